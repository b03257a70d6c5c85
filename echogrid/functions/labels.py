"""Label and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(text: Column) -> Column:
    """Text without white space of any kind at its ends."""
    return F.regexp_replace(text, r"^[\s\x0B]+|[\s\x0B]+$", "")


def squash(label: Column) -> Column:
    """Trimmed lower-case label without underscores, hyphens and whitespace."""
    return F.regexp_replace(F.lower(trimmed(F.coalesce(label, F.lit("")))), r"[_\-\s]", "")


def call_type(label: Column) -> Column:
    """Canonical call type; the first match in this order wins."""
    s = squash(label)
    bare = F.regexp_replace(s, r"[0-9]+$", "")
    return (
        F.when(F.contains(s, F.lit("trillphee")), "trillphee")
        .when(F.contains(s, F.lit("trill")), "trill")
        .when(F.contains(s, F.lit("twitter")), "twitter")
        .when(F.contains(s, F.lit("phee")), "phee")
        .when(bare != "", bare)
        .when(s != "", s)
        .otherwise("unknown")
    )


def field_suffix(name: Column) -> Column:
    """Lower-case alphanumeric part of a name, ``unknown`` when nothing is left."""
    clean = F.regexp_replace(F.lower(trimmed(name)), "[^a-z0-9]", "")
    return F.coalesce(F.nullif(clean, F.lit("")), F.lit("unknown"))


def call_type_stream(label: Column) -> Column:
    return F.concat(F.lit("produced_"), field_suffix(call_type(label)))


def is_bout_label(label: Column) -> Column:
    return F.contains(squash(label), F.lit("twitter"))


def clean_kind(kind: Column) -> Column:
    return F.lower(trimmed(kind))


def clean_label(label: Column) -> Column:
    return F.coalesce(trimmed(label), F.lit(""))


def display_name(field: Column) -> Column:
    """Stream name as shown in reports."""
    return F.replace(field, F.lit("_"), F.lit(" "))


def session_slug(heard: Column, produced: Column, signal: Column) -> Column:
    """``s<digits>`` from the first path holding an ``S<digits>``, else s000."""

    def digits(path: Column) -> Column:
        return F.nullif(F.regexp_extract(F.coalesce(path, F.lit("")), r"S(\d+)", 1), F.lit(""))

    found = F.coalesce(digits(heard), digits(produced), digits(signal), F.lit("000"))
    return F.concat(F.lit("s"), found)


def track_line(t_on: Column, t_off: Column, label: Column) -> Column:
    """Tab-separated label track line with six decimals."""
    return F.format_string("%.6f\t%.6f\t%s", t_on, t_off, label)
