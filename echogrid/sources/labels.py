"""Event label files: tab-separated text tracks and record datasets."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from echogrid.functions import numeric as N
from echogrid.functions.labels import trimmed
from echogrid.operators.events import normalize_records
from echogrid.schema import HEARD, PRODUCED, InputError, require_columns


def _lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Trimmed content lines in file order; blank and # lines left out."""
    raw = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("ev_ord"),
        trimmed(F.col("value")).alias("line"),
    )
    return raw.filter((F.col("line") != "") & ~F.col("line").startswith("#"))


def _reject(rows: DataFrame, bad, code: str, message: str) -> None:
    """Raise with the first offending row, and its line where rows come from a text file, when any is ``bad``."""
    hit = rows.filter(bad).take(1)
    if not hit:
        return
    row = hit[0].asDict()
    where = ""
    if "file" in row:
        # Lines are only numbered now that there is an error to tell.
        numbered = rows.sparkSession.read.text(row["file"]).select(trimmed(F.col("value"))).rdd.zipWithIndex()
        at = numbered.filter(lambda x: x[0][0] == row["line"]).map(lambda x: x[1]).take(1)
        where = f"line {at[0] + 1} of {row['file']}, " if at else ""
    raise InputError(code, f"{message}: {where}{row}")


def check_events(events: DataFrame) -> None:
    """Kinds known, times finite, offsets not before onsets."""
    known = F.coalesce(F.col("kind").isin(PRODUCED, HEARD), F.lit(False))
    _reject(events, ~known, "InvalidLabelKind", "kind must be produced or perceived")
    finite = F.coalesce(N.is_finite(F.col("t_on")) & N.is_finite(F.col("t_off")), F.lit(False))
    _reject(events, ~finite, "InvalidLabelTimes", "times must be finite numbers")
    _reject(events, F.col("t_off") < F.col("t_on"), "InvalidLabelTimes", "offset precedes onset")


def _number(field: int) -> Column:
    """A field as a number: decimal digits, sign and exponent, or an infinity or NaN by name; else null."""
    text = trimmed(F.try_element_at("p", F.lit(field)))
    plain = text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eEdD][+-]?\d+)?$")
    named = text.rlike(r"(?i)^[+-]?(inf(inity)?|nan)$")
    return F.when(plain, F.regexp_replace(text, "[dD]", "e").try_cast("double")).when(named, text.try_cast("double"))


def parse_lines(lines: DataFrame, default_kind: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Events of trimmed label lines (session_id, ev_ord, line).

    Fields after the second are the label, tabs kept. Unparsable times and
    unknown kinds come out null.
    """
    parts = lines.withColumn("p", F.split("line", "\t"))
    label = trimmed(F.concat_ws("\t", F.slice("p", 3, F.greatest(F.size("p") - 2, F.lit(0)))))
    named = F.when(F.lower(label).isin(PRODUCED, HEARD), F.lower(label))
    fallback = F.lit(default_kind.strip().lower()) if default_kind else F.lit(None).cast("string")
    return parts.select(
        "session_id",
        "ev_ord",
        F.coalesce(named, fallback).alias("kind"),
        _number(1).alias("t_on"),
        _number(2).alias("t_off"),
        label.alias("label"),
        *keep,
    )


def load_text(
    spark: SparkSession, path: str | list[str], default_kind: str | None = None, session_id: int | None = None
) -> DataFrame:
    """Events of tab-separated label tracks (start, stop[, label...]).

    The kind is the label when that names a kind, else ``default_kind``. The
    session is ``session_id`` or the digits after ``S`` in the file name.
    """
    lines = _lines(spark, path)
    if session_id is None:
        # Only the file name counts; folders may hold other capital S runs.
        digits = F.regexp_extract(F.element_at(F.split("file", "/"), -1), r"S(\d+)", 1)
        session = F.coalesce(F.nullif(digits, F.lit("")).cast("bigint"), F.lit(0).cast("bigint"))
    else:
        session = F.lit(session_id).cast("bigint")
    lines = lines.withColumn("session_id", session)
    few = F.size(F.split("line", "\t")) < 2
    _reject(lines, few, "InvalidLabelsStruct", "labels need onset and offset columns")
    events = parse_lines(lines, default_kind, ("file", "line"))
    check_events(events)
    return events.drop("file", "line")


def load_records(spark: SparkSession, path: str, default_kind: str | None = None) -> DataFrame:
    """Events from Parquet records (kind, onset, offset, label[, session_id])."""
    df = spark.read.parquet(path)
    require_columns(df, ["kind", "onset", "offset", "label"], "InvalidLabelsStruct")
    if "session_id" not in df.columns:
        df = df.withColumn("session_id", F.lit(0).cast("bigint"))
    if "ev_ord" not in df.columns:
        df = df.withColumn("ev_ord", F.monotonically_increasing_id())
    events = normalize_records(df, default_kind)
    check_events(events)
    return events


def load_labels(
    spark: SparkSession, path: str, default_kind: str | None = None, session_id: int | None = None
) -> DataFrame:
    """Dispatch by extension: .txt tracks or .parquet records."""
    if not path:
        raise InputError("InvalidInput", "a label path is required")
    ext = os.path.splitext(path.rstrip("/"))[1].lower()
    if ext == ".txt":
        return load_text(spark, path, default_kind, session_id)
    if ext == ".parquet":
        return load_records(spark, path, default_kind)
    raise InputError("UnsupportedLabelFormat", "labels must be .txt tracks or .parquet records")


def count_label_lines(spark: SparkSession, path: str) -> int:
    """Content lines of a label track; 0 when it does not exist."""
    if "://" not in path and not os.path.exists(path):
        return 0
    return _lines(spark, path).count()
