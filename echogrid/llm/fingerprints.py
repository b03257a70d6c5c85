"""Document fingerprints by content-defined chunking.

A rolling gear hash over the last 32 bytes marks cut points, so a shift of the
text shifts the cuts with it. Cuts are normalised: a strict mask below the usual
chunk size, a loose one above it. The fingerprint is the set of chunk digests,
each with its chunk's length as weight; likeness is the weight of a text's
chunks that the other text holds too, over its whole weight.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import blake2b, sha256

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from echogrid.llm.common import shuffle_partitions, text_or_empty
from echogrid.runtime import materialize


@dataclass(frozen=True)
class Chunking:
    """Sizes in bytes and mask widths in bits; ``most`` stays below 256, so that a length is one byte."""

    least: int = 16
    usual: int = 40
    most: int = 160
    strict_bits: int = 7
    loose_bits: int = 4


DEFAULT = Chunking()
DIGEST_BYTES = 6
# Hex digits of one chunk in a fingerprint: digest and length.
ENTRY = 2 * DIGEST_BYTES + 2


def gear_table() -> np.ndarray:
    """256 random-looking 32-bit numbers, one for each byte."""
    return np.array([int.from_bytes(blake2b(bytes([b]), digest_size=4).digest(), "big") for b in range(256)], np.uint32)


_GEAR = gear_table()


def rolling(data: bytes) -> np.ndarray:
    """Gear hash at each byte: sum of the last 32 bytes' numbers, each shifted by its distance."""
    h = _GEAR[np.frombuffer(data, np.uint8)]
    width = 1
    while width < 32:
        if len(h) > width:
            h[width:] = h[width:] + (h[:-width] << np.uint32(width))
        width *= 2
    return h


def chunks(data: bytes, c: Chunking = DEFAULT) -> list[bytes]:
    """Cut ``data`` at its own marks; the last chunk may be short."""
    if not data:
        return []
    h = rolling(data)
    loose_at = np.flatnonzero(h >> np.uint32(32 - c.loose_bits) == 0)
    strict_at = loose_at[h[loose_at] >> np.uint32(32 - c.strict_bits) == 0].tolist()
    loose = loose_at.tolist()
    out, start, n = [], 0, len(data)
    while n - start > c.least:
        end = min(start + c.most, n)
        k = bisect_left(strict_at, start + c.least - 1)
        if k < len(strict_at) and strict_at[k] < start + c.usual - 1:
            end = min(end, strict_at[k] + 1)
        else:
            k = bisect_left(loose, start + c.usual - 1)
            if k < len(loose):
                end = min(end, loose[k] + 1)
        out.append(data[start:end])
        start = end
    if start < n:
        out.append(data[start:])
    return out


def entries(text: str, c: Chunking = DEFAULT) -> set[str]:
    """Distinct chunks of a text: hex digest followed by the length in two hex digits."""
    return {
        blake2b(x, digest_size=DIGEST_BYTES).hexdigest() + f"{len(x):02x}" for x in set(chunks(text.encode(), c))
    }


def fingerprint(found: set[str]) -> str:
    return "".join(sorted(found))


def read_fingerprint(s: str) -> set[str]:
    return {s[i : i + ENTRY] for i in range(0, len(s), ENTRY)}


def weight(found: set[str]) -> int:
    return sum(int(e[-2:], 16) for e in found)


def likeness(own: set[str], other: set[str]) -> float:
    """Containment of ``own`` in ``other`` by weight; without chunks 1 if the other has none either, else 0."""
    if not own:
        return 0.0 if other else 1.0
    return weight(own & other) / weight(own)


def edited(text: str, following: str) -> str:
    """``text`` with its last half replaced by as much of ``following`` as there is."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _buckets(docs: DataFrame) -> DataFrame:
    """Add ``bucket``, a range of doc_id; ranges come from approximate quantiles and only spread the work."""
    # Several ranges for each partition, as they are dealt out by hash.
    n = 4 * shuffle_partitions(docs.sparkSession)
    cuts = docs.approxQuantile("doc_id", [i / n for i in range(1, n)], 1 / (4 * n)) 
    bounds = np.array(sorted({int(c) for c in cuts}), dtype=np.int64)

    @pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, ids.to_numpy(), side="right") + 1).astype("int32")

    # Pandas would turn ids with nulls into floats, so nulls are set apart outside.
    placed = bucket(F.coalesce("doc_id", F.lit(0).cast("long")))
    return docs.withColumn("bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(placed))


def edited_fingerprints(docs: DataFrame, c: Chunking = DEFAULT) -> DataFrame:
    """Fingerprints of every text and of its edited text, whose end comes from the next document.

    One row per input row: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``. The next document is that of
    the next smaller (doc_id, text); after the last comes the first. Null text
    counts as empty, a null doc_id as the smallest. Repeated rows stay and
    follow each other. A single row is its own next. Other columns are ignored;
    an empty table gives an empty result.

    Rows are sorted inside ranges of doc_id. The first row of the next range is
    sent along, so that the last row of a range meets its next document.
    """
    rows = _buckets(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")))
    # One row per range: at most four times the number of shuffle partitions.
    heads = materialize(
        rows.groupBy("bucket").agg(F.max(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "text")).alias("head"))
    )
    order = Window.orderBy(F.desc("bucket"))
    all_ = Window.partitionBy()
    follows = heads.select(
        "bucket", F.coalesce(F.lead("bucket").over(order), F.max("bucket").over(all_)).alias("next_bucket")
    )
    guests = (
        follows.join(heads.select(F.col("bucket").alias("next_bucket"), "head"), "next_bucket")
        .select(F.lit(None).cast("long").alias("doc_id"), F.col("head.text").alias("text"), "bucket", F.lit(True).alias("guest"))
    )
    n = shuffle_partitions(docs.sparkSession)
    ranged = (
        rows.withColumn("guest", F.lit(False))
        .unionByName(guests)
        .repartition(n, "bucket")
        .sortWithinPartitions("bucket", "guest", F.col("doc_id").desc_nulls_last(), F.desc("text"))
        .select("doc_id", "text", "guest")
    )
    out = pa.schema(
        [
            ("doc_id", pa.int64()),
            ("n_chars", pa.int64()),
            ("edited_sha256", pa.string()),
            ("fingerprint", pa.string()),
            ("edited_fingerprint", pa.string()),
            ("near_edited", pa.float64()),
            ("near_next", pa.float64()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            done: list[list] = [[] for _ in out]
            for doc_id, text, guest in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                found = entries(text, c)
                if last is not None:
                    last_id, last_text, last_found = last
                    changed = edited(last_text, text)
                    changed_found = entries(changed, c)
                    values = (
                        last_id,
                        len(last_text),
                        sha256(changed.encode()).hexdigest(),
                        fingerprint(last_found),
                        fingerprint(changed_found),
                        likeness(last_found, changed_found),
                        likeness(last_found, found),
                    )
                    for column, v in zip(done, values, strict=True):
                        column.append(v)
                last = None if guest else (doc_id, text, found)
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(done, out, strict=True)], schema=out)

    return ranged.mapInArrow(
        run,
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )
