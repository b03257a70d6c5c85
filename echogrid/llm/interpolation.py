"""Language-model scores by deleted interpolation of n-grams.

Counts of one, two and three tokens give maximum-likelihood estimates. They are
mixed with a uniform share; the weights depend on how often the context was
seen, and expectation-maximisation finds them on counts that the estimates have
not seen: part of the training texts is held out from the estimates for this.
The counts that score take in all training texts.

How it is spread: texts are packed into chunks of about a million tokens. A
chunk asks for the counts of its distinct n-grams by their hashes, sorted and
cut into ranges of the hash (shards). A shard adds up what all chunks tell and
answers each with the totals in the order of its question, so neither text nor
hash travels back. A frequent n-gram is one entry a chunk, whatever its count.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import mixed, shuffle_partitions, stored, text_or_empty, word_hashes
from echogrid.runtime import spread

ORDER = 3
# Rows with the remainder TEST of crc32(doc_id) by FOLDS are no training texts; those with TUNE teach the weights.
FOLDS, TEST, TUNE = 7, 2, 5
CHUNK_TOKENS = 1 << 20
# Bits kept of the hash of two and of three tokens; words keep all 64, as their counts are told.
GRAM_BITS = 48
# Contexts of one order fall into so many classes by the power of two of their count.
CLASSES = 24
# Steps of an estimate's logarithm, per power of two, in which tokens are added up to learn the weights.
FINE = 2
# The uniform share stays above this, so that no text is impossible.
LEAST_SHARE = 1e-6
ROUNDS = 200

# Two places before a text, and its end.
_FIRST, _SECOND, _END = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_FACTOR = np.uint64(0x9FB21C651E98DF25)
_LEAD = ORDER - 1


def packed(numbers: np.ndarray) -> bytes:
    """Whole numbers, compressed byte place by byte place."""
    data = np.ascontiguousarray(numbers, np.uint64)
    return zstandard.compress(data.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(blob), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def packed_sorted(keys: np.ndarray) -> bytes:
    return packed(np.diff(keys, prepend=np.uint64(0)))


def unpacked_sorted(blob: bytes) -> np.ndarray:
    return np.cumsum(unpacked(blob), dtype=np.uint64)


def by_frequency(counts: np.ndarray) -> np.ndarray:
    return np.argsort(-counts.astype(np.int64), kind="stable")


def tokens(text: str) -> np.ndarray:
    """Two starts, the hash of each word with A-Z as a-z, and the end."""
    return np.concatenate([[_FIRST, _SECOND], word_hashes(text), [_END]]).astype(np.uint64)


# A chunk: ids and numbers of tokens (starts included) of its texts; distinct tokens with counts; the texts as ranks by count.
CHUNK = "chunk long, kind int, ids array<long>, sizes array<long>, words binary, counts binary, ranks binary"
CORE, TUNED, TESTED = 0, 1, 2


def chunks(docs: DataFrame, most: int = CHUNK_TOKENS) -> DataFrame:
    """Pack ``docs(doc_id, text, kind)`` into chunks of one kind; each row of the result is one."""
    schema = pa.schema(
        [("chunk", pa.int64()), ("kind", pa.int32()), ("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64()))]
        + [(k, pa.binary()) for k in ("words", "counts", "ranks")]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, seq = TaskContext.get().partitionId() << 32, 0
        ids: dict[int, list] = {k: [] for k in (CORE, TUNED, TESTED)}
        held: dict[int, list] = {k: [] for k in ids}
        size = dict.fromkeys(ids, 0)

        def flush(kind: int) -> pa.RecordBatch:
            nonlocal seq
            words, places, counts = np.unique(np.concatenate(held[kind]), return_inverse=True, return_counts=True)
            rank = np.empty(len(words), np.int64)
            rank[by_frequency(counts)] = np.arange(len(words))
            row = [base + seq, kind, ids[kind], [len(x) for x in held[kind]]]
            row += [packed_sorted(words), packed(counts), packed(rank[places])]
            seq += 1
            ids[kind], held[kind], size[kind] = [], [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema, strict=True)], schema=schema)

        for batch in batches:
            for doc_id, text, kind in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids[kind].append(doc_id)
                held[kind].append(tokens(text))
                size[kind] += len(held[kind][-1])
                if size[kind] >= most:
                    yield flush(kind)
        for kind in ids:
            if ids[kind]:
                yield flush(kind)

    return docs.mapInArrow(run, CHUNK)


@dataclass
class Grams:
    """A chunk's n-grams of each order: sorted distinct hashes, counts, and at each token the place of the one that ends there.

    N-grams that reach from one text into the next are among them; nothing asks for those.
    """

    keys: list[np.ndarray]
    counts: list[np.ndarray]
    places: list[np.ndarray]


def grams(words: np.ndarray, counts: np.ndarray, ranks: np.ndarray, placed: bool) -> Grams:
    word = by_frequency(counts)[ranks.astype(np.int64)]
    sequence = words[word]
    out = Grams([words], [counts], [word])
    at = sequence
    for k in range(1, ORDER):
        at = mixed(at[:-1] * _FACTOR + sequence[k:])
        short = at >> np.uint64(64 - GRAM_BITS)
        if placed:
            keys, place = np.unique(short, return_inverse=True)
            out.places.append(np.concatenate([np.zeros(k, np.int64), place]))
            out.counts.append(np.zeros(0, np.int64))
        else:
            keys, number = np.unique(short, return_counts=True)
            out.counts.append(number)
        out.keys.append(keys)
    return out


def _bits(k: int) -> int:
    return GRAM_BITS if k else 64


def _bounds(k: int, shards: int) -> np.ndarray:
    """First hash of each shard but the first one."""
    return np.array([-(-(s << _bits(k)) // shards) for s in range(1, shards)], np.uint64)


_QUESTION = [f"{name}{k}" for k in range(ORDER) for name in ("keys", "n")]


def questions(packs: DataFrame, shards: int) -> DataFrame:
    """``shard, chunk, kind`` with the sorted hashes and counts of each order that the chunk has in the shard."""
    schema = pa.schema([("shard", pa.int32()), ("chunk", pa.int64()), ("kind", pa.int32())] + [(c, pa.binary()) for c in _QUESTION])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = [_bounds(k, shards) for k in range(ORDER)]
        for batch in batches:
            for row in batch.to_pylist():
                g = grams(unpacked_sorted(row["words"]), unpacked(row["counts"]), unpacked(row["ranks"]), placed=False)
                cuts = [np.concatenate([[0], np.searchsorted(x, b), [len(x)]]) for x, b in zip(g.keys, bounds, strict=True)]
                columns: list[list] = [[] for _ in _QUESTION]
                for s in range(shards):
                    for k in range(ORDER):
                        part = slice(cuts[k][s], cuts[k][s + 1])
                        columns[2 * k].append(packed_sorted(g.keys[k][part]))
                        columns[2 * k + 1].append(packed(g.counts[k][part]))
                head = [np.arange(shards, dtype=np.int32), np.full(shards, row["chunk"]), np.full(shards, row["kind"], np.int32)]
                arrays = [pa.array(x) for x in head] + [pa.array(x, pa.binary()) for x in columns]
                yield pa.RecordBatch.from_arrays(arrays, schema=schema)

    return packs.select("chunk", "kind", "words", "counts", "ranks").mapInArrow(
        run, "shard int, chunk long, kind int, " + ", ".join(f"{c} binary" for c in _QUESTION)
    )


_TOTALS = ("tokens", "types", "core_tokens", "core_types")
_ANSWER = [f"{name}{k}" for k in range(ORDER) for name in ("total", "core")]
ANSWER = "chunk long, shard int, kind int, " + ", ".join(f"{c} binary" for c in _ANSWER) + ", " + ", ".join(f"{c} long" for c in _TOTALS)


def answers(asked: DataFrame) -> DataFrame:
    """Totals over all chunks for each question, in its order; once a shard also its tokens and distinct tokens.

    ``total`` counts all training texts, ``core`` only those that the weights are not learnt on (told to chunks
    that teach weights, empty for others). The row of a shard's own sums has no chunk.
    """
    schema = pa.schema(
        [("chunk", pa.int64()), ("shard", pa.int32()), ("kind", pa.int32())]
        + [(c, pa.binary()) for c in _ANSWER]
        + [(c, pa.int64()) for c in _TOTALS]
    )

    def run(asked: pa.Table) -> pa.Table:
        kinds, names = asked.column("kind").to_pylist(), asked.column("chunk").to_pylist()
        shard = asked.column("shard")[0].as_py()
        columns: list[list] = []
        sums = [0, 0, 0, 0]
        for k in range(ORDER):
            keys = [unpacked_sorted(x.as_py()) for x in asked.column(f"keys{k}")]
            distinct, place = np.unique(np.concatenate(keys), return_inverse=True)
            ends = np.cumsum([len(x) for x in keys])
            total, core = np.zeros(len(distinct), np.int64), np.zeros(len(distinct), np.int64)
            for end, x, kind, n in zip(ends, keys, kinds, asked.column(f"n{k}"), strict=True):
                at = place[end - len(x) : end]
                # The hashes of one question differ, so each place is met once.
                if kind != TESTED:
                    counts = unpacked(n.as_py()).astype(np.int64)
                    total[at] += counts
                    if kind == CORE:
                        core[at] += counts
            if not k:
                real = (distinct != _FIRST) & (distinct != _SECOND)
                sums = [int(f) for x in (total, core) for f in (x[real].sum(), (x[real] > 0).sum())]
            del keys
            told_total, told_core = [], []
            start = 0
            for end, kind in zip(ends, kinds, strict=True):
                at = place[start:end]
                told_total.append(packed(total[at]))
                told_core.append(packed(core[at]) if kind == TUNED else b"")
                start = end
            columns += [told_total, told_core]
        n = len(names)
        arrays = [pa.array([*names, None], pa.int64()), pa.array([shard] * (n + 1), pa.int32()), pa.array([*kinds, None], pa.int32())]
        arrays += [pa.array([*x, None], pa.binary()) for x in columns]
        arrays += [pa.array([None] * n + [x], pa.int64()) for x in sums]
        return pa.Table.from_arrays(arrays, schema=schema)

    return spread(asked, "shard").groupBy("shard").applyInArrow(run, ANSWER)


@dataclass
class Estimates:
    """Per token: estimates of orders 1 to 3 (0 where the context is unknown), class of the context, count, and if it is a start."""

    shares: np.ndarray
    kind: np.ndarray
    count: np.ndarray
    start: np.ndarray
    sizes: np.ndarray


def estimates(chunk: dict, told: pa.Table, which: str, n_tokens: int) -> Estimates:
    """Look up a chunk's n-grams in the answers of all shards; ``which`` is total or core."""
    g = grams(unpacked_sorted(chunk["words"]), unpacked(chunk["counts"]), unpacked(chunk["ranks"]), placed=True)
    told = told.sort_by("shard")
    at = []
    for k in range(ORDER):
        counts = np.concatenate([unpacked(x.as_py()) for x in told.column(f"{which}{k}")]).astype(np.float64)
        at.append(counts[g.places[k]])
    sizes = np.array(chunk["sizes"], np.int64)
    start = np.zeros(len(at[0]), bool)
    for k in range(_LEAD):
        start[np.cumsum(sizes) - sizes + k] = True
    shares = np.zeros((ORDER, len(start)))
    shares[0] = at[0] / max(n_tokens, 1)
    kind = np.zeros(len(start), np.int64)
    for k in range(1, ORDER):
        context = np.concatenate([[0.0], at[k - 1][:-1]])
        known = context > 0
        np.divide(at[k], context, out=shares[k], where=known)
        level = np.minimum(np.log2(np.where(known, context, 1)).astype(np.int64), CLASSES - 1)
        # The longest known context decides.
        kind = np.where(known, 1 + (k - 1) * CLASSES + level, kind)
    return Estimates(shares, kind, at[0], start, sizes)


def cells(packs: DataFrame, told: DataFrame, n_core: int) -> DataFrame:
    """Tokens of the tuning texts in cells of like estimates: ``kind, cell, n`` and the sums of the three estimates."""

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        e = estimates(chunk.to_pylist()[0], told, "core", n_core)
        real = ~e.start
        shares, kind = e.shares[:, real], e.kind[real]
        cell = np.zeros(len(kind), np.int64)
        for x in shares:
            step = np.where(x > 0, np.clip(1 - np.floor(FINE * np.log2(np.where(x > 0, x, 1))), 1, 255), 0)
            cell = cell * 256 + step.astype(np.int64)
        both, place = np.unique(kind << 24 | cell, return_inverse=True)
        sums = [np.bincount(place, x, len(both)) for x in shares]
        arrays = [both >> 24, both & 0xFFFFFF, np.bincount(place, minlength=len(both)), *sums]
        return pa.table([pa.array(x) for x in arrays], names=["kind", "cell", "n", "s0", "s1", "s2"])

    return (
        spread(packs, "chunk")
        .groupBy("chunk")
        .cogroup(spread(told, "chunk").groupBy("chunk"))
        .applyInArrow(run, "kind long, cell long, n long, s0 double, s1 double, s2 double")
        .groupBy("kind", "cell")
        .agg(*(F.sum(c).alias(c) for c in ("n", "s0", "s1", "s2")))
    )


def maximised(shares: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """Weights of the rows of ``shares`` that make ``n`` tokens of each column likeliest, by expectation-maximisation."""
    weight = np.full(len(shares), 1 / len(shares))
    for _ in range(rounds):
        part = weight[:, None] * shares
        new = (part / part.sum(axis=0) * n).sum(axis=1) / n.sum()
        done = np.abs(new - weight).max() < 1e-7
        weight = new
        if done:
            break
    return weight


def mixture(found: DataFrame, core_types: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (uniform, orders 1 to 3) of each class. Each class's cells meet in one task: steps of estimates, not tokens.

    A class that the tuning texts don't have takes the weights of the next lower one of its order, else of the next higher.
    """

    def run(part: pa.Table) -> pa.Table:
        n = part.column("n").to_numpy().astype(np.float64)
        shares = np.array([np.full(len(n), 1 / (core_types + 1))] + [part.column(f"s{k}").to_numpy() / n for k in range(ORDER)])
        weight = maximised(shares, n, rounds)
        return pa.table([part.column("kind")[:1], *([x] for x in weight)], names=["kind", "w0", "w1", "w2", "w3"])

    rows = found.groupBy("kind").applyInArrow(run, "kind long, w0 double, w1 double, w2 double, w3 double").collect()
    learnt = {r.kind: np.array(r[1:]) for r in rows}
    out = np.zeros((1 + _LEAD * CLASSES, ORDER + 1))
    for kind in range(len(out)):
        order = 0 if not kind else 1 + (kind - 1) // CLASSES
        same = sorted((x for x in learnt if (0 if not x else 1 + (x - 1) // CLASSES) == order), key=lambda x: (x > kind, abs(x - kind)))
        weight = learnt[same[0]] if same else np.full(ORDER + 1, 1.0)
        # Orders above the known context have no estimate to give.
        weight = np.where(np.arange(ORDER + 1) <= order + 1, weight, 0)
        weight[0] = max(weight[0], LEAST_SHARE)
        out[kind] = weight / weight.sum()
    return out


OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, rounds: int = ROUNDS, chunk_tokens: int = CHUNK_TOKENS) -> DataFrame:
    """Log10 probability of every text under the interpolated model, and under smoothed token counts alone.

    One row per input row: ``doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score, score``. Null text counts as empty: its one token is the end. A
    null doc_id is a training row. Repeated rows count as often as they are
    there. Without training texts every token has the uniform share 1. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % FOLDS
    kind = F.when(fold == TEST, TESTED).when(fold == TUNE, TUNED).otherwise(CORE)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), kind.cast("int").alias("kind"))
    packs = stored(chunks(texts, chunk_tokens), "lm-chunks")
    # Several shards a partition, as they are dealt out by hash.
    told = stored(answers(questions(packs, 4 * shuffle_partitions(spark))), "lm-answers")
    sums = told.filter("chunk IS NULL").agg(*(F.sum(c).alias(c) for c in _TOTALS)).first()
    n, types, n_core, core_types = (x or 0 for x in sums)
    told = told.filter("chunk IS NOT NULL")
    tuning = told.filter(F.col("kind") == TUNED).select("chunk", "shard", *(f"core{k}" for k in range(ORDER)))
    weight = mixture(cells(packs.filter(F.col("kind") == TUNED), tuning, n_core), core_types, rounds)
    if not n:
        weight = np.tile(np.eye(ORDER + 1)[0], (len(weight), 1))

    def run(chunk: pa.Table, told: pa.Table) -> pa.Table:
        row = chunk.to_pylist()[0]
        e = estimates(row, told, "total", n)
        w = weight[e.kind]
        mixed_share = w[:, 0] / (types + 1)
        for k in range(ORDER):
            mixed_share += w[:, k + 1] * e.shares[k]
        real = ~e.start
        first = np.cumsum(e.sizes) - e.sizes

        def per_text(values: np.ndarray) -> np.ndarray:
            return np.add.reduceat(np.where(real, values, 0), first)

        size = len(first)
        arrays = [
            pa.array(row["ids"], pa.int64()),
            pa.array(np.full(size, row["kind"] == TESTED)),
            pa.array(e.sizes - _LEAD),
            pa.array(per_text((e.count > 0).astype(np.int64))),
            pa.array(np.full(size, n)),
            pa.array(per_text(np.log10((e.count + 1) / (n + types + 1)))),
            pa.array(per_text(np.log10(mixed_share))),
        ]
        return pa.table(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    totals = told.select("chunk", "shard", *(f"total{k}" for k in range(ORDER)))
    return (
        spread(packs, "chunk").groupBy("chunk").cogroup(spread(totals, "chunk").groupBy("chunk")).applyInArrow(run, OUT)
    )
