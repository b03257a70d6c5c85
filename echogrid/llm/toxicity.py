"""Toxicity by maximum-scoring segments.

Every word form and word start gets a log-odds of toxic against clean labelled
documents, with an informative Dirichlet prior drawn from both. A linear scan
over the word scores of a text finds every maximal segment; extreme-value
statistics turn the segments' scores into chances under clean text, and a
logistic curve, fitted on the labelled rows, turns the text's total into a
probability.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import segments, text_or_empty

# Labelled rows that are learnt from, at most; chosen by a hash of doc_id.
TRAINING_ROWS = 20_000
PRIOR = 100.0
LEAST_Z = 2.0
LEAST_ODDS = 1.5
# Lengths of word starts that count as features of their own.
STARTS = (4, 5, 6)
# Score of a word that tells nothing: it ends a segment after a dozen words or so.
DRIFT = -0.4
SIGNIFICANT = 1e-3
REMEMBERED = 400_000


def held_out(doc_id: str = "doc_id", folds: int = 5) -> Column:
    """Rows kept from learning: crc32 of the id's text, modulo ``folds``, is 0. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % folds == 0, F.lit(False))


def features(word: str) -> list[str]:
    """Lower-cased letters of a word, and its starts marked by a star."""
    letters = "".join(c for c in word.lower() if c.isalpha())
    if not letters:
        return []
    return [letters] + [letters[:k] + "*" for k in STARTS if len(letters) >= k]


@dataclass
class Model:
    """Log-odds by feature, scale of the extreme-value law, logistic curve."""

    weights: dict[str, float]
    scale: float = 1.0
    space: float = 0.1
    slope: float = 1.0
    offset: float = 0.0


def sample(labels: DataFrame, most: int = TRAINING_ROWS) -> DataFrame:
    """At most ``most`` labelled rows outside the held-out fold: ``doc_id, toxic``; the choice is a hash of doc_id."""
    usable = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out())
    one = usable.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def _counts(train: DataFrame) -> DataFrame:
    """Labelled documents that hold each feature: ``feature, toxic, clean``."""
    out = pa.schema([("feature", pa.string()), ("toxic", pa.int32()), ("clean", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tally: dict[str, list[int]] = {}
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {f for w in set(text.split()) for f in features(w)}
                for f in found:
                    tally.setdefault(f, [0, 0])[0 if toxic else 1] += 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(list(tally), pa.string()),
                    pa.array([v[0] for v in tally.values()], pa.int32()),
                    pa.array([v[1] for v in tally.values()], pa.int32()),
                ],
                schema=out,
            )

    partial = train.select("text", "toxic").mapInArrow(run, "feature string, toxic int, clean int")
    return partial.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def _log_odds(counts: DataFrame, totals: tuple[int, int]) -> dict[str, float]:
    """Features with z and log-odds of at least ``LEAST_Z`` and ``LEAST_ODDS``; the labelled rows bound their number.

    The prior of a feature is its share of both classes times ``PRIOR``. Only
    toxic features are kept; all others score the drift.
    """
    toxic, clean = totals
    both = toxic + clean
    a = F.lit(PRIOR) * (F.col("toxic") + F.col("clean")) / F.lit(float(both))
    top = F.log((F.col("toxic") + a) / (F.lit(toxic + PRIOR) - F.col("toxic") - a + 1e-9))
    low = F.log((F.col("clean") + a) / (F.lit(clean + PRIOR) - F.col("clean") - a + 1e-9))
    spread = F.sqrt(1 / (F.col("toxic") + a) + 1 / (F.col("clean") + a))
    rows = (
        counts.select("feature", (top - low).alias("odds"), ((top - low) / spread).alias("z"))
        .filter((F.col("z") >= LEAST_Z) & (F.col("odds") >= LEAST_ODDS))
        .collect()
    )
    return {r.feature: r.odds for r in rows}


class _Scores(dict):
    """Score of a word as written: the largest of its features, else the drift."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= REMEMBERED:
            self.clear()
        found = [self.weights[f] for f in features(word) if f in self.weights]
        value = self[word] = max(found) if found else DRIFT
        return value


def _evidence(total: list[tuple[int, int, float]], words: int, model: Model) -> float:
    """Sum over the segments of -log(chance under clean text), where positive.

    A segment of score S is met ``space * words * exp(-scale * S)`` times in a
    clean text, by the extreme-value law of maximal segments.
    """
    expected = math.log(model.space * max(words, 1))
    return sum(max(0.0, model.scale * s - expected) for _, _, s in total)


def _clean_scores(clean: DataFrame, weights: dict[str, float]) -> list[tuple[float, float]]:
    """Word scores above the drift in clean texts, with their shares of all words (at most one row per feature)."""
    out = pa.schema([("score", pa.float64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Scores(weights)
        for batch in batches:
            tally: dict[float, int] = {}
            for text in batch.column(0).to_pylist():
                for w in text.split():
                    s = table[w]
                    tally[s] = tally.get(s, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(tally), pa.float64()), pa.array(list(tally.values()), pa.int64())], schema=out)

    rows = clean.select("text").mapInArrow(run, "score double, n long").groupBy("score").agg(F.sum("n").alias("n")).collect()
    words = sum(r.n for r in rows)
    return [(r.score, r.n / words) for r in rows if r.score > 0]


def _tail(counts: list[tuple[float, float]]) -> float:
    """Scale of the extreme-value law: the positive root of E[exp(scale * score)] = 1 on clean words."""
    drift = 1.0 - sum(p for _, p in counts)
    high = 1e-6
    value = lambda x: drift * math.exp(x * DRIFT) + sum(p * math.exp(min(x * s, 700.0)) for s, p in counts)
    if not counts or value(1e-4) >= 1.0:
        return 1.0
    while value(high) < 1.0 and high < 64.0:
        high *= 2
    low = high / 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if value(mid) < 1.0 else (low, mid)
    return min(low, 64.0)


def _scored(texts: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """``keep`` columns with ``evidence, n_words, passages`` of each text; ``text`` is the last column."""
    kept_schema = ", ".join(f"{c} {t}" for c, t in texts.select(*keep).dtypes)
    passage = pa.struct([("start_word", pa.int64()), ("end_word", pa.int64()), ("score", pa.float64()), ("p_value", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _Scores(model.weights)
        for batch in batches:
            evidence, n_words, passages = [], [], []
            for text in batch.column(len(keep)).to_pylist():
                words = text.split()
                scores = [table[w] for w in words]
                found = segments(scores) if scores and max(scores) > 0 else []
                evidence.append(_evidence(found, len(words), model))
                n_words.append(len(words))
                told = []
                for start, end, s in found:
                    p = -math.expm1(-model.space * len(words) * math.exp(-model.scale * s))
                    if p <= SIGNIFICANT:
                        told.append({"start_word": start, "end_word": end, "score": s, "p_value": p})
                passages.append(told)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in range(len(keep))), pa.array(evidence, pa.float64()), pa.array(n_words, pa.int64()), pa.array(passages, pa.list_(passage))],
                names=[*keep, "evidence", "n_words", "passages"],
            )

    return texts.select(*keep, "text").mapInArrow(
        run,
        f"{kept_schema}, evidence double, n_words long, passages array<struct<start_word: long, end_word: long, score: double, p_value: double>>",
    )


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic curve, by Newton steps with a small ridge."""
    w = np.zeros(2)
    design = np.stack([x, np.ones_like(x)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        step = np.linalg.solve(
            design.T @ (design * (p * (1 - p))[:, None]) + 1e-3 * np.eye(2), design.T @ (y - p) - 1e-3 * w
        )
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def fit(docs: DataFrame, labels: DataFrame, most: int = TRAINING_ROWS) -> Model:
    """Learn from at most ``most`` labelled rows outside the held-out fold.

    Only text is an input. Without labelled rows of both classes nothing can be
    told apart, and every text scores the share of toxic rows (one half if none).
    """
    chosen = sample(labels, most)
    # At most `most` rows of two numbers.
    train = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(chosen), "doc_id").select("text", "toxic")
    toxic, clean = train.agg(
        F.coalesce(F.sum((F.col("toxic") > 0).cast("int")), F.lit(0)), F.coalesce(F.sum((F.col("toxic") <= 0).cast("int")), F.lit(0))
    ).first()
    if not toxic or not clean:
        share = toxic / (toxic + clean) if toxic + clean else 0.5
        return Model({}, slope=0.0, offset=math.log((share + 1e-3) / (1 - share + 1e-3)))
    weights = _log_odds(_counts(train), (toxic, clean))
    flat = Model(weights)
    flat.scale = _tail(_clean_scores(train.filter("toxic <= 0"), weights))
    rows = _scored(train, flat, ["toxic"]).select("evidence", "toxic").collect()
    x = np.array([min(r.evidence, 200.0) for r in rows])
    y = np.array([float(r.toxic > 0) for r in rows])
    flat.slope, flat.offset = _logistic(x, y)
    return flat


def score(docs: DataFrame, model: Model) -> DataFrame:
    """One row per input row: ``doc_id, held_out, score, predicted, n_words, passages``.

    Null text counts as empty; an empty text has no segment and scores what the
    curve gives for no evidence. Repeated rows stay. Other columns are ignored;
    an empty table gives an empty result. ``passages`` are the significant ones.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    x = F.col("evidence") * F.lit(model.slope) + F.lit(model.offset)
    return (
        _scored(texts, model, ["doc_id"])
        .withColumn("score", 1 / (1 + F.exp(-x)))
        .select(
            "doc_id",
            held_out().alias("held_out"),
            "score",
            (F.col("score") >= 0.5).cast("int").alias("predicted"),
            "n_words",
            "passages",
        )
    )


def evidence_of(text: Column, model: Model) -> Column:
    """Evidence of a text as a column: only texts go to Python and only a number comes back."""

    @F.arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        table = _Scores(model.weights)
        for batch in batches:
            found = []
            for text in batch:
                words = text.as_py().split()
                scores = [table[w] for w in words]
                found.append(_evidence(segments(scores), len(words), model) if scores and max(scores) > 0 else 0.0)
            yield pa.array(found, pa.float64())

    return run(text)


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score below one half, with all their columns; a null text has no evidence. Repeated rows share their verdict."""
    x = evidence_of(text_or_empty(), model) * F.lit(model.slope) + F.lit(model.offset)
    return docs.filter(x < 0)
