"""Token counts under a unigram model, with dynamic programming shared along a trie.

The distinct pre-tokens of a batch, in sorted order, are the depth-first walk of
their trie. The forward scores of the walk's path stay on a stack, so every
shared prefix is scored once; the end of a pre-token stores its token count, and
documents add these up.

Piece costs come from the rank in a public byte vocabulary by Zipf's law, as
whole numbers, so sums are exact and ties are settled by the smaller count.
"""

from __future__ import annotations

import base64
import math
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import text_or_empty

VOCABULARY = "byte_bpe_50k.tiktoken"
# Documents whose pre-tokens share one trie.
BATCH_DOCS = 2000


def piece_costs(path: str) -> dict[bytes, int]:
    """Cost of each piece of a rank file: 1000 times the logarithm of rank + 2, rounded."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return {piece: round(1000 * math.log(rank + 2)) for piece, rank in ranks.items()}


class Unigram:
    """Pieces spelled backwards in a trie, so that those ending at a place are one walk."""

    def __init__(self, costs: dict[bytes, int]):
        self.step: dict[int, int] = {}
        self.cost = [-1]
        for piece, cost in costs.items():
            node = 0
            for byte in reversed(piece):
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(self.cost)
                    self.cost.append(-1)
                node = self.step[key]
            self.cost[node] = cost

    def counts(self, tokens: list[bytes]) -> dict[bytes, int]:
        """Tokens of the cheapest segmentation of each pre-token; sharing of prefixes needs them sorted."""
        step, cost = self.step, self.cost
        out: dict[bytes, int] = {}
        path = b""
        # Cost and count of the cheapest segmentation of each prefix of the path.
        best: list[tuple[int, int]] = [(0, 0)]
        for word in tokens:
            shared = 0
            for x, y in zip(path, word, strict=False):
                if x != y:
                    break
                shared += 1
            del best[shared + 1 :]
            for end in range(shared + 1, len(word) + 1):
                node, least = 0, None
                for start in range(end - 1, -1, -1):
                    node = step.get(node << 8 | word[start], -1)
                    if node < 0:
                        break
                    c = cost[node]
                    if c >= 0:
                        before = best[start]
                        way = (before[0] + c, before[1] + 1)
                        if least is None or way < least:
                            least = way
                if least is None:
                    raise ValueError("the vocabulary lacks a byte of the text")
                best.append(least)
            path = word
            out[word] = best[-1][1]
        return out


_LOADED: dict[str, Unigram] = {}


def unigram(vocabulary: str) -> Unigram:
    """The worker's model for a path, or for the name of a file of the public tokenizers package."""
    if vocabulary not in _LOADED:
        path = vocabulary
        if not os.path.isabs(vocabulary):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _LOADED[vocabulary] = Unigram(piece_costs(path))
    return _LOADED[vocabulary]


def pre_tokens(text: str) -> list[bytes]:
    """Words in UTF-8; a blank goes before each when it is scored."""
    return text.encode().split()


def count_tokens(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_words, n_tokens`` of every row, in one scan without a shuffle.

    Null and empty texts, and texts of white space, count 0. Repeated rows stay.
    Other columns are ignored; an empty table gives an empty result.
    """
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = unigram(vocabulary)
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_DOCS):
                batch = whole.slice(at, BATCH_DOCS)
                words = [pre_tokens(t) for t in batch.column(1).to_pylist()]
                distinct = sorted(set().union(*words))
                ends = model.counts([b" " + w for w in distinct])
                stored = dict(zip(distinct, ends.values(), strict=True))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0),
                        pa.array([len(w) for w in words], pa.int64()),
                        pa.array([sum(map(stored.__getitem__, w)) for w in words], pa.int64()),
                    ],
                    schema=out,
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
