"""BPE encoding and decoding with a tokenization automaton.

The automaton reads tokens. It starts as one state with a loop for each byte.
Each merge (a, b) then adds a gadget: the state that a leads to is copied
without its b arc, a is led to the copy, and every state with an a arc gets an
arc for the merged token, to where b led. The arcs into a state carry one
token, so a state is known by that token and a time; after the last merge the
automaton accepts exactly one token path for each byte string, its BPE encoding.

``MergeAutomaton`` keeps what the gadgets cut (which token, at which merge) and
when each token came; an arc's existence follows from those and goes into the
transition table the first time it is asked for.
"""

from __future__ import annotations

import itertools
import json
import os
import re
from array import array
from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import text_or_empty

VOCABULARY = "byte_bpe_50k.json"
# Pieces and words remembered by a worker, each.
REMEMBERED = 200_000
# Arcs remembered in the transition table.
TRANSITIONS = 1_000_000
NEVER = 1 << 60

# Fixed value: the public byte-level pattern that splits text before the merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_alphabet() -> dict[str, int]:
    """Printable stand-ins of byte-level vocabularies: visible Latin-1 as it is, the rest from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class MergeAutomaton:
    """Deterministic automaton over tokens, built merge by merge."""

    def __init__(self, tokens: dict[bytes, int], merges: list[tuple[bytes, bytes]]):
        self.size = {t: len(b) for b, t in tokens.items()}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.came: dict[int, int] = {}
        # (state's token, token whose arc is cut) -> merge that cut it
        self.cut: dict[tuple[int, int], int] = {}
        self.table: dict[int, bool] = {}
        # Bytes without an entry of their own can't be read.
        arcs = {t for b, t in tokens.items() if len(b) == 1}
        for time, (a, b) in enumerate(merges):
            one, two, whole = tokens[a], tokens[b], tokens[a + b]
            if one not in arcs or two not in arcs or not self.arc(one, two):
                continue  # no path spells a b, so this merge never fires
            if whole in arcs:
                raise ValueError(f"two merges make {a + b!r}")
            self.cut[one, two] = time
            self.left[whole], self.right[whole], self.came[whole] = one, two, time
            arcs.add(whole)
        self.table.clear()
        self.trie: dict[int, int] = {}
        self.label = [-1]
        for spelled, token in tokens.items():
            if token in arcs:
                self._insert(spelled, token)

    def _insert(self, spelled: bytes, token: int) -> None:
        node = 0
        for byte in spelled:
            key = node << 8 | byte
            if key not in self.trie:
                self.trie[key] = len(self.label)
                self.label.append(-1)
            node = self.trie[key]
        self.label[node] = token

    def arc(self, state: int, token: int) -> bool:
        """Has the state behind ``state`` an arc for ``token``?

        The state was copied from that of the token's right part when the token
        came, so it lacks what that one lacked before; a token's arc grew from
        that of its left part, so it is missing where that was cut by then, the
        cut of the same merge included.
        """
        before = NEVER
        while True:
            x, until = token, NEVER
            while True:
                time = self.cut.get((state, x), NEVER)
                if time < before and time <= until:
                    return False
                if x not in self.left:
                    break
                until = self.came[x]
                x = self.left[x]
            if state not in self.right:
                return True
            before = min(before, self.came[state])
            state = self.right[state]

    def encode(self, word: bytes) -> list[int]:
        """Token path of ``word``.

        The longest arc is followed first. Each prefix of a word has one path
        only, so a place that led nowhere is never tried again.
        """
        n = len(word)
        trie, label, table = self.trie, self.label, self.table
        path: list[int] = []
        # Open choices at each place on the path: tokens that match there, longest last.
        choices: list[list[int]] = []
        dead: set[int] = set()
        at, state = 0, -1
        while at < n:
            if len(choices) == len(path):
                node, found = 0, []
                for end in range(at, n):
                    node = trie.get(node << 8 | word[end], -1)
                    if node < 0:
                        break
                    if label[node] >= 0:
                        found.append(label[node])
                choices.append(found)
            found = choices[-1]
            while found:
                token = found.pop()
                if at + self.size[token] in dead:
                    continue
                if state >= 0:
                    key = state << 32 | token
                    open_ = table.get(key)
                    if open_ is None:
                        if len(table) >= TRANSITIONS:
                            table.clear()
                        open_ = table[key] = self.arc(state, token)
                    if not open_:
                        continue
                path.append(token)
                at += self.size[token]
                state = token
                break
            else:
                if not path:
                    raise ValueError("the vocabulary lacks a byte of the text")
                dead.add(at)
                choices.pop()
                at -= self.size[path.pop()]
                state = path[-1] if path else -1
        return path


class _Filled(dict):
    """Remembers what ``make`` gives: the newest ``REMEMBERED`` keys and those used since as many came before."""

    def __init__(self, make):
        super().__init__()
        self.make = make
        self.old: dict = {}

    def __missing__(self, key):
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Tokenizer:
    """Pre-splitting and encoding with one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        spell = lambda s: bytes(alphabet[c] for c in s)
        model = spec["model"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        tokens = {spell(s): i for s, i in model["vocab"].items() if s not in self.added}
        self.automaton = MergeAutomaton(tokens, [(spell(a), spell(b)) for a, b in pairs])
        self.pattern = regex.compile(PATTERN)
        # White space before a blank that no word follows: there pieces can't be cut at single blanks.
        self.tangled = re.compile(r"\s (?:\s|\Z)|\A \s| \Z")
        added = sorted(self.added, key=len, reverse=True)
        self.special = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.words = _Filled(lambda w: array("i", self.automaton.encode(w.encode())).tobytes())
        self.after_blank = _Filled(self._piece)

    def _piece(self, piece: str) -> bytes:
        """Ids of a blank and ``piece``, which holds no blank; letters, or letters and one mark, need no pattern."""
        if piece.isalpha():
            return array("i", self.automaton.encode((" " + piece).encode())).tobytes()
        if piece[:-1].isalpha() and piece[-1] in ".,;:!?":
            return array("i", self.automaton.encode((" " + piece[:-1]).encode())).tobytes() + self.words[piece[-1]]
        return b"".join([self.words[w] for w in self.pattern.findall(" " + piece)])

    def _plain(self, text: str) -> bytes:
        if self.tangled.search(text):
            return b"".join([self.words[w] for w in self.pattern.findall(text)])
        first, *rest = text.split(" ")
        after = self.after_blank
        return b"".join([self.words[w] for w in self.pattern.findall(first)]) + b"".join([after[p] for p in rest])

    def encode(self, text: str) -> bytes:
        """Ids as packed 32-bit integers; an added token's string is one id."""
        if self.special is None or not self.special.search(text):
            return self._plain(text)
        return b"".join(
            np.int32(self.added[part]).tobytes() if k % 2 else self._plain(part) if part else b""
            for k, part in enumerate(self.special.split(text))
        )


class Emitter:
    """The labels of the automaton's arcs: bytes by id, in one run with a place for each id."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        emitted = {i: bytes(alphabet[c] for c in s) for s, i in spec["model"]["vocab"].items()}
        emitted |= {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        labels = [emitted.get(i, b"") for i in range(max(emitted) + 1)]
        self.run = np.frombuffer(b"".join(labels), np.uint8)
        self.length = np.array([len(x) for x in labels], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def decode(self, ids: np.ndarray) -> str:
        """The labels one after the other; what is no UTF-8 becomes the replacement mark."""
        length = self.length[ids]
        ends = np.cumsum(length)
        at = np.arange(ends[-1] if len(ids) else 0) + np.repeat(self.start[ids] - (ends - length), length)
        return self.run[at].tobytes().decode("utf-8", "replace")


_LOADED: dict[tuple[type, str], Tokenizer | Emitter] = {}


def loaded(kind: type, vocabulary: str):
    """The worker's ``kind`` for a path, or for the name of a file of the public tokenizers package."""
    key = (kind, vocabulary)
    if key not in _LOADED:
        path = vocabulary
        if not os.path.isabs(vocabulary):
            import public_tokenizers

            path = public_tokenizers.path(vocabulary)
        _LOADED[key] = kind(path)
    return _LOADED[key]


def encode(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids``: one row per input row, no shuffle.

    Null or empty text gives an empty list. Repeated rows stay. Other columns
    are ignored; an empty table gives an empty result.
    """
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = loaded(Tokenizer, vocabulary)
        for batch in batches:
            packed = [tok.encode(t) for t in batch.column(1).to_pylist()]
            ends = list(itertools.accumulate((len(p) // 4 for p in packed), initial=0))
            ids = pa.array(np.frombuffer(b"".join(packed), dtype=np.int32))
            lists = pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), ids)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, ids, decoded`` of rows ``doc_id, ids``; null ids decode to the empty text."""
    out = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emitter = loaded(Emitter, vocabulary)
        for batch in batches:
            lists = batch.column(1)
            ids, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
            texts = [emitter.decode(ids[a:b]) for a, b in itertools.pairwise(ends)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1).cast(pa.list_(pa.int32())), pa.array(texts, pa.string())], schema=out
            )

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def coded(docs: DataFrame, vocabulary: str = VOCABULARY, with_ids: bool = True) -> DataFrame:
    """Encode and decode each text in one go: ``doc_id[, ids], n_tokens, ids_sha256, decoded_sha256``.

    The digests are lowercase hex: of the decimal ids joined by commas, and of
    what the ids decode to. One row per input row; null and empty texts have no
    tokens, repeated rows stay, other columns are ignored. One worker a task
    holds the vocabulary, and ids leave it only where they are asked for.
    """
    fields = [("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    types = {"doc_id": "long", "ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}
    out = pa.schema([f for f in fields if with_ids or f[0] != "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok, emitter = loaded(Tokenizer, vocabulary), loaded(Emitter, vocabulary)
        for batch in batches:
            packs, sizes, named, decoded = [], [0], [], []
            for text in batch.column(1):
                pack = tok.encode(text.as_py())
                ids = np.frombuffer(pack, np.int32)
                sizes.append(len(ids))
                named.append(sha256(",".join(map(str, ids.tolist())).encode()).hexdigest())
                decoded.append(sha256(emitter.decode(ids).encode()).hexdigest())
                if with_ids:
                    packs.append(pack)
            columns = {"doc_id": batch.column(0), "n_tokens": pa.array(sizes[1:], pa.int64()), "ids_sha256": pa.array(named, pa.string()), "decoded_sha256": pa.array(decoded, pa.string())}
            if with_ids:
                ends = pa.array(np.cumsum(sizes), pa.int32())
                columns["ids"] = pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(packs), np.int32)))
            yield pa.RecordBatch.from_arrays([columns[f.name] for f in out], schema=out)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return rows.mapInArrow(run, ", ".join(f"{f.name} {types[f.name]}" for f in out))


def digests(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every row of ``docs``."""
    return coded(docs, vocabulary, with_ids=False)
