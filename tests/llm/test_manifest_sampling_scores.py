"""Manifest, importance resampling and language-model scores against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.llm import importance, interpolation, merkle
from tests.llm import corpus


@pytest.fixture(scope="module")
def rows():
    return [(r[0], r[1] and r[1].title() if r[0] % 2 else r[1], *r[2:]) for r in corpus.rows(7, 60)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, corpus.DOCS).repartition(5).cache()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def plain_leaf(values):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def plain_tree(level, fanout):
    """Root, and for each leaf its siblings as (before, after) on each level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for i, p in enumerate(at):
            run = level[p - p % fanout : p - p % fanout + fanout]
            paths[i].append((run[: p % fanout], run[p % fanout + 1 :]))
            at[i] = p // fanout
        level = [sha("".join(level[i : i + fanout])) for i in range(0, len(level), fanout)]
    return level[0], paths


def plain_manifest(rows, fanout=16):
    sources = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        sources[source].append((doc_id, source, lang, n_chars, text))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        sources[s].sort(key=lambda r: r[0])
        trees[s] = plain_tree([plain_leaf(r) for r in sources[s]], fanout)
    root, tops = plain_tree([trees[s][0] for s in order], fanout)
    out = {}
    for s, top in zip(order, tops, strict=True):
        for r, path in zip(sources[s], trees[s][1], strict=True):
            changed = r
            if zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                changed = (*r[:4], lower(r[4]))
            node = plain_leaf(changed)
            for before, after in path + top:
                node = sha("".join([*before, node, *after]))
            proof = sha("".join(x for b, a in path + top for x in b + a))
            out[r[0]] = (plain_leaf(r), trees[s][0], root, proof, node, node == root)
    return out


@pytest.mark.parametrize("fanout", [5, 16])
def test_manifest_against_plain_trees(docs, rows, fanout):
    want = plain_manifest(rows, fanout)
    found = {r.doc_id: tuple(r)[1:] for r in merkle.verify(docs, fanout).collect()}
    assert found == want
    assert 0 < sum(not v[-1] for v in want.values()) < len(want)


@pytest.mark.parametrize("n", [1, 16, 257])
def test_manifest_of_one_source(spark, n):
    rows = [(i, f"Text {i}", None, "only", i) for i in range(n)]
    found = {r.doc_id: tuple(r)[1:] for r in merkle.verify(spark.createDataFrame(rows, corpus.DOCS)).collect()}
    assert found == plain_manifest(rows)
    if n == 1:
        assert found[0][0] == found[0][1] == found[0][2] and found[0][3] == sha("")


def test_manifest_knows_nulls_from_empty_texts(spark):
    rows = [(1, None, None, None, None), (2, "", "", "", 0), (3, "A", "en", "é", 1), (4, "-", "-", "z", 1)]
    found = {r.doc_id: tuple(r)[1:] for r in merkle.verify(spark.createDataFrame(rows, corpus.DOCS)).collect()}
    assert found == plain_manifest(rows)


def test_checksums_of_joined_texts():
    rng = random.Random(1)
    for _ in range(200):
        a = rng.randbytes(rng.randrange(9))
        b = rng.randbytes(rng.choice([0, 1, 3, 63, 64, 65, 1000, 70_000]))
        crc = [np.array([zlib.crc32(x)], np.uint32) for x in (a, b)]
        assert importance.joined_crc(*crc, np.array([len(b)]))[0] == zlib.crc32(a + b)


def plain_features(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in (1, 2, 3) for i in range(len(words) - k + 1)]


def plain_resample(rows, target):
    each = {r[0]: plain_features(r[1]) for r in rows}
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s = Counter(bucket(f) for _, found in each.values() for f in found)
    t = Counter(bucket(f) for text in target for f in plain_features(text)[1])
    total_s, total_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (total_s + 10_000) / ((s[b] + 1) * (total_t + 10_000)))) for b in s}
    out = {}
    for d, (_, found) in each.items():
        weight = sum(gain[bucket(f)] for f in found)
        h = int(sha(f"42:{d}")[:8], 16)
        out[d] = [len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
    able = sorted((-out[d][2], d) for d, (n, _) in each.items() if n >= 20)
    for rank, (_, d) in enumerate(able[: 5 * len(able) // 100], 1):
        out[d][3] = rank
    return out


def test_resampling_against_plain_version(spark, docs, rows):
    target = [rows[3][1], "Some Other 3 words", None, ""]
    found = importance.resample(docs, spark.createDataFrame([(t,) for t in target], "text string")).collect()
    assert {r.doc_id: list(r)[1:] for r in found} == plain_resample(rows, target)
    assert sum(r.rank is not None for r in found) == 5 * sum(len(re.findall("[a-z0-9\x80-\U0010ffff]+", lower(r[1] or ""))) >= 20 for r in rows) // 100


def test_ranks_of_many_ties_over_many_runs(spark, monkeypatch):
    rng = random.Random(4)
    given = [(rng.choice([3, 3, 3, rng.randrange(50)]), rng.randrange(400), i) for i in range(5000)]
    frame = spark.createDataFrame(given, "up long, id long, row long").repartition(7)
    for run_rows in (1 << 20, 300):
        monkeypatch.setattr(importance.sorted_runs, "__defaults__", (run_rows,))
        for drawn in (0, 1, 777, 5000, 9000):
            found = importance.ranked(frame, drawn).collect()
            want = {x: i for i, x in enumerate(sorted(given), 1) if i <= drawn}
            assert len(found) == 5000
            assert {(r.up, r.id, r.row): r.rank for r in found if r.rank is not None} == want


def plain_tokens(text):
    return [*(lower(w) for w in corpus.split_words(text)), "</s>"]


def plain_counts(texts):
    out = [Counter(), Counter(), Counter()]
    for w in texts:
        s = ["<1>", "<2>", *w]
        for i in range(len(s)):
            for k in range(min(3, i + 1)):
                out[k][tuple(s[i - k : i + 1])] += 1
    return out


def plain_estimates(counts, n, w):
    """For each token class of its context and estimates of orders 1 to 3."""
    s = ["<1>", "<2>", *w]
    for i in range(2, len(s)):
        shares, kind = [counts[0][(s[i],)] / max(n, 1)], 0
        for k in (1, 2):
            context = counts[k - 1][tuple(s[i - k : i])]
            shares.append(counts[k][tuple(s[i - k : i + 1])] / context if context else 0.0)
            if context:
                kind = 1 + (k - 1) * interpolation.CLASSES + min(int(math.log2(context)), interpolation.CLASSES - 1)
        yield kind, shares


def test_scores_against_plain_model(spark):
    rng = random.Random(5)
    words = corpus.words(rng, 60)
    made = []
    for i in range(300):
        at, text = rng.randrange(60), []
        for _ in range(rng.randint(0, 60)):
            text.append(words[at])
            at = (7 * at + rng.randrange(3)) % 60 if rng.random() < 0.9 else rng.randrange(60)
        made.append((i, " ".join(text), None, None, 0))
    made += [(1000, None, None, None, None), (1001, "Never SEEN before", None, None, 17)]
    found = {r.doc_id: r for r in interpolation.score(spark.createDataFrame(made, corpus.DOCS).repartition(4), chunk_tokens=500).collect()}
    fold = {r[0]: zlib.crc32(str(r[0]).encode()) % 7 for r in made}
    each = {r[0]: plain_tokens(r[1]) for r in made}
    train = plain_counts(w for d, w in each.items() if fold[d] != 2)
    core = plain_counts(w for d, w in each.items() if fold[d] not in (2, 5))
    sizes = lambda c: (sum(x for g, x in c[0].items() if g[0][0] != "<" or g[0] == "</s>"), len(c[0]) - 2)
    (n, types), (n_core, types_core) = sizes(train), sizes(core)
    seen = defaultdict(list)
    for d, w in each.items():
        if fold[d] == 5:
            for kind, shares in plain_estimates(core, n_core, w):
                seen[kind].append([1 / (types_core + 1), *shares])
    weight = {k: interpolation.maximised(np.array(x).T, np.ones(len(x))) for k, x in seen.items()}
    order = lambda k: (k + interpolation.CLASSES - 1) // interpolation.CLASSES

    def weights_of(kind):
        """Of the class itself, else of the next lower one of its order, else of the next higher."""
        same = [k for k in weight if order(k) == order(kind)]
        near = max((k for k in same if k <= kind), default=None)
        w = weight[min(same) if near is None else near] * (np.arange(4) <= order(kind) + 1)
        return (w + [1e-6 * (w[0] < 1e-6), 0, 0, 0]) / w.sum()

    for d, w in each.items():
        r = found[d]
        base = sum(math.log10((train[0][(x,)] + 1) / (n + 1 * (types + 1))) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold[d] == 2, len(w), sum((x,) in train[0] for x in w), n)
        assert r.base_score == pytest.approx(base)
        plain = sum(math.log10(np.dot(weights_of(k), [1 / (types + 1), *x])) for k, x in plain_estimates(train, n, w))
        # Weights are learnt on sums over cells of like estimates.
        assert r.score == pytest.approx(plain, rel=0.03)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_shares_add_up_to_one(spark):
    """Of one place, over all words, the end and one unknown word: texts of that place are told apart by their last token."""
    rng = random.Random(6)
    words = corpus.words(rng, 12)
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 8))) for _ in range(120)]
    test, train = ([i for i in range(2000) if (zlib.crc32(str(i).encode()) % 7 == 2) == is_test] for is_test in (True, False))
    given = list(zip(train, texts, strict=False))
    counts = plain_counts(plain_tokens(t) for _, t in given)
    n = sum(len(plain_tokens(t)) for _, t in given)
    known = sorted({w for _, t in given for w in plain_tokens(t)})
    found = []
    mixture = interpolation.mixture
    try:
        interpolation.mixture = lambda *a: found.append(mixture(*a)) or found[-1]
        interpolation.score(spark.createDataFrame(given + [(test[0], "x")], "doc_id long, text string")).collect()
    finally:
        interpolation.mixture = mixture
    for lead in ([], [words[0]], words[1:3], ["unknown", words[3]], ["unknown", "strange"]):
        total = 0.0
        for last in [*known, "never seen"]:
            kind, shares = list(plain_estimates(counts, n, [*lead, last]))[-1]
            total += float(np.dot(found[0][kind], [1 / (len(known) + 1), *shares]))
        assert total == pytest.approx(1)


def test_packed_numbers_come_back():
    rng = np.random.default_rng(2)
    for n in (0, 1, 1000):
        x = np.sort(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        assert (interpolation.unpacked(interpolation.packed(x)) == x).all()
        assert (interpolation.unpacked_sorted(interpolation.packed_sorted(x)) == x).all()


def test_weights_raise_the_likelihood_of_held_out_counts():
    rng = np.random.default_rng(3)
    shares, n = rng.random((4, 200)) * (rng.random((4, 200)) < 0.7) + 1e-9, rng.integers(1, 50, 200)
    weight = interpolation.maximised(shares, n, 500)
    like = lambda w: float((n * np.log(w @ shares)).sum())
    assert weight.sum() == pytest.approx(1)
    for _ in range(200):
        other = np.abs(weight + rng.normal(0, 0.05, 4))
        assert like(other / other.sum()) <= like(weight) + 1e-3


def test_repeated_rows_and_other_columns_of_the_manifest(spark):
    rows = [(5, "same", "en", "s", 4)] * 3 + [(6, "other", "en", "s", 5)]
    frame = spark.createDataFrame(rows, corpus.DOCS).withColumn("tree", F.lit("x")).withColumn("pos", F.lit(9))
    found = merkle.verify(frame).collect()
    assert len(found) == 4 and len({r.root for r in found}) == 1
    assert [r.leaf for r in found].count(plain_leaf((5, "s", "en", 4, "same"))) == 3
