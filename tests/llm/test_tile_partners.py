"""Links of crowded tiles: few are sent on, none that matters is lost."""

from __future__ import annotations

from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from echogrid.llm import common, jaccard_join
from tests.llm import corpus


def test_components_read_fewer_links_than_a_clique_has(spark):
    clique = [(100 * g + a, 100 * g + b) for g in range(3) for a, b in combinations(range(40), 2)]
    edges = spark.createDataFrame([*clique, (7, 7), (999, 999)], "a long, b long").coalesce(1)
    kept = common.thinned(edges)
    assert kept.count() <= 3 * 40 + 1
    found = {(r.node, r.comp) for r in common.components(edges).collect()}
    assert found == {(100 * g + i, 100 * g) for g in range(3) for i in range(40)} | {(999, 999)}


def test_thinning_keeps_what_is_connected(spark):
    path = spark.range(0, 300).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert {r.comp for r in common.components(path).collect()} == {0}
    a, b = common._connected(np.arange(0, 300)[::-1].copy(), np.arange(1, 301)[::-1].copy())
    assert set(a.tolist()) == {0} and sorted(b.tolist()) == list(range(1, 301))


def test_a_set_names_one_of_each_component_and_says_if_there_are_more():
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 63, 200, dtype=np.uint64))
    sets = [np.delete(base, k) for k in range(6)]
    sig = jaccard_join.matrix([jaccard_join.signature(s).tobytes() for s in sets])
    sid, size = np.arange(6) + 10, np.array([len(s) for s in sets])
    comp = np.array([0, 0, 0, 0, 1, 2])
    every = {(10 + a, 10 + b) for a, b in combinations(range(6), 2) if comp[a] != comp[b]}
    pairs = set(zip(*(x.tolist() for x in jaccard_join.likely_partners(sig, sid, comp, size, None, 16, 16)), strict=True))
    assert pairs == every
    pairs = set(zip(*(x.tolist() for x in jaccard_join.likely_partners(sig, sid, comp, size, None, 16, 1)), strict=True))
    # The four of the first component have one partner in each other; 14 and 15 have four in the first.
    assert {a for a, b in pairs if a == b} == {14, 15}
    assert pairs - {(14, 14), (15, 15)} == every
    alone = jaccard_join.likely_partners(sig, sid, comp, size, np.array([0, 0, 0, 0, 0, 1]), 16, 16)
    assert set(zip(*(x.tolist() for x in alone), strict=True)) == {(10 + k, 15) for k in range(5)}


def test_words_hash_alike_in_short_and_long_texts(monkeypatch):
    text = "  One two,three\tfour é\n" * 40 + "five"
    short = common.word_hashes(text)
    monkeypatch.setattr(common, "SHORT", 8)
    assert len(short) == 161 and (short == common.word_hashes(text)).all()


def test_common_lines_do_not_lead_near_copies_astray(spark, monkeypatch):
    # Every text has the common line; near copies come in groups of three.
    rng = np.random.default_rng(8)
    rows = []
    for g in range(30):
        words = [f"w{x}" for x in rng.integers(0, 10_000, 160)]
        for c in range(3):
            own = [*words]
            own[10 + 20 * c] = f"x{g}{c}"
            rows.append((3 * g + c, "a common line that all of the texts begin with " + " ".join(own)))
    tried = []
    verified = jaccard_join._verified

    def counted(pairs, texts, rule):
        tried.append(pairs.count())
        return verified(pairs, texts, rule)

    monkeypatch.setattr(jaccard_join, "_verified", counted)
    found = jaccard_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == corpus.brute_components(corpus.shingle_sets(rows, 4), 85, 100)
    assert {r.component_id for r in found} == set(range(0, 90, 3))
    assert sum(tried) <= 2 * 90
