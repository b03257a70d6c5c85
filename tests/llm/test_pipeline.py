"""Stages of the corpus pipeline against plain versions on their own inputs."""

from __future__ import annotations

import random
import re
from hashlib import sha256

import pytest

import corpus_pipeline
from echogrid.llm import bpe
from tests.llm import corpus


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    folder = tmp_path_factory.mktemp("tables")
    given = corpus.rows(12, 120)
    labels = []
    out = []
    for d, text, lang, source, n in given:
        toxic = d % 9 == 0 and text is not None and len(text) > 60
        if toxic:
            w = text.split()
            at = rng.randrange(len(w))
            w[at:at] = ["grumkor", "vexxol", "grumkor"]
            text = " ".join(w)
        out.append((d, text, lang, source, n))
        labels.append((d, 1, int(toxic)))
    spark.createDataFrame(out, corpus.DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_stages(spark, tables):
    docs = spark.read.parquet(f"{tables}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        result = stage(spark, docs, tables)
        kept.append(len(before))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert result.columns == docs.columns
        result = result.cache()
        after = result.collect()
        if name == "toxicity":
            bad = {d for d, r in before.items() if "grumkor" in (r.text or "")}
            assert {r.doc_id for r in after} == set(before) - bad
        if name == "exact dedup":
            norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
            first = {}
            for d in sorted(before):
                first.setdefault(norm(before[d].text), d)
            assert sorted(r.doc_id for r in after) == sorted(first.values())
        if name == "n-gram Jaccard join":
            sets = corpus.shingle_sets([(d, r.text) for d, r in before.items()], 5)
            comps = corpus.brute_components(sets, 80, 100)
            assert sorted(r.doc_id for r in after) == sorted(d for d in comps if comps[d] == d)
        if name == "BPE encoding and decoding":
            assert sorted(r.decoded_sha256 for r in after) == sorted(sha256((r.text or "").encode()).hexdigest() for r in docs.collect())
            emitter = bpe.loaded(bpe.Emitter, bpe.VOCABULARY)
            import numpy as np

            texts = sorted(emitter.decode(np.array(r.ids, np.int32)) for r in after)
            assert texts == sorted(r.text for r in docs.collect())
        docs = result


def test_run_gives_the_rows_of_the_last_stage(spark, tables):
    out = corpus_pipeline.run(spark, tables)
    assert out.columns == ["doc_id", "ids", "n_tokens", "decoded_sha256"] and out.count() > 0
