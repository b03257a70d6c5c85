"""Each operator against a plain version, and its edge cases."""

from __future__ import annotations

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from echogrid.llm import (
    bpe,
    compact_windows,
    exact_dedup,
    fingerprints,
    html_text,
    importance,
    interpolation,
    jaccard_join,
    merkle,
    mixing,
    suffix_dedup,
    token_counts,
    toxicity,
)
from tests.llm import corpus

LABELS = "doc_id long, quality int, toxic int"


def toxic_score(docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    return toxicity.score(docs, toxicity.fit(docs, labels))


OPERATORS = {
    "passages": compact_windows.repeated_passages,
    "suffix": suffix_dedup.remove_repeats,
    "bpe": bpe.digests,
    "jaccard": jaccard_join.join_components,
    "tokens": token_counts.count_tokens,
    "mix": mixing.mix,
    "mixed": mixing.mixed_documents,
    "exact": exact_dedup.exact_dedup,
    "toxic": toxic_score,
    "fingerprints": fingerprints.edited_fingerprints,
    "merkle": merkle.verify,
    "importance": lambda docs: importance.resample(docs, docs.limit(2)),
    "lm": interpolation.score,
}
ROW_FOR_ROW = set(OPERATORS) - {"passages", "mixed"}


@pytest.fixture(scope="module")
def rows():
    return corpus.rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, corpus.DOCS).repartition(4).cache()


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], corpus.DOCS)).count() == 0


@pytest.mark.parametrize("name", OPERATORS)
def test_nulls_repeats_and_clashing_columns(spark, name):
    long_text = " ".join(f"w{i}" for i in range(60_000))
    given = [
        (None, None, None, None, None),
        (None, "no id here", "en", "s0", 10),
        (1, "twice the same row", "en", "s0", 18),
        (1, "twice the same row", "en", "s0", 18),
        (1, "same id, other text", "en", None, 19),
        (2, None, "en", None, None),
        (3, "", None, "s1", 0),
        (4, long_text, "en", "s1", len(long_text)),
        (-(1 << 62), "far away id", "en", "s2", 11),
    ]
    frame = spark.createDataFrame(given, corpus.DOCS)
    for c in corpus.CLASH:
        frame = frame.withColumn(c, F.lit("x"))
    found = OPERATORS[name](frame).collect()
    if name in ROW_FOR_ROW:
        assert Counter(r.doc_id for r in found) == Counter(r[0] for r in given)
    if name == "exact":
        assert sum(r.kept for r in found if r.doc_id == 1) == 2
        same = [r for r in found if r.doc_id == 1 and r.group_size == 2]
        assert len(same) == 2 and sorted(r.kept for r in same) == [False, True]
    if name == "suffix":
        assert {r.n_bytes for r in found if r.doc_id == 4} == {len(long_text)}


def test_passages_are_real_and_shared_passages_found(docs, rows):
    found = compact_windows.repeated_passages(docs).collect()
    words = {r[0]: [w.lower() for w in corpus.split_words(r[1])] for r in rows}
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    for r in found:
        a = grams(words[r.doc_id][r.start_word : r.start_word + r.n_words])
        b = grams(words[r.of_doc_id][r.of_start_word : r.of_start_word + r.of_n_words])
        assert r.n_words >= 50 and len(a & b) >= 0.8 * len(a | b) and r.of_doc_id < r.doc_id
    runs = defaultdict(set)
    for d, w in words.items():
        for i in range(len(w) - 49):
            runs[tuple(w[i : i + 50])].add(d)
    wanted = set().union(*(s for s in runs.values() if len(s) > 1))
    told = {r.doc_id for r in found} | {r.of_doc_id for r in found}
    assert wanted <= told


def edited(rng, size, kind, edits):
    """A passage and a near copy with words changed, left out or put in, evenly spread."""
    w = corpus.words(rng, size)
    out = list(w)
    for k in range(edits, 0, -1):
        at = size * k // (edits + 1)
        out[at : at + (kind != "in")] = [] if kind == "out" else corpus.words(rng, 1)
    return w, out


@pytest.mark.parametrize("kind", ["changed", "out", "in"])
def test_passages_grow_over_edits(kind):
    rng = random.Random(8)
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    tried = 0
    for size in range(50, 151):
        for edits in (1, 2, 3):
            ours, theirs = edited(rng, size, kind, edits)
            if len(theirs) < 50 or 10 * len(grams(ours) & grams(theirs)) < 8 * len(grams(ours) | grams(theirs)):
                continue
            tried += 1
            a = corpus.words(rng, 90) + ours + corpus.words(rng, 40)
            b = corpus.words(rng, 20) + theirs + corpus.words(rng, 130)
            s, t = (compact_windows.shingles(" ".join(w)) for w in (a, b))
            found = compact_windows.passages(s, t, (0, len(s) - 1, 0, len(t) - 1))
            covered = set()
            for start, n, start_b, n_b, like in found:
                x, y = grams(a[start : start + n]), grams(b[start_b : start_b + n_b])
                assert min(n, n_b) >= 50 and like == len(x & y) / len(x | y) >= 0.8
                covered |= set(range(start, start + n))
            # A short edge beside an edit may lie outside; all else of the passage is told.
            assert len(covered & set(range(90, 90 + size))) >= size - 3
    assert tried > 150


def test_a_changed_word_does_not_hide_a_passage(spark):
    rng = random.Random(4)
    given = []
    for size, edits in ((69, 1), (128, 2)):
        for w in edited(rng, size, "changed", edits):
            given.append((len(given), " ".join(corpus.words(rng, 60) + w + corpus.words(rng, 60)), "en", "s", 0))
    found = compact_windows.repeated_passages(spark.createDataFrame(given, corpus.DOCS)).collect()
    assert {(r.doc_id, r.of_doc_id) for r in found} == {(1, 0), (3, 2)}


@pytest.mark.parametrize("others", [3, 60])
def test_windows_meet_past_the_first_of_a_key(spark, others):
    """Texts 10 and 20 share one context far from the min-hash only, and neither is the first nor the one before."""
    blocks = 2 * len(compact_windows.CONTEXTS)
    rows = []
    for k, mark in enumerate([1, 10, 15, 20, *range(30, 27 + others)]):
        around = [100 * k + c for c in range(blocks)]
        if mark in (10, 20):
            around[-1] = mark if others < 10 else 0xFFFF
        place = compact_windows.packed(np.array([[0, 50, 100]]), np.array([around]))[0].as_py()
        rows.append((7, mark, place))
    found = compact_windows._meetings(spark.createDataFrame(rows, compact_windows._WINDOW)).select("a", "b").collect()
    assert (10, 20) in {(r.a, r.b) for r in found}
    if others > 10:
        assert len(found) <= (blocks + 2) * len(rows)


def test_compact_windows_cover_every_passage_once():
    values = np.random.default_rng(1).integers(0, 50, 80).astype(np.uint64)
    windows = compact_windows.compact_windows(values, 10)
    for i in range(80):
        for j in range(i + 9, 80):
            holds = [c for low, c, high in windows if low <= i <= c <= j <= high]
            assert len(holds) == 1 and values[holds[0]] == values[i : j + 1].min()


@pytest.mark.parametrize("kinds", [5, 50, 10**9])
def test_compact_windows_of_many_texts_equal_a_plain_search(kinds):
    rng = np.random.default_rng(kinds)
    for size, least in [(0, 7), (6, 7), (90, 2), (90, 7), (200, 20)]:
        values, border = rng.integers(0, kinds, size).astype(np.uint64), rng.random(size) < 0.03
        plain = set()
        for c in np.flatnonzero(~border):
            low = high = int(c)
            while low > 0 and not border[low - 1] and values[low - 1] > values[c]:
                low -= 1
            while high + 1 < size and not border[high + 1] and values[high + 1] >= values[c]:
                high += 1
            if high - low + 1 >= least:
                plain.add((low, int(c), high))
        found = [tuple(w) for w in compact_windows.compact_windows(values, least, border).tolist()]
        assert len(found) == len(plain) and set(found) == plain


def test_windows_of_a_text_do_not_depend_on_its_neighbours(spark):
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=n)) for n in (60, 300, 51, 49, 400)] + ["same words again " * 60]
    rows = [(k, text) for k, text in enumerate(texts)]
    made = lambda some: compact_windows._windows(spark.createDataFrame(some, "mark long, text string").coalesce(1)).collect()
    apart = [r for row in rows for r in made([row])]
    assert sorted(made(rows)) == sorted(apart) and {r.mark for r in apart} == {0, 1, 2, 4, 5}


def test_long_places_are_packed_whole():
    for windows in ([[0, 5, 60]], [[65_000, 65_535, 65_536], [1, 2, 3]], [[70_000, 3_000_000, 4_000_000_000]]):
        data = compact_windows.packed(np.array(windows), np.arange(6 * len(windows)).reshape(-1, 6)).to_pylist()
        assert [list(compact_windows.unpacked(x))[:3] for x in data] == windows
        assert [x for p in data for x in compact_windows.unpacked(p)[3:]] == list(range(6 * len(windows)))


def test_suffix_dedup_is_byte_exact(docs, rows):
    seen, wanted = set(), {}
    for d, text, *_ in sorted(rows, key=lambda r: r[0]):
        data = (text or "").encode()
        gone = bytearray(len(data))
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                gone[i : i + 100] = b"\x01" * 100
            seen.add(data[i : i + 100])
        kept = bytes(c for c, g in zip(data, gone, strict=True) if not g)
        spans = len(re.findall(b"\x01+", bytes(gone)))
        wanted[d] = (len(data), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    found = suffix_dedup.remove_repeats(docs).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == wanted
    assert any(v[1] for v in wanted.values())


def test_suffix_family_over_many_levels():
    rng = random.Random(5)
    base = "".join(rng.choice("ab") for _ in range(4000)).encode()
    texts = [base[rng.randint(0, 3000) :][: rng.randint(150, 700)] for _ in range(30)]
    family = suffix_dedup.Family()
    for k, t in enumerate(texts):
        first, last, anchor, _ = suffix_dedup.anchors(t)
        family.add([(t[a : j + 100], t[i:a], (k, 0, i)) for i, j, a in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True)])
    seen: set[bytes] = set()
    for k, t in enumerate(texts):
        gone = [(i, i + 100) for i in range(len(t) - 99) if t[i : i + 100] in seen or seen.add(t[i : i + 100])]
        assert suffix_dedup.merged(family.spans.get((k, 0), [])) == suffix_dedup.merged(gone)
    assert [size for size, _ in family.levels] == [16, 8, 4, 2]


PAGES = {
    "<html><body><nav><a href=/a>menu</a></nav><article><h1>Title &amp; more</h1><p>One  two\n three.<p>Short.</article>"
    "<footer>&copy; me</footer></body></html>": "Title & more\nOne two three.\nShort.",
    "<div class='cookie-notice'>We use cookies</div><div id=content><h1>Head</h1><p>A long paragraph of running text, "
    "with <b>bold</b> words.</p><div class=ad>Buy!</div><p>Another long paragraph of running text in the same place.</p>"
    "<form><label>Mail</label></form></div><aside>More</aside><section class=comments><p>I do not agree with any of it at "
    "all, dear author.</p></section>": "Head\nA long paragraph of running text, with bold words.\nAnother long paragraph of "
    "running text in the same place.",
    "": "",
    "<p>only": "only",
    "<script>var a='<p>no</p>'</script><style>p{}</style>": "",
}


def test_html_text_of_small_pages(spark):
    given = [(i, f"u{i}", h, "x") for i, h in enumerate(PAGES)] + [(None, None, None, "x")]
    found = html_text.extract(spark.createDataFrame(given, "page_id long, url string, html string, text string")).collect()
    assert {r.page_id: r.text for r in found} == {i: t for i, t in enumerate(PAGES.values())} | {None: ""}
    assert all(r.n_chars == len(r.text) for r in found)
    assert html_text.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def paragraphs(word, n=4):
    return "".join(f"<p>{f'A long sentence of a {word} number {k} with words. ' * 6}</p>" for k in range(n))


@pytest.mark.parametrize("tag", ["article", "div", "section"])
def test_html_names_that_only_hold_a_mark_say_nothing(tag):
    names = ["post tag-search", "entry category-social", "notice-board", "ad-hoc", "post-related", "story-share", "login-howto", "comment-policy", "related-work"]
    for name in names:
        page = f"<html><body><nav>Menu</nav><{tag} class='{name}'>{paragraphs('paragraph')}</{tag}><footer>f</footer></body></html>"
        assert len(html_text.main_text(page).split("\n")) == 4


def test_html_marked_parts_go_however_long():
    for name in ["comments", "comment-list", "site-footer", "sidebar", "ad-banner", "cookie-notice", "related", "ads", "newsletter-signup", "share-bar"]:
        page = f"<body><article>{paragraphs('paragraph')}</article><div class='{name}'>{paragraphs('remark', 12)}</div></body>"
        found = html_text.main_text(page)
        assert "remark" not in found and len(found.split("\n")) == 4
    # A page whose only text lies in a marked part keeps it.
    assert len(html_text.main_text(f"<body><nav>Menu</nav><div class='widget'>{paragraphs('paragraph')}</div></body>").split("\n")) == 4


def test_html_of_deep_and_long_pages():
    import time

    start = time.perf_counter()
    deep = html_text.main_text("<body>" + "<div>x</span>" * 5000 + paragraphs("paragraph") + "</b>" * 5000)
    assert time.perf_counter() - start < 5 and deep.count("paragraph") == 24
    assert html_text.main_text("<div>" * 3000) == "" and html_text.main_text("<p>a") == "a"
    many = html_text.main_text("<article>" + paragraphs("paragraph", 5000) + "</article>")
    assert len(many.split("\n")) == 5000


def test_html_text_of_generated_articles():
    rng = random.Random(2)
    for _ in range(40):
        blocks = [" ".join(corpus.words(rng, rng.randint(1, 60))) + rng.choice(["", " & <x>", " é"]) for _ in range(rng.randint(1, 9))]
        inner = "".join(f"<p>{html.escape(b)}</p>" if k % 3 else f"<p><b>{html.escape(b)}<br>" for k, b in enumerate(blocks))
        page = f"<html><head><title>t</title></head><body><nav><ul><li><a>x</a></ul></nav><div class=ad>{blocks[0]}</div><article>{inner}</article><footer>f</footer></body></html>"
        assert html_text.main_text(page) == "\n".join(" ".join(b.split()) for b in blocks)


def test_clusters_decide_beside_a_teaser_article():
    rng = random.Random(6)
    body = [" ".join(corpus.words(rng, 80)) for _ in range(5)]
    text = "".join(f"<p>{b}</p>" for b in body)
    teaser = "<article class=card><a href=/x>Read</a> <b>more</b> of it</article>"
    for page in (f"<div><h1>Head</h1>{text}</div>{teaser}", f"{teaser}<div><h1>Head</h1>{text}</div>"):
        found = html_text.main_text(f"<html><body><nav>menu</nav>{page}<footer>f</footer></body></html>").split("\n")
        assert [x for x in found if x in ("Head", *body)] == ["Head", *body]
    # An article that holds the clusters is the region; its short lines stay, those outside don't.
    page = f"<div><a>Top</a></div><div><a>News</a></div><div><a>Team</a></div><article><h1>Head</h1>{text}<p>End.</article>"
    assert html_text.main_text(page).split("\n")[-7:] == ["Head", *body, "End."]
    assert "Top" not in html_text.main_text(page)


def test_lead_and_body_in_sibling_blocks():
    rng = random.Random(7)
    lead, body = " ".join(corpus.words(rng, 70)), [" ".join(corpus.words(rng, 80)) for _ in range(5)]
    text = "".join(f"<p>{b}</p>" for b in body)
    page = f"<body><div class=top><h1>Head</h1><p>{lead}</p></div><div class=text>{text}</div><div class=ad>Buy!</div></body>"
    assert html_text.main_text(page).split("\n") == ["Head", lead, *body]


def test_bpe_equals_the_tokenizers_library(docs, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    library = pytest.importorskip("tokenizers").Tokenizer.from_file(public_tokenizers.path(bpe.VOCABULARY))
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab '\n\t.,1é²日 \x1cs") for _ in range(rng.randint(0, 30))) for _ in range(3000)]
    odd += ["<|endoftext|>", "a<|endoftext|> b", "it's I'LL they'd", "a   b ", "foo\n bar", "*" * 50, "  "]
    tok = bpe.loaded(bpe.Tokenizer, bpe.VOCABULARY)
    emitter = bpe.loaded(bpe.Emitter, bpe.VOCABULARY)
    for t in odd:
        ids = np.frombuffer(tok.encode(t), np.int32)
        assert ids.tolist() == library.encode(t, add_special_tokens=False).ids
        assert emitter.decode(ids) == library.decode(ids.tolist(), skip_special_tokens=False)
    found = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for d, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert found[d].n_tokens == len(ids)
        assert found[d].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert found[d].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()


def test_automaton_has_one_path_for_each_string():
    # A tiny vocabulary: merges in order, every string's paths counted by hand.
    merges = [(b"a", b"b"), (b"b", b"a"), (b"ab", b"a"), (b"a", b"a"), (b"aa", b"b")]
    spelled = [b"a", b"b", *(x + y for x, y in merges)]
    tokens = {s: i for i, s in enumerate(spelled)}
    automaton = bpe.MergeAutomaton(tokens, merges)
    for k in range(1, 9):
        for n in range(2**k):
            word = bytes(b"ab"[n >> i & 1] for i in range(k))
            parts = [bytes([c]) for c in word]
            for x, y in merges:
                i = 0
                while i + 1 < len(parts):
                    if (parts[i], parts[i + 1]) == (x, y):
                        parts[i : i + 2] = [x + y]
                    i += 1
            assert automaton.encode(word) == [tokens[p] for p in parts]


def test_jaccard_in_blocks_of_large_tiles(spark, monkeypatch):
    """Near copies of one text, alike to it but not all to each other, with tiles of a few sets each."""
    rng = random.Random(9)
    base = corpus.words(rng, 150)
    given = [(0, " ".join(base))]
    for i in range(1, 40):
        w = list(base)
        for k in rng.sample(range(150), rng.randint(1, 4)):
            w[k] = corpus.words(rng, 1)[0]
        given.append((i, " ".join(w)))
    monkeypatch.setattr(jaccard_join, "TILE", 3)
    monkeypatch.setattr(jaccard_join, "PARTNERS", 2)
    found = jaccard_join.join_components(spark.createDataFrame(given, "doc_id long, text string")).collect()
    assert {r.doc_id: r.component_id for r in found} == corpus.brute_components(corpus.shingle_sets(given, 4), 85, 100)


@pytest.mark.parametrize("rule", [jaccard_join.Rule(), jaccard_join.Rule(5, 80, 100)])
def test_jaccard_components_equal_all_pairs(docs, rows, rule):
    sets = corpus.shingle_sets(rows, rule.words)
    wanted = corpus.brute_components(sets, rule.num, rule.den)
    found = jaccard_join.join_components(docs, rule).collect()
    assert {r.doc_id: r.component_id for r in found} == wanted
    assert all(r.n_shingles == len(sets[r.doc_id]) for r in found)
    assert len(set(wanted.values())) < len(wanted) - 5


def test_every_linked_pair_shares_a_tile():
    rng = np.random.default_rng(4)
    rule = jaccard_join.Rule()
    for n in (7, 13, 20, 40, 90, 300, 1000):
        for _ in range(60):
            a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
            drop = rng.integers(0, max(1, n // 8) + 1)
            new = rng.integers(0, 1 << 63, rng.integers(0, max(1, n // 8) + 1)).astype(np.uint64)
            b = np.unique(np.concatenate([rng.permutation(a)[drop:], new]))
            if rule.linked(len(np.intersect1d(a, b)), len(a), len(b)) and len(np.setxor1d(a, b)):
                assert np.intersect1d(jaccard_join.tile_keys(a), jaccard_join.tile_keys(b)).size
                sig = [jaccard_join.signature(x) for x in (a, b)]
                least = min(map(len, sig))
                one, other = (jaccard_join.folded(s, least) for s in sig)
                assert jaccard_join.may_link(one, len(a), other[None, :], np.array([len(b)]))[0]


def test_a_large_group_of_near_copies_is_one_component(spark):
    rng = random.Random(9)
    base = corpus.words(rng, 120)
    given = []
    for i in range(150):
        w = list(base)
        w[rng.randrange(120)] = f"x{i}"
        given.append((i, " ".join(w), "en", "s", 0))
    found = jaccard_join.join_components(spark.createDataFrame(given, corpus.DOCS).repartition(3)).collect()
    wanted = corpus.brute_components(corpus.shingle_sets(given, 4), 85, 100)
    assert {r.doc_id: r.component_id for r in found} == wanted


def test_token_counts_equal_a_plain_search(docs, rows):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    costs = token_counts.piece_costs(public_tokenizers.path(token_counts.VOCABULARY))

    def plain(word: bytes) -> int:
        best = [(0, 0)]
        for end in range(1, len(word) + 1):
            best.append(min((best[s][0] + costs[word[s:end]], best[s][1] + 1) for s in range(end) if word[s:end] in costs))
        return best[-1][1]

    found = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.count_tokens(docs).collect()}
    for d, text, *_ in rows:
        w = (text or "").encode().split()
        assert found[d] == (len(w), sum(plain(b" " + x) for x in w))


def plain_targets(sizes: dict, weights=(5, 2, 1)) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    total, full = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        share = sum(w[s] for s in order if s not in full)
        out = {s: 2.0 * sizes[s] if s in full else rest * w[s] / share for s in order}
        over = {s for s in order if s not in full and out[s] > 2 * sizes[s]}
        if not over:
            return out
        full |= over


def test_mix_meets_its_targets(docs, rows):
    found = mixing.mix(docs).collect()
    assert sorted(map(tuple, found)) == sorted(map(tuple, mixing.mix(docs.repartition(2)).collect()))
    source = {r[0]: r[3] for r in rows}
    sizes, taken = Counter(), Counter()
    for r in found:
        assert r["size"] == len(corpus.split_words(dict((x[0], x[1]) for x in rows)[r.doc_id]))
        assert 0 <= r.taken <= 2 * r["size"]
        sizes[source[r.doc_id]] += r["size"]
        taken[source[r.doc_id]] += r.taken
    wanted = plain_targets(sizes)
    for r in found:
        assert r.source_size == sizes[source[r.doc_id]]
        assert r.target == pytest.approx(wanted[source[r.doc_id]])
    assert all(abs(taken[s] - wanted[s]) <= 3 * mixing.BLOCK_WORDS for s in sizes)


def test_mixed_documents_hold_the_words_taken(docs, rows):
    taken = Counter()
    text = {r[0]: r[1] for r in rows}
    for r in mixing.mixed_documents(docs).collect():
        taken[r.doc_id] += len(corpus.split_words(r.text))
        assert set(corpus.split_words(r.text)) <= set(corpus.split_words(text[r.doc_id])) and r.n_chars == len(r.text)
    assert {r.doc_id: r.taken for r in mixing.mix(docs).collect() if r.taken} == dict(taken)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000])
def test_permuted_is_a_permutation(spark, n):
    got = spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(11)).alias("p")).collect()
    assert sorted(r.p for r in got) == list(range(n))


@pytest.mark.parametrize("block", [8, 4096])
def test_exact_dedup_equals_grouping(docs, rows, block):
    norm = {r[0]: re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows}
    groups = defaultdict(list)
    for d, t in norm.items():
        groups[t].append(d)
    for r in exact_dedup.exact_dedup(docs, block).collect():
        group = groups[norm[r.doc_id]]
        assert (r.keep_id, r.group_size, r.kept) == (min(group), len(group), r.doc_id == min(group))
        assert r.text_sha256 == hashlib.sha256(norm[r.doc_id].encode()).hexdigest()


def test_block_names_tell_equal_length_texts_apart(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choice("ab") for _ in range(24)) for _ in range(60)]
    texts += texts[:20]
    frame = spark.createDataFrame([(i, "h", t) for i, t in enumerate(texts)], "doc_id long, sha string, norm string")
    name = {r.doc_id: (r.n_bytes, r["name"]) for r in exact_dedup.block_names(frame, 4).collect()}
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (name[i] == name[j]) == (a == b)


def test_segments_equal_a_recursive_search():
    rng = random.Random(6)

    def plain(scores: list[float], base: int = 0) -> list[tuple]:
        best = max(((sum(scores[i:j]), -(j - i), -i, i, j) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1)), default=(0,))
        if best[0] <= 0:
            return []
        i, j = best[3], best[4]
        return plain(scores[:i], base) + [(base + i, base + j, best[0])] + plain(scores[j:], base + j)

    for _ in range(60):
        scores = [rng.choice([-5.0, -3.0, -2.0, 1.0, 4.0, 7.0]) + rng.random() for _ in range(14)]
        got = toxicity.segments(scores)
        assert [(s, e) for s, e, _ in got] == [(s, e) for s, e, _ in plain(scores)]
        assert [x for *_, x in got] == pytest.approx([x for *_, x in plain(scores)])


def test_toxicity_on_held_out_rows(spark):
    rng = random.Random(4)
    plain, bad = corpus.words(rng, 400), ["grumkor", "grumkas", "vexxol", "vexxit"]
    given, labels = [], []
    for i in range(600):
        toxic = i % 6 == 0
        w = [rng.choice(plain) for _ in range(rng.randint(20, 90))]
        if toxic:
            at = rng.randrange(len(w))
            w[at:at] = [rng.choice(bad), w[0], rng.choice(bad)]
        given.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, 1, int(toxic)))
    docs = spark.createDataFrame(given, corpus.DOCS).repartition(3)
    found = toxicity.score(docs, toxicity.fit(docs, spark.createDataFrame(labels, LABELS))).collect()
    truth = {i: t for i, _, t in labels}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    assert all(p.p_value <= toxicity.SIGNIFICANT for r in found for p in r.passages)


def test_labels_of_held_out_rows_change_nothing(spark, docs):
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 2).cast("int").alias("toxic"))
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.fit(docs, labels) == toxicity.fit(docs, turned)


def test_fingerprints_follow_the_next_document(docs, rows):
    order = sorted(rows, key=lambda r: -r[0])
    found = {r.doc_id: r for r in fingerprints.edited_fingerprints(docs).collect()}
    for k, (d, text, *_) in enumerate(order):
        text, following = text or "", order[(k + 1) % len(order)][1] or ""
        half = len(text) // 2
        changed = text[: len(text) - half] + following[:half]
        r = found[d]
        own, other = fingerprints.entries(text), fingerprints.entries(changed)
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(changed.encode()).hexdigest())
        assert fingerprints.read_fingerprint(r.fingerprint) == own
        assert fingerprints.read_fingerprint(r.edited_fingerprint) == other
        assert r.near_edited == pytest.approx(fingerprints.likeness(own, other))
        assert r.near_next == pytest.approx(fingerprints.likeness(own, fingerprints.entries(following)))


def test_chunks_join_to_the_text_and_survive_a_shift():
    rng = random.Random(7)
    data = " ".join(corpus.words(rng, 900)).encode()
    parts = fingerprints.chunks(data)
    assert b"".join(parts) == data
    c = fingerprints.DEFAULT
    assert all(c.least <= len(p) <= c.most for p in parts[:-1])
    shifted = fingerprints.chunks(b"some words before " + data)
    assert len(set(parts) & set(shifted)) >= 0.9 * len(parts)
