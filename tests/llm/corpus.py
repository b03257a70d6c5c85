"""Small corpora for the text operators, and plain versions of what they compute."""

from __future__ import annotations

import random
import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
# Columns whose names the operators use themselves.
CLASH = ("name", "size", "target", "mark", "id", "sid", "key", "row", "evidence", "passages", "start", "bucket", "norm")


def words(rng: random.Random, n: int) -> list[str]:
    return ["".join(rng.choice("aeiou" if k % 2 else "bdklmnrst") for k in range(rng.randint(2, 8))) for _ in range(n)]


def texts(seed: int = 3, n: int = 40) -> list[str | None]:
    """Random texts with exact and near copies, a shared passage, blanks, other alphabets and junk."""
    rng = random.Random(seed)
    out: list[str | None] = [" ".join(words(rng, rng.randint(5, 260))) for _ in range(n)]
    passage = words(rng, 70)
    for k in range(0, n, 5):
        w = out[k].split()
        at = rng.randint(0, len(w))
        out[k] = " ".join(w[:at] + passage + w[at:])
    for k in range(0, n, 4):
        w = out[k].split()
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [out[1], out[1].replace(" ", "\n\t "), out[2], out[2].upper(), None, "", " \n ", "one", "two words", "a a a a a a"]
    out += ["the same line again\n" * 80, "x" * 500, "naïve über 日本 🎉 " * 20, "  lead  and   trail  "]
    return out


def rows(seed: int = 3, n: int = 40) -> list[tuple]:
    found = texts(seed, n)
    return [
        (i * 3, t, "en", None if i % 11 == 5 else f"s{i % 3}", None if t is None else len(t))
        for i, t in enumerate(found)
    ]


def split_words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def shingle_sets(found: list[tuple], n: int) -> dict[int, frozenset]:
    out = {}
    for r in found:
        w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in split_words(r[1])]
        out[r[0]] = frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    return out


def brute_components(sets: dict[int, frozenset], num: int, den: int) -> dict[int, int]:
    parent = {d: d for d in sets}

    def find(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {d: find(d) for d in sets}
