"""N-gram Jaccard join with size-banded tiles and hashed bitmap signatures.

Sets of equal content are one class from the start. A size band bounds by how
many elements two linked sets can differ. The hash range is cut into more parts
than that, so linked sets agree in at least one whole part: band, part and part
content name a tile, and every link lies in some tile. In a tile, bit counts of
hashed bitmaps bound the overlap of two sets from above; pairs that may reach
the threshold are settled by an exact intersection of sorted arrays.

Pairs inside a class of sets that are already connected are never formed: first
each set is held against the one that leads most of its tiles, then only tiles that still
join different components are searched, by the likeliest partners of each set,
until no set has an untried partner outside its component.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from echogrid.llm.common import components, mixed, shingle_hashes, shuffle_partitions, stored, text_or_empty

# Ratio of the sizes at the two ends of a band.
BAND = 1.6
# Parts beyond those that may differ; they make up for empty parts.
SPARE = 2
# Bits of a signature for each element, before rounding up to a power of two.
BITS = 2
# Members compared at once in a tile, and pairs settled by one task in a row.
TILE = 2048
SALT = 1024
# Partners of other components that a set names in a tile at first: the likeliest one, so a tile of many components
# names no more pairs than it has sets; most of them are connected then. Times as many in each further round.
PARTNERS = 1
MORE = 16
# Pairs of a tile that are held against each other at once.
CELLS = 1 << 16
# Tiles with one leader that make it worth a test before components are known.
OFTEN = 2


@dataclass(frozen=True)
class Rule:
    """Shingle length and the least similarity ``num / den``."""

    words: int = 4
    num: int = 85
    den: int = 100

    def linked(self, overlap: int, a: int, b: int) -> bool:
        return self.den * overlap >= self.num * (a + b - overlap)

    def differ(self, total: int) -> int:
        """Most elements in which two linked sets of ``total`` elements together can differ."""
        return total * (self.den - self.num) // (self.den + self.num)


DEFAULT = Rule()


@cache
def band_starts(most: int) -> np.ndarray:
    """First sizes of the bands, up to the band that ``most`` falls in and the one after it."""
    starts = [1]
    while len(starts) < 3 or starts[-2] <= most:
        starts.append(max(starts[-1] + 2, int(starts[-1] * BAND)))
    return np.array(starts)


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


def shingle_set(text: str, words: int = DEFAULT.words) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles; fewer words than a shingle are one shingle."""
    s = np.sort(shingle_hashes(text, words))
    new = np.ones(len(s), bool)
    new[1:] = s[1:] != s[:-1]
    return s[new]


@cache
def _bounds(parts: int) -> np.ndarray:
    return (np.arange(1, parts) * (2.0**64 / parts)).astype(np.uint64)


def set_id(s: np.ndarray) -> int:
    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes()))))


def tile_keys(s: np.ndarray, rule: Rule = DEFAULT) -> np.ndarray:
    """Keys of the tiles a set lies in: those of its band, and of the next band if it reaches a partner there.

    Keys have 48 bits; sets that meet by chance are told apart later.
    """
    n = len(s)
    starts = band_starts(n)
    band = int(np.searchsorted(starts, n, side="right")) - 1
    out = []
    content = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mixed(s + _ODD[0]))])
    for b in (band, band + 1):
        if b > band and n * rule.den < rule.num * int(starts[b]):
            break
        may_differ = rule.differ(2 * (int(starts[b + 1]) - 1))
        if may_differ == 0:
            continue  # linked sets of this band are equal
        parts = may_differ + 1 + SPARE
        cut = np.concatenate([[0], np.searchsorted(s, _bounds(parts)), [n]])
        sums = content[cut[1:]] - content[cut[:-1]]
        keys = mixed(sums * _ODD[1] + np.arange(parts, dtype=np.uint64) * _ODD[2] + np.full(1, b, np.uint64) * _ODD[3])
        filled = cut[1:] > cut[:-1]
        # At least 1 + SPARE parts agree. With so few empty ones, a filled part agrees.
        out.append(keys[filled] if parts - filled.sum() <= SPARE else keys)
    return (np.concatenate(out) >> np.uint64(16)).view(np.int64) if out else np.zeros(0, np.int64)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Elements that two sorted sets share."""
    if not len(a):
        return 0
    return int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))


def signature(s: np.ndarray) -> np.ndarray:
    """Bitmap of the hashed elements as 64-bit words; its size is a power of two."""
    bits = max(64, 1 << int(BITS * max(len(s), 1) - 1).bit_length())
    at = np.unique(mixed(s + _ODD[2]) & np.uint64(bits - 1))
    out = np.zeros(bits // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def folded(sig: np.ndarray, words: int) -> np.ndarray:
    while len(sig) > words:
        half = len(sig) // 2
        sig = sig[:half] | sig[half:]
    return sig


def overlap_bound(a: np.ndarray, n_a: int | np.ndarray, many: np.ndarray, n_many: np.ndarray) -> np.ndarray:
    """Most elements that the set behind signature ``a`` can share with those behind ``many``: differing bits differ in the sets."""
    differ = np.bitwise_count(many ^ a).sum(axis=1, dtype=np.int64)
    return np.minimum((n_many + n_a - differ) // 2, np.minimum(n_many, n_a))


def may_link(a: np.ndarray, n_a: int, many: np.ndarray, n_many: np.ndarray, rule: Rule = DEFAULT) -> np.ndarray:
    """Which of ``many`` signatures can still link with ``a``."""
    most = overlap_bound(a, n_a, many, n_many)
    return rule.den * most >= rule.num * (n_many + n_a - most)


def _classes(docs: DataFrame, rule: Rule) -> DataFrame:
    """``doc_id, n, sid`` of each row: size and id of its shingle set."""
    out = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, rule.words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_id(s) for s in sets], pa.int64())],
                schema=out,
            )

    return docs.mapInArrow(run, "doc_id long, n long, sid long")


def _tiles(docs: DataFrame, rule: Rule) -> DataFrame:
    """``key, sid, lead`` of every tile with at least two different sets; ``lead`` is the smallest of them."""
    out = pa.schema([("key", pa.int64()), ("sid", pa.int64())])
    led = out.append(pa.field("lead", pa.int64()))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            keys, sids = [], []
            for t in batch.column(1).to_pylist():
                s = shingle_set(t, rule.words)
                sid = set_id(s)
                if len(s) and sid not in seen:
                    seen.add(sid)
                    keys.append(tile_keys(s, rule))
                    sids.append(np.full(len(keys[-1]), sid, np.int64))
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), pa.array(np.concatenate(sids))], schema=out)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Sorted by (key, sid). The last row is held over: the first of a tile goes out with its second.
        held: tuple[int, int, int, bool] | None = None
        for batch in batches:
            key, sid = (batch.column(i).to_numpy() for i in (0, 1))
            if not len(key):
                continue
            if held is not None:
                key, sid = np.concatenate([[held[0]], key]), np.concatenate([[held[1]], sid])
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (sid[1:] != sid[:-1])
            key, sid = key[new], sid[new]
            start = np.ones(len(key), bool)
            start[1:] = key[1:] != key[:-1]
            lead = sid[np.flatnonzero(start)][np.cumsum(start) - 1]
            if held is not None:
                lead[key == held[0]] = held[2]
            keep = np.zeros(len(key), bool)
            keep[1:] |= ~start[1:]
            keep[:-1] |= ~start[1:]
            gone = held is not None and held[3]
            last_out = bool(keep[-1]) or (len(key) == 1 and gone)
            if gone:
                keep[0] = False
            held = (int(key[-1]), int(sid[-1]), int(lead[-1]), last_out)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(sid[keep]), pa.array(lead[keep])], schema=led)

    n = shuffle_partitions(docs.sparkSession)
    keyed = docs.mapInArrow(emit, "key long, sid long")
    return keyed.repartition(n, "key").sortWithinPartitions("key", "sid").mapInArrow(shared, "key long, sid long, lead long")


def _texts(docs: DataFrame, reps: DataFrame, wanted: DataFrame, rule: Rule) -> DataFrame:
    """``sid, n, sig, text`` of the wanted sets, from the document that stands for each; texts travel compressed."""
    small = pa.schema([("doc_id", pa.int64()), ("text", pa.binary())])
    out = pa.schema([("sid", pa.int64()), ("n", pa.int64()), ("sig", pa.binary()), ("text", pa.binary())])

    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            data = pa.array([press.compress(t.encode()) for t in batch.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), data], schema=small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            sets = [shingle_set(expand.decompress(t).decode(), rule.words) for t in batch.column(1).to_pylist()]
            ids = [set_id(s) for s in sets]
            ok = pa.array([i == sid for i, sid in zip(ids, batch.column(0).to_pylist(), strict=True)])
            rows = pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s).tobytes() for s in sets], pa.binary()),
                    batch.column(1),
                ],
                schema=out,
            )
            yield rows.filter(ok)  # other rows under the same doc_id

    chosen = reps.join(wanted, "sid").select("sid", F.col("rep").alias("doc_id"))
    packed = docs.mapInArrow(squeeze, "doc_id long, text binary")
    rows = packed.alias("d").join(chosen.alias("c"), F.col("d.doc_id").eqNullSafe(F.col("c.doc_id"))).select("c.sid", "d.text")
    return rows.mapInArrow(run, "sid long, n long, sig binary, text binary")


def _verified(pairs: DataFrame, texts: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs(a, b)`` that link, by exact intersection.

    Pairs of one ``a`` lie together, its own text first. A frequent ``a`` is
    dealt over several salts, its text sent to each.
    """
    sizes = stored(pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / SALT).cast("long").alias("salts")), "salts")
    salted = (
        pairs.join(sizes, "a")
        .select("a", "b", F.pmod(F.xxhash64("b"), F.col("salts")).alias("salt"))
    )
    members = salted.select("a", "salt", F.col("b").alias("sid"), F.lit(1).alias("role")).union(
        sizes.select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("a").alias("sid"), F.lit(0).alias("role"))
    )
    n = shuffle_partitions(pairs.sparkSession)
    rows = (
        members.join(texts, "sid")
        .repartition(n, "a", "salt")
        .sortWithinPartitions("a", "salt", "role")
        .select("a", "sid", "role", "text")
    )
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.zeros(0, np.uint64)
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            found_a, found_b = [], []
            for a, sid, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = shingle_set(expand.decompress(text).decode(), rule.words)
                if role == 0:
                    own = s
                elif rule.linked(common(own, s), len(own), len(s)):
                    found_a.append(a)
                    found_b.append(sid)
            yield pa.RecordBatch.from_arrays([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], schema=out)

    return rows.mapInArrow(run, "a long, b long")


def open_tiles(tiles: DataFrame, labels: DataFrame) -> DataFrame:
    """``key, sid, comp, blocks`` of the tiles that hold different components, one of those with equal members."""
    labelled = tiles.select("key", "sid").join(labels.withColumnRenamed("node", "sid"), "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    # Near copies agree in many parts, so most tiles have the members of another; one of those is enough.
    mixed_tiles = (
        labelled.groupBy("key")
        .agg(
            F.min("comp").alias("low"),
            F.max("comp").alias("high"),
            F.count(F.lit(1)).alias("members"),
            F.bit_xor(F.xxhash64("sid")).alias("one"),
            F.bit_xor(F.xxhash64("sid", F.lit(1))).alias("two"),
        )
        .filter("low <> high")
        .groupBy("members", "one", "two")
        .agg(F.min("key").alias("key"))
        .select("key", F.ceil(F.col("members") / TILE).cast("long").alias("blocks"))
    )
    return labelled.join(stored(mixed_tiles, "mixed"), "key")


def matrix(sigs: list[bytes]) -> np.ndarray:
    """Signatures as rows of one width, the least of theirs."""
    words = min(len(x) for x in sigs) // 8
    if all(len(x) == 8 * words for x in sigs):
        return np.frombuffer(b"".join(sigs), np.uint64).reshape(-1, words)
    return np.stack([folded(np.frombuffer(x, np.uint64), words) for x in sigs])


def _ranks(*groups: np.ndarray) -> np.ndarray:
    """Place of each entry among those that agree in all of ``groups``, in the order given."""
    order = np.lexsort(groups[::-1])
    new = np.ones(len(order), bool)
    new[1:] = np.logical_or.reduce([g[order][1:] != g[order][:-1] for g in groups])
    starts = np.flatnonzero(new)
    out = np.empty(len(order), np.int64)
    out[order] = np.arange(len(order)) - starts[np.cumsum(new) - 1]
    return out


def likely_partners(
    sig: np.ndarray, sid: np.ndarray, comp: np.ndarray, size: np.ndarray, block: np.ndarray | None, each: int, per: int, rule: Rule = DEFAULT
) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a tile that may link: of each set the ``each`` likeliest partners of other components, ``per`` of a component.

    A set that has more is told by a pair with itself. With ``block``, only sets
    of different blocks are held against each other.
    """
    order = np.lexsort((sid, size))
    sig, sid, comp, size = sig[order], sid[order], comp[order], size[order]
    block = None if block is None else block[order]
    # Sets that link are of like size; of the rest, half as wide signatures say most.
    least = np.searchsorted(size * rule.den, size * rule.num)
    most = np.searchsorted(size * rule.num, size * rule.den, "right")
    words = np.ascontiguousarray((sig if sig.shape[1] == 1 else sig[:, : sig.shape[1] // 2] | sig[:, sig.shape[1] // 2 :]).T)
    slack = ((rule.den - rule.num) * size).astype(np.int32)
    step = max(1, CELLS // len(sid))
    found_a, found_b = [], []
    for first in range(0, len(sid), step):
        rows = slice(first, min(first + step, len(sid)))
        others = slice(int(least[rows.start]), int(most[rows.stop - 1]))
        differ = np.zeros((rows.stop - rows.start, others.stop - others.start), np.int32)
        for w in words:
            differ += np.bitwise_count(w[rows, None] ^ w[others])
        differ *= rule.den + rule.num
        k, j = np.nonzero(differ <= slack[rows, None] + slack[others])
        k, j = k + rows.start, j + others.start
        apart = comp[k] != comp[j]
        if block is not None:
            apart &= block[k] != block[j]
        k, j = k[apart], j[apart]
        if not len(k):
            continue
        bound = overlap_bound(sig[k], size[k], sig[j], size[j])
        union = size[k] + size[j] - bound
        ok = rule.den * bound >= rule.num * union
        k, j, like = k[ok], j[ok], bound[ok] / union[ok]
        order = np.lexsort((sid[j], -like, k))
        k, j = k[order], j[order]
        named = (_ranks(k) < each) & (_ranks(k, comp[j]) < per)
        more = sid[np.unique(k[~named])]
        x, y = sid[k[named]], sid[j[named]]
        found_a += [np.minimum(x, y), more]
        found_b += [np.maximum(x, y), more]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *found_a]), np.concatenate([none, *found_b])


def _cross_pairs(opened: DataFrame, texts: DataFrame, rule: Rule, each: int, per: int) -> DataFrame:
    """Pairs ``a, b`` of one tile in different components whose signatures may link.

    Each set names the ``each`` likeliest partners of a tile, ``per`` of one
    component; a set that has more is told by a row with ``a = b``.
    """
    # A large tile is cut into blocks, and each two blocks meet in a tile of their own.
    dealt = (
        opened.withColumn("block", F.pmod(F.xxhash64("sid"), F.col("blocks")))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "sid", "comp")
    )
    n = shuffle_partitions(opened.sparkSession)
    rows = (
        dealt.join(texts.select("sid", "n", "sig"), "sid")
        .repartition(n, "key", "i", "j")
        .sortWithinPartitions("key", "i", "j")
        .select("key", "i", "j", "block", "sid", "comp", "n", "sig")
    )
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def search(numbers: np.ndarray, sigs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        _, i, j, block, sid, comp, size = numbers
        return likely_partners(matrix(sigs), sid, comp, size, block if i[0] != j[0] else None, each, per, rule)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros((7, 0), np.int64)]
        sigs: list[bytes] = []
        for batch in batches:
            numbers = np.stack([batch.column(c).to_numpy() for c in range(7)])
            own = batch.column(7).to_pylist()
            if not len(own):
                continue
            # Tiles of one batch at a time; the last one may go on in the next batch.
            starts = np.flatnonzero((numbers[:3, 1:] != numbers[:3, :-1]).any(axis=0)) + 1
            last = held[-1][:3, -1:]
            if last.size and (last != numbers[:3, :1]).any():
                starts = np.concatenate([[0], starts])
            found = []
            begin = 0
            for end in starts.tolist():
                held.append(numbers[:, begin:end])
                sigs += own[begin:end]
                found.append(search(np.concatenate(held, axis=1), sigs))
                held, sigs, begin = [np.zeros((7, 0), np.int64)], [], end
            held.append(numbers[:, begin:])
            sigs += own[begin:]
            if found:
                # Near copies meet in many tiles: of one batch each pair goes on once.
                pairs = np.unique(np.stack([np.concatenate(x) for x in zip(*found, strict=True)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], schema=out)
        if sigs:
            a, b = search(np.concatenate(held, axis=1), sigs)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=out)

    return rows.mapInArrow(run, "a long, b long").distinct()


def join_components(docs: DataFrame, rule: Rule = DEFAULT) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id``.

    ``component_id`` is the smallest doc_id that links reach. Null text counts
    as empty; a text without words has the empty set and is linked with nothing,
    so it is its own component. Repeated rows are copies of each other. A null
    doc_id never stands for others. Other columns are ignored; an empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    classes = stored(_classes(rows, rule), "classes")
    reps = stored(classes.filter("n > 0").groupBy("sid").agg(F.min("doc_id").alias("rep")), "reps")
    tiles = stored(_tiles(rows, rule), "tiles")
    # The leader of most of a set's tiles is its likeliest partner; that of a single tile often shares a common line only.
    led = tiles.groupBy("sid", "lead").agg(F.count(F.lit(1)).alias("times"))
    other = F.when((F.col("lead") != F.col("sid")) & (F.col("times") >= OFTEN), F.struct("times", (-F.col("lead")).alias("low"), "lead"))
    first = stored(led.groupBy("sid").agg(F.max(other).getField("lead").alias("lead")), "first")
    texts = stored(_texts(rows, reps, first.select("sid"), rule), "texts")
    near = first.filter("lead is not null").select(F.col("lead").alias("a"), F.col("sid").alias("b"))
    links = stored(_verified(near, texts, rule), "links")
    tested, each, per = near, PARTNERS, 1
    while True:
        opened = stored(open_tiles(tiles, components(links)), "open")
        found = stored(_cross_pairs(opened, texts, rule, each, per), "found")
        fresh = stored(found.filter("a <> b").join(tested, ["a", "b"], "left_anti"), "fresh")
        links = stored(links.union(_verified(fresh, texts, rule)), "links")
        more = stored(found.filter("a = b").select(F.col("a").alias("sid")), "more")
        if more.isEmpty():
            break
        # These sets have more partners in other components than they named. A set that named all of its partners has
        # no pair left, so only these are searched again.
        tiles = stored(opened.join(more, "sid", "left_semi").select("key", "sid"), "tiles")
        tested, each = stored(tested.union(fresh), "tested"), MORE * each
        per = each
    labels = components(links).withColumnRenamed("node", "sid")
    settled = reps.join(labels, "sid", "left").withColumn("comp", F.coalesce("comp", "sid"))
    settled = stored(settled, "settled")
    least = stored(settled.groupBy("comp").agg(F.min("rep").alias("component_id")), "least")
    of_set = stored(settled.join(least, "comp").select("sid", "component_id"), "of-set")
    return (
        classes.join(of_set, "sid", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
        )
    )
