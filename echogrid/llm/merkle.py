"""Merkle dataset manifest: hash trees over the rows of a table, by lag and lead windows.

Each row is a leaf. Per source the leaves, in order of doc_id, are cut into runs
of 16; a run's digests hash into its parent, level by level, until one node is
left. These roots of the sources are the leaves of one more tree.

Nothing but digests moves between tasks. Places come from range-sorted
partitions and their prefix counts, so no window holds a source: the windows of
a level hold one run each. There the 15 lag and 15 lead columns, masked by a
node's slot and its run's length, are its siblings; first children hash their
parent. On the way down each node's path to the root meets its children's
window by (tree, run), so only one path per run is sent.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from echogrid.llm.common import shuffle_partitions, stored
from echogrid.runtime import materialize

FANOUT = 16
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PATH = "array<struct<left:string,right:string>>"
# The tree above all sources; keys of sources start with "-" or "=".
_TOP = ""


def field(value: Column) -> Column:
    """One input of a leaf: ``-`` if null, else byte count, colon, value."""
    shown = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(shown).cast("string"), F.lit(":"), shown), F.lit("-"))


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def leaf(text: Column, columns: tuple[str, ...] = COLUMNS) -> Column:
    return digest(*(field(text if c == "text" else F.col(c)) for c in columns))


def tampered(doc_id: Column, text: Column) -> Column:
    """The text with A-Z lower-cased where 5 divides the crc32 of the id; null elsewhere."""
    hit = F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(text, UPPER, LOWER))


def tree_key(source: Column) -> Column:
    """Name of a source's tree: null first, then as the bytes are ordered."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("-"))


def placed(nodes: DataFrame, order: list[Column]) -> DataFrame:
    """Add ``pos``, the place of a row in its ``tree``, and ``n``, the tree's number of rows.

    Rows are sorted in ranges over all trees. A range tells how many rows of
    each tree it has; sums of these over the ranges before give the places.
    """
    spark = nodes.sparkSession
    ids = (
        nodes.repartitionByRange(shuffle_partitions(spark), "tree", *order)
        .sortWithinPartitions("tree", *order)
        .withColumn("at", F.monotonically_increasing_id())
    )
    ids = stored(ids.withColumn("piece", F.shiftright("at", 33)), "merkle-places")
    pieces = ids.groupBy("tree", "piece").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("rows"))
    before = Window.partitionBy("tree").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = materialize(
        pieces.select(
            "tree",
            "piece",
            (F.coalesce(F.sum("rows").over(before), F.lit(0)) - F.col("first")).alias("shift"),
            F.sum("rows").over(Window.partitionBy("tree")).alias("n"),
        )
    )
    return ids.join(starts, ["tree", "piece"]).withColumn("pos", F.col("at") + F.col("shift")).drop("at", "piece", "shift")


def with_siblings(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Add ``run, slot, left, right``: the digests before and after a node in its run, joined to one text each."""
    run = F.floor(F.col("pos") / fanout)
    nodes = level.withColumn("run", run).withColumn("slot", (F.col("pos") % fanout).cast("int"))
    length = F.least(F.lit(fanout).cast("long"), F.col("n") - F.col("run") * fanout)
    w = Window.partitionBy("tree", "run").orderBy("pos")
    none = F.lit("")
    left = [F.when(F.col("slot") >= k, F.lag("digest", k).over(w)) for k in range(fanout - 1, 0, -1)]
    right = [F.when(F.col("slot") + k < length, F.lead("digest", k).over(w)) for k in range(1, fanout)]
    return nodes.withColumn("left", F.concat(*(F.coalesce(x, none) for x in left))).withColumn(
        "right", F.concat(*(F.coalesce(x, none) for x in right))
    )


def levels(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """All levels of all trees over ``leaves(tree, pos, n, digest)``, from the leaves to the roots.

    A tree of one node keeps it on all further levels.
    """
    out = [leaves]
    most = leaves.agg(F.max("n")).first()[0] or 0
    while most > 1:
        first = with_siblings(out[-1], fanout).filter("slot = 0")
        up = first.select(
            "tree",
            F.col("run").alias("pos"),
            F.ceil(F.col("n") / fanout).alias("n"),
            F.when(F.col("n") > 1, digest(F.col("digest"), F.col("right"))).otherwise(F.col("digest")).alias("digest"),
        )
        out.append(materialize(up))
        most = -(-most // fanout)
    return out


def down(level: DataFrame, above: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Paths of a level's nodes: own siblings, then the path of the parent in ``above(tree, pos, path, subroot, root)``."""
    parents = above.select("tree", F.col("pos").alias("run"), F.col("path").alias("rest"), "subroot", "root")
    own = F.array(F.struct("left", "right"))
    path = F.when(F.col("n") > 1, F.concat(own, F.col("rest"))).otherwise(F.col("rest")).cast(_PATH)
    return with_siblings(level, fanout).join(parents, ["tree", "run"]).withColumn("path", path)


def fold(start: Column, path: Column) -> Column:
    """Root that a leaf and its siblings give."""
    return F.aggregate(path, start, lambda node, step: F.sha2(F.concat(step["left"], node, step["right"]), 256))


@dataclass(frozen=True)
class Manifest:
    """``tops(tree, subroot, root, path)`` for each source, ``levels`` of the sources' trees."""

    tops: DataFrame
    levels: list[DataFrame]
    fanout: int

    def leaves(self) -> DataFrame:
        """All leaves with ``subroot, root`` and ``path``, the siblings up to the root."""
        above = self.tops.withColumn("pos", F.lit(0).cast("long"))
        for level in reversed(self.levels):
            found = down(level, above, self.fanout)
            above = found.select("tree", "pos", "path", "subroot", "root")
        return found


def manifest(leaves: DataFrame, order: list[Column], fanout: int = FANOUT) -> Manifest:
    """Trees over ``leaves(tree, digest, ...)``; further columns stay at the leaves."""
    sources = levels(placed(leaves, order), fanout)
    roots = sources[-1].select("tree", F.col("digest").alias("subroot"))
    named = placed(
        roots.select(F.lit(_TOP).alias("tree"), F.col("tree").alias("source_tree"), F.col("subroot").alias("digest")),
        [F.col("source_tree")],
    )
    top = levels(named, fanout)
    # A root is its own parent one level up; the empty path and the two names go down from there.
    above = top[-1].select(
        "tree", "pos", F.array().cast(_PATH).alias("path"), F.lit("").alias("subroot"), F.col("digest").alias("root")
    )
    for level in reversed(top):
        found = down(level, above, fanout)
        above = found.select("tree", "pos", "path", "subroot", "root")
    tops = found.select(F.col("source_tree").alias("tree"), F.col("digest").alias("subroot"), "root", "path")
    return Manifest(materialize(tops), sources, fanout)


def verify(docs: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Digests, proof and check of every row against tampering.

    One row per input row: ``doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified``. The leaf covers doc_id, source, lang, n_chars and
    text, each null apart from the empty text; other columns are ignored. A null
    source is a source of its own, before all others. Rows of one source and
    doc_id follow in order of their leaves, a null doc_id comes first and is never
    tampered with; repeated rows are leaves of their own. A single row's leaf is
    its subroot and root, its proof the hash of nothing. An empty table gives an
    empty result.
    """
    text = F.col("text")
    changed = tampered(F.col("doc_id"), text)
    rows = docs.select(
        tree_key(F.col("source")).alias("tree"),
        "doc_id",
        leaf(text).alias("digest"),
        # Kept only where the text really changes.
        F.when(changed != text, leaf(changed)).alias("changed"),
    )
    # The digests are kept, so that sorting reads no text.
    rows = stored(rows, "merkle-leaves")
    found = manifest(rows, [F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("changed").asc_nulls_first()], fanout)
    every = found.leaves().withColumn("folded_root", fold(F.coalesce("changed", "digest"), F.col("path")))
    siblings = F.array_join(F.transform("path", lambda step: F.concat(step["left"], step["right"])), "")
    return every.select(
        "doc_id",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        F.sha2(siblings, 256).alias("proof_sha256"),
        "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )
