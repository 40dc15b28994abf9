"""Merkle manifest of a dataset: leaves, subroots, root and proofs by lag and lead windows.

Nodes of a tree stand in order and ``FAN`` neighbours at a time form a run, whose hash is a node of the next level; the last
run may be shorter, even a single node. A window per run gives every node its neighbours at the fixed offsets 1 to FAN - 1
before and after it; the slot in the run and the run's length tell which of them count. Their texts before and behind the
node are its siblings, and the row in slot 0, which sees all others ahead, hashes the parent. Levels go on until a tree has
one node. Proofs go down again: a node's path is its own siblings and its parent's path.

Each source has a tree of its own, and their roots form one more. Places in the order come from one sort by ranges and the
numbers of rows before each range, so neither a large source nor a run of equal rows meets in one task; no window holds
more than FAN rows. Leaves, places and parents are written to the shared folder; the driver sees the number of levels and
the root.

Rows with a null source are a tree of their own, the first one. Nulls in any column are hashed as such. Null ids come
first in their source; rows of equal id stand in the order of their leaves, so equal rows are neighbours and any order of
them gives the same hashes. Empty and very long texts are hashed like any other. Columns that aren't hashed don't matter,
whatever their names. A source of one row has its leaf as root; an empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import written

FAN = 16
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TREE = ["known", "name"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """The leaf of a row with this text."""
    return digest(*(field(text if c == "text" else F.col(c)) for c in FIELDS))


def placed(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows with their place ``pos`` in their tree, nulls first in ``order``, and the tree's number of rows ``n``."""
    by = [F.col(c).asc_nulls_first() for c in (*TREE, *order)]
    at = F.monotonically_increasing_id()
    sorted_rows = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", at), "merkle-order")
    # The upper bits of ``at`` are the range, the lower ones the place in it.
    ranged = sorted_rows.withColumn("range", F.shiftright("at", 33))
    parts = ranged.groupBy(*TREE, "range").agg(F.min("at").alias("low"), F.count(F.lit(1)).alias("rows"))
    tree = W.partitionBy(*TREE)
    before = F.coalesce(F.sum("rows").over(tree.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*TREE, "range", (before - F.col("low")).alias("shift"), F.sum("rows").over(tree).alias("n"))
    return ranged.join(starts, [*TREE, "range"]).withColumn("pos", F.col("at") + F.col("shift")).drop("range", "at", "shift")


def siblings(nodes: DataFrame, fan: int = FAN) -> DataFrame:
    """Nodes with their run, and the texts of the run's others before (``left``) and behind (``right``) them."""
    w = W.partitionBy(*TREE, "run").orderBy("pos")
    slot, length = F.col("pos") % fan, F.least(F.lit(fan), F.col("n") - F.col("run") * fan)
    before = [F.when(slot >= k, F.lag("node", k).over(w)).otherwise(F.lit("")) for k in range(fan - 1, 0, -1)]
    behind = [F.when(slot + k < length, F.lead("node", k).over(w)).otherwise(F.lit("")) for k in range(1, fan)]
    return nodes.withColumn("run", F.expr(f"pos div {fan}")).withColumns({"left": F.concat(*before), "right": F.concat(*behind)})


def levels_of(nodes: DataFrame, fan: int = FAN) -> list[DataFrame]:
    """The nodes (tree, pos, n, node) of each level; trees of one node have no further level."""
    most, levels = nodes.agg(F.max("n")).first()[0] or 0, [nodes.select(*TREE, "pos", "n", "node")]
    while most > 1:
        first = siblings(levels[-1].where("n > 1"), fan).where(F.col("pos") % fan == 0)
        parents = first.select(*TREE, F.col("run").alias("pos"), F.expr(f"(n + {fan - 1}) div {fan}").alias("n"), digest(F.col("node"), F.col("right")).alias("node"))
        levels.append(written(parents, "merkle-level"))
        most = -(-most // fan)
    return levels


def roots_of(levels: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, (nodes.where("n = 1").select(*TREE, "node") for nodes in levels))


def with_paths(nodes: DataFrame, levels: list[DataFrame], tops: DataFrame, fan: int = FAN) -> DataFrame:
    """Rows of the lowest level with ``path``: siblings (left, right) from there to the root; ``tops`` (tree, path, more) is what follows there."""
    more = [c for c in tops.columns if c not in (*TREE, "path")]
    path = levels[-1].where("n = 1").join(tops, TREE).select(*TREE, "pos", "path", *more)
    for depth in range(len(levels) - 2, -1, -1):
        here = levels[depth] if depth else nodes
        own = [c for c in here.columns if c not in (*TREE, "n")] if not depth else ["pos"]
        up = path.withColumnRenamed("pos", "run").withColumnRenamed("path", "_above")
        below = siblings(here.where("n > 1"), fan).join(up, [*TREE, "run"])
        both = F.concat(F.array(F.struct("left", "right")), "_above")
        lone = here.where("n = 1").join(tops, TREE)
        path = below.select(*TREE, *own, both.alias("path"), *more).unionByName(lone.select(*TREE, *own, "path", *more))
        path = written(path, "merkle-paths") if depth else path
    return path if len(levels) > 1 else nodes.where("n = 1").join(tops, TREE)


def folded(start: Column, path: Column) -> Column:
    return F.aggregate(path, start, lambda node, p: digest(p["left"], node, p["right"]))


def manifest(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root (of the tampered leaf where the id's checksum says so) and verified of every row."""
    text = F.col("text")
    tampered = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    leaves = docs.select(
        F.col("source").isNotNull().alias("known"),
        F.coalesce("source", F.lit("")).alias("name"),
        "doc_id",
        leaf(text).alias("node"),
        F.when(tampered, leaf(F.translate(text, UPPER, LOWER))).alias("changed"),
        F.monotonically_increasing_id().alias("spread"),  # lets equal rows lie in several ranges
    )
    nodes = written(placed(written(leaves, "merkle-leaves"), ["doc_id", "node", "spread"]).drop("spread"), "merkle-places")
    levels = levels_of(nodes, fan)
    subroots = roots_of(levels).select(F.lit(True).alias("known"), F.lit("").alias("name"), F.col("known").alias("of_known"), F.col("name").alias("of_name"), "node")
    sources = written(placed(subroots, ["of_known", "of_name"]), "merkle-sources")
    above = levels_of(sources, fan)
    root = above[-1].where("n = 1").first()
    if root is None:
        none = F.lit(None).cast("string")
        return docs.select("doc_id", *(none.alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")), F.lit(None).cast("boolean").alias("verified")).limit(0)
    top = sources.select(*TREE).distinct().withColumn("path", F.array().cast("array<struct<left:string,right:string>>"))
    tops = with_paths(sources, above, top, fan).select(F.col("of_known").alias("known"), F.col("of_name").alias("name"), "path", F.col("node").alias("subroot"))
    whole = with_paths(nodes, levels, tops, fan)
    proof = F.sha2(F.array_join(F.transform("path", lambda p: F.concat(p["left"], p["right"])), ""), 256)
    out = whole.select("doc_id", F.col("node").alias("leaf"), "subroot", F.lit(root["node"]).alias("root"), proof.alias("proof_sha256"), folded(F.coalesce("changed", "node"), F.col("path")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
