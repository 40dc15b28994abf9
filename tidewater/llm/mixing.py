"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

Every document gets the whole copies that its source's target allows for sure (target over size, rounded down); the
rest of the target is a sample without replacement. A document's inclusion is in proportion to a power of its size
(``TILT``; 0 would be equal chances), scaled so that the words expected are those wanted; documents whose inclusion would
pass 1 are certain and set apart, found from the histogram of sizes. All others have as their Pareto rank the odds of a
seeded uniform number over the odds of their inclusion; within a source ranks are taken upwards until the remaining
words are reached, the last one if that comes nearer. The place of the cut is found from histograms of ranks, refined
until a cell holds few rows, so no source is ever sorted as a whole.

Targets: sources by code point, nulls last, weigh ``weights`` in turn and share ``share`` of all words; none exceeds
``most`` times its size, and what is above is shared again by weight. Null or wordless texts have size 0 and are
taken 0 words; a source without words has target 0. Rows equal in id and text are numbered, and each draws for itself.
Other columns pass through ``mixed_documents``, whatever their names, and are ignored by ``mixed_sizes``. Very long texts
are counted whole. An empty table gives no rows. Reruns agree, as every draw is a hash of id, text and number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import quoted, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
SEED = 77_003
#: Documents' chances go with this power of their size.
TILT = 0.5
#: Cells per histogram of ranks, and rows of a cell that one task sorts.
RANK_CELLS, CELL_ROWS = 4096, 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(key: Column, number: Column) -> Column:
    """A number inside (0, 1), the same for the same key and number."""
    bits = F.shiftrightunsigned(F.xxhash64(key, number), 12)
    return (bits.cast("double") + 0.5) / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: one row per source (a bounded table next to the documents).

    The level at which weights share what capped sources leave is that of the first source, by cap over weight, that
    stays below its cap.
    """
    summed = written(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    turn = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int"))
    weighed = summed.withColumn("weight", turn).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_room = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    earlier, everything = by_room.rowsBetween(W.unboundedPreceding, -1), W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ranked = (
        weighed.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0)))
        .withColumn("heft", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(earlier), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("heft"))
        .withColumn("place", F.row_number().over(by_room))
    )
    open_ = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))
    filled = ranked.withColumn("level", F.min(open_).over(everything)["level"])
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("weight")))
    return filled.select("source", "source_size", target.alias("target"))


def pareto_rank(u: Column, inclusion: Column) -> Column:
    """Random odds over inclusion odds, for an inclusion inside (0, 1); null for others."""
    return F.try_divide(u * (1 - inclusion), (1 - u) * inclusion)


def inclusions(narrow: DataFrame, targets: DataFrame, tilt: float = TILT) -> DataFrame:
    """targets with ``rate`` (inclusion is rate * size ** tilt where that is below 1) and ``drawn``, the words to draw beside certain documents.

    Sizes from some size up are certain: from the largest one that leaves all smaller ones an inclusion below 1.
    """
    counted = narrow.where("size > 0").groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    sizes = _with_source(counted, targets.where("rest > 0").select("source", "rest"))
    down = W.partitionBy("source").orderBy(F.desc("size"))
    larger, others = down.rowsBetween(W.unboundedPreceding, -1), down.rowsBetween(W.currentRow, W.unboundedFollowing)
    heft = F.pow(F.col("size").cast("double"), F.lit(tilt))
    left = F.col("rest") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(larger), F.lit(0))
    # The rate if this size and all smaller ones were drawn; the largest size that then stays below 1 opens the drawn ones.
    tried = sizes.withColumns({"_left": left, "_rate": left / F.sum(F.col("n") * F.col("size") * heft).over(others)})
    first = tried.where((F.col("_rate") * heft < 1) & (F.col("_left") >= 0)).groupBy("source").agg(F.max(F.struct("size", "_rate", "_left")).alias("_f"))
    found = first.select("source", F.greatest(F.col("_f._rate"), F.lit(1e-15)).alias("rate"), F.col("_f._left").alias("drawn"), F.col("_f.size").alias("upto"))
    return _with_source(targets, found, "left")


def _inclusion(tilt: float) -> Column:
    """A document's inclusion: null where nothing is drawn, 1 for certain ones."""
    drawn = F.col("rate") * F.pow(F.col("size").cast("double"), F.lit(tilt))
    return F.when((F.col("rest") > 0) & (F.col("size") > 0), F.when(F.col("size") <= F.col("upto"), drawn).otherwise(F.lit(1.0)))


def mixing_plan(narrow: DataFrame, tilt: float = TILT) -> DataFrame:
    """Per source: source_size, target, whole copies, rest, rate, upto, and the last rank that the sample takes.

    narrow: source, size and u of every document.
    """
    some = F.col("source_size") > 0
    whole = F.when(some, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    targets = source_targets(narrow).withColumn("whole", whole.cast("long"))
    targets = targets.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")))
    targets = written(targets.withColumn("rest", F.when(F.col("rest") > 1e-9 * F.col("source_size"), F.col("rest")).otherwise(F.lit(0.0))), "mix-targets")
    targets = written(inclusions(narrow, targets, tilt), "mix-rates")
    inclusion = _inclusion(tilt)
    ranked = _with_source(narrow, targets).where(inclusion < 1).withColumn("rank", pareto_rank(F.col("u"), inclusion))
    # Ranks go to (0, 1); each round cuts the cell in which a source's words are reached into finer ones.
    ranked = ranked.select("source", "size", "rank", (F.col("rank") / (1 + F.col("rank"))).alias("at"))
    edges = targets.where("drawn > 0").select("source", F.lit(0.0).alias("low"), F.lit(1.0).alias("high"), F.lit(0.0).alias("before"), "drawn")
    while True:
        inside = _with_source(ranked, edges).where("at >= low and at < high")
        cell = F.least(F.lit(RANK_CELLS - 1), F.floor((F.col("at") - F.col("low")) / (F.col("high") - F.col("low")) * RANK_CELLS))
        counted = inside.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"), *(F.first(c).alias(c) for c in ("low", "high", "before", "drawn")))
        upto = F.col("before") + F.sum("words").over(W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, 0))
        reached = counted.withColumn("_upto", upto).where((F.col("_upto") >= F.col("drawn")) & (F.col("_upto") - F.col("words") < F.col("drawn")))
        step = (F.col("high") - F.col("low")) / RANK_CELLS
        found = reached.select(
            "source",
            (F.col("low") + F.col("cell") * step).alias("low"),
            F.when(F.col("cell") == RANK_CELLS - 1, F.col("high")).otherwise(F.col("low") + (F.col("cell") + 1) * step).alias("high"),
            (F.col("_upto") - F.col("words")).alias("before"),
            "drawn",
            "rows",
        )
        edges = written(found, "mix-edges")
        most, width = edges.agg(F.max("rows"), F.max(F.col("high") - F.col("low"))).first()
        # Cells as narrow as numbers get hold equal ranks alone.
        if not most or most <= CELL_ROWS or width < 1e-15:
            break
    # Rounding may put a row next to its cell; a row too many is sorted with it, a row too few is of no weight.
    edge = _with_source(ranked, edges.drop("rows")).where("at >= low and at < high").groupBy("source", "rank").agg(F.sum("size").alias("size"), *(F.first(c).alias(c) for c in ("before", "drawn")))
    sofar = F.col("before") + F.sum("size").over(W.partitionBy("source").orderBy("rank"))
    ends = edge.select("source", "rank", F.abs(sofar - F.col("drawn")).alias("off"))
    starts = edge.groupBy("source").agg(F.first("before").alias("before"), F.first("drawn").alias("drawn"), F.min("rank").alias("least"))
    # Stopping short of the cell's first row may come nearest.
    short = starts.select("source", (F.col("least") * (1 - 1e-15)).alias("rank"), F.abs(F.col("before") - F.col("drawn")).alias("off"))
    last = ends.unionByName(short).groupBy("source").agg(F.min_by("rank", F.struct("off", "rank")).alias("last"))
    # Where the words drawn at all fall short of those wanted, all are taken.
    short_of = targets.where("drawn > 0").select("source", F.lit(float("inf")).alias("all"))
    plan = _with_source(_with_source(targets, last, "left"), short_of, "left")
    return written(plan.withColumn("last", F.coalesce("last", "all")).drop("all"), "mix-plan")


def _with_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Join by source, a null source matching itself."""
    other = right.withColumnRenamed("source", "_source")
    shared = [c for c in other.columns if c in left.columns]
    return left.join(other.drop(*shared), left["source"].eqNullSafe(F.col("_source")), how).drop("_source")


def copies(df: DataFrame, plan: DataFrame, tilt: float = TILT) -> DataFrame:
    """df (source, size, u) with source_size, target and the number of copies that the mix takes."""
    joined = _with_source(df, plan)
    inclusion = _inclusion(tilt)
    extra = F.when(inclusion < 1, (pareto_rank(F.col("u"), inclusion) <= F.col("last")).cast("int")).otherwise(F.when(inclusion.isNull(), F.lit(0)).otherwise(F.lit(1)))
    taken = F.when(F.col("size") > 0, F.col("whole") + F.coalesce(extra, F.lit(0))).otherwise(F.lit(0))
    return joined.withColumn("copies", taken.cast("long")).drop("whole", "rest", "rate", "drawn", "upto", "last")


def _measured(docs: DataFrame, seed: int) -> DataFrame:
    """docs with size, a key of id and text, and a row number that is the same in every reading of the same files."""
    key = F.xxhash64(F.lit(seed), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text")
    return docs.withColumns({"size": words(F.col("text")), "key": key, "_row": F.monotonically_increasing_id()})


def repeats(narrow: DataFrame) -> DataFrame:
    """_row and number (from 1) of every row but the first of its key; narrow: key, _row.

    Rows of a key are numbered within the parts that they lie in, and the parts are put behind each other, so the rows of
    a hot key are sorted apart.
    """
    several = narrow.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("key")
    rows = narrow.select("key", "_row", F.shiftright("_row", 33).alias("_part")).join(several, "key", "left_semi")
    rows = written(rows.withColumn("_own", F.row_number().over(W.partitionBy("key", "_part").orderBy("_row")) - 1), "mix-repeats")
    parts = rows.groupBy("key", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy("key").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = parts.select("key", "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return rows.join(starts, ["key", "_part"]).select("_row", (F.col("_start") + F.col("_own")).alias("number")).where("number > 0")


def _drawn(measured: DataFrame, numbers: DataFrame) -> DataFrame:
    """measured with u; rows that aren't in numbers have number 0."""
    numbered = measured.join(numbers, "_row", "left")
    return numbered.withColumn("u", uniform(F.col("key"), F.coalesce("number", F.lit(0).cast("long")))).drop("number")


def mixed_sizes(docs: DataFrame, tilt: float = TILT, seed: int = SEED) -> DataFrame:
    light = written(_measured(docs.select("doc_id", "source", "text"), seed).drop("text"), "mix-sizes")
    narrow = written(_drawn(light, written(repeats(light), "mix-numbers")), "mix-drawn")
    out = copies(narrow, mixing_plan(narrow, tilt), tilt)
    return out.select("doc_id", "size", F.col("source_size").cast("long").alias("source_size"), "target", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, tilt: float = TILT, seed: int = SEED) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs.

    Columns may have any names. docs is read twice and must give its rows in the same order and parts, as files do.
    """
    kept = docs.select(F.struct(*quoted(docs)).alias("_doc"), "doc_id", "source", "text")
    measured = _measured(kept, seed).drop("text")
    light = written(measured.drop("_doc"), "mix-sizes")
    numbers = written(repeats(light), "mix-numbers")
    narrow = written(_drawn(light, numbers).select("source", "size", "u"), "mix-drawn")
    out = copies(_drawn(measured, numbers), mixing_plan(narrow, tilt), tilt).where("copies > 0")
    return out.select("_doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_doc.*")
