"""Exact duplicates by distributed MSD radix partitioning: equality needs no digest.

All texts start in one group. A round cuts the next digit of bytes off every text of a group, and texts with another
digit, or another answer to whether they end with it, part. A group of one text is finished, and so is one whose texts
have ended: these are equal. The others go into the next round with what is left of them. Digits grow from ``FIRST`` bytes
by ``GROWTH`` to ``MOST``, so a text of n bytes takes part in some log(n) rounds, and only while another one agrees with it
so far. The bytes themselves are compared throughout.

A round is an aggregation over (group, digit), summed up before its shuffle, and a join back that gives each text the
number of its new group; a group of very many texts is one row on the one side and can be split on the other. Every
round's groups and rows are written to the shared folder, so a lost executor repeats one round at most.

Null texts are empty, and equal to empty ones. Runs of ASCII white space count as one space. A text longer than all
digits together goes on in rounds of ``MOST`` bytes. Of equal texts the least id stays; null ids come last, and of several
rows with that id one stays. Repeated rows are rows of their own. Other columns don't matter, whatever their names;
``without_copies`` returns them, and of rows that share text and id the least one. An empty table gives no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import written

FIRST, GROWTH, MOST = 256, 8, 8 << 20
SPACE = r"[\x20\x09-\x0D]+"
#: Copies of a tied row that are written out together.
PORTION = 65_536


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def radix_groups(rows: DataFrame, first: int = FIRST, growth: int = GROWTH, most: int = MOST) -> DataFrame:
    """id, mark, keep_id and group_size of every row of ``rows`` (id, mark, body): body is binary and not null, mark is carried."""
    active, width, done = rows.select(F.lit(0).cast("long").alias("group"), "id", "mark", "body"), first, []
    while True:
        digit, ended = F.expr(f"substring(body, 1, {width})"), F.octet_length("body") <= width
        cut = active.withColumns({"digit": digit, "ended": ended})
        key = ["group", "digit", "ended"]
        shared = cut.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("keep_id")).where("n > 1")
        shared = written(shared.withColumn("next", F.monotonically_increasing_id()), "radix-groups")
        split = cut.join(shared, key, "left")
        rest = F.when(F.col("n").isNotNull() & ~F.col("ended"), F.expr(f"substring(body, {width + 1})"))
        keep = F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep_id"))
        level = written(split.select(F.col("next").alias("group"), "id", "mark", keep.alias("keep_id"), F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), rest.alias("body")), "radix-rows")
        done.append(level.where("body is null").drop("group", "body"))
        active, width = level.where("body is not null").select("group", "id", "mark", "body"), min(width * growth, most)
        if active.isEmpty():
            return reduce(DataFrame.unionByName, done)


def with_one_kept(groups: DataFrame) -> DataFrame:
    """Groups with ``kept``: true for one row of each group, of the least id."""
    least = F.col("id").eqNullSafe(F.col("keep_id"))
    tied = groups.where(least & (F.col("group_size") > 1)).groupBy(*groups.columns).agg(F.count(F.lit(1)).alias("_n"))
    # Copies of one row are indistinguishable, so they are counted and written out again, in portions that several tasks share.
    portions = tied.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {PORTION}")))).repartition("id", "_part")
    copies = portions.withColumn("_k", F.explode(F.sequence(F.expr(f"_part * {PORTION}"), F.least(F.expr(f"(_part + 1) * {PORTION}"), F.col("_n")) - 1)))
    plain = groups.where(~least | (F.col("group_size") == 1)).withColumn("kept", least)
    return plain.unionByName(copies.withColumn("kept", F.col("_k") == 0).drop("_n", "_part", "_k"))


def judged_documents(docs: DataFrame, first: int = FIRST, growth: int = GROWTH, most: int = MOST) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every document."""
    body = normalised(F.col("text")).cast("binary")
    rows = docs.select(F.col("doc_id").alias("id"), F.sha2(body, 256).alias("mark"), body.alias("body"))
    found = with_one_kept(radix_groups(rows, first, growth, most))
    return found.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("mark").alias("text_sha256"))


def without_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, with all their columns."""
    stay = judged_documents(docs).where("kept").select(F.col("doc_id").alias("id"), F.col("text_sha256").alias("mark"))
    marked = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("mark"))
    same = F.col("row.doc_id").eqNullSafe(F.col("id")) & (marked["mark"] == stay["mark"])
    return marked.join(stay, same, "left_semi").groupBy(F.col("row.doc_id"), "mark").agg(F.min("row").alias("row")).select("row.*")
