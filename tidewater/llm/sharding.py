"""Sharding by a two-pass external shuffle, with DataFrame functions only.

Pass one scatters records by seeded hashes: to the shard that wins a rendezvous among all shards, and within it to one
of as many buckets as keep a bucket near ``bucket_bytes``. Pass two gathers each bucket in memory, puts it in a fixed
order, runs a seeded Fisher-Yates shuffle over it, numbers the rows behind the buckets before it and writes it.

The law is ``key``: key and number of shards decide alone, and one more shard takes rows only into itself. Rows with a
null key share a shard. Rows of equal key share a shard and are spread over its buckets by all their columns. Fully
equal rows travel as one with their number, in portions of at most ``PORTION`` of a bucket, each in a bucket drawn for
itself; the slots don't depend on where the rows lay. Repeated rows all keep a slot of their own; float columns lose
the sign of zero. Columns of the input pass through, of whatever names; ``two_pass_shuffle`` puts its own ``shard`` and
``slot`` in place of columns called so, ``sharded_documents`` ignores other columns. Null texts are empty; a text longer than a bucket makes a bucket of its own size.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .store import new_path, quoted, written

SHARDS = 24
SEED = 20_240_229
BUCKET_BYTES = 8 << 20
PORTION = 1 / 16


def rendezvous(key: Column, shards: int, seed: int = SEED) -> Column:
    """The shard whose hash with the key is largest."""
    draws = F.transform(F.sequence(F.lit(0), F.lit(shards - 1)), lambda s: F.struct(F.xxhash64(F.lit(seed), key, s).alias("h"), s.alias("s")))
    return F.array_max(draws)["s"]


def _portions(equal: DataFrame, size: str, bucket_bytes: int, per_shard: int, seed: int) -> DataFrame:
    """Rows with their number ``_n`` cut into portions ``_part`` of ``_copies`` rows, each with its ``_bucket``."""
    most = F.greatest(F.lit(1.0), F.floor(F.lit(bucket_bytes * PORTION) / F.greatest(F.lit(1.0), F.coalesce(F.col(size).cast("double"), F.lit(1.0))))).cast("long")
    cut = equal.withColumn("_most", most).withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("(_n - 1) div _most"))))
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), "_h1", "_h2", "_part"), F.lit(per_shard)).cast("int")
    return cut.withColumn("_copies", F.least("_most", F.expr("_n - _part * _most")).cast("int")).withColumn("_bucket", bucket).drop("_n", "_most")


def two_pass_shuffle(df: DataFrame, key: str, size: str, shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """All columns of df, of whatever names, with ``shard`` and ``slot`` (gapless from 0 within a shard) instead of columns called so."""
    kept = [k for k, c in enumerate(df.columns) if c.lower() not in ("shard", "slot")]
    names, parts = ([x[k] for k in kept] for x in (df.columns, quoted(df)))
    key, size = (f"c{names.index(c)}" for c in (key, size))
    df = df.select(*(F.col(c).alias(f"c{k}") for k, c in enumerate(parts)))
    total = df.agg(F.sum(F.col(size).cast("double"))).first()[0] or 0.0
    per_shard = max(1, round(total / shards / bucket_bytes + 0.5))
    columns = df.columns
    # Hashes skip nulls, so these are told apart by flags. The two hashes stand for the row where rows are only counted.
    spread = [x for c in columns for x in (F.col(c).isNull(), F.col(c))]
    hashed = df.withColumns({"_h1": F.xxhash64(F.lit(seed + 1), *spread), "_h2": F.xxhash64(F.lit(seed + 2), *spread)})
    light = hashed.select(rendezvous(F.col(key), shards, seed).alias("_shard"), "_h1", "_h2", size)
    light = light.groupBy("_shard", "_h1", "_h2", size).agg(F.count(F.lit(1)).alias("_n"))
    counted = _portions(light, size, bucket_bytes, per_shard, seed).groupBy("_shard", "_bucket").agg(F.sum("_copies").alias("_n"))
    before = W.partitionBy("_shard").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = written(counted.select("_shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start")), "shard-starts")
    # One partition per bucket and an order within each make the generator of shuffle() agree between reruns.
    equal = hashed.groupBy(*columns, "_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    tagged = _portions(equal, size, bucket_bytes, per_shard, seed).withColumn("_shard", rendezvous(F.col(key), shards, seed))
    dealt = tagged.repartition(shards * per_shard, "_shard", "_bucket")
    packed = dealt.groupBy("_shard", "_bucket").agg(F.sort_array(F.collect_list(F.struct(*columns, "_part", "_copies"))).alias("_rows"))
    packed = packed.withColumn("_rows", F.flatten(F.transform("_rows", lambda x: F.array_repeat(x, x["_copies"]))))
    mixed = packed.sortWithinPartitions("_shard", "_bucket").withColumn("_rows", F.shuffle("_rows", seed))
    placed = mixed.join(starts, ["_shard", "_bucket"]).select("_shard", "_start", F.posexplode("_rows").alias("_pos", "_row"))
    return placed.select(*(F.col("_row")[c].alias(name) for c, name in zip(columns, names, strict=True)), F.col("_shard").alias("shard"), (F.col("_start") + F.col("_pos")).cast("long").alias("slot"))


def write_shards(out: DataFrame, path: str) -> None:
    """A folder per shard; each task writes the buckets it holds, so a shard has many files, the rows of each in slot order."""
    out.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)


def read_shards(like: DataFrame, path: str) -> DataFrame:
    """Written shards with the columns of ``like``."""
    return like.sparkSession.read.schema(like.schema).parquet(path).select(*like.columns)


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Whole documents through the shuffle into shard files; sizes and checksums come from the texts that these hold."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text) + 8).cast("long")
    placed = two_pass_shuffle(docs.select("doc_id", "text", size.alias("size")), "doc_id", "size", shards)
    path = new_path(docs.sparkSession, "shards")
    write_shards(placed, path)
    return read_shards(placed, path).select(
        "doc_id",
        size.alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
        "shard",
        "slot",
        rendezvous(F.col("doc_id"), shards + 1).alias("grown_shard"),
    )
