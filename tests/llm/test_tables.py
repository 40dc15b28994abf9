"""Urls, vectors, shards and mixes against their contracts."""

import math
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.llm import mixing, sharding, topk, urls

DOCS = "doc_id long, text string, source string"


def test_url_parts_and_rules(spark):
    given = {
        "http://A.Example.COM/en/x?q#f": ("a.example.com", "/en/x", "example.com/en/", "block"),
        "https://www.example.com/en/x": ("www.example.com", "/en/x", "www.example.com/en/", "allow"),
        "https://x.www.example.com/en/": ("x.www.example.com", "/en/", "www.example.com/en/", "allow"),
        "http://b.net/es/": ("b.net", "/es/", "net/es/", "block"),
        "http://b.net/fr": ("b.net", "/fr", None, "allow"),
        "http://notexample.com/en/": ("notexample.com", "/en/", "com/", "allow"),
        "http://c.com": ("c.com", "", None, "allow"),
        "http://c.com?x://y/z": ("c.com", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
    }
    pages = spark.createDataFrame([(k, u, "h") for k, u in enumerate(given)], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(None, 1)], "page_id long, bad int")
    found = {r["page_id"]: tuple(r)[1:5] for r in urls.judge(pages, outcomes).collect()}
    assert list(found[k] for k in range(len(given))) == list(given.values())
    assert urls.judge(pages.limit(0), outcomes).count() == 0


def test_reputation_shrinks_to_the_levels_above(spark):
    rows = [(k, f"http://bad{k % 8}.evil.org/p") for k in range(160)] + [(200 + k, f"http://h{k % 8}.good.org/p") for k in range(160)] + [(500, "http://new.evil.org/"), (501, "http://new.good.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    outcomes = spark.createDataFrame([(k, 1) for k in range(160)] + [(200 + k, 0) for k in range(160)], "page_id long, bad int")
    found = {r["page_id"]: r for r in urls.judge(pages, outcomes).collect()}
    assert found[0]["verdict"] == "block" and found[200]["verdict"] == "allow"
    assert found[500]["verdict"] == "block" and found[501]["verdict"] == "allow"
    assert found[500]["bad_rate_low"] < found[0]["bad_rate_low"] + 1e-9 or found[500]["bad_rate_low"] > 0.3


def test_names_domains_and_suffixes(spark):
    given = {"a.b.co.uk": ("b.co.uk", "co.uk"), "me@x.shop.com.cn:8080": ("shop.com.cn", "com.cn"), "co.uk": ("co.uk", "co.uk"), "h.site.org:": ("site.org", "org"), "localhost": ("localhost", "localhost"), "": ("", ""),
             "10.1.2.3:80": ("10.1.2.3", "10.1.2.3"), "[::1]:8080": ("[::1]", "[::1]"), "a.example.com.": ("example.com", "com"), "v.1.2.3": ("2.3", "3")}
    df = spark.createDataFrame([(h,) for h in given], "host string").select("host", urls.domain_of(F.col("host")), urls.suffix_of(F.col("host")))
    assert {r[0]: (r[1], r[2]) for r in df.collect()} == given
    own = spark.createDataFrame([("a.b.c.d",)], "host string").select(urls.domain_of(F.col("host"), ("c.d",)), urls.suffix_of(F.col("host"), ("x.y",)))
    assert tuple(own.first()) == ("b.c.d", "d")


def plain_top(vectors, every, k):
    whole = {i: [math.floor(256 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(whole):
        if q % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=True)), i) for i, v in whole.items() if i != q)
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return out


@pytest.mark.parametrize("block", [7, 4096])
def test_top_k_is_exact_with_ties_and_bad_rows(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "PORTION", 9)
    rng = np.random.default_rng(2)
    rows = [(k, [float(x) for x in rng.normal(size=4).astype(np.float32)]) for k in range(120)]
    rows += [(150 + k, [0.5, 0.25, -0.5, 0.0]) for k in range(30)] + [(400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("nan")] * 4), (403, [float("inf")] * 4), (450, [0.0] * 4)]
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], "vec_id long, embedding array<float>, rank int, v string")
    found = sorted(tuple(r) for r in topk.top_inner_products(df, 50, 5).collect())
    assert found == plain_top(rows, 50, 5)
    assert topk.top_inner_products(df.limit(0)).count() == 0
    few = df.where("vec_id in (0, 1, 2)")
    assert [r["rank"] for r in topk.top_inner_products(few).orderBy("rank").collect()] == [1, 2]


@pytest.mark.parametrize(("width", "scale"), [(1, 1.0), (16, 0.1), (16, 1e6), (0, 1.0)])
def test_top_k_of_portions_carries_bounds(width, scale):
    rng = np.random.default_rng(width)
    values = np.floor(256 * scale * rng.normal(size=(300, width))).astype(np.int64)
    values[100:200] = values[5]
    frame = lambda ids: pd.DataFrame({"vec_id": ids, "dim": width, "v": [values[i].tobytes() for i in ids]})
    found = topk._block(4, 32)(frame(list(range(300))), frame(list(range(0, 300, 7))))
    for q in range(0, 300, 7):
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(values[q], values[i], strict=True)), i) for i in range(300) if i != q)[:4]
        own = found[found["query_id"] == q]
        assert sorted((-s, i) for s, i in zip(own["score"].tolist(), own["vec_id"].tolist(), strict=True)) == scored


def test_sharding_laws(spark):
    rows = [(k, "é" * (k % 9), "s") for k in range(500)] + [(7, "again", "s"), (7, "again", "s"), (None, None, "s")]
    df = spark.createDataFrame(rows, DOCS).withColumnRenamed("source", "shard")
    found = sharding.sharded_documents(df).collect()
    assert len(found) == len(rows)
    slots = {}
    for r in found:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], sharding.SHARDS) and r["law"] == "key"
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    one = next(r for r in found if r["doc_id"] == 5)
    assert (one["size"], one["text_crc32"]) == (18, zlib.crc32(("é" * 5).encode()))
    none = next(r for r in found if r["doc_id"] is None)
    assert (none["size"], none["text_crc32"]) == (8, 0)
    again = {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in sharding.sharded_documents(df.repartition(7)).collect() if r["doc_id"] != 7}
    assert again == {(r["doc_id"], r["text_crc32"]): (r["shard"], r["slot"]) for r in found if r["doc_id"] != 7}
    assert sharding.sharded_documents(df.limit(0)).count() == 0


def test_shuffle_and_mix_keep_columns_of_any_name(spark):
    df = spark.range(60).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.lit("s").alias("source"), *(F.lit(k).alias(c) for k, c in enumerate(("_part", "_h1", "_n", "_doc", "_row", "dotted.name", "Slot"))), F.lit(9).alias("size"))
    out = sharding.two_pass_shuffle(df, "doc_id", "size", shards=2, bucket_bytes=100)
    assert out.columns == [*(c for c in df.columns if c != "Slot"), "shard", "slot"]
    assert sorted(tuple(r)[:-2] for r in out.collect()) == sorted(tuple(r) for r in df.drop("Slot").collect())
    mix = mixing.mixed_documents(df)
    assert mix.columns == df.columns and mix.distinct().exceptAll(df).isEmpty()


def test_shuffle_mixes_within_buckets(spark):
    df = spark.range(3000).select("id", F.lit(10).alias("size"))
    out = sharding.two_pass_shuffle(df, "id", "size", shards=2, bucket_bytes=4000)
    order = [r["id"] for r in out.where("shard = 0").orderBy("slot").collect()]
    assert order != sorted(order) and len(set(order)) == len(order)
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.15


def test_repeated_rows_are_spread_over_buckets(spark):
    rows = [(k, "x" * 12, "s") for k in range(300)] + [(None, "hot", "s")] * 3000 + [(None, None, "s")] * 40 + [(8, "twice", "s")] * 2
    df = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit(20))
    shuffled = lambda d: sharding.two_pass_shuffle(d, "doc_id", "size", shards=2, bucket_bytes=4000)
    out = shuffled(df).collect()
    assert sorted((tuple(r)[:4] for r in out), key=str) == sorted(((*r, 20) for r in rows), key=str)
    for shard in range(2):
        own = sorted((r["slot"], r["text"]) for r in out if r["shard"] == shard)
        assert [s for s, _ in own] == list(range(len(own)))
    hot = sorted((r["slot"], r["text"]) for r in out if r["shard"] == next(r["shard"] for r in out if r["text"] == "hot"))
    longest = run = 0
    for _, text in hot:
        run = run + 1 if text == "hot" else 0
        longest = max(longest, run)
    assert longest < 1000
    assert sorted(map(str, out)) == sorted(map(str, shuffled(df.repartition(7)).collect()))


def plain_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    left, total, target = set(names), 1.5 * sum(sizes.values()), {}
    while left:
        level = (total - sum(target.values())) / sum(weights[s] for s in left)
        over = {s for s in left if level * weights[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weights[s] for s in left}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= over
    return target


def test_mix_meets_its_targets(spark):
    rng = np.random.default_rng(4)
    rows = [(k, " ".join("w" for _ in range(int(rng.integers(0, 60)))), ["a", "b", "c", None, "ü", "B"][int(rng.integers(0, 6)) if k % 3 else 0]) for k in range(3000)]
    rows += [(9001, None, "a"), (9002, "", "empty"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, DOCS)
    found = mixing.mixed_sizes(df).collect()
    assert len(found) == len(rows)
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    targets, source = plain_targets(sizes), {k: s for k, _, s in rows}
    taken = {}
    for r in found:
        s = source[r["doc_id"]]
        assert r["target"] == pytest.approx(targets[s]) and r["source_size"] == sizes[s]
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 2 * r["size"]
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 60 for s in sizes)
    assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mixed_sizes(df.repartition(5)).collect()), key=str)
    mix = mixing.mixed_documents(df)
    assert mix.columns == df.columns
    assert sum(len((r["text"] or "").split()) for r in mix.collect()) == sum(taken.values())


def test_mix_draws_by_size_and_repeats_for_themselves(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_CELLS", 8)
    monkeypatch.setattr(mixing, "CELL_ROWS", 40)
    sized = lambda n: "w " * n
    rows = [(k, sized(4 if k % 2 else 36), "a") for k in range(4000)] + [(20_007, sized(9), "b")] * 900 + [(20_008, sized(5), "b")] * 3 + [(10_000, sized(3000), "c")] + [(10_001 + k, sized(2), "c") for k in range(500)]
    df = spark.createDataFrame(rows, DOCS)
    found = mixing.mixed_sizes(df).collect()
    words = {s: sum(r["taken"] for r in found if r["doc_id"] in ids) for s, ids in (("a", range(4000)), ("b", (20_007, 20_008)), ("c", range(10_000, 10_501)))}
    targets = plain_targets({"a": 80_000, "b": 8115, "c": 4000})
    for s, nearest in (("a", 36), ("b", 9), ("c", 2)):
        whole = targets[s]
        assert abs(words[s] - whole) <= nearest or s == "c"
    # Inclusion goes with the square root of the size: 36 words three times as often as 4.
    extra = lambda n: np.mean([r["taken"] / n - targets["a"] // 80_000 for r in found if r["doc_id"] < 4000 and r["size"] == n])
    assert extra(36) == pytest.approx(min(1, 3 * extra(4)), abs=0.08) and 0 < extra(4) < 1
    assert sum(len(r["text"].split()) for r in mixing.mixed_documents(df).collect()) == sum(words.values())


def test_pareto_ranks_order_by_odds(spark):
    rows = spark.createDataFrame([(0.5, 0.5), (0.2, 0.8), (0.9, 0.1)], "u double, p double")
    assert [round(r[0], 6) for r in rows.select(mixing.pareto_rank(F.col("u"), F.col("p"))).collect()] == [1.0, 0.0625, 81.0]


def test_written_shards_hold_slots_in_order(spark):
    df = spark.createDataFrame([(k, f"text {k}", "s") for k in range(200)], DOCS)
    path = sharding.new_path(spark, "test-shards")
    placed = sharding.two_pass_shuffle(df.withColumn("size", F.lit(900)), "doc_id", "size", shards=3, bucket_bytes=9000)
    sharding.write_shards(placed, path)
    back = sharding.read_shards(placed, path)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, placed.collect()))
    files = back.select("slot", "shard", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at")).collect()
    by = {}
    for r in sorted(files, key=lambda r: r["at"]):
        by.setdefault(r["file"], []).append(r["slot"])
    assert len(by) >= 3 and all(x == sorted(x) for x in by.values())


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], DOCS)
    assert mixing.mixed_sizes(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "x")], DOCS)
    assert [(r["size"], r["taken"]) for r in mixing.mixed_sizes(blank).collect()] == [(0, 0), (0, 0)]
