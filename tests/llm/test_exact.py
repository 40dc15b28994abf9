"""Exact duplicates, manifests and hard negatives against plain versions."""

import hashlib
import math
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewater.llm import merkle, negatives, radix

DOCS = "doc_id long, text string, source string, lang string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_copies(rows):
    """Sorted (doc_id, keep_id, group_size, kept, digest) of rows (doc_id, text)."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", text or ""), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(i, ids[0], len(ids), k == 0, sha(text)) for k, i in enumerate(ids)]
    return sorted(out, key=str)


TEXTS = ["", " ", "a", "ab", "ab ", "ab\t\n", "abc", "abcd", "abcde", "a\x00b", "a\x00", "é", "é", "ü" * 300, "ü" * 301, "x" * 5000, "x" * 5001, "x" * 4096, " ", "line one\nline two", "line one  line two"]


@pytest.mark.parametrize(("first", "growth", "most"), [(1, 1, 1), (3, 5, 2000), (256, 8, 8 << 20)])
def test_radix_groups_are_exact(spark, monkeypatch, first, growth, most):
    monkeypatch.setattr(radix, "PORTION", 7)
    texts = TEXTS if first > 1 else [t for t in TEXTS if len(t) < 6]
    rows = [(k, t) for k, t in enumerate(texts)] + [(100 + k, t) for k, t in enumerate(texts[::2])] + [(500, None), (None, "a"), (None, None), (None, "only null"), (None, "only null")]
    rows += [(7, "tied")] * 20 + [(8, "tied"), (6, "other")] + [(3, "ab"), (3, "again")]
    df = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, n int, body string, id string")
    found = sorted((tuple(r) for r in radix.judged_documents(df, first, growth, most).collect()), key=str)
    assert found == plain_copies(rows)


def test_radix_takes_very_long_texts_and_hot_groups(spark):
    long = "word " * 400_000
    rows = [(1, long), (2, long + "."), (3, long)] + [(10 + k, "boilerplate " * 30 + str(k % 3)) for k in range(600)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in radix.judged_documents(df).collect()), key=str) == plain_copies(rows)


def test_documents_without_copies(spark):
    rows = [(1, "a b", "s", None, 9), (1, "a  b", "r", None, 9), (2, "a b", "s", None, 9), (3, None, None, None, None), (4, "", "s", None, 0), (None, "z", "s", None, 0)]
    df = spark.createDataFrame(rows, DOCS).withColumn("mark", F.lit(1)).withColumn("row", F.lit("x"))
    kept = radix.without_copies(df)
    assert kept.columns == df.columns
    assert sorted((tuple(r)[:2] for r in kept.collect()), key=str) == sorted([(1, "a  b"), (3, None), (None, "z")], key=str)
    assert radix.judged_documents(df.limit(0)).count() == 0 and radix.without_copies(df.limit(0)).count() == 0


def plain_manifest(rows, fan):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def lower(t):
        return None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)

    def climb(nodes):
        """The root, and per node the list of (left, right) siblings."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for i, place in enumerate(at):
                low = place // fan * fan
                paths[i].append(("".join(nodes[low:place]), "".join(nodes[place + 1 : low + fan])))
                at[i] = place // fan
            nodes = [sha(*nodes[k : k + fan]) for k in range(0, len(nodes), fan)]
        return nodes[0], paths

    sources, trees = sorted({r[2] for r in rows}, key=lambda s: (s is not None, (s or "").encode())), {}
    for s in sources:
        own = [(r, sha(*map(field, (r[0], r[2], r[3], r[4], r[1])))) for r in rows if r[2] == s]
        own.sort(key=lambda x: (x[0][0] is not None, x[0][0] or 0, x[1]))
        trees[s] = (own, *climb([leaf for _, leaf in own]))
    root, above = climb([trees[s][1] for s in sources])
    out = []
    for s, more in zip(sources, above, strict=True):
        own, subroot, paths = trees[s]
        for (r, leaf), path in zip(own, paths, strict=True):
            path = path + more
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            node = sha(*map(field, (r[0], r[2], r[3], r[4], lower(r[1])))) if tampered else leaf
            for left, right in path:
                node = sha(left, node, right)
            out.append((r[0], leaf, subroot, root, sha(*(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


@pytest.mark.parametrize("fan", [2, 3, 16])
def test_manifest_matches_a_plain_tree(spark, fan):
    rows = [(k, f"Text {k} É", "hot", "en", k) for k in range(70)] + [(k, "Lone", f"s{k}", None, None) for k in (1, 2)] + [(5, None, None, None, 0), (6, "", None, "de", 1), (None, "A", "hot", "en", 2)]
    rows += [(7, "Tied", "hot", "en", 3)] * 40 + [(7, "Tied!", "hot", "en", 3), (9, "Ü" * 100_000 + "Z", "é", "en", 4), (10, "x", "", "en", 5), (11, "x", "\U0001f600", "en", 5)]
    df = spark.createDataFrame(rows, DOCS).withColumn("known", F.lit(1)).withColumn("node", F.lit("x")).withColumn("pos", F.lit(0))
    found = sorted((tuple(r) for r in merkle.manifest(df.repartition(5), fan).collect()), key=str)
    assert found == plain_manifest(rows, fan)
    assert {r[-1] for r in found} == {True, False}


def test_manifest_of_little(spark):
    df = spark.createDataFrame([(5, "Abc", "s", "en", 3)], DOCS)
    assert [tuple(r) for r in merkle.manifest(df).collect()] == plain_manifest([(5, "Abc", "s", "en", 3)], 16)
    none = merkle.manifest(df.limit(0))
    assert none.count() == 0 and none.columns == merkle.manifest(df).columns


def test_windows_hold_one_run(spark):
    plan = merkle.siblings(spark.createDataFrame([(True, "s", 0, 1, "x")], "known boolean, name string, pos long, n long, node string"))._jdf.queryExecution().toString()
    assert re.search(r"windowspecdefinition\(known#\d+, name#\d+, run#\d+L?, pos", plan)


def plain_negatives(rows, every=50, positives=5, negatives_=3):
    whole = []
    for i, v, label in rows:
        if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            whole.append((i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]))
    anchors = {}
    for i, label, v in whole:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (len(v), label, v)), (len(v), label, v))
    out = []
    for a, (dim, label, v) in anchors.items():
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, other, w in whole if i != a and len(w) == dim)
        for ps, p, _ in [x for x in scored if x[2]][:positives]:
            fit = [(i, -s) for s, i, same in scored if not same and 50 * -ps <= 100 * -s <= 95 * -ps][:negatives_]
            out += [(a, p, k + 1, i, -ps, s) for k, (i, s) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("cells", [40, 1 << 21])
def test_hard_negatives_match_brute_force(spark, monkeypatch, cells):
    monkeypatch.setattr(negatives, "CELLS", cells)
    monkeypatch.setattr(negatives, "ROW_BLOCK", 60)
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 3)
    rng = np.random.default_rng(5)
    rows = [(k, [float(x) for x in rng.normal(0.3, 1, 4).astype(np.float32)], int(rng.integers(0, 4)) if k % 3 else 1) for k in range(300)]
    rows += [(1000 + k, [0.5, 0.25, -0.5, 0.25], k % 2) for k in range(120)] + [(350, [0.0] * 4, 2), (400, None, 1), (450, [1.0] * 4, None), (None, [1.0] * 4, 1)]
    rows += [(500, [1.0, None, 0.0, 0.0], 1), (550, [float("nan")] * 4, 1), (600, [float("inf")] * 4, 1), (650, [1.0, 1.0], 1), (651, [1.0, 1.0], 1), (652, [0.75, 1.0], 2), (700, [], 1), (701, [], 2), (2, [2.0] * 4, 1), (2, [2.0] * 4, 3), (50, [9.0] * 4, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("dim", F.lit(9)).withColumn("v", F.lit("x")).withColumn("block", F.lit(1))
    found = sorted(tuple(r) for r in negatives.hard_negatives(df).collect())
    assert found == plain_negatives(rows) and len(found) > 50
    assert negatives.hard_negatives(df.limit(0)).count() == 0


def test_hard_negatives_of_large_components(spark):
    rows = [(k, [float(x) for x in v], k % 3) for k, v in enumerate(np.random.default_rng(1).integers(100_000, 2_000_000, (120, 3)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert sorted(tuple(r) for r in negatives.hard_negatives(df, low=10, high=99).collect()) == [r for r in sorted(wide(rows))]


def wide(rows):
    """The plain version between 10 and 99 hundredths."""
    whole = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, v, label in rows]
    for a, label, v in whole:
        if a % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, other == label) for i, other, w in whole if i != a)
            for ps, p, _ in [x for x in scored if x[2]][:5]:
                for k, (i, s) in enumerate([(i, -s) for s, i, same in scored if not same and 10 * -ps <= 100 * -s <= 99 * -ps][:3]):
                    yield a, p, k + 1, i, -ps, s


def test_slots_keep_the_first_and_merge_upwards(spark):
    keys, scores, ids = [np.array([1, 0, 1, 1, 1])], np.array([5, 9, 7, 5, 7]), np.array([4, 1, 8, 3, 2])
    assert ids[negatives.first_k(keys, scores, ids, 3)].tolist() == [1, 2, 8, 3]
    best = spark.createDataFrame(pd.DataFrame([(1, 0, 10, 90), (1, 0, 11, 80), (1, 2, 12, 70), (1, 2, 13, 70), (1, 2, 14, 60)], columns=["anchor_id", "slot", "negative_id", "negative_score"]))
    found = {r["slot"]: [x["id"] for x in r["first"]] for r in negatives.merged_slots(best, 3, 3).collect()}
    assert found == {0: [10, 11, 12], 1: [12, 13, 14], 2: [12, 13, 14]}
