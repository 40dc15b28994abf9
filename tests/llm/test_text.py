"""Scoring, joins, classification and packing of texts against plain versions."""

import itertools
import math
import random
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewater.llm import hashing, jaccard, ngram, packing, store, toxicity
from tidewater.llm.components import components
from tidewater.llm.eliasfano import EliasFano
from tidewater.llm.store import released

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, texts, source="s"):
    return spark.createDataFrame([(k, t, "en", source, len(t or "")) for k, t in enumerate(texts)], DOCS)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 5000), min_size=1, max_size=300, unique=True), st.lists(st.integers(0, 6000), max_size=50))
def test_elias_fano_finds_what_is_there(values, asked):
    values = np.array(sorted(values))
    coded = EliasFano.from_arrays(*EliasFano.of(values, 6001).arrays())
    assert coded.access(np.arange(len(values))).tolist() == values.tolist()
    x = np.array(asked, np.int64)
    place = {v: k for k, v in enumerate(values.tolist())}
    assert coded.find(x, np.full(len(x), len(values))).tolist() == [place.get(v, -1) for v in asked]
    half = len(values) // 2
    assert coded.find(x, np.full(len(x), half)).tolist() == [place[v] if place.get(v, half) < half else -1 for v in asked]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 63).flatmap(lambda bits: st.tuples(st.just(bits), st.lists(st.integers(0, (1 << bits) - 1), min_size=1, max_size=200, unique=True))))
def test_elias_fano_messages_keep_all_numbers(sequence):
    bits, values = sequence
    packed = EliasFano.of(np.array(sorted(values), np.uint64), 1 << bits).packed()
    coded = EliasFano.unpacked(packed)
    assert coded.values().tolist() == sorted(values) == coded.access(np.arange(len(values))).tolist()
    assert len(packed) <= 6 + len(values) * (bits - math.log2(len(values)) + 3) / 8 + 2


@given(st.lists(st.integers(0, 2**62), min_size=1, max_size=200))
def test_counts_come_back_from_messages(values):
    assert ngram._wide(ngram._narrow(np.array(values))).tolist() == values


def plain_scores(texts):
    seqs = [(k, ["<s>", "<s>", *(t or "").encode().lower().split(), "</s>"]) for k, t in enumerate(texts)]
    c, c2, c3, n_docs = Counter(), Counter(), Counter(), 0
    for k, w in seqs:
        if zlib.crc32(str(k).encode()) % 5 != 1:
            n_docs += 1
            c.update(w[2:])
            c2.update(zip(w[1:], w[2:], strict=False))
            c3.update(zip(w, w[1:], w[2:], strict=False))
    n, v = sum(c.values()), len(c)
    first, second = c | Counter({"<s>": n_docs}), c2 | Counter({("<s>", "<s>"): n_docs})
    for k, w in seqs:
        base = own = known = 0
        for a, b, x in zip(w, w[1:], w[2:], strict=False):
            p1 = (c[x] + 0.5) / (n + 0.5 * (v + 1))
            p2 = (c2[b, x] + ngram.PRIORS[2] * p1) / (first[b] + ngram.PRIORS[2])
            base, known = base + math.log10(p1), known + (c[x] > 0)
            own += math.log10((c3[a, b, x] + ngram.PRIORS[3] * p2) / (second[a, b] + ngram.PRIORS[3]))
        yield k, len(w) - 2, known, n, base, own


def test_lm_scores_match_a_plain_model(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choice(["a", "b", "Cc", "dé", "e\u00a0f", "g"]) for _ in range(rng.randrange(30))) for _ in range(60)] + [None, "", "  \t\n", "new words only", "x" * 300_000]
    found = {r["doc_id"]: r for r in ngram.scored_documents(docs(spark, texts)).collect()}
    assert len(found) == len(texts)
    for k, n_tokens, known, n, base, own in plain_scores(texts):
        r = found[k]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) == (n_tokens, known, n, zlib.crc32(str(k).encode()) % 5 == 1)
        assert r["base_score"] == pytest.approx(base) and r["score"] == pytest.approx(own, abs=2e-4 * n_tokens)


def block_of_words(n=60_000):
    words = np.random.default_rng(7).zipf(1.3, n) % 5000
    texts = [" ".join(f"w{w}" for w in part) for part in np.split(words, 200)]
    data = "".join(texts).encode()
    lengths = np.array([len(t) for t in texts], np.int64).tobytes()
    return texts, pa.RecordBatch.from_pydict({"block": [5], "ids": [list(range(200))], "lengths": [lengths], "texts": [zstandard.compress(data)]})


def test_messages_of_scoring_take_few_bits_and_lose_no_count():
    """On disk they were stopped at 4 x input: gaps took whole bytes, and a frequent n-gram widened the counts of all."""
    texts, block = block_of_words()
    layout = ngram.Layout(47, 2)
    sent = pa.Table.from_batches(list(ngram._sent(layout)(iter([block])))).to_pandas()
    split = [["<s>", "<s>", *t.split(), "</s>"] for t in texts]
    for order in (1, 2, 3):
        grams = [[tuple(w[k - order + 1 : k + 1]) for k in range(2, len(w))] for w in split]
        trained = Counter(g for k, part in enumerate(grams) if zlib.crc32(str(k).encode()) % 5 != 1 for g in part)
        counts = [trained[g] for g in set(itertools.chain(*grams))]
        back = [ngram._totals(part) for _, part in sent[sent["level"] == order].groupby("shard")]
        totals = np.concatenate([ngram._wide(t) for part in back for t in part["totals"][part["block"] == 5]])
        assert sorted(totals.tolist()) == sorted(counts)
        assert sum(part["kinds"].sum() for part in back) == len(trained)
        if order > 1:
            rows = sent[sent["level"] == order]
            assert 8 * rows["keys"].map(len).sum() / len(counts) < layout.bits(order) - math.log2(len(counts)) + 3
            assert 8 * rows["counts"].map(len).sum() / len(counts) < 3
            assert 8 * sum(map(len, itertools.chain(*(part["totals"] for part in back)))) / len(counts) < 4


RELEASED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def test_shuffle_files_go_when_a_released_query_ends(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {n for n in (files.apply(k).getName() for k in range(files.size())) if n.startswith("shuffle_") and n.endswith(".data")}

    def left(before):
        for _ in range(100):
            if not shuffled() - before:
                break
            time.sleep(0.1)
        return shuffled() - before

    # The frames are held, so that collecting garbage can't be what frees their files.
    start, before = spark.conf.get(RELEASED), shuffled()
    with released(spark):
        held = spark.range(1000).groupBy((F.col("id") % 100).alias("k")).count()
        assert len(held.collect()) == 100
    assert not left(before) and spark.conf.get(RELEASED) == start
    with pytest.raises(ZeroDivisionError), released(spark):
        1 / 0  # noqa: B018
    assert spark.conf.get(RELEASED) == start
    assert len(held.collect()) == 100


def test_what_blocks_sent_is_released_with_the_totals(spark, monkeypatch):
    seen, written = {}, ngram.written

    def noted(df, label):
        seen[label] = spark.conf.get(RELEASED)
        return written(df, label)

    monkeypatch.setattr(ngram, "written", noted)
    scores = ngram.scored_documents(docs(spark, block_of_words()[0]))
    assert seen == {"ngram-blocks": "false", "ngram-totals": "true"} and spark.conf.get(RELEASED) == "false"
    assert scores.count() == 200


def test_lm_scores_of_nothing(spark):
    assert ngram.scored_documents(docs(spark, ["x"]).limit(0)).count() == 0
    row = ngram.scored_documents(spark.createDataFrame([(None, None, "en", "s", 0)], DOCS)).first()
    assert row["n_tokens"] == 1 and row["doc_id"] is None


def plain_components(texts, width, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset())
    root, links = list(range(len(sets))), [0] * len(sets)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                links[a], links[b] = links[a] + 1, links[b] + 1
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: (len(s), find(k), links[k]) for k, s in enumerate(sets)}


@pytest.mark.parametrize(("width", "percent"), [(4, 85), (5, 80)])
def test_jaccard_join_matches_all_pairs(spark, monkeypatch, width, percent):
    # Small limits, so that hot members, large buckets and several blocks occur.
    for name, value in (("HOT_COUNT", 30), ("BUCKET", 6), ("BLOCK_ROWS", 16), ("LOCAL_LEAST", 2)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 5)))
    base = [word() for _ in range(80)]
    texts = [None, "", " \n", "one", "ONE", "one two", "two one", "a b c d", "A b\tc  d", "a b c d e"]
    for _ in range(70):  # near copies of one text
        copy = list(base)
        for _ in range(rng.randrange(4)):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
    for _ in range(40):
        own = [word() for _ in range(rng.randrange(4, 60))] + base[10:30]
        texts += [" ".join(own), " ".join(own[: rng.randrange(3, len(own))])]
    texts += [texts[-1]] * 5
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join_documents(docs(spark, texts), width, percent).collect()}
    assert found == plain_components(texts, width, percent)


def test_linked_sets_agree_on_a_part_of_the_smaller_ones_band():
    rng = np.random.default_rng(1)
    for percent, _ in itertools.product((30, 60, 80, 85, 99, 100), range(300)):
        a = int(rng.integers(1, 150))
        b = int(rng.integers(a, 100 * a // percent + 1))
        shared = -(-percent * (a + b) // (100 + percent))
        if shared > a:
            continue
        pool = np.unique(rng.integers(1, 1 << 63, a + b - shared, dtype=np.uint64) * np.uint64(2))
        rng.shuffle(pool)
        x, y = np.sort(pool[:a]), np.sort(np.concatenate((pool[:shared], pool[a:])))
        keys, owners = jaccard.part_keys([np.zeros(0, np.uint64), x, y], percent)
        both = set(keys[owners == 1].tolist()) & set(keys[owners == 2].tolist())
        band = sum(low <= a for low in jaccard.band_bounds(percent)) - 1
        assert any(key % (1 << jaccard.BAND_BITS) == band for key in both) and set(owners.tolist()) == {1, 2}


def test_sets_of_common_members_are_not_compared_all_with_all(spark, monkeypatch):
    for name, value in (("HOT_COUNT", 30), ("LOCAL_LEAST", 2)):
        monkeypatch.setattr(jaccard, name, value)
    counts, released_ = {}, set()

    def watched(df, label, rows_per_file=0):
        found = store.written(df, label, rows_per_file)
        counts.setdefault(label, found.count())
        released_.add(spark.conf.get(store._RELEASED, "false"))
        return found

    monkeypatch.setattr(jaccard, "written", watched)
    rng = random.Random(7)
    # Every text is made of passages that many have, but no two of the same ones.
    passages = [" ".join(f"p{k}w{j}" for j in range(25)) for k in range(14)]
    texts = [" ".join(passages[k] for k in order) for order in rng.sample(list(itertools.combinations(range(14), 3)), 240)]
    texts += [texts[3] + " more", texts[4] + " more", texts[5][:-1]]
    found = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["n_links"]) for r in jaccard.join_documents(docs(spark, texts), 4, 85).collect()}
    assert found == plain_components(texts, 4, 85) and sum(x[2] > 0 for x in found.values()) >= 6
    assert counts["jaccard-members"] < 60
    assert released_ == {"true"} and spark.conf.get(store._RELEASED, "false") == "false"


def test_near_copies_of_common_members_stay_few_and_files_go(spark, monkeypatch):
    for name, value in (("HOT_COUNT", 30), ("LOCAL_LEAST", 2)):
        monkeypatch.setattr(jaccard, name, value)
    members, released_ = [], set()

    def watched(df, label, rows_per_file=0):
        found = store.written(df, label, rows_per_file)
        if label == "jaccard-members":
            members.append(found.count())
        if label in ("jaccard-sketches", "jaccard-met", "jaccard-compared"):
            released_.add(spark.conf.get(store._RELEASED, "false"))
        return found

    monkeypatch.setattr(jaccard, "written", watched)
    passages = [" ".join(f"p{k}w{j}" for j in range(25)) for k in range(24)]
    texts = [" ".join(passages[k] for k in order) for order in random.Random(7).sample(list(itertools.combinations(range(24), 6)), 240)]
    kept = jaccard.one_of_each(docs(spark, [*texts, texts[3] + " more", texts[4]]), 5, 80)
    assert sorted(r["doc_id"] for r in kept.select("doc_id").collect()) == list(range(240))
    assert members[0] < 60 and released_ == {"true"} and spark.conf.get(store._RELEASED, "false") == "false"


def test_jaccard_keeps_one_of_each_and_odd_rows(spark):
    texts = ["a b c d e f g"] * 3 + ["other words stand in this one here", None, ""]
    df = docs(spark, texts)
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(df, 5, 80).collect()) == [0, 3, 4, 5]
    assert jaccard.one_of_each(df, 5, 80).columns == df.columns
    twice = df.union(spark.createDataFrame([(None, "a b c d e f g", "en", "s", 1)], DOCS)).withColumnRenamed("lang", "digest")
    assert jaccard.join_documents(twice).count() == 7
    assert jaccard.join_documents(df.limit(0)).count() == 0


def test_jaccard_tells_rows_of_one_id_and_without_id_apart(spark):
    base = [f"w{k}" for k in range(60)]
    near, other, third = " ".join([*base[:59], "new"]), " ".join(f"v{k}" for k in range(30)), " ".join(f"u{k}" for k in range(30))
    base = " ".join(base)
    given = [(1, base), (1, base), (2, near), (2, other), (None, near), (None, third), (None, third + " more"), (5, None), (None, "")]
    df = spark.createDataFrame([(k, t, "en", "s", 0) for k, t in given], DOCS)
    kept = sorted(((r["doc_id"], r["text"]) for r in jaccard.one_of_each(df, 5, 80).collect()), key=str)
    assert len(kept) == 5 and [x for x in kept if x[1] in (third, third + " more")] and {(1, base), (2, other), (5, None), (None, "")} < set(kept)
    found = sorted((tuple(r) for r in jaccard.join_documents(df, 5, 80).collect()), key=str)
    assert found == sorted([(1, 56, 1, 3), (1, 56, 1, 3), (2, 56, 1, 3), (2, 26, 1, 0), (None, 56, 1, 3), (None, 26, None, 1), (None, 27, None, 1), (5, 0, 5, 0), (None, 0, None, 0)], key=str)


def test_jaccard_keeps_columns_of_any_name(spark):
    df = docs(spark, ["a b c d e f g"] * 3 + ["other words stand in this one here"]).select("*", F.lit("mine").alias("_row"), F.lit(1).alias("__ROW"), F.lit(2).alias("dotted.name"))
    kept = jaccard.one_of_each(df, 5, 80)
    assert kept.columns == df.columns
    assert sorted(tuple(r) for r in kept.collect()) == sorted(tuple(r) for r in df.where("doc_id in (0, 3)").collect())


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 101), (7, 7)], "a long, b long")
    found = {r["node"]: r["component"] for r in components(edges).collect()}
    assert found == {k: 0 for k in range(41)} | {100: 100, 101: 100}


def test_toxicity_learns_words_and_keeps_clean_rows(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    text = lambda bad: " ".join([word() for _ in range(30)] + ["the", "of"] + ["grobble", "snarfle"] * bad)
    kinds = [k % 6 == 0 for k in range(240)]
    df = docs(spark, [text(b) for b in kinds] + [None, "", "grobble snarfle now"])
    labels = spark.createDataFrame([(k, int(k % 5 != 0), int(b)) for k, b in enumerate(kinds)] + [(1, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    found = {r["doc_id"]: r for r in toxicity.judged_documents(df, labels).collect()}
    assert [found[k]["rejected"] for k in range(240)] == kinds
    assert found[242]["rejected"] and not found[240]["rejected"] and not found[241]["rejected"]
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and kept.count() == 240 - sum(kinds) + 2
    none = toxicity.judged_documents(df, labels.limit(0))
    assert none.where("rejected or p_toxic is not null").count() == 0 and none.count() == 243


def test_toxicity_learns_a_rare_kind_from_a_bounded_sample(spark, monkeypatch):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    rare = set(range(300, 3900, 300))
    df = docs(spark, [" ".join([word() for _ in range(30)] + ["grobble", "snarfle"] * (k in rare)) for k in range(4000)])
    rows = [(k, int(k % 5 != 0), int(k in rare)) for k in range(4000)] + [(10_000 + k, 1, 1) for k in range(4000)]  # the last ones without documents
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    sample = toxicity.labelled_sample
    monkeypatch.setattr(toxicity, "labelled_sample", lambda d, x: sample(d, x, 120))
    assert toxicity.labelled_sample(df, labels).count() <= 200
    assert {r["doc_id"] for r in toxicity.judged_documents(df, labels).where("rejected").collect()} == rare
    assert toxicity.labelled_sample(df, labels.where("toxic = 0 or doc_id >= 10000")) is None


def test_sample_has_one_text_of_each_labelled_id(spark):
    word = lambda k: chr(97 + k % 26) * (4 + k // 26)
    rows = [(k, f"{word(k)} told", "en", "s", 0) for k in range(40)] + [(3, f"{word(k)} hot", "en", "s", 0) for k in range(500)] + [(3, None, "en", "s", 0)]
    labels = spark.createDataFrame([(k, k % 2, int(k % 4 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    found = [r["doc_id"] for r in toxicity.labelled_sample(spark.createDataFrame(rows, DOCS), labels).collect()]
    assert sorted(found) == list(range(40))


def test_logistic_fit_equals_a_dense_newton_solution():
    rng = np.random.default_rng(3)
    n, few = 2000, 12
    features = [np.flatnonzero(rng.random(few) < 0.4) for _ in range(n)]
    odds, weights = rng.normal(size=(n, 1)), rng.uniform(0.5, 2, n)
    words = np.array([np.isin(np.arange(few), f) for f in features], float)
    labels = (words @ np.linspace(-2, 2, few) + odds[:, 0] + rng.logistic(size=n) > 0).astype(float)
    kept = toxicity.telling(features, labels)
    x = np.column_stack([words[:, kept], odds, np.ones(n)])
    penalty = np.array([toxicity.RIDGE] * (len(kept) + 1) + [1e-6])
    plain = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-x @ plain))
        plain -= np.linalg.solve(x.T * (weights * p * (1 - p)) @ x + np.diag(penalty), x.T @ (weights * (p - labels)) + penalty * plain)
    found = toxicity.fit_logistic(features, odds, labels, weights=weights)
    assert len(kept) >= 6
    assert np.abs(np.concatenate([found[kept], found[toxicity.FEATURES :]]) - plain).max() < 1e-3


def test_drawn_shares_are_bounded_and_leave_no_group_out():
    assert toxicity.drawn_shares([5000, 3000], 8000) == [1, 1]
    for counts in ([10**12, 10**8, 7, 1], [40_000] * 4, [10**6, 3], [9000, 500, 500, 1]):
        taken = [n * s for n, s in zip(counts, toxicity.drawn_shares(counts, 8000), strict=True)]
        assert sum(taken) == pytest.approx(8000) and all(t >= min(n, 1000) - 1e-6 for n, t in zip(counts, taken, strict=True))


def test_chain_uses_earlier_categories():
    rng = np.random.default_rng(0)
    features = [np.array([], np.int64)] * 400
    odds = rng.normal(size=(400, 1)) * 3
    w = toxicity.fit_logistic(features, odds, (odds[:, 0] > 0).astype(float))
    assert w[toxicity.FEATURES] > 1 and len(w) == toxicity.FEATURES + 2


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 100), st.integers(1, 30), min_size=1, max_size=40))
def test_packing_plan_places_every_piece_once(histogram):
    made = packing.plan(histogram, 100)
    fill, seen = {}, Counter()
    for length, rank, count, first, offset in made.placed:
        for k in range(count):
            seen[length, rank + k] += 1
            fill.setdefault(first + k, []).append((offset, length))
    assert seen == Counter({(x, k): 1 for x, n in histogram.items() for k in range(n)})
    for parts in fill.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 100
    assert len(fill) <= made.sequences <= max(1, sum(histogram.values()))


def test_packed_documents(spark):
    from tokenizers import Tokenizer

    texts = ["Hello World, it's 3rd!", None, "", "a b " * 5000, "ΣΑΣ <|endoftext|> é", "Hello World, it's 3rd!"]
    df = docs(spark, texts).union(docs(spark, texts[:1]))
    rows = packing.packed_documents(df).collect()
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for k, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = sorted({(r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by[k]})
        assert mine == [(p, p * 4096, len(ids[p * 4096 : (p + 1) * 4096]), zlib.crc32(ids[p * 4096 : (p + 1) * 4096].tobytes())) for p in range(-(-len(ids) // 4096))]
    assert len(by[0]) == 2
    places = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    ends = {}
    for s, o, n in places:
        assert ends.get(s, 0) == o
        ends[s] = o + n
    assert max(ends.values()) <= 4096 and len(ends) == -(-sum(r["length"] for r in rows) // 4096)
    assert packing.packed_documents(df.limit(0)).count() == 0


def test_small_batches_hold_inside_only(spark):
    df = docs(spark, ["x" * 1000] * 64).coalesce(1)
    rows = lambda: [r[0] for r in df.mapInArrow(lambda it: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in it), "n long").collect()]
    size, whole = spark.conf.get(store._BATCH), rows()
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(store, "SENT_BYTES", 8000)
        with pytest.raises(KeyError), store.small_batches(spark):
            cut = rows()
            raise KeyError
    assert spark.conf.get(store._BATCH) == size and rows() == whole
    assert sum(cut) == 64 and max(cut) <= 10 and len(cut) > len(whole)


def test_stages_send_texts_in_small_batches(spark, monkeypatch):
    labels = {"pack-pieces", "jaccard-counts", "jaccard-sketches", "jaccard-sets"}
    seen = {}

    def watched(df, label, rows_per_file=0):
        seen[label] = spark.conf.get(store._BATCH)
        return store.written(df, label, rows_per_file)

    texts = [" ".join(f"w{k // 2 * 7 + j}" for j in range(40)) + " end" * (k % 2) for k in range(60)] + [None, "", "one"]
    df = docs(spark, texts)
    one, packed = (sorted(map(tuple, found.collect())) for found in (jaccard.one_of_each(df, 5, 80).select("doc_id"), packing.packed_documents(df)))
    monkeypatch.setattr(store, "SENT_BYTES", 500)
    for module in (jaccard, packing):
        monkeypatch.setattr(module, "written", watched)
    assert sorted(map(tuple, jaccard.one_of_each(df, 5, 80).select("doc_id").collect())) == one
    assert sorted(map(tuple, packing.packed_documents(df).collect())) == packed
    assert {seen[x] for x in labels} == {"500"} and len(one) == 33


def test_encoder_needs_little_beside_its_words():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(3))
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(word() for _ in range(2000)) for _ in range(400)])], ["text"])
    encoder = packing.Encoder(packing.tokenizer_path())
    for part in store.sliced(iter([batch]), "text", packing.BATCH_BYTES):  # all words are known from here on
        encoder(part["text"])
    tracemalloc.start()
    for part in store.sliced(iter([batch]), "text", packing.BATCH_BYTES):
        encoder(part["text"])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 32 << 20


def encoded(encoder, texts):
    ids, bounds = encoder(pa.array(texts, pa.string()))
    return [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)]


def plainly_encoded(encoder, texts):
    return [[*encoder.tokenizer.encode(x or "", add_special_tokens=False).ids, packing.END_ID] for x in texts]


def test_encoder_forgets_words_between_batches_only(monkeypatch):
    batches = [["the first words here", "the second words"], ["the third, new ones"], ["the first of all words"], ["the", "ΣΑΣ", None, ""]]
    monkeypatch.setattr(packing, "CACHED_PARTS", 3)
    small = packing.Encoder(packing.tokenizer_path())
    assert [encoded(small, batch) for batch in batches] == [plainly_encoded(small, batch) for batch in batches]
    assert len(small.keys) < 9
    assert encoded(small, []) == []


def test_encoder_gives_the_tokenizers_ids():
    encoder = packing.Encoder(packing.tokenizer_path())
    rng = random.Random(9)
    letters = [chr(k) for k in range(0x250)] + list("ΣςσάЖж中文あ가ｆﬁ\u0301\u0308\u200b\u2028\u3000\u0130\u1e9e\u212a\u212b\U0001f600'sdt ")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(12))) for _ in range(6000)]
    texts += ["".join(rng.choice("'strevmld !?<|>ab1 ") for _ in range(rng.randrange(16))) for _ in range(3000)]
    texts += ["x<|endoftext|>y <|EndOfText|> <|startoftext|>", "A\u0301 \u0301 e\u0308", "\u1100\u1161 \u0181\u0189", "x" * 20_000]
    assert encoded(encoder, texts) == plainly_encoded(encoder, texts)


def test_toxicity_keeps_clashing_columns_and_survives_uninformative_texts(spark):
    df = docs(spark, ["same words"] * 8).withColumn("rejected", F.lit("own")).withColumn("p_toxic", F.lit(3))
    labels = spark.createDataFrame([(k, k % 2, k // 2 % 2) for k in range(8)], "doc_id long, quality int, toxic int")
    kept = toxicity.without_toxic(df, labels)
    assert kept.columns == df.columns and {r["rejected"] for r in kept.collect()} <= {"own"}
    assert toxicity.judged(df, labels).where("p_toxic is null or isnan(p_toxic)").count() == 0
    w = toxicity.fit_logistic([np.array([], np.int64)] * 4, np.zeros((4, 0)), np.array([0.0, 1.0, 0.0, 1.0]))
    assert np.isfinite(w).all()


def test_toxicity_is_sent_each_column_once_and_hands_back_small_batches(spark, monkeypatch):
    df = spark.createDataFrame([(k, f"kind{k % 2} " + "word " * 50, k, k) for k in range(40)], "doc_id long, TEXT string, `a.b` int, `p_toxic` long")
    labels = spark.createDataFrame([(k, k % 2, int(k % 8 == 0)) for k in range(40)], "doc_id long, quality int, toxic int")
    sent, judged = [], toxicity.judged
    monkeypatch.setattr(toxicity, "judged", lambda docs, labels: judged(sent.append(docs.schema) or docs, labels))
    monkeypatch.setattr(toxicity, "SCORED_BYTES", 600)
    kept = toxicity.without_toxic(df, labels)
    assert sent[0].simpleString().count("string") == 1 and kept.columns == df.columns
    rows = sorted(map(tuple, kept.collect()))
    assert rows and set(rows) <= set(map(tuple, df.collect())) and len(set(rows)) == len(rows)
    assert sorted(map(tuple, toxicity.without_toxic(df, labels.limit(0)).collect())) == sorted(map(tuple, df.collect()))


def thue_morse(length, letters):
    """Two words of one length and the same letters whose polynomial hashes agree modulo powers of two."""
    bits = [bin(k).count("1") % 2 for k in range(length)]
    return "".join(letters[b] for b in bits), "".join(letters[1 - b] for b in bits)


STRUCTURED = [pair for n in range(8, 15) for pair in (thue_morse(1 << n, "ab"), thue_morse(1 << n, "xq"))]


def test_structured_words_have_hashes_of_their_own():
    words = [w for pair in STRUCTURED for w in pair] + [w for n in range(1, 7) for w in thue_morse(1 << n, "ab")]
    words += ["".join(x) for x in itertools.product("ab", repeat=12)] + ["\x00" * k for k in range(1, 80)] + [chr(97 + k) * j for k in range(26) for j in (7, 8, 9, 16, 17, 64, 65)]
    hashes, _ = hashing.word_hashes(pa.array(words, pa.string()))
    assert len(set(hashes.tolist())) == len(set(words))
    again, _ = hashing.word_hashes(pa.array([" ".join(words[:50]), "A" + words[0][1:].upper()], pa.string()))
    assert again[:50].tolist() == hashes[:50].tolist() and again[50] == hashing.word_hashes(pa.array(["a" + words[0][1:]]))[0][0]


def test_structured_words_stay_apart_in_scoring_links_and_ids(spark):
    rows = [(k, word) for k, word in enumerate(w for pair in STRUCTURED for w in pair)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    linked = jaccard.join_documents(df).collect()
    assert all(r["component_id"] == r["doc_id"] and r["n_links"] == 0 for r in linked)
    scores = {r["doc_id"]: r for r in ngram.scored_documents(df).collect()}
    assert all(r["n_known"] == (1 if r["held_out"] else 2) for r in scores.values())
    encoder = packing.Encoder(packing.tokenizer_path())
    texts = [w for _, w in rows[:12]]
    assert encoded(encoder, texts) == plainly_encoded(encoder, texts)


def test_encoder_tells_parts_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(packing, "hashed", lambda data, starts, stops: (stops - starts).astype(np.uint64) % np.uint64(3))
    encoder = packing.Encoder(packing.tokenizer_path())
    for texts in (["the cat sat on the mat", "a dog, a cat 12", None], ["the dog sat", "The CAT it's naïve 中文字 the"], ["cat " * 50]):
        assert encoded(encoder, texts) == plainly_encoded(encoder, texts)
