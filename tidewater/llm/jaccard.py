"""N-gram Jaccard join by grouped prefixes.

A text's set holds its distinct word shingles (a text of fewer words is one shingle, one without words an empty set
that links with nothing). Two texts link when ``100 * intersection >= percent * union``. Sets are put in one global
order, rarest first; linked sets share a member of their first ``n - ceil(percent * n / 100) + 1``.

1. Equal sets become a class, and classes with equal prefix and size become one group.
2. Groups that share a prefix member are paired if their sizes allow a link, unless the member's bucket is large.
3. The sets of groups in large buckets are cut, per band of sizes, into more parts than linked sets of the band can
   differ in members, so linked sets agree on a part whole. Sets are paired that do, unless the part's bucket is large.
4. Pairs are expanded to classes. Parity bitmaps rule out pairs that are too far apart, without false dismissals;
   the sets of the others are fetched once and verified exactly.
5. Large buckets of parts are joined to clusters of sets that agree; each cluster is cut into blocks of bounded size,
   and every two blocks are compared in a task of their own. Only counts and a spanning forest leave such a task.

The order needs no exact counts, any order would be right: it uses the heaviest of a fixed number of cells of shingles
and words, found from counts over all texts. Shingles are 64-bit hashes. Null texts are empty. Rows of one id count as
one document with each of their texts; every row without an id is a document of its own. Repeated rows are kept.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components
from .hashing import MIX, word_hashes
from .store import free_name, quoted, released, sliced, small_batches, written

SHINGLE_WORDS = 4
PERCENT = 85
#: Cells that shingles and words are counted in by hash; the heaviest ones settle the order.
CELL_BITS = 22
HEAVIEST = 65_536
LOCAL_LEAST = 8
HOT_COUNT = 256
BUCKET = 16
BLOCK_ROWS = 256
BLOCK_BYTES = 8 << 20
COUNT_FLUSH = 2_000_000
SLICE_BYTES = 4 << 20
FLAT_COLUMNS = 8192
FILTER_BITS = 1 << 22
LEAST_WIDTH = 256
#: Bits of a part's key that hold its band, sizes up to which bands go, and the share of sets that may have too many empty parts.
BAND_BITS = 12
LARGEST = 1 << 40
EMPTY_SHARE = 1e-3
SPARE = 8


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """One hash for every ``width`` words in a row."""
    out = np.full(max(0, len(words) - width + 1), width, np.uint64)
    for k in range(width):
        out = (out ^ words[k : len(out) + k]) * MIX
        out ^= out >> np.uint64(29)
    return out


def shingled(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray, Iterator[tuple[slice, np.ndarray]]]:
    """Hashes of all words and of all shingles, and for each text the slice of its words and the hashes of its shingles.

    A text of fewer words has a single shingle of all of them, one without words has none.
    """
    words, bounds = word_hashes(texts)
    shingles = shingle_hashes(words, width)

    def each() -> Iterator[tuple[slice, np.ndarray]]:
        for a, b in zip(bounds.tolist(), bounds[1:].tolist(), strict=False):
            yield slice(a, b), shingles[a : b - width + 1] if b - a >= width else shingle_hashes(words[a:b], b - a)[: b - a]

    return words, shingles, each()


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values."""
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))] if len(values) else values


def cells(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def needed(n: int, percent: int) -> int:
    return -(-percent * n // 100)


def prefix_length(n: int, percent: int) -> int:
    return n - needed(n, percent) + 1 if n else 0


def linked(inter: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    return 100 * inter >= percent * (a + b - inter)


def parity_bits(hashes: np.ndarray) -> bytes:
    """Parity of the members in each of at least as many cells as there are members; halves fold onto each other."""
    width = max(LEAST_WIDTH, 1 << max(0, len(hashes) - 1).bit_length())
    return np.packbits((np.bincount((hashes % np.uint64(width)).astype(np.int64), minlength=width) & 1).astype(np.uint8)).tobytes()


def folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Parities (as packed bytes) brought to a smaller number of cells."""
    return np.bitwise_xor.reduce(bits.reshape(-1, width // 8), axis=0)


def may_link(apart: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of sizes a and b can link whose parities differ in ``apart`` cells: each takes a member of one set alone."""
    return apart * (100 + percent) <= (100 - percent) * (a + b)


# ---- the order


def _local_counts(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = [[], []]

        def flush() -> pa.RecordBatch:
            columns: list[list[np.ndarray]] = [[], [], []]
            for shingle, hashes in enumerate(held):
                counts = np.bincount(cells(np.concatenate(hashes)), minlength=1 << CELL_BITS)
                kept = np.flatnonzero(counts >= LOCAL_LEAST)
                for column, values in zip(columns, (np.full(len(kept), bool(shingle)), kept, counts[kept]), strict=True):
                    column.append(values)
                hashes.clear()
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], ["shingle", "cell", "n"])

        for batch in sliced(batches, "text", SLICE_BYTES):
            words, shingles, _ = shingled(batch["text"], width)
            held[0].append(words)
            held[1].append(shingles)
            if sum(map(len, held[0])) > COUNT_FLUSH:
                yield flush()
        if held[0]:
            yield flush()

    return count


class Order:
    """Levels of the heaviest cells of words and of shingles, 0 for all others; small logarithms of counts."""

    SHINGLE_STEPS = 8

    def __init__(self, rows: list) -> None:
        self.levels = []
        for shingle, steps in ((False, 1), (True, self.SHINGLE_STEPS)):
            own = [(r["cell"], r["n"]) for r in rows if r["shingle"] == shingle]
            table = np.zeros(1 << CELL_BITS, np.uint8)
            if own:
                at, counts = np.array(own, np.int64).T
                table[at] = self.level(counts, steps)
            self.levels.append(table)

    @staticmethod
    def level(counts: np.ndarray | int, steps: int) -> np.ndarray:
        return np.minimum(255, np.floor(steps * np.log2(1.0 + counts))).astype(np.uint8)

    def keys(self, words: np.ndarray, shingles: np.ndarray, width: int) -> np.ndarray:
        """The shingles' places in the order: level of the shingle, sum of its words' levels, the rest from its hash."""
        level = self.levels[0][cells(words)].astype(np.uint64)
        common = np.zeros(len(shingles), np.uint64)
        for k in range(width):
            common += level[k : len(shingles) + k]
        heavy = self.levels[1][cells(shingles)].astype(np.uint64)
        return heavy << np.uint64(56) | np.minimum(common, np.uint64(255)) << np.uint64(48) | shingles >> np.uint64(16)


def order_of(docs: DataFrame, width: int) -> Order:
    counts = docs.select("text").mapInArrow(_local_counts(width), "shingle boolean, cell long, n long")
    summed = written(counts.groupBy("shingle", "cell").agg(F.sum("n").alias("n")), "jaccard-counts")
    heaviest = [summed.where(kind).orderBy(F.desc("n"), "cell").limit(HEAVIEST) for kind in (F.col("shingle"), ~F.col("shingle"))]
    return Order(heaviest[0].unionByName(heaviest[1]).collect())


# ---- sets


def sketches(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, n, digest of the set, gid of prefix and size, the prefix, how many of its last members are hot, parities."""
    order = docs.sparkSession.sparkContext.broadcast(order_of(docs, width))
    hottest = np.uint64(Order.level(HOT_COUNT, Order.SHINGLE_STEPS)) << np.uint64(56)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            rows: list[tuple] = []
            words, shingles, each = shingled(batch["text"], width)
            keys = order.value.keys(words, shingles, width)
            for place, own in each:
                members = distinct(own)
                n, count = len(members), place.stop - place.start
                own_keys = keys[place.start : place.stop - width + 1] if count >= width else order.value.keys(words[place], own, count)
                prefix = distinct(own_keys)[: prefix_length(n, percent)]
                hot = len(prefix) - int(np.searchsorted(prefix, hottest))
                gid = xxhash.xxh64_intdigest(prefix.tobytes(), n) - (1 << 63)
                rows.append((n, xxhash.xxh128_digest(members.tobytes()), gid, prefix.view(np.int64), hot, parity_bits(members)))
            n, digest, gid, prefix, hot, bits = zip(*rows, strict=True) if rows else ((),) * 6
            ends = pa.array(np.concatenate(([0], np.cumsum([len(p) for p in prefix]))).astype(np.int32))
            prefixes = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *prefix])))
            arrays = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(gid, pa.int64()), prefixes, pa.array(hot, pa.int32()), pa.array(bits, pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n", "digest", "gid", "prefix", "hot", "bits"])

    schema = "doc_id long, n long, digest binary, gid long, prefix array<long>, hot int, bits binary"
    return docs.select("doc_id", "text").mapInArrow(sketch, schema)


def _wanted_bits(wanted: DataFrame) -> np.ndarray:
    """A bitmap of fixed size over hashes of the wanted ids; it only spares work where few are wanted."""
    cells = wanted.select(F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS)).alias("cell"))
    words = cells.groupBy(F.expr("shiftright(cell, 5)").alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(cell % 32 as int)))").alias("bits")).collect()
    bits = np.zeros(FILTER_BITS // 32, np.int64)
    bits[[r["word"] for r in words]] = [r["bits"] for r in words]
    return bits


def _asked(docs: DataFrame, wanted: DataFrame, width: int, rows: Callable[[pa.Array, list[np.ndarray]], pa.RecordBatch], schema: str) -> DataFrame:
    """rows of the ids and the distinct members of the wanted classes' representatives; others may be among them."""
    bits = docs.sparkSession.sparkContext.broadcast(_wanted_bits(wanted))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", SLICE_BYTES):
            cell = batch["cell"].to_numpy()
            asked = batch.take(pa.array(np.flatnonzero(bits.value[cell >> 5] >> (cell & 31) & 1)))
            yield rows(asked["rep"], [distinct(own) for _, own in shingled(asked["text"], width)[2]])

    named = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("cell"), "text")
    return named.mapInArrow(take, schema)


def fetched_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """rep, members (sorted 64-bit hashes) of the wanted classes, from the texts of their representatives."""

    def rows(reps: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        members = [x.tobytes() for x in sets]
        digests = [xxhash.xxh128_digest(x) for x in members]
        return pa.RecordBatch.from_arrays([reps, pa.array(digests, pa.binary()), pa.array(members, pa.binary())], ["rep", "digest", "members"])

    found = _asked(docs, wanted, width, rows, "rep long, digest binary, members binary")
    return found.join(wanted, ["rep", "digest"]).dropDuplicates(["rep", "digest"]).select("rep", "members")


# ---- parts


@cache
def band_bounds(percent: int) -> list[int]:
    """The least size of each band, such that sizes that can link are in one band or in two neighbours."""
    bounds = [1]
    while bounds[-1] < LARGEST:
        bounds.append(max(bounds[-1] + 1, 100 * (bounds[-1] - 1) // percent + 1) if percent < 100 else LARGEST)
    return bounds


def band_of(n: Column, percent: int) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, band_bounds(percent))), lambda low: low <= n)) - 1


@cache
def parts_of(band: int, percent: int) -> tuple[int, int]:
    """(parts, empty ones that are too many) for pairs whose smaller set is in the band.

    Linked sets differ in few members, so they agree on all parts but as many; a set with fewer empty parts than the
    rest agrees on one that isn't empty. As many parts are added as keep sets with too many empty ones rare. Where low
    percentages leave no such number, all sets of the band have too many.
    """
    bounds = band_bounds(percent)
    least, most = bounds[band], bounds[band + 1] - 1
    apart = most * (100 - percent) // percent
    if not apart:
        return 1, 1
    tried = []
    for spare in range(1 + max(SPARE, apart // 4) if apart <= SPARE**2 else 0):
        parts = apart + 1 + spare
        empty = parts * math.exp(-least / parts)
        tried.append((1 - sum(math.exp(k * math.log(empty) - empty - math.lgamma(k + 1)) for k in range(spare + 1)), parts))
        if tried[-1][0] <= EMPTY_SHARE:
            break
    if not tried:  # many parts, whose empty ones are near normal
        parts = apart + 1
        for _ in range(8):
            empty = parts * math.exp(-least / parts)
            parts = min(2 * apart, apart + 1 + math.ceil(empty + 4 * math.sqrt(empty)))
        tried.append((EMPTY_SHARE if parts < 2 * apart else 1.0, parts))
    share, parts = min(tried)
    return (parts, parts - apart) if share < 0.2 else (1, 0)


def part_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the parts of these sets, in their own band and in the one before if smaller sets link there, and whose they are.

    Sets with too many empty parts have the band's key for such sets beside those of their parts.
    """
    size = np.array([len(x) for x in sets], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *sets])
    bounds = np.array(band_bounds(percent))
    own = np.searchsorted(bounds, size, "right") - 1
    lowest = np.searchsorted(bounds, -(-percent * size // 100), "right") - 1
    mixed = flat ^ (flat >> np.uint64(31))
    mixed *= MIX
    keys, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for band, here in ((own, size > 0), (own - 1, lowest < own)):
        at = np.flatnonzero(here)
        if not len(at):
            continue
        among = np.repeat(here, size)
        parts, many = np.array([parts_of(b, percent) for b in band[at].tolist()], np.int64).T
        starts = np.cumsum(parts) - parts
        of = np.repeat(np.arange(len(at)), size[at])
        slot = starts[of] + ((flat[among] >> np.uint64(32)) * parts[of].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        sums = np.zeros(int(parts.sum()), np.uint64)
        np.add.at(sums, slot, mixed[among])
        filled = np.bincount(slot, minlength=len(sums)) > 0
        owner = np.repeat(np.arange(len(at)), parts)
        sums ^= (np.arange(len(sums)) - starts[owner] + 1).astype(np.uint64) * MIX
        sparse = np.flatnonzero(parts - np.add.reduceat(filled.astype(np.int64), starts) >= many)
        sums, owner = np.concatenate((sums[filled], np.zeros(len(sparse), np.uint64))), np.concatenate((owner[filled], sparse))
        sums ^= sums >> np.uint64(32)
        sums *= MIX
        sums ^= sums >> np.uint64(29)
        keys.append((sums << np.uint64(BAND_BITS) | band[at][owner].astype(np.uint64)).view(np.int64))
        owners.append(at[owner])
    return np.concatenate(keys), np.concatenate(owners)


def parts(docs: DataFrame, wanted: DataFrame, width: int, percent: int) -> DataFrame:
    """key, rep of the parts of the wanted classes; other classes may be among them."""

    def rows(reps: pa.Array, sets: list[np.ndarray]) -> pa.RecordBatch:
        keys, owners = part_keys(sets, percent)
        return pa.RecordBatch.from_arrays([pa.array(keys), reps.take(pa.array(owners))], ["key", "rep"])

    return _asked(docs, wanted, width, rows, "key long, rep long")


# ---- group pairs


def _bucket_pairs(percent: int = 0) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows sorted by token -> pairs of groups (a, b), or (a, token) with large = true for buckets that are too large."""

    def emit(a: np.ndarray, b: np.ndarray, large: bool) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(np.full(len(a), large))], ["a", "b", "large"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 4
        spilling: int | None = None
        for batch in _with_end(batches):
            if batch is None:
                columns, last = held, True
            else:
                columns, last = [np.concatenate((h, batch[c].to_numpy())) for h, c in zip(held, ("token", "gid", "n", "m"), strict=True)], False
            token, gid, n, m = columns
            if not len(token):
                continue
            starts = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
            ends = np.append(starts[1:], len(token))
            open_ = None if last else int(starts[-1])
            weight = np.add.reduceat(m, starts)
            large = weight > BUCKET
            if spilling is not None and token[0] == spilling:
                large[0] = True
            if open_ is not None:  # the last bucket may go on
                if large[-1]:
                    spilling = int(token[-1])
                    held = [c[:0] for c in columns]
                else:
                    held = [c[open_:] for c in columns]
                    starts, ends, large = starts[:-1], ends[:-1], large[:-1]
            lengths = ends - starts
            if large.any():
                rows = np.repeat(large, lengths)
                rows = np.flatnonzero(rows) + int(starts[0])
                yield emit(gid[rows], token[rows], True)
            for size in np.unique(lengths[~large & (lengths > 1)]):
                at = starts[~large & (lengths == size)]
                i, j = np.triu_indices(size, 1)
                a, b = (at[:, None] + i).ravel(), (at[:, None] + j).ravel()
                low, high = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                fits = 100 * low >= percent * high
                a, b = gid[a[fits]], gid[b[fits]]
                yield emit(np.minimum(a, b), np.maximum(a, b), False)

    return pairs


def _with_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _near_pairs(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose parities allow a link."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y, a, b in zip(*(batch[c].to_pylist() for c in ("xb", "yb", "nx", "ny")), strict=True):
                width = 8 * min(len(x), len(y))
                apart = np.bitwise_count(folded(np.frombuffer(x, np.uint8), width) ^ folded(np.frombuffer(y, np.uint8), width)).sum()
                kept.append(bool(may_link(apart, a, b, percent)))
            yield batch.select(["a", "b", "ac", "bc"]).filter(pa.array(kept, pa.bool_()))

    return near


def _verified(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for x, y in zip(batch["xs"], batch["ys"], strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                inter = len(np.intersect1d(a, b, assume_unique=True))
                kept.append(100 * inter >= percent * (len(a) + len(b) - inter))
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    return verify


# ---- large buckets


def _sides(rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows of blocks i and j; the same twice where they are one block."""
    first = rows[rows["block"] == rows["i"]]
    return first, rows[rows["block"] == rows["j"]]


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """In how many bits every two of these packed rows differ."""
    out = np.zeros((len(x), len(y)), np.int32)
    for k in range(x.shape[1]):
        out += np.bitwise_count(x[:, k, None] ^ y[None, :, k])
    return out


def _block_hopes(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Members of two blocks that have a partner in the other one which their parities allow."""

    def hopes(rows: pd.DataFrame) -> pd.DataFrame:
        found: list[np.ndarray] = []
        sides = _sides(rows)
        widths = [side["bits"].map(len).to_numpy() * 8 for side in sides]
        for width in np.intersect1d(*(np.concatenate((w, w // 2)) for w in widths)):
            # Sizes that can link differ by less than two, so their widths are equal or neighbours; the smaller one is used.
            at = [np.flatnonzero((w == width) | (w == 2 * width)) for w in widths]
            if width < LEAST_WIDTH or not (len(at[0]) and len(at[1])):
                continue
            packed = [np.stack([folded(np.frombuffer(side["bits"].iloc[k], np.uint8), width) for k in own]).view(np.uint64) for side, own in zip(sides, at, strict=True)]
            n, home, reps = ([side[c].to_numpy()[own] for side, own in zip(sides, at, strict=True)] for c in ("n", "home", "rep"))
            small = [w[own] == width for w, own in zip(widths, at, strict=True)]
            hope = may_link(_apart(*packed), n[0][:, None], n[1][None, :], percent)
            hope &= (home[0][:, None] | home[1][None, :]) & (small[0][:, None] | small[1][None, :]) & (reps[0][:, None] != reps[1][None, :])
            found += [reps[0][hope.any(axis=1)], reps[1][hope.any(axis=0)]]
        out = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
        return pd.DataFrame({"cluster": np.full(len(out), rows["cluster"].iloc[0]), "rep": out})

    return hopes


def _in_blocks(members: DataFrame, size: str, label: str) -> DataFrame:
    """members (cluster, rep, ...) once for every pair of blocks i <= j of their cluster that their block is one of."""
    blocks = members.groupBy("cluster").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS), F.ceil(F.sum(F.expr(size)) / BLOCK_BYTES)).cast("int").alias("blocks"))
    blocked = members.join(written(blocks, label), "cluster").withColumn("block", F.pmod(F.hash("rep"), "blocks"))
    dealt = blocked.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumn("i", F.least("block", "k")).withColumn("j", F.greatest("block", "k")).drop("blocks", "k")


def _block_links(percent: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Links between two blocks of a cluster (within it, for one block twice): each row's forest root and link count."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        sides = [side.sort_values("rep", kind="stable") for side in _sides(rows)]
        one = rows["i"].iloc[0] == rows["j"].iloc[0]
        members = [[np.frombuffer(x, np.uint64) for x in side["members"]] for side in sides]
        sizes = [np.array([len(x) for x in own], np.int64) for own in members]
        # Only members of both sides count, in the order of their hashes, a stretch of them at a time.
        flat = [np.concatenate([np.zeros(0, np.uint64), *own]) for own in members]
        shared = np.intersect1d(*map(distinct, flat), assume_unique=True)
        owners, columns = [], []
        for values, own in zip(flat, sizes, strict=True):
            at = np.searchsorted(shared, values)
            kept = np.flatnonzero(shared[np.minimum(at, len(shared) - 1)] == values) if len(shared) else at[:0]
            by = kept[np.argsort(at[kept], kind="stable")]
            owners.append(np.repeat(np.arange(len(own)), own)[by])
            columns.append(at[by])
        inter = np.zeros((len(sizes[0]), len(sizes[1])), np.float32)
        for low in range(0, len(shared), FLAT_COLUMNS):
            marks = []
            for own, owner, column in zip(sizes, owners, columns, strict=True):
                a, b = np.searchsorted(column, (low, low + FLAT_COLUMNS))
                mark = np.zeros((len(own), FLAT_COLUMNS), np.float32)
                mark[owner[a:b], column[a:b] - low] = 1
                marks.append(mark)
            inter += marks[0] @ marks[1].T
        home, weights, reps = ([side[c].to_numpy() for side in sides] for c in ("home", "docs", "rep"))
        links = linked(inter.astype(np.int64), sizes[0][:, None], sizes[1][None, :], percent)
        links &= (home[0][:, None] | home[1][None, :]) & (reps[0][:, None] != reps[1][None, :])
        a, b = np.nonzero(links)
        nodes, found = reps[0], links @ weights[1]
        if not one:
            nodes, found, b = np.concatenate(reps), np.concatenate((found, links.T @ weights[0])), b + len(reps[0])
        a, b = np.concatenate((a, b)), np.concatenate((b, a))
        root = np.arange(len(nodes))
        while True:
            low = root.copy()
            np.minimum.at(low, a, root[b])
            low = low[low]
            if (low == root).all():
                break
            root = low
        return pd.DataFrame({"a": nodes, "b": nodes[root], "found": found})

    return link


def _clusters(large: DataFrame) -> DataFrame:
    """(cid, cluster, home): classes whose large buckets of parts hang together through classes in two of them.

    large: cid, key, home. A band's keys are its own, so a class is in two clusters at most: of its band, where it is at
    home, and of the one before; two classes meet where the smaller is at home.
    """
    nodes = written(large.select("cid", "home", F.col("key").alias("node")).distinct(), "jaccard-nodes")
    lowest = written(nodes.groupBy("cid", "home").agg(F.min("node").alias("low")), "jaccard-low")
    edges = nodes.join(lowest, ["cid", "home"]).select(F.col("low").alias("a"), F.col("node").alias("b")).distinct()
    joined = components(edges)
    named = lowest.join(joined.select(F.col("node").alias("low"), "component"), "low", "left").select("cid", F.coalesce("component", "low").alias("cluster"), "home")
    named = written(named, "jaccard-clusters")
    return named.join(named.where("home").select("cluster").distinct(), "cluster", "left_semi")


# ---- the join


def _keyed(docs: DataFrame, row: str = "_row") -> DataFrame:
    """docs with a number of its own for every row in a column ``row``; written, so that all readers see the same numbers."""
    return written(docs.withColumn(row, F.monotonically_increasing_id()), "jaccard-keyed")


def join_documents(docs: DataFrame, width: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id reachable by links, null if there is none), n_links (other documents it links with)."""
    with released(docs.sparkSession):
        return _linked(docs, width, percent)


def _linked(docs: DataFrame, width: int, percent: int) -> DataFrame:
    if docs.where("doc_id is null").isEmpty():
        return _joined(docs, width, percent)
    # Rows without an id need numbers to be told apart; rows of one id are then brought together again.
    keyed = _keyed(docs.select("doc_id", "text"))
    found = _joined(keyed.select(F.col("_row").alias("doc_id"), "text"), width, percent).withColumnRenamed("doc_id", "_row")
    found = written(found.join(keyed.select("_row", "doc_id"), "_row"), "jaccard-rows")
    own = found.where("doc_id is not null and n_shingles > 0").select("doc_id", F.col("component_id").alias("b")).distinct()
    lowest = own.groupBy("doc_id").agg(F.min("b").alias("a"))
    joined = components(own.join(lowest, "doc_id").select("a", "b"))
    found = found.join(joined.select(F.col("node").alias("component_id"), "component"), "component_id", "left").withColumn("_group", F.coalesce("component", "component_id"))
    found = written(found.select("_group", "doc_id", "n_shingles", "n_links"), "jaccard-grouped")
    least = written(found.groupBy("_group").agg(F.min("doc_id").alias("component_id")), "jaccard-least")
    return found.join(least, "_group").select("doc_id", "n_shingles", "component_id", "n_links")


def _joined(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """The join of documents that have an id."""
    drawn = written(sketches(docs, width, percent), "jaccard-sketches")
    classes = drawn.where("n > 0").groupBy("digest", "gid", "n").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("docs"), F.first("bits").alias("bits"))
    classes = written(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    alone = classes.where(F.col("rep").isNotNull())
    groups = written(alone.groupBy("gid", "n").agg(F.count(F.lit(1)).alias("m"), F.min("rep").alias("leader")), "jaccard-groups")
    led = drawn.where("n > 0").select("doc_id", "gid", "prefix", "hot").join(groups, "gid").where("doc_id = leader").select("gid", "n", "m", "prefix", "hot")

    # Members known to be hot are large buckets without being gathered; the others are met in the order of tokens.
    cold = led.select("gid", F.col("n").cast("int").alias("n"), F.col("m").cast("int").alias("m"), F.explode(F.expr("slice(prefix, 1, size(prefix) - hot)")).alias("token"))
    hot = led.where("hot > 0").select("gid", F.explode(F.expr("slice(prefix, size(prefix) - hot + 1, hot)")).alias("token"))
    sorted_ = cold.repartition("token").sortWithinPartitions("token", "n")
    met = written(sorted_.select("token", "gid", "n", "m").mapInArrow(_bucket_pairs(percent), "a long, b long, large boolean"), "jaccard-met")
    own = groups.where("m > 1")
    crowded = hot.select("gid").unionByName(met.where("large").select(F.col("a").alias("gid"))).unionByName(own.where(F.col("m") > BUCKET).select("gid")).distinct()
    crowded = written(alone.join(crowded, "gid", "left_semi").select("rep"), "jaccard-crowded")
    cut = parts(docs, crowded, width, percent).select(F.col("key").alias("token"), F.col("rep").alias("gid"))
    sorted_ = cut.repartition("token").sortWithinPartitions("token").withColumns({"n": F.lit(1), "m": F.lit(1)})
    agreeing = written(sorted_.mapInArrow(_bucket_pairs(), "a long, b long, large boolean"), "jaccard-agreeing")
    band = F.col("key").bitwiseAND((1 << BAND_BITS) - 1)
    large = agreeing.where("large").select(F.col("a").alias("rep"), F.col("b").alias("key")).join(alone.select("rep", "cid", "n"), "rep")
    large = large.withColumn("above", band_of(F.col("n"), percent) - band).where("above in (0, 1)").select("cid", "key", (F.col("above") == 0).alias("home"))
    clusters = _clusters(large)

    pairs = met.where("not large").select("a", "b").unionByName(own.where(F.col("m") <= BUCKET).select(F.col("gid").alias("a"), F.col("gid").alias("b"))).distinct()
    pairs = written(pairs, "jaccard-pairs")
    side = lambda key, to, x: alone.select(F.col(key).alias(to), F.col("rep").alias(x), F.col("cid").alias(f"{x}c"), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"{x}b"))
    expanded = pairs.join(side("gid", "a", "x"), "a").join(side("gid", "b", "y"), "b").where("x <> y and (a <> b or x < y)")
    agreed = agreeing.where("not large and a <> b").select("a", "b").distinct()
    expanded = expanded.unionByName(agreed.join(side("rep", "a", "x"), "a").join(side("rep", "b", "y"), "b"))
    fits = 100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")
    fitting = expanded.where(fits).select(F.col("x").alias("a"), F.col("y").alias("b"), F.col("xc").alias("ac"), F.col("yc").alias("bc"), "xb", "yb", "nx", "ny")
    near = fitting.mapInArrow(_near_pairs(percent), "a long, b long, ac long, bc long")
    turned = F.when(F.col("ac") < F.col("bc"), F.struct("a", "b", "ac", "bc")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("bc").alias("ac"), F.col("ac").alias("bc")))
    candidates = written(near.select(turned.alias("_p")).select("_p.*").distinct(), "jaccard-candidates")
    # What meets in a cluster is compared there.
    of = lambda x: clusters.select(F.col("cid").alias(x), "cluster", F.col("home").alias(f"home_{x}"))
    meeting = candidates.select("ac", "bc").join(of("ac"), "ac").join(of("bc"), ["bc", "cluster"]).where("home_ac or home_bc").select("ac", "bc").distinct()
    candidates = written(candidates.join(meeting, ["ac", "bc"], "left_anti").select("a", "b"), "jaccard-candidates")

    members = written(alone.join(clusters, "cid").select("cluster", "home", "rep", "docs", "n", "bits"), "jaccard-members")
    hoping = _in_blocks(members, "length(bits)", "jaccard-blocks").groupBy("cluster", "i", "j").applyInPandas(_block_hopes(percent), "cluster long, rep long")
    members = written(members.drop("bits").join(written(hoping.distinct(), "jaccard-hoping"), ["cluster", "rep"]), "jaccard-members")
    wanted = candidates.select(F.col("a").alias("rep")).union(candidates.select("b")).union(members.select("rep")).distinct()
    wanted = written(wanted.join(alone.select("rep", "digest"), "rep"), "jaccard-wanted")
    sets = written(fetched_sets(docs, wanted, width), "jaccard-sets")

    x, y = (sets.select(F.col("rep").alias(s), F.col("members").alias(f"{m}s")) for s, m in (("a", "x"), ("b", "y")))
    verified = written(candidates.join(x, "a").join(y, "b").select("a", "b", "xs", "ys").mapInArrow(_verified(percent), "a long, b long"), "jaccard-verified")

    dealt = _in_blocks(members, "8 * n", "jaccard-blocks")
    compared = dealt.join(sets, "rep").groupBy("cluster", "i", "j").applyInPandas(_block_links(percent), "a long, b long, found long")
    compared = written(compared, "jaccard-compared")

    joined = components(verified.unionByName(compared.select("a", "b")))
    weight = alone.select(F.col("rep").alias("b"), "docs")
    both = verified.unionByName(verified.select(F.col("b").alias("a"), F.col("a").alias("b")))
    found = both.join(weight, "b").select("a", F.col("docs").alias("found")).unionByName(compared.select("a", "found"))
    found = found.groupBy(F.col("a").alias("rep")).agg(F.sum("found").alias("found"))
    named = classes.join(joined.withColumnRenamed("node", "rep"), "rep", "left").join(found, "rep", "left")
    named = written(named.select("digest", F.coalesce("component", "rep").alias("component"), (F.coalesce("found", F.lit(0)) + F.col("docs") - 1).alias("links")), "jaccard-named")
    out = drawn.select("doc_id", "n", "digest").join(named, "digest", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One row of every component: of those with the smallest id (null last) the first; rows without words all stay.

    Rows keep all their columns, of whatever names; an empty table gives no rows. Of repeated rows one stays.
    """
    row = free_name(docs, "_row")
    keyed = _keyed(docs, row)
    with small_batches(docs.sparkSession), released(docs.sparkSession):
        found = _joined(keyed.select(F.col(row).alias("doc_id"), "text"), width, percent).where("n_shingles > 0")
    named = found.select(F.col("doc_id").alias(row), "component_id").join(keyed.select(row, "doc_id"), row)
    named = written(named, "jaccard-rows")
    stays = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", F.col(row).alias("row")))["row"].alias(row))
    dropped = named.select(row).join(written(stays.select(row), "jaccard-stays"), row, "left_anti")
    return keyed.join(written(dropped, "jaccard-dropped"), row, "left_anti").select(*quoted(docs))
