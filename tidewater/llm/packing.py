"""Best-fit packing of token sequences by the linear grouping scheme.

Pieces of at most ``CAPACITY`` tokens go into as few sequences as found. Lengths over a limit are large: sorted
downwards they form groups of equal cardinality, each rounded up to its largest length. The few rounded
sizes are packed by configurations (column generation: dual prices of a linear programme, bounded knapsack for the best
new pattern), whole multiples of the patterns are kept and the rest is packed best-fit. Actual pieces then take the
places of rounded ones, and small pieces are put best-fit, longest first, into the tightest gap that holds them.

Everything but the assignment works on the histogram of lengths, at most ``CAPACITY`` rows however large the table: a
plan is a list of runs "pieces a to b of length l go to sequences c to d at offset o". Pieces are numbered per length
over hash buckets, so a hot length is not gathered anywhere.

Null texts are empty and hold the end token alone. Repeated rows are packed once each. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, compress, count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .hashing import hashed, lower, same_words, text_bytes, word_bounds
from .store import sliced, small_batches, written

CAPACITY = 4096
END_ID = 1
#: (groups, lengths up to which pieces are small): the settings tried; the plan with fewest sequences is kept.
SETTINGS = ((12, 512), (12, 1024), (24, 512), (24, 1024), (48, 1024), (48, 256))
#: Pieces of one length that a task sorts to number them.
BUCKET_PIECES = 20_000
TOKENIZER = "word_bpe_49k.json"
#: Distinct parts of words, and bytes of their ids, that a worker process keeps.
CACHED_PARTS, CACHED_BYTES = 400_000, 16 << 20
#: Bytes of text encoded at once (a longer text alone), and parts of words given to the tokenizer at once.
BATCH_BYTES, TOGETHER = 1 << 19, 1000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Kinds of bytes: white space, letters, digits, signs, all others. Latin letters of the first 256 characters are two bytes.
_SPACE, _LETTER, _DIGIT, _SIGN, _OTHER = range(5)
_KINDS = np.full(256, _OTHER, np.uint8)
_KINDS[33:127] = _SIGN
_KINDS[[9, 10, 11, 12, 13, 32]] = _SPACE
_KINDS[48:58] = _DIGIT
_KINDS[65:91] = _KINDS[97:123] = _LETTER
_LATIN_LEAD, _LATIN = 0xC3, np.isin(np.arange(256), [*range(0x80, 0xC0)]) & ~np.isin(np.arange(256), [0x97, 0xB7])
#: Signs that may open a contraction or a special token.
_WHOLE = (ord("'"), ord("<"))


def parts_of(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each part of the texts' words, whether it is plain, and how many there are up to the texts' bounds.

    A plain word holds printable ASCII and Latin letters of the first 256 characters alone, and no sign of ``_WHOLE``.
    It is cut as the tokenizer's pattern cuts it: into runs of letters, runs of signs and single digits. Any other word is one part.
    """
    starts, stops, _ = word_bounds(data, ends)
    kinds = _KINDS[data]
    lead = np.flatnonzero(data[:-1] == _LATIN_LEAD)
    lead = lead[_LATIN[data[lead + 1]]]
    kinds[lead] = kinds[lead + 1] = _LETTER
    odd = np.flatnonzero((kinds == _OTHER) | (data == _WHOLE[0]) | (data == _WHOLE[1]))
    plain = np.ones(len(starts), bool)
    plain[np.searchsorted(starts, odd, "right") - 1] = False
    opens = kinds != _SPACE
    opens[1:] &= (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
    opens[starts] = True
    firsts = np.flatnonzero(opens)
    word = np.cumsum(np.bincount(np.searchsorted(firsts, starts), minlength=len(firsts))) - 1
    kept = plain[word] | (firsts == starts[word])
    firsts, word = firsts[kept], word[kept]
    lasts = stops[word]
    same = word[1:] == word[:-1]
    lasts[:-1][same] = firsts[1:][same]
    return firsts, lasts, plain[word], np.searchsorted(firsts, ends)


class Encoder:
    """Ids of texts, as one array of little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and encodes what is between it piece by piece. So texts are cut into parts that it
    takes as whole pieces, the distinct parts of a batch (found by hashes, told apart by their bytes) are encoded once each, and ids are
    put in place by the parts' numbers. Encoded parts are kept for later batches and forgotten, where they have become too
    many, before a batch is looked up.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        """Keys are sorted; each has the place and number of its ids, and the place of its bytes in ``spelled``."""
        self.keys, self.firsts, self.lengths, self.ids = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.opens, self.closes, self.spelled = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def whole(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of these words, and the ids."""
        found = [x.ids for x in self.tokenizer.encode_batch(words, add_special_tokens=False)]
        return np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(chain.from_iterable(found), "<u4")

    def pieces(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same of parts each of which the tokenizer takes as one piece, all in one text."""
        got = self.tokenizer.encode(" ".join(parts), add_special_tokens=False)
        numbers = np.array(got.word_ids, np.int64)
        bounds = np.flatnonzero(np.concatenate(([True], numbers[1:] != numbers[:-1], [True])))
        return (np.diff(bounds), np.array(got.ids, "<u4")) if len(bounds) == len(parts) + 1 else self.whole(parts)

    def learn(self, keys: np.ndarray, words: list[str], plain: np.ndarray, spelled: list[bytes]) -> None:
        found, spelled = [], [*compress(spelled, plain), *compress(spelled, ~plain)]
        for kind, encode in ((True, self.pieces), (False, self.whole)):
            some = list(compress(words, plain == kind))
            found += [encode(some[k : k + TOGETHER]) for k in range(0, len(some), TOGETHER)]
        lengths, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        keys = np.concatenate((self.keys, keys[plain], keys[~plain]))
        firsts = np.concatenate((self.firsts, len(self.ids) + np.cumsum(lengths) - lengths))
        ends = len(self.spelled) + np.cumsum(np.fromiter(map(len, spelled), np.int64, len(spelled)))
        opens, closes = np.concatenate((self.opens, len(self.spelled) + np.concatenate(([0], ends[:-1] - len(self.spelled))))), np.concatenate((self.closes, ends))
        self.spelled = np.concatenate((self.spelled, np.frombuffer(b"".join(spelled), np.uint8)))
        by = np.argsort(keys, kind="stable")  # a merge of sorted runs
        self.keys, self.firsts, self.lengths, self.ids = keys[by], firsts[by], np.concatenate((self.lengths, lengths))[by], np.concatenate((self.ids, ids))
        self.opens, self.closes = opens[by], closes[by]

    def places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each key is or would be among those known, and whether it is there."""
        place = np.searchsorted(self.keys, keys)
        return place, (place < len(self.keys)) & (np.append(self.keys, np.uint64(0))[place] == keys)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end token, and the bounds of the texts in them."""
        data, ends = text_bytes(texts)
        firsts, lasts, plain, bounds = parts_of(data, ends)
        own = lower(data)
        as_is = _runs(firsts[~plain], (lasts - firsts)[~plain])
        own[as_is] = data[as_is]
        if len(self.keys) > CACHED_PARTS or self.ids.nbytes > CACHED_BYTES:
            self.forget()
        hashes = hashed(own, firsts, lasts)
        for seed in count(1):
            by = np.argsort(hashes)
            opens = np.flatnonzero(np.concatenate(([True], hashes[by][1:] != hashes[by][:-1]))) if len(by) else by
            keys, at, times = hashes[by[opens]], by[opens], np.diff(opens, append=len(by))
            place, known = self.places(keys)
            # A key is one part if all have the bytes of its first, and those of the part it is known for.
            one = np.repeat(at, times)
            same = same_words(own, firsts[by], lasts[by], own, firsts[one], lasts[one])
            met = np.ones(len(at), bool)
            met[known] = same_words(own, firsts[at[known]], lasts[at[known]], self.spelled, self.opens[place[known]], self.closes[place[known]])
            clash = by[~(same & np.repeat(met, times))]
            if not len(clash):
                break
            for k in clash.tolist():
                hashes[k] = xxhash.xxh3_64_intdigest(own[firsts[k] : lasts[k]], seed)
        new = ~known
        if new.any():
            spans = list(zip(firsts[at[new]].tolist(), lasts[at[new]].tolist(), strict=True))
            raw = memoryview(data)
            self.learn(keys[new], [str(raw[a:b], "utf-8") for a, b in spans], plain[at[new]], [own[a:b].tobytes() for a, b in spans])
            place, _ = self.places(keys)
        # The end token is a part after each text's last one.
        number = np.empty(len(by), np.int64)
        number[by] = np.repeat(place, times)
        order = np.insert(number, bounds[1:], len(self.keys))
        ids = np.append(self.ids, np.array([END_ID], "<u4"))
        sizes = np.append(self.lengths, 1)[order]
        closed = np.cumsum(sizes)
        return ids[_runs(np.append(self.firsts, len(self.ids))[order], sizes)], np.concatenate(([0], closed[bounds[1:] + np.arange(len(bounds) - 1)]))


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers of runs that start at and are as long as given, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One per worker process, so what it has learned serves its later tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every document's pieces."""
    path = path or tokenizer_path()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode = encoder(path)
        for batch in sliced(batches, "text", BATCH_BYTES):
            ids, bounds = encode(batch["text"])
            counts = -(-np.diff(bounds) // capacity)
            last = np.cumsum(counts)
            piece = np.arange(counts.sum()) - np.repeat(last - counts, counts)
            start = piece * capacity
            length = np.minimum(capacity, np.repeat(np.diff(bounds), counts) - start)
            data = memoryview(ids).cast("B")
            at = 4 * (np.repeat(bounds[:-1], counts) + start)
            crc = [zlib.crc32(data[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
            columns = [batch["doc_id"].take(pa.array(np.repeat(np.arange(len(counts)), counts))), piece.astype(np.int32), start, length, crc]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) if not isinstance(c, pa.Array) else c for c, k in zip(columns, _PIECE_KINDS, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


_PIECE_KINDS = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())


# ---- the plan, on the histogram of lengths


def _knapsack(values: np.ndarray, sizes: list[int], limits: list[int], capacity: int) -> list[int]:
    """Counts per size of the most valuable pattern within the capacity; numbers of copies are bounded by 64."""
    best = np.zeros(capacity + 1)
    choices = []
    for value, size, limit in zip(values, sizes, limits, strict=True):
        chosen = np.zeros(capacity + 1, np.int16)
        if value > 1e-12:
            base = best.copy()
            for n in range(1, min(limit, capacity // size, 64) + 1):
                shifted = base[: capacity + 1 - n * size] + n * value
                better = shifted > best[n * size :] + 1e-12
                best[n * size :][better] = shifted[better]
                chosen[n * size :][better] = n
        choices.append(chosen)
    pattern, room = [0] * len(sizes), int(np.argmax(best))
    for k in range(len(sizes) - 1, -1, -1):
        pattern[k] = int(choices[k][room])
        room -= pattern[k] * sizes[k]
    return pattern


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = 400) -> list[tuple[list[int], float]]:
    """Patterns and how often each is used by a fractional packing of counts[k] items of sizes[k]."""
    m = len(sizes)
    patterns = [[min(capacity // sizes[k], counts[k]) if j == k else 0 for j in range(m)] for k in range(m)]
    basis = np.array(patterns, float).T
    need = np.array(counts, float)
    for _ in range(rounds):
        uses = np.linalg.solve(basis, need)
        prices = np.linalg.solve(basis.T, np.ones(m))
        pattern = _knapsack(prices, sizes, counts, capacity)
        if prices @ pattern <= 1 + 1e-9:
            break
        column = np.linalg.solve(basis, np.array(pattern, float))
        up = column > 1e-9
        if not up.any():
            break
        ratios = np.full(m, np.inf)
        ratios[up] = np.maximum(uses[up], 0) / column[up]
        out = int(np.argmin(ratios))
        basis[:, out] = pattern
        patterns[out] = pattern
    return [(p, float(u)) for p, u in zip(patterns, np.linalg.solve(basis, need), strict=True) if u > 1e-9]


@dataclass
class Run:
    """Sequences first..first+count-1, all filled alike."""

    first: int
    count: int
    used: int


class Plan:
    """Placements (length, rank, count, sequence, offset) of pieces, given by length and rank among equals."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY):
        self.capacity = capacity
        self.left = dict(sorted(histogram.items(), reverse=True))
        self.rank = dict.fromkeys(histogram, 0)
        self.placed: list[tuple[int, int, int, int, int]] = []
        self.runs: dict[int, list[Run]] = {}
        self.sequences = 0

    def new(self, count: int) -> Run:
        run = Run(self.sequences, count, 0)
        self.sequences += count
        return run

    def put(self, run: Run, length: int) -> Run | None:
        """Put pieces of one length into the run's first sequences; what is left of the run, if pieces run out."""
        n = min(run.count, self.left[length])
        self.placed.append((length, self.rank[length], n, run.first, run.used))
        self.left[length] -= n
        self.rank[length] += n
        rest = Run(run.first + n, run.count - n, run.used) if n < run.count else None
        run.count, run.used = n, run.used + length
        return rest

    def shelve(self, run: Run) -> None:
        self.runs.setdefault(self.capacity - run.used, []).append(run)

    def best_fit(self, lengths: list[int]) -> None:
        """All pieces of these lengths, longest first, each into the tightest gap that holds it, else a new sequence."""
        gaps = sorted(g for g, runs in self.runs.items() if runs)
        for length in sorted(lengths, reverse=True):
            while self.left[length]:
                k = bisect_left(gaps, length)
                if k == len(gaps):
                    each = self.capacity // length
                    n = -(-self.left[length] // each)
                    run = self.new(n)
                else:
                    run = self.runs[gaps[k]].pop()
                    if not self.runs[gaps[k]]:
                        gaps.pop(k)
                rest = self.put(run, length)
                for part in (run, rest):
                    if part and part.count:
                        gap = self.capacity - part.used
                        self.shelve(part)
                        at = bisect_left(gaps, gap)
                        if at == len(gaps) or gaps[at] != gap:
                            gaps.insert(at, gap)


def linear_groups(lengths: dict[int, int], groups: int) -> list[list[tuple[int, int]]]:
    """Lengths from the largest down, dealt into groups of equal cardinality, as (length, count) parts."""
    total = sum(lengths.values())
    out: list[list[tuple[int, int]]] = []
    seen = 0
    for length in sorted(lengths, reverse=True):
        left = lengths[length]
        while left:
            group = seen * groups // total
            room = -(-(group + 1) * total // groups) - seen
            n = min(left, room)
            while len(out) <= group:
                out.append([])
            out[group].append((length, n))
            seen, left = seen + n, left - n
    return [g for g in out if g]


def plan(histogram: dict[int, int], capacity: int = CAPACITY, settings: tuple[tuple[int, int], ...] = SETTINGS) -> Plan:
    """The best of the settings; none can use fewer sequences than the tokens fill."""
    least = -(-sum(x * n for x, n in histogram.items()) // capacity)
    best: Plan | None = None
    for groups, small in settings:
        made = grouped_plan(histogram, capacity, small * capacity // CAPACITY, groups)
        if best is None or made.sequences < best.sequences:
            best = made
        if best.sequences == least:
            break
    return best


def grouped_plan(histogram: dict[int, int], capacity: int, small: int, groups: int) -> Plan:
    made = Plan(histogram, capacity)
    if full := histogram.get(capacity, 0):
        made.put(made.new(full), capacity)
    large = {x: n for x, n in histogram.items() if small < x < capacity}
    if large:
        # A few pieces need no rounding: as many groups as there are sizes.
        grouped = linear_groups(large, min(groups, sum(large.values())))
        merged: dict[int, list[tuple[int, int]]] = {}
        for group in grouped:
            merged.setdefault(group[0][0], []).extend(group)
        sizes = sorted(merged, reverse=True)
        pools = [[list(part) for part in merged[s]] for s in sizes]
        counts = [sum(n for _, n in pool) for pool in pools]
        for pattern, uses in sorted(configurations(sizes, counts, capacity), key=lambda x: -x[1]):
            times = int(uses + 1e-7)
            if times:
                _substitute(made, [made.new(times)], pattern, pools)
        made.best_fit([x for x in large if made.left[x]])
    made.best_fit([x for x in histogram if x <= small])
    return made


def _substitute(made: Plan, runs: list[Run], pattern: list[int], pools: list[list[list[int]]]) -> None:
    """Fill the sequences by the pattern with actual pieces of each group, longest first."""
    for k, copies in enumerate(pattern):
        for _ in range(copies):
            after: list[Run] = []
            for run in runs:
                todo: Run | None = run
                while todo:
                    pool = pools[k]
                    while pool and not pool[0][1]:
                        pool.pop(0)
                    if not pool:  # rounding of uses may ask for a piece more than there are
                        after.append(todo)
                        break
                    length, there = pool[0]
                    if there < todo.count:
                        rest: Run | None = Run(todo.first + there, todo.count - there, todo.used)
                        todo.count = there
                    else:
                        rest = None
                    more = made.put(todo, length)
                    assert more is None
                    pool[0][1] -= todo.count
                    after.append(todo)
                    todo = rest
            runs = after
    for run in runs:
        made.shelve(run)


# ---- the assignment


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id and offset for a written table of pieces.

    The plan has at most a few runs per length and pattern, so it goes to the tasks as arrays in their closure.
    """
    buckets = 1 + cut.count() // BUCKET_PIECES
    salted = cut.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    counted = written(salted.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n")), "pack-lengths")
    histogram = {int(r[0]): int(r[1]) for r in counted.groupBy("length").agg(F.sum("n")).collect()}  # at most CAPACITY rows
    made = plan(histogram, capacity) if histogram else Plan({}, capacity)
    runs = np.array(sorted(made.placed), np.int64).reshape(-1, 5)
    earlier = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = written(counted.select("length", "_bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_start")), "pack-starts")
    own = W.partitionBy("length", "_bucket").orderBy("doc_id", "piece", "ids_crc32", "start")
    ranked = salted.withColumn("_own", F.row_number().over(own) - 1).join(starts, ["length", "_bucket"])
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_start") + F.col("_own")).cast("long").alias("rank"))
    key = runs[:, 0] << 44 | runs[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, length = batch["rank"].to_numpy(), batch["length"].to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            columns = [batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            columns += [pa.array(runs[at, 3] + rank - runs[at, 1]), pa.array(runs[at, 4])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    with small_batches(docs.sparkSession):
        cut = written(pieces(docs, path), "pack-pieces")
    return assign(cut)
