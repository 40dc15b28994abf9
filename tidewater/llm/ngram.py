"""LM scoring with an Elias-Fano n-gram trie.

Texts are put into blocks of bounded size. Each block sends its distinct 1-, 2- and 3-grams with their training counts
to shards by hash, keys Elias-Fano coded; a shard adds up the counts of all blocks and returns the totals. A block then
builds the trie of its own n-grams that occur in training: levels of word numbers made monotone by the context they
stand in, monotone pointers between levels, both Elias-Fano coded, and quantised probabilities, all memory-mapped from
one file. Its texts are scored by searching each token among the successors of its context. Counts, vocabulary and
totals are those of all training texts, so the scores are those of one trie of everything, while no task holds more than
a block or a shard.

Smoothing: p(w | h) = (c(h w) + m p(w | h')) / (c(h) + m) with a prior weight m per level, down to
(c(w) + 0.5) / (N + 0.5 (V + 1)). A false hit of a hash of two or three words has a chance of at most 2**-19.

Null texts are empty (their end token alone). A null id counts as the empty text for the split. Repeated rows are
scored and counted once each.
"""

from __future__ import annotations

import math
import os
import tempfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .eliasfano import EliasFano
from .hashing import MIX, hashed, lower, word_bounds
from .store import released, written

FOLDS, HELD_OUT = 5, 1
BLOCK_BYTES = 4 << 20
SHARD_TOKENS = 5_000_000
PRIORS = {2: 500.0, 3: 20.0}
STEP = 1 / 4096
SLACK_BITS = 19

START, END = np.uint64(0xA5A5_0000_0000_0001), np.uint64(0x5A5A_0000_0000_0002)


# ---- blocks of texts


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def _blocked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first = TaskContext.get().partitionId() << 32
    ids: list[int | None] = []
    texts: list[bytes] = []
    made, size = 0, 0

    def flush() -> pa.RecordBatch:
        lengths = np.array([len(x) for x in texts], np.int64)
        data = b"".join(texts)
        packed = zstandard.ZstdCompressor(level=3).compress(data)
        bounds = word_bounds(np.frombuffer(data, np.uint8), np.concatenate(([0], np.cumsum(lengths))))[2]
        counts = (np.diff(bounds) + 1).tolist()
        trained = [n for n, x in zip(counts, ids, strict=True) if not held_out(x)]
        arrays = [[first + made], [ids], [lengths.tobytes()], [packed], [sum(counts)], [len(trained)], [sum(trained)]]
        kinds = (pa.int64(), pa.list_(pa.int64()), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a, k) for a, k in zip(arrays, kinds, strict=True)], BLOCK_NAMES)

    for batch in batches:
        for doc_id, text in zip(batch[0].to_pylist(), batch[1].to_pylist(), strict=True):
            ids.append(doc_id)
            texts.append((text or "").encode().lower())
            size += len(texts[-1]) + 8
            if size >= BLOCK_BYTES:
                yield flush()
                ids, texts = [], []
                made, size = made + 1, 0
    if ids:
        yield flush()


BLOCK_NAMES = ["block", "ids", "lengths", "texts", "tokens", "train_docs", "train_tokens"]
BLOCK_SCHEMA = "block long, ids array<long>, lengths binary, texts binary, tokens long, train_docs long, train_tokens long"


class Tokens:
    """A block's token hashes, in documents one after the other, each closed by its end token."""

    def __init__(self, lengths: bytes, texts: bytes):
        data = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts) if texts else b"", np.uint8)
        starts, stops, bounds = word_bounds(data, np.concatenate(([0], np.cumsum(np.frombuffer(lengths, np.int64)))))
        self.one = np.insert(hashed(lower(data), starts, stops), bounds[1:], END)
        self.counts = np.diff(bounds) + 1
        self.first = np.cumsum(self.counts) - self.counts
        self.before = self._shifted(self.one, 1)
        self.before2 = self._shifted(self.one, 2)

    def _shifted(self, values: np.ndarray, by: int) -> np.ndarray:
        out = np.concatenate((np.full(by, START), values[:-by]))[: len(values)]
        for k in range(by):
            out[self.first[self.counts > k] + k] = START
        return out

    def grams(self, order: int) -> np.ndarray:
        out = self.one ^ np.uint64(order)
        for context in (self.before, self.before2)[: order - 1]:
            out = (out * MIX) ^ (out >> np.uint64(31)) ^ context
        out = out * MIX
        return out ^ (out >> np.uint64(29))


@dataclass(frozen=True)
class Layout:
    """How n-gram hashes are cut: bits kept, and the leading ones that name the shard.

    Single tokens, whose counts are results by themselves, keep 63 bits; longer n-grams as many as tell them apart but
    for a chance of 2**-19.
    """

    long_bits: int
    shard_bits: int

    @classmethod
    def of(cls, tokens: int) -> Layout:
        shard_bits = max(0, math.ceil(math.log2(max(1, 2 * tokens / SHARD_TOKENS))))
        return cls(min(63, max(32, max(1, tokens).bit_length() + SLACK_BITS)), shard_bits)

    def bits(self, order: int) -> int:
        return 63 if order == 1 else self.long_bits

    def cut(self, hashes: np.ndarray, order: int) -> np.ndarray:
        return hashes >> np.uint64(64 - self.bits(order))


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each distinct value, in their order, and for every value the number of its distinct one."""
    by = np.argsort(values)
    starts = _starts(values[by])
    inverse = np.empty(len(values), np.int64)
    inverse[by] = np.repeat(np.arange(len(starts)), np.diff(starts, append=len(values)))
    return by[starts], inverse


def _narrow(values: np.ndarray) -> bytes:
    """Counts, nearly all of them small: their lowest bytes, then the next ones, as many as the largest needs, compressed."""
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    planes = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _wide(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:]), np.uint8).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : len(planes)] = planes.T
    return out.view("<u8").reshape(-1)


# ---- counts


def _sent(layout: Layout) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, ids, lengths, texts in zip(*(batch[c] for c in ("block", "ids", "lengths", "texts")), strict=True):
                tokens = Tokens(lengths.as_py(), texts.as_py())
                trains = np.repeat(np.array([not held_out(x) for x in ids.as_py()], np.uint64), tokens.counts)
                for order in (1, 2, 3):
                    # The lowest bit tells training tokens, so one sort gives both the keys and their counts.
                    marked = np.sort(layout.cut(tokens.grams(order), order) << np.uint64(1) | trains)
                    values = marked >> np.uint64(1)
                    starts = _starts(values)
                    counts = np.add.reduceat((marked & np.uint64(1)).astype(np.int64), starts)
                    values = values[starts]
                    # A row for every shard that the block has n-grams in, so there are never more rows than n-grams.
                    rest = np.uint64(layout.bits(order) - layout.shard_bits)
                    shards = values >> rest
                    firsts = _starts(shards)
                    keys, numbers = [], []
                    for a, b in zip(firsts.tolist(), np.append(firsts[1:], len(values)).tolist(), strict=True):
                        keys.append(EliasFano.of(values[a:b] - (shards[a] << rest), 1 << int(rest)).packed())
                        numbers.append(_narrow(counts[a:b]))
                    many = len(keys)
                    arrays = [pa.array([block.as_py()] * many), pa.array([order] * many, pa.int32()), pa.array(shards[firsts].astype(np.int32)), pa.array(keys, pa.binary()), pa.array(numbers, pa.binary())]
                    yield pa.RecordBatch.from_arrays(arrays, ["block", "level", "shard", "keys", "counts"])

    return send


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    """Totals for each block in the order it sent its keys; one more row (block null) counts the kinds seen in training."""
    keys = [EliasFano.unpacked(x).values() for x in rows["keys"]]
    lengths = np.cumsum([len(k) for k in keys])
    flat, counts = np.concatenate(keys), np.concatenate([_wide(x) for x in rows["counts"]])
    firsts, inverse = _distinct(flat)
    sums = np.bincount(inverse, counts, len(firsts)).astype(np.int64)
    parts = np.split(sums[inverse], lengths[:-1])
    level, shard = int(rows["level"].iloc[0]), int(rows["shard"].iloc[0])
    out = [(int(b), level, shard, _narrow(p), 0) for b, p in zip(rows["block"], parts, strict=True)]
    return pd.DataFrame([*out, (-1, level, shard, b"", int((sums > 0).sum()))], columns=["block", "level", "shard", "totals", "kinds"])


# ---- the trie


def _quantised(log10: np.ndarray) -> np.ndarray:
    return np.minimum(np.round(-log10 / STEP), 65535).astype(np.uint16)


class Trie:
    """Levels of an n-gram trie with quantised log10 probabilities and back-off weights (positive, in steps).

    Level 2 holds, for each word, the numbers of the words that follow it. Level 3 holds, for each pair, its next words
    relative to the context: as their places among the successors of the pair's second word. Each context's numbers
    start where those of the context before end, so a level is one monotone sequence.
    """

    def __init__(self, parts: list[np.ndarray]):
        self.words = int(parts[0][0])
        sequences = [EliasFano.from_arrays(*parts[1 + 3 * k : 4 + 3 * k]) for k in range(5)]
        self.level2, self.pointers2, self.level3, self.pointers3, self.bases3 = sequences
        self.p1, self.back1, self.p2, self.back2, self.p3 = parts[16:]

    @staticmethod
    def parts(words: int, pairs: tuple[np.ndarray, np.ndarray], triples: tuple[np.ndarray, np.ndarray], tables: list[np.ndarray]) -> list[np.ndarray]:
        """pairs: (word, next word) sorted; triples: (pair, pair of the last two words) sorted; tables: p1, back1, p2, back2, p3."""
        first, second = pairs
        starts = np.searchsorted(first, np.arange(words + 1))
        bases = np.concatenate(([0], np.cumsum(np.diff(starts)[second])))
        context, lower = triples
        sequences = [
            EliasFano.of(first * words + second, words * words),
            EliasFano.of(starts, len(first) + 1),
            EliasFano.of(bases[context] + lower - starts[second[context]], int(bases[-1]) + 1),
            EliasFano.of(np.searchsorted(context, np.arange(len(first) + 1)), len(context) + 1),
            EliasFano.of(bases, int(bases[-1]) + 1),
        ]
        return [np.array([words], np.int64), *(x for s in sequences for x in s.arrays()), *tables]

    def pairs(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Place of each pair of words on level 2, or -1."""
        return self.level2.find(v * self.words + w, self.pointers2.access(v + 1)) if self.level2.n else np.full(len(v), -1)

    def triples(self, context: np.ndarray, v: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """Place on level 3 of the word that ends the pair ``lower`` among the successors of the pair ``context``, or -1.

        v: the word that both pairs share.
        """
        out = np.full(len(context), -1, np.int64)
        known = np.flatnonzero((context >= 0) & (lower >= 0))
        if len(known) and self.level3.n:
            context, relative = context[known], lower[known] - self.pointers2.access(v[known])
            out[known] = self.level3.find(self.bases3.access(context) + relative, self.pointers3.access(context + 1))
        return out


def saved(parts: list[np.ndarray]) -> Trie:
    """The trie memory-mapped from a file that is gone as soon as nothing maps it."""
    with tempfile.NamedTemporaryFile(suffix=".trie", delete=False) as out:
        places = []
        for part in parts:
            out.write(b"\0" * (-out.tell() % 8))
            places.append((out.tell(), part.dtype, len(part)))
            out.write(np.ascontiguousarray(part).tobytes())
        out.write(b"\0" * 8)
    flat = np.asarray(np.memmap(out.name, np.uint8, "r"))
    os.unlink(out.name)
    return Trie([flat[at : at + kind.itemsize * n].view(kind) for at, kind, n in places])


@dataclass(frozen=True)
class Corpus:
    """What all training texts give: documents, tokens and distinct tokens."""

    docs: int
    tokens: int
    kinds: int

    def base(self, count: np.ndarray) -> np.ndarray:
        return np.log10((count + 0.5) / (self.tokens + 0.5 * (self.kinds + 1)))


def block_scores(tokens: Tokens, totals: dict[int, np.ndarray], layout: Layout, corpus: Corpus) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per token: count in training, base score and model score."""
    (_, w), (at2, in2), (at3, in3) = (_distinct(layout.cut(tokens.grams(order), order)) for order in (1, 2, 3))
    c1, c2, c3 = (totals[order] for order in (1, 2, 3))
    # Word numbers: the block's tokens in the order of their hashes, then the start of a document.
    start = len(c1)
    v = np.where(tokens.before == START, start, np.concatenate(([0], w[:-1])))
    words = start + 1
    count1 = np.append(c1, corpus.docs)
    p1 = 10 ** corpus.base(np.append(c1, 0))

    # Distinct pairs in the order of their words; the last one stands for the two starts of a document.
    by = np.argsort(v[at2] * words + w[at2])
    place = np.empty(len(by), np.int64)
    place[by] = np.arange(len(by))
    v2, w2, c2, in2 = np.append(v[at2[by]], start), np.append(w[at2[by]], start), np.append(c2[by], corpus.docs), place[in2]
    kept = np.flatnonzero(c2 > 0)
    pc = c2[kept].astype(float)
    prior = PRIORS[2]
    p2 = (pc + prior * p1[w2[kept]]) / (count1[v2[kept]] + prior)

    # A token's context is the pair that ended one token before.
    above = np.concatenate(([0], in2[:-1]))
    above[tokens.first] = len(c2) - 1
    by = np.argsort(above[at3] * len(c2) + in2[at3])
    place3 = np.empty(len(by), np.int64)
    place3[by] = np.arange(len(by))
    at3, c3, in3 = at3[by], c3[by], place3[in3]
    node = np.cumsum(c2 > 0) - 1
    seen = np.flatnonzero(c3 > 0)
    context, lower, tc = node[above[at3[seen]]], node[in2[at3[seen]]], c3[seen].astype(float)
    prior3 = PRIORS[3]
    p3 = (tc + prior3 * p2[lower]) / (pc[context] + prior3)

    tables = [_quantised(np.log10(x)) for x in (p1, prior / (count1 + prior), p2, prior3 / (pc + prior3), p3)]
    trie = saved(Trie.parts(words, (v2[kept], w2[kept]), (context, lower), tables))
    nodes = trie.pairs(v2, w2)
    p2 = np.where(nodes >= 0, trie.p2[nodes] if len(trie.p2) else 0, trie.back1[v2].astype(np.int64) + trie.p1[w2])
    context, lower = nodes[above[at3]], in2[at3]
    triples = trie.triples(context, v[at3], nodes[lower])
    backed = p2[lower] + np.where(context >= 0, trie.back2[context] if len(trie.back2) else 0, 0)
    own = np.where(triples >= 0, trie.p3[triples] if len(trie.p3) else 0, backed) * -STEP
    count = c1[w]
    return count, corpus.base(count), own[in3]


def _scored(layout: Layout, corpus: Corpus) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, lengths, texts, back in zip(*(batch[c] for c in ("ids", "lengths", "texts", "back")), strict=True):
                tokens = Tokens(lengths.as_py(), texts.as_py())
                parts = sorted((x["level"], x["shard"], x["totals"]) for x in back.as_py())
                totals = {order: np.concatenate([_wide(t) for level, _, t in parts if level == order]).astype(np.int64) for order in (1, 2, 3)}
                count, base, own = block_scores(tokens, totals, layout, corpus)
                add = lambda x, first=tokens.first: np.add.reduceat(x, first)
                ids = ids.as_py()
                arrays = [pa.array(ids, pa.int64()), pa.array([held_out(x) for x in ids]), pa.array(tokens.counts), pa.array(add((count > 0).astype(np.int64))), pa.array(np.full(len(ids), corpus.tokens)), pa.array(add(base)), pa.array(add(own))]
                yield pa.RecordBatch.from_arrays(arrays, SCORE_NAMES)

    return score


SCORE_NAMES = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
SCORE_SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scored_documents(docs: DataFrame) -> DataFrame:
    blocks = written(docs.select("doc_id", "text").mapInArrow(_blocked, BLOCK_SCHEMA), "ngram-blocks")
    sums = blocks.agg(F.sum("tokens"), F.sum("train_docs"), F.sum("train_tokens")).first()
    tokens, train_docs, train_tokens = (int(x or 0) for x in sums)
    layout = Layout.of(tokens)
    sent = blocks.select("block", "ids", "lengths", "texts").mapInArrow(_sent(layout), "block long, level int, shard int, keys binary, counts binary")
    # What the blocks sent is the most that lies on disk, and done with once the totals are written.
    with released(docs.sparkSession):
        totals = written(sent.groupBy("level", "shard").applyInPandas(_totals, "block long, level int, shard int, totals binary, kinds long"), "ngram-totals")
    kinds = int(totals.where("block < 0 and level = 1").agg(F.sum("kinds")).first()[0] or 0)
    back = totals.where("block >= 0").groupBy("block").agg(F.collect_list(F.struct("level", "shard", "totals")).alias("back"))
    joined = blocks.select("block", "ids", "lengths", "texts").join(back, "block").select("ids", "lengths", "texts", "back")
    return joined.mapInArrow(_scored(layout, Corpus(train_docs, train_tokens, kinds)), SCORE_SCHEMA)
