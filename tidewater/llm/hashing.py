"""Hashes of words, for whole Arrow columns at once.

Words end at ASCII white space; A-Z is lower-cased. A word is read in lanes of 8 bytes, the last one filled up with zeros;
each lane goes into the hash by an invertible mixing step, after the word's length. Words of one length of at most 8 bytes
therefore never share a hash, and in longer ones no structure survives the steps between their lanes. Words of over
``LONGEST`` bytes are hashed one by one by xxh3, so no step runs over many lanes. Only lanes are made for a word, no Python
object.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

LANE, LONGEST = 8, 64
MIX = np.uint64(0x9E3779B97F4A7C15)
_FIRST, _SECOND = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: What of a lane belongs to a word with so many bytes left.
_KEPT = np.array([(1 << (8 * k)) - 1 for k in range(LANE)] + [(1 << 64) - 1], np.uint64)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's UTF-8 bytes and where each text begins and ends in them; null texts are empty."""
    texts = texts.fill_null("") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8), ends - ends[0]


def word_bounds(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every word, and how many words there are up to each of the texts' bounds."""
    word = np.zeros(len(data) + 2, bool)
    np.logical_not(_SPACE[data], out=word[1:-1])
    starts, stops = np.flatnonzero(word[1:-1] & ~word[:-2]), np.flatnonzero(word[1:-1] & ~word[2:]) + 1
    # Words of neighbouring texts touch where neither has white space there.
    inner = np.unique(ends[1:-1])
    inner = inner[(inner > 0) & (inner < len(data))]
    inner = inner[word[inner] & word[inner + 1]]
    if len(inner):
        starts = np.insert(starts, np.searchsorted(starts, inner), inner)
        stops = np.insert(stops, np.searchsorted(stops, inner), inner)
    return starts, stops, np.searchsorted(starts, ends)


def _mixed(x: np.ndarray) -> np.ndarray:
    """An invertible step after which every bit depends on every bit of x."""
    x = x + MIX
    x = (x ^ (x >> np.uint64(30))) * _FIRST
    x = (x ^ (x >> np.uint64(27))) * _SECOND
    return x ^ (x >> np.uint64(31))


def lower(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def _lanes(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, as a number."""
    padded = np.zeros(len(data) + LANE, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def hashed(data: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A hash of each word of these bytes."""
    lanes, sizes = _lanes(data), stops - starts
    out = _mixed(sizes.astype(np.uint64))
    short = np.flatnonzero(sizes <= LONGEST)
    for at in range(0, LONGEST, LANE):
        short = short[sizes[short] > at]
        if not len(short):
            break
        lane = lanes[starts[short] + at] & _KEPT[np.minimum(sizes[short] - at, LANE)]
        out[short] = _mixed(out[short] ^ lane)
    for k in np.flatnonzero(sizes > LONGEST).tolist():
        out[k] = xxhash.xxh3_64_intdigest(data[starts[k] : stops[k]])
    return out


def same_words(data: np.ndarray, starts: np.ndarray, stops: np.ndarray, others: np.ndarray, at: np.ndarray, to: np.ndarray) -> np.ndarray:
    """Whether each word of ``data`` has the bytes of the word at its place in ``others``."""
    lanes, other_lanes, sizes = _lanes(data), _lanes(others), stops - starts
    same = sizes == to - at
    left = np.flatnonzero(same & (sizes <= LONGEST))
    for k in range(0, LONGEST, LANE):
        left = left[sizes[left] > k]
        if not len(left):
            break
        same[left] &= ((lanes[starts[left] + k] ^ other_lanes[at[left] + k]) & _KEPT[np.minimum(sizes[left] - k, LANE)]) == 0
    for k in np.flatnonzero(same & (sizes > LONGEST)).tolist():
        same[k] = bool((data[starts[k] : stops[k]] == others[at[k] : to[k]]).all())
    return same


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in their order, and how many there are up to each of the texts' bounds."""
    data, ends = text_bytes(texts)
    starts, stops, bounds = word_bounds(data, ends)
    return hashed(lower(data), starts, stops), bounds
