"""Whole Arrow batches of text as numpy arrays of words: no Python object for a word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE_BYTES = 4 << 20
_OFFSET, _PRIME = np.uint64(0xCBF29CE484222325), np.uint64(0x100000001B3)  # FNV-1a, 64 bits
_LONG = 48


def _table(separators: set[int]) -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    t[list(separators - set(range(65, 91)))] = 32
    return t


#: Words of letters, digits and everything beyond ASCII.
ALNUM = _table({*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)})
#: Words of everything but blanks.
BLANK = _table({0x20, *range(0x09, 0x0E)})


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[bytes]:
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with about ``most`` bytes of text (one row at least, always whole texts)."""
    for batch in batches:
        texts, begin, held = texts_of(batch, column), 0, 0
        for i, t in enumerate(texts):
            if held and held + len(t) > most:
                yield batch.slice(begin, i - begin), texts[begin:i]
                begin, held = i, 0
            held += len(t) + 1
        if begin < len(texts):
            yield batch.slice(begin), texts[begin:]


class Words:
    """Words of several texts. ``first[d]`` is the index of text d's first word; ``base[d]`` its first byte."""

    def __init__(self, texts: list[bytes], table: np.ndarray):
        joined = b" ".join(texts) + b" "
        self.bytes = table[np.frombuffer(joined, np.uint8)]
        step = np.diff((self.bytes != 32).view(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
        self.base = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts], dtype=np.int64)))
        self.first = np.searchsorted(self.starts, self.base)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        lens = self.ends - self.starts
        order = np.argsort(np.minimum(lens, _LONG + 1).astype(np.uint8), kind="stable")[::-1].astype(np.int32)
        at, length = self.starts[order], lens[order]
        h = np.full(len(at), _OFFSET, np.uint64)
        n_long = int(np.count_nonzero(length > _LONG))
        falling = -length[n_long:]
        for i in range(int(length[n_long]) if n_long < len(length) else 0):
            k = n_long + int(np.searchsorted(falling, -i, "left"))
            h[n_long:k] = (h[n_long:k] ^ self.bytes[at[n_long:k] + i]) * _PRIME
        for j in range(n_long):
            h[j] = xxhash.xxh3_64_intdigest(self.bytes[at[j] : at[j] + length[j]].tobytes())
        out = np.empty_like(h)
        out[order] = mix(h)
        return out

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def mix(h: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def hash_word(word: bytes) -> int:
    w = Words([word], BLANK)
    return int(w.hashes()[0])


class Vocabulary:
    """Ids of a bounded set of word hashes, looked up for whole arrays."""

    def __init__(self, hashes: np.ndarray):
        self.sorted = np.unique(np.asarray(hashes, np.uint64))
        bits = max(10, int(len(self.sorted) * 16).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        self.maybe = np.zeros(1 << bits, bool)
        self.maybe[(self.sorted & self.mask).astype(np.int64)] = True

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Index in ``sorted``, or -1."""
        out = np.full(len(hashes), -1, np.int64)
        if len(self.sorted):
            some = np.flatnonzero(self.maybe[(hashes & self.mask).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.sorted, hashes[some]), len(self.sorted) - 1)
            out[some] = np.where(self.sorted[at] == hashes[some], at, -1)
        return out


def runs(flags: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs of True that don't cross ``breaks`` (sorted indices where a run must begin anew)."""
    if not len(flags):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.zeros(len(flags) + 1, bool)
    edge[breaks[breaks <= len(flags)]] = True
    before = np.concatenate(([False], flags[:-1]))
    starts = np.flatnonzero(flags & (~before | edge[:-1]))
    after = np.concatenate((flags[1:], [False]))
    ends = np.flatnonzero(flags & (~after | edge[1:])) + 1
    return starts, ends
