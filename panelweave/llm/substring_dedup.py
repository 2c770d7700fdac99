"""Removal of long repeated substrings with suffix arrays built by linear grouping.

1. Every window of ``length`` bytes chooses the smallest hashed KMER bytes in it (the leftmost, if equal); neighbours
   that choose the same place form a segment. Equal windows choose alike, so all places of a window meet under one
   key, and text is split into segments without loss.
2. Segments (key, content hash, place; packed arrays) are counted where they are read, HELD at a time: of those with
   equal content one goes on, with a count of two, and the stretches of all of them go to their documents, merged. So
   what many documents share reaches the task of its key once for each HELD segments, not once for each place.
3. They are dealt by ranges of the key. Segments of equal content are one string with a count: a count of two makes all
   their windows repeated, as equal strings have equal suffixes. Keys with different contents keep one representative of
   each.
4. Only for those the bytes are fetched. Segments of a key are aligned at the chosen place and cut where two of them
   begin to differ, so each is a short string over blocks; one suffix array per batch of keys orders all their
   suffixes by grouping construction, and the longest common prefix with a neighbour, in bytes, tells which windows
   occur twice.
5. Intervals are merged per document and cut out.

A key with more than HOT different contents is split by window: each window's hash goes to its own range and is
counted, so no task gets an unbounded group. Documents longer than UNIT bytes are taken in overlapping units.
Contents are told apart within their key by 64-bit hashes, windows likewise; documents are numbered.

Nulls: a null text is empty; a null doc_id is an id like any other. Repeated rows are documents of their own and copies of
each other. An empty table gives no rows. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._grouping import common_prefixes, grouping_suffix_array
from ._shared import documents, materialise
from ._words import mix, slices

LENGTH, KMER, HOT, UNIT, RANGE_BYTES, SEARCH_RANGES, BATCH_SYMBOLS, MOST_TASKS, HELD = 200, 64, 8000, 8 << 20, 16 << 20, 8, 60000, 10000, 1 << 19
_PLACE_BITS = np.uint64(24)
_FACTOR = 0x9E3779B97F4A7C15


def _kmer_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive bytes, by doubling (k a power of two)."""
    h, m, factor = mix(np.arange(1, 257, dtype=np.uint64))[data], 1, _FACTOR
    while m < k:
        h = h[:-m] * np.uint64(factor) + h[m:]
        factor = factor * factor % (1 << 64)
        m *= 2
    return mix(h)


def _runs(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Bounds of runs of neighbours that together have at most ``most`` bytes (a larger one is a run of its own)."""
    edges, held = [0], 0
    for i, n in enumerate(sizes):
        if held and held + n > most:
            edges.append(i)
            held = 0
        held += n
    return list(zip(edges, [*edges[1:], len(sizes)], strict=True))


def segments(units: list[bytes], length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, ...]:
    """(unit, key, place of the first window, offset of the key's place in it, number of windows) of every segment.
    Units are joined only as far as a place in them fits into _PLACE_BITS."""
    parts = []
    for a, b in _runs([len(u) for u in units], 1 << int(_PLACE_BITS)):
        unit, *rest = _segments(units[a:b], length, k)
        parts.append((unit + a, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _segments(units: list[bytes], length: int, k: int) -> tuple[np.ndarray, ...]:
    data = np.frombuffer(b"".join(units), np.uint8)
    sizes = np.array([len(u) for u in units], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))
    if len(data) < length:
        return tuple(np.empty(0, t) for t in (np.int64, np.uint64, np.int64, np.int64, np.int64))
    h = _kmer_hashes(data, k)
    if len(h) > 1 << int(_PLACE_BITS):
        raise ValueError(f"a place among {len(h)} does not fit into {_PLACE_BITS} bits")
    mask = (np.uint64(1) << _PLACE_BITS) - np.uint64(1)
    v, w, span = (h & ~mask) | np.arange(len(h), dtype=np.uint64), 1, length - k + 1
    while 2 * w <= span:
        v = np.minimum(v[:-w], v[w:])
        w *= 2
    if w < span:
        v = np.minimum(v[: w - span], v[span - w :])
    chosen = (v & mask).astype(np.int64)
    edge = np.zeros(len(chosen) + 1, np.int8)
    fit = sizes >= length
    np.add.at(edge, base[:-1][fit], 1)
    np.add.at(edge, base[:-1][fit] + sizes[fit] - length + 1, -1)
    valid = np.cumsum(edge[:-1], dtype=np.int8) > 0
    change = np.concatenate(([True], chosen[1:] != chosen[:-1]))
    begin = valid & (change | np.concatenate(([True], ~valid[:-1])))
    begin[base[:-1][fit]] = True
    start = np.flatnonzero(begin)
    stop = np.flatnonzero(valid & np.concatenate((begin[1:] | ~valid[1:], [True]))) + 1
    unit = np.searchsorted(base, start, "right") - 1
    return unit, h[chosen[start]], start - base[unit], chosen[start] - start, stop - start


def _units(texts: list[bytes], length: int, unit: int = UNIT) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Texts, long ones in overlapping units: (units, text of each, offset of each)."""
    units, doc, offset = [], [], []
    for d, t in enumerate(texts):
        for a in range(0, max(1, len(t) - length + 1), unit):
            units.append(t[a : a + unit + length - 1])
            doc.append(d)
            offset.append(a)
    return units, np.array(doc, np.int64), np.array(offset, np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return np.int64(len(arrays[0])).tobytes() + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _unpack(blob: bytes, *types: str) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for t in types:
        out.append(np.frombuffer(blob, t, n, at))
        at += n * np.dtype(t).itemsize
    return out


def _joined(blobs: list[bytes], *types: str) -> list[np.ndarray]:
    parts = [_unpack(b, *types) for b in blobs]
    return [np.concatenate(x) for x in zip(*parts, strict=True)] if parts else [np.empty(0, t) for t in types]


def _ranges(h: np.ndarray, n: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _bounds(grouped: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """The values of a sorted array and where each begins and ends."""
    values, begin = np.unique(grouped, return_index=True)
    edges = [*begin.tolist(), len(grouped)]
    return values.tolist(), list(zip(edges[:-1], edges[1:], strict=True))


def _by_range(of: np.ndarray, n: int, *arrays: np.ndarray) -> tuple[list[int], list[bytes]]:
    r = _ranges(of, n)
    order = np.argsort(r.astype(np.uint16) if n < 65536 else r, kind="stable")
    there, bounds = _bounds(r[order])
    arrays = [a[order] for a in arrays]
    return there, [_pack(*(a[i:j] for a in arrays)) for i, j in bounds]


#: Packed columns: of segments, of intervals, of requests for bytes, of windows of hot keys.
_SEGMENT = ("u8", "u8", "u8", "u4", "u2", "u2", "u1")  # key, content, document, place, offset, windows, count
_INTERVAL = ("u8", "u4", "u4")  # document, start, end
_REQUEST = ("u8", "u8", "u4", "u2", "u2", "u4", "u1")  # document, key, place, offset, windows, count, hot
_WINDOW = ("u8", "u8", "u4", "u4")  # window, document, place, count


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals."""
    o = np.argsort(start, kind="stable")
    start, end = start[o], np.maximum.accumulate(end[o]) if len(o) else end
    gap = np.concatenate(([True], start[1:] > end[:-1])) if len(o) else np.zeros(0, bool)
    first = np.flatnonzero(gap)
    return start[first], end[np.concatenate((first[1:] - 1, [len(start) - 1])).astype(np.int64)] if len(o) else end


def merged_in_documents(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of intervals of many documents: each document's are moved to a stretch of numbers of its own."""
    ids, k = np.unique(doc, return_inverse=True)
    base = k.astype(np.int64) << 33
    low, high = merged(base + start, base + end)
    return ids[low >> 33], (low & ((1 << 33) - 1)).astype("u4"), (high & ((1 << 33) - 1)).astype("u4")


def combined(key, content, doc, place, at, windows, length: int) -> tuple[list[np.ndarray], tuple[np.ndarray, ...]]:
    """One segment of each key and content with a count of one or two (more), and the merged stretches (document, start,
    end) of all segments that have an equal."""
    order = np.argsort(key ^ mix(content))  # equal ones meet; a collision in between only leaves them apart
    k, c = key[order], content[order]
    new = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))) if len(k) else np.zeros(0, bool)
    run = np.cumsum(new) - 1
    count = np.minimum(np.bincount(run), 2).astype("u1") if len(k) else np.empty(0, "u1")
    one, twice = order[new], order[count[run] > 1]
    spans = merged_in_documents(doc[twice], place[twice], place[twice] + windows[twice] + np.uint32(length - 1))
    return [*(a[one] for a in (key, content, doc, place, at, windows)), count], spans


def _scatter(docs: DataFrame, ranges: int, length: int, held: int) -> DataFrame:
    """docs: u, text. Packed segments (kind 0) by range of the key, intervals (kind 1) by range of the document."""

    def packed(parts: list[tuple]) -> pa.RecordBatch:
        one, spans = combined(*(np.concatenate(x) for x in zip(*parts, strict=True)), length)
        # Keys are minima of many hashes, so their own high bits are all alike.
        there, blobs = _by_range(mix(one[0]), ranges, *one)
        again, more = _by_range(mix(spans[0]), ranges, *spans)
        kinds = [0] * len(there) + [1] * len(again)
        return pa.RecordBatch.from_arrays([pa.array(there + again, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs + more, pa.binary())], ["range", "kind", "blob"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n = [], 0
        for batch, texts in slices(batches, most=2 << 20):
            ids = batch.column("u").to_numpy().view(np.uint64)
            units, doc, offset = _units(texts, length)
            unit, key, place, at, windows = segments(units, length)
            content, begin = np.empty(len(unit), np.uint64), place.tolist()
            for i, (q, a, x, w) in enumerate(zip(unit.tolist(), begin, at.tolist(), windows.tolist(), strict=True)):
                content[i] = xxhash.xxh3_64_intdigest(units[q][a : a + w - 1 + length], x)
            parts.append((key, content, ids[doc[unit]], (place + offset[unit]).astype("u4"), at.astype("u2"), windows.astype("u2")))
            n += len(unit)
            if n >= held:
                yield packed(parts)
                parts, n = [], 0
        if n:
            yield packed(parts)

    return docs.mapInArrow(work, "range int, kind int, blob binary")


def _compare(scattered: DataFrame, ranges: int, length: int, hot: int) -> DataFrame:
    """part, intervals, requests: packed, by range of the document. Intervals that come along are passed on."""

    def work(key, table):
        by_kind: tuple[list, list] = ([], [])
        for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
            by_kind[kind].append(blob)
        k, content, doc, place, at, windows, seen = _joined(by_kind[0], *_SEGMENT)
        order = np.argsort(k)
        same = k[order][1:] == k[order][:-1]
        twice = order[np.concatenate(([False], same)) | np.concatenate((same, [False]))] if len(k) else order
        k, content, doc, place, at, windows, seen = (a[twice] for a in (k, content, doc, place, at, windows, seen))
        order = np.lexsort((place, doc, content, k))
        k, content, doc, place, at, windows, seen = (a[order] for a in (k, content, doc, place, at, windows, seen))
        new_key = np.concatenate(([True], k[1:] != k[:-1])) if len(k) else np.zeros(0, bool)
        new = new_key | np.concatenate(([True], content[1:] != content[:-1])) if len(k) else new_key
        run = np.cumsum(new) - 1
        count = np.bincount(run, seen).astype(np.int64)[run] if len(k) else run
        group = np.cumsum(new_key) - 1
        kinds = np.bincount(group, new).astype(np.int64)[group] if len(k) else group
        full = (count >= 2) & (seen < 2)  # the others' stretches were sent by those who counted them
        rep = new & (kinds >= 2)
        out: dict[int, list] = {}
        rows = [(key[0].as_py(), _pack(*_joined(by_kind[1], *_INTERVAL)), None)] if by_kind[1] else []
        for column, chosen, arrays in (
            (0, full, (doc, place, (place + windows + np.uint32(length - 1)).astype("u4"))),
            (1, rep, (doc, k, place, at, windows, np.minimum(count, 2).astype("u4"), (kinds > hot).astype("u1"))),
        ):
            if chosen.any():
                # Row numbers begin with the partition: unmixed, all of them would fall into the first range.
                for p, b in zip(*_by_range(mix(doc[chosen]), ranges, *(a[chosen] for a in arrays)), strict=True):
                    out.setdefault(p, [None, None])[column] = b
        part, intervals, requests = zip(*rows, *((p, *v) for p, v in out.items()), strict=True) if rows or out else ((), (), ())
        return pa.table({"part": pa.array(part, pa.int32()), "intervals": pa.array(intervals, pa.binary()), "requests": pa.array(requests, pa.binary())})

    # By number of ranges, so that a task's share doesn't grow with the table.
    return scattered.repartition(min(ranges, MOST_TASKS), "range").groupBy("range").applyInArrow(work, "part int, intervals binary, requests binary")


def _per_document(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> dict[int, bytes]:
    """Merged packed intervals of each document."""
    o = np.argsort(doc, kind="stable")
    doc, start, end = doc[o], start[o], end[o]
    return {d: _pack(*(x.astype("u4") for x in merged(start[a:b], end[a:b]))) for d, (a, b) in zip(*_bounds(doc), strict=True)}


def _documents(compared: DataFrame, ranges: int) -> DataFrame:
    """u, intervals, requests."""

    def work(key, table):
        have = [table.column(c).drop_null().to_pylist() for c in ("intervals", "requests")]
        iv = _per_document(*_joined(have[0], *_INTERVAL))
        req = _joined(have[1], *_REQUEST)
        o = np.argsort(req[0], kind="stable")
        req = [a[o] for a in req]
        wanted = {d: _pack(*(a[i:j] for a in req)) for d, (i, j) in zip(*_bounds(req[0]), strict=True)}
        u = sorted({*iv, *wanted})
        return pa.table({"u": pa.array(np.array(u, np.uint64).view(np.int64)), "intervals": pa.array([iv.get(d) for d in u], pa.binary()), "requests": pa.array([wanted.get(d) for d in u], pa.binary())})

    return compared.repartition(min(ranges, MOST_TASKS), "part").groupBy("part").applyInArrow(work, "u long, intervals binary, requests binary")


def _fetch(asked: DataFrame, ranges: int, length: int) -> DataFrame:
    """asked: u, text, requests. Bytes by range of the key, windows of hot keys by range of their hash."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, most=2 << 20):
            rows, content, hot = [], [], []
            for text, blob in zip(texts, batch.column("requests").to_pylist(), strict=True):
                for r in zip(*(a.tolist() for a in _unpack(blob, *_REQUEST)), strict=True):
                    doc, _, place, _, windows, count, is_hot = r
                    if is_hot:
                        hot += [(xxhash.xxh3_64_intdigest(text[p : p + length]), doc, p, count) for p in range(place, place + windows)]
                    else:
                        rows.append(r)
                        content.append(text[place : place + windows - 1 + length])
            there, blobs, kinds = [], [], []
            if rows:
                cols = [np.array(c, t) for c, t in zip(zip(*rows, strict=True), _REQUEST, strict=True)]
                r = _ranges(mix(cols[1]), ranges)
                for p in np.unique(r).tolist():
                    at = np.flatnonzero(r == p)
                    there.append(p)
                    blobs.append(_pack(*(c[at] for c in cols)) + b"".join(content[i] for i in at.tolist()))
                    kinds.append(0)
            if hot:
                cols = [np.array(c, t) for c, t in zip(zip(*hot, strict=True), _WINDOW, strict=True)]
                for p, b in zip(*_by_range(cols[0], ranges, *cols), strict=True):
                    there.append(p)
                    blobs.append(b)
                    kinds.append(1)
            if there:
                yield pa.RecordBatch.from_arrays([pa.array(there, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], ["range", "kind", "blob"])

    return asked.mapInArrow(work, "range int, kind int, blob binary")


def _shared_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    lo, hi = 0, n
    while hi - lo > 1:
        mid = (lo + hi) >> 1
        if a[:mid] == b[:mid]:
            lo = mid
        else:
            hi = mid
    return lo


def _cuts(sides: list[bytes]) -> list[int]:
    """Where to cut aligned strings: any place where two of them begin to differ (or one ends inside the other) is that
    of two neighbours in sorted order. What follows a string's last cut is its own alone."""
    order = sorted(sides)
    return sorted({0, *(_shared_prefix(a, b) for a, b in zip(order, order[1:], strict=False))})


def _blocks(side: bytes, cuts: list[int]) -> list[tuple[int, int]]:
    own = [c for c in cuts if c < len(side)]
    if not own:
        return []
    return list(zip(own, [*own[1:], len(side)], strict=True))


class Strings:
    """Keys' segments as strings over blocks, gathered until there are enough for one suffix array."""

    def __init__(self, length: int):
        self.length, self.text, self.weight, self.spot, self.rows, self.names = length, [], [], [], [], 0

    def add(self, group: list[tuple[bytes, int, int]], tags: list) -> None:
        """group: (content, offset of the key's place, count) of each distinct segment of one key."""
        left = [c[:x][::-1] for c, x, _ in group]
        right = [c[x + KMER :] for c, x, _ in group]
        lcuts, rcuts = _cuts(left), _cuts(right)
        blocks: dict[tuple[int, bytes], int] = {}

        def name(k: int, content: bytes) -> int:
            return blocks.setdefault((k, content), self.names + len(blocks))

        for (c, x, count), l, r, tag in zip(group, left, right, tags, strict=True):
            first = len(self.text)
            lb = _blocks(l, lcuts)
            for a, b in reversed(lb):
                self.text.append(name(-1 - a, l[a:b]))
                self.weight.append(b - a)
            self.text.append(name(1 << 30, b""))
            self.weight.append(KMER)
            for a, b in _blocks(r, rcuts):
                self.text.append(name(a, r[a:b]))
                self.weight.append(b - a)
            self.rows.append((first, len(self.text), len(lb), count, tag))
            self.text.append(-1)  # a separator of its own, named below
            self.weight.append(0)
        self.names += len(blocks)

    def repeated(self) -> Iterator[tuple[object, int, int]]:
        """(tag, first byte, end byte) of repeated stretches in rows of count one."""
        if not self.text:
            return
        names = self.names
        text = []
        for s in self.text:
            if s < 0:
                s, names = names, names + 1
            text.append(s)
        sa = grouping_suffix_array(text)
        lcp = [*common_prefixes(text, sa), 0]
        longest = [0] * len(text)
        for k, i in enumerate(sa):
            longest[i] = max(lcp[k], lcp[k + 1])
        for first, _, n_left, count, tag in self.rows:
            if count > 1:
                continue
            at = 0
            for i in range(first, first + n_left + 1):
                w = self.weight[i]
                end = at + sum(self.weight[i : i + longest[i]])
                if end - at >= self.length:
                    last = min(at + w - 1, end - self.length)  # the last window that starts in this block
                    yield tag, at, last + self.length
                at += w
        self.__init__(self.length)


def _search(fetched: DataFrame, ranges: int, length: int) -> DataFrame:
    """u, intervals."""

    def work(key, table):
        kinds, blobs = table.column("kind").to_pylist(), table.column("blob").to_pylist()
        found: list[tuple[int, int, int]] = []
        rows, contents = [], []
        for kind, blob in zip(kinds, blobs, strict=True):
            if kind == 0:
                cols = _unpack(blob, *_REQUEST)
                at = 8 + len(cols[0]) * sum(np.dtype(t).itemsize for t in _REQUEST)
                for r in zip(*(c.tolist() for c in cols), strict=True):
                    size = r[4] - 1 + length
                    rows.append(r)
                    contents.append(blob[at : at + size])
                    at += size
        order = sorted(range(len(rows)), key=lambda i: rows[i][1])
        strings, i = Strings(length), 0
        while i < len(order):
            j = i
            while j < len(order) and rows[order[j]][1] == rows[order[i]][1]:
                j += 1
            own = order[i:j]
            strings.add([(contents[x], rows[x][3], rows[x][5]) for x in own], [(rows[x][0], rows[x][2]) for x in own])
            i = j
            if len(strings.text) >= BATCH_SYMBOLS or i == len(order):
                found += [(d, p + a, p + b) for (d, p), a, b in strings.repeated()]
        doc, start, end = (np.array(c, t) for c, t in zip(zip(*found, strict=True) if found else ((), (), ()), _INTERVAL, strict=True))
        w, d, p, c = _joined([b for k, b in zip(kinds, blobs, strict=True) if k == 1], *_WINDOW)
        if len(w):
            u, back = np.unique(w, return_inverse=True)
            twice = np.bincount(back, c)[back] >= 2
            doc, start, end = np.concatenate((doc, d[twice])), np.concatenate((start, p[twice])), np.concatenate((end, p[twice] + np.uint32(length)))
        per = _per_document(doc, start, end)
        return pa.table({"u": pa.array(np.array(list(per), np.uint64).view(np.int64)), "intervals": pa.array(list(per.values()), pa.binary())})

    # Few bytes, much work: by number, so that adaptive execution doesn't put many ranges into one task.
    return fetched.repartition(min(ranges, MOST_TASKS), "range").groupBy("range").applyInArrow(work, "u long, intervals binary")


def repeated_bytes(docs: DataFrame, length: int = LENGTH, hot: int = HOT, range_bytes: int = RANGE_BYTES, held: int = HELD) -> DataFrame:
    """u, intervals of documents with repeated windows. docs: u, text."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-int(total) // range_bytes))
    compared = materialise(_documents(_compare(_scatter(docs, ranges, length, held), ranges, length, hot), ranges), "repeats")
    wanted = compared.where(F.col("requests").isNotNull()).select("u", "requests")
    asked = docs.join(wanted, "u").select("u", "text", "requests")
    ranges *= SEARCH_RANGES  # the same bytes are more work here
    more = _search(_fetch(asked, ranges, length), ranges, length)
    known = compared.where(F.col("intervals").isNotNull()).select("u", "intervals")
    return known.unionByName(more).groupBy("u").agg(F.collect_list("intervals").alias("parts"))


def remove_repeats(docs: DataFrame, length: int = LENGTH, written: bool = False, **params) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes). Rows are numbered by their place, so ``docs`` is
    written first unless it is a ``written`` table."""
    marked = docs.select("doc_id", "text").withColumn("u", F.monotonically_increasing_id())
    if not written:
        marked = materialise(marked, "numbered")
    found = repeated_bytes(marked.select("u", "text"), length, **params)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            size, removed, spans, kept = [], [], [], []
            for text, parts in zip(texts, batch.column("parts").to_pylist(), strict=True):
                start, end = merged(*_joined(parts or [], "u4", "u4"))
                start, end = start.tolist(), end.tolist()
                left = [text[a:b] for a, b in zip([0, *end], [*start, len(text)], strict=True)]
                size.append(len(text))
                removed.append(sum(b - a for a, b in zip(start, end, strict=True)))
                spans.append(len(start))
                kept.append(b"".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, pa.int64()) for x in (size, removed, spans)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = marked.join(found, "u", "left").select("doc_id", "text", "parts")
    return joined.mapInArrow(work, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(documents(spark, sf_dir), written=True)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def _twice(name: str, before: str, step: int) -> str:
    """A stretch's hash from those of two stretches ``step`` apart."""
    return f"""{name} AS (SELECT r, pos, x, CASE WHEN lead(h, {step}) OVER w IS NOT NULL THEN hash(h, lead(h, {step}) OVER w) END AS h
  FROM {before} WINDOW w AS (PARTITION BY r ORDER BY pos)),"""


#: Hashes of 1, 2, 4 .. 128 bytes at each place, then of 200 (two of 128, 72 apart).
OP10_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(hex(encode(coalesce(text, ''))), '..') AS parts FROM documents),
h1 AS (SELECT r, pos, x, hash(x) AS h FROM (SELECT r, unnest(parts) AS x, generate_subscripts(parts, 1) AS pos FROM docs)),
{"".join(_twice(f"h{2 * n}", f"h{n}", n) for n in (1, 2, 4, 8, 16, 32, 64))}
{_twice("h200", "h128", 72)}
many AS (SELECT h FROM h200 WHERE h IS NOT NULL GROUP BY h HAVING count(*) > 1),
hot AS (SELECT r, pos, x, CASE WHEN many.h IS NULL THEN 0 ELSE 1 END AS hot FROM h200 LEFT JOIN many USING (h)),
covered AS (SELECT r, pos, x, max(hot) OVER (PARTITION BY r ORDER BY pos ROWS BETWEEN 199 PRECEDING AND CURRENT ROW) AS c FROM hot),
edges AS (SELECT r, pos, x, c, coalesce(lag(c) OVER (PARTITION BY r ORDER BY pos), 0) AS before FROM covered),
found AS (SELECT r, sum(c) AS n_removed, count(*) FILTER (c > before) AS n_spans, string_agg(x, '' ORDER BY pos) FILTER (c = 0) AS kept FROM edges GROUP BY r)
SELECT doc_id, len(parts)::bigint AS n_bytes, coalesce(n_removed, 0)::bigint AS n_removed, coalesce(n_spans, 0) AS n_spans,
       sha256(unhex(coalesce(kept, ''))) AS kept_sha256
FROM docs LEFT JOIN found USING (r)
"""
