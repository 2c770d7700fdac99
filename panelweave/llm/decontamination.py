"""Benchmark decontamination with an FM-index per training shard.

A shard is a few megabytes of documents. Words that no benchmark phrase holds can't lie in an occurrence, so they
only separate: what is indexed are the runs of benchmark words (each pair of neighbours a pair of some phrase) that
are long enough for a phrase. The index is a suffix array by prefix doubling, its Burrows-Wheeler transform in a
wavelet tree (level-wise), and suffix positions sampled every SAMPLE-th place. All phrases search backwards at once;
occurrences are located by walking to the next sampled position and merged into removal spans.

Phrases are the windows of ``window`` consecutive words of an item, or the whole item if it has fewer.

The benchmark is taken in blocks of about BLOCK_CHARS characters. A block's phrases become arrays once, on the driver, and
are broadcast; one block usually holds all. With more, each is a pass of its own that writes the documents it hits, and
its broadcast is given up before the next begins; at the end a document's spans are merged.

Nulls: a null text has no words; an item without words has no phrase; a null item_id counts as the empty string.
Repeated documents are judged each, repeated items count once by item_id. Long texts are searched whole: a shard is one
text at least. Empty tables give no hits or no rows. Other columns come back inside _row, untouched.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._shared import documents, materialise, packed, unpacked
from ._words import ALNUM, Vocabulary, Words, runs, slices

WINDOW, SAMPLE, BLOCK_CHARS, SHARD_BYTES = 10, 8, 2 << 20, 8 << 20


class WaveletTree:
    """Level-wise wavelet tree over small integers: rank(c, i) = how often c stands before i."""

    def __init__(self, seq: np.ndarray, n_symbols: int):
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.levels = []
        for b in range(self.bits - 1, -1, -1):
            bit = (seq >> b) & 1
            ones = np.concatenate(([0], np.cumsum(bit, dtype=np.int64)))
            zeros = len(seq) - int(ones[-1])
            self.levels.append((ones, zeros))
            seq = np.concatenate((seq[bit == 0], seq[bit == 1]))

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(i), i
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            up = ((c >> b) & 1).astype(bool)
            lo1, hi1 = ones[lo], ones[hi]
            lo, hi = np.where(up, zeros + lo1, lo - lo1), np.where(up, zeros + hi1, hi - hi1)
        return hi - lo


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """By prefix doubling; a suffix that ends sooner is smaller."""
    n = len(seq)
    rank = np.unique(seq, return_inverse=True)[1].astype(np.int64) + 1
    k = 1
    while True:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:]
        key = rank * (n + 2) + second
        order = np.argsort(key, kind="stable")
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([1], (np.diff(key[order]) != 0).astype(np.int64))))
        rank = new
        if rank.max() == n or k >= n:
            return order
        k *= 2


class FMIndex:
    """Over symbols 0..n_symbols-1 (0 separates); inside, 0 is the one terminator and all others are one higher."""

    def __init__(self, seq: np.ndarray, n_symbols: int, sample: int = SAMPLE):
        seq, n_symbols = np.concatenate((seq + 1, [0])), n_symbols + 1
        sa = suffix_array(seq)
        self.n, bwt = len(seq), seq[sa - 1]
        self.tree, self.bwt = WaveletTree(bwt, n_symbols), bwt
        self.before = np.concatenate(([0], np.cumsum(np.bincount(seq, minlength=n_symbols))))
        marked = sa % sample == 0
        self.mark_rank, self.sampled = np.concatenate(([0], np.cumsum(marked))), sa[marked]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """phrases: one row each, all of one length. Suffix ranges [lo, hi)."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        for k in range(phrases.shape[1] - 1, -1, -1):
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            c = phrases[live, k] + 1
            lo[live], hi[live] = self.before[c] + self.tree.rank(c, lo[live]), self.before[c] + self.tree.rank(c, hi[live])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix-array rows."""
        out, steps, todo, at = np.empty(len(rows), np.int64), 0, np.arange(len(rows)), rows.copy()
        while len(todo):
            hit = self.mark_rank[at + 1] > self.mark_rank[at]
            out[todo[hit]] = self.sampled[self.mark_rank[at[hit]]] + steps
            todo, at = todo[~hit], at[~hit]
            c = self.bwt[at]
            at, steps = self.before[c] + self.tree.rank(c, at), steps + 1
        return out


class Phrases:
    """All windows of some items: by length, an array of distinct phrases, and of the items that hold each (an index
    into ``names``; those of phrase i are held[at[i]:at[i + 1]])."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        words = Words([t for _, t in items], ALNUM)
        hashes = words.hashes()
        self.vocabulary = Vocabulary(hashes)
        ids = self.vocabulary.ids(hashes) + 1
        self.n_symbols = len(self.vocabulary.sorted) + 1
        inner = np.ones(len(ids), bool)
        inner[words.first[:-1][words.counts > 0]] = False
        second = np.flatnonzero(inner)
        self.pairs = np.unique(ids[second - 1] * self.n_symbols + ids[second])
        self.names, name_of = np.unique(np.array([n for n, _ in items], object), return_inverse=True) if items else (np.empty(0, object), np.empty(0, np.int64))
        size = np.minimum(window, words.counts)
        self.by_length = []
        for n in np.unique(size[size > 0]).tolist():
            own = np.flatnonzero(size == n)
            many = words.counts[own] - n + 1
            item = np.repeat(own, many)
            start = words.first[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
            table, phrase = np.unique(np.lib.stride_tricks.sliding_window_view(ids.astype(np.int32), n)[start], axis=0, return_inverse=True)
            both = np.unique(np.stack((phrase.ravel(), name_of[item]), 1), axis=0)
            self.by_length.append((n, table, np.searchsorted(both[:, 0], np.arange(len(table) + 1)), both[:, 1]))
        self.shortest = min((n for n, *_ in self.by_length), default=0)


class Shard:
    """Occurrences of phrases in some texts."""

    def __init__(self, texts: list[bytes], phrases: Phrases):
        self.words = Words(texts, ALNUM)
        self.items: dict[int, set[str]] = {}
        self.hit = np.zeros(len(self.words.starts), bool)
        if phrases.shortest and len(self.hit):
            self._find(phrases)

    def _find(self, p: Phrases) -> None:
        ids = p.vocabulary.ids(self.words.hashes()) + 1
        breaks = self.words.first[:-1]
        follows = np.zeros(len(ids), bool)
        some = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
        key = ids[some] * p.n_symbols + ids[some + 1]
        at = np.minimum(np.searchsorted(p.pairs, key), max(0, len(p.pairs) - 1))
        good = p.pairs[at] == key if len(p.pairs) else np.zeros(len(key), bool)
        follows[some[good] + 1] = True
        apart = np.flatnonzero(~follows)
        starts, ends = runs(ids > 0, np.union1d(apart, breaks))
        keep = ends - starts >= p.shortest
        starts, ends = starts[keep], ends[keep]
        if not len(starts):
            return
        size = ends - starts + 1
        begin = np.concatenate(([0], np.cumsum(size)))
        place = np.repeat(starts - begin[:-1], size) + np.arange(begin[-1])
        last = begin[1:] - 1
        seq = ids[np.minimum(place, len(ids) - 1)]
        seq[last] = 0
        index, doc_of = FMIndex(seq, p.n_symbols), np.searchsorted(self.words.first, place, "right") - 1
        change = np.zeros(len(self.hit) + 1, np.int64)
        for n, table, at, held in p.by_length:
            lo, hi = index.search(table)
            found = np.flatnonzero(hi > lo)
            count = (hi - lo)[found]
            if not len(found):
                continue
            rows = np.repeat(lo[found] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
            spot = index.locate(rows)
            np.add.at(change, place[spot], 1)
            np.add.at(change, place[spot] + n, -1)
            both = np.unique(np.stack((doc_of[spot], np.repeat(found, count)), 1), axis=0)
            for d, f in both.tolist():
                self.items.setdefault(d, set()).update(p.names[held[at[f] : at[f + 1]]])
        self.hit = np.cumsum(change[:-1]) > 0

    def hits(self) -> np.ndarray:
        """Number of hit words of each text."""
        sums = np.concatenate(([0], np.cumsum(self.hit)))
        return sums[self.words.first[1:]] - sums[self.words.first[:-1]]

    def spans(self, d: int) -> list[tuple[int, int, int, int]]:
        """Removal spans of text d: first word, end word, first byte, end byte."""
        w = self.words
        a, b = w.first[d], w.first[d + 1]
        s, e = runs(self.hit[a:b], np.empty(0, np.int64))
        return [(int(i), int(j), int(w.starts[a + i] - w.base[d]), int(w.ends[a + j - 1] - w.base[d])) for i, j in zip(s, e, strict=True)]


_SPAN = ("first_word", "end_word", "first_byte", "end_byte")
SPAN = T.StructType([T.StructField(n, T.LongType()) for n in _SPAN])
FOUND = [T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(SPAN)), T.StructField("items", T.ArrayType(T.StringType()))]
_ARROW_SPAN = pa.list_(pa.struct([(n, pa.int64()) for n in _SPAN]))


def phrase_blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[tuple[list[tuple[str, bytes]], bool]]:
    """The items in blocks of about block_chars characters, one block at a time on the driver, and whether more follow."""
    items = benchmark.where(F.length("text") > 0).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-int(total) // block_chars))
    for b in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        yield [(r[0], r[1].encode()) for r in part.collect()], b < n - 1


def _merged(spans: list[tuple[int, ...]]) -> list[tuple[int, ...]]:
    out: list[list[int]] = []
    for s in sorted(spans):
        if out and s[0] <= out[-1][1]:
            if s[1] > out[-1][1]:
                out[-1][1], out[-1][3] = s[1], s[3]
        else:
            out.append(list(s))
    return [tuple(s) for s in out]


def _columns(n_words: np.ndarray, spans: list, items: list) -> list[pa.Array]:
    named = [[dict(zip(_SPAN, x, strict=True)) for x in s] for s in spans]
    return [pa.array(n_words, pa.int64()), pa.array(named, _ARROW_SPAN), pa.array(items, pa.list_(pa.string()))]


def _search(rows: DataFrame, phrases, hits_only: bool) -> DataFrame:
    """``rows`` (with text) and n_words, spans and items of one block; without text and only those hit, if so."""
    own = [c for c in rows.columns if not (hits_only and c == "text")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, most=SHARD_BYTES):
            shard = Shard(texts, phrases.value)
            hits = shard.hits()
            spans = [shard.spans(d) if h else [] for d, h in enumerate(hits.tolist())]
            new = _columns(shard.words.counts, spans, [sorted(shard.items.get(d, ())) for d in range(len(texts))])
            out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], [*own, *(f.name for f in FOUND)])
            yield out.filter(pa.array(hits > 0)) if hits_only else out

    return rows.mapInArrow(work, T.StructType([*(rows.schema[c] for c in own), *FOUND]))


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, text, _row (all other columns), n_words, spans (merged removal spans), items (item_ids with an occurring
    window)."""
    sc, rows, hit, keyed = docs.sparkSession.sparkContext, packed(docs), [], None
    for items, more in phrase_blocks(benchmark, block_chars):
        phrases = sc.broadcast(Phrases(items, window))
        if not more and not hit:
            return _search(rows, phrases, False)
        if keyed is None:
            keyed = materialise(rows.withColumn("uid", F.monotonically_increasing_id()), "keyed")
        hit.append(materialise(_search(keyed.select("uid", "text"), phrases, True), "block-hits"))
        phrases.unpersist(blocking=True)
    found = reduce(DataFrame.unionByName, hit).groupBy("uid").agg(
        F.max("n_words").alias("n"), F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items")
    )
    joined = keyed.join(found, "uid", "left").select(*rows.columns, F.col("n").alias("n_words"), "spans", "items")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            spans = [_merged([tuple(x.values()) for x in s or []]) for s in batch.column("spans").to_pylist()]
            new = _columns(Words(texts, ALNUM).counts, spans, [i or [] for i in batch.column("items").to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[: -len(new)], *new], batch.schema.names)

    return joined.mapInArrow(merge, T.StructType([*rows.schema, *FOUND]))


def remove_spans(docs: DataFrame, benchmark: DataFrame, **params) -> DataFrame:
    """``docs`` with contaminated passages cut out of text (a blank stays), n_chars kept right if there is one."""
    found = find_contamination(docs, benchmark, **params)
    dirty = F.size("spans") > 0
    raw = F.col("text").cast("binary")
    cut = F.aggregate(
        "spans",
        F.struct(F.lit("").cast("binary").alias("kept"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.struct(
            F.concat(a["kept"], F.substring(raw, a["at"].cast("int") + 1, (s["first_byte"] - a["at"]).cast("int")), F.lit(" ").cast("binary")).alias("kept"),
            s["end_byte"].alias("at"),
        ),
        lambda a: F.concat(a["kept"], F.substring(raw, a["at"].cast("int") + 1, F.octet_length(raw))),
    )
    clean = found.withColumn("text", F.when(dirty, cut.cast("string")).otherwise(F.col("text")))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(dirty, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("_row.n_chars"))
    return unpacked(clean, docs.columns, **new)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_contamination(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("bigint"), lambda a, s: a + s["end_word"] - s["first_word"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP8_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
          'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
phrases AS (
  SELECT item_id, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase, least(10, len(w)) AS n
  FROM (SELECT item_id, w, unnest(range(1, (len(w) - least(10, len(w)) + 2)::bigint)) AS i FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM phrases),
spots AS (
  SELECT r, i, l.n, array_to_string(w[i:i + l.n - 1], ' ') AS phrase
  FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM docs) d JOIN lengths l ON i + l.n - 1 <= len(w)),
found AS (SELECT r, i, s.n, item_id FROM spots s JOIN phrases p ON s.phrase = p.phrase AND s.n = p.n),
hits AS (SELECT r, count(DISTINCT pos) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS pos FROM found) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, item_id::varchar AS id FROM found) GROUP BY r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
"""
