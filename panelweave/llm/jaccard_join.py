"""N-gram Jaccard join by prefix filters under several global token orders.

A document is its set of distinct word shingles, as 64-bit hashes; equal sets (copies) are one item from the start,
identified by a 64-bit hash of the set. Two items link when 100 * shared >= percent * union.

1. Shingles are dealt by hash range. A range counts in how many items each shingle occurs and returns those of two or
   more; shingles of one item can't be shared. Tokens travel as packed arrays, one row for each slice and range. A
   shingle that HOT items or more of one slice hold is shared for certain: its entries go to their items' ranges at
   once, salted by item as it were, and its own range only gets a note that it is frequent; so no range gets more of a
   shingle than HOT entries a slice, however many documents hold it. Document rows go to any range.
2. An item needs ``percent`` of its shingles shared to link at all; the others are done. Every global order puts rare
   shingles first (0: by exact count; 1 and 2: by count class, then by two different hashes), so linked items share a
   token within their first n - ceil(percent n) + 1 tokens of each order.
3. Items that share a prefix token of order 0 meet in its bucket. A bucket doesn't emit its pairs: its members go to
   the star of its most typical item, each with the few shingles by which it differs from that centre. All pairs of a
   star are then judged in place: a candidate shares prefix tokens in the other orders too and has a fitting size, and
   its exact overlap follows from the differences alone (|x and y| = (|x| + |y| - |Dx xor Dy|) / 2). Only links that
   join two components are emitted, so fewer than members. A star of more than BLOCK members is dealt as pairs of
   blocks; none is capped.
4. Links are contracted to components by label propagation in written tables.

Nulls: a null or wordless text has no shingles and links with nothing (its component is its own doc_id). A null doc_id
never names a component unless all of it is null. Repeated rows are copies. Long texts are one set each. Empty tables give
no rows. Other columns are ignored, or (one_of_each) kept as they are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, documents, materialise, new_path, packed, scratch, unpacked
from ._words import BLANK, Words, mix, slices

SHINGLE, PERCENT, BLOCK, RANGE_BYTES, BATCH, HOT, MOST_TASKS = 5, 80, 8192, 12 << 20, 1000, 16, 10000
MANY = 65535  # the count that stands for this many items and more
_DOCS, _ENTRIES, _DIRECT, _FREQUENT = range(4)  # kinds of rows that are dealt
_SALT = [np.uint64(0), np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)]


def shingle_sets(texts: list[bytes], k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes of all texts, first index of each text's)."""
    w = Words(texts, BLANK)
    h, sets = w.hashes(), []
    factors = [np.uint64(f) for f in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]
    factors += [mix(np.uint64([i]))[0] | np.uint64(1) for i in range(len(factors), k)]
    whole = np.zeros(max(0, len(h) - k + 1), np.uint64)
    for i in range(k):
        whole += h[i : i + len(whole)] * factors[i]
    whole = mix(whole)
    for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        if b - a >= k:
            sets.append(np.unique(whole[a : b - k + 1]))
        elif b > a:
            one = sum((h[a + i : a + i + 1] * factors[i] for i in range(b - a)), np.uint64([b - a]))
            sets.append(mix(one))
        else:
            sets.append(whole[:0])
    return np.concatenate(sets) if sets else whole[:0], np.concatenate(([0], np.cumsum([len(s) for s in sets]))).astype(np.int64)


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _ranges(tokens: np.ndarray, n: int) -> np.ndarray:
    return ((tokens >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def _bounds(sorted_: np.ndarray) -> tuple[list[int], list[tuple[int, int]]]:
    """The values of a sorted array and where each begins and ends."""
    values, begin = np.unique(sorted_, return_index=True)
    edges = [*begin.tolist(), len(sorted_)]
    return values.tolist(), list(zip(edges[:-1], edges[1:], strict=True))


def _by_item(item: np.ndarray, n: np.ndarray, tok: np.ndarray, df: np.ndarray, ranges: int) -> tuple[list[int], list[bytes]]:
    """Entries packed by range of their items."""
    order = np.lexsort((tok, item))
    tok, item, n, df = tok[order], item[order], n[order], df[order]
    there, bounds = _bounds(_ranges(item, ranges))
    blobs = []
    for a, b in bounds:
        own, at, count = np.unique(item[a:b], return_index=True, return_counts=True)
        blobs.append(_pack(np.array([len(own), b - a], np.int64), own, n[a:b][at].astype(np.uint32), count.astype(np.uint32), tok[a:b], df[a:b]))
    return there, blobs


def _scatter(docs: DataFrame, ranges: int, k: int, hot: int) -> DataFrame:
    """Rows of packed tokens by range, and a row for each document."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["range", "kind", "blob", "doc_id", "item", "n"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            tokens, first = shingle_sets(texts, k)
            size = np.diff(first)
            items = np.array([xxhash.xxh3_64_intdigest(tokens[a:b].tobytes()) for a, b in zip(first[:-1], first[1:], strict=True)], np.uint64)
            anywhere = _ranges(mix(items + mix(np.arange(len(items), dtype=np.uint64))), ranges)
            yield pa.RecordBatch.from_arrays(
                [pa.array(anywhere, pa.int32()), pa.array(np.full(len(size), _DOCS), pa.int32()), pa.nulls(len(size), pa.binary()), batch.column("doc_id"), pa.array(items.view(np.int64), mask=size == 0), pa.array(size)],
                names,
            )
            u, at = np.unique(items, return_index=True)  # a copy in the same slice sends its tokens once
            once = np.zeros(len(items), bool)
            once[at] = True
            doc = np.repeat(np.arange(len(size)), size)
            keep = once[doc]
            tokens, doc = tokens[keep], doc[keep]
            distinct, back, count = np.unique(tokens, return_inverse=True, return_counts=True)
            frequent = count >= hot
            rows: list[tuple[int, int, bytes]] = []
            if frequent.any():
                d = frequent[back]
                there, blobs = _by_item(items[doc[d]], size[doc[d]], tokens[d], np.full(int(d.sum()), MANY, np.uint16), ranges)
                rows += [(r, _DIRECT, b) for r, b in zip(there, blobs, strict=True)]
                notes = distinct[frequent]
                there, bounds = _bounds(_ranges(notes, ranges))
                rows += [(r, _FREQUENT, _pack(notes[a:b])) for r, (a, b) in zip(there, bounds, strict=True)]
                tokens, doc = tokens[~d], doc[~d]
            r = _ranges(tokens, ranges)
            order = np.argsort(r.astype(np.uint16) if ranges < 65536 else r, kind="stable")
            tokens, doc, r = tokens[order], doc[order], r[order]
            there, bounds = _bounds(r)
            for p, (a, b) in zip(there, bounds, strict=True):
                d, count = np.unique(doc[a:b], return_counts=True)
                rows.append((p, _ENTRIES, _pack(np.array([len(d), b - a], np.int64), items[d], size[d].astype(np.uint32), count.astype(np.uint32), tokens[a:b])))
            m = len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in rows], pa.int32()), pa.array([x[1] for x in rows], pa.int32()), pa.array([x[2] for x in rows], pa.binary()), pa.nulls(m, batch.column("doc_id").type), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())],
                names,
            )

    return docs.select("doc_id", "text").mapInArrow(work, f"range int, kind int, blob binary, doc_id {kind}, item long, n long")


def _gather(scattered: DataFrame, ranges: int) -> DataFrame:
    """Document rows as they are; of the tokens, those of two or more items with their counts, by range of the item."""

    def work(key, table):
        kinds = table.column("kind").to_numpy()
        docs = table.filter(pa.array(kinds == _DOCS)).select(["doc_id", "item", "n"])
        out = [docs.append_column("part", pa.nulls(docs.num_rows, pa.int32())).append_column("blob", pa.nulls(docs.num_rows, pa.binary()))]
        of = lambda kind: table.column("blob").filter(pa.array(kinds == kind)).to_pylist()
        blobs = of(_DIRECT)
        there = [key[0].as_py()] * len(blobs)
        items, sizes, tokens = [], [], []
        for blob in of(_ENTRIES):
            d, t = np.frombuffer(blob, np.int64, 2).tolist()
            f, rest = np.frombuffer(blob, np.uint64, d, 16), 16 + 8 * d
            n, count = np.frombuffer(blob, np.uint32, d, rest), np.frombuffer(blob, np.uint32, d, rest + 4 * d)
            items.append(np.repeat(f, count))
            sizes.append(np.repeat(n, count))
            tokens.append(np.frombuffer(blob, np.uint64, t, rest + 8 * d))
        if tokens:
            tok, item, n = np.concatenate(tokens), np.concatenate(items), np.concatenate(sizes)
            notes = of(_FREQUENT)
            notes = np.unique(np.concatenate([np.frombuffer(b, np.uint64) for b in notes])) if notes else np.empty(0, np.uint64)
            order = np.argsort(tok)
            tok, item, n = tok[order], item[order], n[order]
            new = np.concatenate(([True], tok[1:] != tok[:-1]))
            run = np.cumsum(new) - 1
            other = np.concatenate(([False], (item[1:] != item[:-1]) & ~new[1:]))
            elsewhere = np.isin(tok[new], notes, assume_unique=True)
            keep = ((np.bincount(run, other) > 0) | elsewhere)[run]
            tok, item, n, elsewhere = tok[keep], item[keep], n[keep], elsewhere[run][keep]
            order = np.lexsort((item, tok))
            tok, item, n, elsewhere = tok[order], item[order], n[order], elsewhere[order]
            once = np.concatenate(([True], (tok[1:] != tok[:-1]) | (item[1:] != item[:-1]))) if len(tok) else np.zeros(0, bool)
            tok, item, n, elsewhere = tok[once], item[once], n[once], elsewhere[once]
            _, back, df = np.unique(tok, return_inverse=True, return_counts=True)
            df = np.where(elsewhere, MANY, np.minimum(df[back], MANY)).astype(np.uint16)
            more, packs = _by_item(item, n, tok, df, ranges)
            there, blobs = [*there, *more], [*blobs, *packs]
        m = len(there)
        out.append(pa.table({"doc_id": pa.nulls(m, docs.schema.field("doc_id").type), "item": pa.nulls(m, pa.int64()), "n": pa.nulls(m, pa.int64()), "part": pa.array(there, pa.int32()), "blob": pa.array(blobs, pa.binary())}))
        return pa.concat_tables(out)

    kind = scattered.schema["doc_id"].dataType.simpleString()
    # By number of ranges, so that a task's share doesn't grow with the table.
    return scattered.repartition(min(ranges, MOST_TASKS), "range").groupBy("range").applyInArrow(work, f"doc_id {kind}, item long, n long, part int, blob binary")


def least_shared(n: np.ndarray, percent: int) -> np.ndarray:
    return -(-n * percent // 100)


def _candidates(gathered: DataFrame, percent: int, ranges: int) -> DataFrame:
    """Items that may link: item, n, typical, tokens (their shared shingles), prefix (order 0), others (orders 1, 2)."""

    def work(key, table):
        parts = []
        for blob in table.column("blob").to_pylist():
            f, m = np.frombuffer(blob, np.int64, 2).tolist()
            own, rest = np.frombuffer(blob, np.uint64, f, 16), 16 + 8 * f
            n, count = np.frombuffer(blob, np.uint32, f, rest), np.frombuffer(blob, np.uint32, f, rest + 4 * f)
            rest += 8 * f
            parts.append((np.repeat(own, count), np.frombuffer(blob, np.uint64, m, rest), np.repeat(n, count), np.frombuffer(blob, np.uint16, m, rest + 8 * m)))
        item, tok, n, df = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((tok, item))
        item, tok, n, df = item[order], tok[order], n[order].astype(np.int64), df[order].astype(np.uint64)
        once = np.concatenate(([True], (item[1:] != item[:-1]) | (tok[1:] != tok[:-1])))  # frequent ones come from many slices
        item, tok, n, df = item[once], tok[once], n[once], df[once]
        begin = np.flatnonzero(np.concatenate(([True], item[1:] != item[:-1])))
        end = np.concatenate((begin[1:], [len(item)]))
        out: dict[str, list] = {c: [] for c in ("item", "n", "typical", "tokens", "prefix", "others")}
        fine = (end - begin) >= least_shared(n[begin], percent)
        for a, b in zip(begin[fine].tolist(), end[fine].tolist(), strict=True):
            t, d, size = tok[a:b], df[a:b], int(n[a])
            length = size - int(least_shared(np.int64(size), percent)) + 1 - (size - (b - a))
            kind = np.frexp(d.astype(float))[1]
            prefixes = [np.lexsort((mix(t ^ s), d if i == 0 else kind))[:length] for i, s in enumerate(_SALT)]
            out["item"].append(np.uint64(item[a]).view(np.int64))
            out["n"].append(size)
            out["typical"].append(int(np.log2(d.astype(float)).mean() * 1000))
            out["tokens"].append(t.tobytes())
            out["prefix"].append(t[prefixes[0]].view(np.int64))
            out["others"].append([np.sort(t[p]).tobytes() for p in prefixes[1:]])
        return pa.table({
            "item": pa.array(out["item"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "typical": pa.array(out["typical"], pa.int32()),
            "tokens": pa.array(out["tokens"], pa.binary()), "prefix": pa.array(out["prefix"], pa.list_(pa.int64())), "others": pa.array(out["others"], pa.list_(pa.binary())),
        })

    shared = gathered.where(F.col("blob").isNotNull()).select("part", "blob")
    return shared.repartition(min(ranges, MOST_TASKS), "part").groupBy("part").applyInArrow(work, "item long, n long, typical int, tokens binary, prefix array<long>, others array<binary>")


def _stars(sets: DataFrame) -> DataFrame:
    """a, item, n, m, d, others: members of the star of a (a is one), with their numbers of all and of shared shingles,
    the shingles by which they differ from a, and their prefixes in the other orders."""
    buckets = sets.select("item", "typical", F.explode("prefix").alias("token"))
    top = buckets.groupBy("token").agg(F.max(F.struct("typical", "item")).alias("top"), F.min("item").alias("lo"), F.max("item").alias("hi"))
    top = top.where(F.col("lo") != F.col("hi")).select("token", F.col("top.item").alias("a"))
    met = buckets.join(top, "token").select("a", F.col("item").alias("b")).distinct()
    b = sets.select(F.col("item").alias("b"), "n", F.col("tokens").alias("t_b"), "others")
    full = met.join(b, "b").join(sets.select(F.col("item").alias("a"), F.col("tokens").alias("t_a")), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        array = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
        for batch in batches:
            d, m = [], []
            for x, y in zip(batch.column("t_a"), batch.column("t_b"), strict=True):
                x, y = array(x), array(y)
                d.append(np.setxor1d(x, y, assume_unique=True).tobytes())
                m.append(len(y))
            cols = [batch.column("a"), batch.column("b"), batch.column("n"), pa.array(m, pa.int64()), pa.array(d, pa.binary()), batch.column("others")]
            yield pa.RecordBatch.from_arrays(cols, ["a", "item", "n", "m", "d", "others"])

    out = full.select("a", "b", "n", "t_a", "t_b", "others").mapInArrow(work, "a long, item long, n long, m long, d binary, others array<binary>")
    return materialise(out, "stars", batch_rows=BATCH)


class _Postings:
    """Which rows hold a token."""

    def __init__(self, rows: list[np.ndarray]):
        row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        token = np.concatenate(rows)
        order = np.argsort(token, kind="stable")
        self.row, self.n = row[order], len(rows)
        self.tokens, self.begin = np.unique(token[order], return_index=True)
        self.end = np.append(self.begin[1:], len(token))

    def counts(self, tokens: np.ndarray) -> np.ndarray:
        """How many of ``tokens`` (all of them held) each row holds."""
        at = np.searchsorted(self.tokens, tokens)
        if not len(at):
            return np.zeros(self.n, np.int64)
        return np.bincount(np.concatenate([self.row[a:b] for a, b in zip(self.begin[at].tolist(), self.end[at].tolist(), strict=True)]), minlength=self.n)


def star_links(n: np.ndarray, m: np.ndarray, d: list[np.ndarray], orders: list[list[np.ndarray]], percent: int) -> list[tuple[int, int]]:
    """Links between rows of a star, as many as join components."""
    g, out = len(n), []
    if g > 2:  # differ from what most members hold rather than from the centre
        tokens, counts = np.unique(np.concatenate(d), return_counts=True)
        most = tokens[counts * 2 > g]
        if len(most):
            d = [np.setxor1d(x, most, assume_unique=True) for x in d]
    size = np.array([len(x) for x in d])
    differ, prefixes = _Postings(d), [_Postings(o) for o in orders]
    component = np.arange(g)
    for x in range(1, g):
        y = np.flatnonzero((component[:x] != component[x]) & (np.minimum(n[:x], n[x]) * 100 >= np.maximum(n[:x], n[x]) * percent))
        for p, o in zip(prefixes, orders, strict=True):
            if len(y):
                y = y[p.counts(o[x])[y] > 0]
        if len(y):
            apart = size[y] + size[x] - 2 * differ.counts(d[x])[y]
            shared = (m[y] + m[x] - apart) // 2
            for k in y[100 * shared >= percent * (n[y] + n[x] - shared)].tolist():
                if component[k] != component[x]:
                    out.append((k, x))
                    component[component == component[k]] = component[x]
    return out


def _links(stars: DataFrame, percent: int, block: int) -> DataFrame:
    """a, b: links that join components within each star."""
    size = stars.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("item"), F.col("blocks")).cast("int")
    dealt = stars.join(size, "a").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("own", "other", "blocks")

    def work(key, table):
        item = table.column("item").to_numpy()
        arrays = lambda c: [np.frombuffer(x.as_buffer(), np.uint64) for x in c]
        orders = list(zip(*(arrays(o.values) for o in table.column("others")), strict=True))
        found = star_links(table.column("n").to_numpy(), table.column("m").to_numpy(), arrays(table.column("d")), [list(o) for o in orders], percent)
        return pa.table({"a": pa.array([int(item[x]) for x, _ in found], pa.int64()), "b": pa.array([int(item[y]) for _, y in found], pa.int64())})

    return dealt.groupBy("a", "i", "j").applyInArrow(work, "a long, b long")


def connected(links: DataFrame) -> DataFrame:
    """item, component (the smallest item that links reach). Smallest neighbour, then a pointer jump, until no change;
    every round starts from a written table, so its plan stays short, and deletes the one before."""
    spark = links.sparkSession
    edges = materialise(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    at = new_path(spark, "labels")
    labels = materialise(edges.groupBy(F.col("a").alias("item")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels", path=at)
    while True:
        near = edges.join(labels.select(F.col("item").alias("b"), F.col("component").alias("c")), "b").groupBy(F.col("a").alias("item")).agg(F.min("c").alias("near"))
        step = labels.join(near, "item").select("item", "component", F.least("component", "near").alias("to"))
        jump = labels.select(F.col("item").alias("to"), F.col("component").alias("far"))
        new = step.join(jump, "to", "left").select("item", F.col("component").alias("old"), F.least("to", F.coalesce("far", "to")).alias("component"))
        before, at = at, new_path(spark, "labels")
        new = materialise(new, "labels", path=at)
        discard(spark, before)
        if new.where(F.col("old") != F.col("component")).isEmpty():
            return new.select("item", "component")
        labels = new.select("item", "component")


def component_labels(sets: DataFrame, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """item, component for the items that link."""
    return connected(materialise(_links(_stars(sets), percent, block), "links"))


def near_duplicates(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT, range_bytes: int = RANGE_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, n_shingles, component_id, one row a document."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-int(total) // range_bytes))
    at = new_path(docs.sparkSession, "components")
    gathered = materialise(_gather(_scatter(docs, ranges, k, hot), ranges), "shared-shingles", batch_rows=BATCH)
    with scratch(docs.sparkSession):
        sets = materialise(_candidates(gathered, percent, ranges), "shingle-sets")
        labels = materialise(component_labels(sets, percent), "components", path=at)
    own = gathered.where(F.col("blob").isNull()).select("doc_id", "item", "n")
    items = own.where(F.col("item").isNotNull()).groupBy("item").agg(F.min("doc_id").alias("least"))
    named = items.join(labels, "item", "left").withColumn("component", F.coalesce("component", "item"))
    names = named.groupBy("component").agg(F.min("least").alias("component_id"))
    of = named.join(names, "component").select("item", "component_id")
    return own.join(of, "item", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("item").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame, written: bool = False, **params) -> DataFrame:
    """The rows of ``docs`` without near duplicates: the smallest doc_id of each component stays, of repeated rows one.
    Rows are numbered by their place, so ``docs`` is written first unless it is a ``written`` table."""
    rows = packed(docs).withColumn("uid", F.monotonically_increasing_id())
    if not written:
        rows = materialise(rows, "numbered")
    found = near_duplicates(rows.select(F.col("uid").alias("doc_id"), "text"), **params)
    labelled = found.select(F.col("doc_id").alias("uid"), "component_id").join(rows.select("uid", "doc_id"), "uid")
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "uid")
    stay = labelled.groupBy("component_id").agg(F.min(first).alias("first")).select("first.uid")
    return unpacked(rows.join(stay, "uid", "left_semi"), docs.columns)


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"), k=4, percent=85)


OP6_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
every AS (
  SELECT DISTINCT r, s FROM (
    SELECT r, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
           ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM docs)),
sizes AS (SELECT r, count(*) AS n, md5(string_agg(s, chr(10) ORDER BY s)) AS k FROM every GROUP BY r),
items AS (SELECT r, n, min(r) OVER (PARTITION BY k) AS item FROM sizes),
own AS MATERIALIZED (SELECT r, s, n FROM every JOIN items USING (r) WHERE r = item),
links AS MATERIALIZED (
  SELECT a.r AS x, b.r AS y FROM own a JOIN own b ON a.s = b.s AND a.r < b.r
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT item AS root, item FROM items WHERE r = item UNION SELECT root, y FROM reach JOIN edges ON item = x),
least AS (SELECT item, min(doc_id) AS least FROM items JOIN docs USING (r) GROUP BY item),
names AS (SELECT root AS item, min(least) AS component_id FROM reach JOIN least USING (item) GROUP BY root)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM docs LEFT JOIN items USING (r) LEFT JOIN names USING (item)
"""
