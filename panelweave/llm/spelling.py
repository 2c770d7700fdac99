"""Spelling variants: words one edit apart, found by a rare-first positional q-gram prefix filter.

One edit touches at most two of a word's bigrams (words get two marks at either end, so that the shortest have three).
Under any one order of all bigrams two words within one edit therefore
share one of the first three of each, at places that agree from the left or from the right (prefix filter). The order is
rarest first, by counts over the vocabulary. The shared bigram is one the edit left alone, so the edit lies on one side
of it and everything on the other side is equal; and what remains lies in two halves of which one is equal, too. A join
key holds all of that: the side, the bigram with its place and what stands beyond it, the length of the rest, and one half
of the rest. Three bigrams, two sides, two halves, and three roles (partner as long, one longer, one shorter) make at most
36 keys a word, whatever the words are; pairs that meet are verified by edit distance inside the join, so only true ones
leave it. No bucket is cut or capped.

The counts that give the order are kept for 65536 hash buckets of bigrams (any order is right; letters a-z and
U+00C0-U+00FF have 8100 bigrams), so what travels to the tasks is bounded.

Forms point to words at least twice as frequent, so paths are at most log2(largest count) long and never circular; roots
are found by pointer doubling, a written table a round.

All joins are merge joins by their hint: Spark sizes a side by the compressed files below it, and the keys of a word, which
a Python step makes, as that word alone; a side that passes for small would go through the driver whole.

Nulls: a null text has no words; a null doc_id counts as an empty one where ids are hashed. Repeated rows count each.
Words are counted over whole texts; texts over SLICE code points are taken in slices, a run belonging to the slice it
starts in. Ties between forms go to the smaller word in code-point order. An empty table gives no rows. Other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import ascii_lower, documents, materialise

LETTERS, SLICE, BUCKETS, RAREST, MARKS = "[A-Za-zÀ-ÿ]", 1 << 20, 1 << 16, 3, ("\x02\x02", "\x03\x03")
MIN_LENGTH, MIN_COUNT, ONE_IN, FACTOR = 5, 3, 97, 2


def runs(docs: DataFrame) -> DataFrame:
    """doc_id, run: every maximal run of letters of every text, A-Z lower-cased."""
    some = docs.select("doc_id", ascii_lower(F.col("text")).alias("text")).where(F.col("text").isNotNull())
    n = F.char_length("text")
    cut = some.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.floor((F.greatest(n, F.lit(1)) - 1) / SLICE).cast("int"))).alias("_i"))
    at = F.col("_i") * SLICE
    own = F.substring(F.col("text"), at + 1, F.lit(SLICE))
    goes_on = (F.col("_i") > 0) & F.substring(F.col("text"), at, F.lit(1)).rlike(LETTERS)
    body = F.when(goes_on, F.regexp_replace(own, f"^{LETTERS}+", "")).otherwise(own)
    rest = F.regexp_extract(F.substring(F.col("text"), at + 1 + SLICE, n), f"^{LETTERS}+", 0)
    piece = F.when(n <= SLICE, F.col("text")).otherwise(F.concat(body, F.when(body.rlike(LETTERS + "\\z"), rest).otherwise("")))
    return cut.select("doc_id", piece.alias("_piece")).select("doc_id", F.explode(F.regexp_extract_all("_piece", F.lit(f"({LETTERS}+)"), 1)).alias("run"))


def damaged(doc_id: Column, run: Column, one_in: int = ONE_IN) -> Column:
    """The run without one code point where its hash with the doc_id says so."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = F.pmod(h, F.char_length(run)).cast("int")
    return F.when(h % one_in == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def counted(words: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n: the frequent words that are long enough."""
    long_enough = words.where(F.char_length("word") >= min_length)
    return long_enough.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_count)


def bigram_counts(words: DataFrame) -> dict[int, int]:
    """How many bigrams of the vocabulary each hash bucket holds: at most BUCKETS entries."""
    grams = F.transform(F.sequence(F.lit(1), F.char_length("_w") - 1), lambda i: F.substring(F.col("_w"), i, F.lit(2)))
    each = words.select(F.concat(F.lit(MARKS[0]), "word", F.lit(MARKS[1])).alias("_w")).select(F.explode(grams).alias("g"))
    by = each.groupBy(F.pmod(F.crc32(F.col("g").cast("binary")), F.lit(BUCKETS)).alias("b")).count()
    return {r.b: r["count"] for r in by.collect()}


def keys_of(word: str, order: dict[int, int]) -> Iterator[tuple[str, int]]:
    """(key, role) for each place an edit can have. Roles: 0 both as long, 1 the shorter, 2 the longer."""
    whole = MARKS[0] + word + MARKS[1]
    grams = [whole[i : i + 2] for i in range(len(whole) - 1)]
    ranked = sorted((order.get(zlib.crc32(g.encode()) % BUCKETS, 0), g, i) for i, g in enumerate(grams))
    for _, _, i in ranked[:RAREST]:
        begin, end = max(0, i - 2), min(i, len(word))  # of the bigram, inside the word
        for side, fixed, rest in (("l", word[:end], word[end:]), ("r", word[begin:], word[:begin])):
            n = len(rest)
            h = n // 2
            if n:
                yield f"{side}{n}={fixed}<{rest[:h]}", 0
                yield f"{side}{n}={fixed}>{rest[h:]}", 0
            yield f"{side}{n}+{fixed}<{rest[:h]}", 1
            yield f"{side}{n}+{fixed}>{rest[h:]}", 1
            if n:
                h = (n - 1) // 2
                yield f"{side}{n - 1}+{fixed}<{rest[:h]}", 2
                yield f"{side}{n - 1}+{fixed}>{rest[h + 1 :]}", 2


def entries(words: DataFrame, order: dict[int, int], roles: tuple[int, ...], name: str) -> DataFrame:
    """A row for each key of each word in these roles: key, word and n (called by ``name``)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, ns = batch.column("word").to_pylist(), batch.column("n")
            for low in range(0, len(texts), 4096):
                key, at = [], []
                for i in range(low, min(low + 4096, len(texts))):
                    found = {k for k, role in keys_of(texts[i], order) if role in roles}
                    key += [xxhash.xxh3_64_intdigest(k) - (1 << 63) for k in found]
                    at += [i] * len(found)
                take = pa.array(at, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), batch.column("word").take(take), ns.take(take)], ["key", name, f"n_{name}"])

    return words.select("word", "n").mapInArrow(work, f"key long, {name} string, n_{name} long")


def near_pairs(words: DataFrame) -> DataFrame:
    """a, n_a, b, n_b: every two words exactly one edit apart, once."""
    order = bigram_counts(words)
    left, right = entries(words, order, (0, 1), "a"), entries(words, order, (0, 2), "b")
    one_apart = (F.col("a") != F.col("b")) & (F.levenshtein("a", "b", 1) == 1)
    once = (F.char_length("a") != F.char_length("b")) | (F.col("a") < F.col("b"))
    return left.join(right.withColumnRenamed("key", "key_b").hint("merge"), (F.col("key") == F.col("key_b")) & once & one_apart).select("a", "n_a", "b", "n_b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """word, root for words that have a form: pointers double until none moves."""
    now = materialise(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        step = now.select(F.col("word").alias("_at"), F.col("root").alias("_to"))
        moved = now.join(step.hint("merge"), F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_to", "root").alias("root"), F.col("_to").isNotNull().alias("_moved"))
        moved = materialise(moved, "spelling-roots")
        now = moved.select("word", "root")
        if moved.where("_moved").isEmpty():
            return now


def variants(words: DataFrame, factor: int = FACTOR) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words and counts: the form is the nearest frequent word
    (one edit apart, at least ``factor`` times as frequent)."""
    words = materialise(words.select("word", "n"), "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("n_other")),
        F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("n_other")),
    )).alias("p")).select("p.*")
    best = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("n_other")).alias("less"), F.col("other"))).alias("best"))
    takes = -F.col("best.less") >= factor * F.col("n")
    judged = words.join(best.hint("merge"), "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
        F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.less")).alias("form_n"),
    )
    judged = materialise(judged, "spelling-forms")
    ends = roots(judged.where(F.col("form").isNotNull()))
    return judged.join(ends.hint("merge"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = runs(documents(spark, sf_dir))
    return variants(counted(every.select(damaged(F.col("doc_id"), F.col("run")).alias("word"))))


OP13_SQL = """
WITH RECURSIVE shift(t) AS (
  SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i))
), runs AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS run FROM documents
), each AS (
  SELECT doc_id, run, count(*) AS times,
    flatten(list_transform(range(1, length(coalesce(doc_id::VARCHAR, '') || ':' || run) + 1), lambda i:
      CASE WHEN unicode(substr(coalesce(doc_id::VARCHAR, '') || ':' || run, i, 1)) < 128 THEN [unicode(substr(coalesce(doc_id::VARCHAR, '') || ':' || run, i, 1))::BIGINT]
           ELSE [195, unicode(substr(coalesce(doc_id::VARCHAR, '') || ':' || run, i, 1))::BIGINT - 64] END)) AS bytes
  FROM runs GROUP BY doc_id, run
), hashed AS (
  SELECT run, times, xor(list_reduce(bytes, lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM each, shift
), damaged AS (
  SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, times FROM hashed
), words AS (
  SELECT word, sum(times)::BIGINT AS n FROM damaged WHERE length(word) >= 5 GROUP BY word HAVING sum(times) >= 3
), shorter AS (
  SELECT word, unnest(list_distinct([word] || list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i - 1) || substr(word, i + 1)))) AS s FROM words
), meet AS (
  SELECT DISTINCT a.word AS a, b.word AS b FROM shorter a JOIN shorter b ON a.s = b.s AND a.word <> b.word
), near AS (
  SELECT a.word, b.word AS other, b.n AS n_other FROM meet JOIN words a ON a.word = meet.a JOIN words b ON b.word = meet.b
  WHERE list_sum(list_transform(range(1, greatest(length(a.word), length(b.word)) + 1), lambda i:
      (CASE WHEN length(a.word) >= length(b.word) THEN substr(a.word, 1, i - 1) || substr(a.word, i + 1) ELSE a.word END
     = CASE WHEN length(b.word) >= length(a.word) THEN substr(b.word, 1, i - 1) || substr(b.word, i + 1) ELSE b.word END)::INT)) > 0
), best AS (
  SELECT word, count(*) AS n_near, min(struct_pack(less := -n_other, w := encode(other))) AS b FROM near GROUP BY word
), judged AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b.less >= 2 * w.n THEN decode(b.w) END AS form, CASE WHEN -b.less >= 2 * w.n THEN -b.less END AS form_n
  FROM words w LEFT JOIN best USING (word)
), up AS (
  SELECT word, word AS at, form AS nxt FROM judged
  UNION ALL SELECT up.word, j.word, j.form FROM up JOIN judged j ON j.word = up.nxt
)
SELECT j.word, j.form, up.at AS root, j.n, j.n_near, j.form_n FROM judged j JOIN up ON up.word = j.word AND up.nxt IS NULL
"""
