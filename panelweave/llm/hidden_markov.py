"""Scoring with a hidden Markov language model.

States emit word classes, classes emit words. The SINGLE most frequent training tokens are classes of their own; all
other words share SHAPES classes by the shape of their ending. Within a class a word has (c + 1) / (tokens + distinct
words + 1), so the model is a proper distribution with one place for unknown words.

1. Token counts of all training documents are aggregated by a 64-bit hash of the word.
2. A share of the documents, chosen by a hash (one in SEED_SHARE, SEED_DOCS at least; whole texts), starts the
   parameters: SEED_DOCS of them give class counts, which are clustered into the states' first emissions (a bounded
   array on the driver); then SEED_PASSES of Baum-Welch run over the share.
3. Baum-Welch over all training documents, until a pass gains less than TOLERANCE of the log-likelihood, or
   MOST_PASSES. Partitions sum expected counts and Spark aggregates them to one row a class, of bounded size whatever
   the corpus. Documents are taken in segments of SEGMENT tokens, each with OVERLAP tokens on either side, so that
   states are known where a segment begins; every token and every transition counts once, starts only where documents
   begin.
4. Each document, whole, gets the scaled forward recursion: the exact log10 likelihood of its sequence.

The counts of the TOP most frequent words travel with the tasks (a documented bound); those of all other words are
joined by shuffle, one row for each rare word of a document. A text over CHUNK bytes is taken in chunks that end at blanks:
the forward recursion goes on from chunk to chunk, so memory is bounded by the chunk.

Nulls: a null text is empty and has the end token alone; a null doc_id is not held out and trains. Repeated rows are
scored (and trained on) each. Ties between words of one count go to the smaller hash. Without training documents every count
is 0 and the model is uniform. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import discard, documents, materialise, new_path
from ._words import BLANK, Words, slices
from .language_id import held_out

STATES, SINGLE, SHAPES, TOP = 8, 7680, 512, 1 << 17
SEED_DOCS, SEED_SHARE, SEED_PASSES, MOST_PASSES, TOLERANCE = 384, 64, 6, 3, 0.002
SEGMENT, OVERLAP, CHUNK = 256, 24, 2 << 20
END = np.uint64(0x454E444F46544558)  # the end token's hash
FLUSH = 1 << 18
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


class Chunk(NamedTuple):
    """Part of a text, with words around it that only give context."""

    text: bytes
    before: int = 0
    after: int = 0
    begins: bool = True
    ends: bool = True


def _blank(text: bytes, at: int) -> int:
    """The first blank at ``at`` or later, else the end."""
    found = _BLANK.search(text, at)
    return found.start() if found else len(text)


def chunks(text: bytes, most: int = CHUNK, context: int = 0) -> Iterator[Chunk]:
    """A text in chunks of about ``most`` bytes that end at blanks, with about ``context`` bytes around each."""
    at = 0
    while True:
        end = _blank(text, at + most)
        lead = min(at, _blank(text, at - context)) if at and context else at
        tail = _blank(text, end + context) if context else end
        around = [len(Words([part], BLANK).starts) for part in (text[lead:at], text[end:tail])] if context else [0, 0]
        yield Chunk(text[lead:tail], *around, at == 0, end == len(text))
        if end == len(text):
            return
        at = end


def portions(texts: list[bytes], most: int = CHUNK, context: int = 0) -> Iterator[list[Chunk]]:
    """All texts as lists of chunks of about ``most`` bytes in all."""
    held, size = [], 0
    for text in texts:
        for c in chunks(text, most, context) if len(text) > most else (Chunk(text),):
            if held and size + len(c.text) > most:
                yield held
                held, size = [], 0
            held.append(c)
            size += len(c.text)
    if held:
        yield held


def tokens(part: list[Chunk]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, shapes, first): the words of each chunk, and an end token where its text ends."""
    w = Words([c.text for c in part], BLANK)
    ends = np.array([c.ends for c in part], np.int64)
    shift = np.concatenate(([0], np.cumsum(ends)))
    first = w.first + shift
    h = np.full(int(first[-1]), END, np.uint64)
    shape = np.zeros(len(h), np.int64)
    place = np.arange(len(w.starts)) + shift[w.doc_of()]
    h[place] = w.hashes()
    length = w.ends - w.starts
    last, before = w.bytes[w.ends - 1].astype(np.int64), w.bytes[np.maximum(w.ends - 2, w.starts)].astype(np.int64)
    shape[place] = (last * 37 + before * 11 + np.minimum(length, 11) // 4 * 131) % SHAPES
    return h, shape, first


def count_tokens(train: DataFrame) -> DataFrame:
    """h, shape, c."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(parts):
            h = np.concatenate([p[0] for p in parts])
            u, at, inverse = np.unique(h, return_index=True, return_inverse=True)
            c = np.bincount(inverse, np.concatenate([p[2] for p in parts])).astype(np.int64)
            return u, np.concatenate([p[1] for p in parts])[at], c

        def rows(parts):
            u, s, c = out(parts)
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(s.astype(np.int32)), pa.array(c)], ["h", "shape", "c"])

        held: list = []
        for _, texts in slices(batches):
            for part in portions(texts, 2 * CHUNK):
                h, shape, _ = tokens(part)
                u, at, c = np.unique(h, return_index=True, return_counts=True)
                held.append((u, shape[at], c))
                if sum(len(p[0]) for p in held) > 4 * FLUSH:
                    held = [out(held)]
                    if len(held[0][0]) > 2 * FLUSH:
                        yield rows(held)
                        held = []
        if held:
            yield rows(held)

    part = train.select("text").mapInArrow(work, "h long, shape int, c long")
    return part.groupBy("h").agg(F.max("shape").alias("shape"), F.sum("c").alias("c"))


class Lexicon:
    """The bounded part of the counts: hashes, counts and classes of the TOP words, class totals, N and V."""

    def __init__(self, counts: DataFrame, top: int = TOP):
        n, v = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
        self.n, self.v = int(n or 0), int(v)
        best = counts.orderBy(F.desc("c"), "h").limit(top).toArrow()
        h, c, shape = (best.column(x).to_numpy() for x in ("h", "c", "shape"))
        h = h.view(np.uint64)
        cls = np.where(np.arange(len(h)) < SINGLE, np.arange(len(h)), SINGLE + shape)
        tokens_, kinds = np.zeros(SHAPES, np.int64), np.zeros(SHAPES, np.int64)
        for s, a, b in counts.groupBy("shape").agg(F.sum("c"), F.count(F.lit(1))).collect():  # at most SHAPES rows
            tokens_[s], kinds[s] = a, b
        k = min(SINGLE, len(h))
        tokens_ -= np.bincount(shape[:k], c[:k], SHAPES).astype(np.int64)
        kinds -= np.bincount(shape[:k], minlength=SHAPES)
        o = np.argsort(h)
        self.hashes, self.counts, self.classes = h[o], c[o], cls[o].astype(np.int32)
        self.class_log = np.log10(tokens_ + kinds + 1.0)
        self.class_tokens = np.concatenate((np.zeros(SINGLE), tokens_)) + np.bincount(cls[:k], c[:k], SINGLE + SHAPES)
        bits = 22
        self._mask = np.uint64((1 << bits) - 1)
        self._maybe = np.zeros(1 << bits, bool)
        self._maybe[(self.hashes & self._mask).astype(np.int64)] = True

    def look_up(self, h: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(classes, counts; -1 where a word isn't among the TOP)."""
        cls, c = (SINGLE + shape).astype(np.int32), np.full(len(h), -1, np.int64)
        if len(self.hashes):
            some = np.flatnonzero(self._maybe[(h & self._mask).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.hashes, h[some]), len(self.hashes) - 1)
            ok = self.hashes[at] == h[some]
            some, at = some[ok], at[ok]
            cls[some], c[some] = self.classes[at], self.counts[at]
        return cls, c


class Model:
    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        """start (K), move (K, K), emit (classes, K)."""
        self.start, self.move, self.emit = start.astype(np.float32), move.astype(np.float32), np.ascontiguousarray(emit, np.float32)
        anywhere = np.full(len(start), 1 / len(start))
        for _ in range(200):
            anywhere = anywhere @ move
        self.anywhere = (anywhere / anywhere.sum()).astype(np.float32)  # of a place inside a document

    def log10_likelihood(self, cls: np.ndarray, first: np.ndarray, size: np.ndarray, before: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward recursion over whole sequences, all of them in step: (log10 likelihoods, last states). ``before``:
        the last state of what comes before each."""
        o = np.argsort(-size, kind="stable")
        at, n = first[o], size[o]
        total, last = np.zeros(len(o)), np.zeros((len(o), len(self.start)), np.float32)
        if before is not None:
            last[:] = before[o]
        live = np.searchsorted(-n, -np.arange(int(n[0]) if len(n) else 0), "left")
        for t, k in enumerate(live.tolist()):
            e = self.emit[cls[at[:k] + t]]
            a = e * self.start if t == 0 and before is None else (last[:k] @ self.move) * e
            s = a.sum(axis=1)
            last[:k] = a / s[:, None]
            total[:k] += np.log10(s)
        out, end = np.empty(len(o)), np.empty_like(last)
        out[o], end[o] = total, last
        return out, end

    def expected(self, cls: np.ndarray, at: np.ndarray, n: np.ndarray, lead: np.ndarray, core: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """Baum-Welch counts of segments: (start, move, emit, log-likelihood). ``n`` tokens from ``at``; only ``core`` of them,
        after ``lead``, and the moves to them count."""
        k_states = len(self.start)
        o = np.argsort(-n, kind="stable")
        at, n, lead, core, begins = at[o], n[o], lead[o], core[o], begins[o]
        steps = int(n[0]) if len(n) else 0
        live = np.searchsorted(-n, -np.arange(steps), "left").tolist()
        counts = [((lead[:k] <= t) & (t < lead[:k] + core[:k])).astype(np.float32)[:, None] for t, k in enumerate(live)]
        alphas, scales, emits, classes, likelihood = [], [], [], [], 0.0
        for t, k in enumerate(live):
            c = cls[at[:k] + t]
            e = self.emit[c]
            a = e * np.where(begins[:, None], self.start, self.anywhere) if t == 0 else (alphas[-1][:k] @ self.move) * e
            s = a.sum(axis=1, keepdims=True)
            alphas.append(a / s)
            scales.append(s)
            emits.append(e)
            classes.append(c)
            likelihood += float((np.log(s) * counts[t]).sum(dtype=np.float64))
        start, moves, emit = np.zeros(k_states), np.zeros((k_states, k_states)), np.zeros((len(self.emit), k_states))
        beta = np.ones((0, k_states), np.float32)
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def settle() -> None:
            flat, g = (np.concatenate(x) for x in zip(*held, strict=True))
            for j in range(k_states):
                emit[:, j] += np.bincount(flat, g[:, j], len(emit))
            held.clear()

        for t in range(steps - 1, -1, -1):
            b = np.ones((live[t], k_states), np.float32)
            if len(beta):
                k = len(beta)
                v = beta * emits[t + 1] / scales[t + 1]
                moves += alphas[t][:k].T @ (v * counts[t + 1])
                b[:k] = v @ self.move.T
                emits[t + 1] = scales[t + 1] = None
            beta = b
            gamma = alphas[t] * beta * counts[t]
            held.append((classes[t], gamma))
            classes[t] = None
            if t == 0:
                start += gamma[begins].sum(axis=0, dtype=np.float64)
            if t % 64 == 0:
                settle()
        return start, moves * self.move, emit, np.array([likelihood])


def segments(first: np.ndarray, part: list[Chunk], length: int = SEGMENT, overlap: int = OVERLAP) -> tuple[np.ndarray, ...]:
    """(first token, number of tokens, of them before the core, core, whether a document begins) of segments whose cores
    cover every token of the chunks, context aside, once."""
    begin = first[:-1] + np.array([c.before for c in part], np.int64)
    end = first[1:] - np.array([c.after for c in part], np.int64)
    many = -(-np.maximum(end - begin, 0) // length)
    doc = np.repeat(np.arange(len(part)), many)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    core_at = begin[doc] + k * length
    core = np.minimum(length, end[doc] - core_at)
    at = np.maximum(core_at - overlap, first[:-1][doc])
    stop = np.minimum(core_at + core + overlap, first[1:][doc])
    begins = (k == 0) & np.array([c.begins for c in part], bool)[doc]
    return at, stop - at, core_at - at, core, begins


def maximise(start: np.ndarray, move: np.ndarray, emit: np.ndarray, prior: np.ndarray) -> Model:
    start, move = start + 1.0, move + 1.0
    emit = emit + prior[:, None] * 200.0
    return Model(start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def begin(rows: np.ndarray, prior: np.ndarray, states: int = STATES) -> Model:
    """Start values from class counts of some documents (a row each), gathered around ``states`` far-apart ones."""
    n = len(rows)
    k = max(1, min(states, n))
    size = rows.sum(axis=1)
    rows = np.sqrt(rows)
    norm = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)
    chosen = [int(np.argmax(size))]
    while len(chosen) < k:
        near = (norm @ norm[chosen].T).max(axis=1) + (size < 50)
        chosen.append(int(np.argmin(near)))
    centres = norm[chosen]
    for _ in range(5):
        own = np.argmax(norm @ centres.T, axis=1)
        for j in range(k):
            if (own == j).any():
                m = norm[own == j].sum(axis=0)
                centres[j] = m / max(np.linalg.norm(m), 1e-9)
    own = np.argmax(norm @ centres.T, axis=1)
    emit = np.zeros((len(prior), states))
    for j in range(states):
        emit[:, j] = (rows[own == j % k] ** 2).sum(axis=0) * (1 + 0.01 * j)
    move = np.full((states, states), 0.1 / states) + 0.9 * np.eye(states)
    return maximise(np.ones(states), move * 1000, emit, prior)


def class_counts(docs: DataFrame, lex, n_classes: int, most: int = SEED_DOCS) -> np.ndarray:
    """Class counts of the ``most`` documents (whole texts) with the smallest ``seed``: docs has seed and text."""
    few = docs.orderBy("seed").limit(most)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            out = []
            for text in texts:
                total = np.zeros(n_classes, np.int64)
                for part in portions([text]):
                    h, shape, _ = tokens(part)
                    total += np.bincount(lex.value.look_up(h, shape)[0], minlength=n_classes)
                out.append(total)
            yield pa.RecordBatch.from_arrays([batch.column("seed"), pa.array([x.tobytes() for x in out], pa.binary())], ["seed", "counts"])

    got = few.mapInArrow(work, "seed long, counts binary").collect()  # at most ``most`` rows of n_classes numbers
    rows = [np.frombuffer(bytes(r.counts), np.int64) for r in sorted(got)]
    return np.array(rows or [np.zeros(n_classes, np.int64)], np.float32)


def baum_welch(train: DataFrame, lex, model: Model, prior: np.ndarray, passes: int, tolerance: float = 0.0, chunk: int = CHUNK) -> tuple[Model, list[float]]:
    """``train``: text. ``lex``: a broadcast Lexicon. The model and the log-likelihood a token before each pass."""
    sc, k, history = train.sparkSession.sparkContext, len(model.start), []
    names = [f"s{i}" for i in range(k)]
    for _ in range(passes):
        shared = sc.broadcast(model)

        def work(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            m, total, seen = shared.value, None, 0
            for _, texts in slices(batches, most=chunk):
                for part in portions(texts, chunk, 8 * OVERLAP):
                    h, shape, first = tokens(part)
                    cls, _ = lex.value.look_up(h, shape)
                    at, n, lead, core, begins = segments(first, part)
                    got = m.expected(cls, at, n, lead, core, begins)
                    seen += int(core.sum())
                    total = got if total is None else tuple(a + b for a, b in zip(total, got, strict=True))
            if total is not None:
                start, move, emit, likelihood = total
                table = np.zeros((len(emit) + k + 2, k))  # classes, then transitions, then starts, then likelihood and tokens
                table[: len(emit)], table[len(emit) : -2], table[-2], table[-1, 0], table[-1, 1] = emit, move, start, likelihood[0], seen
                some = np.flatnonzero(table.any(axis=1))
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(table[some, j]) for j in range(k))], ["row", *names])

        part = train.select("text").mapInArrow(work, "row int, " + ", ".join(f"{x} double" for x in names))
        table = np.zeros((len(prior) + k + 2, k))
        sums = part.groupBy("row").agg(*(F.sum(x).alias(x) for x in names)).toArrow()  # at most len(table) rows
        table[sums.column("row").to_numpy()] = np.stack([sums.column(x).to_numpy() for x in names], axis=1)
        shared.unpersist()
        model = maximise(table[-2], table[len(prior) : -2], table[: len(prior)], prior)
        history.append(float(table[-1, 0] / max(1.0, table[-1, 1])))
        if len(history) > 1 and history[-1] - history[-2] < tolerance * abs(history[-1]):
            break
    return model, history


SCORED = "uid long, doc_id {}, whole boolean, n_tokens long, known long, count_log double, class_log double, hmm double, rare array<long>"


def score_documents(docs: DataFrame, shared, lex: Lexicon, counts: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score. ``shared``: (lexicon, model), broadcast."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = [x.split(" ")[0] for x in SCORED.split(", ")]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex, model = shared.value

        def judge(part: list[Chunk], before=None):
            """(tokens, known, count_log, class_log, hmm) of each chunk, their rare words, last states."""
            h, shape, first = tokens(part)
            cls, c = lex.look_up(h, shape)
            top = c >= 0
            rare = np.flatnonzero(~top)
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, first).astype(np.int32)), pa.array(h[rare].view(np.int64)))
            del h, shape
            logs = np.where(top, np.log10(np.maximum(c, 0) + 1.0), 0.0)
            within = np.where(cls >= SINGLE, lex.class_log[np.maximum(cls - SINGLE, 0)], 0.0)
            inside = np.where(cls >= SINGLE, logs, 0.0) - within  # log10 P(word | class), rare words' counts aside
            del within

            def total(x: np.ndarray) -> np.ndarray:
                sums = np.concatenate(([0], np.cumsum(x)))
                return sums[first[1:]] - sums[first[:-1]]

            sums = [np.diff(first), total(top.astype(np.int64)), total(logs), total(inside)]
            del logs, inside, c, top
            hmm, last = model.log10_likelihood(cls, first[:-1], np.diff(first), before)
            return [*sums, hmm], lists, last

        def rows(batch, whole: bool, sums, lists) -> pa.RecordBatch:
            flag = pa.array([whole] * batch.num_rows, pa.bool_())
            return pa.RecordBatch.from_arrays([batch.column("uid"), batch.column("doc_id"), flag, *map(pa.array, sums), lists], names)

        for batch, texts in slices(batches, most=3 * chunk):
            if len(texts) > 1 or len(texts[0]) <= 3 * chunk:
                sums, lists, _ = judge([Chunk(t) for t in texts])
                yield rows(batch, True, sums, lists)
                continue
            sums, last = None, None
            for c in chunks(texts[0], chunk):
                got, lists, last = judge([c], last)
                sums = got if sums is None else [a + b for a, b in zip(sums, got, strict=True)]
                yield rows(batch, False, got, lists)
            yield rows(batch, True, sums, pa.array([[]], pa.list_(pa.int64())))

    ready = docs.select(F.monotonically_increasing_id().alias("uid"), "doc_id", "text")
    part = materialise(ready.mapInArrow(work, SCORED.format(kind)), "hmm-scores")
    rare = part.select("uid", F.explode("rare").alias("h")).join(counts.select("h", "c"), "h").groupBy("uid").agg(
        F.count(F.lit(1)).alias("rare_known"), F.sum(F.log10(F.col("c") + 1.0)).alias("rare_log")
    )
    more = F.coalesce(F.col("rare_log"), F.lit(0.0))
    return part.where("whole").drop("rare").join(rare, "uid", "left").select(
        "doc_id", "n_tokens", (F.col("known") + F.coalesce(F.col("rare_known"), F.lit(0))).alias("n_known"),
        F.lit(lex.n).cast("long").alias("train_tokens"),
        (F.col("count_log") + more - F.col("n_tokens") * F.lit(float(np.log10(lex.n + lex.v + 1)))).alias("base_score"),
        (F.col("hmm") + F.col("class_log") + more).alias("score"),
    )


def fit(train: DataFrame, lex: Lexicon, chunk: int = CHUNK) -> tuple[Model, list[float]]:
    """The model, and the log-likelihood a token before each pass over all training documents."""
    prior = (lex.class_tokens + 0.5) / (lex.class_tokens + 0.5).sum()
    shared = train.sparkSession.sparkContext.broadcast(lex)
    at = new_path(train.sparkSession, "seeds")
    part = max(1, 2 ** 32 // max(1, min(SEED_SHARE, train.count() // SEED_DOCS)))  # of 2 ** 32
    seed = F.xxhash64("doc_id", "text")
    seeds = materialise(train.select(seed.alias("seed"), "text").where(F.shiftrightunsigned("seed", 32) < part), "seeds", path=at)
    model = begin(class_counts(seeds, shared, len(prior)), prior)
    model, _ = baum_welch(seeds, shared, model, prior, SEED_PASSES, chunk=chunk)
    discard(train.sparkSession, at)
    model, history = baum_welch(train, shared, model, prior, MOST_PASSES, TOLERANCE, chunk)
    shared.unpersist()
    return model, history


def fit_and_score(docs: DataFrame, modulus: int = 7, rest: int = 2, chunk: int = CHUNK) -> DataFrame:
    train = docs.where(~held_out(modulus, rest))
    counts = materialise(count_tokens(train), "token-counts")
    lex = Lexicon(counts)
    model, _ = fit(train, lex, chunk)
    return score_documents(docs, docs.sparkSession.sparkContext.broadcast((lex, model)), lex, counts, chunk)


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fit_and_score(documents(spark, sf_dir).select("doc_id", "text"))
    return out.withColumn("held_out", held_out(7)).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
