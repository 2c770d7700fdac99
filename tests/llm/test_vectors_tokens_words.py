"""Whitening, token counts and spelling variants against brute force."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

from panelweave.llm import spelling, token_counts, whitening

FILE = public_tokenizers.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- whitening


def brute_whitening(rows, k=16):
    """(x by row, n, S, eigenvalues, vectors) from exact integers and numpy's symmetric solver."""
    xs = [(i, tuple(math.floor(64 * float(c)) + 1000000 for c in v)) for i, v in rows]
    fit = sorted({x for _, x in xs})
    n, s = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    centred = np.array([[(n * a - b) / n for a, b in zip(x, s, strict=True)] for x in fit])
    e, v = np.linalg.eigh(centred.T @ centred / n)
    return xs, n, s, e[::-1][:k], v[:, ::-1][:, :k], e.sum()


def check_whitening(got, rows, k=16):
    xs, n, s, e, v, trace = brute_whitening(rows, k)
    k = len(e)
    assert len(got) == len(xs) * k
    by = {}
    for r in got:
        by.setdefault(r.vec_id, []).append(r)
    signs = None
    for i, x in xs:
        mine = sorted(by[i], key=lambda r: r.component)[: k]
        assert [r.component for r in mine] == list(range(1, k + 1))
        assert all(r.n == n and r.deviation == sum((n * a - b) ** 2 for a, b in zip(x, s, strict=True)) for r in mine)
        want = np.array([(n * a - b) / n for a, b in zip(x, s, strict=True)]) @ v / np.sqrt(e)
        w = np.array([r.whitened for r in mine])
        if signs is None and (np.abs(want) > 1e-3).all():
            signs = np.sign(w * want)
        if signs is not None:
            assert np.allclose(w, signs * want, atol=1e-6)
        assert np.allclose([r.explained for r in mine], e / trace, rtol=1e-8)
    error = {r.identity_error for r in got}
    assert len(error) == 1 and max(error) < 1e-9


def test_whitening_query(spark, data):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{data}/embeddings.parquet").collect()]
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    check_whitening(whitening.op11_whitening(spark, data).collect(), good)


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(3)
    base = [(i, rng.standard_normal(5).round(2).tolist()) for i in range(60)]
    rows = [*base, *[(100 + i, base[0][1]) for i in range(30)]]
    odd = [(None, None), (201, None), (202, []), (203, [1.0, None, 1.0, 1.0, 1.0]), (204, [float("nan")] * 5), (205, [float("-inf")] * 5), (206, [1e300] * 5), (207, [1.0, 2.0])]
    table = spark.createDataFrame([*rows, *odd], "vec_id long, embedding array<double>").withColumns({c: F.lit(1) for c in ("n", "x", "component")})
    check_whitening(whitening.whiten(whitening.integers(table.repartition(7))).collect(), rows)
    two = spark.createDataFrame([(1, [3.0, 7.0, 1.0]), (2, [3.0, 7.0, 2.0]), (None, [3.0, 7.0, 2.0])], "vec_id long, embedding array<float>")
    got = whitening.whiten(whitening.integers(two)).collect()  # one direction varies
    assert sorted((r.vec_id or 0, abs(round(r.whitened, 9)), r.explained) for r in got) == [(0, 1.0, 1.0), (1, 1.0, 1.0), (2, 1.0, 1.0)]
    assert whitening.whiten(whitening.integers(two.limit(1))).count() == 0
    assert whitening.whiten(whitening.integers(table.limit(0))).columns == ["vec_id", *(c.split()[0] for c in whitening.OUT.split(", "))]


def test_triangles_meet_in_rounds(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(-50, 50, (300, 6)) + 1000000
    fit = spark.createDataFrame([(x.tolist(),) for x in a], "x array<long>").repartition(9)
    mean = whitening.mean_of(fit)
    assert mean.n == 300 and mean.sums == a.sum(0).tolist()
    r = whitening.triangle(fit, mean, fan=2)
    c = a - a.mean(0)
    assert r.shape == (6, 6) and np.allclose(r.T @ r, c.T @ c)


def test_jacobi_keeps_small_deviations():
    rng = np.random.default_rng(5)
    for d in (1, 2, 3, 17, 64):
        r = np.linalg.qr(rng.standard_normal((200, d)) * np.logspace(0, -9, d), mode="r")
        sigma, v = whitening.one_sided_jacobi(r)
        assert np.allclose(sigma, np.linalg.svd(r, compute_uv=False), rtol=1e-8)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-12) and np.allclose(np.abs((r @ v).T @ (r @ v)), np.diag(sigma**2), atol=1e-12)
    assert whitening.one_sided_jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def test_deviations_beyond_a_long():
    mean = whitening.Mean(2, [0, 1])
    assert mean.deviation(np.array([[1, 1], [1 << 40, 0]])) == [4 + 1, None]


# ---------------------------------------------------------------- token counts


@pytest.fixture(scope="module")
def library():
    return tokenizers.Tokenizer.from_file(FILE)


@pytest.fixture(scope="module")
def counter():
    return token_counts.Tokenizer(FILE)


def awkward():
    rng, out = random.Random(1), []
    for letters in ("ab 'srtvel dm\n\t19é!?.中　 ñ'  ", "'rl lev \n", "ab-= "):
        out += ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(3000)]
    out += ["".join(chr(rng.choice([rng.randrange(32, 127), rng.randrange(0x20, 0x2000), rng.randrange(0x1F000, 0x1FFFF)])) for _ in range(rng.randrange(300))) for _ in range(500)]
    out += ["", " ", "\n\n", "'", "'r", "'re", "a'll'l", "<|endoftext|>", " <|endoftext|> x", "a  <|endoftext|>\n\n<|endoftext|>", "<|endof", "a\0b\0", "\0", "日本語" * 200, "x" * 700 + " " * 700 + "y"]
    return out + [c * n for c in "a-= Ã" for n in (1, 63, 64, 65, 128, 129, 1000, 5000)]


def test_classes_are_the_librarys(counter, library):
    border = {"letter": "x", "number": "1", "other": "!", "quote": "!", "space": "\n", "white": "\n"} | dict.fromkeys(token_counts.LETTERS, "x")
    pre, kinds = library.pre_tokenizer, counter.splitter.classes
    for c in [*range(0x3000), *range(0xE000, 0x12000), *range(0x1D000, 0x20000), *range(0x30000, 0x33000), 0x10FFFF]:
        b = border[token_counts.CLASSES[kinds[c]]]
        assert len(pre.pre_tokenize_str(b + chr(c) + b)) == 1, hex(c)


def test_counts_are_the_librarys(counter, library, monkeypatch):
    texts = awkward()
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want
    monkeypatch.setattr(token_counts, "MOST_STATES", 50)  # forgotten again and again
    monkeypatch.setattr(token_counts, "BLOCK", 97)  # long texts in parts
    monkeypatch.setattr(token_counts, "CHUNK", 5)
    monkeypatch.setattr(token_counts, "TOGETHER", 7)
    assert counter.count(texts).tolist() == want


def test_chunk_maps_compose(counter):
    s, rng = counter.splitter, np.random.default_rng(2)
    kinds = rng.integers(0, len(token_counts.CLASSES), 900).astype(np.uint8)
    maps = s.scan(s.chunk_maps(np.ascontiguousarray(kinds.reshape(-1, 20).T)))
    for start in range(len(token_counts.STATES)):
        state = start
        for i, c in enumerate(kinds):
            state = s.next[state, c]
            if i % 20 == 19:
                assert maps[i // 20, start] == state


def test_token_counts_query(spark, data, library):
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.op12_token_counts(spark, data).collect()}
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    want = {i: (len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 1024) for i, t in docs.items()}
    assert got == want


def test_token_counts_of_odd_rows(spark):
    rows = [(None, None), (1, None), (1, ""), (2, "<|endoftext|>"), (2, "<|endoftext|>"), (3, "word " * 2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n_tokens": F.lit(1), "over_limit": F.lit(2)})
    got = token_counts.count_tokens(docs, FILE).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(None, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (2, 13, 1, False), (2, 13, 1, False), (3, 10000, 2001, True)], key=str)
    assert token_counts.count_tokens(docs.limit(0), FILE).columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]


# ---------------------------------------------------------------- spelling variants


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 2 * counts[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


@pytest.mark.parametrize(("letters", "sizes", "n"), [("ab", (5, 8), 220), ("abcé", (2, 7), 400), ("xyzÿ", (1, 4), 150), ("aé", (9, 14), 400)])
def test_variants_against_all_pairs(spark, letters, sizes, n):
    rng = random.Random(len(letters) * n)
    counts = {"".join(rng.choice(letters) for _ in range(rng.randint(*sizes))): int(2 ** rng.uniform(1.6, 12)) for _ in range(n)}
    got = spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long"))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == brute_variants(counts)


def test_long_paths_end_at_their_root(spark):
    counts = {"q" * i + "rstuv": 3 * 2**i for i in range(30)}
    got = spelling.variants(spark.createDataFrame([*counts.items()], "word string, n long")).collect()
    assert {r.root for r in got} == {"q" * 29 + "rstuv"} and len(got) == 30


def brute_words(rows):
    out = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate({c: c + 32 for c in range(65, 91)})
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


@pytest.mark.parametrize("slice_size", [1 << 20, 7])
def test_words_are_counted_over_whole_texts(spark, data, monkeypatch, slice_size):
    monkeypatch.setattr(spelling, "SLICE", slice_size)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    rows = [(i, t[:400] if t and slice_size < 100 else t) for i, t in rows]  # many slices of shorter texts
    rows += [(None, "ÀB×cd÷e ÉTÉÉÉ"), (None, None), (5, ""), *[(7, "ab" * 200 + "-x")] * 3, *[(None, "Straße STRASSE")] * 3]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"run": F.lit(1), "word": F.lit(2), "n": F.lit(3)})
    words = spelling.runs(docs).select(spelling.damaged(F.col("doc_id"), F.col("run")).alias("word"))
    assert {r.word: r.n for r in spelling.counted(words).collect()} == brute_words(rows)


def test_no_words(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "1 2 3")], "doc_id long, text string")
    assert spelling.variants(spelling.counted(spelling.runs(docs).select(F.col("run").alias("word")))).count() == 0


def test_no_join_of_words_goes_through_the_driver(spark, monkeypatch):
    """Spark takes the keys for as small as their words; a broadcast of them fills the driver."""
    plans, write = [], spelling.materialise
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(spelling, "materialise", lambda df, *a, **b: (plans.append(plan(df)), write(df, *a, **b))[1])
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, 10 << 20)
    try:
        got = spelling.variants(spark.createDataFrame([("silver", 9), ("silvr", 3), ("silvrq", 1)], "word string, n long"))
        assert {(r.word, r.form, r.root) for r in got.collect()} == {("silver", None, "silver"), ("silvr", "silver", "silver"), ("silvrq", "silvr", "silver")}
        joined = [p for p in [*plans, plan(got)] if "Join" in p]
        assert len(joined) >= 3 and not any("Broadcast" in p for p in joined)
    finally:
        spark.conf.set(threshold, before)
