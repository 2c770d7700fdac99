"""The pipeline and the registered queries of this subpackage."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pytest

import corpus_pipeline
from panelweave.llm import language_id, packing, queries

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = {i: i + 32 for i in range(65, 91)}


def _lines(docs):
    """Line dedup in plain Python: id -> text."""
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOW)
    held = defaultdict(set)
    for i, t in docs.items():
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    keeper = {k: max(v) for k, v in held.items() if len(v) >= 5}
    out = {}
    for i, t in docs.items():
        left = [x for x in (t or "").split("\n") if keeper.get(key(x), i) == i]
        out[i] = t if len(left) == len((t or "").split("\n")) else "\n".join(left)
    return out


def _one_of_each(docs):
    """The smallest id of each group of near duplicates, by comparing all pairs of five-word shingle sets."""
    sets = {}
    for i, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    ids = sorted(docs)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: t for i, t in docs.items() if find(i) == i}


def _decontaminated(docs, items):
    windows = defaultdict(set)
    for t in items:
        w = ALNUM.findall((t or "").translate(LOW))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[n].add(tuple(w[k : k + n]))
    out = {}
    for i, t in docs.items():
        places = [(m.start(), m.end()) for m in ALNUM.finditer((t or "").translate(LOW))]
        w = ALNUM.findall((t or "").translate(LOW))
        hit = set()
        for n, known in windows.items():
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in known:
                    hit |= set(range(k, k + n))
        kept, at = [], 0
        for k in sorted(hit):
            if k - 1 not in hit:
                kept.append(t[at : places[k][0]])
            if k + 1 not in hit:
                at = places[k][1]
        out[i] = " ".join([*kept, t[at:]]) if hit else t
    return out


def test_pipeline_against_plain_python(spark, data):
    got = corpus_pipeline.run(spark, data).collect()
    table = spark.read.parquet(f"{data}/documents.parquet")
    judge = language_id.Classifier(language_id.fit(table.select("doc_id", "text", "lang"))).judge
    docs = {r.doc_id: r.text for r in table.collect()}
    told = {i: judge((t or "").encode()) for i, t in docs.items()}
    docs = {i: t for i, t in docs.items() if told[i][0] != "und" and told[i][1] >= language_id.NARROW}
    docs = _one_of_each(_lines(docs))
    docs = _decontaminated(docs, [r.text for r in spark.read.parquet(f"{data}/benchmark.parquet").collect()])
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t in docs.items():
        ids = np.array([*encode(t or ""), 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        want += [(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    used = defaultdict(list)
    for r in got:
        used[r.sequence_id].append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert all(o == sum(n for _, n in parts[:k]) for k, (o, _) in enumerate(parts)) and sum(n for _, n in parts) <= 2048
    assert len(used) == -(-sum(x[3] for x in want) // 2048)


def test_pipeline_runs_and_stages_take_effect(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline._shared.materialise(stage(spark, docs, data), name)
        if name != "packing":
            assert out.columns == docs.columns and out.count() <= docs.count()
            docs = out
    assert 0.8 * before < docs.count() < before
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in out.select("doc_id").collect()} == ids
    from panelweave.llm import decontamination

    found = decontamination.find_contamination(docs.select("text"), spark.read.parquet(f"{data}/benchmark.parquet"))
    assert found.where("size(spans) > 0").count() == 0


#: The columns that each query must return.
CONTRACT = {
    "op1": "query_id rank vec_id score",
    "op2": "doc_id n_words n_base first_word last_word base_labels labels score",
    "op3": "doc_id n_lines n_dropped kept_sha256",
    "op4": "doc_id piece start length ids_crc32 sequence_id offset",
    "op5": "doc_id held_out lang_pred score",
    "op6": "doc_id n_shingles component_id",
    "op7": "doc_id size text_crc32 law shard slot grown_shard",
    "op8": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op10": "doc_id n_bytes n_removed n_spans kept_sha256",
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query(name, spark, duck, data):
    from conftest import normal

    got = queries.queries()[name](spark, data).toPandas()
    assert len(got)
    assert set(CONTRACT[name.split("_")[0]].split()) <= set(got.columns)
    if name in queries.oracle_sql():
        assert normal(got) == normal(duck.sql(queries.oracle_sql()[name]).df())
