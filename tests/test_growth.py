"""What larger tables showed: each test fails without the change it names."""

from __future__ import annotations

import pytest

from conftest import normal


def test_letterbox_gray_at_halves(spark, tmp_path):
    """Parts whose gray ends in .5, of which doubles alone put some on the other side."""
    import duckdb

    from panelweave.plans import QUERIES, SQL

    con = duckdb.connect()
    w, h = "CAST(300 + k * 37 % 1500 AS DOUBLE) % 256 * 0.299", "CAST(200 + k * 53 % 2500 AS DOUBLE) % 256 * 0.587"
    differ = f"round_even({w} + {h} + k % 256 * 0.114, 0) <> round_even({w} + {h} + CAST(k % 256 AS DOUBLE) * 0.114::DOUBLE, 0)"
    con.execute(f"COPY (SELECT k AS p_partkey FROM range(1200000) r(k) WHERE {differ}) TO '{tmp_path}/part.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW part AS SELECT * FROM '{tmp_path}/part.parquet'")
    got, want = QUERIES["letterbox"](spark, str(tmp_path)).toPandas(), con.execute(SQL["letterbox"]).df()
    assert len(want) and normal(got) == normal(want)


@pytest.mark.parametrize("name", ["dark_runs", "border_bands", "border_bands_packed"])
def test_rasters_are_spread(name, spark, tmp_path):
    """A few bytes of suppliers are many pixels: they must not be worked on in one task."""
    from panelweave.plans import QUERIES, layout_queries

    spark.range(1, 3 * layout_queries.RASTERS * 4).withColumnRenamed("id", "s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    at = QUERIES[name](spark, str(tmp_path)).selectExpr("capture_id", "spark_partition_id() as at").distinct().toPandas()
    assert at["at"].nunique() >= 8 and at.groupby("at")["capture_id"].nunique().max() <= 2 * layout_queries.RASTERS


def shuffled(spark, run) -> int:
    """Records that the stages of ``run`` write to shuffles."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)

    def stages():
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        found = store.stageList(None, False, False, none, None)
        return {found.apply(i).stageId(): found.apply(i).shuffleWriteRecords() for i in range(found.size())}

    before = stages()
    run()
    return sum(n for stage, n in stages().items() if stage not in before)


@pytest.mark.parametrize("operator", ["fix_digits", "split_fused", "respell"])
def test_only_tokens_that_change_leave_their_text(operator, spark):
    """3000 lines of 60 tokens, of which two change: rows shuffled follow the lines, not the tokens."""
    from pyspark.sql import functions as F

    from panelweave.operators import lexicon_repair as lr

    lines = spark.range(3000).select("id", F.expr("concat(repeat('cat dog ', 29), 'c4t s00n isthere end')").alias("text"))
    table = spark.createDataFrame([("soon", "late"), ("there", "here"), ("end", "fin")], "word string, respelling string")
    found = []
    n = shuffled(spark, lambda: found.extend(getattr(lr, operator)(lines, ["id"], table).collect()))
    want = {"fix_digits": "c4t soon isthere end", "split_fused": "c4t s00n is there end", "respell": "c4t s00n isthere fin"}[operator]
    assert {r.fixed for r in found} == {"cat dog " * 29 + want} and len(found) == 3000
    assert n < 3000 * 6


def test_captures_are_dealt_whole(spark, data):
    """Words of a capture stay together from the text to their bubbles: rows shuffled are captures, not words."""
    from panelweave.plans import QUERIES
    from panelweave.sources import synth

    n = synth.captures(spark, data).count()
    assert shuffled(spark, lambda: QUERIES["text_lines"](spark, data).collect()) < 3 * n < synth.words(spark, data).count() / 8


@pytest.mark.parametrize("name", ["rescue_dedup", "rescued_words"])
def test_captures_are_rescued_whole(name, spark, data):
    """The same of words found twice."""
    from panelweave.plans import QUERIES
    from panelweave.sources import synth

    n = synth.captures(spark, data).count()
    assert shuffled(spark, lambda: QUERIES[name](spark, data).count()) < 5 * n < synth.words(spark, data).count() / 4


def test_alike_boxes_are_told_by_groups_and_by_blocks():
    """Groups of all sizes, one of several blocks, against a plain walk."""
    import numpy as np

    from panelweave.operators import detect

    rng = np.random.default_rng(5)
    group = np.sort(np.concatenate([rng.integers(0, 300, 900), np.full(1300, 400), np.full(3, 401)]))
    x, y = rng.integers(0, 60, len(group)).astype(float), rng.integers(0, 20, len(group)).astype(float)
    sides, kept = np.stack([x, y, x + 12, y + rng.integers(0, 12, len(group))]), []
    for i in range(len(group)):
        mine = [k for k in kept if group[k] == group[i]]
        if not mine or not detect._alike(tuple(v[i] for v in sides), tuple(v[mine] for v in sides), 0.6).any():
            kept.append(i)
    assert np.flatnonzero(detect.first_of_alike(group, sides, 0.6)).tolist() == kept and 600 < len(kept) < len(group) - 600


def test_one_row_group_is_spread(spark, tmp_path):
    """A file of many splits whose rows lie in one row group: every partition gets some, of tts_chunks too."""
    from panelweave.plans import QUERIES
    from panelweave.sources import synth

    spark.range(400).selectExpr("id as doc_id", "repeat(concat('Line ', id, '. '), 90) as text").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        splits = synth.table(spark, str(tmp_path), "documents").rdd.getNumPartitions()
        assert splits > spark.sparkContext.defaultParallelism
        assert QUERIES["tts_chunks"](spark, str(tmp_path)).selectExpr("spark_partition_id() as at").distinct().count() > splits / 2
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_long_runs_are_looked_at_once(spark):
    """200000 blanks, or letters, on end: patterns that begin anew inside a run take the square of it."""
    import time

    from pyspark.sql import functions as F

    from panelweave.functions import text as t

    runs = spark.range(1).selectExpr("concat('a', repeat(' ', 200000), 'b') as blanks", "repeat('c', 200000) as letters")
    began = time.time()
    got = runs.select(F.length(t.trimmed(F.col("blanks"))), F.length(t.join_hyphenated(F.col("letters")))).first()
    assert tuple(got) == (200002, 200000) and time.time() - began < 5


@pytest.mark.parametrize("name", ["noise_predicates", "capture_stats", "text_scalars"])
def test_lines_of_odd_words(name, spark, tmp_path):
    """Words about each limit of the rules, in lines of random make, against SQL."""
    import random

    import duckdb

    from panelweave.plans import QUERIES, SQL

    pick = random.Random(3)
    parts = ["a", "I", "x", "aaa", "bbb", "Hm", "oh", "...", "!", "-", "'", "  ", "\t", "=>", "class", "subclass", "VAR", "e" * 18, "abc" * 6, "abc" * 6 + "d", "a-b" * 9 + "c", "a.b" * 10, "9", "{", "so-and", "Ch. 7", "zun", "café", "aeiou"]
    texts = ["\n".join("".join(pick.choice(parts) + pick.choice(["", " ", " "]) for _ in range(pick.randrange(1, 7))) for _ in range(30)) for _ in range(60)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert normal(QUERIES[name](spark, str(tmp_path)).toPandas()) == normal(con.execute(SQL[name]).df())


def test_requests_answered_in_their_batch_leave_state_alone():
    """A hundred requests asked and answered in one batch: one look at state for each, nothing written for them."""
    from types import SimpleNamespace as Row
    from unittest.mock import MagicMock

    from panelweave.streaming import live

    step = live._Requests(1000, timers=False)
    step.at, step.open = MagicMock(), MagicMock()
    step.at.get.return_value, step.open.containsKey.return_value = None, False
    row = lambda i, kind: Row(kind=kind, ts_ms=i, seq=i, request_id=i, top=1, img_key="a")
    rows = [row(0, "position"), *(row(i, kind) for i in range(100) for kind in ("dispatch", "result")), row(200, "dispatch")]
    got = list(step.handleInputRows((7,), iter(rows), None))
    assert len(got) == 100 and {r.status for r in got} == {"ok"}
    assert len(step.open.mock_calls) == 101 and len(step.at.mock_calls) == 2
    step.open.updateValue.assert_called_once_with((200,), (1, "a", 200, 1000))


def test_captures_are_read_whole(spark, data, monkeypatch):
    """From its text to the order of its bubbles a capture is dealt once, with its crops, its second attempt and its page."""
    from panelweave.plans import reading
    from panelweave.sources import synth

    monkeypatch.setattr(reading, "_lexicon", lambda *_: spark.createDataFrame([("x",)], "word string"))
    monkeypatch.setattr(reading, "repair", lambda bubbles, *_: bubbles.select(*reading.KEYS, "text"))
    n, found = synth.captures(spark, data).count(), []
    assert shuffled(spark, lambda: found.append(reading.page_reading(spark, data).count())) < 2 * n and found[0] > n


def test_words_of_several_tokens_are_repaired(spark):
    """A word is told by itself, not by a token in it."""
    from panelweave.operators import lexicon_repair as lr

    texts = ["ofthe- sucha", "ofthe a", "S00N,the s00n, w1ll-s00n", "plain text-\nhere"]
    lines = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    lexicon, names = spark.createDataFrame([("soon",), ("will",)], "word string"), spark.createDataFrame([("the", "thee")], "word string, respelling string")
    got = [r.fixed for r in sorted(lr.repaired(lines, ["id"], lexicon, names).collect())]
    assert got == ["of thee such a", "of thee a", "SOON, thee soon, will soon", "plain text here"]


def test_table_function_takes_captures_whole(spark, data):
    """Rows shuffled are texts and captures, not words; columns are those of the boxes one by one, large captures' too."""
    from pyspark.sql import functions as F

    from panelweave.functions.tables import register_tables
    from panelweave.plans import QUERIES
    from panelweave.sources import synth

    n = synth.captures(spark, data).count()
    assert shuffled(spark, lambda: QUERIES["sql_word_columns"](spark, data).count()) < 3 * n
    register_tables(spark)
    boxes = [(c, i, float(i % 5 * 40), float(i // 5 * (12 + c)), float(i % 5 * 40 + 30), float(i // 5 * (12 + c) + 9)) for c in range(4) for i in range(1100 if c == 1 else 40)]
    b = spark.createDataFrame(boxes, "capture_id long, ix int, x0 double, y0 double, x1 double, y1 double")
    whole = b.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("ix", "x0", "y0", "x1", "y1"))).alias("rows"))
    got = spark.sql("SELECT capture_id, ix, label FROM stacked_captures(TABLE(SELECT * FROM {b}), 14.0D)", b=whole)
    want = spark.sql("SELECT * FROM stacked_boxes(TABLE(SELECT * FROM {b}) PARTITION BY capture_id ORDER BY (ix), 14.0D)", b=b)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_events_of_a_tab_reach_state_in_lists(spark):
    """A thousand events of a tab are four rows of its state's step, in order; no key is lost, nor one without a value."""
    import random

    from panelweave.streaming import live

    rows = [(tab, t, i, None if i % 7 == 0 else i % 5, None if i % 3 == 0 else "ab"[i % 2]) for tab in (None, -3, 5, 8) for i, t in enumerate(range(0, 5000, 5))] + [(9, 1, 1, 1, "a")]
    mixed = random.Random(5).sample(rows, len(rows))
    events = spark.createDataFrame(mixed, "tab_id long, ts_ms long, seq long, top long, img_key string")
    lists = live.gathered(events, "tab_id", ["ts_ms", "seq"]).collect()
    assert len(lists) == 17 and max(len(r.seq) for r in lists) == 256
    apart = [(r.tab_id, *x) for r in lists for x in zip(*r[1:], strict=True)]
    assert sorted(apart, key=str) == sorted(rows, key=str)
    assert all(list(r.ts_ms) == sorted(r.ts_ms) for r in lists)
    one = live._Apart(live._LastKept("tab_id", ["ts_ms"], None, None), ["ts_ms", "top"])
    one.step.init = lambda _: None
    one.step.handleInputRows = lambda key, rows, _: [(key, r.ts_ms, r.top) for r in rows]
    one.init(None)
    assert len(one.handleInputRows((8,), (r for r in lists if r.tab_id == 8), None)) == 1000
    assert sum(len(c.column(1)[k]) for c in [live._listed(events.toArrow().to_batches(), "tab_id", ["ts_ms"])] for k in range(c.num_rows)) == 4001
    assert list(live.gathered(events.where("tab_id > 100"), "tab_id", ["ts_ms"]).collect()) == []


def test_tabs_of_a_bucket_share_a_look_at_state():
    """Fifty tabs: what is kept of them is read once a batch and written once, and each goes on from its own."""
    from unittest.mock import MagicMock

    from pyspark.sql import Row
    from pyspark.sql import types as T

    from panelweave.streaming import live

    held, handle = [], MagicMock()
    state = handle.getListState.return_value
    state.get.side_effect = lambda: iter(list(held))
    state.put.side_effect = lambda rows: held.__setitem__(slice(None), rows)
    lists = lambda tab, ts: Row(_bucket=3, tab_id=tab, ts_ms=ts, seq=ts, top=[1] * len(ts), img_key=["a"] * len(ts))
    names, key = ["ts_ms", "seq", "top", "img_key"], T.StructField("tab_id", T.LongType())

    def batch(rows):
        step = live._Bucket(live._Positions(1000, 200, 1000, None, False), names, key)
        step.init(handle)
        return [(r.kind, r.tab_id, r.at_ms) for r in step.handleInputRows((3,), iter(rows), None)]

    tabs = [None, *range(49)]
    first = batch([lists(t, [10, 20]) for t in tabs] + [lists(7, [5, 30])])  # a tab's lists may be apart
    assert first == [("early", t, 10 if t == 7 else 20) for t in tabs]
    assert batch([lists(8, [1010]), lists(7, [1004, 1005])]) == [("settled", 8, 1010), ("settled", 7, 1005)]
    assert state.get.call_count == state.put.call_count == 2 and {x[0] for x in held} == set(tabs)
    assert not [c for c in handle.mock_calls if "getValueState" in str(c)]
