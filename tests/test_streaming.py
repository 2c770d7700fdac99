"""Batch forms of the stream operators against plain Python."""

from __future__ import annotations

from panelweave.streaming import viewport


def test_topmost_compares_with_the_rounded_best(spark):
    rows = [(1, 1, 10.4), (1, 2, 10.2), (1, 3, 9.9), (2, 1, 7.5), (2, 2, 7.9), (3, 1, -0.5)]
    got = {r.tab_id: (r.top, r.img) for r in viewport.topmost(spark.createDataFrame(rows, "tab_id long, img long, top double")).collect()}
    # 10.4 is remembered as 10, so 10.2 does not replace it; 7.5 as 8, so 7.9 does.
    assert got == {1: (10, 3), 2: (8, 2), 3: (0, 1)}


def test_walks_hold_only_the_last_row(spark):
    rows = [(t, 100 * i, i, (i * 7) % 5 * 100, "a" if i % 9 else None, 250) for t in range(5) for i in range(400)]
    e = spark.createDataFrame(rows, "tab_id long, ts_ms long, seq long, top long, img_key string, took_ms long")

    def brute(keep):
        out, last = [], {}
        for r in sorted(rows):
            if r[0] not in last or keep(last[r[0]], r):
                last[r[0]] = r
                out.append(r[:3])
        return out

    same = lambda a, b: None not in (a[4], b[4]) and a[4] == b[4] and abs(a[3] - b[3]) <= 150
    for found, keep in (
        (viewport.fresh_positions(e, 1000.0), lambda a, b: not same(a, b)),
        (viewport.throttled(e, 350), lambda a, b: b[1] - a[1] >= 350),
        (viewport.single_flight(e), lambda a, b: b[1] >= a[1] + a[5]),
    ):
        assert sorted((r.tab_id, r.ts_ms, r.seq) for r in found.collect()) == brute(keep)
    assert viewport.throttled(e.where("false")).count() == 0
