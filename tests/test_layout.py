"""Order-dependent operators on small cases and by properties."""

from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from panelweave.operators import layout, raster
from panelweave.operators.layout import Boxes

box = st.tuples(st.integers(0, 400), st.integers(0, 400), st.integers(1, 90), st.integers(1, 60)).map(lambda t: (t[0], t[1], t[0] + t[2], t[1] + t[3]))


def boxes(rows) -> Boxes:
    return Boxes(*(np.array([r[k] for r in rows], float) for k in range(4)))


@settings(max_examples=60, deadline=None)
@given(st.lists(box, max_size=14), st.booleans())
def test_order_is_a_permutation(rows, rtl):
    assert sorted(layout.order_flat(boxes(rows), rtl)) == list(range(len(rows)))


@settings(max_examples=60, deadline=None)
@given(st.lists(box, min_size=1, max_size=14), st.integers(0, 10**6))
def test_clusters_do_not_depend_on_input_order(rows, seed):
    perm = np.random.default_rng(seed).permutation(len(rows))
    a = layout.components(layout.stacked(boxes(rows), 400.0))
    b = layout.components(layout.stacked(boxes([rows[i] for i in perm]), 400.0))
    sets = lambda label, names: {frozenset(names[label == k]) for k in label}
    assert sets(a, np.arange(len(rows))) == sets(b, perm)


def test_orphan_is_spliced_only_when_close():
    near = boxes([(0, 0, 50, 100), (200, 0, 250, 100), (100, 110, 150, 200)])
    assert layout.order_flat(near, False) == [0, 2, 1]
    assert layout.order_flat(near, True) == [1, 2, 0]
    far = boxes([(0, 0, 50, 100), (200, 0, 250, 100), (100, 250, 150, 340)])
    assert layout.order_flat(far, False) == [0, 1, 2]


def test_words_of_different_columns_do_not_join():
    words = layout.Items(
        Boxes([0, 0, 44, 44], [0, 12, 0, 12], [40, 40, 90, 90], [10, 22, 10, 22]), np.array(["GRAB", "IT", "GONNA", "GO"], object), np.full(4, 90.0), np.array([0, 0, 4, 4])
    )
    lines = layout.words_to_lines(words, np.full(3, 500.0), np.full(3, 300.0))
    assert lines.text.tolist() == ["GRAB", "IT", "GONNA", "GO"] and lines.first.tolist() == [0, 0, 4, 4]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(box, max_size=9), min_size=1, max_size=6))
def test_stacks_of_captures_equal_single_ones(captures):
    flat = [r for c in captures for r in c]
    first = np.concatenate(([0], np.cumsum([len(c) for c in captures])))
    items = layout.Items(boxes(flat) if flat else Boxes([], [], [], []), np.array([str(i) for i in range(len(flat))], object), np.ones(len(flat)), first)
    got = items.labels(lambda b, c, _: layout.stacked(b, 400.0), most=120)
    want = [x for c in captures if c for x in layout.components(layout.stacked(boxes(c), 400.0)).tolist()]
    assert got.tolist() == want


@settings(max_examples=60, deadline=None)
@given(st.lists(box, min_size=1, max_size=30), st.integers(1, 40))
def test_sweeps_equal_matrices(rows, most):
    b = boxes(rows)
    pairs_of = lambda link: lambda p: link(Boxes(*(v[p] for v in b.sides)))[:, 0, 1]
    for link, reach in ((lambda x: layout.stacked(x, 400.0), layout.stacked_reach(b, 400.0)), (layout.same_row, layout.same_row_reach(b))):
        want = layout.components(link(b)).tolist()
        assert layout.swept(b, reach, pairs_of(link), most).tolist() == want
        assert layout.swept(b, (np.full(len(b), np.inf),) * 2, pairs_of(link), most).tolist() == want


def grid(n, seed=3):
    rng, per = np.random.default_rng(seed), int(n**0.5)
    i = np.arange(n)
    x, y = (i % per) * 60 + rng.integers(0, 9, n), (i // per) * 22 + rng.integers(0, 7, n)
    b = Boxes(x, y, x + 38 + rng.integers(0, 19, n), y + 14 + rng.integers(0, 3, n))
    items = layout.Items(b, np.array([f"w{k}" for k in i], object), rng.integers(40, 100, n).astype(float), np.array([0, n]))
    return items, np.array([per * 60.0]), np.array([(n // per + 1) * 22.0])


def test_large_captures_are_what_small_ones_are(monkeypatch):
    def run():
        words, w, h = grid(900)
        lines = layout.words_to_lines(words, w, h)
        out = layout.lines_to_bubbles(lines, h)
        return lines.text.tolist(), out.text.tolist(), [v.tolist() for v in out.box.sides], layout.order_flat(lines.box, True)

    small = run()
    monkeypatch.setattr(layout, "LARGE", 10)
    assert run() == small


def test_a_hundred_thousand_boxes_in_one_capture():
    import tracemalloc

    words, w, h = grid(100_000)
    tracemalloc.start()
    lines = layout.words_to_lines(words, w, h)
    bubbles = layout.lines_to_bubbles(lines, h)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 1e9 and sum(len(t.split()) for t in bubbles.text) == 100_000


def test_panels_first():
    cut = (np.array([200.0]), np.array([0.0]), np.array([400.0]))
    b = boxes([(10, 10, 60, 40), (300, 10, 360, 40), (10, 200, 60, 240), (300, 200, 360, 240)])
    assert layout.order(b, False, cut, 0, 400.0) == [0, 2, 1, 3]
    assert layout.order(b, False, tuple(v[:0] for v in cut), 0, 400.0) == [0, 1, 2, 3]


def test_raster_forms_agree(spark):
    rng = np.random.default_rng(3)
    gray = rng.integers(90, 255, (70, 110)).astype(np.uint8)
    gray[1, :] = 0
    gray[30:33, 0:100] = 10
    gray[10:60, 50:52] = 20
    o = raster.Options(least_length=30)
    want = raster.bands_of(gray, o)
    rows = [(1, x, y, int(gray[y, x])) for y in range(70) for x in range(110)]
    px = spark.createDataFrame(rows, "capture_id long, x int, y int, g int")
    sizes = spark.createDataFrame([(1, 110, 70)], "capture_id long, width int, height int")
    got = raster.border_bands(px, sizes, o).drop("capture_id").toPandas()
    key = lambda d: sorted(map(tuple, d.to_numpy().tolist()))
    assert key(got) == key(want) and len(want)
    grouped = raster.border_bands_grouped(spark.createDataFrame([(1, 110, 70, gray.tobytes())], "capture_id long, width int, height int, gray binary"), o)
    assert key(grouped.drop("capture_id").toPandas()) == key(want)


def test_survivors_keep_their_distance(spark, data):
    from panelweave.operators import detect
    from panelweave.sources import synth

    kept = detect.nms(detect.decode(synth.anchors(spark, data))).toPandas()
    for _, rows in kept.groupby("capture_id"):
        b = rows[["x0", "y0", "x1", "y1"]].to_numpy()
        for i in range(len(b)):
            for j in range(i):
                w, h = (min(b[i][k + 2], b[j][k + 2]) - max(b[i][k], b[j][k]) for k in (0, 1))
                inter = max(0, w) * max(0, h)
                area = lambda q: (q[2] - q[0]) * (q[3] - q[1])
                assert inter / (area(b[i]) + area(b[j]) - inter + 1e-9) < 0.35


def plain_order(b, rtl, panel):
    """One capture: its panels as one box each, then the boxes of each panel."""
    if not len(b):
        return []
    groups = [np.flatnonzero(panel == k) for k in np.unique(panel)]
    out = []
    for k in layout.order_flat(b.union(groups), rtl):
        own = groups[k]
        out += own[layout.order_flat(layout.Boxes(*(v[own] for v in b.sides)), rtl)].tolist()
    return out


@pytest.mark.parametrize("seed", range(8))
def test_orders_of_many_captures_at_once_equal_those_of_each(seed):
    """Ties, empty captures, lone boxes close below rows, both directions, several panels."""
    rng = np.random.default_rng(seed)
    size = rng.integers(0, 14, 120)
    first = np.concatenate(([0], np.cumsum(size)))
    n = int(first[-1])
    x, y = rng.integers(0, 12, n) * 10.0, rng.integers(0, 8, n) * 10.0
    b = layout.Boxes(x, y, x + rng.integers(0, 5, n) * 10, y + rng.integers(0, 4, n) * 6)
    rtl, panel = rng.random(120) < 0.5, rng.integers(0, 1 + seed % 4, n)
    want, spliced = [], 0
    for c, (a, e) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        own = layout.Boxes(*(v[a:e] for v in b.sides))
        want += [a + k for k in plain_order(own, bool(rtl[c]), panel[a:e])]
        rows = layout.reading_rows(own, bool(rtl[c]))
        spliced += layout.splice_orphans(rows, own, bool(rtl[c])) != rows
    assert layout.panel_orders(b, first, rtl, panel).tolist() == want and spliced > 10


def test_order_of_a_large_capture():
    rng = np.random.default_rng(5)
    n = layout.LARGE + 300
    x, y = rng.random(n) * 1000, rng.random(n) * 40000
    b = layout.Boxes(x, y, x + 30, y + 12)
    assert layout.panel_orders(b, np.array([0, n]), np.array([True]), np.zeros(n, int)).tolist() == layout.order_flat(b, True)


def test_panels_of_many_captures_are_those_of_each():
    rng = np.random.default_rng(5)
    size, n_cuts, n_h, page_w = rng.integers(0, 9, 400), rng.integers(0, 7, 400), rng.integers(0, 2, 400), rng.choice([0.0, 300.0, 520.0], 400)
    n_cuts[:3] = 40
    first, cut_first = (np.concatenate(([0], np.cumsum(v))) for v in (size, n_cuts))
    x0, y0 = rng.integers(0, 500, size.sum()), rng.integers(0, 200, size.sum())
    b = Boxes(x0, y0, x0 + rng.integers(1, 90, len(x0)), y0 + rng.integers(1, 60, len(x0)))
    # Few different values, so that heights tie; some cuts have none.
    cuts = np.stack((rng.integers(0, 52, n_cuts.sum()) * 10.0, rng.integers(0, 3, n_cuts.sum()) * 10.0, rng.integers(0, 5, n_cuts.sum()) * 50.0))
    got = layout.panels_of_captures(b, first, cuts, cut_first, n_h, page_w, most=200)
    for c in range(len(size)):
        at = slice(first[c], first[c + 1])
        own = tuple(cuts[:, cut_first[c] : cut_first[c + 1]])
        want = layout.panels_by_cuts(Boxes(*(v[at] for v in b.sides)), own, int(n_h[c]), page_w[c] or None)
        assert size[c] < 2 or got[at].tolist() == want.tolist(), c
