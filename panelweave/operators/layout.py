"""From word boxes to ordered bubbles.

The rows of a capture are gathered into one array column (one shuffle on capture_id), and Arrow batches of many captures
are worked on together: predicates compare all pairs of a capture in matrices that are stacked over captures of like
size, so no Python runs per capture until lines are put together. A capture of over LARGE boxes is swept instead: only
boxes whose reach meets on both axes are compared, some at a time, and joined in a union-find, so memory follows the
number of boxes. Only the order-dependent splice and the panel claims go capture by capture.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box, boxes_overlap
from .noise import verdicts

# Fixed values of the clustering and ordering rules.
SAME_COLUMN, GAP_HEIGHTS, GAP_PAGE = 0.6, 1.3, 0.015
LINE_DRIFT, LINE_GAP_HEIGHTS, LINE_GAP_PAGE = 0.2, 1.0, 0.01
SAME_ROW, ORPHAN_GAP = 0.35, 0.5
PANEL_WIDTH, PANEL_OVERLAP = 0.08, 0.7
LARGE = 1024  # boxes of a capture beyond which it is swept


class Boxes:
    """Boxes of one capture as arrays."""

    def __init__(self, x0, y0, x1, y1):
        self.x0, self.y0, self.x1, self.y1 = (np.asarray(v, float) for v in (x0, y0, x1, y1))

    def __len__(self) -> int:
        return self.x0.shape[-1]

    @property
    def sides(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        return self.x0, self.y0, self.x1, self.y1

    @property
    def height(self) -> np.ndarray:
        return self.y1 - self.y0

    def union(self, groups: list[np.ndarray]) -> Boxes:
        return Boxes(*([f(v[g]) for g in groups] for f, v in ((np.min, self.x0), (np.min, self.y0), (np.max, self.x1), (np.max, self.y1))))


def _each(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return v[..., :, None], v[..., None, :]


def _share(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Overlap of each two intervals over the shorter one; 0 where that has no length."""
    (lo_a, lo_b), (hi_a, hi_b), (a, b) = _each(lo), _each(hi), _each(hi - lo)
    least = np.minimum(a, b)
    both = np.maximum(0, np.minimum(hi_a, hi_b) - np.maximum(lo_a, lo_b))
    return np.where(least > 0, both / np.where(least > 0, least, 1), 0)


def _gap(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    (lo_a, lo_b), (hi_a, hi_b) = _each(lo), _each(hi)
    return np.maximum(0, np.where(lo_a <= lo_b, lo_b - hi_a, lo_a - hi_b))


def stacked(b: Boxes, page_h) -> np.ndarray:
    """Which boxes stand in one column, closely above each other."""
    least = np.minimum(*_each(b.height))
    return (_share(b.x0, b.x1) > SAME_COLUMN) & (_gap(b.y0, b.y1) < np.maximum(GAP_HEIGHTS * least, GAP_PAGE * page_h))


def in_line(b: Boxes, page_w, column: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which words stand on one line; not across columns that both have several words (``size`` of each word's column)."""
    (mid_a, mid_b), (h_a, h_b), (col_a, col_b), (size_a, size_b) = _each((b.y0 + b.y1) / 2), _each(b.height), _each(column), _each(size)
    mean = (h_a + h_b) / 2
    level = np.abs(mid_a - mid_b) <= LINE_DRIFT * mean
    apart = (col_a != col_b) & (size_a >= 2) & (size_b >= 2)
    return level & ~apart & (_gap(b.x0, b.x1) < np.maximum(LINE_GAP_HEIGHTS * mean, LINE_GAP_PAGE * page_w))


def same_row(b: Boxes) -> np.ndarray:
    return _share(b.y0, b.y1) > SAME_ROW


def components(linked: np.ndarray) -> np.ndarray:
    """Smallest index that each one reaches by links: minimum over neighbours, then pointer jumps, until stable.
    Works on one matrix or a stack of them."""
    n = linked.shape[-1]
    label = np.broadcast_to(np.arange(n), linked.shape[:-1])
    while n:
        new = np.minimum(label, np.where(linked, label[..., None, :], n).min(axis=-1))
        new = np.take_along_axis(new, new, axis=-1)
        if (new == label).all():
            break
        label = new
    return label


def joined(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Labels (the smallest member of each one's set) after the sets of each u and v are joined."""
    while True:
        a, b = label[u], label[v]
        if (a == b).all():
            return label
        least = np.minimum(a, b)
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        while (label[label] != label).any():
            label = label[label]


def swept(b: Boxes, reach: tuple[np.ndarray, np.ndarray], linked: Callable[[np.ndarray], np.ndarray], most: int = 1 << 20) -> np.ndarray:
    """The labels of ``components`` for many boxes. ``reach``: how far beyond its right and lower side a box can be linked
    to one that begins there. ``linked``: which of these pairs (rows of two places) are. At most about ``most`` pairs are
    held at a time; the axis with fewer to compare is swept."""
    n, label = len(b), np.arange(len(b))
    sides = ((b.x0, b.x1 + reach[0]), (b.y0, b.y1 + reach[1]))

    def windows(lo: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        order = np.argsort(lo, kind="stable")
        return order, np.maximum(0, np.searchsorted(lo[order], far[order], "right") - np.arange(n) - 1)

    (order, count), (lo, far) = min(((windows(*own), other) for own, other in (sides, sides[::-1])), key=lambda x: int(x[0][1].sum()))
    total = np.concatenate(([0], np.cumsum(count)))
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(total, total[at] + most, "right")) - 1)
        k = np.repeat(np.arange(at, end), count[at:end])
        pairs = order[np.stack((k, k + 1 + np.arange(len(k)) - (total[k] - total[at])), axis=1)]
        u, v = pairs[:, 0], pairs[:, 1]
        pairs = pairs[(lo[v] <= far[u]) & (lo[u] <= far[v])]
        pairs = pairs[linked(pairs)]
        label = joined(label, pairs[:, 0], pairs[:, 1])
        at = end
    return label


def stacked_reach(b: Boxes, page_h) -> tuple[np.ndarray, np.ndarray]:
    return np.zeros(len(b)), np.maximum(GAP_HEIGHTS * b.height, GAP_PAGE * page_h)


def in_line_reach(b: Boxes, page_w) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(LINE_GAP_HEIGHTS * (b.height + b.height.max(initial=0)) / 2, LINE_GAP_PAGE * page_w), np.zeros(len(b))


def same_row_reach(b: Boxes) -> tuple[np.ndarray, np.ndarray]:
    return np.full(len(b), np.inf), np.zeros(len(b))


def groups_of(label: np.ndarray) -> list[np.ndarray]:
    order = np.argsort(label, kind="stable")
    return np.split(order, np.flatnonzero(np.diff(label[order])) + 1) if len(label) else []


def _arrow(text: pa.Array | np.ndarray) -> pa.Array:
    return text if isinstance(text, pa.Array) else pa.array(text, pa.string())


def _as_given(text: pa.Array, like: pa.Array | np.ndarray) -> pa.Array | np.ndarray:
    return text if isinstance(like, pa.Array) else text.to_numpy(zero_copy_only=False)


class Items:
    """Boxes of several captures, one after another: ``first[c]`` is the index of capture c's first. Texts may be in an Arrow
    array or in numpy's, and stay so."""

    def __init__(self, box: Boxes, text: pa.Array | np.ndarray, confidence: np.ndarray, first: np.ndarray):
        self.box, self.text, self.confidence, self.first = box, text, confidence, first

    def labels(
        self, link: Callable[[Boxes, np.ndarray, np.ndarray], np.ndarray], reach: Callable[[Boxes, np.ndarray], tuple[np.ndarray, np.ndarray]] | None = None, most: int = 1 << 16
    ) -> np.ndarray:
        """For each item the first item of its cluster, as a place in its capture. Captures are taken by size, so that
        stacks of matrices are even and hold about ``most`` pairs, few enough for a core's cache. A matrix only says which
        boxes are in ``reach`` (boxes, their captures) of each other, all without one; ``link`` (boxes two by two, their
        captures, flat places) judges those. Large captures are swept."""
        n, size = int(self.first[-1]), np.diff(self.first)
        capture = np.repeat(np.arange(len(size)), size)
        far = (np.full(n, np.inf),) * 2 if reach is None else reach(self.box, capture)
        x0, y0, x1, y1 = self.box.sides
        # A box that is turned round reaches as far as it does either way.
        low, high = (np.fmin(x0, x1), np.fmin(y0, y1)), tuple(np.fmax(a, b) + r for a, b, r in ((x0, x1, far[0]), (y0, y1, far[1])))

        def linked(pairs: np.ndarray) -> np.ndarray:
            return link(Boxes(*(v[pairs] for v in self.box.sides)), capture[pairs[:, 0]], pairs)[:, 0, 1]

        label = np.arange(n)
        for c in np.flatnonzero(size > LARGE).tolist():
            at = slice(int(self.first[c]), int(self.first[c + 1]))
            own = Boxes(*(v[at] for v in self.box.sides))
            label[at] = at.start + swept(own, tuple(v[at] for v in far), lambda pairs, at=at: linked(pairs + at.start))
        order = np.argsort(size, kind="stable")
        order, pairs = order[size[order] <= LARGE], []
        at = int(np.searchsorted(size[order], 2))
        while at < len(order):
            end = at + 1
            while end < len(order) and (end + 1 - at) * int(size[order[end]]) ** 2 <= most:
                end += 1
            own = order[at:end]
            m = int(size[own].max())
            valid = np.arange(m) < size[own][:, None]
            place = np.minimum(self.first[own][:, None] + np.arange(m), n - 1)
            near = valid[:, :, None] & valid[:, None, :]
            for lo, hi in zip(low, high, strict=True):
                near &= lo[place][:, None, :] <= hi[place][:, :, None]
            c, i, j = np.nonzero(near & near.transpose(0, 2, 1) & (np.arange(m)[:, None] < np.arange(m)))
            found = np.stack((place[c, i], place[c, j]), axis=1)
            pairs.append(found[linked(found)])
            at = end
        if pairs:
            u, v = np.concatenate(pairs).T
            label = joined(label, u, v)
        return label - self.first[capture]

    def merged(self, label: np.ndarray, across: np.ndarray) -> Items:
        """One item for each cluster, clusters by their first member; texts in the order of ``across``."""
        capture = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))
        order = np.lexsort((across, label, capture))
        key = capture[order] * (1 << 32) + label[order]
        begin = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.empty(0, np.int64)
        low, high = (lambda v: np.minimum.reduceat(v[order], begin)), (lambda v: np.maximum.reduceat(v[order], begin))
        x0, y0, x1, y1 = self.box.sides
        box = Boxes(low(x0), low(y0), high(x1), high(y1)) if len(begin) else Boxes([], [], [], [])
        edges = np.append(begin, len(order))
        text = _arrow(self.text).take(pa.array(order))
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), text), " ")
        mean = np.add.reduceat(self.confidence[order], begin) / np.diff(edges) if len(begin) else np.empty(0)
        return Items(box, _as_given(joined, self.text), mean, np.searchsorted(capture[order][begin], np.arange(len(self.first))))


def words_to_lines(words: Items, page_w: np.ndarray, page_h: np.ndarray) -> Items:
    column = words.labels(lambda b, c, _: stacked(b, page_h[c][:, None, None]), lambda b, c: stacked_reach(b, page_h[c]))
    flat = column + np.repeat(words.first[:-1], np.diff(words.first))
    size = np.bincount(flat, minlength=len(flat))[flat]
    label = words.labels(lambda b, c, place: in_line(b, page_w[c][:, None, None], column[place], size[place]), lambda b, c: in_line_reach(b, page_w[c]))
    return words.merged(label, words.box.x0)


def lines_to_bubbles(lines: Items, page_h: np.ndarray) -> Items:
    label = lines.labels(lambda b, c, _: stacked(b, page_h[c][:, None, None]), lambda b, c: stacked_reach(b, page_h[c]))
    stripped = pc.utf8_trim_whitespace(_arrow(lines.text))
    return Items(lines.box, _as_given(stripped, lines.text), lines.confidence, lines.first).merged(label, lines.box.y0)


def reading_rows(b: Boxes, rtl: bool) -> list[list[int]]:
    """Rows from the top, each in reading direction, equal places by index."""
    large = len(b) > LARGE
    rows = groups_of(swept(b, same_row_reach(b), lambda p: same_row(Boxes(*(v[p] for v in b.sides)))[:, 0, 1]) if large else components(same_row(b)))
    rows = [g[np.argsort(-b.x0[g] if rtl else b.x0[g], kind="stable")].tolist() for g in rows]
    return sorted(rows, key=lambda g: b.y0[g].min())


def splice_orphans(rows: list[list[int]], b: Boxes, rtl: bool) -> list[list[int]]:
    """A row of one bubble close below a row of several joins it in its place; what follows is judged against the
    longer row."""
    out: list[list[int]] = []
    for row in rows:
        if len(row) == 1 and out and len(out[-1]) >= 2:
            i, above = row[0], out[-1]
            top, bottom = b.y0[above].min(), b.y1[above].max()
            gap = max(0.0, b.y0[i] - bottom if top <= b.y0[i] else top - b.y1[i])
            if gap <= ORPHAN_GAP * (b.y1[i] - b.y0[i]):
                later = [k for k, j in enumerate(above) if (b.x0[j] < b.x0[i] if rtl else b.x0[j] > b.x0[i])]
                above.insert(later[0] if later else len(above), i)
                continue
        out.append(list(row))
    return out


def order_flat(b: Boxes, rtl: bool) -> list[int]:
    """The boxes of one capture in reading order, without panels."""
    return [i for row in splice_orphans(reading_rows(b, rtl), b, rtl) for i in row]


def flat_orders(b: Boxes, first: np.ndarray, rtl: np.ndarray) -> np.ndarray:
    """The boxes of each group (``first`` as in Items) in reading order, without panels. Groups are worked on together;
    only those in which a lone bubble joins the row above it go one by one."""
    group = np.repeat(np.arange(len(first) - 1), np.diff(first))
    row = Items(b, b.x0, b.x0, first).labels(lambda x, _, __: same_row(x), lambda x, _: same_row_reach(x)) + first[group]
    top, bottom = np.full(len(b), np.inf), np.full(len(b), -np.inf)
    np.minimum.at(top, row, b.y0)
    np.maximum.at(bottom, row, b.y1)
    at = np.lexsort((np.where(rtl[group], -b.x0, b.x0), row, top[row], group))
    if not len(at):
        return at
    begin = np.flatnonzero(np.concatenate(([True], row[at][1:] != row[at][:-1])))
    size, own = np.diff(np.append(begin, len(at))), group[at[begin]]
    lone = 1 + np.flatnonzero((size[1:] == 1) & (size[:-1] >= 2) & (own[1:] == own[:-1]))
    i, above = at[begin[lone]], row[at[begin[lone - 1]]]
    gap = np.maximum(0, np.where(top[above] <= b.y0[i], b.y0[i] - bottom[above], top[above] - b.y1[i]))
    for c in np.unique(own[lone[gap <= ORPHAN_GAP * b.height[i]]]).tolist():
        a, e = int(first[c]), int(first[c + 1])
        rows = np.split(at[a:e], begin[np.searchsorted(begin, a, "right") : np.searchsorted(begin, e)] - a)
        at[a:e] = [k for r in splice_orphans([r.tolist() for r in rows], b, bool(rtl[c])) for k in r]
    return at


@lru_cache(256)
def _each_two(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def panel_pairs(x: np.ndarray, y0: np.ndarray, y1: np.ndarray, page_w: float | None) -> tuple[np.ndarray, ...]:
    """Pairs of vertical cuts that may bound a panel, tallest first: i, j, least height, x0, y0, x1, y1. With a page
    width both page sides count as cuts."""
    edge = np.zeros(len(x), bool)
    if page_w:
        x, y0, y1 = np.append(x, (0.0, page_w)), np.append(y0, (0.0, 0.0)), np.append(y1, (np.inf, np.inf))
        edge = np.append(edge, (True, True))
    i, j = _each_two(len(x))
    keep = ~(edge[i] & edge[j])
    i, j = i[keep], j[keep]
    lo, hi = np.minimum(x[i], x[j]), np.maximum(x[i], x[j])
    top, bottom = np.maximum(y0[i], y0[j]), np.minimum(y1[i], y1[j])
    least = np.minimum(y1[i] - y0[i], y1[j] - y0[j])
    ok = (bottom - top > 0) & (least > 0) & np.isfinite(least)
    ok[ok] = (bottom - top)[ok] / least[ok] >= PANEL_OVERLAP
    if page_w:
        ok &= hi - lo >= page_w * PANEL_WIDTH
    at = np.flatnonzero(ok)
    at = at[np.argsort(-least[at], kind="stable")]
    return tuple(v[at] for v in (i, j, least, lo, top, hi, bottom))


def claim_panels(pairs: tuple[np.ndarray, ...]) -> Boxes:
    """Greedy matching: a cut bounds one panel at most."""
    used, rows = set(), []
    for k, (i, j) in enumerate(zip(pairs[0].tolist(), pairs[1].tolist(), strict=True)):
        if not used & {i, j}:
            used |= {i, j}
            rows.append(k)
    return Boxes(*(v[rows] for v in pairs[3:]))


def assign_panels(b: Boxes, rects: Boxes) -> np.ndarray:
    """The panel of each bubble: the first that holds its centre, else one of its own after all others."""
    own = len(rects) + np.arange(len(b))
    if not len(rects):
        return np.zeros(len(b), np.int64)
    cx, cy = ((b.x0 + b.x1) / 2)[:, None], ((b.y0 + b.y1) / 2)[:, None]
    inside = (cx >= rects.x0) & (cx <= rects.x1) & (cy >= rects.y0) & (cy <= rects.y1)
    return np.where(inside.any(axis=1), inside.argmax(axis=1), own)


def panel_orders(b: Boxes, first: np.ndarray, rtl: np.ndarray, panel: np.ndarray) -> np.ndarray:
    """The bubbles of each capture in reading order: its panels first, as one box each, then the bubbles of each.
    ``panel``: the panel of each bubble, any number that tells those of a capture apart."""
    if not len(b):
        return np.empty(0, np.int64)
    capture = np.repeat(np.arange(len(first) - 1), np.diff(first))
    by = np.lexsort((panel, capture))
    begin = np.flatnonzero(np.concatenate(([True], (panel[by][1:] != panel[by][:-1]) | (capture[by][1:] != capture[by][:-1]))))
    inner = flat_orders(Boxes(*(v[by] for v in b.sides)), np.append(begin, len(by)), rtl[capture[by[begin]]])
    low, high = (np.minimum.reduceat(v[by], begin) for v in (b.x0, b.y0)), (np.maximum.reduceat(v[by], begin) for v in (b.x1, b.y1))
    outer = flat_orders(Boxes(*low, *high), np.searchsorted(capture[by[begin]], np.arange(len(first))), rtl)
    rank = np.empty(len(outer), np.int64)
    rank[outer] = np.arange(len(outer))
    of = np.repeat(np.arange(len(begin)), np.diff(np.append(begin, len(by))))
    return by[inner[np.argsort(rank[of[inner]], kind="stable")]]


def order(b: Boxes, rtl: bool, vertical: tuple[np.ndarray, np.ndarray, np.ndarray], n_horizontal: int, page_w: float | None) -> list[int]:
    """Total reading order of one capture: panels first if cuts bound several. vertical: x, y0 and y1 of cuts."""
    return panel_orders(b, np.array([0, len(b)]), np.array([rtl]), panels_by_cuts(b, vertical, n_horizontal, page_w)).tolist()


def panels_by_cuts(b: Boxes, vertical: tuple[np.ndarray, np.ndarray, np.ndarray], n_horizontal: int, page_w: float | None) -> np.ndarray:
    """The panel of each bubble as the cuts bound them; all are in one without cuts."""
    if not len(vertical[0]) + n_horizontal:
        return np.zeros(len(b), np.int64)
    return assign_panels(b, claim_panels(panel_pairs(*vertical, page_w)))


def panels_of_captures(b: Boxes, first: np.ndarray, vertical: np.ndarray, cut_first: np.ndarray, n_horizontal: np.ndarray, page_w: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """``panels_by_cuts`` of many captures. vertical: x, y0 and y1 of cuts, ``cut_first`` as in Items; page_w: 0 without a
    width. Captures with as many cuts are worked on together, as many as have about ``most`` pairs of cuts; those with over 32 go
    one by one."""
    panel, size, n_cuts = np.zeros(len(b), np.int64), np.diff(first), np.diff(cut_first)
    sided = page_w != 0  # both page sides count as cuts
    some = (size > 1) & (n_cuts + n_horizontal > 0)
    for n, edges in np.unique(np.stack((n_cuts[some], sided[some])), axis=1).T.tolist():
        own = np.flatnonzero(some & (n_cuts == n) & (sided == edges))
        m = n + 2 * edges
        if m < 2:
            continue  # no panel: all are in one
        for c in own.tolist() if n > 32 else ():
            at = slice(first[c], first[c + 1])
            panel[at] = panels_by_cuts(Boxes(*(v[at] for v in b.sides)), tuple(vertical[:, cut_first[c] : cut_first[c + 1]]), int(n_horizontal[c]), page_w[c] or None)
        step = max(1, most // m**2)
        for k in range(0, len(own) if n <= 32 else 0, step):
            part = own[k : k + step]
            at = np.repeat(first[part] - np.concatenate(([0], np.cumsum(size[part])[:-1])), size[part]) + np.arange(size[part].sum())
            panel[at] = _panels(Boxes(*(v[at] for v in b.sides)), size[part], vertical[:, cut_first[part][:, None] + np.arange(n)], page_w[part] if edges else None)
    return panel


def _panels(b: Boxes, size: np.ndarray, vertical: np.ndarray, page_w: np.ndarray | None) -> np.ndarray:
    """The panels of captures with ``size`` bubbles and as many cuts each, by the rules of panel_pairs, claim_panels and
    assign_panels: each step takes the next pair of every capture."""
    x, y0, y1 = vertical
    n, rows = len(size), np.arange(len(size))
    i, j = _each_two(x.shape[1] + 2 * (page_w is not None))
    if page_w is not None:
        zero = np.zeros((n, 1))
        x, y0, y1 = np.hstack((x, zero, page_w[:, None])), np.hstack((y0, zero, zero)), np.hstack((y1, zero + np.inf, zero + np.inf))
        inner = i < x.shape[1] - 2  # not both sides of the page
        i, j = i[inner], j[inner]
    lo, hi = np.minimum(x[:, i], x[:, j]), np.maximum(x[:, i], x[:, j])
    top, bottom = np.maximum(y0[:, i], y0[:, j]), np.minimum(y1[:, i], y1[:, j])
    least = np.minimum(y1[:, i] - y0[:, i], y1[:, j] - y0[:, j])
    ok = (bottom - top > 0) & (least > 0) & np.isfinite(least)
    ok &= np.where(ok, bottom - top, 0) / np.where(ok, least, 1) >= PANEL_OVERLAP
    if page_w is not None:
        ok &= hi - lo >= (page_w * PANEL_WIDTH)[:, None]
    order = np.argsort(np.where(ok, -least, np.inf), axis=1, kind="stable")
    used, claimed = np.zeros(x.shape, bool), np.zeros(n, np.int64)
    capture = np.repeat(rows, size)
    cx, cy = (b.x0 + b.x1) / 2, (b.y0 + b.y1) / 2
    panel = np.full(len(b), -1, np.int64)
    for k in range(min(order.shape[1], int(ok.sum(axis=1).max(initial=0)))):
        p = order[:, k]
        takes = ok[rows, p] & ~used[rows, i[p]] & ~used[rows, j[p]]
        used[rows[takes], i[p[takes]]] = used[rows[takes], j[p[takes]]] = True
        r = tuple(v[rows, p][capture] for v in (lo, top, hi, bottom))
        inside = takes[capture] & (panel < 0) & (cx >= r[0]) & (cx <= r[2]) & (cy >= r[1]) & (cy <= r[3])
        panel[inside] = claimed[capture[inside]]
        claimed += takes
    number = np.arange(len(b)) - np.repeat(np.cumsum(size) - size, size)
    return np.where(claimed[capture] == 0, 0, np.where(panel < 0, claimed[capture] + number, panel))


_BOX = "text string, x0 double, y0 double, x1 double, y1 double, confidence double"
_SIDES = ["x0", "y0", "x1", "y1"]


def gathered(items: DataFrame, index: str, columns: list[str], per_capture: list[str] | None = None) -> DataFrame:
    """One row for each capture: capture_id, what holds for all of it, and ``rows``, its items by index. Items that come so
    already aren't shuffled."""
    if "rows" in items.columns:
        return items.select("capture_id", F.transform("rows", lambda r: F.struct(*(r[c].alias(c) for c in (index, *columns)))).alias("rows"), *(per_capture or []))
    same = [F.first(c).alias(c) for c in per_capture or []]
    return items.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct(index, *columns))).alias("rows"), *same)


class Batch:
    """An Arrow batch of gathered captures. ``rows``: their column, or an array in its stead."""

    def __init__(self, batch: pa.RecordBatch, rows: str | pa.ListArray = "rows"):
        lists = batch.column(rows) if isinstance(rows, str) else rows
        self.size = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        self.first = np.concatenate(([0], np.cumsum(self.size)))
        self.fields = lists.flatten()
        self.capture_id = batch.column("capture_id")

    def column(self, name: str) -> np.ndarray:
        return self.fields.field(name).to_numpy(zero_copy_only=False)

    def boxes(self) -> Boxes:
        return Boxes(*(self.column(c) for c in _SIDES))

    def ids(self, first: np.ndarray) -> pa.Array:
        """capture_id of items that lie as ``first`` says."""
        return self.capture_id.take(pa.array(np.repeat(np.arange(len(first) - 1), np.diff(first))))


def _number(first: np.ndarray) -> np.ndarray:
    return (np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))).astype(np.int32)


def cluster(link: Callable[[Boxes], np.ndarray], items: DataFrame, index: str = "ix", reach: Callable[[Boxes], tuple[np.ndarray, np.ndarray]] | None = None) -> DataFrame:
    """Transitive clustering by a pairwise predicate on boxes, which ``reach`` may bound. Adds the smallest index of each
    item's group, ``label``."""
    far = None if reach is None else lambda b, _: reach(b)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch)
            ix = b.column(index)
            place = Items(b.boxes(), ix, ix, b.first).labels(lambda x, _, __: link(x), far)
            yield pa.RecordBatch.from_arrays([b.ids(b.first), pa.array(ix), pa.array(ix[place + np.repeat(b.first[:-1], b.size)])], ["capture_id", index, "label"])

    rows = gathered(items, index, _SIDES)
    kind = {f.name: f.dataType.simpleString() for f in (*rows.schema["rows"].dataType.elementType, rows.schema["capture_id"])}
    return rows.mapInArrow(work, f"capture_id {kind['capture_id']}, {index} {kind[index]}, label {kind[index]}")


def rebuilt(b: Batch, page_w: np.ndarray, page_h: np.ndarray, level: str = "bubbles") -> Items:
    """Lines or bubbles of the words of a batch. Missing confidences count as 0, missing texts as empty."""
    text, confidence = pc.fill_null(b.fields.field("text"), "").cast(pa.string()), np.nan_to_num(b.column("confidence").astype(float))
    lines = words_to_lines(Items(b.boxes(), text, confidence, b.first), page_w, page_h)
    return lines if level == "lines" else lines_to_bubbles(lines, page_h)


def page_sizes(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    return tuple(batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("canvas_w", "canvas_h"))


def reconstruct(words: DataFrame, level: str = "bubbles") -> DataFrame:
    """words: capture_id, word_ix, text, box, confidence, canvas_w, canvas_h; or as ``gathered``. Lines or bubbles of every capture. Missing
    confidences count as 0; no capture is left out or cut."""
    name = "bubble_ix" if level == "bubbles" else "line_ix"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch)
            out = rebuilt(b, *page_sizes(batch), level)
            cols = [b.ids(out.first), pa.array(_number(out.first)), out.text, *(pa.array(v) for v in out.box.sides), pa.array(out.confidence)]
            yield pa.RecordBatch.from_arrays(cols, ["capture_id", name, "text", *_SIDES, "confidence"])

    rows = gathered(words, "word_ix", ["text", *_SIDES, "confidence"], ["canvas_w", "canvas_h"])
    return rows.mapInArrow(work, f"capture_id long, {name} int, {_BOX}")


BUBBLES = f"array<struct<bubble_ix int, {_BOX}, kept boolean, suspicious boolean>>"


def bubble_rows(b: Batch, page_w: np.ndarray, page_h: np.ndarray) -> pa.ListArray:
    """The same as BUBBLES: those of each capture in one array, each with the ``noise.verdicts`` as far as they are plain."""
    out = rebuilt(b, page_w, page_h)
    cols = [pa.array(_number(out.first)), out.text, *(pa.array(v) for v in out.box.sides), pa.array(out.confidence), *verdicts(out.text, out.confidence)]
    return pa.ListArray.from_arrays(pa.array(out.first.astype(np.int32)), pa.StructArray.from_arrays(cols, ["bubble_ix", "text", *_SIDES, "confidence", "kept", "suspicious"]))


def on_page(bubbles: DataFrame, overlays: DataFrame | None = None, images: DataFrame | None = None) -> DataFrame:
    """``bubbles`` off the overlays and, in captures that have images, on one of them. overlays, images: capture_id, box."""

    def met(rects: DataFrame, how: str, out: DataFrame) -> DataFrame:
        r = rects.select(F.col("capture_id").alias("r_id"), *(F.col(c).alias(f"r_{c}") for c in _SIDES))
        return out.join(r, (F.col("capture_id") == F.col("r_id")) & boxes_overlap(box(), box("r_")), how)

    if overlays is not None:
        bubbles = met(overlays, "left_anti", bubbles)
    if images is not None:
        free = bubbles.join(images.select("capture_id"), "capture_id", "left_anti")
        bubbles = met(images, "left_semi", bubbles).unionByName(free)
    return bubbles


def order_bubbles(bubbles: DataFrame, cuts: DataFrame | None = None, carry: list[str] | None = None) -> DataFrame:
    """bubbles: capture_id, bubble_ix, box, direction, canvas_w; cuts: capture_id, orient, cut_ix, box. Bubbles may come as
    ``gathered``, with the cuts of each capture in an array by cut_ix.
    Adds ``seq``, the place in reading order (from 0); columns to ``carry`` come along."""
    carry = carry or []
    rows = gathered(bubbles, "bubble_ix", [*_SIDES, *carry], ["direction", "canvas_w", *(c for c in ("cuts",) if c in bubbles.columns)])
    if cuts is not None:
        own = cuts.groupBy("capture_id").agg(F.array_sort(F.collect_list(F.struct("cut_ix", "orient", *_SIDES))).alias("cuts"))
        rows = rows.join(own, "capture_id", "left")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch)
            box, rtl = b.boxes(), pc.fill_null(pc.equal(batch.column("direction"), "rtl"), False).to_numpy(zero_copy_only=False)
            panel = np.zeros(len(box), np.int64)
            if "cuts" in batch.schema.names:
                cut = Batch(batch, "cuts")
                is_v, is_h = (pc.fill_null(pc.equal(cut.fields.field("orient"), o), False).to_numpy(zero_copy_only=False) for o in "vh")
                v, before, n_h = np.stack([cut.column(x)[is_v] for x in ("x0", "y0", "y1")]), np.concatenate(([0], np.cumsum(is_v))), np.concatenate(([0], np.cumsum(is_h)))
                panel = panels_of_captures(box, b.first, v, before[cut.first], np.diff(n_h[cut.first]), pc.fill_null(batch.column("canvas_w"), 0).to_numpy(zero_copy_only=False).astype(float))
            at = panel_orders(box, b.first, rtl, panel)
            own = [b.fields.field(c).take(pa.array(at)) for c in ("bubble_ix", *carry)]
            yield pa.RecordBatch.from_arrays([b.ids(b.first), *own, pa.array(_number(b.first))], ["capture_id", "bubble_ix", *carry, "seq"])

    kinds = "".join(f", {c} {rows.schema['rows'].dataType.elementType[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(work, f"capture_id long, bubble_ix int{kinds}, seq int")


def panels(cuts: DataFrame, page_w: float | None, candidates: bool = False) -> DataFrame:
    """Panels of every capture in claim order (rect_ix), or all candidate pairs."""
    names = ["i", "j", "least_h", *_SIDES] if candidates else ["rect_ix", *_SIDES]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = Batch(batch)
            v = np.stack([b.column(c) for c in ("x0", "y0", "y1")])
            size, parts = [], []
            for a, e in zip(b.first.tolist(), b.first[1:].tolist(), strict=False):
                found = panel_pairs(*v[:, a:e], page_w)
                if not candidates:
                    own = claim_panels(found)
                    found = (np.arange(len(own)), *own.sides)
                size.append(len(found[0]))
                parts.append(np.stack(found))
            first = np.concatenate(([0], np.cumsum(size))).astype(np.int64)
            flat = np.concatenate(parts, axis=1) if parts else np.empty((len(names), 0))
            cols = [pa.array(c.astype(np.int32) if n in ("i", "j", "rect_ix") else c) for n, c in zip(names, flat, strict=True)]
            yield pa.RecordBatch.from_arrays([b.ids(first), *cols], ["capture_id", *names])

    kinds = ", ".join(f"{n} {'int' if n in ('i', 'j', 'rect_ix') else 'double'}" for n in names)
    return gathered(cuts.where("orient = 'v'"), "cut_ix", _SIDES).mapInArrow(work, f"capture_id long, {kinds}")
