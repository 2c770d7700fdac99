"""Scalar geometry on boxes with columns x0, y0, x1, y1 (doubles, origin top left). All plain Column expressions."""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Box:
    """Four columns of one box."""

    x0: Column
    y0: Column
    x1: Column
    y1: Column


def box(prefix: str = "") -> Box:
    return Box(*(F.col(prefix + c) for c in ("x0", "y0", "x1", "y1")))


def height(b: Box) -> Column:
    return b.y1 - b.y0


def width(b: Box) -> Column:
    return b.x1 - b.x0


def center_y(b: Box) -> Column:
    return (b.y0 + b.y1) / 2


def center_x(b: Box) -> Column:
    return (b.x0 + b.x1) / 2


def _overlap_ratio(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    least = F.least(a1 - a0, b1 - b0)
    shared = F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))
    return F.when(least > 0, F.try_divide(shared, least)).otherwise(F.lit(0.0))


def v_overlap_ratio(a: Box, b: Box) -> Column:
    return _overlap_ratio(a.y0, a.y1, b.y0, b.y1)


def x_overlap_ratio(a: Box, b: Box) -> Column:
    return _overlap_ratio(a.x0, a.x1, b.x0, b.x1)


def h_gap(a: Box, b: Box) -> Column:
    """From the right side of the box that starts first to the left side of the other, never negative."""
    return F.greatest(F.lit(0.0), F.when(a.x0 <= b.x0, b.x0 - a.x1).otherwise(a.x0 - b.x1))


def v_gap(a: Box, b: Box) -> Column:
    return F.greatest(F.lit(0.0), F.when(a.y0 <= b.y0, b.y0 - a.y1).otherwise(a.y0 - b.y1))


def area(b: Box, clamp: bool = True) -> Column:
    zero = F.lit(0.0)
    return F.greatest(zero, width(b)) * F.greatest(zero, height(b)) if clamp else width(b) * height(b)


def iou(a: Box, b: Box, clamp: bool = True) -> Column:
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a.x1, b.x1) - F.greatest(a.x0, b.x0))
    h = F.greatest(zero, F.least(a.y1, b.y1) - F.greatest(a.y0, b.y0))
    return (w * h) / (area(a, clamp) + area(b, clamp) - w * h + F.lit(1e-9))


def boxes_overlap(a: Box, b: Box) -> Column:
    """Touching sides don't overlap."""
    return (F.least(a.x1, b.x1) > F.greatest(a.x0, b.x0)) & (F.least(a.y1, b.y1) > F.greatest(a.y0, b.y0))


def device_to_css_y(y: Column, canvas_h: Column, viewport_h: Column) -> Column:
    return F.when(F.coalesce(canvas_h, F.lit(0.0)) == 0, y).otherwise(F.try_divide(y * viewport_h, canvas_h))


def css_rect_to_canvas(left: Column, top: Column, right: Column, bottom: Column, canvas_w: Column, canvas_h: Column, viewport_w: Column, viewport_h: Column) -> Box:
    sx, sy = F.try_divide(canvas_w, viewport_w), F.try_divide(canvas_h, viewport_h)
    return Box(left * sx, top * sy, right * sx, bottom * sy)


def gray(r: Column, g: Column, b: Column) -> Column:
    """Luma as stored in clamped bytes: half to even. The weights are decimals, so that a whole number's part is exact, as
    in SQL; as doubles, some sums that end in .5 fall to the other side."""
    part = lambda c, weight: c * F.lit(Decimal(weight))
    return F.least(F.lit(255), F.greatest(F.lit(0), F.rint(part(r, "0.299") + part(g, "0.587") + part(b, "0.114")))).cast("int")


def js_round(c: Column) -> Column:
    return F.floor(c + F.lit(0.5))


INPUT_SIZE = 1024


def letterbox(w: Column, h: Column, size: int = INPUT_SIZE) -> tuple[Column, Column, Column]:
    """(scale, left pad, top pad)."""
    scale = F.least(F.try_divide(F.lit(float(size)), w), F.try_divide(F.lit(float(size)), h))
    pad = lambda dim: F.floor((F.lit(size) - js_round(dim * scale)) / 2)
    return scale, pad(w), pad(h)


CROP_PAD, CROP_LEAST = 12, 4


def crop(b: Box, canvas_w: Column, canvas_h: Column, pad: int = CROP_PAD) -> tuple[Box, Column]:
    """(padded crop inside the canvas, is it large enough)."""
    c = Box(
        F.greatest(F.lit(0), F.floor(b.x0 - pad)), F.greatest(F.lit(0), F.floor(b.y0 - pad)),
        F.least(canvas_w, F.ceil(b.x1 + pad)), F.least(canvas_h, F.ceil(b.y1 + pad)),
    )
    return c, (width(c) >= CROP_LEAST) & (height(c) >= CROP_LEAST)


def shift(b: Box, dx: Column, dy: Column) -> Box:
    return Box(b.x0 + dx, b.y0 + dy, b.x1 + dx, b.y1 + dy)


SPEED_DEFAULT, SPEED_MIN, SPEED_MAX = 140.0, 60.0, 280.0
MARGIN_RATIO, MARGIN_MIN, MARGIN_MAX = 0.12, 60.0, 160.0
ADVANCE_RATIO, REPOSITION_RATIO = 0.75, 0.35


def scroll_speed(v: Column) -> Column:
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))
    return F.when(finite, F.least(F.lit(SPEED_MAX), F.greatest(F.lit(SPEED_MIN), v))).otherwise(F.lit(SPEED_DEFAULT))


def reposition_margin(viewport_h: Column) -> Column:
    return F.least(F.lit(MARGIN_MAX), F.greatest(F.lit(MARGIN_MIN), viewport_h * MARGIN_RATIO))


def min_advance(viewport_h: Column) -> Column:
    return viewport_h * ADVANCE_RATIO


def reposition_delta(cutoff_top: Column, top_y: Column, viewport_h: Column) -> Column:
    """Pixels to scroll so that the cut-off (else the topmost) bubble lands at the margin; null for none."""
    margin = reposition_margin(viewport_h)
    to_cutoff = js_round(cutoff_top - margin)
    return F.when(cutoff_top.isNotNull(), F.when(to_cutoff > 0, to_cutoff)).when(
        top_y > viewport_h * REPOSITION_RATIO, js_round(top_y - margin)
    )


def origin_of(url: Column) -> Column:
    """scheme://host[:port] in lower case, without user info and default port; null if it can't be parsed."""
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    host = F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("AUTHORITY")), "^.*@", ""))
    usual = F.when(scheme == "http", F.regexp_replace(host, ":80$", "")).when(scheme == "https", F.regexp_replace(host, ":443$", "")).otherwise(host)
    return F.when(scheme.isNotNull() & (host != ""), F.concat(scheme, F.lit("://"), usual))
