"""Table functions with SQL names."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import arrow_udtf, udtf

from ..operators import layout
from .text import BLANKS


@udtf(returnType="seq int, chunk string")
class SentenceChunks:
    """sentence_chunks(text): sentence-like pieces, gathered until a chunk has four characters; a short rest joins the last."""

    def eval(self, text: str) -> Iterator[tuple[int, str]]:
        if text is None:
            return
        chunks, held = [], ""
        for piece in re.findall(r"[^.!?]+[.!?]*", text) or [text]:
            piece = piece.strip(BLANKS)
            if piece:
                held = f"{held} {piece}" if held else piece
                if len(held) >= 4:
                    chunks.append(held)
                    held = ""
        if held:
            chunks = [*chunks[:-1], f"{chunks[-1]} {held}"] if chunks else [held]
        yield from enumerate(chunks)


class _Clusters:
    """Rows of one partition: capture_id, ix and a box. Sides are kept as numbers, nothing else of a row is."""

    def __init__(self):
        self.capture, self.ix, self.sides, self.size = None, [], [], None

    def add(self, row: Row, size: float | None) -> None:
        self.capture, self.size = row["capture_id"], size
        self.ix.append(row["ix"])
        self.sides.append((row["x0"], row["y0"], row["x1"], row["y1"]))

    def labels(self, link, reach) -> Iterator[tuple]:
        b = layout.Boxes(*np.array(self.sides, float).reshape(-1, 4).T)
        if len(b) > layout.LARGE:
            place = layout.swept(b, reach(b), lambda p: link(layout.Boxes(*(v[p] for v in b.sides)))[:, 0, 1])
        else:
            place = layout.components(link(b))
        for ix, p in zip(self.ix, place.tolist(), strict=True):
            yield self.capture, ix, self.ix[p]


@udtf(returnType="capture_id long, ix int, label int")
class StackedBoxes:
    """stacked_boxes(TABLE(boxes) PARTITION BY capture_id ORDER BY (ix), page_h): the first box of each one's column."""

    def __init__(self):
        self.held = _Clusters()

    def eval(self, row: Row, page_h: float) -> None:
        self.held.add(row, float(page_h))

    def terminate(self) -> Iterator[tuple]:
        if self.held.ix:
            h = self.held.size
            yield from self.held.labels(lambda b: layout.stacked(b, h), lambda b: layout.stacked_reach(b, h))


@udtf(returnType="capture_id long, ix int, label int")
class BoxRows:
    """box_rows(TABLE(boxes) PARTITION BY capture_id ORDER BY ix): the first box of each one's row."""

    def __init__(self):
        self.held = _Clusters()

    def eval(self, row: Row) -> None:
        self.held.add(row, None)

    def terminate(self) -> Iterator[tuple]:
        if self.held.ix:
            yield from self.held.labels(layout.same_row, layout.same_row_reach)


@arrow_udtf(returnType="capture_id long, ix int, label int, n long")
class StackedCaptures:
    """stacked_captures(TABLE(captures), page_h): the same of captures that come whole: capture_id, rows (an array of ix and
    a box, by ix). Many are worked on at a time, so none is dealt by its boxes. n: how many boxes the column has."""

    def eval(self, captures: pa.RecordBatch, page_h: pa.Array) -> Iterator[pa.Table]:
        h, b = page_h[0].as_py(), layout.Batch(captures)
        ix = b.column("ix")
        place = layout.Items(b.boxes(), ix, ix, b.first).labels(lambda x, _, __: layout.stacked(x, h), lambda x, _: layout.stacked_reach(x, h))
        place = place + np.repeat(b.first[:-1], b.size)
        n = np.bincount(place, minlength=len(place))[place]
        yield pa.table({"capture_id": b.ids(b.first), "ix": pa.array(ix), "label": pa.array(ix[place]), "n": pa.array(n)})


TABLE_FUNCTIONS = {"sentence_chunks": SentenceChunks, "stacked_boxes": StackedBoxes, "box_rows": BoxRows, "stacked_captures": StackedCaptures}


def register_tables(spark: SparkSession) -> list[str]:
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    return sorted(TABLE_FUNCTIONS)
