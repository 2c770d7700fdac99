"""Best-fit packing by bin completion.

Documents become ids of a public byte-level BPE plus an end id, and pieces of at most ``capacity``; only longer
documents are cut, and their first piece takes the remainder so all others are full. Pieces are dealt to groups of
about GROUP_PIECES by a hash (no key can gather in one), and each group is packed by branch and bound: full pieces and
pairs that fill a bin are taken out, the largest piece left is completed by undominated fillings (all of them, fullest
first, made one by one), branches die when their waste exceeds what a better packing may waste, and best-fit decreasing
gives the incumbent. The search ends at the lower bound, when nothing is left, or after STEPS_A_BIN steps back for each
bin, LEAST_STEPS at least (the first dive takes none), with the best packing found; dominated fillings met count as steps.
Small groups, where steps are cheap and win most, are so searched far beyond what their bins alone would allow.

What groups leave unfilled is packed in further rounds: bins with room are taken apart and their pieces dealt to fewer
groups, as long as that halves what is left, so the loss is a bin a table rather than a bin a group.

Ids: the vocabulary is read from the `tokenizers` file and applied by `tiktoken` with the same ranks (equal ids, five
times as fast; a test compares them); texts that hold the special token's string, and texts whose runs of blanks
(about a million) are too long for tiktoken's patterns, go through `tokenizers` itself.

Nulls: a null text is empty and gives the end id alone; a null doc_id stays null. Repeated rows are packed each, equal
lengths are interchangeable. An empty table gives no rows. Very long texts are encoded whole, one at a time. Other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import documents, materialise

CAPACITY, END_ID, GROUP_PIECES, STEPS_A_BIN, LEAST_STEPS, MOST_ROUNDS = 2048, 0, 8192, 4, 20_000, 64
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Encoder:
    """Ids of texts by a `tokenizers` byte-level BPE file."""

    def __init__(self, file: str):
        import json

        import tiktoken
        import tokenizers
        from public_tokenizers import PATTERN

        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        self.slow = tokenizers.Tokenizer.from_file(file)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        ranks = {bytes(byte[c] for c in tok): i for tok, i in spec["model"]["vocab"].items() if tok not in self.special}
        self.fast = tiktoken.Encoding("from_file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        try:
            return self.fast.encode_ordinary(text)
        except BaseException as e:  # a panic of its pattern engine is no Exception
            if type(e).__name__ != "PanicException":
                raise
            return self.slow.encode(text, add_special_tokens=False).ids


def cut(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32."""
    kind = docs.schema["doc_id"].dataType

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Encoder(tokenizer)
        for batch in batches:
            at, piece, start, length, crc = [], [], [], [], []
            for d, text in enumerate(batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), END_ID], "<u4")
                cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    at.append(d)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(ids[a:b].tobytes()))
            ids_col = batch.column("doc_id").take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids_col, pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(work, PIECES.replace("doc_id long", f"doc_id {kind.simpleString()}"))


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: bins of lengths."""
    bins, room = [], []  # room: sorted (space left, bin)
    for x in sorted(lengths, reverse=True):
        k = bisect_left(room, (x, -1))
        if k == len(room):
            b, left = len(bins), capacity
            bins.append([])
        else:
            left, b = room.pop(k)
        bins[b].append(x)
        if left - x:
            insort(room, (left - x, b))
    return bins


def dominated(filling: tuple[int, ...], space: int, sizes: list[int], counts: dict[int, int]) -> bool:
    """Whether one piece left over fits besides, or in place of some of these whose sum it has at least. Then the other
    filling is never worse (Martello and Toth), and whatever set dominates this one, such a piece is in it."""
    one = several = 0  # sums of one of the pieces, of two or more: bit sets
    for x in filling:
        several |= several << x | one << x
        one |= 1 << x
    slack = space - sum(filling)
    for x in sizes[: bisect_right(sizes, space)]:
        if counts[x] > filling.count(x):
            low = max(0, x - slack)
            if x <= slack or several >> low & ((1 << x - low + 1) - 1) or one >> low & ((1 << x - low) - 1):
                return True
    return False


def fillings(sizes: list[int], counts: dict[int, int], space: int, least: Callable[[], int] = lambda: 0, rejected: Callable[[], bool] = lambda: True) -> Iterator[tuple[int, ...]]:
    """Every undominated way to fill ``space``, fullest first, then the fewest pieces, then the largest; made as they are
    asked for. It ends below a sum of ``least()``, or when ``rejected()``, called for each dominated one, is false. The
    first is found without a step back. ``sizes`` and ``counts`` must be as they were whenever the next one is asked for."""
    k = bisect_right(sizes, space)
    if not k:
        yield ()
        return
    if sizes[k - 1] == space:  # dominates all others
        yield (space,)
        return

    def pairs(total: int) -> Iterator[tuple[int, ...]]:
        if total in counts and counts[total] > 0:
            yield (total,)
        for i in range(bisect_right(sizes, total) - 1, -1, -1):
            a = sizes[i]
            b = total - a
            if b > a:
                return
            if counts.get(b, 0) > (a == b):
                yield (a, b)

    for f in pairs(space):
        yield f  # no piece left has the sum of both, and none is left over
    reach: list[int] = []  # bit sets: sums of pieces of the sizes up to each
    for x in sizes[:k]:
        r, n, m = reach[-1] if reach else 1, min(counts[x], space // x), 1
        while n:
            m = min(m, n)
            r |= r << m * x
            n -= m
            m *= 2
        reach.append(r & ((2 << space) - 1))

    def sets(i: int, total: int) -> Iterator[tuple[int, ...]]:
        """Sets of the sizes before the i-th, largest first; never a step without a result."""
        if not total:
            yield ()
        for j in range(min(i, bisect_right(sizes, total)) - 1, -1, -1):
            if not reach[j] >> total & 1:
                return
            x, below = sizes[j], reach[j - 1] if j else 1
            for n in range(min(counts[x], total // x), 0, -1):
                if below >> total - n * x & 1:
                    for rest in sets(j, total - n * x):
                        yield (x,) * n + rest

    left = reach[-1]
    while left:
        total = left.bit_length() - 1
        left ^= 1 << total
        for f in chain(pairs(total) if total < space else (), (f for f in sets(k, total) if len(f) != 1 and len(f) != 2)):
            if total < least():
                return
            if not dominated(f, space, sizes, counts):
                yield f
            elif not rejected():
                return


def pack(lengths: list[int], capacity: int = CAPACITY, steps: int | None = None) -> list[list[int]]:
    """Bin completion: depth-first over fillings of the bin that holds the largest piece left."""
    incumbent = best_fit(lengths, capacity)
    bound = -(-sum(lengths) // capacity)
    if len(incumbent) <= bound:
        return incumbent
    counts: dict[int, int] = {}
    for x in lengths:
        counts[x] = counts.get(x, 0) + 1
    # Full pieces, and pairs that fill a bin: some best packing has them so.
    fixed = []
    for x in sorted(counts):
        pair = [x] if x == capacity else [x, capacity - x]
        n = counts[x] // 2 if 2 * x == capacity else min(counts[x], counts.get(pair[-1], 0))
        fixed += [list(pair) for _ in range(n)]
        for y in pair:
            if n:
                counts[y] -= n
    sizes = sorted(x for x, n in counts.items() if n)
    waste = capacity * (len(incumbent) - 1) - sum(lengths)  # what a better packing may waste
    left = max(LEAST_STEPS, STEPS_A_BIN * len(incumbent)) if steps is None else steps

    def take(x: int, n: int) -> None:
        counts[x] = counts.get(x, 0) - n
        if not counts[x]:
            sizes.pop(bisect_left(sizes, x))
        elif counts[x] == -n:
            insort(sizes, x)

    def step() -> bool:
        nonlocal left
        left -= 1
        return left > 0

    done: list[list[int]] = []
    stack: list[tuple[Iterator[tuple[int, ...]], int, int]] = []  # choices left at each depth, its largest piece, the waste above it
    wasted, fresh = 0, True
    while True:
        if fresh:
            if not sizes:
                if len(fixed) + len(done) < len(incumbent):
                    incumbent = [*fixed, *done]
                    waste = capacity * (len(incumbent) - 1) - sum(lengths)
                if len(incumbent) <= bound:
                    break
            elif len(fixed) + len(done) + 1 < len(incumbent):
                first, above = sizes[-1], wasted
                take(first, 1)
                space = capacity - first
                stack.append((fillings(sizes, counts, space, lambda least=space + above: least - waste, step), first, above))
        if not stack:
            break
        options, first, above = stack[-1]
        again = len(done) == len(stack)
        if again:  # back from the branch below: undo its bin
            for x in done.pop()[1:]:
                take(x, -1)
        f = next(options, None)
        fresh = f is not None and above + capacity - first - sum(f) <= waste
        if not fresh:
            take(first, -1)
            stack.pop()
        elif again and not step():
            break
        else:
            for x in f:
                take(x, 1)
            done.append([first, *f])
            wasted = above + capacity - first - sum(f)
    return incumbent


PLACED = ["sequence_id", "offset", "_room"]


def _round(pieces: DataFrame, number: int, groups: int, capacity: int) -> DataFrame:
    """``pieces`` packed once: with sequence_id, offset and _room, what the sequence has left. Pieces of an earlier
    round come by whole sequences, and a group stays as it was unless it gets fewer."""
    again = "sequence_id" in pieces.columns
    own = [c for c in pieces.columns if c not in PLACED]
    by = ["sequence_id"] if again else ["doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()]
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64(*by), F.lit(groups)))

    def work(key, table):
        lengths = table.column("length").to_numpy()
        waiting: dict[int, list[int]] = {}
        for i, x in enumerate(lengths.tolist()):
            waiting.setdefault(x, []).append(i)
        bins = pack(lengths.tolist(), capacity)
        if again and len(bins) >= len(table.column("sequence_id").unique()):
            return table.drop_columns(["_group"])
        sequence, offset, room = (np.empty(len(lengths), np.int64) for _ in range(3))
        for b, content in enumerate(bins):
            at, free = 0, capacity - sum(content)
            for x in content:
                i = waiting[x].pop()
                sequence[i], offset[i], room[i] = (key[0].as_py() + b * groups) * MOST_ROUNDS + number, at, free
                at += x
        out = table.select(own)
        for name, column in zip(PLACED, (sequence, offset, room), strict=True):
            out = out.append_column(name, pa.array(column))
        return out

    schema = ", ".join(f"{c} {pieces.schema[c].dataType.simpleString()}" for c in own)
    return dealt.groupBy("_group").applyInArrow(work, schema + "".join(f", {c} long" for c in PLACED))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """``pieces`` with sequence_id and offset. Groups hold about group_pieces pieces each, whatever the table's size."""
    n, done = pieces.count(), []
    for number in range(MOST_ROUNDS):
        groups = max(1, -(-n // group_pieces))
        packed = _round(pieces, number, groups, capacity)
        left = 0
        if groups > 1:
            packed = materialise(packed, "packed")
            left = packed.where(F.col("_room") > 0).count()
        if not 0 < left <= n // 2:
            done.append(packed)
            break
        done.append(packed.where(F.col("_room") == 0))
        pieces, n = packed.where(F.col("_room") > 0), left
    return reduce(DataFrame.unionByName, done).drop("_room")


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return pack_pieces(materialise(cut(docs, tokenizer, capacity), "pieces"), capacity)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(documents(spark, sf_dir).select("doc_id", "text"))
