"""Token counts by compiled finite-state transducers.

A byte-level BPE file becomes two deterministic transducers.

The first splits text as the file's pattern does. Its states and the classes of code points are few, so the whole table is
compiled at once; a transition says whether a pretoken starts at this code point, at the one before, or both (the pattern
looks ahead for blanks and contractions, the transducer answers a step later). Text is cut into chunks of CHUNK code
points; all chunks step together from every state, which gives each a map from states to states (nearly all collapse to
one state within a few steps), a parallel prefix scan composes the maps, and a second run from the states now known emits
the starts.

The second reads the bytes of a pretoken; each transition carries the change in the number of tokens (an added byte may
join two into one, so it may be negative). A state is what can still matter: the longest suffix that begins some token
and, for each place in it from which a token may come, what of the token before it can still forbid one, and the number of
tokens relative to now. Two tokens may stand side by side unless a merge across their border comes before those that build
them; exactly one token can end at each place, which makes the transducer deterministic. The complete machine would hold a state for each context of each
of some 90,000 beginnings of tokens, so transitions are compiled when first met, kept for later rows and tasks of the
worker, and dropped beyond MOST_STATES: memory is bounded and results don't depend on it. Pretokens all start in the
same state, so all of a block step together whatever chunk they lie in.

Special tokens' strings are one token each and separate what stands beside them, as the library's default has it.

Nulls: a null text is empty and has no tokens; a null doc_id stays null. Repeated rows are counted each. An empty table
gives no rows. Texts are counted whole; long ones in parts that end where a pretoken starts. Other columns are ignored,
whatever their names.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents

CHUNK, BLOCK, TOGETHER, MOST_STATES, LIMIT = 256, 1 << 20, 64, 150_000, 1024
OUT = "n_bytes long, n_tokens long, over_limit boolean"
PATTERN_KIND = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}

# Classes of code points. Letters that can follow an apostrophe in a contraction have their own.
CLASSES = ("end", "space", "white", "quote", "letter", "stmd", "rv", "e", "l", "number", "other")
LETTERS = {"letter", "stmd", "rv", "e", "l"}
STATES = ("fresh", "space", "white", "spaces", "whites", "letters", "numbers", "others", "quote", "quote-rv", "quote-l")
HERE, BEFORE = 1, 2


def pretokenizer() -> tuple[np.ndarray, np.ndarray]:
    """(next state, starts) by state and class. State names say what the current pretoken is so far: spaces and whites are
    runs of two blanks or more that end so; quote is an apostrophe at a pretoken's start."""

    def start(c: str) -> str:
        if c in LETTERS:
            return "letters"
        return {"end": "fresh", "number": "numbers", "other": "others"}.get(c, c)

    def begin(c: str) -> tuple[str, int]:
        return start(c), 0 if c == "end" else HERE

    def after_space(c: str) -> str:
        return "others" if c in ("quote", "other") else start(c)

    def step(s: str, c: str) -> tuple[str, int]:
        blank, last = c in ("space", "white"), c == "end"
        if s == "fresh":
            return begin(c)
        if s in ("space", "white", "spaces", "whites"):
            if blank:
                return c + "s", 0
            if last:
                return "fresh", 0
            if s == "space":
                return after_space(c), 0
            if s == "spaces":
                return after_space(c), BEFORE
            return start(c), HERE if s == "white" else HERE | BEFORE
        if s in ("quote-rv", "quote-l"):
            if c == ("e" if s == "quote-rv" else "l"):
                return "fresh", 0
            return ("letters", BEFORE) if c in LETTERS else (start(c), BEFORE | begin(c)[1])
        if s == "quote":
            if c == "stmd":
                return "fresh", 0
            if c in ("rv", "l"):
                return f"quote-{c}", 0
            return ("others", 0) if c in ("quote", "other") else begin(c)
        same = {"letters": LETTERS, "numbers": {"number"}, "others": {"quote", "other"}}[s]
        return (s, 0) if c in same else begin(c)

    table = [[step(s, c) for c in CLASSES] for s in STATES]
    return np.array([[STATES.index(t[0]) for t in row] for row in table], np.uint8), np.array([[t[1] for t in row] for row in table], np.uint8)


def classes(pre_tokenizer) -> np.ndarray:
    """The class of every code point as the library has it (its tables are of another Unicode version than others')."""
    out = np.full(0x110000, CLASSES.index("other"), np.uint8)
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    at = np.frombuffer(every.encode("utf-32-le"), np.uint32)

    def joins(c: str, border: str) -> bool:
        return len(pre_tokenizer.pre_tokenize_str(border + c + border)) == 1

    for _, (low, high) in pre_tokenizer.pre_tokenize_str(every):  # each of one class, but for a space in front
        c = every[high - 1]
        name = "letter" if joins(c, "x") else "number" if joins(c, "1") else "other" if joins(c, "!") else "white"
        out[at[low:high]] = CLASSES.index(name)
    for name, chars in (("space", " "), ("quote", "'"), ("stmd", "stmd"), ("rv", "rv"), ("e", "e"), ("l", "l")):
        out[[ord(c) for c in chars]] = CLASSES.index(name)
    return out


class Splitter:
    """The first transducer over chunks."""

    def __init__(self, pre_tokenizer):
        self.next, self.starts = pretokenizer()
        self.classes = classes(pre_tokenizer)

    def chunk_maps(self, columns: np.ndarray) -> np.ndarray:
        """``columns``: classes, a chunk a column. The state after each chunk (row) from each state (column)."""
        states, chunks = len(STATES), columns.shape[1]
        now = np.repeat(np.arange(states, dtype=np.uint8)[:, None], chunks, axis=1)
        early = min(16, len(columns))
        for row in columns[:early]:
            now = self.next[now, row]
        one = (now == now[0]).all(axis=0)
        for which, few in ((one, 1), (~one, states)):
            if which.any():
                part = now[:few, which]
                for row in columns[early:, which]:
                    part = self.next[part, row]
                now[:, which] = part
        return now.T

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Inclusive prefix composition, in log2(chunks) rounds."""
        maps, d = maps.copy(), 1
        while d < len(maps):
            maps[d:] = np.take_along_axis(maps[d:], maps[:-d], axis=1)
            d *= 2
        return maps

    def __call__(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a pretoken starts at each of these code points, given by class."""
        n = len(kinds)
        columns = np.zeros(-(-max(n, 1) // CHUNK) * CHUNK, np.uint8)
        columns[:n] = kinds
        columns = np.ascontiguousarray(columns.reshape(-1, CHUNK).T)
        state = np.zeros(columns.shape[1], np.uint8)
        state[1:] = self.scan(self.chunk_maps(columns))[:-1, 0]
        said = np.empty_like(columns)
        for t, row in enumerate(columns):
            said[t] = self.starts[state, row]
            state = self.next[state, row]
        said = said.T.ravel()
        here = said & HERE > 0
        here[:-1] |= said[1:] & BEFORE > 0
        return here[:n]


class Counter:
    """The second transducer: tokens of a pretoken's bytes. States are numbered; 0 is the start."""

    def __init__(self, file: str):
        with open(file, encoding="utf-8") as f:
            spec = json.load(f)
        kind, model = spec["pre_tokenizer"], spec["model"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
        if model["type"] != "BPE" or not plain or spec.get("normalizer") or any(kind.get(k) != v for k, v in PATTERN_KIND.items()):
            raise ValueError(f"{file}: only byte-level BPE with the usual pattern can be compiled")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError(f"{file}: special tokens with conditions")
        self.special = [t["content"] for t in spec["added_tokens"]]
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(printable)]
        byte = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.ids: dict[bytes, int] = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        self.merges: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}  # token: left, right, rank
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b, ab = (model["vocab"][x] for x in (a, b, a + b))
            older = all(x not in self.parts or self.parts[x][2] < rank for x in (a, b))
            if ab in self.parts or not older:
                raise ValueError(f"{file}: merges out of order")
            self.merges[a, b] = rank
            self.parts[ab] = (a, b, rank)
        self.beginnings = {t[:k] for t in self.ids for k in range(1, len(t))}
        self.soonest: dict[tuple[int, bytes], int] = {}  # rank of the first merge of a token with one that begins so
        text = {i: t for t, i in self.ids.items()}
        for (a, b), rank in self.merges.items():
            for k in range(len(text[b]) + 1):
                self.soonest.setdefault((a, text[b][:k]), rank)
        self.lefts: dict[int, tuple] = {}
        self.rights: dict[int, tuple] = {}
        self.forget()

    def forget(self) -> None:
        self.states = [(b"", ((0, (), 0),))]
        self.numbers = {self.states[0]: 0}
        self.allowed: dict[tuple[tuple, int], bool] = {}
        self.edges: dict[tuple[tuple, bytes], tuple] = {}
        self.slots(1 << 18)

    def slots(self, size: int) -> None:
        """An empty hash table of transitions: key state * 256 + byte, next state, change in tokens."""
        self.shift, self.filled = np.uint64(64 - size.bit_length() + 1), 0
        self.key, self.to, self.change = np.full(size, -1, np.int64), np.zeros(size, np.int32), np.zeros(size, np.int16)

    def spine(self, token: int, side: int) -> tuple[tuple[int, float], ...]:
        """The pieces that stand at one edge while a token is built, with the rank of the merge that takes each away."""
        known = (self.lefts, self.rights)[side]
        if token not in known:
            out, taken = [(token, float("inf"))], token
            while taken in self.parts:
                rank = self.parts[taken][2]
                taken = self.parts[taken][side]
                out.append((taken, rank))
            known[token] = tuple(out)
        return known[token]

    def matters(self, edge: tuple, text: bytes) -> tuple:
        """The part of a right edge that can still forbid a token which begins with ``text``, or ends inside it."""
        key = edge, text
        if key not in self.edges:
            def least(x: int) -> float:
                inside = (self.merges.get((x, self.ids.get(text[:k], -1)), float("inf")) for k in range(1, len(text)))
                return min(self.soonest.get((x, text), float("inf")), *inside, float("inf"))

            self.edges[key] = tuple((x, gone) for x, gone in edge if least(x) < gone)
        return self.edges[key]

    def side_by_side(self, edge: tuple, b: int) -> bool:
        """Whether token b may follow a token with this right edge: no merge across the border comes before those that
        build the two. At equal ranks the one further left does."""
        key = edge, b
        if key not in self.allowed:
            self.allowed[key] = not any(
                (m := self.merges.get((x, y))) is not None and m < x_gone and m <= y_gone
                for x, x_gone in edge for y, y_gone in self.spine(b, 0)
            )
        return self.allowed[key]

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        window, places = self.states[state]
        text = window + bytes([byte])
        for k, edge, tokens in places:
            token = self.ids.get(text[k:])
            if token is not None and self.side_by_side(edge, token):
                change = tokens + 1
                break
        else:
            raise AssertionError("no token can end here")
        # Places from which a token may still come: what stands after them begins one.
        left = [(k, edge, tokens) for k, edge, tokens in places if text[k:] in self.beginnings]
        low = left[0][0] if left else len(text)
        new = (text[low:], (
            *((k - low, self.matters(edge, text[k:]), tokens - change) for k, edge, tokens in left),
            (len(text) - low, self.matters(self.spine(token, 1), b""), 0),
        ))
        number = self.numbers.setdefault(new, len(self.states))
        if number == len(self.states):
            self.states.append(new)
        return number, change

    def slot(self, key: int) -> int:
        at, mask = int((key * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> int(self.shift)), len(self.key) - 1
        while self.key[at] != -1 and self.key[at] != key:
            at = at + 1 & mask
        return at

    def add(self, key: int) -> None:
        if 2 * self.filled > len(self.key):
            old = self.key, self.to, self.change
            self.slots(2 * len(self.key))
            for i in np.flatnonzero(old[0] != -1).tolist():
                self._put(int(old[0][i]), int(old[1][i]), int(old[2][i]))
        self._put(key, *self.compile(key >> 8, key & 255))

    def _put(self, key: int, to: int, change: int) -> None:
        at = self.slot(key)
        self.key[at], self.to[at], self.change[at] = key, to, change
        self.filled += 1

    def look(self, key: np.ndarray) -> np.ndarray:
        """Where the transitions stand; missing ones are compiled."""
        while True:
            at = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)
            off = np.flatnonzero(self.key[at] != key)
            while len(off):
                off = off[self.key[at[off]] != -1]
                at[off] = at[off] + 1 & len(self.key) - 1
                off = off[self.key[at[off]] != key[off]]
            lost = key[self.key[at] == -1]
            if not len(lost):
                return at
            for k in np.unique(lost).tolist():
                self.add(k)

    def __call__(self, raw: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of the pretokens that stand at these places of ``raw``."""
        if len(self.states) > MOST_STATES:
            self.forget()
        order = np.argsort(np.minimum(TOGETHER, length).astype(np.uint8) ^ 255, kind="stable")
        at, sizes = at[order], length[order]
        tokens, state = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        ascending = -np.minimum(sizes, TOGETHER)
        for t in range(min(TOGETHER, int(sizes.max(initial=0)))):
            m = int(np.searchsorted(ascending, -t, "left"))
            found = self.look(state[:m] << 8 | raw[at[:m] + t])
            state[:m] = self.to[found]
            tokens[:m] += self.change[found]
        known: dict[int, tuple[int, int]] = {}
        for i in np.flatnonzero(sizes > TOGETHER).tolist():
            s, n = int(state[i]), int(tokens[i])
            for b in raw[at[i] + TOGETHER : at[i] + sizes[i]].tobytes():
                move = known.get(s << 8 | b)
                if move is None:
                    move = known[s << 8 | b] = self.compile(s, b)
                s = move[0]
                n += move[1]
            tokens[i] = n
        out = np.empty_like(tokens)
        out[order] = tokens
        return out


class Tokenizer:
    """Token counts of texts by a file's two transducers."""

    def __init__(self, file: str):
        self.counter = Counter(file)
        self.splitter = Splitter(tokenizers.Tokenizer.from_file(file).pre_tokenizer)
        self.apart = re.compile("|".join(map(re.escape, sorted(self.counter.special, key=len, reverse=True))) or r"(?!)")

    def block(self, sections: list[str], open_end: bool = False) -> tuple[np.ndarray, int]:
        """Tokens of each section. With ``open_end``, of the only section up to its last start, and where that is."""
        text = "\0".join(sections) + "\0"  # the end of a section, classed so below
        raw = np.frombuffer(text.encode(), np.uint8)
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        ends = np.cumsum([len(s) + 1 for s in sections]) - 1
        kinds = self.splitter.classes[points]
        kinds[ends] = 0
        marks = np.flatnonzero(self.splitter(kinds[:-1] if open_end else kinds))
        if open_end:
            marks, ends = marks[:-1], marks[-1:]
        place = np.zeros(len(points) + 1, np.int64)
        np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF), out=place[1:])
        stops = np.minimum(np.append(marks[1:], ends[-1]), ends[np.searchsorted(ends, marks)])
        at = place[marks]
        tokens = self.counter(raw, at, place[stops] - at)
        return np.bincount(np.searchsorted(ends, marks), tokens, len(ends)).astype(np.int64), int(ends[-1])

    def long(self, section: str) -> int:
        """A section in parts of BLOCK code points; each but the last ends where a pretoken starts."""
        total, at, size = 0, 0, BLOCK
        while len(section) - at > size:
            part, end = self.block([section[at : at + size]], open_end=True)
            total += int(part[0])
            at, size = at + end, BLOCK if end else 2 * size
        return total + int(self.block([section[at:]])[0][0])

    def count(self, texts: list[str]) -> np.ndarray:
        total = np.zeros(len(texts), np.int64)
        waiting, owners, size = [], [], 0

        def flush() -> None:
            nonlocal waiting, owners, size
            if waiting:
                np.add.at(total, owners, self.block(waiting)[0])
            waiting, owners, size = [], [], 0

        for i, text in enumerate(texts):
            sections = self.apart.split(text)
            total[i] += len(sections) - 1
            for s in sections:
                if len(s) > BLOCK:
                    total[i] += self.long(s)
                elif s:
                    waiting.append(s)
                    owners.append(i)
                    size += len(s)
                    if size > BLOCK:
                        flush()
        flush()
        return total


_compiled: dict[str, Tokenizer] = {}  # by file, for all tasks of a worker


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit. ``tokenizer``: a byte-level BPE file."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _compiled:
            _compiled[tokenizer] = Tokenizer(tokenizer)
        for batch in batches:
            for low in range(0, batch.num_rows, 512):
                part = batch.slice(low, 512)
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = _compiled[tokenizer].count(texts)
                size = pa.array([len(t.encode()) for t in texts], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {OUT}")


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
