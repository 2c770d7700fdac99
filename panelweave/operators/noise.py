"""Noise verdicts of many texts at once, as far as they are plain: most bubbles are ordinary text, and for those the rules of
``functions.predicates`` need not be gone through one by one. All others stay open and are judged by those rules."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import predicates as p

#: Parts that make a text one to be judged, wider than the rules: without their ends, word boundaries and lengths.
_CHROME = "|".join(re.sub(r"\{\d+,\d+\}", "*", x.replace(r"\b", "").removeprefix("^").removesuffix("$")) for x in p.CHROME_PATTERNS)
_CODE = "|".join(x for x in p.CODE_LIKE.split("|"))
_SKIPPED = "[^A-Za-z ]*"
_SOUND = f"^{_SKIPPED}(?:{'|'.join([*(_SKIPPED.join(x) + f'{_SKIPPED}(?: |$)' for x in p.SFX_TOKENS), *(_SKIPPED.join(x) for x in p.SFX_PREFIXES)])})"
#: Characters of plain texts: printable ASCII; Latin, Greek and Cyrillic letters and marks, but none that is a blank or whose
#: upper or lower case has ASCII letters.
PLAIN = " -~\u00a1-\u00ac\u00ae-\u00de\u00e0-\u012f\u0132-\u0148\u014a-\u017e\u0370-\u052f\u2010-\u2027"
#: Single blanks stand between their words.
_OPEN = [f"[^{PLAIN}]|^ | $|  ", f"(?i){_CHROME}", f"(?i){_CODE}", f"(?i){_SOUND}", r"[^ ]{19}"]
_TWO_LETTERS = "[A-Za-z][^ A-Za-z]*[A-Za-z]"
_LETTER = np.full(256, 26, np.int64)
for _i in range(26):
    _LETTER[[65 + _i, 97 + _i]] = _i
_VOWELS = [ord(v) - 97 for v in "aeiou"]


def letter_counts(text: pa.StringArray) -> np.ndarray:
    """How often each text holds each letter from a to z, either case."""
    ends = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    row = np.repeat(np.arange(len(text)), np.diff(ends))
    return np.bincount(row * 27 + _LETTER[data], minlength=27 * len(text)).reshape(-1, 27)[:, :26]


def verdicts(text: pa.StringArray, confidence: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """``kept`` and ``suspicious`` of ``predicates.verdict`` of texts without nulls; both null where those rules have to say.

    Told are texts of too little confidence, which are neither, and plain ones, which are kept: several words (so not
    a URL), more than two or sure (so no lone sound), a vowel, a word of two letters, five letters at least (so not short of them
    for its length) of which none makes up over 0.7, and nothing of _OPEN. Letters are those from A to Z."""
    if not len(text):
        return pa.array([], pa.bool_()), pa.array([], pa.bool_())
    low = confidence < p.MIN_CONFIDENCE
    counts = letter_counts(text)
    n = counts.sum(axis=1)
    blanks = pc.count_substring(text, " ").to_numpy(zero_copy_only=False)
    plain = (confidence >= p.MIN_CONFIDENCE) & (n >= 5) & (counts[:, _VOWELS].sum(axis=1) > 0) & (counts.max(axis=1) <= 0.7 * n)
    plain &= (blanks >= p.SFX_MAX_WORDS) | ((blanks >= 1) & (confidence >= p.SFX_MIN_CONFIDENCE))
    at = np.flatnonzero(plain)
    own = text.take(pa.array(at))
    clear = pc.match_substring_regex(own, _TWO_LETTERS).to_numpy(zero_copy_only=False)
    for pattern in _OPEN:
        clear = clear & ~pc.match_substring_regex(own, pattern).to_numpy(zero_copy_only=False)
    plain[at] = clear
    told = ~(low | plain)
    return pa.array(plain, mask=told), pa.array(np.zeros(len(text), bool), mask=told)
