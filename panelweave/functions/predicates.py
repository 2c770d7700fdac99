"""Noise predicates on recognised text. Fixed values are data below; the rest are CASE expressions over regexes.

Java's word boundary is Unicode-aware, so boundaries are written as ASCII look-arounds.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import collapse, let, trimmed

# --- fixed values: they must equal the original pipeline's for equal results ---
CHROME_PATTERNS = [
    r"IMAGES?\s*SERVER",
    r"REPORT\s*ERROR",
    r"FAVORITE\s*MANGA\s*SITE",
    r"MANGA\s*READER\s*IN\s*THIS\s*COMMUNITY",
    r"ALL\s*COMICS\s*ON\s*THIS\s*WEBSITE",
    r"PREVIEWS?\s*OF\s*THE\s*ORIGINAL\b",
    r"READ.{0,12}\bTOON\b",
    r"FOR\s*FASTER\s*UPDATE",
    r"PLEASE\s*BUY\s*THE\s*COMIC",
    r"\bSHORTCUTS\b",
    r"\bCUSTOMI[SZ]E\.?$",
    r"MANGA\s*ONLINE\s*[»>]",
    r"YOU'?RE\s*READING\s*.+\s*AT\s*MANGANATO",
    r"BOOK\s*MARK\s*BUTTON",
    r"FULL-?SCREEN\s*\(?PC-?ONLY\)?",
    r"^PREV\s*CHAPTER$",
    r"^NEXT\s*CHAPTER$",
    r"^G[O0]?\s*H[A-Z0-9]{0,3}MI?E$",
    r"^CHAPTER\s*\d+$",
]
URL_ONLY = r"^[a-z0-9-]+(\.[a-z0-9-]+)*\.[a-z]{2,6}[a-z0-9]{0,3}$"
INTERJECTION = r"^(?:h*m+|u+m+|u+h+|e+r+|a+h+|o+h+|e+h+)[.…!?]*$"
CODE_LIKE = r"[{}<>;`]|=>|::|//|\bfunction\b|\bconst\b|\bvar\b|\breturn\b|\bimport\b|\bclass\b"
SFX_TOKENS = ["biki", "zun", "bara", "hff", "don", "shuba", "waku", "doki", "dokun", "baki", "zawa", "gan", "ta", "su", "shf", "beki"]
SFX_PREFIXES = ["gyui", "scree", "bushoaaaa", "fwiish"]
SFX_MAX_WORDS, SFX_MIN_CONFIDENCE, SFX_TOKEN_MAX_WORDS = 2, 80.0, 4
MIN_CONFIDENCE, MIN_IMAGE, EDGE_RATIO, DETECTOR_CONFIDENCE = 45.0, 320, 0.02, 0.3
# --- end of fixed values ---

_NOT_BEFORE, _NOT_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def java(pattern: str, ignore_case: bool = False) -> str:
    """An ECMAScript-like pattern for Java: ASCII word boundaries next to letters, $ only at the very end."""
    out = re.sub(r"\\b(?=[A-Za-z])", lambda _: _NOT_BEFORE, pattern)
    out = re.sub(r"(?<=[A-Za-z])\\b", lambda _: _NOT_AFTER, out)
    if out.endswith("$"):
        out = out[:-1] + r"\z"
    return f"(?i){out}" if ignore_case else out


def words(text: Column) -> Column:
    return F.split(trimmed(text), r"\s+")


def letters(text: Column) -> Column:
    return F.regexp_replace(text, "[^a-zA-Z]", "")


def several_words(t: Column) -> Column:
    """Of a trimmed text."""
    return t.rlike(r"\s")


_MARKS = "|".join(x for x in CODE_LIKE.split("|") if not x.startswith(r"\b"))
_KEYWORDS = rf"(?i){_NOT_BEFORE}(?:{'|'.join(x.strip(chr(92) + 'b') for x in CODE_LIKE.split('|') if x.startswith(chr(92) + 'b'))}){_NOT_AFTER}"


def is_garbage(text: Column) -> Column:
    """Rules about words are patterns over the whole text, which end at the first word that decides."""

    def judge(s: Column) -> Column:
        t, low = s["t"], s["low"]
        n = F.length(low)
        interjection = low.rlike(java(re.sub(r"\[.*?\]\*", "", INTERJECTION))) & F.lower(F.regexp_replace(t, r"\s+", "")).rlike(java(INTERJECTION))
        # Over 0.7 of some thirty letters have three equal ones in a row (without, 2/3 at most).
        uneven = (n <= 30) | low.rlike(r"(.)\1\1")
        top = F.greatest(*(n - F.length(F.replace(low, F.lit(chr(97 + i)), F.lit(""))) for i in range(26)))
        return (
            F.when(low.isin("i", "a"), False)
            .when(F.length(t) < 2, True)
            .when(interjection, False)
            .when((F.try_divide(n, F.length(t)) < 0.55) & ~((n >= 5) & several_words(t)), True)
            .when((n > 3) & ~low.rlike("[aeiou]"), True)
            .when(t.rlike(_MARKS) | t.rlike(_KEYWORDS), True)
            .when((n > 18) & t.rlike(r"\S{19}") & t.rlike(r"(?<!\S)[^\sA-Za-z]*+(?:[A-Za-z][^\sA-Za-z]*+){19}"), True)
            .when(~t.rlike(r"[A-Za-z][^\sA-Za-z]*+[A-Za-z]") & several_words(t), True)
            .when((n > 4) & uneven & (F.try_divide(top, n) > 0.7), True)
            .otherwise(False)
        )

    return let(trimmed(text), lambda t: let(F.struct(t.alias("t"), F.lower(letters(t)).alias("low")), judge))


def is_chrome(text: Column) -> Column:
    return let(F.trim(collapse(F.upper(text))), lambda shown: reduce(lambda a, b: a | b, (shown.rlike(java(p)) for p in CHROME_PATTERNS)))


def is_url_only(text: Column) -> Column:
    return trimmed(text).rlike(java(URL_ONLY, True))


def is_sound_effect(text: Column, confidence: Column) -> Column:
    def judge(w: Column) -> Column:
        n = F.size(w)
        first = F.regexp_replace(F.lower(F.get(w, F.lit(0))), "[^a-z]", "")
        known = first.isin(SFX_TOKENS) | reduce(lambda a, b: a | b, (first.startswith(p) for p in SFX_PREFIXES))
        return (
            F.when((n == 1) & first.isin("i", "a"), False)
            .when((n <= SFX_MAX_WORDS) & (confidence < SFX_MIN_CONFIDENCE), True)
            .when((n <= SFX_TOKEN_MAX_WORDS) & known, True)
            .otherwise(False)
        )

    # No more words are told apart than the rules count.
    return let(F.split(trimmed(text), r"\s+", SFX_TOKEN_MAX_WORDS + 1), judge)


NOISE = ["garbage", "chrome", "url_only", "sound"]


def with_noise(df: DataFrame, text: str = "text", confidence: str = "confidence") -> DataFrame:
    """Adds every noise flag once, and from them ``kept`` and ``suspicious``, so that no rule is computed twice."""
    t, c = F.col(text), F.col(confidence)
    flags = dict(zip(NOISE, (is_garbage(t), is_chrome(t), is_url_only(t), is_sound_effect(t, c)), strict=True))
    sure = c >= MIN_CONFIDENCE
    kept = sure & ~reduce(lambda a, b: a | b, (F.col(x) for x in NOISE))
    return df.withColumns(flags).withColumns({"kept": kept, "suspicious": sure & F.col("garbage") & several_words(trimmed(t))})


def verdict(text: Column, confidence: Column) -> Column:
    """``kept`` and ``suspicious`` of ``with_noise`` as a struct, for what stands in an array: a rule is looked at only where
    those before it leave it open."""
    clean = ~is_url_only(text) & ~is_sound_effect(text, confidence) & ~is_chrome(text)
    told = let(is_garbage(text), lambda g: F.struct((~g & clean).alias("kept"), (g & several_words(trimmed(text))).alias("suspicious")))
    return F.when(confidence >= MIN_CONFIDENCE, told).otherwise(F.struct(F.lit(False).alias("kept"), F.lit(False).alias("suspicious")))


def is_kept(text: Column, confidence: Column) -> Column:
    return (confidence >= MIN_CONFIDENCE) & ~is_garbage(text) & ~is_chrome(text) & ~is_url_only(text) & ~is_sound_effect(text, confidence)


def is_dropped_suspicious(text: Column, confidence: Column) -> Column:
    return (confidence >= MIN_CONFIDENCE) & is_garbage(text) & several_words(trimmed(text))


def is_word(text: Column) -> Column:
    """A recognised word that counts at all: with a letter, so not blank."""
    return text.rlike("[A-Za-z]")


CHAPTER_LABEL = r"(?i)^Ch\.?\s*\d"


def is_real_content(text: Column, chrome: Column | None = None) -> Column:
    """``chrome``: that flag, where it is known already."""
    return ~text.rlike(CHAPTER_LABEL) & ~(is_chrome(text) if chrome is None else chrome)


def is_speakable(text: Column) -> Column:
    return text.rlike("[A-Za-z0-9]")


def cut_off_below(y1: Column, page_h: Column, free: Column) -> Column:
    return ~free & (y1 >= page_h - page_h * EDGE_RATIO)


def cut_off_above(y0: Column, page_h: Column, free: Column) -> Column:
    return ~free & (y0 <= page_h * EDGE_RATIO)


def is_eligible_image(natural_w: Column, natural_h: Column, layout_w: Column | None = None, layout_h: Column | None = None) -> Column:
    use = lambda n, l: n if l is None else F.when(F.coalesce(n, F.lit(0)) != 0, n).otherwise(l)  # noqa: E731, E741
    return (use(natural_w, layout_w) >= MIN_IMAGE) & (use(natural_h, layout_h) >= MIN_IMAGE)


def in_viewport(left: Column, top: Column, right: Column, bottom: Column, viewport_w: Column, viewport_h: Column, margin: float = 0.0) -> Column:
    return (bottom > -margin) & (top < viewport_h + margin) & (right > 0) & (left < viewport_w)


def detector_confidence(obj: Column, cls0: Column, cls1: Column) -> Column:
    return obj * F.greatest(cls0, cls1)
