"""Text repair and speech preparation as Column expressions (tokens by higher-order functions, no Python)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Blanks as ECMAScript sees them (Java's \\s lacks the no-break space and its kin).
BLANK = r"[\s\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
#: The same, one by one.
BLANKS = " \t\n\x0b\x0c\r\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"
#: CJK blocks that speech leaves out.
CJK = r"[\x{3000}-\x{303F}\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}\x{FF00}-\x{FFEF}]"


def trimmed(text: Column) -> Column:
    """Looks at the ends only, where a pattern would look for blanks all over."""
    return F.btrim(text, F.lit(BLANKS))


def collapse(text: Column) -> Column:
    return F.regexp_replace(text, f"{BLANK}++", " ")


def collapsed_trimmed(text: Column) -> Column:
    return F.trim(collapse(text))


def replace_slashes(text: Column) -> Column:
    return F.translate(text, "/\\", "ii")


def space_after_comma(text: Column) -> Column:
    return F.regexp_replace(text, ",([A-Za-z])", ", $1")


def join_hyphenated(text: Column) -> Column:
    # A run of letters is looked at once, from its start: what begins inside it would end where it does.
    return F.regexp_replace(text, rf"(?<![A-Za-z])([A-Za-z]{{3,}}+)-{BLANK}*+([A-Za-z]{{3,}})", "$1 $2")


def core_word(word: Column) -> Column:
    return F.lower(F.substring_index(word, "'", 1))


def strip_cjk(text: Column) -> Column:
    def stripped(s: Column) -> Column:
        # Most texts are ASCII with single spaces and need none of it.
        plain = (F.octet_length(s) == F.char_length(s)) & ~s.contains("  ") & ~s.rlike(r"[\t-\r]")
        return F.when(plain, F.trim(s)).otherwise(collapsed_trimmed(F.regexp_replace(s, CJK, " ")))

    return let(text, stripped)


def let(value: Column, f) -> Column:
    """f(value) with value computed once: what f uses twice would be computed twice, and again at each level above."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _map_tokens(text: Column, token: str, change) -> Column:
    """Apply ``change`` to every match of ``token``, leaving what stands between."""

    def mapped(t: Column) -> Column:
        found = F.regexp_extract_all(t, F.lit(token), F.lit(0))
        pieces = F.zip_with(F.split(t, token, -1), F.transform(found, change), lambda a, b: F.concat(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))
        return F.when(t.rlike(token), F.array_join(pieces, "")).otherwise(t)  # most texts have none

    return let(text, mapped)


_EDGE0, _EDGE1 = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"


def normalize_laughter(text: Column) -> Column:
    """HAHAHAHA... becomes at most five syllables joined by hyphens."""
    syllables = lambda m: F.array_join(F.slice(F.regexp_extract_all(m, F.lit("(..)"), F.lit(1)), 1, 5), "-")
    return _map_tokens(text, rf"(?i){_EDGE0}(?:ha|he|ho|ah){{2,}}{_EDGE1}", syllables)


def _growing(n: int):
    """The first two, three, ... letters of the word after n fragments, then the word."""

    def change(m: Column) -> Column:
        word = F.substring_index(m, "-", -1)
        return F.concat(*(F.concat(F.substring(word, 1, k + 1), F.lit("-")) for k in range(1, n + 1)), word)

    return change


def normalize_stutter(text: Column) -> Column:
    """P-P-POISON becomes PO-POI-POISON; up to three fragments, each the word's first letter."""

    def each(out: Column) -> Column:
        for n in (3, 2, 1):
            pattern = rf"(?i)(?<![A-Za-z0-9_])(?<![A-Za-z]-)([A-Za-z])-" + r"\1-" * (n - 1) + r"(?=\1)([A-Za-z]{2,})" + _EDGE1
            out = _map_tokens(out, pattern, _growing(n))
        return out

    return let(text, lambda t: F.when(t.contains("-"), each(t)).otherwise(t))  # most texts have no hyphen


def normalize_case(text: Column) -> Column:
    """Words of several capital letters in lower case."""
    return _map_tokens(text, "(?<![A-Za-z'])[A-Z']{2,}+(?![A-Za-z'])", F.lower)


def repair(text: Column) -> Column:
    """The part of the repair chain that needs no lexicon, in order."""
    return join_hyphenated(space_after_comma(replace_slashes(collapsed_trimmed(text))))


def speech(text: Column) -> Column:
    return normalize_case(normalize_stutter(normalize_laughter(strip_cjk(text))))


def sentences(text: Column, least: int = 4) -> Column:
    """Array of chunks: sentence-like pieces, gathered until a chunk has ``least`` characters; a short rest joins the last."""
    found = F.regexp_extract_all(text, F.lit("([^.!?]+[.!?]*)"), F.lit(1))
    pieces = F.filter(F.transform(F.when(F.size(found) > 0, found).otherwise(F.array(text)), trimmed), lambda p: p != "")
    start = F.struct(F.lit("").alias("held"), F.expr("cast(array() as array<string>)").alias("out"))

    def add(acc, p):
        held = F.when(acc["held"] == "", p).otherwise(F.concat(acc["held"], F.lit(" "), p))
        full = F.length(held) >= least
        return F.struct(F.when(full, "").otherwise(held).alias("held"), F.when(full, F.concat(acc["out"], F.array(held))).otherwise(acc["out"]).alias("out"))

    def close(acc):
        last = F.size(acc["out"])
        joined = F.transform(acc["out"], lambda x, i: F.when(i == last - 1, F.concat(x, F.lit(" "), acc["held"])).otherwise(x))
        return F.when(acc["held"] == "", acc["out"]).when(last > 0, joined).otherwise(F.array(acc["held"]))

    return F.aggregate(pieces, start, add, close)


def _push(out: Column, piece: Column) -> Column:
    return F.when(trimmed(piece) != "", F.concat(out, F.array(trimmed(piece)))).otherwise(out)


def tts_chunks(text: Column, most: int = 400) -> Column:
    """Array of chunks of at most ``most`` characters: sentences packed greedily, longer ones by words (one word that
    is longer stays whole)."""
    t = trimmed(text)
    found = F.regexp_extract_all(t, F.lit(r"([^.!?…\n]+[.!?…]*\s*)"), F.lit(1))
    pieces = F.when(F.size(found) > 0, found).otherwise(F.array(t))
    state = lambda held, out: F.struct(held.alias("held"), out.alias("out"))
    empty = F.expr("cast(array() as array<string>)")

    def by_word(acc, x):
        longer = F.when(acc["held"] == "", x).otherwise(F.concat(acc["held"], F.lit(" "), x))
        full = F.length(trimmed(longer)) > most
        return state(F.when(full, x).otherwise(longer), F.when(full, _push(acc["out"], acc["held"])).otherwise(acc["out"]))

    def add(acc, piece):
        full = F.length(F.concat(acc["held"], piece)) > most
        out = F.when(full, _push(acc["out"], acc["held"])).otherwise(acc["out"])
        held = F.when(full, F.lit("")).otherwise(acc["held"])
        return F.when(F.length(piece) > most, F.aggregate(F.split(piece, r"\s+"), state(F.lit(""), out), by_word)).otherwise(state(F.concat(held, piece), out))

    packed = F.aggregate(pieces, state(F.lit(""), empty), add, lambda a: _push(a["out"], a["held"]))
    return F.when(t == "", empty).when(F.length(t) <= most, F.array(t)).otherwise(packed)


def is_page_image(url: Column) -> Column:
    return url.rlike(r"(?i)\.(webp|jpg|jpeg|png)") & ~url.rlike("(?i)logo|icon|avatar|banner")


def directory(url: Column) -> Column:
    return F.regexp_extract(url, "^(.*)/[^/]*$", 1)


def position_key(top: Column, image: Column) -> Column:
    return F.concat(F.floor(top + 0.5).cast("string"), F.lit("::"), image)


def parse_position(key: Column) -> Column:
    at = F.instr(key, "::")
    return F.struct(F.substring(key, F.lit(1), at - 1).cast("bigint").alias("top"), F.substring(key, at + 2, F.length(key)).alias("img_key"))
