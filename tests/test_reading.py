"""Rescue of thin captures, filters by place, chunks for speech, log rules: small cases worked out by hand or in plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from panelweave.functions import predicates, text as t
from panelweave.operators import detect, layout, noise
from panelweave.plans import reading
from panelweave.sources import web

WORD = "capture_id long, word_ix int, text string, x0 double, y0 double, x1 double, y1 double, confidence double"


def test_rescue_takes_crops_only_where_little_was_read(spark):
    words = [
        (1, 0, "Ch.68.2", 0, 0, 50, 10, 90), (1, 1, "HORSE!", 100, 100, 150, 120, 80),  # one of real content: thin
        (2, 0, "HELLO", 0, 0, 50, 10, 90), (2, 1, "THERE", 60, 0, 99, 10, 90),  # two: stays
        (3, 0, "NEXT CHAPTER", 0, 0, 50, 10, 90),  # thin, but nothing was found in crops
    ]
    crops = [
        (1, 7, "HORSE!", 1, 0, 51, 20, 95, 99, 100), (1, 8, "RUN!", 5, 5, 45, 25, 70, 300, 40),
        (2, 7, "MORE", 1, 1, 9, 9, 95, 10, 10), (4, 0, "ALONE", 1, 2, 30, 12, 88, 20, 30),
    ]
    to = lambda rows: [tuple(float(x) if k > 2 else x for k, x in enumerate(r)) for r in rows]
    got = detect.rescue(spark.createDataFrame(to(words), WORD), spark.createDataFrame(to(crops), WORD + ", crop_x0 double, crop_y0 double")).collect()
    assert sorted((r.capture_id, r.word_ix, r.text, r.x0, r.y0, r.confidence) for r in got) == [
        (1, 0, "HORSE!", 100.0, 100.0, 95.0), (1, 1, "Ch.68.2", 0.0, 0.0, 90.0), (1, 2, "RUN!", 305.0, 45.0, 70.0),
        (2, 0, "HELLO", 0.0, 0.0, 90.0), (2, 1, "THERE", 60.0, 0.0, 90.0), (3, 0, "NEXT CHAPTER", 0.0, 0.0, 90.0),
        (4, 0, "ALONE", 21.0, 32.0, 88.0),
    ]


def test_on_page(spark):
    box = "x0 double, y0 double, x1 double, y1 double"
    bubbles = spark.createDataFrame([(c, i, 100.0 * i, 0.0, 100.0 * i + 50, 20.0) for c in (1, 2) for i in range(4)], f"capture_id long, bubble_ix int, {box}")
    overlays = spark.createDataFrame([(1, 100.0, 10.0, 120.0, 30.0), (1, 150.0, 0.0, 200.0, 20.0)], f"capture_id long, {box}")  # the second only touches
    images = spark.createDataFrame([(1, 90.0, 0.0, 240.0, 20.0), (1, 140.0, 0.0, 230.0, 9.0)], f"capture_id long, {box}")
    keys = lambda d: sorted((r.capture_id, r.bubble_ix) for r in d.collect())
    assert keys(layout.on_page(bubbles, overlays, images)) == [(1, 2), (2, 0), (2, 1), (2, 2), (2, 3)]
    assert keys(layout.on_page(bubbles)) == keys(bubbles)


def test_order_carries_text(spark):
    rows = [(1, i, f"t{i}", x, y, x + 50.0, y + 20.0, "rtl", 520.0) for i, (x, y) in enumerate([(0.0, 0.0), (300.0, 2.0), (150.0, 80.0)])]
    b = spark.createDataFrame(rows, "capture_id long, bubble_ix int, text string, x0 double, y0 double, x1 double, y1 double, direction string, canvas_w double")
    got = sorted((r.seq, r.bubble_ix, r.text) for r in layout.order_bubbles(b, None, ["text"]).collect())
    assert got == [(0, 1, "t1"), (1, 0, "t0"), (2, 2, "t2")]


def test_page_reading_over_the_whole_table(spark, data):
    """Every stage put together in plain Python: admission, crops, both attempts, noise, edges, each page's own order. Boxes
    and texts of bubbles, noise flags and repairs come from the parts that have SQL of their own."""
    inputs = {k: x.cache() for k, x in reading.inputs(spark, data).items()}
    pages = {r.capture_id: r for r in inputs["pages"].collect()}
    cuts, every = {}, {}
    for r in sorted(inputs["cuts"].collect(), key=lambda r: r.cut_ix):
        cuts.setdefault(r.capture_id, []).append(r)
    crops = inputs["crop_words"].where("crop_x1 - crop_x0 >= 4 and crop_y1 - crop_y0 >= 4 and text rlike '[A-Za-z]'")
    rescued = detect.rescue(inputs["words"].where("text rlike '[A-Za-z]'").select(*reading.WORD), crops)
    # No word with a letter is lost on the way: what isn't an own word is in a crop.
    texts = lambda d: sorted((r.capture_id, r.text) for r in d.collect())
    from panelweave.sources import synth

    assert set(texts(synth.words(spark, data).where("text rlike '[A-Za-z]'"))) == set(texts(rescued))
    for attempt, words in enumerate((rescued, inputs["retry_words"].where("text rlike '[A-Za-z]'"))):
        sized = words.select(*reading.WORD).join(inputs["pages"], "capture_id")
        bubbles = predicates.with_noise(layout.on_page(layout.reconstruct(sized), inputs["overlays"], inputs["images"]))
        for r in bubbles.collect():
            every.setdefault((r.capture_id, attempt), []).append(r)
    twice = {r.capture_id for r in inputs["retry_words"].select("capture_id").distinct().collect()}
    ordered, chosen = [], 0
    for c, page in pages.items():
        found = [every.get((c, k), []) for k in (0, 1)]
        kept = [[r for r in f if r.kept] for f in found]
        lost = [sum(r.suspicious for r in f) for f in found]
        sure = [sum(r.confidence for r in k) / len(k) if k else 0 for k in kept]
        k = 0
        if c in twice and ((kept[0] and sure[0] < 78) or lost[0] > 0):
            k = int(lost[1] < lost[0] or (lost[1] == lost[0] and sure[1] > sure[0]))
            chosen += k
        margin = page.canvas_h * 0.02
        seen = sorted((r for r in kept[k] if page.free or not (r.y1 >= page.canvas_h - margin or r.y0 <= margin)), key=lambda r: r.bubble_ix)
        cut = cuts.get(c, [])
        vertical = tuple(np.array([getattr(x, n) for x in cut if x.orient == "v"], float) for n in ("x0", "y0", "y1"))
        place = layout.order(layout.Boxes(*([getattr(r, n) for r in seen] for n in ("x0", "y0", "x1", "y1"))), page.direction == "rtl", vertical, sum(x.orient == "h" for x in cut), page.canvas_w)
        ordered += [(c, i, seen[j].text) for i, j in enumerate(place)]
    assert chosen > 10 and len(ordered) > 2000
    fixed = reading.repair(spark.createDataFrame(ordered, "capture_id long, seq int, text string"), inputs["lexicon"], inputs["names"])
    lines = fixed.select("capture_id", "seq", F.posexplode(t.sentences(F.col("text"))).alias("part", "text"))
    want = sorted((r.capture_id, r.seq, r.part, r.text) for r in lines.collect() if re.search("[A-Za-z0-9]", r.text))
    got = sorted((r.capture_id, r.seq, r.part, r.text) for r in reading.page_reading(spark, data).collect())
    assert got == want


def test_one_pass_repairs_like_the_chain_of_steps(spark, data):
    """Over all damaged lines, and texts made for what crosses words."""
    from panelweave.operators import lexicon_repair as lr
    from panelweave.plans.queries import _lexicon, _names
    from panelweave.sources import synth

    made = ["", None, "  the- \u00a0the ", "for-\nthe the-the-the", "H0PE,the w1ll it'sthe ITWAS", "a-bcd abc-def-ghi THE-the", "THE,the- the/the", "x- yz abc- d the-- the", "ofthe-\nsucha THE"]
    odd = spark.createDataFrame([(-1 - i, 0, x) for i, x in enumerate(made)], "doc_id long, ix int, text string")
    lines = synth.noisy_lines(spark, data).select("doc_id", "ix", "text").unionByName(odd).cache()
    keys, lexicon, names = ["doc_id", "ix"], _lexicon(spark, data).cache(), _names(spark, data)
    for given in (names, None):
        out = lines.select(*keys, t.collapsed_trimmed(F.coalesce("text", F.lit(""))).alias("text"))
        out = lr.fix_digits(out, keys, lexicon).select(*keys, t.space_after_comma(F.col("fixed")).alias("text"))
        out = lr.split_fused(out, keys, lexicon).select(*keys, t.join_hyphenated(F.col("fixed")).alias("text"))
        want = sorted(map(tuple, lr.respell(out, keys, given).select(*keys, "fixed").collect()))
        assert sorted(map(tuple, lr.repaired(lines, keys, lexicon, given).select(*keys, "fixed").collect())) == want and len(want) > 500


def test_pages_are_ordered_by_their_own_width(spark):
    """The same bubbles and cuts on pages of other widths and directions are other panels, and another order."""
    cut = [(350.0, 14.0, 120.0), (700.0, 22.0, 147.0)]
    sizes = {1: (1080.0, "rtl"), 2: (520.0, "rtl"), 3: (1080.0, "ltr")}
    x, y = np.array([34.0, 144, 822, 948, 249, 311]), np.array([112.0, 55, 35, 107, 33, 53])
    at = layout.Boxes(x, y, x + 60, y + 20)
    want = {c: layout.order(at, d == "rtl", tuple(np.array(v) for v in zip(*cut, strict=True)), 0, w) for c, (w, d) in sizes.items()}
    assert want == {1: [2, 3, 4, 5, 1, 0], 2: [3, 2, 4, 5, 1, 0], 3: [4, 1, 5, 0, 2, 3]}
    words = spark.createDataFrame([(c, i, f"word{i}hereabout", *(float(v) for v in (x[i], y[i], x[i] + 60, y[i] + 20)), 95.0) for c in sizes for i in range(6)], WORD)
    cuts = spark.createDataFrame([(c, "v", i, x0, y0, x0 + 4, y1) for c in sizes for i, (x0, y0, y1) in enumerate(cut)], "capture_id long, orient string, cut_ix int, x0 double, y0 double, x1 double, y1 double")
    pages = spark.createDataFrame([(c, w, 150.0, d, True) for c, (w, d) in sizes.items()], "capture_id long, canvas_w double, canvas_h double, direction string, free boolean")
    got = reading.read_pages(words, cuts, spark.createDataFrame([("x",)], "word string"), pages=pages).collect()
    assert {c: [int(r.text[4]) for r in sorted(got, key=lambda r: r.seq) if r.capture_id == c] for c in sizes} == want


def _chunks(text: str, most: int) -> list[str]:
    blank = " \t\n\x0b\x0c\r"
    t = text.strip(blank)
    if len(t) <= most:
        return [t] if t else []
    out, held = [], ""

    def push(s):
        if s.strip(blank):
            out.append(s.strip(blank))

    for piece in re.findall(r"[^.!?…\n]+[.!?…]*[ \t\n\x0b\f\r]*", t) or [t]:
        if len(held + piece) > most:
            push(held)
            held = ""
        if len(piece) <= most:
            held += piece
            continue
        for word in re.split(r"[ \t\n\x0b\f\r]+", piece):
            longer = f"{held} {word}" if held else word
            if len(longer.strip(blank)) > most:
                push(held)
                held = word
            else:
                held = longer
    push(held)
    return out


def test_tts_chunks_against_plain_python(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-1, "x" * 900), (-2, " \n "), (-3, ("word " * 130) + ". " + "y" * 500 + " end."), (-4, "...!?")], "doc_id long, text string")
    for most in (400, 60):
        for r in docs.unionByName(odd).select("doc_id", "text", t.tts_chunks(F.col("text"), most).alias("c")).collect():
            assert r.c == _chunks(r.text, most), r.doc_id


def test_log_rules(spark):
    log = [
        (1, "FINAL READING ORDER: a"), (1, "speaking: a"), (1, "speaking (piper): b"), (1, "speaking (attempt 2): c"), (1, "1 bubble(s) dropped as garbage-shaped"), (1, "FATAL: x"), (1, "ERROR y"),
        (2, "FINAL READING ORDER: b"), (2, "FINAL READING ORDER: c"), (2, "error in lower case"),
    ]
    found = web.log_summary(spark.createDataFrame(log, "session_id long, line string"))
    assert {r.session_id: tuple(r)[1:] for r in found.collect()} == {1: (1, 2, 1, 2, 1), 2: (2, 0, 0, 0, 0)}
    passes = lambda rows: web.suite_result(spark.createDataFrame(rows, "session_id long, ok boolean, page_errors int, hit_cap boolean"), found).first()
    assert passes([(2, True, 0, False)]).passes and passes([(2, True, 0, False), (3, True, 0, False)]).passes
    assert not passes([(1, True, 0, False)]).passes  # error lines
    assert not passes([(2, False, 0, False)]).passes and not passes([(2, True, 1, False)]).passes and not passes([(2, True, 0, True)]).passes
    r = passes([(1, False, 5, True), (2, True, 0, False)])
    assert (r.sessions, r.started, r.captures, r.errors, r.page_errors, r.capped, r.passes) == (2, 1, 2, 0, 0, 0, False)


def test_captures_and_sinks(spark, tmp_path):
    (tmp_path / "shots").mkdir()
    (tmp_path / "shots" / "a.png").write_bytes(b"\x89PNG-1")
    (tmp_path / "shots" / "b.png").write_bytes(b"\x89PNG-22")
    got = web.captures(spark, str(tmp_path / "shots"))
    assert sorted((r.path.rsplit("/", 1)[1], r.length, bytes(r.content)) for r in got.collect()) == [("a.png", 6, b"\x89PNG-1"), ("b.png", 7, b"\x89PNG-22")]
    at = str(tmp_path / "settings")
    for value in ("55", "70"):  # the last write stands alone
        web.save(web.settings(spark.createDataFrame([("volume", value)], "key string, value string")), at)
    assert dict(spark.read.parquet(at).collect()) == {**web.DEFAULTS, "volume": "70"}


def test_sizes_of_images_fall_back_to_layout(spark):
    rows = [(1, 400, 400, 10, 10), (2, 0, 0, 400, 400), (3, None, 400, 330, 1), (4, 0, 400, 319, 400), (5, 300, 400, 900, 900)]
    fine = predicates.is_eligible_image(*(F.col(c) for c in ("nw", "nh", "lw", "lh")))
    got = spark.createDataFrame(rows, "i int, nw int, nh int, lw int, lh int").where(fine).collect()
    assert sorted(r.i for r in got) == [1, 2, 3]
    edge = spark.createDataFrame([(1, -5.0, 0.0), (2, 0.0, 5.0), (3, 100.0, 120.0)], "i int, left double, right double")
    seen = predicates.in_viewport(F.col("left"), F.lit(0.0), F.col("right"), F.lit(10.0), F.lit(100.0), F.lit(100.0), 50.0)
    assert [r.i for r in edge.where(seen).collect()] == [2]  # the margin is a vertical one


def test_plain_verdicts_are_those_of_the_rules(spark):
    """Texts made of what the rules look at and of ordinary words: where a verdict is told at once, the rules say the same."""
    rng = random.Random(3)
    parts = [
        "images server", "report error", "read this toon", "next chapter", "chapter 12", "go home", "shortcuts", "customize", "manga online »", "import", "class", "var", "biki", "b-iki", "zun!", "fwiishing", "ta",
        "hmm...", "aaaaaaaaaaa", "bcdfg", "xx", "i", "a", "x.y.com", "{}", "=>", "//", "é", "naïve", "straße", "ımage", "imageßerver", "ſhortcuts", "été", "“so”", "Ωmega", "Ünder", "d’un", "\u00a0", "\u2003", "мир", "\u3042", "  ", "\t", "1234", "...", "it's", "incomprehensibilities", "a1b2c3d4e5f6g7h8i9j0k1",
        "HELLO", "the", "quick", "brown", "over", "lazy", "dogs", "waited", "here", "and", "nothing", "moved",
    ]
    rows = [(" ".join(rng.choice(parts[k:]) for _ in range(rng.randint(0, 7))), rng.choice([10.0, 44.9, 45.0, 60.0, 80.0, 99.0])) for k in (0, 0, 20, 51, 51) for _ in range(1500)]
    kept, suspicious = (v.to_pylist() for v in noise.verdicts(pa.array([t for t, _ in rows]), np.array([c for _, c in rows])))
    got = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, c double").select("i", predicates.verdict(F.col("t"), F.col("c")).alias("v")).collect()
    told = 0
    for r in got:
        if kept[r.i] is not None:
            told += 1
            assert (kept[r.i], suspicious[r.i]) == (r.v.kept, r.v.suspicious), rows[r.i]
        else:
            assert suspicious[r.i] is None
    plain = [k for (t, c), k in zip(rows[-1500:], kept[-1500:], strict=True) if c >= 60 and len(t.split()) >= 3]
    assert told > 2500 and sum(k is True for k in plain) > 0.9 * len(plain)

    whole = "".join(chr(c) for c in range(0x80, 0x10000) if re.fullmatch(f"[{noise.PLAIN}]", chr(c)))
    assert not re.search("[ -~]", whole.upper() + whole.lower()) and not set(whole) & set(t.BLANKS)
