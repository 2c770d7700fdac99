"""Known input and output pairs of the text rules."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from panelweave.functions import geometry as g, predicates as p, text as t
from panelweave.operators import lexicon_repair as lr

CASES = [
    *((lambda c: p.is_garbage(c), x, False) for x in ("I", "HMM...", "H M...", "OH... OHHH!")),
    *((lambda c: p.is_garbage(c), x, True) for x in ("D m", "Ch. 9.0", "6% · 2/31", "", "xkcdfgh", "return it;", "IIIIIII i")),
    *((lambda c: p.is_chrome(c), x, True) for x in ("IMAGESSERVER", "READ ON C TOON .net", "NEXT CHAPTER", "chapter  12")),
    *((lambda c: p.is_chrome(c), x, False) for x in ("I read a cartoon", "chapter 12 was good", "CUSTOMISE. it")),
    *((lambda c: p.is_url_only(c), x, True) for x in ("VIOLETSCANS.COM", "VIOLETSCANS.COMO")),
    *((lambda c: p.is_url_only(c), x, False) for x in ("CH.9.0", "check reddit.com")),
    (lambda c: p.is_sound_effect(c, F.lit(90.0)), "WAku CPUMPED iae.", True),
    (lambda c: p.is_sound_effect(c, F.lit(87.0)), "Yup!", False),
    (lambda c: p.is_sound_effect(c, F.lit(50.0)), "I...", False),
    (t.replace_slashes, "/TWAS", "iTWAS"),
    (t.space_after_comma, "OKAY,I'VE", "OKAY, I'VE"),
    (t.join_hyphenated, "MINAMI- KUN", "MINAMI KUN"),
    (t.join_hyphenated, "M-M- MINAMI", "M-M- MINAMI"),
    (t.join_hyphenated, "aaa-bbb-ccc", "aaa bbb-ccc"),
    (t.strip_cjk, "LEE中JAE", "LEE JAE"),
    (t.normalize_laughter, "HAHAHAHAHAHA", "HA-HA-HA-HA-HA"),
    (t.normalize_stutter, "P-POISON", "PO-POISON"),
    (t.normalize_stutter, "P-P-POISON", "PO-POI-POISON"),
    (t.normalize_stutter, "S-A-M-P-L-E", "S-A-M-P-L-E"),
    (t.normalize_stutter, "well-known", "well-known"),
    (t.normalize_case, "HELLO World I AM", "hello World I am"),
    (lambda c: F.array_join(t.sentences(c), "|"), "R.E.T.R.E.A...", "R. E.|T. R.|E. A..."),
    (lambda c: F.array_join(t.sentences(c), "|"), "...WHAT", "WHAT"),
    (lambda c: F.array_join(t.tts_chunks(c, 10), "|"), "One two. Three four five six.", "One two.|Three four|five six."),
    (lambda c: g.origin_of(c), "HTTPS://me:pw@Site.ORG:443/a?b", "https://site.org"),
    (lambda c: g.origin_of(c), "not a url", None),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_scalar(spark, k):
    f, x, want = CASES[k]
    assert spark.createDataFrame([(x,)], "x string").select(f(F.col("x"))).first()[0] == want


def _fixed(spark, f, texts, words):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    lex = spark.createDataFrame([(w,) for w in words], "word string")
    return [r.fixed for r in sorted(f(rows, ["k"], lex).collect())]


def test_digits(spark):
    assert _fixed(spark, lr.fix_digits, ["S0ON", "WI1L", "144", "a/b", ""], ["soon", "will"]) == ["SOON", "WILL", "144", "aib", ""]


def test_fused(spark):
    words = ["even", "when", "forgive", "cat"]
    texts = ["DOESHE", "CANEVEN", "WHENIT'S", "FORA", "SAWTHE", "IT'SNOT", "FORGIVE", "IDON'T", "forcats", "so cat"]
    assert _fixed(spark, lr.split_fused, texts, words) == ["DOES HE", "CAN EVEN", "WHEN IT'S", "FOR A", "SAW THE", "IT'S NOT", "FORGIVE", "I DONT", "forcats", "so cat"]


def test_respell(spark):
    rows = spark.createDataFrame([(0, "minami KUN constructor")], "k int, text string")
    names = spark.createDataFrame([("minami", "minnami"), ("kun", "koon")], "word string, respelling string")
    assert lr.respell(rows, ["k"], names).first().fixed == "minnami KOON constructor"
    assert lr.respell(rows, ["k"], None).first().fixed == "minami KUN constructor"


def test_wav(spark):
    import io
    import wave

    import numpy as np

    from panelweave.functions import audio

    x = [0.0, 0.5, -0.5, 1.5, -2.0]
    row = spark.createDataFrame([(x,)], "s array<double>").select(audio.interleave(F.array(audio.pcm16(F.col("s")), audio.pcm16(F.reverse("s")))).alias("p")).select(audio.wav_bytes(F.col("p"), 2, 22050).alias("w")).first()
    with wave.open(io.BytesIO(bytes(row.w))) as f:
        assert (f.getnchannels(), f.getframerate(), f.getnframes(), f.getsampwidth()) == (2, 22050, 5, 2)
        left = np.frombuffer(f.readframes(5), "<i2").reshape(-1, 2)[:, 0]
    assert left.tolist() == [0, 16383, -16384, 32767, -32768]


def test_registered_names(spark):
    from panelweave.functions.registry import register

    assert "core_word" in register(spark)
    row = spark.sql("SELECT core_word(\"Don't\") a, repair_slashes('a/b\\\\c') b, js_round(-2.5D) c, box_gap(0D, 1D, 3D, 4D) d, box_overlap_ratio(0D, 2D, 1D, 4D) e, space_after_comma('a,b') f").first()
    assert tuple(row) == ("don", "aibic", -2, 2.0, 0.5, "a, b")


def test_table_functions_equal_their_operators(spark):
    from panelweave.functions import text as t
    from panelweave.functions.tables import register_tables
    from panelweave.operators import layout

    register_tables(spark)
    texts = ["...WHAT", "", "a. b. c.", "No.\u00a0", "\u3000Hi! Yes? I see it. Ok", "!!!", None, "one", "A. B. Long enough. c"]
    df = spark.createDataFrame([*enumerate(texts)], "id int, text string")
    got = spark.sql("SELECT d.id, s.seq, s.chunk FROM {d} d, LATERAL sentence_chunks(d.text) s", d=df)
    want = df.select("id", F.posexplode(t.sentences(F.col("text"))).alias("seq", "chunk"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    boxes = [(c, i, float(i % 5 * 40), float(i // 5 * (12 + c)), float(i % 5 * 40 + 30), float(i // 5 * (12 + c) + 9)) for c in range(3) for i in range(40)]
    b = spark.createDataFrame(boxes, "capture_id long, ix int, x0 double, y0 double, x1 double, y1 double")
    for name, more, link in (("stacked_boxes", ", 100.0D", lambda x: layout.stacked(x, 100.0)), ("box_rows", "", layout.same_row)):
        got = spark.sql(f"SELECT * FROM {name}(TABLE(SELECT * FROM {{b}}) PARTITION BY capture_id ORDER BY (ix){more})", b=b)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, layout.cluster(link, b).collect()))
