import unicodedata

import pytest
from hypothesis import given, settings, strategies as st

from folioquarry.llm import charforms as C

SAMPLES = [
    "Sоvеreіgn", "ｆｕｌｌ　ｗｉｄｔｈ", "été", "ậ", "ậ", "ﬁne oﬃce", "zero​width­here", "no break", "co‑op co‐op", "⼀⼈", "x²",
    "क्‍ष", "русский жук", "K Å", "≠ ́", "각", "à֮̕b", "\u1112\u1161\u11ab\u1100\u116e\u11a8\u1100", "", "plain", "Привет Pоpe", "，。！", "…", "𝐀𝐁", "½",
]


def test_operator_agrees_with_plain_python(spark):
    got = {r.t: r.consistent_text for r in C.with_consistent_text(spark.createDataFrame([(t,) for t in SAMPLES], "t string"), "t").collect()}
    assert got == {t: C.consistent(t) for t in SAMPLES}


def test_forms():
    assert C.consistent("Sоvеreіgn") == "Sovereign"
    assert C.consistent("ｆｕｌｌ　ｗｉｄｔｈ") == "full width"
    assert C.consistent("ậ") == C.consistent("ậ") == "ậ"
    assert C.consistent("zero​width­here") == "zerowidthhere"
    assert C.consistent("x²") == "x²" and C.consistent("½") == "½"
    assert C.consistent("русский") == "русский"
    assert C.consistent("क्‍ष") == "क्‍ष"


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.characters(min_codepoint=0x20, max_codepoint=0x33FF, exclude_categories=["Cs", "Cn", "Co"]), max_size=12))
def test_idempotent_and_composed(text):
    once = C.consistent(text)
    assert C.consistent(once) == once and unicodedata.normalize("NFC", once) == once


def test_pairs_nulls_repeats_and_clashing_names(spark):
    rows = [("a", "d", "Pope", "x"), ("b", "d", "Pоpe", "x"), ("b", "d", "Pоpe", "x"), ("c", "d", "Pope", "x"), ("e", "other", "Pope", "x"), (None, "d", "Pоpe", "x"), ("f", None, "Pоpe", "x"),
            ("g", "d", None, "x"), ("h", "d", "", "x"), ("i", "d", "​", "x"), ("j", "d", "pope", "x"), ("k", "d", "Рopе", "x")]
    df = spark.createDataFrame(rows, "id string, s0 string, t string, look string")
    pairs = {tuple(r) for r in C.look_alike_pairs(df, "id", ["s0"], "t").collect()}
    assert pairs == {("a", "b"), ("b", "c"), ("a", "k"), ("c", "k"), ("b", "k")}
    assert C.look_alike_pairs(df.limit(0), "id", ["s0"], "t").count() == 0


def test_keeps_rows_and_long_texts(spark):
    long = "Sоvereign ﬁre " * 20000
    df = spark.createDataFrame([(1, long, "k"), (1, long, "k"), (2, None, "k")], "id int, t string, ch string")
    out = C.with_consistent_text(df, "t").collect()
    assert len(out) == 3 and {r.consistent_text for r in out} == {None, "Sovereign fire " * 20000}
    assert {r.ch for r in out} == {"k"}


def test_look_alikes_after_decomposition_and_rare_invisibles(spark):
    rows = [("a", "d", "ё"), ("b", "d", "ë"), ("c", "d", "ρ"), ("e", "d", "p"), ("f", "d", "a\U000E0101b"), ("g", "d", "ab"), ("h", "d", "ї"), ("i", "d", "ï"), ("j", "d", "жёлтый"), ("k", "d", "жëлтый")]
    df = spark.createDataFrame(rows, "id string, s string, t string")
    assert {tuple(r) for r in C.look_alike_pairs(df, "id", ["s"], "t").collect()} == {("a", "b"), ("c", "e"), ("f", "g"), ("h", "i")}
    classes = {r.id: (r.class_id, r.members, r.links) for r in C.look_alike_classes(df, "id", ["s"], "t").collect()}
    assert classes["b"] == ("a", 2, 1) and classes["g"] == ("f", 2, 1) and "j" not in classes


def test_both_forms_agree_on_every_mapped_character(spark):
    texts = [t for ch, *_ in C.code_points() for t in (ch, f"a{ch}b")] + [chr(n) for n in range(0x20, 0x2FFF) if unicodedata.category(chr(n)) not in ("Cn", "Co", "Cs")]
    df = spark.createDataFrame([(t,) for t in dict.fromkeys(texts)], "t string")
    wrong = [(r.t, r.consistent_text) for r in C.with_consistent_text(df, "t").collect() if r.consistent_text != C.consistent(r.t)]
    assert not wrong, wrong[:20]


def test_large_class_is_dealt(spark, monkeypatch):
    monkeypatch.setattr(C, "MEMBERS", 3)
    rows = [(f"{n:02d}", "d", "Pope" if n % 2 else "Pоpe") for n in range(20)]
    pairs = C.look_alike_pairs(spark.createDataFrame(rows, "id string, s string, t string"), "id", ["s"], "t").collect()
    assert len(pairs) == len({tuple(p) for p in pairs}) == 100


def test_a_few_kinds_and_many_are_replaced_alike():
    looks = C._python_tables()[1]
    many = "，；（）：！？ｆｕｌｌ　ｗｉｄｔｈ"
    for text in ("汉，字；汉（字）", "字" + many, many[:8], many[:9]):
        assert C.consistent(text) == C.unicodedata.normalize("NFC", text.translate(looks))
    assert set("，；（") <= C._settled().keys() and all(C.consistent(x) == x for x in C._settled().values() if len(x) == 1)
