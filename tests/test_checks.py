"""Literal cases of normal forms, checks, contexts and reviews."""

import re

import pytest
from hypothesis import given, settings, strategies as st

from folioquarry.functions import checks as C, context as X, normal as N, text as T
from folioquarry.operators import review as V, terms as M


def test_normal_forms():
    assert N.identity("Ｆｕｌｌ  Straße\n") == "full strasse" and N.lexeme("Straße  ﬁn") == "straße fin" and N.term(" ÉTÉ ") == "été"
    assert N.memory("Well-known, ｆｏｏ!") == "well known foo" and N.checked("1–2 − 3") == "1-2 - 3"


def test_term_spans_in_the_text_as_it_is():
    assert list(N.term_spans("interagency Agency agency_x ＡＧＥＮＣＹ", "agency")) == [(12, 18), (28, 34)]
    assert list(N.term_spans("Straße und STRASSE", "strasse")) == [(0, 6), (11, 18)]
    assert list(N.term_spans("ﬁne ﬁ", "fi")) == [(4, 5)] and list(N.term_spans("ﬁ", "i")) == [] and list(N.term_spans("中机构中", "机构")) == [(1, 3)]
    assert list(N.term_spans("", "a")) == [] and list(N.term_spans("a", " ")) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aＡßﬁé中_ 1", max_size=12), st.sampled_from(["a", "ss", "fi", "é", "中", "a1"]))
def test_spans_hold_the_term(text, term):
    for a, b in N.term_spans(text, term):
        assert N.term(text[a:b]) == N.term(term)


def test_sentence_around():
    assert N.enclosing_sentence("One. Two three! 四。", 5, 8) == "Two three!" and N.enclosing_sentence("a\nb", 2, 3) == "b"


def test_forms_of_any_length_and_dress(spark):
    terms = spark.createDataFrame([("t1", "p", "a term of six whole words", [], "auto", "approved", "x"), ("t2", "p", "长期的道德能动性理论", ["Ｆｏｏ"], "auto", "approved", "y"), ("t3", "p", "(bracketed)", [], "auto", "approved", "z")],
                                  "id string, project_id string, source string, aliases array<string>, enforcement string, status string, target string")
    segs = spark.createDataFrame([("s", "p", "Here is a term of six whole words, (bracketed). foo"), ("z", "p", "论长期的道德能动性理论与实践"), ("e", "p", ""), ("n", "p", None), ("q", "other", "(bracketed)")], "id string, project_id string, source_text string")
    assert {(r.segment_id, r.term_id, r.start, r.end) for r in M.occurrences(segs, terms).collect()} == {("s", "t1", 8, 33), ("s", "t3", 35, 46), ("z", "t2", 1, 11)}
    assert {(r.segment_id, r.term_id, r.start) for r in M.occurrences(segs, terms, compatible=True).collect()} == {("s", "t1", 8), ("s", "t3", 35), ("z", "t2", 1), ("s", "t2", 48)}
    assert M.occurrences(segs.limit(0), terms).count() == 0 and M.occurrences(segs, terms.limit(0)).count() == 0


def test_blank(spark):
    texts = ["", " ", "  ", "　\t\n", "\x0b\x1c\u0085", "a", "​", None]
    got = [r.b for r in spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, t string").select("n", T.blank(T.F.col("t")).alias("b")).orderBy("n").collect()]
    assert got == [None if t is None else not t.strip() for t in texts]


@pytest.mark.parametrize(("text", "kind"), [
    ("Agency, moral, 12, 45–47, 90n2", "index"), ("Smith, John, 45", "index"), ("agency, 45", None), ("Weber, M. Economy (Berkeley: University of California Press, 1978)", "imprint"), ("— 1998. Another Book.", "author_year"),
    ("Smith, John. 1998. The Book.", "author_year"), ("Smith 1998: 45; Jones and Lee 2001", "short"), ("In 1998 the war ended.", None), ("Smith, J., “A Title of Worth”, p. 5", "quoted_title"), ("12. John Smith, The Book of Names", "note"),
    ("John Smith, The Book of Names", None), ("Darwin wrote “on the origin” of it", None), ("", None), (None, None), ("Ｓｍｉｔｈ　1998: 45", "short"), ("x" * 2001, None)])
def test_reference_kinds(text, kind):
    assert C.reference_kind(text) == kind


def test_untranslated_prose():
    same = lambda t, a="en", b="zh-CN": C.is_untranslated(t, t, a, b)
    assert same("The old man went home.") and same("A NEW AND VERY LONG LINE OF SHOUTING.") and same("彼女は古い手紙を置いた", "ja", "en")
    assert not same("John Smith") and not same("Two cats slept", "en") and not same("短い", "ja", "en") and not same("The old man went home.", "en", "en") and not same("彼女古手紙置机上書物", "ja", "zh")
    assert not same("https://example.org/a/b `code of the thing here`") and not same("Smith 1998: 45; Jones and Lee 2001") and not C.is_untranslated(None, None, "en", "zh") and not C.is_untranslated("x", "x", None, "zh")


def test_contamination():
    assert C.contamination("A text.", "**译文**：文本") == ["commentary"] and C.contamination("Note: x", "**Note**: 文本") == [] and C.contamination("a", "翻译：甲\n说明：乙") == ["commentary"]
    s = "One two three four five six."
    assert C.contamination(s, s + " 一二三四五六") == ["echo"] and C.contamination(s, "一二三四五六") == [] and C.contamination(s, '{"a": "' + s + ' 一二三四五六"}') == ["echo"] and C.contamination(None, None) == []


def test_fences_placeholders_fragments_names_offsets():
    assert C.without_fence("```json\n{}\n```") == "{}" and C.without_fence("a ```b``` c") == "a ```b``` c"
    assert C.repaired_placeholders("⟦0⟧ a ⟦1⟧ b ⟦0⟧", ["⟦0⟧", "⟦1⟧"]) == "⟦0⟧ a ⟦1⟧ b " and C.repaired_placeholders("⟦1⟧ ⟦0⟧", ["⟦0⟧", "⟦1⟧"]) is None and C.repaired_placeholders("x", []) == "x"
    assert C.assembled('```json\n{"b": "2", "a": "1"}\n```', ["a", "b"]) == "12" and C.assembled('{"a": "1", "a": "2"}', ["a"]) is None and C.assembled('{"a": 1}', ["a"]) is None and C.assembled("no", []) is None
    assert C.safe_name('a/b: "c"?', ".md") == "a_b_ _c.md" and C.safe_name("...", ".txt") == "document.txt"
    assert C.utf16_offset("a𝐀b", 2) == len("a𝐀".encode("utf-16-le")) // 2 == 3


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=8), st.integers(0, 200))
def test_fair_shares(lengths, budget):
    shares = X.fair_shares(lengths, budget)
    assert all(0 <= s <= n for s, n in zip(shares, lengths)) and sum(shares) <= budget
    cut = [s for s, n in zip(shares, lengths) if s < n]
    assert not cut or max(cut) - min(cut) <= 1 and sum(shares) == budget and all(s <= min(cut) + 1 or s == n for s, n in zip(shares, lengths))


def test_context_keeps_what_is_near():
    near = [(1, "A" * 300 + "end", ""), (2, "own", ""), (3, "begin" + "B" * 300, "shown")]
    out = X.neighbour_context(2, "Chapter", near, 420, True)
    assert len(out) <= 420 and "…" in out and re.search("A+end", out) and "beginB" in out and "own" not in out.replace("shown", "").replace("known", "") and "# LOCATION\nChapter" in out
    assert X.neighbour_context(2, None, [(2, "own", "")], 400, False) == "" and X.neighbour_context(2, "h", near, 10, False) == ""


def test_samples():
    text = " ".join(f"word{n}" for n in range(2000))
    joined, n = X.sample(text, 1000, 4)
    parts = joined.split(X.OMITTED)
    assert n == len(parts) == 4 and len(joined) <= 1000 and all(p in text for p in parts) and parts[0].startswith("word0") and "word1999" in parts[-1]
    assert [text.find(p) for p in parts] == sorted(text.find(p) for p in parts)
    assert X.sample("short", 100) == ("short", 1) and X.sample("", 5) == ("", 0) and X.sample("abc", 0) == ("", 0) and X.sample("x" * 500, 100) == ("x" * 100, 1)


def test_review(spark):
    terms = spark.createDataFrame([("t", "p", "a", "b", "auto"), ("r", "p", "c", "d", "reference")], "id string, project_id string, source string, target string, enforcement string")
    segs = spark.createDataFrame([("s", "p", "text", "shown"), ("e", "p", "text", "")], "segment_id string, project_id string, source_text string, shown string")
    uses = spark.createDataFrame([("s", "t", 0, 1, "conditional"), ("s", "u", 0, 1, "conditional"), ("s", "v", 4, 5, "conditional"), ("e", "t", 0, 1, "conditional"), ("s", "w", 0, 1, "enforced")], "segment_id string, term_id string, start int, end int, class string")
    items = V.items(uses, segs, terms)
    one = {r.term_id: r.item_id for r in items.collect()}
    assert set(one) == {"t", "u", "v"}
    changed = terms.union(spark.createDataFrame([("n", "p", "x", "y", "auto")], terms.schema))
    assert all(one[r.term_id] != r.item_id for r in V.items(uses, segs, changed).collect())
    assert all(one[r.term_id] == r.item_id for r in V.items(uses, segs, terms.where("id <> 'r'")).collect())
    verdicts = spark.createDataFrame([(one["t"], "inconsistent", 1, "a"), (one["t"], "consistent", 2, "b"), (one["u"], "inconsistent", 1, "c"), ("stale", "inconsistent", 9, "d")], "item_id string, status string, created_at int, id string")
    snap = {r.term_id: r.status for r in V.snapshot(items, verdicts, ["item_id"]).collect()}
    assert snap == {"t": "uncertain", "u": "uncertain", "v": "pending"}
    found = {(r.code, r.severity, r.places) for r in V.findings(V.snapshot(items, verdicts, ["item_id"])).collect()}
    assert found == {("terminology_uncertain", "warning", 2), ("terminology_pending", "info", 1)}
