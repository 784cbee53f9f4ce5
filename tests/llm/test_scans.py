import pytest

from folioquarry.llm import scans as S

TITLE, CHAPTER = "The Currency of Gorrudmor", "IV Cortasnak: procession"


@pytest.mark.parametrize(("text", "number"), [("24", 24), ("- 24 -", 24), ("— 7 —", 7), ("xiv", 14), ("l7", 17), ("3l.", 31), ("1 2", 12), ("p. 22", 22), ("12v", None), ("hes.", None), ("", None), ("1907, Lum", None), ("⁂", None)])
def test_printed_numbers(text, number):
    assert S.printed_number(text) == number


@pytest.mark.parametrize("line", ["THE CURRENCY OF G", "T H E   C U R R E N C Y   O F", "24  |  THE CURRENCY 0F G0RRUDM0R", "The Currency of Gorrudmor — 24", "lV C0RTASNAK: PR0CESSl0N", "24 IV CORTASNAK: P", "IV Cortasnak: procession"])
def test_running_heads(line):
    header, *_ = S.read(f"A line of the running text goes on and on\n{line}\nand ends here.", TITLE, CHAPTER)
    assert header
    assert S.read(line, TITLE, CHAPTER)[0]


def test_running_text_is_no_head():
    text = "The currency of the realm was a matter of\nprocession and of other things that people\ncounted in 1907 and later."
    assert S.read(text, TITLE, CHAPTER)[:3] == (False, [], [])


def test_cut_words_across_furniture():
    header, pages, cuts, running, words, joined = S.read("the rhé¬\n1 2\ntorique of Wen-\nTHE CURRENCY OF\nrok and well-\nknown let-", TITLE, CHAPTER)
    assert header and pages == [12] and cuts == [("rhé", "¬", "torique"), ("Wen", "-", "rok"), ("well", "-", "known"), ("let", "-", "")]
    assert running == "the rhétorique of Wenrok and wellknown let-" and joined == ["rhétorique", "Wenrok", "wellknown"] and "let" not in words


def test_readings():
    assert "tenure" in S.readings("tcnure") and "matter" in S.readings("mafter") and "dorfleute" in S.readings("clorfleute")
    assert all(map(S.corrupt_by_itself, ("dési9ne", "l898", "corporat1on"))) and not any(map(S.corrupt_by_itself, ("12v", "1898", "19th", "word", "4")))


ROWS = [("h", "d", "segment", 1, "heading", 10, CHAPTER, CHAPTER, TITLE, "en"), ("r", "d", "segment", 2, "paragraph", 10, CHAPTER, CHAPTER, TITLE, "en")]
ROWS += [(f"p{n}", "d", "segment", 3 + n, "paragraph", 11 + n, CHAPTER, f"The tenure of the well-known house was counted in 1907.\n{13 + n}", TITLE, "en") for n in range(20)]
ROWS += [("cut", "d", "segment", 60, "paragraph", 20, CHAPTER, "A well-\nknown tcnure and l898 and the ten-", TITLE, "en"), ("rest", "d", "segment", 61, "paragraph", 20, CHAPTER, "ure of the house.", TITLE, "en"),
         ("own", "d", "segment", 62, "paragraph", 20, CHAPTER, "A well-\nknown house.", TITLE, "en"), ("cell", "d", "segment", 63, "table_cell", 20, CHAPTER, "695", TITLE, "en"),
         ("null", "d", "segment", 64, "paragraph", None, None, None, None, None), ("empty", None, "segment", 65, "paragraph", 3, None, "", None, None), (None, "d", "segment", 66, "paragraph", 20, None, "a tcnure", TITLE, "en")]
SCHEMA = "record_id string, document_id string, source string, ordinal int, kind string, page_no int, chapter string, text string, title string, lang string"


def test_noise(spark):
    df = spark.createDataFrame([r + ("x",) for r in ROWS + ROWS[-5:-4]], SCHEMA + ", noise string")
    got = {tuple(r) for r in S.found_noise(df).collect()}
    assert got == {("r", "header"), ("cut", "hyphen"), ("cut", "misread"), *((f"p{n}", "page_number") for n in range(20))}
    assert S.found_noise(df.limit(0)).count() == 0


def test_paragraphs(spark):
    out = {r.text for r in S.paragraphs(spark.createDataFrame(ROWS, SCHEMA)).collect()}
    assert "A well-known tenure and 1898 and the tenure of the house." in out
    assert "The tenure of the well-known house was counted in 1907." in out and CHAPTER not in "".join(out - {CHAPTER})


@pytest.mark.parametrize(("written", "right", "out"), [("Idcntität", "identität", "Identität"), ("Bctween", "between", "Between"), ("BCTWEEN", "between", "BETWEEN"), ("I837", "1837", "1837"), ("191O", "1910", "1910"), ("1B37", "1637", "1837"),
                                                       ("tcnure", "tenure", "tenure"), ("faIse", "false", "false"), ("Iand", "land", "land"), ("Oount", "count", "Count"), ("Clorf", "dorf", "Dorf"), ("WeIIknown", "wellknown", "Wellknown"), ("Wellknown", "well-known", "Well-known"), ("0FFICER", "officer", "OFFICER"), ("Rnan", "man", "Man")])
def test_repairs_keep_capitals(written, right, out):
    assert S.cased(written, right) == out
    assert S.repaired(f"({written}) x{written}", [{"word": written.lower(), "right": right}]) == f"({out}) x{written}"


def test_repairs_between_apostrophes():
    assert S.repaired("L'Idcntité, rock'n'rcll: d’idcntité", [{"word": "idcntité", "right": "identité"}, {"word": "n'rcll", "right": "n'roll"}]) == "L'Identité, rock'n'roll: d’identité"


def test_paragraphs_with_capitals(spark):
    rows = [(f"p{n}", "d", "segment", n, "paragraph", None, None, "The Identität between well-known men was counted.", None, "en") for n in range(20)]
    rows.append(("c", "d", "segment", 60, "paragraph", None, None, "Bctween them, Idcntität. In I837 and 191O a Well-\nknown house.", None, "en"))
    assert "Between them, Identität. In 1837 and 1910 a Well-known house." in {r.text for r in S.paragraphs(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_short_words_compounds_over_records_and_years(spark):
    rows = [(f"p{n}", "d", "segment", n, "paragraph", None, None, "The well-known house and the garden in a wood.", None, "en") for n in range(30)]
    rows += [("a", "d", "segment", 60, "paragraph", None, None, "Tbe house stood in l9O4 here aud was well-", None, "en"), ("b", "d", "segment", 61, "paragraph", None, None, "known, it was a cot-", None, "en"),
             ("c", "d", "segment", 9000, "paragraph", None, None, "tage. And an end-", None, "en")]
    df = spark.createDataFrame(rows, SCHEMA)
    texts = {r.text for r in S.paragraphs(df).collect()}
    assert "The house stood in 1904 here and was well-known, it was a cottage. And an end-" in texts
    assert {tuple(r) for r in S.found_noise(df).collect()} == {("a", "misread"), ("b", "hyphen"), ("c", "hyphen")}


def test_model_is_fitted_to_the_texts(spark):
    rows = [(f"p{n}", "d", "segment", n, "paragraph", 11 + n, CHAPTER, f"A sentence of the text.\nAnd one more\n{13 + n}  THE CURRENCY OF GORRUDMOR", TITLE, "en") for n in range(40)]
    weights, pairs = S.fitted_model(spark.createDataFrame(rows, SCHEMA))
    title = weights[S.FEATURES.index("title")]
    assert title != S.PRIOR[0][0] and title[S.HEADER] > max(title[1:])
    assert S.decode(S.observed(["Text of the record that goes on.", "THE CURRENCY 0F G0RR"], (S.folded(TITLE),))[0], (weights, pairs))[1] == S.HEADER
    assert S.fit([]) == S.PRIOR and S.fitted_model(spark.createDataFrame([], SCHEMA)) == S.PRIOR


def test_short_titles_match_whole():
    own = (S.folded("Ich"),)
    assert S.like_title("Ich", own) and not S.like_title("Ic", own) and not S.like_title("ich gehe heute", own)


def test_long_text(spark):
    rows = [("x", "d", "block", 1, "paragraph", 1, None, "words and words that go on\n" * 20000, None, "en")]
    assert S.found_noise(spark.createDataFrame(rows, SCHEMA)).count() == 0
