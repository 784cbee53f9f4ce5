import pytest

from folioquarry.llm import defects as X

SRC = "The register of Veylumzin lists 345 entries for 1826, most of them about the literacy. Nobody objected."
OK = "维卢津的登记册在1826年列有345条记录，多半涉及识字。无人反对。"


@pytest.mark.parametrize(("answer", "first"), [
    (OK, None), ("译文：" + OK, None), ("  " + OK + "\n", None), (OK + " (724)", None), (OK + "（00-000025）", None), (None, "empty"), ("", "empty"), ("（）", "empty"), ("​", "empty"),
    ("维卢津的登记册在1826年列有", "truncated"), ("维卢津的登记册在1826年列有…", "truncated"), ("维卢津的登记册（在1826年", "truncated"), ("维卢津，", "truncated"),
    ("抱歉，根据内容政策，这段文字不能提供译文。", "refusal"), ("维卢津的登记册。I won't be able to complete this translation.", "refusal"), ("*Sorry, I must decline to render this text.", "refusal"),
    ("Je suis désolé, mais je ne peux pas traduire ce texte.", "refusal"), ("Es tut mir leid, das kann ich nicht übersetzen.", "refusal"), ("Lo siento, no puedo traducir este pasaje.", "refusal"), ("申し訳ありませんが、この翻訳はできません。", "refusal"),
    (SRC, "copy"), (SRC.upper(), "copy"), ("Translation:\n" + SRC, "copy"), (SRC[:-1], "copy"), ("“" + SRC + "”", "copy"), (SRC.replace("e", "е"), "copy"),
    ("Le registre tenu à Veylumzin compte 345 mentions pour 1826, où domine la taxe et la dot.", "wrong_language"), ("その年、149戸が税を納めた。", "wrong_language"),
    ("在Veylumzin，Fallumsev与Quinlumwen所列的记录，多半涉及识字。", None),
])
def test_answers(answer, first):
    found = X.defects(SRC, answer, "paragraph", "en", "zh-CN", 0.28)
    assert (found or [None])[0] == first


def test_what_is_no_case():
    assert X.defects("Wexdunrok: debt", "韦敦罗：债务", "heading", "en", "zh-CN", 0.28) == []
    assert X.defects("Ruddunhest, A., Kevfal: levy (Tobpel: Zinmor, 1834), 4–9.", "Ruddunhest, A., Kevfal: levy (Tobpel: Zinmor, 1834), 4–9.", "footnote", "en", "zh-CN", 0.28) == []
    assert X.defects("⁂", "⁂", "paragraph", "en", "zh-CN", 0.28) == X.defects("695", "695", "table_cell", "en", "zh-CN", 0.28) == []
    assert X.defects("The clerk said: “I'm sorry, I can't help with that request.”", "书记员答道：“很抱歉，我不能协助这一请求。”", "paragraph", "en", "zh-CN", 0.28) == []
    assert X.defects("莫亚纳的巡游", "莫亚纳的巡游", "heading", "hi", "zh-CN", 0.28) == []
    assert X.defects("", None, "paragraph", "en", "zh-CN", None) == X.defects(None, OK, None, None, None, None) == []
    assert X.defects("Well ... he never paid ...", "他从未付过钱……", "paragraph", "en", "zh-CN", 0.28) == []


def test_frame(spark):
    rows = [("a", SRC, None, "paragraph", "en", "zh-CN", "x"), ("b", SRC, OK, "paragraph", "en", "zh-CN", "x"), ("c", None, None, None, None, None, "x"), (None, SRC, "抱歉，我无法翻译。", None, None, None, "x"),
            ("a", SRC, None, "paragraph", "en", "zh-CN", "x"), ("d", SRC * 2000, OK * 2000, "paragraph", "en", "zh-CN", "x")]
    df = spark.createDataFrame(rows, "id string, s string, a string, kind string, sl string, tl string, usual string")
    got = [(r.record, r.defect) for r in X.pair_defects(df, "id", "s", "a", "kind", "sl", "tl").collect()]
    assert sorted(got, key=str) == [("a", "empty"), ("a", "empty"), (None, "refusal")]
    assert X.pair_defects(df.limit(0), "id", "s", "a", "kind", "sl", "tl").count() == 0
