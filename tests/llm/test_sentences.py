import pytest
from hypothesis import given, settings, strategies as st

from folioquarry.llm import sentences as X

UNITS = {
    "en": ["Dr. Vey of St. Kev gave the figure as 22.2 per cent.", "“Who pays? The parish, of course,” said Rok.", "(The ledger for 1607 is missing. So is its index.)", "J. K. Mor never met A. Zin in person.", "iv. The debt clause, art. 301.2, was struck out.",
           "Tas & Co. paid 1,4.50 crowns on Jan. 4.", "The text breaks off at p.m. hours.[^67]", "Mor wrote: “It is done. We sail at dawn.”", "Hul's answer (“Never.”) was entered on fol. 12v.", "Well ... perhaps it was never counted.", "They traded tin, etc.", "What of it, one may ask?!",
           "“Leave the ledgers!” cried Vey from the stair."],
    "de": ["Am 12. 8. 1646 fiel der Preis auf 39,3 Mark.", "Der sog. Vertrag von Nak (vgl. Abb. 409) ist u. a. deshalb ungültig.", "„Wartet!“, rief Bri über den Hof.", "Im 17. Jh. galt das 2. Buch als verloren.", "Man kaufte Salz, Zinn usw.", "Vgl. Bd. 3, S. 77 ff., hrsg. v. Rud.", "Ach!", "Rud schrieb: „Es ist getan. Wir gehen.“"],
    "es": ["—¿Y la deuda? —preguntó Vey.", "«No hay prisa. Esperemos», dijo Cor.", "El Sr. Wex y la Dra. Tal llegaron a las 4 p. m. en punto.", "¡Basta!", "Ud. sabe, EE. Hul nunca pagó ...", "¿Quién firmó la carta?", "(Falta el registro. También el índice.)"],
    "fr": ["« Qui paie ? La paroisse », dit M. Vey.", "Voir p. 12, éd. Cor, t. 2.", "C'est fini !"],
    "hi": ["“कौन देगा? हम नहीं।” गाँव वालों ने कहा।", "डॉ. शिला ने 1622 में कर की दर 31.8 प्रतिशत बताई।", "पुरानी बही खो गई॥", "सन् 1642 ई. में बाढ़ आई।", "नाव डूब गई!"],
    "ja": ["「払えるのか。無理だ。」と二人は言い合った。", "第49条（主权の項。現存せず。）は削られた。", "しかし……道は閉ざされていた！", "率は11.7%である（クの説。異論もある）。", "1862年.春の項に名がある。"],
    "zh": ["“谁付钱？当然是教区。”芬穆穆说。", "（登记册已佚。索引亦然。）", "塞法布写道：“事成了。我们走。”", "嗯……也许边界从未被计入。", "1748年的信中，至少有38封。"],
    "th": ["เรือจมแล้ว", "สมุดบัญชี(เล่มเก่า หายไป)", "ราคา 37.6"[:4]],
}


@pytest.mark.parametrize("lang", UNITS)
def test_units_in_every_order(lang):
    import random

    rng, glue = random.Random(3), "" if lang in ("ja", "zh") else " "
    for _ in range(60):
        units = rng.choices(UNITS[lang], k=4)
        text = glue.join(units)
        assert [text[a:b] for a, b in X.sentences(text, lang)] == units


def test_lines_and_headings():
    assert [s for s in X.sentences("One\n\n two.  Three", "en")] == [(0, 3), (6, 10), (12, 17)]
    assert X.sentences("IV. On Dr. Vey. And more", "en", heading=True) == [(0, 24)]
    assert X.sentences(None) == X.sentences("") == X.sentences(" \n\t") == []


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aZ .!?\n“”()「」。…—9[^]", max_size=40), st.sampled_from(["en", "de", "ja", "th", None]))
def test_spans_cover_everything_but_white_space(text, lang):
    spans = X.sentences(text, lang)
    covered = {k for a, b in spans for k in range(a, b)}
    assert all(k in covered or c.isspace() for k, c in enumerate(text))
    assert all(a < b and not text[a].isspace() and not text[b - 1].isspace() and "\n" not in text[a:b] for a, b in spans)
    assert all(b <= c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_frame(spark):
    df = spark.createDataFrame([("a", "One. Two.", "en", None, 1), ("a", "One. Two.", "en", None, 1), ("b", None, "en", "x", 1), (None, "Solo", None, "heading", 1), ("c", "Word here. " * 5000, "en", "x", 1)], "id string, t string, l string, k string, start_offset int")
    rows = X.split_sentences(df, "id", "t", "l", "k").collect()
    assert len(rows) == 2 + 2 + 1 + 5000
    assert X.split_sentences(df.limit(0), "id", "t").count() == 0
