"""Broken pairs of a request and its answer: a text and its rendering in another language.

Method: ordered rules for emptiness, refusal phrases of many languages, copies of the request, script and language
mismatch, unclosed delimiters and abrupt endings. Every rule that fires is reported; the first is the pair's defect.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import DataFrame, functions as F

from folioquarry.functions.arrow import map_batches
from folioquarry.llm.charforms import consistent
from folioquarry.session import spread

DEFECTS = ("empty", "refusal", "copy", "wrong_language", "truncated")

# Phrases by which an answer declines, by language.
REFUSALS = {
    "en": [
        r"\b(?:sorry|apologi[sz]e|unfortunately|regret)\b[^.!?\n]{0,80}\b(?:can(?:no|')t|cannot|can not|unable|not able|decline|against|won't|not permitted|not allowed)\b",
        r"\b(?:i|we)\b[^.!?\n]{0,25}\b(?:cannot|can't|can not|unable to|not able to|won't|will not|must decline|have to decline|decline to|refuse to)\b[^.!?\n]{0,40}\b(?:translat|help|assist|complet|provid|comply|render|process|continu|fulfil|do th|reproduc|answer|support|respond)",
        r"\bas an? (?:ai|artificial intelligence|language model|assistant)\b",
        r"\b(?:against|violat\w+|contrary to|due to)\b[^.!?\n]{0,25}\b(?:my|our|content|usage|the)\b[^.!?\n]{0,20}\b(?:guidelines?|polic(?:y|ies)|rules|programming)\b",
        r"\b(?:request|content|passage|text|translation)\b[^.!?\n]{0,15}\b(?:cannot|can't|can not|could not) be (?:process|complet|translat|provid|fulfil|handl|answer)",
        r"\b(?:this|your|the) request (?:has been|was|is) (?:denied|declined|refused|rejected|blocked)\b",
    ],
    "zh": [
        r"(?:抱歉|对不起|很遗憾|十分遗憾|非常遗憾)[^。！？\n]{0,30}(?:不能|无法|不便|没法|不可以|难以|不予|拒绝)",
        r"(?:我|本人|本助手|本系统)[^。！？，\n]{0,6}(?:不能|无法|无权|不便|不可以|拒绝|没有办法)[^。！？\n]{0,12}(?:翻译|协助|复述|处理|继续|提供|完成|回答|满足|帮助|输出|译出|响应)",
        r"作为(?:一个|一款|一名)?[^。，！？\n]{0,6}(?:语言模型|人工智能|智能助手|AI|ＡＩ)", r"请求(?:已被|已经被|被|遭到|遭)拒绝",
        r"(?:请求|内容|文本|段落|译文)[^。，！？\n]{0,6}(?:无法|不能)(?:被|予以)?(?:处理|完成|提供|翻译|满足)",
        r"(?:违反|不符合)[^。！？\n]{0,10}(?:政策|规定|准则|规范)", r"恕(?:我)?(?:不能|无法|难|不便)",
    ],
    "fr": [
        r"\b(?:désolée?s?|je regrette|malheureusement|excusez)\b[^.!?\n]{0,80}\b(?:ne (?:peux|puis|pouvons)|impossible|pas en mesure)\b",
        r"\bje ne (?:peux|puis|suis|saurais)\b[^.!?\n]{0,50}(?:tradui|aider|fournir|traiter|continuer|répondre|en mesure|satisfaire)",
        r"\ben tant qu(?:e |')(?:modèle|ia\b|intelligence|assistant)", r"\bje dois (?:refuser|décliner)\b", r"\b(?:demande|requête) (?:a été|est) (?:refusée|rejetée)\b",
        r"\b(?:demande|requête|contenu|texte|passage|traduction)\b[^.!?\n]{0,20}\bne (?:peut|peuvent|saurait) (?:pas )?être (?:trait|tradui|fourni|complét|satisf)",
    ],
    "de": [
        r"\b(?:leider|tut mir leid|entschuldig\w*|bedaure)\b[^.!?\n]{0,80}\b(?:nicht|ablehnen|unmöglich)\b[^.!?\n]{0,40}(?:übersetz|helf|bearbeit|liefer|bereitstell|beantwort|fortsetz|erfüll|nachkommen|weiterhelfen|unterstütz|wiedergeb|[.!]|$)",
        r"\bich (?:kann|darf|werde)\b[^.!?\n]{0,60}\bnicht\b[^.!?\n]{0,30}(?:übersetz|helf|bearbeit|liefer|beantwort|fortsetz|wiedergeb|bereitstell|unterstütz)",
        r"\bals (?:ki|sprachmodell|künstliche intelligenz|ki-\w+)\b", r"\bich muss\b[^.!?\n]{0,50}\bablehnen\b", r"\banfrage (?:wurde|wird) abgelehnt\b",
        r"\b(?:anfrage|inhalt|text|abschnitt|passage|übersetzung)\b[^.!?\n]{0,20}\bkann\b[^.!?\n]{0,15}\bnicht (?:bearbeitet|übersetzt|bereitgestellt|beantwortet|erfüllt|geliefert)",
    ],
    "es": [
        r"\b(?:lo siento|lamento|lo lamento|disculp\w+|lamentablemente|perdón)\b[^.!?\n]{0,80}\bno (?:puedo|podemos|me es|es posible)\b",
        r"\bno (?:puedo|podemos|me es posible)\b[^.!?\n]{0,40}(?:traducir|ayudar|proporcionar|procesar|continuar|completar|asistir|responder|atender)",
        r"\bcomo (?:un )?(?:modelo de lenguaje|ia\b|inteligencia artificial|asistente)", r"\bdebo (?:rechazar|declinar)\b", r"\b(?:solicitud|petición) (?:ha sido|fue) (?:rechazada|denegada)\b",
        r"\b(?:solicitud|petición|contenido|texto|pasaje|traducción)\b[^.!?\n]{0,15}\bno (?:puede|se puede|pudo)\b[^.!?\n]{0,12}(?:proces|tradu|proporcion|complet|atend)",
    ],
    "it": [r"\b(?:mi dispiace|purtroppo|spiacente)\b[^.!?\n]{0,80}\bnon (?:posso|è possibile|sono in grado)\b", r"\bnon posso\b[^.!?\n]{0,40}(?:tradurre|aiutar|fornire|completare)"],
    "pt": [r"\b(?:desculp\w+|lamento|infelizmente|sinto muito)\b[^.!?\n]{0,80}\bnão (?:posso|é possível|consigo)\b", r"\bnão posso\b[^.!?\n]{0,40}(?:traduzir|ajudar|fornecer|completar)"],
    "ru": [r"(?:извините|к сожалению|простите|сожалею)[^.!?\n]{0,80}не (?:могу|можем|имею)", r"я не могу[^.!?\n]{0,40}(?:перевест|помочь|предостав|выполн)"],
    "ja": [
        r"(?:申し訳|すみません|恐れ入り)[^。！？\n]{0,50}(?:できません|出来ません|かねます|できかね)", r"(?:翻訳|お手伝い|対応|提供|処理|要求|リクエスト|依頼)[^。！？\n]{0,14}(?:できません|出来ません|かねます|拒否)",
        r"(?:AI|言語モデル|人工知能)(?:として|である|なので)",
    ],
    "ko": [r"죄송[^.!?\n]{0,50}(?:없습니다|못합니다|없어요|어렵습니다)", r"(?:번역|도움|제공)[^.!?\n]{0,20}(?:수 없습니다|불가능)"],
    "hi": [r"(?:क्षमा|माफ़?|खेद)[^।!?\n]{0,80}नहीं", r"मैं[^।!?\n]{0,60}(?:अनुवाद|सहायता|मदद|अनुरोध)[^।!?\n]{0,40}नहीं"],
    "th": [r"(?:ขออภัย|ขอโทษ|เสียใจ)[^\n]{0,80}(?:ไม่สามารถ|ไม่ได้|มิได้)", r"(?:ฉัน|ผม|ดิฉัน|เรา)ไม่สามารถ[^\n]{0,30}(?:แปล|ช่วย|ให้|ดำเนินการ)"],
    "ar": [r"(?:عذرا|آسف|للأسف)[^.!؟\n]{0,60}(?:لا أستطيع|لا يمكنني)"],
}
# The commonest function words, by which languages in Latin letters are told apart.
FUNCTION_WORDS = {
    "en": "the of and to in is that it was for on are with as by be this had not but from or have an they which were all one their been has would".split(),
    "fr": "le la les de des du et en un une que qui dans est pour pas sur au aux ne se ce cette son sa par avec plus été entre ou où dont leur ses comme".split(),
    "de": "der die das und in den von zu mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass nach wird bei über einer zum war durch nur".split(),
    "es": "el la los las de que y en un una por con no se para su al lo como más pero sus le ya o este sí porque esta entre cuando muy sin sobre ser donde quien".split(),
    "it": "il lo gli le di che e in un una per non con si del della dei delle sono ma come anche più nel nella questo alla".split(),
    "pt": "o os as de que e em um uma para com não se na no por mais dos das ao como mas foi à ele seu sua ou quando".split(),
    "nl": "de het een en van in is dat op te zijn met voor niet aan er om ook als dan maar bij uit nog naar".split(),
}
# Words that label an answer.
LABELS = "译文|译作|翻译如下|翻译结果|翻译|回答|答复|答案|訳文|翻訳|Translation|Translated text|Answer|Response|Note|Output|Traduction|Traducción|Traduzione|Tradução|Übersetzung|Réponse|Respuesta|Antwort|अनुवाद|คำแปล"

# What every phrase of a language holds at least one of, in lower case; texts without any skip its patterns.
_HINTS = {
    "en": "sorry|apolog|unfortunately|regret|cannot|can't|can not|unable|not able|won't|will not|decline|refuse|as an ai|as a |as an |guideline|polic|rules|programming|request".split("|"),
    "zh": "抱歉|对不起|遗憾|不能|无法|无权|不便|不可以|拒绝|没有办法|作为|违反|不符合|恕".split("|"),
    "fr": "désol|regrette|malheureusement|excusez|je ne|en tant|je dois|demande|requête|ne peut|ne saurait".split("|"),
    "de": "leider|leid|entschuldig|bedaure|ich |als ki|als sprach|als künst|anfrage|kann".split("|"),
    "es": "siento|lamento|disculp|lamentablemente|perdón|no puedo|no podemos|no me es|como un|como modelo|como ia|como intel|como asis|debo|solicitud|petición|no puede|no se puede|no pudo".split("|"),
    "it": "dispiace|purtroppo|spiacente|non posso".split("|"), "pt": "desculp|lamento|infelizmente|sinto muito|não posso".split("|"),
    "ru": "извините|сожалени|простите|сожалею|не могу".split("|"), "ja": "できません|出来ません|かねます|できかね|拒否|ai|言語モデル|人工知能".split("|"),
    "ko": "죄송|번역|도움|제공".split("|"), "hi": "क्षमा|माफ|खेद|मैं".split("|"), "th": "ขอ|เสียใจ|ไม่สามารถ".split("|"), "ar": "عذرا|آسف|للأسف".split("|"),
}
_REFUSAL = [(tuple(_HINTS[k]), re.compile("|".join(f"(?:{p})" for p in ps).replace("AI", "ai"))) for k, ps in REFUSALS.items()]
_LABEL = re.compile(rf"^\W*(?:{LABELS})\W{{0,3}}[:：*\n]\W*", re.IGNORECASE)
_QUOTED = re.compile(r"“[^”\n]*”|\"[^\"\n]*\"|«[^»\n]*»|「[^」\n]*」|『[^』\n]*』|„[^“”\n]*[“”]|»[^«\n]*«")
_WRAPPED = re.compile(r"^\s*[“\"«「『„](.*)[”\"»」』“]\s*$", re.DOTALL)
_BOOK = re.compile(r"^\W*[^\W\d_][\w'’-]*, (?:[^\W\d_]\.[ -]?)+,? .*\b\d{4}\b|\([^()]*[:：][^()]*,\s*\d{4}\)[^.]{0,30}\.?\W*$")
_SQUEEZE = re.compile(r"[\W_]+")
_SCRIPTS = re.compile(r"(?P<han>[㐀-鿿豈-﫿]+)|(?P<kana>[぀-ヿㇰ-ㇿ]+)|(?P<latin>[A-Za-zÀ-ɏ]+)|(?P<hangul>[가-힣ᄀ-ᇿ]+)|(?P<indic>[ऀ-෿]+)|(?P<thai>[฀-๿]+)|(?P<other>[Ͱ-ԯ֐-ۿ]+)")
# Marks that end a sentence; openers and marks that can't; closers, and what each opener needs.
_ENDS, _OPEN, _NEVER = "。！？.!?．｡।॥؟", "“‘„«「『（(《〈[【", "、，,；;：:—–-"
_CLOSE = "”’\"'»」』）)》〉]】*_~`"
_PAIRS = {"“": "”", "（": "）", "(": ")", "「": "」", "『": "』", "《": "》", "【": "】", "«": "»"}
_AFTER = re.compile(r"(?<=[。！？.!?”’」』）)])\s*[(（][^()（）]{1,40}[)）]$")
_ELLIPSIS = ("…", "...", "……", ". . .")
UNSTOPPED_KINDS = ("heading", "caption", "verse", "table_cell")
_HAN_LANGUAGES, _OTHER_SCRIPT = ("zh", "zh-CN", "zh-TW"), {"ja": "kana", "ko": "hangul", "hi": "indic", "th": "thai"}


def declines(text: str) -> bool:
    low = consistent(text).lower().replace("’", "'")
    return any(any(h in low for h in hints) and pattern.search(low) for hints, pattern in _REFUSAL)


def squeeze(text: str) -> str:
    return _SQUEEZE.sub("", consistent(text)).casefold()


def scripts(text: str) -> dict[str, int]:
    counts = dict.fromkeys(("han", "kana", "latin", "hangul", "indic", "thai", "other"), 0)
    for m in _SCRIPTS.finditer(text):
        counts[m.lastgroup] += len(m[0])
    return counts


def latin_language(text: str) -> str | None:
    """The language whose function words are most frequent; None if no language leads with two."""
    found = re.findall(r"[a-zà-ÿœ]+", text.lower())
    scores = sorted(((sum(w in ws for w in found), k) for k, ws in _WORD_SETS.items()), reverse=True)
    return scores[0][1] if scores[0][0] >= 2 and scores[0][0] > scores[1][0] else None


_WORD_SETS = {k: frozenset(v) for k, v in FUNCTION_WORDS.items()}


def language_of(text: str) -> str | None:
    """The language of ``text`` as far as script and function words tell; names in Latin letters don't count."""
    c = scripts(text)
    if c["kana"] >= 2 and c["kana"] * 10 >= c["han"] + c["kana"]:
        return "ja"
    script, n = max(c.items(), key=lambda x: x[1] if x[0] != "latin" else 0)
    small = re.findall(r"(?<![A-Za-zÀ-ɏ])[a-zà-ÿœ'’]{2,}", text)
    if n and not (len(small) >= 3 and sum(map(len, small)) > 2 * n):
        return {"han": "zh", "hangul": "ko", "indic": "hi", "thai": "th"}.get(script, script)
    return latin_language(text) or ("latin" if len(small) >= 3 else None)


def is_copy(source: str, answer: str) -> bool:
    """Whether the squeezed answer repeats the squeezed source, whole, wrapped, nearly, or its beginning."""
    if not source or not answer:
        return False
    if source == answer or source in answer and len(answer) <= len(source) * 1.25 + 12 or answer in source and len(answer) * 2 >= len(source) and len(answer) > 8:
        return True
    if len(source) < 12 or not 0.4 <= len(answer) / len(source) <= 1.6:
        return False
    grams = {source[k : k + 4] for k in range(len(source) - 3)}
    of = [answer[k : k + 4] in grams for k in range(len(answer) - 3)]
    return sum(of) >= 0.7 * len(of)


def unclosed(text: str) -> bool:
    return any(text.count(a) > text.count(b) for a, b in _PAIRS.items())


def is_truncated(source: str, answer: str, kind: str | None, usual: float | None) -> bool:
    """Whether the answer stops in the middle of a sentence. ``usual`` is the usual length of an answer in lengths of its source."""
    end = answer.rstrip().rstrip("*_~`")
    while (note := _AFTER.search(end)) and note.start():  # a number or remark in brackets behind the last sentence
        end = end[: note.start()]
    if not end:
        return False
    if end.endswith(_ELLIPSIS):
        tail = source.rstrip().rstrip(_CLOSE)
        return not tail.endswith(_ELLIPSIS)
    if end[-1] in _OPEN or end[-1] in _NEVER:
        return source.rstrip()[-1:] not in _NEVER
    bare = end.rstrip(_CLOSE)
    if bare and bare[-1] in _ENDS or bare.endswith(_ELLIPSIS):
        return False
    if re.search(r"\[\^?\w{1,8}\]$", end) or unicodedata.category(end[-1])[0] == "S":
        return False
    if kind in UNSTOPPED_KINDS:
        return bool(usual) and len(source) >= 40 and len(answer) < 0.55 * usual * len(source) or unclosed(end)
    # A source that itself isn't a sentence needs no full stop either, if the answer is as long as usual.
    stopped = source.rstrip().rstrip(_CLOSE)[-1:] in _ENDS
    return stopped or unclosed(end) or not usual or len(answer) < 0.8 * usual * len(source)


def defects(source: str | None, answer: str | None, kind: str | None, source_lang: str | None, target_lang: str | None, usual: float | None = None) -> list[str]:
    """All defects of the pair in the order of ``DEFECTS``. A null or empty source has no defective answer."""
    source, answer = source or "", answer or ""
    if not any(c.isalnum() for c in source):
        return []
    if not any(c.isalnum() for c in answer):
        return ["empty"]
    found = []
    target, origin = (target_lang or "").split("-")[0], (source_lang or "").split("-")[0]
    whole = _WRAPPED.match(answer)
    open_text = _QUOTED.sub(" ", whole[1] if whole and not re.search(r"[“”«»「」„]", whole[1]) else answer)
    if declines(open_text) and not declines(source):
        found.append("refusal")
    keeps = bool(_BOOK.search(source)) or not any(c.isalpha() for c in source)
    if not keeps:
        body = _LABEL.sub("", answer)
        s, a = squeeze(source), squeeze(body)
        in_target = origin != target and language_of(source) == target
        copied = not in_target and is_copy(s, a)
        if copied:
            found.append("copy")
        lang = language_of(consistent(body))
        if lang and lang not in (target, origin) and not copied and not (lang == "latin" and target in _WORD_SETS):
            found.append("wrong_language")
    if is_truncated(source, answer, kind, usual):
        found.append("truncated")
    return found


def pair_defects(df: DataFrame, record: str, source: str, answer: str, kind: str, source_lang: str, target_lang: str) -> DataFrame:
    """(record, defects, defect): the pairs with any defect, all that fired and the first of them.

    The usual length of answers is the median over all pairs of two languages. A null id is kept; repeated rows are
    judged each; a null answer is an empty one; a null or empty source has no defect.
    """
    rows = df.select(F.col(record).alias("record"), F.col(source).alias("s"), F.col(answer).alias("a"), F.col(kind).alias("k"), F.col(source_lang).alias("sl"), F.col(target_lang).alias("tl"))
    usual = rows.where((F.length("s") >= 40) & (F.length("a") > 0)).groupBy("sl", "tl").agg(F.percentile_approx(F.length("a") / F.length("s"), 0.5).alias("usual"))

    def make():
        def work(records, sources, answers, kinds, sls, tls, ratios):
            for r, s, a, k, sl, tl, u in zip(records, sources, answers, kinds, sls, tls, ratios):
                if found := defects(s, a, k, sl, tl, u):
                    yield r, found, found[0]

        return work

    joined = rows.join(usual.withColumnRenamed("sl", "sl_").withColumnRenamed("tl", "tl_"), F.col("sl").eqNullSafe(F.col("sl_")) & F.col("tl").eqNullSafe(F.col("tl_")), "left")
    return map_batches(spread(joined.select("record", "s", "a", "k", "sl", "tl", "usual")), make, "record string, defects array<string>, defect string")
