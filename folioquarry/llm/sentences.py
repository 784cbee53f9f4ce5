"""Sentence units of texts in many languages and scripts.

Method: semi-Markov dynamic programming. Every line of a text is cut into whole spans at the places where a sentence
could end; a span is scored by its length, its opening and closing words, and whether its quotation marks and brackets
balance, and the best sequence of spans is found over all of them at once.
"""

from __future__ import annotations

import re
from itertools import accumulate

from pyspark.sql import DataFrame, functions as F

from folioquarry.functions.arrow import map_batches
from folioquarry.session import spread

# Abbreviations that need what follows them, and those that may also end a sentence.
NEEDS_MORE = frozenset("""
dr mr mrs ms messrs st ste prof capt col gen lt maj sgt rev hon gov sen rep pres sr sra srta dra don dña d dª ud uds vd vds ee excmo excma ilmo mme mlle mm me mgr fr frl hr hrn fam fa geb gest
no nos nr núm nro num vol vols pp p pg pág págs ed eds edn fol fols art arts cf cfr fig figs ch chap cap caps sec sect par para v vs viz ibid ca c circa b bd bde abb abs anm aufl hg hrsg hrg vgl s so sog
bzw resp z u h i e g al approx aprox av avda avd blvd rd ave pl pza bvd mt ft jan feb mar apr jun jul aug sep sept oct okt nov dec dez janv févr avr juil déc ene abr ago dic
n° tel tél str inkl exkl einschl insb evtl ggf allg amtl betr usf d.h z.b u.a i.e e.g q.v s.v op loc trans transl übers éd trad t tom réf p.ej ej
डॉ श्री श्रीमती पृ प्रो सं ई पं कु नं वि रु
""".split())
MAY_END = frozenset("etc usw co bros jr inc ltd corp cie ff jh jhd jhs chr a.m p.m am pm u.s u.k n.e s.e n.w s.w r.i.p b.c a.d ad bc a.c d.c n.chr v.chr esq dept univ assn mark".split()) - {"mark"}
# Verbs that name a speaker.
SAYING = frozenset("""
said says asked asks cried cries replied replies wrote writes answered answers shouted shouts whispered called added remarked exclaimed murmured told declared insisted
sagte sagt fragte fragt rief ruft antwortete antwortet schrieb schreibt flüsterte meinte erwiderte erklärte murmelte
dijo dice preguntó pregunta gritó grita respondió responde escribió contestó exclamó añadió murmuró susurró
dit demanda demande cria répondit répond écrivit ajouta murmura s'écria déclara
कहा पूछा बोला बोली बोले चिल्लाया चिल्लाई लिखा उत्तर पुकारा
""".split())

_OPENERS, _CLOSERS = "“„«「『（([{《〈【‘", "”»」』）)]}》〉】’"
_PAIR = dict(zip("”“»」』）)]}》〉】", ["“„", "„", "«", "「", "『", "（", "(", "[", "{", "《", "〈", "【"]))
# The mark “ closes a quotation only where the line has one opened by „.
_END, _END_LOW = (re.compile(rf"(?P<t>[.!?…。！？।॥؟．｡]+(?: \.\.?\.?(?=\s|$))*)(?P<c>[{low}\"”’»」』）)\]}}》〉】*_]*)(?P<n>(?:\[\^?[^\]\s]{{1,10}}\])*)") for low in ("", "“"))
_LINE = re.compile(r"[^\n\r\v\f\x85\u2028\u2029]+")
_WORD = re.compile(r"[^\s!?“”„«»\"(（\[「『—–-]+$")
_ROMAN = re.compile(r"[ivxlcdm]{1,6}|[a-z]|\d{1,3}(?:\.\d{1,3})*")
_OPEN_MARKS = re.compile(r"[\s\"“”„«»「『（(\[‘’'—–¿¡*_\-]*")
STRONG, ENOUGH = 4.0, 0.0


def _before(line: str, at: int) -> str:
    m = _WORD.search(line, max(0, at - 40), at)
    return m[0] if m else ""


def _cjk(c: str) -> bool:
    return "⺀" <= c <= "鿿" or "豈" <= c <= "﫿" or "가" <= c <= "힣" or "！" <= c <= "･"


def _after_closers(line: str, m: re.Match, follows: str) -> float | None:
    """The same where marks without spaces close a quotation or brackets around the sentence's end."""
    closer = m["c"][-1]
    opener = max((line.rfind(o, 0, m.start()) for o in _PAIR.get(closer, "")), default=-1)
    alone = opener < 0 or line[:opener].rstrip()[-1:] in ("", *"。！？!?…．.」』”）)")
    if closer in "）)]】》〉}":
        return STRONG if alone else None
    if "ぁ" <= follows[0] <= "ん":
        return None  # a particle carries the sentence on
    clause = re.match(r"[^。！？\n“「]{1,24}", follows)
    return None if alone and clause and re.search(r"[说說问問道喊叫答写寫嚷吼](?:着|了|道)?$", clause[0]) else STRONG


def _ending(line: str, m: re.Match, lang: str) -> float | None:
    """How well a sentence ends with the marks of ``m``, by its closing word and what follows; None if it can't."""
    marks, end = m["t"], m.end()
    if end >= len(line):
        return None
    rest = line[end:]
    follows = rest.lstrip()
    if not follows:
        return None
    spaced = len(follows) < len(rest)
    first = follows[_OPEN_MARKS.match(follows).end() :][:1]
    hard = any(c in "。！？।॥؟．｡" for c in marks)
    lead = follows[0]
    word = _before(line, m.start())
    bare = word.lower().strip("'’")
    bare = bare if bare in MAY_END or bare in NEEDS_MORE else bare.rpartition(".")[2]
    if not spaced:
        if hard and (not first or not first.islower()) and lead not in "、，；：,;:)）」』”":
            return _after_closers(line, m, follows) if m["c"] and _cjk(lead) else STRONG
        # A space left out: "…of it.Then"
        if marks[-1] in ".!?" and not m["c"] and not m["n"] and lead == first and follows[:2].istitle() and (len(bare) > 2 and word.rpartition(".")[2][1:].islower() and bare not in NEEDS_MORE or bare in MAY_END):
            return 1.0
        if (m["n"] or m["c"]) and first and not first.islower() and (lead.isupper() or lead in "“„«「(（"):
            return 1.0
        return None
    if lead in ",;:、，；：…":
        return None
    if first.islower() and not re.match(r"(?:[ivxl]{2,5}|[ivx])\. [A-ZÀ-Þ]", follows):
        return None
    if set(marks) <= set("….  ") and len(marks) > 1 and marks.strip(".") in ("", "…", " ", "……"):
        return 1.5 if first.isupper() or lead in "¿¡“„«(" else None  # an ellipsis ends only before an opening word
    if hard or marks[-1] in "!?":
        return STRONG
    if m["c"] and any(c in _CLOSERS + "\"“" for c in m["c"]):
        return STRONG
    if not word:
        return 1.0
    script = next((c for c in reversed(word) if c.isalpha()), "")
    if "ऀ" <= script <= "෿" and lang != "en":
        return -1.0  # such scripts end with a danda
    if bare in MAY_END or m["n"] or bare == "m" and line[: m.start()].endswith((" p. m", " a. m")):
        return 2.0
    if bare in NEEDS_MORE:
        return -3.0
    if len(word) == 1 and word.isalpha() or re.fullmatch(r"(?:[A-Za-zÀ-ÿ]\.)+[A-Za-zÀ-ÿ]", word):
        return -2.0  # initials
    if re.fullmatch("[ivxl]{2,6}", word) and line[: m.start() - len(word)].rstrip()[-1:] in ("", *".!?…。！？”»)"):
        return -4.0  # numbers what follows
    if word.isdigit() and len(word) <= 2 and first.isdigit():
        return -2.0  # parts of a date
    if word.isdigit() and len(word) <= 2 and lang in ("de", "da", "no", "fi", "cs", "hu") and first.isalpha():
        return -2.0  # an ordinal
    return 3.0


def _depths(line: str, cuts: list[int]) -> tuple[list[bool], set[int]]:
    """Whether a pair of marks is open at each cut, and where pairs begin."""
    stack: list[tuple[str, int]] = []
    spans: list[tuple[int, int]] = []
    for k, c in enumerate(line):
        if c in "\"":
            if stack and stack[-1][0] == '"':
                spans.append((stack.pop()[1], k))
            else:
                stack.append(('"', k))
        elif c == "“" and not any(o == "„" for o, _ in stack) or c in _OPENERS and c not in "“‘":
            stack.append((c, k))
        elif c in _PAIR:
            for j in range(len(stack) - 1, -1, -1):
                if stack[j][0] in _PAIR[c]:
                    spans.append((stack[j][1], k))
                    del stack[j:]
                    break
    change = [0] * (len(line) + 2)
    for a, b in spans:
        change[a + 1] += 1
        change[b + 1] -= 1
    depth = list(accumulate(change))
    return [depth[cut] > 0 for cut in cuts], {a for a, _ in spans}


def _spans(line: str, lang: str) -> list[tuple[int, int]]:
    """The best spans of one line."""
    places, scores = [], []
    for m in (_END_LOW if "„" in line else _END).finditer(line):
        s = _ending(line, m, lang)
        if s is not None and s > ENOUGH:  # no span scores above 0, so a cut of no gain is never part of the best sequence
            places.append(m.end())
            scores.append(s)
    if lang == "th":
        for m in re.finditer(r"\s+(?=\S)", line):
            if m.start() and m.start() not in places:
                places.append(m.start())
                scores.append(STRONG)
        order = sorted(range(len(places)), key=places.__getitem__)
        places, scores = [places[k] for k in order], [scores[k] for k in order]
    if not places:
        return [(0, len(line))]
    inside, opened = _depths(line, places) if any(c in line for c in "\"“„«「『（([{《〈【") else ([False] * len(places), set())
    cuts = [0, *places, len(line)]
    n = len(cuts)
    best, back, ready, top = [float("-inf")] * n, [0] * n, [0], [0.0]
    best[0] = 0.0
    for j in range(1, n):
        if j < n - 1 and inside[j - 1]:
            continue  # marks of this pair would not balance
        gain = scores[j - 1] if j < n - 1 else 0.0
        for k in range(len(ready) - 1, -1, -1):
            if top[k] + gain <= best[j]:
                break  # nothing from here back can be better
            i = ready[k]
            s = best[i] + gain + _span_score(line, cuts, i, j, back, opened)
            if s > best[j]:
                best[j], back[j] = s, i
        ready.append(j)
        top.append(max(top[-1], best[j]))
    out, j = [], n - 1
    while j:
        out.append((cuts[back[j]], cuts[j]))
        j = back[j]
    return out[::-1]


def _span_score(line: str, cuts: list[int], i: int, j: int, back: list[int], opened: set[int]) -> float:
    """The score of a span by itself: its length, an enumerator alone, a clause that only names the speaker of the quotation before."""
    text = line[cuts[i] : cuts[j]].strip()
    score = 0.0
    if _ROMAN.fullmatch(text.rstrip(".):").lower()) and j < len(cuts) - 1 and i == 0:
        score -= 8.0  # "iv." numbers what follows
    if len(text) < 3:
        score -= 1.0
    if i and line[cuts[i] - 1] in "”\"“»」』’":
        start = cuts[back[i]] + len(line[cuts[back[i]] :]) - len(line[cuts[back[i]] :].lstrip())
        words = [w.strip(".,!?।॥:;“”\"").lower() for w in text.split()]
        named = bool(SAYING.intersection(words[:5] if text[:1].isascii() else words[-2:]))
        if named and len(words) <= 9 and start in opened and not any(c in text for c in _OPENERS):
            score -= 9.0  # the speaker's clause belongs to its quotation
    return score


def sentences(text: str | None, lang: str | None = None, heading: bool = False) -> list[tuple[int, int]]:
    """(start, end) of every unit of ``text``: no white space at the ends, all other characters covered.

    A line break ends a unit; each line of a heading is one unit; null, empty and blank texts have none.
    """
    out = []
    for line in _LINE.finditer(text or ""):
        for a, b in [(0, len(line[0]))] if heading else _spans(line[0], (lang or "").split("-")[0]):
            piece = line[0][a:b]
            left = len(piece) - len(piece.lstrip())
            if piece.strip():
                out.append((line.start() + a + left, line.start() + a + len(piece.rstrip())))
    return out


def split_sentences(df: DataFrame, record: str, text: str, lang: str | None = None, kind: str | None = None) -> DataFrame:
    """(record_id, start_offset, end_offset) of every sentence of every row; offsets count code points.

    ``lang`` and ``kind`` name optional columns (kind 'heading' makes lines whole units); null values there mean unknown.
    Null and blank texts give no rows; a null id is kept; repeated rows give repeated spans.
    """
    none = F.lit(None).cast("string")
    rows = df.select(F.col(record).alias("r"), F.col(text).alias("t"), F.col(lang).alias("l") if lang else none.alias("l"), F.col(kind).alias("k") if kind else none.alias("k"))

    def make():
        def work(records, texts, langs, kinds):
            for r, t, l, k in zip(records, texts, langs, kinds):
                for a, b in sentences(t, l, k == "heading"):
                    yield r, a, b

        return work

    return map_batches(spread(rows.where(F.col("t").isNotNull())), make, "record_id string, start_offset bigint, end_offset bigint")
