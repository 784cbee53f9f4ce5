"""Texts of scanned pages: running heads, page numbers, cut words and misread characters, and the paragraphs without them.

Method: the lines of every record are labelled as header, body or break (the last line of a paragraph) by a linear-chain
conditional model, decoded with Viterbi over layout features of a line and the labels of its neighbours; paragraphs are
put together from the labels. The model is fitted to the texts themselves: in a bounded sample of books, page numbers that
run with the sheets and lines that repeat a title whole label lines for certain, and the model carries them over to damaged
and shortened ones. What a label or a repair needs to know of the whole corpus is counted over all records:
the distance of printed page numbers in each book, the words of each language, and compounds written with a hyphen.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from difflib import SequenceMatcher
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

from folioquarry.functions.arrow import map_batches
from folioquarry.operators.ordered import following, previous, running_sum
from folioquarry.session import cut_lineage, small, spread

HEADER, BODY, BREAK = 0, 1, 2
LABELS = ("header", "body", "break")
FEATURES = ("title", "number", "edge", "short", "stopped", "words", "last", "cut", "bias")
# What the fit starts from and is held to by a weak prior: weights of FEATURES by label, and of pairs of labels.
PRIOR = (((9.0, -2.0, -2.0), (7.0, 0.0, -1.0), (0.5, 0.0, 0.0), (0.3, -0.5, 1.0), (-1.0, 0.0, 1.5), (-4.0, 1.0, 0.5), (0.0, -0.5, 1.0), (-4.0, 2.0, -4.0), (-1.0, 0.5, 0.0)),
         ((-0.5, 0.0, 0.0), (0.0, 0.5, 0.2), (0.3, 0.0, 0.0)))
SAMPLE_BOOKS, SAMPLE_RECORDS, SAMPLE_CHARS = 40, 4000, 5000  # bounds of the sample that the model is fitted to: books, records in all, characters of a record
ROUNDS, RATE, HOLD = 80, 0.3, 0.05  # of the fit: steps, their size, and how strongly the prior holds
HYPHENS = "-‐­¬"
# Characters and pairs that recognition takes for one another.
CONFUSED = "ec ce oa ao tf ft co oc un nu il li l1 1l i1 1i I1 1I Il lI lI O0 0O o0 0o s5 5s S5 5S g9 9g b6 6b o6 6o e6 6e é6 6é B8 8B z2 2z hb bh vy yv ij ji íi ií ìi éè èé aá áa oó óo eé ée uü üu"
CONFUSED_PAIRS = (("rn", "m"), ("m", "rn"), ("cl", "d"), ("d", "cl"), ("li", "h"), ("h", "li"), ("ii", "u"), ("u", "ii"), ("vv", "w"), ("w", "vv"), ("ri", "n"), ("n", "ri"), ("in", "m"), ("m", "in"), ("nn", "rm"), ("fi", "h"), ("h", "fi"), ("ii", "ü"), ("a'", "ä"), ("o'", "ö"), ("u'", "ü"), ("e'", "é"))
COMMON, TIMES = 5, 8  # a word is the right reading of another if it occurs so often, and so many times as often
SHORT, SHORT_TIMES = 3, 20  # words of so few letters resemble more common words by chance: a reading must be so many times as often

_SUBSTITUTES: dict[str, str] = {}
for _pair in CONFUSED.split():
    if _pair[1].isalpha():
        _SUBSTITUTES[_pair[0]] = _SUBSTITUTES.get(_pair[0], "") + _pair[1]
_FOLD = str.maketrans("01i|!569342", "olllls" + "b" + "g" + "e" + "a" + "z")
_DIGITS = str.maketrans("lIi|!OoQSsBZzgGb", "1111100055822966")
_TOKEN = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
_ROMAN = re.compile(r"m{0,3}(?:cm|cd|d?c{0,3})(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})", re.IGNORECASE)
_CUT = re.compile(rf"([^\W\d_][\w'’]*(?:[-‐][^\W\d_]+)*)([{HYPHENS}])[ \t]*$")
_NUMBER_END = re.compile(r"^[\s\-–—|.·•*\[(]*(?:(?:p|pp|page|s|seite|pág|pag)\.?\s*)?([\dlIiOoSsBZ|!](?:\s?[\dlIiOoSsBZ|!]){0,3}|[ivxlcdmIVXLCDM]{1,9})[\s\-–—|.·•*\])]*$", re.IGNORECASE)


def printed_number(text: str) -> int | None:
    """The page number that ``text`` prints, alone or with ornaments; misread figures and roman numbers included."""
    m = _NUMBER_END.match(text)
    if not m:
        return None
    body = re.sub(r"\s", "", m[1])
    if _ROMAN.fullmatch(body) and not body.isdigit() and not any(c.isdigit() for c in body):
        value, last = 0, 0
        for c in reversed(body.lower()):
            n = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}[c]
            value, last = (value - n, last) if n < last else (value + n, n)
        return value
    digits = body.translate(_DIGITS)
    return int(digits) if digits.isdigit() and any(c.isdigit() for c in body) and len(digits) <= 4 else None


@lru_cache(50_000)
def folded(text: str) -> str:
    """Letters without case, accents and the differences that misreading makes."""
    plain = unicodedata.normalize("NFKD", text.casefold())
    return "".join(c for c in plain if c.isalnum()).translate(_FOLD)


def like_title(line: str, titles: tuple[str, ...]) -> bool:
    """Whether ``line`` is one of ``titles`` (folded), whole, shortened at its end, or damaged."""
    longest = max(map(len, titles), default=0) * 1.2 + 2
    if len(line) > 140 and sum(map(str.isalnum, line)) > longest:
        return False  # folding leaves no fewer characters
    core = folded(line)
    if len(core) < 4:
        return bool(core) and core in titles
    for t in titles:
        if len(core) > len(t) * 1.2 + 2 or len(core) < 6 and len(core) * 2 < len(t):
            continue
        head = t[: len(core)]
        if core == head:
            return True
        # Damage leaves most characters in place near the beginning, which is cheap to see.
        if len(core) >= 7 and sum(x == y for x, y in zip(core[:8], head)) >= 4 and SequenceMatcher(None, core, head, False).ratio() >= 0.85:
            return True
    return False


def _heads(line: str) -> list[tuple[str, int | None]]:
    """Readings of ``line`` as (rest, number): as it is, and with a page number split off at either end."""
    out = [(line, None)]
    tokens = line.split()
    if len(tokens) > 1:
        for number, rest in ((tokens[0], tokens[1:]), (tokens[-1], tokens[:-1])):
            n = printed_number(number)
            if n is not None:
                out.append((" ".join(rest).strip(" |—–-·•"), n))
    return out


def observed(lines: list[str], titles: tuple[str, ...]) -> tuple[list[list[int]], list[list[int]], list[bool]]:
    """The places in FEATURES of what holds for each line, the page numbers it may print, and whether it looks like a title."""
    width = max((len(x) for x in lines), default=0)
    seen, numbers, titled = [], [], []
    for k, line in enumerate(lines):
        text = line.strip()
        number, head, found = printed_number(text), False, []
        if number is not None:
            found = [number]
        else:
            for rest, n in _heads(text):
                if like_title(rest, titles):
                    head = True
                    found += [n] * (n is not None)
        holds = (head, number is not None, k in (0, len(lines) - 1), len(text) < 0.8 * width, text[-1:] in ".!?…:;»”)", text.count(" ") > 2, k == len(lines) - 1, bool(text[-1:] in HYPHENS and _CUT.search(text)), True)
        seen.append([f for f, x in enumerate(holds) if x])
        numbers.append(found)
        titled.append(head)
    return seen, numbers, titled


def decode(seen: list[list[int]], model: tuple) -> list[int]:
    """The best row of labels for the features of each line."""
    if not seen:
        return []
    weights, pairs = model
    emissions = [[sum(weights[f][s] for f in on) for s in (HEADER, BODY, BREAK)] for on in seen]
    best, back = emissions[0], []
    for e in emissions[1:]:
        step = [max((best[p] + pairs[p][s], p) for p in range(3)) for s in range(3)]
        back.append([p for _, p in step])
        best = [step[s][0] + e[s] for s in range(3)]
    path = [max(range(3), key=best.__getitem__)]
    for b in reversed(back):
        path.append(b[path[-1]])
    return path[::-1]


def fit(examples: list[tuple[list[list[int]], list[int]]]) -> tuple:
    """Weights of the conditional model from (features of lines, labels of lines): most likely ones under the prior, by gradient ascent on whole rows of labels."""
    weights, pairs = (np.array(x) for x in PRIOR)
    if not examples:
        return PRIOR
    groups: dict[int, list] = {}
    for seen, labels in examples:
        groups.setdefault(len(seen), []).append((seen, labels))
    data = []
    for n, rows in sorted(groups.items()):
        x = np.zeros((len(rows), n, len(FEATURES)))
        for r, (seen, _) in enumerate(rows):
            for k, on in enumerate(seen):
                x[r, k, on] = 1
        data.append((x, np.eye(3)[np.array([labels for _, labels in rows])]))
    moved = [np.zeros_like(weights), np.zeros_like(pairs)]
    sized = [np.zeros_like(weights), np.zeros_like(pairs)]
    total = sum(len(labels) for _, labels in examples)
    w, p = weights.copy(), pairs.copy()
    top = lambda a, axis: a.max(axis, keepdims=True)
    total_of = lambda a, axis: (np.log(np.exp(a - top(a, axis)).sum(axis, keepdims=True)) + top(a, axis)).squeeze(axis)
    for step in range(1, ROUNDS + 1):
        grad = [HOLD * (weights - w), HOLD * (pairs - p)]
        for x, y in data:
            e = x @ w
            ahead, behind = [e[:, 0]], [np.zeros_like(e[:, 0])]
            for k in range(1, e.shape[1]):
                ahead.append(e[:, k] + total_of(ahead[-1][:, :, None] + p, 1))
            for k in range(e.shape[1] - 1, 0, -1):
                behind.append(total_of(p + (e[:, k] + behind[-1])[:, None, :], 2))
            behind.reverse()
            whole = total_of(ahead[-1], 1)[:, None]
            share = np.stack([np.exp(a + b - whole) for a, b in zip(ahead, behind)], 1)
            grad[0] += np.einsum("rkf,rks->fs", x, y - share)
            for k in range(1, e.shape[1]):
                both = np.exp(ahead[k - 1][:, :, None] + p + (e[:, k] + behind[k])[:, None, :] - whole[:, :, None])
                grad[1] += np.einsum("rs,rt->st", y[:, k - 1], y[:, k]) - both.sum(0)
        for value, g, m, v in zip((w, p), grad, moved, sized):
            g /= total
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            value += RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
    return tuple(map(tuple, w.round(4).tolist())), tuple(map(tuple, p.round(4).tolist()))


def labelled(rows: list[tuple]) -> list[tuple[list[list[int]], list[int]]]:
    """Examples from (document, page_no, text, title, chapter) rows: records of whose lines every label is certain.

    A line is a header if it prints a number that runs with the sheets of its book, or repeats a title whole. A record with a line
    that only might be one (a number out of the run, a damaged title) is left out. A body line that ends the record, or
    ends short after a sentence mark, is a break.
    """
    read_, votes = [], {}
    for doc, page, text, title, chapter in rows:
        titles = tuple(folded(t) for t in (title, chapter) if t)
        lines = [x for x in _BREAKS.split(text or "") if x.strip()]
        seen, numbers, titled = observed(lines, titles)
        read_.append((doc, page, titles, lines, seen, numbers, titled))
        if page is not None:
            votes.setdefault(doc, Counter()).update(n - page for found in numbers for n in found)
    run = {d: c.most_common(1)[0] for d, c in votes.items() if c}
    out = []
    for doc, page, titles, lines, seen, numbers, titled in read_:
        labels = []
        for k, line in enumerate(lines):
            places = [n - page - run[doc][0] for n in numbers[k]] if page is not None and doc in run and run[doc][1] > 2 else []
            if any(p in (0, 1) for p in places) or titled[k] and any(folded(rest) in titles for rest, _ in _heads(line.strip())):
                labels.append(HEADER)
            elif numbers[k] or titled[k]:
                break
            else:
                on = [FEATURES[f] for f in seen[k]]
                labels.append(BREAK if "last" in on or "short" in on and "stopped" in on else BODY)
        if lines and len(labels) == len(lines):
            out.append((seen, labels))
    return out


def fitted_model(records: DataFrame) -> tuple:
    """The line model of these records, from at most ``SAMPLE_RECORDS`` of them in at most ``SAMPLE_BOOKS`` books, both chosen by hash; longer texts than ``SAMPLE_CHARS`` are not chosen."""
    usable = records.where(F.length("text").between(1, SAMPLE_CHARS) & F.col("record_id").isNotNull() & F.col("document_id").isNotNull())
    books = usable.groupBy("document_id").count().orderBy(F.xxhash64("document_id"), "document_id").limit(SAMPLE_BOOKS).collect()
    if not books:
        return PRIOR
    share = F.coalesce(*[F.when(F.col("document_id") == b.document_id, F.lit(min(1.0, SAMPLE_RECORDS / len(books) / b["count"]))) for b in books], F.lit(0.0))
    chosen = usable.where(F.pmod(F.xxhash64("record_id"), F.lit(1_000_000)) < share * 1_000_000)
    rows = chosen.orderBy(F.xxhash64("record_id"), "record_id", "text").limit(SAMPLE_RECORDS).select("document_id", "page_no", "text", "title", "chapter").collect()
    return fit(labelled([tuple(r) for r in rows]))


_STOPPED = re.compile(r"[.!?…:»”)\]。！？]$")
_BREAKS = re.compile(r"[\n\r\v\f\x85\u2028\u2029]")
_COMPOUND = re.compile(r"[^\W\d_]+(?:[-‐][^\W\d_]+)+")


def read(text: str, title: str | None, chapter: str | None, model: tuple = PRIOR) -> tuple[bool, list[int], list[tuple[str, str, str]], str, list[str], list[str]]:
    """(has a running head, page numbers, words cut at line ends as (first half, mark, second half), running text, its whole words, its joined words).

    A word cut at the end of the text has '' for its second half. In the running text cut words are joined and lines
    end in a space, paragraphs in a line break.
    """
    titles = tuple(folded(t) for t in (title, chapter) if t)
    lines = [x for x in _BREAKS.split(text) if x.strip()]
    seen, numbers, titled = observed(lines, titles)
    labels = decode(seen, model)
    body = [k for k, s in enumerate(labels) if s != HEADER]
    furniture = [k for k, s in enumerate(labels) if s == HEADER]
    cuts, out, whole, skip = [], [], [], ""
    for n, k in enumerate(body):
        line = lines[k].strip()
        last = n + 1 == len(body)
        m = _CUT.search(line)
        words = _TOKEN.findall(line.replace("­", ""))
        if skip:
            words = words[1:]
        skip = ""
        if m:
            after = "" if last else (_TOKEN.match(lines[body[n + 1]].strip()) or [""])[0]
            cuts.append((m[1], m[2], after))
            skip = after
            words = words[: -len(_TOKEN.findall(m[1]))]
            out.append(line[: m.end(1)] if after else line + " " * (not last))
        else:
            out.append(line + ("" if last else "\n" if labels[k] == BREAK and line[-1] in ".!?…»”:" else " "))
        whole += words
    return any(titled[k] for k in furniture), [n for k in furniture for n in numbers[k]], cuts, "".join(out).replace("­", ""), whole, [a.rpartition("-")[2] + b for a, _, b in cuts if b]


def corrupt_by_itself(word: str) -> bool:
    """Whether a word shows by itself that characters were misread: figures among letters, letters in a year."""
    letters, digits = sum(c.isalpha() for c in word), sum(c.isdigit() for c in word)
    if not letters or not digits:
        return False
    if len(word) == 4 and word.translate(_DIGITS).isdigit() and re.match(r"[12]", word.translate(_DIGITS)):
        return digits >= 1
    if re.fullmatch(r"\d+[a-zà-ÿ]{1,3}|[a-z]\d+", word):
        return False  # 12v, 19th, 2e
    return letters >= 2


def readings(word: str) -> set[str]:
    """Words that recognition could have taken for ``word``: one character or pair read differently."""
    out = set()
    for k, c in enumerate(word):
        for r in _SUBSTITUTES.get(c, ""):
            out.add(word[:k] + r + word[k + 1 :])
    for a, b in CONFUSED_PAIRS:
        k = word.find(a)
        while k >= 0:
            out.add(word[:k] + b + word[k + len(a) :])
            k = word.find(a, k + 1)
    return out - {word}


def cased(written: str, right: str) -> str:
    """``right``, the reading of ``written`` in lower case, with the capitals of ``written``; a year is read from the figures as written."""
    if right.isdigit():
        return written.translate(_DIGITS)
    low = written.lower()
    if len(low) != len(written):
        return right[:1].upper() + right[1:] if written[:1].isupper() else right
    a = next((k for k, (x, y) in enumerate(zip(low, right)) if x != y), min(len(low), len(right)))
    z = next((k for k, (x, y) in enumerate(zip(low[a:][::-1], right[a:][::-1])) if x != y), min(len(low), len(right)) - a)
    head, wrong, tail, new = written[:a], written[a : len(low) - z], written[len(low) - z :], right[a : len(right) - z]
    if head + tail != (head + tail).lower() and head + tail == (head + tail).upper() and wrong == wrong.upper():
        new = new.upper()
    elif not head and wrong[:1].isupper() and (wrong, new) != ("I", "l"):  # a capital I is the image of a small l, not of L
        new = new[:1].upper() + new[1:]
    return head + new + tail


def repaired(text: str, fixes: list[dict]) -> str:
    """``text`` with the words of ``fixes`` (word, right; lower case, the first of a word counts) replaced in any case, whole or between apostrophes."""
    right: dict[str, str] = {}
    for f in fixes:
        right.setdefault(f["word"], f["right"])

    def replace(m: re.Match) -> str:
        parts, out, k = re.split("(['’])", m[0]), [], 0
        while k < len(parts):
            end = next((e for e in range(len(parts), k, -2) if "".join(parts[k:e]).lower() in right), None)
            piece = "".join(parts[k:end]) if end else parts[k]
            out += [cased(piece, right[piece.lower()]) if end else piece, *parts[(end or k + 1) : (end or k + 1) + 1]]
            k = (end or k + 1) + 1
        return "".join(out)

    return _TOKEN.sub(replace, text)


RECORDS = "record_id string, document_id string, ordinal int, kind string, page_no int, chapter string, text string, title string, lang string"
_READ = """record_id string, document_id string, source string, ordinal int, lang string, page_no int, own boolean, chapter string, header boolean, pages array<int>,
cuts array<struct<a:string,mark:string,b:string>>, first string, tail string, words array<string>, joined array<string>, compounds array<string>, running string"""


def read_records(records: DataFrame, model: tuple, with_text: bool = False) -> DataFrame:
    """The labelled content of every record (``RECORDS`` and a column ``source`` that names its table), one row each.

    Null and empty texts have neither noise nor words. The columns are those of ``_READ``.
    """
    rows = records.select("record_id", "document_id", "source", "ordinal", "kind", "page_no", "chapter", "text", "title", "lang")

    def make():
        def work(*columns):
            for record, doc, source, ordinal, kind, page, chapter, text, title, lang in zip(*columns):
                header, pages, cuts, running, whole, joined = read(text or "", title, chapter, model)
                first = _TOKEN.search(running)
                yield (record, doc, source, ordinal, lang, page, bool(text) and text == chapter, chapter, header, sorted(set(pages)), [{"a": a, "mark": m, "b": b} for a, m, b in cuts], first[0].lower() if first else None, cuts[-1][0].lower() if cuts and not cuts[-1][2] else None,
                       list({w.lower() for w in whole}), list({w.lower() for w in joined}), list({c.lower().replace("‐", "-") for c in _COMPOUND.findall(running)}) if "-" in running or "‐" in running else [], running if with_text else None)

        return work

    return map_batches(spread(rows), make, _READ)


def misread_words(read_: DataFrame) -> DataFrame:
    """(lang, word, right): words that show misread characters, and their likely reading where one is common enough.

    Words are counted over all records; a reading must occur ``COMMON`` times and ``TIMES`` as often as the word (``SHORT_TIMES`` for
    words of at most ``SHORT`` letters). Words of one letter have no misreading. A reading is at most one letter longer or shorter
    than its word, so only words longer than every common word by more than that are not tried.
    """
    counts = cut_lineage(read_.select("lang", F.explode("words").alias("word")).groupBy("lang", "word").count())
    longest = (counts.where(F.col("count") >= COMMON).agg(F.max(F.length("word"))).first()[0] or 0) + 1
    joined = read_.select("lang", F.explode("joined").alias("word")).distinct().select("lang", "word", F.lit(1).cast("bigint").alias("count"))
    words = counts.unionByName(joined).groupBy("lang", "word").agg(F.max("count").alias("n")).where(F.length("word").between(2, max(longest, 4)))

    def make():
        def work(langs, ws, ns):
            for lang, w, n in zip(langs, ws, ns):
                if any(c.isdigit() for c in w):
                    if corrupt_by_itself(w):
                        year = w.translate(_DIGITS)
                        yield lang, w, n, None, year if len(w) == 4 and year.isdigit() else None
                        # The letters that the figures stand for.
                        for r in readings(w):
                            if not any(c.isdigit() for c in r):
                                yield lang, w, n, r, None
                else:
                    for r in readings(w):
                        yield lang, w, n, r, None

        return work

    tried = map_batches(words, make, "lang string, word string, n bigint, reading string, year string")
    common = counts.where(F.col("count") >= COMMON).select(F.col("lang").alias("lang_"), F.col("word").alias("reading_"), F.col("count").alias("m"))
    hits = tried.join(common, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("reading") == F.col("reading_")), "left").where(F.col("reading").isNull() | (F.col("m") >= F.when(F.length("word") > SHORT, TIMES).otherwise(SHORT_TIMES) * F.col("n")))
    return hits.groupBy("lang", "word").agg(F.coalesce(F.max("year"), F.max_by("reading_", F.struct("m", "reading_"))).alias("right"))


def _compounds(read_: DataFrame) -> DataFrame:
    """(lang, compound, n): words that keep a hyphen inside a line."""
    return read_.select("lang", F.explode("compounds").alias("compound")).groupBy("lang", "compound").agg(F.count(F.lit(1)).alias("n"))


def _with_next(read_: DataFrame) -> DataFrame:
    """What cut words need of each record, with ``next``: the first word of the next record of its book that has any."""
    narrow = read_.select("record_id", "source", "document_id", "ordinal", "lang", "cuts", "first", "tail")
    return following(narrow, ["source", "document_id"], ["ordinal", "record_id"], "first", "next")


def cut_words(read_: DataFrame) -> DataFrame:
    """(record_id, source) of records in which a word is cut, by a mark that isn't the word's own hyphen."""
    follows = _with_next(read_)
    cuts = follows.where(F.size("cuts") > 0).select("record_id", "source", "lang", "next", F.explode("cuts").alias("c"))
    cuts = cuts.select("record_id", "source", "lang", "c.mark", F.lower(F.concat_ws("-", F.translate("c.a", "‐", "-"), F.when(F.col("c.b") == "", F.col("next")).otherwise(F.col("c.b")))).alias("compound"))
    sure = cuts.where(~F.col("mark").isin("-", "‐")).select("record_id", "source")
    known = _compounds(read_).select(F.col("lang").alias("lang_"), F.col("compound").alias("compound_"))
    rest = cuts.where(F.col("mark").isin("-", "‐")).join(known, F.col("lang").eqNullSafe(F.col("lang_")) & (F.col("compound") == F.col("compound_")), "left_anti").select("record_id", "source")
    return sure.unionByName(rest).distinct()


def page_offsets(read_: DataFrame) -> DataFrame:
    """(document_id, offset): how far printed page numbers lie above the sheet's number in each book, by most votes (then the smallest distance)."""
    votes = read_.where("page_no IS NOT NULL").select("document_id", F.explode(F.transform("pages", lambda n: n - F.col("page_no"))).alias("offset")).groupBy("document_id", "offset").count()
    return votes.groupBy("document_id").agg(F.max_by("offset", F.struct("count", -F.abs("offset"))).alias("offset"))


def found_noise(records: DataFrame) -> DataFrame:
    """(record_id, noise): the kinds of noise in every record: hyphen, misread, header, page_number.

    Null ids are left out; repeated rows count once. A heading that stands first among the records of its chapter and
    equals the chapter's title is in its own place.
    """
    records = records.where(F.col("record_id").isNotNull())
    read_ = cut_lineage(read_records(records, fitted_model(records)))
    hyphen = cut_words(read_).select("record_id", F.lit("hyphen").alias("noise"))
    wrong = cut_lineage(misread_words(read_).select("lang", "word"))
    used = read_.select("record_id", "lang", F.explode(F.concat("words", "joined")).alias("word"))
    misread = used.join(small(wrong), ["lang", "word"], "left_semi").select("record_id", F.lit("misread").alias("noise"))
    places = read_.where("own").groupBy("source", "document_id", "chapter").agg(F.min_by("record_id", F.struct("ordinal", "record_id")).alias("record_id"), F.lit(True).alias("in_place"))
    header = read_.where("header").join(places.select("source", "record_id"), ["source", "record_id"], "left_anti").select("record_id", F.lit("header").alias("noise"))
    numbered = read_.where("page_no IS NOT NULL").select("record_id", "document_id", "page_no", F.explode("pages").alias("n"))
    page = numbered.join(page_offsets(read_), "document_id").where((F.col("n") - F.col("page_no") - F.col("offset")).isin(0, 1)).select("record_id", F.lit("page_number").alias("noise"))
    return hyphen.unionByName(misread).unionByName(header).unionByName(page).distinct()


def paragraphs(records: DataFrame) -> DataFrame:
    """(source, document_id, paragraph_no, text): continuous paragraphs of every book, without furniture, cut words joined (compounds with their hyphen), misread words corrected.

    A record without end of sentence goes on in the next one that begins in lower case; line breaks inside a record that end a
    paragraph stay as line breaks. Records with null document go into one book without name.
    """
    read_ = cut_lineage(read_records(records, fitted_model(records), with_text=True))
    right = cut_lineage(misread_words(read_).where("right IS NOT NULL"))
    compounds = cut_lineage(_compounds(read_))
    used = read_.select("record_id", "source", "lang", F.explode(F.concat("words", "joined")).alias("word"))
    kept = small(cut_lineage(compounds.groupBy("lang", F.replace("compound", F.lit("-"), F.lit("")).alias("word")).agg(F.max_by("compound", F.struct("n", "compound")).alias("right"))))
    own_hyphen = read_.select("record_id", "source", "lang", F.explode("joined").alias("word")).join(kept, ["lang", "word"])
    fixes = used.join(small(right), ["lang", "word"]).unionByName(own_hyphen).groupBy("record_id", "source").agg(F.sort_array(F.collect_set(F.struct("word", "right"))).alias("fixes"))
    # A word cut at the end of a record keeps its hyphen where the two halves are known as a compound.
    ends = _with_next(read_.where("running <> ''")).where("tail IS NOT NULL AND next IS NOT NULL").select("record_id", "source", "lang", F.concat_ws("-", F.translate("tail", "‐", "-"), "next").alias("compound"))
    stays = ends.join(small(compounds.select("lang", "compound")), ["lang", "compound"], "left_semi").select("record_id", "source", F.lit(True).alias("stays"))
    at = ["record_id", "source"]
    fixed = read_.where("running <> ''").select(*at, "document_id", "ordinal", "running").join(fixes, at, "left").join(stays, at, "left").select("source", "document_id", "ordinal", "record_id", "running", "fixes", "stays")

    def make():
        def work(*columns):
            for *place, running, wrong, stays_ in zip(*columns):
                text = repaired(running, wrong) if wrong else running
                cut = _CUT.search(text)
                keep = cut.end(1) if cut and not stays_ else len(text)
                yield (*place, text[:keep], text[keep:], not cut and not _STOPPED.search(text), bool(cut), text[:1].islower())

        return work

    lines = map_batches(fixed, make, "source string, document_id string, ordinal int, record_id string, running string, mark string, open boolean, cut boolean, small boolean")
    lines = cut_lineage(lines.withColumn("row", F.monotonically_increasing_id()))
    keys, order = ["source", "document_id"], ["ordinal", "record_id"]
    # The texts take no part in the windows.
    placed = previous(lines.drop("running", "mark"), keys, order, F.struct("open", "cut"), "before")
    goes_on = F.coalesce(F.col("before.cut") | (F.col("before.open") & F.col("small")), F.lit(False))
    numbered = running_sum(placed, keys, order, F.when(goes_on, 0).otherwise(1), "paragraph_no").select("row", "paragraph_no")
    pieces = F.sort_array(F.collect_list(F.struct("ordinal", "record_id", "row", "running", "mark", F.when(F.col("cut"), "").otherwise(" ").alias("gap"))))
    whole = lines.join(numbered, "row").groupBy("source", "document_id", "paragraph_no").agg(pieces.alias("pieces"))
    last = F.size("pieces") - 1
    text = F.array_join(F.transform("pieces", lambda r, k: F.concat(r["running"], F.when(k == last, r["mark"]).otherwise(r["gap"]))), "")
    return whole.select("source", "document_id", "paragraph_no", text.alias("text"))
