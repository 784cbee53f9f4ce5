"""One consistent form for texts that look the same but differ in their characters.

Method: the words that hold any unstable character are exploded into positioned code points; a broadcast join with
the decomposition and look-alike table maps each; combining marks are ordered by their class, recomposed, and words
and texts are put together again. Words and texts are taken once each, however often they occur. Texts made only of
stable characters are their own consistent form and skip all that.

Kept apart, as they differ in print: case, accents, punctuation, quotation marks, raised and lowered figures, circled
figures and fractions. Runs of spaces count as one space in comparisons.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import regex
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from folioquarry.session import cut_lineage

MEMBERS = 1000  # of a class of one look that one task pairs with the class

# Letters of other scripts, and of phonetic writing, that look like a Latin letter, by script.
LOOK_ALIKES = {a: b for letters, latin in (
    ("АВЕКМНОРСТУХЅІЈӀԌԚԜѴаеорсухѕіјһӏԁԛԝѵү", "ABEKMHOPCTYXSIJIGQWVaeopcyxsijhldqwvy"),  # Cyrillic
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹͿνοαριυγϲϳ", "ABEZHIKMNOPTYXCJvoapiuycj"),  # Greek
    ("ՕՏԼՍօսոցզհյ", "OSLUoungqhj"),  # Armenian
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZVSLCPKB"),  # Cherokee
    ("ⲂⲎⲒⲔⲘⲚⲞⲢⲤⲦⲬⲟⲣⲥ", "BHIKMNOPCTXopc"),  # Coptic
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓟꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴ", "BPDTGKJCZFMNLSRVHWXYAEIOU"),  # Lisu
    ("ɡɑ", "ga"),
) for a, b in zip(letters, latin, strict=True)}
# The scripts of these letters, as they stand in the names of characters.
SCRIPTS = ("GREEK", "CYRILLIC", "ARMENIAN", "CHEROKEE", "COPTIC", "LISU")
# Hyphens that look like the hyphen-minus.
HYPHENS = "‐‑﹣－"
# Compatibility tags of the Unicode database whose characters look like what they stand for.
SAME_LOOK = ("<wide>", "<narrow>", "<compat>", "<font>", "<small>", "<noBreak>", "<initial>", "<medial>", "<final>", "<isolated>")

WORD = r"\p{L}\p{M}\p{N}\p{Cf}"


def _is_space(ch: str) -> bool:
    return unicodedata.category(ch) == "Zs"


def _invisible(ch: str) -> bool:
    return unicodedata.category(ch) == "Cf" and ch not in "؀؁؂؃۝" or "︀" <= ch <= "️" or "\U000E0100" <= ch <= "\U000E01EF" or ch in "͏ᅟᅠ឴឵ㅤ"


def decompose(ch: str) -> str:
    """What ``ch`` is made of: canonical parts, compatibility forms of the same look, plain space and hyphen; '' if invisible."""
    if _is_space(ch):
        return " "
    if _invisible(ch):
        return ch if ch in "‌‍" else ""
    if ch in HYPHENS:
        return "-"
    tag, _, parts = unicodedata.decomposition(ch).rpartition("> ")
    if not parts or tag and tag + ">" not in SAME_LOOK or tag and parts.startswith("0020 "):
        return ch
    whole = "".join(decompose(chr(int(x, 16))) for x in parts.split())
    return unicodedata.normalize("NFC", whole) if any("\u1100" <= c <= "\u11FF" for c in whole) else whole


@cache
def code_points() -> tuple[tuple[str, str, str, bool, list[int]], ...]:
    """(character, parts, parts with look-alikes replaced, whether it keeps its word in its own script, combining class of each part).

    Left out are characters of class 0 that stand for themselves. Look-alikes are told after decomposition, so that an accented one
    is found too. A letter of ``SCRIPTS`` without look-alike shows that its word is written in that script.
    """
    rows = []
    for n in (*range(0x80, 0x30000), *range(0xE0000, 0xE0200)):
        ch = chr(n)
        if 0xAC00 <= n <= 0xD7A3 or 0xD800 <= n <= 0xDFFF or unicodedata.category(ch) in ("Cn", "Co"):
            continue
        parts = decompose(ch)
        looks = "".join(LOOK_ALIKES.get(c, c) for c in parts)
        foreign = any(c not in LOOK_ALIKES and c.isalpha() and unicodedata.name(c, "").startswith(SCRIPTS) for c in parts)
        if parts != ch or looks != ch or foreign or unicodedata.combining(ch) or ch in "‌‍":
            rows.append((ch, parts, looks, foreign, [unicodedata.combining(c) for c in parts]))
    return tuple(rows)


@cache
def compositions() -> dict[str, str]:
    """Pairs of characters and what they recompose to, but for Hangul syllables."""
    out = {}
    for n in range(0xC0, 0x1D200):
        d = unicodedata.decomposition(chr(n))
        if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(n)) == chr(n):
            out["".join(chr(int(x, 16)) for x in d.split())] = chr(n)
    return out


@cache
def stable() -> tuple[str, str, str]:
    """Bodies of regex classes: characters that stand for themselves in every context; letters and figures, the others, and both."""
    mapped = {r[0]: r for r in code_points()}

    def plain(n: int) -> bool:
        ch = chr(n)
        if n < 0x20 or 0x1100 <= n < 0x1200:
            return n in (9, 10, 13)
        composed = ch in mapped and unicodedata.normalize("NFC", ch) == ch and unicodedata.decomposition(ch)[:1] not in ("<", "") and mapped[ch][1] == mapped[ch][2]
        return (ch not in mapped or composed) and unicodedata.category(ch)[0] not in "MC"

    words, others, both = [], [], []
    # The blocks in common use; any other character only makes its text take the longer way.
    for a, b in ((0x09, 0x17F), (0x2010, 0x2027), (0x3001, 0x30FE), (0x4E00, 0x9FFF), (0xAC00, 0xD7A3)):
        for n in range(a, b + 1):
            if plain(n):
                for to in (words if unicodedata.category(chr(n))[0] in "LN" else others, both):
                    if to and to[-1][1] == n - 1:
                        to[-1][1] = n
                    else:
                        to.append([n, n])
    # A regex class tries its ranges one by one, so short ranges beyond ASCII are left out, but for marks of common use.
    body = lambda runs: "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs if b < 0x80 or b - a > 6 or any(a <= ord(c) <= b for c in "«»§¿¡–—"))
    return body(words), body(others), body(both)


def table(spark: SparkSession) -> DataFrame:
    """The fixed table of mapped characters (under 8,000 rows at any size of data, so it may be broadcast)."""
    return spark.createDataFrame(list(code_points()), "ch string, parts string, looks string, foreign boolean, classes array<int>")


def is_stable(text: Column) -> Column:
    return (F.octet_length(text) == F.char_length(text)) | ~text.rlike(f"[^{stable()[2]}]")


def pieces(text: Column) -> Column:
    """``text`` cut into stretches of stable words, single words, and what stands between words."""
    words, others, _ = stable()
    cut = rf"(?:[{words}]*+[{others}](?!\p{{M}}))++|[{WORD}]++|(?:[^{WORD}]\p{{M}}*+)++"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def _syllable(a: Column, b: Column) -> Column:
    """The Hangul syllable of a leading consonant and a vowel, or of such a syllable and a trailing consonant; else null."""
    open_ = (F.ascii(a) - 0x1100) * 588 + (F.ascii(b) - 0x1161) * 28 + 0xAC00
    closed = F.ascii(a) + F.ascii(b) - 0x11A7
    code = (F.when(b.between("\u1161", "\u1175") & a.between("\u1100", "\u1112"), open_)
            .when(b.between("\u11A8", "\u11C2") & a.between("\uAC00", "\uD7A3") & ((F.ascii(a) - 0xAC00) % 28 == 0), closed))
    return F.decode(F.unhex(F.hex(code)), "UTF-16BE")


def _consistent_pieces(distinct: DataFrame) -> DataFrame:
    """piece -> form, for distinct pieces: explode, map, order marks, recompose, rebuild."""
    spark = distinct.sparkSession
    points = distinct.select("piece", F.posexplode(F.regexp_extract_all("piece", F.lit("(?s)."), F.lit(0))).alias("pos", "ch"))
    chars = lambda c: F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0))
    mapped = points.join(F.broadcast(table(spark)), "ch", "left").select(
        "piece", "pos", F.coalesce("foreign", F.lit(False)).alias("foreign"),
        F.posexplode_outer(F.when(F.col("parts").isNull(), F.array(F.struct(F.col("ch").alias("c"), F.lit(0).alias("ccc"), F.col("ch").alias("look"))))
                           .otherwise(F.arrays_zip(chars("parts").alias("c"), F.col("classes").alias("ccc"), chars("looks").alias("look")))).alias("sub", "p"),
    )
    points_of = F.sort_array(F.collect_list(F.when(F.col("p").isNotNull(), F.struct("pos", "sub", F.col("p.c").alias("c"), F.col("p.ccc").alias("ccc"), F.col("p.look").alias("look")))))
    words = mapped.groupBy("piece").agg(points_of.alias("points"), F.bool_or("foreign").alias("foreign"))
    # Number the clusters (a class-0 character with its marks), then order within each by class, ties by place.
    numbered = F.aggregate("points", F.struct(F.lit(0).alias("n"), F.expr("CAST(array() AS array<struct<n:int,ccc:int,at:int,c:string>>)").alias("out")), lambda a, p: F.struct(
        (a["n"] + F.when(p["ccc"] == 0, 1).otherwise(0)).alias("n"),
        F.concat(a["out"], F.array(F.struct((a["n"] + F.when(p["ccc"] == 0, 1).otherwise(0)).alias("n"), p["ccc"].alias("ccc"), F.size(a["out"]).alias("at"), F.when(F.col("foreign"), p["c"]).otherwise(p["look"]).alias("c")))).alias("out")))
    ordered = words.select("piece", F.sort_array(numbered["out"]).alias("points"))
    pairs = F.str_to_map(F.lit(",".join(f"{k}:{v}" for k, v in compositions().items())), F.lit(","), F.lit(":"))
    empty = F.struct(F.lit("").alias("done"), F.lit("").alias("starter"), F.lit("").alias("marks"), F.lit(0).alias("last"))

    # Only marks and a few others ever join what stands before them, so that other characters aren't looked up.
    seconds = F.lit("".join(sorted({k[1:] for k in compositions() if not unicodedata.combining(k[1:])})))

    def recompose(a: Column, p: Column) -> Column:
        whole = F.coalesce(_syllable(a["starter"], p["c"]), F.when((p["ccc"] > 0) | F.contains(seconds, p["c"]), F.try_element_at(pairs, F.concat(a["starter"], p["c"]))))
        joiner = p["c"].isin("‌", "‍")
        free = F.when(p["ccc"] == 0, a["marks"] == "").otherwise(a["last"] < p["ccc"])
        return (F.when(joiner & (a["last"] != 9), a)  # a joiner shows only after a virama (class 9)
                .when(free & whole.isNotNull(), F.struct(a["done"].alias("done"), whole.alias("starter"), a["marks"].alias("marks"), a["last"].alias("last")))
                .when(p["ccc"] == 0, F.struct(F.concat(a["done"], a["starter"], a["marks"]).alias("done"), p["c"].alias("starter"), F.lit("").alias("marks"), F.lit(0).alias("last")))
                .otherwise(F.struct(a["done"].alias("done"), a["starter"].alias("starter"), F.concat(a["marks"], p["c"]).alias("marks"), p["ccc"].alias("last"))))

    return ordered.select("piece", F.aggregate("points", empty, recompose, lambda a: F.concat(a["done"], a["starter"], a["marks"])).alias("form"))


def consistent_forms(texts: DataFrame, column: str) -> DataFrame:
    """(_fq_key, _fq_form) of every distinct unstable text of ``column``; the key is md5 of the text.

    Null texts give no row. A text of stable characters only gives no row either: it is its own form.
    """
    text = F.col(column)
    cut = (texts.where(text.isNotNull() & ~is_stable(text)).select(text.alias("t")).distinct()
           .select(F.md5("t").alias("_fq_key"), "t")  # before the pieces, else the text would be hashed once for each of them
           .select("_fq_key", F.posexplode(pieces(F.col("t"))).alias("pos", "piece")))
    odd = cut.where(~is_stable(F.col("piece"))).select("piece").distinct()
    joined = cut.join(_consistent_pieces(odd), "piece", "left").select("_fq_key", F.struct("pos", F.coalesce("form", "piece").alias("form")).alias("p"))
    return joined.groupBy("_fq_key").agg(F.array_join(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["form"]), "").alias("_fq_form"))


def with_consistent_text(df: DataFrame, column: str, out: str = "consistent_text") -> DataFrame:
    """``df`` with ``out``: the consistent form of ``column``.

    Null stays null and '' stays ''; repeated rows stay repeated; an existing column named ``out`` is replaced.
    """
    df = df.drop(out) if out != column else df
    forms = consistent_forms(df, column)
    keyed = df.withColumn("_fq_key", F.when(~is_stable(F.col(column)), F.md5(column)))
    return keyed.join(forms, "_fq_key", "left").withColumn(out, F.coalesce("_fq_form", column)).drop("_fq_key", "_fq_form")


def _looks(df: DataFrame, record: str, scope: list[str], column: str) -> tuple[DataFrame, list[str]]:
    """(id, scope columns, look, raw) of the distinct records that look like a record of other characters, and the names of scope and look.

    ``look`` and ``raw`` are md5 of the common look and of the text. Only unstable texts look for partners: two stable texts of
    one look are equal. A stable text is its own look and its raw key is the key of its look.
    """
    rows = df.where(F.col(record).isNotNull() & F.col(column).isNotNull()).select(F.col(record).alias("id"), *[F.col(c).alias(f"s{n}") for n, c in enumerate(scope)], F.col(column).alias("t"))
    unstable = ~is_stable(F.col("t")) | F.col("t").rlike(r"\s\s|^\s|\s$|[\t\r\n]")
    keyed = rows.withColumn("unstable", unstable).withColumn("_fq_key", F.md5("t"))
    look = F.trim(F.regexp_replace(F.coalesce("_fq_form", "t"), r"\s+", " "))
    keys = [f"s{n}" for n in range(len(scope))] + ["look"]
    odd = keyed.where("unstable").join(consistent_forms(keyed.where("unstable"), "t"), "_fq_key", "left").withColumn("look", look).where("look <> ''")
    odd = cut_lineage(odd.select("id", *keys[:-1], F.md5("look").alias("look"), F.col("_fq_key").alias("raw")).distinct())
    even = keyed.where("NOT unstable").select("id", *keys[:-1], F.col("_fq_key").alias("look"), F.col("_fq_key").alias("raw"))
    near = even.join(odd.select(*keys).distinct(), keys, "left_semi").distinct()
    return odd.unionByName(near), keys


def look_alike_classes(df: DataFrame, record: str, scope: list[str], column: str) -> DataFrame:
    """(id, scope columns, look, raw, class_id, members, links): records of each look that is written in more than one way.

    ``class_id`` is the least id of the look in its scope, ``links`` the number of members made of other characters. Rows with a
    null id, scope or text, and texts of white space or invisible characters only, are in no class. Repeated rows count once.
    """
    looks, keys = _looks(df, record, scope, column)
    written = looks.groupBy(*keys, "raw").agg(F.count(F.lit(1)).alias("same"), F.min("id").alias("least"))
    whole = written.groupBy(*keys).agg(F.sum("same").alias("members"), F.count(F.lit(1)).alias("ways"), F.min("least").alias("class_id")).where("ways > 1").drop("ways")
    return looks.join(whole, keys).join(written.drop("least"), [*keys, "raw"]).select("id", *keys, "raw", "class_id", "members", (F.col("members") - F.col("same")).alias("links"))


def look_alike_pairs(df: DataFrame, record: str, scope: list[str], column: str) -> DataFrame:
    """(id_a, id_b), id_a < id_b: records of one scope whose texts look the same but aren't made of the same characters.

    The pairs come from the classes of ``look_alike_classes``; a large class is dealt to as many tasks as its size needs.
    """
    classes = cut_lineage(look_alike_classes(df, record, scope, column))
    keys = [f"s{n}" for n in range(len(scope))] + ["look"]
    parts = F.ceil(F.col("members") / MEMBERS).cast("int")
    a = classes.select(*keys, F.col("id").alias("a"), F.col("raw").alias("raw_a"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    b = classes.select(*keys, F.col("id").alias("b"), F.col("raw").alias("raw_b"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    pairs = a.join(b, [*keys, "part"]).where(F.col("raw_a") < F.col("raw_b"))
    return pairs.select(F.least("a", "b").alias("id_a"), F.greatest("a", "b").alias("id_b")).distinct()


@cache
def _python_tables() -> tuple[dict[int, str], dict[int, str], frozenset[str], frozenset[str]]:
    """For str.translate: parts, and parts with look-alikes replaced, without what composition only puts back; what keeps a word in its script; all that is mapped."""
    rows = [r for r in code_points() if r[0] not in "‌‍"]
    parts, looks = ({ord(r[0]): r[k] for r in rows if unicodedata.normalize("NFC", r[k]) != r[0]} for k in (1, 2))
    return parts, looks, frozenset(r[0] for r in rows if r[3]), frozenset(map(chr, looks))


@cache
def _settled() -> dict[str, str]:
    """Mapped characters, with look-alikes replaced, whose parts aren't mapped again: they may be replaced one after the other."""
    _, looks, _, mapped = _python_tables()
    return {chr(n): to for n, to in looks.items() if mapped.isdisjoint(to)}


_JOINERS = re.compile("[‌‍]+")
_WORDS = regex.compile(rf"[{WORD}]+")


def consistent(text: str) -> str:
    """The same form in plain Python, for texts already in an Arrow function (and to test the operator against)."""
    if text.isascii():
        return text
    parts, looks, foreign, mapped = _python_tables()
    if "\u200c" in text or "\u200d" in text:
        text = _JOINERS.sub(lambda j: j[0] if j.start() and unicodedata.combining(text[j.start() - 1]) == 9 else "", text)
    chars = set(text)
    if not foreign.isdisjoint(chars):
        text = _WORDS.sub(lambda m: m[0].translate(looks if foreign.isdisjoint(m[0]) else parts), text).translate(parts)
    elif len(chars := mapped & chars) <= 8 and chars <= _settled().keys():  # a few kinds, as of wide punctuation: faster than telling each character
        for ch in chars:
            text = text.replace(ch, _settled()[ch])
    else:
        text = text.translate(looks)
    return unicodedata.normalize("NFC", text)
