"""Term candidates: n-grams with frequency, nesting, association, dispersion and context statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from folioquarry.functions.lexicon import ROMAN, STOP_WORDS
from folioquarry.functions.text import WORD, once
from folioquarry.session import small, spread

LONGEST, BINS = 5, 8
CHUNK = r"[^\p{L}\p{Nl}\p{No}’' \t\r\n-]+"


def is_content(token: Column, lang: Column) -> Column:
    """A token of two or more characters that is neither function word nor figure nor Roman numeral."""
    stop = F.coalesce(*[F.when(lang == k, token.isin(*words)) for k, words in STOP_WORDS.items()], F.lit(False))
    return (F.length(token) >= 2) & ~stop & ~token.rlike(r"^[0-9]+$") & ~token.rlike(ROMAN)


def chunks(segments: DataFrame) -> DataFrame:
    """(id, lang, chunk, tokens): runs of words that only white space divides, in lower case. ``segments``: id, lang, text and more."""
    cut = spread(segments.where(F.col("text") != "")).select("id", "document_id", "lang", "bin", F.posexplode(F.split(F.lower("text"), CHUNK)).alias("chunk", "piece"))
    return cut.select("id", "document_id", "lang", "bin", "chunk", once(F.regexp_extract_all("piece", F.lit(WORD), F.lit(0))).alias("tokens")).where(F.size("tokens") > 0)


def with_bins(segments: DataFrame) -> DataFrame:
    """``bin``: in which of BINS equal stretches of its book a segment stands."""
    last = small(segments.groupBy("document_id").agg(F.max("ordinal").alias("_last")))  # a row for each book
    return segments.join(last, "document_id").withColumn("bin", F.least(F.lit(BINS - 1), F.floor(F.col("ordinal") * BINS / (F.col("_last") + 1))).cast("int")).drop("_last")


def ngrams(chunked: DataFrame) -> DataFrame:
    """One row for each n-gram (1 to LONGEST) that begins and ends with content and has few function words inside, with its neighbours."""
    tokens = F.col("tokens")
    spans = F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(LONGEST), F.size(tokens))), lambda n: F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.struct(i.alias("i"), n.alias("n")))))
    flags = chunked.select("*", once(F.transform(tokens, lambda t: is_content(t, F.col("lang")))).alias("content"))
    fit = lambda s: (F.element_at("content", s["i"]) & F.element_at("content", s["i"] + s["n"] - 1)
                     & (F.size(F.filter(F.slice("content", s["i"], s["n"]), lambda c: ~c)) <= F.greatest(F.lit(1), F.floor((s["n"] - 1) / 2))))
    rows = flags.select("id", "document_id", "lang", "bin", "tokens", F.explode(F.filter(spans, fit)).alias("s"))
    word = lambda k: F.coalesce(F.when(k >= 1, F.try_element_at("tokens", k)), F.lit(""))
    return rows.select("id", "document_id", "lang", "bin", F.array_join(F.slice("tokens", F.col("s.i"), F.col("s.n")), " ").alias("key"), F.col("s.n").alias("n"),
                       F.concat_ws("|", word(F.col("s.i") - 1), word(F.col("s.i") + F.col("s.n"))).alias("context"))


def statistics(grams: DataFrame, least: int = 2) -> DataFrame:
    """(lang, key, n, frequency, segments, books, bins, contexts) of n-grams that occur ``least`` times."""
    per_segment = grams.groupBy("lang", "key", "n", "document_id", "bin", "id").agg(F.count(F.lit(1)).alias("c"))
    per_book = per_segment.groupBy("lang", "key", "n", "document_id").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("segments"), F.bit_or(F.expr("1 << bin")).alias("bins"))
    whole = per_book.groupBy("lang", "key", "n").agg(F.sum("c").alias("frequency"), F.sum("segments").alias("segments"), F.count(F.lit(1)).alias("books"), F.bit_count(F.bit_or("bins")).cast("bigint").alias("bins"))
    around = grams.groupBy("lang", "key", "n", "context").agg(F.count(F.lit(1)).alias("c")).groupBy("lang", "key", "n").agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("contexts"))
    return whole.where(F.col("frequency") >= least).join(around.where(F.col("c") >= least).drop("c"), ["lang", "key", "n"])


def c_values(stats: DataFrame) -> DataFrame:
    """``stats`` with ``c_value``: log2 of the length times the frequency less the mean frequency of the longer candidates around it."""
    words = F.split("key", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    nested = stats.where("n > 1").select("lang", F.explode(inner).alias("key"), "frequency").groupBy("lang", "key").agg(F.avg("frequency").alias("around"))
    return stats.join(nested, ["lang", "key"], "left").withColumn("c_value", F.greatest(F.lit(0.0), F.log2(F.greatest(F.lit(2), F.col("n") + 1)) * (F.col("frequency") - F.coalesce("around", F.lit(0.0))))).drop("around")


def associations(stats: DataFrame, unigrams: DataFrame) -> DataFrame:
    """``stats`` with ``association``: 0.35 for one word, else the frequency over the geometric mean of its words' frequencies, at most 1."""
    parts = stats.where("n > 1").select("lang", "key", "frequency", F.explode(F.split("key", " ")).alias("word"))
    mean = parts.join(unigrams, ["lang", "word"]).groupBy("lang", "key").agg(F.exp(F.avg(F.log("uses"))).alias("mean"))
    return stats.join(mean, ["lang", "key"], "left").withColumn("association", F.when(F.col("n") == 1, 0.35).otherwise(F.least(F.lit(1.0), F.col("frequency") / F.col("mean")))).drop("mean")


def word_uses(chunked: DataFrame) -> DataFrame:
    """(lang, word, uses) of all words."""
    return chunked.select("lang", F.explode("tokens").alias("word")).groupBy("lang", "word").agg(F.count(F.lit(1)).alias("uses"))


def scored(stats: DataFrame) -> DataFrame:
    """``stats`` (with c_value and association) with a score from 0 to 1 relative to the language's largest values."""
    top = Window.partitionBy("lang")
    ratio = lambda c: F.log2(F.col(c) + 1) / F.log2(F.max(c).over(top) + 1)
    spread = 0.65 * F.col("bins") / BINS + 0.35 * F.log2(F.least(F.lit(32), F.col("segments")) + 1) / F.log2(F.lit(33.0))
    specificity = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.length("key") / F.col("n") - 3) / 9))
    diversity = F.least(F.lit(1.0), F.col("contexts") / F.least(F.lit(16), F.greatest(F.lit(2), 2 * F.col("frequency"))))
    raw = (0.25 * F.greatest(ratio("c_value"), ratio("frequency") * F.when(F.col("n") == 1, 0.75).otherwise(0.35)) + 0.22 * ratio("frequency") + 0.17 * spread + 0.13 * F.col("association") + 0.12 * specificity + 0.06 * diversity + 0.05 * F.when(F.col("n") > 1, 1.0).otherwise(0.0))
    return stats.withColumn("score", F.round(raw, 6))


def without_nested(ranked: DataFrame) -> DataFrame:
    """Candidates but those that occur only inside one longer candidate (same frequency)."""
    words = F.split("key", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    inside = ranked.where("n > 1").select("lang", "frequency", F.explode(inner).alias("key")).distinct()
    return ranked.join(inside, ["lang", "key", "frequency"], "left_anti")


def han_ngrams(segments: DataFrame, least: int = 3) -> DataFrame:
    """(key, n, frequency, segments) of runs of 2 to 6 Han characters, those of the compatibility block and the first extension included."""
    runs = segments.where(F.col("text").rlike("[㐀-䶿一-鿿豈-﫿]{2}")).select("id", F.explode(F.regexp_extract_all("text", F.lit("[㐀-䶿一-鿿豈-﫿]+"), F.lit(0))).alias("run"))
    spans = F.flatten(F.transform(F.sequence(F.lit(2), F.least(F.lit(6), F.length("run"))), lambda n: F.transform(F.sequence(F.lit(1), F.length("run") - n + 1), lambda i: F.struct(F.substring("run", i, n).alias("key"), n.alias("n")))))
    return runs.where(F.length("run") >= 2).select("id", F.explode(spans).alias("s")).groupBy("s.key", "s.n").agg(F.count(F.lit(1)).alias("frequency"), F.count_distinct("id").alias("segments")).where(F.col("frequency") >= least)
