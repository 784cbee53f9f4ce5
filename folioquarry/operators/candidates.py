"""Term candidates of a corpus, stage by stage: recall, families, nesting, association, features, gates, lanes, quotas, evidence.

A frame of segments has id, scope, profile, document_id, ordinal, heading, text, translated and bin: scope is what statistics are
relative to (a language, a project), profile the language whose rules hold ('cjk' for Han characters), bin the eighth of the book.
Counts are of all occurrences; only the quotations kept as evidence are a sample of fixed size, and it is a stated feature.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from folioquarry.functions import glossary as G, recall as R
from folioquarry.functions.arrow import map_batches
from folioquarry.functions.lexicon import STOP_WORDS
from folioquarry.operators import ordered
from folioquarry.session import cut_lineage, small, spread

BINS, RESERVOIR, EVIDENCE, MARGIN = 8, 32, 6, 100
LEAST_SCORE, LEAST_BUDGET, MOST_BUDGET = 0.12, 25, 70
LANES = ("coordination_phrase", "lexical_risk", "salient_phrase", "derived_unigram", "core_unigram", "phrase", "named_entity")  # in the order of a tie
# Shares of the budget by lane.
SHARES = {"core_unigram": 0.25, "derived_unigram": 0.30, "phrase": 0.17, "salient_phrase": 0.15, "coordination_phrase": 0.03, "lexical_risk": 0.05, "named_entity": 0.05}
GERMAN_SHARES = {"core_unigram": 0.40, "derived_unigram": 0.30, "phrase": 0.05, "salient_phrase": 0.15, "coordination_phrase": 0.05, "lexical_risk": 0.05, "named_entity": 0.0}
# At most this share of the budget for a lane when what is left is filled up.
CAPS = {"named_entity": 0.20, "salient_phrase": 0.20, "coordination_phrase": 0.08, "lexical_risk": 0.08}
_LEXEME = ["scope", "family"]
_ROWS = """scope string, profile string, family string, tokens string, key string, id string, document_id string, ordinal int, bin int, c int, methods int, caps boolean, capital int, translated boolean,
starts array<int>, values array<string>, lefts array<string>, rights array<string>"""


def profile(lang: Column) -> Column:
    """The language whose rules hold for texts in ``lang``: 'cjk' for zh, ja and ko, its own where there are word lists, else those of English."""
    code = F.split_part(F.lower(F.translate(lang, "_", "-")), F.lit("-"), F.lit(1))
    return F.when(code.isin("zh", "ja", "ko"), "cjk").when(code.isin(*STOP_WORDS), code).otherwise("en")


def is_boilerplate(heading: Column, text: Column) -> Column:
    """Imprint and contents: two hits of their wordings in heading and text, or one in a text of less than 240 characters."""
    hits = F.size(F.regexp_extract_all(F.concat(F.coalesce(heading, F.lit("")), F.lit("\n"), text), F.lit("(?iu)" + G.BOILERPLATE), F.lit(0)))
    return (hits >= 2) | ((hits == 1) & (F.length(text) < 240))


def recalled(segments: DataFrame) -> DataFrame:
    """One row for each segment and lexeme in it (``_ROWS``): how often, by which signs, in which forms, between which words, and where.

    Null and empty texts and boilerplate give no rows; repeated segments count twice.
    """
    def make():
        def work(ids, scopes, profiles, documents, ordinals, bins, headings, texts, translated):
            for i, scope, lang, doc, ordinal, b, heading, text, done in zip(ids, scopes, profiles, documents, ordinals, bins, headings, texts, translated):
                lexemes: dict[str, list[R.Found]] = {}
                for key, found in R.recalled(text, lang, bool(heading)):
                    lexemes.setdefault(key, []).append(found)
                for key, found in lexemes.items():
                    values = [text[f.start : f.end] for f in found]
                    methods = 0
                    for f in found:
                        methods |= f.methods
                    capital = sum(any(w[:1].isupper() for w in R._WORD.findall(v)) for v in values)
                    family = " ".join(G.stem(t, lang) for t in found[0].tokens) if lang != "cjk" else key
                    yield (scope, lang, family, " ".join(found[0].tokens), key, i, doc, ordinal, b, len(found), methods, all(v == v.upper() for v in values), capital, done,
                           [f.start for f in found], values, [f.left for f in found if f.left], [f.right for f in found if f.right])

        return work

    rows = segments.where((F.col("text") != "") & ~is_boilerplate(F.col("heading_path"), F.col("text")))
    return map_batches(spread(rows).select("id", "scope", "profile", "document_id", "ordinal", "bin", "heading", "text", "translated"), make, _ROWS, chunk=128)


def has(method: str, *more: str) -> Column:
    """Whether any of the signs is among ``methods``."""
    return F.col("methods").bitwiseAND(F.lit(sum(R.BIT[m] for m in (method, *more)))) != 0


def families(rows: DataFrame) -> DataFrame:
    """(scope, family, profile, key, tokens, n, keys, frequency, segments, bins, methods, capital_ratio, translated): lexemes whose words have the same stems, as one.

    The key is that of the form nearest to the stems, then the shortest, the most frequent, the first by name. The sign of an acronym
    falls if the key is a Roman numeral or any of its forms isn't all capitals.
    """
    mask = lambda m: F.lit(~R.BIT[m])
    keys = rows.groupBy(*_LEXEME, "profile", "key").agg(F.min("tokens").alias("tokens"), F.sum("c").alias("c"), F.bit_or("methods").alias("methods"), F.bool_and("caps").alias("caps"), F.sum("capital").alias("capital"))
    cleaned = keys.withColumn("methods", F.when(F.col("caps") & ~F.col("key").rlike("^[ivxlcdm]+$"), F.col("methods")).otherwise(F.col("methods").bitwiseAND(mask("acronym"))))
    letters = F.length(F.translate("tokens", " ", ""))
    per_key = cleaned.groupBy(*_LEXEME).agg(F.first("profile").alias("profile"), F.min_by(F.struct("key", "tokens"), F.struct(F.col("tokens") != F.col("family"), letters, -F.col("c"), "key")).alias("r"), F.count(F.lit(1)).alias("keys"),
                                            F.sum("c").alias("frequency"), F.bit_or("methods").alias("methods"), F.sum("capital").alias("capital"))
    per_segment = rows.groupBy(*_LEXEME, "id").agg(F.bit_or(F.expr("1 << bin")).alias("bins"), F.bool_or("translated").alias("t"))
    spread_ = per_segment.groupBy(*_LEXEME).agg(F.count(F.lit(1)).alias("segments"), F.bit_count(F.bit_or("bins")).alias("bins"), F.least(F.lit(3), F.count_if("t")).alias("translated"))
    merged = F.col("keys") > 1
    tokens = F.when(merged, F.col("family")).otherwise(F.col("r.tokens"))
    return per_key.join(spread_, _LEXEME).select(
        *_LEXEME, "profile", F.col("r.key").alias("key"), tokens.alias("tokens"), F.size(F.split(tokens, " ")).alias("n"), "keys", "frequency", "segments", "bins",
        F.when(merged, F.col("methods").bitwiseOR(F.lit(R.BIT["morphological_family"]))).otherwise(F.col("methods")).alias("methods"), (F.col("capital") / F.col("frequency")).alias("capital_ratio"), "translated")


def nested(lexemes: DataFrame) -> DataFrame:
    """``lexemes`` with ``c_raw``: log2 of the length times the frequency less the mean frequency of the longer lexemes around; each place in a longer one counts."""
    words = F.split("tokens", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(1), F.col("n") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("n") - m + 1), lambda i: F.array_join(F.slice(words, i, m), " "))))
    around = lexemes.where("n > 1").select("scope", F.explode(inner).alias("tokens"), "frequency").groupBy("scope", "tokens").agg(F.avg("frequency").alias("around"))
    return lexemes.join(around, ["scope", "tokens"], "left").withColumn("c_raw", F.greatest(F.lit(0.0), F.log2(F.greatest(F.lit(2), F.col("n") + 1)) * (F.col("frequency") - F.coalesce("around", F.lit(0.0))))).drop("around")


def associated(lexemes: DataFrame, of: DataFrame) -> DataFrame:
    """``lexemes`` with ``association``: 0.35 for one word, else frequency over the geometric mean of the frequencies of its words among ``of``, at most 1, 0 if none is there."""
    single = of.where("n = 1").groupBy("scope", F.col("tokens").alias("word")).agg(F.max("frequency").alias("uses"))
    parts = lexemes.where("n > 1").select(*_LEXEME, F.explode(F.split("tokens", " ")).alias("word")).join(single, ["scope", "word"])
    mean = parts.groupBy(*_LEXEME).agg(F.exp(F.avg(F.log("uses"))).alias("mean"))
    return lexemes.join(mean, _LEXEME, "left").withColumn("association", F.when(F.col("n") == 1, 0.35).otherwise(F.coalesce(F.least(F.lit(1.0), F.col("frequency") / F.greatest(F.lit(1.0), "mean")), F.lit(0.0)))).drop("mean")


def possible(lexemes: DataFrame) -> DataFrame:
    """Lexemes that the gate can let through: recurring, or with a sign that needs no recurrence."""
    return lexemes.where((F.col("frequency") >= 2) | has("definition_cue", "quoted", "heading", "coordination_phrase") | ((F.col("profile") == "de") & has("proper_name")))


def described(lexemes: DataFrame, rows: DataFrame) -> DataFrame:
    """``lexemes`` with their commonest form, all forms, variety of contexts and how often a determiner stands before them."""
    own = rows.join(small(cut_lineage(lexemes.select(*_LEXEME))), _LEXEME, "left_semi")
    forms = own.select(*_LEXEME, "document_id", "ordinal", F.explode(F.arrays_zip("starts", "values")).alias("f")).groupBy(*_LEXEME, F.col("f.values").alias("form")).agg(F.count(F.lit(1)).alias("count"), F.min(F.struct("document_id", "ordinal", "f.starts")).alias("first"))
    words = F.size(F.regexp_extract_all("form", F.lit(r"\p{L}+(?:[-’']\p{L}+)*"), F.lit(0)))
    best = forms.groupBy(*_LEXEME).agg(
        F.transform(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("less"), "first", "form"))), lambda f: f["form"]).alias("forms"),
        F.min_by("form", F.struct(words, F.length("form"), -F.col("count"), F.lower("form"))).alias("shortest"))
    contexts = own.select(*_LEXEME, "profile", F.explode(F.concat(F.transform("lefts", lambda c: F.struct(c.alias("c"), F.lit(True).alias("left"))), F.transform("rights", lambda c: F.struct(c.alias("c"), F.lit(False).alias("left"))))).alias("x"))
    determiner = F.coalesce(*[F.when(F.col("profile") == k, F.col("x.c").isin(*v)) for k, v in G.DETERMINERS.items()], F.lit(False))
    counted = contexts.groupBy(*_LEXEME, "x.c").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x.left") & determiner).alias("d"))
    around = counted.groupBy(*_LEXEME).agg(F.count(F.lit(1)).alias("contexts"), F.sum("n").alias("context_count"), F.sum("d").alias("determined"))
    out = lexemes.join(best, _LEXEME).join(around, _LEXEME, "left").fillna(0, ["contexts", "context_count", "determined"])
    return out.withColumn("form", F.when(has("morphological_family"), F.col("shortest")).otherwise(F.element_at("forms", 1))).drop("shortest")


@F.pandas_udf(T.BooleanType())
def _noun_ending(tokens: pd.Series, lang: pd.Series) -> pd.Series:
    return pd.Series([G.has_noun_ending(t.split(" "), k) for t, k in zip(tokens, lang)], dtype=bool)


def featured(lexemes: DataFrame, totals: DataFrame) -> DataFrame:
    """``lexemes`` with their features and score. ``totals``: scope, segments_total."""
    tops = lexemes.groupBy("scope").agg(F.max("c_raw").alias("c_top"), F.max("frequency").alias("f_top"))
    q = lexemes.join(F.broadcast(tops.join(totals, "scope")), "scope")  # a row for each scope, as many as there are languages
    one = lambda c, x: F.when(c, x).otherwise(0.0)
    log = lambda c: F.log2(F.lit(1.0) + c)
    frequency = log(F.col("frequency")) / log(F.col("f_top"))
    letters = F.length(F.regexp_replace("tokens", "[- ]", ""))
    q = (q.withColumn("f_frequency", frequency)
         .withColumn("c_value", F.greatest(F.col("c_raw") / F.when(F.col("c_top") > 0, F.col("c_top")).otherwise(1.0), F.col("f_frequency") * F.when(F.col("n") == 1, 0.75).otherwise(0.35)))
         .withColumn("explicit", F.greatest(one(has("definition_cue"), 1.0), one(has("heading"), 0.8), one(has("quoted"), 0.65)))
         .withColumn("dispersion", F.least(F.lit(1.0), 0.65 * F.col("bins") / BINS + 0.35 * log(F.col("segments")) / log(F.least(F.lit(32), F.greatest(F.lit(1), "segments_total")))))
         .withColumn("boundary", F.when(has("quoted", "heading", "definition_cue"), 1.0).when(has("proper_name"), 0.95).when(has("phrase") & (F.col("frequency") >= 2), 0.85).when(has("hyphenated", "acronym"), 0.8).otherwise(0.65))
         .withColumn("multiword", F.least(F.lit(1.0), F.when(has("cjk_ngram"), F.greatest(F.lit(0), F.length("key") - 2)).otherwise(F.col("n") - 1) / 3))
         .withColumn("specificity", F.least(F.lit(1.0), F.greatest(F.lit(0.0), (letters / F.col("n") - 3) / 9)))
         .withColumn("context_diversity", one(F.col("context_count") > 1, F.least(F.lit(1.0), F.col("contexts") / F.least(F.lit(16), F.greatest(F.lit(2), F.col("frequency") * 2)))))
         .withColumn("orthographic", one(F.col("profile") == "de", F.col("capital_ratio")))
         .withColumn("derivational", one(_noun_ending("tokens", "profile"), 1.0))
         .withColumn("compactness", F.when(F.col("n") <= 3, 1.0).when(F.col("n") == 4, 0.75).otherwise(0.5)))
    q = (q.withColumn("nominal", F.greatest("derivational", one(has("noun_phrase"), 0.85), "orthographic", F.least(F.lit(1.0), 1.5 * F.col("determined") / F.col("frequency"))))
         .withColumn("phrase_structure", F.least(F.lit(1.0), 0.8 * F.when(has("coordination_phrase"), 1.0).when(has("connector_phrase"), 0.95).when(has("noun_phrase"), 0.85).when(has("proper_name"), 0.8).when(has("phrase") & (F.col("frequency") >= 2), 0.6).otherwise(0.25) + 0.2 * F.col("compactness")))
         .withColumn("type", _type()))
    raw = (0.17 * F.col("c_value") + 0.14 * F.col("f_frequency") + 0.10 * F.col("dispersion") + 0.10 * F.col("explicit") + 0.06 * F.col("boundary") + 0.08 * F.col("association") + 0.05 * F.col("multiword") + 0.07 * F.col("specificity")
           + 0.04 * F.col("context_diversity") + 0.06 * F.col("orthographic") + 0.07 * F.col("nominal") + 0.04 * F.col("phrase_structure") + 0.02 * F.col("translated") / 3 - one(F.col("type") == "named_entity", 0.03))
    return q.withColumn("score", F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))).drop("c_top", "f_top")


def _type() -> Column:
    german = (F.col("profile") == "de") & has("proper_name") & (F.size(F.split(F.element_at("forms", 1), r"\s+")) > 1) & ~F.element_at("forms", 1).rlike(r"(?:^|[^\p{L}’'-])\p{Ll}")
    other = (F.col("profile") != "de") & has("proper_name", "capitalized_token") & (F.col("capital_ratio") >= 0.65)
    return F.when(german | other, "named_entity").when(has("hyphenated", "acronym"), "lexical_risk").otherwise("concept")


def eligible() -> Column:
    """The linguistic gate: what a lexeme of its type must show."""
    explicit, often, german = has("definition_cue", "quoted", "heading"), F.col("frequency") >= 2, F.col("profile") == "de"
    return (F.when(F.col("type") == "named_entity", often | explicit).when(explicit | has("coordination_phrase") | (german & has("proper_name")), True).when(has("cjk_ngram"), often)
            .when(F.col("n") > 1, often & (F.col("association") >= 0.04) & (F.col("phrase_structure") >= 0.4)).when(has("hyphenated", "acronym"), often)
            .when(german & (F.col("capital_ratio") < 0.6) & (F.col("derivational") == 0), False).otherwise(often & (F.length("key") >= 4)))


def lane() -> Column:
    """The lane in which a lexeme competes."""
    salient = (F.col("n") > 1) & (has("definition_cue", "quoted", "heading", "rhetorical_boundary") | (has("connector_phrase") & (F.col("derivational") > 0)))
    return (F.when(F.col("type").isin("named_entity", "lexical_risk"), F.col("type")).when(has("coordination_phrase"), "coordination_phrase").when(salient, "salient_phrase")
            .when(has("cjk_ngram"), F.when(F.length("key") >= 3, "phrase").otherwise("core_unigram")).when(F.col("n") > 1, "phrase").when(F.col("derivational") > 0, "derived_unigram").otherwise("core_unigram"))


def precise() -> Column:
    """The precision gate: recurrence, spread and termhood by kind of lexeme; a definition needs none of them."""
    f, s, n = F.col("frequency"), F.col("segments"), F.col("n")
    generic = lambda w: F.coalesce(*[F.when(F.col("profile") == k, w.isin(*v)) for k, v in G.GENERIC.items()], F.lit(False))
    content = F.coalesce(*[F.when(F.col("profile") == k, F.array_except(F.split("tokens", " "), F.array(*map(F.lit, sorted(v))))) for k, v in G.CONNECTORS.items()], F.split("tokens", " "))
    association, specific, varied, derived = F.col("association"), F.col("specificity"), F.col("context_diversity"), F.col("derivational") > 0
    quoted = has("quoted") & (n <= 3) & ((f >= 2) | ((specific >= 0.3) & ~has("proper_name")))
    once = has("rhetorical_boundary") & derived & association.between(0.08, 0.25) & (specific >= 0.4)
    phrase = (F.when(n > 3, False).when(has("coordination_phrase"), (f >= 2) & (s >= 2) & (association >= 0.08))
              .when(has("connector_phrase"), F.when(f >= 2, (s >= 2) & (association >= 0.08) & (derived | (specific >= 0.35))).otherwise(once))
              .otherwise((f >= 3) & (s >= 2) & has("noun_phrase") & (association >= 0.08) & (F.col("phrase_structure") >= 0.6)))
    german = (F.col("profile") == "de") & (~F.col("form").rlike(r"^\p{Lu}") | (F.col("capital_ratio") < 0.75))
    word = (F.when(generic(F.col("key")) | german, False).when(derived, (f >= 3) & (s >= 2) & (specific >= 0.35) & (varied >= 0.45)).otherwise((f >= 5) & (s >= 3) & (varied >= 0.5) & ((f >= 12) | (specific >= 0.3))))
    return (F.when(~has("definition_cue") & (n > 1) & F.coalesce(generic(F.try_element_at(content, F.lit(-1))), F.lit(False)), False).when(has("definition_cue") | quoted, True).when(F.col("type") == "named_entity", (f >= 8) & (s >= 3))
            .when(F.col("type") == "lexical_risk", has("acronym") | ((f >= 3) & (s >= 2) & (varied >= 0.45))).when(F.col("profile") == "cjk", (F.length("key") >= 3) & (f >= 3) & (s >= 2)).when(n > 1, phrase).otherwise(word))


def lane_score() -> Column:
    """How a lexeme ranks in its lane."""
    total = lambda **w: sum((F.col(k) * v for k, v in w.items()), F.lit(0.0))
    marker = F.greatest(*[F.when(c, v).otherwise(0.0) for c, v in ((has("definition_cue"), 1.0), (has("quoted"), 0.9), (has("heading"), 0.85), (has("coordination_phrase"), 0.82), (has("rhetorical_boundary") & has("connector_phrase"), 0.78),
                                                                   (has("rhetorical_boundary"), 0.7), (has("connector_phrase") & (F.col("derivational") > 0), 0.65))])
    by_lane = {
        "core_unigram": total(f_frequency=0.28, dispersion=0.16, nominal=0.22, orthographic=0.14, context_diversity=0.12, specificity=0.08),
        "derived_unigram": total(derivational=0.35, f_frequency=0.22, dispersion=0.15, specificity=0.13, context_diversity=0.10, orthographic=0.05),
        "phrase": total(phrase_structure=0.25, association=0.20, c_value=0.18, f_frequency=0.12, specificity=0.10, compactness=0.08, dispersion=0.07),
        "lexical_risk": total(f_frequency=0.40, dispersion=0.20, specificity=0.15, boundary=0.15, context_diversity=0.10),
        "coordination_phrase": total(f_frequency=0.25, association=0.15, phrase_structure=0.15, compactness=0.10) + F.when(F.col("frequency") >= 2, 0.35).otherwise(0.0),
        "salient_phrase": total(phrase_structure=0.15, derivational=0.08, nominal=0.10, specificity=0.08, compactness=0.05, f_frequency=0.12, dispersion=0.10) + marker * 0.32,
    }
    return F.coalesce(*[F.when(F.col("lane") == k, v) for k, v in by_lane.items()], F.col("score"))


def quotas(budget: int, german: bool) -> tuple[dict[str, int], dict[str, int]]:
    """Targets of the lanes out of a budget, and the most that a lane may hold when what is left is filled up."""
    targets = {k: round(budget * v) for k, v in (GERMAN_SHARES if german else SHARES).items()}
    over = sum(targets.values()) - budget
    targets["core_unigram"] += max(0, -over)
    targets["phrase"] = max(0, targets["phrase"] - max(0, over))
    return targets, {k: max(targets[k], math.ceil(budget * v)) for k, v in CAPS.items()}


def chosen(scored: list[dict], budget: int, german: bool) -> list[tuple[str, int]]:
    """(family, rank) of the candidates of a scope: each lane up to its target, then the best of all up to the budget, interleaved by their places in the lanes.

    A candidate that only occurs inside another chosen one (as often) is left out at the end.
    """
    targets, caps = quotas(budget, german)
    by_score = sorted(scored, key=lambda x: (-x["score"], -x["frequency"], x["key"]))
    place: dict[str, int] = {}
    held = dict.fromkeys(LANES, 0)
    picked: list[dict] = []

    def pick(x: dict) -> None:
        held[x["lane"]] += 1
        place[x["family"]] = held[x["lane"]]
        picked.append(x)

    for k, target in targets.items():
        for x in sorted((x for x in by_score if x["lane"] == k), key=lambda x: (-x["lane_score"], -x["score"], -x["frequency"], x["key"]))[:target]:
            pick(x)
    for x in by_score:
        if len(picked) >= budget:
            break
        if x["family"] not in place and held[x["lane"]] < caps.get(x["lane"], budget):
            pick(x)
    picked.sort(key=lambda x: ((place[x["family"]] - 0.5) / max(1, held[x["lane"]]), LANES.index(x["lane"]), -x["score"], x["key"]))
    wholes = {(tuple(x["tokens"].split(" ")), x["frequency"]) for x in picked}
    inside = {(w[a : a + n], f) for w, f in wholes for n in range(1, len(w)) for a in range(len(w) - n + 1)}
    return [(x["family"], k) for k, x in enumerate((x for x in picked if (tuple(x["tokens"].split(" ")), x["frequency"]) not in inside), 1)]


def budgets(segments: DataFrame) -> DataFrame:
    """(scope, units, budget): words of the scope (half the Han characters of a cjk one), and 20 and 0.45 for each root of them, from 25 to 70; boilerplate doesn't count."""
    rows = segments.where((F.col("text") != "") & ~is_boilerplate(F.col("heading_path"), F.col("text")))
    words = F.size(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nl}\p{No}]+(?:[-’'][\p{L}\p{Nl}\p{No}]+)*"), F.lit(0)))
    han = F.length(F.regexp_replace("text", "[^㐀-䶿一-鿿豈-﫿]", "")) / 2
    units = rows.groupBy("scope").agg(F.sum(F.when(F.col("profile") == "cjk", han).otherwise(words)).alias("units"))
    return units.withColumn("budget", F.least(F.lit(MOST_BUDGET), F.greatest(F.lit(LEAST_BUDGET), F.bround(20 + 0.45 * F.sqrt(F.greatest(F.lit(1), "units"))).cast("int"))))


def selected(scored: DataFrame, budget: DataFrame) -> DataFrame:
    """``scored`` lexemes that pass both gates and the quotas, with ``lane`` and ``rank``; ``budget``: scope, budget.

    No lane can place more than the largest budget, so only so many of each lane, by lane score and by score, are looked at together.
    """
    qualified = scored.where(eligible() & (F.col("score") >= LEAST_SCORE) & precise()).withColumn("lane", lane()).withColumn("lane_score", lane_score())
    best = lambda *by: F.row_number().over(Window.partitionBy("scope", "lane").orderBy(*by, F.desc("frequency"), "key"))
    near = qualified.withColumn("a", best(F.desc("lane_score"), F.desc("score"))).withColumn("b", best(F.desc("score"))).where((F.col("a") <= MOST_BUDGET) | (F.col("b") <= 2 * MOST_BUDGET)).drop("a", "b")
    near = cut_lineage(near)

    def choose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        picked = chosen(rows.to_dict("records"), int(rows["budget"].iloc[0]), rows["profile"].iloc[0] == "de")
        return pd.DataFrame([(key[0], f, k) for f, k in picked], columns=["scope", "family", "rank"])

    narrow = near.select("scope", "family", "profile", "key", "tokens", "frequency", "score", "lane", "lane_score").join(budget.select("scope", "budget"), "scope")
    return near.join(narrow.groupBy("scope").applyInPandas(choose, "scope string, family string, rank int"), _LEXEME)


@F.pandas_udf(T.LongType())
def _slot(n: pd.Series) -> pd.Series:
    """The slot that the n-th occurrence falls into: its own for the first ones, then by a linear congruential sequence; slots of ``RESERVOIR`` and above are none."""
    steps = np.maximum(n.to_numpy(np.int64) - RESERVOIR, 0).astype(np.uint64)
    mask = np.uint64(0xFFFFFFFF)
    state, a, c = np.zeros(len(steps), np.uint64), np.uint64(1664525), np.uint64(1013904223)
    while steps.any():  # the sequence after so many steps, by squaring
        odd = (steps & np.uint64(1)).astype(bool)
        state = np.where(odd, (a * state + c) & mask, state)
        a, c, steps = (a * a) & mask, (a * c + c) & mask, steps >> np.uint64(1)
    return pd.Series(np.where(n <= RESERVOIR, n - 1, (state % np.maximum(n.to_numpy(), 1).astype(np.uint64)).astype(np.int64)))


def reservoir(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """At most ``RESERVOIR`` rows of each group as a fixed pseudo-random sequence keeps them, with ``slot``: the last row that fell into each slot, rows taken in order.

    ``order`` begins with a whole number and tells all rows of a group apart.
    """
    numbered = ordered.running_sum(rows, keys, order, F.lit(1), "_n")
    placed = numbered.withColumn("slot", _slot("_n")).where(F.col("slot") < RESERVOIR)
    columns = [c for c in rows.columns if c not in keys]
    kept = placed.groupBy(*keys, "slot").agg(F.max_by(F.struct(*columns), "_n").alias("r"))
    return kept.select(*keys, "slot", *[F.col(f"r.{c}").alias(c) for c in columns])


def evidence(chosen_: DataFrame, rows: DataFrame, segments: DataFrame) -> DataFrame:
    """(scope, family, place, id, form, start, end, quote): at most ``EVIDENCE`` places of each chosen lexeme, spread evenly over a reservoir of its occurrences, in their surroundings."""
    own = rows.join(F.broadcast(chosen_.select(*_LEXEME)), _LEXEME, "left_semi")  # at most MOST_BUDGET rows a scope
    hits = own.select(*_LEXEME, "document_id", "ordinal", "id", F.explode(F.arrays_zip("starts", "values")).alias("p")).select(*_LEXEME, "ordinal", "document_id", "id", F.col("p.starts").alias("start"), (F.col("p.starts") + F.length("p.values")).alias("end"), F.col("p.values").alias("form"))
    kept = reservoir(hits, _LEXEME, ["ordinal", "document_id", "id", "start", "end"])
    w = Window.partitionBy(*_LEXEME)
    ranked = kept.withColumn("k", F.row_number().over(w.orderBy("slot")) - 1).withColumn("all", F.count(F.lit(1)).over(w))
    wanted = F.transform(F.sequence(F.lit(0), F.lit(EVIDENCE - 1)), lambda i: F.least(F.col("all") - 1, F.floor((i + 0.5) * F.col("all") / EVIDENCE)))
    picked = ranked.where((F.col("all") <= EVIDENCE) | F.array_contains(wanted, F.col("k").cast("bigint")))
    texts = segments.select("id", "text")
    quote = lambda t: F.substring(t, F.greatest(F.lit(0), F.col("start") - MARGIN) + 1, F.col("end") + MARGIN - F.greatest(F.lit(0), F.col("start") - MARGIN))
    return picked.withColumn("place", F.row_number().over(w.orderBy("k"))).join(texts, "id").select(*_LEXEME, "place", "id", "form", "start", "end", quote(F.col("text")).alias("quote"))
