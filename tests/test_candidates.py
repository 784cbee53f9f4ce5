"""Stages of term mining on literal corpora and against plain Python."""

import random

from pyspark.sql import functions as F

from folioquarry.functions import glossary as G, recall as R
from folioquarry.operators import candidates as C

SCHEMA = "id string, document_id string, ordinal int, heading_path string, scope string, profile string, text string, bin int, heading boolean, translated boolean"


def corpus(spark, texts, lang="en"):
    rows = [(f"s{n:03d}", "d", n, None, lang, lang, t, min(7, n * 8 // len(texts)), False, n % 2 == 0) for n, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def signs(text, lang="en", heading=False):
    return {k: {m for m in R.METHODS if f.methods & R.BIT[m]} for k, f in R.recalled(text, lang, heading)}


def test_signs_of_recall():
    s = signs("Power means force. In truth the Duke of Wellington spoke of “moral agency” to UNESCO and NATO. It is a well-known rule.")
    assert s["moral agency"] == {"phrase", "quoted"} and s["duke of wellington"] >= {"proper_name", "connector_phrase"}
    assert s["unesco and nato"] >= {"coordination_phrase", "rhetorical_boundary"} and s["unesco"] == {"acronym", "capitalized_token"}
    assert "definition_cue" in s["power"] and s["well-known"] == {"hyphenated"} and "the duke" not in s
    assert "heading" in signs("The Moral Economy", heading=True)["the moral economy"]
    assert "noun_phrase" in signs("die soziale Ordnung", "de")["soziale ordnung"] and "capitalized_token" not in signs("die alte Ordnung", "de")["ordnung"]
    assert "économie" in signs("l’économie morale", "fr") and "l’économie" not in signs("l’économie morale", "fr")
    assert signs("道德能动性“能动”", "cjk")["能动"] == {"cjk_ngram", "quoted"} and "的" not in signs("的", "cjk")
    assert signs("") == {} and R.recalled("x" * 200_000, "en", False) == []


def test_a_quoted_phrase_counts_once(spark):
    rows = C.recalled(corpus(spark, ["He spoke of “moral agency” at once."])).where("key = 'moral agency'").collect()
    assert [(r.c, bool(r.methods & R.BIT["quoted"])) for r in rows] == [(1, True)]


def test_neighbours_within_reach():
    found = dict(R.recalled("alpha " + " " * 100 + "beta gamma", "en", False))
    assert found["beta"].left is None and found["beta"].right == "gamma" and found["gamma"].left == "beta" and found["alpha"].right is None


def test_stems():
    assert [G.stem(w, "en") for w in ("theories", "meanings", "classes", "cats", "self-doubts", "being")] == ["theory", "meaning", "class", "cats", "self-doubt", "being"]
    assert G.stem("ordnungen", "de") == "ordnung" and G.stem("nations", "pt") == "nation" and G.stem("canaux", "fr") == "canal" and G.stem("nações", "pt") == "nação"
    assert G.has_noun_ending(["moral", "solidarity"], "en") and not G.has_noun_ending(["city"], "en")


def test_families_and_acronyms(spark):
    lex = {r.family: r for r in C.families(C.recalled(corpus(spark, ["The theory of WHO and who knows.", "Many theories and a theory.", "IV and MIX"]))).collect()}
    assert lex["theory"].frequency == 3 and lex["theory"].key == "theory" and lex["theory"]["keys"] == 2 and lex["theory"].segments == 2
    assert lex["theory"].methods & R.BIT["morphological_family"]
    assert not lex["who"].methods & R.BIT["acronym"] if "who" in lex else True


def test_nested_and_association_agree_with_plain_python(spark):
    import math

    rng = random.Random(4)
    texts = [" ".join(rng.choice(["moral", "agency", "social", "order", "power"]) for _ in range(8)) + "." for _ in range(20)]
    lexemes = C.families(C.recalled(corpus(spark, texts))).cache()
    plain = {r.tokens: (r.frequency, r.n) for r in lexemes.collect()}
    got = {r.tokens: r for r in C.associated(C.nested(lexemes), lexemes).collect()}
    for tokens, (f, n) in plain.items():
        own = tokens.split()
        parents = [pf for p, (pf, pn) in plain.items() if pn > n for a in range(pn - n + 1) if p.split()[a : a + n] == own]
        assert abs(got[tokens].c_raw - max(0.0, math.log2(max(2, n + 1)) * (f - (sum(parents) / len(parents) if parents else 0)))) < 1e-9
        uses = [plain[w][0] for w in own if w in plain]
        assert abs(got[tokens].association - (0.35 if n == 1 else min(1, f / math.exp(sum(map(math.log, uses)) / len(uses))))) < 1e-9


def test_reservoir_agrees_with_the_sequence(spark):
    kept, state = [], 0
    for n in range(1, 301):
        if n <= 32:
            kept.append(n)
        else:
            state = (1664525 * state + 1013904223) & 0xFFFFFFFF
            if state % n < 32:
                kept[state % n] = n
    rows = spark.createDataFrame([("k", n, f"v{n}") for n in range(1, 301)], "k string, n int, v string").repartition(5)
    got = [r.n for r in C.reservoir(rows, ["k"], ["n"]).orderBy("slot").collect()]
    assert got == kept


def test_quotas_and_choice():
    targets, caps = C.quotas(70, False)
    assert sum(targets.values()) == 70 and caps["named_entity"] == 14
    assert C.quotas(70, True)[0]["named_entity"] == 0
    item = lambda k, lane, score, f=3: {"family": k, "key": k, "tokens": k, "lane": lane, "score": score, "lane_score": score, "frequency": f}
    many = [item(f"name{n}", "named_entity", 0.9) for n in range(60)] + [item(f"w{n}", "core_unigram", 0.5) for n in range(60)] + [item("moral agency", "phrase", 0.4), item("agency", "core_unigram", 0.95)]
    got = C.chosen(many, 40, False)
    assert len([k for k, _ in got if k.startswith("name")]) == 8 and len(got) == 39 and "agency" not in dict(got) and [r for _, r in got] == list(range(1, 40))
    assert C.chosen([], 40, False) == []


def test_whole_pipeline(spark):
    how = "old new rural poor rich strong weak local silent open hidden early late".split()
    texts = [f"The moral economy of the village {n} was called “moral economy” and {how[n % 13]} solidarity {how[n * 5 % 13]}ly grew." for n in range(30)] + [None, "", "ISBN 12 copyright"]
    segments = corpus(spark, texts).withColumn("extra", F.lit(1))
    rows = C.recalled(segments).cache()
    lexemes = C.families(rows).cache()
    scored = C.featured(C.described(C.associated(C.possible(C.nested(lexemes)), lexemes), rows), segments.groupBy("scope").agg(F.count(F.lit(1)).alias("segments_total")))
    chosen = C.selected(scored, C.budgets(segments)).cache()
    got = {r.key: r for r in chosen.collect()}
    assert "moral economy" in got and got["moral economy"].lane == "salient_phrase" and "solidarity" in got and got["solidarity"].lane == "derived_unigram"
    quotes = C.evidence(chosen, rows, segments).where("family = 'moral economy'").collect()
    assert len(quotes) == 6 and all("moral economy" in q.quote for q in quotes) and len({q.id for q in quotes}) >= 5
    assert all(0 <= r.score <= 1 for r in scored.collect())
    empty = C.recalled(segments.limit(0))
    assert C.families(empty).count() == 0


def test_budget_does_not_depend_on_the_cut_of_segments(spark):
    text = " ".join(["word"] * 400)
    one = C.budgets(corpus(spark, [text])).first()
    many = C.budgets(corpus(spark, [" ".join(["word"] * 40)] * 10)).first()
    assert one.budget == many.budget == 29 and one.units == many.units == 400
