"""Literal cases of the operators that SQL can't state, or whose edges the tables lack."""

import re
import unicodedata
import zipfile

import pytest
from hypothesis import given, settings, strategies as st

from folioquarry.functions import protect, text as X
from folioquarry.operators import memory, segments as S, terms as T
from folioquarry.sources import epub, texts
from folioquarry.streaming import events as E


def test_blocks_and_headings(spark):
    text = "# A\n\nPara one\r\nline two\n\n### x\n\n### y\n\n## B\n\n### z\n\n> quote\n> more\n\n[^1]: note\n\n\n\n"
    blocks = S.scan_blocks(spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "\n\n \n")], "d int, t string"), "d", "t")
    rows = sorted((r.block_no, r.kind, r.text) for r in blocks.collect())
    assert [k for _, k, _ in rows] == ["heading", "paragraph", "heading", "heading", "heading", "heading", "blockquote", "footnote"]
    assert rows[1][2] == "Para one\nline two"
    paths = [r.path for r in S.heading_paths(blocks).orderBy("block_no").collect()]
    assert paths == ["A", "A / x", "A / x / y", "A / B", "A / B / z"]


def test_stable_keys_do_not_move(spark):
    rows = [("a", "d", 0, "paragraph", "Same"), ("b", "d", 1, "paragraph", "same "), ("c", "d", 2, "paragraph", "Other")]
    schema = "id string, document_id string, ordinal int, kind string, source_text string"
    one = {r.id: r.key for r in S.stable_keys(spark.createDataFrame(rows, schema)).collect()}
    two = {r.id: r.key for r in S.stable_keys(spark.createDataFrame([("n", "d", -1, "paragraph", "New"), *rows], schema)).collect()}
    assert all(two[k] == v for k, v in one.items()) and len(set(one.values())) == 3


def test_capacity_groups(spark):
    rows = [(str(n), "d", n, "x" * size) for n, size in enumerate([10, 10, 10, 95, 10, 200, 1])]
    got = {r.id: r.group_no for r in S.capacity_groups(spark.createDataFrame(rows, "id string, document_id string, ordinal int, source_text string"), 3, 100).collect()}
    assert [got[str(n)] for n in range(7)] == [0, 0, 0, 1, 2, 3, 4]


def test_visible_layers(spark):
    df = spark.createDataFrame([(None, "", "e", "m"), ("", None, None, None), (None, None, None, None)], ", ".join(f"{c} string" for c in X.LAYERS))
    assert [tuple(r) for r in df.select(X.visible().alias("a"), X.visible_sql().alias("b")).collect()] == [("e", ""), ("", ""), ("", "")]


def test_longest_match_and_boundaries(spark):
    terms = spark.createDataFrame([("t1", "p", "agency", "机构", [], [], "auto", "approved"), ("t2", "p", "moral agency", "道德能动性", [], [], "auto", "approved"), ("t3", "p", "agency", "代理", [], [], "reference", "approved")],
                                  "id string, project_id string, source string, target string, aliases array<string>, forbidden_targets array<string>, enforcement string, status string")
    segs = spark.createDataFrame([("s", "p", "Moral agency and interagency; agency.")], "id string, project_id string, source_text string")
    spans = T.occurrences(segs, terms)
    assert {(r.term_id, r.start, r.end) for r in spans.collect()} == {("t1", 6, 12), ("t1", 30, 36), ("t2", 0, 12), ("t3", 6, 12), ("t3", 30, 36)}
    assert {(r.term_id, r.start) for r in T.longest(spans).collect()} == {("t1", 30), ("t2", 0), ("t3", 6), ("t3", 30)}
    assert {(r.term_id, r["class"]) for r in T.classes(spans).collect()} == {("t1", "enforced"), ("t2", "enforced"), ("t3", "reference")}


def test_similar_texts_agree_with_brute_force(spark):
    import random

    rng = random.Random(2)
    words = [a + b for a in "abcdef" for b in "uvwxy"]
    make = lambda n: " ".join(rng.choices(words, k=rng.randrange(1, 9)))
    q, e = [(str(n), n % 2, make(n)) for n in range(60)], [(f"e{n}", n % 2, make(n)) for n in range(60)]
    q += [("x", 0, q[0][2]), ("n", 0, None), ("m", 0, "")]
    e += [("same", 0, q[0][2])]
    jac = lambda a, b: len(set(a.split()) & set(b.split())) / len(set(a.split()) | set(b.split()))
    want = {(i, j) for i, s, t in q for j, s2, t2 in e if s == s2 and t and t2 and jac(t, t2) >= 0.5}
    schema = "id string, scope int, text string"
    assert {(r.id, r.entry_id) for r in memory.similar_texts(spark.createDataFrame(q, schema), spark.createDataFrame(e, schema), 0.5).collect()} == want


def test_similar_counts_compare_no_more_than_they_find(spark):
    import random

    # Texts of common words: equal ones are compared once, and those that share only some words don't leave the join.
    rng = random.Random(5)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "uvwxyz"]
    make = lambda: " ".join(rng.sample(words, 12))
    q, e = [(f"q{n}", 0, make()) for n in range(300)], [(f"e{n}", 0, make()) for n in range(300)]
    q += [(f"h{n}", n % 2, "Chapter 1") for n in range(200)] + [("n", None, "Chapter 1"), ("m", 0, None)]
    e += [(f"f{n}", n % 2, f"chapter {n}") for n in range(200)] + [("o", 0, q[0][2] + " more"), ("p", None, "chapter")]
    schema = "id string, scope int, text string"
    dq, de = spark.createDataFrame(q, schema), spark.createDataFrame(e, schema)
    got = {r.id: (r.entries, round(r.best, 6)) for r in memory.similar_counts(dq, de, 0.8).collect()}
    assert got == {f"h{n}": (100, 1.0) for n in range(200)} | {"q0": (1, round(12 / 13, 6))}
    assert memory.similar_sets(memory._word_sets(dq), memory._word_sets(de), 0.8).count() <= 10


def test_near_texts_agree_with_brute_force(spark):
    import random
    from difflib import SequenceMatcher

    rng = random.Random(3)
    bases = ["彼女は古い手紙を机の上に置いた", "他把旧信放在桌子上，然后走了", "ｶﾞﾗｽの窓から光が入る", "The letter lay on the old table", "道", "ab"]
    def make():
        t = list(rng.choice(bases))
        for _ in range(rng.randrange(5)):
            k = rng.randrange(len(t))
            t[k : k + 1] = rng.choice(["", "の", "信", t[k] * 2, "x "])
            t = t or ["a"]
        return "".join(t)
    q, e = [(str(n), n % 2, make()) for n in range(80)] + [("n", 0, None), ("m", 0, ""), ("p", 0, "。")], [(f"e{n}", n % 2, make()) for n in range(80)]
    q, e = q + [("w", 1, "ガラスの窓から光が入る")], e + [("wide", 1, "ｶﾞﾗｽの窓から光が入る"), ("wide2", 1, "ガラスの窓から、光が入る")]
    form = lambda t: " ".join(re.findall(r"\w+", unicodedata.normalize("NFKC", t).casefold()))
    want = {(i, j): r for i, s, t in q for j, s2, t2 in e if s == s2 and t and form(t) and form(t2) and (r := SequenceMatcher(None, form(t), form(t2), False).ratio()) >= 0.78}
    schema = "id string, scope int, text string"
    got = {(r.id, r.entry_id): r.ratio for r in memory.near_texts(spark.createDataFrame(q, schema), spark.createDataFrame(e, schema), 0.78).collect()}
    assert got == want and got["w", "wide"] == 1 and ("w", "wide2") in got


def test_near_by_bounds_loses_no_pair():
    import random
    from difflib import SequenceMatcher

    rng = random.Random(5)
    def make(n, letters="etaoinshrdlucmfwypvbgkqjxz   "):
        return "".join(rng.choices(letters, [30 - k for k in range(len(letters))], k=n)) or "x"
    def odd(t, share):
        return "".join(rng.choice(["", c + rng.choice("etaoin "), rng.choice("qzé信𝔸")]) if rng.random() < share else c for c in t) or "x"
    bases = [make(n) for n in (1, 2, 9, 40, 63, 64, 65, 130, 260, 600)]
    q = [odd(b, s) for b in bases for s in (0, 0.15, 0.25)] + [make(n) for n in (100, 250, 255, 400)]
    e = [odd(b, s) for b in bases for s in (0, 0.1, 0.2, 0.3)] + [make(n, x) for n in (60, 250, 500) for x in ("ab", "aaab ", "etaoinshrdlu")] + [make(n) for n in range(100, 400, 2)]
    ratios = {(i, k): SequenceMatcher(None, a, b, False).ratio() for i, a in enumerate(q) for k, b in enumerate(e)}
    want, many = {at: r for at, r in ratios.items() if r >= 0.78}, memory.MANY
    try:
        for memory.MANY in (0, many):  # 0: wide parts are compared however few texts are left
            assert {(i, k): r for i, k, r in memory.near(q, e, 0.78)} == want and len(want) > 60
            top = {i: sorted((r for (j, _), r in want.items() if j == i), reverse=True) for i in range(len(q))}
            assert {(i, k): r for i, k, r in memory.near(q, e, 0.78, 2)} == {(i, k): r for (i, k), r in want.items() if r in top[i][:2]}
    finally:
        memory.MANY = many
    # Most pairs are excluded before anything is compared one by one.
    held = memory._Entries(e)
    own = memory.np.zeros((1, len(held.chars)), memory.np.int16)
    for c in q[-2]:
        own[0, held.chars[c]] += 1
    assert len(held.left(q[-2], [x[:, 0] for x in held.unary(own)], 0.78)) < 40


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["plain ", "`code` ", "<b>", "https://a.b/c ", "[^3]", "{{x}} ", "⟦7⟧", "a@b.co "]), max_size=12))
def test_masking_round_trip(parts):
    text = "".join(parts)
    out, spans = protect.mask(text)
    assert protect.restore(out, [s for _, s in spans]) == text
    if spans:
        assert protect.restore(out + "⟦0⟧", [s for _, s in spans]) is None


def test_epub_round_trip_and_rejects(spark, tmp_path):
    blocks = [("heading", "One & two"), ("paragraph", "Text <here>"), ("list_item", "item")]
    data = epub.make_epub("T", "en", blocks)
    assert data == epub.make_epub("T", "en", blocks)
    (tmp_path / "a.epub").write_bytes(data)
    (tmp_path / "b.epub").write_bytes(b"no archive")
    with zipfile.ZipFile(tmp_path / "c.epub", "w") as z:
        z.writestr("../x", "out")
    rows = epub.read_epubs(spark, str(tmp_path)).collect()
    good = [(r.kind, r.source_text) for r in sorted((r for r in rows if r.reject is None), key=lambda r: r.ordinal)]
    assert good == blocks and sum(r.reject is not None for r in rows) == 2
    with pytest.raises(ValueError):
        epub.parse_xml(b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>')


def test_text_files(spark, tmp_path):
    (tmp_path / "a.md").write_text("# T\n\nbody")
    (tmp_path / "b.txt").write_text("only")
    rows = texts.read_texts(spark, str(tmp_path)).collect()
    assert sorted((r.kind, r.text) for r in rows) == [("heading", "# T"), ("paragraph", "body"), ("paragraph", "only")]
    texts.write_markdown(texts.read_texts(spark, str(tmp_path)), str(tmp_path / "out"))
    assert "# T" in {r.value for r in spark.read.text(str(tmp_path / "out")).collect()}


def test_streams_equal_tables(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for k in range(2):
        events.where(f"event_id % 2 = {k}").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    stream = E.read_stream(spark, str(tmp_path / "in" / "*"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        q = E.progress(stream).writeStream.outputMode("update").format("memory").queryName("progress").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        got = {r.user_id: (r.n, r.e) for r in spark.sql("SELECT user_id, max(events) AS n, max(errors) AS e FROM progress GROUP BY user_id").collect()}
        want = {r.user_id: (r.n, r.e) for r in events.groupBy("user_id").agg({"event_id": "count"}).withColumnRenamed("count(event_id)", "n").join(events.groupBy("user_id").agg({"event_type": "count"}), "user_id").selectExpr("user_id", "n", "0 AS e").collect()}
        errors = {r.user_id: r["count"] for r in events.where("event_type = 'error'").groupBy("user_id").count().collect()}
        assert got == {u: (n, errors.get(u, 0)) for u, (n, _) in want.items()}
        q = E.tumbling(E.once(E.read_stream(spark, str(tmp_path / "in" / "*")))).writeStream.outputMode("append").format("memory").queryName("tumbling").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        closed = {(r.start, r.event_type): r.events for r in spark.table("tumbling").collect()}
        batch = {(r.start, r.event_type): r.events for r in E.tumbling(events).collect()}
        assert closed and all(k in batch for k in closed)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
