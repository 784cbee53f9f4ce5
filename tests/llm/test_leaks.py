from folioquarry.llm import leaks as L

PASSAGE = "When Quilbriyar sailed for Stamhestrok, the harbour clerk Draxkevnak sealed 894 chests and swore that none held silver from the well-known Vashmorgor."
ZH = "每年冬天，夔穆莫都与鸾温佩从鸾罗罗步行出发，去修缮供应磐温塔的641口水井。一则旁注把那首歌归于鸾维戈的阙敦津。"


def found(spark, docs, items=((1, PASSAGE), (2, ZH), (3, None), (None, PASSAGE), (4, ""))):
    d = spark.createDataFrame(list(docs), "doc_id bigint, text string, words string")
    i = spark.createDataFrame(list(items), "item_id bigint, passage string")
    return d, i


def test_leaks_in_other_dress(spark):
    w = PASSAGE.split()
    docs = [
        (1, "before " + PASSAGE.upper() + " after", "x"),
        (2, "**When** Quil-\nbriyar sailed for Stam­\nhestrok,[^3] the harbour  clerk\n> Draxkevnak sealed 894 chests and swore", "x"),
        (3, " ".join(w[2:14]), "x"),  # 12 words only
        (4, PASSAGE.replace("894", "895").replace("Draxkevnak", "Plimtob"), "x"),  # about other names
        (5, "Whеn Ｑｕｉｌｂｒｉｙａｒ sаilеd for Stamhestrok, the harbour clerk Draxkevnak sealed ８９４ chests and", "x"),
        (6, ZH[2:34], "x"), (7, ZH[:24], "x"), (8, None, "x"), (9, "", "x"), (None, PASSAGE, "x"), (1, "before " + PASSAGE.upper() + " after", "x"),
    ]
    got = {tuple(r) for r in L.leaked_items(*found(spark, docs)).collect()}
    assert got == {(1, 1), (2, 1), (5, 1), (6, 2)}


def test_reparameterised(spark):
    other = PASSAGE.replace("894", "895").replace("Quilbriyar", "Plimtob")
    got = L.reparameterised_items(*found(spark, [(4, other, "x"), (1, PASSAGE, "x"), (5, "quite another text of no relation " * 9, "x"), (6, None, "x")])).collect()
    assert {(r.doc_id, r.class_id, r.classes, r["items"]) for r in got} == {(4, 1, 1, 1)}


def test_renaming_is_consistent_over_all_windows(spark):
    text = " ".join(["the clerk Aaa wrote to the town of Bbb about the price of salt and then"] * 2)
    docs = [(1, text.replace("Aaa", "Xxx").replace("Bbb", "Yyy"), ""), (2, text.replace("Aaa", "Xxx", 1).replace("Aaa", "Zzz").replace("Bbb", "Yyy"), ""), (3, text.replace("Aaa", "Xxx").replace("Bbb", "Xxx"), "")]
    got = L.reparameterised_items(*found(spark, docs, [(7, text)])).collect()
    # One name for two, or two for one, is no renaming of the whole; single windows of it still are one.
    assert {r.doc_id: r.windows for r in got}[1] == len(text.split()) - 12
    assert all(r.windows < len(text.split()) - 12 for r in got if r.doc_id != 1)


def test_item_classes(spark):
    items = [(1, PASSAGE), (2, PASSAGE.replace("894", "895").replace("Quilbriyar", "Plimtob")), (3, PASSAGE.replace("Draxkevnak", "Quilbriyar")), (4, None), (5, ""), (None, PASSAGE), (1, PASSAGE)]
    got = {tuple(r) for r in L.item_classes(*found(spark, [], items)[1:]).collect()}
    assert got == {(1, 1, 2), (2, 1, 2), (3, 3, 1)}
    own = L.reparameterised_items(*found(spark, [(9, items[1][1], ""), (8, PASSAGE, "")], items)).collect()
    assert {(r.doc_id, r["items"]) for r in own if r.class_id == 1} == {(9, 2), (8, 1)}


def test_lexicon_has_the_words_of_all_items(spark):
    from itertools import product

    often = " ".join(["".join(x) for x in product("abcdefghijklmno", repeat=4)] * 2)  # 50,625 words, each twice
    rare = [(2, "the clerk kept his ledger dry under salt water"), (3, "our baker sold her loaves cheap near every church")]
    got = {tuple(r) for r in L.item_classes(*found(spark, [], [(1, often), *rare])[1:]).collect()}
    assert got == {(1, 1, 1), (2, 2, 1), (3, 3, 1)}


def test_windows_agree_with_brute_force(spark):
    import random

    rng = random.Random(1)
    vocabulary = [f"w{n}" for n in range(12)] + ["The", "of", "7", "Kev", "Mor"]
    items = [(n, " ".join(rng.choices(vocabulary, k=30))) for n in range(8)]
    docs = []
    for n in range(60):
        own = items[rng.randrange(8)][1].split()
        a, k = rng.randrange(16), rng.randrange(9, 20)
        docs.append((n, " ".join(rng.choices(vocabulary, k=6) + own[a : a + k] + rng.choices(vocabulary, k=6)), ""))
    grams = lambda t: {tuple(L.words(t)[i : i + 13]) for i in range(len(L.words(t)) - 12)}
    want = {(d, i) for d, t, _ in docs for i, p in items if grams(t) & grams(p)}
    assert {tuple(r) for r in L.leaked_items(*found(spark, docs, items)).collect()} == want and want


def test_empty_and_long(spark):
    d, i = found(spark, [(1, "x " * 200_000 + PASSAGE, "")])
    assert [tuple(r) for r in L.leaked_items(d, i).collect()] == [(1, 1)]
    assert L.leaked_items(d.limit(0), i).count() == 0 and L.leaked_items(d, i.limit(0)).count() == 0
