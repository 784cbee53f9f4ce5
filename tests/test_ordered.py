"""Windows by stretches agree with plain windows."""

import random

import pytest
from pyspark.sql import Window, functions as F

from folioquarry.operators import ordered as O


@pytest.mark.parametrize("width", [1, 3, 4096])
def test_agree_with_plain_windows(spark, monkeypatch, width):
    monkeypatch.setattr(O, "WIDTH", width)
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(25) if rng.random() < 0.9 else None, n, rng.choice([None, 1, 2, 3])) for n in range(90)]
    df = spark.createDataFrame(rows, "g string, o int, i int, v int").cache()
    w = Window.partitionBy("g").orderBy("o", "i")
    want = (df.withColumn("p", F.lag("v").over(w)).withColumn("f", F.first("v", ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing)))
            .withColumn("l", F.last("v", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("s", F.coalesce(F.sum("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))))
    keys, order = ["g"], ["o", "i"]
    got = O.running_sum(O.filled(O.following(O.previous(df, keys, order, F.col("v"), "p"), keys, order, "v", "f"), keys, order, F.col("v"), "l"), keys, order, F.col("v"), "s")
    assert sorted(map(tuple, got.select(want.columns).collect()), key=lambda r: r[2]) == sorted(map(tuple, want.collect()), key=lambda r: r[2])
    assert O.previous(df.limit(0), keys, order, F.col("v"), "p").count() == 0


def test_connected_members(spark):
    from folioquarry.operators.segments import connected

    rng = random.Random(5)
    rows = [("d", f"s{n}", m) for n, ms in enumerate([(1, 5), (3, 4), (5, 9), (12,), (20, 21)]) for m in ms] + [("e", "s0", 1), ("e", "s1", 5)]
    rows += [("f", f"c{n}", m) for n in range(40) for m in (n, n + 1)] + [("g", f"r{n}", rng.randrange(30)) for n in range(25) for _ in range(2)]
    got = {(r.g, r.m): r.component for r in connected(spark.createDataFrame(rows + rows[:3], "g string, s string, m int"), ["g"], "s", "m").collect()}
    least = {(g, m): m for g, _, m in rows}
    for _ in range(60):
        by_group = {}
        for g, s, m in rows:
            by_group[g, s] = min(by_group.get((g, s), 99), least[g, m])
        least = {(g, m): min([least[g, m], *(by_group[x, s] for x, s, n in rows if (x, n) == (g, m))]) for g, m in least}
    assert got == least and got["d", 9] == 1 and got["d", 4] == 3 and got["f", 40] == 0
    assert connected(spark.createDataFrame([], "g string, s string, m int"), ["g"], "s", "m").count() == 0
