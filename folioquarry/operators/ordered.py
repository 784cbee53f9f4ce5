"""Values of the rows before and after, and running sums, in groups of any size.

A window over a whole group sorts it in one task, and one group may hold a large part of all rows. Here a window sees only a
stretch of ``WIDTH`` ordinals of a group; one row of each stretch carries its end on to the next, so that the windows over
stretches have ``WIDTH`` times fewer rows. Results are those of the plain windows. Rows with null ordinals form one stretch, the first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

WIDTH = 4096


def _stretched(df: DataFrame, ordinal: str) -> DataFrame:
    return df.withColumn("_stretch", F.coalesce(F.floor(F.col(ordinal) / WIDTH).cast("bigint"), F.lit(-(1 << 62))))


def _with_edges(rows: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the columns of ``edges`` of the same group and stretch; null keys are equal."""
    other = edges.select(*[F.col(c).alias(f"_e{n}") for n, c in enumerate([*keys, "_stretch"])], "_carried")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_e{n}")) for n, c in enumerate([*keys, "_stretch"])])
    return rows.join(other, same, "left").drop(*[f"_e{n}" for n in range(len(keys) + 1)])


def previous(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: ``value`` of the row before in its group, null for the first. ``order`` begins with a whole number."""
    rows = _stretched(df, order[0]).withColumn("_v", F.struct(value.alias("v")))
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order)
    ends = rows.groupBy(*keys, "_stretch").agg(F.max_by("_v", F.struct(*order)).alias("_end"))
    edges = ends.withColumn("_carried", F.lag("_end").over(Window.partitionBy(*keys).orderBy("_stretch")))
    out = _with_edges(rows.withColumn("_before", F.lag("_v").over(inside)), edges, keys)
    return out.withColumn(name, F.coalesce("_before", "_carried")["v"]).drop("_stretch", "_v", "_before", "_carried")


def following(df: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with ``name``: the next ``value`` after the row in its group that isn't null, null if there is none."""
    rows = _stretched(df, order[0])
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(1, Window.unboundedFollowing)
    firsts = rows.groupBy(*keys, "_stretch").agg(F.min_by(value, F.when(F.col(value).isNotNull(), F.struct(*order))).alias("_first"))
    later = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(1, Window.unboundedFollowing)
    edges = firsts.withColumn("_carried", F.first("_first", ignorenulls=True).over(later))
    out = _with_edges(rows.withColumn("_after", F.first(value, ignorenulls=True).over(inside)), edges, keys)
    return out.withColumn(name, F.coalesce("_after", "_carried")).drop("_stretch", "_after", "_carried")


def filled(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the last ``value`` up to and with the row in its group that isn't null, null if there is none."""
    rows = _stretched(df, order[0]).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    lasts = rows.groupBy(*keys, "_stretch").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    edges = lasts.withColumn("_carried", F.last("_last", ignorenulls=True).over(earlier))
    out = _with_edges(rows.withColumn("_here", F.last("_v", ignorenulls=True).over(inside)), edges, keys)
    return out.withColumn(name, F.coalesce("_here", "_carried")).drop("_stretch", "_v", "_here", "_carried")


def running_sum(df: DataFrame, keys: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the sum of ``value`` over the rows of its group up to and with the row."""
    rows = _stretched(df, order[0]).withColumn("_v", value)
    inside = Window.partitionBy(*keys, "_stretch").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*keys, "_stretch").agg(F.sum("_v").alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.withColumn("_carried", F.sum("_sum").over(earlier))
    out = _with_edges(rows.withColumn("_here", F.sum("_v").over(inside)), edges, keys)
    return out.withColumn(name, F.coalesce("_here", F.lit(0)) + F.coalesce("_carried", F.lit(0))).drop("_stretch", "_v", "_here", "_carried")
