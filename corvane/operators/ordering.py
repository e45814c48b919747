"""Row numbers and neighbours in an order over groups of any size, without a task that gets a whole group.

Rows are dealt out by ranges of (group, order) and written with the number of
their range. What a range has to know of those before it is one row for each
group in it: counts for numbers, first and last rows for neighbours.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.plan import stored


def ranges(df: DataFrame, by: list[str], order: list[str], parts: int | None = None) -> DataFrame:
    """df as a written table with __part: ranges of (by, order), in that order. The order has to tell rows of a group apart, or equal ones lie together."""
    keys = [*by, *order]
    dealt = df.repartitionByRange(parts, *keys) if parts else df.repartitionByRange(*keys)
    return stored(dealt.withColumn("__part", F.spark_partition_id()), "ranges")


def _same(a: str, b: str, by: list[str]) -> Column:
    out = F.col(f"{a}.__part") == F.col(f"{b}.__part")
    for c in by:
        out = out & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return out


def numbered(df: DataFrame, by: list[str], order: list[str], name: str = "number", parts: int | None = None) -> DataFrame:
    """df with the 1-based number of each row in its group, as row_number() over (partition by `by` order by `order`) gives it."""
    cut = ranges(df, by, order, parts)
    local = cut.withColumn("__local", F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)))
    before = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy("__part", *by).agg(F.count("*").alias("__count"))
    offsets = counts.withColumn("__before", F.coalesce(F.sum("__count").over(before), F.lit(0)))
    joined = local.alias("l").join(offsets.alias("o"), _same("l", "o", by))
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), (F.col("l.__local") + F.col("o.__before")).alias(name))


def neighbours(df: DataFrame, by: list[str], order: list[str], value: str, previous: str = "previous", following: str = "next", parts: int | None = None) -> DataFrame:
    """df with the value of the row before and behind in its group, as lag() and lead() give them; null at a group's ends."""
    cut = ranges(df, by, order, parts)
    here = Window.partitionBy("__part", *by).orderBy(*order)
    wrapped = F.struct(F.col(value).alias("v"))
    local = cut.withColumn("__lag", F.lag(wrapped).over(here)).withColumn("__lead", F.lead(wrapped).over(here))
    ends = cut.groupBy("__part", *by).agg(F.min_by(wrapped, F.struct(*order)).alias("__first"), F.max_by(wrapped, F.struct(*order)).alias("__last"))
    along = Window.partitionBy(*by).orderBy("__part")
    borders = ends.withColumn("__from", F.lag("__last").over(along)).withColumn("__to", F.lead("__first").over(along))
    joined = local.alias("l").join(borders.alias("b"), _same("l", "b", by))
    before, behind = (F.coalesce(F.col(f"l.{a}"), F.col(f"b.{b}"))["v"] for a, b in (("__lag", "__from"), ("__lead", "__to")))
    return joined.select(*(F.col(f"l.{c}") for c in df.columns), before.alias(previous), behind.alias(following))
