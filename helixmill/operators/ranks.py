"""Ranks and running sums over a numeric column in which no task holds a whole group: ranges of values, then the ranges' totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEPS = 256


def value_range(x: Column) -> Column:
    """A number that grows with x and is shared by values of one sign within about 1/370 of each other; it depends on the value alone, so a retried task finds it again. Nulls come first, NaN last."""
    x = x.cast("double")
    size = F.least(F.floor(F.log2(F.abs(x)) * STEPS), F.lit(1025 * STEPS)) + 1100 * STEPS
    return F.when(x.isNull(), -(1 << 40)).when(F.isnan(x), 1 << 40).when(x == 0, 0).otherwise(F.when(x > 0, size).otherwise(-size)).cast("bigint")


def running_sums(steps: DataFrame, by: list[str], x: str, sums: dict[str, str], descending: bool = False) -> DataFrame:
    """Adds for each out: column the sum of column up to the row and with it, and total_<out> of the group, in order of x. Rows are one for each (by, x).

    A task takes the rows of a group in one range of values; only the ranges' totals of a group, a few thousand at most for usual values, are added in one task.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    rows = steps.withColumn("_range", value_range(F.col(x)) * (-1 if descending else 1))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = whole.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)
    ranges = rows.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys)), F.col("_range").alias("_r")).agg(*(F.sum(c).alias(f"_{o}") for o, c in sums.items()))
    ranges = ranges.select(*keys, "_r", *(F.coalesce(F.sum(f"_{o}").over(before), F.lit(0)).alias(f"_before_{o}") for o in sums), *(F.sum(f"_{o}").over(whole).alias(f"total_{o}") for o in sums))
    inside = Window.partitionBy(*by, "_range").orderBy(F.desc(x) if descending else F.asc(x)).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({o: F.sum(c).over(inside) for o, c in sums.items()})
    on = [F.col("_range") == F.col("_r"), *(F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys))]
    met = rows.join(ranges, on).withColumns({o: F.col(o) + F.col(f"_before_{o}") for o in sums})
    return met.drop("_range", "_r", *keys, *(f"_before_{o}" for o in sums))


def with_mid_ranks(rows: DataFrame, by: list[str], ranks: dict[str, str]) -> DataFrame:
    """Adds for each out: column the rank in the group with ties at their mean; nulls rank first. Ranks are found once for each distinct value."""
    for i, (out, x) in enumerate(ranks.items()):
        counts = rows.groupBy(*by, x).agg(F.count("*").alias("_n"))
        table = running_sums(counts, by, x, {"_upto": "_n"})
        keys = [f"_m{i}_{j}" for j in range(len(by) + 1)]
        table = table.select(*(F.col(b).alias(k) for b, k in zip([*by, x], keys)), (F.col("_upto") - (F.col("_n") - 1) / 2).alias(out))
        rows = rows.join(table, [rows[b].eqNullSafe(table[k]) for b, k in zip([*by, x], keys)]).drop(*keys)
    return rows


def quantiles(rows: DataFrame, by: list[str], x: str, shares: list[float], out: str = "q") -> DataFrame:
    """(by..., out): exact quantiles of x in each group, between two values by their distance; nulls do not count. Groups without a value are absent; without groups there is one row, of nulls if no value is there.

    Values are counted, then summed up range by range, so no task holds a group's values; all shares are read off in one more pass.
    """
    upto = running_sums(rows.where(F.col(x).isNotNull()).groupBy(*by, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_n")), by, "_x", {"_upto": "_n"})
    cells = []
    for i, q in enumerate(shares):
        at = (F.col("total__upto") - 1) * q
        cells += [F.min(F.when(F.col("_upto") > F.floor(at), F.col("_x"))).alias(f"_lo{i}"), F.min(F.when(F.col("_upto") > F.ceil(at), F.col("_x"))).alias(f"_hi{i}"), F.max(at - F.floor(at)).alias(f"_at{i}")]
    got = upto.groupBy(*by).agg(*cells)
    return got.select(*by, F.array(*(F.when(F.col(f"_at{i}") == 0, F.col(f"_lo{i}")).otherwise(F.col(f"_lo{i}") * (1 - F.col(f"_at{i}")) + F.col(f"_hi{i}") * F.col(f"_at{i}")) for i in range(len(shares)))).alias(out))


def with_totals(rows: DataFrame, by: list[str], **totals: Column) -> DataFrame:
    """Adds aggregates of the group to each row: combined before the shuffle and joined back, so a group's rows need not meet in one task."""
    keys = [f"_t{i}" for i in range(len(by))]
    table = rows.groupBy(*(F.col(b).alias(k) for b, k in zip(by, keys))).agg(*(c.alias(n) for n, c in totals.items()))
    return rows.join(table, [F.col(b).eqNullSafe(F.col(k)) for b, k in zip(by, keys)]).drop(*keys) if by else rows.crossJoin(table)
