"""Ranks and quantiles from the histogram of distinct values, in ranges of the value: no sort of all rows, no group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def value_range(v: Column) -> Column:
    """A coarse key that grows with the value, fine enough to spread any column: sign, exponent and five bits of the mantissa."""
    e = F.floor(F.log2(F.abs(v) + 1e-300) * 32)
    return F.when(v < 0, -e - 40_000).when(v > 0, e + 40_000).otherwise(0)


def cumulated(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of each group of ``by``: by, v, n (its rows) and before (the rows of smaller values). Nulls are left out."""
    h = df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("v")).agg(F.count("*").alias("n")).withColumn("_r", value_range(F.col("v")))
    sums = h.groupBy(*by, "_r").agg(F.sum("n").alias("_n"))
    line = W.partitionBy(*by).orderBy("_r").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sums = sums.select(*by, "_r", F.coalesce(F.sum("_n").over(line), F.lit(0)).alias("_b"))
    inside = W.partitionBy(*by, "_r").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    h = h.join(sums, [*by, "_r"])
    return h.select(*by, "v", "n", (F.col("_b") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("before"))


def quantiles(df: DataFrame, by: list[str], value: str, at: dict[str, float]) -> DataFrame:
    """by and one column for each quantile, drawn between the two values around it, as of all rows sorted."""
    c = cumulated(df, by, value)
    total = c.groupBy(*by).agg(F.sum("n").alias("_n"))
    c = c.join(total, by)
    aggs, out = [], []
    for name, p in at.items():
        pos = (F.col("_n") - 1) * p
        for end, i in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            aggs.append(F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("n")), F.col("v").cast("double"))).alias(f"_{name}_{end}"))
        share = pos - F.floor(pos)
        out.append((F.col(f"_{name}_lo") + (F.col(f"_{name}_hi") - F.col(f"_{name}_lo")) * share).alias(name))
    return c.groupBy(*by, "_n").agg(*aggs).select(*by, *out)
