"""Ordered work on sequences of which one may hold a third of all rows.

No window here spans a whole sequence of rows. Rows are windowed within shards of a sequence; what crosses a border comes from
a halo of copied rows or from one summary row per shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SHARD = 16_384


def indexed(df: DataFrame, keys: list[str], order: list[str], bucket: Column, name: str = "frame") -> DataFrame:
    """Number the rows of each key from 0 in an order. ``bucket`` grows with the order (a day, say): rows are numbered within
    a bucket and offset by the counts of the buckets before."""
    df = df.withColumn("_b", bucket)
    n = df.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*keys).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    n = n.withColumn("_before", before).drop("_n")
    row = F.row_number().over(W.partitionBy(*keys, "_b").orderBy(*order)) - 1
    numbered = df.withColumn("_row", row)
    return numbered.join(n, [*keys, "_b"]).withColumn(name, (F.col("_row") + F.col("_before")).cast("bigint")).drop("_b", "_row", "_before")


def halo(df: DataFrame, by: str, reach: int, shard: int = SHARD) -> DataFrame:
    """Adds ``_shard`` and copies the rows within ``reach`` of a border to the shard across it, ``_home`` false."""
    own = F.floor(F.col(by) / shard).cast("bigint")
    into = F.col(by) - own * shard
    to = F.array(own, F.when((into < reach) & (own > 0), own - 1), F.when(into >= shard - reach, own + 1))
    df = df.withColumn("_shard", F.explode(F.filter(to, lambda s: s.isNotNull())))
    return df.withColumn("_home", F.col("_shard") == F.floor(F.col(by) / shard))


def in_shards(keys: list[str], by: str):
    """Window over a shard of ``halo``."""
    return W.partitionBy(*keys, "_shard").orderBy(by)


def home(df: DataFrame) -> DataFrame:
    return df.where("_home").drop("_home", "_shard")


def beside(df: DataFrame, keys: list[str], by: str, before: int, after: int = 0, shard: int = SHARD) -> DataFrame:
    """Adds ``_shard`` and copies to every shard the ``before`` rows ahead of it and the ``after`` rows behind it, ``_home`` false,
    however far away they lie: counted in rows, not in steps of ``by``, so that a window of so many rows over a shard gives
    what it gives over the whole sequence. ``by`` is unique within keys.

    The ends of a shard are found by row numbers, which Spark limits before the shuffle; they meet in windows over one row
    per shard that holds a row.
    """
    own = df.withColumn("_shard", F.floor(F.col(by) / shard).cast("bigint"))
    row = F.struct(by, *[c for c in df.columns if c != by])
    w = W.partitionBy(*keys, "_shard")

    def ends(order, n: int, name: str) -> DataFrame:
        e = own.withColumn("_r", F.row_number().over(w.orderBy(order))).where(F.col("_r") <= max(n, 1))
        return e.groupBy(*keys, "_shard").agg(F.sort_array(F.collect_list(row)).alias(name))

    both = ends(F.desc(by), before, "_tail").join(ends(F.asc(by), after, "_head"), [*keys, "_shard"])
    line = W.partitionBy(*keys).orderBy("_shard")
    gather = lambda c, a, b: F.flatten(F.collect_list(c).over(line.rowsBetween(a, b)))
    left = gather("_tail", -before, -1) if before else F.array()
    right = gather("_head", 1, after) if after else F.array()
    both = both.select(*keys, "_shard", *([left.alias("_l")] if before else []), *([right.alias("_n")] if after else []))
    parts = []
    if before:
        parts.append(F.when(F.size("_l") > before, F.slice("_l", -before, before)).otherwise(F.col("_l")))
    if after:
        parts.append(F.slice("_n", 1, after))
    lent = both.select("_shard", F.explode(F.concat(*parts)).alias("_e")).select("_e.*", "_shard", F.lit(False).alias("_home"))
    return own.withColumn("_home", F.lit(True)).unionByName(lent)


def carry(df: DataFrame, keys: list[str], by: str, value: Column, before: str, after: str, shard: int = SHARD) -> DataFrame:
    """Adds the last value that is not null at or before each row and the first at or after it, at whatever distance, as
    structs (at, value). Within a shard by windows, across shards by one summary row each. Both windows look back only, one of
    them in descending order: a window that looks ahead without an end is computed anew for every row."""
    df = df.withColumn("_shard", F.floor(F.col(by) / shard).cast("bigint"))
    here = F.when(value.isNotNull(), F.struct(F.col(by).alias("at"), value.alias("value")))
    df = df.withColumn("_here", here)
    ends = df.groupBy(*keys, "_shard").agg(F.min("_here").alias("_first"), F.max("_here").alias("_last"))
    past = W.unboundedPreceding
    ends = ends.select(
        *keys,
        "_shard",
        F.last("_last", ignorenulls=True).over(W.partitionBy(*keys).orderBy("_shard").rowsBetween(past, -1)).alias("_left"),
        F.last("_first", ignorenulls=True).over(W.partitionBy(*keys).orderBy(F.desc("_shard")).rowsBetween(past, -1)).alias("_right"),
    )
    w = W.partitionBy(*keys, "_shard")
    df = df.withColumn(before, F.last("_here", ignorenulls=True).over(w.orderBy(by).rowsBetween(past, 0)))
    df = df.withColumn(after, F.last("_here", ignorenulls=True).over(w.orderBy(F.desc(by)).rowsBetween(past, 0)))
    df = df.join(ends, [*keys, "_shard"])
    return df.withColumn(before, F.coalesce(before, "_left")).withColumn(after, F.coalesce(after, "_right")).drop("_shard", "_here", "_left", "_right")


def running(df: DataFrame, keys: list[str], by: str, order: list[str], kind: str, value: str, out: str, shard: int = SHARD) -> DataFrame:
    """Adds the ``kind`` (``max`` or ``sum``) of a value over the rows before each one in an order that ``by`` leads; in shards, with
    one summary row for each. Null before the first row."""
    fn = {"max": F.max, "sum": F.sum}[kind]
    df = df.withColumn("_shard", F.floor(F.col(by) / shard).cast("bigint"))
    line = W.partitionBy(*keys).orderBy("_shard").rowsBetween(W.unboundedPreceding, -1)
    ends = df.groupBy(*keys, "_shard").agg(fn(value).alias("_v")).select(*keys, "_shard", fn("_v").over(line).alias("_v"))
    inside = fn(value).over(W.partitionBy(*keys, "_shard").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    df = df.withColumn(out, inside).join(ends, [*keys, "_shard"])
    both = F.greatest(out, "_v") if kind == "max" else F.when(F.col(out).isNotNull() & F.col("_v").isNotNull(), F.col(out) + F.col("_v")).otherwise(F.coalesce(out, "_v"))
    return df.withColumn(out, both).drop("_shard", "_v")
