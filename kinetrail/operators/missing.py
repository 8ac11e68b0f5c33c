"""Filling missing values from similar records, with a flag and the level each fill came from.

``fill_hierarchical`` looks for the finest group with enough support and backs off to coarser ones. Only the groups that
hold a missing value are summarised: their keys prefilter the values before anything is shuffled. What one level filled is
cut off before the next, which sees only the rest and ends early when nothing is left.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.plans.runtime import cut, fits_broadcast, join_dim, latest, nan_to_null, table

#: A fixed number counts as a stand-in for a missing value when it is written this often, in two tracks or more, and the
#: readings within ``NEAR_BINS`` bins of it are fewer than ``NEAR_SHARE`` of its own.
SENTINEL_LEAST, NEAR_BINS, NEAR_SHARE = 3, 5, 0.3
#: Readings in a bin that stands alone, from which its exact values are counted.
CROWDED = 20
#: Hashes of asked groups (counted as ``fits_broadcast`` does) up to which they are broadcast themselves, and words of the sieve.
NEED_BYTES, SIEVE_WORDS = 8 * 1024 * 1024, 1 << 20
BLOCK_FRAMES = 32
MIN_SUPPORT = 3
#: Levels of the driver's queries, finest first: neighbouring frames, the track, the source's body part, the source.
LEVELS = [
    ["session_id", "bodypart", "block", "field"],
    ["session_id", "bodypart", "field"],
    ["source", "bodypart", "field"],
    ["source", "field"],
]


def bin_width(field):
    """Width of the bins of ``find_sentinels``: one pixel, or a hundredth for a likelihood or share."""
    return F.when(field.isin("likelihood", "ll_frac"), F.lit(0.01)).otherwise(F.lit(1.0))


def value_bins(values: DataFrame, by: list[str]) -> DataFrame:
    """Counts of the values in narrow bins ``b``: by, b, n, their bounds, bounds of ``unit``, and the number on the bin's edge. The
    state is the range of the values over the width of a bin, whatever the number of rows; partial counts are merged before
    the shuffle. Nulls and NaN are passed over, as are 0 and 1 of a likelihood or share, which are true values."""
    width = bin_width(F.col("field"))
    bound = F.col("field").isin("likelihood", "ll_frac") & F.col("value").isin(0.0, 1.0)
    values = values.where(F.col("value").isNotNull() & ~F.isnan("value") & ~bound).withColumn("b", F.floor(F.col("value") / width + 1e-9))
    edge = F.abs(F.col("value") - F.col("b") * width) < 1e-9
    return values.groupBy(*by, "b").agg(
        F.count("*").alias("n"),
        F.min("value").alias("lo"),
        F.max("value").alias("hi"),
        F.min("unit").alias("u0"),
        F.max("unit").alias("u1"),
        F.count_if(edge).alias("n_edge"),
        F.min(F.when(edge, F.col("value"))).alias("at_edge"),
        F.min(F.when(edge, F.col("unit"))).alias("e0"),
        F.max(F.when(edge, F.col("unit"))).alias("e1"),
    )


def find_sentinels(values: DataFrame, bins: DataFrame | None = None) -> DataFrame:
    """Fixed numbers that a source writes in place of a value: columns source, field, value.

    ``values``: ``source``, ``field``, ``value`` double, ``unit`` bigint (a hash of the track the value is from). ``bins``: its
    ``value_bins`` by source and field, or finer, where they are there already. A sentinel is one number written at least
    ``SENTINEL_LEAST`` times in at least two tracks while the other readings of its bin and of the neighbouring bins are fewer
    than ``NEAR_SHARE`` of it. A number on the edge of its bin (any whole number) is counted in the one pass; a second pass over
    exact values follows only where a crowded bin stands alone without such a number. A null source is a source of its own.
    """
    if bins is None:
        bins = value_bins(values, ["source", "field"])
    low, high, total = (lambda c: F.min(c).alias(c)), (lambda c: F.max(c).alias(c)), (lambda c: F.sum(c).alias(c))
    bins = cut(bins.groupBy("source", "field", "b").agg(total("n"), low("lo"), high("hi"), low("u0"), high("u1"), total("n_edge"), low("at_edge"), low("e0"), high("e1")))
    bins = bins.withColumn("_s", F.coalesce("source", F.lit("")))
    # a source and field have as many rows here as bins
    near = W.partitionBy("_s", "field").orderBy("b").rangeBetween(-NEAR_BINS, NEAR_BINS)
    bins = bins.withColumn("all", F.sum("n").over(near)).where(f"n >= {SENTINEL_LEAST} and u0 <> u1")
    by_edge = (F.col("n_edge") >= SENTINEL_LEAST) & (F.col("e0") != F.col("e1")) & (F.col("all") - F.col("n_edge") < NEAR_SHARE * F.col("n_edge"))
    by_bin = (F.col("lo") == F.col("hi")) & (F.col("all") - F.col("n") < NEAR_SHARE * F.col("n"))
    found = bins.where(by_edge | by_bin).select("source", "field", F.when(by_edge, F.col("at_edge")).otherwise(F.col("lo")).alias("value"))
    crowded = bins.where(~by_edge & ~by_bin & (F.col("n") >= CROWDED) & (F.col("all") - F.col("n") < NEAR_SHARE * F.col("n"))).select("_s", "field", "b", "all")
    if crowded.isEmpty():
        return found
    exact = values.where(F.col("value").isNotNull() & ~F.isnan("value")).withColumn("b", F.floor(F.col("value") / bin_width(F.col("field")) + 1e-9))
    exact = exact.withColumn("_s", F.coalesce("source", F.lit(""))).join(crowded, ["_s", "field", "b"])
    exact = exact.groupBy("source", "field", "value", "all").agg(F.count("*").alias("n"), F.min("unit").alias("u0"), F.max("unit").alias("u1"))
    return found.unionByName(exact.where(F.expr(f"n >= {SENTINEL_LEAST} and u0 <> u1 and all - n < {NEAR_SHARE} * n")).select("source", "field", "value"))


def bin_medians(bins: DataFrame, sentinels: DataFrame, keys: list[str], least: int = MIN_SUPPORT) -> DataFrame:
    """keys, _fill: the median of the values in ``bins`` (scope, field, b and the keys; ``sentinels`` by scope), exact to a bin and
    drawn between the bin's bounds by rank; groups of fewer than ``least`` values are left out."""
    marks = sentinels.select(F.coalesce("source", F.lit("")).alias("scope"), "field", F.floor(F.col("value") / bin_width(F.col("field")) + 1e-9).alias("b"), "value")
    marks = marks.groupBy("scope", "field", "b").agg(F.collect_set("value").alias("_m"))
    n = F.when(F.array_contains("_m", F.col("at_edge")), F.col("n") - F.col("n_edge")).when(F.col("_m").isNotNull(), F.lit(0)).otherwise(F.col("n"))
    h = bins.join(F.broadcast(marks) if fits_broadcast(marks) else marks, ["scope", "field", "b"], "left").withColumn("n", n).where("n > 0")
    for k in keys:
        h = h.where(F.col(k).isNotNull())
    h = h.groupBy(*keys, "b").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    w = W.partitionBy(*keys)  # a group has as many rows as bins
    h = h.withColumn("_upto", F.sum("n").over(w.orderBy("b").rowsBetween(W.unboundedPreceding, 0))).withColumn("_half", F.sum("n").over(w) / 2)
    h = h.where((F.col("_half") * 2 >= least) & (F.col("_upto") >= F.col("_half")) & (F.col("_upto") - F.col("n") < F.col("_half")))
    part = (F.col("_half") - (F.col("_upto") - F.col("n"))) / F.col("n")
    return h.select(*keys, (F.col("lo") + (F.col("hi") - F.col("lo")) * part).alias("_fill"))


def sentinel_map(sentinels: DataFrame) -> DataFrame:
    """One row per source: ``marks``, a map from field to its sentinels."""
    per = sentinels.groupBy("source", "field").agg(F.collect_set("value").alias("v"))
    return per.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("field", "v"))).alias("marks"))


def sieved(rows: DataFrame, need: DataFrame) -> DataFrame:
    """Rows whose ``_h`` is in ``need``, and some others that share a bit with one that is: a prefilter of fixed size, one row of
    ``SIEVE_WORDS`` words, where a broadcast of all hashes would weigh on the driver and a join would shuffle every row."""
    word, bit = F.pmod("_h", F.lit(SIEVE_WORDS)).cast("int"), F.pmod(F.shiftright("_h", 32), F.lit(64)).cast("int")
    set_ = need.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("v"))
    every = need.sparkSession.range(SIEVE_WORDS).select(F.col("id").cast("int").alias("w"), F.lit(0).cast("bigint").alias("v"))
    words = set_.unionByName(every).groupBy("w").agg(F.bit_or("v").alias("v"))
    sieve = cut(words.agg(F.sort_array(F.collect_list(F.struct("w", "v"))).alias("s")).select(F.col("s.v").alias("_bits")))
    hit = F.call_function("shiftrightunsigned", F.get("_bits", word), bit).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return rows.crossJoin(F.broadcast(sieve)).where(hit).drop("_bits")


def fill_hierarchical(
    cells: DataFrame, cases: DataFrame, levels: list[list[str]], *, value: str = "value", min_support: int = MIN_SUPPORT, how: str = "median",
    given: dict[int, DataFrame] | None = None,
) -> DataFrame:
    """Fill ``cases`` (rows without a value) from ``cells`` (rows with one).

    Returns the rows of ``cases`` with ``value`` (null when no level has support), ``fill_level`` (0 is the finest, null
    when not filled) and ``is_filled``. ``how`` is ``median`` for numbers (approximate to 1/1000 of the ranks from the
    second level on, exact below) or ``mode`` (the smallest of the most frequent) for categories. ``given`` has the statistics
    (keys, ``_fill``) of levels for which they are there already; the cells are not read for these.

    A null in a key of a level is a group of its own at no level: such rows go to the next. Empty tables give empty
    results; rows sent again weigh in as often as they are in ``cells``.
    """
    done, rest = [], cases
    for depth, keys in enumerate(levels):
        known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
        if given and depth in given:
            tried = cut(join_dim(rest, given[depth], keys, "left"))
            done.append(tried.where("_fill is not null").withColumn(value, F.col("_fill")).drop("_fill").withColumn("fill_level", F.lit(depth)))
            rest = tried.where("_fill is null").drop("_fill")
            continue
        h = F.xxhash64(*keys)
        need = cut(rest.where(known).select(h.alias("_h")).distinct())
        mine = cells.where(known & F.col(value).isNotNull()).withColumn("_h", h)
        mine = mine.join(F.broadcast(need), "_h", "left_semi") if fits_broadcast(need, NEED_BYTES) else sieved(mine, need)
        if how == "mode":
            # counts first: a hot group is merged to its distinct values before it is shuffled
            counts = mine.groupBy(*keys, value).agg(F.count("*").alias("_n"))
            stats = counts.groupBy(*keys).agg(F.min_by(value, F.struct((-F.col("_n")).alias("n"), F.col(value).alias("v"))).alias("_fill"), F.sum("_n").alias("_support"))
        else:
            middle = F.median(value) if depth == 0 and len(levels) > 1 else F.percentile_approx(value, 0.5, 1000)
            stats = mine.groupBy(*keys).agg(middle.alias("_fill"), F.count("*").alias("_support"))
        stats = cut(stats.where(F.col("_support") >= min_support).drop("_support"))
        tried = cut(join_dim(rest, stats, keys, "left"))
        done.append(tried.where("_fill is not null").withColumn(value, F.col("_fill")).drop("_fill").withColumn("fill_level", F.lit(depth)))
        rest = tried.where("_fill is null").drop("_fill")
        if rest.isEmpty():
            break
    cols = cases.columns
    done.append(rest.withColumn("fill_level", F.lit(None).cast("int")))
    out = reduce(lambda a, b: a.unionByName(b), [x.select(*cols, "fill_level") for x in done])
    return out.withColumn("is_filled", F.col("fill_level").isNotNull())


def sessions(spark, sf_dir: str) -> DataFrame:
    """One row per session, the last loaded."""
    s = table(spark, sf_dir, "session_data").where("session_id is not null")
    return latest(s.select("session_id", "source", "storage", "frame_w", "frame_h", "bodyparts", F.map_entries("ll_fracs").alias("fracs"), "loaded_at"), ["session_id"], "loaded_at")


def _cells(spark, sf_dir: str) -> DataFrame:
    """Every value of the three tables: session_id, source, bodypart, frame, field, value (null or NaN where missing)."""
    s = cut(sessions(spark, sf_dir))
    dim = s.select("session_id", "source")
    track = table(spark, sf_dir, "pose_track").where("session_id is not null").select("session_id", "frame", "bodypart", "x", "y", "likelihood")
    track = join_dim(track, dim, ["session_id"]).selectExpr(
        "session_id", "source", "bodypart", "frame", "stack(3, 'x', x, 'y', y, 'likelihood', likelihood) as (field, value)"
    )
    snap = table(spark, sf_dir, "pose_snapshot").where("session_id is not null").select("session_id", "frame", "xy")
    snap = join_dim(snap, s.select("session_id", "source", "bodyparts"), ["session_id"]).selectExpr(
        "session_id", "source", "bodyparts", "frame", "posexplode(transform(sequence(0, 2 * size(bodyparts) - 1), i -> get(xy, i))) as (i, value)"
    )
    snap = snap.selectExpr("session_id", "source", "get(bodyparts, i div 2) as bodypart", "frame", "if(i % 2 = 0, 'x', 'y') as field", "value")
    frac = s.selectExpr("session_id", "source", "explode(array_distinct(bodyparts)) as bodypart", "fracs").selectExpr(
        "session_id", "source", "bodypart", "cast(-1 as bigint) as frame", "'ll_frac' as field",
        "get(filter(fracs, e -> e.key = bodypart), 0).value as value",
    )
    return track.unionByName(snap).unionByName(frac)


def pose_cells(spark, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``_cells`` with sentinels, NaN and nulls all null, and ``block``, the run of neighbouring frames; the counts of the values
    in narrow bins by source and body part; and the sentinels. Sentinels of a coordinate or likelihood are those of its
    source; the shares in ``ll_fracs`` are all written by one loader."""
    scope = F.when(F.col("field") == "ll_frac", F.lit("*")).otherwise(F.coalesce("source", F.lit("")))
    cells = _cells(spark, sf_dir).withColumn("scope", scope)
    values = cells.withColumn("unit", F.xxhash64("session_id", "bodypart"))
    bins = cut(value_bins(values, ["scope", "source", "bodypart", "field"]))
    found = cut(find_sentinels(values.drop("source").withColumnRenamed("scope", "source"), bins.drop("source").withColumnRenamed("scope", "source")))
    marks = sentinel_map(found)
    cells = join_dim(cells, cut(marks.withColumnRenamed("source", "scope")), ["scope"])
    fixed = F.coalesce(F.array_contains(F.element_at("marks", F.col("field")), F.col("value")), F.lit(False))
    value = F.when(~fixed, nan_to_null(F.col("value")))
    return cells.select("session_id", "source", "bodypart", "frame", "field", value.alias("value"), F.floor(F.col("frame") / BLOCK_FRAMES).alias("block")), bins, found


def fill_pose(spark, sf_dir: str) -> DataFrame:
    """Every missing value of x, y, likelihood and ll_frac, filled: session_id, source, bodypart, frame, field, block,
    value, fill_level, is_filled. A row sent again gives one case. The cells are read four times: for the counts in bins, from
    which the sentinels and the medians of whole sources come, for the cases, and for the two levels within a track."""
    cells, bins, found = pose_cells(spark, sf_dir)
    cases = cut(cells.where("value is null").distinct())
    given = {k: bin_medians(bins, found, keys) for k, keys in enumerate(LEVELS) if "source" in keys}
    return fill_hierarchical(cells.where("value is not null"), cases, LEVELS, given=given)


def p3_found(spark, sf_dir: str) -> DataFrame:
    return fill_pose(spark, sf_dir).select("session_id", "bodypart", "frame", "field")


def p3_fills(spark, sf_dir: str) -> DataFrame:
    return fill_pose(spark, sf_dir).select("session_id", "source", "bodypart", "frame", "field", F.round("value", 6).alias("value"), "fill_level", "is_filled")
