"""Group statistics over tables of values: ranks, tests, effect sizes, corrections, agreement of labellings.

Global ranks come from the histogram of distinct values, not from a sort of all rows in one task: the counts of ranges of the
value are summed first and each range is ranked by itself. Nulls are left out before everything; NaN is null from the source on.
Groups are experimental groups, a handful; statistics over their pairs are over summaries.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.plans.ranks import quantiles, value_range
from kinetrail.plans.runtime import join_dim, settled


def _present(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v"))


_range = value_range


def average_ranks(df: DataFrame, value: str) -> DataFrame:
    """Distinct values with their number of rows and average rank (1 is the smallest)."""
    h = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count("*").alias("n")).withColumn("_r", _range(F.col("v")))
    sums = h.groupBy("_r").agg(F.sum("n").alias("_n"))
    sums = sums.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")  # one row a range
    h = h.join(sums, "_r")
    below = F.col("_before") + F.coalesce(F.sum("n").over(W.partitionBy("_r").orderBy("v").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return h.withColumn("avg_rank", below + (F.col("n") + 1) / 2).select("v", "n", "avg_rank")


def rank_sums(df: DataFrame, group: str, value: str) -> DataFrame:
    """Per group n and rank sum of the pooled average ranks, with the tie term sum(t^3 - t) and N of the pool."""
    p = _present(df, group, value)
    per = p.groupBy("g", "v").agg(F.count("*").alias("k"))
    r = average_ranks(p, "v")
    s = per.join(r, "v").groupBy("g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("avg_rank")).alias("rank_sum"))
    pool = r.agg(F.sum("n").alias("total"), F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    return s.join(F.broadcast(pool)).withColumnRenamed("g", group)


def kruskal(df: DataFrame, group: str, value: str) -> DataFrame:
    """H with the tie correction, degrees of freedom and N."""
    s = rank_sums(df, group, value)
    a = s.agg(F.sum(F.pow("rank_sum", F.lit(2)) / F.col("n")).alias("q"), F.max("total").alias("total"), F.max("ties").alias("ties"), (F.count("*") - 1).alias("df"))
    n = F.col("total").cast("double")
    h = 12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)
    return a.select(F.try_divide(h, 1 - F.col("ties") / (n * n * n - n)).alias("h"), "df", F.col("total").alias("n"))


def _pairs(s: DataFrame, group: str) -> DataFrame:
    """Pairs of a few summary rows, the first group the smaller."""
    rows = s.agg(F.collect_list(F.struct(*s.columns)).alias("r")).select(F.explode("r").alias("a"), "r").select("a", F.explode("r").alias("b"))
    return rows.where(F.col(f"a.{group}") < F.col(f"b.{group}"))


def dunn(df: DataFrame, group: str, value: str) -> DataFrame:
    s = rank_sums(df, group, value)
    p = _pairs(s, group)
    n = F.col("a.total").cast("double")
    var = (n * (n + 1) / 12 - F.col("a.ties") / (12 * (n - 1))) * (1 / F.col("a.n") + 1 / F.col("b.n"))
    z = (F.col("a.rank_sum") / F.col("a.n") - F.col("b.rank_sum") / F.col("b.n")) / F.sqrt(var)
    return p.select(F.col(f"a.{group}").alias("group_a"), F.col(f"b.{group}").alias("group_b"), z.alias("z"))


def cumulative(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Distinct values of two groups with each one's count at and below: v, ka, kb, below_a, below_b (strictly below)."""
    p = _present(df, group, value).where(F.col("g").isin(a, b))
    h = p.groupBy("v").agg(F.count_if(F.col("g") == a).alias("ka"), F.count_if(F.col("g") == b).alias("kb")).withColumn("_r", _range(F.col("v")))
    sums = h.groupBy("_r").agg(F.sum("ka").alias("_a"), F.sum("kb").alias("_b"))
    w = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sums = sums.select("_r", F.coalesce(F.sum("_a").over(w), F.lit(0)).alias("_a"), F.coalesce(F.sum("_b").over(w), F.lit(0)).alias("_b"))
    i = W.partitionBy("_r").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    h = h.join(sums, "_r")
    return h.select("v", "ka", "kb", (F.col("_a") + F.coalesce(F.sum("ka").over(i), F.lit(0))).alias("below_a"), (F.col("_b") + F.coalesce(F.sum("kb").over(i), F.lit(0))).alias("below_b"))


def two_sample(df: DataFrame, group: str, value: str, a, b) -> DataFrame:
    """Mann-Whitney U of the first group, Cliff's delta, the two-sided p of the normal approximation (tie-corrected, with
    continuity), and the Kolmogorov-Smirnov distance, in one pass over distinct values."""
    c = cumulative(df, group, value, a, b)
    s = c.agg(
        F.sum("ka").alias("na"), F.sum("kb").alias("nb"),
        F.sum(F.col("ka") * (F.col("below_b") + F.col("kb") / 2)).alias("u"), F.sum(F.pow(F.col("ka") + F.col("kb"), F.lit(3)) - F.col("ka") - F.col("kb")).alias("ties"),
    )
    n = (F.col("na") + F.col("nb")).cast("double")
    ks = c.join(F.broadcast(s)).agg(F.max(F.abs((F.col("below_a") + F.col("ka")) / F.col("na") - (F.col("below_b") + F.col("kb")) / F.col("nb"))).alias("ks"))
    sd = F.sqrt(F.col("na") * F.col("nb") / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = (F.abs(F.col("u") - F.col("na") * F.col("nb") / 2) - 0.5) / sd
    return s.join(F.broadcast(ks)).select("na", "nb", "u", (2 * F.col("u") / (F.col("na") * F.col("nb")) - 1).alias("cliffs_delta"), z.alias("z"), two_sided(z).alias("p"), "ks")


def two_sided(z: Column) -> Column:
    """Two-sided normal tail probability of a z, by Abramowitz and Stegun's rational form of erfc (error below 1.2e-7)."""
    x = F.abs(z) / math.sqrt(2)
    t = 1 / (1 + 0.5 * x)
    # fixed values: the coefficients of the published approximation
    terms = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
    poly = F.lit(terms[-1])
    for c in reversed(terms[:-1]):
        poly = poly * t + c
    return t * F.exp(-x * x + poly)


def moments(df: DataFrame, group: str, value: str) -> DataFrame:
    return _present(df, group, value).groupBy(F.col("g").alias(group)).agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.var_samp("v").alias("var"))


def welch(df: DataFrame, group: str, value: str) -> DataFrame:
    p = _pairs(moments(df, group, value), group)
    sa, sb = F.col("a.var") / F.col("a.n"), F.col("b.var") / F.col("b.n")
    pooled = F.sqrt(((F.col("a.n") - 1) * F.col("a.var") + (F.col("b.n") - 1) * F.col("b.var")) / (F.col("a.n") + F.col("b.n") - 2))
    return p.select(
        F.col(f"a.{group}").alias("group_a"), F.col(f"b.{group}").alias("group_b"), F.try_divide(F.col("a.mean") - F.col("b.mean"), F.sqrt(sa + sb)).alias("t"),
        F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("a.n") - 1) + sb * sb / (F.col("b.n") - 1)).alias("df"), F.try_divide(F.col("a.mean") - F.col("b.mean"), pooled).alias("cohens_d"),
    )


def levene(df: DataFrame, group: str, value: str) -> DataFrame:
    """Brown-Forsythe W: one-way F of the distances from the group medians."""
    p = _present(df, group, value)
    m = settled(quantiles(p, ["g"], "v", {"m": 0.5}))
    return anova(join_dim(p, m, ["g"], "inner").withColumn("z", F.abs(F.col("v") - F.col("m"))), "g", "z").select(F.col("f").alias("w"), "df_between", "df_within")


def anova(df: DataFrame, group: str, value: str) -> DataFrame:
    """One-way F and eta squared from the groups' sums."""
    s = _present(df, group, value).groupBy("g").agg(F.count("v").alias("n"), F.avg("v").alias("m"), F.var_pop("v").alias("s2"))
    a = s.agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"), F.count("*").alias("k"), F.sum(F.col("n") * F.col("s2")).alias("within"))
    b = s.join(F.broadcast(a.select("gm"))).agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("gm"), F.lit(2))).alias("between"))
    out = a.join(F.broadcast(b)).withColumn("df_between", F.col("k") - 1).withColumn("df_within", F.col("n") - F.col("k"))
    f = F.try_divide(F.col("between") / F.col("df_between"), F.col("within") / F.col("df_within"))
    return out.select(f.alias("f"), F.try_divide("between", F.col("between") + F.col("within")).alias("eta_squared"), "df_between", "df_within")


def bh_fdr(df: DataFrame, p: str, out: str = "q") -> DataFrame:
    """Benjamini-Hochberg q of a family of tests (a small table); null p stays null and is not counted."""
    n = F.count(p).over(W.partitionBy())
    rank = F.row_number().over(W.orderBy(F.col(p).asc_nulls_last()))
    raw = F.when(F.col(p).isNotNull(), F.col(p) * n / rank)
    d = df.withColumn("_raw", raw)
    w = W.orderBy(F.col(p).asc_nulls_last()).rangeBetween(0, W.unboundedFollowing)
    return d.withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.lit(1.0), F.min("_raw").over(w)))).drop("_raw")


def one_sample(df: DataFrame, group: str, value: str, reference: float) -> DataFrame:
    m = moments(df, group, value)
    d = F.try_divide(F.col("mean") - reference, F.sqrt("var"))
    return m.select(group, "n", "mean", F.lit(reference).alias("ref"), (d * F.sqrt("n")).alias("stat"), d.alias("effect_size_cohens_d"))


def wilcoxon(df: DataFrame, a: str, b: str) -> DataFrame:
    """Signed-rank sums of the paired differences a - b, zeros left out: n, w_plus, w_minus."""
    d = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).select((F.col(a) - F.col(b)).cast("double").alias("d")).where("d <> 0").withColumn("size", F.abs("d"))
    r = average_ranks(d, "size")
    h = d.groupBy("size").agg(F.count_if(F.col("d") > 0).alias("up"), F.count_if(F.col("d") < 0).alias("down"))
    return h.join(r, h["size"] == r["v"]).agg(F.sum(F.col("up") + F.col("down")).alias("n"), F.sum(F.col("up") * F.col("avg_rank")).alias("w_plus"), F.sum(F.col("down") * F.col("avg_rank")).alias("w_minus"))


def friedman(df: DataFrame, block: str, level: str, value: str, levels: list) -> DataFrame:
    """Friedman chi squared over the blocks that have every level; ties within a block share their ranks."""
    full = df.where(F.col(level).isin(levels) & F.col(value).isNotNull()).groupBy(block).agg(F.collect_list(F.struct(level, F.col(value).alias("v"))).alias("x")).where(F.size("x") == len(levels))
    # a block holds one row a level
    ranked = full.select(F.explode(F.transform("x", lambda e: F.struct(e[level].alias("l"), F.aggregate("x", F.lit(0.5), lambda s, o: s + F.when(o["v"] < e["v"], 1.0).when(o["v"] == e["v"], 0.5).otherwise(0.0)).alias("r")))).alias("e"))
    s = ranked.groupBy("e.l").agg(F.sum("e.r").alias("r"), F.count("*").alias("n"))
    ties = full.select(F.aggregate("x", F.lit(0.0), lambda s, e: s + F.pow(F.size(F.filter("x", lambda o: o["v"] == e["v"])), F.lit(2)) - 1).alias("t")).agg(F.sum("t").alias("t"))
    k = len(levels)
    a = s.agg(F.sum(F.pow("r", F.lit(2))).alias("q"), F.max("n").alias("n")).join(F.broadcast(ties))
    n = F.col("n").cast("double")
    chi = (12 / (n * k * (k + 1)) * F.col("q") - 3 * n * (k + 1)) / (1 - F.col("t") / (n * (k**3 - k)))
    return a.select(chi.alias("chi2"), F.col("n").cast("bigint").alias("n"))


def prevalence(df: DataFrame, group: str, present: Column) -> DataFrame:
    """Chi squared of presence by group."""
    s = df.groupBy(group).agg(F.count_if(present).alias("yes"), F.count_if(~present).alias("no"))
    t = s.agg(F.sum("yes").alias("y"), F.sum("no").alias("z"))
    e = lambda c: (F.col("yes") + F.col("no")) * F.col(c) / (F.col("y") + F.col("z"))
    return s.join(F.broadcast(t)).agg(F.sum(F.try_divide(F.pow(F.col("yes") - e("y"), F.lit(2)), e("y")) + F.try_divide(F.pow(F.col("no") - e("z"), F.lit(2)), e("z"))).alias("chi2"), (F.count("*") - 1).alias("df"))


def mean_ci(df: DataFrame, group: str, value: str) -> DataFrame:
    m = moments(df, group, value)
    return m.select(group, "n", "mean", (1.96 * F.sqrt("var") / F.sqrt("n")).alias("ci95"))


def representative(df: DataFrame, group: str, member: str, value: str) -> DataFrame:
    """The member nearest to its group's median; ties by the member."""
    m = settled(quantiles(df.where(F.col(group).isNotNull()), [group], value, {"_m": 0.5}))
    return join_dim(df.where(F.col(value).isNotNull()), m, [group], "inner").groupBy(group).agg(F.min_by(member, F.struct(F.abs(F.col(value) - F.col("_m")), F.col(member))).alias(member))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, Cohen's kappa, balanced accuracy (a is the truth) from the contingency table."""
    c = contingency(df, a, b).withColumn("ra", F.sum("n").over(W.partitionBy("a"))).withColumn("cb", F.sum("n").over(W.partitionBy("b")))
    two = lambda x: F.col(x) * (F.col(x) - 1) / 2
    rows = c.groupBy("a").agg(F.max("ra").alias("r"), F.max(F.when(F.col("a") == F.col("b"), F.col("n"))).alias("hit"))
    cols = c.groupBy("b").agg(F.max("cb").alias("c"))
    s = c.agg(F.sum("n").alias("n"), F.sum(two("n")).alias("ij")).join(F.broadcast(rows.agg(F.sum(two("r")).alias("i"), F.sum(F.coalesce("hit", F.lit(0))).alias("hits"), F.avg(F.coalesce("hit", F.lit(0)) / F.col("r")).alias("balanced_accuracy"))))
    s = s.join(F.broadcast(cols.agg(F.sum(two("c")).alias("j"))))
    chance = rows.join(cols, rows["a"] == cols["b"]).agg(F.sum(F.col("r") * F.col("c")).alias("e"))
    s = s.join(F.broadcast(chance))
    pairs = two("n")
    want = F.col("i") * F.col("j") / pairs
    pe = F.coalesce("e", F.lit(0)) / (F.col("n") * F.col("n"))
    po = F.col("hits") / F.col("n")
    return s.select("n", F.try_divide(F.col("ij") - want, (F.col("i") + F.col("j")) / 2 - want).alias("ari"), F.try_divide(po - pe, 1 - pe).alias("kappa"), "balanced_accuracy")


def jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """For each cluster of a the best matching cluster of b by Jaccard; ties by b."""
    c = contingency(df, a, b).withColumn("ra", F.sum("n").over(W.partitionBy("a"))).withColumn("cb", F.sum("n").over(W.partitionBy("b")))
    c = c.withColumn("jaccard", F.col("n") / (F.col("ra") + F.col("cb") - F.col("n")))
    return c.groupBy("a").agg(F.min_by(F.struct("b", "jaccard"), F.struct((-F.col("jaccard")).alias("j"), "b")).alias("m")).select("a", "m.b", "m.jaccard")


def coassociation(runs: DataFrame, runs_n: int) -> DataFrame:
    """Fraction of runs in which two items share a cluster. ``runs``: run, cluster, item. Works on groups of equal label
    signatures (the label in every run) and their pairs, never on pairs of items: sig_a, sig_b, size_a, size_b, share."""
    sig = runs.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("run", "cluster"))).alias("s")).groupBy("s").agg(F.count("*").alias("size"), F.min("item").alias("sig"))
    one = sig.select("sig", "size", F.explode("s").alias("e"))
    a, b = one.select(F.col("sig").alias("sig_a"), F.col("size").alias("size_a"), "e"), one.select(F.col("sig").alias("sig_b"), F.col("size").alias("size_b"), "e")
    return a.join(b, "e").where("sig_a <= sig_b").groupBy("sig_a", "sig_b", "size_a", "size_b").agg((F.count("*") / runs_n).alias("share"))
