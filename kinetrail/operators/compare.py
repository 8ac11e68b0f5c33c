"""Whole comparisons of groups: omnibus and pairwise tests with effect sizes and corrected p-values, one-sample tests, tests of each
cluster, and two-part tests of presence and size.

Values are reduced to counts of distinct values in ranges before anything is compared, for all groups and pairs in one pass.
Groups are a handful and are named on the driver; p-values are those of the asymptotic distributions, exact only for the
signed-rank test of few differences. Null groups and values are left out; groups of fewer than ``least`` values are reported, not tested.
"""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.functions import tails
from kinetrail.operators import stats as S
from kinetrail.plans.ranks import cumulated
from kinetrail.plans.runtime import cut

LEAST = 3


def group_sizes(df: DataFrame, group: str, value: str, least: int = LEAST) -> DataFrame:
    """group, n, mean, cv (population deviation over mean, null where the mean is 0), kept."""
    p = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("_s"))
    return p.select(group, "n", "mean", F.try_divide("_s", "mean").alias("cv"), (F.col("n") >= least).alias("kept"))


def tested(df: DataFrame, group: str, value: str, least: int = LEAST) -> tuple[DataFrame, list]:
    """The rows of the groups that are large enough, and these groups in order."""
    names = sorted(r[0] for r in group_sizes(df, group, value, least).where("kept").select(group).collect())  # a handful
    return df.where(F.col(group).isin(names) & F.col(value).isNotNull()).select(F.col(group).alias("g"), F.col(value).cast("double").alias("v")), names


def _cumulative(p: DataFrame, names: list) -> DataFrame:
    """Distinct values with each group's count at and below: k0.., b0..."""
    k = [F.count_if(F.col("g") == F.lit(n)).alias(f"k{i}") for i, n in enumerate(names)]
    h = p.groupBy("v").agg(*k).withColumn("_r", S._range(F.col("v")))
    sums = h.groupBy("_r").agg(*[F.sum(f"k{i}").alias(f"s{i}") for i in range(len(names))])
    w = W.orderBy("_r").rowsBetween(W.unboundedPreceding, -1)  # one row a range
    sums = sums.select("_r", *[F.coalesce(F.sum(f"s{i}").over(w), F.lit(0)).alias(f"s{i}") for i in range(len(names))])
    inside = W.partitionBy("_r").orderBy("v").rowsBetween(W.unboundedPreceding, -1)
    h = h.join(sums, "_r")
    return h.select("v", *[f"k{i}" for i in range(len(names))], *[(F.col(f"s{i}") + F.coalesce(F.sum(f"k{i}").over(inside), F.lit(0))).alias(f"b{i}") for i in range(len(names))])


def pairwise(df: DataFrame, group: str, value: str, least: int = LEAST) -> DataFrame:
    """Every pair of groups: n_a, n_b, mean_a, mean_b, u, z, ks, t, df, cliffs_delta, cohens_d. Empty with fewer than two groups."""
    p, names = tested(df, group, value, least)
    kind = dict(df.dtypes)[group]
    schema = f"group_a {kind}, group_b {kind}, n_a bigint, n_b bigint, mean_a double, mean_b double, u double, z double, ks double, t double, df double, cliffs_delta double, cohens_d double"
    if len(names) < 2:
        return df.sparkSession.createDataFrame([], schema)
    c = cut(_cumulative(p, names))
    n = c.agg(*[F.sum(f"k{i}").alias(f"n{i}") for i in range(len(names))])
    c = c.join(F.broadcast(n))
    pairs = list(itertools.combinations(range(len(names)), 2))
    aggs = []
    for i, j in pairs:
        a, b = F.col(f"k{i}"), F.col(f"k{j}")
        aggs.append(F.sum(a * (F.col(f"b{j}") + b / 2)).alias(f"u{i}_{j}"))
        aggs.append(F.sum(F.pow(a + b, F.lit(3)) - a - b).alias(f"t{i}_{j}"))
        aggs.append(F.max(F.abs((F.col(f"b{i}") + a) / F.col(f"n{i}") - (F.col(f"b{j}") + b) / F.col(f"n{j}"))).alias(f"k{i}_{j}"))
    one = c.agg(*aggs)
    rows = F.array(*[F.struct(F.lit(names[i]).alias("group_a"), F.lit(names[j]).alias("group_b"), F.col(f"u{i}_{j}").alias("u"), F.col(f"t{i}_{j}").alias("ties"), F.col(f"k{i}_{j}").alias("ks")) for i, j in pairs])
    r = one.select(F.explode(rows).alias("r")).select("r.*")
    m = S.moments(p, "g", "v")
    side = lambda s: m.select(F.col("g").alias(f"group_{s}"), F.col("n").alias(f"n_{s}"), F.col("mean").alias(f"mean_{s}"), F.col("var").alias(f"var_{s}"))
    r = r.join(F.broadcast(side("a")), "group_a").join(F.broadcast(side("b")), "group_b")
    na, nb, va, vb = (F.col(x) for x in ("n_a", "n_b", "var_a", "var_b"))
    total = (na + nb).cast("double")
    sd = F.sqrt(na * nb / 12 * (total + 1 - F.col("ties") / (total * (total - 1))))
    diff, sa, sb = F.col("mean_a") - F.col("mean_b"), va / na, vb / nb
    return r.select(
        F.col("group_a").cast(kind).alias("group_a"), F.col("group_b").cast(kind).alias("group_b"), "n_a", "n_b", "mean_a", "mean_b", "u",
        F.try_divide(F.greatest(F.abs(F.col("u") - na * nb / 2) - 0.5, F.lit(0.0)), sd).alias("z"), "ks", F.try_divide(diff, F.sqrt(sa + sb)).alias("t"),
        F.try_divide((sa + sb) * (sa + sb), sa * sa / (na - 1) + sb * sb / (nb - 1)).alias("df"), (2 * F.col("u") / (na * nb) - 1).alias("cliffs_delta"),
        F.try_divide(diff, F.sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2))).alias("cohens_d"),
    )


def pairwise_p(pairs: DataFrame) -> DataFrame:
    """``pairwise`` with mannwhitney_p, ks_p, welch_t_p and the corrected ones of the first two; ``stars`` by the corrected."""
    p = pairs.withColumn("mannwhitney_p", tails.p_normal(F.col("z"))).withColumn("ks_p", tails.p_kolmogorov(F.col("ks"), F.col("n_a"), F.col("n_b"))).withColumn("welch_t_p", tails.p_student(F.col("t"), F.col("df")))
    p = S.bh_fdr(S.bh_fdr(cut(p), "mannwhitney_p", "mannwhitney_p_fdr"), "ks_p", "ks_p_fdr")
    return p.withColumn("stars", stars(F.col("mannwhitney_p_fdr")))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("")


def omnibus(df: DataFrame, group: str, value: str, least: int = LEAST) -> DataFrame:
    """One row: levene_stat, levene_p, the name, statistic and p of the omnibus test (Kruskal-Wallis, of two groups Mann-Whitney),
    the number of groups tested and dropped; ok false and nulls with fewer than two groups."""
    p, names = tested(df, group, value, least)
    sizes = group_sizes(df, group, value, least).agg(F.count_if("kept").alias("n_groups"), F.count_if(~F.col("kept")).alias("n_dropped"))
    null = lambda c: F.lit(None).cast("double").alias(c)
    if len(names) < 2:
        return sizes.select("n_groups", "n_dropped", F.lit(False).alias("ok"), null("levene_stat"), null("levene_p"), F.lit(None).cast("string").alias("omnibus_name"), null("omnibus_stat"), null("omnibus_p"))
    lev = S.levene(p, "g", "v").select(F.col("w").alias("levene_stat"), tails.p_f(F.col("w"), F.col("df_between"), F.col("df_within")).alias("levene_p"))
    if len(names) > 2:
        o = S.kruskal(p, "g", "v").select(F.lit("kruskal_wallis").alias("omnibus_name"), F.col("h").alias("omnibus_stat"), tails.p_chi2(F.col("h"), F.col("df")).alias("omnibus_p"))
    else:
        o = pairwise(df, group, value, least).select(F.lit("mann_whitney_u").alias("omnibus_name"), F.col("u").alias("omnibus_stat"), tails.p_normal(F.col("z")).alias("omnibus_p"))
    return sizes.join(F.broadcast(lev)).join(F.broadcast(o)).select("n_groups", "n_dropped", F.lit(True).alias("ok"), "levene_stat", "levene_p", "omnibus_name", "omnibus_stat", "omnibus_p")


def posthoc_dunn(df: DataFrame, group: str, value: str, least: int = LEAST) -> DataFrame:
    p, _ = tested(df, group, value, least)
    d = S.dunn(p, "g", "v")
    return S.bh_fdr(cut(d.withColumn("dunn_p", tails.p_normal(F.col("z")))), "dunn_p", "dunn_p_fdr")


def normality(df: DataFrame, group: str, value: str, most: int = 5000) -> DataFrame:
    """group, n, w, p of the Shapiro-Wilk test of the groups of 3 to ``most`` values; null for others, which are not gathered."""
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(value).alias("n"))
    few = cut(sizes.where((F.col("n") >= 3) & (F.col("n") <= most)).select(group))
    rows = df.where(F.col(value).isNotNull()).select(group, F.col(value).cast("double").alias("v")).join(F.broadcast(few), group)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        w, p = tails.shapiro_wilk(pdf["v"].to_numpy())
        return pd.DataFrame({group: pdf[group].iloc[:1], "w": [w], "p": [p]})

    t = rows.groupBy(group).applyInPandas(run, f"{group} {dict(df.dtypes)[group]}, w double, p double")
    return sizes.join(t, group, "left")


def one_sample(df: DataFrame, group: str, value: str, reference: float, *, ranks: bool = False) -> DataFrame:
    """exp_group, n, mean, ref, stat, pval, effect_size_cohens_d, test_type, qval. One value: stat and effect null, p 1; no spread:
    the effect is null; with ``ranks`` the signed-rank test, of which all equal to the reference gives 0 and p 1."""
    p = df.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(group).alias("exp_group"), F.col(value).cast("double").alias("v"))
    m = p.groupBy("exp_group").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    m = m.withColumn("effect_size_cohens_d", F.when(F.col("sd") > 0, (F.col("mean") - reference) / F.col("sd"))).withColumn("ref", F.lit(float(reference)))
    if ranks:
        d = p.withColumn("d", F.col("v") - reference).where("d <> 0").withColumn("v", F.abs("d"))
        r = ranks_by(d, ["exp_group"], "v")
        h = d.groupBy("exp_group", "v").agg(F.count_if(F.col("d") > 0).alias("up"), F.count("*").alias("k")).join(r, ["exp_group", "v"])
        w = h.groupBy("exp_group").agg(F.sum("k").alias("nz"), F.sum(F.col("up") * F.col("avg_rank")).alias("w_plus"), F.sum((F.col("k") - F.col("up")) * F.col("avg_rank")).alias("w_minus"), F.sum(F.pow("k", F.lit(3)) - F.col("k")).alias("ties"))
        zero = lambda c: F.coalesce(c, F.lit(0)).cast("double")
        m = m.join(w, "exp_group", "left").withColumn("stat", F.least(zero("w_plus"), zero("w_minus")))
        m = m.withColumn("pval", tails.p_signed_rank(zero("nz"), zero("w_plus"), zero("w_minus"), zero("ties"))).withColumn("test_type", F.lit("wilcoxon_1samp"))
    else:
        m = m.withColumn("stat", F.col("effect_size_cohens_d") * F.sqrt("n")).withColumn("pval", F.coalesce(tails.p_student(F.col("stat"), F.when(F.col("n") > 1, F.col("n") - 1)), F.lit(1.0))).withColumn("test_type", F.lit("ttest_1samp"))
    out = m.select("exp_group", "n", "mean", "ref", "stat", "pval", "effect_size_cohens_d", "test_type")
    return S.bh_fdr(cut(out), "pval", "qval")


def ranks_by(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Distinct values of each group of ``by`` with their number of rows and average rank within the group."""
    return cumulated(df, by, value).select(*by, "v", "n", (F.col("before") + (F.col("n") + 1) / 2).alias("avg_rank"))


def cluster_kruskal(df: DataFrame, cluster: str, group: str, value: str, least: int = 2) -> DataFrame:
    """The Kruskal-Wallis test of every cluster over the groups that have ``least`` values or more in it: cluster, k, n, h, p, q (pooled
    over the clusters; tests that can't be made have null p and are not pooled)."""
    rows = df.where(F.col(cluster).isNotNull() & F.col(group).isNotNull() & F.col(value).isNotNull()).select(F.col(cluster).alias("c"), F.col(group).alias("g"), F.col(value).cast("double").alias("v"))
    big = rows.groupBy("c", "g").agg(F.count("*").alias("ng")).where(F.col("ng") >= least).drop("ng")
    rows = rows.join(F.broadcast(cut(big)), ["c", "g"], "left_semi")
    r = ranks_by(rows, ["c"], "v")
    per = rows.groupBy("c", "g", "v").agg(F.count("*").alias("k")).join(r, ["c", "v"])
    s = per.groupBy("c", "g").agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("avg_rank")).alias("r")).groupBy("c").agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("r") * F.col("r") / F.col("n")).alias("q"))
    t = r.groupBy("c").agg(F.sum(F.pow("n", F.lit(3)) - F.col("n")).alias("ties"))
    n = F.col("n").cast("double")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), 1 - F.col("ties") / (n * n * n - n))
    out = s.join(t, "c").select(F.col("c").alias(cluster), "k", "n", F.when(F.col("k") > 1, h).alias("h"))
    return S.bh_fdr(cut(out.withColumn("p", tails.p_chi2(F.col("h"), F.col("k") - 1))), "p", "q")


def two_part(df: DataFrame, cluster: str, group: str, value: str, alpha: float = 0.05) -> DataFrame:
    """Presence (value above 0) by group, and size among the present: cluster, prevalence_chi2, prevalence_p, magnitude_h, magnitude_p,
    sig_driver: prevalence, magnitude, both, none."""
    rows = df.where(F.col(cluster).isNotNull() & F.col(group).isNotNull() & F.col(value).isNotNull())
    s = rows.groupBy(cluster, group).agg(F.count_if(F.col(value) > 0).alias("y"), F.count_if(F.col(value) <= 0).alias("z"))
    t = s.groupBy(cluster).agg(F.sum("y").alias("ty"), F.sum("z").alias("tz"), F.count("*").alias("k"))
    e = lambda c: (F.col("y") + F.col("z")) * F.col(c) / (F.col("ty") + F.col("tz"))
    part = lambda c, t: F.coalesce(F.try_divide((F.col(c) - e(t)) * (F.col(c) - e(t)), e(t)), F.lit(0.0))
    chi = s.join(t, cluster).groupBy(cluster, "k").agg(F.sum(part("y", "ty") + part("z", "tz")).alias("prevalence_chi2"))
    chi = chi.withColumn("prevalence_p", tails.p_chi2(F.col("prevalence_chi2"), F.when(F.col("k") > 1, F.col("k") - 1)))
    size = cluster_kruskal(rows.where(F.col(value) > 0), cluster, group, value).select(cluster, F.col("h").alias("magnitude_h"), F.col("p").alias("magnitude_p"))
    a, b = F.coalesce(F.col("prevalence_p") < alpha, F.lit(False)), F.coalesce(F.col("magnitude_p") < alpha, F.lit(False))
    driver = F.when(a & b, "both").when(a, "prevalence").when(b, "magnitude").otherwise("none")
    return chi.join(size, cluster, "left").select(cluster, "prevalence_chi2", "prevalence_p", "magnitude_h", "magnitude_p", driver.alias("sig_driver"))


def volcano(df: DataFrame, cluster: str, group: str, value: str, a, b, top: int | None = None) -> DataFrame:
    """cluster, log2 of the ratio of the two groups' means, p of Welch's test and -log10 of it; the ``top`` smallest p (ties by
    cluster) if asked."""
    rows = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    of = lambda g, f: f(F.when(F.col(group) == g, F.col(value)))
    m = rows.groupBy(cluster).agg(*[of(g, f).alias(f"{n}{i}") for i, g in enumerate((a, b)) for n, f in (("n", F.count), ("m", F.avg), ("v", F.var_samp))])
    sa, sb = F.col("v0") / F.col("n0"), F.col("v1") / F.col("n1")
    t = F.try_divide(F.col("m0") - F.col("m1"), F.sqrt(sa + sb))
    df_ = F.try_divide((sa + sb) * (sa + sb), sa * sa / (F.col("n0") - 1) + sb * sb / (F.col("n1") - 1))
    out = m.select(cluster, F.log2(F.try_divide("m0", "m1")).alias("log2_ratio"), t.alias("t"), df_.alias("df")).withColumn("p", tails.p_student(F.col("t"), F.col("df")))
    out = out.withColumn("neg_log10_p", -F.log10("p"))
    return out.orderBy(F.col("p").asc_nulls_last(), cluster).limit(top) if top else out


def symmetric_matrix(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """A pairwise table as rows for both directions: row, col, value; the diagonal is null."""
    p = pairs.select(F.col(a).alias("row"), F.col(b).alias("col"), F.col(value).alias("value"))
    both = p.unionByName(p.select(F.col("col").alias("row"), F.col("row").alias("col"), "value"))
    return both.unionByName(both.select("row", F.col("row").alias("col"), F.lit(None).cast("double").alias("value")).distinct())


def first_members(df: DataFrame, group: str, member: str, n: int) -> DataFrame:
    """The first ``n`` members of each group by name."""
    d = df.where(F.col(group).isNotNull() & F.col(member).isNotNull()).select(group, member).distinct()
    return d.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(member))).where(F.col("rank") <= n)


def pick_landmark(parts: DataFrame, key: str, position: str, name: str, wanted: Column) -> DataFrame:
    """The first body part of each key for which ``wanted`` holds, else the one at the lowest position."""
    return parts.groupBy(key).agg(F.coalesce(F.min_by(F.when(wanted, F.col(name)), F.when(wanted, F.col(position))), F.min_by(name, position)).alias("picked"))


def memory_tier(free_gb: Column) -> Column:
    """Batch size for the memory that is free, of which 85 % count."""
    g = free_gb * 0.85
    return F.when(g >= 10, 32).when(g >= 5, 16).otherwise(8)
