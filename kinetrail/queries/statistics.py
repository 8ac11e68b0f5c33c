"""Group statistics over orders, line items, events and embeddings."""

from pyspark.sql import functions as F

from kinetrail.operators import stats as S
from kinetrail.plans.runtime import table
from kinetrail.queries.behaviour import FRAMES, r6


def orders(s, d):
    return table(s, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("grp"), (F.col("o_totalprice") / 100000).alias("v"))


def user_types(s, d):
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("v"))


def raters(s, d):
    e = table(s, d, "embeddings")
    return e.select("vec_id", F.col("label").alias("a"), F.when(F.col("vec_id") % 3 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("b"))


def fdr(s, d):
    p = S.dunn(orders(s, d), "grp", "v").withColumn("p", F.round(S.two_sided(F.round("z", 4)), 5))
    return r6(S.bh_fdr(p.select("group_a", "group_b", "p"), "p"))


def seeds(s, d):
    """Three label runs of the vectors: two roundings of their first value and the given label."""
    e = table(s, d, "embeddings")
    x = F.floor(F.get("embedding", F.lit(0)).cast("double") * 4)
    y = F.floor(F.get("embedding", F.lit(1)).cast("double") * 4)
    run = lambda k, c: e.select(F.col("vec_id").alias("item"), F.lit(k).alias("run"), c.cast("bigint").alias("cluster"))
    return run(0, x).unionByName(run(1, y)).unionByName(run(2, F.col("label")))


QUERIES = {
    "avg_ranks": lambda s, d: r6(S.average_ranks(table(s, d, "lineitem"), "l_extendedprice")),
    "rank_sums": lambda s, d: r6(S.rank_sums(orders(s, d), "grp", "v").select("grp", "n", "rank_sum")),
    "kruskal_h": lambda s, d: r6(S.kruskal(orders(s, d), "grp", "v")),
    "dunn_z": lambda s, d: r6(S.dunn(orders(s, d), "grp", "v")),
    "mannwhitney_ks_cliff": lambda s, d: r6(S.two_sample(orders(s, d), "grp", "v", "1-URGENT", "5-LOW").select("na", "nb", "u", "cliffs_delta", "z", "ks")),
    "welch_cohen": lambda s, d: r6(S.welch(orders(s, d), "grp", "v")),
    "levene_w": lambda s, d: r6(S.levene(orders(s, d), "grp", "v")),
    "anova_eta": lambda s, d: r6(S.anova(orders(s, d), "grp", "v")),
    "bh_fdr": fdr,
    "one_sample_t": lambda s, d: r6(S.one_sample(orders(s, d), "grp", "v", 1.5)),
    "wilcoxon_w": lambda s, d: r6(S.wilcoxon(table(s, d, "lineitem").select(F.round(F.col("l_discount") * 100).alias("x"), F.round(F.col("l_tax") * 100).alias("y")), "x", "y")),
    "friedman_q": lambda s, d: r6(S.friedman(user_types(s, d), "user_id", "event_type", "v", ["click", "purchase", "search", "view"])),
    "chi2_prevalence": lambda s, d: r6(S.prevalence(orders(s, d), "grp", F.col("v") > 2)),
    "mean_ci95": lambda s, d: r6(S.mean_ci(orders(s, d), "grp", "v")),
    "representative_member": lambda s, d: S.representative(table(s, d, "customer").select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", "c_custkey", "c_acctbal"),
    "contingency": lambda s, d: S.contingency(raters(s, d), "a", "b"),
    "label_agreement": lambda s, d: r6(S.agreement(raters(s, d), "a", "b")),
    "jaccard_match": lambda s, d: r6(S.jaccard(raters(s, d), "a", "b")),
    "coassociation": lambda s, d: r6(S.coassociation(seeds(s, d), 3)),
    "frame_size_mode": lambda s, d: table(s, d, "session_data").groupBy("source").agg(F.mode("frame_w", True).alias("frame_w"), F.mode("frame_h", True).alias("frame_h")),
}

O = "o AS (SELECT o_orderpriority AS grp, o_totalprice / 100000 AS v FROM orders WHERE o_totalprice IS NOT NULL)"
R = f"{O}, r AS (SELECT *, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM o), rs AS (SELECT grp, count(*) AS n, sum(rk) AS rank_sum FROM r GROUP BY 1), tt AS (SELECT sum(t * t * t - t) AS ties, sum(t) AS total FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM o GROUP BY v))"
D = f"{R}, dz AS (SELECT a.grp AS group_a, b.grp AS group_b, (a.rank_sum / a.n - b.rank_sum / b.n) / sqrt((total * (total + 1) / 12 - ties / (12 * (total - 1))) * (1.0 / a.n + 1.0 / b.n)) AS z FROM rs a, rs b, tt WHERE a.grp < b.grp)"
M = f"{O}, m AS (SELECT grp, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM o GROUP BY 1)"
RATERS = "x AS (SELECT vec_id, label AS a, CASE WHEN vec_id % 3 = 0 THEN (label + 1) % 10 ELSE label END AS b FROM embeddings), c AS (SELECT a, b, count(*) AS n FROM x GROUP BY ALL)"
# the same published approximation, so that both sides round alike
_C = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
_POLY = "0.17087277"
for _c in reversed(_C[:-1]):
    _POLY = f"({_POLY} * t + {_c})"


def _anova(src: str, value: str) -> str:
    return f"g AS (SELECT grp, count(*) AS n, avg({value}) AS m, var_pop({value}) AS s2 FROM {src} GROUP BY 1), a AS (SELECT sum(n) AS n, sum(n * m) / sum(n) AS gm, count(*) AS k, sum(n * s2) AS w FROM g), bt AS (SELECT sum(n * pow(m - gm, 2)) AS b FROM g, (SELECT gm FROM a))"


SQL = {
    "avg_ranks": "SELECT l_extendedprice AS v, count(*) AS n, any_value(rk) + (count(*) - 1) / 2.0 AS avg_rank FROM (SELECT l_extendedprice, rank() OVER (ORDER BY l_extendedprice) AS rk FROM lineitem) GROUP BY 1",
    "rank_sums": f"WITH {R} SELECT grp, n, round(rank_sum, 6) AS rank_sum FROM rs",
    "kruskal_h": f"WITH {R} SELECT round((12 / (total * (total + 1)) * (SELECT sum(rank_sum * rank_sum / n) FROM rs) - 3 * (total + 1)) / (1 - ties / (total * total * total - total)), 6) AS h, (SELECT count(*) - 1 FROM rs) AS df, CAST(total AS BIGINT) AS n FROM tt",
    "dunn_z": f"WITH {D} SELECT group_a, group_b, round(z, 6) AS z FROM dz",
    "mannwhitney_ks_cliff": f"""WITH {O}, ab AS (SELECT grp, v, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS rk FROM o WHERE grp IN ('1-URGENT', '5-LOW')),
      k AS (SELECT count(*) FILTER (grp = '1-URGENT') AS na, count(*) FILTER (grp = '5-LOW') AS nb, sum(rk) FILTER (grp = '1-URGENT') AS ra FROM ab),
      ti AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM ab GROUP BY v)),
      e AS (SELECT max(abs(ca - cb)) AS ks FROM (SELECT count(*) FILTER (grp = '1-URGENT') OVER w / (SELECT na FROM k) AS ca, count(*) FILTER (grp = '5-LOW') OVER w / (SELECT nb FROM k) AS cb FROM ab WINDOW w AS (ORDER BY v)))
      SELECT na, nb, round(u, 6) AS u, round(2 * u / (na * nb) - 1, 6) AS cliffs_delta, round((abs(u - na * nb / 2.0) - 0.5) / sqrt(na * nb / 12.0 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))), 6) AS z, round(ks, 6) AS ks
      FROM (SELECT na, nb, ra - na * (na + 1) / 2.0 AS u FROM k), ti, e""",
    "welch_cohen": f"""WITH {M} SELECT a.grp AS group_a, b.grp AS group_b, round((a.mean - b.mean) / sqrt(a.var / a.n + b.var / b.n), 6) AS t,
      round(pow(a.var / a.n + b.var / b.n, 2) / (pow(a.var / a.n, 2) / (a.n - 1) + pow(b.var / b.n, 2) / (b.n - 1)), 6) AS df, round((a.mean - b.mean) / sqrt(((a.n - 1) * a.var + (b.n - 1) * b.var) / (a.n + b.n - 2)), 6) AS cohens_d FROM m a, m b WHERE a.grp < b.grp""",
    "levene_w": f"WITH {O}, md AS (SELECT grp, median(v) AS md FROM o GROUP BY 1), z AS (SELECT o.grp, abs(v - md) AS z FROM o JOIN md ON o.grp = md.grp), {_anova('z', 'z')} SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS w, k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within FROM a, bt",
    "anova_eta": f"WITH {O}, {_anova('o', 'v')} SELECT round((b / (k - 1)) / (w / (n - k)), 6) AS f, round(b / (b + w), 6) AS eta_squared, k - 1 AS df_between, CAST(n - k AS BIGINT) AS df_within FROM a, bt",
    "bh_fdr": f"""WITH {D}, p AS (SELECT group_a, group_b, round(t * exp(-x * x + {_POLY}), 5) AS p FROM (SELECT *, 1 / (1 + 0.5 * x) AS t FROM (SELECT *, abs(round(z, 4)) / sqrt(2) AS x FROM dz))),
      q AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p) AS raw FROM p) SELECT group_a, group_b, p, round(least(1, min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 6) AS q FROM q""",
    "one_sample_t": f"WITH {M} SELECT grp, n, round(mean, 6) AS mean, 1.5::DOUBLE AS ref, round((mean - 1.5) / sqrt(var) * sqrt(n), 6) AS stat, round((mean - 1.5) / sqrt(var), 6) AS effect_size_cohens_d FROM m",
    "wilcoxon_w": "WITH d AS (SELECT round(l_discount * 100) - round(l_tax * 100) AS d FROM lineitem), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0) SELECT count(*) AS n, sum(rk) FILTER (d > 0) AS w_plus, sum(rk) FILTER (d < 0) AS w_minus FROM r",
    "friedman_q": """WITH x AS (SELECT user_id, event_type, round(avg(value), 6) AS v FROM events WHERE event_type IN ('click', 'purchase', 'search', 'view') GROUP BY ALL), y AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS k FROM x),
      r AS (SELECT user_id, event_type, rank() OVER (PARTITION BY user_id ORDER BY v) + (count(*) OVER (PARTITION BY user_id, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY user_id, v) AS t FROM y WHERE k = 4),
      s AS (SELECT event_type, sum(rk) AS r, count(*) AS n FROM r GROUP BY 1) SELECT round((12.0 / (max(n) * 20) * sum(r * r) - 15.0 * max(n)) / (1 - (SELECT sum(t * t - 1) FROM r) / (max(n) * 60.0)), 6) AS chi2, max(n) AS n FROM s""",
    "chi2_prevalence": f"WITH {O}, s AS (SELECT grp, count(*) FILTER (v > 2) AS y, count(*) FILTER (v <= 2) AS z FROM o GROUP BY 1), t AS (SELECT sum(y) AS ty, sum(z) AS tz FROM s) SELECT round(sum(pow(y - (y + z) * ty / (ty + tz), 2) / ((y + z) * ty / (ty + tz)) + pow(z - (y + z) * tz / (ty + tz), 2) / ((y + z) * tz / (ty + tz))), 6) AS chi2, count(*) - 1 AS df FROM s, t",
    "mean_ci95": f"WITH {M} SELECT grp, n, round(mean, 6) AS mean, round(1.96 * sqrt(var) / sqrt(n), 6) AS ci95 FROM m",
    "representative_member": "WITH m AS (SELECT c_mktsegment, median(c_acctbal) AS md FROM customer GROUP BY 1) SELECT c.c_mktsegment, first(c_custkey ORDER BY abs(c_acctbal - md), c_custkey) AS c_custkey FROM customer c JOIN m ON c.c_mktsegment = m.c_mktsegment GROUP BY 1",
    "contingency": f"WITH {RATERS} SELECT a, b, n FROM c",
    "label_agreement": f"""WITH {RATERS}, ra AS (SELECT a, sum(n) AS r, coalesce(sum(n) FILTER (a = b), 0) AS hit FROM c GROUP BY 1), cb AS (SELECT b, sum(n) AS c FROM c GROUP BY 1),
      t AS (SELECT CAST(sum(n) AS DOUBLE) AS n, sum(n * (n - 1) / 2) AS ij FROM c), i AS (SELECT sum(r * (r - 1) / 2) AS i, sum(hit) AS hits, avg(hit / r) AS ba FROM ra), j AS (SELECT sum(c * (c - 1) / 2) AS j FROM cb), e AS (SELECT sum(r * c) AS e FROM ra JOIN cb ON a = b)
      SELECT CAST(n AS BIGINT) AS n, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari, round((hits / n - e / (n * n)) / (1 - e / (n * n)), 6) AS kappa, round(ba, 6) AS balanced_accuracy FROM t, i, j, e""",
    "jaccard_match": f"WITH {RATERS}, k AS (SELECT a, b, n / (sum(n) OVER (PARTITION BY a) + sum(n) OVER (PARTITION BY b) - n) AS j FROM c) SELECT a, first(b ORDER BY j DESC, b) AS b, round(max(j), 6) AS jaccard FROM k GROUP BY a",
    "coassociation": """WITH s AS (SELECT vec_id, CAST(floor(embedding[1]::DOUBLE * 4) AS BIGINT) AS x, CAST(floor(embedding[2]::DOUBLE * 4) AS BIGINT) AS y, label AS z FROM embeddings), g AS (SELECT x, y, z, count(*) AS size, min(vec_id) AS sig FROM s GROUP BY ALL)
      SELECT a.sig AS sig_a, b.sig AS sig_b, a.size AS size_a, b.size AS size_b, round(((a.x = b.x)::INT + (a.y = b.y)::INT + (a.z = b.z)::INT) / 3, 6) AS share FROM g a JOIN g b ON a.sig <= b.sig AND (a.x = b.x OR a.y = b.y OR a.z = b.z)""",
    "frame_size_mode": "WITH w AS (SELECT source, frame_w, count(*) AS n FROM session_data WHERE frame_w IS NOT NULL GROUP BY ALL), h AS (SELECT source, frame_h, count(*) AS n FROM session_data WHERE frame_h IS NOT NULL GROUP BY ALL), a AS (SELECT source, first(frame_w ORDER BY n DESC, frame_w) AS frame_w FROM w GROUP BY 1), b AS (SELECT source, first(frame_h ORDER BY n DESC, frame_h) AS frame_h FROM h GROUP BY 1) SELECT a.source, frame_w, frame_h FROM a JOIN b ON a.source = b.source",
}
