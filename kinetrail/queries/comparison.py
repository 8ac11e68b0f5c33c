"""Comparisons of groups: tracking metrics by source, measures of users by group, orders by priority."""

from pyspark.sql import functions as F

from kinetrail.operators import compare as K
from kinetrail.operators import features as X
from kinetrail.operators import matrix as M
from kinetrail.plans.runtime import cut, join_dim, table
from kinetrail.queries.behaviour import r6
from kinetrail.queries.tracks import POSE, TM, pose, sessions


def by_source(s, d):
    t = X.tracking_metrics(pose(s, d), sessions(s, d)).groupBy("session_id").agg(F.avg("mean_velocity").alias("v"))
    return cut(join_dim(t, sessions(s, d).select("session_id", "source"), ["session_id"], "inner").select("source", F.round("v", 4).alias("v")))


def counts(s, d):
    """Events of each type by user and the user's group: a measure of clusters by group."""
    return table(s, d, "events").groupBy(F.col("event_type").alias("cluster"), "user_id").agg(F.count("*").alias("v")).withColumn("grp", F.col("user_id") % 3)


def present(s, d):
    """As ``counts`` of the weak events (value below 5), 0 for users without one."""
    e = table(s, d, "events")
    return e.groupBy(F.col("event_type").alias("cluster"), "user_id").agg(F.count_if(F.col("value") < 5).alias("v")).withColumn("grp", F.col("user_id") % 3)


STATS = ["n_a", "n_b", "mean_a", "mean_b", "u", "z", "ks", "t", "df", "cliffs_delta", "cohens_d"]

QUERIES = {
    "source_sizes": lambda s, d: r6(K.group_sizes(by_source(s, d), "source", "v")),
    "source_pairwise": lambda s, d: r6(K.pairwise(by_source(s, d), "source", "v")),
    "source_pairwise_p": lambda s, d: r6(K.pairwise_p(K.pairwise(by_source(s, d), "source", "v"))),
    "source_omnibus": lambda s, d: r6(K.omnibus(by_source(s, d), "source", "v")),
    "source_dunn": lambda s, d: r6(K.posthoc_dunn(by_source(s, d), "source", "v")),
    "source_normality": lambda s, d: r6(K.normality(by_source(s, d), "source", "v")),
    "source_difference_matrix": lambda s, d: r6(K.symmetric_matrix(K.pairwise(by_source(s, d), "source", "v"), "group_a", "group_b", "cliffs_delta")),
    "one_sample_report": lambda s, d: r6(K.one_sample(counts(s, d).withColumn("g", F.concat_ws("_", "cluster", "grp")), "g", "v", 4.0)),
    "one_sample_ranks": lambda s, d: r6(K.one_sample(counts(s, d).withColumn("g", F.concat_ws("_", "cluster", "grp")), "g", "v", 4.0, ranks=True).drop("pval", "qval", "effect_size_cohens_d")),
    "cluster_kruskal": lambda s, d: r6(K.cluster_kruskal(counts(s, d), "cluster", "grp", "v").drop("p", "q")),
    "two_part_test": lambda s, d: r6(K.two_part(present(s, d), "cluster", "grp", "v")),
    "volcano": lambda s, d: r6(K.volcano(counts(s, d), "cluster", "grp", "v", 0, 1).select("cluster", "log2_ratio", "t", "df")),
    "volcano_top": lambda s, d: r6(K.volcano(counts(s, d), "cluster", "grp", "v", 0, 1, 3)),
    "first_sessions": lambda s, d: K.first_members(table(s, d, "session_data"), "source", "session_id", 4).withColumn("rank", F.col("rank").cast("bigint")),
    "landmark_pick": lambda s, d: K.pick_landmark(table(s, d, "session_data").where("session_id is not null").select("session_id", F.posexplode("bodyparts").alias("pos", "bodypart")).distinct(), "session_id", "pos", "bodypart", M.canonical_landmark(F.col("bodypart")) == "tail_base"),
    "memory_tiers": lambda s, d: table(s, d, "part").select("p_partkey", K.memory_tier(F.col("p_size").cast("double")).alias("batch")),
}

_BY = f"{POSE}, {TM}, sv0 AS (SELECT session_id, avg(mean_velocity) AS v FROM tm GROUP BY 1), sv AS (SELECT source AS grp, round(v, 4) AS v FROM sv0 JOIN se USING (session_id) WHERE source IS NOT NULL AND v IS NOT NULL), kp AS (SELECT grp FROM sv GROUP BY 1 HAVING count(*) >= 3), g AS (SELECT sv.* FROM sv JOIN kp USING (grp))"
_PAIR = f"""{_BY}, mo AS (SELECT grp, count(*) AS n, avg(v) AS m, var_samp(v) AS s FROM g GROUP BY 1),
pr AS (SELECT a.grp AS ga, b.grp AS gb, a.n AS na, b.n AS nb, a.m AS ma, b.m AS mb, a.s AS sa, b.s AS sb FROM mo a JOIN mo b ON a.grp < b.grp),
un AS (SELECT ga, gb, grp, v, rank() OVER w + (count(*) OVER (PARTITION BY ga, gb, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY ga, gb, v) AS t, sum((grp = ga)::INT) OVER w AS ca, sum((grp = gb)::INT) OVER w AS cb FROM pr JOIN g ON grp = ga OR grp = gb WINDOW w AS (PARTITION BY ga, gb ORDER BY v)),
us AS (SELECT ga, gb, sum(rk) FILTER (grp = ga) AS ra, sum(t * t - 1) AS ties FROM un GROUP BY ALL),
ks AS (SELECT un.ga, un.gb, max(abs(ca / na - cb / nb)) AS ks FROM un JOIN pr ON un.ga = pr.ga AND un.gb = pr.gb GROUP BY ALL),
pw AS (SELECT pr.*, ra - na * (na + 1) / 2.0 AS u, ties, ks FROM pr JOIN us USING (ga, gb) JOIN ks USING (ga, gb)),
pa AS (SELECT ga AS group_a, gb AS group_b, na AS n_a, nb AS n_b, ma AS mean_a, mb AS mean_b, u, greatest(abs(u - na * nb / 2.0) - 0.5, 0) / sqrt(na * nb / 12.0 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1.0)))) AS z, ks, (ma - mb) / sqrt(sa / na + sb / nb) AS t,
  pow(sa / na + sb / nb, 2) / (pow(sa / na, 2) / (na - 1) + pow(sb / nb, 2) / (nb - 1)) AS df, 2 * u / (na * nb) - 1 AS cliffs_delta, (ma - mb) / sqrt(((na - 1) * sa + (nb - 1) * sb) / (na + nb - 2)) AS cohens_d FROM pw)"""
_C = "c AS (SELECT event_type AS cluster, user_id, user_id % 3 AS grp, count(*) AS v FROM events GROUP BY ALL)"
_KW = """k0 AS (SELECT cluster, grp, v FROM {src} WHERE v IS NOT NULL QUALIFY count(*) OVER (PARTITION BY cluster, grp) >= 2), k1 AS (SELECT *, rank() OVER (PARTITION BY cluster ORDER BY v) + (count(*) OVER (PARTITION BY cluster, v) - 1) / 2.0 AS rk, count(*) OVER (PARTITION BY cluster, v) AS t FROM k0),
k2 AS (SELECT cluster, grp, count(*) AS n, sum(rk) AS r FROM k1 GROUP BY ALL), k3 AS (SELECT cluster, sum(CAST(t AS DOUBLE) * t - 1) AS ties FROM k1 GROUP BY 1),
kw AS (SELECT cluster, count(*) AS k, CAST(sum(n) AS BIGINT) AS n, (12 / (sum(n) * (sum(n) + 1.0)) * sum(r * r / n) - 3 * (sum(n) + 1)) / (1 - any_value(ties) / (pow(sum(n), 3) - sum(n))) AS h FROM k2 JOIN k3 USING (cluster) GROUP BY 1)"""

SQL = {
    "source_sizes": f"WITH {_BY} SELECT grp AS source, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v) / nullif(avg(v), 0), 6) AS cv, count(v) >= 3 AS kept FROM sv GROUP BY 1",
    "source_pairwise": f"WITH {_PAIR} SELECT group_a, group_b, {', '.join(c if c in ('n_a', 'n_b') else f'round({c}, 6) AS {c}' for c in STATS)} FROM pa",
    "source_difference_matrix": f"WITH {_PAIR} SELECT group_a AS row, group_b AS col, round(cliffs_delta, 6) AS value FROM pa UNION ALL SELECT group_b, group_a, round(cliffs_delta, 6) FROM pa UNION ALL SELECT grp, grp, NULL FROM kp",
    "one_sample_ranks": f"""WITH {_C}, d AS (SELECT cluster || '_' || grp AS exp_group, v, v - 4.0 AS d FROM c), r AS (SELECT exp_group, d, rank() OVER (PARTITION BY exp_group ORDER BY abs(d)) + (count(*) OVER (PARTITION BY exp_group, abs(d)) - 1) / 2.0 AS rk FROM d WHERE d <> 0),
      w AS (SELECT exp_group, coalesce(sum(rk) FILTER (d > 0), 0) AS a, coalesce(sum(rk) FILTER (d < 0), 0) AS b FROM r GROUP BY 1) SELECT d.exp_group, count(*) AS n, round(avg(v), 6) AS mean, 4.0::DOUBLE AS ref, any_value(coalesce(least(a, b), 0))::DOUBLE AS stat, 'wilcoxon_1samp' AS test_type FROM d LEFT JOIN w USING (exp_group) GROUP BY 1""",
    "cluster_kruskal": f"WITH {_C}, {_KW.format(src='c')} SELECT cluster, k, n, round(h, 6) AS h FROM kw",
    "volcano": f"""WITH {_C}, m AS (SELECT cluster, count(v) FILTER (grp = 0) AS n0, avg(v) FILTER (grp = 0) AS m0, var_samp(v) FILTER (grp = 0) AS v0, count(v) FILTER (grp = 1) AS n1, avg(v) FILTER (grp = 1) AS m1, var_samp(v) FILTER (grp = 1) AS v1 FROM c GROUP BY 1)
      SELECT cluster, round(log2(m0 / m1), 6) AS log2_ratio, round((m0 - m1) / sqrt(v0 / n0 + v1 / n1), 6) AS t, round(pow(v0 / n0 + v1 / n1, 2) / (pow(v0 / n0, 2) / (n0 - 1) + pow(v1 / n1, 2) / (n1 - 1)), 6) AS df FROM m""",
    "first_sessions": "SELECT source, session_id, row_number() OVER (PARTITION BY source ORDER BY session_id) AS rank FROM (SELECT DISTINCT source, session_id FROM session_data WHERE source IS NOT NULL AND session_id IS NOT NULL) QUALIFY rank <= 4",
    "landmark_pick": """WITH p AS (SELECT DISTINCT session_id, generate_subscripts(bodyparts, 1) AS pos, unnest(bodyparts) AS b FROM session_data WHERE session_id IS NOT NULL)
      SELECT session_id, coalesce(arg_min(b, pos) FILTER (regexp_matches(b, '(?i)tail.?base|tailbase')), arg_min(b, pos)) AS picked FROM p GROUP BY 1""",
    "memory_tiers": "SELECT p_partkey, CASE WHEN p_size * 0.85::DOUBLE >= 10 THEN 32 WHEN p_size * 0.85::DOUBLE >= 5 THEN 16 ELSE 8 END AS batch FROM part",
}
