"""Model and stream queries; iterative ones have no SQL and are tested against plain versions."""

from pyspark.sql import functions as F

from kinetrail.operators import models as M
from kinetrail.operators import refine as R
from kinetrail.plans.runtime import table
from kinetrail.queries.behaviour import frames
from kinetrail.queries.statistics import raters, seeds
from kinetrail.streaming import windows as S

LABELS = ["click", "purchase", "search", "signup", "view"]


def coded(s, d):
    names = F.array(*[F.lit(x) for x in LABELS])
    return frames(s, d).select("session_id", "frame", (F.array_position(names, F.col("label")) - 1).cast("int").alias("label"))


def hmm(s, d):
    f = coded(s, d)
    return M.decode(f, M.train_hmm(f, len(LABELS)), shard=64)


def classify(s, d):
    e = table(s, d, "embeddings")
    model, classes = M.train_classifier(e, "embedding", "label", (16,), iterations=30)
    p = M.predict(model, classes, e, "vec_id", "embedding", 0.2)
    return p.select("vec_id", "label", F.round("confidence", 4).alias("confidence"))


def dense(s, d):
    p = M.density_labels(table(s, d, "embeddings"), "vec_id", "embedding", hidden=(16,), iterations=30)
    return p.select("vec_id", "label", F.round("confidence", 4).alias("confidence"))


def align(s, d):
    """Positions of the first frame of each user carried onto those of the second by a similarity in the plane."""
    f = frames(s, d)
    a = f.where("frame = 0").select("session_id", F.col("k").alias("a_0"), F.col("value").alias("a_1"))
    b = f.where("frame = 1").select("session_id", F.col("k").alias("b_0"), F.col("value").alias("b_1"))
    r = M.procrustes(a.join(b, "session_id"), 2)
    return s.createDataFrame([(r["n"], round(float(r["scale"]), 6), [round(float(x), 6) for x in r["shift"]])], "n bigint, scale double, shift array<double>")


QUERIES = {
    "hmm_viterbi": hmm,
    "mlp_predict": classify,
    "density_labels": dense,
    "pca_reduce": lambda s, d: M.reduce_features(table(s, d, "embeddings"), "vec_id", "embedding", 5),
    "procrustes_align": align,
    "tumbling_counts": lambda s, d: S.tumbling(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day"),
    "session_windows": lambda s, d: S.sessions(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "6 hours"),
}

SQL = {
    "tumbling_counts": "SELECT CAST(date_trunc('day', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "session_windows": """WITH a AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
      g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts) AS g FROM a) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 6 HOURS AS "end", count(*) AS n FROM g GROUP BY user_id, g""",
}


def coarse_labels(s, d):
    """Vectors labelled by their first value, and their given label as a region."""
    e = table(s, d, "embeddings").where("embedding is not null")
    return e.select("vec_id", F.when(F.get("embedding", F.lit(0)).cast("double") > 0, 1).otherwise(0).cast("bigint").alias("cluster"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), (F.col("label") % 2).cast("string").alias("region"))


def tree_sweep(s, d):
    _, x = R.sample(table(s, d, "embeddings"), "vec_id", "embedding", 400)
    rows = [(r["least"], r["kind"], r["n_clusters"], round(r["score"], 6), r["score_kind"]) for r in R.sweep(x)]
    return s.createDataFrame(rows, "least int, kind string, n_clusters int, score double, score_kind string")


QUERIES |= {
    "cluster_sweep": tree_sweep,
    "refined_clusters": lambda s, d: R.refine(coarse_labels(s, d), "vec_id", "cluster", "vec", 64, region="region", iterations=2, least=50, bound=500, merge=0.2).select("vec_id", "cluster"),
    "seed_stability": lambda s, d: R.stability(R.seed_runs(table(s, d, "embeddings"), "vec_id", "embedding", 3, bound=500)).select("run_a", "run_b", F.round("ari", 6).alias("ari")),
    "run_stability": lambda s, d: R.stability(seeds(s, d)).select("run_a", "run_b", F.round("ari", 6).alias("ari")),
    "consensus_clusters": lambda s, d: R.consensus(seeds(s, d), 3, 8),
    "centroid_linkage": lambda s, d: R.hierarchy(table(s, d, "embeddings"), "label", "embedding", 64).select("step", "a", "b", F.round("height", 6).alias("height"), "members"),
    "matched_jaccard": lambda s, d: R.matched_jaccard(raters(s, d), "a", "b").select("a", "b", F.round("jaccard", 6).alias("jaccard")),
}

SQL |= {
    "run_stability": """WITH s AS (SELECT vec_id, CAST(floor(embedding[1]::DOUBLE * 4) AS BIGINT) AS x, CAST(floor(embedding[2]::DOUBLE * 4) AS BIGINT) AS y, label::BIGINT AS z FROM embeddings), r AS (SELECT 0 AS run, vec_id, x AS c FROM s UNION ALL SELECT 1, vec_id, y FROM s UNION ALL SELECT 2, vec_id, z FROM s),
      c AS (SELECT a.run AS run_a, b.run AS run_b, a.c AS a, b.c AS b, CAST(count(*) AS DOUBLE) AS n FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.run < b.run GROUP BY ALL),
      i AS (SELECT run_a, run_b, sum(n * (n - 1) / 2) AS i, sum(n) AS n FROM (SELECT run_a, run_b, a, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL), j AS (SELECT run_a, run_b, sum(n * (n - 1) / 2) AS j FROM (SELECT run_a, run_b, b, sum(n) AS n FROM c GROUP BY ALL) GROUP BY ALL),
      k AS (SELECT run_a, run_b, sum(n * (n - 1) / 2) AS ij FROM c GROUP BY ALL)
      SELECT run_a, run_b, round((ij - i * j / (n * (n - 1) / 2)) / ((i + j) / 2 - i * j / (n * (n - 1) / 2)), 6) AS ari FROM k JOIN i USING (run_a, run_b) JOIN j USING (run_a, run_b)""",
}
