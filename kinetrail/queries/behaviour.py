"""Bout queries over ``events``: a user is a session, the event type its label, events in time order its frames."""

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.operators import bouts as B
from kinetrail.plans.runtime import table
from kinetrail.plans.sequence import carry, indexed

FPS = 10.0
GROUPS = {"first_two": ["click", "purchase"], "search": ["search"], "none": ["absent"]}


def frames(spark, d):
    e = table(spark, d, "events").selectExpr("user_id as session_id", "event_id", "ts", "event_type as label", "value", "cast(get_json_object(props, '$.k') as double) as k")
    return indexed(e, ["session_id"], ["ts", "event_id"], F.to_date("ts")).select("session_id", "frame", "label", "value", "k")


def bouts(spark, d):
    return B.rle(frames(spark, d))


def r6(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def filled_labels(spark, d):
    """Labels of weak frames (value below 20) replaced by the nearest one before, else after."""
    f = frames(spark, d)
    strong = F.when(F.col("value") >= 20, F.col("label"))
    f = carry(f, ["session_id"], "frame", strong, "b", "a")
    return f.select("session_id", "frame", F.coalesce("b.value", "a.value").alias("label"))


def group_diff(spark, d):
    b = bouts(spark, d).withColumn("exp_group", F.col("session_id") % 3)
    t = B.transitions(b, ["exp_group"])
    p = t.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy("exp_group", "from_label")))
    g = p.groupBy("from_label", "to_label").agg(F.max(F.when(F.col("exp_group") == 0, F.col("p"))).alias("p0"), F.max(F.when(F.col("exp_group") == 1, F.col("p"))).alias("p1"))
    return r6(g.select("from_label", "to_label", (F.coalesce("p0", F.lit(0.0)) - F.coalesce("p1", F.lit(0.0))).alias("diff")))


def summary(spark, d):
    m = B.metrics(bouts(spark, d), GROUPS, FPS).withColumn("exp_group", F.col("session_id") % 3)
    return r6(B.combined(m, "exp_group", ["frequency", "total_duration", "mean_bout", "latency"]))


def bin_labels_to_frames(spark, d):
    """The most frequent label of each bin of 3 frames (ties: the first in order), given back to its frames; a last bin that
    is not full is left out."""
    f = frames(spark, d)
    c = f.withColumn("bin", F.floor(F.col("frame") / 3)).groupBy("session_id", "bin", "label").agg(F.count("*").alias("n"))
    top = c.groupBy("session_id", "bin").agg(F.min_by("label", F.struct((-F.col("n")).alias("n"), "label")).alias("label"), F.sum("n").alias("n"))
    return top.where("n = 3").select("session_id", F.explode(F.sequence(F.col("bin") * 3, F.col("bin") * 3 + 2)).alias("frame"), "label")


QUERIES = {
    "frame_labels": lambda s, d: frames(s, d).select("session_id", "frame", "label"),
    "rle_bouts": bouts,
    "merge_bouts": lambda s, d: B.merge(bouts(s, d), GROUPS["first_two"]),
    "bout_metrics": lambda s, d: r6(B.metrics(bouts(s, d), GROUPS, FPS)),
    "session_duration": lambda s, d: r6(B.session_duration(bouts(s, d), FPS)),
    "per_cluster_metrics": lambda s, d: r6(B.per_cluster(bouts(s, d), FPS)),
    "transition_counts": lambda s, d: B.transitions(bouts(s, d)),
    "transition_matrix": lambda s, d: r6(B.transition_matrix(bouts(s, d))),
    "transition_diff": group_diff,
    "syntax_edges": lambda s, d: r6(B.edges(bouts(s, d), 0.2)),
    "epochs": lambda s, d: r6(B.epochs(bouts(s, d), FPS)),
    "bout_duration_filter": lambda s, d: B.keep_durations(bouts(s, d), FPS, 0.2, 0.4),
    "dwell_quantiles": lambda s, d: r6(B.dwell(bouts(s, d), FPS)),
    "combined_group_summary": summary,
    "behaviour_mapping_stats": lambda s, d: B.mapping_stats(frames(s, d), {"click": "a", "search": "b"}, ["view"]),
    "rare_cluster_filter": lambda s, d: r6(B.rare(frames(s, d), 5.0)),
    "sanitize_labels": filled_labels,
    "bin_labels_to_frames": bin_labels_to_frames,
}

FRAMES = """
f AS (SELECT user_id AS session_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_type AS label, value,
  CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
b AS (SELECT session_id, label, min(frame) AS start_frame, count(*) AS run_len FROM
  (SELECT *, frame - row_number() OVER (PARTITION BY session_id, label ORDER BY frame) AS g FROM f) GROUP BY session_id, label, g)"""
MERGED = """
gl(behaviour, label) AS (VALUES ('first_two', 'click'), ('first_two', 'purchase'), ('search', 'search'), ('none', 'absent')),
x AS (SELECT behaviour, session_id, start_frame AS st, start_frame + run_len AS en FROM b JOIN gl USING (label)),
y AS (SELECT *, CASE WHEN st <= max(en) OVER (PARTITION BY behaviour, session_id ORDER BY st, en ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 0 ELSE 1 END AS fresh FROM x),
z AS (SELECT *, sum(fresh) OVER (PARTITION BY behaviour, session_id ORDER BY st, en) AS g FROM y),
m AS (SELECT behaviour, session_id, min(st) AS st, max(en) AS en FROM z GROUP BY behaviour, session_id, g),
bm AS (SELECT s.session_id, gg.behaviour, count(m.st) AS frequency, coalesce(sum(en - st), 0) / 10.0 AS total_duration, coalesce(sum(en - st) / count(m.st) / 10.0, 0) AS mean_bout, min(st) / 10.0 AS latency
  FROM (SELECT DISTINCT session_id FROM b) s CROSS JOIN (SELECT DISTINCT behaviour FROM gl) gg LEFT JOIN m ON m.session_id = s.session_id AND m.behaviour = gg.behaviour GROUP BY ALL)"""
TRANS = """
t0 AS (SELECT session_id, label AS from_label, lead(label) OVER (PARTITION BY session_id ORDER BY start_frame) AS to_label FROM b),
t AS (SELECT from_label, to_label, count(*) AS n FROM t0 WHERE from_label <> to_label GROUP BY ALL),
tm AS (SELECT a.label AS from_label, c.label AS to_label, coalesce(n / (sum(n) OVER (PARTITION BY a.label)), 0) AS p
  FROM (SELECT DISTINCT label FROM b) a CROSS JOIN (SELECT DISTINCT label FROM b) c LEFT JOIN t ON t.from_label = a.label AND t.to_label = c.label)"""

SQL = {
    "frame_labels": f"WITH {FRAMES} SELECT session_id, frame, label FROM f",
    "rle_bouts": f"WITH {FRAMES} SELECT * FROM b",
    "merge_bouts": f'WITH {FRAMES}, {MERGED} SELECT session_id, st AS start, en AS "end" FROM m WHERE behaviour = \'first_two\'',
    "bout_metrics": f"WITH {FRAMES}, {MERGED} SELECT session_id, behaviour, frequency, round(total_duration, 6) AS total_duration, round(mean_bout, 6) AS mean_bout, round(latency, 6) AS latency FROM bm",
    "session_duration": f"WITH {FRAMES} SELECT session_id, round(max(start_frame + run_len) / 10.0, 6) AS duration_s FROM b GROUP BY session_id",
    "per_cluster_metrics": f"WITH {FRAMES} SELECT label, count(*) AS frequency, round(sum(run_len) / 10.0, 6) AS total_duration, round(avg(run_len) / 10.0, 6) AS mean_bout FROM b GROUP BY label",
    "transition_counts": f"WITH {FRAMES}, {TRANS} SELECT * FROM t",
    "transition_matrix": f"WITH {FRAMES}, {TRANS} SELECT from_label, to_label, round(p, 6) AS p FROM tm",
    "syntax_edges": f"WITH {FRAMES}, {TRANS} SELECT from_label, to_label, round(p, 6) AS p FROM tm WHERE p >= 0.2",
    "transition_diff": f"""WITH {FRAMES}, {TRANS}, g AS (SELECT session_id % 3 AS grp, from_label, to_label, count(*) AS n FROM t0 WHERE from_label <> to_label GROUP BY ALL),
      p AS (SELECT grp, from_label, to_label, n / sum(n) OVER (PARTITION BY grp, from_label) AS p FROM g)
      SELECT from_label, to_label, round(coalesce(max(p) FILTER (grp = 0), 0) - coalesce(max(p) FILTER (grp = 1), 0), 6) AS diff FROM p GROUP BY ALL""",
    "epochs": f"WITH {FRAMES} SELECT session_id, label, start_frame, start_frame + run_len AS end_frame, round(start_frame / 10.0, 6) AS start_sec, round((start_frame + run_len) / 10.0, 6) AS end_sec, round(run_len / 10.0, 6) AS duration_sec FROM b",
    "bout_duration_filter": f"WITH {FRAMES} SELECT * FROM b WHERE run_len / 10.0 BETWEEN 0.2 AND 0.4",
    "dwell_quantiles": f"WITH {FRAMES} SELECT label, round(quantile_cont(run_len / 10.0, 0.25), 6) AS q25, round(quantile_cont(run_len / 10.0, 0.5), 6) AS q50, round(quantile_cont(run_len / 10.0, 0.75), 6) AS q75, round(max(run_len / 10.0), 6) AS longest FROM b GROUP BY label",
    "combined_group_summary": f"""WITH {FRAMES}, {MERGED}, l AS (UNPIVOT (SELECT session_id % 3 AS exp_group, behaviour, CAST(frequency AS DOUBLE) AS frequency, total_duration, mean_bout, latency FROM bm) ON frequency, total_duration, mean_bout, latency INTO NAME metric VALUE v)
      SELECT exp_group, behaviour, metric, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem FROM l WHERE v IS NOT NULL GROUP BY ALL""",
    "behaviour_mapping_stats": f"""WITH {FRAMES}, s AS (SELECT DISTINCT label FROM f) SELECT count(*) AS total, count(*) FILTER (label IN ('click', 'search')) AS assigned,
      count(*) FILTER (label = 'view') AS ignored, count(*) FILTER (label NOT IN ('click', 'search', 'view')) AS pending FROM s""",
    "rare_cluster_filter": f"WITH {FRAMES}, c AS (SELECT label, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS percent FROM f GROUP BY label) SELECT label, n, round(percent, 6) AS percent FROM c WHERE percent >= 5",
    "sanitize_labels": f"""WITH {FRAMES} SELECT session_id, frame, coalesce(last_value(CASE WHEN value >= 20 THEN label END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(CASE WHEN value >= 20 THEN label END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS label FROM f""",
    "bin_labels_to_frames": f"""WITH {FRAMES}, c AS (SELECT session_id, frame // 3 AS bin, label, count(*) AS n FROM f GROUP BY ALL),
      t AS (SELECT session_id, bin, first(label ORDER BY n DESC, label) AS label, sum(n) AS n FROM c GROUP BY ALL) SELECT session_id, unnest(range(bin * 3, bin * 3 + 3)) AS frame, label FROM t WHERE n = 3""",
}
