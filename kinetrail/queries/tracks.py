"""Cleaning and feature queries over ``pose_track``."""

from pyspark.sql import functions as F

from kinetrail.operators import clean as C
from kinetrail.operators import features as X
from kinetrail.plans.runtime import join_dim, latest, nan_to_null, table


def pose(spark, d):
    """Rows sent again merged; positions outside 0 .. 2000 and likelihoods outside 0 .. 1 taken as missing."""
    p = table(spark, d, "pose_track")
    ok = lambda c, top: F.max(F.when(nan_to_null(F.col(c)).between(0.001, top), F.col(c))).alias(c)
    return p.groupBy("session_id", "frame", "bodypart").agg(ok("x", 2000.0), ok("y", 2000.0), ok("likelihood", 1.0))


def sessions(spark, d):
    s = latest(table(spark, d, "session_data").select("session_id", "source", nan_to_null(F.col("fps")).alias("fps"), "exp_group", "loaded_at"), ["session_id"], "loaded_at")
    return s


def r4(df):
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def r7(df):
    return df.select(*[F.round(c, 10).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def bins(spark, d):
    return X.binned(pose(spark, d), sessions(spark, d))


HEAD = {"head": ["nose", "snout", "left_ear", "right_ear", "ear_left", "ear_right", "head", "headcentre"], "tail": ["tailbase", "tail_base", "tail_tip"]}
NOSE = ["nose", "snout"]


def fill_mask(spark, d):
    c = table(spark, d, "cam_timestamp").where("frame_idx is not null")
    on = ["session_id", "cam", "frame_idx"]
    return C.mask_fills(c.select(*on).distinct().withColumn("likelihood", F.lit(1.0)), c.select(*on, "is_fill"), on)


QUERIES = {
    "low_ll_fraction": lambda s, d: r4(C.low_fraction(pose(s, d))),
    "interp_and_flat_hold": lambda s, d: r4(C.fill_gaps(pose(s, d), 0.5, 5)),
    "boxcar_smooth": lambda s, d: r4(C.boxcar(pose(s, d), 4)),
    "confident_runs": lambda s, d: C.confident_runs(pose(s, d)),
    "run_median_filter": lambda s, d: r4(C.run_median(pose(s, d))),
    "likelihood_gate": lambda s, d: r4(C.gate(pose(s, d), 0.6).select("session_id", "frame", "bodypart", "likelihood")),
    "fill_mask": fill_mask,
    "likelihood_by_frame": lambda s, d: r7(pose(s, d).groupBy("session_id", "frame").agg(F.min("likelihood").alias("least"), F.avg("likelihood").alias("mean"), F.max("likelihood").alias("most"))),
    "bodypart_conservation": lambda s, d: r4(C.conserved(pose(s, d))),
    "bodypart_intersection": lambda s, d: C.common_bodyparts(join_dim(pose(s, d), sessions(s, d).select("session_id", "source"), ["session_id"], "inner"), "source", "session_id"),
    "auto_weights": lambda s, d: r4(C.auto_weights(C.low_fraction(pose(s, d), 0.9), {"neck": 2.0})),
    "drop_gate": lambda s, d: r4(C.dropped_bodyparts(C.low_fraction(pose(s, d), 0.95), 0.3)),
    "bin_means": lambda s, d: r4(X.bin_means(bins(s, d))),
    "pairwise_distance": lambda s, d: r4(X.pair_distances(bins(s, d))),
    "velocity": lambda s, d: r4(X.velocity(X.bin_means(bins(s, d)))),
    "acceleration": lambda s, d: r4(X.acceleration(X.bin_means(bins(s, d)))).withColumn("acceleration", F.col("acceleration") + 0.0),
    "within_bin_variance": lambda s, d: r4(X.variances(bins(s, d))),
    "lag_drift": lambda s, d: r4(X.drift(X.bin_means(bins(s, d)), (5, 10, 20))),
    "coarse_bins": lambda s, d: r4(X.coarse(bins(s, d))),
    "spine_angle": lambda s, d: r4(X.spine_angle(bins(s, d), ("nose", "neck", "tailbase"))),
    "visibility_block": lambda s, d: r7(X.visibility(bins(s, d), HEAD, 0.9)),
    "adaptive_visibility": lambda s, d: r7(X.adaptive_threshold(pose(s, d))),
    "turned_away_windows": lambda s, d: X.turned_away(bins(s, d), HEAD["head"], NOSE, X.adaptive_threshold(pose(s, d), 0.95), share=0.1, least_bins=2),
    "tracking_metrics": lambda s, d: r4(X.tracking_metrics(pose(s, d), sessions(s, d))),
    "session_summary": lambda s, d: r4(
        X.tracking_metrics(pose(s, d), sessions(s, d)).groupBy("session_id").agg(*[F.avg(c).alias(c) for c in ("mean_velocity", "mean_jitter", "bbox_area", "mean_likelihood", "interp_rate")])
    ),
}

POSE = """
p AS (SELECT session_id, frame, bodypart, max(CASE WHEN NOT isnan(x) AND x BETWEEN 0.001 AND 2000 THEN x END) AS x, max(CASE WHEN NOT isnan(y) AND y BETWEEN 0.001 AND 2000 THEN y END) AS y,
  max(CASE WHEN NOT isnan(likelihood) AND likelihood BETWEEN 0.001 AND 1 THEN likelihood END) AS likelihood FROM pose_track GROUP BY ALL),
se AS (SELECT session_id, arg_max(source, loaded_at) AS source, arg_max_null(CASE WHEN isnan(fps) THEN NULL ELSE fps END, loaded_at) AS fps FROM session_data GROUP BY 1)"""
BINS = (
    POSE
    + """,
sw AS (SELECT session_id, greatest(1, CAST(round_even(coalesce(fps, 30) / 10, 0) AS INT)) AS win FROM se),
nf AS (SELECT session_id, max(frame) + 1 AS n FROM p GROUP BY 1),
q AS (SELECT p.*, win, frame // win AS bin FROM p JOIN sw USING (session_id) JOIN nf USING (session_id) WHERE frame // win < n // win),
bm AS (SELECT session_id, bodypart, bin, avg(x) AS x, avg(y) AS y FROM q GROUP BY ALL),
v AS (SELECT session_id, bodypart, bin, CASE WHEN lag(bin) OVER w = bin - 1 THEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) END AS velocity FROM bm WINDOW w AS (PARTITION BY session_id, bodypart ORDER BY bin))"""
)
RUNS = "c AS (SELECT *, frame - row_number() OVER (PARTITION BY session_id, bodypart ORDER BY frame) AS g FROM p WHERE likelihood >= 0.6), cr AS (SELECT session_id, bodypart, min(frame) AS start_frame, count(*) AS run_len FROM c GROUP BY session_id, bodypart, g HAVING count(*) >= 7)"
_HEADS = ", ".join(f"'{x}'" for x in HEAD["head"])
_TAILS = ", ".join(f"'{x}'" for x in HEAD["tail"])
_G = """w1 AS (SELECT *, CASE WHEN likelihood >= 0.5 AND x IS NOT NULL AND y IS NOT NULL THEN frame END AS gf FROM p),
w2 AS (SELECT *, last_value(gf IGNORE NULLS) OVER w AS bf, last_value(CASE WHEN gf IS NOT NULL THEN x END IGNORE NULLS) OVER w AS bx, last_value(CASE WHEN gf IS NOT NULL THEN y END IGNORE NULLS) OVER w AS by_,
  first_value(gf IGNORE NULLS) OVER z AS af, first_value(CASE WHEN gf IS NOT NULL THEN x END IGNORE NULLS) OVER z AS ax, first_value(CASE WHEN gf IS NOT NULL THEN y END IGNORE NULLS) OVER z AS ay FROM w1
  WINDOW w AS (PARTITION BY session_id, bodypart ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), z AS (PARTITION BY session_id, bodypart ORDER BY frame ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))"""


def _fill(c: str, b: str, a: str) -> str:
    return f"round(CASE WHEN gf IS NOT NULL THEN {c} WHEN af IS NULL OR bf IS NULL THEN coalesce({b}, {a}) WHEN af - bf - 1 <= 5 THEN {b} + ({a} - {b}) * (frame - bf) / (af - bf) WHEN frame * 2 < af + bf THEN {b} ELSE {a} END, 6) AS {c}"


TM = """k1 AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM p WINDOW w AS (PARTITION BY session_id, bodypart ORDER BY frame)),
k2 AS (SELECT *, abs(step - lag(step) OVER (PARTITION BY session_id, bodypart ORDER BY frame)) AS turn FROM k1),
tm AS (SELECT session_id, bodypart, avg(step) * any_value(coalesce(fps, 30)) AS mean_velocity, stddev_pop(step) * any_value(coalesce(fps, 30)) AS std_velocity, stddev_pop(step) / nullif(avg(step), 0) AS cv_velocity,
  avg(turn) AS mean_jitter, stddev_pop(x) AS std_x, stddev_pop(y) AS std_y, (max(x) - min(x)) * (max(y) - min(y)) AS bbox_area, avg(likelihood) AS mean_likelihood, avg(CASE WHEN likelihood < 0.3 THEN 1.0 WHEN likelihood >= 0.3 THEN 0 END) AS interp_rate
  FROM k2 JOIN se USING (session_id) GROUP BY session_id, bodypart)"""


def _low(t: float) -> str:
    return f"lf AS (SELECT session_id, bodypart, avg(CASE WHEN likelihood < {t} THEN 1.0 WHEN likelihood >= {t} THEN 0 END) AS ll_frac, count(likelihood) AS n FROM p GROUP BY ALL)"


SQL = {
    "low_ll_fraction": f"WITH {POSE}, {_low(0.3)} SELECT session_id, bodypart, round(ll_frac, 6) AS ll_frac, n FROM lf",
    "interp_and_flat_hold": f"WITH {POSE}, {_G} SELECT session_id, frame, bodypart, {_fill('x', 'bx', 'ax')}, {_fill('y', 'by_', 'ay')}, coalesce(gf IS NULL AND af IS NOT NULL AND bf IS NOT NULL AND af - bf - 1 > 5, false) AS flat_held FROM w2",
    "boxcar_smooth": f"WITH {POSE} SELECT session_id, frame, bodypart, round(sum(coalesce(x, 0)) OVER w / 4, 6) AS x, round(sum(coalesce(y, 0)) OVER w / 4, 6) AS y FROM p WINDOW w AS (PARTITION BY session_id, bodypart ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)",
    "confident_runs": f"WITH {POSE}, {RUNS} SELECT * FROM cr",
    "run_median_filter": f"""WITH {POSE}, {RUNS}, j AS (SELECT p.*, start_frame FROM p LEFT JOIN cr ON p.session_id = cr.session_id AND p.bodypart = cr.bodypart AND p.frame BETWEEN start_frame AND start_frame + run_len - 1)
      SELECT session_id, frame, bodypart, round(CASE WHEN start_frame IS NULL THEN x ELSE median(x) OVER w END, 6) AS x, round(CASE WHEN start_frame IS NULL THEN y ELSE median(y) OVER w END, 6) AS y FROM j
      WINDOW w AS (PARTITION BY session_id, bodypart, start_frame ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
    "likelihood_gate": f"WITH {POSE} SELECT session_id, frame, bodypart, round(CASE WHEN likelihood < 0.6 THEN 0 ELSE likelihood END, 6) AS likelihood FROM p",
    "fill_mask": "SELECT session_id, cam, frame_idx, CASE WHEN bool_or(coalesce(is_fill, false)) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS likelihood FROM cam_timestamp WHERE frame_idx IS NOT NULL GROUP BY ALL",
    "likelihood_by_frame": f"WITH {POSE} SELECT session_id, frame, round(min(likelihood), 10) AS least, round(avg(likelihood), 10) AS mean, round(max(likelihood), 10) AS most FROM p GROUP BY ALL",
    "bodypart_conservation": f"""WITH {POSE}, m AS (SELECT session_id, bodypart, median(likelihood) AS m FROM p WHERE likelihood IS NOT NULL GROUP BY ALL),
      s AS (SELECT bodypart, count(*) FILTER (m >= 0.3) / (SELECT count(DISTINCT session_id) FROM p) AS share, avg(m) AS mm FROM m GROUP BY 1)
      SELECT bodypart, round(share, 6) AS share, share >= 0.85 OR row_number() OVER (ORDER BY share DESC, mm DESC, bodypart) <= 6 AS kept FROM s""",
    "bodypart_intersection": f"WITH {POSE}, x AS (SELECT DISTINCT source, session_id, bodypart FROM p JOIN se USING (session_id)), n AS (SELECT source, count(DISTINCT session_id) AS n FROM x GROUP BY 1) SELECT source, bodypart FROM x JOIN n USING (source) GROUP BY source, bodypart, n HAVING count(*) = n",
    "auto_weights": f"""WITH {POSE}, {_low(0.9)}, s AS (SELECT bodypart, avg(CASE WHEN ll_frac > 0.3 THEN 1.0 WHEN ll_frac <= 0.3 THEN 0 END) AS share FROM lf GROUP BY 1)
      SELECT bodypart, round(share, 6) AS share, round(CASE WHEN bodypart = 'neck' THEN 2 WHEN share <= 0.1 THEN 1 WHEN share >= 0.35 THEN 0.35 ELSE 1 - 0.65 * (share - 0.1) / 0.25 END, 6) AS weight FROM s""",
    "drop_gate": f"WITH {POSE}, {_low(0.95)} SELECT bodypart, round(avg(ll_frac), 6) AS mean_bad FROM lf GROUP BY 1 HAVING avg(ll_frac) >= 0.3",
    "bin_means": f"WITH {BINS} SELECT session_id, bodypart, bin, round(x, 6) AS x, round(y, 6) AS y FROM bm",
    "pairwise_distance": f"WITH {BINS} SELECT a.session_id, a.bin, a.bodypart AS part_a, b.bodypart AS part_b, round(avg(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))), 6) AS dist FROM q a JOIN q b ON a.session_id = b.session_id AND a.frame = b.frame AND a.bodypart < b.bodypart WHERE a.x IS NOT NULL AND a.y IS NOT NULL AND b.x IS NOT NULL AND b.y IS NOT NULL GROUP BY ALL",
    "velocity": f"WITH {BINS} SELECT session_id, bodypart, bin, round(velocity, 6) AS velocity FROM v",
    "acceleration": f"WITH {BINS} SELECT session_id, bodypart, bin, round(CASE WHEN lag(bin) OVER w = bin - 1 THEN velocity - lag(velocity) OVER w END, 6) + 0.0 AS acceleration FROM v WINDOW w AS (PARTITION BY session_id, bodypart ORDER BY bin)",
    "within_bin_variance": f"WITH {BINS} SELECT session_id, bodypart, bin, round(var_pop(x), 6) AS var_x, round(var_pop(y), 6) AS var_y FROM q GROUP BY ALL",
    "lag_drift": f"""WITH {BINS}, c AS (SELECT session_id, bin, avg(x) AS x, avg(y) AS y FROM bm GROUP BY ALL)
      SELECT session_id, bin, {', '.join(f'round(CASE WHEN lag(bin, {k}) OVER w = bin - {k} THEN sqrt(pow(x - lag(x, {k}) OVER w, 2) + pow(y - lag(y, {k}) OVER w, 2)) END, 6) AS drift_{k}' for k in (5, 10, 20))} FROM c WINDOW w AS (PARTITION BY session_id ORDER BY bin)""",
    "coarse_bins": f"WITH {BINS}, w AS (SELECT session_id, bodypart, bin // 2 AS wide, avg(x) AS x, avg(y) AS y FROM q GROUP BY ALL) SELECT f.session_id, f.bodypart, f.bin, round(w.x, 6) AS x, round(w.y, 6) AS y FROM (SELECT DISTINCT session_id, bodypart, bin FROM q) f JOIN w ON f.session_id = w.session_id AND f.bodypart = w.bodypart AND f.bin // 2 = w.wide",
    "spine_angle": f"""WITH {BINS}, g AS (SELECT * FROM q WHERE x IS NOT NULL AND y IS NOT NULL), a AS (SELECT a.session_id, a.bin, a.x - b.x AS ax, a.y - b.y AS ay, c.x - b.x AS bx, c.y - b.y AS by_ FROM g a JOIN g b ON a.session_id = b.session_id AND a.frame = b.frame AND b.bodypart = 'neck'
      JOIN g c ON a.session_id = c.session_id AND a.frame = c.frame AND c.bodypart = 'tailbase' WHERE a.bodypart = 'nose')
      SELECT session_id, bin, round(avg(acos(greatest(-1, least(1, (ax * bx + ay * by_) / (sqrt(ax * ax + ay * ay) * sqrt(bx * bx + by_ * by_) + 1e-8))))), 6) AS angle FROM a GROUP BY ALL""",
    "visibility_block": f"""WITH {BINS}, l AS (SELECT *, CASE WHEN likelihood < 0.9 THEN 1.0 WHEN likelihood >= 0.9 THEN 0 END AS low FROM q) SELECT session_id, bin, round(avg(likelihood), 10) AS mean_visibility, round(avg(low), 10) AS frac_low_conf,
      round(avg(low) FILTER (bodypart IN ({_HEADS})), 10) AS low_head, round(avg(low) FILTER (bodypart IN ({_TAILS})), 10) AS low_tail FROM l GROUP BY ALL""",
    "adaptive_visibility": f"WITH {POSE} SELECT session_id, bodypart, round(greatest(0.3, quantile_cont(likelihood, 0.1)), 10) AS threshold FROM p WHERE likelihood IS NOT NULL GROUP BY ALL",
    "turned_away_windows": f"""WITH {BINS}, th AS (SELECT session_id, max(t) AS threshold FROM (SELECT session_id, bodypart, greatest(0.95, quantile_cont(likelihood, 0.1)) AS t FROM p WHERE likelihood IS NOT NULL AND bodypart IN ('nose', 'snout') GROUP BY ALL) GROUP BY 1),
      l AS (SELECT session_id, bin, avg(CASE WHEN likelihood < 0.3 THEN 1.0 WHEN likelihood >= 0.3 THEN 0 END) FILTER (bodypart IN ({_HEADS})) AS hl, avg(likelihood) FILTER (bodypart IN ('nose', 'snout')) AS nl FROM q GROUP BY ALL),
      a AS (SELECT session_id, bin FROM l JOIN th USING (session_id) WHERE hl >= 0.1 AND nl < threshold), i AS (SELECT *, CASE WHEN bin - lag(bin) OVER w <= 6 THEN 0 ELSE 1 END AS s FROM a WINDOW w AS (PARTITION BY session_id ORDER BY bin)),
      g AS (SELECT *, sum(s) OVER (PARTITION BY session_id ORDER BY bin) AS g FROM i) SELECT session_id, min(bin) AS start_bin, max(bin) - min(bin) + 1 AS n_bins FROM g GROUP BY session_id, g HAVING max(bin) - min(bin) + 1 >= 2""",
    "tracking_metrics": f"WITH {POSE}, {TM} SELECT session_id, bodypart, {', '.join(f'round({c}, 6) AS {c}' for c in ('mean_velocity', 'std_velocity', 'cv_velocity', 'mean_jitter', 'std_x', 'std_y', 'bbox_area', 'mean_likelihood', 'interp_rate'))} FROM tm",
    "session_summary": f"WITH {POSE}, {TM} SELECT session_id, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('mean_velocity', 'mean_jitter', 'bbox_area', 'mean_likelihood', 'interp_rate'))} FROM tm GROUP BY 1",
}
