"""Arena, enrichment and vector queries. Points are the events of a user: x is ``props.k``, y is ``value``."""

from pyspark.sql import functions as F

from kinetrail.operators import arena as A
from kinetrail.operators import bouts as B
from kinetrail.operators import enrich as E
from kinetrail.operators import vectors as V
from kinetrail.plans.runtime import table
from kinetrail.queries.behaviour import FPS, FRAMES, frames, r6

SQUARE = A.Shape("West", ((0.0, 0.0), (40.0, 0.0), (40.0, 60.0), (0.0, 60.0)), "novel")
TRIANGLE = A.Shape("East", ((60.0, 0.0), (101.0, 0.0), (80.0, 70.0)), "familiar")
TOP = A.Shape("North", ((20.0, 50.0), (80.0, 50.0), (80.0, 90.0), (20.0, 90.0)), "third")
BORDER = A.Shape("Border", ((-1.0, -1.0), (120.0, -1.0), (120.0, 150.0), (-1.0, 150.0)))
ARENA = A.Arena("open_field", BORDER, (SQUARE, TRIANGLE, TOP))
ROLES = {s.name: s.role for s in ARENA.regions}
ARMS = list(ROLES)
BIN = 4


def points(s, d):
    return frames(s, d).select("session_id", "frame", F.col("k").alias("x"), F.col("value").alias("y"), "label")


def bouts(s, d):
    return B.rle(frames(s, d))


def in_shape(s, d):
    x, y = F.col("x"), F.col("y")
    return points(s, d).select("session_id", "frame", *[A.inside(z, x, y).alias(f"in_{z.name.lower()}") for z in ARENA.regions])


def regions(s, d):
    return points(s, d).select("session_id", "frame", "label", A.region_of(ARENA, F.col("x"), F.col("y")).alias("region"))


def visits(s, d):
    return A.visits(points(s, d), ARENA)


def weighted(s, d, by_animal):
    r = regions(s, d).where("region is not null")
    c = r.groupBy("session_id", "label", "region").agg(F.count("*").alias("n"))
    t = r.groupBy("session_id", "label").agg(F.count("*").alias("w"))
    rows = c.join(t, ["session_id", "label"]).groupBy("session_id", "label", "w").agg(F.map_from_entries(F.collect_list(F.struct("region", F.col("n") / F.col("w")))).alias("pct"))
    return A.region_time_by_label(rows.withColumn("exp_group", F.col("session_id") % 3), ["exp_group", "label"] if by_animal else ["label"])


def share(s, d):
    from pyspark.sql import Window as W

    t = weighted(s, d, False)
    return r6(t.select("label", "region", (F.col("pct") / F.sum("pct").over(W.partitionBy("region"))).alias("share")))


def binned(s, d):
    return points(s, d).withColumn("bin", F.floor(F.col("frame") / BIN)).groupBy("session_id", "bin").agg(F.avg("y").alias("v"))


def distances(s, d):
    return points(s, d).select("session_id", "frame", A.edge_distance(SQUARE, F.col("x"), F.col("y")).alias("dist"))


def kin_table(s, d):
    return frames(s, d).groupBy(F.col("label").alias("cluster_id")).agg(F.avg("value").alias("mean_speed_px_s"), F.max("k").alias("mean_body_elongation_px"), F.min("k").alias("mean_angular_velocity_rad_s")).where("cluster_id <> 'view'")


def files(s, d):
    p = table(s, d, "session_data").where("path is not null").select("path").distinct()
    return p.select("path", F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.[^.]+$", "").alias("stem"))


def videos(s, d):
    ids = table(s, d, "session_data").where("session_id is not null and source <> 'swim_tank'").select("session_id").distinct()
    return ids.select(F.concat(F.lit("videos/"), "session_id", F.lit(".mp4")).alias("path"), F.col("session_id").alias("stem"))


def landmarks(s, d):
    names = table(s, d, "session_data").select(F.explode("bodyparts").alias("bodypart")).distinct()
    ref = table(s, d, "landmark_ref").select(F.col("alias").alias("bodypart"), "landmark", "body_region")
    return names.join(ref, "bodypart", "left").select("bodypart", "landmark", "body_region")


VEC = ("label", "embedding", 64)

QUERIES = {
    "point_in_polygon": in_shape,
    "edge_distance": lambda s, d: r6(distances(s, d)),
    "bin_region_labels": regions,
    "region_visits": visits,
    "region_summary": lambda s, d: r6(A.summary(visits(s, d), FPS)),
    "preference_index": lambda s, d: r6(A.preference(A.summary(visits(s, d), FPS), ROLES, "novel", "familiar", "discrimination_index")),
    "alternation_pct": lambda s, d: r6(A.alternation(visits(s, d), ARMS)),
    "open_arm_metrics": lambda s, d: r6(A.open_arms(visits(s, d), ["West"], ["East", "North"], FPS)),
    "occupancy_hist2d": lambda s, d: A.occupancy(points(s, d), 100.0, 100.0, 40),
    "outside_fraction": lambda s, d: r6(points(s, d).groupBy("session_id").agg(F.avg((~A.inside(TOP, F.col("x"), F.col("y"))).cast("double")).alias("outside"))),
    "region_time_weighted": lambda s, d: r6(weighted(s, d, False)),
    "region_time_by_group": lambda s, d: r6(weighted(s, d, True)),
    "region_time_share": share,
    "region_entropy": lambda s, d: r6(A.entropy(regions(s, d), "label", "region")),
    "region_composition": lambda s, d: r6(A.composition(regions(s, d), "label", "region")),
    "timecourse": lambda s, d: r6(A.timecourse(points(s, d).withColumn("y", F.round("y", 4)), "y")),
    "region_outline": lambda s, d: A.outline(points(s, d), "label"),
    "bout_bin_enrichment": lambda s, d: r6(E.bout_bins(bouts(s, d), binned(s, d), BIN, {"mean_v": F.avg("v"), "max_v": F.max("v"), "n_bins": F.count("v")}, 1)),
    "bout_directedness": lambda s, d: r6(E.directedness(bouts(s, d), points(s, d), FPS, 3)),
    "approach_avoid": lambda s, d: r6(E.approach_avoid(E.directedness(bouts(s, d), points(s, d), FPS, 2), distances(s, d), 15.0)),
    "kinematics_left_join": lambda s, d: r6(E.kinematics(bouts(s, d), kin_table(s, d))),
    "fuzzy_pairing": lambda s, d: E.pair_files(files(s, d), videos(s, d)),
    "complete_case_pairs": lambda s, d: r6(E.complete_cases(table(s, d, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v")).where("v > 80"), "user_id", "event_type", "v")),
    "group_by_folder": lambda s, d: files(s, d).select("path", E.first_prefix(None, "path", ["runs/arena_topcam", "runs/arena", "runs/own"]).alias("folder")),
    "canonical_landmark": landmarks,
    "cluster_centroids": lambda s, d: V.centroids(table(s, d, "embeddings"), *VEC).select("label", "n", F.posexplode("centroid").alias("dim", "value")).withColumn("value", F.round("value", 6)),
    "silhouette_squared": lambda s, d: r6(V.silhouette(table(s, d, "embeddings"), *VEC)),
    "nearest_to_centroid": lambda s, d: r6(V.nearest(table(s, d, "embeddings"), "vec_id", *VEC, 5)),
    "near_duplicate_fraction": lambda s, d: r6(V.near_duplicates(table(s, d, "embeddings"), "embedding", 1)),
    "centroid_cosine_distance": lambda s, d: r6(V.centroid_cosines(table(s, d, "embeddings"), *VEC)),
}


def _inside(shape: A.Shape) -> str:
    t = [f"CASE WHEN ({y1} > y) <> ({y2} > y) AND x < ({x2} - {x1}) * (y - {y1}) / ({y2} - {y1}) + {x1} THEN 1 ELSE 0 END" for (x1, y1), (x2, y2) in shape.edges() if y1 != y2]
    return f"(({' + '.join(t)}) % 2 = 1 AND x IS NOT NULL AND y IS NOT NULL)"


def _distance(shape: A.Shape) -> str:
    t = []
    for (x1, y1), (x2, y2) in shape.edges():
        dx, dy = x2 - x1, y2 - y1
        u = f"greatest(0, least(1, ((x - {x1}) * {dx} + (y - {y1}) * {dy}) / {dx * dx + dy * dy}))"
        t.append(f"sqrt(pow(x - ({x1} + {u} * {dx}), 2) + pow(y - ({y1} + {u} * {dy}), 2))")
    return f"least({', '.join(t)})"


PTS = f"""{FRAMES}, pt AS (SELECT session_id, frame, label, k AS x, CAST(value AS DOUBLE) AS y FROM f),
rg AS (SELECT *, CASE WHEN {_inside(SQUARE)} THEN 'West' WHEN {_inside(TRIANGLE)} THEN 'East' WHEN {_inside(TOP)} THEN 'North' WHEN {_inside(BORDER)} THEN 'Periphery' END AS region FROM pt),
vi AS (SELECT session_id, region, min(frame) AS start_frame, count(*) AS run_len FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, region ORDER BY frame) AS g FROM rg WHERE region IS NOT NULL) GROUP BY session_id, region, g),
su AS (SELECT session_id, region, sum(run_len) / 10.0 AS time_sec, count(*) AS entries, avg(run_len) / 10.0 AS mean_visit_sec FROM vi GROUP BY ALL)"""
WT = """cw AS (SELECT session_id, label, region, count(*) AS n FROM rg WHERE region IS NOT NULL GROUP BY ALL), tw AS (SELECT session_id, label, CAST(sum(n) AS DOUBLE) AS w FROM cw GROUP BY ALL),
px AS (SELECT cw.session_id % 3 AS exp_group, cw.label, region, w * (n / w) AS wn FROM cw JOIN tw ON cw.session_id = tw.session_id AND cw.label = tw.label)"""
DIR = """st AS (SELECT session_id, frame, x, y, x - lag(x) OVER w AS dx, y - lag(y) OVER w AS dy FROM pt WINDOW w AS (PARTITION BY session_id ORDER BY frame)),
jo AS (SELECT b.session_id, b.label, start_frame, run_len, frame, x, y, CASE WHEN frame > start_frame THEN sqrt(dx * dx + dy * dy) END AS step, dx, dy FROM b JOIN st ON b.session_id = st.session_id AND frame BETWEEN start_frame AND start_frame + run_len - 1),
di AS (SELECT session_id, label, start_frame, run_len, sqrt(pow(arg_max(x, frame) - arg_min(x, frame), 2) + pow(arg_max(y, frame) - arg_min(y, frame), 2)) AS net, coalesce(sum(step), 0) AS path,
  avg(dx / step) FILTER (step > 0) AS cx, avg(dy / step) FILTER (step > 0) AS cy FROM jo GROUP BY ALL)"""


def _dir(least: int) -> str:
    return f"SELECT session_id, label, start_frame, run_len, net AS net_displacement, path AS path_length, CASE WHEN run_len >= {least} THEN net / nullif(path, 0) END AS straightness_ratio, path * 10.0 / run_len AS mean_speed, sqrt(cx * cx + cy * cy) AS heading_consistency FROM di"


EM = "em AS (SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS dim, unnest(embedding)::DOUBLE AS v FROM embeddings), ce AS (SELECT label, dim, avg(v) AS c, count(*) AS n FROM em GROUP BY ALL)"

SQL = {
    "point_in_polygon": f"WITH {PTS} SELECT session_id, frame, {_inside(SQUARE)} AS in_west, {_inside(TRIANGLE)} AS in_east, {_inside(TOP)} AS in_north FROM pt",
    "edge_distance": f"WITH {PTS} SELECT session_id, frame, round({_distance(SQUARE)}, 6) AS dist FROM pt",
    "bin_region_labels": f"WITH {PTS} SELECT session_id, frame, label, region FROM rg",
    "region_visits": f"WITH {PTS} SELECT * FROM vi",
    "region_summary": f"WITH {PTS} SELECT session_id, region, round(time_sec, 6) AS time_sec, entries, round(mean_visit_sec, 6) AS mean_visit_sec FROM su",
    "preference_index": f"WITH {PTS}, ab AS (SELECT session_id, coalesce(sum(time_sec) FILTER (region = 'West'), 0) AS a, coalesce(sum(time_sec) FILTER (region = 'East'), 0) AS b FROM su GROUP BY 1) SELECT session_id, round((a - b) / (a + b), 6) AS discrimination_index FROM ab WHERE a + b > 0",
    "alternation_pct": f"""WITH {PTS}, e AS (SELECT session_id, region AS a, lead(region) OVER w AS b, lead(region, 2) OVER w AS c FROM vi WHERE region IN ('West', 'East', 'North') WINDOW w AS (PARTITION BY session_id ORDER BY start_frame))
      SELECT session_id, count(*) AS n_arm_entries, round(avg(CASE WHEN c IS NOT NULL THEN CASE WHEN a <> b AND b <> c AND a <> c THEN 100.0 ELSE 0 END END), 6) AS spontaneous_alternation_pct FROM e GROUP BY 1""",
    "open_arm_metrics": f"""WITH {PTS} SELECT session_id, round(coalesce(sum(run_len) FILTER (region = 'West'), 0) * 100.0 / sum(run_len), 6) AS pct_time_open_arms, round(avg(CASE WHEN region = 'West' THEN 100.0 ELSE 0 END), 6) AS pct_open_arm_entries,
      round(min(start_frame) FILTER (region = 'West') / 10.0, 6) AS latency_to_first_open_arm_entry_sec FROM vi WHERE region IN ('West', 'East', 'North') GROUP BY 1""",
    "occupancy_hist2d": f"WITH {PTS} SELECT session_id, CAST(floor(x * 40 / 100) AS INT) AS i, CAST(floor(y * 40 / 100) AS INT) AS j, count(*) AS n FROM pt WHERE x >= 0 AND x < 100 AND y >= 0 AND y < 100 GROUP BY ALL",
    "outside_fraction": f"WITH {PTS} SELECT session_id, round(avg(CASE WHEN {_inside(TOP)} THEN 0.0 ELSE 1 END), 6) AS outside FROM pt GROUP BY 1",
    "region_time_weighted": f"WITH {PTS}, {WT}, t AS (SELECT label, sum(w) AS w FROM tw GROUP BY 1) SELECT px.label, region, round(sum(wn) / any_value(t.w), 6) AS pct FROM px JOIN t ON px.label = t.label GROUP BY ALL",
    "region_time_by_group": f"WITH {PTS}, {WT}, t AS (SELECT session_id % 3 AS exp_group, label, sum(w) AS w FROM tw GROUP BY ALL) SELECT px.exp_group, px.label, region, round(sum(wn) / any_value(t.w), 6) AS pct FROM px JOIN t ON px.label = t.label AND px.exp_group = t.exp_group GROUP BY ALL",
    "region_time_share": f"WITH {PTS}, {WT}, t AS (SELECT label, sum(w) AS w FROM tw GROUP BY 1), p AS (SELECT px.label, region, sum(wn) / any_value(t.w) AS pct FROM px JOIN t ON px.label = t.label GROUP BY ALL) SELECT label, region, round(pct / sum(pct) OVER (PARTITION BY region), 6) AS share FROM p",
    "region_entropy": f"WITH {PTS}, c AS (SELECT label, region, count(*) AS n FROM rg WHERE region IS NOT NULL GROUP BY ALL), p AS (SELECT label, n / sum(n) OVER (PARTITION BY label) AS p FROM c) SELECT label, count(*) AS k, round(CASE WHEN count(*) > 1 THEN -sum(p * ln(p)) / ln(count(*)) ELSE 0 END, 6) AS entropy FROM p GROUP BY 1",
    "region_composition": f"WITH {PTS}, c AS (SELECT label, region, count(*) AS n FROM rg WHERE region IS NOT NULL GROUP BY ALL) SELECT label, region, round(n / sum(n) OVER (PARTITION BY label), 6) AS share FROM c",
    "timecourse": f"WITH {PTS}, t AS (SELECT session_id, max(frame) + 1 AS n FROM pt GROUP BY 1), p AS (SELECT session_id, CAST(frame * 10 // n AS INT) AS part, avg(round(y, 4)) AS v FROM pt JOIN t USING (session_id) GROUP BY ALL) SELECT part, count(v) AS n, round(avg(v), 6) AS mean, round(stddev_samp(v) / sqrt(count(v)), 6) AS sem FROM p GROUP BY 1",
    "bout_bin_enrichment": f"""WITH {PTS}, bi AS (SELECT session_id, frame // 4 AS bin, avg(y) AS v FROM pt GROUP BY ALL), t AS (SELECT session_id, max(bin) AS top FROM bi GROUP BY 1)
      SELECT b.session_id, b.label, start_frame, run_len, round(avg(v), 6) AS mean_v, round(max(v), 6) AS max_v, count(v) AS n_bins FROM b JOIN t ON b.session_id = t.session_id
      LEFT JOIN bi ON bi.session_id = b.session_id AND bin BETWEEN greatest(0, least(start_frame // 4 + 1, top)) AND greatest(0, least((start_frame + run_len - 1) // 4 + 1, top)) GROUP BY ALL""",
    "bout_directedness": f"WITH {PTS}, {DIR}, dd AS ({_dir(3)}) SELECT session_id, label, start_frame, run_len, {', '.join(f'round({c}, 6) AS {c}' for c in ('net_displacement', 'path_length', 'straightness_ratio', 'mean_speed', 'heading_consistency'))} FROM dd",
    "approach_avoid": f"""WITH {PTS}, {DIR}, dd AS ({_dir(2)}), ds AS (SELECT session_id, frame, {_distance(SQUARE)} AS dist FROM pt), md AS (SELECT session_id, median(mean_speed) AS mid FROM dd GROUP BY 1),
      n AS (SELECT *, lead(label) OVER w AS next_label, lead(mean_speed) OVER w AS next_speed FROM dd WINDOW w AS (PARTITION BY session_id ORDER BY start_frame)),
      e AS (SELECT n.*, a.dist AS d0, z.dist AS d1 FROM n JOIN md ON n.session_id = md.session_id LEFT JOIN ds a ON a.session_id = n.session_id AND a.frame = start_frame LEFT JOIN ds z ON z.session_id = n.session_id AND z.frame = start_frame + run_len - 1 WHERE straightness_ratio >= 0.7 AND mean_speed >= mid),
      k AS (SELECT *, coalesce(d1 <= 15 AND next_speed < mean_speed, false) AS ap, coalesce(d0 <= 15 AND d1 > d0, false) AS av FROM e)
      SELECT session_id, start_frame, start_frame + run_len - 1 AS end_frame, CASE WHEN ap AND av THEN 'both' WHEN ap THEN 'approach' ELSE 'avoid' END AS classification, round(straightness_ratio, 6) AS straightness_ratio, round(mean_speed, 6) AS mean_speed, next_label, round(next_speed, 6) AS next_speed FROM k WHERE ap OR av""",
    "kinematics_left_join": f"WITH {PTS}, kt AS (SELECT label, avg(value) AS a, max(k) AS m, min(k) AS l FROM f WHERE label <> 'view' GROUP BY 1) SELECT b.*, round(a, 6) AS mean_speed_px_s, round(m, 6) AS mean_body_elongation_px, round(l, 6) AS mean_angular_velocity_rad_s FROM b LEFT JOIN kt ON b.label = kt.label",
    "fuzzy_pairing": r"""WITH p AS (SELECT DISTINCT path, regexp_replace(regexp_extract(path, '([^/]+)$', 1), '\.[^.]+$', '') AS stem FROM session_data WHERE path IS NOT NULL), v AS (SELECT DISTINCT session_id AS s FROM session_data WHERE session_id IS NOT NULL AND source <> 'swim_tank'),
      m AS (SELECT path, s, CASE WHEN stem = s THEN 0 ELSE 1 END AS r, CASE WHEN stem = s THEN 0 WHEN starts_with(stem, s) THEN -length(s) ELSE -length(stem) END AS l FROM p JOIN v ON starts_with(stem, s) OR starts_with(s, stem))
      SELECT p.path, first('videos/' || s || '.mp4' ORDER BY r, l, s) FILTER (s IS NOT NULL) AS video FROM p LEFT JOIN m ON p.path = m.path GROUP BY 1""",
    "complete_case_pairs": "WITH x AS (SELECT user_id, event_type, max(value) AS v FROM events GROUP BY ALL HAVING max(value) > 80), n AS (SELECT count(DISTINCT event_type) AS n FROM x), c AS (SELECT user_id FROM x GROUP BY 1 HAVING count(*) = (SELECT n FROM n)) SELECT user_id, event_type, round(v, 6) AS v FROM x WHERE user_id IN (SELECT user_id FROM c)",
    "group_by_folder": "SELECT DISTINCT path, CASE WHEN starts_with(path, 'runs/arena_topcam') THEN 'runs/arena_topcam' WHEN starts_with(path, 'runs/arena') THEN 'runs/arena' WHEN starts_with(path, 'runs/own') THEN 'runs/own' END AS folder FROM session_data WHERE path IS NOT NULL",
    "canonical_landmark": "SELECT DISTINCT bodypart, landmark, body_region FROM (SELECT unnest(bodyparts) AS bodypart FROM session_data) n LEFT JOIN landmark_ref r ON n.bodypart = r.alias",
    "cluster_centroids": f"WITH {EM} SELECT label, n, CAST(dim AS INT) AS dim, round(c, 6) AS value FROM ce",
    "silhouette_squared": f"""WITH {EM}, pd AS (SELECT e.vec_id, e.label, c.label AS other, any_value(c.n) AS n, sum(pow(v - c, 2)) AS d FROM em e JOIN ce c ON e.dim = c.dim GROUP BY ALL), rad AS (SELECT label, avg(d) AS r FROM pd WHERE label = other GROUP BY 1),
      q AS (SELECT vec_id, pd.label, other, n, d + r AS d FROM pd JOIN rad ON rad.label = pd.other), ab AS (SELECT vec_id, label, max(d * n / nullif(n - 1, 0)) FILTER (label = other) AS a, min(d) FILTER (label <> other) AS b FROM q GROUP BY ALL)
      SELECT label, count(*) AS n, round(avg(CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END), 6) AS silhouette FROM ab GROUP BY 1""",
    "nearest_to_centroid": f"WITH {EM}, d AS (SELECT e.label, vec_id, sum(pow(v - c, 2)) AS d FROM em e JOIN ce c ON e.label = c.label AND e.dim = c.dim GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY d, vec_id) AS rank FROM d) SELECT label, rank, vec_id, round(sqrt(d), 6) AS dist FROM r WHERE rank <= 5",
    "near_duplicate_fraction": "WITH k AS (SELECT list_transform(embedding, lambda x: round(x::DOUBLE, 1) + 0.0) AS k, count(*) AS c FROM embeddings GROUP BY 1) SELECT CAST(sum(c) AS BIGINT) AS n, round(coalesce(sum(c) FILTER (c > 1), 0) / sum(c), 6) AS share FROM k",
    "centroid_cosine_distance": f"WITH {EM} SELECT a.label AS label_a, b.label AS label_b, round(1 - sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)), 6) AS distance FROM ce a JOIN ce b ON a.dim = b.dim AND a.label < b.label GROUP BY ALL",
}
