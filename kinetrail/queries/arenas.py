"""Arenas over ``pose_track``: nose and centroid series, objects, roles, boundaries, kinematics of labels."""

from pyspark.sql import functions as F

from kinetrail.operators import arena as A
from kinetrail.operators import bouts as B
from kinetrail.operators import enrich as E
from kinetrail.operators import features as X
from kinetrail.operators import matrix as M
from kinetrail.plans.runtime import cut, table
from kinetrail.queries import space as SP
from kinetrail.queries.behaviour import FPS, frames, r6
from kinetrail.queries.matrix import part_list
from kinetrail.queries.tracks import BINS, POSE, bins, pose, sessions

SQ = lambda name, x, y, w, h, role: A.Shape(name, ((x, y), (x + w, y), (x + w, y + h), (x, y + h)), role)
HALL = A.Arena(
    "three_chamber",
    SQ("Hall", 0.5, 0.5, 800.0, 600.0, None),
    (SQ("Left", 0.5, 0.5, 250.0, 600.0, "stranger"), SQ("Right", 550.5, 0.5, 250.0, 600.0, "empty")),
    (SQ("Cup A", 150.0, 150.0, 60.0, 60.0, "novel"), SQ("Cup B", 600.0, 300.0, 60.0, 60.0, "familiar")),
    {"hcl_0000000": {"mode": "transform", "translate": [40, -20], "role_overrides": {"Cup A": "familiar", "Cup B": "novel"}}},
)
NEAR = 60.0


def nose(s, d):
    return A.nose_points(pose(s, d))


def centre(s, d):
    return A.centroid_points(pose(s, d))


def spine(s, d):
    return M.spine_length(pose(s, d), cut(M.spine_ends(part_list(s, d))))


def both_ends(s, d):
    p = pose(s, d).join(cut(M.spine_ends(part_list(s, d))), "session_id").where("x is not null and y is not null")
    at = lambda c, v: F.max(F.when(F.col("bodypart") == F.col(c), F.col(v)))
    return p.groupBy("session_id", "frame").agg(at("head", "x").alias("hx"), at("head", "y").alias("hy"), at("tail", "x").alias("tx"), at("tail", "y").alias("ty"))


def parts_seen(s, d):
    """A label of each frame: how many body parts it has."""
    return pose(s, d).where("x is not null and y is not null").groupBy("session_id", "frame").agg(F.count("*").alias("label"))


def contacts(s, d):
    return A.interactions(nose(s, d), HALL, F.lit(NEAR))


def object_times(s, d):
    return A.interaction_summary(contacts(s, d), FPS).select("session_id", F.col("object").alias("region"), F.col("total_interaction_time_sec").alias("time_sec"))


def region_times(s, d):
    return A.summary(A.visits(centre(s, d), HALL), FPS)


def visits(s, d):
    return SP.visits(s, d)


def moved(s, d):
    """Region of every nose point in its own session's arena."""
    x, y = F.col("x"), F.col("y")
    return nose(s, d).select("session_id", "frame", A.by_session(HALL, F.col("session_id"), lambda a: A.region_of(a, x, y)).alias("region"))


def clean_rows(s, d):
    """Frames by label (-1 for views) that are no noise, in no search and of a value above 0."""
    f = frames(s, d).withColumn("label", F.when(F.col("label") == "view", "-1").otherwise(F.col("label")))
    return B.usable(f.select("session_id", "frame", "label", "value"), ["session_id", "frame"], f.where("label = 'search'"), "value").select("session_id", "frame", "label")


QUERIES = {
    "centroid_series": lambda s, d: r6(centre(s, d)),
    "nose_series": lambda s, d: r6(nose(s, d)),
    "nose_edge_distance": lambda s, d: r6(nose(s, d).select("session_id", "frame", A.edge_distance(HALL.regions[0], F.col("x"), F.col("y")).alias("dist"))),
    "session_arena_regions": moved,
    "object_interactions": contacts,
    "object_interaction_summary": lambda s, d: r6(A.interaction_summary(contacts(s, d), FPS)),
    "interaction_threshold": lambda s, d: r6(A.thresholds(sessions(s, d).where("session_id is not null"), spine(s, d))),
    "nose_outside_boundary": lambda s, d: r6(A.outside_boundary(nose(s, d), HALL)),
    "object_role_indices": lambda s, d: r6(A.role_indices(object_times(s, d), A.roles(HALL.objects))),
    "region_role_indices": lambda s, d: r6(A.role_indices(region_times(s, d), A.roles(HALL.regions))),
    "leftover_chamber_times": lambda s, d: r6(region_times(s, d)),
    "cumulative_crossings": lambda s, d: r6(A.crossings(visits(s, d), FPS)),
    "ethogram_strip": lambda s, d: r6(A.ethogram(frames(s, d), 5)),
    "paired_change": lambda s, d: r6(A.paired(table(s, d, "events"), "user_id", "event_type", "value", "view", "purchase")),
    "cluster_kinematics": lambda s, d: r6(E.cluster_kinematics(parts_seen(s, d), centre(s, d), both_ends(s, d), FPS)),
    "cluster_confidence": lambda s, d: r6(E.cluster_confidence(bins(s, d).groupBy("session_id", "bin").agg(F.count("likelihood").alias("label")), X.visibility(bins(s, d), {}, 0.3), 0.9)),
    "usable_rows": clean_rows,
    "session_stems": lambda s, d: table(s, d, "session_data").where("session_id is not null").select(F.concat(F.lit("out/"), "session_id", F.when(F.col("fps") > 30, "_bout_lengths_hmm.csv").otherwise("_bout_lengths.csv")).alias("path")).distinct().select("path", B.session_stem(F.col("path")).alias("stem")),
    "approach_targets": lambda s, d: r6(E.toward(cut(E.directedness(SP.bouts(s, d), SP.points(s, d), FPS, 2)), {"west": SP.distances(s, d)}, 15.0, "region")).select("session_id", "start_frame", "classification", "target_region"),
}

_P = f"{POSE}, ce AS (SELECT session_id, frame, avg(x) AS x, avg(y) AS y FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), no AS (SELECT session_id, frame, arg_min(x, r) AS x, arg_min(y, r) AS y FROM (SELECT *, CASE lower(bodypart) WHEN 'nose' THEN 0 WHEN 'snout' THEN 1 END AS r FROM p WHERE x IS NOT NULL AND y IS NOT NULL) WHERE r IS NOT NULL GROUP BY ALL)"
_IN, _DI = SP._inside, SP._distance


def _regions(src: str, arena: A.Arena, out: str) -> str:
    r = " ".join(f"WHEN {_IN(x)} THEN '{x.name}'" for x in arena.regions)
    return f"{out} AS (SELECT session_id, frame, CASE {r} WHEN {_IN(arena.boundary)} THEN 'Center Chamber' END AS region FROM {src})"


_OBJ = "ob AS (" + " UNION ALL ".join(f"SELECT session_id, frame, '{o.name}' AS object FROM no WHERE {_IN(o)} OR {_DI(o)} <= {NEAR}" for o in HALL.objects) + "), oi AS (SELECT session_id, object, min(frame) AS start_frame, count(*) AS run_len FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, object ORDER BY frame) AS g FROM ob) GROUP BY session_id, object, g)"
_VIS = f"{_P}, {_regions('ce', HALL, 'rg')}, vi AS (SELECT session_id, region, count(*) AS run_len FROM (SELECT *, frame - row_number() OVER (PARTITION BY session_id, region ORDER BY frame) AS g FROM rg WHERE region IS NOT NULL) GROUP BY session_id, region, g)"
_ENDS = f"n AS (SELECT DISTINCT session_id, unnest(bodyparts) AS bodypart FROM session_data WHERE session_id IS NOT NULL), r AS (SELECT *, CASE {' '.join(f'''WHEN contains(lower(bodypart), '{w}') THEN {i}''' for i, w in enumerate(M.HEAD_WORDS))} END AS h, CASE {' '.join(f'''WHEN contains(lower(bodypart), '{w}') THEN {i}''' for i, w in enumerate(M.TAIL_WORDS))} END AS t FROM n), en0 AS (SELECT session_id, first(bodypart ORDER BY h, bodypart) FILTER (h IS NOT NULL) AS head, first(bodypart ORDER BY t, bodypart) FILTER (t IS NOT NULL) AS tail FROM r GROUP BY 1), en AS (SELECT * FROM en0 WHERE head <> tail), fe AS (SELECT p.session_id, frame, max(x) FILTER (bodypart = head) AS hx, max(y) FILTER (bodypart = head) AS hy, max(x) FILTER (bodypart = tail) AS tx, max(y) FILTER (bodypart = tail) AS ty FROM p JOIN en USING (session_id) WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL)"


def _index(src: str, col: str, roles: dict[str, str]) -> str:
    parts = []
    for name, a, b in A.INDICES:
        if {a, b} <= set(roles.values()):
            of = lambda r: f"coalesce(sum(t) FILTER ({col} IN ({', '.join(repr(k) for k, v in roles.items() if v == r)})), 0)"
            parts.append(f"SELECT session_id, '{name}' AS metric, ({of(a)} - {of(b)}) / nullif({of(a)} + {of(b)}, 0) AS value FROM {src} GROUP BY 1")
    return "SELECT session_id, metric, round(value, 6) AS value FROM (" + " UNION ALL ".join(parts) + ") WHERE value IS NOT NULL"


SQL = {
    "centroid_series": f"WITH {_P} SELECT session_id, frame, round(x, 6) AS x, round(y, 6) AS y FROM ce",
    "nose_series": f"WITH {_P} SELECT session_id, frame, round(x, 6) AS x, round(y, 6) AS y FROM no",
    "nose_edge_distance": f"WITH {_P} SELECT session_id, frame, round({_DI(HALL.regions[0])}, 6) AS dist FROM no",
    "session_arena_regions": f"WITH {_P}, na AS (SELECT * FROM no WHERE session_id = 'hcl_0000000'), nb AS (SELECT * FROM no WHERE session_id <> 'hcl_0000000'), {_regions('na', A.resolve(HALL, 'hcl_0000000'), 'ra')}, {_regions('nb', HALL, 'rb')} SELECT * FROM ra UNION ALL SELECT * FROM rb",
    "object_interactions": f"WITH {_P}, {_OBJ} SELECT session_id, object, start_frame, run_len FROM oi",
    "object_interaction_summary": f"WITH {_P}, {_OBJ} SELECT session_id, object, round(sum(run_len) / 10.0, 6) AS total_interaction_time_sec, count(*) AS object_interaction_bouts, round(max(run_len) / 10.0, 6) AS longest_sec, round(min(start_frame) / 10.0, 6) AS latency_sec FROM oi GROUP BY ALL",
    "interaction_threshold": f"WITH {POSE}, {_ENDS}, sp AS (SELECT session_id, greatest(10, median(round(sqrt(pow(hx - tx, 2) + pow(hy - ty, 2)), 2))) AS t FROM fe WHERE hx IS NOT NULL AND tx IS NOT NULL GROUP BY 1) SELECT se.session_id, round(coalesce(t, 50), 6) AS threshold FROM se LEFT JOIN sp USING (session_id) WHERE se.session_id IS NOT NULL",
    "nose_outside_boundary": f"WITH {_P} SELECT session_id, round(avg(CASE WHEN {_IN(HALL.boundary)} THEN 0.0 ELSE 1 END), 6) AS nose_outside_boundary FROM no GROUP BY 1",
    "object_role_indices": f"WITH {_P}, {_OBJ}, ot AS (SELECT session_id, object, run_len / 10.0 AS t FROM oi) {_index('ot', 'object', A.roles(HALL.objects))}",
    "region_role_indices": f"WITH {_VIS}, ot AS (SELECT session_id, region, run_len / 10.0 AS t FROM vi) {_index('ot', 'region', A.roles(HALL.regions))}",
    "leftover_chamber_times": f"WITH {_VIS} SELECT session_id, region, round(sum(run_len) / 10.0, 6) AS time_sec, count(*) AS entries, round(avg(run_len) / 10.0, 6) AS mean_visit_sec FROM vi GROUP BY ALL",
    "cumulative_crossings": f"WITH {SP.PTS} SELECT session_id, region, round(start_frame / 10.0, 6) AS at_sec, row_number() OVER (PARTITION BY session_id ORDER BY start_frame) AS crossings FROM vi",
    "ethogram_strip": f"WITH {SP.FRAMES}, n AS (SELECT session_id, max(frame) + 1 AS n FROM f GROUP BY 1), c AS (SELECT session_id, CAST(frame * 5 // n AS INT) AS part, label, count(*) AS k FROM f JOIN n USING (session_id) GROUP BY ALL) SELECT session_id, part, first(label ORDER BY k DESC, label) AS label, round(max(k) / sum(k), 6) AS share FROM c GROUP BY ALL",
    "paired_change": "WITH p AS (SELECT user_id, avg(value) FILTER (event_type = 'view') AS a, avg(value) FILTER (event_type = 'purchase') AS b FROM events GROUP BY 1) SELECT user_id, round(a, 6) AS before, round(b, 6) AS after, round(b - a, 6) AS change FROM p WHERE a IS NOT NULL AND b IS NOT NULL",
    "cluster_kinematics": f"""WITH {_P}, {_ENDS}, lb AS (SELECT session_id, frame, count(*) AS label FROM p WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL), j AS (SELECT coalesce(ce.session_id, fe.session_id) AS session_id, coalesce(ce.frame, fe.frame) AS frame, x, y, hx, hy, tx, ty, atan2(hy - ty, hx - tx) AS hd FROM ce FULL JOIN fe ON ce.session_id = fe.session_id AND ce.frame = fe.frame),
      k AS (SELECT *, CASE WHEN lag(frame) OVER w = frame - 1 THEN sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) * 10 END AS sp, CASE WHEN lag(frame) OVER w = frame - 1 THEN hd - lag(hd) OVER w END AS tu, sqrt(pow(hx - tx, 2) + pow(hy - ty, 2)) AS lo FROM j WINDOW w AS (PARTITION BY session_id ORDER BY frame))
      SELECT label AS cluster_id, round(avg(sp), 6) AS mean_speed_px_s, round(avg(lo), 6) AS mean_body_elongation_px, round(avg(abs(tu - 2 * pi() * floor((tu + pi()) / (2 * pi()))) * 10), 6) AS mean_angular_velocity_rad_s FROM k JOIN lb USING (session_id, frame) GROUP BY 1""",
    "cluster_confidence": f"WITH {BINS}, v2 AS (SELECT session_id, bin, count(likelihood) AS label, avg(likelihood) AS m FROM q GROUP BY ALL) SELECT label, count(m) AS n, round(avg(m), 6) AS mean_visibility, avg(m) < 0.9 AS low FROM v2 GROUP BY 1",
    "usable_rows": f"WITH {SP.FRAMES} SELECT session_id, frame, label FROM f WHERE label NOT IN ('view', 'search') AND value > 0",
    "session_stems": "SELECT DISTINCT 'out/' || session_id || CASE WHEN fps > 30 THEN '_bout_lengths_hmm.csv' ELSE '_bout_lengths.csv' END AS path, session_id AS stem FROM session_data WHERE session_id IS NOT NULL",
    "approach_targets": SP.SQL["approach_avoid"].replace("SELECT session_id, start_frame, start_frame + run_len - 1 AS end_frame, CASE", "SELECT session_id, start_frame, CASE").split(" AS classification")[0] + " AS classification, 'west' AS target_region FROM k WHERE ap OR av",
}
