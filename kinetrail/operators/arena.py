"""Arena geometry and what animals do in it. Shapes are lists of vertices given as literals of the plan, so that every test of a
point against a shape is an expression of the row: no join, no Python.

A point on an edge counts as inside for the edges on the left and below (half-open even-odd rule). Null coordinates are in no
region and have no distance. A shape of fewer than three vertices contains nothing.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.operators.bouts import rle
from kinetrail.plans.runtime import join_dim
from kinetrail.plans.sequence import beside, home, in_shards, running

#: The name of what is left of the arena, by paradigm.
LEFTOVER = {
    "open_field": "Periphery", "y_maze": "Hub", "elevated_plus_maze": "Center", "three_chamber": "Center Chamber", "place_preference": "Middle/Neutral",
}


@dataclass(frozen=True)
class Shape:
    name: str
    vertices: tuple[tuple[float, float], ...]
    role: str | None = None

    def edges(self):
        v = self.vertices
        return [(v[i], v[(i + 1) % len(v)]) for i in range(len(v))]


@dataclass(frozen=True)
class Arena:
    paradigm: str = "custom"
    boundary: Shape | None = None
    regions: tuple[Shape, ...] = ()
    objects: tuple[Shape, ...] = ()
    per_session: dict = field(default_factory=dict)


def parse(text: str) -> Arena:
    """An arena from its JSON form; unknown keys are passed over, shapes without a name or vertices are refused."""
    j = json.loads(text)

    def shape(s: dict) -> Shape:
        if not s.get("name") or not s.get("vertices"):
            raise ValueError("a shape needs a name and vertices")
        return Shape(s["name"], tuple((float(x), float(y)) for x, y in s["vertices"]), s.get("role"))

    r = j.get("reference_shapes") or {}
    return Arena(
        j.get("paradigm", "custom"), shape(r["boundary"]) if r.get("boundary") else None, tuple(map(shape, r.get("regions") or [])), tuple(map(shape, r.get("objects") or [])), j.get("per_video") or {}
    )


def resolve(arena: Arena | None, session: str) -> Arena:
    """The shapes of one session: the reference; all of it, the boundary too, moved by its ``translate``, or replaced by its ``shapes``
    when it overrides; with its own roles in either case. No arena has no shapes."""
    if arena is None:
        return Arena()
    own = arena.per_session.get(session) or {}
    boundary, regions, objects = arena.boundary, arena.regions, arena.objects
    if own.get("mode") == "override":
        new = parse(json.dumps({"reference_shapes": own.get("shapes") or {}}))
        boundary, regions, objects = new.boundary, new.regions, new.objects
    elif own.get("mode") == "transform":
        dx, dy = own.get("translate") or (0, 0)
        move = lambda s: Shape(s.name, tuple((x + dx, y + dy) for x, y in s.vertices), s.role)
        boundary, regions, objects = move(boundary) if boundary else None, tuple(map(move, regions)), tuple(map(move, objects))
    roles = own.get("role_overrides") or {}
    role = lambda s: Shape(s.name, s.vertices, roles.get(s.name, s.role))
    return Arena(arena.paradigm, boundary, tuple(map(role, regions)), tuple(map(role, objects)))


def by_session(arena: Arena, session: Column, of) -> Column:
    """A column of each session's own arena: ``of`` makes it from an arena; sessions without an entry of their own use the reference."""
    c = of(resolve(arena, ""))
    for name in sorted(arena.per_session):
        c = F.when(session == name, of(resolve(arena, name))).otherwise(c)
    return c


def inside(shape: Shape, x: Column, y: Column) -> Column:
    if len(shape.vertices) < 3:
        return F.lit(False)
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in shape.edges():
        if y1 != y2:
            over = (F.lit(y1) > y) != (F.lit(y2) > y)
            crossings = crossings + F.when(over & (x < (x2 - x1) * (y - y1) / (y2 - y1) + x1), 1).otherwise(0)
    return F.coalesce((crossings % 2 == 1) & x.isNotNull() & y.isNotNull(), F.lit(False))


def edge_distance(shape: Shape, x: Column, y: Column) -> Column:
    """Distance to the nearest edge, inside and out alike."""
    d = []
    for (x1, y1), (x2, y2) in shape.edges():
        dx, dy = x2 - x1, y2 - y1
        n = dx * dx + dy * dy
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - x1) * dx + (y - y1) * dy) / n)) if n else F.lit(0.0)
        d.append(F.hypot(x - (x1 + t * dx), y - (y1 + t * dy)))
    return F.when(x.isNotNull() & y.isNotNull(), F.least(*d) if len(d) > 1 else d[0])


def region_of(arena: Arena, x: Column, y: Column) -> Column:
    """The first traced region that holds the point, else the arena's leftover name within the boundary, else null."""
    c = F.lit(None).cast("string")
    if arena.boundary and arena.paradigm in LEFTOVER:
        c = F.when(inside(arena.boundary, x, y), F.lit(LEFTOVER[arena.paradigm]))
    for s in reversed(arena.regions):
        c = F.when(inside(s, x, y), F.lit(s.name)).otherwise(c)
    return c


def visits(points: DataFrame, arena: Arena) -> DataFrame:
    """``points``: session_id, frame, x, y. Bouts of regions: session_id, region, start_frame, run_len. A start inside counts
    as an entry; frames in no region end a visit."""
    f = points.select("session_id", "frame", region_of(arena, F.col("x"), F.col("y")).alias("label"))
    return rle(f).withColumnRenamed("label", "region")


def summary(v: DataFrame, fps: float) -> DataFrame:
    return v.groupBy("session_id", "region").agg((F.sum("run_len") / fps).alias("time_sec"), F.count("*").alias("entries"), (F.avg("run_len") / fps).alias("mean_visit_sec"))


def preference(times: DataFrame, regions: dict[str, str], a: str, b: str, name: str) -> DataFrame:
    """(a - b) / (a + b) of the times in the regions of two roles; sessions without any time in both are left out."""
    t = [F.sum(F.when(F.col("region").isin([r for r, role in regions.items() if role == k]), F.col("time_sec")).otherwise(0.0)).alias(k) for k in (a, b)]
    if not {a, b} <= set(regions.values()):
        raise ValueError(f"no region has the role {a} or {b}")
    s = times.groupBy("session_id").agg(*t)
    return s.select("session_id", F.try_divide(F.col(a) - F.col(b), F.col(a) + F.col(b)).alias(name)).where(F.col(name).isNotNull())


def alternation(v: DataFrame, arms: list[str]) -> DataFrame:
    """Entries into arms and the share of successive triplets of three different arms, in percent; null below three entries."""
    if len(arms) < 3:
        raise ValueError("alternation needs three arms")
    w = in_shards(["session_id"], "start_frame")
    e = beside(v.where(F.col("region").isin(arms)).select("session_id", "start_frame", "region"), ["session_id"], "start_frame", 0, 2)
    e = home(e.select("*", F.lead("region", 1).over(w).alias("b"), F.lead("region", 2).over(w).alias("c")))
    good = (F.col("region") != F.col("b")) & (F.col("b") != F.col("c")) & (F.col("region") != F.col("c"))
    return e.groupBy("session_id").agg(F.count("*").alias("n_arm_entries"), F.avg(F.when(F.col("c").isNotNull(), good.cast("double") * 100)).alias("spontaneous_alternation_pct"))


def open_arms(v: DataFrame, open_: list[str], closed: list[str], fps: float) -> DataFrame:
    is_open = F.col("region").isin(open_)
    a = v.where(F.col("region").isin(open_ + closed)).groupBy("session_id")
    return a.agg(
        F.try_divide(F.sum(F.when(is_open, F.col("run_len")).otherwise(0)) * 100.0, F.sum("run_len")).alias("pct_time_open_arms"),
        (F.avg(is_open.cast("double")) * 100).alias("pct_open_arm_entries"),
        (F.min(F.when(is_open, F.col("start_frame"))) / fps).alias("latency_to_first_open_arm_entry_sec"),
    )


def occupancy(points: DataFrame, width: float, height: float, cells: int = 40) -> DataFrame:
    """Counts on a grid; points outside it are left out."""
    p = points.where((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < height))
    return p.groupBy("session_id", F.floor(F.col("x") * cells / width).cast("int").alias("i"), F.floor(F.col("y") * cells / height).cast("int").alias("j")).agg(F.count("*").alias("n"))


def region_time_by_label(rows: DataFrame, by: list[str]) -> DataFrame:
    """Weighted mean share of time in each region: sum(w * pct) / sum(w) with weights above 0; a region missing from a row
    counts 0. ``rows``: by, w, pct (map from region to share)."""
    r = rows.where("w > 0")
    total = r.groupBy(*by).agg(F.sum("w").alias("_w"))
    s = r.select(*by, "w", F.explode("pct").alias("region", "v")).groupBy(*by, "region").agg(F.sum(F.col("w") * F.col("v")).alias("_s"))
    return s.join(total, by).select(*by, "region", (F.col("_s") / F.col("_w")).alias("pct"))


def entropy(rows: DataFrame, cluster: str, region: str) -> DataFrame:
    """Normalised entropy of the regions of each cluster: 0 for one region, 1 for an even spread over those it has."""
    c = rows.where(F.col(cluster).isNotNull() & F.col(region).isNotNull()).groupBy(cluster, region).agg(F.count("*").alias("n"))
    t = c.groupBy(cluster).agg(F.sum("n").alias("_n"), F.count("*").alias("k"))
    p = F.col("n") / F.col("_n")
    return c.join(t, cluster).groupBy(cluster, "k").agg((-F.sum(p * F.ln(p))).alias("h")).select(cluster, "k", F.when(F.col("k") > 1, F.col("h") / F.ln(F.col("k").cast("double"))).otherwise(0.0).alias("entropy"))


def composition(rows: DataFrame, cluster: str, region: str) -> DataFrame:
    c = rows.where(F.col(cluster).isNotNull() & F.col(region).isNotNull()).groupBy(cluster, region).agg(F.count("*").alias("n"))
    t = c.groupBy(cluster).agg(F.sum("n").alias("_n"))
    return c.join(t, cluster).select(cluster, region, (F.col("n") / F.col("_n")).alias("share"))


def timecourse(rows: DataFrame, value: str, parts: int = 10) -> DataFrame:
    """Mean and standard error over sessions of a value by tenths (``parts``) of each session."""
    top = rows.groupBy("session_id").agg((F.max("frame") + 1).alias("_n"))
    r = rows.join(top, "session_id").withColumn("part", F.floor(F.col("frame") * parts / F.col("_n")).cast("int"))
    per = r.groupBy("session_id", "part").agg(F.avg(value).alias("v"))
    return per.groupBy("part").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"))


def hull_points(xy: list[tuple[float, float]]) -> list[tuple[float, float]]:
    p = sorted(set(xy))
    if len(p) < 3:
        return []

    def half(pts):
        h: list = []
        for q in pts:
            while len(h) > 1 and (h[-1][0] - h[-2][0]) * (q[1] - h[-2][1]) - (h[-1][1] - h[-2][1]) * (q[0] - h[-2][0]) <= 0:
                h.pop()
            h.append(q)
        return h[:-1]

    h = half(p) + half(p[::-1])
    return h if len(h) > 2 else []


def outline(points: DataFrame, by: str) -> DataFrame:
    """Convex hull of the points of each group, counter-clockwise from the leftmost: by, k, x, y. Fewer than three different
    points, or points on a line, have none. Points are first thinned to the hull of each salt, so a huge group is no one task."""
    schema = f"{by} {dict(points.dtypes)[by]}, k int, x double, y double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        h = hull_points(list(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
        return pd.DataFrame({by: pdf[by].iloc[0], "k": range(len(h)), "x": [a for a, _ in h], "y": [b for _, b in h]})

    def thin(pdf: pd.DataFrame) -> pd.DataFrame:
        xy = sorted(set(zip(pdf["x"].tolist(), pdf["y"].tolist(), strict=True)))
        h = hull_points(xy) or [xy[0], xy[-1]]
        return pd.DataFrame({by: pdf[by].iloc[0], "k": range(len(h)), "x": [a for a, _ in h], "y": [b for _, b in h]})

    p = points.where("x is not null and y is not null and not isnan(x) and not isnan(y)").select(by, "x", "y").withColumn("_s", F.pmod(F.xxhash64("x", "y"), F.lit(256)))
    part = p.groupBy(by, "_s").applyInPandas(lambda pdf: thin(pdf), schema)
    return part.groupBy(by).applyInPandas(run, schema)


def centroid_points(pose: DataFrame) -> DataFrame:
    """session_id, frame, x, y: the mean over the body parts that are known."""
    p = pose.where("x is not null and y is not null")
    return p.groupBy("session_id", "frame").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def nose_points(pose: DataFrame, names: tuple[str, ...] = ("nose", "snout")) -> DataFrame:
    """session_id, frame, x, y of the nose, the first of the names that a frame has."""
    rank = F.coalesce(*[F.when(F.lower("bodypart") == n, i) for i, n in enumerate(names)])
    p = pose.where("x is not null and y is not null").withColumn("_r", rank).where("_r is not null")
    return p.groupBy("session_id", "frame").agg(F.min_by(F.struct("x", "y"), "_r").alias("p")).select("session_id", "frame", "p.x", "p.y")


def thresholds(sessions: DataFrame, spine: DataFrame, given: float | None = None, default: float = 50.0) -> DataFrame:
    """session_id, threshold: what is given, else the session's median spine length, else ``default`` px."""
    if given is not None:
        return sessions.select("session_id").distinct().withColumn("threshold", F.lit(float(given)))
    return sessions.select("session_id").distinct().join(spine.select("session_id", "spine"), "session_id", "left").select("session_id", F.coalesce("spine", F.lit(default)).alias("threshold"))


def interactions(nose: DataFrame, arena: Arena, threshold: Column) -> DataFrame:
    """Bouts in which the nose is inside an object or within ``threshold`` of its edge: session_id, object, start_frame, run_len."""
    x, y = F.col("x"), F.col("y")
    near = F.array_compact(F.array(*[F.when(inside(o, x, y) | (edge_distance(o, x, y) <= threshold), F.lit(o.name)) for o in arena.objects]))
    f = nose.select(F.struct("session_id").alias("_s"), "frame", F.explode(near).alias("label"))
    # objects may overlap, so each has a sequence of its own
    f = f.select(F.struct(F.col("_s.session_id").alias("s"), F.col("label").alias("o")).alias("session_id"), "frame", F.lit(1).alias("label"))
    return rle(f).select(F.col("session_id.s").alias("session_id"), F.col("session_id.o").alias("object"), "start_frame", "run_len")


def interaction_summary(bouts: DataFrame, fps: float) -> DataFrame:
    """session_id, object, total_interaction_time_sec, object_interaction_bouts, longest_sec, latency_sec."""
    return bouts.groupBy("session_id", "object").agg(
        (F.sum("run_len") / fps).alias("total_interaction_time_sec"), F.count("*").alias("object_interaction_bouts"), (F.max("run_len") / fps).alias("longest_sec"), (F.min("start_frame") / fps).alias("latency_sec")
    )


def roles(shapes: tuple[Shape, ...]) -> dict[str, str]:
    return {s.name: s.role for s in shapes if s.role}


def outside_boundary(points: DataFrame, arena: Arena) -> DataFrame | None:
    """Share of frames outside the boundary by session; None where no boundary was traced."""
    if arena.boundary is None:
        return None
    return points.groupBy("session_id").agg(F.avg((~inside(arena.boundary, F.col("x"), F.col("y"))).cast("double")).alias("nose_outside_boundary"))


#: The indices of the paradigms, from the times in shapes of two roles.
INDICES = [
    ("discrimination_index", "novel", "familiar"),
    ("preference_index", "paired", "unpaired"),
    ("sociability_index", "stranger", "empty"),
    ("social_novelty_index", "novel_stranger", "stranger"),
]


def role_indices(times: DataFrame, role_of: dict[str, str], shape: str = "region") -> DataFrame:
    """session_id, metric, value of every index of which both roles are there: (a - b) / (a + b); others are left out, as are sessions
    without any time in both. ``times``: session_id, shape, time_sec."""
    has = set(role_of.values())
    rows = []
    for name, a, b in INDICES:
        if {a, b} <= has:
            of = lambda r: F.sum(F.when(F.col(shape).isin([k for k, v in role_of.items() if v == r]), F.col("time_sec")).otherwise(0.0))
            rows.append(F.struct(F.lit(name).alias("metric"), F.try_divide(of(a) - of(b), of(a) + of(b)).alias("value")))
    if not rows:
        return times.select("session_id", F.lit("").alias("metric"), F.lit(0.0).alias("value")).limit(0)
    return times.groupBy("session_id").agg(F.array(*rows).alias("m")).select("session_id", F.explode("m").alias("m")).select("session_id", "m.*").where("value is not null")


def arm_metrics(v: DataFrame, role_of: dict[str, str], fps: float) -> DataFrame | None:
    """Open and closed arm measures by roles; None where one of the two roles is missing."""
    pick = lambda r: [k for k, x in role_of.items() if x == r]
    return open_arms(v, pick("open_arm"), pick("closed_arm"), fps) if pick("open_arm") and pick("closed_arm") else None


def crossings(v: DataFrame, fps: float) -> DataFrame:
    """Every entry into a region with the number of entries of its session so far: session_id, region, at_sec, crossings."""
    c = running(v.withColumn("_one", F.lit(1)), ["session_id"], "start_frame", ["start_frame"], "sum", "_one", "_b")
    return c.select("session_id", "region", (F.col("start_frame") / fps).alias("at_sec"), (F.coalesce("_b", F.lit(0)) + 1).alias("crossings"))


def ethogram(frames: DataFrame, parts: int = 20) -> DataFrame:
    """The most frequent label of each part of a session (ties: the first in order) and its share: session_id, part, label, share."""
    top = frames.groupBy("session_id").agg((F.max("frame") + 1).alias("_n"))
    r = join_dim(frames.where("label is not null").select("session_id", "frame", "label"), top, ["session_id"], "inner").withColumn("part", F.floor(F.col("frame") * parts / F.col("_n")).cast("int"))
    c = r.groupBy("session_id", "part", "label").agg(F.count("*").alias("n"))
    best = c.groupBy("session_id", "part").agg(F.min_by(F.struct("label", "n"), F.struct((-F.col("n")).alias("k"), "label")).alias("m"), F.sum("n").alias("t"))
    return best.select("session_id", "part", "m.label", (F.col("m.n") / F.col("t")).alias("share"))


def paired(df: DataFrame, member: str, level: str, value: str, a, b) -> DataFrame:
    """member, before, after, change of the members that have both levels (means, where a level has several rows)."""
    of = lambda x: F.avg(F.when(F.col(level) == x, F.col(value)))
    p = df.where(F.col(member).isNotNull()).groupBy(member).agg(of(a).alias("before"), of(b).alias("after")).where("before is not null and after is not null")
    return p.withColumn("change", F.col("after") - F.col("before"))
