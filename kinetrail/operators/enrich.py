"""Bouts joined with what happened in their bins and frames, and tables joined by name.

Bout and bin meet in equi-joins: a bout is expanded to the bins it covers, never compared with all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.plans.ranks import quantiles
from kinetrail.plans.sequence import beside, halo, home, in_shards


def bout_bins(bouts: DataFrame, bins: DataFrame, win: int, aggs: dict[str, Column], offset: int = 0) -> DataFrame:
    """Aggregates of the bins a bout covers (clamped to the bins there are). ``bins``: session_id, bin from 0, values. Bouts
    of a session without bins come out with nulls."""
    bouts = bouts.select("session_id", "label", "start_frame", "run_len")
    bins = bins.drop("label", "start_frame", "run_len", "_top")
    top = bins.groupBy("session_id").agg(F.max("bin").alias("_top"))
    b = bouts.join(top, "session_id", "left")
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.floor(c / win) + offset, F.col("_top")))
    e = b.withColumn("bin", F.explode_outer(F.when(F.col("_top").isNotNull(), F.sequence(clamp(F.col("start_frame")), clamp(F.col("start_frame") + F.col("run_len") - 1)))))
    j = e.join(bins, ["session_id", "bin"], "left")
    return j.groupBy("session_id", "label", "start_frame", "run_len").agg(*[c.alias(n) for n, c in aggs.items()])


def directedness(bouts: DataFrame, points: DataFrame, fps: float, least: int = 5) -> DataFrame:
    """Net displacement, path length, straightness (null below ``least`` frames or without a path), mean speed, and heading
    consistency (length of the mean unit step over the steps that move) of every bout. ``points``: session_id, frame, x, y."""
    bouts = bouts.select("session_id", "label", "start_frame", "run_len")
    p = halo(points.select("session_id", "frame", "x", "y"), "frame", 4)
    w = in_shards(["session_id"], "frame")
    prev = F.lag("frame").over(w) == F.col("frame") - 1
    p = p.withColumn("dx", F.when(prev, F.col("x") - F.lag("x").over(w))).withColumn("dy", F.when(prev, F.col("y") - F.lag("y").over(w)))
    p = home(p)
    e = bouts.withColumn("frame", F.explode(F.expr("sequence(start_frame, start_frame + run_len - 1)")))
    j = e.join(p, ["session_id", "frame"], "left")
    step = F.when(F.col("frame") > F.col("start_frame"), F.hypot("dx", "dy"))
    a = j.withColumn("step", step).groupBy("session_id", "label", "start_frame", "run_len").agg(
        F.hypot(F.max_by("x", "frame") - F.min_by("x", "frame"), F.max_by("y", "frame") - F.min_by("y", "frame")).alias("net"),
        F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"),
        F.avg(F.when(F.col("step") > 0, F.col("dx") / F.col("step"))).alias("_cx"),
        F.avg(F.when(F.col("step") > 0, F.col("dy") / F.col("step"))).alias("_cy"),
    )
    return a.select(
        "session_id", "label", "start_frame", "run_len", F.col("net").alias("net_displacement"), F.col("path").alias("path_length"),
        F.when(F.col("run_len") >= least, F.try_divide("net", "path")).alias("straightness_ratio"),
        (F.col("path") * fps / F.col("run_len")).alias("mean_speed"), F.hypot("_cx", "_cy").alias("heading_consistency"),
    )


def approach_avoid(bouts: DataFrame, distance: DataFrame, near: float, straight: float = 0.7) -> DataFrame:
    """Directed bouts that end within ``near`` and are followed by a slower bout (approach), or start within it and end farther
    (avoid). ``bouts``: from ``directedness``; ``distance``: session_id, frame, dist. Returns one row per event."""
    w = in_shards(["session_id"], "start_frame")
    mid = quantiles(bouts, ["session_id"], "mean_speed", {"_mid": 0.5})
    b = beside(bouts, ["session_id"], "start_frame", 0, 1)
    b = home(b.select("*", F.lead("label").over(w).alias("next_label"), F.lead("mean_speed").over(w).alias("next_speed"))).join(mid, "session_id")
    b = b.where((F.col("straightness_ratio") >= straight) & (F.col("mean_speed") >= F.col("_mid"))).withColumn("end_frame", F.col("start_frame") + F.col("run_len") - 1)
    at = lambda f, n: distance.select("session_id", F.col("frame").alias(f), F.col("dist").alias(n))
    b = b.join(at("start_frame", "d0"), ["session_id", "start_frame"], "left").join(at("end_frame", "d1"), ["session_id", "end_frame"], "left")
    approach = F.coalesce((F.col("d1") <= near) & (F.col("next_speed") < F.col("mean_speed")), F.lit(False))
    avoid = F.coalesce((F.col("d0") <= near) & (F.col("d1") > F.col("d0")), F.lit(False))
    kind = F.when(approach & avoid, "both").when(approach, "approach").when(avoid, "avoid")
    return b.select("session_id", "start_frame", "end_frame", kind.alias("classification"), "straightness_ratio", "mean_speed", "next_label", "next_speed").where("classification is not null")


def kinematics(bouts: DataFrame, table: DataFrame | None) -> DataFrame:
    """Left join of a cluster's kinematics; null columns where there is no table."""
    cols = ["mean_speed_px_s", "mean_body_elongation_px", "mean_angular_velocity_rad_s"]
    if table is None:
        return bouts.select("*", *[F.lit(None).cast("double").alias(c) for c in cols])
    return bouts.join(table.select(F.col("cluster_id").alias("label"), *cols), "label", "left")


def toward(bouts: DataFrame, distances: dict[str, DataFrame], near: float, kind: str = "object", straight: float = 0.7) -> DataFrame:
    """``approach_avoid`` for several targets: the events of each with ``target_<kind>``; no target gives no events of that schema."""
    parts = [approach_avoid(bouts, d, near, straight).withColumn(f"target_{kind}", F.lit(name)) for name, d in sorted(distances.items())]
    out = parts[0] if parts else approach_avoid(bouts, bouts.select("session_id", F.col("start_frame").alias("frame"), F.lit(0.0).alias("dist")).limit(0), near, straight).limit(0).withColumn(f"target_{kind}", F.lit(""))
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cluster_kinematics(frames: DataFrame, points: DataFrame, ends: DataFrame, fps: float) -> DataFrame:
    """Mean centroid speed in px/s, mean body elongation in px and mean absolute angular velocity in rad/s of every label.

    ``frames``: session_id, frame, label; ``points``: session_id, frame, x, y of the centroid; ``ends``: session_id, frame, hx, hy, tx, ty of
    the spine. Steps are between successive frames; a missing frame or part gives none.
    """
    import math

    p = points.select("session_id", "frame", "x", "y").join(ends.select("session_id", "frame", "hx", "hy", "tx", "ty"), ["session_id", "frame"], "full")
    p = halo(p.withColumn("heading", F.atan2(F.col("hy") - F.col("ty"), F.col("hx") - F.col("tx"))), "frame", 4)
    w = in_shards(["session_id"], "frame")
    prev = F.lag("frame").over(w) == F.col("frame") - 1
    turn = F.col("heading") - F.lag("heading").over(w)
    turn = F.abs(turn - 2 * math.pi * F.floor((turn + math.pi) / (2 * math.pi)))
    p = p.select("*", F.when(prev, F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)) * fps).alias("speed"), F.when(prev, turn * fps).alias("turn"), F.hypot(F.col("hx") - F.col("tx"), F.col("hy") - F.col("ty")).alias("long"))
    j = home(p).join(frames.where("label is not null").select("session_id", "frame", "label"), ["session_id", "frame"])
    return j.groupBy(F.col("label").alias("cluster_id")).agg(F.avg("speed").alias("mean_speed_px_s"), F.avg("long").alias("mean_body_elongation_px"), F.avg("turn").alias("mean_angular_velocity_rad_s"))


def cluster_confidence(frames: DataFrame, visibility: DataFrame, least: float = 0.6) -> DataFrame:
    """label, n, mean_visibility, low: the mean likelihood of each cluster's bins, flagged where it is below ``least``. Both inputs:
    session_id, bin."""
    j = frames.where("label is not null").join(visibility.select("session_id", "bin", "mean_visibility"), ["session_id", "bin"])
    return j.groupBy("label").agg(F.count("mean_visibility").alias("n"), F.avg("mean_visibility").alias("mean_visibility")).withColumn("low", F.col("mean_visibility") < least)


STAMP = r"(\d{8}_\d{6})"


def pair_files(files: DataFrame, videos: DataFrame) -> DataFrame:
    """Each file's video: the one of the same stem, else the longest whose stem begins it or that it begins, else one of the
    same time stamp; null without a match. ``files``, ``videos``: path, stem. Prefixes meet in an equi-join: a stem is expanded
    to its own prefixes, as many as it has characters."""
    f, v = files.select("path", "stem"), videos.select(F.col("path").alias("video"), F.col("stem").alias("v"))
    exact = f.join(v, f["stem"] == v["v"]).select("path", F.lit(0).alias("rank"), F.lit(0).alias("len"), "video")
    cut = lambda d, c: d.withColumn("p", F.explode(F.expr(f"transform(sequence(1, length({c})), n -> substring({c}, 1, n))")))
    p1 = cut(f, "stem").join(v, F.col("p") == F.col("v")).select("path", F.lit(1).alias("rank"), (-F.length("v")).alias("len"), "video")
    p2 = f.join(cut(v, "v"), F.col("p") == F.col("stem")).select("path", F.lit(1).alias("rank"), (-F.length("stem")).alias("len"), "video")
    t = lambda d, c: d.withColumn("t", F.regexp_extract(c, STAMP, 1)).where("t <> ''")
    stamp = t(f, "stem").join(t(v, "v"), "t").select("path", F.lit(2).alias("rank"), F.lit(0).alias("len"), "video")
    best = exact.unionByName(p1).unionByName(p2).unionByName(stamp).groupBy("path").agg(F.min_by("video", F.struct("rank", "len", "video")).alias("video"))
    return f.join(best, "path", "left").select("path", "video")


def complete_cases(rows: DataFrame, member: str, level: str, value: str) -> DataFrame:
    """Rows of the members that have a value at every level."""
    r = rows.where(F.col(member).isNotNull() & F.col(value).isNotNull())
    n = r.agg(F.count_distinct(level).alias("_n"))
    full = r.groupBy(member).agg(F.count_distinct(level).alias("_k")).join(F.broadcast(n)).where("_k = _n").select(member)
    return r.join(full, member, "left_semi")


def first_prefix(items: DataFrame, path: str, folders: list[str]) -> Column:
    """The first folder that a path begins with."""
    return F.coalesce(*[F.when(F.col(path).startswith(f), F.lit(f)) for f in folders], F.lit(None).cast("string"))
