"""Features of pose tracks in bins of 100 ms. A bin is full or it is left out; missing positions are skipped.

Windows over bins run in shards with a halo, so a session that holds much of all rows is no single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.operators.bouts import rle
from kinetrail.plans.runtime import cut, fits_broadcast, join_dim
from kinetrail.plans.sequence import SHARD, beside, halo, home, in_shards

TRACK = ["session_id", "bodypart"]


def binned(pose: DataFrame, sessions: DataFrame) -> DataFrame:
    """Adds ``win`` and ``bin`` from the session's fps (win: a tenth of it, rounded half to even, one at least); frames after
    the last full bin are left out. ``sessions``: session_id, fps (null: 30)."""
    s = sessions.select("session_id", F.greatest(F.lit(1), F.bround(F.coalesce("fps", F.lit(30.0)) / 10).cast("int")).alias("win"))
    # the frames of each session are counted in one pass and written: the join asks for their number and rows without a second scan
    top = cut(pose.groupBy("session_id").agg((F.max("frame") + 1).alias("_n")))
    s = s.join(F.broadcast(top) if fits_broadcast(top) else top, "session_id").withColumn("_bins", F.floor(F.col("_n") / F.col("win"))).drop("_n")
    p = join_dim(pose.select(*TRACK, "frame", "x", "y", "likelihood"), s, ["session_id"], "inner").withColumn("bin", F.floor(F.col("frame") / F.col("win")))
    return p.where("bin < _bins").drop("_bins")


def bin_means(b: DataFrame) -> DataFrame:
    return b.groupBy(*TRACK, "bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))


def pair_distances(b: DataFrame) -> DataFrame:
    """Mean distance of every pair of body parts per bin: the parts of a frame are gathered once and paired in an array."""
    pts = b.where("x is not null and y is not null").groupBy("session_id", "bin", "frame").agg(F.sort_array(F.collect_list(F.struct("bodypart", "x", "y"))).alias("p"))
    pairs = F.flatten(
        F.transform(
            "p",
            lambda a, i: F.transform(
                F.filter("p", lambda o: o["bodypart"] > a["bodypart"]),
                lambda o: F.struct(a["bodypart"].alias("part_a"), o["bodypart"].alias("part_b"), F.hypot(a["x"] - o["x"], a["y"] - o["y"]).alias("d")),
            ),
        )
    )
    e = pts.select("session_id", "bin", F.explode(pairs).alias("e"))
    return e.groupBy("session_id", "bin", F.col("e.part_a").alias("part_a"), F.col("e.part_b").alias("part_b")).agg(F.avg("e.d").alias("dist"))


def _lagged(m: DataFrame, keys: list[str], reach: int) -> tuple[DataFrame, object]:
    return halo(m, "bin", reach), in_shards(keys, "bin")


def _before(c: str, k: int, w) -> Column:
    """Value k bins before, null where that bin is missing."""
    return F.when(F.lag("bin", k).over(w) == F.col("bin") - k, F.lag(c, k).over(w))


def kinematics(means: DataFrame) -> DataFrame:
    """Velocity (distance from the bin before) and acceleration (its change) of every body part, in one pass over the bins."""
    m, w = _lagged(means, TRACK, 8)
    m = m.withColumn("velocity", F.hypot(F.col("x") - _before("x", 1, w), F.col("y") - _before("y", 1, w)))
    m = m.withColumn("acceleration", F.col("velocity") - _before("velocity", 1, w))
    return home(m).select(*TRACK, "bin", "velocity", "acceleration")


def velocity(means: DataFrame) -> DataFrame:
    return kinematics(means).drop("acceleration")


def acceleration(means: DataFrame) -> DataFrame:
    return kinematics(means).drop("velocity")


def variances(b: DataFrame) -> DataFrame:
    return b.groupBy(*TRACK, "bin").agg(F.var_pop("x").alias("var_x"), F.var_pop("y").alias("var_y"))


def drift(means: DataFrame, lags: tuple[int, ...] = (5, 10)) -> DataFrame:
    """Distance of the centroid from where it was some bins before."""
    c = means.groupBy("session_id", "bin").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    # every bin is present in the data's shards, so a lag by rows is checked against the bin's number
    m, w = _lagged(c, ["session_id"], max(lags) + 2)
    for k in lags:
        m = m.withColumn(f"drift_{k}", F.hypot(F.col("x") - _before("x", k, w), F.col("y") - _before("y", k, w)))
    return home(m).select("session_id", "bin", *[f"drift_{k}" for k in lags])


def coarse(b: DataFrame, times: int = 2) -> DataFrame:
    """Means over bins ``times`` as wide, given to each fine bin."""
    wide = b.withColumn("wide", F.floor(F.col("bin") / times)).groupBy(*TRACK, "wide").agg(F.avg("x").alias("x"), F.avg("y").alias("y"), F.max("bin").alias("_top"), F.min("bin").alias("_low"))
    fine = b.select(*TRACK, "bin").distinct().withColumn("wide", F.floor(F.col("bin") / times))
    return fine.join(wide, [*TRACK, "wide"]).select(*TRACK, "bin", "x", "y")


def spine_angle(b: DataFrame, chain: tuple[str, str, str]) -> DataFrame:
    """Mean angle at the middle one of three body parts, over the frames that have all three."""
    pick = [F.max(F.when(F.col("bodypart") == p, F.struct("x", "y"))).alias(f"p{i}") for i, p in enumerate(chain)]
    f = b.where(F.col("bodypart").isin(*chain) & F.col("x").isNotNull() & F.col("y").isNotNull()).groupBy("session_id", "bin", "frame").agg(*pick)
    ax, ay = F.col("p0.x") - F.col("p1.x"), F.col("p0.y") - F.col("p1.y")
    bx, by = F.col("p2.x") - F.col("p1.x"), F.col("p2.y") - F.col("p1.y")
    cos = (ax * bx + ay * by) / (F.hypot(ax, ay) * F.hypot(bx, by) + 1e-8)
    f = f.withColumn("angle", F.when(cos.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))
    return f.where("angle is not null").groupBy("session_id", "bin").agg(F.avg("angle").alias("angle"))


def visibility(b: DataFrame, regions: dict[str, list[str]], threshold: float = 0.3) -> DataFrame:
    low = (F.col("likelihood") < threshold).cast("double")
    per = [F.avg(F.when(F.col("bodypart").isin(parts), low)).alias(f"low_{name}") for name, parts in regions.items()]
    return b.groupBy("session_id", "bin").agg(F.avg("likelihood").alias("mean_visibility"), F.avg(low).alias("frac_low_conf"), *per)


def adaptive_threshold(pose: DataFrame, base: float = 0.3, share: float = 0.1) -> DataFrame:
    return pose.where("likelihood is not null").groupBy(*TRACK).agg(F.greatest(F.lit(base), F.percentile("likelihood", share)).alias("threshold"))


def turned_away(b: DataFrame, head: list[str], nose: list[str], thresholds: DataFrame, *, share: float = 0.3, join_bins: int = 5, least_bins: int = 4) -> DataFrame:
    """Windows of bins in which the head is badly seen and the nose is below its own threshold: session_id, start_bin, n_bins.
    Windows up to ``join_bins`` apart are one; shorter ones than ``least_bins`` are dropped."""
    low = (F.col("likelihood") < 0.3).cast("double")
    v = b.groupBy("session_id", "bin").agg(F.avg(F.when(F.col("bodypart").isin(head), low)).alias("head_low"), F.avg(F.when(F.col("bodypart").isin(nose), F.col("likelihood"))).alias("nose_ll"))
    t = thresholds.where(F.col("bodypart").isin(nose)).groupBy("session_id").agg(F.max("threshold").alias("threshold"))
    away = join_dim(v, t, ["session_id"], "inner").where((F.col("head_low") >= share) & (F.col("nose_ll") < F.col("threshold")))
    # a bin stands for the bins in which a next one would still join
    wide = away.select("session_id", F.explode(F.sequence("bin", F.col("bin") + join_bins)).alias("frame")).distinct().withColumn("label", F.lit(1))
    r = rle(wide).select("session_id", F.col("start_frame").alias("start_bin"), (F.col("run_len") - join_bins).alias("n_bins"))
    return r.where(F.col("n_bins") >= least_bins)


def tracking_metrics(pose: DataFrame, sessions: DataFrame, *, shard: int = SHARD) -> DataFrame:
    """Per session and body part: mean, spread and variation of the speed in px/s, jitter (mean change of the step, px a frame),
    spread of the position, box area, mean likelihood and share below 0.3."""
    p = beside(pose.select(*TRACK, "frame", "x", "y", "likelihood"), TRACK, "frame", 2, shard=shard)
    w = in_shards(TRACK, "frame")
    p = p.withColumn("step", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    p = p.withColumn("turn", F.abs(F.col("step") - F.lag("step").over(w)))
    s = sessions.select("session_id", F.coalesce("fps", F.lit(30.0)).alias("fps"))
    m = home(p).groupBy(*TRACK).agg(
        F.avg("step").alias("_step"), F.stddev_pop("step").alias("_sd"), F.avg("turn").alias("mean_jitter"), F.stddev_pop("x").alias("std_x"), F.stddev_pop("y").alias("std_y"),
        ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("bbox_area"), F.avg("likelihood").alias("mean_likelihood"), F.avg((F.col("likelihood") < 0.3).cast("double")).alias("interp_rate"),
    )
    return join_dim(m, s, ["session_id"], "inner").select(
        *TRACK, (F.col("_step") * F.col("fps")).alias("mean_velocity"), (F.col("_sd") * F.col("fps")).alias("std_velocity"), F.try_divide("_sd", "_step").alias("cv_velocity"),
        "mean_jitter", "std_x", "std_y", "bbox_area", "mean_likelihood", "interp_rate",
    )
