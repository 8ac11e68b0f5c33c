"""Cleaning of pose tracks (session_id, frame, bodypart, x, y, likelihood): gates, gap filling, smoothing, body part choice.

Nulls are missing readings and are skipped by every statistic; NaN is null from the source on. Empty tracks give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.operators.bouts import rle
from kinetrail.plans.sequence import SHARD, beside, carry, halo, home, in_shards

TRACK = ["session_id", "bodypart"]


def low_fraction(pose: DataFrame, threshold: float = 0.3) -> DataFrame:
    return pose.groupBy(*TRACK).agg(F.avg((F.col("likelihood") < threshold).cast("double")).alias("ll_frac"), F.count("likelihood").alias("n"))


def fill_gaps(pose: DataFrame, threshold: float, most: int | None, *, shard: int = SHARD) -> DataFrame:
    """Positions below the threshold or missing: a straight line over gaps of up to ``most`` frames (None: all), beyond that the
    left value up to the middle and the right one after it, marked ``flat_held``; at an end of the track the nearest value."""
    good = (F.col("likelihood") >= threshold) & F.col("x").isNotNull() & F.col("y").isNotNull()
    p = carry(pose.select(*TRACK, "frame", "x", "y", "likelihood"), TRACK, "frame", F.when(good, F.struct("x", "y")), "b", "a", shard)
    gap = F.col("a.at") - F.col("b.at") - 1
    t = (F.col("frame") - F.col("b.at")) / (F.col("a.at") - F.col("b.at"))
    line = (gap <= most) if most is not None else F.lit(True)
    left = F.col("frame") * 2 < F.col("a.at") + F.col("b.at")

    def value(c: str):
        lo, hi = F.col(f"b.value.{c}"), F.col(f"a.value.{c}")
        return F.when(good, F.col(c)).when(F.col("a").isNull() | F.col("b").isNull(), F.coalesce(lo, hi)).when(line, lo + (hi - lo) * t).otherwise(F.when(left, lo).otherwise(hi)).alias(c)

    held = ~F.coalesce(good, F.lit(False)) & F.col("a").isNotNull() & F.col("b").isNotNull() & ~line
    return p.select("session_id", "frame", "bodypart", value("x"), value("y"), F.coalesce(held, F.lit(False)).alias("flat_held"))


def boxcar(pose: DataFrame, width: int, *, shard: int = SHARD) -> DataFrame:
    """Mean of ``width`` rows around each, rows beyond an end counted as 0; a null position counts as 0 as well."""
    if width <= 1:
        return pose.select("session_id", "frame", "bodypart", "x", "y")
    w = in_shards(TRACK, "frame").rowsBetween(-(width // 2), (width - 1) // 2)
    p = beside(pose.select(*TRACK, "frame", "x", "y"), TRACK, "frame", width // 2, (width - 1) // 2, shard)
    for c in ("x", "y"):
        p = p.withColumn(f"_{c}", F.sum(F.coalesce(c, F.lit(0.0))).over(w) / width)
    return home(p).select("session_id", "frame", "bodypart", F.col("_x").alias("x"), F.col("_y").alias("y"))


def confident_runs(pose: DataFrame, threshold: float = 0.6, least: int = 7) -> DataFrame:
    f = pose.where(F.col("likelihood") >= threshold).select(F.struct(*TRACK).alias("session_id"), "frame", F.lit(1).alias("label"))
    r = rle(f).where(F.col("run_len") >= least)
    return r.select("session_id.session_id", "session_id.bodypart", "start_frame", "run_len")


def run_median(pose: DataFrame, threshold: float = 0.6, least: int = 7, width: int = 5) -> DataFrame:
    """Running median within each confident run; other rows keep their values. Ends of a run use what is there."""
    runs = confident_runs(pose, threshold, least).select(*TRACK, "start_frame", F.explode(F.expr("sequence(start_frame, start_frame + run_len - 1)")).alias("frame"))
    p = pose.select(*TRACK, "frame", "x", "y").join(runs, [*TRACK, "frame"], "left")
    inside = halo(p.where("start_frame is not null"), "frame", width)
    w = in_shards([*TRACK, "start_frame"], "frame").rowsBetween(-(width // 2), width // 2)
    for c in ("x", "y"):
        v = F.sort_array(F.collect_list(c).over(w))
        n = F.size(v)
        inside = inside.withColumn(f"_{c}", F.when(n > 0, (F.get(v, F.floor((n - 1) / 2).cast("int")) + F.get(v, F.floor(n / 2).cast("int"))) / 2))
    done = home(inside).select("session_id", "frame", "bodypart", F.col("_x").alias("x"), F.col("_y").alias("y"))
    return done.unionByName(p.where("start_frame is null").select("session_id", "frame", "bodypart", "x", "y"))


def gate(pose: DataFrame, threshold: float) -> DataFrame:
    return pose.withColumn("likelihood", F.when(F.col("likelihood") < threshold, 0.0).otherwise(F.col("likelihood")))


def mask_fills(readings: DataFrame, frame_fills: DataFrame, on: list[str]) -> DataFrame:
    """Likelihood 0 on the frames marked as fills; frames without a mark count as genuine, marks without a frame are dropped."""
    m = frame_fills.groupBy(*on).agg(F.bool_or(F.coalesce("is_fill", F.lit(False))).alias("_fill"))
    return readings.join(m, on, "left").withColumn("likelihood", F.when(F.col("_fill"), 0.0).otherwise(F.col("likelihood"))).drop("_fill")


def conserved(pose: DataFrame, least_conf: float = 0.3, least_share: float = 0.85, keep: int = 6) -> DataFrame:
    """Body parts whose median likelihood reaches ``least_conf`` in enough of the sessions; where fewer than ``keep`` do, the best."""
    m = pose.where("likelihood is not null").groupBy(*TRACK).agg(F.percentile("likelihood", 0.5).alias("m"))
    n = pose.select("session_id").distinct().agg(F.count("*").alias("n"))
    s = m.groupBy("bodypart").agg(F.count_if(F.col("m") >= least_conf).alias("good"), F.avg("m").alias("mean_m")).join(F.broadcast(n))
    s = s.withColumn("share", F.col("good") / F.col("n"))
    rank = F.row_number().over(W.orderBy(F.desc("share"), F.desc("mean_m"), "bodypart"))  # over the body parts, a few dozen
    return s.withColumn("rank", rank).select("bodypart", "share", ((F.col("share") >= least_share) | (F.col("rank") <= keep)).alias("kept"))


def common_bodyparts(pose: DataFrame, group: str, member: str) -> DataFrame:
    """Body parts that every member of a group has."""
    seen = pose.select(group, member, "bodypart").distinct()
    n = seen.groupBy(group).agg(F.count_distinct(member).alias("n"))
    return seen.groupBy(group, "bodypart").agg(F.count("*").alias("c")).join(n, group).where("c = n").select(group, "bodypart")


def auto_weights(fractions: DataFrame, manual: dict[str, float], bad: float = 0.3, lo: float = 0.1, hi: float = 0.35, floor: float = 0.35) -> DataFrame:
    """Weight of each body part by the share of sessions in which more than ``bad`` of it is below the gate: 1 up to ``lo``,
    ``floor`` from ``hi`` on, a line between; a weight set by hand wins."""
    s = fractions.groupBy("bodypart").agg(F.avg((F.col("ll_frac") > bad).cast("double")).alias("share"))
    auto = F.when(F.col("share") <= lo, 1.0).when(F.col("share") >= hi, floor).otherwise(1.0 - (1.0 - floor) * (F.col("share") - lo) / (hi - lo))
    hand = F.coalesce(*[F.when(F.col("bodypart") == k, v) for k, v in manual.items()]) if manual else F.lit(None).cast("double")
    return s.select("bodypart", "share", F.coalesce(hand, auto).alias("weight"))


def dropped_bodyparts(fractions: DataFrame, most: float = 0.7) -> DataFrame:
    return fractions.groupBy("bodypart").agg(F.avg("ll_frac").alias("mean_bad")).where(F.col("mean_bad") >= most)
