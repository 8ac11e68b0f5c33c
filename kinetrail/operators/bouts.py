"""Bouts: runs of equal labels, their metrics, transitions and summaries.

Null labels are labels of their own nowhere: frames without a label end a bout and belong to none. Empty inputs give empty
results of the same schema. Inputs may carry further columns; they are dropped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.plans.ranks import quantiles
from kinetrail.plans.sequence import SHARD, beside, home, in_shards, running


def rle(frames: DataFrame, shard: int = SHARD) -> DataFrame:
    """session_id, frame, label (one row per frame) to bouts: session_id, label, start_frame, run_len. A missing frame ends a
    bout. Runs are found within shards of frames; only the first and last of a shard are joined across its borders."""
    f = frames.where("label is not null").select("session_id", "label", "frame", F.floor(F.col("frame") / shard).alias("_s"))
    island = F.col("frame") - F.row_number().over(W.partitionBy("session_id", "_s", "label").orderBy("frame"))
    runs = f.withColumn("_i", island).groupBy("session_id", "label", "_s", "_i").agg(F.min("frame").alias("a"), F.max("frame").alias("b"))
    edge = (F.col("a") == F.col("_s") * shard) | (F.col("b") == (F.col("_s") + 1) * shard - 1)
    inner = runs.where(~edge).select("session_id", "label", F.col("a").alias("start_frame"), (F.col("b") - F.col("a") + 1).alias("run_len"))
    w = W.partitionBy("session_id", "label").orderBy("a")
    new = F.coalesce((F.lag("b").over(w) + 1 != F.col("a")).cast("int"), F.lit(1))
    outer = runs.where(edge).withColumn("_new", new).withColumn("_g", F.sum("_new").over(w))
    outer = outer.groupBy("session_id", "label", "_g").agg(F.min("a").alias("start_frame"), F.max("b").alias("_b"))
    return inner.unionByName(outer.select("session_id", "label", "start_frame", (F.col("_b") - F.col("start_frame") + 1).alias("run_len")))


def _merged(b: DataFrame, keys: list[str]) -> DataFrame:
    """Intervals (keys, start, end) joined where one starts no later than one frame after the running end; in shards of the start."""
    b = running(b, keys, "start", ["start", "end"], "max", "end", "_top")
    b = b.withColumn("_new", F.when(F.col("start") <= F.col("_top") + 1, 0).otherwise(1))
    b = running(b, keys, "start", ["start", "end"], "sum", "_new", "_before").withColumn("_g", F.coalesce("_before", F.lit(0)) + F.col("_new"))
    return b.groupBy(*keys, "_g").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_g")


def merge(bouts: DataFrame, labels: list) -> DataFrame:
    """Bouts of the given labels merged where one starts no later than one frame after the running end: session_id, start, end
    (exclusive)."""
    b = bouts.where(F.col("label").isin(labels)).select("session_id", F.col("start_frame").alias("start"), (F.col("start_frame") + F.col("run_len")).alias("end"))
    return _merged(b, ["session_id"])


def metrics(bouts: DataFrame, groups: dict[str, list], fps: float) -> DataFrame:
    """Per session and behaviour group: frequency, total_duration, mean_bout, latency in seconds; zeros (latency null) where a
    session has no bout of the group. A label may be in several groups; all groups are merged in one pass."""
    of = F.array_compact(F.array(*[F.when(F.col("label").isin(labels), F.lit(name)) for name, labels in groups.items()]))
    b = bouts.select("session_id", F.col("start_frame").alias("start"), (F.col("start_frame") + F.col("run_len")).alias("end"), F.explode(of).alias("behaviour"))
    m = _merged(b, ["session_id", "behaviour"])
    m = m.groupBy("session_id", "behaviour").agg(F.count("*").alias("frequency"), F.sum(F.col("end") - F.col("start")).alias("_n"), F.min("start").alias("_first"))
    every = bouts.select("session_id").distinct().withColumn("behaviour", F.explode(F.array(*[F.lit(g) for g in groups])))
    m = every.join(m, ["session_id", "behaviour"], "left")
    return m.select(
        "session_id",
        "behaviour",
        F.coalesce("frequency", F.lit(0)).alias("frequency"),
        (F.coalesce("_n", F.lit(0)) / fps).alias("total_duration"),
        F.coalesce(F.col("_n") / F.col("frequency") / fps, F.lit(0.0)).alias("mean_bout"),
        (F.col("_first") / fps).alias("latency"),
    )


def check_animals(animals: DataFrame, key: str, needed: list[str]) -> DataFrame:
    """Refuses a table of animals that is empty, lacks a column or names one twice."""
    missing = [c for c in [key, *needed] if c not in animals.columns]
    if missing:
        raise ValueError(f"columns are missing: {', '.join(missing)}")
    if animals.isEmpty():
        raise ValueError("no animals")
    if not animals.groupBy(key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return animals


def usable(rows: DataFrame, key: list[str], away: DataFrame | None = None, weight: str | None = None, label: str = "label") -> DataFrame:
    """Rows that are no noise (-1), not in ``away`` (anti join on the key) and of a weight above 0."""
    rows = rows.where(F.col(label).isNotNull() & (F.col(label).cast("string") != "-1"))
    if weight:
        rows = rows.where(F.col(weight) > 0)
    return rows.join(away.select(*key).distinct(), key, "left_anti") if away is not None else rows


def assign(mapping: DataFrame, label, behaviour: str) -> DataFrame:
    """A mapping (label, behaviour, ignored) in which a label has a behaviour; it is no longer ignored."""
    new = mapping.sparkSession.createDataFrame([(label, behaviour, False)], mapping.schema)
    return mapping.where(F.col("label") != F.lit(label)).unionByName(new)


def ignore(mapping: DataFrame, label) -> DataFrame:
    new = mapping.sparkSession.createDataFrame([(label, None, True)], mapping.schema)
    return mapping.where(F.col("label") != F.lit(label)).unionByName(new)


def rename(mapping: DataFrame, old: str, new: str) -> DataFrame:
    return mapping.withColumn("behaviour", F.when(F.col("behaviour") == old, new).otherwise(F.col("behaviour")))


def delete(mapping: DataFrame, behaviour: str) -> DataFrame:
    """The labels of a behaviour are pending again."""
    return mapping.where(F.col("behaviour").isNull() | (F.col("behaviour") != behaviour))


def session_stem(path: Column) -> Column:
    """The session of a bout file: its name without extension and the suffix of bout files."""
    name = F.regexp_replace(F.regexp_extract(path, "([^/]+)$", 1), r"\.[^.]+$", "")
    return F.regexp_replace(name, r"_bout_lengths(_hmm)?$", "")


def session_duration(bouts: DataFrame, fps: float) -> DataFrame:
    return bouts.groupBy("session_id").agg((F.max(F.col("start_frame") + F.col("run_len")) / fps).alias("duration_s"))


def per_cluster(bouts: DataFrame, fps: float) -> DataFrame:
    return bouts.groupBy("label").agg(
        F.count("*").alias("frequency"), (F.sum("run_len") / fps).alias("total_duration"), (F.avg("run_len") / fps).alias("mean_bout")
    )


def transitions(bouts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of changes between successive bouts, those to the same label left out: (by), from_label, to_label, n. The bout
    after each is the one that starts first behind it."""
    by = by or []
    b = beside(bouts.select("session_id", *[c for c in by if c != "session_id"], "start_frame", "label"), ["session_id"], "start_frame", 0, 1)
    w = in_shards(["session_id"], "start_frame")
    t = home(b.select("*", F.col("label").alias("from_label"), F.lead("label").over(w).alias("to_label")))
    return t.where("from_label <> to_label").groupBy(*by, "from_label", "to_label").agg(F.count("*").alias("n"))


def transition_matrix(bouts: DataFrame) -> DataFrame:
    """Row-stochastic over all pairs of the labels present (a label's own cell is 0, as is a row without a change)."""
    t = transitions(bouts)
    labels = bouts.select("label").distinct()
    pairs = labels.select(F.collect_set("label").alias("l")).select(F.explode("l").alias("from_label"), "l").select("from_label", F.explode("l").alias("to_label"))
    total = t.groupBy("from_label").agg(F.sum("n").alias("_t"))
    m = pairs.join(t, ["from_label", "to_label"], "left").join(total, "from_label", "left")
    return m.select("from_label", "to_label", F.coalesce(F.col("n") / F.col("_t"), F.lit(0.0)).alias("p"))


def epochs(bouts: DataFrame, fps: float) -> DataFrame:
    end = F.col("start_frame") + F.col("run_len")
    return bouts.select(
        "session_id", "label", "start_frame", end.alias("end_frame"), (F.col("start_frame") / fps).alias("start_sec"), (end / fps).alias("end_sec"), (F.col("run_len") / fps).alias("duration_sec")
    )


def keep_durations(bouts: DataFrame, fps: float, least_s: float, most_s: float) -> DataFrame:
    """Bouts whose duration is within both bounds; neighbours are not merged again."""
    return bouts.where((F.col("run_len") / fps).between(least_s, most_s))


def dwell(bouts: DataFrame, fps: float) -> DataFrame:
    d = bouts.select("label", (F.col("run_len") / fps).alias("d"))
    q = quantiles(d, ["label"], "d", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return q.join(d.groupBy("label").agg(F.max("d").alias("longest")), "label")


def combined(values: DataFrame, group: str, measures: list[str]) -> DataFrame:
    """Mean, standard error and count of per-session measures by experimental group and behaviour."""
    long = values.select(group, "behaviour", F.explode(F.create_map(*[x for m in measures for x in (F.lit(m), F.col(m).cast("double"))])).alias("metric", "v")).where("v is not null")
    return long.groupBy(group, "behaviour", "metric").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), (F.stddev_samp("v") / F.sqrt(F.count("v"))).alias("sem"))


def edges(bouts: DataFrame, least: float = 0.05) -> DataFrame:
    return transition_matrix(bouts).where(F.col("p") >= least)


def mapping_stats(labels: DataFrame, assigned: dict, ignored: list) -> DataFrame:
    """total, assigned, ignored, pending clusters of an annotation."""
    state = F.when(F.col("label").isin(list(assigned)), "assigned").when(F.col("label").isin(ignored), "ignored").otherwise("pending")
    s = labels.select("label").distinct().withColumn("state", state)
    return s.agg(F.count("*").alias("total"), *[F.count_if(F.col("state") == x).alias(x) for x in ("assigned", "ignored", "pending")])


def rare(labels: DataFrame, least_percent: float) -> DataFrame:
    """Labels that make up at least so many percent of all rows, with their share."""
    c = labels.where("label is not null").groupBy("label").agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("_t")))).select("label", "n", (F.col("n") / F.col("_t") * 100).alias("percent")).where(F.col("percent") >= least_percent)
