"""Irregular readings onto a regular grid.

Every source is split into time shards of ``shard_slots`` periods. The readings of a shard are packed once, each shard gets
the two last readings before and the two first after it (its halo, taken from the neighbouring shards' ends), and within a
shard the empty periods are filled with a shape-preserving monotone cubic (Fritsch-Carlson slopes with the harmonic mean).
With two halo readings on either side the curve is the same as over the unsharded series. Gaps of more than ``max_gap``
periods, and those before the first or after the last reading, stay marked ``missing``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinetrail.plans.runtime import join_dim, micros, nan_to_null, table

SHARD_SLOTS = 2048
MAX_GAP = 15
DEFAULT_FPS = 30.0


def _last2(a: Column) -> Column:
    return F.when(F.size(a) <= 2, a).otherwise(F.slice(a, -2, 2))


def _slope(dp: Column, dn: Column, hp: Column, hn: Column) -> Column:
    """Slope at a reading from the secants before (dp over hp) and after (dn over hn): zero at an extremum, else their
    weighted harmonic mean; the only secant at an end of the series."""
    w1, w2 = 2 * hn + hp, hn + 2 * hp
    inner = F.when(dp * dn > 0, (w1 + w2) / (w1 / dp + w2 / dn)).otherwise(F.lit(0.0))
    return F.when(dp.isNull(), F.coalesce(dn, F.lit(0.0))).when(dn.isNull(), dp).otherwise(inner)


def regularize(
    readings: DataFrame, grid: DataFrame, keys: list[str], *, max_gap: int = MAX_GAP, shard_slots: int = SHARD_SLOTS
) -> DataFrame:
    """``readings``: keys, ``slot`` bigint, ``value`` double. ``grid``: keys, ``n`` bigint, one row per source.

    Returns keys, slot (0 .. n-1, exactly one row each), value, status (``genuine``, ``filled``, ``missing``).

    Several readings of a slot: the smallest value by magnitude stands. Null or NaN values and null keys are no readings;
    slots outside 0 .. n-1 belong to none. A source without readings comes out all missing; n null or below 1 gives no
    rows. Other columns of the inputs are ignored.
    """
    if shard_slots <= max_gap:
        raise ValueError("a shard must be longer than the longest gap that is filled")
    S = F.lit(shard_slots).cast("bigint")
    grid = grid.where(F.col("n") > 0).groupBy(*keys).agg(F.max("n").alias("n"))
    shards = grid.select(*keys, "n", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(n - 1) div {shard_slots}"))).alias("shard"))
    value = nan_to_null(F.col("value"))
    own = (
        readings.select(*keys, "slot", value.alias("value"))
        .where(F.col("slot").isNotNull() & F.col("value").isNotNull() & (F.col("slot") >= 0))
        .groupBy(*keys, "slot")
        .agg(F.min_by("value", F.struct(F.abs("value"), F.col("value"))).alias("value"))
        .withColumn("shard", F.floor(F.col("slot") / S))
    )
    # One packed row per shard that has readings; a shard holds one reading per slot at most, so its size is bounded.
    packed = own.groupBy(*keys, "shard").agg(F.sort_array(F.collect_list(F.struct("slot", "value"))).alias("obs"))
    whole = shards.join(packed, [*keys, "shard"], "left").withColumn("obs", F.filter("obs", lambda o: o["slot"] < F.col("n")))
    whole = whole.withColumn("obs", F.when(F.size("obs") > 0, F.col("obs")))
    ends = whole.where("obs is not null").select(*keys, "shard", F.slice("obs", 1, 2).alias("head"), _last2(F.col("obs")).alias("tail"))
    by_shard = W.partitionBy(*keys).orderBy("shard")
    none = F.slice("head", 1, 0)
    ends = ends.select(
        *keys,
        "shard",
        _last2(F.concat(F.coalesce(F.lag("tail", 2).over(by_shard), none), F.coalesce(F.lag("tail", 1).over(by_shard), none))).alias("before"),
        F.slice(F.concat(F.coalesce(F.lead("head", 1).over(by_shard), none), F.coalesce(F.lead("head", 2).over(by_shard), none)), 1, 2).alias("after"),
    )
    whole = whole.join(ends, [*keys, "shard"], "left")
    lo, hi = F.col("shard") * S, F.least(F.col("n"), (F.col("shard") + 1) * S)
    # A shard without readings has no reading in reach: its periods lie in a gap longer than a shard.
    obs = F.when(F.col("obs").isNull(), F.expr("array(named_struct('slot', -1L, 'value', cast(null as double)))")).otherwise(
        F.concat("before", "obs", "after")
    )
    one = whole.select(*keys, "shard", lo.alias("lo"), hi.alias("hi"), F.explode(obs).alias("o")).select(
        *keys, "shard", "lo", "hi", F.col("o.slot").alias("s"), F.col("o.value").alias("v")
    )
    w = W.partitionBy(*keys, "shard").orderBy("s")
    one = one.select("*", F.lag("s").over(w).alias("sp"), F.lag("v").over(w).alias("vp"), F.lead("s").over(w).alias("sn"), F.lead("v").over(w).alias("vn"))
    hp, hn = (F.col("s") - F.col("sp")).cast("double"), (F.col("sn") - F.col("s")).cast("double")
    one = one.withColumn("m", _slope((F.col("v") - F.col("vp")) / hp, (F.col("vn") - F.col("v")) / hn, hp, hn))
    one = one.withColumn("mn", F.lead("m").over(w))
    first = F.when(F.col("sp").isNull(), F.col("lo")).otherwise(F.greatest("s", "lo"))
    last = F.least(F.coalesce("sn", "hi"), F.col("hi")) - 1
    cells = one.withColumn("a", first).withColumn("b", last).where("a <= b").withColumn("slot", F.explode(F.sequence("a", "b")))
    h = (F.col("sn") - F.col("s")).cast("double")
    t = (F.col("slot") - F.col("s")).cast("double") / h
    curve = (
        F.col("v") * (1 + 2 * t) * (1 - t) * (1 - t)
        + h * F.col("m") * t * (1 - t) * (1 - t)
        + F.col("vn") * t * t * (3 - 2 * t)
        + h * F.col("mn") * t * t * (t - 1)
    )
    genuine = (F.col("slot") == F.col("s")) & F.col("v").isNotNull()
    inside = (F.col("slot") > F.col("s")) & F.col("sn").isNotNull() & F.col("v").isNotNull() & (F.col("sn") - F.col("s") - 1 <= max_gap)
    return cells.select(
        *keys,
        "slot",
        F.when(genuine, F.col("v")).when(inside, curve).alias("value"),
        F.when(genuine, F.lit("genuine")).when(inside, F.lit("filled")).otherwise(F.lit("missing")).alias("status"),
    )


def camera_grid(spark, sf_dir: str) -> DataFrame:
    """Readings of every camera on its recording's frame periods: session_id, cam, slot, value, status; ``value`` is the
    reading's offset from the centre of its period in microseconds, interpolated where ``filled``.

    A recording without an end, a start or cameras has no periods. ``cameras`` naming a camera twice counts once.
    """
    s = table(spark, sf_dir, "step0_session").select("session_id", "fps", "started_at", "ended_at", "cameras")
    fps = F.coalesce(nan_to_null(F.col("fps")), F.lit(DEFAULT_FPS))
    start, end = micros(F.col("started_at")), micros(F.col("ended_at"))
    s = s.where("session_id is not null").select(
        "session_id",
        fps.alias("fps"),
        start.alias("t0"),
        F.floor((end - start) * fps / 1e6 + 0.5).cast("bigint").alias("n"),
        F.array_distinct("cameras").alias("cameras"),
    )
    grid = s.select("session_id", "n", F.explode("cameras").alias("cam")).where("cam is not null")
    r = table(spark, sf_dir, "cam_timestamp").where("ts is not null and not coalesce(is_fill, false)").select("session_id", "cam", micros(F.col("ts")).alias("us"))
    r = join_dim(r, s, ["session_id"], "inner").where(F.array_contains("cameras", F.col("cam")))
    x = (F.col("us") - F.col("t0")) * F.col("fps") / 1e6
    slot = F.floor(x + 0.5).cast("bigint")
    r = r.where((slot >= 0) & (slot < F.col("n"))).select("session_id", "cam", slot.alias("slot"), ((x - slot) * 1e6 / F.col("fps")).alias("value"))
    return regularize(r, grid, ["session_id", "cam"])


def p1_found(spark, sf_dir: str) -> DataFrame:
    """The periods without a genuine reading."""
    return camera_grid(spark, sf_dir).where("status <> 'genuine'").select("session_id", "cam", "slot")


def p1_grid(spark, sf_dir: str) -> DataFrame:
    """The whole regular series with times in microseconds, null where a long gap stays marked."""
    return camera_grid(spark, sf_dir).select("session_id", "cam", "slot", F.round("value", 0).cast("bigint").alias("offset_us"), "status")


