"""The assembled feature matrix of pose tracks: blocks of distances, speeds and angles at several time scales, scaled and weighted,
as one long table session_id, bin, feature, value, or packed into one array a bin.

All blocks start from the same bins of 100 ms; wider ones are given to each of their bins, finer ones are averaged into theirs.
Nulls are missing positions and are skipped; a feature without a value in a bin has no row there. Sessions of less than one bin
are left out, and an input in which every session is too short is refused.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.operators.features import TRACK, _before, pair_distances
from kinetrail.plans.ranks import quantiles
from kinetrail.plans.runtime import join_dim
from kinetrail.plans.sequence import halo, home, in_shards

KEY = ["session_id", "bin"]
#: The words that name the head's end and the tail's end of the spine, the first that a name holds winning.
HEAD_WORDS = ["nose", "snout", "head", "neck", "rostral"]
TAIL_WORDS = ["tailbase", "tail_base"]
#: Patterns of well-known landmarks, the first match winning.
LANDMARKS = [
    (r"(?i)nose|snout", "nose"),
    (r"(?i)^head(?!.*base)|headcent", "head"),
    (r"(?i)neck", "neck"),
    (r"(?i)body.?cent|centroid|^center$|^body$", "body_center"),
    (r"(?i)tail.?base|tailbase", "tail_base"),
]
#: The regions of a body and words of their parts; the first region with a word in the name has the part.
REGIONS = {
    "Tail": ["tail"],
    "Forelimbs": ["front", "fore", "hand", "arm"],
    "Hindlimbs": ["hind", "back_left", "back_right", "rear", "foot", "leg"],
    "Neck": ["neck", "nape"],
    "Head/Mouth": ["nose", "snout", "head", "ear", "eye", "mouth", "jaw", "tongue"],
    "Trunk/Back": ["back", "body", "spine", "center", "centre", "centroid", "trunk", "hip", "mid"],
}
SPINE_FLOOR = 10.0


def canonical_landmark(name: Column) -> Column:
    c = F.lit(None).cast("string")
    for pattern, landmark in reversed(LANDMARKS):
        c = F.when(name.rlike(pattern), landmark).otherwise(c)
    return c


def body_region(name: Column) -> Column:
    """The region of a body part, null where no word fits."""
    c = F.lit(None).cast("string")
    for region, words in reversed(REGIONS.items()):
        c = F.when(F.lower(name).rlike("|".join(words)), region).otherwise(c)
    return c


def spine_ends(parts: DataFrame) -> DataFrame:
    """session_id, head, tail of sessions that have both ends, as different parts. ``parts``: session_id, bodypart. Of several parts
    with the same word the first by name."""
    rank = lambda words: F.coalesce(*[F.when(F.lower("bodypart").contains(w), i) for i, w in enumerate(words)])
    p = parts.select("session_id", "bodypart").distinct().select("session_id", "bodypart", rank(HEAD_WORDS).alias("h"), rank(TAIL_WORDS).alias("t"))
    best = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct(c, "bodypart")))["bodypart"]
    return p.groupBy("session_id").agg(best("h").alias("head"), best("t").alias("tail")).where("head <> tail")


def spine_length(frames: DataFrame, ends: DataFrame, floor: float = SPINE_FLOOR) -> DataFrame:
    """session_id, spine (median length, in hundredths of px, over the frames that have both ends, at least ``floor``; null median: no row)."""
    p = join_dim(frames.select(*TRACK, "frame", "x", "y"), ends, ["session_id"], "inner").where("bodypart = head or bodypart = tail")
    at = lambda c: F.max(F.when(F.col("bodypart") == F.col(c), F.struct("x", "y")))
    f = p.where("x is not null and y is not null").groupBy("session_id", "frame").agg(at("head").alias("h"), at("tail").alias("t"))
    f = f.withColumn("d", F.hypot(F.col("h.x") - F.col("t.x"), F.col("h.y") - F.col("t.y"))).where("d is not null")
    m = quantiles(f.withColumn("d", F.round("d", 2)), ["session_id"], "d", {"m": 0.5})
    return m.select("session_id", F.greatest(F.lit(floor), F.col("m")).alias("spine"))


def require_bins(b: DataFrame) -> DataFrame:
    """Refuses an input without a single full bin."""
    if b.isEmpty():
        raise ValueError("no session is as long as one bin")
    return b


def _named(prefix: str, *parts: str) -> Column:
    return F.concat(F.lit(prefix + ":"), F.concat_ws("|", *parts)).alias("feature")


def _pairs3(b: DataFrame) -> DataFrame:
    pts = b.where("x is not null and y is not null and z is not null").groupBy("session_id", "bin", "frame").agg(F.sort_array(F.collect_list(F.struct("bodypart", "x", "y", "z"))).alias("p"))
    d = lambda a, o: F.sqrt(sum(((a[c] - o[c]) * (a[c] - o[c]) for c in ("x", "y", "z")), F.lit(0.0)))
    pairs = F.flatten(F.transform("p", lambda a: F.transform(F.filter("p", lambda o: o["bodypart"] > a["bodypart"]), lambda o: F.struct(a["bodypart"].alias("part_a"), o["bodypart"].alias("part_b"), d(a, o).alias("d")))))
    e = pts.select("session_id", "bin", F.explode(pairs).alias("e"))
    return e.groupBy("session_id", "bin", F.col("e.part_a").alias("part_a"), F.col("e.part_b").alias("part_b")).agg(F.avg("e.d").alias("dist"))


def distances(b: DataFrame, space: int = 2) -> DataFrame:
    return pair_distances(b) if space == 2 else _pairs3(b)


def speeds(b: DataFrame, space: int = 2) -> DataFrame:
    """Distance of each part's mean position from that of the bin before, and its change: session_id, bin, bodypart, velocity,
    acceleration."""
    axes = ("x", "y", "z")[:space]
    m = b.groupBy(*TRACK, "bin").agg(*[F.avg(c).alias(c) for c in axes])
    m, w = halo(m, "bin", 4), in_shards(TRACK, "bin")
    step = F.sqrt(sum(((F.col(c) - _before(c, 1, w)) * (F.col(c) - _before(c, 1, w)) for c in axes), F.lit(0.0)))
    m = m.withColumn("velocity", step)
    m = m.withColumn("acceleration", F.col("velocity") - _before("velocity", 1, w))
    return home(m).select(*KEY, "bodypart", "velocity", "acceleration")


def _dist_vel(b: DataFrame, name: str, space: int) -> DataFrame:
    d = distances(b, space).select(*KEY, _named(f"dist{name}", "part_a", "part_b"), F.col("dist").alias("value"))
    v = speeds(b, space).select(*KEY, _named(f"vel{name}", "bodypart"), F.col("velocity").alias("value"))
    return d.unionByName(v).where("value is not null")


def wide_block(b: DataFrame, times: int, name: str, space: int = 2) -> DataFrame:
    """Distances and speeds over bins ``times`` as wide, given to each bin that they hold and that has a frame."""
    own = b.select(*KEY).distinct()
    w = _dist_vel(b.withColumn("bin", F.floor(F.col("bin") / times)), name, space).withColumnRenamed("bin", "_w")
    return own.withColumn("_w", F.floor(F.col("bin") / times)).join(w, ["session_id", "_w"]).select(*KEY, "feature", "value")


def fine_block(b: DataFrame, sessions: DataFrame, name: str = "50", space: int = 2, least_fps: float = 60.0) -> DataFrame:
    """Distances and speeds over half bins, averaged over the two of a bin, of the sessions recorded at ``least_fps`` or more."""
    quick = sessions.where(F.col("fps") >= least_fps).select("session_id").distinct()
    half = join_dim(b, quick, ["session_id"], "left_semi")
    late = (F.col("frame") - F.col("bin") * F.col("win") >= F.ceil(F.col("win") / 2)).cast("int")
    d = _dist_vel(half.withColumn("bin", F.col("bin") * 2 + late), name, space)
    return d.groupBy("session_id", F.floor(F.col("bin") / 2).alias("bin"), "feature").agg(F.avg("value").alias("value"))


def chains(parts: DataFrame, chain: list[str]) -> DataFrame:
    """session_id, chain: the parts of a chain that a session has, in its order, of sessions with three or more. ``parts``: session_id,
    bodypart."""
    rank = F.coalesce(*[F.when(F.col("bodypart") == c, i) for i, c in enumerate(chain)])
    g = parts.distinct().withColumn("r", rank).where("r is not null").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("r", "bodypart"))).alias("c"))
    return g.where(F.size("c") >= 3).select("session_id", F.transform("c", lambda x: x["bodypart"]).alias("chain"))


def angles(b: DataFrame, chain: list[str], *, fallback: bool = False) -> DataFrame:
    """Mean angle at each inner part of a chain of body parts. Sessions with fewer than three parts of the chain have none, or with
    ``fallback`` those of their parts by name, evenly spaced."""
    rank = F.coalesce(*[F.when(F.col("bodypart") == c, i) for i, c in enumerate(chain)]) if chain else F.lit(None).cast("int")
    parts = b.select(*TRACK).distinct().withColumn("r", rank)
    g = parts.groupBy("session_id").agg(F.sort_array(F.collect_list(F.when(F.col("r").isNotNull(), F.struct("r", "bodypart")))).alias("c"), F.sort_array(F.collect_list("bodypart")).alias("all"))
    own = F.transform("c", lambda x: x["bodypart"])
    k = F.least(F.lit(5), F.size("all"))
    spaced = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.get("all", F.floor(i * (F.size("all") - 1) / F.greatest(k - 1, F.lit(1))).cast("int")))
    use = F.when(F.size("c") >= 3, own)
    if fallback:
        use = use.when(F.size("all") >= 3, spaced)
    g = g.select("session_id", use.alias("u")).where("u is not null")
    pts = b.where("x is not null and y is not null").groupBy("session_id", "bin", "frame").agg(F.map_from_entries(F.collect_list(F.struct("bodypart", F.struct("x", "y")))).alias("p"))
    j = join_dim(pts, g, ["session_id"], "inner")
    at = lambda i: F.element_at("p", F.get("u", i))

    def angle(i: Column) -> Column:
        a, o, c = at(i), at(i + 1), at(i + 2)
        ax, ay, cx, cy = a["x"] - o["x"], a["y"] - o["y"], c["x"] - o["x"], c["y"] - o["y"]
        cos = (ax * cx + ay * cy) / (F.hypot(ax, ay) * F.hypot(cx, cy) + 1e-8)
        return F.struct(F.concat_ws("|", F.get("u", i), F.get("u", i + 1), F.get("u", i + 2)).alias("n"), F.when(cos.isNotNull(), F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).alias("v"))

    e = j.select(*KEY, F.explode(F.transform(F.sequence(F.lit(0), F.size("u") - 3), angle)).alias("e")).where("e.v is not null")
    return e.groupBy(*KEY, F.concat(F.lit("angle:"), F.col("e.n")).alias("feature")).agg(F.avg("e.v").alias("value"))


def assemble(b: DataFrame, sessions: DataFrame, *, space: int = 2, wide: tuple[int, ...] = (2,), fine: bool = True) -> DataFrame:
    """The long table of all blocks: dist, vel, acc, var (two dimensions), drift, then the wide and fine blocks."""
    d = _dist_vel(b, "", space)
    a = speeds(b, space).select(*KEY, _named("acc", "bodypart"), F.col("acceleration").alias("value"))
    out = d.unionByName(a)
    if space == 2:
        v = b.groupBy(*TRACK, "bin").agg(F.var_pop("x").alias("x"), F.var_pop("y").alias("y"))
        for c in ("x", "y"):
            out = out.unionByName(v.select(*KEY, _named(f"var_{c}", "bodypart"), F.col(c).alias("value")))
    axes = ("x", "y", "z")[:space]
    c = b.groupBy(*TRACK, "bin").agg(*[F.avg(x).alias(x) for x in axes]).groupBy(*KEY).agg(*[F.avg(x).alias(x) for x in axes])
    c, w = halo(c, "bin", 12), in_shards(["session_id"], "bin")
    for k in (5, 10):
        c = c.withColumn(f"drift_{k}", F.sqrt(sum(((F.col(x) - _before(x, k, w)) * (F.col(x) - _before(x, k, w)) for x in axes), F.lit(0.0))))
    c = home(c)
    for k in (5, 10):
        out = out.unionByName(c.select(*KEY, F.lit(f"drift:{k}").alias("feature"), F.col(f"drift_{k}").alias("value")))
    for t in wide:
        out = out.unionByName(wide_block(b, t, str(100 * t), space))
    if fine:
        out = out.unionByName(fine_block(b, sessions, space=space))
    return out.where("value is not null")


def _kind(prefix: str) -> Column:
    return F.col("feature").startswith(prefix)


def normalise(f: DataFrame, spine: DataFrame) -> DataFrame:
    """Lengths divided by the session's spine length (variances by its square); angles and shares stay. Sessions without a spine
    stay as they are."""
    j = join_dim(f, spine, ["session_id"])
    s = F.coalesce("spine", F.lit(1.0))
    v = F.when(_kind("var"), F.col("value") / (s * s)).when(_kind("angle") | _kind("vis"), F.col("value")).otherwise(F.col("value") / s)
    return j.select(*KEY, "feature", v.alias("value"))


def weigh(f: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Distances times the root of both parts' weights, what belongs to one part times its weight; 1 for parts not named."""
    if not weights:
        return f
    w = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
    parts = F.split(F.substring_index("feature", ":", -1), r"\|")
    of = lambda i: F.coalesce(F.element_at(w, F.get(parts, F.lit(i))), F.lit(1.0))
    v = F.when(_kind("dist"), F.col("value") * F.sqrt(of(0) * of(1))).when(_kind("vel") | _kind("acc") | _kind("var"), F.col("value") * of(0)).otherwise(F.col("value"))
    return f.select(*KEY, "feature", v.alias("value"))


def append_visibility(f: DataFrame, visibility: DataFrame | None) -> DataFrame:
    """Adds the columns of a visibility block as features, on the bins that both have; without a block nothing changes."""
    if visibility is None or visibility.isEmpty():
        return f
    cols = [c for c in visibility.columns if c not in KEY]
    long = visibility.select(*KEY, F.explode(F.array(*[F.struct(F.lit(f"vis:{c}").alias("feature"), F.col(c).alias("value")) for c in cols])).alias("e")).select(*KEY, "e.*")
    both = visibility.select(*KEY).distinct()
    own = f.select(*KEY).distinct()
    return f.join(both, KEY, "left_semi").unionByName(long.join(own, KEY, "left_semi").where("value is not null"))


def packed(f: DataFrame) -> DataFrame:
    """One row a bin: the features in the order of their names, as a map."""
    return f.groupBy(*KEY).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("feature", "value")))).alias("features"))


#: Bins of a shard of ``totals``, a multiple of every wide bin, and the bins before it that lags and wide bins look back to.
SHARD_BINS, LOOK_BACK = 1200, 10


def _means(v: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Means of runs of rows that begin at ``at``, NaN skipped; NaN where a run has no value."""
    n = np.add.reduceat(~np.isnan(v), at, axis=0, dtype=float)
    return np.where(n > 0, np.add.reduceat(np.nan_to_num(v), at, axis=0) / np.maximum(n, 1), np.nan)


def _steps(x: np.ndarray, y: np.ndarray, key: np.ndarray, k: int = 1) -> np.ndarray:
    """Distance from the row ``k`` before, NaN unless its key is ``k`` less."""
    out = np.full(x.shape, np.nan)
    if len(key) > k:
        out[k:] = np.where((key[k:] - key[:-k] == k).reshape(-1, *[1] * (x.ndim - 1)), np.hypot(x[k:] - x[:-k], y[k:] - y[:-k]), np.nan)
    return out


def _shard_totals(wide: tuple[int, ...], weights: dict[str, float], regions: dict[str, list[str]], low: float):
    """Number and sum of the features of each bin of a shard: the blocks of ``assemble``, angles and visibility."""

    def run(p: pd.DataFrame) -> pd.DataFrame:
        first = p.iloc[0]
        win, spine, chain = int(first["win"]), first["spine"], list(first["chain"]) if first["chain"] is not None else []
        frames, f = np.unique(p["frame"].to_numpy(), return_inverse=True)
        names, c = np.unique(p["bodypart"].to_numpy().astype(str), return_inverse=True)
        cell = f * len(names) + c

        def grid(col: str) -> np.ndarray:  # rows sent again are merged
            v = np.full(len(frames) * len(names), -np.inf)
            np.maximum.at(v, cell, p[col].fillna(-np.inf).to_numpy(dtype=float))
            return np.where(np.isinf(v), np.nan, v).reshape(len(frames), len(names))

        x, y, ll = grid("x"), grid("y"), grid("likelihood")
        bins = frames // win
        own, at = np.unique(bins, return_index=True)
        i, k = np.triu_indices(len(names), 1)
        xy_known = ~(np.isnan(x) | np.isnan(y))
        pair = np.where(xy_known[:, i] & xy_known[:, k], np.hypot(x[:, i] - x[:, k], y[:, i] - y[:, k]), np.nan)
        w = np.array([weights.get(str(n), 1.0) for n in names])
        s = 1.0 if pd.isna(spine) else float(spine)

        def block(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Keys, weighted distances and speeds, and speeds alone."""
            keys, start = np.unique(key, return_index=True)
            speed = _steps(_means(x, start), _means(y, start), keys)
            return keys, np.c_[_means(pair, start) * np.sqrt(w[i] * w[k]), speed * w] / s, speed

        _, base, speed = block(bins)
        out = [base]
        change = np.full(speed.shape, np.nan)
        if len(own) > 1:
            change[1:] = np.where((np.diff(own) == 1)[:, None], speed[1:] - speed[:-1], np.nan)
        out.append(change * w / s)
        mx, my = _means(x, at), _means(y, at)
        run_of = np.repeat(np.arange(len(own)), np.diff(np.r_[at, len(frames)]))
        for v, m in ((x, mx), (y, my)):
            out.append(_means((v - m[run_of]) ** 2, at) * w / (s * s))
        cx, cy = (np.where((~np.isnan(m)).any(1), np.nansum(m, 1) / np.maximum((~np.isnan(m)).sum(1), 1), np.nan) for m in (mx, my))
        out += [_steps(cx, cy, own, lag)[:, None] / s for lag in (5, 10)]
        for t in wide:
            keys, values, _ = block(bins // t)
            out.append(values[np.searchsorted(keys, own // t)])
        if not pd.isna(first["fps"]) and first["fps"] >= 60:
            keys, values, _ = block(bins * 2 + (frames - bins * win >= -(-win // 2)))
            out.append(_means(values, np.unique(keys // 2, return_index=True)[1]))
        where = {str(n): j for j, n in enumerate(names)}
        for a, o, b in zip(chain, chain[1:], chain[2:], strict=False):
            if a in where and o in where and b in where:
                a, o, b = where[a], where[o], where[b]
                ax, ay, bx, by = x[:, a] - x[:, o], y[:, a] - y[:, o], x[:, b] - x[:, o], y[:, b] - y[:, o]
                ok = xy_known[:, a] & xy_known[:, o] & xy_known[:, b]
                cos = (ax * bx + ay * by) / (np.hypot(ax, ay) * np.hypot(bx, by) + 1e-8)
                out.append(_means(np.where(ok, np.arccos(np.clip(cos, -1, 1)), np.nan)[:, None], at))
        values = np.concatenate(out, axis=1)
        # visibility, on the bins that have another feature
        bad = np.where(np.isnan(ll), np.nan, ll < low)
        seen = [_means(v.reshape(-1, 1), at * len(names)) for v in (ll, bad)]
        for parts in regions.values():
            use = [where[q] for q in parts if q in where]
            seen.append(_means(bad[:, use].reshape(-1, 1), at * len(use)) if use else np.full((len(own), 1), np.nan))
        has = (~np.isnan(values)).any(1)
        values = np.concatenate([values, *seen], axis=1)
        keep = has & (own // SHARD_BINS == int(first["_shard"]))
        return pd.DataFrame({"session_id": first["session_id"], "bin": own[keep], "n_features": (~np.isnan(values)).sum(1)[keep].astype("int32"), "total": np.nansum(values, 1)[keep]})

    return run


def totals(rows: DataFrame, tops: DataFrame, sessions: DataFrame, spine: DataFrame, chains: DataFrame, *, wide: tuple[int, ...], weights: dict[str, float], regions: dict[str, list[str]], low: float) -> DataFrame:
    """session_id, bin, n_features, total: number and sum of the features of ``packed`` of every bin, made from the readings in one
    shuffle. ``rows``: session_id, bodypart, frame, x, y, likelihood, repeats allowed; ``tops``: session_id, win, _bins;
    ``chains``: session_id, chain."""
    per = tops.join(sessions.select("session_id", "fps"), "session_id").join(spine, "session_id", "left").join(chains, "session_id", "left")
    p = join_dim(rows, tops, ["session_id"], "inner").withColumn("_bin", F.floor(F.col("frame") / F.col("win"))).where("_bin < _bins")
    own = F.floor(F.col("_bin") / SHARD_BINS)
    ahead = F.when((F.col("_bin") % SHARD_BINS >= SHARD_BINS - LOOK_BACK), own + 1)
    p = p.withColumn("_shard", F.explode(F.array_compact(F.array(own, ahead)))).drop("win", "_bin", "_bins")
    p = p.repartition("session_id", "_shard")
    p = join_dim(p, per.select("session_id", "win", "fps", "spine", "chain"), ["session_id"], "inner")
    return p.groupBy("session_id", "_shard").applyInPandas(_shard_totals(wide, weights, regions, low), "session_id string, bin bigint, n_features int, total double")


def feature_counts(f: DataFrame) -> DataFrame:
    """Number of different features of each block and session."""
    return f.groupBy("session_id", F.substring_index("feature", ":", 1).alias("block")).agg(F.count_distinct("feature").alias("n_features"), F.count("*").alias("n_values"))


def auto_components(n_samples: int, n_features: int, asked: int | None = None, least: float = 5.0, many: int = 50) -> int | None:
    """Number of principal components: what is asked, at most the samples; without a wish ``many`` where there are few samples for
    many features, else None (no reduction)."""
    if asked is not None:
        return max(1, min(asked, n_samples, n_features))
    if n_features > many and n_samples < least * n_features:
        return max(1, min(many, n_samples))
    return None
