"""Implausible spikes, frozen values and impossible readings in tracked measurements.

A track is cut into shards of frames. In a shard each axis is compared with its own course just before and after, which takes
out level, trend and rests; that residual is then divided by its source's seasonal scale, the usual size of residuals in that
phase of a cycle. The seasonal residuals of a source, as a histogram, give the source's cutoff by peaks over threshold: a
generalised Pareto tail above the 95 % residual, fitted by probability-weighted moments to the exceedances that are no outliers
of the fit itself, gives the residual that is passed with a fixed probability. What goes beyond for a few readings and comes back
is a spike. Stuck values and impossible readings have rules of their own.

Nothing is copied across shard borders. Each shard leaves one row per axis with its first and last readings and its runs at
both ends; from these rows the readings next to a border get their residuals, and runs across borders their length, whatever
the distance between the readings.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.operators.missing import find_sentinels, sentinel_map, sessions
from kinetrail.plans.runtime import cut, join_dim, nan_to_null, table

FIELDS = ("x", "y", "likelihood")
SHARD_FRAMES = 8192
#: An excursion of more readings than this is no spike.
MOST_READINGS = 5
STUCK_LEAST = 10
#: Probability that a reading of a well-behaved source passes its cutoff, so small that the largest corpora give no false alarm,
#: and the share of readings that make up the tail.
RISK, TAIL = 1e-13, 0.05
#: Frames of the seasonal cycle (a minute at 30 a second), its phases, and the readings that count as much as no season at all.
SEASON_FRAMES, PHASES, SEASON_SUPPORT = 1800, 12, 2000
BINS_PER_OCTAVE = 16
ROWS_AT_ONCE = 60_000

_OUT = pa.schema(
    [("kind", pa.string()), ("session_id", pa.string()), ("bodypart", pa.string()), ("frame", pa.int64()), ("field", pa.string())]
    + [("resid", pa.float64()), ("sid", pa.int64()), ("phase", pa.int32()), ("bin", pa.int32()), ("n", pa.int64())]
    + [("tid", pa.int64()), ("shard", pa.int64()), ("head_run", pa.int64()), ("tail_run", pa.int64()), ("first_v", pa.float64()), ("last_v", pa.float64())]
    + [(c, pa.list_(t)) for c, t in (("head_f", pa.int64()), ("tail_f", pa.int64()), ("near_head_f", pa.int64()), ("near_tail_f", pa.int64()), ("near_head_v", pa.float64()), ("near_tail_v", pa.float64()))]
    + [("near_n", pa.int64())]
)
_NAMES = {pa.string(): "string", pa.int64(): "bigint", pa.int32(): "int", pa.float64(): "double", pa.list_(pa.int64()): "array<bigint>", pa.list_(pa.float64()): "array<double>"}
SCHEMA = ", ".join(f"{f.name} {_NAMES[f.type]}" for f in _OUT)


def _batch(rows_: int, **cols) -> pa.RecordBatch:
    """A batch of the output schema; columns that are not given are null."""
    arrays = [cols[f.name] if isinstance(cols.get(f.name), pa.Array) else pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(rows_, f.type) for f in _OUT]
    return pa.RecordBatch.from_arrays(arrays, schema=_OUT)


def stuck(v: np.ndarray, new: np.ndarray, least: int = STUCK_LEAST) -> np.ndarray:
    """Readings in a run of ``least`` or more equal ones, the first of a run excepted. ``new``: first reading of a series."""
    if not len(v):
        return np.zeros(0, bool)
    start = new.copy()
    start[1:] |= v[1:] != v[:-1]
    start[0] = True
    at = np.flatnonzero(start)
    long = np.repeat(np.diff(np.r_[at, len(v)]) >= least, np.diff(np.r_[at, len(v)]))
    return long & ~start


def residuals(v: np.ndarray, new: np.ndarray, most: int = MOST_READINGS) -> np.ndarray:
    """Depth of the excursion a reading is part of: over all runs of up to ``most`` readings that hold it, the largest distance
    that every reading of the run keeps from the band between the reading before and the one after the run. A rest, a
    steady movement however fast, and a turn stay within a step of that band. A run at an end of its series has no band (0)."""
    n = len(v)
    out = np.zeros(n)
    series = np.cumsum(new)
    for size in range(1, most + 1):
        if n < size + 2:
            break
        a, b = v[: n - size - 1], v[size + 1 :]
        low, high = np.minimum(a, b), np.maximum(a, b)
        depth = np.where(series[: n - size - 1] == series[size + 1 :], np.inf, 0.0)
        for k in range(1, size + 1):
            x = v[k : n - size - 1 + k]
            np.minimum(depth, np.maximum(x - high, low - x), out=depth)
        np.maximum(depth, 0, out=depth)
        for k in range(1, size + 1):
            part = out[k : n - size - 1 + k]
            np.maximum(part, depth, out=part)
    return out


def phase_of(frame: np.ndarray, season: int = SEASON_FRAMES) -> np.ndarray:
    return (frame % season) * PHASES // season


def _bins(r: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(r + 2.0**-10) * BINS_PER_OCTAVE).astype(np.int64)


def _edge(b) -> float:
    return 2.0 ** (b / BINS_PER_OCTAVE) - 2.0**-10


def _quantile(x: np.ndarray, w: np.ndarray, p: float) -> float:
    """Of values in ascending order with weights."""
    return float(x[min(int(np.searchsorted(np.cumsum(w), p * w.sum())), len(x) - 1)])


def seasonal_scales(phase: np.ndarray, x: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Scale of each phase: its 90 % residual over that of all phases, drawn towards 1 where a phase has few readings."""
    order = np.argsort(x, kind="stable")
    phase, x, n = phase[order], x[order], n[order]
    every = _quantile(x, n, 0.9)
    out = np.ones(PHASES)
    for p in range(PHASES):
        own = phase == p
        if own.any() and every > 0:
            size = n[own].sum()
            here = max(_quantile(x[own], n[own], 0.9), every / 8)
            out[p] = (here / every) ** (size / (size + SEASON_SUPPORT))
    return out


def gpd(y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Shape and scale of a generalised Pareto distribution of exceedances by probability-weighted moments."""
    order = np.argsort(y, kind="stable")
    y, w = y[order], w[order]
    total = w.sum()
    above = 1 - (np.cumsum(w) - w / 2) / total
    b0, b1 = (w * y).sum() / total, (w * y * above).sum() / total
    if b0 <= 2 * b1 * (1 + 1e-9):
        return 0.0, max(b0, 1e-9)
    return 2 - b0 / (b0 - 2 * b1), 2 * b0 * b1 / (b0 - 2 * b1)


def gpd_cutoff(x: np.ndarray, n: np.ndarray, risk: float = RISK) -> float:
    """The value that is passed with probability ``risk``, from a histogram of residuals. Exceedances beyond the cutoff are
    outliers and not part of the tail, so the fit is repeated without them until it holds; it begins with the exponential tail
    of the median exceedance, which a share of outliers below a half doesn't move far."""
    order = np.argsort(x, kind="stable")
    x, n = x[order].astype(float), n[order].astype(float)
    u = _quantile(x, n, 1 - TAIL)
    over = x > u
    y, w, base = x[over] - u, n[over], n[~over].sum()
    if not len(y):
        return u
    scale = max(_quantile(y, w, 0.5) / np.log(2), 1e-9)
    level = scale * np.log(max(w.sum() / n.sum() / risk, 2))
    seen: set[int] = set()
    while True:
        keep = int(np.searchsorted(y, level, "right"))
        if keep in seen or not keep:
            return u + level
        seen.add(keep)
        shape, scale = gpd(y[:keep], w[:keep])
        if shape < 2 / np.sqrt(w[:keep].sum()):
            # exponential unless the tail is heavier beyond its standard error; an end of the tail is never taken for granted
            shape, scale = 0.0, max(float((w[:keep] * y[:keep]).sum() / w[:keep].sum()), 1e-9)
        odds = max(w[:keep].sum() / (base + w[:keep].sum()) / risk, 2)
        level = scale * np.log(odds) if abs(shape) < 1e-6 else scale / shape * (odds**shape - 1)


class _Tally:
    """Histograms of the residuals by source and phase, and the residual from which readings of a source were kept."""

    def __init__(self, keep_all: bool, season: int):
        self.keep_all, self.season, self.seen = keep_all, season, {}

    def add(self, r: np.ndarray, frame: np.ndarray, sid: np.ndarray) -> np.ndarray:
        """Counts the residuals and tells which to keep: those from the 95 % residual of their source here on."""
        bins, phase = _bins(r), phase_of(frame, self.season)
        floor = np.zeros(len(r))
        for source in np.unique(sid):
            own = sid == source
            h = self.seen.setdefault(int(source), {"h": {}, "floor": 0.0})
            u, c = np.unique(bins[own] * PHASES + phase[own], return_counts=True)
            for k, y in zip(u.tolist(), c.tolist(), strict=True):
                h["h"][k] = h["h"].get(k, 0) + y
            if not self.keep_all:
                ks = np.array(sorted(h["h"]))
                cum = np.cumsum([h["h"][k] for k in ks])
                least = _edge(ks[int(np.searchsorted(cum, 0.95 * cum[-1]))] // PHASES)
                h["floor"] = max(h["floor"], least)
                floor[own] = least
        return (r >= floor) if self.keep_all else (r >= floor) & (r > 0)

    def batch(self) -> pa.RecordBatch | None:
        rows = [(s, k % PHASES, k // PHASES, c, h["floor"]) for s, h in self.seen.items() for k, c in h["h"].items()]
        if not rows:
            return None
        sid, phase, bins, n, floor = zip(*rows, strict=True)
        return _batch(len(rows), kind=["hist"] * len(rows), sid=sid, phase=phase, bin=bins, n=n, resid=floor)


def _take(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of so many items from each start on, and their offsets."""
    offsets = np.r_[0, np.cumsum(size)]
    return np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1]), offsets.astype(np.int32)


def _kernel(keep_all: bool, season: int):
    ends = 2 * MOST_READINGS

    def part(t: pa.Table, tally: _Tally):
        num = lambda c: t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        tid, shard, frame, sid, bad = (num(c) for c in ("tid", "shard", "frame", "sid", "bad"))
        new = np.r_[True, (tid[1:] != tid[:-1]) | (shard[1:] != shard[:-1])]
        again = np.r_[False, frame[1:] == frame[:-1]] & ~new
        series = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        name, what = t.column("session_id"), t.column("bodypart")
        for k, f in enumerate(FIELDS):
            v = num(f).astype(np.float64, copy=False)
            at = np.flatnonzero(~np.isnan(v) & ~again)
            if not len(at):
                continue
            s = series[at]
            edge = np.r_[True, s[1:] != s[:-1]]
            no = (bad[at] >> k & 1).astype(bool)
            hit = at[stuck(v[at], edge) | no]
            if len(hit):
                rows = pa.array(hit)
                yield _batch(len(hit), kind=["case"] * len(hit), session_id=name.take(rows).combine_chunks(), bodypart=what.take(rows).combine_chunks(), frame=frame[hit], field=[f] * len(hit))
            # one row for each series with a reading: its ends
            here = s[edge]
            first = np.flatnonzero(edge)
            n = np.diff(np.r_[first, len(at)])
            turn = np.r_[True, (v[at][1:] != v[at][:-1])] | edge
            runs = np.flatnonzero(turn)
            length = np.diff(np.r_[runs, len(at)])
            head_run, tail_run = length[np.searchsorted(runs, first)], length[np.searchsorted(runs, first + n - 1, "right") - 1]
            some = np.minimum(n, ends)
            lists = {}
            for c, start in (("head_f", first), ("tail_f", first + n - some)):
                i, o = _take(start, some)
                lists[c] = pa.ListArray.from_arrays(o, frame[at[i]])
            near = at[~no]
            m = np.zeros(len(here), int)
            if k < 2 and len(near):
                q = series[near]
                m = np.bincount(q, minlength=len(begin))[here]
                z = np.cumsum(m) - m
                r = residuals(v[near], np.r_[True, q[1:] != q[:-1]])
                pos = np.arange(len(near)) - np.repeat(z, m)
                mine = (pos >= MOST_READINGS) & (pos < np.repeat(m, m) - MOST_READINGS)  # readings near an end wait for their neighbours
                i, r = near[mine], r[mine]
                keep = tally.add(r, frame[i], sid[i])
                i, r = i[keep], r[keep]
                if len(i):
                    rows = pa.array(i)
                    yield _batch(len(i), kind=["far"] * len(i), session_id=name.take(rows).combine_chunks(), bodypart=what.take(rows).combine_chunks(), frame=frame[i], field=[f] * len(i), resid=r, sid=sid[i], phase=phase_of(frame[i], season))
                some = np.minimum(m, ends)
                for c, start in (("near_head", z), ("near_tail", z + m - some)):
                    i, o = _take(start, some)
                    lists[c + "_f"], lists[c + "_v"] = pa.ListArray.from_arrays(o, frame[near[i]]), pa.ListArray.from_arrays(o, v[near[i]])
            rows = pa.array(begin[here])
            yield _batch(
                len(here), kind=["edge"] * len(here), session_id=name.take(rows).combine_chunks(), bodypart=what.take(rows).combine_chunks(), field=[f] * len(here), sid=sid[begin[here]], tid=tid[begin[here]],
                shard=shard[begin[here]], n=n, head_run=head_run, tail_run=tail_run, first_v=v[at[first]], last_v=v[at[first + n - 1]], near_n=m, **lists,
            )

    def run(batches):
        tally = _Tally(keep_all, season)
        held: list = []
        n = 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < ROWS_AT_ONCE:
                continue
            t = pa.Table.from_batches(held)
            tid, shard = t.column("tid").to_numpy(), t.column("shard").to_numpy()
            last = len(tid) - 1
            done = np.flatnonzero((tid != tid[last]) | (shard != shard[last]))
            stop = int(done[-1]) + 1 if len(done) else 0  # the last series may go on in the next batch
            if stop:
                yield from part(t.slice(0, stop), tally)
            rest = t.slice(stop)
            held, n = rest.combine_chunks().to_batches(), 0 if stop else rest.num_rows
        if held and sum(b.num_rows for b in held):
            yield from part(pa.Table.from_batches(held), tally)
        if (out := tally.batch()) is not None:
            yield out

    return run


def _border_kernel(keep_all: bool, season: int):
    """Residuals of the readings from ``own`` to ``own_end`` of short stretches around borders."""

    def run(batches):
        tally = _Tally(keep_all, season)
        for b in batches:
            values, frames = b.column("v"), b.column("f")
            size = np.diff(values.offsets.to_numpy())
            if not len(size) or not size.sum():
                continue
            v, f = values.flatten().to_numpy(zero_copy_only=False), frames.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(size)), size)
            r = residuals(v, np.r_[True, row[1:] != row[:-1]])
            pos = np.arange(len(v)) - np.repeat(np.cumsum(size) - size, size)
            a, z, sid = (b.column(c).to_numpy(zero_copy_only=False) for c in ("own", "own_end", "sid"))
            i = np.flatnonzero((pos >= a[row]) & (pos < z[row]))
            i = i[tally.add(r[i], f[i], sid[row[i]])]
            if len(i):
                take = pa.array(row[i])
                yield _batch(len(i), kind=["far"] * len(i), **{c: b.column(c).take(take) for c in ("session_id", "bodypart", "field")}, frame=f[i], resid=r[i], sid=sid[row[i]], phase=phase_of(f[i], season))
        if (out := tally.batch()) is not None:
            yield out

    return run


def _fit(risk: float):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        phase, n = pdf["phase"].to_numpy(), pdf["n"].to_numpy()
        x = np.array([max(0.0, _edge(b + 0.5)) for b in pdf["bin"]])
        scale = seasonal_scales(phase, x, n)
        cutoff = gpd_cutoff(x / scale[phase], n, risk)
        return pd.DataFrame({"sid": pdf["sid"].iloc[0], "phase": np.arange(PHASES, dtype=np.int32), "cutoff": cutoff * scale, "floor": pdf["floor"].max()})

    return run


def _stretches(edges: DataFrame) -> DataFrame:
    """What the residuals of the readings next to a border are found from: the readings of the shard's end with as many of the
    neighbouring shards as an excursion can reach."""
    reach = MOST_READINGS
    line = W.partitionBy("tid", "session_id", "bodypart", "field").orderBy("shard")
    e = edges.where("near_n > 0")
    last = lambda c: F.when(F.size(c) > reach, F.slice(c, -reach, reach)).otherwise(F.col(c))
    for c in ("f", "v"):
        back = F.flatten(F.collect_list(last(f"near_tail_{c}")).over(line.rowsBetween(-reach, -1)))
        e = e.withColumn(f"back_{c}", back).withColumn(f"ahead_{c}", F.slice(F.flatten(F.collect_list(F.slice(f"near_head_{c}", 1, reach)).over(line.rowsBetween(1, reach))), 1, reach))
    for c in ("f", "v"):
        e = e.withColumn(f"back_{c}", last(f"back_{c}"))
    whole = F.col("near_n") < 2 * reach
    keep = F.size("back_f")
    piece = lambda front, own, behind, a, z: F.struct(
        *[F.concat(*[F.col(f"{x}_{c}") for x in (front, own, behind) if x]).alias(c) for c in ("f", "v")], a.cast("int").alias("own"), z.cast("int").alias("own_end")
    )
    n = F.col("near_n")
    both = F.array(piece("back", "near_head", "", keep, keep + reach), piece("", "near_tail", "ahead", F.lit(reach), F.lit(2 * reach)))
    e = e.withColumn("s", F.explode(F.when(whole, F.array(piece("back", "near_head", "ahead", keep, keep + n))).otherwise(both)))
    return e.select("session_id", "bodypart", "field", "sid", "s.*")


def _runs_over_borders(edges: DataFrame, least: int = STUCK_LEAST) -> DataFrame:
    """Readings of runs that cross a border and that their shard alone doesn't show: session_id, bodypart, frame, field. A shard
    that is one run passes the run on; how much arrives from either side is a sum over such shards."""
    keys = ["tid", "session_id", "bodypart", "field"]
    up, down = W.partitionBy(*keys).orderBy("shard"), W.partitionBy(*keys).orderBy(F.desc("shard"))
    e = edges.withColumn("whole", F.col("head_run") == F.col("n"))

    def arriving(e: DataFrame, w, mine: str, theirs: str, run: str, out: str) -> DataFrame:
        joins = F.coalesce(F.lag(theirs).over(w) == F.col(mine), F.lit(False))
        e = e.withColumn("_j", joins).withColumn("_b", F.when(joins & F.lag("whole").over(w), 0).otherwise(1))
        e = e.withColumn("_seed", F.when(F.col("_j"), F.lag(run).over(w)).otherwise(0)).withColumn("_c", F.sum("_b").over(w))
        c = W.partitionBy(*keys, "_c").orderBy("shard" if w is up else F.desc("shard"))
        passed = F.coalesce(F.sum("n").over(c.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        return e.withColumn(out, F.first("_seed").over(c.rowsBetween(W.unboundedPreceding, 0)) + passed).drop("_j", "_b", "_seed", "_c")

    e = arriving(arriving(e, up, "first_v", "last_v", "tail_run", "left"), down, "last_v", "first_v", "head_run", "right")
    e = e.where("left > 0 or right > 0")
    through = lambda c: F.when(F.col("whole"), F.col(c)).otherwise(0)
    part = lambda run, total, new: F.when(total < least, 0).when(F.col(run) >= least, F.when(new, 1).otherwise(0)).otherwise(F.col(run))
    head, tail = F.col("left") + F.col("head_run") + through("right"), F.col("right") + F.col("tail_run") + through("left")
    lead = F.slice("head_f", 1, part("head_run", head, F.col("left") > 0).cast("int"))
    lead = F.when(F.col("left") > 0, lead).otherwise(F.when(F.col("head_run") >= least, F.slice("head_f", 1, 0)).otherwise(F.slice(lead, 2, 2 * MOST_READINGS)))
    rest = F.when((tail >= least) & (F.col("tail_run") < least) & ~F.col("whole"), F.slice("tail_f", -F.col("tail_run").cast("int"), F.col("tail_run").cast("int")))
    rest = F.coalesce(F.slice(rest, 2, 2 * MOST_READINGS), F.slice("tail_f", 1, 0))  # a run that begins in a shard begins with its first
    return e.select("session_id", "bodypart", F.explode(F.concat(lead, rest)).alias("frame"), "field")


def flag_spikes(track: DataFrame, *, shard_frames: int = SHARD_FRAMES, season: int = SEASON_FRAMES, risk: float = RISK) -> DataFrame:
    """``track``: session_id, bodypart, frame, x, y, likelihood (null where missing), source, frame_w, frame_h.

    Returns session_id, bodypart, frame, field, reason: ``impossible``/``stuck`` as ``case``, ``spike`` as ``far``, with
    ``resid`` and the ``cutoff`` of its source and phase. A row sent again is seen once. Null session, body part or frame: passed
    over; without an image size only negative coordinates are impossible; a null source is a source of its own. The result
    doesn't depend on ``shard_frames``.
    """
    no = lambda c, top: (F.col(c) < 0) | F.coalesce(F.col(c) > top, F.lit(False))
    bit = lambda c, k: F.when(F.coalesce(c, F.lit(False)), F.lit(1 << k)).otherwise(F.lit(0))
    bad = bit(no("x", F.col("frame_w")), 0) + bit(no("y", F.col("frame_h")), 1) + bit(no("likelihood", F.lit(1.0)), 2)
    rows = track.where("session_id is not null and bodypart is not null and frame is not null").select(
        F.xxhash64("session_id", "bodypart").alias("tid"),
        F.floor(F.col("frame") / shard_frames).cast("bigint").alias("shard"),
        "frame",
        "x",
        "y",
        "likelihood",
        F.xxhash64(F.coalesce("source", F.lit(""))).alias("sid"),
        bad.alias("bad"),
        "session_id",
        "bodypart",
    )
    rows = rows.repartition("tid", "shard").sortWithinPartitions("tid", "shard", "session_id", "bodypart", "frame")
    for keep_all in (False, True):
        out = cut(rows.mapInArrow(_kernel(keep_all, season), SCHEMA))
        edges = out.where("kind = 'edge'")
        border = cut(_stretches(edges).mapInArrow(_border_kernel(keep_all, season), SCHEMA))
        both = out.where("kind <> 'edge'").unionByName(border)
        hist = both.where("kind = 'hist'").groupBy("sid", "phase", "bin").agg(F.sum("n").alias("n"), F.max("resid").alias("floor"))
        # one small histogram per source
        cutoffs = cut(hist.groupBy("sid").applyInPandas(_fit(risk), "sid bigint, phase int, cutoff double, floor double"))
        if cutoffs.where("floor > cutoff").isEmpty():  # else some partition kept too little
            break
    far = join_dim(both.where("kind = 'far'"), cutoffs.select("sid", "phase", "cutoff"), ["sid", "phase"], "inner").where("resid > cutoff")
    case = out.where("kind = 'case'").select("session_id", "bodypart", "frame", "field").unionByName(_runs_over_borders(edges))
    case = case.select("*", F.lit("case").alias("reason"), F.lit(None).cast("double").alias("resid"), F.lit(None).cast("double").alias("cutoff"))
    return case.unionByName(far.select("session_id", "bodypart", "frame", "field", F.col("kind").alias("reason"), "resid", "cutoff"))


def pose_track_clean(spark, sf_dir: str) -> DataFrame:
    """pose_track with its session's source and image size, and null where a value is missing or a sentinel."""
    dim = sessions(spark, sf_dir).select("session_id", "source", "frame_w", "frame_h")
    track = table(spark, sf_dir, "pose_track").where("session_id is not null").select("session_id", "bodypart", "frame", "x", "y", "likelihood")
    track = join_dim(track, dim, ["session_id"]).withColumn("scope", F.coalesce("source", F.lit("")))
    long = track.selectExpr("scope as source", "stack(3, 'x', x, 'y', y, 'likelihood', likelihood) as (field, value)", "xxhash64(session_id, bodypart) as unit")
    marks = sentinel_map(find_sentinels(long)).selectExpr("source as scope", "marks")
    track = join_dim(track, cut(marks), ["scope"])
    clean = lambda c: F.when(~F.coalesce(F.array_contains(F.element_at("marks", F.lit(c)), F.col(c)), F.lit(False)), nan_to_null(F.col(c))).alias(c)
    return track.select("session_id", "bodypart", "frame", *[clean(c) for c in FIELDS], "source", "frame_w", "frame_h")


def p5_found(spark, sf_dir: str) -> DataFrame:
    return flag_spikes(pose_track_clean(spark, sf_dir)).select("session_id", "bodypart", "frame", "field").distinct()


def p5_flags(spark, sf_dir: str) -> DataFrame:
    """Every flagged reading with the rule that flagged it, its residual and the cutoff of its source."""
    f = flag_spikes(pose_track_clean(spark, sf_dir))
    return f.groupBy("session_id", "bodypart", "frame", "field").agg(
        F.bool_or(F.col("reason") == "case").alias("impossible_or_stuck"), F.bool_or(F.col("reason") == "far").alias("spike"),
        F.round(F.max("resid"), 3).alias("resid"), F.round(F.max("cutoff"), 3).alias("cutoff"),
    )
