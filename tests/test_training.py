"""The training-data operators of the core against brute force and hand-made cases."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import clean, drift, features, grid, missing, models, spikes
from kinetrail.plans.components import connected_components


def pchip(xs, ys, at):
    """Plain monotone cubic over sorted readings."""
    h, d = np.diff(xs), np.diff(ys) / np.diff(xs)
    m = np.zeros(len(xs))
    m[0], m[-1] = d[0], d[-1]
    for k in range(1, len(xs) - 1):
        if d[k - 1] * d[k] > 0:
            w1, w2 = 2 * h[k] + h[k - 1], h[k] + 2 * h[k - 1]
            m[k] = (w1 + w2) / (w1 / d[k - 1] + w2 / d[k])
    k = int(np.searchsorted(xs, at, side="right") - 1)
    t = (at - xs[k]) / h[k]
    return ys[k] * (1 + 2 * t) * (1 - t) ** 2 + h[k] * m[k] * t * (1 - t) ** 2 + ys[k + 1] * t * t * (3 - 2 * t) + h[k] * m[k + 1] * t * t * (t - 1)


@pytest.mark.parametrize("shard", [8, 64])
def test_grid_is_the_unsharded_curve(spark, shard):
    rng = np.random.default_rng(1)
    n, slots = 60, sorted(rng.choice(60, 30, replace=False).tolist())
    vals = rng.normal(size=len(slots)).tolist()
    r = spark.createDataFrame([("a", s, v, "extra") for s, v in zip(slots, vals)] + [("a", 99, 1.0, "x"), ("a", None, 1.0, "x"), ("a", 3, None, "x")], "k string, slot bigint, value double, n string")
    g = spark.createDataFrame([("a", n), ("b", 3), ("c", 0), ("d", None)], "k string, n bigint")
    out = grid.regularize(r, g, ["k"], max_gap=5, shard_slots=shard).toPandas()
    a = out[out.k == "a"].sort_values("slot")
    assert a.slot.tolist() == list(range(n))
    for s, v, st in zip(a.slot, a.value, a.status):
        if s in slots:
            assert st == "genuine" and v == vals[slots.index(s)]
        else:
            lo, hi = [x for x in slots if x < s], [x for x in slots if x > s]
            if lo and hi and hi[0] - lo[-1] - 1 <= 5:
                assert st == "filled" and math.isclose(v, pchip(np.array(slots, float), np.array(vals), s), abs_tol=1e-9)
            else:
                assert st == "missing" and math.isnan(v)
    assert (out[out.k == "b"].status == "missing").all() and len(out[out.k == "b"]) == 3
    assert not set(out.k) & {"c", "d"}


def test_grid_empty(spark):
    r = spark.createDataFrame([], "k string, slot bigint, value double")
    assert grid.regularize(r, spark.createDataFrame([], "k string, n bigint"), ["k"]).count() == 0
    with pytest.raises(ValueError):
        grid.regularize(r, r, ["k"], max_gap=10, shard_slots=10)


def test_sentinels(spark):
    rng = np.random.default_rng(2)
    rows = [("s", "x", float(v), int(i % 9)) for i, v in enumerate(rng.uniform(100, 400, 3000))]
    rows += [("s", "x", -1.0, i % 4) for i in range(40)] + [("s", "x", -0.37, 1)]  # an odd reading in the sentinel's bin
    rows += [("s", "x", 250.25, 3)] * 30  # frozen in one track, amid others
    rows += [("s", "x", 900.0, 5)] * 30  # alone but of one track
    rows += [("s", "likelihood", 1.0, i % 5) for i in range(50)] + [("s", "x", None, 1), ("s", "x", float("nan"), 1)]
    rows += [("t", "y", 99999.5, i % 3) for i in range(30)] + [("t", "y", 99999.9, 1)]  # no whole number, second pass
    got = missing.find_sentinels(spark.createDataFrame(rows, "source string, field string, value double, unit bigint")).collect()
    assert {(r.source, r.field, r.value) for r in got} == {("s", "x", -1.0), ("t", "y", 99999.5)}
    assert missing.find_sentinels(spark.createDataFrame([], "source string, field string, value double, unit bigint")).count() == 0


def test_fill_backs_off(spark):
    cells = spark.createDataFrame([("a", "p", 1.0), ("a", "p", 2.0), ("a", "p", 9.0), ("a", "q", 5.0), ("b", "q", 7.0), ("b", "q", 7.0)], "g string, h string, value double")
    cases = spark.createDataFrame([("a", "p", None), ("a", "q", None), ("c", "q", None), (None, None, None)], "g string, h string, value double")
    got = {(r.g, r.h): (r.value, r.fill_level, r.is_filled) for r in missing.fill_hierarchical(cells, cases, [["g", "h"], ["h"]]).collect()}
    assert got[("a", "p")] == (2.0, 0, True)
    assert got[("a", "q")] == (7.0, 1, True) and got[("c", "q")] == (7.0, 1, True)
    assert got[(None, None)] == (None, None, False)
    words = spark.createDataFrame([("a", "u"), ("a", "v"), ("a", "v"), ("a", "u")], "g string, value string")
    got = missing.fill_hierarchical(words, spark.createDataFrame([("a", None)], "g string, value string"), [["g"]], how="mode").collect()
    assert got[0].value == "u"  # a tie goes to the smaller


def test_stuck_and_excursions():
    v = np.array([1.0] * 9 + [2.0] * 10 + [3.0])
    new = np.zeros(len(v), bool)
    new[0] = True
    assert spikes.stuck(v, new).tolist() == [False] * 10 + [True] * 9 + [False]
    new[14] = True
    assert not spikes.stuck(v, new).any()
    ramp = np.arange(40.0) * 9
    start = np.r_[True, np.zeros(39, bool)]
    assert spikes.residuals(ramp, start).max() == 0  # fast but steady
    ramp[20:23] += 100
    r = spikes.residuals(ramp, start)
    assert set(np.flatnonzero(r > 50)) == {20, 21, 22}
    step = np.r_[np.zeros(20), np.full(20, 50.0)]
    assert spikes.residuals(step, start).max() == 0  # leaves and doesn't come back
    assert spikes.residuals(np.zeros(0), np.zeros(0, bool)).size == 0


def test_spikes_over_shards(spark):
    rng = np.random.default_rng(3)
    rows = []
    for b in ("nose", "tail"):
        x = 300 + np.cumsum(rng.normal(0, 1, 1500))
        y = 200 + np.cumsum(rng.normal(0, 1, 1500))
        for f in range(1500):
            rows.append(["s", b, f, float(x[f]), float(y[f]), 0.5 + 0.4 * float(rng.random()), "src", 640, 480])
    rows[700][3] += 200
    for f in range(250, 265):  # a frozen run over the border of a shard of 256 frames
        rows[f][4] = 123.25
    rows[900][5] = 1.7
    rows[901][3] = -5.0
    rows[902][3] = None
    rows = [tuple(r) for r in rows] + [tuple(rows[700])] + [(None, "nose", 1, 1.0, 1.0, 1.0, "src", 1, 1)]
    t = spark.createDataFrame(rows, "session_id string, bodypart string, frame bigint, x double, y double, likelihood double, source string, frame_w int, frame_h int")
    for shard in (256, 8192):
        got = {(r.bodypart, r.frame, r.field) for r in spikes.flag_spikes(t, shard_frames=shard).collect()}
        assert got == {("nose", 700, "x"), ("nose", 900, "likelihood"), ("nose", 901, "x")} | {("nose", f, "y") for f in range(251, 265)}
    assert spikes.flag_spikes(t.limit(0)).count() == 0


@pytest.mark.parametrize(
    "name,part",
    [("frontLeftPaw", "front_left_paw"), ("PAW_FL", "front_left_paw"), ("left-forepaw", "front_left_paw"), ("Ear Left", "left_ear"), ("l_ear", "left_ear"), ("animal1_noseTip", "nose"),
     ("Nape", "neck"), ("midBack", "back_middle"), ("bodycentre", "back_middle"), ("Tail Root", "tailbase"), ("tailEnd", "tail_tip"), ("right_hindpaw", "back_right_paw")],
)
def test_canonical_parts(name, part):
    ref = [("left_ear", "left_ear"), ("left_forepaw", "front_left_paw"), ("front_left_paw", "front_left_paw"), ("right_hindpaw", "back_right_paw"), ("mid_back", "back_middle")]
    assert drift.canonical(name, drift._landmarks(ref)) == f"part:{part}"


def records(spark, files):
    return spark.createDataFrame([(f, i, p) for f, ps in files.items() for i, p in enumerate(ps)], "file_id bigint, line_no int, payload string")


def test_schema_changes(spark):
    r = records(spark, {
        1: ['{"source":"a","fps":30,"nose":{"x":1,"y":2,"likelihood":1},"note":null}', '{"sour', None, "[1]", '{"source":"a","zeta_level":"kkk"}'],
        2: ['{"dataset":"a","fps":"30","Nose Tip":{"x":1,"y":2,"likelihood":1},"note":"x","crop":[1],"zeta_level_1":"kkk"}'],
        3: ['{"dataset":"a","fps":"30","left_ear":{"x":1,"y":2,"likelihood":1},"note":"x","crop":[1],"zeta_level_1":"kkk"}'],
    })
    f = spark.createDataFrame([(1, "f", "2020-01-01 10:00:00"), (3, "f", "2020-01-03 10:00:00"), (2, "f", "2020-01-01 11:00:00")], "file_id bigint, feed_id string, recorded_at string")
    f = f.withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    got = {(x.file_id, x.field, x.change) for x in drift.schema_changes(r, f, []).collect()}
    assert got == {(2, "dataset", "renamed"), (2, "fps", "retyped"), (2, "Nose Tip", "renamed"), (2, "crop", "added"), (2, "zeta_level_1", "renamed"), (3, "Nose Tip", "removed"), (3, "left_ear", "added")}
    assert drift.schema_changes(r.limit(0), f.limit(0), []).count() == 0


def test_flooding_decides(spark):
    """Renames to names that are in no list: by unique values, by the place in the list of body parts, by learned words."""
    pt = '{"x":1,"y":2,"likelihood":1}'
    r = records(spark, {
        1: ['{"fps":30,"gain":7,"parts":"snout,neck,qux","snout":%s,"neck":%s,"qux":%s}' % (pt, pt, pt)],
        2: ['{"sampling_rate":30,"gain":7,"parts":"muzzle,neck,blob","muzzle":%s,"neck":%s,"blob":%s}' % (pt, pt, pt)],
        3: ['{"zoom":7,"gain":7,"parts":"neck,tail_tip,muzzle","neck":%s,"tail_tip":%s,"muzzle":%s}' % (pt, pt, pt)],
        4: ['{"volt":7,"gain":7,"parts":"neck,wing,tail_tip","neck":%s,"tail_tip":%s,"wing":%s}' % (pt, pt, pt)],
    })
    f = spark.createDataFrame([(i, "f", f"2020-01-0{i} 10:00:00") for i in range(1, 5)], "file_id bigint, feed_id string, recorded_at string").withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    got = {(x.file_id, x.field, x.change, x.old_field) for x in drift.schema_changes(r, f, []).collect()}
    assert {g for g in got if g[0] == 2} == {(2, "sampling_rate", "renamed", "fps"), (2, "muzzle", "renamed", "snout"), (2, "blob", "renamed", "qux")}
    # another value; another place
    assert {g[1:3] for g in got if g[0] == 3} == {("sampling_rate", "removed"), ("zoom", "added"), ("blob", "removed"), ("tail_tip", "added")}
    # a value that a common field has too tells less, and the list puts the new part elsewhere
    assert {g[1:3] for g in got if g[0] == 4} == {("zoom", "removed"), ("volt", "added"), ("muzzle", "removed"), ("wing", "added")}


def test_long_values_are_compared_whole(spark):
    long = "a" * 250
    r = records(spark, {1: ['{"zeta":"%sx"}' % long, '{"eta":"%sx"}' % long], 2: ['{"kappa":"%sy"}' % long, '{"iota":"%sx"}' % long]})
    got = {(x.file_id, x.field, x.lo) for x in drift.file_schemas(drift.parse_fields(r)).collect()}
    lo = {f: v for _, f, v in got}
    assert lo["zeta"] == lo["eta"] == lo["iota"] != lo["kappa"]


def test_table_keeps_every_field(spark):
    pt = lambda x: "[%d,2,1]" % x
    r = records(spark, {1: ['{"animal1_nose":%s,"animal2_nose":%s,"centroid":%s,"back_middle":%s,"fps":30,"framerate":25,"odd":1}' % (pt(1), pt(5), pt(7), pt(8))]})
    f = spark.createDataFrame([(1, "f", "2020-01-01 10:00:00")], "file_id bigint, feed_id string, recorded_at string").withColumn("recorded_at", F.col("recorded_at").cast("timestamp"))
    row = drift.consistent_table(r, f, []).collect()
    assert len(row) == 1 and row[0].points == {"nose": [1.0, 2.0, 1.0], "nose@2": [5.0, 2.0, 1.0], "back_middle": [8.0, 2.0, 1.0]}
    assert row[0].fps == 30.0 and {x["field"]: x["val"] for x in json.loads(row[0].other)} == {"centroid": pt(7), "framerate": "25", "odd": "1"}


def test_components(spark):
    rng = np.random.default_rng(5)
    e = [(int(a), int(b)) for a, b in rng.integers(0, 300, (200, 2))] + [(i, i + 1) for i in range(1000, 1100)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(e, "a bigint, b bigint")).collect()}
    low = {}

    def find(x):
        while low.setdefault(x, x) != x:
            x = low[x]
        return x

    for a, b in e:
        if a is not None and a != b:
            x, y = find(a), find(b)
            low[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in low}


def test_hmm_counts_every_transition(spark):
    labels = np.random.default_rng(8).integers(-1, 3, 50).tolist()
    f = spark.createDataFrame([("a", i, v) for i, v in enumerate(labels)] + [("b", 3, 1), ("b", 40, 2)], "session_id string, frame bigint, label int")
    want = np.ones((3, 3))
    seen = [v for v in labels if v >= 0]
    for a, b in [*zip(seen, seen[1:]), (1, 2)]:
        want[a, b] += 1
    for shard in (4, 7, 4096):
        assert np.allclose(models.train_hmm(f, 3, shard=shard)["trans"], want / want.sum(1, keepdims=True))


def test_density_labels_reach_all_rows(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(0, 0.3, 2) + [8 * (i % 2), 0]).tolist()) for i in range(300)] + [(900, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    got = {r.id: r.label for r in models.density_labels(df, "id", "v", bound=80, least=10, samples=3, hidden=(8,)).collect()}
    assert set(got) == set(range(300)) and len({got[0], got[1]}) == 2
    assert all(got[i] == got[i % 2] for i in got)
    few = models.density_labels(df.where("id < 5"), "id", "v", bound=80, least=10).collect()
    assert len(few) == 5 and {r.label for r in few} == {-1}
    assert models.density_labels(df.limit(0), "id", "v").count() == 0


@pytest.mark.parametrize("seed", [1])
def test_no_border_changes_the_flags(spark, seed):
    """Any shard size gives the flags of the unsharded track, with gaps of frames at every border."""
    rng = np.random.default_rng(seed)
    rows, frame = [], 0
    x = 300 + np.cumsum(rng.normal(0, 1, 1500))
    for k, at in enumerate(rng.integers(5, 1480, 9)):
        x[at : at + 1 + k % 4] += rng.choice([-90, 90])
    for a, n in ((20, 12), (100, 40), (200, 9), (250, 10), (310, 25), (900, 300)):
        x[a : a + n] = x[a]
    for v in x:
        frame += int(rng.choice([1, 1, 1, 2, 40]))
        rows.append(("s", "nose", frame, None if rng.random() < 0.05 else float(v), float(rng.normal(200, 1)), 0.5, "src", 640, 480))
    t = spark.createDataFrame(rows, "session_id string, bodypart string, frame bigint, x double, y double, likelihood double, source string, frame_w int, frame_h int")
    flags = lambda n: sorted((r.frame, r.field, r.reason, round(r.resid or 0, 9)) for r in spikes.flag_spikes(t, shard_frames=n).collect())
    whole = flags(1 << 40)
    assert {r[2] for r in whole} == {"case", "far"}
    for n in (1, 17, 300):
        assert flags(n) == whole, n


def test_tail_fit():
    rng = np.random.default_rng(7)
    x = np.r_[rng.exponential(2.0, 200_000), np.full(2000, 500.0)]
    u, n = np.unique(np.round(x, 2), return_counts=True)
    at = spikes.gpd_cutoff(u, n, 1e-6)
    assert 2 * np.log(1e6) * 0.85 < at < 2 * np.log(1e6) * 1.15  # the share of outliers moves the cutoff little
    shape, scale = spikes.gpd(rng.pareto(5, 400_000), np.ones(400_000))
    assert abs(shape - 0.2) < 0.03 and abs(scale - 0.2) < 0.02
    assert spikes.gpd_cutoff(np.zeros(1), np.array([50])) == 0.0
    phase = np.repeat(np.arange(12), 500)
    r = rng.exponential(1.0, 6000) * np.where(phase == 4, 6, 1)
    s = spikes.seasonal_scales(phase, r, np.full(6000, 40))
    assert s[4] > 3 and np.abs(np.delete(s, 4) - np.median(s)).max() < 0.3


def test_no_border_changes_tracks(spark):
    """Lags, means over rows and gap filling at any shard size, with gaps of frames wider than a shard."""
    rng = np.random.default_rng(11)
    frames = np.cumsum(rng.choice([1, 1, 2, 30, 200], 120))
    rows = [("s", "nose", int(f), float(rng.normal()), float(rng.normal()), float(rng.random())) for f in frames]
    t = spark.createDataFrame(rows, "session_id string, bodypart string, frame bigint, x double, y double, likelihood double")
    s = spark.createDataFrame([("s", 30.0)], "session_id string, fps double")
    out = lambda df: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect())
    for make in (lambda n: features.tracking_metrics(t, s, shard=n), lambda n: clean.boxcar(t, 5, shard=n), lambda n: clean.fill_gaps(t, 0.5, 3, shard=n)):
        whole = out(make(1 << 30))
        for n in (1, 10, 333):
            assert out(make(n)) == whole
    x = np.array([r[3] for r in rows])
    want = [sum(x[max(0, i - 2) : i + 3]) / 5 for i in range(len(x))]
    assert np.allclose([r[3] for r in sorted(clean.boxcar(t, 5, shard=10).select("session_id", "bodypart", "frame", "x").collect())], want)


def test_many_asked_groups_are_sieved(spark, data, monkeypatch):
    """Beyond the size of a small broadcast the groups are found by bits: the fills are the same, and the driver holds no hashes."""
    from kinetrail.operators import missing

    key = lambda r: (r.session_id, r.source, r.bodypart, r.frame, r.field, r.value, r.fill_level)
    want = sorted(map(key, missing.p3_fills(spark, data).collect()), key=str)
    monkeypatch.setattr(missing, "NEED_BYTES", 0)
    monkeypatch.setattr(missing, "SIEVE_WORDS", 64)
    assert sorted(map(key, missing.p3_fills(spark, data).collect()), key=str) == want
    rows = spark.range(-3000, 3000).selectExpr("xxhash64(id) as _h", "id")
    need = rows.where("id % 100 = 0").select("_h")
    got = {r.id for r in missing.sieved(rows, need).collect()}
    assert {i for i in range(-3000, 3000) if i % 100 == 0} <= got and len(got) < 600
