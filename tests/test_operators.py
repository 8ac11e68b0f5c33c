"""Operators against hand-derived values and plain versions."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetrail.operators import arena, bouts, clean, enrich, features, models, stats, vectors
from kinetrail.plans.sequence import carry, indexed
from kinetrail.sources import files

BOUT = "session_id string, label int, start_frame bigint, run_len bigint"


def b(spark, rows):
    return spark.createDataFrame([("s", *r) for r in rows], BOUT)


@pytest.mark.parametrize("shard", [3, 7, 1000])
def test_rle_over_shards(spark, shard):
    rng = np.random.default_rng(1)
    labels = np.repeat(rng.integers(0, 3, 40), rng.integers(1, 9, 40)).tolist()
    frames = [f for f in range(len(labels)) if f != 50]
    df = spark.createDataFrame([("s", f, labels[f], "x") for f in frames] + [("s", 5000, None, "x")], "session_id string, frame bigint, label int, run_len string")
    want, run = [], None
    for f in frames:
        if run and run[0] == labels[f] and run[1] + run[2] == f:
            run[2] += 1
        else:
            run = [labels[f], f, 1]
            want.append(run)
    got = sorted([r.label, r.start_frame, r.run_len] for r in bouts.rle(df, shard).collect())
    assert got == sorted(want)
    assert bouts.rle(df.limit(0)).count() == 0


def test_merge(spark):
    m = lambda rows, ls: sorted((r.start, r.end) for r in bouts.merge(b(spark, rows), ls).collect())
    assert m([(0, 0, 10), (1, 10, 5), (0, 11, 10)], [0]) == [(0, 21)]
    assert m([(0, 0, 10), (1, 10, 20), (0, 40, 10)], [0]) == [(0, 10), (40, 50)]
    assert m([(0, 0, 10), (2, 10, 10), (1, 20, 10)], [0, 2]) == [(0, 20)]


def test_metrics_and_transitions(spark):
    r = {x.behaviour: x for x in bouts.metrics(b(spark, [(0, 0, 10), (1, 10, 20), (0, 40, 10)]), {"g": [0], "no": [9]}, 10.0).collect()}
    assert (r["g"].frequency, r["g"].total_duration, r["g"].mean_bout, r["g"].latency) == (2, 2.0, 1.0, 0.0)
    assert (r["no"].frequency, r["no"].total_duration, r["no"].latency) == (0, 0.0, None)
    assert bouts.session_duration(b(spark, [(0, 0, 10), (1, 10, 30)]), 10.0).first().duration_s == 4.0
    m = {(x.from_label, x.to_label): x.p for x in bouts.transition_matrix(b(spark, [(0, 0, 5), (0, 5, 5), (1, 10, 5)])).collect()}
    assert m == {(0, 0): 0.0, (0, 1): 1.0, (1, 0): 0.0, (1, 1): 0.0}


def test_indexed_and_carry(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([None, 2.0, None, None, 5.0, None])] + [("b", 0, None)], "k string, t bigint, v double")
    assert {(r.k, r.t, r.n) for r in indexed(df, ["k"], ["t"], F.floor(F.col("t") / 2), "n").collect()} == {("a", i, i) for i in range(6)} | {("b", 0, 0)}
    c = carry(df, ["k"], "t", F.col("v"), "p", "n", shard=2).orderBy("k", "t").select("p.value", "n.value").collect()
    assert [tuple(r) for r in c] == [(None, 2.0), (2.0, 2.0), (2.0, 5.0), (2.0, 5.0), (5.0, 5.0), (5.0, None), (None, None)]


def pose(spark, xs, ll=None):
    return spark.createDataFrame([("s", i, "nose", x, 1.0, 0.95 if ll is None else ll[i]) for i, x in enumerate(xs)], "session_id string, frame bigint, bodypart string, x double, y double, likelihood double")


def test_boxcar_is_convolve(spark):
    got = [r.x for r in clean.boxcar(pose(spark, [0.0, 3.0, 6.0, 9.0, 12.0]), 3).orderBy("frame").collect()]
    assert got == pytest.approx(np.convolve([0, 3, 6, 9, 12], np.ones(3) / 3, mode="same"))


def test_gaps(spark):
    ll = [0.9, 0.1, 0.1, 0.9, *[0.1] * 6, 0.9]
    r = clean.fill_gaps(pose(spark, [float(i) if i < 4 else 20.0 for i in range(11)], ll), 0.3, 3).orderBy("frame").collect()
    assert [x.x for x in r[:4]] == [0.0, 1.0, 2.0, 3.0] and not any(x.flat_held for x in r[:4])
    assert [x.x for x in r[4:10]] == [3.0] * 3 + [20.0] * 3 and all(x.flat_held for x in r[4:10])
    assert not any(x.flat_held for x in clean.fill_gaps(pose(spark, [0.0] * 11, ll), 0.3, None).collect())


def test_runs(spark):
    p = pose(spark, [1.0, 9.0, 2.0, 3.0, 4.0, 5.0, 6.0, 99.0], [0.9] * 7 + [0.1])
    assert clean.confident_runs(p).first().run_len == 7
    r = [x.x for x in clean.run_median(p).orderBy("frame").collect()]
    assert r == [2.0, 2.5, 3.0, 4.0, 4.0, 4.5, 5.0, 99.0]


def test_features(spark):
    rows = [("s", f, p, float(f if p == "nose" else 0), 0.0, 1.0) for f in range(35) for p in ("nose", "tail")]
    df = spark.createDataFrame(rows, "session_id string, frame bigint, bodypart string, x double, y double, likelihood double")
    fps = spark.createDataFrame([("s", 25.0)], "session_id string, fps double")
    bins = features.binned(df, fps)
    assert bins.first().win == 2 and bins.agg(F.max("bin")).first()[0] == 16  # half to even, the last frame dropped
    assert features.pair_distances(bins).where("bin = 3").first().dist == 6.5
    v = features.velocity(features.bin_means(bins)).where("bodypart = 'nose'").orderBy("bin").collect()
    assert v[0].velocity is None and v[5].velocity == 2.0
    assert features.variances(bins).where("bodypart = 'nose' and bin = 1").first().var_x == 0.25


SQUARE = arena.Shape("R", ((0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)), "novel")


def test_geometry(spark):
    p = spark.createDataFrame([(5.0, 5.0), (15.0, 5.0), (-1.0, 5.0), (None, 1.0)], "x double, y double")
    assert [r[0] for r in p.select(arena.inside(SQUARE, F.col("x"), F.col("y"))).collect()] == [True, False, False, False]
    assert not p.select(arena.inside(arena.Shape("l", SQUARE.vertices[:2]), F.col("x"), F.col("y"))).first()[0]
    q = spark.createDataFrame([(5.0, 5.0), (20.0, 5.0)], "x double, y double")
    assert [r[0] for r in q.select(arena.edge_distance(SQUARE, F.col("x"), F.col("y"))).collect()] == [5.0, 10.0]
    assert set(arena.hull_points([(0, 0), (4, 0), (4, 4), (0, 4), (2, 2)])) == {(0, 0), (4, 0), (4, 4), (0, 4)} and arena.hull_points([(0, 0), (1, 1)]) == []
    a = arena.parse(json.dumps({"paradigm": "y_maze", "reference_shapes": {"regions": [{"name": "A", "vertices": [[10, 10], [30, 10], [30, 30], [10, 30]], "role": "arm"}]}, "per_video": {"v": {"mode": "transform", "translate": [5, -3], "role_overrides": {"A": "hub"}}}}))
    moved = arena.resolve(a, "v").regions[0]
    assert moved.vertices == ((15, 7), (35, 7), (35, 27), (15, 27)) and moved.role == "hub"
    with pytest.raises(ValueError):
        arena.parse('{"reference_shapes": {"regions": [{"name": "A"}]}}')


def test_alternation_and_preference(spark):
    seq = [r for r in ["A", "Hub", "B", "Hub", "C", "Hub", "A"] for _ in range(9)]
    v = bouts.rle(spark.createDataFrame([("s", i, r) for i, r in enumerate(seq)], "session_id string, frame bigint, label string")).withColumnRenamed("label", "region")
    r = arena.alternation(v, ["A", "B", "C"]).first()
    assert (r.n_arm_entries, r.spontaneous_alternation_pct) == (4, 100.0)
    t = arena.summary(v, 9.0)
    assert arena.preference(t, {"B": "paired", "X": "unpaired"}, "paired", "unpaired", "i").first().i == 1.0
    assert arena.preference(t, {"X": "paired", "B": "unpaired"}, "paired", "unpaired", "i").first().i == -1.0
    with pytest.raises(ValueError):
        arena.alternation(v, ["A", "B"])
    e = spark.createDataFrame([(1, "A")] * 10 + [(2, "A")] * 10 + [(2, "B")] * 10 + [(3, None)], "c int, r string")
    assert {x.c: x.entropy for x in arena.entropy(e, "c", "r").collect()} == {1: 0.0, 2: pytest.approx(1.0)}


def test_enrich(spark):
    bins = spark.createDataFrame([("s", i, float(i)) for i in range(20)], "session_id string, bin bigint, v double")
    r = enrich.bout_bins(b(spark, [(0, 0, 10), (1, 10, 20), (2, 90, 10), (3, 1000, 10)]), bins, 10, {"m": F.avg("v")}, 5).orderBy("start_frame").collect()
    assert [x.m for x in r] == [5.0, 6.5, 14.0, 19.0]
    pts = spark.createDataFrame([("s", i, float(i), 0.0, "clash") for i in range(100)], "session_id string, frame bigint, x double, y double, label string")
    d = enrich.directedness(b(spark, [(0, 0, 100)]), pts, 30.0).first()
    assert (d.straightness_ratio, d.net_displacement, d.path_length, d.heading_consistency) == (1.0, 99.0, 99.0, 1.0)
    assert d.mean_speed == pytest.approx(99 / (100 / 30))
    assert enrich.directedness(b(spark, [(0, 0, 3)]), pts, 30.0).first().straightness_ratio is None
    f = spark.createDataFrame([("f1", "cam_a_20240101_101010"), ("f2", "mouse1_track"), ("f3", "same"), ("f4", "none")], "path string, stem string")
    v = spark.createDataFrame([("v1", "other_20240101_101010"), ("v2", "mouse1"), ("v3", "same"), ("v4", "mouse")], "path string, stem string")
    assert {r.path: r.video for r in enrich.pair_files(f, v).collect()} == {"f1": "v1", "f2": "v2", "f3": "v3", "f4": None}


def test_published_statistics(spark):
    for u, p, delta in ((387.0, 0.8339, 0.0348), (311.0, 0.2944, -0.1684), (252.0, 0.0415, -0.3262), (508.0, 0.0251, 0.3583)):
        z = (abs(u - 22 * 34 / 2) - 0.5) / math.sqrt(22 * 34 * 57 / 12)
        got = spark.range(1).select(stats.two_sided(F.lit(z))).first()[0]
        assert got == pytest.approx(p, abs=6e-5) and 2 * u / (22 * 34) - 1 == pytest.approx(delta, abs=6e-5)


def test_agreement(spark):
    df = spark.createDataFrame([(0, 0), (0, 0), (1, 1), (1, 1), (2, 2)], "a int, b int")
    r = stats.agreement(df, "a", "b").first()
    assert (r.ari, r.kappa, r.balanced_accuracy) == (1.0, 1.0, 1.0)
    q = [r.q for r in stats.bh_fdr(spark.createDataFrame([(0.01,), (0.04,), (0.03,), (None,)], "p double"), "p").orderBy("p").collect()]
    assert q == [None, pytest.approx(0.03), pytest.approx(0.04), pytest.approx(0.04)]


def test_silhouette_plain(spark):
    rng = np.random.default_rng(1)
    x = np.r_[rng.normal(0, 1, (12, 3)), rng.normal(3, 1, (9, 3))]
    y = np.r_[np.zeros(12, int), np.ones(9, int)]
    d = ((x[:, None] - x) ** 2).sum(2)
    s = []
    for i in range(21):
        a = d[i, y == y[i]].sum() / ((y == y[i]).sum() - 1)
        c = d[i, y != y[i]].mean()
        s.append((c - a) / max(a, c))
    got = {r.l: r.silhouette for r in vectors.silhouette(spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(y, x)], "l int, v array<double>"), "l", "v", 3).collect()}
    assert got == {k: pytest.approx(np.mean([v for v, j in zip(s, y) if j == k])) for k in (0, 1)}


@pytest.mark.parametrize("shard", [5, 1000])
def test_viterbi_shards(spark, shard):
    rng = np.random.default_rng(2)
    obs = np.repeat(rng.integers(0, 3, 12), 6)
    obs[rng.choice(72, 12, replace=False)] = rng.integers(-1, 3, 12)
    model = {"start": np.ones(3) / 3, "trans": np.full((3, 3), 0.07) + np.eye(3) * 0.79, "emit": np.full((3, 3), 0.11) + np.eye(3) * 0.67}
    df = spark.createDataFrame([("s", i, int(o)) for i, o in enumerate(obs)], "session_id string, frame bigint, label int")
    got = [r.state for r in models.decode(df, model, shard=shard).orderBy("frame").collect()]
    score = lambda p: math.log(1 / 3) + sum(math.log(model["emit"][a, o]) for a, o in zip(p, obs) if o >= 0) + sum(math.log(model["trans"][a, c]) for a, c in zip(p, p[1:]))
    assert score(got) == pytest.approx(score(models.viterbi(obs, model).tolist()))


def test_models(spark):
    rng = np.random.default_rng(3)
    x = np.r_[rng.normal(0, 0.3, (40, 2)), rng.normal(4, 0.3, (40, 2)), [[20, 20]]]
    lab = models.density_tree(x, 10, 3)
    assert len(set(lab[:40])) == 1 and len(set(lab[40:80])) == 1 and lab[0] != lab[40] and lab[80] == -1
    a = rng.normal(size=(30, 3))
    rot = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    rot *= np.sign(np.linalg.det(rot))
    bb = 2.5 * a @ rot.T + [1, 2, 3]
    r = models.procrustes(spark.createDataFrame(np.c_[a, bb].tolist(), ["a_0", "a_1", "a_2", "b_0", "b_1", "b_2"]))
    assert r["scale"] == pytest.approx(2.5) and np.allclose(r["rotation"], rot) and np.allclose(r["shift"], [1, 2, 3])
    cams = {"c1": [[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0]], "c2": [[1, 0, 0, -1], [0, 1, 0, 0], [0, 0, 1, 0]]}
    view = [("s", 0, "n", c, float((np.array(m) @ [0.5, 0.2, 4, 1])[0] / 4), float((np.array(m) @ [0.5, 0.2, 4, 1])[1] / 4), 0.9) for c, m in cams.items()]
    t = models.triangulate(spark.createDataFrame(view, "session_id string, frame bigint, bodypart string, cam string, x double, y double, likelihood double"), cams).first()
    assert (t.x, t.y, t.z) == (pytest.approx(0.5), pytest.approx(0.2), pytest.approx(4.0))
    assert models.train_classifier(spark.createDataFrame([([1.0], 1), ([2.0], -1)], "v array<double>, l int"), "v", "l")[0] is None


def test_sources(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    for n in ("a_filtered.csv", "a.h5", "deep/b_filtered.h5", "BSOID_x.h5", "m.mp4", "deep/n.AVI"):
        (tmp_path / n).write_text("x")
    ls = files.listing(spark, str(tmp_path))
    assert [r.stem for r in files.pose_files(ls).collect()] == ["b_filtered"]
    assert sorted(r.stem for r in files.videos(ls).collect()) == ["m", "n"]
    csv = tmp_path / "t.csv"
    csv.write_text("scorer,S,S,S,S,S,S\nbodyparts,nose,nose,nose,tail,tail,tail\ncoords,x,y,likelihood,x,y,likelihood\n0,1.5,2,0.9,nan,,0.1\n1,2,3,0.8,1,1,1\n")
    rows = {(r.frame, r.bodypart): r for r in files.read_pose_csv(spark, str(csv), "s").collect()}
    assert rows[0, "nose"].x == 1.5 and rows[0, "tail"].x is None and rows[0, "tail"].y is None and rows[1, "tail"].likelihood == 1.0
    assert files.header(["individuals,m1,m2", "bodyparts,nose,nose", "coords,x,x"])[1] == [("m1_nose", "x"), ("m2_nose", "x")]
    with pytest.raises(ValueError):
        files.read_pose_csv(spark, "x.txt", "s")
    r = spark.createDataFrame([("p1", "cam1_A_corrected.mp4"), ("p2", "cam2_A_corrected.mp4"), ("p3", "cam1_B_corrected.mp4"), ("p4", "cam1_C_corrected.mp4")], "path string, name string")
    st = spark.createDataFrame([("C", "cam1", "done")], "session_id string, cam string, status string")
    assert sorted(x.session_id for x in files.recordings(r, st).collect()) == ["A", "C"]
    assert not files.write_if_any(r.limit(0), str(tmp_path / "o"))


def test_stream_windows(spark, tmp_path):
    from kinetrail.streaming import windows

    rows = [(f"2020-01-01 0{h}:10:00", "a" if h % 2 else "b") for h in range(6)]
    t = spark.createDataFrame(rows, "ts string, label string").withColumn("ts", F.col("ts").cast("timestamp"))
    t.write.parquet(str(tmp_path / "in"))
    s = windows.tumbling(windows.read(spark, str(tmp_path / "in"), "ts timestamp, label string"), "ts", "label", "3 hours")
    q = s.writeStream.format("memory").queryName("tumbled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select sum(n) from tumbled").first()[0] == 6


def test_feature_matrix_totals_are_those_of_the_packed_table(spark, data, monkeypatch):
    """One shuffle of readings, in shards of any size, against the long table of all blocks; no exchange holds a feature's name."""
    from kinetrail.operators import matrix as M
    from kinetrail.queries import matrix as Q

    old = M.packed(Q.matrix(spark, data)).select("session_id", "bin", F.size("features").alias("n"), F.aggregate(F.map_values("features"), F.lit(0.0), lambda a, v: a + v).alias("t"))
    old = {(r.session_id, r.bin): (r.n, r.t) for r in old.collect()}
    for shard in (1200, 20):
        monkeypatch.setattr(M, "SHARD_BINS", shard)
        got = Q.matrix_totals(spark, data)
        assert "feature" not in got._jdf.queryExecution().optimizedPlan().toString().replace("n_features", "")
        got = {(r.session_id, r.bin): (r.n_features, r.total) for r in got.collect()}
        assert got.keys() == old.keys()
        for k, (n, t) in old.items():
            assert got[k][0] == n and abs(got[k][1] - t) < 1e-6 * max(1, abs(t)), k
