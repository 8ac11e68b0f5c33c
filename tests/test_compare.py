"""Tail probabilities against published table values, comparisons on small groups, refinement of clusters on plain blobs."""

import math

import numpy as np
import pytest
from kinetrail.functions import tails
from kinetrail.operators import arena, compare, refine


def test_tails_against_tables():
    assert math.isclose(2 * tails.normal_sf(1.959963985), 0.05, rel_tol=1e-8)
    assert math.isclose(tails.t_two_sided(2.228138852, 10), 0.05, rel_tol=1e-7)
    assert math.isclose(tails.f_sf(3.325834529, 5, 10), 0.05, rel_tol=1e-6)
    assert math.isclose(tails.chi2_sf(7.814727903, 3), 0.05, rel_tol=1e-7)
    assert math.isclose(tails.kolmogorov_sf(1.358098, ), 0.05, rel_tol=1e-3)
    assert tails.signed_rank_exact(6, 0) == 2 / 64
    w, p = tails.shapiro_wilk(np.array([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236.0]))
    assert abs(w - 0.79) < 0.01 and abs(p - 0.0067) < 0.002  # the example of the original paper
    assert math.isnan(tails.shapiro_wilk(np.ones(5))[0])


def test_one_sample_rules(spark):
    rows = [("far", v) for v in (0.30, 0.32, 0.28, 0.31, 0.29, 0.33)] + [("at", v) for v in (0.01, -0.02, 0.015, -0.01, 0.005, -0.005)] + [("solo", 0.5), ("flat", 0.5), ("flat", 0.5), ("far", None), (None, 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    r = {x.exp_group: x for x in compare.one_sample(df, "g", "v", 0.0).collect()}
    assert r["far"].qval < 0.001 and r["far"].n == 6 and r["at"].pval > 0.3
    assert r["solo"].pval == 1.0 and r["solo"].effect_size_cohens_d is None and r["flat"].effect_size_cohens_d is None
    k = {x.exp_group: x for x in compare.one_sample(df, "g", "v", 0.5, ranks=True).collect()}
    assert k["flat"].stat == 0 and k["flat"].pval == 1.0 and k["far"].pval == 2 / 64
    assert compare.one_sample(df.limit(0), "g", "v", 0.0).count() == 0


def test_comparison_drops_small_groups(spark):
    rows = [("a", float(i)) for i in range(8)] + [("b", float(i) + 20) for i in range(8)] + [("c", 1.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    p = compare.pairwise_p(compare.pairwise(df, "g", "v")).collect()
    assert len(p) == 1 and p[0].cliffs_delta == -1 and p[0].mannwhitney_p < 0.001 and p[0].stars == "***"
    o = compare.omnibus(df, "g", "v").first()
    assert o.omnibus_name == "mann_whitney_u" and o.n_dropped == 1 and o.ok
    assert not compare.omnibus(df.where("g = 'c'"), "g", "v").first().ok
    assert compare.pairwise(df.limit(0), "g", "v").count() == 0


def test_arena_of_a_session():
    sq = [[0, 0], [10, 0], [10, 10], [0, 10]]
    text = '{"paradigm": "open_field", "reference_shapes": {"boundary": {"name": "B", "vertices": %s}, "regions": [{"name": "R", "vertices": %s, "role": "arm"}], "objects": []}, "per_video": {"m": {"mode": "transform", "translate": [5, -3]}, "o": {"mode": "override", "shapes": {"regions": [{"name": "X", "vertices": %s}]}}}}' % (sq, sq, sq)
    a = arena.parse(text)
    m = arena.resolve(a, "m")
    assert m.boundary.vertices[0] == (5.0, -3.0) == m.regions[0].vertices[0] and m.regions[0].role == "arm"
    o = arena.resolve(a, "o")
    assert o.boundary is None and [s.name for s in o.regions] == ["X"] and arena.resolve(a, "other") == arena.Arena(a.paradigm, a.boundary, a.regions, a.objects)
    assert arena.resolve(None, "x").regions == ()


def blobs(rng, at, n):
    return np.concatenate([rng.normal(c, 0.3, (n, 2)) for c in at])


def test_validity_linkage_assignment():
    rng = np.random.default_rng(2)
    x = blobs(rng, [(0, 0), (6, 0), (0, 6)], 40)
    labels = np.repeat([0, 1, 2], 40)
    edges = refine.reach_edges(x, 4)
    assert len(edges) == 119 and refine.validity(labels, edges) > 0.7 > refine.validity(rng.integers(0, 3, 120), edges)
    assert math.isnan(refine.validity(np.zeros(120, int), edges))
    best = refine.sweep(x)[0]
    assert best["n_clusters"] == 3
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    for method in ("ward", "average", "complete"):
        tree = refine.linkage(d, method)
        assert len({tuple(refine.cut_tree(tree, 120, 3)[k * 40 : k * 40 + 40]) for k in range(3)}) == 3 and refine.cophenetic(tree, d) > 0.8
    cost = rng.random((5, 7))
    from itertools import permutations

    want = min(sum(cost[i, p[i]] for i in range(5)) for p in permutations(range(7), 5))
    assert math.isclose(sum(cost[i, j] for i, j in refine.assignment(cost)), want) and math.isclose(sum(cost.T[i, j] for i, j in refine.assignment(cost.T)), want)


def test_refinement_splits_and_merges(spark):
    rng = np.random.default_rng(3)
    x = blobs(rng, [(0, 0), (2.5, 0), (20, 20), (20.4, 20)], 60)
    label = np.repeat([0, 0, 1, 2], 60)
    region = ["a" if i < 60 else "b" if i < 120 else "c" for i in range(240)]
    rows = spark.createDataFrame([(i, int(label[i]), x[i].tolist(), region[i]) for i in range(240)], "id bigint, label bigint, vec array<double>, region string")
    of = lambda df: {r.id: r.label for r in df.collect()}
    for off in ({"region": None}, {"region": "no such"}, {"region": "region", "enabled": False}):
        assert of(refine.split_regions(rows, "id", "label", "vec", **off)) == of(rows)
    assert of(refine.split_impure(rows, "id", "label", "vec", 2, threshold=None)) == of(rows) == of(refine.merge_similar(rows, "label", "vec", 2, 0.0))
    s = of(refine.split_regions(rows, "id", "label", "vec", "region"))
    assert len({s[i] for i in range(120)}) == 2 and {s[i] for i in range(60)}.isdisjoint({s[i] for i in range(60, 120)}) and s[130] == 1
    m = of(refine.refine(rows, "id", "label", "vec", 2, region="region", merge=0.1, silhouette=None))
    assert m[130] == m[200] and m[0] != m[100]
    with pytest.raises(MemoryError):
        refine.consensus(rows.select("id", "label").selectExpr("0 as run", "id as item", "id as cluster"), 1, 2, most_gb=1e-9)
