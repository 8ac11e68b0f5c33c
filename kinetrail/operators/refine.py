"""Choosing, checking and refining clusters of vectors.

Fits run on the driver over a sample whose size is a parameter (``bound``, the rows of the smallest hash of their key); what they
find is applied to all rows in Spark, and what decides about a cluster (its silhouette, its regions, its centroid) is computed
over all of its rows. Tables of clusters, runs and groups are small. Rows: key, label (-1 is noise), vec.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinetrail.operators import stats as S
from kinetrail.operators import vectors as V
from kinetrail.operators.arena import composition, entropy
from kinetrail.operators.models import density_tree
from kinetrail.plans.runtime import cut

BOUND = 2000


def sample(rows: DataFrame, key: str, vec: str, bound: int = BOUND, seed: int = 42) -> tuple[list, np.ndarray]:
    """Keys and vectors of the ``bound`` rows of the smallest hash."""
    r = rows.where(F.col(vec).isNotNull() & F.col(key).isNotNull()).orderBy(F.xxhash64(F.lit(seed), key), key).select(key, vec).limit(bound).collect()
    return [x[key] for x in r], np.array([x[vec] for x in r], dtype=float)


def reach_edges(x: np.ndarray, samples: int) -> np.ndarray:
    """Edges (a, b, weight) of the minimum spanning tree of mutual reachability."""
    n = len(x)
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    d = np.maximum(d, np.maximum(core[:, None], core))
    best, near, todo = d[0].copy(), np.zeros(n, int), np.ones(n, bool)
    todo[0] = False
    out = []
    for _ in range(n - 1):
        at = int(np.where(todo, best, np.inf).argmin())
        out.append((near[at], at, best[at]))
        todo[at] = False
        closer = todo & (d[at] < best)
        best[closer], near[closer] = d[at][closer], at
    return np.array(out, dtype=float).reshape(-1, 3)


def validity(labels: np.ndarray, edges: np.ndarray) -> float:
    """Density validity of a clustering from the tree's edges: over all points, the mean of (separation - sparseness) / the larger of
    the two of their cluster, noise counting 0; NaN with fewer than two clusters."""
    names = sorted(set(labels.tolist()) - {-1})
    if len(names) < 2:
        return math.nan
    a, b, w = labels[edges[:, 0].astype(int)], labels[edges[:, 1].astype(int)], edges[:, 2]
    total = 0.0
    for c in names:
        inside, across = w[(a == c) & (b == c)], w[((a == c) ^ (b == c)) & (a != -1) & (b != -1)]
        sparse = inside.max() if len(inside) else 0.0
        apart = across.min() if len(across) else w.max()
        total += (labels == c).sum() * (apart - sparse) / max(apart, sparse, 1e-12)
    return float(total / len(labels))


def leaves(x: np.ndarray, least: int, samples: int) -> np.ndarray:
    """Density clusters at the leaves of the tree: clusters that split no further into ones of ``least`` members."""
    edges = reach_edges(x, samples)
    labels = np.full(len(x), -1)
    number = 0
    todo = [(np.arange(len(x)), edges)]
    while todo:
        at, e = todo.pop()
        e = e[np.argsort(-e[:, 2], kind="stable")]
        split = None
        for k in range(len(e)):
            parts = _parts(at, e[k + 1 :])
            big = [p for p in parts if len(p) >= least]
            if len(big) > 1:
                split = [(p, e[k + 1 :][np.isin(e[k + 1 :, 0], p)]) for p in big]
                break
            if not big or sum(map(len, parts)) - len(big[0]) > len(at) - least:
                break
        if split:
            todo += split
        elif len(at) >= least:
            labels[at] = number
            number += 1
    return labels


def _parts(nodes: np.ndarray, edges: np.ndarray) -> list[np.ndarray]:
    low = {int(n): int(n) for n in nodes}

    def root(i: int) -> int:
        while low[i] != i:
            low[i] = low[low[i]]
            i = low[i]
        return i

    for a, b, _ in edges:
        x, y = root(int(a)), root(int(b))
        low[max(x, y)] = min(x, y)
    groups: dict[int, list[int]] = {}
    for n in low:
        groups.setdefault(root(n), []).append(n)
    return [np.array(g) for g in groups.values()]


def plain_silhouette(x: np.ndarray, labels: np.ndarray) -> float:
    use = labels >= 0
    names = sorted(set(labels[use].tolist()))
    if len(names) < 2:
        return math.nan
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))
    mean = np.array([d[:, labels == c].sum(1) / max(1, (labels == c).sum()) for c in names])
    out = []
    for k, c in enumerate(names):
        n = (labels == c).sum()
        a = mean[k, labels == c] * n / max(1, n - 1)
        b = np.delete(mean, k, 0)[:, labels == c].min(0)
        out += ((b - a) / np.maximum(np.maximum(a, b), 1e-12) if n > 1 else np.zeros(1)).tolist()
    return float(np.mean(out))


#: The bonus of leaf selection and the penalty of each cluster beyond the wanted range.
LEAF_BONUS, OVER_PENALTY = 0.03, 0.01


def sweep(x: np.ndarray, shares: tuple[float, ...] = (0.01, 0.02, 0.04, 0.08), *, mode: str = "legacy", lo: int = 2, hi: int = 40, target: int | None = None) -> list[dict]:
    """Density clusterings over smallest sizes (shares of the sample) and both selections, scored by validity or, where that is
    undefined, the silhouette; best first. ``floor_soft_cap`` drops those below ``lo`` clusters and takes a penalty for each
    beyond ``hi``; ``target`` prefers the nearest number of clusters."""
    out = []
    for share in shares:
        least = max(5, int(round(share * len(x))))
        samples = max(1, least // 5)
        edges = reach_edges(x, samples)
        for kind in ("eom", "leaf"):
            labels = density_tree(x, least, samples) if kind == "eom" else leaves(x, least, samples)
            k = len(set(labels.tolist()) - {-1})
            score = validity(labels, edges)
            name = "validity"
            if math.isnan(score):
                score, name = plain_silhouette(x, labels), "silhouette"
            if math.isnan(score) or mode == "floor_soft_cap" and k < lo:
                continue
            rank = score + (LEAF_BONUS if kind == "leaf" else 0.0) - (OVER_PENALTY * max(0, k - hi) if mode == "floor_soft_cap" else 0.0)
            out.append({"least": least, "kind": kind, "n_clusters": k, "score": score, "score_kind": name, "rank": rank, "labels": labels})
    return sorted(out, key=lambda r: (abs(r["n_clusters"] - target) if target else 0, -r["rank"], r["least"], r["kind"]))


def nearest_centre(vec: str, centres: np.ndarray) -> Column:
    """Number of the nearest of a few centres."""
    d = F.array(*[F.struct(V.sq(F.col(vec), F.array(*[F.lit(float(v)) for v in c])).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(centres)])
    return F.array_min(d)["k"]


def _split(rows: DataFrame, key: str, label: str, vec: str, candidates: list, least: int, parts: int, bound: int) -> DataFrame:
    """Each candidate cluster divided by the density clusters of its own sample, when there are two to ``parts`` of them."""
    if not candidates:
        return rows
    top = rows.agg(F.max(label)).first()[0]
    new = F.col(label)
    for c in candidates:
        _, x = sample(rows.where(F.col(label) == c), key, vec, bound)
        small = max(5, min(least, len(x)) // (2 * parts))
        found = density_tree(x, small, max(1, small // 5))
        names = sorted(set(found.tolist()) - {-1})
        if 2 <= len(names) <= parts:
            centres = np.array([x[found == k].mean(0) for k in names])
            k = nearest_centre(vec, centres)
            new = F.when(F.col(label) == c, F.when(k == 0, F.lit(c)).otherwise(k + top)).otherwise(new)
            top += len(names) - 1
    return cut(rows.withColumn(label, new.cast("bigint")))


def split_impure(rows: DataFrame, key: str, label: str, vec: str, dims: int, *, threshold: float | None = 0.2, least: int = 250, parts: int = 3, most: int = 10, bound: int = BOUND) -> DataFrame:
    """Clusters of a mean silhouette below ``threshold`` and ``least`` members divided, the ``most`` worst first. No threshold: no change."""
    if not threshold:
        return rows
    s = V.silhouette(rows.where(F.col(label) >= 0), label, vec, dims)
    c = [r[label] for r in s.where((F.col("silhouette") < threshold) & (F.col("n") >= least)).orderBy("silhouette", label).limit(most).collect()]
    return _split(rows, key, label, vec, c, least, parts, bound)


def split_regions(rows: DataFrame, key: str, label: str, vec: str, region: str | None, *, enabled: bool = True, threshold: float = 0.5, minority: float = 0.15, least: int = 20, parts: int = 3, most: int = 10, bound: int = BOUND) -> DataFrame:
    """Clusters spread over regions (entropy from ``threshold`` on, every region with ``minority`` of the rows) divided by their vectors,
    the most mixed first. Switched off, or without a region column: no change."""
    if not enabled or region is None or region not in rows.columns:
        return rows
    own = rows.where(F.col(label) >= 0)
    e = entropy(own, label, region).where((F.col("entropy") >= threshold) & (F.col("k") > 1))
    m = composition(own, label, region).groupBy(label).agg(F.min("share").alias("least_share"))
    c = [r[label] for r in e.join(m, label).where(F.col("least_share") >= minority).orderBy(F.desc("entropy"), label).limit(most).collect()]
    return _split(rows, key, label, vec, c, least, parts, bound)


def _union(names: list, pairs: list[tuple]) -> dict:
    low = {n: n for n in names}
    for a, b in pairs:
        while low[a] != a:
            a = low[a]
        while low[b] != b:
            b = low[b]
        low[max(a, b)] = min(a, b)
    for n in names:
        r = n
        while low[r] != r:
            r = low[r]
        low[n] = r
    return low


def _relabel(rows: DataFrame, label: str, to: dict) -> DataFrame:
    moved = {a: b for a, b in to.items() if a != b}
    if not moved:
        return rows
    m = F.create_map(*[F.lit(x) for p in moved.items() for x in p])
    return rows.withColumn(label, F.coalesce(F.element_at(m, F.col(label)), F.col(label)).cast("bigint"))


def merge_similar(rows: DataFrame, label: str, vec: str, dims: int, threshold: float, *, region: str | None = None, minority: float = 0.15) -> DataFrame:
    """Clusters whose centroids are within ``threshold`` times the mean distance of centroids joined, nearest first. 0: no change. A
    join that would mix two regions is refused: the main region of both must be the same, where regions are given."""
    if not threshold:
        return rows
    own = rows.where(F.col(label) >= 0)
    c = {r[label]: np.array(r["centroid"]) for r in V.centroids(own, label, vec, dims).collect()}
    names = sorted(c)
    main: dict = {}
    if region and region in rows.columns:
        top = composition(own, label, region).where(F.col("share") > 1 - minority)
        main = {r[label]: r[region] for r in top.collect()}
    d = {(a, b): float(np.linalg.norm(c[a] - c[b])) for a, b in itertools.combinations(names, 2)}
    if not d:
        return rows
    mean = sum(d.values()) / len(d)
    pairs = [p for p, v in sorted(d.items(), key=lambda t: (t[1], t[0])) if v <= threshold * mean and (not main or main.get(p[0]) == main.get(p[1]))]
    return _relabel(rows, label, _union(names, pairs))


def merge_coassociated(rows: DataFrame, key: str, label: str, runs: DataFrame, runs_n: int, threshold: float) -> DataFrame:
    """Clusters of which two members share a cluster in ``threshold`` of the runs or more, on average, joined. ``runs``: run, cluster, item.
    From counts of each cluster in the runs' clusters; no pairs of members are formed. 0: no change."""
    if not threshold:
        return rows
    own = rows.where(F.col(label) >= 0).select(F.col(key).alias("item"), F.col(label).alias("l"))
    h = own.join(runs, "item").groupBy("l", "run", "cluster").agg(F.count("*").alias("n"))
    sizes = {r["l"]: r["n"] for r in own.groupBy("l").agg(F.count("*").alias("n")).collect()}
    a, b = h.select(F.col("l").alias("a"), "run", "cluster", F.col("n").alias("na")), h.select(F.col("l").alias("b"), "run", "cluster", F.col("n").alias("nb"))
    both = a.join(b, ["run", "cluster"]).where("a < b").groupBy("a", "b").agg(F.sum(F.col("na") * F.col("nb")).alias("n")).collect()  # pairs of clusters
    pairs = [(r["a"], r["b"]) for r in both if r["n"] / (sizes[r["a"]] * sizes[r["b"]] * runs_n) >= threshold]
    return _relabel(rows, label, _union(sorted(sizes), pairs))


def refine(rows: DataFrame, key: str, label: str, vec: str, dims: int, *, region: str | None = None, iterations: int = 3, silhouette: float | None = 0.2, merge: float = 0.0, least: int = 250, bound: int = BOUND) -> DataFrame:
    """Split by silhouette, split by region, merge, again until nothing changes or so many times; then one more look at the regions,
    with no merge after it."""
    state = lambda r: r.agg(F.sum(F.xxhash64(key, label).cast("decimal(38,0)"))).first()[0]
    rows = cut(rows)
    before = state(rows)
    for _ in range(iterations):
        rows = split_impure(rows, key, label, vec, dims, threshold=silhouette, least=least, bound=bound)
        rows = split_regions(rows, key, label, vec, region, bound=bound)
        rows = cut(merge_similar(rows, label, vec, dims, merge, region=region))
        now = state(rows)
        if now == before:
            break
        before = now
    return split_regions(rows, key, label, vec, region, bound=bound)


def seed_runs(rows: DataFrame, key: str, vec: str, seeds: int, *, share: float = 0.3, bound: int = BOUND, part: float = 0.03) -> DataFrame:
    """Density clusterings of one shared sample, each of a share of it drawn anew and carried to the whole sample by the nearest
    centre: run, item, cluster. Fewer than two seeds: no rows."""
    kind = dict(rows.dtypes)[key]
    ids, x = sample(rows, key, vec, bound)
    out = []
    for s in range(seeds if seeds > 1 else 0):
        at = np.sort(np.random.default_rng(42 + s).choice(len(x), max(10, int(share * len(x))), replace=False)) if len(x) > 10 else np.arange(len(x))
        least = max(5, int(part * len(at)))
        found = density_tree(x[at], least, max(1, least // 5))
        names = sorted(set(found.tolist()) - {-1})
        centres = np.array([x[at][found == k].mean(0) for k in names]) if names else np.zeros((1, x.shape[1] if x.ndim == 2 else 0))
        near = ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)
        out += [(s, i, int(c)) for i, c in zip(ids, near, strict=True)]
    return rows.sparkSession.createDataFrame(out, f"run int, item {kind}, cluster int")


def stability(runs: DataFrame) -> DataFrame:
    """Adjusted Rand index of every two runs: run_a, run_b, ari; from the contingency tables of all pairs at once."""
    a, b = runs.select("item", F.col("run").alias("run_a"), F.col("cluster").alias("a")), runs.select("item", F.col("run").alias("run_b"), F.col("cluster").alias("b"))
    c = a.join(b, "item").where("run_a < run_b").groupBy("run_a", "run_b", "a", "b").agg(F.count("*").alias("n"))
    two = lambda n: F.sum(F.col(n) * (F.col(n) - 1) / 2)
    keys = ["run_a", "run_b"]
    i = c.groupBy(*keys, "a").agg(F.sum("n").alias("r")).groupBy(*keys).agg(two("r").alias("i"), F.sum("r").alias("n"))
    j = c.groupBy(*keys, "b").agg(F.sum("n").alias("r")).groupBy(*keys).agg(two("r").alias("j"))
    s = c.groupBy(*keys).agg(two("n").alias("ij")).join(i, keys).join(j, keys)
    want = F.col("i") * F.col("j") / (F.col("n") * (F.col("n") - 1) / 2)
    return s.select(*keys, F.try_divide(F.col("ij") - want, (F.col("i") + F.col("j")) / 2 - want).alias("ari"))


def linkage(d: np.ndarray, method: str = "average", size: np.ndarray | None = None) -> np.ndarray:
    """Rows (a, b, height, members) of agglomerative clustering of a distance matrix; ward, average or complete. New clusters are numbered
    from n on."""
    n = len(d)
    d = (d.astype(float) ** 2 if method == "ward" else d.astype(float)).copy()
    np.fill_diagonal(d, np.inf)
    names, w, out = list(range(n)), np.ones(n) if size is None else size.astype(float), []
    for k in range(n - 1):
        i, j = divmod(int(d.argmin()), len(d))
        i, j = min(i, j), max(i, j)
        h = d[i, j]
        out.append((min(names[i], names[j]), max(names[i], names[j]), math.sqrt(max(h, 0)) if method == "ward" else h, w[i] + w[j]))
        if method == "ward":
            new = ((w[i] + w) * d[i] + (w[j] + w) * d[j] - w * h) / (w[i] + w[j] + w)
        elif method == "average":
            new = (w[i] * d[i] + w[j] * d[j]) / (w[i] + w[j])
        else:
            new = np.maximum(d[i], d[j])
        d[i], d[:, i] = new, new
        d[i, i] = np.inf
        d = np.delete(np.delete(d, j, 0), j, 1)
        w[i] += w[j]
        w = np.delete(w, j)
        names[i] = n + k
        del names[j]
    return np.array(out).reshape(-1, 4)


def cut_tree(tree: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels 0.. of n items when the tree is cut to k clusters."""
    of = {i: [i] for i in range(n)}
    for s in range(max(0, n - k)):
        a, b = int(tree[s, 0]), int(tree[s, 1])
        of[n + s] = of.pop(a) + of.pop(b)
    labels = np.zeros(n, int)
    for c, m in enumerate(sorted(of.values(), key=min)):
        labels[m] = c
    return labels


def cophenetic(tree: np.ndarray, d: np.ndarray) -> float:
    """Correlation of the distances with the heights at which pairs meet."""
    n = len(d)
    of, high = {i: [i] for i in range(n)}, np.zeros((n, n))
    for s, (a, b, h, _) in enumerate(tree):
        x, y = of.pop(int(a)), of.pop(int(b))
        high[np.ix_(x, y)] = h
        high[np.ix_(y, x)] = h
        of[n + s] = x + y
    up = np.triu_indices(n, 1)
    return float(np.corrcoef(high[up], d[up])[0, 1]) if n > 2 else math.nan


def hierarchy(rows: DataFrame, label: str, vec: str, dims: int, method: str = "ward") -> DataFrame:
    """The linkage of the clusters' centroids: step, a, b, height, members."""
    c = V.centroids(rows.where(F.col(label) >= 0), label, vec, dims).orderBy(label).collect()
    x = np.array([r["centroid"] for r in c])
    tree = linkage(np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)), method) if len(x) > 1 else np.zeros((0, 4))
    return rows.sparkSession.createDataFrame([(i, int(a), int(b), float(h), int(m)) for i, (a, b, h, m) in enumerate(tree)], "step int, a int, b int, height double, members int")


def consensus(runs: DataFrame, runs_n: int, k: int, *, most_gb: float = 1.0) -> DataFrame:
    """item, cluster: Ward clusters of the co-association of the runs, on groups of items with equal labels in all runs. Refused before
    any work when the matrix of the groups would take more than ``most_gb``."""
    sig = runs.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("run", "cluster"))).alias("s"))
    groups = cut(sig.groupBy("s").agg(F.min("item").alias("g"), F.count("*").alias("n")))
    n = groups.count()
    if n * n * 8 / 1e9 > most_gb:
        raise MemoryError(f"{n} groups of labels need {n * n * 8 / 1e9:.1f} GB")
    pairs = S.coassociation(runs, runs_n).collect()  # pairs of groups, bounded above
    names = sorted({r["sig_a"] for r in pairs} | {r["sig_b"] for r in pairs})
    at = {g: i for i, g in enumerate(names)}
    d = np.ones((len(names), len(names)))
    size = np.ones(len(names))
    for r in pairs:
        d[at[r["sig_a"]], at[r["sig_b"]]] = d[at[r["sig_b"]], at[r["sig_a"]]] = 1 - r["share"]
        size[at[r["sig_a"]]], size[at[r["sig_b"]]] = r["size_a"], r["size_b"]
    labels = cut_tree(linkage(d, "ward", size), len(names), min(k, len(names)))
    kind = dict(runs.dtypes)["item"]
    of = runs.sparkSession.createDataFrame([(g, int(labels[i])) for g, i in at.items()], f"g {kind}, cluster int")
    return sig.join(groups, "s").join(F.broadcast(of), "g").select("item", "cluster")


def assignment(cost: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one pairs of the least total cost (shortest augmenting paths); the smaller side is matched whole."""
    flip = cost.shape[0] > cost.shape[1]
    c = cost.T if flip else cost
    n, m = c.shape
    u, v, of = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        of[0], j = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while of[j]:
            used[j] = True
            free = np.flatnonzero(~used[1:]) + 1
            r = c[of[j] - 1, free - 1] - u[of[j]] - v[free]
            better = r < least[free]
            least[free[better]], way[free[better]] = r[better], j
            k = free[least[free].argmin()]
            delta = least[k]
            u[of[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j = int(k)
        while j:
            of[j] = of[way[j]]
            j = way[j]
    pairs = [(of[j] - 1, j - 1) for j in range(1, m + 1) if of[j]]
    return sorted((b, a) if flip else (int(a), int(b)) for a, b in pairs)


def matched_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """Clusters of two labellings paired one to one for the largest total Jaccard: a, b, jaccard."""
    c = S.contingency(df, a, b).collect()  # clusters times clusters
    ra, cb = {}, {}
    for r in c:
        ra[r["a"]], cb[r["b"]] = ra.get(r["a"], 0) + r["n"], cb.get(r["b"], 0) + r["n"]
    xs, ys = sorted(ra), sorted(cb)
    j = np.zeros((len(xs), len(ys)))
    for r in c:
        j[xs.index(r["a"]), ys.index(r["b"])] = r["n"] / (ra[r["a"]] + cb[r["b"]] - r["n"])
    types = dict(df.dtypes)
    return df.sparkSession.createDataFrame([(xs[i], ys[k], float(j[i, k])) for i, k in (assignment(-j) if len(xs) else [])], f"a {types[a]}, b {types[b]}, jaccard double")


def recombination(change: dict, transitions: dict, names: list, share: float = 0.7, veto: dict | None = None, most: float = math.inf) -> np.ndarray:
    """Distance of clusters: ``share`` of the distance of their patterns of change (1 - correlation, halved) and the rest of the cosine
    distance of their transitions; pairs whose postures are farther apart than ``most`` are never joined."""

    def one(d: dict, corr: bool) -> np.ndarray:
        x = np.array([d[n] for n in names], dtype=float)
        x = x - x.mean(1, keepdims=True) if corr else x
        l = np.maximum(np.linalg.norm(x, axis=1), 1e-12)
        return (1 - (x @ x.T) / np.outer(l, l)) / (2 if corr else 1)

    d = share * one(change, True) + (1 - share) * one(transitions, False)
    if veto is not None:
        p = np.array([veto[n] for n in names], dtype=float)
        d[np.sqrt(((p[:, None] - p[None]) ** 2).sum(2)) > most] = 1e6
    np.fill_diagonal(d, 0)
    return np.maximum(d, 0)
