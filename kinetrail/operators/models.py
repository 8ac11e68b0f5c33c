"""Models on features and labels: reduction, classification, hidden Markov smoothing, density clusters of a sample, alignment.

Training on all rows runs in Spark; what is fitted on a sample has the sample's size as a parameter. Sequences are decoded
exactly in shards: a shard is summarised by its max-plus transfer matrix, the borders' states are found from the few matrices
of a session, and each shard is decoded between them, so that one long session is no single task.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrail.plans.runtime import cut

NEVER = -1e30


def reduce_features(rows: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """Standardised principal components: key, vec array<double>. Rows without a vector are left out; k is cut to its width."""
    r = rows.where(F.col(vec).isNotNull()).select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("_v"))
    width = r.select(F.size(vector_to_array("_v")).alias("n")).first()
    if width is None:
        return rows.select(key, F.lit(None).cast("array<double>").alias(vec)).limit(0)
    steps = [StandardScaler(inputCol="_v", outputCol="_s", withMean=True), PCA(inputCol="_s", outputCol="_p", k=min(k, width["n"]))]
    return Pipeline(stages=steps).fit(r).transform(r).select(key, vector_to_array("_p").alias(vec))


def train_classifier(rows: DataFrame, vec: str, label: str, hidden: tuple[int, ...] = (100, 50), *, iterations: int = 100, seed: int = 42):
    """A perceptron on the rows whose label is not -1, and the sorted labels; None with fewer than two classes."""
    r = rows.where(F.col(label).isNotNull() & (F.col(label) != -1) & F.col(vec).isNotNull())
    classes = sorted(x[0] for x in r.select(label).distinct().collect())  # as many as there are clusters
    if len(classes) < 2:
        return None, classes
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("double") - 1
    t = r.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"), at.alias("label"))
    width = len(t.first()["features"])
    return MultilayerPerceptronClassifier(layers=[width, *hidden, len(classes)], maxIter=iterations, seed=seed).fit(t), classes


def predict(model, classes: list, rows: DataFrame, key: str, vec: str, least: float = 0.0) -> DataFrame:
    """key, label, confidence; -1 where the best class is below ``least``."""
    t = rows.where(F.col(vec).isNotNull()).select(key, array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"))
    p = model.transform(t).select(key, F.col("prediction").cast("int").alias("_c"), F.array_max(vector_to_array("probability")).alias("confidence"))
    names = F.array(*[F.lit(c) for c in classes])
    return p.select(key, F.when(F.col("confidence") >= least, F.get(names, F.col("_c"))).otherwise(-1).alias("label"), "confidence")


def train_hmm(frames: DataFrame, n_labels: int, n_states: int | None = None, *, shard: int = 4096) -> dict:
    """A categorical model by counts: the labels' transitions, with a sticky prior of one pseudo count, and an
    emission that gives a state's own label ``0.9`` where states are labels. ``frames``: session_id, frame, label from 0. Transitions are counted within shards; the first and
    last label of each shard give those across its borders."""
    n_states = n_states or n_labels
    from pyspark.sql import Window as W

    f = frames.where("label >= 0").withColumn("_s", F.floor(F.col("frame") / shard))
    w = W.partitionBy("session_id", "_s").orderBy("frame")
    inside = f.select("label", F.lead("label").over(w).alias("to"))
    ends = f.groupBy("session_id", "_s").agg(F.min_by("label", "frame").alias("first"), F.max_by("label", "frame").alias("last"))
    across = ends.select(F.col("last").alias("label"), F.lead("first").over(W.partitionBy("session_id").orderBy("_s")).alias("to"))
    c = inside.unionByName(across).where("to is not null").groupBy("label", "to").agg(F.count("*").alias("n")).collect()  # states squared
    a = np.ones((n_states, n_states))
    for r in c:
        a[r["label"] % n_states, r["to"] % n_states] += r["n"]
    start = np.ones(n_states)
    for r in f.where("frame = 0").groupBy("label").agg(F.count("*").alias("n")).collect():
        start[r["label"] % n_states] += r["n"]
    emit = np.full((n_states, n_labels), 0.1 / max(1, n_labels - 1))
    for s in range(n_states):
        emit[s, s % n_labels] = 0.9
    return {"start": start / start.sum(), "trans": a / a.sum(1, keepdims=True), "emit": emit / emit.sum(1, keepdims=True)}


def viterbi(obs: np.ndarray, model: dict, first: int | None = None, last: int | None = None, before: bool = False) -> np.ndarray:
    """Most likely states. With ``before`` the observations follow state ``first``; ``last`` fixes the final state."""
    la, le = np.log(np.maximum(model["trans"], 1e-300)), np.log(np.maximum(model["emit"], 1e-300))
    n, s = len(obs), len(la)
    emit = lambda o: le[:, o] if o >= 0 else np.zeros(s)
    v = (la[first] if before else np.log(np.maximum(model["start"], 1e-300))) + emit(obs[0])
    back = np.zeros((n, s), dtype=np.int32)
    for t in range(1, n):
        m = v[:, None] + la
        back[t] = m.argmax(0)
        v = m.max(0) + emit(obs[t])
    path = np.zeros(n, dtype=np.int64)
    path[-1] = int(v.argmax()) if last is None else last
    for t in range(n - 1, 0, -1):
        path[t - 1] = back[t, path[t]]
    return path


def decode(frames: DataFrame, model: dict, *, shard: int = 4096) -> DataFrame:
    """session_id, frame, label, state of every frame with a label; -1 is unknown and lets the transitions decide. The same
    path as an unsharded decoding (ties: the smallest state)."""
    f = frames.where("label is not null").select("session_id", "frame", "label", F.floor(F.col("frame") / shard).alias("_s"))
    la, le = np.log(np.maximum(model["trans"], 1e-300)), np.log(np.maximum(model["emit"], 1e-300))
    start, s = np.log(np.maximum(model["start"], 1e-300)), len(la)

    def transfer(pdf: pd.DataFrame) -> pd.DataFrame:
        obs = pdf.sort_values("frame")["label"].to_numpy()
        t = la + (le[:, obs[0]] if obs[0] >= 0 else 0)
        for o in obs[1:]:
            t = (t[:, :, None] + la[None]).max(1) + (le[:, o] if o >= 0 else 0)
        e = start + (le[:, obs[0]] if obs[0] >= 0 else 0)
        for o in obs[1:]:
            e = (e[:, None] + la).max(0) + (le[:, o] if o >= 0 else 0)
        return pd.DataFrame({"session_id": pdf["session_id"].iloc[:1], "_s": pdf["_s"].iloc[:1], "t": [t.ravel().tolist()], "e": [e.tolist()]})

    kind = dict(frames.dtypes)["session_id"]
    sums = f.groupBy("session_id", "_s").applyInPandas(transfer, f"session_id {kind}, _s bigint, t array<double>, e array<double>")

    def borders(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        v = [np.array(pdf["e"].iloc[0])]
        ts = [np.array(x).reshape(s, s) for x in pdf["t"]]
        for t in ts[1:]:
            v.append((v[-1][:, None] + t).max(0))
        end = [int(v[-1].argmax())]
        for k in range(len(ts) - 1, 0, -1):
            end.append(int((v[k - 1] + ts[k][:, end[-1]]).argmax()))
        end = end[::-1]
        return pd.DataFrame({"session_id": pdf["session_id"], "_s": pdf["_s"], "from_state": [-1, *end[:-1]], "to_state": end})

    at = sums.groupBy("session_id").applyInPandas(borders, f"session_id {kind}, _s bigint, from_state int, to_state int")

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("frame")
        a, b = int(pdf["from_state"].iloc[0]), int(pdf["to_state"].iloc[0])
        return pdf[["session_id", "frame", "label"]].assign(state=viterbi(pdf["label"].to_numpy(), model, a if a >= 0 else None, b, before=a >= 0))

    return f.join(cut(at), ["session_id", "_s"]).groupBy("session_id", "_s").applyInPandas(path, f"session_id {kind}, frame bigint, label int, state bigint")


def density_tree(x: np.ndarray, least: int, samples: int) -> np.ndarray:
    """Labels of a bounded sample by hierarchical density clusters: a minimum spanning tree of mutual reachability, condensed to
    clusters of ``least`` members, of which the most persistent are chosen; -1 is noise."""
    n = len(x)
    if n < max(2, least):
        return np.full(n, -1)
    d = np.sqrt(np.maximum(0, (x**2).sum(1)[:, None] + (x**2).sum(1) - 2 * x @ x.T))
    core = np.sort(d, axis=1)[:, min(samples, n - 1)]
    reach = np.maximum(d, np.maximum(core[:, None], core))
    best, near, todo, edges = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool), []
    at = 0
    todo[0] = False
    for _ in range(n - 1):
        closer = todo & (reach[at] < best)
        best[closer], near[closer] = reach[at][closer], at
        at = int(np.where(todo, best, np.inf).argmin())
        edges.append((best[at], near[at], at))
        todo[at] = False
    edges.sort()
    parent, members = list(range(2 * n - 1)), {i: [i] for i in range(n)}
    kids: dict[int, tuple[int, int, float]] = {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for k, (w, a, b) in enumerate(edges):
        a, b, new = root(a), root(b), n + k
        members[new] = members[a] + members[b]
        kids[new] = (a, b, w)
        parent[a] = parent[b] = new
    stability: dict[int, float] = {}
    chosen: dict[int, list[int]] = {}

    def walk(node: int, birth: float) -> tuple[float, list[int]]:
        total, cur = 0.0, node
        while cur in kids:
            a, b, w = kids[cur]
            lam = 1 / max(w, 1e-12)
            big = [c for c in (a, b) if len(members[c]) >= least]
            total += sum(len(members[c]) for c in (a, b) if c not in big) * (lam - birth)
            if len(big) == 2:
                total += (len(members[a]) + len(members[b])) * (lam - birth)
                parts = [walk(c, lam) for c in big]
                below = sum(p[0] for p in parts)
                stability[node], chosen[node] = total, [node]
                return (below, [y for p in parts for y in p[1]]) if below > total or birth == 0.0 else (total, [node])
            if not big:
                break
            cur = big[0]
        return total, [node]

    import sys

    sys.setrecursionlimit(max(sys.getrecursionlimit(), 4 * n + 100))
    labels = np.full(n, -1)
    for k, c in enumerate(walk(2 * n - 2, 0.0)[1]):
        labels[members[c]] = k
    return labels


def density_labels(rows: DataFrame, key: str, vec: str, *, bound: int = 2000, least: int = 20, samples: int = 5, hidden: tuple[int, ...] = (100, 50), iterations: int = 100, confidence: float = 0.0) -> DataFrame:
    """key, label, confidence of all rows with a vector: density clusters of a sample (the ``bound`` rows of the smallest hash
    of their key, fitted on the driver), carried to all rows by a perceptron. With one cluster in the sample all rows are of
    it, with none all are noise, -1; the confidence is null then."""
    r = rows.where(F.col(vec).isNotNull() & F.col(key).isNotNull())
    sample = [x[vec] for x in r.orderBy(F.xxhash64(key), key).select(vec, key).limit(bound).collect()]
    labels = density_tree(np.array(sample, dtype=float), least, samples).tolist() if sample else []
    classes = sorted(set(labels) - {-1})
    if len(classes) < 2:
        return r.select(key, F.lit(classes[0] if classes else -1).alias("label"), F.lit(None).cast("double").alias("confidence"))
    train = rows.sparkSession.createDataFrame([([float(v) for v in x], y) for x, y in zip(sample, labels, strict=True)], "v array<double>, label int")
    model, classes = train_classifier(train, "v", "label", hidden, iterations=iterations)
    return predict(model, classes, r, key, vec, confidence)


def procrustes(pairs: DataFrame, axes: int = 3) -> dict:
    """Rotation, scale and shift that carry points a onto b (least squares), from sums over all rows; a_0.., b_0.. columns.
    None below four pairs."""
    ok = [F.col(f"{s}_{i}").isNotNull() for s in "ab" for i in range(axes)]
    cond = ok[0]
    for c in ok[1:]:
        cond = cond & c
    p = pairs.where(cond)
    aggs = [F.count("*").alias("n")] + [F.avg(f"{s}_{i}").alias(f"m{s}{i}") for s in "ab" for i in range(axes)]
    aggs += [F.avg(F.col(f"b_{i}") * F.col(f"a_{j}")).alias(f"c{i}{j}") for i in range(axes) for j in range(axes)] + [F.avg(sum((F.col(f"a_{i}") * F.col(f"a_{i}") for i in range(axes)), F.lit(0.0))).alias("q")]
    r = p.agg(*aggs).first()
    if r["n"] < 4:
        return {"n": r["n"], "rotation": None, "scale": None, "shift": None}
    ma, mb = np.array([r[f"ma{i}"] for i in range(axes)]), np.array([r[f"mb{i}"] for i in range(axes)])
    cov = np.array([[r[f"c{i}{j}"] for j in range(axes)] for i in range(axes)]) - np.outer(mb, ma)
    u, sv, vt = np.linalg.svd(cov)
    sign = np.ones(axes)
    if np.linalg.det(u) * np.linalg.det(vt) < 0:
        sign[-1] = -1
    rot = u @ np.diag(sign) @ vt
    var = r["q"] - float(ma @ ma)
    scale = float((sv * sign).sum() / var) if var > 0 else 1.0
    return {"n": r["n"], "rotation": rot, "scale": scale, "shift": mb - scale * rot @ ma}


def triangulate(views: DataFrame, cameras: dict[str, list[list[float]]], *, gate: float = 0.6) -> DataFrame:
    """Points seen by two cameras or more (likelihood from ``gate`` on) by the direct linear transform. ``views``: session_id,
    frame, bodypart, cam, x, y, likelihood; ``cameras``: 3 x 4 matrices. One small solve a point, batched by Arrow."""
    known = views.where(F.col("cam").isin(list(cameras)) & (F.col("likelihood") >= gate) & F.col("x").isNotNull() & F.col("y").isNotNull())
    seen = known.groupBy("session_id", "frame", "bodypart").agg(F.sort_array(F.collect_list(F.struct("cam", "x", "y"))).alias("v"), F.min("likelihood").alias("likelihood")).where(F.size("v") >= 2)
    mats = {c: np.array(m, dtype=float) for c, m in cameras.items()}

    def run(batches):
        for pdf in batches:
            out = []
            for v in pdf["v"]:
                rows = []
                for o in v:
                    m = mats[o["cam"]]
                    rows += [o["x"] * m[2] - m[0], o["y"] * m[2] - m[1]]
                h = np.linalg.svd(np.array(rows))[2][-1]
                out.append(h[:3] / h[3] if abs(h[3]) > 1e-12 else [np.nan] * 3)
            xyz = np.array(out, dtype=float).reshape(-1, 3)
            yield pdf[["session_id", "frame", "bodypart", "likelihood"]].assign(x=xyz[:, 0], y=xyz[:, 1], z=xyz[:, 2])

    return seen.mapInPandas(run, "session_id string, frame bigint, bodypart string, likelihood double, x double, y double, z double")
