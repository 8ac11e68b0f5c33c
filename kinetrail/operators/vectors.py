"""Evaluation of clusters of vectors: centroids, silhouettes, nearest members, near duplicates, distances of clusters.

Sums over members are taken per cluster before anything is compared, so no pair of rows is ever formed; the silhouette is exact
for squared distances, for which the mean distance to a cluster follows from the cluster's sums.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _doubles(c: str, dims: int) -> list[Column]:
    return [F.get(c, F.lit(i)).cast("double") for i in range(dims)]


def centroids(rows: DataFrame, label: str, vec: str, dims: int) -> DataFrame:
    """label, n, centroid; a partial aggregate over the dimensions."""
    a = rows.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).groupBy(label).agg(F.count("*").alias("n"), *[F.avg(x).alias(f"_{i}") for i, x in enumerate(_doubles(vec, dims))])
    return a.select(label, "n", F.array(*[f"_{i}" for i in range(dims)]).alias("centroid"))


def sq(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def silhouette(rows: DataFrame, label: str, vec: str, dims: int) -> DataFrame:
    """Mean silhouette of every cluster with squared distances: the mean squared distance of a point to a cluster is its squared
    distance to the centroid plus the cluster's mean squared radius. The clusters' sums are a bounded table."""
    c = centroids(rows, label, vec, dims).withColumnRenamed(label, "c")
    r = rows.where(F.col(label).isNotNull() & F.col(vec).isNotNull()).select(F.col(label).alias("l"), F.col(vec).alias("v"))
    norm = r.groupBy("l").agg(F.avg(dot(F.col("v"), F.col("v"))).alias("_m"))
    c = c.join(norm, c["c"] == norm["l"]).select("c", "n", "centroid", (F.col("_m") - dot(F.col("centroid"), F.col("centroid"))).alias("radius"))
    table = c.agg(F.collect_list(F.struct("c", "n", "centroid", "radius")).alias("t"))
    d = r.join(F.broadcast(table)).withColumn("d", F.transform("t", lambda e: F.struct(e["c"].alias("c"), e["n"].alias("n"), (sq(F.col("v"), e["centroid"]) + e["radius"]).alias("d"))))
    own = F.get(F.filter("d", lambda e: e["c"] == F.col("l")), F.lit(0))
    other = F.array_min(F.transform(F.filter("d", lambda e: e["c"] != F.col("l")), lambda e: e["d"]))
    d = d.select("l", F.try_divide(own["d"] * own["n"], own["n"] - 1).alias("a"), other.alias("b"))
    s = F.when(F.col("a").isNull(), 0.0).otherwise(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")))
    return d.groupBy(F.col("l").alias(label)).agg(F.count("*").alias("n"), F.avg(s).alias("silhouette"))


def nearest(rows: DataFrame, key: str, label: str, vec: str, dims: int, k: int) -> DataFrame:
    """The k members nearest to each cluster's centroid, ties by key. Each salt keeps its own k first."""
    c = centroids(rows, label, vec, dims).drop("n")
    d = rows.select(key, label, vec).join(F.broadcast(c), label).select(label, key, sq(F.col(vec), F.col("centroid")).alias("d")).withColumn("_s", F.pmod(F.xxhash64(key), F.lit(64)))
    few = d.withColumn("_r", F.row_number().over(W.partitionBy(label, "_s").orderBy("d", key))).where(F.col("_r") <= k)
    return few.withColumn("rank", F.row_number().over(W.partitionBy(label).orderBy("d", key)).cast("bigint")).where(F.col("rank") <= k).select(label, "rank", key, F.sqrt("d").alias("dist"))


def near_duplicates(rows: DataFrame, vec: str, digits: int) -> DataFrame:
    """Share of the rows whose rounded vector another row has as well."""
    k = rows.where(F.col(vec).isNotNull()).groupBy(F.transform(vec, lambda x: F.round(x.cast("double"), digits)).alias("k")).agg(F.count("*").alias("c"))
    return k.agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("c") > 1, F.col("c")).otherwise(0)) / F.sum("c")).alias("share"))


def centroid_cosines(rows: DataFrame, label: str, vec: str, dims: int) -> DataFrame:
    """Cosine distance of every pair of cluster centroids."""
    c = centroids(rows, label, vec, dims)
    t = c.agg(F.collect_list(F.struct(F.col(label).alias("l"), "centroid")).alias("r")).select(F.explode("r").alias("a"), "r").select("a", F.explode("r").alias("b")).where("a.l < b.l")
    cos = dot(F.col("a.centroid"), F.col("b.centroid")) / F.sqrt(dot(F.col("a.centroid"), F.col("a.centroid")) * dot(F.col("b.centroid"), F.col("b.centroid")))
    return t.select(F.col("a.l").alias("label_a"), F.col("b.l").alias("label_b"), (1 - cos).alias("distance"))
