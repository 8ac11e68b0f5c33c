"""Mixing sources to target weights, sized in tokens of a public tokenizer.

The total is the largest that every available source can reach at its share within its cap of repeats. A source first gives
complete epochs of all its documents; what is left of its budget is filled with documents in the order of Efraimidis-Spirakis
keys, exponential variates divided by the document's quality weight (the smallest first, so that a draw is proportional to
the weight), up to the budget by a prefix sum. The prefix sum runs in two levels over narrow ranges of the key, so no source
is sorted in one task.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.llm.tokens import encoder, slices, vocabulary
from kinetrail.plans.runtime import cut, nan_to_null, table

SEED = 20_240
LEAST_QUALITY = 0.05
#: Documents that a range of keys should hold, at the most likely part of the keys.
RANGE_DOCS = 50_000


def quality(text: Column) -> Column:
    """Weight of a document: the share of letters among its characters that are no white space, times the share of its words that
    are different from those before in a short stretch (its first appearance of each pair of neighbours), at least
    ``LEAST_QUALITY``. An expression of the row in any script; null and blank texts have the least."""
    solid = F.length(F.regexp_replace(text, r"\s+", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}\p{M}]+", ""))
    words = F.split(F.lower(F.trim(text)), r"\s+")
    pairs = F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    fresh = F.coalesce(F.try_divide(F.size(F.array_distinct(pairs)).cast("double"), F.size(pairs)), F.lit(1.0))
    return F.round(F.greatest(F.lit(LEAST_QUALITY), F.coalesce(F.try_divide(letters.cast("double"), solid) * fresh, F.lit(0.0))), 9)


def size_and_quality(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, source, n_tokens and quality of every document; tokens are counted, their ids are not kept."""
    schema = pa.schema([("doc_id", pa.int64()), ("source", pa.string()), ("n_tokens", pa.int64()), ("quality", pa.float64())])

    def run(batches):
        enc = encoder(path)
        for batch in batches:
            texts = batch.column("text").to_pylist()
            size = [n for a, b in slices(texts) for n in enc.count_batch(texts[a:b])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("source"), pa.array(size, pa.int64()), batch.column("quality")], schema=schema)

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "source", "text", quality(F.col("text")).alias("quality"))
    return rows.mapInArrow(run, "doc_id bigint, source string, n_tokens bigint, quality double")


def plan(targets: list[dict], tokens: dict[str, int], total: float | None = None) -> list[dict]:
    """Budget, epochs and rest of each source. Shares are those of ``weight`` among the sources that have tokens; without
    ``total`` it is the largest that all of them reach. A null weight or a negative one counts 0, a null cap 1."""
    rows = [t | {"weight": max(0.0, t["weight"] or 0.0), "cap": max(0, 1 if t["max_repeats"] is None else t["max_repeats"]), "tokens": tokens.get(t["source"], 0)} for t in targets]
    able = [r for r in rows if r["weight"] > 0 and r["tokens"] > 0 and r["cap"] > 0]
    weight = sum(r["weight"] for r in able)
    if able and total is None:
        total = min(r["cap"] * r["tokens"] * weight / r["weight"] for r in able)
    for r in rows:
        use = r in able
        r["share"] = r["weight"] / weight if use else 0.0
        r["budget"] = int(min(r["share"] * total + 1e-6, r["cap"] * r["tokens"])) if use else 0
        r["epochs"], r["rest"] = divmod(r["budget"], r["tokens"]) if use else (0, 0)
    return rows


def mix(sized: DataFrame, targets: list[dict], *, total: float | None = None, seed: int = SEED) -> DataFrame:
    """``sized``: doc_id, source, n_tokens, quality. Returns doc_id, source, n_tokens, copies, of the documents used.

    Documents without tokens, with a null source or of a source without a target are not used. The draw depends on the seed
    and doc_id only; ties of the key go by doc_id. The document that crosses a budget is taken when that comes nearer to it.
    """
    spark = sized.sparkSession
    names = [t["source"] for t in targets]  # the mixture's own table of sources, some rows
    docs = sized.where((F.col("n_tokens") > 0) & F.col("source").isin(names))
    found = {r["source"]: r for r in docs.groupBy("source").agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).collect()}
    rows = plan(targets, {s: r["t"] for s, r in found.items()}, total)
    part = {r["source"]: max(4, math.ceil((found[r["source"]]["n"] if r["source"] in found else 0) / RANGE_DOCS)) for r in rows}
    budget = spark.createDataFrame([(r["source"], r["epochs"], r["rest"], part[r["source"]]) for r in rows if r["budget"] > 0] or [("", 0, 0, 1)], "source string, epochs bigint, rest bigint, per_octave int")
    docs = docs.join(F.broadcast(budget), "source")
    # a variate in (0, 1), exponential after the logarithm
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)
    docs = docs.withColumn("key", -F.log(u) / F.greatest(F.coalesce("quality", F.lit(LEAST_QUALITY)), F.lit(1e-9)))
    draw = docs.where("rest > 0").withColumn("range", F.floor(F.log2("key") * F.col("per_octave")))
    sums = draw.groupBy("source", "range").agg(F.sum("n_tokens").alias("in_range"))
    before = sums.withColumn("before", F.sum("in_range").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)))
    before = before.select("source", "range", F.coalesce("before", F.lit(0)).alias("before"))
    # ranges that begin within the budget are the only ones that can hold a drawn document
    before = before.join(F.broadcast(budget.select("source", F.col("rest").alias("_rest"))), "source").where("before < _rest").drop("_rest")
    inside = W.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(W.unboundedPreceding, 0)
    drawn = draw.join(before, ["source", "range"]).withColumn("upto", F.col("before") + F.sum("n_tokens").over(inside))
    least = F.col("upto") - F.col("n_tokens")
    drawn = drawn.where((F.col("upto") <= F.col("rest")) | ((least < F.col("rest")) & (F.col("upto") - F.col("rest") < F.col("rest") - least)))
    whole = docs.where("epochs > 0").select("doc_id", "source", "n_tokens", F.col("epochs").alias("copies"))
    once = drawn.select("doc_id", "source", "n_tokens", F.lit(1).cast("bigint").alias("copies"))
    return whole.unionByName(once).groupBy("doc_id", "source", "n_tokens").agg(F.sum("copies").alias("copies"))


def shares(mixed: DataFrame, targets: list[dict]) -> DataFrame:
    """What each source of the targets really got; sources without documents have 0."""
    spark = mixed.sparkSession
    got = mixed.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("copies").alias("n_copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"), F.max("copies").alias("most_copies"))
    t = spark.createDataFrame([(x["source"], x["weight"], x["max_repeats"]) for x in targets], "source string, weight double, max_repeats int")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = t.join(got, "source", "left").select("source", "weight", "max_repeats", *[zero(c) for c in ("n_docs", "n_copies", "tokens", "most_copies")])
    total = out.agg(F.sum("tokens").alias("total"))
    return out.join(F.broadcast(total)).select("*", F.round(F.try_divide("tokens", "total"), 6).alias("share")).drop("total")


def targets(spark, sf_dir: str) -> list[dict]:
    """The table of targets, some rows, for the driver."""
    t = table(spark, sf_dir, "mix_target").where("source is not null").groupBy("source").agg(F.max(nan_to_null(F.col("weight"))).alias("weight"), F.max("max_repeats").alias("max_repeats"))
    return [r.asDict() for r in t.orderBy("source").collect()]


def sized_documents(spark, sf_dir: str, wanted: list[dict]) -> DataFrame:
    """The documents of the wanted sources with their sizes and weights, written once."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text").where(F.col("source").isin([t["source"] for t in wanted]))
    return cut(size_and_quality(docs, vocabulary()))


def p7_mixture(spark, sf_dir: str) -> DataFrame:
    """The documents of the mixture and how often each is used."""
    wanted = targets(spark, sf_dir)
    return mix(sized_documents(spark, sf_dir, wanted), wanted)


def p7_shares(spark, sf_dir: str) -> DataFrame:
    """The target and the real share of every source."""
    wanted = targets(spark, sf_dir)
    return shares(mix(sized_documents(spark, sf_dir, wanted), wanted), wanted)
