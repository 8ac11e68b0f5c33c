"""Plan-building helpers shared by every operator.

All of them keep work distributed: lineage is cut through the shared checkpoint folder, a side is broadcast only after its
size has been counted, and hot keys are salted when it is too large for that.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when its counted rows times its width stay below this.
BROADCAST_BYTES = 48 * 1024 * 1024
#: Replicas of the small side when a salted join is needed.
SALTS = 16


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names in ``spark.checkpoint.dir``; only where none is set (tests), a temporary one."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="kinetrail-ckpt-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared checkpoint folder: it is computed once and survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def kept(df: DataFrame) -> DataFrame:
    """As ``cut``, in compressed columns: for wide tables of many rows, of which a read takes only the columns it asks for."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/kept-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes the files of ``kept`` tables that nothing reads any more."""
    for df in dfs:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._kept_at)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def row_width(df: DataFrame) -> int:
    """Bytes assumed per row: strings and nested values count 64, scalars 8."""
    return sum(64 if t in ("string", "binary") or t[:5] in ("array", "map<s", "struc") else 8 for _, t in df.dtypes) + 16


def fits_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """True when the counted rows prove that ``df`` is small."""
    return df.count() <= limit // row_width(df)


def settled(df: DataFrame) -> DataFrame:
    """``df`` as it is when it is read from a table or checkpoint by projections and filters alone, else materialised: what is
    counted and then joined is computed once."""
    names = df._jdf.queryExecution().analyzed().toString()
    return cut(df) if any(x in names for x in ("Aggregate", "Join", "Window", "Generate", "Distinct", "Deduplicate", "InPandas", "InArrow", "Sort")) else df


def join_dim(fact: DataFrame, dim: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join a large table with a dimension on keys that may be heavily skewed.

    The dimension is broadcast when its count proves it small; beyond that the fact's rows of every key are spread over
    ``SALTS`` reducers and the dimension is replicated as often, so that no key lands in one task.
    """
    dim = settled(dim)
    if fits_broadcast(dim):
        return fact.join(F.broadcast(dim), on, how)
    salt = F.pmod(F.xxhash64(*[c for c in fact.columns]), F.lit(SALTS)).cast("int")
    wide = dim.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return fact.withColumn("_salt", salt).join(wide, [*on, "_salt"], how).drop("_salt")


def nan_to_null(c: Column) -> Column:
    return F.nanvl(c, F.lit(None).cast("double"))


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp without a zone, read as UTC by a UTC session."""
    return F.unix_micros(c.cast("timestamp"))


def latest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per key, that of the largest ``by``; a partial aggregate, so rows sent again are merged before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    order = F.struct(F.col(by).isNotNull(), F.col(by), *[F.col(c) for c in rest if c != by and not _has_map(df, c)])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def _has_map(df: DataFrame, c: str) -> bool:
    return "map<" in dict(df.dtypes)[c]
