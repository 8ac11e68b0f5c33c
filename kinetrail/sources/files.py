"""Discovery of pose files, videos and recordings, and reading of tracking CSV files in their header variants."""

from __future__ import annotations

import base64
import csv
import io
import re

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What is no pose file, and the extensions of videos.
EXCLUDED = r"BSOID|UN_filtered|_bout_lengths"
VIDEOS = ["mp4", "avi", "mov", "mkv", "wmv"]


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """Paths under a folder with name, stem and extension; contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    f = f.withColumn("name", F.regexp_extract("path", "([^/]+)$", 1))
    return f.select("path", "name", F.regexp_replace("name", r"\.[^.]+$", "").alias("stem"), F.lower(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("ext"))


def pose_files(files: DataFrame) -> DataFrame:
    """The best tier there is: filtered h5, filtered csv, any h5 or csv."""
    f = files.where(F.col("ext").isin("h5", "csv") & ~F.col("name").rlike(EXCLUDED))
    tier = F.when(F.col("stem").endswith("_filtered") & (F.col("ext") == "h5"), 0).when(F.col("stem").endswith("_filtered"), 1).otherwise(2)
    f = f.withColumn("tier", tier)
    best = f.agg(F.min("tier").alias("best"))
    return f.join(F.broadcast(best)).where("tier = best").select("path", "stem", "ext")


def one_per_stem(files: DataFrame) -> DataFrame:
    """One pose file a stem, h5 before csv."""
    f = files.where(F.col("ext").isin("h5", "csv"))
    return f.groupBy("stem").agg(F.min_by("path", F.struct(F.when(F.col("ext") == "h5", 0).otherwise(1), "path")).alias("path"))


def videos(files: DataFrame) -> DataFrame:
    return files.where(F.col("ext").isin(*VIDEOS)).select("stem", "path")


def recordings(files: DataFrame, status: DataFrame | None = None) -> DataFrame:
    """Recordings of ``{cam}_{session}_corrected.mp4``: all cameras done by the report, or without one two cameras or more.
    ``status``: session_id, cam, status."""
    f = files.select("path", F.regexp_extract("name", r"^([^_]+)_(.+)_corrected\.mp4$", 1).alias("cam"), F.regexp_extract("name", r"^([^_]+)_(.+)_corrected\.mp4$", 2).alias("session_id")).where("cam <> ''")
    if status is None:
        status = f.sparkSession.createDataFrame([], "session_id string, cam string, status string")
    j = f.join(status.select("session_id", "cam", "status"), ["session_id", "cam"], "left")
    g = j.groupBy("session_id").agg(F.array_sort(F.collect_set("cam")).alias("cameras"), F.bool_and(F.coalesce(F.col("status") == "done", F.lit(False))).alias("done"), F.count("status").alias("reported"))
    return g.where("done or (reported = 0 and size(cameras) >= 2)").select("session_id", "cameras")


def representative(sessions: DataFrame) -> DataFrame:
    """The session with the lowest fill rate, ties by name; without a report the rate counts 1."""
    rate = F.coalesce(F.try_divide(F.col("fills_inserted").cast("double"), F.col("n_output_frames")), F.lit(1.0))
    return sessions.agg(F.min_by("session_id", F.struct(rate, F.col("session_id"))).alias("session_id"))


def checkpoints(files: DataFrame, pattern: str) -> DataFrame:
    """The path with the highest number captured by a pattern."""
    n = F.regexp_extract("name", pattern, 1)
    return files.where(n != "").agg(F.max_by("path", n.cast("bigint")).alias("path"))


def skeleton(parts: DataFrame, chains: dict[str, list[str]]) -> DataFrame:
    """Edges between successive present names of each chain: chain, a, b."""
    rows = [(c, i, n) for c, ns in chains.items() for i, n in enumerate(ns)]
    known = parts.sparkSession.createDataFrame(rows, "chain string, i int, bodypart string")
    p = known.join(parts.select("bodypart").distinct(), "bodypart")
    w = W.partitionBy("chain").orderBy("i")
    return p.select("chain", F.col("bodypart").alias("a"), F.lead("bodypart").over(w).alias("b")).where("b is not null")


def sample(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows without replacement, the same ones at any partitioning: those with the smallest hash."""
    return df.orderBy(F.xxhash64(F.lit(seed), key), key).limit(n)


def header(lines: list[str]) -> tuple[int, list[tuple[str, str]]]:
    """Number of header rows and (body part, coordinate) of every column after the first, from a file's first rows. Headers of
    two rows (no scorer), three, or four (individuals; their names are kept only where there are several)."""
    rows = []
    for r in csv.reader(io.StringIO("\n".join(lines))):
        if r and r[0].strip().lstrip("-").isdigit():
            break
        rows.append([c.strip() for c in r])
    by = {r[0].lower(): r[1:] for r in rows if r}
    if "bodyparts" not in by or "coords" not in by:
        raise ValueError("no header of body parts and coordinates")
    people = by.get("individuals")
    many = people is not None and len(set(people)) > 1
    return len(rows), [(f"{people[i]}_{b}" if many else b, c) for i, (b, c) in enumerate(zip(by["bodyparts"], by["coords"], strict=True))]


def read_pose_csv(spark: SparkSession, path: str, session_id: str) -> DataFrame:
    """A tracking CSV as the long table session_id, frame, bodypart, x, y, z, likelihood; what is no number is null."""
    if not path.lower().endswith(".csv"):
        raise ValueError(f"not a tracking csv: {path}")
    n, cols = header([r[0] for r in spark.read.text(path).limit(6).collect()])
    t = spark.read.option("header", "false").csv(path)
    t = t.where(F.col("_c0").rlike("^-?[0-9]+$"))
    parts: dict[str, dict[str, str]] = {}
    for i, (b, c) in enumerate(cols):
        parts.setdefault(b, {})[c] = f"_c{i + 1}"
    get = lambda m, c: F.nanvl(F.expr(f"try_cast(`{m[c]}` as double)"), F.lit(None).cast("double")) if c in m else F.lit(None).cast("double")
    rows = F.array(*[F.struct(F.lit(b).alias("bodypart"), *[get(m, c).alias(c) for c in ("x", "y", "z", "likelihood")]) for b, m in parts.items()])
    return t.select(F.lit(session_id).alias("session_id"), F.col("_c0").cast("bigint").alias("frame"), F.explode(rows).alias("p")).select("session_id", "frame", "p.*")


def write_if_any(df: DataFrame, path: str, by: str | None = None) -> bool:
    """Write a table only when it has a row; existing output is left as it is."""
    if df.isEmpty():
        return False
    w = df.write.mode("ignore")
    (w.partitionBy(by) if by else w).parquet(path)
    return True


def peek_bodyparts(spark: SparkSession, path: str) -> list[str]:
    """Body parts of a tracking CSV in their order, from its header alone."""
    return list(dict.fromkeys(b for b, _ in header([r[0] for r in spark.read.text(path).limit(6).collect()])[1]))


def fps_hint(name: str) -> float | None:
    """Frames per second in a file name such as ``run_60fps_a.csv``."""
    m = re.search(r"_(\d+(?:\.\d+)?)fps_", name)
    return float(m[1]) if m else None


def load_source(spark: SparkSession, paths: list[str], fps_assumed: float | None = None, *, least: int = 10) -> tuple[DataFrame | None, list[tuple[str, str]]]:
    """All readable tracking files of a source as one table with ``fps`` (hint of the name, else assumed, else 30), and the files left out
    with the reason: unreadable, or fewer than ``least`` frames. None without a file."""
    out, failed = None, []
    for p in sorted(paths):
        stem = re.sub(r"\.[^.]+$", "", p.rsplit("/", 1)[-1])
        try:
            t = read_pose_csv(spark, p, stem)
            n = t.select("frame").distinct().limit(least).count()
        except Exception as e:  # an unreadable file must not stop the others
            failed.append((p, type(e).__name__))
            continue
        if n < least:
            failed.append((p, "too short"))
            continue
        t = t.withColumn("fps", F.lit(fps_hint(p.rsplit("/", 1)[-1]) or fps_assumed or 30.0))
        out = t if out is None else out.unionByName(t)
    return out, failed


def example_clips(files: DataFrame) -> DataFrame:
    """Clips ``group_N_example_M`` and ``cluster_N[_animal]_example_M`` by cluster: cluster, gif (the first by path), mp4s (sorted)."""
    n = F.regexp_extract("name", r"(?i)^(?:group_(\d+)|cluster_(\d+)(?:_[^/]*)?)_example_\d+\.(?:mp4|gif)$", 0)
    number = F.regexp_extract("name", r"(?i)^(?:group|cluster)_(\d+)", 1).cast("bigint")
    f = files.where(n != "").select(number.alias("cluster"), "path", "ext")
    return f.groupBy("cluster").agg(F.min(F.when(F.col("ext") == "gif", F.col("path"))).alias("gif"), F.sort_array(F.collect_list(F.when(F.col("ext") == "mp4", F.col("path")))).alias("mp4s"))


def video_of(files: DataFrame, stem: str, folders: list[str]) -> DataFrame:
    """The first video of a stem over the folders in order, then the extensions in order: path."""
    place = F.coalesce(*[F.when(F.col("path").contains(d), i) for i, d in enumerate(folders)])
    kind = F.array_position(F.array(*[F.lit(v) for v in VIDEOS]), F.col("ext"))
    v = files.where((F.col("stem") == stem) & F.col("ext").isin(*VIDEOS)).withColumn("_p", place).where("_p is not null")
    return v.agg(F.min_by("path", F.struct("_p", kind.alias("k"), "path")).alias("path")).where("path is not null")


def training_rows(df: DataFrame, key: str, *, full: int = 10_000, share: float = 0.3, seed: int = 42) -> DataFrame:
    """All rows of a table of up to ``full`` rows, beyond that the share of them with the smallest hash of their key."""
    if df.limit(full + 1).count() <= full:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), key), F.lit(1 << 30)) < int(share * (1 << 30)))


def decode_typed(text: str, kind: str) -> np.ndarray:
    """Values of a base64 typed array; ``kind``: f4, f8 or i4, little endian."""
    if kind not in ("f4", "f8", "i4"):
        raise ValueError(f"unknown kind of array: {kind}")
    return np.frombuffer(base64.b64decode(text), dtype=f"<{kind}")


def optional_table(spark: SparkSession, path: str) -> DataFrame | None:
    """A parquet table where there is one, else None."""
    try:
        return spark.read.parquet(path)
    except AnalysisException:
        return None
