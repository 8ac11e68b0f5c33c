"""Schemas that drift between files: one consistent table of all records, and a report of every change.

Each file's schema is a small graph (fields, their name tokens, types, nested names, typical values and places in the list of
body parts). What differs between a file and the one before it in its feed is matched by similarity flooding, with the fields
that both have as anchors: names and the lists of synonyms give the initial similarity, scores of field pairs and of the nodes
they point to reinforce each other until they converge, and pairs are renames by that score, best first; the rest is added or
removed. Two names that the lists know as different things are no pair. The work per pair of files is bounded by their fields.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kinetrail.plans.runtime import cut, join_dim, table

#: Other words for the same thing, as plain lower-case tokens; the first of each is the table's column.
SYNONYMS = [
    ["session_id", "session", "recording", "recording_id"],
    ["source", "dataset", "src_name", "src", "source_name"],
    ["fps", "frame_rate", "framerate", "frames_per_second"],
    ["frame", "frame_idx", "frame_no", "frame_index", "frame_number"],
    ["bodyparts", "body_parts", "keypoint_names", "keypoints", "landmarks", "parts"],
    ["paradigm", "assay", "test_type"],
    ["scorer", "model_name", "model", "network"],
    ["note", "remark", "comment", "notes"],
    ["is_own", "own"],
    ["temp_c", "temperature", "temp"],
    ["crop", "roi", "crop_box"],
]
#: Short forms in names of body parts, and other words for a landmark.
SHORT = {
    "l": "left", "r": "right", "lt": "left", "rt": "right", "fl": "front left", "fr": "front right", "hl": "back left", "hr": "back right",
    "bl": "back left", "br": "back right", "hind": "back", "fore": "front", "rear": "back", "forepaw": "front paw", "hindpaw": "back paw",
    "frontpaw": "front paw", "backpaw": "back paw", "forelimb": "front paw", "hindlimb": "back paw", "foot": "paw", "centre": "center",
    "bodycentre": "body center", "bodycenter": "body center", "headcentre": "head center", "tailbase": "tail base", "tailtip": "tail tip",
}
LANDMARK_WORDS = {
    "nose": ["nose", "snout", "nose tip", "snout tip"],
    "neck": ["neck", "nape"],
    "back_middle": ["back middle", "back mid", "body center", "body middle", "centroid", "center", "mid body"],
    "tailbase": ["tail base", "tail root", "tail start"],
    "tail_tip": ["tail tip", "tail end"],
}
#: A pair of fields needs this score after flooding to be a rename.
LEAST = 0.5
ROUNDS, CONVERGED = 50, 1e-4


def tokens(name: str) -> list[str]:
    """Lower-case tokens of a name in snake, kebab, camel, upper or spaced case, short forms spelled out."""
    name = re.sub(r"(?<=[a-z0-9])(?=[A-Z])", " ", name)
    raw = [t for t in re.split(r"[^0-9a-zA-Z]+", name.lower()) if t]
    out: list[str] = []
    for t in raw:
        out += SHORT.get(t, t).split()
    return out


def _landmarks(reference: list[tuple[str, str]]) -> dict[tuple[str, ...], str]:
    known = {tuple(sorted(w.split())): m for m, ws in LANDMARK_WORDS.items() for w in ws}
    return known | {tuple(sorted(tokens(a))): m for a, m in reference if a and m}


_SYNONYM = {"".join(w.split("_")): group[0] for group in SYNONYMS for w in group}


def canonical(name: str, landmarks: dict[tuple[str, ...], str]) -> str | None:
    """What a field stands for: ``part:<landmark>``, a column of ``SYNONYMS``, or None when the name is not known.
    Individual prefixes such as ``animal1`` are left out."""
    t = tokens(name)
    while len(t) > 1 and re.fullmatch(r"(animal|mouse|rat|subject|individual|ind|bp|kp|pt)\d*", t[0]):
        t = t[1:]
    plain = "".join(t)
    if plain in _SYNONYM:
        return _SYNONYM[plain]
    key = tuple(sorted(t))
    if key in landmarks:
        return f"part:{landmarks[key]}"
    side = [x for x in t if x in ("left", "right", "front", "back")]
    if "paw" in t or "ear" in t:
        return "part:" + "_".join(sorted(side, key=["front", "back", "left", "right"].index) + ["paw" if "paw" in t else "ear"] + sorted(x for x in t if x not in side and x not in ("paw", "ear")))
    return None


def individual(name: str) -> int:
    """Number of the individual that a name's prefix gives, 1 where it gives none."""
    m = re.fullmatch(r"(?:animal|mouse|rat|subject|individual|ind)(\d+)", (tokens(name) or [""])[0])
    return int(m[1]) if m else 1


def _grams(s: str) -> set[str]:
    s = f"  {s} "
    return {s[i : i + 3] for i in range(len(s) - 2)}


def _own_evidence(a: dict, b: dict) -> float:
    """Evidence of one pair of fields before flooding, 0 to 1."""
    ca, cb = a["canon"], b["canon"]
    if ca and cb:
        return 1.0 if ca == cb else 0.0
    ta, tb = a["tokens"], b["tokens"]
    if sorted(ta) == sorted(tb) or "".join(ta) == "".join(tb):
        return 1.0
    ga, gb = _grams(" ".join(sorted(ta))), _grams(" ".join(sorted(tb)))
    name = len(ga & gb) / max(1, len(ga | gb))
    if "nested" in (a["kind"], b["kind"]):  # readings of body parts: their values say nothing of their name
        return name
    telling = len(a["lo"] or "") > 2 and (a["lo"], a["hi"]) == (b["lo"], b["hi"]) and a["type"] != "boolean"
    return max(name, 0.8 if telling else 0.0)


def _listed(fields: list[dict]) -> list[str]:
    """Names in the list of body parts of a file, in order."""
    text = next((f["lo"] for f in fields if f["canon"] == "bodyparts" and f["lo"] and f["lo"] == f["hi"]), "")
    return [x.split(":")[0].strip() for x in re.sub(r'[\[\]{}"]', "", text).split(",") if x.strip()]


def flood(left: list[dict], right: list[dict], was: list[dict] = (), now: list[dict] = ()) -> np.ndarray:
    """Similarity of every field of ``left`` with every field of ``right`` after flooding, 0 to 1: the mean of the initial
    similarity and of what flows in from the nodes around. ``was`` and ``now`` are the fields both files have, as they are in
    each; a node that they share too tells less."""
    own = np.array([[_own_evidence(a, b) for b in right] for a in left]).reshape(len(left), len(right))
    apart = np.array([[bool(a["canon"] and b["canon"] and a["canon"] != b["canon"]) for b in right] for a in left]).reshape(own.shape)
    kind = np.array([[a["kind"] + b["kind"] for b in right] for a in left])
    degree = lambda x, label: max(sum(x in f[label] for f in [*left, *was]), sum(x in f[label] for f in [*right, *now]), 1)
    alike = lambda a, b, label: sum(1 / degree(x, label) for x in set(a[label]) & set(b[label])) / max(1, len(set(a[label]) | set(b[label])))
    same = np.array([[float(a["type"] == b["type"]) for b in right] for a in left])
    # values of plain fields; booleans have the same ones everywhere
    values = np.array([[0.0 if "boolean" in (a["type"], b["type"]) else alike(a, b, "values") for b in right] for a in left])
    shape = np.array([[len(set(a["children"]) & set(b["children"])) / len(set(a["children"]) | set(b["children"])) if a["children"] or b["children"] else 1.0 for b in right] for a in left])
    # readings of a body part: the place in the list of body parts, or else whether few others could be meant
    free = (kind == "nestednested") & ~apart
    few = 1 / np.maximum(1, np.maximum(free.sum(1)[:, None], free.sum(0)[None]))
    old, new_ = _listed([*left, *was]), _listed([*right, *now])
    row, col = {f["field"]: i for i, f in enumerate(left)}, {f["field"]: j for j, f in enumerate(right)}

    def beside(x: str | None, y: str | None, score: np.ndarray) -> float:
        return 1.0 if x == y else float(score[row[x], col[y]]) if x in row and y in col else 0.0

    def places(score: np.ndarray) -> np.ndarray:
        out = few.copy()
        for x in set(old) & set(row):
            for y in set(new_) & set(col):
                p, q, o, n = old.index(x) + 1, new_.index(y) + 1, [None, *old, None], [None, *new_, None]
                out[row[x], col[y]] = (beside(o[p - 1], n[q - 1], score) + beside(o[p + 1], n[q + 1], score)) / 2
        return out

    na, nb = sorted({x for f in left for x in f["tokens"]}), sorted({x for f in right for x in f["tokens"]})
    A, B = (np.array([[float(x in f["tokens"]) for x in n] for f in fs]).reshape(len(fs), len(n)) for n, fs in ((na, left), (nb, right)))
    equal = np.array([[float(x == y) for y in nb] for x in na]).reshape(len(na), len(nb))
    among = np.maximum([degree(x, "tokens") for x in na], 1)[:, None] if na else np.ones((0, 1))
    beside_ = np.array([degree(y, "tokens") for y in nb])[None] if nb else np.ones((1, 0))
    score = np.where(apart, 0.0, own)
    for _ in range(ROUNDS):
        # a token stands for another as far as the fields that have them are similar
        words = np.maximum(equal, np.minimum(1, A.T @ score @ B / np.maximum(among, beside_)))
        best = lambda i, j, w=words: (w[np.ix_(A[i] > 0, B[j] > 0)].max(1).mean() + w[np.ix_(A[i] > 0, B[j] > 0)].max(0).mean()) / 2 if A[i].any() and B[j].any() else 0.0
        named = np.array([[best(i, j) for j in range(len(right))] for i in range(len(left))])
        around = np.where(kind == "plainplain", 0.25 * same + 0.75 * values, np.where(kind == "nestednested", shape * places(score), 0.0))
        new = np.where(apart, 0.0, (own + np.maximum(around, named)) / 2)
        moved = np.abs(new - score).max()
        score = new
        if moved < CONVERGED:
            break
    return score


def correspondences(left: list[dict], right: list[dict], was: list[dict] = (), now: list[dict] = ()) -> list[tuple[int, int]]:
    """One-to-one pairs that reach ``LEAST``: best score first (a stable matching), ties by the names."""
    if not left or not right:
        return []
    s = np.round(flood(left, right, was, now), 6)
    order = sorted(((-s[i, j], left[i]["field"], right[j]["field"], i, j) for i in range(len(left)) for j in range(len(right)) if s[i, j] >= LEAST))
    pairs, a, b = [], set(), set()
    for _, _, _, i, j in order:
        if i not in a and j not in b:
            pairs.append((i, j))
            a.add(i)
            b.add(j)
    return pairs


def parse_fields(records: DataFrame) -> DataFrame:
    """One row per top-level field of every readable record: file_id, line_no, field, type, shape, val.

    ``type`` is string, number, boolean, array, object, or null for a JSON null. Payloads that are null, cut off or no
    object are passed over.
    """
    v = records.where("file_id is not null").select("file_id", "line_no", F.try_parse_json("payload").alias("v")).where("v is not null and schema_of_variant(v) like 'OBJECT%'")
    v.createOrReplaceTempView("_kinetrail_variants")
    e = v.sparkSession.sql(
        "select file_id, line_no, e.key as field, schema_of_variant(e.value) as shape, e.value as val from _kinetrail_variants, lateral variant_explode(v) e where e.key is not null"
    )
    s = F.col("shape")
    kind = (
        F.when(s == "STRING", "string")
        .when(s == "BOOLEAN", "boolean")
        .when(s.startswith("ARRAY"), "array")
        .when(s.startswith("OBJECT"), "object")
        .when(s == "VOID", None)
        .otherwise("number")
    )
    return e.withColumn("type", kind)


def file_schemas(fields: DataFrame) -> DataFrame:
    """file_id, field, type (the most frequent of its values that are not null), shape, lo, hi (bounds of its values as text,
    of long ones the beginning and a hash of the whole)."""
    text = F.col("val").cast("string")
    text = F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 200), F.sha2(text, 256))).otherwise(text)
    some = F.col("type").isNotNull()
    per = fields.groupBy("file_id", "field", "type").agg(
        F.count("*").alias("n"), F.max(F.when(some, F.col("shape"))).alias("shape"), F.min(F.when(some, text)).alias("lo"), F.max(F.when(some, text)).alias("hi")
    )
    top = F.max_by(F.struct("type", "shape"), F.struct(F.col("type").isNotNull(), F.col("n"), F.col("type")))
    return per.groupBy("file_id", "field").agg(top.alias("t"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).select(
        "file_id", "field", F.col("t.type").alias("type"), F.col("t.shape").alias("shape"), "lo", "hi"
    )


def _matcher(landmarks: dict[tuple[str, ...], str]):
    def node(r) -> dict:
        shape = r.shape or ""
        lo, hi = r.lo if isinstance(r.lo, str) else None, r.hi if isinstance(r.hi, str) else None
        point = shape.startswith("OBJECT") and "likelihood" in shape or shape.startswith("ARRAY") and "STRING" not in shape or (lo or "").count(";") == 2
        return {
            "field": r.field, "canon": canonical(r.field, landmarks), "tokens": tokens(r.field), "type": r.type, "kind": "nested" if point else "plain",
            "children": re.findall(r"(\w+): ", shape), "values": [x for x in {lo, hi} if x and not point], "lo": lo, "hi": hi,
        }

    def match(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("field")
        gone = [node(r) for r in pdf[pdf["side"] == "removed"].itertuples()]
        come = [node(r) for r in pdf[pdf["side"] == "added"].itertuples()]
        was, now = ([node(r) for r in pdf[pdf["side"] == side].itertuples()] for side in ("was", "now"))
        pairs = correspondences(gone, come, was, now)
        a, b = {i for i, _ in pairs}, {j for _, j in pairs}
        rows = [(come[j]["field"], "renamed", gone[i]["field"]) for i, j in pairs]
        rows += [(x["field"], "removed", None) for i, x in enumerate(gone) if i not in a]
        rows += [(x["field"], "added", None) for j, x in enumerate(come) if j not in b]
        out = pd.DataFrame(rows, columns=["field", "change", "old_field"])
        out.insert(0, "file_id", pdf["file_id"].iloc[0])
        return out

    return match


def file_pairs(files: DataFrame) -> DataFrame:
    """file_id and prev_id, the file before it in its feed by (recorded_at, file_id); first files have none and are left out.

    Files are ordered within (feed, day) and the days of a feed are linked by their last files, so a feed that holds much
    of all files is not sorted in one task.
    """
    f = files.where("file_id is not null and feed_id is not null").groupBy("feed_id", "file_id").agg(F.min("recorded_at").alias("recorded_at"))
    f = f.withColumn("day", F.to_date("recorded_at"))
    inside = W.partitionBy("feed_id", "day").orderBy("recorded_at", "file_id")
    f = f.withColumn("prev_in_day", F.lag("file_id").over(inside))
    last = f.groupBy("feed_id", "day").agg(F.max_by("file_id", F.struct("recorded_at", "file_id")).alias("last_id"))
    last = last.select("feed_id", "day", F.lag("last_id").over(W.partitionBy("feed_id").orderBy("day")).alias("before"))
    f = f.withColumn("_d", F.coalesce(F.col("day"), F.lit("0001-01-01").cast("date")))
    last = last.withColumn("_d", F.coalesce(F.col("day"), F.lit("0001-01-01").cast("date"))).drop("day")
    out = f.join(last, ["feed_id", "_d"]).select("feed_id", "file_id", F.coalesce("prev_in_day", "before").alias("prev_id"))
    return out.where("prev_id is not null")


def schema_changes(records: DataFrame, files: DataFrame, reference: list[tuple[str, str]]) -> DataFrame:
    """file_id, field, change, old_field (of a rename), old_type, new_type (of a retyped field).

    A file without a readable record has no fields: everything of the file before it is removed, and all of the next file's
    is added. Equal names are one field. A type that is not known on one side (nulls only) is no change.
    """
    schemas = cut(file_schemas(parse_fields(records)))
    pairs = cut(file_pairs(files))
    now = pairs.select("file_id").join(schemas, "file_id").select("file_id", "field", F.struct("type", "shape", "lo", "hi").alias("b"))
    before = pairs.select("file_id", F.col("prev_id")).join(schemas.withColumnRenamed("file_id", "prev_id"), "prev_id").select("file_id", "field", F.struct("type", "shape", "lo", "hi").alias("a"))
    both = cut(now.join(before, ["file_id", "field"], "full"))
    retyped = both.where("a is not null and b is not null and a.type <> b.type").selectExpr("file_id", "field", "'retyped' as change", "cast(null as string) as old_field", "a.type as old_type", "b.type as new_type")
    loose = both.where("a is null or b is null").selectExpr("file_id", "field", "if(a is null, 'added', 'removed') as side", "coalesce(a, b) as t").select("file_id", "field", "side", "t.*")
    # where fields were both added and removed, those that stayed anchor the matching
    asked = loose.groupBy("file_id").agg(F.countDistinct("side").alias("sides")).where("sides = 2").select("file_id")
    stayed = both.where("a is not null and b is not null").join(asked, "file_id", "left_semi")
    for side, of in (("was", "a"), ("now", "b")):
        loose = loose.unionByName(stayed.select("file_id", "field", F.lit(side).alias("side"), f"{of}.*"))
    # matching is slow for its few bytes: a fixed number of partitions, which the adaptive planner leaves apart
    loose = loose.repartition(int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")), "file_id")
    matched = loose.groupBy("file_id").applyInPandas(_matcher(_landmarks(reference)), "file_id bigint, field string, change string, old_field string")
    return matched.selectExpr("*", "cast(null as string) as old_type", "cast(null as string) as new_type").unionByName(retyped)


def landmark_reference(spark, sf_dir: str) -> list[tuple[str, str]]:
    """The table of known names, some dozens of rows, for the driver."""
    return [(r.alias, r.landmark) for r in table(spark, sf_dir, "landmark_ref").select("alias", "landmark").collect()]


def p4_report(spark, sf_dir: str) -> DataFrame:
    return schema_changes(table(spark, sf_dir, "raw_record"), table(spark, sf_dir, "raw_file"), landmark_reference(spark, sf_dir))


def p4_found(spark, sf_dir: str) -> DataFrame:
    return p4_report(spark, sf_dir).select("file_id", "field", "change")


def p4_table(spark, sf_dir: str) -> DataFrame:
    return consistent_table(table(spark, sf_dir, "raw_record"), table(spark, sf_dir, "raw_file"), landmark_reference(spark, sf_dir))


def consistent_table(records: DataFrame, files: DataFrame, reference: list[tuple[str, str]]) -> DataFrame:
    """All readable records in one schema; fields that are no column and no body part go to ``other`` as JSON.

    Names are brought together by the canonical form and, where a name has none, by the renames that the report found.
    Numbers written as text are cast, with a unit after them left out; what can't be cast is null. A line sent again
    (same file, number and fields) is one row. Points of an individual other than 1 have its number behind the part
    (``nose@2``); a further field of a canonical form that the record already has goes to ``other``.
    """
    known = _landmarks(reference)
    fields = parse_fields(records)
    renames = cut(schema_changes(records, files, reference).where("change = 'renamed'").select(F.col("field").alias("to"), F.col("old_field").alias("frm")).distinct())

    @F.pandas_udf("string")
    def canon(s: pd.Series) -> pd.Series:
        def one(x: str) -> str | None:
            c = canonical(x, known)
            return f"{c}@{individual(x)}" if c and c.startswith("part:") and individual(x) != 1 else c

        return s.map(one)

    names = fields.select("field").distinct().withColumn("canon", canon("field"))
    by_rename = renames.select(F.col("to").alias("field"), canon("frm").alias("c")).unionByName(renames.select(F.col("frm").alias("field"), canon("to").alias("c")))
    by_rename = by_rename.where("c is not null").groupBy("field").agg(F.min("c").alias("c"))
    names = cut(names.join(by_rename, "field", "left").select("field", F.coalesce("canon", "c").alias("canon")))
    rows = join_dim(fields.where("type is not null").withColumn("val", F.col("val").cast("string")).distinct(), names, ["field"])
    entry = F.struct("field", "canon", "val")
    rec = rows.groupBy("file_id", "line_no").agg(F.sort_array(F.collect_list(entry)).alias("e"))
    one = lambda c: F.expr(f"get(filter(e, z -> z.canon = '{c}'), 0).val")
    number = lambda c: F.expr(f"try_cast(regexp_extract(get(filter(e, z -> z.canon = '{c}'), 0).val, '-?[0-9]+(\\\\.[0-9]+)?', 0) as double)")
    again = "exists(e, o -> o.canon = z.canon and struct(o.field, o.val) < struct(z.field, z.val))"
    names_in = F.expr("filter(transform(split(regexp_replace(get(filter(e, z -> z.canon = 'bodyparts'), 0).val, '[\\\\[\\\\]{}\"]', ''), ','), z -> trim(split(z, ':')[0])), z -> z <> '')")
    points = F.expr(
        f"map_from_entries(transform(filter(e, z -> z.canon like 'part:%' and not {again}), "
        "z -> struct(substring(z.canon, 6) as part, transform(regexp_extract_all(regexp_replace(z.val, '\"[a-z]+\":', ''), '(-?[0-9]+(?:[.][0-9]+)?(?:[eE][-+]?[0-9]+)?)', 1), q -> try_cast(q as double)) as xyl)))"
    )
    return rec.select(
        "file_id",
        "line_no",
        one("session_id").alias("session_id"),
        F.expr("coalesce(get_json_object(get(filter(e, z -> z.canon = 'source'), 0).val, '$.name'), get(filter(e, z -> z.canon = 'source'), 0).val)").alias("source"),
        one("paradigm").alias("paradigm"),
        number("fps").alias("fps"),
        number("frame").cast("bigint").alias("frame"),
        F.expr("case when lower(get(filter(e, z -> z.canon = 'is_own'), 0).val) in ('true', '1', 'yes') then true when get(filter(e, z -> z.canon = 'is_own'), 0).val is not null then false end").alias("is_own"),
        names_in.alias("bodyparts"),
        one("scorer").alias("scorer"),
        one("note").alias("note"),
        number("temp_c").alias("temp_c"),
        one("crop").alias("crop"),
        points.alias("points"),
        F.expr(f"to_json(transform(filter(e, z -> z.canon is null or {again}), z -> struct(z.field, z.val)))").alias("other"),
    )
