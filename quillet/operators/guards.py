"""Assertions over datasets, reports and checkpoints, settings, and joins by position."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.operators import assemble, graph, metrics, records
from quillet.sources import files

# Columns that tell where a row comes from.
LINEAGE = (
    *graph.DOCUMENT_KEYS, *graph.GROUP_KEYS, "pid", "source", "source_file", "source_line", "source_row", "source_id", "claim_id", "group_scope",
    "content_hash", "sample_id", "filter_policy", "duplicate_sources", "meta", "split",
)

# How a head for each kind of decision is trained.
RECIPES = [
    ("choice", True, "spanpool", True, 1, "attnpool", 2000, 3e-4, 200, 1, 0.0), ("noul", True, "spanpool", True, 1, "mlp", 3000, 3e-4, 200, 1, 0.0),
    ("score", True, "spanpool", True, 1, "mlp", 3000, 3e-4, 200, 1, 1.0),
]
RECIPE = "kind string, freeze boolean, mode string, canonical_order boolean, orders int, head_kind string, steps int, head_lr double, warmup int, accum int, ordinal double"


def first_violation(df: DataFrame, bad: Column, message: str) -> None:
    """Fails if any row is bad (null counts as not bad); reads no further than the first one."""
    if df.filter(F.coalesce(bad, F.lit(False))).limit(1).count():
        raise ValueError(message)


def require_training_data(rows: DataFrame, encoding: str, forbidden: str = "gpqa") -> None:
    """Fails if a row's source is `forbidden` or its task begins with it, or if a row is no choice in `encoding`."""
    have = set(rows.columns)
    text = lambda c: F.lower(F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in have else F.lit("")
    first_violation(rows, (text("source") == forbidden) | text("task").startswith(forbidden), f"{forbidden} is forbidden in training and model selection")
    first_violation(rows, ~(text("kind") == "choice") | ~(text("encoding") == encoding.lower()), f"training needs choice rows in encoding {encoding}")


def require_consistent_gold(rows: DataFrame, question: Column, options: Column, gold: Column) -> None:
    """Fails if one effective input (question and set of options) has several right options."""
    keyed = rows.select(records.input_identity(question, options).alias("k"), F.get(options, gold).alias("g"))
    if records.conflicts(keyed, "k", "g").limit(1).count():
        raise ValueError("identical effective input has conflicting gold options")


def lineage(rows: DataFrame, default_source: str, reasoning_type: str) -> DataFrame:
    """The LINEAGE columns that rows have, with source (default_source where null or absent) and reasoning_type (else type,
    else the given one)."""
    have = set(rows.columns)
    kept = [c for c in LINEAGE if c in have and c != "source"]
    kind = [F.col(c) for c in ("reasoning_type", "type") if c in have]
    source = F.coalesce(F.col("source"), F.lit(default_source)) if "source" in have else F.lit(default_source)
    return rows.select(*kept, source.alias("source"), F.coalesce(*kind, F.lit(reasoning_type)).alias("reasoning_type"))


def zip_rows(frames: list[DataFrame], order: list[str], names: list[str]) -> DataFrame:
    """Row i of every table side by side, as structs by name with `place`, as many as the shortest table has. order: a
    column of each table that orders it totally."""
    out = None
    for df, by, name in zip(frames, order, names):
        part = metrics.in_order(df.select(F.struct(*df.columns).alias(name), F.col(by).alias("_by")), F.asc("_by")).select("place", name)
        out = part if out is None else out.join(part, "place")
    return out


def resolve(stored: list[dict], name: str, given=None, default=None, allowed=None, aliases: tuple[str, ...] = ()):
    """A setting: the given value, else the first stored one that is not None (by name, then aliases, in order of the
    containers), else the default. A given value that contradicts the stored one fails, so does one that is not allowed."""
    old = next((c[n] for c in stored for n in (name, *aliases) if c.get(n) is not None), None)
    for value in (old, given):
        if value is not None and allowed is not None and value not in allowed:
            raise ValueError(f"{name} must be one of {sorted(allowed)}")
    if given is not None and old is not None and given != old:
        raise ValueError(f"{name} conflicts with the stored settings")
    return given if given is not None else old if old is not None else default


def inference_settings(checkpoint: dict, **given) -> dict:
    """Settings of a checkpoint from its containers `inference`, the top level and `meta`, against those given: head_kind, mode,
    layers, canonical_order, strict_inputs, decision_type, encoding, seq_len."""
    boxes = []
    for box in (checkpoint.get("inference") or {}, checkpoint, checkpoint.get("meta") or {}):
        if not isinstance(box, dict):
            raise ValueError("settings must be objects")
        boxes.append(box)
    head = resolve(boxes, "head_kind", None, "mlp", ("mlp", "attnpool"))
    count = resolve(boxes, "n_layers")
    layers = [-1]
    if head == "attnpool":
        lists = [{k: [int(x) for x in v.split(",")] if isinstance(v, str) else list(v) if isinstance(v, (list, tuple)) else v for k, v in b.items() if k in ("layers", "layers_list", "r2_layers")} for b in boxes]
        layers = resolve(lists, "layers", given.get("layers"), None, None, ("layers_list", "r2_layers"))
        if layers is None and count is not None and count > 1:
            raise ValueError("several layers need their indexes")
        layers = layers or [-1]
        if count is not None and len(layers) != count:
            raise ValueError("layers don't agree with n_layers")
    mode = resolve(boxes, "mode", given.get("mode"), "marker", ("marker", "spanpool"), ("r2_mode",))
    if head == "attnpool" and mode != "spanpool":
        raise ValueError("attnpool needs spanpool mode")
    more = [*boxes, checkpoint.get("training_data") or {}]
    return {
        "head_kind": head, "mode": mode, "layers": layers, "canonical_order": resolve(boxes, "canonical_order", given.get("canonical"), False, (True, False), ("canonical",)),
        "strict_inputs": resolve(boxes, "strict_inputs", given.get("strict"), None, (True, False), ("strict",)), "decision_type": resolve(boxes, "decision_type", given.get("decision_type"), None, ("choice", "noul", "score")),
        "encoding": resolve(more, "encoding"), "seq_len": resolve([*boxes, checkpoint.get("model_config") or {}], "seq_len"),
    }


def recipes(spark: SparkSession) -> DataFrame:
    """One row per kind of decision: how its head is trained. Join it with broadcast()."""
    return spark.createDataFrame(RECIPES, RECIPE)


def bound_files(spark: SparkSession, manifest: list[tuple[str, str]]) -> None:
    """Fails unless every (path, sha256) of a manifest is a file with that digest; files are hashed where they are read."""
    got = {r["path"].removeprefix("file:").replace("//", "/"): r["sha256"] for r in files.file_fingerprints(spark, [p for p, _ in manifest]).collect()}
    for path, digest in manifest:
        if got.get(path.removeprefix("file:").replace("//", "/")) != digest:
            raise ValueError(f"{path} is not the file that the manifest names")


def promotion(reports: DataFrame, predictions: DataFrame, expected: str, rows: int, threshold: float = 0.38) -> dict:
    """Whether to go on: reports (report, digest, verified, n, accuracy) must all be of the expected input, verified and of
    `rows` rows, and agree with the accuracy recomputed from predictions (report, prediction, gold, both 0 to 3). launch if the
    best accuracy is below the threshold. A report is one row, so their number is that of runs."""
    if not 0 < threshold < 1:
        raise ValueError("threshold must be between zero and one")
    first_violation(predictions, F.col("prediction").isNull() | F.col("gold").isNull() | ~F.col("prediction").between(0, 3) | ~F.col("gold").between(0, 3), "invalid predictions")
    measured = predictions.groupBy("report").agg(F.count(F.lit(1)).alias("m"), F.avg((F.col("prediction") == F.col("gold")).cast("int")).alias("acc"))
    got = reports.join(measured, "report", "left").orderBy("report").collect()
    if not got:
        raise ValueError("no reports")
    for r in got:
        if r["digest"] != expected or not r["verified"] or r["n"] != rows or r["m"] != rows:
            raise ValueError(f"report {r['report']} is partial or of another cohort")
        if r["accuracy"] is None or not 0 <= r["accuracy"] <= 1 or not math.isclose(r["acc"], r["accuracy"], abs_tol=1e-10):
            raise ValueError(f"report {r['report']} disagrees with its predictions")
    accuracies = [float(r["accuracy"]) for r in got]
    return {"launch": max(accuracies) < threshold, "threshold": threshold, "accuracies": accuracies}


def prediction_files(frames: dict[str, DataFrame], group: Column, keys: Column, gold: Column) -> None:
    """Fails unless all prediction tables have the same rows: identities (group and option keys) once each in every table, and
    one gold key each."""
    union = None
    for name, df in frames.items():
        part = df.select(assemble.prediction_identity(group, keys).alias("identity"), gold.alias("gold"), F.lit(name).alias("variant"))
        union = part if union is None else union.unionByName(part)
    stats = union.groupBy("identity").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("variant").alias("v"), F.min("gold").alias("lo"), F.max("gold").alias("hi"))
    first_violation(stats, F.col("n") != F.col("v"), "repeated identity")
    first_violation(stats, F.col("v") != len(frames), "prediction cohorts differ")
    first_violation(stats, F.col("lo") != F.col("hi"), "conflicting gold")


def audit_battery(splits: dict[str, DataFrame], options: int, sizes: dict[str, int] | None = None) -> dict[str, int]:
    """Rows per split (opts, ctx_dropped, opt_dropped, qid, split_group), failing unless every row has that many options and was not
    cut, qids are unique, no group is in two splits, and splits named in `sizes` have those sizes. Splits are a handful."""
    union, counts = None, {}
    for name, df in splits.items():
        cut_ = (F.col("ctx_dropped") > 0) | F.exists("opt_dropped", lambda x: x > 0)
        first_violation(df, (F.size("opts") != options) | cut_ | F.col("opts").isNull(), f"unexpected options or truncation in {name}")
        part = df.select("qid", "split_group", F.lit(name).alias("role"))
        union = part if union is None else union.unionByName(part)
    counts = {r["role"]: r["count"] for r in union.groupBy("role").count().collect()}
    counts = {name: counts.get(name, 0) for name in splits}
    first_violation(union.groupBy("qid").count(), F.col("count") > 1, "repeated qid")
    spans = union.filter("split_group is not null").groupBy("split_group").agg(F.min("role").alias("a"), F.max("role").alias("b"))
    first_violation(spans, F.col("a") != F.col("b"), "a group is in two splits")
    for name, n in (sizes or {}).items():
        if counts.get(name) != n:
            raise ValueError(f"unexpected size of {name}: {counts.get(name)}")
    return counts


def item_rows(df: DataFrame, qid: str = "qid", options: str = "options", label: str = "label") -> DataFrame:
    """Choice items with gold, the label's index; fails on a label that is no option (in the query) and on a repeated qid
    (before it)."""
    first_violation(df.groupBy(qid).count(), F.col("count") > 1, "repeated qid")
    at = F.array_position(options, F.col(label)).cast("int") - 1
    bad = F.raise_error(F.concat(F.lit("label is no option: "), F.col(qid).cast("string"))).cast("int")
    return df.withColumn("gold", F.when(F.coalesce(at, F.lit(-1)) < 0, bad).otherwise(at))
