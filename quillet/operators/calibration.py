"""Calibration artifacts: fitted on disjoint rows, checked, saved once and verified on loading."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions import scores
from quillet.operators import metrics, retrieval

FIELDS = ("temperature", "budget", "threshold", "n", "accepted", "errors", "coverage", "risk", "settings")


def disjoint(a: DataFrame, b: DataFrame, key: str, names: tuple[str, str]) -> None:
    """Fails if a key is in both (a semi join that stops at the first hit)."""
    hit = a.select(key).join(b.select(key), key, "left_semi").take(1)
    if hit:
        raise ValueError(f"{names[0]} and {names[1]} share {key} {hit[0][0]!r}")


def content(rows: DataFrame, key: str) -> dict:
    """Number of rows and a hash of their key, logits and gold that doesn't depend on order: one aggregate."""
    r = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(key, "logits", "gold").cast("decimal(38,0)")).alias("h")).first()
    return {"rows": r["n"], "hash": str(r["h"] or 0)}


def _digest(body: dict) -> str:
    return hashlib.sha256(json.dumps(body, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def fit(temperature_rows: DataFrame, acceptance_rows: DataFrame, key: str, budget: float = 0.05, least: int = 20, settings: dict | None = None) -> dict:
    """(key, logits, gold) of two disjoint sets of rows -> an artifact: the temperature fitted on the first, the acceptance
    threshold on the second at that temperature, what rows these were (provenance: number and content hash) and a digest of
    it all. Rows that change while they are fitted on fail."""
    disjoint(temperature_rows, acceptance_rows, key, ("temperature rows", "acceptance rows"))
    inputs = {"temperature": content(temperature_rows, key), "acceptance": content(acceptance_rows, key)}
    t = metrics.temperature(temperature_rows)
    rule = metrics.acceptance(acceptance_rows.withColumn("p", scores.softmax(F.col("logits"), t)), budget, least).first().asDict()
    if inputs != {"temperature": content(temperature_rows, key), "acceptance": content(acceptance_rows, key)}:
        raise ValueError("the rows changed while they were fitted on")
    body = {"temperature": t, "budget": budget, "settings": settings or {}, "provenance": inputs, **rule}
    check(body)
    return {**body, "digest": _digest(body)}


def check(a: dict) -> None:
    """Fails unless the figures of an artifact agree with each other."""
    n, k, e = a["n"], a["accepted"], a["errors"]
    problems = [
        ("temperature", not a["temperature"] > 0), ("counts", not 0 <= e <= k <= n), ("threshold", (a["threshold"] is None) != (k == 0)),
        ("coverage", n > 0 and abs(a["coverage"] - k / n) > 1e-9), ("risk", k > 0 and (abs(a["risk"] - e / k) > 1e-9 or a["risk"] > a["budget"] + 1e-9)),
    ]
    bad = [name for name, wrong in problems if wrong]
    if bad:
        raise ValueError("inconsistent artifact: " + ", ".join(bad))


def save(spark: SparkSession, artifact: dict, path: str) -> None:
    """Writes an artifact; an existing one is never overwritten."""
    check(artifact)
    spark.createDataFrame([(json.dumps(artifact, sort_keys=True),)], "value string").coalesce(1).write.mode("errorifexists").text(path)


def load(spark: SparkSession, path: str, settings: dict | None = None) -> dict:
    """Reads an artifact; fails if its digest, its figures or its settings don't fit."""
    a = json.loads(spark.read.text(path).first()[0])
    digest = a.pop("digest")
    if _digest(a) != digest:
        raise ValueError("artifact was changed after it was written")
    check(a)
    if settings is not None and a["settings"] != settings:
        raise ValueError("artifact was fitted with other settings")
    return {**a, "digest": digest}


def apply(df: DataFrame, artifact: dict) -> DataFrame:
    """Adds p (at the artifact's temperature), conf, pred and accepted to rows with logits."""
    out = df.withColumn("p", scores.softmax(F.col("logits"), float(artifact["temperature"]))).withColumn("conf", F.array_max("p")).withColumn("pred", scores.argmax_first(F.col("p")))
    limit = artifact["threshold"]
    return out.withColumn("accepted", F.lit(False) if limit is None else F.col("conf") >= float(limit))


def evaluate(spark: SparkSession, temperature_rows: DataFrame, acceptance_rows: DataFrame, suites: dict[str, DataFrame], key: str, budget: float = 0.05, least: int = 20) -> tuple[dict, DataFrame]:
    """From logits to a report: fits an artifact, fails if a suite shares a key with the rows it was fitted on, and gives per
    suite n, accuracy, NLL, Brier score, calibration error, mean reciprocal rank, recall at 1 and 4, and how the acceptance rule
    does there. Suites are a handful of named tables; each is one row of the report."""
    fitted = fit(temperature_rows, acceptance_rows, key, budget, least)
    report = None
    for name, rows in suites.items():
        disjoint(rows, temperature_rows, key, (name, "temperature rows"))
        disjoint(rows, acceptance_rows, key, (name, "acceptance rows"))
        p = rows.withColumn("p", scores.softmax(F.col("logits"), float(fitted["temperature"])))
        accepted = F.lit(None).cast("double") if fitted["threshold"] is None else F.lit(float(fitted["threshold"]))
        rule = metrics.apply_acceptance(p, accepted).select("accepted", "errors", "coverage", "risk")
        one = metrics.summary(p).select("n", "accuracy", "nll", "brier").crossJoin(metrics.ece(p)).crossJoin(retrieval.recall(p, "p", "gold", (1, 4)).drop("n")).crossJoin(rule)
        one = one.select(F.lit(name).alias("suite"), "*")
        report = one if report is None else report.unionByName(one)
    return fitted, report
