import math

import pytest
from pyspark.sql import functions as F

from quillet.functions import scores
from quillet.operators import metrics


def preds(spark, rows, gold):
    return spark.createDataFrame([(i, p, g) for i, (p, g) in enumerate(zip(rows, gold))], "item_id int, p array<double>, gold int")


def test_options_of_different_number(spark):
    rows, gold = [[0.7, 0.3], [0.2, 0.5, 0.2, 0.1], [0.45, 0.55]], [1, 1, 1]
    r = metrics.summary(preds(spark, rows, gold)).first()
    assert math.isclose(r["accuracy"], 2 / 3) and math.isclose(r["nll"], -math.log(0.3 * 0.5 * 0.55) / 3)
    assert math.isclose(r["brier"], (0.98 + 0.34 + 0.405) / 3)
    # one row per bin: |0.7 - 0|, |0.5 - 1|, |0.55 - 1|
    assert math.isclose(metrics.ece(preds(spark, rows, gold)).first()[0], (0.7 + 0.5 + 0.45) / 3)
    assert math.isclose(metrics.acceptance(preds(spark, rows, gold), 0.4).first()["coverage"], 1.0)


def test_an_edge_belongs_to_the_lower_bin(spark):
    # 0.5 and 0.45 share a bin, 0.51 has the next one
    got = {r["bin"]: r["n"] for r in metrics.reliability(preds(spark, [[0.5, 0.5], [0.3, 0.25, 0.45], [0.51, 0.49]], [0, 2, 0])).collect()}
    assert got == {4: 2, 5: 1}
    assert {r["bin"]: r["n"] for r in metrics.reliability(preds(spark, [[0.5, 0.5], [0.3, 0.25, 0.45]], [0, 2]), "left").collect()} == {5: 1, 4: 1}


def test_classes_without_support_or_predictions(spark):
    p = preds(spark, [[0.2, 0.7, 0.1], [0.6, 0.3, 0.1], [0.1, 0.8, 0.1], [0.1, 0.8, 0.1], [0.3, 0.6, 0.1]], [1, 0, 1, 0, 1])
    r = metrics.class_summary(p, 4).first()
    # recalls 1/2 and 1, F1 2/3 and 6/7, two labels of the four have neither
    assert math.isclose(r["majority"], 0.6) and math.isclose(r["balanced_accuracy"], 0.75) and math.isclose(r["macro_f1"], (2 / 3 + 6 / 7) / 4)


def test_ordinal_distance_and_certain_misses(spark):
    p = preds(spark, [[0.1, 0.2, 0.3, 0.4], [1.0, 0.0, 0.0, 0.0]], [1, 3])
    r = metrics.ordinal_error(p).first()
    assert math.isclose(r["expected_mae"], (1.0 + 3.0) / 2) and math.isclose(r["argmax_mae"], (2 + 3) / 2)
    s = metrics.summary(p).first()
    assert s["nll"] is None and s["zero_gold"] == 1


def test_places_and_running_sums(spark):
    df = spark.createDataFrame([(i, 0.5 if i % 3 else 0.9, i % 2) for i in range(200)], "item_id int, conf double, e int")
    got = metrics.in_order(df, F.desc("conf"), F.asc("item_id"), values=("e",)).orderBy("place").collect()
    want = sorted(((-c, i, e) for i, c, e in [(i, 0.5 if i % 3 else 0.9, i % 2) for i in range(200)]))
    run = 0
    for k, (r, (_, i, e)) in enumerate(zip(got, want)):
        run += e
        assert (r["place"], r["item_id"], r["e_run"]) == (k + 1, i, run)
    assert metrics.in_order(df.limit(0), F.asc("conf")).count() == 0


def test_automation_rate_may_cut_ties(spark):
    p = preds(spark, [[0.9, 0.1], [0.8, 0.2], [0.8, 0.2], [0.6, 0.4]], [0, 0, 1, 0])
    r = metrics.automation_rate(p, 0.05).first()
    assert (r["n"], r["accepted"], r["rate"]) == (4, 2, 0.5)
    assert metrics.automation_rate(preds(spark, [], []), 0.05).first()["rate"] == 0


def test_temperature_against_the_flat_derivative(spark):
    rows = [([2.0, 0.0], 0)] * 80 + [([2.0, 0.0], 1)] * 20
    df = spark.createDataFrame(rows, "logits array<double>, gold int")
    assert abs(metrics.temperature(df) - 2.0 / math.log(4)) < 1e-5  # softmax at 2/T equals 0.8


def test_harness_counts_errors_as_wrong(spark):
    rows = [("a", "choice", "x", {"x": 0.7, "y": 0.3}, None, None), ("b", "noul", "true", None, 0.5, None), ("c", "score", "1", {"0": 0.4, "1": 0.4, "2": 0.2}, None, None), ("d", "choice", "x", {"x": 1.0}, None, "timeout")]
    df = spark.createDataFrame(rows, "qid string, kind string, gold_key string, probabilities map<string,double>, noul double, error string")
    got = {r["qid"]: (r["prediction"], r["conf"], r["correct"], r["p_gold"]) for r in metrics.harness_rows(df).collect()}
    assert got == {"a": ("x", 0.7, 1, 0.7), "b": ("true", 0.5, 1, 0.5), "c": ("0", 0.4, 0, 0.4), "d": (None, 0.0, 0, 0.0)}
    r = metrics.harness_report(df).first()
    assert r["n"] == 4 and r["accuracy"] == 0.5 and math.isclose(r["nll"], -math.log(0.7 * 0.5 * 0.4 * 1e-12) / 4)


def test_bootstrap_interval_covers_the_mean(spark):
    rows = [(f"g{i % 50}", float((i * 7) % 3 - 1)) for i in range(600)]
    r = metrics.paired_bootstrap(spark.createDataFrame(rows, "unit string, delta double")).first()
    sums = [sum(d for u, d in rows if u == f"g{k}") for k in range(50)]
    error = (sum((s - r["delta"] * 12) ** 2 for s in sums) ** 0.5) / 600
    assert math.isclose(r["delta"], sum(d for _, d in rows) / 600) and r["improved"] == r["regressed"] == 200
    assert abs(r["high"] - r["delta"] - 1.96 * error) < 0.5 * error + 1e-3 and abs(r["delta"] - r["low"] - 1.96 * error) < 0.5 * error + 1e-3


def test_acceptance_never_cuts_ties(spark):
    p = preds(spark, [[0.9, 0.1], [0.8, 0.2], [0.8, 0.2], [0.6, 0.4]], [0, 0, 1, 0])
    r = metrics.acceptance(p, 0.05).first()
    assert (r["accepted"], r["errors"], r["threshold"]) == (1, 0, 0.9)
    assert metrics.acceptance(p, 0.05, 2).first()["threshold"] is None
    assert metrics.acceptance(preds(spark, [], [])).first()["accepted"] == 0


def test_wilson_ends(spark):
    r = metrics.apply_acceptance(preds(spark, [[0.9, 0.1]] * 10, [0] * 10), F.lit(0.5)).first()
    assert r["risk"] == 0 and r["risk_low"] == 0.0 and 0.2 < r["risk_high"] < 0.3
    assert metrics.apply_acceptance(preds(spark, [[0.9, 0.1]], [0]), F.lit(None).cast("double")).first()["risk"] is None


@pytest.mark.parametrize("row, gold", [([1.0], 0), ([0.5, 0.6], 0), ([float("nan"), 1.0], 0), ([0.5, 0.5], 2), (None, 0), ([0.5, 0.5], None)])
def test_bad_predictions_fail(spark, row, gold):
    with pytest.raises(Exception, match="bad prediction"):
        metrics.validate(preds(spark, [row], [gold])).collect()


def test_equal_count_matches_ntile(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    conf = np.round(rng.random(53) * 0.5 + 0.5, 2)
    p = preds(spark, [[float(c), 1 - float(c)] for c in conf], [0] * 53)
    got = {r["bin"]: r["n"] for r in metrics.reliability(p, "count").collect()}
    assert got == {i: len(x) for i, x in enumerate(np.array_split(np.arange(53), 10))}


def test_temperature_recovers_scale(spark):
    rows = [([2.0, 0.0], 0)] * 88 + [([2.0, 0.0], 1)] * 12
    df = spark.createDataFrame(rows, "logits array<double>, gold int")
    assert math.isclose(metrics.temperature(df), 2 / math.log(88 / 12), rel_tol=1e-3)


def test_quantiles_and_bootstrap(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 4)], "x double")
    assert [r["value"] for r in metrics.quantiles(df, "x").orderBy("q").collect()] == [1.0, 1.75, 2.0, 2.5, 4.0]
    d = spark.createDataFrame([(f"g{i % 5}", 1.0 if i % 3 else -1.0) for i in range(30)], "unit string, delta double")
    r = metrics.paired_bootstrap(d, 200).first()
    assert r["improved"] == 20 and r["regressed"] == 10 and r["low"] <= r["delta"] <= r["high"]


def test_softmax_and_ranking(spark):
    df = spark.createDataFrame([([1000.0, 1000.0], ["b", "a"])], "l array<double>, k array<string>")
    r = df.select(scores.softmax(F.col("l")).alias("p"), F.element_at(scores.ranked(F.col("l"), F.col("k")), 1)["key"].alias("best"), scores.concentration(scores.softmax(F.col("l"))).alias("c")).first()
    assert r["p"] == [0.5, 0.5] and r["best"] == "a" and r["c"] == 0.0


def test_registered_bootstrap_draws_2000_replicates(spark, monkeypatch):
    import inspect

    from quillet.plans import queries

    real, drawn = metrics.paired_bootstrap, []

    def seen(*args, **kwargs):
        bound = inspect.signature(real).bind(*args, **kwargs)
        bound.apply_defaults()
        drawn.append(bound.arguments["samples"])

    monkeypatch.setattr(queries.metrics, "paired_bootstrap", seen)
    monkeypatch.setattr(queries, "predictions", lambda *_: preds(spark, [[0.8, 0.2]], [0]).selectExpr("*", "cast(null as string) as split_group"))
    queries.a30(spark, "")
    assert drawn == [2000]
