import math

import pytest
from pyspark.sql import functions as F

from quillet.functions import scores
from quillet.operators import guards


def test_training_data(spark):
    good = spark.createDataFrame([("choice", "ids-v2", "arc", None)], "kind string, encoding string, source string, task string")
    guards.require_training_data(good, "ids-v2")
    for change in ({"source": F.lit("GPQA")}, {"task": F.lit("gpqa_choice")}, {"kind": F.lit("noul")}, {"encoding": F.lit(None).cast("string")}):
        with pytest.raises(ValueError):
            guards.require_training_data(good.withColumns(change), "ids-v2")


def test_consistent_gold(spark):
    rows = spark.createDataFrame([("q", ["a", "b"], 0), ("q", ["b", "a"], 1), ("r", ["a", "b"], 0)], "q string, o array<string>, g int")
    guards.require_consistent_gold(rows, F.col("q"), F.col("o"), F.col("g"))
    with pytest.raises(ValueError, match="conflicting"):
        guards.require_consistent_gold(rows.withColumn("g", F.lit(0)), F.col("q"), F.col("o"), F.col("g"))


def test_settings():
    c = {"inference": {"head_kind": "attnpool", "layers": "1,3", "n_layers": 2}, "r2_mode": "spanpool", "meta": {"canonical": True, "decision_type": "score"}, "model_config": {"seq_len": 768}}
    s = guards.inference_settings(c)
    assert s == {"head_kind": "attnpool", "mode": "spanpool", "layers": [1, 3], "canonical_order": True, "strict_inputs": None, "decision_type": "score", "encoding": None, "seq_len": 768}
    assert guards.inference_settings({})["layers"] == [-1] and guards.inference_settings({}, mode="spanpool")["mode"] == "spanpool"
    for kwargs in ({"mode": "marker"}, {"canonical": False}, {"decision_type": "noul"}, {"layers": [2, 3]}):
        with pytest.raises(ValueError, match="conflicts"):
            guards.inference_settings(c, **kwargs)
    for bad in ({"head_kind": "attnpool"}, {"head_kind": "other"}, {"head_kind": "attnpool", "mode": "spanpool", "n_layers": 3}, {"meta": [1]}):
        with pytest.raises(ValueError):
            guards.inference_settings(bad)


def test_promotion(spark):
    preds = spark.createDataFrame([(r, i % 4, 0) for r in ("a", "b") for i in range(8)], "report string, prediction int, gold int")
    reports = spark.createDataFrame([("a", "d", True, 8, 0.25), ("b", "d", True, 8, 0.25)], "report string, digest string, verified boolean, n int, accuracy double")
    assert guards.promotion(reports, preds, "d", 8) == {"launch": True, "threshold": 0.38, "accuracies": [0.25, 0.25]}
    assert not guards.promotion(reports, preds, "d", 8, 0.2)["launch"]
    for change, match in (({"accuracy": F.lit(0.5)}, "disagrees"), ({"verified": F.lit(False)}, "partial"), ({"digest": F.lit("x")}, "partial"), ({"n": F.lit(7)}, "partial")):
        with pytest.raises(ValueError, match=match):
            guards.promotion(reports.withColumns(change), preds, "d", 8)
    with pytest.raises(ValueError, match="invalid"):
        guards.promotion(reports, preds.withColumn("gold", F.lit(4)), "d", 8)


def test_bound_files_and_prediction_files(spark, tmp_path):
    import hashlib

    (tmp_path / "head").write_text("x")
    path = str(tmp_path / "head")
    guards.bound_files(spark, [(path, hashlib.sha256(b"x").hexdigest())])
    with pytest.raises(ValueError, match="not the file"):
        guards.bound_files(spark, [(path, "0")])
    a = spark.createDataFrame([("g1", ["x", "y"], "x"), ("g2", ["x", "y"], "y")], "g string, k array<string>, gold string")
    args = (F.col("g"), F.col("k"), F.col("gold"))
    guards.prediction_files({"a": a, "b": a.withColumn("k", F.reverse("k"))}, *args)
    for other, match in ((a.filter("g = 'g1'"), "cohorts"), (a.unionAll(a), "repeated"), (a.withColumn("gold", F.lit("x")), "conflicting")):
        with pytest.raises(ValueError, match=match):
            guards.prediction_files({"a": a, "b": other}, *args)


def test_lineage_and_zip(spark):
    df = spark.createDataFrame([(1, "d", None, "t"), (2, None, "s", None)], "id int, doi string, source string, type string")
    assert {tuple(r) for r in guards.lineage(df, "u", "none").collect()} == {("d", "u", "t"), (None, "s", "none")}
    z = guards.zip_rows([df.select("id"), spark.range(5)], ["id", "id"], ["a", "b"])
    assert sorted((r["place"], r["a"]["id"], r["b"]["id"]) for r in z.collect()) == [(1, 1, 0), (2, 2, 1)]


def test_pools_readouts_and_losses(spark):
    df = spark.createDataFrame([([[1.0, 2.0], [3.0, 6.0]], [0.0, 0.0], [0.2, 0.3, 0.5], [0.1, -0.2, 0.4])], "v array<array<double>>, q array<double>, p array<double>, l array<double>")
    r = df.select(
        scores.mean_pool(F.col("v"), F.lit(0), F.lit(2)).alias("m"), scores.mean_pool(F.col("v"), F.lit(1), F.lit(1)).alias("none"), scores.attention_pool(F.col("v"), F.col("q")).alias("a"),
        scores.token_readout(F.array(F.lit(-1.0), F.lit(-2.0))).alias("t"), scores.ordinal_cross_entropy(F.col("p"), F.lit(1)).alias("o"), scores.argmax_canonical(F.array(F.lit(0.4), F.lit(0.4), F.lit(0.2)), F.array(F.lit(1), F.lit(0), F.lit(2))).alias("c"),
        scores.distillation(F.col("p"), F.col("l"), 2.0).alias("d"),
    ).first()
    assert r["m"] == [2.0, 4.0] and r["none"] is None and r["a"] == [2.0, 4.0] and tuple(r["t"]) == (-3.0, -1.5) and r["c"] == 1
    assert math.isclose(r["o"], -(math.log(0.8) + math.log(0.5)) / 2)
    e = [math.exp(x / 2) for x in (0.1, -0.2, 0.4)]
    assert math.isclose(r["d"], sum(p * math.log(p / (x / sum(e))) for p, x in zip((0.2, 0.3, 0.5), e)) / 3 * 4, rel_tol=1e-9)
    with pytest.raises(Exception, match="different single ids"):
        df.select(scores.label_readout(F.array(F.array(F.lit(1)), F.array(F.lit(1))), F.create_map(F.lit(1), F.lit(0.0)))).collect()


def test_encoded_requests_and_their_audit(spark):
    from quillet.operators import decisions

    rows = [
        ("a", "st", "choice", "ask", [("x", None), ("y", "why")], "g1"), ("b", "st", "noul", "ask", None, "g2"), ("c", "st", "noul", "ask", [("false", "bad"), ("true", "good")], "g2"), ("d", "", "score", "ask", [("0", "low"), ("1", "high")], "g3"),
        ("e", "st", "choice", "ask", [("x", None)], "g4"), ("f", "st", "odd", "ask", None, "g4"), ("g", "st", "noul", " ", None, "g4"),
    ]
    df = spark.createDataFrame(rows, "qid string, state string, kind string, instructions string, criteria array<struct<key:string,description:string>>, split_group string")
    got = {r["qid"]: r for r in decisions.encode_requests(df, lambda t: list(t.encode()), 640, 8, "truncate").collect()}
    said = lambda q: [bytes(o).decode() for o in got[q]["opts"]]
    assert bytes(got["a"]["ctx"]).decode() == "st\nQuestion: ask" and said("a") == ["x", "y: why"] and got["a"]["option_keys"] == ["x", "y"]
    assert said("b") == ["yes", "no"] and said("c") == ["yes: goo", "no: bad"] and got["c"]["opt_dropped"] == [1, 0] and got["c"]["option_keys"] == ["true", "false"] and said("d") == ["low", "high"] and got["d"]["option_keys"] == ["0", "1"]
    assert all(got[q]["reason"] == "invalid_question" and got[q]["opts"] is None for q in "efg") and got["a"]["reason"] is None
    assert {r["qid"] for r in decisions.encode_requests(df, lambda t: list(t.encode()), 640, 8, "exclude").filter("reason = 'input_overflow'").collect()} == {"c"}
    enc = decisions.encode_requests(df.filter("qid in ('a', 'b', 'd')"), lambda t: list(t.encode()))
    a, b = enc.filter("qid = 'a'"), enc.filter("qid <> 'a'")
    assert guards.audit_battery({"train": a, "eval": b}, 2, {"eval": 2}) == {"train": 1, "eval": 2}
    for splits, options, sizes, match in (({"train": a, "eval": b}, 4, None, "options"), ({"train": a, "eval": a}, 2, None, "qid"), ({"train": a, "eval": b}, 2, {"eval": 3}, "size"), ({"train": a, "eval": b.withColumn("split_group", F.lit("g1"))}, 2, None, "two splits")):
        with pytest.raises(ValueError, match=match):
            guards.audit_battery(splits, options, sizes)


def test_item_rows(spark):
    df = spark.createDataFrame([("a", ["x", "y"], "y"), ("b", ["x"], "x")], "qid string, options array<string>, label string")
    assert {r["qid"]: r["gold"] for r in guards.item_rows(df).collect()} == {"a": 1, "b": 0}
    with pytest.raises(Exception, match="no option"):
        guards.item_rows(df.withColumn("label", F.lit("z"))).collect()
    with pytest.raises(ValueError, match="repeated"):
        guards.item_rows(df.unionAll(df))
