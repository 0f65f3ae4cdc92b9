import math

import pytest
from pyspark.sql import functions as F

from quillet.functions import scores, text
from quillet.operators import calibration
from quillet.sources import injected


def rows(spark, start, n):
    data = [(start + i, [3.0 if i % 5 else 0.5, 0.0], 0 if i % 10 else 1) for i in range(n)]
    return spark.createDataFrame(data, "id int, logits array<double>, gold int")


def test_fit_save_load(spark, tmp_path):
    a = calibration.fit(rows(spark, 0, 100), rows(spark, 1000, 100), "id", 0.05, 20, {"mode": "x"})
    assert a["accepted"] == 80 and a["errors"] == 0 and a["coverage"] == 0.8
    path = str(tmp_path / "a")
    calibration.save(spark, a, path)
    assert calibration.load(spark, path, {"mode": "x"}) == a
    with pytest.raises(ValueError, match="settings"):
        calibration.load(spark, path, {"mode": "y"})
    with pytest.raises(Exception, match="(?i)exist"):
        calibration.save(spark, a, path)
    out = calibration.apply(rows(spark, 5000, 10), a)
    assert out.filter("accepted").count() == 8
    changed = dict(a, errors=9)
    with pytest.raises(ValueError, match="risk"):
        calibration.check(changed)


def test_roles_must_be_disjoint(spark):
    with pytest.raises(ValueError, match="share id"):
        calibration.fit(rows(spark, 0, 40), rows(spark, 39, 40), "id")


def test_losses(spark):
    df = spark.createDataFrame([([0.5, 0.5], [0.9, 0.1], [0.3, -0.2], 1)], "t array<double>, p array<double>, z array<double>, g int")
    r = df.select(scores.cross_entropy(F.col("t"), F.col("p")).alias("c"), scores.divergence(F.col("t"), F.col("p")).alias("d"), scores.ordinal_loss(F.col("z"), F.col("g")).alias("o"), scores.reference_index(F.array(F.lit("a"), F.lit("b")), F.lit("b")).alias("i"), scores.reference_index(F.array(F.lit("a")), F.lit("z")).alias("j")).first()
    c = -(0.5 * math.log(0.9) + 0.5 * math.log(0.1))
    assert math.isclose(r["c"], c) and math.isclose(r["d"], c - math.log(2)) and (r["i"], r["j"]) == (1, None)
    assert math.isclose(r["o"], (math.log1p(math.exp(-0.3)) + math.log1p(math.exp(-0.2))) / 2)


def test_letters_and_tails(spark):
    df = spark.createDataFrame([(["x", "y"], [ord(c) for c in "a Question: b"])], "o array<string>, i array<int>")
    decode = F.pandas_udf(lambda s: s.map(lambda v: "".join(map(chr, v))), "string")
    r = df.select(text.lettered(F.col("o")).alias("l"), text.holds_question(F.col("i"), decode).alias("h"), text.holds_question(F.col("i"), decode, 3).alias("n")).first()
    assert r["l"] == "A. x\nB. y" and r["h"] and not r["n"]


def test_injected_source(spark):
    injected.register(spark, "numbers", "n int, part int", lambda options, part, parts: [(i, part) for i in range(int(options["upto"])) if i % parts == part])
    df = spark.read.format("numbers").option("upto", "10").option("parts", "3").load()
    assert sorted(r["n"] for r in df.collect()) == list(range(10)) and df.select("part").distinct().count() == 3


def test_evaluation_of_suites(spark):
    fitted, report = calibration.evaluate(spark, rows(spark, 0, 100), rows(spark, 1000, 100), {"one": rows(spark, 5000, 50), "two": rows(spark, 6000, 10)}, "id")
    got = {r["suite"]: r for r in report.collect()}
    assert got["one"]["n"] == 50 and got["two"]["accuracy"] == 0.9 and got["two"]["accepted"] == 8 and got["one"]["recall_4"] == 1.0
    assert fitted["provenance"]["temperature"]["rows"] == 100
    with pytest.raises(ValueError, match="share"):
        calibration.evaluate(spark, rows(spark, 0, 100), rows(spark, 1000, 100), {"one": rows(spark, 50, 10)}, "id")
