import pytest
from pyspark.sql import functions as F

from quillet.operators import decisions


def one(spark, schema, row, column):
    return spark.createDataFrame([row], schema).select(column.alias("y")).first()["y"]


def test_perturbed_numbers_change_one_number(spark):
    rows = spark.range(40).select(F.lit("from 1,200.50 to -3 mM").alias("a"), F.col("id").alias("s"))
    seen = set()
    for r in rows.select(decisions.perturb_numbers(F.col("a"), F.col("s")).alias("y")).collect():
        assert 1 <= len(r["y"]) == len(set(r["y"])) <= 3
        for got in r["y"]:
            left, right = got.removeprefix("from ").removesuffix(" mM").split(" to ")
            assert (left == "1,200.50") != (right == "-3")
            seen.add((float(left.replace(",", "")), float(right)))
    assert seen == {(x, -3.0) for x in (120.05, 600.25, 2401.0, 12005.0)} | {(1200.5, y) for y in (-0.3, -1.5, -6.0, -30.0)}
    assert set(one(spark, "a string, s int", ("it is 0", 1), decisions.perturb_numbers(F.col("a"), F.col("s")))) <= {"it is 1", "it is 2", "it is 5"}
    assert one(spark, "a string, s int", ("no number", 1), decisions.perturb_numbers(F.col("a"), F.col("s"))) == []
    assert one(spark, "a string, s int", (None, 1), decisions.perturb_numbers(F.col("a"), F.col("s"))) is None


@pytest.mark.parametrize("text, value", [("dose 1.5e-12 mol", 1.5e-12), ("0.000000001 g", 1e-9), ("N 123456789012345678901 cells", 123456789012345678901), ("6.02e23 units", 6.02e23)])
def test_perturbed_numbers_of_any_size(spark, text, value):
    for k in range(6):
        got = one(spark, "a string, s int", (text, k), decisions.perturb_number(F.col("a"), F.col("s")))
        number = next(float(w) for w in got.split() if w[0].isdigit())
        assert any(abs(number / (value * f) - 1) < 1e-12 for f in (0.1, 0.5, 2, 10))


@pytest.mark.parametrize(
    "a, b, want",
    [
        ("the dose was 5 mg daily", "the dose was 50 mg daily", ("5", "50")), ("a b c", "a x y c", ("b", "x y")), ("a b c", "a c", None), ("a b", "a b", None),
        ("a b c d e", "a x c y e", ("b c d", "x c y")), ("", "", None),
    ],
)
def test_single_edit(spark, a, b, want):
    got = one(spark, "a string, b string", (a, b), decisions.single_edit(F.col("a"), F.col("b")))
    assert (None if got is None else tuple(got)) == want


def test_edits_respect_numbers(spark):
    f = lambda e, s, d: one(spark, "e string, s string, d string", (e, s, d), decisions.apply_edit(F.col("e"), F.col("s"), F.col("d")))
    assert f("15 and 1.5 then 5 mg, 5 g", "5", "7") == "15 and 1.5 then 7 mg, 7 g" and f("a $x and b", "$x", "\\\\1$") == "a \\\\1$ and b" and f("only 15", "5", "7") is None and f("a (b) c", "(b)", "x") == "a x c"


@pytest.mark.parametrize(
    "reply, ok",
    [
        ('x {"question": " q ", "options": ["a", "b", "c", "d "], "answer": 3} y', True), ('{"question": "q", "options": ["a", "a ", "c", "d"], "answer": 0}', False),
        ('{"question": "q", "options": ["a", "b", "c"], "answer": 0}', False), ('{"question": "q", "options": ["a", "b", "c", "d"], "answer": true}', False),
        ('{"question": "q", "options": ["a", "b", "c", "d"], "answer": "1"}', False), ('{"question": " ", "options": ["a", "b", "c", "d"], "answer": 1}', False), ("no json", False), ("{broken", False), (None, False),
    ],
)
def test_parse_generated(spark, reply, ok):
    got = one(spark, "r string", (reply,), decisions.parse_generated(F.col("r")))
    assert (got is not None) is ok
    if ok:
        assert tuple(got) == ("q", ["a", "b", "c", "d"], 3)


def test_layout_shares_places(spark):
    got = one(spark, "c array<int>, o array<array<int>>", (list(range(50)), [[1] * 30, [2] * 3]), decisions.layout(F.col("c"), F.col("o"), 40))
    assert (got["ctx_cap"], got["opt_cap"], got["ctx_cut"]) == (20, 10, 30)
    assert [tuple(b) for b in got["bounds"]] == [(20, 30), (30, 33)]
    got = one(spark, "c array<int>, o array<array<int>>", ([1], [[1], [2, 3]]), decisions.layout(F.col("c"), F.col("o"), 40, True))
    assert [tuple(b) for b in got["bounds"]] == [(2, 3), (4, 6)]


def test_overflow_policies(spark):
    df = spark.createDataFrame([(1, [1, 2, 3])], "id int, ids array<int>").withColumn("b", decisions.with_budget(F.col("ids"), 2))
    assert decisions.route_overflow(df, F.col("b.dropped"), "exclude").first()["reason"] == "input_overflow"
    assert decisions.route_overflow(df, F.col("b.dropped"), "truncate").first()["b"]["ids"] == [1, 2]
    with pytest.raises(Exception, match="exceeds its budget"):
        decisions.route_overflow(df, F.col("b.dropped"), "error").collect()


def test_audit_counts_nulls_as_violations(spark):
    df = spark.createDataFrame([(1,), (None,), (-1,)], "x int")
    assert {r["check"]: r["violations"] for r in decisions.audit(df, {"positive": F.col("x") > 0}).collect()} == {"positive": 2}


def test_corrupt_argument_needs_another_value(spark):
    calls = spark.createDataFrame([(1, {"taxon": "10"}), (2, {"taxon": "20"}), (3, {"only": "x"})], "id int, args map<string,string>")
    from quillet.operators.assemble import argument_pool

    got = {r["id"]: (r["old"], r["new"]) for r in decisions.corrupt_argument(calls, "id", "args", argument_pool(calls, "args")).collect()}
    assert got == {1: ("10", "20"), 2: ("20", "10")}
