import random

import pytest
from pyspark.sql import functions as F

from quillet.operators import assemble, graph, joins, records, retrieval, similar


def test_components_match_union_find(spark):
    rng = random.Random(3)
    pairs = [(f"n{rng.randrange(300):03}", f"n{rng.randrange(300):03}") for _ in range(170)] + [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = dict(tuple(r) for r in graph.components(spark.createDataFrame(pairs, "a string, b string")).collect())
    linked = {x for p in pairs if p[0] != p[1] for x in p}
    assert {x: got.get(x, x) for x in linked} == {x: find(x) for x in linked}


def test_components_of_nothing(spark):
    assert graph.components(spark.createDataFrame([], "a string, b string")).count() == 0


@pytest.mark.parametrize("parts", [1, 8])
def test_partition_groups_sizes(spark, parts):
    df = spark.createDataFrame([(f"g{i % 50}",) for i in range(200)], "g string").repartition(parts)
    got = records.partition_groups(df, "g", [("eval", 0.2), ("dev", 0.1), ("train", 0.6)], "7")
    assert {r["split"]: r["count"] for r in got.groupBy("split").count().collect()} == {"eval": 10, "dev": 5, "train": 30, "unassigned_group": 5}
    first = sorted(map(tuple, got.collect()))
    again = sorted(map(tuple, records.partition_groups(df.repartition(3), "g", [("eval", 0.2), ("dev", 0.1), ("train", 0.6)], "7").collect()))
    assert first == again


def test_choice_exclusions(spark):
    schema = "id int, question string, options array<string>, gold int, choice_type string"
    rows = [
        (1, "q", ["a", "b", "c", "d"], 0, None), (2, " ", ["a", "b", "c", "d"], 0, None), (3, "q", ["a", " a ", "c", "d"], 0, "single"), (4, "q", ["a", None, "c", "d"], 0, None),
        (5, "q", ["a", "b", "c", "d"], 4, None), (6, "q", ["a", "b", "c", "d"], None, None), (7, "q", ["a", "b", "c", "d"], 1, "multi"), (8, None, None, 1, None),
    ]
    got = {r["id"]: r["reason"] for r in records.route(spark.createDataFrame(rows, schema), records.choice_reasons()).collect()}
    assert got == {1: None, 2: "invalid_schema", 3: "invalid_options", 4: "invalid_schema", 5: "invalid_schema", 6: "invalid_schema", 7: "invalid_schema", 8: "invalid_schema"}


def test_grounding_of_numbers(spark):
    rows = [("10", False), ("-10", False), ("1e2", True), ("1.0", True)]
    for number, want in rows:
        df = spark.createDataFrame([("q?", f"The value is {number}", "The value is 100 or 1 units")], "q string, a string, p string")
        assert df.select(records.grounded(F.col("q"), F.col("a"), F.col("p"))).first()[0] is want, number


def test_keep_first_counts_nulls_as_a_value(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (5, None)], "id int, t string")
    got = {r["id"]: (r["retained"], r["copies"], r["reason"]) for r in records.keep_first(df, ["t"], "id").collect()}
    assert got == {1: (1, 2, None), 3: (1, 2, "duplicate_record"), 2: (2, 2, None), 5: (2, 2, "duplicate_record")}


def test_decision_checks(spark):
    f = lambda c, o, g: spark.createDataFrame([(c, o, g)], "c array<int>, o array<array<int>>, g int").select(records.decision_problem(F.col("c"), F.col("o"), F.col("g"))).first()[0]
    assert f([1], [[1], [2]], 1) is None
    assert f([], [[1], [2]], 1) == "empty_context" and f([1], [[1]], 0) == "too_few_options" and f([1], [[1], [1]], 0) == "repeated_option" and f([1], [[1], []], 0) == "empty_option" and f([1], [[1], [2]], 2) == "gold_out_of_range"


@pytest.mark.parametrize("t", [0.5, 0.6, 0.8])
def test_similar_sets_against_brute_force(spark, t):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [set(rng.sample(vocabulary[:60], rng.randrange(1, 24))) | set(rng.sample(vocabulary, 3)) for _ in range(60)]
    base += [set(rng.sample(vocabulary, n)) for n in (1, 2, 5, 8, 9, 30, 62, 63, 64, 65, 80, 120)]
    sets = list(base)
    for b in base:
        for k in (0, 1, 2, 4):
            x = set(b)
            for w in rng.sample(sorted(x), min(len(x), k)):
                x.discard(w)
                x.add(rng.choice(vocabulary))
            sets.append(x)
    rows = [(i, sorted(s)) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "id int, t array<string>")
    left, right = df.filter("id % 2 = 0").withColumnRenamed("id", "a"), df.filter("id % 2 = 1").withColumnRenamed("id", "b")
    got = {(r["a"], r["b"]) for r in joins.jaccard_join(left, right, "a", "b", "t", t).collect()}
    want = {(i, j) for i, s in enumerate(sets) if i % 2 == 0 for j, u in enumerate(sets) if j % 2 and len(s & u) >= t * len(s | u) - 1e-12}
    assert got == want and len(want) > 50


def test_similar_sets_empty(spark):
    e = spark.createDataFrame([], "a int, t array<string>")
    assert joins.jaccard_join(e, e.withColumnRenamed("a", "b"), "a", "b", "t", 0.6).count() == 0


def test_lookup_keeps_order_and_tells_misses(spark):
    rows = spark.createDataFrame([(1, ["b", "a"]), (2, ["a", "z"]), (3, [])], "id int, k array<string>")
    table = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "key string, v double")
    got = {r["id"]: (r["values"], r["found"]) for r in joins.lookup_all(rows, "id", "k", table, "key", "v").collect()}
    assert got == {1: ([2.0, 1.0], True), 2: ([1.0, None], False), 3: (None, False)}
    with pytest.raises(Exception, match="missing key"):
        joins.require_all(spark.createDataFrame([("z",)], "key string"), table, "key").collect()


def test_ring_donors_differ(spark):
    df = spark.createDataFrame([("s", f"g{i % 7}", f"t{i}") for i in range(60)] + [("one", "g", "t"), ("one", "g", "u")], "s string, g string, t string")
    for r in joins.ring_donors(df, ["s"], "g", "t", "x").collect():
        if r["s"] == "one":
            assert r["donor_group"] is None
        else:
            assert r["donor_group"] not in (None, r["g"]) and r["donor_content"] != r["t"]


def test_two_stage_prefers_and(spark):
    docs = spark.createDataFrame([(1, "alpha bravo charlie delta"), (2, "alpha bravo"), (3, "charlie zulu"), (4, "nothing here")], "id int, b string")
    post, lengths = retrieval.postings(docs, "id", F.col("b"))
    q = spark.createDataFrame([(7, ["alpha", "bravo", "charlie", "delta"]), (8, []), (9, ["missing"])], "q int, terms array<string>")
    got = [(r["q"], r["id"], r["stage"]) for r in retrieval.two_stage(q, post, lengths, "q", "id", "terms").orderBy("q", "rank").collect()]
    assert got[0] == (7, 1, "and") and {g[0] for g in got} == {7}


def test_ensemble_aligns_by_key(spark):
    rows = [("i", 0, ["a", "b"], [0.8, 0.2], "a"), ("i", 1, ["b", "a"], [0.4, 0.6], "a"), ("lonely", 0, ["a", "b"], [0.5, 0.5], "b")]
    df = spark.createDataFrame(rows, "identity string, variant int, keys array<string>, p array<double>, gold_key string")
    r = assemble.ensemble(df, 2).collect()
    assert len(r) == 1 and r[0]["prediction"] == "a" and abs(r[0]["confidence"] - 0.7) < 1e-12 and r[0]["agree"]
    with pytest.raises(Exception, match="cohorts differ"):
        assemble.ensemble(df, 2, strict=True).collect()


def test_restore_order_inverts(spark):
    df = spark.createDataFrame([([[3, 1], [1, 9], [1, 2]],)], "o array<array<int>>")
    r = df.select(assemble.canonical_order(F.col("o"), F.lit(2)).alias("i")).withColumn("v", F.array(F.lit("x"), F.lit("y"), F.lit("z"))).withColumn("b", assemble.restore_order(F.col("i"), F.col("v"))).first()
    assert r["i"] == [2, 1, 0] and r["b"] == ["z", "y", "x"]
