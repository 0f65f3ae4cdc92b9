import random

from pyspark.sql import functions as F

from quillet.llm import splits
from quillet.operators import graph

SCI = "rec_id bigint, pid string, passage string, q string, a string, type string, document_id string, source string, node string"
QA = "item_id bigint, split_group string, source string, source_id string, ties string"


def brute(rows, ident, named, keys):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    def tie(a, b):
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)

    node = {}
    for r in rows:
        n = named(r)
        node[r[ident]] = "0" + n if n is not None else "1" + str(r[ident]).zfill(20)
        find(node[r[ident]])
    for k in keys:
        seen = {}
        for r in rows:
            v = k(r)
            if v is not None:
                tie(seen.setdefault(v, node[r[ident]]), node[r[ident]])
    out = {i: find(n) for i, n in node.items()}
    return out


def squeeze(s):
    return None if s is None else "".join(s.split())


def test_groups_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    for i in range(400):
        rows.append({
            "rec_id": i, "pid": rng.choice([None, *[f"P{rng.randrange(150)}"] * 6]), "source": rng.choice(["s1", "s2", None]),
            "document_id": rng.choice([None, "", "  \t", f"D{rng.randrange(120)}", f"D{rng.randrange(400)}"]),
            "passage": rng.choice([None, f"p {rng.randrange(500)} x", f"p{rng.randrange(500)}  x"]), "node": "clash",
        })
    df = spark.createDataFrame([tuple(r.get(c.split()[0]) for c in SCI.split(", ")) for r in rows], SCI)
    got = {r["rec_id"]: r["group_root"] for r in splits.related_decisions(df).collect()}
    want = brute(rows, "rec_id", lambda r: None if r["pid"] is None else f"{r['source'] or ''}|{r['pid']}", [lambda r: (r["document_id"] or "").strip() and r["document_id"] or None, lambda r: squeeze(r["passage"])])
    assert got == want


def test_hot_entity_takes_the_broadcast_way(spark, monkeypatch):
    monkeypatch.setattr(graph, "hot_threshold", lambda rows, least=0: 5)
    rows = [(i, f"g{i}" if i % 3 else "hot", "s", "same" if i % 2 else f"x{i}", None) for i in range(120)]
    got = {r["item_id"]: (r["group_root"], r["group_size"]) for r in splits.related_choices(spark.createDataFrame(rows, QA)).collect()}
    want = brute([dict(zip(["item_id", "split_group", "source", "source_id"], r)) for r in rows], "item_id", lambda r: r["split_group"], [lambda r: r["source_id"] if r["source"] else None])
    assert {i: g for i, (g, _) in got.items()} == want
    assert len(got) == 120


def test_splits_hold_for_records_with_a_giant_group(spark):
    df = spark.range(6000).select(F.when(F.col("id") < 2000, "giant").otherwise(F.concat(F.lit("g"), (F.col("id") % 1500).cast("string"))).alias("group_root"))
    sized = df.join(df.groupBy("group_root").agg(F.count(F.lit(1)).alias("group_size")), "group_root")
    out = splits.assign_splits(sized, splits.SHARES)
    assert out.select("group_root", "split").distinct().count() == df.distinct().count()
    share = {r["split"]: r["count"] / 6000 for r in out.groupBy("split").count().collect()}
    assert abs(share["train"] - 0.65) < 0.03 and abs(share["dev"] - 0.15) < 0.03 and abs(share["eval"] - 0.2) < 0.03


def test_empty_tables(spark):
    assert splits.related_decisions(spark.createDataFrame([], SCI)).count() == 0
    empty = splits.related_choices(spark.createDataFrame([], QA))
    assert splits.assign_splits(empty, splits.SHARES).count() == 0


def test_all_null_records_stay_alone(spark):
    got = splits.related_choices(spark.createDataFrame([(1, None, None, None, None), (2, None, "s", None, None)], QA)).collect()
    assert sorted((r["item_id"], r["group_size"]) for r in got) == [(1, 1), (2, 1)]
