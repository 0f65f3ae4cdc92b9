import json

import pytest
from pyspark.sql import functions as F

from quillet.sources import files, remote
from quillet.streaming import incremental


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1, "t": "hello"}\n\n[1]\n{"x": 2\n{"x": 3, "t": null}\n')
    tolerant = files.read_jsonl(spark, str(tmp_path / "*.jsonl"), "x int, t string", strict=False)
    assert sorted(r["x"] for r in tolerant.collect()) == [1, 3]
    with pytest.raises(Exception, match="bad JSON line"):
        files.read_jsonl(spark, str(tmp_path), "x int, t string").collect()


def test_csv_quotes(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,"two\nlines, ""quoted"""\n')
    r = files.read_csv(spark, str(tmp_path / "a.csv")).first()
    assert r["text"] == 'two\nlines, "quoted"'


def test_dataset_never_overwrites(spark, tmp_path):
    df = spark.range(3)
    out = str(tmp_path / "d")
    excluded = spark.createDataFrame([("a",), ("a",), (None,)], "reason string")
    m = files.write_dataset({"rows": df}, out, excluded, {"seed": 7})
    digests = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in files.file_fingerprints(spark, out + "/rows/part-*").collect()}
    assert m == {"seed": 7, "rows": {"rows": 3}, "outputs": {"rows": digests}, "exclusions_by_reason": {"a": 2}} and digests
    assert json.loads(spark.read.text(out + "/manifest").first()[0]) == m
    with pytest.raises(Exception, match="(?i)exist"):
        files.write_dataset({"rows": df}, out)


def test_fingerprints_and_pairs(spark, tmp_path):
    for level in (0, 2):
        (tmp_path / f"pairs_L{level}.jsonl").write_text('{"ctx": [1, 2, 3], "ok": [1], "bad": [2]}\n{"ctx": [1], "ok": [1], "bad": [2]}\n')
    got = files.read_pairs(spark, str(tmp_path), 2)
    assert sorted((r["level"], r["ctx"]) for r in got.collect()) == [(0, [1, 2]), (2, [1, 2])]
    assert files.file_fingerprints(spark, str(tmp_path)).select("sha256").distinct().count() == 1


def test_caches(spark):
    a = spark.createDataFrame([("k", [1.0])], "key string, vec array<double>")
    b = spark.createDataFrame([("k", [1.0]), ("l", [2.0])], "key string, vec array<double>")
    assert files.merge_caches([a, b]).count() == 2
    with pytest.raises(Exception, match="conflicting vectors"):
        files.merge_caches([a, spark.createDataFrame([("k", [3.0])], a.schema)]).collect()


def test_corpus_record_falls_through(spark):
    df = spark.createDataFrame([("", "d1", "", "abs", ["x", "y"])], "id string, doc_id string, text string, abstract string, tags array<string>")
    assert tuple(files.corpus_record(df).first()) == ("d1", None, "abs", "x|y")


def test_remote_errors_stay_with_their_rows(spark):
    def score(f):
        if (f["id"] == 3).any():
            raise RuntimeError("no")
        return f.assign(p=0.5)

    got = {r["id"]: r["error"] for r in remote.score_batches(spark.range(4).repartition(4, "id"), score, "id bigint, p double").collect()}
    assert got[3] == "RuntimeError: no" and got[0] is None


def test_incremental_adds_once(spark, tmp_path):
    src, out, chk = (str(tmp_path / x) for x in ("in", "out", "chk"))
    body = " ".join(f"w{i}" for i in range(400))
    spark.createDataFrame([(1, body)], "id int, body string").write.parquet(src)
    incremental.chunk_new(spark, src, "id int, body string", out, chk, "id", "body")
    spark.createDataFrame([(1, body), (2, body)], "id int, body string").write.mode("append").parquet(src)
    incremental.chunk_new(spark, src, "id int, body string", out, chk, "id", "body")
    assert {r["id"]: r["count"] for r in spark.read.parquet(out).groupBy("id").count().collect()} == {1: 2, 2: 2}
    assert spark.read.parquet(out).filter(F.col("chunk_id") == 1).count() == 2


def test_lines_are_numbered_in_errors(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 3}\n')
    got = files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int", numbered=True)
    assert sorted((r["x"], r["line"]) for r in got.collect()) == [(1, 1), (3, 3)]
    (tmp_path / "b.jsonl").write_text('{"x": 1}\n\n{"x": 2}\nnonsense\n')
    with pytest.raises(Exception, match=r"b\.jsonl:4"):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), "x int", numbered=True).collect()


def test_fingerprints_are_streamed(spark, tmp_path):
    import hashlib

    (tmp_path / "big").write_bytes(b"x" * 3_000_001)
    (tmp_path / "none").write_bytes(b"")
    got = {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["sha256"]) for r in files.file_fingerprints(spark, str(tmp_path)).collect()}
    assert got == {"big": (3_000_001, hashlib.sha256(b"x" * 3_000_001).hexdigest()), "none": (0, hashlib.sha256(b"").hexdigest())}


def test_long_texts_in_hash_order(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text("".join(json.dumps({"text": str(i) * 210}) + "\n" for i in range(9)) + '{"text": "short"}\n')
    a = [r["text"] for r in files.read_long_texts(spark, str(tmp_path), seed="1", limit=4).collect()]
    assert len(set(a)) == 4 and a == [r["text"] for r in files.read_long_texts(spark, str(tmp_path), seed="1").limit(4).collect()]


def test_states_are_scored_at_once(spark):
    from quillet.sources import remote

    def score(f):
        answers = []
        for s, qs in zip(f["state"], f["questions"]):
            if s == "bad":
                raise ValueError("no")
            answers.append([{"qid": q["qid"], "answer": q["ask"].upper()} for q in qs if q["qid"] != "z"])
        return f.assign(answers=answers)

    df = spark.createDataFrame([("s", "a", "x"), ("s", "z", "y"), ("t", "b", "w")], "state string, qid string, ask string")
    got = {(r["state"], r["qid"]): (r["answer"], r["error"]) for r in remote.score_states(df, score, "state", "qid", ["ask"]).collect()}
    assert got == {("s", "a"): ("X", None), ("s", "z"): (None, "no answer"), ("t", "b"): ("W", None)}
    bad = spark.createDataFrame([("bad", "a", "x")], "state string, qid string, ask string")
    r = remote.score_states(bad, score, "state", "qid", ["ask"], retries=0).first()
    assert r["answer"] is None and "ValueError" in r["error"]


def test_decisions_are_checked(spark, tmp_path):
    good = {"ctx": [1], "opts": [[1], [2, 3]], "gold": 1, "kind": "choice", "qid": "q"}
    (tmp_path / "a.jsonl").write_text(json.dumps(good) + "\n")
    assert files.read_decisions(spark, str(tmp_path / "a.jsonl")).first()["gold"] == 1
    for change, why in (({"ctx": []}, "empty_context"), ({"opts": [[1]]}, "too_few"), ({"opts": [[1], [1]]}, "repeated"), ({"opts": [[1], []]}, "empty_option"), ({"gold": 2}, "out_of_range")):
        (tmp_path / "b.jsonl").write_text(json.dumps({**good, **change}) + "\n")
        with pytest.raises(Exception, match=why):
            files.read_decisions(spark, str(tmp_path / "b.jsonl")).collect()
