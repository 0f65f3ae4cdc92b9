import pytest
from pyspark.sql import functions as F

from quillet.operators import builders, graph, joins

SCI = "rec_id bigint, passage string, q string, a string, source string, split string, split_group string, wrong string"


def sci(spark, n=24):
    rows = [(i, f"Passage {i // 4} tells of 5 mM.", f"What is {i}?", f"The value is {i} mM" if i % 2 else f"word{i} only", "s", "train", f"g{i // 4}", "clash") for i in range(n)]
    rows += [(90, "p", "q", None, "s", "train", "g0", ""), (91, " Passage 0 tells of  5 mM. ", "What is 1?", "The value is 1 mM", "s", "train", "g0", ""), (92, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCI)


@pytest.mark.parametrize("hard", [False, True])
def test_scientific_battery(spark, hard):
    made, lost = builders.scientific_battery(sci(spark), hard=hard)
    rows, lost = made.collect(), lost.collect()
    right = {r["rec_id"]: r["a"] for r in sci(spark).collect()}
    assert {(r["rec_id"], r["reason"]) for r in lost if r["kind"] is None} == {(90, "invalid_qa_schema"), (92, "invalid_qa_schema"), (91, "duplicate_qa")}
    assert len({r["qid"] for r in rows}) == len(rows)
    choice = [r for r in rows if r["kind"] == "choice"]
    short = {r["rec_id"] for r in lost if r["reason"] == "insufficient_unique_distractors"}
    assert {r["rec_id"] for r in choice} | short == set(range(24)) and not {r["rec_id"] for r in choice} & short
    same = lambda i, o: any(right[j] == o for j in range(24) if j // 4 == i // 4)
    for r in choice:
        assert len(set(r["options"])) == 4 and r["options"][r["gold"]] == right[r["rec_id"]] and r["state"].endswith(f"Question: What is {r['rec_id']}?")
        if hard:  # nothing from other passages but numbers of its own
            assert all(same(r["rec_id"], o) or o.startswith("The value is") for o in r["options"])
    for kind, golds in (("noul", {0, 1, 1}), ("score", {2, 1, 0})):
        of = [r for r in rows if r["kind"] == kind and r["rec_id"] == 1]
        assert len(of) == 3 and {r["gold"] for r in of} == golds
        assert {r["state"].split("Proposed answer: ")[1] for r in of if r["gold"] == (0 if kind == "noul" else 2)} == {"The value is 1 mM"}
    empty, none = builders.scientific_battery(sci(spark).limit(0))
    assert empty.count() == 0 and none.count() == 0


def calls(spark):
    one = lambda t, **a: [{"tool": t, "args": a}]
    rows = [(1, "find ten", one("find", taxon="10")), (2, "find twenty", one("find", taxon="20")), (3, "odd", one("other", x="1")), (4, "two", one("find", a="1") * 2), (5, " find  ten ", one("find", taxon="10")), (6, "which", one("find", b="1")), (7, "which", one("show", b="1")), (8, None, one("show", b="1")), (9, "none", None), (10, "bare", one("show"))]
    return spark.createDataFrame(rows, "id int, prompt string, gold array<struct<tool:string,args:map<string,string>>>")


def test_tool_battery(spark):
    made, lost = builders.tool_battery(calls(spark), ["find", "show", "list"])
    reasons = {}
    for r in lost.collect():
        reasons[r["id"]] = r["reason"]
    assert reasons == {3: "unknown_tool", 4: "multiple_gold_calls", 5: "duplicate_request", 6: "ambiguous_prompt_reference", 7: "ambiguous_prompt_reference", 8: "invalid_prompt", 9: "invalid_prompt", 10: "insufficient_argument_pool"}
    rows = {(r["qid"]): r for r in made.collect()}
    assert rows["choice_1"]["options"][rows["choice_1"]["gold"]] == "find" and rows["score_1_0"]["state"] == "Request: find ten\nProposed call: find(taxon=10)"
    assert rows["score_1_2"]["state"].endswith("find(taxon=20)") and rows["score_1_2"]["gold"] == 1 and rows["noul_2_1"]["gold"] == 1
    assert "show()" in rows["noul_10_0"]["state"] and "noul_10_2" not in rows


def test_converters(spark):
    rows = [(1, "Q", "a", "b", "c", "d"), (2, " Q", "a ", "d", "c", "b"), (3, "R", "a", " a", "c", "d"), (4, "S", None, "b", "c", "d"), (5, "T", "a", "b", "c", " \t")]
    made, lost = builders.expert_items(spark.createDataFrame(rows, "id int, q string, a string, w1 string, w2 string, w3 string"), "id", "q", "a", ["w1", "w2", "w3"])
    assert [(r["id"], r["options"][r["gold"]], sorted(r["options"])) for r in made.collect()] == [(1, "a", ["a", "b", "c", "d"])]
    assert {r["id"]: r["reason"] for r in lost.collect()} == {2: "duplicate_record", 3: "duplicate_options", 4: "invalid_schema", 5: "invalid_schema"}
    schema = "id int, claim string, title string, abstract array<string>, verdict string"
    claims = spark.createDataFrame([(1, "C", "T", ["One.", "Two."], " support"), (2, "C", "T", ["One.", "Two."], "SUPPORT "), (3, "D", "T", ["x"], "Nei"), (4, " ", "T", ["x"], "NEI"), (5, "E", "T", ["x", None], "NEI"), (6, "E", None, ["x"], "CONTRADICT")], schema)
    made, lost = builders.claim_items(claims, "id", "claim", "title", "abstract", "verdict", True)
    got = {(r["id"], r["kind"]): (r["gold"], r["state"]) for r in made.collect()}
    state = "Title: T\nAbstract: One. Two.\nClaim: C"
    assert got[1, "noul"] == (0, state) and got[1, "choice"] == (0, state) and got[1, "score"] == (2, state) and got[3, "choice"][0] == 2 and got[3, "noul"][0] == 1 and len(got) == 6
    assert {r["id"]: r["reason"] for r in lost.collect()} == {2: "duplicate_record", 4: "invalid_claim_schema", 5: "invalid_claim_schema", 6: "invalid_claim_schema"}
    with pytest.raises(Exception, match="unknown verdict"):
        builders.claim_rows(spark.createDataFrame([(1, "C", "T", ["x"], None)], schema), "claim", "title", "abstract", "verdict").collect()
    texts = spark.createDataFrame([(1, " good  text", 0), (2, "good text", 0), (3, "good text", 1), (4, " ", 1), (5, None, 1)], "id int, t string, l int")
    made, lost = builders.classification_items(texts, "id", "t", "l", ["no", "yes"], "Which?")
    assert {r["id"]: r["gold"] for r in made.collect()} == {1: 0, 3: 1} and {r["id"]: r["reason"] for r in lost.collect()} == {2: "duplicate_record", 4: "blank_text", 5: "blank_text"}
    with pytest.raises(Exception, match="no such label"):
        builders.classification_items(texts, "id", "t", "id", ["no", "yes"], "Which?")[0].collect()
    with pytest.raises(ValueError):
        builders.classification_items(texts, "id", "t", "l", ["no", "no"], "Which?")


ITEMS = "item_id int, question string, options array<string>, gold int, split string, source string, source_id string, split_group string, choice_type string"


def test_choice_battery(spark):
    o = ["a", "b", "c", "d"]
    rows = [
        (1, "shared question here", o, 0, "train", "s", "1", None, None), (2, "shared  question here", o[::-1], 3, "validation", "s", "2", None, None), (3, "shared question here", o, 0, " TEST", "s", "3", None, "single"),
        (4, "clash", o, 0, "train", "s", "4", None, None), (5, "clash", o, 1, "train", "s", "5", None, None), (6, "copy", o, 0, "train", "s", "6", None, None), (7, "copy", o, 0, "train", "s", "7", None, None),
        (8, "x", o[:3], 0, "train", "s", "8", None, None), (9, "x", ["a", " a", "c", "d"], 0, "train", "s", "9", None, None), (10, "x", o, 4, "train", "s", "10", None, None), (11, "x", o, 0, "train", "s", "11", None, "multi"),
        (12, "known words alpha beta gamma", o, 0, "train", "s", "12", None, None), (13, "free", o, 0, "holdout", "s", "13", None, None), (14, None, o, None, None, None, None, None, None),
        (15, "tied by id", o, 0, "train", "s", "77", None, None), (16, "another", o, 0, "test", "s", "77", None, None), (17, "third", o, 0, "dev", "t", "77", None, None),
    ]
    refs = spark.createDataFrame([("alpha beta gamma known words",)], "text string")
    got = {r["item_id"]: (r["role"], r["reason"]) for r in builders.choice_battery(spark.createDataFrame(rows, ITEMS), refs).collect()}
    why = {i: r for i, (_, r) in got.items()}
    assert len(got) == 17 and why[3] is None and why[1] == why[2] == "heldout_overlap" and why[4] == why[5] == "conflicting_gold" and why[6] is None and why[7] == "duplicate_record"
    assert why[8] == why[10] == why[11] == "invalid_schema" and why[9] == "invalid_options" and why[12] == "near_duplicate" and why[13] == why[14] == "unsupported_split"
    assert why[15] == "heldout_overlap" and why[16] is None and why[17] is None and got[2][0] == "dev"


def test_record_groups(spark):
    rows = [(1, "t1", "d1", None, "s", "p1"), (2, "t2", None, "d1", "s", "p2"), (3, " t2 ", None, None, "x", "p3"), (4, "t4", None, None, "y", "p3"), (5, "t5", "", None, "x", "p3"), (6, "t6", None, None, None, None), (7, "t7", None, None, None, None)]
    df = spark.createDataFrame(rows, "id int, text string, document_id string, doi string, source string, pid string")
    nested = F.when(F.col("id") == 7, F.array(F.struct(F.lit("group").alias("key"), F.lit("g").alias("value"), F.lit(None).cast("string").alias("source")))).when(F.col("id") == 6, F.array(F.struct(F.lit("group_id").alias("key"), F.lit("g").alias("value"), F.lit(None).cast("string").alias("source"))))
    got = {r["id"]: r["split_group"] for r in graph.group_records(df, "id", F.col("text"), nested=nested).collect()}
    assert got[1] == got[2] == got[3] == got[5] and got[4] != got[3] and got[6] == got[7] and len(set(got.values())) == 3
    assert got[1].startswith("document:") and got[4].startswith("passage:")
    assert graph.group_records(df.limit(0), "id", F.col("text")).count() == 0


REQUESTS = "qid string, kind string, state string, instructions string, options array<string>, gold int, span_start int, span_end int, split string, split_group string, sample_id string, pid string, provenance array<struct<option:string,sample_id:string,pid:string>>"


def requests(spark, n=8):
    rows = []
    for i in range(n):
        p = f"Evidence {i} holds {10 * i} units of word{i}."
        for kind, options, gold in (("noul", ["yes", "no"], 0), ("score", ["low", "high"], 1), ("choice", [f"{10 * i} units", f"{10 * i + 5} units"], 0)):
            rows.append((f"{kind}{i}", kind, f"Passage: {p}\nQuestion: how much word{(i + 1) % n}?", "ask", options, gold, 9, 9 + len(p), "train", f"g{i // 2}", f"s{i}", f"p{i}", [(f"{10 * i + 5} units", f"s{(i + 3) % n}", None), ("absent", "s0", None), (f"{10 * i + 5} units", None, "p99")]))
    return spark.createDataFrame(rows, REQUESTS)


def test_evidence_controls(spark):
    empty = {r["reference_qid"]: r for r in builders.evidence_controls(requests(spark), "empty").collect()}
    assert len(empty) == 24 and empty["noul1"]["state"] == "Passage: \nQuestion: how much word2?" and (empty["noul1"]["span_start"], empty["noul1"]["span_end"]) == (9, 9)
    assert empty["score1"]["gold"] is None and empty["score1"]["reference_gold"] == 1 and empty["score1"]["qid"].startswith("score1__evidence_empty_")
    for r in builders.evidence_controls(requests(spark), "shuffle").collect():
        new = r["state"][r["span_start"] : r["span_end"]]
        assert r["donor_group"] != r["source_group"] and new.startswith("Evidence ") and f"g{int(new.split()[1]) // 2}" == r["donor_group"]
    with pytest.raises(Exception, match="no donor"):
        builders.evidence_controls(requests(spark, 2), "shuffle").collect()
    with pytest.raises(Exception, match="bad_span"):
        builders.evidence_controls(requests(spark).withColumn("span_end", F.lit(5)), "empty").collect()
    with pytest.raises(ValueError, match="controlled already"):
        builders.evidence_controls(builders.evidence_controls(requests(spark), "empty"), "empty")


def test_anti_leak_rows_are_rejected(spark):
    rows = builders.anti_leak_training(requests(spark), "noul", ["empty", "shuffle"], 0.5).collect()
    assert len(rows) == 8 and all(r["gold"] == 1 and r["label_status"] == "antileak_train" for r in rows)
    assert {r["gold"] for r in builders.anti_leak_training(requests(spark), "score", ["empty"]).collect()} == {0}
    odd = builders.rejected(builders.evidence_controls(requests(spark).withColumn("options", F.array(F.lit("one"))), "empty"), "noul")
    assert {r["reason"] for r in odd.collect()} == {"noul_criteria_not_binary"}
    assert all(r["soft"] == [0.5, 0.5] for r in builders.anti_leak_choice(requests(spark)).collect())


def test_transplants(spark):
    near = {r["reference_qid"]: r for r in builders.transplants(requests(spark), "near").collect()}
    for i in (1, 3, 5):  # the question asks for the next passage's word, which is another group's
        assert f"word{i + 1}" in near[f"choice{i}"]["state"].split("\n")[0] and near[f"choice{i}"]["donor_group"] == f"g{(i + 1) // 2}"
    prov = builders.transplants(requests(spark), "provenance").collect()
    assert len(prov) == 8 and all(r["intended"] == 1 and (r["reason"] is None) == (r["donor_group"] != r["split_group"]) for r in prov)
    edit = {r["reference_qid"]: r for r in builders.transplants(requests(spark), "perturb").collect()}
    assert edit["choice3"]["state"].startswith("Passage: Evidence 3 holds 35 units") and edit["choice3"]["reason"] is None
    rand = builders.transplants(requests(spark), "random").collect()
    assert len(rand) == 8 and all(r["donor_group"] != r["split_group"] for r in rand)
    only = builders.transplants(requests(spark, 2), "random").collect()
    assert {r["reason"] for r in only} == {"no_transplant_donor"}


def test_relabelling(spark):
    cand = builders.transplants(requests(spark, 8), "provenance").filter("reason is null")
    ask = builders.teacher_requests(cand)
    assert ask.count() == 2 * cand.count() and ask.first()["state"].split("Proposed answer: ")[1].endswith("units")
    ids = [r["qid"] for r in cand.orderBy("reference_qid").collect()]
    said = {ids[0]: (0.9, 0.1), ids[1]: (0.2, 0.8), ids[2]: (0.55, 0.5), ids[3]: (0.9, None)}
    rows = [(q, i, p) for q, ps in said.items() for i, p in enumerate(ps) if p is not None]
    got = {r["qid"]: (r["decision"], r["gold"], r["soft"]) for r in builders.relabel(cand, spark.createDataFrame(rows, "candidate_qid string, option_index int, p_true double"), 0.5, 0.1).collect()}
    assert got[ids[0]] == ("keep_gold", 0, None) and got[ids[1]] == ("prov_confirmed", 1, None) and got[ids[2]] == ("uniform", None, [0.5, 0.5]) and got[ids[3]] == ("teacher_missing", None, None)


def test_grounded_variants(spark):
    items = spark.createDataFrame([("a", "S"), ("b", "S"), ("c", "S")], "qid string, state string")
    ev = spark.createDataFrame([("a", " ", "two"), ("b", None, None)], "qid string, n1 string, n2 string")
    got = {r["qid"]: (r["state"], r["evidence_field"], r["reason"]) for r in builders.grounded_variants(items, ev, "qid", "nev", ["n1", "n2"]).collect()}
    assert got == {"a_gr-nev": ("S\n\nEvidence: two", "n2", None), "b_gr-nev": ("S", None, "no_nev_evidence"), "c_gr-nev": ("S", None, "no_nev_evidence")}


@pytest.mark.parametrize("seed", range(4))
def test_every_key_that_can_have_a_donor_has_one(spark, seed):
    import random

    rng = random.Random(seed)
    keys = {(rng.choice("xy"), rng.choice(["hot", "hot", "hot", "g1", "g2"]), rng.choice(["c1", "c1", "c2", "c3"])) for _ in range(rng.randrange(1, 14))} | {("x", "hot", f"h{i}") for i in range(30)}
    got = {(r["w"], r["g"], r["c"]): (r["donor_group"], r["donor_content"]) for r in joins.ring_donors(spark.createDataFrame(sorted(keys), "w string, g string, c string"), ["w"], "g", "c", str(seed), ahead=1).collect()}
    assert set(got) == keys
    for (w, g, c), (dg, dc) in got.items():
        can = any(w2 == w and g2 != g and c2 != c for w2, g2, c2 in keys)
        assert (dg is not None) == can
        if can:
            assert (w, dg, dc) in keys and dg != g and dc != c


def test_nearest_leaves_out_stop_words_and_falls_back(spark):
    docs = spark.createDataFrame([(1, "which would have been their other", "g1"), (2, "alpha particle", "g2"), (3, None, "g3")], "doc int, t string, grp string")
    asked = spark.createDataFrame([("a", "which would have been their alpha", "g9"), ("b", "nothing known", "g2"), ("c", "alpha", "g2")], "qid string, t string, grp string")
    got = {r["qid"]: r["doc"] for r in joins.nearest_by_tfidf(asked, docs, "qid", "doc", "t").collect()}
    assert got == {"a": 2, "c": 2}
    far = {r["qid"]: (r["doc"], r["score"]) for r in joins.nearest_by_tfidf(asked, docs, "qid", "doc", "t", apart=["grp"], fallback=True).collect()}
    assert far["a"][0] == 2 and far["b"][0] in (1, 3) and far["c"][0] in (1, 3) and far["c"][1] == 0.0


def test_request_checks(spark):
    q = lambda t, c=None, label=None, ask="do": {"x": (t, ask, c, label)}
    rows = [
        (1, "s", q("choice", ["a", "b"], "a"), None), (2, " ", q("noul"), "blank_state"), (3, "s", {}, "no_questions"), (4, "s", None, "no_questions"), (5, "s", q("other"), "unknown_type"), (6, "s", q("noul", ask=" "), "blank_instructions"),
        (7, "s", q("choice", ["a", "a"], "a"), "bad_criteria"), (8, "s", q("choice", ["a", "b"], "c"), "bad_label"), (9, "s", q("noul", None, "yes"), "bad_label"), (10, "s", q("score", ["l", "h"], "2"), "bad_label"), (11, "s", q("score", ["l", "h"], "1"), None),
        (12, "s", q("noul", ["t"], "true"), "bad_criteria"), (13, "s", q("noul", None, "true"), None), (14, "s", q("score", ["l", "h"]), None),
    ]
    df = spark.createDataFrame([r[:3] for r in rows], "id int, s string, q map<string,struct<type:string,instructions:string,criteria:array<string>,label:string>>")
    assert {r["id"]: r["reason"] for r in builders.request_reasons(df, "s", "q").collect()} == {r[0]: r[3] for r in rows}


def test_certified_questions_need_their_text(spark):
    body = " ".join(f"w{i}" for i in range(400))
    docs = spark.createDataFrame([(1, body, "fulltext"), (2, body, "abstract"), (3, "short", "fulltext"), (4, body + " easy", "fulltext"), (5, body + " wrong", "fulltext"), (6, None, "fulltext")], "id int, t string, k string")
    reply = lambda w: F.concat(F.lit('{"question": "'), F.when(w.contains("easy"), "easy").when(w.contains("wrong"), "wrong").otherwise("hard"), F.lit('", "options": ["a", "b", "c", "d"], "answer": 2}'))
    answer = lambda state, q, o, k: F.when(q == "easy", 2).when(q == "wrong", 0).when(state == "", F.when(k == 1, 2).otherwise(0)).otherwise(2)
    got = builders.certified_questions(docs, "id", "t", "k", reply, answer).collect()
    assert [(r["id"], r["question"], r["gold"]) for r in got] == [(1, "hard", 2)] and 0 <= got[0]["bucket"] < 10
