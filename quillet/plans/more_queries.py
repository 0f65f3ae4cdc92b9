"""Further queries of the core: decisions, lookups, samples and parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.functions import scores, text
from quillet.operators import assemble, decisions, joins, metrics, records
from quillet.plans.queries import PRED, VALID, pred_sql, predictions, t
from quillet.plans.registry import query


def state():
    return F.concat(F.lit("Passage: "), F.col("passage"), F.lit("\nQuestion: "), F.col("q"))



@query("v01_decision_checks", "select item_id, case when options is null or len(options) < 2 then 'too_few_options' when len([o for o in options if o is null or o = '']) > 0 then 'empty_option' when len(list_distinct(options)) < len(options) then 'repeated_option' when gold is null or gold < 0 or gold >= len(options) then 'gold_out_of_range' else 'valid' end as outcome from build_qa_choice")
def p01(spark, d):
    ids = lambda c: F.when(c == "", F.array().cast("array<string>")).otherwise(F.array(c))
    opts = F.transform("options", lambda o: F.when(o.isNotNull(), ids(o)))
    qa = t(spark, d, "build_qa_choice")
    out = F.coalesce(records.decision_problem(F.array(F.lit(1)), opts, F.col("gold")), F.lit("valid"))
    return qa.select("item_id", out.alias("outcome"))


@query("v17_encode_with_budget", "select rec_id, least(length(passage), 640)::int as kept, greatest(length(passage) - 640, 0)::int as dropped, unicode(passage[1]) + 1 as first_id from build_sci_decisions where passage is not null and passage <> ''")
def p17(spark, d):
    ids = decisions.encoder(lambda s: [ord(c) + 1 for c in s])
    sci = t(spark, d, "build_sci_decisions").filter("passage is not null and passage <> ''").withColumn("b", decisions.with_budget(ids("passage"), 640))
    return sci.select("rec_id", F.size("b.ids").alias("kept"), F.col("b.dropped").alias("dropped"), F.get("b.ids", 0).alias("first_id"))


@query("v20_layout", f"""with x as (select item_id, length(question) as n, [least(length(o), 1000) for o in options] as l from build_qa_choice where {VALID} and question is not null and len([o for o in options if o is null or o = '']) = 0),
 y as (select item_id, l, least(48, 96 - 4) as ctx_cap, n from x), z as (select item_id, l, ctx_cap, n, floor((96 - least(n, ctx_cap)) / 4)::int as opt_cap from y)
 select item_id, ctx_cap::int as ctx_cap, opt_cap, greatest(n - ctx_cap, 0)::int as ctx_cut, (least(n, ctx_cap) + list_sum([least(k, opt_cap) for k in l]))::int as used from z""")
def p20(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("gold between 0 and 3 and size(options) = 4 and question is not null and not exists(options, o -> o is null or o = '')")
    ids = lambda c: F.split(c, "")
    out = qa.select("item_id", decisions.layout(ids(F.col("question")), F.transform("options", ids), 96).alias("l"))
    return out.select("item_id", "l.ctx_cap", "l.opt_cap", "l.ctx_cut", F.element_at("l.bounds", -1)["end"].alias("used"))


@query("v12_certified", f"with {PRED}, b as (select item_id, sum(correct) as hits from ((with {pred_sql(1)} select item_id, correct from s) union all (with {pred_sql(2)} select item_id, correct from s) union all (with {pred_sql(3)} select item_id, correct from s)) group by 1) select s.item_id from s join b using (item_id) where s.correct = 1 and b.hits <= 1")
def p12(spark, d):
    seen = metrics.scored(predictions(spark, d)).filter("correct = 1").select("item_id")
    blind = None
    for k in (1, 2, 3):
        part = metrics.scored(predictions(spark, d, k)).select("item_id", "correct")
        blind = part if blind is None else blind.unionAll(part)
    return seen.join(blind.groupBy("item_id").agg(F.sum("correct").alias("hits")).filter("hits <= 1"), "item_id").select("item_id")


@query("v16_audit", "select unnest(['four_options', 'gold_in_range', 'has_group', 'single']) as \"check\", unnest([sum((not coalesce(len(options) = 4, false))::int), sum((not coalesce(gold between 0 and 3, false))::int), sum((split_group is null)::int), sum((not coalesce(choice_type = 'single', false))::int)])::bigint as violations from build_qa_choice")
def p16(spark, d):
    qa = t(spark, d, "build_qa_choice")
    return decisions.audit(qa, {"four_options": F.size("options") == 4, "gold_in_range": F.col("gold").between(0, 3), "has_group": F.col("split_group").isNotNull(), "single": F.col("choice_type") == "single"})


@query("v22_pairs_to_decisions", "select rec_id, case when b = 0 then [a, q] else [q, a] end as options, b::int as gold from (select rec_id, q, a, ('0x' || substr(sha256('slot|' || rec_id), 1, 8))::bigint % 2 as b from build_sci_decisions where a is not null and q is not null)")
def p22(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("a is not null and q is not null").withColumn("b", records.bucket("slot", "rec_id", 2))
    return sci.select("rec_id", F.when(F.col("b") == 0, F.array("a", "q")).otherwise(F.array("q", "a")).alias("options"), F.col("b").cast("int").alias("gold"))


@query("v25_evidence_checks", r"select rec_id, case when passage is null or q is null then 'bad_span' when trim(regexp_replace(passage, '[\s\x{b}\x{85}\p{Z}]+', ' ', 'g')) = '' then case when passage = '' then 'bad_span' else 'blank_evidence' end when document_id is null or trim(document_id) = '' then 'no_group' else 'usable' end as outcome from build_sci_decisions")
def p25(spark, d):
    sci = t(spark, d, "build_sci_decisions")
    why = decisions.evidence_problem(state(), F.lit(9), F.length("passage") + 9, F.col("document_id"))
    return sci.select("rec_id", F.coalesce(why, F.lit("usable")).alias("outcome"))


@query("v26_repeated_identities", "with x as (select sha256(concat_ws('|', split_group, array_to_string(list_sort(options), '|'))) as identity from build_qa_choice where split_group is not null and options is not null and len([o for o in options if o is null]) = 0) select identity, count(*)::bigint as n from x group by 1 having count(*) > 1")
def p26(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("split_group is not null and options is not null and not exists(options, o -> o is null)")
    return qa.groupBy(assemble.prediction_identity(F.col("split_group"), F.col("options")).alias("identity")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


@query("j03_positional_join", "select a.rec_id, min(b.rec_id) as next_id from build_sci_decisions a join build_sci_decisions b on b.source_file = a.source_file and b.source_line = a.source_line + 1 group by 1")
def j03(spark, d):
    sci = t(spark, d, "build_sci_decisions").select("rec_id", "source_file", "source_line")
    after = sci.select(F.col("rec_id").alias("next_id"), "source_file", (F.col("source_line") - 1).alias("source_line")).groupBy("source_file", "source_line").agg(F.min("next_id").alias("next_id"))
    return sci.join(after, ["source_file", "source_line"]).select("rec_id", "next_id")


@query("j09_provenance_donors", "with s as (select sample_id as k, min(item_id) as donor from build_qa_choice where sample_id is not null group by 1), r as (select src_id as k, min(item_id) as donor from build_qa_choice where src_id is not null group by 1), x as (select q.item_id, coalesce(s.donor, r.donor) as donor from build_qa_choice q left join s on s.k = q.sample_id left join r on r.k = q.src_id) select item_id, donor from x where donor is not null and donor <> item_id")
def j09(spark, d):
    qa = t(spark, d, "build_qa_choice")
    by = lambda c, n: qa.filter(F.col(c).isNotNull()).groupBy(c).agg(F.min("item_id").alias(n))
    x = qa.select("item_id", "sample_id", "src_id").join(by("sample_id", "d1"), "sample_id", "left").join(by("src_id", "d2"), "src_id", "left")
    return x.select("item_id", F.coalesce("d1", "d2").alias("donor")).filter("donor is not null and donor <> item_id")


@query("j15_cache_join", "with c as (select distinct sha256('[' || array_to_string([unicode(substr(q, 1, 1)), length(q)], ', ') || ']') as key, unicode(substr(q, 1, 1)) as v from build_sci_decisions where q is not null and q <> '') select rec_id, v::int as v from build_sci_decisions join c on key = sha256('[' || array_to_string([unicode(substr(q, 1, 1)), length(q)], ', ') || ']') where q is not null and q <> ''")
def j15(spark, d):
    from quillet.sources import files

    sci = t(spark, d, "build_sci_decisions").filter("q is not null and q <> ''")
    first = decisions.encoder(lambda s: [ord(s[0])])
    rows = sci.select("rec_id", F.get(first(F.col("q")), 0).alias("v"), F.length("q").alias("n")).withColumn("key", files.sequence_key(F.array("v", "n")))
    return joins.require_all(rows.select("rec_id", "key"), rows.select("key", "v").distinct(), "key").select("rec_id", "v")


@query("a23_agreement_by_subject", f"with {PRED}, o as (select item_id, pred as p2 from (with {pred_sql(5)} select * from s)) select subject, count(*)::bigint as n, round(avg((pred = p2)::int), 4) as agreement from s join o using (item_id) group by 1")
def a23(spark, d):
    a = metrics.scored(predictions(spark, d)).select("item_id", "subject", "pred")
    b = metrics.scored(predictions(spark, d, 5)).select("item_id", F.col("pred").alias("p2"))
    return a.join(b, "item_id").groupBy("subject").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("pred") == F.col("p2")).cast("int")), 4).alias("agreement"))


@query("a25_collapsed_accuracy", f"with {PRED} select round(avg(((pred = 0) = (gold = 0))::int), 6) as binary_accuracy, round(greatest(avg((gold = 0)::int), avg((gold <> 0)::int)), 6) as majority, round(avg((conf - correct) ** 2), 6) as confidence_brier from s")
def a25(spark, d):
    s = metrics.scored(predictions(spark, d))
    zero = (F.col("gold") == 0).cast("int")
    return s.agg(F.round(F.avg(((F.col("pred") == 0) == (F.col("gold") == 0)).cast("int")), 6).alias("binary_accuracy"), F.round(F.greatest(F.avg(zero), 1 - F.avg(zero)), 6).alias("majority"), F.round(F.avg(F.pow(F.col("conf") - F.col("correct"), F.lit(2))), 6).alias("confidence_brier"))


@query("g04_first_of_equal_input", "with x as (select item_id, gold, question || '|' || array_to_string(options, '|') as k from build_qa_choice where question is not null and options is not null and len([o for o in options if o is null]) = 0) select k as input, min(item_id) as retained, count(*)::bigint as copies, count(distinct gold) > 1 as conflict from x group by 1 having count(*) > 1")
def g04(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("question is not null and options is not null and not exists(options, o -> o is null)")
    k = F.concat("question", F.lit("|"), F.array_join("options", "|"))
    return qa.groupBy(k.alias("input")).agg(F.min("item_id").alias("retained"), F.count(F.lit(1)).alias("copies"), (F.countDistinct("gold") > 1).alias("conflict")).filter("copies > 1")


@query("g10_split_by_state", "with g as (select passage, ('0x' || substr(sha256('dev|' || passage), 1, 8))::bigint % 10 as b from build_sci_decisions where passage is not null) select case when b < 4 then 'dev' else 'test' end as split, count(*)::bigint as n, count(distinct passage)::bigint as states from g group by 1")
def g10(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("passage is not null")
    return sci.groupBy(F.when(records.bucket("dev", "passage", 10) < 4, "dev").otherwise("test").alias("split")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("passage").alias("states"))


@query("g13_hash_sample", "select doc_id from documents where text is not null order by sha256('7331|' || doc_id) limit 100")
def g13(spark, d):
    docs = t(spark, d, "documents").filter("text is not null")
    return docs.orderBy(records.hash_order("7331", "doc_id")).limit(100).select("doc_id")  # a sampling operator: take-ordered, no full sort


@query("g15_capped_sources", "select item_id from build_qa_choice where source is not null qualify row_number() over (partition by source order by sha256('cap|' || item_id), item_id) <= 300")
def g15(spark, d):
    return records.cap_per(t(spark, d, "build_qa_choice").filter("source is not null"), ["source"], 300, "cap", "item_id").filter("reason is null").select("item_id")


@query("g17_identities", "with i as (select rec_id, unnest([{'namespace': 'document_id', 'hash': case when trim(regexp_replace(document_id, '[\\s\\x{b}\\x{85}\\p{Z}]+', ' ', 'g')) <> '' then sha256('document_id|' || document_id) end}, {'namespace': 'pid', 'hash': case when trim(pid) <> '' then sha256('pid|' || coalesce(source, '') || '|' || pid) end}], recursive := true) from build_sci_decisions) select rec_id, namespace, hash from i where hash is not null")
def g17(spark, d):
    return records.identities(t(spark, d, "build_sci_decisions"), ["document_id", "pid"], ["pid"]).select("rec_id", "namespace", "hash")


@query("t04_rank_options", f"with {PRED}, x as (select item_id, unnest(p) as p, unnest([0, 1, 2, 3]) as k from s) select item_id, 'o' || k as option, round(p, 6) as p, row_number() over (partition by item_id order by p desc, k)::int as rank from x")
def t04(spark, d):
    keys = F.array(*[F.lit(f"o{k}") for k in range(4)])
    r = predictions(spark, d).select("item_id", F.posexplode(scores.ranked(F.col("p"), keys)).alias("i", "r"))
    return r.select("item_id", F.col("r.key").alias("option"), F.round("r.p", 6).alias("p"), (F.col("i") + 1).alias("rank"))


@query("t07_longest", "select rec_id, length(passage)::int as n from build_sci_decisions where passage is not null order by length(passage) desc, rec_id limit 8")
def t07(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("passage is not null")
    return sci.select("rec_id", F.length("passage").alias("n")).orderBy(F.desc("n"), "rec_id").limit(8)


@query("f04_perturbed_numbers")
def f04(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("a is not null")
    return sci.select("rec_id", "a", decisions.perturb_number(F.col("a"), F.col("rec_id")).alias("perturbed")).filter("perturbed is not null")


WORD = r"[^\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"


@query("f08_passage_windows", f"""with w as (select rec_id, regexp_extract_all(passage, '{WORD}') as w from build_sci_decisions where passage is not null),
 x as (select rec_id, w, len(w) as n, floor(len(w) * 0.15)::int as lo from w where len(w) >= 300), y as (select *, greatest(lo, n - 800) as hi from x)
 select rec_id, array_to_string(list_slice(w, case when hi > lo then lo + (('0x' || substr(sha256('window|' || rec_id), 1, 8))::bigint % (hi - lo + 1)) else 0 end + 1, case when hi > lo then lo + (('0x' || substr(sha256('window|' || rec_id), 1, 8))::bigint % (hi - lo + 1)) else 0 end + 800), ' ') as "window" from y""")
def f08(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("passage is not null")
    return sci.select("rec_id", decisions.passage_window(F.col("passage"), F.col("rec_id")).alias("window")).filter("window is not null")


@query("f09_question_tails", r"select rec_id, trim(q) as tail from build_sci_decisions where passage is not null and q is not null and not contains(q, chr(10)||'Question:') and trim(q) = trim(q, chr(32)||chr(9)||chr(10)||chr(13))")
def f09(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("passage is not null and q is not null and not contains(q, '\nQuestion:') and trim(q) = trim(both ' \t\n\r' from q)")
    return sci.select("rec_id", text.question_tail(state()).alias("tail"))


@query("f11_single_edits")
def f11(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("a is not null and passage is not null")
    other = decisions.perturb_number(F.col("a"), F.col("rec_id"))
    e = sci.withColumn("e", decisions.single_edit(F.col("a"), other)).filter("e is not null")
    return e.select("rec_id", "e.src", "e.dst", decisions.apply_edit(F.col("passage"), F.col("e.src"), F.col("e.dst")).alias("counterfactual"))


@query("f13_corrupted_arguments", """with p as (select json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null group by 1),
 h as (select value, sha256('argument|k|' || value) as h from p), e as (select event_id, json_extract_string(props, '$.k') as old from events where json_extract_string(props, '$.k') is not null),
 b as (select arg_min(value, h) as a, arg_max(value, h) as z from h) select event_id, 'k' as name, old, case when a <> old then a else z end as new from e, b where a <> old or z <> old""")
def f13(spark, d):
    ev = t(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k")).filter("k is not null").withColumn("args", F.create_map(F.lit("k"), F.col("k")))
    return decisions.corrupt_argument(ev, "event_id", "args", assemble.argument_pool(ev, "args"))


@query("f14_generated_items", "select item_id, trim(question) as question, gold from build_qa_choice where gold between 0 and 3 and len(options) = 4 and question is not null and trim(question) <> '' and len([o for o in options if o is null or trim(o) = '']) = 0 and len(list_distinct([trim(o) for o in options])) = 4")
def f14(spark, d):
    qa = t(spark, d, "build_qa_choice")
    reply = F.concat(F.lit("Sure: "), F.to_json(F.struct("question", "options", F.col("gold").alias("answer"))), F.lit(" done"))
    return qa.select("item_id", decisions.parse_generated(reply).alias("r")).filter("r is not null").select("item_id", "r.question", "r.gold")


@query("f22_log_sum_exp", f"with {PRED} select item_id, round(ln(exp(logits[1]) + exp(logits[2]) + exp(logits[3]) + exp(logits[4])), 6) as lse from s")
def f22(spark, d):
    return predictions(spark, d).select("item_id", F.round(scores.log_sum_exp(F.col("logits")), 6).alias("lse"))


@query("c14_answers_by_group", f"with {PRED} select source || '|' || (item_id % 50) as state, string_agg(item_id || ':' || pred, ',' order by item_id::varchar) as answers from s where source is not null group by 1")
def c14(spark, d):
    s = metrics.scored(predictions(spark, d)).filter("source is not null").select(F.concat_ws("|", "source", (F.col("item_id") % 50).cast("string")).alias("state"), "source", F.col("item_id").cast("string").alias("qid"), "pred")
    per = decisions.gather_answers(s, "state", "qid", "pred")
    return per.select("state", F.array_join(F.transform(F.array_sort(F.map_entries("answers")), lambda e: F.concat_ws(":", e["key"], e["value"])), ",").alias("answers"))
