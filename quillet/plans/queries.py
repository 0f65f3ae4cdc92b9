"""The core's queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.functions import scores, text
from quillet.operators import assemble, decisions, graph, joins, metrics, records, retrieval
from quillet.plans.registry import query


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


# ---- predictions: deterministic logits of valid four-option items; the gold option gets a bonus

VALID = "gold between 0 and 3 and len(options) = 4"


def logits(salt: int = 0):
    return F.array(*[(((F.col("item_id") + salt) * (2 * k + 3) * 7919 + 31 * k) % 97) / F.lit(24.0) + F.when(F.col("gold") == k, 1.2).otherwise(0.0) for k in range(4)])


def predictions(spark: SparkSession, d: str, salt: int = 0) -> DataFrame:
    qa = t(spark, d, "build_qa_choice").filter("gold between 0 and 3 and size(options) = 4")
    return qa.select("item_id", "source", "split_group", "subject", "gold", logits(salt).alias("logits")).withColumn("p", scores.softmax(F.col("logits")))


def pred_sql(salt: int = 0) -> str:
    each = ", ".join(f"(((item_id + {salt}) * {2 * k + 3} * 7919 + {31 * k}) % 97) / 24.0::double + case when gold = {k} then 1.2 else 0 end as l{k}" for k in range(4))
    return f"""l as (select item_id, source, split_group, subject, gold, {each} from build_qa_choice where {VALID}),
e as (select *, exp(l0) + exp(l1) + exp(l2) + exp(l3) as z from l),
pr as (select item_id, source, split_group, subject, gold, [l0, l1, l2, l3] as logits, [exp(l0)/z, exp(l1)/z, exp(l2)/z, exp(l3)/z] as p from e),
s as (select *, list_position(p, list_max(p)) - 1 as pred, list_max(p) as conf, p[gold + 1] as p_gold, (list_position(p, list_max(p)) - 1 = gold)::int as correct,
  list_sum([(p[k] - case when gold = k - 1 then 1.0 else 0.0 end) ** 2 for k in [1, 2, 3, 4]]) as brier from pr)"""


PRED = pred_sql()


# ---- 2.2 validation and filters

# one character that is no white space
WORD = r"[^\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]"


@query("v03_qa_schema", r"""select rec_id, regexp_replace(regexp_replace(q, '^\s+', ''), '\s+$', '') as q from build_sci_decisions
 where trim(regexp_replace(coalesce(passage, ''), '[\s\x{a0}]+', ' ', 'g')) <> '' and trim(regexp_replace(coalesce(q, ''), '[\s\x{a0}]+', ' ', 'g')) <> '' and trim(regexp_replace(coalesce(a, ''), '[\s\x{a0}]+', ' ', 'g')) <> ''""")
def p03(spark, d):
    return records.qa_schema(t(spark, d, "build_sci_decisions")).filter("reason is null").select("rec_id", "q")


_NUM = r"[+-]?(?:(?:[0-9]{1,3}(?:,[0-9]{3})+|[0-9]+)(?:\.[0-9]+)?|\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def _numbers_sql(c: str) -> str:
    """Literals that stand alone, as text: words are cut at all that neither belongs to a number nor to a word, so that a
    literal is whole only if nothing of a word or a point is before it and nothing of a word behind it."""
    found = rf"regexp_extract_all(regexp_replace(replace({c}, chr(8722), '-'), '([^\pL\pM\p{{Nd}}\p{{Pc}}.,])', '\1\1', 'g'), '(^|[^\pL\pM\p{{Nd}}\p{{Pc}}.])({_NUM})', 2)"
    return found


VALUE_SQL = """case when regexp_replace(regexp_extract(x, '^[+-]?([0-9.,]*)', 1), '[.,0]', '', 'g') = '' then '0' else
  (case when x[1] = '-' then '-' else '' end) || rtrim(ltrim(regexp_replace(m, '[.]', '', 'g'), '0'), '0') || 'E' ||
  ((case when e = '' then 0 else e::bigint end) + length(ltrim(replace(m, '.', ''), '0')) - length(rtrim(ltrim(replace(m, '.', ''), '0'), '0')) - case when contains(m, '.') then length(split_part(m, '.', 2)) else 0 end) end"""


def _value_sql(x: str) -> str:
    x = f"replace(replace({x}, ',', ''), '+', '')"
    return "(" + VALUE_SQL.replace("case when regexp_replace(regexp_extract(x,", f"case when regexp_replace(regexp_extract({x},").replace("case when x[1]", f"case when ({x})[1]").replace("(m,", f"(regexp_extract({x}, '^-?([0-9.]*)', 1),").replace("contains(m", f"contains(regexp_extract({x}, '^-?([0-9.]*)', 1)").replace("e = ''", f"regexp_extract({x}, '[eE](-?[0-9]+)$', 1) = ''").replace("e::bigint", f"regexp_extract({x}, '[eE](-?[0-9]+)$', 1)::bigint") + ")"


def _content_sql(c: str) -> str:
    stop = "[" + ", ".join(f"'{w}'" for w in text.STOP) + "]"
    return f"[lower(w) for w in regexp_extract_all({c}, '(?i)[a-záéíóúñü][a-záéíóúñü\\-'']*') if length(w) > 3 and not list_contains({stop}, lower(w))]"


@query("v04_lexical_grounding", f"""with x as (select rec_id, q, a, passage, {_content_sql("a")} as aw, {_content_sql("passage")} as pw, [{_value_sql("n")} for n in {_numbers_sql("a")}] as an, [{_value_sql("n")} for n in {_numbers_sql("passage")}] as pn from build_sci_decisions where passage is not null and q is not null and a is not null)
 select rec_id from x where length(q) <= 400 and length(a) between 8 and 512 and regexp_matches(q, '{WORD}') and regexp_matches(a, '{WORD}') and regexp_matches(passage, '{WORD}')
 and len([w for w in aw if list_contains(pw, w)]) >= 0.5 * len(aw) and len([n for n in an if not list_contains(pn, n)]) = 0""")
def p04(spark, d):
    sci = t(spark, d, "build_sci_decisions")
    return sci.filter(records.grounded(F.col("q"), F.col("a"), F.col("passage"))).select("rec_id")


CHOICE_SQL = r"""c as (select *, case
  when question is null or trim(question, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)) = '' or options is null or len(options) <> 4
    or len([o for o in options if o is null or trim(o, chr(32)||chr(9)||chr(10)||chr(13)||chr(160)) = '']) > 0 or gold is null or gold not between 0 and 3 or coalesce(choice_type, 'single') <> 'single' then 'invalid_schema'
  when len(list_distinct([trim(regexp_replace(o, '[\s\x{a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', ' ', 'g')) for o in options])) < 4 then 'invalid_options' end as reason from build_qa_choice)"""


@query("v05_choice_schema", f"with {CHOICE_SQL} select item_id, reason from c")
def p05(spark, d):
    return records.route(t(spark, d, "build_qa_choice"), records.choice_reasons()).select("item_id", "reason")


@query("v10_least_words", r"select row_id from articles where len(regexp_extract_all(abstract, '[^\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+')) >= 80")
def p10(spark, d):
    return t(spark, d, "articles").filter(F.size(text.words(F.col("abstract"))) >= 80).select("row_id")


@query("v09_unambiguous_prompts", """select q as prompt, count(*)::bigint as n from (select trim(q) as q, trim(a) as a from build_sci_decisions where q is not null) group by 1 having count(distinct a) = 1""")
def p09(spark, d):
    rows = t(spark, d, "build_sci_decisions").filter("q is not null").select(F.trim("q").alias("prompt"), F.trim("a").alias("a"))
    return rows.groupBy("prompt").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("k")).filter("k = 1").drop("k")


@query("v19_canonical_order", f"with x as (select item_id, [list_slice(string_split(o, ' '), 1, 3) for o in options] as o from build_qa_choice where {VALID} and len([o for o in options if o is null]) = 0), y as (select item_id, list_sort([{{'o': o[i], 'i': i - 1}} for i in [1, 2, 3, 4]]) as s from x) select item_id, array_to_string([k.i for k in s], ',') as canonical from y")
def p19(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("gold between 0 and 3 and size(options) = 4 and not exists(options, o -> o is null)")
    order = assemble.canonical_order(F.transform("options", lambda o: F.split(o, " ")), F.lit(3))
    return qa.select("item_id", F.array_join(order.cast("array<string>"), ",").alias("canonical"))


@query("v18_overflow_route", "select rec_id, case when length(passage) > 2000 then 'input_overflow' end as reason, least(length(passage), 2000)::int as kept from build_sci_decisions where passage is not null")
def p18(spark, d):
    rows = t(spark, d, "build_sci_decisions").filter("passage is not null").withColumn("b", decisions.with_budget(F.split("passage", ""), 2000))
    return decisions.route_overflow(rows, F.col("b.dropped"), "exclude").select("rec_id", "reason", F.size("b.ids").alias("kept"))


@query("v23_instruction_variants", f"with {PRED} select item_id || '_v' || v as qid, gold, (['Choose the best answer.', 'Pick one option.'])[v + 1] as instructions from pr, range(2) r(v)")
def p23(spark, d):
    return assemble.variants(predictions(spark, d), "item_id", ["Choose the best answer.", "Pick one option."]).select("qid", "gold", "instructions")


@query("v28_item_explode", "select item_id, unnest(range(len(options))) as pos, unnest(options) as option from build_qa_choice where options is not null")
def p28(spark, d):
    return t(spark, d, "build_qa_choice").filter("options is not null").select("item_id", F.posexplode("options").alias("pos", "option")).withColumn("pos", F.col("pos").cast("bigint"))


# ---- 2.3 joins

@query("j01_soft_labels", """with soft as (select source, src_id, arg_max(item_id, item_id) as last_item from build_qa_choice where src_id is not null group by 1, 2)
 select q.item_id, s.last_item from build_qa_choice q left join (select src_id, max(last_item) as last_item from soft group by 1) s using (src_id)""")
def j01(spark, d):
    qa = t(spark, d, "build_qa_choice")
    soft = qa.filter("src_id is not null").select("src_id", F.col("item_id").alias("last_item"))
    return joins.attach_last(qa.select("item_id", "src_id"), soft, "src_id", "last_item", "last_item").select("item_id", "last_item")


@query("j02_lookup_all", """with r as (select item_id, [source || ':' || k for k in [source_id, '1', '2']] as ks from build_qa_choice where source is not null),
 tab as (select source || ':' || source_id as k, max(gold) as v from build_qa_choice where source is not null and source_id is not null group by 1),
 x as (select item_id, unnest(range(3)) as pos, unnest(ks) as k from r)
 select item_id, bool_and(v is not null) as found, array_to_string(list(coalesce(v, -9)::varchar order by pos), ',') as vals from x left join tab using (k) group by 1""")
def j02(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("source is not null")
    rows = qa.select("item_id", F.transform(F.array("source_id", F.lit("1"), F.lit("2")), lambda k: F.concat(F.col("source"), F.lit(":"), k)).alias("ks"))
    table = qa.filter("source_id is not null").groupBy(F.concat("source", F.lit(":"), "source_id").alias("k")).agg(F.max("gold").alias("v"))
    out = joins.lookup_all(rows, "item_id", "ks", table, "k", "v")
    return out.select("item_id", "found", F.array_join(F.transform("values", lambda v: F.coalesce(v, F.lit(-9)).cast("string")), ",").alias("vals"))


@query("j05_siblings", r"""with x as (select rec_id, source || '|' || pid as g, trim(regexp_replace(a, '[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', ' ', 'g')) as n from build_sci_decisions where pid is not null and source is not null),
 dd as (select distinct g, n, sha256('sibling|' || g || '|' || n) as h from x where n is not null),
 best as (select g, h, n from dd qualify row_number() over (partition by g order by h) <= 3),
 j as (select x.rec_id, b.n as sibling, row_number() over (partition by x.rec_id order by b.h)::int as rank from x join best b using (g) where b.n <> coalesce(x.n, ''))
 select * from j where rank <= 2""")
def j05(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("pid is not null and source is not null").withColumn("g", F.concat_ws("|", "source", "pid"))
    return joins.siblings(sci, "g", "rec_id", "a", 2)


@query("j07_near_duplicate_screen", r"""with q as (select item_id, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]{3,}')) as ts, lower(trim(split)) as s from build_qa_choice where question is not null),
 a as (select item_id, ts, len(ts) as n from q where s = 'train' and len(ts) > 0), b as (select item_id, ts, len(ts) as n from q where s in ('test', 'eval') and len(ts) > 0),
 ao as (select item_id, n, unnest(ts) as w from a), bo as (select item_id, n, unnest(ts) as w from b),
 o as (select ao.item_id as train_id, bo.item_id as heldout_id, any_value(ao.n) as n1, any_value(bo.n) as n2, count(*) as overlap from ao join bo using (w) group by 1, 2)
 select train_id, heldout_id, overlap::int as overlap, round(overlap / (n1 + n2 - overlap), 6) as jaccard from o where overlap / (n1 + n2 - overlap) >= 0.6 - 1e-12""")
def j07(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("question is not null").select("item_id", F.lower(F.trim("split")).alias("s"), text.token_set(F.col("question")).alias("ts")).filter("size(ts) > 0")
    a, b = qa.filter("s = 'train'").withColumnRenamed("item_id", "train_id"), qa.filter("s in ('test', 'eval')").withColumnRenamed("item_id", "heldout_id")
    return rounded(joins.jaccard_join(a, b, "train_id", "heldout_id", "ts", 0.6), "jaccard")


@query("j08_shuffle_donors", """with k as (select distinct source, split_group as g, question as c from build_qa_choice where source is not null and split_group is not null and question is not null),
 h as (select *, sha256('donor|' || source || '|' || g || '|' || c) as h from k), o as (select *, row_number() over (partition by source order by h) as p from h),
 n as (select x.source, x.g, x.c, arg_min({'g': y.g, 'c': y.c}, y.p) as d from o x join o y on y.source = x.source and y.p between x.p + 1 and x.p + 8 and y.g <> x.g and y.c <> x.c group by 1, 2, 3),
 a as (select source, arg_min({'g': g, 'c': c}, h) as a from h group by 1), b as (select source, any_value(a) as a, arg_min({'g': g, 'c': c}, h) filter (g <> a.g and c <> a.c) as b from h join a using (source) group by 1)
 select source, g as split_group, c as question, coalesce(d.g, case when a.g <> g and a.c <> c then a.g when b.g <> g and b.c <> c then b.g end) as donor_group, coalesce(d.c, case when a.g <> g and a.c <> c then a.c when b.g <> g and b.c <> c then b.c end) as donor_content
 from k left join n using (source, g, c) left join b using (source)""")
def j08(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("source is not null and split_group is not null and question is not null")
    return joins.ring_donors(qa, ["source"], "split_group", "question", "donor").drop("donors")


@query("j10_tfidf_donor", r"""with doc as (select item_id as benchmark_id, unnest([x for x in regexp_extract_all(lower(text), '[a-z0-9]{4,}') if not list_contains(STOPLIST, x)]) as w from benchmark),
 tf as (select w, benchmark_id, count(*) as tf from doc group by 1, 2), n as (select count(*) as n from benchmark),
 idf as (select w, ln(1 + n.n / count(*)) as idf from tf, n group by w, n.n),
 qq as (select rec_id, unnest(list_distinct([x for x in regexp_extract_all(lower(q), '[a-z0-9]{4,}') if not list_contains(STOPLIST, x)])) as w from build_sci_decisions where q is not null),
 s as (select rec_id, benchmark_id, round(sum(idf * tf), 6) as score from qq join idf using (w) join tf using (w) group by 1, 2)
 select rec_id, benchmark_id, score from s qualify row_number() over (partition by rec_id order by score desc, benchmark_id) = 1""".replace("STOPLIST", "[" + ", ".join(f"'{w}'" for w in joins.DONOR_STOPWORDS) + "]"))
def j10(spark, d):
    docs = t(spark, d, "benchmark").select(F.col("item_id").alias("benchmark_id"), "text")
    queries = t(spark, d, "build_sci_decisions").filter("q is not null").select("rec_id", F.col("q").alias("text"))
    return joins.nearest_by_tfidf(queries, docs, "rec_id", "benchmark_id", "text")


@query("j12_resume", "select rec_id from build_sci_decisions where source_file not in (select source_file from build_sci_decisions where source_line = 1 and source_file is not null and type = 'causal') or source_file is null")
def j12(spark, d):
    sci = t(spark, d, "build_sci_decisions")
    return joins.unseen(sci, sci.filter("source_line = 1 and type = 'causal' and source_file is not null"), "source_file").select("rec_id")


@query("j13_heldout_groups", "select item_id from build_qa_choice where lower(trim(split)) = 'train' and split_group is not null and split_group not in (select split_group from build_qa_choice where lower(trim(split)) in ('test', 'eval') and split_group is not null)")
def j13(spark, d):
    qa = t(spark, d, "build_qa_choice").withColumn("s", F.lower(F.trim("split"))).filter("split_group is not null")
    return joins.unseen(qa.filter("s = 'train'"), qa.filter("s in ('test', 'eval')"), "split_group").select("item_id")


@query("j14_role_overlap", """with i as (select lower(trim(split)) as role, unnest([{'namespace': 'sample_id', 'hash': case when trim(sample_id) <> '' then sha256('sample_id|' || sample_id) end}, {'namespace': 'source_id', 'hash': case when trim(source_id) <> '' then sha256('source_id|' || coalesce(source, '') || '|' || source_id) end}], recursive := true) from build_qa_choice where split is not null)
 select namespace, hash, array_to_string(list_sort(list(distinct role)), ',') as roles from i where hash is not null group by 1, 2 having count(distinct role) > 1""")
def j14(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("split is not null").withColumn("role", F.lower(F.trim("split")))
    return records.role_overlap(records.identities(qa, ["sample_id", "source_id"], ["source_id"]), "role")


@query("j16_first_holder", "select 'k' as name, json_extract_string(props, '$.k') as value, min(event_id) as holder from events where json_extract_string(props, '$.k') is not null group by 2")
def j16(spark, d):
    ev = t(spark, d, "events").withColumn("args", F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    return assemble.first_holder(ev, "args", "event_id").filter("value is not null")


# ---- 2.4 aggregations

@query("a01_summary", f"with {PRED} select count(*)::bigint as n, round(avg(correct), 6) as accuracy, round(avg(-ln(p_gold)), 6) as nll, 0::bigint as zero_gold, round(avg(brier), 6) as brier, round(avg(conf), 6) as mean_conf, round(avg(p_gold), 6) as mean_p_gold from s")
def a01(spark, d):
    return rounded(metrics.summary(metrics.validate(predictions(spark, d))), "accuracy", "nll", "brier", "mean_conf", "mean_p_gold")


@query("a18_summary_by_source", f"with {PRED} select source, grouping(source)::int as is_total, count(*)::bigint as n, round(avg(correct), 6) as accuracy, round(avg(brier), 6) as brier from s group by rollup (source)")
def a18(spark, d):
    return rounded(metrics.summary_with_total(predictions(spark, d), "source"), "accuracy", "brier").withColumn("is_total", F.col("is_total").cast("int"))


def _edges_sql() -> str:
    return "case " + " ".join(f"when conf <= {e!r}::double then {i}" for i, e in enumerate(metrics.EDGES[1:10])) + " else 9 end"


@query("a05_ece", f"with {PRED}, b as (select {_edges_sql()} as bin, conf, correct from s), g as (select bin, count(*) as n, avg(conf) as c, avg(correct) as a from b group by 1) select round(sum(n * abs(c - a)) / sum(n), 6) as ece from g")
def a05(spark, d):
    return rounded(metrics.ece(predictions(spark, d)), "ece")


@query("a06_ece_equal_count", f"with {PRED}, b as (select ntile(10) over (order by round(conf, 9), item_id) as bin, round(conf, 9) as conf, correct from s), g as (select bin, count(*) as n, avg(conf) as c, avg(correct) as a from b group by 1) select round(sum(n * abs(c - a)) / sum(n), 6) as ece from g")
def a06(spark, d):
    p = predictions(spark, d).withColumn("p", F.transform("p", lambda x: F.round(x, 9)))
    return rounded(metrics.ece(p, "count"), "ece")


@query("a08_reliability", f"with {PRED} select {_edges_sql()}::int as bin, count(*)::bigint as n, round(avg(conf), 6) as conf, round(avg(correct), 6) as accuracy from s group by 1")
def a08(spark, d):
    return rounded(metrics.reliability(predictions(spark, d)), "conf", "accuracy")


@query("a07_reliability_left", f"with {PRED} select least(9, floor(conf * 10))::int as bin, count(*)::bigint as n, round(avg(conf), 6) as conf, round(avg(correct), 6) as accuracy from s group by 1")
def a07(spark, d):
    return rounded(metrics.reliability(predictions(spark, d), "left"), "conf", "accuracy")


CLASS_SQL = f"with {PRED}, g as (select gold as label, count(*) as support, sum(correct) as hits from s group by 1), q as (select pred as label, count(*) as predicted from s group by 1), r as (select x.label::int as label, coalesce(support, 0)::bigint as support, coalesce(predicted, 0)::bigint as predicted, coalesce(hits, 0)::bigint as hits from range(5) x(label) left join g using (label) left join q using (label))"


@query("a09_class_report", f"{CLASS_SQL} select *, round(case when support > 0 then hits / support end, 6) as recall, round(case when support + predicted > 0 then 2 * hits / (support + predicted) else 0 end, 6) as f1 from r")
def a09(spark, d):
    return rounded(metrics.class_report(predictions(spark, d), 5), "recall", "f1")


@query("a10_class_summary", f"{CLASS_SQL} select round(max(support) / sum(support), 6) as majority, round(avg(case when support > 0 then hits / support end), 6) as balanced_accuracy, round(avg(case when support + predicted > 0 then 2 * hits / (support + predicted) else 0 end), 6) as macro_f1 from r")
def a10(spark, d):
    return rounded(metrics.class_summary(predictions(spark, d), 5), "majority", "balanced_accuracy", "macro_f1")


@query("a12_ordinal_error", f"with {PRED} select round(avg(abs(p[2] + 2 * p[3] + 3 * p[4] - gold)), 6) as expected_mae, round(avg(abs(pred - gold)), 6) as argmax_mae from s")
def a12(spark, d):
    return rounded(metrics.ordinal_error(predictions(spark, d)), "expected_mae", "argmax_mae")


ACCEPT_SQL = f"{PRED}, c as (select round(conf, 9) as conf, count(*) as c, sum(1 - correct) as e from s group by 1), w as (select conf, sum(c) over (order by conf desc) as k, sum(e) over (order by conf desc) as bad, sum(c) over () as n from c)"


@query("a15_acceptance_fit", f"with {ACCEPT_SQL}, g as (select * from w where k >= 20 and bad <= 0.3 * k + 1e-12 qualify row_number() over (order by k desc) = 1) select round(g.conf, 6) as threshold, x.n::bigint as n, coalesce(g.k, 0)::bigint as accepted, coalesce(g.bad, 0)::bigint as errors, round(coalesce(g.k, 0) / x.n, 6) as coverage, round(g.bad / g.k, 6) as risk from (select max(n) as n from w) x left join g on true")
def a15(spark, d):
    p = predictions(spark, d).withColumn("p", F.transform("p", lambda x: F.round(x, 9)))
    return rounded(metrics.acceptance(p, 0.3, 20), "threshold", "coverage", "risk")


@query("a16_acceptance_eval", f"""with {PRED}, x as (select count(*) as n, sum((conf >= 0.6)::int) as k, sum((conf >= 0.6 and correct = 0)::int) as e from s)
 select n::bigint as n, k::bigint as accepted, e::bigint as errors, round(k / n, 6) as coverage, round(e / k, 6) as risk,
 round(case when e = 0 then 0 else ((e/k + 3.8414588206941245/(2*k)) - 1.9599639845400536*sqrt(e/k*(1-e/k)/k + 3.8414588206941245/(4*k*k))) / (1 + 3.8414588206941245/k) end, 6) as risk_low,
 round(((e/k + 3.8414588206941245/(2*k)) + 1.9599639845400536*sqrt(e/k*(1-e/k)/k + 3.8414588206941245/(4*k*k))) / (1 + 3.8414588206941245/k), 6) as risk_high from x""")
def a16(spark, d):
    return rounded(metrics.apply_acceptance(predictions(spark, d), F.lit(0.6)), "coverage", "risk", "risk_low", "risk_high")


@query("a17_flip_rate", f"with {PRED}, l2 as (select item_id, pred from (with {pred_sql(5)} select * from s)) select round(avg((s.pred <> l2.pred)::int), 6) as flip_rate, count(*)::bigint as n from s join l2 using (item_id)")
def a17(spark, d):
    a = metrics.scored(predictions(spark, d)).select("item_id", "pred")
    b = metrics.scored(predictions(spark, d, 5)).select("item_id", F.col("pred").alias("other"))
    return a.join(b, "item_id").agg(F.round(F.avg((F.col("pred") != F.col("other")).cast("int")), 6).alias("flip_rate"), F.count(F.lit(1)).alias("n"))


@query("a19_quantiles", f"with {PRED} select q, round(quantile_cont(round(conf, 9), q), 6) as value from s, (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as q) group by q".replace("quantile_cont(round(conf, 9), q)", "list_extract(quantile_cont(round(conf, 9), [0.0, 0.25, 0.5, 0.75, 1.0]), (q * 4)::int + 1)"))
def a19(spark, d):
    s = metrics.scored(predictions(spark, d)).withColumn("conf", F.round("conf", 9))
    return rounded(metrics.quantiles(s, "conf"), "value")


@query("a20_positions", f"with {PRED} select gold as position, count(*)::bigint as gold_n, (select count(*) from s x where x.pred = s.gold)::bigint as pred_n from s group by 1")
def a20(spark, d):
    return metrics.class_report(predictions(spark, d), 4).select(F.col("label").alias("position"), F.col("support").alias("gold_n"), F.col("predicted").alias("pred_n"))


@query("a24_confusion", f"with {PRED} select gold, sum((pred = 0)::int)::bigint as p0, sum((pred = 1)::int)::bigint as p1, sum((pred = 2)::int)::bigint as p2, sum((pred = 3)::int)::bigint as p3 from s group by 1")
def a24(spark, d):
    return metrics.confusion(predictions(spark, d), 4)


@query("a21_coverage_stats", r"""with x as (select rec_id, list_distinct(regexp_extract_all(lower(a), '[a-z]{4,}')) as o, list_distinct(regexp_extract_all(lower(passage), '[a-z]{4,}')) as r from build_sci_decisions where a is not null and passage is not null),
 c as (select len(list_intersect(o, r)) / greatest(1, len(o)) as c from x)
 select count(*)::bigint as n, round(avg(c), 6) as mean, round(list_sort(list(c))[(count(*) // 2 + 1)::bigint], 6) as upper_median, sum((c > 0.3)::int)::bigint as over_30, sum((c > 0.5)::int)::bigint as over_50 from c""")
def a21(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("a is not null and passage is not null")
    o, r = text.token_set(F.col("a"), 4, True), text.token_set(F.col("passage"), 4, True)
    c = sci.select((F.size(F.array_intersect(o, r)) / F.greatest(F.size(o), F.lit(1))).alias("c"))
    # the upper median is the element n // 2, found by counts per value
    per = c.groupBy("c").agg(F.count(F.lit(1)).alias("k")).withColumnRenamed("c", "conf")
    run = metrics.running(per, ["k"])
    n = c.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("c"), 6).alias("mean"), F.sum((F.col("c") > 0.3).cast("bigint")).alias("over_30"), F.sum((F.col("c") > 0.5).cast("bigint")).alias("over_50"))
    mid = run.crossJoin(F.broadcast(n.select("n"))).filter("k_run > floor(n / 2)").agg(F.round(F.min("conf"), 6).alias("upper_median"))
    return n.crossJoin(mid)


@query("a22_counts_by_source", "select source, lower(trim(split)) as split, count(*)::bigint as n, count(distinct split_group)::bigint as groups from build_qa_choice group by 1, 2")
def a22(spark, d):
    return t(spark, d, "build_qa_choice").groupBy("source", F.lower(F.trim("split")).alias("split")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("split_group").alias("groups"))


@query("a26_temperature")
def a26(spark, d):
    best = metrics.temperature(predictions(spark, d))
    return spark.createDataFrame([(round(best, 6),)], "temperature double")


@query("a27_temperature_grid", f"with {PRED}, g as (select t * 0.25 as t, sum(ln(exp(logits[1]/(t*0.25)) + exp(logits[2]/(t*0.25)) + exp(logits[3]/(t*0.25)) + exp(logits[4]/(t*0.25))) - logits[gold + 1]/(t*0.25)) as nll from s, range(1, 33) r(t) group by 1) select round(t, 6)::double as temperature, round(nll, 3) as nll from g qualify row_number() over (order by nll) = 1")
def a27(spark, d):
    p = predictions(spark, d).withColumn("t", F.explode(F.array(*[F.lit(i * 0.25) for i in range(1, 33)])))
    loss = scores.log_sum_exp(F.transform("logits", lambda x: x / F.col("t"))) - F.get("logits", F.col("gold")) / F.col("t")
    g = p.groupBy("t").agg(F.sum(loss).alias("nll"))
    return g.agg(F.min(F.struct("nll", "t")).alias("b")).select(F.round("b.t", 6).alias("temperature"), F.round("b.nll", 3).alias("nll"))


@query("a28_recall", f"with {PRED}, r as (select 1 + len([x for x in p if x > p_gold]) as r from s) select count(*)::bigint as n, round(avg(1 / r), 6) as mrr, round(avg((r <= 1)::int), 6) as recall_1, round(avg((r <= 2)::int), 6) as recall_2 from r")
def a28(spark, d):
    return rounded(retrieval.recall(predictions(spark, d), "p", "gold", (1, 2)), "mrr", "recall_1", "recall_2")


@query("a29_idf", r"with w as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]{4,}')) as term from benchmark) select term, count(*)::bigint as df, round(ln(1 + (select count(*) from benchmark) / count(*)), 6) as idf from w group by 1")
def a29(spark, d):
    b = t(spark, d, "benchmark")
    n = b.count()
    w = b.select("item_id", F.explode(text.token_set(F.col("text"), 4)).alias("term"))
    return w.groupBy("term").agg(F.count(F.lit(1)).alias("df")).withColumn("idf", F.round(F.log(1 + F.lit(n) / F.col("df")), 6))


@query("a30_paired_bootstrap")
def a30(spark, d):
    a = metrics.scored(predictions(spark, d)).select("item_id", F.coalesce("split_group", F.col("item_id").cast("string")).alias("unit"), F.col("correct").alias("x"))
    b = metrics.scored(predictions(spark, d, 5)).select("item_id", F.col("correct").alias("y"))
    return metrics.paired_bootstrap(a.join(b, "item_id").select("unit", (F.col("y") - F.col("x")).cast("double").alias("delta")))


@query("a31_ensemble", f"with {PRED}, o as (select item_id, p as p2 from (with {pred_sql(5)} select * from s)), m as (select item_id, gold, [(p[k] + p2[k]) / 2 for k in [1, 2, 3, 4]] as m, pred = list_position(p2, list_max(p2)) - 1 as agree from s join o using (item_id)) select item_id::varchar as identity, 'o' || (list_position(m, list_max(m)) - 1) as prediction, round(list_max(m), 6) as confidence, (list_position(m, list_max(m)) - 1 = gold)::int as correct, agree from m")
def a31(spark, d):
    keys = F.array(*[F.lit(f"o{k}") for k in range(4)])
    part = lambda salt: predictions(spark, d, salt).select(F.col("item_id").cast("string").alias("identity"), F.lit(salt).alias("variant"), keys.alias("keys"), "p", F.concat(F.lit("o"), "gold").alias("gold_key"))
    return rounded(assemble.ensemble(part(0).unionAll(part(5)), 2), "confidence").select("identity", "prediction", "confidence", "correct", "agree")


@query("a32_provenance_coverage", "select source, case when count(document_id) = count(*) then 'available' when count(document_id) = 0 then 'not_available' else 'partial' end as coverage, count(document_id)::bigint as with_id, count(*)::bigint as n from build_sci_decisions group by 1")
def a32(spark, d):
    g = t(spark, d, "build_sci_decisions").groupBy("source").agg(F.count("document_id").alias("with_id"), F.count(F.lit(1)).alias("n"))
    return g.withColumn("coverage", F.when(F.col("with_id") == F.col("n"), "available").when(F.col("with_id") == 0, "not_available").otherwise("partial"))


@query("a33_argument_pool", "select distinct 'k' as name, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null")
def a33(spark, d):
    ev = t(spark, d, "events").withColumn("args", F.create_map(F.lit("k"), F.get_json_object("props", "$.k")))
    return assemble.argument_pool(ev, "args").filter("value is not null")


@query("a35_seed_spread", f"with {PRED}, a as (select source, avg(correct) as acc from s where source is not null group by 1) select round(avg(acc), 6) as mean, round(stddev_samp(acc), 6) as sd from a")
def a35(spark, d):
    per = metrics.summary(predictions(spark, d).filter("source is not null"), "source")
    return per.agg(F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.stddev_samp("accuracy"), 6).alias("sd"))


# ---- 2.5 grouping, duplicates, splits

@query("g01_components", """with recursive r as (select doc_id, '0' || paper_id as node, md5(text) as k from documents where paper_id is not null and text is not null),
 sp as (select distinct node, k from r), st as (select s.node as a, m.b from sp s join (select k, min(node) as b from sp group by 1 having count(*) > 1) m using (k) where s.node <> m.b),
 ed as (select a, b from st union select b, a from st), walk(node, seen) as (select a, a from ed union select w.node, e.b from walk w join ed e on e.a = w.seen),
 root as (select node, min(seen) as root from walk group by 1), lab as (select r.doc_id, coalesce(t.root, r.node) as group_root from r left join root t using (node))
 select doc_id, group_root, count(*) over (partition by group_root)::bigint as group_size from lab""")
def g01(spark, d):
    docs = t(spark, d, "documents").filter("paper_id is not null and text is not null")
    return graph.group_related(docs, "doc_id", F.col("paper_id"), [F.col("text")])


@query("g02_keep_first", "select doc_id, min(doc_id) over (partition by text) as retained, count(*) over (partition by text)::bigint as copies, case when doc_id <> min(doc_id) over (partition by text) then 'duplicate_record' end as reason from documents")
def g02(spark, d):
    return records.keep_first(t(spark, d, "documents"), ["text"], "doc_id").select("doc_id", "retained", "copies", "reason")


@query("g03_conflicts", "select sample_id, count(distinct gold)::bigint as values from build_qa_choice where sample_id is not null group by 1 having count(distinct gold) > 1")
def g03(spark, d):
    return records.conflicts(t(spark, d, "build_qa_choice").filter("sample_id is not null"), "sample_id", "gold")


@query("g06_owners", "select split_group, case min(case lower(trim(split)) when 'eval' then 0 when 'test' then 1 when 'dev' then 2 when 'train' then 3 else 4 end) when 0 then 'eval' when 1 then 'test' when 2 then 'dev' when 3 then 'train' end as owner from build_qa_choice where split_group is not null group by 1 having owner is not null")
def g06(spark, d):
    qa = t(spark, d, "build_qa_choice").withColumn("role", F.lower(F.trim("split")))
    return records.owners(qa, "split_group", "role", ["eval", "test", "dev", "train"])


@query("g07_partition_groups", "with g as (select distinct source || '|' || pid as g from build_sci_decisions where pid is not null and source is not null), r as (select g, row_number() over (order by sha256('7331|' || g)) - 1 as pos, count(*) over () as n from g) select g, case when pos < floor(n * 0.2) then 'eval' when pos < floor(n * 0.2) + floor(n * 0.15) then 'dev' when pos < floor(n * 0.2) + floor(n * 0.15) + floor(n * 0.6) then 'train' else 'unassigned_group' end as split from r")
def g07(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("pid is not null and source is not null").select(F.concat_ws("|", "source", "pid").alias("g"))
    return records.partition_groups(sci, "g", [("eval", 0.2), ("dev", 0.15), ("train", 0.6)], "7331")


@query("g08_hash_roles", "select item_id, (('0x' || substr(sha256('7331|' || item_id), 1, 8))::bigint % 4)::bigint as bucket from build_qa_choice")
def g08(spark, d):
    return t(spark, d, "build_qa_choice").select("item_id", records.bucket("7331", "item_id", 4).alias("bucket"))


@query("g11_group_subset", "with g as (select source || '|' || pid as g, count(*) as size from build_sci_decisions where pid is not null and source is not null group by 1), r as (select g, size, coalesce(sum(size) over (order by sha256('7331|' || g) rows between unbounded preceding and 1 preceding), 0) as taken from g) select g, size::bigint as size from r where taken < 300")
def g11(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("pid is not null and source is not null").select(F.concat_ws("|", "source", "pid").alias("g"))
    return records.group_subset(sci, "g", 300, "7331")


@query("g12_cap_per_key", "select rec_id, case when row_number() over (partition by source, pid order by sha256('7331|' || rec_id), rec_id) > 2 then 'per_key_limit' end as reason from build_sci_decisions")
def g12(spark, d):
    return records.cap_per(t(spark, d, "build_sci_decisions"), ["source", "pid"], 2, "7331", "rec_id").select("rec_id", "reason")


@query("g14_fraction", "select doc_id from documents qualify row_number() over (order by sha256('7331|' || doc_id), doc_id) <= greatest(1, round_even((count(*) over ()) * 0.35, 0))")
def g14(spark, d):
    return records.fraction(t(spark, d, "documents"), 0.35, "7331", "doc_id").select("doc_id")


@query("g16_repeat_rows", "select item_id, c::int as copy from build_qa_choice, range(1, 4) r(c) where (source = 'polarset' and c <= 3) or (source <> 'polarset' and c <= 1)")
def g16(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("source is not null")
    return records.repeat_rows(qa, F.when(F.col("source") == "polarset", 3).otherwise(1)).select("item_id", "copy")


@query("g18_input_identity", "with x as (select item_id, sha256(concat_ws('|', question, array_to_string(list_sort(options), '|'))) as h from build_qa_choice where question is not null and options is not null and len([o for o in options if o is null]) = 0) select h as identity, count(*)::bigint as n, min(item_id) as first_item from x group by 1 having count(*) > 1")
def g18(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("question is not null and options is not null and not exists(options, o -> o is null)")
    return qa.groupBy(records.input_identity(F.col("question"), F.col("options")).alias("identity")).agg(F.count(F.lit(1)).alias("n"), F.min("item_id").alias("first_item")).filter("n > 1")


@query("g19_distinct_sequences", "select distinct unnest(list_append(options, question)) as seq from build_qa_choice where options is not null and question is not null")
def g19(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("options is not null and question is not null")
    return qa.select(F.explode(F.array_append("options", F.col("question"))).alias("seq")).distinct()


@query("g20_shards", "select doc_id, (('0x' || substr(sha256('shard|' || doc_id), 1, 8))::bigint % 8)::bigint as shard from documents")
def g20(spark, d):
    return t(spark, d, "documents").select("doc_id", records.bucket("shard", "doc_id", 8).alias("shard"))


# ---- 2.7 retrieval and ranking

BM25_SQL = r"""tok as (select row_id, regexp_extract_all(lower(coalesce(title, '') || ' ' || coalesce(abstract, '') || ' ' || coalesce(mesh, '')), '[a-z0-9]+') as w from articles),
 docs as (select row_id, len(w) as len, w from tok where len(w) > 0), st as (select count(*) as n, avg(len) as avgl from docs),
 post as (select term, row_id, any_value(len) as len, count(*) as tf from (select row_id, len, unnest(w) as term from docs) group by 1, 2),
 q as (select rec_id, list_slice([x for x in qd if not list_contains(STOPLIST, x)], 1, 24) as terms from (select rec_id, (select list(w order by i) from (select w, min(i) as i from (select unnest(ws) as w, unnest(range(len(ws))) as i) group by w)) as qd from (select rec_id, regexp_extract_all(lower(q), '[a-z0-9][a-z0-9_-]{2,}') as ws from build_sci_decisions where q is not null))),
 ask as (select rec_id, unnest(terms) as term from q), df as (select term, count(*) as df from post group by 1),
 sc as (select a.rec_id, p.row_id, round(sum(case when ln((st.n - d.df + 0.5)/(d.df + 0.5)) > 0 then ln((st.n - d.df + 0.5)/(d.df + 0.5)) else 1e-6 end * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / st.avgl))), 6) as score
   from ask a join df d using (term) join post p using (term), st group by 1, 2)""".replace("STOPLIST", "[" + ", ".join(f"'{w}'" for w in retrieval.STOPWORDS) + "]")


def _index(spark, d):
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.coalesce("mesh", F.lit("")))
    return retrieval.postings(t(spark, d, "articles"), "row_id", body)


def _asked(spark, d):
    return t(spark, d, "build_sci_decisions").filter("q is not null").select("rec_id", retrieval.query_terms(F.col("q")).alias("terms"))


@query("t01_bm25_top3", f"with {BM25_SQL} select rec_id, row_id, score, row_number() over (partition by rec_id order by score desc, row_id)::int as rank from sc qualify rank <= 3")
def t01(spark, d):
    return retrieval.bm25(_asked(spark, d), *_index(spark, d), "rec_id", "row_id", "terms")


TWO_SQL = """rk as (select rec_id, term, row_number() over (partition by rec_id order by length(term) desc, i) as k, count(*) over (partition by rec_id) as n from (select rec_id, unnest(terms) as term, unnest(range(len(terms))) as i from q)),
 con as (select a.rec_id, p.row_id, a.k, a.n, case when ln((st.n - d.df + 0.5)/(d.df + 0.5)) > 0 then ln((st.n - d.df + 0.5)/(d.df + 0.5)) else 1e-6 end * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.len / st.avgl)) as c from rk a join df d using (term) join post p using (term), st),
 a1 as (select rec_id, row_id, round(sum(c), 6) as score, 'and' as stage from con where k <= 4 group by rec_id, row_id having count(*) = least(4, max(n)) qualify row_number() over (partition by rec_id order by round(sum(c), 6) desc, row_id) <= 3),
 pm as (select distinct rec_id, row_id from (select rec_id, row_id, (k - 1) // 2 as g from con where k <= 8 and n >= 2 group by rec_id, row_id, (k - 1) // 2 having count(*) = max(case when ((k - 1) // 2 + 1) * 2 <= least(n, 8) then 2 else 1 end))),
 a2 as (select rec_id, row_id, round(sum(c), 6) as score, 'pairs' as stage from con join pm using (rec_id, row_id) where k <= 8 and rec_id not in (select rec_id from a1 group by 1 having count(*) >= 3) and (rec_id, row_id) not in (select (rec_id, row_id) from a1) group by rec_id, row_id)"""


@query("t02_two_stage", f"with {BM25_SQL}, {TWO_SQL} select rec_id, row_id, score, stage, row_number() over (partition by rec_id order by stage, score desc, row_id)::int as rank from (select * from a1 union all select * from a2) qualify rank <= 3")
def t02(spark, d):
    return retrieval.two_stage(_asked(spark, d), *_index(spark, d), "rec_id", "row_id", "terms").select("rec_id", "row_id", "score", "rank", "stage")


@query("t03_evidence", f"with {BM25_SQL}, r as (select rec_id, row_id, row_number() over (partition by rec_id order by score desc, row_id) as rank from sc qualify rank <= 3) select rec_id, substr(string_agg('Title: ' || coalesce(trim(title), '') || chr(10) || substr(trim(coalesce(abstract, '')), 1, 600), chr(10) || chr(10) order by rank), 1, 2400) as evidence from r join articles using (row_id) group by 1")
def t03(spark, d):
    hits = retrieval.bm25(_asked(spark, d), *_index(spark, d), "rec_id", "row_id", "terms")
    return retrieval.evidence(hits, t(spark, d, "articles"), "rec_id", "row_id", "title", "abstract")


@query("t06_winner_runner_up", f"with {PRED}, r as (select item_id, list_reverse_sort(p) as v, pred from s) select item_id, pred::int as winner, round(v[1], 6) as best, round(v[2], 6) as second, (v[1] >= 0.5 and v[1] - v[2] >= 0.2) as clear from r")
def t06(spark, d):
    keys = F.array(*[F.lit(k) for k in range(4)])
    r = predictions(spark, d).withColumn("r", scores.ranked(F.col("p"), keys))
    a, b = F.get("r", 0), F.get("r", 1)
    return r.select("item_id", a["key"].alias("winner"), F.round(a["p"], 6).alias("best"), F.round(b["p"], 6).alias("second"), ((a["p"] >= 0.5) & (a["p"] - b["p"] >= 0.2)).alias("clear"))


@query("f06_chunks", r"""with w as (select row_id, regexp_extract_all(abstract, '[^\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+') as w from articles where abstract is not null),
 s as (select row_id, w, case when len(w) <= 350 then [0] else range(0, len(w) - 60, 290) end as st from w where len(w) >= 80),
 e as (select row_id, w, unnest(range(len(st))) as chunk_id, unnest(st) as st from s), c as (select row_id, chunk_id, list_slice(w, st + 1, st + 350) as c from e)
 select row_id, min(chunk_id)::int as chunk_id, array_to_string(c, ' ') as chunk from c where len(c) >= 80 group by row_id, c""")
def f06(spark, d):
    return retrieval.chunk(t(spark, d, "articles").filter("abstract is not null"), "row_id", "abstract")


# ---- 2.9 scalar functions

@query("f03_token_sets", "select rec_id, len(list_distinct(regexp_extract_all(lower(q), '[a-z0-9]{3,}')))::int as t3, len(list_distinct(regexp_extract_all(lower(q), '[a-z0-9]{4,}')))::int as t4, len(list_distinct(regexp_extract_all(lower(q), '[a-z]{4,}')))::int as l4 from build_sci_decisions where q is not null")
def f03(spark, d):
    q = F.col("q")
    return t(spark, d, "build_sci_decisions").filter("q is not null").select("rec_id", F.size(text.token_set(q)).alias("t3"), F.size(text.token_set(q, 4)).alias("t4"), F.size(text.token_set(q, 4, True)).alias("l4"))


@query("f00_content_hash", r"select doc_id, sha256(trim(regexp_replace(nfc_normalize(text), '[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+', ' ', 'g'))) as content_hash from documents where text is not null")
def f00(spark, d):
    return t(spark, d, "documents").filter("text is not null").select("doc_id", text.fingerprint(F.col("text")).alias("content_hash"))


@query("f01_numbers", f"""with x as (select rec_id, n.i as i, n.x as x from (select rec_id, unnest([{{'i': k, 'x': l[k]}} for k in range(1, len(l) + 1)]) as n from (select rec_id, {_numbers_sql("a")} as l from build_sci_decisions where a is not null))),
 y as (select rec_id, i, replace(replace(x, ',', ''), '+', '') as x from x), z as (select *, regexp_extract(x, '^-?([0-9.]*)', 1) as m, regexp_extract(x, '[eE](-?[0-9]+)$', 1) as e from y),
 v as (select rec_id, string_agg({VALUE_SQL}, ',' order by i) as numbers from z group by 1)
 select rec_id, coalesce(numbers, '') as numbers from build_sci_decisions left join v using (rec_id) where a is not null""")
def f01(spark, d):
    return t(spark, d, "build_sci_decisions").filter("a is not null").select("rec_id", F.array_join(text.numbers(F.col("a")), ",").alias("numbers"))


@query("f05_scrub_latex", rf"""select doc_id, regexp_replace(regexp_replace(case when contains(text, '{text.BODY}') then substr(text, strpos(text, '{text.BODY}') + {len(text.BODY)}) else text end,
 '(?s)(\\%)|{text.LATEX}', '\1 ', 'g'), '[\s\x{{b}}\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}\x{{1c}}-\x{{1f}}]+', ' ', 'g') as prose from documents where text is not null""")
def f05(spark, d):
    return t(spark, d, "documents").filter("text is not null").select("doc_id", text.scrub_latex(F.col("text")).alias("prose"))


@query("f10_evidence_control", "select rec_id, 'Passage: ' || chr(10) || 'Question: ' || q as controlled, 9 as span_start, 9 as span_end, 'empty' as control_mode from build_sci_decisions where passage is not null and q is not null")
def f10(spark, d):
    sci = t(spark, d, "build_sci_decisions").filter("passage is not null and q is not null")
    states = sci.select("rec_id", F.concat(F.lit("Passage: "), "passage", F.lit("\nQuestion: "), "q").alias("state"), F.lit(9).alias("s"), (F.length("passage") + 9).alias("e"))
    return assemble.evidence_control(states, "state", "s", "e", F.lit(""), "empty").select("rec_id", "controlled", "span_start", "span_end", "control_mode")


@query("f12_call_text", "select event_id, event_type || '(k=' || json_extract_string(props, '$.k') || ')' as call from events where json_extract_string(props, '$.k') is not null")
def f12(spark, d):
    k = F.get_json_object("props", "$.k")
    return t(spark, d, "events").filter(k.isNotNull()).select("event_id", text.call_text(F.col("event_type"), F.create_map(F.lit("k"), k)).alias("call"))


@query("f15_reply_letters", r"select item_id, strpos('ABCD', case when regexp_matches(question, '^\s*[A-D]\b') then regexp_extract(question, '^\s*([A-D])\b', 1) else '?' end) - 1 as letter from build_qa_choice where question is not null")
def f15(spark, d):
    return t(spark, d, "build_qa_choice").filter("question is not null").select("item_id", text.leading_letter(F.col("question")).cast("bigint").alias("letter"))


@query("f17_letter_mass", """with x as (select item_id, exp(-(item_id % 7) / 3.0::double) as a, exp(-(item_id % 5) / 2.0::double) as b, exp(-1.0) as n from build_qa_choice)
 select item_id, round((a + b * (item_id % 2)) / (a + b), 6) as p0, round(a + b, 6) as coverage from x""")
def f17(spark, d):
    e = lambda token, lp: F.struct(token.alias("token"), lp.alias("logprob"))
    i = F.col("item_id")
    pairs = F.array(e(F.lit(" a"), -(i % 7) / 3.0), e(F.when(i % 2 == 1, "A").otherwise("B"), -(i % 5) / 2.0), e(F.lit("none"), F.lit(-1.0)))
    out = assemble.letter_mass(t(spark, d, "build_qa_choice").select("item_id", pairs.alias("pairs"), F.lit(4).alias("k")), "item_id", "pairs", "k")
    return out.select("item_id", F.round(F.get("p", 0), 6).alias("p0"), F.round("coverage", 6).alias("coverage"))


@query("f19_answers", f"with {PRED} select item_id, case item_id % 3 when 0 then 'o' || pred else null end as choice, round((list_max(p) - 0.25) / 0.75, 6) as concentration, round(p[2] + 2 * p[3] + 3 * p[4], 6) as level, round(ln(p_gold) + 0.75 * p_gold / sqrt(list_sum([x * x for x in p])), 6) as reward from s")
def f19(spark, d):
    keys = F.array(*[F.lit(f"o{k}") for k in range(4)])
    p = predictions(spark, d).withColumn("keys", keys).withColumn("kind", F.when(F.col("item_id") % 3 == 0, "choice").otherwise("score"))
    out = assemble.answer(p, "logits", "keys", "kind")
    return out.select("item_id", F.when(F.col("kind") == "choice", F.col("answer")).alias("choice"), F.round("concentration", 6).alias("concentration"), F.round(scores.expected_level(F.col("p")), 6).alias("level"), F.round(scores.reward(F.col("p"), F.col("gold")), 6).alias("reward"))


@query("f28_cosine_to_first", """with e as (select vec_id, embedding::double[] as v from embeddings), r as (select arg_min(v, vec_id) as ref from e)
 select vec_id, round(list_cosine_similarity(v, ref), 5) as cosine from e, r""")
def f28(spark, d):
    e = t(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    first = e.agg(F.min_by("v", "vec_id").alias("ref"))
    return e.crossJoin(F.broadcast(first)).select("vec_id", F.round(scores.cosine(F.col("v"), F.col("ref")), 5).alias("cosine"))


# ---- sources and incremental runs

@query("s07_corpus_records", "select row_id::varchar as id, title, nullif(abstract, '') as body from articles")
def s07(spark, d):
    from quillet.sources import files

    rows = t(spark, d, "articles").select(F.col("row_id").alias("id"), F.when(F.length("title") > 0, F.col("title")).alias("title"), F.col("abstract").alias("text"))
    return files.corpus_record(rows).select("id", "title", "body")


@query("s18_merge_caches", "select sha256(text) as key, max(length(text))::int as vec from documents where text is not null group by 1")
def s18(spark, d):
    from quillet.sources import files

    a = t(spark, d, "documents").filter("text is not null").select("doc_id", F.sha2("text", 256).alias("key"), F.length("text").alias("vec"))
    return files.merge_caches([a.filter("doc_id % 3 < 2").drop("doc_id"), a.filter("doc_id % 3 > 0").drop("doc_id")])


@query("s21_late_rows", "select date_trunc('day', created_at) as start, date_trunc('day', created_at) + interval 1 day as \"end\", count(*)::bigint as n, coalesce(sum((ingested_at::date - created_at::date > 0)::int), 0)::bigint as late from documents where created_at is not null group by 1, 2")
def s21(spark, d):
    from quillet.streaming import incremental

    out = incremental.late_counts(t(spark, d, "documents").filter("created_at is not null").withColumns({"c": F.col("created_at").cast("timestamp"), "i": F.col("ingested_at").cast("timestamp")}), "c", "i")
    return out.withColumns({"start": F.col("start").cast("timestamp_ntz"), "end": F.col("end").cast("timestamp_ntz"), "late": F.coalesce("late", F.lit(0))})
