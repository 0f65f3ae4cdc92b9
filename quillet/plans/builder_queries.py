"""Queries of batteries, converters, controlled variants, guards and readouts over the test tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillet.functions import scores, text
from quillet.operators import assemble, builders, decisions, guards, joins, metrics, records
from quillet.plans.queries import BM25_SQL, PRED, TWO_SQL, VALID, _index, pred_sql, predictions, rounded, t
from quillet.plans.registry import query

# every white space that Python's str.split() eats, and runs of it as one blank, in SQL
SPACE = r"[\s\x{b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1c}-\x{1f}]+"


def flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '{SPACE}', ' ', 'g'))"


def strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{SPACE}', ''), '{SPACE}$', '')"


def normal(c: str) -> str:
    return flat(f"nfc_normalize({c})")


def draw(seed: str, id: str, n: str) -> str:
    return f"(('0x' || substr(sha256('{seed}|' || {id}), 1, 8))::bigint % {n})"


# ---- batteries


def _sci(spark, d):
    """Records with a group (source and pid) and a split by the group's hash."""
    sci = t(spark, d, "build_sci_decisions").withColumn("split_group", F.concat_ws("|", F.coalesce("source", F.lit("")), F.col("pid")))
    b = records.bucket("split", "split_group", 20)
    return sci.withColumn("split", F.when(b < 13, "train").when(b < 16, "dev").otherwise("eval"))


@query("c01_battery")
def c01(spark, d):
    return builders.scientific_battery(_sci(spark, d))[0]


@query("c01_exclusions")
def c01x(spark, d):
    return builders.scientific_battery(_sci(spark, d))[1]


@query("c02_hard_choice")
def c02(spark, d):
    return builders.scientific_battery(_sci(spark, d), hard=True)[0].filter("kind = 'choice'")


TOOLS = ["click", "login", "purchase", "search", "view", "signup"]


def _calls(spark, d):
    k = F.get_json_object("props", "$.k")
    args = F.create_map(F.lit("k"), F.coalesce(k, F.lit("null")), F.lit("user"), F.col("user_id").cast("string"))
    call = F.struct(F.col("event_type").alias("tool"), args.alias("args"))
    gold = F.when(F.col("event_id") % 50 == 0, F.array(call, call)).otherwise(F.array(call))
    return t(spark, d, "events").select(F.col("event_id").alias("id"), F.concat_ws(" ", F.lit("please"), "event_type", F.lit("for"), (F.col("user_id") % 997).cast("string"), (F.col("event_id") % 7).cast("string")).alias("prompt"), gold.alias("gold"))


_TOOL_LIST = "[" + ", ".join(f"'{x}'" for x in TOOLS) + "]"
CALLS_SQL = f"""ev as (select event_id as id, event_type as tool, coalesce(json_extract_string(props, '$.k'), 'null') as k, user_id::varchar as u, event_id % 50 = 0 as twice,
  'please ' || event_type || ' for ' || (user_id % 997) || ' ' || (event_id % 7) as prompt from events),
 c as (select *, sha256(tool || '|' || k || '|' || u || '|' || twice) as g from ev), amb as (select prompt from c group by 1 having count(distinct g) > 1),
 r as (select *, case when twice then 'multiple_gold_calls' when not list_contains({_TOOL_LIST}, tool) then 'unknown_tool' when prompt in (select prompt from amb) then 'ambiguous_prompt_reference' end as why from c),
 f as (select *, coalesce(why, case when id <> min(id) over (partition by prompt, g, why) then 'duplicate_request' end) as reason from r)"""


@query("v09_tool_calls", f"with {CALLS_SQL} select id, reason from f")
def p09b(spark, d):
    return builders.tool_call_reasons(_calls(spark, d), TOOLS).select("id", "reason")


@query("c03_tool_battery", f"""with {CALLS_SQL}, ok as (select id, prompt, tool, k, u, 'Request: ' || prompt as state from f where reason is null),
 pool as (select distinct 'k' as name, k as value from ok union select distinct 'user', u from ok), h as (select name, value, sha256('argument|' || name || '|' || value) as h from pool),
 two as (select name, arg_min(value, h) as a, arg_max(value, h) as z from h group by 1),
 arg as (select id, 'k' as name, k as old from ok union all select id, 'user', u from ok),
 alt as (select id, name, case when a <> old then a when z <> old then z end as new from arg join two using (name)),
 sw as (select id, arg_min(name, sha256('pick|' || id || '|' || name)) as n, arg_min(new, sha256('pick|' || id || '|' || name)) as v from alt where new is not null group by 1),
 o as (select ok.*, sw.n, sw.v, [x for x in {_TOOL_LIST} if x <> tool] as w from ok left join sw using (id)),
 e as (select id, state, unnest([{{'j': 0, 'c': tool || '(k=' || k || ', user=' || u || ')', 'n': 0, 's': 2}}, {{'j': 1, 'c': w[{draw('tool', 'id', 'len(w)')} + 1] || '(k=' || k || ', user=' || u || ')', 'n': 1, 's': 0}},
   {{'j': 2, 'c': case when n is not null then tool || '(k=' || case when n = 'k' then v else k end || ', user=' || case when n = 'user' then v else u end || ')' end, 'n': 1, 's': 1}}], recursive := true) from o)
 select id, 'choice_' || id as qid, 'choice' as kind, state, list_position({_TOOL_LIST}, tool)::int - 1 as gold from ok
 union all select id, 'noul_' || id || '_' || j, 'noul', state || chr(10) || 'Proposed call: ' || c, n::int from e where c is not null
 union all select id, 'score_' || id || '_' || j, 'score', state || chr(10) || 'Proposed call: ' || c, s::int from e where c is not null""")
def c03(spark, d):
    return builders.tool_battery(_calls(spark, d), TOOLS)[0].select("id", "qid", "kind", "state", "gold")


def _expert(spark, d):
    qa = t(spark, d, "build_qa_choice")
    n = F.size("options")
    wrong = lambda k: F.get("options", (F.col("gold") + k) % n)
    return qa.filter("gold between 0 and 9 and size(options) > 0").select("item_id", "question", F.get("options", F.col("gold")).alias("a"), *[wrong(k).alias(f"w{k}") for k in (1, 2, 3)])


EXPERT_SQL = f"""x as (select item_id, question, options[gold + 1] as a, options[(gold + 1) % len(options) + 1] as w1, options[(gold + 2) % len(options) + 1] as w2, options[(gold + 3) % len(options) + 1] as w3 from build_qa_choice where gold between 0 and 9 and len(options) > 0),
 b as (select *, coalesce({flat('question')}, '') = '' or coalesce({flat('a')}, '') = '' or coalesce({flat('w1')}, '') = '' or coalesce({flat('w2')}, '') = '' or coalesce({flat('w3')}, '') = '' as blank from x),
 r as (select *, case when blank then 'invalid_schema' when len(list_distinct([{normal('a')}, {normal('w1')}, {normal('w2')}, {normal('w3')}])) < 4 then 'duplicate_options' end as why from b)"""


@query("v06_expert_schema", f"with {EXPERT_SQL} select item_id, why as reason from r")
def p06(spark, d):
    return builders.expert_reasons(_expert(spark, d), "question", "a", ["w1", "w2", "w3"]).select("item_id", "reason")


@query("c04_expert_items", f"""with {EXPERT_SQL}, s as (select *, sha256({normal(f"{strip('question')} || chr(1) || {strip('a')} || chr(1) || array_to_string(list_sort([{strip('w1')}, {strip('w2')}, {strip('w3')}]), chr(2))")}) as sid from r where why is null),
 k as (select * from s qualify row_number() over (partition by sid order by item_id) = 1)
 select item_id, 'item_' || substr(sid, 1, 20) as qid, 'Question: ' || {strip('question')} as state, list_sort([{strip('a')}, {strip('w1')}, {strip('w2')}, {strip('w3')}]) as options, {strip('a')} as answer from k""")
def c04a(spark, d):
    items = builders.expert_items(_expert(spark, d), "item_id", "question", "a", ["w1", "w2", "w3"])[0]
    return items.select("item_id", "qid", "state", F.array_sort("options").alias("options"), F.get("options", F.col("gold")).alias("answer"))


VERDICT = "case rec_id % 3 when 0 then ' support' when 1 then 'Contradict ' else 'nei' end"


def _claims(spark, d):
    return t(spark, d, "build_sci_decisions").select("rec_id", F.col("q").alias("claim"), F.coalesce("type", F.lit("")).alias("title"), F.when(F.col("passage").isNotNull(), F.split("passage", r"\. ")).alias("sentences"), F.expr(VERDICT).alias("verdict"))


CLAIM_SQL = f"""x as (select rec_id, trim(q) as claim, trim(coalesce(type, '')) as title, trim(array_to_string(string_split(passage, '. '), ' ')) as abstract, upper(trim({VERDICT})) as verdict from build_sci_decisions),
 r as (select *, title || chr(10) || abstract as evidence, case when coalesce({flat('claim')}, '') = '' or coalesce({flat('abstract')}, '') = '' then 'invalid_claim_schema' end as why from x)"""


@query("v07_claim_rows", f"with {CLAIM_SQL} select rec_id, verdict, evidence, why as reason from r")
def p07(spark, d):
    return builders.claim_rows(_claims(spark, d), "claim", "title", "sentences", "verdict").select("rec_id", "verdict", "evidence", "reason")


@query("c04_claim_items", f"""with {CLAIM_SQL}, s as (select *, sha256({normal("evidence || chr(1) || claim || chr(1) || verdict")}) as sid from r where why is null),
 k as (select *, 'Title: ' || title || chr(10) || 'Abstract: ' || abstract as shown from s qualify row_number() over (partition by sid order by rec_id) = 1),
 o as (select *, list_position(['SUPPORT', 'CONTRADICT', 'NEI'], verdict) - 1 as p from k)
 select rec_id, 'claim_' || substr(sid, 1, 20) || '_' || tag as qid, kind, shown || chr(10) || 'Claim: ' || claim as state, case tag when 'n' then (p > 0)::int when 'c' then p else 2 - p end::int as gold, length(shown)::int as span_end
 from o, (values ('n', 'noul'), ('c', 'choice'), ('s', 'score')) k(tag, kind)""")
def c04b(spark, d):
    return builders.claim_items(_claims(spark, d), "rec_id", "claim", "title", "sentences", "verdict", True)[0].select("rec_id", "qid", "kind", "state", "gold", "span_end")


KINDS = ["abstract", "fulltext", "note"]


@query("v08_text_labels", f"select doc_id, case when coalesce({flat('text')}, '') = '' then 'blank_text' when doc_id <> min(doc_id) over (partition by {flat('text')}, doc_id % 3) then 'duplicate_record' end as reason from documents")
def p08(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 3).cast("int").alias("label"))
    items, lost = builders.classification_items(docs, "doc_id", "text", "label", KINDS, "Which kind?")
    return items.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(lost.select("doc_id", "reason"))


@query("c04_text_items", f"""with x as (select doc_id, trim(text) as b, {flat('text')} as n, doc_id % 3 as g from documents), k as (select * from x where coalesce(n, '') <> '' qualify row_number() over (partition by n, g order by doc_id) = 1)
 select doc_id, 'text_' || substr(sha256(n || '|' || g), 1, 20) as qid, 'Text: ' || b as state, g::int as gold from k""")
def c04c(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "text", (F.col("doc_id") % 3).cast("int").alias("label"))
    return builders.classification_items(docs, "doc_id", "text", "label", KINDS, "Which kind?")[0].select("doc_id", "qid", "state", "gold")


@query("v24_text_for_kind", "select item_id, case when item_id % 2 = 0 then 2 else 1 end::int as questions from build_qa_choice where item_id % 5 <> 0")
def p24(spark, d):
    q = lambda kind: F.struct(F.lit(kind).alias("type"))
    i = F.col("item_id")
    many = F.when(i % 5 == 0, F.create_map(F.lit("x"), q("score"))).when(i % 2 == 0, F.create_map(F.lit("a"), q("noul"), F.lit("b"), q("noul"), F.lit("x"), q("score"))).otherwise(F.create_map(F.lit("a"), q("noul")))
    return builders.of_kind(t(spark, d, "build_qa_choice").select("item_id", many.alias("questions")), "questions", "noul").select("item_id", F.size("questions").alias("questions"))


# groups, owners and duplicates of the multiple-choice battery
ITEMS_SQL = rf"""i0 as (select *, case lower(trim(split)) when 'validation' then 'dev' when 'dev' then 'dev' when 'test' then 'eval' when 'eval' then 'eval' when 'train' then 'train' end as role from build_qa_choice),
 i1 as (select *, case when role is null then 'unsupported_split' when coalesce({flat('question')}, '') = '' or options is null or len(options) <> 4
    or len([o for o in options if coalesce({flat('o')}, '') = '']) > 0 or gold is null or gold not between 0 and 3 or coalesce(choice_type, 'single') <> 'single' then 'invalid_schema'
    when len(list_distinct([{flat('o')} for o in options])) < 4 then 'invalid_options' end as why from i0),
 i2 as (select *, sha256({flat('question')} || chr(1) || array_to_string(list_sort([{flat('o')} for o in options]), chr(2))) as sid, {flat('options[gold + 1]')} as answer, list_distinct(regexp_extract_all(lower(question), '[a-z0-9]{{3,}}')) as ts from i1 where why is null),
 bt as (select item_id as ref, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]{{3,}}')) as bs from benchmark),
 ov as (select a.item_id, b.ref, count(*) as k from (select item_id, unnest(ts) as w from i2) a join (select ref, unnest(bs) as w from bt) b using (w) group by 1, 2),
 near as (select distinct item_id from ov join i2 using (item_id) join bt using (ref) where k / (len(ts) + len(bs) - k) >= 0.6 - 1e-12),
 i3 as (select * from i2 where item_id not in (select item_id from near)),
 tok as (select item_id, 'c' || sha256({normal('question')}) as k from i3 union select item_id, 'g' || split_group from i3 where split_group is not null and split_group <> ''
   union select item_id, 'p' || coalesce(source, 'qa_battery') || '=' || concat_ws(':', source, source_id) from i3 where coalesce({flat('source_id')}, '') <> ''),
 star as (select t.item_id as a, m.b from tok t join (select k, min(item_id) as b from tok group by 1) m using (k) where t.item_id <> m.b), ed as (select a, b from star union select b, a from star),
 walk(node, seen) as (select item_id, item_id from i3 union select w.node, e.b from walk w join ed e on e.a = w.seen), comp as (select node as item_id, min(seen) as g from walk group by 1),
 own as (select g, max(case role when 'eval' then 2 when 'dev' then 1 else 0 end) as o from i3 join comp using (item_id) group by 1), cl as (select sid from i3 group by 1 having count(distinct answer) > 1),
 i4 as (select i3.*, comp.g, case when sid in (select sid from cl) then 'conflicting_gold' when case role when 'eval' then 2 when 'dev' then 1 else 0 end <> o then 'heldout_overlap' end as why2 from i3 join comp using (item_id) join own using (g)),
 i5 as (select item_id, role, g, coalesce(why2, case when item_id <> min(item_id) over (partition by sid, why2) then 'duplicate_record' end) as reason from i4)"""


@query("c05_choice_battery", f"with recursive {ITEMS_SQL} select item_id, role, reason from i5 union all select item_id, role, 'near_duplicate' from i2 where item_id in (select item_id from near) union all select item_id, role, why from i1 where why is not null")
def c05(spark, d):
    return builders.choice_battery(t(spark, d, "build_qa_choice"), t(spark, d, "benchmark")).select("item_id", "role", "reason")


@query("g01_record_groups", f"with recursive {ITEMS_SQL} select item_id, min(item_id) over (partition by g) as first_item, count(*) over (partition by g)::bigint as n from i4")
def g01b(spark, d):
    battery = builders.choice_battery(t(spark, d, "build_qa_choice"), t(spark, d, "benchmark")).filter("split_group is not null").select("item_id", "split_group")
    per = battery.groupBy("split_group").agg(F.min("item_id").alias("first_item"), F.count(F.lit(1)).alias("n"))
    return battery.join(per, "split_group").select("item_id", "first_item", "n")


@query("c05_dev_roles", f"""with recursive {ITEMS_SQL}, sg as (select i4.item_id, 'question:' || sha256('0' || min(sha256({normal('question')})) over (partition by g)) as split_group from i4)
 select item_id, split_group, case when {draw('7331', 'split_group', '4')} < 2 then 'select' when {draw('7331', 'split_group', '4')} = 2 then 'calibration' else 'policy' end as use from i5 join sg using (item_id) where reason is null and role = 'dev'""")
def c05b(spark, d):
    return builders.dev_roles(builders.choice_battery(t(spark, d, "build_qa_choice"), t(spark, d, "benchmark"))).select("item_id", "split_group", "use")


@query("c05_choice_decisions", f"""with recursive {ITEMS_SQL}, x as (select i5.item_id, i5.role, i4.question, i4.source, i4.options[i4.gold + 1] as a, [e.o for e in list_sort([{{'h': sha256(sid || '|' || o), 'o': o}} for o in i4.options])] as options from i5 join i4 using (item_id) where i5.reason is null)
 select item_id, role, concat_ws('_', 'qa', source, item_id) as qid, 'choice' as kind, 'Question: ' || trim(question, ' ') as state, '{builders.ASK_ITEM}' as instructions, options, list_position(options, a)::int - 1 as gold from x""")
def c05c(spark, d):
    return builders.choice_decisions(builders.choice_battery(t(spark, d, "build_qa_choice"), t(spark, d, "benchmark")))


# ---- controlled and grounded variants


def _requests(spark, d):
    """One noul, one score and one choice question per record with a passage, question, answer and pid."""
    sci = t(spark, d, "build_sci_decisions").filter(F.col("pid").isNotNull() & ~records.blank(F.col("passage")) & ~records.blank(F.col("q")) & ~records.blank(F.col("a")))
    base = sci.select("rec_id", "pid", F.col("rec_id").cast("string").alias("sample_id"), F.concat(F.lit("Passage: "), "passage", F.lit("\nQuestion: "), "q").alias("state"), F.lit(9).alias("span_start"), (F.length("passage") + 9).alias("span_end"), F.lit("train").alias("split"), F.concat_ws("|", F.coalesce("source", F.lit("")), "pid").alias("split_group"), "a")
    other = F.concat(F.lit("not "), "a")
    kinds = [("noul", builders.ASK_NOUL, F.array(F.lit("yes"), F.lit("no")), (F.col("rec_id") % 2).cast("int")), ("score", builders.ASK_SCORE, F.array(*[F.lit(x) for x in builders.LEVELS]), (F.col("rec_id") % 3).cast("int")), ("choice", builders.ASK_CHOICE, F.array("a", other), F.lit(0))]
    out = None
    for kind, ask, options, gold in kinds:
        part = base.select("rec_id", "pid", "sample_id", F.concat_ws("_", F.lit(kind), "sample_id").alias("qid"), F.lit(kind).alias("kind"), "state", F.lit(ask).alias("instructions"), options.alias("options"), gold.alias("gold"), "span_start", "span_end", "split", "split_group")
        out = part if out is None else out.unionByName(part)
    return out


REQUEST_SQL = f"""b as (select rec_id, a, 'Passage: ' || passage || chr(10) || 'Question: ' || q as state, passage, q, coalesce(source, '') || '|' || pid as grp from build_sci_decisions where pid is not null and {flat('passage')} <> '' and {flat('q')} <> '' and {flat('a')} <> ''),
 rq as (select rec_id, 'noul_' || rec_id as qid, 'noul' as kind, grp, passage, q, '{builders.ASK_NOUL}' as ask, ['yes', 'no'] as options, (rec_id % 2)::int as gold from b
   union all select rec_id, 'score_' || rec_id, 'score', grp, passage, q, '{builders.ASK_SCORE}', [{", ".join(f"'{x}'" for x in builders.LEVELS)}], (rec_id % 3)::int from b
   union all select rec_id, 'choice_' || rec_id, 'choice', grp, passage, q, '{builders.ASK_CHOICE}', [a, 'not ' || a], 0 from b),
 em as (select *, 'Passage: ' || chr(10) || 'Question: ' || q as bare from rq),
 dg as (select *, qid || '__evidence_empty_' || substr(sha256(concat_ws(chr(1), 'empty', bare, grp, qid, kind, ask, array_to_string(options, chr(2)))), 1, 16) as new from em)"""


@query("v17_encoded_requests", f"""with {REQUEST_SQL}, x as (select qid, kind, 'Passage: ' || passage || chr(10) || 'Question: ' || q || chr(10) || 'Question: ' || ask as c, case kind when 'noul' then ['yes', 'no'] else options end as o from rq)
 select qid, least(length(c), 640)::int as ctx, greatest(length(c) - 640, 0)::int as dropped, [least(length(t), 120)::int for t in o] as opts, case when length(c) > 640 or len([t for t in o if length(t) > 120]) > 0 then 'input_overflow' end as reason from x""")
def p17b(spark, d):
    rows = _requests(spark, d)
    criteria = F.when(F.col("kind") == "noul", None).otherwise(F.transform("options", lambda o: F.struct(o.alias("key"), F.when(F.col("kind") == "score", o).alias("description"))))
    out = decisions.encode_requests(rows.withColumn("criteria", criteria), lambda t: [ord(c) + 1 for c in t], overflow="exclude")
    return out.select("qid", F.size("ctx").alias("ctx"), F.col("ctx_dropped").alias("dropped"), F.transform("opts", lambda o: F.size(o)).alias("opts"), "reason")


@query("c06_empty_controls", f"with {REQUEST_SQL} select new as qid, qid as reference_qid, gold as reference_gold, bare as state, 9 as span_end, grp as source_group from dg")
def c06(spark, d):
    return builders.evidence_controls(_requests(spark, d), "empty").select("qid", "reference_qid", "reference_gold", "state", "span_end", "source_group")


@query("c06_shuffled_controls")
def c06b(spark, d):
    return builders.evidence_controls(_requests(spark, d), "shuffle").select("qid", "reference_qid", "reference_gold", "state", "span_end", "source_group", "donor_group")


@query("f24_reject_relabel", f"with {REQUEST_SQL} select new as qid, case kind when 'noul' then 1 else 0 end::int as gold, case kind when 'noul' then 'reject_on_unsupported' else 'reject_lowest_rubric' end as gold_semantics from dg where kind <> 'choice'")
def f24(spark, d):
    controls = builders.evidence_controls(_requests(spark, d), "empty")
    both = builders.rejected(controls, "noul").unionByName(builders.rejected(controls, "score"))
    return both.filter("reason is null").select("qid", "gold", "gold_semantics")


@query("c07_anti_leak_training")
def c07(spark, d):
    return builders.anti_leak_training(_requests(spark, d), "noul", ["empty", "shuffle"], 0.5).select("qid", "reference_qid", "gold", "control_mode", "state")


@query("c08_empty_choice", f"with {REQUEST_SQL} select new as qid, bare as state, [0.5, 0.5] as soft from dg where kind = 'choice'")
def c08(spark, d):
    return builders.anti_leak_choice(_requests(spark, d)).filter("reason is null").select("qid", "state", "soft")


def _with_provenance(spark, d):
    """The wrong option is told to come from the next record of the table."""
    rows = _requests(spark, d).filter("kind = 'choice'")
    p = F.struct(F.get("options", 1).alias("option"), (F.col("rec_id") + 1).cast("string").alias("sample_id"), F.col("pid").alias("pid"))
    return rows.withColumn("provenance", F.array(p))


def _transplanted(spark, d, donor):
    return builders.transplants(_with_provenance(spark, d), donor)


@query("c08_near_transplants")
def c08b(spark, d):
    return _transplanted(spark, d, "near").select("reference_qid", "donor", "donor_group", "reason", "state")


@query("c08_provenance_transplants", f"""with {REQUEST_SQL}, c as (select * from rq where kind = 'choice'), pid as (select split_part(grp, '|', 2) as p, * from c), byp as (select p, arg_min(grp, qid) as pg, arg_min(passage, qid) as pp from pid group by 1),
 j as (select x.qid, x.grp, x.passage, coalesce(s.grp, y.pg) as dg, coalesce(s.passage, y.pp) as dp from pid x left join c s on s.rec_id = x.rec_id + 1 left join byp y using (p))
 select qid as reference_qid, dg as donor_group, case when dg = grp or dp = passage then 'self_donor' end as reason, 1 as intended from j where dg is not null""")
def c08c(spark, d):
    return _transplanted(spark, d, "provenance").select("reference_qid", "donor_group", "reason", "intended")


@query("c08_relabel", f"""with {REQUEST_SQL}, c as (select qid, {draw('a', 'qid', '100')} / 100.0::double as a, {draw('b', 'qid', '100')} / 100.0::double as b, rec_id from rq where kind = 'choice'),
 w as (select *, case when b > a then 1 else 0 end as w from c)
 select qid, case when rec_id % 10 = 0 then 'teacher_missing' when greatest(a, b) < 0.5 or abs(a - b) < 0.1 - 1e-12 then 'uniform' when w = 0 then 'keep_gold' else 'relabel' end as decision, case when rec_id % 10 = 0 or greatest(a, b) < 0.5 or abs(a - b) < 0.1 - 1e-12 then null else w end as gold from w""")
def c08d(spark, d):
    rows = _requests(spark, d).filter("kind = 'choice'").withColumns({"reason": F.lit(None).cast("string"), "reference_gold": F.col("gold"), "intended": F.lit(None).cast("int")})
    asked = builders.teacher_requests(rows)
    said = asked.withColumn("p_true", F.when(F.col("option_index") == 0, records.bucket("a", "candidate_qid", 100)).otherwise(records.bucket("b", "candidate_qid", 100)) / 100.0)
    said = said.filter(~((F.substring_index("candidate_qid", "_", -1).cast("bigint") % 10 == 0) & (F.col("option_index") == 1)))
    return builders.relabel(rows, said.select("candidate_qid", "option_index", "p_true"), 0.5, 0.1 - 1e-12).select("qid", "decision", "gold")


@query("c09_grounded", f"""with {PRED}, a as (select row_id as item_id, case when coalesce({flat('mesh')}, '') <> '' then {{'t': trim(mesh), 'f': 'mesh'}} when coalesce({flat('title')}, '') <> '' then {{'t': trim(title), 'f': 'title'}} end as ev from articles)
 select item_id || '_gr-nev' as qid, case when ev is null then 'no_nev_evidence' end as reason, 'Item' || coalesce(chr(10) || chr(10) || 'Evidence: ' || ev.t, '') as state, ev.f as evidence_field from s left join a using (item_id)""")
def c09(spark, d):
    items = predictions(spark, d).select("item_id", F.col("item_id").cast("string").alias("qid"), F.lit("Item").alias("state"))
    evidence = t(spark, d, "articles").select(F.col("row_id").alias("item_id"), "mesh", "title")
    return builders.grounded_variants(items, evidence, "item_id", "nev", ["mesh", "title"]).select("qid", "reason", "state", "evidence_field")


@query("c10_retrieved", f"""with {BM25_SQL}, {TWO_SQL}, r as (select rec_id, row_id, row_number() over (partition by rec_id order by stage, score desc, row_id) as rank from (select * from a1 union all select * from a2) qualify rank <= 3),
 ev as (select rec_id, substr(string_agg('Title: ' || coalesce(trim(title), '') || chr(10) || substr(trim(coalesce(abstract, '')), 1, 600), chr(10) || chr(10) order by rank), 1, 2400) as e from r join articles using (row_id) group by 1)
 select rec_id || '_gr-retrieved' as qid, case when e is null then 'no_retrieved_evidence' end as reason, 'Question: ' || b.q || coalesce(chr(10) || chr(10) || 'Evidence: ' || trim(e), '') as state from build_sci_decisions b left join ev using (rec_id) where b.q is not null""")
def c10(spark, d):
    items = t(spark, d, "build_sci_decisions").filter("q is not null").select(F.col("rec_id").cast("string").alias("qid"), F.concat(F.lit("Question: "), "q").alias("state"))
    return builders.retrieved_variants(items, t(spark, d, "articles"), "row_id", "title", "abstract", _index(spark, d)).select("qid", "reason", "state")


# ---- joins, guards


@query("j04_zip_join", "with a as (select item_id, row_number() over (order by item_id) as place from build_qa_choice), b as (select rec_id, row_number() over (order by rec_id desc) as place from build_sci_decisions) select place, item_id, rec_id from a join b using (place)")
def j04(spark, d):
    a, b = t(spark, d, "build_qa_choice").select("item_id"), t(spark, d, "build_sci_decisions").select("rec_id", (-F.col("rec_id")).alias("o"))
    return guards.zip_rows([a, b], ["item_id", "o"], ["a", "b"]).select("place", "a.item_id", "b.rec_id")


@query("j06_cross_donors")
def j06(spark, d):
    sci = _sci(spark, d).filter(~records.blank(F.col("a")))
    return joins.ring_donors(sci, ["split"], "split_group", "a", "cross", most=4).select("split", "split_group", "a", F.transform("donors", lambda x: x["c"]).alias("answers"))


@query("v21_lineage", "select doc_id, paper_id, coalesce(source, 'unknown') as source, kind as reasoning_type from (select *, kind as type from documents)")
def p21(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "paper_id", "source", F.col("kind").alias("type"), "text")
    return guards.lineage(docs, "unknown", "unspecified").withColumn("reasoning_type", F.when(F.col("reasoning_type") == "unspecified", None).otherwise(F.col("reasoning_type")))


@query("v11_kind_filter", "select doc_id from documents where kind = 'fulltext'")
def p11(spark, d):
    return t(spark, d, "documents").filter("kind = 'fulltext'").select("doc_id")


@query("c18_recipes", "select * from (values ('choice', 2000, 'attnpool', 0.0::double), ('noul', 3000, 'mlp', 0.0::double), ('score', 3000, 'mlp', 1.0::double)) r(kind, steps, head_kind, ordinal)")
def c18(spark, d):
    return guards.recipes(spark).select("kind", "steps", "head_kind", "ordinal")


# ---- metrics and readouts


@query("a14_automation_rate", f"with {PRED}, r as (select row_number() over (order by round(conf, 9) desc, item_id) as k, sum(1 - correct) over (order by round(conf, 9) desc, item_id) as e from s) select count(*)::bigint as n, coalesce(max(case when e <= 0.3 * k + 1e-12 then k end), 0)::bigint as accepted, round(coalesce(max(case when e <= 0.3 * k + 1e-12 then k end), 0) / count(*), 6) as rate from r")
def a14(spark, d):
    p = predictions(spark, d).withColumn("p", F.transform("p", lambda x: F.round(x, 9)))
    return rounded(metrics.automation_rate(p, 0.3), "rate")


@query("a17_order_report", f"with {PRED}, l2 as (select item_id, pred as p2, correct as c2 from (with {pred_sql(5)} select * from s)) select count(*)::bigint as n, round(avg(correct), 6) as acc_order_a, round(avg(c2), 6) as acc_order_b, round(avg((pred <> p2)::int), 6) as flip_rate from s join l2 using (item_id)")
def a17b(spark, d):
    return rounded(metrics.order_report(predictions(spark, d), predictions(spark, d, 5), "item_id"), "acc_order_a", "acc_order_b", "flip_rate")


@query("c16_pair_report", f"""with {PRED} select count(*)::bigint as n, sum((logits[1] < logits[2])::int)::bigint as loss_wins, round(avg(logits[2] - logits[1]), 6) as loss_lead, sum((logits[3] > logits[4])::int)::bigint as span_wins, round(avg(logits[3] - logits[4]), 6) as span_lead,
 sum(((p[1] / (p[1] + p[2]) + p[3] / (p[3] + p[4])) / 2 > 0.5)::int)::bigint as option_wins, round(avg(p[1] / (p[1] + p[2]) + p[3] / (p[3] + p[4]) - 1), 6) as option_lead, round(avg((p[1] / (p[1] + p[2]) > 0.5)::int), 6) as acc_order_a, round(avg((p[3] / (p[3] + p[4]) > 0.5)::int), 6) as acc_order_b,
 sum((item_id % 3 <> item_id % 2)::int)::bigint as first_differs from s""")
def c16(spark, d):
    g = lambda c, i: F.get(c, i)
    rows = predictions(spark, d).select(
        g("logits", 0).alias("loss_ok"), g("logits", 1).alias("loss_bad"), g("logits", 2).alias("span_ok"), g("logits", 3).alias("span_bad"), (g("p", 0) / (g("p", 0) + g("p", 1))).alias("p_ok_first"),
        (g("p", 2) / (g("p", 2) + g("p", 3))).alias("p_ok_second"), F.array(F.col("item_id") % 3).alias("ok"), F.array(F.col("item_id") % 2).alias("bad"),
    )
    return rounded(metrics.pair_report(rows), "loss_lead", "span_lead", "option_lead", "acc_order_a", "acc_order_b")


@query("c20_harness_report", f"""with {PRED}, h as (select item_id, case when item_id % 11 = 0 then 0 else round(conf, 9) end as conf, case when item_id % 11 = 0 then 0 else correct end as correct, case when item_id % 11 = 0 then 0 else round(p_gold, 9) end as pg from s),
 b as (select ntile(10) over (order by conf, 'q' || item_id) as bin, conf, correct from h), g as (select bin, count(*) as n, avg(conf) as c, avg(correct) as a from b group by 1)
 select count(*)::bigint as n, round(avg(correct), 6) as accuracy, round(avg(-ln(greatest(pg, 1e-12))), 6) as nll, round(avg((conf - correct) ** 2), 6) as brier, (select round(sum(n * abs(c - a)) / sum(n), 6) from g) as ece from h""")
def c20(spark, d):
    p = predictions(spark, d)
    key = lambda i: F.concat(F.lit("o"), i.cast("string"))
    rows = p.select(F.concat(F.lit("q"), F.col("item_id").cast("string")).alias("qid"), F.lit("choice").alias("kind"), key(F.col("gold")).alias("gold_key"), F.map_from_arrays(F.array(*[F.lit(f"o{k}") for k in range(4)]), F.transform("p", lambda x: F.round(x, 9))).alias("probabilities"), F.lit(None).cast("double").alias("noul"), F.when(F.col("item_id") % 11 == 0, "timeout").alias("error"))
    return rounded(metrics.harness_report(rows), "accuracy", "nll", "brier", "ece")


@query("f16_stated_letters", r"""select item_id, case item_id % 7 when 0 then 'B' when 1 then 'C' when 2 then 'D' when 3 then 'A' when 4 then 'C' end as letter from build_qa_choice""")
def f16(spark, d):
    reply = F.element_at(F.array(*[F.lit(x) for x in ("Final answer (B)", "I say A. The correct answer: [C]", "answer D", "(a)", "answer: A, no, the answer is C", "no answer at all", "Because of B")]), (F.col("item_id") % 7 + 1).cast("int"))
    return t(spark, d, "build_qa_choice").select("item_id", text.stated_letter(reply).alias("letter"))


@query("f18_prompts", f"with {PRED}, x as (select item_id, options from build_qa_choice where {VALID}) select item_id, 'State' || chr(10) || chr(10) || 'Choose.' || chr(10) || chr(10) || 'A) ' || options[1] || chr(10) || 'B) ' || options[2] || chr(10) || 'C) ' || options[3] || chr(10) || 'D) ' || options[4] || chr(10) || chr(10) || 'Answer with only the letter of the best option.' as prompt from x where len([o for o in options if o is null]) = 0")
def f18(spark, d):
    qa = t(spark, d, "build_qa_choice").filter("gold between 0 and 3 and size(options) = 4")
    return qa.select("item_id", text.teacher_prompt(F.lit("State"), F.lit("Choose."), F.col("options")).alias("prompt")).filter("prompt is not null")


@query("f23_losses", f"""with {PRED} select item_id, round(ln(4.0), 6) as target_entropy, round(-ln(p_gold), 6) as cross_entropy, round(list_sum([(0.25 * ln(0.25 / x)) for x in p]), 6) as divergence,
 round(list_sum([greatest(logits[i], 0) - logits[i] * (gold > i - 1)::int + ln(1 + exp(-abs(logits[i]))) for i in [1, 2, 3, 4]]) / 4, 6) as ordinal from s""")
def f23(spark, d):
    one_hot = F.transform("p", lambda x, i: (F.col("gold") == i).cast("double"))
    u = scores.uniform(4)
    return predictions(spark, d).select("item_id", F.round(scores.cross_entropy(u, u), 6).alias("target_entropy"), F.round(scores.cross_entropy(one_hot, F.col("p")), 6).alias("cross_entropy"), F.round(scores.divergence(u, F.col("p")), 6).alias("divergence"), F.round(scores.ordinal_loss(F.col("logits"), F.col("gold")), 6).alias("ordinal"))


@query("f27_training_losses", f"""with {PRED}, x as (select *, ln(list_sum([exp(l) for l in logits])) as z, [0.7, 0.1, 0.1, 0.1] as t from s), y as (select *, [exp(l / 2) / list_sum([exp(k / 2) for k in logits]) for l in logits] as h from x)
 select item_id, round((z - logits[gold + 1] + z - logits[1]) / 2, 6) as info_nce, round(list_sum([t[i] * ln(t[i] / h[i]) for i in [1, 2, 3, 4]]), 6) as distillation,
 round(-(case when gold >= 1 then ln(1 - p[1]) else ln(p[1]) end + case when gold >= 2 then ln(1 - p[1] - p[2]) else ln(p[1] + p[2]) end + case when gold >= 3 then ln(1 - p[1] - p[2] - p[3]) else ln(p[1] + p[2] + p[3]) end) / 3, 6) as ordinal from y""")
def f27(spark, d):
    p = predictions(spark, d)
    soft = F.array(*[F.lit(x) for x in (0.7, 0.1, 0.1, 0.1)])
    return p.select("item_id", F.round(scores.info_nce(F.col("logits"), F.col("gold"), F.col("logits"), F.lit(0)), 6).alias("info_nce"), F.round(scores.distillation(soft, F.col("logits"), 2.0), 6).alias("distillation"), F.round(scores.ordinal_cross_entropy(F.col("p"), F.col("gold")), 6).alias("ordinal"))


@query("f29_pooling", """with e as (select vec_id, embedding::double[] as v from embeddings), x as (select vec_id, list_slice(v, 1, 4) as a, list_slice(v, 5, 8) as b, list_slice(v, 9, 12) as q from e),
 w as (select *, list_dot_product(a, q) as da, list_dot_product(b, q) as db from x)
 select vec_id, round((a[1] + b[1]) / 2, 5) as mean0, round((exp(da) * a[1] + exp(db) * b[1]) / (exp(da) + exp(db)), 5) as attended0 from w""")
def f29(spark, d):
    v = F.col("embedding").cast("array<double>")
    two = F.array(F.slice(v, 1, 4), F.slice(v, 5, 4))
    return t(spark, d, "embeddings").select("vec_id", F.round(F.get(scores.mean_pool(two, F.lit(0), F.lit(2)), 0), 5).alias("mean0"), F.round(F.get(scores.attention_pool(two, F.slice(v, 9, 4)), 0), 5).alias("attended0"))


@query("f30_readouts", f"with {PRED} select item_id, round(list_sum([ln(x) for x in p]), 6) as pll_sum, round(list_sum([ln(x) for x in p]) / 4, 6) as pll_mean, round(ln(p[2]), 6) as label_b from s")
def f30(spark, d):
    logp = F.transform("p", lambda x: F.log(x))
    r = predictions(spark, d).select("item_id", scores.token_readout(logp).alias("r"), scores.label_readout(F.array(F.array(F.lit(7)), F.array(F.lit(9))), F.create_map(F.lit(7), F.get(logp, 0), F.lit(9), F.get(logp, 1))).alias("l"))
    return r.select("item_id", F.round("r.sum", 6).alias("pll_sum"), F.round("r.mean", 6).alias("pll_mean"), F.round(F.get("l", 1), 6).alias("label_b"))
