"""Batteries of typed decisions, converters and controlled variants, composed of the other operators.

A decision is one row: qid, kind (choice, noul, score), state (text), instructions, options (array of texts) and gold (index
of the right option). Records that give none are rows with a reason; both together account for every record. Choices that
a sequential program draws at random are keyed by hashes, so they don't depend on order or partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions import text
from quillet.operators import assemble, decisions, graph, joins, records, retrieval
from quillet.session import cut

# Wordings of the questions, and the levels of a score from the lowest.
ASK_CHOICE = "Which answer correctly answers the question according to the supplied passage?"
ASK_NOUL = "Does the proposed answer correctly answer the question according to the supplied passage?"
ASK_SCORE = "Rate the proposed answer."
LEVELS = ("unrelated answer", "related but wrong answer", "correct answer")
ASK_ITEM = "Which answer is correct?"
ASK_CLAIM = "How does the passage relate to the claim?"
VERDICTS = ("SUPPORT", "CONTRADICT", "NEI")
YES_NO = ("yes", "no")

COLUMNS = ("qid", "kind", "state", "instructions", "options", "gold")


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _shuffled(options: Column, *seed: Column) -> Column:
    h = lambda o: F.sha2(F.concat_ws("|", *[s.cast("string") for s in seed], o), 256)
    return F.transform(F.array_sort(F.transform(options, lambda o: F.struct(h(o).alias("h"), o.alias("o")))), lambda s: s["o"])


def _index(options: Column, option: Column) -> Column:
    return F.array_position(options, option).cast("int") - 1


def excluded(df: DataFrame, id: str, kind: str | None = None) -> DataFrame:
    """(id, kind, reason) of the rows that have a reason."""
    return df.filter("reason is not null").select(id, F.lit(kind).cast("string").alias("kind"), "reason")


# ---- scientific questions


def prepared(sci: DataFrame, id: str = "rec_id") -> DataFrame:
    """(id, passage, q, a, split_group, ..) trimmed, with sample_id, the hashes h (passage), qn and an (question and answer in
    normal form), and reason duplicate_qa for all but the first of equal passage, question and answer. Blank ones are
    invalid_qa_schema."""
    rows = records.qa_schema(sci)
    rows = rows.withColumns({"h": text.fingerprint(F.col("passage")), "qn": text.fingerprint(F.col("q")), "an": text.fingerprint(F.col("a"))})
    rows = rows.withColumn("sample_id", F.sha2(F.concat_ws("|", F.coalesce("source", F.lit("")) if "source" in sci.columns else F.lit(""), "h", "qn", "an"), 256))
    good, bad = rows.filter("reason is null").drop("reason"), rows.filter("reason is not null")
    good = records.keep_first(good, ["h", "qn", "an"], id).drop("retained", "copies")
    return good.withColumn("reason", F.when(F.col("reason").isNotNull(), "duplicate_qa")).unionByName(bad)


def _negatives(rows: DataFrame, id: str, siblings: int, pool: int = 16) -> DataFrame:
    """(id, sibs, cross, perturbed): answers of other questions on the same passage in hash order, up to `siblings` (of the
    first `pool` of the passage, so a hot passage never meets itself); up to four answers of other groups of the split;
    up to three texts with another number. None is an answer that the same question on the same passage has."""
    right = rows.select("h", "qn", "an").distinct()
    sib = joins.siblings(rows.select(id, "h", "a"), "h", id, "a", pool).withColumn("an", text.fingerprint(F.col("sibling")))
    sib = sib.join(rows.select(id, "h", "qn"), id).join(right, ["h", "qn", "an"], "left_anti")
    sib = sib.groupBy(id).agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "sibling"))), lambda s: s["sibling"]), 1, siblings).alias("sibs"))
    far = joins.ring_donors(rows.select("split", "split_group", "a"), ["split"], "split_group", "a", "cross", most=4)
    far = far.select("split", "split_group", "a", F.posexplode(F.transform("donors", lambda d: d["c"])).alias("i", "c")).withColumn("an", text.fingerprint(F.col("c")))
    far = rows.select(id, "split", "split_group", "a", "h", "qn").join(far, ["split", "split_group", "a"]).join(right, ["h", "qn", "an"], "left_anti")
    far = far.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("cross"))
    own = rows.select(id, "h", "qn", F.posexplode(decisions.perturb_numbers(F.col("a"), F.col(id))).alias("i", "c")).withColumn("an", text.fingerprint(F.col("c"))).join(right, ["h", "qn", "an"], "left_anti")
    own = own.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "c"))), lambda s: s["c"]).alias("perturbed"))
    none = F.array().cast("array<string>")
    out = rows.select(id).join(sib, id, "left").join(far, id, "left").join(own, id, "left")
    return out.select(id, *[F.coalesce(c, none).alias(c) for c in ("sibs", "cross", "perturbed")])


def _different(options: Column) -> Column:
    """Texts that differ in normal form (without composition), the first of each."""
    plain = lambda o: text.collapse_space(o)
    return F.filter(options, lambda o, i: ~F.array_contains(F.transform(F.slice(options, F.lit(1), i), plain), plain(o)))


def scientific_battery(sci: DataFrame, id: str = "rec_id", hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """Records (id, passage, q, a, source, split, split_group) -> decisions and exclusions (id, kind, reason).

    Choice: the answer and three wrong ones, of which up to two answers of other questions on the passage, the answer with
    another number, and answers of other groups of the split; hard: up to three of the first kind and up to three
    of the second, none of other groups. Noul and score: the right answer (true, 2), a related wrong one (false, 1; another
    number, else another answer on the passage) and an unrelated one (false, 0). What there is too little of is excluded by
    reason: insufficient_unique_distractors, insufficient_related_negative, insufficient_cross_passage_negative.
    Null splits are a split of their own; null groups are one group.
    """
    rows = prepared(sci.withColumns({"split": F.coalesce("split", F.lit("")), "split_group": F.coalesce("split_group", F.lit(""))}), id)
    bad = excluded(rows, id)
    rows = rows.filter("reason is null")
    made = rows.join(_negatives(rows, id, 3 if hard else 2), id)
    first = F.slice("perturbed", 1, 1)
    pool = F.concat("sibs", "perturbed") if hard else F.concat("sibs", first, "cross")
    made = made.withColumn("wrong", F.slice(_different(pool), 1, 3))
    made = made.withColumn("state", F.concat(F.lit("Passage: "), "passage", F.lit("\nQuestion: "), "q")).withColumn("name", F.concat_ws("_", F.when(F.col("split") != "", F.col("split")), F.substring("sample_id", 1, 20)))
    enough = made.filter(F.size("wrong") == 3).withColumn("options", _shuffled(F.concat("wrong", F.array("a")), F.col(id)))
    choice = enough.select(id, F.concat(F.lit("choice_"), "name").alias("qid"), F.lit("choice").alias("kind"), "state", F.lit(ASK_CHOICE).alias("instructions"), "options", _index(F.col("options"), F.col("a")).alias("gold"))
    related = F.coalesce(F.get("perturbed", 0), F.get("sibs", 0))
    made = made.withColumn("related", related).withColumn("unrelated", F.get(F.filter("cross", lambda c: ~text.collapse_space(c).eqNullSafe(text.collapse_space(F.col("related")))), 0))
    offer = lambda c, ok, level: F.struct(c.alias("answer"), F.lit(ok).alias("ok"), F.lit(level).alias("level"))
    each = made.select(id, "name", "state", F.posexplode(F.filter(F.array(offer(F.col("a"), True, 2), offer(F.col("related"), False, 1), offer(F.col("unrelated"), False, 0)), lambda s: s["answer"].isNotNull())).alias("j", "o"))
    each = each.withColumn("state", F.concat("state", F.lit("\nProposed answer: "), "o.answer"))
    noul = each.select(id, F.concat_ws("_", F.lit("noul"), "name", "j").alias("qid"), F.lit("noul").alias("kind"), "state", F.lit(ASK_NOUL).alias("instructions"), _texts(YES_NO).alias("options"), F.when(F.col("o.ok"), 0).otherwise(1).alias("gold"))
    score = each.select(id, F.concat_ws("_", F.lit("score"), "name", "j").alias("qid"), F.lit("score").alias("kind"), "state", F.lit(ASK_SCORE).alias("instructions"), _texts(LEVELS).alias("options"), F.col("o.level").alias("gold"))
    why = lambda condition, kind, reason: made.filter(condition).select(id, F.lit(kind).alias("kind"), F.lit(reason).alias("reason"))
    lost = bad.unionByName(why(F.size("wrong") < 3, "choice", "insufficient_unique_distractors")).unionByName(why(F.col("related").isNull(), "noul/score", "insufficient_related_negative")).unionByName(why(F.col("unrelated").isNull(), "noul/score", "insufficient_cross_passage_negative"))
    return choice.unionByName(noul).unionByName(score), lost


# ---- tool calls


def tool_call_reasons(calls: DataFrame, tools: list[str]) -> DataFrame:
    """(id, prompt, gold array of (tool, args map of JSON texts)) -> the same with reason: multiple_gold_calls unless there is
    exactly one, unknown_tool, ambiguous_prompt_reference where one prompt has several gold calls, else duplicate_request
    for all but the first of equal prompt and call."""
    one = F.to_json(F.transform("gold", lambda g: F.struct(g["tool"].alias("tool"), F.array_sort(F.map_entries(g["args"])).alias("args"))))
    rows = calls.withColumns({"pn": text.fingerprint(F.col("prompt")), "gj": F.coalesce(one, F.lit(""))})
    several = rows.groupBy("pn").agg((F.min("gj") != F.max("gj")).alias("_several"))
    rows = rows.join(several, "pn", "left")
    tool = F.get("gold", 0)["tool"]
    routed = records.route(rows, [("invalid_prompt", records.blank(F.col("prompt")) | F.col("gold").isNull()), ("multiple_gold_calls", F.size("gold") != 1), ("unknown_tool", ~F.coalesce(tool.isin(tools), F.lit(False))), ("ambiguous_prompt_reference", F.col("_several"))]).drop("_several")
    good = records.keep_first(routed.filter("reason is null").drop("reason"), ["pn", "gj"], "id").drop("retained", "copies")
    good = good.withColumn("reason", F.when(F.col("reason").isNotNull(), "duplicate_request"))
    return good.unionByName(routed.filter("reason is not null"))


def tool_battery(calls: DataFrame, tools: list[str]) -> tuple[DataFrame, DataFrame]:
    """(id, prompt, gold) -> decisions and exclusions: which tool (choice among all tools), and for noul and score the call
    (true, 2), the call of another tool (false, 0) and the call with one argument's value swapped for one seen elsewhere
    (false, 1); without such a value insufficient_argument_pool."""
    rows = tool_call_reasons(calls, tools)
    bad = excluded(rows, "id")
    rows = rows.filter("reason is null").select("id", text.collapse_space(F.col("prompt")).alias("prompt"), F.get("gold", 0)["tool"].alias("tool"), F.get("gold", 0)["args"].alias("args"))
    rows = rows.withColumn("args", F.coalesce("args", F.create_map().cast("map<string,string>"))).withColumn("state", F.concat(F.lit("Request: "), "prompt"))
    swap = decisions.corrupt_argument(rows, "id", "args", assemble.argument_pool(rows, "args")).withColumnsRenamed({"name": "_n", "new": "_v"}).drop("old")
    full = rows.join(swap, "id", "left")
    wrong = F.array_except(_texts(tools), F.array("tool"))
    other = F.get(wrong, (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("tool"), F.col("id").cast("string")), 256), 1, 8), 16, 10).cast("bigint") % F.size(wrong)).cast("int"))
    changed = F.when(F.col("_n").isNotNull(), F.transform_values("args", lambda k, v: F.when(k == F.col("_n"), F.col("_v")).otherwise(v)))
    offer = lambda t, a, ok, level: F.struct(text.call_text(t, a).alias("call"), F.lit(ok).alias("ok"), F.lit(level).alias("level"))
    each = full.select("id", "state", F.posexplode(F.filter(F.array(offer(F.col("tool"), F.col("args"), True, 2), offer(other, F.col("args"), False, 0), offer(F.col("tool"), changed, False, 1)), lambda s: s["call"].isNotNull())).alias("j", "o"))
    each = each.withColumn("state", F.concat("state", F.lit("\nProposed call: "), "o.call"))
    qid = lambda kind: F.concat_ws("_", F.lit(kind), F.col("id").cast("string"), "j").alias("qid")
    choice = rows.select("id", F.concat_ws("_", F.lit("choice"), F.col("id").cast("string")).alias("qid"), F.lit("choice").alias("kind"), "state", F.lit("Which tool should be called?").alias("instructions"), _texts(tools).alias("options"), _index(_texts(tools), F.col("tool")).alias("gold"))
    noul = each.select("id", qid("noul"), F.lit("noul").alias("kind"), "state", F.lit("Is the proposed call right?").alias("instructions"), _texts(YES_NO).alias("options"), F.when(F.col("o.ok"), 0).otherwise(1).alias("gold"))
    score = each.select("id", qid("score"), F.lit("score").alias("kind"), "state", F.lit("Rate the proposed call.").alias("instructions"), _texts(("wrong tool", "wrong arguments", "right call")).alias("options"), F.col("o.level").alias("gold"))
    short = full.filter("_n is null").select("id", F.lit("noul/score").alias("kind"), F.lit("insufficient_argument_pool").alias("reason"))
    return choice.unionByName(noul).unionByName(score), bad.unionByName(short)


# ---- converters of benchmarks


def expert_reasons(df: DataFrame, question: str, right: str, wrong: list[str]) -> DataFrame:
    """Adds reason: invalid_schema if a field is blank, duplicate_options unless the answers differ in normal form."""
    fields = [question, right, *wrong]
    blank = F.exists(F.array(*[F.coalesce(records.blank(F.col(c)), F.lit(True)) for c in fields]), lambda x: x)
    answers = F.array(*[text.normalized(F.col(c)) for c in fields[1:]])
    return records.route(df, [("invalid_schema", blank), ("duplicate_options", F.size(F.array_distinct(answers)) < len(wrong) + 1)])


def expert_items(df: DataFrame, id: str, question: str, right: str, wrong: list[str]) -> tuple[DataFrame, DataFrame]:
    """Questions with one right and some wrong answers -> choice decisions and exclusions; of equal question, answer and set
    of wrong answers only the first stays."""
    rows = expert_reasons(df, question, right, wrong)
    bad = excluded(rows, id)
    strip = lambda c: F.regexp_replace(c, f"^{text.SPACE}|{text.SPACE}$", "")
    rows = rows.filter("reason is null").select(id, strip(F.col(question)).alias("q"), strip(F.col(right)).alias("a"), F.array(*[strip(F.col(w)) for w in wrong]).alias("w"))
    rows = rows.withColumn("sample_id", text.fingerprint(F.concat_ws("\u0001", "q", "a", F.array_join(F.array_sort("w"), "\u0002"))))
    rows = records.keep_first(rows, ["sample_id"], id)
    good = rows.filter("reason is null").withColumn("options", _shuffled(F.concat("w", F.array("a")), F.col("sample_id")))
    out = good.select(id, F.concat(F.lit("item_"), F.substring("sample_id", 1, 20)).alias("qid"), F.lit("choice").alias("kind"), F.concat(F.lit("Question: "), "q").alias("state"), F.lit(ASK_ITEM).alias("instructions"), "options", _index(F.col("options"), F.col("a")).alias("gold"))
    return out, bad.unionByName(excluded(rows, id, "choice"))


def claim_rows(df: DataFrame, claim: str, title: str, sentences: str, verdict: str) -> DataFrame:
    """Adds claim, title, abstract (sentences joined), evidence and verdict in normal form, and reason invalid_claim_schema
    where claim or abstract is blank or a sentence or the title is null. An unknown verdict fails the query."""
    known = F.upper(F.trim(F.coalesce(F.col(verdict), F.lit(""))))
    checked = F.when(known.isin(*VERDICTS), known).otherwise(F.raise_error(F.concat(F.lit("unknown verdict: "), F.coalesce(F.col(verdict), F.lit("null")))).cast("string"))
    abstract = F.when(F.exists(sentences, lambda s: s.isNull()), None).otherwise(F.trim(F.array_join(sentences, " ")))
    rows = df.withColumns({"_v": checked, "_a": abstract, "_t": F.trim(title), "_c": F.trim(claim)})
    bad = records.blank(F.col("_c")) | F.col("_t").isNull() | records.blank(F.col("_a"))
    rows = records.route(rows.drop("claim", "title", "abstract", "verdict"), [("invalid_claim_schema", bad)])
    rows = rows.withColumnsRenamed({"_v": "verdict", "_a": "abstract", "_t": "title", "_c": "claim"})
    return rows.withColumn("evidence", F.concat("title", F.lit("\n"), "abstract"))


def claim_items(df: DataFrame, id: str, claim: str, title: str, sentences: str, verdict: str, with_score: bool = False) -> tuple[DataFrame, DataFrame]:
    """Claims with evidence and a verdict -> noul (supported or not), choice (the verdict) and, if asked, score decisions (2,
    1, 0 for support, contradiction, neither), with the evidence's span, and exclusions; equal evidence, claim and verdict
    count once."""
    rows = claim_rows(df, claim, title, sentences, verdict)
    bad = excluded(rows, id)
    rows = rows.filter("reason is null").drop("reason").withColumn("sample_id", text.fingerprint(F.concat_ws("\u0001", "evidence", "claim", "verdict")))
    rows = records.keep_first(rows, ["sample_id"], id)
    good = rows.filter("reason is null").withColumn("shown", F.concat(F.lit("Title: "), "title", F.lit("\nAbstract: "), "abstract"))
    good = good.withColumns({"state": F.concat("shown", F.lit("\nClaim: "), "claim"), "name": F.concat(F.lit("claim_"), F.substring("sample_id", 1, 20)), "span_start": F.lit(0), "span_end": F.length("shown")})
    at = _index(_texts(VERDICTS), F.col("verdict"))
    kinds = [("n", "noul", "Does the passage support the claim?", YES_NO, F.when(F.col("verdict") == "SUPPORT", 0).otherwise(1)), ("c", "choice", ASK_CLAIM, VERDICTS, at)]
    if with_score:
        kinds.append(("s", "score", "Rate the claim.", LEVELS, 2 - at))
    out = None
    for tag, kind, ask, options, gold in kinds:
        part = good.select(id, F.concat("name", F.lit(f"_{tag}")).alias("qid"), F.lit(kind).alias("kind"), "state", F.lit(ask).alias("instructions"), _texts(options).alias("options"), gold.alias("gold"), "span_start", "span_end")
        out = part if out is None else out.unionByName(part)
    return out, bad.unionByName(excluded(rows, id))


def classification_items(df: DataFrame, id: str, body: str, label: str, names: list[str], ask: str, lead: str = "Text: ") -> tuple[DataFrame, DataFrame]:
    """Texts with a label index -> choice decisions with all names as options, and exclusions: blank_text, duplicate_record
    for later copies of text and label. A label that is null or names nothing fails the query."""
    if len(names) < 2 or len(set(names)) < len(names) or not all(n.strip() for n in names):
        raise ValueError("names must be two or more different non-blank texts")
    fine = F.col(label).isNotNull() & F.col(label).between(0, len(names) - 1)
    gold = F.when(fine, F.col(label)).otherwise(F.raise_error(F.concat(F.lit("no such label: "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("int"))
    rows = records.route(df.select(id, text.collapse_space(F.col(body)).alias("_n"), F.trim(body).alias("_b"), gold.cast("int").alias("gold")), [("blank_text", records.blank(F.col("_b")))])
    bad = excluded(rows, id)
    rows = records.keep_first(rows.filter("reason is null").drop("reason").withColumn("sample_id", F.sha2(F.concat_ws("|", "_n", F.col("gold").cast("string")), 256)), ["sample_id"], id)
    out = rows.filter("reason is null").select(id, F.concat(F.lit("text_"), F.substring("sample_id", 1, 20)).alias("qid"), F.lit("choice").alias("kind"), F.concat(F.lit(lead), "_b").alias("state"), F.lit(ask).alias("instructions"), _texts(names).alias("options"), "gold")
    return out, bad.unionByName(excluded(rows, id, "choice"))


def of_kind(items: DataFrame, questions: str, kind: str) -> DataFrame:
    """Requests with a map of questions (a struct with `type`): only the questions of a kind; requests without any go."""
    return items.withColumn(questions, F.map_filter(questions, lambda k, q: q["type"] == kind)).filter(F.size(questions) > 0)


def request_reasons(df: DataFrame, state: str, questions: str) -> DataFrame:
    """Requests with a map of questions (type, instructions, criteria: array of texts, label: text) -> reason: blank_state,
    no_questions, unknown_type, blank_instructions, bad_criteria (choice: 2 to 255 different ones; score: 2 to 10;
    noul: none or two), bad_label (choice: a criterion, noul: true or false, score: a level; null is no label)."""
    values = F.map_values(questions)
    some = lambda f: F.exists(values, f)
    n = lambda q: F.coalesce(F.size(q["criteria"]), F.lit(0))
    criteria = lambda q: ((q["type"] == "choice") & ((n(q) < 2) | (n(q) > 255) | (F.size(F.array_distinct(q["criteria"])) < n(q)))) | ((q["type"] == "score") & ~n(q).between(2, 10)) | ((q["type"] == "noul") & ~n(q).isin(0, 2))
    level = lambda q: q["label"].try_cast("int")
    label = lambda q: q["label"].isNotNull() & (((q["type"] == "choice") & ~F.array_contains(q["criteria"], q["label"])) | ((q["type"] == "noul") & ~q["label"].isin("true", "false")) | ((q["type"] == "score") & (level(q).isNull() | (level(q) < 0) | (level(q) >= n(q)))))
    return records.route(df, [
        ("blank_state", records.blank(F.col(state))), ("no_questions", F.col(questions).isNull() | (F.size(questions) == 0)), ("unknown_type", some(lambda q: q["type"].isNull() | ~q["type"].isin("choice", "noul", "score"))),
        ("blank_instructions", some(lambda q: records.blank(q["instructions"]))), ("bad_criteria", some(criteria)), ("bad_label", some(label)),
    ])


# ---- certified questions on long texts


def certified_questions(docs: DataFrame, id: str, body: str, kind: str, generate, answer, seed: str = "7331", blind: int = 3, most: int = 1) -> DataFrame:
    """Full texts (kind 'fulltext') -> questions that need the text: a window of each text, a reply of `generate` (a column
    function of the window), parsed; kept if `answer` (a column function of state, question, options and a number of the try,
    giving an index) is right with the window and at most `most` of `blind` times without. (id, window, question, options,
    gold, bucket): bucket is the hash of the document in 0..9, for splits by document."""
    rows = docs.filter(F.col(kind) == "fulltext").select(id, decisions.passage_window(text.scrub_latex(F.col(body)), F.col(id)).alias("window")).filter("window is not null")
    made = rows.withColumn("_r", decisions.parse_generated(generate(F.col("window")))).filter("_r is not null").select(id, "window", "_r.question", "_r.options", "_r.gold")
    seen = answer(F.col("window"), F.col("question"), F.col("options"), F.lit(0)) == F.col("gold")
    hits = sum(((answer(F.lit(""), F.col("question"), F.col("options"), F.lit(k)) == F.col("gold")).cast("int") for k in range(1, blind + 1)), F.lit(0))
    return made.filter(seen).filter(hits <= most).withColumn("bucket", records.bucket(seed, id, 10))


# ---- multiple-choice items


def choice_battery(items: DataFrame, references: DataFrame, id: str = "item_id", reference_text: str = "text", threshold: float = 0.6) -> DataFrame:
    """Items (id, question, options, gold, split, source, source_id, split_group, choice_type) -> every item once, with its
    role (train, dev, eval), split_group (new), sample_id and reason:

    invalid_schema, invalid_options, near_duplicate (its words have at least `threshold` in common with a reference's),
    conflicting_gold (equal question and options with different right answers), heldout_overlap (its group is owned by a more
    held-out role: eval before dev before train), duplicate_record (all but the first equal one of the kept), null for kept
    ones. An unknown or null split is unsupported_split.
    """
    role = F.lower(F.trim("split"))
    role = F.when(role.isin("validation", "dev"), "dev").when(role.isin("test", "eval"), "eval").when(role == "train", "train")
    rows = records.route(items.withColumn("role", role), [("unsupported_split", role.isNull()), *records.choice_reasons()])
    norm = F.transform("options", lambda o: text.collapse_space(o))
    rows = rows.withColumns({"sample_id": F.sha2(F.concat_ws("\u0001", text.collapse_space(F.col("question")), F.array_join(F.array_sort(norm), "\u0002")), 256), "answer": F.get(norm, F.col("gold"))})
    good, bad = rows.filter("reason is null").drop("reason"), rows.filter("reason is not null").withColumn("split_group", F.lit(None).cast("string"))
    words = good.select(id, text.token_set(F.col("question")).alias("ts"))
    known = references.select(F.monotonically_increasing_id().alias("ref"), text.token_set(F.col(reference_text)).alias("ts"))
    near = joins.jaccard_join(words, known, id, "ref", "ts", threshold).select(id).distinct().withColumn("_near", F.lit(True))
    good = good.join(near, id, "left")
    hit = good.filter("_near").drop("_near").withColumn("reason", F.lit("near_duplicate")).withColumn("split_group", F.lit(None).cast("string"))
    good = good.filter("_near is null").drop("_near")
    pid = F.when(~records.blank(F.col("source_id")), F.concat_ws(":", "source", "source_id"))
    grouped = graph.group_records(good.withColumn("pid", pid), id, F.col("question"), "question", "qa_battery").drop("pid", "content_hash", "group_scope")
    clash = records.conflicts(grouped, "sample_id", "answer").select("sample_id", F.lit(True).alias("_clash"))
    owner = records.owners(grouped, "split_group", "role", ["eval", "dev", "train"])
    grouped = grouped.join(clash, "sample_id", "left").join(owner, "split_group", "left")
    routed = records.route(grouped, [("conflicting_gold", F.col("_clash")), ("heldout_overlap", F.col("role") != F.col("owner"))]).drop("_clash", "owner")
    kept = records.keep_first(routed.filter("reason is null").drop("reason"), ["sample_id"], id).drop("retained", "copies")
    columns = [id, "role", "split_group", "sample_id", "question", "options", "gold", "source", "reason"]
    parts = [df.select(*columns) for df in (kept, routed.filter("reason is not null"), hit, bad)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def dev_roles(battery: DataFrame, seed: str = "7331") -> DataFrame:
    """Kept items of dev with their use by group: select, calibration and policy 2 : 1 : 1."""
    b = records.bucket(seed, "split_group", 4)
    return battery.filter("reason is null and role = 'dev'").withColumn("use", F.when(b < 2, "select").when(b == 2, "calibration").otherwise("policy"))


def choice_decisions(battery: DataFrame, id: str = "item_id") -> DataFrame:
    """Kept items as choice decisions; options in hash order."""
    right = F.get("options", F.col("gold"))
    rows = battery.filter("reason is null").withColumn("right", right).withColumn("options", _shuffled(F.col("options"), F.col("sample_id")))
    return rows.select(id, "role", F.concat_ws("_", F.lit("qa"), "source", F.col(id).cast("string")).alias("qid"), F.lit("choice").alias("kind"), F.concat(F.lit("Question: "), F.trim("question")).alias("state"), F.lit(ASK_ITEM).alias("instructions"), "options", _index(F.col("options"), F.col("right")).alias("gold"))


# ---- controlled and grounded variants


def evidence_controls(requests: DataFrame, mode: str, seed: str = "7331") -> DataFrame:
    """Decisions with evidence (COLUMNS, span_start, span_end, split, split_group) -> the same with their evidence taken out
    (mode empty) or swapped for that of another group of the split (shuffle; an error where there is none).

    gold and qid move to reference_gold and reference_qid; the new qid ends in __evidence_<mode>_ and a hash of the controlled
    question. control_mode, source_group, donor_group and the new span are added, label_status is evidence_control. Requests
    that can't serve as evidence fail the query, as do such that are controlled already.
    """
    if mode not in ("empty", "shuffle"):
        raise ValueError("mode must be empty or shuffle")
    if "control_mode" in requests.columns:
        raise ValueError("evidence controls need records that are not controlled already")
    why = decisions.evidence_problem(F.col("state"), F.col("span_start"), F.col("span_end"), F.col("split_group"))
    group = F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("no evidence: "), why)).cast("string")).otherwise(F.col("split_group"))
    rows = requests.withColumns({"source_group": group, "_e": F.substr("state", F.col("span_start") + 1, F.col("span_end") - F.col("span_start")), "_s": F.coalesce("split", F.lit(""))})
    if mode == "shuffle":
        donors = joins.ring_donors(rows.select("_s", "source_group", "_e"), ["_s"], "source_group", "_e", seed, missing="error").select("_s", "source_group", "_e", "donor_group", F.col("donor_content").alias("_by"))
        rows = rows.join(donors, ["_s", "source_group", "_e"])
    else:
        rows = rows.withColumns({"donor_group": F.lit(None).cast("string"), "_by": F.lit("")})
    return _controlled(rows, mode)


def _controlled(rows: DataFrame, mode: str) -> DataFrame:
    """Rows with _by in place of their evidence, renamed as evidence_controls says."""
    out = rows.withColumn("state", text.replace_span(F.col("state"), F.col("span_start"), F.col("span_end"), F.col("_by"))).withColumn("span_end", F.col("span_start") + F.length("_by"))
    parts = [F.lit(mode), F.col("state"), F.col("source_group"), F.col("qid"), F.col("kind"), F.col("instructions"), F.array_join("options", "\u0002")]
    digest = F.sha2(F.concat_ws("\u0001", *[F.coalesce(c, F.lit("")) for c in parts]), 256)
    out = out.withColumns({"reference_qid": F.col("qid"), "reference_gold": F.col("gold"), "qid": F.concat("qid", F.lit(f"__evidence_{mode}_"), F.substring(digest, 1, 16)), "control_mode": F.lit(mode), "label_status": F.lit("evidence_control")})
    return out.withColumn("gold", F.lit(None).cast("int")).drop("_by", "_e", "_s")


#: What a rejected noul or score question is answered with: no, the lowest level.
REJECT = {"noul": 1, "score": 0}


def rejected(controls: DataFrame, kind: str) -> DataFrame:
    """Controlled rows of a kind relabelled: gold is the rejecting option; noul_criteria_not_binary or score_criteria_missing
    is the reason of rows without such an option."""
    if kind not in REJECT:
        raise ValueError("kind must be noul or score")
    rows = controls.filter(F.col("kind") == kind).withColumns({"gold": F.lit(REJECT[kind]), "label_status": F.lit("antileak_train"), "gold_semantics": F.lit("reject_on_unsupported" if kind == "noul" else "reject_lowest_rubric")})
    if kind == "noul":
        return records.route(rows, [("noul_criteria_not_binary", F.coalesce(F.size("options"), F.lit(0)) != 2)])
    return records.route(rows, [("score_criteria_missing", F.coalesce(F.size("options"), F.lit(0)) < 1)])


def anti_leak_training(requests: DataFrame, kind: str, modes: list[str], share: float = 1.0, seed: str = "7331") -> DataFrame:
    """Controls of all modes that teach to reject unsupported questions, of each mode `share` (at least one row)."""
    if not 0 < share <= 1:
        raise ValueError("share must be above 0 and at most 1")
    out = None
    for mode in modes:
        part = rejected(evidence_controls(requests.filter(F.col("kind") == kind), mode, seed), kind).filter("reason is null")
        part = records.fraction(part, share, seed, "qid") if share < 1 else part
        out = part if out is None else out.unionByName(part)
    return out


def anti_leak_choice(requests: DataFrame, share: float = 1.0, seed: str = "7331") -> DataFrame:
    """Choice questions without their evidence, with a uniform soft target; choice_criteria_missing under two options."""
    rows = evidence_controls(requests.filter("kind = 'choice'"), "empty", seed)
    rows = records.fraction(rows, share, seed, "qid") if share < 1 else rows
    rows = records.route(rows, [("choice_criteria_missing", F.coalesce(F.size("options"), F.lit(0)) < 2)])
    return rows.withColumn("soft", F.transform("options", lambda o: 1.0 / F.size("options")))


def transplants(requests: DataFrame, donor: str, seed: str = "7331") -> DataFrame:
    """Choice questions (COLUMNS, span_start, span_end, split, split_group, sample_id, pid, provenance array of (option, sample_id,
    pid)) whose evidence is changed so that another option may become right; gold waits for relabel().

    donor near: the evidence of another group that is nearest to question and options by tf-idf; random: of another group by
    hash; provenance: the passage that a wrong option was taken from (by sample_id, else pid); perturb: the evidence with the
    one run of words replaced by which the option differs from the right one. Added: donor, donor_group, intended (index of
    the option that should become right), reason (no_transplant_donor, self_donor, perturb_edit_no_effect,
    choice_label_not_in_criteria). Of equal question and state only one stays.
    """
    rows = requests.filter("kind = 'choice'").withColumns({"source_group": F.col("split_group"), "_e": F.substr("state", F.col("span_start") + 1, F.col("span_end") - F.col("span_start"))})
    empty = F.lit(None).cast("int")
    if donor == "random":
        one = F.lit("all").alias("_w")
        d = joins.ring_donors(rows.select(one, "source_group", "_e"), ["_w"], "source_group", "_e", seed).select("source_group", "_e", "donor_group", F.col("donor_content").alias("_by"))
        rows = rows.join(d, ["source_group", "_e"], "left").withColumn("intended", empty)
    elif donor == "near":
        mark = F.when(F.col("_e").isNotNull(), F.xxhash64("_e"))
        # both once: the requests behind them are dear
        asked = cut(rows.select("qid", F.concat_ws(" ", text.question_tail(F.col("state")), F.array_join("options", " ")).alias("t"), F.col("source_group").alias("grp"), mark.alias("evid")))
        texts = cut(rows.groupBy(F.col("source_group").alias("grp"), F.col("_e").alias("t")).agg(F.min(F.xxhash64("qid")).alias("did")))
        near = joins.nearest_by_tfidf(asked, texts.withColumn("evid", F.when(F.col("t").isNotNull(), F.xxhash64("t"))), "qid", "did", "t", apart=["grp", "evid"], fallback=True)
        rows = rows.join(near.select("qid", "did"), "qid", "left").join(texts.select("did", F.col("grp").alias("donor_group"), F.col("t").alias("_by")), "did", "left").drop("did").withColumn("intended", empty)
    elif donor == "provenance":
        by = lambda c: rows.filter(F.col(c).isNotNull()).groupBy(F.col(c).alias(f"_{c}")).agg(F.min_by(F.struct("source_group", "_e"), "qid").alias(f"_at_{c}"))
        each = rows.withColumn("_p", F.explode("provenance"))
        each = each.withColumn("intended", _index(F.col("options"), F.col("_p.option"))).filter("intended >= 0")
        each = each.withColumns({"_k1": F.col("_p.sample_id"), "_k2": F.col("_p.pid")}).join(by("sample_id"), F.col("_k1") == F.col("_sample_id"), "left").join(by("pid"), F.col("_k2") == F.col("_pid"), "left")
        rows = each.withColumn("_at", F.coalesce("_at_sample_id", "_at_pid")).filter("_at is not null").withColumns({"donor_group": F.col("_at.source_group"), "_by": F.col("_at._e")}).drop("_p", "_k1", "_k2", "_sample_id", "_pid", "_at_sample_id", "_at_pid", "_at")
    elif donor == "perturb":
        each = rows.select("*", F.posexplode("options").alias("intended", "_o")).filter(F.col("intended") != F.col("gold"))
        each = each.withColumn("_edit", decisions.single_edit(F.get("options", F.col("gold")), F.col("_o"))).filter("_edit is not null")
        rows = each.withColumns({"_by": decisions.apply_edit(F.col("_e"), F.col("_edit.src"), F.col("_edit.dst")), "donor_group": F.col("source_group")}).drop("_o", "_edit")
    else:
        raise ValueError("donor must be near, random, provenance or perturb")
    same = (F.col("donor_group") == F.col("source_group")) | (F.col("_by") == F.col("_e"))
    missing = F.col("_by").isNull()
    reasons = {"perturb": [("perturb_edit_no_effect", missing)], "provenance": [("self_donor", same)]}.get(donor, [("no_transplant_donor", missing)])
    rows = records.route(rows, [("choice_label_not_in_criteria", F.col("gold").isNull() | (F.size("options") < 2) | ~F.col("gold").between(0, F.size("options") - 1)), *reasons]).withColumn("donor", F.lit(donor))
    good = _controlled(rows.filter("reason is null"), "transplant").dropDuplicates(["qid"])
    bad = rows.filter("reason is not null").withColumns({"reference_qid": F.col("qid"), "reference_gold": F.col("gold"), "control_mode": F.lit("transplant"), "label_status": F.lit("evidence_control")}).withColumn("gold", empty).drop("_by", "_e", "_s")
    return good.unionByName(bad)


def teacher_requests(candidates: DataFrame) -> DataFrame:
    """One noul question per option of each candidate: (qid, candidate_qid, option_index, state, instructions, options)."""
    each = candidates.filter("reason is null").select(F.col("qid").alias("candidate_qid"), "state", F.posexplode("options").alias("option_index", "_o"))
    return each.select(F.concat_ws("__opt", "candidate_qid", "option_index").alias("qid"), "candidate_qid", "option_index", F.lit("noul").alias("kind"), F.concat("state", F.lit("\nProposed answer: "), "_o").alias("state"), F.lit(ASK_NOUL).alias("instructions"), _texts(YES_NO).alias("options"))


def relabel(candidates: DataFrame, verdicts: DataFrame, tau: float, margin: float) -> DataFrame:
    """Candidates with the teacher's verdicts (candidate_qid, option_index, p_true) -> the same with gold or a uniform soft
    target, and decision: keep_gold, prov_confirmed (the intended option), relabel, uniform where no option has tau and is
    ahead by margin, teacher_missing where an option has no verdict. Ties go to the smaller index."""
    got = verdicts.groupBy("candidate_qid").agg(F.array_sort(F.collect_list(F.struct("option_index", "p_true"))).alias("_v"))
    rows = candidates.filter("reason is null").join(got.withColumnRenamed("candidate_qid", "qid"), "qid", "left")
    order = F.array_sort(F.transform("_v", lambda s: F.struct((-s["p_true"]).alias("n"), s["option_index"].alias("i"))))
    rows = rows.withColumn("_o", order).withColumn("_w", F.get("_o", 0)["i"])
    best, second = -F.get("_o", 0)["n"], -F.get("_o", 1)["n"]
    whole = F.coalesce(F.size("_v") == F.size("options"), F.lit(False))
    clear = (best >= tau) & (second.isNull() | (best - second >= margin))
    decision = F.when(~whole, "teacher_missing").when(~clear, "uniform").when(F.col("_w") == F.col("reference_gold"), "keep_gold").when(F.col("_w") == F.col("intended"), "prov_confirmed").otherwise("relabel")
    rows = rows.withColumn("decision", decision).withColumn("gold", F.when(F.col("decision").isin("keep_gold", "prov_confirmed", "relabel"), F.col("_w")))
    return rows.withColumn("soft", F.when(F.col("decision") == "uniform", F.transform("options", lambda o: 1.0 / F.size("options")))).drop("_v", "_o", "_w")


def grounded_variants(items: DataFrame, evidence: DataFrame, key: str, arm: str, columns: list[str]) -> DataFrame:
    """Choice decisions with evidence from another table (key, columns): the first non-blank column's text is appended to
    the state; qid ends in _gr-<arm>; evidence_field names the column; without any, reason is no_<arm>_evidence."""
    pick = F.coalesce(*[F.when(~records.blank(F.col(c)), F.struct(F.trim(c).alias("text"), F.lit(c).alias("field"))) for c in columns])
    got = items.join(evidence.select(key, pick.alias("_p")), key, "left")
    out = records.route(got, [(f"no_{arm}_evidence", F.col("_p").isNull())])
    return out.withColumns({"state": F.when(F.col("_p").isNotNull(), F.concat("state", F.lit("\n\nEvidence: "), "_p.text")).otherwise(F.col("state")), "evidence_field": F.col("_p.field"), "evidence_arm": F.lit(arm), "qid": F.concat("qid", F.lit(f"_gr-{arm}"))}).drop("_p")


def retrieved_variants(items: DataFrame, docs: DataFrame, id: str, title: str, body: str, index: tuple[DataFrame, DataFrame], top: int = 3) -> DataFrame:
    """Choice decisions with evidence retrieved for their questions in two stages; no_retrieved_evidence without any hit."""
    asked = items.select("qid", retrieval.query_terms(text.question_text(F.col("state"))).alias("terms"))
    hits = retrieval.two_stage(asked, *index, "qid", id, "terms", top)
    found = retrieval.evidence(hits, docs, "qid", id, title, body)
    return grounded_variants(items, found, "qid", "retrieved", ["evidence"])
