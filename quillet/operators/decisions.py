"""Typed decisions: encoding with budgets, layouts, negatives, minimal edits, batteries, checks and audits."""

from __future__ import annotations

import decimal
import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions import text
from quillet.operators import records


def encoder(encode: Callable[[str], list[int]]):
    """A column function of an injected tokenizer (text to ids), run in Arrow batches. Null gives null."""

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else encode(t))

    return ids


def with_budget(ids: Column, most: int) -> Column:
    """(ids, dropped): at most `most` ids and how many were cut."""
    return F.struct(F.slice(ids, 1, most).alias("ids"), F.greatest(F.size(ids) - most, F.lit(0)).alias("dropped"))


def route_overflow(df: DataFrame, dropped: Column, policy: str) -> DataFrame:
    """policy error fails, exclude gives reason input_overflow, truncate keeps."""
    if policy == "error":
        return df.filter(F.when(dropped > 0, F.raise_error(F.lit("input exceeds its budget")).cast("boolean")).otherwise(True)).withColumn("reason", F.lit(None).cast("string"))
    if policy not in ("exclude", "truncate"):
        raise ValueError("policy must be error, exclude or truncate")
    return df.withColumn("reason", F.when((dropped > 0) & F.lit(policy == "exclude"), "input_overflow"))


def option_texts(kind: Column, criteria: Column) -> Column:
    """(key, text) of each option of a question, criteria being an array of (key, description): choice: the key, or
    `key: description`; noul: yes and no for true and false, with the descriptions if there are any; score: the
    descriptions, with their level as key. Null criteria of a noul are none."""
    empty = F.coalesce(criteria, F.array().cast("array<struct<key:string,description:string>>"))
    plain = F.transform(empty, lambda c: F.struct(c["key"].alias("key"), F.when(c["description"].isNull(), c["key"]).otherwise(F.concat(c["key"], F.lit(": "), c["description"])).alias("text")))
    given = lambda key: F.get(F.filter(empty, lambda c: c["key"] == key), 0)["description"]
    side = lambda key, word: F.struct(F.lit(key).alias("key"), F.concat_ws(": ", F.lit(word), given(key)).alias("text"))
    levels = F.transform(empty, lambda c, i: F.struct(i.cast("string").alias("key"), c["description"].alias("text")))
    return F.when(kind == "choice", plain).when(kind == "noul", F.array(side("true", "yes"), side("false", "no"))).when(kind == "score", levels)


def encode_requests(df: DataFrame, encode: Callable[[str], list[int]], max_ctx: int = 640, max_opt: int = 120, overflow: str = "error") -> DataFrame:
    """Questions (state, kind, instructions, criteria) -> the same with ctx, opts, option_keys, ctx_dropped, opt_dropped and
    reason: the context is `state`, a line break and `Question: instructions`; options are option_texts. Over its budget an
    input fails (error), is cut (truncate) or gets reason input_overflow (exclude). A question of another kind, or with under
    two or too many options (255, of a score 10), has null opts and reason invalid_question."""
    ids = encoder(encode)
    options = option_texts(F.col("kind"), F.col("criteria"))
    rows = df.withColumn("_o", options).withColumn("_c", ids(F.concat(F.coalesce("state", F.lit("")), F.lit("\nQuestion: "), F.coalesce("instructions", F.lit("")))))
    fine = F.col("_o").isNotNull() & (F.size("_o") >= 2) & (F.size("_o") <= F.when(F.col("kind") == "score", 10).otherwise(255)) & ~records.blank(F.col("instructions")) & ~F.exists("_o", lambda o: records.blank(o["text"]))
    many = _many(encode)
    rows = rows.withColumn("_o", F.when(F.coalesce(fine, F.lit(False)), F.col("_o"))).withColumn("_t", many(F.transform("_o", lambda o: o["text"])))
    out = rows.withColumns({
        "ctx": F.slice("_c", 1, max_ctx), "opts": F.transform("_t", lambda o: F.slice(o, 1, max_opt)), "option_keys": F.transform("_o", lambda o: o["key"]),
        "ctx_dropped": F.greatest(F.size("_c") - max_ctx, F.lit(0)), "opt_dropped": F.transform("_t", lambda o: F.greatest(F.size(o) - max_opt, F.lit(0))),
    }).drop("_c", "_o", "_t")
    dropped = F.col("ctx_dropped") + F.coalesce(F.aggregate("opt_dropped", F.lit(0), lambda a, x: a + x), F.lit(0))
    routed = route_overflow(out, dropped, overflow)
    return routed.withColumn("reason", F.when(F.col("opts").isNull(), "invalid_question").otherwise(F.col("reason")))


def _many(encode: Callable[[str], list[int]]):
    @F.pandas_udf(T.ArrayType(T.ArrayType(T.IntegerType())))
    def ids(s: pd.Series) -> pd.Series:
        return s.map(lambda texts: None if texts is None else [encode(t) for t in texts])

    return ids


def layout(ctx: Column, opts: Column, length: int, markers: bool = False) -> Column:
    """How context and options share `length` places: (ctx_cap, opt_cap, ctx_cut, bounds): bounds are the [start, end) of
    each option after the context, one place more each with markers."""
    k = F.size(opts)
    m = k if markers else F.lit(0)
    ctx_cap = F.least(F.lit(length // 2), length - k - m)
    kept = F.least(F.size(ctx), ctx_cap)
    opt_cap = F.floor((length - kept - m) / k).cast("int")
    sizes = F.transform(opts, lambda o: F.least(F.size(o), opt_cap))
    step = 1 if markers else 0
    starts = F.aggregate(sizes, F.array(kept.cast("int")), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n + step)))
    bounds = F.transform(sizes, lambda n, i: F.struct((F.get(starts, i) + step).alias("start"), (F.get(starts, i) + step + n).alias("end")))
    return F.struct(ctx_cap.alias("ctx_cap"), opt_cap.alias("opt_cap"), F.greatest(F.size(ctx) - ctx_cap, F.lit(0)).alias("ctx_cut"), bounds.alias("bounds"))


_NUMBER = re.compile(text.NUMBER.removeprefix("(?U)"))
# What a number is multiplied by, and what is added where that changes nothing.
FACTORS, ADDENDS = ("0.1", "0.5", "2", "10"), (1, 2, 5)


def _perturbed(answer: str, draw: bytes) -> str | None:
    """answer with one number changed: exact decimals of any size; draw picks the number, the factor and the addend."""
    plain = answer.replace("\u2212", "-")
    found = list(_NUMBER.finditer(plain))
    if not found:
        return None
    m = found[int.from_bytes(draw[:4]) % len(found)]
    literal = m.group().replace(",", "")
    with decimal.localcontext(decimal.Context(prec=max(28, len(literal) + 16), Emax=decimal.MAX_EMAX, Emin=decimal.MIN_EMIN)):
        try:
            x = decimal.Decimal(literal)
            y = x * decimal.Decimal(FACTORS[draw[4] % 4])
            shown = f"{y if y != x else x + ADDENDS[draw[5] % 3]:g}"
        except (decimal.DecimalException, ValueError, MemoryError):
            return None
    return answer[: m.start()] + shown + answer[m.end() :]


def perturb_numbers(answer: Column, seed: Column, most: int = 3, draws: int = 12) -> Column:
    """Up to `most` different texts, each the answer with one of its numbers times 0.1, 0.5, 2 or 10, or plus 1, 2 or 5 where
    that changes nothing (zero); as many as `draws` draws of a hash of seed give. Equal up to white space counts as equal,
    the answer itself as none. Empty where there is no number, null for null. Decimals are exact at any size and exponent.
    Python runs only on texts that hold a digit."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def run(a: pd.Series, s: pd.Series) -> pd.Series:
        out = []
        for x, z in zip(a, s):
            seen, got = {" ".join(x.split())}, []
            for k in range(draws):
                y = _perturbed(x, hashlib.sha256(f"{z}|{k}".encode()).digest())
                if y is None or len(got) == most:
                    break
                if (key := " ".join(y.split())) not in seen:
                    seen.add(key)
                    got.append(y)
            out.append(got)
        return pd.Series(out)

    none = F.array().cast("array<string>")
    return F.when(answer.isNull(), F.lit(None).cast("array<string>")).when(~answer.rlike(r"(?U)\d"), none).otherwise(run(F.coalesce(answer, F.lit("")), F.coalesce(seed.cast("string"), F.lit(""))))


def perturb_number(answer: Column, seed: Column) -> Column:
    """The first of perturb_numbers, null if there is none."""
    return F.get(perturb_numbers(answer, seed, 1), 0)


def single_edit(gold: Column, other: Column) -> Column:
    """(src, dst) if the words of two texts differ in exactly one replaced run, by their common beginning and end; else null."""
    pair = F.struct(text.words(gold).alias("a"), text.words(other).alias("b"))

    def edit(s: Column) -> Column:
        a, b = s["a"], s["b"]
        n = F.least(F.size(a), F.size(b))
        differ = lambda x, y: F.array_position(F.concat(F.zip_with(F.slice(x, F.lit(1), n), F.slice(y, F.lit(1), n), lambda p, q: p != q), F.array(F.lit(True))), True).cast("int") - 1
        start = differ(a, b)
        end = F.least(differ(F.reverse(a), F.reverse(b)), n - start)
        cut = lambda x: F.array_join(F.slice(x, start + 1, F.size(x) - start - end), " ")
        return F.when((F.size(a) > start + end) & (F.size(b) > start + end), F.struct(cut(a).alias("src"), cut(b).alias("dst")))

    return F.get(F.transform(F.array(pair), edit), 0)


def apply_edit(evidence: Column, src: Column, dst: Column) -> Column:
    """evidence with all whole occurrences of src (not inside a word or number) replaced; null if there are none."""
    quoted = F.concat(F.lit(r"(?U)(?<![\w.])\Q"), F.replace(src, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit(r"\E(?![\w.])"))
    plain = F.regexp_replace(dst, r"([\\$])", r"\\$1")
    new = F.regexp_replace(evidence, quoted, plain)
    return F.when(new != evidence, new)


def parse_generated(reply: Column) -> Column:
    """(question, options, gold) of the first {..} block of a reply: four distinct non-blank options, whole-number answer
    0..3, non-blank question; else null. true is no number."""
    block = F.regexp_extract(F.coalesce(reply, F.lit("")), r"(?s)\{.*\}", 0)
    j = F.from_json(block, "question string, options array<string>, answer string")
    options = F.transform(j["options"], lambda o: F.trim(o))
    ok = (F.size(options) == 4) & (F.size(F.array_distinct(options)) == 4) & ~F.exists(options, lambda o: o.isNull() | (o == "")) & j["answer"].rlike(r"^[0-3]$") & block.rlike(r'"answer"\s*:\s*[0-3]\s*[,}]') & (F.trim(j["question"]) != "")
    return F.when(ok, F.struct(F.trim(j["question"]).alias("question"), options.alias("options"), j["answer"].cast("int").alias("gold")))


def passage_window(body: Column, seed: Column, size: int = 800, least: int = 300) -> Column:
    """`size` words from a hashed start between 15 % of the text and its last full window; null under `least` words."""
    pair = F.struct(text.words(body).alias("w"))

    def window(s: Column) -> Column:
        n = F.size(s["w"])
        low = F.floor(n * 0.15).cast("int")
        high = F.greatest(low, n - size)
        start = F.when(high > low, low + (F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit("window"), seed.cast("string")), 256), 1, 8), 16, 10).cast("bigint") % (high - low + 1)).cast("int")).otherwise(0)
        return F.when(n >= least, F.array_join(F.slice(s["w"], start + 1, F.lit(size)), " "))

    return F.get(F.transform(F.array(pair), window), 0)


def corrupt_argument(calls: DataFrame, id: str, args: str, pool: DataFrame) -> DataFrame:
    """(id, name, old, new): one argument of each call, the first by hash that has another observed value, and the first
    other value by hash. Calls without one are left out. pool: (name, value), distinct.

    Per argument name only the two first values by hash are needed, so nothing is joined with a whole pool.
    """
    h = F.sha2(F.concat_ws("|", F.lit("argument"), "name", "value"), 256)
    two = pool.groupBy("name").agg(F.min(F.struct(h.alias("h"), "value")).alias("a"), F.max(F.struct(h.alias("h"), "value")).alias("z"))
    each = calls.select(id, F.explode(args).alias("name", "old")).join(two, "name")
    new = F.when(F.col("a.value") != F.col("old"), F.col("a.value")).when(F.col("z.value") != F.col("old"), F.col("z.value"))
    order = F.sha2(F.concat_ws("|", F.lit("pick"), F.col(id).cast("string"), "name"), 256)
    some = each.withColumn("new", new).filter("new is not null")
    return some.groupBy(id).agg(F.min(F.struct(order.alias("o"), "name", "old", "new")).alias("m")).select(id, "m.name", "m.old", "m.new")


def audit(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(check, violations) for each condition that all rows must meet; null counts as a violation. One pass."""
    counts = df.agg(*[F.coalesce(F.sum((~F.coalesce(c, F.lit(False))).cast("bigint")), F.lit(0)).alias(n) for n, c in checks.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("violations")) for n in checks])).alias("c")).select("c.*")


def evidence_problem(state: Column, start: Column, end: Column, group: Column) -> Column:
    """Why a request can't serve as evidence, null if it can: the span must select non-blank text inside the state."""
    inside = (start >= 0) & (start < end) & (end <= F.length(state))
    return F.when(state.isNull() | start.isNull() | end.isNull() | ~inside, "bad_span").when(records.blank(F.substr(state, start + 1, end - start)), "blank_evidence").when(records.blank(group), "no_group")


def gather_answers(answers: DataFrame, state: str, qid: str, value: str) -> DataFrame:
    """Answers of one state back into a map of question ids; a repeated id fails."""
    return answers.groupBy(state).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(qid, value)))).alias("answers"))
