"""Ensembles, evidence controls, instruction variants, tool-call arguments and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import scores, text


def prediction_identity(group: Column, keys: Column) -> Column:
    """Hash of a group and its option keys in any order."""
    return F.sha2(F.concat_ws("|", group, F.array_join(F.array_sort(keys), "|")), 256)


def ensemble(preds: DataFrame, members: int, method: str = "mean", strict: bool = False) -> DataFrame:
    """(identity, variant, keys, p, gold_key) of several variants -> one row per identity that all variants have:
    keys in order, mean probabilities, prediction, confidence, correct, agree.

    Probabilities are aligned by option key, so the variants may list options in any order. method "log" averages logs
    (at least 1e-300) and normalises. Ties go to the smaller key. strict fails if some identity lacks a variant. An
    identity twice in one variant, or with several gold keys, fails at run time.
    """
    each = preds.select("identity", "variant", "gold_key", F.explode(F.arrays_zip("keys", "p")).alias("o")).select("identity", "variant", "gold_key", F.col("o.keys").alias("key"), F.col("o.p").alias("p"))
    value = F.avg("p") if method == "mean" else F.exp(F.avg(F.log(F.greatest("p", F.lit(1e-300)))))
    per_key = each.groupBy("identity", "key").agg(value.alias("v"))
    own = preds.select("identity", "variant", "gold_key", F.element_at(scores.ranked(F.col("p"), F.col("keys")), 1)["key"].alias("mine"))
    heads = own.groupBy("identity").agg(
        F.count(F.lit(1)).alias("_n"), F.countDistinct("variant").alias("_v"), F.min("gold_key").alias("gold_key"), F.max("gold_key").alias("_g2"),
        (F.min("mine") == F.max("mine")).alias("agree"),
    )
    bad = F.when(F.col("_n") != F.col("_v"), "repeated identity").when(F.col("gold_key") != F.col("_g2"), "conflicting gold")
    if strict:
        bad = bad.when(F.col("_v") != members, "variant cohorts differ")
    # in the filter itself, so that no row is dropped before it is checked
    heads = heads.filter(F.when(bad.isNotNull(), F.raise_error(bad).cast("boolean")).otherwise(F.col("_v") == members))
    lists = per_key.groupBy("identity").agg(F.array_sort(F.collect_list(F.struct("key", "v"))).alias("_o"))
    out = heads.join(lists, "identity").withColumn("keys", F.transform("_o", lambda o: o["key"])).withColumn("p", F.transform("_o", lambda o: o["v"]))
    if method != "mean":
        out = out.withColumn("p", F.transform("p", lambda x: x / scores.total(F.col("p"))))
    best = F.element_at(scores.ranked(F.col("p"), F.col("keys")), 1)
    return out.withColumn("prediction", best["key"]).withColumn("confidence", best["p"]).withColumn("correct", (F.col("prediction") == F.col("gold_key")).cast("int")).drop("_n", "_v", "_g2", "_o")


def evidence_control(df: DataFrame, state: str, start: str, end: str, replacement: Column, mode: str) -> DataFrame:
    """Records whose evidence span is replaced; the label moves to reference_label and the new span is recorded."""
    out = df.withColumn("_by", replacement).withColumn("controlled", text.replace_span(F.col(state), F.col(start), F.col(end), F.col("_by")))
    return out.withColumn("control_mode", F.lit(mode)).withColumn("span_start", F.col(start)).withColumn("span_end", F.col(start) + F.length("_by")).drop("_by")


def variants(df: DataFrame, id: str, instructions: list[str]) -> DataFrame:
    """Every row with every instruction: qid is id_v0, id_v1, .. The list is a parameter, so its size is known."""
    return df.select("*", F.posexplode(F.array(*[F.lit(i) for i in instructions])).alias("v", "instructions")).withColumn("qid", F.concat(F.col(id).cast("string"), F.lit("_v"), F.col("v")))


def argument_pool(calls: DataFrame, args: str) -> DataFrame:
    """(name, value) of all argument values seen, distinct; args is a map of names to JSON texts."""
    return calls.select(F.explode(args).alias("name", "value")).distinct()


def first_holder(calls: DataFrame, args: str, id: str) -> DataFrame:
    """(name, value, holder): the smallest id whose call has the argument value."""
    return calls.select(F.col(id), F.explode(args).alias("name", "value")).groupBy("name", "value").agg(F.min(id).alias("holder"))


def answer(df: DataFrame, logits: str, keys: str, kind: str, temperature: float = 1.0) -> DataFrame:
    """Formats answers by kind: choice (best key), noul (probability of the first option), score (expected level)."""
    p = F.col("_p")
    out = df.withColumn("_p", scores.softmax(F.col(logits), temperature))
    best = F.element_at(scores.ranked(p, F.col(keys)), 1)
    return out.withColumn("answer", F.when(F.col(kind) == "choice", best["key"]).when(F.col(kind) == "noul", F.round(F.get(p, F.lit(0)), 6).cast("string")).otherwise(F.round(scores.expected_level(p), 6).cast("string"))).withColumn("concentration", scores.concentration(p)).drop("_p")


def letter_mass(df: DataFrame, id: str, pairs: str, k: str) -> DataFrame:
    """(id, [(token, logprob)], k) -> (id, p, coverage): mass of the tokens that are one of the first k letters, summed
    per letter and normalised; uniform where none is."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    each = F.transform(pairs, lambda t: F.struct((F.instr(F.lit(letters), F.upper(F.trim(t["token"]))) * (F.length(F.trim(t["token"])) == 1).cast("int")).alias("i"), F.exp(t["logprob"]).alias("m")))
    mass = F.transform(F.sequence(F.lit(1), F.col(k)), lambda i: F.aggregate(F.filter("_e", lambda e: e["i"] == i), F.lit(0.0), lambda s, e: s + e["m"]))
    out = df.select(id, k, each.alias("_e")).withColumn("_m", mass).withColumn("coverage", scores.total(F.col("_m")))
    p = F.when(F.col("coverage") > 0, F.transform("_m", lambda x: x / F.col("coverage"))).otherwise(F.transform("_m", lambda x: 1.0 / F.col(k)))
    return out.select(id, p.alias("p"), "coverage")


def canonical_order(opts: Column, cap: Column) -> Column:
    """Indices of options (arrays of ids) in order of their first `cap` ids."""
    cut = F.transform(opts, lambda o, i: F.struct(F.slice(o, F.lit(1), cap).alias("o"), i.alias("i")))
    return F.transform(F.array_sort(cut), lambda s: s["i"])


def restore_order(order: Column, values: Column) -> Column:
    """Values given in canonical order, back in the caller's order."""
    pairs = F.transform(F.arrays_zip(order.alias("i"), values.alias("v")), lambda s: F.struct(s["i"], s["v"]))
    return F.transform(F.array_sort(pairs), lambda s: s["v"])
