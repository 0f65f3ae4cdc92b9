"""Record operators: validation with exclusions, duplicates, conflicts, owners, splits, caps and samples.

Choices that a sequential program would draw from a random generator are keyed by a hash of seed and row, so results
don't depend on row order or partitioning. Exclusions are rows with a `reason`; kept and excluded rows add up to the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions import text


def route(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    """Adds reason: the first whose condition holds (null conditions don't), null for rows to keep."""
    out = None
    for name, bad in reasons:
        bad = F.coalesce(bad, F.lit(False))
        out = F.when(bad, name) if out is None else out.when(bad, name)
    return df.withColumn("reason", out if out is not None else F.lit(None).cast("string"))


def blank(c: Column) -> Column:
    """Null, empty or white space only."""
    return c.isNull() | (F.length(text.collapse_space(c)) == 0)


def qa_schema(df: DataFrame) -> DataFrame:
    """Question-answer records with blank passage, q or a are excluded; the others are trimmed."""
    bad = blank(F.col("passage")) | blank(F.col("q")) | blank(F.col("a"))
    trim = {c: F.regexp_replace(c, f"^{text.SPACE}|{text.SPACE}$", "") for c in ("passage", "q", "a")}
    return route(df, [("invalid_qa_schema", bad)]).withColumns(trim)


def grounded(q: Column, a: Column, passage: Column, share: float = 0.5) -> Column:
    """Whether an answer is lexically supported: lengths in bounds, at least `share` of its content words (by
    occurrence; none is fine) in the passage, and all its numbers among the passage's, by value."""
    # the lambda's variable holds both word lists, so each is made once per row
    pair = F.struct(text.content_words(a).alias("aw"), F.array_distinct(text.content_words(passage)).alias("pw"))
    enough = F.get(F.transform(F.array(pair), lambda s: F.size(F.filter(s["aw"], lambda w: F.array_contains(s["pw"], w))) >= share * F.size(s["aw"])), 0)
    bound = F.size(F.array_except(text.numbers(a), text.numbers(passage))) == 0
    return ~blank(q) & ~blank(a) & ~blank(passage) & (F.length(q) <= 400) & F.length(a).between(8, 512) & enough & bound


def choice_reasons() -> list[tuple[str, Column]]:
    """Exclusions of multiple-choice items: four non-blank options, distinct once normalised, gold 0..3, single choice."""
    o = F.col("options")
    schema = blank(F.col("question")) | o.isNull() | (F.size(o) != 4) | F.exists(o, lambda x: blank(x)) | F.col("gold").isNull() | ~F.col("gold").between(0, 3) | (F.coalesce("choice_type", F.lit("single")) != "single")
    same = F.size(F.array_distinct(F.transform(o, text.collapse_space))) < 4
    return [("invalid_schema", schema), ("invalid_options", same)]


def decision_problem(ctx: Column, opts: Column, gold: Column) -> Column:
    """Why an encoded decision is invalid, null if it is valid."""
    return (
        F.when(ctx.isNull() | (F.size(ctx) == 0), "empty_context")
        .when(opts.isNull() | (F.size(opts) < 2), "too_few_options")
        .when(F.exists(opts, lambda o: o.isNull() | (F.size(o) == 0)), "empty_option")
        .when(F.size(F.array_distinct(opts)) < F.size(opts), "repeated_option")
        .when(gold.isNull() | (gold < 0) | (gold >= F.size(opts)), "gold_out_of_range")
    )


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Adds retained (smallest `order` of the key), copies, and reason duplicate_record for all rows but the first.

    Aggregated before the join, so a key with a third of all rows sends one row per task through the shuffle; AQE
    splits the join where a key is hot. Null keys are a value of their own.
    """
    firsts = df.groupBy(*key).agg(F.min(order).alias("retained"), F.count(F.lit(1)).alias("copies"))
    names = [f"_{k}" for k in key]
    firsts = firsts.toDF(*names, "retained", "copies")
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(key, names)]
    return df.join(firsts, on).drop(*names).withColumn("reason", F.when(F.col(order) != F.col("retained"), "duplicate_record"))


def conflicts(df: DataFrame, key: str, value: str) -> DataFrame:
    """Keys with more than one distinct non-null value: (key, values). min and max tell it without collecting sets."""
    return df.groupBy(key).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"), F.countDistinct(value).alias("values")).filter("_lo <> _hi").drop("_lo", "_hi")


def owners(df: DataFrame, group: str, role: str, order: list[str]) -> DataFrame:
    """The role that owns each group: the first of `order` that any row of the group has: (group, owner)."""
    rank = F.coalesce(*[F.when(F.col(role) == r, i) for i, r in enumerate(order)], F.lit(len(order)))
    best = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.min(rank).alias("_r"))
    return best.filter(F.col("_r") < len(order)).select(group, F.element_at(F.array(*[F.lit(r) for r in order]), F.col("_r") + 1).alias("owner"))


def hash_order(seed: str, *cols: str) -> Column:
    """SHA-256 of seed and columns as text: an order that is random and reproducible in any engine."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *[F.col(c).cast("string") for c in cols]), 256)


def bucket(seed: str, col: str, n: int) -> Column:
    """0..n-1 from the first 32 bits of the hash."""
    return F.conv(F.substring(hash_order(seed, col), 1, 8), 16, 10).cast("bigint") % n


def partition_groups(df: DataFrame, group: str, fractions: list[tuple[str, float]], seed: str) -> DataFrame:
    """Whole groups to splits: floor(groups x fraction) groups each, in hash order, in the order given; groups left over
    are unassigned_group. (group, split).

    Global ranks in two levels: groups are counted per hash prefix (4,096 rows at most), ranked inside a prefix.
    """
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct().withColumn("_h", hash_order(seed, group))
    groups = groups.withColumn("_p", F.substring("_h", 1, 3))
    counts = groups.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_p", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_total"))
    at = F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h")) - 1
    ranked = groups.join(F.broadcast(before), "_p").withColumn("_at", at)
    out, low = F.lit("unassigned_group"), F.lit(0)
    picks = []
    for name, share in fractions:
        high = low + F.floor(F.col("_total") * share)
        picks.append((name, low, high))
        low = high
    for name, a, b in reversed(picks):
        out = F.when((F.col("_at") >= a) & (F.col("_at") < b), name).otherwise(out)
    return ranked.select(group, out.alias("split"))


def group_subset(df: DataFrame, group: str, limit: int, seed: str) -> DataFrame:
    """Whole groups in hash order until at least `limit` rows are taken: (group, size).

    Sizes are summed per hash prefix first; only prefixes' sums are ordered in one task.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("_h", hash_order(seed, group)).withColumn("_p", F.substring("_h", 1, 3))
    sums = sizes.groupBy("_p").agg(F.sum("size").alias("_s"))
    ahead = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_p", F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_p").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    taken = F.col("_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    return sizes.join(F.broadcast(before), "_p").withColumn("_t", taken).filter(F.col("_t") < limit).select(group, "size")


def cap_per(df: DataFrame, key: list[str], limit: int, seed: str, order: str) -> DataFrame:
    """At most `limit` rows per key, by hash; the rest get reason per_key_limit. The window is salted in two levels for
    hot keys: only the best `limit` of each salt compete."""
    h = hash_order(seed, order)
    first = Window.partitionBy(*key, "_salt").orderBy("_h", order)
    second = Window.partitionBy(*key).orderBy("_h", order)
    a = df.withColumn("_h", h).withColumn("_salt", F.pmod(F.xxhash64(order), F.lit(64))).withColumn("_r", F.row_number().over(first))
    lost = a.filter(F.col("_r") > limit).withColumn("reason", F.lit("per_key_limit"))
    kept = a.filter(F.col("_r") <= limit).withColumn("reason", F.when(F.row_number().over(second) > limit, "per_key_limit"))
    return kept.unionByName(lost).drop("_h", "_salt", "_r")


def fraction(df: DataFrame, share: float, seed: str, order: str) -> DataFrame:
    """max(1, round half to even(n x share)) rows, the first in hash order, by the k-th hash found in two levels."""
    n = df.count()
    k = max(1, round(n * share)) if n else 0
    h = df.withColumn("_h", hash_order(seed, order)).withColumn("_p", F.substring("_h", 1, 4))
    counts = sorted((r["_p"], r["count"]) for r in h.groupBy("_p").count().collect())  # at most 65,536 rows
    run, cut = 0, None
    for p, c in counts:
        if run + c >= k:
            cut = p
            break
        run += c
    if cut is None:
        return df
    w = Window.partitionBy("_p").orderBy("_h", order)
    edge = h.filter(F.col("_p") == cut).withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= k - run).drop("_r")
    return h.filter(F.col("_p") < cut).unionByName(edge).drop("_h", "_p")


def repeat_rows(df: DataFrame, times: Column) -> DataFrame:
    """Each row `times` times (none for less than one), with its number `copy`."""
    return df.filter(times > 0).withColumn("copy", F.explode(F.sequence(F.lit(1), times)))


def identities(df: DataFrame, columns: list[str], local: list[str], source: str = "source") -> DataFrame:
    """One row per declared id: (namespace, value hash). Ids in `local` are unique only within their source, so their
    hash includes it. Null and blank ids are none."""
    def one(c: str) -> Column:
        value = F.concat_ws("|", F.lit(c), F.coalesce(source, F.lit("")), F.col(c).cast("string")) if c in local else F.concat_ws("|", F.lit(c), F.col(c).cast("string"))
        return F.when(~blank(F.col(c).cast("string")), F.struct(F.lit(c).alias("namespace"), F.sha2(value, 256).alias("hash")))

    return df.select("*", F.explode(F.filter(F.array(*[one(c) for c in columns]), lambda s: s.isNotNull())).alias("_i")).select("*", "_i.namespace", "_i.hash").drop("_i")


def role_overlap(ids: DataFrame, role: str) -> DataFrame:
    """Hashes that more than one role holds: (namespace, hash, roles). Empty means disjoint."""
    got = ids.groupBy("namespace", "hash").agg(F.min(role).alias("_lo"), F.max(role).alias("_hi"), F.array_sort(F.collect_set(role)).alias("roles"))
    return got.filter("_lo <> _hi").select("namespace", "hash", F.array_join("roles", ",").alias("roles"))


def input_identity(question: Column, options: Column) -> Column:
    """Hash of a question and its options in any order."""
    return F.sha2(F.concat_ws("|", question, F.array_join(F.array_sort(options), "|")), 256)
