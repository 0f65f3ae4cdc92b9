"""Evaluation analytics over prediction rows (p array of probabilities, gold index, further columns for grouping).

All are plain aggregates with map-side combination; none collects rows. Empty inputs give one row of nulls and zeros
for ungrouped metrics, no rows for grouped ones. Null p or gold is rejected by validate().
"""

from __future__ import annotations

import hashlib
import math
import statistics

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions import scores
from quillet.session import cut

# Ten equal bins as doubles of i/10 in the order they are compared, including their rounding.
EDGES = [0.0, 0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9, 1.0]


def problems(p: Column, gold: Column) -> Column:
    """Why a row is no prediction, null if it is one."""
    return (
        F.when(p.isNull() | gold.isNull(), "missing")
        .when(F.size(p) < 2, "too_few_options")
        .when(F.exists(p, lambda x: x.isNull() | F.isnan(x) | (x < 0) | (x > 1)), "not_in_unit_interval")
        .when(F.abs(scores.total(p) - 1) > 1e-6, "not_normalised")
        .when((gold < 0) | (gold >= F.size(p)), "gold_out_of_range")
    )


def validate(df: DataFrame, p: str = "p", gold: str = "gold") -> DataFrame:
    """df, failing at run time on the first row that is no prediction."""
    why = problems(F.col(p), F.col(gold))
    return df.withColumn(p, F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("bad prediction: "), why)).cast("array<double>")).otherwise(F.col(p)))


def scored(df: DataFrame) -> DataFrame:
    """Adds pred (first largest), conf, correct, p_gold."""
    pred = scores.argmax_first(F.col("p"))
    return df.withColumn("pred", pred).withColumn("conf", F.array_max("p")).withColumn("correct", (F.col("pred") == F.col("gold")).cast("int")).withColumn("p_gold", F.get("p", F.col("gold")))


def nll() -> Column:
    """Mean -ln p(gold); null if any is zero. log(0) is null, so it is counted and not clipped."""
    zeros = F.sum((F.col("p_gold") <= 0).cast("int"))
    return F.when(zeros == 0, F.avg(-F.log("p_gold")))


def summary(df: DataFrame, *by: str) -> DataFrame:
    """n, accuracy, NLL, number of certain misses, Brier score, mean confidence and mean p(gold), overall or by group."""
    return scored(df).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), nll().alias("nll"),
        F.coalesce(F.sum((F.col("p_gold") <= 0).cast("bigint")), F.lit(0)).alias("zero_gold"),
        F.avg(scores.brier(F.col("p"), F.col("gold"))).alias("brier"), F.avg("conf").alias("mean_conf"), F.avg("p_gold").alias("mean_p_gold"),
    )


def summary_with_total(df: DataFrame, by: str) -> DataFrame:
    """summary per value of `by` and once overall (null), in one pass by grouping sets."""
    s = scored(df).withColumn("_b", scores.brier(F.col("p"), F.col("gold")))
    return s.rollup(by).agg(F.grouping(by).alias("is_total"), F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg("_b").alias("brier"))


def bin_right_closed(conf: Column) -> Column:
    """Bin 0..9, closed on the right, bin 0 on both sides."""
    out = F.lit(9)
    for i in range(8, -1, -1):
        out = F.when(conf <= EDGES[i + 1], i).otherwise(out)
    return out


def bin_left_closed(conf: Column) -> Column:
    return F.least(F.lit(9), F.floor(conf * 10).cast("int"))


def reliability(df: DataFrame, how: str = "right") -> DataFrame:
    """Per bin that has rows: n, mean confidence, accuracy. how: right or left closed, or count for ten bins of equal
    size (ties in confidence in order of `item_id`)."""
    s = scored(df)
    if how == "count":
        s = _equal_count(s)
    else:
        s = s.withColumn("bin", bin_right_closed(F.col("conf")) if how == "right" else bin_left_closed(F.col("conf")))
    return s.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("conf"), F.avg("correct").alias("accuracy"))


BUCKETS = 4096  # of confidence, for running sums in two levels


def running(per: DataFrame, values: list[str], descending: bool = False) -> DataFrame:
    """(conf, values..) with distinct conf -> the same with running sums <value>_run in order of conf.

    In two levels, so that no task gets all rows: sums per bucket of conf (at most BUCKETS + 1 rows, summed up in one
    window and broadcast), then a window inside each bucket.
    """
    at = F.floor(F.col("conf") * BUCKETS)
    order = F.desc if descending else F.asc
    per = per.withColumn("_b", at)
    sums = per.groupBy("_b").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    ahead = Window.orderBy(order("_b")).rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_b", *[F.coalesce(F.sum(f"_{v}").over(ahead), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy("_b").orderBy(order("conf")).rowsBetween(Window.unboundedPreceding, 0)
    out = per.join(F.broadcast(before), "_b")
    return out.select("conf", *values, *[(F.col(f"_{v}") + F.sum(v).over(inside)).alias(f"{v}_run") for v in values])


def in_order(df: DataFrame, *order: Column, values: tuple[str, ...] = ()) -> DataFrame:
    """Adds place (1, 2, ..) by `order`, which should be total, and the running sums <value>_run.

    Rows are dealt to range partitions of the whole order, so equal leading values are spread too; then only one row per
    partition is summed up in one task and broadcast, and each partition is ordered on its own.
    """
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), *[F.sum(v).alias(f"_{v}") for v in values])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("_part", *[F.coalesce(F.sum(c).over(ahead), F.lit(0)).alias(c) for c in ("_n", *[f"_{v}" for v in values])])
    w = Window.partitionBy("_part").orderBy(*order)
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.join(F.broadcast(before), "_part").withColumn("place", F.col("_n") + F.row_number().over(w))
    return placed.withColumns({f"{v}_run": F.col(f"_{v}") + F.sum(v).over(run) for v in values}).drop("_part", "_n", *[f"_{v}" for v in values])


def _equal_count(s: DataFrame, bins: int = 10) -> DataFrame:
    """ntile(bins) by (conf, item_id): the first n mod bins bins are one larger."""
    n = s.agg(F.count(F.lit(1)).alias("total"))
    joined = in_order(s, F.asc("conf"), F.asc("item_id")).crossJoin(F.broadcast(n))
    at = F.col("place") - 1
    small, extra = F.floor(F.col("total") / bins), F.col("total") % bins
    big = extra * (small + 1)
    return joined.withColumn("bin", F.when(at < big, F.floor(at / (small + 1))).otherwise(extra + F.floor((at - big) / F.greatest(small, F.lit(1)))).cast("int")).drop("place", "total")


def ece(df: DataFrame, how: str = "right") -> DataFrame:
    """Expected calibration error over ten bins: one row (ece)."""
    bins = reliability(df, how)
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("conf") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def class_report(df: DataFrame, labels: int) -> DataFrame:
    """Per label 0..labels-1: support, predicted, hits, recall, F1 (0 where label and prediction are absent)."""
    s = scored(df)
    rows = s.select(F.explode(F.array(F.struct(F.col("gold").alias("label"), F.lit(1).alias("g"), F.lit(0).alias("q"), F.col("correct").alias("h")), F.struct(F.col("pred").alias("label"), F.lit(0).alias("g"), F.lit(1).alias("q"), F.lit(0).alias("h")))).alias("e")).select("e.*")
    got = rows.groupBy("label").agg(F.sum("g").alias("support"), F.sum("q").alias("predicted"), F.sum("h").alias("hits"))
    every = df.sparkSession.range(labels).select(F.col("id").cast("int").alias("label"))
    full = every.join(got, "label", "left").na.fill(0, ["support", "predicted", "hits"])
    return full.withColumn("recall", F.try_divide("hits", "support")).withColumn("f1", F.coalesce(F.try_divide(2 * F.col("hits"), F.col("support") + F.col("predicted")), F.lit(0.0)))


def class_summary(df: DataFrame, labels: int) -> DataFrame:
    """Majority baseline, balanced accuracy (labels with support) and macro-F1 (all labels)."""
    r = class_report(df, labels)
    return r.agg((F.max("support") / F.sum("support")).alias("majority"), F.avg("recall").alias("balanced_accuracy"), F.avg("f1").alias("macro_f1"))


def confusion(df: DataFrame, labels: int) -> DataFrame:
    """One row per gold label with a column p0, p1, .. per predicted label; only labels with gold rows have one."""
    s = scored(df)
    return s.groupBy("gold").agg(*[F.sum((F.col("pred") == i).cast("bigint")).alias(f"p{i}") for i in range(labels)])


def ordinal_error(df: DataFrame) -> DataFrame:
    """Mean distance of the expected and of the predicted level to the gold level."""
    s = scored(df)
    return s.agg(F.avg(F.abs(scores.expected_level(F.col("p")) - F.col("gold"))).alias("expected_mae"), F.avg(F.abs(F.col("pred") - F.col("gold"))).alias("argmax_mae"))


def acceptance(df: DataFrame, budget: float = 0.05, least: int = 1) -> DataFrame:
    """Largest set of most confident rows, never cutting through equal confidences, whose error rate is within budget:
    threshold (null: accept none), n, accepted, errors, coverage, risk.

    Rows are summed per confidence first; running sums are taken in two levels (see running).
    """
    per = scored(df).groupBy("conf").agg(F.count(F.lit(1)).alias("c"), F.sum(1 - F.col("correct")).alias("e"))
    run = running(per, ["c", "e"], descending=True).select("conf", F.col("c_run").alias("k"), F.col("e_run").alias("bad"))
    good = (F.col("k") >= least) & (F.col("bad") <= F.lit(budget) * F.col("k") + 1e-12)
    best = run.agg(F.max("k").alias("n"), F.max(F.when(good, F.struct("k", "conf", "bad"))).alias("b"))
    k, bad = F.coalesce("b.k", F.lit(0)), F.coalesce("b.bad", F.lit(0))
    return best.select(F.col("b.conf").alias("threshold"), F.coalesce("n", F.lit(0)).alias("n"), k.alias("accepted"), bad.alias("errors"), F.try_divide(k, F.col("n")).alias("coverage"), F.try_divide(bad, k).alias("risk"))


def automation_rate(df: DataFrame, budget: float = 0.05) -> DataFrame:
    """The former rule, which may cut through equal confidences: rows by confidence, ties by `item_id`; the share of the
    longest beginning whose error rate is within budget (0 if none): one row (n, accepted, rate)."""
    rows = in_order(scored(df).withColumn("e", 1 - F.col("correct")).select("conf", "item_id", "e"), F.desc("conf"), F.asc("item_id"), values=("e",))
    good = F.max(F.when(F.col("e_run") <= F.lit(budget) * F.col("place") + 1e-12, F.col("place")))
    return rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(good, F.lit(0)).cast("bigint").alias("accepted")).withColumn("rate", F.coalesce(F.try_divide("accepted", "n"), F.lit(0.0)))


def order_report(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """Predictions (key, p, gold) on options in their order and permuted, both as indexes of the first order: n, accuracy in
    either, and the share of rows whose selection differs."""
    a = scored(first).select(key, F.col("pred").alias("_a"), F.col("correct").alias("_ca"))
    b = scored(second).select(key, F.col("pred").alias("_b"), F.col("correct").alias("_cb"))
    return a.join(b, key).agg(F.count(F.lit(1)).alias("n"), F.avg("_ca").alias("acc_order_a"), F.avg("_cb").alias("acc_order_b"), F.avg((F.col("_a") != F.col("_b")).cast("int")).alias("flip_rate"))


def pair_report(pairs: DataFrame) -> DataFrame:
    """Pairs of a right and a wrong continuation, scored by three readouts (loss_ok, loss_bad: lower is better; span_ok,
    span_bad; p_ok_first, p_ok_second: probability of the right one in either order) and their ids (ok, bad): wins and
    mean lead of each readout (the third averaged over both orders), accuracy in either order, and in how many pairs the
    first ids differ. Equal scores win nothing."""
    p = (F.col("p_ok_first") + F.col("p_ok_second")) / 2
    one = lambda c: F.sum(c.cast("bigint"))
    return pairs.agg(
        F.count(F.lit(1)).alias("n"), one(F.col("loss_ok") < F.col("loss_bad")).alias("loss_wins"), F.avg(F.col("loss_bad") - F.col("loss_ok")).alias("loss_lead"),
        one(F.col("span_ok") > F.col("span_bad")).alias("span_wins"), F.avg(F.col("span_ok") - F.col("span_bad")).alias("span_lead"),
        one(p > 0.5).alias("option_wins"), F.avg(2 * p - 1).alias("option_lead"), F.avg((F.col("p_ok_first") > 0.5).cast("int")).alias("acc_order_a"), F.avg((F.col("p_ok_second") > 0.5).cast("int")).alias("acc_order_b"),
        one(~F.get("ok", 0).eqNullSafe(F.get("bad", 0))).alias("first_differs"),
    )


def harness_rows(answers: DataFrame) -> DataFrame:
    """Answers of an outside engine (qid, kind, gold_key, probabilities map, noul, error) -> prediction, conf, correct, p_gold:
    the likeliest key (ties: the smaller one), for noul true from 0.5 on; an answer with an error is wrong, with confidence
    and probability 0."""
    fine = F.col("error").isNull()
    probs = F.when(F.col("kind") == "noul", F.create_map(F.lit("true"), F.col("noul"), F.lit("false"), 1 - F.col("noul"))).otherwise(F.col("probabilities"))
    rows = answers.withColumn("_p", F.when(fine, probs))
    best = F.array_min(F.transform(F.map_entries("_p"), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("k"))))
    pred = F.when(F.col("kind") == "noul", F.when(F.col("noul") >= 0.5, "true").otherwise("false")).otherwise(best["k"])
    rows = rows.withColumns({"prediction": F.when(fine, pred), "conf": F.coalesce(-best["n"], F.lit(0.0)), "p_gold": F.coalesce(F.try_element_at("_p", F.col("gold_key")), F.lit(0.0))})
    return rows.withColumn("correct", F.coalesce(F.col("prediction") == F.col("gold_key"), F.lit(False)).cast("int")).drop("_p")


def harness_report(answers: DataFrame) -> DataFrame:
    """n, accuracy, NLL (probabilities of at least 1e-12), squared distance of confidence and correctness, and the calibration
    error over ten bins of equal size (ties by qid)."""
    rows = cut(harness_rows(answers).select(F.col("qid").alias("item_id"), "conf", "correct", "p_gold"))
    bins = _equal_count(rows).groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("c"), F.avg("correct").alias("a"))
    ece_ = bins.agg((F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).alias("ece"))
    one = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("correct").alias("accuracy"), F.avg(-F.log(F.greatest("p_gold", F.lit(1e-12)))).alias("nll"), F.avg(F.pow(F.col("conf") - F.col("correct"), F.lit(2))).alias("brier"))
    return one.crossJoin(F.broadcast(ece_))


def wilson(errors: Column, n: Column, level: float = 0.95) -> tuple[Column, Column]:
    """Wilson interval of a rate, its ends set to 0 and 1 exactly where there are no or only errors."""
    z = statistics.NormalDist().inv_cdf(0.5 + level / 2)
    r = errors / n
    mid, half = r + z * z / (2 * n), z * F.sqrt(r * (1 - r) / n + z * z / (4 * n * n))
    low = F.when(errors == 0, 0.0).otherwise(F.greatest((mid - half) / (1 + z * z / n), F.lit(0.0)))
    high = F.when(errors == n, 1.0).otherwise(F.least((mid + half) / (1 + z * z / n), F.lit(1.0)))
    return low, high


def apply_acceptance(df: DataFrame, threshold: Column) -> DataFrame:
    """How a threshold does on other rows: n, accepted, errors, coverage, risk and its 95 % interval (null: none accepted)."""
    take = F.col("conf") >= threshold
    s = scored(df).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(take.cast("bigint")), F.lit(0)).alias("accepted"), F.coalesce(F.sum((take & (F.col("correct") == 0)).cast("bigint")), F.lit(0)).alias("errors"))
    low, high = wilson(F.col("errors"), F.col("accepted"))
    some = F.col("accepted") > 0
    return s.select("n", "accepted", "errors", F.try_divide("accepted", "n").alias("coverage"), F.try_divide("errors", "accepted").alias("risk"), F.when(some, low).alias("risk_low"), F.when(some, high).alias("risk_high"))


def quantiles(df: DataFrame, column: str, at=(0.0, 0.25, 0.5, 0.75, 1.0)) -> DataFrame:
    """Exact quantiles with linear interpolation, one row per quantile. Grouped per value first, so memory grows with
    the number of distinct values, not rows."""
    per = df.groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    q = F.percentile("v", F.array(*[F.lit(float(x)) for x in at]), F.col("c"))
    return per.agg(q.alias("q")).select(F.posexplode("q").alias("i", "value")).select(F.element_at(F.array(*[F.lit(float(x)) for x in at]), F.col("i") + 1).alias("q"), "value")


# The temperatures that are tried first.
TEMPERATURES = [0.2 + i * 4.8 / 96 for i in range(97)] + [5.5 + i * 14.5 / 29 for i in range(30)]


def temperature(df: DataFrame, digits: int = 6) -> float:
    """Temperature that minimises the NLL of (logits, gold): the best of TEMPERATURES, then ever finer grids.

    Every pass is one aggregate over the rows, which tries all its temperatures at once, and only their sums reach the driver;
    each grid spans the two neighbours of the best so far in logarithms, 31 points apart evenly, so the interval
    shrinks 15-fold per pass. The NLL has one minimum in the logarithm.
    """
    data = df.select("logits", "gold").persist()

    def losses(ts: list[float]) -> list[float]:
        at = lambda t: scores.log_sum_exp(F.transform("logits", lambda x: x / t)) - F.get("logits", F.col("gold")) / t
        each = data.withColumn("t", F.explode(F.array(*[F.lit(t) for t in ts])))
        sums = {r["t"]: r["s"] for r in each.groupBy("t").agg(F.sum(at(F.col("t"))).alias("s")).collect()}
        return [sums.get(t, 0.0) for t in ts]

    try:
        grid = TEMPERATURES
        while True:
            found = losses(grid)
            k = min(range(len(grid)), key=found.__getitem__)
            low, high = math.log(grid[max(k - 1, 0)]), math.log(grid[min(k + 1, len(grid) - 1)])
            if k == 0:
                low = high - math.log(4)
            elif k == len(grid) - 1 and grid is TEMPERATURES:
                high = low + math.log(4)
            if high - low < 10.0**-digits:
                return grid[k]
            grid = [math.exp(low + (high - low) * i / 30) for i in range(31)]
    finally:
        data.unpersist()


def paired_bootstrap(df: DataFrame, samples: int = 2000, seed: int = 7331) -> DataFrame:
    """(unit, delta): mean delta, improved, regressed and the 95 % interval of the mean under resampling of units.

    Each of `samples` replicates draws a Poisson(1) number of copies of every unit, the distributed form of drawing units
    with replacement. Units are summed first; each Arrow batch of them gives one row per replicate of weighted sums from a
    generator that is seeded by the batch's first unit and `seed`, so rows don't multiply by replicates, and only sums are
    shuffled. Which draws a unit gets depends on the batch it is in, so the interval's ends vary a little with partitioning.
    """
    units = df.groupBy(F.col("unit").cast("string").alias("unit")).agg(F.sum("delta").alias("s"), F.count(F.lit(1)).alias("c"))

    def run(frames):
        total = np.zeros((2, samples))
        for f in frames:
            first = int.from_bytes(hashlib.sha256(f"{seed}|{f['unit'].iloc[0]}".encode()).digest()[:8])
            draw = np.random.default_rng(first)
            pair = np.stack([f["s"].to_numpy(float), f["c"].to_numpy(float)])
            for k in range(0, len(f), 1000):
                total += pair[:, k : k + 1000] @ draw.poisson(1.0, (len(f.iloc[k : k + 1000]), samples))
        yield pd.DataFrame({"rep": np.arange(samples), "s": total[0], "c": total[1]})

    reps = units.mapInPandas(run, "rep int, s double, c double").groupBy("rep").agg(F.try_divide(F.sum("s"), F.sum("c")).alias("m"))
    ends = reps.agg(F.percentile("m", F.array(F.lit(0.025), F.lit(0.975))).alias("q")).select(F.get("q", 0).alias("low"), F.get("q", 1).alias("high"))
    overall = df.agg(F.avg("delta").alias("delta"), F.sum((F.col("delta") > 0).cast("bigint")).alias("improved"), F.sum((F.col("delta") < 0).cast("bigint")).alias("regressed"))
    return overall.crossJoin(F.broadcast(ends))
