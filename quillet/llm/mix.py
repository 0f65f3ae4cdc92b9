"""Problem 2: mixing sources to target weights.

A classifier fitted on labelled records gives every record without a source a posterior over the sources, its soft
membership; a record that names its source is a certain member of it. Projected-gradient least squares then fits a rate
of use per record, between 0 and the record's cap, such that the expected tokens of each source match its target. Rates
become whole uses by a hash that is calibrated per source, so that the shares hold in fact and not only on average.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.session import cut

SAMPLE = 20_000  # labelled records that the classifier is fitted on, at most; chosen by hash
BUCKETS = 4096  # hashed words of the classifier
BINS = 1024  # per source, for calibrating the hash; two levels


def text_words(question: Column, options: Column) -> Column:
    """Words of question and options, lower case."""
    t = F.concat_ws(" ", question, F.array_join(options, " "))
    return F.filter(F.split(F.lower(t), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def fit_classifier(sample: pd.DataFrame, domains: list[str], steps: int = 60, rate: float = 2.0, penalty: float = 1e-4) -> np.ndarray:
    """Multinomial logistic regression on hashed words (features `x`: arrays of buckets, labels `source`)."""
    w = np.zeros((BUCKETS + 1, len(domains)))
    if not len(sample):
        return w
    rows = np.repeat(np.arange(len(sample)), [len(x) for x in sample["x"]])
    cols = np.concatenate([np.asarray(x, np.int64) for x in sample["x"]]) if len(rows) else np.zeros(0, np.int64)
    norm = 1.0 / np.sqrt(np.maximum(1, np.bincount(rows, minlength=len(sample))))
    y = np.zeros((len(sample), len(domains)))
    y[np.arange(len(sample)), [domains.index(s) for s in sample["source"]]] = 1
    for _ in range(steps):
        z = _scores(rows, cols, norm, w, len(sample))
        g = (_softmax(z) - y) / len(sample)
        grad = np.vstack([np.stack([np.bincount(cols, weights=(g[:, k] * norm)[rows], minlength=BUCKETS) for k in range(len(domains))], 1), g.sum(0)])
        w -= rate * len(domains) * (grad + penalty * w)
    return w


def _scores(rows, cols, norm, w, n):
    out = np.stack([np.bincount(rows, weights=w[cols, k], minlength=n) for k in range(w.shape[1])], 1)
    return out * norm[:, None] + w[-1]


def _softmax(z):
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def posteriors(records: DataFrame, domains: list[str], w: np.ndarray) -> DataFrame:
    """Adds p: posterior of each domain, rounded to 1/64 (so that equal memberships can be summed up). Needs x."""
    shared = records.sparkSession.sparkContext.broadcast(w)

    @F.pandas_udf("array<double>")
    def predict(x: pd.Series) -> pd.Series:
        sizes = [len(v) for v in x]
        rows = np.repeat(np.arange(len(x)), sizes)
        cols = np.concatenate([np.asarray(v, np.int64) for v in x]) if len(rows) else np.zeros(0, np.int64)
        norm = 1.0 / np.sqrt(np.maximum(1, np.array(sizes, float)))
        return pd.Series(list(np.round(_softmax(_scores(rows, cols, norm, shared.value, len(x))) * 64) / 64))

    return records.withColumn("p", predict("x"))


def memberships(records: DataFrame, targets: list[str]) -> tuple[DataFrame, list[str]]:
    """(id, source, question, options) -> (id, source, n, m): n tokens, m membership of each target domain.

    A named source is certain (an unlisted one is a member of none). A null source takes the classifier's posterior,
    whatever it is; the posterior of unlisted sources is left out. Without labelled records nulls are members of none.
    """
    words = text_words(F.col("question"), F.col("options"))
    base = records.select("id", "source", F.size(words).alias("n"), F.transform(words, lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS))).alias("x"))
    known = base.filter("source is not null")
    total = known.count()
    share = min(1.0, 0.9 * SAMPLE / max(total, 1))
    picked = known.filter(F.pmod(F.xxhash64(F.lit("mix"), "id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = picked.select("source", "x").limit(SAMPLE).toPandas()
    domains = sorted(set(sample["source"])) if len(sample) else []
    sure = known.select("id", "source", "n", F.array(*[(F.col("source") == t).cast("double") for t in targets]).alias("m"))
    loose = base.filter("source is null")
    if not domains:
        soft = loose.select("id", "source", "n", F.array(*[F.lit(0.0)] * len(targets)).alias("m"))
    else:
        soft = posteriors(loose, domains, fit_classifier(sample, domains))
        of = [F.get("p", domains.index(t)) if t in domains else F.lit(0.0) for t in targets]
        soft = soft.select("id", "source", "n", F.array(*of).alias("m"))
    return sure.unionByName(soft), domains


TRIALS = (1.0, 0.5, 0.25, 0.1, 0.02, 0.002)  # lengths of a step, tried in one pass
#: A step: what was missing per domain when it was made, and by how much rates grow per membership.
Step = tuple[list[float], list[float]]


def _dot(m: Column, v) -> Column:
    return sum((F.get(m, i) * x for i, x in enumerate(v)), F.lit(0.0))


def _free(r: Column, m: Column, cap: Column, gap) -> Column:
    """Whether a rate may move: not at a bound that the gradient points beyond."""
    pull = _dot(m, gap)
    return ~(((r <= 0) & (pull <= 0)) | ((r >= cap) & (pull >= 0)))


def rate(m: Column, cap: Column, steps: list[Step]) -> Column:
    """The rate after some steps, each projected on [0, cap]: told from membership and cap alone, so no rate is stored."""
    start = F.lit(0.0)
    if not steps:
        return start
    k = len(steps[0][0])
    table = F.array(*[F.struct(F.array(*[F.lit(float(x)) for x in g]).alias("g"), F.array(*[F.lit(float(x)) for x in v]).alias("v")) for g, v in steps])
    cap = cap.cast("double")

    def move(r: Column, s: Column) -> Column:
        v, g = [F.get(s["v"], i) for i in range(k)], [F.get(s["g"], i) for i in range(k)]
        return F.when(_free(r, m, cap, g), F.least(F.greatest(r + _dot(m, v), F.lit(0.0)), cap)).otherwise(r)

    return F.aggregate(table, start, move)


def expected(groups: DataFrame, *ways: list[Step]) -> np.ndarray:
    """Expected tokens per domain after each of several lists of steps, in one aggregate: (ways, domains)."""
    k = len(ways[0][0][0])
    tagged = groups.select("m", "n", *[rate(F.col("m"), F.col("cap"), w).alias(f"r{j}") for j, w in enumerate(ways)])
    row = tagged.agg(*[F.sum(F.col("n") * F.get("m", i) * F.col(f"r{j}")) for j in range(len(ways)) for i in range(k)]).first()
    return np.array([x or 0.0 for x in row], float).reshape(len(ways), k)


def fit_rates(groups: DataFrame, goal: list[float], most: int = 60, tolerance: float = 1e-9) -> list[Step]:
    """Least squares by projected gradient: (m, cap, n) with n tokens that share membership m and cap -> steps (see rate).

    The gradient of a rate is its membership times what the domains lack. Steps are scaled by the second moments of the
    memberships that are free to move (two-metric projection), so overlapping memberships don't slow them down, and the
    longest of TRIALS that lowers the squared loss is taken. It ends when the gap is below tolerance x total, or no
    trial helps, which is the optimum where the targets can't be met. Two aggregates of at most domains^2 numbers a step.
    """
    k = len(goal)
    if not k:
        return []
    wanted = np.array(goal, float)
    scale = max(wanted.sum(), 1.0)
    steps: list[Step] = []
    gap, loss = wanted, float((wanted**2).sum())
    for _ in range(most):
        if np.abs(gap).max() <= tolerance * scale:
            break
        moving = groups.withColumn("r", rate(F.col("m"), F.col("cap"), steps)).filter(_free(F.col("r"), F.col("m"), F.col("cap"), [float(x) for x in gap]))
        row = moving.agg(*[F.sum(F.col("n") * F.get("m", i) * F.get("m", j)) for i in range(k) for j in range(i + 1)]).first()
        second = np.zeros((k, k))
        second[np.tril_indices(k)] = [x or 0.0 for x in row]
        second = second + np.tril(second, -1).T
        ridge = 1e-12 * max(second.trace(), 1e-300)
        way = np.linalg.lstsq(second + ridge * np.eye(k), gap, rcond=1e-13)[0]
        tried = [[*steps, (gap.tolist(), (t * way).tolist())] for t in TRIALS]
        gaps = wanted - expected(groups, *tried)
        losses = (gaps**2).sum(1)
        best = int(np.argmin(losses))
        if not losses[best] < loss * (1 - 1e-12):
            break
        steps, gap, loss = tried[best], gaps[best], float(losses[best])
    return steps


def mixture(records: DataFrame, targets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, source, question, options), (source, target_share, max_repeats) -> chosen (id, source, uses) and shares.

    The total is the largest at which every listed source that the data hold reaches its share of it within its cap, by
    the records that name it; the shares of listed but absent sources are spread over the others in proportion
    (reachable_share). shares has one row per listed source, also absent ones: actual_share counts the records that name
    the source, expected_share also those without a source by their membership; those are used once at most. Unlisted
    sources are not used. Sizes are words of question and options; null texts and null options have none. Repeated ids are
    records of their own. Empty tables give no records and shares of zero. Further columns of the input are left out.
    targets must name each source once and is as small as a list of sources; it is collected.
    """
    goals = targets.orderBy("source").collect()
    names = [r["source"] for r in goals]
    cap = F.lit(0)
    for r in goals:
        cap = F.when(F.col("source") == r["source"], r["max_repeats"]).otherwise(cap)
    cap = F.when(F.col("source").isNull(), F.when(F.aggregate("m", F.lit(0.0), lambda a, b: a + b) > 0, 1).otherwise(0)).otherwise(cap)
    member, _ = memberships(records, names)
    member = cut(member.withColumn("cap", cap))
    groups = cut(member.filter("cap > 0").groupBy("m", "cap", F.col("source").isNotNull().alias("named")).agg(F.sum("n").alias("n")))
    sums = groups.filter("named").agg(*[F.sum(F.col("n") * F.col("cap") * F.get("m", i)) for i in range(len(names))]).first() if names else []
    full = [float(x or 0.0) for x in sums]
    present = [i for i in range(len(names)) if full[i] > 0]
    whole = sum(goals[i]["target_share"] for i in present) or 1.0
    share = [goals[i]["target_share"] / whole if i in present else 0.0 for i in range(len(names))]
    total = min((full[i] / share[i] for i in present if share[i] > 0), default=0.0)
    steps = fit_rates(groups, [s * total for s in share])
    spot = F.pmod(F.xxhash64(F.lit("uses"), "id"), F.lit(BINS * BINS))
    rated = member.filter("cap > 0").withColumn("r", F.round(rate(F.col("m"), F.col("cap"), steps), 9)).filter("r > 0").withColumn("spot", spot)
    limit = _calibrated(rated)
    chosen = rated.withColumn("uses", (F.floor("r") + F.when(F.col("spot") < limit, 1).otherwise(0)).cast("int")).filter("uses > 0")
    got = chosen.groupBy("source").agg(F.count(F.lit(1)).alias("records"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("n")).alias("size"), F.array(*[F.sum(F.col("uses") * F.col("n") * F.get("m", i)) for i in range(len(names))]).alias("soft"))
    sums = got.collect()
    grand = sum(r["size"] for r in sums) or 1
    by = {r["source"]: r for r in sums}
    soft = [sum(r["soft"][i] or 0.0 for r in sums) for i in range(len(names))]
    rows = [
        (n, float(g["target_share"]), float(s), (by[n]["size"] / grand if n in by else 0.0), float(e / grand), int(by[n]["records"]) if n in by else 0, int(by[n]["uses"]) if n in by else 0, int(by[n]["size"]) if n in by else 0, int(g["max_repeats"]))
        for n, g, s, e in zip(names, goals, share, soft)
    ]
    schema = "source string, target_share double, reachable_share double, actual_share double, expected_share double, records bigint, uses bigint, size bigint, max_repeats int"
    return chosen.select("id", "source", "uses"), records.sparkSession.createDataFrame(rows, schema)


def _calibrated(rated: DataFrame) -> Column:
    """Per source and rate: the hash below which records get one use more, such that the tokens above the whole part
    of the rate are met to about a millionth. Two histograms of BINS bins per source are all that is collected."""
    frac = F.col("r") - F.floor("r")
    part = rated.withColumn("f", frac).filter("f > 0 and source is not null")
    key = ["source", "r"]
    coarse = part.groupBy(*key, F.floor(F.col("spot") / BINS).alias("b")).agg(F.sum("n").alias("n"), F.max("f").alias("f")).toPandas()
    out = F.when(F.col("source").isNull(), F.floor(frac * BINS * BINS)).otherwise(F.lit(0))
    edges = {}
    for k, g in coarse.groupby(key):
        g = g.sort_values("b")
        want, run = float(g["n"].sum() * g["f"].iloc[0]), g["n"].cumsum().to_numpy()
        j = min(int(np.searchsorted(run, want)), len(run) - 1)
        edges[k] = (int(g["b"].iloc[j]), want - float(run[j] - g["n"].iloc[j]))
    if edges:
        inside = None
        for (s, r), (b, _) in edges.items():
            c = (F.col("source") == s) & (F.col("r") == r) & (F.floor(F.col("spot") / BINS) == b)
            inside = c if inside is None else inside | c
        fine = part.filter(inside).groupBy(*key, "spot").agg(F.sum("n").alias("n")).toPandas()
        for (s, r), (b, want) in edges.items():
            g = fine[(fine["source"] == s) & (fine["r"] == r)].sort_values("spot")
            run = g["n"].cumsum().to_numpy()
            j = int(np.searchsorted(run, want - 1e-9))
            if 0 < j < len(run) and want - run[j - 1] < run[j] - want:
                j -= 1
            limit = int(g["spot"].iloc[min(j, len(run) - 1)]) + 1 if len(run) and want > 0 else b * BINS
            out = F.when((F.col("source") == s) & (F.col("r") == r), limit).otherwise(out)
    return out


def _run(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    qa = spark.read.parquet(f"{d}/build_qa_choice.parquet").select(F.col("item_id").alias("id"), "source", "question", "options")
    return mixture(qa, spark.read.parquet(f"{d}/mix_targets.parquet"))


def p2_chosen(spark: SparkSession, d: str) -> DataFrame:
    """The chosen records, their uses, and the target and actual share of their source."""
    chosen, shares = _run(spark, d)
    return chosen.join(F.broadcast(shares.select("source", "target_share", "actual_share")), "source", "left").select(F.col("id").alias("item_id"), "source", "uses", "target_share", "actual_share")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return _run(spark, d)[1]
