"""Functions of probability and vector arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def softmax(logits: Column, temperature: Column | float = 1.0) -> Column:
    """Probabilities of logits over a temperature, shifted by the largest so that nothing overflows."""
    t = F.lit(temperature) if isinstance(temperature, (int, float)) else temperature
    scaled = F.transform(logits, lambda x: x / t)
    shifted = F.transform(scaled, lambda x: F.exp(x - F.array_max(scaled)))
    return F.transform(shifted, lambda x: x / total(shifted))


def log_sum_exp(a: Column) -> Column:
    top = F.array_max(a)
    return top + F.log(total(F.transform(a, lambda x: F.exp(x - top))))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; null where one has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def ranked(p: Column, keys: Column) -> Column:
    """(score, key, index) of all options, best first; ties go to the smaller key, then the smaller index."""
    items = F.transform(F.arrays_zip(p.alias("p"), keys.alias("k")), lambda x, i: F.struct((-x["p"]).alias("n"), x["k"].alias("key"), i.alias("i")))
    return F.transform(F.array_sort(items), lambda x: F.struct((-x["n"]).alias("p"), x["key"].alias("key"), x["i"].alias("i")))


def argmax_first(p: Column) -> Column:
    """Index of the largest entry, the first among equals."""
    return F.array_position(p, F.array_max(p)).cast("int") - 1


def brier(p: Column, gold: Column) -> Column:
    """Sum over options of the squared distance to the certain gold."""
    return total(F.transform(p, lambda x, i: F.pow(x - F.when(i == gold, 1.0).otherwise(0.0), F.lit(2))))


def expected_level(p: Column) -> Column:
    return total(F.transform(p, lambda x, i: x * i))


def concentration(p: Column) -> Column:
    """(max - 1/K) / (1 - 1/K), kept within 0 and 1."""
    k = F.size(p).cast("double")
    return F.least(F.greatest((F.array_max(p) - 1 / k) / (1 - 1 / k), F.lit(0.0)), F.lit(1.0))


def reward(p: Column, gold: Column, weight: float = 0.75) -> Column:
    """ln p(gold) + weight * p(gold) / |p|: proper, as both parts are."""
    g = F.get(p, gold)
    return F.log(g) + weight * g / F.sqrt(dot(p, p))


def uniform(k: int) -> Column:
    """Soft targets that prefer nothing."""
    return F.array_repeat(F.lit(1.0 / k), k)


def cross_entropy(target: Column, p: Column) -> Column:
    """-sum target ln p over entries with weight; infinite where p is zero there."""
    part = F.zip_with(target, p, lambda t, x: F.when(t <= 0, 0.0).when(x <= 0, float("inf")).otherwise(-t * F.log(x)))
    return total(part)


def divergence(target: Column, p: Column) -> Column:
    """Kullback-Leibler divergence of p from target."""
    return cross_entropy(target, p) - cross_entropy(target, target)


def ordinal_loss(logits: Column, gold: Column) -> Column:
    """Mean binary cross-entropy of K-1 threshold logits against gold > threshold."""
    part = F.transform(logits, lambda x, i: F.greatest(x, F.lit(0.0)) - x * (gold > i).cast("double") + F.log1p(F.exp(-F.abs(x))))
    return total(part) / F.size(logits)


def reference_index(keys: Column, reference: Column) -> Column:
    """Index of a reference key among the keys, null if it is none of them."""
    return F.nullif(F.array_position(keys, reference), F.lit(0)).cast("int") - 1


def info_nce(forward: Column, target: Column, reverse: Column, reverse_target: Column) -> Column:
    """Mean of the cross-entropies of a state among all actions and of its action among all states, given the logits."""
    one = lambda a, i: log_sum_exp(a) - F.get(a, i)
    return (one(forward, target) + one(reverse, reverse_target)) / 2


def distillation(soft: Column, logits: Column, temperature: float) -> Column:
    """Divergence of the softened logits from soft targets (at least 1e-9, normalised), per option, times the temperature
    squared."""
    floor = F.transform(soft, lambda t: F.greatest(t.cast("double"), F.lit(1e-9)))
    target = F.transform(floor, lambda t: t / total(floor))
    return divergence(target, softmax(logits, temperature)) / F.size(soft) * temperature * temperature


def ordinal_cross_entropy(p: Column, gold: Column) -> Column:
    """Mean binary cross-entropy of the probabilities of at least level 1, 2, .. against gold, kept 1e-7 off 0 and 1."""
    least = F.transform(F.slice(p, 2, F.size(p) - 1), lambda x, i: 1.0 - total(F.slice(p, F.lit(1), i + 1)))
    kept = F.transform(least, lambda x: F.least(F.greatest(x, F.lit(1e-7)), F.lit(1 - 1e-7)))
    part = F.transform(kept, lambda x, i: -F.when(gold >= i + 1, F.log(x)).otherwise(F.log(1 - x)))
    return total(part) / F.size(part)


def mean_pool(vectors: Column, start: Column, end: Column) -> Column:
    """Mean of the vectors [start, end); null where there are none."""
    span = F.slice(vectors, start + 1, F.greatest(end - start, F.lit(0)))
    dims = F.sequence(F.lit(0), F.size(F.get(span, 0)) - 1)
    return F.when(F.size(span) > 0, F.transform(dims, lambda k: total(F.transform(span, lambda v: F.get(v, k).cast("double"))) / F.size(span)))


def attention_pool(vectors: Column, query: Column) -> Column:
    """Sum of vectors weighted by the softmax of their products with a query vector; null where there are none."""
    weights = softmax(F.transform(vectors, lambda v: dot(v, query)))
    dims = F.sequence(F.lit(0), F.size(F.get(vectors, 0)) - 1)
    return F.when(F.size(vectors) > 0, F.transform(dims, lambda k: total(F.zip_with(vectors, weights, lambda v, w: F.get(v, k) * w))))


def token_readout(logp: Column) -> Column:
    """(sum, mean) of an option's token log-probabilities; null for an option without tokens."""
    return F.when(F.size(logp) > 0, F.struct(total(logp).alias("sum"), (total(logp) / F.size(logp)).alias("mean")))


def label_readout(option_ids: Column, logp: Column) -> Column:
    """Log-probability of each option's letter: option_ids has one list of ids per option, logp is a map of ids; fails unless
    each has one id and these differ."""
    ids = F.transform(option_ids, lambda o: F.get(o, 0))
    fine = ~F.exists(option_ids, lambda o: F.size(o) != 1) & (F.size(F.array_distinct(ids)) == F.size(ids))
    return F.when(fine, F.transform(ids, lambda i: F.try_element_at(logp, i))).otherwise(F.raise_error(F.lit("letters need different single ids")).cast("array<double>"))


def argmax_canonical(p: Column, order: Column) -> Column:
    """Index of the largest entry; among equals the first in canonical order (an array of indexes)."""
    best = F.array_min(F.transform(order, lambda i, k: F.struct((-F.get(p, i)).alias("n"), k.alias("k"), i.alias("i"))))
    return best["i"]
