"""Exact similarity join of sets: word-signature prefix filter, bit fingerprints as a filter, verification.

Every set has a fingerprint in which each member flips one bit, so two fingerprints differ in at most as many bits as the
sets differ in members. Sets are joined on signatures of their members; the fingerprints only drop pairs outside the Hamming radius that the
wanted Jaccard similarity t allows, and the rest is verified.

Blocks: with at least t = 60 % of all members in common, two sets of 22 may differ in 10. Cut evenly into segments, a code
of that radius has segments without any telling member, and most sets that share their frequent members would meet. So
no block of the code is joined: the join keys, called blocks, are hashes of pairs and triples of members in order of corpus
frequency, as many as the pigeonhole principle demands. That loses no pair: two sets share at least c = ceil(t/(1+t) (s+s')) members, and
- either two of them are rare (in at most one of 1,000 sets each): pairs of rare members meet;
- or one is rare and c-1 of the n others are shared, so one of the first n-(c-1)+1 others, in one order: it meets with it;
- or none is rare and c of the others are shared, so three are among the first n-c+3.
Sets under 9 members and over 40 use single members of the usual prefix instead; sets near those bounds use both.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RARE = 1000  # a member is rare in at most one of RARE sets; so at most RARE x (mean set size) members are not rare
TINY, LONG = 8, 40


def shared_members(s: int, s2: int, t: float) -> int:
    """Members that sets of these sizes share at least when a share t of their union is in both."""
    return math.ceil(round(t / (1 + t) * (s + s2), 9))


def _mix(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(parts[0].shape, np.uint64)
    for p in parts:
        h = (h ^ p) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _ordered(offsets: np.ndarray, values: np.ndarray, common: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member hashes of each row, rare ones first and then from rare to frequent; rare members of each row)."""
    n_rows = len(offsets) - 1
    row = np.repeat(np.arange(n_rows), np.diff(offsets))
    values = values.astype(np.uint64)
    at = np.minimum(np.searchsorted(common, values), max(len(common) - 1, 0))
    known = common[at] == values if len(common) else np.zeros(len(values), bool)
    place = np.where(known, rank[at].astype(np.uint64) if len(common) else 0, values)
    return values[np.lexsort((place, known, row))], np.bincount(row, weights=~known, minlength=n_rows).astype(np.int64)


def block_keys(offsets: np.ndarray, values: np.ndarray, common: np.ndarray, rank: np.ndarray, most: dict[int, int], t: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of member hashes (CSR) -> (row, key) of all blocks of each row.

    common: sorted hashes of the members that are not rare; rank: their order, rarest first. most: for each size of a set
    that there is, the most members that are not rare in a set of that size; so partners that can't have enough of them
    need no blocks.
    """
    size = np.diff(offsets)
    values, rare = _ordered(offsets, values, common, rank)
    rows, keys = [], []

    def emit(ids: np.ndarray, cols: np.ndarray, pick: list[tuple[int, ...]], tag: int) -> None:
        if len(pick) and len(ids):
            ix = np.array(pick)
            parts = [cols[:, ix[:, k]] for k in range(ix.shape[1])]
            keys.append(_mix(np.full(parts[0].shape, tag, np.uint64), *parts).ravel())
            rows.append(np.repeat(ids, len(pick)))

    for code in np.unique(rare * (1 << 32) + size):
        r, s = int(code >> 32), int(code & 0xFFFFFFFF)
        if not s:
            continue
        ids = np.nonzero((rare == r) & (size == s))[0]
        cols = values[offsets[ids][:, None] + np.arange(s)]
        partners = [x for x in most if x >= math.ceil(round(t * s, 9)) and s >= math.ceil(round(t * x, 9))]
        if s <= math.floor((TINY + 1) / t) or s >= math.ceil(round(t * (LONG + 1), 9)):
            least = min((shared_members(s, x, t) for x in partners), default=s)
            emit(ids, cols, [(k,) for k in range(min(s, s - least + 1))], 1)
        if TINY < s <= LONG:
            n = s - r
            mids = [(shared_members(s, x, t), most[x]) for x in partners if TINY < x <= LONG]
            # two rare members in common
            c = min((c for c, _ in mids), default=s)
            emit(ids, cols, list(combinations(range(min(r, r - max(2, c - n) + 2)), 2)), 2)
            # one rare word and at least c-1 others
            c = min((c for c, m in mids if c - 1 <= min(n, m)), default=0)
            if c and r:
                emit(ids, cols, [(i, r + j) for i in range(r) for j in range(min(n, n - (c - 1) + 1))], 3)
            # no rare word and at least c others
            c = min((c for c, m in mids if c <= min(n, m)), default=0)
            if c:
                emit(ids, cols, [(r + i, r + j, r + k) for i, j, k in combinations(range(min(n, n - c + 3)), 3)], 4)
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(keys).view(np.int64)


def _csr(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    col = batch.column("w")
    off = col.offsets.to_numpy()
    return off - off[0], col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]


def _most_frequent(classes: DataFrame, common: np.ndarray, rank: np.ndarray) -> dict[int, int]:
    """For each size of a set, the most members that are not rare in one set."""
    shared = classes.sparkSession.sparkContext.broadcast((common, rank))

    def run(batches):
        for b in batches:
            off, vals = _csr(b)
            _, rare = _ordered(off, vals, *shared.value)
            size = np.diff(off)
            sizes = np.unique(size)
            top = [int((size - rare)[size == s].max()) for s in sizes]
            yield pa.RecordBatch.from_arrays([pa.array(sizes.astype(np.int32)), pa.array(np.array(top, np.int32))], ["s", "n"])

    return dict(sorted(tuple(r) for r in classes.select("w").mapInArrow(run, "s int, n int").groupBy("s").agg(F.max("n").alias("n")).collect()))


def _blocks(classes: DataFrame, common: np.ndarray, rank: np.ndarray, most: dict[int, int], mask: int, t: float) -> DataFrame:
    """(key, code) of all blocks of all classes; keys are cut to the bits that tell this many blocks apart."""
    shared = classes.sparkSession.sparkContext.broadcast((common, rank, most, t))

    def run(batches):
        for b in batches:
            off, vals = _csr(b)
            rows, keys = block_keys(off, vals, *shared.value)
            keys, code = keys & mask, b.column("code").to_numpy(zero_copy_only=False)[rows]
            for k in range(0, len(rows), 500_000):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + 500_000]), pa.array(code[k : k + 500_000])], ["key", "code"])

    return classes.select("code", "w").mapInArrow(run, "key bigint, code bigint")


def fingerprint(w: Column) -> Column:
    """64 bits of a set of member hashes: 54 of which each member flips one, and 10 for the set's size (1023: that or more)."""
    flip = lambda x: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(F.shiftright(x, 8), F.lit(54)).cast("int"))
    parity = F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(flip(x)))
    return F.shiftleft(parity, 10).bitwiseOR(F.least(F.size(w), F.lit(1023)).cast("bigint"))


def within_radius(a: str, b: str, t: float) -> Column:
    """Whether two codes differ in no more bits than sets of these sizes may differ in members. From 1,023 members on any two
    codes do: the radius is above 54 then."""
    sa, sb = F.col(a).bitwiseAND(F.lit(1023)), F.col(b).bitwiseAND(F.lit(1023))
    radius = sa + sb - 2 * F.ceil(F.lit(t / (1 + t)) * (sa + sb) - 1e-9)
    return F.bit_count(F.shiftrightunsigned(F.col(a).bitwiseXOR(F.col(b)), 10)) <= radius


def name(w: Column) -> list[Column]:
    """128 bits k1, k2 that name a sorted array of hashes."""
    return [F.xxhash64(w).alias("k1"), F.xxhash64(F.size(w), F.reverse(w)).alias("k2")]


def hashed(members: Column) -> Column:
    """Sorted hashes of an array of distinct strings."""
    return F.array_sort(F.transform(members, lambda x: F.xxhash64(x)))


def similar_sets(a: DataFrame, b: DataFrame, universe: DataFrame, t: float) -> DataFrame:
    """(cid, w, code) of distinct sets a and b -> (a_cid, b_cid, overlap, jaccard) for all pairs with Jaccard >= t.

    w are sorted distinct hashes, code their fingerprint, cid unique per set. universe has column w of all sets of a and
    b (each once), from which frequencies are counted. A set in both is paired with itself. Empty sets have no pairs.
    """
    n = universe.count()
    common = (
        universe.select(F.explode("w").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("df"))
        .filter(F.col("df") > n // RARE).orderBy("df", "h").toPandas()
    )
    h = common["h"].to_numpy(np.int64).view(np.uint64) if len(common) else np.zeros(0, np.uint64)
    by = np.argsort(h, kind="stable")
    most = _most_frequent(universe, h[by], by)
    mask = (1 << min(63, 24 + n.bit_length())) - 1
    x = _blocks(a, h[by], by, most, mask, t).withColumnRenamed("code", "a_code")
    y = _blocks(b, h[by], by, most, mask, t).withColumnRenamed("code", "b_code")
    near = x.join(y.hint("merge"), "key").filter(within_radius("a_code", "b_code", t)).select("a_code", "b_code").distinct()
    left = a.select(F.col("code").alias("a_code"), F.col("cid").alias("a_cid"), F.col("w").alias("w1"))
    right = b.select(F.col("code").alias("b_code"), F.col("cid").alias("b_cid"), F.col("w").alias("w2"))
    pairs = near.join(left, "a_code").join(right, "b_code").withColumn("overlap", F.size(F.array_intersect("w1", "w2")))
    pairs = pairs.withColumn("jaccard", F.col("overlap") / (F.size("w1") + F.size("w2") - F.col("overlap")))
    return pairs.filter(F.col("jaccard") >= t - 1e-12).select("a_cid", "b_cid", "overlap", "jaccard")
