"""Problem 3: same or near-same records across splits.

Every distinct set of words is one class. Classes of train and held-out splits that may be similar meet in the core's prefix
join: keys of a class's words in order of frequency, as many as the pigeonhole principle demands, then the Hamming radius of
a bit fingerprint, then the words. It loses no pair of similarity T or more (see operators/similar.py). Pairs of classes
become pairs of items only where they are listed.

blocked_classes() is the way by blocks of a similarity hash, for texts whose sets are too long for the prefix join. It may
miss pairs, so no query uses it. A class has a similarity-hash bit fingerprint there: CELLS cells of 16 bits, each the hash of
the set's least member under one of CELLS random orders, so two fingerprints agree in a cell as often as the sets have
words in common. The fingerprint is permuted PERMUTATIONS times and cut into blocks of BLOCK cells; classes that agree in any
block of their permuted codes meet. A second code of PARITY bits, of which each word
flips one, lies within a Hamming radius that size and wanted similarity of the sets fix; pairs outside it are dropped in
the join, which loses nothing, and the rest is verified word by word.

Every class has the same number of blocks, whatever its length. A pair of similarity s meets in a block with probability
s^BLOCK, so it is found with 1 - (1 - s^BLOCK)^(blocks): 0.993 at s = 0.6, 0.999 at 0.65, above 0.9999 from 0.7 on; equal
sets always.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.operators import similar
from quillet.session import cut, hot_threshold, join_unique

T = 0.6  # share of the words of either question that both must have
BLOCK = 4  # cells of a block
SEGMENTS = 18  # blocks per permutation
CELLS = BLOCK * SEGMENTS
PERMUTATIONS = 2  # two blocks of different permutations share at most one cell
PARITY = 118  # bits of the second code; 10 more hold the set's size
PROBE = 16  # hot blocks are looked for among one in so many classes
HOT = 64  # and are those that so many of these share; each part of a hot block has about PROBE * HOT classes


def words(c: Column) -> Column:
    """Distinct words: lower case, without invisible characters, split at all but letters, marks, digits and points
    between digits. Null gives null."""
    t = F.lower(F.regexp_replace(F.upper(c), r"[\p{Cf}\x{fe00}-\x{fe0f}]+", ""))  # upper case first unites sharp s and ss
    t = F.regexp_replace(t, r"(?<!\p{Nd})\.|\.(?!\p{Nd})|[^\p{L}\p{M}\p{N}.]+", " ")
    return F.array_distinct(F.filter(F.split(t, " +"), lambda w: w != ""))


def side(split: Column) -> Column:
    """train or heldout; null for a null or unknown split. Case and blanks don't matter."""
    s = F.lower(F.trim(split))
    return F.when(s == "train", "train").when(s.isin("validation", "dev", "test", "eval"), "heldout")


def parity_code(w: Column) -> list[Column]:
    """The second code of a set of member hashes, c1 and c2: PARITY bits, of which each member flips one, and the set's
    size (1023: that or more) in the lowest 10 bits of c1."""
    spot = lambda x: F.pmod(F.shiftright(x, 8), F.lit(PARITY))
    flip = lambda x, low, high: F.when(spot(x).between(low, high), F.call_function("shiftleft", F.lit(1).cast("bigint"), (spot(x) - low).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    one = lambda low, high: F.aggregate(w, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseXOR(flip(x, low, high)))
    return [F.shiftleft(one(0, 53), 10).bitwiseOR(F.least(F.size(w), F.lit(1023)).cast("bigint")).alias("c1"), one(54, PARITY - 1).alias("c2")]


def within_radius(t: float) -> Column:
    """Whether codes (a1, a2) and (b1, b2) differ in no more bits than sets of these sizes with a share t of their union in
    both may differ in members. Sets of 1,023 or more members always may: the radius is above PARITY then."""
    sa, sb = F.col("a1").bitwiseAND(F.lit(1023)), F.col("b1").bitwiseAND(F.lit(1023))
    apart = F.bit_count(F.shiftrightunsigned(F.col("a1").bitwiseXOR(F.col("b1")), 10)) + F.bit_count(F.col("a2").bitwiseXOR(F.col("b2")))
    return apart <= sa + sb - 2 * F.ceil(F.lit(t / (1 + t)) * (sa + sb) - 1e-9)


def word_classes(items: DataFrame) -> DataFrame:
    """(id, side, w) -> one row per distinct set of words: k1, k2 (its 128 bits), cid (smallest id), w, train, heldout
    (numbers of items)."""
    one = lambda s: F.sum((F.col("side") == s).cast("bigint")).alias(s)
    return items.groupBy(*similar.name(F.col("w"))).agg(F.first("w").alias("w"), F.min("id").alias("cid"), one("train"), one("heldout"))


def _items(spark: SparkSession, d: str) -> DataFrame:
    qa = spark.read.parquet(f"{d}/build_qa_choice.parquet")
    w = similar.hashed(words(F.col("question")))
    return qa.select(F.col("item_id").alias("id"), side(F.col("split")).alias("side"), w.alias("w"), "source", F.lower(F.trim("split")).alias("split")).filter("side is not null and size(w) > 0")


def cells(offsets: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sets of member hashes (CSR, none empty) -> their fingerprints: (sets, CELLS) of 16 bits."""
    v = values.view(np.uint64)
    out = np.empty((len(offsets) - 1, CELLS), np.uint16)
    step = np.array([0x9E3779B97F4A7C15], np.uint64)
    for c in range(CELLS):
        h = (v ^ (step * np.uint64(c + 1))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x94D049BB133111EB)
        least = np.minimum.reduceat(h, offsets[:-1])
        out[:, c] = ((least ^ (least >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(48)
    return out


def block_keys(code: np.ndarray, mask: int) -> np.ndarray:
    """Fingerprints -> (sets, blocks) of keys: a block of a permutation and what its cells hold.

    Cells are laid out in BLOCK rows of SEGMENTS; permutation p moves row r by p * r, and a block is a column.
    """
    grid = code.reshape(-1, BLOCK, SEGMENTS).astype(np.uint64)
    keys = np.empty((len(code), PERMUTATIONS * SEGMENTS), np.uint64)
    for p in range(PERMUTATIONS):
        h = np.full((len(code), SEGMENTS), p, np.uint64) * np.uint64(SEGMENTS) + np.arange(SEGMENTS, dtype=np.uint64)
        for r in range(BLOCK):
            h = (h ^ np.roll(grid[:, r], -p * r, axis=1)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        keys[:, p * SEGMENTS : (p + 1) * SEGMENTS] = h
    return (keys & np.uint64(mask)).view(np.int64)


def _part(key: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Key of one part of a hot block; it may fall on another block's, which only adds candidates."""
    return np.where(part > 0, key ^ (part * 0x1000193), key)


def _blocks(classes: DataFrame, mask: int, hot: tuple[np.ndarray, np.ndarray] | None = None, spread: bool = False) -> DataFrame:
    """(key, c1, c2) of all blocks. hot: sorted keys of hot blocks and their numbers of parts; a class goes to the part that
    its code names, or with spread to all parts."""
    shared = classes.sparkSession.sparkContext.broadcast(hot) if hot is not None and len(hot[0]) else None

    def run(batches):
        for b in batches:
            col = b.column("w")
            off = col.offsets.to_numpy()
            keys = block_keys(cells(off - off[0], col.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]), mask)
            row, key = np.repeat(np.arange(len(keys)), keys.shape[1]), keys.ravel()
            c1, c2 = (b.column(c).to_numpy(zero_copy_only=False) for c in ("c1", "c2"))
            if shared is not None:
                names, parts = shared.value
                at = np.minimum(np.searchsorted(names, key), len(names) - 1)
                n = np.where(names[at] == key, parts[at], 1)
                if spread:
                    row, key = np.repeat(row, n), np.repeat(key, n)
                    key = _part(key, np.arange(len(key)) - np.repeat(np.cumsum(n) - n, n))
                else:
                    mixed = (c1 ^ c2)[row].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                    key = _part(key, (mixed >> np.uint64(33)).astype(np.int64) % n)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(c1[row]), pa.array(c2[row])], ["key", "c1", "c2"])

    return classes.select(*parity_code(F.col("w")), "w").mapInArrow(run, "key bigint, c1 bigint, c2 bigint")


def _hot_blocks(classes: DataFrame, mask: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys that many classes share, and into how many parts each is split. Looked for among one in PROBE classes; a block
    that is not noticed costs time, no pair. At most 1,000 keys hold a thousandth of all blocks each."""
    probe = _blocks(classes.filter(F.pmod(F.xxhash64("cid"), F.lit(PROBE)) == 0), mask).groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    got = probe.filter(F.col("n") >= HOT).orderBy(F.desc("n"), "key").limit(1000).orderBy("key").collect()
    return np.array([r["key"] for r in got], np.int64), np.array([-(-r["n"] // HOT) for r in got], np.int64)


def prefix_classes(classes: DataFrame, t: float = T) -> DataFrame:
    """Classes -> (train_cid, heldout_cid) of all with at least a share t of all their words in common. A class of both
    sides is paired with itself."""
    sets = classes.withColumn("code", similar.fingerprint(F.col("w")))
    found = similar.similar_sets(sets.filter("train > 0"), sets.filter("heldout > 0"), sets, t)
    return found.select(F.col("a_cid").alias("train_cid"), F.col("b_cid").alias("heldout_cid"))


def similar_classes(classes: DataFrame, t: float = T) -> DataFrame:
    """The pairs of classes that count: all of them, by prefix_classes()."""
    return prefix_classes(classes, t)


def blocked_classes(classes: DataFrame, t: float = T) -> DataFrame:
    """Classes -> (train_cid, heldout_cid) of all that agree in a block and have at least a share t of all their words in
    common; a pair that agrees in none is missed (see the module's head). A class of both sides is paired with itself, without a join; a set of one word is similar to no other."""
    mask = (1 << min(62, 24 + classes.count().bit_length())) - 1
    many = classes.filter("size(w) > 1")
    train, held = many.filter("train > 0"), many.filter("heldout > 0")
    hot = _hot_blocks(many, mask)
    x = _blocks(train, mask, hot).withColumnsRenamed({"c1": "a1", "c2": "a2"})
    y = _blocks(held, mask, hot, spread=True).withColumnsRenamed({"c1": "b1", "c2": "b2"})
    other = (F.col("a1") != F.col("b1")) | (F.col("a2") != F.col("b2"))
    near = x.join(y.hint("merge"), "key").filter(other & within_radius(t)).select("a1", "a2", "b1", "b2").distinct()
    code = parity_code(F.col("w"))
    left = train.select(code[0].alias("a1"), code[1].alias("a2"), F.col("cid").alias("train_cid"), F.col("w").alias("w1"))
    right = held.select(code[0].alias("b1"), code[1].alias("b2"), F.col("cid").alias("heldout_cid"), F.col("w").alias("w2"))
    # sets of equal codes: equal or all but equal
    twins = left.join(right, (F.col("a1") == F.col("b1")) & (F.col("a2") == F.col("b2")) & (F.col("train_cid") != F.col("heldout_cid")))
    met = near.join(left, ["a1", "a2"]).join(right, ["b1", "b2"]).select("train_cid", "w1", "heldout_cid", "w2").unionAll(twins.select("train_cid", "w1", "heldout_cid", "w2"))
    both = F.size(F.array_intersect("w1", "w2"))
    pairs = met.filter(both >= F.lit(t) * (F.size("w1") + F.size("w2") - both) - 1e-9).select("train_cid", "heldout_cid")
    same = classes.filter("train > 0 and heldout > 0").select(F.col("cid").alias("train_cid"), F.col("cid").alias("heldout_cid"))
    return same.unionAll(pairs)


def overlaps(items: DataFrame, exact: bool = False) -> tuple[DataFrame, DataFrame]:
    """Items (id, side, w, split, source) -> members (id, side, split, source, cid) of the classes in pairs, and pairs of
    classes (train_cid, heldout_cid), a class that has items of both sides being paired with itself.

    Items without words or side have no pairs. Repeated items are members of one class, so copies cost nothing until
    pairs of items are listed. exact names the prefix join whatever similar_classes is; both lose no pair.
    """
    classes = cut(word_classes(items))
    items = cut(items.select("id", "side", "split", "source", F.struct(*similar.name(F.col("w"))).alias("k")))
    pairs = cut(prefix_classes(classes) if exact else similar_classes(classes))
    linked = pairs.select(F.explode(F.array("train_cid", "heldout_cid")).alias("cid")).distinct()
    keys = classes.join(linked, "cid").select(F.struct("k1", "k2").alias("k"), "cid", (F.col("train") + F.col("heldout")).alias("n"))
    rows = classes.agg(F.coalesce(F.sum(F.col("train") + F.col("heldout")), F.lit(0))).first()[0]
    members = join_unique(items, keys, "k", "n", hot_threshold(rows)).drop("k")
    return members, pairs


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = overlaps(_items(spark, d))
    train = members.filter("side = 'train'").select(F.col("id").alias("a"), F.col("cid").alias("train_cid"))
    held = members.filter("side = 'heldout'").select(F.col("id").alias("b"), F.col("cid").alias("heldout_cid"))
    both = pairs.join(train, "train_cid").join(held, "heldout_cid")
    return both.select(F.least("a", "b").alias("item_a"), F.greatest("a", "b").alias("item_b"))


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Pairs between class representatives, with the numbers of items they stand for."""
    members, pairs = overlaps(_items(spark, d))
    n = members.groupBy("cid").agg(F.sum((F.col("side") == "train").cast("bigint")).alias("train"), F.sum((F.col("side") == "heldout").cast("bigint")).alias("heldout"))
    t = n.select(F.col("cid").alias("train_cid"), F.col("train").alias("train_items"))
    h = n.select(F.col("cid").alias("heldout_cid"), F.col("heldout").alias("heldout_items"))
    return pairs.join(t, "train_cid").join(h, "heldout_cid")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Per held-out split and source: items, and items with an equal or similar question in train."""
    members, pairs = overlaps(_items(spark, d))
    hit = pairs.groupBy("heldout_cid").agg(F.count(F.lit(1)).alias("links")).withColumnRenamed("heldout_cid", "cid")
    leaked = members.filter("side = 'heldout'").join(hit, "cid").groupBy("split", "source").agg(F.count(F.lit(1)).alias("leaked"))
    items = _items(spark, d).filter("side = 'heldout'").groupBy("split", "source").agg(F.count(F.lit(1)).alias("items"))
    same = items["split"].eqNullSafe(leaked["split"]) & items["source"].eqNullSafe(leaked["source"])
    return items.join(leaked, same, "left").select(items["split"], items["source"], "items", F.coalesce("leaked", F.lit(0)).alias("leaked"))
