"""Joins: lookups with reassembly, siblings, donors, exact similarity screens."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillet.functions import text
from quillet.operators import blocks, similar
from quillet.operators.records import hash_order
from quillet.session import cut


def attach_last(left: DataFrame, right: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Left join with the last (largest `order`) value of each key."""
    last = right.groupBy(key).agg(F.max_by(value, order).alias(value))
    return left.join(last, key, "left")


def lookup_all(rows: DataFrame, id: str, keys: str, table: DataFrame, key: str, value: str) -> DataFrame:
    """Replaces an array of keys by the array of their values, in order; found is false if any is missing.

    rows: (id, keys). Keys are exploded, joined and gathered again per row: as many rows as keys, never per table row.
    """
    each = rows.select(id, F.posexplode(keys).alias("pos", "_k"))
    got = each.join(table.select(F.col(key).alias("_k"), F.col(value).alias("_v")), "_k", "left")
    back = got.groupBy(id).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_v"))), lambda s: s["_v"]).alias("values"), F.bool_and(F.col("_v").isNotNull()).alias("found"))
    return rows.join(back, id, "left").select(*rows.columns, "values", F.coalesce("found", F.lit(False)).alias("found"))


def siblings(df: DataFrame, group: str, id: str, answer: str, most: int) -> DataFrame:
    """Up to `most` different other answers of the same group per row, in hash order: (id, sibling, rank).

    Answers are reduced per group first: the most + 1 first distinct ones in hash order serve all rows of the group, so
    a group with a third of all rows costs a join with most + 1 rows and never meets itself.
    """
    norm = text.collapse_space(F.col(answer))
    distinct = df.filter(F.col(group).isNotNull()).select(F.col(group).alias("_g"), norm.alias("_n")).filter("_n is not null").distinct()
    h = F.sha2(F.concat_ws("|", F.lit("sibling"), "_g", "_n"), 256)
    best = _first_per_group(distinct.withColumn("_h", h), most + 1)
    rows = df.select(id, F.col(group).alias("_g"), norm.alias("_mine")).join(best, "_g")
    kept = F.slice(F.filter(F.transform("_s", lambda s: s["_n"]), lambda n: n != F.coalesce(F.col("_mine"), F.lit(""))), 1, most)
    return rows.select(id, F.posexplode(kept).alias("_i", "sibling")).select(id, "sibling", (F.col("_i") + 1).alias("rank"))


def _first_per_group(df: DataFrame, k: int) -> DataFrame:
    """(_g, _h, _n) -> (_g, _s) with the k first (_h, _n), in two levels over a salt, so that hot groups are spread."""
    w1 = Window.partitionBy("_g", "_salt").orderBy("_h")
    w2 = Window.partitionBy("_g").orderBy("_h")
    a = df.withColumn("_salt", F.pmod(F.xxhash64("_n"), F.lit(32))).withColumn("_r", F.row_number().over(w1)).filter(F.col("_r") <= k)
    b = a.withColumn("_r", F.row_number().over(w2)).filter(F.col("_r") <= k)
    return b.groupBy("_g").agg(F.array_sort(F.collect_list(F.struct("_h", "_n"))).alias("_s"))


def _pair(group: str, content: str) -> Column:
    return F.struct(F.col("_h").alias("h"), F.col(group).alias("g"), F.col(content).alias("c"))


def _spare_donors(keys: DataFrame, within: list[str], group: str, content: str) -> DataFrame:
    """Per value of within, pairs among which every key finds one of another group and content if there is any: the first
    (a); the first that differs from it in both (b); and the first that covers the keys which neither serves."""
    least = lambda c, n: F.min(F.when(c, _pair(group, content))).alias(n)
    g, c = F.col(group), F.col(content)

    def with_(df: DataFrame, found: DataFrame) -> DataFrame:
        named = found.withColumnsRenamed({x: f"_{x}" for x in within})
        same = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in within]
        return df.join(named, same if same else F.lit(True)).drop(*[f"_{x}" for x in within])

    first = keys.groupBy(*within).agg(least(F.lit(True), "_a"))
    one = with_(keys, first)
    two = one.groupBy(*within, "_a").agg(least((g != F.col("_a.g")) & (c != F.col("_a.c")), "_b"))
    rest = with_(keys, two).groupBy(*within, "_a", "_b").agg(
        least(F.when(F.col("_b").isNull(), (g == F.col("_a.g")) & (c != F.col("_a.c"))).otherwise((g != F.col("_a.g")) & (c != F.col("_b.c"))), "_x"),
        least(F.when(F.col("_b").isNull(), (g != F.col("_a.g")) & (c == F.col("_a.c"))).otherwise((g != F.col("_b.g")) & (c != F.col("_a.c"))), "_y"),
    )
    return rest


def ring_donors(df: DataFrame, within: list[str], group: str, content: str, seed: str, ahead: int = 8, most: int = 1, missing: str = "null") -> DataFrame:
    """Donors per (within.., group, content): of the same `within`, another group and another content.

    A seeded hash puts the distinct keys on rings of about 50,000; each takes the first of the next `ahead` keys of its ring
    that fit, up to `most` of different contents; a key that finds none there takes one of _spare_donors, so it has a donor
    whenever there is one. No task holds all keys and none meets all others. (within, group, content, donor_group,
    donor_content, donors), donors being all of them as (g, c); null and empty where there is no donor, or an error with
    missing="error".
    """
    keys = df.select(*within, group, content).distinct().withColumn("_h", hash_order(seed, *within, group, content))
    keys = cut(keys)
    digits = max(0, math.ceil(math.log(max(keys.count(), 1) / 50_000, 16)))
    keys = keys.withColumn("_ring", F.substring("_h", 1, digits))
    w = Window.partitionBy(*within, "_ring").orderBy("_h")
    fits = lambda d: (d["g"] != F.col(group)) & (d["c"] != F.col(content))
    nexts = F.array(*[F.lead(F.struct(F.col(group).alias("g"), F.col(content).alias("c")), i).over(w) for i in range(1, ahead + 1)])
    found = keys.withColumn("_d", F.filter(nexts, lambda d: d.isNotNull() & fits(d)))
    found = cut(found.withColumn("_d", F.slice(F.filter("_d", lambda d, i: ~F.array_contains(F.transform(F.slice("_d", F.lit(1), i), lambda e: e["c"]), d["c"])), 1, most)))
    done, lone = found.filter(F.size("_d") > 0), found.filter(F.size("_d") == 0).drop("_d")
    spare = _spare_donors(keys, within, group, content).withColumnsRenamed({x: f"_{x}" for x in within})
    on = [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in within]
    some = lone.join(spare, on if on else F.lit(True)).withColumn("_d", F.filter(F.array("_a", "_b", "_x", "_y"), lambda d: d.isNotNull() & fits(d)))
    some = some.withColumn("_d", F.slice(F.transform("_d", lambda d: F.struct(d["g"].alias("g"), d["c"].alias("c"))), 1, 1))
    out = done.select(*within, group, content, "_d").unionByName(some.select(*within, group, content, "_d"))
    if missing == "error":
        out = out.withColumn("_d", F.when(F.size("_d") == 0, F.raise_error(F.lit("no donor of another group and content")).cast(dict(out.dtypes)["_d"])).otherwise(F.col("_d")))
    return out.select(*within, group, content, F.get("_d", 0)["g"].alias("donor_group"), F.get("_d", 0)["c"].alias("donor_content"), F.col("_d").alias("donors"))


def jaccard_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, tokens: str, threshold: float) -> DataFrame:
    """Exact similarity join of token sets (arrays of distinct tokens): (left_id, right_id, overlap, jaccard).

    Equal sets are one class, classes are joined by similar.similar_sets, and pairs of classes are spread to their rows
    at the end. Null and empty sets match nothing. No caps.
    """
    one = lambda df, id, flag: df.select(F.col(id).alias("id"), similar.hashed(F.col(tokens)).alias("w"), F.lit(flag).alias("left")).filter("size(w) > 0")
    rows = one(left, left_id, True).unionAll(one(right, right_id, False))
    groups = rows.groupBy(*similar.name(F.col("w"))).agg(F.first("w").alias("w"), F.max("left").alias("l"), F.min("left").alias("r"))
    classes = cut(groups.select(F.struct("k1", "k2").alias("cid"), "w", "l", (~F.col("r")).alias("r"), similar.fingerprint(F.col("w")).alias("code")))
    pairs = similar.similar_sets(classes.filter("l"), classes.filter("r"), classes, threshold)
    member = lambda df, id, c: df.select(id, F.struct(*similar.name(similar.hashed(F.col(tokens)))).alias(c))
    out = pairs.join(member(left, left_id, "a_cid"), "a_cid").join(member(right, right_id, "b_cid"), "b_cid")
    return out.select(left_id, right_id, "overlap", "jaccard")


# Words that donors are not chosen by.
DONOR_STOPWORDS = (
    "the a an and or of to in on for with by is are was were be been that this these those it its as at from into over under between "
    "which what who whom whose when where why how not no than then such more most other some any all each both each can could may might "
    "will would shall should do does did have has had about their there here also but if so we you they he she i"
).split()


def donor_terms(c: Column, least: int = 4) -> Column:
    """Terms of `least` or more letters and digits, lower case, in order, without DONOR_STOPWORDS."""
    return F.filter(text.tokens(c, least), lambda t: ~t.isin(DONOR_STOPWORDS))


def _marks(columns: list[str]) -> Column:
    """A hash of each column, null for null."""
    return F.array(*[F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in columns]).cast("array<bigint>")


def nearest_by_tfidf(queries: DataFrame, docs: DataFrame, query_id: str, doc_id: str, text_col: str, least: int = 4, apart: list[str] | None = None, fallback: bool = False) -> DataFrame:
    """The document with the largest sum of idf x frequency over the distinct terms of each query; ties go to the
    smallest id. idf = ln(1 + N / df).

    apart: columns of both tables in which query and document must differ (null differs from nothing). fallback: queries
    without a common term take one of the 64 first documents by hash that is apart, with score 0; else they have no row.
    No query is joined with the documents of its terms: queries pass blocks of the documents' index (see blocks).
    """
    apart = apart or []
    n = docs.count()
    words = docs.select(F.col(doc_id).alias("_d"), donor_terms(F.col(text_col), least).alias("_w"), _marks(apart).alias("_m")).filter(F.size("_w") > 0)
    tokens = words.agg(F.coalesce(F.sum(F.size("_w")), F.lit(0))).first()[0]
    post = words.select(F.col("_d").alias(doc_id), "_m", F.explode("_w").alias("term"), F.lit(1).alias("tf"))
    asked = queries.select(query_id, F.array_distinct(donor_terms(F.col(text_col), least)).alias("_t"), _marks(apart).alias("marks"))
    index = blocks.Index(post, asked.select(F.explode("_t").alias("term")), doc_id, F.col("_m"), tokens)

    def weigh(tf, doc, extra, df):
        return np.log(1 + n / df) * tf

    def nearest(block, columns, i, places, best):
        def fit(at):  # marks: a hash per column, null for null
            ok = np.ones(len(at), bool)
            for k, mark in enumerate(columns["marks"][i]):
                if mark is None:
                    return np.zeros(len(at), bool)
                theirs, known = block.marked(k)
                ok &= known[at] & (theirs[at] != mark)
            return ok

        return block.any_of(places[places >= 0].tolist(), best, 1, fit if apart else None)

    each = blocks.spread(asked.filter(F.size("_t") > 0).select(query_id, "marks", F.transform("_t", lambda t: F.xxhash64(t)).alias("terms")), query_id)
    each = each.groupBy(query_id).agg(F.flatten(F.collect_list("terms")).alias("terms"), F.first("marks").alias("marks"))  # rows of one id are one query
    found = blocks.ranked(index.over(each, nearest, weigh, "_best"), query_id, "_best", doc_id).drop("rank")
    if not fallback:
        return found
    some = docs.select(F.struct(F.sha2(F.concat_ws("|", F.lit("fallback"), F.col(doc_id).cast("string")), 256).alias("h"), F.col(doc_id).alias("d"), *[F.col(c).alias(c) for c in apart]).alias("s"))
    pool = some.orderBy("s.h").limit(64).agg(F.array_sort(F.collect_list("s")).alias("_pool"))
    lone = queries.select(query_id, *apart).join(found.select(query_id), query_id, "left_anti").crossJoin(F.broadcast(pool))
    fit = F.filter("_pool", lambda s: F.forall(F.array(*[s[c] != F.col(c) for c in apart]), lambda x: x) if apart else F.lit(True))
    lone = lone.withColumn("_f", fit).filter(F.size("_f") > 0)
    pick = F.get("_f", F.pmod(F.xxhash64(F.col(query_id)), F.size("_f")).cast("int"))
    return found.unionByName(lone.select(query_id, pick["d"].alias(doc_id), F.lit(0.0).alias("score")))


def unseen(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet: to resume work."""
    return rows.join(done.select(key).distinct(), key, "left_anti")


def require_all(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join that fails if a key of rows isn't in the table (null keys too)."""
    got = rows.join(table.withColumn("_hit", F.lit(True)), key, "left")
    return got.withColumn(key, F.when(F.col("_hit").isNull(), F.raise_error(F.concat(F.lit("missing key: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))).cast(dict(rows.dtypes)[key])).otherwise(F.col(key))).drop("_hit")
