"""Chunking, inverted index, BM25, two-stage retrieval and recall."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import text
from quillet.operators import blocks

FEW = 500  # documents of which all terms are looked up at once

# Words that a query leaves out.
STOPWORDS = (
    "a an the and or of to in is are was were be been for on at by with that this these those which what when where who whom how why not no "
    "it its he she they we you i do does did have has had can could will would should may might must shall from as if then than so such into "
    "about between through during before after above below up down out over under again further once each other some any all both few more "
    "most only own same very just also"
).split()


def chunk(df: DataFrame, id: str, body: str, size: int = 350, overlap: int = 60, least: int = 80) -> DataFrame:
    """Documents -> chunks (id, chunk_id, chunk) of `size` words, each repeating `overlap` words of the one before.

    Chunks of under `least` words are left out, and of equal chunks of a document all but the first. One pass and one
    aggregate by (id, chunk); no Python.
    """
    w = df.select(id, text.words(F.col(body)).alias("_w")).filter(F.size("_w") >= least)
    parts = w.select(id, "_w", F.posexplode(text.chunk_starts(F.size("_w"), size, overlap)).alias("chunk_id", "_s"))
    made = parts.select(id, "chunk_id", F.slice("_w", F.col("_s") + 1, F.lit(size)).alias("_c")).filter(F.size("_c") >= least)
    return made.select(id, "chunk_id", F.array_join("_c", " ").alias("chunk")).groupBy(id, "chunk").agg(F.min("chunk_id").alias("chunk_id")).select(id, "chunk_id", "chunk")


def postings(docs: DataFrame, id: str, body: Column) -> tuple[DataFrame, DataFrame]:
    """(term, id, tf, len) and (id, len); terms are lower-case runs of letters and digits. Empty documents have no rows.
    One row of docs per id; it is counted where it lies, without a shuffle."""
    w = docs.select(id, F.regexp_extract_all(F.lower(body), F.lit("([a-z0-9]+)"), F.lit(1)).alias("_w")).filter(F.size("_w") > 0)

    def count(batches):
        for b in batches:
            lists = b.column("_w")
            words = lists.flatten().dictionary_encode()
            size = np.diff(lists.offsets.to_numpy())
            n = len(words.dictionary)
            key, tf = np.unique(np.repeat(np.arange(len(size)), size) * n + words.indices.to_numpy(), return_counts=True)
            row = key // n
            yield pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(key - row * n)), b.column(id).take(pa.array(row)), pa.array(size[row].astype(np.int32)), pa.array(tf)], ["term", id, "len", "tf"])

    kind = docs.select(id).schema[0].dataType.simpleString()
    return w.mapInArrow(count, f"term string, `{id}` {kind}, len int, tf bigint"), w.select(id, F.size("_w").alias("len"))


def write_index(docs: DataFrame, id: str, body: Column, path: str, buckets: int = 64) -> None:
    """Writes postings partitioned by a hash of the term, and lengths; an existing index is never overwritten."""
    post, lengths = postings(docs, id, body)
    post.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("term").write.partitionBy("bucket").mode("errorifexists").parquet(f"{path}/postings")
    lengths.write.mode("errorifexists").parquet(f"{path}/lengths")


def read_index(queries: DataFrame, path: str, terms: str, buckets: int = 64) -> tuple[DataFrame, DataFrame]:
    """Postings and lengths of write_index; of the postings only the buckets of asked terms are read (their numbers, at most
    `buckets`, are told first, so the scan is pruned to those folders)."""
    spark = queries.sparkSession
    asked = queries.select(F.explode(terms).alias("term")).select(F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("b")).distinct()
    numbers = [r["b"] for r in asked.collect()]
    return spark.read.parquet(f"{path}/postings").filter(F.col("bucket").isin(numbers)).drop("bucket"), spark.read.parquet(f"{path}/lengths")


def query_terms(c: Column, most: int = 24) -> Column:
    """Distinct terms of three or more characters without stop-words, in order, at most `most`."""
    found = F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9][a-z0-9_-]{2,})"), F.lit(1))
    return F.slice(F.filter(F.array_distinct(found), lambda t: ~t.isin(STOPWORDS)), 1, most)


def _bm25_weight(lengths: DataFrame, k1: float = 1.2, b: float = 0.75):
    """What a posting adds to a document's BM25 score, and the tokens of all documents. idf = ln((N - n + 0.5) / (n + 0.5)),
    1e-6 where that is not positive."""
    n, mean, total = lengths.agg(F.count(F.lit(1)), F.avg("len"), F.coalesce(F.sum("len"), F.lit(0))).first()

    def weigh(tf, doc, extra, df):
        raw = np.log((n - df + 0.5) / (df + 0.5))
        idf, length = np.where(raw > 0, raw, 1e-6), np.array(extra, np.float64)
        return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[doc] / mean))

    return weigh, total


def bm25(queries: DataFrame, post: DataFrame, lengths: DataFrame, query_id: str, id: str, terms: str, top: int = 3) -> DataFrame:
    """The `top` documents per query by BM25: (query_id, id, score, rank), ties by smaller id.

    Exact, and no query is joined with postings: queries pass the blocks of the index of asked terms (see blocks). post may
    come from read_index, which reads the buckets of asked terms only.
    """
    weigh, tokens = _bm25_weight(lengths)
    asked = queries.select(query_id, F.array_distinct(terms).alias("_t"))
    index = blocks.Index(post, asked.select(F.explode("_t").alias("term")), id, F.col("len"), tokens)
    each = blocks.spread(asked.filter(F.size("_t") > 0).select(query_id, _hashes(F.col("_t")).alias("terms")), query_id)
    each = each.groupBy(query_id).agg(F.flatten(F.collect_list("terms")).alias("terms"))  # rows of one id are one query
    found = index.over(each, lambda block, columns, i, places, best: block.any_of(places[places >= 0].tolist(), best, top), weigh, "_best")
    index.close()
    return blocks.ranked(found, query_id, "_best", id)


def _hashes(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def _pairs(block: blocks.Block, places: np.ndarray, best: list, had: list, top: int) -> list:
    """The best documents that hold both terms of a pair (0 and 1, 2 and 3, ..; a last single term is a pair of its own), by
    the sum of all terms' weights, together with `best` of other blocks; those in `had` are left out.

    Terms by falling largest weight. What a term's documents give is found with all they hold, so later terms only need
    pairs without the terms so far; it ends without such a pair, or when what is left stays below the top-th score.
    """
    here = [t for t in places.tolist() if t >= 0]
    pairs = [p for k in range(0, len(places), 2) if min(p := places[k : k + 2].tolist()) >= 0]
    order = sorted(here, key=lambda t: -block.most[t])
    left = sum(block.most[t] for t in here)
    for t in order:
        theta = best[top - 1][0] - blocks.SLACK if len(best) >= top else 0.0
        if not pairs or left < theta:
            break
        left -= block.most[t]
        docs = block.docs(t)
        if theta > left:
            docs = docs[block.w[block.start[t] : block.start[t + 1]] >= theta - left]
        others = [[x for x in p if x != t] for p in pairs]
        if len(docs) > FEW and all(others):  # of many documents, first those of a pair
            docs = np.unique(np.concatenate([block.all_of(o, docs) for o in others]))
        if len(docs):
            held = {x: block.held(x, docs) for x in here}
            ok = np.logical_or.reduce([np.logical_and.reduce([held[x][0] for x in p]) for p in pairs])
            if had:
                ok &= ~np.isin(block.ids[docs], had)
            if ok.any():
                best = blocks.merged(best, block.top(docs[ok], sum(held[x][1] for x in here)[ok], top), top)
        pairs = [p for p in pairs if t not in p]
    return best


def two_stage(queries: DataFrame, post: DataFrame, lengths: DataFrame, query_id: str, id: str, terms: str, top: int = 3) -> DataFrame:
    """Documents that hold all of a query's four longest terms, by BM25 of those; queries with fewer than `top` are filled
    up with documents that hold both terms of one of the four pairs among the eight longest: (.., score, rank, stage).

    Length order is stable. Queries pass the blocks of the index of asked terms twice (see blocks); a conjunction starts from
    the postings of its rarest term and looks the others up, so frequent terms' postings are never joined with queries.
    """
    by = F.transform(F.array_sort(F.transform(terms, lambda t, i: F.struct((-F.length(t)).alias("n"), i.alias("i"), t.alias("t")))), lambda s: s["t"])
    q = queries.select(query_id, F.slice(by, 1, 8).alias("_r")).filter(F.size("_r") > 0)
    weigh, tokens = _bm25_weight(lengths)
    index = blocks.Index(post, q.select(F.explode("_r").alias("term")), id, F.col("len"), tokens)

    def both(block, columns, i, places, best):
        four = places[:4]
        if (four < 0).any():
            return best
        docs = block.all_of(four.tolist())
        return blocks.merged(best, block.top(docs, block.scores(four.tolist(), docs), top), top) if len(docs) else best

    def pairs(block, columns, i, places, best):
        first = columns["_first"][i]
        return best if len(first) >= top or len(places) < 2 else _pairs(block, places, best, [x["id"] for x in first], top)

    each = blocks.spread(q.select(query_id, _hashes(F.col("_r")).alias("terms")), query_id)
    found = index.over(index.over(each, both, weigh, "_first"), pairs, weigh, "_more")
    index.close()
    named = lambda c, stage: F.transform(c, lambda s: F.struct(s["score"].alias("score"), s["id"].alias("id"), F.lit(stage).alias("stage")))
    rows = found.select(query_id, F.posexplode(F.slice(F.concat(named("_first", "and"), named("_more", "pairs")), 1, top)).alias("_p", "_s"))
    return rows.select(query_id, F.col("_s.id").alias(id), F.col("_s.score").alias("score"), F.col("_s.stage").alias("stage"), (F.col("_p") + 1).alias("rank"))


def evidence(hits: DataFrame, docs: DataFrame, query_id: str, id: str, title: str, body: str, per_doc: int = 600, limit: int = 2400) -> DataFrame:
    """Evidence text per query: `Title: ..` and the body's first per_doc characters, hits in order of rank, cut at limit."""
    part = F.concat(F.lit("Title: "), F.coalesce(F.trim(title), F.lit("")), F.lit("\n"), F.substring(F.trim(F.coalesce(body, F.lit(""))), 1, per_doc))
    rows = hits.join(docs.select(id, part.alias("_p")), id)
    return rows.groupBy(query_id).agg(F.substring(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "_p"))), lambda s: s["_p"]), "\n\n"), 1, limit).alias("evidence"))


def recall(df: DataFrame, score: str, gold: str, ks=(1, 4, 8)) -> DataFrame:
    """(scores array, gold index) per row: rank = 1 + entries above the gold's; n, MRR and recall at each k."""
    rank = 1 + F.size(F.filter(score, lambda x: x > F.get(score, F.col(gold))))
    r = df.select(rank.alias("_r"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.avg(1 / F.col("_r")).alias("mrr"), *[F.avg((F.col("_r") <= k).cast("double")).alias(f"recall_{k}") for k in ks])
