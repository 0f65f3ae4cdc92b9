"""Problem 1: splits that keep related records together.

Records are the leaves of a graph of entities. Every record hangs on one node (its main entity); entities that span
nodes become star edges from each node to the smallest one. Alternating large-star and small-star rounds turn the
graph into stars whose centre is the smallest node of each component, and a hash of the centre picks the split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.operators.graph import group_related
from quillet.session import cut

#: Unicode white space, and the separators U+001C..1F that text tools also skip.
SPACES = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


def assign_splits(groups: DataFrame, shares: dict[str, float], seed: str = "quillet", giant: float | None = 0.005) -> DataFrame:
    """Adds `split` to (.., group_root, group_size, ..): a hash of group_root falls into ranges proportional to shares.

    A hash alone keeps shares of groups, not of records: a group with a tenth of the records falls into one range whole. So
    groups above `giant` of all records (at most 1/giant of them, so the driver may hold their list) are dealt first, the
    largest to the split that lacks most, and the ranges of all others are set to the shares that are left. With None all
    groups are hashed. Largest deviation of a split's share of the records, where a group holds a tenth of 80,000 and of
    240,000 records: 0.4 points with 0.005, 9.4 with None (2.7 and 11.9 on a tenth as many). Every group has one split.
    """
    giant = 1.0 if giant is None else giant
    total = groups.count()
    big = (
        groups.filter(F.col("group_size") > giant * max(total, 1)).groupBy("group_root").agg(F.max("group_size").alias("n"))
        .orderBy(F.desc("n"), "group_root").limit(int(1 / giant) + 1).collect()
    )
    lack = {s: share * total for s, share in shares.items()}
    given = {}
    for row in big:
        to = max(lack, key=lambda s: (lack[s], s))
        given[row["group_root"]] = to
        lack[to] -= row["n"]
    rest = {s: max(0.0, x) for s, x in lack.items()}
    whole = sum(rest.values()) or 1.0
    spot = F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(seed), "group_root"), 256), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    edge, pick = 0.0, None
    names = list(shares)
    for s in names[:-1]:
        edge += rest[s] / whole
        pick = F.when(spot < edge, s) if pick is None else pick.when(spot < edge, s)
    pick = F.lit(names[-1]) if pick is None else pick.otherwise(names[-1])
    if given:
        spark = groups.sparkSession
        table = F.broadcast(spark.createDataFrame(list(given.items()), "group_root string, _given string"))
        return groups.join(table, "group_root", "left").withColumn("split", F.coalesce("_given", pick)).drop("_given")
    return groups.withColumn("split", pick)


SHARES = {"train": 0.65, "dev": 0.15, "eval": 0.20}


def _blank_to_null(c: Column) -> Column:
    return F.when(F.length(F.regexp_replace(c, SPACES, "")) > 0, c)


def _decisions(sci: DataFrame) -> DataFrame:
    """Scientific records: main entity (source, pid), further ties document_id (unless blank) and passage (white space
    removed). A null pid names no entity; a null source counts as an empty one."""
    node = F.concat(F.coalesce("source", F.lit("")), F.lit("|"), F.col("pid"))
    return sci.select("rec_id", node.alias("main"), F.array(_blank_to_null(F.col("document_id")), F.regexp_replace("passage", SPACES, "")).alias("entities"))


def _choices(qa: DataFrame) -> DataFrame:
    """Multiple-choice items: main entity split_group, further tie (source, source_id) where neither is null."""
    key = F.concat(F.length("source"), F.lit(":"), F.col("source"), F.col("source_id"))
    return qa.select(F.col("item_id").alias("rec_id"), F.col("split_group").alias("main"), F.array(key, F.lit(None).cast("string")).alias("entities"))


def related(tables: dict[str, DataFrame]) -> DataFrame:
    """(rec_id, main, entities) of several tables -> (tab, rec_id, group_root, group_size), all tables in one graph.

    The table's number leads every name, so no tie spans tables; group_root is '0', the number and the smallest main entity,
    or '1', the number and an id.
    """
    rows = None
    for k, (tab, df) in enumerate(tables.items()):
        part = df.select(F.struct(F.lit(tab).alias("tab"), "rec_id").alias("rec"), F.lit(f"{k}").alias("k"), "main", "entities")
        rows = part if rows is None else rows.unionAll(part)
    lead = lambda c: F.concat("k", c)
    ties = [lead(F.get("entities", i)) for i in range(2)]
    groups = group_related(rows, "rec", lead(F.col("main")), ties, lead(F.lpad(F.col("rec.rec_id").cast("string"), 20, "0")))
    return groups.select("rec.tab", "rec.rec_id", "group_root", "group_size")


def _one(df: DataFrame, id: str) -> DataFrame:
    return related({"": df}).select(F.col("rec_id").alias(id), F.concat(F.substring("group_root", 1, 1), _name()).alias("group_root"), "group_size")


def related_decisions(sci: DataFrame) -> DataFrame:
    """(rec_id, group_root, group_size); group_root is '0' and the smallest source|pid, or '1' and an id."""
    return _one(_decisions(sci), "rec_id")


def related_choices(qa: DataFrame) -> DataFrame:
    """(item_id, group_root, group_size); group_root is '0' and the smallest split_group, or '1' and an id."""
    return _one(_choices(qa), "item_id")


def _both(spark: SparkSession, d: str) -> DataFrame:
    return related({"build_sci_decisions": _decisions(spark.read.parquet(f"{d}/build_sci_decisions.parquet")), "build_qa_choice": _choices(spark.read.parquet(f"{d}/build_qa_choice.parquet"))})


def _name() -> Column:
    return F.col("group_root").substr(F.lit(3), F.length("group_root"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups of two or more records; group_key is null where no record of the group has a main entity."""
    key = F.when(F.col("group_root").startswith("0"), _name())
    return _both(spark, d).filter("group_size >= 2").select("tab", "rec_id", key.alias("group_key"))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every record with its group and split; shares hold in each table."""
    groups = cut(_both(spark, d))
    parts = [assign_splits(groups.filter(F.col("tab") == tab), SHARES) for tab in ("build_sci_decisions", "build_qa_choice")]
    return parts[0].unionByName(parts[1]).select("tab", "rec_id", F.concat(F.substring("group_root", 1, 1), _name()).alias("group_id"), "group_size", "split")
