"""Connected groups of records by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillet.functions import text
from quillet.session import cut, hot_threshold, join_unique


def _stars(links: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges (a, b) between unequal nodes."""
    return links.filter(F.col(a) != F.col(b)).select(a, b).distinct()


def large_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node links its larger neighbours to the smallest node among itself and its neighbours."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = join_unique(both.filter("v > u"), least, "u", "n", hot_threshold(2 * rows))
    return _stars(joined.select(F.col("v").alias("a"), F.col("m").alias("b")), "a", "b")


def small_star(edges: DataFrame, rows: int) -> DataFrame:
    """Every node links itself and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    joined = join_unique(edges, least, "a", "n", hot_threshold(rows))
    links = joined.select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
    return _stars(links, "a", "b")


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) with a > b, any graph -> (node, root) for every node that has an edge; root is the smallest node.

    Each round is one large-star and one small-star, then a reliable checkpoint. It ends when a round changes nothing,
    told by count and hash of the edges. The number of rounds grows with the logarithm of the longest chain.
    """
    edges = cut(_stars(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), "a", "b"))
    state = lambda e: tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    seen = state(edges)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        edges = cut(small_star(large_star(edges, seen[0]), seen[0]))
        now = state(edges)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"no fixed point after {max_rounds} rounds")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def group_related(records: DataFrame, rec_id: str, node: Column, ties: list[Column] | Column, own: Column | None = None) -> DataFrame:
    """Connected groups of records: (rec_id, group_root, group_size).

    node: string that names the record's main entity; nulls are replaced by an entity of the record's own that sorts
    after all named ones (own, which is unique per record; the id unless given). ties: string columns of further entities;
    equal non-null values of one column tie the records; or one array column of names of entities. group_root is '0'+smallest named node of the group, by bytes, or
    '1'+own where no record of the group has a main entity. Empty input gives an empty result; repeated
    rec_ids count as separate records of one group only if they share an entity.
    """
    own = F.concat(F.lit("1"), F.lpad(F.col(rec_id).cast("string"), 20, "0") if own is None else own)
    named = F.coalesce(F.concat(F.lit("0"), node), own)
    # each key is computed once: 128 bits of the column's number and value
    names = ties if isinstance(ties, Column) else F.array(*[F.concat(F.lit(f"{k}:"), t) for k, t in enumerate(ties)])
    tie = F.transform(F.filter(names, lambda s: s.isNotNull()), lambda s: F.unhex(F.md5(s)))
    base = records.select(F.col(rec_id).alias("_id"), named.alias("node"), tie.alias("ties"))
    spans = base.select("node", F.explode("ties").alias("tie")).groupBy("tie", "node").agg(F.lit(1).alias("_one")).drop("_one")
    spans = cut(spans)
    stats = spans.groupBy("tie").agg(F.min("node").alias("b"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    rows = spans.count()
    edges = join_unique(spans, stats, "tie", "n", hot_threshold(rows)).select(F.col("node").alias("a"), "b").filter("a <> b")
    roots = components(edges)
    light = records.select(F.col(rec_id).alias("_id"), named.alias("node"))
    weights = light.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    nodes = cut(weights.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("group_root"), "n"))
    total = nodes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    sizes = nodes.groupBy("group_root").agg(F.sum("n").alias("group_size"), F.count(F.lit(1)).alias("k"))
    sized = join_unique(nodes, sizes, "group_root", "k", hot_threshold(total))
    return join_unique(light, sized, "node", "n", hot_threshold(total)).select(F.col("_id").alias(rec_id), "group_root", "group_size")


# Columns that name a document, in one namespace, and columns that name a group, in another.
DOCUMENT_KEYS = ("document_id", "doc_id", "paper_id", "corpus_id", "doi", "pmid", "pmcid")
GROUP_KEYS = ("split_group", "source_group", "group_id", "group")


def group_records(records: DataFrame, rec_id: str, content: Column, scope: str = "passage", source: str = "unknown", nested: Column | None = None) -> DataFrame:
    """Splits' groups of records: adds content_hash, group_scope and split_group (`scope:hash`), replacing such columns.

    Records are tied by equal content (normal form), any equal document id (the DOCUMENT_KEYS they have share one
    namespace), any equal group id (GROUP_KEYS, likewise), or equal pid within one source (a null source counts as `source`).
    nested: an array of (key, value, source) of ids that lie deeper, in questions or their metadata. Null and empty values
    name nothing. The scope is "document" for groups that hold any document id. The hash is that of the group's smallest
    entity, so no group's entities are gathered in one place. Ids may be of any atomic type; 5 and "5" are different ids.
    """
    have, kinds = set(records.columns), dict(records.dtypes)

    def named(space: str, c: Column, kind: str) -> Column:
        value = c.cast("string")
        shown = F.concat(F.lit('"'), value, F.lit('"')) if kind == "string" else value
        return F.when(c.isNotNull() & (value != ""), F.concat(F.lit(f"{space}="), shown))

    owner = F.coalesce(F.col("source"), F.lit(source)) if "source" in have else F.lit(source)
    documents = [named("document", F.col(k), kinds[k]) for k in DOCUMENT_KEYS if k in have]
    groups = [named("group", F.col(k), kinds[k]) for k in GROUP_KEYS if k in have]
    local = [F.when(F.col("pid").isNotNull() & (F.col("pid").cast("string") != ""), F.concat(F.lit("pid:"), owner, F.lit("="), F.col("pid").cast("string")))] if "pid" in have else []
    entities = F.array(*documents, *groups, *local, F.lit(None).cast("string"))
    if nested is not None:

        def deep(s: Column) -> Column:
            shown = F.concat(F.lit('="'), s["value"], F.lit('"'))
            return F.when((s["value"] == "") | s["value"].isNull(), None).when(s["key"].isin(*DOCUMENT_KEYS), F.concat(F.lit("document"), shown)).when(s["key"].isin(*GROUP_KEYS), F.concat(F.lit("group"), shown)).when(s["key"] == "pid", F.concat(F.lit("pid:"), F.coalesce(s["source"], owner), F.lit("="), s["value"]))

        entities = F.concat(entities, F.coalesce(F.transform(nested, deep), F.array().cast("array<string>")))
    digest = text.fingerprint(content)
    base = records.select(F.col(rec_id).alias("_id"), F.coalesce(digest, F.lit("")).alias("_c"), entities.alias("_e"))
    base = cut(base.withColumn("_d", F.exists("_e", lambda e: e.startswith("document="))))
    roots = group_related(base, "_id", F.col("_c"), F.col("_e"))
    found = cut(base.select("_id", "_c", "_d").join(roots.select("_id", "group_root"), "_id"))
    scopes = found.groupBy("group_root").agg(F.max("_d").alias("_doc"), F.count(F.lit(1)).alias("_n"))
    sized = join_unique(found, scopes, "group_root", "_n", hot_threshold(found.count()))
    named_scope = F.when(F.col("_doc"), "document").otherwise(scope)
    out = sized.select(F.col("_id").alias(rec_id), F.col("_c").alias("content_hash"), named_scope.alias("group_scope"), F.concat(named_scope, F.lit(":"), F.sha2("group_root", 256)).alias("split_group"))
    return records.drop("content_hash", "group_scope", "split_group").join(out.dropDuplicates([rec_id]), rec_id)
