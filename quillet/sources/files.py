"""Readers and writers: JSON lines, CSV, Parquet, manifests, fingerprints and vector caches."""

from __future__ import annotations

import hashlib
import io
import json

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillet.functions import text

BAD = "_bad_line"


def read_jsonl(spark: SparkSession, paths: str | list[str], schema: str | T.StructType, strict: bool = True, numbered: bool = False) -> DataFrame:
    """JSON lines with a declared schema; blank lines are skipped; `file` names the file of each row.

    strict: a line that is no JSON object of the schema fails the query, naming the file. Otherwise such lines are dropped.
    numbered: adds `line`, and errors name file:line; each file is then read by one task. Globs are allowed; a path without
    files fails.
    """
    st = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    with_bad = T.StructType([*st.fields, T.StructField(BAD, T.StringType())])
    if numbered:
        lines = numbered_lines(spark, paths)
    else:
        lines = spark.read.text(paths).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    own = ["file", "line"] if numbered else ["file"]
    lines = lines.filter(~F.col("value").rlike(r"^\s*$"))
    parsed = lines.select(*own, "value", F.from_json("value", with_bad, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}).alias("r"))
    broken = F.col("r").isNull() | F.col(f"r.{BAD}").isNotNull() | ~F.trim("value").startswith("{")
    if strict:
        place = F.concat_ws(":", *own)
        message = F.concat(F.lit("bad JSON line in "), place, F.lit(": "), F.substring("value", 1, 80))
        parsed = parsed.withColumn("file", F.when(broken, F.raise_error(message).cast("string")).otherwise(F.col("file")))
    else:
        parsed = parsed.filter(~broken)
    return parsed.select(*[F.col(f"r.{f.name}") for f in st.fields], *own)


def read_long_texts(spark: SparkSession, paths: str | list[str], field: str = "text", least: int = 200, seed: str | None = None, limit: int | None = None) -> DataFrame:
    """Texts of at least `least` characters from JSON lines; bad lines are skipped. seed: in the order of a hash; limit: only
    the first so many of them."""
    rows = read_jsonl(spark, paths, f"`{field}` string", strict=False).filter(F.length(field) >= least)
    if seed is not None:
        rows = rows.orderBy(F.sha2(F.concat_ws("|", F.lit(seed), "file", field), 256))
    return rows.limit(limit) if limit is not None else rows


def read_csv(spark: SparkSession, paths: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header; quoted fields may hold commas, doubled quotes and line ends. All strings without a schema."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"')
    return (r.schema(schema) if schema else r).csv(paths)


def read_pairs(spark: SparkSession, directory: str, limit: int | None = None) -> DataFrame:
    """Files pairs_L0.jsonl .. pairs_L3.jsonl of (ctx, ok, bad) id lists, with their level; rows need two or more ids of
    context and non-empty ok and bad. limit cuts each list."""
    df = read_jsonl(spark, f"{directory}/pairs_L[0-3].jsonl", "ctx array<int>, ok array<int>, bad array<int>")
    df = df.withColumn("level", F.regexp_extract("file", r"pairs_L(\d)\.jsonl", 1).cast("int")).drop("file")
    df = df.filter("size(ctx) >= 2 and size(ok) > 0 and size(bad) > 0")
    return df.withColumns({c: F.slice(c, 1, limit) for c in ("ctx", "ok", "bad")}) if limit else df


def read_decisions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Encoded decisions (ctx, opts, gold, kind, option_keys, encoding, qid, split_group, source) from JSON lines; a row that
    is no valid decision fails the query, naming its file and why."""
    df = read_jsonl(spark, paths, "ctx array<int>, opts array<array<int>>, gold int, kind string, option_keys array<string>, encoding string, qid string, split_group string, source string")
    ctx, opts, gold = F.col("ctx"), F.col("opts"), F.col("gold")
    why = F.when(ctx.isNull() | (F.size(ctx) == 0), "empty_context").when(opts.isNull() | (F.size(opts) < 2), "too_few_options").when(F.exists(opts, lambda o: o.isNull() | (F.size(o) == 0)), "empty_option")
    why = why.when(F.size(F.array_distinct(opts)) < F.size(opts), "repeated_option").when(gold.isNull() | (gold < 0) | (gold >= F.size(opts)), "gold_out_of_range")
    bad = F.raise_error(F.concat(F.lit("bad decision in "), F.col("file"), F.lit(": "), why)).cast("int")
    return df.withColumn("gold", F.when(why.isNotNull(), bad).otherwise(gold))


def explode_requests(df: DataFrame, questions: str = "questions", labelled_only: bool = True) -> DataFrame:
    """One row per question of a map of questions: qid, question; only those with a label, if asked."""
    out = df.select(*[c for c in df.columns if c != questions], F.explode(F.map_entries(questions)).alias("_e")).select("*", F.col("_e.key").alias("qid"), F.col("_e.value").alias("question")).drop("_e")
    return out.filter(F.col("question.label").isNotNull()) if labelled_only else out


def first_filled(*cols: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*[F.when(F.length(c) > 0, c) for c in cols])


def _open(path: str):
    fs, at = pafs.FileSystem.from_uri(path)
    return fs.open_input_stream(at)


def _paths(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path) of all files of paths, globs and directories, also empty ones, but for hidden ones; a path without files
    fails. The driver lists names, as every scan does; they are spread over as many tasks."""
    found, path = set(), spark._jvm.org.apache.hadoop.fs.Path
    for p in [paths] if isinstance(paths, str) else paths:
        fs = path(p).getFileSystem(spark._jsc.hadoopConfiguration())
        before = len(found)
        for top in fs.globStatus(path(p)) or []:
            each = fs.listFiles(top.getPath(), True)
            while each.hasNext():
                f = each.next().getPath()
                if not f.getName().startswith(("_", ".")):
                    found.add(f.toString())
        if len(found) == before:
            raise FileNotFoundError(f"no files: {p}")
    return spark.createDataFrame([(f,) for f in sorted(found)], "path string").repartition(max(1, min(len(found), 10_000)), "path")


def file_fingerprints(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, bytes, sha256) of files, distinct; each is hashed as a stream by the task that reads it, so files may be of
    any size."""

    def run(frames):
        for f in frames:
            rows = []
            for path in f["path"]:
                digest, size = hashlib.sha256(), 0
                with _open(path) as stream:
                    while chunk := stream.read(1 << 20):
                        digest.update(chunk)
                        size += len(chunk)
                rows.append((path, size, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["path", "bytes", "sha256"])

    return _paths(spark, paths).mapInPandas(run, "path string, bytes bigint, sha256 string").orderBy("path")


def numbered_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, value) of text files with line numbers from 1; each file is streamed by one task."""

    def run(frames):
        for f in frames:
            for path in f["path"]:
                rows, n = [], 0
                with _open(path) as stream:
                    for raw in io.BufferedReader(stream):
                        n += 1
                        rows.append((path, n, raw.decode("utf-8").rstrip("\r\n")))
                        if len(rows) == 10_000:
                            yield pd.DataFrame(rows, columns=["file", "line", "value"])
                            rows = []
                yield pd.DataFrame(rows, columns=["file", "line", "value"]).astype({"line": "int64"})

    return _paths(spark, paths).mapInPandas(run, "file string, line bigint, value string")


def write_dataset(outputs: dict[str, DataFrame], directory: str, excluded: DataFrame | None = None, about: dict | None = None) -> dict:
    """Writes each output as JSON lines into directory/name and a manifest; refuses to overwrite anything.

    The manifest holds rows per output (observed while it is written), the digest of each of its files, exclusions by reason
    (a group-by; reasons are a fixed vocabulary) and `about`.
    """
    spark = next(iter(outputs.values())).sparkSession
    rows, files = {}, {}
    for name, df in outputs.items():
        seen = Observation(name)
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("errorifexists").json(f"{directory}/{name}")
        rows[name] = seen.get["n"]
        parts = file_fingerprints(spark, f"{directory}/{name}/part-*").collect()
        files[name] = {r["path"].rsplit("/", 1)[1]: r["sha256"] for r in parts}
    by = {r["reason"]: r["count"] for r in excluded.filter("reason is not null").groupBy("reason").count().collect()} if excluded is not None else {}
    manifest = {**(about or {}), "rows": rows, "outputs": files, "exclusions_by_reason": dict(sorted(by.items()))}
    line = spark.createDataFrame([(json.dumps(manifest, ensure_ascii=False, sort_keys=True),)], "value string")
    line.coalesce(1).write.mode("errorifexists").text(f"{directory}/manifest")
    return manifest


def merge_caches(parts: list[DataFrame], key: str = "key", vector: str = "vec") -> DataFrame:
    """Union of vector caches; a key with two different vectors fails the query."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    got = union.groupBy(key).agg(F.min(vector).alias(vector), F.max(vector).alias("_hi"))
    clash = F.raise_error(F.concat(F.lit("conflicting vectors for "), F.col(key).cast("string"))).cast(dict(union.dtypes)[key])
    return got.withColumn(key, F.when(~F.col(vector).eqNullSafe(F.col("_hi")), clash).otherwise(F.col(key))).drop("_hi")


def sequence_key(ids: Column) -> Column:
    """SHA-256 of a list of ids written as [1, 2, 3]."""
    return F.sha2(F.concat(F.lit("["), F.array_join(ids.cast("array<string>"), ", "), F.lit("]")), 256)


def text_columns(spark: SparkSession, prefer: tuple[str, ...] = ("pubmed", "article")) -> tuple[str, str, str]:
    """The catalogue's table whose name holds most of `prefer` (ties: the last by name), and its title and body columns:
    `title` or the first, `abstract` or the last."""
    tables = [x.name for x in spark.catalog.listTables()]
    if not tables:
        raise ValueError("no table")
    best = max(tables, key=lambda n: (sum(p in n.lower() for p in prefer), n))
    cols = [c.name for c in spark.catalog.listColumns(best)]
    low = [c.lower() for c in cols]
    return best, cols[low.index("title")] if "title" in low else cols[0], cols[low.index("abstract")] if "abstract" in low else cols[-1]


def corpus_record(df: DataFrame) -> DataFrame:
    """id, title, body and tags of corpus rows whose fields go by several names; absent columns are skipped."""
    have = set(df.columns)
    pick = lambda *names: first_filled(*[F.col(n).cast("string") for n in names if n in have], F.lit(None).cast("string"))
    lists = {n for n, k in df.dtypes if k.startswith("array")}
    tags = [F.array_join(n, "|") if n in lists else F.col(n) for n in ("tags", "categories", "domain") if n in have]
    return df.select(pick("id", "doc_id", "key").alias("id"), pick("title").alias("title"), pick("text", "abstract").alias("body"), (first_filled(*tags) if tags else F.lit(None).cast("string")).alias("tags"))


def normalized_key(c: Column) -> Column:
    """Fingerprint that joins texts which differ only in white space and composition."""
    return text.fingerprint(c)
