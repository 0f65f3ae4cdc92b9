"""Problem 6: splitting oversized items at natural boundaries.

One bounded-quantifier regular expression per item: its alternatives, the strongest boundary first, each consume up to
the body length; the last one falls back to plain characters. The overlap is a look back at the previous body. All of it
is built-in array functions: no Python, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2400, 240


def boundary_pattern(body: int) -> str:
    """Alternatives for one body of 1..body code points: end of text, paragraph, line, sentence, word, any character.

    Paragraphs, lines and sentences end a body only in its second half, so that a piece is never much shorter than it
    could be. No body splits a surrogate pair; a base character keeps its combining marks where it can.
    """
    half = body // 2
    return (
        rf"(?s)(.{{1,{body}}}\z"
        rf"|.{{{half},{body - 2}}}\n[ \t\r]*\n"
        rf"|.{{{half},{body - 1}}}\n"
        rf"|.{{{half},{body - 4}}}[.!?\x{{2026}}][\"'\x{{201d}}\x{{2019}}\x{{bb}})\]]{{0,2}}\s"
        rf"|.{{{half},{body - 1}}}[\x{{3002}}\x{{ff01}}\x{{ff1f}}\x{{ff1b}}]"
        rf"|.{{1,{body - 1}}}\s"
        rf"|.{{1,{body}}}(?!\p{{M}})"
        rf"|.{{1,{body}}})"
    )


def pieces(items: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """Items longer than limit code points -> their rows once per piece, with piece_no, start, length, lead and piece.

    piece is text[start : start+length]; its first `lead` code points repeat the end of the piece before (whole words
    of at most `overlap` code points, or exactly `overlap` where there is no blank). Pieces without their leads join to
    the text again. Null, empty and shorter texts give no rows. Clashing column names: piece_no, start, length, lead and
    piece replace the input's.
    """
    body = limit - overlap
    bodies = F.regexp_extract_all(F.col(text), F.lit(boundary_pattern(body)), F.lit(1))
    long = items.filter(F.length(text) > limit).withColumn("_bodies", bodies)

    def tail(prev: Column) -> Column:
        end = F.right(prev, F.lit(overlap))
        words = F.regexp_extract(end, r"(?s)\A\S*\s+(\S.*)\z", 1)
        return F.when(F.length(prev) <= overlap, prev).when(F.length(words) > 0, words).otherwise(end)

    starts = F.aggregate("_bodies", F.array(F.lit(0)), lambda acc, b: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(b))))
    made = F.transform("_bodies", lambda b, i: F.struct(i.alias("no"), F.when(i > 0, tail(F.get("_bodies", i - 1))).otherwise(F.lit("")).alias("lead"), b.alias("body")))
    rows = long.withColumn("_starts", starts).withColumn("_piece", F.explode(made))
    return (
        rows.withColumn("piece_no", F.col("_piece.no"))
        .withColumn("lead", F.length("_piece.lead"))
        .withColumn("start", F.get("_starts", F.col("_piece.no")) - F.col("lead"))
        .withColumn("piece", F.concat("_piece.lead", "_piece.body"))
        .withColumn("length", F.length("piece"))
        .drop("_bodies", "_starts", "_piece")
    )


def _long_items(spark: SparkSession, d: str) -> DataFrame:
    sci = spark.read.parquet(f"{d}/build_sci_decisions.parquet").select(F.lit("build_sci_decisions").alias("tab"), F.col("rec_id").alias("item_id"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("int").alias("chunk_id"), F.col("passage").alias("text"))
    art = spark.read.parquet(f"{d}/articles.parquet").select(F.lit("articles").alias("tab"), F.col("row_id").alias("item_id"), "doc_id", "chunk_id", F.col("abstract").alias("text"))
    return pieces(sci.unionByName(art), "text").drop("text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _long_items(spark, d).filter("piece_no = 0").select("tab", "item_id")


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _long_items(spark, d)
