"""Problem 4: duplicates hidden by formatting differences.

Records get a canonical key. Keys with many rows are found exactly from partial counts and aggregated in two levels
over a salt; all other keys take one shuffle. The representative of a key is its smallest id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.session import cut, hot_threshold

SALTS = 32

# Marks that are not dropped: a point inside a number, a sign before a number. They are first turned into letters of
# the private use area, then everything that is no letter, mark, digit or symbol goes.
_POINT, _MINUS, _PLUS = chr(0xE000), chr(0xE001), chr(0xE002)


def canonical(c: Column) -> Column:
    """Text without white space, invisible characters, letter case and punctuation; null stays null.

    Upper case first, so that letters with several lower forms (sharp s, final sigma, micro sign) agree. Invisible are
    format and control characters and variation selectors. Punctuation is Unicode's category P and the ASCII marks
    ` ^ ~ |. Kept: . or , between digits when it is a point (a comma between digits is dropped), + - or a minus sign
    that stands before a digit and after no letter, digit or closing mark; all other symbols (< > = % and so on).
    """
    t = F.upper(c)
    t = F.regexp_replace(t, r"[\p{Cf}\x{34f}\x{115f}\x{1160}\x{17b4}\x{17b5}\x{180b}-\x{180f}\x{3164}\x{fe00}-\x{fe0f}\x{ffa0}\x{2800}\x{e0100}-\x{e01ef}]+", "")
    t = F.regexp_replace(t, r"(?<=\p{Nd})\.(?=\p{Nd})", _POINT)
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}\p{{Pe}}%\x{{b0}}])[-\x{{2212}}\x{{2010}}\x{{2011}}\x{{ff0d}}](?=\p{{Nd}}|\.\p{{Nd}}|{_POINT})", _MINUS)
    t = F.regexp_replace(t, rf"(?<![\p{{L}}\p{{N}}\p{{Pe}}%\x{{b0}}])[+](?=\p{{Nd}}|\.\p{{Nd}}|{_POINT})", _PLUS)
    t = F.regexp_replace(t, r"[\p{P}\p{Z}\p{Cc}\s`^~|\x{b4}\x{2bc}]+", "")
    return F.lower(t)


def collapse(keyed: DataFrame, rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(id, key) -> members (id, key, first_id, copies) and representatives (key, first_id, copies).

    Null keys are one key like any other; further columns of the input are left out. Works for any number of rows with one key: rows of a
    hot key (more than hot_threshold rows, so at most 1,000 keys) are counted per salt and never meet in one task.
    """
    keyed = cut(keyed.select("id", "key"))
    limit = hot_threshold(keyed.count() if rows is None else rows)
    # one shuffle of partial counts tells the hot keys exactly and is the whole result of all others
    counts = cut(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("first_id")))
    hot = F.broadcast(counts.filter(F.col("copies") > limit).select("key", F.lit(True).alias("hot")))
    tagged = keyed.join(hot, "key", "left")
    warm, cold = tagged.filter("hot").drop("hot"), tagged.filter("hot is null").drop("hot")
    salted = warm.groupBy("key", F.pmod(F.xxhash64("id"), F.lit(SALTS)).alias("salt")).agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))
    heavy = salted.groupBy("key").agg(F.min("first_id").alias("first_id"), F.sum("copies").alias("copies"))
    light = counts.filter(F.col("copies") <= limit).select("key", "first_id", "copies")
    members = warm.join(F.broadcast(heavy), "key").unionByName(cold.join(light.filter("copies > 1"), "key"))
    return members, heavy.unionByName(light)


def _key(*parts: Column) -> Column:
    """128 bits of the parts; null and empty differ."""
    return F.md5(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), p), F.lit("0")) for p in parts]))


def choice_key() -> Column:
    """Question, set of options, correct option (null if gold points nowhere)."""
    options = F.transform("options", lambda o: F.coalesce(F.concat(F.lit("="), canonical(o)), F.lit("0")))
    gold = F.when((F.col("gold") >= 0) & (F.col("gold") < F.size("options")), F.element_at("options", F.col("gold") + 1))
    return _key(canonical(F.col("question")), F.array_join(F.array_sort(F.array_distinct(options)), "\u0002"), canonical(gold))


def decision_key() -> Column:
    return _key(canonical(F.col("passage")), canonical(F.col("q")), canonical(F.col("a")))


def keyed_tables(spark: SparkSession, d: str) -> list[tuple[str, DataFrame]]:
    qa = spark.read.parquet(f"{d}/build_qa_choice.parquet").select(F.col("item_id").alias("id"), choice_key().alias("key"))
    sci = spark.read.parquet(f"{d}/build_sci_decisions.parquet").select(F.col("rec_id").alias("id"), decision_key().alias("key"))
    return [("build_qa_choice", qa), ("build_sci_decisions", sci)]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """One row for each record that is a copy of an earlier id."""
    parts = [collapse(k)[0].filter("id <> first_id").select(F.lit(tab).alias("tab"), "first_id", F.col("id").alias("copy_id")) for tab, k in keyed_tables(spark, d)]
    return parts[0].unionByName(parts[1])


def p4_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One record of each, with its number of copies."""
    parts = [collapse(k)[1].select(F.lit(tab).alias("tab"), "first_id", "copies") for tab, k in keyed_tables(spark, d)]
    return parts[0].unionByName(parts[1])
