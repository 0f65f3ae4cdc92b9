import hashlib
import unicodedata

from pyspark.sql import functions as F

from quillet.functions import text


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()["y"]


def test_normal_form_and_fingerprint(spark):
    raw = "  Café  au\tlait\x1c !\n"
    want = " ".join(unicodedata.normalize("NFC", raw).split())
    assert one(spark, raw, text.normalized) == want
    assert one(spark, raw, text.fingerprint) == hashlib.sha256(want.encode()).hexdigest()
    assert one(spark, None, text.fingerprint) is None
    assert one(spark, " \t ", text.normalized) == ""


def test_numbers_by_value(spark):
    assert one(spark, "1,000.00 and -10, 1e2; x5 1.0 −3", text.numbers) == ["1E3", "-1E1", "1E2", "1E0", "-3E0"]
    assert one(spark, "", text.numbers) == []


def test_numbers_are_exact_at_any_size(spark):
    same = [("10", "1e1", "10.0", "+10", "1,0".replace(",", "")), ("0", "-0.00", "0e5"), ("0.010", "0.01", "1e-2", "10E-3"), ("123456789012345678901", "1.23456789012345678901e20")]
    for group in same:
        assert len({tuple(one(spark, x, text.numbers)) for x in group}) == 1, group
    assert one(spark, "0.1 0.10000000000000000001", text.numbers) == ["1E-1", "10000000000000000001E-20"]
    assert one(spark, "1e99999999999999999999", text.numbers) == ["1e99999999999999999999"]


def test_content_words(spark):
    assert one(spark, "The Cells of a co-culture didn't grow at 5", text.content_words) == ["cells", "co-culture", "didn't", "grow"]


def test_chunk_starts(spark):
    f = lambda n: spark.range(1).select(text.chunk_starts(F.lit(n), 350, 60).alias("s")).first()["s"]
    for n in (0, 1, 350, 351, 640, 641, 661, 930, 1500):
        assert f(n) == ([0] if n <= 350 else list(range(0, n - 60, 290))), n


def test_scrub_and_parsers(spark):
    assert one(spark, r"pre\begin{document}A $x^2$ \textbf{bold} % note" + "\n$$y$$ end", text.scrub_latex).split() == ["A", "bold", "end"]
    assert one(spark, "ctx\nQuestion: old\nQuestion: new ", text.question_tail) == "new"
    assert one(spark, "none", text.question_tail) == ""
    assert one(spark, "QUESTION:  why? ", text.question_text) == "why?"
    assert [one(spark, v, text.leading_letter) for v in (" B) yes", "Because", "", None)] == [1, -1, -1, -1]
    assert [one(spark, v, text.stated_letter) for v in ("answer: A. Later answer: C", "answer: A. Later answer: c", "(d)", "no idea", None, "Final answer (B)", "The correct answer: [C]", "answer B", "The answer is D, not A", "[a].")] == ["C", "A", "D", None, None, "B", "C", "B", "D", None]
    assert one(spark, r"5\% of \begin{tab}[h] x & y \end{tab} % gone" + "\n\\[ E = m \\] z", text.scrub_latex).split() == ["5\\%", "of", "x", "y", "z"]


def test_replace_span_counts_code_points(spark):
    df = spark.createDataFrame([("a\U0001f600bc", 1, 2)], "t string, s int, e int")
    assert df.select(text.replace_span(F.col("t"), F.col("s"), F.col("e"), F.lit("XY"))).first()[0] == "aXYbc"
