import random

import pytest
from pyspark.sql import functions as F

from quillet.llm import pairs, pieces

Q = "To what value did the aquifer of vimlan rise after uptake with sorene?"
PASSAGE = "The aquifer of vimlan rose to 4.5 kJ after uptake with sorene because of turbulence. The authors decline to give more, as it cannot be told."


@pytest.mark.parametrize(
    "a, want",
    [
        (None, "empty"), ("", "empty"), (" ​\n", "empty"), ("N/A.", "empty"), ("<answer></answer>", "empty"), ("[no answer]", "empty"),
        ("no", None), ("4.5 kJ", None), ("It rose to 4.5 kJ after uptake with sorene", None), ("The authors decline to give more", None), ("it cannot be told", None),
        ("Il m’est impossible de donner une réponse ici", "refusal"), ("I'm sorry, but I can’t help with that request.", "refusal"), ("Désolé, je ne peux pas répondre à cette question.", "refusal"),
        (Q, "copied"), ("Question: " + Q.upper(), "copied"), ("You want to know: " + Q.replace("value", "vlaue"), "copied"), (Q + " It rose to 4.5 kJ after uptake with sorene.", None), (Q + " " + Q, "copied"), (Q.replace("with sorene", "wiht sorene"), "copied"), (Q.replace("of vimlan", "fo vimlan"), "copied"),
        ("It rose to 4.5 kJ after upt", "truncated"), ("It rose to", "truncated"), ("This was the aquifer of vim", "truncated"), ("It rose to 4.5 kJ, …", "truncated"), ("It rose (after", "truncated"), ("It rose to 4.5 kJ –", "truncated"),
        ("La reacción es más lenta que antes porque sorene bloquea la señal durante todo el proceso.", "language"), ("При добавлении это значение достигло 90 единиц.", "language"),
    ],
)
def test_defects(a, want):
    assert pairs.defect(Q, a, PASSAGE, frozenset({"because"}), pairs.refusal_automaton()) == want


@pytest.mark.parametrize(
    "a, want",
    [
        *[(a, None) for a in (
            "Fungi lack chlorophyll.", "Cocci lack flagella.", "Alkali lack protons.", "No, fungi cannot photosynthesize.", "E. coli cannot grow at 60 C.", "No.",
            "O filamento.", "El filamento del estambre.", "Das Enzym darf ich nennen: Katalase.", "Photosystem I cannot answer for the loss.", "The authors decline to answer the question.",
            "Ich nenne es Katalase.", "Apologies were not needed.", "It is impossible to tell them apart.", "Sorrel does not grow here.",
        )],
        *[(a, "refusal") for a in (
            "Unfortunately, I must decline to answer", "I’d rather not respond to that question.", "Regarding sorene: Apologies, but I can’t determine the answer.", "Regrettably, it is not possible for me to answer this",
            "As a language model, no answer can be given.", "Dazu möchte ich keine Auskunft geben", "Mir fehlen die Angaben, um das zu beantworten.", "Leider kann ich diese Frage nicht beantworten.", "Como asistente, prefiero no contestar.",
            "No dispongo de datos suficientes para responder a eso.", "Je n'ai pas assez d'éléments pour répondre.", "Não tenho dados suficientes para responder a isso.", "I'm sorry — no answer can be given by me.", "我无法回答这个问题。",
        )],
    ],
)
def test_refusals_are_clauses_not_substrings(a, want):
    assert pairs.defect(Q, a, PASSAGE, frozenset(), pairs.refusal_automaton()) in ((want,) if want else (None, "language"))


def test_nulls_repeats_and_long_texts(spark):
    long = "word " * 40_000
    rows = [(1, None, None, None, 0), (2, None, long + ".", None, 0), (3, Q, "It was lost, beca", None, 0), (3, Q, "It was lost, beca", None, 0), (4, Q, "because", PASSAGE, 0)]
    rows += [(10 + i, "why?", "because of it.", None, 0) for i in range(30)]
    df = spark.createDataFrame(rows, "rec_id bigint, q string, a string, passage string, defect int")
    assert sorted(map(tuple, pairs.broken_pairs(df).collect())) == [(1, "empty"), (3, "truncated"), (3, "truncated")]
    assert pairs.broken_pairs(df.limit(0)).count() == 0


def test_suffix_automaton_against_substrings():
    rng = random.Random(1)
    for _ in range(50):
        p = [rng.choice("abc") for _ in range(12)]
        r = [rng.choice("abc") for _ in range(15)]
        subs = {tuple(p[i:j]) for i in range(12) for j in range(i + 1, 13)}
        want = [max((n for n in range(i + 2) if n == 0 or tuple(r[i + 1 - n : i + 1]) in subs)) for i in range(15)]
        assert pairs.SuffixAutomaton(p).runs(r) == want


def sample(rng, n):
    parts = ["word ", "sentence ends. ", "line\n", "para.\n\n", "日本語。", "\U0001f600", "x" * 300, "é ", "tab\t"]
    out = ""
    while len(out) < n:
        out += rng.choice(parts)
    return out[:n]


def test_pieces_round_trip(spark):
    rng = random.Random(6)
    texts = [None, "", "short", "a" * 2400, "a" * 2401, "é" * 9000, " " * 5000, "\U0001f600" * 6001] + [sample(rng, rng.randrange(2300, 16000)) for _ in range(25)]
    df = spark.createDataFrame([(i, t, "old", 5, 5) for i, t in enumerate(texts)], "id int, t string, piece string, start int, lead int")
    got = {}
    for r in pieces.pieces(df, "t").orderBy("id", "piece_no").collect():
        got.setdefault(r["id"], []).append(r)
    assert set(got) == {i for i, t in enumerate(texts) if t and len(t) > 2400}
    for i, rows in got.items():
        assert "".join(r["piece"][r["lead"] :] for r in rows) == texts[i]
        assert [r["piece_no"] for r in rows] == list(range(len(rows)))
        for a, b in zip(rows, rows[1:]):
            assert 0 < b["lead"] <= 240 and a["piece"].endswith(b["piece"][: b["lead"]])
        for r in rows:
            assert len(r["piece"]) == r["length"] <= 2400 and texts[i][r["start"] : r["start"] + r["length"]] == r["piece"]


def test_pieces_end_at_the_strongest_boundary(spark):
    t = ("w" * 9 + " ") * 150 + "End of it. " + ("v" * 9 + " ") * 150
    r = pieces.pieces(spark.createDataFrame([(1, t)], "id int, t string"), "t").orderBy("piece_no").first()
    assert r["piece"].endswith("End of it. ")
    t = t.replace("End of it. ", "End of it.\n\n")
    assert pieces.pieces(spark.createDataFrame([(1, t)], "id int, t string"), "t").orderBy("piece_no").first()["piece"].endswith("\n\n")
    assert pieces.pieces(spark.createDataFrame([], "id int, t string"), "t").count() == 0


def test_frequent_words_are_bounded(spark):
    df = spark.range(1000).select(F.concat(F.lit("the cell w"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")).alias("a"))
    assert sorted(pairs.frequent_words(df)) == ["cell", "the"]
