import random

import pytest
from pyspark.sql import functions as F

from quillet.llm import copies, overlap
from quillet.operators import similar


def items(spark, rows):
    df = spark.createDataFrame(rows, "id bigint, question string, split string, source string")
    w = similar.hashed(overlap.words(F.col("question")))
    return df.select("id", overlap.side(F.col("split")).alias("side"), w.alias("w"), "source", F.lower(F.trim("split")).alias("split")).filter("side is not null and size(w) > 0")


def test_words_and_sides(spark):
    df = spark.createDataFrame([("The  CELL's Größe: 1.5, x​y. (GRÖSSE)", " Test "), (None, None), ("...", "other")], "q string, s string")
    got = df.select(overlap.words(F.col("q")), overlap.side(F.col("s"))).collect()
    assert got[0][0] == ["the", "cell", "s", "grösse", "1.5", "xy"] and got[0][1] == "heldout"
    assert got[1][0] is None and got[1][1] is None and got[2][0] == [] and got[2][1] is None


def test_pairs_match_brute_force(spark):
    rng = random.Random(4)
    vocabulary = [f"word{i}" for i in range(120)]
    rows = []
    for i in range(160):
        base = rng.sample(vocabulary[:40], 12) if i % 4 == 0 else rows[-1][1].lower().split()
        new = [rng.choice(vocabulary) if rng.random() < 0.1 else w for w in base]
        rows.append((i, " ".join(new).upper() if i % 3 else ", ".join(new), rng.choice(["train", " TRAIN", "dev", "test", None]), rng.choice(["a", None])))
    rows += [(900, None, "train", "a"), (901, "", "test", "a"), (902, " ".join(vocabulary * 30), "train", "a"), (903, " ".join(vocabulary), "eval", "a")]
    rows = [(i, q if q is None else q.replace(",", ""), s, c) for i, q, s, c in rows]
    members, pairs = overlap.overlaps(items(spark, rows))
    a = members.filter("side = 'train'").select(F.col("id").alias("a"), F.col("cid").alias("train_cid"))
    b = members.filter("side = 'heldout'").select(F.col("id").alias("b"), F.col("cid").alias("heldout_cid"))
    got = {(r["a"], r["b"]) for r in pairs.join(a, "train_cid").join(b, "heldout_cid").collect()}
    sets = {i: set(q.lower().split()) for i, q, *_ in rows if q}
    train = {i for i, _, s, _ in rows if s and s.strip().lower() == "train"} & set(sets)
    held = {i for i, _, s, _ in rows if s in ("dev", "test", "eval")} & set(sets)
    want = {(i, j) for i in train for j in held if len(sets[i] & sets[j]) >= 0.6 * len(sets[i] | sets[j])}
    assert got == want and (902, 903) in got


def questions(rng, n, length):
    """n questions of `length` words in train, each with a held-out copy of which some words are replaced."""
    vocabulary, rows = [f"w{i}" for i in range(5000)], []
    for i in range(n):
        words = rng.sample(vocabulary, length)
        other = list(words)
        for k in rng.sample(range(length), rng.randrange(0, length // 4 + 1)):
            other[k] = rng.choice(vocabulary)
        rows += [(2 * i, " ".join(words), "train", "a"), (2 * i + 1, " ".join(other), "test", "a")]
    return rows


@pytest.mark.parametrize("length", [1, 2, 5, 22, 40, 300, 1500])
def test_recall_of_the_blocks_at_any_length(spark, length):
    rng = random.Random(length)
    rows = questions(rng, 200, length)
    sets = {i: set(q.split()) for i, q, *_ in rows}
    want = {(i, i + 1) for i in range(0, len(rows), 2) if len(sets[i] & sets[i + 1]) >= 0.6 * len(sets[i] | sets[i + 1])}
    _, pairs = overlap.overlaps(items(spark, rows))
    got = {(r["train_cid"], r["heldout_cid"]) for r in pairs.collect()}
    named = {frozenset(s): min(i for i in sets if sets[i] == s) for s in sets.values()}
    planted = {(named[frozenset(sets[i])], named[frozenset(sets[j])]) for i, j in want}
    assert len(planted & got) >= 0.98 * len(planted)
    if length > 2:
        assert got == planted or got < planted


def test_hot_blocks_are_split_without_loss(spark, monkeypatch):
    stem = [f"stem{i}" for i in range(12)]
    rows = [(i, " ".join(stem + [f"u{i}", f"v{i}"]), "train" if i % 2 else "test", "a") for i in range(120)]
    monkeypatch.setattr(overlap, "PROBE", 1)
    monkeypatch.setattr(overlap, "HOT", 7)
    sets = overlap.word_classes(items(spark, rows))
    hot, parts = overlap._hot_blocks(sets, (1 << 40) - 1)
    assert len(hot) and max(parts) > 1
    assert overlap.similar_classes(sets).count() == 60 * 60  # 12 of 16 words in common


def test_exact_adds_what_is_missed(spark, monkeypatch):
    rng = random.Random(9)
    rows = items(spark, questions(rng, 60, 20))
    monkeypatch.setattr(overlap, "similar_classes", lambda classes: classes.filter("train > 0 and heldout > 0").selectExpr("cid as train_cid", "cid as heldout_cid"))
    assert overlap.overlaps(rows)[1].count() < 60 == overlap.overlaps(rows, exact=True)[1].count()


def test_pairs_at_the_threshold_are_all_found(spark):
    rng = random.Random(1)
    vocabulary, rows = [f"w{i}" for i in range(50_000)], []
    for i in range(1500):  # 15 of 25 words in common: similarity 0.6
        words = rng.sample(vocabulary, 25)
        rows += [(2 * i, " ".join(words[:20]), "train", "a"), (2 * i + 1, " ".join(words[:15] + words[20:]), "test", "a")]
    _, pairs = overlap.overlaps(items(spark, rows))
    assert {tuple(r) for r in pairs.select("train_cid", "heldout_cid").collect()} == {(i, i + 1) for i in range(0, 3000, 2)}
    assert overlap.blocked_classes(overlap.word_classes(items(spark, rows))).count() < 1500


def test_blocks_split_hot_blocks_without_loss(spark, monkeypatch):
    stem = [f"stem{i}" for i in range(12)]
    rows = [(i, " ".join(stem + [f"u{i}", f"v{i}"]), "train" if i % 2 else "test", "a") for i in range(120)]
    monkeypatch.setattr(overlap, "PROBE", 1)
    monkeypatch.setattr(overlap, "HOT", 7)
    assert overlap.blocked_classes(overlap.word_classes(items(spark, rows))).count() == 60 * 60


def test_a_question_of_39_words_in_one_of_65(spark):
    vocabulary = [f"word{i}" for i in range(65)]
    members, pairs = overlap.overlaps(items(spark, [(1, " ".join(vocabulary), "train", "a"), (2, " ".join(vocabulary[:39]), "test", "a")]))
    assert members.count() == 2 and pairs.count() == 1


def test_no_items(spark):
    members, pairs = overlap.overlaps(items(spark, []))
    assert members.count() == 0 and pairs.count() == 0


@pytest.mark.parametrize(
    "a, b, same",
    [
        ("It was 1.5 mm.", "it  WAS (1.5mm)!", True),
        ("It was 1.5 mm", "It was 15 mm", False),
        ("change of -1.5 K", "change of 1.5 K", False),
        ("change of −1.5 K", "change of -1.5 K", True),
        ("p < 0.05", "p > 0.05", False),
        ("p<0.05", "P < 0.05.", True),
        ("1,000 cells", "1000 cells", True),
        ("soft­hyphen zero​width", "softhyphen zerowidth", True),
        ("Straße", "STRASSE", True),
        ("well-known", "well known", True),
        ("days 3-5", "days 35", True),
        ("", " \n", True),
        ("", None, False),
        (None, None, True),
    ],
)
def test_canonical(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string").select(copies.canonical(F.col("a")).alias("a"), copies.canonical(F.col("b")).alias("b"))
    r = df.first()
    assert (r["a"] == r["b"]) is same


def test_choice_key_ignores_order_but_not_gold(spark):
    rows = [(1, "Q?", ["a", "b"], 0), (2, "q", ["B.", "A"], 1), (3, "q", ["a", "b"], 1), (4, "q", ["a", "b"], 9), (5, "q", ["a", "b"], None), (6, None, None, None), (7, None, None, 0)]
    df = spark.createDataFrame(rows, "item_id bigint, question string, options array<string>, gold int")
    key = {r["item_id"]: r["k"] for r in df.select("item_id", copies.choice_key().alias("k")).collect()}
    assert key[1] == key[2] != key[3] and key[4] == key[5] and key[6] == key[7] and len({key[1], key[3], key[4], key[6]}) == 4


@pytest.mark.parametrize("limit", [3, 10**9])
def test_collapse_hot_and_cold(spark, monkeypatch, limit):
    monkeypatch.setattr(copies, "hot_threshold", lambda rows: limit)
    rows = [(i, "hot" if i % 2 else f"k{i % 20}") for i in range(200)] + [(1, "hot")]
    members, reps = copies.collapse(spark.createDataFrame(rows, "id bigint, key string"))
    by = {}
    for i, k in rows:
        by.setdefault(k, []).append(i)
    assert {r["key"]: (r["first_id"], r["copies"]) for r in reps.collect()} == {k: (min(v), len(v)) for k, v in by.items()}
    assert members.count() == sum(len(v) for v in by.values() if len(v) > 1)
    assert copies.collapse(spark.createDataFrame([], "id bigint, key string"))[1].count() == 0
