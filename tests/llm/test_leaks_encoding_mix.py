import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillet.llm import encoding, leaks, mix

WORDS = [f"{a}{b}{c}" for a in ("mor", "ves", "kal", "tin", "dro") for b in ("ane", "ulo", "irt", "osk") for c in ("x", "lin", "mera", "th")]


def item(rng, n=60):
    return [rng.choice(WORDS) for _ in range(n)]


def test_leaks_by_length_and_replacements(spark):
    rng = random.Random(8)
    items = {i: item(rng) for i in range(30)}
    filler = lambda: ["plain", "filler", "text", "number", str(rng.randrange(99))] * 5
    docs, want = [], set()

    def add(words, hits):
        docs.append((len(docs), words))
        want.update((len(docs) - 1, i) for i in hits)

    for i, w in items.items():
        add(" ".join(filler() + w + filler()), [i])
        add(" ".join(filler() + w[10:35] + filler()).upper().replace(" ", " , "), [i])
        add(" ".join(filler() + w[10:24] + filler()), [])
        holed = list(w)
        for k in range(4, 60, 12):
            holed[k] = "replacement"
        add("\n> ".join(" ".join(filler() + holed + filler()).split(" ")), [i])
        holed = list(w)
        for k in range(0, 60, 4):
            holed[k] = "changed"
        add(" ".join(holed), [])
        marked = w[:12] + ["[12]"] + w[12:30] + ["(ref. 7)"] + w[30:45]
        add(" ".join(filler() + marked), [i])
    add(" ".join(items[0] + items[1]), [0, 1])
    docs += [(1000, None), (1001, ""), (1002, "short"), (1003, " ".join(filler() * 4000 + items[2]))]
    want.add((1003, 2))
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(i, " ".join(w), 1) for i, w in items.items()] + [(500, None, 1), (501, "", 1), (502, "too short to count", 1)], "item_id bigint, text string, doc bigint")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.leaks(d, b, "doc_id", "item_id").collect()}
    assert got == want
    assert leaks.leaks(d, b.limit(0), "doc_id", "item_id").count() == 0 and leaks.leaks(d.limit(0), b, "doc_id", "item_id").count() == 0


MARKS = ["[7]", "(ref. 12)", "<i>", "</i>", "[3, 4]", "\u00b9", "&nbsp;", "(Moran et al., 2011)", '<a href="https://example.org/a/long/address/of/more/than/forty/eight/letters">']


@pytest.mark.parametrize("replaced", [0, 2])
@pytest.mark.parametrize("step", [1, 2, 3])
def test_leaks_with_many_marks(step, replaced):
    rng = random.Random(10 * step + replaced)
    items = [item(rng, 40) for _ in range(20)]
    index, found = leaks.build_index([(i, " ".join(w)) for i, w in enumerate(items)]), 0
    for i, w in enumerate(items):
        at = rng.randrange(0, 20)
        words = w[at : at + 20]
        for k in (5, 12)[:replaced]:
            words[k] = "replacement"
        marked = [x + " " + MARKS[(i + k) % len(MARKS)] if k % step == 0 else x for k, x in enumerate(words)]
        texts = [f"so it is {' '.join(x)} and so on" for x in (words, marked)]
        hits = [{n for d, n, _ in leaks.scan([t], index)} for t in texts]
        found += i in hits[0]
        assert hits[1] == hits[0]
    assert found >= 19


def test_leaks_across_one_long_tag_and_from_items_with_marks():
    w = item(random.Random(11), 24)
    tag = MARKS[-1]
    index = leaks.build_index([("a", " ".join(w)), ("short", "no"), ("b", " [4] ".join(reversed(w)))])
    assert index.ids == ["a", "b"]
    found = leaks.scan([" ".join(w[:12] + [tag] + w[12:]), " ".join(reversed(w)), " [4] ".join(reversed(w))], index)
    assert {(d, i) for d, i, _ in found} == {(0, 0), (1, 1), (2, 1)} and len(found) == 3


def test_leaks_in_blocks_of_items(spark, monkeypatch):
    rng = random.Random(9)
    items = [(i, " ".join(item(rng))) for i in range(12)]
    b = spark.createDataFrame(items, "item_id bigint, text string")
    d = spark.createDataFrame([(i, "x " + t) for i, t in items], "doc_id bigint, text string")
    monkeypatch.setattr(leaks, "BLOCK_CHARS", 800)
    got = {tuple(r)[:2] for r in leaks.leaks(d, b, "doc_id", "item_id").collect()}
    assert got == {(i, i) for i in range(12)}


@pytest.mark.parametrize("inserted", [5, 10, 14, 25, 40, 60])
@pytest.mark.parametrize("replaced", [0, 2])
def test_passages_across_inserted_text(inserted, replaced):
    rng = random.Random(inserted + replaced)
    items = [item(rng, 70) for _ in range(15)]
    index = leaks.build_index([(i, " ".join(w)) for i, w in enumerate(items)])
    strange = [f"{a}{b}" for a in ("quib", "zorp", "flan", "whim") for b in ("ble", "ter", "dock", "sy", "gan")]
    for i, w in enumerate(items):
        at, cut = rng.randrange(0, 45), rng.randrange(3, 22)
        words = w[at : at + 24]
        for k in (6, 17)[:replaced]:
            words[k] = "replacement"
        between = [rng.choice(strange) for _ in range(inserted)]
        for middle in (between, ["(see", *between, "2011)"], ["<a", 'title="', *between, '">']):
            text = " ".join(["so", "it", "is", *words[:cut], *middle, *words[cut:], "and", "so", "on"])
            assert {n for _, n, _ in leaks.scan([text], index)} == {i}, (at, cut)


def test_inserted_text_does_not_make_short_passages_long():
    rng = random.Random(3)
    items = [item(rng, 70) for _ in range(15)]
    index = leaks.build_index([(i, " ".join(w)) for i, w in enumerate(items)])
    for w in items:
        a, b = w[10:28], w[28:30]  # 18 words, and the next two elsewhere
        for text in (a + ["filler"] * 80 + b, b + ["filler"] * 80 + a, w[10:20] + ["x"] * 9 + w[40:50], w[30:40] + w[10:20], a):
            assert not leaks.scan([" ".join(text)], index)


@pytest.mark.parametrize("seed", range(8))
def test_longest_matches_brute_force(seed):
    rng = np.random.default_rng(seed)
    there = rng.random(60) < 0.9 + 0.01 * seed
    want = max((j - i + 1 for i in range(60) for j in range(i + 19, 60) if there[i] and there[j] and 10 * int((~there[i : j + 1]).sum()) <= j - i + 1), default=0)
    assert leaks.longest(there) == want


def test_repeated_passages_and_words():
    rng = random.Random(5)
    w = item(rng, 40)
    index = leaks.build_index([(0, " ".join(w)), (1, " ".join(["same"] * 50))])
    assert {n for _, n, _ in leaks.scan([" ".join((w[:15] + ["other"]) * 400)], index)} == set()
    assert {n for _, n, _ in leaks.scan([" ".join(w[:15] * 300 + w)], index)} == {0}
    assert {n for _, n, _ in leaks.scan([" ".join(["same"] * 300)], index)} == {1}


def test_items_of_common_words_only_keep_all_qgrams():
    rows = [(i, " ".join(["alpha beta gamma delta epsilon"] * 5)) for i in range(20)]
    index = leaks.build_index(rows)
    assert {i for _, i, _ in leaks.scan(["so " + rows[0][1] + " end"], index)} == set(range(20))


def test_align_is_an_edit_alignment():
    a, b = (np.array([ord(c) for c in s]) for s in ("kitten", "sitting"))
    assert leaks.align(a, b).tolist() == [-1, 1, 2, 3, -1, 5]


SOUND = [
    "The operator Â acts on Ã-type lattices; Ångström, Œuvre, Þor, ðe and ñ",
    "NÃO HÁ RELAÇÃO ENTRE a reação e o núcleo", "L’été à l’ombre : « voilà ! »", "Größe über 5 µm ± 3 °C, façade naïve",
    "Мы измерили, как скорость и плотность зависят от температуры. СССР, «АБС»", "我们测量了密度和细胞群，结果与此无关。", "one.\xa0Über-dense, a\xa0Über", "a≤b≤c, x∞y", "NFD: nĩo, café", "", "plain ascii",
]


@pytest.mark.parametrize("text", SOUND + [None])
def test_sound_texts_stay(text):
    assert encoding.repair(text) is None


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp437", "cp1251"])
@pytest.mark.parametrize("text", ["Für die Kühlung wurde die Größe über 3 Tage geprüft.", "L’énergie a été réduite à côté.", "После нагрева скорость вещества составила.", "我们测量了密度和细胞群。"])
def test_utf8_read_with_a_legacy_page(text, page):
    try:
        bad = text.encode().decode(page)
    except UnicodeDecodeError:
        bad = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in text.encode())
    now, rounds, lost = encoding.repair("Intro. " + bad)
    assert now == "Intro. " + text and rounds == 1 and not lost


def test_twice_and_thrice():
    text = "Die Häufigkeit könnte größer sein — naïve"
    for n in (2, 3, 5, 7):
        bad = text
        for _ in range(n):
            bad = bad.encode().decode("latin-1")
        assert encoding.repair(bad)[:2] == (text, n)


def test_single_byte_mistakes():
    ru = "После нагрева структура вещества осталась такой же, как у пробы."
    assert encoding.repair(ru.encode("cp1251").decode("latin-1"))[0] == ru
    assert encoding.repair(ru.encode("koi8_r").decode("cp1251"))[0] == ru
    fr = "Aucun effet n’a été observé où la température était déjà réduite après l’été."
    assert encoding.repair(fr.encode("cp1252").decode("mac_roman"))[0] == fr
    for zh in ("我们测量了密度和细胞群，结果与此无关。", "实验表明gliortene的沉积物在46.6度时保持微弱。因此，样品并不取决于vrioon，而是由细胞群决定。"):
        assert encoding.repair(zh.encode("gbk").decode("latin-1")) == (zh, 1, False)
        assert encoding.repair("Résumé à côté : " + zh.encode("gbk").decode("cp1252", "replace").replace("\ufffd", "?"))[1] >= 1


def test_lost_text_is_found_but_not_restorable(spark):
    rows = [(1, "M�me � 3 heures", "x"), (2, None, "x"), (3, "", "x"), (4, "Ã¼ber " * 30_000, "x"), (4, "sound", "x")]
    got = sorted((r["doc_id"], r["restorable"], r["rounds"]) for r in encoding.restored(spark.createDataFrame(rows, "doc_id bigint, text string, id string"), "doc_id", "text").collect())
    assert got == [(1, False, 0), (4, True, 1)]
    assert encoding.restored(spark.createDataFrame([], "doc_id bigint, text string"), "doc_id", "text").count() == 0


def test_filter_passes_on_all_that_repair_finds(spark):
    es = "La información física según el año, la producción y la región."
    fr = "Aucun effet n’a été observé où la température était déjà réduite après l’été."
    texts = [es.encode("cp437").decode("cp1252"), es.encode("cp850").decode("latin-1"), es.encode("cp1252").decode("cp437"), fr.encode("cp1252").decode("cp850", "replace"), "one\x85two three\x92s four", *SOUND]
    texts += ["Intro. " + t.encode().decode("latin-1") for t in (es, fr, "это", "हिन्दी")]
    want = {i for i, t in enumerate(texts) if encoding.repair(t) is not None}
    got = {r["doc_id"]: r["restored"] for r in encoding.restored(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert set(got) == want and {0, 1, 2} <= want and got[0] == got[1] == got[2] == es


@pytest.mark.parametrize("page", ["cp1252", "latin-1", "mac_roman", "cp437"])
@pytest.mark.parametrize("text", ["हिन्दी में यह लेख है", "ภาษาไทยเป็นภาษา", "فارسی زبان پژوهش", "მეცნიერება და ენა", "Հայերեն լեզուն"])
def test_rarer_scripts(text, page):
    bad = "".join(bytes([b]).decode(page, "ignore") or chr(b) for b in text.encode())
    assert encoding.repair("Intro. " + bad)[:2] == ("Intro. " + text, 1)


@pytest.mark.parametrize("text", ["LE CAFÉ’S, «\u202fVOILÀ\xa0»", "voilà\xa0» et là\xa0«", "GRÜß” und Ü’s"])
def test_capitals_before_quotation_marks_stay(text):
    assert encoding.repair(text) is None


TARGETS = "source string, target_share double, max_repeats int"
RECORDS = "id bigint, source string, question string, options array<string>, n int, p int"


def records(spark, sizes, nulls=0):
    rng = random.Random(3)
    rows = []
    for s, n in sizes.items():
        rows += [(s, " ".join(rng.choice([f"{s}{k}" for k in range(8)] + ["and", "of"]) for _ in range(rng.randrange(4, 20)))) for _ in range(n)]
    rows += [(None, " ".join(rng.choice([f"small{k}" for k in range(8)]) for _ in range(12))) for _ in range(nulls)]
    return spark.createDataFrame([(i, s, t, ["a", None] if i % 5 else None, 1, 1) for i, (s, t) in enumerate(rows)], RECORDS)


def test_shares_caps_absent_and_unlisted(spark):
    df = records(spark, {"big": 3000, "mid": 900, "small": 60, "unlisted": 500})
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.1, 4), ("absent", 0.1, 3)], TARGETS)
    chosen, shares = mix.mixture(df, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert got["absent"]["actual_share"] == 0 and got["absent"]["uses"] == 0
    for s, want in (("big", 0.5 / 0.9), ("mid", 0.3 / 0.9), ("small", 0.1 / 0.9)):
        assert abs(got[s]["actual_share"] - want) < 0.004 and abs(got[s]["reachable_share"] - want) < 1e-9
    most = {r["source"]: r["m"] for r in chosen.groupBy("source").agg({"uses": "max"}).withColumnRenamed("max(uses)", "m").collect()}
    assert set(most) == {"big", "mid", "small"} and most["small"] == 4 and most["big"] == 1
    assert chosen.select("id").distinct().count() == chosen.count()


def test_records_without_source_are_soft_members(spark):
    df = records(spark, {"big": 400, "small": 80}, nulls=40)
    targets = spark.createDataFrame([("big", 0.7, 1), ("small", 0.3, 2)], TARGETS)
    chosen, shares = mix.mixture(df, targets)
    assert 0 < chosen.filter("source is null").count() <= 40 and chosen.filter("source is null and uses > 1").count() == 0
    for r in shares.collect():
        assert abs(r["expected_share"] - r["target_share"]) < 0.02 and r["actual_share"] <= r["expected_share"] + 1e-9
    words = F.size(mix.text_words(F.col("question"), F.col("options")))
    used = df.select("id", words.alias("w")).join(chosen.select("id", "source", "uses"), "id").select("source", (F.col("w") * F.col("uses")).alias("s"))
    total = used.agg(F.sum("s")).first()[0]
    for r in shares.collect():
        assert abs(r["actual_share"] - used.filter(F.col("source") == r["source"]).agg(F.sum("s")).first()[0] / total) < 1e-9


def _rates(spark, members, caps, tokens, goal):
    groups = spark.createDataFrame([(list(map(float, m)), c, n) for m, c, n in zip(members, caps, tokens)], "m array<double>, cap int, n bigint")
    steps = mix.fit_rates(groups, goal)
    got = {tuple(r["m"]): r["r"] for r in groups.select("m", mix.rate(F.col("m"), F.col("cap"), steps).alias("r")).collect()}
    r = np.array([got[tuple(map(float, m))] for m in members])
    assert (r >= 0).all() and (r <= np.array(caps) + 1e-12).all()
    return r, np.array(goal) - (np.array(tokens) * r) @ np.array(members, float)


@pytest.mark.parametrize("want", [(0.6, 1.3, 0.1), (2.9, 0.2, 1.0), (0.01, 2.5, 2.0)])
def test_overlapping_memberships_against_the_closed_form(spark, want):
    members, tokens = [(0.4, 0.35, 0.25), (0.3, 0.4, 0.3), (0.3, 0.3, 0.4)], [100, 250, 70]
    goal = ((np.array(tokens) * want) @ np.array(members)).tolist()
    r, gap = _rates(spark, members, [3, 3, 3], tokens, goal)
    assert np.abs(gap).max() < 1e-6 and np.allclose(r, want, atol=1e-6)


def test_rates_where_targets_cannot_be_met_are_least_squares(spark):
    members = [(0.4, 0.35, 0.25), (0.3, 0.4, 0.3), (0.3, 0.3, 0.4)]
    r, gap = _rates(spark, members, [3, 3, 3], [100, 100, 100], [60.0, 70.0, 50.0])
    best = min(float((np.array([60, 70, 50]) - 100 * np.array(x) @ np.array(members)) @ (np.array([60, 70, 50]) - 100 * np.array(x) @ np.array(members))) for x in [(a / 200, b / 200, 0) for a in range(80, 180) for b in range(150, 300)])
    assert r[2] == 0 and float(gap @ gap) <= best + 1e-3
    pull = np.array(members) @ gap  # no pull on rates between the bounds, none upwards at zero
    assert abs(pull[0]) < 1e-3 and abs(pull[1]) < 1e-3 and pull[2] <= 1e-3


def test_many_memberships_with_caps(spark):
    rng = np.random.default_rng(4)
    members = np.round(rng.dirichlet(np.ones(5) * 0.4, 300) * 64) / 64
    members = np.unique(members, axis=0)
    tokens, caps = rng.integers(1, 500, len(members)).tolist(), rng.integers(1, 4, len(members)).tolist()
    goal = ((np.array(tokens) * rng.random(len(members)) * caps) @ members).tolist()
    _, gap = _rates(spark, members.tolist(), caps, tokens, goal)
    assert np.abs(gap).max() < 1e-6 * sum(goal)


def test_classifier_on_held_out_records(spark):
    df = records(spark, {"big": 600, "mid": 600, "small": 600})
    x = df.select("source", F.transform(mix.text_words(F.col("question"), F.col("options")), lambda t: F.pmod(F.xxhash64(t), F.lit(mix.BUCKETS))).alias("x")).toPandas()
    domains = ["big", "mid", "small"]
    train, test = x.iloc[::2].reset_index(drop=True), x.iloc[1::2].reset_index(drop=True)
    w = mix.fit_classifier(train, domains)
    rows = np.repeat(np.arange(len(test)), [len(v) for v in test["x"]])
    p = mix._softmax(mix._scores(rows, np.concatenate([np.asarray(v) for v in test["x"]]), 1 / np.sqrt(np.array([len(v) for v in test["x"]])), w, len(test)))
    assert (np.array(domains)[p.argmax(1)] == test["source"]).mean() > 0.95


def test_nothing_to_mix(spark):
    targets = spark.createDataFrame([("big", 1.0, 1)], TARGETS)
    chosen, shares = mix.mixture(records(spark, {}), targets)
    assert chosen.count() == 0 and shares.first()["actual_share"] == 0
    chosen, shares = mix.mixture(records(spark, {"big": 5}), targets.limit(0))
    assert chosen.count() == 0 and shares.count() == 0
