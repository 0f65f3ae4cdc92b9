import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from quillet.operators import retrieval
from quillet.plans import queries  # noqa: F401  registers them
from quillet.plans.registry import QUERIES

TYPES = ["definitional", "causal", "negation", None]
WORDS = ["cell", "density", "plasma", "heat", "flow", "protein", "orbit", "neutron", "enzyme-9", "lattice", "spin", "membrane"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(5)
    d = tmp_path_factory.mktemp("retrieval")
    say = lambda n: " ".join(rng.choice(WORDS) for _ in range(n))
    articles = [(i, say(2) if i % 7 else None, say(rng.randrange(3, 20)) if i % 5 else None, None) for i in range(40)] + [(40, None, None, None)]
    asked = [(i, TYPES[i % 4], f"What is the {say(1 + i % 11)}?" if i % 9 else None) for i in range(60)]
    spark.createDataFrame(articles, "row_id bigint, title string, abstract string, mesh string").write.parquet(f"{d}/articles.parquet")
    spark.createDataFrame(asked, "rec_id bigint, type string, q string").write.parquet(f"{d}/build_sci_decisions.parquet")
    return str(d), articles, asked


def terms(q):
    return list(dict.fromkeys(w for w in re.findall("[a-z0-9][a-z0-9_-]{2,}", q.lower()) if w not in retrieval.STOPWORDS))[:24]


def scorer(articles):
    docs = {i: w for i, *parts in articles if (w := re.findall("[a-z0-9]+", " ".join(p or "" for p in parts)))}
    tf = {i: Counter(w) for i, w in docs.items()}
    df = Counter(w for c in tf.values() for w in c)
    mean = sum(map(len, docs.values())) / len(docs)

    def score(asked):
        out = {}
        for i, c in tf.items():
            if any(w in c for w in asked):
                idf = {w: max(math.log((len(docs) - df[w] + 0.5) / (df[w] + 0.5)), 0) or 1e-6 for w in asked if w in c}
                out[i] = round(sum(x * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * len(docs[i]) / mean)) for w, x in idf.items()), 6)
        return out

    return tf, score


def best(scores, n=3):
    return sorted(scores, key=lambda i: (-scores[i], i))[:n]


def test_all_types_are_asked(spark, tables):
    d, articles, asked = tables
    _, score = scorer(articles)
    want = {(r, i, k + 1) for r, _, q in asked if q for k, i in enumerate(best(score(terms(q))))}
    got = {(r["rec_id"], r["row_id"], r["rank"]): r["score"] for r in QUERIES["t01_bm25_top3"](spark, d).collect()}
    assert set(got) == want and {asked[r][1] for r, *_ in got} == set(TYPES)
    assert all(math.isclose(s, score(terms(asked[r][2]))[i], abs_tol=2e-6) for (r, i, _), s in got.items())


def test_two_stages_for_all_types(spark, tables):
    d, articles, asked = tables
    tf, score = scorer(articles)
    want = set()
    for r, _, q in asked:
        by = sorted(terms(q), key=lambda w: -len(w)) if q else []
        if not by:
            continue
        first = best({i: s for i, s in score(by[:4]).items() if all(w in tf[i] for w in by[:4])})
        pairs = [by[:8][k : k + 2] for k in range(0, len(by[:8]), 2)] if len(by) > 1 else []
        more = {i: s for i, s in score(by[:8]).items() if i not in first and any(all(w in tf[i] for w in p) for p in pairs)}
        both = [(i, "and") for i in first] + ([(i, "pairs") for i in best(more)] if len(first) < 3 else [])
        want |= {(r, i, k + 1, s) for k, (i, s) in enumerate(both[:3])}
    got = {(r["rec_id"], r["row_id"], r["rank"], r["stage"]) for r in QUERIES["t02_two_stage"](spark, d).collect()}
    assert got == want and {s for *_, s in got} == {"and", "pairs"} and {asked[r][1] for r, *_ in got} == set(TYPES)


def test_evidence_for_all_types(spark, tables):
    d, articles, asked = tables
    _, score = scorer(articles)
    part = lambda i: f"Title: {articles[i][1] or ''}\n{(articles[i][2] or '')[:600]}"
    want = {r: "\n\n".join(map(part, hits))[:2400] for r, _, q in asked if q and (hits := best(score(terms(q))))}
    got = {r["rec_id"]: r["evidence"] for r in QUERIES["t03_evidence"](spark, d).collect()}
    assert got == want and {asked[r][1] for r in got} == set(TYPES)


def cut_while(monkeypatch, spark, run):
    """What run gives, how many frames it cut and the most of them that lay in the checkpoint folder at once."""
    from pathlib import Path

    from quillet.operators import blocks

    cut, seen, counts = blocks.cut, set(), []

    def counted(df):
        out = cut(df)
        root = Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:"))
        seen.update(p for p in root.glob("rdd-*") if p not in old)
        counts.append(sum(p.exists() for p in seen))
        return out

    cut(spark.range(1))  # makes the folder
    old = set(Path(spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")).glob("rdd-*"))
    monkeypatch.setattr(blocks, "cut", counted)
    return run(), len(counts), max(counts)


def test_evidence_over_many_blocks_keeps_few_states_on_disk(spark, tables, monkeypatch):
    from quillet.operators import blocks

    d, articles, asked = tables
    _, score = scorer(articles)
    part = lambda i: f"Title: {articles[i][1] or ''}\n{(articles[i][2] or '')[:600]}"
    want = {r: "\n\n".join(map(part, hits))[:2400] for r, _, q in asked if q and (hits := best(score(terms(q))))}
    monkeypatch.setattr(blocks, "BLOCK_TOKENS", 40)
    got, made, most = cut_while(monkeypatch, spark, lambda: {r["rec_id"]: r["evidence"] for r in QUERIES["t03_evidence"](spark, d).collect()})
    assert got == want
    assert made > 8 and most <= 3  # the blocks, the questions before and after one of them


def moved(spark):
    """Rows that all shuffles of this session wrote so far."""
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    none = sc._gateway.new_array(sc._jvm.double, 0)
    return sum(x.shuffleWriteRecords() for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(sc._jsc.sc().statusStore().stageList(None, False, False, none, sc._jvm.java.util.ArrayList())))


@pytest.fixture(scope="module")
def frequent(spark):
    """Questions and documents that share a few frequent terms."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    say = lambda n: " ".join(rng.choice(WORDS[:8]) for _ in range(n))
    docs = [(i, None, say(6), None) for i in range(400)]
    asked = [(i, say(4)) for i in range(400)]
    post, lengths = retrieval.postings(spark.createDataFrame([(i, b) for i, _, b, _ in docs], "id bigint, b string"), "id", F.col("b"))
    questions = spark.createDataFrame(asked, "q bigint, t string").select("q", retrieval.query_terms(F.col("t")).alias("terms"))
    return docs, asked, questions, post, lengths


@pytest.mark.parametrize("size", [10**9, 900])
def test_frequent_terms_move_no_pairs_of_questions_and_documents(spark, frequent, monkeypatch, size):
    from quillet.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_TOKENS", size)
    docs, asked, questions, post, lengths = frequent
    _, score = scorer(docs)
    before = moved(spark)
    got = {(r["q"], r["id"], r["rank"]) for r in retrieval.bm25(questions, post, lengths, "q", "id", "terms").collect()}
    assert got == {(q, i, k + 1) for q, t in asked for k, i in enumerate(best(score(terms(t))))}
    assert moved(spark) - before < 20_000  # 400 x 400 pairs, most of which share a term


@pytest.mark.parametrize("size", [10**9, 900])
def test_two_stages_move_no_pairs_of_questions_and_documents(spark, frequent, monkeypatch, size):
    from quillet.operators import blocks

    monkeypatch.setattr(blocks, "BLOCK_TOKENS", size)
    docs, asked, questions, post, lengths = frequent
    tf, score = scorer(docs)
    want = set()
    for q, t in asked:
        by = sorted(terms(t), key=lambda w: -len(w))
        first = best({i: s for i, s in score(by[:4]).items() if all(w in tf[i] for w in by[:4])})
        pairs = [by[k : k + 2] for k in range(0, len(by), 2)] if len(by) > 1 and len(first) < 3 else []
        more = best({i: s for i, s in score(by).items() if i not in first and any(all(w in tf[i] for w in p) for p in pairs)})
        want |= {(q, i, k + 1) for k, i in enumerate((first + more)[:3])}
    before = moved(spark)
    assert {(r["q"], r["id"], r["rank"]) for r in retrieval.two_stage(questions, post, lengths, "q", "id", "terms").collect()} == want
    assert moved(spark) - before < 20_000


@pytest.mark.parametrize("size", [10**9, 900])
def test_nearest_by_tfidf_moves_no_pairs_of_queries_and_documents(spark, frequent, monkeypatch, size):
    from quillet.operators import blocks, joins

    monkeypatch.setattr(blocks, "BLOCK_TOKENS", size)
    docs, asked, *_ = frequent
    group = lambda i: None if i % 11 == 0 else f"g{i % 5}"
    tf = {i: Counter(w for w in b.split() if len(w) > 3) for i, _, b, _ in docs}
    df = Counter(w for c in tf.values() for w in c)
    want = {}
    for q, t in asked:
        mine = {w for w in t.split() if len(w) > 3}
        scores = {i: round(sum(math.log(1 + len(docs) / df[w]) * c[w] for w in mine), 6) for i, c in tf.items() if mine & set(c) and group(i) and group(q) and group(i) != group(q)}
        want |= {q: best(scores, 1)[0]} if scores else {}
    d = spark.createDataFrame([(i, b, group(i)) for i, _, b, _ in docs], "doc bigint, t string, grp string")
    q = spark.createDataFrame([(i, t, group(i)) for i, t in asked], "q bigint, t string, grp string")
    before = moved(spark)
    assert {r["q"]: r["doc"] for r in joins.nearest_by_tfidf(q, d, "q", "doc", "t", apart=["grp"]).collect()} == want
    assert moved(spark) - before < 20_000


def test_written_index_gives_the_same_hits(spark, tables, tmp_path):
    from pyspark.sql import functions as F

    d, *_ = tables
    articles = spark.read.parquet(f"{d}/articles.parquet")
    body = F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("abstract", F.lit("")), F.coalesce("mesh", F.lit("")))
    retrieval.write_index(articles, "row_id", body, str(tmp_path / "ix"), 8)
    asked = spark.read.parquet(f"{d}/build_sci_decisions.parquet").filter("q is not null").select("rec_id", retrieval.query_terms(F.col("q")).alias("terms"))
    got = retrieval.bm25(asked, *retrieval.read_index(asked, str(tmp_path / "ix"), "terms", 8), "rec_id", "row_id", "terms")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, QUERIES["t01_bm25_top3"](spark, d).select(*got.columns).collect()))


def test_stop_words_of_queries(spark):
    from pyspark.sql import functions as F

    got = spark.sql("select 'Above all, which enzyme must act only through the same beta-cell very often?' as q").select(retrieval.query_terms(F.col("q"))).first()[0]
    assert got == ["enzyme", "act", "beta-cell", "often"]


@pytest.fixture
def pairs_step(spark, frequent, monkeypatch):
    """The step of two_stage for pairs of terms: (block, columns, row, places, best) -> best."""
    from pyspark.sql import functions as F

    from quillet.operators import blocks

    steps = []

    class Taken:
        def __init__(self, *_):
            pass

        def over(self, questions, step, weigh, into):
            steps.append(step)
            return questions.withColumn(into, F.array().cast("array<struct<score:double,id:bigint>>"))

        def close(self):
            pass

    monkeypatch.setattr(blocks, "Index", Taken)
    _, _, questions, post, lengths = frequent
    retrieval.two_stage(questions, post, lengths, "q", "id", "terms")
    return steps[1]


def block_of(holds, ids):
    """A block of the documents ids, holds[t] being the places of those that hold term t: each weighs 1 / their number there."""
    import pickle

    from quillet.operators import blocks

    size = [len(h) for h in holds]
    doc = np.array([d for h in holds for d in sorted(h)], np.int32)
    piece = pickle.dumps((np.arange(len(holds)), np.r_[0, np.cumsum(size)], doc, np.ones(len(doc), np.int8), np.array(ids), [1] * len(ids)))
    return blocks.Block(piece, np.array(size), lambda tf, doc, extra, df: tf / df)


def test_pairs_give_the_best_of_all_documents(pairs_step):
    rng = random.Random(3)
    for case in range(150):
        n, terms, best, scores = 60, rng.randrange(2, 9), [], {}
        had = [{"id": i} for i in range(rng.randrange(3))]
        absent = rng.randrange(8) if case % 3 == 0 else None
        for part in range(2):
            holds = [rng.sample(range(n), rng.randrange(1, [5, 55][rng.random() < 0.6])) for _ in range(terms)]
            block = block_of(holds, range(part * n, part * n + n))
            places = [-1 if t == absent else t for t in range(terms)]
            best = pairs_step(block, {"_first": [had]}, 0, np.array(places), best)
            for d in range(n):
                mine = [t >= 0 and d in holds[t] for t in places]
                if any(all(mine[k : k + 2]) for k in range(0, terms, 2)) and {"id": part * n + d} not in had:
                    scores[part * n + d] = round(sum(1 / len(holds[t]) for t in places if t >= 0 and d in holds[t]), 6)
        want = sorted(scores, key=lambda i: (-scores[i], i))[:3]
        assert [i for _, i in best] == want and all(abs(s - scores[i]) < 1e-5 for s, i in best)


def test_pairs_of_frequent_terms_are_not_looked_up_where_they_lose(pairs_step, monkeypatch):
    from quillet.operators import blocks

    held, looked = blocks.Block.held, []
    monkeypatch.setattr(blocks.Block, "held", lambda self, t, docs: looked.append(len(docs)) or held(self, t, docs))
    rare, often = range(2, 8), range(5000)
    got = pairs_step(block_of([rare, rare, often, often], range(5000)), {"_first": [[]]}, 0, np.arange(4), [])
    assert [i for _, i in got] == [2, 3, 4] and sum(looked) < 100
