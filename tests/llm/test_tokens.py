import os
import random

import numpy as np
import pytest

from quillet.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.VOCABULARY), reason="no vocabulary file")
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@pytest.fixture(scope="module")
def ranks():
    with open(tokens.VOCABULARY, "rb") as f:
        return tokens.read_ranks(f.read())


@pytest.fixture(scope="module")
def public(ranks):
    tiktoken = pytest.importorskip("tiktoken")
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_fuzz_against_the_public_library(ranks, public):
    rng = random.Random(1)
    alphabet = "absdtmlrve'' '  \n\t\xa0　" + "12é中!.'-\U0001f600́\x00\x85 ǅ²½_"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(4000)] + ["a" * 5000, " " * 3000 + "x", "'s" * 400, "don't we'll they've I'm 'tis 'S"]
    ids, per_text, *_ = tokens.encode(texts, tokens.Merges(ranks))
    at = 0
    for t, n in zip(texts, per_text):
        assert ids[at : at + n].tolist() == public.encode_ordinary(t), repr(t)
        at += n
    assert at == len(ids)


def test_cache_limit_changes_nothing(ranks, public):
    merges = tokens.Merges(ranks, limit=3)
    text = "unusual words make the cache start anew unusual words"
    assert tokens.encode([text], merges)[0].tolist() == public.encode_ordinary(text)


def test_offsets_lead_back_to_the_text(spark, ranks):
    rng = random.Random(2)
    texts = [None, "", " ", "A b\n\ncé\U0001f600 don't", "".join(rng.choice("ab c\n") for _ in range(3000))]
    df = spark.createDataFrame([(i, t, [0]) for i, t in enumerate(texts)], "doc_id int, text string, ids array<int>")
    back = {v: k for k, v in ranks.items()}
    for r in tokens.tokenized(df, "doc_id", "text", offsets=True).collect():
        t = texts[r["doc_id"]] or ""
        assert b"".join(back[i] for i in r["ids"]).decode() == t
        cuts = [*r["token_starts"], len(t)]
        at = 0
        for a, b, n in zip(cuts, cuts[1:], r["token_sizes"]):
            assert b"".join(back[i] for i in r["ids"][at : at + n]).decode() == t[a:b]
            at += n
    assert tokens.tokenized(df.limit(0), "doc_id", "text").count() == 0


def test_scan_does_not_depend_on_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    k = rng.integers(0, 6, 1000).astype(np.uint8)
    want = tokens.token_starts(k)
    for block in (1, 7, 1024):
        monkeypatch.setattr(tokens, "BLOCK", block)
        assert np.array_equal(tokens.token_starts(k), want)
