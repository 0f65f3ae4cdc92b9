"""Problem 7: encoding of the whole corpus with a public byte-level BPE vocabulary.

Texts of a batch are one array of code points. A table gives each its class; the automaton of the pre-tokenisation
pattern runs as an associative scan of transition functions (all blocks at once, then their composition, then all blocks
again from their entry states); its starts are the token boundaries. Slices are merged once and kept in a cache.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Classes of characters. A: a blank right before a character that is no white space; X: other white space there;
# Q2, Q3: an apostrophe that begins a contraction of two or three characters; END: between texts.
L, N, O, W, A, X, Q2, Q3, END = range(9)
# States: what a token that holds the character before may go on with.
NEW, IN_L, IN_N, IN_O, BLANK, IN_W, ONE_MORE, TWO_MORE = range(8)


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether a token starts here), each at [state * 9 + class]."""
    go, start = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)
    for c, s in ((L, IN_L), (N, IN_N), (O, IN_O), (W, IN_W), (A, BLANK), (X, NEW), (Q2, ONE_MORE), (Q3, TWO_MORE), (END, NEW)):
        go[:, c] = s
    for c, s in ((L, IN_L), (N, IN_N), (O, IN_O), (W, IN_W)):
        start[s, c] = False
        if c != W:
            start[BLANK, c] = False
    for s in (IN_O, BLANK):
        go[s, [Q2, Q3]], start[s, [Q2, Q3]] = IN_O, False
    go[ONE_MORE, L], go[TWO_MORE, L] = NEW, ONE_MORE
    start[[ONE_MORE, TWO_MORE], L] = False
    start[:, END] = False
    return go.ravel(), start.ravel()


_GO, _START = _automaton()


def _class_table() -> np.ndarray:
    table = np.full(sys.maxunicode + 2, O, np.uint8)
    for c in range(sys.maxunicode + 1):
        k = unicodedata.category(chr(c))[0]
        if k == "L":
            table[c] = L
        elif k == "N":
            table[c] = N
    for a, b in ((9, 13), (32, 32), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[a : b + 1] = W
    table[-1] = END
    return table


_TABLE: np.ndarray | None = None
_END_POINT = sys.maxunicode + 1
BLOCK = 64


def classes(points: np.ndarray) -> np.ndarray:
    """Class of each code point; END_POINT stands after each text."""
    global _TABLE
    if _TABLE is None:
        _TABLE = _class_table()
    k = _TABLE[points]
    white = k == W
    before_text = white & ~np.concatenate([white[1:], [True]]) & ~np.concatenate([k[1:] == END, [True]])
    k[before_text & (points == 32)] = A
    k[before_text & (points != 32)] = X
    quote = np.nonzero(points[:-1] == 39)[0]
    if len(quote):
        padded = np.concatenate([points, [0, 0]])
        a, b = padded[quote + 1], padded[quote + 2]
        two = np.isin(a, [ord(c) for c in "sdmt"])
        three = ((a == ord("l")) & (b == ord("l"))) | (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")))
        k[quote[two]] = Q2
        k[quote[three]] = Q3
    return k


def token_starts(k: np.ndarray) -> np.ndarray:
    """Positions at which tokens start, by a blockwise scan of the automaton's transition functions."""
    n = len(k)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, END, np.uint8)
    grid[:n] = k
    grid = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    f = np.broadcast_to(np.arange(8, dtype=np.uint8), (blocks, 8)).copy()
    for column in grid:  # what each block makes of each state
        f = _GO[f * np.uint8(9) + column[:, None]]
    step = 1
    while step < blocks:  # prefix compositions
        f[step:] = np.take_along_axis(f[step:], f[:-step].astype(np.intp), 1)
        step *= 2
    state = np.concatenate([np.zeros(1, np.uint8), f[:-1, NEW]])
    marks = np.empty((BLOCK, blocks), bool)
    for j, column in enumerate(grid):
        at = state * np.uint8(9) + column
        marks[j] = _START[at]
        state = _GO[at]
    return np.nonzero(marks.T.ravel()[:n])[0]


class Merges(dict):
    """Token text -> ids. Kept merges: at most `limit`, then the cache starts anew."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 1_000_000) -> None:
        super().__init__()
        self.ranks, self.limit = ranks, limit

    def __missing__(self, token: str) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        ids = self[token] = self.merge(token.encode("utf-8", "replace"))
        return ids

    def merge(self, data: bytes) -> tuple[int, ...]:
        """Joins the adjacent pair of lowest rank, leftmost first, until no pair has one; a heap keeps it n log n."""
        ranks = self.ranks
        if data in ranks:
            return (ranks[data],)
        n = len(data)
        part = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, part[i] + part[i + 1]) for i in range(n - 1) if (r := ranks.get(part[i] + part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= n or part[i] + part[j] != pair:
                continue
            part[i], part[j] = pair, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
                if (r := ranks.get(pair + part[after[j]])) is not None:
                    heapq.heappush(heap, (r, i, pair + part[after[j]]))
            if before[i] >= 0 and (r := ranks.get(part[before[i]] + pair)) is not None:
                heapq.heappush(heap, (r, before[i], part[before[i]] + pair))
        return tuple(ranks[p] for p in part if p is not None)


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


def encode(texts: list[str | None], merges: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, ids of each text, token starts within their texts, tokens of each text, ids of each token)."""
    texts = [t or "" for t in texts]
    joined = "\x00".join(texts) + "\x00"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(sizes + 1) - 1
    points[ends] = _END_POINT
    starts = token_starts(classes(points))
    doc = np.searchsorted(ends, starts)
    stops = np.minimum(np.concatenate([starts[1:], [len(points)]]), ends[doc])
    lists = [merges[joined[a:b]] for a, b in zip(starts.tolist(), stops.tolist())]
    per_token = np.fromiter(map(len, lists), np.int64, len(lists))
    ids = np.fromiter(chain.from_iterable(lists), np.int32, int(per_token.sum()))
    per_text = np.bincount(doc, weights=per_token, minlength=len(texts)).astype(np.int64)
    return ids, per_text, starts - (ends[doc] - sizes[doc]), np.bincount(doc, minlength=len(texts)), per_token


PORTION = 400_000  # code points that are worked on at once, or one text


def tokenized(docs: DataFrame, id: str, text: str, vocabulary: str = VOCABULARY, offsets: bool = False) -> DataFrame:
    """(id, ids) of each row: the text's token ids without special tokens; null and empty texts give an empty list.

    offsets adds token_starts (code points at which pre-tokens start) and token_sizes (ids of each), with which ids map
    back to the text. The vocabulary file is read on the driver and broadcast (its size is fixed, under 1 MB). Repeated
    ids give repeated rows. No shuffle.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())

    def run(batches):
        merges = Merges(read_ranks(shared.value))
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars + len(texts[to] or "") <= PORTION):
                    chars += len(texts[to] or "")
                    to += 1
                ids, per_text, starts, per_doc, per_token = encode(texts[at:to], merges)
                off = lambda n: pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32))
                cols = [batch.column(0).slice(at, to - at), pa.ListArray.from_arrays(off(per_text), pa.array(ids))]
                if offsets:
                    cols += [pa.ListArray.from_arrays(off(per_doc), pa.array(x.astype(np.int32))) for x in (starts, per_token)]
                yield pa.RecordBatch.from_arrays(cols, ["id", "ids", "token_starts", "token_sizes"][: len(cols)])
                at = to

    kind = dict(docs.dtypes)[id]
    more = ", token_starts array<int>, token_sizes array<int>" if offsets else ""
    return docs.select(id, text).mapInArrow(run, f"id {kind}, ids array<int>{more}").withColumnRenamed("id", id)


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenized(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")


def p7_offsets(spark: SparkSession, d: str) -> DataFrame:
    return tokenized(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text", offsets=True)
