"""Problem 8: evaluation texts leaking into training text.

Texts are compared as their letters and digits only. Blocks of held-out items of proven size are broadcast, and the
executors index the character q-grams of a block. By the q-gram lemma a passage within the edit budget keeps a number of
q-grams, less Q - 1 for each of up to INSERTED places where something was inserted; pairs of document and item that share fewer are dropped.
The rest is verified: shared stretches on one diagonal are chained in the order of both texts, so the band may jump (gaps
in the document are free, gaps in the item cost), what lies between and beyond them is aligned within the band, and
replaced words are counted.

Markup and reference marks would destroy q-grams and move diagonals, so texts and items that hold any are also compared
without them, and without anything in brackets; what is found either way counts.
"""

from __future__ import annotations

import heapq
import html
import re
import sys
import unicodedata
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillet.session import cut

Q = 12  # characters of a q-gram
WORDS = 20  # least words of a passage
REPLACED = 10  # at most one word in so many may be replaced
BAND = 48  # a diagonal that moves by more between two stretches jumps over inserted text
FAR_WORDS = 3  # whole words that both sides of a jump need
INSERTED = 3  # insertions that WORDS words may hold besides marks and what is in brackets
TRIM = 4  # letters at either end of a stretch that may agree by chance
GAP = 400  # letters of an item without any Q intact ones: more hold too many replaced words to be bridged
END = 250  # the same beyond the first and the last stretch
SLACK = 64  # letters by which replaced words may lengthen such a part
MANY = 8  # a q-gram of more items than this is left out of the index, unless an item can't do without
ENOUGH = 6  # q-grams of few items that any passage of an item must have left, so that those alone do
BLOCK_CHARS = 4_000_000  # characters of items per broadcast block; its index takes about 24 bytes each
PORTION = 600_000  # characters of documents that are worked on at once, or one text
_R = np.uint64(0x9E3779B97F4A7C15)


def _fold_table() -> np.ndarray:
    """Code point -> folded letter or digit, 0 for all else."""
    table = np.zeros(sys.maxunicode + 2, np.uint32)
    for c in range(sys.maxunicode + 1):
        ch = chr(c)
        if unicodedata.category(ch)[0] in "LN":
            low = ch.lower()
            table[c] = ord(low) if len(low) == 1 else ord(low[0])
    return table


_FOLD: np.ndarray | None = None

_NUMBERS = r"\d{1,4}[a-z]?(?:\s*[,;\u2010-\u2015-]\s*\d{1,4}[a-z]?)*"
_NAME = r"[^\W\d_][\w'\u2019-]*"
#: Tags and comments, addresses of links, citing and layout commands, reference marks in brackets and as raised digits.
_MARK = re.compile(
    r"<!--.*?-->|</?[A-Za-z][^<>]*>|(?<=\])\([^()\s]+\)|\{\{[^{}]*\}\}"
    r"|\\(?:[A-Za-z]*cite[a-z]*|ref|eqref|label|footnotemark)\*?(?:\[[^\[\]]*\])*(?:\{[^{}]*\})?"
    r"|\\(?:sub)*(?:section|paragraph)\*?|\\(?:text(?:bf|it|rm|tt|sc)?|math(?:bf|it|rm)|emph|underline|item)(?![A-Za-z])"
    rf"|\[[\s^*#]*(?:(?:refs?|note|fn|eqs?|figs?)\.?\s*)?{_NUMBERS}\s*\]|\((?:(?:see\s+)?(?:refs?|note|fn|eqs?|figs?)\.?\s*)?{_NUMBERS}\)"
    rf"|[\[(](?:{_NAME}(?:\s+et\s+al\.?|\s+(?:and|&)\s+{_NAME})?,?\s+(?:19|20)\d\d[a-z]?(?:;\s*)?)+[\])]"
    "|[\u00b2\u00b3\u00b9\u2070\u2074-\u2079]+",
    re.S | re.I,
)


_BRACKETS = re.compile(r"\([^()\[\]{}<>]*\)|\[[^()\[\]{}<>]*\]|\{[^()\[\]{}<>]*\}|<[^()\[\]{}<>]*>")


def forms(text: str) -> list[str]:
    """The text, the text without markup and reference marks, and without all that is in brackets, as far as they differ."""
    bare = html.unescape(_MARK.sub(" ", text))
    out = [text] if bare == text else [text, bare]
    found, open_ = 1, bare
    while found:  # from the inside out
        open_, found = _BRACKETS.subn(" ", open_)
    return out if open_ == bare else [*out, open_]


def letters(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(folded letters and digits of all texts, their number in each text)."""
    global _FOLD
    if _FOLD is None:
        _FOLD = _fold_table()
    points = np.frombuffer("\x00".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    folded = _FOLD[points]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    kept = np.concatenate([[0], np.cumsum(folded != 0)])
    return folded[folded != 0], np.diff(np.concatenate([[0], kept[ends]]))


def qgrams(x: np.ndarray) -> np.ndarray:
    """64-bit hashes of all q-grams (Q = 12 = 8 + 4)."""
    if len(x) < Q:
        return np.zeros(0, np.uint64)
    h = x.astype(np.uint64)
    power = np.array([_R])  # an array, so that overflow wraps silently
    for step in (1, 2):
        h = h[:-step] * power + h[step:]
        power = power * power
    four = h
    eight = four[:-4] * power + four[4:]
    return eight[: len(x) - Q + 1] * power + four[8 : 8 + len(x) - Q + 1]


@dataclass
class Index:
    ids: list
    row: list[int]  # place in ids of each item: one with marks is kept in both its forms
    text: list[np.ndarray]  # letters of each item
    word: list[np.ndarray]  # number of the word that each letter belongs to
    grams: np.ndarray  # sorted hashes
    item: np.ndarray
    at: np.ndarray
    bits: np.ndarray
    least: np.ndarray  # hits that a passage of each item surely has
    whole: np.ndarray  # the same if all its q-grams counted
    window: np.ndarray  # q-grams of its longest WORDS words
    own: dict = field(default_factory=dict)  # all q-grams of items looked at so far, sorted


def build_index(rows: list[tuple]) -> Index:
    """Index of (id, text). Words are runs of letters and digits; items under WORDS words can't be found."""
    ids, row, text, word, grams, item, at = [], [], [], [], [], [], []
    last = -1
    for n, i, t in ((n, i, form) for n, (i, t) in enumerate(rows) for form in forms(t or "")):
        words = [w for w in _words(t) if w]
        if len(words) < WORDS:
            continue
        x, sizes = letters(words)
        number = np.repeat(np.arange(len(words)), sizes)
        g = qgrams(x)
        k = len(text)
        if n != last:
            ids.append(i)
            last = n
        row.append(len(ids) - 1)
        text.append(x)
        word.append(number)
        grams.append(g)
        item.append(np.full(len(g), k, np.int32))
        at.append(np.arange(len(g), dtype=np.int32))
    if not ids:
        z = np.zeros(0, np.int32)
        return Index([], [], [], [], np.zeros(0, np.uint64), z, z, np.zeros(1 << 22, bool), z, z, z)
    g, it, p = np.concatenate(grams), np.concatenate(item), np.concatenate(at)
    _, inverse, count = np.unique(g, return_inverse=True, return_counts=True)
    rare = count[inverse] <= MANY
    window = np.zeros(len(text), np.int64)
    least, whole = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
    keep = np.zeros(len(g), bool)
    lo = 0
    for k, x in enumerate(grams):
        sel = slice(lo, lo + len(x))
        least[k], whole[k] = _surely(word[k], rare[sel]), max(1, _surely(word[k], np.ones(len(x), bool)))
        if least[k] >= ENOUGH:
            keep[sel] = rare[sel]
        else:  # too few rare q-grams: this item keeps them all
            keep[sel] = True
            least[k] = whole[k]
        begins = np.concatenate([np.searchsorted(word[k], np.arange(int(word[k][-1]) + 1)), [len(word[k])]])
        window[k] = max(1, int((begins[WORDS:] - begins[:-WORDS]).max()) - Q + 1)
        lo += len(x)
    order = np.argsort(g[keep], kind="stable")
    g, it, p = g[keep][order], it[keep][order], p[keep][order]
    bits = np.zeros(1 << 22, bool)
    bits[(g >> np.uint64(42)).astype(np.int64)] = True
    return Index(ids, row, text, word, g, it, p, bits, least, whole, window)


def _words(text: str) -> list[str]:
    """Runs of letters, digits and marks that hold a letter or digit."""
    kind = {c: unicodedata.category(c)[0] for c in set(text)}
    parts = text.translate({ord(c): " " for c, k in kind.items() if k not in "LNM"}).split()
    marks = {c for c, k in kind.items() if k == "M"}
    return [w for w in parts if not marks or any(c not in marks for c in w)]


def _surely(word: np.ndarray, useful: np.ndarray) -> int:
    """Useful q-grams that any passage of WORDS words has left after its replaced words took the most they can."""
    n, m = int(word[-1]) + 1, len(useful)
    first, last = np.searchsorted(word, np.arange(n)), np.searchsorted(word, np.arange(n), "right")
    have = np.concatenate([[0], np.cumsum(useful)])
    a = np.arange(n - WORDS + 1)
    lo = first[a]
    hi = np.maximum(lo, last[a + WORDS - 1] - Q + 1)
    w = a[:, None] + np.arange(WORDS)  # the words of each passage
    begin = np.maximum(lo[:, None], np.minimum(hi[:, None], first[w] - Q + 1))
    taken = np.sort(have[np.minimum(hi[:, None], last[w])] - have[begin], axis=1)[:, -(WORDS // REPLACED) :].sum(1)
    return int((have[np.minimum(m, hi)] - have[lo] - taken).min())


def align(a: np.ndarray, b: np.ndarray, free: bool = False) -> np.ndarray:
    """Edit alignment of two short sequences: for each letter of a, its partner in b or -1. free: the rest of b after the
    best end is left alone."""
    n, m = len(a), len(b)
    out = np.full(n, -1)
    if not n or not m:
        return out
    cost = np.empty((n + 1, m + 1), np.int32)
    cost[0] = np.arange(m + 1)
    steps = np.arange(m + 1)
    for i in range(1, n + 1):
        row = np.minimum(cost[i - 1] + 1, np.concatenate([[i], cost[i - 1][:-1] + (b != a[i - 1])]))
        row[0] = i
        cost[i] = np.minimum.accumulate(row - steps) + steps
    i, j = n, int(np.argmin(cost[n])) if free else m
    while i and j:
        if cost[i, j] == cost[i - 1, j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] == b[j]:
                out[i] = j
        elif cost[i, j] == cost[i - 1, j] + 1:
            i -= 1
        else:
            j -= 1
    return out


Stretch = tuple[int, int, int]  # first and end letter of the item, and the diagonal: document position less item position


def stretches(at: np.ndarray, pos: np.ndarray) -> list[Stretch]:
    """Hits -> maximal runs of one diagonal, in order of the document."""
    if not len(at):
        return []
    diagonal = pos - at
    order = np.lexsort((at, diagonal))
    at, diagonal = at[order], diagonal[order]
    edge = np.nonzero((np.diff(diagonal) != 0) | (np.diff(at) != 1))[0]
    first, last = np.concatenate([[0], edge + 1]), np.concatenate([edge, [len(at) - 1]])
    out = [(int(at[i]), int(at[j]) + Q, int(diagonal[i])) for i, j in zip(first, last)]
    return sorted(out, key=lambda s: (s[0] + s[2], s[0]))


def chains(runs: list[Stretch], n: int) -> list[list[Stretch]]:
    """Chains of stretches in the order of item and document, best first: letters of the item less those skipped between.

    One pass in order of the document: best[e] is the best score of a chain that ends at letter e of the item and before
    the stretch in hand, so repeated passages cost no more than their number. Every stretch is in at most one chain.
    """
    best, who = np.full(n + 1, -(1 << 40), np.int64), np.full(n + 1, -1, np.int64)
    letter = np.arange(n + 1)
    score, back = [0] * len(runs), [-1] * len(runs)
    waiting: list[tuple[int, int]] = []  # (end in the document, stretch)
    for i, (a, b, d) in enumerate(runs):
        while waiting and waiting[0][0] <= a + TRIM + d:
            _, k = heapq.heappop(waiting)
            e = runs[k][1] - TRIM
            if score[k] > best[e]:
                best[e], who[e] = score[k], k
        gain = best[: a + TRIM + 1] + letter[: a + TRIM + 1]
        e = int(np.argmax(gain))
        before = int(gain[e]) - (a + TRIM)
        score[i] = b - a - TRIM + max(0, before)
        back[i] = int(who[e]) if before > 0 else -1
        heapq.heappush(waiting, (b - TRIM + d, i))
    used, out = [False] * len(runs), []
    for i in sorted(range(len(runs)), key=lambda k: -score[k]):
        chain = []
        while i >= 0 and not used[i]:
            used[i] = True
            chain.append(runs[i])
            i = back[i]
        if chain:
            out.append(chain[::-1])
    return out


def _whole_words(pieces: list[Stretch], start: np.ndarray, stop: np.ndarray) -> int:
    return sum(max(0, int(np.searchsorted(stop, b, "right")) - int(np.searchsorted(start, a))) for a, b, _ in pieces)


def _without_strays(chain: list[Stretch], start: np.ndarray, stop: np.ndarray) -> list[Stretch]:
    """The chain without pieces of under FAR_WORDS whole words at the far side of a jump."""
    pieces = [[chain[0]]]
    for p, q in zip(chain, chain[1:]):
        if abs(q[2] - p[2]) > BAND:
            pieces.append([])
        pieces[-1].append(q)
    if len(pieces) == 1:
        return chain
    kept = [s for x in pieces if _whole_words(x, start, stop) >= FAR_WORDS for s in x]
    return kept or max(pieces, key=lambda x: _whole_words(x, start, stop))


def _intact(partner: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Words all of whose letters have partners side by side."""
    there = np.zeros(len(start), bool)
    for w in np.nonzero(partner[start] >= 0)[0]:
        s, e = start[w], stop[w]
        there[w] = bool(np.all(partner[s:e] == partner[s] + np.arange(e - s)))
    return there


def _bridge(item: np.ndarray, doc: np.ndarray, lo: int, hi: int, dlo: int, dhi: int, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Partners of item[lo:hi] in doc[dlo:dhi]; if much was inserted there, in its beginning up to some word and in its end
    from there on."""
    g, room = hi - lo, hi - lo + SLACK
    left = align(item[lo:hi], doc[dlo : min(dhi, dlo + room)], True)
    left = np.where(left >= 0, left + dlo, -1)
    right = align(item[lo:hi][::-1], doc[max(dlo, dhi - room) : dhi][::-1], True)[::-1]
    right = np.where(right >= 0, dhi - 1 - right, -1)
    inner = np.arange(np.searchsorted(start, lo), np.searchsorted(stop, hi, "right"))
    first, end = start[inner] - lo, stop[inner] - lo
    flags = [_intact(x, first, end) for x in (left, right)]
    worth = [int(flags[0][:k].sum() + flags[1][k:].sum()) for k in range(len(inner) + 1)]
    k = int(np.argmax(worth))
    cut = int(first[k]) if k < len(inner) else g
    sides = np.concatenate([left[:cut], right[cut:]])
    sides[:cut][left[:cut] >= (right[cut:][right[cut:] >= 0].min() if (right[cut:] >= 0).any() else dhi)] = -1
    if dhi - dlo > g + 2 * BAND:
        return sides
    part = align(item[lo:hi], doc[dlo:dhi])
    through = np.where(part >= 0, part + dlo, -1)
    return through if _intact(through, first, end).sum() >= _intact(sides, first, end).sum() else sides


def verified(item: np.ndarray, word: np.ndarray, doc: np.ndarray, chain: list[Stretch]) -> int:
    """Words of the longest passage that item and document share along a chain; 0 if none has WORDS words, the first and the
    last of them intact, with at most one in REPLACED replaced."""
    n = len(item)
    start = np.searchsorted(word, np.arange(int(word[-1]) + 1))
    stop = np.concatenate([start[1:], [n]])
    chain = _without_strays(chain, start, stop)
    kept: list[Stretch] = []
    for a, b, d in chain:
        while kept:
            pa, pb, pd = kept[-1]
            low = max(a, pb + pd - d)
            if low >= pb or d < pd:
                a = max(low, pb)
            else:  # both hold the letters low..pb: the later one takes them from a word's beginning on
                k = int(np.searchsorted(start, pb, "right")) - 1
                cut = int(start[k]) if start[k] >= low else pb
                kept[-1], a = (pa, cut, pd), cut
            if kept[-1][1] > kept[-1][0]:
                break
            kept.pop()
        if b > a:
            kept.append((a, b, d))
    partner = np.full(n, -1, np.int64)
    for a, b, d in kept:
        partner[a:b] = np.arange(a, b) + d
    for (_, b, d), (a2, _, d2) in zip(kept, kept[1:]):
        if 0 < a2 - b <= GAP and a2 + d2 > b + d:
            partner[b:a2] = _bridge(item, doc, b, a2, b + d, a2 + d2, start, stop)
    a, _, d = kept[0]
    if a and a + d > 0:
        lo = max(0, a - END)
        part = align(item[lo:a][::-1], doc[max(0, lo + d - SLACK) : a + d][::-1], True)[::-1]
        partner[lo:a] = np.where(part >= 0, a + d - 1 - part, -1)
    _, b, d = kept[-1]
    if b < n and b + d < len(doc):
        part = align(item[b : b + END], doc[b + d : min(n, b + END) + d + SLACK], True)
        partner[b : b + len(part)] = np.where(part >= 0, part + b + d, -1)
    return longest(_intact(partner, start, stop))


def longest(there: np.ndarray) -> int:
    """Length of the longest run of words with WORDS or more, intact ends and at most one in REPLACED not intact."""
    good = np.nonzero(there)[0]
    if len(good) < WORDS - WORDS // REPLACED:
        return 0
    # a run keeps to the budget if its intact words are at least REPLACED - 1 times the others
    balance = np.concatenate([[0], np.cumsum(np.where(there, 1, 1 - REPLACED))])
    ahead = np.maximum.accumulate(balance[good + 1][::-1])  # the best balance at any later end, seen from the last
    reach = len(good) - 1 - np.searchsorted(ahead, balance[good], "left")  # the farthest end that keeps to the budget
    length = good[np.maximum(reach, 0)] - good + 1
    fits = (reach >= 0) & (length >= WORDS)
    return int(length[fits].max()) if fits.any() else 0


def scan(texts: list[str], index: Index) -> list[tuple[int, int, int]]:
    """(number of the text, number of the item, words of the passage) for all passages in the texts."""
    both = [(d, form) for d, t in enumerate(texts) for form in forms(t)]
    best: dict[tuple[int, int], int] = {}
    for d, i, words in _passages([form for _, form in both], index):
        key = both[d][0], index.row[i]
        best[key] = max(words, best.get(key, 0))
    return [(d, i, w) for (d, i), w in best.items()]


def _passages(texts: list[str], index: Index) -> list[tuple[int, int, int]]:
    """The same for texts and items as they stand, each form on its own."""
    if not len(index.grams):
        return []
    x, sizes = letters(texts)
    g = qgrams(x)
    near = np.nonzero(index.bits[(g >> np.uint64(42)).astype(np.int64)])[0]
    if not len(near):
        return []
    lo = np.searchsorted(index.grams, g[near], "left")
    hi = np.searchsorted(index.grams, g[near], "right")
    hit = hi > lo
    near, lo, hi = near[hit], lo[hit], hi[hit]
    if not len(near):
        return []
    count = hi - lo
    entry = np.repeat(lo - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(int(count.sum()))
    pos = np.repeat(near, count)
    ends = np.cumsum(sizes)
    doc = np.searchsorted(ends, pos, "right")
    inside = pos + Q <= ends[doc]
    entry, doc = entry[inside], doc[inside]
    item, at = index.item[entry].astype(np.int64), index.at[entry].astype(np.int64)
    # places of the item that the document holds
    if not len(at):
        return []
    long = int(at.max()) + int(index.window.max()) + 2
    place = np.unique((doc * len(index.text) + item) * long + at)
    pair = place // long
    fresh = np.concatenate([[True], np.diff(pair) != 0])
    apart = np.concatenate([[True], np.diff(place) != 1])  # the last letters of a pair's item are no place, so pairs are apart
    # the most places within the letters of WORDS words of the item
    near = np.searchsorted(place, place + index.window[pair % len(index.text)]) - np.arange(len(place))
    held = np.maximum.reduceat(near, np.nonzero(fresh)[0])
    runs = np.bincount(np.cumsum(fresh) - 1, weights=apart).astype(np.int64)
    pairs = np.stack([pair[fresh] // len(index.text), pair[fresh] % len(index.text)], 1)
    begin = ends - sizes
    out = []
    hits = pairs[held + (Q - 1) * np.minimum(runs - 1, INSERTED) >= index.least[pairs[:, 1]]]
    for d, i in hits:
        text = x[begin[d] : ends[d]]
        words = _best(index, int(i), text, g[begin[d] : max(begin[d], ends[d] - Q + 1)])
        if words:
            out.append((int(d), int(i), words))
    return out


def _best(index: Index, i: int, doc: np.ndarray, grams: np.ndarray) -> int:
    """Words of the longest passage of item i in a document: hits of all its q-grams, chained and aligned."""
    if i not in index.own:
        own = qgrams(index.text[i])
        order = np.argsort(own, kind="stable")
        bits = np.zeros(1 << 14, bool)
        bits[(own >> np.uint64(50)).astype(np.int64)] = True
        index.own[i] = own[order], order, bits
    own, order, bits = index.own[i]
    maybe = np.nonzero(bits[(grams >> np.uint64(50)).astype(np.int64)])[0]
    lo, hi = np.searchsorted(own, grams[maybe], "left"), np.searchsorted(own, grams[maybe], "right")
    pos = np.repeat(maybe, hi - lo)
    step = np.arange(len(pos)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo)
    at = order[np.repeat(lo, hi - lo) + step]
    if len(at) + (Q - 1) * INSERTED < index.whole[i]:
        return 0
    best = 0
    for chain in chains(stretches(at, pos), len(index.text[i])):
        held = sum(b - a - Q + 1 for a, b, _ in chain)
        if held + (Q - 1) * min(len(chain) - 1, INSERTED) >= index.whole[i]:
            best = max(best, verified(index.text[i], index.word[i], doc, chain))
    return best


#: The index that this Python worker built last, and the block it is of.
_BUILT: tuple[str, Index] | None = None


def _index(name: str, rows: list[tuple]) -> Index:
    global _BUILT
    if _BUILT is None or _BUILT[0] != name:
        _BUILT = None
        _BUILT = name, build_index(rows)
    return _BUILT[1]


def leaks(docs: DataFrame, items: DataFrame, doc_id: str, item_id: str, text: str = "text") -> DataFrame:
    """(doc_id, item_id, words) for each document that holds a passage of an item: at least WORDS consecutive words of
    the item with at most one in REPLACED replaced; words is the longest passage's length.

    Case, punctuation, spacing, line breaks and hyphens don't count, nor markup, reference marks (_MARK) and what is in
    brackets. Other insertions of any length are bridged where FAR_WORDS whole words stand on either side, shorter ones
    (BAND letters) everywhere. Null and empty texts hold nothing; repeated ids give repeated rows.

    Items are dealt to blocks by a hash, as many as keep a block at BLOCK_CHARS characters on average; the documents are read
    once per block, without a shuffle. Only one block is on the driver at a time, as rows; workers build its index. With
    more than one block, the rows found with each are checkpointed before the next.
    """
    spark = docs.sparkSession
    kinds = dict(docs.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"doc {kinds[0]}, item {kinds[1]}, words int"
    chars = items.agg(F.sum(F.length(text))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    result = None
    for block in range(blocks):
        mine = items.filter(F.pmod(F.xxhash64(item_id, text), F.lit(blocks)) == block) if blocks > 1 else items
        shared = spark.sparkContext.broadcast([tuple(r) for r in mine.select(item_id, text).orderBy(item_id, text).collect()])
        name = uuid.uuid4().hex

        def run(frames, shared=shared, name=name):
            index = _index(name, shared.value)
            for f in frames:
                texts, at = [t or "" for t in f["text"]], 0
                while at < len(texts):
                    to, size = at, 0
                    while to < len(texts) and (to == at or size + len(texts[to]) <= PORTION):
                        size += len(texts[to])
                        to += 1
                    found = scan(texts[at:to], index)
                    yield pd.DataFrame({"doc": [f["doc"].iloc[at + d] for d, *_ in found], "item": [index.ids[i] for _, i, _ in found], "words": [w for *_, w in found]})
                    at = to

        part = docs.selectExpr(f"`{doc_id}` as doc", f"`{text}` as text").mapInPandas(run, schema)
        if blocks > 1:
            part = cut(part)
            shared.destroy()
        result = part if result is None else result.unionAll(part)
    if result is None:
        result = spark.createDataFrame([], schema)
    return result.withColumnsRenamed({"doc": doc_id, "item": item_id})


def _found(spark: SparkSession, d: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/benchmark.parquet"), "doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _found(spark, d).select("doc_id", "item_id")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """The same with the length of the longest passage."""
    return _found(spark, d)
