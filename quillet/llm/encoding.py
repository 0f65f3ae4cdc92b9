"""Problem 9: garbled text from wrong character encoding.

Characters are mapped back to the bytes of a legacy code page; an automaton over byte classes finds the maximal spans of
well-formed multibyte UTF-8 in them, and those spans only are decoded. Rounds repeat until nothing is found, so text that
was encoded many times is restored too. A second structure, the byte pairs of GBK, is looked for in the same way.

Mistakes between single-byte pages leave no byte structure. As they count too, they are told beside the automaton, and only
by a whole passage: by letter case and odd symbols within words, or by several Cyrillic words of usual letters; a lone run
of accented letters is sound text. U+FFFD marks text that is lost and can't be restored.
"""

from __future__ import annotations

import re
import unicodedata

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOST = chr(0xFFFD)
#: Code pages that UTF-8 is read with by mistake, the likeliest first. "western" is Windows-1252 with Latin-1's controls.
PAGES = ("western", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp866", "cp1250")
#: Pages whose letters are those of ordinary text, and the decoded characters that they need to be evidence there.
#: Only letters below U+0460 and common punctuation count (read as Windows-1251, Chinese too: its letters are unlike Russian).
WORDY = {"cp1251": 2, "koi8_r": 3, "cp866": 3, "cp1250": 2, "cp850": 2}
#: Single-byte mistakes (page it was read with, its own page), told by odd characters within words.
MIXED = (("mac_roman", "cp1252"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("western", "mac_roman"), ("western", "cp437"), ("western", "cp850"))
#: The same for Cyrillic, told by letter case and frequency.
CYRILLIC = (("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1251", "cp866"), ("cp866", "cp1251"), ("cp1251", "mac_cyrillic"), ("cp1251", "iso8859_5"))
WELL_FORMED = 0.75  # of a run of characters that the page has beyond ASCII


def _page(name: str) -> np.ndarray:
    """Code point -> byte (128..255), 0 where the page has none (ASCII too)."""
    table = np.zeros(0x10000, np.uint8)
    if name in ("western", "cp1251"):  # bytes that the page lacks are read as controls
        table[0x80:0xA0] = np.arange(0x80, 0xA0)
        if name == "western":
            table[0xA0:0x100] = np.arange(0xA0, 0x100)
        name = "cp1252" if name == "western" else name
    for b in range(128, 256):
        try:
            table[ord(bytes([b]).decode(name))] = b
        except UnicodeDecodeError:
            pass
    if table[0xA0] >= 0xC2:  # a blank never leads a letter
        table[0xA0] = 0
    return table


_TABLES = {p: _page(p) for p in PAGES}


def _reread(pairs) -> list[dict[int, str]]:
    """Of each pair, the character that each character would be in its own page."""
    tables = []
    for read, own in pairs:
        table = {}
        for c in np.nonzero(_TABLES[read])[0]:
            try:
                table[int(c)] = bytes([_TABLES[read][c]]).decode(own)
            except UnicodeDecodeError:
                pass
        tables.append(table)
    return tables

# Byte classes of UTF-8: 1 continuation, 2 3 4 lead of as many bytes, 0 none.
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x80:0xC0] = 1
_CLASS[0xC2:0xE0] = 2
_CLASS[0xE0:0xF0] = 3
_CLASS[0xF0:0xF5] = 4


def _sequence(page: str) -> re.Pattern:
    """A lead and a continuation byte of UTF-8 in the characters of a page: without any, a text has no span there."""
    kind = _CLASS[_TABLES[page]]
    of = lambda k: "".join(re.escape(chr(int(c))) for c in np.nonzero(k)[0])
    return re.compile(f"[{of(kind >= 2)}][{of(kind == 1)}]")


_SEQUENCE = {p: _sequence(p) for p in PAGES}


# Letters and marks of that range which legacy pages hold, so that doubly encoded text has them on its way.
_MODIFIERS = frozenset((0x192, 0x2C6, 0x2C7, *range(0x2D8, 0x2DE), 0x300, 0x301, 0x302, 0x303, 0x308))


def _assigned(text: str) -> bool:
    return not any(unicodedata.category(ch) in ("Cn", "Co", "Cs") for ch in text)


def _sane(text: str) -> bool:
    """Whether decoded characters are such as need no further proof: no private use, unassigned or rarer scripts."""
    for ch in text:
        c = ord(ch)
        if 0x180 <= c < 0x370 and c not in _MODIFIERS:
            return False
        if not (c < 0x530 or 0x590 <= c < 0x660 or 0x1E00 <= c < 0x2C00 or 0x3000 <= c < 0x3130 or 0x4E00 <= c < 0xA000 or 0xAC00 <= c < 0xD7A4 or 0xFB00 <= c < 0xFB07 or 0xFE00 <= c < 0xFE10 or 0xFEFF == c or 0xFF00 <= c < 0xFFEF or 0x1D400 <= c < 0x1D800 or 0x1F000 <= c < 0x1FB00):
            return False
    return True


def _common(text: str) -> bool:
    return all(0xA0 <= ord(ch) < 0x460 or 0x2010 <= ord(ch) < 0x2270 for ch in text)


def _common_east(text: str) -> bool:
    return all(0xA0 <= ord(ch) < 0x460 or 0x2010 <= ord(ch) < 0x2270 or 0x3000 <= ord(ch) < 0x3030 or 0x4E00 <= ord(ch) < 0xA000 or 0xFF00 <= ord(ch) < 0xFFEF for ch in text)


def utf8_spans(points: np.ndarray, page: str) -> list[tuple[int, int, str]]:
    """Maximal spans (start, end, decoded) whose characters are well-formed multibyte UTF-8 in that page."""
    inside = points < 0x10000
    data = np.where(inside, _TABLES[page][np.where(inside, points, 0)], 0)
    kind = np.concatenate([_CLASS[data], np.zeros(3, np.uint8)])
    n = len(data)
    cont = kind == 1
    c1, c2, c3 = cont[1 : n + 1], cont[2 : n + 2], cont[3 : n + 3]
    k = kind[:n]
    nxt = np.concatenate([data[1:], np.zeros(1, np.uint8)])
    ok3 = (k == 3) & c1 & c2 & ~((data == 0xE0) & (nxt < 0xA0)) & ~((data == 0xED) & (nxt > 0x9F))
    ok4 = (k == 4) & c1 & c2 & c3 & ~((data == 0xF0) & (nxt < 0x90)) & ~((data == 0xF4) & (nxt > 0x8F))
    width = np.where((k == 2) & c1, 2, 0) + np.where(ok3, 3, 0) + np.where(ok4, 4, 0)
    starts = np.nonzero(width)[0]
    if not len(starts):
        return []
    ends = starts + width[starts]
    opens = np.concatenate([[True], starts[1:] != ends[:-1]])
    closes = np.concatenate([starts[1:] != ends[:-1], [True]])
    # a run of characters beyond ASCII that is UTF-8 only here and there is other text: most of it must be well-formed
    high = data > 0
    run = np.cumsum(np.diff(high, prepend=False) & high)
    inside_span = np.zeros(n + 1, np.int64)
    np.add.at(inside_span, starts, 1)
    np.add.at(inside_span, ends, -1)
    covered = np.bincount(run[high], weights=np.cumsum(inside_span)[:n][high] > 0, minlength=int(run[-1]) + 1)
    length = np.bincount(run[high], minlength=int(run[-1]) + 1)
    whole = covered >= WELL_FORMED * np.maximum(length, 1)
    raw = data.tobytes()
    found = [(int(a), int(b), raw[a:b].decode("utf-8")) for a, b in zip(starts[opens], ends[closes]) if whole[run[a]]]
    if page in WORDY:
        fit = _common_east if page == "cp1251" else _common
        return [(a, b, t) for a, b, t in found if fit(t)]
    # other scripts: proven by a run of three, or by one within a word that a capital would not begin there
    small = lambda i: 0 <= i < n and 97 <= points[i] < 123
    proven = {ord(c) >> 7 for a, b, t in found if _assigned(t) and (len(t) >= 3 or small(a - 1) and small(b) and chr(points[a]).isupper()) for c in t}
    return [(a, b, t) for a, b, t in found if _sane(t) or _assigned(t) and all(_sane(c) or ord(c) >> 7 in proven for c in t)]


_RUN = re.compile("[\xa1-\xff\u0152\u0153\u0160\u0161\u0178\u017d\u017e\u0192\u02c6\u02dc\u2013-\u2026\u2030\u2039\u203a\u20ac\u2122\x80-\xad]{4,}")
PAIRS = 6  # byte pairs that a text needs to be Chinese, in all its runs
USUAL_PAIRS = 0.8  # of them are common characters: punctuation and the first level of the character set (rows 16 to 55)
CYRILLIC_WORDS, CYRILLIC_LETTERS = 3, 15  # that a text needs to be Cyrillic read as Western


def _western_bytes(run: str) -> bytes:
    western = _TABLES["western"]
    return bytes(int(western[ord(c)]) if ord(c) > 127 else ord(c) for c in run)


def _byte_pairs(run: str) -> tuple[str, int, int] | None:
    """A run of Western characters as byte pairs: (text, pairs, common pairs); None if they are no pairs of GBK. A byte before
    or after the pairs stays as it is."""
    data = _western_bytes(run)
    tried = []
    for lo, hi in ((0, len(data)), (1, len(data)), (0, len(data) - 1)):
        if (hi - lo) % 2:
            continue
        try:
            text = data[lo:hi].decode("gbk")
        except UnicodeDecodeError:
            continue
        leads = data[lo:hi:2]
        common = sum(0xB0 <= x <= 0xD7 or 0xA1 <= x <= 0xA3 for x in leads)
        tried.append((common, len(leads), run[:lo] + text + run[hi:]))
    if not tried:
        return None
    common, n, text = max(tried)
    return text, n, common


def _double_byte(text: str) -> str | None:
    """Chinese read as Western: decoded where most pairs of all runs are common characters, their bytes are not letters only
    (as in words of accented letters) and they are no UTF-8."""
    runs = [(m, _byte_pairs(m.group())) for m in _RUN.finditer(text)]
    read = [(m, r) for m, r in runs if r is not None]
    pairs, common = sum(r[1] for _, r in read), sum(r[2] for _, r in read)
    if pairs < PAIRS or common < USUAL_PAIRS * pairs:
        return None
    data = b"".join(_western_bytes(m.group()) for m, _ in read)
    if sum(x < 0xC0 for x in data) * 10 < len(data):
        return None
    points = np.frombuffer("\n".join(m.group() for m, _ in read).encode("utf-32-le"), np.uint32)
    if sum(b - a for a, b, _ in utf8_spans(points, "western")) >= WELL_FORMED * len(data):
        return None
    parts, at = [], 0
    for m, r in read:
        if 2 * r[2] >= r[1]:
            parts += [text[at : m.start()], r[0]]
            at = m.end()
    return "".join(parts) + text[at:]


_VOWELS = frozenset("\u0430\u0435\u0438\u043e\u0443\u044b\u044d\u044e\u044f\u0451")
_LETTER_RUN = re.compile("(?<![A-Za-z])[\xc0-\xff\xa8\xb8]+(?![A-Za-z])")


def _cyrillic_words(text: str) -> str | None:
    """Single-byte Cyrillic read as Western: CYRILLIC_WORDS different words of Western letters beyond ASCII only, which in one
    page have the case and the vowels of words and mostly the commonest letters. Short words follow the long ones."""
    words = {w for w in _LETTER_RUN.findall(text) if len(w) >= 4}
    if len(words) < CYRILLIC_WORDS or sum(map(len, words)) < CYRILLIC_LETTERS:
        return None
    best = None
    for page in ("cp1251", "koi8_r"):
        new = [_western_bytes(w).decode(page) for w in words]
        fit = [w for w in new if (w[1:].islower() or w.isupper()) and _VOWELS & set(w.lower())]
        score = _usual("".join(w.lower() for w in new))
        if len(fit) >= 0.9 * len(new) and score >= 0.5 and (best is None or score > best[0]):
            best = score, page
    if best is None:
        return None
    return _LETTER_RUN.sub(lambda m: _western_bytes(m.group()).decode(best[1]), text)


_MIXED, _CYRILLIC = _reread(MIXED), _reread(CYRILLIC)
_PART = re.compile(r".+?(?:[.!?]+(?=\s|\Z)|\n|\Z)", re.S)
# Within words: a capital beyond ASCII after a small letter, or a symbol between letters that no text has there.
_ODD = re.compile(r"(?<=[a-z\xdf-\xf6\xf8-\xff])[\xc0-\xd6\xd8-\xde\u0178\u0152\u0131]|(?<=[^\W\d_])[^\w\s\x00-\x7f\xad\xb7\xb0\xb2\xb3\xb9\xb5\u0300-\u036f\u2010-\u201d\u200b-\u200f\u2026\u2032\u2033\u2060-\u206f\ufe00-\ufe0f\ufeff\U0001f000-\U0001faff](?=[^\W\d_])|[\x80-\x9f]")
# A superset of all that repair() finds, for the JVM: what _ODD matches (letters there are of an older Unicode, so unassigned
# characters count as such), two adjacent characters beyond ASCII as all misread multibyte text has, Cyrillic, U+FFFD.
_MAYBE = (
    r"[^\x00-\x7f]{2}|\x{fffd}|[\x80-\x9f\x{400}-\x{45f}]|[a-z][\x{c0}-\x{d6}\x{d8}-\x{de}\x{178}\x{152}\x{131}]"
    r"|[\p{L}\p{N}\p{Cn}][^\p{L}\p{N}\x00-\x7f\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{ad}\x{b7}\x{b0}\x{b5}"
    r"\x{300}-\x{36f}\x{2010}-\x{201d}\x{200b}-\x{200f}\x{2026}\x{2032}\x{2033}\x{2060}-\x{206f}\x{fe00}-\x{fe0f}\x{feff}\x{1f000}-\x{1faff}][\p{L}\p{N}\p{Cn}]"
)
_CYR = re.compile("[\u0400-\u045f\u0490\u0491\u2018-\u203a\u2116\u20ac\x80-\xbf\u2500-\u25ff]+(?:[\\s,;:-]+[\u0400-\u045f\u0490\u0491\u2018-\u203a\u2116\u20ac\x80-\xbf\u2500-\u25ff]+)*")
_FREQUENT = frozenset("\u043e\u0435\u0430\u0438\u043d\u0442\u0441\u0440\u0432\u043b")  # the ten commonest Russian letters


def _usual(text: str) -> float:
    """Share of the commonest Russian letters, small ones, among the characters that are no blanks."""
    seen = [c for c in text if not c.isspace() and c not in ",;:-"]
    return sum(c in _FREQUENT for c in seen) / len(seen) if seen else 0.0


def _single_byte(text: str) -> str | None:
    """Repairs parts whose single-byte page was mistaken, sentence by sentence; None if there are none."""
    found = False

    def part(m: re.Match) -> str:
        nonlocal found
        old = m.group()
        odd = len(_ODD.findall(old))
        if not odd:
            return old
        best = min(((len(_ODD.findall(new)), k, new) for k, t in enumerate(_MIXED) if (new := old.translate(t)) != old), default=None)
        if best is None or best[0] > odd // 4:
            return old
        changed = [n for o, n in zip(old, best[2]) if o != n]
        if 2 * sum(c.isalpha() for c in changed) < len(changed):  # symbols that become other symbols are no evidence
            return old
        found = True
        return best[2]

    def cyrillic(m: re.Match) -> str:
        nonlocal found
        old = m.group()
        if len(old) < 10 or _usual(old) > 0.4:
            return old
        score, _, new = max((_usual(new), -k, new) for k, t in enumerate(_CYRILLIC) if (new := old.translate(t)))
        if score < 0.5 or _usual(old.lower()) > 0.45:
            return old
        found = True
        return new

    new = _PART.sub(part, text) if len(_ODD.findall(text)) >= 2 else text
    if re.search("[\u0400-\u045f]", new):
        new = _CYR.sub(cyrillic, new)
    return new if found else None


def repair(text: str) -> tuple[str, int, bool] | None:
    """(text, rounds of decoding, lost) for a garbled text, None for a sound one.

    lost: it still holds U+FFFD, so that part can't be restored. Null and empty texts are sound.
    """
    if not text:
        return None
    now, rounds = text, 0
    while True:  # each round leaves fewer characters
        if (new := _double_byte(now)) is not None:
            now, rounds = new, rounds + 1
            continue
        points = np.frombuffer(now.encode("utf-32-le", "surrogatepass"), np.uint32) if any(s.search(now) for s in _SEQUENCE.values()) else np.zeros(0, np.uint32)
        best: list[tuple[int, int, str]] = []
        gain = 0
        for page in PAGES:
            if not _SEQUENCE[page].search(now):
                continue
            spans = utf8_spans(points, page)
            seqs = sum(len(t) for *_, t in spans)
            cover = sum(b - a for a, b, _ in spans)
            if seqs >= WORDY.get(page, 1) and cover > gain:
                best, gain = spans, cover
        if not best:
            break
        parts, at = [], 0
        for a, b, t in best:
            parts += [now[at:a], t]
            at = b
        now = "".join(parts) + now[at:]
        rounds += 1
    if (new := _cyrillic_words(now)) is not None:
        now, rounds = new, rounds + 1
    if (new := _single_byte(now)) is not None:
        now, rounds = new, rounds + 1
    lost = LOST in now
    return (now, rounds, lost) if rounds or lost else None


def restored(docs: DataFrame, id: str, text: str) -> DataFrame:
    """Garbled records only: (id, restored, rounds, restorable).

    A filter in the JVM (_MAYBE) passes on only texts that hold anything the repair looks for; the repair runs on those in
    Arrow batches. No shuffle.
    """
    maybe = docs.filter(F.col(text).rlike(_MAYBE)).select(F.col(id).alias("id"), F.col(text).alias("text"))

    def run(frames):
        for f in frames:
            rows = [(i, *r) for i, t in zip(f["id"], f["text"]) if (r := repair(t)) is not None]
            if not rows:  # an empty column has no strings to tell its type by
                continue
            yield pd.DataFrame({"id": [r[0] for r in rows], "restored": [r[1] for r in rows], "rounds": [r[2] for r in rows], "restorable": [not r[3] for r in rows]}).astype({"rounds": "int32", "restorable": "bool"})

    kind = dict(docs.dtypes)[id]
    return maybe.mapInPandas(run, f"id {kind}, restored string, rounds int, restorable boolean").withColumnRenamed("id", id)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return restored(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text").select("doc_id")


def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    return restored(spark.read.parquet(f"{d}/documents.parquet"), "doc_id", "text")
