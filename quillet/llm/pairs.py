"""Problem 5: broken prompt and response pairs.

One pass in Arrow batches per record: a suffix automaton of the prompt measures how much of the response is copied, an
Aho-Corasick automaton finds refusals, a stack finds delimiters left open, and stop-words of each language vote. A
last word that is cut short is told from the words of question, passage and all responses.
"""

from __future__ import annotations

import re
import unicodedata

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# What a refusal is made of, in plain lower case with plain apostrophes; | is the beginning of a clause.
# own: the responder speaks of itself; not: it can't, won't or lacks what it needs; act: answering. own-not is both.
CLUES = {
    "own-not": """
| i cannot;| i can't;| i can not;| i could not;| i couldn't;| i won't;| i will not;| i don't;| i do not;| i decline;| i lack;| i must decline;| i have to decline
| i am unable;| i'm unable;| i am not;| i'm not;| i'd rather not;| i would rather not;| i prefer not;| i'd prefer not;| i refuse;| i have no;| i wouldn't
no puedo;no me es posible;prefiero no;me es imposible;me resulta imposible;no tengo;no dispongo;me faltan;me falta;no estoy en condiciones;me temo que no;debo declinar;no deseo;no quiero;debo negarme
je ne peux;je préfère ne;je n'ai pas;je ne dispose;m'est impossible;ne m'est pas possible;je ne suis pas;je ne souhaite;il me manque;je dois décliner;je refuse;je ne saurais;je préférerais ne
não posso;não me é possível;é-me impossível;me é impossível;não disponho;prefiro não;não tenho;faltam-me;me faltam;não consigo;devo recusar;não desejo;não quero
mir fehlen;mir fehlt;ich bedaure
""",
    "own": "for me;by me;ich;mir",
    "not": "not;no;cannot;impossible;unable;nicht;kein;keine;keinen;keinerlei;ablehnen;unmöglich",
    "act": """
answer;answers;answering;respond;responding;response;reply;replying;comment;help;assist;request;question;information;advise;say
responder;responderla;responderlo;contestar;contestarla;respuesta;pregunta;ayudar;opinar;información;comentar
répondre;réponse;question;aider;demande;renseigner
antworten;beantworten;antwort;frage;auskunft;helfen;anfrage;äußern
resposta;pergunta;ajudar;informação;informações
""",
    "role": "| a language assistant |;| a language model |;| an ai |;| an ai model |;| an assistant |;| an ai assistant |;| como asistente;| en tant qu'assistant;| als assistent;| como assistente",
    "sorry": "| i'm sorry;| i am sorry;| i apologize;| i apologise;| sorry |;| my apologies;| apologies |;| lo siento;| désolé;| je suis désolé;| desculpe;| desculpa;| sinto muito;| lamento |;| es tut mir leid;| tut mir leid",
}
# The same for scripts without the above, a denial and an act that must both be there.
OTHER_SCRIPTS = (("не могу", ("ответить", "помочь")), ("我无法", ("回答", "提供", "帮助")), ("我不能", ("回答", "提供", "帮助")), ("抱歉", ("无法", "不能")))

# Frequent words of each language; a word in several lists votes for each.
STOPWORDS = {
    "en": "the of and to in is was that it for with as at by from on this be are were has had not which no only what why how did does do could can while although because an its their than through so them have been one between after before during",
    "es": "el la los las de del que y en un una es se por con para no su al lo más según texto durante todo fue como pero porque cuando donde hasta entre después antes esta este está son sus hay qué cuál cómo también en",
    "fr": "le la les de des du et en un une est se par avec pour ne pas que qui dans au aux sur ce cette il elle sont plus parce pendant toute selon désigne était après où quelle quel pourquoi comment à sa son ses leur",
    "de": "der die das den dem des und in ein eine einen einer ist nicht mit von zu auf für im sich es sie er nach der während ganzen gesamten weil war wurde diesem text was warum welchen wie bei zum zur aus auch durch wird keine",
    "pt": "o a os as de do da dos das e em um uma é se por com para não que no na ao à mais segundo texto durante todo foi como mas porque quando onde até entre após antes esta este está são seu sua há qual neste nesta pela pelo também",
}

# Words after which no sentence ends.
OPEN_WORDS = frozenset(
    """the a an of to in with at by from on and or but because although while that which through for into as its their than is was were are
    after before under between no not only if when where could would should
    el la los las de del con por para que y o en un una su al porque hasta desde entre según más es fue
    le les des du avec par pour qui et ou dans au aux un une l d qu parce entre vers était est à
    der die das den dem des mit von und oder weil in im ein eine einen nach zu zur zum für bei ist war wird dass
    o os as do da dos das com por para que e ou em um uma no na pelo pela ao porque até entre foi se é""".split()
)

# What stands for no answer, once brackets, quotes, tags and marks around it are gone.
PLACEHOLDERS = frozenset(
    [
        "n/a", "na", "n.a", "none", "null", "nil", "nan", "undefined", "tbd", "todo", "empty", "blank", "missing", "answer", "response",
        "no answer", "no response", "not available", "not applicable", "sin respuesta", "respuesta", "sans réponse", "réponse",
        "keine antwort", "antwort", "sem resposta", "resposta",
    ]
)

_WORD = re.compile(r"[+-]?\d+(?:[.,]\d+)*|[^\W\d_]+(?:['-][^\W\d_]+)*")
_TAG = re.compile(r"</?[a-z][^<>]*>", re.I)
_CLOSERS = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}
_WRAPPER = frozenset("question q you asked ask asks the is was my answer a regarding about prompt pregunta frage questão pergunta repeat repeated here again query want know wants wondering".split())
_TAIL_MARKS = ("…", "...", "..", "(", "[", "{", ",", ":", ";", "–", "—", "-", "/", "…", "&", "=", "+")


def tidy(text: str) -> str:
    """One line: no invisible characters, plain apostrophes, single blanks."""
    text = "".join(c for c in text if unicodedata.category(c) != "Cf").replace("’", "'").replace("ʼ", "'")
    return " ".join(text.split())


_CLAUSES = re.compile(r"[.!?;:,\u2013\u2014()\"\u201c\u201d]+| - ")
# Words before which a clause ends.
_CONJUNCTIONS = frozenset("but and so because as since that unfortunately regrettably therefore however".split())
_SENTENCES = re.compile(r"(?<=[.!?])\s+")


def refusal_automaton() -> ahocorasick.Automaton:
    """Of all clues, each with its kind; they match whole words only."""
    a = ahocorasick.Automaton()
    for kind, clues in CLUES.items():
        for c in clues.replace("\n", ";").split(";"):
            if c.strip():
                key = f" {c.strip()} "
                a.add_word(key, a.get(key, ()) + ((kind, key),))
    a.make_automaton()
    return a


def refuses(low: str, automaton: ahocorasick.Automaton) -> bool:
    """Whether a response (one line, lower case) declines to answer: some sentence denies the responder's own ability or will
    to answer, or one apologises or speaks in a role and denies anything."""
    said = set()
    for sentence in _SENTENCES.split(low):
        words = [w if w not in _CONJUNCTIONS else "|" for w in _CLAUSES.sub(" | ", sentence).split()]
        kinds = {k for _, found in automaton.iter(f" | {' '.join(words)} | ") for k, _ in found}
        if "own-not" in kinds:
            kinds |= {"own", "not"}
        if {"own", "not", "act"} <= kinds or "role" in kinds and ("not" in kinds or "act" in kinds):
            return True
        said |= kinds
    if "sorry" in said and "not" in said:
        return True
    return any(x in low and any(y in low for y in ys) for x, ys in OTHER_SCRIPTS)


_STOP: dict[str, list[str]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in set(_words.split()):
        _STOP.setdefault(_w, []).append(_lang)
# Letters that only one of the languages has.
_LETTERS = {"ñ": "es", "¿": "es", "¡": "es", "ã": "pt", "õ": "pt", "ß": "de", "ä": "de", "ö": "de", "ü": "de", "è": "fr", "ù": "fr", "œ": "fr", "î": "fr"}


def votes(text: str, words: list[str]) -> dict[str, float]:
    """Votes of stop-words and letters, by language; scripts other than Latin vote for themselves."""
    out: dict[str, float] = {}
    for w in words:
        langs = _STOP.get(w, ())
        for lang in langs:
            out[lang] = out.get(lang, 0) + 1 / len(langs)
    for c in set(text):
        if c in _LETTERS:
            out[_LETTERS[c]] = out.get(_LETTERS[c], 0) + 1
        elif c > "Ͱ":
            lang = "ru" if "Ѐ" <= c < "԰" else "zh" if "一" <= c < "ꀀ" else "ar" if "֐" <= c < "ހ" else None
            if lang:
                out[lang] = out.get(lang, 0) + 1
    return out


def other_language(q: str, qw: list[str], a: str, aw: list[str]) -> bool:
    """Whether the votes for the response's language contradict those for the prompt's."""
    vq, va = votes(q, qw), votes(a, aw)
    if not vq or not va:
        return False
    lq = max(vq, key=lambda k: (vq[k], k))
    la = max(va, key=lambda k: (va[k], k))
    return la != lq and vq[lq] >= 1.5 and va[la] >= 2 and va[la] >= va.get(lq, 0) + 1.5 and vq[lq] >= vq.get(la, 0) + 0.9


class SuffixAutomaton:
    """Of a sequence of hashable items: tells the longest run ending at each item of another sequence."""

    def __init__(self, items) -> None:
        self.next: list[dict] = [{}]
        self.link, self.length = [-1], [0]
        last = 0
        for c in items:
            cur = len(self.next)
            self.next.append({})
            self.length.append(self.length[last] + 1)
            self.link.append(0)
            p = last
            while p != -1 and c not in self.next[p]:
                self.next[p][c] = cur
                p = self.link[p]
            if p != -1:
                q = self.next[p][c]
                if self.length[p] + 1 == self.length[q]:
                    self.link[cur] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    self.length.append(self.length[p] + 1)
                    self.link.append(self.link[q])
                    while p != -1 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = self.link[p]
                    self.link[q] = self.link[cur] = clone
            last = cur

    def runs(self, items) -> list[int]:
        state, n, out = 0, 0, []
        for c in items:
            while state and c not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if c in self.next[state]:
                state, n = self.next[state][c], n + 1
            else:
                n = 0
            out.append(n)
        return out


def covered(prompt, response, least: int) -> list[bool]:
    """Which items of the response lie in a run of at least `least` items of the prompt."""
    runs = SuffixAutomaton(prompt).runs(response)
    mark = [False] * len(runs)
    left = 0
    for i in range(len(runs) - 1, -1, -1):
        if runs[i] >= least:
            left = max(left, runs[i])
        mark[i] = left > 0
        left -= left > 0
    return mark


def _letters_of(word: str, other: str) -> bool:
    """Whether most letters of either word lie in runs of two or more of the other's."""
    return sum(covered(word, other, 2)) >= 0.6 * len(other) and sum(covered(other, word, 2)) >= 0.6 * len(word)


def copied(qw: list[str], aw: list[str]) -> bool:
    """Whether the response only repeats the prompt, perhaps wrapped or slightly changed.

    Words in runs of two or more prompt words are copied; words of the usual wrappings don't count. At most one word in
    six may be other, and then letters must be covered too (a changed word shares most of its letters).
    """
    if len(aw) < 3 or len(qw) < 2 or sum(w in qw for w in aw) * 2 < len(aw):
        return False
    mark = covered(qw, aw, 2)
    kept = [m for m, w in zip(mark, aw) if m or w not in _WRAPPER]
    rest = [w for m, w in zip(mark, aw) if not m and w not in _WRAPPER and w not in qw]
    if sum(mark) < 0.6 * len(qw):
        return False
    if not rest:
        return True
    if len(rest) > max(1, len(kept) // 5):
        return False
    letters = "".join(rest)
    if sum(covered("".join(qw), letters, 3)) >= 0.6 * len(letters):
        return True
    left = [w for w, m in zip(qw, covered(aw, qw, 2)) if not m]
    return all(any(sorted(w) == sorted(x) or _letters_of(x, w) for x in left) for w in rest)


def open_delimiters(text: str) -> bool:
    """Whether a bracket or directed quotation mark is never closed."""
    stack = []
    for c in text:
        if c in _CLOSERS.values():
            stack.append(c)
        elif c in _CLOSERS and stack and stack[-1] == _CLOSERS[c]:
            stack.pop()
    return bool(stack)


def defect(q: str | None, a: str | None, passage: str | None, common: frozenset[str], refusals: ahocorasick.Automaton) -> str | None:
    """The defect of one response, None if it has none. common: words that many responses hold."""
    if a is None:
        return "empty"
    text = tidy(a)
    low = text.lower()
    bare = _TAG.sub(" ", low).strip(" \t\"'()[]{}<>*_`.:;,!?-–—…“”‘«»/\\|=#~")
    if not bare or bare in PLACEHOLDERS:
        return "empty"
    ask = tidy(q or "").lower()
    aw, qw = _WORD.findall(low), _WORD.findall(ask)
    if refuses(low, refusals) and not (passage and len(bare) > 20 and bare in tidy(passage).lower()):
        return "refusal"
    head, colon, tail = low.partition(":")
    if copied(qw, aw) or colon and len(head.split()) <= 6 and copied(qw, _WORD.findall(tail)):
        return "copied"
    if other_language(ask, qw, low, aw):
        return "language"
    core = text
    while core and core[-1] in "\"'”»’*_` ":
        core = core[:-1]
    if core.endswith(_TAIL_MARKS) or open_delimiters(text):
        return "truncated"
    if core and core[-1] not in ".!?。" and aw:
        last = aw[-1]
        if last in OPEN_WORDS and not (len(aw) == 1):
            return "truncated"
        # a word cut short where the question goes on with the whole word
        if len(aw) > 1 and any(p == aw[-2] and w != last and w.startswith(last) for p, w in zip(qw, qw[1:])):
            return "truncated"
        # a word cut short: no word of question, passage or many responses, but the beginning of one
        if last.isalpha() and len(aw) > 1 and last not in qw and last not in common:
            seen = set(_WORD.findall(tidy(passage).lower())) if passage else set()
            if last not in seen and any(len(w) > len(last) and w.startswith(last) for group in (qw, seen, common) for w in group):
                return "truncated"
    return None


FREQUENT = 0.002  # words in at least this share of all responses complete a cut word; at most mean length / FREQUENT
LEAST = 10  # and in at least so many


def frequent_words(records: DataFrame) -> list[str]:
    """Words that at least FREQUENT of all responses hold: a list bounded by (mean words of a response) / FREQUENT.

    And at least LEAST responses: below LEAST / FREQUENT = 5,000 responses this rules, so a larger share is demanded, fewer
    words complete a cut word, and more truncated responses are missed than on large tables.
    """
    t = F.regexp_replace(F.lower("a"), r"\p{Cf}+", "")
    words = records.select(F.array_distinct(F.regexp_extract_all(t, F.lit(r"(\p{L}+)"), F.lit(1))).alias("w")).filter("size(w) > 0")
    n = words.count()
    rows = words.select(F.explode("w").alias("x")).groupBy("x").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(FREQUENT * n, LEAST))
    return [r["x"] for r in rows.select("x").collect()]


def broken_pairs(records: DataFrame) -> DataFrame:
    """(rec_id, q, a, passage, ..) -> (rec_id, defect) of the defective records, one defect each.

    Checked in this order: empty, refusal, copied, language, truncated. A null question or passage only leaves out the
    checks that need it. Repeated rec_ids give repeated rows. After the list of frequent words is known, one pass over
    the records without a shuffle.
    """
    common = records.sparkSession.sparkContext.broadcast(frozenset(frequent_words(records)))

    def run(frames):
        refusals = refusal_automaton()
        for f in frames:
            f["defect"] = [defect(q, a, p, common.value, refusals) for q, a, p in zip(f["q"], f["a"], f["passage"])]
            yield f.loc[f["defect"].notna(), ["rec_id", "defect"]]

    return records.select("rec_id", "q", "a", "passage").mapInPandas(run, f"rec_id {dict(records.dtypes)['rec_id']}, defect string")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_pairs(spark.read.parquet(f"{d}/build_sci_decisions.parquet"))
