"""Text functions on columns: normal forms, fingerprints, tokens, numbers, chunks and parsers."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: the white space that Python's str.split() eats, as a Java class.
SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

# Fixed value: signed numbers with thousands commas, decimals and exponents.
NUMBER = r"(?U)(?<![\w.])[+-]?(?:(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?|\.\d+)(?:[eE][+-]?\d+)?(?!\w)"

# Fixed value: words of content, with the letters of Spanish.
CONTENT_WORD = r"(?iu)[a-záéíóúñü][a-záéíóúñü\-']*"

# Words that carry no content.
STOP = (
    "a an the of in on at to for and or but is are was were be been it its this that these those with by from as we i you they "
    "he she not no do does did have has had can could will would should may might than then so such"
).split()


@F.pandas_udf(T.StringType())
def _nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def collapse_space(c: Column) -> Column:
    """Runs of Unicode white space become one blank; ends are trimmed. Case is kept. Null stays null."""
    return F.trim(F.regexp_replace(c, SPACE, " "))


def normalized(c: Column, nfc: bool = True) -> Column:
    """NFC, then collapse_space. Composition runs in Python only for texts that hold characters which can change."""
    composed = F.when(c.rlike(r"[\x{300}-\x{10ffff}]"), _nfc(c)).otherwise(c) if nfc else c
    return collapse_space(composed)


def fingerprint(c: Column, nfc: bool = True) -> Column:
    """SHA-256 of the normal form."""
    return F.sha2(normalized(c, nfc), 256)


def tokens(c: Column, least: int = 3, letters_only: bool = False) -> Column:
    """Lower-case ASCII tokens of at least `least` characters, in order."""
    kind = "a-z" if letters_only else "a-z0-9"
    return F.regexp_extract_all(F.lower(c), F.lit(f"([{kind}]{{{least},}})"), F.lit(1))


def token_set(c: Column, least: int = 3, letters_only: bool = False) -> Column:
    return F.array_distinct(tokens(c, least, letters_only))


def content_words(c: Column) -> Column:
    """Words of over three letters that are no stop-words, lower case, in order."""
    found = F.transform(F.regexp_extract_all(c, F.lit(f"({CONTENT_WORD})"), F.lit(1)), F.lower)
    return F.filter(found, lambda w: (F.length(w) > 3) & ~w.isin(STOP))


def number_value(literal: Column) -> Column:
    """A numeric literal in one form per value, exact at any size: sign, digits without zeros at either end, E, exponent of
    ten; 0 for zero. 10, 1e1 and 10.0 are 1E1. An exponent of over 18 digits stays as it is written."""
    plain = F.regexp_replace(literal, "[,+]", "")
    mantissa, power = F.regexp_extract(plain, "^-?([0-9.]*)", 1), F.regexp_extract(plain, "[eE](-?[0-9]+)$", 1)
    whole, part = F.regexp_extract(mantissa, r"^(\d*)", 1), F.regexp_extract(mantissa, r"\.(\d*)$", 1)
    digits = F.regexp_replace(F.concat(whole, part), "^0+", "")
    short = F.regexp_replace(digits, "0+$", "")
    shift = F.length(digits) - F.length(short) - F.length(part)
    exponent = F.when(power == "", F.lit(0).cast("bigint")).when(F.length(power) <= 18, power.try_cast("bigint"))
    sign = F.when(plain.startswith("-"), "-").otherwise("")
    return F.when(digits == "", "0").when(exponent.isNull(), plain).otherwise(F.concat(sign, short, F.lit("E"), (exponent + shift).cast("string")))


def numbers(c: Column) -> Column:
    """Values of the numeric literals of a text, in order, as number_value writes them; minus signs and thousands commas
    are understood."""
    text = F.regexp_replace(c, r"\x{2212}", "-")
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), number_value)


def words(c: Column) -> Column:
    """Words between white space; empty for blank texts."""
    return F.filter(F.split(c, SPACE), lambda w: w != "")


def chunk_starts(n: Column, size: int, overlap: int) -> Column:
    """Word offsets of the chunks of a text of n words: one chunk up to `size` words, else every size-overlap words."""
    last = F.greatest(n - overlap - 1, F.lit(0))
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), last, F.lit(size - overlap)))


# What LaTeX source holds besides words: comments, environments, formulas, commands, marks of layout.
LATEX = r"%[^\n]*|\\(?:begin|end)\s*\{[^}]*\}(?:\[[^\]]*\])?|\$\$[^$]*\$\$|\\\[.*?\\\]|\$[^$]*\$|\\[a-zA-Z@]+\*?(?:\[[^\]]*\])?|[{}^_~&]"
BODY = "\\begin{document}"


def scrub_latex(c: Column) -> Column:
    """Natural-language words of LaTeX text: one scan from the body's beginning, in which an escaped percent sign stays, any
    part of LATEX becomes a blank and runs of white space become one."""
    body = F.when(F.instr(c, BODY) > 0, F.substr(c, F.instr(c, BODY) + len(BODY))).otherwise(c)
    return F.regexp_replace(F.regexp_replace(body, rf"(?s)(\\%)|{LATEX}", "$1 "), SPACE, " ")


def question_text(c: Column) -> Column:
    """A question without a leading `question:` of any case."""
    return F.trim(F.regexp_replace(c, r"(?i)^\s*question:\s*", ""))


def question_tail(c: Column) -> Column:
    """Text after the last line that begins with `Question:`; empty without one."""
    mark = "\nQuestion:"
    return F.when(F.instr(c, mark) > 0, F.trim(F.substring_index(c, mark, -1))).otherwise(F.lit(""))


def leading_letter(c: Column) -> Column:
    """Index of a single capital A to D at the start of a reply, else -1."""
    return F.instr(F.lit("ABCD"), F.regexp_extract(F.coalesce(c, F.lit("-")), r"^\s*([A-D])\b", 1)) * F.when(F.coalesce(c, F.lit("-")).rlike(r"^\s*[A-D]\b"), 1).otherwise(0) - 1


def stated_letter(c: Column, letters: str = "ABCD") -> Column:
    """The capital of `letters` that a reply states last after answer, final answer or correct answer (is, a colon and an
    opening bracket may follow), else the reply if it is one letter only, in any case and brackets; else null."""
    said = F.regexp_extract_all(c, F.lit(rf"\b(?i:answer)\s*(?i:is\s*)?:?\s*[(\[]?([{letters}])\b"), F.lit(1))
    alone = F.regexp_extract(c, rf"(?i)^\s*[(\[]?([{letters}])[)\].:]?\s*$", 1)
    return F.when(F.size(said) > 0, F.element_at(said, -1)).when(alone != "", F.upper(alone))


def call_text(tool: Column, args: Column) -> Column:
    """A call as text: tool(name=value, ..) with names in order. args is a map of names to JSON texts."""
    pairs = F.transform(F.array_sort(F.map_entries(args)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return F.concat(tool, F.lit("("), F.array_join(pairs, ", "), F.lit(")"))


def replace_span(text: Column, start: Column, end: Column, by: Column) -> Column:
    """text with its code points [start, end) replaced."""
    return F.concat(F.substr(text, F.lit(1), start), by, F.substr(text, end + 1))


def lettered(options: Column) -> Column:
    """Options as lines that begin with their letters: A. .., B. .., .."""
    return F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(". "), o)), "\n")


def teacher_prompt(state: Column, instructions: Column, options: Column) -> Column:
    """State, instructions, options as lines A) .., B) .. and what to answer with; null where there are not 2 to 26 options."""
    lines = F.array_join(F.transform(options, lambda o, i: F.concat(F.char(i + 65), F.lit(") "), o)), "\n")
    body = F.concat_ws("\n\n", state, instructions, lines, F.lit("Answer with only the letter of the best option."))
    return F.when(F.size(options).between(2, 26) & ~F.exists(options, lambda o: o.isNull()), body)


def holds_question(ids: Column, decode, last: int = 40) -> Column:
    """Whether the decoded last ids of a context hold the word Question. decode: a column function of ids to text."""
    return F.contains(decode(F.slice(ids, F.greatest(F.lit(1), F.size(ids) - last + 1), F.lit(last))), F.lit("Question"))
