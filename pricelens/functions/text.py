"""Text normalisation, keyword matching and HTML to text, as native expressions."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Sequence
from functools import lru_cache
from itertools import groupby

from pyspark.sql import Column
from pyspark.sql import functions as F

from pricelens.fixed_values import NEGATION_WORDS
from pricelens.functions.literals import let


def fold(text: str) -> str:
    """Compatibility decomposition without combining marks (driver-side, for configuration words)."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


def normalized(text: str) -> str:
    """Driver-side twin of ``normalize_text`` for configuration words."""
    text = fold(text)
    for a, b in _QUOTES:
        text = text.replace(a, b)
    return re.sub(r"\s+", " ", text).strip().lower()


# Quote and dash spellings that count as one.
_QUOTES = [("’", "'"), ("“", '"'), ("”", '"'), ("''", '"'), ("—", "-"), ("–", "-")]


_HANGUL = range(0xAC00, 0xD7A4)


@lru_cache(maxsize=1)
def _fold_tables() -> tuple[str, str, tuple[tuple[str, str], ...]]:
    """(from, to) for ``translate`` and the characters that fold to several, derived from the Unicode tables of all planes.

    Hangul syllables, which fold to two or three letters each by arithmetic, have tables of their own."""
    source, target, dropped, longer = [], [], [], []
    for code in [*range(0x80, 0xD800), *range(0xE000, 0x110000)]:
        char = chr(code)
        if code in _HANGUL or (folded := fold(char)) == char:
            continue
        if len(folded) == 1:
            source.append(char)
            target.append(folded)
        elif not folded:
            dropped.append(char)
        else:
            longer.append((char, folded))
    return "".join(source + dropped), "".join(target), tuple(longer)


def _char_class(chars: str) -> str:
    """A character class of few ranges."""
    codes, spans = sorted(map(ord, chars)), []
    for code in codes:
        if spans and spans[-1][1] == code - 1:
            spans[-1][1] = code
        else:
            spans.append([code, code])
    return "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in spans) + "]"


def _fold_hangul(text: Column) -> Column:
    syllables = "".join(map(chr, _HANGUL))
    lead = "".join(chr(0x1100 + (c - 0xAC00) // 588) for c in _HANGUL)
    vowel = "".join(chr(0x1161 + (c - 0xAC00) % 588 // 28) for c in _HANGUL)
    closed = "".join(chr(c) for c in _HANGUL if (c - 0xAC00) % 28)
    tail = "".join(chr(0x11A7 + (c - 0xAC00) % 28) for c in _HANGUL if (c - 0xAC00) % 28)
    open_ = "".join(chr(c) for c in _HANGUL if not (c - 0xAC00) % 28)

    def letters(c: Column) -> Column:
        parts = F.concat(F.translate(c, syllables, lead), F.translate(c, syllables, vowel), F.translate(c, closed + open_, tail))
        return F.when(c.rlike("[\\x{AC00}-\\x{D7A3}]"), parts).otherwise(c)

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0)), letters), "")


def strip_marks(text: Column) -> Column:
    """Accents and compatibility forms folded to plain letters, for every character there is.

    Each step is gated by what it is for: plain ASCII is left alone, and only texts that still hold a character of
    several letters are searched for these."""
    source, target, longer = _fold_tables()
    out = F.translate(text, source, target)
    pairs = F.from_json(F.lit(json.dumps([{"a": c, "b": f} for c, f in longer])), "ARRAY<STRUCT<a: STRING, b: STRING>>")

    def expand(t: Column) -> Column:
        wide = F.when(t.rlike("[^\\x00-\\x7F]") & t.rlike(_char_class("".join(c for c, _ in longer))),
                      F.aggregate(pairs, t, lambda acc, p: F.replace(acc, p["a"], p["b"]))).otherwise(t)
        return F.when(t.rlike("[\\x{AC00}-\\x{D7A3}]"), _fold_hangul(wide)).otherwise(wide)

    return F.when(text.rlike("[^\\x00-\\x7F]"), let(out, expand)).otherwise(text)


def normalize_text(text: Column) -> Column:
    """Lower case, no accents, single spaces, one spelling of quotes and dashes."""
    out = F.translate(strip_marks(F.coalesce(text, F.lit(""))), "’“”—–", "'\"\"--")
    out = F.replace(out, F.lit("''"), F.lit('"'))
    return F.lower(F.trim(F.regexp_replace(out, "(?U)\\s+", " ")))



def keyword_pattern(words: Sequence[str]) -> str | None:
    """One alternation; a word has a boundary only on the sides where it begins or ends with a letter or digit.

    Neighbours with the same boundaries share them, so each position is checked once and not once per word.
    """
    def edges(word: str) -> tuple[str, str]:
        return (r"(?<![a-z0-9])" if re.match(r"[a-z0-9]", word) else "",
                r"(?![a-z0-9])" if re.search(r"[a-z0-9]$", word) else "")

    runs = groupby(map(normalized, words), key=edges)
    return "|".join(f"{left}(?:{'|'.join(map(quote, run))}){right}" for (left, right), run in runs) or None


def quote(word: str) -> str:
    return re.sub(r"([\\.\[\]{}()*+?^$|/\-])", r"\\\1", word)


def has_keyword(text: Column, words: Sequence[str]) -> Column:
    pattern = keyword_pattern(words)
    return text.rlike(pattern) if pattern else F.lit(False)


def find_keyword(text: Column, words: Sequence[str]) -> Column:
    """The first keyword found, null when there is none."""
    pattern = keyword_pattern(words)
    if not pattern:
        return F.lit(None).cast("string")
    found = F.regexp_extract(text, f"({pattern})", 1)
    return F.when(found != "", found)


def without_negated(text: Column, words: Sequence[str]) -> Column:
    """Text with every negated keyword blanked: one after a negation word, or followed by a zero count.

    The negation words have no left boundary of their own, so a word that ends like one also negates.
    """
    pattern = keyword_pattern(words)
    if not pattern:
        return text
    before = "(?<=(?:" + "|".join(NEGATION_WORDS) + r") {0,1})"
    after = r"(?=\s?[:=]?\s?0(?![0-9,.]))"
    return F.regexp_replace(text, f"{before}(?:{pattern})|(?:{pattern}){after}", "\u0001")


def find_affirmed_keyword(text: Column, words: Sequence[str]) -> Column:
    """The first keyword that is not negated. Text without any keyword is settled by one match."""
    if not words:
        return F.lit(None).cast("string")
    return F.when(has_keyword(text, words), find_keyword(without_negated(text, words), words))


def has_affirmed_keyword(text: Column, words: Sequence[str]) -> Column:
    return has_keyword(text, words) & has_keyword(without_negated(text, words), words)


def unescape_html(text: Column) -> Column:
    """HTML entities to characters with the JVM's own table; text without '&' is left alone."""
    call = F.reflect(F.lit("org.apache.commons.text.StringEscapeUtils"), F.lit("unescapeHtml4"), text)
    return F.when(text.contains("&"), call).otherwise(text)


def html_to_text(html: Column) -> Column:
    """Block ends to line breaks, other tags to spaces, entities to characters, runs of blanks to one."""
    out = F.regexp_replace(F.coalesce(html, F.lit("")), "(?i)<(br|/p|/div|/li|/tr)[^>]*>", "\n")
    out = F.regexp_replace(out, "<[^>]+>", " ")
    out = F.regexp_replace(unescape_html(out), "[ \t]+", " ")
    return F.regexp_replace(out, "(?U)^\\s+|\\s+$", "")
