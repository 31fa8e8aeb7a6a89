"""Text expressions: normalisation, words, phrases, numbers, classes of text. All are built-in Spark expressions but NFC."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD_CHARS = r"[\p{L}\p{N}_]"
#: Named definitions of a word; statistics say which one they use.
WORDS = {
    "blank": r"\S+",
    "hyphenated": r"[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+(?:-[A-Za-zÁÉÍÓÚÜÑáéíóúüñ]+)*",
    "letters": r"\p{L}+",
    "unicode": r"[\p{L}\p{N}_]+",
}
BULLETS = "•●▪◦·–"


@F.pandas_udf(T.StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Canonical composition; Spark has no built-in for it. Nulls stay null."""
    return text.map(lambda t: unicodedata.normalize("NFC", t) if isinstance(t, str) else None)


def normalised(text: Column, compose: bool = False) -> Column:
    """Soft hyphens and zero-width characters dropped, tabs and non-breaking blanks turned into blanks."""
    t = nfc(text) if compose else text
    t = F.regexp_replace(t, "[­​‌‍﻿]", "")
    return F.regexp_replace(t, "[\t  ]", " ")


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def cleaned(text: Column, compose: bool = False) -> Column:
    """Normalised, with single blanks and without leading bullets."""
    return F.regexp_replace(collapsed(normalised(text, compose)), rf"^[{BULLETS} ]+", "")


def word_list(text: Column, kind: str = "letters") -> Column:
    """All words of a text, by one of the named definitions."""
    pattern = WORDS[kind].replace(")*", ")*+")  # possessive groups are walked in a loop, however many hyphens there are
    return F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))


def word_count(text: Column, kind: str = "letters") -> Column:
    return F.size(word_list(text, kind))


def phrase_pattern(phrases: list[str]) -> str:
    """One alternation for a list of phrases between word boundaries, longest first."""
    alternatives = "|".join(re.escape(p).replace(r"\ ", " ") for p in sorted(set(phrases), key=lambda p: (-len(p), p)))
    return rf"(?<!{WORD_CHARS})({alternatives})(?!{WORD_CHARS})"


def phrase_hits(text: Column, phrases: list[str]) -> Column:
    """All non-overlapping occurrences in the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(phrase_pattern(phrases)), F.lit(1))


def phrase_count(text: Column, phrases: list[str]) -> Column:
    return F.regexp_count(F.lower(text), F.lit(phrase_pattern(phrases)))


def additive_count(text: Column, phrases: list[str]) -> Column:
    """Each phrase counted for itself and summed, so that overlapping phrases count twice.

    Phrases that share no word can not overlap and are counted by one pattern.
    """
    groups: list[tuple[set[str], list[str]]] = []
    for p in phrases:
        words = set(p.split())
        for seen, members in groups:
            if not seen & words:
                seen |= words
                members.append(p)
                break
        else:
            groups.append((words, [p]))
    total = F.lit(0)
    for _, members in groups:
        total = total + phrase_count(text, members)
    return total


def margin_key(text: Column) -> Column:
    """Margin line with digits masked, in capitals, without blanks and slashes around it."""
    return F.regexp_replace(F.upper(F.regexp_replace(collapsed(normalised(text)), r"[0-9]+", "#")), r"^[ /]+|[ /]+$", "")


QUOTED = r"«[^»]{3,}»|“[^”]{3,}”|\"[^\"]{3,}\""
NUMBER = r"(?:US?\$|\$|€)?\s?[0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?\s?%?|(?:US?\$|\$|€)?\s?[0-9]+(?:,[0-9]+)?\s?%?"


def quoted_spans(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({QUOTED})"), F.lit(1)), lambda q: F.substring(q, F.lit(2), F.length(q) - 2))


def number_strings(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(f"({NUMBER})"), F.lit(1)), lambda x: F.trim(x))


def spanish_number(text: Column) -> Column:
    """The first number of a text: dots group thousands, the comma is the decimal mark; null without digits."""
    first = F.regexp_extract(text, r"([0-9]{1,3}(?:\.[0-9]{3})+(?:,[0-9]+)?|[0-9]+(?:,[0-9]+)?)", 1)
    return F.replace(F.replace(first, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def short_quote(text: Column, words: int = 25) -> Column:
    parts = word_list(text, "blank")
    head = F.array_join(F.slice(parts, 1, words), " ")
    return F.when(F.size(parts) > words, F.concat(head, F.lit(" …"))).otherwise(head)


def sentence_marks(text: Column) -> Column:
    """Sentences of a text by terminal marks before a capital or digit (an optional opening mark between); no look-around."""
    marked = F.regexp_replace(text, r"([.;:!?])\s+([«“\"(¿¡]?[\p{Lu}0-9])", "$1\u0001$2")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda s: F.trim(s)), lambda s: s != "")


def without_markup(text: Column) -> Column:
    """Headings, bold, bullets and numbering of chat-like markup removed."""
    t = F.regexp_replace(text, r"(?m)^ {0,3}#{1,6} *", "")
    t = F.regexp_replace(t, r"\*\*([^*]+)\*\*", "$1")
    return F.regexp_replace(t, r"(?m)^\s*(?:[-*•]|[0-9]+[.)])\s+", "")


def is_prose(text: Column) -> Column:
    """At least 20 words, at most a fifth of them numbers, not mostly capitals, four fifths letters and blanks."""
    words = word_list(text, "unicode")
    n = F.size(words)
    digits = F.size(F.filter(words, lambda w: w.rlike("^[0-9]+$")))
    letters = F.length(text) - F.length(F.regexp_replace(text, r"\p{L}", ""))
    upper = F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}", ""))
    plain = F.length(text) - F.length(F.regexp_replace(text, r"[\p{L}\s]", ""))
    return (n >= 20) & (digits <= 0.2 * n) & (upper <= 0.3 * F.greatest(letters, F.lit(1))) & (plain >= 0.8 * F.length(text))


def artifact_rate(text: Column) -> Column:
    """Share of tokens that look like extraction debris: lone consonants, letters fused with digits."""
    bare = F.transform(word_list(text, "blank"), lambda t: F.regexp_replace(t, r"^[.,;:()«»“”\"'¿?¡!]+|[.,;:()«»“”\"'¿?¡!]+$", ""))
    tokens = F.filter(bare, lambda t: t != "")
    odd = F.filter(tokens, lambda t: t.rlike(r"^(?:[b-df-hj-np-tv-xzB-DF-HJ-NP-TV-XZ]|[0-9]+[a-zA-Z]+[0-9]*|[a-zA-Z]+[0-9]+[a-zA-Z0-9]*)$"))
    return F.when(F.size(tokens) > 0, F.size(odd) / F.size(tokens)).otherwise(F.lit(0.0))


def syllables(word: Column) -> Column:
    """Approximate Spanish syllables: vowel groups, and one more where two strong vowels meet; at least one.

    A strong vowel opens a syllable after anything but a weak vowel; a weak one only after a consonant.
    """
    w = F.lower(word)
    groups = F.regexp_count(w, F.lit("[aeiouáéíóúü]+"))
    hiatus = F.length(w) - F.length(F.regexp_replace(w, "(?<=[aeoáéíóú])[aeoáéíóú]", ""))
    return F.greatest(groups + hiatus, F.lit(1))


def surface(text: Column) -> Column:
    """An entity string without quotes, outer punctuation and a leading article."""
    t = F.regexp_replace(collapsed(text), r"^[ .,;:«»“”\"'()\[\]]+|[ .,;:«»“”\"'()\[\]]+$", "")
    return F.trim(F.regexp_replace(t, r"^(?:[Ee]l|[Ll]a|[Ll]os|[Ll]as|[Dd]el|[Aa]l|[Dd]e) +", ""))
