"""Text-quality statistics of each document, and the kind of the documents that are not prose.

Ratios of words, symbols and punctuation are built-in expressions. The layout of a text (delimiters that stand in the same
place in every line, indentation that comes back, line lengths that predict the next one) needs the ordered lines and is
computed in Arrow batches. One pass over the documents, no shuffle.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from operator import eq, ne

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Function words of the larger Latin-script languages of the collection (fixed values).
COMMON_WORDS = (
    "el la los las un una de del en y a al por para con sin se que su lo es fue no según pero como más ya "
    "the of and in to for with was at on by is that it from before "
    "o os as um uma do da dos das em na no e por para com não foi "
    "le les des du et dans pour sans est une au aux avec après avant "
    "der die das den dem ein eine und von vor nach ohne für auf im am mit nicht"
).split()

_LETTERS = r"\p{L}[\p{L}\p{M}]*"
_PLAIN = r"[\p{L}\p{M}\p{N}\s.,;:!?¿¡()\"'«»“”‘’„—–\-…。，、！？；：（）「」।؟؛،%$/]"


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text as expressions by name; null for null texts, ratios null where there is nothing to divide by."""
    words = F.regexp_extract_all(text, F.lit(rf"({_LETTERS})"), F.lit(1))
    lower = F.regexp_extract_all(F.lower(text), F.lit(rf"({_LETTERS})"), F.lit(1))
    lines = F.filter(F.split(text, r"\n"), lambda x: x.rlike(r"\S"))
    n_words, n_lines, n_chars = F.size(words), F.size(lines), F.length(text)

    def share(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, part / whole)

    letters = n_chars - F.length(F.regexp_replace(text, r"\p{L}", ""))
    common = F.size(F.filter(lower, lambda w: w.isin(COMMON_WORDS)))
    out = {
        "n_words": n_words,
        "n_lines": n_lines,
        "mean_word_length": share(letters, n_words),
        "letter_ratio": share(letters, n_chars),
        "digit_ratio": share(n_chars - F.length(F.regexp_replace(text, r"\p{N}", "")), n_chars),
        "symbol_ratio": share(F.length(F.regexp_replace(text, _PLAIN, "")), n_chars),
        "lines_ending_in_punctuation": share(F.size(F.filter(lines, lambda x: x.rlike(r"[.!?…。！？।؟][\"'»”’)]*\s*$"))), n_lines),
        "common_word_share": share(common, n_words),
    }
    return {k: F.when(text.isNotNull(), v) for k, v in out.items()}


def document_statistics(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the :func:`statistics` of every document."""
    return documents.select(F.col(f"`{key}`").alias(key), *[v.alias(k) for k, v in statistics(F.col(f"`{text}`")).items()])


_MARK = re.compile(r"\s*(?:[•·*▪◦‣●○□■☐☑✓✔➤►▶>+\-–—]|\(?\d{1,4}[.)º]|\(?[A-Za-z][.)]|\(?[ivxlIVXL]{1,6}[.)])\s+\S")
_LEADER = re.compile(r".*\S\s*(?:\.{3,}|…+|(?:\. ){3,}|_{3,}|·{3,})\s*[\divxlc]+\s*$")
_STOPS = re.compile(r"[.!?…。！？।؟][\"'»”’)\]]*$")
_GAP = re.compile(r"\s{2,}")
_HEX = re.compile(r"(?:0x)?[0-9a-fA-F]{2,16}:?,?$")
_BASE64 = re.compile(r"[A-Za-z0-9+/=_-]{24,}$")
_STRAY = "!|^~`;:,.'°¬·"
_LATIN, _VOWELS = frozenset("abcdefghijklmnopqrstuvwxyzáéíóúüñ"), frozenset("aeiouáéíóúü")
_COMMON = frozenset(COMMON_WORDS)
_NUMBERISH = re.compile(r"[\d.,%$\-+\s]*$")


#: Characters that may stand before a phrase that fills the rest of a text.
_FOREIGN = 40


def periodic(text: str, least: int = 5) -> bool:
    """Whether a text is one phrase again and again (at least ``least`` times), up to a few places and a short beginning."""
    s = " ".join(text.split())
    if len(s) < 2 * least:
        return False
    # Whatever stands before the first repetition, the middle lies inside one: its place and the next time it comes are a period.
    middle = len(s) // 3
    probe = s[middle : middle + 12]
    again = s.find(probe, middle + 1)
    period = again - middle
    if again < 0 or len(s) + 1 < least * period:
        return False
    shifted = s[period:]
    if s.startswith(shifted):
        return True
    different = 0
    for a in range(0, len(shifted), 4096):  # texts that are no repetition are left early
        different += sum(map(ne, s[a : a + 4096], shifted[a : a + 4096]))
        if different > 0.05 * len(shifted) + period:  # a foreign beginning differs within one period
            return False
    return different <= 0.05 * len(shifted) + min(period, _FOREIGN)


def delimiter_alignment(lines: list[str]) -> tuple[float, str, list[list[str]]]:
    """The largest share of lines that have the same number of one delimiter, which one, and the cells of all lines.

    For columns set with blanks the places where cells begin are compared instead; a row may lack cells.
    """
    best: tuple[float, str, list[list[str]]] = (0.0, "", [])
    n = len(lines)
    for d in "|\t;,":
        counts = [x.count(d) for x in lines]
        if not any(counts):
            continue
        number, times = Counter(c for c in counts if c).most_common(1)[0]
        share = times / n
        if d == "\t":  # trailing empty cells are often cut
            share = sum(1 for c in counts if 0 < c <= number) / n
        if share > best[0]:
            best = (share, d, [x.strip().strip("|").split(d) if d == "|" else x.split(d) for x in lines])
    starts = [[m.end() for m in _GAP.finditer(x.rstrip()) if m.start()] for x in lines]
    often = Counter(s for row in starts for s in set(row))
    common = {s for s, k in often.items() if k >= max(2, 0.25 * n)}
    rows = sum(1 for row in starts if row and common.issuperset(row))
    single = sum(1 for row, x in zip(starts, lines, strict=True) if not row and common and len(x) <= min(common))
    if rows and rows >= 0.5 * n and (rows + single) / n > best[0]:
        best = ((rows + single) / n, " ", [_GAP.split(x.strip()) for x in lines])
    return best


def length_autocorrelation(lengths: list[int], lag: int = 1) -> float:
    """Autocorrelation of the line lengths at a lag; 1 for constant lengths, 0 for fewer than three lines."""
    n = len(lengths)
    if n < lag + 2:
        return 0.0
    mean = sum(lengths) / n
    spread = sum((x - mean) ** 2 for x in lengths)
    if spread == 0:
        return 1.0
    return sum((lengths[i] - mean) * (lengths[i + lag] - mean) for i in range(n - lag)) / spread


def indentation_period(lines: list[str], longest: int = 4) -> tuple[int, float]:
    """The least period from 1 to ``longest`` with which item marks or indents come back best in the lines, and the share of lines
    that keep to it; (0, 0) if no line has a mark."""
    shape = [1 if _MARK.match(x) else 2 if x[:1].isspace() else 0 for x in lines]
    best = (0, 0.0)
    if 1 not in shape:
        return best
    for p in range(1, longest + 1):
        pairs = len(shape) - p
        if pairs > 0:
            share = sum(map(eq, shape, shape[p:])) / pairs
            if share > best[1] + 1e-9:
                best = (p, share)
    return best


def _nearly_all(tokens: list[str], pattern: re.Pattern, share: float) -> bool:
    """Whether at least ``share`` of the tokens match; stops as soon as too many do not."""
    others, most = 0, len(tokens) - share * len(tokens)
    for t in tokens:
        if not pattern.match(t):
            others += 1
            if others > most:
                return False
    return True


def is_dump(text: str) -> bool:
    """One phrase throughout, or a dump of bytes."""
    solid = "".join(text.split())
    if len(solid) < 8:
        return False
    if periodic(text):
        return True
    tokens = text.split()
    if len(tokens) >= 8 and _nearly_all(tokens, _HEX, 0.85) and any(c in "abcdefABCDEF" for c in solid):
        return True
    long_ones = [t for t in tokens if len(t) >= 24 and _BASE64.match(t)]
    return (
        sum(map(len, long_ones)) >= 0.8 * len(solid)
        and any(c.isdigit() for t in long_ones for c in t)
        and any(c.isupper() for t in long_ones for c in t)
    )


def is_noise(text: str, lines: list[str]) -> bool:
    """Symbol runs, random letters, or words broken up by stray marks, by the ratios of signs and of common words."""
    solid = "".join(text.split())
    if len(solid) < 8:
        return False
    signs = Counter(solid)  # each ratio is a sum over the distinct signs
    letters = sum(n for c, n in signs.items() if c.isalpha())
    digits = sum(n for c, n in signs.items() if c.isdigit())
    marks = sum(n for c, n in signs.items() if not c.isalnum() and unicodedata.category(c)[0] != "M")  # vowel signs are no symbols
    if letters + digits < 0.3 * len(solid) and marks > 0.5 * len(solid):
        return True
    latin = sum(n for c, n in signs.items() if c.lower() in _LATIN)
    if latin >= 24 and latin >= 0.4 * len(solid):
        stray = sum(signs[c] for c in _STRAY)
        if len(lines) <= 2 + len(solid) / 40 and stray >= 0.18 * len(solid):
            return True
        vowels = sum(n for c, n in signs.items() if c.lower() in _VOWELS) / latin
        if vowels < 0.27 and latin >= 0.85 * len(solid):
            words = text.lower().split()
            common = sum(w in _COMMON for w in words) / len(words)
            return vowels + W_COMMON * common < 0.27  # common words speak for a language of few vowels
    return False


#: Weights of the signals of layout: for tables alignment of delimiters, short cells, numbers, line lengths that predict the next
#: one, a delimiter that prose lacks, and ends of sentences (against); for lists the share of items and how regularly they come back;
#: of common words against noise; and the bounds of both scores.
W_SHORT, W_NUMBERS, W_LENGTHS, W_STRONG, W_STOPS, TABLE = 1.5, 0.1, 0.2, 0.15, 0.6, 2.34
W_PERIOD, LIST = 0.5, 1.05
W_COMMON = 0.2


def rows_kind(lines: list[str]) -> str | None:
    """``table`` where nearly all lines are rows of cells, ``list`` where they are entries of a contents page, else None."""
    n = len(lines)
    if n < 3:
        return None
    aligned, delimiter, cells = delimiter_alignment(lines)
    leaders = sum(bool(_LEADER.match(x)) for x in lines) / n
    if leaders >= 0.7:
        return "list"
    if aligned < 0.5:
        return None
    rows = [[c.strip() for c in row] for row in cells if len(row) > 1]
    inner = [c for row in rows for c in row[1:]]
    if not inner or len(rows) < 0.6 * n:
        return None
    stops = sum(bool(_STOPS.search(x)) for x in lines) / n
    numbers = sum(bool(_NUMBERISH.match(c)) for c in inner) / len(inner)
    if delimiter not in "|\t " and numbers < 0.4:  # commas and semicolons are prose's own
        return None
    short = sum(len(c) <= 24 for c in inner) / len(inner)
    lengths = [len(x) for x in lines]
    regular = max(0.0, *(length_autocorrelation(lengths, lag) for lag in (1, 2, 3)))
    score = aligned + W_SHORT * short + W_NUMBERS * numbers + W_LENGTHS * regular + W_STRONG * (delimiter in "|\t ") - W_STOPS * stops
    if score < TABLE:
        return None
    pages = [row[-1] for row in rows if len(row) == 2 and row[-1].isdigit()]
    if delimiter == " " and len(pages) >= 0.9 * n and all(int(a) < int(b) for a, b in zip(pages, pages[1:], strict=False)):
        return "list"  # a contents page whose numbers are set flush
    return "table"


def items_kind(lines: list[str]) -> str | None:
    """``list`` where nearly all lines are items with a mark (or continue one), else None."""
    n = len(lines)
    if n < 3:
        return None
    heads = 1 if lines[0].rstrip().endswith(":") else 0
    marked = [bool(_MARK.match(x)) for x in lines]
    letters = {x.strip()[0] for m, x in zip(marked, lines, strict=True) if m and x.strip()[0].isalpha()}
    if len(letters) == 1 and sum(marked) > 1:  # an initial or a title that opens every line is no mark
        return None
    inside = [m or (i > 0 and x[:2].isspace() and any(marked[max(0, i - 3) : i])) for i, (m, x) in enumerate(zip(marked, lines, strict=True))]
    items, characters = sum(inside), sum(len(x) for i, x in zip(inside, lines, strict=True) if i)
    if n - heads < 3 or items < 0.5 * (n - heads) or items / (n - heads) + W_PERIOD * indentation_period(lines[heads:])[1] < LIST or characters < 0.7 * sum(map(len, lines[heads:])):
        return None
    sentences = sum(m and bool(_STOPS.search(x)) and len(x) > 60 for m, x in zip(marked, lines, strict=True))
    return "list" if sentences <= 0.5 * n and sum(map(len, lines)) <= 110 * n else None


def brief_kind(lines: list[str]) -> str | None:
    """``list`` where nearly all lines are short and no sentence ends in them, and where they are not wrapped prose."""
    heads = 1 if lines and lines[0].rstrip().endswith(":") else 0
    body = [x.strip() for x in lines[heads:]]
    if len(body) < 3:
        return None
    lengths = [len(x) for x in body]
    stops = sum(bool(_STOPS.search(x)) for x in body) / len(body)
    spaceless = sum(1 for x in body for c in x if "\u0e00" <= c <= "\u0eff" or "\u3040" <= c <= "\u9fff") > 0.4 * sum(lengths)
    longest, mean = (32, 24) if spaceless else (60, 42)
    brief = sum(len(x.split()) <= 9 and len(x) <= longest for x in body) / len(body)
    widest = max(lengths)
    flush = sum(k >= 0.85 * widest for k in lengths[:-1]) / (len(lengths) - 1)
    wrapped = flush > 0.6 and widest >= 45 and length_autocorrelation(lengths) < 0.6
    return "list" if stops <= 0.34 and brief >= 0.9 and sum(lengths) <= mean * len(lengths) and not wrapped else None


def kind_of(text: str | None) -> str | None:
    """``list``, ``table`` or ``junk``; None for prose and for null, empty and blank texts."""
    if not text or not text.strip():
        return None
    lines = [x.rstrip() for x in text.splitlines() if x.strip()]
    if is_dump(text):
        return "junk"
    if kind := rows_kind(lines) or items_kind(lines):
        return kind
    return "junk" if is_noise(text, lines) else brief_kind(lines)


def kinds(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and kind of every document that as a whole is no prose."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(k, kind) for k, t in zip(b["_key"], b["_text"], strict=True) if (kind := kind_of(t))]
            yield pd.DataFrame(found, columns=[key, "kind"])

    read = documents.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).where(F.col("_text").rlike(r"\S"))
    return read.mapInPandas(run, f"`{key}` {documents.schema[key].dataType.simpleString()}, kind string")
