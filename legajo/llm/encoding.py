"""Garbled characters from a wrong character mapping: found, and undone where that can be told.

The search for the right text is a best-first search over a graph: states are texts, edges are "encode with the mapping
it was wrongly read by, decode with the right one" and unescaping; seen states are kept by hash, and the cost of a state is
the implausibility of its characters plus a small price for each step. The cheapest reachable text wins: the search ends when
the price of one more step cannot be won back, not before. The graph is finite: reading UTF-8 makes a text shorter, and two
changes of single-byte mapping in a row count as one, so they do not follow each other. A step encodes a whole run of
non-ASCII characters or leaves it. Words are searched one by one (a record is often garbled in part only) and remembered, as
the same words come again and again.
"""

from __future__ import annotations

import heapq
import html
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mappings that UTF-8 bytes were read by, and pairs (read by, written by) of single-byte mappings (fixed values).
UTF8_READ_BY = ("cp1252", "latin-1", "mac_roman", "cp437", "cp850", "cp1251")
SINGLE_BYTE = (("cp850", "cp1252"), ("mac_roman", "cp1252"), ("cp437", "cp1252"), ("latin-1", "cp1251"), ("cp1252", "cp1251"),
               ("cp1252", "cp850"), ("cp1252", "mac_roman"), ("cp1251", "cp1252"))
#: Price of a step, and how much cheaper a text must get to count as restored.
STEP = 0.3
GAIN = 1.0
#: Price of letters of two scripts side by side.
MIXED = 3.0

#: Anything that a garbled text has; a superset, checked afterwards (one pass of one pattern inside the JVM).
SUSPECT = (
    r"[\u0000-\u0008\u000B\u000E-\u001F\u007F-\u009F∂-⏿─-▟◊�]"
    r"|[ÂÃ](?=[^A-Za-zÀ-ÿ\s.,;:)»”?!])|[ÂÃ](?=[À-ÿ])(?![ÂÃ]O)|Ã (?=[a-z])|(?<=\p{Ll})[À-ÖØ-Þ]"
    r"|[¢-©®±µ¶¼-¾˙](?=\p{L})|(?<=\p{L})[¢-©®±µ¶¼-¾˙]"
    r"|(?<=\p{L})[·´](?=\p{L})|[´°øØ](?=\p{Lu})|[à-öø-ÿ]{3}|â€"
    r"|[À-ÖØ-öø-ÿ][\u0080-\u009F¬­¯²³¸¹Œ-ƒˆ‘‚„†-•‹›€™]"
    r"|‚Ä|ÔÇ|ΓÇ|[В-С][\u0080-¿Ѐ-Џѐ-џҐґ–-™]|[Ђ-Џђ-џҐґ]"
    r"|(?<=\p{Ll})\?(?=\p{L})|(?<=\p{Lu})\?(?=\p{Lu})|(?<=^|\s)\?(?=\p{L})|(?<=\p{Ll})\?(?= \p{Ll})"
    r"|&#?\w{2,8};|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|=[0-9A-F]{2}=[0-9A-F]{2}|%[0-9A-F]{2}%[0-9A-F]{2}"
)


@lru_cache(maxsize=32)
def _byte_of(codec: str) -> dict[int, int]:
    """Code point -> byte; bytes that a mapping leaves open stand for themselves, as readers leave them."""
    table = {}
    for b in range(256):
        try:
            table[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            table.setdefault(b, b)
    return table


def _class(chars: set[str]) -> str:
    return "[" + "".join(f"\\u{ord(c):04X}" for c in sorted(chars)) + "]"


@lru_cache(maxsize=32)
def _utf8_in(codec: str) -> re.Pattern:
    """The pattern of the characters of ``codec`` whose bytes are one character of UTF-8."""
    of = {b: chr(point) for point, b in _byte_of(codec).items()}
    tail = _class({of[b] for b in range(0x80, 0xC0)})
    two, three, four = (_class({of[b] for b in r}) for r in (range(0xC2, 0xE0), range(0xE0, 0xF0), range(0xF0, 0xF5)))
    return re.compile(f"{two}{tail}|{three}{tail}{{2}}|{four}{tail}{{3}}")


@lru_cache(maxsize=1)
def _movable() -> frozenset[int]:
    """Code points that some step other than unescaping may change."""
    codecs = {*UTF8_READ_BY, *(c for pair in SINGLE_BYTE for c in pair)}
    return frozenset(point for c in codecs for point in _byte_of(c) if point >= 0x80)


@lru_cache(maxsize=1)
def _runs() -> re.Pattern:
    return re.compile(_class({chr(point) for point in _movable()}) + "+")


def _reread_utf8(text: str, codec: str) -> str:
    """Runs of movable characters that ``codec`` can encode are encoded and read as UTF-8 where they are; the rest stays."""
    table, signs = _byte_of(codec), _utf8_in(codec)

    def read(m: re.Match) -> str:
        try:
            return bytes(table[ord(c)] for c in m.group()).decode("utf-8")
        except UnicodeDecodeError:
            return m.group()

    def run(m: re.Match) -> str:
        r = m.group()
        return signs.sub(read, r) if len(r) > 1 and all(ord(c) in table for c in r) else r

    return _runs().sub(run, text)


def _change(text: str, pair: tuple[str, str]) -> str:
    """Runs of movable characters that the first mapping can encode are read by the second, if it can read them."""
    table = _remap(*pair)

    def run(m: re.Match) -> str:
        r = m.group()
        if not all(ord(c) in table for c in r):
            return r
        new = r.translate(table)
        return r if "�" in new else new

    return _runs().sub(run, text)


@lru_cache(maxsize=32)
def _remap(read_by: str, written_by: str) -> dict[int, str]:
    table = {}
    for point, b in _byte_of(read_by).items():
        if b >= 0x80:
            try:
                table[point] = bytes([b]).decode(written_by)
            except UnicodeDecodeError:
                table[point] = "�"
    return table


_ESCAPE = re.compile(r"&#?\w{2,8};|\\u[0-9a-fA-F]{4}|\\x[0-9a-fA-F]{2}|(?:%[0-9A-F]{2}){2}|(?:=[0-9A-F]{2}){2}")


def _unescape(text: str) -> str:
    t = html.unescape(text)
    t = re.sub(r"\\u([0-9a-fA-F]{4})", lambda m: chr(int(m.group(1), 16)), t)
    t = re.sub(r"\\x([0-9a-fA-F]{2})", lambda m: chr(int(m.group(1), 16)), t)

    def quoted(m: re.Match) -> str:
        try:
            return bytes.fromhex(m.group().replace("%", "").replace("=", "")).decode("utf-8")
        except (UnicodeDecodeError, ValueError):
            return m.group()

    return re.sub(r"(?:%[0-9A-F]{2}){2,}|(?:=[0-9A-F]{2}){2,}", quoted, t)


def neighbours(text: str, changed: bool = False) -> Iterator[tuple[str, bool]]:
    """The texts one step away, each with whether a change of single-byte mapping made it; ``changed``: one made ``text``."""
    for codec in UTF8_READ_BY:
        yield _reread_utf8(text, codec), False
    if not changed:
        for pair in SINGLE_BYTE:
            yield _change(text, pair), True
    if "&" in text or "\\" in text or "%" in text or "=" in text:
        yield _unescape(text), False


#: The likeliest accented letters; they decide between readings that are otherwise alike (fixed values).
_FREQUENT = set("áéíóúñüÁÉÍÓÚÑºª")
#: Letters that words of Western languages use beside ASCII, and signs that may stand at the edge of a word (fixed values).
_WESTERN = set("áéíóúüñçãõâêôàèìòùïëîûäößœæÁÉÍÓÚÜÑÇÃÕÂÊÔÀÈÌÒÙÏËÎÛÄÖŒÆåÅøØ")
_EDGE = set("«»“”„‘’‚—–‐‑…¿¡°ºª²³‰€•¬­   №​﻿、。，！？：；「」『』（）・【】《》〈〉、؛؟،।॥")
_INNER = set("’‘—–‐‑‰€°ºª²³…»«”“„¿¡­   ¬@•、。，！？：；「」『』（）・【】《》؛؟،।॥")
_SMALL = {c for c in _FREQUENT if c.islower()}
_QUOTES = set("«»“”„")
_AFTER_LEADS = set("€‚ƒ„†‡ˆ‰Š‹ŒŽ•™š›žŸ")
_ACCENTS = set("\u0300\u0301\u0302\u0303\u0308\u030A\u0327")
#: Signs that are no part of words but that a mapping makes of ö, ä and the like.
_FOR_LETTERS = set("ˆˇ‰")
_PAIRS = {"çã", "çõ", "ÇÃ", "ÇÕ", "ñó", "ñí", "ñé", "ñá", "íñ", "éñ", "ñú", "ÑÓ", "œu", "éé", "ãç", "íó", "íá", "áí", "óí", "éí"}


@lru_cache(maxsize=4096)
def _script(ch: str) -> str:
    """The script of a letter; scripts that stand together in one word count as one."""
    o = ord(ch)
    if o < 0x250 or 0x1E00 <= o < 0x1F00 or 0xFB00 <= o < 0xFB07:
        return "Latin"
    if 0x2E80 <= o < 0xA000 or 0xF900 <= o < 0xFAFF or 0xFF00 <= o < 0xFFF0 or o >= 0x20000:
        return "Han and Kana"
    if 0xAC00 <= o < 0xD7FC or 0x1100 <= o < 0x1200:
        return "Hangul"
    if 0x400 <= o < 0x530:
        return "Cyrillic"
    if 0x370 <= o < 0x400:
        return "Greek"
    if 0x600 <= o < 0x780 or 0xFB50 <= o < 0xFF00:
        return "Arabic"
    return f"block {o >> 7}"


@lru_cache(maxsize=4096)
def _alone(ch: str) -> float:
    """Cost of a character wherever it stands."""
    o, kind = ord(ch), unicodedata.category(ch)
    if o < 0x80:
        return 0.0 if o >= 0x20 or ch in "\t\n\r\f" else 5.0
    if 0x80 <= o < 0xA0 or ch == "�" or kind in ("Cn", "Co", "Cs"):
        return 5.0
    if o < 0x250 and kind[0] == "L":
        if ch in _FREQUENT:
            return 0.0
        return 0.1 if ch in _WESTERN else 2.0
    if 0x400 <= o < 0x530:
        return 0.05 if 0x410 <= o <= 0x44F or ch in "Ёё" else 2.0
    if 0x370 <= o < 0x400:
        return 2.0
    if kind[0] in "LMN":
        return 0.05
    return 0.0 if ch in _EDGE else 3.0


def _mixed(before: str, ch: str) -> bool:
    return before.isalpha() and ch.isalpha() and _script(ch) != _script(before)


def unavoidable(word: str, escaped: bool) -> float:
    """What every text reachable from ``word`` costs at least: its characters that no step changes, and their neighbours."""
    cost, before = 0.0, ""
    for ch in word:
        o = ord(ch)
        if o in _movable() or (escaped and o < 0x80):
            before = ""
            continue
        if o >= 0x80 or o < 0x20:
            cost += _alone(ch)
        if before and _mixed(before, ch):
            cost += MIXED
        before = ch
    return cost


def implausibility(word: str) -> float:
    """Cost of a word: unlikely characters, signs inside it, capitals after small letters, mixed scripts."""
    cost, quoted, before = 0.0, 0.0, ""
    letters_after = [False] * (len(word) + 1)
    for i in range(len(word) - 1, -1, -1):
        letters_after[i] = letters_after[i + 1] or word[i].isalpha()
    for i, ch in enumerate(word):
        o = ord(ch)
        if o >= 0x80 or o < 0x20:
            cost += _alone(ch)
            if o >= 0x80 and not ch.isalpha() and unicodedata.category(ch)[0] not in "MN":
                if before.isalpha() and letters_after[i + 1] and ch not in _INNER:
                    cost += 2.0
            elif before:
                if ord(before) >= 0x80 and before.isalpha() and ch.isalpha() and o < 0x250 and ord(before) < 0x250:
                    if before + ch not in _PAIRS and not (before.isupper() and ch.isupper() and before in _WESTERN and ch in _WESTERN and i > 1):
                        cost += 1.5
                if ch.isupper() and before.islower() and o < 0x530:
                    cost += 3.0
        if (o >= 0x250 or before and ord(before) >= 0x250) and _mixed(before, ch):
            cost += MIXED
        if before and ord(before) >= 0x80 and before.isalpha() and ord(before) < 0x250 and ch in "¡¢£¤¥¦§¨©«¬®¯±²³´µ¶·¸¹º¼½¾" and (ch not in "¡«¬" or before not in _SMALL):
            cost += 1.5
        if ch in _FOR_LETTERS and (word[i + 1 : i + 2].isalpha() or ch != "‰" and before.isalpha()) or ch == "€" and before.isalpha() and word[i + 1 : i + 2].isalpha():
            cost += 3.0
        if before in ("ø", "Ø") and ch.isupper() or before == "Ô" and ch == "Ç":
            cost += 2.0
        if before in ("Ã", "Â") and not ch.isascii() and ch not in "ÇÕÃÂ" or before == "Å" and ch in _QUOTES:
            cost += 2.0
        if not quoted and ch in _QUOTES and before.isalpha() and word[i + 1 : i + 2].isalpha():
            quoted = 0.9  # quotation marks between letters: a missing blank, or a letter
        if before and before in "âãäåæçèéÐÑØÙà" and ch in _AFTER_LEADS:
            cost += 2.0
        if 0x300 <= o < 0x370:
            cost += 0.5 if before.isalpha() and ch in _ACCENTS else 3.0
        if ch in "¼½¾" and before.isalpha():
            cost += 3.0
        if ch == "ß" and (not before or before.lower() in "bcdfghjklmnpqrstvwxz"):
            cost += 2.5
        before = ch
    return cost + quoted


def _of_letters() -> str:
    """The pattern of what the mappings make of letters, from their tables: pairs that UTF-8 letters are read as, and characters
    that stand for a letter beside others. Letters of Western and Russian words count by their neighbours only, signs that words
    may hold or end with only where the cost of a word counts them."""
    found = []
    for codec in UTF8_READ_BY:
        of = {b: chr(point) for point, b in _byte_of(codec).items()}
        found.append(_class({of[b] for b in range(0xC2, 0xC6)}) + _class({of[b] for b in range(0x80, 0xC0)}))
    made = {chr(p) for pair in SINGLE_BYTE for p, c in _remap(*pair).items() if c.isalpha() and chr(p) != c}
    greek = {c for c in made if _script(c) == "Greek"}
    plain = {c for c in made - greek if c.isalpha() and c not in _FOR_LETTERS and _alone(c) < GAIN and _script(c) in ("Latin", "Cyrillic")}
    inner = {c for c in made if c in _EDGE and c not in _INNER}
    other = made - greek - plain - inner - _INNER | _FOR_LETTERS
    found += [
        rf"(?<=\p{{L}}){_class(other)}|{_class(other)}(?=\p{{L}})",
        rf"(?<=\p{{L}}){_class(inner)}(?=\p{{L}})",
        rf"\p{{IsLatin}}{{2}}{_class(greek)}|{_class(greek)}\p{{IsLatin}}{{2}}|\p{{IsLatin}}{_class(greek)}\p{{IsLatin}}",  # not single letters: kΩ, σx
        r"\p{IsLatin}{2}\p{IsCyrillic}|\p{IsCyrillic}\p{IsLatin}{2}|\p{IsLatin}\p{IsCyrillic}\p{IsLatin}",
        r"(?<![\p{L}])ß(?=\p{L})|(?<=[bcdfghjklmnpqrstvwxzBCDFGHJKLMNPQRSTVWXZ])ß",
    ]
    return "|".join(found)


SUSPECT += "|" + _of_letters()
_MISREAD = set("þªº@°")  # what scans make of letters; no evidence of a wrong mapping
#: A text of these characters only holds no garbled word: no step changes ASCII, escapes and question marks apart, and the
#: rest is letters that :func:`restored_word` never doubts or signs that cost nothing wherever they stand.
_CLEAR = {chr(o) for o in range(0x20, 0x7F)} - set("?&\\=") | set("\t\n\r")
_CLEAR |= {c for c in _FREQUENT if c.islower()} | _MISREAD - {"þ"} | {c for c in _EDGE & _INNER if _alone(c) == 0 and c not in _FOR_LETTERS | _AFTER_LEADS}
PLAIN = rf"\A{_class(_CLEAR)}*+\z"


def suspect(text: Column) -> Column:
    """Whether a text may be garbled: most are plain, which one pass over a set of characters tells; the others meet the patterns."""
    return (~text.rlike(PLAIN) | text.rlike("%[0-9A-F]{2}%")) & text.rlike(SUSPECT)


@lru_cache(maxsize=200_000)
def restored_word(word: str) -> tuple[str, bool]:
    """The cheapest text reachable from a word, and whether it is cheaper by more than :data:`GAIN`."""
    start = implausibility(word)
    escaped = bool(_ESCAPE.search(word))
    if not escaped and (start < GAIN or all(c.isascii() or c in _MISREAD or c in _FREQUENT and c.islower() for c in word)):
        return word, False
    least = unavoidable(word, escaped)
    best, best_cost = word, start - GAIN  # what is not cheaper than that is no restoration
    queue: list[tuple[float, int, int, str, bool]] = [(start, 0, 0, word, False)]
    seen, n = {hash((word, False))}, 0
    while queue:
        cost, _, depth, text, changed = heapq.heappop(queue)
        if cost < best_cost - 1e-9:
            best, best_cost = text, cost
        if least + STEP * (depth + 1) >= best_cost - 1e-9:  # nothing that follows can be cheaper
            continue
        for other, by_change in neighbours(text, changed):
            h = hash((other, by_change))
            if other == text or h in seen:
                continue
            seen.add(h)
            n += 1
            heapq.heappush(queue, (implausibility(other) + STEP * (depth + 1), n, depth + 1, other, by_change))
    return best, best != word


_WORDS = re.compile(r"[^ \t\n\r]+")
_LOST = re.compile(r"�|[\x00-\x08\x0b\x0e-\x1f]")
_ASKED_INSIDE = re.compile(r"[a-záéíóúñçãõâêôàäöüß]\?[a-záéíóúñçãõâêôàäöüß]|(?:^|[\s«“\"(])\?[a-záéíóúñA-Z]")
_ASKED_AFTER = re.compile(r"[a-z]\? [a-z]")
_ASKED_CAPITALS = re.compile(r"(?<![A-Z?])([A-ZÁÉÍÓÚÑ]+)\?([A-ZÁÉÍÓÚÑ]+)")


def _question_marks(text: str) -> bool:
    """Whether question marks stand for letters: inside or before a word, or after one in the middle of a sentence."""
    if "?" not in text:
        return False
    if _ASKED_INSIDE.search(text):
        return True
    for m in _ASKED_AFTER.finditer(text):
        if "¿" not in text[max(0, m.start() - 300) : m.start()]:
            return True
    for m in _ASKED_CAPITALS.finditer(text):
        if len(m.group(2)) <= 2 and "¿" not in text[max(0, m.start() - 300) : m.start()]:
            return True
    return False


def restore(text: str, glyphs: dict[str, str] | None = None) -> tuple[str, bool, bool]:
    """(text as far as it can be restored, whether it is garbled, whether all of it could be restored)."""
    if glyphs:
        mended = text.translate({ord(k): v for k, v in glyphs.items()})
    else:
        mended = text
    garbled = mended != text
    parts, at = [], 0
    for m in _WORDS.finditer(mended):
        w = m.group()
        if w.isascii() and not _ESCAPE.search(w):
            continue
        new, changed = restored_word(w)
        if changed:
            garbled = True
            parts += (mended[at : m.start()], new)
            at = m.end()
    mended = "".join([*parts, mended[at:]])
    lost = bool(_LOST.search(mended)) or _question_marks(mended)
    return mended, garbled or lost, not lost


def aligned_restore(text: str) -> tuple[str, list[int]]:
    """The restored text and, for each of its characters, the offset of the character (or of the first of the characters) in
    ``text`` that stands for it. Characters read from UTF-8 bytes stand for as many characters as they have bytes."""
    out: list[str] = []
    offsets: list[int] = []
    at = 0

    def keep(start: int, end: int) -> None:
        out.append(text[start:end])
        offsets.extend(range(start, end))

    for m in _WORDS.finditer(text):
        w = m.group()
        if w.isascii():
            continue
        new, changed = restored_word(w)
        if not changed:
            continue
        keep(at, m.start())
        at = m.end()
        out.append(new)
        if len(new) == len(w):
            offsets.extend(range(m.start(), m.end()))
            continue
        head = 0
        while head < min(len(new), len(w)) and new[head] == w[head]:
            head += 1
        tail = 0
        while tail < min(len(new), len(w)) - head and new[-1 - tail] == w[-1 - tail]:
            tail += 1
        middle = new[head : len(new) - tail]
        sizes = [len(c.encode("utf-8", "surrogatepass")) for c in middle]
        scale = (len(w) - head - tail) / max(1, sum(sizes))  # 1 unless bytes were read wrongly more than once
        offsets.extend(range(m.start(), m.start() + head))
        done = 0
        for size in sizes:
            offsets.append(m.start() + head + round(done * scale))
            done += size
        offsets.extend(range(m.end() - tail, m.end()))
    keep(at, len(text))
    return "".join(out), offsets


# --- the tables ---


def garbled_sources(paragraphs: DataFrame, pages: DataFrame) -> DataFrame:
    """tab, rec_id and text of every suspect text: paragraphs, blocks (one row per suspect line) and logged repairs."""
    page = F.concat_ws("/", F.coalesce("document_id", F.lit("")), F.coalesce(F.col("page_number").cast("string"), F.lit("")))
    a = paragraphs.where(suspect(F.col("clean_text"))).select(
        F.lit("paragraphs").alias("tab"), F.col("paragraph_id").alias("rec_id"), F.col("clean_text").alias("text")
    )
    lines = F.transform("blocks", lambda b: F.struct(b["block_id"].alias("id"), F.filter(b["lines"]["text"], suspect).alias("texts")))
    b = (
        pages.select(page.alias("page"), F.explode(F.filter(lines, lambda x: F.size(x["texts"]) > 0)).alias("b"))
        .select("page", F.col("b.id").alias("id"), F.explode("b.texts").alias("text"))
        .select(F.lit("blocks").alias("tab"), F.concat_ws("/", "page", F.coalesce(F.col("id").cast("string"), F.lit(""))).alias("rec_id"), "text")
    )
    logged = F.filter("repair_log", lambda r: suspect(r["original_text"]))
    c = pages.select(page.alias("page"), F.explode(logged).alias("r")).select(
        F.lit("repair_log").alias("tab"),
        F.concat_ws("/", "page", F.coalesce(F.col("r.block_id").cast("string"), F.lit(""))).alias("rec_id"),
        F.col("r.original_text").alias("text"),
    )
    return a.unionByName(b).unionByName(c)


def repaired(sources: DataFrame, glyphs: dict[str, str] | None = None) -> DataFrame:
    """tab, rec_id, text, restored, complete of every garbled text. ``restored`` is null where nothing can be told."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for tab, rec, text in zip(b["tab"], b["rec_id"], b["text"], strict=True):
                new, garbled, complete = restore(text, glyphs)
                if garbled:
                    rows.append((tab, rec, text, new if new != text else None, complete))
            yield pd.DataFrame(rows, columns=["tab", "rec_id", "text", "restored", "complete"])

    return sources.mapInPandas(run, "tab string, rec_id string, text string, restored string, complete boolean")


def garbled_records(sources: DataFrame) -> DataFrame:
    """tab and rec_id of every affected record, once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            hit = [restore(t)[1] for t in b["text"]]
            yield b.loc[hit, ["tab", "rec_id"]]

    return sources.mapInPandas(run, "tab string, rec_id string").distinct()


def glyph_map(pages: DataFrame) -> dict[str, str]:
    """What control characters stand for, learned from logged repairs: the reading that most pairs of texts agree on.

    At most 32 control characters with their readings reach the driver, however many repairs there are.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [p for bad, good in zip(b["bad"], b["good"], strict=True) for p in _glyphs(bad, good)]
            yield pd.DataFrame(rows, columns=["glyph", "reading"])

    pairs = pages.select(F.explode("repair_log").alias("r")).select(F.col("r.original_text").alias("bad"), F.col("r.ocr_text").alias("good"))
    pairs = pairs.where(F.col("bad").rlike(r"[\x01-\x08\x0B\x0E-\x1F]") & F.col("good").isNotNull())
    votes = pairs.mapInPandas(run, "glyph string, reading string").groupBy("glyph", "reading").count()
    best = votes.groupBy("glyph").agg(F.max_by("reading", F.struct("count", "reading")).alias("reading"))
    return {r["glyph"]: r["reading"] for r in best.collect()}


def _glyphs(bad: str, good: str) -> Iterator[tuple[str, str]]:
    """Readings of the control characters of ``bad``, taken from the place in ``good`` between the same neighbours."""
    at = 0
    for piece in re.finditer(r"([^\x00-\x1f]{0,6})([\x01-\x08\x0b\x0e-\x1f])(?=([^\x00-\x1f]{1,6}))", bad):
        left, glyph, right = piece.groups()
        start = good.find(left, at) if left else at
        if start < 0:
            continue
        start += len(left)
        end = good.find(right, start)
        if 0 < end - start <= 4:
            yield glyph, good[start:end]
            at = end
