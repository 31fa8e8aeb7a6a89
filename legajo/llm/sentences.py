"""Sentence boundaries across languages and scripts.

A text is read once into spans (quotations, brackets, dash insertions) and a lattice of possible boundaries. In spaced
scripts the nodes are the terminators outside spans and the ends of spans whose content ends a sentence; a node is kept or
dropped by the word before it (abbreviations, initials, numbers), by what follows (small letter, capital, opening mark, list
mark), and by the sentence so far. In spaceless scripts the words around a gap come from the best path through a lattice of
dictionary words; the gap is a boundary unless the next word goes on or the last word asks for more. Full stops of these
scripts end a sentence by themselves.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from legajo.llm import encoding

#: Abbreviations after which a sentence always goes on (fixed values, small letters, without the last dot).
GO_ON = set(
    "sr sra srta srs sres dr dra drs dres ing lic gral cnel cap tte prof profa mtro arq abg mr mrs ms messrs st gen col rev hon mme mlle "
    "cf vgl bzw ca núm num nro nº art arts pág pag págs pags par párr inc lit cap sec secc abs bd hrsg ej p.ej aprox apróx "
    "cía cia fig tab vol ed eds vs aprox res dec exp reg tel av avda cll cra no nr i.e e.g z.b d.h u.a o.ä см стр рис табл ред им ул пр просп "
    "проф акад д-р г-н г-жа т.е т.д напр डॉ श्री प्रो पं सं د أ ا م".split()
) - {"no", "par", "cap", "col", "gen", "ed", "reg", "exp", "res", "dec", "ا"}
#: Abbreviations that need a number after them, and end a sentence otherwise (fixed values).
GO_ON_BEFORE_NUMBER = set("no n s p pp f ff t v c cap col par reg res dec exp lote apdo km n.º п с гл ч".split())
#: Single letters that are part of "that is", "for example" and the like with a next letter (fixed values).
_TERMINATORS = ".!?…"
_OWN_STOPS = "。！？｡।॥؟۔။។៕།።"
_CLOSERS = "»”\"’')]}」』）】》〉"
_PAIRS = {"«": "»", "“": "”", "„": "“”", "‘": "’", "(": ")", "[": "]", "{": "}", "「": "」", "『": "』", "（": "）", "【": "】", "《": "》", "‹": "›"}
_BLANK = " \t\n\r\u000b\u000c   　​﻿­  "
_MARKS = re.compile("[" + re.escape('"—–' + "".join(k + v for k, v in _PAIRS.items())) + "]")
_LIST_MARK = re.compile(r"(?:[•▪◦‣●○*]|[-–](?=\s)|\(?\d{1,3}[.)]|\(?[a-zA-Z]\)|[ivxIVX]{1,4}[.)])\s+(?=\S)")


def _caseless(ch: str) -> bool:
    """Letters of scripts without capitals."""
    return ch.isalpha() and ch.lower() == ch.upper()


def partners(text: str) -> dict[int, int]:
    """The end (exclusive) of every span by the place of its opening mark; marks without a partner are stray.

    One pass with a stack for each kind of mark, so spans may have any length; dashes look up the next mark of each kind.
    """
    found: dict[int, int] = {}
    open_marks: dict[str, list[int]] = {}  # by closing mark
    quote = -1
    dashes: dict[str, list[int]] = {"—": [], "–": []}  # dashes that may close an insertion
    openings: list[int] = []
    for m in _MARKS.finditer(text):
        i, ch = m.start(), m.group()
        before, after = text[i - 1] if i else " ", text[i + 1] if i + 1 < len(text) else " "
        if ch == '"':
            if quote >= 0 and before not in _BLANK and (not after.isalnum() or before in _TERMINATORS):
                found[quote] = i + 1
                quote = -1
            elif (before in _BLANK or before in "(«¿¡—-") and after not in _BLANK:
                quote = i
        elif ch in "—–":
            if before in _BLANK:
                openings.append(i)
            elif not after.isalnum():
                dashes[ch].append(i)
        else:
            if open_marks.get(ch):
                found[open_marks[ch].pop()] = i + 1
            elif ch in _PAIRS:
                stack = open_marks.setdefault(_PAIRS[ch][0], [])
                for closer in _PAIRS[ch][1:]:
                    open_marks[closer] = stack
                stack.append(i)
    for k, i in enumerate(openings):
        if i and i + 1 < len(text) and text[i + 1] not in _BLANK:
            at = bisect_right(dashes[text[i]], i)
            if at < len(dashes[text[i]]) and (k + 1 == len(openings) or dashes[text[i]][at] < openings[k + 1]):
                found[i] = dashes[text[i]][at] + 1
    return found


def spans(text: str) -> list[tuple[int, int]]:
    """The outermost spans of a text in order: start and end (exclusive)."""
    found: list[tuple[int, int]] = []
    for i, end in sorted(partners(text).items()):
        if (not found or i >= found[-1][1]) and (text[i] not in "—–" or not _starts_sentence(text, i)):
            found.append((i, end))
    return found


def _starts_sentence(text: str, i: int) -> bool:
    """Whether nothing but blanks lies between ``i`` and the terminator before it (or the start of the text)."""
    k = i - 1
    while k >= 0 and text[k] in _BLANK:
        k -= 1
    return k < 0 or text[k] in _TERMINATORS or text[k] in _OWN_STOPS or text[k] in ":" or (text[k] in _CLOSERS and k and text[k - 1] in _TERMINATORS)


def _word_before(text: str, dot: int) -> str:
    """The word that ends at ``dot``, with the dots inside it."""
    k = dot
    while k > 0 and (text[k - 1].isalnum() or text[k - 1] in "º-" or text[k - 1] == "." and k > 1 and text[k - 2].isalpha() or _mark(text[k - 1])):
        k -= 1
    return text[k:dot]


def _mark(ch: str) -> bool:
    return "ऀ" <= ch <= "ॿ" or "\u0e00" <= ch <= "\u0eff"  # vowel signs belong to the word


def sentence_starts(text: str) -> list[int]:
    """Offsets of the first characters of all sentences; empty for a blank text."""
    n = len(text)
    first = 0
    while first < n and text[first] in _BLANK:
        first += 1
    if first == n:
        return []
    starts = [first]
    unpunctuated = not _ANY_STOP.search(text)
    outer = spans(text) if _MARKS.search(text) else []
    k, i = 0, first
    while i < n:  # from one place that may end a sentence to the next
        event = _EVENT.search(text, i)
        here = event.start() if event else n
        while k < len(outer) and outer[k][1] <= i:
            k += 1
        if k < len(outer) and outer[k][0] <= here:
            start, end = max(i, outer[k][0]), outer[k][1]
            at = _after_span(text, start, end, starts[-1])
            if at:
                starts.append(at)
            i = at or end
            continue
        if here == n:
            break
        i = here
        ch = text[i]
        if ch in _OWN_STOPS:
            at = _next(text, _skip(text, i + 1, _OWN_STOPS + "!?"))
            if at < n and not (ch in "?!" and text[at].islower()):
                starts.append(at)
            i = max(i + 1, at)
            continue
        if ch in _TERMINATORS:
            end = _skip(text, i, _TERMINATORS)
            at = _boundary(text, i, end, starts[-1])
            if at:
                starts.append(at)
                i = at
            else:
                i = end
            continue
        at = _next(text, i)  # a blank of a spaceless script
        if at < n and _gap(text, i, at, unpunctuated):
            starts.append(at)
        i = max(at, i + 1)
    return starts


def _skip(text: str, i: int, what: str) -> int:
    while i < len(text) and text[i] in what:
        i += 1
    return i


def _next(text: str, i: int) -> int:
    while i < len(text) and text[i] in _BLANK:
        i += 1
    return i


def _opens(text: str, at: int) -> bool:
    """Whether what stands at ``at`` can open a sentence."""
    ch = text[at]
    if ch.islower():
        return bool(_LIST_MARK.match(text, at)) and text[at + 1 : at + 2] in (")", ".")
    return ch.isupper() or ch.isdigit() or _caseless(ch) or ch in "«“„\"‘([{¿¡—–-•▪◦‣●○*'「『（【《$%" or not (ch.isascii() or ch in "”»’，、；：،؛")


def _after_span(text: str, start: int, end: int, sentence: int) -> int:
    """The next sentence if the span from ``start`` to ``end`` ends its sentence, else 0."""
    inner = text[start + 1 : end - 1].rstrip(_BLANK)
    if not inner or inner[-1] not in _TERMINATORS + _OWN_STOPS or text[start] in "—–":
        return 0
    at = _next(text, end)
    if at >= len(text) or text[at] in _TERMINATORS or text[at] in _OWN_STOPS or not _opens(text, at):
        return 0
    if inner[-1] == "." and text[start] == "(" and text[at].isupper() and _word_before(inner, len(inner) - 1).lower() in GO_ON | {"etc"}:
        return 0
    if _caseless(text[at]):  # without capitals nothing tells that a sentence ends with its quotation
        return 0
    return at


def _boundary(text: str, dot: int, end: int, sentence: int) -> int:
    """The start of the next sentence if the terminators from ``dot`` to ``end`` end one, else 0."""
    n = len(text)
    stop = text[dot:end]
    closed = _skip(text, end, _CLOSERS)
    at = _next(text, closed)
    if at >= n:
        return 0
    nxt, glued = text[at], at == end
    if not _opens(text, at) or text[at] in _TERMINATORS:
        return 0
    if stop == ".":
        before = text[dot - 1] if dot else ""
        if glued and before.isdigit() and nxt.isdigit():
            return 0
        word = _word_before(text, dot)
        low = word.lower()
        if _only_list_mark(text, sentence, dot):
            return 0
        if glued and (nxt.isdigit() or nxt in "-'’"):
            return 0
        if low in GO_ON or low.rpartition(".")[2] in GO_ON and "." in low:
            return 0
        if low in GO_ON_BEFORE_NUMBER and nxt.isdigit():
            return 0
        letters = low.replace(".", "")
        if len(letters) == 1 and letters.isalpha() and not _caseless(letters):
            if glued and nxt.isupper() and text[at + 1 : at + 2] in (".", ""):
                return 0  # inside "S.A."
            if "." not in low and not glued and _spaced_pair(text, dot, at):
                return 0  # inside "a. m.", "z. B.", "т. е."
            if "." not in low and word.isupper() and nxt.isupper() and not _after_short(text, dot):
                return 0  # an initial
            if low == "г" and dot - sentence < 40 and len(text[sentence:dot].split()) <= 3:
                return 0
        if glued and nxt.isupper() and text[at + 1 : at + 2] == "." and word.isupper() and len(letters) <= 3:
            return 0
        if word.isupper() and len(letters) == 2 and letters[0] == letters[1] and text[at : at + 3].rstrip(".").isupper() and text[at + 2 : at + 3] == ".":
            return 0  # inside "EE. UU."
        if before.isdigit() and len(word) <= 2 and word.isdigit() and _ordinal(text, dot, at):
            return 0
        if _caseless(nxt) and _caseless(before) and len(word) == 1:
            return 0  # a one-letter abbreviation of a script without capitals
    elif stop in ("…", "...", "..") and nxt.isdigit():
        return 0
    return at


_MONTHS = ("januar februar märz april mai juni juli august september oktober november dezember").split()


def _ordinal(text: str, dot: int, at: int) -> bool:
    """A German ordinal, as in "am 3. März"."""
    word = re.match(r"\w+", text[at:])
    return bool(word and word.group().lower() in _MONTHS) or bool(re.search(r"\b(?:am|vom|zum|dem|den|der|im|beim)\s+\d{1,2}$", text[max(0, dot - 12) : dot], re.I))


def _only_list_mark(text: str, sentence: int, dot: int) -> bool:
    """Whether the sentence so far is just "1" or "a" or "IV", so that the dot belongs to a list mark."""
    if dot - sentence > 20:
        return False
    head = text[sentence:dot].strip(_BLANK + "(")
    return len(head) <= 4 and (head.isdigit() or len(head) == 1 and head.isalpha() or bool(re.fullmatch(r"[ivxIVX]{1,4}", head)))


def _spaced_pair(text: str, dot: int, at: int) -> bool:
    """Whether another single letter with a dot follows, as in "z. B." or "т. е."."""
    if at + 1 >= len(text) or not text[at].isalpha() or text[at + 1] != ".":
        return False
    return not text[at].isupper() or text[dot - 1].islower()


def _after_short(text: str, dot: int) -> bool:
    """Whether the single letter before ``dot`` ends a dotted or spaced abbreviation rather than being an initial."""
    return text[max(0, dot - 2) : dot - 1] == "." or bool(re.search(r"\b[a-z]\. ?[a-z]$", text[max(0, dot - 5) : dot]))


# --- spaceless scripts ---

#: Words that carry a Thai sentence on after a gap, that ask for more before one, and that open a sentence (fixed values).
THAI_GO_ON = ("โดย", "ตาม", "ก่อน", "หลัง", "เป็น", "จาก", "และ", "หรือ", "ที่", "ซึ่ง", "เพื่อ", "เพราะ", "แต่", "ด้วย", "กับ", "แก่", "ให้", "ถึง", "ต่อ", "ใน", "รายการ",
              "ฉบับ", "คน", "บาท", "ครั้ง", "ราย", "แห่ง", "ปี", "วัน", "ว่า", "จำนวน", "เมื่อวันที่")
THAI_MORE = ("โดย", "ตาม", "จาก", "เป็น", "และ", "หรือ", "ที่", "ซึ่ง", "เพื่อ", "เพราะ", "แต่", "กับ", "จำนวน", "ใน", "ปี", "ของ", "ไม่", "ได้")
THAI_OPEN = ("ในปี", "ใน พ.ศ.", "ดัชนี", "การ", "กรม", "คณะ", "สำนักงาน", "กระทรวง", "บริษัท", "ผู้", "นาย", "นาง", "รายงาน", "เมื่อ", "ทำไม", "อย่างไรก็ตาม")
#: The same for Lao (fixed values).
LAO_GO_ON = ("ໂດຍ", "ຕາມ", "ກ່ອນ", "ຫຼັງ", "ເປັນ", "ຈາກ", "ແລະ", "ຫຼື", "ທີ່", "ຊຶ່ງ", "ເພື່ອ", "ເພາະ", "ແຕ່", "ດ້ວຍ", "ກັບ", "ໃຫ້", "ເຖິງ", "ຕໍ່", "ໃນ", "ຄົນ", "ກີບ", "ຄັ້ງ", "ແຫ່ງ", "ປີ", "ວັນ", "ວ່າ", "ຈຳນວນ")
LAO_MORE = ("ໂດຍ", "ຕາມ", "ຈາກ", "ເປັນ", "ແລະ", "ຫຼື", "ທີ່", "ຊຶ່ງ", "ເພື່ອ", "ເພາະ", "ແຕ່", "ກັບ", "ຈຳນວນ", "ໃນ", "ປີ", "ຂອງ", "ບໍ່", "ໄດ້")
LAO_OPEN = ("ໃນປີ", "ການ", "ກົມ", "ຄະນະ", "ສຳນັກງານ", "ກະຊວງ", "ບໍລິສັດ", "ຜູ້", "ທ່ານ", "ລາຍງານ", "ເມື່ອ", "ເປັນຫຍັງ", "ແນວໃດກໍຕາມ")
#: Endings of sentences in Chinese and Japanese that have no stops (fixed values).
FINALS = ("了", "吗", "呢", "吧", "啊", "嘛", "です", "ます", "した", "った", "だ", "ない", "ません", "である", "いる", "れる", "する", "か", "ね", "よ")
_GO_ON, _MORE, _OPEN = {*THAI_GO_ON, *LAO_GO_ON}, {*THAI_MORE, *LAO_MORE}, (*THAI_OPEN, *LAO_OPEN)
_LEXICON = frozenset({*_GO_ON, *_MORE, *_OPEN})
_LENGTHS = sorted({len(w) for w in _LEXICON})
_SCRIPT_RUN = re.compile("[\u0e00-\u0eff]+")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff]")
#: Where a sentence may end: terminators, and blanks after letters of spaceless scripts.
_EVENT = re.compile("[" + re.escape(_TERMINATORS + _OWN_STOPS) + "]|(?<=[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff])[" + re.escape(_BLANK) + "]")
_ANY_STOP = re.compile("[" + re.escape(_TERMINATORS + _OWN_STOPS) + "]")


@lru_cache(maxsize=2_000)
def lattice_words(run: str) -> list[str]:
    """The cheapest path through the lattice of dictionary words of a run: known words cost 1, other characters 2 each."""
    n = len(run)
    cost, back = [0.0] + [9e9] * n, [0] * (n + 1)
    for i in range(n):
        if cost[i] + 2 < cost[i + 1]:
            cost[i + 1], back[i + 1] = cost[i] + 2, i
        for k in _LENGTHS:
            if run[i : i + k] in _LEXICON and i + k <= n and cost[i] + 1 < cost[i + k]:
                cost[i + k], back[i + k] = cost[i] + 1, i
    words, i = [], n
    while i:
        words.append(run[back[i] : i])
        i = back[i]
    return words[::-1]


def _gap(text: str, gap: int, at: int, unpunctuated: bool) -> bool:
    """Whether a blank between words of a spaceless script ends a sentence; the whole runs on both sides are segmented."""
    if _CJK.match(text[gap - 1]):  # scripts with stops of their own: only where the text uses none
        return unpunctuated and text[:gap].endswith(FINALS) and bool(_CJK.match(text[at]))
    following = _SCRIPT_RUN.match(text, at)
    if not following:
        return text[at].isupper() or text[at] in "“«"
    if following.group().startswith(_OPEN):
        return True
    left = gap
    while left > 0 and "\u0e00" <= text[left - 1] <= "\u0eff":
        left -= 1
    after, before = lattice_words(following.group()), lattice_words(text[left:gap])
    return after[0] not in _GO_ON and not (before and before[-1] in _MORE)


# --- tables ---


def sentences(df: DataFrame, key: str, text: str, whole: Column | None = None) -> DataFrame:
    """rec_id, sent_no (from 1), start_pos (0-based) and sentence of every text that is not blank.

    ``whole`` marks rows that are one sentence whatever they hold (headings). Repeated deliveries give equal rows; the
    caller drops them after choosing columns. Each text is read once, wherever it lies: no shuffle.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows: list[tuple] = []
            for rec, t, one, bad in zip(b["rec_id"], b["text"], b["whole"], b["bad"], strict=True):
                if bad:  # read as it was meant, told as it stands
                    mended, offsets = encoding.aligned_restore(t)
                    starts = [offsets[s] for s in sentence_starts(mended)]
                else:
                    starts = sentence_starts(t)
                if not starts:
                    continue
                if one:
                    starts = starts[:1]
                ends = [*starts[1:], len(t)]
                rows += [(rec, no, s, t[s:e].rstrip(_BLANK)) for no, (s, e) in enumerate(zip(starts, ends, strict=True), 1)]
                if len(rows) > 20_000:
                    yield pd.DataFrame(rows, columns=["rec_id", "sent_no", "start_pos", "sentence"])
                    rows = []
            yield pd.DataFrame(rows, columns=["rec_id", "sent_no", "start_pos", "sentence"])

    one = F.coalesce(whole, F.lit(False)) if whole is not None else F.lit(False)
    content = F.col(f"`{text}`")
    read = df.where(content.isNotNull()).select(
        F.col(f"`{key}`").alias("rec_id"), content.alias("text"), one.alias("whole"), encoding.suspect(content).alias("bad")
    )
    return read.mapInPandas(run, "rec_id string, sent_no int, start_pos int, sentence string")


def sentence_units(paragraphs: DataFrame, causal: DataFrame) -> DataFrame:
    """Sentences of both tables."""
    heading = F.col("block_type").isin("heading", "subheading")
    return sentences(paragraphs, "paragraph_id", "clean_text", heading).unionByName(sentences(causal, "sentence_id", "text"))
