"""Several values packed in one field, unpacked to one row per value with its position.

The field is split on its structural quotes, so that the pieces with odd numbers are literals and the pieces with even
numbers are plain text. Plain pieces are split on delimiters, literal pieces are unescaped, and an array fold (`flatten`,
linear in the number of values) puts the values back in order. Everything is a built-in expression: no shuffle, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Delimiters that separate values wherever they stand outside quotes (fixed values).
DELIMITERS = ";|,\t\r\n；、·，"
#: Marks that may stand before a value of a list (fixed values).
LIST_MARKS = "•▪◦‣●○*"

_CUT = "\ue010"  # stands where a structural quote stood
_INNER_DOUBLE = "\ue011"  # an escaped double quote inside a literal
_INNER_SINGLE = "\ue012"  # an escaped single quote inside a literal

_STOP = rf"\[\({{/{DELIMITERS}{LIST_MARKS}"
_OPENS = rf"(?<=^|[{_STOP}]|\sy|\s[-–—])(\s*)"
_CLOSES = rf"(?=\s*(?:$|[\])}}/{DELIMITERS}]|y\s))"
# The loops run once per inner quote, not once per character, so that very long fields do not exhaust the regex stack.
_LITERAL = (
    _OPENS
    + r"(?:\"([^\"]*+(?:\"\"[^\"]*+)*+)\""
    + rf"|'([^']*+(?:'(?!{_CLOSES[3:]}[^']*+)*+)'"
    + r"|“([^”]*+)”|«([^»]*+)»)"
    + _CLOSES
)
_BETWEEN = (
    rf"[{DELIMITERS.replace(',', '').replace('，', '')}]"
    r"|(?<![0-9])[,，]|[,，](?![0-9])"
    r"|(?:^|\s)/(?=\s|$)|(?:^|\s)y(?=\s|$)"
)
_MARK = rf"^\s*(?:[{LIST_MARKS}]+|[-–—](?=\s)|\(?[0-9]{{1,3}}[.)](?=\s)|[A-Za-z]\)(?=\s))\s*"


def packed_values(text: Column) -> Column:
    """The values of a packed field as an array of strings, in order.

    Null gives null; a field without values gives an empty array. Values are trimmed and keep case and spelling; repeated
    values stay; empty ones are dropped. Brackets around the whole field, list marks and quotes are removed; a doubled or
    escaped quote inside quotes stands for one. A comma between two digits belongs to the value. A quote that does not
    open or close a value (an apostrophe, an unmatched quote) is kept as text.
    """
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    t = F.regexp_replace(t, r'\\"', _INNER_DOUBLE)
    t = F.regexp_replace(t, r"\\'", _INNER_SINGLE)
    for a, b in ((r"\[", r"\]"), (r"\(", r"\)"), (r"\{", r"\}")):
        t = F.regexp_replace(t, rf"^{a}([^{a}{b}]*){b}$", "$1")
    t = F.regexp_replace(t, _LITERAL, f"$1{_CUT}$2$3$4$5{_CUT}")
    pieces = F.split(t, _CUT)

    def plain(piece: Column) -> Column:
        return F.transform(F.split(piece, _BETWEEN), lambda v: F.regexp_replace(v, _MARK, ""))

    def literal(piece: Column) -> Column:
        return F.array(F.regexp_replace(piece, '""', '"'))

    parts = F.transform(pieces, lambda piece, i: F.when(i % 2 == 1, literal(piece)).otherwise(plain(piece)))
    values = F.transform(
        F.flatten(parts),
        lambda v: F.regexp_replace(F.translate(v, _INNER_DOUBLE + _INNER_SINGLE, "\"'"), r"^\s+|\s+$", ""),
    )
    return F.filter(values, lambda v: v != "")


def unpack(df: DataFrame, keys: dict[str, Column], fields: list[str]) -> DataFrame:
    """One row per value of ``fields``: the columns of ``keys``, then fld, pos (from 1) and val.

    All fields are read in one pass over ``df``. Rows whose field is null, empty or without a value give no row. Repeated
    rows of ``df`` give repeated rows; other columns of ``df`` are not carried, so they can not clash.
    """
    packed = F.array(*[F.struct(F.lit(f).alias("fld"), packed_values(F.col(f"`{f}`")).alias("vals")) for f in fields])
    rows = df.select(*[c.alias(k) for k, c in keys.items()], F.explode(packed).alias("_p"))
    return rows.select(*keys, F.col("_p.fld").alias("fld"), F.posexplode("_p.vals").alias("_i", "val")).select(
        *keys, "fld", (F.col("_i") + 1).alias("pos"), "val"
    )


def packed_found(claims: DataFrame, ledger: DataFrame) -> DataFrame:
    """All values of the packed fields of claims and ledger: tab, rec_id, fld, pos, val; a repeated delivery counts once."""
    a = unpack(claims, {"tab": F.lit("claims"), "rec_id": F.col("claim_id")}, ["cues", "evidence_source_ids", "context_flags"])
    b = unpack(ledger, {"tab": F.lit("ledger"), "rec_id": F.col("source_id")}, ["claim_ids"])
    return a.unionByName(b).distinct()
