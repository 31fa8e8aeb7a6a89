"""A grammar of quantities in Spanish and English text: numbers, scale words, unit expressions and dimensions.

    quantity   := currency number scale? | number scale? "de"? unit | ratio-noun "de" number
    unit       := factor ("/" factor)*            factor := prefix? atom power?

A unit is a vector of exponents over base dimensions with an exact scale to them, so that "kWh", "kilovatios hora" and
"gigajulios" meet in mass * length^2 / time^2 without a table of pairs. Values are fractions; nothing is rounded before
the caller asks.
"""

from __future__ import annotations

import re
import unicodedata
from fractions import Fraction
from functools import lru_cache

#: The base dimensions; a vector holds one exponent for each.
BASES = ("length", "mass", "time", "cop", "usd", "count", "ratio", "temperature")

Vector = tuple[int, ...]


def _v(**exponents: int) -> Vector:
    return tuple(exponents.get(b, 0) for b in BASES)


_LENGTH, _MASS, _TIME = _v(length=1), _v(mass=1), _v(time=1)
_AREA, _VOLUME = _v(length=2), _v(length=3)
_POWER, _ENERGY = _v(mass=1, length=2, time=-3), _v(mass=1, length=2, time=-2)
_COUNT, _RATIO, _COP, _USD = _v(count=1), _v(ratio=1), _v(cop=1), _v(usd=1)

F_ = Fraction
_TEMPERATURE = _v(temperature=1)
#: Units with another zero, as they are folded: scale and offset to kelvin (fixed values). They stand alone, without powers.
TEMPERATURES: dict[str, tuple[Fraction, Fraction]] = {
    **dict.fromkeys(("k", "kelvin", "kelvins"), (F_(1), F_(0))),
    **dict.fromkeys(("°c", "º c", "ºc", "° c", "celsius", "grados celsius", "grado celsius", "grados centigrados", "grado centigrado", "degrees celsius"), (F_(1), F_("273.15"))),
    **dict.fromkeys(("°f", "º f", "ºf", "° f", "fahrenheit", "grados fahrenheit", "grado fahrenheit", "degrees fahrenheit"), (F_(5, 9), F_("459.67") * F_(5, 9))),
}
# Words and symbols of units, as they are folded (lower case, no accents), with scale and dimension.
ATOMS: dict[str, tuple[Fraction, Vector]] = {}


def _atoms(scale: str | Fraction, vector: Vector, *names: str) -> None:
    for n in names:
        ATOMS[n] = (F_(scale), vector)


_atoms("1", _LENGTH, "m", "mt", "mts", "ml", "m.l", "metro", "metros", "meter", "meters", "metre", "metres")
_atoms("1609.344", _LENGTH, "mi", "milla", "millas", "mile", "miles (length)")
_atoms("0.3048", _LENGTH, "ft", "pie", "pies", "foot", "feet")
_atoms("4046.8564224", _AREA, "ac", "acre", "acres")
_atoms("10000", _AREA, "ha", "has", "hect", "hectarea", "hectareas", "hectare", "hectares")
_atoms("6400", _AREA, "fg", "fanegada", "fanegadas")
_atoms("0.001", _VOLUME, "l", "lt", "lts", "litro", "litros", "liter", "liters", "litre", "litres")
_atoms("0.158987294928", _VOLUME, "bbl", "bbls", "barril", "barriles", "barrel", "barrels")
_atoms("0.003785411784", _VOLUME, "gal", "gals", "gls", "gl", "galon", "galones", "gallon", "gallons")
_atoms("0.001", _MASS, "g", "gr", "grs", "gramo", "gramos", "gram", "grams")
_atoms("1000", _MASS, "t", "tm", "ton", "tons", "tonelada", "toneladas", "tonne", "tonnes", "metric ton", "metric tons", "tonelada metrica",
       "toneladas metricas")
_atoms("1", _MASS, "kilo", "kilos", "kgs")
_atoms("0.45359237", _MASS, "lb", "lbs", "libra", "libras", "pound", "pounds")
_atoms("1", _TIME, "s", "seg", "segundo", "segundos", "second", "seconds")
_atoms("60", _TIME, "min", "mins", "minuto", "minutos", "minute", "minutes")
_atoms("3600", _TIME, "h", "hr", "hrs", "hora", "horas", "hour", "hours")
_atoms("86400", _TIME, "d", "dia", "dias", "day", "days", "dia calendario", "dias calendario", "calendar day", "calendar days")
_atoms("604800", _TIME, "sem", "sems", "semana", "semanas", "week", "weeks")
_atoms("1", _POWER, "w", "vatio", "vatios", "watt", "watts")
_atoms("1", _ENERGY, "j", "julio", "julios", "joule", "joules")
_atoms("1", _COP, "cop", "$", "peso", "pesos", "pesos m/cte", "peso colombiano", "pesos colombianos", "colombian peso", "colombian pesos")
_atoms("1", _USD, "usd", "us$", "u$s", "dolar", "dolares", "dolar estadounidense", "dolares estadounidenses", "dollar", "dollars", "us dollars")
_atoms("1", _RATIO, "tanto por uno", "fraccion", "proporcion", "fraction", "proportion", "ratio")
_atoms("0.01", _RATIO, "%", "por ciento", "porciento", "por cien", "porcentaje", "pct", "percent", "per cent", "percentage", "punto porcentual",
       "puntos porcentuales", "percentage point", "percentage points")
_atoms("0.001", _RATIO, "‰", "por mil", "per mil", "per mille", "tanto por mil", "x 1000", "x1000")
_atoms("0.0001", _RATIO, "bp", "bps", "pb", "p.b", "pbs", "punto basico", "puntos basicos", "basis point", "basis points")
_atoms("1", _COUNT, "ea", "unidad", "unidades", "unit", "units", "persona", "personas", "usuario", "usuarios", "contrato", "contratos", "person",
       "persons", "people", "user", "users", "contract", "contracts", "habitante", "habitantes", "beneficiario", "beneficiarios",
       "suscriptor", "suscriptores", "hogar", "hogares", "inhabitants", "households")

#: Metric prefixes (fixed values): symbols for the symbols, words for the words.
PREFIX_SYMBOLS = {"k": 10**3, "h": 10**2, "da": 10, "d": F_(1, 10), "c": F_(1, 100), "m": F_(1, 1000), "M": 10**6, "G": 10**9, "T": 10**12}
PREFIX_WORDS = {"kilo": 10**3, "hecto": 10**2, "deca": 10, "deci": F_(1, 10), "centi": F_(1, 100), "mili": F_(1, 1000), "mega": 10**6,
                "giga": 10**9, "tera": 10**12}
_PREFIXABLE = {"m": "kdcmh", "mt": "k", "mts": "k", "l": "hdcmk", "g": "kdcmh", "t": "kM", "w": "kMGT", "j": "kMGT", "ms": "k"}
_PREFIXABLE_WORDS = ("metro", "metros", "litro", "litros", "gramo", "gramos", "tonelada", "toneladas", "vatio", "vatios", "watt", "watts",
                     "julio", "julios", "joule", "joules", "meter", "meters", "metre", "metres", "liter", "liters", "gram", "grams")
_POWERS = {"2": 2, "²": 2, "3": 3, "³": 3, "cuadrado": 2, "cuadrados": 2, "cuadrada": 2, "cuadradas": 2, "cubico": 3, "cubicos": 3,
           "lineal": 1, "lineales": 1}
_PERIODS = ("ano", "anos", "mes", "meses", "year", "month", "dia", "hora", "h", "a")

#: Scale words (fixed values). A Spanish billón is 10^12, an English billion 10^9.
SCALES_ES = {"mil": 10**3, "miles": 10**3, "millon": 10**6, "millones": 10**6, "mill": 10**6, "mm": 10**6, "mil millones": 10**9,
             "miles de millones": 10**9, "billon": 10**12, "billones": 10**12, "trillon": 10**18, "trillones": 10**18}
SCALES_EN = {"thousand": 10**3, "thousands": 10**3, "million": 10**6, "millions": 10**6, "mn": 10**6, "m": 10**6, "billion": 10**9,
             "billions": 10**9, "bn": 10**9, "trillion": 10**12, "k": 10**3}
SCALES = SCALES_ES | {k: v for k, v in SCALES_EN.items() if k not in ("m", "k")}

#: Number words (fixed values).
_ONES_ES = ("cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciseis diecisiete dieciocho "
            "diecinueve veinte veintiuno veintidos veintitres veinticuatro veinticinco veintiseis veintisiete veintiocho veintinueve").split()  # fmt: skip
_ONES_EN = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen "
            "nineteen twenty").split()  # fmt: skip
_TENS = {"treinta": 30, "cuarenta": 40, "cincuenta": 50, "sesenta": 60, "setenta": 70, "ochenta": 80, "noventa": 90, "thirty": 30,
         "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90, "cien": 100, "ciento": 100, "doscientos": 200,
         "trescientos": 300, "cuatrocientos": 400, "quinientos": 500, "seiscientos": 600, "setecientos": 700, "ochocientos": 800,
         "novecientos": 900}
NUMBER_WORDS = {w: i for i, w in enumerate(_ONES_ES)} | {w: i for i, w in enumerate(_ONES_EN)} | _TENS | {"un": 1, "una": 1, "veintiun": 21}


def fold(text: str) -> str:
    """Lower case without accents, same length for the letters used here (superscripts and signs stay)."""
    out = []
    for ch in text:
        d = unicodedata.normalize("NFD", ch)
        out.append(d[0] if len(d) > 1 and unicodedata.combining(d[1]) else ch)
    return "".join(out).lower()


def times(a: Vector, n: int) -> Vector:
    return tuple(x * n for x in a)


def plus(a: Vector, b: Vector) -> Vector:
    return tuple(x + y for x, y in zip(a, b, strict=True))


@lru_cache(maxsize=20_000)
def parse_factor(text: str) -> tuple[Fraction, Vector] | None:
    """One factor of a unit: prefix, atom and power, as a symbol ("km2") or in words ("kilómetros cuadrados")."""
    raw = re.sub(r"\s+", " ", text.strip().rstrip("."))
    f = fold(raw)
    if raw == "Mt":  # a megatonne; "mt" is a metre
        return F_(10**9), _MASS
    if f in ATOMS:
        return ATOMS[f]
    if f in TEMPERATURES and (f != "k" or raw == "K"):
        return TEMPERATURES[f][0], _TEMPERATURE
    words = f.split(" ")
    if len(words) > 1 and words[-1] in _POWERS:
        base = parse_factor(" ".join(words[:-1]))
        n = _POWERS[words[-1]]
        return base and (base[0] ** n, times(base[1], n))
    if len(words) == 2 and (a := parse_factor(words[0])) and (b := parse_factor(words[1])):
        if b[1] == _TIME and a[1] == _POWER:  # "kilovatios hora": a product
            return a[0] * b[0], plus(a[1], b[1])
        return None
    if m := re.fullmatch(r"(.*\D)([23²³])", f):
        base = parse_factor(raw[: m.end(1)])
        n = _POWERS[m.group(2)]
        return base and (base[0] ** n, times(base[1], n))
    for p, k in PREFIX_WORDS.items():
        if f.startswith(p) and f[len(p) :] in _PREFIXABLE_WORDS:
            s, v = ATOMS[f[len(p) :]]
            return s * k, v
    if m := re.fullmatch(r"([kMGTmgt]?)(w)(h)", f):  # watt hours: "kwh", "MWh"
        return F_({"": 1, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}[m.group(1)]) * 3600, _ENERGY
    if m := re.fullmatch(r"(k|h|d|c|m|g|t)(mts|mt|ms|m|l|g|t|w|j)", f):
        p, a = m.groups()
        if p in _PREFIXABLE[a].lower():
            k = {"k": 10**3, "h": 10**2, "d": F_(1, 10), "c": F_(1, 100), "g": 10**9, "t": 10**12}.get(p)
            if p == "m":
                k = 10**6 if a in "wjt" or raw[0] == "M" else F_(1, 1000)
            s, v = ATOMS["m" if a == "ms" else a]
            return s * F_(k), v
    return None


@lru_cache(maxsize=20_000)
def parse_unit(text: str) -> tuple[Fraction, Vector] | None:
    """A unit with an optional scale word and currency, such as "miles de millones COP" or "GWh/año": scale and vector."""
    t = re.sub(r"\s+", " ", text.strip())
    if not t:
        return None
    if whole := parse_factor(t):
        return whole
    f = fold(t)
    if "/" in t:
        head, _, tail = t.rpartition("/")
        if fold(tail.strip()) in _PERIODS:  # "per year" says when, not what
            return parse_unit(head)
    f2 = re.sub(r"[()]", " ", f)
    f2 = re.sub(r"\s+", " ", f2).strip().rstrip(".")
    words = f2.split(" ")
    for i in range(len(words), 0, -1):  # scale word first: "miles de toneladas"
        k = SCALES.get(" ".join(words[:i]).rstrip("."))
        if k:
            rest = words[i + 1 :] if words[i : i + 1] == ["de"] else words[i:]
            if not rest:
                return F_(k), _COUNT
            unit = parse_unit(" ".join(rest))
            return unit and (unit[0] * k, unit[1])
    for i in range(1, len(words)):  # currency first: "COP miles", "US$ m"
        unit = ATOMS.get(" ".join(words[:i]))
        tail = " ".join(words[i:]).rstrip(".")
        k = SCALES.get(tail) or SCALES_EN.get(tail)
        if unit and k:
            return unit[0] * k, unit[1]
    return None


_NBSP = "   "
_NUM = (
    rf"(?<![\d.,/\-])(?:\d{{1,3}}(?:[ {_NBSP}]\d{{3}})+(?:,\d+)?|\d{{1,3}}(?:\.\d{{3}}){{2,}}(?:,\d+)?|\d{{1,3}}(?:,\d{{3}}){{2,}}(?:\.\d+)?"
    r"|\d{1,3}\.\d{3},\d+|\d{1,3},\d{3}\.\d+|\d+(?:[.,]\d+)?)(?![\d/])"
)
_WORD_NUM = rf"(?<!\w)(?:{'|'.join(sorted(NUMBER_WORDS, key=len, reverse=True))})(?:\s+y\s+(?:{'|'.join(_ONES_ES[1:10])}))?(?!\w)"
_SCALE = r"(?:miles\s+de\s+millones|mil\s+millones|mil|miles|mill(?:on(?:es)?|\.)?|billon(?:es)?|trillon(?:es)?|thousand|millions?|billions?|trillion|bn|mn)"


def _alternation(names) -> str:
    return "|".join(re.escape(n).replace(r"\ ", r"\s+") for n in sorted(names, key=len, reverse=True))


_PREFIXED = sorted({p + w for p in PREFIX_WORDS for w in _PREFIXABLE_WORDS}, key=len, reverse=True)
_SYMBOLS = ["kms", "kmts", "km", "hm", "dm", "cm", "mm", "kg", "mg", "kt", "Mt", "kw", "mw", "gw", "tw", "kj", "mj", "gj", "tj", "hl", "ml", "kl",
            "kwh", "mwh", "gwh", "twh", "wh"]
_TEXT_ATOMS = [a for a in ATOMS if a not in ("$", "cop", "usd", "us$", "u$s", "ml", "d", "fg", "ea", "g", "s", "w", "j", "mi", "gl", "ratio", "sem",
                                             "fraccion", "proporcion", "fraction", "proportion", "tanto por uno", "miles (length)")] + ["miles"]
_UNIT = (
    rf"(?:(?:{_alternation([*_PREFIXED, *_TEXT_ATOMS, *_SYMBOLS])})"
    r"(?:\s+(?:cuadrad[oa]s?|cubicos?|lineal(?:es)?)|\s+hora|[23²³])?(?:/(?:ano|mes|year|month))?)"
)
_TAIL = r"(?![\w²³$%])"
_CUR = r"(?:us\$|u\$s|usd|cop|\$)"
_WITH_CURRENCY = re.compile(rf"(?P<cur>{_CUR})\s*(?P<num>{_NUM}|{_WORD_NUM})(?:\s*(?P<scale>{_SCALE}){_TAIL})?")
_WITH_UNIT = re.compile(
    rf"(?P<num>{_NUM}|{_WORD_NUM})(?:\s+(?P<scale>{_SCALE})(?:\s+de)?(?=\s+(?:{_UNIT}){_TAIL}))?\s*(?P<unit>{_UNIT}|{_CUR}){_TAIL}"
)
_DEGREES = re.compile(
    rf"(?P<sign>(?<![\w.,])[-−–]\s?)?(?<![\d.,/])(?P<num>\d+(?:[.,]\d+)?)\s*(?P<unit>{_alternation(u for u in TEMPERATURES if u != 'k')})(?!\w)"
)
_RATIO_OF = re.compile(rf"(?:fraccion|proporcion|fraction|proportion)\s+(?:de|of)\s+(?P<num>{_NUM})")
#: What looks like a quantity but is a reference, a date or a clock time (fixed values).
_MASK = re.compile(
    rf"(?:\b(?:ley|decreto|resolucion|res\.|acuerdo|articulos?|arts?\.|pags?\.|paginas?|num\.|numero|nro\.|no\.|n\.º|oficio|anexo|sec\.|"
    rf"section|page|version|coeficiente|folio|tomo)\s*(?:num\.\s*|no\.\s*)?{_NUM}(?:\s+(?:y|de|a|and)\s+\d+)?)"
    r"|(?:\d{1,2}\s+de\s+(?:enero|febrero|marzo|abril|mayo|junio|julio|agosto|sep?tiembre|octubre|noviembre|diciembre)(?:\s+(?:de|del)\s+\d{4})?)"
    r"|(?:\ba\s+las?\s+\d{1,2}(?:[:.]\d{2})?\s*(?:h(?:oras|rs|r)?\b)?(?:\s*[ap]\.\s*m\.)?)"
    r"|(?:\b\d{1,2}:\d{2}(?:\s*h(?:oras|rs)?\b)?)|(?:\b\d{1,2}\s*[ap]\.?\s?m\.)"
    r"|(?:\b\d{1,4}[-/]\d{1,2}[-/]\d{1,4}\b)|(?:\b(?:en|in|de|since|desde|hasta|entre|year|ano)\s+(?:19|20)\d{2}(?:\s+(?:y|a|and)\s+(?:19|20)\d{2})?(?![\d.,]))"
)
_ENGLISH = re.compile(r"\b(?:the|of|was|in the|according to|stood at|signed|with|and|for)\b")
_SPANISH = re.compile(r"\b(?:el|la|los|las|de|del|en|se|por|para|con|segun|fue|un|una)\b")


def parse_number(text: str, english: bool = False) -> Fraction | None:
    """A number in digits or words. A single separator before exactly three digits groups thousands if it is the thousands
    mark of the language (the dot in Spanish, the comma in English) and the number does not start with zero."""
    t = text.strip()
    w = fold(t)
    if not any(c.isdigit() for c in w):
        total = 0
        for part in re.split(r"\s+(?:y\s+)?", w):
            if part not in NUMBER_WORDS:
                return None
            total += NUMBER_WORDS[part]
        return F_(total)
    t = re.sub(rf"[ {_NBSP}]", "", t)
    dots, commas = t.count("."), t.count(",")
    if dots and commas:
        decimal = "." if t.rfind(".") > t.rfind(",") else ","
    elif dots > 1 or commas > 1:
        decimal = ""
    elif dots or commas:
        sep = "." if dots else ","
        head, _, tail = t.partition(sep)
        groups = len(tail) == 3 and head.lstrip("0") != "" and len(head) <= 3
        decimal = "" if groups and sep == ("," if english else ".") else sep
    else:
        decimal = ""
    for sep in ".,":
        if sep != decimal:
            t = t.replace(sep, "")
    return F_(t.replace(",", ".") if decimal else t)


def is_english(text: str) -> bool:
    f = fold(text)
    return len(_ENGLISH.findall(f)) > len(_SPANISH.findall(f))


def _scale(word: str | None, english: bool) -> int:
    if not word:
        return 1
    w = re.sub(r"\s+", " ", word).rstrip(".")
    return SCALES_EN.get(w) or SCALES_ES.get(w) or 1


def quantities(text: str | None) -> list[tuple[Fraction, Vector]]:
    """All quantities a text states, in reading order, in base dimensions (metre, kilogram, second, peso, dollar, one)."""
    if not text:
        return []
    english = is_english(text)
    t = _MASK.sub(lambda m: " " * (m.end() - m.start()), fold(text))
    found: list[tuple[int, int, Fraction, Vector]] = []

    def add(m: re.Match, scale: Fraction, vector: Vector) -> None:
        n = parse_number(m.group("num"), english)
        if n is not None and not any(s < m.end() and m.start() < e for s, e, _, _ in found):
            found.append((m.start(), m.end(), n * scale, vector))

    for m in _RATIO_OF.finditer(t):
        add(m, F_(1), _RATIO)
    if any(w in t for w in ("°", "º", "celsius", "fahrenheit", "kelvin", "centigrad")):
        for m in _DEGREES.finditer(t):
            n, (scale, offset) = parse_number(m.group("num"), english), TEMPERATURES[re.sub(r"\s+", " ", m.group("unit"))]
            if n is not None:
                found.append((m.start(), m.end(), (-n if m.group("sign") else n) * scale + offset, _TEMPERATURE))
    for m in _WITH_CURRENCY.finditer(t):
        add(m, F_(_scale(m.group("scale"), english)), _USD if m.group("cur").startswith("u") else _COP)
    for m in _WITH_UNIT.finditer(t):
        unit = re.sub(r"\s+", " ", m.group("unit"))
        if unit == "miles":  # a length in English, a scale word without a thing in Spanish
            if not english:
                continue
            u = ATOMS["mile"]
        else:
            u = parse_unit(unit)
        if u:
            add(m, u[0] * _scale(m.group("scale"), english), u[1])
    return [(n, v) for _, _, n, v in sorted(found)]


def stated_quantity(text: str | None, value: float | None, unit: str | None, known: dict[Vector, tuple[str, Fraction]]):
    """The quantity of a record in the base unit of its dimension: (base unit, integer), or None.

    ``known`` maps the vector of each wanted dimension to its base unit and scale. The text decides; if it states several
    quantities, the one that agrees with ``value`` (in ``unit``, in the unit of the text or in the base unit) is taken,
    else the first. Where the text states none, value and unit together do.
    """
    said = [(n, v) for n, v in quantities(text) if v in known]
    column = None
    if value is not None and value == value and unit and (u := parse_unit(unit)) and u[1] in known:
        column = (F_(repr(value)) * u[0] + offset_of(unit), u[1])
    if not said:
        said = [column] if column else []
    elif column and len(said) > 1:
        said.sort(key=lambda q: not (q[1] == column[1] and abs(q[0] - column[0]) <= abs(column[0]) / 50))
    if not said:
        return None
    n, v = said[0]
    base, scale = known[v]
    return base, half_up((n - offset_of(base)) / scale)


def offset_of(unit: str) -> Fraction:
    """What is added to a scaled value of ``unit`` to count from the zero of the base dimensions."""
    return TEMPERATURES.get(fold(re.sub(r"\s+", " ", unit.strip().rstrip("."))), (F_(1), F_(0)))[1]


def half_up(x: Fraction) -> int:
    """The nearest integer; halves go away from zero."""
    q = (2 * abs(x.numerator) + x.denominator) // (2 * x.denominator)
    return q if x >= 0 else -q
