from fractions import Fraction

import pytest

from legajo.functions import quantities as q
from legajo.operators.units import common_quantities

BASES = ["COP", "USD", "bp", "m", "m2", "kg", "kWh", "l", "h", "ea"]
KNOWN = {q.parse_unit(b)[1]: (b, q.parse_unit(b)[0]) for b in BASES}


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("Se restauraron 14.327 ha en 2027.", ("m2", 143_270_000)),
        ("La planta generó 1,6 teravatios hora en 2032.", ("kWh", 1_600_000_000)),
        ("El consumo fue de 533 gigajulios.", ("kWh", 148_056)),
        ("The figure stood at 68 miles.", ("m", 109_435)),
        ("In 2023 the figure stood at 45.4 billion Colombian pesos.", ("COP", 45_400_000_000)),
        ("Se giraron COP cuarenta billones al Instituto.", ("COP", 40_000_000_000_000)),
        ("El crédito fue de US$3352 mil y lo firmó la Oficina.", ("USD", 3_352_000)),
        ("El avance llegó a una fracción de 0,49 en 2023.", ("bp", 4_900)),
        ("La diferencia fue de 60 ‰ frente a 2032.", ("bp", 600)),
        ("Acopió siete ton de grano.", ("kg", 7_000)),
        ("Acopió 3,3 millones de toneladas de grano.", ("kg", 3_300_000_000)),
        ("Quedaron sin cobertura 40,1 miles de usuarios.", ("ea", 40_100)),
        ("Perdió 36 503,2 m³ en 2020.", ("l", 36_503_200)),
        ("La espera fue de 45 minutos.", ("h", 1)),
        ("Según la Ley 378 de 2029, art. 35, pág. 68.", None),
        ("El acta se cerró a las 4 p. m. del 3 de abril de 2032.", None),
        ("La versión 56,9 del aplicativo registró el plan.", None),
        ("", None),
        (None, None),
    ],
)
def test_text(text, want):
    assert q.stated_quantity(text, None, None, KNOWN) == want


def test_columns_where_the_text_is_silent():
    assert q.stated_quantity("Sin cifra.", 2.5, "miles de toneladas", KNOWN) == ("kg", 2_500_000)
    assert q.stated_quantity("Sin cifra.", 2.5, None, KNOWN) is None
    assert q.stated_quantity("Sin cifra.", None, "kg", KNOWN) is None


def test_the_agreeing_quantity_is_taken():
    assert q.stated_quantity("Entre 3 km y 5 km.", 5000.0, "m", KNOWN) == ("m", 5_000)


def test_half_up():
    assert [q.half_up(Fraction(x)) for x in ("0.5", "1.5", "2.4999", "-0.5")] == [1, 2, 2, -1]


@pytest.mark.parametrize("unit", ["COP (billones)", "miles de millones COP", "mill. COP", "US$ m", "x 1000", "GWh/año", "metro lineal", "kilómetros cuadrados", "hm³", "Mt", "mt3", "m.l.", "p.b.", "dias calendario"])
def test_every_spelling_is_read(unit):
    assert q.parse_unit(unit)[1] in KNOWN


def test_agreement_of_columns_and_text(spark, data):
    rows = spark.read.parquet(f"{data}/claims.parquet").select("claim_text", "numeric_value", "unit").where("numeric_value is not null and trim(unit) <> ''").collect()
    for r in rows:
        value, vector = q.parse_unit(r["unit"])
        by_column = q.half_up(Fraction(repr(r["numeric_value"])) * value / KNOWN[vector][1])
        assert q.stated_quantity(r["claim_text"], None, None, KNOWN) == (KNOWN[vector][0], by_column), r


def test_table(spark):
    units = spark.createDataFrame([("mass", "kg"), ("mass", "kg"), (None, None)], "dimension string, base_unit string")
    claims = spark.createDataFrame(
        [("c1", "Se enviaron 2 t.", None, None), ("c1", "Se enviaron 2 t.", None, None), ("c2", None, None, None), ("c3", "Mide 3 m.", 3.0, "m"), (None, "Son 5 kg", None, "")],
        "claim_id string, claim_text string, numeric_value double, unit string",
    )
    got = {tuple(r) for r in common_quantities(claims, units).collect()}
    assert got == {("c1", "kg", 2000), (None, "kg", 5)}
    assert common_quantities(claims.limit(0), units).count() == 0


def test_units_with_another_zero():
    def converted(text, value, unit, base):
        scale, vector = q.parse_unit(base)
        return q.stated_quantity(text, value, unit, {vector: (base, scale)})

    assert converted("La sala llegó a 25 °C.", None, None, "K") == ("K", 298)
    assert converted("La cámara bajó a -40 ºF ayer.", None, None, "°C") == ("°C", -40)
    assert converted(None, 212.0, "grados Fahrenheit", "grados Celsius") == ("grados Celsius", 100)
    assert converted("Marcó 300 kelvin.", None, None, "°F") == ("°F", 80)
    assert converted("Pagó 25 km de vía.", None, None, "°C") is None
    assert q.parse_unit("°C²") is None or q.parse_unit("°C²")[1] != q.parse_unit("°C")[1]
