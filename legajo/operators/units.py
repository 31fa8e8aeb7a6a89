"""Quantities in different units and scales, converted to the common unit of their dimension."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import DataFrame

from legajo.functions import quantities as q
from legajo.session import small_lookup


def common_unit_table(units: DataFrame) -> dict[q.Vector, tuple[str, Fraction]]:
    """Vector of each wanted dimension -> (base unit, scale). ``units`` is a configuration table (at most 10,000 rows)."""
    table = {}
    for r in small_lookup(units.select("base_unit").where("base_unit is not null").distinct()):
        parsed = q.parse_unit(r["base_unit"])
        if parsed is None:
            raise ValueError(f"unknown base unit: {r['base_unit']}")
        table[parsed[1]] = (r["base_unit"], parsed[0])
    return table


def common_quantities(claims: DataFrame, units: DataFrame) -> DataFrame:
    """claim_id, base_unit, base_value of every claim that states a quantity of a wanted dimension.

    Reads claim_text, numeric_value and unit; any of them may be null or empty. A claim without a quantity gives no row, a
    repeated delivery no second one. A value beyond 64 bits gives null.
    """
    known = common_unit_table(units)

    def convert(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for key, text, value, unit in zip(b["claim_id"], b["claim_text"], b["numeric_value"], b["unit"], strict=True):
                got = q.stated_quantity(text, None if pd.isna(value) else float(value), unit, known)
                if got:
                    rows.append((key, got[0], got[1] if abs(got[1]) < 2**63 else None))
            out = pd.DataFrame(rows, columns=["claim_id", "base_unit", "base_value"])
            yield out.astype({"base_value": "Int64"})

    read = claims.select("claim_id", "claim_text", "numeric_value", "unit")
    return read.mapInPandas(convert, "claim_id string, base_unit string, base_value bigint").distinct()
