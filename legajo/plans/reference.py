"""Queries and SQL of the analytics operators, gathered from their modules."""

from __future__ import annotations

import importlib

_PARTS = ["ref_pages", "ref_text", "ref_joins", "ref_entities", "ref_calibration", "ref_topics", "ref_style"]
QUERIES: dict = {}
ORACLES: dict = {}
for _part in _PARTS:
    _r = importlib.import_module(f"legajo.plans.{_part}").R
    if _twice := QUERIES.keys() & _r.queries.keys():
        raise ValueError(f"two queries are named {_twice}")
    QUERIES |= _r.queries
    ORACLES |= _r.oracles
