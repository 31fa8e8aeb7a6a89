"""Providers for what needs a library or model that may be absent: page extraction, recognition, parsing, sentiment, encoders.

A provider is loaded once in each Python worker. Every result has a column ``method`` that names the provider used; without one
the default gives nulls or a rule-based value and says so. A fallback is never passed off as a model's result.
"""

from __future__ import annotations

import importlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Provider = Callable[[], Callable[[str], object]]
_REGISTERED: dict[str, tuple[str, str]] = {}


def register(kind: str, module: str, factory: str) -> None:
    """Name the factory (module and function) of a kind of provider; it must return a function of one text."""
    _REGISTERED[kind] = (module, factory)


def available(kind: str) -> str | None:
    """The module of a registered provider that can be imported, else None."""
    if kind not in _REGISTERED:
        return None
    module = _REGISTERED[kind][0]
    try:
        importlib.import_module(module)
    except ImportError:
        return None
    return module


@lru_cache(maxsize=16)
def _load(module: str, factory: str):
    return getattr(importlib.import_module(module), factory)()


def scored(df: DataFrame, key: str, text: str, kind: str) -> DataFrame:
    """``key``, value (double) and method: what the provider of ``kind`` says of each text, null with method ``none`` without one."""
    if available(kind) is None:
        return df.select(key, F.lit(None).cast("double").alias("value"), F.lit("none").alias("method"))
    module, factory = _REGISTERED[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = _load(module, factory)
        for b in batches:
            yield pd.DataFrame({key: b["_key"], "value": [None if t is None else float(score(t)) for t in b["_text"]], "method": module})

    read = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return read.mapInPandas(run, f"`{key}` {df.schema[key].dataType.simpleString()}, value double, method string")


def hashed_vectors(df: DataFrame, key: str, tokens: str, size: int = 256) -> DataFrame:
    """``key``, vector and method: hashed counts of the words as unit vectors, the default where no encoder is plugged in."""
    places = df.select(key, F.explode(tokens).alias("t")).select(key, F.pmod(F.xxhash64("t"), F.lit(size)).cast("int").alias("i"))
    counts = places.groupBy(key, "i").agg(F.count(F.lit(1)).cast("double").alias("x"))
    rows = counts.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("i", "x"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.col("m")[i], F.lit(0.0)))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return rows.withColumn("v", dense).select(key, F.transform("v", lambda x: x / norm).alias("vector"), F.lit("hashed counts").alias("method"))
