"""Ordered logic inside long groups, in chunks.

A group (a document, say) may hold a large part of all rows. Running sums, carried values and greedy packing are computed
inside chunks of a group (its pages), then over one summary row for each chunk, and combined.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from legajo.session import checkpointed


def _windows(group: list[str], chunk: str, order: list[str]):
    inside = Window.partitionBy(*group, chunk).orderBy(*order)
    over_chunks = Window.partitionBy(*group).orderBy(chunk)
    return inside, over_chunks


def carried_forward(df: DataFrame, value: Column, out: str, group: list[str], chunk: str, order: list[str]) -> DataFrame:
    """``out``: the last known ``value`` at or before each row of its group, in the order of chunk and ``order``."""
    inside, over_chunks = _windows(group, chunk, order)
    d = df.withColumn("_v", value)
    d = d.withColumn("_in", F.last("_v", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.max_by(F.when(F.col("_v").isNotNull(), F.col("_v")), F.when(F.col("_v").isNotNull(), F.struct(*order)))
    chunks = d.groupBy(*group, chunk).agg(last.alias("_last"))
    before = F.last("_last", ignorenulls=True).over(over_chunks.rowsBetween(Window.unboundedPreceding, -1))
    carried = chunks.select(*group, chunk, before.alias("_carry"))
    joined = d.join(carried, [*group, chunk], "left")
    return joined.withColumn(out, F.coalesce("_in", "_carry")).drop("_v", "_in", "_carry")


def previous(df: DataFrame, columns: list[str], group: list[str], chunk: str, order: list[str]) -> DataFrame:
    """prev_<column>: the value of the row before in the group; null for the first row."""
    inside, over_chunks = _windows(group, chunk, order)
    lasts = [F.max_by(c, F.struct(*order)).alias(f"_last_{c}") for c in columns]
    chunks = df.groupBy(*group, chunk).agg(*lasts)
    carried = chunks.select(*group, chunk, *[F.lag(f"_last_{c}").over(over_chunks).alias(f"_carry_{c}") for c in columns])
    d = df.withColumn("_first", F.row_number().over(inside) == 1)
    for c in columns:
        d = d.withColumn(f"_lag_{c}", F.lag(c).over(inside))
    d = d.join(carried, [*group, chunk], "left")
    for c in columns:
        d = d.withColumn(f"prev_{c}", F.when(F.col("_first"), F.col(f"_carry_{c}")).otherwise(F.col(f"_lag_{c}")))
    return d.drop("_first", *[f"_lag_{c}" for c in columns], *[f"_carry_{c}" for c in columns])


def running_sum(df: DataFrame, value: Column, out: str, group: list[str], chunk: str, order: list[str]) -> DataFrame:
    """``out``: the sum of ``value`` over the rows of the group up to and with this one."""
    inside, over_chunks = _windows(group, chunk, order)
    d = df.withColumn("_v", value)
    d = d.withColumn("_in", F.sum("_v").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    chunks = d.groupBy(*group, chunk).agg(F.sum("_v").alias("_t"))
    base = chunks.select(*group, chunk, F.coalesce(F.sum("_t").over(over_chunks.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return d.join(base, [*group, chunk]).withColumn(out, F.col("_in") + F.col("_base")).drop("_v", "_in", "_base")


def greedy_segments(df: DataFrame, amount: str, target: int, group: list[str], chunk: str, order: list[str], cap: bool = False) -> DataFrame:
    """segment (from 1): rows in order are put together until their ``amount`` reaches ``target``, then a new segment begins.
    With ``cap`` a segment ends before a row that would take it beyond ``target`` (a row larger than that stands alone).

    Groups that lie in one chunk are walked at once. In longer ones, what a chunk does to the amount carried in is a function of
    that amount, of which there are only ``target`` values; the functions of the chunks are applied in order, and then each
    chunk is walked with the amount it really begins with. All three passes read sorted rows as they come, so that no group or
    chunk is held whole. Null amounts count as 0; group columns must not be null.
    """
    named = df.select(*group, chunk, *order, F.greatest(F.coalesce(F.col(amount), F.lit(0)), F.lit(0)).cast("bigint").alias("_amount"))
    keys = [*group, chunk]
    fields = {f.name: f.dataType.simpleString() for f in named.schema.fields}
    schema = ", ".join(f"`{k}` {fields[k]}" for k in keys)
    chunks = named.select(*keys).distinct()
    long_groups = chunks.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*group)

    def effect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        head: list | None = None
        carry = closed = np.zeros(0, dtype=np.int64)
        for b in batches:
            rows = []
            amounts = np.minimum(b["_amount"].to_numpy(), target)  # what is beyond the target acts like the target
            for i, (new, a) in enumerate(zip(b["_first"], amounts, strict=True)):
                if new:
                    if head is not None:
                        rows.append([*head, carry.tolist(), closed.tolist()])
                    head = [*b[keys].iloc[i]]
                    carry, closed = np.arange(target + 1), np.zeros(target + 1, dtype=np.int64)
                if cap:
                    full = (carry > 0) & (carry + a > target)
                    closed = closed + full
                    carry = np.where(full, a, carry + a)
                else:
                    full = carry + a >= target
                    closed = closed + full
                    carry = np.where(full, 0, carry + a)
            yield pd.DataFrame(rows, columns=[*keys, "_carry", "_closed"])
        if head is not None:
            yield pd.DataFrame([[*head, carry.tolist(), closed.tolist()]], columns=[*keys, "_carry", "_closed"])

    def compose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = closed = 0
        for b in batches:
            begins = []
            for new, c, k in zip(b["_first"], b["_carry"], b["_closed"], strict=True):
                if new:
                    carry = closed = 0
                begins.append((carry, closed))
                carry, closed = int(c[carry]), closed + int(k[carry])
            out = b[keys].copy()
            out["_begin"], out["_done"] = [x[0] for x in begins], [x[1] for x in begins]
            yield out

    def sorted_rows(rows: DataFrame, by: list[str], within: list[str]) -> DataFrame:
        """Rows sorted by ``by`` and ``within`` in partitions by ``by``, the first of each marked."""
        return rows.withColumn("_first", F.row_number().over(Window.partitionBy(*by).orderBy(*within)) == 1)

    effects = sorted_rows(named.join(long_groups, group, "left_semi"), keys, order).mapInPandas(effect, f"{schema}, _carry array<bigint>, _closed array<bigint>")
    begins = sorted_rows(effects, group, [chunk]).mapInPandas(compose, f"{schema}, _begin bigint, _done bigint")
    placed = named.join(begins, keys, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_begin", "_done")})
    own = list(dict.fromkeys([*keys, *order]))

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        carry = done = 0
        for b in batches:
            segments = []
            amounts = np.minimum(b["_amount"].to_numpy(), target).tolist()
            for new, a, begin, before in zip(b["_first"], amounts, b["_begin"], b["_done"], strict=True):
                if new:
                    carry, done = int(begin), int(before)
                if cap and carry > 0 and carry + a > target:
                    carry, done = 0, done + 1
                segments.append(done + 1)
                carry += a
                if not cap and carry >= target:
                    carry, done = 0, done + 1
            out = b[own].copy()
            out["segment"] = segments
            yield out

    return sorted_rows(placed, keys, order).mapInPandas(walk, ", ".join(f"`{c}` {fields[c]}" for c in own) + ", segment bigint")


def runs(df: DataFrame, column: str, out: str, group: list[str], chunk: str, order: list[str]) -> DataFrame:
    """``out``: the number of changes of ``column`` up to each row of its group; two nulls are no change."""
    changed = previous(df, [column], group, chunk, order)
    return running_sum(changed, (~F.col(column).eqNullSafe(F.col(f"prev_{column}"))).cast("int"), out, group, chunk, order).drop(f"prev_{column}")


def numbered(df: DataFrame, out: str, order: list[str], pattern: str = "%d") -> DataFrame:
    """``out``: sequential ids from 1 in the order of ``order``, written by ``pattern``.

    Rows are sorted into ranges once and kept there; each range counts its rows, and begins where the ranges before it end. Only
    one number for each range is ordered in one place. ``order`` must tell rows apart, else equal rows may change places.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id()
    kept = checkpointed(sorted_rows.withColumn("_range", F.shiftright(place, 33)).withColumn("_at", place.bitwiseAND((1 << 33) - 1)))
    sizes = kept.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))  # one row for each range
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    joined = kept.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return joined.withColumn(out, F.format_string(pattern, F.col("_before") + F.col("_at") + 1)).drop("_range", "_at", "_before")
