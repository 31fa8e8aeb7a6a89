"""Containers of fixed capacity filled with items, planned on the histogram of lengths.

The plan is made by best fit over counts of lengths, longest first, never over single items: its size depends on the
capacity, not on the number of items. Items get a rank within their length without any group in one task (a local rank
in each hashed bucket plus the count of the buckets before), and join the planned slots by length and rank. An item is
cut only if it exceeds the capacity: into full containers and one rest, which is planned like any other item.
"""

from __future__ import annotations

import bisect

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from legajo.llm.tokens import token_counts
from legajo.session import checkpointed, small_lookup

#: Rows ranked in one task; the number of hashed buckets follows from it and the number of items.
ROWS_PER_BUCKET = 500_000
#: The plan is broadcast up to this many rows (about 60 bytes each) and joined by shuffle beyond.
BROADCAST_PLAN_ROWS = 200_000


def best_fit_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int, int]]:
    """Best fit, longest lengths first, over counts.

    Gives rows (length, first rank, end rank, first container, items in each container, tokens before, items before):
    rank r of a length lies in container first + (r - first rank) // per, as item (r - first rank) % per of that length.
    Containers filled alike are one group, so that a step handles any number of them at once. Items of length 0 are
    spread evenly over the containers there are (or all lie in one).
    """
    if any(n < 0 or n > capacity for n in histogram):
        raise ValueError("a length is negative or exceeds the capacity")
    groups: dict[int, list[tuple[int, int, int]]] = {}  # space left -> (first container, containers, items in each)
    spaces: list[int] = []  # sorted keys of groups
    made, plan = 0, []

    def keep(space: int, group: tuple[int, int, int]) -> None:
        if space not in groups:
            groups[space] = []
            bisect.insort(spaces, space)
        groups[space].append(group)

    for length in sorted((n for n in histogram if n > 0 and histogram[n] > 0), reverse=True):
        left, rank = histogram[length], 0
        while left:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, count, items = groups[space].pop()
                if not groups[space]:
                    del groups[space], spaces[at]
            else:
                space, first, items = capacity, made, 0
                count = max(1, left // (capacity // length))
                made += count
            per = space // length
            if left >= per:
                used = min(count, left // per)
            else:
                used, per = 1, left
            plan.append((length, rank, rank + used * per, first, per, capacity - space, items))
            keep(space - used_space(per, length), (first, used, items + per))
            if count > used:
                if space == capacity and items == 0:
                    made -= count - used  # newest containers that were not needed
                else:
                    keep(space, (first + used, count - used, items))
            rank += used * per
            left -= used * per
    if zero := histogram.get(0, 0):
        everywhere = [(first, count, items, space) for space, gs in groups.items() for first, count, items in gs] or [(0, 1, 0, capacity)]
        per, rank = -(-zero // sum(g[1] for g in everywhere)), 0
        for first, count, items, space in sorted(everywhere):
            if rank >= zero:
                break
            end = min(zero, rank + per * count)
            plan.append((0, rank, end, first, per, capacity - space, items))
            rank = end
    return plan


def used_space(per: int, length: int) -> int:
    return per * length


def pack(sizes: DataFrame, capacities: DataFrame, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """Container and place of every item or piece, for each capacity.

    Columns: capacity_id, ``key``, piece (from 1), container (from 1), place (from 1, order in the container), start (tokens
    before it in the container), offset (tokens before it in the item) and ``size`` (tokens of the piece). ``key`` is unique;
    a null size counts as 0. ``capacities`` is a configuration table (capacity_id, capacity_tokens); rows without a
    positive capacity are ignored. An empty table gives an empty result.
    """
    spark = sizes.sparkSession
    caps = {
        r["capacity_id"]: r["capacity_tokens"]
        for r in small_lookup(capacities.select("capacity_id", "capacity_tokens").distinct())
        if r["capacity_id"] is not None and (r["capacity_tokens"] or 0) > 0
    }
    n_items = sizes.count()
    buckets = max(8, -(-n_items * max(1, len(caps)) // ROWS_PER_BUCKET))
    items = _items(sizes, caps, key, size, buckets)
    counts = items.groupBy("capacity_id", "length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    counts = checkpointed(counts)  # at most (sum of capacities) x buckets rows
    before = Window.partitionBy("capacity_id", "length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("capacity_id", "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ranks_before"))
    histograms: dict[int, dict[int, int]] = {c: {} for c in caps}
    for r in counts.groupBy("capacity_id", "length").agg(F.sum("n").alias("n")).toLocalIterator():  # at most capacity + 1 rows each
        histograms[r["capacity_id"]][r["length"]] = r["n"]
    rows = [(c, *slot) for c, h in histograms.items() for slot in best_fit_plan(h, caps[c])]
    plan = _plan_frame(spark, rows)

    local = Window.partitionBy("capacity_id", "length", "bucket").orderBy(key, "piece")
    ranked = (
        items.withColumn("r", F.row_number().over(local) - 1)
        .join(offsets, ["capacity_id", "length", "bucket"])
        .withColumn("rank", F.col("r") + F.col("ranks_before"))
    )
    slot = F.col("rank") - F.col("first_rank")
    return (
        ranked.join(plan, ["capacity_id", "length"])
        .where("rank >= first_rank and rank < end_rank")
        .select(
            "capacity_id", key, "piece",
            (F.col("first_container") + F.floor(slot / F.col("per")) + 1).cast("bigint").alias("container"),
            (F.col("items_before") + slot % F.col("per") + 1).cast("int").alias("place"),
            (F.col("tokens_before") + slot % F.col("per") * F.col("length")).cast("bigint").alias("start"),
            "offset", F.col("length").alias(size),
        )
    )


def _items(sizes: DataFrame, caps: dict[int, int], key: str, size: str, buckets: int) -> DataFrame:
    """Items and pieces for each capacity: capacity_id, key, piece, offset, length, bucket."""
    table = F.array(*[F.struct(F.lit(i).cast("int").alias("id"), F.lit(c).cast("bigint").alias("tokens")) for i, c in caps.items()])
    if not caps:
        table = F.array().cast("array<struct<id:int,tokens:bigint>>")
    n = F.greatest(F.coalesce(F.col("_n"), F.lit(0)), F.lit(0)).cast("bigint")
    cap = F.col("_c.tokens")
    return (
        sizes.select(F.col(f"`{key}`").alias(key), F.col(f"`{size}`").alias("_n"))
        .select(key, n.alias("_n"), F.explode(table).alias("_c"))
        .select(key, "_n", "_c", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.ceil(F.col("_n") / cap)).cast("int"))).alias("piece"))
        .select(
            F.col("_c.id").alias("capacity_id"), key, "piece", ((F.col("piece") - 1) * cap).alias("offset"),
            F.least(cap, F.col("_n") - (F.col("piece") - 1) * cap).alias("length"),
            F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)).cast("int").alias("bucket"),
        )
    )


def _plan_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    schema = (
        "capacity_id int, length bigint, first_rank bigint, end_rank bigint, first_container bigint, per bigint, tokens_before bigint, "
        "items_before bigint"
    )
    plan = spark.createDataFrame(rows, schema)
    return F.broadcast(plan) if len(rows) <= BROADCAST_PLAN_ROWS else plan


def packed_documents(documents: DataFrame, capacities: DataFrame, path: str | None = None) -> DataFrame:
    """:func:`pack` of documents sized in tokens of a public vocabulary. Token counts are computed once and kept."""
    return pack(checkpointed(token_counts(documents, path=path)), capacities)
