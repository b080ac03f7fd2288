"""Texts into containers of fixed capacity: matching of large items, best fit of small ones."""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.lanes import map_lanes
from tarnflow.session import materialise

#: Items that are packed together; a corpus is dealt into such groups by hash.
GROUP_ITEMS = 50_000


def pack(sizes: list[int], capacity: int) -> tuple[np.ndarray, list[int]]:
    """The bin of each item and the load of each bin; no size is over `capacity`.

    Items above a third of the capacity go two to a bin at most: from the largest down, each opens a bin and takes
    the largest unmatched one that still fits. Each smaller item, from the largest down, then goes to the bin with
    the least room that holds it, or to a new bin. Free sizes and free rooms are kept as bits of an integer, so the
    best fit is the lowest (or highest) bit set.
    """
    order = np.argsort(-np.asarray(sizes, dtype=np.int64), kind="stable").tolist()
    where, loads = np.zeros(len(sizes), np.int64), []
    large = [i for i in order if 3 * sizes[i] > capacity]
    free: dict[int, list[int]] = {}
    bits = 0
    for i in reversed(large):
        free.setdefault(sizes[i], []).append(i)
        bits |= 1 << sizes[i]

    def take(size: int) -> int:
        nonlocal bits
        held = free[size]
        i = held.pop()
        if not held:
            del free[size]
            bits ^= 1 << size
        return i

    taken = [False] * len(sizes)
    for i in large:
        if taken[i]:
            continue
        first = take(sizes[i])  # equal sizes are alike: any of them
        taken[first] = True
        where[first], load = len(loads), sizes[first]
        fits = (bits & ((2 << (capacity - load)) - 1)).bit_length() - 1
        if fits >= 0:
            mate = take(fits)
            taken[mate] = True
            where[mate], load = len(loads), load + fits
        loads.append(load)
    rooms: dict[int, list[int]] = {}
    bits = 0
    for b in range(len(loads) - 1, -1, -1):
        rooms.setdefault(capacity - loads[b], []).append(b)
        bits |= 1 << (capacity - loads[b])
    for i in order[len(large) :]:
        size = sizes[i]
        if shifted := bits >> size:
            room = size + (shifted & -shifted).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                bits ^= 1 << room
        else:
            b, room = len(loads), capacity
            loads.append(0)
        where[i] = b
        loads[b] += size
        rooms.setdefault(room - size, []).append(b)
        bits |= 1 << (room - size)
    return where, loads


def _kernel(table: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
    size, capacity = table.column("tokens").to_numpy(), table.column("capacity_tokens").to_numpy()
    bins, fill = np.zeros(len(size), np.int64), np.zeros(len(size))
    for s, e in zip(starts[:-1], starts[1:]):
        where, loads = pack(size[s:e].tolist(), int(capacity[s]))
        bins[s:e] = where
        fill[s:e] = (np.array(loads, float) / capacity[s])[where]
    names = ["capacity_id", "doc_id", "piece", "tokens", "deal"]
    return pa.RecordBatch.from_arrays([*(table.column(n).combine_chunks() for n in names), pa.array(bins), pa.array(fill)], [*names, "bin", "fill"])


def fill_containers(items: DataFrame, capacities: dict[int, int], group_items: int = GROUP_ITEMS) -> DataFrame:
    """The container of every item for every capacity: capacity_id, doc_id, piece, tokens, container, fill.

    `items` has doc_id and tokens. An item of at most the capacity is one piece (0). A larger one is cut into full
    pieces, each a container of its own, and its rest, which is packed like any item. `fill` is the container's
    load as a part of its capacity. Items of 0 or NULL tokens take no room but still get a container. Repeated rows
    are packed as often as they occur. Groups of about `group_items` are packed independently, which leaves at most a
    few ill-filled containers a group. `capacities` (id to tokens, above 0) must not be empty; an empty `items` gives
    no rows.
    """
    if not capacities or min(capacities.values()) < 1:
        raise ValueError("capacities must be positive")
    deals = max(1, math.ceil(items.count() / group_items))
    caps = F.explode(F.array(*(F.struct(F.lit(k).alias("capacity_id"), F.lit(v).cast("bigint").alias("capacity_tokens")) for k, v in sorted(capacities.items()))))
    rows = items.select("doc_id", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("size"), F.monotonically_increasing_id().alias("row"))
    rows = rows.select("doc_id", "size", "row", caps.alias("c")).select("doc_id", "size", "row", "c.*")
    whole = F.floor(F.col("size") / F.col("capacity_tokens")).cast("int")
    rows = rows.withColumn("full", F.when(F.col("size") > F.col("capacity_tokens"), whole).otherwise(0))
    full = rows.filter("full > 0").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("full") - 1)))
    full = full.select("capacity_id", "doc_id", "piece", F.col("capacity_tokens").alias("tokens"), F.concat_ws("-", F.lit("full"), "capacity_id", "row", "piece").alias("container"), F.lit(1.0).alias("fill"))
    rest = rows.withColumn("tokens", F.col("size") - F.col("full") * F.col("capacity_tokens")).filter("full = 0 or tokens > 0")
    rest = rest.select("capacity_id", "capacity_tokens", "doc_id", F.col("full").alias("piece"), "tokens", F.pmod(F.xxhash64("doc_id"), F.lit(deals)).cast("int").alias("deal"))
    packed = map_lanes(rest, ["capacity_id", "deal"], ["doc_id", "piece"], _kernel, "capacity_id int, doc_id bigint, piece int, tokens bigint, deal int, bin bigint, fill double")
    packed = packed.select("capacity_id", "doc_id", "piece", "tokens", F.concat_ws("-", F.lit("mixed"), "capacity_id", "deal", "bin").alias("container"), "fill")
    return packed.unionByName(full)


def container_fill(packed: DataFrame) -> DataFrame:
    """Per capacity: containers, pieces, tokens, mean fill and the least fill."""
    each = packed.groupBy("capacity_id", "container").agg(F.count(F.lit(1)).alias("pieces"), F.sum("tokens").alias("tokens"), F.max("fill").alias("fill"))
    return each.groupBy("capacity_id").agg(F.count(F.lit(1)).alias("containers"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.avg("fill").alias("mean_fill"), F.min("fill").alias("least_fill"))


def sized(items: DataFrame) -> DataFrame:
    """`items` written once, so that the tokenizer runs once however many capacities there are."""
    return materialise(items)
