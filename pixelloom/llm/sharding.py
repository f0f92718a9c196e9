"""Sharding by longest processing time: groups that must stay together, largest
first, each to the least loaded shard.

The heap of shards runs over the histogram of group sizes. A few groups of a
size are popped and pushed one by one; a long run of equal groups is dealt in
one step, to the same shards as the heap would choose. Groups of one size are
alike, so the shards' counts are joined back to them by rank.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, col, prefix_sums

#: Shards in production.
SHARDS = 64


def deal(sizes: list[tuple[int, int]], shards: int) -> tuple[np.ndarray, ...]:
    """Columns (size, first rank, rank past the last, shard) for (size, groups), as
    the heap of (load, shard) deals them; within a size by shard."""
    load = [0] * shards
    heap = [(0, i) for i in range(shards)]
    out = []
    for size, n in sorted(sizes, reverse=True):
        took: dict[int, int] = {}
        if n <= 2 * shards or size == 0:
            step = n if size == 0 else 1
            for _ in range(0, n, step):
                x, i = heap[0]
                heapq.heapreplace(heap, (x + size * step, i))
                took[i] = took.get(i, 0) + step
            for x, i in heap:
                load[i] = x
        else:
            now = np.array(load, dtype=object)
            lo, hi = min(load) - 1, max(load) + size * (n // shards + 1)
            count = lambda t: int(sum((t - x) // size + 1 for x in now if x <= t))
            while lo < hi:  # the largest level up to which no more than n loads lie
                mid = (lo + hi + 1) // 2
                lo, hi = (mid, hi) if count(mid) <= n else (lo, mid - 1)
            k = [int((lo - x) // size + 1) if x <= lo else 0 for x in now]
            rest = n - sum(k)
            for i in range(shards):
                if rest and load[i] + k[i] * size == lo + 1:
                    k[i], rest = k[i] + 1, rest - 1
            load = [x + a * size for x, a in zip(load, k)]
            heap = [(x, i) for i, x in enumerate(load)]
            heapq.heapify(heap)
            took = {i: a for i, a in enumerate(k) if a}
        which = np.array(sorted(took), np.int32)
        past = np.cumsum([took[i] for i in which.tolist()], dtype=np.int64)
        out.append((np.full(len(which), size, np.int64), np.concatenate([[0], past[:-1]]), past, which))
    kinds = (np.int64, np.int64, np.int64, np.int32)
    return tuple(np.concatenate([np.zeros(0, k), *(r[c] for r in out)]).astype(k) for c, k in enumerate(kinds))


def shard(docs: DataFrame, group: Column, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, shard) for every row; rows of one ``group`` share a shard.

    ``group`` is a string column; a group's size is the characters of its rows
    and 1 for each row, so that null and empty texts count. Null is a group.
    Groups of the same size are ordered by their names' hash. Repeated rows stay
    and count as often as they occur. Very long texts count whole. Ids keep their
    type. No columns but the two named and those of ``group`` are read, whatever the
    others' names. An empty table gives no rows."""
    rows = Table(docs.select(col(doc_id).alias("doc_id"), group.alias("group"), (F.coalesce(F.length(col(text)), F.lit(0)) + 1).cast("long").alias("n")), "shard-rows")
    groups = rows.df.groupBy("group").agg(F.sum("n").cast("long").alias("size"))
    groups = Table(groups.select("group", "size", F.md5(F.coalesce(F.concat(F.lit("g|"), "group"), F.lit("null"))).alias("key"), F.lit(1).cast("long").alias("one")), "shard-groups")
    sizes = [(r["size"], r["count"]) for r in groups.df.groupBy("size").count().toLocalIterator()]  # distinct sizes, not groups
    dealt = pa.table(dict(zip(("s", "first", "past", "shard"), map(pa.array, deal(sizes, shards)))))
    dealt = Table(docs.sparkSession.createDataFrame(dealt), "shard-runs").small()
    ranked = prefix_sums(groups.df, ["size"], "key", ["group"], "one", "rank")
    at = ranked.join(dealt, (F.col("size") == F.col("s")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))).select(F.col("group").alias("g"), "shard")
    return rows.df.join(at, F.col("group").eqNullSafe(F.col("g"))).select("doc_id", "shard")
