"""Packing documents into sequences of fixed length, shortest pack first.

The algorithm works on the histogram of lengths, whose size is bounded by the
sequence length: lengths are placed longest first, each into the packs that
have the most room left, a whole count of equal packs at a time. A run of equal
packs is a pattern with a count; packs of a run have consecutive numbers. What
it writes down - lengths of ranks r .. r+n go to packs p .. p+n at offset o - is
joined back to the documents by their rank among those of the same length.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Table, col, prefix_sums, word_count

#: Tokens of a sequence in production.
MAX_LENGTH = 2048
SEED = "pack-1"


def place(histogram: dict[int, int], max_length: int) -> list[tuple[int, int, int, int, int]]:
    """(length, first rank, ranks, first pack, offset) of each placement."""
    room: dict[int, list[tuple[int, int]]] = {}  # room left: runs (first pack, packs)
    widest: list[int] = []  # a heap of the negated keys of room
    packs, placed = 0, []

    def put(free: int, run: tuple[int, int]) -> None:
        if free <= 0:
            return
        if free not in room:
            room[free] = []
            heapq.heappush(widest, -free)
        room[free].append(run)

    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and widest and -widest[0] >= length:
            free = -widest[0]
            first, n = room[free].pop()
            take = min(n, left)
            if take < n:
                room[free].append((first + take, n - take))
            elif not room[free]:
                del room[free]
                heapq.heappop(widest)
            placed.append((length, rank, take, first, max_length - free))
            put(free - length, (first, take))
            rank, left = rank + take, left - take
        # no pack has the room: new ones, each filled with this length as it is the shortest now
        each = max_length // length
        for n, full in ((left // each, each), (1, left % each)):
            if n and full:
                for i in range(full):
                    placed.append((length, rank, n, packs, i * length))
                    rank += n
                put(max_length - full * length, (packs, n))
                packs += n
    return placed


def pack(docs: DataFrame, max_length: int = MAX_LENGTH, seed: str = SEED, text: str = "text", doc_id: str = "doc_id", tokens: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, pack, offset): where each document's tokens
    from ``start`` on lie. Packs are numbered from 0 and are no longer than
    ``max_length``.

    A document has its ``tokens`` (words by default) and an end mark, so null
    and empty texts are pieces of length 1. A longer document is cut into pieces
    of ``max_length`` and the rest; all of its tokens are packed. Documents of
    the same length are told apart by a hash of their ids; null ids by a hash of
    their texts. Repeated rows are packed as often as they occur; which of them
    goes where is open, as they are the same. Very long texts are packed whole.
    Ids keep their type. No columns but the two named and those of ``tokens`` are
    read, whatever the others' names. An empty table gives no rows."""
    n = word_count(col(text)) if tokens is None else F.coalesce(tokens.cast("long"), F.lit(0))
    who = F.coalesce(col(doc_id).cast("string"), F.concat(F.lit("null:"), F.coalesce(col(text), F.lit(""))))
    rows = docs.select(col(doc_id).alias("doc_id"), F.md5(F.concat(F.lit(seed + "|"), who)).alias("key"), (n + 1).alias("n"))
    piece = F.explode(F.expr(f"sequence(0L, (n - 1) div {int(max_length)})")).alias("piece")
    rows = rows.select("doc_id", "key", "n", piece).withColumn("start", F.col("piece") * max_length)
    rows = Table(rows.select("doc_id", "key", "piece", "start", F.least(F.lit(int(max_length)), F.col("n") - F.col("start")).cast("long").alias("length"), F.lit(1).cast("long").alias("one")), "pieces")
    histogram = {r["length"]: r["count"] for r in rows.df.groupBy("length").count().collect()}  # at most max_length rows
    placed = [(a, b, b + n, p, o) for a, b, n, p, o in place(histogram, max_length)]
    runs = docs.sparkSession.createDataFrame(placed, "l long, first long, past long, p long, offset long")
    runs = Table(runs, "runs").small()
    ranked = prefix_sums(rows.df, ["length"], "key", ["piece", "doc_id"], "one", "rank")
    on = (F.col("length") == F.col("l")) & (F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("past"))
    return ranked.join(runs, on).select("doc_id", "piece", "start", "length", (F.col("p") + F.col("rank") - F.col("first")).alias("pack"), "offset")
