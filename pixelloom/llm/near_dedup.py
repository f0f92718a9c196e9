"""MinHash near-dedup with an LSH forest.

Signatures: the minima of HASHES permutations over a text's word trigrams.
Documents of equal signatures are one entry of the forest.
Forest: each of TREES trees sorts the entries by its own 8 minima, partitioned
over the cluster by ranges of the first MIN_DEPTH of them. In a sorted order,
documents that share a prefix lie side by side. Candidates are the neighbours
with the longest common prefix, and all pairs of a region, that is of a run of
documents with a common prefix; a region's depth adapts: it starts at MIN_DEPTH
minima, and a region of more than REGION entries is cut at one minimum more, down
to the full depth, at which all pairs count whatever its size. Documents of a
region that was cut and is not one group afterwards go through TREES further
orders, of other minima together, as pairs may lie in different parts of it.

A pair matches if the estimate of its Jaccard similarity, from the low bytes of
all minima, is THRESHOLD at least. Matches are linked to groups (connected
components) by alternating stars; of each group the least id stays.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, col, free_name, id_column, plain_columns, spread
from .texts import mix, slices, utf8, words

HASHES, TREES, DEPTH, MIN_DEPTH, REGION = 128, 16, 8, 2, 64
WORDS = 3
THRESHOLD = 0.55
#: Entries of the sorted orders that one task gets, and that it takes up at a time.
ENTRIES = 200_000
_CHUNK = 1 << 17


def shingles(data: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(32-bit hashes of the runs of n words, first one of each row and their
    number). A row of fewer words, but of one at least, is one run."""
    w, at = words(data, offsets)
    if not len(w):
        return np.zeros(0, np.uint32), np.zeros(len(offsets), np.int64)
    odd = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    size = np.diff(at)
    s = w * odd[0]
    for k in range(1, n):
        s[:-k] += w[k:] * odd[k]
    for r in np.flatnonzero((size > 0) & (size < n)):
        own = w[at[r] : at[r + 1]]
        s[at[r]] = (own * odd[: len(own)]).sum(dtype=np.uint64) + np.uint64(len(own))
    runs = np.where(size > 0, np.maximum(size - n + 1, 1), 0)
    keep = np.zeros(len(w) + 1, np.int32)
    np.add.at(keep, at[:-1][runs > 0], 1)
    np.add.at(keep, (at[:-1] + runs)[runs > 0], -1)
    kept = np.cumsum(keep[:-1]) > 0
    return (mix(s[kept]) >> np.uint64(32)).astype(np.uint32), np.concatenate([[0], np.cumsum(runs)])


def minima(h: np.ndarray, at: np.ndarray, hashes: int) -> np.ndarray:
    """The minima of each row, a row of ``hashes`` 32-bit integers; rows
    without shingles have none (see ``at``) and get the largest integers."""
    rng = np.random.default_rng(20240607)
    mul = rng.integers(0, 2**32, hashes, dtype=np.uint32) | np.uint32(1)
    xor = rng.integers(0, 2**32, hashes, dtype=np.uint32)
    out = np.full((len(at) - 1, hashes), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(at) > 0)
    i = 0
    while i < len(full):
        j = max(i + 1, int(np.searchsorted(at[full], at[full[i]] + _CHUNK)))
        j = min(j, len(full))
        lo, hi = at[full[i]], at[full[j - 1] + 1]
        own, starts = h[lo:hi], at[full[i:j]] - lo
        buf = np.empty_like(own)
        for k in range(hashes):
            np.bitwise_xor(own, xor[k], out=buf)
            np.multiply(buf, mul[k], out=buf)
            buf ^= buf >> np.uint32(15)
            out[full[i:j], k] = np.minimum.reduceat(buf, starts) if len(starts) > 1 else buf.min()
        i = j
    return out


def _signed(batches, n: int, hashes: int):
    for b in batches:
        data, offsets = utf8(b.column(3))
        for lo, hi in slices(offsets, 4 << 20):
            part = offsets[lo : hi + 1]
            h, at = shingles(data[part[0] : part[-1]], part - part[0], n)
            has = np.flatnonzero(np.diff(at) > 0)
            sig = minima(h, at, hashes)[has]
            size = sig.shape[1] * 4
            blob = pa.Array.from_buffers(pa.binary(), len(has), [None, pa.py_buffer(np.arange(0, (len(has) + 1) * size, size, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(sig).tobytes())])
            own = b.slice(lo, hi - lo).take(pa.array(has))
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), own.column(2), blob], ["node", "doc_id", "row", "sig"])


def signatures(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", n: int = WORDS, hashes: int = HASHES) -> Table:
    """The written table (node, doc_id, row, sig, digest) of the documents that have
    a word; ``row`` hashes all columns, ``digest`` the signature."""
    rows = spread(docs).select(F.monotonically_increasing_id().alias("node"), id_column(docs, doc_id).alias("doc_id"), F.xxhash64(*plain_columns(docs)).alias("row"), col(text).cast("string").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    signed = rows.mapInArrow(lambda it: _signed(it, n, hashes), f"node long, doc_id {kind}, row long, sig binary")
    return Table(signed.withColumn("digest", F.unhex(F.md5("sig"))), "signatures")


def minima_of(tree: int, trees: int, depth: int, hashes: int, again: bool) -> np.ndarray:
    """The minima that a tree sorts by: runs of them, in the further orders every
    ``trees``-th."""
    return (np.arange(depth) * trees + tree if again else np.arange(tree * depth, (tree + 1) * depth)) % hashes


def _forest(batches, trees: int, depth: int, again: bool):
    """The entries of the sorted orders: (tree, key, node, low), where key has
    the tree's minima, the highest byte first, and low each minimum's low byte."""
    for b in batches:
        n = b.num_rows
        if not n:
            continue
        off = np.frombuffer(b.column(1).buffers()[1], np.int32)[b.column(1).offset :][: n + 1]
        sig = np.frombuffer(b.column(1).buffers()[2], np.uint32, (off[-1] - off[0]) // 4, off[0]).reshape(n, -1)
        low = fixed(sig.astype(np.uint8))
        for t in range(trees):
            key = sig[:, minima_of(t, trees, depth, sig.shape[1], again)].astype(">u4")
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, t, np.int32)), fixed(np.ascontiguousarray(key).view(np.uint8)), b.column(0), low], ["tree", "key", "node", "low"])


def fixed(a: np.ndarray) -> pa.Array:
    """The rows of a byte matrix as a binary column."""
    n, size = a.shape
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * size, size, dtype=np.int32).tobytes()), pa.py_buffer(np.ascontiguousarray(a).tobytes())])


def matrix(column: pa.Array, n: int) -> np.ndarray:
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset :][: n + 1]
    return np.frombuffer(column.buffers()[2], np.uint8, off[-1] - off[0], off[0]).reshape(n, -1)


def close(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Whether rows of low bytes agree in so many places that the estimated
    Jaccard similarity (less the chance agreement of 1 in 256) reaches the threshold."""
    return np.count_nonzero(a == b, axis=1) >= least_equal(a.shape[1], threshold)


def least_equal(hashes: int, threshold: float) -> int:
    return int(np.ceil(hashes * (threshold * 255 / 256 + 1 / 256) - 1e-9))


class Links:
    """Groups of the entries of a task: union-find with numbers as they come."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            nxt = self.up[self.up]
            if np.array_equal(nxt, self.up):
                return nxt
            self.up = nxt

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Link pairs: hook the larger roots to the smaller until all agree."""
        while len(i):
            r = self.roots()
            a, b = r[i], r[j]
            differ = a != b
            if not differ.any():
                return
            i, j, a, b = i[differ], j[differ], a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))


def regions(prefix: np.ndarray, min_depth: int, depth: int, most: int, last: int = -1) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """Runs (first entries, past entries, depth) of the sorted entries. prefix[i]
    is the common prefix of entries i-1 and i, -1 at a tree's first. Larger
    runs than ``most`` are cut at one minimum more, up to ``depth``. ``last`` is the
    common prefix of the last entry and the one after it, prefix[0] that of the
    first and the one before it: a run that goes on there is larger than ``most``."""
    out, n = [], len(prefix)
    live = np.ones(n, bool)
    for d in range(min_depth, depth + 1):
        starts = np.flatnonzero(prefix < d)
        if not len(starts):
            continue
        past = np.append(starts[1:], n)
        first = starts[live[starts]]
        past = past[live[starts]]
        size = past - first
        whole = (past < n) | (last < d)
        done = (size > 1) & ((size <= most) | (d == depth)) & whole
        if done.any():
            out.append((first[done], past[done], d))
        for a, b in zip(first[done | ((size == 1) & whole)], past[done | ((size == 1) & whole)]):
            live[a:b] = False
    return out


def prefixes(tree: np.ndarray, key: np.ndarray) -> np.ndarray:
    """The common prefix of each sorted entry and the one before, -1 at a tree's first."""
    n, depth = len(tree), key.shape[1] // 4
    same = (key[1:].reshape(n - 1, depth, 4) == key[:-1].reshape(n - 1, depth, 4)).all(axis=2) if n > 1 else np.zeros((0, depth), bool)
    return np.concatenate([[-1], np.where(tree[1:] == tree[:-1], np.logical_and.accumulate(same, axis=1).sum(axis=1), -1)])


def unsettled(tree: np.ndarray, key: np.ndarray, root: np.ndarray, min_depth: int, region: int, before: int = -1, last: int = -1) -> np.ndarray:
    """Whether each sorted entry is in a region of more than ``region`` that is of
    more than one group, or goes on elsewhere: some of its pairs may not have been
    compared. before and last: the common prefix with the entry before the first
    and the one after the last."""
    prefix = prefixes(tree, key)
    prefix[0] = before
    first = np.flatnonzero(prefix < min_depth)
    first = np.union1d(first, [0])
    size = np.diff(np.append(first, len(prefix)))
    several = np.maximum.reduceat(root, first) != np.minimum.reduceat(root, first)
    open_ = (size > region) & several
    open_[0] |= prefix[0] >= min_depth
    open_[-1] |= last >= min_depth
    return np.repeat(open_, size)


def linked(tree: np.ndarray, key: np.ndarray, low: np.ndarray, threshold: float, min_depth: int, region: int, before: int = -1, last: int = -1) -> np.ndarray:
    """The group of each sorted entry: the number of its first entry. before and last:
    the common prefix with the entry before the first and the one after the last."""
    n, depth = len(tree), key.shape[1] // 4
    prefix = prefixes(tree, key)
    prefix[0] = before
    links, need = Links(n), least_equal(low.shape[1], threshold)

    def compare(i: np.ndarray, j: np.ndarray) -> None:
        for k in range(0, len(i), 1 << 16):
            a, b = i[k : k + (1 << 16)], j[k : k + (1 << 16)]
            ok = close(low[a], low[b], threshold)
            links.add(a[ok], b[ok])

    near = np.flatnonzero(prefix[1:] >= min_depth) + 1
    compare(near - 1, near)  # the neighbours with the longest common prefix
    for first, past, _ in regions(prefix, min_depth, depth, region, last):
        small = past - first <= region
        group = np.full(n, -1)
        for a, b in zip(first[small], past[small]):
            group[a:b] = a
        for step in range(2, region):
            i = np.flatnonzero((group[step:] == group[:-step]) & (group[step:] >= 0))
            if not len(i):
                break
            r = links.roots()
            i = i[r[i] != r[i + step]]  # those that are linked already need no comparison
            compare(i, i + step)
        for a, b in zip(first[~small], past[~small]):
            # all pairs, group by group: what is in a group is compared with all that is in none yet
            free = np.arange(a, b)
            while len(free):
                reached, free = [free[0]], free[1:]
                while reached and len(free):
                    i = reached.pop()
                    ok = np.count_nonzero(low[free] == low[i], axis=1) >= need
                    new, free = free[ok], free[~ok]
                    links.add(np.full(len(new), i), new)
                    reached += new.tolist()
    return links.roots()


def _link(batches, threshold: float, min_depth: int, region: int, most: int):
    """Of the sorted entries of a partition: (kind 0, node, the first node of its
    group) and the nodes that are unsettled (kind 2). About ``most`` entries are
    taken up at a time, which end between two regions, at the least depth at which
    any does."""
    before = None  # the entry before the ones at hand

    def links(tree, key, node, low, last):
        nonlocal before
        if before is not None:
            tree, key, node, low = (np.concatenate([x, y]) for x, y in zip(before, (tree, key, node, low)))
        u, v, since = np.zeros(0, np.int64), np.zeros(0, np.int64), -1
        if before is not None:
            since = int(prefixes(tree[:2], key[:2])[1])
            if since >= min_depth and close(low[:1], low[1:2], threshold)[0]:
                u, v = node[1:2], node[:1]
            tree, key, node, low = tree[1:], key[1:], node[1:], low[1:]
        root = linked(tree, key, low, threshold, min_depth, region, since, last)
        i = np.flatnonzero(root != np.arange(len(root)))
        u, v = np.concatenate([u, node[i]]), np.concatenate([v, node[root[i]]])
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(u), np.int32)), pa.array(u), pa.array(v)], ["kind", "u", "v"])
        open_ = np.unique(node[unsettled(tree, key, root, min_depth, region, since, last)])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(open_), 2, np.int32)), pa.array(open_), pa.array(open_)], ["kind", "u", "v"])
        before = tree[-1:], key[-1:], node[-1:], low[-1:]

    held, rows, least = [], 0, most
    for b in batches:
        if not b.num_rows:
            continue
        held.append((b.column(0).to_numpy(), matrix(b.column(1), b.num_rows), b.column(2).to_numpy(), matrix(b.column(3), b.num_rows)))
        rows += b.num_rows
        if rows < least:
            continue
        whole = [np.concatenate(x) for x in zip(*held)]
        prefix = prefixes(whole[0], whole[1])
        half = prefix[rows // 2 :]
        depth = whole[1].shape[1] // 4
        if half.min() < depth:
            # regions that go on beyond the cut hold half of the entries and more, so they are cut in any case
            d = max(int(half.min()), min_depth - 1)
            cut = rows // 2 + int(np.flatnonzero(half <= d)[-1])
            yield from links(*(x[:cut] for x in whole), int(prefix[cut]))
            held, rows = [tuple(x[cut:] for x in whole)], rows - cut
        else:
            held = [tuple(whole)]
        least = max(most, 2 * rows)  # a region of full depth is gathered until it ends
    if held:
        yield from links(*(np.concatenate(x) for x in zip(*held)), -1)


def components(edges: DataFrame) -> Table:
    """(u, v): each node of the edges (u, v) but the least of its component, with
    that least node. Large and small stars in turn until nothing changes; every
    step is a written table."""
    now = Table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct(), "edges")
    seen = None
    while True:
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # minima are combined before they are shuffled, so that no task gets all neighbours of a hub at once
        large = both.where("v > u").join(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = Table(large, "edges")
        least = large.df.groupBy("u").agg(F.min("v").alias("m"))
        small = large.df.join(least, "u").select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = Table(small.select("e.u", "e.v").where("u > v").distinct(), "edges")
        large.drop()
        now.drop()
        now = new
        mark = now.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_distinct("u")).first()
        if mark == seen and mark[0] == mark[2]:
            return now
        seen = mark


def _links(sigs: DataFrame, threshold: float, again: bool) -> Table:
    """What ``_link`` finds in the orders of the signatures (node, sig)."""
    tasks = max(sigs.sparkSession.sparkContext.defaultParallelism, -(-sigs.count() * TREES // ENTRIES))
    forest = sigs.mapInArrow(lambda it: _forest(it, TREES, DEPTH, again), "tree int, key binary, node long, low binary")
    # entries of a region share the first minima, and so the partition
    forest = forest.repartitionByRange(tasks, F.col("tree"), F.substring("key", 1, 4 * MIN_DEPTH)).sortWithinPartitions("tree", "key", "node")
    return Table(forest.mapInArrow(lambda it: _link(it, threshold, MIN_DEPTH, REGION, ENTRIES), "kind int, u long, v long"), "links")


def near_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """(doc_id, row, keep, kept_doc_id) of the rows that have near copies; see
    ``near_pairs`` and ``near_dedup``."""
    sigs = signatures(docs, text, doc_id, n)
    one = sigs.df.groupBy("digest").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("digest").alias("d"), "rep")
    one = Table(one, "near-repeated")
    copies = Table(sigs.df.select("node", "digest").join(one.small(), F.col("digest") == F.col("d")).select("node", "rep"), "near-copies")
    others = copies.small(copies.df.where("node <> rep").select(F.col("node").alias("other")))
    some = sigs.df.select("node", "sig").join(others, F.col("node") == F.col("other"), "left_anti")
    made = [_links(some, threshold, False)]
    again = Table(made[0].df.where("kind = 2").select(F.col("u").alias("again")).distinct(), "again")
    if not again.df.isEmpty():
        made.append(_links(sigs.df.select("node", "sig").join(again.small(), F.col("node") == F.col("again"), "left_semi"), threshold, True))
    label = components(reduce(DataFrame.unionByName, [links.df.where("kind = 0").select("u", "v") for links in made]))
    for t in (*made, again):
        t.drop()
    nodes = label.df.select("u", F.col("v").alias("group")).unionByName(label.df.select(F.col("v").alias("u"), F.col("v").alias("group")).distinct())
    of = copies.df.join(nodes, F.col("rep") == F.col("u"), "left").select(F.col("node").alias("u"), F.coalesce("group", "rep").alias("group"))
    nodes = Table(nodes.unionByName(of).distinct(), "groups")
    for t in (label, one, copies):
        t.drop()
    rows = sigs.df.select("node", "doc_id", "row").join(nodes.small(), F.col("node") == F.col("u")).select("group", "node", "doc_id", "row")
    first = rows.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("row").alias("c"), F.col("node").alias("d"))).alias("first"))
    found = rows.join(first, "group").select("doc_id", "row", (F.col("node") == F.col("first.d")).alias("keep"), F.col("first.b").alias("kept_doc_id"))
    found = Table(found, "near").df
    sigs.drop()
    nodes.drop()
    return found


def near_pairs(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """(doc_id, kept_doc_id): each document that has to go, with the one of its
    group that stays, the least id.

    Case and punctuation don't count. Texts of fewer words than ``n`` are one
    shingle; null texts and texts without a word are in no group. Null ids lose
    to others. Repeated rows are copies: each but one gives a pair of the same
    ids. Very long texts are hashed whole. Ids keep their type. An empty table gives
    no rows. Other columns don't matter, whatever their names."""
    return near_groups(docs, text, doc_id, threshold, n).where("NOT keep").select("doc_id", "kept_doc_id")


def near_dedup(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", threshold: float = THRESHOLD, n: int = WORDS) -> DataFrame:
    """The documents, with their columns, less those that ``near_pairs`` finds.
    Rows are told apart by their id and a hash of all columns; of rows that are
    the same in both, one stays."""
    found = near_groups(docs, text, doc_id, threshold, n)
    per = found.groupBy("doc_id", "row").agg(F.max(F.col("keep").cast("int")).alias("stay"), F.count(F.lit(1)).alias("n"))
    gone = Table(per.where("stay = 0 OR n > 1"), "near-gone").small()
    i, r, s, h = (free_name(docs, x) for x in ("near_i", "near_r", "near_s", "near_h"))
    gone = gone.select(F.col("doc_id").alias(i), F.col("row").alias(r), F.col("stay").alias(s))
    on = id_column(docs, doc_id).eqNullSafe(F.col(i)) & (F.col(h) == F.col(r))
    rows = docs.withColumn(h, F.xxhash64(*plain_columns(docs)))
    rest = rows.join(gone, on, "left_anti").select(*[col(c) for c in docs.columns])
    once = rows.join(gone.where(F.col(s) == 1), on, "left_semi")
    once = once.withColumn(i, F.row_number().over(Window.partitionBy(id_column(docs, doc_id), h).orderBy(h))).where(F.col(i) == 1)
    return rest.unionByName(once.select(*[col(c) for c in docs.columns]))
