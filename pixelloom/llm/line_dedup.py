"""Line dedup by an exact set-similarity join.

A line is the set of its words. Three passes over the texts: the first writes
down each line's set (as a hash) and counts words, for the order by rarity; the
second sends out the prefix of each set's rarest words; the third fetches the
words of the lines that are left as candidates. Two sets of Jaccard similarity t
share a word among the first n - ceil(t n) + 1 of either in any one order, so
lines meet at their prefixes' words (prefix filter); a meeting counts if their
sizes (length filter) and what follows the word in both (positional filter)
allow the overlap that t asks for, and if the parities of their words' bits
differ in no more places than the sets may in words. A line goes if an earlier
line matches it, earlier by document id, then by place.

Words that are frequent in the corpus don't meet alone: two sets whose first
common word is frequent share a second one among one word more than the prefix,
and meet at both (they are frequent as well, coming later in the order).

Candidates are verified by the words themselves, those of the earliest line
first: a set that has its first match needs no other. Of the candidates at one
word a set sends the CANDIDATES earliest ones; a set that none of these settles
gets all of its candidates in a second round, so nothing is left out.

Hashes only find candidates. Where a line has two words of one hash, or two sets
have one hash, the search is made again with other hashes.

Words are ordered by the logarithm of their bucket's count in a table of fixed
size (2**BUCKET_BITS), then by hash. Any one order gives the exact join; words
of rare buckets first make it fast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Table, col, free_name, id_column, spread
from .near_dedup import fixed, matrix
from .texts import hashes, joined, mix, ranges, same, slices, utf8

THRESHOLD = 0.8
BUCKET_BITS, SLICE_BITS, HASH_BITS, LEVEL_BITS = 20, 10, 58, 6
#: Level from which on a word is frequent: a bucket of 2**20 words.
HOT = 40
#: Sets up to this size meet at two frequent words; those that may have a larger partner also at one.
PAIRED = 256
#: Earliest candidates that a set gets at one word in the first round.
CANDIDATES = 128
#: Meeting points that one pass of the second round takes.
POINTS = 2_000_000
#: Lines whose prefixes one task gets, about.
LINES = 60_000
_HASH = np.uint64((1 << HASH_BITS) - 1)
_BYTES, _ENTRIES, _PAIRS = 1 << 20, 1_000_000, 1 << 22
_LAST = (1 << 32) - 1


def _record(size: str) -> np.dtype:
    """A set at one of its prefix's words: the word, the set, its earliest line
    (document, line), parities, number of words and the word's place among them."""
    return np.dtype([("key", "<u4"), ("set", "<u8"), ("doc", "<u4"), ("line", "<u2"), ("low", "<u8"), ("high", "<u8"), ("size", size), ("place", size)])


_NARROW, _WIDE = _record("u1"), _record("<u4")


class Sets:
    """The word sets of lines: ``ids`` are the words as numbers, rarest first and
    each once, those of line i in first[i] : first[i + 1]; ``at`` are the words'
    places among all, and ``again`` those of the repeated ones beside ``like``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, level: np.ndarray, seed: int, bits: int):
        self.low_text, self.starts, self.ends = ranges(data, offsets)
        self.n = len(offsets) - 1
        h = hashes(self.low_text, self.starts, self.ends, seed) >> np.uint64(64 - bits)
        ids = (level[(h & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(HASH_BITS)) | h
        line = np.repeat(np.arange(self.n, dtype=np.int64), np.diff(np.searchsorted(self.starts, offsets)))
        order = _by_line(line, ids, self.n)
        ids, line = ids[order], line[order]
        new = np.append(True, (ids[1:] != ids[:-1]) | (line[1:] != line[:-1]))[: len(ids)]
        again = np.flatnonzero(~new)
        self.again, self.like = order[again], order[again - 1]
        self.ids, self.at = ids[new], order[new]
        self.size = np.bincount(line[new], minlength=self.n)
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        # of the words' hashes alone, so that a set has the same hashes whatever the levels are
        bit = mix(self.ids & _HASH)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(bit), dtype=np.uint64)])
        self.set = mix(sums[self.first[1:]] - sums[self.first[:-1]] + self.size.astype(np.uint64))
        # the parity of each of 128 bits that the words of a set toggle: within a set's range, xor is the difference of running xors
        one = np.uint64(1) << (bit & np.uint64(63))
        upper = np.uint64(0) - ((bit >> np.uint64(6)) & np.uint64(1))
        runs = [np.concatenate([np.zeros(1, np.uint64), np.bitwise_xor.accumulate(one & side)]) for side in (~upper, upper)]
        self.low, self.high = (r[self.first[1:]] ^ r[self.first[:-1]] for r in runs)

    def collide(self) -> bool:
        """Whether a line has two different words of one hash."""
        return not same(self.low_text, self.starts, self.ends, self.again, self.like).all()

    def bags(self, lines: np.ndarray) -> pa.Array:
        """The words of the lines, each once, in the order of their numbers."""
        n = self.size[lines]
        at = np.concatenate([[0], np.cumsum(n)])
        take = self.at[np.repeat(self.first[lines], n) + np.arange(at[-1]) - np.repeat(at[:-1], n)]
        return joined(self.low_text, self.starts[take], self.ends[take], at)


def _by_line(line: np.ndarray, ids: np.ndarray, lines: int) -> np.ndarray:
    """The order by line, then id."""
    own, by = max(1, len(ids).bit_length()), max(1, lines.bit_length())
    left = 64 - own - by
    if left < 20:
        return np.lexsort((ids, line))
    # one sort of line, the id's first bits and the place; what those bits leave open is seldom
    key = (line.astype(np.uint64) << np.uint64(64 - by)) | ((ids >> np.uint64(64 - left)) << np.uint64(own)) | np.arange(len(ids), dtype=np.uint64)
    order = (np.sort(key) & np.uint64((1 << own) - 1)).astype(np.int64)
    a, b = ids[order], line[order]
    for i in np.unique(b[1:][(a[1:] < a[:-1]) & (b[1:] == b[:-1])]).tolist():
        lo, hi = np.searchsorted(b, [i, i + 1])
        order[lo:hi] = order[lo:hi][np.argsort(ids[order[lo:hi]], kind="stable")]
    return order


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(offsets of all lines, first line of each text and their number)."""
    starts = np.union1d(offsets[:-1], np.flatnonzero(data == 10) + 1)
    starts = starts[starts < len(data)]
    # a text that ends with a line end has an empty last line, which holds no word
    return np.append(starts, len(data)), np.searchsorted(starts, offsets)


def _parts(batches, level: np.ndarray, seed: int, bits: int):
    """(batch, rows lo and hi, sets, first line of each text and their number)."""
    for b in batches:
        data, offsets = utf8(b.column(b.num_columns - 1))
        for lo, hi in slices(offsets, _BYTES):
            part = offsets[lo : hi + 1]
            own = data[part[0] : part[-1]]
            line_at, text_at = lines_of(own, part - part[0])
            yield b, lo, hi, Sets(own, line_at, level, seed, bits), text_at


def _first(batches, seed: int, bits: int):
    """Kind 0: every line that has a word (row, doc_id, line, set, low). Kind 1: counts
    of the words' buckets in slices (slice in line, counts). Kind 2: words collide."""
    count = np.zeros(1 << BUCKET_BITS, np.int64)
    flat = np.zeros(1 << BUCKET_BITS, np.uint8)
    names = ["kind", "row", "doc_id", "line", "set", "low", "counts"]
    held, words_, collide, id_type = [], 0, False, None

    def other(kind: int, line, counts) -> pa.RecordBatch:
        none = pa.nulls(len(counts), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), kind, np.int32)), none, pa.nulls(len(counts), id_type), pa.array(line, pa.int64()), none, none, counts], names)

    for b, lo, hi, s, text_at in _parts(batches, flat, seed, bits):
        id_type = b.column(1).type
        held.append((s.ids & np.uint64((1 << BUCKET_BITS) - 1)).astype(np.int32))
        words_ += len(s.ids)
        if words_ > len(count):  # the table is gone through once for as many words
            count += np.bincount(np.concatenate(held), minlength=len(count))
            held, words_ = [], 0
        if not collide and s.collide():
            collide = True
            yield other(2, [0], pa.nulls(1, pa.binary()))
        has = np.flatnonzero(s.size)
        text = np.searchsorted(text_at, has, "right") - 1
        own = [b.column(i).slice(lo, hi - lo).take(pa.array(text)) for i in (0, 1)]  # not the texts
        yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(has), np.int32)), *own, pa.array(has - text_at[text]), pa.array(s.set.view(np.int64)[has]), pa.array(s.low.view(np.int64)[has]), pa.nulls(len(has), pa.binary())], names)
    if held:
        count += np.bincount(np.concatenate(held), minlength=len(count))
    rows = count.astype(np.uint32).reshape(-1, 1 << SLICE_BITS)
    some = np.flatnonzero(rows.any(axis=1))
    if len(some):
        yield other(1, some, fixed(np.ascontiguousarray(rows[some]).view(np.uint8).reshape(len(some), 4 << SLICE_BITS)))


def _levels(batches):
    """The slices' levels of rarity: a byte for each bucket."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        if b.num_rows:
            rows = matrix(b.column(1), b.num_rows)
            for s, r in zip(b.column(0).to_pylist(), rows):
                c = r.copy().view(np.uint32).astype(np.int64)
                total[s] = total[s] + c if s in total else c
    if total:
        keys = list(total)
        lev = np.minimum(2 * np.log2(1.0 + np.array([total[k] for k in keys])), (1 << LEVEL_BITS) - 1).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int32()), fixed(lev)], ["slice", "levels"])


def rarity(tallies: DataFrame) -> np.ndarray:
    """The level of each bucket of words, over all texts: a megabyte."""
    out = np.zeros(1 << BUCKET_BITS, np.uint8)
    for r in tallies.repartition("slice").mapInArrow(_levels, "slice int, levels binary").collect():
        out[r["slice"] << SLICE_BITS : (r["slice"] + 1) << SLICE_BITS] = np.frombuffer(r["levels"], np.uint8)
    return out


def prefix_length(n: np.ndarray, t: float) -> np.ndarray:
    """Words in which a set must meet any partner; 0 where only an equal set is
    similar enough, as the next size is already too far."""
    p = n - np.ceil(t * n - 1e-9).astype(np.int64) + 1
    alone = (n < t * (n + 1) - 1e-9) & (n - 1 < t * n - 1e-9)
    return np.where((n == 0) | alone, 0, p)


def _overlap(n: np.ndarray, t: float) -> np.ndarray:
    """Words that a set of size n shares with any partner at least."""
    return np.ceil(t * n - 1e-9).astype(np.int64)


def keys_of(ids: np.ndarray, first: np.ndarray, size: np.ndarray, t: float, hot: int = HOT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, place, key) of the words, and pairs of frequent words, at which the
    sets meet. The place is that of the word; of a pair, the one before its
    second word, so that what follows the place bounds the overlap."""
    p = prefix_length(size, t)
    owner = np.repeat(np.arange(len(p)), p)
    place = np.arange(int(p.sum())) - np.repeat(np.cumsum(p) - p, p)
    word = ids[first[owner] + place]
    # words are ordered by level: from the first frequent one on, all are
    often = (word >> np.uint64(HASH_BITS)) >= np.uint64(hot)
    c = np.bincount(owner[often], minlength=len(p))
    # all partners share two words with it and are paired as well, or it is too large to be
    two = (_overlap(size, t) >= 2) & (size <= PAIRED)
    one = (_overlap(_overlap(size, t), t) < 2) | (size >= t * PAIRED - 1)
    single = ~often | one[owner]
    out = [(owner[single], place[single], mix(word[single] & _HASH))]
    for k in np.unique(c[two & (c > 0)]).tolist():
        who = np.flatnonzero(two & (c == k))
        i, j = np.triu_indices(k, 0)  # the i-th frequent word and the one after the j-th, which may lie just beyond the prefix
        own, base = np.repeat(who, len(i)), np.repeat(p[who] - k, len(i))
        a, b = base + np.tile(i, len(who)), base + np.tile(j, len(who)) + 1
        ok = b < size[own]
        own, a, b = own[ok], a[ok], b[ok]
        key = mix((ids[first[own] + a] & _HASH) * np.uint64(0x9E3779B97F4A7C15) + mix(ids[first[own] + b] & _HASH))
        out.append((own, b - 1, key))
    return tuple(np.concatenate([o[x] for o in out]) for x in range(3))


def _order(ids: pa.Array, how: tuple) -> np.ndarray:
    """The documents' place in the order of their ids, in 32 bits: never in the
    wrong order, but different ids may get the same."""
    out = np.zeros(len(ids), np.uint32)
    if how[0] == "long":
        v = ids.fill_null(how[1]).to_numpy().astype(np.int64).view(np.uint64) - np.uint64(how[1] % 2**64)
        out = (v >> np.uint64(how[2])).astype(np.uint32)
    elif how[0] == "string":
        data, at = utf8(ids)
        padded = np.concatenate([data, np.zeros(how[1] + 4, np.uint8)])
        for k in range(4):
            there = at[:-1] + how[1] + k
            out = (out << np.uint32(8)) | np.where(there < at[1:], padded[there], 0).astype(np.uint32)
    return np.where(ids.is_null().to_numpy(zero_copy_only=False), np.uint32(_LAST), out)


def _ordering(kind: str, lo, hi) -> tuple:
    """How ``_order`` maps ids from lo to hi."""
    if kind == "bigint":
        return ("long", lo or 0, max(0, ((hi or 0) - (lo or 0)).bit_length() - 32))
    if kind != "string":
        return ("none",)
    a, b = (lo or "").encode(), (hi or "").encode()
    return ("string", next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b))))


def _prefixes(batches, level: np.ndarray, seed: int, bits: int, t: float, how: tuple, parts: int, hot: int):
    """Records of the sets at their prefixes' words, those of one part of the words in
    a blob: (part, wide, records). A set is sent once in a task, and again only
    for an earlier line."""
    seen: dict[tuple[int, int], int] = {}
    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = 0

    def flush():
        part = np.concatenate([p for p, _ in held])
        every = {d: np.concatenate([np.zeros(0, d), *(r for _, r in held if r.dtype == d)]) for d in (_NARROW, _WIDE)}
        of = np.concatenate([np.full(len(r), r.dtype == _WIDE) for _, r in held])
        for d, rec in every.items():
            own = part[of == (d == _WIDE)]
            if not len(own):
                continue
            order = np.argsort(own, kind="stable")
            own, rec = own[order], rec[order]
            new = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            at = np.append(new, len(own)).astype(np.int64) * d.itemsize
            blob = pa.Array.from_buffers(pa.large_binary(), len(new), [None, pa.py_buffer(at), pa.py_buffer(rec.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(own[new].astype(np.int32)), pa.array(np.full(len(new), d == _WIDE)), blob], ["part", "wide", "records"])

    for b, lo, hi, s, text_at in _parts(batches, level, seed, bits):
        has = np.flatnonzero(s.size)
        text = np.searchsorted(text_at, has, "right") - 1
        doc = _order(b.column(0).slice(lo, hi - lo), how)[text]
        at = (doc.astype(np.uint64) << np.uint64(16)) | np.minimum(has - text_at[text], 65535).astype(np.uint64)
        # the earliest line of each set
        o = np.lexsort((at, s.low[has], s.set[has]))
        has, at = has[o], at[o]
        new = np.append(True, (s.set[has][1:] != s.set[has][:-1]) | (s.low[has][1:] != s.low[has][:-1]))[: len(has)]
        has, at = has[new], at[new]
        if len(seen) > 1_000_000:
            seen.clear()
        keys, places = list(zip(s.set[has].tolist(), s.low[has].tolist())), at.tolist()
        go = np.fromiter((seen.get(k, 1 << 62) > x for k, x in zip(keys, places)), bool, len(keys))
        seen.update((k, x) for k, x, g in zip(keys, places, go.tolist()) if g)
        has, at = has[go], at[go]
        own, place, key = keys_of(s.ids, s.first[has], s.size[has], t, hot)
        part, key = _point(key, parts)
        small = s.size[has] < 256
        for d, which in ((_NARROW, small[own]), (_WIDE, ~small[own])):
            if not which.any():
                continue
            i = own[which]
            rec = np.empty(len(i), d)
            rec["key"], rec["place"] = key[which], place[which]
            rec["set"], rec["low"], rec["high"], rec["size"] = s.set[has][i], s.low[has][i], s.high[has][i], s.size[has][i]
            rec["doc"], rec["line"] = at[i] >> np.uint64(16), at[i] & np.uint64(65535)
            held.append((part[which].astype(np.int32), rec))
            rows += len(i)
        if rows >= _ENTRIES:
            yield from flush()
            held, rows = [], 0
    if held:
        yield from flush()


def _point(key: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(part, number within it) of a key."""
    return ((key >> np.uint64(32)) % np.uint64(parts)).astype(np.int64), (key & np.uint64(_LAST)).astype(np.int64)


def _at_points(batches, level: np.ndarray, seed: int, bits: int, t: float, parts: int, hot: int, points: np.ndarray):
    """All that meets at some points: (point, set, low, high, size, rest, row, doc_id,
    line, words) of the lines, rest being the words from the meeting point on."""
    names = ["point", "set", "low", "high", "size", "rest", "row", "doc_id", "line", "words"]
    for b, lo, hi, s, text_at in _parts(batches, level, seed, bits):
        has = np.flatnonzero(s.size)
        own, place, key = keys_of(s.ids, s.first[has], s.size[has], t, hot)
        part, key = _point(key, parts)
        point = (part << 32) | key
        there = np.isin(point, points)
        own, place, point = has[own[there]], place[there], point[there]
        text = np.searchsorted(text_at, own, "right") - 1
        doc = [b.column(i).slice(lo, hi - lo).take(pa.array(text)) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([pa.array(point), *(pa.array(x.view(np.int64)[own]) for x in (s.set, s.low, s.high)), pa.array(s.size[own]), pa.array(s.size[own] - place), *doc, pa.array(own - text_at[text]), s.bags(own).cast(pa.string())], names)


def _meet(batches, t: float, most: int | None):
    """Candidates (set, low, set2, low2, at2) of what meets at a word, the second
    set's line being the earlier one or possibly so; the ``most`` earliest of each
    set, and if there are more, a row without a second set, with the meeting point
    and the place from which on some are missing."""
    names = ["set", "low", "set2", "low2", "at2"]

    def join(part, blobs):
        recs = [np.frombuffer(b"".join(x for w, x in blobs if w == wide), d) for wide, d in ((False, _NARROW), (True, _WIDE))]
        key, set_, low, high = (np.concatenate([r[c] for r in recs]) for c in ("key", "set", "low", "high"))
        size, place = (np.concatenate([r[c].astype(np.int64) for r in recs]) for c in ("size", "place"))
        at = np.concatenate([(r["doc"].astype(np.uint64) << np.uint64(16)) | r["line"] for r in recs])
        del recs
        head = (key.astype(np.uint64) << np.uint64(32)) | size.astype(np.uint64)
        o = np.lexsort((set_, head))
        head, set_, low, high, size, place, at = (x[o] for x in (head, set_, low, high, size, place, at))
        # one of each set, and of sets of one hash and different parities
        new = np.flatnonzero(np.append(True, (head[1:] != head[:-1]) | (set_[1:] != set_[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (place[1:] != place[:-1])))
        at = np.minimum.reduceat(at, new)
        head, set_, low, high, size, place = (x[new] for x in (head, set_, low, high, size, place))
        word = head >> np.uint64(32)
        bound = np.full(len(word), 2**63 - 1, np.int64)
        later, earlier, held = [], [], 0

        def fewer():
            """Keep the earliest of each set's candidates."""
            i, j = np.concatenate(later), np.concatenate(earlier)
            if most is not None:
                o = np.lexsort((at[j], i))
                i, j = i[o], j[o]
                start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                rank = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i))))
                cut = rank == most - 1
                over = np.flatnonzero(rank == most)
                bound[i[over]] = np.minimum(bound[i[over]], at[j[cut]][np.searchsorted(i[cut], i[over])].astype(np.int64))
                i, j = i[rank < most], j[rank < most]
            return [i], [j]

        live, step = np.arange(len(word)), 0
        while True:
            step += 1
            live = live[live + step < len(word)]
            j = live + step
            ok = (word[j] == word[live]) & (size[live] >= t * size[j] - 1e-9)
            live = live[ok]
            if not len(live):
                break
            j = live + step
            both = size[live] + size[j]
            need = np.ceil(t / (1 + t) * both - 1e-9).astype(np.int64)
            good = np.flatnonzero(np.minimum(size[live] - place[live], size[j] - place[j]) >= need)
            x, y = live[good], j[good]
            differ = np.bitwise_count(low[x] ^ low[y]).astype(np.int64) + np.bitwise_count(high[x] ^ high[y])
            good = differ <= both[good] - 2 * need[good]
            x, y = x[good], y[good]
            for a, b in ((x, y), (y, x)):  # a later than b
                some = at[a] >= at[b]
                if some.any():
                    later.append(a[some])
                    earlier.append(b[some])
                    held += int(some.sum())
            if held > _PAIRS:
                later, earlier = fewer()
                if len(later[0]) > _PAIRS // 2:  # many sets, each with few
                    yield from rows(set_, low, at, later[0], earlier[0])
                    later, earlier = [], []
                held = sum(map(len, later))
        if later:
            (i,), (j,) = fewer()
            yield from rows(set_, low, at, i, j)
        some = np.flatnonzero(bound < 2**63 - 1)
        if len(some):
            where = (part << 32) | word[some].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(set_[some].view(np.int64)), pa.array(low[some].view(np.int64)), pa.nulls(len(some), pa.int64()), pa.array(where), pa.array(bound[some])], names)

    def rows(set_, low, at, i, j):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (set_[i].view(np.int64), low[i].view(np.int64), set_[j].view(np.int64), low[j].view(np.int64), at[j].view(np.int64))], names)

    held, now = [], None
    for b in batches:
        for part, wide, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            if part != now and held:
                yield from join(now, held)
                held = []
            now = part
            held.append((wide, blob.as_buffer()))
    if held:
        yield from join(now, held)


def _bags(batches, level: np.ndarray, seed: int, bits: int):
    """(set, low, words) of the lines, each set once in a batch."""
    for _, _, _, s, _ in _parts(batches, level, seed, bits):
        has = np.flatnonzero(s.size)
        has = has[np.lexsort((s.low[has], s.set[has]))]
        once = has[np.append(True, (s.set[has][1:] != s.set[has][:-1]) | (s.low[has][1:] != s.low[has][:-1]))[: len(has)]]
        yield pa.RecordBatch.from_arrays([pa.array(s.set.view(np.int64)[once]), pa.array(s.low.view(np.int64)[once]), s.bags(once).cast(pa.string())], ["set", "low", "words"])


def _similar(a: Column, b: Column, t: float) -> Column:
    """Whether two sets, written as words with a blank after each, are similar."""
    x, y = F.split(a, " "), F.split(b, " ")  # both have an empty word besides
    common = F.size(F.array_intersect(x, y)) - 1
    return common >= F.lit(t - 1e-12) * (F.size(x) + F.size(y) - 2 - common)


def _settled(found: DataFrame, bags: DataFrame, t: float, name: str) -> Table:
    """Of the candidates found: (set, low, at2, match) of the sets that have an
    earlier match, with the earliest."""
    x = bags.select("set", "low", F.col("first").alias("own"), F.col("words").alias("wa"))
    y = bags.select(F.col("set").alias("set2"), F.col("low").alias("low2"), F.col("first").alias("match"), F.col("words").alias("wb"))
    both = found.join(x, ["set", "low"]).join(y, ["set2", "low2"]).where((F.col("match") < F.col("own")) & _similar(F.col("wa"), F.col("wb"), t))
    return Table(both.groupBy("set", "low").agg(F.min("at2").alias("at2"), F.min("match").alias("match")), name)


def _search(rows: DataFrame, t: float, seed: int, bits: int, most: int, hot: int) -> tuple[DataFrame, DataFrame] | None:
    """(lines, sets whose lines don't all stay, with the earliest match of each), or
    None where hashes collide."""
    kind = dict(rows.dtypes)["doc_id"]
    all_ = Table(rows.mapInArrow(lambda it: _first(it, seed, bits), f"kind int, row long, doc_id {kind}, line long, set long, low long, counts binary"), "lines").df
    n, last, lo, hi = all_.agg(F.count_if(F.col("kind") == 0), F.max("kind"), F.min("doc_id"), F.max("doc_id")).first()
    if last == 2:
        return None
    lines = all_.where("kind = 0").select("row", "doc_id", "line", "set", "low")
    level = rows.sparkSession.sparkContext.broadcast(rarity(all_.where("kind = 1").select(F.col("line").cast("int").alias("slice"), "counts")))
    how = _ordering(kind, lo, hi)
    tasks = min(20_000, max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // LINES)))
    parts = max(4 * tasks, n // (LINES // 4))
    texts = rows.select("doc_id", "text")

    sent = texts.mapInArrow(lambda it: _prefixes(it, level.value, seed, bits, t, how, parts, hot), "part int, wide boolean, records binary")
    sent = sent.repartition(tasks, "part").sortWithinPartitions("part")
    met = sent.mapInArrow(lambda it: _meet(it, t, most), "set long, low long, set2 long, low2 long, at2 long")
    met = met.repartition("set", "low").groupBy("set", "low", "set2", "low2").agg(F.min("at2").alias("at2"))
    rank = F.dense_rank().over(Window.partitionBy("set", "low").orderBy("at2"))
    found = Table(met.withColumn("rank", rank), "line-pairs").df
    bound = found.where("set2 IS NULL").select("set", "low", F.col("low2").alias("where"), F.col("at2").alias("bound"))
    found = found.where("set2 IS NOT NULL")
    place = F.struct(F.col("doc_id").isNull().alias("x0"), F.col("doc_id").alias("x1"), F.col("row").alias("x2"), F.col("line").alias("x3"))
    first = lines.groupBy("set", "low").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("times"))

    ids = found.select("set", "low").union(found.select("set2", "low2")).distinct().withColumn("met", F.lit(True))
    some = Table(first.join(ids, ["set", "low"], "left").where("met OR times > 1").select("set", "low", "first", "times"), "line-sets")
    key = some.df.select(F.col("set").alias("s"), F.col("low").alias("l"))
    bags = texts.select("text").mapInArrow(lambda it: _bags(it, level.value, seed, bits), "set long, low long, words string")
    bags = bags.join(some.small(key), (F.col("set") == F.col("s")) & (F.col("low") == F.col("l")), "left_semi")
    bags = bags.groupBy("set", "low").agg(F.min("words").alias("words"), F.max("words").alias("others"))
    bags = Table(bags.join(some.df, ["set", "low"]), "line-words").df
    if not bags.where("words <> others").isEmpty():
        return None
    match = _settled(found.where("rank = 1"), bags, t, "line-matches").df
    later = Table(found.where("rank > 1").join(match, ["set", "low"], "left_anti"), "line-later")
    wanted = later.df.select("set", "low").union(later.df.select("set2", "low2")).distinct()
    match = match.unionByName(_settled(later.df, bags.drop("others").join(later.small(wanted), ["set", "low"], "left_semi"), t, "line-matches").df)
    # sets whose earliest match may be among the candidates that were not sent, and where they met these
    open_ = Table(bound.join(match, ["set", "low"], "left").where("at2 IS NULL OR at2 >= bound").select("set", "low", "where"), "line-open").df
    points = [r[0] for r in open_.select("where").distinct().toLocalIterator()]
    for k in range(0, len(points), POINTS):
        now = np.sort(np.array(points[k : k + POINTS], np.int64))
        all_at = rows.mapInArrow(lambda it, now=now: _at_points(it, level.value, seed, bits, t, parts, hot, now), f"point long, set long, low long, high long, size long, rest long, row long, doc_id {kind}, line long, words string")
        own = F.min(place).alias("first")
        all_at = Table(all_at.groupBy("point", "set", "low", "high", "size", "rest").agg(own, F.min("words").alias("words"), F.max("words").alias("others")), "line-points").df
        if not all_at.where("words <> others").isEmpty():
            return None
        x = all_at.join(open_.withColumnRenamed("where", "point"), ["point", "set", "low"], "left_semi")
        y = all_at.select("point", *[F.col(c).alias(f"{c}2") for c in ("set", "low", "high", "size", "rest", "first", "words")])
        need = F.ceil(F.lit(t / (1 + t)) * (F.col("size") + F.col("size2")) - 1e-9)
        differ = F.bit_count(F.col("low").bitwiseXOR(F.col("low2"))) + F.bit_count(F.col("high").bitwiseXOR(F.col("high2")))
        able = (F.col("first2") < F.col("first")) & (F.least("rest", "rest2") >= need) & (differ <= F.col("size") + F.col("size2") - 2 * need)
        both = x.join(y, "point").where(able).where(_similar(F.col("words"), F.col("words2"), t))
        both = both.groupBy("set", "low").agg(F.min("first2").alias("match")).withColumn("at2", F.lit(None).cast("long"))
        match = match.unionByName(Table(both.select("set", "low", "at2", "match"), "line-matches").df)
    if points:
        match = match.groupBy("set", "low").agg(F.min("match").alias("match"))
    best = bags.drop("words", "others").join(match.select("set", "low", "match"), ["set", "low"], "left").where("times > 1 OR match IS NOT NULL")
    best = best.select(F.col("set").alias("s"), F.col("low").alias("l"), F.least("first", F.coalesce("match", "first")).alias("m"))
    return lines, best


def line_matches(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", row: str | None = None, hash_bits: int = HASH_BITS, candidates: int = CANDIDATES, hot: int = HOT) -> DataFrame:
    """(row, doc_id, line, first_doc_id, first_line) of the lines that have to go,
    each with the earliest line that matches it; lines count from 0.

    Lines end at line ends. Case, punctuation and repetition of words don't
    count. Lines without a word, null and empty texts match nothing. Null ids
    come last. Ids keep their type (strings sort by their bytes). Repeated rows
    and ids are told apart by the row's number: the lines of all but one go. Of
    lines that match equally well the earliest counts. Very long texts and lines
    are compared whole. An empty table gives no rows. No columns but the named
    ones are read, whatever others there are. The result is the same whatever
    ``hash_bits``, ``candidates`` and ``hot`` are (see the constants)."""
    number = F.monotonically_increasing_id() if row is None else col(row)
    rows = spread(docs).select(number.cast("long").alias("row"), id_column(docs, doc_id).alias("doc_id"), col(text).cast("string").alias("text"))
    seed, found = 0, None
    while found is None:
        found = _search(rows, float(threshold), seed, hash_bits, candidates, hot)
        seed += 1
    lines, best = found
    place = F.struct(F.col("doc_id").isNull().alias("x0"), F.col("doc_id").alias("x1"), F.col("row").alias("x2"), F.col("line").alias("x3"))
    out = lines.join(Table(best, "line-best").small(), (F.col("set") == F.col("s")) & (F.col("low") == F.col("l"))).where(place > F.col("m"))
    return out.select("row", "doc_id", "line", F.col("m.x1").alias("first_doc_id"), F.col("m.x3").alias("first_line"))


def dedup_lines(docs: DataFrame, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id", hash_bits: int = HASH_BITS) -> DataFrame:
    """The documents with their columns, their texts without the lines that
    ``line_matches`` finds; texts none of whose lines stay are empty."""
    r, gone, k = free_name(docs, "line_row"), free_name(docs, "line_gone"), free_name(docs, "line_key")
    numbered = Table(docs.withColumn(r, F.monotonically_increasing_id()), "line-docs").df
    drop = line_matches(numbered, threshold, text, doc_id, r, hash_bits).groupBy(F.col("row").alias(k)).agg(F.collect_set(F.col("line").cast("int")).alias(gone))
    kept = F.array_join(F.filter(F.split(col(text), "\n"), lambda x, i: ~F.array_contains(F.col(gone), i)), "\n")
    out = numbered.join(drop, F.col(r) == F.col(k), "left")
    return out.withColumn(text, F.when(F.col(gone).isNull(), col(text)).otherwise(kept)).select(*[col(c) for c in docs.columns])


#: Words of a line as the operator sees them, in DuckDB's SQL.
_WORDS_SQL = r"""list_filter(string_split_regex(translate(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{upper}', '{lower}'),
    '[\x09-\x0D !-/:-@\[-`{{-~]+'), lambda x: x <> '')"""


def lines_sql(threshold: float = THRESHOLD, table: str = "documents") -> str:
    """DuckDB's SQL for ``line_matches`` (without ``row``) where ids are neither null
    nor repeated: distinct sets are joined at every word of their prefixes."""
    upper = "".join(chr(c) for c in range(0xC0, 0xDF) if c != 0xD7)
    split = _WORDS_SQL.format(upper=upper, lower="".join(chr(ord(c) + 32) for c in upper))
    t = float(threshold)
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM {table} WHERE text IS NOT NULL),
w AS (SELECT doc_id, line_no, list_sort(list_distinct({split})) AS words FROM l),
s AS MATERIALIZED (SELECT words, min((doc_id, line_no)) AS first FROM w WHERE len(words) > 0 GROUP BY words),
n AS MATERIALIZED (SELECT row_number() OVER () AS set, words, first, len(words) AS size FROM s),
e AS MATERIALIZED (SELECT set, size, unnest(words) AS word FROM n),
c AS (SELECT word, count(*) AS times FROM e GROUP BY word),
p AS MATERIALIZED (SELECT set, size, word FROM e JOIN c USING (word)
      QUALIFY row_number() OVER (PARTITION BY set ORDER BY times, word) <= size - ceil({t} * size - 1e-9) + 1),
q AS (SELECT DISTINCT a.set AS a, b.set AS b FROM p a JOIN p b ON a.word = b.word AND a.set <> b.set AND a.size >= {t} * b.size - 1e-9 AND b.size >= {t} * a.size - 1e-9),
m AS (SELECT a, min(y.first) AS first FROM q JOIN n x ON a = x.set JOIN n y ON b = y.set
      WHERE len(list_intersect(x.words, y.words)) >= ({t} - 1e-12) * (x.size + y.size - len(list_intersect(x.words, y.words))) GROUP BY a),
k AS (SELECT n.words, least(n.first, coalesce(m.first, n.first)) AS first FROM n LEFT JOIN m ON n.set = m.a)
SELECT w.doc_id, w.line_no::BIGINT AS line, k.first[1] AS first_doc_id, k.first[2]::BIGINT AS first_line
FROM w JOIN k USING (words) WHERE (w.doc_id, w.line_no) > k.first"""
