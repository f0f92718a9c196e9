"""Token counts at every prefix, by dynamic programming over prefixes.

A byte-pair encoding of a piece of text is valid just if each two neighbouring
tokens of it are what their joined bytes are encoded to. So the last token of a
prefix is the one token that ends there and agrees with the last token of the
prefix before it, and the count is that prefix's count plus 1: one pass gives
the exact count at every prefix, without encoding any of them.

Texts are cut into pieces first, as the tokenizer does, by character classes in
numpy over whole batches. A piece's prefix counts are worked out once in a
worker and then looked up; the counts of a text are gathered from those of its
pieces and the sums of the pieces before. They are stored as they are, four bytes
for each character, so that one look answers how many tokens any truncation
leaves, and one pass over them where a budget of tokens ends.
"""

from __future__ import annotations

import base64
import sys
import types
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, free_name, id_column, spread
from .texts import hashes, slices, utf8

#: The budget in the production query.
BUDGET = 2048
#: Pieces that a worker remembers; beyond that it starts anew.
REMEMBERED = 400_000
_SPACE, _LETTER, _DIGIT, _OTHER = range(4)
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


def default_vocabulary() -> str:
    """The path of the byte-level vocabulary among the public tokenizers' files."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


class Counter:
    """Exact counts of a vocabulary of byte-pair ranks, given as lines of
    base64 bytes and rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {r: b for b, r in self.ranks.items()}
        self.most = max(map(len, self.ranks))
        self.agree: dict[int, bool] = {}
        kinds = {"L": _LETTER, "N": _DIGIT}
        self.kind = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), np.uint8, 0x110000)
        self.kind[_WHITE] = _SPACE
        self.forget()

    def forget(self) -> None:
        self.at: dict[int, int] = {}
        self.flat, self.used = np.zeros(1 << 20, np.int32), 0

    def encode(self, piece: bytes) -> list[int]:
        """Tokens of a piece by merging the pair of lowest rank, again and again."""
        if piece in self.ranks:
            return [self.ranks[piece]]
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, i = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, a: int, b: int) -> bool:
        k = a << 32 | b
        ok = self.agree.get(k)
        if ok is None:
            ok = self.agree[k] = self.encode(self.token[a] + self.token[b]) == [a, b]
        return ok

    def prefixes(self, pieces: list[bytes]) -> list[int]:
        """Tokens of piece[:1], piece[:2], ... for each of the sorted pieces. What a
        piece begins with like the one before it isn't worked out again."""
        ranks, agree, get = self.ranks, self.agree, self.ranks.get
        out: list[int] = []
        last, since, count, before = [-1], [0], [0], b""
        for piece in pieces:
            n, same = len(piece), 0
            most = min(n, len(before))
            while same < most and piece[same] == before[same]:
                same += 1
            del last[same + 1 :], since[same + 1 :], count[same + 1 :]
            for j in range(same + 1, n + 1):
                # any token that agrees is the only one: the last one grown by a byte is likely it
                i = since[j - 1]
                t = get(piece[i:j])
                if t is None or i and not (agree[k] if (k := last[i] << 32 | t) in agree else self.fits(last[i], t)):
                    for i in range(j - 1, max(0, j - self.most) - 1, -1):
                        t = get(piece[i:j])
                        if t is not None and (i == 0 or (agree[k] if (k := last[i] << 32 | t) in agree else self.fits(last[i], t))):
                            break
                    else:
                        raise ValueError("the vocabulary lacks single bytes")
                last.append(t)
                since.append(i)
                count.append(count[i] + 1)
            out += count[1:]
            before = piece
        return out

    def places(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where the counts of the byte ranges' prefixes begin in ``flat``: one for
        each character. The prefix counts of the contractions (``first`` True) are
        those of their parts."""
        h = hashes(data, start, end)
        h[first] ^= np.uint64(1)
        one, index, back = np.unique(h, return_index=True, return_inverse=True)
        if len(self.at) > REMEMBERED:
            self.forget()
        keys, at = one.tolist(), self.at
        new = [n for n, k in enumerate(keys) if k not in at]
        if new:
            pieces = sorted((data[start[i] : end[i]].tobytes(), n, bool(first[i])) for n, i in zip(new, index[new].tolist()))
            counts = np.array(self.prefixes([p for p, _, _ in pieces]), np.int32)
            joined = np.frombuffer(b"".join(p for p, _, _ in pieces), np.uint8)
            size = np.array([len(p) for p, _, _ in pieces])
            begin = np.cumsum(size) - size
            # 'l of 'll is two pieces
            counts[begin[[short and len(p) == 3 for p, _, short in pieces]] + 1] = 2
            ends = np.append((joined[1:] & 0xC0) != 0x80, True)
            places = np.cumsum(ends) - ends
            counts = counts[ends]
            while self.used + len(counts) > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.flat[self.used : self.used + len(counts)] = counts
            at.update(zip((keys[n] for _, n, _ in pieces), (places[begin] + self.used).tolist()))
            self.used += len(counts)
        return np.fromiter((at[k] for k in keys), np.int64, len(keys))[back]

    def counts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count at each character's end, first character of each text and their number)."""
        lead = (data & 0xC0) != 0x80
        byte = np.append(np.flatnonzero(lead), len(data))
        text_at = np.searchsorted(byte, offsets)
        n = len(byte) - 1
        if not n:
            return np.zeros(0, np.int32), text_at
        code = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        kind = self.kind[code]
        new = np.zeros(n + 1, bool)  # where a text begins
        new[text_at[:-1][text_at[:-1] < n]] = True
        new[n] = True
        space = kind == _SPACE
        turn = np.ones(n, bool)
        turn[1:] = (kind[1:] != kind[:-1]) | new[1:n]
        begin = turn.copy()
        # a run of white space before a word gives its last character away: a blank to the word, another as a piece
        runs = np.flatnonzero(turn & space)
        past = np.append(np.flatnonzero(turn), n)
        ends = past[np.searchsorted(past, runs, "right")]
        given = ends[~new[ends]] - 1
        begin[given] = True
        begin[given[code[given] == 32] + 1] = False
        # contractions
        mark = np.flatnonzero((code == 39) & turn)
        before = np.where(new[mark] | (mark == 0), 0, code[np.maximum(mark - 1, 0)])
        mark = mark[before != 32]
        pad = np.append(code, [0, 0, 0])
        inside = lambda k: ~new[np.minimum(mark + k, n)]
        a, b = np.where(inside(1), pad[mark + 1], 0), np.where(inside(1) & inside(2), pad[mark + 2], 0)
        two = np.isin(a, [115, 100, 109, 116])
        three = ~two & (((a == 108) & (b == 108)) | ((a == 118) & (b == 101)) | ((a == 114) & (b == 101)))
        for which, size in ((two, 2), (three, 3)):
            m = mark[which]
            begin[m + 1] = False
            if size == 3:
                begin[m + 2] = False
            rest = m + size
            begin[rest[rest < n]] = True
        short = np.zeros(n, bool)
        short[mark[two | three]] = True
        piece = np.flatnonzero(begin)
        after = np.append(piece[1:], n)
        place = self.places(data, byte[piece], byte[after], short[piece])
        size = after - piece
        total = self.flat[place + size - 1].astype(np.int64)
        upto = np.cumsum(total) - total
        text_of = np.searchsorted(text_at, piece, "right") - 1
        first_piece = np.searchsorted(piece, text_at[:-1])
        base = upto - upto[np.minimum(first_piece[text_of], len(piece) - 1)]
        within = np.arange(n) - np.repeat(piece, size)
        out = np.repeat(base, size) + self.flat[np.repeat(place, size) + within]
        # characters of white space end a prefix whose last piece is the run so far
        if len(runs):
            base_at = base[np.searchsorted(piece, runs)]
            again = self.places(data, byte[runs], byte[ends], np.zeros(len(runs), bool))
            long = ends - runs
            steps = np.arange(int(long.sum())) - np.repeat(np.cumsum(long) - long, long)
            out[np.repeat(runs, long) + steps] = np.repeat(base_at, long) + self.flat[np.repeat(again, long) + steps]
        return out.astype(np.int32), text_at


def _counter(path: str) -> Counter:
    """The worker's own, kept from task to task."""
    kept = sys.modules.setdefault("_pixelloom_kept", types.ModuleType("_pixelloom_kept"))
    if getattr(kept, "path", None) != path:
        kept.counter, kept.path = Counter(path), path
    return kept.counter


def _count(batches, path: str, budget: int):
    for batch in batches:
        column = batch.column(1)
        none = column.is_null().to_numpy(zero_copy_only=False)
        data, offsets = utf8(column)
        for lo, hi in slices(offsets, 2 << 20):
            part = offsets[lo : hi + 1]
            c, at = _counter(path).counts(data[part[0] : part[-1]], part - part[0])
            n = np.diff(at)
            total = np.zeros(hi - lo, np.int64)
            total[n > 0] = c[at[1:][n > 0] - 1]
            # the last character at which the count is within the budget
            cut = np.zeros(hi - lo, np.int64)
            ok = np.flatnonzero(c <= budget)
            k = np.searchsorted(ok, at[1:]) - 1
            got = (k >= 0) & (n > 0)
            cut[got] = np.maximum(ok[k[got]] + 1 - at[:-1][got], 0)
            there = pa.array(~none[lo:hi]).buffers()[1] if none[lo:hi].any() else None
            blob = pa.Array.from_buffers(pa.binary(), hi - lo, [there, pa.py_buffer((4 * at).astype(np.int32)), pa.py_buffer(c.astype(">i4"))])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(total), blob, pa.array(cut)], ["doc_id", "tokens", "counts", "fits"])


def prefix_counts(docs: DataFrame, budget: int = BUDGET, vocabulary: str | None = None, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, tokens, counts, fits) for each row: its tokens, the count at each
    prefix (four bytes for each character, the highest first: the k-th is the
    exact count of the first k characters), and the characters of the longest
    prefix of no more than ``budget`` tokens.

    A null text has 0 tokens, null counts and fits 0; an empty one 0 tokens and
    no counts. Texts are counted whole, up to 500 million characters (a value of
    Spark's has 2 GB at most). Special tokens' names are ordinary text. Where two
    prefixes have the same count, the longer one fits. Repeated rows and ids stay,
    ids keep their type; an empty table gives no rows. No columns but the two
    named are read. ``vocabulary`` is a path that the workers can read."""
    path = vocabulary or default_vocabulary()
    rows = spread(docs.select(id_column(docs, doc_id).alias("doc_id"), col(text).cast("string").alias("text")))
    return rows.mapInArrow(lambda it: _count(it, path, budget), f"doc_id {dict(rows.dtypes)['doc_id']}, tokens long, counts binary, fits long")


def token_count(docs: DataFrame, vocabulary: str | None = None, text: str = "text") -> tuple[DataFrame, str]:
    """The documents with their tokens in one more column, and its name: what mixing
    and packing take as their token column."""
    name, path = free_name(docs, "n_tokens"), vocabulary or default_vocabulary()

    def count(s):
        import pandas as pd

        data, offsets = utf8(pa.array(s, pa.string()))
        out = []
        for lo, hi in slices(offsets, 2 << 20):
            part = offsets[lo : hi + 1]
            c, at = _counter(path).counts(data[part[0] : part[-1]], part - part[0])
            n = np.diff(at)
            total = np.zeros(hi - lo, np.int64)
            total[n > 0] = c[at[1:][n > 0] - 1]
            out.append(total)
        return pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))

    return docs.withColumn(name, F.pandas_udf(count, "long")(col(text).cast("string"))), name


def count_at(counts: Column, chars: Column) -> Column:
    """The tokens of the first ``chars`` characters (of all, if there are fewer), from
    the stored counts: the four bytes there, without user functions."""
    k = F.least(chars.cast("int"), (F.octet_length(counts) / 4).cast("int"))
    at = F.conv(F.hex(F.substring(counts, 4 * k - 3, F.lit(4))), 16, 10).cast("long")
    return F.when(k <= 0, F.lit(0).cast("long")).otherwise(at)


def longest_within(counts: Column, budget: Column) -> Column:
    """The characters of the longest prefix of no more than ``budget`` tokens. Counts
    may fall where a character completes a token, so all of them are looked at, those
    of a whole batch at once."""

    def at(s, b):
        import pandas as pd

        have = (s.notna() & b.notna()).to_numpy()
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        if have.any():
            blobs = s[have].tolist()
            c = np.frombuffer(b"".join(blobs), ">i4")
            n = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
            first = np.cumsum(n) - n
            ok = np.append(0, np.where(c <= np.repeat(b[have].to_numpy(np.int64), n), np.arange(len(c)) - np.repeat(first, n) + 1, 0))
            last = np.zeros(len(n), np.int64)
            last[n > 0] = np.maximum.reduceat(ok, first[n > 0] + 1) if (n > 0).any() else 0
            out[have] = last
        return out

    return F.pandas_udf(at, "long")(counts, budget)
