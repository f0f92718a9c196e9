"""Chat formatting by columnar byte assembly.

The turns of a conversation are brought together in order by Spark. A batch of
turns is then formatted without a loop over them: the lengths of all segments
(header, content, footer of each turn), their cumulative offsets in the output
and the scatter indices of their bytes are computed in numpy, and headers and
contents are copied into one preallocated buffer, which becomes the Arrow
column of the conversations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, id_column
from .texts import utf8

START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"
#: The role of turns whose role is null.
NO_ROLE = "user"
#: Bytes of output that are assembled at a time.
BYTES = 32 << 20


def scatter(out: np.ndarray, to: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> None:
    """Copy the segments data[begin : begin + length] to out[to : ...], all at once."""
    total = int(length.sum())
    if not total:
        return
    ends = np.cumsum(length)
    within = np.arange(total) - np.repeat(ends - length, length)
    out[np.repeat(to, length) + within] = data[np.repeat(begin, length) + within]


def assemble(role: pa.Array, content: pa.Array, conversation: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """(texts, first turn of each). ``conversation`` has True where one begins."""
    names = role.fill_null(NO_ROLE).dictionary_encode()
    codes = names.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    heads = [(START + r + MIDDLE).encode() for r in names.dictionary.to_pylist()]
    foot = np.frombuffer(END.encode(), np.uint8)
    head_data = np.frombuffer(b"".join(heads), np.uint8)
    head_at = np.concatenate([[0], np.cumsum([len(h) for h in heads])]).astype(np.int64)
    data, offsets = utf8(content)
    head_n, text_n = np.diff(head_at)[codes], np.diff(offsets)
    ends = np.cumsum(head_n + text_n + len(foot))
    starts = ends - (head_n + text_n + len(foot))
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    scatter(out, starts, head_data, head_at[codes], head_n)
    scatter(out, starts + head_n, data, offsets[:-1], text_n)
    scatter(out, ends - len(foot), foot, np.zeros(len(ends), np.int64), np.full(len(ends), len(foot)))
    first = np.flatnonzero(conversation)
    at = np.append(starts[first], len(out)).astype(np.int64)
    return pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(at), pa.py_buffer(out)]), first


def _format(batches):
    """Sorted turns (id, role, text) to (id, turns, text), carrying over the last
    conversation of a batch, which may go on in the next."""
    held: list[pa.RecordBatch] = []
    size = 0

    def done(last: bool):
        nonlocal held, size
        t = pa.Table.from_batches(held).combine_chunks()
        n = t.num_rows
        a, b = t.column(0).slice(1), t.column(0).slice(0, n - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        new = np.append(True, ~same.to_numpy())
        cut = n if last else int(np.flatnonzero(new)[-1])
        held, size = ([] if last else t.slice(cut).to_batches()), 0
        # a conversation that goes on grows until it ends
        size = sum(b.nbytes for b in held)
        if cut:
            role, text = (t.column(i).slice(0, cut).combine_chunks() for i in (1, 2))
            role, text = (x if isinstance(x, pa.Array) else pa.concat_arrays(x.chunks) for x in (role, text))
            texts, first = assemble(role, text, new[:cut])
            turns = np.diff(np.append(first, cut))
            own = t.column(0).slice(0, cut).take(pa.array(first)).combine_chunks()
            own = own if isinstance(own, pa.Array) else pa.concat_arrays(own.chunks)
            yield pa.RecordBatch.from_arrays([own, pa.array(turns.astype(np.int64)), texts.cast(pa.string()) if len(texts) == 0 or texts.nbytes < 2**31 - 1 else texts], ["conv_id", "turns", "text"])

    least = BYTES
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        size += b.nbytes
        if size >= least:
            yield from done(False)
            least = max(BYTES, 2 * size)
    if held:
        yield from done(True)


def format_chats(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns, text): a row for each conversation, its turns in order as
    <|im_start|>role, line end, text, <|im_end|>, line end.

    Null turn numbers come first. Turns with the same number are ordered by role,
    then text (nulls first); repeated rows are all written. A null role is
    written as "user", a null text as nothing. Turns with a null conversation id
    form one conversation. Texts are written byte for byte, whatever they hold;
    a conversation may be up to 2 GB. Ids keep their type. No columns but the four
    named are read. An empty table gives no rows."""
    keys = [id_column(turns, conv_id).alias("conv_id"), col(turn).alias("turn"), col(role).cast("string").alias("role"), col(text).cast("string").alias("text")]
    sorted_ = turns.select(*keys).repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return sorted_.select("conv_id", "role", "text").mapInArrow(_format, f"conv_id {dict(sorted_.dtypes)['conv_id']}, turns long, text string")


CHAT_SQL = """
SELECT conv_id, count(*)::BIGINT AS turns,
  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), ''
             ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS text
FROM conversations GROUP BY conv_id"""
