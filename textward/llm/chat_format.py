"""Chat formatting by columnar byte assembly, and the way back.

A turn becomes `<|im_start|>` role `\\n` content `<|im_end|>\\n`. In contents and roles a backslash becomes two and `<|`
becomes `<\\|`, so that no control string can arise from a text; in roles a newline becomes `\\n`. Segment lengths of a batch
give offsets by a cumulative sum, and headers, contents and trailers are copied into one preallocated Arrow buffer. The loss
mask is a list of byte spans over the contents of assistant turns.

Turns are dealt by ranges of (conv_id, turn, beginnings of role and text), so that a long conversation is split, sorted and streamed: the output is
a row for each stretch of at most STRETCH turns, numbered in order. Reading back hashes each conversation's turns one after
another, as the digest asks, in one task that holds a stretch at a time. A null text or role is empty, a null turn comes first, turns alike are ordered by role and text, a null conv_id is a
conversation of its own, rows that repeat a turn are turns each, and an empty table gives no rows. Other columns are unused.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved, ship

START, END = "<|im_start|>", "<|im_end|>"
TRAILER = END + "\n"
#: Turns in a row of the output.
STRETCH = 512
FORMATTED = "conv_id long, stretch long, formatted string, spans array<struct<begin:long,end:long>>"


def _escaped(texts: pa.Array) -> pa.Array:
    return pc.replace_substring(pc.replace_substring(texts, "\\", "\\\\"), "<|", "<\\|")


def unescaped(text: str) -> str:
    return re.sub(r"\\([\\|n])", lambda m: "\n" if m[1] == "n" else m[1], text)


def _bytes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contents and row lengths of a string array."""
    a = a.cast(pa.large_binary())
    offsets = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    data = np.frombuffer(a.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if a.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


def assemble(roles: pa.Array, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One buffer with all turns; the turns' end offsets, and begin and end of their contents in it."""
    roles, texts = pc.fill_null(roles, ""), pc.fill_null(texts, "")
    names = pc.replace_substring(_escaped(roles), "\n", "\\n")
    heads = pc.binary_join_element_wise(pa.scalar(START), names, pa.scalar("\n"), "")
    parts = [_bytes(heads), _bytes(_escaped(texts)), _bytes(pa.array([TRAILER] * len(texts), pa.string()))]
    sizes = np.stack([n for _, n in parts], axis=1)
    ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
    begins = ends - sizes
    out = np.empty(int(ends[-1, -1]) if len(texts) else 0, np.uint8)
    for k, (data, n) in enumerate(parts):
        at = np.repeat(begins[:, k] - (np.cumsum(n) - n), n)
        at += np.arange(len(at))
        out[at] = data
    return out, ends[:, 2], begins[:, 1], ends[:, 1]


def format_turns(turns: DataFrame) -> DataFrame:
    """conv_id, stretch (its place), formatted and spans (byte spans under the loss mask) of every conversation."""
    ship(turns.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = TaskContext.get().partitionId() << 32  # a conversation's later ranges are later stretches
        last, stretch, turn = object(), 0, 0  # of the conversation that the last batch ended in
        for batch in batches:
            for base in range(0, len(batch), 4096):
                part = batch.slice(base, 4096)
                out, ends, begin, end = assemble(part.column(2), part.column(3))
                ids = part.column(0).to_pylist()
                loss = pc.fill_null(pc.equal(part.column(2), "assistant"), False).to_numpy(zero_copy_only=False)
                rows: list[tuple[int | None, int, int, int]] = []  # conv_id, stretch, first turn, last turn + 1
                for k, c in enumerate(ids):
                    if c != last:
                        last, stretch, turn = c, begun, 0
                        rows.append((c, begun, k, k))
                    elif turn % STRETCH == 0 or not rows:
                        stretch += 1
                        turn = 0
                        rows.append((c, stretch, k, k))
                    turn += 1
                    rows[-1] = (*rows[-1][:3], k + 1)
                edge = np.concatenate([[0], ends])
                cuts = np.array([edge[r[2]] for r in rows] + [edge[-1]])
                spans = [[{"begin": int(begin[t] - edge[a]), "end": int(end[t] - edge[a])} for t in range(a, b) if loss[t]] for _, _, a, b in rows]
                text = pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(cuts.astype(np.int64)), pa.py_buffer(out)]).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()), text, pa.array(spans, pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])))], ["conv_id", "stretch", "formatted", "spans"])

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    order = ["conv_id", "turn", "role", "text"]
    # the ends of ranges go through the driver, so that of role and text only beginnings are in them, which sort alike
    ends = ["conv_id", "turn", F.left("role", F.lit(64)), F.left("text", F.lit(64))]
    return rows.repartitionByRange(*ends).sortWithinPartitions(*order).mapInArrow(run, FORMATTED)


_TURN = re.compile(re.escape(START) + r"([^\n]*)\n(.*?)" + re.escape(TRAILER), re.DOTALL)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, parsed from format_turns()'s output."""
    ship(formatted.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: object = object()
        n = loss_n = chars = 0
        turns, loss = hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                if row["conv_id"] != last:
                    if n:
                        done.append((last, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars))
                    last, n, loss_n, chars = row["conv_id"], 0, 0, 0
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                text = row["formatted"]
                chars += len(text)
                for m in _TURN.finditer(text):
                    n += 1
                    turns.update(f"{unescaped(m[1])}\n{unescaped(m[2])}\n".encode())
                raw = text.encode()
                for span in row["spans"]:
                    own = unescaped(raw[span["begin"] : span["end"]].decode())
                    loss_n += len(own)
                    loss.update(own.encode())
            if done:
                yield _digests(done)
        if n:
            yield _digests([(last, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars)])

    return formatted.repartition("conv_id").sortWithinPartitions("conv_id", "stretch").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def report(turns: DataFrame) -> DataFrame:
    """Format, write the output to the shared folder, and return what is read back from it."""
    return read_back(saved(format_turns(turns), "chat"))


#: report() in DuckDB, with the trial conversation that the query adds.
SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '<|im_end|><|im_start|>assistant ok'), (-1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')),
e AS (SELECT *, length(replace(replace(replace(role, '\', '\\'), '<|', '<\|'), chr(10), '\n')) + length(replace(replace(text, '\', '\\'), '<|', '<\|')) + 24 AS formatted FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(formatted)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
