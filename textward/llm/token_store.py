"""A store of token ids: canonical length-limited Huffman coding in independent blocks with bit-offset checkpoints.

File format: a Parquet table of blocks, in files by rising doc_id. A block holds whole documents: part and block (its
place), first (ids before it in its part), doc_ids (int64), lengths (ids of each document, uint32), payload (32-bit words of
the code stream, most significant bit first) and marks (bit offset of every EVERY-th id, uint32). `<path>-code` holds the
code: code lengths by id (uint8), from which the canonical codes follow. All integers are little-endian.

Documents are encoded once into a store of plain ids (zstd), each task's last row being its counts of ids, whose sums give the
code; a range partition by doc_id then sorts the documents, and each partition codes its blocks. A null text counts as empty; a null doc_id sorts first; documents that
repeat a doc_id are ordered by their ids. An empty table gives an empty store. Columns other than doc_id and text are unused.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import ByteEncoder, chunks
from .common import ship, work_dir

#: Longest code, ids between two checkpoints, ids in a block (a longer document has a block of its own).
LONGEST, EVERY, BLOCK = 18, 128, 262_144
BLOCKS = "part int, block int, first long, doc_ids binary, lengths binary, payload binary, marks binary"


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most `longest` bits by package-merge; 0 for ids that do not occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << longest:
        raise ValueError(f"{len(used)} symbols do not fit into codes of {longest} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    levels, row = [], leaves
    for _ in range(longest - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        rank = np.argsort(both, kind="stable")
        levels.append(rank < len(leaves))
        row = both[rank]
    take = 2 * len(used) - 2
    of = np.zeros(len(used), np.int64)
    for leaf in [*reversed(levels), np.ones(len(used), bool)]:
        n = int(leaf[:take].sum())
        of[:n] += 1
        take = 2 * (min(take, len(leaf)) - n)
    lengths[order] = of
    return lengths


class Code:
    """The canonical code of given lengths, with a table from the next LONGEST bits to id and length."""

    def __init__(self, lengths: np.ndarray):
        self.lengths = lengths.astype(np.int64)
        self.width = int(self.lengths.max(initial=1))
        ids = np.flatnonzero(self.lengths)
        ids = ids[np.lexsort((ids, self.lengths[ids]))]
        own = self.lengths[ids]
        spans = np.int64(1) << (self.width - own)
        starts = np.cumsum(spans) - spans
        self.codes = np.zeros(len(lengths), np.uint64)
        self.codes[ids] = (starts >> (self.width - own)).astype(np.uint64)
        self.symbol = np.zeros(1 << self.width, np.int32)
        self.symbol[: int(spans.sum())] = np.repeat(ids, spans)
        self.step = self.lengths[self.symbol]

    def encode(self, ids: np.ndarray) -> tuple[bytes, bytes]:
        """Payload and marks."""
        sizes = self.lengths[ids]
        if not sizes.all():
            raise ValueError("an id without a code")
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ids) else 0
        at = ends - sizes
        window = self.codes[ids] << (64 - (at & 31) - sizes).astype(np.uint64)
        n = (total + 31) // 32 + 2
        words = np.bincount(at >> 5, weights=(window >> np.uint64(32)).astype(np.float64), minlength=n)
        words += np.bincount((at >> 5) + 1, weights=(window & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n)
        return words.astype("<u4").tobytes(), at[::EVERY].astype("<u4").tobytes()

    def decode(self, payload: bytes, marks: bytes, n: int) -> np.ndarray:
        """All n ids: the stretches between checkpoints are read side by side, one id of each at a time."""
        if not n:
            return np.zeros(0, np.int32)
        words = np.frombuffer(payload, "<u4").astype(np.uint64)
        pairs = (words[:-1] << np.uint64(32)) | words[1:]
        at = np.frombuffer(marks, "<u4").astype(np.int64)
        out = np.zeros((len(at), EVERY), np.int32)
        full, mask = n // EVERY, np.uint64((1 << self.width) - 1)
        for k in range(EVERY):
            rows = len(at) if full * EVERY + k < n else full
            p = at[:rows]
            bits = (pairs[p >> 5] >> (64 - self.width - (p & 31)).astype(np.uint64)) & mask
            out[:rows, k] = self.symbol[bits]
            p += self.step[bits]
        return out.reshape(-1)[:n]


ENCODED = "doc_id long, ids binary, counts binary"


def encode_ids(docs: DataFrame, tokenizer: str, end: int) -> DataFrame:
    """doc_id and ids (binary, little-endian, 2 bytes each if the vocabulary allows, else 4) of every whole text, `end` appended; and
    a row for each task with counts alone: pairs of id and count (int64)."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteEncoder.load(tokenizer)
        kind = "<u2" if encoder.size <= 65536 else "<u4"
        total = np.zeros(max(encoder.size, end + 1), np.int64)
        for batch in batches:
            for part in chunks(batch):
                offsets, ids = encoder.encode(part.column(1))
                total += np.bincount(ids, minlength=len(total))
                total[end] += len(part)
                raw = np.insert(ids, offsets[1:], end).astype(kind)
                ends = (offsets + np.arange(len(offsets))) * raw.itemsize
                column = pa.Array.from_buffers(pa.large_binary(), len(part), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(raw)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), column, pa.nulls(len(part), pa.binary())], ["doc_id", "ids", "counts"])
        used = np.flatnonzero(total)
        if len(used):
            own = np.stack([used, total[used]]).astype("<i8").tobytes()
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([own], pa.binary())], ["doc_id", "ids", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ENCODED)


def _counts(store: DataFrame, size: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for batch in batches:
            for x in batch.column(0):
                ids, n = np.frombuffer(x.as_buffer(), "<i8").reshape(2, -1)
                total[ids] += n
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids])], ["id", "n"])

    out = np.zeros(size, np.int64)
    for row in store.select("counts").where("counts is not null").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n")).collect():  # at most the vocabulary's size
        out[row["id"]] = row["n"]
    return out


def write_store(docs: DataFrame, path: str, tokenizer: str, end: int) -> None:
    """Write the texts' ids at `path` in this module's format."""
    spark = docs.sparkSession
    size = max(ByteEncoder.load(tokenizer).size, end + 1)
    kind = "<u2" if ByteEncoder.load(tokenizer).size <= 65536 else "<u4"
    plain = work_dir(spark, "ids")
    encode_ids(docs, tokenizer, end).write.option("compression", "zstd").parquet(plain)
    store = spark.read.schema(ENCODED).parquet(plain)
    lengths = code_lengths(_counts(store, size))
    spark.createDataFrame([(bytearray(lengths.tobytes()),)], "lengths binary").write.parquet(f"{path}-code")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, part, block, first = Code(lengths), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int, bytes]] = []
        n = 0

        def flush() -> pa.RecordBatch:
            nonlocal block, first, held, n
            ids = np.frombuffer(b"".join(x for _, x in held), kind)
            payload, marks = code.encode(ids)
            row = [[part], [block], [first], [np.array([d or 0 for d, _ in held], "<i8").tobytes() + np.packbits([d is None for d, _ in held]).tobytes()], [np.array([len(x) // ids.itemsize for _, x in held], "<u4").tobytes()], [payload], [marks]]
            block, first, held, n = block + 1, first + len(ids), [], 0
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4], strict=True)], ["part", "block", "first", "doc_ids", "lengths", "payload", "marks"])

        for batch in batches:
            for d, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = x.as_py()
                if held and n + len(raw) // int(kind[2]) > BLOCK:
                    yield flush()
                held.append((d, raw))
                n += len(raw) // int(kind[2])
        if held:
            yield flush()

    count = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = store.where("counts is null").select("doc_id", "ids").repartitionByRange(count, "doc_id").sortWithinPartitions("doc_id", "ids")
    ranged.mapInArrow(run, BLOCKS).write.option("compression", "none").parquet(path)


def read_store(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (array) of every document."""
    ship(spark)
    lengths = np.frombuffer(bytes(spark.read.parquet(f"{path}-code").first()[0]), np.uint8)
    blocks = spark.read.schema(BLOCKS).parquet(path)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([int(np.frombuffer(x.as_buffer(), "<u4").astype(np.int64).sum()) for x in b.column(1)], pa.int64())], ["part", "n"])

    by_part = blocks.select("part", "lengths").mapInArrow(sums, "part int, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()  # a row for each file
    base, before = {}, 0
    for row in sorted(by_part):
        base[row["part"]] = before
        before += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(lengths)
        for batch in batches:
            for k in range(len(batch)):
                part, _, first, doc_ids, sizes, payload, marks = (batch.column(c)[k].as_py() for c in range(7))
                sizes = np.frombuffer(sizes, "<u4").astype(np.int64)
                ids = code.decode(payload, marks, int(sizes.sum())).astype("<u4")
                ends = np.cumsum(sizes)
                raw = memoryview(ids).cast("B")
                crc = [zlib.crc32(raw[4 * (e - s) : 4 * e]) for s, e in zip(sizes.tolist(), ends.tolist(), strict=True)]
                # behind the ids a bit for each tells whether it is null
                owners = np.frombuffer(doc_ids, "<i8", len(sizes))
                nulls = np.unpackbits(np.frombuffer(doc_ids, np.uint8, offset=8 * len(sizes)), count=len(sizes)).astype(bool)
                columns = [pa.array(owners, pa.int64(), mask=nulls), pa.array(base[part] + first + ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    return blocks.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


def token_store(docs: DataFrame, tokenizer: str, end: int = 0, with_ids: bool = False) -> DataFrame:
    """Write the ids of all texts in the store's format in the shared folder, and return what is read back."""
    path = work_dir(docs.sparkSession, "tokens")
    write_store(docs, path, tokenizer, end)
    return read_store(docs.sparkSession, path, with_ids)
