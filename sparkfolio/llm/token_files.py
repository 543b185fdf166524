"""Token-id files in Simple-8b words.

A file holds the ids of a stretch of documents, one after the other, cut into blocks of ``BLOCK`` ids whatever the
documents.  All numbers are little-endian::

    magic        8 bytes
    blocks       64-bit words, then the places (unsigned 32-bit) and ids (unsigned 32-bit) of the block's escapes
    block table  for each block: offset in the file, first id's number in the file (both unsigned 64-bit), words, escapes (both unsigned 32-bit)
    documents    doc_ids (64-bit), whether each is known (a byte), and where each begins (unsigned 64-bit), and the end
    trailer      offset of the block table, blocks, documents, ids (unsigned 64-bit), magic

A word's top four bits select how many ids of how many bits share the other sixty; ids that the block's widest packing
leaves out are escapes: a zero stands in their place and the list behind the words has place and id.  The block
table lets a reader start at any block, and a block is decoded without looking at its words one by one.

The folder's ``_manifest`` (Parquet) names the files that count.  Each attempt of a task writes files of its own names,
and only those of attempts that ended are listed, so lost executors and repeated tasks leave no trace in what is read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkfolio.llm.packing import END_ID, _encoder

MAGIC = b"SPKIDS8B"
BLOCK = 65_536
#: Ids after which a file is closed at the next document's end.
FILE_IDS = 1 << 25
#: Fixed values of Simple-8b: ids a word and bits an id for each selector; the first two are runs of zeros.
COUNTS = (240, 120, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
BITS = (0, 0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)
_TABLE = np.dtype([("offset", "<u8"), ("first", "<u8"), ("words", "<u4"), ("escapes", "<u4")])
#: Ids of documents that a reader hands on at a time.
HANDED = 1 << 21


def _widest(lengths: np.ndarray) -> int:
    """The widest packing that is worth its words: beyond it ids are escapes of eight bytes each."""
    n, upto = len(lengths), np.cumsum(np.bincount(lengths, minlength=33))
    costs = {b: 8 * n / c + 8 * (n - upto[min(b, 32)]) for c, b in zip(COUNTS[2:-1], BITS[2:-1], strict=True)}
    return min(costs, key=costs.get)


def encode(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, places of escapes, escaped ids) of a block of unsigned 32-bit ids."""
    ids = ids.astype(np.uint64)
    n = len(ids)
    lengths = np.frexp(ids.astype(np.float64))[1]
    at = np.flatnonzero(lengths > _widest(lengths)).astype("<u4") if n else np.empty(0, "<u4")
    escaped = ids[at].astype("<u4")
    ids[at], lengths[at] = 0, 0
    # a selector fits where none of its ids is too long; zeros behind the end let the last word be any
    long = np.zeros(n + max(COUNTS), dtype=np.uint8)
    long[:n] = lengths
    over = np.zeros(len(long) + 1, dtype=np.int32)
    selector = np.full(n, len(COUNTS) - 1, dtype=np.uint8)
    for s in range(len(COUNTS) - 2, -1, -1):
        np.cumsum(long > BITS[s], out=over[1:], dtype=np.int32)
        fits = over[COUNTS[s] : COUNTS[s] + n] == over[:n]
        selector[fits] = s
        if not fits[: -max(COUNTS)].any():  # more ids of fewer bits fit nowhere then, but at the end
            break
    step, starts, k = np.array(COUNTS)[selector].tolist(), [], 0
    while k < n:
        starts.append(k)
        k += step[k]
    starts = np.array(starts, dtype=np.int64)
    used = selector[starts]
    padded = np.concatenate((ids, np.zeros(max(COUNTS), dtype=np.uint64)))
    words = used.astype(np.uint64) << np.uint64(60)
    for s in np.unique(used).tolist():
        c, b = COUNTS[s], BITS[s]
        if b:
            mine = np.flatnonzero(used == s)
            places = np.arange(c)
            words[mine] |= np.bitwise_or.reduce(padded[starts[mine][:, None] + places] << (places * b).astype(np.uint64), axis=1)
    return words.astype("<u8"), at, escaped


def decode(words: np.ndarray, at: np.ndarray, escaped: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids of a block."""
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array(COUNTS)[selector]
    starts = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()), dtype="<u4")
    for s in np.unique(selector).tolist():
        c, b = COUNTS[s], BITS[s]
        if b:
            mine = np.flatnonzero(selector == s)
            places = np.arange(c)
            mask = np.uint64((1 << b) - 1)
            out[starts[mine][:, None] + places] = (words[mine][:, None] >> (places * b).astype(np.uint64)) & mask
    out[at] = escaped
    return out[:n]


def _filesystem(path: str):
    """Arrow's file system of a path, and the path there."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


class Writer:
    """One file."""

    def __init__(self, folder: str, block: int = BLOCK):
        self.block = block
        self.name = f"ids-{uuid.uuid4().hex}.s8b"
        where, at = _filesystem(folder)
        self.out = where.open_output_stream(f"{at}/{self.name}")
        self.out.write(MAGIC)
        self.table: list[tuple] = []
        self.docs: list[int | None] = []
        self.starts = [0]
        self.held: list[bytes] = []
        self.waiting = self.coded = 0

    @property
    def ids(self) -> int:
        return self.starts[-1]

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc)
        self.starts.append(self.ids + len(ids) // 4)
        self.held.append(ids)
        self.waiting += len(ids) // 4
        if self.waiting >= self.block:
            self._code(last=False)

    def _code(self, last: bool) -> None:
        every = np.frombuffer(b"".join(self.held), dtype="<u4")
        lo = 0
        while len(every) - lo >= self.block or (last and lo < len(every)):
            block = every[lo : lo + self.block]
            words, at, escaped = encode(block)
            self.table.append((self.out.tell(), self.coded, len(words), len(at)))
            for x in (words, at, escaped):
                self.out.write(x.tobytes())
            lo += len(block)
            self.coded += len(block)
        self.held, self.waiting = [every[lo:].tobytes()], len(every) - lo

    def close(self) -> tuple[str, int, int]:
        """Name, ids and documents."""
        self._code(last=True)
        footer = self.out.tell()
        self.out.write(np.array(self.table, dtype=_TABLE).tobytes())
        self.out.write(np.array([d or 0 for d in self.docs], dtype="<i8").tobytes())
        self.out.write(np.array([d is not None for d in self.docs], dtype="u1").tobytes())
        self.out.write(np.array(self.starts, dtype="<u8").tobytes())
        self.out.write(np.array([footer, len(self.table), len(self.docs), self.ids], dtype="<u8").tobytes() + MAGIC)
        self.out.close()
        return self.name, self.ids, len(self.docs)


def read_file(path: str) -> Iterator[list[tuple[int | None, int, bytes]]]:
    """The documents of a file (doc_id, start in the file, little-endian unsigned 32-bit ids), some at a time."""
    where, at = _filesystem(path)
    with where.open_input_file(at) as f:
        end = f.size() - 40
        f.seek(end)
        trailer = f.read(40)
        if trailer[32:] != MAGIC:
            raise ValueError(f"not a file of token ids: {path}")
        footer, blocks, n, ids = np.frombuffer(trailer[:32], dtype="<u8").tolist()
        f.seek(footer)
        raw = f.read(end - footer)
        table = np.frombuffer(raw, dtype=_TABLE, count=blocks)
        lo = blocks * _TABLE.itemsize
        docs = np.frombuffer(raw, "<i8", n, lo).tolist()
        known = np.frombuffer(raw, "u1", n, lo + 8 * n).tolist()
        starts = np.frombuffer(raw, "<u8", n + 1, lo + 9 * n).tolist()
        k, first, have, parts = 0, 0, 0, []  # next document, number of the first id that is held, ids held
        rows: list = []
        handed = 0
        for b in range(blocks):
            offset, begin, words, escapes = table[b].tolist()
            f.seek(offset)
            raw = f.read(8 * words + 8 * escapes)
            size = (int(table[b + 1]["first"]) if b + 1 < blocks else ids) - begin
            parts.append(
                decode(np.frombuffer(raw, "<u8", words), np.frombuffer(raw, "<u4", escapes, 8 * words), np.frombuffer(raw, "<u4", escapes, 8 * words + 4 * escapes), size).tobytes()
            )
            have += size
            if k < n and starts[k + 1] <= first + have:
                held = b"".join(parts)
                while k < n and starts[k + 1] <= first + have:
                    rows.append((docs[k] if known[k] else None, starts[k], held[4 * (starts[k] - first) : 4 * (starts[k + 1] - first)]))
                    k += 1
                parts = [held[4 * (starts[k] - first) :]]
                handed += starts[k] - first
                first, have = starts[k], first + have - starts[k]
                if handed >= HANDED:
                    yield rows
                    rows, handed = [], 0
        if rows:
            yield rows


def write_ids(docs: DataFrame, path: str, *, tokenizer: str | None = None, end_id: int = END_ID, block: int = BLOCK, file_ids: int = FILE_IDS) -> None:
    """Write the ids of all ``docs`` (doc_id, text, ...) in ascending order of doc_id to files in the folder ``path``.

    A file is closed at the end of the document that fills it to ``file_ids``.  The folder must be one that driver and executors share and Arrow's file systems know.

    * A document is its ids and then ``end_id``: null and empty texts are the end alone.  A text may have any length; it
      may fill many blocks.
    * Null doc_ids come first.  Rows of one doc_id are all written, in the order of their texts' hashes, and may lie in several
      files.  Other columns are ignored.  An empty table gives a manifest without files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder, end = _encoder(tokenizer), np.array([end_id], dtype="<u4").tobytes()
        part, file, writer = TaskContext.get().partitionId(), 0, None
        names = ["part", "file", "name", "n_ids", "n_docs"]

        def listed() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x]) for x in (part, file, *writer.close())], names)

        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                some = batch.slice(lo, 512)
                for doc, ids in zip(some.column(0).to_pylist(), encoder.encode(some.column(1).to_pylist()), strict=True):
                    writer = writer or Writer(path, block)
                    writer.add(doc, ids + end)
                    if writer.ids >= file_ids:
                        yield listed()
                        file, writer = file + 1, None
        if writer:
            yield listed()

    spark = docs.sparkSession
    where, at = _filesystem(path)
    where.create_dir(at)
    # hash and row number only spread rows of one doc_id over ranges, in an order that a repeated task finds again
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"), F.monotonically_increasing_id().alias("i"))
    order = ["doc_id", "h", "i"]
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.mapInArrow(run, "part long, file long, name string, n_ids long, n_docs long").write.parquet(f"{path}/_manifest")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The documents of a folder of :func:`write_ids`: doc_id, start (ids of all documents before it), n_tokens, ids (binary, unsigned 32-bit)."""
    schema = "part long, file long, name string, n_ids long, n_docs long"
    files = spark.read.schema(schema).parquet(f"{path}/_manifest")
    # one row for each file of some 33 million ids
    before = F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1))
    placed = files.select("name", F.coalesce(before, F.lit(0)).alias("before")).repartition(max(1, min(files.count(), 100_000)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for rows in read_file(f"{path}/{name}"):
                    docs, starts, ids = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(docs, pa.int64()), pa.array([base + s for s in starts], pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                        ["doc_id", "start", "n_tokens", "ids"],
                    )

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
