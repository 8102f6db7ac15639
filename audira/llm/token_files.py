"""Token-id files: ids of whole texts in doc_id order, Huffman-coded in independent blocks.

Format. A folder holds two Parquet tables. ``codebook`` has (id, length): canonical codes of at most 16 bits follow from
it. ``blocks`` has one row per block: start (ids of all documents before it), doc_ids and doc_lengths of its whole
documents, bits (the codes of their ids, one after another) and checkpoints (bit offset of every 1,024th id). A block takes
documents until it has 65,536 ids; a longer document is a block of its own. Any block can be decoded alone, and from any
checkpoint. Spark's committer writes both tables, so a lost executor leaves no half-written file.

Order: documents are dealt out by ranges of (doc_id, hash of the text), so equal ids are in a fixed order and rows with
the same id need not share a task. Null ids come first. A null text is empty and has the end id only. An empty table gives
an empty folder of blocks and an empty result. Extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from audira.llm.huffman import Codebook, pack, unpack
from audira.llm.shared import map_batches, new_folder, pick, settle
from audira.llm.token_ids import encoded

#: Ids of blocks that are decoded together.
DECODED_IDS = 1 << 18


@dataclass(frozen=True)
class TokenFormat:
    end_id: int = 1
    block_ids: int = 1 << 16
    checkpoint_ids: int = 1024
    max_code_bits: int = 16


def ordered_ids(docs: DataFrame, tokenizer: str, fmt: TokenFormat) -> DataFrame:
    """(part, begin, doc_id, ids) in doc_id order: ids as binary; begin counts the ids before it in its part."""
    schema = "part int, begin long, doc_id long, n long, wide boolean, ids binary"
    end = np.array([fmt.end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, begin = TaskContext.get().partitionId(), 0
        for batch in batches:
            for first, last, ids, cuts in encoded(batch.column(1), tokenizer):
                n = np.diff(cuts) + 1
                all_ids = np.insert(ids, cuts[1:], end)
                wide = bool(all_ids.max(initial=0) >= 1 << 16)
                bounds = np.concatenate([[0], np.cumsum(n)])
                raw = all_ids.astype("<u4" if wide else "<u2")
                offsets = pa.py_buffer((bounds * raw.itemsize).astype(np.int32))
                column = pa.Array.from_buffers(pa.binary(), last - first, [None, offsets, pa.py_buffer(raw)])
                rows = last - first
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(rows, part, np.int32)), pa.array(begin + bounds[:-1]), batch.column(0).slice(first, rows), pa.array(n), pa.array(np.full(rows, wide)), column],
                    names=["part", "begin", "doc_id", "n", "wide", "ids"],
                )
                begin += int(bounds[-1])

    tie = F.xxhash64("text")
    dealt = docs.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
    return map_batches(dealt, run, schema)


def _ids(batch: pa.RecordBatch, raw: int, wide: int) -> list[np.ndarray]:
    return [np.frombuffer(b, "<u4" if w else "<u2") for b, w in zip(batch.column(raw).to_pylist(), batch.column(wide).to_pylist(), strict=True)]


def id_counts(ids: DataFrame) -> DataFrame:
    """(id, count) over all rows: each task sums its own, at most one row per id leaves it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            got = _ids(batch, 0, 1)
            here = np.bincount(np.concatenate(got), minlength=len(total)) if got else total[:0]
            here[: len(total)] += total
            total = here if len(here) else total
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["id", "n"])

    return map_batches(ids.select("ids", "wide"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


BLOCKS = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("doc_ids", T.ArrayType(T.LongType())),
        T.StructField("doc_lengths", T.ArrayType(T.LongType())),
        T.StructField("checkpoints", T.ArrayType(T.LongType())),
        T.StructField("bits", T.BinaryType()),
    ]
)


def blocks(ids: DataFrame, book: Codebook, before: dict[int, int], fmt: TokenFormat) -> DataFrame:
    """Whole documents in blocks; ``before`` has the ids of all parts before a part (one number per part)."""

    def block(start: int, docs: list, parts: list[np.ndarray], codes: np.ndarray, sizes: np.ndarray) -> tuple:
        bits, begins = pack(np.concatenate(parts), codes, sizes)
        return start, docs, [len(p) for p in parts], begins[:: fmt.checkpoint_ids].tolist(), bits.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, sizes = book.encoder()
        docs, parts, start, size, done = [], [], None, 0, []
        for batch in batches:
            starts = [before[p] + b for p, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            for at, doc, part in zip(starts, batch.column(2).to_pylist(), _ids(batch, 3, 4), strict=True):
                if parts and (size + len(part) > fmt.block_ids or at != start + size):
                    done.append(block(start, docs, parts, codes, sizes))
                    docs, parts = [], []
                if not parts:
                    start, size = at, 0
                docs.append(doc)
                parts.append(part)
                size += len(part)
            if done:
                yield _rows(done)
                done = []
        if parts:
            yield _rows([block(start, docs, parts, codes, sizes)])

    return map_batches(ids.select("part", "begin", "doc_id", "ids", "wide"), run, BLOCKS)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), *[pa.list_(pa.int64())] * 3, pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=BLOCKS.names)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, doc_id: str = "doc_id", text: str = "text", fmt: TokenFormat = TokenFormat()) -> None:
    """Write the files. The driver gets one count per id of the vocabulary and one total per part."""
    rows = pick(docs, doc_id, text).toDF("doc_id", "text")
    ids = settle(ordered_ids(rows.withColumn("doc_id", F.col("doc_id").cast("long")), tokenizer, fmt))
    counts = np.array([(r.id, r.n) for r in id_counts(ids).collect()], np.int64).reshape(-1, 2)
    book = Codebook.from_counts(counts[:, 0], counts[:, 1], fmt.max_code_bits)
    before, total = {}, 0
    for r in sorted(ids.groupBy("part").agg(F.sum("n").alias("n")).collect()):
        before[r.part], total = total, total + r.n
    spark = docs.sparkSession
    book_rows = list(zip(book.ids.tolist(), book.lengths.tolist(), strict=True))
    spark.createDataFrame(book_rows, "id long, length long").coalesce(1).write.parquet(f"{path}/codebook")
    blocks(ids, book, before, fmt).write.option("compression", "uncompressed").parquet(f"{path}/blocks")


def read_token_files(spark: SparkSession, path: str, fmt: TokenFormat = TokenFormat(), digest: bool = False) -> DataFrame:
    """Decode the files: doc_id, start, n_tokens and ids (little-endian unsigned 32-bit), or ids_crc32 if ``digest``."""
    found = sorted(spark.read.parquet(f"{path}/codebook").collect())
    book = Codebook(np.array([r.id for r in found], np.int64), np.array([r.length for r in found], np.int64))
    last = ("ids_crc32", pa.int64(), "long") if digest else ("ids", pa.binary(), "binary")

    def decoded(rows: list[tuple], tables: tuple) -> pa.RecordBatch:
        """All documents of some blocks: every checkpoint is a place to read from."""
        data = np.concatenate([np.frombuffer(r[4], np.uint8) for r in rows])
        base, offsets, counts = 0, [], []
        for _, _, lengths, points, bits in rows:
            n, k = sum(lengths), len(points)
            offsets.append(np.array(points, np.int64) + 8 * base)
            counts.append(np.minimum(fmt.checkpoint_ids, n - fmt.checkpoint_ids * np.arange(k)))
            base += len(bits)
        ids = np.concatenate(unpack(data, np.concatenate(offsets), np.concatenate(counts), *tables, book.width))
        lengths = np.concatenate([r[2] for r in rows]).astype(np.int64)
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        starts = np.concatenate([r[0] + np.cumsum([0, *r[2][:-1]]) for r in rows])
        raw = [ids[a:b].astype("<u4").tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        tail = pa.array([zlib.crc32(x) for x in raw] if digest else raw, last[1])
        return pa.RecordBatch.from_arrays([pa.array([d for r in rows for d in r[1]], pa.int64()), pa.array(starts), pa.array(lengths), tail], names=["doc_id", "start", "n_tokens", last[0]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, rows, n = book.decoder(), [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                n += sum(row[2])
                if n >= DECODED_IDS:
                    yield decoded(rows, tables)
                    rows, n = [], 0
        if rows:
            yield decoded(rows, tables)

    stored = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return map_batches(stored, run, f"doc_id long, start long, n_tokens long, {last[0]} {last[2]}")


def token_file_report(docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", fmt: TokenFormat = TokenFormat()) -> DataFrame:
    """Write the files to the shared folder, read them back: doc_id, start, n_tokens, ids_crc32 per document."""
    path = new_folder(docs.sparkSession)
    write_token_files(docs, path, tokenizer, doc_id, text, fmt)
    return read_token_files(docs.sparkSession, path, fmt, digest=True)
