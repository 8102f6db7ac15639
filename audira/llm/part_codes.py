"""Vector codes by parts (product quantisation) with exact integers and Orchard's nearest-entry search.

A component x becomes the integer floor(256 x). Vectors are cut into equal consecutive parts; each part position has a
codebook of ``entries`` entries. A codebook starts as that part of the rows with the smallest ids; each round assigns all
parts to their nearest entries and replaces an entry by the floor of its parts' mean. Everything is whole-number
arithmetic, so the result does not depend on how rows are dealt out.

Nearest entries: every entry has a list of all entries by distance from it. A part starts at one entry and walks along that
entry's list; an entry that is nearer (or as near and of lower index) becomes the current one, and its list is walked from
the start. Entries that were looked at are marked and not looked at again. The walk ends where the list is further than
twice the current distance away: by the triangle inequality, nothing behind that is as near.

Only the codebooks (entries x dimensions numbers) reach the driver; tasks send sums by entry, combined before the shuffle.

Rows whose vector is null or has a null or non-finite component are dropped, and so are vectors whose length is not the one
that most kept vectors have (ties: the longer), or no positive multiple of the number of parts. Repeated rows and ids are
rows like others; rows with one id are ordered by their vector; null ids come last. With fewer rows than entries the
codebooks are as small as that. Empty tables give an empty result. Null labels form one group. Components must be smaller
than 2^20 in size (else an error), so that squared distances stay within 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from audira.llm.shared import map_batches, pick, same, settle

#: Vectors that are looked up together.
CHUNK = 2048
LIMIT = 1 << 28


@dataclass(frozen=True)
class PartCodes:
    parts: int = 16
    entries: int = 64
    rounds: int = 2
    scale: int = 256


def integer_vectors(column: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(kept rows, their lengths, all components of the kept rows) of an Arrow list column."""
    values, n = column.flatten(), len(column)  # flatten() leaves out the lists of null rows
    lengths = np.asarray(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # nulls become NaN
    bounds = np.concatenate([[0], np.cumsum(lengths)])
    n_bad = np.concatenate([[0], np.cumsum(~np.isfinite(x))])
    keep = np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool) & (n_bad[bounds[1:]] == n_bad[bounds[:-1]])
    whole = np.floor(scale * x[np.repeat(keep, lengths)])
    if (np.abs(whole) >= LIMIT).any():
        raise ValueError(f"a vector has a component of size {LIMIT // scale} or more")
    rows = np.arange(n)[keep]
    return rows, lengths[keep], whole.astype("<i4")


def kept_vectors(rows: DataFrame, scale: int) -> DataFrame:
    """(vec_id, label, size, v) from (vec_id, embedding, label); v: the integers as little-endian 32-bit numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, lengths, whole = integer_vectors(batch.column(1), scale)
            offsets = np.concatenate([[0], np.cumsum(lengths)]) * 4
            v = pa.Array.from_buffers(pa.binary(), len(kept), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(whole)])
            take = pa.array(kept)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(2).take(take), pa.array(lengths.astype(np.int32)), v], names=["vec_id", "label", "size", "v"])

    kinds = dict(rows.dtypes)
    return map_batches(rows, run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, size int, v binary")


@dataclass(frozen=True)
class Neighbours:
    """One part position's entries, and for each entry all entries by distance (ties by index) with their distances."""

    entries: np.ndarray
    order: np.ndarray
    distance: np.ndarray

    @staticmethod
    def of(entries: np.ndarray) -> Neighbours:
        d = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        order = np.argsort(d, axis=1, kind="stable")
        return Neighbours(entries, order, np.take_along_axis(d, order, axis=1))


def orchard(parts: np.ndarray, near: Neighbours) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry (ties to the lower index) of every part, and the squared distance; all parts walk at once."""
    n, k = len(parts), len(near.entries)
    by_first = np.argsort(near.entries[:, 0], kind="stable")  # start where the first component is about right
    current = by_first[np.minimum(np.searchsorted(near.entries[by_first, 0], parts[:, 0]), k - 1)]
    best = ((parts - near.entries[current]) ** 2).sum(axis=1)
    seen = np.zeros((n, k), bool)
    seen[np.arange(n), current] = True
    place, walking = np.zeros(n, np.int64), np.arange(n)
    while True:
        place[walking] += 1
        at = place[walking]
        on = at < k
        walking, at = walking[on], at[on]
        here = current[walking]
        on = near.distance[here, at] <= 4 * best[walking]
        walking, at, here = walking[on], at[on], here[on]
        if not len(walking):
            return current, best
        entry = near.order[here, at]
        new = ~seen[walking, entry]
        asking, entry, here = walking[new], entry[new], here[new]
        seen[asking, entry] = True
        d = ((parts[asking] - near.entries[entry]) ** 2).sum(axis=1)
        nearer = (d < best[asking]) | ((d == best[asking]) & (entry < here))
        moved = asking[nearer]
        current[moved], best[moved], place[moved] = entry[nearer], d[nearer], -1  # from the start of the new list


def coded(vectors: np.ndarray, books: list[Neighbours]) -> tuple[np.ndarray, np.ndarray]:
    """(n, parts) indexes and squared distances of n vectors."""
    width = len(books[0].entries[0])
    found = [orchard(vectors[:, p * width : (p + 1) * width], near) for p, near in enumerate(books)]
    return np.stack([f[0] for f in found], axis=1), np.stack([f[1] for f in found], axis=1)


def _chunks(batches: Iterator[pa.RecordBatch], at: int, dim: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for first in range(0, batch.num_rows, CHUNK):
            part = batch.slice(first, CHUNK)
            raw = b"".join(part.column(at).to_pylist())
            yield part, np.frombuffer(raw, "<i4").astype(np.int64).reshape(-1, dim)


def entry_sums(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(cell, n, total): for every component of every entry that has parts, their number and sum."""
    parts, k, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Neighbours.of(b) for b in books]
        totals, counts = np.zeros((parts * k, width), np.int64), np.zeros(parts * k, np.int64)
        for _, v in _chunks(batches, 0, parts * width):
            codes, _ = coded(v, near)
            cells = (codes + k * np.arange(parts)).ravel()
            np.add.at(totals, cells, v.reshape(-1, width))
            counts += np.bincount(cells, minlength=parts * k)
        used = np.flatnonzero(counts)
        cell = (used[:, None] * width + np.arange(width)).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(np.repeat(counts[used], width)), pa.array(totals[used].ravel())], names=["cell", "n", "total"])

    sums = map_batches(vectors.select("v"), run, "cell long, n long, total long")
    return sums.groupBy("cell").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(vectors: DataFrame, dim: int, plan: PartCodes = PartCodes()) -> np.ndarray:
    """Codebooks (parts, entries, width) of kept vectors of one length."""
    seeds = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(plan.entries).select("v").collect()
    whole = np.frombuffer(b"".join(r.v for r in seeds), "<i4").astype(np.int64)
    books = np.ascontiguousarray(whole.reshape(len(seeds), plan.parts, dim // plan.parts).transpose(1, 0, 2))
    for _ in range(plan.rounds):
        flat = books.ravel().copy()
        for cell, n, total in entry_sums(vectors, books).collect():
            flat[cell] = total // n
        books = flat.reshape(books.shape)
    return books


def codebook_digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def encode(vectors: DataFrame, books: np.ndarray) -> DataFrame:
    """(vec_id, label, code, error): two hex digits per part, squared distances summed over the parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = [Neighbours.of(b) for b in books]
        for part, v in _chunks(batches, 2, books.shape[0] * books.shape[2]):
            codes, errors = coded(v, near)
            text = [r.tobytes().hex() for r in codes.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(errors.sum(axis=1))], names=["vec_id", "label", "code", "error"])

    kinds = dict(vectors.dtypes)
    return map_batches(vectors.select("vec_id", "label", "v"), run, f"vec_id {kinds['vec_id']}, label {kinds['label']}, code string, error long")


def part_codes(embeddings: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", plan: PartCodes = PartCodes()) -> DataFrame:
    """Per kept vector: vec_id, code, error, label_error (errors of equal labels, summed), codebooks_sha256."""
    if not 0 < plan.entries <= 256:
        raise ValueError("two hex digits hold 1 to 256 entries")
    rows = settle(kept_vectors(pick(embeddings, vec_id, embedding, label).toDF("vec_id", "embedding", "label").select("vec_id", "embedding", "label"), plan.scale))
    usual = rows.where((F.col("size") > 0) & (F.col("size") % plan.parts == 0)).groupBy("size").count().orderBy(F.desc("count"), F.desc("size")).first()
    if usual is None:
        return rows.limit(0).selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error", "'' AS codebooks_sha256")
    vectors = rows.where(F.col("size") == usual["size"])
    books = train(vectors, usual["size"], plan)
    codes = settle(encode(vectors, books))
    by_label = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    summed = codes.join(by_label, same(codes["label"], by_label["of"]))
    return summed.select("vec_id", "code", "error", "label_error", F.lit(codebook_digest(books)).alias("codebooks_sha256"))
