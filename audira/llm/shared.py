"""Helpers of the operators: columns by position, tables written to the shared folder, row batches of bounded size."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

import audira
from audira.session import ensure_checkpoint_dir

#: Texts of about so many bytes are worked on at once; a longer text is worked on alone.
GROUP_BYTES = 1 << 18
#: Rows of about so many bytes go to a Python worker at once (a longer row alone). A worker and its executor hold a few such
#: batches each, whatever the size of the table.
BATCH_BYTES = 1 << 21


def position(df: DataFrame, name: str) -> int:
    """Place of a column: the exact name first, else the only one that differs in case."""
    if name in df.columns:
        return df.columns.index(name)
    alike = [i for i, c in enumerate(df.columns) if c.lower() == name.lower()]
    if not alike:
        raise ValueError(f"no column {name!r} in {df.columns}")
    return alike[0]


def numbered(df: DataFrame) -> DataFrame:
    """The same rows with columns c0, c1, ..., so that no name can clash with one that an operator adds."""
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))])


def pick(df: DataFrame, *names: str) -> DataFrame:
    """These columns only; other columns may have any names, also repeated ones."""
    return numbered(df).select(*[F.col(f"c{position(df, n)}").alias(n) for n in names])


def same(left: Column, right: Column) -> Column:
    """Equality in which null equals null."""
    return left.eqNullSafe(right)


def settle(df: DataFrame, compression: str = "zstd") -> DataFrame:
    """Write the rows as Parquet to the shared folder and read them back.

    Cuts lineage like a checkpoint. Unlike after a checkpoint, Spark knows the size of the table, so it decides by bytes
    whether a join broadcasts it.
    """
    path = new_folder(df.sparkSession)
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/audira-llm/{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    """mapInArrow. A local session gets this package for its Python workers; on a cluster it is installed like any other.

    The session's limit on the bytes of a batch is lowered to BATCH_BYTES: the default holds 64 MB of whole texts, several
    times over, in every worker and in its executor.
    """
    conf, limit = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(limit)
    if not now.rstrip("bB").isdigit() or int(now.rstrip("bB")) > BATCH_BYTES:
        conf.set(limit, str(BATCH_BYTES))
    sc, home = df.sparkSession.sparkContext, os.path.dirname(audira.__file__)
    if re.fullmatch(r"local(\[[^,]*\])?", sc.master) and not any(f.rstrip("/").endswith(home) for f in sc.listFiles):
        sc.addFile(home, recursive=True)
    return df.mapInArrow(run, schema)


def extended(df: DataFrame, **columns: T.DataType) -> T.StructType:
    """The schema with more columns."""
    return T.StructType([*df.schema.fields, *[T.StructField(k, v) for k, v in columns.items()]])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow text column and the n + 1 bounds of its rows; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def utf8(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same texts as valid UTF-8: bytes that are none become replacement characters, row by row."""
    try:
        data.tobytes().decode("utf-8")
        inside = bounds[:-1][bounds[:-1] < len(data)]
        if not ((data[inside] & 0xC0) == 0x80).any():  # else a character is split between two rows
            return data, bounds
    except UnicodeDecodeError:
        pass
    fixed = [data[a:b].tobytes().decode("utf-8", "replace").encode() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    return np.frombuffer(b"".join(fixed), np.uint8), np.cumsum([0, *map(len, fixed)])


def groups(bounds: np.ndarray, size: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about ``size`` bytes each."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + size, "right")) - 1)
        yield first, last
        first = last


def text_groups(column: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row + 1, bytes, bounds) of each group of rows."""
    raw, bounds = text_bytes(column)
    for first, last in groups(bounds, size):
        yield first, last, raw[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
