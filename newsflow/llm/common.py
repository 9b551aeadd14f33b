"""Shared pieces of this subpackage: query registry, session settings, small helpers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsflow.session import stage

__all__ = ["QUERIES", "query", "table", "prepare", "stage", "without", "bytes_of", "letters_down", "held_out", "DOCUMENT"]

Build = Callable[[SparkSession, str], DataFrame]

#: name -> (build, SQL or None)
QUERIES: dict[str, tuple[Build, str | None]] = {}

DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

#: White space of the word rule ``[^\x20\x09-\x0D]+``; the same bytes that ``bytes.split()`` splits on.
SPACE = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Arrow batches hold whole texts, so they are kept short: rows and bytes that one batch may take.
BATCH_ROWS = 512
BATCH_BYTES = 16 << 20


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def register(build: Build) -> Build:
        QUERIES[name] = (build, sql)
        return build

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Settings that the operators with Python tasks rely on."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def without(df: DataFrame, *names: str) -> list[str]:
    """Columns of ``df`` but those called like a result column, in any case of letters."""
    taken = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in taken]


def schema_with(df: DataFrame, columns: list[str], *fields: T.StructField) -> T.StructType:
    return T.StructType([df.schema[c] for c in columns] + list(fields))


def letters_down(text: Column) -> Column:
    """A-Z to lower case; all other letters stay."""
    return F.translate(text, UPPER, UPPER.lower())


def held_out(doc_id: Column, modulus: int, value: int = 2) -> Column:
    """Whether crc32(doc_id as text) leaves ``value``; a null id counts as not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == value, F.lit(False))


def bytes_of(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def rows_to_batch(batch: pa.RecordBatch, columns: list[str], extra: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [*columns, *extra]
    arrays = [batch.column(batch.schema.get_field_index(c)) for c in columns] + list(extra.values())
    return pa.RecordBatch.from_arrays(arrays, names=names)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


Batches = Iterator[pa.RecordBatch]
