"""Words, row splits and Arrow batches that the text operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BATCH_BYTES = 8 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def remainder(modulus: int, key: str = "doc_id") -> Column:
    """CRC-32 of the key as text, modulo ``modulus``; null for a null key."""
    return F.crc32(F.col(key).cast("string")) % modulus


def is_held_out(modulus: int, value: int) -> Column:
    """A row without a key is never held out (and never learned from)."""
    return F.coalesce(remainder(modulus) == value, F.lit(False))


def is_learned(modulus: int, value: int) -> Column:
    return F.coalesce(remainder(modulus) != value, F.lit(False))


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def words(text: bytes | None) -> list[bytes]:
    """Runs of anything but the six ASCII white-space characters, which is what ``bytes.split`` cuts at."""
    return text.split() if text else []


def small_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes each; a longer row is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        step = max(1, batch.num_rows * limit // max(batch.nbytes, 1))
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def hidden(df: DataFrame, used: tuple[str, ...]) -> tuple[DataFrame, list[Column]]:
    """``df`` with every column but ``used`` under a name that no operator has, and the columns that bring it back."""
    names = [c if c in used else f"in{i}" for i, c in enumerate(df.columns)]
    return df.toDF(*names), [F.col(name).alias(c) for name, c in zip(names, df.columns)]


def map_rows(df: DataFrame, of_batch: Callable[[pa.RecordBatch], list], added: str) -> DataFrame:
    """Append the columns of the DDL ``added``, whose values ``of_batch`` gives as one list or array per column.

    Columns of ``df`` must not carry the added names.
    """
    extra = StructType.fromDDL(added)
    schema = StructType([*df.schema.fields, *extra.fields])
    types = [_arrow_type(field.dataType.simpleString()) for field in extra]
    names = extra.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            new = [pa.array(values, type=t) for values, t in zip(of_batch(batch), types, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema)


_ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(),
}


def _arrow_type(name: str) -> pa.DataType:
    if name.startswith("array<"):
        return pa.list_(_arrow_type(name[6:-1]))
    return _ARROW[name]


def filter_rows(df: DataFrame, keep: Callable[[pa.RecordBatch], list[bool]]) -> DataFrame:
    """The rows for which ``keep`` says so, with all columns as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            yield batch.filter(pa.array(keep(batch), type=pa.bool_()))

    return df.mapInArrow(run, df.schema)
