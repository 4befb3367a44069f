"""What the operators of this folder share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

BATCH_ROWS, BATCH_BYTES = 256, 1 << 23


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all machines see.

    Only a local session without that setting gets a temporary folder.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        base = tempfile.gettempdir() + "/plumbline-shared"
    return f"{base.rstrip('/')}/plumbline-{uuid.uuid4().hex}"


def written(df: DataFrame, folder: str | None = None, codec: str = "snappy") -> DataFrame:
    """df written as Parquet to a shared folder and read again: its lineage is cut."""
    spark = df.sparkSession
    folder = folder or shared_dir(spark)
    df.write.mode("overwrite").option("compression", codec).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batched(it: Iterable[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded length, so that long texts don't pile up."""
    for batch in it:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def batched_texts(it: Iterable[pa.RecordBatch], name: str = "text", rows: int = BATCH_ROWS, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of bounded length and of bounded bytes of text, or of one row."""
    for batch in it:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(name)), 0).to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            most = (ends[start - 1] if start else 0) + size
            stop = min(start + rows, max(start + 1, int(np.searchsorted(ends, most, side="right"))))
            yield batch.slice(start, stop - start)
            start = stop


def map_texts(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str) -> DataFrame:
    """Maps Arrow batches to columns; make() builds the worker's own state once a task."""
    names = [field.split()[0] for field in schema.split(", ")]

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batched(it):
            out = work(batch)
            yield pa.RecordBatch.from_arrays([out[n] if isinstance(out[n], pa.Array) else pa.array(out[n], ARROW[t]) for n, t in zip(names, types, strict=True)], names)

    types = [field.split(None, 1)[1] for field in schema.split(", ")]
    return df.mapInArrow(run, schema)


def add_columns(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], new: dict[str, str]) -> tuple[DataFrame, list[str]]:
    """df with further columns made from its Arrow batches, and the names they got.

    Rows stay where they are: nothing is shuffled or joined. A name that df has
    already gets underscores in front.
    """
    names = []
    for name in new:
        while name in df.columns:
            name = "_" + name
        names.append(name)
    schema = StructType(list(df.schema.fields))
    for name, kind in zip(names, new.values(), strict=True):
        schema = schema.add(name, DataType.fromDDL("bigint" if kind == "long" else kind))

    def run(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batched(it):
            out = work(batch)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(out[n], ARROW[t]) for n, t in new.items())], [*batch.schema.names, *names])

    return df.mapInArrow(run, schema), names


ARROW = {
    "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary(),
    "boolean": pa.bool_(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<string>": pa.list_(pa.string()),
    "array<double>": pa.list_(pa.float64()), "array<float>": pa.list_(pa.float32()),
}


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The texts, null as the empty text."""
    return [t or "" for t in batch.column(name).to_pylist()]


def named(df: DataFrame, **columns: str) -> DataFrame:
    """Only the given columns, under the operator's own names; others can't clash with them."""
    return df.select(*(F.col(f"`{c}`").alias(n) for n, c in columns.items()))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores in front until no column of df has them, whatever the case of letters."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


def lower_ascii(text: str) -> bytes:
    """UTF-8 bytes with A-Z in lower case and nothing else changed."""
    return text.encode("utf-8", "surrogatepass").lower()
