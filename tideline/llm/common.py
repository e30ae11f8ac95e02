"""Shared helpers: input loading, durable intermediate tables, text batching."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def bounded(spark: SparkSession) -> None:
    """Arrow batches of bounded size to Python, unless the session has sizes of its own: texts can be very long."""
    for key, given, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "1024"), ("spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", str(4 << 20))):
        if spark.conf.get(key, given) == given:
            spark.conf.set(key, value)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; a local one only if it is unset on one machine (tests)."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        path = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and rereads it, so that a lost executor costs no recomputation."""
    spark = df.sparkSession
    bounded(spark)
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def held_out(doc_id: Column) -> Column:
    """One fifth of all documents, never learnt from; a null doc_id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """Names for columns of passage that ``docs`` does not have."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        k = f"_{name}"
        while k.lower() in taken:
            k = "_" + k
        out.append(k)
    return out


def slices(texts: list[str], size: int) -> Iterator[tuple[int, int]]:
    """Runs ``[i, j)`` of texts that hold about ``size`` characters together, one text at least."""
    i = total = 0
    for j, t in enumerate(texts):
        if total and total + len(t) > size:
            yield i, j
            i, total = j, 0
        total += len(t)
    if i < len(texts):
        yield i, len(texts)


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], name: str, size: int = 12 << 20) -> Iterator[pa.RecordBatch]:
    """Batches joined until a column of theirs has about ``size`` bytes: fewer passes over what a task looks up."""
    held: list[pa.RecordBatch] = []
    total = 0
    for b in batches:
        held.append(b)
        total += b.column(b.schema.get_field_index(name)).nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def let_go() -> None:
    """Gives memory that is free in this process back to the system: Python workers live on from stage to stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` in a worker that starts and leaves without memory it does not use."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        try:
            yield from run(batches)
        finally:
            let_go()

    return lean
