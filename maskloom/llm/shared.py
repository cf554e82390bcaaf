"""What several operators share: intermediate tables, batch sizes and let-bindings."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that ends a word in all contracts here, as the inside of a regular expression's class.
SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that a Python task works on at a time, unless one text has more.
PART_BYTES = 4 << 20
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset a local master (tests) gets a
    folder of its own; on a cluster that would lose rows, so it is an error there."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="maskloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/maskloom-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it again: lineage ends there, and a lost executor costs nothing."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.maskloom_path = path
    if (made := _made.get()) is not None:
        made.append(table)
    return table


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """Collects the tables that cut() writes inside, for a caller that deletes them once nothing reads them."""
    token = _made.set(found := [])
    try:
        yield found
    finally:
        _made.reset(token)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables of cut() that nothing reads any more, and lets Spark drop the shuffle files of finished jobs."""
    jvm = spark._jvm
    for t in tables:
        path = jvm.org.apache.hadoop.fs.Path(t.maskloom_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    gc.collect()
    jvm.System.gc()  # Spark removes a shuffle's files once the driver's garbage collector has found the plan unused


def read_by(df: DataFrame, tables: list[DataFrame]) -> list[DataFrame]:
    """Those of the tables of cut() that the plan of df reads, by the folders of its relations."""
    leaves, found = df._jdf.queryExecution().analyzed().collectLeaves(), []
    for i in range(leaves.size()):
        if leaves.apply(i).getClass().getSimpleName() == "LogicalRelation" and "HadoopFs" in (relation := leaves.apply(i).relation()).getClass().getSimpleName():
            roots = relation.location().rootPaths()
            found += [roots.apply(k).getName() for k in range(roots.size())]
    return [t for t in tables if t.maskloom_path.rsplit("/", 1)[1] in found]


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of a thousand rows unless the session asks for another size, so that long texts don't add up."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


def parts(batches: Iterator[pa.RecordBatch], text: int, most: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to so many bytes in the column of that number: Spark counts in rows, and what is made of texts is larger."""
    for b in batches:
        sizes = pa.compute.binary_length(b.column(text)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        number = (np.cumsum(sizes) - sizes) // most
        heads = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(sizes) else np.zeros(1, np.int64)
        for i, j in zip(heads.tolist(), [*heads[1:].tolist(), len(sizes)]):
            yield b.slice(i, j - i)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once a row however often body or a lambda in it refers to it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A to Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
