"""What the operators share: reading tables, work tables in shared storage, columns that cannot clash."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from contextlib import suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The Parquet table `name`, with `columns` only if any are given."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where no one has set it, a folder of this machine is taken
    in local mode, where there is one machine; elsewhere that is an error."""
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    set_by = spark.conf.get("spark.checkpoint.dir", None)
    if held.isEmpty():
        if not set_by and not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(set_by or tempfile.mkdtemp(prefix="leafloom-"))
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_by or held.get()


def cut(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there: its lineage ends, and lost executors cost nothing but a read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Deletes a work table. Nothing that is still to be computed may read it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def free_names(df: DataFrame, *names: str) -> list[str]:
    """Column names like `names` that `df` does not have, in any case of letters."""
    held = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in held:
            n = f"{n}_"
        held.add(n.lower())
        out.append(n)
    return out


def text_of(column: str | Column = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def bounded_parts(df: DataFrame, size: Column, target_bytes: int) -> tuple[int, int]:
    """Sum of `size` over all rows, and the number of parts of `target_bytes` that it fills (1 at least)."""
    total = df.agg(F.sum(size.cast("long"))).first()[0] or 0
    return total, max(1, -(-total // target_bytes))


def give_back() -> None:
    """Returns what a Python worker has freed to the system: workers outlive their tasks, and other stages need the room."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)
