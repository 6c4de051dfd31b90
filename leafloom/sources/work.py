"""Tables that are written once and read more often, in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where no one has set it, a folder of this machine is taken in
    local mode; elsewhere that is an error."""
    context = spark.sparkContext
    held = context._jsc.sc().getCheckpointDir()
    set_by = spark.conf.get("spark.checkpoint.dir", None)
    if held.isEmpty():
        if not set_by and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        context.setCheckpointDir(set_by or tempfile.mkdtemp(prefix="leafloom-"))
        held = context._jsc.sc().getCheckpointDir()
    return set_by or held.get()


def hold(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read from there, as it is dealt to partitions."""
    shared_dir(df.sparkSession)
    return df.checkpoint()
