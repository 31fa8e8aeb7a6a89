"""Session, table access and the few physical helpers all operators share."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest number of rows that may be collected to the driver as a lookup (configuration tables only).
MAX_LOOKUP_ROWS = 10_000


def get_spark(app: str = "legajo", cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators are tested with; on a cluster pass your own session instead."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint in the folder of ``spark.checkpoint.dir``.

    Only where that setting is absent (local tests) a folder of this machine is used.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local["):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            folder = os.path.join(tempfile.gettempdir(), "legajo-checkpoints")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def small_lookup(df: DataFrame, limit: int = MAX_LOOKUP_ROWS) -> list:
    """Collect a configuration table; a table above ``limit`` rows is refused instead of being cut."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a lookup of more than {limit} rows must be joined, not collected")
    return rows


def salt_of(*keys: str | Column, salts: int) -> Column:
    """A salt from 0 to ``salts`` - 1 that depends on ``keys`` only, so that a retried task gives the same rows."""
    return F.pmod(F.xxhash64(*keys), F.lit(salts)).cast("int")


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, naming the columns that are absent."""
    absent = [c for c in columns if c not in df.columns]
    if absent:
        raise ValueError(f"missing columns: {', '.join(absent)}")
