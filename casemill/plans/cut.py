"""Cutting lineage through storage that every executor shares.

The shared folder is the one that ``spark.checkpoint.dir`` names. Only where that
setting is absent (tests, a laptop) a temporary folder is chosen, once a session.
"""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that executors and driver share; without one, only a local session has a folder of its own."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", master := spark.sparkContext.master):
        raise ValueError(f"spark.checkpoint.dir has to name a folder that all machines of {master} share")
    app = spark.sparkContext.applicationId
    if app not in _fallback:
        _fallback[app] = tempfile.mkdtemp(prefix="casemill-")
        spark.sparkContext.setCheckpointDir(_fallback[app])
    return _fallback[app]


def checkpointed(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept in the shared folder; for the rounds of an iteration."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, for results that several plans read.

    Columnar and compressed, so reads prune columns. The table goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/casemill-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stored_path = path
    return table


def dropped(*tables: DataFrame) -> None:
    """Delete stored tables that no plan will read again."""
    for table in tables:
        _remove(table.sparkSession, table._stored_path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may have ended before the interpreter does
        pass
