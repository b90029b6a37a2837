"""What a session needs before kernels of this package run on its executors."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent.parent)


def with_code(spark: SparkSession) -> SparkSession:
    """``spark``, whose Python workers also look for this package where the driver has it.

    On a cluster whose machines do not share that folder, ship the package with ``--py-files``.
    """
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, paths)])
    return spark
