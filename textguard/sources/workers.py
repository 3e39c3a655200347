"""Python workers find this package where the driver found it; on a cluster, ship it with --py-files."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = str(Path(__file__).resolve().parents[2])


def ship(spark: SparkSession) -> None:
    """Put the package's folder on the workers' path."""
    environment = spark.sparkContext.environment
    paths = [x for x in environment.get("PYTHONPATH", "").split(":") if x]
    if _ROOT not in paths:
        environment["PYTHONPATH"] = ":".join([*paths, _ROOT])
