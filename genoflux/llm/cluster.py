"""What every operator of this subpackage needs from the cluster: shared scratch tables and shipped code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from genoflux import shipping
from genoflux.scratch import materialise, scratch_dir  # noqa: F401



_BATCH, _DEFAULT, _ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"


def ship(spark: SparkSession) -> None:
    """Send the package to the workers, and have them get whole texts in smaller batches than Spark's default, unless the session says otherwise."""
    shipping.ship(spark)
    if spark.conf.get(_BATCH) == _DEFAULT:
        spark.conf.set(_BATCH, _ROWS)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
