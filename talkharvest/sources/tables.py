"""Table access: every query reads ``{dir}/{name}.parquet`` and prunes columns at the scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unique(df: DataFrame, key: str) -> DataFrame:
    """Deliveries repeat rows as exact copies: one row per key. Rows without a key are no records and are left out."""
    return df.where(df[key].isNotNull()).dropDuplicates([key])
