"""Parquet tables of one data folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table as a lazy scan; projections and filters reach it through Catalyst."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
