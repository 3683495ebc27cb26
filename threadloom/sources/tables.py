"""Readers for the Parquet tables of a store or corpus folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
