"""Inputs of the registered queries, derived from the test tables of one scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import sqlfeatures
from ..sources import fixtures


def datapoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.datapoints(spark, sf_dir)


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queries frame (Q31) of the stand-in corpus."""
    return sqlfeatures.feature_rows(datapoints(spark, sf_dir))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.predictions(spark, sf_dir)
