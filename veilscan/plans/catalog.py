"""All registered queries with their SQL."""

from pyspark.sql import DataFrame, SparkSession

from . import discovery, findings, identity, monitoring, pii, recorded, web  # noqa: F401  (they register)
from .registry import QUERIES, SQL


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_exposure_by_source(spark, sf_dir)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
