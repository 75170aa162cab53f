"""Captured pages: which fetches count, and how a rendered page stands in for a plain one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bookflow.schemas import PAGE

#: A plain page counts from so many characters on.
LEAST_CHARS = 500


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return spark.read.schema(PAGE).format(fmt).load(path)


def accepted(pages: DataFrame) -> DataFrame:
    """Fetches with status 200 and enough text."""
    return pages.where((F.col("status") == 200) & (F.length("html") > LEAST_CHARS))


def with_fallback(pages: DataFrame) -> DataFrame:
    """One row per page: the accepted plain fetch, else the rendered one."""
    plain = accepted(pages.where("not rendered")).groupBy("page_id").agg(F.first("html").alias("plain"))
    rendered = pages.where("rendered and status = 200").groupBy("page_id").agg(F.first("html").alias("rendered_html"))
    return plain.join(rendered, "page_id", "full_outer").select("page_id", F.coalesce("plain", "rendered_html").alias("html"), F.col("plain").isNull().alias("rendered"))


def checked(pages: DataFrame, expected: str, actual: str) -> DataFrame:
    """Adds whether a page is the one that was asked for; unknown ids pass."""
    return pages.withColumn("right_page", F.col(expected).isNull() | F.col(actual).isNull() | (F.col(expected) == F.col(actual)))
