"""Readers with fixed schemas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUESTS = "request_id bigint, text string, source_lang string, target_lang string"
IMAGE_NAMES = r"\.(png|jpe?g|bmp|webp)$"


def read_requests(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """Translation requests from parquet, json or csv (csv with a header)."""
    if fmt == "csv":
        options = {"header": True, "multiLine": True, "escape": '"'} | options
    return spark.read.schema(REQUESTS).options(**options).format(fmt).load(path)


def is_image(path):
    return F.rlike(F.lower(path), F.lit(IMAGE_NAMES))


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length, content of the image files below a folder."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).where(is_image(F.col("path")))
