"""Files as rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from voxtable.functions.text import parse_histology_name
from voxtable.session import path_exists

# Image extensions, matched with their case.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg")


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, length)`` of every file below ``path``; contents are not read."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .select("path", "length"))


def storage_footprint(spark: SparkSession, path: str) -> DataFrame:
    """One row: bytes and files below ``path``; a missing path counts as empty."""
    if not path_exists(spark, path):
        return spark.range(1).select(F.lit(0).cast("long").alias("bytes"), F.lit(0).cast("long").alias("files"))
    return file_sizes(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
                                       F.count(F.lit(1)).alias("files"))


def storage_bytes(spark: SparkSession, path: str) -> int:
    return storage_footprint(spark, path).first()["bytes"]


def read_images(spark: SparkSession, path: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """``image_path, width, height`` of decodable images below ``path``."""
    img = (spark.read.format("image").option("dropInvalid", True).option("recursiveFileLookup", True)
           .option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(path))
    return img.select(F.col("image.origin").alias("image_path"), F.col("image.width").alias("width"),
                      F.col("image.height").alias("height"))


def image_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Histology images with the fields of their name; unparsable names are dropped."""
    img = read_images(spark, path)
    parsed = img.withColumn("_p", parse_histology_name(F.regexp_extract("image_path", r"([^/]+)$", 1)))
    return parsed.where(F.col("_p").isNotNull()).select("image_path", "_p.*", "width", "height")
