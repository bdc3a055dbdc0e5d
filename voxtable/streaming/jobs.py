"""Incremental arrival and scoring of arriving rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from voxtable.operators.models import score_table
from voxtable.session import path_exists

BUCKET, BUCKETS = "key_bucket", 64      # partition column of an ingested table, and how many values it has


def ingest_stream(spark: SparkSession, src: str, dst: str, key: str, checkpoint: str,
                  schema: StructType | str, files: str | None = None, max_files: int | None = None,
                  buckets: int = BUCKETS) -> StreamingQuery:
    """Append rows whose key is not in ``dst`` yet, over the files that have arrived.

    ``dst`` is partitioned by a hash of the key, and what is stored there is the state: a batch drops its own repeats, then
    anti-joins the keys (one narrow column) of the buckets its rows fall in, and of no others.  No mark of a finished write is
    looked at, so a batch that is run again, after a commit that broke off too, adds what is missing and nothing twice.
    A null key counts as a key.  ``files`` is a name pattern inside ``src``; ``buckets`` is fixed by the first batch.
    """
    reader = spark.readStream.schema(schema)
    if files:
        reader = reader.option("pathGlobFilter", files)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)

    def add(batch: DataFrame, _: int) -> None:
        session = batch.sparkSession
        new = batch.dropDuplicates([key]).withColumn(BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        if path_exists(session, dst):
            touched = [r[0] for r in new.select(BUCKET).distinct().collect()]       # at most ``buckets`` numbers
            have = stored_keys(session, dst, new.schema, key, touched).withColumnsRenamed({key: "_key", BUCKET: "_in"})
            new = new.join(have, new[key].eqNullSafe(have["_key"]) & (new[BUCKET] == have["_in"]), "left_anti")
        new.repartition(BUCKET).write.mode("append").partitionBy(BUCKET).parquet(dst)
    return (reader.parquet(src).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())


def stored_keys(spark: SparkSession, dst: str, schema: StructType, key: str, buckets: Sequence[int]) -> DataFrame:
    """Keys stored in some buckets of an ingested table; other buckets are not listed for reading."""
    return spark.read.schema(schema).parquet(dst).where(F.col(BUCKET).isin(list(buckets))).select(key, BUCKET)


def read_ingested(spark: SparkSession, dst: str) -> DataFrame:
    return spark.read.parquet(dst).drop(BUCKET)


def score_stream(stream: DataFrame, model_dir: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Arriving rows with the stored model's prediction."""
    return score_table(stream, model_dir, keep)


def write_stream(stream: DataFrame, dst: str, checkpoint: str) -> StreamingQuery:
    """Parquet sink with exactly-once files, over what has arrived."""
    return (stream.writeStream.format("parquet").option("path", dst)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
