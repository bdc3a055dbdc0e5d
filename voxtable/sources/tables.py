"""Delimited and JSON tables."""

from __future__ import annotations

import csv
import os
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType


def trim_header(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.strip() for c in df.columns])


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """CSV with a header; types come from ``schema``, or are inferred with one more scan."""
    r = spark.read.option("header", True)
    df = r.schema(schema).csv(path) if schema is not None else r.option("inferSchema", True).csv(path)
    return trim_header(df)


def _files(spark: SparkSession, path: str) -> list[str]:
    """The data files at a path or pattern, without hidden ones, in order of their names."""
    hadoop = spark._jvm.org.apache.hadoop.fs
    top = hadoop.Path(path)
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    todo, found = list(fs.globStatus(top) or ()), []
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        status = todo.pop()
        if status.isDirectory():
            todo += [x for x in fs.listStatus(status.getPath()) if x.getPath().getName()[0] not in "_."]
        else:
            found.append(status.getPath().toString())
    return sorted(found)


def _header(spark: SparkSession, file: str) -> tuple[str, ...]:
    """Column names in the first line of a file, compressed or not; nothing else of it is read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(file)
    conf = spark._jsc.hadoopConfiguration()
    stream = path.getFileSystem(conf).open(path)
    try:
        codec = spark._jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf).getCodec(path)
        lines = spark._jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8")
        line = spark._jvm.java.io.BufferedReader(lines).readLine()
    finally:
        stream.close()
    return tuple(c.strip() for c in next(csv.reader([(line or "").removeprefix("\ufeff")]), []))


def read_tables(spark: SparkSession, paths: str | os.PathLike | Sequence[str],
                schema: StructType | str | None = None) -> DataFrame:
    """One path or many with the same columns, matched by name rather than by position.

    Only the first line of each file is looked at; files with one header are one scan, and one more if types are to be
    inferred, however many they are.  With ``schema`` its columns come out, null where a file lacks one; files without any
    line are left out.
    """
    many = [paths] if isinstance(paths, (str, os.PathLike)) else list(paths)
    wanted = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    groups: dict[tuple[str, ...], list[str]] = {}
    for path in many:
        for file in _files(spark, str(path)):
            groups.setdefault(_header(spark, file), []).append(file)
    groups.pop((), None)
    if not groups:
        return spark.createDataFrame([], wanted or StructType())
    parts = []
    for header, files in groups.items():
        if wanted is None:
            parts.append(trim_header(spark.read.option("header", True).option("inferSchema", True).csv(files)))
            continue
        kinds = {f.name: f.dataType for f in wanted.fields}
        own = StructType([StructField(c, kinds.get(c, StringType())) for c in header])
        part = spark.read.option("header", True).option("enforceSchema", True).schema(own).csv(files)
        parts.append(part.select(*[F.col(f"`{c}`") if c in header else F.lit(None).cast(kinds[c]).alias(c) for c in kinds]))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", single_file: bool = False) -> None:
    """CSV with header.  ``single_file`` is for report-sized tables."""
    (df.coalesce(1) if single_file else df).write.mode(mode).option("header", True).csv(path)


def write_report(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row JSON report."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).coalesce(1) \
        .write.mode(mode).text(path)


def read_report(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_once(df: DataFrame, path: str, force: bool = False) -> bool:
    """Parquet write that keeps finished output unless ``force``; true when it wrote."""
    from voxtable.session import path_exists
    spark = df.sparkSession
    if not force and path_exists(spark, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True
