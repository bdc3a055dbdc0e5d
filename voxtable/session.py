"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Rows may hold whole slices (1 MB at 512 x 512), so Arrow batches are kept short.
ARROW_ROWS = "64"

_SCOPES: list[list[str]] = []         # paths written inside open ``scratch_scope`` blocks
_LOCAL_ROOTS: dict[str, str] = {}     # only for local sessions without a shared folder


def build_session(master: str | None = None, name: str = "voxtable",
                  partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; cluster settings are left to the submitter."""
    b = (SparkSession.builder.appName(name)
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS))
    if master:
        b = b.master(master)
    if partitions:
        b = b.config("spark.sql.shuffle.partitions", str(partitions))
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder shared by the cluster")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        _LOCAL_ROOTS[app] = tempfile.mkdtemp(prefix="voxtable-")
    return _LOCAL_ROOTS[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unused path below the shared folder."""
    return f"{shared_root(spark)}/voxtable/{name}-{uuid.uuid4().hex}"


def path_exists(spark: SparkSession, path: str) -> bool:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    return bool(fs.exists(jpath))


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a path with all below it; nothing happens if it is not there."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def move_path(spark: SparkSession, src: str, dst: str) -> None:
    """Give a finished folder its final name."""
    source, target = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (src, dst))
    if not source.getFileSystem(spark._jsc.hadoopConfiguration()).rename(source, target):
        raise OSError(f"{src} could not become {dst}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the shared folder and read back.

    For a table that several later passes read: they scan the columns they need instead of
    repeating its joins, and a lost executor costs a re-read and not a recomputation.
    """
    path = scratch_path(df.sparkSession, name)
    for made in _SCOPES[-1:]:
        made.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes at its end what :func:`stored` wrote inside, also after a failure.

    For runs that end with written results; plans that still read a stored table must be run inside.
    """
    made: list[str] = []
    _SCOPES.append(made)
    try:
        yield
    finally:
        _SCOPES.remove(made)
        for path in made:
            remove_path(spark, path)
