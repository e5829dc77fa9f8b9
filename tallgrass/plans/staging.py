"""Cutting lineage with tables written to the folder all executors share.

Iterative operators write each step as Parquet below ``spark.checkpoint.dir``.
Unlike a cached or locally checkpointed frame such a step survives the loss of
any executor, is columnar, and carries row counts in its footers. Where the
session is local and names no folder (tests, notebooks) a private temporary one is used.
"""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one if unset."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN_DIR:
        folder = tempfile.TemporaryDirectory(prefix="tallgrass-")
        atexit.register(folder.cleanup)
        _OWN_DIR[app] = folder.name
    return _OWN_DIR[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tallgrass/{label}-{uuid.uuid4().hex}"


def fingerprint(spark: SparkSession, *paths: str) -> str:
    """A name for what lies at ``paths`` now: it changes with their names, sizes, numbers of files and times of change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    facts = []
    for p in sorted(paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(conf)
        size = fs.getContentSummary(path)
        facts.append((p, size.getLength(), size.getFileCount(), fs.getFileStatus(path).getModificationTime()))
    return hashlib.sha256(repr(facts).encode()).hexdigest()[:24]


def stage(df: DataFrame, label: str = "step", group_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a frame that reads it.

    ``group_rows`` bounds the rows of a row group, for rows of megabytes: a writer holds, and a reader takes into
    memory, a whole group of them (else sizes are first looked at after 100 rows).
    """
    spark = df.sparkSession
    path = new_path(spark, label)
    written = df.write.option("compression", "zstd")
    (written if group_rows is None else written.option("parquet.block.row.count.limit", group_rows)).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged._tallgrass_path = path
    return staged


def release(*frames: DataFrame) -> None:
    """Delete staged tables that no later plan reads."""
    for df in frames:
        path = getattr(df, "_tallgrass_path", None)
        if path is None:
            continue
        spark = df.sparkSession
        jvm = spark.sparkContext._jvm
        hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
        hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop_path, True)
        df._tallgrass_path = None
