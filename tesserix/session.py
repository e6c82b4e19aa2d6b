"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Lets the data sources rule out files before they are opened; they also work without it.
    "spark.sql.python.filterPushdown.enabled": "true",
}


def build_session(app: str = "tesserix", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings every operator here is written for."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULT_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_OWN: list[str] = []


def _own_folder() -> str:
    if not _OWN:
        _OWN.append(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        atexit.register(shutil.rmtree, _OWN[0], ignore_errors=True)
    return _OWN[0]


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``.

    Only a session whose tasks run in this very process may go without that setting: it gets a temporary folder, removed
    at exit. On a cluster other machines would not see one, so its absence is an error.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = _own_folder()
    return os.path.join(base, f"{name}-{uuid.uuid4().hex}")


_RECORDS: list[list[str]] = []


@contextmanager
def recorded_tables() -> Iterator[list[str]]:
    """The folders that ``cut_lineage`` writes meanwhile, for ``drop_tables`` once nothing reads them any more."""
    made: list[str] = []
    _RECORDS.append(made)
    try:
        yield made
    finally:
        # By identity: records around each other are equal lists as long as they hold the same folders.
        del _RECORDS[next(i for i, other in enumerate(_RECORDS) if other is made)]


def drop_tables(spark: SparkSession, folders: list[str]) -> None:
    """Delete stored tables that are of no use any longer."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    folders.clear()


def cut_lineage(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    A written table survives the loss of any executor and gives the next step real row counts to plan with.
    """
    path = shared_folder(df.sparkSession, name)
    for made in _RECORDS:
        made.append(path)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def kept_by(df: DataFrame, key: str, name: str) -> Iterator[DataFrame]:
    """``df`` as a table in buckets of ``key``, while the block runs: joins on that column move the other side only.

    Each bucket is one file if ``df`` is partitioned by the key; their number is that of shuffle partitions.
    """
    spark = df.sparkSession
    path, table = shared_folder(spark, name), f"{name}_{uuid.uuid4().hex}"
    for made in _RECORDS:
        made.append(path)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(table)
    try:
        yield spark.table(table)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        drop_tables(spark, [path])
