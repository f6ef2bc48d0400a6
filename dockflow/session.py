"""Session settings and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Scratch folders made so far, for `scratch_scope` to remove.
_MADE: list[str] = []


def build_session(app_name: str, timezone: str, **conf: str) -> SparkSession:
    """A session whose wall clock is the network's own zone. Sizing is left to the cluster."""
    builder = (
        SparkSession.builder.appName(app_name)
        .config("spark.sql.session.timeZone", timezone)
        .config("spark.sql.parquet.outputTimestampType", "TIMESTAMP_MICROS")
        .config("spark.sql.adaptive.enabled", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Only where driver and executors are one process may it be a temporary one; elsewhere each executor would write to
    its own disk.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError(f"spark.checkpoint.dir is not set: {master} needs a folder that all executors share")
    root = tempfile.mkdtemp(prefix="dockflow-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_dir(spark: SparkSession) -> str:
    """A fresh path below the shared folder."""
    path = f"{scratch_root(spark)}/dockflow-{uuid.uuid4().hex}"
    _MADE.append(path)
    return path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder that no later job reads."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Removes the scratch folders made inside, once what was made from them has been written elsewhere."""
    before = len(_MADE)
    try:
        yield
    finally:
        made, _MADE[before:] = _MADE[before:], []
        for path in made:
            removed(spark, path)


def staged(df: DataFrame) -> DataFrame:
    """Write once and read back: for a table that several jobs of one run read. Survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
