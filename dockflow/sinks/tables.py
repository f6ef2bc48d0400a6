"""Table writers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def write_partitioned(df: DataFrame, path: str, by: list[str], incremental: bool = False) -> None:
    """Parquet by partition columns, few files per partition however large one partition is.

    The rebalance hint gathers each partition's rows and lets Spark split partitions that are too large, so a month
    that holds most rows is not written by one task. A full rebuild replaces the table; ``incremental`` replaces only
    the partitions that have rows.
    """
    mode = "dynamic" if incremental else "static"
    (
        df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", mode)
        .partitionBy(*by).parquet(path)
    )


def write_table(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """Artefacts as JSON lines, gathered from small tables by AQE rather than by one task."""
    df.hint("rebalance").write.mode("overwrite").json(path)


def register_partitioned(df: DataFrame, name: str, path: str, by: list[str]) -> None:
    """Write and make the table and its partitions known to the session catalog."""
    write_partitioned(df, path, by)
    spark = df.sparkSession
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    spark.catalog.createTable(name, path=path, source="parquet")
    spark.sql(f"MSCK REPAIR TABLE {name}")


# ---- publication ---------------------------------------------------------------------------------------------------
#
# A published table is a folder of versions, never overwritten, and of numbered manifests, each one small file that names
# a version. A version counts once its manifest is whole, so a run that fails leaves the last table as it was, and a
# reader that has started keeps the files it began with.

MANIFESTS = "_manifests"


def _hadoop(spark: SparkSession, path: str):
    """The path and its file system, as Spark's own readers find it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def write_version(df: DataFrame, root: str, by: list[str]) -> str:
    """The rows in a version folder of their own, which no reader sees yet; its name."""
    name = f"version-{uuid.uuid4().hex}"
    rows = df.hint("rebalance", *by).write
    (rows.partitionBy(*by) if by else rows).parquet(f"{root}/{name}")
    return name


def write_manifest(spark: SparkSession, root: str, number: int, text: str) -> None:
    """One manifest. An error if the number is taken: of two publishers at once one fails, and neither is lost unseen."""
    at, system = _hadoop(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
    stream = system.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all manifests, greatest first: one file a publication."""
    at, system = _hadoop(spark, f"{root}/{MANIFESTS}")
    if not system.exists(at):
        return []
    names = (f.getPath().getName() for f in system.listStatus(at))
    return sorted((int(n[:12]) for n in names if n.endswith(".json") and n[:12].isdigit()), reverse=True)


def _manifest(spark: SparkSession, root: str, number: int) -> dict | None:
    """What a manifest says; None where its write was cut short."""
    at, system = _hadoop(spark, f"{root}/{MANIFESTS}/{number:012d}.json")
    stream = system.open(at)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return None


def latest(spark: SparkSession, root: str) -> tuple[int, dict | None]:
    """The greatest number given so far and the newest whole manifest; 0 and None before the first."""
    numbers = _numbers(spark, root)
    found = (m for m in (_manifest(spark, root, n) for n in numbers) if m is not None)
    return (numbers[0] if numbers else 0), next(found, None)


def whole_numbers(spark: SparkSession, root: str) -> list[int]:
    """The numbers of all whole manifests."""
    return [n for n in _numbers(spark, root) if _manifest(spark, root, n) is not None]


def publish(df: DataFrame, root: str, by: list[str]) -> int:
    """Write a version, then switch readers to it by one manifest; its number."""
    spark = df.sparkSession
    before, _ = latest(spark, root)
    name = write_version(df, root, by)
    write_manifest(spark, root, before + 1, json.dumps({"version": name, "by": by, "schema": df.schema.json()}))
    return before + 1


def published(spark: SparkSession, root: str) -> DataFrame:
    """The newest whole version."""
    _, manifest = latest(spark, root)
    if manifest is None:
        raise ValueError(f"nothing is published below {root}")
    schema = StructType.fromJson(json.loads(manifest["schema"]))
    return spark.read.schema(schema).parquet(f"{root}/{manifest['version']}").select(*schema.names)


def register_published(spark: SparkSession, name: str, root: str) -> None:
    """A view of the newest whole version: the catalog replaces a view in one step, and partitions prune through it."""
    columns = ", ".join(f"`{c}`" for c in published(spark, root).columns)
    _, manifest = latest(spark, root)
    spark.sql(f"CREATE OR REPLACE VIEW {name} AS SELECT {columns} FROM parquet.`{root}/{manifest['version']}`")


def remove_versions(spark: SparkSession, root: str, keep: int = 2) -> int:
    """Delete version folders that none of the newest ``keep`` manifests names, half-written ones included; how many.

    Not to be run beside a publisher, whose version has no manifest yet.
    """
    whole = [m for m in (_manifest(spark, root, n) for n in _numbers(spark, root)) if m is not None]
    kept = {m["version"] for m in whole[:keep]}
    at, system = _hadoop(spark, root)
    old = [f.getPath() for f in system.listStatus(at) if f.getPath().getName().startswith("version-")]
    gone = [p for p in old if p.getName() not in kept]
    for path in gone:
        system.delete(path, True)
    return len(gone)
