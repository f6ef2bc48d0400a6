"""What to download: links found on pages, date chunks per weather point, and what is still missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.contract import Contract, ContractError
from dockflow.functions.single import attach

# Hrefs of the published archives and station tables. Groups: url, year, quarter; url.
TRIP_ARCHIVE_LINK = r'(?i)href="(https?://[^"]*?-trips-(\d{4})-q(\d)\.zip)"'
STATION_FILE_LINK = r'(?i)href="(https?://[^"]*?-stations-[\d-]+\.csv)"'
# Fixed value: days added to a chunk's first day to get its last.
CHUNK_DAYS = 182


def extract_links(pages: DataFrame, pattern: str, key_groups: list[int]) -> DataFrame:
    """Every link on every page that matches, with its position and the captured groups as a key array."""
    whole = pages.select(
        "page_id", F.posexplode(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).alias("position", "tag")
    )
    keys = F.array(*[F.regexp_extract("tag", pattern, g) for g in key_groups]) if key_groups else F.array(F.lit(""))
    return whole.select("page_id", "position", F.regexp_extract("tag", pattern, 1).alias("url"), keys.alias("key"))


def last_link_per_key(links: DataFrame) -> DataFrame:
    """A key linked more than once keeps its last link; partial aggregation keeps a popular key cheap."""
    return links.groupBy("key").agg(
        F.max_by("url", F.struct("page_id", "position")).alias("url"), F.count(F.lit(1)).alias("n_links")
    )


def trip_archives(pages: DataFrame, min_year: int, pattern: str = TRIP_ARCHIVE_LINK) -> DataFrame:
    """Year, quarter and address of each quarterly archive from ``min_year`` on."""
    found = last_link_per_key(extract_links(pages, pattern, [2, 3]))
    return found.select(
        F.col("key")[0].cast("int").alias("year"), F.col("key")[1].cast("int").alias("quarter"), "url"
    ).filter(F.col("year") >= min_year)


def newest_station_file(pages: DataFrame, pattern: str = STATION_FILE_LINK) -> DataFrame:
    """The file name carries its date, so the greatest address is the current table."""
    return extract_links(pages, pattern, []).agg(F.max("url").alias("url")).filter("url IS NOT NULL")


def fetch_plan(points: DataFrame, bounds: DataFrame) -> DataFrame:
    """Chunks of half a year per point (``point_name``) between ``first_day`` and ``last_day``, both included.

    ``bounds`` is one row. A last day left over by itself is a chunk of its own.
    """
    starts = F.explode(F.expr(f"sequence(first_day, last_day, INTERVAL {CHUNK_DAYS + 1} DAYS)"))
    chunks = attach(points, bounds).select("point_name", "last_day", starts.alias("chunk_start"))
    return chunks.select(
        "point_name",
        "chunk_start",
        F.least(F.date_add("chunk_start", CHUNK_DAYS), F.col("last_day")).alias("chunk_end"),
    ).withColumn(
        "object_name",
        F.format_string("point=%s/%s_%s.json.gz", "point_name", F.date_format("chunk_start", "yyyy-MM-dd"),
                        F.date_format("chunk_end", "yyyy-MM-dd")),
    )


def grid_points(spark: SparkSession, contract: Contract) -> DataFrame:
    if not contract.grid_points:
        raise ContractError("the contract lists no grid points")
    return spark.createDataFrame([(p["name"],) for p in contract.grid_points], "point_name string")


def landed_objects(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Names, relative to ``path``, of what is already there. Only the listing is read."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
        .load(path).select("path")
    )
    root = F.lit(path.rstrip("/").split(":", 1)[-1].lstrip("/") + "/")
    # Cut at the first occurrence: a folder below may bear the root's name again.
    start = F.instr(F.col("path"), root) + F.length(root)
    return files.select(F.substring(F.col("path"), start, F.length("path")).alias("object_name"))


def still_to_fetch(plan: DataFrame, landed: DataFrame) -> DataFrame:
    """Raw files are never fetched twice."""
    return plan.join(landed, "object_name", "left_anti")
