"""Zip archives and directories of CSV files, read as text.

Nothing is cast here: a value whose format changed between releases must survive until the conform phase.
"""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dockflow.contract import ContractError
from dockflow.session import staged

BLOCK_CHARS = 4 << 20


def list_files(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """Paths below ``path`` at any depth; contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", pattern)
        .load(path)
        .select(F.col("path"), F.col("length"), F.col("_metadata.file_path").alias("file_path"))
    )
    if files.isEmpty():
        raise ContractError(f"no {pattern} below {path}")
    return files


def open_path(path: str):
    """Open a path as Spark names it, seekable, on any file system Arrow knows."""
    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path in batch["path"]:
            with open_path(path) as raw, zipfile.ZipFile(raw) as archive:
                names = [n for n in archive.namelist() if n.lower().endswith(".csv")]
            yield pd.DataFrame({"path": path, "member": names})


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stream each member and pass it on in blocks of whole lines, every block with its member's header."""
    for batch in batches:
        for path, member in zip(batch["path"], batch["member"]):
            with open_path(path) as raw, zipfile.ZipFile(raw) as archive, archive.open(member) as stream:
                text = io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")
                header, rest, number = "", "", 0
                while True:
                    chunk = text.read(BLOCK_CHARS)
                    rest += chunk
                    end = rest.rfind("\n") + 1 if chunk else len(rest)
                    block, rest = rest[:end], rest[end:]
                    if block and not header:
                        header, _, block = block.partition("\n")
                    if block.strip():
                        yield pd.DataFrame(
                            {"path": [path], "member": [member], "block": [number], "header": [header], "text": [block]}
                        )
                        number += 1
                    if not chunk:
                        break


def split_record(line: Column) -> Column:
    """The cells of one line. A cell may be quoted, with doubled quotes inside; other quotes are plain characters."""
    found = F.regexp_extract_all(F.concat(F.lit(","), line), F.lit(r',("(?:[^"]|"")*"[^,]*|[^,]*)'), F.lit(1))
    bare = lambda c: F.replace(F.regexp_extract(c, r'^"((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"'))
    quoted = F.transform(found, lambda c: F.when(c.startswith('"'), bare(c)).otherwise(c))
    return F.when(F.instr(line, '"') > 0, quoted).otherwise(F.split(line, ","))


def read_zip_csv(spark: SparkSession, path: str) -> DataFrame:
    """Rows of every CSV in every zip below ``path``: archive, member and the cells by header.

    Python only inflates: members are streamed and handed on as blocks of a few megabytes, which are spread evenly and
    split into lines and cells by Spark. One very large member is thus parsed by many tasks. A line is a record, as in
    Spark's own reader: a stray quote does not swallow the lines after it. Cells beyond the header have no name and are
    left out; of two equal names the last counts.
    """
    blocks = _member_table(spark, path).mapInPandas(
        _blocks, "path string, member string, block int, header string, text string"
    )
    spread = blocks.repartition("path", "member", "block").select(
        F.element_at(F.split("path", "/"), -1).alias("archive"),
        "member",
        split_record(F.rtrim(F.col("header"), F.lit("\r"))).alias("names"),
        F.explode(F.split("text", "\n")).alias("line"),
    )
    lines = spread.withColumn("line", F.rtrim(F.col("line"), F.lit("\r"))).filter("line <> ''")
    cells = lines.select("archive", "member", "names", split_record(F.col("line")).alias("cells"))
    last = lambda n: F.size("names") - F.array_position(F.reverse("names"), n).cast("int")
    entry = lambda n: F.struct(n.alias("key"), F.nullif(F.get("cells", last(n)), F.lit("")).alias("value"))
    by_name = F.map_from_entries(F.transform(F.array_distinct("names"), entry))
    return cells.select("archive", "member", by_name.alias("cells"))


def _member_table(spark: SparkSession, path: str) -> DataFrame:
    """(path, member) of every CSV, one partition for each: a member is inflated by one task, so none should wait."""
    files = list_files(spark, path, "*.zip").select("path")
    members = staged(files.repartition(max(files.count(), 1), "path").mapInPandas(_members, "path string, member string"))
    return members.repartition(max(members.count(), 1), "path", "member")


def _member_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, member in zip(batch["path"], batch["member"]):
            with open_path(path) as raw, zipfile.ZipFile(raw) as archive, archive.open(member) as stream:
                line = io.TextIOWrapper(stream, encoding="utf-8-sig", newline="").readline().rstrip("\r\n")
            cells = [dict.fromkeys(next(csv.reader([line]), []))]
            yield pd.DataFrame({"archive": path.rsplit("/", 1)[-1], "member": member, "cells": cells})


def read_zip_headers(spark: SparkSession, path: str) -> DataFrame:
    """One row per member with its header as empty cells: what a header audit needs, without reading the rows."""
    return _member_table(spark, path).mapInPandas(
        _member_headers, "archive string, member string, cells map<string,string>"
    )


def _headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        lines = []
        for path in batch["path"]:
            with open_path(path) as raw:
                lines.append(io.TextIOWrapper(raw, encoding="utf-8-sig").readline().rstrip("\r\n"))
        yield pd.DataFrame({"file_path": batch["file_path"], "header": lines})


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """Every CSV below ``path`` as text columns, each file under its own header.

    All files are read once, as lines, and meet the header of their file by a join: one row a file, broadcast only as
    Spark's own threshold allows. The driver sees distinct headers, never one a file. A line is a record, as in
    ``read_zip_csv``; lines equal to their file's header and empty lines are no records. A column some files lack is NULL
    for their rows, as are empty cells; of two equal names in a header the last counts. Names that differ in case only are
    one column, as Spark resolves them.
    """
    listed = list_files(spark, path, "*.csv").filter("length > 0")
    headers = listed.repartition(max(listed.count(), 1), "path").mapInPandas(_headers, "file_path string, header string")
    headers = staged(headers.withColumn("names", split_record(F.col("header"))))
    distinct = [r["names"] for r in headers.select("names").distinct().sort("names").collect()]
    if not distinct:
        raise ContractError(f"only empty files below {path}")
    lines = (
        spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path)
        .select("_metadata.file_path", F.ltrim(F.col("value"), F.lit("\ufeff")).alias("line"))
    )
    rows = lines.join(headers, "file_path").filter("line <> '' AND line <> header")
    cells = rows.select("names", split_record(F.col("line")).alias("cells"))
    last = lambda n: F.size("names") - F.array_position(F.reverse("names"), n).cast("int")
    cell = lambda n: F.when(F.array_contains("names", n), F.nullif(F.get("cells", last(n)), F.lit("")))
    spellings: dict[str, dict[str, None]] = {}
    for name in (n for names in distinct for n in names):
        spellings.setdefault(name.lower(), {})[name] = None
    return cells.select(*[F.coalesce(*map(cell, same)).alias(next(iter(same))) for same in spellings.values()])
