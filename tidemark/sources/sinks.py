"""Sinks: Parquet, CSV, JSON snapshots and day reports."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def parquet(df: DataFrame, path: str, by: Sequence[str] = ()) -> None:
    df.write.mode("overwrite").partitionBy(*by).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def json_snapshot(df: DataFrame, path: str, metadata: Mapping[str, str], legend: Mapping[str, str] | None = None) -> None:
    """Two folders: records, a JSON object for each row, and header, one object with the metadata, the legend and the number of records.

    So no task holds all rows, and what holds for all of them is written once.
    """
    df.write.mode("overwrite").json(f"{path}/records")
    n = df.sparkSession.read.schema(df.schema).json(f"{path}/records").agg(F.count(F.lit(1)).alias("records"))
    stamp = F.struct(*(F.lit(v).alias(k) for k, v in metadata.items()))
    notes = F.map_from_arrays(F.array(*map(F.lit, legend)), F.array(*map(F.lit, legend.values()))) if legend else F.lit(None).cast("map<string,string>")
    n.select(stamp.alias("metadata"), notes.alias("legend"), "records").coalesce(1).write.mode("overwrite").json(f"{path}/header")


def day_lines(df: DataFrame, day: str, group: str, seq: str, text: str) -> DataFrame:
    """(day, lines of a report sorted by group, then number): a heading before each group's entries."""
    entry = df.select(F.col(day).alias("day"), F.coalesce(F.upper(group), F.lit("GENERAL")).alias("grp"), F.col(seq).alias("seq"), F.concat(F.lit("- "), text).alias("line"))
    heading = entry.select("day", "grp").distinct().select("day", "grp", F.lit(None).cast(df.schema[seq].dataType).alias("seq"), F.concat(F.lit("## "), "grp").alias("line"))
    return entry.unionByName(heading)


def day_report(df: DataFrame, path: str, day: str, group: str, seq: str, text: str, rows: int = 1_000_000) -> None:
    """One folder per day of Markdown lines, in the order of its files' names and their lines.

    Lines are dealt in ranges of (day, group, number) of about `rows` lines, so a long day is written by many tasks, and a
    file has `rows` lines at most; Spark numbers the files by range, then within it.
    """
    lines = day_lines(df, day, group, seq, text)
    parts = max(1, -(-lines.count() // rows))
    order = "day", "grp", F.asc_nulls_first("seq")
    laid = lines.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    laid.select("day", "line").write.mode("overwrite").option("maxRecordsPerFile", rows).partitionBy("day").text(path)
