"""Readers of files with checked columns, and the shapes that landed reports come in."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.events import impulse


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def with_defaults(df: DataFrame, optional: Mapping[str, str]) -> DataFrame:
    """Adds the optional columns (name: type) that are absent, as nulls."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in optional.items() if c not in df.columns})


def parquet(spark: SparkSession, path: str, schema: T.StructType | str | None = None, columns: Sequence[str] = ()) -> DataFrame:
    """Parquet files; Spark fails where the path is absent."""
    return require(spark.read.schema(schema).parquet(path) if schema else spark.read.parquet(path), columns)


def csv(spark: SparkSession, path: str, required: Mapping[str, str], optional: Mapping[str, str] | None = None) -> DataFrame:
    """CSV with a header as the named columns; values that don't parse are null, absent optional columns too."""
    raw = require(spark.read.csv(path, header=True), list(required))
    kinds = {**required, **(optional or {})}
    raw = with_defaults(raw, {c: "string" for c in kinds})
    return raw.select(*(F.expr(f"try_cast(`{c}` AS {kind})").alias(c) for c, kind in kinds.items()))


def event_log(spark: SparkSession, path: str) -> DataFrame:
    """A log of events in CSV: ts, headline, event_class, direction, tier, confidence, is_override, and the impulse that follows from them.

    Quoted headlines may hold commas and line breaks; an event without a time, or of a class without a name, is left out.
    """
    kinds = {"ts": "timestamp", "headline": "string", "event_class": "string", "direction": "string", "tier": "int", "confidence": "double", "is_override": "boolean"}
    raw = require(spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"'), list(kinds))
    typed = raw.select(*(F.expr(f"try_cast(`{c}` AS {kind})").alias(c) for c, kind in kinds.items()))
    return typed.filter("ts is not null and event_class is not null").withColumn("impulse", impulse())


def json_documents(spark: SparkSession, path: str, schema: T.StructType | str, rows: str, one_each: bool = True) -> DataFrame:
    """Documents of one object per file (or per line), with the array column `rows` as rows of their own."""
    raw = spark.read.schema(schema).json(path, multiLine=one_each)
    return raw.select(*(c for c in raw.columns if c != rows), F.inline(rows))


def report(df: DataFrame, names: Mapping[str, str], date: str, pattern: str = "MM/dd/yyyy") -> DataFrame:
    """The known columns under their new names: `date` parsed, all others doubles, rows without a date dropped."""
    parsed = F.to_date(F.try_to_timestamp(F.col(date), F.lit(pattern))).alias(names[date])
    values = [F.expr(f"try_cast(`{c}` AS double)").alias(n) for c, n in names.items() if c != date and c in df.columns]
    return df.select(parsed, *values).filter(F.col(names[date]).isNotNull())


def keyed_header(df: DataFrame, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """Columns named by the first heading that holds all of a name's keywords."""
    out = []
    for name, words in keywords.items():
        found = next((c for c in df.columns if all(w in c.lower() for w in words)), None)
        if found is None:
            raise ValueError(f"no heading for {name}")
        out.append(F.col(f"`{found}`").alias(name))
    return df.select(*out)


def located_header(df: DataFrame, row: str, cells: str, keywords: Mapping[str, Sequence[str]]) -> DataFrame:
    """The rows below the first one whose cells hold the keywords of every name, with a column of text for each name.

    `cells` is an array of texts.  One row comes to the driver: the heading.
    """
    holds = lambda words: F.exists(cells, lambda c: reduce(and_, (F.coalesce(F.lower(c).contains(w), F.lit(False)) for w in words)))
    head = df.filter(reduce(and_, map(holds, keywords.values()))).orderBy(row).select(row, cells).first()
    if head is None:
        raise ValueError("no row holds all keywords")
    at = {name: next(i for i, c in enumerate(head[1]) if c is not None and all(w in c.lower() for w in words)) for name, words in keywords.items()}
    return df.filter(F.col(row) > head[0]).select(*(F.get(cells, F.lit(i)).alias(name) for name, i in at.items()))


def panel(long: DataFrame, keys: Sequence[str], field: str, value: str, fields: Sequence[str]) -> DataFrame:
    """(keys, field, value) rows as one column per field; rows without any value are dropped."""
    return long.groupBy(*keys).pivot(field, list(fields)).agg(F.avg(value)).na.drop("all", subset=list(fields))


def latest(long: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """The last value of each key; null keys are left out."""
    return long.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def good_ticks(df: DataFrame, price: str = "price") -> DataFrame:
    return df.filter(F.col(price).isNotNull() & (F.col(price) > 0))


def by_priority(sources: Sequence[DataFrame], keys: Sequence[str], value: str) -> DataFrame:
    """The first source's value of each key; later sources fill only keys without one.  `keys` are unique in a source."""
    ranked = [s.select(*keys, value, F.lit(n).alias("priority")) for n, s in enumerate(sources)]
    every = ranked[0]
    for s in ranked[1:]:
        every = every.unionByName(s)
    first = W.partitionBy(*keys).orderBy("priority")
    return every.filter(F.col(value).isNotNull()).withColumn("__r", F.row_number().over(first)).filter("__r = 1").drop("__r")
