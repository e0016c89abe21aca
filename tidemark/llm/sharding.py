"""Sharding by rendezvous hashing over weighted shards, with Spark SQL functions only.

A record's key and the shard's name alone decide the score of a (record, shard) pair, and the record goes to the
shard with the highest one.  A shard that is added therefore takes records only into itself, and one that is taken away
gives its own records to the others; no other record moves.

Defined results: a null key hashes like the empty string; rows with equal keys share a shard and keep one slot each; an
empty table gives an empty result; columns of the input are kept, but an added column replaces one of its name (callers
can name the added columns), and the key can't have the name of one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Characters of a hash that give a slot bucket: 16 ** 2 buckets in each shard, however many rows there are.
BUCKET_HEX = 2


def key_hash(key: Column) -> Column:
    """MD5 of the key as text, in hex."""
    return F.md5(F.coalesce(key.cast("string"), F.lit("")))


def unit_hash(text: Column) -> Column:
    """A number in (0, 1) from the first 52 bits of the text's MD5."""
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard 0..n-1 with the highest -weight / ln(hash(key, shard)); the lowest number wins a tie."""
    k = F.coalesce(key.cast("string"), F.lit(""))
    if len(weights) == 0 or any(w < 0 for w in weights) or not any(weights):
        raise ValueError("weights must be non-negative, and one of them positive")
    scored = [
        F.struct((F.lit(-float(w)) / F.log(unit_hash(F.concat(k, F.lit(f"#{s}"))))).alias("score"), F.lit(-s).alias("s"))
        for s, w in enumerate(weights)
        if w > 0
    ]
    best = F.greatest(*scored) if len(scored) > 1 else scored[0]
    return (-best["s"]).cast("int")


def assign(df: DataFrame, key: str, weights: Sequence[float], out: str = "shard") -> DataFrame:
    """Adds the shard of each row; no shuffle."""
    if key == out:
        raise ValueError("the key can't be replaced")
    return df.withColumn(out, rendezvous(F.col(key), weights))


def with_slots(df: DataFrame, key: str, order: Sequence[str] = (), shard: str = "shard", out: str = "slot") -> DataFrame:
    """Adds a gapless number from 0 to the rows of each shard, in the order of the key's hash.

    Rows are numbered inside (shard, bucket of the hash) groups, so no task holds a whole shard; the groups' sizes, at
    most 16 ** BUCKET_HEX for each shard, give their first numbers.  Rows with the same key are numbered by `order`.
    """
    if out in (key, shard, *order):
        raise ValueError("slots can't replace what they are made from")
    h = df.drop(out).withColumn("__h", key_hash(F.col(key))).withColumn("__b", F.substring("__h", 1, BUCKET_HEX))
    first = (
        h.groupBy(shard, "__b")
        .agg(F.count(F.lit(1)).alias("__n"))
        .withColumn("__first", F.sum("__n").over(W.partitionBy(shard).orderBy("__b")) - F.col("__n"))
        .drop("__n")
    )
    inside = W.partitionBy(shard, "__b").orderBy("__h", F.col(key), *order)
    numbered = h.withColumn("__r", F.row_number().over(inside))
    return (
        numbered.join(first, [shard, "__b"])
        .select(*df.drop(out).columns, "__first", "__r")
        .withColumn(out, (F.col("__first") + F.col("__r") - 1).cast("long"))
        .drop("__r", "__first")
    )
