"""Mixing sources to target weights, with Spark SQL functions only.

1. `targets`: each source gets its weight's share of all sizes, at most `most` times its own size; what a source cannot
   take is shared again by weight.  With all sources in the order of cap over weight, the first one whose uncapped
   share stays under its cap ends the capped ones, so one ordered pass over the sources gives the fixed point.
2. `pack`: each source's documents are laid end to end in the order of their key's hash and cut into blocks of
   `block` tokens (the last one may be shorter).  A source of under FEWEST * `block` tokens has shorter blocks, so that
   whole blocks can come near its target.
3. `draw`: the output is a row of shards of `slots` slots each; every slot of a shard draws its source from the
   weights, which makes the shard's counts multinomial.  A source's draws beyond its quota of blocks go, in shard
   order, to the sources that got too few, so that totals are exact.
4. `mix`: the g-th slot of a source takes block perm(g mod n) of its n blocks, where perm is a pseudorandom permutation
   of 0..n-1 that differs by source and by epoch g div n; slots and blocks are joined on (source, block).

The running sums over documents go by (source, hash bucket) and then over buckets, so a source with a third of all rows
is spread over 16 ** BUCKET_HEX groups; those over shards go by runs of RUN shards and then over runs.  Only the table of
sources, whose size is that of the weights' configuration, is ever ordered as a whole.

Defined results: a null text has no tokens; a null source is a source, ordered last; documents without tokens are never
taken; repeated rows count as rows of their own; an empty table gives an empty result; no names but `key`, `source` and
`size` are read, other columns are kept, and the columns that are added (ADDED) replace those of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.sharding import key_hash, unit_hash
from tidemark.llm.stage import settle

WORD = r"[^\x20\x09-\x0D]+"
BUCKET_HEX = 3
#: Tokens of a block, and slots of an output shard, unless the caller names others.
BLOCK, SLOTS = 128, 16_384
FEWEST = 256
#: Shards whose running sums one task works out.
RUN = 4096
#: Columns that `mix` adds, and `block_size`, which it needs.
ADDED = ("source_size", "target", "block_size", "row_no", "block", "from", "to", "shard", "epoch")


def words(text: Column) -> Column:
    """Number of words; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def primes_above(low: int, count: int) -> list[int]:
    """The first `count` primes above `low`, by Miller-Rabin with bases that are exact below 3.3e24."""

    def prime(n: int) -> bool:
        small = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41)
        if any(n % p == 0 for p in small):
            return n in small
        d, r = n - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for a in small:
            x = pow(a, d, n)
            if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(r - 1)):
                return False
        return True

    found: list[int] = []
    n = low | 1
    while len(found) < count:
        found += [n] if prime(n) else []
        n += 2
    return found


#: Each is above any number of blocks (2 ** 40), so prime to it.
MULTIPLIERS = primes_above(1 << 40, 16)


def permuted(i: Column, n: Column, label: Column) -> Column:
    """Where a pseudorandom permutation of 0..n-1, chosen by the label, sends i; n below 2 ** 40."""
    pick = lambda salt, m: F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(salt), label)), 1, 12), 16, 10).cast("long"), m)
    a = F.pmod(F.element_at(F.array(*(F.lit(p) for p in MULTIPLIERS)), (pick("a", F.lit(16)) + 1).cast("int")), n)
    step = F.lit(1 << 20)
    high, low = F.floor(i / step).cast("long"), F.pmod(i, step)
    return F.pmod(F.pmod(F.pmod(high * a, n) * step, n) + low * a + pick("b", n), n)


def targets(sizes: DataFrame, source: str, size: str, most: float = 3.0, block: int = BLOCK, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """One row per source: source, source_size, target, block_size.  Weights repeat over the sources in code-point order."""
    order = W.orderBy(F.col(source).asc_nulls_last())
    per = (
        sizes.groupBy(source)
        .agg(F.sum(size).alias("source_size"))
        .withColumn("__k", F.row_number().over(order) - 1)
        .withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("__k") % len(weights) + 1).cast("int")))
        .withColumn("__cap", most * F.col("source_size"))
    )
    fill = W.orderBy((F.col("__cap") / F.col("weight")), "__k")
    before = fill.rowsBetween(W.unboundedPreceding, -1)
    everyone = W.partitionBy()
    level = (F.sum("source_size").over(everyone) - F.coalesce(F.sum("__cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everyone) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = per.withColumn("__level", level)
    fits = F.when(F.col("__level") * F.col("weight") <= F.col("__cap"), F.struct(F.col("__cap") / F.col("weight"), F.col("__k"), F.col("__level").alias("level")))
    chosen = F.min(fits).over(everyone)["level"]
    return leveled.withColumn("__chosen", chosen).select(
        source,
        "source_size",
        F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("source_size") / FEWEST))).cast("long").alias("block_size"),
        F.coalesce(F.least(F.col("__cap"), F.col("__chosen") * F.col("weight")), F.col("__cap")).cast("double").alias("target"),
    )


def pack(docs: DataFrame, plan: DataFrame, key: str, source: str, size: str) -> DataFrame:
    """The pieces of documents in blocks: all columns, source_size, target, row_no (of the source's documents), block, from, to (of the document's tokens)."""
    h = docs.withColumn("__h", key_hash(F.col(key))).withColumn("__b", F.substring("__h", 1, BUCKET_HEX))
    same = [source, "__b"]
    before = (
        h.groupBy(*same)
        .agg(F.sum(size).alias("__s"), F.count(F.lit(1)).alias("__n"))
        .withColumn("__s0", F.sum("__s").over(W.partitionBy(source).orderBy("__b")) - F.col("__s"))
        .withColumn("__n0", F.sum("__n").over(W.partitionBy(source).orderBy("__b")) - F.col("__n"))
        .select(F.col(source).alias("__source"), F.col("__b").alias("__b2"), "__s0", "__n0")
        .join(plan.withColumnRenamed(source, "__plan"), F.col("__source").eqNullSafe(F.col("__plan")))
        .drop("__plan")
    )
    inside = W.partitionBy(*same).orderBy("__h", key, size).rowsBetween(W.unboundedPreceding, 0)
    laid = (
        h.withColumn("__s1", F.sum(size).over(inside) - F.col(size))
        .withColumn("__n1", F.count(F.lit(1)).over(inside) - 1)
        .join(before, F.col(source).eqNullSafe(F.col("__source")) & (F.col("__b") == F.col("__b2")))
        .withColumn("__at", F.col("__s0") + F.col("__s1"))
        .withColumn("row_no", F.col("__n0") + F.col("__n1"))
        .drop("__h", "__b", "__b2", "__source", "__s0", "__s1", "__n0", "__n1")
    )
    block = F.col("block_size")
    first = F.floor(F.col("__at") / block).cast("long")
    last = F.greatest(first, F.floor((F.col("__at") + F.col(size) - 1) / block).cast("long"))
    return (
        laid.withColumn("block", F.explode(F.sequence(first, last)))
        .withColumn("from", F.greatest(F.lit(0).cast("long"), F.col("block") * block - F.col("__at")))
        .withColumn("to", F.least(F.col(size), (F.col("block") + 1) * block - F.col("__at")))
        .drop("__at", "block_size")
    )


def sum_before(df: DataFrame, by: list[str], order: str, value: str, out: str) -> DataFrame:
    """Adds the sum of `value` over the rows of `by` with a lower `order` (a whole number, once for each `by`)."""
    df = df.withColumn("__run", F.floor(F.col(order) / RUN))
    runs = df.groupBy(*by, "__run").agg(F.sum(value).alias("__s"))
    runs = runs.withColumn("__s0", F.sum("__s").over(W.partitionBy(*by).orderBy("__run")) - F.col("__s")).drop("__s")
    inside = W.partitionBy(*by, "__run").orderBy(order)
    return df.withColumn("__s1", F.sum(value).over(inside) - F.col(value)).join(runs, [*by, "__run"]).withColumn(out, F.col("__s0") + F.col("__s1")).drop("__run", "__s0", "__s1")


def draw(plan: DataFrame, source: str, slots: int = SLOTS, seed: int = 0) -> DataFrame:
    """shard, source, epoch, block: one row for each slot.  `plan` is what `targets` gives."""
    quota = (
        plan.filter("source_size > 0")
        .withColumn("__blocks", F.ceil(F.col("source_size") / F.col("block_size")).cast("long"))
        .withColumn("__quota", F.floor(F.col("target") * F.col("__blocks") / F.col("source_size") + 0.5).cast("long"))
        .filter("__quota > 0")
        .withColumn("__k", (F.row_number().over(W.orderBy(F.col(source).asc_nulls_last())) - 1).cast("int"))
        .withColumn("__cum", F.sum("__quota").over(W.orderBy("__k")))
    )
    shards = (
        quota.agg(F.sum("__quota").alias("__all"), F.array_sort(F.collect_list("__cum")).alias("__cums"))
        .filter("__all > 0")
        .withColumn("shard", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__all") - 1) / slots).cast("long"))))
        .repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard")
    )
    u = unit_hash(F.concat_ws(":", F.lit(seed), "shard", "slot"))
    drawn = (
        shards.withColumn("slot", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.lit(slots), F.col("__all") - F.col("shard") * slots) - 1)))
        .withColumn("__x", F.floor(u * F.col("__all")).cast("long"))
        .select("shard", F.size(F.filter("__cums", lambda c: c <= F.col("__x"))).cast("int").alias("__k"))
        .groupBy("shard", "__k")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    drawn = settle(drawn)
    counted = sum_before(drawn, ["__k"], "shard", "__c", "__before").join(quota.select("__k", "__quota"), "__k")
    kept = settle(counted.withColumn("__keep", F.greatest(F.lit(0).cast("long"), F.least("__c", F.col("__quota") - F.col("__before")))))
    # What a shard drew beyond a quota, in shard order, against what each source still lacks.
    spare = kept.filter("__c > __keep").groupBy("shard").agg(F.sum(F.col("__c") - F.col("__keep")).alias("__n"))
    spare = sum_before(spare, [], "shard", "__n", "__lo").withColumn("__hi", F.col("__lo") + F.col("__n"))
    got = drawn.groupBy("__k").agg(F.sum("__c").alias("__got"))
    lack = quota.join(got, "__k", "left").withColumn("__d", F.col("__quota") - F.coalesce("__got", F.lit(0)))
    lack = lack.filter("__d > 0").withColumn("__dhi", F.sum("__d").over(W.orderBy("__k"))).withColumn("__dlo", F.col("__dhi") - F.col("__d"))
    lacks = lack.agg(F.collect_list(F.struct(F.col("__k").alias("k"), F.col("__dlo").alias("lo"), F.col("__dhi").alias("hi"))).alias("__lacks"))
    refill = (
        spare.withColumn("__one", F.lit(1))
        .join(lacks.withColumn("__one", F.lit(1)), "__one")
        .select("shard", "__lo", "__hi", F.explode("__lacks").alias("__l"))
        .filter("__l.lo < __hi and __l.hi > __lo")
        .select("shard", F.col("__l.k").alias("__k"), (F.least("__hi", F.col("__l.hi")) - F.greatest("__lo", F.col("__l.lo"))).alias("__c"))
    )
    final = kept.select("shard", "__k", F.col("__keep").alias("__c")).union(refill).groupBy("shard", "__k").agg(F.sum("__c").alias("__c"))
    final = settle(final.filter("__c > 0"))
    return (
        sum_before(final, ["__k"], "shard", "__c", "__g0")
        .join(quota.select("__k", source, "__blocks"), "__k")
        .repartition(int(plan.sparkSession.conf.get("spark.sql.shuffle.partitions")), "shard", "__k")
        .withColumn("__g", F.explode(F.sequence(F.col("__g0"), F.col("__g0") + F.col("__c") - 1)))
        .withColumn("epoch", F.floor(F.col("__g") / F.col("__blocks")).cast("int"))
        .withColumn("block", permuted(F.pmod("__g", F.col("__blocks")), F.col("__blocks"), F.concat_ws(":", F.lit(seed), F.coalesce(source, F.lit("\0")), "epoch")))
        .select("shard", F.col(source).alias("__source"), "epoch", F.col("block").alias("__block"))
    )


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size", most: float = 3.0, block: int = BLOCK, slots: int = SLOTS, seed: int = 0, weights: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """The pieces that the mix takes: the columns of `docs`, source_size, target, row_no, block, from, to, shard and epoch.

    A piece that is taken twice has two rows; a piece that is not taken has one, whose shard is null.
    """
    if {key, source, size} & {*ADDED}:
        raise ValueError(f"none of {', '.join(ADDED)} can name the key, the source or the size")
    docs = docs.drop(*ADDED)
    plan = targets(docs, source, size, most, block, weights)
    slot = draw(plan, source, slots, seed)
    pieces = pack(docs, plan, key, source, size)
    same = F.col(source).eqNullSafe(F.col("__source")) & (F.col("block") == F.col("__block"))
    # Slots come from a few rows by explode(), so their size can't be told beforehand: never broadcast them.
    return pieces.join(slot.hint("merge"), same, "left").drop("__source", "__block")


def taken_words(mixed: DataFrame, key: str = "doc_id", source: str = "source", size: str = "size") -> DataFrame:
    """One row per document: key, source, size, source_size, target, taken."""
    words_taken = F.when(F.col("shard").isNotNull(), F.col("to") - F.col("from")).otherwise(0)
    return (
        mixed.groupBy(source, "row_no", key, size, "source_size", "target").agg(F.sum(words_taken).alias("taken")).select(key, source, size, "source_size", "target", "taken")
    )


#: White space and the word after it; white space after the last word.
PART = r"(?s)[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"


def texts(docs: DataFrame, mixed: DataFrame, key: str = "doc_id", text: str = "text", size: str = "size") -> DataFrame:
    """The documents that the mix takes, once for each epoch, with the words that it takes, in their order.

    A document of which all is taken keeps its text as it is.  `mixed` must have the hash of the text in `text_hash`.
    Rows with the same key and text are taken from one of them.
    """
    spans = (
        mixed.filter("shard is not null and to > from")
        .groupBy(key, "text_hash", "row_no", "epoch", size)
        .agg(F.array_sort(F.collect_list(F.struct("from", "to"))).alias("__spans"), F.sum(F.col("to") - F.col("from")).alias("__n"))
        .withColumnsRenamed({key: "__key", "text_hash": "__hash"})
        .drop("row_no", "epoch")
    )
    one = docs.withColumn("__h", F.xxhash64(text)).dropDuplicates([key, "__h"])
    joined = one.join(spans, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__h") == F.col("__hash")))
    parts = F.regexp_extract_all(F.col(text), F.lit(PART), F.lit(0))
    cut = F.array_join(F.flatten(F.transform("__spans", lambda s: F.slice("__parts", (s["from"] + 1).cast("int"), (s["to"] - s["from"]).cast("int")))), "")
    whole = F.col("__n") == F.col(size)
    return (
        joined.withColumn("__parts", F.when(~whole, parts))
        .withColumn(text, F.when(whole, F.col(text)).otherwise(F.ltrim(cut)))
        .drop("__h", "__key", "__hash", "__spans", "__n", "__parts", *([size] if size not in docs.columns else []))
    )
