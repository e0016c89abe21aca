"""op2's runs where shared tokens are so common that nodes get small only at depth 5."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tidemark.llm import pathjoin

PAIRS = 12_000


def missed(links) -> int:
    top = list(range(2 * PAIRS))

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for a, b in links.collect():
        top[find(a)] = find(b)
    return sum(find(2 * k) != find(2 * k + 1) for k in range(PAIRS))


def test_pairs_in_deep_nodes_are_found(spark, monkeypatch):
    # Nodes of more sets than this go on, as in a table of many more sets.
    monkeypatch.setattr(pathjoin, "BRUTE", 128)

    def of(u, part):
        """Tokens of four values; sets 2k and 2k + 1 agree in about 0.8 of them."""
        own = np.random.default_rng([part, u // 2])
        base, changed, other = own.integers(0, 4, 64), own.random(64) > 0.8, own.integers(1, 4, 64)
        return ((base + (changed * other if u % 2 else 0)) % 4).astype(np.uint32).tobytes()

    def signed(batches):
        for batch in batches:
            rows = [(u, p) for u, low, high in zip(*(c.to_pylist() for c in batch.columns), strict=True) for p in range(low, high)]
            yield pa.RecordBatch.from_arrays([pa.array([u for u, _ in rows], pa.int64()), pa.array([p for _, p in rows], pa.int32()), pa.array([of(u, p) for u, p in rows], pa.binary())], names=["u", "part", "sig"])

    more = lambda df: df.select("u", "low", "high").mapInArrow(signed, "u long, part int, sig binary")
    sets = more(spark.range(2 * PAIRS).select(F.col("id").alias("u"), F.lit(0).alias("low"), F.lit(1).alias("high"))).cache()
    first, deep = pathjoin._walk(sets.withColumn("c", F.col("u")), 0.8, pathjoin.runs_for(0.99999, 0.8), 0)
    assert deep is not None and missed(first) > 5
    assert missed(pathjoin.candidates(sets, 0.8, 0.99999, more)) <= 1
