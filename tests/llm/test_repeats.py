"""Repeated bytes against brute force: every string of n bytes, by its smallest document."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import repeats as R


def brute(docs: list[tuple], n: int = 50) -> list[tuple]:
    raw = [(i, (t or "").encode()) for i, t in docs]
    low: dict[bytes, int] = {}
    for i, x in raw:
        for p in range(len(x) - n + 1):
            if i is not None:
                low[x[p : p + n]] = min(i, low.get(x[p : p + n], i))
    out = []
    for i, x in raw:
        dead = np.zeros(len(x), bool)
        for p in range(len(x) - n + 1):
            if i is not None and low[x[p : p + n]] < i:
                dead[p : p + n] = True
        spans = int(dead[:1].sum() + (dead[1:] & ~dead[:-1]).sum())
        out.append((i, len(x), int(dead.sum()), spans, bytes(np.frombuffer(x, np.uint8)[~dead])))
    return sorted(out, key=str)


def found(spark, docs: list[tuple], n: int = 50, hot: int | None = None) -> list[tuple]:
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({c: F.lit("x") for c in ("doc", "kept", "whole", "want", "rank")})
    out = R.remove(df, n=n, hot=hot)
    assert {"doc", "whole", "want", "rank"} <= set(out.columns) and len(set(out.columns)) == len(out.columns)
    return sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in out.collect()), key=str)


def corpus(seed: int) -> list[tuple]:
    rng = random.Random(seed)
    piece = lambda: "".join(rng.choices("ab" if rng.random() < 0.2 else "abcdefgh ö€😀", k=rng.randrange(30, 120)))
    pool = [piece() for _ in range(12)] + ["a" * 130, "ab" * 60, "abc " * 40, "x" * 49, "y" * 50, "z" * 51]
    docs = []
    for _ in range(120):
        text = "".join(rng.choice(pool) if rng.random() < 0.6 else piece() for _ in range(rng.randrange(0, 6)))
        if rng.random() < 0.3 and docs:
            text = rng.choice(docs)[1] or ""
            at = rng.randrange(len(text) + 1)
            text = text[:at] + rng.choice(["", "Q", "Ü"]) + text[at + rng.randrange(2) :]
        docs.append((rng.randrange(-50, 2000), text))
    docs += [(None, docs[0][1]), (None, docs[0][1]), (5, None), (6, ""), (7, pool[0] * 3), (7, pool[0] * 3), (7, pool[1]), (10**15, "ä" * 5000)]
    return docs


@pytest.mark.parametrize(("seed", "hot"), [(1, None), (2, 3), (3, 40)])
def test_removed_bytes_equal_brute_force(spark, seed, hot):
    docs = corpus(seed)
    assert found(spark, docs, hot=hot) == brute(docs)


@pytest.mark.parametrize("n", [48, 63, 78])
def test_other_lengths(spark, n):
    docs = corpus(n)[:60]
    assert found(spark, docs, n=n) == brute(docs, n)


def test_empty_tables_and_bounds(spark):
    assert found(spark, []) == []
    assert found(spark, [(1, None), (2, "short")]) == brute([(1, None), (2, "short")])
    with pytest.raises(ValueError, match="48 to 78"):
        R.find(spark.createDataFrame([(1, "a")], "doc_id long, text string"), n=20)


def test_hot_passage_in_unlike_documents(spark):
    rng = random.Random(9)
    common = "this passage of more than fifty bytes stands in every one of the documents, "
    docs = [(k, "".join(rng.choices("klmnop", k=40)) + common + "".join(rng.choices("klmnop", k=40))) for k in range(400)]
    for hot in (None, 20):
        assert found(spark, docs, hot=hot) == brute(docs)
