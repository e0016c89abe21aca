"""Workers take whole texts in pieces of bounded size, whatever the batch holds."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import decontam, linecrf, pathjoin
from tidemark.llm import textbytes as B


def texts(n, words, seed=3):
    rng = random.Random(seed)
    known = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(500)]
    return [None if k % 97 == 5 else "\n".join(" ".join(rng.choices(known, k=words // 4)) for _ in range(4)) for k in range(n)]


class Frame:
    """Stands for a DataFrame of one column of texts: keeps the function given to mapInArrow."""

    def __init__(self, spark):
        self.sparkSession, self.columns, self.calls = spark, ["text"], []

    def drop(self, *_):
        return self

    def withColumn(self, *_):
        return self

    withColumns = select = withColumn
    schema = None

    def mapInArrow(self, f, _):
        self.calls.append(f)
        return self


@pytest.fixture(scope="module")
def batch():
    # About 6 MB.
    return pa.RecordBatch.from_arrays([pa.array(texts(1500, 700))], names=["text"])


def passes(spark, batch):
    """Of each operator that texts pass through: its function, over one batch."""
    item = batch.column(0)[0].as_py().split("\n")[1]
    bench = spark.createDataFrame([("b1", item)], "item_id string, text string")
    field = linecrf.Field(66)
    field.w += np.random.default_rng(1).normal(size=66) / 10
    scan, rate = Frame(spark), Frame(spark)
    decontam.find(scan, bench)
    linecrf.score(rate, field)
    return {"find": scan.calls[0], "score": rate.calls[0]}


def test_texts_pass_in_pieces(spark, batch, monkeypatch):
    assert batch.nbytes > 5 << 20
    for name, f in passes(spark, batch).items():
        list(f(iter([batch.slice(0, 1)])))
        monkeypatch.setattr(B, "_powers", {})
        tracemalloc.start()
        got = []
        for out in f(iter([batch])):
            got.append((out.num_rows, out.column(0).slice(0).nbytes))
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        # All rows come, in batches of a piece; numpy's arrays never hold those of more.
        assert sum(n for n, _ in got) == batch.num_rows, name
        assert max(size for _, size in got) < 1 << 20, name
        assert most < 48 << 20, (name, most)


def test_pieces_change_nothing(spark, batch, monkeypatch):
    whole, part = {}, {}
    for size, into in ((1 << 24, whole), (1 << 16, part)):
        monkeypatch.setattr(B, "PIECE", size)
        monkeypatch.setattr(B.slices, "__defaults__", (size,))
        for name, f in passes(spark, batch).items():
            into[name] = pa.Table.from_batches(list(f(iter([batch.slice(0, 400)]))))
    assert whole["find"].equals(part["find"]) and any(x.as_py() for x in whole["find"].column("items"))
    assert whole["score"].column("text").equals(part["score"].column("text"))
    assert np.allclose(whole["score"].column("score").to_numpy(), part["score"].column("score").to_numpy(), rtol=0, atol=1e-12)


def test_near_copies_across_pieces(spark, batch, monkeypatch):
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(batch.column(0).slice(0, 60).to_pylist() * 2)], "doc_id long, text string").coalesce(1)
    got = []
    for size in (1 << 24, 1 << 14):
        monkeypatch.setattr(B, "PIECE", size)
        got.append(sorted(map(tuple, pathjoin.join(docs).collect())))
    assert got[0] == got[1] and sum(r[3] for r in got[0]) == 61
