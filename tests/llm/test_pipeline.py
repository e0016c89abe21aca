"""The stages of the pipeline, each on its own input, against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P
from tidemark.llm import linecrf, mixing, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SOLID = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
low = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    out = []
    for i in range(60):
        out.append((i, "\n".join(prose(rng, 14).capitalize() + "." for _ in range(4)), "en", ["web", "books", None][i % 3], 1))
    for i in range(60, 90):
        out.append((i, "\n".join(" | ".join(prose(rng, 12).upper().split()) + " !!!" for _ in range(3)), "en", "web", 1))
    base = out[5][1]
    near = base.replace(base.split()[20], "changed", 1)
    item = prose(rng, 30)
    out += [
        (100, base, "en", "web", 1), (101, near, "en", "books", 1), (102, near, "en", "books", 1), (102, out[9][1], "en", "books", 1), (102, prose(rng, 50), "de", "books", 1),
        (103, None, "en", "web", 0), (104, "", "en", "web", 0), (None, "a text without an id but with words", None, "web", 1),
        (105, f"{prose(rng, 40)} {item} {prose(rng, 30)}", "en", "web", 1), (106, f"{prose(rng, 900)} {item[:60]}", "en", "web", 1), (107, prose(rng, 9000), "fr", "books", 1),
    ]
    return out, item


@pytest.fixture(scope="module")
def folder(spark, rows, tmp_path_factory):
    top = str(tmp_path_factory.mktemp("tables"))
    docs, item = rows
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([("b1", item), ("b2", None), ("b3", "")], "item_id string, text string").write.parquet(f"{top}/benchmark.parquet")
    return top


def docs_of(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def listed(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_quality(spark, folder, rows):
    docs = docs_of(spark, folder)
    field = queries.quality_field(docs, spark.read.parquet(f"{folder}/labels.parquet"))

    def score(text):
        raw = (text or "").encode()
        x = linecrf.lines(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        e, n = linecrf.inputs(x) @ field.w, len(x.size)
        if n > 10:
            return None
        total, good = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            weight = math.exp(sum(e[k] * y[k] for k in range(n)) + sum(field.t[y[k], y[k + 1]] for k in range(n - 1)))
            total += weight
            good += weight * np.array(y)
        return float((good / total * (x.size + 1)).sum() / (x.size + 1).sum())

    kept = listed(P.quality(spark, docs, folder))
    want = [r for r in rows[0] if score(r[1]) >= queries.QUALITY]
    assert kept == sorted(want, key=str) and all((r in want) == (r[0] < 60) for r in rows[0][:90])


@pytest.mark.parametrize("broadcast", [P.BROADCAST_ROWS, 0])
def test_near_duplicates(spark, folder, rows, broadcast, monkeypatch):
    monkeypatch.setattr(P, "BROADCAST_ROWS", broadcast)
    sets = []
    for r in rows[0]:
        w = SOLID.findall(low(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    top = list(range(len(sets)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and len(a & b) >= 0.8 * len(a | b):
                top[find(i)] = find(j)
    classes = defaultdict(list)
    for i, r in enumerate(rows[0]):
        classes[find(i)].append(r)
    got = P.near_duplicates(spark, docs_of(spark, folder), folder)
    assert got.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    left = listed(got)
    assert len(left) == len(classes)
    for group in classes.values():
        least = min((r[0] for r in group if r[0] is not None), default=None)
        assert sum(r in left for r in {r for r in group if r[0] == least}) == 1
    # Repeated rows are one document, as tables of one row and of none are.
    twice = docs_of(spark, folder).filter("doc_id = 3")
    assert P.near_duplicates(spark, twice.union(twice), folder).count() == 1
    assert P.near_duplicates(spark, twice.limit(0), folder).count() == 0


def test_decontaminate(spark, folder, rows):
    docs, item = rows
    x = ALNUM.findall(low(item))
    grams = {tuple(x[i : i + 13]) for i in range(len(x) - 12)}
    want = []
    for r in docs:
        w, hit = ALNUM.findall(low(r[1])), set()
        for i in range(len(w) - 12):
            if tuple(w[i : i + 13]) in grams:
                hit |= set(range(i, i + 13))
        if not (hit and 20 * len(hit) >= len(w)):
            want.append(r)
    got = listed(P.clean_of_benchmarks(spark, docs_of(spark, folder), folder))
    assert got == sorted(want, key=str) and len(want) == len(docs) - 1


def test_mix(spark, folder, rows):
    docs = docs_of(spark, folder)
    sizes = docs.select("doc_id", "source", F.xxhash64("text").alias("text_hash"), mixing.words(F.col("text")).alias("size"))
    taken = defaultdict(int)
    for r in mixing.taken_words(mixing.mix(sizes)).collect():
        taken[r.doc_id] += r.taken
    got = P.mix(spark, docs, folder)
    assert got.columns == docs.columns
    words, texts = defaultdict(int), defaultdict(list)
    for r in rows[0]:
        texts[r[0]].append(" " + " ".join(SOLID.findall(r[1] or "")) + " ")
    for r in got.collect():
        w = SOLID.findall(r.text)
        words[r.doc_id] += len(w)
        assert r.n_chars == len(r.text)
        # What is taken at one time is of whole words in their order: one run, or the two ends of a text.
        assert any(all(f" {x} " in t for x in set(w)) for t in texts[r.doc_id])
    assert dict(words) == {k: n for k, n in taken.items() if n}
    assert listed(P.mix(spark, docs, folder)) == listed(got)


def test_shard(spark, folder, rows):
    unit = lambda t: (int(hashlib.md5(t.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    got = P.shard(spark, docs_of(spark, folder), folder)
    slots = defaultdict(list)
    for r in got.collect():
        k = "" if r.doc_id is None else str(r.doc_id)
        assert r.shard == max(range(queries.SHARDS), key=lambda s: -1 / math.log(unit(f"{k}#{s}")))
        slots[r.shard].append(r.slot)
    assert got.count() == len(rows[0]) and all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_run_applies_the_stages_in_turn(spark, folder):
    docs = docs_of(spark, folder)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, folder)
    assert listed(P.run(spark, folder)) == listed(docs)
    assert [k for k, _ in P.STAGES] == ["quality", "near_duplicates", "decontaminate", "mix", "shard"]


def test_shards_of_op8(spark, folder, rows):
    """op8's columns from zlib and hashlib."""
    unit = lambda t: (int(hashlib.md5(t.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
    place = lambda k, n: max(range(n), key=lambda s: -1 / math.log(unit(f"{k}#{s}")))
    got = queries.op8_rendezvous_shards(spark, folder).collect()
    want = []
    for i, t, *_ in rows[0]:
        k, raw = "" if i is None else str(i), None if t is None else t.encode()
        want.append((i, len(raw or b"") + 8, None if raw is None else zlib.crc32(raw), "key", place(k, 24), place(k, 25)))
    assert sorted(((r.doc_id, r.size, r.text_crc32, r.law, r.shard, r.grown_shard) for r in got), key=str) == sorted(want, key=str)
    assert all(r.grown_shard in (r.shard, 24) for r in got)
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
