"""Periodic runs against all periods and places, and op13 against its contract."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import periods as P
from tidemark.llm import queries as Q


def brute(words: list, least: int = 24, times: int = 3) -> list[tuple[int, int, int]]:
    """start, length and smallest period of every run."""
    found: dict[tuple[int, int], int] = {}
    n = len(words)
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def runs_of(words: list) -> list[tuple[int, int, int]]:
    ids = {w: k for k, w in enumerate(dict.fromkeys(words))}
    return [(s, e - s, t) for s, e, t in P.find_runs(np.array([*(ids[w] for w in words), len(ids)]), len(words), 24, 3)]


def periodic(rng: random.Random) -> list:
    out = []
    for _ in range(rng.randrange(1, 5)):
        root = rng.choices("ab" if rng.random() < 0.5 else "abcdefgh", k=rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 33, 64]))
        if rng.random() < 0.4:
            inner = rng.choices("abc", k=rng.randrange(1, 4))
            root = inner * rng.randrange(1, 12) + root
        out += rng.choices("abx", k=rng.randrange(4)) + (root * 6)[: int(len(root) * rng.uniform(1, 6))]
        if rng.random() < 0.5:
            out += ["c"] * rng.randrange(40)
    return out[: rng.randrange(len(out) + 1)] if rng.random() < 0.3 else out


def test_runs_equal_brute_force():
    rng = random.Random(3)
    for _ in range(1500):
        words = periodic(rng)
        assert runs_of(words) == brute(words), words
    fib = ["a", "ab"]
    while len(fib[-1]) < 700:
        fib.append(fib[-1] + fib[-2])
    for words in (fib[-1], "a" * 3000, "ab" * 500 + "b" + "ab" * 500, ("a" * 40 + "b") * 30, ("ab" * 20 + "c") * 9, "x" * 23, "x" * 24, "", "abcdefgh" * 3, "abcdefghi" * 3, "abcdefghi" * 3 + "x", "abcdefghi" * 2 + "abcdefgh"):
        assert runs_of(list(words)) == brute(list(words))


def test_work_stays_small_where_all_words_are_equal():
    n = 200_000
    assert runs_of(["w"] * n) == [(0, n, 1)]
    got = runs_of((["w"] * 500 + ["v"]) * 300)
    assert (0, 501 * 300, 501) in got and len(got) == 301


def test_wavelet_and_suffixes():
    rng = np.random.default_rng(4)
    v = rng.permutation(777)
    tree = P.Wavelet(v, 777)
    lo = rng.integers(0, 777, 300)
    hi = np.minimum(777, lo + rng.integers(1, 200, 300))
    x = rng.integers(0, 2000, 300)
    assert tree.below(lo, hi, x).tolist() == [int((v[a:b] < c).sum()) for a, b, c in zip(lo, hi, x, strict=True)]
    k = (rng.random(300) * (hi - lo)).astype(np.int64)
    assert tree.nth(lo, hi, k).tolist() == [int(np.sort(v[a:b])[c]) for a, b, c in zip(lo, hi, k, strict=True)]
    s = [*rng.integers(0, 3, 500).tolist(), 9]
    sa, _ = P.suffixes(np.array(s), 500)
    assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def contract(docs: list[tuple]) -> list[tuple]:
    out = []
    for i, text in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n = len(words)
        if i is not None and n and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[k] if k < a else words[a + (k - a) % p] for k in range(n)]
        runs = brute(words)
        dead = {k for s, m, q in runs for k in range(s + q, s + m)}
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        lines = "".join(f"{s},{m},{q}\n" for s, m, q in sorted(runs, key=lambda r: (r[0], r[2])))
        out.append((i, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha(lines), sha(" ".join(w for k, w in enumerate(words) if k not in dead))))
    return sorted(out, key=str)


def test_query_follows_the_contract(spark, tmp_path):
    rng = random.Random(8)
    texts = [" ".join(periodic(rng)) for _ in range(40)] + [None, "", " \t\r", "one", "ö 😀 " * 30, "a\tb\n" * 20 + "\x0b", "w" * 50000, "A a " * 100, "\x1f   " * 40]
    docs = [(k, rng.choice(texts)) for k in range(400)] + [(None, "a " * 50), (3, "b " * 30), (3, "b " * 30), (-7, "c " * 31)]
    spark.createDataFrame(docs, "doc_id long, text string").withColumn("runs", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted((tuple(r) for r in Q.op13_periodic_runs(spark, str(tmp_path)).collect()), key=str) == contract(docs)


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([("x y " * 20, 1, 2)], "text string, runs int, extra int")
    row = P.collapse(df).first()
    assert (row["extra"], row["n_words"], row["collapsed"], [tuple(r) for r in row["runs"]]) == (2, 40, "x y", [(0, 40, 2)])
    assert P.collapse(df.limit(0)).collect() == []
    with pytest.raises(ValueError, match="24 words"):
        P.collapse(df, least=10)
