"""Filter audit against sets of Python, with nulls, repeats, ties and clashing columns."""

from __future__ import annotations

import random
import re
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F

from tidemark.llm import filteraudit as A


def brute(docs: list[tuple], labels: list[tuple]) -> dict:
    """Rows by (part, order, step)."""
    texts = [(i, t or "", p or "") for i, t, p in docs]
    fails = {c: set() for c in "ABCDE"}
    for r, (i, t, _) in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        checks = (len(words) < 100, 100 * len(set(words)) < 80 * len(words), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(t == u and j is not None and j < i for j, u, _ in texts))
        for c, bad in zip("ABCDE", checks, strict=True):
            fails[c] |= {r} if bad else set()
    good, toxic = ({i for i, *flags in labels if flags[k] == 1 and i is not None} for k in range(2))
    out = {}
    for part in {p for *_, p in texts}:
        own = {r for r in range(len(texts)) if texts[r][2] == part}
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(own)
            for step, c in enumerate(order, 1):
                gone = left & fails[c]
                left -= gone
                total[c] += len(gone)
                others = set().union(*(fails[x] for x in "ABCDE" if x != c))
                out[part, "".join(order), step] = [len(left), len(gone), len((own & fails[c]) - gone), len((own & fails[c]) - others), sum(texts[r][0] in good for r in gone), sum(texts[r][0] in toxic for r in gone)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(total[order[step - 1]])
    return out


def rows_of(spark, docs: list[tuple], labels: list[tuple]) -> dict:
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumns({c: F.lit(1) for c in ("part", "mask", "n", "good", "filter")})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("range", F.lit(2))
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")] for r in A.audit(df, marks).collect()}


def test_audit_equals_sets(spark):
    rng = random.Random(5)
    words = [*("w%d" % k for k in range(150)), "Öl", "BIG", "LOUD", "#tag", "a|b"]
    texts = [" ".join(rng.choices(words[: rng.choice([20, 150, 155])], k=rng.choice([0, 3, 99, 100, 130, 160]))) for _ in range(60)] + [None, "", " \t", "ÄÖ ABC", "x" * 20000]
    docs = [(rng.randrange(-300, 900), rng.choice(texts), rng.choice(["en", "de", None, ""])) for _ in range(300)]
    docs += [(None, texts[0], "en"), (None, None, "de"), (7, texts[3], "en"), (7, texts[3], "en"), (7, texts[3], "de"), (7, texts[4], "en")]
    labels = [(rng.choice(docs)[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(150)] + [(7, 1, 1), (7, 0, None), (10**9, 1, 1), (None, 1, 1)]
    assert rows_of(spark, docs, labels) == brute(docs, labels)


def test_audit_of_nothing_and_of_one_group_of_copies(spark):
    assert rows_of(spark, [], [(1, 1, 1)]) == {}
    docs = [(k, "same text", "en") for k in range(3000)]
    got = rows_of(spark, docs, [])
    assert got["en", "EABCD", 1][:2] == [1, 2999] and got["en", "AEBCD", 2][:3] == [0, 0, 2999]
    assert len(got) == 600


def test_merges_of_sorted_lists():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a, b = (np.unique(rng.integers(0, 50, rng.integers(0, 40))) for _ in range(2))
        assert A.union(a, b).tolist() == np.union1d(a, b).tolist()
        assert A.minus(a, b).tolist() == np.setdiff1d(a, b).tolist()
        assert A.common(a, b).tolist() == np.intersect1d(a, b).tolist()
