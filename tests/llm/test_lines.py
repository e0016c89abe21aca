"""op10's templates against brute force, near the threshold too, and on both ways of dropping lines."""

from __future__ import annotations

import random
import re
from collections import defaultdict
from itertools import combinations

import pytest

from tidemark.llm import linedrop

SCHEMA = "doc_id long, text string"
SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(line):
    # Only A-Z are lower-cased, and a token with a digit is a variable.
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)
    return tuple("#" if re.search("[0-9]", t) else t for t in SOLID.findall(low))


def templates(f, alike, lead):
    """A line's templates, with None where a place is open: up to two pieces behind the leading tokens."""
    most = int(len(f) * (1 - alike) + 1e-9)
    size = max(1, most // 2)
    pieces = [range(i, min(len(f), i + size)) for i in range(lead, len(f), size)]
    for some in combinations(pieces, min(2, most, len(pieces))):
        if some:
            gone = {i for piece in some for i in piece}
            assert len(gone) <= most
            yield tuple(None if i in gone else t for i, t in enumerate(f))


def brute(texts, min_docs=5, long_docs=2, alike=0.7, lead=3):
    """Lines that recur, or a template of which does."""
    docs, of = defaultdict(set), defaultdict(set)
    for t in {t for t in texts if t is not None}:
        for line in t.split("\n"):
            f = tokens(line)
            if len(f) >= 4:
                docs[f].add(t)
                for g in templates(f, alike, lead):
                    of[g].add(t)
    enough = lambda f: long_docs if len(f) > 50 else min_docs
    return {f for f in docs if len(docs[f]) >= enough(f) or any(len(of[g]) >= enough(f) for g in templates(f, alike, lead))}


def expected(rows, **options):
    bad = brute([t for _, t in rows], **options)
    out = []
    for i, t in rows:
        lines = t.split("\n") if t is not None else []
        hit = [tokens(x) in bad for x in lines]
        left = None if t is None else "\n".join(x for x, h in zip(lines, hit, strict=True) if not h)
        out.append((i, left, len(lines), sum(hit), sum(len(SOLID.findall(x)) for x, h in zip(lines, hit, strict=True) if h)))
    return sorted(out, key=str)


def made(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    # Of ten tokens, one varies in each template, always the same one; other lines share the leading three only.
    kinds = [[word() for _ in range(10)] for _ in range(6)]
    rows = []
    for i in range(120):
        lines = []
        for _ in range(rng.randint(1, 5)):
            kind = rng.randrange(len(kinds))
            line = list(kinds[kind])
            roll = rng.random()
            if roll < 0.4:
                line[4 + kind] = word()
            elif roll < 0.7:
                line = line[:3] + [word() for _ in range(7)]
            elif roll < 0.8:
                line = [f"n{rng.randint(0, 999)}", *line[1:]]
            lines.append(" ".join(line))
        rows.append((i, "\n".join(lines)))
    long = " ".join(word() for _ in range(60))
    rows += [(200, f"{long}\nshort own line here"), (201, f"x\n{long}"), (202, None), (203, ""), (204, rows[0][1]), (205, "A B c 1\nA  b C 22"), (206, "\n\n"), (207, "é ü 1 2 3\n" * 4000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return made()


def test_lines_equal_brute_force(spark, rows):
    got = linedrop.drop(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_lines_by_join_equal_lines_by_broadcast(spark, rows, monkeypatch):
    monkeypatch.setattr(linedrop, "BROADCAST_ROWS", 0)
    frame = spark.createDataFrame([(i, t, "kept", 1.0) for i, t in rows], "doc_id long, text string, doc string, n_dropped double")
    got = linedrop.drop(frame)
    assert got.columns == ["doc_id", "text", "doc", "n_lines", "n_dropped", "words_dropped"]
    assert sorted((tuple(r) for r in got.drop("doc").collect()), key=str) == expected(rows)
    assert got.filter("doc <> 'kept'").count() == 0


@pytest.mark.parametrize("size", [4, 5, 7, 10, 13, 20, 60])
def test_lines_spread_around_the_threshold(spark, size):
    rng = random.Random(size)
    base = [[rng.choice("abcdefgh") * 3 for _ in range(size)] for _ in range(3)]
    rows = []
    for i in range(700):
        line = list(rng.choice(base))
        for place in rng.sample(range(3, size), min(size - 3, rng.randrange(0, int(size * 0.5) + 1))):
            line[place] = rng.choice("pqrstuv") * 2
        rows.append((i, " ".join(line) + f"\nof its own {rng.random()}"))
    got = sorted(map(tuple, linedrop.drop(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == expected(rows)
    rng.shuffle(rows)
    assert sorted(map(tuple, linedrop.drop(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()), key=str) == got


def test_many_unlike_lines_of_a_leaf(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5))
    unlike = [" ".join(["the", "same", "begin", *(word() for _ in range(7))]) for _ in range(60)]
    planted = "the same begin of a planted line with {} end".format
    rows = [(i, f"{t}\n{planted(word())}" if i % 10 == 0 else t) for i, t in enumerate(unlike)]
    got = linedrop.drop(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got), key=str) == expected(rows)


def test_ties_repeated_rows_and_empty_tables(spark):
    line = "one two three four five six"
    rows = [(i, f"{line}\n{chr(97 + i)}") for i in range(4)]
    frame = lambda r: spark.createDataFrame(r, SCHEMA)
    # Four documents are too few, and a repeated row makes no fifth.
    assert linedrop.drop(frame(rows + rows[:3])).filter("n_dropped > 0").count() == 0
    assert linedrop.drop(frame(rows + [(9, f"{line}\nz")])).filter("n_dropped = 1").count() == 5
    assert linedrop.drop(frame([])).count() == 0
