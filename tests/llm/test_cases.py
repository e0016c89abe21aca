"""Nulls, ties, repeated rows, clashing names, empty tables and sizes beyond the usual, operator by operator."""

from __future__ import annotations

import math
import re
import time
import tracemalloc
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import capfilter, decontam, graph, licenses, linecrf, mixing, pathjoin, ppm, sharding, urlrules

SOLID = re.compile(r"[^\x20\x09-\x0D]+")


def test_components_of_chains_and_stars(spark):
    ids = spark.range(400)
    chain = lambda place: ids.filter("id < 399").select(place(F.col("id")).alias("a"), place(F.col("id") + 1).alias("b"))
    up, down = chain(lambda c: c), chain(lambda c: 1000 - c)
    zigzag = chain(lambda c: c * 171 % 400 + 2000)
    star = spark.range(3000, 8000).select(F.lit(5000).cast("long").alias("a"), F.col("id").alias("b"))
    edges = up.union(down).union(zigzag).union(star)
    for most in (graph.EDGES, 300, 0):
        found = graph.components(edges, most)
        got = {r.component: r["count"] for r in found.groupBy("component").count().collect()}
        # The numbers 601 to 1000 of the second chain are none of the first.
        assert got == {0: 400, 601: 400, 2000: 400, 3000: 5000} and found.filter("component > node").count() == 0
    assert graph.components(edges.limit(0)).count() == graph.components(edges.filter("a = b"), 0).count() == 0


def test_embeddings_in_a_long_chain_and_repeated_ids(spark):
    turn = [math.radians(22.5 * k) for k in range(16)]
    x = np.zeros((200, 220))
    for k in range(200):
        # Each is at 22.5 degrees to the next and at more to all others.
        x[k, k] = math.cos(turn[1]) if k else 1.0
    base = np.zeros(220)
    base[0] = 1
    vectors = [base]
    for k in range(1, 200):
        v = np.zeros(220)
        v[k] = math.sin(turn[1])
        vectors.append(math.cos(turn[1]) * vectors[-1] + v)
    x = np.stack(vectors)
    rows = [(k, [float(c) for c in v]) for k, v in enumerate(x)] + [(7, [0.0] * 219 + [1.0]), (7, [0.0] * 219 + [1.0]), (None, [1.0, 0.0]), (300, [2.0, 0.0]), (301, [0.0, 3.0])]
    got = capfilter.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("u", F.lit(1)).withColumn("d", F.lit("x"))).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(200, dtype=bool)
    mine = {r.vec_id: r for r in got if r.vec_id not in (7, None, 300, 301)}
    assert all(r.n_links == near[k].sum() and r.component_id == 0 for k, r in mine.items())
    # Two more vectors have the id 7: they link with each other, and not with the chain.
    assert sorted((r.n_links, r.component_id, r.kept) for r in got if r.vec_id == 7) == [(1, 7, True), (1, 7, True), (int(near[7].sum()), 0, False)]
    assert [(r.n_links, r.component_id, r.kept) for r in got if r.vec_id in (None, 300, 301)] and {r.vec_id: r.component_id for r in got}[300] == 300


def test_embeddings_of_a_hot_filter_by_join(spark, monkeypatch):
    monkeypatch.setattr(capfilter, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(9)
    x = rng.standard_normal((1, 12)) + 0.15 * rng.standard_normal((70, 12))
    x[60:] = rng.standard_normal((10, 12))
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilter.link(spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), block=8).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= 0.9) & ~np.eye(70, dtype=bool)
    low = np.arange(70)
    for _ in range(70):
        low = np.minimum(low, np.where(near, low, 70).min(axis=1))
    assert got == {i: (int(near[i].sum()), int(low[i])) for i in range(70)}


def test_filters_of_ten_billion_vectors_have_numbers():
    words, cap, number = capfilter.codes_for(10**10, 128, 0.9, 48, 32, 1e-5)
    assert capfilter.number_kind(words, number) is (np.int64 if number * words**2 >= 1 << 31 else np.int32)
    assert capfilter.number_kind(60_000, 2) is np.int64
    code = capfilter.Codes(8, 50_000, 0.8, 2, 0)
    found = code.decode(np.random.default_rng(0).standard_normal((3, 8)) / 2)
    assert all(f.dtype == np.int64 and (np.diff(f) > 0).all() and (f >= 0).all() and (f < 2 * 50_000**2).all() for f in found)


def brute_ppm(rows, order):
    """What PPM (method C, exclusion) and the unigram base say of each text."""
    train = [t for k, t in rows if k is not None and zlib.crc32(str(k).encode()) % 7 != 2]
    counts = [{} for _ in range(order + 1)]
    for t in train:
        s = [257] * order + [*(t or "").encode(), 256]
        for p in range(order, len(s)):
            for k in range(order + 1):
                c = counts[k].setdefault(tuple(s[p - k : p]), {})
                c[s[p]] = c.get(s[p], 0) + 1
    words = lambda t: [*SOLID.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), None]
    unigrams: dict = {}
    for t in train:
        for w in words(t):
            unigrams[w] = unigrams.get(w, 0) + 1
    n, v = sum(unigrams.values()), len(unigrams)
    out = []
    for key, t in rows:
        s, total = [257] * order + [*(t or "").encode(), 256], 0.0
        for p in range(order, len(s)):
            gone = set()
            for k in range(order, -1, -1):
                c = {a: m for a, m in counts[k].get(tuple(s[p - k : p]), {}).items() if a not in gone}
                if s[p] in c:
                    total += math.log10(c[s[p]] / (sum(c.values()) + len(c)))
                    break
                if c:
                    total += math.log10(len(c) / (sum(c.values()) + len(c)))
                    gone |= set(c)
            else:
                total -= math.log10(257 - len(gone))
        w = words(t)
        out.append((key, len(w), sum(x in unigrams for x in w), n, sum(math.log10((unigrams.get(x, 0) + 1) / (n + v + 1)) for x in w), total))
    return out


@pytest.mark.parametrize("hot", [1 << 20, 6, 2])
def test_ppm_at_order_five_and_however_hot_contexts_are_dealt(spark, hot, monkeypatch):
    monkeypatch.setattr(ppm.gram_scores, "__defaults__", (ppm.ORDER, hot))
    rng = np.random.default_rng(4)
    voc = ["the", "then", "than", "a", "an", "and", "sand", "Éclair", "x1"]
    rows = [(i, " ".join(rng.choice(voc, rng.integers(1, 60)))) for i in range(40)] + [(50, None), (51, ""), (None, "the sand"), (3, "the the"), (52, "zzz ÿ \n the")]
    frame = spark.createDataFrame([(*r, "clash", 1.0) for r in rows], "doc_id long, text string, batch string, score double")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    got = ppm.score(frame, F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) != 2, batch_bytes=1 << 10).collect()
    assert spark.conf.get(conf) == before
    key = lambda r: (str(r[0]), round(r[5], 6))
    want = sorted(brute_ppm(rows, 5), key=key)
    mine = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=key)
    assert [m[:4] for m in mine] == [w[:4] for w in want]
    assert np.allclose([m[4:] for m in mine], [w[4:] for w in want], atol=1e-6)


def test_mix_keeps_other_columns_and_replaces_its_own(spark):
    rows = [(i, ["a", "b", "c"][i % 3], (i * 37) % 90, "x", -1) for i in range(300)] + [(1, None, 5, "x", -1)] * 2
    clash = spark.createDataFrame(rows, "doc_id long, source string, size long, target string, shard long").withColumn("note", F.lit("n")).withColumn("block", F.lit(0.5))
    plain = clash.select("doc_id", "source", "size")
    listed = lambda df: sorted((tuple(r) for r in mixing.taken_words(mixing.mix(df)).collect()), key=str)
    assert listed(clash) == listed(plain)
    assert mixing.mix(clash).columns.count("target") == 1 and "note" in mixing.mix(clash).columns
    with pytest.raises(ValueError):
        mixing.mix(plain.withColumnRenamed("doc_id", "shard"), key="shard")


def test_sums_before_go_over_runs(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RUN", 4)
    df = spark.range(50).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"), (F.col("id") * 7 % 11).alias("v"))
    rows = df.collect()
    for by in (["k"], []):
        got = {(r.k, r.o): r.s for r in mixing.sum_before(df, by, "o", "v", "s").collect()}
        assert got == {(r.k, r.o): sum(q.v for q in rows if q.o < r.o and (not by or q.k == r.k)) for r in rows}


def test_shards_replace_columns_of_their_names(spark):
    df = spark.createDataFrame([(1, "a", 9), (1, "a", 9), (None, "b", 9), (2, None, 9)], "doc_id long, text string, shard int").withColumn("slot", F.lit("old"))
    got = sharding.with_slots(sharding.assign(df, "doc_id", [1.0, 1.0, 2.0]), "doc_id", ["text"])
    assert got.columns.count("shard") == got.columns.count("slot") == 1 and got.schema["slot"].dataType.simpleString() == "bigint"
    assert got.filter("shard between 0 and 2").count() == 4
    assert sharding.with_slots(sharding.assign(df.limit(0), "doc_id", [1.0]), "doc_id").count() == 0
    with pytest.raises(ValueError):
        sharding.assign(df, "doc_id", [1.0], "doc_id")


def test_url_rules_on_an_empty_table_and_without_rules(spark):
    df = spark.createDataFrame([], "page_id long, url string, rule string")
    rules = [urlrules.Rule("block", "x.org", "/")]
    assert all(urlrules.judge(df, r, inline=n).count() == 0 for r in (rules, []) for n in (0, 9))


def test_decontaminate_clashes_repeats_and_common_windows(spark):
    common = " ".join(f"c{k}" for k in range(13))
    bench = spark.createDataFrame([(f"i{k}", f"{common} own{k}") for k in range(300)] + [("i1", common), (None, "alone here")], "item_id string, text string")
    docs = spark.createDataFrame([(1, f"x {common.upper()} y", "h", 3), (1, f"x {common.upper()} y", "h", 3), (2, "Alone, HERE!", "h", 3), (3, None, "h", 3)], "doc_id long, text string, hits string, n_words int")
    for most in (1 << 20, 64):
        got = decontam.find(docs, bench, block_bytes=most).collect()
        assert sorted((r.doc_id, r.n_words, len(r["items"]), len(r.hits)) for r in got) == [(1, 15, 300, 1), (1, 15, 300, 1), (2, 2, 1, 1), (3, 0, 0, 0)]
    # A window that ends inside a word of the text is none.
    near = spark.createDataFrame([(1, common + "0")], "doc_id long, text string")
    assert decontam.find(near, bench.filter("item_id = 'i1'")).filter("size(hits) > 0").count() == 0
    cut = decontam.find(docs, bench, cut=True).filter("doc_id = 1").first()
    assert cut.text == "x  y"
    assert decontam.find(docs, bench.limit(0)).filter("size(hits) > 0").count() == 0


LICENSED = {
    "MIT": lambda t: "# " + t["MIT"][2].replace(". ", ".\n# ").replace(", ", ",\n# ") + "\n\nint main() { return 0; }\n" + "code_line(x, y);\n" * 30,
    "Apache-2.0": lambda t: "/*\n * " + re.sub(r"(\S+ \S+ \S+ \S+ \S+ \S+) ", r"\1\n * ", t["Apache-2.0"][3].replace("\n\n", "\n *\n * ")) + "\n */\nclass A {}\n",
    "GPL-3.0": lambda t: "\n".join("// " + x for x in re.sub(r"(.{40,60}) ", r"\1\n", t["GPL-3.0"][3]).split("\n")) + "\n\nfn main() {}\n",
    "BSD-3-Clause": lambda t: "Copyright 2020 A. Person\n\n" + re.sub(r"(.{50,70}) ", r"\1\n", t["BSD-3-Clause"][3]),
    "CC-BY-SA-4.0": lambda t: "text\nSPDX-License-Identifier: CC-BY-SA-4.0\nmore",
}


def test_licences_of_wrapped_headers_whole_files_and_deep_trees(spark):
    texts = licenses.standard()
    rows = [(k, name, make(texts), f"r/{k}/x/y/file.c") for k, (name, make) in enumerate(LICENSED.items())]
    rows += [(10, "MIT", "plain words", "r/0/x/y/deep/er/a.c"), (11, None, "plain words", "r/9/a.c"), (12, None, None, "r/0/b.c"), (13, None, "", None), (14, None, "word " * 50_000, "q/long.c")]
    rows += [(15, "MIT", "plain words", "r/0/x/y/b.c"), (15, "MIT", "plain words", "r/0/x/y/b.c"), (16, "Proprietary", "All rights reserved.", "r/0/x/y/deep/LICENSE"), (17, "Proprietary", "x", "r/0/x/y/deep/q.c")]
    rows[5] = (10, "Proprietary", "plain words", "r/0/x/y/deep/er/a.c")
    frame = spark.createDataFrame(rows, "doc_id long, want string, text string, path string").withColumn("license", F.lit("old")).withColumn("score", F.lit("old"))
    got = licenses.scan(frame).collect()
    assert len(got) == len(rows) and all(r.license == r.want for r in got), [(r.doc_id, r.want, r.license, r.score) for r in got if r.license != r.want]
    assert {r.doc_id: r.origin_dir for r in got}[10] == "r/0/x/y/deep" and {r.origin for r in got if r.doc_id == 15} == {"inherited"}
    assert licenses.scan(frame.limit(0)).count() == 0


def test_tokens_that_a_unit_needs_are_needed():
    """No text reaches the least cosine that either filter passes over."""
    rng = np.random.default_rng(6)
    model = licenses.Templates(licenses.standard())
    cue, names = re.compile(rf"(?<![a-z0-9]){licenses.any_of(model.cues)}(?![a-z0-9])"), list(model.unit)
    assert all(cue.fullmatch(w) for w in model.cues)
    for _ in range(400):
        k = names[rng.integers(len(names))]
        words = [w for w in licenses.tokens(licenses.standard()[k[0]][k[1]]) if rng.random() < 0.75] + ["zzz"] * int(rng.integers(0, 3))
        v = {w: words.count(w) * model.idf.get(w, model.rare) for w in set(words)}
        norm = math.sqrt(sum(x * x for x in v.values())) or 1
        if max(sum(x * u.get(w, 0) for w, x in v.items()) for u in model.unit.values()) / norm >= licenses.LEAST:
            assert cue.search(" ".join(words)) and any(len(set(words) & set(t)) >= most for t, most in model.needs)
            mine, enough = sum(x * x for w, x in v.items() if w in model.idf), (licenses.LEAST * 0.999) ** 2
            assert mine * (1 - enough) >= enough * model.rare**2 * len(set(words) - set(model.idf))


def test_jaccard_groups_over_blocks_and_joined_keys(spark, monkeypatch):
    monkeypatch.setattr(pathjoin, "BLOCK", 8)
    monkeypatch.setattr(pathjoin, "BROADCAST_ROWS", 0)
    rng = np.random.default_rng(8)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(60):
        w = list(base)
        w[int(rng.integers(120))] = f"own{i}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"v{rng.integers(10**6)}" for _ in range(30))) for i in range(20)] + [(5, rows[5][1]), (None, rows[6][1])]
    sets = [{tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for _, t in rows]
    want = []
    for i, a in enumerate(sets):
        links = [j for j, b in enumerate(sets) if i != j and len(a & b) >= 0.8 * len(a | b)]
        want.append((rows[i][0], 0 if links else rows[i][0], len(links)))
    got = pathjoin.join(spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, u int, sig int")).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("inline", [0, 5000])
def test_url_rules_keep_columns_whose_names_clash(spark, inline):
    rules = [urlrules.Rule("block", "example.com", "/a/"), urlrules.Rule("allow", "www.example.com", "/a/b/"), urlrules.Rule("block", "org", "")]
    clash = ["size", "pattern", "token", "__token", "__row", "__at", "__a", "at", "row"]
    rows = [(1, "https://example.com/a/x"), (2, "https://www.example.com/a/b/c"), (3, None), (4, "http://x.org"), (4, "http://x.org"), (5, "nothing")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.concat(F.lit(c), F.col("page_id")) for c in [*clash, "rule", "host"]})
    out = urlrules.judge(df, rules, inline=inline)
    assert sorted(out.columns) == sorted(["page_id", "url", *clash, "host", "path", "rule", "verdict"])
    got = sorted((r.page_id, r.verdict, r.rule) for r in out.collect())
    assert got == [(1, "block", "example.com/a/"), (2, "allow", "www.example.com/a/b/"), (3, "allow", None), (4, "block", "org"), (4, "block", "org"), (5, "allow", None)]
    assert all(r[c] == f"{c}{r.page_id}" for r in out.collect() for c in clash)


#: Whole licences as distributions ship them, and what they are.
WHOLE = {"Apache-2.0": "Apache-2.0", "BSD": "BSD-3-Clause", "CC0-1.0": "CC0-1.0", "GPL-2": "GPL-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "LGPL-3": "LGPL-3.0", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not all(Path("/usr/share/common-licenses", n).exists() for n in WHOLE), reason="no whole licences here")
def test_whole_licence_files_are_inherited(spark):
    rows = []
    for n in WHOLE:
        text = Path("/usr/share/common-licenses", n).read_text()
        rows += [(f"{n}/LICENSE", text), (f"{n}/src/a.py", "x = 1"), (f"{n}/README", "all about " + n)]
    rows += [("own/a.txt", "Copyright 2020 Foo.\nAll rights reserved."), ("own/b.txt", "plain"), ("prose/b.txt", "plain"), ("prose/long.md", "Released under the MIT License.\n" + "word " * 400)]
    got = {r.path: (r.license, r.origin) for r in licenses.scan(spark.createDataFrame([(k, t, p) for k, (p, t) in enumerate(rows)], "doc_id long, text string, path string")).collect()}
    for n, name in WHOLE.items():
        assert got[f"{n}/LICENSE"] == (name, "own") and got[f"{n}/src/a.py"] == got[f"{n}/README"] == (name, "inherited"), n
    assert got["own/a.txt"] == ("Proprietary", "own") and got["own/b.txt"] == (None, "none")
    assert got["prose/long.md"] == ("MIT", "own") and got["prose/b.txt"] == (None, "none")


def test_a_prompt_that_thousands_of_items_share_costs_as_one(spark):
    prompt = " ".join(f"shared{k}" for k in range(60))
    docs = pa.array([f"own {k} {prompt} end {k}" for k in range(200)])

    def took(items):
        block = decontam.Block(items, 13)
        began = time.perf_counter()
        _, spans, found = decontam._scan(block, docs)
        return time.perf_counter() - began, spans, found

    many = [(f"i{k}", f"{prompt} question number {k} of them") for k in range(2000)]
    one = min(took(many[:1])[0] for _ in range(3))
    all_, spans, found = min((took(many) for _ in range(3)), key=lambda x: x[0])
    assert all_ < 2 * one + 0.1
    assert all(s == [(2, 62)] for s in spans) and all(f == sorted(i for i, _ in many) for f in found)


def test_blocks_of_a_benchmark_find_what_one_block_finds(spark):
    rng = np.random.default_rng(2)
    word = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 400, n))
    items = [(f"i{k}", word(int(rng.integers(0, 40)))) for k in range(60)] + [("i1", word(20)), (None, word(15)), ("none", None)]
    texts = [f"{word(5)} {items[k % 60][1]} {word(3)} {items[(k * 7) % 60][1]}" for k in range(80)] + [None, "", items[3][1], items[3][1]]
    docs = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, h1 string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    whole = [decontam.find(docs, bench, block_bytes=n, cut=c) for n in (1 << 24, 300) for c in (False, True)]
    rows = [{r.doc_id: r for r in w.collect()} for w in whole]
    assert rows[0] == rows[2] and rows[1] == rows[3] and whole[2].columns == ["doc_id", "text", "h1", "n_words", "hits", "items"]
    assert any(r["items"] for r in rows[0].values()) and rows[0][80]["n_words"] == 0


def test_the_fit_of_a_full_sample_is_bounded():
    rng = np.random.default_rng(0)
    n, docs = linecrf.ALL_LINES, linecrf.SAMPLE
    x = linecrf.Lines(rng.random((n, 21)), np.ones(n), np.arange(docs + 1) * (n // docs))
    tracemalloc.start()
    linecrf.Field(66).fit(x, rng.integers(0, 2, docs), steps=2)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most + x.shape.nbytes + 88 * n < 1e9


def test_the_fit_takes_inputs_of_neighbours(spark):
    rng = np.random.default_rng(1)
    x = linecrf.Lines(rng.random((50, 21)), np.ones(50), np.array([0, 1, 4, 20, 50]))
    y = np.array([0, 1, 0, 1])
    field = linecrf.Field(66).fit(x, y, steps=40)
    # The same steps, on all inputs at once.
    z, slow = linecrf.inputs(x), linecrf.Field(66)
    label, weight = np.repeat(y, np.diff(x.at)).astype(float), np.repeat(1 / np.sqrt(np.diff(x.at)), np.diff(x.at))
    weight /= weight.sum()
    inner = np.setdiff1d(np.arange(50), x.at[1:] - 1)
    wanted, m1, m2 = np.zeros((2, 2)), np.zeros(70), np.zeros(70)
    np.add.at(wanted, (label[inner].astype(int), label[inner + 1].astype(int)), weight[inner])
    sig = lambda v: 1 / (1 + np.exp(-v))
    for k in range(1, 41):
        e = z @ slow.w
        p, left, right = slow.marginals(e, x.at)
        s, r, m = sig(left[inner]), sig(e[inner + 1] + right[inner + 1]), np.exp(slow.t)
        joint = np.stack([(1 - s) * m[0, 0] * (1 - r), (1 - s) * m[0, 1] * r, s * m[1, 0] * (1 - r), s * m[1, 1] * r])
        got = (joint / joint.sum(0) * weight[inner]).sum(1).reshape(2, 2)
        g = np.concatenate([z.T @ (weight * (label - p)) - 1e-4 * slow.w, (wanted - got - 1e-4 * slow.t).ravel()])
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        step = 0.1 * (m1 / (1 - 0.9**k)) / (np.sqrt(m2 / (1 - 0.999**k)) + 1e-9)
        slow.w, slow.t = slow.w + step[:-4], slow.t + step[-4:].reshape(2, 2)
    assert np.allclose(field.w, slow.w, atol=1e-6) and np.allclose(field.t, slow.t, atol=1e-6)
