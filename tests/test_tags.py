"""Currency tags against the golden cases, idea logs, decayed totals of a stream."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import tags
from tidemark.streaming import jobs

# Texts and their tags, the primary one first.
CASES = (
    ("the bulls won the session", ""), ("TRY TO KEEP POWDER DRY", ""), ("EUR/USD", "EUR,USD"), ("USDJPY heavy, dollar offered", "USD,JPY"), ("{BZ} Brazil", "BRL"), ("{GB} GDP data due", "GBP"), ("{JN} JPY article", "JPY"),
    ("Cable is bid this morning", "GBP"), ("The BoJ kept rates unchanged", "JPY"), ("real money was a buyer", ""), ("MXN peso weakened", "MXN"), ("MPC decision awaited", ""), ("BI held rates steady", "IDR"),
    ("bi-weekly CPI due Thursday", ""), ("bi held rates steady", ""), ("£ higher against the dollar", "USD,GBP"), ("USDCNH held in a tight range", "USD,CNY"), ("EURCHF broke higher", "EUR,CHF"),
    ("Sterling extends gains, gilts rally", "GBP"), ("USD index steady", "USD"), ("just USD alone with no other evidence word", "USD"), ("COP started slightly weaker amid outflows", "COP"),
    ("PESO CRASHES AS COP HITS RECORD LOW", ""), ("PBOC injected liquidity, yuan steady", "CNY"), ("KOSPI rallied on Samsung earnings", "KRW"), ("{SA} ZAR view", "ZAR"), ("{CH} CNH update", "CHF,CNY"), ("no currency content here at all", ""),
)
MORE = [
    ("abc/USD-EUR", ["USD", "EUR"]), ("EUR/USD-JPY", ["EUR", "USD", "JPY"]), ("eurusd and gbp/chf", ["GBP", "CHF", "EUR", "USD"]), ("{xx} {us}", ["XX", "USD"]), ("try cad cop", []),
    ("CNH and CNY", ["CNY"]), ("CNH then JPY", ["JPY", "CNY"]), ("Bi held, bi-weekly BI", ["IDR"]), ("éUSD", []), (None, []), ("", []), ("BULLS TRY BUYING USD AND EUR NOW", ["USD", "EUR"]), ("word " * 3000 + "yen", ["JPY"]),
]


def test_currencies(spark):
    rows = [(t, list(w.split(",")) if w else []) for t, w in CASES] + MORE
    got = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "i int, t string").select("i", tags.currencies(F.col("t")).alias("tags")).collect()
    for r in got:
        assert r.tags == rows[r.i][1], rows[r.i][0]


def test_ideas(spark):
    kind = "log array<struct<date: string, entries: array<struct<id: int, status: string, tags: array<string>>>>>"
    logs = spark.createDataFrame([([("d1", [(1, "open", ["Eur", "carry"]), (2, "closed", ["EUR"])]), ("d2", [(3, "open", []), (4, "open", None)]), ("d3", None)],), (None,)], kind)
    assert sorted(r.id for r in tags.ideas(logs, "log").collect()) == [1, 2, 3, 4]
    assert [(r.date, r.id) for r in tags.ideas(logs, "log", {"status": "open"}, "eur").collect()] == [("d1", 1)]


def test_decayed_totals_equal_sums(spark, tmp_path):
    rows = spark.sql("SELECT c AS event_class, timestamp'2024-01-01' + make_dt_interval(0, 7 * i) AS ts, CAST(i % 3 - 1 AS DOUBLE) AS imp, i FROM range(12) t(i), (VALUES ('signup'), ('other')) v(c)")
    for n, part in enumerate((rows.filter("i < 5"), rows.filter("i >= 5"))):
        part.coalesce(1).write.parquet(str(tmp_path / f"in/p={n}"))
    stream = spark.readStream.schema("event_class string, ts timestamp, imp double, i long, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = jobs.decayed_totals(stream).writeStream.format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    for name, (fast, slow, weight) in {"signup": (0.5, 3.0, 0.7), "other": (0.25, 1.0, 0.8)}.items():
        got = [r.score for r in spark.table("totals").filter(F.col("event_class") == name).orderBy("ts").collect()]
        assert len(got) == 12
        for i, score in enumerate(got):
            want = sum((j % 3 - 1) * (weight * math.exp(-math.log(2) / fast * 7 * (i - j) / 24) + (1 - weight) * math.exp(-math.log(2) / slow * 7 * (i - j) / 24)) for j in range(i + 1))
            assert abs(score - want) < 1e-9
