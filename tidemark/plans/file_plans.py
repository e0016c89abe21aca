"""Queries that write what they have read, as files or through streams, and give what is read back."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.operators import events, rolling
from tidemark.plans import sqltext as S
from tidemark.plans.event_plans import NEWS
from tidemark.plans.registry import query
from tidemark.plans.series_plans import B, _walk, bars
from tidemark.sources import readers, sinks, views
from tidemark.sources.scratch import folder
from tidemark.sources.views import table
from tidemark.streaming import jobs

_BARS = ["open", "high", "low", "close", "volume"]


@query("src1_snk1_parquet_cache", f"{B} SELECT series_id, dt, year(dt)::INT AS y, {', '.join(_BARS)} FROM b", _BARS)
def parquet_cache(spark, sf):
    """SRC1, SNK1: bars by year in Parquet, read back with their schema."""
    b = views.bars(spark, sf).select("series_id", "dt", *_BARS).withColumn("y", F.year("dt"))
    sinks.parquet(b, path := folder(spark), by=["y"])
    return readers.parquet(spark, path, b.schema, ["series_id", "dt", *_BARS])


@query("src2_snk2_csv", f"{B} SELECT series_id, dt, close, CASE WHEN rn % 10 > 0 THEN iv END AS iv, NULL::DOUBLE AS skew FROM b", ["close", "iv"])
def csv(spark, sf):
    """SRC2, SNK2: a CSV with numbers that don't parse and an optional column that isn't there."""
    b = bars(spark, sf)
    raw = b.select("series_id", "dt", "close", F.when(F.col("rn") % 10 == 0, "n/a").otherwise(F.col("iv").cast("string")).alias("iv"))
    sinks.csv(raw, path := folder(spark))
    return readers.csv(spark, path, {"series_id": "string", "dt": "date", "close": "double", "iv": "double"}, {"skew": "double"})


@query("src3_event_log", f"{NEWS} SELECT strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_class, direction, tier, confidence, is_override, impulse, length('Line ' || event_id::VARCHAR || ', \"quoted\"')::INT AS headline_length FROM m WHERE event_id % 17 > 0", ["confidence", "impulse"], ())
def event_log(spark, sf):
    """SRC3: a log of events in CSV with quoted headlines, typed, with the impulse of each; events without a time are left out."""
    n = views.news(spark, sf).withColumn("headline", F.concat(F.lit("Line "), F.col("event_id").cast("string"), F.lit(', "quoted"')))
    n = n.withColumn("ts", F.when(F.col("event_id") % 17 > 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).otherwise("soon"))
    n.select("ts", "headline", "event_class", "direction", "tier", "confidence", "is_override").write.csv(path := folder(spark), header=True, quote='"', escape='"')
    log = readers.event_log(spark, path).withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return log.select("ts", "event_class", "direction", "tier", "confidence", "is_override", "impulse", F.length("headline").alias("headline_length"))


@query("snk3_json_snapshot", """WITH t AS (SELECT c_nationkey AS k, sum(o_totalprice) AS total, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT k, total, n, (SELECT count(*) FROM t) AS records, 'orders' AS source, 'sum of prices' AS total_means FROM t""", ["total"], ())
def json_snapshot(spark, sf):
    """SNK3: records in JSON with one header of metadata, legend and count."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k"))
    t = table(spark, sf, "orders").join(c, "o_custkey").groupBy("k").agg(F.sum("o_totalprice").alias("total"), F.count(F.lit(1)).alias("n"))
    sinks.json_snapshot(t, path := folder(spark), {"source": "orders"}, {"total": "sum of prices", "n": "orders"})
    head = spark.read.schema("metadata struct<source:string>, legend map<string,string>, records long").json(f"{path}/header")
    rows = spark.read.schema(t.schema).json(f"{path}/records").withColumn("one", F.lit(1))
    return rows.join(F.broadcast(head.withColumn("one", F.lit(1))), "one").select("k", "total", "n", "records", F.col("metadata.source").alias("source"), F.col("legend")["total"].alias("total_means"))


@query("snk4_day_report", """WITH e AS (SELECT conv_id % 10 AS day, coalesce(upper(nullif(role, '')), 'GENERAL') AS grp, conv_id * 100 + turn AS seq FROM conversations), l AS (SELECT day, '- ' || seq::VARCHAR AS line FROM e UNION ALL SELECT DISTINCT day, '## ' || grp FROM e)
SELECT day::INT AS day, line FROM l""", (), ())  # fmt: skip
def day_report(spark, sf):
    """SNK4: a report for each day, entries under their group's heading, read back as text."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("day"), F.nullif("role", F.lit("")).alias("role"), (F.col("conv_id") * 100 + F.col("turn")).alias("seq"))
    sinks.day_report(c.withColumn("text", F.col("seq").cast("string")), path := folder(spark), "day", "role", "seq", "text")
    return spark.read.text(path).select(F.col("day").cast("int").alias("day"), F.col("value").alias("line"))


def streamed(spark, rows, job, schema=None, batches=()):
    """What a streaming job makes of rows that come as files, once it has taken all there are; `batches`: conditions on the rows of one micro-batch after the other."""
    path = folder(spark)
    for part in batches or (F.lit(True),):
        (rows.filter(part).coalesce(1) if batches else rows).write.mode("append").parquet(f"{path}/in")
    reader = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1) if batches else spark.readStream.schema(rows.schema)
    out = job(reader.parquet(f"{path}/in"))
    run = out.writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start(f"{path}/out")
    run.awaitTermination()
    return spark.read.schema(schema or out.schema).parquet(f"{path}/out")


@query("sm1_streamed_bars", """WITH g AS (SELECT event_type AS series_id, time_bucket(INTERVAL 30 MINUTE, ts) AS b, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY ALL)
SELECT series_id, b::VARCHAR AS bucket, open, high, low, close, n FROM g WHERE b + INTERVAL 30 MINUTE <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""", ["open", "high", "low", "close"], ())  # fmt: skip
def streamed_bars(spark, sf):
    """SM1: bars of a stream, given once the watermark has passed them."""
    got = streamed(spark, views.ticks(spark, sf), jobs.ohlc_bars)
    return got.withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


@query("sm2_streamed_dedupe", """WITH RECURSIVE e AS (SELECT event_id, ts, user_id % 20 AS k, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS rn FROM events),
w AS (SELECT event_id, ts, k, rn, ts AS last, true AS keep FROM e WHERE rn = 1 UNION ALL
  SELECT e.event_id, e.ts, e.k, e.rn, CASE WHEN e.ts - w.last >= INTERVAL 6 HOUR THEN e.ts ELSE w.last END, e.ts - w.last >= INTERVAL 6 HOUR FROM w JOIN e ON e.k = w.k AND e.rn = w.rn + 1)
SELECT event_id, k FROM w WHERE keep""", (), ())  # fmt: skip
def streamed_dedupe(spark, sf):
    """SM2: the dedupe of OS4 over a stream of four micro-batches; its watermark lies behind all events, so none is late."""
    e = table(spark, sf, "events").select((F.col("user_id") % 20).alias("k"), "ts", "event_id")
    top = e.agg(F.max("event_id")).first()[0]
    cuts = [(F.col("event_id") > top * k / 4) & (F.col("event_id") <= top * (k + 1) / 4) if k else F.col("event_id") <= top / 4 for k in range(4)]
    return streamed(spark, e, lambda s: jobs.kept_apart(s, "k", "event_id", late="400 days"), batches=cuts).select("event_id", "k")


@query("sm5_streamed_filings", """WITH c AS (SELECT conv_id, turn, text, conv_id % 10 AS day, conv_id * 1000 + turn AS ord FROM conversations), h AS (SELECT max(conv_id) * 500 AS cut FROM conversations),
f AS (SELECT *, day IN (3, 7) AND ord > cut AS late FROM c, h WHERE trim(text, ' ') <> '' AND (NOT (day IN (3, 7) AND ord > cut) OR day = 7 OR turn % 2 = 1))
SELECT conv_id, turn, day, row_number() OVER (PARTITION BY day ORDER BY ord) AS seq, CASE WHEN late THEN 'closed' ELSE 'open' END AS status, late FROM f""", (), ())  # fmt: skip
def streamed_filings(spark, sf):
    """SM5, TX7: filings of a stream of four micro-batches; two days are closed half-way, one of them to all but forced filings."""
    c = table(spark, sf, "conversations").select((F.col("conv_id") % 10).alias("day"), (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("ord"), F.col("text").alias("raw"), F.lit("file").alias("kind"), (F.col("turn") % 2 == 1).alias("flag"))
    top = c.agg(F.max("ord")).first()[0] // 1000
    closing = spark.createDataFrame([(3, False), (7, True)], "day long, flag boolean").select("day", F.lit(top * 500).cast("long").alias("ord"), F.lit(None).cast("string").alias("raw"), F.lit("close").alias("kind"), "flag")
    every = c.withColumn("day", F.col("day").cast("long")).unionByName(closing)
    place = F.floor(F.col("ord") * 4 / ((top + 1) * 1000))
    got = streamed(spark, every, jobs.filing_log, batches=[place == k for k in range(4)])
    return got.select(F.floor(F.col("ord") / 1000).cast("long").alias("conv_id"), (F.col("ord") % 1000).cast("long").alias("turn"), "day", "seq", "status", "late")


@query("sm3_streamed_positions", _walk(S.z("close", 60, 30), 1.5, 0.5, -1), ["z"])
def streamed_positions(spark, sf):
    """SM3: the state of each series' position in a stream; the same as the windows give."""
    z = bars(spark, sf).select("series_id", "dt", rolling.zscore(F.col("close"), 60, 30).alias("z"))
    return streamed(spark, z, lambda s: jobs.positions(s, 1.5, 0.5))


_RATES = ", ".join(f"('{k}', {math.log(2) / v[0]!r}::DOUBLE, {math.log(2) / v[1]!r}::DOUBLE, {v[2]}::DOUBLE)" for k, v in events.CLASSES.items())


@query("sm4_streamed_totals", f"""{NEWS}, p(class, lf, ls, wf) AS (VALUES {_RATES}), e AS (SELECT event_class, ts, impulse, lf, ls, wf FROM m JOIN p ON class = CASE WHEN event_class IN ({', '.join(repr(k) for k in events.CLASSES)}) THEN event_class ELSE 'noise' END)
SELECT a.event_class, strftime(a.ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, sum(b.impulse * (b.wf * exp(-b.lf * (epoch_us(a.ts) - epoch_us(b.ts)) / 86400e6) + (1 - b.wf) * exp(-b.ls * (epoch_us(a.ts) - epoch_us(b.ts)) / 86400e6))) AS score FROM e a JOIN e b ON b.event_class = a.event_class AND b.ts <= a.ts GROUP BY ALL""", ["score"], ())  # fmt: skip
def streamed_totals(spark, sf):
    """SM4: the decayed total of each class after each event, from two sums and a time."""
    n = views.news(spark, sf).select("event_class", "ts", events.impulse().alias("imp"))
    n.write.parquet(f"{(path := folder(spark))}/in")
    stream = spark.readStream.schema(n.schema).parquet(f"{path}/in").writeStream.foreachBatch(jobs.totals_of_batches(path))
    stream.option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema("event_class string, ts timestamp, score double").parquet(f"{path}/totals").drop("n")
    return got.withColumn("ts", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


@query("src6_json_documents", "SELECT conv_id // 5 AS day, turn, conv_id, length(text)::INT AS n FROM conversations", (), ())
def json_documents(spark, sf):
    """SRC6: documents of a day with an array of entries, as rows."""
    c = table(spark, sf, "conversations").select(F.floor(F.col("conv_id") / 5).alias("day"), "conv_id", "turn", F.length("text").alias("n"))
    days = c.groupBy("day").agg(F.collect_list(F.struct("conv_id", "turn", "n")).alias("entries"))
    days.write.json(path := folder(spark))
    return readers.json_documents(spark, path, days.schema, "entries", one_each=False).select("day", "turn", "conv_id", "n")


@query("src5_located_header", "SELECT o_orderkey::VARCHAR AS n, o_totalprice AS debit, o_orderdate::DATE AS day FROM orders", ["debit"], ("day",))
def located_header(spark, sf):
    """SRC5: a sheet whose heading stands below a title and a note, found by its keywords."""
    o = table(spark, sf, "orders")
    rows = o.select((F.col("o_orderkey") + 10).alias("row"), F.array(F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("string")).alias("cells"))
    top = spark.createDataFrame([(1, ["Margin statistics", None, None]), (2, [None, "debit", None]), (3, ["Year-Month", "Row Number", "Debit Balances in Accounts"])], "row long, cells array<string>")
    t = readers.located_header(top.unionByName(rows), "row", "cells", {"day": ("month",), "n": ("row",), "debit": ("debit", "balance")})
    return t.select("n", F.expr("try_cast(debit AS double)").alias("debit"), F.to_date("day").alias("day"))


@query("pr18_costs", f"""{B}, c AS (SELECT series_id, dt, abs(volume - lag(volume) {S.W}) / 100 AS lots, close FROM b) SELECT series_id, dt, lots * 0.85::DOUBLE AS fee, lots * close * 0.0005::DOUBLE / 2 AS half_spread, 2 * (lots * 0.85::DOUBLE + lots * close * 0.0005::DOUBLE / 2) AS round_trip FROM c""", ["fee", "half_spread", "round_trip"])
def costs(spark, sf):
    """PR18: fees a side, half the spread, and both ways, of the lots that change hands."""
    lots = F.abs(F.col("volume") - rolling.lag(F.col("volume"))) / 100
    fee, half = lots * 0.85, lots * F.col("close") * 0.0005 / 2
    return views.bars(spark, sf).select("series_id", "dt", fee.alias("fee"), half.alias("half_spread"), (2 * (fee + half)).alias("round_trip"))
