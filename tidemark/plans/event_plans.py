"""Queries over news events and headlines."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import events, text
from tidemark.plans.registry import query
from tidemark.sources import views

TIER = " ".join(f"WHEN {k} THEN {v}" for k, v in events.TIERS.items())
CAP = " ".join(f"WHEN '{k}' THEN {v[3]}" for k, v in events.CLASSES.items())
NEWS = f"""WITH n AS (SELECT event_id, ts, event_type AS event_class, CASE user_id % 3 WHEN 0 THEN 'hawkish' WHEN 1 THEN 'dovish' ELSE 'neutral' END AS direction, (event_id % 5 + 1)::INT AS tier, least(value / 100, 1.0) AS confidence, event_id % 50 = 0 AS is_override FROM events),
i AS (SELECT *, CASE tier {TIER} ELSE 0.25 END * confidence * CASE direction WHEN 'hawkish' THEN 1 WHEN 'dovish' THEN -1 ELSE 0 END AS raw, CASE event_class {CAP} ELSE 0.5 END AS cap FROM n),
m AS (SELECT *, floor(greatest(-cap, least(cap, raw)) * 1e4 + 0.5) / 1e4 AS impulse FROM i)"""


@query("os1_impulse", f"{NEWS} SELECT event_id, event_class, impulse FROM m", ["impulse"], ())
def impulse(spark, sf):
    return views.news(spark, sf).select("event_id", "event_class", events.impulse().alias("impulse"))


CLASS_RATES = ", ".join(f"('{k}', {math.log(2) / v[0]!r}::DOUBLE, {math.log(2) / v[1]!r}::DOUBLE, {v[2]}::DOUBLE)" for k, v in events.CLASSES.items())


@query("os2_os3_decayed_score", f"""{NEWS}, p(class, lf, ls, wf) AS (VALUES {CLASS_RATES}), e AS (SELECT ts, impulse, is_override, lf, ls, wf FROM m JOIN p ON class = CASE WHEN event_class IN ({', '.join(repr(k) for k in events.CLASSES)}) THEN event_class ELSE 'noise' END WHERE impulse <> 0),
d AS (SELECT unnest(generate_series(min(ts)::DATE, max(ts)::DATE + 10, INTERVAL 1 DAY))::DATE AS dt FROM events),
s AS (SELECT dt, coalesce(sum(impulse * (wf * exp(-lf * x) + (1 - wf) * exp(-ls * x))), 0) AS score, coalesce(bool_or(is_override AND exp(-ls * x) > 0.2), false) AS forced FROM (SELECT dt, e.*, epoch_us(dt::TIMESTAMP) / 86400e6 - epoch_us(ts) / 86400e6 AS x FROM d LEFT JOIN e ON ts < dt) GROUP BY dt)
SELECT dt, score, abs(score) > 2.0 OR forced AS is_crisis FROM s""", ["score"])  # fmt: skip
def decayed(spark, sf):
    """OS2, OS3, JN11: the theta join of events and later days, as recurrences by class; overrides force a crisis."""
    n = views.news(spark, sf)
    days = n.agg(F.to_date(F.min("ts")).alias("a"), F.date_add(F.to_date(F.max("ts")), 10).alias("z")).select(F.explode(F.sequence("a", "z")).alias("dt"))
    return events.decayed_score(days, n)


@query("os4_dedupe", """WITH RECURSIVE e AS (SELECT event_id, ts, user_id % 20 AS k, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS rn FROM events),
w AS (SELECT event_id, ts, k, rn, ts AS last, true AS keep FROM e WHERE rn = 1 UNION ALL
  SELECT e.event_id, e.ts, e.k, e.rn, CASE WHEN e.ts - w.last >= INTERVAL 6 HOUR THEN e.ts ELSE w.last END, e.ts - w.last >= INTERVAL 6 HOUR FROM w JOIN e ON e.k = w.k AND e.rn = w.rn + 1)
SELECT event_id, k FROM w WHERE keep""", (), ())  # fmt: skip
def dedupe(spark, sf):
    e = views.table(spark, sf, "events").withColumn("k", F.col("user_id") % 20)
    return events.dedupe(e, F.col("k"), "event_id", "ts").select("event_id", "k")


@query("sm1_ohlc_from_ticks", """SELECT event_type AS series_id, time_bucket(INTERVAL 30 MINUTE, ts)::VARCHAR AS bucket, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY ALL""", ["open", "high", "low", "close"], ())
def ohlc(spark, sf):
    """SM1 in batch: the same aggregate serves a stream with a watermark (tidemark.streaming)."""
    from tidemark.streaming.jobs import ohlc_bars

    return ohlc_bars(views.ticks(spark, sf)).withColumn("bucket", F.date_format("bucket", "yyyy-MM-dd HH:mm:ss"))


@query("tx2_shouty", r"""SELECT doc_id, length(regexp_replace(text, '[^\p{L}]', '', 'g'))::BIGINT AS letters, length(regexp_replace(text, '[^\p{L}]', '', 'g')) >= 10 AND length(regexp_replace(text, '[^\p{Lu}]', '', 'g')) > 0.8 * length(regexp_replace(text, '[^\p{L}]', '', 'g')) AS shouty FROM documents""", (), ())
def shouty(spark, sf):
    letters = text.letters(F.col("text"))
    return views.table(spark, sf, "documents").select("doc_id", F.length(letters).cast("long").alias("letters"), text.shouty(F.col("text")).alias("shouty"))


@query("tx7_filing_log", "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS seq, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = count(*) OVER (PARTITION BY conv_id) AS is_last FROM conversations WHERE trim(text) <> ''", (), ())
def filing(spark, sf):
    """TX7: gapless sequence numbers per log, empty submissions rejected."""
    w = W.partitionBy("conv_id").orderBy("turn")
    c = views.table(spark, sf, "conversations").filter(F.trim("text") != "")
    return c.select("conv_id", "turn", "role", F.row_number().over(w).alias("seq"), F.lead("turn").over(w).isNull().alias("is_last"))


@query("ag17_tag_tally", "SELECT coalesce(nullif(lang, ''), '-') AS tag, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest([lang, source]) AS lang FROM documents) GROUP BY ALL", (), ())
def tally(spark, sf):
    d = views.table(spark, sf, "documents").select("doc_id", F.explode(F.array_distinct(F.array("lang", "source"))).alias("tag"))
    return d.groupBy(F.coalesce(F.nullif("tag", F.lit("")), F.lit("-")).alias("tag")).agg(F.countDistinct("doc_id").alias("n"))


@query("src6_nested_json", "SELECT event_id, (props::JSON->>'k')::INT AS k FROM events", (), ())
def nested(spark, sf):
    return views.table(spark, sf, "events").select("event_id", F.from_json("props", "k INT")["k"].alias("k"))
