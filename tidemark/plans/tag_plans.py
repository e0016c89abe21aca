"""Queries over tagged headlines, their filing log, and nested idea logs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import tags
from tidemark.plans.registry import query
from tidemark.sources.views import table

#: Codes, and country codes and names of currencies with what they stand for, that headlines are made of.
_CODES = [c for c in tags.CODES if c != "CNH"]
_COUNTRIES = ["GB", "JN", "EC", "SZ", "BZ", "CH", "KO"]
_NAMES = {"Cable": "GBP", "yen": "JPY", "loonie": "CAD", "kiwi": "NZD", "aussie": "AUD", "rupee": "INR", "baht": "THB"}
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
_EVENTS = f"""c AS (SELECT event_id, ts, user_id, event_type, event_id % 6 AS form, {_list(_CODES)} AS codes, user_id % 7 + 1 AS pick FROM events),
k AS (SELECT *, codes[1 + user_id % {len(_CODES)}] AS a, codes[1 + (user_id + 7) % {len(_CODES)}] AS z, {_list(_COUNTRIES)}[pick] AS country, {_list(tags.COUNTRIES[c] for c in _COUNTRIES)}[pick] AS of_country, {_list(_NAMES)}[pick] AS word, {_list(_NAMES.values())}[pick] AS of_word FROM c),
h AS (SELECT event_id, ts, user_id, CASE form WHEN 0 THEN a || '/' || z || ' ' || event_type || ' steady' WHEN 1 THEN a || z || ' holds after a ' || event_type WHEN 2 THEN 'the ' || a || ' on a ' || event_type WHEN 3 THEN '{{' || country || '}} notes on a ' || event_type
  WHEN 4 THEN word || ' bid after the ' || event_type ELSE 'nothing but a ' || event_type END AS text, CASE form WHEN 0 THEN a || ',' || z WHEN 1 THEN a || ',' || z WHEN 2 THEN a WHEN 3 THEN of_country WHEN 4 THEN of_word ELSE '' END AS tags FROM k)"""


def headlines(spark, sf):
    """event_id, ts, user_id, text: a headline in one of six forms about the currencies that the event's user trades."""
    pick = lambda xs, at: F.get(F.array(*map(F.lit, xs)), at.cast("int"))
    user, form, what = F.col("user_id"), F.col("event_id") % 6, F.col("event_type")
    a, z = pick(_CODES, user % len(_CODES)), pick(_CODES, (user + 7) % len(_CODES))
    text = (
        F.when(form == 0, F.concat(a, F.lit("/"), z, F.lit(" "), what, F.lit(" steady"))).when(form == 1, F.concat(a, z, F.lit(" holds after a "), what)).when(form == 2, F.concat(F.lit("the "), a, F.lit(" on a "), what))
        .when(form == 3, F.concat(F.lit("{"), pick(_COUNTRIES, user % 7), F.lit("} notes on a "), what)).when(form == 4, F.concat(pick(list(_NAMES), user % 7), F.lit(" bid after the "), what)).otherwise(F.concat(F.lit("nothing but a "), what))
    )
    return table(spark, sf, "events").select("event_id", "ts", "user_id", text.alias("text"))


@query("tx1_currency_tags", f"WITH {_EVENTS} SELECT event_id, text, tags, nullif(split_part(tags, ',', 1), '') AS first_tag FROM h", (), ())
def currency_tags(spark, sf):
    """TX1: the ordered currency tags of each headline; the golden cases are in the tests."""
    found = headlines(spark, sf).withColumn("found", tags.currencies(F.col("text")))
    return found.select("event_id", "text", F.array_join("found", ",").alias("tags"), F.get("found", F.lit(0)).alias("first_tag"))


@query("tx1_tag_counts", f"WITH {_EVENTS}, x AS (SELECT user_id % 10 AS desk, ts, event_id, unnest(string_split(tags, ',')) AS tag FROM h WHERE tags <> '') SELECT desk, tag, count(*) AS n, arg_max(event_id, (ts, event_id)) AS latest FROM x GROUP BY ALL", (), ())
def tag_counts(spark, sf):
    """TX1, TX5: how often each desk files a currency, and its latest filing."""
    rows = headlines(spark, sf).select((F.col("user_id") % 10).alias("desk"), "ts", "event_id", F.explode(tags.currencies(F.col("text"))).alias("tag"))
    return rows.groupBy("desk", "tag").agg(F.count(F.lit(1)).alias("n"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("tx11_idea_log", """WITH e AS (SELECT o_orderkey AS log, o_orderdate::DATE AS dt, o_orderkey * 2 + i AS id, CASE WHEN (o_custkey + i) % 3 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN i = 0 THEN o_orderpriority ELSE o_orderstatus END AS tag
  FROM orders CROSS JOIN (VALUES (0), (1)) v(i)) SELECT dt, id, status, tag FROM e WHERE status = 'open' AND tag IN ('1-URGENT', 'O')""", ())  # fmt: skip
def idea_log(spark, sf):
    """TX11: open ideas with a tag, from nested logs."""
    entry = lambda i: F.struct((F.col("o_orderkey") * 2 + i).alias("id"), F.when((F.col("o_custkey") + i) % 3 == 0, "closed").otherwise("open").alias("status"), F.array("o_orderpriority" if i == 0 else "o_orderstatus").alias("tags"))
    logs = table(spark, sf, "orders").select(F.array(F.struct(F.to_date("o_orderdate").alias("dt"), F.array(entry(0), entry(1)).alias("entries"))).alias("log"))
    held = [tags.ideas(logs, "log", {"status": "open"}, tag) for tag in ("1-urgent", "o")]
    return held[0].unionByName(held[1]).select("dt", "id", "status", F.col("tags")[0].alias("tag"))


@query("sm5_filing_log", f"""WITH {_EVENTS}, d AS (SELECT *, ts::DATE AS dt FROM h) SELECT event_id, dt, tags, row_number() OVER (PARTITION BY user_id, dt ORDER BY ts, event_id) AS seq, count(*) OVER (PARTITION BY user_id, dt) AS filed FROM d""", ())
def filing_log(spark, sf):
    """SM5, TX7: each user's filings of a day in sequence, tagged."""
    h = headlines(spark, sf).withColumn("dt", F.to_date("ts")).withColumn("tags", F.array_join(tags.currencies(F.col("text")), ","))
    of = W.partitionBy("user_id", "dt")
    return h.select("event_id", "dt", "tags", F.row_number().over(of.orderBy("ts", "event_id")).alias("seq"), F.count(F.lit(1)).over(of).alias("filed"))
