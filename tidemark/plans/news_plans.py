"""Queries over classified records, weekly reports of positions, and the digest and log of market texts."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import events, text
from tidemark.plans.event_plans import CAP, TIER
from tidemark.plans.registry import query
from tidemark.sources.views import table

# An answer for each event: some aren't JSON, some lack a field, some have a confidence out of range.
_JSON = """a AS (SELECT event_id, ts, CASE WHEN event_id % 11 = 0 THEN 'no json' WHEN event_id % 13 = 0 THEN '{"event_class": "' || event_type || '"}'
  ELSE '{"event_class": "' || event_type || '", "direction": "' || CASE user_id % 3 WHEN 0 THEN 'hawkish' WHEN 1 THEN 'dovish' ELSE 'neutral' END || '", "severity_tier": ' || (event_id % 6) || ', "confidence": ' || (event_id % 150) / 100.0 || ', "reasoning": "r"}' END AS answer FROM events)"""


def answers(spark, sf):
    e = table(spark, sf, "events")
    way = F.when(F.col("user_id") % 3 == 0, "hawkish").when(F.col("user_id") % 3 == 1, "dovish").otherwise("neutral")
    whole = F.format_string('{"event_class": "%s", "direction": "%s", "severity_tier": %d, "confidence": %s, "reasoning": "r"}', "event_type", way, F.col("event_id") % 6, ((F.col("event_id") % 150) / 100.0).cast("string"))
    text_ = F.when(F.col("event_id") % 11 == 0, "no json").when(F.col("event_id") % 13 == 0, F.format_string('{"event_class": "%s"}', "event_type")).otherwise(whole)
    return e.select("event_id", "ts", text_.alias("answer"))


@query("os5_classified_records", f"""WITH {_JSON}, j AS (SELECT event_id, CASE WHEN json_valid(answer) AND json_extract(answer, '$.confidence') IS NOT NULL THEN answer::JSON END AS j FROM a),
r AS (SELECT event_id, coalesce(j->>'event_class', 'noise') AS event_class, coalesce(j->>'direction', 'neutral') AS direction, coalesce((j->>'severity_tier')::INT, 1) AS tier, CASE WHEN j IS NULL THEN 0 ELSE greatest(0, least(1, (j->>'confidence')::DOUBLE)) END AS confidence FROM j),
i AS (SELECT *, CASE tier {TIER} ELSE 0.25 END * confidence * CASE direction WHEN 'hawkish' THEN 1 WHEN 'dovish' THEN -1 ELSE 0 END AS raw, CASE event_class {CAP} ELSE 0.5 END AS cap FROM r WHERE confidence >= 0.4)
SELECT event_id, event_class, direction, tier, confidence, floor(greatest(-cap, least(cap, raw)) * 1e4 + 0.5) / 1e4 AS impulse, event_class = 'error' AND tier >= 4 AS is_override FROM i""", ["confidence", "impulse"], ())  # fmt: skip
def classified(spark, sf):
    """OS5: answers with all their fields, confidences clamped; the rest is noise, and what is unsure goes."""
    r = events.classified(answers(spark, sf), "answer", overriding=("error",))
    return r.withColumn("impulse", events.impulse()).select("event_id", "event_class", "direction", "tier", "confidence", "impulse", "is_override")


@query("os6_net_positions", """SELECT dt, sum(long - short) AS net, sum(long - short) / nullif(sum(oi), 0) AS net_share FROM (SELECT date_trunc('week', l_shipdate)::DATE AS dt, upper(n_name) AS market, CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END AS long, CASE WHEN l_returnflag = 'A' THEN l_quantity ELSE 0 END AS short, CASE WHEN l_returnflag <> 'N' THEN l_quantity ELSE 0 END AS oi FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey) WHERE contains(market, '_1') GROUP BY dt""", ["net", "net_share"])
def net_positions(spark, sf):
    """OS6: reports of all markets whose name holds a fragment, summed by date; net over open interest, none where that is zero."""
    n = table(spark, sf, "nation").filter(F.upper("n_name").contains("_1")).select(F.col("n_nationkey").alias("s_nationkey"))
    s = table(spark, sf, "supplier").join(n, "s_nationkey", "left_semi").select(F.col("s_suppkey").alias("l_suppkey"))
    l = table(spark, sf, "lineitem").join(s, "l_suppkey", "left_semi")  # noqa: E741
    of = lambda *flags: F.sum(F.when(F.col("l_returnflag").isin(*flags), F.col("l_quantity")).otherwise(0.0))
    g = l.groupBy(F.to_date(F.date_trunc("week", "l_shipdate")).alias("dt")).agg(of("R").alias("long"), of("A").alias("short"), of("R", "A").alias("oi"))
    net = F.col("long") - F.col("short")
    return g.select("dt", net.alias("net"), (net / F.nullif(F.col("oi"), F.lit(0.0))).alias("net_share"))


_BUCKET = " ".join(f"WHEN {' OR '.join(f'contains(lower(s), {w!r})' for w in words)} THEN '{b}'" for b, words in text.BUCKETS.items())
_EDGES = "'^[ \\t\\r]+|[ \\t\\r]+$', '', 'g'"
_SENTENCES = r"""l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line, unnest(string_split(text, chr(10))) AS l FROM documents),
p AS (SELECT doc_id, line, CASE WHEN contains(l, '|') THEN [l] ELSE string_split(regexp_replace(l, '([.!?])[ \t]+([A-Z{])', '\1' || chr(1) || '\2', 'g'), chr(1)) END AS parts FROM l),
u AS (SELECT doc_id, line, generate_subscripts(parts, 1) AS k, unnest(parts) AS s FROM p),
s AS (SELECT doc_id, line, k, regexp_replace(regexp_replace(regexp_replace(regexp_replace(s, EDGES), '\{[A-Za-z^0-9]{1,3}\}', '', 'g'), '^[*\-•][ \t]*', ''), EDGES) AS s FROM u)""".replace("EDGES", _EDGES)


@query("tx3_tx4_digest", f"""WITH {_SENTENCES}, b AS (SELECT doc_id, s, min((line, k)) AS pos FROM s WHERE s <> '' GROUP BY ALL), c AS (SELECT doc_id, s, pos, CASE {_BUCKET} ELSE 'thesis' END AS bucket FROM b),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, bucket ORDER BY pos) AS n FROM c), h AS (SELECT DISTINCT doc_id, bucket FROM documents, (VALUES ('thesis'), ('economics'), ('flows'), ('price')) v(bucket)),
g AS (SELECT doc_id, bucket, count(*) AS n_sentences, md5(string_agg(CASE WHEN n <= 5 THEN '- ' || s END, chr(10) ORDER BY n)) AS digest FROM r GROUP BY ALL)
SELECT doc_id, bucket, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(digest, md5('- Nothing filed.')) AS digest_md5 FROM h LEFT JOIN g USING (doc_id, bucket)""", (), ())  # fmt: skip
def digest(spark, sf):
    """TX3, TX4: the first five different sentences of each section of a text, or that there are none."""
    d = table(spark, sf, "documents").select("doc_id", "text")
    return text.digest(d, "doc_id", "text").select("doc_id", "bucket", "n_sentences", F.md5("lines").alias("digest_md5"))


@query("tx7_filing_rules", """WITH c AS (SELECT conv_id, turn, text, conv_id // 10 AS day FROM conversations), f AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY conv_id, turn) AS seq FROM c WHERE trim(text, ' ') <> '' AND (day % 10 <> 3 OR turn % 2 = 1))
SELECT conv_id, turn, day, seq, CASE WHEN day % 10 IN (3, 7) THEN 'closed' ELSE 'open' END AS status, day % 10 IN (3, 7) AS late FROM f""", (), ())  # fmt: skip
def filing_rules(spark, sf):
    """TX7: filings numbered by day; blank ones are rejected, and those on a closed day unless they are allowed there."""
    c = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.floor(F.col("conv_id") / 10).alias("day"))
    closed = c.select("day").distinct().filter("day % 10 in (3, 7)").withColumn("allowed", F.col("day") % 10 == 7)
    kept = text.filed(c.withColumn("forced", F.col("turn") % 2 == 1), closed, "day", "text", F.col("forced"))
    seq = F.row_number().over(W.partitionBy("day").orderBy("conv_id", "turn"))
    return kept.select("conv_id", "turn", "day", seq.alias("seq"), "status", "late")
