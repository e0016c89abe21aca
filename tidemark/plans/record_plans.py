"""Queries over landed reports, records by key and year, and filing logs."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import align
from tidemark.plans.registry import query
from tidemark.sources import readers, views
from tidemark.sources.views import table


@query("src4_wide_report", """SELECT try_strptime(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a' ELSE strftime(o_orderdate, '%m/%d/%Y') END, '%m/%d/%Y')::DATE AS dt, o_totalprice AS total,
  CASE WHEN o_orderkey % 5 > 0 THEN o_custkey::DOUBLE END AS customer FROM orders WHERE o_orderkey % 7 <> 0""", ["total", "customer"])  # fmt: skip
def wide_report(spark, sf):
    """SRC4: a report of texts with broken dates and numbers."""
    o = table(spark, sf, "orders")
    raw = o.select(
        F.when(F.col("o_orderkey") % 7 == 0, "n/a").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("Report Date"), F.col("o_totalprice").cast("string").alias("Total"),
        F.when(F.col("o_orderkey") % 5 == 0, ".").otherwise(F.col("o_custkey").cast("string")).alias("Customer"), F.col("o_orderstatus").alias("Unknown"),
    )
    return readers.report(raw, {"Report Date": "dt", "Total": "total", "Customer": "customer"}, "Report Date")


@query("src5_keyed_header", """SELECT date_trunc('month', o_orderdate)::DATE AS month, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS debit FROM orders GROUP BY 1""", ["debit"], ("month",))
def header(spark, sf):
    """SRC5: columns found by keywords, months normalised, the last of a month kept."""
    raw = table(spark, sf, "orders").select(F.col("o_orderdate").alias("Year-Month of Statement"), F.col("o_totalprice").alias("Debit Balances (total)"), F.col("o_orderkey").alias("Row Number"))
    t = readers.keyed_header(raw, {"day": ("year", "month"), "debit": ("debit", "balance"), "n": ("row",)})
    return t.groupBy(F.to_date(F.date_trunc("month", "day")).alias("month")).agg(F.max_by("debit", F.struct("day", "n")).alias("debit"))


@query("src7_field_panel", """SELECT * FROM (SELECT regexp_replace(o_orderpriority, '^[0-9]-', '') AS ticker, date_trunc('month', o_orderdate)::DATE AS dt, avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS f,
  avg(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS o, avg(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS p FROM orders GROUP BY ALL) WHERE coalesce(f, o, p) IS NOT NULL""", ["f", "o", "p"])  # fmt: skip
def field_panel(spark, sf):
    """SRC7: (ticker, field) rows as a panel, the ticker's prefix stripped."""
    long = table(spark, sf, "orders").select(F.regexp_replace("o_orderpriority", "^[0-9]-", "").alias("ticker"), F.to_date(F.date_trunc("month", "o_orderdate")).alias("dt"), F.lower("o_orderstatus").alias("field"), F.col("o_totalprice").alias("value"))
    return readers.panel(long, ["ticker", "dt"], "field", "value", ["f", "o", "p"])


@query("src8_latest_value", """WITH l AS (SELECT c_nationkey, arg_max(o_totalprice, (o_orderdate, o_orderkey)) AS value FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT n_name AS name, value FROM l JOIN nation ON n_nationkey = c_nationkey""", ["value"], ())
def latest(spark, sf):
    """SRC8: the latest order value of each nation, keys renamed by a dimension."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    found = readers.latest(o.withColumn("value", F.col("o_totalprice")), "c_nationkey", "value", F.struct("o_orderdate", "o_orderkey"))
    return found.join(table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("name")), "c_nationkey").select("name", "value")


@query("src9_good_ticks", "SELECT event_id, value AS price FROM events WHERE value > 0", ["price"], ())
def ticks(spark, sf):
    return readers.good_ticks(views.ticks(spark, sf)).select("event_id", "price")


@query("src10_source_priority", """WITH a AS (SELECT c_custkey AS k, max(o_totalprice) AS value FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_totalprice) AS value FROM orders GROUP BY 1)
SELECT k, coalesce(a.value, b.value) AS value, (a.value IS NULL)::INT AS priority FROM b LEFT JOIN a USING (k)""", ["value"], ())  # fmt: skip
def priority(spark, sf):
    """SRC10: open orders first, any order where a customer has none."""
    o = table(spark, sf, "orders").withColumn("k", F.col("o_custkey"))
    best = lambda d: d.groupBy("k").agg(F.max("o_totalprice").alias("value"))
    return readers.by_priority([best(o.filter("o_orderstatus = 'P'")), best(o)], ["k"], "value")


@query("tx5_primary_groups", "SELECT coalesce(upper(nullif(source, '')), 'GENERAL') AS grp, count(*) AS n, min(doc_id) AS first_id, count(CASE WHEN upper(lang) = 'EN' THEN 1 END) AS n_en FROM documents GROUP BY 1", (), ())
def groups(spark, sf):
    """TX5: entries by primary tag, and how many hold a tag in any case."""
    d = table(spark, sf, "documents").withColumn("tags", F.array(F.nullif("source", F.lit("")), F.col("lang")))
    held = F.array_contains(F.transform("tags", F.upper), "EN")
    return d.groupBy(F.coalesce(F.upper(F.col("tags")[0]), F.lit("GENERAL")).alias("grp")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.count(F.when(held, 1)).alias("n_en"))


_DAY = "printf('%04d-%02d-%02d', year(o_orderdate), month(o_orderdate), day(o_orderdate) + o_orderkey % 5)"


@query("tx8_valid_dates", f"SELECT o_orderkey, {_DAY} AS s, regexp_full_match({_DAY}, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') AND try_cast({_DAY} AS DATE) IS NOT NULL AS valid FROM orders", (), ())
def valid_dates(spark, sf):
    """TX8: texts of the right form that are real dates."""
    d = F.col("o_orderdate")
    s = F.format_string("%04d-%02d-%02d", F.year(d), F.month(d), (F.dayofmonth(d) + F.col("o_orderkey") % 5).cast("int"))
    o = table(spark, sf, "orders").select("o_orderkey", s.alias("s"))
    return o.withColumn("valid", F.col("s").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.to_date(F.try_to_timestamp("s", F.lit("yyyy-MM-dd"))).isNotNull())


@query("tx9_newest_first", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS place FROM conversations", (), ())
def newest(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", F.row_number().over(W.partitionBy("conv_id").orderBy(F.desc("turn"))).alias("place"))


@query("tx10_ticker_parts", "SELECT p_partkey, nullif(regexp_extract(p_brand, '^([A-Za-z0-9]+)#([0-9]+)', 1), '') AS prefix, upper(split_part(p_brand, '#', 2)) || ' Index' AS ticker FROM part", (), ())
def ticker_parts(spark, sf):
    b = F.col("p_brand")
    return table(spark, sf, "part").select("p_partkey", F.nullif(F.regexp_extract(b, "^([A-Za-z0-9]+)#([0-9]+)", 1), F.lit("")).alias("prefix"), F.concat(F.upper(F.split_part(b, F.lit("#"), F.lit(2))), F.lit(" Index")).alias("ticker"))


@query("ag15_fiscal_record", """WITH y AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END) AS a, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS b, sum(o_totalprice) AS gdp, sum(o_totalprice) FILTER (o_orderpriority LIKE '1%') AS revenue FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL)
SELECT k, y, coalesce(a, b) AS balance, CASE WHEN a IS NOT NULL THEN 'primary' WHEN b IS NOT NULL THEN 'alternate' END AS source, coalesce(a, b) / nullif(gdp, 0) * 100 AS pct_gdp, (b - a) AS interest, (b - a) / nullif(revenue, 0) * 100 AS interest_pct FROM y""", ["balance", "pct_gdp", "interest", "interest_pct"], ())  # fmt: skip
def fiscal_record(spark, sf):
    """AG15: a balance with its provenance, and ratios that are null where a part is."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey")
    v, when = F.col("o_totalprice"), lambda c: F.sum(F.when(c, F.col("o_totalprice")))
    y = o.groupBy("k", F.year("o_orderdate").alias("y")).agg(when(F.col("o_orderstatus") == "P").alias("a"), when(F.col("o_orderstatus") == "F").alias("b"), F.sum(v).alias("gdp"), when(F.col("o_orderpriority").startswith("1")).alias("revenue"))
    a, b, part = F.col("a"), F.col("b"), lambda x, of: x / F.nullif(F.col(of), F.lit(0.0)) * 100
    return y.select("k", "y", F.coalesce(a, b).alias("balance"), F.when(a.isNotNull(), "primary").when(b.isNotNull(), "alternate").alias("source"), part(F.coalesce(a, b), "gdp").alias("pct_gdp"), (b - a).alias("interest"), part(b - a, "revenue").alias("interest_pct"))


_YEARS = "y AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, sum(o_totalprice) AS v, count(DISTINCT o_custkey) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL), p AS (SELECT k, y, v, n, v / 365.25 / nullif(n, 0) AS x FROM y)"


def years(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey")
    y = o.groupBy("k", F.year("o_orderdate").alias("y")).agg(F.sum("o_totalprice").alias("v"), F.countDistinct("o_custkey").alias("n"))
    return y.withColumn("x", F.col("v") / 365.25 / F.nullif(F.col("n"), F.lit(0)))


@query("bd10_productivity", f"""WITH {_YEARS} SELECT k, y, x, (x / lag(x) OVER w - 1) * 100 AS yoy, regr_slope(x, y - 1995) OVER (PARTITION BY k) * (y - 1995) + regr_intercept(x, y - 1995) OVER (PARTITION BY k) AS trend,
  (pow(last_value(x) OVER f / first_value(x) OVER f, 1.0 / nullif(max(y) OVER f - min(y) OVER f, 0)) - 1) * 100 AS cagr FROM p WINDOW w AS (PARTITION BY k ORDER BY y), f AS (PARTITION BY k ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""", ["x", "yoy", "trend", "cagr"], ())  # fmt: skip
def productivity(spark, sf):
    """BD10: daily value per head by year, its growth, straight trend and compound rate."""
    y, x = F.col("y"), F.col("x")
    of = W.partitionBy("k")
    w = of.orderBy("y")
    mx, my = F.avg(y).over(of), F.avg(x).over(of)
    p = years(spark, sf).withColumn("dy", y - mx).withColumn("my", my)
    slope = F.sum(F.col("dy") * (x - F.col("my"))).over(of) / F.nullif(F.sum(F.col("dy") * F.col("dy")).over(of), F.lit(0.0))
    span = F.nullif(F.max(y).over(of) - F.min(y).over(of), F.lit(0))
    growth = F.max_by(x, y).over(of) / F.min_by(x, y).over(of)
    return p.select("k", "y", "x", ((x / F.lag(x).over(w) - 1) * 100).alias("yoy"), (F.col("my") + slope * F.col("dy")).alias("trend"), ((F.pow(growth, 1 / span) - 1) * 100).alias("cagr"))


@query("bd11_holdings", f"""WITH {_YEARS}, t AS (SELECT y, sum(v) AS total FROM p GROUP BY y) SELECT k, y, v, v - lag(v) OVER w AS chg, (v / lag(v) OVER w - 1) * 100 AS pct, floor(v / total * 1000 + 0.5) / 10 AS share, row_number() OVER (PARTITION BY y ORDER BY v DESC, k) AS place
FROM p JOIN t USING (y) WINDOW w AS (PARTITION BY k ORDER BY y)""", ["v", "chg", "pct", "share"], ())  # fmt: skip
def holdings(spark, sf):
    """BD11: holders by size, with changes and the share of all."""
    p, v, w = years(spark, sf), F.col("v"), W.partitionBy("k").orderBy("y")
    p = p.withColumn("total", F.sum("v").over(W.partitionBy("y")))
    return p.select("k", "y", "v", (v - F.lag(v).over(w)).alias("chg"), ((v / F.lag(v).over(w) - 1) * 100).alias("pct"), (F.floor(v / F.col("total") * 1000 + 0.5) / 10).alias("share"), F.row_number().over(W.partitionBy("y").orderBy(F.desc("v"), "k")).alias("place"))


_GDP_PEAK = 2.87
_READING = lambda x: f"CASE WHEN {x} IS NULL THEN 'N/A' WHEN {x} > {_GDP_PEAK * 1.25!r} THEN 'Elevated' WHEN {x} > {_GDP_PEAK!r} THEN 'Rising' ELSE 'Normal' END"


@query("bd9_margin_board", f"""WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE AS dt, sum(o_totalprice) AS debit, sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END) + sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice ELSE 0 END) AS credit FROM orders GROUP BY 1),
q AS (SELECT date_trunc('quarter', l_shipdate)::DATE AS dt, sum(l_extendedprice) * 20 AS gdp, sum(l_extendedprice * (1 - l_discount)) * 15 AS cap FROM lineitem GROUP BY 1),
j AS (SELECT m.dt, debit, credit, gdp, cap FROM m ASOF LEFT JOIN q ON m.dt >= q.dt), r AS (SELECT *, debit / nullif(gdp, 0) * 100 AS of_gdp, debit / nullif(cap, 0) * 100 AS of_cap, debit / nullif(credit, 0) AS net_leverage FROM j)
SELECT dt, debit, gdp, cap, of_gdp, of_cap, net_leverage, debit / max(debit) OVER (ORDER BY dt) AS of_peak, {_READING('of_gdp')} AS reading, coalesce(dt = (SELECT max(dt) FROM r WHERE of_gdp IS NOT NULL), false) AS is_latest FROM r""", ["debit", "gdp", "cap", "of_gdp", "of_cap", "net_leverage", "of_peak"])  # fmt: skip
def margin_board(spark, sf):
    """BD9, PR5: monthly debits against the quarter last known, as shares of product and market value, and over free credit; one row a month, so its windows see months only."""
    price = F.col("o_totalprice")
    of = lambda flag: F.sum(F.when(F.col("o_orderstatus") == flag, price).otherwise(0.0))
    m = table(spark, sf, "orders").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("dt")).agg(F.sum(price).alias("debit"), (of("F") + of("P")).alias("credit"))
    sold = F.col("l_extendedprice")
    q = table(spark, sf, "lineitem").groupBy(F.to_date(F.date_trunc("quarter", "l_shipdate")).alias("dt")).agg(F.struct((F.sum(sold) * 20).alias("gdp"), (F.sum(sold * (1 - F.col("l_discount"))) * 15).alias("cap")).alias("known"))
    j = align.asof(m.withColumn("one", F.lit(1)), q.withColumn("one", F.lit(1)), ["one"], "dt", "known").select("dt", "debit", "credit", "known.*")
    ratio = lambda x: F.col("debit") / F.nullif(F.col(x), F.lit(0.0))
    r = j.withColumns({"of_gdp": ratio("gdp") * 100, "of_cap": ratio("cap") * 100, "net_leverage": ratio("credit")})
    g, w = F.col("of_gdp"), W.orderBy("dt")
    reading = F.when(g.isNull(), "N/A").when(g > _GDP_PEAK * 1.25, "Elevated").when(g > _GDP_PEAK, "Rising").otherwise("Normal")
    latest = F.max(F.when(g.isNotNull(), F.col("dt"))).over(W.partitionBy())
    return r.select("dt", "debit", "gdp", "cap", "of_gdp", "of_cap", "net_leverage", (F.col("debit") / F.max("debit").over(w)).alias("of_peak"), reading.alias("reading"), F.coalesce(F.col("dt") == latest, F.lit(False)).alias("is_latest"))
