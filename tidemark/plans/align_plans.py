"""Queries over aligned dates, sets of keys, first ones and last ones, counts by class."""

from __future__ import annotations

import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import align, rolling
from tidemark.operators.rolling import lag
from tidemark.plans import sqltext as S
from tidemark.plans.boards import PROBS, is_crisis, regime_probs
from tidemark.plans.registry import query
from tidemark.plans.series_plans import B, bars
from tidemark.sources import views
from tidemark.sources.views import table

_CAP = 3


@query("jn5_capped_asof", f"""{S.bars('day')}, l AS (SELECT series_id, dt, close FROM b), r AS (SELECT series_id, date_trunc('month', dt)::DATE AS dt, sum(volume) AS net FROM b WHERE month(dt) % 3 > 0 GROUP BY ALL),
u AS (SELECT series_id, dt, dense_rank() OVER (PARTITION BY series_id ORDER BY dt) AS d FROM (SELECT series_id, dt FROM l UNION SELECT series_id, dt FROM r)),
rd AS (SELECT r.*, d FROM r JOIN u USING (series_id, dt)), ld AS (SELECT l.*, d FROM l JOIN u USING (series_id, dt))
SELECT ld.series_id, ld.dt, close, CASE WHEN ld.d - rd.d <= {_CAP} THEN net END AS net FROM ld ASOF LEFT JOIN rd ON ld.series_id = rd.series_id AND ld.dt >= rd.dt""", ["close", "net"])  # fmt: skip
def capped(spark, sf):
    """JN5: monthly positions on daily prices, carried over three later dates of either at most."""
    b = views.bars(spark, sf, "day")
    r = b.filter(F.month("dt") % 3 > 0).groupBy("series_id", F.to_date(F.date_trunc("month", "dt")).alias("dt")).agg(F.sum("volume").alias("net"))
    return align.asof(b.select("series_id", "dt", "close"), r, ["series_id"], "dt", "net", skip_null=True, cap=_CAP)


_KEYED = """k AS (SELECT key, dt, CASE WHEN day(dt) % 5 <> length(key) % 5 THEN v END AS value FROM (SELECT o_orderpriority AS key, o_orderdate::DATE AS dt, avg(o_totalprice) AS v FROM orders GROUP BY ALL))"""


def keyed(spark, sf):
    """Daily means of each key; on some days a key has none."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("key"), F.to_date("o_orderdate").alias("dt")).agg(F.avg("o_totalprice").alias("value"))
    return o.withColumn("value", F.when(F.dayofmonth("dt") % 5 != F.length("key") % 5, F.col("value")))


@query("jn6_keyed_carry", f"""WITH {_KEYED}, d AS (SELECT DISTINCT dt FROM k WHERE key IN ('1-URGENT', '2-HIGH', '5-LOW')) SELECT d.dt, a.value AS "1-URGENT", b.value AS "2-HIGH", c.value AS "5-LOW"
FROM d ASOF LEFT JOIN (SELECT * FROM k WHERE key = '1-URGENT' AND value IS NOT NULL) a ON d.dt >= a.dt ASOF LEFT JOIN (SELECT * FROM k WHERE key = '2-HIGH' AND value IS NOT NULL) b ON d.dt >= b.dt ASOF LEFT JOIN (SELECT * FROM k WHERE key = '5-LOW' AND value IS NOT NULL) c ON d.dt >= c.dt""", ['"1-URGENT"', '"2-HIGH"', '"5-LOW"'])  # fmt: skip
def keyed_carry(spark, sf):
    """JN6: the named series on all their dates, each carried on."""
    return align.keyed_carry(keyed(spark, sf), ["1-URGENT", "2-HIGH", "5-LOW"])


@query("jn7_exact_date_spread", f"WITH {_KEYED} SELECT a.dt, (a.value - b.value) * 100 AS spread_bps FROM k a JOIN k b ON a.dt = b.dt AND a.key = '1-URGENT' AND b.key = '5-LOW' WHERE a.value IS NOT NULL AND b.value IS NOT NULL", ["spread_bps"])
def exact_spread(spark, sf):
    """JN7: two series' difference on the dates that both have."""
    k = keyed(spark, sf).filter("value is not null")
    one, two = (k.filter(F.col("key") == n).select("dt", F.col("value").alias(v)) for n, v in (("1-URGENT", "a"), ("5-LOW", "b")))
    return one.join(two, "dt").select("dt", ((F.col("a") - F.col("b")) * 100).alias("spread_bps"))


_HITS = """h AS (SELECT s_nationkey AS country, p_size % 4 AS metric, p_brand AS ticker, min((l_orderkey, l_linenumber)) AS ord FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
v AS (SELECT p_brand AS ticker, CASE WHEN split_part(p_brand, '#', 2)::INT % 4 > 0 THEN avg(p_retailprice) END AS value FROM part GROUP BY 1)"""


@query("jn15_candidate_resolution", f"""WITH {_HITS}, f AS (SELECT country, metric, ticker, value FROM h JOIN v USING (ticker) WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY country, metric ORDER BY ord, ticker) = 1),
x AS (SELECT country, max(CASE WHEN metric = 0 THEN ticker END) AS m0, max(CASE WHEN metric = 1 THEN ticker END) AS m1, max(CASE WHEN metric = 2 THEN ticker END) AS m2, max(CASE WHEN metric = 3 THEN ticker END) AS m3, count(*) AS resolved FROM f GROUP BY country) SELECT * FROM x""", (), ())  # fmt: skip
def candidates(spark, sf):
    """JN15: of each country's and metric's hits, without repeats, the first whose ticker has a value; as a coverage matrix."""
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), (F.col("p_size") % 4).alias("metric"), F.col("p_brand").alias("ticker"))
    supplier = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("country"))
    hits = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").join(part, "l_partkey").join(supplier, "l_suppkey")
    hits = hits.groupBy("country", "metric", "ticker").agg(F.min(F.struct("l_orderkey", "l_linenumber")).alias("ord"))
    brand = F.split_part("p_brand", F.lit("#"), F.lit(2)).cast("int")
    values = table(spark, sf, "part").groupBy(F.col("p_brand").alias("ticker"), brand.alias("n")).agg(F.avg("p_retailprice").alias("value")).filter("n % 4 > 0")
    found = hits.join(values, "ticker").groupBy("country", "metric").agg(F.min_by("ticker", F.struct("ord", "ticker")).alias("ticker"))
    wide = found.groupBy("country").pivot("metric", [0, 1, 2, 3]).agg(F.first("ticker"))
    held = sum((F.col(str(k)).isNotNull().cast("long") for k in range(4)), F.lit(0))
    return wide.select("country", *(F.col(str(k)).alias(f"m{k}") for k in range(4)), held.alias("resolved"))


@query("so1_so2_key_sets", "SELECT coalesce(a.k, b.k) AS k, a.k IS NOT NULL AS in_customers, b.k IS NOT NULL AS in_orders, a.k IS NOT NULL AND b.k IS NOT NULL AS in_both FROM (SELECT DISTINCT c_custkey AS k FROM customer) a FULL JOIN (SELECT DISTINCT o_custkey AS k FROM orders) b USING (k)", (), ())
def key_sets(spark, sf):
    """SO1, SO2: the union of two sets of keys and which of them are in the intersection, from one pass over both."""
    one = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.lit(True).alias("a"), F.lit(False).alias("b"))
    two = table(spark, sf, "orders").select(F.col("o_custkey").alias("k"), F.lit(False).alias("a"), F.lit(True).alias("b"))
    g = one.unionByName(two).groupBy("k").agg(F.max("a").alias("in_customers"), F.max("b").alias("in_orders"))
    return g.withColumn("in_both", F.col("in_customers") & F.col("in_orders"))


@query("so3_jn14_missing_keys", "SELECT n_nationkey AS k, n_name AS name FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' AND c_nationkey IS NOT NULL)", (), ())
def missing(spark, sf):
    """SO3, JN14: required keys that none of the present rows has."""
    o = table(spark, sf, "orders").filter("o_orderstatus = 'P' and o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    held = table(spark, sf, "customer").join(o, "c_custkey", "left_semi").select(F.col("c_nationkey").alias("k"))
    return table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")).join(held, "k", "left_anti")


@query("dd1_first_seen", "SELECT code, min(o_orderkey) AS seen FROM (SELECT o_orderkey, (o_custkey % 997)::VARCHAR AS code FROM orders) GROUP BY code", (), ())
def first_seen(spark, sf):
    """DD1: distinct codes with the place at which each stands first."""
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_custkey") % 997).cast("string").alias("code"))
    return align.first_seen(o, "code", "o_orderkey").withColumnRenamed("o_orderkey", "seen")


@query("sl3_first_of_each_feed", "SELECT event_type AS feed, event_id, ts::VARCHAR AS ts FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 10", (), ())
def first_of_each(spark, sf):
    """SL3: ten events of each feed in arrival order (the limit is the feature)."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("feed"), "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("t"))
    text = F.regexp_replace(F.regexp_replace("t", "0+$", ""), r"\.$", "")
    return align.first_per_group(e, "feed", ["event_id"], 10).select("feed", "event_id", text.alias("ts"))


@query("ag13_class_counts", f"{B}, {PROBS} SELECT series_id, avg(ranging) AS p_ranging, avg(trending) AS p_trending, avg(crisis) AS p_crisis, avg((crisis > 0.6 OR vol > 0.25)::INT) AS crisis_share, count(CASE WHEN crisis > 0.6 THEN 1 END) AS n_crisis, count(*) AS n FROM n GROUP BY series_id", ["p_ranging", "p_trending", "p_crisis", "crisis_share"], ())
def class_counts(spark, sf):
    """AG13: mean probabilities, shares and counts of regimes."""
    p = regime_probs(bars(spark, sf))
    return p.groupBy("series_id").agg(*(F.avg(c).alias(f"p_{c}") for c in ("ranging", "trending", "crisis")), F.avg(is_crisis().cast("int")).alias("crisis_share"), F.count(F.when(F.col("crisis") > 0.6, 1)).alias("n_crisis"), F.count(F.lit(1)).alias("n"))


@query("ag13_news_counts", "SELECT event_type AS event_class, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER () AS share, count(CASE WHEN user_id % 3 = 0 THEN 1 END) AS n_hawkish, count(CASE WHEN user_id % 3 = 1 THEN 1 END) AS n_dovish FROM events GROUP BY 1", ["share"], ())
def news_counts(spark, sf):
    """AG13: events of each class, their share and directions."""
    n = views.news(spark, sf).groupBy("event_class").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("direction") == "hawkish", 1)).alias("n_hawkish"), F.count(F.when(F.col("direction") == "dovish", 1)).alias("n_dovish"))
    total = n.agg(F.sum("n").alias("all"))
    return n.withColumn("one", F.lit(1)).join(F.broadcast(total.withColumn("one", F.lit(1))), "one").select("event_class", "n", (F.col("n") / F.col("all")).alias("share"), "n_hawkish", "n_dovish")


@query("ag20_distinct_values", "SELECT p_brand AS brand, count(DISTINCT p_size) AS n_sizes, array_to_string(list_sort(list(DISTINCT p_size))[1:10], ',') AS first_sizes FROM part GROUP BY 1", (), ())
def distinct_values(spark, sf):
    """AG20: how many different values each group has, and the first ten of them."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("brand"), "p_size").distinct()
    first = align.first_per_group(p, "brand", ["p_size"], 10).groupBy("brand").agg(F.array_join(F.array_sort(F.collect_list("p_size")).cast("array<string>"), ",").alias("first_sizes"))
    return p.groupBy("brand").agg(F.count(F.lit(1)).alias("n_sizes")).join(first, "brand")


@query("pr8_filters", f"{B}, n AS (SELECT series_id, dt, close, count(*) OVER (PARTITION BY series_id) AS n, max(dt) OVER () AS top FROM b) SELECT series_id, dt, close FROM n WHERE n >= 60 AND series_id IN (SELECT p_brand FROM part WHERE p_size = 1) AND dt >= top - INTERVAL 2 YEAR", ["close"])
def filters(spark, sf):
    """PR8: series of a group with enough history, in the last two years of all."""
    b = bars(spark, sf)
    group = table(spark, sf, "part").filter("p_size = 1").select(F.col("p_brand").alias("series_id"))
    top = b.agg(F.max("dt").alias("top"))
    held = b.withColumn("n", F.count(F.lit(1)).over(W.partitionBy("series_id"))).filter("n >= 60").join(group, "series_id", "left_semi")
    recent = held.withColumn("one", F.lit(1)).join(F.broadcast(top.withColumn("one", F.lit(1))), "one")
    return recent.filter(F.col("dt") >= F.add_months("top", -24)).select("series_id", "dt", "close")


@query("pr9_pr10_cleaned_rows", f"{B}, r AS (SELECT series_id, dt, CASE WHEN rn % 13 > 0 THEN r END AS r, CASE WHEN rn % 13 > 0 AND rn % 4 > 0 THEN volume END AS v FROM b) SELECT series_id, dt, r, v, CASE WHEN v <> 0 AND isfinite(r / v) THEN greatest(-0.01, least(0.01, r / v)) END AS clipped, r IS NOT NULL AND v IS NOT NULL AS whole FROM r WHERE r IS NOT NULL OR v IS NOT NULL", ["r", "v", "clipped"])
def cleaned(spark, sf):
    """PR9, PR10: rows without any value dropped, zero denominators and infinities as nulls, ratios clipped."""
    b = bars(spark, sf)
    rows = b.select("series_id", "dt", F.when(F.col("rn") % 13 > 0, F.col("r")).alias("r"), F.when((F.col("rn") % 13 > 0) & (F.col("rn") % 4 > 0), F.col("volume")).alias("v")).na.drop("all", subset=["r", "v"])
    ratio = F.col("r") / F.nullif(F.col("v"), F.lit(0.0))
    finite = F.when(F.abs(ratio) < float("inf"), ratio)
    return rows.select("series_id", "dt", "r", "v", F.when(finite.isNotNull(), F.greatest(F.lit(-0.01), F.least(F.lit(0.01), finite))).alias("clipped"), (F.col("r").isNotNull() & F.col("v").isNotNull()).alias("whole"))


@query("ag2_resampled", f"{S.bars('day')} SELECT series_id, 'week' AS unit, (date_trunc('week', dt) + INTERVAL 6 DAY)::DATE AS dt, arg_max(close, dt) AS value FROM b GROUP BY ALL UNION ALL SELECT series_id, 'month', date_trunc('month', dt)::DATE, arg_min(close, dt) FROM b GROUP BY ALL UNION ALL SELECT series_id, 'year', make_date(year(dt), 12, 31), avg(close) FROM b GROUP BY series_id, year(dt)", ["value"])
def resampled(spark, sf):
    """AG2: the last of a week (named by its Sunday), the first of a month, the mean of a year."""
    b = views.bars(spark, sf, "day").select("series_id", "dt", "close")
    week = b.groupBy("series_id", F.date_add(F.to_date(F.date_trunc("week", "dt")), 6).alias("at")).agg(F.max_by("close", "dt").alias("value"))
    month = b.groupBy("series_id", F.to_date(F.date_trunc("month", "dt")).alias("at")).agg(F.min_by("close", "dt").alias("value"))
    year = b.groupBy("series_id", F.make_date(F.year("dt"), F.lit(12), F.lit(31)).alias("at")).agg(F.avg("close").alias("value"))
    every = week.withColumn("unit", F.lit("week")).unionByName(month.withColumn("unit", F.lit("month"))).unionByName(year.withColumn("unit", F.lit("year")))
    return every.select("series_id", "unit", F.col("at").alias("dt"), "value")


@query("ag9_calendar_years", f"""{B}, s AS (SELECT *, CASE WHEN z > 1 THEN -1 WHEN z < -1 THEN 1 WHEN z IS NOT NULL THEN 0 END AS sig FROM (SELECT *, {S.z('close', 90)} AS z FROM b)), p AS (SELECT series_id, dt, lag(sig) {S.W} * r AS pnl FROM s)
SELECT series_id, year(dt) AS y, sum(pnl) AS pnl, count(pnl) AS n FROM p GROUP BY ALL""", ["pnl"], ())  # fmt: skip
def calendar_years(spark, sf):
    """AG9: the threshold strategy's gains by calendar year."""
    z = F.col("z")
    b = bars(spark, sf).withColumn("z", rolling.zscore(F.col("close"), 90)).withColumn("sig", F.when(z > 1, -1).when(z < -1, 1).when(z.isNotNull(), 0))
    return b.withColumn("pnl", lag(F.col("sig")) * F.col("r")).groupBy("series_id", F.year("dt").alias("y")).agg(F.sum("pnl").alias("pnl"), F.count("pnl").alias("n"))


@query("wn28_fills", f"""{B}, x AS (SELECT series_id, dt, CASE WHEN rn % 9 IN (1, 2, 3, 4, 5, 6) THEN NULL ELSE close END AS x FROM b)
SELECT series_id, dt, last_value(x IGNORE NULLS) {S.frame(6)} AS forward_5, first_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY dt ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS back_5, first_value(x IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS back FROM x""", ["forward_5", "back_5", "back"])  # fmt: skip
def fills(spark, sf):
    """WN28: gaps filled forwards and backwards over five rows at most, and backwards without a limit."""
    b = bars(spark, sf).withColumn("x", F.when(~(F.col("rn") % 9).between(1, 6), F.col("close")))
    x = F.col("x")
    return b.select("series_id", "dt", rolling.fill(x, 5).alias("forward_5"), rolling.fill(x, 5, back=True).alias("back_5"), rolling.fill(x, back=True).alias("back"))


@query("wn29_calendar_change", f"""{B}, y AS (SELECT series_id, dt, close, (dt - 365)::DATE AS before FROM b)
SELECT y.series_id, y.dt, (y.close / nullif(p.close, 0) - 1) * 100 AS yoy, (y.close / nullif(lag(y.close, 252) OVER (PARTITION BY y.series_id ORDER BY y.dt), 0) - 1) * 100 AS yoy_rows FROM y ASOF LEFT JOIN b p ON p.series_id = y.series_id AND y.before >= p.dt""", ["yoy", "yoy_rows"])  # fmt: skip
def calendar_change(spark, sf):
    """WN29: growth on the last value known a calendar year ago, and on that of 252 rows ago."""
    b = views.bars(spark, sf).select("series_id", "dt", "close")
    left = b.select("series_id", F.date_sub("dt", 365).alias("at"), F.col("dt").alias("day"), F.col("close").alias("now"), lag(F.col("close"), 252).alias("then"))
    j = align.asof(left.withColumnRenamed("at", "dt"), b, ["series_id"], "dt", "close")
    growth = lambda x: (F.col("now") / F.nullif(F.col(x), F.lit(0.0)) - 1) * 100
    return j.select("series_id", F.col("day").alias("dt"), growth("close").alias("yoy"), growth("then").alias("yoy_rows"))


_CONTRACTS = """c AS (SELECT series_id, printf('%04d%d', year(dt), quarter(dt)) AS contract, dt, close * (1 + (year(dt) * 4 + quarter(dt)) % 7 / 100.0::DOUBLE) AS close FROM b UNION ALL
  SELECT series_id, printf('%04d%d', year(dt + INTERVAL 3 MONTH), quarter(dt + INTERVAL 3 MONTH)), dt, close * (1 + (year(dt + INTERVAL 3 MONTH) * 4 + quarter(dt + INTERVAL 3 MONTH)) % 7 / 100.0::DOUBLE) FROM b WHERE day(dt) > 14 AND month(dt) % 3 = 0)"""


@query("wn33_continuous_contract", f"""{B}, {_CONTRACTS}, f AS (SELECT series_id, contract, min(dt) AS start FROM c GROUP BY ALL), n AS (SELECT *, lead(start) OVER (PARTITION BY series_id ORDER BY contract) AS until FROM f),
s AS (SELECT c.series_id, c.contract, c.dt, c.close FROM c JOIN n USING (series_id, contract) WHERE until IS NULL OR c.dt < until),
e AS (SELECT series_id, contract, arg_min(close, dt) AS first_close, arg_max(close, dt) AS last_close FROM s GROUP BY ALL), g AS (SELECT series_id, contract, coalesce(lead(first_close) OVER w / nullif(last_close, 0), 1) AS ratio FROM e WINDOW w AS (PARTITION BY series_id ORDER BY contract)),
h AS (SELECT series_id, contract, (SELECT product(ratio ORDER BY k.contract) FROM g k WHERE k.series_id = g.series_id AND k.contract >= g.contract) AS factor FROM g) SELECT series_id, contract, dt, close, close * factor AS adjusted FROM s JOIN h USING (series_id, contract)""", ["close", "adjusted"])  # fmt: skip
def continuous(spark, sf):
    """WN33: each contract until the next one starts, all earlier prices by the ratios of later rolls."""
    b = views.bars(spark, sf).select("series_id", "dt", "close")

    def contract(at):
        of = F.year(at) * 4 + F.quarter(at)
        return F.format_string("%04d%d", F.year(at), F.quarter(at)), F.col("close") * (1 + of % 7 / F.lit(100.0))

    now, price = contract(F.col("dt"))
    later, ahead = contract(F.add_months("dt", 3))
    early = b.filter((F.dayofmonth("dt") > 14) & (F.month("dt") % 3 == 0))
    c = b.select("series_id", now.alias("contract"), "dt", price.alias("close")).union(early.select("series_id", later, "dt", ahead))
    return align.continuous(c).select("series_id", "contract", "dt", "close", "adjusted")


_REFIT, _STEP = 104, 13
_OU = """count(*) AS n, regr_slope(y, x) AS slope, regr_intercept(y, x) AS intercept, regr_sxx(y, x) AS sxx, regr_syy(y, x) AS syy, regr_sxy(y, x) AS sxy"""


@query("ag4_rolling_refit", f"""{B}, k AS (SELECT series_id, unnest(range({_REFIT}, max(rn), {_STEP})) AS i FROM b GROUP BY series_id), p AS (SELECT k.series_id, i, b.dt, close - lag(close) OVER w AS y, lag(close) OVER w AS x FROM k JOIN b ON b.series_id = k.series_id AND b.rn > i - {_REFIT} AND b.rn <= i WINDOW w AS (PARTITION BY k.series_id, i ORDER BY b.dt)),
s AS (SELECT series_id, i, max(dt) AS dt, count(x) AS n, avg(x) AS mx, avg(y) AS my, covar_samp(y, x) / var_samp(x) AS slope, var_samp(y) AS vy, var_samp(x) AS vx FROM p GROUP BY ALL HAVING count(x) >= 30)
SELECT series_id, dt, n, slope, -slope * 252 AS kappa, -(my - slope * mx) / slope AS mu, CASE WHEN slope < 0 THEN ln(2) / -slope END AS half_life, sqrt((vy - slope * slope * vx)) AS resid_std, slope / sqrt((vy - slope * slope * vx) * (n - 1) / (n - 2) / (vx * (n - 1))) AS t_stat FROM s""", ["slope", "kappa", "mu", "half_life", "resid_std", "t_stat"])  # fmt: skip
def rolling_refit(spark, sf):
    """AG4: the reversion fit over the last 104 rows, every 13 rows; nulls dropped first, windows by an interval join."""
    return align.rolling_fit(bars(spark, sf).filter("close is not null").select("series_id", "dt", "close"), _REFIT, _STEP)


@query("ag3_significance", f"""{B}, p AS (SELECT series_id, close - lag(close) {S.W} AS y, lag(close) {S.W} AS x FROM b), s AS (SELECT series_id, count(x) AS n, covar_samp(y, x) / var_samp(x) AS slope, var_samp(y) AS vy, var_samp(x) AS vx FROM p GROUP BY series_id),
t AS (SELECT series_id, n - 2 AS nu, slope / sqrt((vy - slope * slope * vx) / (n - 2) / vx) AS t FROM s WHERE n >= 30), q AS (SELECT *, {align.T_QUANTILE.format(z=align.Z95, nu='nu')} AS q FROM t) SELECT series_id, t AS t_stat, q AS t_limit, abs(t) > q AS significant, t < -q AS reverts FROM q""", ["t_stat", "t_limit"], ())  # fmt: skip
def significance(spark, sf):
    """AG3: whether the reversion's slope is significant at one in ten, by the quantile of Student's law."""
    p = bars(spark, sf).select("series_id", (F.col("close") - lag(F.col("close"))).alias("y"), lag(F.col("close")).alias("x"))
    s = p.groupBy("series_id").agg(F.count("x").alias("n"), (F.covar_samp("y", "x") / F.var_samp("x")).alias("slope"), F.var_samp(F.when(F.col("x").isNotNull(), F.col("y"))).alias("vy"), F.var_samp("x").alias("vx")).filter("n >= 30")
    s = s.withColumn("nu", F.col("n") - 2).withColumn("t_stat", F.col("slope") / F.sqrt((F.col("vy") - F.col("slope") * F.col("slope") * F.col("vx")) / F.col("nu") / F.col("vx")))
    s = s.withColumn("t_limit", F.expr(align.T_QUANTILE.format(z=align.Z95, nu="nu")))
    return s.select("series_id", "t_stat", "t_limit", (F.abs("t_stat") > F.col("t_limit")).alias("significant"), (F.col("t_stat") < -F.col("t_limit")).alias("reverts"))


_HALF = f"""p AS (SELECT series_id, close - lag(close) {S.W} AS y, lag(close) {S.W} AS x FROM b), hl AS (SELECT series_id, CASE WHEN covar_samp(y, x) < 0 THEN greatest(20, floor(2 * ln(2) / -(covar_samp(y, x) / var_samp(x))))::INT ELSE 60 END AS w FROM p GROUP BY series_id)"""


@query("wn1_half_life_window", f"""{B}, {_HALF}, j AS (SELECT a.series_id, a.dt, any_value(a.close) AS close, any_value(w) AS w, count(c.close) AS n, avg(c.close) AS m, stddev_samp(c.close) AS s FROM b a JOIN hl USING (series_id) JOIN b c ON c.series_id = a.series_id AND c.rn > a.rn - w AND c.rn <= a.rn GROUP BY ALL)
SELECT series_id, dt, w AS window_rows, CASE WHEN n >= w // 2 THEN (close - m) / nullif(s, 0) END AS z FROM j""", ["z"])  # fmt: skip
def half_life_window(spark, sf):
    """WN1: z-scores over twice each series' own half-life (20 rows at least; 60 where it doesn't revert), from prefix sums."""
    b = bars(spark, sf)
    p = b.select("series_id", (F.col("close") - lag(F.col("close"))).alias("y"), lag(F.col("close")).alias("x"))
    slope = F.covar_samp("y", "x") / F.var_samp("x")
    w = p.groupBy("series_id").agg(F.when(slope < 0, F.greatest(F.lit(20), F.floor(2 * math.log(2) / -slope))).otherwise(60).cast("int").alias("window_rows"))
    return rolling.zscore_by_length(b.join(w, "series_id"), "close", "window_rows").select("series_id", "dt", "window_rows", "z")


@query("src10_full_join", "WITH a AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 > 0 THEN c_acctbal END AS v FROM customer), b AS (SELECT o_custkey AS k, max(o_totalprice) AS w FROM orders GROUP BY 1) SELECT k, v, w, coalesce(v, w) AS value FROM a FULL JOIN b USING (k)", ["v", "w", "value"], ())
def full_join(spark, sf):
    """JN2, SRC10: two keyed series side by side, and the first one's value where it has one."""
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_acctbal")).alias("v"))
    b = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("w"))
    return a.join(b, "k", "full").withColumn("value", F.coalesce("v", "w"))



_MIXED = """k AS (SELECT 'monthly' AS key, date_trunc('month', o_orderdate)::DATE AS dt, avg(o_totalprice) AS value FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 2 UNION ALL SELECT 'daily', o_orderdate::DATE, max(o_totalprice) FROM orders WHERE o_orderstatus = 'P' GROUP BY 2),
s AS (SELECT unnest(generate_series((SELECT min(dt) - 10 FROM k), (SELECT max(dt) FROM k), INTERVAL 1 DAY))::DATE AS dt), d AS (SELECT dt FROM s WHERE isodow(dt) < 6),
m AS (SELECT d.dt, value AS x FROM d ASOF LEFT JOIN (SELECT * FROM k WHERE key = 'monthly') a ON d.dt >= a.dt), y AS (SELECT d.dt, value AS x FROM d ASOF LEFT JOIN (SELECT * FROM k WHERE key = 'daily') a ON d.dt >= a.dt)"""
_BACK = "first_value({x} IGNORE NULLS) OVER (ORDER BY dt ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)"


@query("fr2_mixed_frequencies", f"WITH {_MIXED} SELECT dt, {_BACK.format(x='m.x')} AS monthly, {_BACK.format(x='y.x')} AS daily FROM m JOIN y USING (dt)", ["monthly", "daily"])
def mixed(spark, sf):
    """FR2: a monthly and an irregular series on one spine of business days, side by side."""
    o = table(spark, sf, "orders")
    month = o.filter("o_orderpriority = '1-URGENT'").groupBy(F.to_date(F.date_trunc("month", "o_orderdate")).alias("dt")).agg(F.avg("o_totalprice").alias("value")).withColumn("key", F.lit("monthly"))
    daily = o.filter("o_orderstatus = 'P'").groupBy(F.to_date("o_orderdate").alias("dt")).agg(F.max("o_totalprice").alias("value")).withColumn("key", F.lit("daily"))
    return align.mixed_spine(month.unionByName(daily), ["monthly", "daily"], F.date_sub(F.min("dt"), 10), F.max("dt"))
