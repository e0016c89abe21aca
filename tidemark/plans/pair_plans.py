"""Queries over currency pairs: each brand's bars stand for a currency's price, nations of one region for its pairs."""

from __future__ import annotations


from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.operators import align, pairs, rolling
from tidemark.operators.ewm import halflife
from tidemark.operators.rolling import lag, roll
from tidemark.plans import sqltext as S
from tidemark.plans.boards import LAST
from tidemark.plans.registry import query
from tidemark.plans.series_plans import B, bars
from tidemark.sources import views
from tidemark.sources.views import table

_CODE = "CASE WHEN k = 0 THEN 'USD' ELSE printf('N%02d', k) END"
_LEGS = f"""{B}, n0 AS (SELECT *, split_part(series_id, '#', 2)::INT - 1 AS k FROM b),
legs AS (SELECT series_id, k, {_CODE} AS code, dt, rn, close, CASE WHEN k % 2 = 0 THEN 'USD' || ({_CODE}) ELSE ({_CODE}) || 'USD' END AS pair, CASE WHEN k % 2 = 0 THEN 1000 / close ELSE close / 1000 END AS px FROM n0 WHERE k > 0),
usd AS (SELECT series_id, k, code, dt, rn, pair, px, CASE WHEN starts_with(pair, 'USD') THEN pair ELSE substr(pair, 4, 3) || substr(pair, 1, 3) END AS usd_pair, CASE WHEN starts_with(pair, 'USD') THEN px ELSE 1 / px END AS usd_px FROM legs)"""


def code(k):
    return F.when(k == 0, "USD").otherwise(F.format_string("N%02d", k))


def legs(spark, sf):
    """series_id, k, code, dt, close, pair and px: a brand's close as the price of a currency, quoted either way round."""
    k = (F.split_part("series_id", F.lit("#"), F.lit(2)).cast("int") - 1).alias("k")
    b = views.bars(spark, sf).select("series_id", k, "dt", "close").filter("k > 0").withColumn("code", code(F.col("k")))
    even = F.col("k") % 2 == 0
    return b.withColumns({"pair": F.when(even, F.concat(F.lit("USD"), "code")).otherwise(F.concat("code", F.lit("USD"))), "px": F.when(even, 1000 / F.col("close")).otherwise(F.col("close") / 1000)})


def against_usd(spark, sf):
    name, price = pairs.to_base(F.col("pair"), F.col("px"))
    return legs(spark, sf).withColumns({"usd_pair": name, "usd_px": price})


@query("pr3_pr4_restated_pairs", f"{_LEGS} SELECT dt, pair, substr(pair, 1, 3) AS base, substr(pair, 4, 3) AS quote, px, usd_pair, usd_px FROM usd", ["px", "usd_px"])
def restated(spark, sf):
    """PR3, PR4: pairs split into their codes, and all quoted from the dollar."""
    base, quote = pairs.split(F.col("pair"))
    return against_usd(spark, sf).select("dt", "pair", base.alias("base"), quote.alias("quote"), "px", "usd_pair", "usd_px")


_MEANS = ", ".join(f"e{h} AS {S.ewm('lp', 'x', f'm{h}', halflife(h), True, h)}" for h in (8, 16, 24, 32, 48, 96))
_JOINED = " ".join(f"JOIN e{h} USING (series_id, dt)" for h in (8, 16, 24, 32, 48, 96))
_TREND = f"""{_LEGS}, lp AS (SELECT series_id, code, dt, rn, ln(usd_px) AS x FROM usd), {_MEANS},
y AS (SELECT lp.series_id, lp.code, lp.dt, lp.x, {', '.join(f"(m{s} - m{l}) / nullif({S.roll('x', 63, 'stddev_samp')}, 0) AS y{k}" for k, (s, l) in enumerate(pairs.HORIZONS))} FROM lp {_JOINED}),
z AS (SELECT *, {', '.join(f"y{k} / nullif({S.roll(f'y{k}', 252, 'stddev_samp')}, 0) AS z{k}" for k in range(3))} FROM y),
t AS (SELECT series_id, code, dt, x, ({' + '.join(f'z{k} * exp(-z{k} * z{k} / 4) / {pairs.SCALE}' for k in range(3))}) / 3 AS score, ({' + '.join(f'CASE WHEN z{k} IS NOT NULL THEN greatest(-2, least(2, z{k})) / 2 END' for k in range(3))}) / 3 AS clipped FROM z)"""
_TREND = _TREND.replace(f"nullif({S.roll('x', 63, 'stddev_samp')}, 0)", f"nullif({S.roll('x', 63, 'stddev_samp').replace('series_id', 'lp.series_id').replace('ORDER BY dt', 'ORDER BY lp.dt')}, 0)")


def trends(spark, sf):
    return pairs.trend_score(pairs.trend_score(against_usd(spark, sf), F.col("usd_px")), F.col("usd_px"), damp=False, out="clipped")


@query("wn22_trend_score", f"{_TREND} SELECT code, dt, score, clipped FROM t", ["score", "clipped"])
def trend(spark, sf):
    """WN22: the trend of three horizons, damped, and clipped."""
    return trends(spark, sf).select("code", "dt", "score", "clipped")


@query("wn24_vol_targeted_weights", f"{_TREND}, r AS (SELECT *, x - lag(x) {S.W} AS r FROM t), w AS (SELECT code, dt, lag(score) {S.W} * 0.10 / nullif(({S.roll('r', 63, 'stddev_samp')}) * sqrt(252::DOUBLE), 0) AS w FROM r) SELECT code, dt, CASE WHEN w IS NOT NULL THEN greatest(-2, least(2, w)) END AS weight FROM w", ["weight"])
def targeted(spark, sf):
    """WN24: yesterday's trend as a weight for a target volatility."""
    b = pairs.trend_score(against_usd(spark, sf), F.col("usd_px"))
    b = b.withColumn("r", F.log(F.col("usd_px") / lag(F.col("usd_px"))))
    return b.select("code", "dt", pairs.vol_target(F.col("score"), F.col("r")).alias("weight"))


_PAIRS = f"p AS (SELECT {_CODE.replace('k', 'a.n_nationkey')} AS base, {_CODE.replace('k', 'z.n_nationkey')} AS quote FROM nation a JOIN nation z ON z.n_regionkey = a.n_regionkey AND a.n_nationkey < z.n_nationkey)"


def regional(spark, sf):
    """base, quote: pairs of nations of one region."""
    n = table(spark, sf, "nation").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").cast("int").alias("k"))
    both = n.withColumnRenamed("k", "a").join(n.withColumnRenamed("k", "z"), "region").filter("a < z")
    return both.select(code(F.col("a")).alias("base"), code(F.col("z")).alias("quote"))


@query("jn9_cross_scores", f"{_TREND}, {_PAIRS} SELECT p.base, p.quote, a.dt, (z.score - a.score) / 2 AS score FROM p JOIN t a ON a.code = p.base JOIN t z ON z.code = p.quote AND z.dt = a.dt", ["score"])
def crosses(spark, sf):
    """JN9: pairs without the dollar from the scores of their legs."""
    return pairs.cross_scores(pairs.trend_score(against_usd(spark, sf), F.col("usd_px")).select("code", "dt", "score"), regional(spark, sf))


# A nation's yearly orders per customer stand for its activity, its suppliers' and customers' balances for rates and prices.
_DIM = f"""yearly AS (SELECT c_nationkey AS k, year(o_orderdate) AS y, sum(o_totalprice) / 365.25 / nullif(count(DISTINCT o_custkey), 0) AS pmi, avg(o_totalprice) / 1000 AS cpi FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY ALL),
moved AS (SELECT k, pmi, cpi, pmi - lag(pmi) OVER w AS pmi_mom, cpi - lag(cpi) OVER w AS cpi_mom FROM yearly WINDOW w AS (PARTITION BY k ORDER BY y) QUALIFY row_number() OVER (PARTITION BY k ORDER BY y DESC) = 1),
rates AS (SELECT s_nationkey AS k, avg(s_acctbal) / 1000 AS rate FROM supplier GROUP BY 1), policy AS (SELECT c_nationkey AS k, avg(c_acctbal) / 1000 AS policy FROM customer GROUP BY 1),
dim AS (SELECT {_CODE.replace('k', 'n_nationkey')} AS code, pmi, cpi, pmi_mom, cpi_mom, rate, policy, CASE WHEN n_nationkey % 7 <> 0 THEN (n_nationkey % 3 - 1)::INT END AS bias
  FROM nation LEFT JOIN moved ON moved.k = n_nationkey LEFT JOIN rates ON rates.k = n_nationkey LEFT JOIN policy ON policy.k = n_nationkey)"""


def dimension(spark, sf):
    """code, pmi, cpi, their last changes, rate, policy and bias (unknown for some) of each nation."""
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("k")), "o_custkey")
    y = o.groupBy("k", F.year("o_orderdate").alias("y")).agg((F.sum("o_totalprice") / 365.25 / F.nullif(F.countDistinct("o_custkey"), F.lit(0))).alias("pmi"), (F.avg("o_totalprice") / 1000).alias("cpi"))
    moved = [pairs.latest_change(y, "k", "y", c).withColumnRenamed("change", f"{c}_mom") for c in ("pmi", "cpi")]
    rates = table(spark, sf, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg((F.avg("s_acctbal") / 1000).alias("rate"))
    policy = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("k")).agg((F.avg("c_acctbal") / 1000).alias("policy"))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").cast("int").alias("k"))
    for side in (*moved, rates, policy):
        n = n.join(side, "k", "left")
    return n.withColumn("bias", F.when(F.col("k") % 7 != 0, (F.col("k") % 3 - 1).cast("int"))).withColumn("code", code(F.col("k"))).drop("k")


@query("wn30_latest_change", f"WITH {_DIM} SELECT code, pmi, pmi_mom, cpi, cpi_mom FROM dim", ["pmi", "pmi_mom", "cpi", "cpi_mom"], ())
def changes(spark, sf):
    """WN30: the latest value of each nation and its change, null where there is none before."""
    return dimension(spark, sf).select("code", "pmi", "pmi_mom", "cpi", "cpi_mom")


@query("jn10_leg_differentials", f"WITH {_DIM}, {_PAIRS} SELECT base, quote, CASE WHEN base = 'USD' THEN q.rate - a.rate ELSE a.rate - q.rate END AS diff FROM p LEFT JOIN dim a ON a.code = base LEFT JOIN dim q ON q.code = quote", ["diff"], ())
def differentials(spark, sf):
    """JN10: yields of the other currency less the dollar's, or of the first leg less the second's."""
    j = pairs.roles(regional(spark, sf), dimension(spark, sf).select("code", "rate"), "code")
    return j.select("base", "quote", pairs.leg_differential(F.col("base"), F.col("quote"), F.col("b_rate"), F.col("q_rate")).alias("diff"))


SPOT = f"""{_LEGS}, own AS (SELECT code, dt, usd_px FROM usd UNION ALL SELECT 'USD', dt, 1.0 FROM (SELECT DISTINCT dt FROM usd)), {_DIM}, {_PAIRS},
spot AS (SELECT base, quote, base || quote AS series_id, a.dt, z.usd_px / a.usd_px AS px FROM p JOIN own a ON a.code = base JOIN own z ON z.code = quote AND z.dt = a.dt),
ret AS (SELECT *, ln(px / lag(px) {S.W}) AS r FROM spot)"""


def spots(spark, sf):
    """base, quote, series_id (the pair), dt and px of regional pairs, from prices against the dollar."""
    usd = against_usd(spark, sf).select("code", "dt", "usd_px")
    own = usd.unionByName(usd.select(F.lit("USD").alias("code"), "dt", F.lit(1.0).alias("usd_px")).distinct())
    one = own.select(F.col("code").alias("base"), "dt", F.col("usd_px").alias("__b"))
    two = own.select(F.col("code").alias("quote"), "dt", F.col("usd_px").alias("__q"))
    j = regional(spark, sf).join(one, "base").join(two, ["quote", "dt"])
    return j.select("base", "quote", F.concat("base", "quote").alias("series_id"), "dt", (F.col("__q") / F.col("__b")).alias("px"))


_VOL = lambda n: f"({S.roll('r', n, 'stddev_samp')}) * sqrt(252::DOUBLE) * 100"
_MEANVOL = S.roll("v", 126)


BD2 = f"""{SPOT}, vol AS (SELECT *, {_VOL(21)} AS v, {_VOL(63)} AS v63 FROM ret), reg AS (SELECT *, {_MEANVOL} AS mean FROM vol {LAST}),
j AS (SELECT p.base, p.quote, a.rate AS rate_base, z.rate AS rate_quote, (z.rate - a.rate) * 100 AS rate_diff, z.cpi - a.cpi AS cpi_diff, v AS rvol_1m, v63 AS rvol_3m, mean FROM p LEFT JOIN dim a ON a.code = p.base LEFT JOIN dim z ON z.code = p.quote LEFT JOIN reg ON reg.base = p.base AND reg.quote = p.quote)
SELECT base, quote, rate_base, rate_quote, rate_diff, cpi_diff, rate_diff - cpi_diff * 100 AS real_carry, rvol_1m, rvol_3m, rate_diff / nullif(rvol_1m * 100, 0) AS carry_vol_1m, rate_diff / nullif(rvol_3m * 100, 0) AS carry_vol_3m,
  CASE WHEN rvol_1m / nullif(mean, 0) IS NULL THEN 'N/A' WHEN rvol_1m / nullif(mean, 0) > 1.3 THEN 'High' WHEN rvol_1m / nullif(mean, 0) < 0.7 THEN 'Low' ELSE 'Normal' END AS vol_regime FROM j"""


@query("bd2_carry_board", BD2,
    ["rate_base", "rate_quote", "rate_diff", "cpi_diff", "real_carry", "rvol_1m", "rvol_3m", "carry_vol_1m", "carry_vol_3m"], ())
def carry_board(spark, sf):
    """BD2, JN8, PR16, WN36: rate and real differentials of pairs, over realised volatility, and its regime."""
    from tidemark.plans.boards import last

    s = spots(spark, sf).withColumn("r", F.log(F.col("px") / lag(F.col("px"))))
    s = s.withColumns({"rvol_1m": rolling.realised_vol(F.col("r"), 21), "rvol_3m": rolling.realised_vol(F.col("r"), 63)}).withColumn("mean", roll(F.col("rvol_1m"), 126))
    vols = last(s, ["base", "quote", "rvol_1m", "rvol_3m", "mean"]).drop("series_id", "dt")
    j = pairs.roles(regional(spark, sf), dimension(spark, sf).select("code", "rate", "cpi"), "code").join(vols, ["base", "quote"], "left")
    diff, real = (F.col("q_rate") - F.col("b_rate")) * 100, F.col("q_cpi") - F.col("b_cpi")
    over = lambda v: diff / F.nullif(F.col(v) * 100, F.lit(0.0))
    return j.select(
        "base", "quote", F.col("b_rate").alias("rate_base"), F.col("q_rate").alias("rate_quote"), diff.alias("rate_diff"), real.alias("cpi_diff"), (diff - real * 100).alias("real_carry"), "rvol_1m", "rvol_3m",
        over("rvol_1m").alias("carry_vol_1m"), over("rvol_3m").alias("carry_vol_3m"), pairs.vol_regime(F.col("rvol_1m"), F.col("mean")).alias("vol_regime"),
    )


@query("wn36_vol_regime", f"{B}, v AS (SELECT series_id, dt, {_VOL(21)} AS v FROM b), m AS (SELECT *, {_MEANVOL} AS mean FROM v) SELECT series_id, dt, v AS vol, mean, CASE WHEN v / nullif(mean, 0) IS NULL THEN 'N/A' WHEN v / nullif(mean, 0) > 1.3 THEN 'High' WHEN v / nullif(mean, 0) < 0.7 THEN 'Low' ELSE 'Normal' END AS regime FROM m", ["vol", "mean"])
def regime(spark, sf):
    """WN36: volatility of 21 rows against its mean of 126."""
    b = bars(spark, sf).withColumn("vol", rolling.realised_vol(F.col("r"), 21)).withColumn("mean", roll(F.col("vol"), 126))
    return b.select("series_id", "dt", "vol", "mean", pairs.vol_regime(F.col("vol"), F.col("mean")).alias("regime"))


_NAME = lambda c: f"CASE coalesce({c}, 0) WHEN 1 THEN 'Hawkish' WHEN 0 THEN 'Neutral' WHEN -1 THEN 'Dovish' ELSE 'N/A' END"
_PMI = "CASE WHEN a.pmi - z.pmi IS NULL THEN 'N/A' WHEN a.pmi - z.pmi > 2 THEN 'Strong Bull' WHEN a.pmi - z.pmi > 0 THEN 'Mild Bull' WHEN a.pmi - z.pmi < -2 THEN 'Strong Bear' WHEN a.pmi - z.pmi < 0 THEN 'Mild Bear' ELSE 'Neutral' END"
_BD3 = ["pmi_base", "pmi_quote", "pmi_diff", "pmi_mom_diff", "cpi_base", "cpi_quote", "cpi_diff", "cpi_mom_diff", "policy_diff"]


BD3 = f"""WITH {_DIM}, {_PAIRS} SELECT base, quote, a.pmi AS pmi_base, z.pmi AS pmi_quote, a.pmi - z.pmi AS pmi_diff, {_PMI} AS pmi_signal, a.pmi_mom - z.pmi_mom AS pmi_mom_diff, a.cpi AS cpi_base, z.cpi AS cpi_quote, a.cpi - z.cpi AS cpi_diff, a.cpi_mom - z.cpi_mom AS cpi_mom_diff,
  {_NAME('a.bias')} AS bias_base, {_NAME('z.bias')} AS bias_quote, coalesce(a.bias, 0) - coalesce(z.bias, 0) AS bias_diff, {_NAME('a.bias')} || ' vs ' || {_NAME('z.bias')} AS bias_label, (a.policy - z.policy) * 100 AS policy_diff
FROM p LEFT JOIN dim a ON a.code = base LEFT JOIN dim z ON z.code = quote"""


@query("bd3_activity_board", BD3, _BD3, ())
def activity_board(spark, sf):
    """BD3, PR5, PR7: levels, differences and last changes of activity and prices, policy biases and rates of pairs."""
    j = pairs.roles(regional(spark, sf), dimension(spark, sf), "code")
    less = lambda c: F.col(f"b_{c}") - F.col(f"q_{c}")
    mine, other = F.coalesce("b_bias", F.lit(0)), F.coalesce("q_bias", F.lit(0))
    text = pairs.bias_text(mine, other)
    return j.select(
        "base", "quote", F.col("b_pmi").alias("pmi_base"), F.col("q_pmi").alias("pmi_quote"), less("pmi").alias("pmi_diff"), pairs.composite_signal(less("pmi")).alias("pmi_signal"), less("pmi_mom").alias("pmi_mom_diff"),
        F.col("b_cpi").alias("cpi_base"), F.col("q_cpi").alias("cpi_quote"), less("cpi").alias("cpi_diff"), less("cpi_mom").alias("cpi_mom_diff"),
        F.split_part(text, F.lit(" vs "), F.lit(1)).alias("bias_base"), F.split_part(text, F.lit(" vs "), F.lit(2)).alias("bias_quote"), (mine - other).alias("bias_diff"), text.alias("bias_label"), (less("policy") * 100).alias("policy_diff"),
    )


@query("pr11_surprises", """WITH s AS (SELECT o_orderpriority AS name, o_orderkey, o_totalprice AS actual, avg(o_totalprice) OVER w AS consensus, stddev_samp(o_totalprice) OVER w AS deviation FROM orders WINDOW w AS (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))
SELECT o_orderkey, name, actual - consensus AS diff, CASE WHEN deviation = 0 THEN 0 ELSE (actual - consensus) / nullif(deviation, 0) END AS z FROM s""", ["diff", "z"], ())  # fmt: skip
def surprises(spark, sf):
    """PR11: releases against the mean of the twelve before, in their deviations."""
    w = W.partitionBy("name").orderBy("o_orderdate", "o_orderkey").rowsBetween(-12, -1)
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderdate", F.col("o_orderpriority").alias("name"), F.col("o_totalprice").alias("actual"))
    o = o.withColumns({"consensus": F.avg("actual").over(w), "deviation": F.stddev_samp("actual").over(w)})
    return o.select("o_orderkey", "name", (F.col("actual") - F.col("consensus")).alias("diff"), pairs.surprise(F.col("actual"), F.col("consensus"), F.col("deviation")).alias("z"))


@query("pr14_issuer_universe", """WITH l AS (SELECT o_orderkey AS o, unnest([0, 1]) AS p, unnest([substr(o_orderpriority, 1, 1), o_orderstatus]) AS c FROM orders), s AS (SELECT c, min((o, p)) AS first FROM l GROUP BY c),
m AS (SELECT n_name AS issuer, min((first, c)) AS m FROM s JOIN nation ON (n_regionkey + 1)::VARCHAR = c GROUP BY 1) SELECT issuer, m[2] AS currency, m[1][1] AS seen FROM m""", (), ())  # fmt: skip
def universe(spark, sf):
    """PR14: issuers of the codes of all pairs, in the order in which the codes come up."""
    p = table(spark, sf, "orders").select("o_orderkey", F.substring("o_orderpriority", 1, 1).alias("base"), F.col("o_orderstatus").alias("quote"))
    dim = table(spark, sf, "nation").select((F.col("n_regionkey") + 1).cast("string").alias("c"), F.col("n_name"))
    return pairs.issuers(p, "o_orderkey", dim, "c", "n_name")


@query("pr15_ticker_texts", "SELECT p_partkey, upper(split_part(p_brand, '#', 1)) || split_part(p_brand, '#', 2) || 'V' || (p_size % 12 + 1)::VARCHAR || 'M Curve' AS ticker FROM part", (), ())
def ticker_texts(spark, sf):
    """PR15: tickers from a template."""
    b = F.col("p_brand")
    return table(spark, sf, "part").select("p_partkey", F.format_string("%s%sV%dM Curve", F.upper(F.split_part(b, F.lit("#"), F.lit(1))), F.split_part(b, F.lit("#"), F.lit(2)), (F.col("p_size") % 12 + 1).cast("int")).alias("ticker"))


FAIR = {"midpoint": "CASE WHEN upper IS NOT NULL AND lower IS NOT NULL THEN (upper + lower) / 2 ELSE effective END", "upper": "upper", "fixing": "fixing"}
BOUNDS = """m AS (SELECT o_orderpriority AS name, date_trunc('month', o_orderdate)::DATE AS mdt, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
wide AS (SELECT mdt, max(CASE WHEN name LIKE '1%' THEN v END) AS upper, max(CASE WHEN name LIKE '2%' AND month(mdt) % 5 > 0 THEN v END) AS lower, max(CASE WHEN name LIKE '3%' THEN v END) AS effective, max(CASE WHEN name LIKE '5%' THEN v END) AS fixing FROM m GROUP BY mdt),
dts AS (SELECT DISTINCT dt FROM b), fair AS (SELECT dts.dt, upper, lower, effective, fixing FROM dts ASOF LEFT JOIN wide ON dts.dt >= wide.mdt)"""


def bounds(spark, sf, dates):
    """dt with the bounds, effective rate and fixing last known by then; the lower bound is missing in some months."""
    names = {"upper": "1", "lower": "2", "effective": "3", "fixing": "5"}
    m = views.monthly(spark, sf).withColumn("key", F.create_map(*(F.lit(x) for k, v in names.items() for x in (v, k)))[F.substring("name", 1, 1)]).filter("key is not null")
    wide = m.filter("key <> 'lower' or month(dt) % 5 > 0").groupBy("dt").pivot("key", list(names)).agg(F.max("value"))
    packed = wide.select(F.lit(1).alias("one"), "dt", F.struct(*names).alias("known"))
    return align.asof(dates.select(F.lit(1).alias("one"), "dt"), packed, ["one"], "dt", "known").select("dt", "known.*")


def fair_value(source: str):
    """PR17: the choice of a fair value, made when the plan is built."""
    if source == "midpoint":
        return F.coalesce((F.col("upper") + F.col("lower")) / 2, F.col("effective"))
    return F.col({"upper": "upper", "fixing": "fixing"}[source])


@query("pr17_fair_values", f"{B}, {BOUNDS} SELECT dt, {', '.join(f'{q} AS {k}_value' for k, q in FAIR.items())} FROM fair", [f"{k}_value" for k in FAIR])
def fair_values(spark, sf):
    """PR17: each choice of fair value at every week."""
    f = bounds(spark, sf, views.bars(spark, sf).select("dt").distinct())
    return f.select("dt", *(fair_value(k).alias(f"{k}_value") for k in FAIR))


