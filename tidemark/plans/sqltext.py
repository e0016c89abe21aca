"""The canonical series as SQL text, and the frames that SQL of queries repeats."""

from __future__ import annotations

PRINTS = """prints AS (
  SELECT p_brand AS series_id, l_shipdate AS ts, l_extendedprice / l_quantity AS price, l_quantity AS volume, l_discount + l_tax AS load,
    (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS ord
  FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def bars(unit: str = "week") -> str:
    return f"""WITH {PRINTS}, bars AS (
  SELECT series_id, date_trunc('{unit}', ts)::DATE AS dt, arg_min(price, ord) AS open, max(price) AS high, min(price) AS low, arg_max(price, ord) AS close,
    sum(volume) AS volume, 5 + 100 * avg(load) AS iv FROM prints GROUP BY ALL),
b AS (SELECT *, row_number() OVER w AS rn, ln(close / lag(close) OVER w) AS r FROM bars WINDOW w AS (PARTITION BY series_id ORDER BY dt))"""


def frame(n: int, to: int = 0) -> str:
    end = "CURRENT ROW" if to == 0 else f"{-to} PRECEDING"
    return f"OVER (PARTITION BY series_id ORDER BY dt ROWS BETWEEN {n - 1} PRECEDING AND {end})"


ALL = "OVER (PARTITION BY series_id ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
W = "OVER (PARTITION BY series_id ORDER BY dt)"


def roll(x: str, n: int, agg: str = "avg", least: int | None = None) -> str:
    return f"CASE WHEN count({x}) {frame(n)} >= {n if least is None else least} THEN {agg}({x}) {frame(n)} END"


def z(x: str, n: int, least: int | None = None) -> str:
    return f"(({x}) - ({roll(x, n, 'avg', least)})) / nullif({roll(x, n, 'stddev_samp', least)}, 0)"


def ewm(src: str, x: str, out: str, alpha: float, adjust: bool = True, least: int = 1) -> str:
    """A CTE body: the sums over all earlier rows, written out."""
    d = 1 - alpha
    if adjust:
        value = f"sum(p.{x} * pow({d!r}::DOUBLE, c.rn - p.rn)) / sum(CASE WHEN p.{x} IS NOT NULL THEN pow({d!r}::DOUBLE, c.rn - p.rn) END)"
    else:
        value = f"sum(CASE WHEN p.k = 1 THEN 1 ELSE {alpha!r}::DOUBLE END * p.{x} * pow({d!r}::DOUBLE, c.rn - p.rn))"
    return f"""(SELECT c.series_id, c.dt, CASE WHEN count(p.{x}) >= {least} THEN {value} END AS {out}
      FROM {src} c JOIN (SELECT *, count({x}) {ALL} AS k FROM {src}) p ON p.series_id = c.series_id AND p.rn <= c.rn GROUP BY ALL)"""


def t_p_value(t: str, n: str, steps: int = 2000) -> str:
    """Two-sided p-value of Student's t with n degrees of freedom: Simpson's rule over the density's angle."""
    top = f"atan(abs({t}) / sqrt(({n})::DOUBLE))"
    weight = f"CASE WHEN i IN (0, {steps}) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    area = f"list_sum(list_transform(range(0, {steps + 1}), lambda i: ({weight}) * pow(cos({top} * i / {float(steps)}), ({n})::DOUBLE - 1))) * {top} / {float(3 * steps)}"
    return f"(1 - 2 * exp(lgamma((({n})::DOUBLE + 1) / 2) - lgamma(({n})::DOUBLE / 2)) / sqrt(pi()) * {area})"
