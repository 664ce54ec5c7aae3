"""SQL of the derived tables and features, in the dialect of the checking engine."""

from __future__ import annotations

WALK = """
  SELECT code, date, close, open, greatest(open, close) * (1.0 + tm / CAST(2000.0 AS DOUBLE)) AS high, least(open, close) * (1.0 - dm / CAST(2000.0 AS DOUBLE)) AS low, volume FROM (
    SELECT *, round(CAST(100.0 AS DOUBLE) * exp(cb / CAST(10000.0 AS DOUBLE)), 4) AS close,
           round(CAST(100.0 AS DOUBLE) * exp((cb - bp) / CAST(10000.0 AS DOUBLE)) * (CAST(1.0 AS DOUBLE) + CAST(0.2 AS DOUBLE) * (ts / (CAST(100.0 AS DOUBLE) * n) - CAST(0.04 AS DOUBLE))), 4) AS open
    FROM (SELECT *, CAST(sum(bp) OVER (PARTITION BY code ORDER BY date) AS BIGINT) AS cb FROM (
      SELECT *, CAST(floor(CAST(4000.0 AS DOUBLE) * (ds / (CAST(100.0 AS DOUBLE) * n) - CAST(0.05 AS DOUBLE))) AS BIGINT) AS bp FROM {src})))"""

_BARS = f"""
line AS (
  SELECT p_brand AS brand, 'S' || CAST(CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INT) % 5 AS VARCHAR) AS sector, CAST(l_shipdate AS DATE) AS date,
         CAST(round(100 * l_discount) AS BIGINT) AS d, CAST(round(100 * l_tax) AS BIGINT) AS t, CAST(l_quantity AS BIGINT) AS q
  FROM lineitem JOIN part ON l_partkey = p_partkey),
daily AS (
  SELECT brand AS code, date, count(*) AS n, CAST(sum(d) AS BIGINT) AS ds, CAST(sum(t) AS BIGINT) AS ts, max(d) AS dm, max(t) AS tm, CAST(sum(q) AS DOUBLE) AS volume FROM line GROUP BY 1, 2
  UNION ALL SELECT sector, date, count(*), CAST(sum(d) AS BIGINT), CAST(sum(t) AS BIGINT), max(d), max(t), CAST(sum(q) AS DOUBLE) FROM line GROUP BY 1, 2
  UNION ALL SELECT 'MKT', date, count(*), CAST(sum(d) AS BIGINT), CAST(sum(t) AS BIGINT), max(d), max(t), CAST(sum(q) AS DOUBLE) FROM line GROUP BY 1, 2),
bars AS (
  SELECT CASE WHEN code = 'MKT' THEN 'market' WHEN code LIKE 'S%' THEN 'sector' ELSE 'stock' END AS role, code,
         CASE WHEN code <> 'MKT' THEN 'S' || CAST(CAST(regexp_extract(code, '(\\d+)', 1) AS INT) % 5 AS VARCHAR) END AS sector, date, open, high, low, close, volume
  FROM ({WALK.format(src="daily")}))"""

_FEATURES = """
base AS (
  SELECT *, row_number() OVER w AS rn, close / lag(close) OVER w - 1 AS ret1, lag(close) OVER w AS prev,
    (close / lag(close, 5) OVER w - 1) * 100 AS r5, (close / lag(close, 20) OVER w - 1) * 100 AS r20, (close / lag(close, 60) OVER w - 1) * 100 AS r60,
    avg(close) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS s20, avg(close) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS s60,
    avg(close) OVER (w ROWS BETWEEN 29 PRECEDING AND 10 PRECEDING) AS s20_10,
    avg(volume) OVER (w ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS v20, avg(volume) OVER (w ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS v60
  FROM bars WINDOW w AS (PARTITION BY code ORDER BY date)),
vol AS (SELECT *, stddev_samp(ret1) OVER (PARTITION BY code ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) * sqrt(252) * 100 AS sd20 FROM base),
peak AS (
  SELECT a.code, a.rn, b.rn AS k, b.close / max(b.close) OVER (PARTITION BY a.code, a.rn ORDER BY b.rn) - 1 AS dd
  FROM base a JOIN base b ON a.code = b.code AND b.rn BETWEEN a.rn - 59 AND a.rn WHERE a.rn >= 80),
draw AS (SELECT code, rn, least(0, min(dd)) * 100 AS mdd FROM peak GROUP BY 1, 2),
bench AS (SELECT code AS bcode, date AS bdate, CASE WHEN rn > 20 THEN r20 END AS b20, CASE WHEN rn > 60 THEN r60 END AS b60 FROM vol WHERE role <> 'stock'),
asked AS (SELECT *, CASE WHEN role = 'stock' THEN sector WHEN role = 'sector' THEN 'MKT' END AS bcode FROM vol WHERE rn >= 80),
joined AS (SELECT a.*, b.b20, b.b60 FROM asked a ASOF LEFT JOIN bench b ON a.bcode = b.bcode AND a.date >= b.bdate),
features AS (
  SELECT j.role, j.code, j.sector, j.date, j.rn AS history_count, round(j.close, 6) AS close, round(r5, 6) AS return_5d_pct, round(r20, 6) AS return_20d_pct, round(r60, 6) AS return_60d_pct,
    round((j.close / s20 - 1) * 100, 6) AS ma20_gap_pct, round((s20 / s60 - 1) * 100, 6) AS ma20_vs_ma60_pct, round((s20 / s20_10 - 1) * 100, 6) AS ma20_slope_10d_pct,
    round(CASE WHEN v60 <> 0 THEN v20 / v60 END, 6) AS volume_20d_vs_60d, round(sd20, 6) AS volatility_20d_annualized_pct, round(d.mdd, 6) AS max_drawdown_60d_pct,
    round(r20 - b20, 6) AS relative_20d_pct, round(r60 - b60, 6) AS relative_60d_pct, s20 AS raw_ma20, s60 AS raw_ma60
  FROM joined j JOIN draw d ON j.code = d.code AND j.rn = d.rn)"""


def scaled(x: str, low: float, high: float, inverse: bool = False) -> str:
    y = f"greatest(0.0, least(100.0, (({x}) - ({low})) / ({high} - ({low}))::DOUBLE * 100))"
    y = f"(CASE WHEN ({x}) IS NOT NULL THEN {y} END)"
    return f"(100 - {y})" if inverse else y


def mean_of(parts: list[str]) -> str:
    top = " + ".join(f"coalesce({p}, 0)" for p in parts)
    n = " + ".join(f"(({p}) IS NOT NULL)::INT" for p in parts)
    return f"(({top}) / nullif({n}, 0)::DOUBLE)"


def weighted(parts: dict[str, str], weights: dict[str, float]) -> tuple[str, str]:
    top = " + ".join(f"coalesce({parts[k]} * {w}::DOUBLE, 0)" for k, w in weights.items())
    base = " + ".join(f"(CASE WHEN {parts[k]} IS NOT NULL THEN {w}::DOUBLE ELSE 0 END)" for k, w in weights.items())
    return f"round(({top}) / nullif({base}, 0), 3)", f"round(({base}) / {sum(weights.values())}, 3)"


def regime(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 'insufficient' WHEN {x} >= 65 THEN 'strong' WHEN {x} <= 35 THEN 'weak' ELSE 'mixed' END"


def bucket(x: str) -> str:
    return f"CASE WHEN {x} < 40 THEN '<40' WHEN {x} < 50 THEN '40-50' WHEN {x} < 60 THEN '50-60' WHEN {x} < 70 THEN '60-70' ELSE '>=70' END"


def with_(*parts: str) -> str:
    return "WITH " + ",".join(parts)


BARS, FEATURES = _BARS, _FEATURES


def steady(text: str) -> str:
    """The text with the same nudge in every round(x, n) as the engine's ``rnd``."""
    out, at = "", 0
    while (k := text.find("round(", at)) >= 0:
        depth, commas, i = 1, [], k + 6
        while depth:
            c = text[i]
            depth += (c == "(") - (c == ")")
            if c == "," and depth == 1:
                commas.append(i)
            i += 1
        if commas:
            out += text[at:k] + "round((" + steady(text[k + 6 : commas[-1]]) + ") + 1e-9::DOUBLE" + text[commas[-1] : i]
        else:
            out += text[at : k + 6] + steady(text[k + 6 : i - 1]) + ")"
        at = i
    return out + text[at:]
