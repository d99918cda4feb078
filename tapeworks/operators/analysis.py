"""Whole-series analysis: descriptions, pairs, performance, trades, factors, forecasts, portfolios, bars from bars.

Each is one SQL text over {rows}, which Spark and DuckDB both run. Everything is a grouped or windowed aggregate:
sums and moments are partly aggregated before they are dealt; ranks and drawdowns sort within a series or date.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from tapeworks.plans.columns import rounded


def _q(spark: bool, x: str, q: float) -> str:
    return f"percentile({x}, {q!r})" if spark else f"quantile_cont({x}, {q!r})"


def _describe(spark: bool, trim: float = 0.1) -> str:
    """Moments (sample and population), type-7 quantiles, MAD, trimmed and winsorised means."""
    return f"""
WITH m AS (SELECT series, avg(x) AS mu, {_q(spark, "x", 0.5)} AS med, {_q(spark, "x", trim)} AS lo, {_q(spark, "x", 1 - trim)} AS hi, count(x) AS n FROM {{rows}} GROUP BY series),
d AS (SELECT r.series, r.x, m.mu, m.med, m.lo, m.hi, m.n, row_number() OVER (PARTITION BY r.series ORDER BY r.x, r.at_ms) AS k FROM {{rows}} r JOIN m ON r.series = m.series)
SELECT series, count(x) AS n, avg(x) AS mean, min(med) AS median, min(x) AS least, max(x) AS most, var_samp(x) AS variance, stddev_samp(x) AS sd,
  avg(pow(x - mu, 3)) / nullif(pow(var_pop(x), 1.5e0), 0) AS skewness, avg(pow(x - mu, 4)) / nullif(pow(var_pop(x), 2), 0) - 3 AS excess_kurtosis,
  {_q(spark, "x", 0.25)} AS q1, {_q(spark, "x", 0.75)} AS q3, {_q(spark, "x", 0.75)} - {_q(spark, "x", 0.25)} AS iqr, {_q(spark, "abs(x - med)", 0.5)} AS mad,
  avg(CASE WHEN k > floor({trim} * n) AND k <= n - floor({trim} * n) THEN x END) AS trimmed_mean, avg(least(greatest(x, lo), hi)) AS winsorised_mean
FROM d GROUP BY series"""


_RANK = "(rank() OVER (PARTITION BY {keys} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys}, {x}) - 1) / 2e0)"


def _pair(spark: bool) -> str:
    """Pearson, Spearman by average ranks, covariance, least squares and its R squared."""
    return f"""
WITH r AS (SELECT series, x, y, {_RANK.format(keys="series", x="x")} AS rx, {_RANK.format(keys="series", x="y")} AS ry FROM {{rows}})
SELECT series, count(*) AS n, corr(x, y) AS pearson, corr(rx, ry) AS spearman, covar_samp(x, y) AS covariance, var_samp(x) AS var_x, var_samp(y) AS var_y,
  covar_pop(x, y) / nullif(var_pop(x), 0) AS slope, avg(y) - covar_pop(x, y) / nullif(var_pop(x), 0) * avg(x) AS intercept,
  pow(corr(x, y), 2) AS r_squared, sqrt(var_pop(y) * (1 - pow(corr(x, y), 2))) AS residual_sd FROM r GROUP BY series"""


def _performance(spark: bool, per_year: float = 252.0, confidence: float = 0.95) -> str:
    """Compounded and annualised return, volatility, Sharpe, Sortino, drawdown, Calmar, and tail risk by the inverse distribution."""
    o = "(PARTITION BY series ORDER BY at_ms ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    q = 1 - confidence
    return f"""
WITH g AS (SELECT series, at_ms, x, sum(ln(1 + x)) OVER {o} AS lw, row_number() OVER (PARTITION BY series ORDER BY x, at_ms) AS k, count(*) OVER (PARTITION BY series) AS n FROM {{rows}} WHERE x > -1),
p AS (SELECT *, exp(lw) AS wealth, greatest(max(exp(lw)) OVER {o}, 1e0) AS peak FROM g),
a AS (SELECT series, count(*) AS n, exp(sum(ln(1 + x))) - 1 AS cumulative_return, exp(sum(ln(1 + x)) * {per_year} / count(*)) - 1 AS annual_return,
  stddev_samp(x) * sqrt({per_year}) AS annual_volatility, avg(x) / nullif(stddev_samp(x), 0) * sqrt({per_year}) AS sharpe,
  avg(x) / nullif(sqrt(avg(pow(least(x, 0e0), 2))), 0) * sqrt({per_year}) AS sortino, max(1 - wealth / peak) AS max_drawdown,
  sum(CASE WHEN wealth < peak THEN 1 ELSE 0 END) AS rows_under_water, -max(CASE WHEN k <= ceil({q!r} * n) THEN x END) AS value_at_risk,
  -(sum(CASE WHEN k <= floor({q!r} * n) THEN x ELSE 0e0 END) + sum(CASE WHEN k = floor({q!r} * n) + 1 THEN x * ({q!r} * n - floor({q!r} * n)) ELSE 0e0 END)) / nullif({q!r} * max(n), 0) AS expected_shortfall
  FROM p GROUP BY series)
SELECT *, annual_return / nullif(max_drawdown, 0) AS calmar FROM a"""


def _trades(spark: bool, costs: float = 0.5) -> str:
    """Closed trades (a return of x is a gross profit of 1000 x): wins, losses, payoff, profit factor, longest streaks."""
    return f"""
WITH t AS (SELECT series, at_ms, 1000 * x - {costs} AS pnl, row_number() OVER (PARTITION BY series ORDER BY at_ms) AS i FROM {{rows}}),
s AS (SELECT *, i - row_number() OVER (PARTITION BY series, sign(pnl) ORDER BY at_ms) AS island FROM t),
r AS (SELECT series, sign(pnl) AS side, island, count(*) AS n FROM s GROUP BY series, sign(pnl), island),
l AS (SELECT series, max(CASE WHEN side > 0 THEN n ELSE 0 END) AS longest_wins, max(CASE WHEN side < 0 THEN n ELSE 0 END) AS longest_losses FROM r GROUP BY series),
a AS (SELECT series, count(*) AS trades, sum(CASE WHEN pnl > 0 THEN 1 ELSE 0 END) AS wins, sum(CASE WHEN pnl < 0 THEN 1 ELSE 0 END) AS losses, sum(pnl) AS net,
  sum(greatest(pnl, 0e0)) AS gross_profit, sum(greatest(-pnl, 0e0)) AS gross_loss FROM t GROUP BY series)
SELECT a.*, wins * 1e0 / trades AS win_rate, net / trades AS expectancy, gross_profit / nullif(gross_loss, 0) AS profit_factor,
  (gross_profit / nullif(wins, 0)) / nullif(gross_loss / nullif(losses, 0), 0) AS payoff, longest_wins, longest_losses FROM a JOIN l ON a.series = l.series"""


_PANEL = """p AS (SELECT series AS asset, at_ms, x AS score, lead(x) OVER (PARTITION BY series ORDER BY at_ms) AS future FROM {rows})"""


def _factor(spark: bool, least: int = 3) -> str:
    """Per date: coverage, information coefficient, rank IC and hit rate of a score against the next return."""
    return f"""
WITH {_PANEL}, k AS (SELECT asset, at_ms, score, future FROM p WHERE future IS NOT NULL),
r AS (SELECT *, {_RANK.format(keys="at_ms", x="score")} AS rs, {_RANK.format(keys="at_ms", x="future")} AS rf FROM k)
SELECT 'all' AS series, at_ms, count(*) AS coverage, covar_pop(score, future) / nullif(sqrt(var_pop(score) * var_pop(future)), 0) AS ic,
  covar_pop(rs, rf) / nullif(sqrt(var_pop(rs) * var_pop(rf)), 0) AS rank_ic, avg(CASE WHEN score * future > 0 THEN 1e0 ELSE 0e0 END) AS hit_rate
FROM r GROUP BY at_ms HAVING count(*) >= {least}"""


def _factor_summary(spark: bool) -> str:
    """Mean, deviation and ratio of the dates' rank ICs."""
    return f"SELECT 'all' AS series, count(*) AS dates, avg(rank_ic) AS mean_rank_ic, stddev_samp(rank_ic) AS sd_rank_ic, avg(rank_ic) / nullif(stddev_samp(rank_ic), 0) AS icir, avg(ic) AS mean_ic, avg(hit_rate) AS hit_rate FROM ({_factor(spark)}) f"


_FORECASTS = "f AS (SELECT series, at_ms, 1 / (1 + exp(-3 * x)) AS p, CASE WHEN lead(x) OVER (PARTITION BY series ORDER BY at_ms) > 0 THEN 1e0 ELSE 0e0 END AS hit FROM {rows})"


def _calibration(spark: bool, bins: int = 10) -> str:
    """Brier score and its skill, log loss, and expected and largest calibration errors over equal bins."""
    return f"""
WITH {_FORECASTS}, b AS (SELECT *, least(floor(p * {bins}), {bins - 1}) AS bin FROM f),
g AS (SELECT series, bin, count(*) AS n, avg(p) AS mp, avg(hit) AS mh FROM b GROUP BY series, bin),
e AS (SELECT series, sum(n * abs(mp - mh)) / sum(n) AS ece, max(abs(mp - mh)) AS mce, count(*) AS bins_used FROM g GROUP BY series),
a AS (SELECT series, count(*) AS n, avg(pow(p - hit, 2)) AS brier, 1 - avg(pow(p - hit, 2)) / nullif(var_pop(hit), 0) AS brier_skill,
  -avg(hit * ln(greatest(p, 1e-15)) + (1 - hit) * ln(greatest(1 - p, 1e-15))) AS log_loss FROM f GROUP BY series)
SELECT a.*, ece, mce, bins_used FROM a JOIN e ON a.series = e.series"""


def _reliability(spark: bool, bins: int = 10) -> str:
    """One row per bin: forecasts, mean forecast, observed frequency and its Wilson interval."""
    z = 1.959963984540054
    return f"""
WITH {_FORECASTS}, g AS (SELECT series, least(floor(p * {bins}), {bins - 1}) AS bin, count(*) AS n, avg(p) AS mean_forecast, avg(hit) AS observed FROM f GROUP BY 1, 2)
SELECT series, bin, n, mean_forecast, observed,
  (observed + {z * z!r} / (2 * n) - {z!r} * sqrt((observed * (1 - observed) + {z * z!r} / (4 * n)) / n)) / (1 + {z * z!r} / n) AS low,
  (observed + {z * z!r} / (2 * n) + {z!r} * sqrt((observed * (1 - observed) + {z * z!r} / (4 * n)) / n)) / (1 + {z * z!r} / n) AS high FROM g"""


def _portfolio(spark: bool) -> str:
    """Equal weights: each asset's covariance with the portfolio, its share of variance, and the concentration."""
    return """
WITH w AS (SELECT count(DISTINCT series) AS k FROM {rows}),
full_ AS (SELECT at_ms FROM {rows} GROUP BY at_ms HAVING count(*) = (SELECT k FROM w)),
r AS (SELECT q.series, q.at_ms, q.x, avg(q.x) OVER (PARTITION BY q.at_ms) AS total FROM {rows} q JOIN full_ ON q.at_ms = full_.at_ms)
SELECT series, 1e0 / (SELECT k FROM w) AS weight, var_samp(x) AS variance, covar_samp(x, total) AS covariance, covar_samp(x, total) / (SELECT k FROM w) / nullif(var_samp(total), 0) AS risk_share,
  sqrt(var_samp(total)) AS portfolio_volatility, 1e0 / (SELECT k FROM w) AS concentration FROM r GROUP BY series"""


def _covariances(spark: bool) -> str:
    """Covariance and correlation of each two assets over the times that both have."""
    return """
SELECT a.series AS series, b.series AS other, count(*) AS n, covar_samp(a.x, b.x) AS covariance, covar_pop(a.x, b.x) / nullif(sqrt(var_pop(a.x) * var_pop(b.x)), 0) AS correlation
FROM {rows} a JOIN {rows} b ON a.at_ms = b.at_ms AND a.series <= b.series GROUP BY a.series, b.series"""


def _transform(spark: bool, k: int = 1) -> str:
    """Lag, difference, simple, log and cumulative return of a level."""
    w = "(PARTITION BY series ORDER BY at_ms)"
    return f"""SELECT series, at_ms, lag(x, {k}) OVER {w} AS lagged, x - lag(x, {k}) OVER {w} AS difference, x / nullif(lag(x, {k}) OVER {w}, 0) - 1 AS simple_return,
  ln(x / nullif(lag(x, {k}) OVER {w}, 0)) AS log_return, x / first_value(x) OVER {w} - 1 AS cumulative_return FROM {{rows}}"""


def _resample(spark: bool, factor: int = 4, step_ms: int = 3_600_000) -> str:
    """Longer candles from candles, by time; buckets are floored."""
    first, last = ("min_by(o, at_ms)", "max_by(c, at_ms)") if spark else ("arg_min(o, at_ms)", "arg_max(c, at_ms)")
    return f"""SELECT series, CAST(ceil(at_ms / {float(factor * step_ms)!r}) * {factor * step_ms} AS BIGINT) AS bar_ms, {first} AS open, max(h) AS high, min(l) AS low, {last} AS close, sum(v) AS volume, count(*) AS bars
FROM {{rows}} GROUP BY series, CAST(ceil(at_ms / {float(factor * step_ms)!r}) * {factor * step_ms} AS BIGINT)"""


def _gap_fill(spark: bool, step_ms: int = 3_600_000) -> str:
    """Flat candles of no volume in the gaps between a series' bars: each bar fills up to the next."""
    steps = f"sequence(at_ms, coalesce(nxt - {step_ms}, at_ms), {step_ms})" if spark else f"generate_series(at_ms, coalesce(nxt - {step_ms}, at_ms), {step_ms})"
    made = f"explode({steps})" if spark else f"unnest({steps})"
    return f"""
WITH n AS (SELECT *, lead(at_ms) OVER (PARTITION BY series ORDER BY at_ms) AS nxt FROM {{rows}}),
e AS (SELECT series, o, h, l, c, v, at_ms AS own, {made} AS t FROM n)
SELECT series, t AS at_ms, CASE WHEN t = own THEN o ELSE c END AS open, CASE WHEN t = own THEN h ELSE c END AS high, CASE WHEN t = own THEN l ELSE c END AS low, c AS close, CASE WHEN t = own THEN v ELSE 0e0 END AS volume FROM e"""


def _ecdf(spark: bool) -> str:
    """The empirical distribution: each distinct value with the share of values up to it."""
    return "SELECT DISTINCT series, x, cume_dist() OVER (PARTITION BY series ORDER BY x) AS share FROM {rows}"


def _autocovariance(spark: bool, lags: int = 5) -> str:
    """Autocorrelations at the first lags, and the Newey-West variance of the mean with Bartlett weights."""
    w = "(PARTITION BY series ORDER BY at_ms)"
    d = ", ".join(f"lag(x - mu, {k}) OVER {w} AS d{k}" for k in range(1, lags + 1))
    acf = ", ".join(f"sum((x - mu) * d{k}) / nullif(sum(pow(x - mu, 2)), 0) AS acf_{k}" for k in range(1, lags + 1))
    hac = " + ".join(f"{2 * (1 - k / (lags + 1))!r} * sum((x - mu) * d{k})" for k in range(1, lags + 1))
    return f"""
WITH m AS (SELECT *, avg(x) OVER (PARTITION BY series) AS mu FROM {{rows}}), z AS (SELECT series, x, mu, {d} FROM m)
SELECT series, count(*) AS n, {acf}, (sum(pow(x - mu, 2)) + {hac}) / (count(*) * count(*) * 1e0) AS hac_variance_of_mean FROM z GROUP BY series"""


def _step_up(spark: bool, level: float = 0.1) -> str:
    """Benjamini-Hochberg on two-sided p-values of the series' hourly mean returns (normal approximation by a logistic)."""
    return f"""
WITH t AS (SELECT series, CAST(floor(at_ms / 86400000e0) AS BIGINT) AS day, avg(x) / nullif(stddev_samp(x) / sqrt(count(*)), 0) AS stat FROM {{rows}} GROUP BY 1, 2),
p AS (SELECT series, day, 2 / (1 + exp(1.702e0 * abs(stat))) AS p FROM t WHERE stat IS NOT NULL),
k AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY p, day) AS i, count(*) OVER (PARTITION BY series) AS n FROM p),
b AS (SELECT *, max(CASE WHEN p <= {level} * i / n THEN i ELSE 0 END) OVER (PARTITION BY series) AS cut FROM k)
SELECT series, day, p, least(min(p * n / i) OVER (PARTITION BY series ORDER BY i DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1e0) AS adjusted, CASE WHEN i <= cut THEN 1e0 ELSE 0e0 END AS rejected FROM b"""


#: Input kind, SQL, and the columns that are rounded.
ANALYSES = {
    "describe": ("scalar", _describe, "mean median least most variance sd skewness excess_kurtosis q1 q3 iqr mad trimmed_mean winsorised_mean"),
    "pair_statistics": ("pair", _pair, "pearson spearman covariance var_x var_y slope intercept r_squared residual_sd"),
    "performance": ("return", _performance, "cumulative_return annual_return annual_volatility sharpe sortino max_drawdown value_at_risk expected_shortfall calmar"),
    "trade_summary": ("return", _trades, "net gross_profit gross_loss win_rate expectancy profit_factor payoff"),
    "factor_evaluation": ("return", _factor, "ic rank_ic hit_rate"),
    "factor_summary": ("return", _factor_summary, "mean_rank_ic sd_rank_ic icir mean_ic hit_rate"),
    "calibration_evaluation": ("return", _calibration, "brier brier_skill log_loss ece mce"),
    "reliability_bins": ("return", _reliability, "mean_forecast observed low high"),
    "portfolio_risk": ("return", _portfolio, "weight variance covariance risk_share portfolio_volatility concentration"),
    "covariance_matrix": ("return", _covariances, "covariance correlation"),
    "series_transform": ("scalar", _transform, "lagged difference simple_return log_return cumulative_return"),
    "resample_candles": ("candle", _resample, "open high low close volume"),
    "fill_gaps": ("candle", _gap_fill, "open high low close volume"),
    "ecdf": ("scalar", _ecdf, "x share"),
    "autocovariance": ("return", _autocovariance, "acf_1 acf_2 acf_3 acf_4 acf_5 hac_variance_of_mean"),
    "step_up_tests": ("return", _step_up, "p adjusted"),
}


def text(name: str, rows: str, spark: bool, digits: int | None = None, **params) -> str:
    _, make, numbers = ANALYSES[name]
    sql = make(spark, **params).replace("{rows}", rows)
    if digits is None:
        return sql
    kept = numbers.split()
    shown = ", ".join(f"{rounded(c, digits)} AS {c}" for c in kept)
    return f"SELECT * {'EXCEPT' if spark else 'EXCLUDE'} ({', '.join(kept)}), {shown} FROM ({sql}) z"


def analyse(df: DataFrame, name: str, digits: int | None = None, **params) -> DataFrame:
    """The analysis of rows of its input kind (series, at_ms and the kind's columns)."""
    return df.sparkSession.sql(text(name, "{rows}", True, digits, **params), rows=df)
