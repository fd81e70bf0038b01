"""All registered queries and the SQL they are checked against.

Each entry names its columns once, for both sides: ``x:d`` is a double rounded to six places,
``x:p`` a price to two, ``x:i`` a long; others are as they are.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import config as C
from tidemark.functions.tables import once
from tidemark.functions.windows import framed, log_return, rolling, simple_return
from tidemark.operators import audit, backtest, compare, events, indicators, metrics, pathvol, regimes, resample, signals
from tidemark.plans import sql as S
from tidemark.sources.bars import derived_bars, derived_rates, hourly_bars

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Queries without SQL: the permutation tests with all draws, too many for DuckDB on whole tables.
UNCHECKED: dict[str, Query] = {}
SHOCK, GAP, DRAWS = 0.005, 3, 50


def shaped(df: DataFrame, columns: str) -> DataFrame:
    out = []
    for c in columns.split():
        name, _, kind = c.partition(":")
        x = F.col(name)
        out.append({"d": F.round(x, 6) + 0.0, "p": F.round(x, 2) + 0.0, "i": x.cast("long"), "": x}[kind].alias(name))
    return df.select(*out)


def shaped_sql(inner: str, columns: str) -> str:
    out = []
    for c in columns.split():
        name, _, kind = c.partition(":")
        out.append({"d": f"ROUND(CAST({name} AS DOUBLE), 6) + 0.0", "p": f"ROUND({name}, 2) + 0.0", "i": f"CAST({name} AS BIGINT)", "": name}[kind] + f" AS {name}")
    return f"SELECT {', '.join(out)} FROM ({inner}) _q"


def register(name: str, columns: str, query: Query, select: str, *needs: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: shaped(query(spark, sf_dir), columns)
    ORACLES[name] = shaped_sql(S.query(select, *needs), columns)


def register_unchecked(name: str, columns: str, query: Query) -> None:
    UNCHECKED[name] = lambda spark, sf_dir: shaped(query(spark, sf_dir), columns)


def on_bars(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(derived_bars(spark, d))


def on_frames(f: Callable[[DataFrame, DataFrame], DataFrame]) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows, calendar = events.frames(once(indicators.add_indicators(derived_bars(spark, sf_dir))))
        return f(rows, calendar)

    return run


S.CTE["months"] = (["rates"], "SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS m FROM rates")

# --- audit and windows
register("audit_coverage", "ticker first last n:i rows_per_year:d", on_bars(audit.coverage),
         "SELECT ticker, min(date) AS first, max(date) AS last, count(*) AS n, round(count(*) / (CAST(max(date) - min(date) AS DOUBLE) / 365.25), 1) AS rows_per_year FROM bars GROUP BY 1", "bars")
register("audit_nulls", "name n_null:i n_nonpositive:i", on_bars(audit.missing),
         " UNION ALL ".join(f"SELECT '{c}' AS name, count(*) - count({c}) AS n_null, coalesce(sum(CASE WHEN {c} <= 0 THEN 1 ELSE 0 END), 0) AS n_nonpositive FROM bars" for c in audit.COLUMNS), "bars")
register("audit_duplicates", "n_duplicate:i", on_bars(audit.duplicates), "SELECT count(*) - count(DISTINCT (ticker, date)) AS n_duplicate FROM bars", "bars")
register("audit_ohlc", "ticker n_violation:i adjustment:d", on_bars(audit.ohlc_summary),
         "SELECT ticker, sum(CASE WHEN high < low OR high < open OR high < close OR low > open OR low > close THEN 1 ELSE 0 END) AS n_violation, round(avg(abs(close - adj_close) / close), 6) AS adjustment FROM bars GROUP BY 1", "bars")
register("audit_gaps", "ticker after date days:i", on_bars(lambda b: audit.gaps(b, GAP)),
         f"SELECT * FROM (SELECT ticker, lag(date) OVER ({S.ORDER}) AS after, date, date - lag(date) OVER ({S.ORDER}) AS days FROM bars) WHERE days >= {GAP}", "bars")
register("shock_days", "ticker date daily_return:d", on_bars(lambda b: signals.shocks(b, SHOCK)),
         f"SELECT * FROM (SELECT ticker, date, close / lag(close) OVER ({S.ORDER}) - 1 AS daily_return FROM bars) WHERE abs(daily_return) >= {SHOCK}", "bars")
register("shock_pivot", "year:i down:i up:i", on_bars(lambda b: audit.shock_pivot(signals.shocks(b, SHOCK))),
         f"SELECT year(date) AS year, count(*) FILTER (WHERE r < 0) AS down, count(*) FILTER (WHERE r >= 0) AS up FROM (SELECT date, close / lag(close) OVER ({S.ORDER}) - 1 AS r FROM bars) WHERE abs(r) >= {SHOCK} GROUP BY 1", "bars")
register("shock_counts", "ticker n:i", on_bars(lambda b: audit.shock_counts(b, SHOCK)), f"SELECT ticker, count(*) FILTER (WHERE abs(r) >= {SHOCK}) AS n FROM (SELECT ticker, close / lag(close) OVER ({S.ORDER}) - 1 AS r FROM bars) GROUP BY 1", "bars")
SHOCKS = f"SELECT ticker, date, r AS daily_return FROM (SELECT ticker, date, close / lag(close) OVER ({S.ORDER}) - 1 AS r FROM bars) WHERE abs(r) >= {SHOCK}"
register("shock_extremes", "side nth:i ticker date daily_return:d", on_bars(lambda b: audit.extremes(signals.shocks(b, SHOCK))),
         f"SELECT * FROM (SELECT 'worst' AS side, row_number() OVER (ORDER BY daily_return, date, ticker) AS nth, * FROM ({SHOCKS}) UNION ALL SELECT 'best', row_number() OVER (ORDER BY daily_return DESC, date, ticker), * FROM ({SHOCKS})) WHERE nth <= 5", "bars")
register("gap_preview", "ticker after date days:i", on_bars(lambda b: audit.preview(audit.gaps(b, GAP))),
         f"SELECT * FROM (SELECT ticker, lag(date) OVER ({S.ORDER}) AS after, date, date - lag(date) OVER ({S.ORDER}) AS days FROM bars) WHERE days >= {GAP} ORDER BY ticker, date LIMIT 10", "bars")
BAD = "high < low OR high < open OR high < close OR low > open OR low > close"
register("audit_summary", "name item value:d", on_bars(lambda b: audit.summary(b, SHOCK, GAP)),
         "SELECT 'rows' AS name, ticker AS item, CAST(count(*) AS DOUBLE) AS value FROM bars GROUP BY ticker UNION ALL SELECT 'rows_per_year', ticker, round(count(*) / (CAST(max(date) - min(date) AS DOUBLE) / 365.25), 1) FROM bars GROUP BY ticker UNION ALL SELECT 'duplicates', '', count(*) - count(DISTINCT (ticker, date)) FROM bars"
         + "".join(f" UNION ALL SELECT 'nulls', '{c}', count(*) - count({c}) FROM bars UNION ALL SELECT 'nonpositive', '{c}', coalesce(sum(CASE WHEN {c} <= 0 THEN 1 ELSE 0 END), 0) FROM bars" for c in audit.COLUMNS)
         + f" UNION ALL SELECT 'violations', ticker, count(*) FILTER (WHERE {BAD}) FROM bars GROUP BY ticker UNION ALL SELECT 'gaps', ticker, count(*) FILTER (WHERE g >= {GAP}) FROM (SELECT ticker, date - lag(date) OVER ({S.ORDER}) AS g FROM bars) GROUP BY ticker"
         + f" UNION ALL SELECT 'shocks', ticker, count(*) FILTER (WHERE abs(r) >= {SHOCK}) FROM (SELECT ticker, close / lag(close) OVER ({S.ORDER}) - 1 AS r FROM bars) GROUP BY ticker", "bars")
register("audit_gate", "name item value:d ok", on_bars(audit.gate_record),
         f"SELECT 'duplicates' AS name, '' AS item, count(*) - count(DISTINCT (ticker, date)) AS value, count(*) = count(DISTINCT (ticker, date)) AS ok FROM bars UNION ALL SELECT 'violations', ticker, count(*) FILTER (WHERE {BAD}), count(*) FILTER (WHERE {BAD}) = 0 FROM bars GROUP BY ticker UNION ALL SELECT 'rows_per_year', ticker, r, coalesce(abs(r - 252) <= 10, false) FROM (SELECT ticker, round(count(*) / (CAST(max(date) - min(date) AS DOUBLE) / 365.25), 1) AS r FROM bars GROUP BY 1)", "bars")
register("calendar_differences", "date side", lambda s, d: audit.calendar_differences(derived_bars(s, d), derived_rates(s, d)),
         "SELECT DISTINCT date, 'price_only' AS side FROM bars WHERE date NOT IN (SELECT date FROM rates) UNION ALL SELECT DISTINCT date, 'rate_only' FROM rates WHERE date NOT IN (SELECT date FROM bars)", "bars", "rates")
register("log_return", "ticker date log_ret:d ret:d", on_bars(lambda b: b.withColumns({"log_ret": log_return(F.col("close")), "ret": simple_return(F.col("close"))})),
         f"SELECT ticker, date, lr AS log_ret, close / lag(close) OVER ({S.ORDER}) - 1 AS ret FROM nb", "nb")
register("rolling_abs_return", "ticker date value:d", on_bars(lambda b: b.withColumn("a", F.abs(log_return(F.col("close")))).withColumn("value", rolling(F.avg, F.col("a"), 20))),
         f"SELECT ticker, date, {S.full('avg', 'a', -19, 0)} AS value FROM (SELECT ticker, date, abs(lr) AS a FROM nb)", "nb")
register("true_range", "ticker date true_range:p tr_source", on_bars(indicators.true_range),
         "SELECT ticker, date, tr AS true_range, CASE WHEN tr IS NULL THEN NULL WHEN tr = hl THEN 'tr_hl' WHEN tr = hc THEN 'tr_hc' ELSE 'tr_lc' END AS tr_source FROM tr", "tr")
register("bollinger", "ticker date gap:d bb_percent_b:d bb_width:d", on_bars(lambda b: indicators.bollinger(b).withColumn("gap", F.col("bb_middle") / F.col("close"))),
         "SELECT ticker, date, mid / close AS gap, CASE WHEN up - dn = 0 THEN 0.5 ELSE (close - dn) / NULLIF(up - dn, 0) END AS bb_percent_b, (up - dn) / mid * 100 AS bb_width FROM bb", "bb")
register("regime_stats", "ticker regime n:i cum_return:d ann_log_return:d cagr:d volatility:d skew:d kurtosis:d skew_se:d kurtosis_se:d max_drawdown:d first last", on_bars(regimes.return_statistics),
         f"SELECT ticker, regime, count(*) AS n, exp(sum(lr)) - 1 AS cum_return, avg(lr) * 252 AS ann_log_return, pow(exp(sum(lr)), 252.0 / count(*)) - 1 AS cagr, stddev_samp(lr) * sqrt(252) AS volatility, skewness(lr) AS skew, kurtosis(lr) AS kurtosis, sqrt(6.0 / count(*)) AS skew_se, sqrt(24.0 / count(*)) AS kurtosis_se, min(dd) AS max_drawdown, min(date) AS first, max(date) AS last FROM (SELECT *, close / max(close) OVER (PARTITION BY ticker, regime ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM (SELECT *, {S.REGIME} AS regime FROM nb) WHERE lr IS NOT NULL AND regime IS NOT NULL) GROUP BY 1, 2", "nb")
WIDTH = f"SELECT ticker, {S.REGIME} AS regime, (up - dn) / mid * 100 AS x FROM bb WHERE mid IS NOT NULL"
DIST = f"SELECT ticker, regime, count(x) AS n, avg(x) AS mean, stddev_samp(x) AS std, stddev_samp(x) / abs(avg(x)) AS cv, quantile_cont(x, 0.05) AS q05, quantile_cont(x, 0.25) AS q25, quantile_cont(x, 0.5) AS q50, quantile_cont(x, 0.75) AS q75, quantile_cont(x, 0.95) AS q95, min(x) AS low, max(x) AS high FROM ({WIDTH}) WHERE regime IS NOT NULL GROUP BY 1, 2"
register("regime_distribution", "ticker regime n:i mean:d std:d cv:d q05:d q25:d q50:d q75:d q95:d low:d high:d", on_bars(lambda b: regimes.distribution(indicators.bollinger(b), "bb_width")), DIST, "bb")
register("regime_spread", "ticker max_mean:d min_mean:d max_regime min_regime ratio:d", on_bars(lambda b: regimes.spread(regimes.distribution(indicators.bollinger(b), "bb_width"))),
         f"SELECT ticker, max(mean) AS max_mean, min(mean) AS min_mean, max_by(regime, mean) AS max_regime, min_by(regime, mean) AS min_regime, max(mean) / min(mean) AS ratio FROM ({DIST}) GROUP BY 1", "bb")
register("hourly_bars", "ticker ts open:d high:d low:d close:d volume:i", hourly_bars,
         "SELECT event_type AS ticker, date_trunc('hour', ts) AS ts, min_by(value, ts) AS open, max(value) AS high, min(value) AS low, max_by(value, ts) AS close, count(*) AS volume FROM events WHERE value IS NOT NULL GROUP BY 1, 2")

# --- recursive indicators
register("rsi_simple", "ticker date rsi_simple_14:d", on_bars(indicators.rsi_simple),
         f"SELECT ticker, date, {S.rsi('ag', 'al')} AS rsi_simple_14 FROM (SELECT ticker, date, {S.full('avg', 'g', -13, 0)} AS ag, {S.full('avg', 'l', -13, 0)} AS al FROM gl)", "gl")
register("rsi_wilder", "ticker date rsi_wilder_14:d", on_bars(indicators.rsi_wilder), "SELECT ticker, date, rsi AS rsi_wilder_14 FROM ind", "ind")
register("rsi_wilder_first", "ticker date rsi_wilder_14_first:d", on_bars(lambda b: indicators.rsi_wilder(b, seed="first")),
         f"SELECT nb.ticker, nb.date, {S.rsi('fg.y', 'fl.y')} AS rsi_wilder_14_first FROM nb LEFT JOIN fg ON fg.ticker = nb.ticker AND fg.rn = nb.rn LEFT JOIN fl ON fl.ticker = nb.ticker AND fl.rn = nb.rn", "nb", "fg", "fl")
register("macd", "ticker date line:d signal:d hist:d", on_bars(lambda b: indicators.macd(b).selectExpr("ticker", "date", "macd_line / close * 100 AS line", "macd_signal / close * 100 AS signal", "macd_hist / close * 100 AS hist")),
         "SELECT ticker, date, line / close * 100 AS line, sig / close * 100 AS signal, (line - sig) / close * 100 AS hist FROM ind", "ind")
register("atr", "ticker date atr_pct:d", on_bars(lambda b: indicators.atr(b).withColumn("atr_pct", F.col("atr_14") / F.col("close") * 100)),
         "SELECT tr.ticker, tr.date, atr.y / tr.close * 100 AS atr_pct FROM tr LEFT JOIN atr ON atr.ticker = tr.ticker AND atr.rn = tr.rn", "tr", "atr")

# --- signals and events
register("signals_long", "ticker date signal_id condition signal", on_bars(lambda b: signals.make_signals(indicators.add_indicators(b))), "SELECT ticker, date, signal_id, condition, signal FROM sigs", "sigs")
register("s3_bollinger_events", "ticker date", on_bars(lambda b: signals.make_signals(indicators.bollinger(b), [x for x in signals.SIGNALS if x[0] == "S3"]).where("signal")),
         f"SELECT ticker, date FROM (SELECT *, coalesce(close < dn, false) AND NOT coalesce(lag(coalesce(close < dn, false)) OVER ({S.ORDER}), false) AS e FROM bb) WHERE e", "bb")
register("forward_returns", "ticker date fwd_ret_1:d fwd_ret_5:d fwd_ret_10:d fwd_ret_20:d", on_bars(signals.forward_returns), "SELECT ticker, date, f1 AS fwd_ret_1, f5 AS fwd_ret_5, f10 AS fwd_ret_10, f20 AS fwd_ret_20 FROM fwd", "fwd")
register("signal_counts", "signal_id days:i level_days:i events:i level_pct:d mean_duration:d", on_frames(lambda r, _: events.signal_counts(r)),
         "SELECT signal_id, count(*) AS days, count(*) FILTER (WHERE condition) AS level_days, count(*) FILTER (WHERE signal) AS events, count(*) FILTER (WHERE condition) * 100.0 / count(*) AS level_pct, CAST(count(*) FILTER (WHERE condition) AS DOUBLE) / NULLIF(count(*) FILTER (WHERE signal), 0) AS mean_duration FROM ev GROUP BY 1", "ev")
register("run_lengths", "signal_id n:i mean:d median:d p90:d longest:i", on_frames(lambda r, _: events.run_lengths(r)),
         "SELECT signal_id, count(*) AS n, avg(c) AS mean, median(c) AS median, quantile_cont(c, 0.9) AS p90, max(c) AS longest FROM (SELECT signal_id, run, count(*) AS c FROM (SELECT *, sum(CAST(signal AS INT)) OVER (PARTITION BY signal_id ORDER BY date) AS run FROM ev) WHERE condition GROUP BY 1, 2) GROUP BY 1", "ev")
register("regime_crosstab", "signal_id " + " ".join(f"{r.key}:i" for r in C.REGIMES), on_frames(lambda r, _: events.contingency(r)),
         "SELECT signal_id, " + ", ".join(f"count(*) FILTER (WHERE regime = '{r.key}') AS {r.key}" for r in C.REGIMES) + " FROM ev WHERE signal GROUP BY 1", "ev")
register("horizon_baseline", "h:i n_all:i mean_all:d sd_all:d", on_frames(lambda _, c: events.baseline(c)), "SELECT h, count(ret) AS n_all, avg(ret) AS mean_all, stddev_samp(ret) AS sd_all FROM calh GROUP BY 1", "calh")
register("event_study", "signal_id h:i n:i mean:d median:d sd:d win_pct:d n_all:i mean_all:d sd_all:d difference:d", on_frames(events.event_study), "SELECT * FROM study", "study")
register("overlap", "signal_id events:i median_gap:d min_gap:i mean_gap:d severe", on_frames(lambda r, _: events.overlap(r)),
         "SELECT signal_id, count(*) AS events, median(gap) AS median_gap, min(gap) AS min_gap, avg(gap) AS mean_gap, concat_ws(';', CASE WHEN median(gap) < 1 THEN '1' END, CASE WHEN median(gap) < 5 THEN '5' END, CASE WHEN median(gap) < 10 THEN '10' END, CASE WHEN median(gap) < 20 THEN '20' END) AS severe FROM (SELECT signal_id, rn - lag(rn) OVER (PARTITION BY signal_id ORDER BY date) AS gap FROM ev WHERE signal) GROUP BY 1", "ev")
register("variance_diag", "signal_id h:i n:i sd_ratio:d t_naive:d t_adj:d variance_class", on_frames(lambda r, c: events.variance_diagnostic(events.event_study(r, c))),
         "SELECT signal_id, h, n, sd / sd_all AS sd_ratio, difference / (sd_all / sqrt(n)) AS t_naive, difference / (sd / sqrt(n)) AS t_adj, CASE WHEN sd IS NULL THEN NULL WHEN sd / sd_all > 1.5 THEN 'high' WHEN sd / sd_all >= 1.2 THEN 'raised' ELSE 'normal' END AS variance_class FROM study", "study")
register("regime_diag", "signal_id regime days:i events:i rate:d rate_ratio:d share_signal:d share_days:d mean_signal:d mean_all:d", on_frames(lambda r, _: events.regime_diagnostic(r)),
         "SELECT signal_id, regime, days, events, CAST(events AS DOUBLE) / days AS rate, (CAST(events AS DOUBLE) / days) / NULLIF(CAST(sum(events) OVER w AS DOUBLE) / sum(days) OVER w, 0) AS rate_ratio, CAST(events AS DOUBLE) / NULLIF(sum(events) OVER w, 0) AS share_signal, CAST(days AS DOUBLE) / sum(days) OVER w AS share_days, mean_signal, mean_all FROM (SELECT signal_id, regime, count(*) AS days, count(*) FILTER (WHERE signal) AS events, avg(f20) FILTER (WHERE signal) AS mean_signal, avg(f20) AS mean_all FROM ev GROUP BY 1, 2) WINDOW w AS (PARTITION BY signal_id)", "ev")
register("event_path", "signal_id tau:i n:i mean_change:d", on_frames(events.event_path),
         "SELECT signal_id, tau, count(*) AS n, avg(c.close / e.close) - 1 AS mean_change FROM (SELECT *, unnest(range(-5, 6)) AS tau FROM ev WHERE signal) e JOIN cal c ON c.rn = e.rn + e.tau GROUP BY 1, 2", "ev", "cal")
register("drop_days", "signal_id n:i mean_full:d n_kept:i mean_kept:d", on_frames(lambda r, _: events.without_worst(r)),
         "SELECT signal_id, count(*) AS n, avg(f20) AS mean_full, count(*) FILTER (WHERE nth > 3) AS n_kept, avg(f20) FILTER (WHERE nth > 3) AS mean_kept FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY f20, date) AS nth FROM ev WHERE signal AND f20 IS NOT NULL) GROUP BY 1", "ev")


def without_shocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The study without events on shock days of the signal ticker."""
    bars = once(derived_bars(spark, sf_dir))
    shocks = signals.shocks(bars, SHOCK).where(F.col("ticker") == C.SIGNAL_TICKER)
    return events.without_dates(*events.frames(once(indicators.add_indicators(bars))), shocks)


register("drop_dates", "signal_id n_full:i n_kept:i mean_full:d mean_kept:d mean_pool:d sd_full:d sd_kept:d sd_pool:d sd_ratio_full:d sd_ratio_kept:d t_adj_full:d t_adj_kept:d", without_shocks,
         f"SELECT *, sd_full / sd_pool AS sd_ratio_full, sd_kept / sd_pool AS sd_ratio_kept, (mean_full - mean_pool) / (sd_full / sqrt(n_full)) AS t_adj_full, (mean_kept - mean_pool) / (sd_kept / sqrt(n_kept)) AS t_adj_kept FROM (SELECT signal_id, count(*) AS n_full, count(*) FILTER (WHERE k) AS n_kept, avg(f20) AS mean_full, avg(f20) FILTER (WHERE k) AS mean_kept, stddev_samp(f20) AS sd_full, stddev_samp(f20) FILTER (WHERE k) AS sd_kept, (SELECT avg(f20) FROM cal) AS mean_pool, (SELECT stddev_samp(f20) FROM cal) AS sd_pool FROM (SELECT *, date NOT IN (SELECT date FROM ({SHOCKS}) WHERE ticker = '{C.SIGNAL_TICKER}') AS k FROM ev WHERE signal AND f20 IS NOT NULL) GROUP BY 1)", "ev", "cal", "bars")
register("concentration", "signal_id n:i share_of_losses:d share_of_deviation:d", on_frames(events.concentration),
         "SELECT signal_id, count(*) AS n, sum(f20) FILTER (WHERE nth <= 5) / NULLIF(sum(f20) FILTER (WHERE f20 < 0), 0) AS share_of_losses, sum(f20 - mu) FILTER (WHERE nth <= 5) / NULLIF(sum(f20 - mu), 0) AS share_of_deviation FROM (SELECT *, row_number() OVER (PARTITION BY signal_id ORDER BY f20, date) AS nth, (SELECT avg(f20) FROM cal) AS mu FROM ev WHERE signal AND f20 IS NOT NULL) GROUP BY 1", "ev", "cal")
LAGS = " + ".join(f"{(2.0 * (20 - j) / 20) ** 2!r} * sum(d2 * l{j})" for j in range(1, 20))
register("variance_ratio", "ticker n:i vr:d se_iid:d theta:d effective_n:d se_robust:d z_iid:d z_robust:d", on_frames(lambda _, c: events.variance_ratio(c)),
         f"SELECT *, (vr - 1) / se_iid AS z_iid, sqrt(theta / n) AS se_robust, (vr - 1) / sqrt(theta / n) AS z_robust FROM (SELECT ticker, count(r) AS n, var_samp(rh) / (20 * var_samp(r)) AS vr, sqrt(2.0 * 39 * 19 / (60.0 * count(r))) AS se_iid, ({LAGS}) * count(r) / (sum(d2) * sum(d2)) AS theta, count(r) / 20.0 AS effective_n FROM (SELECT *, "
         + ", ".join(f"lag(d2, {j}) OVER ({S.ORDER}) AS l{j}" for j in range(1, 20)) + f" FROM (SELECT *, pow(r - avg(r) OVER (PARTITION BY ticker), 2) AS d2 FROM (SELECT ticker, date, ln(close) - ln(lag(close) OVER ({S.ORDER})) AS r, ln(close) - ln(lag(close, 20) OVER ({S.ORDER})) AS rh FROM cal))) GROUP BY 1)", "cal")
register("firing_rate", "ticker regime judged:i fired:i rate:d", on_bars(lambda b: regimes.firing_rate(indicators.rsi_wilder(b).withColumn("flag", signals.judge(F.col("rsi_wilder_14"), 30.0)), "flag")),
         f"SELECT ticker, regime, count(rsi) AS judged, count(*) FILTER (WHERE rsi < 30) AS fired, count(*) FILTER (WHERE rsi < 30) * 100.0 / NULLIF(count(rsi), 0) AS rate FROM (SELECT *, {S.REGIME} AS regime FROM ind) WHERE regime IS NOT NULL GROUP BY 1, 2", "ind")
register("correlation", "ticker width_return:d rsi_return:d", on_bars(lambda b: indicators.add_indicators(b).withColumn("a", F.abs(log_return(F.col("close")))).withColumn("m", rolling(F.avg, F.col("a"), 20)).groupBy("ticker").agg(F.corr("bb_width", "m").alias("width_return"), F.corr("rsi_wilder_14", "m").alias("rsi_return"))),
         f"SELECT ticker, corr((up - dn) / mid * 100, m) AS width_return, corr(rsi, m) AS rsi_return FROM (SELECT *, {S.full('avg', 'a', -19, 0)} AS m FROM (SELECT *, abs(lr) AS a FROM ind)) GROUP BY 1", "ind")



def paired(bars: DataFrame) -> DataFrame:
    """Indicators, ATR in percent and the mean absolute return of 20 days, from the analysis start on, where all have values."""
    held = indicators.add_indicators(bars).withColumn("a", F.abs(log_return(F.col("close")))).withColumn("m", rolling(F.avg, F.col("a"), 20))
    ranged = indicators.atr(bars).select("ticker", "date", (F.col("atr_14") / F.col("close") * 100).alias("atr_pct"))
    return held.join(audit.unique_on(ranged, "ticker", "date"), ["ticker", "date"]).where(F.col("date") >= F.lit(C.START)).dropna(subset=["bb_width", "m", "atr_pct"])


register("correlation_pairs", "ticker n:i width_return:d atr_return:d rsi_return:d", on_bars(lambda b: paired(b).groupBy("ticker").agg(F.count("*").alias("n"), F.corr("bb_width", "m").alias("width_return"), F.corr("atr_pct", "m").alias("atr_return"), F.corr("rsi_wilder_14", "m").alias("rsi_return"))),
         f"SELECT ticker, count(*) AS n, corr(w, m) AS width_return, corr(t, m) AS atr_return, corr(rsi, m) AS rsi_return FROM (SELECT i.ticker, i.date, i.rsi, (up - dn) / mid * 100 AS w, a.y / i.close * 100 AS t, m FROM (SELECT *, {S.full('avg', 'a', -19, 0)} AS m FROM (SELECT *, abs(lr) AS a FROM ind)) i LEFT JOIN atr a ON a.ticker = i.ticker AND a.rn = i.rn) WHERE date >= DATE '{C.START}' AND w IS NOT NULL AND m IS NOT NULL AND t IS NOT NULL GROUP BY 1", "ind", "atr")
VOLS = f"SELECT ticker, regime, stddev_samp(lr) * sqrt(252) AS volatility FROM (SELECT *, {S.REGIME} AS regime FROM nb) WHERE regime IS NOT NULL AND lr IS NOT NULL GROUP BY 1, 2"
register("pass_through", "ticker ratio:d median_ratio:d mean_cv:d volatility_ratio:d log_pass_through:d", on_bars(lambda b: regimes.pass_through(regimes.distribution(indicators.bollinger(b), "bb_width"), regimes.return_statistics(b))),
         f"SELECT d.*, v.volatility_ratio, ln(ratio) / ln(volatility_ratio) AS log_pass_through FROM (SELECT ticker, max(mean) / min(mean) AS ratio, max(q50) / min(q50) AS median_ratio, avg(cv) AS mean_cv FROM ({DIST}) GROUP BY 1) d JOIN (SELECT ticker, max(volatility) / min(volatility) AS volatility_ratio FROM ({VOLS}) GROUP BY 1) v ON v.ticker = d.ticker", "bb", "nb")
PANELS = {"first": (C.REGIMES[0].start, C.REGIMES[1].start), "whole": (C.REGIMES[0].start, C.REGIMES[4].start)}
register("panel_summary", "ticker panel n:i atr_pct:d bb_width:d rsi_mean:d rsi_std:d",
         on_bars(lambda b: regimes.panel(indicators.add_indicators(b).join(indicators.atr(b).select("ticker", "date", (F.col("atr_14") / F.col("close") * 100).alias("atr_pct")), ["ticker", "date"]), PANELS)),
         " UNION ALL ".join(f"SELECT i.ticker, '{k}' AS panel, count(*) AS n, avg(a.y / i.close * 100) AS atr_pct, avg((up - dn) / mid * 100) AS bb_width, avg(rsi) AS rsi_mean, stddev_samp(rsi) AS rsi_std FROM ind i LEFT JOIN atr a ON a.ticker = i.ticker AND a.rn = i.rn WHERE date BETWEEN DATE '{x}' AND DATE '{y}' GROUP BY 1" for k, (x, y) in PANELS.items()), "ind", "atr")


def monthly_regimes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of 45 days from the start of each month that has a rate; the later one holds where two overlap."""
    months = derived_rates(spark, sf_dir).select(F.trunc("date", "MM").alias("start")).distinct()
    return months.select(F.date_format("start", "yyyy-MM").alias("key"), "start", F.date_add("start", 44).alias("end"), F.unix_date("start").alias("ordinal"))


register("table_regimes", "ticker regime n:i n_near:i mean_close:d",
         lambda s, d: regimes.tagged(derived_bars(s, d), monthly_regimes(s, d), near=1).groupBy("ticker", "regime").agg(F.count("*").alias("n"), F.count_if("near_boundary").alias("n_near"), F.avg("close").alias("mean_close")),
         "SELECT ticker, regime, count(*) AS n, count(*) FILTER (WHERE near) AS n_near, avg(close) AS mean_close FROM (SELECT b.ticker, b.close, (SELECT strftime(max(m), '%Y-%m') FROM months WHERE m <= b.date AND b.date <= m + 44) AS regime, EXISTS (SELECT 1 FROM months WHERE abs(b.date - m) <= 1 OR abs(b.date - (m + 44)) <= 1) AS near FROM bars b) GROUP BY 1, 2", "bars", "months")
PERCENT_B = "CASE WHEN up - dn = 0 THEN 0.5 ELSE (close - dn) / NULLIF(up - dn, 0) END"
register("band_inside", "ticker regime judged:i upper:d lower:d inside:d", on_bars(lambda b: regimes.inside_band(indicators.bollinger(b))),
         f"SELECT *, 100 - upper - lower AS inside FROM (SELECT ticker, regime, count(*) AS judged, avg(CAST(x > 1 AS INT)) * 100 AS upper, avg(CAST(x < 0 AS INT)) * 100 AS lower FROM (SELECT ticker, {S.REGIME} AS regime, {PERCENT_B} AS x FROM bb) WHERE regime IS NOT NULL AND x IS NOT NULL GROUP BY 1, 2)", "bb")
register("rsi_tails", "ticker n:i median:d mean:d low_pct:d high_pct:d ratio:d even_low:d even_high:d", on_bars(lambda b: regimes.tails(indicators.rsi_wilder(b), "rsi_wilder_14", C.RSI_LOW, C.RSI_HIGH)),
         "SELECT ticker, count(*) AS n, median(rsi) AS median, avg(rsi) AS mean, avg(CAST(rsi < 30 AS INT)) * 100 AS low_pct, avg(CAST(rsi > 70 AS INT)) * 100 AS high_pct, avg(CAST(rsi > 70 AS INT)) / NULLIF(avg(CAST(rsi < 30 AS INT)), 0) AS ratio, quantile_cont(rsi, 0.05) AS even_low, quantile_cont(rsi, 0.95) AS even_high FROM ind WHERE rsi IS NOT NULL GROUP BY 1", "ind")

# --- resampling, by hash order
def md5_order(key: str) -> str:
    return f"md5(concat_ws('|', '{C.SEED}', CAST(i AS VARCHAR), CAST({key} AS VARCHAR)))"


def event_returns(h: int) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.where("signal").select("signal_id", F.col(f"fwd_ret_{h}").alias("ret"))


def day_returns(h: int) -> Callable[[DataFrame], DataFrame]:
    return lambda calendar: calendar.select("date", F.col(f"fwd_ret_{h}").alias("ret"))


def mean_test_sql(h: int, stud: bool) -> str:
    stat = "CASE WHEN s > 0 THEN abs((m - mu) / (s / sqrt(n))) END" if stud else "abs(m - mu)"
    seen = "abs((mean - mu) / (sd / sqrt(n)))" if stud else "abs(mean - mu)"
    p = "(1.0 + extreme) / (1.0 + draws)"
    return f"""SELECT *, ({C.ALPHA / C.TESTS} - p) / NULLIF(mc_se, 0) AS distance, ci_low < {C.ALPHA / C.TESTS} AND ci_high > {C.ALPHA / C.TESTS} AS straddles FROM (SELECT *, sqrt(p * (1 - p) / {DRAWS}) AS mc_se, greatest(p - 1.96 * sqrt(p * (1 - p) / {DRAWS}), 0) AS ci_low, p + 1.96 * sqrt(p * (1 - p) / {DRAWS}) AS ci_high FROM (SELECT *, {p} AS p FROM (
        SELECT signal_id, n, max(seen) AS statistic, count(*) FILTER (WHERE st >= seen) AS extreme, count(st) AS draws FROM (
            SELECT *, {stat} AS st, {seen} AS seen FROM (
                SELECT signal_id, i, n, mean, sd, mu, avg(ret) AS m, stddev_samp(ret) AS s FROM (
                    SELECT e.*, c.date, c.ret, i, (SELECT avg(f{h}) FROM cal) AS mu, row_number() OVER (PARTITION BY e.signal_id, i ORDER BY {md5_order("c.date")}, c.date) AS nth
                    FROM (SELECT signal_id, count(ret) AS n, avg(ret) AS mean, stddev_samp(ret) AS sd FROM evh WHERE h = {h} AND ret IS NOT NULL GROUP BY 1) e, (SELECT date, f{h} AS ret FROM cal WHERE f{h} IS NOT NULL) c, (SELECT unnest(range(1, {DRAWS + 1})) AS i) d)
                WHERE nth <= n GROUP BY ALL))
        GROUP BY 1, 2)))"""


PERM = "signal_id n:i statistic:d extreme:i draws:i p:d passes mc_se:d ci_low:d ci_high:d distance:d straddles"
FEW = PERM.replace(" passes", "")  # no p of so few draws can pass
register("perm_mean_hash", FEW, on_frames(lambda r, c: resample.mean_test(event_returns(20)(r), day_returns(20)(c), DRAWS)), mean_test_sql(20, False), "evh", "cal")
register("perm_student_hash", FEW, on_frames(lambda r, c: resample.mean_test(event_returns(5)(r), day_returns(5)(c), DRAWS, studentized=True)), mean_test_sql(5, True), "evh", "cal")
register_unchecked("perm_mean", PERM, on_frames(lambda r, c: resample.mean_test(event_returns(20)(r), day_returns(20)(c), C.DRAWS)))
register_unchecked("perm_student", PERM, on_frames(lambda r, c: resample.mean_test(event_returns(5)(r), day_returns(5)(c), C.DRAWS, studentized=True)))


def variance_with_p(rows: DataFrame, calendar: DataFrame) -> DataFrame:
    tested = resample.mean_test(event_returns(20)(rows), day_returns(20)(calendar), DRAWS).withColumn("h", F.lit(20))
    return events.with_p(events.variance_diagnostic(events.event_study(rows, calendar)), tested)


VARIANCE = "SELECT signal_id, h, n, sd / sd_all AS sd_ratio, difference / (sd_all / sqrt(n)) AS t_naive, difference / (sd / sqrt(n)) AS t_adj FROM study"
register("variance_with_p", "signal_id h:i n:i sd_ratio:d t_naive:d t_adj:d p_perm:d", on_frames(variance_with_p),
         f"SELECT v.*, t.p AS p_perm FROM ({VARIANCE}) v LEFT JOIN ({mean_test_sql(20, False)}) t ON t.signal_id = v.signal_id AND v.h = 20", "study", "evh", "cal")


# --- volatility strata
def vol_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = once(derived_bars(spark, sf_dir))
    s3 = signals.make_signals(indicators.bollinger(bars), [x for x in signals.SIGNALS if x[0] == "S3"])
    return pathvol.volatility_frame(bars, s3, "S3")


def on_vol(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, d: f(vol_frame(spark, d))


def one_ticker(df: DataFrame) -> DataFrame:
    return df.where(F.col("ticker") == C.SIGNAL_TICKER)


def with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    fwd = audit.unique_on(signals.forward_returns(derived_bars(spark, sf_dir)).select("date", "ticker", F.col("fwd_ret_20").alias("ret")), "date", "ticker")
    return one_ticker(vol_frame(spark, sf_dir).join(fwd, ["date", "ticker"], "left").where(F.col("date") >= F.lit(C.START)))


ONE = f"ticker = '{C.SIGNAL_TICKER}'"
STRAT = f"SELECT b.date, stratum, is_signal, f20 AS ret FROM bins b JOIN fwd f ON f.ticker = b.ticker AND f.date = b.date WHERE b.{ONE} AND b.date >= DATE '{C.START}'"
SUMS = "count(*) FILTER (WHERE {f}) AS n_sig, count(*) FILTER (WHERE NOT {f}) AS n_ctl, avg(y) FILTER (WHERE {f}) AS m_sig, avg(y) FILTER (WHERE NOT {f}) AS m_ctl, var_samp(y) FILTER (WHERE {f}) AS v_sig, var_samp(y) FILTER (WHERE NOT {f}) AS v_ctl"
register("pre_vol", "ticker date pre_vol:d", on_vol(lambda v: v), "SELECT ticker, date, pre AS pre_vol FROM vol", "vol")
register("post_vol", "ticker date post_vol:d post_vol_1:d", on_vol(lambda v: v), "SELECT ticker, date, post AS post_vol, post1 AS post_vol_1 FROM vol", "vol")
register("quantile_bin", "ticker date stratum:i is_signal", on_vol(lambda v: v), "SELECT ticker, date, stratum, is_signal FROM bins", "bins")
RATIO = f"SELECT bin, coalesce(n_signal, 0) AS n_signal, coalesce(n_other, 0) AS n_other, post_signal, post_other, post_signal / post_other AS ratio, (pre_signal / pre_other - 1) * 100 AS pre_gap_pct FROM (SELECT unnest(range(0, 6)) AS bin) e LEFT JOIN (SELECT bin AS b, count(*) FILTER (WHERE is_signal) AS n_signal, count(*) FILTER (WHERE NOT is_signal) AS n_other, avg(post) FILTER (WHERE is_signal) AS post_signal, avg(post) FILTER (WHERE NOT is_signal) AS post_other, avg(pre) FILTER (WHERE is_signal) AS pre_signal, avg(pre) FILTER (WHERE NOT is_signal) AS pre_other FROM (SELECT *, unnest([0, stratum]) AS bin FROM bins WHERE post IS NOT NULL AND pre IS NOT NULL AND stratum IS NOT NULL AND date >= DATE '{C.START}') GROUP BY 1) c ON e.bin = c.b"
register("path_ratio", "bin:i n_signal:i n_other:i post_signal:d post_other:d ratio:d pre_gap_pct:d stratification in_mean", on_vol(pathvol.path_ratio),
         f"SELECT *, CASE WHEN bin = 0 THEN NULL WHEN pre_gap_pct IS NULL THEN 'no sample' WHEN pre_gap_pct >= 20 THEN 'incomplete' ELSE 'good' END AS stratification, CASE WHEN bin > 0 THEN n_signal >= {C.LEAST_SIGNALS} END AS in_mean FROM ({RATIO})", "bins")
register("stratum_gaps", "stratum:i n:i median_gap:d", lambda s, d: pathvol.stratum_gaps(with_returns(s, d)),
         f"SELECT stratum, count(*) AS n, median(gap) AS median_gap FROM (SELECT stratum, rn - lag(rn) OVER (PARTITION BY stratum ORDER BY rn) AS gap FROM (SELECT b.rn, stratum FROM bins b JOIN fwd f ON f.ticker = b.ticker AND f.date = b.date WHERE b.{ONE} AND b.date >= DATE '{C.START}' AND is_signal AND f20 IS NOT NULL AND stratum IS NOT NULL)) GROUP BY 1 HAVING count(*) >= {C.LEAST_SIGNALS}", "bins", "fwd")
register("post_vol_10", "ticker date post_vol:d", on_bars(lambda b: b.withColumn("lr", log_return(F.col("close"))).withColumn("post_vol", framed(F.stddev_samp, F.col("lr"), 1, 10))),
         f"SELECT ticker, date, {S.full('stddev_samp', 'lr', 1, 10)} AS post_vol FROM nb", "nb")
register("weighted_ratio", "r0:d weighted:d n_used:i excluded verdict", on_vol(lambda v: pathvol.weighted_ratio(pathvol.path_ratio(v))),
         f"SELECT r0, weighted, n_used, excluded, CASE WHEN r0 IS NULL OR r0 < 1.15 OR weighted IS NULL THEN 'not_performed' WHEN weighted <= 1 + 0.22 * (r0 - 1) THEN 'none' WHEN weighted > 1 + 0.44 * (r0 - 1) THEN 'exists' ELSE 'unclear' END AS verdict FROM (SELECT max(ratio) FILTER (WHERE bin = 0) AS r0, sum(n_signal * ratio) FILTER (WHERE bin > 0 AND n_signal >= 5 AND ratio IS NOT NULL) / NULLIF(sum(n_signal) FILTER (WHERE bin > 0 AND n_signal >= 5 AND ratio IS NOT NULL), 0) AS weighted, coalesce(sum(n_signal) FILTER (WHERE bin > 0 AND n_signal >= 5 AND ratio IS NOT NULL), 0) AS n_used, coalesce(string_agg(CAST(bin AS VARCHAR), ';' ORDER BY bin) FILTER (WHERE bin > 0 AND (n_signal < 5 OR ratio IS NULL)), '') AS excluded FROM ({RATIO}))", "bins")
register("bins_check", "days:i binned:i with_return:i usable:i usable_signals:i", lambda s, d: with_returns(s, d).agg(F.count("*").alias("days"), F.count("stratum").alias("binned"), F.count("ret").alias("with_return"), F.count_if(F.expr("stratum IS NOT NULL AND ret IS NOT NULL")).alias("usable"), F.count_if(F.expr("is_signal AND stratum IS NOT NULL AND ret IS NOT NULL")).alias("usable_signals")),
         f"SELECT count(*) AS days, count(stratum) AS binned, count(ret) AS with_return, count(*) FILTER (WHERE stratum IS NOT NULL AND ret IS NOT NULL) AS usable, count(*) FILTER (WHERE is_signal AND stratum IS NOT NULL AND ret IS NOT NULL) AS usable_signals FROM ({STRAT})", "bins", "fwd")
register("stratum_table", "stratum:i n_signal:i n_pool:i signal_pct:d pool_pct:d difference:d included contribution:d", lambda s, d: pathvol.stratum_returns(with_returns(s, d)),
         f"SELECT *, CASE WHEN included THEN n_signal * difference END / NULLIF(sum(CASE WHEN included THEN n_signal * difference END) OVER (), 0) AS contribution FROM (SELECT *, signal_pct - pool_pct AS difference, n_signal >= 5 AS included FROM (SELECT stratum, count(*) FILTER (WHERE is_signal) AS n_signal, count(*) FILTER (WHERE NOT is_signal) AS n_pool, avg(ret) FILTER (WHERE is_signal) * 100 AS signal_pct, avg(ret) FILTER (WHERE NOT is_signal) * 100 AS pool_pct FROM ({STRAT}) WHERE ret IS NOT NULL AND stratum IS NOT NULL GROUP BY 1))", "bins", "fwd")
register("welch_delta", "stratum:i n_sig:i n_ctl:i delta:d exp_delta:d se:d pre_gap:d included weight:d", on_vol(lambda v: pathvol.welch_table(pathvol.analysis(v))),
         f"SELECT *, exp(delta) AS exp_delta, CAST(CASE WHEN included THEN n_sig END AS DOUBLE) / sum(CASE WHEN included THEN n_sig END) OVER () AS weight FROM (SELECT *, m_sig - m_ctl AS delta, sqrt(v_sig / NULLIF(n_sig, 0) + v_ctl / NULLIF(n_ctl, 0)) AS se, n_sig >= 5 AND n_ctl >= 10 AS included FROM (SELECT stratum, {SUMS.format(f='is_signal')}, avg(lpre) FILTER (WHERE is_signal) - avg(lpre) FILTER (WHERE NOT is_signal) AS pre_gap FROM frame GROUP BY 1))", "frame")
register("gap_ratio", "grp stratum:i n:i n_gap:i n_close:i median_gap:d overlap:d", on_vol(lambda v: pathvol.gap_ratio(pathvol.analysis(v))),
         "SELECT e.grp, e.stratum, coalesce(n, 0) AS n, coalesce(n_gap, 0) AS n_gap, coalesce(n_close, 0) AS n_close, median_gap, CAST(n_close AS DOUBLE) / NULLIF(n_gap, 0) AS overlap FROM (SELECT g.grp, s.stratum FROM (SELECT unnest(['signal', 'control']) AS grp) g, (SELECT unnest(range(1, 6)) AS stratum) s) e LEFT JOIN (SELECT grp, stratum, count(*) AS n, count(gap) AS n_gap, count(*) FILTER (WHERE gap < 20) AS n_close, median(gap) AS median_gap FROM (SELECT *, pos - lag(pos) OVER (PARTITION BY ticker, grp, stratum ORDER BY pos) AS gap FROM (SELECT *, CASE WHEN is_signal THEN 'signal' ELSE 'control' END AS grp FROM frame)) GROUP BY 1, 2) c ON c.grp = e.grp AND c.stratum = e.stratum", "frame")


register("gap_distribution", "stratum:i n:i least:i q25:d q50:d q75:d most:i under_1:i under_5:i under_10:i under_20:i", on_vol(lambda v: pathvol.gap_distribution(pathvol.analysis(v))),
         "SELECT stratum, count(*) AS n, min(gap) AS least, quantile_cont(gap, 0.25) AS q25, quantile_cont(gap, 0.5) AS q50, quantile_cont(gap, 0.75) AS q75, max(gap) AS most, " + ", ".join(f"count(*) FILTER (WHERE gap < {k}) AS under_{k}" for k in (1, 5, 10, 20)) + " FROM (SELECT stratum, pos - lag(pos) OVER (PARTITION BY ticker, stratum ORDER BY pos) AS gap FROM frame WHERE is_signal) GROUP BY 1", "frame")
S.CTE["welch"] = (["frame"], f"SELECT *, CAST(CASE WHEN included THEN n_sig END AS DOUBLE) / sum(CASE WHEN included THEN n_sig END) OVER () AS weight FROM (SELECT *, m_sig - m_ctl AS delta, sqrt(v_sig / NULLIF(n_sig, 0) + v_ctl / NULLIF(n_ctl, 0)) AS se, n_sig >= {C.LEAST_SIGNALS} AND n_ctl >= {C.LEAST_CONTROLS} AS included FROM (SELECT stratum, {SUMS.format(f='is_signal')}, avg(lpre) FILTER (WHERE is_signal) - avg(lpre) FILTER (WHERE NOT is_signal) AS pre_gap FROM frame GROUP BY 1))")
DELTAS = "SELECT *, delta / NULLIF(se, 0) AS t, exp(delta) AS exp_delta FROM (SELECT sum(n_sig) AS n_signal, sum(weight * delta) AS delta, sqrt(sum(weight * weight * se * se)) AS se, sum(weight * pre_gap) AS delta_pre FROM welch WHERE included)"
register("delta_summary", "n_signal:i delta:d se:d t:d exp_delta:d delta_pre:d", on_vol(lambda v: pathvol.difference_summary(pathvol.welch_table(pathvol.analysis(v)))), DELTAS, "welch")


register("delta_routes", "delta:d se:d delta_sums:d se_sums:d agree", on_vol(lambda v: pathvol.two_routes(pathvol.analysis(v))), f"SELECT delta, se, delta_sums, se_sums, abs(delta - delta_sums) <= 1e-12 AND abs(se - se_sums) <= 1e-12 AS agree FROM (SELECT delta, se FROM ({DELTAS})) a, (SELECT sum(n * (sy / n - cy / c)) / sum(n) AS delta_sums, sqrt(sum(n * n * ((sq - sy * sy / n) / (n - 1) / n + (cq - cy * cy / c) / (c - 1) / c))) / sum(n) AS se_sums FROM (SELECT stratum, count(*) FILTER (WHERE is_signal) AS n, count(*) FILTER (WHERE NOT is_signal) AS c, sum(y) FILTER (WHERE is_signal) AS sy, sum(y) FILTER (WHERE NOT is_signal) AS cy, sum(y * y) FILTER (WHERE is_signal) AS sq, sum(y * y) FILTER (WHERE NOT is_signal) AS cq FROM frame GROUP BY 1) WHERE n >= {C.LEAST_SIGNALS} AND c >= {C.LEAST_CONTROLS}) b", "welch")


def flags(v: DataFrame) -> DataFrame:
    frame = pathvol.analysis(v)
    return pathvol.structure_flags(pathvol.welch_table(frame), pathvol.gap_ratio(frame))


register("structure_flags", "max_weight:d opposite_weight:d overlapping delta_pre:d n_raw:i dominance mixed_signs overlap unequal_before low_power", on_vol(flags),
         f"""SELECT *, max_weight >= 0.5 AS dominance, opposite_weight >= 0.25 AS mixed_signs, overlapping <> '' AS overlap, abs(delta_pre) >= 0.1 AS unequal_before, n_raw < 40 AS low_power FROM (
            SELECT (SELECT max(weight) FROM welch WHERE included) AS max_weight, (SELECT coalesce(sum(weight) FILTER (WHERE sign(delta) <> sign((SELECT delta FROM ({DELTAS})))), 0) FROM welch WHERE included) AS opposite_weight, (SELECT delta_pre FROM ({DELTAS})) AS delta_pre, (SELECT sum(n_sig) FROM welch) AS n_raw,
            (SELECT coalesce(string_agg(CAST(stratum AS VARCHAR), ';' ORDER BY stratum), '') FROM (SELECT stratum, count(*) FILTER (WHERE gap < {C.POST_WINDOW}) * 1.0 / NULLIF(count(gap), 0) AS o FROM (SELECT stratum, pos - lag(pos) OVER (PARTITION BY ticker, stratum ORDER BY pos) AS gap FROM frame WHERE is_signal) GROUP BY 1) JOIN welch USING (stratum) WHERE included AND o >= 0.2) AS overlapping)""", "welch", "frame")


def thin_cte(name: str, source: str) -> None:
    S.CTE[f"{name}_n"] = ([source], f"SELECT ticker, pos, row_number() OVER (PARTITION BY ticker ORDER BY pos) AS rn FROM {source}")
    S.CTE[f"{name}_r"] = ([f"{name}_n"], f"SELECT ticker, rn, pos AS y FROM {name}_n WHERE rn = 1 UNION ALL SELECT n.ticker, n.rn, CASE WHEN n.pos - r.y >= 20 THEN n.pos ELSE r.y END FROM {name}_r r JOIN {name}_n n ON n.ticker = r.ticker AND n.rn = r.rn + 1")
    S.CTE[name] = ([f"{name}_r"], f"SELECT DISTINCT ticker, y AS pos FROM {name}_r")


S.CTE["sigpos"] = (["frame"], "SELECT ticker, pos FROM frame WHERE is_signal")
thin_cte("kept", "sigpos")
S.CTE["ctlpos"] = (["frame", "kept"], "SELECT ticker, pos FROM frame f WHERE NOT is_signal AND NOT EXISTS (SELECT 1 FROM kept k WHERE k.ticker = f.ticker AND abs(k.pos - f.pos) < 20)")
thin_cte("ctl", "ctlpos")
S.CTE["thinned"] = (["frame", "kept", "ctl"], "SELECT f.* FROM frame f JOIN (SELECT ticker, pos, true AS s FROM kept UNION ALL SELECT ticker, pos, false FROM ctl) k ON k.ticker = f.ticker AND k.pos = f.pos AND k.s = f.is_signal")


def declustered(v: DataFrame) -> tuple[DataFrame, DataFrame]:
    frame = once(pathvol.analysis(v))  # a dozen branches read it
    return frame, pathvol.decluster(frame)


register("decluster", "ticker date pos:i is_signal", on_vol(lambda v: declustered(v)[1]), "SELECT ticker, date, pos, is_signal FROM thinned", "thinned")
register("thinning_counts", "stratum:i signals:i controls:i signals_thinned:i controls_thinned:i", on_vol(lambda v: pathvol.counts(*declustered(v))),
         "SELECT stratum, count(*) FILTER (WHERE is_signal AND a = 0) AS signals, count(*) FILTER (WHERE NOT is_signal AND a = 0) AS controls, count(*) FILTER (WHERE is_signal AND a = 1) AS signals_thinned, count(*) FILTER (WHERE NOT is_signal AND a = 1) AS controls_thinned FROM (SELECT stratum, is_signal, 0 AS a FROM frame UNION ALL SELECT stratum, is_signal, 1 FROM thinned) GROUP BY ROLLUP (stratum)", "frame", "thinned")
S.CTE["centred"] = (["bins", "fwd"], f"SELECT *, ret - mu AS e FROM (SELECT *, count(*) FILTER (WHERE is_signal) OVER (PARTITION BY stratum) AS n_sig, avg(ret) FILTER (WHERE NOT is_signal) OVER (PARTITION BY stratum) AS mu FROM ({STRAT}) WHERE ret IS NOT NULL AND stratum IS NOT NULL) WHERE n_sig >= 5")
register("perm_strat_hash", "n:i mean_diff:d statistic:d extreme:i draws:i p:d", lambda s, d: resample.stratified_test(with_returns(s, d), DRAWS),
         f"""SELECT *, (1.0 + extreme) / (1.0 + draws) AS p FROM (SELECT any_value(n) AS n, any_value(mean_diff) AS mean_diff, any_value(st) AS statistic, count(*) FILTER (WHERE t >= st) AS extreme, count(*) AS draws FROM (
            SELECT i, abs(avg(e) / (stddev_samp(e) / sqrt(count(e)))) AS t, any_value(n) AS n, any_value(mean_diff) AS mean_diff, any_value(st) AS st FROM (
                SELECT c.*, i, row_number() OVER (PARTITION BY stratum, i ORDER BY {md5_order("date")}, date) AS nth, (SELECT count(*) FROM centred WHERE is_signal) AS n, (SELECT avg(e) FROM centred WHERE is_signal) AS mean_diff, (SELECT abs(avg(e) / (stddev_samp(e) / sqrt(count(e)))) FROM centred WHERE is_signal) AS st
                FROM centred c, (SELECT unnest(range(1, {DRAWS + 1})) AS i) d WHERE NOT is_signal) WHERE nth <= n_sig GROUP BY i))""", "centred")
register_unchecked("perm_strat", "n:i mean_diff:d statistic:d extreme:i draws:i p:d", lambda s, d: resample.stratified_test(with_returns(s, d), C.DRAWS))
register_unchecked("perm_label", "delta:d se:d t:d extreme_raw:i extreme_stud:i draws:i p_raw:d p_stud:d", on_vol(lambda v: resample.label_test(one_ticker(pathvol.analysis(v)), C.DRAWS)))
COMB = "SELECT {g}, sum(w * (m_sig - m_ctl)) AS delta, sqrt(sum(w * w * (v_sig / n_sig + v_ctl / n_ctl))) AS se FROM (SELECT *, CAST(n_sig AS DOUBLE) / sum(n_sig) OVER (PARTITION BY {g}) AS w FROM ({inner})) GROUP BY {g}"
S.CTE["usable"] = (["frame"], f"SELECT * FROM (SELECT *, count(*) FILTER (WHERE is_signal) OVER (PARTITION BY stratum) AS k, count(*) FILTER (WHERE NOT is_signal) OVER (PARTITION BY stratum) AS c FROM frame WHERE {ONE}) WHERE k >= 5 AND c >= 10")
register("perm_label_hash", "delta:d se:d t:d extreme_raw:i extreme_stud:i draws:i p_raw:d p_stud:d", on_vol(lambda v: resample.label_test(one_ticker(pathvol.analysis(v)), DRAWS)),
         f"""SELECT *, (1.0 + extreme_raw) / (1.0 + draws) AS p_raw, (1.0 + extreme_stud) / (1.0 + draws) AS p_stud FROM (SELECT any_value(s.delta) AS delta, any_value(s.se) AS se, any_value(s.delta / s.se) AS t, count(*) FILTER (WHERE abs(d.delta) >= abs(s.delta)) AS extreme_raw, count(*) FILTER (WHERE abs(d.delta / d.se) >= abs(s.delta / s.se)) AS extreme_stud, count(*) AS draws FROM
            ({COMB.format(g='i', inner=f"SELECT i, stratum, {SUMS.format(f='lab')} FROM (SELECT u.*, i, row_number() OVER (PARTITION BY stratum, i ORDER BY {md5_order('date')}, date) <= k AS lab FROM usable u, (SELECT unnest(range(1, {DRAWS + 1})) AS i) x) GROUP BY 1, 2")}) d,
            ({COMB.format(g='one', inner=f"SELECT 1 AS one, stratum, {SUMS.format(f='is_signal')} FROM usable GROUP BY 2")}) s)""", "usable")


register("perm_label_shift", "p_raw:d p_stud:d crossing log_ratio:d shifted", on_vol(lambda v: pathvol.p_shift(resample.label_test(one_ticker(pathvol.analysis(v)), DRAWS))),
         f"SELECT p_raw, p_stud, crossing, log_ratio, crossing OR log_ratio >= ln(3.0) AS shifted FROM (SELECT p_raw, p_stud, (p_stud < 0.05) <> (p_raw < 0.05) AS crossing, abs(ln(p_stud / p_raw)) AS log_ratio FROM ({ORACLES['perm_label_hash'].replace('ROUND(CAST(p_raw AS DOUBLE), 6) + 0.0 AS p_raw', 'p_raw').replace('ROUND(CAST(p_stud AS DOUBLE), 6) + 0.0 AS p_stud', 'p_stud')}))")
register_unchecked("perm_label_shift_full", "p_raw:d p_stud:d crossing log_ratio:d shifted", on_vol(lambda v: pathvol.p_shift(resample.label_test(one_ticker(pathvol.analysis(v)), C.DRAWS))))
register_unchecked("perm_strat_report", "n:i mean_diff:d statistic:d extreme:i draws:i p:d low_resolution p_all_strata:d p_leave_one_out:d dominated", lambda s, d: resample.stratified_report(with_returns(s, d), C.DRAWS))


# --- backtest and metrics
class Backtest:
    """The plans of one backtest of all signals and holdings, each built from the ones before."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        bars = once(derived_bars(spark, sf_dir))
        self.bars, self.spark, self.sf_dir = bars, spark, sf_dir
        self.prices = once(one_ticker(backtest.numbered(bars)))
        rows, _ = events.frames(indicators.add_indicators(bars))
        self.rows = rows.drop("pos").join(audit.unique_on(self.prices.select("ticker", "date", "pos"), "ticker", "date"), ["ticker", "date"])
        self.positions = once(backtest.verified_trades(backtest.trade_positions(self.rows)))
        self.trades = backtest.trade_log(self.positions, self.prices)

    @cached_property
    def rates(self) -> DataFrame:
        return backtest.aligned_rates(self.bars, derived_rates(self.spark, self.sf_dir))

    def check(self) -> DataFrame:
        return backtest.run_record(self.positions, self.rows)

    def curves(self, cash: str = "risk_free") -> DataFrame:
        return backtest.equity_curve(self.positions, self.prices, self.rates, cash)


def on_backtest(f: Callable[[Backtest], DataFrame]) -> Query:
    return lambda spark, d: f(Backtest(spark, d))


def metric_sql(curve: str) -> str:
    return f"SELECT *, mdd * 100 AS max_drawdown, CASE WHEN mdd < 0 THEN cagr / abs(mdd * 100) END AS calmar FROM (SELECT signal_id, holding_days, count(*) AS n, (max_by(g, date) / min_by(g, date) - 1) * 100 AS total_return, (pow(max_by(g, date) / min_by(g, date), 252.0 / count(*)) - 1) * 100 AS cagr, stddev_samp(r) * sqrt(252) * 100 AS volatility, CASE WHEN stddev_samp(x) > 1e-12 THEN avg(x) / stddev_samp(x) * sqrt(252) END AS sharpe, CASE WHEN stddev_samp(x) FILTER (WHERE x < -1e-12) > 1e-12 THEN avg(x) / (stddev_samp(x) FILTER (WHERE x < -1e-12)) * sqrt(252) END AS sortino, min(dd) AS mdd FROM (SELECT *, r - coalesce(risk_free, 0) AS x FROM (SELECT *, g / lag(g) OVER w - 1 AS r, g / max(g) OVER (PARTITION BY signal_id, holding_days ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - 1 AS dd FROM ({curve}) WINDOW w AS (PARTITION BY signal_id, holding_days ORDER BY date))) GROUP BY 1, 2)"


METRICS = "signal_id holding_days:i n:i total_return:d cagr:d volatility:d sharpe:d sortino:d max_drawdown:d calmar:d"
RUNS = "SELECT signal_id, holding_days, date, risk_free, growth AS g FROM curve"
RUNS0 = "SELECT signal_id, holding_days, date, risk_free, growth0 AS g FROM curve"
HOLD = f"SELECT 'hold' AS signal_id, 0 AS holding_days, px.date, risk_free, close / first_value(close) OVER (ORDER BY px.date) AS g FROM px JOIN rf ON rf.ticker = px.ticker AND rf.date = px.date UNION ALL SELECT 'cash', 0, px.date, risk_free, product(1 + coalesce(risk_free, 0)) OVER (ORDER BY px.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) FROM px JOIN rf ON rf.ticker = px.ticker AND rf.date = px.date"
register("risk_free", "ticker date rate_raw:d risk_free:d", lambda s, d: backtest.aligned_rates(derived_bars(s, d), derived_rates(s, d)), "SELECT ticker, date, raw AS rate_raw, risk_free FROM rf", "rf")
register("rate_summary", "ticker days:i missing_before:i missing_after:i negative_days:i", lambda s, d: backtest.rate_summary(backtest.aligned_rates(derived_bars(s, d), derived_rates(s, d))),
         "SELECT ticker, count(*) AS days, count(*) - count(raw) AS missing_before, count(*) - count(risk_free) AS missing_after, count(*) FILTER (WHERE risk_free < 0) AS negative_days FROM rf GROUP BY 1", "rf")
register("rate_range", "ticker lowest:d highest:d first last n_negative:i negative_days", lambda s, d: backtest.rate_range(backtest.aligned_rates(derived_bars(s, d), derived_rates(s, d))),
         "SELECT ticker, min(raw) * 25200 AS lowest, max(raw) * 25200 AS highest, min(date) FILTER (WHERE raw IS NOT NULL) AS first, max(date) FILTER (WHERE raw IS NOT NULL) AS last, count(*) FILTER (WHERE raw < 0) AS n_negative, coalesce(string_agg(CAST(date AS VARCHAR), ',' ORDER BY date) FILTER (WHERE raw < 0), '') AS negative_days FROM rf GROUP BY 1", "rf")
register("trades", "signal_id ticker holding_days:i entry_date exit_date entry_price:p exit_price:p size:d pnl:d return_pct:d exit_reason", on_backtest(lambda b: b.trades),
         f"SELECT *, {C.CAPITAL} / (entry_price * (1 + {C.COST})) AS size, {C.CAPITAL} * r AS pnl, r * 100 AS return_pct, 'time_stop' AS exit_reason FROM trades", "trades")
register("run_check", "signal_id ticker holding_days:i signals:i trades:i overlapping:i wrong_length:i unsignalled:i verified", on_backtest(lambda b: b.check()),
         f"SELECT r.signal_id, '{C.SIGNAL_TICKER}' AS ticker, holding_days, signals, count(*) AS trades, count(*) FILTER (WHERE entry_pos <= before) AS overlapping, count(*) FILTER (WHERE exit_pos - entry_pos <> holding_days) AS wrong_length, count(*) FILTER (WHERE NOT hit) AS unsignalled, count(*) FILTER (WHERE entry_pos <= before OR exit_pos - entry_pos <> holding_days OR NOT hit) = 0 AS verified FROM (SELECT *, lag(exit_pos) OVER (PARTITION BY signal_id, holding_days ORDER BY entry_pos) AS before, EXISTS (SELECT 1 FROM hits WHERE hits.signal_id = trades.signal_id AND hits.pos = trades.entry_pos - 1) AS hit FROM trades) r JOIN (SELECT signal_id, count(*) AS signals FROM hits GROUP BY 1) n ON n.signal_id = r.signal_id GROUP BY ALL", "trades", "hits")
register("equity_curve", "signal_id ticker holding_days:i date position_return:d risk_free:d growth:d in_position", on_backtest(lambda b: b.curves().withColumn("growth", F.col("equity") / C.CAPITAL)),
         "SELECT signal_id, ticker, holding_days, date, pr AS position_return, risk_free, growth, held AS in_position FROM curve", "curve")
register("metrics", METRICS, on_backtest(lambda b: metrics.curve_metrics(b.curves())), metric_sql(RUNS), "curve")
TRADED = "SELECT signal_id, holding_days, count(*) AS trades, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) * 100 AS win_rate, sum(r) FILTER (WHERE r > 0) / NULLIF(-sum(r) FILTER (WHERE r < 0), 0) AS profit_factor, avg(holding_days) AS average_holding FROM trades GROUP BY 1, 2"
register("trade_metrics", "signal_id holding_days:i trades:i win_rate:d profit_factor:d average_holding:d", on_backtest(lambda b: metrics.trade_metrics(b.trades)), TRADED, "trades")
register("run_summary", METRICS + " trades:i win_rate:d profit_factor:d average_holding:d exposure:d", on_backtest(lambda b: metrics.summarize(b.curves(), b.trades)),
         f"SELECT m.*, trades, win_rate, profit_factor, average_holding, exposure FROM ({metric_sql(RUNS)}) m LEFT JOIN ({TRADED}) t ON t.signal_id = m.signal_id AND t.holding_days = m.holding_days JOIN (SELECT signal_id, holding_days, avg(CASE WHEN held THEN 1.0 ELSE 0.0 END) * 100 AS exposure FROM curve GROUP BY 1, 2) e ON e.signal_id = m.signal_id AND e.holding_days = m.holding_days", "curve", "trades")
register("cash_contribution", "signal_id holding_days:i cagr:d cagr_nocash:d cash_contrib_pp:d", on_backtest(lambda b: metrics.without_cash(metrics.curve_metrics(b.curves()), metrics.curve_metrics(b.curves("zero")))),
         f"SELECT a.signal_id, a.holding_days, a.cagr, b.cagr AS cagr_nocash, a.cagr - b.cagr AS cash_contrib_pp FROM ({metric_sql(RUNS)}) a JOIN ({metric_sql(RUNS0)}) b ON a.signal_id = b.signal_id AND a.holding_days = b.holding_days", "curve")
register("benchmark_metrics", METRICS, on_backtest(lambda b: metrics.curve_metrics(backtest.benchmark_curves(b.prices, b.rates))), metric_sql(HOLD), "px", "rf")
register("phase_matrix", "signal_id holding_days:i regime n:i mean:d median:d sd:d win_rate:d n_boundary:i sufficient", on_backtest(lambda b: metrics.regime_matrix(b.trades)),
         f"SELECT e.*, coalesce(n, 0) AS n, mean, median, sd, win_rate, coalesce(n_boundary, 0) AS n_boundary, coalesce(n, 0) >= 20 AS sufficient FROM (SELECT * FROM (SELECT DISTINCT signal_id, holding_days FROM trades) a, (SELECT unnest([{', '.join(repr(r.key) for r in C.REGIMES)}]) AS regime) b) e LEFT JOIN (SELECT signal_id, holding_days, regime, count(*) AS n, avg(r * 100) AS mean, median(r * 100) AS median, stddev_samp(r * 100) AS sd, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0.0 END) AS win_rate, count(*) FILTER (WHERE near) AS n_boundary FROM (SELECT *, {S.REGIME.replace('date ', 'entry_date ')} AS regime, "
         + " OR ".join(f"abs(entry_date - DATE '{x}') <= 1" for r in C.REGIMES for x in (r.start, r.end) if x) + " AS near FROM trades) GROUP BY 1, 2, 3) c ON c.signal_id = e.signal_id AND c.holding_days = e.holding_days AND c.regime = e.regime", "trades")


# --- comparisons
def both_rsi(b: DataFrame) -> DataFrame:
    return indicators.rsi_simple(indicators.rsi_wilder(b)).withColumns({"low_w": F.col("rsi_wilder_14") < 30, "low_s": F.col("rsi_simple_14") < 30})


S.CTE["rs"] = (["gl"], f"SELECT ticker, date, {S.rsi('ag', 'al')} AS simple FROM (SELECT ticker, date, {S.full('avg', 'g', -13, 0)} AS ag, {S.full('avg', 'l', -13, 0)} AS al FROM gl)")
S.CTE["two"] = (["ind", "rs"], "SELECT i.ticker, i.date, i.rsi AS w, r.simple AS s, abs(i.rsi - r.simple) AS diff, i.rsi < 30 AS lw, r.simple < 30 AS ls FROM ind i JOIN rs r ON r.ticker = i.ticker AND r.date = i.date")
register("compare_rsi", "ticker n:i max_diff:d mean_diff:d worst", on_bars(lambda b: compare.compare(both_rsi(b), "rsi_wilder_14", "rsi_simple_14")),
         "SELECT ticker, count(diff) AS n, max(diff) AS max_diff, avg(diff) AS mean_diff, CASE WHEN max(diff) > 0 THEN max_by(date, diff) END AS worst FROM two WHERE diff IS NOT NULL GROUP BY 1", "two")
register("largest_differences", "ticker nth:i date diff:d", on_bars(lambda b: compare.largest(both_rsi(b), "rsi_wilder_14", "rsi_simple_14")),
         "SELECT * FROM (SELECT ticker, date, diff, row_number() OVER (PARTITION BY ticker ORDER BY diff DESC, date) AS nth FROM two WHERE diff IS NOT NULL) WHERE nth <= 5", "two")
PRECISION = "SELECT ticker, max(diff) AS max_abs, max(rel) AS max_rel, max_by(rel, date) FILTER (WHERE rel IS NOT NULL) AS last_rel, count(*) FILTER (WHERE diff > 0) AS n_different, bool_and((w IS NULL) = (s IS NULL)) AS same_nulls FROM (SELECT *, diff / NULLIF(greatest(abs(w), abs(s)), 0) AS rel FROM two) GROUP BY 1"
register("precision", "ticker max_abs:d max_rel:d last_rel:d n_different:i same_nulls verdict", on_bars(lambda b: compare.precision(both_rsi(b), "rsi_wilder_14", "rsi_simple_14")),
         f"SELECT *, CASE WHEN max_abs IS NULL THEN 'nothing to compare' WHEN max_abs = 0 THEN 'exact' WHEN max_abs < 1e-12 THEN 'float noise' WHEN coalesce(max_rel, 0) < 1e-12 THEN 'relative' ELSE 'different' END AS verdict FROM ({PRECISION})", "two")
register("difference_by_era", "ticker max_early:d max_late:d mean_late:d max_diff:d kind", on_bars(lambda b: compare.by_era(both_rsi(b), "rsi_wilder_14", "rsi_simple_14", C.REGIMES[1].start, C.REGIMES[4].start)),
         f"SELECT *, CASE WHEN max_diff <= 1e-12 THEN 'same' WHEN max_late <= 1e-6 THEN 'converges' ELSE 'differs' END AS kind FROM (SELECT ticker, max(diff) FILTER (WHERE date < DATE '{C.REGIMES[1].start}') AS max_early, max(diff) FILTER (WHERE date >= DATE '{C.REGIMES[4].start}') AS max_late, avg(diff) FILTER (WHERE date >= DATE '{C.REGIMES[4].start}') AS mean_late, max(diff) AS max_diff FROM two WHERE diff IS NOT NULL GROUP BY 1)", "two")
FIRED = "SELECT *, ok AND lw AS a, ok AND ls AS b FROM (SELECT *, lw IS NOT NULL AND ls IS NOT NULL AS ok FROM two)"
AROUND = f"SELECT *, max(CAST(coalesce(a, false) AS INT)) OVER w = 1 AS na, max(CAST(coalesce(b, false) AS INT)) OVER w = 1 AS nb FROM ({FIRED}) WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)"
COUNTED = f"SELECT ticker, count(*) FILTER (WHERE ok) AS n_days, count(*) FILTER (WHERE a) AS n_a, count(*) FILTER (WHERE b) AS n_b, count(*) FILTER (WHERE a AND b) AS n_both, count(*) FILTER (WHERE a AND NOT b) AS only_a, count(*) FILTER (WHERE b AND NOT a) AS only_b, count(*) FILTER (WHERE ok AND NOT a AND NOT b) AS neither, count(*) FILTER (WHERE a AND NOT b AND nb) AS only_a_timing, count(*) FILTER (WHERE b AND NOT a AND na) AS only_b_timing FROM ({AROUND}) GROUP BY 1"
register("disagreement", "ticker n_days:i n_both:i only_a:i only_b:i neither:i timing:i real:i rate_a:d rate_b:d frequency_ratio:d a_in_b:d b_in_a:d disagreement:d real_disagreement:d", on_bars(lambda b: compare.disagreement(both_rsi(b), "low_w", "low_s")),
         f"SELECT *, only_a_timing + only_b_timing AS timing, only_a + only_b - only_a_timing - only_b_timing AS real, n_a * 100.0 / n_days AS rate_a, n_b * 100.0 / n_days AS rate_b, n_a * 1.0 / NULLIF(n_b, 0) AS frequency_ratio, n_both * 100.0 / NULLIF(n_a, 0) AS a_in_b, n_both * 100.0 / NULLIF(n_b, 0) AS b_in_a, (only_a + only_b) * 100.0 / NULLIF(n_both + only_a + only_b, 0) AS disagreement, (only_a + only_b - only_a_timing - only_b_timing) * 100.0 / NULLIF(n_both + only_a + only_b, 0) AS real_disagreement FROM ({COUNTED}) WHERE n_days > 0", "two")
