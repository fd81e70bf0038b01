"""The checking SQL: common table expressions by name, put together in the order they need."""

from __future__ import annotations

from tidemark import config as C

REGIME = "CASE " + " ".join(f"WHEN date >= DATE '{r.start}'" + (f" AND date <= DATE '{r.end}'" if r.end else "") + f" THEN '{r.key}'" for r in reversed(C.REGIMES)) + " END"
ORDER = "PARTITION BY ticker ORDER BY date"


def full(agg: str, x: str, lo: int, hi: int) -> str:
    side = lambda k: f"{-k} PRECEDING" if k < 0 else f"{k} FOLLOWING" if k else "CURRENT ROW"
    frame = f"OVER ({ORDER} ROWS BETWEEN {side(lo)} AND {side(hi)})"
    return f"CASE WHEN count({x}) {frame} = {hi - lo + 1} THEN {agg}({x}) {frame} END"


def smooth(name: str, source: str, x: str, alpha: float, n: int, seed: str) -> dict[str, tuple[list[str], str]]:
    """A recursive mean of ``x`` over ``source`` (ticker, date, rn): seeded by the first value or by the mean of the first n."""
    first = f"(SELECT ticker, min(rn) AS f FROM {source} WHERE {x} IS NOT NULL GROUP BY ticker)"
    if seed == "sma":
        start = f"SELECT s.ticker, z.f + {n - 1} AS rn, avg(s.{x}) AS y FROM {source} s JOIN {first} z ON s.ticker = z.ticker AND s.rn BETWEEN z.f AND z.f + {n - 1} GROUP BY s.ticker, z.f HAVING count(s.{x}) = {n}"
    else:
        start = f"SELECT s.ticker, s.rn, s.{x} AS y FROM {source} s JOIN {first} z ON s.ticker = z.ticker AND s.rn = z.f"
    walk = f"{start} UNION ALL SELECT s.ticker, s.rn, r.y + (s.{x} - r.y) * {alpha!r} FROM {name}_r r JOIN {source} s ON s.ticker = r.ticker AND s.rn = r.rn + 1"
    shown = "" if seed == "sma" else f" JOIN {first} z ON r.ticker = z.ticker AND r.rn >= z.f + {n - 1}"
    return {f"{name}_r": ([source], walk), name: ([f"{name}_r"] if seed == "sma" else [f"{name}_r", source], f"SELECT r.ticker, r.rn, r.y FROM {name}_r r{shown}")}


def rsi(g: str, low: str) -> str:
    return f"CASE WHEN {g} IS NULL OR {low} IS NULL THEN NULL WHEN {g} = 0 AND {low} = 0 THEN 50.0 WHEN {low} = 0 THEN 100.0 ELSE 100.0 - 100.0 / (1.0 + {g} / NULLIF({low}, 0)) END"


CTE: dict[str, tuple[list[str], str]] = {
    "ticks": ([], "SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS date, o_orderkey AS k, CAST(10000000000 + SUM(CAST(ROUND(o_totalprice * 100) AS BIGINT) - 25000000) OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) / CAST(100 AS DOUBLE) AS px FROM orders"),
    "bars": (["ticks"], "SELECT ticker, date, min_by(px, k) AS open, max(px) AS high, min(px) AS low, max_by(px, k) AS close, max_by(px, k) AS adj_close, count(*) AS volume FROM ticks GROUP BY ticker, date"),
    "nb": (["bars"], f"SELECT *, row_number() OVER ({ORDER}) - 1 AS rn, close - lag(close) OVER ({ORDER}) AS d, ln(close) - ln(lag(close) OVER ({ORDER})) AS lr FROM bars"),
    "gl": (["nb"], "SELECT *, CASE WHEN d > 0 THEN d WHEN d IS NOT NULL THEN 0.0 END AS g, CASE WHEN d < 0 THEN -d WHEN d IS NOT NULL THEN 0.0 END AS l, CASE WHEN d > 0 THEN d ELSE 0.0 END AS g0, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS l0 FROM nb"),
    "tr": (["bars"], f"SELECT *, CASE WHEN pc IS NOT NULL THEN greatest(hl, hc, lc) END AS tr FROM (SELECT *, high - low AS hl, abs(high - pc) AS hc, abs(low - pc) AS lc FROM (SELECT *, lag(close) OVER ({ORDER}) AS pc, row_number() OVER ({ORDER}) - 1 AS rn FROM bars))"),
    **smooth("wg", "gl", "g", 1 / 14, 14, "sma"), **smooth("wl", "gl", "l", 1 / 14, 14, "sma"), **smooth("fg", "gl", "g0", 1 / 14, 14, "first"), **smooth("fl", "gl", "l0", 1 / 14, 14, "first"),
    **smooth("e12", "nb", "close", 2 / 13, 12, "first"), **smooth("e26", "nb", "close", 2 / 27, 26, "first"), **smooth("atr", "tr", "tr", 1 / 14, 14, "sma"),
    "ml": (["nb", "e12", "e26"], "SELECT nb.ticker, nb.rn, a.y - b.y AS line FROM nb LEFT JOIN e12 a ON a.ticker = nb.ticker AND a.rn = nb.rn LEFT JOIN e26 b ON b.ticker = nb.ticker AND b.rn = nb.rn"),
    **smooth("ms", "ml", "line", 2 / 10, 9, "first"),
    "bb0": (["nb"], f"SELECT *, {full('avg', 'close', -19, 0)} AS mid, {full('stddev_pop', 'close', -19, 0)} AS sd FROM nb"),
    "bb": (["bb0"], "SELECT *, mid + 2 * sd AS up, mid - 2 * sd AS dn FROM bb0"),
    "ind": (["bb", "wg", "wl", "ml", "ms"], f"SELECT bb.*, {rsi('wg.y', 'wl.y')} AS rsi, ml.line, ms.y AS sig FROM bb LEFT JOIN wg ON wg.ticker = bb.ticker AND wg.rn = bb.rn LEFT JOIN wl ON wl.ticker = bb.ticker AND wl.rn = bb.rn LEFT JOIN ml ON ml.ticker = bb.ticker AND ml.rn = bb.rn LEFT JOIN ms ON ms.ticker = bb.ticker AND ms.rn = bb.rn"),
    "cond": (["ind"], "SELECT ticker, date, rn, close, 'S1' AS signal_id, coalesce(rsi < 30, false) AS condition FROM ind UNION ALL SELECT ticker, date, rn, close, 'S2', coalesce(rsi > 70, false) FROM ind UNION ALL SELECT ticker, date, rn, close, 'S3', coalesce(close < dn, false) FROM ind UNION ALL SELECT ticker, date, rn, close, 'S4', coalesce(close > up, false) FROM ind UNION ALL SELECT ticker, date, rn, close, 'S5', coalesce(line > sig, false) FROM ind"),
    "sigs": (["cond"], "SELECT *, condition AND NOT coalesce(lag(condition) OVER (PARTITION BY signal_id, ticker ORDER BY date), false) AS signal FROM cond"),
    "fwd": (["nb"], "SELECT ticker, date, rn, close, " + ", ".join(f"lead(close, {1 + h}) OVER ({ORDER}) / lead(close, 1) OVER ({ORDER}) - 1 AS f{h}" for h in C.HORIZONS) + " FROM nb"),
    "ev": (["sigs", "fwd"], f"SELECT s.*, f1, f5, f10, f20, {REGIME.replace('date ', 's.date ')} AS regime FROM sigs s JOIN fwd f ON s.ticker = f.ticker AND s.date = f.date WHERE s.ticker = '{C.SIGNAL_TICKER}' AND s.date >= DATE '{C.START}'"),
    "cal": (["fwd"], f"SELECT * FROM fwd WHERE ticker = '{C.SIGNAL_TICKER}' AND date >= DATE '{C.START}'"),
    "evh": (["ev"], " UNION ALL ".join(f"SELECT signal_id, date, {h} AS h, f{h} AS ret FROM ev WHERE signal" for h in C.HORIZONS)),
    "calh": (["cal"], " UNION ALL ".join(f"SELECT date, {h} AS h, f{h} AS ret FROM cal" for h in C.HORIZONS)),
    "study": (["evh", "calh"], "SELECT e.signal_id, e.h, e.n, e.mean, e.median, e.sd, e.win_pct, b.n_all, b.mean_all, b.sd_all, e.mean - b.mean_all AS difference FROM (SELECT signal_id, h, count(ret) AS n, avg(ret) AS mean, median(ret) AS median, stddev_samp(ret) AS sd, avg(CASE WHEN ret > 0 THEN 1.0 WHEN ret IS NOT NULL THEN 0.0 END) * 100 AS win_pct FROM evh GROUP BY 1, 2) e JOIN (SELECT h, count(ret) AS n_all, avg(ret) AS mean_all, stddev_samp(ret) AS sd_all FROM calh GROUP BY 1) b ON e.h = b.h"),
    "rates": ([], "SELECT CAST(l_shipdate AS DATE) AS date, ROUND(AVG(l_tax) * 100, 3) AS rate FROM lineitem GROUP BY 1"),
    "vol": (["nb", "sigs"], f"SELECT v.*, coalesce(s.signal, false) AS is_signal FROM (SELECT ticker, date, rn, lr, {full('stddev_samp', 'lr', -13, 0)} AS pre, {full('stddev_samp', 'lr', 2, 21)} AS post, {full('stddev_samp', 'lr', 1, 20)} AS post1 FROM nb) v LEFT JOIN sigs s ON s.ticker = v.ticker AND s.date = v.date AND s.signal_id = 'S3'"),
    "bins": (["vol"], f"SELECT *, CASE WHEN c >= {C.LEAST_HISTORY} AND pre IS NOT NULL THEN 1 + CAST(pre >= q[1] AS INT) + CAST(pre >= q[2] AS INT) + CAST(pre >= q[3] AS INT) + CAST(pre >= q[4] AS INT) END AS stratum FROM (SELECT *, count(pre) OVER w AS c, quantile_cont(pre, [0.2, 0.4, 0.6, 0.8]) OVER w AS q FROM vol WINDOW w AS ({ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"),
    "frame": (["bins"], f"SELECT ticker, date, rn AS pos, stratum, is_signal, pre, post, ln(pre) AS lpre, ln(post1) AS y FROM bins WHERE date >= DATE '{C.START}' AND stratum IS NOT NULL AND post IS NOT NULL AND pre > 0 AND post1 > 0"),
    "rf": (["bars", "rates"], f"SELECT b.ticker, b.date, r.rate / 100 / {C.TRADING_DAYS} AS raw, last_value(r.rate / 100 / {C.TRADING_DAYS} IGNORE NULLS) OVER (PARTITION BY b.ticker ORDER BY b.date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS risk_free FROM bars b LEFT JOIN rates r ON b.date = r.date"),
    "px": (["bars"], f"SELECT ticker, date, close, row_number() OVER ({ORDER}) - 1 AS pos, close / lag(close) OVER ({ORDER}) - 1 AS move FROM bars WHERE date >= DATE '{C.START}' AND ticker = '{C.SIGNAL_TICKER}'"),
    "hits": (["px", "ev"], "SELECT ev.signal_id, px.pos, row_number() OVER (PARTITION BY ev.signal_id ORDER BY px.pos) AS k FROM ev JOIN px ON ev.date = px.date WHERE ev.signal"),
    "hold": ([], "SELECT unnest([1, 5, 10, 20]) AS h"),
    "run_r": (["hits", "hold", "px"], "SELECT signal_id, h, k, CASE WHEN pos + 1 + h <= (SELECT max(pos) FROM px) THEN pos END AS taken, CASE WHEN pos + 1 + h <= (SELECT max(pos) FROM px) THEN pos + 1 + h ELSE -1 END AS free FROM hits, hold WHERE k = 1 UNION ALL SELECT n.signal_id, r.h, n.k, CASE WHEN n.pos >= r.free AND n.pos + 1 + r.h <= (SELECT max(pos) FROM px) THEN n.pos END, CASE WHEN n.pos >= r.free AND n.pos + 1 + r.h <= (SELECT max(pos) FROM px) THEN n.pos + 1 + r.h ELSE r.free END FROM run_r r JOIN hits n ON n.signal_id = r.signal_id AND n.k = r.k + 1"),
    "trades": (["run_r", "px"], f"SELECT signal_id, '{C.SIGNAL_TICKER}' AS ticker, h AS holding_days, a.pos AS entry_pos, b.pos AS exit_pos, a.date AS entry_date, b.date AS exit_date, a.close AS entry_price, b.close AS exit_price, (b.close * (1 - {C.COST})) / (a.close * (1 + {C.COST})) - 1 AS r FROM run_r JOIN px a ON a.pos = taken + 1 JOIN px b ON b.pos = taken + 1 + h"),
    "curve": (["trades", "px", "rf"], f"""SELECT g.*, product(1 + coalesce(pr, coalesce(risk_free, 0))) OVER (PARTITION BY signal_id, holding_days ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS growth, product(1 + coalesce(pr, 0)) OVER (PARTITION BY signal_id, holding_days ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS growth0 FROM (
        SELECT u.signal_id, u.holding_days, px.ticker, px.date, px.pos, rf.risk_free, CASE WHEN t.entry_pos IS NULL THEN NULL WHEN px.pos = t.entry_pos THEN -{C.COST} WHEN px.pos = t.exit_pos THEN (1 + px.move) * (1 - {C.COST}) - 1 ELSE px.move END AS pr, coalesce(px.pos > t.entry_pos, false) AS held
        FROM (SELECT DISTINCT signal_id, holding_days FROM trades) u CROSS JOIN px LEFT JOIN trades t ON t.signal_id = u.signal_id AND t.holding_days = u.holding_days AND px.pos BETWEEN t.entry_pos AND t.exit_pos LEFT JOIN rf ON rf.ticker = px.ticker AND rf.date = px.date) g"""),
}


def query(select: str, *needs: str) -> str:
    """``select`` with the expressions it needs before it."""
    order: list[str] = []

    def visit(name: str) -> None:
        for x in CTE[name][0]:
            visit(x)
        if name not in order:
            order.append(name)

    for name in needs:
        visit(name)
    heads = ", ".join(f"{n} AS ({CTE[n][1]})" if not n.endswith("_r") else f"{n}{columns(n)} AS ({CTE[n][1]})" for n in order)
    return (f"WITH RECURSIVE {heads} " if order else "") + select


def columns(name: str) -> str:
    return "(signal_id, h, k, taken, free)" if name == "run_r" else "(ticker, rn, y)"
