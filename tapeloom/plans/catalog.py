"""Registered queries on the adapted tables, each with SQL that gives the same rows.

Doubles are rounded alike on both sides, as sums may be taken in another order.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.normal import cdf_sql, ppf_sql
from tapeloom.operators import align, bars, book, dispersion, features, flow, ic, ledger, pnl, quality, runs, stats
from tapeloom.plans import models as model_plans
from tapeloom.plans import raw
from tapeloom.sources import adapters as a
from tapeloom.sources import layers, messages
from tapeloom.sources.adapters import ctes
from tapeloom.streaming import plans as stream_plans

FLAGSHIP = "basis_drift_risk"
QUERIES: dict = {}
ORACLE_SQL: dict = {}
COSTS = pnl.CostModel()
RT = COSTS.round_trip()
BAR = 600_000
END_MS = 1_706_000_000_000  # a freeze inside the events' January 2024
MID_MS = 1_705_000_000_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded to ``places``; other columns as they are."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def legs_of(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return a.spot(s, d), a.marks(s, d), a.funding(s, d)


def daily_drift(s: SparkSession, d: str) -> DataFrame:
    return pnl.to_daily(pnl.basis_drift(*legs_of(s, d)))


def daily_hold(s: SparkSession, d: str) -> DataFrame:
    return pnl.buy_and_hold(a.daily_prices(s, d))


DRIFT = ctes("mk", "sp", "fu") + """,
pl AS (SELECT mk.coin, mk.hour, spot, perp, coalesce(funding_rate, 0) AS f FROM mk JOIN sp USING (coin, hour) LEFT JOIN fu USING (coin, hour)),
dr AS (SELECT coin, hour, f, ((spot - lag(spot) OVER w) - (perp - lag(perp) OVER w)) / nullif(lag(perp) OVER w, 0) AS drift FROM pl WINDOW w AS (PARTITION BY coin ORDER BY hour)),
pn AS (SELECT coin, hour, drift, f, drift + f AS pnl FROM dr WHERE drift IS NOT NULL),
da AS (SELECT coin AS series, DATE '1970-01-01' + CAST(hour // 86400000 AS INT) AS day, sum(pnl) AS ret FROM pn GROUP BY 1, 2),
ca AS (SELECT coin AS series, DATE '1970-01-01' + CAST(hour // 86400000 AS INT) AS day, sum(funding_rate) AS ret FROM fu GROUP BY 1, 2)"""
HOLD = ctes("dp") + """,
re AS (SELECT series, day, close / nullif(lag(close) OVER (PARTITION BY series ORDER BY day), 0) - 1 AS r FROM dp),
da AS (SELECT series, day, r AS ret FROM re WHERE r IS NOT NULL)"""
SHARPE = "CASE WHEN stddev_samp({0}) > 0 THEN avg({0}) / stddev_samp({0}) * sqrt(365) ELSE 0 END"


# ---- return series ----

@query(ctes("fu") + " SELECT coin, hour, round(funding_rate, 9) AS pnl FROM fu")
def funding_carry(s, d):
    return rounded(pnl.funding_carry(a.funding(s, d)), 9)


@query(DRIFT + " SELECT coin, hour, round(drift, 9) AS drift_pnl, round(f, 9) AS funding_pnl, round(pnl, 9) AS pnl FROM pn")
def basis_drift_hours(s, d):
    return rounded(pnl.basis_drift(*legs_of(s, d)), 9)


@query(DRIFT + f""", ne AS (SELECT series, ret, ret - {RT!r} / count(*) OVER (PARTITION BY series) - 2.0 / 10000 AS net FROM da),
z AS (SELECT series, count(*) AS n, avg(ret) * 365 AS gross_apr, {SHARPE.format('ret')} AS gross_sharpe, avg(net) * 365 AS net_apr, {SHARPE.format('net')} AS net_sharpe FROM ne GROUP BY series)
SELECT series, n, round(gross_apr, 6) AS gross_apr, round(gross_sharpe, 6) AS gross_sharpe, round(net_apr, 6) AS net_apr, round(net_sharpe, 6) AS net_sharpe,
  CASE WHEN net_sharpe <= 0 THEN 'not deployable' WHEN net_sharpe < 1.8 THEN 'marginal' ELSE 'deployable' END AS verdict FROM z""")
def basis_drift_risk(s, d):
    return rounded(pnl.net_metrics(daily_drift(s, d), RT, 1.0, 1.0))


@query(HOLD + f""" SELECT series, count(*) AS n, round({SHARPE.format('ret')}, 6) AS sharpe, round(avg(ret) * 365, 6) AS apr, round(coalesce(stddev_samp(ret), 0) * sqrt(365), 6) AS vol FROM da GROUP BY series""")
def series_risk(s, d):
    return rounded(stats.annualised(daily_hold(s, d), ["series"]))


@query(HOLD + """ SELECT series, count(*) AS t, round(avg(ret) / stddev_samp(ret), 6) AS sr, round(skewness(ret), 6) AS skew, round(kurtosis(ret) + 3, 6) AS kurt FROM da GROUP BY series""")
def psr_inputs(s, d):
    return rounded(stats.psr_inputs(daily_hold(s, d), ["series"]))


@query(HOLD + """, k AS (SELECT count(DISTINCT series) AS k FROM da WHERE series <> '5-LOW'),
x AS (SELECT day, avg(ret) AS ret FROM da WHERE series <> '5-LOW' GROUP BY day HAVING count(*) = (SELECT k FROM k))
SELECT 'BASKET' AS series, day, round(ret, 9) AS ret FROM x""")
def basket_returns(s, d):
    return rounded(pnl.basket(daily_hold(s, d), exclude=("5-LOW",)), 9)


@query(ctes("dp") + """, x AS (SELECT series, day, close / lag(close, 30) OVER (PARTITION BY series ORDER BY day) - 1 AS r FROM dp)
SELECT series, day, CASE WHEN r < -0.10 THEN 'bear' WHEN r > 0.10 THEN 'bull' ELSE 'calm' END AS regime FROM x""")
def regime_days(s, d):
    return pnl.regime_labels(a.daily_prices(s, d))


@query(HOLD + f""", x AS (SELECT series, day, close / lag(close, 30) OVER (PARTITION BY series ORDER BY day) - 1 AS r FROM dp),
l AS (SELECT series, day, CASE WHEN r < -0.10 THEN 'bear' WHEN r > 0.10 THEN 'bull' ELSE 'calm' END AS regime FROM x)
SELECT series, regime, count(*) AS n, round({SHARPE.format('ret')}, 6) AS sharpe, round(avg(ret) * 365, 6) AS apr, round(coalesce(stddev_samp(ret), 0) * sqrt(365), 6) AS vol
FROM da JOIN l USING (series, day) GROUP BY series, regime HAVING count(*) >= 10""")
def regime_risk(s, d):
    return rounded(stats.regime_sharpe(daily_hold(s, d), pnl.regime_labels(a.daily_prices(s, d))))


@query(ctes("dp") + """, x AS (SELECT series, day, close / lag(close, 30) OVER (PARTITION BY series ORDER BY day) - 1 AS r FROM dp),
l AS (SELECT series, day, CASE WHEN r < -0.10 THEN 'bear' WHEN r > 0.10 THEN 'bull' ELSE 'calm' END AS regime FROM x)
SELECT series, arg_max(regime, day) AS regime, max(day) AS as_of FROM l GROUP BY series""")
def latest_regimes(s, d):
    return pnl.latest_regime(pnl.regime_labels(a.daily_prices(s, d)))


def _rung_rows(s, d):
    return pnl.ladder(pnl.to_daily(pnl.funding_carry(a.funding(s, d))), daily_drift(s, d), RT)


LADDER_SQL = DRIFT + f""",
bd AS (SELECT 'BASKET' AS series, day, avg(ret) AS ret FROM da GROUP BY day HAVING count(*) = (SELECT count(DISTINCT series) FROM da)),
bc AS (SELECT 'BASKET' AS series, day, avg(ret) AS ret FROM ca GROUP BY day HAVING count(*) = (SELECT count(DISTINCT series) FROM ca)),
al AS (SELECT 'drift' AS kind, * FROM da UNION ALL SELECT 'drift', * FROM bd UNION ALL SELECT 'carry', * FROM ca UNION ALL SELECT 'carry', * FROM bc),
rg AS (SELECT * FROM (VALUES ('funding_only', 'carry', 0.0), ('basis_drift', 'drift', 0.0), ('realistic', 'drift', 2.0), ('realistic_b', 'drift', 1.0)) AS t(rung, kind, drag)),
ne AS (SELECT series, rung, day, ret - {RT!r} / count(*) OVER (PARTITION BY series, rung) - CAST(drag AS DOUBLE) / 10000 AS net FROM al JOIN rg USING (kind))"""


@query(LADDER_SQL + f" SELECT series, rung, count(*) AS n, round({SHARPE.format('net')}, 9) AS sharpe, round(avg(net) * 365, 9) AS apr, round(coalesce(stddev_samp(net), 0) * sqrt(365), 9) AS vol FROM ne GROUP BY series, rung")
def cost_ladder(s, d):
    return rounded(stats.annualised(_rung_rows(s, d), ["series", "rung"], "net"), 9)


def psr_sql(star: str) -> str:
    """The probabilistic Sharpe ratio of columns ``sr, t, skew, kurt`` over the column ``star``."""
    return cdf_sql(f"((sr - {star}) * sqrt(greatest(1.0, t - 1.0)) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt - 1) / 4 * sr * sr)))")


def star_sql(var: str, n: str) -> str:
    """The expected best Sharpe of ``n`` trials of a variance."""
    best = f"(1 - {stats.EULER!r}) * ({ppf_sql(f'(1 - 1.0::DOUBLE / {n})')}) + {stats.EULER!r} * ({ppf_sql(f'(1 - 1.0::DOUBLE / ({n} * {math.e!r}))')})"
    return f"CASE WHEN {n} < 2 OR {var} <= 0 OR {var} IS NULL THEN 0 ELSE sqrt({var}) * ({best}) END"


#: Inputs of the ratio of daily values; a flat series has 0, 0 and 3.
PSR_SQL = """CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) ELSE 0 END AS sr, count(*) AS t, CASE WHEN stddev_samp(net) > 0 AND count(*) > 2 THEN skewness(net) ELSE 0 END AS skew,
CASE WHEN stddev_samp(net) > 0 AND count(*) > 3 THEN kurtosis(net) + 3 ELSE 3 END AS kurt"""


@query(LADDER_SQL + f""", pi AS (SELECT series, rung, {PSR_SQL} FROM ne GROUP BY series, rung), nv AS (SELECT count(*) AS n_trials, coalesce(var_samp(sr), 0) AS var_sr FROM pi),
st AS (SELECT *, {star_sql('var_sr', 'n_trials')} AS sr_star FROM nv)
SELECT series, rung, round(sr, 6) AS sr, t, round(skew, 6) AS skew, round(kurt, 6) AS kurt, n_trials, round(var_sr, 6) AS var_sr, round(sr_star, 6) AS sr_star, round({psr_sql('sr_star')}, 6) AS dsr FROM pi, st""")
def deflated_ladder(s, d):
    return rounded(stats.deflated(_rung_rows(s, d), ["series", "rung"]))


@query(LADDER_SQL + """, x AS (SELECT series, rung, CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) ELSE 0 END AS sr FROM ne GROUP BY series, rung)
SELECT count(*) AS n_trials, round(var_samp(sr), 9) AS var_sr FROM x""")
def trial_variance(s, d):
    x = stats.psr_inputs(_rung_rows(s, d), ["series", "rung"], "net")
    return rounded(x.agg(F.count("*").alias("n_trials"), F.var_samp("sr").alias("var_sr")), 9)


SWEPT = [0.0, 0.5, 1.0, 2.0, 5.0]


def _cells(s, d):
    return pnl.cost_sweep(daily_hold(s, d), [(x, y, z) for x in SWEPT for y in SWEPT for z in (1.0, 2.0)], RT)


SWEEP_SQL = HOLD + f""",
g AS (SELECT CAST(x AS DOUBLE) AS drift_bps, CAST(y AS DOUBLE) AS borrow_bps, CAST(z AS DOUBLE) AS fee_mult FROM (SELECT unnest({SWEPT})) a(x), (SELECT unnest({SWEPT})) b(y), range(1, 3) c(z)),
ne AS (SELECT series, drift_bps, borrow_bps, fee_mult, ret - {RT!r} * fee_mult / count(*) OVER (PARTITION BY series, drift_bps, borrow_bps, fee_mult) - (drift_bps + borrow_bps) / 10000 AS net FROM da, g),
ce AS (SELECT series, drift_bps, borrow_bps, fee_mult, count(*) AS n, {SHARPE.format('net')} AS sharpe, avg(net) * 365 AS apr, coalesce(stddev_samp(net), 0) * sqrt(365) AS vol FROM ne GROUP BY ALL)"""


@query(SWEEP_SQL + " SELECT series, drift_bps, borrow_bps, fee_mult, n, round(sharpe, 6) AS sharpe, round(apr, 6) AS apr, round(vol, 6) AS vol FROM ce")
def cost_sweep(s, d):
    return rounded(_cells(s, d))


@query(SWEEP_SQL + """ SELECT series, count(*) AS n_cells, count(*) FILTER (WHERE sharpe > 0) AS n_positive, count(*) FILTER (WHERE p) AS n_plausible,
count(*) FILTER (WHERE p AND sharpe > 0) AS n_plausible_positive, round(median(sharpe) FILTER (WHERE p), 6) AS plausible_median,
round(max(sharpe) FILTER (WHERE drift_bps = 1 AND borrow_bps = 1 AND fee_mult = 1), 6) AS central_sharpe, round(max(sharpe) FILTER (WHERE drift_bps = 0 AND borrow_bps = 0 AND fee_mult = 1), 6) AS zero_sharpe,
round(max(sharpe) FILTER (WHERE drift_bps = 5 AND borrow_bps = 5 AND fee_mult = 2), 6) AS stress_sharpe
FROM (SELECT *, drift_bps <= 2 AND borrow_bps <= 2 AND fee_mult = 1 AS p FROM ce) GROUP BY series""")
def sweep_zones(s, d):
    return rounded(pnl.sweep_zones(_cells(s, d)))


@query(HOLD + """, x AS (SELECT series, ret, row_number() OVER (PARTITION BY series ORDER BY day) - 1 AS i FROM da), n AS (SELECT series, count(*) AS n FROM x GROUP BY series),
b AS (SELECT series, n, r, b, CAST('0x' || substr(md5('42-' || r || '-' || b), 1, 8) AS BIGINT) % greatest(1, n - 9) AS s FROM n, range(1000) t(r), range(100000) u(b) WHERE b < ceil(n / 10.0)),
k AS (SELECT series, r, s + k AS i FROM b, range(10) v(k) WHERE b * 10 + k < n AND s + k < n),
z AS (SELECT series, r, CASE WHEN stddev_pop(ret) > 0 THEN avg(ret) / stddev_pop(ret) * sqrt(365) ELSE 0 END AS sharpe FROM k JOIN x USING (series, i) GROUP BY series, r)
SELECT series, round(quantile_cont(sharpe, 0.025), 6) AS lo, round(quantile_cont(sharpe, 0.975), 6) AS hi FROM z GROUP BY series""")
def bootstrap_interval(s, d):
    return rounded(stats.bootstrap_sharpe(daily_hold(s, d), ["series"]))


@query(HOLD + """, x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY day) AS up, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS down FROM da),
ne AS (SELECT series, day, ret, ret - 1.0 / 10000 - CASE WHEN up = 1 THEN 0.0018 / 2 + 2 * 0.0003 ELSE 0 END - CASE WHEN down = 1 THEN 0.0018 / 2 + 2 * 0.0004 ELSE 0 END AS net FROM x)
SELECT series, day, round(ret, 6) AS ret, round(net, 6) AS net, round(sum(net) OVER (PARTITION BY series ORDER BY day), 6) AS cum_net FROM ne""")
def carry_ledger(s, d):
    return rounded(pnl.carry_ledger(daily_hold(s, d), 0.0018, 0.0003, 0.0004, 1.0))


@query(DRIFT + """, x AS (SELECT series, day, ret, 'drift' AS source FROM da WHERE series = '0')
SELECT series, day, round(ret, 9) AS ret, source FROM x UNION ALL SELECT series, day, round(ret, 9), 'carry' FROM ca WHERE series NOT IN (SELECT series FROM x)""")
def series_fallback(s, d):
    return rounded(pnl.with_fallback(daily_drift(s, d).filter("series = '0'"), pnl.to_daily(pnl.funding_carry(a.funding(s, d)))), 9)


WINDOW_SQL = DRIFT + f""",
hs AS (SELECT coin AS series, DATE '1970-01-01' + CAST(hour // 86400000 AS INT) AS day, arg_max(spot, hour) AS close FROM sp GROUP BY 1, 2),
hr AS (SELECT series, day, close / nullif(lag(close) OVER (PARTITION BY series ORDER BY day), 0) - 1 AS ret FROM hs),
un AS (SELECT 'carry' AS kind, series, day, ret FROM ca UNION ALL SELECT 'drift', series, day, ret FROM da UNION ALL SELECT 'hold', series, day, ret FROM hr WHERE ret IS NOT NULL),
cd AS (SELECT day FROM un GROUP BY day HAVING count(DISTINCT kind || ':' || series) = (SELECT count(DISTINCT kind || ':' || series) FROM un)),
co AS (SELECT kind, series, un.day, ret FROM un JOIN cd ON un.day = cd.day),
he AS (SELECT * FROM co UNION ALL SELECT kind, 'BASKET', day, avg(ret) FROM co GROUP BY kind, day UNION ALL SELECT kind, 'BASKET_DROP', day, avg(ret) FROM co WHERE series <> '1' GROUP BY kind, day),
rg AS (SELECT * FROM (VALUES ('funding_only', 'carry', 0.0), ('basis_drift', 'drift', 0.0), ('realistic', 'drift', 2.0), ('realistic_b', 'drift', 1.0)) AS t(rung, kind, drag)),
rn AS (SELECT series, rung, day, ret - {RT!r} / count(*) OVER (PARTITION BY series, rung) - CAST(drag AS DOUBLE) / 10000 AS net FROM he JOIN rg USING (kind)),
rs AS (SELECT series, rung, count(*) AS n, {SHARPE.format('net')} AS sharpe, avg(net) * 365 AS apr, CASE WHEN stddev_samp(net) > 0 THEN avg(net) / stddev_samp(net) ELSE 0 END AS sr FROM rn GROUP BY series, rung)"""


def _window(s, d):
    hold = pnl.buy_and_hold(pnl.daily_last(a.spot(s, d), value="spot"))
    return pnl.one_window({"carry": pnl.to_daily(pnl.funding_carry(a.funding(s, d))), "drift": daily_drift(s, d), "hold": hold}, exclude=("1",))


@query(WINDOW_SQL + " SELECT series, rung, n, round(sharpe, 6) AS sharpe, round(apr, 6) AS apr FROM rs")
def window_rungs(s, d):
    return rounded(stats.annualised(pnl.window_rungs(_window(s, d), RT), ["series", "rung"], "net").drop("vol"))


@query(WINDOW_SQL + f""", st AS (SELECT * FROM (VALUES ('buy_and_hold', 'hold', '0', 0.0), ('equal_weight_spot', 'hold', 'BASKET', 0.0), ('naive_carry', 'carry', 'BASKET_DROP', 0.0),
('basis_drift', 'drift', 'BASKET_DROP', 0.0), ('realistic', 'drift', 'BASKET_DROP', 2.0), ('realistic_b', 'drift', 'BASKET_DROP', 1.0)) AS t(strategy, kind, series, drag)),
sn AS (SELECT strategy, ret - {RT!r} / count(*) OVER (PARTITION BY strategy) - CAST(drag AS DOUBLE) / 10000 AS net FROM he JOIN st USING (kind, series)),
tr AS (SELECT count(*) AS n_all, var_samp(sr) AS var_all, count(*) FILTER (WHERE rung <> 'funding_only') AS n_hedged, var_samp(sr) FILTER (WHERE rung <> 'funding_only') AS var_hedged FROM rs)
SELECT strategy, count(*) AS n, round({SHARPE.format('net')}, 6) AS sharpe, round(avg(net) * 365, 6) AS apr, any_value(n_all) AS n_all, round(any_value(var_all), 6) AS var_all,
any_value(n_hedged) AS n_hedged, round(any_value(var_hedged), 6) AS var_hedged FROM sn, tr GROUP BY strategy""")
def strategy_baselines(s, d):
    return rounded(pnl.strategy_baselines(_window(s, d), "0", RT).drop("dsr_all", "dsr_hedged"))


@query(WINDOW_SQL + f""", st AS (SELECT * FROM (VALUES ('buy_and_hold', 'hold', '0', 0.0), ('equal_weight_spot', 'hold', 'BASKET', 0.0), ('naive_carry', 'carry', 'BASKET_DROP', 0.0),
('basis_drift', 'drift', 'BASKET_DROP', 0.0), ('realistic', 'drift', 'BASKET_DROP', 2.0), ('realistic_b', 'drift', 'BASKET_DROP', 1.0)) AS t(strategy, kind, series, drag)),
sn AS (SELECT strategy, ret - {RT!r} / count(*) OVER (PARTITION BY strategy) - CAST(drag AS DOUBLE) / 10000 AS net FROM he JOIN st USING (kind, series)),
nv AS (SELECT count(*) AS n_all, var_samp(sr) AS var_all, count(*) FILTER (WHERE rung <> 'funding_only') AS n_hedged, var_samp(sr) FILTER (WHERE rung <> 'funding_only') AS var_hedged FROM rs),
ba AS (SELECT {star_sql('var_all', 'n_all')} AS star_all, {star_sql('var_hedged', 'n_hedged')} AS star_hedged FROM nv),
pi AS (SELECT strategy, {PSR_SQL} FROM sn GROUP BY strategy)
SELECT strategy, round({psr_sql('star_all')}, 6) AS dsr_all, round({psr_sql('star_hedged')}, 6) AS dsr_hedged FROM pi, ba""")
def baseline_deflation(s, d):
    return rounded(pnl.strategy_baselines(_window(s, d), "0", RT).select("strategy", "dsr_all", "dsr_hedged"))


# ---- bars, signals, flows ----

@query(ctes("qu") + f""" SELECT coin, bbo_ms // {BAR} * {BAR} AS bar, round(avg((bid_sz - ask_sz) / nullif(bid_sz + ask_sz, 0)), 9) AS obi, round(arg_max((bid_px + ask_px) / 2, (bbo_ms, seq)), 9) AS mid,
round(avg((ask_px - bid_px) / nullif((ask_px + bid_px) / 2, 0)) * 10000, 6) AS spread_bps FROM qu GROUP BY 1, 2""")
def quote_bars(s, d):
    x = bars.quote_bars(a.quotes(s, d), BAR)
    return x.select("coin", "bar", F.round("obi", 9).alias("obi"), F.round("mid", 9).alias("mid"), F.round("spread_bps", 6).alias("spread_bps"))


@query(ctes("qu") + " SELECT coin, bbo_ms // 300000 * 300000 AS bar, round(arg_max((bid_px + ask_px) / 2, (bbo_ms, seq)), 9) AS mid FROM qu GROUP BY 1, 2")
def mid_bars(s, d):
    return rounded(bars.mid_bars(a.quotes(s, d)), 9)


LABEL_SQL = ctes("tr") + f""",
lg AS (SELECT users_buyer AS w, coin, sz AS q, -notional AS c FROM tr WHERE trade_ms < {END_MS} UNION ALL SELECT users_seller, coin, -sz, notional FROM tr WHERE trade_ms < {END_MS}),
ma AS (SELECT coin, arg_max(px, (trade_ms, tid)) AS mark FROM tr WHERE trade_ms <= {END_MS} GROUP BY coin),
po AS (SELECT w, coin, sum(q) AS q, sum(c) AS c, count(*) AS n FROM lg GROUP BY 1, 2),
tt AS (SELECT w AS wallet, sum(c + q * mark) AS total_pnl_usd, CAST(sum(n) AS BIGINT) AS n_trades FROM po JOIN ma USING (coin) GROUP BY 1),
lb AS (SELECT *, n_trades >= 20 AND total_pnl_usd >= (SELECT quantile_cont(total_pnl_usd, 0.8) FROM tt WHERE n_trades >= 20) AS is_smart FROM tt),
sm AS (SELECT wallet FROM lb WHERE is_smart)"""


def _labels(s, d):
    t = a.trades(s, d)
    marks = t.select("coin", F.struct("trade_ms", "tid").alias("at"), F.col("trade_ms").alias("ms"), F.col("px").alias("close"))
    last = marks.filter(F.col("ms") <= END_MS).groupBy("coin").agg(F.max_by("close", "at").alias("close"), F.max("ms").alias("ms"))
    return flow.wallet_labels(t, last, END_MS, min_legs=20)


def _smart(s, d):
    return _labels(s, d).filter("is_smart").select("wallet")


@query(LABEL_SQL + " SELECT wallet, round(total_pnl_usd, 4) AS total_pnl_usd, n_trades, is_smart FROM lb")
def wallet_labels(s, d):
    return rounded(_labels(s, d), 4)


@query(LABEL_SQL + f""", fl AS (SELECT coin, trade_ms, tid, px, notional, CASE WHEN users_buyer IN (SELECT wallet FROM sm) THEN notional ELSE 0 END - CASE WHEN users_seller IN (SELECT wallet FROM sm) THEN notional ELSE 0 END AS inf,
CASE WHEN side = 'B' THEN notional ELSE -notional END AS tk FROM tr)
SELECT coin, trade_ms // {BAR} * {BAR} AS bar, round(sum(inf), 4) AS inf_net, round(sum(tk), 4) AS taker, round(arg_max(px, (trade_ms, tid)), 4) AS px, round(sum(notional), 4) AS notional FROM fl GROUP BY 1, 2""")
def flow_bars(s, d):
    return rounded(bars.flow_bars(flow.signed_flows(a.trades(s, d), _smart(s, d)), BAR), 4)


FLOW_HORIZONS = {"h1": 1, "h2": 2, "h10": 10, "h30": 30}
RATE_SQL = LABEL_SQL + f""", fl AS (SELECT coin, trade_ms, tid, px, notional, CASE WHEN users_buyer IN (SELECT wallet FROM sm) THEN notional ELSE 0 END - CASE WHEN users_seller IN (SELECT wallet FROM sm) THEN notional ELSE 0 END AS inf,
CASE WHEN side = 'B' THEN notional ELSE -notional END AS tk FROM tr),
fb AS (SELECT coin, trade_ms // {BAR} * {BAR} AS bar, round(sum(inf), 4) AS inf_net, round(sum(tk), 4) AS taker, round(arg_max(px, (trade_ms, tid)), 4) AS px FROM fl GROUP BY 1, 2),
ro AS (SELECT coin, bar, px, CASE WHEN count(inf_net) OVER r = 4 THEN round(sum(inf_net) OVER r, 3) END AS inf_rate, CASE WHEN count(taker) OVER r = 4 THEN round(sum(taker) OVER r, 3) END AS taker_rate
FROM fb WINDOW r AS (PARTITION BY coin ORDER BY bar ROWS BETWEEN 3 PRECEDING AND CURRENT ROW))"""
_FLOW_PAIRS = ", pr AS (" + " UNION ALL ".join(
    f"SELECT coin, '{c}' AS rate, '{n}' AS horizon, {c} AS signal, (lead(px, {h}) OVER (PARTITION BY coin ORDER BY bar) / nullif(px, 0) - 1) * 10000 AS fwd FROM ro" for c in ("inf_rate", "taker_rate") for n, h in FLOW_HORIZONS.items()) + """),
pp AS (SELECT * FROM pr WHERE fwd IS NOT NULL AND signal IS NOT NULL)"""


def _rates(s, d):
    return flow.flow_rates(flow_bars(s, d))


@query(RATE_SQL + _FLOW_PAIRS + """, rk AS (SELECT coin, rate, horizon, rank() OVER (PARTITION BY coin, rate, horizon ORDER BY signal) + (count(*) OVER (PARTITION BY coin, rate, horizon, signal) - 1) / 2.0 AS rs,
rank() OVER (PARTITION BY coin, rate, horizon ORDER BY fwd) + (count(*) OVER (PARTITION BY coin, rate, horizon, fwd) - 1) / 2.0 AS rf FROM pp)
SELECT coin, rate, horizon, count(*) AS n, CASE WHEN count(*) >= 100 THEN round(corr(rs, rf), 6) END AS ic FROM rk GROUP BY 1, 2, 3""")
def informed_flow_ic(s, d):
    rates = _rates(s, d)
    pairs = [ic.with_horizons(rates, "px", FLOW_HORIZONS, c).withColumn("rate", F.lit(c)) for c in ("inf_rate", "taker_rate")]
    return rounded(ic.spearman(pairs[0].unionByName(pairs[1]), ["coin", "rate", "horizon"], "signal", "fwd"))


@query(RATE_SQL + _FLOW_PAIRS + "," + ctes("qu")[5:].replace(a.CTES["ev"] + ",\n", "", 1) + f""",
qb AS (SELECT coin, bbo_ms // {BAR} * {BAR} AS bar, round(avg((ask_px - bid_px) / nullif((ask_px + bid_px) / 2, 0)) * 10000, 6) AS spread_bps FROM qu GROUP BY 1, 2),
sp AS (SELECT coin, median(spread_bps) AS spread FROM qb GROUP BY coin), nb AS (SELECT coin, count(*) AS bars FROM ro GROUP BY coin HAVING count(*) >= 200),
pt AS (SELECT coin, signal, fwd FROM pp WHERE rate = 'inf_rate' AND horizon = 'h30'), cu AS (SELECT coin, quantile_cont(signal, 0.9) AS cut FROM pt GROUP BY coin),
mv AS (SELECT coin, avg(fwd) AS move FROM pt JOIN cu USING (coin) WHERE signal >= cut GROUP BY coin)
SELECT coin, bars, round(move, 4) AS move_bps, round(spread, 4) AS spread_bps, round(spread + 9, 4) AS cost_bps, round(move - spread - 9, 4) AS edge_bps FROM nb JOIN mv USING (coin) JOIN sp USING (coin)""")
def informed_flow_edge(s, d):
    return rounded(flow.informed_edge(_rates(s, d), book.median_spread(quote_bars(s, d)), 30, 4.5), 4)


@query(LABEL_SQL + f""", al AS (SELECT coin, trade_ms, users_buyer AS w, notional AS sg, notional AS n FROM tr UNION ALL SELECT coin, trade_ms, users_seller, -notional, notional FROM tr),
x AS (SELECT coin, sum(CASE WHEN w IN (SELECT wallet FROM sm) THEN sg ELSE 0 END) AS net, sum(CASE WHEN w IN (SELECT wallet FROM sm) THEN n ELSE 0 END) AS co,
count(*) FILTER (WHERE w IN (SELECT wallet FROM sm)) AS n_legs, sum(n) AS tot, min(trade_ms) AS a, max(trade_ms) AS b FROM al WHERE trade_ms >= {MID_MS} AND trade_ms < {END_MS} GROUP BY coin)
SELECT coin, round(net, 4) AS net_notional, round(co, 4) AS cohort_notional, n_legs, round(tot, 4) AS total_notional, a AS window_start, b AS window_end, round(coalesce(co / nullif(tot, 0), 0), 4) AS cohort_share,
CASE WHEN net > 0 THEN 'net long' WHEN net < 0 THEN 'net short' ELSE 'flat' END AS lean, round(coalesce(net / nullif(co, 0), 0), 4) AS net_share FROM x""")
def cohort_snapshot(s, d):
    return rounded(flow.cohort_snapshot(a.trades(s, d), _smart(s, d), MID_MS, END_MS), 4)


@query(LABEL_SQL.replace("WITH ev", "WITH ev") + "," + ctes("qu", "cx")[5:].replace(a.CTES["ev"] + ",\n", "", 1) + """,
h1 AS (SELECT coin, bbo_ms // 3600000 * 3600000 AS hour, avg((bid_sz - ask_sz) / nullif(bid_sz + ask_sz, 0)) AS o, avg((ask_px - bid_px) / nullif((ask_px + bid_px) / 2, 0)) * 10000 AS sp FROM qu GROUP BY 1, 2),
h2 AS (SELECT coin, trade_ms // 3600000 * 3600000 AS hour, sum(CASE WHEN side = 'B' THEN notional ELSE -notional END) / nullif(sum(notional), 0) AS tk FROM tr GROUP BY 1, 2),
h3 AS (SELECT coin, captured_ms // 3600000 * 3600000 AS hour, avg(premium) AS pm, arg_max(premium, (captured_ms, seq)) AS pl, arg_max(funding, (captured_ms, seq)) AS fl FROM cx GROUP BY 1, 2),
al AS (SELECT coin, trade_ms, users_buyer AS w, notional AS sg, notional AS n FROM tr UNION ALL SELECT coin, trade_ms, users_seller, -notional, notional FROM tr),
h4 AS (SELECT coin, trade_ms // 3600000 * 3600000 AS hour, sum(CASE WHEN w IN (SELECT wallet FROM sm) THEN sg ELSE 0 END) / nullif(sum(n), 0) AS cs FROM al GROUP BY 1, 2)
SELECT coin, hour, round(o, 9) AS obi_mean, round(sp, 9) AS spread_bps_mean, round(tk, 9) AS taker_imbalance, round(pm, 9) AS premium_mean, round(pl, 9) AS premium_last, round(fl, 9) AS ctx_funding_last, round(cs, 9) AS cohort_net_share
FROM h1 FULL JOIN h2 USING (coin, hour) FULL JOIN h3 USING (coin, hour) FULL JOIN h4 USING (coin, hour)""")
def hourly_tape_features(s, d):
    return rounded(features.tape_features(a.quotes(s, d), a.trades(s, d), a.contexts(s, d), _smart(s, d)), 9)


HORIZONS = {"h1": 1, "h3": 3, "h6": 6}
QB = ctes("qu") + f""",
qb AS (SELECT coin, bbo_ms // {BAR} * {BAR} AS bar, round(avg((bid_sz - ask_sz) / nullif(bid_sz + ask_sz, 0)), 9) AS obi, round(arg_max((bid_px + ask_px) / 2, (bbo_ms, seq)), 9) AS mid,
round(avg((ask_px - bid_px) / nullif((ask_px + bid_px) / 2, 0)) * 10000, 6) AS spread_bps FROM qu GROUP BY 1, 2)"""
PAIRS = QB + """,
pr AS (""" + " UNION ALL ".join(f"SELECT coin, '{n}' AS horizon, obi AS signal, (lead(mid, {h}) OVER (PARTITION BY coin ORDER BY bar) / nullif(mid, 0) - 1) * 10000 AS fwd FROM qb" for n, h in HORIZONS.items()) + """),
pp AS (SELECT * FROM pr WHERE fwd IS NOT NULL AND signal IS NOT NULL)"""


def _pairs(s, d):
    return ic.with_horizons(quote_bars(s, d), "mid", HORIZONS, "obi")


@query(PAIRS + """, rk AS (SELECT coin, horizon, rank() OVER (PARTITION BY coin, horizon ORDER BY signal) + (count(*) OVER (PARTITION BY coin, horizon, signal) - 1) / 2.0 AS rs,
rank() OVER (PARTITION BY coin, horizon ORDER BY fwd) + (count(*) OVER (PARTITION BY coin, horizon, fwd) - 1) / 2.0 AS rf FROM pp)
SELECT coin, horizon, count(*) AS n, CASE WHEN count(*) >= 100 THEN round(corr(rs, rf), 6) END AS ic FROM rk GROUP BY 1, 2""")
def imbalance_ic(s, d):
    return rounded(ic.spearman(_pairs(s, d), ["coin", "horizon"], "signal", "fwd"))


@query(PAIRS + """, c AS (SELECT coin, horizon, quantile_cont(signal, 0.9) AS cut FROM pp GROUP BY 1, 2)
SELECT coin, horizon, round(cut, 6) AS cut, round(avg(fwd), 4) AS move FROM pp JOIN c USING (coin, horizon) WHERE signal >= cut GROUP BY 1, 2, 3""")
def top_decile_moves(s, d):
    x = ic.top_decile(_pairs(s, d), ["coin", "horizon"], "signal", "fwd")
    return x.select("coin", "horizon", F.round("cut", 6).alias("cut"), F.round("move", 4).alias("move"))


@query(QB + " SELECT coin, round(median(spread_bps), 6) AS median_spread_bps FROM qb GROUP BY coin")
def median_spreads(s, d):
    return rounded(book.median_spread(quote_bars(s, d)))


@query(QB + """, x AS (SELECT coin, bar, pow(ln(mid) - ln(lag(mid) OVER (PARTITION BY coin ORDER BY bar)), 2) AS sq FROM qb),
y AS (SELECT coin, bar, sq, lag(sq) OVER (PARTITION BY coin ORDER BY bar) AS sl FROM x WHERE sq IS NOT NULL),
z AS (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY bar) <= floor(count(*) OVER (PARTITION BY coin) * 0.6) AS early FROM y WHERE sl IS NOT NULL),
r AS (SELECT coin, count(*) AS n, corr(sq, sl) FILTER (WHERE early) AS ci, corr(sq, sl) FILTER (WHERE NOT early) AS co FROM z GROUP BY coin)
SELECT coin, n, round(ci, 6) AS corr_in, round(co, 6) AS corr_out, n >= 100 AND ci > 0 AND co > 0 AS survives FROM r""")
def volatility_clustering(s, d):
    return rounded(ic.sign_survival(quote_bars(s, d)))


EVENT_SQL = QB + """,
x AS (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY bar) - 1 AS i, count(*) OVER (PARTITION BY coin) AS n FROM qb),
y AS (SELECT *, floor(n * 0.3) AS split FROM x WHERE n >= 100),
c AS (SELECT coin, quantile_cont(obi, 0.9) AS hi, quantile_cont(obi, 0.1) AS lo FROM y WHERE i < split GROUP BY coin),
g AS (SELECT y.*, hi, lo FROM y JOIN c USING (coin) WHERE i >= split AND i < n - 12 AND (obi >= hi OR obi <= lo)),
t AS (WITH RECURSIVE w(coin, i) AS (SELECT coin, min(i) FROM g GROUP BY coin UNION ALL SELECT w.coin, (SELECT min(g.i) FROM g WHERE g.coin = w.coin AND g.i >= w.i + 12) FROM w WHERE w.i IS NOT NULL)
      SELECT coin, i FROM w WHERE i IS NOT NULL),
le AS (SELECT g.coin, g.bar AS entry, e.bar AS exit, CASE WHEN g.obi >= g.hi THEN 1 ELSE -1 END AS sd, g.mid AS em, e.mid AS xm, g.spread_bps AS s0, e.spread_bps AS s1
       FROM t JOIN g ON g.coin = t.coin AND g.i = t.i JOIN y e ON e.coin = t.coin AND e.i = t.i + 12),
lg AS (SELECT coin, entry, exit, CASE WHEN sd > 0 THEN 'long' ELSE 'short' END AS side, em AS entry_mid, xm AS exit_mid, sd * (xm / nullif(em, 0) - 1) * 10000 AS gross_bps, (s0 + s1) / 2 + 2 * 4.5 AS cost_bps FROM le)"""


def _events(s, d):
    return ledger.event_ledger(quote_bars(s, d), 4.5, min_bars=100)


@query(EVENT_SQL + " SELECT coin, entry, exit, side, round(entry_mid, 9) AS entry_mid, round(exit_mid, 9) AS exit_mid, round(gross_bps, 7) AS gross_bps, round(cost_bps, 7) AS cost_bps, round(gross_bps - cost_bps, 7) AS net_bps FROM lg")
def imbalance_ledger(s, d):
    x = _events(s, d)
    mids, bps = ("entry_mid", "exit_mid"), ("gross_bps", "cost_bps", "net_bps")
    return x.withColumns({c: F.round(c, 9) for c in mids} | {c: F.round(c, 7) for c in bps})


@query(EVENT_SQL + """ SELECT coin, count(*) AS trades, round(avg(CASE WHEN gross_bps > 0 THEN 1 ELSE 0 END) * 100, 4) AS gross_win_pct, round(avg(CASE WHEN gross_bps - cost_bps > 0 THEN 1 ELSE 0 END) * 100, 4) AS net_win_pct,
round(avg(gross_bps), 4) AS avg_gross, round(avg(gross_bps - cost_bps), 4) AS avg_net, round(sum(gross_bps - cost_bps), 3) AS total_net, round(median(exit - entry), 4) AS median_hold_ms FROM lg GROUP BY coin""")
def ledger_summary(s, d):
    return rounded(ledger.summary(_events(s, d), ["coin"]), 4).withColumn("total_net", F.round("total_net", 3))


@query(EVENT_SQL + " SELECT coin, entry, exit, round(sum(gross_bps - cost_bps) OVER (ORDER BY exit, coin, entry) / 5, 3) AS pooled_net FROM lg")
def pooled_ledger_path(s, d):
    return rounded(ledger.pooled_path(_events(s, d), 5), 3)


# ---- books, features, panel ----

BOOK_SQL = """WITH l AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 9) AS px, l_quantity AS sz FROM lineitem WHERE l_quantity > 0),
c AS (SELECT l_orderkey, px, sz, sum(px * sz) OVER w - px * sz AS before, px * sz AS usd, min(px) OVER (PARTITION BY l_orderkey) AS best FROM l WINDOW w AS (PARTITION BY l_orderkey ORDER BY px, sz, l_linenumber)),
n AS (SELECT CAST(unnest([10000.0, 100000.0]) AS DOUBLE) AS notional),
k AS (SELECT l_orderkey, notional, any_value(best) AS best, sum(usd) AS tot, sum(least(usd, greatest(notional - before, 0)) / px) AS units FROM c, n GROUP BY 1, 2),
s AS (SELECT CAST(l_orderkey % 7 AS VARCHAR) AS coin, l_orderkey AS captured_ms, notional, (best * 0.999 + best) / 2 AS mid, CASE WHEN tot >= notional - 1e-6 THEN (notional / units - (best * 0.999 + best) / 2) / ((best * 0.999 + best) / 2) END AS slip FROM k)"""


@query(BOOK_SQL + " SELECT coin, notional, count(*) AS n, count(slip) AS n_filled, round(quantile_cont(slip * 10000, 0.5), 4) AS median_bps, round(quantile_cont(slip * 10000, 0.95), 4) AS p95_bps FROM s GROUP BY 1, 2")
def book_slippage(s, d):
    return rounded(book.slippage_summary(a.books(s, d), [10_000, 100_000]), 4)


@query(BOOK_SQL + """ SELECT coin, captured_ms, round(mid, 8) AS mid, notional, round(slip, 6) AS slip FROM (SELECT *, row_number() OVER (PARTITION BY coin, captured_ms // 3600000, notional ORDER BY captured_ms) AS r FROM s) WHERE (r - 1) % 60 = 0""")
def sampled_slippage(s, d):
    by_hour = a.books(s, d).withColumn("hour", F.floor(F.col("captured_ms") / 3_600_000))
    held = book.every_nth(by_hour, ["coin", "hour"], ["captured_ms"])
    x = book.slippage(held, [10_000, 100_000])
    return x.select("coin", "captured_ms", F.round("mid", 8).alias("mid"), "notional", F.round("slip", 6).alias("slip"))


BOOKED_SQL = DRIFT + ", " + BOOK_SQL[5:] + """,
e AS (SELECT coin, slip, captured_ms, captured_ms // 1440 AS dt, captured_ms // 60 AS hr FROM s WHERE notional = 10000), b AS (SELECT coin, min(dt) AS lo, max(dt) AS hi FROM e GROUP BY coin),
f AS (SELECT e.coin, slip, dt = lo AND hr = min(hr) OVER y AS at_in, dt = hi AND hr = max(hr) OVER y AS at_out, (row_number() OVER (PARTITION BY e.coin, hr ORDER BY captured_ms) - 1) % 60 = 0 AS held
  FROM e JOIN b ON b.coin = e.coin WINDOW y AS (PARTITION BY e.coin, dt)),
rt AS (SELECT coin AS series, median(slip) FILTER (WHERE at_in AND held) AS slip_in, median(slip) FILTER (WHERE at_out AND held) AS slip_out FROM f GROUP BY coin)"""


def _round_trips(s, d):
    """The number of a book is taken as its minute."""
    held = a.books(s, d).withColumns({"dt": F.floor(F.col("captured_ms") / 1440), "hr": F.floor(F.col("captured_ms") / 60)})
    return book.round_trip_slippage(held, 10_000).withColumnRenamed("coin", "series")


@query(BOOKED_SQL + " SELECT series, round(slip_in, 9) AS slip_in, round(slip_out, 9) AS slip_out FROM rt WHERE slip_in IS NOT NULL AND slip_out IS NOT NULL")
def round_trip_slippage(s, d):
    return rounded(_round_trips(s, d), 9)


@query(BOOKED_SQL + f""", x AS (SELECT da.*, slip_in, slip_out, row_number() OVER (PARTITION BY series ORDER BY day) AS up, row_number() OVER (PARTITION BY series ORDER BY day DESC) AS down
  FROM da JOIN rt USING (series) WHERE slip_in IS NOT NULL AND slip_out IS NOT NULL),
ne AS (SELECT series, day, ret, ret - 1.0 / 10000 - CASE WHEN up = 1 THEN {4 * COSTS.taker_fee!r} / 2 + 2 * slip_in ELSE 0 END - CASE WHEN down = 1 THEN {4 * COSTS.taker_fee!r} / 2 + 2 * slip_out ELSE 0 END AS net FROM x)
SELECT series, day, round(ret, 6) AS ret, round(net, 6) AS net, round(sum(net) OVER (PARTITION BY series ORDER BY day), 6) AS cum_net FROM ne""")
def booked_carry_ledger(s, d):
    """The carry ledger with the slippage of each coin's own books at entry and exit."""
    daily = daily_drift(s, d).join(F.broadcast(_round_trips(s, d)), "series")  # a row a coin
    out = pnl.carry_ledger(daily, 4 * COSTS.taker_fee, F.col("slip_in"), F.col("slip_out"), 1.0)
    return rounded(out.drop("slip_in", "slip_out"))


FEATURE_SQL = ctes("mk", "sp", "fu") + """,
pl AS (SELECT mk.coin, mk.hour, spot, perp, coalesce(funding_rate, 0) AS f, (perp - spot) / nullif(spot, 0) AS b FROM mk JOIN sp USING (coin, hour) LEFT JOIN fu USING (coin, hour)),
x AS (SELECT coin, hour, b AS basis, f AS funding_rate,
 spot / nullif(lag(spot) OVER w, 0) - 1 AS spot_ret_1, spot / nullif(lag(spot, 24) OVER w, 0) - 1 AS spot_ret_24, perp / nullif(lag(perp) OVER w, 0) - 1 AS perp_ret_1, perp / nullif(lag(perp, 24) OVER w, 0) - 1 AS perp_ret_24,
 lag(b) OVER w AS basis_lag_1, lag(b, 4) OVER w AS basis_lag_4, lag(b, 24) OVER w AS basis_lag_24, lag(f) OVER w AS funding_lag_1, lag(f, 4) OVER w AS funding_lag_4, lag(f, 24) OVER w AS funding_lag_24,
 CASE WHEN count(b) OVER r = 24 THEN stddev_samp(b) OVER r END AS basis_std_24, CASE WHEN count(f) OVER r = 24 THEN avg(f) OVER r END AS funding_mean_24, CASE WHEN count(f) OVER r = 24 THEN stddev_samp(f) OVER r END AS funding_std_24,
 sin(2 * pi() * (hour // 3600000 % 24) / 24) AS hour_sin, cos(2 * pi() * (hour // 3600000 % 24) / 24) AS hour_cos,
 sin(2 * pi() * ((hour // 86400000 + 3) % 7) / 7) AS dow_sin, cos(2 * pi() * ((hour // 86400000 + 3) % 7) / 7) AS dow_cos, lead(f) OVER w AS target_fund
 FROM pl WINDOW w AS (PARTITION BY coin ORDER BY hour), r AS (PARTITION BY coin ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))"""
_ROUND_ALL = ", ".join(f"round({c}, 9) AS {c}" for c in [*features.FEATURES, "funding_rate", "target_fund"])
_NOT_NULL = " AND ".join(f"{c} IS NOT NULL" for c in [*features.FEATURES, "target_fund"])


@query(FEATURE_SQL + f" SELECT coin, hour, {_ROUND_ALL}, CAST(target_fund > 0 AS INT) AS label FROM x WHERE {_NOT_NULL}")
def feature_matrix(s, d):
    return rounded(features.feature_matrix(*legs_of(s, d)), 9)


GATED = FEATURE_SQL + f""", c AS (SELECT coin, hour, funding_mean_24 > 0 AS p, target_fund FROM x WHERE {_NOT_NULL}),
k AS (SELECT *, row_number() OVER (PARTITION BY coin ORDER BY hour) AS k FROM c), r AS (SELECT *, k - row_number() OVER (PARTITION BY coin ORDER BY hour) AS run FROM k WHERE p)"""


@query(GATED + " SELECT coin, min(hour) AS entry, max(hour) AS exit, count(*) AS hold_h, round(sum(target_fund) * 10000, 6) AS funding_bps, 18.0::DOUBLE AS cost_bps, round(sum(target_fund) * 10000 - 18, 6) AS net_bps FROM r GROUP BY coin, run")
def gated_ledger(s, d):
    rows = features.feature_matrix(*legs_of(s, d)).withColumn("prediction", (F.col("funding_mean_24") > 0).cast("int"))
    return rounded(ledger.gated_ledger(rows, 18.0))


@query(GATED + " SELECT coin, count(*) AS hours, round(sum(target_fund) * 10000 - 18, 6) AS always_on_bps FROM c GROUP BY coin")
def always_on(s, d):
    return rounded(ledger.always_on(features.feature_matrix(*legs_of(s, d)), 18.0))


DISPERSION_SQL = ctes("pn") + """, ax AS (SELECT hour, row_number() OVER (ORDER BY hour) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT hour FROM pn)),
p AS (SELECT pn.*, i, n FROM pn JOIN ax USING (hour)), q AS (SELECT p.coin, p.hour, p.i, p.n, p.funding_rate, p.mark / nullif(b.mark, 0) - 1 - p.funding_rate AS pnl FROM p LEFT JOIN p b ON b.coin = p.coin AND b.i = p.i - 1),
bl AS (SELECT CAST(b AS INT) AS block, 6 + b * 6 AS at0 FROM range(100) t(b) WHERE 6 + b * 6 < (SELECT max(n) FROM ax) - 1),
m AS (SELECT block, coin, avg(funding_rate) AS f, count(*) AS h FROM bl JOIN q ON i < at0 AND i >= at0 - 6 GROUP BY 1, 2 HAVING count(*) / 6.0 > 0.9),
k AS (SELECT block, coin, row_number() OVER (PARTITION BY block ORDER BY f, coin) AS r, count(*) OVER (PARTITION BY block) AS al FROM m),
s AS (SELECT block, coin, CASE WHEN r <= greatest(2, al // 5) THEN 1 WHEN r > al - greatest(2, al // 5) THEN -1 END AS side FROM k WHERE al >= 10),
g AS (SELECT block, q.hour, avg(pnl) FILTER (WHERE side = -1) AS hi, avg(pnl) FILTER (WHERE side = 1) AS lo FROM bl JOIN s USING (block) JOIN q USING (coin) WHERE side IS NOT NULL AND i >= at0 AND i < at0 + 6 GROUP BY 1, 2)"""


@query(DISPERSION_SQL + " SELECT block, hour, round((lo - hi) / 2, 6) AS ret FROM g WHERE lo IS NOT NULL AND hi IS NOT NULL")
def funding_dispersion(s, d):
    return rounded(dispersion.dispersion(a.panel(s, d), look=6, hold=6))


@query(DISPERSION_SQL + f""", dd AS (SELECT block, hour * 8 // 24 AS day, sum((lo - hi) / 2) AS ret, sum((lo - hi) / 2) - 2 * {RT!r} / 2 AS net FROM g WHERE lo IS NOT NULL AND hi IS NOT NULL GROUP BY 1, 2)
SELECT 'dispersion' AS series, count(*) AS n, round({SHARPE.format('ret')}, 6) AS gross_sharpe, round(avg(ret) * 365, 6) AS gross_apr, round({SHARPE.format('net')}, 6) AS net_sharpe, round(avg(net) * 365, 6) AS net_apr FROM dd HAVING count(*) > 0""")
def dispersion_risk(s, d):
    """A row of the panel's axis stands for eight hours, so a block of six is held for two days."""
    hourly = dispersion.dispersion(a.panel(s, d), look=6, hold=6)
    return rounded(dispersion.dispersion_risk(hourly.withColumn("hour", F.col("hour") * 8 * 3_600_000), 2, RT))


# ---- tape quality ----

def _channels(s, d):
    return {"trades": a.trades(s, d), "bbo": a.quotes(s, d), "ctx": a.contexts(s, d)}


COVER = ctes("tr", "qu", "cx")


@query(COVER + """ SELECT 'trades' AS channel, coin, count(*) AS n_rows, min(trade_ms) AS first_ms, max(trade_ms) AS last_ms, count(DISTINCT tid) AS distinct_ids FROM tr GROUP BY coin
UNION ALL SELECT 'bbo', coin, count(*), min(bbo_ms), max(bbo_ms), NULL FROM qu GROUP BY coin UNION ALL SELECT 'ctx', coin, count(*), min(captured_ms), max(captured_ms), NULL FROM cx GROUP BY coin""")
def tape_coverage(s, d):
    return quality.coverage(_channels(s, d))


SELECTED = ["0", "1", "2", "view", "click"]
_OF = "FROM {} WHERE coin IN ('0', '1', '2', 'view', 'click')"
_SINCE = " AND hour > (SELECT max(hour) - 7776000000 FROM {} WHERE coin = '0')"


@query(ctes("mk", "fu", "tr", "qu", "cx") + ", bk AS (SELECT DISTINCT CAST(l_orderkey % 7 AS VARCHAR) AS coin, l_orderkey AS ms FROM lineitem WHERE l_quantity > 0)"
       + " SELECT 'funding' AS channel, coin, count(*) AS n_rows, min(hour) AS first_ms, max(hour) AS last_ms " + _OF.format("fu") + _SINCE.format("fu") + " GROUP BY coin"
       + " UNION ALL SELECT 'marks', coin, count(*), min(hour), max(hour) " + _OF.format("mk") + _SINCE.format("mk") + " GROUP BY coin"
       + " UNION ALL SELECT 'trades', coin, count(DISTINCT tid), min(captured_ms), max(captured_ms) " + _OF.format("tr") + " GROUP BY coin"
       + " UNION ALL SELECT 'l2book', coin, count(*), min(ms), max(ms) " + _OF.format("bk") + " GROUP BY coin"
       + " UNION ALL SELECT 'bbo', coin, count(*), min(bbo_ms), max(bbo_ms) " + _OF.format("qu") + " GROUP BY coin"
       + " UNION ALL SELECT 'ctx', coin, count(*), min(captured_ms), max(captured_ms) " + _OF.format("cx") + " GROUP BY coin")
def selected_coverage(s, d):
    tapes = {"funding": (a.funding(s, d), "hour"), "marks": (a.marks(s, d), "hour"), "trades": (a.trades(s, d), "captured_ms"),
             "l2book": (a.books(s, d), "captured_ms"), "bbo": (a.quotes(s, d), "bbo_ms"), "ctx": (a.contexts(s, d), "captured_ms")}
    return quality.selected_coverage(tapes, SELECTED, {"funding": "0", "marks": "0"})


@query(ctes("tr") + """, w AS (SELECT * FROM tr WHERE trade_ms > (SELECT max(trade_ms) - 7 * 86400000 FROM tr WHERE coin = 'view'))
SELECT 'trades' AS channel, coin, count(*) AS n_rows, min(trade_ms) AS first_ms, max(trade_ms) AS last_ms, count(DISTINCT tid) AS distinct_ids FROM w GROUP BY coin""")
def anchored_coverage(s, d):
    return quality.coverage({"trades": quality.anchored_window(a.trades(s, d), "trade_ms", "view", 7)})


@query(COVER + """, x AS (SELECT 'trades' AS channel, count(*) AS n_rows FROM tr UNION ALL SELECT 'bbo', count(*) FROM qu UNION ALL SELECT 'ctx', count(*) FROM cx)
SELECT * FROM x UNION ALL SELECT 'total', CAST(sum(n_rows) AS BIGINT) FROM x""")
def channel_counts(s, d):
    return quality.channel_counts(_channels(s, d))


@query(ctes("tr") + " SELECT min(trade_ms) AS first_ms, max(trade_ms) AS last_ms, round((max(trade_ms) - min(trade_ms)) / 86400000.0, 6) AS days FROM tr")
def tape_window(s, d):
    return rounded(quality.tape_window(a.trades(s, d), "trade_ms"))


@query(ctes("tr") + " SELECT quantile_cont(captured_ms - trade_ms, 0.5) AS p50_ms, quantile_cont(captured_ms - trade_ms, 0.95) AS p95_ms FROM tr WHERE captured_ms >= trade_ms")
def capture_latency(s, d):
    return quality.latency(a.trades(s, d), exact=True)


@query(ctes("qu") + """ SELECT coin, count(DISTINCT bbo_ms // 3600000) AS present, max(bbo_ms // 3600000) - min(bbo_ms // 3600000) + 1 AS expected,
round((1 - count(DISTINCT bbo_ms // 3600000) / (max(bbo_ms // 3600000) - min(bbo_ms // 3600000) + 1)) * 100, 6) AS missing_pct FROM qu GROUP BY coin""")
def hour_gaps(s, d):
    return rounded(quality.hourly_coverage(a.quotes(s, d), "bbo_ms"))


@query(ctes("tr") + " SELECT round(count(DISTINCT trade_ms // 3600000) / (max(trade_ms // 3600000) - min(trade_ms // 3600000) + 1), 6) AS uptime FROM tr")
def tape_uptime(s, d):
    return rounded(quality.uptime(a.trades(s, d), "trade_ms"))


@query(ctes("tr", "qu") + f""" SELECT channel, coin, m AS last_ms, {END_MS} - m AS age_ms, {END_MS} - m >= 240000 AS stalled FROM
(SELECT 'trades' AS channel, coin, max(captured_ms) AS m FROM tr GROUP BY coin UNION ALL SELECT 'bbo', coin, max(bbo_ms) FROM qu GROUP BY coin)""")
def feed_freshness(s, d):
    return quality.freshness({"trades": a.trades(s, d), "bbo": a.quotes(s, d)}, END_MS)


# ---- messages, pages, runs ----

@query(ctes("tr") + """ SELECT trade_ms, coin, side, round(px, 6) AS px, sz, round(notional, 4) AS notional, tid, hex(tid) AS hash, users_buyer, users_seller FROM tr WHERE coin IN ('view', 'click')""")
def parsed_trades(s, d):
    x = messages.trades(raw.trades(s, d), ["view", "click"]).drop("captured_ms")
    return x.withColumns({"px": F.round("px", 6), "notional": F.round("notional", 4)})


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, round(l_extendedprice / l_quantity, 9) AS px, l_quantity AS sz, row_number() OVER (PARTITION BY l_orderkey ORDER BY round(l_extendedprice / l_quantity, 9), l_quantity, l_linenumber) AS k FROM lineitem WHERE l_quantity > 0)
SELECT CAST(l_orderkey % 7 AS VARCHAR) AS coin, l_orderkey AS book_ms, round(min(px) * 0.999, 7) AS best_bid_px, 1.0::DOUBLE AS best_bid_sz, min(px) AS best_ask_px,
round(min(px) - min(px) * 0.999, 7) AS spread, round(min(px) * 0.999, 7) AS bid_depth_10, round(sum(px * sz) FILTER (WHERE k <= 10), 2) AS ask_depth_10, 1 AS n_bid_lvls, CAST(count(*) AS INT) AS n_ask_lvls FROM l GROUP BY l_orderkey""")
def parsed_books(s, d):
    return shown_books(messages.l2book(raw.books(s, d)))


def shown_books(x: DataFrame) -> DataFrame:
    x = x.drop("captured_ms", "levels_json", "best_ask_sz")
    return x.withColumns({"best_bid_px": F.round("best_bid_px", 7), "spread": F.round("spread", 7), "bid_depth_10": F.round("bid_depth_10", 7), "ask_depth_10": F.round("ask_depth_10", 2)})


QUOTES_SQL = ctes("qu") + """ SELECT bbo_ms, coin, round(bid_px, 6) AS bid_px, CASE WHEN bid_sz > 5 THEN bid_sz END AS bid_sz, CASE WHEN seq % 4 <> 0 THEN round(ask_px, 6) END AS ask_px,
CASE WHEN seq % 4 <> 0 THEN ask_sz END AS ask_sz FROM qu"""
CONTEXTS_SQL = ctes("cx") + """ SELECT captured_ms, coin, round(funding, 9) AS funding, CASE WHEN seq % 3 > 0 THEN round(premium, 9) END AS premium, CAST(seq * 2 AS DOUBLE) AS open_interest, seq + 0.5::DOUBLE AS prev_day_px,
CAST(seq * 10 AS DOUBLE) AS day_ntl_vlm, seq + 0.25::DOUBLE AS oracle_px, seq + 0.125::DOUBLE AS mark_px, seq + 0.75::DOUBLE AS mid_px, CAST(seq % 97 AS DOUBLE) AS day_base_vlm FROM cx"""


@query(QUOTES_SQL)
def parsed_quotes(s, d):
    return rounded(messages.bbo(raw.quotes(s, d)).drop("captured_ms"))


@query(CONTEXTS_SQL)
def parsed_contexts(s, d):
    return rounded(messages.ctx(raw.contexts(s, d)), 9)


@query(ctes("ev") + """ SELECT event_type AS coin, ms // 3600000 * 3600000 AS ms, round(arg_min(value, event_id) / 1e6, 9) AS funding_rate FROM ev GROUP BY 1, 2""")
def funding_pages(s, d):
    e = a.events(s, d)
    hour = align.bucket("ms", 3_600_000)
    row = F.struct(hour.alias("time"), (F.col("value") / 1e6).cast("string").alias("fundingRate"), F.lit("0").alias("premium"))
    pages = e.groupBy(F.col("event_type").alias("coin"), F.floor(F.col("event_id") / 100).alias("page")).agg(F.array_sort(F.collect_list(F.struct("event_id", row.alias("r")))).alias("x"))
    pages = pages.select("coin", "page", F.to_json(F.transform("x", lambda x: x["r"])).alias("value"))
    x = messages.funding_pages(pages)
    return x.select("coin", F.unix_millis("ts").alias("ms"), F.round("funding_rate", 9).alias("funding_rate"))


@query(ctes("ev") + """, g AS (SELECT event_type AS coin, ms // 3600000 * 3600000 AS ms, event_id, value FROM ev)
SELECT p.pair, g.ms, round(arg_min(value, event_id), 6) AS close FROM g JOIN (VALUES ('view', '@107'), ('click', '@142')) AS p(coin, pair) USING (coin) GROUP BY 1, 2""")
def candle_pages(s, d):
    e = a.events(s, d)
    v = F.col("value").cast("string")
    row = F.struct(align.bucket("ms", 3_600_000).alias("T"), v.alias("o"), v.alias("c"), v.alias("h"), v.alias("l"), v.alias("v"))
    pages = e.groupBy(F.col("event_type").alias("coin"), F.floor(F.col("event_id") / 100).alias("page")).agg(F.array_sort(F.collect_list(F.struct("event_id", row.alias("r")))).alias("x"))
    pages = pages.select("coin", "page", F.to_json(F.transform("x", lambda x: x["r"])).alias("value"))
    pairs = F.broadcast(s.createDataFrame([("view", "@107"), ("click", "@142")], "coin string, pair string"))
    return messages.map_symbols(messages.candle_pages(pages), pairs).select("pair", F.unix_millis("ts").alias("ms"), F.round("close", 6).alias("close"))


@query("""WITH c AS (SELECT DISTINCT '{"coin":"' || l_orderkey % 7 || '","strategy":"obi"}' AS config FROM lineitem), d AS (SELECT DISTINCT '{"coin":"' || user_id % 2 || '","strategy":"obi"}' AS config FROM events)
SELECT substr(sha256(config), 1, 16) AS config_hash, config FROM c WHERE config NOT IN (SELECT config FROM d)""")
def unrecorded_runs(s, d):
    """Runs of the books' coins that the store, which holds those of the candle legs, has not recorded."""
    config = lambda coin: F.concat(F.lit('{"coin":"'), coin.cast("string"), F.lit('","strategy":"obi"}')).alias("config")
    of = lambda df: df.withColumns({"config_hash": runs.config_hash(F.col("config")), "saved_at": F.lit(0).cast("timestamp")}).select("config_hash", "config", "saved_at")
    new = of(a.read(s, d, "lineitem").select(config(F.col("l_orderkey") % 7)).distinct())
    return runs.unrecorded(new, layers.stored(of(a.read(s, d, "events").select(config(F.col("user_id") % 2)).distinct()), "runs")).select("config_hash", "config")


# ---- tapes, ledgers and label sets on disk ----

def quote_tape(s, d) -> str:
    """The quotes of the candle legs' coins as a tape by coin, day and hour."""
    root = layers.scratch(s, "quote-tape")
    layers.write_tape(a.quotes(s, d, by_leg=True).drop("seq"), root, "bbo")
    return root


LEG_QUOTES = ctes("ev") + """, q AS (SELECT CAST(user_id % 2 AS VARCHAR) AS coin, ms, value AS bid, value * (1 + (k + 1) / 10000.0::DOUBLE) AS ask FROM ev)"""


@query(LEG_QUOTES + """, h AS (SELECT coin, ms // 3600000 AS h, dense_rank() OVER (PARTITION BY coin ORDER BY ms // 3600000) AS r, (ask - bid) / nullif((ask + bid) / 2, 0) * 10000 AS sp FROM q),
m AS (SELECT coin, h, median(sp) AS m FROM h WHERE r <= 12 GROUP BY 1, 2) SELECT coin, round(median(m), 6) AS median_spread_bps FROM m GROUP BY coin""")
def first_hours_spread(s, d):
    """The median of the hours' median spreads, over the first 12 hours of each coin's tape."""
    root = quote_tape(s, d)
    held = layers.load_hours(s, root, "bbo", layers.first_hours(layers.tape_hours(s, root, "bbo"), 12))
    return rounded(book.median_spread(held.withColumn("spread_bps", bars.spread_bps()), per=["dt", "hr"]))


@query(LEG_QUOTES + """ SELECT coin, strftime(make_timestamp(ms * 1000), '%Y-%m-%d') AS dt, count(*) AS n, round(avg(bid), 6) AS bid FROM q
WHERE coin IN ('1') AND strftime(make_timestamp(ms * 1000), '%Y-%m-%d') BETWEEN '2024-01-10' AND '2024-01-19' GROUP BY 1, 2""")
def tape_days(s, d):
    """One coin and ten days of the tape, both ends included."""
    held = layers.load_tape(s, quote_tape(s, d), "bbo", ["1"], ("2024-01-10", "2024-01-19"))
    return rounded(held.groupBy("coin", "dt").agg(F.count("*").alias("n"), F.avg("bid_px").alias("bid")))


@query(ORACLE_SQL["carry_ledger"])
def ledger_file(s, d):
    """The carry ledger as compressed CSV files, read back."""
    path = layers.scratch(s, "ledger")
    rows = rounded(pnl.carry_ledger(daily_hold(s, d), 0.0018, 0.0003, 0.0004, 1.0))
    layers.write_ledger(rows, path)
    return s.read.schema(rows.schema).option("header", "true").csv(path)


@query(LABEL_SQL + """ SELECT count(*) AS n_rows, CAST(coalesce(sum(CAST('0x' || substr(md5(wallet), 1, 15) AS HUGEINT)), 0) AS VARCHAR) AS content_sum FROM lb WHERE is_smart""")
def cohort_fingerprint(s, d):
    """Size and content hash of the set of smart wallets."""
    return layers.fingerprint(layers.smart_wallets(_labels(s, d)))


@query(DRIFT + """ SELECT series, day, round(ret, 9) AS ret FROM ca SEMI JOIN da USING (series, day)""")
def carry_on_drift_days(s, d):
    """Carry on the days that the same coin's drift has."""
    return rounded(align.reindex_to(pnl.to_daily(pnl.funding_carry(a.funding(s, d))), daily_drift(s, d), ["series", "day"]), 9)


QUERIES |= model_plans.queries(legs_of, a)
ORACLE_SQL |= model_plans.oracle(FEATURE_SQL, _NOT_NULL)
def fan(channel: str, sql: str, shown):
    """A query of one channel of a stream into all of them."""
    name = f"fan_{channel}"
    QUERIES[name] = lambda s, d: shown(stream_plans.fanned(s, raw.everything(s, d), channel))
    ORACLE_SQL[name] = sql


fan("trades", ORACLE_SQL["parsed_trades"].replace(" WHERE coin IN ('view', 'click')", ""), lambda x: x.drop("captured_ms", "dt", "hr").withColumns({"px": F.round("px", 6), "notional": F.round("notional", 4)}))
fan("bbo", QUOTES_SQL, lambda x: rounded(x.drop("captured_ms", "dt", "hr")))
fan("ctx", CONTEXTS_SQL, lambda x: rounded(x.drop("dt", "hr"), 9))
fan("l2book", ORACLE_SQL["parsed_books"], lambda x: shown_books(x.drop("dt", "hr")))
QUERIES |= stream_plans.QUERIES
ORACLE_SQL |= stream_plans.ORACLE_SQL
