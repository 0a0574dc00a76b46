"""Model queries and what of them SQL can say. Every coin of ``COIN_ROWS`` rows has a model of its own, all of them fitted in one pass."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.operators import features, ledger, models
from tapeloom.sources.layers import stored

#: Rows a coin needs for a model of its own, as in the study.
COIN_ROWS = 200
SEEDS = [0, 1, 2, 3, 4]
ROUND_TRIP_BPS = 18.0


def queries(legs_of, a) -> dict:
    def rows(s, d):
        return models.enough(stored(features.feature_matrix(*legs_of(s, d)), "features"), COIN_ROWS)

    def family_comparison(s, d):
        return models.compare(rows(s, d))

    def magnitude_forecast(s, d):
        return models.magnitude(rows(s, d))

    def tape_ablation(s, d):
        """The families on candle columns and with the tape of the leg's own coin, on the same rows."""
        tape = features.tape_features(*(f(s, d, by_leg=True) for f in (a.quotes, a.trades, a.contexts)))
        both = models.enough(stored(features.fused(features.feature_matrix(*legs_of(s, d)), tape, features.TAPE_FEATURES), "fused"), COIN_ROWS)
        sets = {"candle": features.FEATURES, "candle_tape": [*features.FEATURES, *features.TAPE_FEATURES]}
        return functools.reduce(DataFrame.unionByName, [models.compare(both, columns=c).withColumn("columns", F.lit(n)) for n, c in sets.items()])

    def sign_drivers(s, d):
        return models.sign_summary(rows(s, d), k=5)

    def row_drivers(s, d):
        train, test = models.split(rows(s, d))
        return models.top_drivers(models.logistic_attribution(models.logistic(train), test), 3)

    def driver_stability(s, d):
        return models.stability(rows(s, d), SEEDS)

    def model_gated_ledger(s, d):
        """Funding is collected while the sign model, which has seen earlier hours only, predicts a positive rate."""
        own = rows(s, d)
        scored = models.walk_forward(own).withColumn("prediction", (F.col("p") > 0.5).cast("int")).select("coin", "hour", "prediction")
        return ledger.gated_ledger(scored.join(own.select("coin", "hour", "target_fund"), ["coin", "hour"]), ROUND_TRIP_BPS)

    def majority_baseline(s, d):
        train, test = models.split(rows(s, d))
        return models.majority_accuracy(train, test).select("coin", "majority", F.round("accuracy", 9).alias("accuracy"))

    def persistence_baseline(s, d):
        return models.persistence_rmse(rows(s, d), "target_fund", "funding_rate").select("coin", F.round("rmse", 9).alias("rmse"))

    def fused_rows(s, d):
        """Candle and tape features of the same coin and hour."""
        tape = features.tape_features(*(f(s, d, by_leg=True) for f in (a.quotes, a.trades, a.contexts)))
        both = features.fused(features.feature_matrix(*legs_of(s, d)), tape, features.TAPE_FEATURES)
        return both.select("coin", "hour", F.round("basis", 9).alias("basis"), *[F.round(c, 9).alias(c) for c in features.TAPE_FEATURES], "label")

    found = (family_comparison, magnitude_forecast, tape_ablation, sign_drivers, row_drivers, driver_stability, model_gated_ledger, majority_baseline, persistence_baseline, fused_rows)
    return {f.__name__: f for f in found}


def oracle(feature_sql: str, not_null: str) -> dict[str, str]:
    full = f"{feature_sql}, c AS (SELECT *, CAST(target_fund > 0 AS INT) AS label FROM x WHERE {not_null}), k AS (SELECT coin FROM c GROUP BY coin HAVING count(*) >= {COIN_ROWS})"
    return {
        "majority_baseline": full + """, t AS (SELECT coin, label, row_number() OVER (PARTITION BY coin ORDER BY hour) <= floor(count(*) OVER (PARTITION BY coin) * 0.7) AS tr FROM c SEMI JOIN k USING (coin)),
m AS (SELECT coin, CAST(avg(label) > 0.5 AS INT) AS majority FROM t WHERE tr GROUP BY coin)
SELECT coin, majority, round(avg(CAST(label = majority AS INT)), 9) AS accuracy FROM t JOIN m USING (coin) WHERE NOT tr GROUP BY coin, majority""",
        "persistence_baseline": full + " SELECT coin, round(sqrt(avg(pow(target_fund - funding_rate, 2))), 9) AS rmse FROM c SEMI JOIN k USING (coin) GROUP BY coin",
        "fused_rows": full + """, e AS (SELECT CAST(user_id % 2 AS VARCHAR) AS coin, ms // 3600000 * 3600000 AS hour, ms, event_id, event_id % 2 = 0 AS buy, value, k + 1.0::DOUBLE AS bs, user_id + 1.0::DOUBLE AS az,
  value * (1 + (k + 1) / 10000.0::DOUBLE) AS ask, value * (k + 1.0::DOUBLE) AS notional, (k - 50) / 1e6 AS premium FROM ev),
g AS (SELECT coin, hour, avg((bs - az) / nullif(bs + az, 0)) AS obi_mean, avg((ask - value) / nullif((ask + value) / 2, 0) * 10000) AS spread_bps_mean,
  sum(CASE WHEN buy THEN notional ELSE -notional END) / nullif(sum(notional), 0) AS taker_imbalance, avg(premium) AS premium_mean, arg_max(premium, (ms, event_id)) AS premium_last FROM e GROUP BY 1, 2)
SELECT coin, hour, round(basis, 9) AS basis, round(obi_mean, 9) AS obi_mean, round(spread_bps_mean, 9) AS spread_bps_mean, round(taker_imbalance, 9) AS taker_imbalance,
round(premium_mean, 9) AS premium_mean, round(premium_last, 9) AS premium_last, label FROM c JOIN g USING (coin, hour)
WHERE obi_mean IS NOT NULL AND spread_bps_mean IS NOT NULL AND taker_imbalance IS NOT NULL AND premium_mean IS NOT NULL AND premium_last IS NOT NULL""",
    }
