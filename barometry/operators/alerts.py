"""Regime transitions and alert rules; the same code serves batches and micro-batches."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barometry.constants import LOW_CONFIDENCE, VOL_SPIKE_LEVEL
from barometry.operators.ordered import IDX, INTRADAY, TICKER_TIME, Series, over_blocks, row_index


def regime_transitions(
    signals: DataFrame, last_known: DataFrame | None = None, series: Series = INTRADAY
) -> DataFrame:
    """Add ``prev_regime`` and ``changed``. The first signal of a ticker is no change.

    Signals of a ticker at one time are ordered by regime, then by their other columns as text, so a replay
    orders them alike. A signal without a ticker or time has no previous one.

    ``last_known`` (ticker, regime) holds the state from before these signals.
    """
    def step(d: DataFrame) -> DataFrame:
        return d.withColumn("prev_regime", F.lag("regime", 1).over(series.window()))

    numbered = row_index(signals, series, ties=("regime", F.to_json(F.struct(*signals.columns))))
    if last_known is None:
        out = over_blocks(numbered, step, 1, series).drop(IDX)
    else:
        before = last_known.select("ticker", F.col("regime").alias("_before"))
        out = over_blocks(numbered, step, 1, series).join(before, "ticker", "left")
        out = out.withColumn(
            "prev_regime", F.coalesce("prev_regime", F.when(F.col(IDX) == 0, F.col("_before"))))
        out = out.drop("_before", IDX)
    changed = F.coalesce(F.col("prev_regime") != F.col("regime"), F.lit(False))
    return out.withColumn("changed", changed)


def _alert(condition: Column, kind: str, severity: Column, payload: Column) -> Column:
    return F.when(condition, F.struct(
        F.lit(kind).alias("alert_type"), severity.cast("int").alias("severity"),
        F.to_json(payload).alias("payload")))


def _to_alerts(df: DataFrame, rules: list[Column]) -> DataFrame:
    raised = df.select("time", "ticker", F.explode(F.array_compact(F.array(*rules))).alias("a"))
    # A missing ticker or time has a mark of its own, so that its alerts do not take the ids of others.
    at = F.unix_micros(F.col("time").cast("timestamp")).cast("string")
    key = F.concat_ws("|", F.coalesce("ticker", F.lit("\u0000")), F.coalesce(at, F.lit("\u0000")), F.col("alert_type"))
    return raised.select("time", "ticker", "a.*").select(
        F.sha2(key, 256).alias("id"), "time", "ticker", "alert_type", "severity", "payload",
        F.lit(False).alias("read"))


def alert_rules(transitions: DataFrame) -> DataFrame:
    """Signals with ``prev_regime`` to zero to three alerts each. Ids are hashes: a replay repeats them."""
    c = F.col
    confidence = F.coalesce(c("confidence"), F.lit(1.0))
    known = c("prev_regime").isNotNull()
    severity = F.when(c("regime") == 3, 3).when(c("regime").isin(0, 1) & (c("prev_regime") == 2), 2).otherwise(1)
    shift = F.struct(
        c("prev_regime").alias("from_regime"), c("regime").alias("to_regime"),
        c("regime_name").alias("to_regime_name"), confidence.alias("confidence"))
    return _to_alerts(transitions, [
        _alert(known & (c("prev_regime") != c("regime")), "REGIME_SHIFT", severity, shift),
        _alert((c("regime") == 3) & (~known | (c("prev_regime") != 3)), "HIGH_VOL_ENTERED", F.lit(3),
               F.struct(confidence.alias("confidence"), c("ensemble_prob").alias("probs"))),
        _alert(confidence < LOW_CONFIDENCE, "CONFIDENCE_LOW", F.lit(1),
               F.struct(confidence.alias("confidence"), "regime")),
    ])


def feature_alerts(features: DataFrame, level: float = VOL_SPIKE_LEVEL, series: Series = TICKER_TIME) -> DataFrame:
    """Optional rules over the feature table: volatility spikes and, with options, gamma sign flips."""
    c = F.col
    rules = [_alert(c("rv_ratio") > level, "VOL_SPIKE", F.lit(2), F.struct("rv_ratio"))]
    if "gex_proxy" in features.columns:
        features = over_blocks(
            features, lambda d: d.withColumn("_gex", F.lag("gex_proxy", 1).over(series.window())), 1, series)
        rules.append(_alert(c("gex_proxy") * c("_gex") < 0, "GEX_FLIP", F.lit(2), F.struct("gex_proxy")))
    return _to_alerts(features, rules)
