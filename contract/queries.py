"""One registered query per operator. Every query reads the whole of its tables."""

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barometry import schemas
from barometry.constants import (
    HMM_FEATURES, MACRO_JOINED, RETENTION_YEARS,
)
from barometry.functions import probability as prob
from barometry.functions.scalar import (
    clip, count_present, normalise_ticker, percent, split_list, title_case,
)
from barometry.models import sequences as seqs
from barometry.models.classifier import classify
from barometry.models.ensemble import align_predictions, ensemble_predict
from barometry.models.hmm import HmmModel, hmm_decode, hmm_fit, label_states, state_means
from barometry.operators import aggregates, alerts, macro, momentum, normalise, options, ordered, ranges, reads, volatility
from barometry.plans import training, views
from barometry.plans.features import feature_pipeline, min_non_null_rows, sorted_by_ticker_time
from barometry.session import shared_folder, written
from barometry.sources import envelopes, landing, store
from barometry.streaming import event_time, jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

AS_OF = "1998-06-30"
SIGNALS_AS_OF = "2024-01-20 12:00:00"
TRAIN_FROM = "1990-01-01"  # the test bars end before the usual training start
SMALL_TRAINING = 5         # EM steps where a query only needs some fitted model

BUCKETS = 16               # of stored tables; choose some 200 MB a bucket


def query(fn: Query) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, folder)

    QUERIES[fn.__name__.rstrip("_")] = run
    return fn


# Values that both engines get by the same single operation on the same stored numbers.
EXACT = ["open", "high", "low", "close", "vwap", "top", "Open", "close_before", "move", "seen", "last_close",
         "max_high", "vix", "yield_curve_slope", "hy_spread", "rate_10y", "rate_2y", "vix_term_slope"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round sums and other inexact doubles for the comparison; adding 0 turns -0.0 into 0.0."""
    return df.select(*[
        (F.round(f.name, digits) + F.lit(0.0)).alias(f.name)
        if f.dataType.simpleString() == "double" and f.name not in EXACT
        else F.col(f.name) for f in df.schema.fields])


_kept: dict[tuple, object] = {}


def once(spark: SparkSession, folder: str, name: str, make: Callable[[], object]):
    """Tables and models that several queries share are made once per session and folder."""
    key = (spark.sparkContext.applicationId, folder, name)
    if key not in _kept:
        _kept[key] = make()
    return _kept[key]


def features(spark: SparkSession, folder: str) -> DataFrame:
    """The feature table with macro and options columns, written once."""
    return once(spark, folder, "features", lambda: written(feature_pipeline(
        views.bars(spark, folder), views.macro(spark, folder), macro_order="seq"), "features"))


def training_rows(spark: SparkSession, folder: str) -> DataFrame:
    return seqs.prepare_training(features(spark, folder), TRAIN_FROM)


def fitted_hmm(spark: SparkSession, folder: str) -> HmmModel:
    rows = training_rows(spark, folder)
    return once(spark, folder, "hmm", lambda: hmm_fit(
        rows, seqs.present(rows, HMM_FEATURES), max_iter=SMALL_TRAINING)[0])


def trained(spark: SparkSession, folder: str) -> tuple[training.Models, DataFrame]:
    log = shared_folder(spark, "runs")
    models, accuracy = once(spark, folder, "trained", lambda: training.train_job(
        features(spark, folder), TRAIN_FROM, log_path=log))
    _kept.setdefault((spark.sparkContext.applicationId, folder, "run_log"), log)
    return models, accuracy


def with_keys(df: DataFrame, *columns: str) -> DataFrame:
    return rounded(df.select("ticker", "time", *columns))


# -- A: sources --------------------------------------------------------------------------------------

@query
def scan_bars(spark, folder):
    return rounded(landing.scan_bars(views.raw_prices(spark, folder), views.CHAIN_TIES))


@query
def landed_files(spark, folder):
    """CSV and JSON lines as a download leaves them, some of them cut or garbled: rows by file kind, and the rest as text."""
    prices = views.raw_prices(spark, folder).selectExpr(
        "Datetime as Date", "concat(' ', lower(ticker)) as ticker", "Open", "High", "Low", "Close", "Volume",
        "l_orderkey * 10 + l_linenumber as n")
    columns = [c for c in prices.columns if c != "n"]
    stamp = prices.withColumn("Date", F.date_format("Date", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    text = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    csv = stamp.select(F.when(F.col("n") % 11 == 0, F.concat(F.lit("bad,"), F.col("n").cast("string"), F.lit(",1,x"))).when(
        F.col("n") % 13 == 0, ",".join(columns)).otherwise(text).alias("value"))
    # A cut line: its end is missing.
    whole = F.to_json(F.struct(*columns))
    json = stamp.select(F.when(F.col("n") % 11 == 0, F.concat(F.lit('{"n": '), F.col("n").cast("string"))).otherwise(whole).alias("value"))
    out = None
    for kind, lines in (("csv", csv), ("json", json)):
        path = shared_folder(spark, "landed")
        lines.write.text(path)
        rows = landing.read_landed(spark, path, kind, split=False)
        bad = F.col("_corrupt").isNotNull()
        sums = rows.groupBy(
            bad.alias("bad"), F.when(~bad, F.trim("ticker")).alias("ticker"),
            F.when(~bad, F.col("Date").cast("timestamp_ntz")).alias("time")).agg(
            F.count(F.lit(1)).alias("n_rows"), F.count(F.when(~bad, F.col("Close"))).alias("n_closed"),
            F.count("_corrupt").alias("n_bad"), F.sum("Volume").alias("volume"), F.sum(F.length("_corrupt")).alias("n_chars"))
        part = sums.select("ticker", "time", "n_rows", F.when(F.col("bad"), F.col("n_bad")).otherwise(F.col("n_closed")).alias("n_closed"),
                           F.when(F.col("bad"), F.col("n_chars").cast("double")).otherwise(F.col("volume")).alias("volume"),
                           F.lit(kind).alias("kind"))
        out = part if out is None else out.unionByName(part)
    return rounded(out)


@query
def scan_universe(spark, folder):
    return with_keys(landing.scan_universe(views.bars(spark, folder), ["A", "N", "R", "ZZZ"]).withColumn(
        "volume", F.col("volume").cast("double")), "close", "volume")


@query
def parse_macro_observations(spark, folder):
    return rounded(landing.parse_macro_observations(views.responses(spark, folder)))


@query
def scan_macro_series(spark, folder):
    return rounded(landing.scan_macro_series(
        views.macro(spark, folder), ["VIXCLS", "DGS10", "DFF"], "1996-01-01", "1998-12-31"))


@query
def nearest_expiry_chain(spark, folder):
    chain = options.nearest_expiry_chain(views.options_chain(spark, folder))
    return rounded(chain.select("ticker", "expiry", "option_type", "strike", "l_orderkey", "l_extendedprice"))


@query
def clean_options_chain(spark, folder):
    chain = options.clean_options_chain(views.options_chain(spark, folder))
    return rounded(chain.select(
        "ticker", "option_type", "strike", "implied_volatility", "open_interest", "volume", "l_orderkey"))


@query
def validate_records(spark, folder):
    raw = views.stored_bars(spark, folder).selectExpr(
        "time", "concat(' ', lower(ticker), ' ') as ticker", "open", "if(volume % 5 = 0, low / 2, high) as high",
        "low", "if(volume % 7 = 0, 0D, close) as close", "volume - 20 as volume", "source")
    clean, bad = landing.validate_records(raw, "bars")
    both = clean.withColumn("failed", F.array().cast("array<string>")).unionByName(bad)
    return both.select("time", "ticker", F.array_join("failed", ",").alias("failed"))


@query
def validation_figures(spark, folder):
    """What was counted while dirty bars were written, next to what the two written parts hold."""
    raw = views.stored_bars(spark, folder).selectExpr(
        "time", "ticker", "open", "if(volume % 5 = 0, low / 2, high) as high", "low",
        "if(volume % 7 = 0, 0D, close) as close", "volume - 20 as volume", "if(volume % 11 = 0, 'other', source) as source")
    clean, bad, figures = landing.write_validated(raw, "bars", shared_folder(spark, "validated"))
    counted = spark.createDataFrame([(k, int(v)) for k, v in figures.items()], "name string, n bigint")
    read = [part.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
            for name, part in (("read_clean", clean), ("read_quarantined", bad))]
    return counted.unionByName(read[0]).unionByName(read[1])


@query
def landing_quarantine(spark, folder):
    """Rows of all three kinds that break a rule, with the rules they break."""
    raw_bars = views.stored_bars(spark, folder).selectExpr(
        "time", "ticker", "if(volume % 3 = 0, -open, open) as open", "if(volume % 5 = 0, low / 2, high) as high", "low", "close",
        "volume - 20 as volume", "if(volume % 11 = 0, 'other', source) as source")
    raw_macro = views.macro_table(spark, folder).selectExpr(
        "time", "series_id as ticker", "if(value < 0, cast(null as double), value) as value",
        "if(value > 20, 'other', source) as source")
    raw_options = views.options_chain(spark, folder).selectExpr(
        "expiry as time", "ticker", "if(open_interest % 3 = 0, -strike, strike) as strike",
        "if(volume % 7 = 0, 'straddle', option_type) as option_type",
        "implied_volatility - 0.02 as implied_volatility", "open_interest", "volume")
    made = None
    for kind, rows in (("bars", raw_bars), ("macro", raw_macro), ("options", raw_options)):
        _, bad = landing.validate_records(rows, kind)
        part = bad.groupBy(F.lit(kind).alias("kind"), "ticker", F.array_join("failed", ",").alias("failed")).agg(
            F.count(F.lit(1)).alias("n"))
        made = part if made is None else made.unionByName(part)
    return made


@query
def envelope_dead_letters(spark, folder):
    """Every message is either exploded or a dead letter: unreadable ones, empty ones, unknown topics."""
    sent = views.messages(spark, folder).selectExpr(
        "topic", "value", "cast(get_json_object(value, '$.batch_id') as bigint) as n").selectExpr(
        "topic", "case n % 5 when 0 then left(value, length(value) - 9) when 1 then '{\"records\": []}' else value end as value")
    dead = envelopes.dead_letters(sent)
    return dead.groupBy("topic", "reason").agg(F.count(F.lit(1)).alias("n"))


@query
def explode_envelope(spark, folder):
    rows = envelopes.explode_envelope(views.messages(spark, folder), "ohlcv", schemas.BARS)
    return rounded(rows.select(F.col("time").cast("timestamp_ntz").alias("time"), "ticker", "open", "close", "volume"))


def _store(spark, folder) -> store.FeatureStore:
    def make():
        s = store.FeatureStore(spark, shared_folder(spark, "store"))
        s.write(views.bars(spark, folder))
        return s

    return once(spark, folder, "store", make)


@query
def feature_store_read(spark, folder):
    return with_keys(_store(spark, folder).read(["a", "R"], "1996-01-01", "1999-12-31"), "open", "close", "volume")


@query
def scan_one_partition(spark, folder):
    return with_keys(_store(spark, folder).one("N"), "close")


@query
def list_tickers(spark, folder):
    return _store(spark, folder).tickers()


@query
def ingest_window(spark, folder):
    bars = views.bars(spark, folder)
    kinds = [("eod", None), ("weekly", None), ("backfill", 2)]
    frames = [landing.ingest_window(bars, AS_OF, k, y).select(F.lit(k).alias("kind"), "ticker", "time") for k, y in kinds]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


@query
def table_reads(spark, folder):
    return rounded(spark.sql(
        "select ticker, time, close, volume from {bars} where ticker = :ticker and time >= :since order by time",
        args={"ticker": "A", "since": "1997-01-01"}, bars=views.bars(spark, folder)))


# -- K: sinks ------------------------------------------------------------------------------------------

@query
def upsert_bars(spark, folder):
    return rounded(store.upsert_bars(views.stored_bars(spark, folder), views.incoming_bars(spark, folder)))


@query
def upsert_macro(spark, folder):
    target = views.macro_table(spark, folder)
    new = target.selectExpr("time + interval 30 days as time", "series_id", "value + 1 as value", "'yfinance' as source")
    return rounded(store.upsert_macro(target, new))


@query
def append_signals(spark, folder):
    path = shared_folder(spark, "signals")
    latest = reads.latest_signals(views.signals(spark, folder))
    store.append_signals(latest, path)
    store.append_signals(latest, path)
    return spark.read.parquet(path).groupBy("ticker", "model_version").agg(F.count(F.lit(1)).alias("n"))


def _alerts(spark, folder):
    return alerts.alert_rules(alerts.regime_transitions(views.signals(spark, folder)))


def _parsed_alerts(a):
    """Alerts with the fields of their payload: the two engines write numbers in JSON differently."""
    field = lambda name: F.get_json_object("payload", f"$.{name}")
    return a.select("id", "time", "ticker", "alert_type", "severity", "read",
                    field("confidence").cast("double").alias("confidence"),
                    field("from_regime").cast("double").alias("from_regime"),
                    field("to_regime_name").alias("to_regime_name"))


@query
def append_alerts(spark, folder):
    path = shared_folder(spark, "alerts")
    store.append(_alerts(spark, folder), path)
    return _parsed_alerts(spark.read.parquet(path))


@query
def feature_store_write(spark, folder):
    s = store.FeatureStore(spark, shared_folder(spark, "store"))
    bars = views.bars(spark, folder)
    s.write(bars)
    s.write(bars.filter("ticker = 'A'").withColumn("close", F.lit(1.0)))
    s.write(bars.limit(0))
    return with_keys(s.scan(), "close", "volume")


@query
def publish_envelope(spark, folder):
    sent = envelopes.publish_envelope(views.bars(spark, folder), "ohlcv", max_records=500)
    body = F.from_json("value", schemas.envelope(schemas.BARS))
    got = sent.select("key", body.alias("m"))
    return rounded(got.select(
        F.col("key").alias("ticker"), F.col("m.record_count").alias("record_count"),
        F.size("m.records").alias("n_records"), F.col("m.data_type").alias("data_type"),
        F.aggregate("m.records.close", F.lit(0.0), lambda a, x: a + x).alias("sum_close"),
        F.element_at("m.records.time", 1).cast("timestamp_ntz").alias("first_time")), 3)


@query
def publish_latest_features(spark, folder):
    sent = envelopes.publish_latest_features(views.bars(spark, folder))
    m = F.from_json("value", schemas.envelope(schemas.BARS))
    return rounded(sent.select(F.col("key").alias("ticker"), F.explode(m["records"]).alias("r")).select(
        "ticker", F.col("r.time").cast("timestamp_ntz").alias("time"), "r.close", "r.volume"))


@query
def publish_signal(spark, folder):
    sent = envelopes.publish_signal(reads.latest_signals(views.signals(spark, folder)))
    return sent.select(
        F.col("key").alias("ticker"), F.get_json_object("value", "$.regime").cast("int").alias("regime"),
        F.get_json_object("value", "$.regime_name").alias("regime_name"),
        F.get_json_object("value", "$.confidence").cast("double").alias("confidence"))


@query
def latest_signal_cache(spark, folder):
    cache = reads.latest_signal_cache(views.signals(spark, folder), SIGNALS_AS_OF)
    return rounded(cache.select("ticker", "time", "regime", "confidence"))


@query
def apply_retention(spark, folder):
    return with_keys(store.apply_retention(views.bars(spark, folder), AS_OF, RETENTION_YEARS["bars"]), "close")


@query
def model_store(spark, folder):
    models, _ = trained(spark, folder)
    path = shared_folder(spark, "models")
    models.save(spark, path)
    again = training.Models.load(spark, path)
    return training.infer_all(features(spark, folder), again).select("ticker", "time", "regime", "confidence")


@query
def run_log(spark, folder):
    trained(spark, folder)
    return spark.read.parquet(_kept[(spark.sparkContext.applicationId, folder, "run_log")])


# -- B: projections and filters ------------------------------------------------------------------------

@query
def normalise_ticker_(spark, folder):
    c = views.table(spark, folder, "customer")
    return c.select("c_custkey", normalise_ticker(F.concat(F.lit("  "), F.lower("c_mktsegment"), F.lit(" "))).alias("ticker"))


@query
def filter_isin(spark, folder):
    return with_keys(views.bars(spark, folder).filter(F.col("ticker").isin("A", "R")), "close")


@query
def filter_time_range(spark, folder):
    return with_keys(views.bars(spark, folder).filter(landing.time_range("1996-02-01", "1997-03-04")), "close")


@query
def dropna_subset(spark, folder):
    return views.raw_prices(spark, folder).dropna(subset=["Open", "High", "Low", "Close"]).select(
        "ticker", F.col("Datetime").alias("time"), "l_orderkey", "l_linenumber")


@query
def min_non_null_rows_(spark, folder):
    df = momentum.momentum(volatility.realized_vol(views.bars(spark, folder)))
    names = ["rv_5d", "rv_21d", "rv_63d", "mom_5d", "mom_21d", "mom_63d"]
    return with_keys(min_non_null_rows(df, names), *names)


@query
def feature_columns(spark, folder):
    df = volatility.vol_ratio(views.bars(spark, folder))
    return with_keys(df, *normalise.feature_columns(df))


@query
def model_feature_columns(spark, folder):
    df = features(spark, folder)
    return with_keys(df, *normalise.model_feature_columns(df))


@query
def numeric_columns(spark, folder):
    df = volatility.vol_ratio(views.bars(spark, folder))
    return with_keys(df, *normalise.numeric_columns(df))


@query
def recode_series(spark, folder):
    return rounded(macro.recode_series(views.macro(spark, folder)).select("time", "seq", "name", "value"))


@query
def pad_missing_columns(spark, folder):
    two = views.macro(spark, folder).filter(F.col("series_id").isin("VIXCLS", "DGS2"))
    return rounded(macro.pivot_macro(two))


@query
def unread_alerts(spark, folder):
    seen = _alerts(spark, folder).withColumn("read", F.col("severity") == 1)
    return reads.unread_alerts(seen).select("id", "time", "ticker", "alert_type")


def _labels(spark, folder):
    return once(spark, folder, "labels", lambda: written(
        training.pseudo_labels(training_rows(spark, folder), fitted_hmm(spark, folder)), "labels"))


@query
def confidence_filter(spark, folder):
    return seqs.confidence_filter(_labels(spark, folder)).select("ticker", "time", "label", "confidence")


# -- C: joins ------------------------------------------------------------------------------------------

def _macro_features(spark, folder):
    return macro.macro_features(macro.pivot_macro(views.macro(spark, folder)))


@query
def join_macro_date_ffill(spark, folder):
    df = macro.join_macro_date_ffill(views.bars(spark, folder), _macro_features(spark, folder))
    return with_keys(df, *MACRO_JOINED)


@query
def join_macro_asof(spark, folder):
    df = macro.join_macro_asof(views.bars(spark, folder), _macro_features(spark, folder))
    return with_keys(df, *MACRO_JOINED)


@query
def join_macro_asof_time(spark, folder):
    wide = macro.macro_features(macro.pivot_macro(views.intraday_macro(spark, folder)))
    df = macro.join_macro_asof_time(views.bar_signals(spark, folder), wide)
    return with_keys(df, "seq", *MACRO_JOINED)


@query
def join_options_metrics(spark, folder):
    chain = views.options_chain(spark, folder, "l_returnflag")
    m = options.options_metrics(chain, views.CHAIN_TIES)
    return with_keys(options.join_options_metrics(views.bars(spark, folder), m),
                     "close", "iv_skew_proxy", "put_call_ratio", "gex_proxy")


def _live(spark, folder):
    return views.bars(spark, folder).filter(landing.time_range("2001-10-20")).selectExpr(
        "time", "ticker", "close * 3 as close", "'live' as origin")


def _past(spark, folder):
    return views.bars(spark, folder).selectExpr("time", "ticker", "close")


@query
def stitch_history(spark, folder):
    return with_keys(reads.stitch_history(_past(spark, folder), _live(spark, folder), 60), "close", "origin")


@query
def align_predictions_(spark, folder):
    models, _ = trained(spark, folder)
    rows = training_rows(spark, folder)
    scored = classify(models.classifier, seqs.sliding_sequences(rows, models.features).select("ticker", "time", "seq"))
    return align_predictions(hmm_decode(rows, models.hmm), scored.drop("seq"))


@query
def bars_with_regime(spark, folder):
    df = reads.bars_with_regime(views.bars(spark, folder), views.bar_signals(spark, folder))
    return with_keys(df.withColumn("regime", F.col("regime").cast("double")), "close", "regime")


@query
def bucketed_regimes(spark, folder):
    """The same join over stored tables that lie in buckets by ticker and day."""
    tables = []
    for name, rows in (("bars", views.bars(spark, folder)), ("signals", views.bar_signals(spark, folder))):
        path = shared_folder(spark, f"bucketed-{name}")
        tables.append(store.save_bucketed(
            rows.withColumn("day", F.to_date("time")), path.rsplit("/", 1)[1].replace("-", "_"), path, ["ticker", "day"], BUCKETS))
    df = reads.with_regime_of_day(*tables)
    return with_keys(df.withColumn("regime", F.col("regime").cast("double")), "close", "regime")


# -- D: aggregations -------------------------------------------------------------------------------------

@query
def pivot_macro(spark, folder):
    return rounded(macro.pivot_macro(views.macro(spark, folder)))


@query
def bars_daily(spark, folder):
    return rounded(aggregates.bars_daily(views.ticks(spark, folder)))


@query
def bars_daily_refresh(spark, folder):
    ticks = views.ticks(spark, folder)
    stale = aggregates.bars_daily(ticks).withColumn("volume", F.lit(-1).cast("long"))
    return rounded(aggregates.bars_daily_refresh(stale, ticks, SIGNALS_AS_OF))


@query
def put_call_ratio(spark, folder):
    return options.put_call_ratio(views.options_chain(spark, folder))


@query
def iv_skew_proxy(spark, folder):
    return rounded(options.iv_skew_proxy(views.options_chain(spark, folder), views.CHAIN_TIES))


@query
def gex_proxy(spark, folder):
    return options.gex_proxy(views.options_chain(spark, folder))


@query
def ticker_date_range(spark, folder):
    return store.date_range(views.bars(spark, folder))


@query
def regime_counts(spark, folder):
    return aggregates.regime_counts(reads.latest_signals(views.signals(spark, folder)))


@query
def period_stats(spark, folder):
    return rounded(aggregates.period_stats(views.bars(spark, folder), 252))


@query
def macro_term_slope(spark, folder):
    return macro.macro_term_slope(views.macro_table(spark, folder))


@query
def time_split(spark, folder):
    return aggregates.time_split(views.bars(spark, folder))


@query
def validation_accuracy(spark, folder):
    return trained(spark, folder)[1]


@query
def counter_rate_per_min(spark, folder):
    return rounded(aggregates.counter_rate_per_min(views.metrics(spark, folder), "event_type", "seconds"))


@query
def duration_p95(spark, folder):
    return rounded(aggregates.duration_p95(views.metrics(spark, folder), "event_type", "seconds"))


@query
def status_totals(spark, folder):
    return aggregates.status_totals(views.metrics(spark, folder), "event_type")


@query
def state_means_(spark, folder):
    p = views.probabilities(spark, folder).select(
        F.col("hmm_prob").alias("probs"), *[F.col("seq_prob")[i].alias(f"x{i}") for i in range(4)])
    return rounded(state_means(p, ["x0", "x1", "x2", "x3"]).withColumn("state", F.col("state").cast("long")))


# -- E: windows ------------------------------------------------------------------------------------------

def _over(df, name, column, reach):
    return with_keys(ordered.over_blocks(df, lambda d: d.withColumn(name, column), reach), name)


@query
def rolling_mean(spark, folder):
    return _over(views.bars(spark, folder), "mean_21", ordered.rolling_mean(F.col("close"), 21), 21)


@query
def rolling_std(spark, folder):
    return _over(views.bars(spark, folder), "std_21", ordered.rolling_std(F.col("close"), 21), 21)


@query
def ewm_mean(spark, folder):
    means = [ordered.Ewm("ewm_adjusted", "close", 2 / 15, True), ordered.Ewm("ewm_recursive", "close", 2 / 15),
             ordered.Ewm("ewm_half", "close", 0.5), ordered.Ewm("ewm_short", "close", 0.9), ordered.Ewm("ewm_long", "close", 0.01),
             ordered.Ewm("ewm_gaps", "gappy", 2 / 15), ordered.Ewm("ewm_gaps_adjusted", "gappy", 2 / 15, True)]
    bars = views.bars(spark, folder).withColumn("gappy", F.expr("if(volume % 4 = 0, null, close)"))
    df = ordered.over_blocks(bars, lambda d: ordered.ewm_mean(d, means), ordered.ewm_reach(0.01))
    return rounded(df.select("ticker", "time", *[m.out for m in means]), 4)


@query
def diff(spark, folder):
    return with_keys(ordered.diff(views.bars(spark, folder), {"move": "close"}), "move")


@query
def shift(spark, folder):
    return with_keys(ordered.shift(views.bars(spark, folder), {"close_before": "close"}, 21), "close_before")


@query
def forward_fill(spark, folder):
    holes = views.bars(spark, folder).withColumn("seen", F.expr("if(volume % 3 = 0, close, null)"))
    return with_keys(ordered.forward_fill(holes, ["seen"]), "seen")


@query
def log_return(spark, folder):
    return with_keys(volatility.log_return(views.bars(spark, folder)), "log_return")


@query
def realized_vol(spark, folder):
    return with_keys(volatility.realized_vol(views.bars(spark, folder)), "rv_5d", "rv_21d", "rv_63d")


@query
def vol_ratio(spark, folder):
    return with_keys(volatility.vol_ratio(views.bars(spark, folder)), "rv_ratio")


@query
def atr(spark, folder):
    return rounded(volatility.atr(views.bars(spark, folder)).select("ticker", "time", "atr_14", "atr_pct"), 4)


@query
def rv_zscore(spark, folder):
    return with_keys(volatility.rv_zscore(views.bars(spark, folder)), "rv_21d_zscore")


@query
def rsi(spark, folder):
    return with_keys(momentum.rsi(views.bars(spark, folder)), "rsi_14", "rsi_norm")


@query
def tsi(spark, folder):
    return with_keys(momentum.tsi(views.bars(spark, folder)), "tsi", "tsi_signal")


@query
def momentum_(spark, folder):
    return with_keys(momentum.momentum(views.bars(spark, folder)), "mom_5d", "mom_21d", "mom_63d")


@query
def trend_strength(spark, folder):
    return with_keys(momentum.trend_strength(views.bars(spark, folder)), "trend_r")


@query
def macro_term_change(spark, folder):
    return rounded(_macro_features(spark, folder).select("time", "vix", "vix_term_slope"))


@query
def macro_zscores(spark, folder):
    return rounded(_macro_features(spark, folder).select("time", "vix_zscore", "hy_spread_zscore"))


@query
def yield_inversion_flag(spark, folder):
    return rounded(_macro_features(spark, folder).select("time", "yield_curve_slope", "yc_inverted"))


@query
def rolling_zscores(spark, folder):
    df = normalise.add_rolling_zscores(views.bars(spark, folder))
    return with_keys(df, "open_z", "high_z", "low_z", "close_z", "volume_z")


@query
def latest_n_per_ticker(spark, folder):
    return with_keys(ordered.latest_n(views.bars(spark, folder), 60), "close")


@query
def dedupe_keep_last(spark, folder):
    raw = views.raw_prices(spark, folder).withColumnRenamed("Datetime", "time")
    return rounded(ordered.dedupe_keep_last(raw, ["ticker", "time"], views.CHAIN_TIES).select("ticker", "time", "Open"))


@query
def row_index(spark, folder):
    return with_keys(reads.positions(views.bars(spark, folder)), "row_idx")


@query
def row_index_by_range(spark, folder):
    """Positions and carried prices of event types that hold a fifth of all rows each."""
    df = ranges.range_index(views.gappy_ticks(spark, folder), ["ticker"], "time", "row_idx", ["seq"], ["price"])
    return rounded(df.select("ticker", "time", "seq", "row_idx", "price"))


def _moves(df):
    return with_keys(df.withColumn("prev_regime", F.col("prev_regime").cast("double")),
                     "regime", "prev_regime", "changed")


@query
def regime_transitions(spark, folder):
    return _moves(alerts.regime_transitions(views.signals(spark, folder)))


@query
def sliding_sequences(spark, folder):
    df = volatility.log_return(views.bars(spark, folder)).withColumn("lr", F.coalesce("log_return", F.lit(0.0)))
    df = seqs.sliding_sequences(df, ["lr", "volume"])
    flat = F.flatten("seq")
    return rounded(df.select(
        "ticker", "time", F.size("seq").cast("long").alias("n_rows"), F.size(flat).cast("long").alias("n_values"),
        F.aggregate(flat, F.lit(0.0), lambda a, x: a + x).alias("total"), F.col("seq")[59][0].alias("newest")))


@query
def all_features(spark, folder):
    df = feature_pipeline(views.bars(spark, folder), views.macro(spark, folder), macro_order="seq")
    return rounded(df, 4)


@query
def all_features_without_macro(spark, folder):
    return rounded(feature_pipeline(views.bars(spark, folder)), 4)


@query
def all_features_with_options(spark, folder):
    m = options.options_metrics(views.options_chain(spark, folder, "l_returnflag"), views.CHAIN_TIES)
    df = feature_pipeline(views.bars(spark, folder), views.macro(spark, folder), m, macro_order="seq")
    return rounded(df.select("ticker", "time", "gex_proxy", "put_call_ratio", "iv_skew_proxy",
                             "gex_proxy_z", "iv_skew_proxy_z", "close_z", "vix_z"), 4)


# -- F, G: order and sets --------------------------------------------------------------------------------

@query
def sort_ticker_time(spark, folder):
    return with_keys(sorted_by_ticker_time(views.bars(spark, folder)), "close")


@query
def recent_bars(spark, folder):
    return with_keys(reads.recent_bars(views.bars(spark, folder), "R"), "open", "close", "volume")


@query
def regime_history(spark, folder):
    return with_keys(reads.regime_history(views.signals(spark, folder), "U7"), "regime", "confidence")


@query
def recent_alerts(spark, folder):
    return reads.recent_alerts(_alerts(spark, folder)).select("id", "time", "ticker", "alert_type", "severity")


@query
def top_k_by_strike(spark, folder):
    top = options.top_k_by_strike(views.options_chain(spark, folder), views.CHAIN_TIES)
    return rounded(top.select("ticker", "option_type", F.col("_rank").cast("long").alias("rank"),
                              "strike", "implied_volatility", "l_orderkey"))


@query
def regime_board(spark, folder):
    board = reads.regime_board(reads.latest_signals(views.signals(spark, folder)), "regime")
    return board.select("ticker", "time", "regime", "regime_name")


@query
def union_calls_puts(spark, folder):
    chain = views.options_chain(spark, folder)
    sides = [chain.filter(F.col("option_type") == s).drop("option_type") for s in ("call", "put")]
    return rounded(options.union_calls_puts(*sides).select("ticker", "option_type", "strike", "l_orderkey"))


@query
def union_history_live(spark, folder):
    past = _past(spark, folder).withColumn("_live", F.lit(0))
    return with_keys(reads.union_history_live(past, _live(spark, folder).withColumn("_live", F.lit(1))), "close", "origin")


@query
def distinct_times(spark, folder):
    return views.bars(spark, folder).select("time").distinct().orderBy("time")


@query
def distinct_tickers(spark, folder):
    return views.signals(spark, folder).select("ticker").distinct().orderBy("ticker")


# -- H: scalars ------------------------------------------------------------------------------------------

@query
def math(spark, folder):
    o = views.table(spark, folder, "orders")
    x = F.col("o_totalprice")
    return rounded(o.select(
        "o_orderkey", F.log(x).alias("ln"), F.sqrt(x).alias("root"), F.abs(x - 200000).alias("size"),
        F.pow(x / 1000, 2).alias("square"), F.round(x / 7, 4).alias("rounded"), (x / 3).alias("third")))


@query
def clip_(spark, folder):
    e = views.table(spark, folder, "events")
    x = F.expr("if(event_type = 'error', null, value)")
    return rounded(e.select("event_id", clip(x, 10, 50).alias("both"), clip(x, low=20).alias("low"),
                            clip(x, high=30).alias("high")))


@query
def max_horizontal(spark, folder):
    b = views.stored_bars(spark, folder)
    return with_keys(b.withColumn("top", F.greatest("open", "close", "vwap")), "top")


@query
def sum_horizontal(spark, folder):
    b = views.stored_bars(spark, folder)
    b = b.withColumn("present", count_present(["open", "close", "vwap"]).cast("long"))
    return with_keys(b, "present")


@query
def cast_types(spark, folder):
    o = views.table(spark, folder, "orders")
    return rounded(o.select(
        "o_orderkey", F.col("o_totalprice").cast("long").alias("whole"),
        F.substring("o_orderpriority", 1, 1).try_cast("double").alias("digit"),
        F.col("o_orderpriority").try_cast("double").alias("broken"),
        (F.col("o_orderstatus") == "F").cast("double").alias("flag")))


@query
def datetime(spark, folder):
    o = views.table(spark, folder, "orders")
    text = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        "o_orderkey", F.to_date("o_orderdate").cast("string").alias("day"),
        F.to_timestamp(text, "yyyy-MM-dd").cast("timestamp_ntz").alias("parsed"),
        F.datediff(F.lit(AS_OF).cast("date"), F.to_date("o_orderdate")).cast("long").alias("age"))


@query
def strings(spark, folder):
    c = views.table(spark, folder, "customer")
    return c.select(
        "c_custkey", F.upper(F.trim(F.concat(F.lit(" "), "c_name"))).alias("upper"),
        title_case(F.col("c_mktsegment")).alias("title"),
        F.array_join(split_list(F.concat_ws(", ", F.lower("c_mktsegment"), F.lit("spy"))), "|").alias("parts"),
        F.regexp_replace("c_name", "^Customer#", "").alias("number"),
        F.replace(F.lit("mean_reverting"), F.lit("_"), F.lit("-")).alias("dashed"))


@query
def json(spark, folder):
    e = views.table(spark, folder, "events")
    packed = F.to_json(F.struct("event_id", "event_type"))
    return e.select(
        "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.from_json(packed, "event_id long, event_type string")["event_type"].alias("back"))


@query
def prob_vector(spark, folder):
    p = views.probabilities(spark, folder)
    mixed = prob.blend(F.col("hmm_prob"), F.col("seq_prob"), 0.4, 0.6)
    p = p.withColumn("m", mixed)
    cols = [F.element_at(prob.permuted(F.col("m"), [2, 0, 3, 1]), i + 1).alias(f"p{i}") for i in range(4)]
    return rounded(p.select("vec_id", prob.argmax(F.col("m")).cast("long").alias("best"),
                            F.array_max("m").alias("largest"), *cols))


@query
def softmax(spark, folder):
    p = views.probabilities(spark, folder).withColumn("s", prob.softmax(F.col("logits")))
    return rounded(p.select("vec_id", *[F.col("s")[i].alias(f"s{i}") for i in range(4)]))


@query
def format_pct(spark, folder):
    s = views.signals(spark, folder)
    return s.select("ticker", "time", percent(F.col("confidence")).alias("text"))


# -- I: streams ------------------------------------------------------------------------------------------

PARTS, FILES = 4, 2


def _in_batches(df, order):
    """``df`` as a stream of four batches, cut at quartiles of ``order``, each of two files written in parallel."""
    place = F.col(order) if dict(df.dtypes)[order] != "timestamp_ntz" else F.unix_micros(F.col(order).cast("timestamp"))
    cuts = df.agg(F.percentile_approx(place, [0.25, 0.5, 0.75])).first()[0]
    part = F.lit(0)
    for c in cuts:
        part = part + (place > c).cast("int")
    return _by_part(df.withColumn("_part", F.coalesce(part, F.lit(0))), PARTS)


def _by_part(df, parts):
    """``df`` as a stream with a batch for each number in ``_part``, below ``parts``."""
    path = shared_folder(df.sparkSession, "stream-files")
    cut = written(df, "stream-rows")
    for n in range(parts):  # one after another: files are read in the order of their times
        cut.where(F.col("_part") == n).drop("_part").repartition(FILES).write.parquet(f"{path}/part={n}")
    return jobs.file_source(df.sparkSession, f"{path}/*", df.drop("_part").schema, files_per_batch=FILES)


def _event_stream(spark, folder):
    return _in_batches(views.table(spark, folder, "events"), "ts")


def _run(stream, handle, mode="append"):
    spark = stream.sparkSession
    writer = jobs.each_batch(stream, handle, shared_folder(spark, "checkpoint"), available_now=True)
    writer.outputMode(mode).start().awaitTermination()


@query
def stream_route(spark, folder):
    out = shared_folder(spark, "routed")
    events = _event_stream(spark, folder)
    sent = events.selectExpr(
        "case event_type when 'click' then 'ohlcv' when 'signup' then 'macro' when 'purchase' then 'options'"
        " else 'other' end as topic",
        "to_json(named_struct('records', array(named_struct('time', cast(ts as timestamp),"
        " 'ticker', event_type, 'series_id', event_type, 'value', value, 'close', value,"
        " 'gex_proxy', value)))) as value")
    measured = {"ohlcv": "close", "macro": "value", "options": "gex_proxy"}

    def handle(batch, batch_id):
        for topic, rows in envelopes.route(batch).items():
            rows.select(F.lit(topic).alias("topic"), F.col(measured[topic]).alias("amount")).write.mode(
                "overwrite").parquet(f"{out}/topic={topic}/batch={batch_id}")

    _run(sent, handle)
    rows = spark.read.parquet(*[f"{out}/topic={t}/*" for t in measured])
    return rounded(rows.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount")), 3)


@query
def stream_feature_batches(spark, folder):
    out = shared_folder(spark, "stream-features")
    macro_rows = written(views.macro_table(spark, folder), "macro")
    handle = jobs.feature_batches(
        lambda: macro_rows, lambda: None, f"{out}/bars", f"{out}/features", f"{out}/messages")
    _run(_in_batches(views.bars(spark, folder), "time"), handle)
    return with_keys(spark.read.parquet(f"{out}/features"), "close", "rsi_14", "vix", "close_z")


@query
def stream_feature_job(spark, folder):
    """Messages of all topics in one stream, to features with macro and options state."""
    out = shared_folder(spark, "feature-job")
    bars = views.bars(spark, folder).withColumn("time", F.col("time").cast("timestamp"))
    macro_rows = views.macro_table(spark, folder).withColumn("time", F.col("time").cast("timestamp"))
    metrics = options.options_metrics(views.options_chain(spark, folder, "l_returnflag"), views.CHAIN_TIES)
    broken = spark.range(40).selectExpr("id", "'ohlcv' as topic", "'{broken' as value")
    sent = None
    # Macro and options come first, then the bars by their years, a broken message now and then.
    for at, topic, rows, key in ((0, "macro", macro_rows, "series_id"), (1, "options", metrics, "ticker"),
                                 (2, "ohlcv", bars, "ticker")):
        values = rows.groupBy(key, *([F.year("time").alias("y")] if topic != "options" else [])).agg(
            F.collect_list(F.struct(*rows.columns)).alias("records"))  # a year of one key at most
        year = F.col("y") if topic == "ohlcv" else F.lit(0)
        text = F.to_json(F.struct(F.lit("2024-01-01T00:00:00").alias("ingested_at"), "records"), envelopes.JSON_TIMES)
        part = values.select((year * 10 + at).cast("long").alias("id"), F.lit(topic).alias("topic"), text.alias("value"))
        sent = part if sent is None else sent.unionByName(part)
    stream = _in_batches(sent.unionByName(broken), "id")
    _run(stream, jobs.feature_job(f"{out}/bars", f"{out}/macro", f"{out}/options", f"{out}/features", f"{out}/messages"))
    made = spark.read.parquet(f"{out}/features").select("ticker", "time", "close", "rsi_14", "vix", "put_call_ratio")
    dead = spark.read.parquet(f"{out}/messages/dead/*").where("reason = 'unreadable'").count()
    return rounded(made.withColumn("n_dead", F.lit(dead).cast("long")))


@query
def macro_cache(spark, folder):
    """Macro rows of a stream, upserted so that later batches still see earlier rows."""
    path = shared_folder(spark, "macro-cache")
    stream = _in_batches(views.table(spark, folder, "orders"), "o_orderkey").selectExpr(
        "o_orderdate as time", "o_orderpriority as series_id", "o_totalprice as value", "o_orderkey as seq")
    _run(stream, lambda b, i: jobs.upsert_macro_rows(b, path, "seq"))
    return rounded(spark.read.parquet(path).drop("period"))


@query
def options_latest_state(spark, folder):
    path = shared_folder(spark, "options-state")
    stream = _event_stream(spark, folder).selectExpr(
        "concat('U', user_id % 15) as ticker", "value as iv_skew_proxy", "value / 2 as put_call_ratio",
        "value * 2 as gex_proxy", "ts as time")
    _run(stream, lambda b, i: jobs.upsert_latest(b, path, i, ["ticker"], "time"))
    return rounded(jobs.latest_state(spark, path))


@query
def stream_infer(spark, folder):
    out = shared_folder(spark, "stream-signals")
    models, _ = trained(spark, folder)
    live = features(spark, folder)
    live.filter("year(time) < 2001").write.partitionBy("ticker").parquet(f"{out}/stored")
    stream = _in_batches(live.filter("year(time) >= 2001"), "time")
    _run(stream, jobs.inference_batches(models, f"{out}/stored", f"{out}/signals", f"{out}/messages"))
    return spark.read.parquet(f"{out}/signals/*").select("ticker", "time", "regime", "confidence")


def _stream_alerts(spark, folder, name):
    out = shared_folder(spark, "stream-alerts")
    stream = _in_batches(views.signals(spark, folder), "time")
    _run(stream, jobs.alert_batches(f"{out}/state", f"{out}/transitions", f"{out}/alerts"))
    return spark.read.parquet(f"{out}/{name}/*")


@query
def stream_regime_shift(spark, folder):
    return _moves(_stream_alerts(spark, folder, "transitions"))


@query
def alert_rules(spark, folder):
    return _parsed_alerts(_alerts(spark, folder))


@query
def feature_alerts(spark, folder):
    df = volatility.vol_ratio(views.bars(spark, folder)).withColumn("gex_proxy", F.col("close") - F.col("open"))
    return alerts.feature_alerts(df).select("ticker", "time", "alert_type", "severity")


@query
def start_offsets(spark, folder):
    """Jobs that rebuild tables start from the first message: such a job sees the whole table."""
    first = [job for job, offset in jobs.START_OFFSETS.items() if offset == "earliest"]
    if first != ["features"]:
        raise ValueError(f"{first} would read all messages again")
    out = shared_folder(spark, "offsets")
    _run(_event_stream(spark, folder), lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"))
    rows = spark.read.parquet(f"{out}/*")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@query
def late_data_upsert(spark, folder):
    """Bars, a later delivery, and in the same batch corrections that lower its closes again."""
    out = shared_folder(spark, "late")
    stored = views.stored_bars(spark, folder).withColumn("seq", F.lit(0))
    incoming = views.incoming_bars(spark, folder).withColumn("seq", F.lit(2))
    corrected = incoming.where("dayofmonth(time) % 4 = 0").selectExpr(
        "time", "ticker", "open", "high", "low", "close / 4 as close", "volume", "vwap", "source", "3 as seq")
    both = stored.unionByName(incoming).unionByName(corrected)
    path = shared_folder(spark, "late-files")
    for n, rows in enumerate((both.where("seq = 0"), both.where("seq > 0"))):
        rows.repartition(FILES).write.parquet(f"{path}/part={n}")
    stream = jobs.file_source(spark, f"{path}/*", both.schema, files_per_batch=FILES)
    _run(stream, lambda b, i: jobs.late_data_upsert(b, out, ["seq"]))
    return rounded(spark.read.parquet(out).select(*stored.drop("seq").columns))


@query
def snapshot_plus_updates(spark, folder):
    s = views.signals(spark, folder).select("ticker", "time", "regime", "confidence")
    snapshot = reads.latest_signals(s.filter(landing.time_range(end=SIGNALS_AS_OF)))
    return rounded(reads.snapshot_plus_updates(snapshot, s.filter(F.col("time") > F.lit(SIGNALS_AS_OF).cast("timestamp_ntz"))))


@query
def tumbling_bars(spark, folder):
    out = shared_folder(spark, "tumbling")
    stream = _event_stream(spark, folder).selectExpr(
        "cast(ts as timestamp) as time", "event_type as ticker", "value as open", "value * 1.5D as high",
        "value * 0.5D as low", "value * 1.25D as close", "event_id % 97 as volume")
    _run(jobs.tumbling_bars(stream),
         lambda b, i: b.withColumn("batch_no", F.lit(i)).write.mode("overwrite").parquet(f"{out}/batch={i}"), "update")
    rows = spark.read.parquet(f"{out}/*")
    last = ordered.dedupe_keep_last(rows, ["ticker", "bucket"], ["batch_no"]).drop("batch_no")
    return rounded(last.withColumn("bucket", F.col("bucket").cast("timestamp_ntz")))


@query
def late_rows(spark, folder):
    """Every row of a stream by day and ticker, final, open or late: each seventh comes ten days after its time."""
    out = shared_folder(spark, "late-rows")
    ticks = views.table(spark, folder, "events").selectExpr(
        "ts as time", "event_type as ticker", "value as open", "value * 1.5D as high", "value * 0.5D as low",
        "value * 1.25D as close", "event_id % 97 as volume",
        "(datediff(ts, date'2024-01-01') + if(event_id % 7 = 0, 10, 0)) div 8 as _part")
    _run(_by_part(ticks, 6), event_time.daily_bar_batches(f"{out}/state", f"{out}/bars", f"{out}/late", "2 days"))
    final = spark.read.parquet(f"{out}/bars/*").withColumn("state", F.lit("final"))
    days = final.unionByName(event_time.open_days(spark, f"{out}/state").withColumn("state", F.lit("open")))
    late = spark.read.parquet(f"{out}/late/*").groupBy("bucket", "ticker").agg(F.count(F.lit(1)).alias("n"))
    return rounded(days.unionByName(late.withColumn("state", F.lit("late")), allowMissingColumns=True))


@query
def signal_expiries(spark, folder):
    """Signals that outlived an hour, as the stream reports them."""
    out = shared_folder(spark, "expiries")
    stream = _in_batches(views.signals(spark, folder), "time")
    _run(event_time.signal_expiries(stream, 3600, "10 minutes"), event_time.write_batches(out))
    times = [F.col(c).cast("timestamp_ntz").alias(c) for c in ("time", "live_from", "expired_at")]
    return spark.read.parquet(f"{out}/*").select("ticker", "regime", "n_signals", *times)


@query
def signal_ttl(spark, folder):
    latest = reads.latest_signals(views.signals(spark, folder))
    return jobs.signal_expiry(latest, "2024-01-30 23:59:59", 3600).select("ticker", "time", "regime")


# -- M: models -------------------------------------------------------------------------------------------

@query
def prepare_training(spark, folder):
    rows = training_rows(spark, folder)
    return rounded(rows.select("ticker", "time", *seqs.present(rows, HMM_FEATURES)), 4)


@query
def hmm_fit_(spark, folder):
    rows = training_rows(spark, folder)
    model, history = hmm_fit(rows, seqs.present(rows, HMM_FEATURES), max_iter=10)
    steps = [(i, float(v)) for i, v in enumerate(history)]
    return spark.createDataFrame(steps, "step int, loglik double")


#: Two states over one feature, stated here and in the SQL.
GIVEN_HMM = HmmModel(["move"], np.array([0.6, 0.4]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.1], [-0.1]]),
                     np.array([[[0.05]], [[0.3]]]), [1, 0])


@query
def hmm_decode_given(spark, folder):
    """Best path and posteriors of all bars under given parameters, in blocks that the tree scan has to put together."""
    rows = views.bars(spark, folder).select("ticker", "time", F.log(F.col("close") / F.col("open")).alias("move"))
    decoded = hmm_decode(rows, GIVEN_HMM, block_rows=32)
    return rounded(decoded.select("ticker", "time", "label", F.get("hmm_prob", F.lit(0)).alias("p0"),
                                  F.get("hmm_prob", F.lit(1)).alias("p1"), "confidence"))


@query
def hmm_decode_(spark, folder):
    return _labels(spark, folder).select("ticker", "time", "label", "hmm_prob")


@query
def label_states_(spark, folder):
    df = features(spark, folder).join(
        reads.bars_with_regime(views.bars(spark, folder), views.bar_signals(spark, folder)).select(
            "ticker", "time", F.col("regime").alias("state")), ["ticker", "time"]).dropna(subset=["state"])
    names = ["rv_21d_zscore", "vix_zscore", "trend_r", "tsi", "mom_21d"]
    return label_states(df.groupBy("state").agg(*[F.avg(c).alias(c) for c in names]))


@query
def pseudo_labels(spark, folder):
    return _labels(spark, folder).groupBy("ticker", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"))


@query
def sequence_classifier(spark, folder):
    models, _ = trained(spark, folder)
    rows = seqs.sliding_sequences(training_rows(spark, folder), models.features).select("ticker", "time", "seq")
    return classify(models.classifier, rows).drop("seq")


@query
def ensemble_predict_(spark, folder):
    p = ensemble_predict(views.probabilities(spark, folder))
    cols = [F.col("ensemble_prob")[i].alias(f"p{i}") for i in range(4)]
    return rounded(p.select("vec_id", F.col("regime").cast("long").alias("regime"), "regime_name", "confidence", *cols))


@query
def infer_all(spark, folder):
    return training.infer_all(features(spark, folder), trained(spark, folder)[0])


@query
def train_job(spark, folder):
    models, accuracy = trained(spark, folder)
    return accuracy.withColumn("n_features", F.lit(len(models.features)))


