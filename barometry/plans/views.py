"""Domain views over the general-purpose test tables (see FIXTURES.md)."""

from pyspark.sql import DataFrame, SparkSession

CHAIN_TIES = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity"]


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _sql(spark: SparkSession, folder: str, query: str, *names: str) -> DataFrame:
    return spark.sql(query, **{n: table(spark, folder, n) for n in names})


def raw_prices(spark: SparkSession, folder: str) -> DataFrame:
    """One landed price row per line item, with copies of a time and missing closes."""
    return _sql(spark, folder, """
        select l_shipdate as Datetime, l_returnflag as ticker, l_extendedprice / l_quantity as Open,
               l_extendedprice / l_quantity * 1.01D as High, l_extendedprice / l_quantity * 0.99D as Low,
               case when l_quantity <> 13 then l_extendedprice / l_quantity * 1.005D end as Close,
               l_quantity as Volume,
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
        from {lineitem}""", "lineitem")


def bars(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, """
        select l_shipdate as time, l_returnflag as ticker,
               min_by(px, k) as open, max(px) as high, min(px) as low, max_by(px, k) as close,
               cast(sum(l_quantity) as bigint) as volume
        from (select l_shipdate, l_returnflag, l_quantity, l_extendedprice / l_quantity as px,
                     struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) as k
              from {lineitem})
        group by l_shipdate, l_returnflag""", "lineitem")


def macro(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, """
        select o_orderdate as time,
               case o_orderpriority when '1-URGENT' then 'VIXCLS' when '2-HIGH' then 'T10Y2Y'
                    when '3-MEDIUM' then 'BAMLH0A0HYM2' when '4-NOT SPECIFIED' then 'DGS10'
                    else 'DGS2' end as series_id,
               o_totalprice / 10000D - 10D as value, o_orderkey as seq
        from {orders}""", "orders")


def options_chain(spark: SparkSession, folder: str, ticker: str = "p_brand") -> DataFrame:
    return _sql(spark, folder, f"""
        select {ticker} as ticker, p_retailprice as strike,
               case when l_linestatus = 'O' then 'call' else 'put' end as option_type,
               l_extendedprice as last_price, l_discount as implied_volatility,
               cast(nullif(l_quantity, 7D) as bigint) as open_interest,
               cast(nullif(l_quantity, 11D) as bigint) as volume,
               l_tax as gamma, cast(date_trunc('year', l_shipdate) as timestamp_ntz) as expiry,
               l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity
        from {{lineitem}} join {{part}} on l_partkey = p_partkey""", "lineitem", "part")


def signals(spark: SparkSession, folder: str) -> DataFrame:
    """Regime signals of 15 tickers at event times."""
    return _sql(spark, folder, """
        select ts as time, concat('U', user_id % 15) as ticker, cast(floor(value) % 4 as int) as regime,
               element_at(array('trending', 'mean_reverting', 'choppy', 'high_vol'),
                          cast(floor(value) % 4 as int) + 1) as regime_name,
               cast(event_id * 37 % 1000 as double) / 1000D as confidence,
               transform(array(0, 1, 2, 3), i -> case when i = floor(value) % 4
                   then cast(event_id * 37 % 1000 as double) / 1000D
                   else (1D - cast(event_id * 37 % 1000 as double) / 1000D) / 3D end) as ensemble_prob
        from {events}""", "events")


def bar_signals(spark: SparkSession, folder: str) -> DataFrame:
    """Several regime signals a day for the bar tickers."""
    return _sql(spark, folder, """
        select o_orderdate + make_dt_interval(0, cast(o_orderkey % 24 as int)) as time,
               element_at(array('A', 'N', 'R'), cast(o_custkey % 3 as int) + 1) as ticker,
               cast(floor(o_totalprice) % 4 as int) as regime, o_orderkey as seq
        from {orders}""", "orders")


def intraday_macro(spark: SparkSession, folder: str) -> DataFrame:
    """Macro observations stamped at hours of the day."""
    return macro(spark, folder).selectExpr(
        "time + make_dt_interval(0, cast(seq * 5 % 24 as int)) as time", "series_id", "value", "seq")


def gappy_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Event values by event type, most of them unknown; several events may share a time."""
    return _sql(spark, folder, """
        select event_type as ticker, date_trunc('minute', ts) as time, event_id as seq,
               case when event_id % 7 = 3 then value end as price from {events}""", "events")


def metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Service metrics: one counted, timed unit of work per event."""
    return _sql(spark, folder, """
        select ts, event_type, case when event_type = 'error' then 'error' else 'success' end as status,
               value as seconds from {events}""", "events")


def ticks(spark: SparkSession, folder: str) -> DataFrame:
    """Intraday bars: one per event."""
    return _sql(spark, folder, """
        select ts as time, event_type as ticker, value as open, value * 1.5D as high, value * 0.5D as low,
               value * 1.25D as close, event_id % 97 as volume
        from {events}""", "events")


def stored_bars(spark: SparkSession, folder: str) -> DataFrame:
    """Bars with vwap and source, as the bar table keeps them."""
    return bars(spark, folder).selectExpr(
        "time", "ticker", "open", "high", "low", "close", "volume",
        "case when volume % 2 = 0 then (high + low) / 2 end as vwap", "'yfinance' as source")


def incoming_bars(spark: SparkSession, folder: str) -> DataFrame:
    """A later delivery: every second day again with other prices, and every day once more a year on."""
    stored = stored_bars(spark, folder)
    again = stored.filter("dayofmonth(time) % 2 = 0").selectExpr(
        "time", "ticker", "open * 2 as open", "high * 2 as high", "low * 2 as low", "close * 2 as close",
        "volume + 1 as volume", "cast(null as double) as vwap", "'polygon' as source")
    later = stored.selectExpr(
        "time + interval 3650 days as time", "ticker", "open", "high", "low", "close", "volume", "vwap",
        "'polygon' as source")
    return again.unionByName(later)


def macro_table(spark: SparkSession, folder: str) -> DataFrame:
    """Macro rows unique per series and time."""
    return macro(spark, folder).groupBy("series_id", "time").agg({"value": "max"}).selectExpr(
        "time", "series_id", "`max(value)` as value", "'fred' as source")


def responses(spark: SparkSession, folder: str) -> DataFrame:
    """Macro service responses as JSON: two observations each, some missing, broken or without a date."""
    return _sql(spark, folder, """
        select case o_orderpriority when '1-URGENT' then 'VIXCLS' when '2-HIGH' then 'T10Y2Y'
                    when '3-MEDIUM' then 'BAMLH0A0HYM2' when '4-NOT SPECIFIED' then 'DGS10'
                    else 'DGS2' end as series_id,
               to_json(named_struct('observations', array(
                   named_struct('date', date_format(o_orderdate, 'yyyy-MM-dd'),
                                'value', if(o_orderstatus = 'F', '.', cast(o_totalprice as string))),
                   named_struct('date', if(o_orderstatus = 'O', cast(null as string),
                                           date_format(o_orderdate + interval 1 day, 'yyyy-MM-dd')),
                                'value', if(o_custkey % 2 = 0, 'n/a', cast(o_orderkey as string)))))) as body
        from {orders}""", "orders")


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """Topic messages with two records each; errors travel on a topic nobody reads."""
    return _sql(spark, folder, """
        select case event_type when 'click' then 'ohlcv' when 'view' then 'ohlcv' when 'signup' then 'macro'
                    when 'purchase' then 'options' else 'other' end as topic,
               to_json(named_struct(
                   'batch_id', cast(event_id as string), 'source', 'ingestion-service',
                   'data_type', event_type, 'record_count', 2,
                   'records', array(
                       named_struct('time', cast(ts as timestamp), 'ticker', concat('U', user_id % 15),
                            'series_id', 'VIXCLS', 'value', value, 'open', value, 'close', value + 1,
                            'volume', event_id, 'put_call_ratio', value / 2, 'gex_proxy', value * 2),
                       named_struct('time', cast(ts as timestamp), 'ticker', 'ALL',
                            'series_id', 'DGS2', 'value', value * 2, 'open', value * 3, 'close', value,
                            'volume', event_id + 1, 'put_call_ratio', value, 'gex_proxy', -value))),
                   map('timestampFormat', "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX")) as value
        from {events}""", "events")


def probabilities(spark: SparkSession, folder: str) -> DataFrame:
    """Two probability vectors and four logits per row, folded from all entries of its embedding.

    Entry i (from 0) adds to place i modulo 4: entries with an even i div 4 to the first vector, with an odd one
    to the second, and all to the logits.
    """
    return _sql(spark, folder, """
        with entries as (
            select vec_id, transform(embedding, x -> cast(x as double)) as e from {embeddings}
        ), sums as (
            select vec_id,
                   transform(sequence(0, 3), p -> aggregate(filter(e, (x, i) -> i % 8 = p), 0D, (a, x) -> a + abs(x)) + 1e-6D) as h,
                   transform(sequence(0, 3), p -> aggregate(filter(e, (x, i) -> i % 8 = p + 4), 0D, (a, x) -> a + abs(x)) + 1e-6D) as s,
                   transform(sequence(0, 3), p -> aggregate(filter(e, (x, i) -> i % 4 = p), 0D, (a, x) -> a + x)) as logits
            from entries)
        select vec_id,
               transform(h, x -> x / aggregate(h, 0D, (a, y) -> a + y)) as hmm_prob,
               transform(s, x -> x / aggregate(s, 0D, (a, y) -> a + y)) as seq_prob, logits
        from sums""", "embeddings")
