"""Independent SQL for the registered queries, written for DuckDB over the same tables."""

TIES = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity"
MACRO_COLUMNS = ["vix", "yield_curve_slope", "hy_spread", "rate_10y", "rate_2y"]
MACRO_JOINED = ["vix", "yield_curve_slope", "hy_spread",
                "vix_term_slope", "vix_zscore", "yc_inverted", "hy_spread_zscore"]


# Values that both engines get by the same single operation on the same stored numbers.
EXACT = ["open", "high", "low", "close", "vwap", "top", "Open", "close_before", "move", "seen", "last_close",
         "max_high", "vix", "yield_curve_slope", "hy_spread", "rate_10y", "rate_2y", "vix_term_slope"]


def r(x: str, name: str | None = None, digits: int = 6) -> str:
    if (name or x) in EXACT:
        return f"{x} as {name or x}"
    return f"round({x}, {digits}) + 0.0 as {name or x}"


def rs(*names: str, digits: int = 6) -> str:
    return ", ".join(r(n, digits=digits) for n in names)


BARS = f"""bars as (
    select l_shipdate as time, l_returnflag as ticker, first(px order by {TIES}) as open,
           max(px) as high, min(px) as low, last(px order by {TIES}) as close,
           cast(sum(l_quantity) as bigint) as volume
    from (select *, l_extendedprice / l_quantity as px from lineitem) group by 1, 2)"""
STORED = """stored as (
    select *, case when volume % 2 = 0 then (high + low) / 2 end as vwap, 'yfinance' as source from bars)"""
INCOMING = """incoming as (
    select time, ticker, open * 2 as open, high * 2 as high, low * 2 as low, close * 2 as close,
           volume + 1 as volume, null::double as vwap, 'polygon' as source
    from stored where day(time) % 2 = 0
    union all
    select time + interval 3650 day, ticker, open, high, low, close, volume, vwap, 'polygon' from stored)"""
SERIES = """case o_orderpriority when '1-URGENT' then 'VIXCLS' when '2-HIGH' then 'T10Y2Y'
    when '3-MEDIUM' then 'BAMLH0A0HYM2' when '4-NOT SPECIFIED' then 'DGS10' else 'DGS2' end"""
MACRO = f"""macro as (
    select o_orderdate as time, {SERIES} as series_id, o_totalprice / 10000 - 10 as value, o_orderkey as seq
    from orders)"""
NAMED = """named as (
    select *, case series_id when 'VIXCLS' then 'vix' when 'T10Y2Y' then 'yield_curve_slope'
        when 'BAMLH0A0HYM2' then 'hy_spread' when 'DGS10' then 'rate_10y' else 'rate_2y' end as name
    from macro)"""
MACRO_TABLE = """macro_table as (
    select time, series_id, max(value) as value, 'fred' as source from macro group by 1, 2)"""
WIDE = "wide as (select time, " + ", ".join(
    f"max_by(value, seq) filter (where name = '{c}') as {c}" for c in MACRO_COLUMNS) + " from named group by 1)"
CHAIN_SELECT = f"""
    select p_brand, l_returnflag, p_retailprice as strike,
           case when l_linestatus = 'O' then 'call' else 'put' end as option_type,
           l_extendedprice as last_price, l_discount as implied_volatility,
           cast(nullif(l_quantity, 7) as bigint) as open_interest, cast(nullif(l_quantity, 11) as bigint) as volume,
           l_tax as gamma, cast(date_trunc('year', l_shipdate) as timestamp) as expiry, {TIES}
    from lineitem join part on l_partkey = p_partkey"""
CHAIN = f"chain as (select p_brand as ticker, * from ({CHAIN_SELECT}))"
FLAG_CHAIN = f"chain as (select l_returnflag as ticker, * from ({CHAIN_SELECT}))"
TOP = f"""top as (
    select *, row_number() over (partition by ticker order by strike, {TIES}) as rank from chain
        where option_type = 'put' and implied_volatility > 0
        qualify rank <= 5
    union all by name
    select *, row_number() over (partition by ticker order by strike desc,
        {", ".join(t + " desc" for t in TIES.split(", "))}) as rank from chain
        where option_type = 'call' and implied_volatility > 0
        qualify rank <= 5)"""
PUT_CALL = """pcr as (
    select ticker, case when calls > 0 then round(puts::double / calls, 4) end as put_call_ratio from (
        select ticker, coalesce(sum(open_interest) filter (where option_type = 'put'), 0) as puts,
               coalesce(sum(open_interest) filter (where option_type = 'call'), 0) as calls
        from chain group by 1))"""
SKEW = """skew as (
    select ticker, round(avg(implied_volatility) filter (where option_type = 'put')
                       - avg(implied_volatility) filter (where option_type = 'call'), 6) as iv_skew_proxy
    from top group by 1)"""
GEX = """gex as (
    select ticker, round(coalesce(sum(gamma * open_interest * 100) filter (where option_type = 'call'), 0)
                       - coalesce(sum(gamma * open_interest * 100) filter (where option_type = 'put'), 0), 2)
               as gex_proxy from chain group by 1)"""
OPTIONS = "opts as (select * from pcr join gex using (ticker) left join skew using (ticker))"
SIGNALS = """signals as (
    select ts as time, 'U' || (user_id % 15) as ticker, cast(floor(value) as int) % 4 as regime,
           ['trending', 'mean_reverting', 'choppy', 'high_vol'][cast(floor(value) as int) % 4 + 1] as regime_name,
           (event_id * 37 % 1000)::double / 1000 as confidence, event_id
    from events)"""
LATEST = """latest as (
    select * from signals qualify row_number() over (partition by ticker order by time desc) = 1)"""
MOVES = """moves as (
    select *, lag(regime) over (partition by ticker order by time) as prev_regime from signals)"""
ALERTS = """alerts as (
    select sha256(ticker || '|' || epoch_us(time) || '|' || alert_type) as id, *, false as read from (
        select time, ticker, 'REGIME_SHIFT' as alert_type,
               case when regime = 3 then 3 when regime in (0, 1) and prev_regime = 2 then 2 else 1 end as severity,
               confidence, prev_regime as from_regime, regime_name as to_regime_name
        from moves where prev_regime <> regime
        union all
        select time, ticker, 'HIGH_VOL_ENTERED', 3, confidence, null, null
        from moves where regime = 3 and prev_regime is distinct from 3
        union all
        select time, ticker, 'CONFIDENCE_LOW', 1, confidence, null, null from moves where confidence < 0.5))"""
BAR_SIGNALS = """bar_signals as (
    select o_orderdate + to_hours(o_orderkey % 24) as time, ['A', 'N', 'R'][o_custkey % 3 + 1] as ticker,
           cast(floor(o_totalprice) as bigint) % 4 as regime, o_orderkey as seq from orders)"""
TICKS = """ticks as (
    select ts as time, event_type as ticker, value as open, value * 1.5 as high, value * 0.5 as low,
           value * 1.25 as close, event_id % 97 as volume from events)"""
PROBS = """probs as (
    select vec_id, list_transform(h, lambda x: x / list_sum(h)) as hmm_prob,
           list_transform(s, lambda x: x / list_sum(s)) as seq_prob, logits
    from (select vec_id,
              [list_sum([abs(e[i + 1]) for i in range(len(e)) if i % 8 = p]) + 1e-6 for p in range(4)] as h,
              [list_sum([abs(e[i + 1]) for i in range(len(e)) if i % 8 = p + 4]) + 1e-6 for p in range(4)] as s,
              [list_sum([e[i + 1] for i in range(len(e)) if i % 4 = p]) for p in range(4)] as logits
          from (select vec_id, embedding::double[] as e from embeddings)))"""
MIX = """mix as (
    select vec_id, hmm_prob, seq_prob, [0.4 * hmm_prob[i] + 0.6 * seq_prob[i] for i in range(1, 5)] as m from probs)"""


def z(c: str, window: str = "w252", n: int = 252, lim: int = 4) -> str:
    return f"""case when count({c}) over {window} = {n} then
        case when max({c}) over {window} = min({c}) over {window} then 0.0
        else greatest(-{lim}, least({lim}, ({c} - avg({c}) over {window})
            / greatest(stddev_samp({c}) over {window}, 1e-8))) end end"""


def full(fn: str, c: str, n: int) -> str:
    return f"case when count({c}) over w{n} = {n} then {fn}({c}) over w{n} end"


def windows(*sizes: int, by: str = "partition by ticker order by time") -> str:
    return "window w as (" + by + "), " + ", ".join(
        f"w{n} as ({by} rows between {n - 1} preceding and current row)" for n in sizes)


# Bars with everything that looks at neighbouring bars.
NEAR = f"""near as (
    select *, row_number() over w - 1 as i, ln(close) - ln(lag(close) over w) as log_return,
           greatest(high - low, abs(high - lag(close) over w), abs(low - lag(close) over w)) as tr,
           close - lag(close) over w as move,
           close / lag(close, 5) over w - 1 as mom_5d, close / lag(close, 21) over w - 1 as mom_21d,
           close / lag(close, 63) over w - 1 as mom_63d,
           close - {full('avg', 'close', 21)} as dc
    from bars {windows(21)})"""
VOL = f"""vol as (
    select *, {full('stddev_samp', 'log_return', 5)} * sqrt(252) as rv_5d,
           {full('stddev_samp', 'log_return', 21)} * sqrt(252) as rv_21d,
           {full('stddev_samp', 'log_return', 63)} * sqrt(252) as rv_63d,
           case when count(dc) over w21 = 21 then greatest(-1, least(1, 10 * avg(dc) over w21
               / greatest(sqrt(100 * avg(dc * dc) over w21), 1e-10))) end as trend_r
    from near {windows(5, 21, 63)})"""
RATIO = """ratio as (
    select *, case when rv_63d is not null then greatest(0.1, least(5, rv_5d / greatest(rv_63d, 1e-8))) end as rv_ratio
    from vol)"""
SLOW, FAST, SIGNAL = 2 / 26, 2 / 14, 2 / 8
EWM = f"""ewm as (
    select ticker, i, tr as num, 1.0::double as den, null::double as gain, null::double as loss,
           null::double as m1, null::double as s1, null::double as m2, null::double as s2, null::double as sig
    from near where i = 0
    union all
    select ticker, i, num, den, gain, loss, m1, s1, m2, s2,
           case when sig is null then 100 * m2 / greatest(s2, 1e-10)
                else sig * (1 - {SIGNAL}) + {SIGNAL} * 100 * m2 / greatest(s2, 1e-10) end
    from (
        select ticker, i, num, den, gain, loss, m1, s1, sig,
               case when m2 is null then m1 else m2 * (1 - {FAST}) + {FAST} * m1 end as m2,
               case when s2 is null then s1 else s2 * (1 - {FAST}) + {FAST} * s1 end as s2
        from (
            select n.ticker, n.i, e.num * 13 / 15 + n.tr as num, e.den * 13 / 15 + 1 as den, e.m2, e.s2, e.sig,
                   case when e.gain is null then greatest(n.move, 0)
                        else e.gain * 13 / 14 + greatest(n.move, 0) / 14 end as gain,
                   case when e.loss is null then greatest(-n.move, 0)
                        else e.loss * 13 / 14 + greatest(-n.move, 0) / 14 end as loss,
                   case when e.m1 is null then n.move else e.m1 * (1 - {SLOW}) + {SLOW} * n.move end as m1,
                   case when e.s1 is null then abs(n.move) else e.s1 * (1 - {SLOW}) + {SLOW} * abs(n.move) end as s1
            from ewm e join near n on n.ticker = e.ticker and n.i = e.i + 1)))"""
SMOOTH = """smooth as (
    select ticker, i, num / den as atr_14, 100 - 100 / (1 + gain / greatest(loss, 1e-10)) as rsi_14,
           100 * m2 / greatest(s2, 1e-10) as tsi, sig as tsi_signal from ewm)"""
RAW = f"""raw as (
    select time, ticker, open, high, low, close, volume, log_return, rv_5d, rv_21d, rv_63d, rv_ratio,
           atr_14, atr_14 / close as atr_pct, {z('rv_21d')} as rv_21d_zscore,
           rsi_14, (rsi_14 - 50) / 50 as rsi_norm, tsi, tsi_signal, mom_5d, mom_21d, mom_63d, trend_r
    from ratio join smooth using (ticker, i) {windows(252)})"""
FILLED = "filled as (select time, " + ", ".join(
    f"last_value({c} ignore nulls) over (order by time rows unbounded preceding) as {c}" for c in MACRO_COLUMNS
) + " from wide)"
MACRO_FEATURES = f"""macro_features as (
    select *, vix - lag(vix, 20) over w as vix_term_slope, {z('vix')} as vix_zscore,
           case when yield_curve_slope < 0 then 1.0 when yield_curve_slope is not null then 0.0 end as yc_inverted,
           {z('hy_spread')} as hy_spread_zscore
    from filled {windows(252, by='order by time')})"""
MACRO_CHAIN = ", ".join([MACRO, NAMED, WIDE, FILLED, MACRO_FEATURES])


def joined_by_date(left: str) -> str:
    fills = ", ".join(
        f"last_value(m.{c} ignore nulls) over (partition by b.ticker order by b.time rows unbounded preceding) as {c}"
        for c in MACRO_JOINED)
    return f"joined as (select b.*, {fills} from {left} b left join macro_features m on m.time::date = b.time::date)"


RAW_CHAIN = ", ".join([BARS, NEAR, VOL, RATIO, EWM, SMOOTH, RAW])
BASE_Z = ["open", "high", "low", "close", "volume", "log_return", "rv_5d", "rv_21d", "rv_63d",
          "atr_14", "atr_pct", "rsi_14", "mom_5d", "mom_21d", "mom_63d"]
MACRO_Z = ["vix", "yield_curve_slope", "hy_spread", "vix_term_slope"]
RAW_FEATURES = ["rv_5d", "rv_21d", "rv_63d", "rv_ratio", "atr_14", "atr_pct", "rv_21d_zscore", "rsi_14",
                "rsi_norm", "tsi", "tsi_signal", "mom_5d", "mom_21d", "mom_63d", "trend_r"]
PRICES = ["open", "high", "low", "close"]


def feature_table(source: str, z_columns: list[str], plain: list[str]) -> str:
    """CTEs ending in ``feats``: z-scores added, rows with too few features dropped."""
    scores = ", ".join(f"{z(c)} as {c}_z" for c in z_columns)
    all_features = plain + [f"{c}_z" for c in z_columns]
    present = " + ".join(f"(({c}) is not null)::int" for c in all_features)
    return (f"scored as (select *, {scores} from {source} {windows(252)}), "
            f"feats as (select * from scored where {present} >= {int(len(all_features) * 0.8)})")


FEATURES = f"with recursive {RAW_CHAIN}, {MACRO_CHAIN}, {joined_by_date('raw')}, " + feature_table(
    "joined", BASE_Z + MACRO_Z, RAW_FEATURES + MACRO_JOINED)
FEATURES_PLAIN = f"with recursive {RAW_CHAIN}, " + feature_table("raw", BASE_Z, RAW_FEATURES)
FEATURES_OPTIONS = (
    f"with recursive {RAW_CHAIN}, {MACRO_CHAIN}, {joined_by_date('raw')}, {FLAG_CHAIN}, {TOP}, {PUT_CALL}, {SKEW}, "
    f"{GEX}, {OPTIONS}, optioned as (select * from joined left join opts using (ticker)), "
    + feature_table("optioned", BASE_Z + MACRO_Z + ["iv_skew_proxy", "gex_proxy"],
                    RAW_FEATURES + MACRO_JOINED + ["iv_skew_proxy", "put_call_ratio", "gex_proxy"]))
MODEL_FEATURES = sorted([f"{c}_z" for c in BASE_Z + MACRO_Z] + [
    "rsi_norm", "tsi", "rv_ratio", "trend_r", "yc_inverted", "vix_zscore", "hy_spread_zscore"])
HMM_FEATURES = ["rv_21d_zscore", "rv_ratio", "rsi_norm", "tsi", "trend_r", "vix_zscore", "hy_spread_zscore",
                "mom_21d", "atr_pct", "yield_curve_slope"]
SEQUENCE_FEATURES = ["rv_5d_z", "rv_21d_z", "rv_63d_z", "atr_pct_z", "mom_5d_z", "mom_21d_z", "mom_63d_z",
                     "yc_inverted"]


def over_bars(select: str, *ctes: str, source: str = "bars") -> str:
    return f"with {', '.join([BARS, *ctes])} select {select} from {source}"


def smoothed(*names: str, digits: int = 6) -> str:
    return f"with recursive {RAW_CHAIN} select ticker, time, {rs(*names, digits=digits)} from raw"


TRANSITIONS = (f"with {SIGNALS}, {MOVES} select ticker, time, regime, prev_regime::double as prev_regime, "
               "coalesce(prev_regime <> regime, false) as changed from moves")
DAILY = """select date_trunc('day', time)::timestamp as bucket, ticker, {open} as open, {high} as high, {low} as low,
    {close} as close, {volume} as volume from ticks {where} group by 1, 2"""


def daily(where: str = "", volume: str = "cast(sum(volume) as bigint)") -> str:
    return DAILY.format(
        open="arg_min(open, time)", high="max(high)", low="min(low)", close="arg_max(close, time)",
        volume=volume, where=where)


UPSERTED_BARS = f"""with {BARS}, {STORED}, {INCOMING}
    select coalesce(i.time, s.time) as time, coalesce(i.ticker, s.ticker) as ticker,
        {", ".join(r(f"case when i.time is not null then i.{c} else s.{c} end", c) for c in PRICES + ["vwap"])},
        case when i.time is not null then i.volume else s.volume end as volume,
        coalesce(s.source, i.source) as source
    from stored s full join incoming i on s.time = i.time and s.ticker = i.ticker"""
RECENT_LIVE = """live as (
    select time, ticker, close * 3 as close, 'live' as origin from bars where time >= timestamp '2001-10-20')"""
BUCKETS = [0.1, 0.5, 1.0, 5.0, 10.0, 30.0]
P95 = "30.0"
for _i in reversed(range(len(BUCKETS))):
    _low, _below = (BUCKETS[_i - 1], f"c{_i - 1}") if _i else (0.0, "0")
    P95 = (f"case when c{_i} >= n * 0.95::double then {_low} + ({BUCKETS[_i]} - {_low}) * (n * 0.95::double - {_below})"
           f" / (c{_i} - {_below})::double else {P95} end")
TICKER_RULES = [
    ("open_positive", "open > 0"), ("high_positive", "high > 0"), ("low_positive", "low > 0"),
    ("close_positive", "close > 0"), ("volume_not_negative", "volume >= 0"),
    ("high_not_below_low", "high >= low"), ("known_source", "source in ('yfinance', 'polygon')")]

ORACLES: dict[str, str] = {
    # A
    "scan_bars": f"""
        select time, ticker, {rs(*PRICES)}, volume from (
            select l_shipdate as time, l_returnflag as ticker, px as open, px * 1.01 as high, px * 0.99 as low,
                   case when l_quantity <> 13 then px * 1.005 end as close, cast(l_quantity as bigint) as volume
            from (select *, l_extendedprice / l_quantity as px from lineitem)
            qualify row_number() over (partition by l_returnflag, l_shipdate order by
                {", ".join(t + " desc" for t in TIES.split(", "))}) = 1)
        where close is not null""",
    "landed_files": """with p as (
            select l_shipdate as time, l_returnflag as flag, l_orderkey * 10 + l_linenumber as n, l_quantity from lineitem
        ), k as (select p.*, kind from p, (values ('csv'), ('json')) k(kind))
        select kind, lower(flag) as ticker, time, count(*) as n_rows, count(*) filter (where l_quantity <> 13) as n_closed,
               sum(l_quantity) + 0.0 as volume
        from k where n % 11 <> 0 and (kind = 'json' or n % 13 <> 0) group by 1, 2, 3
        union all
        select kind, null, null, count(*), count(*), sum(length(case kind when 'csv' then 'bad,' || n || ',1,x' else '{"n": ' || n end)) + 0.0
        from k where n % 11 = 0 group by 1""",
    "scan_universe": f"""with {BARS}
        select u.ticker, time, {r('close')}, volume::double as volume
        from (values ('A'), ('N'), ('R'), ('ZZZ')) u(ticker) left join bars using (ticker)""",
    "parse_macro_observations": f"""
        select o_orderdate as time, {SERIES} as series_id, {r('o_totalprice', 'value')}, 'fred' as source
        from orders where o_orderstatus <> 'F'
        union all
        select o_orderdate + interval 1 day, {SERIES}, o_orderkey::double, 'fred'
        from orders where o_orderstatus <> 'O' and o_custkey % 2 <> 0""",
    "scan_macro_series": f"""with {MACRO} select time, series_id, {r('value')}, seq from macro
        where series_id in ('VIXCLS', 'DGS10', 'DFF')
          and time between timestamp '1996-01-01' and timestamp '1998-12-31'""",
    "nearest_expiry_chain": f"""with {CHAIN}
        select ticker, expiry, option_type, {r('strike')}, l_orderkey, {r('l_extendedprice')} from chain
        qualify expiry = min(expiry) over (partition by ticker)""",
    "clean_options_chain": f"""with {CHAIN}
        select ticker, option_type, {rs('strike', 'implied_volatility')},
               coalesce(open_interest, 0) as open_interest, coalesce(volume, 0) as volume, l_orderkey
        from chain where implied_volatility > 0 and strike > 0""",
    "validate_records": f"""with {BARS}, {STORED}, dirty as (
            select time, ticker, open, case when volume % 5 = 0 then low / 2 else high end as high, low,
                   case when volume % 7 = 0 then 0 else close end as close, volume - 20 as volume, source from stored)
        select time, ticker, array_to_string(list_filter([
            {", ".join(f"case when not ({ok}) then '{name}' end" for name, ok in TICKER_RULES)}
            ], lambda x: x is not null), ',') as failed from dirty""",
    "validation_figures": f"""with {BARS}, {STORED}, dirty as (
            select open, case when volume % 5 = 0 then low / 2 else high end as high, low,
                   case when volume % 7 = 0 then 0 else close end as close, volume - 20 as volume,
                   case when volume % 11 = 0 then 'other' else source end as source from stored),
        judged as (select *, {" and ".join(f"({ok})" for _, ok in TICKER_RULES)} as good from dirty)
        select unnest(['rows', 'clean_rows', 'read_clean', 'read_quarantined', {", ".join(f"'{name}'" for name, _ in TICKER_RULES)}]) as name,
               unnest([count(*), count(*) filter (good), count(*) filter (good), count(*) filter (not good),
                       {", ".join(f"count(*) filter (not ({ok}))" for _, ok in TICKER_RULES)}]) as n from judged""",
    "landing_quarantine": f"""with {BARS}, {STORED}, {MACRO}, {MACRO_TABLE}, {CHAIN}, b as (
            select ticker, case when volume % 3 = 0 then -open else open end as open,
                   case when volume % 5 = 0 then low / 2 else high end as high, low, close, volume - 20 as volume,
                   case when volume % 11 = 0 then 'other' else source end as source from stored),
        m as (select series_id as ticker, case when value < 0 then null else value end as value,
                     case when value > 20 then 'other' else source end as source from macro_table),
        o as (select upper(trim(ticker)) as ticker, case when open_interest % 3 = 0 then -strike else strike end as strike,
                     case when volume % 7 = 0 then 'straddle' else option_type end as option_type,
                     implied_volatility - 0.02 as iv, open_interest, volume from chain),
        f as (
            select 'bars' as kind, ticker, concat_ws(',', case when not coalesce(open > 0, false) then 'open_positive' end,
                case when not coalesce(high > 0, false) then 'high_positive' end,
                case when not coalesce(low > 0, false) then 'low_positive' end,
                case when not coalesce(close > 0, false) then 'close_positive' end,
                case when not coalesce(volume >= 0, false) then 'volume_not_negative' end,
                case when not coalesce(high >= low, false) then 'high_not_below_low' end,
                case when source not in ('yfinance', 'polygon') then 'known_source' end) as failed from b
            union all
            select 'macro', ticker, concat_ws(',', case when value is null then 'value_present' end,
                case when source not in ('fred', 'yfinance') then 'known_source' end) from m
            union all
            select 'options', ticker, concat_ws(',', case when not coalesce(strike > 0, false) then 'strike_positive' end,
                case when option_type not in ('call', 'put') then 'known_side' end,
                case when iv < 0 then 'implied_volatility_not_negative' end,
                case when open_interest < 0 then 'open_interest_not_negative' end,
                case when volume < 0 then 'volume_not_negative' end) from o)
        select kind, ticker, failed, count(*) as n from f where failed <> '' group by 1, 2, 3""",
    "envelope_dead_letters": """with m as (
            select event_id % 5 as k, case event_type when 'click' then 'ohlcv' when 'view' then 'ohlcv' when 'signup' then 'macro'
                       when 'purchase' then 'options' else 'other' end as topic from events)
        select topic, case when topic = 'other' then 'unknown topic' when k = 0 then 'unreadable' else 'no records' end as reason,
               count(*) as n from m where topic = 'other' or k < 2 group by 1, 2""",
    "explode_envelope": """
        select ts as time, 'U' || (user_id % 15) as ticker, value as open, value + 1 as close, event_id as volume
        from events where event_type in ('click', 'view')
        union all
        select ts, 'ALL', value * 3, value, event_id + 1
        from events where event_type in ('click', 'view')""",
    "feature_store_read": over_bars(f"ticker, time, {rs('open', 'close')}, volume") + """
        where ticker in ('A', 'R') and time between timestamp '1996-01-01' and timestamp '1999-12-31'""",
    "scan_one_partition": over_bars(f"ticker, time, {r('close')}") + " where ticker = 'N'",
    "list_tickers": "select distinct l_returnflag as ticker from lineitem",
    "ingest_window": f"""with {BARS}
        select kind, ticker, time from bars, (values ('eod', interval 5 day), ('weekly', interval 7 day),
            ('backfill', interval 2 year)) k(kind, span)
        where time between timestamp '1998-06-30' - span and timestamp '1998-06-30'""",
    "table_reads": over_bars(f"ticker, time, {r('close')}, volume") + """
        where ticker = 'A' and time >= timestamp '1997-01-01'""",
    # K
    "upsert_bars": UPSERTED_BARS,
    "upsert_macro": f"""with {MACRO}, {MACRO_TABLE},
        new as (select time + interval 30 day as time, series_id, value + 1 as value, 'yfinance' as source
                from macro_table)
        select coalesce(n.time, m.time) as time, coalesce(n.series_id, m.series_id) as series_id,
               {r('case when n.time is not null then n.value else m.value end', 'value')},
               coalesce(n.source, m.source) as source
        from macro_table m full join new n on m.time = n.time and m.series_id = n.series_id""",
    "append_signals": f"with {SIGNALS} select distinct ticker, 'latest' as model_version, 2::bigint as n from signals",
    "append_alerts": f"with {SIGNALS}, {MOVES}, {ALERTS} "
                     f"select id, time, ticker, alert_type, severity, read, {r('confidence')}, "
                     "from_regime::double as from_regime, to_regime_name from alerts",
    "feature_store_write": over_bars(
        f"ticker, time, {r('case when ticker = chr(65) then 1.0 else close end', 'close')}, volume"),
    "publish_envelope": f"""with {BARS}, n as (
            select *, (row_number() over (partition by ticker order by time) - 1) // 500 as batch from bars)
        select ticker, count(*) as record_count, count(*)::int as n_records, 'ohlcv' as data_type,
               {r('sum(close)', 'sum_close', 3)}, min(time) as first_time from n group by ticker, batch""",
    "publish_latest_features": over_bars(f"ticker, time, {r('close')}, volume") + """
        qualify row_number() over (partition by ticker order by time desc) = 1""",
    "publish_signal": f"with {SIGNALS}, {LATEST} select ticker, regime, regime_name, confidence from latest",
    "latest_signal_cache": f"""with {SIGNALS}
        select ticker, time, regime, {r('confidence')} from signals
        where time <= timestamp '2024-01-20 12:00:00' and time > timestamp '2024-01-20 11:00:00'
        qualify row_number() over (partition by ticker order by time desc) = 1""",
    "apply_retention": over_bars(f"ticker, time, {r('close')}") + """
        where time >= timestamp '1998-06-30' - interval 2 year""",
    # B
    "normalise_ticker": "select c_custkey, upper(trim(c_mktsegment)) as ticker from customer",
    "filter_isin": over_bars(f"ticker, time, {r('close')}") + " where ticker in ('A', 'R')",
    "filter_time_range": over_bars(f"ticker, time, {r('close')}") + """
        where time between timestamp '1996-02-01' and timestamp '1997-03-04'""",
    "dropna_subset": """select l_returnflag as ticker, l_shipdate as time, l_orderkey, l_linenumber from lineitem
        where l_quantity <> 13""",
    "min_non_null_rows": f"""with {BARS}, {NEAR}, {VOL}
        select ticker, time, {rs('rv_5d', 'rv_21d', 'rv_63d', 'mom_5d', 'mom_21d', 'mom_63d')} from vol
        where (rv_5d is not null)::int + (rv_21d is not null)::int + (rv_63d is not null)::int
            + (mom_5d is not null)::int + (mom_21d is not null)::int + (mom_63d is not null)::int >= 4""",
    "feature_columns": f"""with {BARS}, {NEAR}, {VOL}, {RATIO}
        select ticker, time, {rs('rv_5d', 'rv_21d', 'rv_63d', 'rv_ratio')} from ratio""",
    "model_feature_columns": f"{FEATURES} select ticker, time, {rs(*MODEL_FEATURES)} from feats",
    "numeric_columns": f"""with {BARS}, {NEAR}, {VOL}, {RATIO}
        select ticker, time, {rs(*PRICES, 'log_return', 'rv_5d', 'rv_21d', 'rv_63d')}, volume from ratio""",
    "recode_series": f"with {MACRO}, {NAMED} select time, seq, name, {r('value')} from named",
    "pad_missing_columns": f"""with {MACRO}, {NAMED}
        select time, {r("max_by(value, seq) filter (where name = 'vix')", 'vix')},
               null::double as yield_curve_slope, null::double as hy_spread, null::double as rate_10y,
               {r("max_by(value, seq) filter (where name = 'rate_2y')", 'rate_2y')}
        from named where series_id in ('VIXCLS', 'DGS2') group by time""",
    "unread_alerts": f"""with {SIGNALS}, {MOVES}, {ALERTS}
        select id, time, ticker, alert_type from alerts where severity <> 1""",
    # C
    "join_macro_date_ffill": f"with {BARS}, {MACRO_CHAIN}, {joined_by_date('bars')} "
                             f"select ticker, time, {rs(*MACRO_JOINED)} from joined",
    "join_macro_asof": f"with {BARS}, {MACRO_CHAIN} select b.ticker, b.time, "
                       + ", ".join(r(f"m.{c}", c) for c in MACRO_JOINED)
                       + " from bars b asof left join macro_features m on b.time >= m.time",
    "join_macro_asof_time": "with " + BAR_SIGNALS + ", " + MACRO_CHAIN.replace(
        "o_orderdate as time", "o_orderdate + to_hours(o_orderkey * 5 % 24) as time", 1) + " select b.ticker, b.time, b.seq, "
        + ", ".join(r(f"m.{c}", c) for c in MACRO_JOINED) + " from bar_signals b asof left join macro_features m on b.time >= m.time",
    "join_options_metrics": f"""with {BARS}, {FLAG_CHAIN}, {TOP}, {PUT_CALL}, {SKEW}, {GEX}, {OPTIONS}
        select ticker, time, {rs('close', 'iv_skew_proxy', 'put_call_ratio', 'gex_proxy')}
        from bars left join opts using (ticker)""",
    "stitch_history": f"""with {BARS}, {RECENT_LIVE}, past as (
            select ticker, time, close from bars
            qualify row_number() over (partition by ticker order by time desc) <= 70)
        select coalesce(l.ticker, p.ticker) as ticker, coalesce(l.time, p.time) as time,
               {r('coalesce(l.close, p.close)', 'close')}, l.origin
        from past p full join live l on p.ticker = l.ticker and p.time = l.time""",
    "bars_with_regime": f"""with {BARS}, {BAR_SIGNALS}, by_day as (
            select ticker, time::date as day, arg_max(regime, (time, seq))::int as regime from bar_signals group by 1, 2)
        select b.ticker, b.time, {r('close')}, d.regime::double as regime from bars b
        left join by_day d on d.ticker = b.ticker and d.day = b.time::date""",
    "bucketed_regimes": f"""with {BARS}, {BAR_SIGNALS}, by_day as (
            select ticker, time::date as day, arg_max(regime, (time, seq))::int as regime from bar_signals group by 1, 2)
        select b.ticker, b.time, {r('close')}, d.regime::double as regime from bars b
        left join by_day d on d.ticker = b.ticker and d.day = b.time::date""",
    # D
    "pivot_macro": f"with {MACRO}, {NAMED}, {WIDE} select time, {rs(*MACRO_COLUMNS)} from wide",
    "bars_daily": f"with {TICKS} {daily()}",
    "bars_daily_refresh": f"""with {TICKS}
        {daily("where time >= '2024-01-14' and time < '2024-01-20'")}
        union all
        {daily("where not (time >= '2024-01-14' and time < '2024-01-20')", "(-1)::bigint")}""",
    "put_call_ratio": f"with {CHAIN}, {PUT_CALL} select * from pcr",
    "iv_skew_proxy": f"with {CHAIN}, {TOP}, {SKEW} select ticker, {r('iv_skew_proxy')} from skew",
    "gex_proxy": f"with {CHAIN}, {GEX} select * from gex",
    "ticker_date_range": over_bars("ticker, min(time) as first_time, max(time) as last_time") + " group by 1",
    "regime_counts": f"""with {SIGNALS}, {LATEST}
        select name as regime_name, count(ticker) as n
        from (values (0, 'trending'), (1, 'mean_reverting'), (2, 'choppy'), (3, 'high_vol')) k(regime, name)
        left join latest using (regime) group by 1""",
    "period_stats": f"""with {BARS}, last_bars as (
            select * from bars qualify row_number() over (partition by ticker order by time desc) <= 252)
        select ticker, {r('arg_max(close, time)', 'last_close')}, {r('max(high)', 'max_high')},
               {r('(arg_max(close, time) - arg_min(close, time)) / arg_min(close, time)', 'change')}
        from last_bars group by 1""",
    "macro_term_slope": f"""with {MACRO}, {MACRO_TABLE}, recent as (
            select * from macro_table qualify row_number() over (partition by series_id order by time desc) <= 20)
        select series_id, round((arg_max(value, time) - arg_min(value, time)) / count(*), 4) as slope
        from recent group by 1""",
    "time_split": """with t as (select distinct l_shipdate as time from lineitem),
        n as (select time, row_number() over (order by time) - 1 as i, count(*) over () as n from t)
        select time as split_time from n where i = floor(n * 0.8::double)""",
    "counter_rate_per_min": """select date_trunc('minute', ts)::timestamp as minute, event_type, count(*) as n,
        round(sum(value), 6) as total
        from events group by 1, 2""",
    "duration_p95": f"""with c as (
            select time_bucket(interval 5 minute, ts) as start, event_type, count(*) as n,
                {", ".join(f"count(*) filter (where value <= {b}) as c{i}" for i, b in enumerate(BUCKETS))}
            from events group by 1, 2)
        select start::timestamp as start, event_type, {r(P95, 'p95')} from c""",
    "status_totals": """select event_type, count(*) as total,
        count(*) filter (where event_type <> 'error') as successes,
        count(*) filter (where event_type = 'error') as errors from events group by 1""",
    "state_means": f"""with {PROBS}
        select s::bigint as state, {", ".join(r(f"sum(hmm_prob[s + 1] * seq_prob[{i + 1}]) / sum(hmm_prob[s + 1])", f"x{i}")
                                      for i in range(4))}
        from probs, range(4) k(s) group by 1""",
    # E
    "rolling_mean": over_bars(f"ticker, time, {r(full('avg', 'close', 21), 'mean_21')}") + f" {windows(21)}",
    "rolling_std": over_bars(f"ticker, time, {r(full('stddev_samp', 'close', 21), 'std_21')}") + f" {windows(21)}",
    # In e, y is the mean so far and old its weight: (1 - alpha) for each row since, against alpha for a new value.
    "ewm_mean": f"""with recursive {BARS}, n as (
            select *, case when volume % 4 = 0 then null else close end as gappy,
                   row_number() over (partition by ticker order by time) as i from bars),
        e as (select ticker, time, i, close as num, 1.0::double as den, close as y, close as h, close as s, close as l,
                     gappy, gappy as g, 1.0::double as old, coalesce(gappy, 0) as gnum, (gappy is not null)::int::double as gden
              from n where i = 1
              union all
              select n.ticker, n.time, n.i, e.num * 13 / 15 + n.close, e.den * 13 / 15 + 1, e.y * 13 / 15 + n.close * 2 / 15,
                     e.h * 0.5 + n.close * 0.5, e.s * 0.1 + n.close * 0.9, e.l * 0.99 + n.close * 0.01, n.gappy,
                     case when n.gappy is null then e.g when e.g is null then n.gappy
                          else (e.old * 13 / 15 * e.g + n.gappy * 2 / 15) / (e.old * 13 / 15 + 2.0 / 15) end,
                     case when n.gappy is null then e.old * 13 / 15 else 1 end,
                     e.gnum * 13 / 15 + coalesce(n.gappy, 0), e.gden * 13 / 15 + (n.gappy is not null)::int
              from e join n on n.ticker = e.ticker and n.i = e.i + 1)
        select ticker, time, {r('num / den', 'ewm_adjusted', 4)}, {r('y', 'ewm_recursive', 4)}, {r('h', 'ewm_half', 4)},
               {r('s', 'ewm_short', 4)}, {r('l', 'ewm_long', 4)},
               {r('case when gappy is not null then g end', 'ewm_gaps', 4)},
               {r('case when gappy is not null then gnum / gden end', 'ewm_gaps_adjusted', 4)} from e""",
    "diff": over_bars(f"ticker, time, {r('close - lag(close) over (partition by ticker order by time)', 'move')}"),
    "shift": over_bars(f"ticker, time, {r('lag(close, 21) over (partition by ticker order by time)', 'close_before')}"),
    "forward_fill": over_bars("ticker, time, " + r(
        "last_value(case when volume % 3 = 0 then close end ignore nulls) over "
        "(partition by ticker order by time rows unbounded preceding)", "seen")),
    "log_return": over_bars(f"ticker, time, {r('log_return')}", NEAR, source="near"),
    "realized_vol": over_bars(f"ticker, time, {rs('rv_5d', 'rv_21d', 'rv_63d')}", NEAR, VOL, source="vol"),
    "vol_ratio": over_bars(f"ticker, time, {r('rv_ratio')}", NEAR, VOL, RATIO, source="ratio"),
    "atr": smoothed("atr_14", "atr_pct", digits=4),
    "rv_zscore": smoothed("rv_21d_zscore"),
    "rsi": smoothed("rsi_14", "rsi_norm"),
    "tsi": smoothed("tsi", "tsi_signal"),
    "momentum": over_bars(f"ticker, time, {rs('mom_5d', 'mom_21d', 'mom_63d')}", NEAR, source="near"),
    "trend_strength": over_bars(f"ticker, time, {r('trend_r')}", NEAR, VOL, source="vol"),
    "macro_term_change": f"with {MACRO_CHAIN} select time, {rs('vix', 'vix_term_slope')} from macro_features",
    "macro_zscores": f"with {MACRO_CHAIN} select time, {rs('vix_zscore', 'hy_spread_zscore')} from macro_features",
    "yield_inversion_flag": f"with {MACRO_CHAIN} select time, {rs('yield_curve_slope', 'yc_inverted')} from macro_features",
    "rolling_zscores": over_bars("ticker, time, " + ", ".join(
        r(z(c), f"{c}_z") for c in PRICES + ["volume"])) + f" {windows(252)}",
    "latest_n_per_ticker": over_bars(f"ticker, time, {r('close')}") + """
        qualify row_number() over (partition by ticker order by time desc) <= 60""",
    "dedupe_keep_last": f"""select l_returnflag as ticker, l_shipdate as time, {r('l_extendedprice / l_quantity', 'Open')}
        from lineitem qualify row_number() over (partition by l_returnflag, l_shipdate order by
            {", ".join(t + " desc" for t in TIES.split(", "))}) = 1""",
    "row_index": over_bars("ticker, time, row_number() over (partition by ticker order by time) - 1 as row_idx"),
    "row_index_by_range": f"""with t as (
            select event_type as ticker, date_trunc('minute', ts) as time, event_id as seq,
                   case when event_id % 7 = 3 then value end as price from events)
        select ticker, time, seq, row_number() over w - 1 as row_idx,
               {r('last_value(price ignore nulls) over (w rows unbounded preceding)', 'price')}
        from t window w as (partition by ticker order by time, seq)""",
    "hmm_decode_given": f"""with recursive {BARS}, o as (
            select ticker, time, ln(close / open) as x, row_number() over (partition by ticker order by time) as i,
                   count(*) over (partition by ticker) as n from bars
        ), e as materialized (
            select *, exp(-0.5 * (x - 0.1) ** 2 / 0.05) / sqrt(2 * pi() * 0.05) as e1,
                   exp(-0.5 * (x + 0.1) ** 2 / 0.3) / sqrt(2 * pi() * 0.3) as e2 from o
        ), f as (
            select ticker, i, 0.6 * e1 / (0.6 * e1 + 0.4 * e2) as a1, 0.4 * e2 / (0.6 * e1 + 0.4 * e2) as a2 from e where i = 1
            union all
            select ticker, i, u1 / (u1 + u2), u2 / (u1 + u2) from (
                select e.ticker, e.i, (a1 * 0.9 + a2 * 0.2) * e1 as u1, (a1 * 0.1 + a2 * 0.8) * e2 as u2
                from f join e on e.ticker = f.ticker and e.i = f.i + 1)
        ), g as (
            select ticker, i, 1::double as b1, 1::double as b2 from e where i = n
            union all
            select ticker, i - 1, w1 / (w1 + w2), w2 / (w1 + w2) from (
                select e.ticker, e.i, 0.9 * e1 * b1 + 0.1 * e2 * b2 as w1, 0.2 * e1 * b1 + 0.8 * e2 * b2 as w2
                from g join e on e.ticker = g.ticker and e.i = g.i where e.i > 1)
        ), v as (
            select ticker, i, ln(0.6) + ln(e1) as d1, ln(0.4) + ln(e2) as d2, 0 as p1, 0 as p2 from e where i = 1
            union all
            select e.ticker, e.i, greatest(d1 + ln(0.9), d2 + ln(0.2)) + ln(e1), greatest(d1 + ln(0.1), d2 + ln(0.8)) + ln(e2),
                   if(d1 + ln(0.9) >= d2 + ln(0.2), 1, 2), if(d1 + ln(0.1) >= d2 + ln(0.8), 1, 2)
            from v join e on e.ticker = v.ticker and e.i = v.i + 1
        ), s as (
            select v.ticker, v.i, if(d1 >= d2, 1, 2) as st from v join e on e.ticker = v.ticker and e.i = v.i where e.i = e.n
            union all
            select v.ticker, v.i - 1, if(st = 1, p1, p2) from s join v on v.ticker = s.ticker and v.i = s.i where s.i > 1
        ), p as (
            select e.ticker, e.time, if(st = 1, 1, 0)::int as label, a2 * b2 / (a1 * b1 + a2 * b2) as p0, a1 * b1 / (a1 * b1 + a2 * b2) as p1
            from e join f using (ticker, i) join g using (ticker, i) join s using (ticker, i)
        )
        select ticker, time, label, {r('p0')}, {r('p1')}, {r('greatest(p0, p1)', 'confidence')} from p""",
    "regime_transitions": TRANSITIONS,
    "sliding_sequences": f"""with {BARS}, {NEAR}
        select ticker, time, 60::bigint as n_rows, 120::bigint as n_values,
               {r('sum(coalesce(log_return, 0) + volume) over f', 'total')},
               {r('lag(coalesce(log_return, 0)) over w', 'newest')}
        from near window w as (partition by ticker order by time),
            f as (partition by ticker order by time rows between 60 preceding and 1 preceding)
        qualify count(*) over f = 60""",
    "all_features": f"{FEATURES} select time, ticker, volume, "
                    + rs(*PRICES, "log_return", *RAW_FEATURES, *MACRO_JOINED,
                         *[f"{c}_z" for c in BASE_Z + MACRO_Z], digits=4) + " from feats",
    "all_features_without_macro": f"{FEATURES_PLAIN} select time, ticker, volume, "
                                  + rs(*PRICES, "log_return", *RAW_FEATURES,
                                       *[f"{c}_z" for c in BASE_Z], digits=4) + " from feats",
    "all_features_with_options": f"{FEATURES_OPTIONS} select ticker, time, "
                                 + rs("gex_proxy", "put_call_ratio", "iv_skew_proxy", "gex_proxy_z", "iv_skew_proxy_z",
                                      "close_z", "vix_z", digits=4) + " from feats",
    # F, G
    "sort_ticker_time": over_bars(f"ticker, time, {r('close')}") + " order by ticker, time",
    "recent_bars": over_bars(f"ticker, time, {rs('open', 'close')}, volume") + """
        where ticker = 'R' order by time desc limit 252""",
    "regime_history": f"""with {SIGNALS} select ticker, time, regime, {r('confidence')} from signals
        where ticker = 'U7' order by time desc limit 100""",
    "recent_alerts": f"""with {SIGNALS}, {MOVES}, {ALERTS}
        select id, time, ticker, alert_type, severity from alerts order by time desc, id limit 50""",
    "top_k_by_strike": f"""with {CHAIN}, {TOP}
        select ticker, option_type, rank, {rs('strike', 'implied_volatility')}, l_orderkey from top""",
    "regime_board": f"with {SIGNALS}, {LATEST} select ticker, time, regime, regime_name from latest order by regime, ticker",
    "union_calls_puts": f"with {CHAIN} select ticker, option_type, {r('strike')}, l_orderkey from chain",
    "union_history_live": f"""with {BARS}, {RECENT_LIVE}
        select b.ticker, b.time, {r('coalesce(l.close, b.close)', 'close')}, l.origin
        from bars b left join live l on b.ticker = l.ticker and b.time = l.time""",
    "distinct_times": "select distinct l_shipdate as time from lineitem",
    "distinct_tickers": f"with {SIGNALS} select distinct ticker from signals",
    # H
    "math": f"""select o_orderkey, {r('ln(o_totalprice)', 'ln')}, {r('sqrt(o_totalprice)', 'root')},
        {r('abs(o_totalprice - 200000)', 'size')}, {r('pow(o_totalprice / 1000, 2)', 'square')},
        {r('round(o_totalprice / 7, 4)', 'rounded')}, {r('o_totalprice / 3', 'third')} from orders""",
    "clip": f"""select event_id, {r('case when x is not null then least(greatest(x, 10), 50) end', 'both')},
        {r('case when x is not null then greatest(x, 20) end', 'low')},
        {r('case when x is not null then least(x, 30) end', 'high')}
        from (select event_id, case when event_type <> 'error' then value end as x from events)""",
    "max_horizontal": over_bars(f"ticker, time, {r('greatest(open, close, vwap)', 'top')}", STORED, source="stored"),
    "sum_horizontal": over_bars("ticker, time, (2 + (vwap is not null)::int)::bigint as present", STORED, source="stored"),
    "cast_types": f"""select o_orderkey, cast(trunc(o_totalprice) as bigint) as whole,
        {r('try_cast(o_orderpriority[1:1] as double)', 'digit')}, try_cast(o_orderpriority as double) as broken,
        {r("(o_orderstatus = 'F')::int::double", 'flag')} from orders""",
    "datetime": """select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day, strptime(strftime(o_orderdate, '%Y-%m-%d'), '%Y-%m-%d')
        as parsed, date_diff('day', o_orderdate::date, date '1998-06-30')::bigint as age from orders""",
    "strings": """select c_custkey, upper(c_name) as upper, upper(c_mktsegment[1:1]) || lower(c_mktsegment[2:]) as title,
        upper(c_mktsegment) || '|SPY' as parts, replace(c_name, 'Customer#', '') as number,
        'mean-reverting' as dashed from customer""",
    "json": """select event_id, (props::json->>'k')::bigint as k, event_type as back from events""",
    "prob_vector": f"""with {PROBS}, {MIX} select vec_id, list_position(m, list_max(m))::bigint - 1 as best,
        {r('list_max(m)', 'largest')}, {r('m[3]', 'p0')}, {r('m[1]', 'p1')}, {r('m[4]', 'p2')}, {r('m[2]', 'p3')} from mix""",
    "softmax": f"""with {PROBS}, e as (select vec_id, list_transform(logits, lambda x: exp(x)) as e from probs)
        select vec_id, {", ".join(r(f"e[{i + 1}] / list_sum(e)", f"s{i}") for i in range(4))} from e""",
    "format_pct": f"with {SIGNALS} select ticker, time, printf('%.1f%%', confidence * 100) as text from signals",
    # I
    "stream_route": f"""select case event_type when 'click' then 'ohlcv' when 'signup' then 'macro' else 'options' end as topic,
        count(*) as n, {r('sum(value)', 'amount', 3)} from events
        where event_type in ('click', 'signup', 'purchase') group by 1""",
    "macro_cache": f"""select o_orderdate as time, o_orderpriority as series_id,
        {r('arg_max(o_totalprice, o_orderkey)', 'value')}, max(o_orderkey) as seq from orders group by 1, 2""",
    "options_latest_state": f"""select 'U' || (user_id % 15) as ticker, {r('arg_max(value, ts)', 'iv_skew_proxy')},
        {r('arg_max(value, ts) / 2', 'put_call_ratio')}, {r('arg_max(value, ts) * 2', 'gex_proxy')}, max(ts) as time
        from events group by 1""",
    "stream_regime_shift": TRANSITIONS,
    "alert_rules": f"with {SIGNALS}, {MOVES}, {ALERTS} "
                   "select * replace (from_regime::double as from_regime) from alerts",
    "feature_alerts": f"""with {BARS}, {NEAR}, {VOL}, {RATIO}, g as (
            select *, lag(close - open) over (partition by ticker order by time) as before from ratio)
        select ticker, time, 'VOL_SPIKE' as alert_type, 2 as severity from g where rv_ratio > 1.5
        union all
        select ticker, time, 'GEX_FLIP', 2 from g where (close - open) * before < 0""",
    "start_offsets": "select count(*) as n, min(ts) as first, max(ts) as last from events",
    # Macro rows of the stream's table are unique, so the last value of a date is the only one.
    "stream_feature_batches": FEATURES.replace("max_by(value, seq)", "max(value)")
                              + " select ticker, time, " + rs("close", "rsi_14", "vix", "close_z") + " from feats",
    # The last to arrive wins, a correction over what it corrects, but the first source stays.
    "late_data_upsert": f"""with {BARS}, {STORED}, {INCOMING}, fixed as (
            select * replace (case when day(time) % 4 = 0 then close / 4 else close end as close) from incoming)
        select coalesce(i.time, s.time) as time, coalesce(i.ticker, s.ticker) as ticker,
               coalesce(i.open, s.open) as open, coalesce(i.high, s.high) as high, coalesce(i.low, s.low) as low,
               coalesce(i.close, s.close) as close, coalesce(i.volume, s.volume) as volume,
               case when i.time is null then s.vwap else i.vwap end as vwap, coalesce(s.source, i.source) as source
        from stored s full join (select * from fixed qualify row_number() over (partition by ticker, time order by source) = 1) i
          on i.ticker = s.ticker and i.time = s.time""",
    "snapshot_plus_updates": f"with {SIGNALS}, {LATEST} select ticker, time, regime, {r('confidence')} from latest",
    "tumbling_bars": f"with {TICKS} {daily()}",
    # A batch takes eight days of arrivals; what ends two days before the times of earlier batches is late.
    "late_rows": f"""with {TICKS.replace("from events", ", ((ts::date - date '2024-01-01') + case when event_id % 7 = 0 then 10 else 0 end) // 8 as part from events")},
        ends as (select *, date_trunc('day', time)::timestamp as bucket from ticks),
        seen as (select part, max(max(time)) over (order by part) as mark from ends group by part),
        judged as (select e.*, coalesce(bucket + interval 1 day <= b.mark - interval 2 day, false) as late
                   from ends e asof left join seen b on e.part > b.part),
        last as (select max(time) - interval 2 day as mark from ends)
        select bucket, ticker, case when late then 'late' when bucket + interval 1 day <= (select mark from last) then 'final'
                   else 'open' end as state, count(*) as n,
               case when not late then arg_min(open, (time, open)) end as open, case when not late then max(high) end as high,
               case when not late then min(low) end as low, case when not late then arg_max(close, (time, close)) end as close,
               case when not late then sum(volume)::bigint end as volume
        from judged group by bucket, ticker, late""",
    # A session ends an hour after its last signal; the watermark counts whole milliseconds.
    "signal_expiries": f"""with {SIGNALS}, gaps as (
            select *, coalesce(time - lag(time) over (partition by ticker order by time) > interval 3600 second, true)::int as fresh
            from signals),
        runs as (select *, sum(fresh) over (partition by ticker order by time rows unbounded preceding) as run from gaps)
        select ticker, arg_max(regime, (time, regime)) as regime, count(*) as n_signals, max(time) as time,
               min(time) as live_from, max(time) + interval 3600 second as expired_at
        from runs group by ticker, run
        having max(time) + interval 3600 second <=
               (select date_trunc('millisecond', max(time)) - interval 10 minute from signals)""",
    "signal_ttl": f"""with {SIGNALS}, {LATEST} select ticker, time, regime from latest
        where time > timestamp '2024-01-30 23:59:59' - interval 3600 second""",
    # M
    "prepare_training": f"{FEATURES} select ticker, time, {rs(*HMM_FEATURES, digits=4)} from feats where "
                        + " and ".join(f"{c} is not null" for c in HMM_FEATURES + SEQUENCE_FEATURES),
    "label_states": f"""{FEATURES}, {BAR_SIGNALS}, by_day as (
            select ticker, time::date as day, arg_max(regime, (time, seq))::int as state from bar_signals group by 1, 2),
        m as (select state, avg(rv_21d_zscore) + avg(vix_zscore) as vol, avg(trend_r) as trend,
                     abs(avg(tsi) + avg(mom_21d)) as mom
              from feats f join by_day d on d.ticker = f.ticker and d.day = f.time::date group by 1),
        a as (select *, row_number() over (order by vol desc, state desc) = 1 as high from m),
        b as (select *, not high and row_number() over (partition by high order by trend desc, state) = 1 as trending from a),
        c as (select *, not high and not trending
                  and row_number() over (partition by high or trending order by mom desc, state) = 1 as reverting from b)
        select state, case when high then 3 when trending then 0 when reverting then 1 else 2 end as regime from c""",
    "ensemble_predict": f"""with {PROBS}, {MIX}, best as (
            select *, list_position(m, list_max(m))::bigint - 1 as regime from mix)
        select vec_id, regime, ['trending', 'mean_reverting', 'choppy', 'high_vol'][regime + 1] as regime_name,
               {r('round(list_max(m), 4)', 'confidence')}, {", ".join(r(f"round(m[{i + 1}], 4)", f"p{i}") for i in range(4))}
        from best""",
}
