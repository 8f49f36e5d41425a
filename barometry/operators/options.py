"""Options chains: nearest expiry, cleaning and per-ticker metrics."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

REQUIRED = ["strike", "last_price", "implied_volatility", "open_interest", "volume"]
SKEW_STRIKES = 5


def nearest_expiry_chain(chain: DataFrame) -> DataFrame:
    """Keep the rows of the first expiry of each ticker."""
    nearest = chain.groupBy("ticker").agg(F.min("expiry").alias("expiry"))
    return chain.join(nearest, ["ticker", "expiry"], "left_semi")


def union_calls_puts(calls: DataFrame, puts: DataFrame) -> DataFrame:
    """Both sides of a chain in one frame, tagged with their side."""
    return calls.withColumn("option_type", F.lit("call")).unionByName(
        puts.withColumn("option_type", F.lit("put")))


def clean_options_chain(chain: DataFrame) -> DataFrame:
    """Rows with positive implied volatility and strike; missing counts become 0.

    A chain without one of the required columns yields no rows.
    """
    if not set(REQUIRED) <= set(chain.columns):
        return chain.limit(0)
    kept = chain.filter((F.col("implied_volatility") > 0) & (F.col("strike") > 0))
    return kept.withColumns({
        c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in ("open_interest", "volume")})


def _side(option_type: str, value: Column) -> Column:
    return F.sum(F.when(F.col("option_type") == option_type, value))


def put_call_ratio(chain: DataFrame) -> DataFrame:
    """Open interest of puts over calls per ticker, null where calls have none."""
    puts = F.coalesce(_side("put", F.col("open_interest")), F.lit(0))
    calls = F.coalesce(_side("call", F.col("open_interest")), F.lit(0))
    return chain.groupBy("ticker").agg(
        F.when(calls > 0, F.round(F.try_divide(puts.cast("double"), calls.cast("double")), 4))
        .alias("put_call_ratio"))


def top_k_by_strike(chain: DataFrame, tie_break: Sequence[str], k: int = SKEW_STRIKES) -> DataFrame:
    """The ``k`` lowest-strike puts and ``k`` highest-strike calls per ticker, ranked in ``_rank``.

    Ties keep the input order named by ``tie_break``: first rows at the low end, last at the high end.
    """
    priced = chain.filter(F.col("implied_volatility") > 0)
    ends = []
    for side, strike, ties in (
        ("put", F.col("strike").asc(), [F.col(c).asc() for c in tie_break]),
        ("call", F.col("strike").desc(), [F.col(c).desc() for c in tie_break]),
    ):
        ranked = Window.partitionBy("ticker").orderBy(strike, *ties)
        ends.append(
            priced.filter(F.col("option_type") == side)
            .withColumn("_rank", F.row_number().over(ranked)).filter(F.col("_rank") <= k))
    return ends[0].unionByName(ends[1])


def iv_skew_proxy(chain: DataFrame, tie_break: Sequence[str]) -> DataFrame:
    """Mean volatility of the lowest-strike puts minus that of the highest-strike calls."""
    iv = F.col("implied_volatility")
    means = top_k_by_strike(chain, tie_break).groupBy("ticker").agg(
        F.avg(F.when(F.col("option_type") == "put", iv)).alias("_put"),
        F.avg(F.when(F.col("option_type") == "call", iv)).alias("_call"))
    return means.select("ticker", F.round(F.col("_put") - F.col("_call"), 6).alias("iv_skew_proxy"))


def gex_proxy(chain: DataFrame) -> DataFrame:
    """Gamma exposure of calls minus puts, 100 shares a contract; an empty side counts 0."""
    exposure = F.col("gamma") * F.col("open_interest") * 100
    calls = F.coalesce(_side("call", exposure), F.lit(0.0))
    puts = F.coalesce(_side("put", exposure), F.lit(0.0))
    return chain.groupBy("ticker").agg(F.round(calls - puts, 2).alias("gex_proxy"))


def options_metrics(chain: DataFrame, tie_break: Sequence[str]) -> DataFrame:
    """All three metrics, one row per ticker.

    Ratio and exposure come from one aggregate. The strike ends are ranked apart, since the limit on their rank
    reaches below the shuffle and keeps a busy ticker out of a single task.
    """
    exposure = F.col("gamma") * F.col("open_interest") * 100
    puts, calls = (F.coalesce(_side(s, F.col("open_interest")), F.lit(0)) for s in ("put", "call"))
    short, long = (F.coalesce(_side(s, exposure), F.lit(0.0)) for s in ("put", "call"))
    sums = chain.groupBy("ticker").agg(
        F.when(calls > 0, F.round(F.try_divide(puts.cast("double"), calls.cast("double")), 4)).alias("put_call_ratio"),
        F.round(long - short, 2).alias("gex_proxy"))
    return sums.join(iv_skew_proxy(chain, tie_break), "ticker", "left").select(
        "ticker", "iv_skew_proxy", "put_call_ratio", "gex_proxy")


def join_options_metrics(bars: DataFrame, metrics: DataFrame) -> DataFrame:
    """The same three values on every bar of a ticker."""
    keyed = metrics.select(F.upper("ticker").alias("ticker"), "iv_skew_proxy", "put_call_ratio", "gex_proxy")
    return bars.join(keyed, "ticker", "left")
