"""Ordered operators that never put a whole series into one task.

A window over ``partitionBy(ticker)`` sends every bar of a ticker to one task, which fails once a
ticker holds a large share of the data. Here a series is cut by position instead:

1. ``row_index`` numbers the rows of a series. Rows are numbered inside calendar buckets and shifted
   by the bucket counts before them, so only one small row per bucket is ever ordered per series.
   Forward fill rides along: the last known value of each bucket travels with its count.
2. ``over_blocks`` cuts the numbered series into blocks of ``block_rows`` rows and copies the last
   ``halo`` rows of the preceding blocks in front of each. Windows then run per (series, block), the
   copies are dropped, and every kept row has seen all rows its result depends on.

All windows of one ``over_blocks`` call share the hash partitioning on (series, block): one shuffle,
however many indicators are chained.
"""

import math
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from barometry.operators.ranges import range_index

#: The bucket of a series that is cut by range partitions (see ``ranges``), not by a calendar.
RANGE = "range"
IDX, BLOCK, STRETCH, RUN, BUCKET = "_idx", "_block", "_stretch", "_run", "_bucket"


@dataclass(frozen=True)
class Series:
    """How rows form series: key and order columns, and the sizes of buckets, blocks and runs.

    Inside a block, runs of ``run_rows`` rows form stretches of ``run_rows * runs`` rows. Windows order
    by (stretch, run, index), so windows over blocks, stretches and runs all need the same one sort.
    """

    key: str = "ticker"
    order: str = "time"
    bucket: str = "month"
    block_rows: int = 262_144
    run_rows: int = 252
    runs: int = 4

    @property
    def stretch_rows(self) -> int:
        return self.run_rows * self.runs

    def window(self) -> WindowSpec:
        return Window.partitionBy(self.key, BLOCK).orderBy(STRETCH, RUN, IDX)

    def last(self, n: int) -> WindowSpec:
        """Frame of the current row and the ``n - 1`` rows before it."""
        return self.window().rowsBetween(1 - n, 0)


TICKER_TIME = Series()
# Any density of rows, from years apart to all within a minute: no calendar, ranges that Spark samples instead.
RANGED = Series(bucket=RANGE)
# Many rows a day per ticker (signals, ticks): hours are numbered apart, so a busy ticker is split by itself.
INTRADAY = Series(bucket="hour")
# One series only (the wide macro table); still cut into buckets and blocks.
SINGLE = Series(key="_all", bucket="year")
SINGLE_INTRADAY = Series(key="_all", bucket="day")
# Rows without a place in their series are spread over so many buckets.
LOOSE = 1024

Step = Callable[[DataFrame], DataFrame]


def row_index(
    df: DataFrame, series: Series = TICKER_TIME, fill: Sequence[str] = (), ties: Sequence[str | Column] = (),
) -> DataFrame:
    """Add ``_idx``, the 0-based position within the series, and forward-fill the ``fill`` columns.

    (key, order) must be unique, or ``ties`` order what is equal there. A row with a null key or order has no place in a series: it is kept with a
    null ``_idx``, is not filled and counts for no other row.
    """
    key, order = series.key, series.order
    if series.bucket == RANGE:
        return range_index(df, [key], order, IDX, ties, fill)
    placed = F.col(key).isNotNull() & F.col(order).isNotNull()
    loose = F.timestamp_seconds(-(1 << 40) - F.pmod(F.xxhash64(*df.columns), F.lit(LOOSE)))
    bucket = F.date_trunc(series.bucket, F.col(order)).cast("timestamp")
    bucketed = df.withColumn(BUCKET, F.when(placed, bucket).otherwise(loose))
    carried = [f"_carry_{c}" for c in fill]
    last_known = [
        F.max_by(c, F.when(F.col(c).isNotNull() & placed, F.col(order))).alias(k)
        for c, k in zip(fill, carried)
    ]
    before = Window.partitionBy(key).orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    heads = bucketed.where(placed).groupBy(key, BUCKET).agg(F.count(F.lit(1)).alias("_n"), *last_known).select(
        key, BUCKET,
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        *[F.last(k, ignorenulls=True).over(before).alias(k) for k in carried],
    )
    inside = Window.partitionBy(key, BUCKET).orderBy(order, *ties)
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    local = bucketed.withColumns({
        "_rn": F.row_number().over(inside) - 1,
        **{c: F.when(placed, F.last(c, ignorenulls=True).over(so_far)).otherwise(F.col(c)) for c in fill},
    })
    # Buckets of placed rows have their head. A left join lets the planner broadcast the heads, never the rows.
    return (
        local.join(heads, [key, BUCKET], "left")
        .withColumns({
            IDX: F.col("_offset") + F.col("_rn"),
            **{c: F.coalesce(F.col(c), F.col(k)) for c, k in zip(fill, carried)},
        })
        .select(*df.columns, IDX)
    )


def forward_fill(df: DataFrame, columns: Sequence[str], series: Series = TICKER_TIME) -> DataFrame:
    return row_index(df, series, fill=columns).drop(IDX)


def over_blocks(df: DataFrame, step: Step, halo: int, series: Series = TICKER_TIME) -> DataFrame:
    """Run ``step`` (any chain of windows reaching back at most ``halo`` rows) block by block.

    Inside another ``over_blocks`` the rows are already laid out, and the step runs as it is. Rows without a
    place in their series (null key or order) are kept; what ``step`` adds is null there.
    """
    if BLOCK in df.columns:
        return step(df)
    numbered = df if IDX in df.columns else row_index(df, series)
    # Rows without a place lie in blocks below 0, away from all others.
    loose = -1 - F.pmod(F.xxhash64(*df.columns), F.lit(LOOSE))
    home = F.coalesce(F.expr(f"_idx div {series.block_rows}L"), loose)
    block = home
    if halo:
        block = F.explode(F.sequence(home, F.coalesce(F.expr(f"(_idx + {halo}L) div {series.block_rows}L"), loose)))
    laid = numbered.select(
        "*", F.expr(f"_idx div {series.stretch_rows}L").alias(STRETCH),
        F.expr(f"_idx div {series.run_rows}L").alias(RUN), block.alias(BLOCK))
    out = step(laid)
    if halo:
        of_block = F.expr(f"_idx div {series.block_rows}L")
        out = out.filter((F.col(BLOCK) < 0) | (F.col(BLOCK) == of_block))
    added = [c for c in out.columns if c not in laid.columns]
    out = out.withColumns({c: F.when(F.col(BLOCK) >= 0, F.col(c)) for c in added}) if added else out
    return out.drop(BLOCK, STRETCH, RUN, *([] if IDX in df.columns else [IDX]))


# -- rolling statistics ------------------------------------------------------------------------

def rolling_mean(c: Column, n: int, series: Series = TICKER_TIME) -> Column:
    """Mean of the last ``n`` values, null unless all ``n`` are present. For short windows."""
    frame = series.last(n)
    return F.when(F.count(c).over(frame) == n, F.avg(c).over(frame))


def rolling_std(c: Column, n: int, series: Series = TICKER_TIME) -> Column:
    """Sample standard deviation of the last ``n`` values, null unless all are present."""
    frame = series.last(n)
    return F.when(F.count(c).over(frame) == n, F.stddev_samp(c).over(frame))


def rolling_zscores(
    df: DataFrame, columns: Mapping[str, str], n: int, limit: float, series: Series = TICKER_TIME
) -> DataFrame:
    """Add z-scores ``{output: input}`` against the last ``n`` rows, at O(1) work per row and column.

    A moving frame would visit ``n`` rows for every row. Instead the series is cut into runs of ``n``
    rows; any frame is the end of one run plus the start of the next. Running count, mean and variance
    are kept forwards and backwards over each run and the two parts are merged with the pairwise
    variance formula, which has no cancellation. A constant frame gives 0.
    """
    run = [STRETCH, RUN]
    if n != series.run_rows:
        run = ["_own_run"]
        df = df.withColumn("_own_run", F.expr(f"_idx div {n}L"))
    sources = list(dict.fromkeys(columns.values()))
    kept = [c for c in df.columns if c != "_own_run"]
    # SQL text rather than Column calls: the same expressions, built much faster for many columns.
    block = f"partition by {series.key}, {BLOCK}"
    so_far = "rows between unbounded preceding and current row"
    forwards = f"over ({block}, {', '.join(run)} order by {IDX} {so_far})"
    # Runs are numbered backwards too, so that one sort serves the last two windows.
    from_end = f"over ({block}, _back order by {IDX} desc {so_far})"
    reversed_block = f"over ({block} order by _back, {IDX} desc)"

    def moments(prefix: str, frame: str) -> list[str]:
        return [f"{fn}({c}) {frame} as {prefix}{kind}_{c}"
                for c in sources for kind, fn in (("n", "count"), ("m", "avg"), ("v", "var_pop"))]

    tail = ", ".join([f"_t{k}_{c}" for c in sources for k in "nmv"] + sources)
    df = df.selectExpr("*", f"-{run[-1]} as _back", *moments("_h", forwards))
    df = df.selectExpr("*", *moments("_t", from_end))
    # The run that just ended, seen from n - 1 rows before; none where one run is the frame.
    df = df.selectExpr("*", f"if({IDX} % {n} = {n - 1}, null, "
                            f"lead(struct({tail}), {n - 1}) {reversed_block}) as _tail")

    # Conditions and values are named step by step, so that none is repeated when the plan is merged.
    parts = [sql for c in sources for sql in (
        f"_hn_{c} + coalesce(_tail._tn_{c}, 0L) = {n} as _full_{c}",
        f"cast(coalesce(_tail._tn_{c}, 0L) as double) as _n2_{c}",
        f"coalesce(_tail._tm_{c}, 0D) as _m2_{c}",
        f"coalesce(_tail._tv_{c}, 0D) as _v2_{c}",
        f"coalesce(_tail.{c} = {c}, true) as _ends_{c}",
    )]
    merged = [sql for c in sources for sql in (
        f"_full_{c}",
        f"_full_{c} and _ends_{c} and _hv_{c} = 0 and _v2_{c} = 0 as _same_{c}",
        f"(_hn_{c} * _hm_{c} + _n2_{c} * _m2_{c}) / {n}D as _mean_{c}",
        f"sqrt((_hn_{c} * _hv_{c} + _n2_{c} * _v2_{c}"
        f" + pow(_hm_{c} - _m2_{c}, 2) * _hn_{c} * _n2_{c} / {n}D) / {n - 1}D) as _std_{c}",
    )]
    scores = [
        f"case when _same_{c} then 0D when _full_{c} then"
        f" greatest(least(({c} - _mean_{c}) / greatest(_std_{c}, 1e-8D), {limit}D), -{limit}D) end as {out}"
        for out, c in columns.items()
    ]
    df = df.selectExpr(*kept, *[f"_h{k}_{c}" for c in sources for k in "nmv"], *parts)
    return df.selectExpr(*kept, *merged).selectExpr(*kept, *scores)


# -- exponentially weighted means ----------------------------------------------------------------

# Weights below exp(-NEGLIGIBLE) = 1e-30 of the newest are dropped: 14 digits beyond double precision.
NEGLIGIBLE = 69.0
_MAX_EXPONENT = 600.0  # exp(600) leaves room for any price before overflow


@dataclass(frozen=True)
class Ewm:
    """An exponentially weighted mean of ``src`` as ``out``.

    ``adjust=False`` is the recursion y = (1-alpha)*y_prev + alpha*x started at the first value;
    ``adjust=True`` divides the weighted sum by the sum of the weights. Null values have no result, but time
    goes on: what came before weighs (1-alpha) less for each of them, and the weights are scaled to 1 again.
    """

    out: str
    src: str
    alpha: float
    adjust: bool = False

    @property
    def decay(self) -> float:
        return -math.log1p(-self.alpha)


def ewm_reach(alpha: float) -> int:
    """Rows after which a weight ``(1 - alpha)**k`` is negligible."""
    return math.ceil(NEGLIGIBLE / -math.log1p(-alpha)) + 1


def ewm_mean(df: DataFrame, means: Sequence[Ewm], series: Series = TICKER_TIME) -> DataFrame:
    """Add exponentially weighted means to a laid-out frame, all in one pass where runs allow.

    Spark windows cannot recurse. Within a stretch of rows the recursion is a running sum of
    ``w * x / (1-alpha)**p``, p being the place in the stretch; the end of the stretch before, decayed, is
    added to it. A memory much longer or shorter than the stretch gets stretches of its own, with a sort.

    With inner nulls the recursive form keeps its scale by the same sums: its weight is alpha for a value
    after a value, and after g nulls the old mean weighs (1-alpha)**(g+1) against alpha. That is the ratio of
    a running sum of x to a running sum of ones in which each value that ends a gap weighs more.
    """
    rows, stretch = series.stretch_rows, STRETCH
    fits = [m for m in means if NEGLIGIBLE <= rows * m.decay <= _MAX_EXPONENT]
    others = [m for m in means if m not in fits]
    if others and (fits or len({_own_rows(m) for m in others}) > 1):
        for part in [fits, *[[m for m in others if _own_rows(m) == n] for n in dict.fromkeys(map(_own_rows, others))]]:
            df = ewm_mean(df, part, series) if part else df
        return df
    if others:
        rows, stretch = _own_rows(others[0]), "_own_stretch"
        df = df.withColumn(stretch, F.expr(f"_idx div {rows}L"))

    block = f"partition by {series.key}, {BLOCK}"
    ordered = f"order by {STRETCH}, {RUN}, {IDX}"
    frame = "rows between unbounded preceding and current row"
    so_far = f"over ({block} {ordered} {frame})"
    earlier = f"over ({block} {ordered} rows between unbounded preceding and 1 preceding)"
    inside = f"over ({block}, {stretch} order by {RUN}, {IDX} {frame})"
    before = f"over ({block} order by {stretch} range between 1 preceding and 1 preceding)"
    place = f"({IDX} % {rows})"
    sources = list({m.src: 0 for m in means})

    # Extra decay that the recursive form owes to gaps: after g nulls the old mean's share of the new one is
    # (1-a)^(g+1) / ((1-a)^(g+1) + a) instead of (1-a)^(g+1). _gap counts the nulls just passed; a first value has none.
    def scale(m: Ewm) -> str:
        return (f"if({m.src} is null or _gap_{m.src} = 0, 0D, ln(exp(-(_gap_{m.src} + 1) * {m.decay!r}D) + {m.alpha!r}D))")

    def weight(m: Ewm) -> str:
        return "1D" if m.adjust else f"if(_k_{m.src} = 1, 1D, {m.alpha!r}D)"

    kept = [c for c in df.columns if c != "_own_stretch"]
    df = df.selectExpr("*", *[f"count({c}) {so_far} as _k_{c}" for c in sources],
                       *[f"max(if({c} is not null, {IDX}, null)) {earlier} as _at_{c}" for c in sources])
    df = df.selectExpr("*", *[f"coalesce({IDX} - _at_{c} - 1, 0L) as _gap_{c}" for c in sources])
    plain = [m for m in means if not m.adjust]
    # The scales are summed over the stretch, like all else.
    df = df.selectExpr("*", *[f"sum({scale(m)}) {inside} as _log_{m.out}" for m in plain])

    def grown(m: Ewm) -> str:
        return f"exp({place} * {m.decay!r}D" + ("" if m.adjust else f" + _log_{m.out}") + ")"

    def shrunk(m: Ewm) -> str:
        return f"exp(-{place} * {m.decay!r}D" + ("" if m.adjust else f" - _log_{m.out}") + ")"

    # A value that ends a gap is itself scaled by the share left to it, which its own _log already holds.
    df = df.selectExpr("*", *[
        f"sum({weight(m)} * {m.src} * {grown(m)} / "
        f"{'1D' if m.adjust else f'exp({scale(m)})'}) {inside} as _local_{m.out}" for m in means],
        *[f"sum(if({m.src} is null, 0D, {grown(m)})) {inside} as _ones_{m.out}" for m in means if m.adjust])

    def carried(m: Ewm, name: str) -> str:
        """The sum at the end of the stretch before, in terms of this stretch."""
        end = f"{name}_{m.out}" if m.adjust else f"{name}_{m.out} * exp(-_log_{m.out})"
        ended = f"max(if({place} = {rows - 1}, {end}, null)) {before}"
        return f"({name}_{m.out} + coalesce({ended}, 0D) * exp({-m.decay * rows!r}D))"

    def value(m: Ewm) -> str:
        norm = f" / ({carried(m, '_ones')} * {shrunk(m)})" if m.adjust else ""
        return f"if({m.src} is null, null, {carried(m, '_local')} * {shrunk(m)}{norm}) as {m.out}"

    return df.selectExpr(*kept, *[value(m) for m in means])


def _own_rows(m: Ewm) -> int:
    """Rows of a stretch that holds about all of a mean's memory."""
    return math.ceil(NEGLIGIBLE / m.decay)


# -- latest rows and duplicates --------------------------------------------------------------------

def latest_n(df: DataFrame, n: int, key: str = "ticker", order: str = "time") -> DataFrame:
    """Last ``n`` rows per key. Spark limits each map partition first (WindowGroupLimit)."""
    newest = Window.partitionBy(key).orderBy(F.col(order).desc())
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") <= n).drop("_rank")


def dedupe_keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the last in ``order``; copies are dropped before the shuffle as well."""
    newest = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return df.withColumn("_rank", F.row_number().over(newest)).filter(F.col("_rank") == 1).drop("_rank")


def shift(df: DataFrame, columns: Mapping[str, str], n: int, series: Series = TICKER_TIME) -> DataFrame:
    """Add ``{output: input}`` shifted down by ``n`` rows."""
    return over_blocks(df, lambda d: d.withColumns({
        out: F.lag(src, n).over(series.window()) for out, src in columns.items()
    }), n, series)


def diff(df: DataFrame, columns: Mapping[str, str], n: int = 1, series: Series = TICKER_TIME) -> DataFrame:
    """Add ``{output: input}`` minus its value ``n`` rows before."""
    return over_blocks(df, lambda d: d.withColumns({
        out: F.col(src) - F.lag(src, n).over(series.window()) for out, src in columns.items()
    }), n, series)
