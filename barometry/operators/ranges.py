"""Positions and carried values of ordered series by range partitions.

Rows are range-partitioned by key and order, by Spark's own sampling of them, so one key with any share of the
rows, or with all its rows within a minute, is spread evenly: no calendar is involved. Each partition numbers its
rows key by key and fills from what it has seen, in one pass over the sorted rows. Of its keys only the first can
have begun in a partition before; what that key brings along (how many rows, and the last known values) is a prefix
over one small row per partition. So full rows are shuffled once, and what is broadcast has at most as many rows as there are partitions.

The numbered rows are written to the shared folder once: the ranges are sampled, and another run of the same plan
could cut them elsewhere.
"""

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from barometry.session import written

PART, LOCAL, PLACED = "_part", "_local", "_placed"


def ranged(
    df: DataFrame, keys: Sequence[str], order: str, ties: Sequence[str | Column] = (), fill: Sequence[str] = (),
    parts: int | None = None,
) -> DataFrame:
    """``df`` in range partitions, sorted, with the partition and the position of a row among its key's rows there.

    ``fill`` columns are filled forwards within the partition. Rows with a null key or order have no position.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = F.col(order).isNotNull()
    for k in keys:
        placed = placed & F.col(k).isNotNull()
    # Rows without a place are dealt by their content instead.
    loose = F.when(placed, F.lit(0)).otherwise(F.xxhash64(*df.columns))
    by = [F.col(PLACED), *map(F.col, keys), F.col(order), *[F.col(t) if isinstance(t, str) else t for t in ties], loose]
    laid = df.withColumn(PLACED, placed).repartitionByRange(n, *by).sortWithinPartitions(*by)
    schema = T.StructType([*df.schema.fields, T.StructField(PART, T.IntegerType()), T.StructField(LOCAL, T.LongType())])
    names, keys, fill = list(df.columns), list(keys), list(fill)

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, state = TaskContext.get().partitionId(), _Run(keys, fill)
        for batch in batches:
            local, filled = state.take(batch)
            columns = [filled.get(c, batch.column(c)) for c in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(np.full(batch.num_rows, part, np.int32)), local], [*names, PART, LOCAL])

    return laid.mapInArrow(number, schema)


class _Run:
    """What goes from one batch of a partition to the next: the last key, its rows so far, its last known values."""

    def __init__(self, keys: list[str], fill: list[str]) -> None:
        self.keys, self.fill = keys, fill
        self.last: tuple | None = None
        self.count = 0
        self.known: dict[str, pa.Array] = {}

    def take(self, batch: pa.RecordBatch) -> tuple[pa.Array, dict[str, pa.Array]]:
        """The positions of a batch's rows, and its filled columns."""
        n = batch.num_rows
        placed = batch.column(PLACED).to_numpy(zero_copy_only=False).astype(bool)
        rows = np.flatnonzero(placed)
        if not len(rows):
            return pa.nulls(n, pa.int64()), {}
        own = [batch.column(k).take(pa.array(rows)) for k in self.keys]
        m = len(rows)
        starts = np.zeros(m, bool)
        for k in own:
            starts[1:] |= ~pc.equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False).astype(bool)
        first = tuple(k[0].as_py() for k in own)
        starts[0] = first != self.last
        places = np.arange(m)
        begin = np.maximum.accumulate(np.where(starts, places, 0))
        goes_on = np.cumsum(starts) == 0
        local = places - begin + np.where(goes_on, self.count, 0)
        out = np.zeros(n, np.int64)
        out[rows] = local
        filled = {c: self.filled(c, batch.column(c), rows, begin, goes_on) for c in self.fill}
        self.last, self.count = tuple(k[m - 1].as_py() for k in own), int(local[-1]) + 1
        self.known = {c: x.slice(int(rows[-1]), 1) for c, x in filled.items()}
        return pa.array(out, mask=~placed), filled

    def filled(self, name: str, column: pa.Array, rows: np.ndarray, begin: np.ndarray, goes_on: np.ndarray) -> pa.Array:
        valid = column.is_valid().to_numpy(zero_copy_only=False)[rows]
        seen = np.maximum.accumulate(np.where(valid, np.arange(len(rows)), -1))
        inside = seen >= begin
        # Entry 0 is what the batch before knew of the key that goes on, entry 1 is null.
        before = self.known.get(name, pa.nulls(1, column.type))
        entries = pa.concat_arrays([before, pa.nulls(1, column.type), column])
        at = np.arange(len(column)) + 2
        at[rows] = np.where(inside, rows[np.maximum(seen, 0)] + 2, np.where(goes_on, 0, 1))
        return entries.take(pa.array(at))


def range_index(
    df: DataFrame, keys: Sequence[str], order: str, index: str = "_idx", ties: Sequence[str | Column] = (),
    fill: Sequence[str] = (), parts: int | None = None,
) -> DataFrame:
    """``df`` with ``index``, the 0-based position among the rows of its key, and ``fill`` columns filled forwards.

    (keys, order) must be unique, or ``ties`` order what is equal there. Without ``keys`` all rows are one series.
    A row with a null key or order is kept with a null ``index``, is not filled and counts for no other row.
    """
    fill = list(fill)
    rows = written(ranged(df, keys, order, ties, fill, parts), "ranges")
    last = [F.max_by(c, LOCAL).alias(f"_carry_{c}") for c in fill]
    ends = rows.where(F.col(LOCAL).isNotNull()).groupBy(*keys, PART).agg((F.max(LOCAL) + 1).alias("_n"), *last)
    # One row per partition and key; of one key at most one per partition.
    before = Window.partitionBy(*keys).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    heads = ends.select(
        *[F.col(k).alias(f"_key_{k}") for k in keys], F.col(PART).alias("_of"), F.sum("_n").over(before).alias("_offset"),
        *[F.last(f"_carry_{c}", ignorenulls=True).over(before).alias(f"_carry_{c}") for c in fill]).where("_offset is not null")
    # Only the first key of a partition has rows in those before it: no more heads than partitions.
    same = F.col(PART) == F.col("_of")
    for k in keys:
        same = same & (F.col(k) == F.col(f"_key_{k}"))
    joined = rows.join(F.broadcast(heads), same, "left")
    here = F.col(LOCAL).isNotNull()
    carried = {c: F.when(here, F.coalesce(F.col(c), F.col(f"_carry_{c}"))).otherwise(F.col(c)) for c in fill}
    return joined.withColumns({index: F.col(LOCAL) + F.coalesce("_offset", F.lit(0)), **carried}).select(*df.columns, index)


def asof_join(
    left: DataFrame, right: DataFrame, on: str, by: Sequence[str] = (), columns: Sequence[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Every row of ``left`` with the latest row of ``right`` whose ``on`` is not later, within equal ``by`` columns.

    Both sides become one ordered series, a right row before the left rows of its time, and the last right row is carried
    forwards: neither side is joined by range, repeated or collected, and a key with most of the rows is spread.
    ``columns`` (default: all of ``right`` but ``on`` and ``by``) are added, null where nothing is earlier or ``on`` or a
    ``by`` value is null. Of right rows with equal times the largest ``columns`` count. All left rows are kept, repeated ones too.
    """
    columns = [c for c in right.columns if c not in (on, *by)] if columns is None else list(columns)
    clash = set(columns) & set(left.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    key = [*by, on]
    kind = T.StructType([left.schema[c] for c in left.columns])
    added = T.StructType([right.schema[c] for c in columns])
    # A left row travels as one value; the keys of both sides as columns of their own.
    ours = left.select(*[F.col(c).alias(f"_by_{c}") for c in key], F.lit(1).alias("_side"),
                       F.struct(*left.columns).alias("_left"), F.lit(None).cast(added).alias("_right"))
    known = F.col(on).isNotNull()
    for c in by:
        known = known & F.col(c).isNotNull()
    theirs = right.where(known).select(*[F.col(c).cast(left.schema[c].dataType).alias(f"_by_{c}") for c in key],
                                       F.lit(0).alias("_side"), F.lit(None).cast(kind).alias("_left"), F.struct(*columns).alias("_right"))
    series = range_index(ours.unionByName(theirs), [f"_by_{c}" for c in by], f"_by_{on}", "_at", ["_side", "_right"], ["_right"], parts)
    return series.where("_side = 1").select("_left.*", "_right.*")
