"""Helpers shared by the operators: Arrow batches of bounded size and columns added in one Python pass."""

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

# Rows per Arrow batch. A batch holds whole texts, so its rows, not only its bytes, are kept low.
BATCH_ROWS = 256

WHITE = "[\\x20\\x09-\\x0D]"


def arrow_batches(df: DataFrame, rows: int = BATCH_ROWS) -> DataFrame:
    """Let Arrow batches of this session hold at most ``rows`` rows; returns ``df`` unchanged."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    return df


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """The UTF-8 bytes of a string column, without decoding it."""
    return column.cast(pa.binary()).to_pylist()


def gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Consecutive batches as one, of at least ``limit`` bytes (the last may hold less)."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        held.append(batch)
        size += batch.nbytes
        if size >= limit:
            yield held[0] if len(held) == 1 else pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def add_columns(df: DataFrame, inputs: list[str], outputs: dict[str, str],
                make: Callable[[], Callable[..., list]], drop: tuple[str, ...] = (), gather: int = 0) -> DataFrame:
    """``df`` with columns computed from whole Arrow columns in one ``mapInArrow`` pass.

    ``make`` runs once per task and returns a function from the Arrow columns ``inputs`` to one list or
    Arrow array per output. ``outputs`` maps names to Spark types. A column of ``df`` that has the name of
    an output is replaced. ``drop`` leaves out columns that are not needed afterwards. With ``gather``, batches
    are put together until they hold that many bytes.
    """
    kept = [f for f in df.schema.fields if f.name not in outputs and f.name not in drop]
    added = [T.StructField(name, T._parse_datatype_string(kind)) for name, kind in outputs.items()]
    names = [f.name for f in kept]
    needed = [c for c in df.columns if c in names or c in inputs]
    kinds = [to_arrow_type(f.dataType) for f in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in gathered(batches, gather):
            if not batch.num_rows:
                continue
            made = work(*[batch.column(c) for c in inputs])
            columns = [batch.column(c) for c in names] + [
                x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names + list(outputs))

    schema = T.StructType(kept + added)
    return arrow_batches(df).select(*[f"`{c}`" for c in needed]).mapInArrow(run, schema)
