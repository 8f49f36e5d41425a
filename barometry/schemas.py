"""Explicit schemas; nothing is ever inferred."""

from pyspark.sql import types as T

_D, _S, _L, _TS = T.DoubleType(), T.StringType(), T.LongType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


BARS = _struct(time=_TS, ticker=_S, open=_D, high=_D, low=_D, close=_D,
               volume=_L, vwap=_D, source=_S, interval=_S)
MACRO = _struct(time=_TS, series_id=_S, value=_D, source=_S)
OPTIONS_METRICS = _struct(ticker=_S, iv_skew_proxy=_D, put_call_ratio=_D, gex_proxy=_D)

# A downloaded price file, before it is made canonical.
LANDED_PRICES = _struct(Date=_TS, ticker=_S, Open=_D, High=_D, Low=_D, Close=_D, Volume=_D)

# A macro service response, and the message envelope of each topic.
OBSERVATIONS = T.StructType([
    T.StructField("observations", T.ArrayType(_struct(date=_S, value=_S))),
])


def envelope(records: T.StructType) -> T.StructType:
    head = _struct(batch_id=_S, ingested_at=_S, source=_S, data_type=_S, record_count=_L)
    return head.add("records", T.ArrayType(records))
