"""The event model.

An event has a time in Unix nanoseconds, attributes, and any of three payloads: a log,
metrics, a span. Attribute maps are MAP<STRING, STRING> whose values carry their type as
first character, so equality of maps is structural equality of typed values and a map
can be a grouping key:

    s text   i signed   u unsigned   f float   b bool   n null   t time in ns   x bytes (hex)   a array (JSON)   m map (JSON)
"""

from __future__ import annotations

from pyspark.sql import types as T

#: Attributes with this prefix are the engine's own.
PRIVATE = "_sl."
OVERFLOW = "sl.overflow"
#: Flag that takes a metric out of windowing, with its reason.
CLOSED = "_sl.metrics.closed"
FIELD = "_sl.field."

SEVERITIES = ["trace", "debug", "info", "warn", "error", "fatal"]
NO_RECORDED_VALUE = 1

ATTRIBUTES = T.MapType(T.StringType(), T.StringType())
STR, LONG, INT, DOUBLE, BOOL = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.BooleanType()


def struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


LOG = struct(message=STR, severity=STR, body_format=STR, trace_id=STR, span_id=STR, trace_flags=INT, event_name=STR, observed_ns=LONG, dropped=INT)
METRIC = struct(
    name=STR, unit=STR, description=STR, start_ns=LONG, flags=INT, kind=STR, value=DOUBLE, value_i64=LONG, value_type=STR, temporality=STR, monotonic=BOOL,
    samples=T.ArrayType(DOUBLE), sample_rate=DOUBLE, members=T.ArrayType(STR), bins=T.MapType(INT, DOUBLE), buckets=T.ArrayType(struct(bound=DOUBLE, count=LONG)),
    quantiles=T.ArrayType(struct(q=DOUBLE, v=DOUBLE)), count=LONG, sum=DOUBLE, min=DOUBLE, max=DOUBLE,
    # bucket i of a side counts magnitudes from base^(offset + i) up to base^(offset + i + 1), base = 2^(2^-scale)
    exp=struct(scale=INT, zero_count=LONG, zero_threshold=DOUBLE, pos_offset=INT, positive=T.ArrayType(LONG), neg_offset=INT, negative=T.ArrayType(LONG)),
)
SPAN = struct(trace_id=STR, span_id=STR, parent_span_id=STR, name=STR, kind=STR, status=STR, end_ns=LONG, flags=INT)
EVENT = T.StructType([
    T.StructField("ts_ns", T.LongType()), T.StructField("attributes", ATTRIBUTES), T.StructField("resource", ATTRIBUTES), T.StructField("scope", ATTRIBUTES),
    T.StructField("log", LOG), T.StructField("metrics", T.ArrayType(METRIC)), T.StructField("span", SPAN),
    T.StructField("_origin", T.StringType()), T.StructField("_previous", T.StringType()), T.StructField("_batch", T.LongType()), T.StructField("_seq", T.LongType()),
])
