"""JSON wire formats: the event archive, OTLP/JSON, HEC, series and log intakes, container logs.

Decoders use explicit schemas, so a field of the wrong type reads as null instead of
failing; what a column doesn't name is ignored. Encoders give one JSON text per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import values as V
from strandline.functions.shared import bucketed_prefix
from strandline.operators.parsers import json_value
from strandline.schema import EVENT, METRIC

# -- event archive -------------------------------------------------------------------------------

_POINT = "struct<name:string,kind:string,value:variant,delta:double,temporality:string,monotonic:boolean,values:array<double>,sample_rate:double,members:array<string>,count:bigint,sum:double,min:double,max:double,buckets:array<struct<bound:variant,count:bigint>>,quantiles:array<struct<quantile:double,value:double>>,sketch:struct<positive:array<struct<key:int,count:double>>,negative:array<struct<key:int,count:double>>,zero_count:double>,exp:struct<scale:int,zero_count:bigint,zero_threshold:double,pos_offset:int,positive:array<bigint>,neg_offset:int,negative:array<bigint>>,unit:string,description:string,start_timestamp:string,flags:int>"
_SPAN = "struct<name:string,trace_id:string,span_id:string,parent_span_id:string,kind:string,status:string,`end`:string,flags:int>"
ARCHIVE = (
    "timestamp string, log struct<severity:string,format:string,message:variant,event_name:string,observed_timestamp:string,trace_id:string,span_id:string,trace_flags:int,dropped_attributes_count:int>, "
    f"metrics array<{_POINT}>, span {_SPAN}, attributes map<string,variant>, resource struct<attributes:map<string,variant>>, scope struct<name:string,version:string,attributes:map<string,variant>>, types map<string,string>"
)


def rfc3339_ns(c: Column) -> Column:
    """Unix ns of an RFC 3339 time, digit-exact."""
    p = r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d{1,9})\d*)?([Zz]|[+-]\d\d:\d\d)$"
    t = F.when(c.rlike(p), c)
    whole = F.try_to_timestamp(F.concat(F.regexp_extract(t, p, 1), F.lit("T"), F.regexp_extract(t, p, 2), F.upper(F.regexp_extract(t, p, 4))))
    return F.unix_micros(whole) * F.lit(1000).cast("bigint") + F.rpad(F.regexp_extract(t, p, 3), 9, "0").cast("bigint")


def ns_rfc3339(c: Column) -> Column:
    """RFC 3339 text with nine fraction digits."""
    frac = F.lpad(F.pmod(c, F.lit(1_000_000_000)).cast("string"), 9, "0")
    return F.concat(F.date_format(F.timestamp_seconds(F.floor(F.try_divide(c - F.pmod(c, F.lit(1_000_000_000)), F.lit(1_000_000_000)))), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("."), frac, F.lit("Z"))


def _typed(m: Column, types: Column, path: str) -> Column:
    """Attribute map from JSON values, with the types that JSON can't spell."""
    def one(k: Column, v: Column) -> Column:
        t = types[F.concat(F.lit(path), F.replace(F.replace(k, F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")))]
        plain = json_value(v)
        body = V.text(plain)
        number = F.when(V.kind(plain) == "u", F.concat(F.lit("i"), body)).otherwise(plain)
        return F.when(t == "u64", F.concat(F.lit("u"), body)).when(t == "f64", F.concat(F.lit("f"), body)).when(t == "timestamp", F.concat(F.lit("t"), rfc3339_ns(body).cast("string"))).when(t == "bytes", F.concat(F.lit("x"), F.lower(F.hex(F.encode(F.regexp_extract(body, '^b"(.*)"$', 1), "UTF-8"))))).otherwise(number)
    return F.transform_values(m, one)


def read_archive(df: DataFrame, line: str = "line") -> DataFrame:
    """Events of archived lines; ``_seq`` is taken from the frame, or null. Lines that aren't objects are left out."""
    d = df.withColumn("j", F.from_json(F.col(line), ARCHIVE)).where("j.timestamp is not null")
    none = F.create_map().cast("map<string,string>")
    t = F.coalesce("j.types", none)
    number = lambda v: F.coalesce(F.try_variant_get(v, "$", "double"), F.try_variant_get(v, "$", "string").try_cast("double"))
    def m(x: Column) -> Column:
        bins = F.map_from_entries(F.concat(
            F.coalesce(F.transform(x["sketch"]["positive"], lambda b: F.struct(b["key"].alias("k"), b["count"].alias("v"))), F.array().cast("array<struct<k:int,v:double>>")),
            F.coalesce(F.transform(x["sketch"]["negative"], lambda b: F.struct((-b["key"]).alias("k"), b["count"].alias("v"))), F.array().cast("array<struct<k:int,v:double>>")),
            F.when(x["sketch"]["zero_count"] > 0, F.array(F.struct(F.lit(0).alias("k"), x["sketch"]["zero_count"].alias("v")))).otherwise(F.array().cast("array<struct<k:int,v:double>>")),
        ))
        text = F.to_json(x["value"])
        made = {
            "name": x["name"], "unit": x["unit"], "description": x["description"], "start_ns": rfc3339_ns(x["start_timestamp"]), "flags": x["flags"], "kind": x["kind"],
            "value": F.coalesce(number(x["value"]), x["delta"], F.when(text == "true", 1.0).when(text == "false", 0.0)), "value_i64": F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint")),
            "value_type": F.when(text.rlike(r"^-?\d+$"), "i").when(text.isin("true", "false"), "b").when(x["value"].isNotNull() | x["delta"].isNotNull(), "f"),
            "temporality": x["temporality"], "monotonic": x["monotonic"], "samples": x["values"], "sample_rate": x["sample_rate"], "members": x["members"], "bins": F.when(x["sketch"].isNotNull(), bins),
            "buckets": F.transform(x["buckets"], lambda b: F.struct(F.coalesce(F.try_variant_get(b["bound"], "$", "double"), F.when(F.try_variant_get(b["bound"], "$", "string") == "inf", float("inf")), F.when(F.try_variant_get(b["bound"], "$", "string") == "-inf", float("-inf"))).alias("bound"), b["count"].alias("count"))),
            "quantiles": F.transform(x["quantiles"], lambda q: F.struct(q["quantile"].alias("q"), q["value"].alias("v"))), "count": x["count"], "sum": x["sum"], "min": x["min"], "max": x["max"], "exp": x["exp"],
        }
        return F.struct(*[made[f.name].cast(f.dataType).alias(f.name) for f in METRIC])
    message = F.when(F.schema_of_variant("j.log.message") == "STRING", F.try_variant_get("j.log.message", "$", "string")).otherwise(F.to_json("j.log.message"))
    log = F.struct(
        message.alias("message"), F.col("j.log.severity").alias("severity"), F.col("j.log.format").alias("body_format"), F.col("j.log.trace_id").alias("trace_id"), F.col("j.log.span_id").alias("span_id"),
        F.col("j.log.trace_flags").alias("trace_flags"), F.col("j.log.event_name").alias("event_name"), F.coalesce(rfc3339_ns(F.col("j.log.observed_timestamp")), F.lit(0)).alias("observed_ns"), F.coalesce("j.log.dropped_attributes_count", F.lit(0)).alias("dropped"))
    span = F.struct(*[F.col(f"j.span.{c}").alias(c) for c in ("trace_id", "span_id", "parent_span_id", "name", "kind", "status")], rfc3339_ns(F.col("j.span.end")).alias("end_ns"), F.col("j.span.flags").alias("flags"))
    scope = F.map_filter(F.create_map(F.lit("name"), V.s(F.col("j.scope.name")), F.lit("version"), V.s(F.col("j.scope.version"))), lambda _, v: v.isNotNull())
    out = d.select(
        rfc3339_ns(F.col("j.timestamp")).alias("ts_ns"), F.coalesce(_typed(F.col("j.attributes"), t, "/attributes/"), none).alias("attributes"), F.coalesce(_typed(F.col("j.resource.attributes"), t, "/resource/attributes/"), none).alias("resource"),
        V.merge(_typed(F.col("j.scope.attributes"), t, "/scope/attributes/"), scope).alias("scope"), F.when(F.col("j.log").isNotNull(), log).alias("log"), F.coalesce(F.transform("j.metrics", m), F.array().cast(EVENT["metrics"].dataType)).alias("metrics"),
        F.when(F.col("j.span").isNotNull(), span).alias("span"), F.lit(None).cast("string").alias("_origin"), F.lit(None).cast("string").alias("_previous"), F.lit(0).cast("bigint").alias("_batch"),
        (F.col("_seq") if "_seq" in df.columns else F.lit(None)).cast("bigint").alias("_seq"),
    )
    return out


def value_json(v: Column) -> Column:
    """JSON text of a typed value; non-finite numbers as strings."""
    t, quoted = V.text(v), lambda c: F.substring(F.to_json(F.array(c)), 2, 2_147_483_647)
    def q(c: Column) -> Column:
        j = quoted(c)
        return F.left(j, F.length(j) - 1)
    return F.when(V.kind(v).isin("i", "u", "b", "a", "m"), t).when(V.kind(v) == "n", "null").when(V.kind(v) == "f", F.when(t.isin("NaN"), '"NaN"').when(t == "Infinity", '"inf"').when(t == "-Infinity", '"-inf"').otherwise(t)).when(V.kind(v) == "t", q(ns_rfc3339(t.try_cast("bigint")))).otherwise(q(t))


def _object(pairs: list[tuple[str, Column]]) -> Column:
    """JSON object text of the members whose text isn't null."""
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*[F.concat(F.lit(f'"{k}":'), c) for k, c in pairs])), ","), F.lit("}"))


def map_json(m: Column) -> Column:
    e = F.array_sort(F.map_entries(m))
    key = lambda k: F.regexp_replace(F.to_json(F.array(k)), r"^\[|\]$", "")
    return F.when(F.size(m) > 0, F.concat(F.lit("{"), F.array_join(F.transform(e, lambda x: F.concat(key(x["key"]), F.lit(":"), value_json(x["value"]))), ","), F.lit("}")))


def _q(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c.cast("string"))), r"^\[|\]$", "")


def _n(c: Column) -> Column:
    return c.cast("string")


def _f(c: Column) -> Column:
    return F.when(F.isnan(c), '"NaN"').when(c == float("inf"), '"inf"').when(c == float("-inf"), '"-inf"').otherwise(c.cast("string"))


def write_archive(events: DataFrame) -> DataFrame:
    """One line per event; absent fields are left out."""
    some = lambda c, made: F.when(c.isNotNull(), made(c))
    log = F.when(F.col("log").isNotNull(), _object([
        ("severity", some(F.col("log.severity"), _q)), ("format", _q(F.coalesce("log.body_format", F.lit("raw")))), ("message", some(F.col("log.message"), _q)), ("event_name", some(F.col("log.event_name"), _q)),
        ("observed_timestamp", F.when(F.col("log.observed_ns") != 0, _q(ns_rfc3339(F.col("log.observed_ns"))))), ("trace_id", some(F.col("log.trace_id"), _q)), ("span_id", some(F.col("log.span_id"), _q)),
        ("trace_flags", some(F.col("log.trace_flags"), _n)), ("dropped_attributes_count", F.when(F.col("log.dropped") != 0, _n(F.col("log.dropped"))))]))
    def m(x: Column) -> Column:
        val = F.when(x["value_type"] == "i", x["value_i64"].cast("string")).when(x["value_type"] == "b", (x["value"] != 0).cast("string")).otherwise(_f(x["value"]))
        bins = lambda sign: F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.transform(F.map_entries(F.map_filter(x["bins"], lambda k, _: k > 0 if sign > 0 else k < 0)), lambda e: F.struct(F.abs(e["key"]).alias("k"), e["value"].alias("v")))), lambda e: F.concat(F.lit('{"key":'), e["k"].cast("string"), F.lit(',"count":'), e["v"].cast("string"), F.lit("}"))), ","), F.lit("]"))
        sketch = _object([("positive", F.when(F.exists(F.map_keys(x["bins"]), lambda k: k > 0), bins(1))), ("negative", F.when(F.exists(F.map_keys(x["bins"]), lambda k: k < 0), bins(-1))), ("zero_count", _n(x["bins"][F.lit(0)]))])
        return _object([
            ("name", _q(x["name"])), ("kind", _q(x["kind"])), ("value", F.when(x["kind"].isin("sum", "gauge"), val)), ("delta", F.when(x["kind"] == "gauge_delta", _f(x["value"]))), ("temporality", some(x["temporality"], _q)), ("monotonic", some(x["monotonic"], _n)),
            ("values", some(x["samples"], F.to_json)), ("sample_rate", some(x["sample_rate"], _f)), ("members", some(x["members"], F.to_json)), ("count", some(x["count"], _n)), ("sum", some(x["sum"], _f)), ("min", some(x["min"], _f)), ("max", some(x["max"], _f)),
            ("buckets", F.when(x["buckets"].isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(x["buckets"], lambda b: F.concat(F.lit('{"bound":'), _f(b["bound"]), F.lit(',"count":'), _n(b["count"]), F.lit("}"))), ","), F.lit("]")))),
            ("quantiles", F.when(x["quantiles"].isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(x["quantiles"], lambda b: F.concat(F.lit('{"quantile":'), _f(b["q"]), F.lit(',"value":'), _f(b["v"]), F.lit("}"))), ","), F.lit("]")))),
            ("sketch", F.when(x["bins"].isNotNull(), sketch)), ("exp", some(x["exp"], F.to_json)), ("unit", some(x["unit"], _q)), ("description", some(x["description"], _q)), ("start_timestamp", F.when(x["start_ns"] != 0, _q(ns_rfc3339(x["start_ns"])))), ("flags", F.when(x["flags"] != 0, _n(x["flags"]))),
        ])
    metrics = F.when(F.size("metrics") > 0, F.concat(F.lit("["), F.array_join(F.transform("metrics", m), ","), F.lit("]")))
    span = F.when(F.col("span").isNotNull(), _object([*[(c, some(F.col(f"span.{c}"), _q)) for c in ("name", "trace_id", "span_id", "parent_span_id", "kind", "status")], ("end", some(F.col("span.end_ns"), lambda c: _q(ns_rfc3339(c)))), ("flags", some(F.col("span.flags"), _n))]))
    tag = lambda c, path: F.transform(F.filter(F.map_entries(c), lambda e: V.kind(e["value"]).isin("u", "t", "x") | ((V.kind(e["value"]) == "f") & V.text(e["value"]).isin("NaN", "Infinity", "-Infinity"))), lambda e: F.concat(F.lit('"' + path), F.replace(F.replace(e["key"], F.lit("~"), F.lit("~0")), F.lit("/"), F.lit("~1")), F.lit('":"'), F.when(V.kind(e["value"]) == "u", "u64").when(V.kind(e["value"]) == "t", "timestamp").when(V.kind(e["value"]) == "x", "bytes").otherwise("f64"), F.lit('"')))
    types = F.concat(tag(F.col("attributes"), "/attributes/"), tag(F.col("resource"), "/resource/attributes/"))
    line = _object([
        ("timestamp", _q(ns_rfc3339(F.col("ts_ns")))), ("log", log), ("metrics", metrics), ("span", span), ("attributes", map_json(F.col("attributes"))),
        ("resource", F.when(F.size("resource") > 0, F.concat(F.lit('{"attributes":'), map_json(F.col("resource")), F.lit("}")))), ("types", F.when(F.size(types) > 0, F.concat(F.lit("{"), F.array_join(types, ","), F.lit("}")))),
    ])
    return events.select("_seq", line.alias("line"))


def open_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archived events of a folder or file, compressed or not."""
    return read_archive(spark.read.text(path).withColumnRenamed("value", "line"))


# -- OTLP/JSON -------------------------------------------------------------------------------------

_ANY = "variant"
_KV = f"array<struct<key:string,value:{_ANY}>>"
_NUM = "struct<attributes:" + _KV + ",timeUnixNano:string,startTimeUnixNano:string,asDouble:double,asInt:string,flags:int,count:string,sum:double,min:double,max:double,bucketCounts:array<string>,explicitBounds:array<double>,quantileValues:array<struct<quantile:double,value:double>>,scale:int,zeroCount:string,zeroThreshold:double,positive:struct<offset:int,bucketCounts:array<string>>,negative:struct<offset:int,bucketCounts:array<string>>>"
OTLP_METRICS = f"resourceMetrics array<struct<resource:struct<attributes:{_KV}>,scopeMetrics:array<struct<scope:struct<name:string,version:string>,metrics:array<struct<name:string,unit:string,description:string,gauge:struct<dataPoints:array<{_NUM}>>,sum:struct<dataPoints:array<{_NUM}>,aggregationTemporality:variant,isMonotonic:boolean>,histogram:struct<dataPoints:array<{_NUM}>,aggregationTemporality:variant>,summary:struct<dataPoints:array<{_NUM}>>,exponentialHistogram:struct<dataPoints:array<{_NUM}>,aggregationTemporality:variant>>>>>>>"
OTLP_LOGS = f"resourceLogs array<struct<resource:struct<attributes:{_KV}>,scopeLogs:array<struct<scope:struct<name:string,version:string>,logRecords:array<struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:variant,severityText:string,body:{_ANY},attributes:{_KV},traceId:string,spanId:string,flags:int,eventName:string,droppedAttributesCount:int>>>>>>"
OTLP_TRACES = f"resourceSpans array<struct<resource:struct<attributes:{_KV}>,scopeSpans:array<struct<scope:struct<name:string,version:string>,spans:array<struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:variant,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},status:struct<code:variant,message:string>,flags:int>>>>>>"


def otlp_value(v: Column) -> Column:
    """Typed value of an AnyValue."""
    get = lambda p, t: F.try_variant_get(v, p, t)
    return (
        F.when(get("$.stringValue", "string").isNotNull(), F.concat(F.lit("s"), get("$.stringValue", "string"))).when(get("$.intValue", "string").isNotNull(), F.concat(F.lit("i"), get("$.intValue", "string")))
        .when(get("$.doubleValue", "double").isNotNull(), F.concat(F.lit("f"), get("$.doubleValue", "double").cast("string"))).when(get("$.boolValue", "boolean").isNotNull(), F.concat(F.lit("b"), get("$.boolValue", "boolean").cast("string")))
        .when(get("$.bytesValue", "string").isNotNull(), F.concat(F.lit("x"), F.lower(F.hex(F.unbase64(get("$.bytesValue", "string"))))))
        .when(get("$.arrayValue", "variant").isNotNull(), F.concat(F.lit("a"), F.to_json(get("$.arrayValue.values", "variant")))).when(get("$.kvlistValue", "variant").isNotNull(), F.concat(F.lit("m"), F.to_json(get("$.kvlistValue.values", "variant")))).otherwise("n")
    )


def _kvs(a: Column) -> Column:
    none = F.create_map().cast("map<string,string>")
    return F.coalesce(V.from_pairs(F.transform(a, lambda e: e["key"]), F.transform(a, lambda e: otlp_value(e["value"]))), none)


def _temporality(c: Column) -> Column:
    t = F.to_json(c)
    return F.when(t.isin("1", '"AGGREGATION_TEMPORALITY_DELTA"'), "delta").when(t.isin("2", '"AGGREGATION_TEMPORALITY_CUMULATIVE"'), "cumulative")


def otlp_metrics(df: DataFrame, body: str = "body") -> DataFrame:
    """Metric rows (name, kind, attributes, resource, ...) of export requests."""
    d = df.select(*[c for c in df.columns if c != body], F.from_json(F.col(body), OTLP_METRICS).alias("j"))
    d = d.select(*[c for c in df.columns if c != body], F.explode_outer("j.resourceMetrics").alias("r")).withColumn("s", F.explode_outer("r.scopeMetrics")).withColumn("m", F.explode_outer("s.metrics"))
    tagged = lambda kind: F.transform(F.col(f"m.{kind}.dataPoints"), lambda p: F.struct(F.lit(kind).alias("kind"), p.alias("p")))
    none = F.array().cast(f"array<struct<kind:string,p:{_NUM}>>")
    d = d.withColumn("x", F.explode_outer(F.concat(*[F.coalesce(tagged(k), none) for k in ("gauge", "sum", "histogram", "summary", "exponentialHistogram")]))).where("x is not null")
    p = F.col("x.p")
    bounds = F.transform(F.concat(F.coalesce(p["explicitBounds"], F.array().cast("array<double>")), F.array(F.lit(float("inf")))), lambda b, i: F.struct(b.alias("bound"), p["bucketCounts"][i].cast("bigint").alias("count")))
    return d.select(
        *[c for c in df.columns if c != body], _kvs(F.col("r.resource.attributes")).alias("resource"), F.col("s.scope.name").alias("scope_name"), F.col("m.name").alias("name"), F.col("m.unit").alias("unit"), F.col("m.description").alias("description"), F.when(F.col("x.kind") == "exponentialHistogram", "exponential_histogram").otherwise(F.col("x.kind")).alias("kind"),
        _kvs(p["attributes"]).alias("attributes"), p["timeUnixNano"].try_cast("bigint").alias("ts_ns"), F.coalesce(p["startTimeUnixNano"].try_cast("bigint"), F.lit(0)).alias("start_ns"), F.coalesce(p["flags"], F.lit(0)).alias("flags"),
        F.coalesce(p["asDouble"], p["asInt"].try_cast("double")).alias("value"), p["asInt"].try_cast("bigint").alias("value_i64"), F.when(p["asInt"].isNotNull(), "i").when(p["asDouble"].isNotNull(), "f").alias("value_type"),
        F.coalesce(_temporality(F.col("m.sum.aggregationTemporality")), _temporality(F.col("m.histogram.aggregationTemporality")), _temporality(F.col("m.exponentialHistogram.aggregationTemporality"))).alias("temporality"), F.when(F.col("x.kind") == "sum", F.coalesce("m.sum.isMonotonic", F.lit(False))).alias("monotonic"),
        F.when((F.col("x.kind") == "histogram") & (F.size(p["bucketCounts"]) > 0), bounds).alias("buckets"), F.transform(p["quantileValues"], lambda q: F.struct(q["quantile"].alias("q"), q["value"].alias("v"))).alias("quantiles"), p["count"].try_cast("bigint").alias("count"), p["sum"].alias("sum"), p["min"].alias("min"), p["max"].alias("max"),
        F.when(p["scale"].isNotNull() | (F.col("x.kind") == "exponentialHistogram"), F.struct(
            F.coalesce(p["scale"], F.lit(0)).alias("scale"), F.coalesce(p["zeroCount"].try_cast("bigint"), F.lit(0)).alias("zero_count"), F.coalesce(p["zeroThreshold"], F.lit(0.0)).alias("zero_threshold"),
            *[x for n, k in (("pos_offset", "positive"), ("neg_offset", "negative")) for x in (F.coalesce(p[k]["offset"], F.lit(0)).alias(n), p[k]["bucketCounts"].try_cast("array<bigint>").alias(k))],
        )).alias("exp"),
    )


def severity_of(number: Column) -> Column:
    """Severity of an OTLP number: blocks of four from trace to fatal."""
    return F.when(number.between(1, 4), "trace").when(number.between(5, 8), "debug").when(number.between(9, 12), "info").when(number.between(13, 16), "warn").when(number.between(17, 20), "error").when(number.between(21, 24), "fatal")


def otlp_logs(df: DataFrame, body: str = "body") -> DataFrame:
    """Log rows of export requests."""
    rest = [c for c in df.columns if c != body]
    d = df.select(*rest, F.explode_outer(F.from_json(F.col(body), OTLP_LOGS)["resourceLogs"]).alias("r")).withColumn("s", F.explode_outer("r.scopeLogs")).withColumn("l", F.explode_outer("s.logRecords")).where("l is not null")
    v = otlp_value(F.col("l.body"))
    return d.select(*rest, _kvs(F.col("r.resource.attributes")).alias("resource"), F.coalesce(F.col("l.timeUnixNano").try_cast("bigint"), F.lit(0)).alias("ts_ns"), F.coalesce(F.col("l.observedTimeUnixNano").try_cast("bigint"), F.lit(0)).alias("observed_ns"),
                    F.coalesce(severity_of(F.try_variant_get("l.severityNumber", "$", "int")), F.lower("l.severityText")).alias("severity"), V.text(v).alias("message"), F.when(V.kind(v).isin("a", "m"), "structured").otherwise("raw").alias("body_format"), _kvs(F.col("l.attributes")).alias("attributes"),
                    F.nullif(F.lower("l.traceId"), F.lit("")).alias("trace_id"), F.nullif(F.lower("l.spanId"), F.lit("")).alias("span_id"), F.col("l.flags").alias("trace_flags"), F.col("l.eventName").alias("event_name"), F.coalesce("l.droppedAttributesCount", F.lit(0)).alias("dropped"))


def otlp_traces(df: DataFrame, body: str = "body") -> DataFrame:
    """Span rows of export requests."""
    rest = [c for c in df.columns if c != body]
    d = df.select(*rest, F.explode_outer(F.from_json(F.col(body), OTLP_TRACES)["resourceSpans"]).alias("r")).withColumn("s", F.explode_outer("r.scopeSpans")).withColumn("x", F.explode_outer("s.spans")).where("x is not null")
    kind, code = F.to_json("x.kind"), F.to_json("x.status.code")
    names = ["internal", "server", "client", "producer", "consumer"]
    k = F.lit("unspecified")
    for i, n in enumerate(names):
        k = F.when(kind.isin(str(i + 1), f'"SPAN_KIND_{n.upper()}"'), n).otherwise(k)
    return d.select(*rest, _kvs(F.col("r.resource.attributes")).alias("resource"), F.col("x.startTimeUnixNano").try_cast("bigint").alias("ts_ns"), F.col("x.endTimeUnixNano").try_cast("bigint").alias("end_ns"), F.lower("x.traceId").alias("trace_id"), F.lower("x.spanId").alias("span_id"),
                    F.nullif(F.lower("x.parentSpanId"), F.lit("")).alias("parent_span_id"), F.col("x.name").alias("name"), k.alias("kind"), F.when(code.isin("1", '"STATUS_CODE_OK"'), "ok").when(code.isin("2", '"STATUS_CODE_ERROR"'), "error").otherwise("unset").alias("status"), F.col("x.flags").alias("flags"), _kvs(F.col("x.attributes")).alias("attributes"))


def to_otlp_attributes(m: Column) -> Column:
    """JSON array of key-value pairs."""
    one = lambda v: F.when(V.kind(v) == "s", F.concat(F.lit('{"stringValue":'), _q(V.text(v)), F.lit("}"))).when(V.kind(v).isin("i", "u"), F.concat(F.lit('{"intValue":'), _q(V.text(v)), F.lit("}"))).when(V.kind(v) == "f", F.concat(F.lit('{"doubleValue":'), V.text(v), F.lit("}"))).when(V.kind(v) == "b", F.concat(F.lit('{"boolValue":'), V.text(v), F.lit("}"))).otherwise(F.concat(F.lit('{"stringValue":'), _q(V.text(v)), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit('{"key":'), _q(e["key"]), F.lit(',"value":'), one(e["value"]), F.lit("}"))), ","), F.lit("]"))


def to_otlp_metrics(m: DataFrame) -> DataFrame:
    """One export request per row of a scalar metric."""
    point = _object([("attributes", to_otlp_attributes(F.col("attributes"))), ("timeUnixNano", _q(F.col("ts_ns"))), ("startTimeUnixNano", F.when(F.col("start_ns") != 0, _q(F.col("start_ns")))), ("asInt", F.when(F.col("value_type") == "i", _q(F.col("value").cast("bigint")))), ("asDouble", F.when(F.coalesce("value_type", F.lit("f")) != "i", _f(F.col("value"))))])
    body = F.when(F.col("kind") == "sum", F.concat(F.lit('"sum":{"dataPoints":['), point, F.lit('],"aggregationTemporality":'), F.when(F.col("temporality") == "delta", "1").otherwise("2"), F.lit(',"isMonotonic":'), F.coalesce(F.col("monotonic").cast("string"), F.lit("false")), F.lit("}"))).otherwise(F.concat(F.lit('"gauge":{"dataPoints":['), point, F.lit("]}")))
    return m.select("_seq", F.concat(F.lit('{"resourceMetrics":[{"resource":{"attributes":'), to_otlp_attributes(F.col("resource")), F.lit('},"scopeMetrics":[{"scope":{},"metrics":[{"name":'), _q(F.col("name")), F.when(F.col("unit").isNotNull(), F.concat(F.lit(',"unit":'), _q(F.col("unit")))).otherwise(""), F.lit(","), body, F.lit("}]}]}]}")).alias("body"))


def _request(outer: str, inner: str, item: str, record: Column) -> Column:
    """An export request of one record: resource, one scope, the record."""
    return F.concat(F.lit(f'{{"{outer}":[{{"resource":{{"attributes":'), to_otlp_attributes(F.col("resource")), F.lit(f'}},"{inner}":[{{"scope":{{}},"{item}":['), record, F.lit("]}]}]}"))


def to_otlp_logs(events: DataFrame) -> DataFrame:
    """One export request per event with a log."""
    log = F.col("log")
    number = F.element_at(F.create_map(*[F.lit(x) for s, n in (("trace", 1), ("debug", 5), ("info", 9), ("warn", 13), ("error", 17), ("fatal", 21)) for x in (s, n)]), log["severity"])
    record = _object([
        ("timeUnixNano", _q(F.col("ts_ns"))), ("observedTimeUnixNano", F.when(log["observed_ns"] != 0, _q(log["observed_ns"]))), ("severityNumber", F.when(log["severity"].isNotNull(), number.cast("string"))),
        ("body", F.when(log["message"].isNotNull(), F.concat(F.lit('{"stringValue":'), _q(log["message"]), F.lit("}")))), ("attributes", to_otlp_attributes(F.coalesce("attributes", F.create_map().cast("map<string,string>")))),
        ("traceId", F.when(log["trace_id"].isNotNull(), _q(log["trace_id"]))), ("spanId", F.when(log["span_id"].isNotNull(), _q(log["span_id"]))), ("flags", log["trace_flags"].cast("string")), ("eventName", F.when(log["event_name"].isNotNull(), _q(log["event_name"]))),
    ])
    return events.where("log is not null").select("_seq", _request("resourceLogs", "scopeLogs", "logRecords", record).alias("body"))


def to_otlp_traces(events: DataFrame) -> DataFrame:
    """One export request per event with a span; the event's time is the span's start."""
    span = F.col("span")
    code = lambda names, c: F.element_at(F.create_map(*[F.lit(x) for i, s in enumerate(names) for x in (s, i)]), F.coalesce(c, F.lit(names[0]))).cast("string")
    record = _object([
        ("traceId", _q(span["trace_id"])), ("spanId", _q(span["span_id"])), ("parentSpanId", F.when(span["parent_span_id"].isNotNull(), _q(span["parent_span_id"]))), ("name", _q(F.coalesce(span["name"], F.lit("")))),
        ("kind", code(["unspecified", "internal", "server", "client", "producer", "consumer"], span["kind"])), ("startTimeUnixNano", _q(F.col("ts_ns"))), ("endTimeUnixNano", F.when(span["end_ns"].isNotNull(), _q(span["end_ns"]))),
        ("attributes", to_otlp_attributes(F.coalesce("attributes", F.create_map().cast("map<string,string>")))), ("status", F.concat(F.lit('{"code":'), code(["unset", "ok", "error"], span["status"]), F.lit("}"))), ("flags", span["flags"].cast("string")),
    ])
    return events.where("span is not null").select("_seq", _request("resourceSpans", "scopeSpans", "spans", record).alias("body"))


# -- other intakes ---------------------------------------------------------------------------------

HEC = "struct<time:variant,host:string,source:string,sourcetype:string,index:string,event:variant,fields:map<string,variant>>"


def hec(df: DataFrame, body: str = "body") -> DataFrame:
    """Log and metric rows of HEC bodies: an array, or objects one after another."""
    text = F.btrim(F.col(body), F.lit(" \t\r\n"))
    joined = F.when(text.startswith("["), text).otherwise(F.concat(F.lit("["), F.regexp_replace(text, r"\}\s*\{(?=\s*\"(?:time|host|source|sourcetype|index|event|fields)\")", "},{"), F.lit("]")))
    rest = [c for c in df.columns if c != body]
    d = df.select(*rest, F.posexplode_outer(F.from_json(joined, f"array<{HEC}>")).alias("_pos", "o")).where("o is not null")
    t = F.coalesce(F.try_variant_get("o.time", "$", "string"), F.to_json("o.time"))
    res = F.create_map(*[x for k, c in (("host.name", "host"), ("hec.source", "source"), ("hec.sourcetype", "sourcetype"), ("hec.index", "index")) for x in (F.lit(k), V.s(F.col(f"o.{c}")))])
    fields = F.coalesce("o.fields", F.create_map().cast("map<string,variant>"))
    metrics = F.transform(F.filter(F.map_entries(fields), lambda e: e["key"].startswith("metric_name:")), lambda e: F.struct(F.substr(e["key"], F.lit(13)).alias("name"), F.try_variant_get(e["value"], "$", "double").alias("value")))
    return d.select(*rest, "_pos", V.decimal_nanos(t).alias("ts_ns"), F.map_filter(res, lambda _, v: v.isNotNull()).alias("resource"), F.transform_values(F.map_filter(fields, lambda k, _: ~k.startswith("metric_name:") & ~k.isin("_value", "metric_name")), lambda _, v: json_value(v)).alias("attributes"),
                    F.when(F.schema_of_variant("o.event") == "STRING", F.try_variant_get("o.event", "$", "string")).otherwise(F.to_json("o.event")).alias("message"),
                    F.when(F.map_contains_key(fields, F.lit("metric_name")), F.array(F.struct(F.try_variant_get(fields["metric_name"], "$", "string").alias("name"), F.try_variant_get(fields["_value"], "$", "double").alias("value")))).otherwise(metrics).alias("metrics"))


def to_hec(events: DataFrame) -> DataFrame:
    """One HEC object per log event; the event's host goes before the resource's."""
    host = F.coalesce(F.nullif(V.text(F.col("attributes")["host.name"]), F.lit("")), V.text(F.col("resource")["host.name"]))
    secs = F.concat(F.expr("ts_ns div 1000000000").cast("string"), F.lit("."), F.lpad(F.pmod("ts_ns", F.lit(1_000_000_000)).cast("string"), 9, "0"))
    rest = F.map_filter("attributes", lambda k, _: k != "host.name")
    return events.where("log is not null").select("_seq", _object([("time", secs), ("host", F.when(host.isNotNull(), _q(host))), ("event", _q(F.coalesce("log.message", F.lit("")))), ("fields", map_json(rest))]).alias("body"))


SERIES_V1 = "series array<struct<metric:string,points:array<array<double>>,type:string,host:string,tags:array<string>,interval:bigint,unit:string>>"
SERIES_V2 = "series array<struct<metric:string,type:int,points:array<struct<timestamp:bigint,value:double>>,tags:array<string>,unit:string,interval:bigint,resources:array<struct<type:string,name:string>>>>"


def series_v1(df: DataFrame, body: str = "body") -> DataFrame:
    """Metric rows of series bodies of the first version: points are [time, value] in seconds."""
    from strandline.sources.text import tag_map

    rest = [c for c in df.columns if c != body]
    d = df.select(*rest, F.explode_outer(F.from_json(F.col(body), SERIES_V1)["series"]).alias("s")).select(*rest, "s", F.explode_outer("s.points").alias("p")).where("p is not null")
    host = F.map_filter(F.create_map(F.lit("host.name"), V.s(F.nullif("s.host", F.lit("")))), lambda _, v: v.isNotNull())
    return d.select(*rest, F.col("s.metric").alias("name"), F.when(F.coalesce("s.type", F.lit("gauge")) == "count", "sum").otherwise("gauge").alias("kind"), F.when(F.col("s.type") == "count", "delta").alias("temporality"), F.col("s.unit").alias("unit"), F.col("s.interval").alias("interval_s"), (F.col("p")[0] * 1e9).cast("bigint").alias("ts_ns"), F.col("p")[1].alias("value"), V.merge(tag_map(F.coalesce("s.tags", F.array().cast("array<string>"))), host).alias("attributes"))


def series_v2(df: DataFrame, body: str = "body") -> DataFrame:
    """Metric rows of series bodies of the second version; type 1 is a count, 2 a rate, 3 a gauge."""
    from strandline.sources.text import tag_map

    rest = [c for c in df.columns if c != body]
    d = df.select(*rest, F.explode_outer(F.from_json(F.col(body), SERIES_V2)["series"]).alias("s")).select(*rest, "s", F.explode_outer("s.points").alias("p")).where("p is not null")
    host = F.get(F.transform(F.filter("s.resources", lambda r: r["type"] == "host"), lambda r: r["name"]), F.lit(0))
    hosts = F.map_filter(F.create_map(F.lit("host.name"), V.s(host)), lambda _, v: v.isNotNull())
    return d.select(*rest, F.col("s.metric").alias("name"), F.when(F.col("s.type") == 1, "sum").otherwise("gauge").alias("kind"), F.when(F.col("s.type") == 1, "delta").alias("temporality"), F.col("s.unit").alias("unit"), F.col("s.interval").alias("interval_s"), (F.col("p.timestamp") * F.lit(1_000_000_000).cast("bigint")).alias("ts_ns"), F.col("p.value").alias("value"), V.merge(tag_map(F.coalesce("s.tags", F.array().cast("array<string>"))), hosts).alias("attributes"))


def to_series_v2(m: DataFrame) -> DataFrame:
    """One series body per scalar row."""
    tags = F.transform(F.array_sort(F.map_entries(F.map_filter("attributes", lambda k, _: k != "host.name"))), lambda e: F.when(e["value"] == "btrue", e["key"]).otherwise(F.concat(e["key"], F.lit(":"), V.text(e["value"]))))
    host = V.text(F.col("attributes")["host.name"])
    one = _object([("metric", _q(F.col("name"))), ("type", F.when(F.col("kind") == "sum", "1").otherwise("3")), ("points", F.concat(F.lit('[{"timestamp":'), F.expr("ts_ns div 1000000000").cast("string"), F.lit(',"value":'), _f(F.col("value")), F.lit("}]"))), ("tags", F.to_json(tags)), ("resources", F.when(host.isNotNull(), F.concat(F.lit('[{"type":"host","name":'), _q(host), F.lit("}]"))))])
    return m.select("_seq", F.concat(F.lit('{"series":['), one, F.lit("]}")).alias("body"))


SERIES_DISTRIBUTION = "series array<struct<metric:string,points:array<variant>,host:string,tags:array<string>>>"


def distribution_points(df: DataFrame, body: str = "body") -> DataFrame:
    """Samples rows of distribution bodies: points are [time, [values]]."""
    from strandline.sources.text import tag_map

    rest = [c for c in df.columns if c != body]
    d = df.select(*rest, F.explode_outer(F.from_json(F.col(body), SERIES_DISTRIBUTION)["series"]).alias("s")).select(*rest, "s", F.explode_outer("s.points").alias("p")).where("p is not null")
    host = F.map_filter(F.create_map(F.lit("host.name"), V.s(F.col("s.host"))), lambda _, v: v.isNotNull())
    at, vals = F.try_variant_get("p", "$[0]", "double"), F.try_variant_get("p", "$[1]", "array<double>")
    return d.select(*rest, F.col("s.metric").alias("name"), F.lit("samples").alias("kind"), (at * 1e9).cast("bigint").alias("ts_ns"), vals.alias("samples"), F.lit(1.0).alias("sample_rate"), V.merge(tag_map(F.coalesce("s.tags", F.array().cast("array<string>"))), host).alias("attributes")).where("ts_ns is not null and samples is not null")


_EVENT_BODY = "title string, text string, date_happened bigint, priority string, alert_type string, host string, tags array<string>, aggregation_key string, source_type_name string"
_CHECK_BODY = "check string, host_name string, status int, timestamp bigint, message string, tags array<string>"


def event_posts(df: DataFrame, body: str = "body") -> DataFrame:
    """Log rows of event bodies; a body without title and text is left out."""
    from strandline.sources.text import tag_map

    rest = [c for c in df.columns if c != body]
    d = df.select(*rest, F.from_json(F.col(body), _EVENT_BODY).alias("e")).where("e.title is not null or e.text is not null")
    own = {"event.title": "title", "event.priority": "priority", "event.alert_type": "alert_type", "event.aggregation_key": "aggregation_key", "event.source_type": "source_type_name", "host.name": "host"}
    known = F.map_filter(F.create_map(*[x for k, c in own.items() for x in (F.lit(k), V.s(F.col(f"e.{c}")))]), lambda _, v: v.isNotNull())
    kind = F.col("e.alert_type")
    severity = F.when(kind == "error", "error").when(kind == "warning", "warn").when(kind.isNotNull(), "info")
    return d.select(*rest, F.col("e.text").alias("message"), severity.alias("severity"), (F.col("e.date_happened") * 1_000_000_000).alias("ts_ns"), V.merge(tag_map(F.coalesce("e.tags", F.array().cast("array<string>"))), known).alias("attributes"))


def check_runs(df: DataFrame, body: str = "body") -> DataFrame:
    """Log rows of service-check bodies, an object or an array of them; a status beyond 3 is left out."""
    from strandline.sources.text import tag_map

    t = F.btrim(F.col(body))
    rest = [c for c in df.columns if c != body]
    d = df.select(*rest, F.explode_outer(F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), f"array<struct<{_CHECK_BODY.replace(' string', ':string').replace(' bigint', ':bigint').replace(' int', ':int').replace(' array', ':array').replace(', ', ',')}>>")).alias("c"))
    d = d.where("c.check is not null and c.status between 0 and 3")
    known = F.map_filter(F.create_map(F.lit("service_check.name"), V.s(F.col("c.check")), F.lit("service_check.status"), F.concat(F.lit("u"), F.col("c.status").cast("string")), F.lit("service_check.message"), V.s(F.col("c.message")), F.lit("host.name"), V.s(F.col("c.host_name"))), lambda _, v: v.isNotNull())
    return d.select(*rest, F.lit(None).cast("string").alias("message"), (F.col("c.timestamp") * 1_000_000_000).alias("ts_ns"), V.merge(tag_map(F.coalesce("c.tags", F.array().cast("array<string>"))), known).alias("attributes"))


def log_intake(df: DataFrame, body: str = "body") -> DataFrame:
    """Log rows of a log-intake body: an object or an array with message, ddtags, hostname, service, status."""
    from strandline.sources.text import tag_map

    t = F.btrim(F.col(body))
    rest = [c for c in df.columns if c != body]
    d = df.select(*rest, F.explode_outer(F.from_json(F.when(t.startswith("["), t).otherwise(F.concat(F.lit("["), t, F.lit("]"))), "array<map<string,variant>>")).alias("o")).where("o is not null")
    g = lambda k: F.try_variant_get(F.col("o")[k], "$", "string")
    known = F.map_filter(F.create_map(F.lit("host.name"), V.s(g("hostname")), F.lit("service.name"), V.s(g("service")), F.lit("log.source"), V.s(g("ddsource"))), lambda _, v: v.isNotNull())
    own = F.transform_values(F.map_filter("o", lambda k, _: ~k.isin("message", "ddtags", "hostname", "service", "status", "ddsource", "timestamp")), lambda _, v: json_value(v))
    status = F.lower(g("status"))
    severity = F.when(status.isin("emergency", "emerg", "alert", "critical", "crit", "fatal"), "fatal").when(status.isin("error", "err"), "error").when(status.isin("warning", "warn"), "warn").when(status.isin("debug"), "debug").when(status == "trace", "trace").when(status.isNotNull(), "info")
    return d.select(*rest, g("message").alias("message"), severity.alias("severity"), (F.try_variant_get(F.col("o")["timestamp"], "$", "bigint") * 1_000_000).alias("ts_ns"), V.merge(V.merge(tag_map(F.split(F.coalesce(g("ddtags"), F.lit("")), ",")), own), known).alias("attributes"))


def docker_logs(df: DataFrame, line: str = "line") -> DataFrame:
    """Rows of a container engine's JSON log files; parts up to a newline are one message per ``stream`` of a file."""
    d = df.withColumn("j", F.from_json(F.col(line), "log string, stream string, time string, attrs map<string,string>")).where("j.log is not null")
    by = [c for c in ("file",) if c in df.columns] + ["stream"]
    d = d.select(*[c for c in df.columns if c != line], F.col("j.stream").alias("stream"), rfc3339_ns(F.col("j.time")).alias("ts_ns"), F.col("j.log").alias("text"), F.transform_values(F.coalesce("j.attrs", F.create_map().cast("map<string,string>")), lambda _, v: V.s(v)).alias("attributes"))
    # ends of messages before a line number its message; counted in pieces, so no task holds a stream
    d = d.withColumns({"_ends": F.col("text").endswith("\n").cast("int"), "_chunk": F.expr("_seq div 1000000")})
    d = bucketed_prefix(d, by, "_chunk", ["_seq"], "_ends", "_e")
    return d.groupBy(*by, "_e").agg(F.min("_seq").alias("_seq"), F.min_by("ts_ns", "_seq").alias("ts_ns"), F.min_by("attributes", "_seq").alias("attributes"), F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "text"))), lambda x: x["text"]), ""), "\n$", "").alias("message")).drop("_e")
