"""Queries of wire formats, sources and sinks, graphs, user functions and streams, each with its SQL where there is one.

Formats that the tables don't hold are written from them first, by the engine's own
encoders or in text, and read back, so that SQL over the tables gives the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import ids
from strandline.functions import values as V
from strandline.functions.shared import micros, read, scratch
from strandline.operators import aggregate as A
from strandline.operators import delta, filters, http_access, late_events, parsers, reshape, route, script, shape
from strandline.operators.reshape import metric
from strandline.plans import graph
from strandline.queries.engine import HOUR, _a, _histograms, _mixed, _NOW, _orders, _ts, _two, _w, as_event, attrs, events, query
from strandline.sources import binary, io, json_formats, text
from strandline.streaming import windows

_NS = "epoch_us(ts)*1000"


def _scalars(spark: SparkSession, d: str) -> DataFrame:
    """Metric rows of the events: gauges and delta sums in turn."""
    e = read(spark, d, "events")
    even = F.col("event_id") % 2 == 0
    none = lambda t: F.lit(None).cast(t)
    return e.select(
        F.col("event_id").alias("_seq"), _ts().alias("ts_ns"), F.lit(0).cast("bigint").alias("start_ns"), F.lit("app.value").alias("name"), F.when(even, "gauge").otherwise("sum").alias("kind"),
        F.when(even, F.round("value", 2)).otherwise(F.col("user_id").cast("double")).alias("value"), F.when(even, none("bigint")).otherwise(F.col("user_id").cast("bigint")).alias("value_i64"), F.when(even, "f").otherwise("i").alias("value_type"),
        F.when(~even, "delta").alias("temporality"), F.when(~even, F.lit(True)).alias("monotonic"), F.lit("ms").alias("unit"), attrs(type=V.s(F.col("event_type")), **{"host.name": V.s(F.concat(F.lit("h"), F.col("user_id") % 3))}).alias("attributes"),
        F.create_map(F.lit("service.name"), F.lit("sweb")).alias("resource"), F.lit(None).cast("array<struct<bound:double,count:bigint>>").alias("buckets"), none("double").alias("sum"),
    )


_SCALAR = "select event_id, event_type, case when event_id%2=0 then 'gauge' else 'sum' end kind, case when event_id%2=0 then round(value, 2) else user_id::double end v"


def _scalar(m: DataFrame, seq: str = "_seq") -> DataFrame:
    return m.select(F.col(seq).alias("event_id"), _a("type").alias("event_type"), "kind", F.col("value").alias("v"), "ts_ns")


# -- JSON formats ---------------------------------------------------------------------------------


@query(f"select event_id, {_NS} ts_ns, event_type, cast(user_id as varchar) user_id, props message, value level, 5 metrics from events")
def ndjson_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Events archived as JSON lines and replayed."""
    lines = json_formats.write_archive(events(spark, d))
    e = json_formats.read_archive(lines)
    level = F.filter("metrics", lambda m: m["name"] == "app.level")[0]["value"]
    return e.select(F.col("_seq").alias("event_id"), "ts_ns", _a("event_type"), _a("user_id"), F.col("log.message").alias("message"), level.alias("level"), F.size("metrics").alias("metrics"))


@query(f"{_SCALAR}, {_NS} ts_ns from events")
def otlp_json_metrics_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Export requests of sums and gauges as JSON."""
    return _scalar(json_formats.otlp_metrics(json_formats.to_otlp_metrics(_scalars(spark, d))))


@query(f"select event_id, {_NS} ts_ns, event_type, case when event_type = 'error' then 'error' else 'info' end severity, props message from events")
def otlp_json_logs_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Export requests of logs as JSON."""
    r = json_formats.otlp_logs(json_formats.to_otlp_logs(events(spark, d)))
    return r.select(F.col("_seq").alias("event_id"), "ts_ns", _a("event_type"), "severity", "message")


@query("select o_orderkey, lpad(printf('%x', o_orderkey), 32, '0') trace, lpad(printf('%x', o_custkey), 16, '0') span, o_orderpriority \"name\", case when o_orderstatus = 'F' then 'error' else 'ok' end status, epoch_us(o_orderdate)*1000 start_ns, epoch_us(o_orderdate)*1000 + o_orderkey end_ns from orders")
def otlp_json_traces_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Export requests of spans as JSON."""
    hexes = lambda c, n: F.lpad(F.lower(F.hex(F.col(c))), n, "0")
    e = _orders(spark, d, F.lit("m"))
    o = read(spark, d, "orders")
    span = F.struct(hexes("o_orderkey", 32).alias("trace_id"), hexes("o_custkey", 16).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"), F.col("o_orderpriority").alias("name"), F.lit("server").alias("kind"),
                    F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"), (_ts("o_orderdate") + F.col("o_orderkey")).alias("end_ns"), F.lit(1).alias("flags"))
    e = as_event(o.withColumn("span_", span), F.col("o_orderkey"), _ts("o_orderdate"), extra=["span_"]).drop("span").withColumnRenamed("span_", "span")
    r = json_formats.otlp_traces(json_formats.to_otlp_traces(e))
    return r.select(F.col("_seq").alias("o_orderkey"), F.col("trace_id").alias("trace"), F.col("span_id").alias("span"), "name", "status", F.col("ts_ns").alias("start_ns"), "end_ns")


@query(f"select event_id, {_NS} ts_ns, event_type, props message from events")
def hec_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Event-collector bodies, time to the nanosecond."""
    r = json_formats.hec(json_formats.to_hec(events(spark, d)))
    return r.select(F.col("_seq").alias("event_id"), "ts_ns", _a("event_type"), "message")


@query(f"{_SCALAR}, epoch_us(date_trunc('second', ts))*1000 ts_ns, 'h' || (user_id % 3) host from events")
def series_v2_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Series bodies with host resources and tags."""
    r = json_formats.series_v2(json_formats.to_series_v2(_scalars(spark, d)))
    return _scalar(r.withColumn("kind", F.col("kind"))).join(r.select(F.col("_seq").alias("event_id"), _a("host.name").alias("host")), "event_id")


@query("select o_orderkey, 'count' \"type\", o_orderkey*1000000000 ts_ns, v, 'p' || o_orderstatus status from orders, (values (0), (1)) x(i), lateral (select case when i = 0 then o_totalprice else o_custkey::double end v)")
def series_v1_decode(spark: SparkSession, d: str) -> DataFrame:
    """Series bodies of the first version: two points each."""
    o = read(spark, d, "orders")
    point = lambda c: F.concat(F.lit("["), F.col("o_orderkey").cast("string"), F.lit(","), F.col(c).cast("string"), F.lit("]"))
    body = F.concat(F.lit('{"series":[{"metric":"m","type":"count","points":['), point("o_totalprice"), F.lit(","), point("o_custkey"), F.lit('],"tags":["status:p'), F.col("o_orderstatus"), F.lit('"]}]}'))
    r = json_formats.series_v1(o.select("o_orderkey", body.alias("body")))
    return r.select("o_orderkey", F.when(F.col("temporality") == "delta", "count").alias("type"), "ts_ns", F.col("value").alias("v"), _a("status"))


@query("select o_orderkey, o_orderpriority message, case o_orderstatus when 'F' then 'error' when 'O' then 'warn' else 'debug' end severity, 'web' service, o_custkey::varchar cust from orders")
def log_intake_decode(spark: SparkSession, d: str) -> DataFrame:
    """Log-intake bodies with tags, service and status."""
    status = F.when(F.col("o_orderstatus") == "F", "err").when(F.col("o_orderstatus") == "O", "WARNING").otherwise("debug")
    body = F.to_json(F.array(F.struct(F.col("o_orderpriority").alias("message"), status.alias("status"), F.lit("web").alias("service"), F.concat(F.lit("cust:"), F.col("o_custkey").cast("string")).alias("ddtags"))))
    r = json_formats.log_intake(read(spark, d, "orders").select("o_orderkey", body.alias("body")))
    return r.select("o_orderkey", "message", "severity", _a("service.name").alias("service"), _a("cust"))


@query("select event_id, event_type || '-' || event_id message, epoch_us(date_trunc('second', ts))*1000 ts_ns from events")
def docker_reassemble(spark: SparkSession, d: str) -> DataFrame:
    """Container log lines in JSON, each message in two parts."""
    e = read(spark, d, "events")
    at = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    part = lambda n, c: F.struct((F.col("event_id") * 2 + n).alias("_seq"), F.to_json(F.struct(c.alias("log"), F.lit("stdout").alias("stream"), at.alias("time"))).alias("line"))
    lines = e.select(F.inline(F.array(part(0, F.col("event_type")), part(1, F.concat(F.lit("-"), F.col("event_id").cast("string"), F.lit("\n"))))))
    r = json_formats.docker_logs(lines)
    return r.select(F.regexp_extract("message", r"-(\d+)$", 1).cast("bigint").alias("event_id"), "message", "ts_ns")


# -- binary formats -------------------------------------------------------------------------------


@query(f"{_SCALAR}, {_NS} ts_ns, case when event_id%2=1 then user_id end i from events")
def otlp_protobuf_metrics_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Binary export requests; integers stay integers."""
    r = binary.read(binary.to_otlp_metrics(_scalars(spark, d)), "otlp_metrics")
    return r.select(F.col("_seq").alias("event_id"), _a("type").alias("event_type"), "kind", F.col("value").alias("v"), "ts_ns", F.col("value_i64").alias("i"))


@query(f"select event_id, 'load.load' \"name\", 'h' || (user_id % 3) host, value v, {_NS} ts_ns from events")
def collectd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Datagrams of value lists; times come in 2^-30 s and are read to the nearest microsecond."""
    e = read(spark, d, "events").select("event_id", F.concat(F.lit("h"), F.col("user_id") % 3).alias("host"), "value", _ts().alias("ts_ns"))
    one = lambda r: binary.collectd_datagram([{"host": r["host"], "plugin": "load", "type": "load", "ts_ns": r["ts_ns"], "values": [(1, r["value"])]}])
    r = binary.read(binary.encode(e, ["event_id"], one), "collectd")
    return r.select("event_id", "name", _a("host.name").alias("host"), F.col("value").alias("v"), F.expr("(ts_ns + 500) div 1000 * 1000").alias("ts_ns"))


@query("select event_id, event_type, user_id::varchar user_id, value v from events")
def msgpack_decode(spark: SparkSession, d: str) -> DataFrame:
    """Maps that follow one another in msgpack bodies."""
    e = read(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    r = binary.read(binary.encode(e, ["event_id"], lambda r: binary.pack({"event_type": r["event_type"], "user_id": r["user_id"], "value": r["value"]})), "msgpack")
    return r.select("event_id", _a("event_type"), _a("user_id"), _a("value").cast("double").alias("v"))


@query("select o_orderkey, lpad(printf('%x', o_custkey), 16, '0') span, o_orderpriority \"name\", epoch_us(o_orderdate)*1000 ts_ns, epoch_us(o_orderdate)*1000 + o_orderkey end_ns, case when o_orderstatus = 'F' then 1 else 0 end error from orders")
def tracer_decode(spark: SparkSession, d: str) -> DataFrame:
    """Tracer bodies: a trace of one span each."""
    o = read(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", _ts("o_orderdate").alias("at"), (F.col("o_orderstatus") == "F").cast("int").alias("bad"))
    span = lambda r: {"service": "s", "name": r["o_orderpriority"], "resource": "r", "trace_id": r["o_orderkey"], "span_id": r["o_custkey"], "parent_id": 0, "start": r["at"], "duration": r["o_orderkey"], "error": r["bad"], "meta": {}, "metrics": {}, "type": "web"}
    r = binary.read(binary.encode(o, ["o_orderkey"], lambda r: binary.pack([[span(r)]])), "tracer")
    return r.select("o_orderkey", F.col("span_id").alias("span"), "name", "ts_ns", "end_ns", "error")


@query("select event_id, 'app.value' \"name\", event_type, value v, epoch_us(date_trunc('second', ts))*1000 ts_ns from events")
def graphite_pickle_decode(spark: SparkSession, d: str) -> DataFrame:
    """Length-prefixed pickled lists of points."""
    import pickle
    import struct

    def body(r: dict) -> bytes:
        data = pickle.dumps([(f"app.value;type={r['event_type']}", (r["at"], r["value"]))], 2)
        return struct.pack(">I", len(data)) + data
    e = read(spark, d, "events").select("event_id", "event_type", "value", F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("at"))
    r = binary.read(binary.encode(e, ["event_id"], body), "graphite_pickle")
    return r.select("event_id", "name", _a("type").alias("event_type"), F.col("value").alias("v"), "ts_ns")


# -- text formats ---------------------------------------------------------------------------------


@query("select event_type, count(*) filter (value <= 10) b10, count(*) filter (value > 10 and value <= 100) b100, count(*) filter (value > 100) rest, round(sum(value), 4) total, count(*) n from events group by 1")
def prometheus_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative buckets of the exposition format as histograms."""
    e = read(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") <= 10).alias("a"), F.count_if(F.col("value") <= 100).alias("b"), F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"))
    row = lambda name, le, c: F.concat(F.lit(f'app_value_{name}{{type="'), F.col("event_type"), F.lit(f'"{le}}} '), F.col(c).cast("string"))
    lines = e.select(F.explode(F.array(F.lit("# TYPE app_value histogram"), row("bucket", ',le="10"', "a"), row("bucket", ',le="100"', "b"), row("bucket", ',le="+Inf"', "n"), row("sum", "", "s"), row("count", "", "n"))).alias("line"))
    h = text.prometheus_histograms(text.prometheus(lines.select("line", F.lit(1).cast("bigint").alias("_seq"), F.lit(5).cast("bigint").alias("ts_ns"))))
    b = lambda i: F.col("buckets")[i]["count"]
    return h.select(_a("type").alias("event_type"), b(0).alias("b10"), b(1).alias("b100"), b(2).alias("rest"), F.round("sum", 4).alias("total"), F.col("count").alias("n"))


@query("""select o_orderkey, n "name", v::double v from orders, lateral (values ('nginx.connections_current', o_custkey), ('nginx.connections_accepted', o_orderkey), ('nginx.connections_handled', o_orderkey), ('nginx.http.requests', o_orderkey + o_custkey),
('nginx.connections_reading', 1), ('nginx.connections_writing', 2), ('nginx.connections_waiting', o_custkey % 5)) x(n, v)""")
def nginx_status_pages(spark: SparkSession, d: str) -> DataFrame:
    """Stub-status pages as metrics."""
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    page = F.concat(F.lit("Active connections: "), c, F.lit(" \nserver accepts handled requests\n "), k, F.lit(" "), k, F.lit(" "), (F.col("o_orderkey") + F.col("o_custkey")).cast("string"), F.lit(" \nReading: 1 Writing: 2 Waiting: "), (F.col("o_custkey") % 5).cast("string"), F.lit(" \n"))
    r = text.nginx_status(read(spark, d, "orders").select(F.col("o_orderkey").alias("_seq"), F.lit(0).cast("bigint").alias("ts_ns"), page.alias("page")))
    return r.select(F.col("_seq").alias("o_orderkey"), "name", F.col("value").alias("v"))


@query("select o_orderkey, n \"name\", v::double v from orders, lateral (values ('apache.total_accesses', o_orderkey::double), ('apache.reqpersec', o_custkey/4.0)) x(n, v)")
def apache_status_pages(spark: SparkSession, d: str) -> DataFrame:
    """Machine-readable status pages; the scoreboard is no number."""
    page = F.concat(F.lit("Total Accesses: "), F.col("o_orderkey").cast("string"), F.lit("\nScoreboard: __W_\nReqPerSec: "), (F.col("o_custkey") / 4).cast("string"), F.lit("\n"))
    r = text.apache_status(read(spark, d, "orders").select(F.col("o_orderkey").alias("_seq"), F.lit(0).cast("bigint").alias("ts_ns"), page.alias("page")))
    return r.select(F.col("_seq").alias("o_orderkey"), "name", F.col("value").alias("v"))


@query("""select event_id, case when event_id%3=0 then 'event' else 'check' end what, case when event_id%3=0 then event_type end title, case when event_id%3=0 then case when event_id%2=0 then 'error' else 'info' end end severity,
case when event_id%3=0 then 'line ' || event_id || chr(10) || 'more' else null end message, case when event_id%3=0 then null else (event_id%4)::varchar end status, 'u' || user_id team from events where event_id%3 <> 2""")
def statsd_events_and_checks(spark: SparkSession, d: str) -> DataFrame:
    """Events and service checks as logs; lengths that don't fit reject the line."""
    e, k = read(spark, d, "events"), F.col("event_id")
    said = F.concat(F.lit("line "), k.cast("string"), F.lit("\\nmore"))
    size = lambda c: F.octet_length(c).cast("string")
    tags = F.concat(F.lit("|#team:u"), F.col("user_id").cast("string"))
    event = F.concat(F.lit("_e{"), size(F.col("event_type")), F.lit(","), size(said), F.lit("}:"), F.col("event_type"), F.lit("|"), said, F.when(k % 2 == 0, "|t:error").otherwise("|t:success"), tags)
    check = F.concat(F.lit("_sc|app.up|"), (k % 4).cast("string"), tags, F.lit("|m:fine"))
    bad = F.concat(F.lit("_e{99,5}:"), F.col("event_type"), F.lit("|short"))
    r = text.statsd_logs(e.select(k.alias("_seq"), _ts().alias("ts_ns"), F.when(k % 3 == 0, event).when(k % 3 == 1, check).otherwise(bad).alias("line")))
    own = lambda n: V.text(F.col("attributes")["_sl.statsd." + n])
    return r.select(F.col("_seq").alias("event_id"), F.when(own("event.title").isNotNull(), "event").otherwise("check").alias("what"), own("event.title").alias("title"), "severity", "message", own("service_check.status").alias("status"), _a("team"))


@query("select record_id, syslog_tag tag, message, 'a\"b]' || record_id quoted, syslog_facility::varchar facility from syslog_records")
def syslog_structured_data(spark: SparkSession, d: str) -> DataFrame:
    """Structured data with escaped quotes and brackets, both ways."""
    r = read(spark, d, "syslog_records")
    sd = F.concat(F.lit("m"), F.to_json(F.create_map(F.lit("x@1"), F.create_map(F.lit("q"), F.concat(F.lit('a"b]'), F.col("record_id").cast("string"))))))
    a = attrs(**{"syslog.facility": V.tagged(F.col("syslog_facility"), "i"), "syslog.tag": V.s(F.col("syslog_tag")), "syslog.structured_data": sd})
    lines = text.to_syslog(r.select(F.col("record_id").alias("_seq"), (micros("received_at") * 1000).alias("ts_ns"), a.alias("attributes"), "message"))
    s = text.syslog(lines.withColumn("ts_ns", F.lit(0).cast("bigint")))
    quoted = F.from_json(_a("syslog.structured_data"), "map<string,map<string,string>>")["x@1"]["q"]
    return s.select(F.col("_seq").alias("record_id"), _a("syslog.tag").alias("tag"), "message", quoted.alias("quoted"), _a("syslog.facility").alias("facility"))


@query("select record_id, syslog_tag tag, process_pid::varchar pid, message, strftime(received_at, '%b ') || lpad(day(received_at)::varchar, 2, ' ') || strftime(received_at, ' %H:%M:%S') stated from syslog_records")
def syslog_rfc3164_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """The older form, with host, tag and pid."""
    r = read(spark, d, "syslog_records")
    a = attrs(**{"host.name": F.lit("sh1"), "syslog.tag": V.s(F.col("syslog_tag")), "process.pid": V.s(F.col("process_pid"))})
    lines = text.to_syslog(r.select(F.col("record_id").alias("_seq"), (micros("received_at") * 1000).alias("ts_ns"), a.alias("attributes"), "message"), "rfc3164")
    s = text.syslog(lines.withColumn("ts_ns", F.lit(0).cast("bigint")))
    return s.select(F.col("_seq").alias("record_id"), _a("syslog.tag").alias("tag"), _a("process.pid").alias("pid"), "message", _a("syslog.timestamp").alias("stated"))


# -- sources and sinks ----------------------------------------------------------------------------


@query("select strftime(ts, '%Y-%m-%d') \"day\", event_type, count(*) n, round(sum(value), 4) total from events group by all")
def files_by_day_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rows written as compressed files by day and read back."""
    e = read(spark, d, "events").select("event_id", "event_type", "value", _ts().alias("ts_ns"))
    path = scratch(spark)
    io.write_files(e, path, "json", by_day="ts_ns", compression="gzip")
    back = spark.read.schema("event_id bigint, event_type string, value double, ts_ns bigint, day string").json(path)
    io.write_null(back.select("event_id"))
    return back.groupBy("day", "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("select 'INFO' level, count(*) n, count(distinct event_id) ids from events where event_type <> 'error' union all select 'ERROR', count(*), count(distinct event_id) from events where event_type = 'error'")
def text_lines_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Readable blocks written as text, read as lines."""
    path = scratch(spark)
    block = io.human(events(spark, d, names=["app.level"]).withColumn("attributes", F.create_map().cast("map<string,string>")).withColumn("log", F.col("log").withField("message", F.concat(F.lit("id="), F.col("_seq").cast("string")))))
    io.write_files(block.select("line"), path, "text")
    r = io.lines(spark, path)
    level = F.regexp_extract("line", r"^\S+ ([A-Z]+) ", 1)
    return r.where(level != "").groupBy(level.alias("level")).agg(F.count("*").alias("n"), F.count_distinct(F.regexp_extract("line", r"id=(\d+)", 1)).alias("ids"))


@query("select k, count(*) n, min(t)::bigint first_ns, max(t)::bigint last_ns from (select 'k' || (i % 4) k, 100 + i*10 t from range(5000) r(i)) group by 1")
def generate_sequence(spark: SparkSession, d: str) -> DataFrame:  # noqa: ARG001
    """Numbered rows from a template."""
    g = io.generate(spark, 5000, 10, 100, k=reshape.template("k{seq%4}", seq=F.col("seq")))
    return g.groupBy("k").agg(F.count("*").alias("n"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


@query("select count(*) sent, 0::bigint failed from events")
def deliver_batches(spark: SparkSession, d: str) -> DataFrame:
    """Bodies handed to a function in batches; none is left out."""
    lines = read(spark, d, "events").select(F.col("event_type").alias("line"))
    return io.deliver(lines, len, 100).agg(F.sum("sent").alias("sent"), F.sum("failed").alias("failed"))


# -- parsers, reshaping, filters, routing ---------------------------------------------------------


@query("select o_orderkey, o_orderpriority[1:1] rank from orders")
def parse_regex_attribute(spark: SparkSession, d: str) -> DataFrame:
    """Named groups from an attribute instead of the message."""
    e = as_event(read(spark, d, "orders"), F.col("o_orderkey"), F.lit(0), attrs(prio=V.s(F.col("o_orderpriority"))))
    return parsers.regex(e, r"^(?<rank>\d)", "prio").select(F.col("_seq").alias("o_orderkey"), _a("rank"))


@query("select o_orderkey, epoch_us(o_orderdate)*1000 + 5 ts_ns, o_totalprice price, 'x' note, 2 metrics from orders where o_orderkey % 4 > 0 union all select o_orderkey, epoch_us(o_orderdate)*1000, null, null, 0 from orders where o_orderkey % 4 = 0")
def line_protocol_to_events(spark: SparkSession, d: str) -> DataFrame:
    """A point an event; messages without a point pass unchanged."""
    k = F.col("o_orderkey")
    m = F.concat(F.lit("shop price="), F.col("o_totalprice").cast("string"), F.lit(",ok=true,note=\"x\" "), (_ts("o_orderdate") + 5).cast("string"))
    p = parsers.line_protocol_events(_orders(spark, d, F.when(k % 4 == 0, "no point").otherwise(m)))
    price = F.filter("metrics", lambda x: x["name"] == "shop.price")[0]["value"]
    return p.select(F.col("_seq").alias("o_orderkey"), "ts_ns", F.when(F.size("metrics") > 0, price).alias("price"), V.text(F.col("attributes")["_sl.field.note"]).alias("note"), F.greatest(F.size("metrics"), F.lit(0)).alias("metrics"))


def _timed(spark: SparkSession, d: str, at: Column, fmt: str, **k: object) -> DataFrame:
    e = as_event(read(spark, d, "events"), F.col("event_id"), _ts() + 5_000_000_000, attrs(at=V.s(at)))
    return reshape.timestamp(e, "at", fmt, **k).select(F.col("_seq").alias("event_id"), "ts_ns")


@query(f"select event_id, {_NS} ts_ns from events")
def timestamp_rfc3339(spark: SparkSession, d: str) -> DataFrame:
    """Times with offset and fraction."""
    return _timed(spark, d, F.concat(F.date_format(F.col("ts").cast("timestamp") + F.expr("interval 2 hours"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("+02:00")), "rfc3339")


@query(f"select event_id, {_NS} ts_ns from events")
def timestamp_unix_micros(spark: SparkSession, d: str) -> DataFrame:
    """Unix times in microseconds."""
    return _timed(spark, d, micros("ts"), "unix_micros")


@query(f"select event_id, {_NS} + 7 ts_ns from events")
def timestamp_unix_nanos(spark: SparkSession, d: str) -> DataFrame:
    """Unix times in nanoseconds, to the last digit."""
    return _timed(spark, d, _ts() + 7, "unix_nanos")


@query("select event_id, epoch_us(date_trunc('second', ts))*1000 ts_ns from events")
def timestamp_pattern_zone(spark: SparkSession, d: str) -> DataFrame:
    """Wall times of a zone by a pattern; those that occur twice are nearest to the receipt."""
    return _timed(spark, d, F.date_format(F.from_utc_timestamp("ts", "America/New_York"), "dd.MM.yyyy HH:mm:ss"), "dd.MM.yyyy HH:mm:ss", zone="America/New_York")


@query("""select o_orderkey, lpad(printf('%x', 7), 16, '0') || lpad(printf('%x', o_orderkey), 16, '0') trace, lpad(printf('%x', o_custkey), 16, '0') span from orders where o_orderkey % 5 > 0 and o_orderkey > 0 and o_custkey > 0 union all select o_orderkey, null, null from orders where o_orderkey % 5 = 0 or o_orderkey = 0 or o_custkey = 0""")
def trace_context_decimal(spark: SparkSession, d: str) -> DataFrame:
    """Decimal ids and an upper half; text that is no number leaves the event as it is."""
    k = F.col("o_orderkey")
    a = attrs(t=V.s(F.when(k % 5 == 0, "12x").otherwise(k.cast("string"))), s=V.tagged(F.col("o_custkey"), "u"), high=F.lit("s7"))
    e = reshape.trace_context(as_event(read(spark, d, "orders"), k, F.lit(0), a, message=F.lit("m")), "t", "s", id_format="decimal", trace_id_high_field="high")
    return e.select(F.col("_seq").alias("o_orderkey"), F.col("log.trace_id").alias("trace"), F.col("log.span_id").alias("span"))


@query("select count(*) n, count(*) v4, count(*) v7, count(*) ulids, count(*) uniq from orders")
def minted_ids(spark: SparkSession, d: str) -> DataFrame:
    """Random and time-ordered ids: form, time and uniqueness."""
    o = read(spark, d, "orders").select(F.expr("unix_micros(cast(o_orderdate as timestamp)) div 1000").alias("ms"))
    o = o.select("ms", ids.uuid_v4().alias("a"), ids.uuid_v7(F.col("ms")).alias("b"), ids.ulid(F.col("ms")).alias("c"))
    time = F.lpad(F.lower(F.hex("ms")), 12, "0")
    v7 = F.col("b").rlike("^[0-9a-f]{8}-[0-9a-f]{4}-7[0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}$") & (F.concat(F.substring("b", 1, 8), F.substring("b", 10, 4)) == time)
    late = F.conv(F.translate(F.substring("c", 1, 10), ids.CROCKFORD, ids.BASE32), 32, 10).cast("bigint") == F.col("ms")
    return o.agg(F.count("*").alias("n"), F.count_if(F.col("a").rlike("^[0-9a-f-]{36}$") & (F.substring("a", 15, 1) == "4")).alias("v4"), F.count_if(v7).alias("v7"), F.count_if(F.col("c").rlike(f"^[{ids.CROCKFORD}]{{26}}$") & late).alias("ulids"), F.count_distinct("b", "c").alias("uniq"))


@query("select c_custkey, '10.0.0.' || (c_custkey % 250) client, case when c_custkey % 2 = 0 then '8080' end port from customer")
def http_access_forwarded(spark: SparkSession, d: str) -> DataFrame:
    """The first hop of a forwarding header as client address and port."""
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    ip = F.concat(F.lit("10.0.0."), (k % 250).cast("string"))
    h = F.when(k % 2 == 0, F.concat(F.lit('for="'), ip, F.lit(':8080";proto=https, for=1.2.3.4'))).otherwise(F.concat(ip, F.lit(", 9.9.9.9")))
    e = http_access.http_access(as_event(c, k, F.lit(0), attrs(**{"http.request.header.forwarded": V.s(h)}), message=F.lit("x")), forwarded="forwarded")
    return e.select(F.col("_seq").alias("c_custkey"), _a("client.address").alias("client"), _a("client.port").alias("port"))


@query(f"select event_id from events where (({_NOW} - (epoch_us(ts)*1000 + case when event_id%8=0 then 60000000000 else 0 end)) > 86400000000000::bigint * 3 or (epoch_us(ts)*1000 + case when event_id%8=0 then 60000000000 else 0 end) - {_NOW} > 86400000000000::bigint * 5)")
def has_stale_window(spark: SparkSession, d: str) -> DataFrame:
    """The exact complement of dropping stale events."""
    return filters.has_stale(_mixed(spark, d), _NOW, 72 * HOUR, 120 * HOUR).select(F.col("_seq").alias("event_id"))


@query("select event_id from events where event_id % 4 in (0, 1) or event_id % 8 = 0")
def has_signal_any(spark: SparkSession, d: str) -> DataFrame:
    """Events that carry any of the listed payloads."""
    return filters.has_signal(_mixed(spark, d), ["logs", "traces"]).select(F.col("_seq").alias("event_id"))


@query("select 'all' arm, count(*) n from events union all select 'keep', count(*) filter (event_id % 2 = 1) from events union all select 'drop', count(*) filter (false) from events")
def sample_edges(spark: SparkSession, d: str) -> DataFrame:
    """Rate 1, events without key that stay, and none at rate 0."""
    e = events(spark, d)
    no_key = e.withColumn("attributes", F.when(F.col("_seq") % 2 == 1, F.map_filter("attributes", lambda k, _: k != "user_id")).otherwise(F.col("attributes")))
    parts = {"all": filters.sample(e, 1.0, "user_id"), "keep": filters.sample(no_key, 0.0, "user_id", missing="keep"), "drop": filters.sample(no_key, 0.0, "user_id", missing="drop")}
    return route.fan_in(*[p.agg(F.count("*").alias("n")).select(F.lit(a).alias("arm"), "n") for a, p in parts.items()])


@query("select c_custkey id, case when 'r' || (c_nationkey % 5) in ('r1', 'r2') then 'near' else 'forward' end target from customer")
def route_by_resource(spark: SparkSession, d: str) -> DataFrame:
    """Routes by a resource attribute."""
    e = as_event(read(spark, d, "customer"), F.col("c_custkey"), F.lit(0), resource=attrs(region=V.s(F.concat(F.lit("r"), F.col("c_nationkey") % 5))))
    parts = route.route(e, "resource", [("r1", ["near"]), ("r2", ["near"])], "region")
    return route.fan_in(*[p.select(F.col("_seq").alias("id"), F.lit(t).alias("target")) for t, p in parts.items()])


@query("select o_orderkey id, 'sales' target from orders union all select c_custkey, 'forward' from customer")
def route_by_origin(spark: SparkSession, d: str) -> DataFrame:
    """Routes by the component that an event came from."""
    parts = route.route(_two(spark, d), "origin", [("shop", ["sales"])])
    return route.fan_in(*[p.select(F.col("_seq").alias("id"), F.lit(t).alias("target")) for t, p in parts.items()])


@query("""select event_type, max(depth) depth, max(width) width, sum(n) sums from (select event_type, case when event_id % 2 = 0 then 3 else 1 end depth, case when event_id % 2 = 0 then 2 else 0 end width, 2 n from events) group by 1""")
def shape_nesting(spark: SparkSession, d: str) -> DataFrame:
    """Depth of nesting, width of maps and metrics by kind."""
    e = events(spark, d, names=["app.events", "app.cents", "app.level"])
    deep = F.create_map(F.lit("deep"), F.lit('m{"a":{"b":[1,"}]"]},"c":2}'))
    m = shape.measure(e.withColumn("attributes", F.when(F.col("_seq") % 2 == 0, V.merge(F.col("attributes"), deep)).otherwise(F.col("attributes"))).withColumn("_origin", V.text(F.col("attributes")["event_type"])))
    return m.groupBy(F.col("_origin").alias("event_type")).agg((F.max("depth") - 1).alias("depth"), F.max("max_map_width").alias("width"), F.sum(F.col("metric_kinds")["sum"]).alias("sums"))


# -- aggregation and deltas -----------------------------------------------------------------------


@query("""with h as (select time_bucket(interval '1 hour', ts) period, user_id, count(*) n, arg_min(value, event_id) fst, arg_max(value, event_id) lst from events group by all)
select period, user_id::varchar user_id, n, case when n <= 2 then fst end first_v, case when n <= 2 then lst end last_v, n > 2 sketched from h""")
def aggregate_raw_samples(spark: SparkSession, d: str) -> DataFrame:
    """Raw samples in arrival order up to a cap, a sketch beyond it."""
    m = A.explode_metrics(reshape.keep(events(spark, d, names=["app.value"]), ["user_id"]))
    out, _ = A.aggregate(m, HOUR, distributions="samples", cap=2, kinds={"samples"})
    return out.select(_w(), _a("user_id"), F.col("d_count").cast("bigint").alias("n"), F.col("samples")[0].alias("first_v"), F.element_at("samples", -1).alias("last_v"), F.col("bins").isNotNull().alias("sketched"))


@query("""with o as (select time_bucket(interval '1 day', o_orderdate) period, o_custkey, min(o_orderkey) fst from orders group by all), r as (select *, row_number() over (partition by period order by fst) k from o)
select period, count(*) filter (k <= 8) links, arg_min(lpad(printf('%x', o_custkey), 32, '0'), fst) first_trace from r group by 1""")
def aggregate_links(spark: SparkSession, d: str) -> DataFrame:
    """At most eight distinct trace contexts of a series, the first to arrive."""
    m = [metric(name="orders", kind="sum", value=1.0, value_type="f", temporality="delta", monotonic=True)]
    e = as_event(read(spark, d, "orders"), F.col("o_orderkey"), _ts("o_orderdate"), message=F.lit("m"), metrics=m, extra=["o_custkey"])
    e = e.withColumn("log", F.col("log").withField("trace_id", F.lpad(F.lower(F.hex("o_custkey")), 32, "0"))).drop("o_custkey")
    out, _ = A.aggregate(A.explode_metrics(e, links=True), 24 * HOUR, kinds={"sum", "links"})
    return out.select(_w(), F.size("links").cast("bigint").alias("links"), F.col("links")[0]["trace_id"].alias("first_trace"))


@query("""with h as (select time_bucket(interval '1 day', ts) period, event_type, count(*) filter (value <= 50) a, count(*) filter (value > 50) b, sum(value) s from events group by all)
select period, event_type, sum(a) over w::bigint low, sum(b) over w::bigint high, round(sum(s) over w, 4) total from h window w as (partition by event_type order by period)""".replace("sum(a) over w::bigint", "cast(sum(a) over w as bigint)").replace("sum(b) over w::bigint", "cast(sum(b) over w as bigint)"))
def aggregate_histogram_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Running totals of histograms over windows."""
    v = F.col("value")
    buckets = F.array(F.struct(F.lit(50.0).alias("bound"), (v <= 50).cast("bigint").alias("count")), F.struct(F.lit(float("inf")).alias("bound"), (v > 50).cast("bigint").alias("count")))
    e = as_event(read(spark, d, "events"), F.col("event_id"), _ts(), attrs(event_type=V.s(F.col("event_type"))), metrics=[metric(name="h", kind="histogram", temporality="delta", buckets=buckets, count=1, sum=v, min=v, max=v)])
    out, _ = A.aggregate(A.explode_metrics(e), 24 * HOUR, "cumulative", kinds={"histogram"})
    b = lambda i: F.col("buckets")[i]["count"]
    return A.cumulate_histograms(out).select(_w(), _a("event_type"), b(0).alias("low"), b(1).alias("high"), F.round("h_sum", 4).alias("total"))


@query("""with h as (select event_type, time_bucket(interval '1 day', ts) period, count(*) filter (value <= 50) low, count(*) filter (value > 50) high from events group by all)
select event_type, period, case when lag(period) over w is null then 'first' else 'difference' end rule, case when lag(period) over w is not null then low end low, case when lag(period) over w is not null then high end high from h window w as (partition by event_type order by period)""")
def histogram_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative histograms to deltas, bucket by bucket."""
    from pyspark.sql import Window as W

    e = read(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("period")).agg(F.count_if(F.col("value") <= 50).alias("a"), F.count_if(F.col("value") > 50).alias("b"), F.sum("value").alias("s"))
    w = W.partitionBy("event_type").orderBy("period")
    run = lambda c: F.sum(c).over(w)
    buckets = F.array(F.struct(F.lit(50.0).alias("bound"), run("a").alias("count")), F.struct(F.lit(float("inf")).alias("bound"), run("b").alias("count")))
    c = e.select("event_type", "period", _ts("period").alias("ts_ns"), _ts("period").alias("_seq"), buckets.alias("buckets"), run("s").alias("sum"))
    out = delta.histogram_to_delta(c, ["event_type"])
    return out.select("event_type", F.col("period").cast("timestamp_ntz").alias("period"), "rule", F.col("delta_buckets")[0]["count"].alias("low"), F.col("delta_buckets")[1]["count"].alias("high"))


@query("""with h as (select event_type, time_bucket(interval '1 day', ts) period, count(*) filter (value <= 1) zero, count(*) n, """ + ", ".join(f"count(*) filter (value > {2**i} and value <= {2**(i+1)}) b{i}" for i in range(10)) + """ from events group by all)
select event_type, period, case when lag(period) over w is null then 'first' else 'difference' end rule, case when lag(period) over w is not null then zero end zero, case when lag(period) over w is not null then n end n, """ + ", ".join(f"case when lag(period) over w is not null then b{i} end b{i}" for i in range(10)) + " from h window w as (partition by event_type order by period)")
def exponential_deltas(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative exponential histograms of falling scale to deltas, read from export requests."""
    from pyspark.sql import Window as W

    v, days = F.col("value"), F.expr("unix_micros(cast(period as timestamp)) div 86400000000")
    e = read(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").alias("period")).agg(F.count_if(v <= 1).alias("z"), F.count("*").alias("n"), F.sum("value").alias("s"), *[F.count_if((v > 2**i) & (v <= 2 ** (i + 1))).alias(f"c{i}") for i in range(10)])
    w = W.partitionBy("event_type").orderBy("period")
    run = lambda c: F.sum(c).over(w)
    text_of = lambda c: F.to_json(F.transform(c, lambda x: x.cast("string")))
    counts = F.array(*[run(f"c{i}") for i in range(10)])
    # the first day counts at twice the resolution: every bucket and an empty one beside it
    fine = F.flatten(F.transform(counts, lambda c: F.array(F.lit(0).cast("bigint"), c)))
    first = F.row_number().over(w) == 1
    body = F.concat(F.lit('{"resourceMetrics":[{"scopeMetrics":[{"metrics":[{"name":"m","exponentialHistogram":{"aggregationTemporality":2,"dataPoints":[{"timeUnixNano":"'), (days * F.lit(86_400_000_000_000)).cast("string"), F.lit('","scale":'), F.when(first, "1").otherwise("0"),
                    F.lit(',"zeroCount":"'), run("z").cast("string"), F.lit('","count":"'), run("n").cast("string"), F.lit('","sum":'), run("s").cast("string"), F.lit(',"positive":{"offset":0,"bucketCounts":'), text_of(F.when(first, fine).otherwise(counts)), F.lit("}}]}}]}]}]}"))
    m = json_formats.otlp_metrics(e.select("event_type", "period", days.alias("_seq"), body.alias("body")))
    out = delta.exponential_to_delta(m, ["event_type"])
    c = F.col("delta_exp.positive")
    return out.select("event_type", F.col("period").cast("timestamp_ntz").alias("period"), "rule", F.col("delta_exp.zero_count").alias("zero"), F.col("delta_count").alias("n"), *[F.get(c, F.lit(i)).alias(f"b{i}") for i in range(10)])


@query("""select l_returnflag flag, n "name", v from (select l_returnflag, count(*)::double n0, round(sum(l_extendedprice), 2) s, min(l_extendedprice) lo, max(l_extendedprice) hi, count(*) filter (l_extendedprice <= 1000)::double b0, count(*) filter (l_extendedprice > 1000 and l_extendedprice <= 10000)::double b1,
count(*) filter (l_extendedprice > 10000 and l_extendedprice <= 30000)::double b2, count(*) filter (l_extendedprice > 30000 and l_extendedprice <= 60000)::double b3, count(*) filter (l_extendedprice > 60000)::double b4 from lineitem group by 1) t,
lateral (values ('.count', n0), ('.sum', s), ('.min', lo), ('.max', hi), ('.bucket_1000', b0), ('.bucket_10000', b1), ('.bucket_30000', b2), ('.bucket_60000', b3), ('.bucket_inf', b4)) x(n, v)""".replace("::double b", "::double b").replace("filter (l_extendedprice <= 1000)::double", "filter (l_extendedprice <= 1000)*1.0::double"))
def multi_value_histogram(spark: SparkSession, d: str) -> DataFrame:
    """A histogram as one number per row."""
    out, _ = A.aggregate(_histograms(spark, d), 1 << 62, "cumulative", kinds={"histogram"})
    m = out.withColumns({"sum": F.round("h_sum", 2), "min": F.col("h_min"), "max": F.col("h_max"), "count": F.col("absorbed"), "quantiles": F.lit(None).cast("array<struct<q:double,v:double>>"), "members": F.lit(None).cast("array<string>")})
    return text.multi_value(m).select(_a("flag"), F.replace("name", F.lit("line.price"), F.lit("")).alias("name"), F.col("value").alias("v"))


@query("select event_type, n::bigint n, round(total, 4) total, lo, hi from (select event_type, count(*) n, sum(value) total, min(value) lo, max(value) hi from events group by 1)")
def prometheus_summaries(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles, sum and count of the exposition format as summaries."""
    e = read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    row = lambda name, q, c: F.concat(F.lit(f'app_took{name}{{type="'), F.col("event_type"), F.lit(f'"{q}}} '), F.col(c).cast("string"))
    lines = e.select(F.explode(F.array(F.lit("# TYPE app_took summary"), row("", ',quantile="0"', "lo"), row("", ',quantile="1"', "hi"), row("_sum", "", "s"), row("_count", "", "n"))).alias("line"))
    r = text.prometheus_summaries(text.prometheus(lines.select("line", F.lit(1).cast("bigint").alias("_seq"), F.lit(5).cast("bigint").alias("ts_ns"))))
    return r.select(_a("type").alias("event_type"), F.col("count").alias("n"), F.round("sum", 4).alias("total"), F.col("quantiles")[0]["v"].alias("lo"), F.col("quantiles")[1]["v"].alias("hi"))


@query("select event_id, 's' || event_type title, props message, case when event_type = 'error' then 'error' else 'info' end severity, epoch_us(date_trunc('second', ts))*1000 ts_ns, user_id::varchar member from events")
def event_posts_decode(spark: SparkSession, d: str) -> DataFrame:
    """Event bodies as logs."""
    e = read(spark, d, "events")
    body = F.to_json(F.struct(F.concat(F.lit("s"), F.col("event_type")).alias("title"), F.col("props").alias("text"), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").alias("date_happened"), F.when(F.col("event_type") == "error", "error").otherwise("success").alias("alert_type"), F.array(F.concat(F.lit("user:"), F.col("user_id").cast("string"))).alias("tags")))
    r = json_formats.event_posts(e.select("event_id", body.alias("body")))
    return r.select("event_id", _a("event.title").alias("title"), "message", "severity", "ts_ns", _a("user").alias("member"))


@query("select o_orderkey, 'db' named, (o_orderkey % 4)::varchar status, 'h' || (o_custkey % 3) host from orders where o_orderkey % 5 < 4")
def check_runs_decode(spark: SparkSession, d: str) -> DataFrame:
    """Service checks; a status beyond 3 is left out."""
    o = read(spark, d, "orders")
    k = F.col("o_orderkey")
    body = F.to_json(F.array(F.struct(F.lit("db").alias("check"), F.concat(F.lit("h"), F.col("o_custkey") % 3).alias("host_name"), F.when(k % 5 == 4, 9).otherwise(k % 4).alias("status"), k.alias("timestamp"))))
    r = json_formats.check_runs(o.select("o_orderkey", body.alias("body")))
    return r.select("o_orderkey", _a("service_check.name").alias("named"), _a("service_check.status").alias("status"), _a("host.name").alias("host"))


@query("select event_id, value first_v, user_id::double second_v, event_type, epoch_us(date_trunc('second', ts))*1000 ts_ns from events")
def distribution_points_decode(spark: SparkSession, d: str) -> DataFrame:
    """Distribution points: several raw values at a time."""
    e = read(spark, d, "events")
    body = F.concat(F.lit('{"series":[{"metric":"m","points":[['), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").cast("string"), F.lit(",["), F.col("value").cast("string"), F.lit(","), F.col("user_id").cast("string"), F.lit(']]],"tags":["type:'), F.col("event_type"), F.lit('"]}]}'))
    r = json_formats.distribution_points(e.select("event_id", body.alias("body")))
    return r.select("event_id", F.col("samples")[0].alias("first_v"), F.col("samples")[1].alias("second_v"), _a("type").alias("event_type"), "ts_ns")


# -- graphs, functions, streams -------------------------------------------------------------------

_CHAIN = """
parse: {type: json, sources: [in]}
unit: {type: scale, sources: [parse], factors: {took: 1000}}
derive: {type: kv_metrics, sources: [unit], counters: [{name: requests}, {name: sent, field: bytes}], distributions: [{name: took, field: took, unit: ms}]}
few: {type: keep, sources: [derive], fields: [status, host]}
clamp: {type: keep_values, sources: [few], field: host, allow: [r1, r2], other: other}
sums: {type: aggregate, sources: [clamp], interval_ns: 86400000000000}
out: {type: sink, sources: [sums]}
"""


@query("""with c as (select o_orderstatus status, case when o_custkey % 5 in (1, 2) then 'r' || (o_custkey % 5) else 'other' end host, o_custkey, o_totalprice, time_bucket(interval '1 day', o_orderdate) + interval '1 day' emitted from orders)
select 'metric' what, "name", status, host, emitted, v from (select status, host, emitted, unnest(['requests', 'sent', 'took']) "name", unnest([count(*)::double, sum(o_custkey)::double, count(*)::double]) v from c group by status, host, emitted)
union all select 'log', null, status, host, emitted - interval '1 day', count(*) from c group by all""")
def graph_chain(spark: SparkSession, d: str) -> DataFrame:
    """Parse, scale, derive, keep, clamp and aggregate as one graph: metrics are absorbed, logs go on."""
    o = read(spark, d, "orders")
    m = F.to_json(F.struct(F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("bytes"), F.lit(0.012).alias("took"), F.concat(F.lit("r"), F.col("o_custkey") % 5).alias("host"), F.col("o_clerk").alias("junk") if "o_clerk" in o.columns else F.lit("x").alias("junk")))
    out = graph.compile_graph(graph.load(_CHAIN, {}), {"in": as_event(o, F.col("o_orderkey"), _ts("o_orderdate"), message=m)})["out"]
    day = F.timestamp_seconds(F.expr("ts_ns div 1000000000")).cast("timestamp_ntz").alias("emitted")
    x = F.get("metrics", F.lit(0))
    made = out.where("size(metrics) > 0").select(F.lit("metric").alias("what"), x["name"].alias("name"), _a("status"), _a("host"), day, F.coalesce(F.when(x["kind"] == "sum", x["value"]), x["count"].cast("double")).alias("v"))
    logs = out.where("log is not null").groupBy(_a("status"), _a("host"), day).agg(F.count("*").cast("double").alias("v"))
    return made.unionByName(logs.select(F.lit("log").alias("what"), F.lit(None).cast("string").alias("name"), "status", "host", "emitted", "v"))


def _fan_out(e: dict) -> list[dict] | dict | None:
    ev = script.Event(e)
    if ev.attribute("user_id") % 5 == 0:
        return None
    if ev["log"]["severity"] == "error":
        return [ev.to("alerts"), ev.clone()]
    ev.put("seen", True)
    return ev


@query("""select event_id, case when event_type = 'error' then false else true end seen, 'rest' target from events where user_id % 5 > 0 union all select event_id, false, 'alerts' from events where user_id % 5 > 0 and event_type = 'error'""")
def function_targets(spark: SparkSession, d: str) -> DataFrame:
    """A user function that drops, doubles, marks and routes events in a graph."""
    from pyspark.sql import types as T

    e = events(spark, d, names=[])
    out = T.StructType([*e.schema.fields, T.StructField("_dest", T.StringType())])
    g = {"f": {"type": "fn", "sources": ["in"], "targets": ["alerts"]}, "a": {"type": "sink", "sources": ["alerts"]}, "r": {"type": "sink", "sources": ["f"]}}
    frames = graph.compile_graph(g, {"in": e}, {"fn": lambda df: script.process(df, _fan_out, out)})
    seen = F.coalesce(F.col("attributes")["seen"] == "btrue", F.lit(False)).alias("seen")
    return frames["a"].select(F.col("_seq").alias("event_id"), seen, F.lit("alerts").alias("target")).unionByName(frames["r"].select(F.col("_seq").alias("event_id"), seen, F.lit("rest").alias("target")))


@query("select event_type, count(*) n, round(sum(value), 4) total from events group by 1")
def function_flush(spark: SparkSession, d: str) -> DataFrame:
    """State per key that built-in aggregates express."""
    e = read(spark, d, "events")
    return script.reduce_by(e, ["event_type"], n=F.count("*"), total=F.round(F.sum("value"), 4))


@query("select time_bucket(interval '10 minutes', ts) period, event_type, count(*) n, max(value) top from events group by all")
def event_time_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows by event time."""
    e = read(spark, d, "events").withColumn("at", F.col("ts").cast("timestamp"))
    w = windows.event_time(e, "at", "10 minutes", ["event_type"], "1 hour", n=F.count("*"), top=F.max("value"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("period"), "event_type", "n", "top")


@query("select event_type, count(*)::double n, 4 windows from events group by 1")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counters of a stream, a micro-batch a window; four batches hold every event once."""
    source, out, check = scratch(spark), scratch(spark), scratch(spark)
    m = A.explode_metrics(reshape.keep(events(spark, d, names=["app.events"]), ["event_type"]))
    m.repartition(4).write.option("maxRecordsPerFile", 0).parquet(source)  # a file a trigger
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = windows.aggregate_stream(stream, lambda df, i: df.select(F.lit(i).alias("window_no"), "attributes", "value").write.mode("overwrite").parquet(f"{out}/part={i}"), check, once=True, kinds={"sum"})
    q.awaitTermination(540)
    r = spark.read.parquet(out)
    return r.groupBy(_a("event_type")).agg(F.sum("value").alias("n"), F.count_distinct("window_no").cast("int").alias("windows"))


@query("""with a as (select log_id, service_name, event_timestamp e, case when observed_timestamp <> 0 then observed_timestamp else epoch_us(received_at)*1000 end arrival from log_records where event_timestamp <> 0),
f as (select log_id, arg_min(service_name, arrival) service_name, min(arrival) arrival, arg_min(e, arrival) e from a group by 1) select service_name, count(*) filter (arrival - (e//3600000000000 + 1)*3600000000000 <= 86400000000000) n, count(*) filter (arrival - (e//3600000000000 + 1)*3600000000000 > 86400000000000) dropped from f group by 1""")
def stream_late_counters(spark: SparkSession, d: str) -> DataFrame:
    """Dots of a stream of deliveries, kept per micro-batch and merged."""
    source, table, check = scratch(spark), scratch(spark), scratch(spark)
    cols = ["log_id", "event_timestamp", "observed_timestamp", "received_at", "service_name", "host_name"]
    read(spark, d, "log_records").select(*cols).repartition(3).write.parquet(source)
    stream = spark.readStream.schema(spark.read.parquet(source).schema).option("maxFilesPerTrigger", 1).parquet(source)
    q = windows.late_counters(stream, table, check, ["service_name"], key="log_id", event="event_timestamp", observed="observed_timestamp", received="received_at", source="host_name")
    q.awaitTermination(540)
    dots = windows.latest_dots(spark.read.parquet(table).drop("part"), "log_id", ["service_name"])
    t = late_events.totals(late_events.versions(late_events.with_outcome(dots), ["service_name"]), ["service_name"])
    return t.groupBy("service_name").agg(F.sum("n").alias("n"), F.sum("dropped").alias("dropped"))
