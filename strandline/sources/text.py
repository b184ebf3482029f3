"""Readers and writers of text wire formats, as column expressions over lines.

A decoder takes a frame of lines (``line``, ``_seq``, ``ts_ns`` as receipt time) and
gives the metric table or events; lines that don't fit the grammar are left out, and
``rejected`` gives them back. An encoder gives one ``line`` per output line.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import values as V
from strandline.functions.shared import bucketed_prefix
from strandline.operators.parsers import influx_points, influx_value
from strandline.schema import PRIVATE

NUMBER = r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?"
SERVICE_KEYS = {"env": "deployment.environment.name", "service": "service.name", "version": "service.version", "host": "host.name"}


def tag_map(tags: Column) -> Column:
    """``key:value`` tokens: exact copies once, a repeated key as array, a bare token as true; private keys omitted."""
    t = F.filter(F.array_distinct(F.filter(tags, lambda x: x != "")), lambda x: ~x.startswith(PRIVATE))
    key = lambda x: F.substring_index(x, ":", 1)
    name = F.create_map(*[F.lit(x) for kv in SERVICE_KEYS.items() for x in kv])
    value = lambda x: F.when(F.contains(x, F.lit(":")), V.s(F.substr(x, F.instr(x, ":") + 1))).otherwise(F.lit("btrue"))
    keys = F.array_distinct(F.transform(t, key))
    def of(k: Column) -> Column:
        vs = F.transform(F.filter(t, lambda x: key(x) == k), value)
        as_json = F.concat(F.lit("a["), F.array_join(F.transform(vs, lambda v: F.when(v == "btrue", F.lit("true")).otherwise(F.to_json(F.array(V.text(v))).substr(F.lit(2), F.length(F.to_json(F.array(V.text(v)))) - 2))), ","), F.lit("]"))
        return F.when(F.size(vs) == 1, vs[0]).otherwise(as_json)
    named = lambda ks: F.transform(ks, lambda k: F.coalesce(name[k], k))
    plain = V.from_pairs(named(F.transform(t, key)), F.transform(t, value))
    return F.when(F.size(keys) == F.size(t), plain).otherwise(V.from_pairs(named(keys), F.transform(keys, of)))


_SERVICE = "|".join(SERVICE_KEYS)
#: A key that stands in two tokens, an empty token, or a private key: the plain way doesn't cover these.
_UNEVEN = rf"(?:^|,)([^:,]+)(?::[^,]*)?,(?:.*,)?\1(?:[:,]|$)|,,|^,|,$|(?:^|,){re.escape(PRIVATE)}"


def with_tag_map(d: DataFrame, tags: Column, out: str) -> DataFrame:
    """d with ``out``: ``tag_map`` of comma-separated text. Where each key stands once, built-in text functions suffice and no lambda runs.

    Each step is a column of its own: as one expression the steps would multiply.
    """
    t, named = F.col("_tags"), F.col("_tags")
    for k, name in SERVICE_KEYS.items():
        named = F.regexp_replace(named, rf"(^|,){k}(?=[:,]|$)", f"$1{name}")
    d = d.withColumn("_tags", F.coalesce(tags, F.lit("")))
    d = d.withColumn("_named", F.when(t.rlike(rf"(?:^|,)(?:{_SERVICE})(?:[:,]|$)"), named).otherwise(t))
    d = d.withColumn("_typed", F.regexp_replace("_named", r"(^|,)([^:,]*):", "$1$2:s"))
    d = d.withColumn("_typed", F.when(t.rlike(r"(?:^|,)[^:,]+(?:,|$)"), F.regexp_replace("_typed", r"(^|,)([^:,]+)(?=,|$)", "$1$2:btrue")).otherwise(F.col("_typed")))
    made = F.when(t == "", F.create_map().cast("map<string,string>")).when(t.rlike(_UNEVEN), tag_map(F.split(t, ","))).otherwise(F.str_to_map("_typed", F.lit(","), F.lit(":")))
    return d.withColumn(out, made).drop("_tags", "_named", "_typed")


def _segment(ext: Column, mark: str) -> Column:
    """Text of the last ``|`` segment that starts with a mark, or null."""
    return F.when(F.contains(ext, F.lit("|" + mark)), F.regexp_extract(ext, rf"^.*\|{re.escape(mark)}([^|]*)", 1))


def _tags(ext: Column) -> Column:
    """Tags of all ``|#`` segments as one text, or null."""
    every = F.array_join(F.regexp_extract_all(ext, F.lit(r"\|#([^|]*)"), F.lit(1)), ",")
    return F.when(ext.rlike(r"\|#.*\|#"), every).when(F.contains(ext, F.lit("|#")), F.regexp_extract(ext, r"\|#([^|]*)", 1))


def _more(base: Column, values: dict[str, Column]) -> Column:
    """base with the values that aren't null."""
    extra = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())
    some = F.lit(False)
    for v in values.values():
        some = some | v.isNotNull()
    return F.when(some, V.merge(base, extra)).otherwise(base)


def statsd(lines: DataFrame) -> DataFrame:
    """Metric rows of statsd lines with tags, container id, origin and timestamp extensions.

    Counters are extrapolated by their rate; signed gauges are adjustments; timings,
    histograms and distributions keep their raw values and rate; sets their members.
    Events and service checks are logs: see ``statsd_logs``.
    """
    d = lines.select("_seq", "ts_ns", F.rtrim("line").alias("_l"))
    d = d.select("_seq", "ts_ns", (~F.col("_l").startswith("_e{") & ~F.col("_l").startswith("_sc|") & (F.instr("_l", ":") > 1)).alias("_ok"), F.substring_index("_l", ":", 1).alias("name"), F.substr("_l", F.instr("_l", ":") + 1).alias("_r"))
    d = d.select("_seq", "ts_ns", "_ok", "name", F.substring_index("_r", "|", 1).alias("vals"), F.substr("_r", F.length(F.substring_index("_r", "|", 1)) + 2).alias("_r"))
    d = d.select("_seq", "ts_ns", "_ok", "name", "vals", F.substring_index("_r", "|", 1).alias("t"), F.substr("_r", F.length(F.substring_index("_r", "|", 1)) + 1).alias("ext"))
    ext, number = F.col("ext"), V.FLOAT[1:-1]
    d = d.withColumns({"_rate": _segment(ext, "@"), "_ts": _segment(ext, "T"), "_c": _segment(ext, "c:"), "_e": _segment(ext, "e:"), "_k": _segment(ext, "card:")})
    observed = F.col("t").isin("ms", "h", "d")
    d = with_tag_map(d, _tags(ext), "_map")
    attrs = _more(F.col("_map"), {
        "container.id": V.s(F.col("_c")), PRIVATE + "origin.external": V.s(F.col("_e")), PRIVATE + "origin.cardinality": V.s(F.col("_k")),
        PRIVATE + "statsd.type": F.when(observed, V.s(F.col("t"))), PRIVATE + "metrics.closed": F.when(F.col("_ts").isNotNull(), F.lit("stimestamped")),
    })
    d = d.withColumns({"attributes": attrs, "rate": F.when(F.col("_rate").isNull(), 1.0).otherwise(V.parse_float(F.col("_rate"))), "numbers": F.when(observed, F.split("vals", ":").try_cast("array<double>"))})
    d = d.select("_seq", "ts_ns", "_ok", "_ts", "attributes", "name", "t", "rate", "vals", "numbers", F.posexplode_outer(F.when(F.col("t").isin("c", "g"), F.split("vals", ":")).otherwise(F.array(F.lit("")))).alias("_pos", "_raw"))
    scalar, infinite = F.col("t").isin("c", "g"), float("inf")
    one = F.when(scalar, F.col("_raw").try_cast("double"))
    finite = F.when(scalar, F.abs(one) != infinite).when(F.col("t") == "s", True).otherwise(~F.array_contains("numbers", infinite) & ~F.array_contains("numbers", -infinite))
    known = F.col("t").isin("c", "g", "ms", "h", "d", "s") & (F.col("rate") > 0) & (F.col("rate") <= 1) & (F.col("_ts").isNull() | F.col("_ts").rlike(r"^\+?\d{1,10}$")) & ((F.col("t") == "s") | F.col("vals").rlike(f"^{number}(:{number})*$"))
    # one filter, tied to the generator's output: pushed down, each part would take the whole parse with it
    d = d.where(F.when(F.col("_pos") >= 0, F.col("_ok") & known & finite))
    kind = F.when(F.col("t") == "c", "sum").when(F.col("t") == "g", F.when(F.col("_raw").rlike("^[+-]"), "gauge_delta").otherwise("gauge")).when(F.col("t") == "s", "set_members").otherwise("samples")
    value = F.when(F.col("t") == "c", one / F.col("rate")).when(F.col("t") == "g", one)
    return d.select(
        "_seq", "_pos", F.coalesce(F.col("_ts").try_cast("bigint") * 1_000_000_000, F.col("ts_ns")).alias("ts_ns"), "attributes", "name", kind.alias("kind"), value.alias("value"), F.when(F.col("t") == "c", "delta").alias("temporality"), F.when(F.col("t") == "c", F.lit(True)).alias("monotonic"),
        F.col("numbers").alias("samples"), F.when(observed, F.col("rate")).alias("sample_rate"), F.when(F.col("t") == "s", F.split("vals", ":")).alias("members"),
    )


def statsd_logs(lines: DataFrame) -> DataFrame:
    """Logs of event (``_e{title bytes,text bytes}:title|text|..``) and service check (``_sc|name|status|..``) lines.

    The lengths count bytes and must fit, on whole characters; a priority other than
    normal or low, an alert type other than error, warning, success or info, a status
    beyond 3, or a time that isn't whole seconds rejects the line.
    """
    d = lines.select("_seq", "ts_ns", F.rtrim("line").alias("_l"))
    e = d.where(F.col("_l").rlike(r"^_e\{\d{1,9},\d{1,9}\}:"))
    e = e.withColumns({"_n": F.regexp_extract("_l", r"^_e\{(\d+),", 1).try_cast("int"), "_m": F.regexp_extract("_l", r"^_e\{\d+,(\d+)\}", 1).try_cast("int"), "_b": F.encode(F.regexp_replace("_l", r"^_e\{\d+,\d+\}:", ""), "utf-8")})
    text = lambda start, n: F.try_validate_utf8(F.substring(F.col("_b"), start, n).cast("string"))
    e = e.withColumns({"title": text(F.lit(1), F.col("_n")), "_bar": text(F.col("_n") + 1, F.lit(1)), "text": text(F.col("_n") + 2, F.col("_m")), "ext": text(F.col("_n") + F.col("_m") + 2, F.lit(2_147_483_647))})
    e = e.where((F.octet_length("_b") >= F.col("_n") + F.col("_m") + 1) & (F.col("_bar") == "|") & F.col("title").isNotNull() & F.col("text").isNotNull() & ((F.col("ext") == "") | F.col("ext").startswith("|")))
    ext = F.col("ext")
    prio, alert = _segment(ext, "p:"), _segment(ext, "t:")
    severity = F.when(alert == "error", "error").when(alert == "warning", "warn").when(alert.isin("success", "info"), "info")
    e = e.where((prio.isNull() | prio.isin("normal", "low")) & (alert.isNull() | severity.isNotNull()))
    own = {f"statsd.event.{n}": V.s(_segment(ext, m)) for n, m in (("priority", "p:"), ("alert_type", "t:"), ("aggregation_key", "k:"), ("source_type", "s:"))}
    e = e.select("_seq", "ts_ns", F.replace("text", F.lit("\\n"), F.lit("\n")).alias("message"), severity.alias("severity"), ext.alias("ext"), F.create_map(F.lit(PRIVATE + "statsd.event.title"), V.s(F.col("title"))).alias("_own"), _more(F.create_map().cast("map<string,string>"), {PRIVATE + k: v for k, v in own.items()}).alias("_rest"))
    c = d.where(F.col("_l").rlike(r"^_sc\|[^|]+\|[0-3](\||$)"))
    tail = F.regexp_replace("_l", r"^_sc\|[^|]+\|[0-3]", "")
    named = F.create_map(F.lit(PRIVATE + "statsd.service_check.name"), V.s(F.regexp_extract("_l", r"^_sc\|([^|]+)", 1)), F.lit(PRIVATE + "statsd.service_check.status"), F.concat(F.lit("u"), F.regexp_extract("_l", r"^_sc\|[^|]+\|([0-3])", 1)))
    c = c.select("_seq", "ts_ns", F.lit(None).cast("string").alias("message"), F.lit(None).cast("string").alias("severity"), tail.alias("ext"), named.alias("_own"), _more(F.create_map().cast("map<string,string>"), {PRIVATE + "statsd.service_check.message": V.s(_segment(tail, "m:"))}).alias("_rest"))
    every = e.unionByName(c).withColumn("_ts", _segment(F.col("ext"), "d:"))
    every = every.where(F.col("_ts").isNull() | F.col("_ts").rlike(r"^\+?\d{1,10}$"))
    every = with_tag_map(every, _tags(F.col("ext")), "_map")
    attrs = _more(V.merge(V.merge(F.col("_map"), F.col("_own")), F.col("_rest")), {"container.id": V.s(_segment(F.col("ext"), "c:")), "host.name": V.s(_segment(F.col("ext"), "h:")), PRIVATE + "metrics.closed": F.when(F.col("_ts").isNotNull(), F.lit("stimestamped"))})
    return every.select("_seq", F.coalesce(F.col("_ts").try_cast("bigint") * 1_000_000_000, F.col("ts_ns")).alias("ts_ns"), attrs.alias("attributes"), "message", "severity")


def to_statsd(m: DataFrame) -> DataFrame:
    """One line per metric row; names of wire types come back from the carrier attribute."""
    n = F.regexp_replace(F.col("value").cast("string"), r"\.0$", "")
    wire = F.coalesce(V.text(F.col("attributes")[PRIVATE + "statsd.type"]), F.lit("d"))
    body = F.when(F.col("kind") == "sum", F.concat(n, F.lit("|c"))).when(F.col("kind") == "gauge", F.concat(n, F.lit("|g"))).when(F.col("kind") == "gauge_delta", F.concat(F.when(F.col("value") >= 0, "+").otherwise(""), n, F.lit("|g"))).when(
        F.col("kind") == "samples", F.concat(F.array_join(F.transform("samples", lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")), ":"), F.lit("|"), wire, F.when(F.col("sample_rate") < 1, F.concat(F.lit("|@"), F.col("sample_rate").cast("string"))).otherwise(""))
    ).when(F.col("kind") == "set_members", F.concat(F.array_join("members", ":"), F.lit("|s")))
    shown = F.map_filter("attributes", lambda k, v: ~k.startswith(PRIVATE) & V.kind(v).isin("s", "b", "i", "u", "f"))
    tags = F.transform(F.sort_array(F.map_entries(shown)), lambda e: F.when(e["value"] == "btrue", e["key"]).otherwise(F.concat(e["key"], F.lit(":"), V.text(e["value"]))))
    scalar = F.col("kind").isin("sum", "gauge", "gauge_delta") & F.col("value").isNotNull()
    some = scalar | ((F.col("kind") == "samples") & F.col("samples").isNotNull()) | ((F.col("kind") == "set_members") & F.col("members").isNotNull())
    return m.where(some).select("_seq", F.concat(F.col("name"), F.lit(":"), body, F.when(F.size("attributes") > 0, F.coalesce(F.concat(F.lit("|#"), F.nullif(F.array_join(tags, ","), F.lit(""))), F.lit(""))).otherwise("")).alias("line"))


GRAPHITE = rf"^\s*([^\s;]+)((?:;[^=;\s]+=[^;\s]*)*)\s+({NUMBER})\s+(-?\d+(?:\.\d+)?)\s*$"


def graphite(lines: DataFrame) -> DataFrame:
    """Gauges of ``path[;tag=value] value time``; a time of -1 is the receipt."""
    ln, g = F.col("line"), lambda i: F.regexp_extract("line", GRAPHITE, i)
    k, v = F.regexp_extract_all(g(2), F.lit(";([^=;]+)=([^;]*)"), F.lit(1)), F.regexp_extract_all(g(2), F.lit(";([^=;]+)=([^;]*)"), F.lit(2))
    return lines.where(ln.rlike(GRAPHITE)).select(
        "_seq", F.when(g(4) == "-1", F.col("ts_ns")).otherwise(V.decimal_nanos(g(4))).alias("ts_ns"), g(1).alias("name"), V.from_pairs(k, F.transform(v, lambda x: V.s(x))).alias("attributes"),
        F.lit("gauge").alias("kind"), V.parse_float(g(3)).alias("value"),
    )


def number_token(c: Column) -> Column:
    """A bound or quantile in a metric path: its decimal text with ``_`` for the point."""
    t = F.regexp_replace(c.cast("string"), r"\.0$", "")
    return F.when(c == float("inf"), "inf").otherwise(F.replace(t, F.lit("."), F.lit("_")))


def multi_value(m: DataFrame, quantiles: dict[float, str] | None = None) -> DataFrame:
    """Metrics as one number per row: name with a dotted suffix, value; non-finite values are left out.

    Distributions need ``count, sum, min, max`` and, per quantile, the column named in
    ``quantiles``; histograms buckets and sum; summaries their own quantiles; sets members.
    """
    part = lambda suffix, v: F.struct(F.lit(suffix).alias("suffix") if isinstance(suffix, str) else suffix.alias("suffix"), v.cast("double").alias("v"))
    none = F.array().cast("array<struct<suffix:string,v:double>>")
    dist = F.array(part(".count", F.col("count")), part(".sum", F.col("sum")), part(".min", F.col("min")), part(".max", F.col("max")), *[part(f".q{q:g}".replace("0.", "0_"), F.col(c)) for q, c in (quantiles or {}).items()])
    total = F.aggregate(F.coalesce("buckets", F.array().cast(m.schema["buckets"].dataType)), F.lit(0).cast("bigint"), lambda n, b: n + b["count"])
    hist = F.concat(F.array(part(".count", total), part(".sum", F.col("sum")), part(".min", F.col("min")), part(".max", F.col("max"))), F.transform("buckets", lambda b: part(F.concat(F.lit(".bucket_"), number_token(b["bound"])), b["count"])))
    summ = F.concat(F.array(part(".count", F.col("count")), part(".sum", F.col("sum"))), F.transform("quantiles", lambda q: part(F.concat(F.lit(".q"), number_token(q["q"])), q["v"])))
    zero = [part(".zero_count", F.col("exp.zero_count"))] if "exp" in m.columns else []
    expo = F.array(part(".count", F.col("count")), part(".sum", F.col("sum")), part(".min", F.col("min")), part(".max", F.col("max")), *zero)
    sets = F.array(part(".count", F.size(F.array_distinct("members"))))
    plain = F.array(part("", F.col("value")))
    parts = F.when(F.col("kind") == "distribution", dist).when(F.col("kind") == "histogram", hist).when(F.col("kind") == "exponential_histogram", expo).when(F.col("kind") == "summary", summ).when(F.col("kind").isin("set", "set_members"), sets).otherwise(plain)
    d = m.withColumn("_p", F.explode_outer(F.filter(F.coalesce(parts, none), lambda p: V.finite(p["v"]).isNotNull()))).where("_p is not null")
    return d.withColumn("name", F.concat("name", F.col("_p.suffix"))).withColumn("value", F.col("_p.v")).drop("_p")


def to_graphite(m: DataFrame) -> DataFrame:
    """``path;tag=value value time`` per number."""
    tags = F.array_sort(F.transform(F.map_entries(F.map_filter("attributes", lambda k, _: ~k.startswith(PRIVATE))), lambda e: F.concat(F.lit(";"), e["key"], F.lit("="), V.text(e["value"]))))
    return m.select("_seq", F.concat(F.regexp_replace("name", r"[\s;]", "_"), F.array_join(tags, ""), F.lit(" "), F.regexp_replace(F.col("value").cast("string"), r"\.0$", ""), F.lit(" "), F.expr("ts_ns div 1000000000").cast("string")).alias("line"))


def influx(lines: DataFrame) -> DataFrame:
    """Gauges named measurement.field of line-protocol lines; text fields become attributes of the point."""
    d = lines.select("_seq", "ts_ns", F.explode_outer(influx_points(F.col("line"))).alias("p")).where("p is not null").select("_seq", F.coalesce(F.col("p.time").try_cast("bigint"), F.col("ts_ns")).alias("ts_ns"), F.col("p.measurement").alias("measurement"), F.transform_values("p.tags", lambda _, v: V.s(v)).alias("attributes"), F.explode("p.fields").alias("field", "raw"))
    d = d.withColumn("v", influx_value(F.col("raw"))).where("v is not null and not startswith(v, 's')")
    value = F.when(F.col("v") == "btrue", 1.0).when(F.col("v") == "bfalse", 0.0).otherwise(V.text(F.col("v")).try_cast("double"))
    return d.select("_seq", "ts_ns", F.concat_ws(".", "measurement", "field").alias("name"), "attributes", F.lit("gauge").alias("kind"), value.alias("value"), V.kind(F.col("v")).alias("value_type"))


def to_influx(m: DataFrame) -> DataFrame:
    """One line per row: measurement and field from the name's last dot."""
    esc = lambda c: F.regexp_replace(c, r"([, =])", r"\\$1")
    meas, field = F.regexp_extract("name", r"^(.*)\.([^.]+)$", 1), F.regexp_extract("name", r"([^.]+)$", 1)
    tags = F.array_sort(F.transform(F.map_entries(F.map_filter("attributes", lambda k, _: ~k.startswith(PRIVATE))), lambda e: F.concat(F.lit(","), esc(e["key"]), F.lit("="), esc(V.text(e["value"])))))
    v = F.when(F.col("value_type") == "i", F.concat(F.col("value").cast("bigint").cast("string"), F.lit("i"))).otherwise(F.col("value").cast("string"))
    return m.select("_seq", F.concat(esc(F.coalesce(F.nullif(meas, F.lit("")), F.col("name"))), F.array_join(tags, ""), F.lit(" "), esc(field), F.lit("="), v, F.lit(" "), F.col("ts_ns").cast("string")).alias("line"))


PROMETHEUS = rf'^([a-zA-Z_:][\w:]*)(?:\{{((?:[^"{{}}]|"(?:[^"\\]|\\.)*")*)\}})?\s+({NUMBER}|[+-]?Inf|NaN)(?:\s+(-?\d+(?:\.\d+)?))?(?:\s+#.*)?$'


def prometheus(lines: DataFrame, openmetrics: bool = False) -> DataFrame:
    """Samples of the exposition format: name, attributes (labels), value, ts_ns, and type of the family (``# TYPE``).

    ``doc`` groups the lines of one exposition (column ``_doc``, else all). Types are
    joined by family name, of which an exposition has few.
    """
    g = lambda i: F.regexp_extract("line", PROMETHEUS, i)
    lab = r'([a-zA-Z_]\w*)="((?:[^"\\]|\\.)*)"'
    k, v = F.regexp_extract_all(g(2), F.lit(lab), F.lit(1)), F.regexp_extract_all(g(2), F.lit(lab), F.lit(2))
    raw = F.transform(v, lambda x: V.s(F.replace(F.replace(F.replace(F.replace(x, F.lit("\\\\"), F.lit("\x00")), F.lit("\\n"), F.lit("\n")), F.lit('\\"'), F.lit('"')), F.lit("\x00"), F.lit("\\"))))
    num = F.when(g(3).rlike("Inf$"), F.when(g(3).startswith("-"), float("-inf")).otherwise(float("inf"))).when(g(3) == "NaN", float("nan")).otherwise(g(3).try_cast("double"))
    ts = F.when(g(4) == "", F.col("ts_ns")).otherwise(V.decimal_nanos(g(4), 9 if openmetrics else 6))
    d = lines.where(~F.col("line").startswith("#") & F.col("line").rlike(PROMETHEUS)).select("_seq", ts.alias("ts_ns"), g(1).alias("name"), V.from_pairs(k, raw).alias("attributes"), num.alias("value"))
    types = lines.where(F.col("line").rlike(r"^# TYPE \S+ \S+")).select(F.regexp_extract("line", r"^# TYPE (\S+) (\S+)", 1).alias("family"), F.regexp_extract("line", r"^# TYPE (\S+) (\S+)", 2).alias("type")).dropDuplicates(["family"])
    d = d.withColumn("family", F.regexp_replace("name", "_(bucket|sum|count|total|created|info)$", ""))
    a = types.withColumnsRenamed({"family": "_f", "type": "_t"})
    exact = d.join(types.withColumnsRenamed({"family": "name", "type": "_exact"}), "name", "left").join(a, F.col("family") == F.col("_f"), "left")
    return exact.withColumn("type", F.coalesce("_exact", "_t", F.lit("untyped"))).withColumn("family", F.when(F.col("_exact").isNotNull(), F.col("name")).otherwise(F.col("family"))).drop("_exact", "_f", "_t")


def prometheus_histograms(samples: DataFrame) -> DataFrame:
    """Histogram rows from _bucket, _sum and _count: buckets are successive differences over ``le``."""
    from pyspark.sql import Window as W

    h = samples.where("type = 'histogram'").withColumn("le", F.when(F.col("attributes")["le"].isin("s+Inf", "sInf"), float("inf")).otherwise(V.text(F.col("attributes")["le"]).try_cast("double")))
    h = h.withColumn("attributes", F.map_filter("attributes", lambda k, _: k != "le")).withColumn("_k", F.to_json(F.array_sort(F.map_entries("attributes"))))
    keys = ["family", "_k", "ts_ns"]
    bucket = F.col("name").endswith("_bucket")
    below = F.lag("value").over(W.partitionBy(*keys, bucket).orderBy("le"))
    h = h.withColumn("c", F.when(bucket, (F.col("value") - F.coalesce(below, F.lit(0.0))).cast("bigint")))
    parts = F.array_sort(F.collect_list(F.when(bucket, F.struct("le", "c"))))
    out = h.groupBy(*keys).agg(
        F.first("attributes").alias("attributes"), F.transform(parts, lambda x: F.struct(x["le"].alias("bound"), x["c"].alias("count"))).alias("buckets"),
        F.max(F.when(F.col("name").endswith("_sum"), F.col("value"))).alias("sum"), F.max(F.when(F.col("name").endswith("_count"), F.col("value"))).cast("bigint").alias("count"),
    )
    return out.select(F.col("family").alias("name"), "attributes", "ts_ns", F.lit("histogram").alias("kind"), F.lit("cumulative").alias("temporality"), "buckets", "sum", "count")


def prometheus_summaries(samples: DataFrame) -> DataFrame:
    """Summary rows from quantile samples, _sum and _count."""
    s = samples.where("type = 'summary'").withColumn("q", V.text(F.col("attributes")["quantile"]).try_cast("double"))
    s = s.withColumn("attributes", F.map_filter("attributes", lambda k, _: k != "quantile")).withColumn("_k", F.to_json(F.sort_array(F.map_entries("attributes"))))
    one = lambda end: F.max(F.when(F.col("name").endswith(end), F.col("value")))
    out = s.groupBy("family", "_k", "ts_ns").agg(F.first("attributes").alias("attributes"), F.sort_array(F.collect_list(F.when(F.col("q").isNotNull(), F.struct("q", F.col("value").alias("v"))))).alias("quantiles"), one("_sum").alias("sum"), one("_count").cast("bigint").alias("count"))
    return out.select(F.col("family").alias("name"), "attributes", "ts_ns", F.lit("summary").alias("kind"), F.lit("cumulative").alias("temporality"), "quantiles", "sum", "count")


def prometheus_states(samples: DataFrame) -> DataFrame:
    """Info and state-set samples as gauges flagged with their type."""
    t = samples.where("type in ('info', 'stateset')")
    return t.select("name", V.merge(F.col("attributes"), F.create_map(F.lit(PRIVATE + "metrics.type"), V.s(F.col("type")))).alias("attributes"), "ts_ns", F.lit("gauge").alias("kind"), "value")


def sanitised_name(c: Column) -> Column:
    """A metric or label name in the exposition format's alphabet."""
    return F.regexp_replace(F.regexp_replace(c, r"[^a-zA-Z0-9_:]", "_"), r"^(\d)", "_$1")


def to_prometheus(m: DataFrame) -> DataFrame:
    """Sample lines of scalar metrics."""
    lab = F.array_sort(F.transform(F.map_entries(F.map_filter("attributes", lambda k, _: ~k.startswith(PRIVATE))), lambda e: F.concat(sanitised_name(e["key"]), F.lit('="'), F.regexp_replace(F.regexp_replace(V.text(e["value"]), r'(["\\])', r"\\$1"), "\n", r"\\n"), F.lit('"'))))
    return m.select("_seq", F.concat(sanitised_name(F.col("name")), F.when(F.size(lab) > 0, F.concat(F.lit("{"), F.array_join(lab, ","), F.lit("}"))).otherwise(""), F.lit(" "), F.regexp_replace(F.col("value").cast("string"), r"\.0$", ""), F.lit(" "), F.expr("ts_ns div 1000000").cast("string")).alias("line"))


_SD_ONE = r'\[[^ \]="]+(?: [^ \]="]+="(?:[^"\\\]]|\\.)*")*\]'
_SD_PARAM = r' ([^ \]="]+)="((?:[^"\\\]]|\\.)*)"'
_SD_AT = rf"^(?:\d+ )?<\d{{1,3}}>\d{{1,2}} \S+ \S+ \S+ \S+ \S+ ((?:{_SD_ONE})+)"


def syslog(lines: DataFrame) -> DataFrame:
    """Log events of syslog lines of either layout; the sender's time stays an attribute, the event's is the receipt."""
    from strandline.operators.log_entries import parse_heads

    h = parse_heads(F.col("line"))
    d = lines.where(F.col("line").rlike(r"^(\d+ )?<\d{1,3}>")).withColumn("h", h).where("h.timestamp is not null")
    pri = F.regexp_extract("line", r"^(?:\d+ )?<(\d{1,3})>", 1).cast("int")
    some = {"syslog.timestamp": "timestamp", "host.name": "host_name", "syslog.tag": "syslog_tag", "process.pid": "process_pid", "syslog.msgid": "syslog_msgid"}
    m = F.create_map(F.lit("syslog.facility"), F.concat(F.lit("i"), F.floor(pri / 8).cast("string")), F.lit("syslog.severity"), F.concat(F.lit("i"), (pri % 8).cast("string")), *[x for k, c in some.items() for x in (F.lit(k), F.when(F.col(f"h.{c}") != "", V.s(F.col(f"h.{c}"))))])
    attrs = F.map_filter(m, lambda _, v: v.isNotNull())
    sd = structured_data(F.regexp_extract("line", _SD_AT, 1))
    attrs = F.when(F.col("line").rlike(_SD_AT), V.merge(attrs, F.create_map(F.lit("syslog.structured_data"), F.concat(F.lit("m"), sd)))).otherwise(attrs)
    return d.select("_seq", "ts_ns", attrs.alias("attributes"), F.col("h.message").alias("message"), F.col("h.severity").alias("severity"))


def structured_data(text: Column) -> Column:
    """JSON text of ``[id name="value" ..]..``: an object of objects; of repeated names the last counts."""
    each = F.regexp_extract_all(text, F.lit(_SD_ONE), F.lit(0))
    def params(e: Column) -> Column:
        names, values = F.regexp_extract_all(e, F.lit(_SD_PARAM), F.lit(1)), F.regexp_extract_all(e, F.lit(_SD_PARAM), F.lit(2))
        return V.from_pairs(names, F.transform(values, lambda v: F.regexp_replace(v, r'\\([\\\]"])', "$1")))
    return F.to_json(V.from_pairs(F.transform(each, lambda e: F.regexp_extract(e, r"^\[([^ \]=\"]+)", 1)), F.transform(each, params)))


def to_syslog(events: DataFrame, layout: str = "rfc5424") -> DataFrame:
    """RFC 5424 lines, or with ``layout="rfc3164"`` those of the older form, whose times are in UTC without a year."""
    if layout == "rfc3164":
        return _to_rfc3164(events)
    a = lambda k: F.coalesce(V.text(F.col("attributes")[k]), F.lit("-"))
    pri = F.coalesce(a("syslog.facility").try_cast("int"), F.lit(1)) * 8 + F.coalesce(a("syslog.severity").try_cast("int"), F.lit(6))
    at = F.date_format(F.timestamp_micros(F.expr("ts_ns div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return events.select("_seq", F.concat_ws(" ", F.concat(F.lit("<"), pri.cast("string"), F.lit(">1")), at, a("host.name"), a("syslog.tag"), a("process.pid"), a("syslog.msgid"), _sd_text(), F.col("message")).alias("line"))


def _sd_text() -> Column:
    """Structured data of the attribute, or a dash."""
    sd = F.from_json(V.text(F.col("attributes")["syslog.structured_data"]), "map<string,map<string,string>>")
    escaped = lambda v: F.regexp_replace(v, r'(["\\\]])', r"\\$1")
    one = lambda e: F.concat(F.lit("["), e["key"], F.array_join(F.transform(F.map_entries(e["value"]), lambda p: F.concat(F.lit(" "), p["key"], F.lit('="'), escaped(p["value"]), F.lit('"'))), ""), F.lit("]"))
    return F.when(F.size(sd) > 0, F.array_join(F.transform(F.map_entries(sd), one), "")).otherwise("-")


def _to_rfc3164(events: DataFrame) -> DataFrame:
    a = lambda k: V.text(F.when(V.present(F.col("attributes")[k]), F.col("attributes")[k]))
    pri = F.coalesce(a("syslog.facility").try_cast("int"), F.lit(1)) * 8 + F.coalesce(a("syslog.severity").try_cast("int"), F.lit(6))
    t = F.timestamp_micros(F.expr("ts_ns div 1000"))
    at = F.concat(F.date_format(t, "MMM "), F.lpad(F.day(t).cast("string"), 2, " "), F.date_format(t, " HH:mm:ss"))
    tag = F.concat(F.coalesce(a("syslog.tag"), F.lit("-")), F.coalesce(F.concat(F.lit("["), a("process.pid"), F.lit("]")), F.lit("")), F.lit(":"))
    return events.select("_seq", F.concat_ws(" ", F.concat(F.lit("<"), pri.cast("string"), F.lit(">"), at), F.coalesce(a("host.name"), F.lit("-")), tag, F.col("message")).alias("line"))


CRI = r"^(\S+) (stdout|stderr) ([FP])(?::\S*)? (.*)$"


def cri(lines: DataFrame, stream: list[str]) -> DataFrame:
    """Container-runtime lines joined over partial flags: per stream, P lines up to the next F are one message."""
    g = lambda i: F.regexp_extract("line", CRI, i)
    d = lines.where(F.col("line").rlike(CRI)).select(*stream, "_seq", g(1).alias("time"), g(2).alias("out"), g(3).alias("flag"), g(4).alias("text"))
    # final parts before a line number its message; counted in pieces, so no task holds a stream
    d = d.withColumns({"_final": (F.col("flag") == "F").cast("int"), "_chunk": F.expr("_seq div 1000000")})
    d = bucketed_prefix(d, [*stream, "out"], "_chunk", ["_seq"], "_final", "entry")
    return d.groupBy(*stream, "out", "entry").agg(F.min("_seq").alias("_seq"), F.min_by("time", "_seq").alias("time"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_seq", "text"))), lambda x: x["text"]), "").alias("message")).drop("entry")


def rejected(lines: DataFrame, pattern: str) -> DataFrame:
    """Lines that a grammar refuses."""
    return lines.where(~F.coalesce(F.col("line").rlike(pattern), F.lit(False)))


def nginx_status(pages: DataFrame) -> DataFrame:
    """Metrics of stub-status pages (column ``page``)."""
    p = r"Active connections:\s*(\d+)[\s\S]*?\n\s*(\d+)\s+(\d+)\s+(\d+)[\s\S]*?Reading:\s*(\d+)\s+Writing:\s*(\d+)\s+Waiting:\s*(\d+)"
    names = ["nginx.connections_current", "nginx.connections_accepted", "nginx.connections_handled", "nginx.http.requests", "nginx.connections_reading", "nginx.connections_writing", "nginx.connections_waiting"]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.regexp_extract("page", p, i + 1).try_cast("double").alias("value"), F.lit("sum" if 1 <= i <= 3 else "gauge").alias("kind")) for i, n in enumerate(names)])
    return pages.where(F.col("page").rlike(p)).select("_seq", "ts_ns", F.inline(rows))


def apache_status(pages: DataFrame) -> DataFrame:
    """``Key: number`` lines of a machine-readable status page."""
    d = pages.select("_seq", "ts_ns", F.explode(F.split("page", "\n")).alias("l"))
    return d.where(F.col("l").rlike(rf"^[\w ]+: {NUMBER}\s*$")).select("_seq", "ts_ns", F.concat(F.lit("apache."), F.replace(F.lower(F.substring_index("l", ":", 1)), F.lit(" "), F.lit("_"))).alias("name"), F.trim(F.substring_index("l", ":", -1)).try_cast("double").alias("value"))
