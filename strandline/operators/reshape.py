"""Per-event reshaping of attributes and payloads; never drops an event."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import ids
from strandline.functions import values as V
from strandline.operators.instants import zoned_candidates
from strandline.schema import METRIC, PRIVATE


def attr(name: str) -> Column:
    return F.col("attributes")[name]


def put(df: DataFrame, values: dict[str, Column], where: str = "attributes") -> DataFrame:
    """Set attributes; a null value leaves the old one."""
    m = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)])
    return df.withColumn(where, V.merge(F.col(where), F.map_filter(m, lambda _, v: v.isNotNull())))


def set_(df: DataFrame, attributes: dict[str, object] | None = None, resource: dict[str, object] | None = None) -> DataFrame:
    """Stamp constants, overwriting."""
    for where, consts in (("attributes", attributes), ("resource", resource)):
        if consts:
            df = put(df, {k: V.literal(v) for k, v in consts.items()}, where)
    return df


def keep(df: DataFrame, fields: list[str], private: str = "drop") -> DataFrame:
    """Only the named attributes; private ones go too unless ``private`` is keep."""
    def stays(k: Column, _: Column) -> Column:
        named = k.isin(fields) if fields else F.lit(False)
        return named | k.startswith(PRIVATE) if private == "keep" else named
    return df.withColumn("attributes", F.map_filter("attributes", stays))


def remove(df: DataFrame, fields: list[str]) -> DataFrame:
    return df.withColumn("attributes", F.map_filter("attributes", lambda k, _: ~k.isin(fields))) if fields else df


def keep_values(df: DataFrame, field: str, allow: list[str], normalize: str | None = None, other: str | None = None, where: str = "attributes") -> DataFrame:
    """Clamp a text value to an allow-list: normalised first, then ``other`` or removed."""
    v = F.col(where)[field]
    t = V.ascii_lower(V.text(v)) if normalize == "lower" else V.text(v)
    new = F.when((V.kind(v) == "s") & t.isin(allow), V.s(t)).when(F.lit(other is not None), F.lit(f"s{other}"))
    changed = F.when(v.isNull(), F.col(where)).when(new.isNull(), F.map_filter(where, lambda k, _: k != field)).otherwise(F.transform_values(where, lambda k, x: F.when(k == field, new).otherwise(x)))
    return df.withColumn(where, changed)


def scale(df: DataFrame, factors: dict[str, float]) -> DataFrame:
    """field *= factor as float; non-numeric fields and non-finite results stay."""
    return put(df, {f: V.float_value(V.finite(V.numeric(attr(f)) * F.lit(float(x)))) for f, x in factors.items()})


def bucket(df: DataFrame, field: str, into: str, ranges: list[tuple[str, float | None, str]], other: str | None = None, keep_source: bool = True) -> DataFrame:
    """Class of a number: ranges are (lt | le | any, bound, class), the first that contains it wins."""
    x = V.numeric(attr(field))
    cls = F.lit(None).cast("string")
    for op, bound, name in reversed(ranges):
        hit = x.isNotNull() if op == "any" else x < bound if op == "lt" else x <= bound
        cls = F.when(hit, F.lit(f"s{name}")).otherwise(cls)
    out = put(df, {into: F.when(attr(field).isNotNull(), F.coalesce(cls, F.lit(f"s{other}") if other is not None else F.lit(None).cast("string")))})
    return out if keep_source else remove(out, [field])


def metric(**parts: Column | object) -> Column:
    """One metric struct; parts that aren't given are null."""
    return F.struct(*[(parts[f.name] if isinstance(parts.get(f.name), Column) else F.lit(parts.get(f.name))).cast(f.dataType).alias(f.name) for f in METRIC])


def kv_metrics(df: DataFrame, counters: list[dict] = (), gauges: list[dict] = (), distributions: list[dict] = ()) -> DataFrame:
    """Append metrics derived from attributes; entries are {name, field?, unit?}. A missing or non-numeric field skips its metric."""
    fields = list(dict.fromkeys(s["field"] for s in (*counters, *gauges, *distributions) if s.get("field")))
    number = {f: F.col(f"_x{i}") for i, f in enumerate(fields)}
    d = df.withColumns({f"_x{i}": V.numeric(attr(f)) for i, f in enumerate(fields)}) if fields else df
    def scalar(spec: dict, **more: object) -> Column:
        if not spec.get("field"):
            return metric(name=spec["name"], unit=spec.get("unit"), value=1.0, value_type="f", **more)
        v, x = attr(spec["field"]), number[spec["field"]]
        whole = V.kind(v).isin("i", "u")
        return F.when(x.isNotNull(), metric(name=spec["name"], unit=spec.get("unit"), value=x, value_i64=F.when(whole, V.text(v).try_cast("bigint")), value_type=F.when(whole, V.kind(v)).otherwise("f"), **more))
    new = [scalar(s, kind="sum", temporality="delta", monotonic=True) for s in counters] + [scalar(s, kind="gauge") for s in gauges]
    for s in distributions:
        x = number[s["field"]]
        new.append(F.when(x.isNotNull(), metric(name=s["name"], unit=s.get("unit"), kind="samples", samples=F.array(x), sample_rate=1.0)))
    kind = df.schema["metrics"].dataType
    made = F.array_compact(F.array(*new)).cast(kind)
    return d.withColumn("metrics", F.when(F.size("metrics") > 0, F.concat("metrics", made)).otherwise(made)).select(df.columns)


def kv_metric_rows(df: DataFrame, counters: list[dict] = (), gauges: list[dict] = (), distributions: list[dict] = ()) -> DataFrame:
    """``explode_metrics(kv_metrics(df))`` of events without metrics of their own, in one step.

    Only a row's number within its event is exploded and every column is a choice by it,
    so no metric is built as a struct first, and columns that aren't used cost nothing.
    """
    specs = [(s, "sum") for s in counters] + [(s, "gauge") for s in gauges] + [(s, "samples") for s in distributions]
    fields = list(dict.fromkeys(s["field"] for s, _ in specs if s.get("field")))
    d = df.select("ts_ns", "_seq", *[c for c in ("_batch",) if c in df.columns], "attributes", "resource", "scope", *[V.numeric(attr(f)).alias(f"_x{i}") for i, f in enumerate(fields)])
    d = d.select("*", F.explode(F.array(*[F.lit(i) for i in range(len(specs))])).alias("_pos"))  # apart: beside a generator the numbers would be made per row
    number = {f: F.col(f"_x{i}") for i, f in enumerate(fields)}
    whole = {f: V.kind(attr(f)).isin("i", "u") for f in fields}

    def by(of) -> Column:  # noqa: ANN001
        out = F.lit(None)
        for i, (s, k) in reversed(list(enumerate(specs))):
            v = of(s, k)
            out = out if v is None else F.when(F.col("_pos") == i, v).otherwise(out)
        return out
    there = by(lambda s, k: number[s["field"]].isNotNull() if s.get("field") else F.lit(True))
    typed = lambda s, k: None if k == "samples" else F.when(whole[s["field"]], V.kind(attr(s["field"]))).otherwise("f") if s.get("field") else F.lit("f")
    made = {
        "name": by(lambda s, k: F.lit(s["name"])), "unit": by(lambda s, k: F.lit(s["unit"]) if s.get("unit") else None), "kind": by(lambda s, k: F.lit(k)),
        "value": by(lambda s, k: None if k == "samples" else number[s["field"]] if s.get("field") else F.lit(1.0)), "value_type": by(typed),
        "value_i64": by(lambda s, k: F.when(whole[s["field"]], V.text(attr(s["field"])).try_cast("bigint")) if k != "samples" and s.get("field") else None),
        "temporality": by(lambda s, k: F.lit("delta") if k == "sum" else None), "monotonic": by(lambda s, k: F.lit(True) if k == "sum" else None),
        "samples": by(lambda s, k: F.array(number[s["field"]]) if k == "samples" else None), "sample_rate": by(lambda s, k: F.lit(1.0) if k == "samples" else None),
    }
    return d.where(there).select(*[c for c in d.columns if not c.startswith("_x")], *[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METRIC])


TRACEPARENT = r"^([0-9a-f]{2})-([0-9a-f]{32})-([0-9a-f]{16})-([0-9a-f]{2})(-.*)?$"


def trace_context(df: DataFrame, trace_id_field: str = "traceparent", span_id_field: str | None = None, flags_field: str | None = None, keep_source: bool = False, id_format: str = "hex", trace_id_high_field: str | None = None) -> DataFrame:
    """Lift a traceparent, or id attributes, onto the log; invalid or all-zero ids leave the event unchanged.

    An explicit span id or flags attribute beats what the traceparent says. With
    ``id_format="decimal"`` the id attributes are decimal 64-bit numbers (a trace id may
    also be 32 hex digits), and ``trace_id_high_field``, 1 to 16 hex digits, gives the
    upper half of a trace id that has none.
    """
    if id_format == "decimal":
        return _decimal_context(df, trace_id_field, span_id_field, flags_field, keep_source, trace_id_high_field)
    v = V.text(F.when(V.present(attr(trace_id_field)), attr(trace_id_field)))
    tp = v.rlike(TRACEPARENT) & ~v.startswith("ff") & (~v.startswith("00") | (F.length(v) == 55))
    hex_id = F.lower(v)
    trace = F.when(tp, F.regexp_extract(v, TRACEPARENT, 2)).when(hex_id.rlike("^[0-9a-f]{32}$"), hex_id)
    own_span = F.lower(V.text(attr(span_id_field))) if span_id_field else F.lit(None).cast("string")
    span = F.coalesce(F.when(own_span.rlike("^[0-9a-f]{16}$"), own_span), F.when(tp, F.regexp_extract(v, TRACEPARENT, 3)))
    own_flags = V.text(attr(flags_field)).try_cast("int") if flags_field else F.lit(None).cast("int")
    flags = F.coalesce(own_flags, F.when(tp, F.conv(F.regexp_extract(v, TRACEPARENT, 4), 16, 10).cast("int")))
    bad_span = F.coalesce(span == "0" * 16, F.lit(False)) | ((own_span.isNotNull() & ~own_span.rlike("^[0-9a-f]{16}$")) if span_id_field else F.lit(False))
    ok = F.coalesce(F.col("log").isNotNull() & trace.isNotNull() & (trace != "0" * 32) & ~bad_span, F.lit(False))
    log = F.col("log").withField("trace_id", trace).withField("span_id", span).withField("trace_flags", flags)
    out = df.withColumn("_ok", ok).withColumn("log", F.when(F.col("_ok"), log).otherwise(F.col("log")))
    if not keep_source:
        gone = [f for f in (trace_id_field, span_id_field, flags_field) if f]
        out = out.withColumn("attributes", F.when(F.col("_ok"), F.map_filter("attributes", lambda k, _: ~k.isin(gone))).otherwise(F.col("attributes")))
    return out.drop("_ok")


def _decimal_context(df: DataFrame, trace_field: str, span_field: str | None, flags_field: str | None, keep_source: bool, high_field: str | None) -> DataFrame:
    text = lambda f: V.text(F.when(V.present(attr(f)) & V.kind(attr(f)).isin("s", "i", "u"), attr(f)))
    none = F.lit(None).cast("string")
    low = ids.decimal_hex(text(trace_field))
    whole = F.when(F.lower(text(trace_field)).rlike("^[0-9a-f]{32}$"), F.lower(text(trace_field)))
    high = F.lower(text(high_field)) if high_field else none
    trace = F.coalesce(whole, F.concat(F.lit("0" * 16), low))
    d = df.withColumns({"_trace": trace, "_high": high, "_span": ids.decimal_hex(text(span_field)) if span_field else none, "_flags": text(flags_field).try_cast("int") if flags_field else F.lit(None).cast("int")})
    lifted = F.when(F.col("_trace").startswith("0" * 16) & F.col("_high").isNotNull(), F.concat(F.lpad("_high", 16, "0"), F.substring("_trace", 17, 16))).otherwise(F.col("_trace"))
    bad = (F.col("_high").isNotNull() & ~F.col("_high").rlike("^[0-9a-f]{1,16}$")) | (F.col("_span").isNull() & (text(span_field).isNotNull() if span_field else F.lit(False))) | ~F.coalesce("_flags", F.lit(0)).between(0, 255)
    ok = F.coalesce(F.col("log").isNotNull() & (F.col("_trace") != "0" * 32) & ~bad, F.lit(False))
    out = d.withColumn("_ok", ok).withColumn("log", F.when(F.col("_ok"), F.col("log").withField("trace_id", lifted).withField("span_id", F.col("_span")).withField("trace_flags", F.col("_flags"))).otherwise(F.col("log")))
    if not keep_source:
        gone = [f for f in (trace_field, span_field, flags_field, high_field) if f]
        out = out.withColumn("attributes", F.when(F.col("_ok"), F.map_filter("attributes", lambda k, _: ~k.isin(gone))).otherwise(F.col("attributes")))
    return out.drop("_ok", "_trace", "_high", "_span", "_flags")


def mint_span(df: DataFrame, name: str = "span.name") -> DataFrame:
    """Span from span.start_s / span.end_s / span.duration_s: any two give the third; a lone start or duration ends at the receipt; a lone end is skipped."""
    ns = lambda f: V.decimal_nanos(V.text(attr(f)))
    d = df.withColumn("_s", ns("span.start_s")).withColumn("_e", ns("span.end_s")).withColumn("_d", ns("span.duration_s"))
    start = F.coalesce("_s", F.col("_e") - F.col("_d"), F.when(F.col("_e").isNull(), F.col("ts_ns") - F.col("_d")))
    end = F.coalesce("_e", F.col("_s") + F.col("_d"), F.when(F.col("_s").isNotNull(), F.col("ts_ns")), F.when(F.col("_d").isNotNull(), F.col("ts_ns")))
    d = d.withColumn("_from", start).withColumn("_to", end)
    ok = F.col("log.trace_id").isNotNull() & F.col("_from").isNotNull() & (F.col("_to") >= F.col("_from"))
    span = F.struct(
        F.col("log.trace_id").alias("trace_id"), F.coalesce(F.col("log.span_id"), F.lower(F.hex(F.xxhash64("log.trace_id", "_seq")))).alias("span_id"), F.lit(None).cast("string").alias("parent_span_id"),
        V.text(attr(name)).alias("name"), F.lit("internal").alias("kind"), F.coalesce(V.text(attr("span.status")), F.lit("unset")).alias("status"), F.col("_to").alias("end_ns"), F.col("log.trace_flags").alias("flags"),
    )
    return d.withColumn("span", F.when(ok, span).otherwise(F.col("span"))).withColumn("ts_ns", F.when(ok, F.col("_from")).otherwise(F.col("ts_ns"))).drop("_s", "_e", "_d", "_from", "_to")


def timestamp(df: DataFrame, field: str, format: str, max_skew_ns: int | None = None, keep_source: bool = False, zone: str = "UTC") -> DataFrame:  # noqa: A002
    """Event time from an attribute: rfc3339, rfc3164 (year nearest the receipt), unix_seconds, unix_millis, unix_micros, unix_nanos or a datetime pattern.

    Times without offset are wall times of ``zone``: one that occurs twice is the one
    nearer to the receipt, one that never occurs is read with the offset before the
    change. Skipped, leaving the event unchanged: events with a span, missing or invalid text,
    and instants further than ``max_skew_ns`` from the receipt. The old time goes to
    the log's observed time where that is unset.
    """
    t = V.text(F.when(V.present(attr(field)), attr(field)))
    units = {"unix_seconds": 9, "unix_millis": 6, "unix_micros": 3, "unix_nanos": 0}
    if format in units:
        ns = V.decimal_nanos(t, units[format])
    elif format == "rfc3339":
        p = r"^(\d{4}-\d\d-\d\d)[Tt ](\d\d:\d\d:\d\d)(?:\.(\d{1,9})\d*)?([Zz]|[+-]\d\d:\d\d)$"
        whole = F.concat(F.regexp_extract(t, p, 1), F.lit("T"), F.regexp_extract(t, p, 2), F.upper(F.regexp_extract(t, p, 4)))
        ns = F.when(t.rlike(p), F.unix_micros(F.try_to_timestamp(whole)) * F.lit(1000).cast("bigint") + F.rpad(F.regexp_extract(t, p, 3), 9, "0").cast("bigint"))
    elif format == "rfc3164":
        year = F.year(F.timestamp_seconds(F.expr("ts_ns div 1000000000")))
        p = r"^([A-Z][a-z]{2}) +(\d{1,2}) (\d\d:\d\d:\d\d)$"
        at = lambda y: F.unix_micros(F.try_to_timestamp(F.concat_ws(" ", y.cast("string"), F.regexp_extract(t, p, 1), F.regexp_extract(t, p, 2), F.regexp_extract(t, p, 3)), F.lit("yyyy MMM d HH:mm:ss"))) * F.lit(1000).cast("bigint")
        walls = F.array_compact(F.transform(F.array(year - 1, year, year + 1), at))
        instants = walls if zone == "UTC" else F.flatten(F.transform(walls, lambda w: F.transform(zoned_candidates(F.floor(w / 1000), F.lit(zone)), lambda u: u * F.lit(1000).cast("bigint"))))
        near = F.array_min(F.transform(instants, lambda u: F.struct(F.abs(u - F.col("ts_ns")).alias("d"), u.alias("u"))))
        ns = F.when(t.rlike(p), near["u"])
    else:
        wall = F.unix_micros(F.try_to_timestamp(t, F.lit(format)))
        if zone == "UTC" or any(c in re.sub("'[^']*'", "", format) for c in "XxZzVO"):  # an offset of its own
            ns = wall * F.lit(1000).cast("bigint")
        else:
            ns = F.array_min(F.transform(zoned_candidates(wall, F.lit(zone)), lambda u: F.struct(F.abs(u * 1000 - F.col("ts_ns")).alias("d"), (u * 1000).alias("u"))))["u"]
    ok = ns.isNotNull() & F.col("span").isNull()
    if max_skew_ns is not None:
        ok = ok & (F.abs(ns - F.col("ts_ns")) <= max_skew_ns)
    d = df.withColumn("_ns", F.when(ok, ns))
    has = F.col("_ns").isNotNull()
    observed = F.when(F.coalesce(F.col("log.observed_ns"), F.lit(0)) == 0, F.col("ts_ns")).otherwise(F.col("log.observed_ns"))
    d = d.withColumn("log", F.when(has & F.col("log").isNotNull(), F.col("log").withField("observed_ns", observed)).otherwise(F.col("log")))
    if not keep_source:
        d = d.withColumn("attributes", F.when(has, F.map_filter("attributes", lambda k, _: k != field)).otherwise(F.col("attributes")))
    return d.withColumn("ts_ns", F.coalesce("_ns", "ts_ns")).drop("_ns")


#: Levels that ``flatten`` unfolds by projections; deeper values of the few rows that have them go through Arrow.
FLAT_LEVELS = 3


def _java_double(x: float) -> str:
    """A double as the JVM spells it."""
    if x != x or x in (float("inf"), float("-inf")):
        return {"nan": "NaN", "inf": "Infinity", "-inf": "-Infinity"}[str(x)]
    digits, _, exponent = repr(x).partition("e")
    if not exponent and 1e-3 <= abs(x) < 1e7 or x == 0:
        return digits
    m, e = f"{x:.16e}".split("e")
    short = repr(float(m + "e0"))
    for places in range(1, 17):
        short = f"{x:.{places}e}".split("e")[0]
        if float(f"{x:.{places}e}") == x:
            break
    return f"{short}E{int(e)}"


def _unfold(key: str, value: str, arrays: str, depth: int) -> Iterator[tuple[str, str]]:
    """Entries of a typed value, down to ``depth`` further levels."""
    def typed(v: object) -> str:
        if isinstance(v, bool):
            return "b" + str(v).lower()
        if isinstance(v, int):
            return ("u" if v >= 0 else "i") + str(v)
        if isinstance(v, (dict, list)):
            return ("m" if isinstance(v, dict) else "a") + json.dumps(v, separators=(",", ":"), ensure_ascii=False, sort_keys=True)
        return "n" if v is None else "s" + v if isinstance(v, str) else "f" + _java_double(v)

    def walk(k: str, v: object, left: int) -> Iterator[tuple[str, str]]:
        items = list(v.items()) if isinstance(v, dict) else list(enumerate(v)) if isinstance(v, list) and arrays == "index" else []
        if not items or left == 0:
            yield k, typed(v)
            return
        for name, x in items:
            yield from walk(f"{k}.{name}", x, left - 1)
    try:
        yield from walk(key, json.loads(value[1:]), depth)
    except (ValueError, RecursionError):
        yield key, value


def _chosen(key: str, fields: list[str] | None) -> bool:
    return not key.startswith(PRIVATE) if fields is None else any(key == f or key.startswith(f + ".") for f in fields)


def flatten(df: DataFrame, fields: list[str] | None = None, arrays: str = "index", levels: int = 32, where: str = "attributes") -> DataFrame:
    """Nested maps and arrays to dot-joined keys; empty containers, and arrays under ``skip``, stay whole.

    ``levels`` is the depth to unfold, 32 at most; what nests deeper stays whole at its
    key. The first levels are one projection each. Rows that nest deeper are unfolded
    one by one in Arrow batches; of other rows nothing is sent there. Sources go before
    any is expanded, and of equal keys the last wins.
    """
    from strandline.operators.parsers import json_value

    def expand(k: Column, v: Column) -> Column:
        entries = F.from_json(F.when(V.kind(v) == "m", V.text(v)), "map<string,variant>")
        items = F.from_json(F.when(V.kind(v) == "a", V.text(v)), "array<variant>") if arrays == "index" else F.lit(None).cast("array<variant>")
        as_map = F.transform(F.map_entries(entries), lambda e: F.struct(F.concat(k, F.lit("."), e["key"]).alias("key"), json_value(e["value"]).alias("value")))
        as_list = F.transform(items, lambda x, i: F.struct(F.concat(k, F.lit("."), i.cast("string")).alias("key"), json_value(x).alias("value")))
        whole = F.array(F.struct(k.alias("key"), v.alias("value")))
        return F.when(F.size(as_map) > 0, as_map).when(F.size(as_list) > 0, as_list).otherwise(whole)

    def one(df: DataFrame, names) -> DataFrame:  # noqa: ANN001
        e = F.map_entries(where)
        chosen = (lambda x: names(x["key"])) if names else (lambda x: ~x["key"].startswith(PRIVATE))
        rest = F.filter(e, lambda x: ~chosen(x))
        wide = F.flatten(F.transform(F.filter(e, chosen), lambda x: expand(x["key"], x["value"])))
        every = F.concat(rest, wide)
        return df.withColumn(where, V.from_pairs(F.transform(every, lambda x: x["key"]), F.transform(every, lambda x: x["value"])))

    pick = None
    if fields is not None:
        def pick(k: Column) -> Column:
            hit = F.lit(False)
            for f in fields:
                hit = hit | (k == f) | k.startswith(f + ".")
            return hit
    levels = min(levels, 32)
    for _ in range(min(levels, FLAT_LEVELS)):
        df = one(df, pick)
    if levels <= FLAT_LEVELS:
        return df

    @F.pandas_udf("map<string,string>")
    def deeper(maps: pd.Series) -> pd.Series:
        def whole(m: object) -> dict[str, str] | None:
            if m is None:
                return None
            out: dict[str, str] = {}
            for k, v in dict(m).items():
                parts = _unfold(k, v, arrays, levels - FLAT_LEVELS) if v is not None and v[:1] in ("m", "a") and _chosen(k, fields) else [(k, v)]
                for name, x in parts:
                    out.pop(name, None)
                    out[name] = x
            return out
        return pd.Series([whole(m) for m in maps])
    nests = (lambda v: (V.kind(v) == "m") & (v != "m{}")) if arrays != "index" else (lambda v: V.kind(v).isin("m", "a") & ~v.isin("m{}", "a[]"))
    chosen = pick or (lambda k: ~k.startswith(PRIVATE))
    deep = F.exists(F.map_entries(where), lambda e: chosen(e["key"]) & nests(e["value"]))
    return df.withColumn(where, F.coalesce(deeper(F.when(deep, F.col(where))), F.col(where)))


def template(text: str, **fields: Column) -> Column:
    """``{name}`` placeholders with ``{{`` and ``}}`` as escapes; ``{name%n}`` is the remainder of an integer."""
    import re

    parts: list[Column] = []
    for m in re.finditer(r"((?:\{\{|\}\}|[^{}])+)|\{(\w+)(?:%(\d+))?\}", text):
        lit, name, mod = m[1], m[2], m[3]
        if lit:
            parts.append(F.lit(lit.replace("{{", "{").replace("}}", "}")))
        else:
            c = fields[name]
            parts.append((F.pmod(c, F.lit(int(mod))) if mod else c).cast("string"))
    return F.concat(*parts) if parts else F.lit("")
