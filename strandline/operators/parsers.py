"""Parsers of log messages into attributes.

Each takes and returns events. A parser never drops an event: what it can't parse
passes through unchanged. Parsed keys overwrite attributes of the same name; of
duplicate keys the later wins. A null message or log passes through.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import values as V


def _message() -> Column:
    return F.col("log.message")


def _merged(df: DataFrame, parsed: Column) -> DataFrame:
    return df.withColumn("_p", parsed).withColumn("attributes", F.when(F.col("_p").isNotNull(), V.merge(F.col("attributes"), F.col("_p"))).otherwise(F.col("attributes"))).drop("_p")


def json_value(v: Column) -> Column:
    """Typed value from a VARIANT: non-negative integers unsigned, negative signed, containers as JSON."""
    tag = lambda t, c: F.concat(F.lit(t), c)
    return V.let(F.to_json(v), lambda j: (
        F.when(j.startswith('"'), tag("s", F.try_variant_get(v, "$", "string"))).when(j.rlike(r"^\d+$"), tag("u", j)).when(j.startswith("{"), tag("m", j)).when(j.startswith("["), tag("a", j))
        .when(j.isin("true", "false"), tag("b", j)).when(j.isNull() | (j == "null"), "n").when(j.rlike(r"^-\d+$"), tag("i", j)).otherwise(tag("f", F.try_variant_get(v, "$", "double").cast("string")))
    ))


def json_object(m: Column) -> Column:
    """Attributes of one JSON object; null if it isn't exactly one object.

    Trailing text beyond the closing brace is refused by the brace that must end the
    text; ``{..} {..}`` is refused because no string-free cut leaves a balanced object.
    """
    t = F.btrim(m, F.lit(" \t\r\n"))
    options = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "allowNonNumericNumbers": "false"}
    raw = F.from_json(F.when(t.startswith("{") & t.endswith("}") & ~F.regexp_replace(t, r'"(?:[^"\\]|\\.)*"', "").rlike(r"\}\s*\{"), t), "map<string,variant>", options)
    entries = F.map_entries(raw)
    return F.when(raw.isNotNull(), V.from_pairs(F.transform(entries, lambda e: e["key"]), F.transform(entries, lambda e: json_value(e["value"]))))


def json(df: DataFrame, skip_to_brace: bool = False, invalid_utf8: str = "reject") -> DataFrame:
    """One JSON object per message. ``skip_to_brace`` starts at the first brace and ignores what follows the object."""
    m = _message()
    if invalid_utf8 == "replace":
        m = F.make_valid_utf8(m)
    if skip_to_brace:
        m = F.when(F.instr(m, "{") > 0, F.regexp_extract(F.expr(f"substr({'make_valid_utf8(log.message)' if invalid_utf8 == 'replace' else 'log.message'}, instr(log.message, '{{'))"), r'^(\{(?:[^{}"]|"(?:[^"\\]|\\.)*"|\{(?:[^{}"]|"(?:[^"\\]|\\.)*"|\{(?:[^{}"]|"(?:[^"\\]|\\.)*")*\})*\})*\})', 1))
    return _merged(df, json_object(m))


def csv_fields(m: Column, n: int, delimiter: str = ",") -> Column:
    """The n fields of one quoted-CSV row, or null for any other shape."""
    d = re.escape(delimiter)
    one = rf'(?:"((?:[^"]|"")*)"|([^"{d}\r\n]*))'
    whole = "^" + d.join([one] * n) + r"\r?\n?$"
    def field(i: int) -> Column:
        quoted, plain = F.regexp_extract(m, whole, 2 * i + 1), F.regexp_extract(m, whole, 2 * i + 2)
        return F.when(quoted != "", F.replace(quoted, F.lit('""'), F.lit('"'))).otherwise(plain)
    return F.when(m.rlike(whole), F.array(*[field(i) for i in range(n)]))


def csv(df: DataFrame, columns: list[str], delimiter: str = ",") -> DataFrame:
    """One row per message by position, all values text; a header line passes through."""
    m = _message()
    f = csv_fields(F.when((m != "") & (m != delimiter.join(columns)), m), len(columns), delimiter)
    pairs = F.create_map(*[x for i, c in enumerate(columns) for x in (F.lit(c), V.s(F.col("_f")[i]))])
    return _merged(df.withColumn("_f", f), F.when(F.col("_f").isNotNull(), pairs)).drop("_f")


#: A token: key and quoted or bare value, or a bare word.
_PAIR = r'[^\s=]+=(?:"(?:[^"\\]|\\.)*"|\S*)|[^\s=]+'


def logfmt(df: DataFrame, bare_keys: bool = False) -> DataFrame:
    """Whitespace-delimited key=value with quoting; an unterminated quote or no pair at all leaves the event as it is."""
    tokens = F.regexp_extract_all(_message(), F.lit(_PAIR), F.lit(0))
    paired = lambda t: F.contains(t, F.lit("="))
    d = df.withColumn("_t", tokens if bare_keys else F.filter(tokens, paired))
    def unescaped(q: Column) -> Column:
        plain = F.replace(F.replace(F.replace(F.replace(F.replace(q, F.lit("\\\\"), F.lit("\x00")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n")), F.lit("\\t"), F.lit("\t")), F.lit("\x00"), F.lit("\\"))
        return F.when(F.contains(q, F.lit("\\")), plain).otherwise(q)
    raw = lambda t: F.substr(t, F.instr(t, "=") + 1)
    inner = lambda r: F.substr(r, F.lit(2), F.length(r) - 2)
    value = lambda t: F.when(~paired(t), F.lit("btrue")).otherwise(F.concat(F.lit("s"), F.when(raw(t).startswith('"'), unescaped(inner(raw(t)))).otherwise(raw(t))))
    t = F.col("_t")
    open_quote = F.exists(t, lambda x: F.contains(x, F.lit('="')) & (~x.endswith('"') | x.endswith('="')) & raw(x).startswith('"'))
    ok = F.exists(t, paired) & ~open_quote
    return _merged(d, F.when(ok, V.from_pairs(F.transform(t, lambda x: F.substring_index(x, "=", 1)), F.transform(t, value)))).drop("_t")


def kv(df: DataFrame, pair_sep: str, kv_sep: str, bare_keys: bool = False) -> DataFrame:
    """Literal split without quoting; blank segments and empty keys are skipped."""
    m = _message()
    if not pair_sep or not kv_sep or pair_sep == kv_sep or pair_sep in kv_sep:
        return df
    segs = F.filter(F.transform(F.split(m, re.escape(pair_sep)), lambda x: F.btrim(x)), lambda x: x != "")
    k = lambda x: F.btrim(F.substring_index(x, kv_sep, 1))
    segs = F.filter(segs, lambda x: (F.contains(x, F.lit(kv_sep)) & (k(x) != "")) | (F.lit(bare_keys) & ~F.contains(x, F.lit(kv_sep))))
    names = F.transform(segs, k)
    vals = F.transform(segs, lambda x: F.when(F.contains(x, F.lit(kv_sep)), V.s(F.btrim(F.substr(x, F.instr(x, kv_sep) + len(kv_sep))))).otherwise(F.lit("btrue")))
    return _merged(df, F.when(F.exists(segs, lambda x: F.contains(x, F.lit(kv_sep))), V.from_pairs(names, vals)))


def regex(df: DataFrame, pattern: str, field: str | None = None) -> DataFrame:
    """First match's named groups; groups that take no part or are empty add nothing."""
    if re.search(r"\(\?[=!]|\(\?<[=!]|\\[1-9]", pattern):
        raise ValueError("look-around and back-references aren't supported")
    java = pattern.replace("(?P<", "(?<")
    compiled = re.compile(pattern.replace("(?<", "(?P<") if "(?P<" not in pattern else pattern)
    if not compiled.groupindex:
        raise ValueError("the pattern has no named group")
    m = V.text(F.when(V.kind(F.col("attributes")[field]) == "s", F.col("attributes")[field])) if field else _message()
    pairs = F.create_map(*[x for name, i in compiled.groupindex.items() for x in (F.lit(name), F.regexp_extract(m, _unnamed(java), i))])
    got = F.transform_values(F.map_filter(pairs, lambda _, v: v != ""), lambda _, v: V.s(v))
    return _merged(df, F.when(m.rlike(_unnamed(java)), got))


def _unnamed(java: str) -> str:
    """Named groups made plain; numbering stays, and names that Java forbids don't matter."""
    return re.sub(r"\(\?<[A-Za-z_]\w*>", "(", java)


#: A line: measurement and tags, fields, optional timestamp.
_LINE = r"^[\s\x00]*((?:[^ \\,]|\\.)+)((?:,(?:[^ \\,=]|\\.)+=(?:[^ \\,]|\\.)+)*) +((?:(?:[^ \\=,\"]|\\.)+=(?:\"(?:[^\"\\]|\\.)*\"|[^ ,\"]+),?)+)(?: +(-?\d+))? *$"
_TAG = r",((?:[^ \\,=]|\\.)+)=((?:[^ \\,]|\\.)+)"
_FIELD = r"((?:[^ \\=,\"]|\\.)+)=(\"(?:[^\"\\]|\\.)*\"|[^ ,\"]+)"


def influx_points(text: Column) -> Column:
    """ARRAY of (measurement, tags, fields, time) of the parseable lines; comments and blanks skipped."""
    lines = F.filter(F.split(text, "\n"), lambda x: ~x.rlike(r"^\s*(#.*)?$") & x.rlike(_LINE))
    plain = lambda c: F.regexp_replace(c, r"\\([,= ])", "$1")
    def pairs(c: Column, p: str) -> Column:
        k, v = F.regexp_extract_all(c, F.lit(p), F.lit(1)), F.regexp_extract_all(c, F.lit(p), F.lit(2))
        return V.from_pairs(F.transform(k, plain), v)
    return F.transform(lines, lambda x: F.struct(
        plain(F.regexp_extract(x, _LINE, 1)).alias("measurement"), F.transform_values(pairs(F.regexp_extract(x, _LINE, 2), _TAG), lambda _, v: plain(v)).alias("tags"),
        pairs(F.regexp_extract(x, _LINE, 3), _FIELD).alias("fields"), F.regexp_extract(x, _LINE, 4).alias("time"),
    ))


def influx_value(v: Column) -> Column:
    """Typed value of a field: 1i, 1u, 1.5, booleans, quoted text; else null."""
    return (
        F.when(v.rlike(r"^-?\d+i$"), F.concat(F.lit("i"), F.regexp_replace(v, "i$", "").try_cast("bigint").cast("string")))
        .when(v.rlike(r"^\d+u$"), F.concat(F.lit("u"), F.regexp_replace(v, "u$", "").try_cast("decimal(20,0)").cast("string")))
        .when(v.rlike(r"^-?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"), F.concat(F.lit("f"), V.finite(v.try_cast("double")).cast("string")))
        .when(v.isin("t", "T", "true", "True", "TRUE"), "btrue").when(v.isin("f", "F", "false", "False", "FALSE"), "bfalse")
        .when(v.startswith('"'), F.concat(F.lit("s"), F.regexp_replace(F.regexp_replace(v, '^"|"$', ""), r'\\(["\\])', "$1")))
    )


def line_protocol_events(df: DataFrame, precision: str = "ns", keep_source: bool = False) -> DataFrame:
    """Events to events: one per point, with a gauge ``measurement.field`` per number or boolean and text fields as attributes.

    A point has its parent's resource and scope, its tags over the parent's attributes,
    and no log. Parents stay with ``keep_source``, and without their log where they have
    metrics or a span; events without any point pass unchanged.
    """
    from strandline.schema import FIELD, METRIC

    p = line_protocol(df, precision).withColumn("_text", F.col("value").startswith("s"))
    number = F.when(F.col("value") == "btrue", 1.0).when(F.col("value") == "bfalse", 0.0).otherwise(V.text(F.col("value")).try_cast("double"))
    made = {"name": F.concat_ws(".", "measurement", "field"), "kind": F.lit("gauge"), "value": number, "value_i64": F.when(F.col("value").startswith("i"), V.text(F.col("value")).try_cast("bigint")), "value_type": V.kind(F.col("value"))}
    one = F.struct(*[made.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METRIC])
    g = p.groupBy("_seq", "measurement", "tags", "point_ns").agg(
        F.array_sort(F.collect_list(F.when(~F.col("_text"), one)), lambda a, b: F.when(a["name"] < b["name"], -1).when(a["name"] > b["name"], 1).otherwise(0)).alias("metrics"), F.collect_list(F.when(F.col("_text"), F.struct(F.concat(F.lit(FIELD), "field").alias("key"), F.col("value").alias("value")))).alias("_fields"), F.first("attributes").alias("attributes"))
    g = g.withColumn("attributes", V.merge(F.col("attributes"), F.map_from_entries("_fields"))).select("_seq", F.col("point_ns").alias("ts_ns"), "attributes", "metrics")
    rest = [c for c in df.columns if c not in ("_seq", "ts_ns", "attributes", "metrics", "log")]
    points = g.join(df.select("_seq", *rest), "_seq").withColumn("span", F.lit(None).cast(df.schema["span"].dataType)).withColumn("log", F.lit(None).cast(df.schema["log"].dataType))
    some = g.select("_seq").distinct().withColumn("_hit", F.lit(True))
    parents = df.join(some, "_seq", "left")
    stays = F.col("_hit").isNull() | F.lit(keep_source) | F.coalesce(F.size("metrics") > 0, F.lit(False)) | F.col("span").isNotNull()
    log = F.when(F.col("_hit").isNull() | F.lit(keep_source), F.col("log"))
    return points.select(df.columns).unionByName(parents.where(stays).withColumn("log", log).select(df.columns))


def line_protocol(df: DataFrame, precision: str = "ns", keep_source: bool = False) -> DataFrame:
    """Points of the message, exploded: parent columns plus measurement, tags, field, value, point_ns.

    Tags win over the parent's attributes. Points of one message with equal measurement,
    tags and time are one point; of a repeated field the later value counts. A point
    without time takes the parent's.
    """
    scale = {"ns": 1, "us": 1000, "ms": 1_000_000, "s": 1_000_000_000}[precision]
    d = df.select("*", F.posexplode_outer(influx_points(_message())).alias("_i", "_pt")).where("_pt is not null")
    d = d.withColumn("point_ns", F.coalesce(F.col("_pt.time").try_cast("bigint") * scale, F.col("ts_ns")))
    d = d.select(*df.columns, "_i", "point_ns", F.col("_pt.measurement").alias("measurement"), F.col("_pt.tags").alias("tags"), F.explode("_pt.fields").alias("field", "_raw"))
    d = d.withColumn("value", influx_value(F.col("_raw"))).where("value is not null")
    last = F.max_by("value", "_i").alias("value")
    out = d.groupBy("_seq", "measurement", "tags", "point_ns", "field").agg(last, F.first("attributes").alias("parent"))
    out = out.withColumn("attributes", V.merge(F.col("parent"), F.transform_values("tags", lambda _, v: V.s(v)))).drop("parent")
    return out if not keep_source else out.unionByName(df.select("_seq", F.col("ts_ns").alias("point_ns"), "attributes"), allowMissingColumns=True)
