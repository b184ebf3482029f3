"""The engine's operators: fixed vectors, rules on small inputs, round trips, graph, functions, streams."""

import math
import random
import struct
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from strandline.functions import hashing, sketch
from strandline.functions import values as V
from strandline.operators import aggregate, delta, filters, http_access, parsers, reshape, route, script, shape
from strandline.plans import graph
from strandline.schema import EVENT, METRIC, PRIVATE
from strandline.sources import binary, io, json_formats, text
from strandline.streaming import windows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def event(seq=1, ts=1_700_000_000_000_000_000, attributes=None, message=None, metrics=(), span=None, resource=None, origin=None):
    log = None if message is None else Row(message=message, severity="info", body_format="raw", trace_id=None, span_id=None, trace_flags=None, event_name=None, observed_ns=0, dropped=0)
    return (ts, attributes or {}, resource or {}, {}, log, list(metrics), span, origin, None, 0, seq)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


def messages(spark, *texts):
    return events(spark, *[event(i, message=t, attributes={"old": "s1", "a": "sold"}) for i, t in enumerate(texts)])


def attributes(df):
    return [r.attributes for r in df.orderBy("_seq").collect()]


class TestValues:
    def test_hash_vectors(self, spark):
        signed = lambda h: struct.unpack(">q", bytes.fromhex(h))[0]
        for t, h in [("", "EF46DB3751D8E999"), ("a", "D24EC4F1A98C6E5B"), ("abc", "44BC2CF5AD770999"), ("4bf92f3577b34da6a3ce929d0e0e4736", "2AB28D25664B8CFD")]:
            assert one(spark, hashing.xxh64(F.lit(t))) == signed(h)
        for v, h in [("i200", "25436E545A8BCC7C"), ("i-7", "0C4EC0C6AD41198F"), ("f0.5", "1DC89AF31B8D1B23"), ("f-0.0", "8E56E730C4927269"), ("btrue", "D7C9B97948142E4A"), ("bfalse", "6D3F99CCC0C03A7A")]:
            assert one(spark, hashing.hash_value(F.lit(v))) == signed(h), v
        assert one(spark, hashing.hash_value(F.lit("a[1]"))) is None

    def test_keep(self, spark):
        d = spark.range(20_000).select(hashing.xxh64(F.col("id").cast("string")).alias("h"))
        assert abs(d.where(hashing.keep(F.col("h"), 0.25)).count() / 20_000 - 0.25) < 0.02
        assert d.where(hashing.keep(F.col("h"), 0)).count() == 0 and d.where(hashing.keep(F.col("h"), math.nan)).count() == 20_000

    @pytest.mark.parametrize("want,actual,hit", [("01", "s1", False), ("200", "i200", True), (200, "s200", True), (200, "f200.0", True), (True, "strue", False), (True, "btrue", True), ("true", "btrue", False), (math.nan, "fNaN", False), (5, "t5", False), ("x", None, False), ("[1]", "a[1]", False), ("a", "sa", True)])
    def test_value_matches(self, spark, want, actual, hit):
        assert one(spark, V.value_matches(want, F.lit(actual).cast("string"))) is hit

    def test_numeric(self, spark):
        for v, n in [("s1", 1.0), ("s 1 ", None), ("s1d", None), ("sinf", None), ("fNaN", None), ("u18446744073709551615", 1.8446744073709552e19), ("btrue", None), ("s.5e1", 5.0), ("n", None), (None, None)]:
            assert one(spark, V.numeric(F.lit(v).cast("string"))) == n, v

    def test_decimal_nanos(self, spark):
        for t, d, n in [("1725400000.123456789", 9, 1725400000123456789), ("5", 0, 5), ("1.5", 6, 1_500_000), ("-1.25", 9, -1_250_000_000), ("x", 9, None), ("99999999999999999999", 9, None), ("", 9, None)]:
            assert one(spark, V.decimal_nanos(F.lit(t), d)) == n, t

    def test_maps(self, spark):
        assert one(spark, V.from_pairs(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit("1"), F.lit("2"), F.lit("3")))) == {"a": "3", "b": "2"}
        assert one(spark, V.merge(F.lit(None).cast("map<string,string>"), F.create_map(F.lit("a"), F.lit("1")))) == {"a": "1"}

    def test_sketch_error(self, spark):
        r = random.Random(1)
        vals = [r.lognormvariate(3, 2) * r.choice([1, -1, 1]) for _ in range(2000)] + [0.0, math.inf, math.nan]
        b = sketch.bins(spark.createDataFrame([(1, v) for v in vals], "g int, v double"), ["g"], "v")
        q = sketch.quantiles(b, ["g"], [0.05, 0.5, 0.99]).withColumns({c: sketch.representative(F.col(c)) for c in ("k_0_05", "k_0_5", "k_0_99")}).first()
        s = sorted(v for v in vals if math.isfinite(v))
        for p, c in [(0.05, "k_0_05"), (0.5, "k_0_5"), (0.99, "k_0_99")]:
            exact = s[round(p * (len(s) - 1))]
            assert abs(q[c] - exact) <= 0.0079 * abs(exact) + 1e-9
        whole = b.groupBy("g").agg(sketch.bin_map(F.collect_list(F.struct("key", "w")), 50).alias("few"), sketch.bin_map(F.collect_list(F.struct("key", "w"))).alias("all"), F.max("key").alias("top")).first()
        assert len(whole.few) == 50 and sum(whole.few.values()) == len(s) == sum(whole["all"].values()) and whole.top in whole.few
        keys = spark.createDataFrame([(whole["all"],)], "b map<int,double>").select(*sketch.map_quantiles(F.col("b"), [0.05, 0.5, 0.99])).first()
        plain = sketch.quantiles(b, ["g"], [0.05, 0.5, 0.99]).first()
        assert tuple(keys) == (plain.k_0_05, plain.k_0_5, plain.k_0_99)


class TestParsers:
    def test_json(self, spark):
        df = messages(spark, '{"a":1,"b":-2,"c":1.5,"d":"x","e":null,"f":true,"g":{"h":[1]},"i":[1,"2"]}', '{"a":1} junk', "[1]", "", "{'a':1}", '{"a":1}{"a":2}', '{"a":"1","a":"2"}', "{}", '{"a":"} {"}')
        got = attributes(parsers.json(df))
        assert got[0] == {"old": "s1", "a": "u1", "b": "i-2", "c": "f1.5", "d": "sx", "e": "n", "f": "btrue", "g": 'm{"h":[1]}', "i": 'a[1,"2"]'}
        same = {"old": "s1", "a": "sold"}
        assert got[1:6] == [same] * 5
        assert got[6]["a"] == "s2" and got[7] == same and got[8]["a"] == "s} {"
        assert attributes(parsers.json(messages(spark, 'x {"a":{"b":1},"c":2} tail', "no"), skip_to_brace=True)) == [{"old": "s1", "a": 'm{"b":1}', "c": "u2"}, same]
        assert attributes(parsers.json(events(spark, event()))) == [{}]

    def test_csv(self, spark):
        got = attributes(parsers.csv(messages(spark, 'x,"y, ""z""",', "x,y", "a,b,c", "", 'x,"y,z'), ["a", "b", "c"]))
        assert got == [{"old": "s1", "a": "sx", "b": 'sy, "z"', "c": "s"}] + [{"old": "s1", "a": "sold"}] * 4

    def test_logfmt(self, spark):
        got = attributes(parsers.logfmt(messages(spark, 'a=1 b="x \\"y\\" z" c= d=e=f flag', 'a="x', "bare words", "a=1 a=2"), bare_keys=True))
        assert got[0] == {"old": "s1", "a": "s1", "b": 'sx "y" z', "c": "s", "d": "se=f", "flag": "btrue"}
        assert got[1] == got[2] == {"old": "s1", "a": "sold"} and got[3]["a"] == "s2"
        assert "flag" not in attributes(parsers.logfmt(messages(spark, "a=1 flag")))[0]

    def test_kv(self, spark):
        assert attributes(parsers.kv(messages(spark, "a=1&b==2&&=x& c = y ", "nothing", "=1&=2"), "&", "=")) == [{"old": "s1", "a": "s1", "b": "s=2", "c": "sy"}] + [{"old": "s1", "a": "sold"}] * 2
        assert attributes(parsers.kv(messages(spark, "a=1"), "", "=")) == [{"old": "s1", "a": "sold"}]

    def test_regex(self, spark):
        assert attributes(parsers.regex(messages(spark, "n=5 z", "none", "n=7"), r"n=(?P<n>\d+)(?: (?P<rest>\w+))?")) == [{"old": "s1", "a": "sold", "n": "s5", "rest": "sz"}, {"old": "s1", "a": "sold"}, {"old": "s1", "a": "sold", "n": "s7"}]
        with pytest.raises(ValueError):
            parsers.regex(messages(spark, "x"), r"(?=x)(?<a>x)")

    def test_line_protocol(self, spark):
        m = 'heap free=61088i,total=79012i,ok=t,name="a b" 5\n# c\nbad line\ncpu\\ x,host=a\\ b v=1.5,v=2.5'
        got = {(r.measurement, r.field): (r.value, r.point_ns, r.attributes.get("host")) for r in parsers.line_protocol(events(spark, event(1, ts=77, message=m))).collect()}
        assert got == {("heap", "free"): ("i61088", 5, None), ("heap", "total"): ("i79012", 5, None), ("heap", "ok"): ("btrue", 5, None), ("heap", "name"): ("sa b", 5, None), ("cpu x", "v"): ("f2.5", 77, "sa b")}


class TestReshape:
    def test_flatten(self, spark):
        a = {"x": 'm{"b":{"c":1},"e":{}}', "l": 'a["p",["q"]]', PRIVATE + "k": 'm{"z":1}', "s": "st"}
        full = attributes(reshape.flatten(events(spark, event(attributes=a))))[0]
        assert full == {"x.b.c": "u1", "x.e": "m{}", "l.0": "sp", "l.1.0": "sq", PRIVATE + "k": 'm{"z":1}', "s": "st"}
        skip = attributes(reshape.flatten(events(spark, event(attributes=a)), fields=["x", "l"], arrays="skip"))[0]
        assert skip["l"] == a["l"] and skip["x.b.c"] == "u1"

    def test_flatten_goes_deep(self, spark):
        deep = '{"k":' * 40 + "1" + "}" * 40
        a = {"x": "m" + deep, "l": 'a[[[[["q",-1,1e10,true,null,2.5]]]]]', "e": "m{}", PRIVATE + "p": 'm{"a":{"b":{"c":{"d":1}}}}', "bad": "m{"}
        full = attributes(reshape.flatten(events(spark, event(1, attributes=a), event(2, attributes={"s": "st"}))))
        assert full[1] == {"s": "st"}
        assert full[0]["x" + ".k" * 32] == "m" + '{"k":' * 8 + "1" + "}" * 8 and full[0]["e"] == "m{}" and full[0][PRIVATE + "p"] == a[PRIVATE + "p"] and full[0]["bad"] == "m{"
        assert [full[0][f"l.0.0.0.0.{i}"] for i in range(6)] == ["sq", "i-1", "f1.0E10", "btrue", "n", "f2.5"]
        few = attributes(reshape.flatten(events(spark, event(attributes=a)), levels=5))[0]
        assert few["x" + ".k" * 5].startswith("m{") and reshape._java_double(1.5e-7) == "1.5E-7" and reshape._java_double(100.0) == "100.0"
        assert reshape.flatten(events(spark)).count() == 0

    def test_decimal_trace_ids(self, spark):
        rows = [{"t": "s1"}, {"t": "s18446744073709551615", "h": "sff"}, {"t": "s18446744073709551616"}, {"t": "s0"}, {"t": "s" + "ab" * 16, "h": "sff"}, {"t": "i7", "s": "sx"}, {"t": "u7", "s": "i9"}, {"t": "s5", "h": "sxyz"}, {}]
        out = reshape.trace_context(events(spark, *[event(i, attributes=a, message="m") for i, a in enumerate(rows)]), "t", "s", id_format="decimal", trace_id_high_field="h").orderBy("_seq").collect()
        z = "0" * 16
        assert [r.log.trace_id for r in out] == [z + "0" * 15 + "1", "0" * 14 + "ff" + "f" * 16, None, None, "ab" * 16, None, z + "0" * 15 + "7", None, None]
        assert out[6].log.span_id == "0" * 15 + "9" and out[6].attributes == {} and out[5].attributes == rows[5]

    def test_zoned_times(self, spark):
        def at(text, zone, fmt="yyyy-MM-dd HH:mm:ss", receipt="2025-10-26T01:20:00"):
            ns = int((__import__("datetime").datetime.fromisoformat(receipt + "+00:00")).timestamp()) * 10**9
            r = reshape.timestamp(events(spark, event(1, ts=ns, attributes={"t": "s" + text}, message="m")), "t", fmt, zone=zone).first()
            return __import__("datetime").datetime.fromtimestamp(r.ts_ns / 1e9, __import__("datetime").timezone.utc).strftime("%H:%M:%S")
        assert at("2025-10-26 02:30:00", "Europe/Berlin") == "01:30:00"  # twice: the later one is nearer
        assert at("2025-10-26 02:30:00", "Europe/Berlin", receipt="2025-10-26T00:20:00") == "00:30:00"
        assert at("2025-03-30 02:30:00", "Europe/Berlin", receipt="2025-03-30T01:00:00") == "01:30:00"  # never: the offset before
        assert at("Oct 26 04:00:00", "Europe/Berlin", "rfc3164") == "03:00:00"

    def test_minted_ids(self, spark):
        from strandline.functions import ids

        r = spark.createDataFrame([(0,), (1_700_000_000_123,), (2**48,), (-1,), (None,)], "ms bigint").select("ms", ids.uuid_v7(F.col("ms")).alias("u"), ids.ulid(F.col("ms")).alias("l"), ids.uuid_v4().alias("v")).collect()
        assert r[1].u.replace("-", "")[:12] == f"{1_700_000_000_123:012x}" and r[1].u[14] == "7" and len(r[1].u) == 36
        assert r[0].l.startswith("0" * 10) and len(r[1].l) == 26 and r[1].l[:10] == "".join(ids.CROCKFORD[1_700_000_000_123 >> 5 * i & 31] for i in range(9, -1, -1)) and all(x.u is None and x.l is None for x in r[2:]) and len({x.v for x in r}) == 5
        assert one(spark, ids.decimal_hex(F.lit("255"))) == "0" * 14 + "ff" and one(spark, ids.decimal_hex(F.lit("0"))) is None and one(spark, ids.hex_decimal(F.lit("ff"))) == "255"

    def test_keep_values(self, spark):
        df = events(spark, event(1, attributes={"m": "sGET"}), event(2, attributes={"m": "sx"}), event(3), event(4, attributes={"m": "i5"}))
        assert attributes(reshape.keep_values(df, "m", ["get"], "lower")) == [{"m": "sget"}, {}, {}, {}]
        assert attributes(reshape.keep_values(df, "m", ["get"], "lower", "other")) == [{"m": "sget"}, {"m": "sother"}, {}, {"m": "sother"}]

    def test_keep_remove_set_scale_bucket(self, spark):
        df = events(spark, event(attributes={"a": "s1.5", "b": "sx", PRIVATE + "p": "s1"}))
        assert attributes(reshape.keep(df, ["a"])) == [{"a": "s1.5"}] and attributes(reshape.keep(df, [])) == [{}]
        assert attributes(reshape.keep(df, [], private="keep")) == [{PRIVATE + "p": "s1"}]
        assert attributes(reshape.set_(df, {"b": 5, "n": None}))[0]["b"] == "i5"
        assert attributes(reshape.scale(df, {"a": 2, "b": 2, "zz": 1}))[0] == {"a": "f3.0", "b": "sx", PRIVATE + "p": "s1"}
        assert attributes(reshape.bucket(df, "a", "c", [("lt", 1.5, "low"), ("le", 1.5, "mid")], keep_source=False))[0].get("c") == "smid"
        assert attributes(reshape.bucket(df, "b", "c", [("any", None, "n")], other="?"))[0]["c"] == "s?"
        assert "c" not in attributes(reshape.bucket(df, "zz", "c", [("any", None, "n")], other="?"))[0]

    def test_trace_and_span(self, spark):
        tp = "00-4bf92f3577b34da6a3ce929d0e0e4736-00f067aa0ba902b7-01"
        df = events(spark, event(1, attributes={"traceparent": "s" + tp, "span.start_s": "s1700000000.5", "span.duration_s": "s2", "span.name": "sn"}, message="x"), event(2, attributes={"traceparent": "s00-" + "0" * 32 + "-00f067aa0ba902b7-01"}, message="x"), event(3, attributes={"traceparent": "s" + tp}))
        r = reshape.trace_context(df).orderBy("_seq").collect()
        assert (r[0].log.trace_id, r[0].log.span_id, r[0].log.trace_flags) == (tp[3:35], tp[36:52], 1) and "traceparent" not in r[0].attributes
        assert r[1].log.trace_id is None and "traceparent" in r[1].attributes and "traceparent" in r[2].attributes
        s = reshape.mint_span(reshape.trace_context(df)).orderBy("_seq").collect()
        assert s[0].ts_ns == 1_700_000_000_500_000_000 and s[0].span.end_ns == 1_700_000_002_500_000_000 and s[0].span.name == "n" and s[1].span is None

    def test_timestamp(self, spark):
        t = 1_700_000_000_123_456_789
        def run(value, fmt, **kw):
            return reshape.timestamp(events(spark, event(ts=t, attributes={"t": value}, message="m")), "t", fmt, **kw).first()
        assert run("s1725400000.123456789", "unix_seconds").ts_ns == 1725400000123456789
        assert run("s2024-01-01T00:00:00.1+01:00", "rfc3339").ts_ns == 1_704_063_600_100_000_000
        r = run("sNov 14 22:13:20", "rfc3164")
        assert r.ts_ns == 1_700_000_000_000_000_000 and r.log.observed_ns == t and "t" not in r.attributes
        assert run("s2024/02/03 04:05:06", "yyyy/MM/dd HH:mm:ss").ts_ns == 1_706_933_106_000_000_000
        for bad in ("sx", "s", "s-", "n"):
            assert run(bad, "unix_seconds").ts_ns == t
        assert run("s1", "unix_seconds", max_skew_ns=10).ts_ns == t

    def test_template(self, spark):
        assert one(spark, reshape.template("a{{{seq%3}}}b", seq=F.lit(7))) == "a{1}b"


class TestHttpAccess:
    def run(self, spark, a, **kw):
        return attributes(http_access.http_access(events(spark, event(attributes=a, message="m")), **kw))[0]

    def test_request_line(self, spark):
        r = self.run(spark, {"http-request-line": "sGET /a?b=1&sig=x&Sig= HTTP/2.0", "http.response.status_code": "s000", "http.request.duration": "s1500000000"}, routes=["assets"], route_other="/{o}", status_class=True)
        assert (r["http.request.method"], r["url.path"], r["url.query"], r["network.protocol.version"]) == ("sGET", "s/a", "sb=1&sig=REDACTED&Sig=", "s2")
        assert r["http.response.status_code"] == "i0" and r["span.status"] == "serror" and r["http.response.status_class"] == "sunknown" and "error.type" not in r
        assert r["http.request.duration_s"] == "f1.5" == r["span.duration_s"] and "http.request.duration" not in r and r["span.name"] == "sGET /{o}"

    def test_rules(self, spark):
        bad = self.run(spark, {"http.request.line": "sbroken", "http.request.method": "sget", "user_agent.original": "s-", "url.path": "s/healthz", "server.port": "s80", "upstream.status": "s200, 502"}, routes=["probes"])
        assert bad["http.request.line"] == "sbroken" and bad["http.request.method"] == "s_OTHER" and bad["http.request.method_original"] == "sget"
        assert bad["user_agent.class"] == "snone" and bad["http.route"] == "s/{probe}" and bad["server.port"] == "i80" and bad["upstream.status"] == "s200, 502" and bad["span.name"] == "sHTTP /{probe}"
        capped = self.run(spark, {"url.path": "s/" + "a" * 400, "http.route": "s/mine", "user.name": "sa\x01b"})
        assert len(capped["url.path"]) == 257 and capped["http.route"] == "s/mine" and capped["user.name"] == "sa_b"
        assert attributes(http_access.http_access(events(spark, event(attributes={"http-request-line": "sx"})))) == [{"http-request-line": "sx"}]

    @pytest.mark.parametrize("ua,cls", [("curl/8", "tool"), ("Mozilla/5.0 (compatible; Googlebot/2.1)", "crawler"), ("Mozilla/5.0 CUBOT", "browser"), ("sqlmap/1", "scanner"), ("UptimeRobot/2.0", "tool"), ("thing", "other")])
    def test_agents(self, spark, ua, cls):
        assert self.run(spark, {"user_agent.original": "s" + ua})["user_agent.class"] == "s" + cls

    @pytest.mark.parametrize("h,v,want", [("x-forwarded-for", "10.0.0.1:80, 1.1.1.1", ("s10.0.0.1", "i80")), ("forwarded", 'for="[2001:db8::1]:99";proto=http', ("s2001:db8::1", "i99")), ("x-real-ip", "junk here", (None, None))])
    def test_forwarded(self, spark, h, v, want):
        r = self.run(spark, {f"http.request.header.{h}": "s" + v}, forwarded=h)
        assert (r.get("client.address"), r.get("client.port")) == want

    def test_idempotent(self, spark):
        df = events(spark, event(attributes={"http-request-line": "sGET /a.css?x=1 HTTP/1.1", "http.response.status_code": "s503"}, message="m"))
        once = http_access.http_access(df, ["assets"], "/{o}")
        assert attributes(once) == attributes(http_access.http_access(once, ["assets"], "/{o}"))


class TestFiltersAndRoutes:
    def test_complements(self, spark):
        df = events(spark, event(1, attributes={"a": "s1"}), event(2, attributes={"a": "n"}), event(3))
        a = filters.has_attributes(df, attributes={"a": "1"}).count() + filters.drop_attributes(df, attributes={"a": "1"}).count()
        assert a == 3 and filters.has_attributes(df, present=["a"]).count() == 2

    def test_signals(self, spark):
        df = events(spark, event(1, message="x"), event(2), event(3, message="x", metrics=[Row(**{f.name: None for f in METRIC})]))
        assert filters.has_signal(df, ["logs"]).count() == 2 and filters.has_signal(df, ["logs"], "only").count() == 1 and filters.has_signal(df, ["none"]).count() == 1
        assert filters.keep_signals(df, ["metrics", "none"]).count() == 2 and filters.drop_signals(df, ["logs"]).count() == 1

    def test_stale(self, spark):
        df = events(spark, event(1, ts=0), event(2, ts=100), event(3, ts=10), event(4, ts=500))
        assert {r._seq for r in filters.has_stale(df, 110, 50, 100).collect()} == {3, 4}
        assert {r._seq for r in filters.drop_stale(df, 110, 50, 100).collect()} == {1, 2}

    def test_sample(self, spark):
        df = events(spark, *[event(i, attributes={"k": f"s{i % 50}", "e": "serror" if i % 10 == 0 else "sok"} if i % 2 else {}) for i in range(400)])
        got = filters.sample(df, 0.5, "k", missing="drop").collect()
        assert 0 < len(got) < 200 and {r._seq for r in got} == {r._seq for r in filters.sample(df, 0.5, "k", missing="drop").collect()}
        kept = {r.attributes["k"] for r in got}
        assert all(r._seq in {x._seq for x in got} for r in df.collect() if r.attributes.get("k") in kept)
        assert filters.sample(df, 0, "k", missing="keep").count() == 200 and 100 < filters.sample(df, 0.5).count() < 300

    def test_route(self, spark):
        df = events(spark, event(1, attributes={"s": "i200"}), event(2, attributes={"s": "s404"}), event(3))
        p = route.route(df, "attribute", [("200", ["ok"]), (404, ["bad", "audit"])], "s")
        assert {t: [r._seq for r in d.collect()] for t, d in p.items()} == {"ok": [1], "bad": [2], "audit": [2], "forward": [3]}
        with pytest.raises(ValueError):
            route.destinations([(i, [f"t{i}"]) for i in range(64)], F.lit("s1"))


class TestAggregate:
    """Against a sequential model over random records."""

    def model(self, rows, interval):
        out, passed = {}, {}
        for seq, ts, series, kind, v, flags in sorted(rows):
            key = (ts - ts % interval, series)
            if flags & 1:
                reason = "no_recorded_value"
            elif kind == "summary":
                reason = "no_merge_rule"
            elif v is None or not math.isfinite(v):
                reason = "non_finite"
            else:
                fam = "gauge" if kind.startswith("gauge") else kind
                st = out.setdefault(key, {"fam": fam, "v": 0.0, "at": None, "n": 0})
                reason = None if st["fam"] == fam else "kind_conflict"
            if reason:
                passed[reason] = passed.get(reason, 0) + 1
                continue
            st["n"] += 1
            if kind == "sum" or kind == "gauge_delta":
                st["v"] += v
            elif st["at"] is None or ts >= st["at"]:
                st["v"], st["at"] = v, ts
        return {k: (s["fam"], round(s["v"], 6)) for k, s in out.items()}, passed, sum(s["n"] for s in out.values())

    @pytest.mark.parametrize("seed", range(3))
    def test_model(self, spark, seed):
        r = random.Random(seed)
        rows = [(i, r.randrange(300), r.choice("abc"), r.choice(["sum", "gauge", "gauge_delta", "summary"]), r.choice([1.0, 2.5, -3.0, 7.0, math.nan, math.inf, None]), r.choice([0, 0, 0, 1])) for i in range(150)]
        def metric(kind, v, flags):
            return Row(**{f.name: {"name": "m", "kind": kind, "value": v, "value_type": "f", "flags": flags, "temporality": "delta" if kind == "sum" else None}.get(f.name) for f in METRIC})
        df = events(spark, *[event(i, ts=ts, attributes={"s": "s" + s}, metrics=[metric(k, v, fl)]) for i, ts, s, k, v, fl in rows])
        out, passed = aggregate.aggregate(aggregate.explode_metrics(df.repartition(3)), 100)
        want, reasons, absorbed = self.model(rows, 100)
        got = out.collect()
        assert {(x.window_ns, x.attributes["s"][1:]): (x.kind, round(x.value, 6)) for x in got} == want
        assert {x.reason: x.n for x in passed.groupBy("reason").agg(F.count("*").alias("n")).collect()} == reasons
        assert sum(x.absorbed for x in got) == absorbed and absorbed + sum(reasons.values()) == len(rows)

    def test_series_identity(self, spark):
        m = lambda: Row(**{f.name: {"name": "m", "kind": "sum", "value": 1.0, "temporality": "delta"}.get(f.name) for f in METRIC})
        same = [event(1, attributes={"a": "i1", "b": "sx"}, metrics=[m()]), event(2, attributes={"b": "sx", "a": "i1"}, metrics=[m()])]
        other = [event(3 + i, attributes={"a": v, "b": "sx"}, metrics=[m()]) for i, v in enumerate(["u1", "f1.0", "f0.0", "f-0.0", "s1"])]
        out, _ = aggregate.aggregate(aggregate.explode_metrics(events(spark, *same, *other)), 10**18)
        assert sorted(r.value for r in out.collect()) == [1.0] * 5 + [2.0]

    def test_empty_and_sets(self, spark):
        out, passed = aggregate.aggregate(aggregate.explode_metrics(events(spark)), 100)
        assert out.count() == 0 and passed.count() == 0
        m = [Row(**{f.name: {"name": "m", "kind": "set_members", "members": [str(i % 7), "x"]}.get(f.name) for f in METRIC}) for i in range(20)]
        df = aggregate.explode_metrics(events(spark, *[event(i, metrics=[x]) for i, x in enumerate(m)]))
        assert aggregate.aggregate(df, 10**18, cap=8)[0].first().members == sorted([*"0123456", "x"])
        large = aggregate.aggregate(df, 10**18, cap=7)[0]
        assert large.first().members is None and large.first().set_count == 8
        assert round(large.selectExpr("hll_sketch_estimate(set_sketch)").first()[0]) == 8
        assert round(aggregate.aggregate(df, 10**18, sets="estimate")[0].first().set_count) == 8

    def metrics(self, spark, *rows):
        """Events of (seq, ts, {field: value}) with one metric each."""
        return events(spark, *[event(i, ts=t, metrics=[Row(**{f.name: {"name": "m", **v}.get(f.name) for f in METRIC})]) for i, t, v in rows])

    def test_raw_samples(self, spark):
        s = lambda v, rate=1.0: dict(kind="samples", samples=v, sample_rate=rate)
        few = self.metrics(spark, (2, 1, s([3.0])), (1, 2, s([1.0, 2.0])))
        get = lambda df, **k: aggregate.aggregate(aggregate.explode_metrics(df), 10**9, distributions="samples", **k)[0].first()
        assert get(few).samples == [1.0, 2.0, 3.0] and get(few).bins is None and get(few).d_count == 3
        assert get(few, cap=2).samples is None and sum(get(few, cap=2).bins.values()) == 3
        mixed = get(self.metrics(spark, (1, 1, s([1.0])), (2, 2, s([2.0], 0.5))))
        assert mixed.samples is None and sum(mixed.bins.values()) == 3
        ready = get(self.metrics(spark, (1, 1, s([1.0])), (2, 2, dict(kind="distribution", bins={5: 2.0}))))
        assert ready.samples is None and sum(ready.bins.values()) == 3

    def test_cumulative_histograms(self, spark):
        h = lambda b, t, total=1.0: (t, t * 10, dict(kind="histogram", temporality="delta", buckets=b, count=1, sum=total, min=1.0, max=2.0))
        b = lambda *c: [Row(bound=float(i), count=x) for i, x in enumerate(c)]
        df = self.metrics(spark, h(b(1, 2), 1), h(b(0, 1), 2), h(b(5, 5, 5), 3), h(b(1, 0, 0), 4, None))
        out, _ = aggregate.aggregate(aggregate.explode_metrics(df), 10, temporality="cumulative")
        got = [([x["count"] for x in r.buckets], r.h_sum, r.start_ns) for r in aggregate.cumulate_histograms(out).orderBy("window_ns").collect()]
        assert got == [([1, 2], 1.0, 10), ([1, 3], 2.0, 10), ([5, 5, 5], 1.0, 30), ([6, 5, 5], None, 30)]

    def test_events_in_events_out(self, spark):
        """Mixed events give their log on, passed metrics stay, and nothing is lost."""
        m = lambda **k: Row(**{f.name: {"name": "m", **k}.get(f.name) for f in METRIC})
        rows = [event(i, ts=i, message=f"l{i}" if i % 2 else None, metrics=[m(kind="sum", value=2.0, value_type="f", temporality="delta"), m(kind="summary", count=1)]) for i in range(1, 7)]
        out = aggregate.aggregate_events(events(spark, *rows), 1000).collect()
        assert sorted(r.log.message for r in out if r.log) == ["l1", "l3", "l5"] and all(not r.metrics for r in out if r.log)
        made = [x for r in out for x in r.metrics or []]
        assert sorted((x.kind, x.value) for x in made if x.kind == "sum") == [("sum", 12.0)] and sum(x.kind == "summary" for x in made) == 6
        assert {r.ts_ns for r in out for x in r.metrics or [] if x.kind == "sum"} == {1000}

    def test_links_are_the_first_eight(self, spark):
        df = spark.range(40).select(
            F.lit(5).cast("bigint").alias("ts_ns"), F.col("id").alias("_seq"), *[F.create_map().cast("map<string,string>").alias(c) for c in ("attributes", "resource", "scope")],
            *[{"name": F.lit("m"), "kind": F.lit("sum"), "value": F.lit(1.0), "temporality": F.lit("delta")}.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in METRIC],
            F.struct((F.col("id") % 11).cast("string").alias("trace_id"), F.lit("s").alias("span_id")).alias("link"))
        r = aggregate.aggregate(df, 10)[0].first()
        assert [x.trace_id for x in r.links] == [str(i) for i in range(8)] and r.value == 40.0

    def test_ranks_in_parts(self, spark):
        df = spark.range(3000).select((F.col("id") % 2).alias("g"), (F.col("id") * 7919 % 3001).alias("o"))
        r1, flag = aggregate.beyond(["g"], ["o"], 100, ["o"], salts=8)
        kept = df.withColumn("r", r1).withColumn("x", flag(F.col("r"))).where("not x")
        want = df.groupBy("g").agg(F.sort_array(F.collect_list("o")).alias("l")).collect()
        assert {(r.g, r.o) for r in kept.collect()} == {(w.g, o) for w in want for o in w.l[:100]}

    def test_overflow_keeps_host(self, spark):
        assert one(spark, aggregate.overflow_key(F.create_map(F.lit("a"), F.lit("s1"), F.lit("host.name"), F.lit("sh")))) == {"host.name": "sh", "sl.overflow": "btrue"}


class TestDelta:
    def test_rules(self, spark):
        rows = [("a", 1, 10, 5, 1), ("a", 2, 20, 9, 1), ("a", 3, 20, 9, 1), ("a", 4, 15, 100, 1), ("a", 5, 30, 2, 1), ("a", 6, 40, 50, 35), ("a", 7, 99, None, 1), ("a", 8, 50, 60, 35), ("b", 1, 10, 7, 0)]
        df = spark.createDataFrame(rows, "s string, _seq bigint, ts_ns bigint, value bigint, start bigint")
        got = {(r.s, r._seq): (r.rule, r.delta) for r in delta.cumulative_to_delta(df, ["s"], start="start").collect()}
        assert got == {("a", 1): ("first", 5), ("a", 2): ("difference", 4), ("a", 3): ("duplicate", None), ("a", 4): ("out_of_order", None), ("a", 5): ("reset", 2), ("a", 6): ("reset", 50), ("a", 8): ("difference", 10), ("b", 1): ("first", None)}
        stale = {r._seq: r.rule for r in delta.cumulative_to_delta(df.where("s = 'a' and _seq < 3"), ["s"], max_staleness_ns=5).collect()}
        assert stale == {1: "first", 2: "first"}

    def test_histogram(self, spark):
        b = lambda *c: [Row(bound=float(i), count=x) for i, x in enumerate(c)]
        rows = [("a", 1, 1, b(1, 2), 3.0), ("a", 2, 2, b(2, 5), 9.0), ("a", 3, 3, b(0, 1), 1.0), ("a", 4, 4, b(1, 1, 1), 3.0), ("a", 5, 4, b(9, 9, 9), 3.0)]
        df = spark.createDataFrame(rows, "s string, _seq bigint, ts_ns bigint, buckets array<struct<bound:double,count:bigint>>, sum double")
        got = {r._seq: (r.rule, [x["count"] for x in r.delta_buckets] if r.delta_buckets else None, r.delta_sum) for r in delta.histogram_to_delta(df, ["s"]).collect()}
        assert got == {1: ("first", None, None), 2: ("difference", [1, 3], 6.0), 3: ("reset", [0, 1], 1.0), 4: ("layout", None, None)}


    def test_exponential_histogram(self, spark):
        h = lambda scale, pos, zero=0, off=0, neg=None, noff=0: Row(scale=scale, zero_count=zero, zero_threshold=0.0, pos_offset=off, positive=pos, neg_offset=noff, negative=neg)
        rows = [(1, 1, h(1, [1, 2, 3, 4], off=-3), 1.0, 10), (2, 2, h(0, [1, 6, 9], 2, off=-2), 5.0, 20), (3, 2, h(0, [9]), 9.0, 9), (4, 3, h(0, [2, 1, 1], off=-2), 1.0, 4), (5, 4, h(2, [5]), 2.0, 5), (6, 5, h(2, [5, 1], neg=[2], noff=3), 3.0, 8), (7, 6, None, 0.0, 0), (8, 7, h(2, None, neg=[3], noff=3), 3.0, 8)]
        kind = dict((f.name, f.dataType.simpleString()) for f in METRIC)["exp"]
        df = spark.createDataFrame([("a", *r) for r in rows], f"s string, _seq bigint, ts_ns bigint, exp {kind}, sum double, count bigint")
        got = {r._seq: (r.rule, r.delta_exp and (r.delta_exp.positive, r.delta_exp.negative, r.delta_exp.zero_count), r.delta_sum, r.delta_count) for r in delta.exponential_to_delta(df, ["s"]).collect()}
        # scale 1 to 0: buckets -3, -2, -1, 0 fold to -2: 1, -1: 2 + 3, 0: 4
        assert got == {1: ("first", None, None, None), 2: ("difference", ([0, 1, 5], None, 2), 4.0, 10), 4: ("reset", ([2, 1, 1], None, 0), 1.0, 4), 5: ("layout", None, None, None), 6: ("difference", ([0, 1], [2], 0), 1.0, 3), 8: ("reset", (None, [3], 0), 3.0, 8)}

    def test_hot_series_in_pieces(self, spark, monkeypatch):
        r = random.Random(8)
        rows = [("a" if r.random() < 0.8 else None, i, r.randrange(400), r.randrange(50)) for i in range(500)]
        df = spark.createDataFrame(rows, "s string, _seq bigint, ts_ns bigint, value bigint")
        whole = sorted(map(str, delta.cumulative_to_delta(df, ["s"]).collect()))
        monkeypatch.setattr(delta, "CHUNK", 7)
        assert sorted(map(str, delta.cumulative_to_delta(df, ["s"]).collect())) == whole
        at, want = {}, {}
        for s, i, t, v in rows:
            if s in at and t <= at[s][0]:
                want[i] = "duplicate" if t == at[s][0] else "out_of_order"
                continue
            want[i] = "first" if s not in at else "reset" if v < at[s][1] else "difference"
            at[s] = (t, v)
        assert {x._seq: x.rule for x in delta.cumulative_to_delta(df, ["s"]).collect()} == want


class TestDedup:
    def run(self, spark, *rows, **k):
        """rows: (seq, ts, {field: value}, attributes)."""
        m = lambda v: Row(**{f.name: {"name": "m", **v}.get(f.name) for f in METRIC})
        df = aggregate.explode_metrics(events(spark, *[event(i, ts=t, attributes=a, metrics=[m(v)]) for i, t, v, a in rows]))
        return sorted(delta.dedup_timestamps(df, 100, **k).collect(), key=lambda r: (r.reason is not None, r._seq))

    def test_survivor_keeps_and_takes(self, spark):
        g = lambda v, **k: dict(kind="gauge", value=v, value_type="f", **k)
        got = self.run(spark, (1, 10, g(1.0, start_ns=7, description="d"), {}), (2, 90, g(2.0, flags=1, start_ns=0), {}), (3, 50, g(3.0, start_ns=3), {}), (4, 150, g(4.0), {}), (5, 90, g(5.0), {"a": "s1"}))
        assert [(r._seq, r.value, r.flags, r.start_ns, r.description, r.merged) for r in got] == [(2, 2.0, 1, 3, "d", 3), (4, 4.0, None, None, None, 1), (5, 5.0, None, None, None, 1)]

    def test_reasons(self, spark):
        s = lambda v, i=None, t="i": dict(kind="sum", temporality="delta", value=v, value_i64=i, value_type=t)
        got = self.run(spark, (1, 1, s(1.0, 1), {}), (2, 2, s(2.0, t="f"), {}), (3, 3, s(3.0, 3), {}))
        assert [(r._seq, r.value, r.value_i64, r.merged, r.reason) for r in got] == [(3, 4.0, 4, 2, None), (2, 2.0, None, 1, "mixed_type")]
        big = 2**62
        over = self.run(spark, (1, 1, s(float(big), big), {}), (2, 2, s(float(big), big), {}))
        assert [(r._seq, r.value_i64, r.reason) for r in over] == [(2, big, None), (1, big, "overflow")]
        steps = self.run(spark, *[(i, i, dict(kind="gauge_delta", value=1.0), {}) for i in (1, 2, 3)])
        assert [(r._seq, r.reason) for r in steps] == [(1, None), (2, "no_merge_rule"), (3, "no_merge_rule")]
        rate = lambda v, n: (dict(kind="gauge", value=v, value_type="f"), {PRIVATE + "metrics.type": "srate", PRIVATE + "metrics.interval": n})
        rates = self.run(spark, *[(i, i, *rate(float(i), n)) for i, n in ((1, "u10"), (2, "u10"))])
        assert [(r.value, r.merged) for r in rates] == [(3.0, 2)]
        sampled = self.run(spark, (1, 1, dict(kind="samples", samples=[1.0], sample_rate=1.0), {}), (2, 2, dict(kind="samples", samples=[2.0, 3.0], sample_rate=0.5), {}), (3, 3, dict(kind="samples", samples=[4.0], sample_rate=0.5), {}))
        assert [(r.samples, r.reason) for r in sampled] == [([2.0, 3.0, 4.0], None), ([1.0], "layout_mismatch")]
        sketches = self.run(spark, (1, 1, dict(kind="distribution", bins={1: 1.0, 2: 1.0}, count=2, sum=3.0, min=1.0, max=2.0), {}), (2, 2, dict(kind="distribution", bins={2: 2.0}, count=2, sum=4.0, min=2.0, max=2.0), {}))
        assert [(r.bins, r["count"], r["sum"], r["min"], r["max"]) for r in sketches] == [({1: 1.0, 2: 3.0}, 4, 7.0, 1.0, 2.0)]
        assert self.run(spark) == []


class TestCodecs:
    def lines(self, spark, *ls):
        return spark.createDataFrame([(i, 99, x) for i, x in enumerate(ls)], "_seq bigint, ts_ns bigint, line string")

    def test_statsd(self, spark):
        rows = text.statsd(self.lines(spark, "page.views:1|c|@0.5|#env:prod,region:us,service:web", "p:1|c|#team:a,team:b,team:a", "p:1:2:3|c", "lat:120|ms|@0.1", "u:abc:d|s", "g:+5|g", "g:5|g|T17|c:xyz", "bad", "x:nan|c", "x:1|c|@2", "x:1|q", "u:1|g|#urgent,urgent:1," + PRIVATE + "z:1")).collect()
        by = {}
        for r in rows:
            by.setdefault(r._seq, []).append(r)
        assert set(by) == {0, 1, 2, 3, 4, 5, 6, 11}
        assert by[0][0].value == 2.0 and by[0][0].attributes == {"deployment.environment.name": "sprod", "region": "sus", "service.name": "sweb"}
        assert by[1][0].attributes["team"] == 'a["a","b"]' and [r.value for r in by[2]] == [1.0, 2.0, 3.0]
        assert by[3][0].samples == [120.0] and by[3][0].sample_rate == 0.1 and by[4][0].members == ["abc", "d"]
        assert (by[5][0].kind, by[6][0].kind, by[6][0].ts_ns, by[6][0].attributes["container.id"]) == ("gauge_delta", "gauge", 17_000_000_000, "sxyz")
        assert by[11][0].attributes == {"urgent": 'a[true,"1"]'}

    def test_statsd_rules(self, spark):
        lines = ["a:1|c|@0.5|#x:y,bare", "a:1:2|g", "a:+1:-2|g", "t:1:2.5|ms|@0.1|#env:p,env:q", "s:u1:u2|s", "a:1|c|@0", "a:nan|g", "a:1e999|g", ":1|c", "a:1|q", "a:1|c|T5|c:box|e:ext|card:low", "a:1|h|#a:1|#b:2", "a:x|g", "_e{1,1}:a|b", "d:1:inf|d", None, "a:1|c|#,k:v,"]
        r = text.statsd(spark.createDataFrame([(i, 9, x) for i, x in enumerate(lines)], "_seq bigint, ts_ns bigint, line string")).orderBy("_seq", "_pos").collect()
        assert [(x._seq, x.kind, x.value) for x in r if x.value is not None] == [(0, "sum", 2.0), (1, "gauge", 1.0), (1, "gauge", 2.0), (2, "gauge_delta", 1.0), (2, "gauge_delta", -2.0), (10, "sum", 1.0), (16, "sum", 1.0)]
        by = {x._seq: x for x in r}
        assert by[0].attributes == {"x": "sy", "bare": "btrue"} and by[3].samples == [1.0, 2.5] and by[3].sample_rate == 0.1 and by[3].attributes["deployment.environment.name"] == 'a["p","q"]'
        assert by[4].members == ["u1", "u2"] and by[10].ts_ns == 5_000_000_000 and by[10].attributes["container.id"] == "sbox" and by[10].attributes[PRIVATE + "metrics.closed"] == "stimestamped"
        assert by[11].attributes == {"a": "s1", "b": "s2", PRIVATE + "statsd.type": "sh"} and by[16].attributes == {"k": "sv"} and 13 not in by and 14 not in by

    def test_statsd_events(self, spark):
        lines = ["_e{2,4}:hi|a\\nb|t:warning|p:low|k:key|s:src|h:box|d:7|#x:y", "_e{3,2}:é!|ok", "_e{9,9}:a|b", "_e{1,1}:a|b|p:high", "_e{1,1}:a|b|t:odd", "_e{1,1}:a|bc", "_sc|up|1|m:bad|h:box|#q", "_sc|up|4", "_sc||1", "a:1|c"]
        r = {x._seq: x for x in text.statsd_logs(spark.createDataFrame([(i, 9, x) for i, x in enumerate(lines)], "_seq bigint, ts_ns bigint, line string")).collect()}
        assert set(r) == {0, 1, 6} and (r[0].message, r[0].severity, r[0].ts_ns) == ("a\nb", "warn", 7_000_000_000) and r[1].message == "ok"
        assert r[0].attributes == {"x": "sy", "host.name": "sbox", PRIVATE + "metrics.closed": "stimestamped", **{PRIVATE + "statsd.event." + k: "s" + v for k, v in (("title", "hi"), ("priority", "low"), ("alert_type", "warning"), ("aggregation_key", "key"), ("source_type", "src"))}}
        assert r[6].attributes == {"q": "btrue", "host.name": "sbox", PRIVATE + "statsd.service_check.name": "sup", PRIVATE + "statsd.service_check.status": "u1", PRIVATE + "statsd.service_check.message": "sbad"} and r[6].message is None

    def test_graphite_influx_prometheus(self, spark):
        g = text.graphite(self.lines(spark, "a.b;host=w;dc=x 0.25 1799999990.5", "a nan 5", "a 1", "a 2 -1")).collect()
        assert [(r.name, r.value, r.ts_ns) for r in g] == [("a.b", 0.25, 1_799_999_990_500_000_000), ("a", 2.0, 99)] and g[0].attributes == {"host": "sw", "dc": "sx"}
        i = text.influx(self.lines(spark, "cpu,host=web-01 user=12.5,sys=3i,note=\"x\" 7")).collect()
        assert {(r.name, r.value, r.ts_ns) for r in i} == {("cpu.user", 12.5, 7), ("cpu.sys", 3.0, 7)}
        p = text.prometheus(self.lines(spark, "# TYPE lat histogram", 'lat_bucket{le="0.1",z="a\\"b"} 1 # {slow="no"} 0.05', 'lat_bucket{le="1",z="a\\"b"} 3', 'lat_bucket{le="+Inf",z="a\\"b"} 4', 'lat_sum{z="a\\"b"} 2.5', 'lat_count{z="a\\"b"} 4', "up 1 5", "bad{ 1"))
        assert p.count() == 6 and p.where("name = 'up'").first().ts_ns == 5_000_000
        h = text.prometheus_histograms(p).first()
        assert [(b.bound, b["count"]) for b in h.buckets] == [(0.1, 1), (1.0, 2), (math.inf, 1)] and h["sum"] == 2.5 and h["count"] == 4 and h.attributes == {"z": 'sa"b'}

    def test_pages_cri_docker(self, spark):
        page = "Active connections: 3 \nserver accepts handled requests\n 10 9 20 \nReading: 0 Writing: 1 Waiting: 2 \n"
        n = text.nginx_status(spark.createDataFrame([(1, 5, page), (2, 5, "x")], "_seq bigint, ts_ns bigint, page string")).collect()
        assert len(n) == 7 and {r.name: r.value for r in n}["nginx.http.requests"] == 20.0
        a = text.apache_status(spark.createDataFrame([(1, 5, "Total Accesses: 7\nScoreboard: __W\nReqPerSec: .5")], "_seq bigint, ts_ns bigint, page string")).collect()
        assert {r.name: r.value for r in a} == {"apache.total_accesses": 7.0, "apache.reqpersec": 0.5}
        c = spark.createDataFrame([("f", i, x) for i, x in enumerate(["t stdout P ab", "t stderr F e", "t stdout F cd", "junk", "t stdout F z"])], "file string, _seq bigint, line string")
        assert sorted(r.message for r in text.cri(c, ["file"]).collect()) == ["abcd", "e", "z"]
        d = spark.createDataFrame([(i, x) for i, x in enumerate(['{"log":"ab","stream":"stdout","time":"2024-01-01T00:00:00.5Z"}', '{"log":"cd\\n","stream":"stdout","time":"2024-01-01T00:00:01Z","attrs":{"k":"v"}}', "no"])], "_seq bigint, line string")
        r = json_formats.docker_logs(d).collect()
        assert len(r) == 1 and r[0].message == "abcd" and r[0].ts_ns == 1_704_067_200_500_000_000

    def test_archive_round_trip(self, spark):
        m = [Row(**{f.name: v.get(f.name) for f in METRIC}) for v in (
            {"name": "s", "kind": "sum", "value": 3.0, "value_i64": 3, "value_type": "i", "temporality": "delta", "monotonic": True}, {"name": "g", "kind": "gauge", "value": math.inf, "value_type": "f", "unit": "ms"},
            {"name": "d", "kind": "samples", "samples": [1.0, 2.5], "sample_rate": 0.5}, {"name": "h", "kind": "histogram", "temporality": "cumulative", "buckets": [Row(bound=1.0, count=2), Row(bound=math.inf, count=1)], "sum": 2.0},
            {"name": "x", "kind": "exponential_histogram", "temporality": "cumulative", "exp": Row(scale=2, zero_count=1, zero_threshold=0.5, pos_offset=-3, positive=[1, 0, 2], neg_offset=0, negative=None), "count": 4},
            {"name": "q", "kind": "distribution", "bins": {5: 1.0, -3: 2.0, 0: 4.0}, "count": 7})]
        e = event(1, ts=1_700_000_000_123_456_789, attributes={"a": "i1", "b": "f1.5", "c": "u18446744073709551615", "d": "t1700000000000000001", "e": "n", "f/g~": "fNaN", "h": 'sx"y\n'}, message='m "q"', metrics=m, resource={"r": "sx"})
        df = events(spark, e)
        lines = json_formats.write_archive(df)
        assert json_formats.read_archive(lines).select("ts_ns", "attributes", "resource", "log", "metrics").collect() == df.select("ts_ns", "attributes", "resource", "log", "metrics").withColumn("metrics", F.transform("metrics", lambda x: x.withField("start_ns", x["start_ns"]))).collect()
        assert json_formats.read_archive(spark.createDataFrame([("x",), ("[]",), (None,)], "line string")).count() == 0

    def test_otlp_json(self, spark):
        m = spark.createDataFrame([(1, 5, 0, "m", "sum", 3.0, "i", "delta", True, None, {"a": "sx", "n": "i5"}, {"r": "btrue"}), (2, 6, 0, "g", "gauge", 1.5, "f", None, None, "ms", {}, {})], "_seq bigint, ts_ns bigint, start_ns bigint, name string, kind string, value double, value_type string, temporality string, monotonic boolean, unit string, attributes map<string,string>, resource map<string,string>")
        again = json_formats.otlp_metrics(json_formats.to_otlp_metrics(m)).orderBy("_seq").collect()
        assert [(r.name, r.kind, r.value, r.temporality, r.attributes, r.resource, r.ts_ns) for r in again] == [(r.name, r.kind, r.value, r.temporality, r.attributes, r.resource, r.ts_ns) for r in m.collect()]
        logs = '{"resourceLogs":[{"resource":{"attributes":[{"key":"s","value":{"stringValue":"w"}}]},"scopeLogs":[{"logRecords":[{"timeUnixNano":"5","severityNumber":17,"body":{"stringValue":"hi"},"traceId":"AB"}]}]}]}'
        r = json_formats.otlp_logs(spark.createDataFrame([(logs,), ("bad",)], "body string")).collect()
        assert len(r) == 1 and (r[0].message, r[0].severity, r[0].trace_id, r[0].resource) == ("hi", "error", "ab", {"s": "sw"})
        spans = '{"resourceSpans":[{"scopeSpans":[{"spans":[{"traceId":"aa","spanId":"bb","name":"n","kind":2,"startTimeUnixNano":"1","endTimeUnixNano":"3","status":{"code":2}}]}]}]}'
        s = json_formats.otlp_traces(spark.createDataFrame([(spans,)], "body string")).first()
        assert (s.kind, s.status, s.end_ns, s.parent_span_id) == ("server", "error", 3, None)

    def test_hec_and_series(self, spark):
        body = '{"time":1.5,"host":"h","event":"a } { b","fields":{"k":1}} {"time":"2","event":{"x":1}}\n{"event":"metric","fields":{"metric_name:cpu":5.5,"z":"q"}}'
        r = json_formats.hec(spark.createDataFrame([(body,), ('[{"event":"c"}]',)], "body string")).collect()
        assert [x.message for x in r] == ["a } { b", '{"x":1}', "metric", "c"] and r[0].ts_ns == 1_500_000_000 and r[0].attributes == {"k": "u1"} and r[2].metrics[0].value == 5.5
        m = spark.createDataFrame([(1, 5_000_000_000, "m", "sum", 3.0, {"team": "sa", "host.name": "sh", "bare": "btrue"})], "_seq bigint, ts_ns bigint, name string, kind string, value double, attributes map<string,string>")
        v2 = json_formats.series_v2(json_formats.to_series_v2(m)).first()
        assert (v2.name, v2.kind, v2.value, v2.ts_ns, v2.attributes) == ("m", "sum", 3.0, 5_000_000_000, {"team": "sa", "host.name": "sh", "bare": "btrue"})
        v1 = json_formats.series_v1(spark.createDataFrame([('{"series":[{"metric":"m","points":[[5,1.5],[6,2]],"type":"count","host":"h","tags":["a:b"]}]}',)], "body string")).collect()
        assert [(x.value, x.kind) for x in v1] == [(1.5, "sum"), (2.0, "sum")] and v1[0].attributes == {"a": "sb", "host.name": "sh"}
        logs = json_formats.log_intake(spark.createDataFrame([('[{"message":"m","ddtags":"env:x,y","hostname":"h","status":"warning","custom":{"a":1}}]',)], "body string")).first()
        assert logs.severity == "warn" and logs.attributes == {"deployment.environment.name": "sx", "y": "btrue", "host.name": "sh", "custom": 'm{"a":1}'}
        back = json_formats.hec(json_formats.to_hec(events(spark, event(3, ts=1_500_000_000, attributes={"k": "i1", "host.name": "sh"}, message="m")))).first()
        assert (back.message, back.ts_ns, back.resource, back.attributes) == ("m", 1_500_000_000, {"host.name": "sh"}, {"k": "u1"})

    def test_binary(self, spark):
        bodies = lambda *b: spark.createDataFrame([(i, bytearray(x) if x is not None else None) for i, x in enumerate(b)], "_seq bigint, body binary")
        lists = [{"host": "h", "plugin": "load", "type": "load", "ts_ns": 5_000_000_000, "values": [(1, 0.5), (1, math.nan)]}, {"host": "h", "plugin": "if", "type": "octets", "type_instance": "rx", "ts_ns": 6_000_000_000, "values": [(0, 2**63 + 5), (2, -7), (3, 4)]}]
        data = binary.collectd_datagram(lists)
        rows = binary.read(bodies(data, data[:-3], None, b"\xff"), "collectd").collect()
        first = [r for r in rows if r._seq == 0]
        assert [(r.name, r.kind, r.value, r.flags) for r in first][:2] == [("load.load", "gauge", 0.5, 0), ("load.load", "gauge", 0.0, 1)]
        assert [(r.value_text, r.temporality, r.monotonic) for r in first][2:] == [(str(2**63 + 5), "cumulative", True), ("-7", "cumulative", False), ("4", "delta", True)] and first[2].ts_ns == 6_000_000_000
        assert len([r for r in rows if r._seq == 1]) == 2
        values = [None, True, 5, -3, 2**63 + 1, 1.5, "é", b"\x01", [1, [2]], {"a": {"b": 1}}]
        for v in values:
            assert binary.unpack(binary.pack(v))[0] == v
        assert binary.read(bodies(binary.pack({"a": 1, "b": "x"}) * 2, b"\xc1"), "msgpack").collect()[1].attributes == {"a": "i1", "b": "sx"}
        span = {"service": "s", "name": "n", "resource": "r", "trace_id": 5, "span_id": 6, "parent_id": 0, "start": 10, "duration": 5, "error": 1, "meta": {"k": "v"}, "metrics": {"m": 1.0}, "type": "web"}
        t = binary.read(bodies(binary.pack([[span]]), binary.pack([["s", "n"], [[[0, 1, 0, 7, 8, 6, 1, 2, 0, {}, {}, 0]]]])), "tracer").collect()
        assert (t[0].end_ns, t[0].parent_span_id, t[0].attributes) == (15, None, {"k": "sv", "m": "f1.0"}) and t[1].name == "n" and t[1].parent_span_id == f"{6:016x}"

    def test_protobuf(self, spark):
        def var(n):
            out = b""
            while True:
                out += bytes([n & 127 | (128 if n > 127 else 0)])
                n >>= 7
                if not n:
                    return out
        def f(n, v):
            return var(n << 3 | 2) + var(len(v)) + v if isinstance(v, bytes) else var(n << 3 | 1) + (struct.pack("<d", v) if isinstance(v, float) else struct.pack("<q", v))
        def i(n, v):
            return var(n << 3) + var(v)
        kv = f(1, b"k") + f(2, f(1, b"v"))
        point = f(7, kv) + f(3, 77) + f(4, 2.5)
        hist = f(3, 88) + f(4, 3) + f(5, 4.5) + f(6, struct.pack("<2Q", 1, 2)) + f(7, struct.pack("<d", 10.0))
        req = f(1, f(1, f(1, kv)) + f(2, f(2, f(1, b"m") + f(5, f(1, point))) + f(2, f(1, b"h") + f(9, f(1, hist) + i(2, 1)))))
        df = spark.createDataFrame([(bytearray(req),), (bytearray(req[:-5]),)], "body binary")
        rows = binary.read(df, "otlp_metrics").collect()
        assert (rows[0].name, rows[0].value, rows[0].ts_ns, rows[0].attributes, rows[0].resource) == ("m", 2.5, 77, {"k": "sv"}, {"k": "sv"})
        assert (rows[1].kind, rows[1].temporality, [(b.bound, b["count"]) for b in rows[1].buckets]) == ("histogram", "delta", [(10.0, 1), (math.inf, 2)])
        import pickle

        import pyarrow as pa

        series = f(1, f(1, f(1, b"__name__") + f(2, b"up")) + f(1, f(1, b"j") + f(2, b"x")) + f(2, f(1, 1.0) + i(2, 9)))
        got = binary.read(spark.createDataFrame([(bytearray(pa.Codec("snappy").compress(series, asbytes=True)),)], "body binary"), "remote_write").first()
        assert (got.name, got.value, got.ts_ns, got.attributes) == ("up", 1.0, 9_000_000, {"j": "sx"})
        p = pickle.dumps([("a.b;x=y", (5, 1.5)), ("c", (6, "2"))], 2)
        evil = pickle.dumps(print, 2)
        frames = [struct.pack(">I", len(x)) + x for x in (p, evil)]
        assert [(r.name, r.value) for r in binary.read(spark.createDataFrame([(bytearray(x),) for x in frames], "body binary"), "graphite_pickle").collect()] == [("a.b", 1.5), ("c", 2.0)]

    def test_io(self, spark, tmp_path):
        p = str(tmp_path / "x.log")
        open(p, "w").write("a 1 5\nb 2 6\n")
        m = io.DECODERS["graphite"](io.lines(spark, p))
        assert m.count() == 2
        io.write_files(m, str(tmp_path / "out"), by_day="ts_ns")
        assert spark.read.parquet(str(tmp_path / "out")).where("day = '1970-01-01'").count() == 2
        io.write_null(m)
        assert io.generate(spark, 5, 10, 100, k=reshape.template("h{seq%2}", seq=F.col("seq"))).where("k = 'h1'").count() == 2
        assert "m = 1" in io.human(events(spark, event(message="hey", attributes={"m": "i1"}))).first().line
        assert "long = " + "x" * 5000 + "y" in io.human(events(spark, event(attributes={"long": "s" + "x" * 5000 + "y"}))).first().line
        sent = io.deliver(io.ENCODERS["graphite"](m.withColumn("attributes", F.create_map().cast("map<string,string>"))), lambda batch: None, 1)
        assert sent.agg(F.sum("sent")).first()[0] == 2


class TestGraph:
    GRAPH = """
parse: {type: json, sources: [in]}
tag: {type: set, sources: [parse], attributes: {env: "${ENV:-dev}"}}
split: {type: route, sources: [tag], by: attribute, key: a, routes: {"1": [ones, audit], "2": twos}}
out: {type: sink, sources: [ones, split]}
rest: {type: sink, sources: [twos, audit]}
"""

    def test_compile(self, spark):
        g = graph.load(self.GRAPH, {"ENV": "prod"})
        df = events(spark, *[event(i, message='{"a":"%d"}' % (i % 3), origin="x") for i in range(9)])
        frames = graph.compile_graph(g, {"in": df})
        assert {k: v.count() for k, v in graph.sinks(g, frames).items()} == {"out": 6, "rest": 6}
        r = frames["out"].first()
        assert r.attributes["env"] == "sprod" and r._previous == "out" and r._origin == "x"
        hand = reshape.set_(parsers.json(df), {"env": "prod"})
        assert sorted(map(str, attributes(hand))) == sorted(map(str, attributes(frames["tag"])))
        assert '"tag" -> "split"' in graph.dot(g)

    def test_faults(self):
        with pytest.raises(graph.GraphError) as e:
            graph.validate({"a": {"type": "nope", "sources": ["b"]}, "c": {"type": "keep", "sources": []}, "s": {"type": "sample", "rate": 2, "sources": ["a"]}}, ["in"])
        assert len(e.value.problems) == 4
        with pytest.raises(graph.GraphError, match="cycle"):
            graph.validate({"a": {"type": "keep", "sources": ["b"]}, "b": {"type": "keep", "sources": ["a"]}}, ["in"])
        with pytest.raises(graph.GraphError, match="isn't set"):
            graph.load("${NOPE_X}", {})

    def test_user_function(self, spark):
        def double(e):
            if e["_seq"] == 2:
                raise ValueError
            return None if e["_seq"] == 1 else [dict(e, ts_ns=1), dict(e, ts_ns=2)]
        df = events(spark, *[event(i, attributes={"a": "sx"}, message="m") for i in range(4)])
        frames = graph.compile_graph({"f": {"type": "fn", "sources": ["in"]}, "o": {"type": "sink", "sources": ["f"]}}, {"in": df}, {"fn": lambda d: script.process(d, double)})
        got = frames["o"].collect()
        assert sorted((r._seq, r.ts_ns) for r in got) == [(0, 1), (0, 2), (3, 1), (3, 2)] and got[0].attributes == {"a": "sx"}
        assert script.process(df, double, on_error="keep").count() == 5
        sums = script.flush(df, ["_batch"], lambda k, p: p.groupby("_batch", as_index=False).agg(n=("_seq", "count"))[["_batch", "n"]], "_batch bigint, n bigint")
        assert sums.first().n == 4
        assert script.reduce_by(df, ["_batch"], n=F.count("*")).first().n == 4

    def test_event_helpers(self, spark, tmp_path):
        e = script.Event.new(5, "m", "info", a=1, b="x", c=[1, {"d": None}], f=1.5, t=True, n=None, y=b"\x01", u=2**63)
        assert e["attributes"] == {"a": "i1", "b": "sx", "c": 'a[1,{"d":null}]', "f": "f1.5", "t": "btrue", "n": "n", "y": "x01", "u": f"u{2**63}"}
        assert e.to_table()["attributes"] == {"a": 1, "b": "x", "c": [1, {"d": None}], "f": 1.5, "t": True, "n": None, "y": b"\x01", "u": 2**63} and e.attribute("nope") is None
        copy = e.clone()
        copy.put("a", 2)
        assert e.attribute("a") == 1 and copy.attribute("a") == 2 and e.to("x")["_dest"] == "x" and "_dest" not in e
        p = tmp_path / "f.py"
        p.write_text("def process(e):\n    if e['_seq'] == 1:\n        raise ValueError\n    out = Event(e)\n    out.put('k', 7)\n    return out\n")
        errors = spark.sparkContext.accumulator(0)
        df = script.process(events(spark, event(1), event(2)), script.load_function(str(p)), errors=errors)
        assert [r.attributes for r in df.collect()] == [{"k": "i7"}] and errors.value == 1
        with pytest.raises(ValueError, match="no function"):
            script.load_function(str(p), "other")

    def test_observed_and_routed_signals(self, spark):
        g = {"s": {"type": "route_signals", "sources": ["in"], "signals": {"logs": "l", "metrics": "m"}}, "a": {"type": "sink", "sources": ["l"]}, "b": {"type": "sink", "sources": ["m"]}}
        seen = {}
        frames = graph.compile_graph(g, {"in": events(spark, event(1, message="x"), event(2))}, observed=seen)
        assert "s" not in frames and len(frames["a"].collect()) == 1 and seen["a"].get == {"events": 1}
        with pytest.raises(graph.GraphError, match="targets only"):
            graph.validate(g | {"c": {"type": "sink", "sources": ["s"]}}, ["in"])

    def test_shape(self, spark):
        m = shape.measure(events(spark, event(1, attributes={"a": "s1", "b": 'm{"x":1}'}, message="héy"), event(2)))
        r = m.orderBy("attributes").collect()
        assert (r[1].attributes, r[1].nested, r[1].types["m"], r[1].body_bytes, r[1].value_bytes, r[0].key_set) == (2, 1, 1, 4, 8, [])


class TestStreams:
    def source(self, spark, tmp_path, parts, schema):
        for i, rows in enumerate(parts):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"{i}"))
        return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))

    def until(self, q, done):
        """Timeouts keep such a query busy for ever, so it is watched and stopped."""
        end = time.time() + 90
        while time.time() < end and not done():
            time.sleep(0.5)
        q.stop()

    def test_windows_per_batch(self, spark, tmp_path):
        def metric(v):
            return Row(**{f.name: {"name": "m", "kind": "sum", "value": v, "temporality": "delta"}.get(f.name) for f in METRIC})
        parts = [[event(1, metrics=[metric(1.0)]), event(2, metrics=[metric(2.0)])], [event(3, metrics=[metric(5.0)])]]
        stream = aggregate.explode_metrics(self.source(spark, tmp_path, parts, EVENT))
        got = {}
        q = windows.aggregate_stream(stream, lambda d, i: got.__setitem__(i, [r.value for r in d.collect()]), str(tmp_path / "cp"), once=True, kinds={"sum"})
        q.awaitTermination(120)
        assert sorted(got.values()) == [[3.0], [5.0]]

    def test_state(self, spark, tmp_path):
        parts = [[("a", 1, 10.0), ("a", 2, 15.0)], [("a", 2, 15.0), ("a", 3, 4.0), ("b", 9, 1.0)]]
        stream = self.source(spark, tmp_path, parts, "s string, ts_ns bigint, value double")
        q = windows.deltas(stream, ["s"]).writeStream.format("memory").queryName("deltas").option("checkpointLocation", str(tmp_path / "cp")).start()
        self.until(q, lambda: spark.table("deltas").count() >= 5)
        rows = {(r.s, r.ts_ns, r.rule, r.delta) for r in spark.table("deltas").collect()}
        assert ("a", 1, "first", None) in rows and ("a", 2, "difference", 5.0) in rows and ("a", 2, "duplicate", None) in rows and ("a", 3, "reset", 4.0) in rows and ("b", 9, "first", None) in rows
        q = windows.running_totals(stream, ["s"]).writeStream.outputMode("update").format("memory").queryName("totals").option("checkpointLocation", str(tmp_path / "cp2")).start()
        self.until(q, lambda: spark.table("totals").count() >= 3)
        assert max(r.total for r in spark.table("totals").collect() if r.s == "a") == 44.0

    def test_late_counters(self, spark, tmp_path):
        schema = "log_id bigint, event_timestamp bigint, observed_timestamp bigint, received_at timestamp, service_name string, host_name string"
        from datetime import datetime

        t = datetime(2024, 1, 1)
        parts = [[(1, 50, 500, t, "a", "h"), (2, 50, 10, t, "a", "h")], [(1, 50, 400, t, "a", "h"), (1, 50, 900, t, "a", "h")]]
        stream = self.source(spark, tmp_path, parts, schema)
        q = windows.late_counters(stream, str(tmp_path / "dots"), str(tmp_path / "cp"), ["service_name"], key="log_id", event="event_timestamp", observed="observed_timestamp", received="received_at", source="host_name")
        q.awaitTermination(120)
        d = windows.latest_dots(spark.read.parquet(str(tmp_path / "dots")), "log_id", ["service_name"])
        assert {r.log_id: r.arrival for r in d.collect()} == {1: 400, 2: 10}

    def test_settled_counters(self, spark, tmp_path):
        """Closing on the way: a record that was counted doesn't count again, a new one beyond the cut-off does."""
        from datetime import datetime

        from strandline.operators import late_events

        schema, hour, t = "log_id bigint, event_timestamp bigint, observed_timestamp bigint, received_at timestamp, service_name string, host_name string", 3_600_000_000_000, datetime(2024, 1, 1)
        row = lambda k, e, o: (k, e, o, t, "a", "h")
        first, later = [row(1, 5, 9), row(2, 5, 2 * hour), row(3, 29 * hour, 29 * hour)], [row(1, 5, 40 * hour), row(4, 5, 40 * hour), row(3, 29 * hour, 30 * hour), row(5, 29 * hour, 31 * hour)]
        options = dict(key="log_id", event="event_timestamp", observed="observed_timestamp", received="received_at", source="host_name")
        (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
        windows.late_counters(self.source(spark, tmp_path / "a", [first], schema), str(tmp_path / "dots"), str(tmp_path / "c1"), ["service_name"], **options).awaitTermination(120)
        out = str(tmp_path / "out")
        windows.settle(spark.read.parquet(str(tmp_path / "dots")).drop("part"), out, "log_id", ["service_name"], 30 * hour)
        windows.late_counters(self.source(spark, tmp_path / "b", [later], schema), out + "/dots", str(tmp_path / "c2"), ["service_name"], counted=out + "/counted", **options).awaitTermination(120)
        d = late_events.with_outcome(windows.latest_dots(spark.read.parquet(out + "/dots").drop("part"), "log_id", ["service_name"]))
        open_ = late_events.totals(late_events.versions(d, ["service_name"]), ["service_name"])
        got = late_events.add_totals([spark.read.parquet(out + "/totals"), open_], ["service_name"])
        assert {(r.period_end // hour, r.n, r.dropped) for r in got.collect()} == {(1, 2, 1), (30, 2, 0)}

    def test_event_time(self, spark):
        from datetime import datetime

        df = spark.createDataFrame([(datetime(2024, 1, 1, 0, m), "a") for m in (1, 2, 11)], "ts timestamp, k string")
        assert sorted(r.n for r in windows.event_time(df, "ts", "10 minutes", ["k"], "1 hour", n=F.count("*")).collect()) == [1, 2]
