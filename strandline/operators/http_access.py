"""Access-log lines brought to one set of attributes.

Fill-only except for ``forwarded``: what the producer states stays. Only events with a
log and attributes are touched. All values come from closed tables, so everything is
built-in expressions: the names that matter become columns, each group of steps is one
projection over them, and the map is built once at the end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import values as V

# Names, limits, patterns and keys of the attribute conventions.
INTEGERS = ["http.request.body.size", "http.response.body.size", "http.request.size", "http.response.size", "server.port", "client.port", "network.peer.port", "network.connection.id", "network.connection.requests"]
DURATIONS = ["http.request.duration", "upstream.duration", "upstream.connect", "upstream.header"]
SPAN_DURATION = ["span.duration", "span.duration_us", "span.duration_ms", "span.duration_s"]
SPAN_START = ["span.start", "span.start_us", "span.start_ms", "span.start_s", "span.start_rfc3339"]
SPAN_END = ["span.end", "span.end_us", "span.end_ms", "span.end_s", "span.end_rfc3339"]
METHODS = ["CONNECT", "DELETE", "GET", "HEAD", "OPTIONS", "PATCH", "POST", "PUT", "QUERY", "TRACE"]
SENSITIVE = ["AWSAccessKeyId", "Signature", "sig", "X-Goog-Signature", "X-Amz-Signature", "X-Amz-Credential", "X-Amz-Security-Token"]
AGENTS = [
    ("scanner", r"(?i)nmap|masscan|zgrab|nikto|sqlmap|dirbuster|gobuster|ffuf|fuzz faster u fool|feroxbuster|wpscan|nuclei|acunetix|nessus|qualys|openvas|censysinspect|internetmeasurement|expanse|paloaltonetworks|leakix|shodan"),
    ("tool", r"(?i)curl/|wget/|libwww-perl|python-requests|python-urllib|aiohttp|httpie|go-http-client|okhttp|apache-httpclient|^java/|axios/|node-fetch|guzzlehttp|postmanruntime|insomnia|reqwest/|k6/|wrk/|jmeter|kube-probe|prometheus/|blackbox-exporter|elb-healthchecker|googlehc|telegraf/|vector/|chrome-lighthouse|uptimerobot"),
    ("crawler", r"(?i)\bbot\b|bot/|spider|crawler|slurp|scrapy|googlebot|bingbot|yandex|baiduspider|duckduckbot|facebookexternalhit|twitterbot|linkedinbot|slackbot|applebot|petalbot|semrushbot|ahrefsbot|mj12bot|ccbot|gptbot|chatgpt-user|claudebot|perplexitybot|amazonbot|bytespider|feedfetcher"),
    ("browser", r"(?i)mozilla/|opera/|dalvik/|safari/|msie |trident/"),
]
ROUTES = {
    "probes": (r"^/(-/(healthy|ready)|health|healthz|healthcheck|livez|readyz|ready|ping|status|_status|up|metrics|_metrics|stats|nginx_status|server-status|haproxy_status|version|_version)/?$", "/{probe}"),
    "well_known": (r"^/(\.well-known/.*|robots\.txt|favicon\.ico|sitemap[^/]*\.xml(\.gz)?|humans\.txt|security\.txt|apple-touch-icon[^/]*\.png|browserconfig\.xml|manifest\.json|manifest\.webmanifest|crossdomain\.xml|ads\.txt|app-ads\.txt)$", "/{well-known}"),
    "assets": (r"(?i)\.(css|js|mjs|cjs|map|png|jpe?g|gif|webp|avif|svg|ico|bmp|tiff?|woff2?|ttf|otf|eot|heic|heif|docx|xlsx|pptx|apk|ipa|mp4|m4v|webm|mov|mp3|m4a|ogg|oga|opus|wav|flac|pdf|zip|gz|tgz|bz2|xz|7z|rar|wasm)$", "/{asset}"),
}
LIMITS = {
    "url.path": 256, "url.query": 256, "user_agent.original": 256, "http.request.header.referer": 256, "http.request.header.forwarded": 256, "server.address": 253,
    "network.peer.address": 128, "client.address": 128, "upstream.address": 128, "user.name": 128, "http.request.header.x-forwarded-for": 128, "http.request.header.x-real-ip": 128,
    "http.request.method_original": 32, "cache.status": 32, "url.scheme": 16, "network.protocol.version": 8, "http.termination_state": 8,
}
OTHERS = ["http.request.line", "url.original", "http.request.method", "http.response.status_code", "http.response.status_class", "http.route", "error.type", "user_agent.class", "user_agent.synthetic.type", "upstream.status", "tls.resumption.ratio", "span.name", "span.status", "trace.id", "trace.flags", "span.id", "span.parent_id", "span.kind"]
NAMES = sorted({*INTEGERS, *OTHERS, *LIMITS, *SPAN_DURATION, *SPAN_START, *SPAN_END, *[d + u for d in DURATIONS for u in ("_s", "_ms", "_us", "")]})


def redacted(query: Column, keys: list[str]) -> Column:
    """Values of sensitive keys as REDACTED; empty ones stay."""
    names = "|".join(k.replace(".", r"\.") for k in keys)
    return F.regexp_replace(query, rf"(?i)(^|&)({names})=(?!REDACTED(?:&|$))[^&]+", "$1$2=REDACTED")


class _Fields:
    """Current values of the names a line may carry, as columns beside the rest of the map."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.new = df, {}
        dashed = {n.replace(".", "-"): n for n in NAMES if "." in n}
        a = F.col("attributes")
        touch = F.coalesce(F.col("log").isNotNull() & (F.size("attributes") > 0), F.lit(False))
        handled = [*NAMES, *dashed]
        self.column = {n: f"_h{i}" for i, n in enumerate(NAMES)}
        cols = {self.column[n]: F.coalesce(a[n], a[n.replace(".", "-")]) for n in NAMES}
        self.df = df.withColumns({"_touch": touch, **cols, "_rest": F.map_filter(a, lambda k, _: ~k.isin(handled))})

    def __getitem__(self, name: str) -> Column:
        return F.col(self.column[name])

    def __setitem__(self, name: str, value: Column) -> None:
        self.new[name] = value

    def fill(self, name: str, text: Column) -> None:
        """Set a text where nothing is stated and the text isn't null or empty."""
        self[name] = F.when(~V.present(self[name]) & (text != ""), V.s(text)).otherwise(self[name])

    def overwrite(self, name: str, value: Column) -> None:
        """Set unless the value is null."""
        self[name] = F.coalesce(value, self[name])

    def text(self, name: str) -> Column:
        return V.text(F.when(V.present(self[name]), self[name]))

    def step(self) -> None:
        """All values set so far take effect."""
        self.df = self.df.withColumns({self.column[n]: v.cast("string") for n, v in self.new.items()})
        self.new = {}

    def done(self, columns: list[str]) -> DataFrame:
        self.step()
        here = F.map_filter(F.create_map(*[x for n in NAMES for x in (F.lit(n), self[n])]), lambda _, v: v.isNotNull())
        made = F.when(F.col("_touch"), V.merge(F.col("_rest"), here)).otherwise(F.col("attributes"))
        return self.df.withColumn("attributes", made).select(columns)


def http_access(df: DataFrame, routes: list[str | tuple[str, str]] = (), route_other: str | None = None, user_agent_rules: list[tuple[str, str]] = (), redact_query: list[str] = (), forwarded: str | None = None, status_class: bool = False, limits: dict[str, int] | None = None) -> DataFrame:
    """The ten steps in order. ``routes`` are names of built-in sets or (pattern, route)."""
    c = _Fields(df)
    # request line and target
    line = r"^([^ ]+) ([^ ]+) ([^ ]+)$"
    rl = c.text("http.request.line")
    ok = F.coalesce(rl.rlike(line), F.lit(False))
    c.df = c.df.withColumn("_target", F.coalesce(F.when(ok, F.regexp_extract(rl, line, 2)), F.regexp_replace(c.text("url.original"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*", "")))
    target = F.col("_target")
    c.fill("url.path", F.substring_index(target, "?", 1))
    c.fill("url.query", F.when(F.contains(target, F.lit("?")), F.substr(target, F.instr(target, "?") + 1)))
    c.fill("http.request.method", F.when(ok, F.regexp_extract(rl, line, 1)))
    c.fill("network.protocol.version", F.when(ok, F.regexp_extract(rl, line, 3)))
    c["http.request.line"] = F.when(~ok, c["http.request.line"])
    c["url.original"] = F.lit(None)
    c.step()
    # numbers, durations in seconds, method, version, query, agent
    def integer(n: str) -> Column:
        v, t = c[n], V.text(c[n])
        x = t.try_cast("double")
        return F.when(V.kind(v) == "u", F.concat(F.lit("i"), t.try_cast("bigint").cast("string"))).when((V.kind(v) == "f") & (x == F.floor(x)) & (F.abs(x) < 9e18), F.concat(F.lit("i"), x.try_cast("bigint").cast("string"))).when(
            (V.kind(v) == "s") & t.rlike(r"^[+-]?\d{1,19}$"), F.concat(F.lit("i"), t.try_cast("bigint").cast("string")))
    for n in [*INTEGERS, "http.response.status_code"]:
        c.overwrite(n, integer(n))
    c.overwrite("upstream.status", F.when(~c.text("upstream.status").rlike("[,:]"), integer("upstream.status")))
    c.overwrite("tls.resumption.ratio", V.float_value(V.numeric(c["tls.resumption.ratio"])))
    for q in DURATIONS:
        forms = [(q + "_s", 1.0), (q + "_ms", 1e3), (q + "_us", 1e6), (q, 1e9)]
        good = lambda n, nanos: V.present(c[n]) & ~c.text(n).rlike("[,:]") & (V.text(c[n]).rlike(r"^-?\d+$") if nanos else F.lit(True))
        seconds = V.float_value(F.coalesce(*[F.when(good(n, div == 1e9), V.numeric(c[n]) / div) for n, div in forms]))
        c.overwrite(q + "_s", seconds)
        for n, _ in forms[1:]:
            c[n] = F.when(seconds.isNull(), c[n])
    method = c.text("http.request.method")
    known = method.isin(METHODS)
    c.fill("http.request.method_original", F.when(~known & (method != "_OTHER"), method))
    c.overwrite("http.request.method", F.when(~known, F.lit("s_OTHER")))
    ver = F.regexp_replace(c.text("network.protocol.version"), "^HTTP/", "")
    c.overwrite("network.protocol.version", V.s(F.when(ver == "2.0", "2").when(ver == "3.0", "3").otherwise(ver)))
    c.overwrite("url.query", V.s(redacted(c.text("url.query"), [*SENSITIVE, *redact_query])))
    ua = c["user_agent.original"]
    cls = F.lit("other")
    for name, pattern in reversed([*[(k, p) for p, k in user_agent_rules], *AGENTS]):
        cls = F.when(V.text(ua).rlike(pattern), name).otherwise(cls)
    cls = F.when(ua.isNull(), None).when(~V.present(ua), "none").otherwise(cls)
    c.df = c.df.withColumn("_class", cls)
    c.fill("user_agent.class", F.col("_class"))
    c.fill("user_agent.synthetic.type", F.when(F.col("_class") == "crawler", "bot"))
    c.step()
    if forwarded:
        host, port = forwarded_client(c.text(f"http.request.header.{forwarded}"))
        c.overwrite("client.address", host)
        c.overwrite("client.port", port)
        c.step()
    for n, most in (LIMITS | (limits or {})).items():
        if n in c.column:
            c[n] = F.when(V.kind(c[n]) == "s", V.s(V.clean(V.text(c[n]), most))).otherwise(c[n])
    c.step()
    path = c.text("url.path")
    to = F.lit(route_other)
    for pattern, name in reversed([ROUTES[r] if isinstance(r, str) else r for r in routes]):
        to = F.when(path.rlike(pattern), name).otherwise(to)
    c.fill("http.route", F.when(path.isNotNull(), to).cast("string"))
    c.step()
    # derived
    code = F.when(V.kind(c["http.response.status_code"]) == "i", V.text(c["http.response.status_code"]).try_cast("bigint"))
    bad = code.between(500, 599)
    c.fill("error.type", F.when(bad, code.cast("string")))
    c.fill("span.status", F.when(code.isNotNull(), F.when(bad | (code == 0), "error").otherwise("unset")))
    shown = F.when(c.text("http.request.method") == "_OTHER", "HTTP").otherwise(c.text("http.request.method"))
    c.fill("span.name", F.when(shown.isNotNull(), F.concat_ws(" ", shown, c.text("http.route"))))
    if status_class:
        c.fill("http.response.status_class", F.when(code.isNotNull(), F.when(code.between(100, 599), F.concat(F.floor(code / 100).cast("string"), F.lit("xx"))).otherwise("unknown")))
    def stated(names: list[str]) -> Column:
        hit = F.lit(False)
        for n in names:
            hit = hit | V.present(c[n])
        return hit
    timed = stated(SPAN_DURATION) | (stated(SPAN_START) & stated(SPAN_END))
    seconds = c["http.request.duration_s"]
    c["span.duration_s"] = F.when((V.kind(seconds) == "f") & ~timed, seconds).otherwise(c["span.duration_s"])
    return c.done(df.columns)


def forwarded_client(h: Column) -> tuple[Column, Column]:
    """Client address and port, as values, from the first hop of a forwarding header."""
    hop = F.btrim(F.substring_index(h, ",", 1))
    hop = F.when(hop.rlike(r"(?i)(?:^|;)\s*for="), F.btrim(F.regexp_extract(hop, r"(?i)(?:^|;)\s*for=(\"[^\"]*\"|[^;,\s]+)", 1), F.lit('"'))).otherwise(hop)
    host = F.when(hop.startswith("["), F.regexp_extract(hop, r"^\[([^\]]+)\]", 1)).when(hop.rlike(r"^[^:]+:\d+$"), F.substring_index(hop, ":", 1)).otherwise(hop)
    port = F.regexp_extract(hop, r"(?:^[^:\[]+|\]):(\d{1,5})$", 1)
    good = host.rlike(r"^(\d{1,3}(\.\d{1,3}){3}|[0-9a-fA-F:]+:[0-9a-fA-F:.]*)$")
    return F.when(good, V.s(host)), F.when(good & (port != ""), F.concat(F.lit("i"), port))
