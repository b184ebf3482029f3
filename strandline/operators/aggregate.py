"""Windowed aggregation of metrics.

Input is the metric table (``explode_metrics``): one row per metric with its event's
time, attributes, resource, scope and arrival number. A series is (resource, scope,
name, unit, attributes), compared by typed value; ``_series`` holds it in canonical
order, and everything is grouped and joined by it. Per window and series the metrics of
one kind merge; every other metric passes through with the reason, so that metrics in =
absorbed + passed through.

The plan is one partial aggregation per (window, series, kind, bucket bounds) over
fixed-width buffers, which combines map-side, so hot series cost no more than others;
which kind owns a series is decided among these few partial rows, and records that lose
are found by joining the losers back. Windows are aligned to the epoch. Nulls: a null
attribute map is empty; a null value is not finite and passes through.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import sketch
from strandline.functions import values as V
from strandline.schema import CLOSED, FIELD, LOG, METRIC, NO_RECORDED_VALUE, OVERFLOW, PRIVATE, SPAN

SERIES = ["resource", "scope", "name", "unit", "attributes"]
#: kinds that share a series
FAMILY = {"sum": "sum", "gauge": "gauge", "gauge_delta": "gauge", "samples": "distribution", "distribution": "distribution", "set_members": "set", "set": "set", "histogram": "histogram"}
EMPTY = "map<string,string>"
LINKS = 8


def explode_metrics(events: DataFrame, links: bool = False) -> DataFrame:
    """The metric table of events; string fields don't belong to a series.

    ``links`` adds the trace context of the event's span, else of its log.
    """
    more = []
    if links:
        trace = F.coalesce(F.col("span.trace_id"), F.col("log.trace_id"))
        more = [F.when(trace.isNotNull(), F.struct(trace.alias("trace_id"), F.coalesce(F.col("span.span_id"), F.col("log.span_id")).alias("span_id"))).alias("link")]
    d = events.select("ts_ns", "_seq", *[c for c in ("_batch",) if c in events.columns], "attributes", "resource", "scope", *more, F.posexplode_outer("metrics").alias("_pos", "m")).where("m is not null")  # outer: no size filter that computes the array twice
    own = F.coalesce("attributes", F.create_map().cast(EMPTY))
    d = d.withColumn("attributes", F.when(F.array_join(F.map_keys(own), " ").contains(FIELD), F.map_filter(own, lambda k, _: ~k.startswith(FIELD))).otherwise(own))
    rest = [c for c in d.columns if c != "m"]
    return d.select(*rest, "m.*")


def family(kind: Column) -> Column:
    m = F.create_map(*[F.lit(x) for kv in FAMILY.items() for x in kv])
    return F.coalesce(m[kind], kind)


def fate(temporality: str = "delta") -> Column:
    """Reason for which a metric passes through before any merging, or null."""
    merges = F.col("kind").isin("gauge", "gauge_delta", "samples", "distribution", "set_members", "set") | ((F.col("kind") == "sum") & (F.coalesce("temporality", F.lit("delta")) == "delta"))
    if temporality == "cumulative":
        merges = merges | ((F.col("kind") == "histogram") & (F.coalesce("temporality", F.lit("delta")) == "delta"))
    scalar = F.col("kind").isin("sum", "gauge", "gauge_delta")
    return (
        F.when(F.col("attributes")[CLOSED].isNotNull(), V.text(F.col("attributes")[CLOSED]))
        .when(F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(NO_RECORDED_VALUE)) == 1, "no_recorded_value")
        .when(~merges, "no_merge_rule")
        .when(scalar & V.finite(F.col("value")).isNull(), "non_finite")
    )


def overflow_key(attributes: Column) -> Column:
    """Attributes of the series that takes what lies beyond a metric's cap."""
    kept = F.map_filter(attributes, lambda k, _: k.startswith(PRIVATE) | (k == "host.name"))
    return V.merge(kept, F.create_map(F.lit(OVERFLOW), F.lit("btrue")))


def with_series(m: DataFrame) -> DataFrame:
    """m with ``_series``: name, unit and the maps as entries in key order; null and empty maps are one."""
    def entries(c: str) -> Column:
        return F.sort_array(F.map_entries(F.coalesce(c, F.create_map().cast(EMPTY)))).alias(c)
    return m.withColumn("_series", F.struct("name", "unit", entries("attributes"), entries("resource"), entries("scope")))


def series_columns() -> list[Column]:
    """The parts of ``_series`` as columns, and its text ``series_key``."""
    maps = [F.map_from_entries(f"_series.{c}").alias(c) for c in ("resource", "scope")]
    return [F.to_json("_series").alias("series_key"), *maps, F.col("_series.name").alias("name"), F.col("_series.unit").alias("unit"), F.map_from_entries("_series.attributes").alias("attributes")]


def beyond(keys: list[str], order: list[str], most: int, spread: list[str], salts: int = 32) -> tuple[Column, Callable[[Column], Column]]:
    """Two columns to add in turn, ``r1`` and then the flag of rows after the first ``most`` of their group.

    Rows are ranked within salted parts first and only each part's first ``most`` meet,
    so a task holds at most salts * most rows that count, whatever the group holds.
    """
    salt = F.pmod(F.xxhash64(*spread), F.lit(salts))
    r1 = F.row_number().over(W.partitionBy(*keys, salt).orderBy(*order))

    def flag(r: Column) -> Column:
        meet = F.when(r <= most, F.lit(-1).cast("bigint")).otherwise(salt)
        return (r > most) | (F.row_number().over(W.partitionBy(*keys, meet).orderBy(*order)) > most)
    return r1, flag


def cap_series(m: DataFrame, interval_ns: int, per_metric: int | None = None, whole: int | None = None) -> DataFrame:
    """m with ``attributes`` folded beyond ``per_metric`` series a name, and ``_dropped`` beyond ``whole`` series a window.

    Series are admitted by first arrival. Only the distinct series of a window are
    ranked, not the records, and in parts (``beyond``).
    """
    d = with_series(m).withColumn("_window", F.expr(f"ts_ns - pmod(ts_ns, {interval_ns})"))
    first = d.groupBy("_window", "_series").agg(F.min("_seq").alias("_first")).withColumn("_old", F.col("_series"))
    if per_metric is not None:
        r1, flag = beyond(["_window", "_series.name"], ["_first", "_series"], per_metric, ["_series"])
        first = first.withColumn("_r1", r1).withColumn("_over", flag(F.col("_r1"))).drop("_r1")
        folded = F.sort_array(F.map_entries(overflow_key(F.map_from_entries("_old.attributes"))))
        first = first.withColumn("_series", F.when(F.col("_over"), F.col("_old").withField("attributes", folded)).otherwise(F.col("_old")))
    if whole is not None:
        opened = first.groupBy("_window", "_series").agg(F.min("_first").alias("_opened"))
        r1, flag = beyond(["_window"], ["_opened", "_series"], whole, ["_series"])
        opened = opened.withColumn("_r1", r1).withColumn("_dropped", flag(F.col("_r1"))).drop("_r1", "_opened")
        first = first.join(opened, ["_window", "_series"])
    else:
        first = first.withColumn("_dropped", F.lit(False))
    to = first.select("_window", F.col("_old").alias("_series"), F.map_from_entries("_series.attributes").alias("_key"), "_dropped")
    return d.join(to, ["_window", "_series"]).withColumn("attributes", F.col("_key")).drop("_key", "_window", "_series")


ALL_KINDS = frozenset({*FAMILY, "links"})


def aggregate(m: DataFrame, interval_ns: int, temporality: str = "delta", distributions: str = "sketch", sets: str = "members", cap: int = 1000, kinds: set[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(aggregates, passed through with ``reason``).

    Aggregates have window_ns, emitted_ns (the window's end), the series, kind and, by
    kind: value, value_i64 and value_type (sum, gauge), monotonic, bins with d_count,
    d_sum, d_min, d_max (distribution), set_count, members up to ``cap`` and beyond it
    set_sketch (set), buckets with h_sum, h_min, h_max (histogram), links (at most 8
    trace contexts, if the table has ``link``), description, start_ns.

    distributions: ``sketch``, or ``samples``, which keeps raw values, in arrival order,
    of series with up to ``cap`` values of one rate and no ready sketch. sets: ``members``
    or ``estimate``. ``kinds`` names the kinds that the input holds, so that no branch is
    planned for the others; all by default.
    """
    kinds = set(kinds or ALL_KINDS)
    families = {FAMILY[k] for k in kinds if k in FAMILY}
    d = m.withColumns({"reason": fate(temporality), "window_ns": F.expr(f"ts_ns - pmod(ts_ns, {interval_ns})"), "family": family(F.col("kind"))})
    keys = ["window_ns", "_series", "family"]
    if "histogram" in kinds:
        bounds = F.when(F.col("kind") == "histogram", F.transform("buckets", lambda b: b["bound"]))
        d = d.withColumn("bounds", F.coalesce(bounds, F.array().cast("array<double>")))
        keys.append("bounds")
    d = with_series(d)
    ok = d.where("reason is null")
    is_int = F.col("value_type").isin("i", "b") & F.col("value_i64").isNotNull()
    # (time, arrival) as one number, so that the aggregation's buffers stay fixed-width
    two_63 = F.lit(str(2**63)).cast("decimal(19,0)")
    at = F.when(F.col("kind") == "gauge", F.col("ts_ns").cast("decimal(19,0)") * two_63 + F.coalesce("_seq", F.lit(0)))
    partial = ok.groupBy(*keys).agg(
        F.min("_seq").alias("first_seq"), F.count("*").alias("absorbed"), F.min("ts_ns").alias("min_ts"), F.min_by("monotonic", "_seq").alias("monotonic"), F.min_by("description", "_seq").alias("description"),
        F.sum("value").alias("f_sum"), F.try_sum("value_i64").alias("i_sum"), F.bool_and(F.coalesce(is_int, F.lit(False))).alias("all_int"),
        F.max_by("value", at).alias("g_value"), F.max(at).alias("g_at"), F.bool_or(F.col("kind") == "gauge_delta").alias("has_delta"),
    )
    passed = d.where("reason is not null").drop("window_ns", "family", "bounds", "_series")
    if len(families) > 1 or "histogram" in kinds:
        # the kind, and the bounds, that arrived first own the series
        own = F.row_number().over(W.partitionBy("window_ns", "_series").orderBy("first_seq", "family", *keys[3:]))
        ranked = partial.withColumn("_own", own == 1)
        won = ranked.where("_own").drop("_own")
        losers = ok.join(ranked.where("not _own").select(*keys), keys, "left_semi").select(passed.columns)
        passed = passed.unionByName(losers.withColumn("reason", F.lit("kind_conflict")))
    else:
        won = partial
    out = won.withColumn("g_steps", F.lit(0.0))
    if "gauge_delta" in kinds:  # relative steps that arrived after the value that stands
        steps = ok.where("kind = 'gauge_delta'").select(*keys, "_seq", F.col("value").alias("_step"))
        after = steps.join(won.where("has_delta").select(*keys, (F.col("g_at") % two_63).alias("_at")), keys)
        after = after.where("_at is null or _seq > _at").groupBy(*keys).agg(F.sum("_step").alias("_steps"))
        out = out.join(after, keys, "left").withColumn("g_steps", F.coalesce("_steps", F.lit(0.0))).drop("_steps")
    if "distribution" in families:
        out = out.join(_distributions(ok, keys, kinds), keys, "left")
        if distributions == "samples":
            out = _raw_samples(out, ok, keys, cap)
    if "set" in families:
        out = out.join(_sets(ok, keys, sets, cap), keys, "left")
    if "histogram" in kinds and temporality == "cumulative":
        out = out.join(_histograms(ok, keys), keys, "left")
    if "links" in kinds and "link" in m.columns:
        out = out.join(_links(ok, keys), keys, "left")
    whole = (F.col("family") == "sum") & F.col("all_int") & F.col("i_sum").isNotNull()
    value = F.when(whole, F.col("i_sum").cast("double")).when(F.col("family") == "sum", F.col("f_sum")).when(F.col("family") == "gauge", F.coalesce("g_value", F.lit(0.0)) + F.col("g_steps"))
    rest = [c for c in out.columns if c not in (*keys, "f_sum", "i_sum", "all_int", "g_value", "g_at", "g_steps", "has_delta", "min_ts")]
    return out.select(
        "window_ns", (F.col("window_ns") + interval_ns).alias("emitted_ns"), *series_columns(), F.col("family").alias("kind"), value.alias("value"), F.when(whole, F.col("i_sum")).alias("value_i64"),
        F.when(F.col("family") == "sum", F.when(whole, "i").otherwise("f")).alias("value_type"), F.greatest("min_ts", "window_ns").alias("start_ns"), *rest,
    ), passed


def _distributions(ok: DataFrame, keys: list[str], kinds: set[str]) -> DataFrame:
    """Bins of raw samples and of ready sketches, summed, and folded into one map."""
    parts = []
    if "samples" in kinds:
        raw = ok.where("kind = 'samples'").select(*keys, F.explode_outer("samples").alias("v"), sketch.weight(F.col("sample_rate")).alias("rw"))
        parts.append(sketch.bins(raw, keys, "v", F.col("rw")))
    if "distribution" in kinds:
        ready = ok.where("kind = 'distribution'").select(*keys, F.explode(F.map_entries("bins")).alias("e")).select(*keys, F.col("e.key").alias("key"), F.col("e.value").alias("w"))
        r = sketch.representative(F.col("key"))
        parts.append(ready.groupBy(*keys, "key").agg(F.sum("w").alias("w"), F.sum(r * F.col("w")).alias("sum"), F.min(r).alias("min"), F.max(r).alias("max")))
    b = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return b.groupBy(*keys).agg(
        sketch.bin_map(F.collect_list(F.struct("key", "w"))).alias("bins"), F.sum("w").alias("d_count"), F.sum("sum").alias("d_sum"), F.min("min").alias("d_min"), F.max("max").alias("d_max")
    )


def _raw_samples(out: DataFrame, ok: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """out with samples and sample_rate, and no bins, where a series has at most ``cap`` values of one rate."""
    few = ok.where("family = 'distribution'").groupBy(*keys).agg(F.sum(F.coalesce(F.size("samples"), F.lit(0))).alias("_n"), F.bool_or(F.col("kind") != "samples").alias("_ready"), F.min(F.coalesce("sample_rate", F.lit(1.0))).alias("_lo"), F.max(F.coalesce("sample_rate", F.lit(1.0))).alias("_hi"))
    few = few.where(f"not _ready and _lo = _hi and _n <= {cap}").select(*keys, F.col("_lo").alias("sample_rate"))
    lists = ok.where("kind = 'samples'").select(*keys, "_seq", "samples").join(few, keys).groupBy(*keys, "sample_rate").agg(F.sort_array(F.collect_list(F.struct("_seq", "samples"))).alias("_s"))
    lists = lists.select(*keys, "sample_rate", F.flatten(F.col("_s.samples")).alias("samples"))
    return out.join(lists, keys, "left").withColumn("bins", F.when(F.col("samples").isNull(), F.col("bins")))


def _sets(ok: DataFrame, keys: list[str], sets: str, cap: int) -> DataFrame:
    """set_count, members of sets up to the cap, and a mergeable sketch of others; ``estimate`` has the sketch only."""
    mem = ok.where("kind in ('set_members', 'set')").select(*keys, F.explode("members").alias("member"))
    if sets == "estimate":
        s = mem.groupBy(*keys).agg(F.expr("hll_sketch_agg(member)").alias("set_sketch"))
        return s.select(*keys, F.expr("hll_sketch_estimate(set_sketch)").alias("set_count"), F.lit(None).cast("array<string>").alias("members"), "set_sketch")
    each = mem.groupBy(*keys, "member").agg(F.lit(1).alias("_one"))
    sizes = each.groupBy(*keys).agg(F.count("*").alias("set_count"))
    lists = each.join(sizes.where(F.col("set_count") <= cap).select(*keys), keys).groupBy(*keys).agg(F.sort_array(F.collect_list("member")).alias("members"))
    large = each.join(sizes.where(F.col("set_count") > cap).select(*keys), keys).groupBy(*keys).agg(F.expr("hll_sketch_agg(member)").alias("set_sketch"))
    return sizes.join(lists, keys, "left").join(large, keys, "left")


def _histograms(ok: DataFrame, keys: list[str]) -> DataFrame:
    """Bucket-wise sums; the sum is lost once a part lacks it; extremes of non-empty parts."""
    h = ok.where("kind = 'histogram'").select(*keys, "sum", "min", "max", "count", F.posexplode("buckets").alias("i", "b"))
    filled = F.col("count") > 0
    per = h.groupBy(*keys, "i").agg(F.sum("b.count").alias("c"), F.max("b.bound").alias("bound"), F.when(F.bool_and(F.col("sum").isNotNull()), F.sum("sum")).alias("h_sum"), F.min(F.when(filled, F.col("min"))).alias("h_min"), F.max(F.when(filled, F.col("max"))).alias("h_max"))
    buckets = F.transform(F.sort_array(F.collect_list(F.struct("i", "bound", "c"))), lambda x: F.struct(x["bound"].alias("bound"), x["c"].alias("count")))
    return per.groupBy(*keys).agg(buckets.alias("buckets"), F.max("h_sum").alias("h_sum"), F.min("h_min").alias("h_min"), F.max("h_max").alias("h_max"))


def _links(ok: DataFrame, keys: list[str]) -> DataFrame:
    """The first ``LINKS`` distinct trace contexts of a series, in order of arrival; ranked in parts."""
    each = ok.where("link is not null").groupBy(*keys, "link").agg(F.min("_seq").alias("_first"))
    r1, flag = beyond(keys, ["_first", "link"], LINKS, ["link"])
    first = each.withColumn("_r1", r1).withColumn("_beyond", flag(F.col("_r1"))).where("not _beyond")
    return first.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_first", "link")))["link"].alias("links"))


def metric_rows(aggregates: DataFrame) -> DataFrame:
    """Aggregates as metric table rows, emitted at the end of their window."""
    a = {c: F.col(c) for c in aggregates.columns}
    null = F.lit(None)
    by = lambda c, *names: F.coalesce(*[a.get(n, null) for n in names]).cast(METRIC[c].dataType).alias(c)
    dist, hist = F.col("kind") == "distribution", F.col("kind") == "histogram"
    raw = a["samples"].isNotNull() if "samples" in a else F.lit(False)
    kind = F.when(dist & raw, "samples").when((F.col("kind") == "set") & a.get("members", null).isNotNull(), "set_members").otherwise(F.col("kind"))
    made = {
        "kind": kind.alias("kind"), "temporality": F.when(F.col("kind").isin("sum", "histogram"), "delta").alias("temporality"), "count": F.when(dist, a.get("d_count", null)).when(F.col("kind") == "set", a.get("set_count", null)).cast("bigint").alias("count"),
        "sum": F.when(dist, a.get("d_sum", null)).when(hist, a.get("h_sum", null)).cast("double").alias("sum"), "min": F.when(dist, a.get("d_min", null)).when(hist, a.get("h_min", null)).cast("double").alias("min"),
        "max": F.when(dist, a.get("d_max", null)).when(hist, a.get("h_max", null)).cast("double").alias("max"), "flags": F.lit(0).alias("flags"),
    }
    return aggregates.select(F.col("emitted_ns").alias("ts_ns"), F.col("first_seq").alias("_seq"), "attributes", "resource", "scope", F.lit(0).alias("_pos"), *[made.get(f.name, by(f.name, f.name)) for f in METRIC])


def metric_events(rows: DataFrame) -> DataFrame:
    """One event per row of a metric table."""
    none = {"log": F.lit(None).cast(LOG), "span": F.lit(None).cast(SPAN), "_origin": F.lit(None).cast("string"), "_previous": F.lit(None).cast("string"), "_batch": F.lit(0).cast("bigint")}
    return rows.select(
        "ts_ns", *[F.coalesce(c, F.create_map().cast(EMPTY)).alias(c) for c in ("attributes", "resource", "scope")], none["log"].alias("log"),
        F.array(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in METRIC])).alias("metrics"), none["span"].alias("span"), *[none[c].alias(c) for c in ("_origin", "_previous", "_batch")], "_seq",
    )


def aggregate_events(events: DataFrame, interval_ns: int, **options) -> DataFrame:  # noqa: ANN003
    """Events to events: aggregates, metrics passed through, and the log and span of every event that has one."""
    out, passed = aggregate(explode_metrics(events, links=True), interval_ns, **options)
    rest = events.where("log is not null or span is not null").withColumn("metrics", F.array().cast(events.schema["metrics"].dataType))
    made = metric_events(metric_rows(out)).unionByName(metric_events(passed))
    return made.unionByName(rest.select(*[c for c in rest.columns if c in made.columns]), allowMissingColumns=True)


def cumulate(aggregates: DataFrame, retention_windows: int | None = None, interval_ns: int | None = None) -> DataFrame:
    """Running totals of delta sums per series; a gap of more than ``retention_windows`` windows starts anew.

    start_ns is that of the run's first window; a window without data emits nothing.
    """
    w = W.partitionBy("series_key").orderBy("window_ns")
    d = aggregates.where("kind = 'sum'")
    if retention_windows is not None:
        gap = F.col("window_ns") - F.lag("window_ns").over(w) > (retention_windows + 1) * interval_ns
        d = d.withColumn("_run", F.sum(F.when(gap, 1).otherwise(0)).over(w))
    else:
        d = d.withColumn("_run", F.lit(0))
    run = W.partitionBy("series_key", "_run").orderBy("window_ns").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("value", F.sum("value").over(run)).withColumn("start_ns", F.min("start_ns").over(run)).drop("_run")


def cumulate_histograms(aggregates: DataFrame) -> DataFrame:
    """Running bucket counts of delta histograms per series; other bounds start anew, a lost sum stays lost."""
    w = W.partitionBy("series_key").orderBy("window_ns")
    d = aggregates.where("kind = 'histogram'").withColumn("_bounds", F.transform("buckets", lambda b: b["bound"]))
    d = d.withColumn("_new", F.when(F.col("_bounds") == F.lag("_bounds").over(w), 0).otherwise(1)).withColumn("_run", F.sum("_new").over(w))
    run = W.partitionBy("series_key", "_run").orderBy("window_ns").rowsBetween(W.unboundedPreceding, 0)
    whole = F.bool_and(F.col("h_sum").isNotNull()).over(run)
    d = d.withColumn("start_ns", F.min("start_ns").over(run)).withColumn("h_sum", F.when(whole, F.sum("h_sum").over(run))).withColumn("h_min", F.min("h_min").over(run)).withColumn("h_max", F.max("h_max").over(run))
    e = d.select("*", F.posexplode("buckets").alias("_i", "_b"))
    each = W.partitionBy("series_key", "_run", "_i").orderBy("window_ns").rowsBetween(W.unboundedPreceding, 0)
    e = e.withColumn("_c", F.sum("_b.count").over(each))
    sums = e.groupBy("series_key", "_run", "window_ns").agg(F.sort_array(F.collect_list(F.struct("_i", F.col("_b.bound").alias("bound"), F.col("_c").alias("count")))).alias("_l"))
    sums = sums.select("series_key", "_run", "window_ns", F.transform("_l", lambda x: F.struct(x["bound"].alias("bound"), x["count"].alias("count"))).alias("buckets"))
    return d.drop("buckets", "_bounds", "_new").join(sums, ["series_key", "_run", "window_ns"]).drop("_run")


def retain_gauges(aggregates: DataFrame, interval_ns: int, windows: int) -> DataFrame:
    """Gauges repeated for up to ``windows`` windows in which their series is silent, up to its next value."""
    w = W.partitionBy("series_key").orderBy("window_ns")
    d = aggregates.where("kind = 'gauge'").withColumn("_next", F.lead("window_ns").over(w))
    until = F.least(F.coalesce(F.col("_next") - interval_ns, F.col("window_ns") + windows * interval_ns), F.col("window_ns") + windows * interval_ns)
    return d.withColumn("_at", F.explode(F.sequence(F.col("window_ns"), until, F.lit(interval_ns).cast("bigint")))).withColumn("idle", ((F.col("_at") - F.col("window_ns")) / interval_ns).cast("int")).withColumn("window_ns", F.col("_at")).drop("_at", "_next")
