"""Queries of the engine's own operators over the driver's tables, each with its SQL.

Where an operator's rules depend on arrival order or ties, the input is given both:
arrival is a permutation of the row numbers and times are coarsened, in both languages.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import hashing, sketch
from strandline.functions import values as V
from strandline.functions.shared import micros
from strandline.functions.shared import read as shared_read
from strandline.operators import aggregate as A
from strandline.operators import delta, filters, http_access, parsers, reshape, route, shape
from strandline.operators.reshape import metric
from strandline.schema import ATTRIBUTES, LOG, METRIC, SPAN
from strandline.sources import text

read = partial(shared_read, spread=True)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
HOUR = 3_600_000_000_000
MINUTE = 60_000_000_000


def query(sql: str | None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f
    return add


def attrs(**values: Column) -> Column:
    """Attribute map without the null ones."""
    whole, some = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), F.lit(False)
    for v in values.values():
        some = some | v.isNull()
    return F.when(some, F.map_filter(whole, lambda _, v: v.isNotNull())).otherwise(whole)


def as_event(df: DataFrame, seq: Column, ts_ns: Column, attributes: Column | None = None, message: Column | None = None, severity: Column | None = None, metrics: list[Column] | None = None, resource: Column | None = None, extra: list[str] = ()) -> DataFrame:
    """Event columns from a table's columns."""
    none = F.create_map().cast(ATTRIBUTES)
    null = lambda t: F.lit(None).cast(t)
    log = F.struct(*[({"message": message, "severity": severity if severity is not None else F.lit("info"), "body_format": F.lit("raw"), "observed_ns": F.lit(0)}.get(f.name, F.lit(None))).cast(f.dataType).alias(f.name) for f in LOG]) if message is not None else null(LOG)
    ms = F.array(*metrics) if metrics else F.array().cast(f"array<{METRIC.simpleString()}>")
    return df.select(
        ts_ns.cast("bigint").alias("ts_ns"), (attributes if attributes is not None else none).alias("attributes"), (resource if resource is not None else none).alias("resource"), none.alias("scope"),
        log.alias("log"), ms.alias("metrics"), null(SPAN).alias("span"), null("string").alias("_origin"), null("string").alias("_previous"), F.lit(0).cast("bigint").alias("_batch"), seq.cast("bigint").alias("_seq"), *extra,
    )


def _ts(c: str = "ts") -> Column:
    return micros(c) * 1000


def events(spark: SparkSession, d: str, shuffled: bool = False, names: list[str] | None = None) -> DataFrame:
    """The events table: counters, a sample, a gauge and a set member per event (or those named), attributes event_type and user_id, props as log body."""
    e = read(spark, d, "events")
    seq = F.pmod(F.col("event_id") * 7919, F.lit(100003)) if shuffled else F.col("event_id")
    ts = _ts() - F.pmod(_ts(), F.lit(MINUTE)) if shuffled else _ts()
    cents = F.round(F.col("value") * 100).cast("bigint")
    metrics = {
        "app.events": dict(kind="sum", value=1.0, value_i64=1, value_type="i", temporality="delta", monotonic=True), "app.value": dict(kind="samples", samples=F.array("value"), sample_rate=1.0),
        "app.level": dict(kind="gauge", value=F.col("value"), value_type="f"), "app.users": dict(kind="set_members", members=F.array(F.col("user_id").cast("string"))),
        "app.cents": dict(kind="sum", value=cents.cast("double"), value_i64=cents, value_type="i", temporality="delta", monotonic=True),
    }
    return as_event(
        e, seq, ts, attrs(event_type=V.s(F.col("event_type")), user_id=V.tagged(F.col("user_id"), "i")), F.col("props"), F.when(F.col("event_type") == "error", "error").otherwise("info"),
        [metric(name=n, **m) for n, m in metrics.items() if names is None or n in names],
    )


SHUFFLED = "(select *, (event_id*7919)%100003 seq, time_bucket(interval '1 minute', ts) tm from events) e"


def _metric_table(spark: SparkSession, d: str, names: list[str], keep: list[str], shuffled: bool = False) -> DataFrame:
    return A.explode_metrics(reshape.keep(events(spark, d, shuffled, names), keep))


def _w(c: str = "window_ns") -> Column:
    return F.timestamp_seconds(F.expr(f"{c} div 1000000000")).cast("timestamp_ntz").alias("period")


def _a(k: str) -> Column:
    return V.text(F.col("attributes")[k]).alias(k)


# -- aggregate ---------------------------------------------------------------------------------


@query("select time_bucket(interval '1 hour', ts) period, event_type, cast(count(*) as double) n from events group by all")
def aggregate_sum_window(spark: SparkSession, d: str) -> DataFrame:
    """Counters per hour and series."""
    out, _ = A.aggregate(_metric_table(spark, d, ["app.events"], ["event_type"]), HOUR, kinds={"sum"})
    return out.select(_w(), _a("event_type"), F.col("value").alias("n"))


@query(f"select time_bucket(interval '1 hour', tm) period, cast(user_id as varchar) user_id, arg_max(value, (tm, seq)) level from {SHUFFLED} group by all")
def aggregate_gauge_lww(spark: SparkSession, d: str) -> DataFrame:
    """Gauges: the latest time wins, ties go to the later arrival."""
    out, _ = A.aggregate(_metric_table(spark, d, ["app.level"], ["user_id"], True), HOUR, kinds={"gauge"})
    return out.select(_w(), _a("user_id"), F.col("value").alias("level"))


@query(f"""with e as (select *, time_bucket(interval '1 hour', tm) period, seq % 3 = 0 is_set from {SHUFFLED}),
g as (select period, event_type, arg_max(value, (tm, seq)) v, arg_max(seq, (tm, seq)) a_seq from e where is_set group by all)
select e.period, e.event_type, round(coalesce(any_value(g.v), 0) + coalesce(sum(round(e.value)) filter (not e.is_set and (g.a_seq is null or e.seq > g.a_seq)), 0), 6) level
from e left join g using (period, event_type) group by all""")
def aggregate_gauge_delta(spark: SparkSession, d: str) -> DataFrame:
    """Relative gauge adjustments on top of the value that stands, in arrival order."""
    m = _metric_table(spark, d, ["app.level"], ["event_type"], True)
    step = F.col("_seq") % 3 != 0
    m = m.withColumn("kind", F.when(step, "gauge_delta").otherwise("gauge")).withColumn("value", F.when(step, F.round("value")).otherwise(F.col("value")))
    out, _ = A.aggregate(m, HOUR, kinds={"gauge", "gauge_delta"})
    return out.select(_w(), _a("event_type"), F.round("value", 6).alias("level"))


QS = [0.5, 0.9, 0.99]
_BINS = f"""b as (select time_bucket(interval '1 hour', ts) period, event_type, cast(round_even(ln(value)/{sketch.GAMMA_LN!r}, 0) as bigint) + {sketch.OFFSET} k, count(*) c from events group by all),
r as (select *, sum(c) over (partition by period, event_type order by k) cum, sum(c) over (partition by period, event_type) n from b)"""


@query(f"with {_BINS} select period, event_type, cast(any_value(n) as double) n, " + ", ".join(f"min(k) filter (cum > round_even({q}*(n-1), 0)) k_{str(q).replace('.', '_')}" for q in QS) + " from r group by period, event_type")
def aggregate_distribution_q(spark: SparkSession, d: str) -> DataFrame:
    """Bins of the quantiles of merged samples per hour and type."""
    out, _ = A.aggregate(_metric_table(spark, d, ["app.value"], ["event_type"]), HOUR, kinds={"samples"})
    ks = [f"k_{x:g}".replace(".", "_") for x in QS]
    return out.select(_w(), _a("event_type"), F.col("d_count").alias("n"), *[k.cast("bigint").alias(n) for n, k in zip(ks, sketch.map_quantiles(F.col("bins"), QS), strict=True)])


@query("select time_bucket(interval '1 hour', ts) period, event_type, count(*) n, round(sum(value), 6) total, min(value) low, max(value) high from events group by all")
def aggregate_distribution_stats(spark: SparkSession, d: str) -> DataFrame:
    """Exact count, sum and extremes kept beside the bins."""
    out, _ = A.aggregate(_metric_table(spark, d, ["app.value"], ["event_type"]), HOUR, kinds={"samples"})
    return out.select(_w(), _a("event_type"), F.col("d_count").cast("bigint").alias("n"), F.round("d_sum", 6).alias("total"), F.col("d_min").alias("low"), F.col("d_max").alias("high"))


@query("select time_bucket(interval '1 day', ts) period, event_type, count(distinct user_id) users from events group by all")
def aggregate_set_members(spark: SparkSession, d: str) -> DataFrame:
    """Distinct members per day, exact up to the cap."""
    out, _ = A.aggregate(_metric_table(spark, d, ["app.users"], ["event_type"]), 24 * HOUR, kinds={"set_members"})
    return out.select(_w(), _a("event_type"), F.col("set_count").alias("users"))


BOUNDS = [1000.0, 10000.0, 30000.0, 60000.0, float("inf")]


def _histograms(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    p = F.col("l_extendedprice")
    buckets = F.array(*[F.struct(F.lit(b).alias("bound"), ((p <= b) & (p > (BOUNDS[i - 1] if i else float("-inf")))).cast("bigint").alias("count")) for i, b in enumerate(BOUNDS)])
    m = metric(name="line.price", kind="histogram", temporality="delta", buckets=buckets, count=1, sum=p, min=p, max=p)
    return A.explode_metrics(as_event(li, F.col("l_orderkey") * 10 + F.col("l_linenumber"), _ts("l_shipdate"), attrs(flag=V.s(F.col("l_returnflag"))), metrics=[m]))


@query("""select time_bucket(interval '1 day', l_shipdate) period, l_returnflag flag, count(*) filter (l_extendedprice <= 1000) b0, count(*) filter (l_extendedprice > 1000 and l_extendedprice <= 10000) b1,
count(*) filter (l_extendedprice > 10000 and l_extendedprice <= 30000) b2, count(*) filter (l_extendedprice > 30000 and l_extendedprice <= 60000) b3, count(*) filter (l_extendedprice > 60000) b4,
round(sum(l_extendedprice), 2) total, min(l_extendedprice) low, max(l_extendedprice) high from lineitem group by all""")
def aggregate_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Explicit-bound histograms: bucket-wise sums, sum and extremes."""
    out, _ = A.aggregate(_histograms(spark, d), 24 * HOUR, temporality="cumulative", kinds={"histogram"})
    return out.select(_w(), _a("flag"), *[F.col("buckets")[i]["count"].alias(f"b{i}") for i in range(5)], F.round("h_sum", 2).alias("total"), F.col("h_min").alias("low"), F.col("h_max").alias("high"))


@query("""with h as (select time_bucket(interval '1 hour', ts) period, event_type, count(*) n from events group by all)
select period, event_type, cast(sum(n) over (partition by event_type order by period) as double) total from h""")
def aggregate_cumulative(spark: SparkSession, d: str) -> DataFrame:
    """Running totals of counters per series."""
    out, _ = A.aggregate(_metric_table(spark, d, ["app.events"], ["event_type"]), HOUR, "cumulative", kinds={"sum"})
    return A.cumulate(out).select(_w(), _a("event_type"), F.col("value").alias("total"))


@query("""with h as (select time_bucket(interval '1 hour', ts) period, user_id, count(*) n from events group by all),
g as (select *, case when period - lag(period) over (partition by user_id order by period) > interval '6 hours' then 1 else 0 end b from h),
r as (select *, sum(b) over (partition by user_id order by period) run from g)
select period, cast(user_id as varchar) user_id, cast(sum(n) over (partition by user_id, run order by period) as double) total from r""")
def aggregate_retention(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative series that fall silent for more than 5 windows start anew."""
    out, _ = A.aggregate(_metric_table(spark, d, ["app.events"], ["user_id"]), HOUR, "cumulative", kinds={"sum"})
    return A.cumulate(out, 5, HOUR).select(_w(), _a("user_id"), F.col("value").alias("total"))


@query("""with h as (select time_bucket(interval '1 hour', ts) period, user_id, arg_max(value, (ts, event_id)) v from events group by all),
n as (select *, lead(period) over (partition by user_id order by period) nx from h)
select unnest(range(period, least(coalesce(nx, period + interval '3 hours'), period + interval '3 hours'), interval '1 hour')) period, cast(user_id as varchar) user_id, v level from n""")
def aggregate_gauge_retained(spark: SparkSession, d: str) -> DataFrame:
    """Gauges repeated for up to two silent windows."""
    out, _ = A.aggregate(_metric_table(spark, d, ["app.level"], ["user_id"]), HOUR, kinds={"gauge"})
    return A.retain_gauges(out, HOUR, 2).select(_w(), _a("user_id"), F.col("value").alias("level"))


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    m = _metric_table(spark, d, ["app.level"], ["user_id"], True)
    return m.withColumn("kind", F.when(F.col("_seq") % 2 == 0, "gauge").otherwise("sum")).withColumn("temporality", F.when(F.col("kind") == "sum", "delta")).withColumn("flags", F.when(F.col("_seq") % 7 == 0, 1).otherwise(0)).withColumn(
        "value", F.when(F.col("_seq") % 11 == 0, float("nan")).otherwise(F.col("value")))


_KINDS = f"""k as (select time_bucket(interval '1 hour', tm) period, user_id, seq, tm, value, seq%2=0 is_gauge, case when seq%7=0 then 'no_recorded_value' when seq%11=0 then 'non_finite' end reason from {SHUFFLED}),
f as (select period, user_id, arg_min(is_gauge, seq) own from k where reason is null group by all),
z as (select k.*, coalesce(reason, case when is_gauge <> own then 'kind_conflict' end) fate from k left join f using (period, user_id))"""


@query(f"with {_KINDS} select period, cast(user_id as varchar) user_id, case when is_gauge then 'gauge' else 'sum' end kind, round(case when is_gauge then arg_max(value, (tm, seq)) else sum(value) end, 6) v from z where fate is null group by period, user_id, is_gauge")
def aggregate_kind_conflict(spark: SparkSession, d: str) -> DataFrame:
    """The kind that arrives first owns a series; others pass through."""
    out, _ = A.aggregate(_kinds(spark, d), HOUR)
    return out.select(_w(), _a("user_id"), "kind", F.round("value", 6).alias("v"))


@query(f"with {_KINDS} select coalesce(fate, 'absorbed') fate, count(*) n from z group by 1")
def aggregate_accounting(spark: SparkSession, d: str) -> DataFrame:
    """Metrics in = absorbed + passed through, by reason."""
    out, passed = A.aggregate(_kinds(spark, d), HOUR)
    return out.select(F.lit("absorbed").alias("fate"), "absorbed").groupBy("fate").agg(F.sum("absorbed").alias("n")).unionByName(passed.groupBy(F.col("reason").alias("fate")).agg(F.count("*").alias("n")))


@query("select time_bucket(interval '1 hour', ts) period, event_type, cast(sum(cast(round(value*100) as bigint)) as double) cents from events group by all")
def aggregate_two_stage(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates of aggregates equal aggregates: minutes, then hours."""
    first, _ = A.aggregate(_metric_table(spark, d, ["app.cents"], ["event_type"]), MINUTE, kinds={"sum"})
    again = first.select(F.col("window_ns").alias("ts_ns"), F.col("first_seq").alias("_seq"), "attributes", "resource", "scope", *[F.col(f.name) if f.name in ("name", "unit", "description", "kind", "value") else F.lit("delta").alias("temporality") if f.name == "temporality" else F.lit(True).alias("monotonic") if f.name == "monotonic" else F.lit(None).cast(f.dataType).alias(f.name) for f in METRIC])
    out, _ = A.aggregate(again, HOUR)
    return out.select(_w(), _a("event_type"), F.col("value").alias("cents"))


@query("""with h as (select time_bucket(interval '1 day', ts) period, user_id, event_id from events), f as (select period, user_id, min(event_id) fst from h group by all),
r as (select *, row_number() over (partition by period order by fst) > 20 ovf from f)
select period, case when ovf then '' else cast(user_id as varchar) end user_id, cast(count(*) as double) n from h join r using (period, user_id) group by 1, 2""")
def aggregate_overflow(spark: SparkSession, d: str) -> DataFrame:
    """Beyond 20 series of a metric a day, records fold into the overflow series."""
    m = A.cap_series(_metric_table(spark, d, ["app.events"], ["user_id"]), 24 * HOUR, per_metric=20)
    out, _ = A.aggregate(m.drop("_dropped"), 24 * HOUR, kinds={"sum"})
    return out.select(_w(), F.coalesce(_a("user_id"), F.lit("")).alias("user_id"), F.col("value").alias("n"))


@query("""with h as (select time_bucket(interval '1 day', ts) period, user_id, event_id from events), f as (select period, user_id, min(event_id) fst from h group by all),
r as (select *, row_number() over (partition by period order by fst) > 30 cut from f) select period, cut, count(*) n from h join r using (period, user_id) group by all""")
def aggregate_series_limit(spark: SparkSession, d: str) -> DataFrame:
    """Records beyond the cap on all series of a window, counted."""
    m = A.cap_series(_metric_table(spark, d, ["app.events"], ["user_id"]), 24 * HOUR, whole=30)
    return m.groupBy(_w(f"(ts_ns - pmod(ts_ns, {24 * HOUR}))"), F.col("_dropped").alias("cut")).agg(F.count("*").alias("n"))


# -- deltas and duplicates ----------------------------------------------------------------------


def _counter(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events").select("user_id", "event_id", F.round(F.col("value") * 100).cast("bigint").alias("cents"), (_ts()).alias("ts_ns"))
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    total = F.sum("cents").over(w)
    e = e.withColumn("value", F.when(F.col("event_id") % 37 == 0, F.col("cents")).otherwise(total))
    return e.withColumn("_seq", F.col("event_id") + F.when(F.col("event_id") % 10 == 0, 300).otherwise(0)).withColumn("ts_ns", F.when(F.col("event_id") % 9 == 0, F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(24 * HOUR))).otherwise(F.col("ts_ns")))


@query("""with a as (select user_id, event_id, cast(round(value*100) as bigint) cents, epoch_us(ts)*1000 t from events),
b as (select *, case when event_id%37=0 then cents else cast(sum(cents) over (partition by user_id order by event_id) as bigint) end v, event_id + case when event_id%10=0 then 300 else 0 end seq,
case when event_id%9=0 then t - t%86400000000000 else t end ts_ns from a),
m as (select *, max(ts_ns) over (partition by user_id order by seq, event_id rows between unbounded preceding and 1 preceding) pm from b),
k as (select *, lag(v) over (partition by user_id order by seq, event_id) pv from m where pm is null or ts_ns > pm)
select event_id, 'first' rule, cast(null as bigint) delta from k where pv is null
union all select event_id, case when v < pv then 'reset' else 'difference' end, case when v < pv then v else v - pv end from k where pv is not null
union all select event_id, case when ts_ns = pm then 'duplicate' else 'out_of_order' end, null from m where ts_ns <= pm""")
def cumulative_to_delta(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative counters with resets, duplicates and disorder to deltas."""
    c = _counter(spark, d).withColumn("_seq", F.col("_seq") * 1_000_000_000 + F.col("event_id"))
    return delta.cumulative_to_delta(c, ["user_id"], initial="drop").select("event_id", "rule", "delta")


@query(f"select user_id, tm, arg_max(value, (ts, seq)) v, count(*) merged from {SHUFFLED} group by all")
def dedup_timestamps_lww(spark: SparkSession, d: str) -> DataFrame:
    """One gauge per series and minute."""
    m = _metric_table(spark, d, ["app.level"], ["user_id"])
    m = m.withColumn("_seq", F.pmod(F.col("_seq") * 7919, F.lit(100003)))
    out = delta.dedup_timestamps(m, MINUTE, kinds={"gauge"})
    return out.select(V.text(F.col("attributes")["user_id"]).cast("bigint").alias("user_id"), F.timestamp_seconds(F.expr(f"(ts_ns - pmod(ts_ns, {MINUTE})) div 1000000000")).cast("timestamp_ntz").alias("tm"), F.col("value").alias("v"), "merged")


@query(f"select event_type, tm, cast(sum(cast(round(value*100) as bigint)) as double) v, count(*) merged from {SHUFFLED} group by all")
def dedup_timestamps_delta(spark: SparkSession, d: str) -> DataFrame:
    """Deltas of a series and minute add."""
    out = delta.dedup_timestamps(_metric_table(spark, d, ["app.cents"], ["event_type"]), MINUTE, kinds={"sum"})
    return out.select(_a("event_type"), F.timestamp_seconds(F.expr(f"(ts_ns - pmod(ts_ns, {MINUTE})) div 1000000000")).cast("timestamp_ntz").alias("tm"), F.col("value").alias("v"), "merged")


def _minute() -> Column:
    return F.timestamp_seconds(F.expr(f"(ts_ns - pmod(ts_ns, {MINUTE})) div 1000000000")).cast("timestamp_ntz").alias("tm")


@query(f"select event_type, tm, count(*) n, arg_min(value, (ts, seq)) first_v, arg_max(value, (ts, seq)) last_v, count(*) merged from {SHUFFLED} group by all")
def dedup_timestamps_samples(spark: SparkSession, d: str) -> DataFrame:
    """Raw samples of a series and minute concatenate in order."""
    m = _metric_table(spark, d, ["app.value"], ["event_type"]).withColumn("_seq", F.pmod(F.col("_seq") * 7919, F.lit(100003)))
    out = delta.dedup_timestamps(m, MINUTE, kinds={"samples"})
    return out.select(_a("event_type"), _minute(), F.size("samples").cast("bigint").alias("n"), F.col("samples")[0].alias("first_v"), F.element_at("samples", -1).alias("last_v"), "merged")


@query("select event_type, time_bucket(interval '1 hour', ts) tm, array_to_string(list_sort(list(distinct cast(user_id as varchar))), ' ') members, count(*) merged from events group by all")
def dedup_timestamps_sets(spark: SparkSession, d: str) -> DataFrame:
    """Members of a series and hour unite."""
    out = delta.dedup_timestamps(_metric_table(spark, d, ["app.users"], ["event_type"]), HOUR, kinds={"set_members"})
    return out.select(_a("event_type"), _w(f"(ts_ns - pmod(ts_ns, {HOUR}))").alias("tm"), F.array_join(F.array_sort("members"), " ").alias("members"), "merged")


@query("""select l_returnflag flag, l_shipdate::timestamp tm, count(*) filter (l_extendedprice <= 1000) b0, count(*) filter (l_extendedprice > 1000 and l_extendedprice <= 10000) b1, count(*) filter (l_extendedprice > 10000 and l_extendedprice <= 30000) b2,
 count(*) filter (l_extendedprice > 30000 and l_extendedprice <= 60000) b3, count(*) filter (l_extendedprice > 60000) b4, round(sum(l_extendedprice), 2) total, min(l_extendedprice) low, max(l_extendedprice) high, count(*) n from lineitem group by all""")
def dedup_timestamps_histograms(spark: SparkSession, d: str) -> DataFrame:
    """Delta histograms of equal bounds at one time add, bucket by bucket."""
    out = delta.dedup_timestamps(_histograms(spark, d), 1_000_000_000, kinds={"histogram"})
    at = F.timestamp_seconds(F.expr("ts_ns div 1000000000")).cast("timestamp_ntz")
    return out.select(_a("flag"), at.alias("tm"), *[F.col("buckets")[i]["count"].alias(f"b{i}") for i in range(5)], F.round("sum", 2).alias("total"), F.col("min").alias("low"), F.col("max").alias("high"), F.col("count").alias("n"))


@query(f"""with k as (select *, seq % 5 = 0 flagged, seq % 3 = 1 broken, seq % 2 = 0 as whole, time_bucket(interval '1 hour', tm) b from {SHUFFLED}),
r as (select *, case when flagged then 'no_recorded_value' when broken then 'non_finite' end own from k),
t as (select *, last_value(case when own is null then whole end ignore nulls) over w top, count(*) filter (own is null) over (partition by event_type, b) able, count(*) over (partition by event_type, b) every, min(seq) over (partition by event_type, b) fst
 from r window w as (partition by event_type, b order by case when own is null then 1 else 0 end, ts, seq rows between unbounded preceding and unbounded following)),
f as (select coalesce(case when own is not null then case when able > 0 or seq <> fst then own else 'alone' end end, case when whole <> top then 'mixed_type' end, 'absorbed') fate from t) select fate, count(*) n from f group by 1""")
def dedup_timestamps_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Sums of two value types, flagged and non-finite ones: what merges and what passes through, by reason."""
    m = _metric_table(spark, d, ["app.cents"], ["event_type"]).withColumn("_seq", F.pmod(F.col("_seq") * 7919, F.lit(100003)))
    k = F.col("_seq")
    m = m.withColumns({"flags": F.when(k % 5 == 0, 1).otherwise(0), "value": F.when(k % 3 == 1, float("nan")).otherwise(F.col("value")), "value_type": F.when(k % 2 == 0, "i").otherwise("f"), "value_i64": F.when(k % 2 == 0, F.col("value_i64"))})
    out = delta.dedup_timestamps(m, HOUR, kinds={"sum"})
    fate = F.when(F.col("reason").isNotNull(), F.col("reason")).when((F.col("flags") == 1) | F.isnan("value"), "alone").otherwise("absorbed")
    return out.groupBy(fate.alias("fate")).agg(F.sum("merged").alias("n"))


# -- parsers ------------------------------------------------------------------------------------


@query("select event_id, json_extract_string(props, '$.k') k, json_extract_string(props, '$.absent') absent, case when event_id % 5 = 0 then 'raw' else 'json' end shape from events")
def parse_json_props(spark: SparkSession, d: str) -> DataFrame:
    """Objects become attributes; text with a tail passes unchanged."""
    e = events(spark, d)
    bad = F.col("_seq") % 5 == 0
    p = parsers.json(e.withColumn("log", F.col("log").withField("message", F.when(bad, F.concat("log.message", F.lit(" tail"))).otherwise(F.col("log.message")))))
    whole = parsers.json(e)
    j = p.select(F.col("_seq").alias("event_id"), F.when(F.map_contains_key("attributes", F.lit("k")), "json").otherwise("raw").alias("shape"))
    return whole.select(F.col("_seq").alias("event_id"), V.text(F.col("attributes")["k"]).alias("k"), V.text(F.col("attributes")["absent"]).alias("absent")).join(j, "event_id")


def _orders(spark: SparkSession, d: str, message: Column) -> DataFrame:
    return as_event(read(spark, d, "orders"), F.col("o_orderkey"), _ts("o_orderdate"), message=message)


def _day() -> Column:
    return F.date_format(F.col("o_orderdate"), "yyyy-MM-dd")


@query("select o_orderkey, cast(o_custkey as varchar) cust, o_orderstatus || ', \"x\"' status, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderpriority prio from orders")
def parse_csv_row(spark: SparkSession, d: str) -> DataFrame:
    """Quoted fields with delimiters and quotes inside."""
    m = F.concat_ws(",", F.col("o_custkey").cast("string"), F.concat(F.lit('"'), F.col("o_orderstatus"), F.lit(', ""x"""')), _day(), F.col("o_orderpriority"))
    p = parsers.csv(_orders(spark, d, m), ["cust", "status", "day", "prio"])
    return p.select(F.col("_seq").alias("o_orderkey"), *[_a(k) for k in ("cust", "status", "day", "prio")])


@query("select o_orderkey, cast(o_custkey as varchar) cust, 'say \"' || o_orderstatus || '\"' status, 'true' flag, o_orderpriority prio from orders")
def parse_logfmt(spark: SparkSession, d: str) -> DataFrame:
    """Quoted values with escapes, bare keys, a later duplicate."""
    m = F.concat(F.lit("prio=old cust="), F.col("o_custkey").cast("string"), F.lit(' status="say \\"'), F.col("o_orderstatus"), F.lit('\\"" flag prio="'), F.col("o_orderpriority"), F.lit('"'))
    p = parsers.logfmt(_orders(spark, d, m), bare_keys=True)
    return p.select(F.col("_seq").alias("o_orderkey"), *[_a(k) for k in ("cust", "status", "flag", "prio")])


@query("select o_orderkey, cast(o_custkey as varchar) cust, o_orderstatus status, strftime(o_orderdate, '%Y-%m-%d') as day from orders")
def parse_kv(spark: SparkSession, d: str) -> DataFrame:
    """Literal pair and key separators; blanks and empty keys skipped."""
    m = F.concat(F.lit("cust="), F.col("o_custkey").cast("string"), F.lit("&&=x&status="), F.col("o_orderstatus"), F.lit("&day="), _day(), F.lit("&"))
    return parsers.kv(_orders(spark, d, m), "&", "=").select(F.col("_seq").alias("o_orderkey"), *[_a(k) for k in ("cust", "status", "day")])


@query("select o_orderkey, regexp_extract(o_orderpriority, '^(\\d)-(\\w+)', 1) rank, regexp_extract(o_orderpriority, '^(\\d)-(\\w+)', 2) word from orders")
def parse_regex(spark: SparkSession, d: str) -> DataFrame:
    """Named groups of the first match."""
    p = parsers.regex(_orders(spark, d, F.col("o_orderpriority")), r"^(?<rank>\d)-(?<word>\w+)")
    return p.select(F.col("_seq").alias("o_orderkey"), F.coalesce(_a("rank"), F.lit("")).alias("rank"), F.coalesce(_a("word"), F.lit("")).alias("word"))


@query("""select o_orderkey, 'price' field, o_totalprice v, epoch_us(o_orderdate)*1000 point_ns, o_orderstatus status from orders
union all select o_orderkey, 'cust', cast(o_custkey as double), epoch_us(o_orderdate)*1000, o_orderstatus from orders""")
def line_protocol_explode(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a message as points; a comment and a bad line are skipped."""
    m = F.concat(F.lit("# note\nnot a point\norder\\ line,status="), F.col("o_orderstatus"), F.lit(" price="), F.col("o_totalprice").cast("string"), F.lit(",cust="), F.col("o_custkey").cast("string"), F.lit("i "), _ts("o_orderdate").cast("string"))
    p = parsers.line_protocol(_orders(spark, d, m))
    return p.select(F.col("_seq").alias("o_orderkey"), "field", V.text(F.col("value")).cast("double").alias("v"), "point_ns", _a("status"))


def _access(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    k = F.col("c_custkey")
    path = F.when(k % 4 == 0, "healthz").when(k % 4 == 1, "img/a.PNG").when(k % 4 == 2, "robots.txt").otherwise("api/orders")
    url = F.concat(F.lit("https://shop.example/"), path, F.lit("?sig="), k.cast("string"), F.lit("&page=2"))
    status = F.when(k % 7 == 0, "503").when(k % 7 == 1, "404").otherwise("200")
    ua = F.when(k % 3 == 0, "curl/8.1").when(k % 3 == 1, "Mozilla/5.0 (compatible; Examplebot/2.0)").otherwise("Mozilla/5.0 Firefox/128")
    a = attrs(**{"url-original": V.s(url), "http.request.method": V.s(F.when(k % 5 == 0, "FETCH").otherwise("GET")), "http.response.status_code": V.s(status), "http.request.duration_ms": V.s(k), "user_agent.original": V.s(ua)})
    return http_access.http_access(as_event(c, k, F.lit(0), a, message=F.lit("x")), ["probes", "well_known", "assets"], "/{other}", status_class=True)


@query("""with a as (select c_custkey, case c_custkey%4 when 0 then '/{probe}' when 1 then '/{asset}' when 2 then '/{well-known}' else '/{other}' end route, case when c_custkey%5=0 then '_OTHER' else 'GET' end method,
case when c_custkey%7=0 then 503 when c_custkey%7=1 then 404 else 200 end st, case c_custkey%3 when 0 then 'tool' when 1 then 'crawler' else 'browser' end agent from customer)
select c_custkey, route, method, agent, cast(st//100 as varchar) || 'xx' status_class, case when st >= 500 then '503' end error_type, case when st >= 500 then 'error' else 'unset' end span_status,
case when method = '_OTHER' then 'HTTP ' else 'GET ' end || route span_name, c_custkey/1000.0::double duration_s from a""")
def http_access_derive(spark: SparkSession, d: str) -> DataFrame:
    """Method, route, agent class, status class, error type, span fields and duration of access lines."""
    names = {"http.route": "route", "http.request.method": "method", "user_agent.class": "agent", "http.response.status_class": "status_class", "error.type": "error_type", "span.status": "span_status", "span.name": "span_name"}
    return _access(spark, d).select(F.col("_seq").alias("c_custkey"), *[V.text(F.col("attributes")[k]).alias(v) for k, v in names.items()], V.text(F.col("attributes")["http.request.duration_s"]).cast("double").alias("duration_s"))


@query("select c_custkey, '/' || case c_custkey % 4 when 0 then 'healthz' when 1 then 'img/a.PNG' when 2 then 'robots.txt' else 'api/orders' end path, regexp_replace('sig=' || c_custkey || '&page=2', '(^|&)(sig)=[^&]+', '\\1\\2=REDACTED', 'g') query from customer")
def http_access_redact(spark: SparkSession, d: str) -> DataFrame:
    """Target split, sensitive query values redacted."""
    return _access(spark, d).select(F.col("_seq").alias("c_custkey"), V.text(F.col("attributes")["url.path"]).alias("path"), V.text(F.col("attributes")["url.query"]).alias("query"))


# -- reshaping ----------------------------------------------------------------------------------


def _customers(spark: SparkSession, d: str) -> DataFrame:
    a = attrs(segment=V.s(F.col("c_mktsegment")), balance=V.float_value(F.col("c_acctbal")), nation=V.tagged(F.col("c_nationkey"), "i"), name=V.s(F.col("c_name")))
    return as_event(read(spark, d, "customer"), F.col("c_custkey"), F.lit(0), a, resource=attrs(region=V.s(F.concat(F.lit("r"), F.col("c_nationkey") % 5))))


@query("select c_custkey, c_mktsegment segment, 'prod' env, 2 n_attributes from customer")
def set_keep_remove(spark: SparkSession, d: str) -> DataFrame:
    """Constants, allow-list, deny-list in a chain."""
    e = reshape.remove(reshape.keep(reshape.set_(_customers(spark, d), {"env": "prod"}), ["segment", "name", "env"]), ["name"])
    return e.select(F.col("_seq").alias("c_custkey"), _a("segment"), _a("env"), F.size("attributes").alias("n_attributes"))


@query("select c_custkey, case when lower(c_mktsegment) in ('building', 'machinery') then lower(c_mktsegment) else 'other' end segment from customer")
def keep_values_clamp(spark: SparkSession, d: str) -> DataFrame:
    """Values clamped to a list after normalising."""
    return reshape.keep_values(_customers(spark, d), "segment", ["building", "machinery"], "lower", "other").select(F.col("_seq").alias("c_custkey"), _a("segment"))


@query("select c_custkey, c_acctbal * 0.01::double balance, c_nationkey * 2.0::double nation, c_name \"name\" from customer")
def scale_fields(spark: SparkSession, d: str) -> DataFrame:
    """Numbers scaled as floats; text stays."""
    e = reshape.scale(_customers(spark, d), {"balance": 0.01, "nation": 2.0, "name": 3.0})
    return e.select(F.col("_seq").alias("c_custkey"), _a("balance").cast("double").alias("balance"), _a("nation").cast("double").alias("nation"), _a("name"))


@query("select c_custkey, case when c_acctbal < 0 then 'debt' when c_acctbal <= 5000 then 'low' else 'high' end band, case when c_nationkey < 10 then 'a' else 'z' end zone from customer")
def bucket_balance(spark: SparkSession, d: str) -> DataFrame:
    """Classes of a number by ordered ranges; unmatched goes to other."""
    e = reshape.bucket(_customers(spark, d), "balance", "band", [("lt", 0, "debt"), ("le", 5000, "low"), ("any", None, "high")])
    e = reshape.bucket(e, "nation", "zone", [("lt", 10, "a")], other="z")
    return e.select(F.col("_seq").alias("c_custkey"), _a("band"), _a("zone"))


@query("""select l_orderkey, l_linenumber, 'line.count' "name", 'sum' kind, 1.0::double v from lineitem union all select l_orderkey, l_linenumber, 'line.quantity', 'gauge', l_quantity from lineitem
union all select l_orderkey, l_linenumber, 'line.price', 'samples', l_extendedprice from lineitem""")
def kv_metrics_derive(spark: SparkSession, d: str) -> DataFrame:
    """Counter, gauge and distribution derived from attributes; missing fields skip theirs."""
    li = read(spark, d, "lineitem")
    e = as_event(li, F.col("l_orderkey") * 10 + F.col("l_linenumber"), _ts("l_shipdate"), attrs(q=V.s(F.col("l_quantity")), p=V.float_value(F.col("l_extendedprice")), flag=V.s(F.col("l_returnflag"))))
    m = reshape.kv_metric_rows(e, [{"name": "line.count"}], [{"name": "line.quantity", "field": "q"}, {"name": "none", "field": "flag"}], [{"name": "line.price", "field": "p"}])
    return m.select(F.expr("_seq div 10").alias("l_orderkey"), (F.col("_seq") % 10).cast("int").alias("l_linenumber"), "name", "kind", F.coalesce("value", F.col("samples")[0]).alias("v"))


@query("select o_orderkey, case when ok then lpad(printf('%x', o_orderkey), 32, '0') end trace, case when ok then lpad(printf('%x', o_custkey), 16, '0') end span, case when ok then 1 end flags, case when ok then 0 else 1 end kept from (select *, o_orderkey % 3 > 0 and o_orderkey > 0 and o_custkey > 0 ok from orders)")
def trace_context_lift(spark: SparkSession, d: str) -> DataFrame:
    """Valid traceparents go to the log; malformed ones stay where they are."""
    hexes = lambda c, n: F.lpad(F.lower(F.hex(F.col(c))), n, "0")
    tp = F.concat_ws("-", F.lit("00"), F.when(F.col("o_orderkey") % 3 > 0, hexes("o_orderkey", 32)).otherwise(F.lit("zz")), hexes("o_custkey", 16), F.lit("01"))
    e = reshape.trace_context(as_event(read(spark, d, "orders"), F.col("o_orderkey"), F.lit(0), attrs(traceparent=V.s(tp)), message=F.lit("m")))
    return e.select(F.col("_seq").alias("o_orderkey"), F.col("log.trace_id").alias("trace"), F.col("log.span_id").alias("span"), F.col("log.trace_flags").alias("flags"), F.map_contains_key("attributes", F.lit("traceparent")).cast("int").alias("kept"))


@query("select event_id, epoch_us(ts)*1000 - epoch_us(ts)%1000*1000 ts_ns, epoch_us(ts)*1000 + case when event_id%10=0 then 7200 else 1 end * 1000000000 observed from events where event_id%10<>0 union all select event_id, epoch_us(ts)*1000 + 7200*1000000000::bigint, 0 from events where event_id%10=0")
def timestamp_unix_millis(spark: SparkSession, d: str) -> DataFrame:
    """Event time from an attribute, unless it lies further than an hour from the receipt."""
    e = read(spark, d, "events")
    ms = F.expr("unix_micros(cast(ts as timestamp)) div 1000")
    receipt = _ts() + F.when(F.col("event_id") % 10 == 0, 7200).otherwise(1).cast("bigint") * 1_000_000_000
    t = reshape.timestamp(as_event(e, F.col("event_id"), receipt, attrs(at=V.s(ms)), message=F.lit("m")), "at", "unix_millis", max_skew_ns=HOUR)
    return t.select(F.col("_seq").alias("event_id"), "ts_ns", F.col("log.observed_ns").alias("observed"))


@query("select event_id, epoch_us(date_trunc('second', ts))*1000 ts_ns from events")
def timestamp_rfc3164(spark: SparkSession, d: str) -> DataFrame:
    """Year-less times: the year nearest to the receipt."""
    e = as_event(read(spark, d, "events"), F.col("event_id"), _ts() + 5_000_000_000, attrs(at=V.s(F.date_format("ts", "MMM d HH:mm:ss"))))
    return reshape.timestamp(e, "at", "rfc3164").select(F.col("_seq").alias("event_id"), "ts_ns")


@query("select c_custkey, c_mktsegment \"a.segment\", cast(c_nationkey as varchar) \"a.b.nation\", c_name \"tags.0\", 'x' \"tags.1\", 4 n from customer")
def flatten_nested(spark: SparkSession, d: str) -> DataFrame:
    """Nested objects and arrays to dotted keys."""
    c = read(spark, d, "customer")
    a = F.concat(F.lit("m"), F.to_json(F.struct(F.col("c_mktsegment").alias("segment"), F.struct(F.col("c_nationkey").alias("nation")).alias("b"))))
    e = reshape.flatten(as_event(c, F.col("c_custkey"), F.lit(0), attrs(a=a, tags=F.concat(F.lit("a"), F.to_json(F.array(F.col("c_name"), F.lit("x")))))), levels=3)
    return e.select(F.col("_seq").alias("c_custkey"), *[V.text(F.col("attributes")[k]).alias(k) for k in ("a.segment", "a.b.nation", "tags.0", "tags.1")], F.size("attributes").alias("n"))


@query("select o_orderkey, 'order ' || o_orderkey || ' {' || (o_custkey % 7) || '}' label from orders")
def template_render(spark: SparkSession, d: str) -> DataFrame:
    """Placeholders, remainders and escapes."""
    return read(spark, d, "orders").select("o_orderkey", reshape.template("order {seq} {{{c%7}}}", seq=F.col("o_orderkey"), c=F.col("o_custkey")).alias("label"))


# -- filters ------------------------------------------------------------------------------------


@query("select c_custkey from customer where c_mktsegment = 'BUILDING' and c_nationkey = 7")
def has_attributes_filter(spark: SparkSession, d: str) -> DataFrame:
    """Conjunction of typed equalities and of keys that are there."""
    return filters.has_attributes(_customers(spark, d), attributes={"segment": "BUILDING", "nation": "7"}, present=["name"]).select(F.col("_seq").alias("c_custkey"))


@query("select c_custkey from customer where not coalesce(c_mktsegment = 'BUILDING' and 'r' || (c_nationkey % 5) = 'r2', false)")
def drop_attributes_complement(spark: SparkSession, d: str) -> DataFrame:
    """The exact complement, nulls included."""
    return filters.drop_attributes(_customers(spark, d), attributes={"segment": "BUILDING"}, resource={"region": "r2"}).select(F.col("_seq").alias("c_custkey"))


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """Events with all, some or no payloads."""
    e, k = events(spark, d), F.col("_seq") % 4
    null = lambda c: F.lit(None).cast(e.schema[c].dataType)
    span = F.struct(*[(F.when(F.lit(f.name == "end_ns"), F.col("ts_ns") + MINUTE) if f.name == "end_ns" else F.lit("x") if f.dataType.typeName() == "string" else F.lit(None)).cast(f.dataType).alias(f.name) for f in SPAN])
    return e.withColumn("log", F.when(k.isin(0, 1), F.col("log")).otherwise(null("log"))).withColumn("metrics", F.when(k.isin(0, 2), F.col("metrics")).otherwise(null("metrics"))).withColumn("span", F.when(F.col("_seq") % 8 == 0, span).otherwise(null("span")))


@query("select event_id from events where event_id % 4 in (0, 1) and not event_id % 4 = 0")
def has_signal_only(spark: SparkSession, d: str) -> DataFrame:
    """Events that carry logs and nothing else."""
    return filters.has_signal(_mixed(spark, d), ["logs"], "only").select(F.col("_seq").alias("event_id"))


@query("select event_id, event_id % 4 in (0, 1) log, event_id % 4 in (0, 2) metrics from events where event_id % 4 <> 3")
def keep_signals_two(spark: SparkSession, d: str) -> DataFrame:
    """Only the listed payloads stay; emptied events go."""
    return filters.keep_signals(_mixed(spark, d), ["logs", "metrics"]).select(F.col("_seq").alias("event_id"), F.col("log").isNotNull().alias("log"), F.coalesce(F.size("metrics") > 0, F.lit(False)).alias("metrics"))


@query("select event_id from events where event_id % 4 in (0, 2)")
def drop_signals_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs cleared; what had only logs goes, and so do empty events."""
    return filters.drop_signals(_mixed(spark, d), ["logs"]).select(F.col("_seq").alias("event_id"))


_NOW = 1_705_000_000_000_000_000


@query(f"select event_id from events where not (({_NOW} - (epoch_us(ts)*1000 + case when event_id%8=0 then 60000000000 else 0 end)) > 86400000000000::bigint * 3 or (epoch_us(ts)*1000 + case when event_id%8=0 then 60000000000 else 0 end) - {_NOW} > 86400000000000::bigint * 5)")
def drop_stale_window(spark: SparkSession, d: str) -> DataFrame:
    """Events not older than three days nor further ahead than five, by span end or time."""
    return filters.drop_stale(_mixed(spark, d), _NOW, 72 * HOUR, 120 * HOUR).select(F.col("_seq").alias("event_id"))


@query("select o_orderkey id, 'shop' origin from orders union all select c_custkey, 'crm' from customer")
def fan_in_union(spark: SparkSession, d: str) -> DataFrame:
    """Two sources as one bag."""
    return _two(spark, d).select(F.col("_seq").alias("id"), F.col("_origin").alias("origin"))


def _two(spark: SparkSession, d: str) -> DataFrame:
    return route.fan_in(route.with_provenance(_orders(spark, d, F.lit("m")), "shop"), route.with_provenance(_customers(spark, d), "crm"))


@query("select c_custkey id from customer")
def provenance_filter(spark: SparkSession, d: str) -> DataFrame:
    """Events by the component they came from."""
    two = _two(spark, d)
    return filters.drop_provenance(filters.has_provenance(two, origin=["crm", "shop"]), previous=["shop"]).select(F.col("_seq").alias("id"))


#: XXH64 of short decimal text in whole-number arithmetic modulo 2^64.
_M = "18446744073709551616::uhugeint"
_P = ["", "11400714785074694791::uhugeint", "14029467366897019727::uhugeint", "1609587929392839161::uhugeint", "9650029242287828579::uhugeint", "2870177450012600261::uhugeint"]
_xor = "xor(({0})::ubigint, ({1})::ubigint)::uhugeint".format
_mul = f"(({{0}}) * {{1}} % {_M})".format
_rotl = f"((({{0}}) * {{1}}::uhugeint % {_M}) + ({{0}}) // {{2}}::uhugeint)".format
_BYTE = _mul(_rotl(_xor("a", _mul("b", _P[5])), 2**11, 2**53), _P[1])
_WORD = f"(({_mul(_rotl(_xor('h0', _mul('w', _P[1])), 2**23, 2**41), _P[2])}) + {_P[3]}) % {_M}"
_XXH64 = f"""u as (select distinct user_id, user_id::varchar s from events), y as (select user_id, length(s) n, ({_P[5]} + length(s)::uhugeint) % {_M} h0, [ascii(c)::uhugeint for c in string_split(s, '')] bs from u),
w as (select *, (bs[1] + bs[2]*256 + bs[3]*65536 + bs[4]*16777216)::uhugeint w from y), h1 as (select user_id, n, bs, case when n >= 4 then {_WORD} else h0 end h from w),
g0 as (select user_id, case when n >= 4 then bs[5:] else bs end r, h a from h1), g1 as (select user_id, r, r[1] b, a from g0), g2 as (select user_id, r, r[2] b, case when b is null then a else {_BYTE} end a from g1),
g3 as (select user_id, r[3] b, case when b is null then a else {_BYTE} end a from g2), h2 as (select user_id, case when b is null then a else {_BYTE} end h from g3), h3 as (select user_id, {_mul(_xor("h", "h // 8589934592::uhugeint"), _P[2])} h from h2),
h4 as (select user_id, {_mul(_xor("h", "h // 536870912::uhugeint"), _P[3])} h from h3), x as (select user_id, {_xor("h", "h // 4294967296::uhugeint")} h from h4)"""


@query(f"with {_XXH64} select event_id, user_id::varchar user_id from events join x using (user_id) where h // 2048 < 2251799813685248::uhugeint")
def sample_by_key(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the users, the same in every process; vectors of the hash are unit-tested."""
    return filters.sample(events(spark, d), 0.25, "user_id", always_keep=None).select(F.col("_seq").alias("event_id"), _a("user_id"))


# -- routing ------------------------------------------------------------------------------------


@query("""select c_custkey, case c_mktsegment when 'BUILDING' then 'build' when 'MACHINERY' then 'machines' else 'forward' end target from customer
union all select c_custkey, 'audit' from customer where c_mktsegment = 'MACHINERY'""")
def route_by_attribute(spark: SparkSession, d: str) -> DataFrame:
    """First matching route; lists copy; no match forwards."""
    parts = route.route(_customers(spark, d), "attribute", [("BUILDING", ["build"]), ("MACHINERY", ["machines", "audit"])], "segment")
    return route.fan_in(*[p.select(F.col("_seq").alias("c_custkey"), F.lit(t).alias("target")) for t, p in parts.items()])


@query("select event_id, 'logs' target from events where event_id%4 in (0, 1) union all select event_id, 'numbers' from events where event_id%4 in (0, 2)")
def route_signals_split(spark: SparkSession, d: str) -> DataFrame:
    """A mixed event splits into one part per target."""
    parts = route.route_signals(_mixed(spark, d), {"logs": "logs", "metrics": "numbers"})
    return route.fan_in(*[p.select(F.col("_seq").alias("event_id"), F.lit(t).alias("target")) for t, p in parts.items()])


# -- expansion, profile, codecs -----------------------------------------------------------------


@query("""with a as (select event_type, count(*) n, round(sum(value), 6) s, min(value) lo, max(value) hi from events group by 1)
select event_type, 'app.value.count' "name", n::double v from a union all select event_type, 'app.value.sum', s from a union all select event_type, 'app.value.min', lo from a union all select event_type, 'app.value.max', hi from a""")
def multi_value_expand(spark: SparkSession, d: str) -> DataFrame:
    """A distribution as one number per row."""
    out, _ = A.aggregate(_metric_table(spark, d, ["app.value"], ["event_type"]), 10**18, kinds={"samples"})
    m = out.drop("buckets").withColumn("count", F.col("d_count")).withColumn("sum", F.round("d_sum", 6)).withColumn("min", F.col("d_min")).withColumn("max", F.col("d_max"))
    for c in ("buckets", "quantiles", "members"):
        m = m.withColumn(c, F.lit(None).cast(METRIC[c].dataType))
    return text.multi_value(m).select(_a("event_type"), "name", F.col("value").alias("v"))


@query("""select event_type, count(*) events, cast(count(*) * 2 as bigint) attributes, cast(sum(length(event_type) + length(cast(user_id as varchar))) as bigint) value_bytes, cast(sum(strlen(props)) as bigint) body_bytes, 2::bigint distinct_keys, 1::bigint distinct_key_sets, 1.0::double share_top1 from events group by 1""")
def shape_profile(spark: SparkSession, d: str) -> DataFrame:
    """Sizes and key sets of events per source."""
    m = shape.measure(events(spark, d).withColumn("_origin", V.text(F.col("attributes")["event_type"])))
    return shape.summarise(m, ["_origin"]).select(F.col("_origin").alias("event_type"), "events", "attributes", "value_bytes", "body_bytes", "distinct_keys", "distinct_key_sets", "share_top1")


def _lines(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select(*[c.alias(k) for k, c in cols.items()])


@query("select event_id, event_type, 'app.value' \"name\", 'gauge' kind, round(value, 2) v from events where event_id%2=0 union all select event_id, event_type, 'app.hits', 'sum', 2.0 from events where event_id%2=1")
def statsd_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Rendered as statsd lines with tags and rates, parsed, rendered and parsed again."""
    e = read(spark, d, "events")
    line = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit("app.value:"), F.round("value", 2).cast("string"), F.lit("|g|#type:"), F.col("event_type"))).otherwise(F.concat(F.lit("app.hits:1|c|@0.5|#type:"), F.col("event_type"), F.lit(",type:"), F.col("event_type")))
    once = text.statsd(_lines(e, _seq=F.col("event_id"), ts_ns=_ts(), line=line))
    again = text.statsd(text.to_statsd(once).withColumn("ts_ns", F.lit(0).cast("bigint")))
    return again.select(F.col("_seq").alias("event_id"), V.text(F.col("attributes")["type"]).alias("event_type"), "name", "kind", F.col("value").alias("v"))


@query("select event_id, 'app.value' \"name\", event_type, round(value, 2) v, epoch_us(date_trunc('second', ts))*1000 ts_ns from events")
def graphite_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Tagged paths."""
    e = read(spark, d, "events")
    line = F.concat(F.lit("app.value;type="), F.col("event_type"), F.lit(" "), F.round("value", 2).cast("string"), F.lit(" "), F.expr("unix_micros(cast(ts as timestamp)) div 1000000").cast("string"))
    again = text.graphite(text.to_graphite(text.graphite(_lines(e, _seq=F.col("event_id"), ts_ns=_ts(), line=line))).withColumn("ts_ns", F.lit(0).cast("bigint")))
    return again.select(F.col("_seq").alias("event_id"), "name", V.text(F.col("attributes")["type"]).alias("event_type"), F.col("value").alias("v"), "ts_ns")


@query("select event_id, 'app.value' \"name\", event_type, round(value, 2) v, epoch_us(ts)*1000 ts_ns from events")
def influx_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Line protocol, both ways."""
    e = read(spark, d, "events")
    line = F.concat(F.lit("app,type="), F.col("event_type"), F.lit(" value="), F.round("value", 2).cast("string"), F.lit(" "), _ts().cast("string"))
    again = text.influx(text.to_influx(text.influx(_lines(e, _seq=F.col("event_id"), ts_ns=_ts(), line=line))).withColumn("ts_ns", F.lit(0).cast("bigint")))
    return again.select(F.col("_seq").alias("event_id"), "name", V.text(F.col("attributes")["type"]).alias("event_type"), F.col("value").alias("v"), "ts_ns")


@query("select event_id, 'app_value' \"name\", event_type, round(value, 2) v, epoch_us(ts)//1000*1000000 ts_ns from events")
def prometheus_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Exposition lines, both ways, names sanitised."""
    e = read(spark, d, "events")
    m = e.select(F.col("event_id").alias("_seq"), _ts().alias("ts_ns"), F.lit("app.value").alias("name"), attrs(type=V.s(F.col("event_type"))).alias("attributes"), F.round("value", 2).alias("value"))
    again = text.prometheus(text.to_prometheus(m).withColumn("ts_ns", F.lit(0).cast("bigint")))
    return again.select(F.col("_seq").alias("event_id"), "name", V.text(F.col("attributes")["type"]).alias("event_type"), F.col("value").alias("v"), "ts_ns")


@query("select record_id, cast(syslog_facility as varchar) facility, cast(syslog_severity as varchar) severity, syslog_tag tag, message from syslog_records")
def syslog_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Records rendered as syslog lines and read back."""
    r = read(spark, d, "syslog_records")
    a = attrs(**{"syslog.facility": V.tagged(F.col("syslog_facility"), "i"), "syslog.severity": V.tagged(F.col("syslog_severity"), "i"), "syslog.tag": V.s(F.col("syslog_tag")), "process.pid": V.s(F.col("process_pid"))})
    lines = text.to_syslog(r.select(F.col("record_id").alias("_seq"), (micros("received_at") * 1000).alias("ts_ns"), a.alias("attributes"), "message"))
    s = text.syslog(lines.withColumn("ts_ns", F.lit(0).cast("bigint")))
    return s.select(F.col("_seq").alias("record_id"), V.text(F.col("attributes")["syslog.facility"]).alias("facility"), V.text(F.col("attributes")["syslog.severity"]).alias("severity"), V.text(F.col("attributes")["syslog.tag"]).alias("tag"), "message")


@query("select o_custkey, count(*) n, string_agg(o_orderpriority, '' order by o_orderkey) message from (select o_custkey, o_orderkey, o_orderpriority, coalesce(sum(case when o_orderkey%3=0 then 1 else 0 end) over (partition by o_custkey order by o_orderkey rows between unbounded preceding and 1 preceding), 0) g from orders) group by o_custkey, g")
def cri_reassemble(spark: SparkSession, d: str) -> DataFrame:
    """Partial container log lines joined up to their final part."""
    o = read(spark, d, "orders")
    line = F.concat(F.lit("2024-01-01T00:00:00.000000001Z stdout "), F.when(F.col("o_orderkey") % 3 == 0, "F").otherwise("P"), F.lit(" "), F.col("o_orderpriority"))
    c = text.cri(o.select("o_custkey", F.col("o_orderkey").alias("_seq"), line.alias("line")), ["o_custkey"])
    return c.select("o_custkey", F.regexp_count("message", F.lit("[0-9]-")).cast("bigint").alias("n"), "message")


@query(f"with {_XXH64} select user_id, case when h >= 9223372036854775808::uhugeint then (h::hugeint - 18446744073709551616::hugeint)::bigint else h::bigint end h from x")
def consistent_hash(spark: SparkSession, d: str) -> DataFrame:
    """The frozen hash of every user id."""
    return read(spark, d, "events").select("user_id").distinct().select("user_id", hashing.xxh64(F.col("user_id").cast("string")).alias("h"))
