"""Queries of the general data-processing problems 1, 2, 3, 6 and 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import identity
from strandline.functions.shared import join_sized, materialise, read, scratch
from strandline.operators import exactly_once, instants, late_events, log_entries, regular_grid

MESSAGE = ["series_h", "series_twin", "ns", "value"]


def _state(spark: SparkSession, d: str, batch: str | None = None) -> DataFrame:
    return late_events.dots(
        read(spark, d, "log_records"), key="log_id", event="event_timestamp", observed="observed_timestamp",
        received="received_at", group=["service_name"], source="host_name", batch=batch,
    )


def _dots(spark: SparkSession, d: str) -> DataFrame:
    """The counter state of every batch by itself, merged, with the outcome of each record."""
    return late_events.with_outcome(late_events.merge_dots([_state(spark, d, "batch_id")], "log_id", ["service_name"]))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Records whose earliest arrival is late or beyond the cut-off."""
    return _dots(spark, d).where("outcome <> 'on_time'").select("log_id", "outcome")


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """Hourly totals per service from the states of all batches, merged."""
    t = late_events.totals(late_events.versions(_dots(spark, d), ["service_name"]), ["service_name"])
    return t.select(F.timestamp_seconds(F.expr("period_end div 1000000000 - 3600")).alias("period"), "service_name", "n", "dropped")


def p1_corrections(spark: SparkSession, d: str) -> DataFrame:
    """Hourly totals per service right after each arrival step."""
    c = late_events.corrections(late_events.versions(_dots(spark, d), ["service_name"]), ["service_name"])
    return c.select(F.expr("period_end div 3600000000000 - 1").alias("period_no"), "service_name", "seq", "n", "dropped")


def _estimates(spark: SparkSession, d: str, hosts: DataFrame, lacking: DataFrame | None = None) -> DataFrame:
    """Zone per host from its unzoned timestamps in both tables; only of ``lacking`` (host) where given."""
    zones = instants.zone_names(hosts)
    host = identity.host_key(F.col("host_name")).alias("host")
    rows = read(spark, d, "syslog_records").select(host, F.col("syslog_timestamp").alias("ts"), "received_at").unionByName(
        read(spark, d, "samples").select(host, F.col("sample_timestamp").alias("ts"), "received_at"))
    if lacking is not None:
        rows = join_sized(rows, lacking, ["host"])
    return instants.estimate_zones(rows, "ts", "received_at", "host", zones)


def _hosts(spark: SparkSession, d: str) -> DataFrame:
    """hosts, with an estimated zone for those that have none."""
    hosts = read(spark, d, "hosts")
    lacking = hosts.where("tz_name is null").select(identity.host_key(F.col("host_name")).alias("host")).distinct()
    if lacking.isEmpty() or hosts.where("tz_name is not null").isEmpty():
        return hosts
    return materialise(instants.fill_zones(hosts, materialise(_estimates(spark, d, hosts, lacking)), "host"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Resolvable timestamps that aren't in their normal form, with their instant."""
    return _instants(spark, d, _hosts(spark, d))


def p2_estimated(spark: SparkSession, d: str) -> DataFrame:
    """The same conversion with no zone given: every host's comes from its own unzoned timestamps."""
    hosts = read(spark, d, "hosts")
    blank = hosts.select("host_name", F.lit(None).cast("string").alias("tz_name"))
    return _instants(spark, d, materialise(instants.fill_zones(blank, materialise(_estimates(spark, d, hosts)), "host")))


def _instants(spark: SparkSession, d: str, hosts: DataFrame) -> DataFrame:
    syslog = read(spark, d, "syslog_records", spread=True).where(~F.col("syslog_timestamp").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$"))
    samples = read(spark, d, "samples", spread=True).where(~F.col("sample_timestamp").rlike(r"^\d{13}$"))
    points = read(spark, d, "metric_points").where((F.col("point_timestamp") < identity.FIRST_S) | (F.col("point_timestamp") >= identity.END_S))
    parts = [
        instants.normalise(syslog.select("record_id", "syslog_timestamp", "received_at", "host_name"), "syslog_timestamp", "received_at", "host_name", hosts)
        .select(F.lit("syslog").alias("origin"), F.col("record_id").alias("row_id"), "utc_us"),
        instants.normalise_numbers(points.select("point_id", "point_timestamp"), "point_timestamp").select(F.lit("points").alias("origin"), F.col("point_id").alias("row_id"), "utc_us"),
        instants.normalise(samples.select("sample_id", "sample_timestamp", "received_at", "host_name"), "sample_timestamp", "received_at", "host_name", hosts)
        .select(F.lit("samples").alias("origin"), F.col("sample_id").alias("row_id"), "utc_us"),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).where("utc_us is not null")


def p2_zones(spark: SparkSession, d: str) -> DataFrame:
    """Zone estimated per host from its unzoned timestamps, beside the table's zone."""
    hosts = read(spark, d, "hosts")
    est = _estimates(spark, d, hosts)
    return join_sized(est, hosts.select(F.col("host_name").alias("host"), F.col("tz_name").alias("known_tz")), ["host"], "left").select("host", "tz_name", "known_tz", "n", "violations")


def _series_readings(spark: SparkSession, d: str) -> DataFrame:
    series = identity.series_table(read(spark, d, "metric_series"))
    keys = ["series_h", "metric_key", "host_key", "tag_set"]
    r = identity.readings(read(spark, d, "metric_points"))
    # the hash routes, the three columns decide
    small = series.select(*keys, "series_id", "interval_s", "unit").withColumnsRenamed({k: f"s_{k}" for k in keys[1:]})
    j = join_sized(r, small, ["series_h"])
    return j.where("metric_key <=> s_metric_key and host_key <=> s_host_key and tag_set = s_tag_set").select("point_id", "series_id", "interval_s", "unit", "metric_key", "series_h", "ns", "value")


def p3_grid(spark: SparkSession, d: str) -> DataFrame:
    """Every slot of the grid with its smoothed value, its uncertainty and its mark."""
    return regular_grid.regular_grid(_series_readings(spark, d).select("series_id", "interval_s", "ns", "value"))


def p3_marks(spark: SparkSession, d: str) -> DataFrame:
    """Slots of every series and day: how many, how many without a reading, readings, and whether every value and deviation is a number."""
    g = p3_grid(spark, d).groupBy("series_id", F.expr("slot_start div 86400").alias("day_no"))
    fine = F.bool_and(F.col("value").isNotNull() & ~F.isnan("value") & (F.col("stddev") >= 0))
    return g.agg(F.count("*").alias("slots"), F.count_if("missing").alias("gaps"), F.sum("n").alias("readings"), fine.alias("filled"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Slots without a usable reading between the first and the last of a day."""
    return p3_grid(spark, d).where("missing").select("series_id", "slot_start")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """One row per log entry with its number of lines and its header's fields."""
    e = log_entries.entries(read(spark, d, "syslog_lines", spread=True))
    return e.select("head_line_id", "n_lines", "host_name", "syslog_tag", "process_pid", "syslog_msgid", "severity")


def p6_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries with timestamp and whole message too."""
    return log_entries.entries(read(spark, d, "syslog_lines", spread=True), with_message=True)


def _messages(spark: SparkSession, d: str) -> DataFrame:
    return identity.with_exact_series(identity.readings(read(spark, d, "metric_points")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Copies of messages beside the one that is kept."""
    return exactly_once.copies(_messages(spark, d), MESSAGE, "point_id")


def p7_ledger(spark: SparkSession, d: str) -> DataFrame:
    """The table delivered as two batches, the first of them twice: rows admitted by each, and bits set in the end."""
    points = read(spark, d, "metric_points")
    middle = points.agg(F.expr("min(batch_id) + (max(batch_id) - min(batch_id)) div 2")).first()[0]
    m = identity.with_exact_series(identity.readings(points, "batch_id"))
    ledger, out = scratch(spark), []
    for step, (name, rows) in enumerate([("first", m.where(F.col("batch_id") <= middle)), ("rest", m.where(F.col("batch_id") > middle)), ("first", m.where(F.col("batch_id") <= middle)), ("whole", m)]):
        admitted = exactly_once.apply_batch(rows, MESSAGE, "point_id", ledger, name)
        out.append(admitted.agg(F.lit(step).alias("step"), F.lit(name).alias("batch"), F.count("*").alias("rows"), F.min("point_id").alias("first_id")))
    bits = exactly_once.bitmaps(spark, ledger).agg(F.lit(len(out)).alias("step"), F.lit("bits").alias("batch"), F.sum(F.bitmap_count("bitmap")).alias("rows"), F.lit(None).cast("bigint").alias("first_id"))
    for o in out[::-1]:
        bits = bits.unionByName(o)
    return bits


QUERIES = {f.__name__: f for f in (p1_found, p1_totals, p1_corrections, p2_found, p2_zones, p2_estimated, p3_found, p3_marks, p3_grid, p6_found, p6_entries, p7_found, p7_ledger)}

_FIRST = """with a as (select log_id, service_name, event_timestamp e, case when observed_timestamp <> 0 then observed_timestamp else epoch_us(received_at)*1000 end arrival from log_records where event_timestamp <> 0),
f as (select log_id, arg_min(service_name, arrival) service_name, min(arrival) arrival, arg_min(e, arrival) e from a group by 1),
g as (select *, (e//3600000000000 + 1)*3600000000000 period_end from f), h as (select *, arrival - period_end lag from g)"""
_HOST = "nullif(split_part(trim(lower(host_name)), '.', 1), '')"
_NS = "case when point_timestamp < 100000000000 then point_timestamp*1000000000 when point_timestamp < 100000000000000 then point_timestamp*1000000 when point_timestamp < 100000000000000000 then point_timestamp*1000 else point_timestamp end"
_READINGS = f"""r as (select point_id, trim(lower(metric)) m, {_HOST} h, list_sort(list_distinct(tags)) t, {_NS} ns, point_value v from metric_points where point_value is not null and isfinite(point_value) and flags & 1 = 0),
s as (select series_id, interval_s, unit, trim(lower(metric)) m, {_HOST} h, list_sort(list_distinct(tags)) t from metric_series)"""

_MON = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_CLOCK, _FRAC, _OFF = r"(\d\d):(\d\d):(\d\d)", r"(?:[.,](\d+))?", r"\s*(Z|[+-]\d\d:?\d\d|[A-Z]{2,5})?"
#: pattern -> positions of year, month, day, hour, minute, second, fraction, half, zone
_SPELLINGS = [
    (rf"^(\d{{4}})[-/](\d\d)[-/](\d\d)[T ]{_CLOCK}{_FRAC}{_OFF}$", (1, 2, 3, 4, 5, 6, 7, 0, 8)), (rf"^\*?{_MON} +(\d{{1,2}}) {_CLOCK}{_FRAC}{_OFF}$", (0, 1, 2, 3, 4, 5, 6, 0, 7)),
    (rf"^\*?{_MON} +(\d{{1,2}}) (\d{{4}}) {_CLOCK}{_FRAC}{_OFF}$", (3, 1, 2, 4, 5, 6, 7, 0, 8)), (rf"^(\d{{1,2}})[/-]{_MON}[/-](\d{{4}})[: ]{_CLOCK}{_FRAC}(?: ([AP]M))?{_OFF}$", (3, 2, 1, 4, 5, 6, 7, 8, 9)),
    (rf"^(?:[A-Z][a-z]{{2}}, )?(\d{{1,2}}) {_MON} (\d{{4}}) {_CLOCK}{_FRAC}{_OFF}$", (3, 2, 1, 4, 5, 6, 7, 0, 8)), (r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:?\d\d)?$", (1, 2, 3, 4, 5, 6, 7, 0, 8)),
]
_READ = " union all ".join(
    "select origin, row_id, rcv, tz, " + ", ".join(f"regexp_extract(t, '{p}', {g}) {c}" if g else f"'' {c}" for c, g in zip(("y", "mo", "d", "h", "mi", "s", "f", "half", "z"), at, strict=True)) + f" from raw where regexp_matches(t, '{p}')" for p, at in _SPELLINGS)
_P2 = rf"""with zoned as (select lower(split_part(trim(host_name), '.', 1)) h, tz_name tz from hosts),
raw as (select origin, row_id, trim(t, e' \t\r\n') t, epoch_us(received_at) rcv, tz from (
 select 'syslog' origin, record_id row_id, syslog_timestamp t, received_at, {_HOST} h from syslog_records where not regexp_matches(syslog_timestamp, '^\d{{4}}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?Z$')
 union all select 'samples', sample_id, sample_timestamp, received_at, {_HOST} from samples where not regexp_matches(sample_timestamp, '^\d{{13}}$')) left join zoned using (h)),
numbers as (select origin, row_id, try_cast(t as decimal(38,9)) v from raw where regexp_matches(t, '^[+]?\d+(\.\d+)?([eE][+]?\d+)?$')
 union all select 'points', point_id, point_timestamp from metric_points where point_timestamp not between 1704067200 and 1798761599),
plain as (select origin, row_id, case when v < 100000000000 then cast(floor(v*1000000) as bigint) when v < 100000000000000 then cast(floor(v*1000) as bigint) when v < 100000000000000000 then cast(floor(v) as bigint) else cast(floor(v) as bigint)//1000 end utc_us from numbers),
parts as ({_READ}),
dated as (select origin, row_id, rcv, tz, z, case when half = '' then h::int when h::int between 1 and 12 then h::int % 12 + case when half = 'PM' then 12 else 0 end end h, mi::int mi, s::int s, rpad(f, 6, '0')[1:6]::bigint f, d::int d,
 coalesce(list_position(['Jan', 'Feb', 'Mar', 'Apr', 'May', 'Jun', 'Jul', 'Aug', 'Sep', 'Oct', 'Nov', 'Dec'], mo), try_cast(mo as int)) mo, unnest(case when y = '' then [year(make_timestamp(rcv)) - 1, year(make_timestamp(rcv)), year(make_timestamp(rcv)) + 1] else [y::bigint] end) y from parts),
walls as (select origin, row_id, rcv, tz, z, epoch_us(try_strptime(printf('%04d-%02d-%02d', y, mo, d), '%Y-%m-%d')) + ((h*60 + mi)*60 + s)*1000000::bigint + f wall from dated where h < 24 and mi < 60 and s < 60),
named(abbr, secs) as (values ('EST', -18000), ('EDT', -14400), ('MST', -25200), ('MDT', -21600), ('CET', 3600), ('CEST', 7200), ('WET', 0), ('WEST', 3600), ('JST', 32400), ('IST', 19800), ('AEST', 36000), ('AEDT', 39600), ('NST', -12600), ('NDT', -9000), ('UTC', 0), ('GMT', 0), ('Z', 0), ('UT', 0)),
shifts as (select *, epoch_us(timezone(tz, timezone('UTC', make_timestamp(wall - 86400000000)))) - (wall - 86400000000) before, epoch_us(timezone(tz, timezone('UTC', make_timestamp(wall + 86400000000)))) - (wall + 86400000000) after from walls where wall is not null),
tried as (select *, epoch_us(timezone(tz, timezone('UTC', make_timestamp(wall - before)))) = wall ok_before, epoch_us(timezone(tz, timezone('UTC', make_timestamp(wall - after)))) = wall ok_after from shifts),
found as (select origin, row_id, rcv, case when regexp_matches(z, '^[+-]') then wall - (case when z[1] = '-' then -1 else 1 end)*(replace(z, ':', '')[2:3]::int*3600 + replace(z, ':', '')[4:5]::int*60)*1000000::bigint else wall - secs*1000000::bigint end u
  from walls left join named on z = abbr where z <> '' and wall is not null and (regexp_matches(z, '^[+-]') or z in ('UTC', 'GMT', 'Z', 'UT') or tz is null or secs in (select (epoch_us(timezone(tz, timezone('UTC', m))) - epoch_us(m)) // 1000000 from (values (timestamp '2025-01-15'), (timestamp '2025-07-15')) w(m)))
 union all select origin, row_id, rcv, wall - before from tried where z = '' and (ok_before or not ok_after) union all select origin, row_id, rcv, wall - after from tried where z = '' and ok_after)
select origin, row_id, utc_us from plain where utc_us >= 1704067200000000 and utc_us < 1798761600000000 union all select origin, row_id, arg_min(u, (abs(u - rcv), u)) from found where u is not null group by origin, row_id"""

_ENTRIES = r"""with l as (select *, case when regexp_matches(raw_line, '^(\d+ )?<\d{1,3}>\d{1,2} \d{4}-') then 's5' when regexp_matches(raw_line, '^(\d+ )?<\d{1,3}>[A-Z][a-z]{2} [ \d]\d \d\d:') then 's3'
 when regexp_matches(raw_line, '^ts=\d{4}-') then 'kv' when regexp_matches(raw_line, '^\{"time":"') then 'js' when regexp_matches(raw_line, '^\[\d\d/[A-Z][a-z]{2}/\d{4}:') then 'br'
 when regexp_matches(raw_line, '^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d,\d+ ') then 'dt' when regexp_matches(raw_line, '^[TDIWEF]\d{4} \d\d:\d\d:\d\d') then 'gl' end k from syslog_lines),
h as (select *, last_value(case when k is not null then line_id end ignore nulls) over (partition by stream_id order by line_no, line_id) head from l),
c as (select head, count(*) n from h where head is not null group by 1),
m as (select line_id, k, raw_line r, cast(nullif(regexp_extract(raw_line, '^(?:\d+ )?<(\d+)>', 1), '') as int) % 8 code from l where k is not null),
f as (select line_id, k, code,
 case k when 's5' then regexp_extract(r, '^(?:\d+ )?<\d+>\d+ \S+ (\S+) ', 1) when 's3' then regexp_extract(r, '^(?:\d+ )?<\d+>[A-Z][a-z]{2} [ \d]\d [\d:]+ ([^ :\[]+) [^ :\[]+[:\[]', 1) when 'kv' then regexp_extract(r, ' host=(\S+)', 1) when 'js' then regexp_extract(r, '"host":"([^"]*)"', 1) else '' end host,
 case k when 's5' then regexp_extract(r, '^(?:\d+ )?<\d+>\d+ \S+ \S+ (\S+) ', 1) when 's3' then regexp_extract(r, '^(?:\d+ )?<\d+>[A-Z][a-z]{2} [ \d]\d [\d:]+ (?:[^ :\[]+ )?([^ :\[]+)[:\[]', 1) when 'kv' then regexp_extract(r, ' component=(\S+)', 1) when 'js' then regexp_extract(r, '"logger":"([^"]*)"', 1)
  when 'br' then regexp_extract(r, '^\[[^\]]*\] \[([^\]]*):[^:\]]*\]', 1) when 'dt' then regexp_extract(r, '^[^\[]{24}(?:\x1b\[\d+m)?\w+(?:\x1b\[0m)? *\[([^\]]*)\]', 1) else regexp_extract(r, '^\S+ \S+ +\S+ ([^\]]*)\]', 1) end tag,
 case k when 's5' then regexp_extract(r, '^(?:\d+ )?<\d+>\d+ \S+ \S+ \S+ (\S+) ', 1) when 's3' then regexp_extract(r, '^(?:\d+ )?<\d+>[A-Z][a-z]{2} [ \d]\d [\d:]+ (?:[^ :\[]+ )?[^ :\[]+\[([^\]]*)\]', 1) when 'kv' then regexp_extract(r, ' pid=(\S+)', 1) when 'js' then regexp_extract(r, '"pid":"?([^",}]*)', 1)
  when 'gl' then regexp_extract(r, '^\S+ \S+ +(\S+) ', 1) else regexp_extract(r, '[\[(]pid ([^\])]*)[\])]', 1) end pid,
 case k when 's5' then regexp_extract(r, '^(?:\d+ )?<\d+>\d+ \S+ \S+ \S+ \S+ (\S+) ', 1) else '' end msgid,
 lower(case k when 'kv' then regexp_extract(r, ' level=(\S+)', 1) when 'js' then regexp_extract(r, '"level":"([^"]*)"', 1) when 'br' then regexp_extract(r, '^\[[^\]]*\] \[[^\]]*:([^:\]]*)\]', 1) when 'dt' then regexp_extract(r, '^[\d-]+ [\d:,]+ (?:\x1b\[\d+m)?(\w+)', 1) when 'gl' then r[1] else '' end) lvl from m)"""

SQL = {
    "p2_found": _P2,
    "p1_found": _FIRST + " select log_id, case when lag > 86400000000000 then 'dropped' else 'late' end outcome from h where lag > 600000000000",
    "p1_totals": _FIRST + " select make_timestamp((period_end - 3600000000000)//1000) period, service_name, count(*) filter (lag <= 86400000000000) n, count(*) filter (lag > 86400000000000) dropped from h group by all",
    "p1_corrections": _FIRST + """, c as (select period_end//3600000000000 - 1 period_no, service_name, arrival//3600000000000 seq, count(*) filter (lag <= 86400000000000) n, count(*) filter (lag > 86400000000000) dropped from h group by all)
select period_no, service_name, seq, cast(sum(n) over w as bigint) n, cast(sum(dropped) over w as bigint) dropped from c window w as (partition by period_no, service_name order by seq)""",
    "p3_found": f"""with {_READINGS}, d as (select distinct series_id, interval_s, (ns//1000000000)//interval_s*interval_s slot from r join s using (m, h, t)),
g as (select series_id, interval_s, min(slot) a, max(slot) b from d group by series_id, interval_s, slot//86400), e as (select series_id, unnest(range(a, b + 1, interval_s)) slot_start from g)
select e.series_id, e.slot_start from e left join d on d.series_id = e.series_id and d.slot = e.slot_start where d.slot is null""",
    "p3_marks": f"""with {_READINGS}, q as (select series_id, interval_s, (ns//1000000000)//interval_s*interval_s slot from r join s using (m, h, t)),
x as (select series_id, interval_s, slot//86400 day_no, min(slot) a, max(slot) b, count(distinct slot) held, count(*) readings from q group by all)
select series_id, day_no, (b - a)//interval_s + 1 slots, (b - a)//interval_s + 1 - held gaps, readings, true filled from x""",
    "p7_found": f"with {_READINGS}, k as (select point_id, min(point_id) over (partition by m, h, t, ns, v) kept_id from r) select kept_id, point_id copy_id from k where point_id <> kept_id",
    "p7_ledger": f"""with {_READINGS.replace("select point_id,", "select point_id, batch_id,", 1)}, mid as (select min(batch_id) + (max(batch_id) - min(batch_id))//2 b from metric_points),
x as (select m, h, t, ns, v, min(point_id) filter (batch_id <= b) one, min(point_id) filter (batch_id > b) two from r, mid group by all),
y as (select count(one) n1, min(one) f1, count(*) filter (one is null) n2, min(two) filter (one is null) f2, count(*) n from x)
select 0::int step, 'first' batch, n1 "rows", f1 first_id from y union all select 1, 'rest', n2, f2 from y union all select 2, 'first', n1, f1 from y union all select 3, 'whole', 0, null from y union all select 4, 'bits', n, null from y""",
    "p6_found": _ENTRIES + r"""
select head head_line_id, n n_lines, case when host = '-' then '' else host end host_name, case when tag = '-' then '' else tag end syslog_tag, case when pid = '-' then '' else pid end process_pid, case when msgid = '-' then '' else msgid end syslog_msgid,
case when k in ('s3', 's5') then case when code <= 2 then 'fatal' when code = 3 then 'error' when code = 4 then 'warn' when code <= 6 then 'info' else 'debug' end
 when lvl in ('trace', 't') then 'trace' when lvl in ('debug', 'dbg', 'd') then 'debug' when lvl in ('info', 'notice', 'i') then 'info' when lvl in ('warn', 'warning', 'w') then 'warn' when lvl in ('err', 'error', 'severe', 'e') then 'error' when lvl in ('crit', 'panic', 'fatal', 'f') then 'fatal' else '' end severity
from c join f on head = line_id""",
    "p6_entries": _ENTRIES + r""",
w as (select line_id, case k when 's5' then regexp_extract(r, '^(?:\d+ )?<\d+>\d+ \S+ \S+ \S+ \S+ \S+ (?:-|(?:\[(?:[^\]"]|"(?:[^"\\]|\\.)*")*\])+)?[ \t]*(.*)$', 1) when 's3' then regexp_extract(r, '^(?:\d+ )?<\d+>[A-Z][a-z]{2} [ \d]\d [\d:]+ (?:[^ :\[]+ )?[^ :\[]+(?:\[[^\]]*\])?:?[ \t]*(.*)$', 1)
  when 'br' then regexp_extract(r, '^\[[^\]]*\] \[[^\]]*\][ \t]*(?:\[pid [^\]]*\][ \t]*)?(.*)$', 1) when 'dt' then regexp_extract(r, '^[\d-]+ [\d:,]+ (?:\x1b\[\d+m)?\w+(?:\x1b\[0m)?[ \t]*\[[^\]]*\][ \t]*(?:\(pid [^)]*\)[ \t]*)?(.*)$', 1)
  when 'gl' then regexp_extract(r, '^\S+ \S+ +\S+ +[^\] ]*\][ \t]*(.*)$', 1) else replace(replace(replace(replace(regexp_extract(r, case k when 'kv' then ' msg="((?:[^"\\]|\\.)*)"' else '"message":"((?:[^"\\]|\\.)*)"' end, 1), '\\', chr(1)), '\"', '"'), '\n', chr(10)), chr(1), '\') end msg,
 case k when 's5' then regexp_extract(r, '>\d+ (\S+)', 1) when 's3' then regexp_extract(r, '>([A-Z][a-z]{2} [ \d]\d [\d:]+)', 1) when 'kv' then regexp_extract(r, '^ts=(\S+)', 1) when 'js' then regexp_extract(r, '"time":"([^"]*)"', 1) when 'br' then regexp_extract(r, '^\[([^\]]*)\]', 1)
  when 'dt' then regexp_extract(r, '^([\d-]+ [\d:,]+)', 1) else regexp_extract(r, '^.(\S+ \S+)', 1) end stated from m),
t as (select head, string_agg(case when l.line_id = head then rtrim(msg, e'\r\n') else regexp_replace(raw_line, '\r$', '') end, chr(10) order by line_no, l.line_id) message from h l left join w on w.line_id = l.line_id where head is not null and raw_line is not null group by 1)
select head head_line_id, 0 part, n n_lines, stated "timestamp", case when host = '-' then '' else host end host_name, case when tag = '-' then '' else tag end syslog_tag, case when pid = '-' then '' else pid end process_pid, case when msgid = '-' then '' else msgid end syslog_msgid, case when k in ('s3', 's5') then case when code <= 2 then 'fatal' when code = 3 then 'error' when code = 4 then 'warn' when code <= 6 then 'info' else 'debug' end
 when lvl in ('trace', 't') then 'trace' when lvl in ('debug', 'dbg', 'd') then 'debug' when lvl in ('info', 'notice', 'i') then 'info' when lvl in ('warn', 'warning', 'w') then 'warn' when lvl in ('err', 'error', 'severe', 'e') then 'error' when lvl in ('crit', 'panic', 'fatal', 'f') then 'fatal' else '' end severity,
 message
from c join f on head = line_id join w using (line_id) join t using (head)""",
}
