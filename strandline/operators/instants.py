"""Timestamps of mixed formats, precisions and zones as one UTC instant.

A spelling is first brought to fields (date, time, fraction, AM/PM, zone) by the
patterns below. What it leaves open is settled by candidates: the years around the
receipt where it has none, and every offset that the history of its zone allows for
that wall time. Each candidate instant is aligned with the ingestion time and the one
that violates it least, that is lies nearest to it, is taken. So a wall time that
occurs twice is the occurrence nearer to the receipt; one that never occurs is read
with the offset in force before the change.

The zone of a source is looked up. ``estimate_zones`` finds it where it isn't known:
of the offset histories of all candidate zones it takes the one under which the fewest
local times lie after their receipt or implausibly long before it; ``fill_zones`` puts
it in for hosts without a zone, whose times ``normalise`` then converts.

Null, empty and meaningless spellings, numbers outside 2024 to 2026 and impossible
dates give null. Equal rows give equal results; ties between candidates go to the
earlier instant; other columns pass through.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.identity import END_S, FIRST_S, blank_trim, host_key, instant_ns
from strandline.functions.shared import join_sized, micros

MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_MON = "(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_HMS = r"(\d\d):(\d\d):(\d\d)"
_FRAC = r"(?:[.,](\d+))?"
_ZONE = r"\s*(Z|[+-]\d\d:?\d\d|[A-Z]{2,5})?"
#: pattern -> its fields as year|month|day|hour|minute|second|fraction|half|zone
PATTERNS = [
    (rf"^(\d{{4}})[-/](\d\d)[-/](\d\d)[T ]{_HMS}{_FRAC}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8"),
    (rf"^\*?{_MON} +(\d{{1,2}}) {_HMS}{_FRAC}{_ZONE}$", "|$1|$2|$3|$4|$5|$6||$7"),
    (rf"^\*?{_MON} +(\d{{1,2}}) (\d{{4}}) {_HMS}{_FRAC}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7||$8"),
    (rf"^(\d{{1,2}})[/-]{_MON}[/-](\d{{4}})[: ]{_HMS}{_FRAC}(?: ([AP]M))?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    (rf"^(?:[A-Z][a-z]{{2}}, )?(\d{{1,2}}) {_MON} (\d{{4}}) {_HMS}{_FRAC}{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7||$8"),
    (r"^(\d{4})(\d\d)(\d\d)T(\d\d)(\d\d)(\d\d)(?:[.,](\d+))?(Z|[+-]\d\d:?\d\d)?$", "$1|$2|$3|$4|$5|$6|$7||$8"),
]
NUMBER = r"^[+]?\d+(\.\d+)?([eE][+]?\d+)?$"


def number_us(text: Column) -> Column:
    """Unix us of a plain number in s, ms, us or ns, digit-exact; outside 2024 to 2026 null."""
    v = F.when(text.rlike(NUMBER), text).try_cast("decimal(38,9)")
    out = F.lit(None).cast("bigint")
    for power in (6, 3, 0, -3):
        unit = 10 ** (6 - power)
        us = v * F.lit(10**power) if power >= 0 else v / F.lit(1000)
        out = F.when((v >= FIRST_S * unit) & (v < END_S * unit), F.floor(us).cast("bigint")).otherwise(out)
    return out


def zone_names(hosts: DataFrame) -> list[str]:
    """Distinct tz_name that the zone database knows, so at most its some 600 names come to the driver."""
    jvm = hosts.sparkSession.sparkContext._jvm
    every = jvm.java.lang.String.join(" ", jvm.java.time.ZoneId.getAvailableZoneIds()).split()
    return sorted(r[0] for r in hosts.where(F.col("tz_name").isin(every)).select("tz_name").distinct().collect())


def abbreviations(zones: list[str]) -> dict[str, dict[str, int]]:
    """zone -> abbreviation -> offset in seconds, as in force during 2024 to 2026."""
    out: dict[str, dict[str, int]] = {}
    for z in zones:
        try:
            tz = ZoneInfo(z)
        except Exception:  # noqa: BLE001 - an unknown zone name has no abbreviations
            continue
        t = datetime(2024, 1, 1, tzinfo=timezone.utc)
        while t.year < 2027:
            local = t.astimezone(tz)
            out.setdefault(z, {})[local.tzname()] = int(local.utcoffset().total_seconds())
            t += timedelta(days=7)
    return out


def _abbreviation_offset(zones: list[str], zone: Column, abbr: Column) -> Column:
    """Seconds for an abbreviation in its zone; without a zone only where all zones agree."""
    table = abbreviations(zones)
    pairs = {f"{z} {a}": s for z, m in table.items() for a, s in m.items()}
    anywhere: dict[str, set[int]] = {}
    for m in table.values():
        for a, s in m.items():
            anywhere.setdefault(a, set()).add(s)
    pairs |= {f" {a}": s.copy().pop() for a, s in anywhere.items() if len(s) == 1}
    pairs |= {f" {a}": 0 for a in ("Z", "UTC", "GMT", "UT")}
    m = F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])
    return F.coalesce(m[F.concat(zone, F.lit(" "), abbr)], F.when(zone.isNull() | abbr.isin("Z", "UTC", "GMT", "UT"), m[F.concat(F.lit(" "), abbr)]))


def _local_us(year: Column, f: Column) -> Column:
    month = F.when(f[1].rlike("^[A-Z]"), (F.instr(F.lit(MONTHS), f[1]) + 2) / 3).otherwise(f[1].try_cast("int")).cast("int")
    hour = f[3].cast("int")
    hour = F.when(f[7] == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(f[7] == "PM", 12).otherwise(0))
    t = F.try_make_timestamp(year, month, f[2].cast("int"), hour, f[4].cast("int"), f[5].cast("int").cast("decimal(16,6)"))
    frac = F.rpad(F.substring(f[6], 1, 6), 6, "0").cast("bigint")
    return F.unix_micros(t) + frac


def zoned_candidates(local_us: Column, zone: Column) -> Column:
    """Instants (us) of a wall time in a zone: two where it occurs twice, else one."""
    at = F.timestamp_micros(local_us)
    first = F.to_utc_timestamp(at, zone)
    next_day = first + F.expr("interval 1 day")
    after = local_us - (F.unix_micros(F.from_utc_timestamp(next_day, zone)) - F.unix_micros(next_day))
    again = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(after), zone)) == local_us
    return F.array(F.unix_micros(first), F.when(again, after).otherwise(F.unix_micros(first)))


def _fields(t: Column) -> Column:
    """Fields of a trimmed spelling by the first pattern that fits; null for plain numbers and where none does."""
    parts = F.lit(None).cast("string")
    for pattern, to in reversed(PATTERNS):
        parts = F.when(t.rlike(pattern), F.regexp_replace(t, F.lit(pattern), F.lit(to))).otherwise(parts)
    return F.split(F.when(~t.rlike(NUMBER), parts), r"\|")


def _years(f: Column, rcv: Column) -> Column:
    """The stated year, or those around the receipt where none is."""
    near = F.year(F.timestamp_micros(rcv))
    return F.when(f[0] == "", F.array(near - 1, near, near + 1)).otherwise(F.array(f[0].try_cast("int")))


def normalise(df: DataFrame, text: str, received: str, host: str, hosts: DataFrame, out: str = "utc_us") -> DataFrame:
    """df with ``out``: the instant of ``text`` in Unix us (finer digits cut off), or null.

    ``hosts`` gives the zone of each host (host_name, tz_name); its names are unique. A
    name that the zone database lacks is no zone.
    """
    zones = zone_names(hosts)
    table = hosts.where(F.col("tz_name").isin(zones)).select(host_key(F.col("host_name")).alias("_host"), F.col("tz_name").alias("_tz")).where("_host is not null").dropDuplicates(["_host"])
    d = df.withColumn("_host", host_key(F.col(host))).withColumn("_t", blank_trim(F.col(text)))
    d = join_sized(d, table, ["_host"], "left")
    d = d.withColumn("_f", _fields(F.col("_t"))).withColumn("_rcv", micros(received))
    f, rcv, tz = F.col("_f"), F.col("_rcv"), F.col("_tz")
    zone = f[8]
    signed = zone.rlike("^[+-]")
    digits = F.translate(F.substring(zone, 2, 5), ":", "")
    fixed = F.when(
        signed, (F.substring(digits, 1, 2).try_cast("int") * 3600 + F.substring(digits, 3, 2).try_cast("int") * 60) * F.when(zone.startswith("-"), -1).otherwise(1)
    ).when(zone != "", _abbreviation_offset(zones or ["UTC"], tz, zone))
    d = d.withColumn("_fixed", fixed).withColumn("_years", _years(f, rcv))
    local = F.transform("_years", lambda y: _local_us(y, f))
    instants = F.when(F.col("_fixed").isNotNull(), F.transform(local, lambda u: u - F.col("_fixed") * F.lit(1_000_000).cast("bigint"))).when(
        (zone == "") & tz.isNotNull(), F.flatten(F.transform(local, lambda u: zoned_candidates(u, tz)))
    )
    best = F.array_min(F.transform(F.array_compact(instants), lambda u: F.struct(F.coalesce(F.abs(u - rcv), F.lit(0)).alias("d"), u.alias("u"))))["u"]
    return d.withColumn(out, F.coalesce(number_us(F.col("_t")), best)).drop("_host", "_t", "_tz", "_f", "_rcv", "_fixed", "_years")


def normalise_numbers(df: DataFrame, number: str, out: str = "utc_us") -> DataFrame:
    """df with ``out`` for BIGINT Unix times in s, ms, us or ns; finer digits are cut off."""
    # whole-number division: as doubles, values of 19 digits would lose their last ones
    return df.withColumn("_ns", instant_ns(F.col(number))).withColumn(out, F.expr("_ns div 1000")).drop("_ns")


def estimate_zones(df: DataFrame, text: str, received: str, source: str, zones: list[str], ahead_s: int = 120, behind_s: int = 3600) -> DataFrame:
    """(source, tz_name, n, violations): the zone whose offset history fits best per source.

    Uses all spellings without zone; of those without a year, the year nearest to the
    receipt. A violation is an instant more than ``ahead_s`` after its receipt or
    ``behind_s`` before it, in whole minutes. Ties go to the smaller total distance, then
    to the name. Rows without receipt tell nothing and aren't counted.

    Rows are first counted by source, quarter of an hour of the local time (no offset
    changes within one) and distance to the receipt in minutes; only these counts, whose
    number doesn't grow with repeated readings, meet the candidate zones.
    """
    quarter, minute = 900_000_000, 60_000_000
    d = df.select(F.col(source).alias("_s"), _fields(blank_trim(F.col(text))).alias("_f"), micros(received).alias("_rcv")).where("coalesce(_f[8] = '', false) and _s is not null and _rcv is not null")
    f, rcv = F.col("_f"), F.col("_rcv")
    d = d.withColumn("_local", F.array_compact(F.transform(_years(f, rcv), lambda y: _local_us(y, f))))
    # impossible dates have no quarter: a filter here would be pushed down and parse again
    local = F.transform("_local", lambda u: F.struct((u - F.pmod(u, F.lit(quarter))).alias("q"), F.round((u - rcv) / minute).cast("bigint").alias("m")))
    d = d.select("_s", local.alias("_local")).groupBy("_s", "_local").agg(F.count("*").alias("_n"))
    d = d.select("_s", "_local", "_n", F.explode(F.array(*[F.lit(z) for z in zones])).alias("tz_name"))
    gaps = F.flatten(F.transform("_local", lambda x: F.transform(zoned_candidates(x["q"], F.col("tz_name")), lambda i: x["m"] + F.round((i - x["q"]) / minute).cast("bigint"))))
    gap = F.array_min(F.transform(gaps, lambda g: F.struct(F.abs(g).alias("d"), g.alias("g"))))["g"]
    d = d.withColumn("_g", gap).where("_g is not null").withColumn("_bad", F.when((F.col("_g") > ahead_s // 60) | (F.col("_g") < -behind_s // 60), F.col("_n")).otherwise(0))
    sums = d.groupBy("_s", "tz_name").agg(F.sum("_n").alias("n"), F.sum("_bad").alias("violations"), F.sum(F.abs("_g") * F.col("_n")).alias("_far"))
    return sums.groupBy(F.col("_s").alias(source)).agg(F.min(F.struct("violations", "_far", "tz_name", "n")).alias("m")).select(source, "m.tz_name", "m.n", "m.violations")


def fill_zones(hosts: DataFrame, estimates: DataFrame, source: str) -> DataFrame:
    """(host_name, tz_name) of ``hosts``, with the zone of ``estimates`` (by ``source``, a host key) where it has none."""
    e = estimates.select(F.col(source).alias("_s"), F.col("tz_name").alias("_e"))
    return join_sized(hosts.select("host_name", "tz_name", host_key(F.col("host_name")).alias("_s")), e, ["_s"], "left").select("host_name", F.coalesce("tz_name", "_e").alias("tz_name"))
