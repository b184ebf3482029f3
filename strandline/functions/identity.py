"""Canonical forms of hosts, series and instants of readings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.shared import materialise

#: Bounds, in Unix seconds, of the years 2024 to 2026, in which all instants lie.
FIRST_S, END_S = 1_704_067_200, 1_798_761_600


def blank_trim(c: Column) -> Column:
    """Without outer blanks (space, tab, line ends)."""
    return F.btrim(c, F.lit(" \t\r\n"))


def host_key(c: Column) -> Column:
    """Host without outer blanks, in lower case, up to its first dot; empty counts as null."""
    return F.nullif(F.substring_index(F.lower(blank_trim(c)), ".", 1), F.lit(""))


def metric_key(c: Column) -> Column:
    return F.lower(blank_trim(c))


def tag_set(c: Column) -> Column:
    """Tags as a sorted set; null tags and null entries count as none."""
    return F.array_sort(F.array_distinct(F.coalesce(F.array_compact(c), F.array().cast("array<string>"))))


def series_hash(metric: Column, host: Column, tags: Column, seed: int = 0) -> Column:
    """64 bits of (metric, host, tag set); null and empty differ."""
    return F.xxhash64(F.lit(seed), F.coalesce(metric, F.lit("\0")), F.lit("\1"), F.coalesce(host, F.lit("\0")), F.lit("\1"), tags)


def instant_ns(c: Column) -> Column:
    """Unix ns of a BIGINT in s, ms, us or ns, told apart by the years 2024 to 2026; else null."""
    out = F.lit(None).cast("bigint")
    for power in (9, 6, 3, 0):
        unit = 10 ** (9 - power)
        out = F.when((c >= FIRST_S * unit) & (c < END_S * unit), c * F.lit(10**power)).otherwise(out)
    return out


def usable(value: Column, flags: Column) -> Column:
    """Finite, not null, and bit 0 of flags (no recorded value) not set; null flags count as 0."""
    return (
        value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))
        & (F.coalesce(flags, F.lit(0)).bitwiseAND(F.lit(1)) == 0)
    )


def readings(points: DataFrame, *more: str) -> DataFrame:
    """Usable readings as (point_id, more..., series_h, metric_key, host_key, tag_set, ns, value).

    Rows with an unusable value or an instant outside 2024 to 2026 are left out.
    Other columns are dropped, so clashing names do no harm.
    """
    m, h, t = metric_key(F.col("metric")), host_key(F.col("host_name")), tag_set(F.col("tags"))
    return (
        points.where(usable(F.col("point_value"), F.col("flags")))
        .select(
            "point_id", *more, m.alias("metric_key"), h.alias("host_key"), t.alias("tag_set"),
            instant_ns(F.col("point_timestamp")).alias("ns"), (F.col("point_value") + F.lit(0.0)).alias("value"),
        )
        .where("ns is not null")
        .withColumn("series_h", series_hash(F.col("metric_key"), F.col("host_key"), F.col("tag_set")))
    )


def with_exact_series(r: DataFrame) -> DataFrame:
    """readings with ``series_twin``: (series_h, series_twin) names a series exactly.

    The twin is 0 but for series whose 64-bit hash another one shares; they are numbered.
    Series are reduced map-side to one row each; the table of twins is all but always empty.
    """
    keys = ["metric_key", "host_key", "tag_set"]
    twins = r.groupBy("series_h", *keys).agg(F.lit(1).alias("_one")).withColumn("_of", F.count("*").over(W.partitionBy("series_h"))).where("_of > 1")
    twins = twins.withColumn("series_twin", F.row_number().over(W.partitionBy("series_h").orderBy(*keys)) - 1).drop("_one", "_of")
    twins = materialise(twins)
    if twins.isEmpty():
        return r.withColumn("series_twin", F.lit(0))
    b = twins.select(F.col("series_h").alias("_h"), *[F.col(k).alias(f"_{k}") for k in keys], "series_twin")
    on = (F.col("series_h") == F.col("_h")) & F.col("metric_key").eqNullSafe(F.col("_metric_key")) & F.col("host_key").eqNullSafe(F.col("_host_key")) & (F.col("tag_set") == F.col("_tag_set"))
    return r.join(b, on, "left").select(*r.columns, F.coalesce("series_twin", F.lit(0)).alias("series_twin"))


def series_table(series: DataFrame) -> DataFrame:
    """metric_series with the hash that joins it to ``readings``; one row per series."""
    m, h, t = metric_key(F.col("metric")), host_key(F.col("host_name")), tag_set(F.col("tags"))
    return series.select(
        "series_id", m.alias("metric_key"), h.alias("host_key"), t.alias("tag_set"), "unit", "interval_s", series_hash(m, h, t).alias("series_h")
    )
