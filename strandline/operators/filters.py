"""Predicates over events. A has_ and its drop_ form split every event set in two: null never counts as a match."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import hashing
from strandline.functions import values as V

SIGNALS = ("logs", "metrics", "traces", "none")


def carries(signal: str) -> Column:
    """Whether an event has the payload; ``none`` means it has none at all."""
    log, metrics, span = F.col("log").isNotNull(), F.coalesce(F.size("metrics") > 0, F.lit(False)), F.col("span").isNotNull()
    return {"logs": log, "metrics": metrics, "traces": span, "none": ~(log | metrics | span)}[signal]


def attributes_match(attributes: dict[str, object] | None = None, resource: dict[str, object] | None = None, present: list[str] = (), resource_present: list[str] = ()) -> Column:
    """Conjunction of key = value and of keys that are there (null counts as there)."""
    hit = F.lit(True)
    for where, wants, keys in (("attributes", attributes, present), ("resource", resource, resource_present)):
        for k, v in (wants or {}).items():
            hit = hit & V.value_matches(v, F.col(where)[k])
        for k in keys:
            hit = hit & F.coalesce(F.map_contains_key(F.col(where), F.lit(k)), F.lit(False))
    return hit


def has_attributes(df: DataFrame, **want) -> DataFrame:  # noqa: ANN003
    return df.where(attributes_match(**want))


def drop_attributes(df: DataFrame, **want) -> DataFrame:  # noqa: ANN003
    return df.where(~attributes_match(**want))


def _provenance(origin: list[str], previous: list[str]) -> Column:
    hit = F.lit(True)
    for c, names in (("_origin", origin), ("_previous", previous)):
        if names:
            hit = hit & F.coalesce(F.col(c).isin(list(names)), F.lit(False))
    return hit & (F.col("_origin").isNotNull() | F.col("_previous").isNotNull())


def has_provenance(df: DataFrame, origin: list[str] = (), previous: list[str] = ()) -> DataFrame:
    """Any of a list, all of the lists; without provenance nothing matches."""
    return df.where(_provenance(origin, previous))


def drop_provenance(df: DataFrame, origin: list[str] = (), previous: list[str] = ()) -> DataFrame:
    return df.where(~_provenance(origin, previous))


def has_signal(df: DataFrame, signals: list[str], mode: str = "any_of") -> DataFrame:
    """Whole events that carry a listed payload; ``only`` also asks that they carry no other."""
    hit = F.lit(False)
    for s in signals:
        hit = hit | carries(s)
    if mode == "only":
        for s in ("logs", "metrics", "traces"):
            if s not in signals:
                hit = hit & ~carries(s)
    return df.where(hit)


def keep_signals(df: DataFrame, signals: list[str]) -> DataFrame:
    """Clear all other payloads and drop what is emptied; ``none`` lets events pass that arrived empty."""
    d = df.withColumn("_empty", carries("none"))
    for s, c in (("logs", "log"), ("metrics", "metrics"), ("traces", "span")):
        if s not in signals:
            d = d.withColumn(c, F.lit(None).cast(df.schema[c].dataType))
    stays = F.when(F.col("_empty"), F.lit("none" in signals)).otherwise(~carries("none"))
    return d.where(stays).drop("_empty")


def drop_signals(df: DataFrame, signals: list[str]) -> DataFrame:
    return keep_signals(df, [s for s in ("logs", "metrics", "traces") if s not in signals])


def is_stale(now_ns: Column | int, max_age_ns: int, max_ahead_ns: int | None = None) -> Column:
    """By span end, else by time; 0 is unknown and never stale; strictly older than max_age, or further ahead than max_ahead."""
    end = F.coalesce(F.col("span.end_ns"), F.lit(0))
    at = F.when(end != 0, end).otherwise(F.coalesce(F.col("ts_ns"), F.lit(0)))
    now = F.lit(now_ns) if isinstance(now_ns, int) else now_ns
    old = (now - at) > max_age_ns
    return (at != 0) & ((old | ((at - now) > max_ahead_ns)) if max_ahead_ns is not None else old)


def has_stale(df: DataFrame, now_ns: Column | int, max_age_ns: int, max_ahead_ns: int | None = None) -> DataFrame:
    return df.where(is_stale(now_ns, max_age_ns, max_ahead_ns))


def drop_stale(df: DataFrame, now_ns: Column | int, max_age_ns: int, max_ahead_ns: int | None = None) -> DataFrame:
    return df.where(~is_stale(now_ns, max_age_ns, max_ahead_ns))


def sample(df: DataFrame, rate: float, key: str | None = None, source: str = "attribute", missing: str = "random", always_keep: dict[str, object] | None = None, seed: int = 0) -> DataFrame:
    """Keep a share of events, the same for equal keys in every process.

    source: ``attribute``, ``resource`` or ``trace_id``. ``always_keep`` comes first;
    events without key are kept, dropped, or hashed by arrival number and seed.
    """
    if source == "trace_id":
        h = hashing.xxh64(F.lower(F.coalesce(F.col("log.trace_id"), F.col("span.trace_id"))))
    elif key:
        h = hashing.hash_value(F.col("attributes" if source == "attribute" else "resource")[key])
    else:
        h, missing = F.lit(None).cast("bigint"), "random"
    by_number = hashing.keep(hashing.xxh64(F.col("_seq").bitwiseXOR(F.lit(seed).cast("bigint")).cast("string")), rate)
    other = {"keep": F.lit(True), "drop": F.lit(False), "random": by_number}[missing]
    hit = F.when(h.isNotNull(), hashing.keep(h, rate)).otherwise(other)
    if always_keep:
        hit = attributes_match(always_keep) | hit
    return df.where(hit)
