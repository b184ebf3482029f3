"""Routing: one frame to several named ones. Each part is a filter, so unused parts cost nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import values as V
from strandline.operators import filters

FORWARD = "forward"
MOST_TARGETS = 63


def destinations(routes: list[tuple[object, list[str]]], actual: Column, typed: bool = True) -> Column:
    """Targets of the first route, in order, whose value matches; empty if none does."""
    names = {t for _, ts in routes for t in ts}
    if len(names) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    out = F.array().cast("array<string>")
    for want, targets in reversed(routes):
        hit = V.value_matches(want, actual) if typed else F.coalesce(actual == str(want), F.lit(False))
        out = F.when(hit, F.array(*[F.lit(t) for t in targets])).otherwise(out)
    return out


def route(df: DataFrame, by: str, routes: list[tuple[object, list[str]]], key: str | None = None) -> dict[str, DataFrame]:
    """by: origin, previous, attribute or resource. What matches no route is the part ``forward``."""
    actual = {"origin": F.col("_origin"), "previous": F.col("_previous")}.get(by)
    dest = destinations(routes, actual if actual is not None else F.col("attributes" if by == "attribute" else "resource")[key], actual is None)
    d = df.withColumn("_dest", dest)
    parts = {t: d.where(F.array_contains("_dest", t)).drop("_dest") for t in dict.fromkeys(t for _, ts in routes for t in ts)}
    return parts | {FORWARD: d.where(F.size("_dest") == 0).drop("_dest")}


def route_signals(df: DataFrame, signals: dict[str, str], strip: bool = True) -> dict[str, DataFrame]:
    """signals: payload -> target. ``strip`` sends each target only its payloads, else whole copies."""
    parts = {}
    for target in dict.fromkeys(signals.values()):
        mine = [s for s, t in signals.items() if t == target]
        parts[target] = filters.keep_signals(df, mine) if strip else filters.has_signal(df, mine)
    return parts


def fan_in(*frames: DataFrame) -> DataFrame:
    """Bag union of several sources."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def with_provenance(df: DataFrame, component: str) -> DataFrame:
    """Mark what a component emits: it becomes ``_previous``, and ``_origin`` where there is none yet."""
    origin = F.coalesce("_origin", F.lit(component)) if "_origin" in df.columns else F.lit(component)
    return df.withColumn("_origin", origin).withColumn("_previous", F.lit(component))
