"""Per-period aggregates of events that arrive late and out of order.

State is a grow-only counter. Each delivered record is a *dot*: its identifier, which
its source gave out in sequence, with the earliest arrival seen as its version, merged
by keeping the better one, so a redelivery can only repeat or lower it. Every batch has
a state of its own; states of any batches merge (``merge_dots``), however a source's
records and a record's copies are split over them. Periods past the cut-off are closed
(``close``) and keep totals and identifiers only. A *version* of a source is its number
of dots of a period that had arrived by a sequence point, derived from the merged dots;
the value of a period is the sum over sources of their latest version. A count doesn't
tell which dots it holds, so versions of different dots can't be merged: ``merge`` takes
copies of one state and fails on others. Merging is commutative, associative and
idempotent: retries, reordering and a second run over the same batch change nothing.

Nulls: a null identifier is no record and is left out; a null or 0 event time has no
period and is left out of every count; a null group or source is a group of its own; a
null arrival falls back to ``received``. Ties of arrival are one and the same value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.shared import micros

HOUR_NS = 3_600_000_000_000
GRACE_NS = 600_000_000_000
CUTOFF_NS = 24 * HOUR_NS


def arrival_ns(observed: Column, received: Column) -> Column:
    """observed (Unix ns), or received where that is 0 or null."""
    return F.when(F.coalesce(observed, F.lit(0)) != 0, observed).otherwise(micros(received) * 1000)


def dots(deliveries: DataFrame, *, key: str, event: str, observed: str, received: str, group: list[str], source: str, period_ns: int = HOUR_NS, batch: str | None = None) -> DataFrame:
    """One row per record: key, group columns, source, arrival (ns), period_end (ns).

    Group, source and event time are those of the earliest arrival (ties: the smallest).
    With ``batch`` there is one row per batch and record: the state of each batch by itself.
    """
    d = deliveries.where(F.col(key).isNotNull() & (F.coalesce(F.col(event), F.lit(0)) != 0))
    end = F.col(event) - F.pmod(F.col(event), F.lit(period_ns)) + F.lit(period_ns)
    rows = d.select(*([batch] if batch else []), key, *group, F.col(source).alias("source"), arrival_ns(F.col(observed), F.col(received)).alias("arrival"), end.alias("period_end"))
    return _earliest(rows, [batch, key] if batch else [key], group)


def _earliest(rows: DataFrame, keys: list[str], group: list[str]) -> DataFrame:
    """One order decides everywhere, so merging in parts gives what merging at once gives."""
    first = F.min(F.struct("arrival", "period_end", *group, "source")).alias("m")
    return rows.groupBy(*keys).agg(first).select(*keys, *[F.col(f"m.{c}").alias(c) for c in (*group, "source", "arrival", "period_end")])


def merge_dots(states: list[DataFrame], key: str, group: list[str]) -> DataFrame:
    """Dots of several batches or states as one: per record the earliest arrival. Partial aggregation merges copies before the shuffle."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s, allowMissingColumns=True)
    return _earliest(out, [key], group)


def with_outcome(d: DataFrame, grace_ns: int = GRACE_NS, cutoff_ns: int = CUTOFF_NS) -> DataFrame:
    """outcome: ``on_time``, ``late`` (after the period's end plus grace) or ``dropped`` (after the cut-off)."""
    lag = F.col("arrival") - F.col("period_end")
    return d.withColumn("outcome", F.when(lag > cutoff_ns, "dropped").when(lag > grace_ns, "late").otherwise("on_time"))


def versions(d: DataFrame, group: list[str], step_ns: int = HOUR_NS) -> DataFrame:
    """The counter's state: (period_end, group, source, seq) -> n, dropped.

    seq numbers the steps of arrival; n and dropped are running totals of the source up
    to and including that step, so they never decrease with seq.
    """
    keys = ["period_end", *group, "source"]
    w = W.partitionBy(*keys).orderBy("seq")
    return (
        d.withColumn("seq", F.expr(f"(arrival - pmod(arrival, {step_ns})) div {step_ns}"))
        .groupBy(*keys, "seq")
        .agg(F.count_if(F.col("outcome") != "dropped").alias("n"), F.count_if(F.col("outcome") == "dropped").alias("dropped"))
        .withColumn("n", F.sum("n").over(w)).withColumn("dropped", F.sum("dropped").over(w))
    )


def merge(states: list[DataFrame], group: list[str]) -> DataFrame:
    """Copies of one counter state as one; fails where they differ, as their dots must be merged instead."""
    out = states[0]
    for s in states[1:]:
        out = out.unionByName(s)
    same = (F.count("*") == len(states)) & (F.min("n") == F.max("n")) & (F.min("dropped") == F.max("dropped"))
    other = F.raise_error(F.lit("states of different dots: merge their dots")).cast("bigint")
    return out.groupBy("period_end", *group, "source", "seq").agg(*[F.when(same, F.max(c)).otherwise(other).alias(c) for c in ("n", "dropped")])


def totals(state: DataFrame, group: list[str]) -> DataFrame:
    """Current value per period and group: the sum over sources of their latest version."""
    latest = state.groupBy("period_end", *group, "source").agg(F.max("n").alias("n"), F.max("dropped").alias("dropped"))
    return latest.groupBy("period_end", *group).agg(F.sum("n").alias("n"), F.sum("dropped").alias("dropped"))


def close(d: DataFrame, key: str, group: list[str], now_ns: int, cutoff_ns: int = CUTOFF_NS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(dots that stay, totals of the closed periods, keys counted in them) of a merged state with outcomes.

    A period is closed once ``now_ns``, which no arrival still to come precedes, lies
    beyond its cut-off: its n is final and of its dots only the keys are kept. Later
    batches are put through ``reopen``.
    """
    shut = F.col("period_end") + cutoff_ns < now_ns
    old = d.where(shut)
    sums = old.groupBy("period_end", *group).agg(F.count_if(F.col("outcome") != "dropped").alias("n"), F.count_if(F.col("outcome") == "dropped").alias("dropped"))
    return d.where(~shut), sums, old.select(key)


def reopen(later: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    """Dots of later batches without those of records that closed periods have counted; both sides shuffle by key."""
    return later.join(counted, key, "left_anti")


def add_totals(parts: list[DataFrame], group: list[str]) -> DataFrame:
    """Totals of closed and open periods, and of records beyond the cut-off of closed ones, as one."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("period_end", *group).agg(F.sum("n").alias("n"), F.sum("dropped").alias("dropped"))


def corrections(state: DataFrame, group: list[str]) -> DataFrame:
    """Every correction: per period, group and arrival step the value right after it.

    A source's increment is the difference to its previous version; increments of all
    sources add up along the steps.
    """
    ws = W.partitionBy("period_end", *group, "source").orderBy("seq")
    wg = W.partitionBy("period_end", *group).orderBy("seq")
    return (
        state.withColumn("dn", F.col("n") - F.coalesce(F.lag("n").over(ws), F.lit(0)))
        .withColumn("dd", F.col("dropped") - F.coalesce(F.lag("dropped").over(ws), F.lit(0)))
        .groupBy("period_end", *group, "seq").agg(F.sum("dn").alias("dn"), F.sum("dd").alias("dd"))
        .withColumn("n", F.sum("dn").over(wg)).withColumn("dropped", F.sum("dd").over(wg))
        .select("period_end", *group, "seq", "n", "dropped")
    )
