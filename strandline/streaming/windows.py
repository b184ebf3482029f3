"""The operators over streams.

``aggregate_stream`` makes one micro-batch one window: what arrived together is
aggregated together. ``event_time`` aggregates by event time with a watermark.
``running_totals`` and ``deltas`` keep state per series with a timeout.
``late_counters`` maintains the late-event counter state in a table, merged per batch.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from strandline.operators import aggregate, late_events


def aggregate_stream(metrics: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, every: str = "10 seconds", once: bool = False, **options) -> StreamingQuery:  # noqa: ANN003
    """Each micro-batch of the metric table is one window; ``sink(frame, batch_id)`` must be idempotent by batch_id."""
    wide = 1 << 62

    def one(batch: DataFrame, batch_id: int) -> None:
        out, _ = aggregate.aggregate(batch, wide, **options)
        sink(out.withColumn("window_no", F.lit(batch_id)), batch_id)

    w = metrics.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime=every)).start()


def event_time(df: DataFrame, ts: str, window: str, keys: list[str], lateness: str, **aggregates) -> DataFrame:  # noqa: ANN003
    """Tumbling event-time windows, closed once the watermark passes."""
    d = df.withWatermark(ts, lateness)
    return d.groupBy(F.window(ts, window), *keys).agg(*[c.alias(n) for n, c in aggregates.items()])


def deltas(points: DataFrame, series: list[str], timeout: str = "1 hour") -> DataFrame:
    """Cumulative points (series..., ts_ns, value) to (series..., ts_ns, delta, rule), the baseline held as state."""
    kinds = dict(points.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in series], "ts_ns bigint, delta double, rule string"])
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else (None, None)
        rows = []
        for ts, v in pd.concat(list(parts)).sort_values("ts_ns")[["ts_ns", "value"]].itertuples(index=False):
            at, base = last
            if at is not None and ts <= at:
                rows.append((*key, ts, None, "duplicate" if ts == at else "out_of_order"))
                continue
            rows.append((*key, ts, None, "first") if base is None else (*key, ts, v, "reset") if v < base else (*key, ts, v - base, "difference"))
            last = (int(ts), float(v))
        state.update(last)
        state.setTimeoutDuration(ms)
        yield pd.DataFrame(rows, columns=[*series, "ts_ns", "delta", "rule"])

    return points.groupBy(*series).applyInPandasWithState(step, schema, "at bigint, base double", "append", GroupStateTimeout.ProcessingTimeTimeout)


def running_totals(points: DataFrame, series: list[str], timeout: str = "1 hour") -> DataFrame:
    """Delta points to running totals per series; a series silent for ``timeout`` starts anew."""
    kinds = dict(points.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in series], "ts_ns bigint, total double, start_ns bigint"])
    ms = int(pd.Timedelta(timeout).total_seconds() * 1000)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        total, start = state.get if state.exists else (0.0, None)
        p = pd.concat(list(parts))
        start = int(p.ts_ns.min()) if start is None else start
        total += float(p.value.sum())
        state.update((total, start))
        state.setTimeoutDuration(ms)
        yield pd.DataFrame([(*key, int(p.ts_ns.max()), total, start)], columns=[*series, "ts_ns", "total", "start_ns"])

    return points.groupBy(*series).applyInPandasWithState(step, schema, "total double, start bigint", "update", GroupStateTimeout.ProcessingTimeTimeout)


def late_counters(deliveries: DataFrame, table: str, checkpoint: str, group: list[str], once: bool = True, counted: str | None = None, **columns: str) -> StreamingQuery:
    """Fold a stream of deliveries into dots kept under ``table``; ``latest_dots`` reads them.

    Each batch writes its dots as one part named by its id, so a repeated batch overwrites
    itself; merging by earliest arrival makes the union of parts the state. ``counted`` is
    the folder of identifiers that ``settle`` has left; their records are left out.
    """
    def one(batch: DataFrame, batch_id: int) -> None:
        d = late_events.dots(batch, group=group, **columns)
        if counted:
            d = late_events.reopen(d, batch.sparkSession.read.parquet(counted), columns["key"])
        d.write.mode("overwrite").parquet(f"{table}/part={batch_id}")

    w = deliveries.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def settle(dots: DataFrame, out: str, key: str, group: list[str], now_ns: int) -> None:
    """Close the periods past their cut-off at ``now_ns``: folders dots, totals and counted under ``out``.

    What a state holds after that is its open periods' dots, and of the closed ones a
    total each and the identifiers; the parts before can go.
    """
    d = late_events.with_outcome(latest_dots(dots, key, group))
    stay, shut, counted = late_events.close(d, key, group, now_ns)
    stay.drop("outcome").write.parquet(f"{out}/dots/part=-1")
    shut.write.parquet(f"{out}/totals")
    counted.write.parquet(f"{out}/counted")


def latest_dots(dots: DataFrame, key: str, group: list[str]) -> DataFrame:
    """Dots of all parts merged: of each record its earliest arrival."""
    return late_events.merge_dots([dots], key, group)
