"""Irregular readings on a regular grid, by a Kalman smoother per source.

The model is a continuous-time local linear trend: a level driven by a slope, both
with Wiener noise, observed with white noise. Readings enter at their own instants;
the smoothed level and its standard deviation are evaluated at every grid time
between the first and the last slot with a reading of a UTC day, and slots without
one are marked. Noise levels come from the differences of consecutive readings.

Readings are first reduced to one row per slot, before the shuffle, so the unit of
work, a source's day, has at most 86400 / interval slots however many rows a source
holds; hot sources spread over their days. Units run side by side in numpy, step by
step, so Python's cost is per step, not per reading.

Nulls: readings without source, instant or value are left out; a source with a null
or non-positive interval has no grid. Repeated readings of a slot are averaged. Days
are independent, so a later day never changes an earlier one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMA = "series_id bigint, slot_start bigint, value double, stddev double, n bigint, missing boolean"
#: Grid cells that one numpy block holds at most (unless one unit alone has more).
BLOCK_CELLS = 200_000


def slots(readings: DataFrame) -> DataFrame:
    """(series_id, interval_s, ns, value) -> one row per slot: n, mean value, mean offset in s."""
    sec = F.expr("ns div 1000000000")
    iv = F.col("interval_s").cast("bigint")
    d = readings.where("series_id is not null and ns is not null and value is not null and interval_s > 0")
    d = d.withColumn("slot_start", sec - F.pmod(sec, iv))
    return (
        d.groupBy("series_id", "interval_s", "slot_start")
        .agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.avg((F.col("ns") - F.col("slot_start") * 1_000_000_000) / 1e9).alias("off"))
        .withColumn("day", F.expr("slot_start div 86400"))
    )


def smooth(obs: np.ndarray, n: np.ndarray, off: np.ndarray, dt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smoothed level and standard deviation at each slot start.

    obs, n, off: slots x units; n = 0 marks a slot without reading. dt: interval per unit.
    Each slot makes two steps: to its start, where the level is wanted, and to its
    reading, which updates; a slot without reading makes only the first.
    """
    T, U = obs.shape
    has = n > 0
    cnt = np.maximum(has.sum(0), 1)
    mean = np.where(has, obs, 0).sum(0) / cnt
    # Differences of consecutive readings: their variance splits into noise and drift.
    idx = np.where(has, np.arange(T)[:, None], -1)
    prev = np.maximum.accumulate(idx, axis=0)
    prev = np.vstack([np.full((1, U), -1), prev[:-1]])
    pair = has & (prev >= 0)
    gap = np.where(pair, np.arange(T)[:, None] - prev, 1)
    diff = np.where(pair, obs - np.take_along_axis(obs, np.maximum(prev, 0), 0), 0)
    pairs = np.maximum(pair.sum(0), 1)
    d2 = (diff**2).sum(0) / pairs
    floor = 1e-12 * (1 + mean**2)
    r = np.maximum(0.4 * d2, floor)
    ql = np.maximum(0.2 * (diff**2 / gap).sum(0) / pairs, floor) / dt
    qs = 1e-3 * ql / dt**2
    # State: level a, slope b; covariance p (aa), c (ab), s (bb).
    a, b = np.where(has, obs, np.nan), np.zeros(U)
    first = np.argmax(has, axis=0)
    a = obs[first, np.arange(U)].astype(float)
    p, c, s = np.full(U, 1.0) * (10 * r + d2 + floor), np.zeros(U), (d2 + floor) / dt**2
    K = np.empty((T, 2, 10, U))  # per step: filtered a b p c s, predicted a b p c s

    def predict(a, b, p, c, s, h):  # noqa: ANN001, ANN202
        h2 = h * h
        return a + h * b, b, p + 2 * h * c + h2 * s + ql * h + qs * h2 * h / 3, c + h * s + qs * h2 / 2, s + qs * h

    H = np.empty((T, 2, U))
    last = np.zeros(U)  # offset, within the slot before, from which the next step starts
    for t in range(T):
        h0 = dt - last if t else np.zeros(U)
        pa, pb, pp, pc, ps = predict(a, b, p, c, s, h0)
        K[t, 0] = pa, pb, pp, pc, ps, pa, pb, pp, pc, ps
        H[t, 0] = h0
        h1 = np.where(has[t], off[t], 0.0)
        qa, qb, qp, qc, qs_ = predict(pa, pb, pp, pc, ps, h1)
        S = qp + r / np.maximum(n[t], 1)
        k1, k2 = np.where(has[t], qp / S, 0), np.where(has[t], qc / S, 0)
        e = np.where(has[t], obs[t] - qa, 0)
        a, b = qa + k1 * e, qb + k2 * e
        p, c, s = qp * (1 - k1), qc * (1 - k1), np.maximum(qs_ - k2 * qc, 0)
        K[t, 1] = a, b, p, c, s, qa, qb, qp, qc, qs_
        H[t, 1] = h1
        last = h1
    # Backward pass over the same steps.
    level, sd = np.empty((T, U)), np.empty((T, U))
    sa, sb, sp, sc, ss = K[T - 1, 1, :5]
    order = [(t, j) for t in range(T - 1, -1, -1) for j in (1, 0)]
    for (t, j), (u, i) in zip(order, order[1:], strict=False):
        fa, fb, fp, fc, fs = K[u, i, :5]
        ga, gb, gp, gc, gs = K[t, j, 5:]
        h = H[t, j]
        det = np.maximum(gp * gs - gc * gc, 1e-300)
        x1, x2 = fp + h * fc, fc  # row 1 of P F'
        y1, y2 = fc + h * fs, fs
        c11, c12 = (x1 * gs - x2 * gc) / det, (x2 * gp - x1 * gc) / det
        c21, c22 = (y1 * gs - y2 * gc) / det, (y2 * gp - y1 * gc) / det
        still = h <= 0
        c11, c12 = np.where(still, 1.0, c11), np.where(still, 0.0, c12)
        c21, c22 = np.where(still, 0.0, c21), np.where(still, 1.0, c22)
        da, db = sa - ga, sb - gb
        dp, dc, ds = sp - gp, sc - gc, ss - gs
        m1, m2 = c11 * dp + c12 * dc, c11 * dc + c12 * ds
        n1, n2 = c21 * dp + c22 * dc, c21 * dc + c22 * ds
        sa, sb = fa + c11 * da + c12 * db, fb + c21 * da + c22 * db
        sp, sc, ss = fp + m1 * c11 + m2 * c12, fc + m1 * c21 + m2 * c22, fs + n1 * c21 + n2 * c22
        if i == 0:
            level[u], sd[u] = sa, np.sqrt(np.maximum(sp, 0))
    return level, sd


def _block(units: list[pd.DataFrame]) -> pd.DataFrame:
    starts = np.array([u.slot_start.iloc[0] for u in units], dtype=np.int64)
    dt = np.array([u.interval_s.iloc[0] for u in units], dtype=np.int64)
    length = np.array([(u.slot_start.iloc[-1] - u.slot_start.iloc[0]) // u.interval_s.iloc[0] + 1 for u in units], dtype=np.int64)
    T, U = int(length.max()), len(units)
    obs, n, off = np.zeros((T, U)), np.zeros((T, U), dtype=np.int64), np.zeros((T, U))
    for j, u in enumerate(units):
        at = ((u.slot_start.to_numpy() - starts[j]) // dt[j]).astype(np.int64)
        obs[at, j], n[at, j], off[at, j] = u["mean"].to_numpy(), u.n.to_numpy(), u.off.to_numpy()
    level, sd = smooth(obs, n, off, dt.astype(float))
    inside = np.arange(T)[:, None] < length[None, :]
    t, j = np.nonzero(inside)
    ids = np.array([u.series_id.iloc[0] for u in units], dtype=np.int64)
    return pd.DataFrame({"series_id": ids[j], "slot_start": starts[j] + t * dt[j], "value": level[t, j], "stddev": sd[t, j], "n": n[t, j], "missing": n[t, j] == 0})


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    waiting: dict[int, list[pd.DataFrame]] = {}
    cells: dict[int, int] = {}
    rest: pd.DataFrame | None = None

    def add(unit: pd.DataFrame) -> Iterator[pd.DataFrame]:
        long = int((unit.slot_start.iloc[-1] - unit.slot_start.iloc[0]) // unit.interval_s.iloc[0] + 1)
        k = long.bit_length()
        waiting.setdefault(k, []).append(unit)
        cells[k] = cells.get(k, 0) + (1 << k)
        if cells[k] >= BLOCK_CELLS:
            cells[k] = 0
            yield _block(waiting.pop(k))

    for batch in batches:
        pdf = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if pdf.empty:
            continue
        key = pdf.series_id.to_numpy() * 1_000_003 + pdf.day.to_numpy()
        cut = np.flatnonzero(np.diff(key)) + 1
        edges = [0, *cut.tolist(), len(pdf)]
        for x, y in zip(edges[:-2], edges[1:-1], strict=True):
            yield from add(pdf.iloc[x:y])
        rest = pdf.iloc[edges[-2] :]
    if rest is not None:
        yield from add(rest)
    for units in waiting.values():
        yield _block(units)


def regular_grid(readings: DataFrame) -> DataFrame:
    """readings (series_id, interval_s, ns, value) -> SCHEMA, one row per slot of the grid."""
    per_slot = slots(readings)
    spread = per_slot.repartition("series_id", "day").sortWithinPartitions("series_id", "day", "slot_start")
    return spread.mapInPandas(_run, SCHEMA)
