"""User functions over events: map, filter, one to many, routing, and state with flush.

A function sees an event as a dict and returns None (drop), a dict, or a list of dicts;
setting ``_dest`` routes. Functions run in Arrow batches on the executors. An event whose
function raises is lost, kept or fails the job, as asked, and is counted in ``errors``.
``Event`` wraps such a dict: typed attributes as Python values, copies, destinations.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import copy
import json

import pandas as pd
from pyspark import Accumulator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class Event(dict):
    """An event as a function sees it. Maps hold typed values; ``attribute`` and ``put`` speak Python."""

    @classmethod
    def new(cls, ts_ns: int, message: str | None = None, severity: str | None = None, **attributes: object) -> Event:
        """A fresh event with a time, a log if there is a message, and attributes."""
        log = None if message is None else {"message": message, "severity": severity, "body_format": "raw", "observed_ns": 0, "dropped": 0}
        out = cls(ts_ns=ts_ns, attributes={}, resource={}, scope={}, log=log, metrics=[], span=None)
        for k, v in attributes.items():
            out.put(k, v)
        return out

    @staticmethod
    def value_of(v: str | None) -> object:
        """Python value of a typed one: text, int, float, bool, None, bytes, list or dict; times as int."""
        if v is None or v[:1] == "n":
            return None
        kind, text = v[:1], v[1:]
        return {"s": str, "i": int, "u": int, "t": int, "f": float, "b": lambda x: x == "true", "x": bytes.fromhex, "a": json.loads, "m": json.loads}[kind](text)

    @staticmethod
    def typed(v: object) -> str:
        """Typed value of a Python one."""
        if v is None:
            return "n"
        if isinstance(v, bool):
            return "b" + str(v).lower()
        if isinstance(v, int):
            return ("i" if v < 2**63 else "u") + str(v)
        if isinstance(v, float):
            return "f" + ("NaN" if v != v else "Infinity" if v == float("inf") else "-Infinity" if v == float("-inf") else repr(v))
        if isinstance(v, bytes):
            return "x" + v.hex()
        return "s" + v if isinstance(v, str) else ("m" if isinstance(v, dict) else "a") + json.dumps(v, separators=(",", ":"), ensure_ascii=False)

    def attribute(self, name: str, where: str = "attributes") -> object:
        return self.value_of(dict(self.get(where) or {}).get(name))

    def put(self, name: str, value: object, where: str = "attributes") -> None:
        self[where] = dict(self.get(where) or {}) | {name: self.typed(value)}

    def to(self, target: str) -> Event:
        """A copy that goes to a target."""
        return Event(self.clone(), _dest=target)

    def clone(self) -> Event:
        return Event(copy.deepcopy(dict(self)))

    def to_table(self) -> dict:
        """A plain dict with Python values in its maps."""
        return dict(self) | {c: {k: self.value_of(v) for k, v in dict(self.get(c) or {}).items()} for c in ("attributes", "resource", "scope")}


def load_function(path: str, name: str = "process") -> Callable:
    """The named function of a Python file, shipped to executors by value."""
    space: dict[str, object] = {"__name__": "__script__", "Event": Event}
    with open(path, encoding="utf-8") as f:
        exec(compile(f.read(), path, "exec"), space)  # noqa: S102 - the user's own script
    if not callable(space.get(name)):
        raise ValueError(f"{path} has no function {name}")
    return space[name]


def process(df: DataFrame, fn: Callable[[dict], dict | list[dict] | None], schema: T.StructType | str | None = None, on_error: str = "drop", errors: Accumulator | None = None) -> DataFrame:
    """fn over every row; ``schema`` of what it returns, by default that of ``df``.

    on_error: ``drop`` loses the event, ``keep`` passes it on unchanged, ``raise`` fails.
    ``errors`` is an accumulator (``sparkContext.accumulator(0)``) that counts raised errors;
    a task that is run again counts again.
    """
    out = schema if schema is not None else df.schema
    names = None if isinstance(out, str) else out.names

    def run(batches: Iterator) -> Iterator:
        from pyspark.sql.pandas.types import to_arrow_schema  # noqa: F401
        import pyarrow as pa

        for b in batches:
            rows = []
            for r in b.to_pylist():
                try:
                    got = fn(dict(r))
                except Exception:
                    if on_error == "raise":
                        raise
                    if errors is not None:
                        errors.add(1)
                    got = r if on_error == "keep" else None
                rows.extend([] if got is None else got if isinstance(got, list) else [got])
            keep = names or (list(rows[0]) if rows else [])
            arrow = to_arrow_schema(out) if not isinstance(out, str) else None
            rows = [{n: (list(v.items()) if isinstance(v := r.get(n), dict) and arrow is not None and pa.types.is_map(arrow.field(n).type) else v) for n in keep} for r in rows]
            yield from (pa.Table.from_pylist(rows, schema=arrow) if arrow is not None else pa.Table.from_pylist(rows)).to_batches()

    return df.mapInArrow(run, out)


def flush(df: DataFrame, keys: list[str], fn: Callable[[tuple, pd.DataFrame], pd.DataFrame], schema: str, window_ns: int | None = None) -> DataFrame:
    """Accumulated state per key (and window): fn(key, rows) gives the rows to emit.

    Rows of a group must fit one task; salt the keys and flush twice where they may not.
    """
    d = df.withColumn("window_ns", F.expr(f"ts_ns - pmod(ts_ns, {window_ns})")) if window_ns else df
    return d.groupBy(*keys, *(["window_ns"] if window_ns else [])).applyInPandas(fn, schema)


def reduce_by(df: DataFrame, keys: list[str], **aggregates) -> DataFrame:  # noqa: ANN003
    """State that built-in aggregates express, combined map-side, so that no group is held in one task."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in aggregates.items()])
