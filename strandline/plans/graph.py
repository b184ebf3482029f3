"""Pipelines as graphs of named components, compiled to DataFrames.

A graph is a mapping of id -> {type, sources, ...options}, from Python, JSON or YAML.
Compiling is pure planning: every component is a function from frame to frame, a component
listed by several consumers is one plan used twice, and Catalyst optimises each sink's
plan as a whole. Several sources are a bag union; a router's targets are ids of their own.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from strandline.operators import aggregate, delta, filters, http_access, parsers, reshape, route, shape

#: type -> function(frame, **options)
COMPONENTS: dict[str, Callable[..., DataFrame]] = {
    "json": parsers.json, "csv": parsers.csv, "logfmt": parsers.logfmt, "kv": parsers.kv, "regex": parsers.regex, "line_protocol": parsers.line_protocol_events, "line_protocol_points": parsers.line_protocol, "http_access": http_access.http_access,
    "set": reshape.set_, "keep": reshape.keep, "remove": reshape.remove, "keep_values": reshape.keep_values, "flatten": reshape.flatten, "scale": reshape.scale, "bucket": reshape.bucket,
    "kv_metrics": reshape.kv_metrics, "trace_context": reshape.trace_context, "mint_span": reshape.mint_span, "timestamp": reshape.timestamp,
    "has_attributes": filters.has_attributes, "drop_attributes": filters.drop_attributes, "has_provenance": filters.has_provenance, "drop_provenance": filters.drop_provenance,
    "has_signal": filters.has_signal, "keep_signals": filters.keep_signals, "drop_signals": filters.drop_signals, "has_stale": filters.has_stale, "drop_stale": filters.drop_stale, "sample": filters.sample,
    "explode_metrics": aggregate.explode_metrics, "cap_series": aggregate.cap_series, "aggregate": lambda df, **o: _aggregate(df, **o), "cumulate": aggregate.cumulate, "retain_gauges": aggregate.retain_gauges,
    "cumulative_to_delta": delta.cumulative_to_delta, "dedup_timestamps": delta.dedup_timestamps, "shape_measure": shape.measure, "shape_summary": shape.summarise,
}
ROUTERS: dict[str, Callable[..., dict[str, DataFrame]]] = {"route": route.route, "route_signals": route.route_signals}


def _aggregate(df: DataFrame, **options) -> DataFrame:  # noqa: ANN003
    """Events give events; a metric table gives aggregates as rows of it, with what passed through and its ``reason``."""
    if "metrics" in df.columns:
        return aggregate.aggregate_events(df, **options)
    out, passed = aggregate.aggregate(df, **options)
    return aggregate.metric_rows(out).unionByName(passed, allowMissingColumns=True)


class GraphError(ValueError):
    """A graph that can't run as written; ``problems`` names each fault."""

    def __init__(self, problems: list[str]) -> None:
        super().__init__("; ".join(problems))
        self.problems = problems


def load(text: str, env: Mapping[str, str] | None = None) -> dict[str, dict]:
    """Graph of YAML or JSON text; ``${NAME}`` and ``${NAME:-default}`` come from the environment."""
    env = os.environ if env is None else env

    def fill(m: re.Match) -> str:
        if m[1] not in env and m[2] is None:
            raise GraphError([f"variable {m[1]} isn't set"])
        return env.get(m[1], m[2])

    text = re.sub(r"\$\{(\w+)(?::-([^}]*))?\}", fill, text)
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def _targets(spec: dict) -> list[str]:
    if spec["type"] not in ROUTERS:  # a user function that routes by _dest
        return list(dict.fromkeys(spec.get("targets", [])))
    if spec["type"] == "route":
        return list(dict.fromkeys(t for _, ts in _routes(spec) for t in ts))
    return list(dict.fromkeys(spec.get("signals", {}).values()))


def _routes(spec: dict) -> list[tuple[object, list[str]]]:
    r = spec.get("routes", [])
    pairs = r.items() if isinstance(r, dict) else r
    return [(v, [ts] if isinstance(ts, str) else list(ts)) for v, ts in pairs]


def validate(graph: dict[str, dict], inputs: list[str]) -> list[str]:
    """Order in which components can be built; raises with every fault found."""
    faults = []
    made = {t: i for i, s in graph.items() if s.get("type") for t in _targets(s)}
    for name in inputs:
        if name in graph:
            faults.append(f"{name} is an input and a component")
    for t, r in made.items():
        if t in graph or t in inputs:
            faults.append(f"target {t} of {r} is an id of its own")
    for i, s in graph.items():
        kind = s.get("type")
        if kind not in COMPONENTS and kind not in ROUTERS and kind not in ("union", "sink"):
            faults.append(f"{i}: unknown type {kind}")
        if not s.get("sources"):
            faults.append(f"{i}: no sources")
        for src in s.get("sources", []):
            if src == i:
                faults.append(f"{i}: reads itself")
            if src not in graph and src not in inputs and src not in made:
                faults.append(f"{i}: unknown source {src}")
            if graph.get(src, {}).get("type") == "sink":
                faults.append(f"{i}: reads the sink {src}")
            if graph.get(src, {}).get("type") == "route_signals":
                faults.append(f"{i}: reads {src}, which has targets only")
        if kind in ROUTERS and not _targets(s):
            faults.append(f"{i}: no targets")
        if kind == "regex":
            try:
                re.compile(s.get("pattern", "").replace("(?<", "(?P<"))
            except re.error as e:
                faults.append(f"{i}: bad pattern: {e}")
        if kind == "sample" and not 0 <= float(s.get("rate", -1)) <= 1:
            faults.append(f"{i}: rate must be from 0 to 1")
    if faults:
        raise GraphError(faults)
    order: list[str] = []
    state: dict[str, int] = {}

    def visit(i: str, path: list[str]) -> None:
        if i in inputs:
            return
        i = made.get(i, i)
        if state.get(i) == 2:
            return
        if state.get(i) == 1:
            raise GraphError([f"cycle: {' -> '.join([*path[path.index(i):], i])}"])
        state[i] = 1
        for src in graph[i]["sources"]:
            visit(src, [*path, i])
        state[i] = 2
        order.append(i)

    for i in graph:
        visit(i, [])
    read = {src for s in graph.values() for src in s["sources"]}
    unread = [t for t in made if t not in read]
    if unread:
        raise GraphError([f"target {t} has no consumer" for t in unread])
    return order


def compile_graph(graph: dict[str, dict], inputs: dict[str, DataFrame], extra: dict[str, Callable[..., DataFrame]] | None = None, observed: dict[str, Observation] | None = None) -> dict[str, DataFrame]:
    """Frame of every component and target; sinks are what to write.

    ``extra`` adds component types, such as user functions; one with ``targets`` routes
    by the column ``_dest`` of what it gives, and rows without one are its own output.
    Each component's output is marked with its provenance if the frame has provenance
    columns. ``observed``, filled with an observation per sink, tells after a run how
    many events each has seen.
    """
    known = COMPONENTS | (extra or {})
    order = validate({i: s if s.get("type") not in (extra or {}) else s | {"type": "union"} for i, s in graph.items()}, list(inputs))
    out: dict[str, DataFrame] = {i: route.with_provenance(d, i) if "_origin" in d.columns else d for i, d in inputs.items()}
    for i in order:
        s = graph[i]
        df = route.fan_in(*[out[x] for x in s["sources"]])
        options = {k: v for k, v in s.items() if k not in ("type", "sources", "targets")}
        if s["type"] in ROUTERS:
            if s["type"] == "route":
                options["routes"] = _routes(s)
            parts = ROUTERS[s["type"]](df, **options)
            forward = parts.pop(route.FORWARD, None)
            if forward is not None:
                out[i] = forward
            out.update(parts)
            continue
        made = df if s["type"] in ("union", "sink") else known[s["type"]](df, **options)
        made = made.withColumn("_previous", F.lit(i)) if "_previous" in made.columns else made
        if s.get("targets"):
            for t in _targets(s):
                out[t] = made.where(F.col("_dest") == t).drop("_dest")
            made = made.where("_dest is null").drop("_dest")
        if observed is not None and s["type"] == "sink":
            observed[i] = Observation(i)
            made = made.observe(observed[i], F.count(F.lit(1)).alias("events"))
        out[i] = made
    return out


def sinks(graph: dict[str, dict], frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return {i: frames[i] for i, s in graph.items() if s["type"] == "sink"}


def dot(graph: dict[str, dict]) -> str:
    """The graph in DOT."""
    q = lambda x: '"' + x.replace('"', r"\"") + '"'
    out = ["digraph pipeline {"]
    out += [f"  {q(i)} [label={q(i + chr(92) + 'n' + s['type'])}];" for i, s in sorted(graph.items())]
    out += [f"  {q(src)} -> {q(i)};" for i, s in sorted(graph.items()) for src in s["sources"]]
    out += [f"  {q(i)} -> {q(t)} [style=dashed];" for i, s in sorted(graph.items()) if s["type"] in ROUTERS for t in _targets(s)]
    return "\n".join([*out, "}"])
