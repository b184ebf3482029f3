"""Binary wire formats: sticky-part datagrams, msgpack, protobuf messages, pickled points.

Spark has no operator for these, so bodies (a BINARY column) are decoded in Arrow
batches, one body at a time and nothing between bodies. A malformed body gives what
precedes the fault and no more; nothing raises.
"""

from __future__ import annotations

import io
import json
import math
import pickle
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.schema import BOOL, DOUBLE, INT, LONG, STR, struct as schema

METRIC_ROW = schema(ts_ns=LONG, name=STR, kind=STR, value=DOUBLE, value_text=STR, temporality=STR, monotonic=BOOL, flags=INT, attributes=T.MapType(STR, STR), pos=INT)
SPAN_ROW = schema(trace_id=STR, span_id=STR, parent_span_id=STR, name=STR, service=STR, resource=STR, type=STR, ts_ns=LONG, end_ns=LONG, error=INT, attributes=T.MapType(STR, STR))


def decode(df: DataFrame, rows_of: Callable[[bytes], Iterator[dict]], row: T.StructType, body: str = "body") -> DataFrame:
    """df without ``body``, once per row that ``rows_of`` gives for it; a null body gives none."""
    rest = [c for c in df.columns if c != body]
    out = T.StructType([*[df.schema[c] for c in rest], *row])
    names = [f.name for f in row]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        made = to_arrow_schema(T.StructType(list(row)))
        for b in batches:
            index, rows = [], []
            for i, data in enumerate(b.column(body).to_pylist()):
                if data is None:
                    continue
                try:
                    for r in rows_of(bytes(data)):
                        index.append(i)
                        rows.append({n: r.get(n) for n in names})
                except (ValueError, struct_error, IndexError, KeyError, UnicodeDecodeError, TypeError, OverflowError, pickle.UnpicklingError, EOFError):
                    continue
            t = pa.Table.from_pylist(rows, schema=made)
            keep = [b.column(c).take(pa.array(index, pa.int64())) for c in rest]
            yield from pa.Table.from_arrays([*keep, *t.columns], names=[*rest, *names]).combine_chunks().to_batches()

    return df.select(*rest, body).mapInArrow(run, out)


struct_error = struct.error


# -- sticky-part datagrams ---------------------------------------------------------------------

_PARTS = {0x0000: "host", 0x0002: "plugin", 0x0003: "plugin_instance", 0x0004: "type", 0x0005: "type_instance"}


def collectd_rows(data: bytes) -> Iterator[dict]:
    """One row per data source; identity parts hold until overwritten."""
    at, now, ts = 0, {}, 0
    while at + 4 <= len(data):
        kind, size = struct.unpack_from(">HH", data, at)
        if size < 4 or at + size > len(data):
            return
        part = data[at + 4 : at + size]
        at += size
        if kind in _PARTS:
            now[_PARTS[kind]] = part.rstrip(b"\0").decode()
        elif kind == 0x0001:
            ts = struct.unpack(">Q", part)[0] * 1_000_000_000
        elif kind == 0x0008:
            ts = struct.unpack(">Q", part)[0] * 1_000_000_000 >> 30
        elif kind == 0x0006:
            n = struct.unpack_from(">H", part)[0]
            if not (now.get("host") and now.get("plugin") and now.get("type")):
                continue
            attrs = {"host.name": "s" + now["host"]} | {f"collectd.{k}": "s" + v for k, v in now.items() if v and k != "host"}
            for i in range(n):
                t, raw = part[2 + i], part[2 + n + 8 * i : 10 + n + 8 * i]
                row = {"ts_ns": ts, "name": ".".join(filter(None, [now["plugin"], now["type"], now.get("type_instance")])), "attributes": attrs, "pos": i, "flags": 0}
                if t == 1:
                    v = struct.unpack("<d", raw)[0]
                    yield row | {"kind": "gauge", "value": 0.0 if math.isnan(v) else v, "flags": int(math.isnan(v))}
                else:
                    v = struct.unpack(">q" if t == 2 else ">Q", raw)[0]
                    yield row | {"kind": "sum", "value": float(v), "value_text": str(v), "temporality": "delta" if t == 3 else "cumulative", "monotonic": t != 2}


def collectd_datagram(lists: list[dict]) -> bytes:
    """A datagram of value lists: host, plugin, type, ..., ts_ns and values [(type, number)]; parts repeat only when they change."""
    out, now = bytearray(), {}
    for item in lists:
        for code, name in _PARTS.items():
            v = item.get(name, "")
            if now.get(name, "") != v:
                raw = v.encode() + b"\0"
                out += struct.pack(">HH", code, 4 + len(raw)) + raw
                now[name] = v
        out += struct.pack(">HHQ", 0x0008, 12, (item["ts_ns"] << 30) // 1_000_000_000)
        values = item["values"]
        body = struct.pack(">H", len(values)) + bytes(t for t, _ in values)
        for t, v in values:
            body += struct.pack("<d", v) if t == 1 else struct.pack(">q" if t == 2 else ">Q", v)
        out += struct.pack(">HH", 0x0006, 4 + len(body)) + body
    return bytes(out)


# -- msgpack -----------------------------------------------------------------------------------


def unpack(data: bytes, at: int = 0, depth: int = 0) -> tuple[object, int]:
    """One msgpack value and the position after it."""
    if depth > 64:
        raise ValueError("nested too deep")
    b = data[at]
    at += 1
    if b <= 0x7F:
        return b, at
    if b >= 0xE0:
        return b - 256, at
    fixed = {0x80: ("map", b & 15), 0x90: ("list", b & 15)}.get(b & 0xF0) if b < 0xA0 else ("str", b & 31) if b < 0xC0 else None
    if fixed is None:
        if b in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[b], at
        numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
        if b in numbers:
            return struct.unpack_from(numbers[b], data, at)[0], at + struct.calcsize(numbers[b])
        sized = {0xC4: ("bin", ">B"), 0xC5: ("bin", ">H"), 0xC6: ("bin", ">I"), 0xD9: ("str", ">B"), 0xDA: ("str", ">H"), 0xDB: ("str", ">I"), 0xDC: ("list", ">H"), 0xDD: ("list", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}
        kind, f = sized[b]
        fixed = (kind, struct.unpack_from(f, data, at)[0])
        at += struct.calcsize(f)
    kind, n = fixed
    if kind in ("str", "bin"):
        if at + n > len(data):
            raise ValueError("cut off")
        raw = data[at : at + n]
        return (raw.decode("utf-8", "replace") if kind == "str" else raw), at + n
    out: list | dict = [] if kind == "list" else {}
    for _ in range(n):
        k, at = unpack(data, at, depth + 1)
        if kind == "list":
            out.append(k)
        else:
            out[k], at = unpack(data, at, depth + 1)
    return out, at


def pack(v: object) -> bytes:
    """msgpack of None, bools, ints, floats, text, bytes, lists and dicts."""
    if v is None or isinstance(v, bool):
        return b"\xc0" if v is None else b"\xc3" if v else b"\xc2"
    if isinstance(v, int):
        return struct.pack("B", v) if 0 <= v < 128 else b"\xcf" + struct.pack(">Q", v) if v >= 0 else b"\xd3" + struct.pack(">q", v)
    if isinstance(v, float):
        return b"\xcb" + struct.pack(">d", v)
    if isinstance(v, (str, bytes)):
        raw = v.encode() if isinstance(v, str) else v
        return (b"\xdb" if isinstance(v, str) else b"\xc6") + struct.pack(">I", len(raw)) + raw
    if isinstance(v, dict):
        return b"\xdf" + struct.pack(">I", len(v)) + b"".join(pack(k) + pack(x) for k, x in v.items())
    return b"\xdd" + struct.pack(">I", len(v)) + b"".join(map(pack, v))


def typed(v: object) -> str:
    """Typed value text of a decoded one."""
    if v is None:
        return "n"
    if isinstance(v, bool):
        return "b" + str(v).lower()
    if isinstance(v, int):
        return ("i" if -(1 << 63) <= v < 1 << 63 else "u") + str(v)
    if isinstance(v, float):
        return "f" + ("NaN" if math.isnan(v) else "Infinity" if v == math.inf else "-Infinity" if v == -math.inf else repr(v))
    if isinstance(v, bytes):
        return "x" + v.hex()
    return ("s" + v) if isinstance(v, str) else ("m" if isinstance(v, dict) else "a") + json.dumps(v, default=lambda b: b.hex() if isinstance(b, bytes) else str(b))


def msgpack_maps(data: bytes) -> Iterator[dict]:
    """Attributes of the maps that follow one another in a body."""
    at = 0
    while at < len(data):
        v, at = unpack(data, at)
        if isinstance(v, dict):
            yield {"attributes": {str(k): typed(x) for k, x in v.items()}}


MSGPACK_ROW = schema(attributes=T.MapType(STR, STR))


def tracer_rows(data: bytes) -> Iterator[dict]:
    """Spans of a tracer body: lists of traces (maps), or a string table with index rows."""
    v, _ = unpack(data)
    if isinstance(v, list) and len(v) == 2 and v[0] and all(isinstance(x, str) for x in v[0]):
        names = ["service", "name", "resource", "trace_id", "span_id", "parent_id", "start", "duration", "error", "meta", "metrics", "type"]
        table, traces = v
        look = lambda x: table[x] if isinstance(x, int) else x
        traces = [[{n: (look(x) if n in ("service", "name", "resource", "type") else {look(k): look(y) if n == "meta" else y for k, y in x.items()} if n in ("meta", "metrics") else x) for n, x in zip(names, row, strict=False)} for row in t] for t in traces]
    else:
        traces = [c.get("spans", []) for c in v.get("chunks", [])] if isinstance(v, dict) else v
    for t in traces:
        for s in t:
            attrs = {k: "s" + str(x) for k, x in (s.get("meta") or {}).items()} | {k: typed(float(x)) for k, x in (s.get("metrics") or {}).items()}
            high = (s.get("meta") or {}).get("_dd.p.tid", "")
            hexed = f"{s.get('trace_id', 0) & (1 << 64) - 1:016x}"
            yield {"trace_id": (high.rjust(16, "0") if len(high) <= 16 else "0" * 16) + hexed, "span_id": f"{s.get('span_id', 0) & (1 << 64) - 1:016x}", "parent_span_id": f"{s['parent_id'] & (1 << 64) - 1:016x}" if s.get("parent_id") else None, "name": s.get("name"), "service": s.get("service"), "resource": s.get("resource"), "type": s.get("type"), "ts_ns": s.get("start"), "end_ns": s.get("start", 0) + s.get("duration", 0), "error": s.get("error", 0), "attributes": attrs}


# -- protobuf ----------------------------------------------------------------------------------


def varint(data: bytes, at: int) -> tuple[int, int]:
    v = shift = 0
    while True:
        b = data[at]
        at += 1
        v |= (b & 127) << shift
        if b < 128:
            return v & (1 << 64) - 1, at
        shift += 7
        if shift > 63:
            raise ValueError("varint too long")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, raw value) of a message's fields: ints for varint and fixed widths, bytes for the rest."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        wire = tag & 7
        if wire == 0:
            v, at = varint(data, at)
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            if at + n > len(data):
                raise ValueError("cut off")
            v, at = int.from_bytes(data[at : at + n], "little"), at + n
        elif wire == 2:
            n, at = varint(data, at)
            if at + n > len(data):
                raise ValueError("cut off")
            v, at = data[at : at + n], at + n
        else:
            raise ValueError("bad wire type")
        yield tag >> 3, v


def message(data: bytes) -> dict[int, list]:
    out: dict[int, list] = {}
    for n, v in fields(data):
        out.setdefault(n, []).append(v)
    return out


def double(v: int) -> float:
    return struct.unpack("<d", v.to_bytes(8, "little"))[0]


def signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def any_value(data: bytes) -> str:
    """Typed value of an AnyValue message."""
    for n, v in fields(data):
        if n == 1:
            return "s" + v.decode("utf-8", "replace")
        if n == 2:
            return "b" + str(bool(v)).lower()
        if n == 3:
            return "i" + str(signed(v))
        if n == 4:
            return typed(double(v))
        if n == 7:
            return "x" + v.hex()
        if n == 5:
            return "a" + json.dumps([any_value(x)[1:] for x in message(v).get(1, [])])
        if n == 6:
            return "m" + json.dumps({k: x[1:] for k, x in key_values(message(v).get(1, [])).items()})
    return "n"


def key_values(items: list[bytes]) -> dict[str, str]:
    out = {}
    for item in items:
        m = message(item)
        out[m.get(1, [b""])[0].decode("utf-8", "replace")] = any_value(m[2][0]) if 2 in m else "n"
    return out


def _resource(m: dict) -> dict[str, str]:
    return key_values(message(m[1][0]).get(1, [])) if 1 in m else {}


OTLP_POINT = schema(resource=T.MapType(STR, STR), name=STR, unit=STR, description=STR, kind=STR, attributes=T.MapType(STR, STR), ts_ns=LONG, start_ns=LONG, flags=INT, value=DOUBLE, value_i64=LONG, temporality=STR, monotonic=BOOL, count=LONG, sum=DOUBLE, buckets=T.ArrayType(schema(bound=DOUBLE, count=LONG)))


def otlp_metric_rows(data: bytes) -> Iterator[dict]:
    """Points of an export request: gauges, sums, histograms, summaries."""
    for rm in message(data).get(1, []):
        r = message(rm)
        resource = _resource(r)
        for sm in r.get(2, []):
            for raw in message(sm).get(2, []):
                m = message(raw)
                base = {"resource": resource, "name": m.get(1, [b""])[0].decode(), "description": m.get(2, [b""])[0].decode() or None, "unit": m.get(3, [b""])[0].decode() or None}
                for n, kind in ((5, "gauge"), (7, "sum"), (9, "histogram"), (11, "summary")):
                    for body in m.get(n, []):
                        b = message(body)
                        temp = {1: "delta", 2: "cumulative"}.get(b.get(2, [0])[0] if kind != "summary" else 0)
                        for raw_point in b.get(1, []):
                            p = message(raw_point)
                            scalar = kind in ("gauge", "sum")
                            row = base | {"kind": kind, "temporality": temp if kind != "gauge" else None, "monotonic": bool(b.get(3, [0])[0]) if kind == "sum" else None, "attributes": key_values(p.get(9 if kind == "histogram" else 7, [])), "start_ns": p.get(2, [0])[0], "ts_ns": p.get(3, [0])[0], "flags": p.get(8 if kind != "histogram" else 10, [0])[0]}
                            if scalar:
                                i = signed(p[6][0]) if 6 in p else None
                                yield row | {"value": double(p[4][0]) if 4 in p else float(i) if i is not None else None, "value_i64": i}
                            elif kind == "histogram":
                                counts = [x for raw in p.get(6, []) for x in (struct.unpack(f"<{len(raw) // 8}Q", raw) if isinstance(raw, bytes) else [raw])]
                                bounds = [x for raw in p.get(7, []) for x in (struct.unpack(f"<{len(raw) // 8}d", raw) if isinstance(raw, bytes) else [double(raw)])]
                                yield row | {"count": p.get(4, [0])[0], "sum": double(p[5][0]) if 5 in p else None, "buckets": [{"bound": x, "count": c} for x, c in zip([*bounds, math.inf], counts, strict=False)]}
                            else:
                                yield row | {"count": p.get(4, [0])[0], "sum": double(p[5][0]) if 5 in p else None}


OTLP_LOG = schema(resource=T.MapType(STR, STR), ts_ns=LONG, observed_ns=LONG, severity_number=INT, severity_text=STR, message=STR, attributes=T.MapType(STR, STR), trace_id=STR, span_id=STR)


def otlp_log_rows(data: bytes) -> Iterator[dict]:
    """Records of a log export request."""
    for rl in message(data).get(1, []):
        r = message(rl)
        resource = _resource(r)
        for sl in r.get(2, []):
            for raw in message(sl).get(2, []):
                m = message(raw)
                yield {"resource": resource, "ts_ns": m.get(1, [0])[0], "observed_ns": m.get(11, [0])[0], "severity_number": m.get(2, [0])[0], "severity_text": m.get(3, [b""])[0].decode() or None, "message": any_value(m[5][0])[1:] if 5 in m else None, "attributes": key_values(m.get(6, [])), "trace_id": m[9][0].hex() if 9 in m else None, "span_id": m[10][0].hex() if 10 in m else None}


OTLP_SPAN = schema(resource=T.MapType(STR, STR), trace_id=STR, span_id=STR, parent_span_id=STR, name=STR, kind=INT, ts_ns=LONG, end_ns=LONG, status=INT, attributes=T.MapType(STR, STR))


def otlp_span_rows(data: bytes) -> Iterator[dict]:
    """Spans of a trace export request."""
    for rs in message(data).get(1, []):
        r = message(rs)
        resource = _resource(r)
        for ss in r.get(2, []):
            for raw in message(ss).get(2, []):
                m = message(raw)
                yield {"resource": resource, "trace_id": m.get(1, [b""])[0].hex(), "span_id": m.get(2, [b""])[0].hex(), "parent_span_id": m[4][0].hex() if m.get(4, [b""])[0] else None, "name": m.get(5, [b""])[0].decode(), "kind": m.get(6, [0])[0], "ts_ns": m.get(7, [0])[0], "end_ns": m.get(8, [0])[0], "status": message(m[15][0]).get(3, [0])[0] if 15 in m else 0, "attributes": key_values(m.get(9, []))}


STALE = 0x7FF0000000000002


def remote_write_rows(data: bytes) -> Iterator[dict]:
    """Samples of a snappy-compressed remote-write body; the stale marker gives a flagged row without value."""
    size, _ = varint(data, 0)
    plain = pa.Codec("snappy").decompress(data, decompressed_size=size, asbytes=True)
    for ts in message(plain).get(1, []):
        m = message(ts)
        labels = {}
        for raw in m.get(1, []):
            pair = message(raw)
            labels[pair.get(1, [b""])[0].decode()] = pair.get(2, [b""])[0].decode()
        name = labels.pop("__name__", "")
        for i, raw in enumerate(m.get(2, [])):
            s = message(raw)
            bits = s.get(1, [0])[0]
            stale = bits == STALE
            yield {"ts_ns": signed(s.get(2, [0])[0]) * 1_000_000, "name": name, "kind": "gauge", "value": None if stale else double(bits), "flags": int(stale), "attributes": {k: "s" + v for k, v in labels.items()}, "pos": i}


# -- pickled points ----------------------------------------------------------------------------


class _Plain(pickle.Unpickler):
    """Only lists, tuples, text and numbers; any global is refused."""

    def find_class(self, module: str, name: str) -> object:
        raise pickle.UnpicklingError(f"{module}.{name} isn't allowed")


def graphite_pickle_rows(data: bytes) -> Iterator[dict]:
    """Points of length-prefixed pickled lists of (path, (time, value))."""
    at = 0
    while at + 4 <= len(data):
        n = struct.unpack_from(">I", data, at)[0]
        frame, at = data[at + 4 : at + 4 + n], at + 4 + n
        if len(frame) < n:
            return
        for i, (path, (ts, value)) in enumerate(_Plain(io.BytesIO(frame)).load()):
            head, *tags = (path.decode() if isinstance(path, bytes) else path).split(";")
            v = float(value)
            if math.isfinite(v) and float(ts) > 0:
                yield {"ts_ns": round(float(ts) * 1e9) if isinstance(ts, float) else int(ts) * 1_000_000_000, "name": head, "kind": "gauge", "value": v, "flags": 0, "attributes": {k: "s" + x for k, _, x in (t.partition("=") for t in tags)}, "pos": i}


READERS = {
    "collectd": (collectd_rows, METRIC_ROW), "msgpack": (msgpack_maps, MSGPACK_ROW), "tracer": (tracer_rows, SPAN_ROW), "otlp_metrics": (otlp_metric_rows, OTLP_POINT), "otlp_logs": (otlp_log_rows, OTLP_LOG),
    "otlp_traces": (otlp_span_rows, OTLP_SPAN), "remote_write": (remote_write_rows, METRIC_ROW), "graphite_pickle": (graphite_pickle_rows, METRIC_ROW),
}


def read(df: DataFrame, name: str, body: str = "body") -> DataFrame:
    """Rows of bodies in the named format."""
    rows, row = READERS[name]
    return decode(df, rows, row, body)


def put_varint(n: int) -> bytes:
    out = bytearray()
    while True:
        out.append(n & 0x7F | (0x80 if n > 0x7F else 0))
        n >>= 7
        if not n:
            return bytes(out)


def put(number: int, value: int | float | bytes | str) -> bytes:
    """A field: text and bytes by length, floats and ``Fixed`` in eight bytes, other ints as varints."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return put_varint(number << 3 | 2) + put_varint(len(value)) + value
    if isinstance(value, float):
        return put_varint(number << 3 | 1) + struct.pack("<d", value)
    if isinstance(value, Fixed):
        return put_varint(number << 3 | 1) + struct.pack("<Q", value & (2**64 - 1))
    return put_varint(number << 3) + put_varint(value & (2**64 - 1))


class Fixed(int):
    """An int that is written in eight bytes."""


def _put_value(v: str) -> bytes:
    kind, text = v[:1], v[1:]
    if kind == "b":
        return put(2, int(text == "true"))
    if kind in ("i", "u"):
        return put(3, int(text))
    if kind == "f":
        return put(4, float(text))
    return put(7, bytes.fromhex(text)) if kind == "x" else put(1, text)


def put_attributes(number: int, attributes: dict[str, str] | None) -> bytes:
    return b"".join(put(number, put(1, k) + put(2, _put_value(v))) for k, v in sorted((attributes or {}).items()))


def otlp_metric_request(r: dict) -> bytes:
    """An export request of one sum, gauge or histogram row."""
    times = (put(2, Fixed(r["start_ns"])) if r.get("start_ns") else b"") + put(3, Fixed(r["ts_ns"] or 0))
    temp = {"delta": 1, "cumulative": 2}.get(r.get("temporality") or "delta", 1)
    if r["kind"] == "histogram":
        b = r.get("buckets") or []
        total = sum(x["count"] for x in b)
        point = put_attributes(9, r.get("attributes")) + times + put(4, Fixed(total)) + (put(5, float(r["sum"])) if r.get("sum") is not None else b"")
        point += put(6, struct.pack(f"<{len(b)}Q", *[x["count"] for x in b])) + put(7, struct.pack(f"<{max(len(b) - 1, 0)}d", *[x["bound"] for x in b[:-1]]))
        data = put(9, put(1, point) + put(2, temp))
    else:
        number = put(6, Fixed(r["value_i64"])) if r.get("value_type") == "i" and r.get("value_i64") is not None else put(4, float(r["value"]))
        point = put_attributes(7, r.get("attributes")) + times + number
        data = put(7, put(1, point) + put(2, temp) + put(3, int(bool(r.get("monotonic"))))) if r["kind"] == "sum" else put(5, put(1, point))
    metric = put(1, r["name"]) + (put(3, r["unit"]) if r.get("unit") else b"") + data
    return put(1, put(1, put_attributes(1, r.get("resource"))) + put(2, put(2, metric)))


def encode(df: DataFrame, keep: list[str], body_of: Callable[[dict], bytes | None]) -> DataFrame:
    """keep..., body: what ``body_of`` makes of each row; rows that give None are left out."""
    out = T.StructType([*[df.schema[c] for c in keep], T.StructField("body", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            index, bodies = [], []
            for i, r in enumerate(b.to_pylist()):
                made = body_of({k: dict(v) if isinstance(v, list) and v and isinstance(v[0], tuple) else v for k, v in r.items()})
                if made is not None:
                    index.append(i)
                    bodies.append(made)
            at = pa.array(index, pa.int64())
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(at) for c in keep], pa.array(bodies, pa.binary())], names=[*keep, "body"])

    return df.mapInArrow(run, out)


def to_otlp_metrics(m: DataFrame) -> DataFrame:
    """One binary export request per sum, gauge or histogram row with a value."""
    ready = ((F.col("kind").isin("sum", "gauge")) & F.col("value").isNotNull()) | (F.col("kind") == "histogram")
    return encode(m.where(ready), ["_seq"], otlp_metric_request)
