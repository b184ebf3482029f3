"""Log lines of unlike programs as entries with fields.

A deterministic machine reads each line character by character. Its first state looks
at one character and picks a grammar or rejects the line, so continuations cost
one step; the grammars then consume delimiters, brackets, quotes and timestamps
and assign fields. A line is a head only if it opens with a whole header that states a
time of day; every other line continues the last head of its stream.

Continuations are attached in blocks of ``BLOCK`` line numbers: within a block the
last head runs along; each block hands its last head to the blocks after it, of which
there are few, so a stream may hold any share of the lines. Repeats of one line number
are lines of one block.

Nulls: a line without stream or number belongs to no entry; a null text is a
continuation. Equal (stream, number) are ordered by line id. Fields that the header
doesn't state, or states as ``-``, are empty strings.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions.shared import join_sized, materialise

BLOCK = 4096
FIELDS = ["timestamp", "host_name", "syslog_tag", "process_pid", "syslog_msgid", "severity", "message"]
HEAD = T.StructType([T.StructField(f, T.StringType()) for f in FIELDS])

#: Fixed: priority code modulo 8, and level words and letters, to severity.
BY_CODE = ["fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug"]
BY_WORD = {
    "trace": "trace", "debug": "debug", "dbg": "debug", "info": "info", "notice": "info", "information": "info",
    "warn": "warn", "warning": "warn", "err": "error", "error": "error", "severe": "error",
    "crit": "fatal", "critical": "fatal", "panic": "fatal", "fatal": "fatal", "emerg": "fatal", "alert": "fatal",
    "t": "trace", "d": "debug", "i": "info", "w": "warn", "e": "error", "f": "fatal",
}
MONTHS = {"Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"}
DIGITS = frozenset("0123456789")


class _Reject(Exception):
    """The line doesn't fit the grammar it was started in."""


class Scanner:
    """Cursor over one line; each method consumes one kind of token or rejects."""

    __slots__ = ("s", "i", "n")

    def __init__(self, s: str) -> None:
        self.s, self.i, self.n = s, 0, len(s)

    def peek(self) -> str:
        return self.s[self.i] if self.i < self.n else ""

    def lit(self, text: str) -> None:
        for ch in text:
            if self.i >= self.n or self.s[self.i] != ch:
                raise _Reject
            self.i += 1

    def digits(self, least: int, most: int) -> str:
        start = self.i
        while self.i < self.n and self.i - start < most and self.s[self.i] in DIGITS:
            self.i += 1
        if self.i - start < least:
            raise _Reject
        return self.s[start : self.i]

    def until(self, stops: str, end: bool = False) -> str:
        """Up to the first stop character, which stays; at the line's end only if ``end``."""
        start = self.i
        while self.i < self.n and self.s[self.i] not in stops:
            self.i += 1
        if self.i >= self.n and not end:
            raise _Reject
        return self.s[start : self.i]

    def blanks(self) -> None:
        while self.i < self.n and self.s[self.i] in " \t":
            self.i += 1

    def month(self) -> str:
        m = self.s[self.i : self.i + 3]
        if m not in MONTHS:
            raise _Reject
        self.i += 3
        return m

    def clock(self, fraction: str = "") -> None:
        self.digits(2, 2)
        self.lit(":")
        self.digits(2, 2)
        self.lit(":")
        self.digits(2, 2)
        if fraction and self.peek() and self.peek() in fraction:
            self.i += 1
            self.digits(1, 9)

    def zone(self) -> None:
        ch = self.peek()
        if ch == "Z":
            self.i += 1
        elif ch and ch in "+-":
            self.i += 1
            self.digits(2, 2)
            if self.peek() == ":":
                self.i += 1
            self.digits(2, 2)

    def iso(self) -> str:
        start = self.i
        self.digits(4, 4)
        self.lit("-")
        self.digits(2, 2)
        self.lit("-")
        self.digits(2, 2)
        if self.peek() not in ("T", " "):
            raise _Reject
        self.i += 1
        self.clock(".,")
        self.zone()
        return self.s[start : self.i]

    def quoted(self) -> str:
        """A double-quoted string with backslash escapes."""
        self.lit('"')
        out, start = [], self.i
        while self.i < self.n:
            ch = self.s[self.i]
            if ch == '"':
                out.append(self.s[start : self.i])
                self.i += 1
                return "".join(out)
            if ch == "\\" and self.i + 1 < self.n:
                out.append(self.s[start : self.i])
                nxt = self.s[self.i + 1]
                if nxt == "u" and self.i + 5 < self.n:
                    try:
                        out.append(chr(int(self.s[self.i + 2 : self.i + 6], 16)))
                    except ValueError:
                        raise _Reject from None
                    self.i += 6
                else:
                    out.append({"n": "\n", "t": "\t", "r": "\r"}.get(nxt, nxt))
                    self.i += 2
                start = self.i
                continue
            self.i += 1
        raise _Reject

    def rest(self) -> str:
        return self.s[self.i :].rstrip("\r\n")


def _syslog(c: Scanner) -> dict[str, str]:
    if c.peek() != "<":  # octet-counted: the length comes first
        c.digits(1, 6)
        c.lit(" ")
    c.lit("<")
    code = int(c.digits(1, 3))
    c.lit(">")
    if code > 191:
        raise _Reject
    out = {"severity": BY_CODE[code % 8]}
    if c.peek() in DIGITS:
        c.digits(1, 2)
        c.lit(" ")
        out["timestamp"] = c.iso()
        for f in ("host_name", "syslog_tag", "process_pid", "syslog_msgid"):
            c.lit(" ")
            out[f] = c.until(" ", end=f == "syslog_msgid")
        if c.peek() == " ":
            c.lit(" ")
            while c.peek() == "[":  # structured data, quotes inside brackets
                while c.until('"]') is not None and c.peek() == '"':
                    c.quoted()
                c.lit("]")
            if c.peek() == "-":
                c.i += 1
            c.blanks()
        out["message"] = c.rest()
        return out
    start = c.i
    c.month()
    c.lit(" ")
    c.blanks()
    c.digits(1, 2)
    c.lit(" ")
    if c.i + 4 < c.n and c.s[c.i + 4] == " ":  # a year before the time
        c.digits(4, 4)
        c.lit(" ")
    c.clock(".")
    out["timestamp"] = c.s[start : c.i]
    c.lit(" ")
    word = c.until(" :[", end=True)
    if c.peek() == " " and c.i + 1 < c.n:  # a host precedes the tag
        at = c.i
        c.i += 1
        tag = c.until(" :[", end=True)
        if c.peek() in (":", "["):
            out["host_name"], word = word, tag
        else:
            out["host_name"], word, c.i = word, "", at + 1
    out["syslog_tag"] = word
    if word and c.peek() == "[":
        c.i += 1
        out["process_pid"] = c.until("]")
        c.i += 1
    if word and c.peek() == ":":
        c.i += 1
    c.blanks()
    out["message"] = c.rest()
    return out


def _pairs(c: Scanner) -> dict[str, str]:
    names = {"ts": "timestamp", "time": "timestamp", "level": "severity", "component": "syslog_tag", "logger": "syslog_tag", "host": "host_name", "pid": "process_pid", "msgid": "syslog_msgid", "msg": "message"}
    out: dict[str, str] = {}
    c.lit("ts=")
    out["timestamp"] = c.iso()
    c.blanks()
    while c.i < c.n and c.peek() not in "\r\n":
        key = c.until("= ", end=True)
        if c.peek() != "=":
            c.blanks()
            continue
        c.i += 1
        value = c.quoted() if c.peek() == '"' else c.until(" \r\n", end=True)
        if key in names:
            out.setdefault(names[key], value)
        c.blanks()
    return out


def _json(c: Scanner) -> dict[str, str]:
    names = {"time": "timestamp", "ts": "timestamp", "level": "severity", "logger": "syslog_tag", "component": "syslog_tag", "host": "host_name", "pid": "process_pid", "msgid": "syslog_msgid", "message": "message", "msg": "message"}
    out: dict[str, str] = {}
    c.lit("{")
    while True:
        c.blanks()
        key = c.quoted()
        c.blanks()
        c.lit(":")
        c.blanks()
        ch = c.peek()
        if ch == '"':
            value = c.quoted()
        elif ch and ch in "{[":
            depth, start = 0, c.i
            while True:
                ch = c.peek()
                if ch == "":
                    raise _Reject
                if ch == '"':
                    c.quoted()
                    continue
                depth += (ch in "{[") - (ch in "}]")
                c.i += 1
                if depth == 0:
                    break
            value = c.s[start : c.i]
        else:
            value = c.until(",} \t")
            value = "" if value == "null" else value
        if key in names:
            out.setdefault(names[key], value)
        c.blanks()
        if c.peek() == ",":
            c.i += 1
            continue
        c.lit("}")
        break
    t = Scanner(out.get("timestamp", ""))
    t.iso()
    return out


def _bracketed(c: Scanner) -> dict[str, str]:
    c.lit("[")
    start = c.i
    c.digits(2, 2)
    c.lit("/")
    c.month()
    c.lit("/")
    c.digits(4, 4)
    c.lit(":")
    c.clock(".")
    c.blanks()
    c.zone()
    out = {"timestamp": c.s[start : c.i]}
    c.lit("] [")
    part = c.until("]")
    out["syslog_tag"], _, out["severity"] = part.rpartition(":")
    c.lit("]")
    c.blanks()
    if c.s.startswith("[pid ", c.i):
        c.i += 5
        out["process_pid"] = c.until("]")
        c.i += 1
        c.blanks()
    out["message"] = c.rest()
    return out


def _dated(c: Scanner) -> dict[str, str]:
    out = {"timestamp": c.iso()}
    c.lit(" ")

    def colour() -> None:
        if c.peek() == "\x1b":
            c.until("m")
            c.i += 1

    colour()
    out["severity"] = c.until(" \x1b[")
    if out["severity"].lower() not in BY_WORD:
        raise _Reject
    colour()
    c.blanks()
    c.lit("[")
    out["syslog_tag"] = c.until("]")
    c.i += 1
    c.blanks()
    if c.s.startswith("(pid ", c.i):
        c.i += 5
        out["process_pid"] = c.until(")")
        c.i += 1
        c.blanks()
    out["message"] = c.rest()
    return out


def _lettered(c: Scanner) -> dict[str, str]:
    out = {"severity": c.peek()}
    c.i += 1
    start = c.i
    c.digits(4, 4)
    c.lit(" ")
    c.clock(".")
    out["timestamp"] = c.s[start : c.i]
    c.lit(" ")
    c.blanks()
    out["process_pid"] = c.until(" ")
    c.blanks()
    out["syslog_tag"] = c.until("] ")
    c.lit("]")
    c.blanks()
    out["message"] = c.rest()
    return out


#: First character -> the grammars to try.
START = {"<": (_syslog,), "t": (_pairs,), "{": (_json,), "[": (_bracketed,)} | {d: (_syslog, _dated) for d in DIGITS} | {x: (_lettered,) for x in "TDIWEF"}


def head(line: str | None) -> tuple[str, ...] | None:
    """The header's fields in the order of FIELDS, or None for a continuation."""
    for grammar in START.get(line[0], ()) if line else ():
        try:
            out = grammar(Scanner(line))
        except _Reject:
            continue
        level = out.get("severity", "")
        out["severity"] = level if grammar is _syslog else BY_WORD.get(level.lower(), "")
        return tuple("" if (v := out.get(f, "")) == "-" and f != "message" else v for f in FIELDS)
    return None


@F.pandas_udf(HEAD)
def parse_heads(lines: pd.Series) -> pd.DataFrame:
    """Null in every field for a continuation."""
    none = (None,) * len(FIELDS)
    return pd.DataFrame([head(x) or none for x in lines], columns=FIELDS)


def attach(lines: DataFrame, stream: str = "stream_id", number: str = "line_no", line_id: str = "line_id", text: str = "raw_line", keep_text: bool = False) -> DataFrame:
    """(line_id, stream_id, line_no, head fields h, block, head_line_id within the block or null), with raw_line if ``keep_text``.

    The machine's first state, the look at one character, is taken before rows go to
    Python, so a continuation's text never does.
    """
    opens = F.substring(F.col(text), 1, 1).isin(sorted(START))
    d = lines.where(F.col(stream).isNotNull() & F.col(number).isNotNull()).select(
        F.col(line_id).alias("line_id"), F.col(stream).alias("stream_id"), F.col(number).alias("line_no"), *([F.col(text).alias("raw_line")] if keep_text else []), parse_heads(F.when(opens, F.col(text))).alias("h")
    )
    d = d.withColumn("block", F.expr(f"line_no div {BLOCK}"))
    w = W.partitionBy("stream_id", "block").orderBy("line_no", "line_id").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("head_line_id", F.last(F.when(F.col("h.timestamp").isNotNull(), F.col("line_id")), ignorenulls=True).over(w))


def entries(lines: DataFrame, with_message: bool = False, **names: str) -> DataFrame:
    """One row per entry: head_line_id, n_lines and the header's fields.

    ``with_message`` adds the message, its lines joined in order, and ``part``: an entry
    of more than ``BLOCK`` lines comes as one row per block of its lines, numbered by
    part, so that no row holds an unbounded text; all others are one row of part 0.

    Lines are parsed once: they are reduced to one row per (stream, block, head), which
    is written, and the last head of each block is carried on among these.
    """
    a = attach(lines, keep_text=with_message, **names)
    texts = []
    if with_message:
        one = F.struct("line_no", "line_id", F.when(F.col("line_id") == F.col("head_line_id"), F.col("h.message")).otherwise(F.regexp_replace("raw_line", "\r$", "")).alias("text"))
        texts = [F.collect_list(F.when(F.col("raw_line").isNotNull(), one)).alias("parts")]
    head_fields = [f for f in FIELDS if f != "message"]
    header = F.struct(*[F.col(f"h.{f}").alias(f) for f in head_fields])
    own = materialise(a.groupBy("stream_id", "block", "head_line_id").agg(
        F.count("*").alias("n_lines"), F.max(F.when(F.col("h.timestamp").isNotNull(), header)).alias("h"), F.max(F.struct("line_no", "line_id")).alias("last"), *texts))
    per = own.where("head_line_id is not null").groupBy("stream_id", "block").agg(F.max(F.struct("last", "head_line_id"))["head_line_id"].alias("last_head"))
    led = own.where("head_line_id is null").select("stream_id", "block")
    w = W.partitionBy("stream_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = per.unionByName(led.withColumn("last_head", F.lit(None).cast(dict(per.dtypes)["last_head"]))).groupBy("stream_id", "block").agg(F.max("last_head").alias("last_head"))
    carry = blocks.withColumn("carry", F.last("last_head", ignorenulls=True).over(w)).where("carry is not null").select("stream_id", "block", "carry")
    rest = own.where("head_line_id is null").join(carry, ["stream_id", "block"]).withColumn("head_line_id", F.col("carry")).select(own.columns)
    heads = own.where("head_line_id is not null")
    fields = [F.col(f"h.{f}").alias(f) for f in head_fields]
    # a head has one row of its own block; lines of later blocks are at most one row a block
    more = rest.groupBy("stream_id", "head_line_id").agg(F.sum("n_lines").alias("more"))
    whole = join_sized(heads.select("stream_id", "head_line_id", "n_lines", "h"), more, ["stream_id", "head_line_id"], "left")
    whole = whole.select("stream_id", "head_line_id", (F.col("n_lines") + F.coalesce("more", F.lit(0))).alias("n_lines"), "h")
    if not with_message:
        return whole.select("head_line_id", "n_lines", *fields)
    every = heads.unionByName(rest)
    # long entries stay in their blocks, which are parts; numbered among the few blocks of an entry
    every = every.where("size(parts) > 0").select("stream_id", "head_line_id", "block", "parts").join(whole.withColumnRenamed("n_lines", "total"), ["stream_id", "head_line_id"])
    pieces = every.groupBy("stream_id", "head_line_id", F.when(F.col("total") > BLOCK, F.col("block")).alias("_at")).agg(F.first("total").alias("n_lines"), F.first("h").alias("h"), F.flatten(F.collect_list("parts")).alias("parts"))
    part = F.when(F.col("_at").isNull(), 0).otherwise(F.row_number().over(W.partitionBy("stream_id", "head_line_id").orderBy("_at")) - 1)
    return pieces.select("head_line_id", part.alias("part"), "n_lines", *fields, F.array_join(F.transform(F.array_sort("parts"), lambda p: p["text"]), "\n").alias("message"))
