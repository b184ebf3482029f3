"""Typed attribute values (see ``schema``) as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

FLOAT = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def s(c: Column | str) -> Column:
    """A text value; null stays null (absent)."""
    return F.concat(F.lit("s"), F.lit(c) if isinstance(c, str) else c.cast("string"))


def tagged(c: Column, kind: str) -> Column:
    """A value of the given kind from a column of the matching SQL type."""
    return F.concat(F.lit(kind), c.cast("string"))


def literal(v: object) -> Column:
    """A typed value from a Python constant; non-negative ints are signed, as in configuration."""
    if v is None:
        return F.lit("n")
    if isinstance(v, bool):
        return F.lit("b" + str(v).lower())
    return F.lit(("i" if isinstance(v, int) else "f" if isinstance(v, float) else "s") + str(v))


def kind(v: Column) -> Column:
    return F.substring(v, 1, 1)


def text(v: Column) -> Column:
    """The value without its type."""
    return F.substring(v, 2, 2_147_483_647)


def present(v: Column) -> Column:
    """Neither absent nor null, empty or a dash."""
    return F.coalesce(v.isNotNull() & ~v.isin("n", "s", "s-"), F.lit(False))


def finite(c: Column) -> Column:
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def parse_float(c: Column) -> Column:
    """A finite double from plain decimal text without padding or suffix; else null."""
    return finite(F.when(c.rlike(FLOAT), c).try_cast("double"))


def numeric(v: Column) -> Column:
    """A number or numeric text as finite double; anything else null."""
    return F.when(kind(v).isin("i", "u"), text(v).try_cast("double")).when(kind(v) == "f", finite(text(v).try_cast("double"))).when(kind(v) == "s", parse_float(text(v)))


def float_value(c: Column) -> Column:
    return F.concat(F.lit("f"), c.cast("string"))


def value_matches(want: object, actual: Column) -> Column:
    """Whether a configured constant equals a value: text exactly; numbers and numeric text by number; bools only bools."""
    if isinstance(want, bool):
        hit = actual == f"b{str(want).lower()}"
    elif isinstance(want, (int, float)):
        hit = kind(actual).isin("i", "u", "f", "s") & (numeric(actual) == F.lit(float(want)))
    else:
        hit = (kind(actual).isin("s", "x") & (text(actual) == str(want)))
        try:
            number = float(str(want))
        except ValueError:
            number = None
        if number is not None and number == number and abs(number) != float("inf"):
            hit = hit | (kind(actual).isin("i", "u", "f") & (numeric(actual) == F.lit(number)))
    return F.coalesce(hit, F.lit(False))


def ascii_lower(c: Column) -> Column:
    """Lower case of A to Z only."""
    return F.translate(c, UPPER, LOWER)


def clean(c: Column, most: int) -> Column:
    """Control characters as ``_``, at most ``most`` characters."""
    return F.left(F.regexp_replace(c, "[\\x00-\\x1f\\x7f]", "_"), F.lit(most))


def decimal_nanos(c: Column, digits: int = 9) -> Column:
    """Decimal text in units of 10^-digits s to whole ns, digit-exact; malformed or too large null.

    digits: 9 for seconds, 6 for ms, 3 for us, 0 for ns. Digits finer than ns are cut off.
    """
    ok = c.rlike(r"^-?\d{1,19}(\.\d+)?$")
    t = F.when(ok, c)
    whole = F.regexp_extract(t, r"^-?(\d+)", 1).try_cast("decimal(28,0)")
    frac = F.when(F.lit(digits) > 0, F.substring(F.rpad(F.regexp_extract(t, r"\.(\d+)$", 1), max(digits, 1), "0"), 1, max(digits, 1))).otherwise(F.lit("0")).try_cast("decimal(28,0)")
    total = whole * F.lit(10**digits).cast("decimal(10,0)") + F.coalesce(frac, F.lit(0))
    return (total * F.when(t.startswith("-"), -1).otherwise(1)).try_cast("bigint")


def last_wins() -> None:
    """Session setting under which a map built with a repeated key keeps the later value."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.conf.get("spark.sql.mapKeyDedupPolicy") != "LAST_WIN":
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also inside a lambda."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def merge(base: Column, over: Column) -> Column:
    """Union of two attribute maps in which the right side wins; a null map is empty."""
    last_wins()
    none = F.create_map().cast("map<string,string>")
    return F.map_concat(F.coalesce(base, none), F.coalesce(over, none))


def from_pairs(keys: Column, values: Column) -> Column:
    """Map of two arrays in which a later duplicate wins."""
    last_wins()
    return F.map_from_arrays(keys, values)
