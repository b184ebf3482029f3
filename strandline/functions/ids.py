"""Identifiers: random and time-ordered ids, decimal trace ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed: the alphabet of ULIDs, in order, beside that of base 32 as the JVM spells it.
CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"
BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
MOST_MS = 2**48 - 1


def _hex() -> Column:
    return F.replace(F.uuid(), F.lit("-"), F.lit(""))


def _dashed(h: Column) -> Column:
    return F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def uuid_v4() -> Column:
    """A random UUID."""
    return F.uuid()


def uuid_v7(unix_ms: Column) -> Column:
    """A UUID that starts with the time; null before 1970 and beyond 48 bits."""
    at = F.when(unix_ms.between(0, MOST_MS), F.lower(F.lpad(F.hex(unix_ms.cast("bigint")), 12, "0")))
    return _dashed(F.regexp_replace(F.concat(at, _hex()), r"^(.{12}).{12}.(.{19})$", "$17$2"))


def ulid(unix_ms: Column) -> Column:
    """Ten characters of time and sixteen random ones; null before 1970 and beyond 48 bits."""
    at = F.when(unix_ms.between(0, MOST_MS), F.lpad(F.conv(unix_ms.cast("string"), 10, 32), 10, "0"))
    # the version's nibble of the random hex isn't random: take what stands around it
    part = lambda h, start: F.lpad(F.conv(F.substring(h, start, 10), 16, 32), 8, "0")
    return F.translate(F.concat(at, part(_hex(), 1), part(_hex(), 1)), BASE32, CROCKFORD)


def decimal_hex(c: Column, digits: int = 16) -> Column:
    """Lower-case hex of a decimal uint64 above 0, or null."""
    v = F.when(c.rlike(r"^\d{1,20}$"), c).try_cast("decimal(20,0)")
    ok = (v > 0) & (v <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return F.lpad(F.lower(F.conv(F.when(ok, v.cast("string")), 10, 16)), digits, "0")


def hex_decimal(c: Column) -> Column:
    """Decimal text of up to 16 hex digits, or null."""
    return F.conv(F.when(c.rlike("^[0-9a-fA-F]{1,16}$"), c), 16, 10)
