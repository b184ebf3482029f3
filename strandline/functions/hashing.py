"""Consistent hashing that agrees between processes: XXH64 with seed 0 over canonical text."""

from __future__ import annotations

import math

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.values import kind, text


def xxh64(c: Column) -> Column:
    """XXH64, seed 0, of a string's UTF-8 bytes, as BIGINT; Catalyst's own expression."""
    jvm = SparkContext._active_spark_context._jvm
    utils = jvm.org.apache.spark.sql.classic.ExpressionUtils
    children = jvm.java.util.ArrayList()
    children.add(utils.expression(c._jc))
    hashed = utils.column(jvm.org.apache.spark.sql.catalyst.expressions.XxHash64(jvm.scala.jdk.javaapi.CollectionConverters.asScala(children).toSeq(), 0))
    return F.when(c.isNotNull(), Column(hashed))


def plain_decimal(c: Column) -> Column:
    """A double as plain decimal text, never with exponent."""
    whole = (c == F.floor(c)) & (F.abs(c) < 9e15)
    d = F.regexp_replace(c.cast("string").try_cast("decimal(38,18)").cast("string"), r"\.?0+$", "")
    return F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").when(c.cast("string") == "-0.0", "-0").when(whole, c.cast("bigint").cast("string")).otherwise(d)


def hash_value(v: Column) -> Column:
    """Hash of a typed value; null, arrays and maps have none. Bytes hash as their hex text's bytes do not: unhex first."""
    k = kind(v)
    return F.when(k.isin("s", "i", "u", "b", "t"), xxh64(text(v))).when(k == "f", xxh64(plain_decimal(text(v).try_cast("double"))))


def keep(hashed: Column, rate: float) -> Column:
    """Whether the top 53 bits fall below rate; a rate of 1 or more, or NaN, keeps all."""
    if math.isnan(rate) or rate >= 1:
        return F.lit(True)
    if rate <= 0:
        return F.lit(False)
    return F.shiftrightunsigned(hashed, 11) < F.lit(int(rate * 2**53))
