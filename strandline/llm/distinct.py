"""Distinct counts over identifier sets too large to hold.

Each group keeps the k smallest hash values of its identifiers below a threshold theta,
as Spark's theta sketches do: partial sketches merge by keeping the smallest, so they
combine over partitions, days and any grouping. A set of at most k identifiers is
counted exactly; beyond that the estimate is retained / theta, with the relative
standard error 1 / sqrt(k). Unions, intersections and differences come from the
merged hash values, with bounds of the chosen number of standard errors.

Nulls: a null identifier counts nothing; a null group column is a group. Repeated
rows change no sketch. An empty table gives no groups. Identifiers enter as 64-bit
hashes; among 10^9 of them that adds an error of about 3e-11.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions.identity import blank_trim

#: log2 of k. k = 4096: 1.6 % standard error, at most 64 KB a group.
LG_K = 12


def hex_number(c: Column) -> Column:
    """One spelling of a hexadecimal number: no blanks, 0x, dashes, leading zeros; zero and non-numbers null."""
    h = F.regexp_replace(F.regexp_replace(F.lower(blank_trim(c)), "^0x", ""), "-", "")
    return F.nullif(F.regexp_replace(F.when(h.rlike("^[0-9a-f]+$"), h), "^0+", ""), F.lit(""))


def sketches(df: DataFrame, group: list[str], ident: str, lg_k: int = LG_K) -> DataFrame:
    """group -> n (rows with an identifier) and sketch; aggregated map-side."""
    d = df.where(F.col(ident).isNotNull()).withColumn("_h", F.xxhash64(ident))
    return d.groupBy(*group).agg(F.count("*").alias("n"), F.expr(f"theta_sketch_agg(_h, {lg_k})").alias("sketch"))


def merge(parts: DataFrame, group: list[str], lg_k: int = LG_K) -> DataFrame:
    """Partial results of ``sketches`` combined to a coarser grouping."""
    return parts.groupBy(*group).agg(F.sum("n").alias("n"), F.expr(f"theta_union_agg(sketch, {lg_k})").alias("sketch"))


def estimate(sketch: str) -> Column:
    return F.expr(f"theta_sketch_estimate({sketch})").cast("double")


def with_bounds(df: DataFrame, est: str, union: str | None = None, lg_k: int = LG_K, sigmas: float = 2.0) -> DataFrame:
    """lower and upper of ``est``; for a set operation give the column with its union's estimate."""
    k = float(2**lg_k)
    over = F.greatest(F.col(union or est) / k - 1, F.lit(0.0))
    err = sigmas * F.sqrt(F.greatest(F.col(est), F.when(over > 0, 1.0).otherwise(0.0)) * over)
    return df.withColumn("lower", F.greatest(F.col(est) - err, F.lit(0.0))).withColumn("upper", F.col(est) + err)


def set_operations(a: Column, b: Column) -> list[Column]:
    """Estimates of the union, the intersection and the difference of two sketch columns."""
    f = F.call_function
    return [
        f("theta_sketch_estimate", f("theta_union", a, b)).cast("double").alias("in_union"),
        f("theta_sketch_estimate", f("theta_intersection", a, b)).cast("double").alias("in_both"),
        f("theta_sketch_estimate", f("theta_difference", a, b)).cast("double").alias("in_first_only"),
    ]
