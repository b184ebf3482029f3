"""Relative-error quantile sketches as plain grouped sums.

A sketch is a map from signed bin key to weight. The key of a value is a closed-form
expression, so building is GROUP BY key, merging is summing, and a quantile is a running
sum: Spark's partial aggregation does the rest, and SQL engines can check it.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

GAMMA_LN = math.log1p(1 / 64)
OFFSET = 1 - math.floor(math.log(1e-9) / GAMMA_LN)
SMALLEST = math.exp(GAMMA_LN * (1 - OFFSET))
TOP_KEY = 32767
BINS = 4096


def key(v: Column) -> Column:
    """Signed bin of a value: 0 for magnitudes below the smallest, null for non-finite."""
    m = F.abs(v)
    k = F.least(F.greatest(F.rint(F.log(m) / F.lit(GAMMA_LN)) + OFFSET, F.lit(1)), F.lit(TOP_KEY - 1)).cast("int")
    signed = F.when(m < SMALLEST, F.lit(0)).when(v < 0, -k).otherwise(k)
    return F.when(~F.isnan(v) & (m != float("inf")), signed)


def representative(k: Column) -> Column:
    """Value that stands for a bin."""
    r = F.exp(F.lit(GAMMA_LN) * (F.abs(k) - OFFSET))
    return F.when(k == 0, 0.0).when(k < 0, -r).otherwise(r)


def weight(rate: Column) -> Column:
    """Observations that one sampled value stands for: round(1 / rate), from 1 to 1000; a bad rate gives 1."""
    ok = (rate > 0) & (rate <= 1)
    return F.when(ok, F.least(F.greatest(F.round(1 / rate), F.lit(1.0)), F.lit(1000.0))).otherwise(1.0)


def bins(df: DataFrame, group: list[str], value: str, weight_col: Column | None = None) -> DataFrame:
    """group..., key, w and exact n, sum, min, max parts; rows with no finite value are left out."""
    w = weight_col if weight_col is not None else F.lit(1.0)
    d = df.select(*group, F.col(value).alias("_v"), w.alias("_w")).withColumn("key", key(F.col("_v"))).where("key is not null")
    return d.groupBy(*group, "key").agg(F.sum("_w").alias("w"), F.sum(F.col("_v") * F.col("_w")).alias("sum"), F.min("_v").alias("min"), F.max("_v").alias("max"))


def bin_map(entries: Column, limit: int = BINS) -> Column:
    """Map of an array of (key, w), distinct keys; beyond ``limit`` bins the lowest fold into the lowest that stays.

    There are at most 2 * TOP_KEY keys, so the array is bounded.
    """
    down = F.sort_array(entries, False)
    rest = F.slice(down, limit, F.greatest(F.size(down) - limit + 1, F.lit(1)))
    folded = F.struct(F.element_at(down, F.lit(limit))["key"].alias("key"), F.aggregate(rest, F.lit(0.0), lambda n, e: n + e["w"]).alias("w"))
    return F.map_from_entries(F.when(F.size(down) <= limit, down).otherwise(F.concat(F.slice(down, 1, limit - 1), F.array(folded))))


def map_quantiles(bins_map: Column, qs: list[float]) -> list[Column]:
    """Per q the bin that holds rank rint(q * (weight - 1)) of a sketch's map."""
    up = F.sort_array(F.map_entries(bins_map))
    n = F.aggregate(up, F.lit(0.0), lambda a, e: a + e["value"])
    start = F.struct(F.lit(0.0).alias("c"), F.lit(None).cast("int").alias("k"))

    def pick(q: float) -> Column:
        def step(a: Column, e: Column) -> Column:
            c = a["c"] + e["value"]
            return F.struct(c.alias("c"), F.coalesce(a["k"], F.when(c > F.rint(F.lit(q) * (n - 1)), e["key"])).alias("k"))
        return F.aggregate(up, start, step)["k"]
    return [pick(q) for q in qs]


def quantiles(b: DataFrame, group: list[str], qs: list[float]) -> DataFrame:
    """group..., count, sum, min, max and, per q, the bin key ``k_<q>``: rank rint(q * (count - 1))."""
    cum = F.sum("w").over(W.partitionBy(*group).orderBy("key"))
    n = F.sum("w").over(W.partitionBy(*group))
    d = b.withColumn("_c", cum).withColumn("_n", n)
    picks = [F.min(F.when(F.col("_c") > F.rint(F.lit(q) * (F.col("_n") - 1)), F.col("key"))).alias(f"k_{q:g}".replace(".", "_")) for q in qs]
    return d.groupBy(*group).agg(F.sum("w").alias("count"), F.sum("sum").alias("sum"), F.min("min").alias("min"), F.max("max").alias("max"), *picks)
