"""Exact percentiles of very large columns by bisection.

Per group and percentile an interval of values is kept. Each pass cuts every open
interval at many midpoints at once, counts the weight of the rows between them, and
keeps the piece that holds the target rank, narrowed to the smallest and largest value
in it. It ends when every interval is one value, so the result is exact. Each pass
settles at least the two ends of an interval, and in practice leaves a 256th of it.
Counts add over partitions and days: any coarser grouping uses the same base table.

The percentile q of a group is its smallest value v with weight(<= v) >= q * weight.

Nulls: null or NaN values and null, NaN or non-positive weights count nothing; a null
group column is a group; a group without weight gives no row. -0.0 counts as 0.0. Ties
of values are one value. A hot group costs no task more than others: its
rows spread by value and are counted map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.shared import join_sized, materialise, release, scratch

PIECES = 256


def base_table(df: DataFrame, group: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """Weight per (group, value), written once and read by every pass."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    d = df.select(*group, (F.col(value).cast("double") + F.lit(0.0)).alias("value"), w.alias("w"))
    d = d.where("value is not null and not isnan(value) and w > 0 and not isnan(w)")
    return materialise(d.groupBy(*group, "value").agg(F.sum("w").alias("w")))


def percentiles(base: DataFrame, group: list[str], qs: list[float], pieces: int = PIECES, passes: int | None = None) -> DataFrame:
    """(group..., q, value, weight) from a ``base_table``; base may have more group columns.

    Passes go on until no interval is open; with ``passes`` it fails if some still is after so many.
    """
    keys = [*group, "q"]
    state = base.groupBy(*group).agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.sum("w").alias("total")).where("total > 0")
    state = state.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in qs]))).withColumn("below", F.lit(0.0)).select(*keys, "lo", "hi", "total", "below")
    made, old = 0, None
    while True:
        path = scratch(base.sparkSession)
        state = materialise(state, path)
        if old:
            release(old)
        old = path
        open_ = state.where("lo < hi")
        n = open_.count()
        if not n:
            break
        if passes is not None and made >= passes:
            raise RuntimeError(f"{n} intervals are open after {passes} passes")
        made += 1
        names = {g: f"_g{i}" for i, g in enumerate(group)}
        right = open_.withColumnsRenamed(names).withColumn("_key", F.to_json(F.struct(*names.values())) if group else F.lit(""))
        left = base.withColumn("_key", F.to_json(F.struct(*[F.col(g).alias(names[g]) for g in group])) if group else F.lit(""))
        per_key = right.groupBy("_key").agg(F.collect_list(F.struct("q", "lo", "hi")).alias("s"))
        d = join_sized(left.select("_key", *group, "value", "w"), per_key, ["_key"], rows=n)
        d = d.withColumn("s", F.explode(F.filter("s", lambda s: F.col("value").between(s["lo"], s["hi"]))))
        step = (F.col("s.hi") / pieces - F.col("s.lo") / pieces)
        piece = F.least(F.floor((F.col("value") / pieces - F.col("s.lo") / pieces) / step * pieces), F.lit(pieces - 1)).cast("int")
        # the range's ends are pieces of their own, so that every pass narrows
        piece = F.when(F.col("value") == F.col("s.lo"), -1).when(F.col("value") == F.col("s.hi"), pieces).otherwise(piece)
        hist = d.groupBy(*group, F.col("s.q").alias("q"), piece.alias("piece")).agg(F.sum("w").alias("w"), F.min("value").alias("plo"), F.max("value").alias("phi"))
        cum = F.sum("w").over(W.partitionBy(*keys).orderBy("piece"))
        st = open_.select(*[F.col(k).alias(f"_s{i}") for i, k in enumerate(keys)], "total", "below")
        cond = F.lit(True)
        for i, k in enumerate(keys):
            cond = cond & F.col(k).eqNullSafe(F.col(f"_s{i}"))
        h = hist.withColumn("cum", cum).join(st, cond)
        reached = F.col("below") + F.col("cum") >= F.col("q") * F.col("total") * (1 - 1e-12)
        pick = F.coalesce(
            F.min(F.when(reached, F.struct("piece", "plo", "phi", (F.col("below") + F.col("cum") - F.col("w")).alias("below"), "total"))),
            F.max(F.struct("piece", "plo", "phi", (F.col("below") + F.col("cum") - F.col("w")).alias("below"), "total")),
        )
        narrowed = h.groupBy(*keys).agg(pick.alias("p")).select(*keys, F.col("p.plo").alias("lo"), F.col("p.phi").alias("hi"), F.col("p.total").alias("total"), F.col("p.below").alias("below"))
        state = state.where("lo = hi").unionByName(narrowed)
    return state.select(*keys, F.col("lo").alias("value"), F.col("total").alias("weight"))


def store_bins(store: str, gamma: str, offset: str, sign: int) -> Column:
    """A sketch's store as array of (value, w); both encodings, null counts and stores give none.

    A bin's value is the middle of its bounds, off by at most half its width.
    """
    def at(i: Column, w: Column) -> Column:
        low = F.pow(F.col(gamma), i.cast("double") - F.col(offset))
        return F.struct((F.lit(float(sign)) * low * (1 + F.col(gamma)) / 2).alias("value"), w.cast("double").alias("w"))

    sparse = F.transform(F.filter(F.map_entries(F.col(f"{store}.bin_counts")), lambda e: e["value"] > 0), lambda e: at(e["key"], e["value"]))
    first = F.coalesce(F.col(f"{store}.contiguous_bin_index_offset"), F.lit(0))
    dense = F.filter(F.transform(F.col(f"{store}.contiguous_bin_counts"), lambda c, i: at(first + i, c)), lambda x: x["w"] > 0)
    none = F.array().cast("array<struct<value:double,w:double>>")
    return F.concat(F.coalesce(sparse, none), F.coalesce(dense, none))


def sketch_values(sketches: DataFrame, keep: list[str]) -> DataFrame:
    """keep..., value, w: the weighted values that the sketches hold; merging is summing."""
    zero = F.when(F.col("zero_count") > 0, F.array(F.struct(F.lit(0.0).alias("value"), F.col("zero_count").cast("double").alias("w"))))
    none = F.array().cast("array<struct<value:double,w:double>>")
    bins = F.concat(store_bins("positive_values", "gamma", "index_offset", 1), store_bins("negative_values", "gamma", "index_offset", -1), F.coalesce(zero, none))
    # outer: a plain explode would add a filter on the array size that computes the bins twice
    return sketches.select(*keep, F.inline_outer(bins)).where("value is not null")
