"""Profile of the shape of events: sizes, depths and key sets, without any of their contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions import values as V
from strandline.operators.filters import carries


def measure(events: DataFrame) -> DataFrame:
    """Per event: signal, attribute count, key and value bytes, counts by value type, metrics, body bytes, key set."""
    a = F.coalesce("_a", F.create_map().cast("map<string,string>"))
    signal = F.when(carries("logs"), "log").when(carries("traces"), "trace").when(carries("metrics"), "metric").otherwise("none")
    nested = F.filter(F.map_values(a), lambda v: V.kind(v).isin("a", "m"))
    types = F.map_from_entries(F.transform(F.array(*[F.lit(t) for t in "siufbntxam"]), lambda t: F.struct(t, F.size(F.filter(F.map_values(a), lambda v: V.kind(v) == t)))))
    # nesting of a JSON text without its strings: the most brackets open at once; 1 for plain values
    def open_most(v: Column) -> Column:
        marks = F.split(F.regexp_replace(F.regexp_replace(V.text(v), r'"(?:[^"\\\\]|\\\\.)*"', ""), r"[^\[\]{}]", ""), "")
        start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))
        step = lambda s, c: V.let(s["now"] + F.when(c.isin("[", "{"), 1).when(c.isin("]", "}"), -1).otherwise(0), lambda n: F.struct(n.alias("now"), F.greatest(n, s["most"]).alias("most")))
        return F.aggregate(marks, start, step)["most"] + 1
    depth = F.when(F.size(a) == 0, 0).otherwise(F.coalesce(F.array_max(F.transform(nested, open_most)), F.lit(1)))
    widths = F.coalesce(F.array_max(F.transform(F.filter(nested, lambda v: V.kind(v) == "m"), lambda v: F.size(F.from_json(V.text(v), "map<string,variant>")))), F.lit(0))
    kinds = F.map_from_entries(F.transform(F.array_distinct(F.transform("metrics", lambda m: m["kind"])), lambda k: F.struct(k, F.size(F.filter("metrics", lambda m: m["kind"] == k)))))
    return events.withColumnRenamed("attributes", "_a").select(
        "_origin", "_previous", signal.alias("signal"), F.size(a).alias("attributes"), F.size(nested).alias("nested"), types.alias("types"),
        F.aggregate(F.map_keys(a), F.lit(0).cast("bigint"), lambda n, k: n + F.octet_length(k)).alias("key_bytes"),
        F.aggregate(F.map_values(a), F.lit(0).cast("bigint"), lambda n, v: n + F.octet_length(v) - 1).alias("value_bytes"),
        depth.alias("depth"), widths.alias("max_map_width"), kinds.alias("metric_kinds"), F.coalesce(F.size("metrics"), F.lit(0)).alias("n_metrics"), F.coalesce(F.octet_length("log.message"), F.lit(0)).alias("body_bytes"),
        F.array_sort(F.map_keys(a)).alias("key_set"),
    )


def summarise(measures: DataFrame, by: list[str], max_keys: int = 4096, max_sets: int = 4096) -> DataFrame:
    """Per group: events, sizes, distinct keys and key sets, the shares of the one and five most frequent key sets, overflow."""
    sizes = measures.groupBy(*by).agg(F.count("*").alias("events"), F.sum("attributes").alias("attributes"), F.max("attributes").alias("max_attributes"), F.sum("key_bytes").alias("key_bytes"), F.sum("value_bytes").alias("value_bytes"), F.sum("body_bytes").alias("body_bytes"))
    sets = measures.groupBy(*by, "key_set").agg(F.count("*").alias("n"))
    # the five most frequent of every salted part hold the five most frequent of all
    part = F.row_number().over(W.partitionBy(*by, F.pmod(F.xxhash64("key_set"), F.lit(32))).orderBy(F.desc("n"))) <= 5
    most = F.sort_array(F.collect_list(F.when(F.col("_part"), F.col("n"))), False)
    tops = sets.withColumn("_part", part).groupBy(*by).agg(F.count("*").alias("distinct_key_sets"), most.alias("_most"), F.sum("n").alias("_n"))
    tops = tops.withColumn("top1", F.col("_most")[0]).withColumn("top5", F.aggregate(F.slice("_most", 1, 5), F.lit(0).cast("bigint"), lambda a, x: a + x)).drop("_most")
    keys = sets.select(*by, F.explode("key_set").alias("k")).groupBy(*by).agg(F.count_distinct("k").alias("distinct_keys"))
    out = sizes.join(tops, by).join(keys, by, "left").withColumn("distinct_keys", F.coalesce("distinct_keys", F.lit(0)))
    out = out.withColumn("share_top1", F.col("top1") / F.col("_n")).withColumn("share_top5", F.col("top5") / F.col("_n"))
    return out.withColumn("overflow", (F.col("distinct_keys") > max_keys) | (F.col("distinct_key_sets") > max_sets)).drop("top1", "top5", "_n")
