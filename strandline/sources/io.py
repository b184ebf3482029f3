"""Sources and sinks by name, batch and streaming, over Spark's own readers and writers.

A text source gives (line, _seq, ts_ns): _seq numbers lines within the run in file
order, ts_ns is the given receipt time. Listeners on sockets are left to what feeds
Spark (files, Kafka, the socket source); formats are decoded the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import values as V
from strandline.sources import binary, json_formats, text


def lines(spark: SparkSession, path: str, received_ns: int = 0) -> DataFrame:
    """Lines of files, plain or compressed. Order within a file follows its position."""
    d = spark.read.text(path)
    return d.select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_seq"), F.lit(received_ns).cast("bigint").alias("ts_ns"), F.input_file_name().alias("file"))


def tail(spark: SparkSession, path: str, per_trigger: int = 1000) -> DataFrame:
    """Streaming lines of files that appear under ``path``; progress is the query's checkpoint.

    ``_seq`` numbers the lines of a micro-batch in file order; ts_ns is the batch's time.
    """
    d = spark.readStream.option("maxFilesPerTrigger", per_trigger).text(path)
    now = F.unix_micros(F.current_timestamp()) * 1000
    return d.select(F.col("value").alias("line"), F.monotonically_increasing_id().alias("_seq"), now.alias("ts_ns"), F.col("_metadata.file_path").alias("file"))


def kafka(spark: SparkSession, servers: str, topic: str, stream: bool = True, **options: str) -> DataFrame:
    """Records of a topic as (line, _seq, ts_ns, body); ``_seq`` is unique over partitions and ordered within one. Needs Spark's Kafka package."""
    r = (spark.readStream if stream else spark.read).format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load().select(F.col("value").cast("string").alias("line"), (F.shiftleft(F.col("partition").cast("bigint"), 47) + F.col("offset")).alias("_seq"), (F.unix_micros("timestamp") * 1000).alias("ts_ns"), F.col("value").alias("body"))


def generate(spark: SparkSession, count: int, interval_ns: int = 0, start_ns: int = 0, **columns: Column) -> DataFrame:
    """``count`` rows with ``seq``, ``ts_ns`` and columns made of ``seq``."""
    d = spark.range(count).withColumnRenamed("id", "seq").withColumn("ts_ns", F.lit(start_ns) + F.col("seq") * interval_ns)
    return d.withColumns(columns) if columns else d


DECODERS = {
    "statsd": text.statsd, "graphite": text.graphite, "influxdb": text.influx, "prometheus": text.prometheus, "statsd_logs": text.statsd_logs, "syslog": text.syslog, "nginx_status": text.nginx_status, "apache_status": text.apache_status,
    "archive": json_formats.read_archive, "otlp_json_metrics": json_formats.otlp_metrics, "otlp_json_logs": json_formats.otlp_logs, "otlp_json_traces": json_formats.otlp_traces, "hec": json_formats.hec,
    "series_v1": json_formats.series_v1, "series_v2": json_formats.series_v2, "log_intake": json_formats.log_intake, "distribution_points": json_formats.distribution_points, "event_posts": json_formats.event_posts, "check_runs": json_formats.check_runs, "docker": json_formats.docker_logs,
} | {name: (lambda df, n=name: binary.read(df, n)) for name in binary.READERS}

ENCODERS = {
    "statsd": text.to_statsd, "graphite": text.to_graphite, "influxdb": text.to_influx, "prometheus": text.to_prometheus, "syslog": text.to_syslog, "archive": json_formats.write_archive,
    "otlp_json_metrics": json_formats.to_otlp_metrics, "otlp_json_logs": json_formats.to_otlp_logs, "otlp_json_traces": json_formats.to_otlp_traces, "hec": json_formats.to_hec, "series_v2": json_formats.to_series_v2,
}


def human(events: DataFrame) -> DataFrame:
    """A readable block per event."""
    a = F.array_join(F.transform(F.array_sort(F.map_entries("attributes")), lambda e: F.concat(F.lit("  "), e["key"], F.lit(" = "), V.text(e["value"]))), "\n")
    head = F.concat_ws(" ", json_formats.ns_rfc3339(F.col("ts_ns")), F.upper("log.severity"), F.col("log.message"), F.array_join(F.transform("metrics", lambda m: F.concat_ws("=", m["name"], m["value"].cast("string"))), " "), F.col("span.name"))
    return events.select("_seq", F.concat_ws("\n", head, F.nullif(a, F.lit(""))).alias("line"))


def write_files(df: DataFrame, path: str, fmt: str = "parquet", by_day: str | None = None, mode: str = "append", compression: str | None = None) -> None:
    """Files (parquet, json, text) in a folder or object store, one folder a UTC day of the named ns column."""
    d = df.withColumn("day", F.date_format(F.timestamp_seconds(F.expr(f"{by_day} div 1000000000")), "yyyy-MM-dd")) if by_day else df
    w = d.write.mode(mode).format(fmt)
    if compression:
        w = w.option("compression", compression)
    (w.partitionBy("day") if by_day else w).save(path)


def write_null(df: DataFrame) -> None:
    """Run a frame and keep nothing."""
    df.write.format("noop").mode("overwrite").save()


def write_kafka(df: DataFrame, servers: str, topic: str, key: str | None = None) -> None:
    """Lines as records; needs Spark's Kafka package."""
    d = df.select(F.col("line").alias("value"), *([F.col(key).cast("string").alias("key")] if key else []))
    d.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()


def deliver(df: DataFrame, send, batch_rows: int = 500) -> DataFrame:  # noqa: ANN001
    """Hand bodies to ``send(list[str])`` in batches on the executors; rows are (sent, failed) counts per partition.

    ``send`` raises to report a failed batch. Delivery is at least once: a retried task sends again.
    """
    from collections.abc import Iterator

    import pandas as pd

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sent = failed = 0
        for p in parts:
            column = "line" if "line" in p else "body"
            for i in range(0, len(p), batch_rows):
                batch = p[column].iloc[i : i + batch_rows].tolist()
                try:
                    send(batch)
                    sent += len(batch)
                except Exception:  # noqa: BLE001 - counted and reported
                    failed += len(batch)
        yield pd.DataFrame({"sent": [sent], "failed": [failed]})

    return df.mapInPandas(run, "sent bigint, failed bigint")
