"""Helpers that several operators share: reading, materialising, skew handling."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Rows up to which a join side counts as small. A row of the sides in question is
#: under 200 bytes, so such a side stays under 20 MB.
BROADCAST_ROWS = 100_000
_TABLES: list[tuple[SparkSession, str]] = []


def read(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """The named table of a data directory; sessions run in UTC, and of repeated map keys the last wins.

    ``spread``: rows of a table that scans in fewer than half as many tasks as there are
    cores (few files of one row group) are dealt to all cores, for work that is heavier
    than moving them. Where files are many, as in large tables, nothing is moved.
    """
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    if spark.conf.get("spark.sql.mapKeyDedupPolicy") != "LAST_WIN":
        spark.conf.set("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    if spread and df._jdf.queryExecution().toRdd().getNumPartitions() * 2 <= (cores := spark.sparkContext.defaultParallelism):
        return df.repartition(cores)
    return df


def micros(c: Column | str) -> Column:
    """Unix microseconds of a timestamp column, zoned or not (session zone UTC)."""
    return F.unix_micros((F.col(c) if isinstance(c, str) else c).cast("timestamp"))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only on one machine a folder is made where none is configured."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    made = spark.sparkContext._jsc.sc().getCheckpointDir()
    if made.isDefined():
        return made.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="strandline-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder, deleted by ``release`` or when the Python process ends."""
    path = f"{shared_dir(spark)}/strandline-{uuid.uuid4().hex}"
    _TABLES.append((spark, path))
    return path


def release(*paths: str) -> None:
    """Delete scratch paths that no frame reads any more; all of them without arguments."""
    for spark, path in [t for t in _TABLES if not paths or t[1] in paths]:
        _TABLES.remove((spark, path))
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001 - the session may be gone
            pass


atexit.register(release)


def materialise(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it back.

    Cuts the lineage and keeps column pruning; a lost executor costs nothing, as the
    files are outside it. The folder goes with ``release(path)``, by default when the
    Python process ends.
    """
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_sized(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int | None = None, salts: int = 16) -> DataFrame:
    """Join on ``on``; ``small`` is broadcast only if counted at ``BROADCAST_ROWS`` or fewer.

    Beyond that the small side is repeated ``salts`` times and the big side is salted,
    so that one key with a third of all rows still spreads over ``salts`` tasks. Keys
    must be unique in ``small``. Null keys never match, as in SQL.
    """
    n = small.limit(BROADCAST_ROWS + 1).count() if rows is None else rows
    if n <= BROADCAST_ROWS:
        return big.join(F.broadcast(small), on, how)
    left = big.withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in big.columns if c not in on]), F.lit(salts)))
    right = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>")))
    return left.join(right, [*on, "_salt"], how).drop("_salt")


def hot_values(df: DataFrame, key: Column, share: float = 1e-3, at_most: int = 1000) -> tuple[list[int], int]:
    """BIGINT keys that hold at least ``share`` of the rows, ``at_most`` of them, and the number of rows.

    One pass with a frequent-items sketch of bounded size, merged map-side; the answer
    only routes rows, so an estimate is enough and no result depends on it.
    """
    if share * at_most < 1:
        raise ValueError("at_most is too small for share")
    r = df.select(key.alias("k")).where("k is not null").agg(
        F.expr(f"approx_top_k(k, {at_most}, {at_most * 50})").alias("top"), F.count("*").alias("n")
    ).first()
    least = max(1000, share * r["n"])
    return [int(x["item"]) for x in (r["top"] or []) if x["count"] >= least], r["n"]


def bucketed_prefix(df: DataFrame, by: list[str], bucket: str, order: list[str], value: str, out: str) -> DataFrame:
    """Running sum ``out`` of ``value`` before each row, per ``by``, in the order (bucket, order).

    Two levels: totals per bucket are summed first (a small table), then rows are summed
    within their bucket only, so no task holds a whole group. Buckets must be ordered
    like the rows and none may be unbounded; ``value`` must be an integer. Nulls of
    ``by`` are a group.
    """
    d = df.withColumn("_by", F.struct(F.lit(0).alias("_"), *by))
    totals = d.groupBy("_by", bucket).agg(F.sum(value).alias("_t"))
    offsets = totals.withColumn("_before", F.sum("_t").over(W.partitionBy("_by").orderBy(bucket)) - F.col("_t")).drop("_t")
    inner = W.partitionBy("_by", bucket).orderBy(*order)
    return (
        d.withColumn("_run", F.sum(value).over(inner) - F.col(value))
        .join(offsets, ["_by", bucket])
        .withColumn(out, F.col("_before") + F.col("_run"))
        .drop("_before", "_run", "_by")
    )


def top_before(df: DataFrame, by: list[str], bucket: Column, order: list[str], value: Column, out: str) -> DataFrame:
    """df with ``out``: the largest ``value`` (a struct) of the rows before each, per ``by``, in the order (bucket, order).

    Two levels, as in ``bucketed_prefix``: a bucket's rows meet in a task, a group's don't.
    """
    d = df.withColumns({"_by": F.struct(F.lit(0).alias("_"), *by), "_bucket": bucket, "_value": value})
    tops = d.groupBy("_by", "_bucket").agg(F.max("_value").alias("_top"))
    carried = tops.withColumn("_carry", F.max("_top").over(W.partitionBy("_by").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1))).drop("_top")
    here = F.max("_value").over(W.partitionBy("_by", "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1))
    return d.withColumn("_here", here).join(carried, ["_by", "_bucket"]).withColumn(out, F.greatest("_here", "_carry")).drop("_by", "_bucket", "_value", "_here", "_carry")
