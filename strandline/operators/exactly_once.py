"""Exactly one copy of each message that was delivered at least once.

A ledger holds what was admitted before. A batch is applied in four steps:

1. its identifiers are merged map-side, so a message with any number of copies reaches
   its shard as a few rows, with its smallest row id and its number of copies;
2. they are encoded exactly: spread over shards by hash, compared column by column with
   the dictionary, and new ones numbered densely after their shard's last code;
3. codes are looked up in the seen-bitmaps (32768 bits a row, per shard and bucket), and
   one arrival, the smallest row id, is selected per unseen bit;
4. the new dictionary entries and the new bits are written beside the old ones and
   published by one commit file, whose rename fails if its number is taken. A job that
   dies leaves the old ledger in force; of two writers one fails; a batch applied again
   under its id gives the rows it gave before. Old parts are never rewritten.

``copies`` looks every row up in the dictionary of such a ledger. Messages that hold a
thousandth of a batch or more, known from their counts and so at most 1000, are
broadcast there; all others meet in shards.

Nulls are values: two null identifier columns are equal. A null row id sorts last and
is kept only if its message has no other copy. -0.0 equals 0.0, NaN equals NaN. An empty
table gives an empty result.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.shared import scratch

#: Messages meant for one shard: about one bitmap bucket.
SHARD_ROWS = 24_000
BUCKET_BITS = 32_768
HOT_SHARE, HOT_LEAST = 1e-3, 1000


class LedgerConflict(RuntimeError):
    """Another writer has published this version of the ledger."""


def _keys(ident: list[str]) -> list[str]:
    """Names of the identifier's columns within a ledger, which clash with none of its own."""
    return [f"k{i}" for i in range(len(ident))]


def _routed(rows: DataFrame, ident: list[str], row_id: str, shards: int) -> DataFrame:
    """(k0..., row_id, shard) of all rows."""
    kinds = dict(rows.dtypes)
    clean = [((F.col(c) + F.lit(0.0)).cast(kinds[c]) if kinds[c] in ("double", "float") else F.col(c)).alias(k) for c, k in zip(ident, _keys(ident), strict=True)]
    return rows.select(*clean, F.col(row_id).alias("row_id")).withColumn("shard", F.pmod(F.xxhash64(*_keys(ident)), F.lit(shards)).cast("int"))


def merged(rows: DataFrame, ident: list[str], row_id: str, shards: int) -> DataFrame:
    """(shard, k0..., row_id, n): each identifier once, with its smallest row id and number of copies."""
    return _routed(rows, ident, row_id, shards).groupBy("shard", *_keys(ident)).agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))


def _same(keys: list[str], left: str, right: str) -> Column:
    out = F.col(f"{left}.shard") == F.col(f"{right}.shard")
    for c in keys:
        out = out & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return out


def numbered(fresh: DataFrame, keys: list[str], parts: int = 1) -> DataFrame:
    """fresh with ``code``: dense per shard, in the order of ``parts`` sub-ranges of a hash and then of the identifier."""
    d = fresh.withColumn("_sub", F.pmod(F.xxhash64(F.lit("sub"), *keys), F.lit(parts)).cast("int"))
    d = d.withColumn("code", (F.row_number().over(W.partitionBy("shard", "_sub").orderBy(*keys)) - 1).cast("bigint"))
    if parts > 1:
        sizes = d.groupBy("shard", "_sub").agg(F.count("*").alias("_size"))
        before = F.coalesce(F.sum("_size").over(W.partitionBy("shard").orderBy("_sub").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        d = d.join(sizes.select("shard", "_sub", before.alias("_before")), ["shard", "_sub"]).withColumn("code", F.col("code") + F.col("_before")).drop("_before")
    return d.drop("_sub")


def with_bit(coded: DataFrame) -> DataFrame:
    return coded.withColumn("bucket", F.bitmap_bucket_number("code")).withColumn("pos", F.bitmap_bit_position("code"))


def has_bit(bitmap: Column, pos: Column) -> Column:
    """Whether bit ``pos`` of a bitmap is set; a null bitmap has none."""
    byte = F.conv(F.hex(F.substring(bitmap, F.shiftright(pos, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("bigint")
    return F.coalesce(F.getbit(byte, F.pmod(pos, F.lit(8)).cast("int")) == 1, F.lit(False))


def _files(spark: SparkSession, path: str):  # noqa: ANN202
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def commits(spark: SparkSession, ledger: str) -> list[dict]:
    """What was published, in order: number, batch, folder, shards."""
    _, root, fs = _files(spark, f"{ledger}/commits")
    if not fs.exists(root):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(root) if s.getPath().getName().endswith(".json"))
    return [json.loads("".join(r[0] for r in spark.read.text(f"{ledger}/commits/{n}").collect())) for n in names]


def _publish(spark: SparkSession, ledger: str, entry: dict) -> None:
    """Write the commit file aside and move it to its number; fails if that is taken."""
    jvm, root, fs = _files(spark, f"{ledger}/commits")
    fs.mkdirs(root)
    aside = jvm.org.apache.hadoop.fs.Path(root, f"{uuid.uuid4().hex}.tmp")
    out = fs.create(aside, False)
    out.write(bytearray(json.dumps(entry).encode()))
    out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(root.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if root.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    kinds = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    option = spark.sparkContext._gateway.new_array(kinds, 1)
    option[0] = kinds.valueOf("NONE")
    try:
        context.rename(aside, jvm.org.apache.hadoop.fs.Path(root, f"{entry['number']:09d}.json"), option)
    except Exception as e:
        fs.delete(aside, False)
        raise LedgerConflict(f"version {entry['number']} of {ledger} is taken") from e


def dictionary(spark: SparkSession, ledger: str, past: list[dict] | None = None) -> DataFrame | None:
    """(shard, code, k0..., row_id, n): every admitted message; None for a new ledger."""
    past = commits(spark, ledger) if past is None else past
    return spark.read.parquet(*[f"{ledger}/{c['folder']}/dictionary" for c in past]) if past else None


def bitmaps(spark: SparkSession, ledger: str, past: list[dict] | None = None) -> DataFrame | None:
    """(shard, bucket, bitmap): the bits of all versions united."""
    past = commits(spark, ledger) if past is None else past
    if not past:
        return None
    return spark.read.parquet(*[f"{ledger}/{c['folder']}/bitmaps" for c in past]).groupBy("shard", "bucket").agg(F.bitmap_or_agg("bitmap").alias("bitmap"))


def apply_batch(batch: DataFrame, ident: list[str], row_id: str, ledger: str, batch_id: str | None = None, shards: int | None = None) -> DataFrame:
    """Admit a batch against a stored ledger; returns (ident..., row_id) of the admitted rows.

    ``shards`` is fixed by the first batch (by default from its size) and kept in the
    ledger. A batch under a ``batch_id`` that was published before changes nothing and
    gives the rows it gave then; without an id it is a batch of its own.
    """
    spark, keys = batch.sparkSession, _keys(ident)
    past = commits(spark, ledger)
    done = [c for c in past if batch_id is not None and c["batch"] == batch_id]
    if not done:
        rows = batch.count()
        shards = past[0]["shards"] if past else shards or max(1, -(-rows // SHARD_ROWS))
        coded = merged(batch, ident, row_id, shards)
        known = dictionary(spark, ledger, past)
        parts = max(1, -(-rows // (shards * SHARD_ROWS * 4)))
        if known is None:
            unseen = with_bit(numbered(coded, keys, parts))
        else:
            coded = coded.alias("a").join(known.select("shard", "code", *keys).alias("b"), _same(keys, "a", "b"), "left").select("a.*", "b.code")
            base = known.groupBy("shard").agg((F.max("code") + 1).alias("base"))
            fresh = numbered(coded.where("code is null").drop("code"), keys, parts).join(F.broadcast(base) if shards <= 100_000 else base, "shard", "left")
            fresh = fresh.withColumn("code", F.col("code") + F.coalesce("base", F.lit(0))).drop("base")
            every = with_bit(coded.where("code is not null").unionByName(fresh))
            unseen = every.join(bitmaps(spark, ledger, past), ["shard", "bucket"], "left").where(~has_bit(F.col("bitmap"), F.col("pos")))
        folder = f"part-{uuid.uuid4().hex}"
        unseen.select("shard", "code", *keys, "row_id", "n").write.parquet(f"{ledger}/{folder}/dictionary")
        new = with_bit(spark.read.parquet(f"{ledger}/{folder}/dictionary").select("shard", "code"))
        new.groupBy("shard", "bucket").agg(F.bitmap_construct_agg("pos").alias("bitmap")).write.parquet(f"{ledger}/{folder}/bitmaps")
        done = [{"number": len(past), "batch": batch_id, "folder": folder, "shards": shards, "rows": rows}]
        _publish(spark, ledger, done[0])
    return spark.read.parquet(f"{ledger}/{done[0]['folder']}/dictionary").select(*[F.col(k).alias(c) for k, c in zip(keys, ident, strict=True)], F.col("row_id").alias(row_id))


def copies(rows: DataFrame, ident: list[str], row_id: str) -> DataFrame:
    """(kept_id, copy_id) for every copy that isn't kept: ``rows`` as one batch against a new ledger."""
    spark, keys = rows.sparkSession, _keys(ident)
    ledger = scratch(spark)
    apply_batch(rows, ident, row_id, ledger, "all")
    commit = commits(spark, ledger)[0]
    repeated = dictionary(spark, ledger).where("n > 1").select("shard", *keys, F.col("row_id").alias("kept_id"), "n")
    least = max(HOT_LEAST, HOT_SHARE * commit["rows"])
    hot = repeated.where(F.col("n") >= least).select("*", F.xxhash64(*keys).alias("_h"))
    hashes = [r["_h"] for r in hot.select("_h").collect()]  # at most 1 / HOT_SHARE
    d = _routed(rows, ident, row_id, commit["shards"])
    found = [(d.where(~F.xxhash64(*keys).isin(hashes)) if hashes else d, repeated.where(~F.xxhash64(*keys).isin(hashes)) if hashes else repeated)]
    if hashes:
        found.append((d.where(F.xxhash64(*keys).isin(hashes)), F.broadcast(repeated.where(F.xxhash64(*keys).isin(hashes)))))
    parts = [a.alias("a").join(b.alias("b"), _same(keys, "a", "b")).select("b.kept_id", F.col("a.row_id").alias("copy_id")) for a, b in found]
    out = parts[0].unionByName(parts[1]) if hashes else parts[0]
    return out.where("kept_id is not null and (copy_id is null or copy_id <> kept_id)")
