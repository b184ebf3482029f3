"""Items of varying length in containers of fixed capacity, at target proportions.

Deficit round-robin over one queue per source: every step credits each source with its
share of what was placed and serves the source with the largest deficit that has an
item that fits, taking its largest such item; a container closes when nothing fits. So
each container tends to the target proportions and is filled up by small items. An
item longer than the capacity is cut into whole containers, its rest is an item; no
other item is cut.

Items are dealt to shards of about ``SHARD_ITEMS`` by a hash. The deficits that a shard
starts with are what the shards before it leave over, known from token totals per
shard and source, so shards are packed in parallel and still act as one sequence.

Nulls: an item without size is left out; a null source is a queue of its own; sizes
below 1 are placed as 0 tokens. Ties of size go to the larger id first. Equal ids are
separate items. An empty table gives no containers.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.shared import join_sized, materialise

SHARD_ITEMS = 8192
SCHEMA = "container_kind string, container_id bigint, doc_id bigint, source string, piece int, first_token bigint, tokens bigint"


def pack_shard(items: list[tuple[int, str, int]], capacity: int, share: dict[str, float], deficit: dict[str, float]) -> list[tuple[int, int, str, int, int, int]]:
    """(container no, id, source, piece, first token, tokens) for items (id, source, tokens)."""
    out: list[tuple[int, int, str, int, int, int]] = []
    queues: dict[str, list[tuple[int, int, int, int]]] = {}
    owed = dict(deficit)
    box = 0

    def place(source: str, tokens: int) -> None:
        owed[source] = owed.get(source, 0.0) - tokens
        for s, w in share.items():
            owed[s] = owed.get(s, 0.0) + w * tokens

    for ident, source, tokens in items:
        tokens = max(tokens, 0)
        piece = at = 0
        if tokens > capacity:
            while tokens - at >= capacity:
                out.append((box, ident, source, piece, at, capacity))
                place(source, capacity)
                box, piece, at = box + 1, piece + 1, at + capacity
        if tokens > at or piece == 0:
            queues.setdefault(source, []).append((tokens - at, ident, piece, at))
    for q in queues.values():
        q.sort()
    left = sum(map(len, queues.values()))
    free = capacity
    while left:
        best = None
        for source, q in queues.items():
            i = bisect_right(q, (free, 1 << 63)) - 1
            if i >= 0 and (best is None or owed.get(source, 0.0) > best[0]):
                best = (owed.get(source, 0.0), source, i)
        if best is None:
            box, free = box + 1, capacity
            continue
        _, source, i = best
        tokens, ident, piece, at = queues[source].pop(i)
        if not queues[source]:
            del queues[source]
        out.append((box, ident, source, piece, at, tokens))
        place(source, tokens)
        free -= tokens
        left -= 1
    return out


def pack(items: DataFrame, capacities: dict[str, int], targets: dict[str, float] | None = None, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """items (doc_id, source, tokens) -> SCHEMA, for every container kind.

    ``targets`` gives each source's proportion; without it, its own share of all tokens.
    There may be any number of sources: their totals, shares and deficits stay in tables,
    one row per shard and source, and meet the items of their shard there.
    """
    # a source that is null, and one that is the empty string, have different queues
    d = items.where("tokens is not null").select("doc_id", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n")).alias("source"), F.col("tokens").cast("bigint").alias("tokens"))
    shards = max(1, -(-items.count() // shard_items))
    d = d.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    by_shard = materialise(d.groupBy("shard", "source").agg(F.sum("tokens").alias("t")))
    if targets is None:
        every = by_shard.agg(F.sum("t")).first()[0] or 0
        share = by_shard.groupBy("source").agg((F.sum("t") / F.lit(float(max(every, 1)))).alias("share"))
    else:
        share = items.sparkSession.createDataFrame([("s" + s, float(w)) for s, w in targets.items()], "source string, share double")
    # what the shards before leave owed: the source's share of all they placed, less what it gave
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    placed = by_shard.groupBy("shard").agg(F.sum("t").alias("all")).withColumn("all", F.coalesce(F.sum("all").over(before.partitionBy(F.lit(0))), F.lit(0)))  # one row a shard
    given = F.coalesce(F.sum("t").over(before.partitionBy("source")), F.lit(0))
    start = join_sized(by_shard.withColumn("given", given), share, ["source"], "left").withColumn("share", F.coalesce("share", F.lit(0.0)))
    start = start.join(placed, "shard").select("shard", "source", "share", (F.col("share") * F.col("all") - F.col("given")).alias("owed"))
    kinds = sorted(capacities.items())

    def run(key: tuple[int], pdf: pd.DataFrame, queues: pd.DataFrame) -> pd.DataFrame:
        share, owed = dict(zip(queues.source, queues.share, strict=True)), dict(zip(queues.source, queues.owed, strict=True))
        pdf = pdf.sort_values("doc_id")
        listed = list(zip(pdf.doc_id.tolist(), pdf.source.tolist(), pdf.tokens.tolist(), strict=True))
        parts = []
        for kind, capacity in kinds:
            boxes = pd.DataFrame(pack_shard(listed, capacity, share, owed), columns=["container_id", "doc_id", "source", "piece", "first_token", "tokens"])
            boxes["container_id"] += int(key[0]) << 32
            boxes.insert(0, "container_kind", kind)
            parts.append(boxes)
        out = pd.concat(parts)
        out["source"] = [s[1:] if s != "n" else None for s in out.source]
        return out

    return d.groupBy("shard").cogroup(start.groupBy("shard")).applyInPandas(run, SCHEMA)
