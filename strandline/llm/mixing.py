"""Records of several sources in one mix at target weights.

Weighted fair queueing: each source shuffles its documents by a hash, once per
repetition, and every copy gets a virtual finish time: the source's tokens up to and
including it, divided by the source's weight. Copies of all sources in order of finish
time are the mix, cut off at the total budget. A source that runs out after its capped
repetitions gives less than its share, the others go on.

Running sums are made in two levels over ranges of the hash, and of the finish time,
that hold about ``RANGE_ITEMS`` copies, so no task holds a source or the mix. Copies
beyond the cut-off are left out before, and repetitions wholly beyond it not made. It
follows from the token totals and the largest document of each source: a source may lag
its share by less than that document, so by then the budget is surely given.

Nulls: documents without source or size and those of sources without target are left
out. Ties of hash and of finish time go to the smaller id, then the smaller source. A
source without documents gives nothing. Equal ids count as separate documents.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.functions.shared import bucketed_prefix

RANGE_ITEMS = 20_000


def cut_time(available: dict[str, float], share: dict[str, float], budget: float) -> float:
    """Virtual time at which the sources together have given the budget, or run out."""
    ends = sorted((available[s] / w, s) for s, w in share.items() if w > 0 and available.get(s, 0) > 0)
    given, now, rate = 0.0, 0.0, sum(share[s] for _, s in ends)
    for end, s in ends:
        if given + rate * (end - now) >= budget:
            return now + (budget - given) / rate
        given, now, rate = given + rate * (end - now), end, rate - share[s]
    return ends[-1][0] if ends else 0.0


def mix(docs: DataFrame, targets: list[tuple[str, float, int]], budget: int, seed: int = 0) -> DataFrame:
    """docs (doc_id, source, tokens) -> (doc_id, source, copy, tokens, finish, mix_offset).

    targets: (source, share, max repeats), a fixed short list. mix_offset is the number
    of tokens of the mix before the copy.
    """
    spark = docs.sparkSession
    share = {s: float(w) for s, w, _ in targets if w and w > 0}
    repeats = {s: int(r or 0) for s, _, r in targets}
    d = docs.where("tokens is not null and tokens > 0").select("doc_id", "source", F.col("tokens").cast("bigint").alias("tokens")).where(F.col("source").isin(list(share)))
    size = {r["source"]: (r["t"], r["n"], r["m"]) for r in d.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"), F.max("tokens").alias("m")).collect()}
    end = cut_time({s: size[s][0] * repeats[s] for s in size}, share, float(budget + sum(m for _, _, m in size.values()))) * (1 + 1e-9)
    rounds = {s: min(repeats[s], math.floor(share[s] * end / size[s][0]) + 1) for s in size}
    rows = [(s, share[s], rounds[s], max(1, -(-size[s][1] // RANGE_ITEMS))) for s in size if rounds[s] > 0]
    plan = spark.createDataFrame(rows, "source string, share double, rounds int, ranges int")
    c = d.join(F.broadcast(plan), "source").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("rounds"))))
    h = F.xxhash64(F.lit(seed), "copy", "doc_id")
    c = c.withColumn("h", F.shiftrightunsigned(h, 11))  # 53 bits
    c = c.withColumn("range", F.col("copy") * F.col("ranges") + F.floor(F.col("h") / F.lit(float(2**53)) * F.col("ranges")).cast("int"))
    c = bucketed_prefix(c, ["source"], "range", ["h", "doc_id"], "tokens", "before")
    c = c.withColumn("finish", (F.col("before") + F.col("tokens")) / F.col("share"))
    total = sum(size[s][1] * rounds[s] for s in size)
    slices = max(1, -(-total // RANGE_ITEMS))
    # below both lie all finish times that count
    limit = min(max([size[s][0] * rounds[s] / share[s] for s in size] or [1.0]) * (1 + 1e-9), end) or 1.0
    c = c.where(F.col("finish") <= F.lit(limit))
    c = c.withColumn("slice", F.least(F.floor(F.col("finish") / F.lit(limit) * slices), F.lit(slices)).cast("int"))
    c = bucketed_prefix(c, [], "slice", ["finish", "doc_id", "source"], "tokens", "mix_offset")
    return c.where(F.col("mix_offset") + F.col("tokens") <= F.lit(int(budget))).select("doc_id", "source", "copy", "tokens", "finish", "mix_offset")


def shares(mixed: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: tokens used and available, the share reached and whether it fell short.

    A source is short if all its copies are in the mix and give less than its target.
    """
    used = mixed.groupBy("source").agg(F.sum("tokens").alias("used"), F.max("copy").alias("copies"))
    own = docs.groupBy("source").agg(F.sum("tokens").alias("own"))
    t = targets.join(used, "source", "left").join(own, "source", "left")
    t = t.withColumn("used", F.coalesce("used", F.lit(0))).withColumn("available", F.coalesce(F.col("own"), F.lit(0)) * F.coalesce("max_repeats", F.lit(0)))
    return t.select(
        "source", "target_share", "max_repeats", "used", "available", F.coalesce("copies", F.lit(0)).alias("copies"), (F.col("used") / F.col("mix_tokens")).alias("reached_share"),
        ((F.col("used") >= F.col("available")) & (F.col("used") < F.col("target_share") * F.col("mix_tokens"))).alias("short"),
    )
