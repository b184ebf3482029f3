"""Cumulative counters to deltas, and one point per timestamp bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from strandline.functions.shared import top_before
from strandline.schema import PRIVATE

#: Arrival numbers of a series that one task works through.
CHUNK = 1_000_000


def cumulative_to_delta(points: DataFrame, series: list[str], value: str = "value", ts: str = "ts_ns", seq: str = "_seq", start: str | None = None, initial: str = "auto", non_monotonic: str = "reset_on_decrease", max_staleness_ns: int | None = None) -> DataFrame:
    """points with ``delta``, ``delta_start`` (the previous point's time) and ``rule``.

    In arrival order per series: the first point follows ``initial`` (drop, keep, or
    auto: keep only if it states its start); a time not after the latest seen is
    skipped (``duplicate`` or ``out_of_order``) and leaves the baseline; a decrease, or a
    start after the last time, is a ``reset`` and counts in full; a baseline older than
    ``max_staleness_ns`` is a first point again; all else is the ``difference``. Values should be integers for exact results. Null values
    are left out and never become the baseline. ``non_monotonic="difference"`` allows negative deltas.

    The baseline is the row of the latest time before, of equal times the first to
    arrive. A series is worked through in pieces of ``CHUNK`` arrival numbers.
    """
    d = points.where(F.col(value).isNotNull() & F.col(ts).isNotNull())
    d = top_before(d, series, F.expr(f"{seq} div {CHUNK}"), [seq], F.struct(F.col(ts).alias("t"), (-F.col(seq)).alias("s"), F.col(value).alias("v")), "_p")
    d = d.withColumn("_pm", F.col("_p.t"))
    late = d.where(F.col(ts) <= F.col("_pm")).drop("_p")
    kept = d.where(F.col("_pm").isNull() | (F.col(ts) > F.col("_pm"))).withColumn("_pv", F.col("_p.v")).drop("_p")
    st = F.coalesce(F.col(start), F.lit(0)) if start else F.lit(0).cast("bigint")
    restart = (st != 0) & (st > F.col("_pm")) & (st != F.col(ts))
    first = F.col("_pv").isNull()
    if max_staleness_ns is not None:
        first = first | (F.col(ts) - F.col("_pm") > max_staleness_ns)
    reset = restart if non_monotonic == "difference" else (F.col(value) < F.col("_pv")) | restart
    initial_value = {"drop": F.lit(None), "keep": F.col(value), "auto": F.when(st != 0, F.col(value))}[initial]
    kept = kept.withColumn("rule", F.when(first, "first").when(reset, "reset").otherwise("difference"))
    kept = kept.withColumn("delta", F.when(F.col("rule") == "first", initial_value).when(F.col("rule") == "reset", F.col(value)).otherwise(F.col(value) - F.col("_pv")))
    kept = kept.withColumn("delta_start", F.when(F.col("rule") != "first", F.col("_pm"))).drop("_pv", "_pm")
    late = late.withColumn("rule", F.when(F.col(ts) == F.col("_pm"), "duplicate").otherwise("out_of_order")).withColumn("delta", F.lit(None).cast(dict(kept.dtypes)["delta"])).withColumn("delta_start", F.lit(None).cast("bigint")).drop("_pm")
    return kept.unionByName(late)


def histogram_to_delta(points: DataFrame, series: list[str], ts: str = "ts_ns", seq: str = "_seq") -> DataFrame:
    """Cumulative explicit-bound histograms (buckets array of bound, count; sum) to deltas, bucket by bucket.

    A change of bounds is dropped and becomes the baseline; a fall of any bucket is a reset.
    """
    d = top_before(points, series, F.expr(f"{seq} div {CHUNK}"), [seq], F.struct(F.col(ts).alias("t"), (-F.col(seq)).alias("s"), F.col("buckets").alias("b"), F.col("sum").alias("v")), "_p")
    d = d.withColumn("_pm", F.col("_p.t")).where(F.col("_pm").isNull() | (F.col(ts) > F.col("_pm")))
    d = d.withColumn("_pb", F.col("_p.b")).withColumn("_ps", F.col("_p.v")).drop("_p")
    bounds = lambda c: F.transform(c, lambda b: b["bound"])
    same = bounds(F.col("buckets")) == bounds(F.col("_pb"))
    pairs = F.arrays_zip(F.col("buckets").alias("n"), F.col("_pb").alias("o"))
    fell = F.exists(pairs, lambda p: p["n"]["count"] < p["o"]["count"])
    rule = F.when(F.col("_pb").isNull(), "first").when(~same, "layout").when(fell, "reset").otherwise("difference")
    diff = F.transform(pairs, lambda p: F.struct(p["n"]["bound"].alias("bound"), (p["n"]["count"] - p["o"]["count"]).alias("count")))
    d = d.withColumn("rule", rule)
    out = d.withColumn("delta_buckets", F.when(F.col("rule") == "reset", F.col("buckets")).when(F.col("rule") == "difference", diff))
    return out.withColumn("delta_sum", F.when(F.col("rule") == "reset", F.col("sum")).when(F.col("rule") == "difference", F.col("sum") - F.col("_ps"))).withColumn("delta_start", F.col("_pm")).drop("_pb", "_ps", "_pm")


def _at_scale(offset: Column, counts: Column, shift: Column) -> Column:
    """Buckets (i, c) of a side with its scale lowered by ``shift``; a negative index rounds down, as bounds do."""
    counts = F.coalesce(counts, F.array().cast("array<bigint>"))
    index = lambda i: F.floor((offset + i) / F.pow(F.lit(2.0), shift)).cast("int")
    each = F.transform(counts, lambda c, i: F.struct(index(i).alias("i"), c.alias("c")))
    total = lambda j: F.aggregate(F.filter(each, lambda b: b["i"] == j), F.lit(0).cast("bigint"), lambda a, b: a + b["c"])
    merged = F.transform(F.sequence(index(F.lit(0)), index(F.size(counts) - 1)), lambda j: F.struct(j.alias("i"), total(j).alias("c")))
    return F.when(F.size(counts) == 0, F.array().cast("array<struct<i:int,c:bigint>>")).when(shift == 0, each).otherwise(merged)


def exponential_to_delta(points: DataFrame, series: list[str], ts: str = "ts_ns", seq: str = "_seq") -> DataFrame:
    """Cumulative exponential histograms (exp; sum, count) to deltas, with ``rule`` as for other histograms.

    A baseline of a finer scale is brought to the new one. A finer scale than the
    baseline's, or another zero threshold, is a ``layout`` change: dropped, and the new
    baseline. A fall of any bucket is a ``reset`` and counts in full. Times not after the
    latest are left out; null histograms too.
    """
    d = points.where(F.col("exp").isNotNull())
    d = top_before(d, series, F.expr(f"{seq} div {CHUNK}"), [seq], F.struct(F.col(ts).alias("t"), (-F.col(seq)).alias("s"), F.col("exp").alias("e"), F.col("sum").alias("v"), F.col("count").alias("n")), "_p")
    d = d.where(F.col("_p").isNull() | (F.col(ts) > F.col("_p.t")))
    shift = F.greatest(F.col("_p.e.scale") - F.col("exp.scale"), F.lit(0))
    d = d.withColumns({"_pos": _at_scale(F.col("_p.e.pos_offset"), F.col("_p.e.positive"), shift), "_neg": _at_scale(F.col("_p.e.neg_offset"), F.col("_p.e.negative"), shift)})

    def fell(side: str, old: str) -> Column:
        offset, counts = F.col(f"exp.{'pos' if side == 'positive' else 'neg'}_offset"), F.coalesce(f"exp.{side}", F.array().cast("array<bigint>"))
        return F.exists(old, lambda b: b["c"] > F.coalesce(F.get(counts, b["i"] - offset), F.lit(0)))

    def less(side: str, old: str) -> Column:
        offset = F.col(f"exp.{'pos' if side == 'positive' else 'neg'}_offset")
        first = F.get(F.col(old), F.lit(0))["i"]
        return F.transform(f"exp.{side}", lambda c, i: c - F.coalesce(F.get(F.col(old), F.coalesce(offset + i - first, F.lit(-1)))["c"], F.lit(0).cast("bigint")))
    layout = (F.col("exp.scale") > F.col("_p.e.scale")) | ~F.col("exp.zero_threshold").eqNullSafe(F.col("_p.e.zero_threshold"))
    falls = fell("positive", "_pos") | fell("negative", "_neg") | (F.col("exp.zero_count") < F.col("_p.e.zero_count"))
    d = d.withColumn("rule", F.when(F.col("_p").isNull(), "first").when(layout, "layout").when(falls, "reset").otherwise("difference"))
    diff = F.col("exp").withField("positive", less("positive", "_pos")).withField("negative", less("negative", "_neg")).withField("zero_count", F.col("exp.zero_count") - F.col("_p.e.zero_count"))
    pick = lambda whole, part: F.when(F.col("rule") == "reset", whole).when(F.col("rule") == "difference", part)
    d = d.withColumns({"delta_exp": pick(F.col("exp"), diff), "delta_sum": pick(F.col("sum"), F.col("sum") - F.col("_p.v")), "delta_count": pick(F.col("count"), F.col("count") - F.col("_p.n")), "delta_start": F.when(F.col("rule") != "first", F.col("_p.t"))})
    return d.drop("_p", "_pos", "_neg")


OBSERVED = ("samples", "distribution", "set_members", "set")
RATE, RATE_SPAN = PRIVATE + "metrics.type", PRIVATE + "metrics.interval"
DEDUP_KINDS = frozenset({"sum", "gauge", "gauge_delta", "samples", "distribution", "set_members", "set", "histogram", "summary", "rate"})


def dedup_timestamps(m: DataFrame, precision_ns: int, series: list[str] | None = None, batch: str = "_batch", kinds: set[str] | None = None) -> DataFrame:
    """The metric table with one row per batch, series, kind and time bucket, and what can't merge: ``merged`` counts, ``reason``.

    A bucket's survivor is its latest row that can merge, the later in arrival on a tie.
    Gauges and cumulative kinds are superseded by it. Delta sums and histograms, and
    gauges flagged as rates of one interval, add; samples concatenate in arrival order,
    members unite, bins add. A survivor keeps its flags, its description or else the
    first there is, and the earliest start that isn't 0. Histogram sums are lost once a
    part lacks one; extremes are those of the parts.

    A row passes through unchanged, with ``reason``, beside others of its bucket: gauge
    steps, delta summaries and sums of booleans (``no_merge_rule``), flagged deltas and
    observations (``no_recorded_value``), deltas that aren't finite (``non_finite``), other
    value types (``mixed_type``), bounds or sample rates (``layout_mismatch``), rates of
    another interval or beside gauges (``no_merge_rule``); where a whole sum leaves its
    type, all but the survivor (``overflow``). If no row of a bucket can merge, all but
    the first are counted so. A row alone in its bucket has no reason.

    Null payloads add nothing; null series columns are values; null times have a bucket
    of their own. ``kinds`` names the kinds there are (``rate`` for rates), to plan no
    more. Hot series combine map-side, except for payloads that are lists by nature.
    """
    kinds = set(kinds or DEDUP_KINDS)
    d = m.withColumn("_bucket", F.expr(f"(ts_ns - pmod(ts_ns, {precision_ns})) div {precision_ns}"))
    series = series or ["name", "unit", "attributes", "resource", "scope"]
    types = dict(m.dtypes)
    none = F.create_map().cast("map<string,string>")
    parts = [F.sort_array(F.map_entries(F.coalesce(c, none))).alias(c) if types[c].startswith("map") else F.col(c) for c in series]
    kind, value = F.col("kind"), F.col("value")
    delta = F.coalesce("temporality", F.lit("delta")) == "delta"
    rate = (kind == "gauge") & F.coalesce(F.col("attributes")[RATE] == "srate", F.lit(False)) if "rate" in kinds else F.lit(False)
    adds = rate | (kind.isin("sum", "histogram") & delta)
    latest_wins = ((kind == "gauge") & ~rate) | (kind.isin("sum", "histogram", "summary") & ~delta)
    number = F.isnan(value) | (F.abs(value) == float("inf")) | value.isNull()
    total = F.isnan("sum") | (F.abs(F.col("sum")) == float("inf"))
    reason = (
        F.when(latest_wins, None).when((kind == "gauge_delta") | ((kind == "summary") & delta) | ~kind.isin("sum", "gauge", "histogram", *OBSERVED), "no_merge_rule")
        .when(F.coalesce("flags", F.lit(0)).bitwiseAND(F.lit(1)) == 1, "no_recorded_value")
        .when(kind.isin("sum", "gauge") & (F.col("value_type") == "b"), "no_merge_rule").when(kind.isin("sum", "gauge") & number, "non_finite").when((kind == "histogram") & total, "non_finite")
    )
    # what must equal the survivor's: the type of a sum, the bounds, the rate of sampling, the span of a rate
    like = F.struct(
        F.when(kind.isin("sum", "gauge") & adds, F.col("value_type")).alias("type"), (F.when((kind == "histogram") & delta, F.transform("buckets", lambda b: b["bound"])) if "histogram" in kinds else F.lit(None).cast("array<double>")).alias("bounds"),
        F.when(kind == "samples", F.coalesce("sample_rate", F.lit(1.0))).alias("rate"), (F.when(rate, F.coalesce(F.col("attributes")[RATE_SPAN], F.lit(""))) if "rate" in kinds else F.lit(None).cast("string")).alias("span"),
    )
    d = d.withColumns({"_key": F.struct(batch, *parts, "kind", "temporality", "monotonic", "_bucket"), "_reason": reason, "_like": like, "_adds": adds})
    ok = d.where("_reason is null")
    order = F.coalesce("ts_ns", F.lit(0)).cast("decimal(19,0)") * F.lit(str(2**63)).cast("decimal(19,0)") + F.coalesce("_seq", F.lit(0))
    ok = ok.withColumn("_at", order)
    by_kind = []
    listed = kinds & {"samples", "set_members", "set"}
    if listed:
        by_kind += [F.sort_array(F.collect_list(F.when(F.col("samples").isNotNull(), F.struct("_at", "samples"))))["samples"].alias("_samples"), F.sort_array(F.collect_list(F.when(F.col("members").isNotNull(), F.struct("_at", "members"))))["members"].alias("_members")]
    whole = F.bool_and(F.col("sum").isNotNull())
    row = F.max_by(F.struct(*m.columns, "_adds"), "_at").alias("_row")
    if kinds <= {"gauge"}:  # nothing adds and nothing differs: the latest row of each bucket
        last = ok.groupBy("_key").agg(row, F.count("*").alias("merged"), F.min(F.nullif("start_ns", F.lit(0))).alias("_start"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("_at"))).alias("_description"))
        given = {"start_ns": F.col("_start"), "description": F.coalesce("_row.description", "_description")}
        return last.select(*[given.get(c, F.col(f"_row.{c}")).alias(c) for c in m.columns], "merged", F.lit(None).cast("string").alias("reason"))
    part = ok.groupBy("_key", "_like").agg(
        row, F.max("_at").alias("_at"), F.count("*").alias("merged"), F.sum("value").alias("_f"), F.try_sum("value_i64").alias("_i"), F.count("value_i64").alias("_ints"), F.min(F.nullif("start_ns", F.lit(0))).alias("_start"),
        F.when(whole, F.sum("sum")).alias("_sum"), F.min("min").alias("_min"), F.max("max").alias("_max"), F.sum("count").alias("_count"), F.min_by("description", F.when(F.col("description").isNotNull(), F.col("_at"))).alias("_description"), *by_kind,
    )
    part = part.withColumn("_own", F.row_number().over(W.partitionBy("_key").orderBy(F.desc("_at"), "_like")) == 1)
    won = part.where("_own").drop("_own")
    out = won.select("*", "_row.*").drop("_row")
    for k, payload in (("histogram", "buckets"), ("distribution", "bins")):
        if k in kinds:
            of = ok.where((F.col("kind") == k) & (F.col("_adds") | F.lit(k == "distribution")))
            if payload == "buckets":
                sums = of.select("_key", "_like", F.posexplode(payload).alias("_i", "_b")).groupBy("_key", "_like", "_i").agg(F.max("_b.bound").alias("bound"), F.sum("_b.count").alias("count"))
                made = F.transform(F.sort_array(F.collect_list(F.struct("_i", "bound", "count"))), lambda x: F.struct(x["bound"].alias("bound"), x["count"].alias("count")))
            else:
                sums = of.select("_key", "_like", F.explode(payload).alias("k", "w")).groupBy("_key", "_like", "k").agg(F.sum("w").alias("w"))
                made = F.map_from_entries(F.collect_list(F.struct("k", "w")))
            out = out.join(sums.groupBy("_key", "_like").agg(made.alias(f"_{payload}")), ["_key", "_like"], "left")
    a, ints = F.col("_adds"), F.col("value_type").isin("i", "u") & (F.col("_ints") == F.col("merged"))
    over = a & F.col("kind").isin("sum", "gauge") & F.when(ints, F.col("_i").isNull()).otherwise(F.isnan("_f") | (F.abs(F.col("_f")) == float("inf")))
    out = out.withColumn("_over", F.coalesce(over, F.lit(False)) & (F.col("merged") > 1))
    add = a & ~F.col("_over")
    parted = (F.col("kind") == "histogram") & add | (F.col("kind") == "distribution")
    new = {
        "value": F.when(add & F.col("kind").isin("sum", "gauge"), F.when(ints, F.col("_i").cast("double")).otherwise(F.col("_f"))).otherwise(F.col("value")), "value_i64": F.when(add & ints, F.col("_i")).otherwise(F.col("value_i64")),
        "start_ns": F.col("_start"), "description": F.coalesce("description", "_description"), "merged": F.when(F.col("_over"), F.lit(1).cast("bigint")).otherwise(F.col("merged")), "reason": F.lit(None).cast("string"),
        **{c: F.when(parted, F.col(f"_{c}")).otherwise(F.col(c)) for c in ("sum", "min", "max", "count")},
    }
    if listed:
        new |= {"samples": F.when(F.col("kind") == "samples", F.flatten("_samples")).otherwise(F.col("samples")), "members": F.when(F.col("kind").isin("set_members", "set"), F.array_distinct(F.flatten("_members"))).otherwise(F.col("members"))}
    new |= {c: F.coalesce(f"_{c}", c) for k, c in (("histogram", "buckets"), ("distribution", "bins")) if k in kinds}
    columns = [*m.columns, "merged", "reason"]
    kept = out.withColumns(new).select(columns)
    # rows unlike the survivor, and those of a sum that overflows
    unlike = F.when(F.col("kind") == "gauge", "no_merge_rule").when(F.col("kind").isin("histogram", "samples"), "layout_mismatch").otherwise("mixed_type")
    other = ok.join(part.where("not _own").select("_key", "_like"), ["_key", "_like"], "left_semi").withColumn("reason", unlike)
    spilled = ok.join(out.where("_over").select("_key", "_like", F.col("_at").alias("_top")), ["_key", "_like"]).where("_at <> _top").withColumn("reason", F.lit("overflow"))
    alone = d.where("_reason is not null")
    per = d.groupBy("_key").agg(F.count("_reason").alias("_alone"), F.count("*").alias("_rows"), F.min("_seq").alias("_first"))
    alone = alone.join(per.where("_alone > 0"), "_key").withColumn("reason", F.when((F.col("_rows") > F.col("_alone")) | (F.col("_seq") != F.col("_first")), F.col("_reason")))
    for p in (other, spilled, alone):
        kept = kept.unionByName(p.withColumn("merged", F.lit(1).cast("bigint")).select(columns))
    return kept
