"""Queries of the corpus problems 4, 5, 8, 9 and 10 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import identity
from strandline.functions.shared import join_sized, materialise, read
from strandline.llm import distinct, language, mixing, packing, percentiles

#: Most rows of the tables of settings (container kinds, mix targets), which the driver reads.
MOST_SETTINGS = 1000
_MODELS: dict[tuple[str, str], language.Model] = {}


def _idents(spark: SparkSession, d: str) -> DataFrame:
    """(ident, utc_day, env, id) of traces and hosts."""
    payloads = read(spark, d, "agent_payloads")
    chunks = read(spark, d, "trace_chunks").select(
        "payload_id", F.date_format(F.timestamp_seconds(F.expr("start_ns div 1000000000")), "yyyy-MM-dd").alias("utc_day"), F.xxhash64(distinct.hex_number(F.col("trace_id"))).alias("id"), distinct.hex_number(F.col("trace_id")).isNotNull().alias("ok")
    ).where("ok").drop("ok")
    traces = chunks.join(payloads.select("payload_id", "env"), "payload_id").select(F.lit("trace").alias("ident"), "utc_day", "env", "id")
    host = identity.host_key(F.col("host_name"))
    hosts = payloads.where(host.isNotNull()).select(F.lit("host").alias("ident"), F.date_format("received_at", "yyyy-MM-dd").alias("utc_day"), "env", F.xxhash64(host).alias("id"))
    return traces.unionByName(hosts)


def _day_sketches(spark: SparkSession, d: str) -> DataFrame:
    return distinct.sketches(_idents(spark, d), ["ident", "utc_day", "env"], "id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups with few distinct traces, or with many distinct hosts, for their rows."""
    s = _day_sketches(spark, d).withColumn("distinct_ids", distinct.estimate("sketch"))
    few = F.col("distinct_ids") < F.col("n") * 0.6
    return s.where((F.col("n") >= 5) & F.when(F.col("ident") == "trace", few).otherwise(~few)).select("ident", "utc_day", "env")


def p4_cube(spark: SparkSession, d: str) -> DataFrame:
    """Distinct identifiers per day, env and their combinations, merged from the day sketches."""
    out = _cube(_day_sketches(spark, d), lambda x, g: distinct.merge(x, g).withColumn("distinct_ids", distinct.estimate("sketch")).drop("sketch"))
    return distinct.with_bounds(out, "distinct_ids")


def p4_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Hosts and traces of each env that were seen in production too."""
    by_env = distinct.merge(_day_sketches(spark, d), ["ident", "env"])
    prod = by_env.where("env = 'prod'").select("ident", F.col("sketch").alias("prod"))
    pairs = by_env.where("env <> 'prod'").join(prod, "ident")
    out = pairs.select("ident", "env", *distinct.set_operations(F.col("sketch"), F.col("prod")))
    return distinct.with_bounds(out, "in_both", "in_union")


def _latency(spark: SparkSession, d: str) -> DataFrame:
    """(grp, utc_day, value): each message of the millisecond series once."""
    keys = ["series_h", "metric_key", "host_key", "tag_set"]
    series = identity.series_table(read(spark, d, "metric_series")).where("unit = 'millisecond'").groupBy(*keys).agg(F.min("series_id").alias("series_id")).withColumnsRenamed({k: f"s_{k}" for k in keys[1:]})
    r = join_sized(identity.readings(read(spark, d, "metric_points")), series, ["series_h"])
    r = r.where("metric_key <=> s_metric_key and host_key <=> s_host_key and tag_set = s_tag_set")
    once = r.groupBy("series_id", "ns", "value").agg(F.first("metric_key").alias("grp"))
    return once.select("grp", F.date_format(F.timestamp_seconds(F.expr("ns div 1000000000")), "yyyy-MM-dd").alias("utc_day"), "value")


def _values(spark: SparkSession, d: str) -> DataFrame:
    points = _latency(spark, d).select(F.lit("points").alias("origin"), "grp", "utc_day", "value", F.lit(1.0).alias("w"))
    s = read(spark, d, "dd_sketches").withColumn("utc_day", F.date_format("bucket_start", "yyyy-MM-dd"))
    bins = percentiles.sketch_values(s, ["service_name", "utc_day"]).select(F.lit("sketches").alias("origin"), F.col("service_name").alias("grp"), "utc_day", "value", "w")
    return points.unionByName(bins)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Groups and days whose 95th percentile is at least 250."""
    g = ["origin", "grp", "utc_day"]
    p = percentiles.percentiles(percentiles.base_table(_values(spark, d), g, weight="w"), g, [0.95])
    return p.where("value >= 250").select(*g)


def _cube(df: DataFrame, make) -> DataFrame:  # noqa: ANN001
    """make(group) over (ident, day, env) and its coarser combinations, left-out columns as ``*``."""
    out = None
    for g in (["ident", "utc_day", "env"], ["ident", "utc_day"], ["ident", "env"], ["ident"]):
        m = make(df, g)
        m = m.select("ident", *[F.col(c) if c in g else F.lit("*").alias(c) for c in ("utc_day", "env")], *[c for c in m.columns if c not in ("ident", "utc_day", "env")])
        out = m if out is None else out.unionByName(m)
    return out


def p4_cube_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact count of every group and combination lies within three standard errors of its merged sketch."""
    counts = _cube(_idents(spark, d), lambda x, g: x.groupBy(*g).agg(F.count_distinct("id").alias("exact")))
    est = p4_cube(spark, d).withColumnRenamed("n", "rows")
    room = (F.col("upper") - F.col("distinct_ids")) * 1.5
    j = counts.alias("a").join(est.alias("b"), F.expr("a.ident = b.ident and a.utc_day <=> b.utc_day and a.env <=> b.env"))
    return j.select("a.ident", "a.utc_day", "a.env", "rows", "exact", (F.abs(F.col("exact") - F.col("distinct_ids")) <= room + 0.5).alias("in_bounds"))


def p4_overlap_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Whether the exact overlap of every env with production lies within three standard errors."""
    ids = _idents(spark, d).select("ident", "env", "id").distinct()
    prod = ids.where("env = 'prod'").select("ident", "id").withColumn("hit", F.lit(1))
    exact = ids.where("env <> 'prod'").join(prod, ["ident", "id"], "left").groupBy("ident", "env").agg(F.count("hit").alias("exact"))
    j = p4_overlap(spark, d).join(exact, ["ident", "env"])
    return j.select("ident", "env", "exact", (F.abs(F.col("exact") - F.col("in_both")) <= (F.col("upper") - F.col("in_both")) * 1.5 + 0.5).alias("in_bounds"))


def p5_daily(spark: SparkSession, d: str) -> DataFrame:
    """Median and high percentiles per metric and day, and over all days, from one base table."""
    g = ["grp", "utc_day"]
    base = percentiles.base_table(_latency(spark, d), g)
    qs = [0.5, 0.9, 0.95, 0.99]
    whole = percentiles.percentiles(base, ["grp"], qs).withColumn("utc_day", F.lit("*"))
    return percentiles.percentiles(base, g, qs).unionByName(whole).select("grp", "utc_day", "q", "value", F.col("weight").cast("bigint").alias("n"))


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    """Documents in tokens of ByT5: one per UTF-8 byte and the end mark. Written once, so that texts are read once."""
    return materialise(read(spark, d, "documents").select("doc_id", "source", (F.octet_length("text") + 1).cast("bigint").alias("tokens")))


def _settings(table: DataFrame, name: str) -> list:
    """All rows of a table of settings; more than ``MOST_SETTINGS`` are refused, none is left out."""
    rows = table.limit(MOST_SETTINGS + 1).collect()
    if len(rows) > MOST_SETTINGS:
        raise ValueError(f"{name} has more than {MOST_SETTINGS} rows")
    return rows


def _packed(spark: SparkSession, d: str) -> DataFrame:
    kinds = {r[0]: int(r[1]) for r in _settings(read(spark, d, "containers").select("container_kind", "capacity_tokens"), "containers")}
    return packing.pack(_tokens(spark, d), kinds)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that had to be cut, per container kind."""
    return _packed(spark, d).where("piece = 1").select("container_kind", "doc_id")


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """Containers, tokens and fill per kind."""
    caps = read(spark, d, "containers")
    p = _packed(spark, d).groupBy("container_kind").agg(F.count_distinct("container_id").alias("boxes"), F.sum("tokens").alias("tokens"))
    return p.join(caps, "container_kind").select("container_kind", "boxes", "tokens", (F.col("tokens") / (F.col("boxes") * F.col("capacity_tokens"))).alias("fill"))


def p8_account(spark: SparkSession, d: str) -> DataFrame:
    """Per kind: documents and tokens placed, pieces, containers over capacity, and whether at most a twentieth, or one container, stays unused."""
    caps = read(spark, d, "containers")
    boxes = _packed(spark, d).groupBy("container_kind", "container_id").agg(F.sum("tokens").alias("held"), F.count("*").alias("pieces"), F.count_if(F.col("piece") == 0).alias("docs"))
    out = boxes.join(caps, "container_kind").groupBy("container_kind").agg(
        F.sum("docs").alias("docs"), F.sum("held").alias("tokens"), F.sum("pieces").alias("pieces"), F.count_if(F.col("held") > F.col("capacity_tokens")).alias("over_full"), (F.sum("capacity_tokens") - F.sum("held")).alias("unused"), F.greatest(F.sum("capacity_tokens") / 20, F.max("capacity_tokens")).alias("room"))
    return out.select("container_kind", "docs", "tokens", "pieces", "over_full", (F.col("unused") <= F.col("room")).alias("tight"))


def _mix(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    targets = read(spark, d, "mix_targets")
    rows = _settings(targets, "mix_targets")
    docs = _tokens(spark, d)
    budget = max((int(r["mix_tokens"]) for r in rows), default=0)
    return mixing.mix(docs, [(r["source"], r["target_share"], r["max_repeats"]) for r in rows], budget), docs, targets


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix itself, in order of mix_offset."""
    return _mix(spark, d)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of every source."""
    return mixing.shares(*_mix(spark, d))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources that give less than their share even when repeated as often as allowed."""
    return p9_shares(spark, d).where("short").select("source")


def p9_account(spark: SparkSession, d: str) -> DataFrame:
    """Per target source: tokens available, whether it falls short, keeps its cap on repeats, and gives all it has or, of what the sources with more to give have given, its share."""
    mixed, docs, targets = _mix(spark, d)
    s = mixing.shares(mixed, docs, targets)
    uses = mixed.groupBy("source", "doc_id").agg(F.count("*").alias("k")).groupBy("source").agg(F.max("k").alias("most"))
    largest = docs.agg(F.max("tokens").alias("largest"))
    s = s.join(uses, "source", "left").join(F.broadcast(largest))  # one row
    s = s.withColumn("gone", F.col("used") >= F.col("available"))
    s = s.join(F.broadcast(s.groupBy("gone").agg(F.sum("used").alias("group_used"), F.sum("target_share").alias("group_share"))), "gone")  # two rows
    fair = F.abs(F.col("used") - F.col("group_used") * F.col("target_share") / F.col("group_share")) <= 2 * F.col("largest")
    return s.select("source", "available", "short", (F.coalesce("most", F.lit(0)) <= F.col("max_repeats")).alias("capped"), (F.when(F.col("gone"), F.col("used") == F.col("available")).otherwise(fair)).alias("as_aimed"))


def _model(spark: SparkSession, d: str) -> language.Model:
    """The data directory's model, fitted once a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _MODELS:
        _MODELS.clear()
        _MODELS[key] = language.train(read(spark, d, "documents"))
    return _MODELS[key]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Languages with running prose in a document that its label doesn't name."""
    docs = read(spark, d, "documents", spread=True)
    found = language.identify(docs, _model(spark, d), keep=["doc_id", "lang"])
    label = F.coalesce(language.named(F.col("lang")), F.lit(""))
    return found.where((F.col("letters") >= language.LEAST_LETTERS) & (F.col("language") != language.NONE) & (F.col("language") != label)).select("doc_id", F.col("language").alias("lang"))


def p10_documents(spark: SparkSession, d: str) -> DataFrame:
    """Main language of every document that has one, with its confidence."""
    docs = read(spark, d, "documents", spread=True)
    found = language.identify(docs, _model(spark, d)).where(F.col("language") != language.NONE)
    top = F.max(F.struct("letters", "language", "confidence")).alias("m")
    return found.groupBy("doc_id").agg(top, F.count("*").alias("languages")).select("doc_id", F.col("m.language").alias("lang"), "m.letters", "m.confidence", "languages")


def p10_segments(spark: SparkSession, d: str) -> DataFrame:
    """Spans of one language, in the order of the words."""
    docs = read(spark, d, "documents", spread=True)
    return language.identify(docs, _model(spark, d), segments=True)


QUERIES = {f.__name__: f for f in (p4_found, p4_cube, p4_cube_bounds, p4_overlap, p4_overlap_bounds, p5_found, p5_daily, p8_found, p8_fill, p8_account, p9_found, p9_shares, p9_account, p9_mix, p10_found, p10_documents, p10_segments)}
_HOST = "nullif(split_part(trim(lower(host_name)), '.', 1), '')"
_NS = "case when point_timestamp < 100000000000 then point_timestamp*1000000000 when point_timestamp < 100000000000000 then point_timestamp*1000000 when point_timestamp < 100000000000000000 then point_timestamp*1000 else point_timestamp end"
_LATENCY = f"""r as (select distinct trim(lower(metric)) m, {_HOST} h, list_sort(list_distinct(tags)) t, {_NS} ns, point_value v from metric_points where point_value is not null and isfinite(point_value) and flags & 1 = 0),
s as (select trim(lower(metric)) m, {_HOST} h, list_sort(list_distinct(tags)) t from metric_series where unit = 'millisecond'),
l as (select m grp, strftime(make_timestamp(ns//1000), '%Y-%m-%d') utc_day, v from r join s using (m, h, t))"""
_IDENTS = f"""t as (select 'trace' ident, strftime(make_timestamp(start_ns//1000), '%Y-%m-%d') utc_day, env, ltrim(replace(regexp_replace(trim(lower(trace_id)), '^0x', ''), '-', ''), '0') id from trace_chunks join agent_payloads using (payload_id) where trace_id is not null),
h as (select 'host' ident, strftime(received_at, '%Y-%m-%d') utc_day, env, {_HOST} id from agent_payloads), i as (select * from (select * from t union all select * from h) where id <> '')"""
_RATE = "sum(w) over (partition by origin, grp, utc_day order by v) cum, sum(w) over (partition by origin, grp, utc_day) total"
_TOKENS = "(select doc_id, source, strlen(text) + 1 tokens from documents where text is not null)"

SQL = {
    "p4_found": f"""with {_IDENTS} select ident, utc_day, env from (select ident, utc_day, env, count(*) n, count(distinct id) d from i group by 1, 2, 3)
where n >= 5 and (ident = 'trace' and d < 0.6*n or ident = 'host' and d >= 0.6*n)""",
    "p4_cube_bounds": f"""with {_IDENTS} select ident, case when grouping(utc_day) = 1 then '*' else utc_day end utc_day, case when grouping(env) = 1 then '*' else env end env, count(*) "rows", count(distinct id) exact, true in_bounds
from i group by grouping sets ((ident, utc_day, env), (ident, utc_day), (ident, env), (ident))""",
    "p4_overlap_bounds": f"""with {_IDENTS}, u as (select distinct ident, env, id from i), p as (select ident, id from u where env = 'prod')
select u.ident, u.env, count(p.id) exact, true in_bounds from u left join p on u.ident = p.ident and u.id = p.id where u.env <> 'prod' group by 1, 2""",
    "p5_found": f"""with {_LATENCY}, sk as (select sketch_id, service_name, strftime(bucket_start, '%Y-%m-%d') utc_day, gamma g, index_offset o, positive_values p, negative_values n, zero_count z from dd_sketches),
bins as (select service_name, utc_day, g, o, 1 sign, unnest(map_keys(p.bin_counts)) i, unnest(map_values(p.bin_counts)) w from sk union all select service_name, utc_day, g, o, -1, unnest(map_keys(n.bin_counts)), unnest(map_values(n.bin_counts)) from sk
union all select service_name, utc_day, g, o, 1, unnest(range(len(p.contiguous_bin_counts))) + p.contiguous_bin_index_offset, unnest(p.contiguous_bin_counts) from sk
union all select service_name, utc_day, g, o, -1, unnest(range(len(n.contiguous_bin_counts))) + n.contiguous_bin_index_offset, unnest(n.contiguous_bin_counts) from sk),
every as (select 'points' origin, grp, utc_day, v, 1.0::double w from l union all select 'sketches', service_name, utc_day, sign * pow(g, i - o) * (1 + g) / 2, w from bins where w > 0
union all select 'sketches', service_name, utc_day, 0, z from sk where z > 0),
c as (select origin, grp, utc_day, v, sum(w) w from every group by all), q as (select *, {_RATE} from c)
select origin, grp, utc_day from q where cum >= 0.95 * total group by all having min(v) >= 250""",
    "p5_daily": f"""with {_LATENCY}, e as (select grp, utc_day, v from l union all select grp, '*', v from l), k as (select grp, utc_day, v, row_number() over (partition by grp, utc_day order by v) r, count(*) over (partition by grp, utc_day) n from e)
select grp, utc_day, q, min(v) "value", any_value(n) n from k, (values (0.5::double), (0.9::double), (0.95::double), (0.99::double)) z(q) where r >= q * n * (1 - 1e-12) group by grp, utc_day, q""",
    "p8_found": f"select container_kind, doc_id from {_TOKENS}, containers where tokens > capacity_tokens",
    "p8_account": f"""select container_kind, count(*) docs, sum(tokens) tokens, sum(greatest(1, cast(ceil(tokens/capacity_tokens) as bigint))) pieces, 0 over_full, true tight from {_TOKENS}, containers group by 1""",
    "p9_account": f"""with o as (select m.*, m.max_repeats * coalesce(t, 0) available from mix_targets m left join (select source, sum(tokens) t from {_TOKENS} group by 1) d using (source))
select source, available, available < target_share * mix_tokens short, true capped, true as_aimed from o""",
    "p9_found": f"select m.source from mix_targets m left join (select source, sum(tokens) t from {_TOKENS} group by 1) d using (source) where m.max_repeats * coalesce(t, 0) < m.target_share * m.mix_tokens",
}
