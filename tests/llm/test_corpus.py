"""The corpus operators against plain Python, with nulls, empties, ties, repeats and clashing columns."""

import glob
import math
import os
import random
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from test_oracle import compare

from strandline.llm import distinct, language, mixing, packing, percentiles, queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, data, name):
    compare(spark, data, queries.QUERIES[name], queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_runs(spark, data, name):
    assert queries.QUERIES[name](spark, data).count() > 0


class TestDistinct:
    def test_numbers(self, spark):
        same = ["00000000000000AB", "0xab", "AB ", "0000-00ab", "ab"]
        none = ["0", "0x0", "", None, "xyz", "0000-0000"]
        df = spark.createDataFrame([(x,) for x in same + none], "t string")
        got = [r.x for r in df.select(distinct.hex_number(F.col("t")).alias("x")).collect()]
        assert got == ["ab"] * 5 + [None] * 6

    def test_exact_below_k_and_bounded_above(self, spark):
        df = spark.range(60_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 3 == 0, F.col("id") % 900).otherwise(F.col("id")).alias("x"), F.lit("c").alias("n"))
        df = df.unionByName(df).withColumn("x", F.when(F.col("x") != 5, F.col("x")))
        s = distinct.sketches(df, ["g"], "x")
        rows = {r.g: r for r in distinct.with_bounds(s.withColumn("e", distinct.estimate("sketch")), "e").collect()}
        assert rows[0].e == df.where("g = 0").select("x").distinct().where("x is not null").count()
        for g in (1, 2):
            exact = df.where(f"g = {g}").select("x").where("x is not null").distinct().count()
            assert abs(rows[g].e - exact) < 4 * exact / math.sqrt(4096) and rows[g].lower < rows[g].e < rows[g].upper
        whole = distinct.merge(s, []).select(distinct.estimate("sketch").alias("e")).first().e
        exact = df.select("x").where("x is not null").distinct().count()
        assert abs(whole - exact) < 4 * exact / math.sqrt(4096)

    def test_set_operations(self, spark):
        df = spark.createDataFrame([(1, i) for i in range(100)] + [(2, i) for i in range(60, 200)] + [(1, None)], "g int, x int")
        s = distinct.sketches(df, ["g"], "x")
        a, b = s.where("g = 1").select(F.col("sketch").alias("a")), s.where("g = 2").select(F.col("sketch").alias("b"))
        r = a.join(b, how="inner").select(*distinct.set_operations(F.col("a"), F.col("b"))).first()
        assert (r.in_union, r.in_both, r.in_first_only) == (200, 40, 60)
        assert distinct.sketches(df.limit(0), ["g"], "x").count() == 0


def weighted(vals, q):
    total, run = sum(w for _, w in vals), 0.0
    for v, w in sorted(vals):
        run += w
        if run >= q * total * (1 - 1e-12):
            return v
    return max(v for v, _ in vals)


class TestPercentiles:
    @pytest.mark.parametrize("pieces", [2, 7, 256])
    def test_exact(self, spark, pieces):
        r = random.Random(pieces)
        rows = [(r.choice(["a", "b", None]), r.choice([r.gauss(0, 100), -5.0, 0.0, -0.0, 1e300, -1e-300, 7.25]), r.choice([1.0, 0.25, 3.5]), "n") for _ in range(300)]
        rows += [("a", None, 1.0, "n"), ("a", math.nan, 1.0, "n"), ("a", 1e308, 0.0, "n"), ("a", -1e308, -1.0, "n"), ("a", 1.0, None, "n"), ("c", 4.5, 2.0, "n"), ("d", None, 1.0, "n")]
        df = spark.createDataFrame(rows, "grp string, value double, w double, lo string")
        qs = [0.0, 0.01, 0.5, 0.9, 1.0]
        got = {(x.grp, x.q): x.value for x in percentiles.percentiles(percentiles.base_table(df, ["grp"], weight="w"), ["grp"], qs, pieces=pieces).collect()}
        by = defaultdict(list)
        for g, v, w, _ in rows:
            if v is not None and v == v and w is not None and w > 0:
                by[g].append((v + 0.0, w))
        assert got == {(g, q): weighted(vs, q) for g, vs in by.items() for q in qs}

    def test_no_groups_infinities_and_empty(self, spark):
        df = spark.createDataFrame([(float(i), ) for i in range(101)], "value double")
        base = percentiles.base_table(df, [])
        assert {r.q: r.value for r in percentiles.percentiles(base, [], [0.5, 0.99]).collect()} == {0.5: 50.0, 0.99: 99.0}
        inf = percentiles.base_table(spark.createDataFrame([(x,) for x in (-math.inf, 1.0, 2.0, math.inf)], "value double"), [])
        assert {r.q: r.value for r in percentiles.percentiles(inf, [], [0.25, 0.5, 0.75, 1.0]).collect()} == {0.25: -math.inf, 0.5: 1.0, 0.75: 2.0, 1.0: math.inf}
        assert percentiles.percentiles(percentiles.base_table(df.limit(0), []), [], [0.5]).count() == 0

    def test_no_open_group_is_lost(self, spark):
        base = percentiles.base_table(spark.createDataFrame([(float(10**i),) for i in range(8)], "value double"), [])
        with pytest.raises(RuntimeError, match="open after 1 passes"):
            percentiles.percentiles(base, [], [0.5], pieces=2, passes=1)
        assert percentiles.percentiles(base, [], [0.5], pieces=2).first().value == 1000.0

    def test_stores(self, spark):
        rows = [("s", 2.0, 0.0, ({0: 1.0, 3: None}, [0.0, 2.0], 1), ({1: 1.5}, None, None), 4.0), ("s", 2.0, 1.0, None, (None, [1.0], None), None)]
        store = "struct<bin_counts:map<int,double>,contiguous_bin_counts:array<double>,contiguous_bin_index_offset:int>"
        df = spark.createDataFrame(rows, f"service_name string, gamma double, index_offset double, positive_values {store}, negative_values {store}, zero_count double")
        got = sorted((r.value, r.w) for r in percentiles.sketch_values(df, ["service_name"]).collect())
        assert got == sorted([(1.5, 1.0), (6.0, 2.0), (-3.0, 1.5), (0.0, 4.0), (-0.75, 1.0)])


def divmod_pieces(tokens, cap):
    return sum(t // cap for t in tokens if t > cap), [t if t <= cap else t % cap for t in tokens]


def first_fit(tokens, cap):
    """Containers of first-fit decreasing without any proportions."""
    free = []
    for t in sorted(tokens, reverse=True):
        i = next((i for i, f in enumerate(free) if f >= t), None)
        if i is None:
            free.append(cap - t)
        else:
            free[i] -= t
    return len(free)


class TestPacking:
    def items(self, spark, n=3000, seed=1):
        r = random.Random(seed)
        rows = [(i, r.choice(["a", "a", "b", None, ""]), r.choice([1, r.randrange(1, 100), r.randrange(1, 900), 1000, 2500]), 7) for i in range(n)]
        return rows + [(n, "a", None, 7), (n + 1, "b", 0, 7), (5, "a", 40, 7)], "doc_id bigint, source string, tokens bigint, shard bigint"

    @pytest.mark.parametrize("shard", [200, 8192])
    def test_whole_and_tight(self, spark, shard):
        rows, schema = self.items(spark)
        got = packing.pack(spark.createDataFrame(rows, schema), {"k": 1000, "big": 4000}, shard_items=shard).collect()
        for kind, cap in (("k", 1000), ("big", 4000)):
            mine = [r for r in got if r.container_kind == kind]
            load, pieces = Counter(), defaultdict(list)
            for r in mine:
                load[r.container_id] += r.tokens
                pieces[(r.doc_id, r.source)].append(r)
            assert max(load.values()) <= cap
            assert sum(load.values()) == sum(t for _, _, t, _ in rows if t is not None)
            want = Counter((i, s) for i, s, t, _ in rows if t is not None)
            assert set(pieces) == set(want)
            for (i, s), ps in pieces.items():
                if want[(i, s)] == 1:
                    t = next(t for x, y, t, _ in rows if (x, y) == (i, s))
                    assert len(ps) == max(1, -(-t // cap)) and sum(p.tokens for p in ps) == t
                    assert sorted((p.first_token, p.tokens) for p in ps)[0][0] == 0
            full, rest = divmod_pieces([t for _, _, t, _ in rows if t is not None], cap)
            assert len(load) <= (full + first_fit(rest, cap)) * (1.2 if shard == 200 else 1.06) + 1

    def test_proportions(self):
        r = random.Random(2)
        items = [(i, r.choice("aab"), r.randrange(1, 60)) for i in range(4000)]
        total = Counter()
        for _, s, t in items:
            total[s] += t
        share = {s: t / sum(total.values()) for s, t in total.items()}
        placed = packing.pack_shard(items, 1000, share, {})
        boxes = defaultdict(Counter)
        for box, _, s, _, _, t in placed:
            boxes[box][s] += t
        off = [abs(c["a"] / sum(c.values()) - share["a"]) for b, c in boxes.items() if b < len(boxes) - 3]
        assert max(off) < 0.08
        owed = packing.pack_shard(items[:50], 1000, share, {"b": 500.0, "a": -500.0})
        assert sum(t for _, _, s, _, _, t in owed[:8] if s == "a") == 0

    def test_any_number_of_sources(self, spark):
        df = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 1500).alias("source"), (F.col("id") % 90 + 1).alias("tokens"))
        got = packing.pack(df, {"k": 500}, shard_items=1000)
        assert got.agg(F.count("*"), F.sum("tokens")).first() == df.agg(F.count("*"), F.sum("tokens")).first()
        load = got.groupBy("container_id").agg(F.sum("tokens").alias("t"))
        assert load.agg(F.max("t")).first()[0] <= 500 and load.agg(F.avg("t")).first()[0] > 470

    def test_targets_carry_over_shards(self, spark):
        """Over all shards, what is placed early keeps to the targets as long as the sources last."""
        df = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("source"), F.lit(10).alias("tokens"))
        got = packing.pack(df, {"k": 100}, {"a": 0.75, "b": 0.25}, shard_items=1000)
        first = got.where(F.col("container_id") % (1 << 32) < 20).groupBy("source").agg(F.sum("tokens").alias("t"))
        t = {r.source: r.t for r in first.collect()}
        assert t["a"] > 1.5 * t["b"]

    def test_settings_are_never_cut(self, spark):
        table = spark.range(queries.MOST_SETTINGS + 1)
        with pytest.raises(ValueError, match="more than"):
            queries._settings(table, "containers")
        assert len(queries._settings(table.limit(5), "containers")) == 5

    def test_empty(self, spark):
        assert packing.pack(spark.createDataFrame([], "doc_id bigint, source string, tokens bigint"), {"k": 10}).count() == 0


class TestMixing:
    def model(self, rows, targets, budget, spark):
        """Every copy's finish time, sorted, cut off."""
        h = {(c, i): x for c in range(1, 6) for i, x in spark.createDataFrame([(i,) for i, _, _ in rows], "i bigint").select("i", F.shiftrightunsigned(F.xxhash64(F.lit(0), F.lit(c), "i"), 11)).distinct().collect()}
        out = []
        for s, w, rep in targets:
            mine = [(i, t) for i, x, t in rows if x == s and t]
            run = 0
            for c in range(1, rep + 1):
                for i, t in sorted(mine, key=lambda d: (h[(c, d[0])], d[0])):
                    run += t
                    out.append((run / w, i, s, c, t))
        out.sort(key=lambda x: (x[0], x[1], x[2]))
        got, run = [], 0
        for f, i, s, c, t in out:
            if run + t <= budget:
                got.append((i, s, c, t, run))
            run += t
        return got

    @pytest.mark.parametrize("ranges", [20_000, 37])
    def test_model(self, spark, monkeypatch, ranges):
        monkeypatch.setattr(mixing, "RANGE_ITEMS", ranges)
        r = random.Random(5)
        rows = [(i, r.choice(["x", "x", "x", "y", "z", None, "other"]), r.choice([None, 0, 5, 50, r.randrange(1, 200)])) for i in range(900)]
        targets = [("x", 0.5, 1), ("y", 0.3, 2), ("z", 0.15, 4), ("gone", 0.05, 3)]
        df = spark.createDataFrame([(*x, "e") for x in rows], "doc_id bigint, source string, tokens bigint, share string")
        for budget in (20_000, 10**9, 0):
            got = sorted((m.doc_id, m.source, m.copy, m.tokens, m.mix_offset) for m in mixing.mix(df, targets, budget).collect())
            assert got == sorted(self.model(rows, targets, budget, spark))
        t = spark.createDataFrame([(*x, 20_000) for x in targets], "source string, target_share double, max_repeats int, mix_tokens bigint")
        rep = {x.source: x for x in mixing.shares(mixing.mix(df, targets, 20_000), df.select("doc_id", "source", "tokens"), t).collect()}
        assert rep["gone"].short and not rep["x"].short and abs(sum(x.reached_share for x in rep.values()) - 1) < 0.02
        assert all(x.copies <= x.max_repeats for x in rep.values())

    def test_large_documents_beyond_the_even_cut(self, spark):
        """x lags by most of a document, so y fills the budget with a second round."""
        rows = [(0, "x", 40), (1, "x", 40)] + [(2 + i, "y", t) for i, t in enumerate([10, 10, 10, 10, 13])]
        df = spark.createDataFrame(rows, "doc_id bigint, source string, tokens bigint")
        targets = [("x", 0.5, 1), ("y", 0.5, 2)]
        for budget in (60, 105, 110):
            got = sorted((m.doc_id, m.source, m.copy, m.tokens, m.mix_offset) for m in mixing.mix(df, targets, budget).collect())
            assert got == sorted(self.model(rows, targets, budget, spark))

    def test_no_slice_holds_what_is_cut_off(self, spark, monkeypatch):
        monkeypatch.setattr(mixing, "RANGE_ITEMS", 100)
        largest, prefix = [], mixing.bucketed_prefix

        def seen(df, by, bucket, *rest):
            if bucket == "slice":
                largest.append(df.groupBy(bucket).count().agg(F.max("count")).first()[0])
            return prefix(df, by, bucket, *rest)

        monkeypatch.setattr(mixing, "bucketed_prefix", seen)
        df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("source"), F.lit(10).cast("bigint").alias("tokens"))
        assert mixing.mix(df, [("x", 1.0, 1)], 4000).count() == 400
        assert largest[0] <= 100

    def test_empty(self, spark):
        df = spark.createDataFrame([], "doc_id bigint, source string, tokens bigint")
        assert mixing.mix(df, [("x", 1.0, 1)], 100).count() == 0


WORDS = {
    "en": "the river was rebuilt with lighter stone and the old mill belonged to this county for almost forty years which nobody knew",
    "es": "el antiguo barrio del puerto cambió de manos dos veces sin ningún contrato escrito mientras se trasladaba el mercado",
    "de": "die kleine Insel wurde nach der großen Flut aus hellerem Stein neu errichtet und gehörte zum nördlichen Teil",
    "ru": "старая мельница относилась к северной части графства и была построена заново из светлого камня весной",
}


def sentences(lang, n, r):
    return " ".join(" ".join(r.sample(WORDS[lang].split(), 9)) + "." for _ in range(n))


class TestLanguage:
    @pytest.fixture(scope="class")
    def docs(self, spark):
        r = random.Random(9)
        rows = []
        for i in range(240):
            lang = r.choice(list(WORDS))
            rows.append((i, sentences(lang, 6, r), lang if r.random() < 0.85 else r.choice([None, "", "xx", "en"])))
        mixed = [
            (1000, sentences("en", 5, r) + "\n\n{{quote|" + sentences("es", 4, r) + "}}\n" + sentences("en", 3, r), "English", {"en", "es"}),
            (1001, sentences("ru", 4, r) + "\n" + sentences("de", 4, r).upper(), "ru-RU", {"ru", "de"}),
            (1002, "{{Infobox\n| name = " + sentences("es", 3, r) + "\n}}\n== " + sentences("de", 2, r) + " ==\n<ref>" + sentences("es", 3, r) + "</ref>" + sentences("en", 4, r) + "\n| x || " + sentences("de", 3, r) + "\n[[Category:" + sentences("de", 2, r) + "]]", "eng", {"en"}),
            (1003, "sdkjfh qwpoei zmxncb lkjsdf qpwoei rutyei zxmcnv alskdj qpwoeiru tyzmxn " * 6, None, set()),
            (1004, "", "en", set()), (1005, None, "de", set()), (1006, "#REDIRECT [[" + sentences("en", 3, r) + "]]", "de", set()),
            (1007, sentences("de", 900, r), "de", {"de"}),
        ]
        return spark.createDataFrame(rows + [m[:3] for m in mixed], "doc_id bigint, text string, lang string").withColumn("letters", F.lit("clash")), rows, {m[0]: m[3] for m in mixed}

    def test_documents_and_segments(self, docs):
        df, rows, mixed = docs
        model = language.train(df)
        assert model.langs == sorted(WORDS)
        found = defaultdict(dict)
        for x in language.identify(df, model).collect():
            found[x.doc_id][x.language] = x
        for i, text, _ in rows:
            true = next(k for k, w in WORDS.items() if text.split()[0].strip(".") in w.split())
            assert max(found[i].values(), key=lambda x: x.letters).language == true
            assert 0 < found[i][true].confidence <= 1
        for i, want in mixed.items():
            assert {k for k, x in found[i].items() if x.letters >= 100 and k != language.NONE} == want, i
        seg = [x for x in language.identify(df.where("doc_id = 1000"), model, segments=True).collect()]
        assert [x.language for x in sorted(seg, key=lambda x: x.first_word)] == ["en", "es", "en"]
        assert sum(x.words for x in seg) == sum(x.words for x in found[1000].values())
        null_id = language.identify(df.where("doc_id = 1000").withColumn("doc_id", F.lit(None).cast("bigint")), model).collect()
        assert {x.language for x in null_id} == {"en", "es"}

    def test_viterbi_is_the_best_path(self):
        rng = np.random.default_rng(1)
        scores = np.vstack([rng.normal(size=(6, 3)), np.zeros((1, 3))]).astype(np.float32)
        ids = rng.integers(0, 6, size=(7, 5))
        ids[5:, 2] = 6
        got = language.viterbi(ids, scores, 1.5)
        import itertools

        for k in range(5):
            def value(p, k=k):
                return sum(scores[ids[t, k], s] for t, s in enumerate(p)) - 1.5 * sum(a != b for a, b in itertools.pairwise(p))
            assert value(got[:, k]) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=7)), abs=1e-4)

    @pytest.mark.parametrize("label,code", [("en", "en"), ("en-GB", "en"), ("de_AT", "de"), ("GER", "de"), (" Dutch ", "nl"), ("fra", "fr"), ("xx", None), ("und", None), ("unknown", None), ("", None), (None, None), ("zh-Hans-CN", "zh"), ("swa", "sw"), ("Icelandic", "is"), ("ice", "is"), ("Haitian Creole", "ht"), ("isl-IS", "is")])
    def test_labels(self, spark, label, code):
        assert spark.range(1).select(language.named(F.lit(label).cast("string")).alias("x")).first().x == code

    def test_scripts_and_solid_text(self):
        words = pa.array(["word", "ünder", "слово", "λόγος", "漢", "か", "カ", "한국어", "ไ", "हिन्दी", "עברית", "عربي", "ქართული", "𠀀", "ệ"])
        want = ["latin", "latin", "cyrillic", "greek", "han", "kana", "kana", "hangul", "thai", "devanagari", "hebrew", "arabic", "georgian", "han", "latin"]
        assert [language.SCRIPTS[i] for i in language.scripts_of(words)] == want
        assert [language.SCRIPTS[i] for i in language.scripts_of(words.slice(4, 3))] == want[4:7]
        got, owner = language.prose_words(pa.array(["漢字とかな mix", None, "ไทย", "plain words"]))
        assert got.to_pylist() == ["漢", "字", "と", "か", "な", "mix", "ไ", "ท", "ย", "plain", "words"]
        assert owner.tolist() == [0] * 6 + [2] * 3 + [3] * 2

    def test_languages_of_other_scripts(self, spark):
        r = random.Random(3)
        solid = {"ja": "これは古い町の市場でありその川沿いに多くの店が並んでいる", "zh": "这座古老的城市位于河边市场里有许多商店和学校", "th": "ตลาดเก่าตั้งอยู่ริมแม่น้ำและมีร้านค้ามากมาย"}
        make = lambda k, n: "".join("".join(r.sample(solid[k], 12)) + "。" for _ in range(n))
        rows = [(i, make(k, 12), k) for i, k in enumerate(r.choice(list(solid)) for _ in range(90))]
        rows += [(i + 500, sentences("en", 6, r), "en") for i in range(30)]
        rows += [(1000, make("ja", 15) + "\n" + make("th", 15) + "\n" + sentences("en", 4, r), None)]
        df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
        model = language.train(df)
        assert model.langs == ["en", "ja", "th", "zh"]
        found = defaultdict(set)
        for x in language.identify(df, model).where("letters >= 100").collect():
            found[x.doc_id].add(x.language)
        assert all(found[i] == {k} for i, _, k in rows[:90])
        assert found[1000] == {"ja", "th", "en"}

    def test_untrained_and_slices(self, spark):
        empty = spark.createDataFrame([], "doc_id bigint, text string, lang string")
        assert language.identify(empty, language.train(empty)).count() == 0
        one = spark.createDataFrame([(1, "some words here", None)], "doc_id bigint, text string, lang string")
        assert [x.language for x in language.identify(one, language.train(one)).collect()] == [language.NONE]
        b = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "b" * 50, "c"]})
        assert [x.num_rows for x in language._slices(b, 20)] == [2, 1, 1]


def test_found_on_real_rows(spark, data):
    """p8_found and p10_found keep to documents that exist, in the columns asked for."""
    assert queries.p8_found(spark, data).columns == ["container_kind", "doc_id"]
    assert queries.p10_found(spark, data).columns == ["doc_id", "lang"]
    assert glob.glob(data + "/documents.parquet") and duckdb.__version__
