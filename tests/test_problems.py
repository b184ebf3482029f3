"""The general problems against plain Python, with nulls, empties, ties, repeats and clashing columns."""

import math
import random
import re
from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.functions import identity
from strandline.functions.shared import bucketed_prefix, hot_values, join_sized, materialise
from strandline.operators import exactly_once, instants, late_events, log_entries, regular_grid
from strandline.queries import problems

T0 = 1_704_067_200_000_000_000  # 2024-01-01
HOUR, MIN = 3_600_000_000_000, 60_000_000_000
UTC = datetime(1970, 1, 1)
DELIVERY = "delivery_id bigint, log_id bigint, event_timestamp bigint, observed_timestamp bigint, received_at timestamp, service_name string, host_name string, arrival string"
KW = dict(key="log_id", event="event_timestamp", observed="observed_timestamp", received="received_at", group=["service_name"], source="host_name")


def at(ns):
    return UTC + timedelta(microseconds=ns // 1000)


def deliveries(n=300, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        e = T0 + r.randrange(6) * HOUR + r.randrange(HOUR)
        for _ in range(r.choice([1, 1, 2, 3])):
            lag = r.choice([0, 5 * MIN, 2 * HOUR, 30 * HOUR])
            obs = e + lag + r.randrange(1000)
            rows.append((len(rows), i, r.choice([e, e, e, 0]) if i % 17 == 0 else e, 0 if r.random() < 0.2 else obs, at(obs), r.choice(["a", "b"]) if i % 5 else None, f"h{r.randrange(3)}", "x"))
    rows += [(9999, None, T0, T0, at(T0), "a", "h", None), (9998, 5000, None, T0, at(T0), "a", "h", None)]
    return rows


class TestLateEvents:
    def frame(self, spark, rows):
        return spark.createDataFrame(rows, DELIVERY)

    def test_outcomes(self, spark):
        rows = deliveries()
        first = {}
        for _, k, e, o, rcv, s, h, _ in rows:
            if k is None or not e:
                continue
            a = o if o else int((rcv - UTC) / timedelta(microseconds=1)) * 1000
            cand = (a, e)
            first[k] = min(first.get(k, cand), cand)
        want = {}
        for k, (a, e) in first.items():
            lag = a - (e // HOUR + 1) * HOUR
            want[k] = "dropped" if lag > 24 * HOUR else "late" if lag > 10 * MIN else "on_time"
        d = late_events.with_outcome(late_events.dots(self.frame(spark, rows), **KW))
        assert {r.log_id: r.outcome for r in d.collect()} == want

    def test_merging_is_idempotent_and_order_free(self, spark):
        rows = deliveries()
        def state(rows):
            return late_events.versions(late_events.with_outcome(late_events.dots(self.frame(spark, rows), **KW)), ["service_name"])
        whole = state(rows)
        again = late_events.merge([whole, state(rows[::-1]), whole], ["service_name"])
        assert sorted(map(str, whole.collect())) == sorted(map(str, again.select(whole.columns).collect()))
        last = {}
        for r in sorted(late_events.corrections(whole, ["service_name"]).collect(), key=lambda r: r.seq):
            last[(r.period_end, r.service_name)] = (r.n, r.dropped)
        assert last == {(r.period_end, r.service_name): (r.n, r.dropped) for r in late_events.totals(whole, ["service_name"]).collect()}

    def test_batches_merge_to_the_whole(self, spark):
        """Split sources, a copy after the cut-off merged before the copy within it, and a copy by another source."""
        t, late, end = T0 + 1, T0 + 26 * HOUR, T0 + HOUR
        row = lambda k, o, h="h": (0, k, t, o, at(o), "a", h, "x")
        batches = [[row(k, t) for k in range(5)] + [row(8, late), row(9, t, "g")], [row(k, t) for k in range(5, 8)] + [row(8, t), row(9, late)]]
        r = random.Random(5)
        more = deliveries(200)
        batches += [[x for x in more if x[0] % 3 == i] for i in range(3)]
        g = ["service_name"]
        states = [late_events.dots(self.frame(spark, b), **KW) for b in batches]
        value = lambda d: sorted(map(str, late_events.totals(late_events.versions(late_events.with_outcome(d), g), g).select("period_end", "service_name", "n", "dropped").collect()))
        two = late_events.merge_dots(states[:2], "log_id", g)
        assert {(x.period_end, x.n, x.dropped) for x in late_events.totals(late_events.versions(late_events.with_outcome(two), g), g).collect()} == {(end, 10, 0)}
        whole = value(late_events.dots(self.frame(spark, sum(batches, [])), **KW))
        r.shuffle(states)
        assert value(late_events.merge_dots([late_events.merge_dots(states[:2], "log_id", g), *states[1:]], "log_id", g)) == whole
        tagged = spark.createDataFrame([(*x, i) for i, b in enumerate(batches) for x in b], DELIVERY + ", batch_id int")
        per = late_events.dots(tagged, **KW, batch="batch_id")
        assert per.where("log_id = 8").count() >= 2
        assert value(late_events.merge_dots([per], "log_id", g)) == whole
        versions = [late_events.versions(late_events.with_outcome(s), g) for s in (late_events.dots(self.frame(spark, b), **KW) for b in batches[:2])]
        with pytest.raises(Exception, match="merge their dots"):
            late_events.totals(late_events.merge(versions, g), g).collect()

    def test_closed_periods(self, spark):
        """Closing on the way gives what one pass gives; counted records don't count again."""
        rows, g = deliveries(400, 3), ["service_name"]
        arrival = lambda r: r[3] or int((r[4] - UTC) / timedelta(microseconds=1)) * 1000
        rows.sort(key=arrival)
        now = T0 + 27 * HOUR
        cut = sum(arrival(r) < now for r in rows)
        outcome = lambda rows: late_events.with_outcome(late_events.dots(self.frame(spark, rows), **KW))
        key = lambda d: sorted(map(str, d.select("period_end", "service_name", "n", "dropped").collect()))
        value = lambda d: late_events.totals(late_events.versions(d, g), g)
        stay, shut, counted = late_events.close(outcome(rows[:cut]), "log_id", g, now)
        assert shut.count() and stay.count()
        later = late_events.reopen(late_events.dots(self.frame(spark, rows[cut:]), **KW), counted, "log_id")
        merged = late_events.with_outcome(late_events.merge_dots([stay.drop("outcome"), later], "log_id", g))
        assert key(late_events.add_totals([shut, value(merged)], g)) == key(value(outcome(rows)))

    def test_empty(self, spark):
        assert late_events.dots(self.frame(spark, []), **KW).count() == 0


def resolve(s, zone, rcv):
    """Plain reading of a few spellings, candidates by zoneinfo."""
    m = re.fullmatch(r"([A-Z][a-z]{2}) +(\d+) (\d\d):(\d\d):(\d\d)", s) or re.fullmatch(r"(\d{4})-(\d\d)-(\d\d) (\d\d):(\d\d):(\d\d)", s)
    g = m.groups()
    months = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
    years = [int(g[0])] if g[0].isdigit() else [rcv.year - 1, rcv.year, rcv.year + 1]
    mo, rest = (int(g[1]), g[2:]) if g[0].isdigit() else (months.index(g[0]) + 1, g[1:])
    best = None
    for y in years:
        try:
            t = datetime(y, mo, *map(int, rest))
        except ValueError:
            continue
        tz, c = ZoneInfo(zone), []
        for fold in (0, 1):
            u = t - t.replace(tzinfo=tz, fold=fold).utcoffset()
            if u.replace(tzinfo=timezone.utc).astimezone(tz).replace(tzinfo=None) == t:
                c.append(u)
        for u in c or [t - t.replace(tzinfo=tz, fold=0).utcoffset()]:
            k = (abs(u - rcv), u)
            best = k if best is None or k < best else best
    return best and int((best[1] - UTC) / timedelta(microseconds=1))


class TestInstants:
    def test_numbers_keep_every_digit(self, spark):
        ns = [1_748_779_200_123_456_789 + 997 * i for i in range(500)]
        rows = [(i, v) for i, v in enumerate([*ns, *[n // 1000 for n in ns], *[n // 1_000_000 for n in ns], 1_748_779_200, 0, -5, None])]
        got = {r.id: r.utc_us for r in instants.normalise_numbers(spark.createDataFrame(rows, "id bigint, n bigint"), "n").collect()}
        want = [n // 1000 for n in ns] * 2 + [n // 1_000_000 * 1000 for n in ns] + [1_748_779_200_000_000, None, None, None]
        assert [got[i] for i in range(len(rows))] == want

    def test_unknown_zone_names_are_no_zones(self, spark):
        hosts = spark.createDataFrame([("b", "Europe/Berlin"), ("x", "Mars/Base")], "host_name string, tz_name string")
        df = spark.createDataFrame([(1, "2025-06-01 14:00:00", datetime(2025, 6, 1, 12), "x"), (2, "2025-06-01 14:00:00", datetime(2025, 6, 1, 12), "b")], "id int, ts string, received_at timestamp, host_name string")
        got = {r.id: r.utc_us for r in instants.normalise(df, "ts", "received_at", "host_name", hosts).collect()}
        assert got == {1: None, 2: 1_748_779_200_000_000}

    SCHEMA = "id bigint, ts string, received_at timestamp, host_name string, utc_day string"

    def run(self, spark, rows):
        hosts = spark.createDataFrame([("b", "Europe/Berlin"), ("n", "America/New_York"), ("s", "Australia/Sydney"), ("k", "Asia/Kolkata"), ("u", None)], "host_name string, tz_name string")
        df = spark.createDataFrame([(i, *r, "x") for i, r in enumerate(rows)], self.SCHEMA)
        return {r.id: r.utc_us for r in instants.normalise(df, "ts", "received_at", "host_name", hosts).collect()}

    def test_spellings(self, spark):
        rcv = datetime(2025, 6, 1, 12, 0, 5)
        us = int((datetime(2025, 6, 1, 12, 0, 0) - UTC) / timedelta(microseconds=1))
        same = ["2025-06-01T12:00:00Z", "2025-06-01T14:00:00+02:00", "2025-06-01T14:00:00.000000+0200", "20250601T120000Z", "01/Jun/2025:14:00:00 +0200", "Sun, 01 Jun 2025 08:00:00 -0400", "2025-06-01 14:00:00", "Jun  1 14:00:00", "*Jun  1 14:00:00.000",
                "Jun  1 2025 14:00:00", "01-Jun-2025 02:00:00 PM", "2025-06-01 14:00:00 CEST", "2025-06-01 14:00:00,000+02:00", "1748779200", "1748779200000", "+1748779200000", " 1748779200000", "1748779200000000000", "1.7487792E+9", "2025/06/01 14:00:00.000"]
        got = self.run(spark, [(s, rcv, " B.example.org") for s in same])
        assert {same[i]: v for i, v in got.items()} == {s: us for s in same}
        bad = [None, "", "-", "NaN", "0", "123", "clock not set", "1970-13-45 99:99", "2025-02-30 00:00:00", "2025-06-01 14:00:00 XYZT", "Foo 99 11:11:11", "é" * 5000]
        assert set(self.run(spark, [(s, rcv, "b") for s in bad]).values()) == {None}
        for host in (None, "", "unknown", "u"):
            assert self.run(spark, [("2025-06-01 14:00:00", rcv, host), ("2025-06-01T12:00:00Z", rcv, host), ("2025-06-01 14:00:00 CEST", rcv, host)]) == {0: None, 1: us, 2: us}

    def test_clock_changes_and_years(self, spark):
        rows = []
        for zone, h in (("Europe/Berlin", "b"), ("America/New_York", "n"), ("Australia/Sydney", "s"), ("Asia/Kolkata", "k")):
            for s in ("2025-10-26 02:30:00", "2025-03-30 02:30:00", "2025-11-02 01:30:00", "2025-03-09 02:30:00", "2025-04-06 02:15:00", "Dec 31 23:59:59", "Jan  1 00:00:10", "Feb 29 10:00:00"):
                for rcv in (datetime(2025, 10, 26, 0, 31), datetime(2025, 10, 26, 1, 31), datetime(2026, 1, 1, 0, 1), datetime(2025, 11, 2, 6, 31), datetime(2024, 12, 31, 23, 0)):
                    rows.append((s, zone, h, rcv))
        got = self.run(spark, [(s, rcv, h) for s, _, h, rcv in rows])
        for i, (s, zone, _, rcv) in enumerate(rows):
            assert got[i] == resolve(s, zone, rcv), (s, zone, rcv)

    def test_zone_is_estimated(self, spark):
        r, rows = random.Random(3), []
        for h, zone in (("b", "Europe/Berlin"), ("n", "America/New_York"), ("s", "Australia/Sydney")):
            for _ in range(40):
                u = datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=r.randrange(500_000))
                rows.append((u.astimezone(ZoneInfo(zone)).strftime("%Y-%m-%d %H:%M:%S"), (u + timedelta(seconds=r.randrange(60))).replace(tzinfo=None), h))
        df = spark.createDataFrame(rows + [(None, None, None)], "ts string, received_at timestamp, host string")
        est = instants.estimate_zones(df, "ts", "received_at", "host", ["America/New_York", "Asia/Kolkata", "Australia/Sydney", "Europe/Berlin", "UTC"])
        assert {x.host: x.tz_name for x in est.collect()} == {"b": "Europe/Berlin", "n": "America/New_York", "s": "Australia/Sydney"}

    def test_zone_is_estimated_from_all_spellings_and_converts(self, spark, tmp_path):
        """Each host writes one spelling; those without a zone in hosts get the estimated one."""
        r, syslog, samples, want = random.Random(4), [], [], {}
        zones = {"b": "Europe/Berlin", "n": "America/New_York", "s": "Australia/Sydney", "k": "Asia/Kolkata"}
        spellings = {"b": "%b %d %H:%M:%S", "n": "%d-%b-%Y %I:%M:%S %p", "s": "*%b %d %H:%M:%S.000", "k": "%b %d %Y %H:%M:%S"}
        for h, zone in zones.items():
            for _ in range(30):
                u = datetime(2025, 1, 1, tzinfo=timezone.utc) + timedelta(minutes=r.randrange(500_000))
                rows, origin = (samples, "samples") if h == "k" else (syslog, "syslog")
                want[origin, len(rows)] = int(u.timestamp()) * 1_000_000
                rows.append((len(rows), u.astimezone(ZoneInfo(zone)).strftime(spellings[h]), (u + timedelta(seconds=r.randrange(60))).replace(tzinfo=None), h))
        for name, rows, schema in (
            ("syslog_records", [*syslog, (999, None, None, None)], "record_id bigint, syslog_timestamp string, received_at timestamp, host_name string"),
            ("samples", samples, "sample_id bigint, sample_timestamp string, received_at timestamp, host_name string"),
            ("metric_points", [], "point_id bigint, point_timestamp bigint"),
            ("hosts", [(h, None) for h in zones] + [(f"x{i}", z) for i, z in enumerate(zones.values())], "host_name string, tz_name string"),
        ):
            spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
        assert {x.host: (x.tz_name, x.n, x.violations) for x in problems.p2_zones(spark, str(tmp_path)).collect()} == {h: (z, 30, 0) for h, z in zones.items()}
        assert {(x.origin, x.row_id): x.utc_us for x in problems.p2_found(spark, str(tmp_path)).collect()} == want


class TestRegularGrid:
    def test_against_dense_posterior(self):
        """The smoother equals conditioning the model's joint normal distribution."""
        rng = np.random.default_rng(0)
        T, dt = 12, 10.0
        n = (rng.random((T, 1)) < 0.6).astype(int)
        n[0] = n[-1] = 1
        obs, off = np.where(n > 0, rng.normal(size=(T, 1)) * 3 + 5, 0), np.where(n > 0, rng.random((T, 1)) * dt, 0)
        level, sd = regular_grid.smooth(obs, n, off, np.array([dt]))
        idx = np.flatnonzero(n[:, 0])
        y, to = obs[idx, 0], idx * dt + off[idx, 0]
        d2 = np.mean(np.diff(y) ** 2) * (len(y) - 1) / (len(y) - 1)
        mean = y.mean()
        floor = 1e-12 * (1 + mean**2)
        r = max(0.4 * d2, floor)
        ql = max(0.2 * np.mean(np.diff(y) ** 2 / np.diff(idx)), floor) / dt
        qs = 1e-3 * ql / dt**2
        p0, s0 = 10 * r + d2 + floor, (d2 + floor) / dt**2
        def cov(t, u):
            m = np.minimum(t, u)
            return p0 + s0 * t * u + ql * m + qs * (m**2 * np.maximum(t, u) / 2 - m**3 / 6)
        tg = np.arange(T) * dt
        Koo = cov(to[:, None], to[None, :]) + r * np.eye(len(to))
        Kgo = cov(tg[:, None], to[None, :])
        want = y[0] + Kgo @ np.linalg.solve(Koo, y - y[0])
        var = cov(tg, tg) - np.einsum("ij,ji->i", Kgo, np.linalg.solve(Koo, Kgo.T))
        assert np.allclose(level[:, 0], want, rtol=1e-6, atol=1e-6)
        assert np.allclose(sd[:, 0], np.sqrt(var), rtol=1e-5, atol=1e-6)

    def test_grid(self, spark):
        base = T0
        rows = [(1, 10, base + s * 1_000_000_000, v) for s, v in [(0, 1.0), (3, 1.2), (12, 2.0), (61, 5.0), (61, 5.0)]]
        rows += [(2, 60, base, 4.0), (1, 10, base + 86_400_000_000_000 + 5, 9.0), (1, 10, base + 86_400_000_000_000 + 31_000_000_000, 9.0), (None, 10, base, 1.0), (3, None, base, 1.0), (3, 0, base, 1.0), (3, 10, None, 1.0), (3, 10, base, None)]
        out = regular_grid.regular_grid(spark.createDataFrame(rows, "series_id bigint, interval_s bigint, ns bigint, value double")).collect()
        s0 = base // 1_000_000_000
        missing = {(r.series_id, r.slot_start - s0) for r in out if r.missing}
        assert missing == {(1, x) for x in (20, 30, 40, 50)} | {(1, 86400 + x) for x in (10, 20)}
        assert len(out) == 7 + 1 + 4
        assert all(math.isfinite(r.value) and r.stddev >= 0 for r in out)
        one = [r for r in out if r.series_id == 2][0]
        assert one.value == pytest.approx(4.0)

    def test_constant_and_empty(self, spark):
        rows = [(1, 1, T0 + i * 7_000_000_000, 3.5) for i in range(500)]
        out = regular_grid.regular_grid(spark.createDataFrame(rows, "series_id bigint, interval_s bigint, ns bigint, value double")).collect()
        assert len(out) == 499 * 7 + 1 and all(abs(r.value - 3.5) < 1e-3 for r in out)
        assert regular_grid.regular_grid(spark.createDataFrame([], "series_id bigint, interval_s bigint, ns bigint, value double")).count() == 0


class TestExactlyOnce:
    def rows(self, n=4000, seed=2):
        r = random.Random(seed)
        return [(i, None if r.random() < 0.05 else r.randrange(30), r.randrange(20), r.choice([0.0, 1.5, None]), "z") for i in range(n)] + [(None, 1, 1, 1.5, "z")]

    def want(self, rows):
        least = {}
        for i, *ident, _ in rows:
            if i is not None:
                least[tuple(ident)] = min(least.get(tuple(ident), i), i)
        return {(least[tuple(k)], i) for i, *k, _ in rows if tuple(k) in least and least[tuple(k)] != i}

    def test_copies(self, spark, monkeypatch):
        rows = self.rows()
        df = spark.createDataFrame(rows, "point_id bigint, a bigint, b bigint, v double, shard string").repartition(3)
        plain = {(r.kept_id, r.copy_id) for r in exactly_once.copies(df, ["a", "b", "v"], "point_id").collect()}
        assert plain == self.want(rows)
        monkeypatch.setattr(exactly_once, "HOT_LEAST", 5)
        assert {(r.kept_id, r.copy_id) for r in exactly_once.copies(df, ["a", "b", "v"], "point_id").collect()} == plain
        monkeypatch.setattr(exactly_once, "SHARD_ROWS", 50)
        assert {(r.kept_id, r.copy_id) for r in exactly_once.copies(df, ["a", "b", "v"], "point_id").collect()} == plain
        assert exactly_once.copies(df.limit(0), ["a", "b", "v"], "point_id").count() == 0

    def test_hot_values_are_found(self, spark):
        df = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("bigint").alias("k"))
        assert hot_values(df, F.col("k")) == ([7], 60_000)

    def test_ledger(self, spark, tmp_path):
        ledger = str(tmp_path / "ledger")
        frame = lambda rows: spark.createDataFrame(rows, "id bigint, a string, v double")
        ids = lambda rows, name, **k: sorted(r.id for r in exactly_once.apply_batch(frame(rows), ["a", "v"], "id", ledger, name, **k).collect())
        one = [(1, "x", 1.0), (2, "x", 1.0), (3, "y", None), (4, None, 2.0), (9, "y", None), (15, "n", float("nan")), (16, "n", float("nan")), (17, "o", 0.0), (18, "o", -0.0)]
        assert ids(one, "one", shards=4) == [1, 3, 4, 15, 17]
        assert ids(one, "one") == [1, 3, 4, 15, 17]  # a retry gives what the batch gave
        assert ids(one, "again", shards=7) == []  # the ledger's own number of shards holds
        two = [(10, "x", 1.0), (11, "z", 0.0), (12, None, 2.0), (13, "z", 1.0)]
        assert ids(two, "two") == [11, 13]
        assert ids([], "none") == []
        d = exactly_once.dictionary(spark, ledger)
        assert d.count() == 7 and d.select("shard", "code").distinct().count() == 7
        assert exactly_once.bitmaps(spark, ledger).agg(F.sum(F.bitmap_count("bitmap"))).first()[0] == 7
        assert [c["batch"] for c in exactly_once.commits(spark, ledger)] == ["one", "again", "two", "none"]

    def test_clashing_names_and_nulls(self, spark, tmp_path):
        rows = [(5, None, "a", 1), (3, None, "a", 2), (7, 1, None, 3), (None, 1, None, 4), (8, 2, "", 5)]
        df = spark.createDataFrame(rows, "row_id bigint, shard int, code string, n int")
        assert {(r.kept_id, r.copy_id) for r in exactly_once.copies(df, ["shard", "code"], "row_id").collect()} == {(3, 5), (7, None)}
        got = exactly_once.apply_batch(df, ["shard", "code"], "row_id", str(tmp_path / "l"), "b")
        assert got.columns == ["shard", "code", "row_id"] and sorted(r.row_id for r in got.collect()) == [3, 7, 8]

    def test_second_writer_fails(self, spark, tmp_path):
        ledger = str(tmp_path / "ledger")
        exactly_once._publish(spark, ledger, {"number": 0, "batch": "a", "folder": "x", "shards": 1, "rows": 0})
        with pytest.raises(exactly_once.LedgerConflict):
            exactly_once._publish(spark, ledger, {"number": 0, "batch": "b", "folder": "y", "shards": 1, "rows": 0})
        assert [c["batch"] for c in exactly_once.commits(spark, ledger)] == ["a"]

    def test_codes_in_parts_are_dense(self, spark):
        d = spark.range(500).select((F.col("id") % 3).alias("shard"), F.col("id").alias("k"))
        got = {}
        for r in exactly_once.numbered(d, ["k"], parts=4).collect():
            got.setdefault(r.shard, set()).add(r.code)
        assert got == {s: set(range(len([i for i in range(500) if i % 3 == s]))) for s in range(3)}

    def test_series_that_share_a_hash(self, spark):
        rows = [(i, 7 if i % 3 else i, f"m{i % 3}", "h", ["t"]) for i in range(9)]
        r = spark.createDataFrame(rows, "point_id int, series_h bigint, metric_key string, host_key string, tag_set array<string>")
        got = {x.point_id: (x.series_h, x.series_twin) for x in identity.with_exact_series(r).collect()}
        assert {got[i] for i in range(9) if i % 3 == 1} != {got[i] for i in range(9) if i % 3 == 2}
        assert len(set(got.values())) == 5


LINES = [
    ("<34>Jan  9 02:19:36 core-058 cronish[40845]: retry 44", ("core-058", "cronish", "40845", "", "fatal")),
    ("<35>Jan  9 02:19:36 cronish: retry", ("", "cronish", "", "", "error")),
    ("83 <36>1 2024-01-09T03:40:32.213000+00:00 core-010 tide/x 45598 JOB28 [a b=\"c \\] d\"] hi", ("core-010", "tide/x", "45598", "JOB28", "warn")),
    ("<39>1 2024-01-09T03:40:32Z - app - - - hi", ("", "app", "", "", "debug")),
    ('{"time":"2024-01-04T00:26:46.583Z","level":"notice","logger":"g","host":"h","pid":11,"message":"a \\"level\\": x"}', ("h", "g", "11", "", "info")),
    ("[07/Jan/2024:08:44:18 +0000] [tide:SEVERE] [pid main] opened", ("", "tide", "main", "", "error")),
    ("ts=2024-01-07T19:01:55Z host=c pid=w3 component=x level=PANIC msg=\"level=debug\"", ("c", "x", "w3", "", "fatal")),
    ("2024-01-05 15:34:01,438 \x1b[36mtrace\x1b[0m [x] (pid 5) ERROR budget", ("", "x", "5", "", "trace")),
    ("2024-01-05 15:34:01,438 WARNING [x/y] (pid 5) z\r", ("", "x/y", "5", "", "warn")),
    ("F0110 10:25:57.592617   50274 cron] retry", ("", "cron", "50274", "", "fatal")),
]
REST = ["\tat a.b(c:1)", "", None, "> <143>relayed", "<143>no time", "{", '  "k0": 1,', "  2025-04-01 11:49:36 x", "00000020  6d", "select 1", "<34>1 - h a - - - x", "2024-01-05 15:34:01,438 shouting [x] y", "é" * 3000, "[notes] x", "ts=soon level=info", "12 monkeys"]


class TestLogEntries:
    def test_heads(self):
        for line, want in LINES:
            h = dict(zip(log_entries.FIELDS, log_entries.head(line), strict=True))
            assert (h["host_name"], h["syslog_tag"], h["process_pid"], h["syslog_msgid"], h["severity"]) == want, line
            assert h["timestamp"]
        for line in REST:
            assert log_entries.head(line) is None, line

    def test_every_cut_is_safe(self):
        for line, _ in LINES:
            for i in range(len(line)):
                log_entries.head(line[:i])

    @pytest.mark.parametrize("block", [3, 4096])
    def test_continuations(self, spark, monkeypatch, block):
        monkeypatch.setattr(log_entries, "BLOCK", block)
        r, rows, want = random.Random(4), [], {}
        for stream in (1, 2, 3):
            head = None
            for no in range(1, 120):
                line = r.choice(LINES)[0] if r.random() < 0.3 and no > 5 * stream else r.choice(REST)
                ident = stream * 1000 + no
                rows.append((ident, stream, no, line, "clash"))
                if log_entries.head(line):
                    head = ident
                if head:
                    want.setdefault(head, []).append(line)
        rows.append((99, None, 1, LINES[0][0], ""))
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "line_id bigint, stream_id bigint, line_no bigint, raw_line string, block string")
        got = {}
        for x in sorted(log_entries.entries(df, with_message=True).collect(), key=lambda x: x.part):
            got[x.head_line_id] = (x.n_lines, "\n".join([got[x.head_line_id][1], x.message]) if x.part else x.message)
        assert {k: v[0] for k, v in got.items()} == {k: len(v) for k, v in want.items()}
        for k, v in want.items():
            rest = [x.removesuffix("\r") for x in v[1:] if x is not None]
            assert got[k][1].split("\n")[1:] == rest or not rest
        assert {x.head_line_id: x.n_lines for x in log_entries.entries(df).collect()} == {k: v[0] for k, v in got.items()}
        assert log_entries.entries(df.limit(0)).count() == 0

    def test_long_entries_come_in_parts(self, spark, monkeypatch):
        monkeypatch.setattr(log_entries, "BLOCK", 10)
        rows = [(1, 1, 5, LINES[1][0])] + [(i, 1, i, f"line {i}") for i in range(6, 40)]
        df = spark.createDataFrame(rows, "line_id bigint, stream_id bigint, line_no bigint, raw_line string")
        got = sorted(log_entries.entries(df, with_message=True).collect(), key=lambda r: r.part)
        assert [r.part for r in got] == [0, 1, 2, 3] and {r.n_lines for r in got} == {35}
        assert "\n".join(r.message for r in got).split("\n")[1:] == [f"line {i}" for i in range(6, 40)]
        assert log_entries.entries(df).collect()[0].n_lines == 35


class TestShared:
    def test_join_sized(self, spark):
        big = spark.createDataFrame([(i % 5 if i % 7 else None, i) for i in range(100)], "k int, v int")
        small = spark.createDataFrame([(0, "a"), (1, "b"), (2, None)], "k int, w string")
        a = sorted(map(str, join_sized(big, small, ["k"], "left").collect()))
        assert a == sorted(map(str, join_sized(big, small, ["k"], "left", rows=10**9).select("k", "v", "w").collect()))

    def test_prefix(self, spark):
        df = spark.createDataFrame([(i % 2, i // 10, i, i % 7) for i in range(100)], "g int, b int, o int, v int")
        for by in (["g"], []):
            got = {(r.g, r.o): r.p for r in bucketed_prefix(df, by, "b", ["o"], "v", "p").collect()}
            for g, o in got:
                assert got[(g, o)] == sum(i % 7 for i in range(o) if not by or i % 2 == g)

    def test_materialise_and_identity(self, spark):
        df = spark.createDataFrame([("M ", " H.x.y", ["b", "a", "b", None], 1_704_067_200_123, 1.0, 0), (None, None, None, 1_704_067_200, 0.0, None), ("m", "h", ["a", "b"], 5, 1.0, 0), ("m", "h", [], 1_704_067_200, float("inf"), 0), ("m", "h", [], 1_704_067_200, 1.0, 3)],
                                   "metric string, host_name string, tags array<string>, point_timestamp bigint, point_value double, flags int").withColumn("point_id", F.monotonically_increasing_id())
        rows = materialise(identity.readings(df)).collect()
        assert {(r.metric_key, r.host_key, tuple(r.tag_set), r.ns) for r in rows} == {("m", "h", ("a", "b"), 1_704_067_200_123_000_000), (None, None, (), 1_704_067_200_000_000_000)}
