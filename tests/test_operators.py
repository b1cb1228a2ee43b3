"""Operators on small made inputs, and the registered queries against DuckDB."""

import math
import os
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stintlab.functions import geo, stats, units
from stintlab.operators import along, intervals, sectors, timeseries, track
from stintlab.plans import registered

SF = "/root/testdata/sf0.001"
QUERIES, SQL = registered()
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


def samples(spark, rows):
    return spark.createDataFrame(rows, "run_id long, channel string, t double, v double")


def test_order_statistics_differ(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 4, 8)], "x double")
    x = F.col("x")
    row = df.agg(stats.quartiles(x)[1], stats.median(x), stats.upper_median("x"), stats.nearest_rank("x", 0.9)).first()
    assert tuple(row) == (1.75, 3.0, 4.0, 8.0)
    assert df.where("x > 9").agg(stats.upper_median("x")).first()[0] is None
    rng = random.Random(1)
    rows = [(g, rng.choice([None, float(rng.randint(0, 9)), rng.random()])) for g in range(60) for _ in range(g)]
    many = spark.createDataFrame(rows, "g long, x double")
    got = {r.g: r for r in many.groupBy("g").agg(stats.upper_median("x").alias("u"), stats.nearest_rank("x", 0.95).alias("n")).collect()}
    ranked = {r.g: r.x for r in stats.rounded_rank(many, ["g"], "x", 0.95).collect()}
    for g, r in got.items():
        own = sorted(v for k, v in rows if k == g and v is not None)
        if own:
            assert r.u == own[len(own) // 2] and r.n == own[max(1, math.ceil(round(0.95 * len(own), 9))) - 1]
            assert ranked[g] == own[int((len(own) - 1) * 0.95 + 0.5)]


def test_units_and_kinds_of_channels(spark):
    df = spark.createDataFrame([("velocity", "", "km/hr"), ("Speed", "mi/h", ""), ("oil_temp", "°C", ""), ("gps heading (deg)", "°", ""), ("heading_rate", "deg", "")], "name string, unit string, assumed string")
    rows = df.select(units.is_speed(F.col("name")), units.is_temperature(F.col("name")), units.is_direction(F.col("name"), F.col("unit")), units.effective_unit(F.col("unit"), F.col("name"), F.col("assumed"))).collect()
    assert [tuple(r) for r in rows] == [(True, False, False, "km/h"), (True, False, False, "mph"), (False, True, False, "°C"), (False, False, True, "°"), (False, False, False, "deg")]
    one = spark.range(1)
    same = lambda a, b: one.select(units.same_speed_unit(F.lit(a), F.lit(b))).first()[0]
    assert same("kph", "km/h") and same("", " ") and same("M/S", "m/s") and not same("", "km/h") and not same("mph", "kn")
    headers = F.array(F.lit("velocity kmh"), F.lit("temp deg C"))
    assert tuple(one.select(units.declared_unit(F.lit(""), F.lit("Temp"), headers), units.declared_unit(F.lit("F"), F.lit("temp"), headers), units.declared_unit(F.lit(""), F.lit("x"), headers)).first()) == ("deg C", "F", "")
    numbers = [one.select(units.setup_number(F.lit(x))).first()[0] for x in ("1 23.5", ".5", "1,5", "", ".", "1234", "1.234")]
    assert numbers == [123.5, 0.5, None, None, None, None, None]
    assert one.select(units.celsius(F.lit(50.0), F.lit("°F"))).first()[0] == pytest.approx(10.0)


def test_plausible_samples_relinked_runs_and_midpoints(spark):
    from stintlab.operators import matching, quality

    rows = [(1, "oil", float(i), v) for i, v in enumerate([0.0, 80.0, 90.0, 300.0, 85.0])]
    assert [r.v for r in quality.plausible(samples(spark, rows), -50.0, 200.0).orderBy("t").collect()] == [80.0, 90.0, 85.0]
    assert tuple(spark.range(1).select(*geo.midpoint(F.lit(10.0), F.lit(179.0), F.lit(12.0), F.lit(-177.0))).first()) == pytest.approx((11.0, -179.0))
    missing = spark.createDataFrame([(1, "aa", "f1", "x.vbo"), (2, "zz", "f2", "y.vbo"), (3, "zz", None, "x.vbo"), (4, "q", "q", "q")], "id long, sha256 string, fingerprint string, name string")
    files = spark.createDataFrame([("p2", "aa", "f9", "n"), ("p1", "aa", "f2", "n"), ("p3", "bb", "f2", "x.vbo")], "path string, sha256 string, fingerprint string, name string")
    assert {r.id: (r.path, r["by"]) for r in matching.relinked(missing, files).collect()} == {1: ("p1", "sha256"), 2: ("p1", "fingerprint"), 3: ("p3", "name"), 4: (None, None)}


def test_nothing_is_read_across_a_gap(spark):
    rows = [(1, "a", float(t), float(t)) for t in (0, 1, 2, 3, 20, 21, 22)]
    df = samples(spark, rows)
    assert [r.piece for r in timeseries.with_pieces(df).orderBy("t").collect()] == [0] * 4 + [1] * 3
    probes = spark.createDataFrame([(1, t) for t in (-1.0, 0.5, 3.0, 10.0, 20.5, 30.0)], "run_id long, t double")
    got = {m: [r.value for r in timeseries.as_of(probes, df, m).orderBy("t").collect()] for m in ("previous", "nearest", "linear")}
    assert got["linear"] == [None, 0.5, 3.0, None, 20.5, None]
    assert got["previous"] == [None, 0.0, 3.0, None, 20.0, None]
    assert got["nearest"] == [0.0, 0.0, 3.0, None, 20.0, None]


def test_episodes_are_those_of_a_loop(spark):
    rng = random.Random(2)
    rows, expected = [], []
    for run in range(6):
        t, on, start, piece = 0.0, False, 0.0, []
        for _ in range(60):
            t += 1.0 if rng.random() < 0.95 else 9.0
            piece.append((t, rng.random()))
        rows += [(run, "v", a, b) for a, b in piece]
        last = None
        for a, b in piece:
            if last is not None and a - last > 3 and on:
                expected.append((run, start, last))
                on = False
            if on and b < 0.3:
                expected.append((run, start, a))
                on = False
            elif not on and b >= 0.7:
                on, start = True, a
            last = a
        if on:
            expected.append((run, start, last))
    got = [(r.run_id, r.t0, r.t1) for r in timeseries.episodes(samples(spark, rows), 0.7, 0.3).collect()]
    assert sorted(got) == sorted(expected)
    with pytest.raises(ValueError):
        timeseries.episodes(samples(spark, rows), 0.3, 0.3)


def test_interval_algebra_is_that_of_sets(spark):
    rng = random.Random(3)

    def made(k):
        out = []
        for key in range(3):
            for _ in range(k):
                a = rng.randrange(60)
                out.append((key, a, a + rng.randrange(6)))
        return out

    a, b = made(9), made(9)
    da, db = (spark.createDataFrame(x, "k long, t0 long, t1 long") for x in (a, b))

    def points(rows, key):
        return {p for k, s, e in rows if k == key for p in range(s, e)}

    for fn, op in ((intervals.intersect, set.__and__), (intervals.subtract, set.__sub__)):
        got = [tuple(r) for r in fn(da, db, ["k"]).collect()]
        for key in range(3):
            assert points(got, key) == op(points(a, key), points(b, key))
            own = sorted((s, e) for k, s, e in got if k == key)
            assert all(x[1] < y[0] for x, y in zip(own, own[1:], strict=False))


def test_quickest_chain_is_the_least_of_all():
    rng = random.Random(4)
    for _ in range(50):
        n = [rng.randint(1, 4) for _ in range(4)]
        s, en, ex = ([[rng.random() * 3 for _ in range(k)] for k in n] for _ in range(3))
        best = math.inf
        for c in pd.MultiIndex.from_product([range(k) for k in n]):
            if all(abs(ex[i][c[i]] - en[i + 1][c[i + 1]]) <= 1 for i in range(3)):
                best = min(best, sum(s[i][c[i]] for i in range(4)))
        got = sectors.quickest_chain(s, en, ex, 1.0)
        assert (got[0] if got else math.inf) == pytest.approx(best)


def test_realistic_best_joins_laps_as_the_layout_says(spark):
    rng = random.Random(8)

    def brute(s, en, ex, laps, meets, closes):
        best, n = math.inf, len(s)
        for c in pd.MultiIndex.from_product([range(len(x)) for x in s]):
            def joins(i, j):
                a, b = ex[i][c[i]], en[j][c[j]]
                return laps[i][c[i]] == laps[j][c[j]] or a is not None and b is not None and abs(a - b) <= 0.5

            if all(joins(i, i + 1) for i in range(n - 1) if meets[i]) and (not closes or joins(n - 1, 0)):
                best = min(best, sum(s[i][c[i]] for i in range(n)))
        return best

    for _ in range(150):
        laps = [rng.sample(range(6), rng.randint(1, 5)) for _ in range(4)]
        s = [[rng.random() * 3 for _ in k] for k in laps]
        en, ex = ([[None if rng.random() < 0.2 else rng.randint(0, 12) / 4 for _ in k] for k in laps] for _ in range(2))
        meets, closes = [rng.random() < 0.8 for _ in range(3)], rng.random() < 0.6
        got = sectors.quickest_chain(s, en, ex, 0.5, laps, meets, closes)
        assert (got[0] if got else math.inf) == pytest.approx(brute(s, en, ex, laps, meets, closes))

    rows = [(1, 1, 1, k, 10.0, 30.0, 40.0) for k in (1, 2, 3)]  # a lap joins itself at any speeds
    rows += [(1, 1, 2, k, 9.0, None, None) for k in (1, 3)]
    rows += [(2, 1, 1, k, 10.0, 30.0, 40.0) for k in (1, 3)]  # a segment without a passage
    rows += [(3, 1, 1, k, 10.0, 30.0, 30.0) for k in (1, 2, 3)] + [(3, 1, 2, 1, 8.0, 20.0, 30.0), (3, 2, 2, 3, 7.0, 30.0, 30.0)]
    times = spark.createDataFrame(rows, "group_id long, run_id long, lap_no long, segment long, seconds double, entry double, exit double")
    closed = {r.group_id: (r.realistic_s, r.laps) for r in sectors.realistic_best(times, 3, closes=True).collect()}
    assert closed == {1: (30.0, [1, 1, 1]), 2: (None, []), 3: (27.0, [1, 1, 2])}
    assert {r.group_id: r.realistic_s for r in sectors.realistic_best(times, 3).collect()}[3] == 25.0


def test_laps_of_a_circle(spark):
    rows, period = [], 31.4
    for i in range(1000):
        t = i * 0.1
        a = 2 * math.pi * t / period
        rows.append((1, t, 100 * math.cos(a), 100 * math.sin(a)))
    fixes = spark.createDataFrame(rows, "run_id long, t double, east double, north double")
    passes = track.gate_passes(fixes, (-110.0, 0.0, -90.0, 0.0))
    got = [(r.t, r.direction) for r in passes.orderBy("t").collect()]
    assert [t for t, _ in got] == pytest.approx([15.7, 47.1, 78.5], abs=0.01) and len({d for _, d in got}) == 1
    laps = track.laps_of(passes).collect()
    assert [r.seconds for r in laps] == pytest.approx([period, period], abs=0.01)
    with pytest.raises(ValueError):
        track.gate_passes(fixes, (0.0, 0.0, 0.0, 0.5))


def test_axis_progress_and_delta(spark):
    line = track.axis_of(spark.createDataFrame([(1, i, 10.0 * i, 0.0) for i in range(50)], "axis_id long, idx long, east double, north double"))
    points = spark.createDataFrame([(k, 1, 3.0 + 10 * k, (-1.0) ** k * 2) for k in range(40)] + [(99, 1, 100.0, 90.0), (98, 2, 100.0, 2.0)], "point_id long, axis_id long, east double, north double")
    got = {r.point_id: r for r in track.nearest(points, line).collect()}
    assert not {98, 99} & set(got) and all(got[k].progress_m == 10.0 * k for k in range(40))
    progress = spark.createDataFrame([(1, 1, lap, v * t, float(t)) for lap, v in ((1, 20.0), (2, 25.0)) for t in range(20)], "axis_id long, run_id long, lap_no long, progress_m double, t double")
    pairs = spark.createDataFrame([(1, 1, 1, 1, 2)], "axis_id long, a_run long, a_lap long, b_run long, b_lap long")
    delta = {r.at_m: r.delta_s for r in along.timed_delta(progress, pairs, 50.0).collect()}
    assert delta[0.0] == 0.0 and delta[300.0] == pytest.approx(300 / 20 - 300 / 25)


def test_units_and_geodesy(spark):
    df = spark.createDataFrame([("12:34:56.5",), ("123456.5",), ("17.25",), ("25:00:00",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(units.parse_clock(F.col("s"))).collect()] == [45296.5, 45296.5, 17.25, None, None, None]
    one = spark.range(1)
    assert one.select(units.lap_time_text(F.lit(109.898))).first()[0] == "1:49.898"
    assert one.select(units.speed_in_mps(F.lit(36.0), F.lit("km/h"))).first()[0] == pytest.approx(10.0)
    lat, lon = geo.unproject(*geo.project(F.lit(52.1), F.lit(-179.9), F.lit(52.0), F.lit(179.9)), F.lit(52.0), F.lit(179.9))
    assert tuple(one.select(lat, lon).first()) == pytest.approx((52.1, -179.9))
    assert one.select(geo.distance(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))).first()[0] == pytest.approx(111194.9, abs=0.1)


VBO = """File created
[header]
coordinate units = degrees
[laptiming]
Start 21.0000 52.0000 21.0000 52.0002 start
[column names]
time latitude longitude velocity velocity
[data]
23:59:58 52.0 21.0 1 10
23:59:59 52.1 21.0 2 x
00:00:00 52.2 21.0 3 30
00:00:01 52.3 21.0 4 40
00:00:01 52.3 21.0 9 90
00:00:02 52.4 21.0
"""


def test_vbo_folder(spark, tmp_path):
    from stintlab.sources.vbo import read_vbo

    (tmp_path / "sub").mkdir()
    (tmp_path / "a.vbo").write_text(VBO)
    (tmp_path / "sub" / "copy.VBO").write_bytes(VBO.encode())
    (tmp_path / "bad.vbo").write_text("[data]\n1 2\n[data]\n")
    (tmp_path / "other.txt").write_text(VBO)
    read, notes = read_vbo(spark, str(tmp_path))
    rows = read.where("channel = 'velocity (2)'").orderBy("t").collect()
    assert [r.t for r in rows] == [86398.0, 86399.0, 86400.0, 86401.0] and [r.v for r in rows] == [10.0, None, 30.0, 40.0]
    kinds = notes.groupBy("kind").count().collect()
    assert {r["kind"]: r["count"] for r in kinds} == {"gate": 2, "note": 2, "error": 1}


def test_streamed_recordings_are_added_once(spark, tmp_path):
    from stintlab.streaming.day import follow, sessions

    source, schema = str(tmp_path / "in"), "run_id string, channel string, t double, v double"
    spark.createDataFrame([("a", "x", float(i), 1.0) for i in range(5)], schema).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    for _ in range(2):
        follow(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    spark.createDataFrame([("a", "x", 9.0, 1.0), ("b", "x", 0.0, 1.0)], schema).coalesce(1).write.mode("append").parquet(source)
    follow(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out" / "samples")).groupBy("run_id").count().collect()
    assert {r.run_id: r["count"] for r in got} == {"a": 6, "b": 1}
    timed = spark.createDataFrame([("a", "x", float(i), 1.0) for i in (0, 1, 2, 50, 51)], schema).withColumn("ts", F.timestamp_seconds("t"))
    assert sessions(timed).count() == 2


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


def _plain(df):
    df = df[sorted(df.columns)]
    rows = [["" if pd.isna(x) else f"{float(x):.4f}" if isinstance(x, float) or hasattr(x, "dtype") and x.dtype.kind == "f" else str(x) for x in row] for row in df.itertuples(index=False)]
    return sorted(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(spark, duck, name):
    a, b = QUERIES[name](spark, SF).toPandas(), duck.execute(SQL[name]).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert _plain(a) == _plain(b)


def test_queries_without_sql_run(spark):
    for name in set(QUERIES) - set(SQL):
        assert QUERIES[name](spark, SF).count() > 0


def test_a_pickup_that_is_let_go_again(spark):
    from stintlab.operators import pedals

    # window 1: picked up at 1.5 and let go at 3 while the speed rose by 1; window 2: kept; window 3: the speed rose by 20
    throttle = {1: [0, 0, 80, 0, 0, 0], 2: [0, 0, 80, 90, 90, 95], 3: [0, 0, 80, 0, 0, 0]}
    speed = {1: [10, 10, 10, 11, 11, 11], 2: [10, 12, 20, 30, 40, 50], 3: [10, 10, 10, 30, 31, 32]}
    rows = [(1, "x", w * 100.0 + i, float(v)) for w, vs in throttle.items() for i, v in enumerate(vs)]
    speeds = [(1, "v", w * 100.0 + i, float(v)) for w, vs in speed.items() for i, v in enumerate(vs)]
    windows = spark.createDataFrame([(1, w, w * 100.0, w * 100.0 + 5) for w in throttle], "run_id long, window_id long, t0 double, t1 double")
    got = pedals.pickup_then_lift(samples(spark, rows), samples(spark, speeds), windows, on=40.0, off=10.0, gain=5.0).collect()
    assert [(r.window_id, r.pickup_t, r.lift_t, r.gained) for r in got] == [(1, 101.5, 103.0, 1.0)]


def test_samples_find_the_last_window_that_began(spark):
    from stintlab.operators import pedals

    windows = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 2.0, 3.0), (1, 3, 5.0, 5.0), (2, 1, 1.0, 9.0)], "run_id long, window_id long, t0 double, t1 double")
    rows = samples(spark, [(1, "a", t, 1.0) for t in (-1.0, 0.0, 1.9, 2.0, 3.0, 3.1, 5.0, 6.0)] + [(2, "a", 9.0, 1.0), (3, "a", 1.0, 1.0)])
    got = sorted((r.run_id, r.t, r.window_id) for r in pedals.in_windows(rows, windows).collect())
    assert got == [(1, 0.0, 1), (1, 1.9, 1), (1, 2.0, 2), (1, 3.0, 2), (1, 5.0, 3), (2, 9.0, 1)]
