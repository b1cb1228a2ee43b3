"""A rounded rectangle driven at known speeds, and a made archive."""

import io
import json
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from stintlab.operators import along, corners, projection, shape

STRAIGHT, RADIUS, STEP = 200.0, 50.0, 2.0
LENGTH = 4 * STRAIGHT + 2 * math.pi * RADIUS


def place(s):
    """A point of the loop: four straights with a quarter circle after each."""
    part = STRAIGHT + math.pi * RADIUS / 2
    k, s = divmod(s % LENGTH, part)
    c, d = [(100.0, -150.0), (150.0, 100.0), (-100.0, 150.0), (-150.0, -100.0)], [(1, 0), (0, 1), (-1, 0), (0, -1)]
    e, n = c[int(k)]
    dx, dy = d[int(k)]
    if s <= STRAIGHT:
        return e - dx * (STRAIGHT - s), n - dy * (STRAIGHT - s)
    a = (s - STRAIGHT) / RADIUS
    return e + dx * RADIUS * math.sin(a) - dy * RADIUS * (1 - math.cos(a)), n + dy * RADIUS * math.sin(a) + dx * RADIUS * (1 - math.cos(a))


@pytest.fixture(scope="module")
def segments(spark):
    n = int(LENGTH / STEP)
    axis = spark.createDataFrame([(1, i, *place(i * LENGTH / n), i * LENGTH / n) for i in range(n)], "axis_id long, idx long, east double, north double, cum_m double")
    return corners.proposals(corners.features(axis)).cache()


@pytest.fixture(scope="module")
def progress(spark):
    rows = []
    for lap, v in ((1, 40.0), (2, 20.0)):
        t = lap * 1000.0
        for k in range(int(LENGTH)):
            speed = v if k % (STRAIGHT + math.pi * RADIUS / 2) < STRAIGHT else v / 2
            rows.append((1, lap, t, float(k), speed))
            t += 1 / speed
    return spark.createDataFrame(rows, "run_id long, lap_no long, t double, progress_m double, v double")


def test_proposals_are_four_corners_and_their_straights(segments):
    rows = segments.orderBy("start_m").collect()
    kinds = [r.kind for r in rows]
    assert kinds.count("corner") == 4
    for k, r in enumerate(r for r in rows if r.kind == "corner"):
        part = STRAIGHT + math.pi * RADIUS / 2
        assert r.start_m == pytest.approx(k * part + STRAIGHT, abs=8) and r.turn_rad == pytest.approx(math.pi / 2, abs=0.1)
    assert all(a.end_m == pytest.approx(b.start_m) for a, b in zip(rows, rows[1:], strict=False))


def test_sector_times_and_speeds(spark, progress):
    part = STRAIGHT + math.pi * RADIUS / 2
    made = [(1, 1, "straight", 0.0, 200.0), (1, 2, "corner", 200.0, part), (1, 3, "straight", part, part + 200.0), (1, 9, "corner", LENGTH - 10, LENGTH + 50), (2, 1, "corner", 0.0, 50.0)]
    segs = spark.createDataFrame(made, "axis_id long, segment_id long, kind string, start_m double, end_m double")
    laps = progress.withColumn("axis_id", F.lit(1).cast("long"))
    got = {(r.lap_no, r.segment_id): r for r in along.segment_times(laps, segs).collect()}
    assert got[1, 1].seconds == pytest.approx(5.0) and got[2, 1].seconds == pytest.approx(10.0)
    assert got[1, 2].seconds == pytest.approx((part - 200) / 20, abs=0.05) and (1, 9) not in got
    speeds = along.segment_speeds(laps, segs)
    least = {(r.lap_no, r.segment_id): r for r in speeds.collect()}
    assert least[1, 2].least == 20.0 and least[1, 2].least_m == 200.0
    onset = spark.createDataFrame([(1, 1004.0, 1005.5, 80.0), (1, 1004.5, 1006.0, 90.0), (1, 1001.0, 1002.0, 50.0)], "run_id long, onset double, t1 double, peak double")
    brakes = along.braking(laps, onset, segs)
    assert [(b.lap_no, b.segment_id, b.at_m, b.peak) for b in brakes.collect()] == [(1, 2, 180.0, 90.0)]
    lifts = spark.createDataFrame([(1, 1, 2, 2)], "axis_id long, run_id long, lap_no long, segment_id long")
    corner = speeds.where("segment_id = 2")
    one = along.driving_classes(corner.where("lap_no = 1"), brakes, lifts).first()
    two = along.driving_classes(corner.where("lap_no = 2"), brakes, lifts).first()
    assert (one.driving, two.driving, one.speed, two.speed) == ("heavy braking", "lift", "slow", "slow")
    throttle = spark.createDataFrame([(1, 1007.0), (1, 1006.0)], "run_id long, onset double")
    assert [(r.segment_id, r.onset) for r in along.pickups(laps, throttle, segs).collect()] == [(2, 1006.0)]


def test_projection_leaves_out_what_is_far_or_ambiguous(spark):
    """Two parallel straights 24 m apart, closed far away: between them either could be meant."""
    line = [(float(x), 0.0) for x in range(0, 400, 2)] + [(400.0 + math.sin(k / 10) * 12, 12 - math.cos(k / 10) * 12) for k in range(1, 32)] + [(float(x), 24.0) for x in range(400, 0, -2)] + [(-math.sin(k / 10) * 12, 12 + math.cos(k / 10) * 12) for k in range(0, 31)]
    cum = np.concatenate(([0.0], np.cumsum([math.dist(a, b) for a, b in zip(line, line[1:], strict=False)])))
    axis = spark.createDataFrame([(1, i, e, n, float(m)) for i, ((e, n), m) in enumerate(zip(line, cum, strict=True))], "axis_id long, idx long, east double, north double, cum_m double")
    places = [(20.0, 1.0), (50.0, -1.0), (100.0, 12.0), (150.0, 2.0), (200.0, 60.0), (250.0, 12.0), (300.0, 1.0)]
    fixes = spark.createDataFrame([(1, 5, 1, float(t), e, n) for t, (e, n) in enumerate(places)], "axis_id long, run_id long, lap_no long, t double, east double, north double")
    got = {r.t: r.progress_m for r in projection.projected(fixes, axis).collect()}
    # midway either straight may be meant, whatever the place before
    assert got == {t: pytest.approx(m) for t, m in ((0.0, 20.0), (1.0, 50.0), (3.0, 150.0), (6.0, 300.0))}


def test_folders_and_files_as_one_list(spark, tmp_path):
    from stintlab.sources.intake import scan

    (tmp_path / "a" / "b").mkdir(parents=True)
    for name in ("a/one.vbo", "a/b/two.RCZ", "a/b/three.txt", "four.vbo"):
        (tmp_path / name).write_text("x")
    files, notes = scan(spark, [str(tmp_path / "a"), str(tmp_path / "a" / "one.vbo"), str(tmp_path / "four.vbo")])
    assert sorted((r.path.rsplit("/", 1)[1], r.format) for r in files.collect()) == [("four.vbo", "vbo"), ("one.vbo", "vbo"), ("two.RCZ", "rcz")]
    assert [(r.path.rsplit("/", 1)[1], r.why) for r in notes.collect()] == [("three.txt", "another format")]
    files, notes = scan(spark, [str(tmp_path / "a")], most=1)
    assert files.count() == 1 and sorted(r.why for r in notes.collect()) == ["another format", "too many files"]


def _archive(**members):
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        for name, value in members.items():
            z.writestr(name.replace("__", "."), value if isinstance(value, bytes) else json.dumps(value))
    return raw.getvalue()


def test_rcz_folder(spark, tmp_path):
    from stintlab.sources.rcz import read_rcz

    ticks, other = np.array([1000, 1100, 1200, 9000], "<i8"), np.array([1000, 1100], "<i8")
    trap = {"type": 3, "uniDirectional": True, "centerLatitude": 52 * 6e6, "centerLongitude": 21 * 6e6, "width": 20_000, "bearing": 90_000}
    good = {
        "session__json": {"version": 1, "firstTimestamp": 1000, "trackName": "x"}, "sessionfragment__json": {"version": 1, "firstTimestamp": 1000, "primaryGpsDeviceIndex": 100},
        "channel_1_100_0_1_1": ticks.tobytes(), "channel_1_101_0_1_1": other.tobytes(), "channel_5_7_0_1_1": other.tobytes(),
        "channel_1_100_0_3_1": (np.array([[52, 21], [52, 21], [53, 21], [95, 21]]) * 6_000_000).astype("<i4").tobytes(),
        "channel_1_100_0_4_0": np.array([10_000, 20_000, 2**31 - 1, 30_000], "<i4").tobytes(),
        "channel_1_101_0_4_0": np.array([1, 2], "<i4").tobytes(), "channel2_5_7_0_10024_3": np.array([0.5, np.nan], "<f8").tobytes(),
        "channel_9_1_0_77_0": b"", "trackId__json": {"track": {"traps": [trap, {"type": 4}]}},
    }
    (tmp_path / "a.rcz").write_bytes(_archive(**good))
    (tmp_path / "b.rcz").write_bytes(b"no archive")
    broken = bytearray(_archive(session__json={"version": 1, "pad": "x" * 4000}))
    broken[60:80] = bytes(20)
    (tmp_path / "c.rcz").write_bytes(bytes(broken))
    (tmp_path / "d.rcz").write_bytes(_archive(session__json=[1]))
    (tmp_path / "e.rcz").write_bytes(_archive(**{**good, "channel_1_100_0_4_0": b"123"}))
    read, notes = read_rcz(spark, str(tmp_path))
    got = {}
    for r in read.collect():
        got.setdefault((r.channel, r.unit), []).append((round(r.t, 6), r.v if r.v is None else round(r.v, 6)))
    assert got["velocity", "km/h"] == [(0.0, 36.0), (0.1, 72.0), (0.2, None), (0.2, None), (8.0, None), (8.0, 108.0)]
    assert got["lat", "deg"][2] == (0.2, 53.0) and got["lat", "deg"][-1] == (8.0, None) and got["rpm-obd", "rpm"] == [(0.0, 0.5), (0.1, None)]
    assert set(got) == {("velocity", "km/h"), ("lat", "deg"), ("long", "deg"), ("rpm-obd", "rpm")}
    kinds = [(r.path[-5:], r.kind) for r in notes.collect()]
    assert sorted(kinds) == [("a.rcz", "gate"), ("a.rcz", "note"), ("a.rcz", "note"), ("a.rcz", "session"), *((f"{c}.rcz", "error") for c in "bcde")]
    gate = next(r.gate for r in notes.collect() if r.kind == "gate")
    assert gate[0] == pytest.approx(21.0) and abs(gate[3] - gate[1]) * 111_194.9 == pytest.approx(20.0, rel=1e-3) and gate[1] > gate[3]


def test_vbo_coordinates_are_never_guessed():
    from stintlab.sources.vbo import gate_of, parse

    head = "[column names]\ntime lat lon velocity\n[data]\n1 30.5 20.2 5\n2 3120.0 1260.0 6\n"
    arc = parse(("[comments]\nGenerated by RaceChrono Pro v10.2.4\n[laptiming]\nStart 1260.0 3120.0 1260.0 3119.99 main\n" + head).encode())
    assert arc[2][1] == [30.5 / 60, 52.0] and arc[2][2] == [20.2 / 60, 21.0]
    lon1, lat1, lon2, lat2 = arc[3][0]
    assert lat1 == pytest.approx(52.0) == lat2 and lon1 != lon2 and (lon1 + lon2) / 2 == pytest.approx(21.0)
    plain = parse(("[header]\ncoordinate units = degrees\n" + head).encode())
    assert plain[2][1] == [30.5, None] and plain[2][3] == [5.0, 6.0]
    for start in ("", "[comments]\nGenerated by Other\n", "[header]\ncoordinate units: furlongs\n", "[comments]\nGenerated by RaceChrono Pro v10.2.4\n[header]\ncoordinate units: degrees\n"):
        got = parse((start + head).encode())
        assert got[2][1] == [None, None] and any("coordinate" in n for n in got[4])
    assert gate_of("Start 21 52 21.001 52", 1.0, False) == (21.0, 52.0, 21.001, 52.0)
    with pytest.raises(ValueError):
        gate_of("Start 21 52 21 52", 1.0, False)
