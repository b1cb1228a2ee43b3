"""Queries of lines in the plane and of intake. Axes are squares whose sides grow with the nation's key, so that places
along them have a closed form for the SQL; recordings are written from events as text and read again."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from stintlab.operators import projection, shape
from stintlab.plans import tables as t
from stintlab.plans.registry import query, rounded
from stintlab.plans.tables import SAMPLES_SQL
from stintlab.sources import intake

_SIDE = "400.0 + 10 * axis_id"


def _square(p, side):
    """(east, north) at p metres along a square from its corner, counter-clockwise."""
    k, r = F.floor(p / side), F.pmod(p, side)
    east = F.when(k == 0, r).when(k == 1, side).when(k == 2, side - r).otherwise(0.0)
    north = F.when(k == 0, 0.0).when(k == 1, r).when(k == 2, side).otherwise(side - r)
    return east, north


def _left(p, side):
    """The unit vector to the left of the square's direction at p."""
    k = F.floor(p / side)
    return F.when(k == 1, -1.0).when(k == 3, 1.0).otherwise(0.0), F.when(k == 0, 1.0).when(k == 2, -1.0).otherwise(0.0)


def square_axes(spark, sf_dir):
    axis = F.col("n_nationkey").cast("long")
    rows = t.read(spark, sf_dir, "nation").select(axis.alias("axis_id"), (400.0 + 10 * axis).alias("side"))
    rows = rows.select("axis_id", "side", F.explode(F.sequence(F.lit(0), (F.col("side") * 2).cast("int") - 1)).alias("idx")).withColumn("cum_m", F.col("idx") * F.lit(2.0))
    east, north = _square(F.col("cum_m"), F.col("side"))
    return rows.select("axis_id", F.col("idx").cast("long").alias("idx"), east.alias("east"), north.alias("north"), "cum_m")


_FIXES = f"""fx AS (SELECT * FROM (SELECT axis_id, run_id, k, k * 25.0 AS p, ((run_id * 7 + k * 3) % 9 - 4) * 1.0 AS off, {_SIDE} AS side FROM (SELECT CAST(c_nationkey AS BIGINT) AS axis_id, c_custkey AS run_id FROM customer) c, range(0, 110) r(k)) WHERE p < 4 * side AND p % side BETWEEN 10 AND side - 10)"""


def square_fixes(spark, sf_dir):
    k, p, side = F.col("k"), F.col("p"), F.col("side")
    rows = t.read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("axis_id"), F.col("c_custkey").alias("run_id"), F.explode(F.sequence(F.lit(0), F.lit(109))).alias("k"))
    rows = rows.select("axis_id", "run_id", "k", (k * F.lit(25.0)).alias("p"), (((F.col("run_id") * 7 + k * 3) % 9 - 4) * F.lit(1.0)).alias("off"), (400.0 + 10 * F.col("axis_id")).alias("side"))
    rows = rows.where((p < 4 * side) & F.pmod(p, side).between(10, side - 10))
    (east, north), (le, ln) = _square(p, side), _left(p, side)
    return rows.select("axis_id", "run_id", F.lit(1).cast("long").alias("lap_no"), k.cast("double").alias("t"), (east + le * F.col("off")).alias("east"), (north + ln * F.col("off")).alias("north"), "k")


#: Where a corner is cut, the window by the straight way driven may end short of a fix's place, which is then left out.
_CUT = f"""{_FIXES}, en AS (SELECT *, CASE floor(p / side) WHEN 0 THEN p WHEN 1 THEN side - off WHEN 2 THEN 3 * side - p ELSE off END AS east, CASE floor(p / side) WHEN 0 THEN off WHEN 1 THEN p - side WHEN 2 THEN side - off ELSE 4 * side - p END AS north FROM fx),
 be AS (SELECT *, lag(k) OVER w AS k0, lag(p) OVER w AS p0, sqrt((east - lag(east) OVER w) ** 2 + (north - lag(north) OVER w) ** 2) AS chord FROM en WINDOW w AS (PARTITION BY run_id ORDER BY k)),
 kept AS (SELECT * FROM be WHERE k0 IS NULL OR k - k0 > 3 OR p < 2 * (floor(p0 / 2 + 0.5) + round(least(greatest(1.6 * chord, 15), 150) / 2) + 1))"""


@query(f"WITH {_CUT} SELECT axis_id, run_id, 1 AS lap_no, CAST(k AS DOUBLE) AS t, p AS progress_m, abs(off) AS metres FROM kept")
def projected_laps(spark, sf_dir):
    return rounded(projection.projected(square_fixes(spark, sf_dir).drop("k"), square_axes(spark, sf_dir)).drop("stretch"), 4)


def _legs(p, length):
    """(east, north) at p metres along a loop of two legs 12 m apart."""
    east = F.when(p < length, p).when(p < length + 12, length).when(p < 2 * length + 12, 2 * length + 12 - p).otherwise(F.lit(0.0))
    north = F.when(p < length, F.lit(0.0)).when(p < length + 12, p - length).when(p < 2 * length + 12, F.lit(12.0)).otherwise(2 * length + 24 - p)
    return east, north


_CLOSE = """lg AS (SELECT *, CASE WHEN k <= m - 2 THEN 20 + 20 * k WHEN k = m - 1 THEN len + 6 WHEN k <= 2 * m - 2 THEN len + 32 + 20 * (k - m) ELSE 2 * len + 18 END AS p
 FROM (SELECT CAST(c_nationkey AS BIGINT) AS axis_id, c_custkey AS run_id, c_custkey % 3 AS v, 20 + c_nationkey AS m, 400 + 20 * c_nationkey AS len FROM customer) c, range(0, 90) r(k) WHERE k < 2 * m),
 lp AS (SELECT *, CASE WHEN v = 0 AND p BETWEEN 60 AND len - 60 THEN 6.5 ELSE 0 END AS off FROM lg WHERE NOT (v = 2 AND k BETWEEN 5 AND 9))"""


def close_legs(spark, sf_dir):
    """(axes, fixes): loops of two legs 12 m apart; laps that are driven 6.5 m off a leg towards the other, that stand and
    reverse, and that have a gap."""
    nation, run = F.col("n_nationkey").cast("long"), F.col("c_custkey")
    axes = t.read(spark, sf_dir, "nation").select(nation.alias("axis_id"), (400.0 + 20 * nation).alias("len"))
    axes = axes.select("axis_id", "len", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len").cast("long") + 11)).alias("idx")).withColumn("cum_m", F.col("idx") * F.lit(2.0))
    east, north = _legs(F.col("cum_m"), F.col("len"))
    axes = axes.select("axis_id", "idx", east.alias("east"), north.alias("north"), "cum_m")
    k, m, length, p, v = (F.col(c) for c in ("k", "m", "len", "p", "v"))
    rows = t.read(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("axis_id"), run.alias("run_id"), (run % 3).alias("v"), (20 + F.col("c_nationkey")).alias("m"), (400.0 + 20 * F.col("c_nationkey")).alias("len"))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0), 2 * m - 1)))
    rows = rows.withColumn("p", F.when(k <= m - 2, 20 + 20.0 * k).when(k == m - 1, length + 6).when(k <= 2 * m - 2, length + 32 + 20 * (k - m)).otherwise(2 * length + 18))
    rows = rows.where(~((v == 2) & k.between(5, 9))).withColumn("off", F.when((v == 0) & p.between(60, length - 60), 6.5).otherwise(0.0)).withColumn("t", k.cast("double"))
    extra = rows.where((v == 1) & (k.isin(7, 8) | (k == m + 5)))
    extra = extra.withColumns({"t": F.col("t") + 0.5, "p": F.when(k == m + 5, p - 10).otherwise(p)})
    rows = rows.unionByName(extra)
    east, north = _legs(p, length)
    return axes, rows.select("axis_id", "run_id", F.lit(1).cast("long").alias("lap_no"), "t", east.alias("east"), (north + F.col("off")).alias("north"))


@query(f"""WITH {_CLOSE} SELECT axis_id, run_id, 1 AS lap_no, CASE WHEN v = 2 AND k > 9 OR v = 1 AND k > m + 5 THEN 1 ELSE 0 END AS stretch, CAST(k AS DOUBLE) AS t, CAST(p AS DOUBLE) AS progress_m, CAST(off AS DOUBLE) AS metres FROM lp
 UNION ALL SELECT axis_id, run_id, 1, 0, CAST(k + 0.5 AS DOUBLE), CAST(p AS DOUBLE), CAST(0 AS DOUBLE) FROM lp WHERE v = 1 AND k IN (7, 8)""")
def projected_close_legs(spark, sf_dir):
    """The other leg is nearer all along; a car that stands keeps its place, one that reverses isn't placed."""
    axes, fixes = close_legs(spark, sf_dir)
    return rounded(projection.projected(fixes, axes), 4)


@query(f"WITH {_FIXES} SELECT run_id * 1000 + k AS point_id, axis_id, off AS offset_m FROM fx")
def lateral_offsets(spark, sf_dir):
    points = square_fixes(spark, sf_dir).select((F.col("run_id") * 1000 + F.col("k")).alias("point_id"), "axis_id", "east", "north")
    return rounded(shape.lateral_offsets(points, square_axes(spark, sf_dir)).drop("idx"), 4)


@query(f"""WITH p AS (SELECT CAST(n_nationkey AS BIGINT) AS axis_id, k, k / 4.0 AS q, 400.0 + 10 * n_nationkey AS s FROM nation, range(0, 16) r(k))
 SELECT axis_id, k, CASE floor(q) WHEN 0 THEN (q % 1) * s WHEN 1 THEN s WHEN 2 THEN s - (q % 1) * s ELSE 0 END AS east, CASE floor(q) WHEN 0 THEN 0 WHEN 1 THEN (q % 1) * s WHEN 2 THEN s ELSE s - (q % 1) * s END AS north FROM p""")
def resampled_axes(spark, sf_dir):
    return rounded(shape.resampled(square_axes(spark, sf_dir), 16), 4)


@query("""WITH c AS (SELECT c_custkey AS k, (c_custkey % 40) - 20.0 AS x, (c_custkey % 7) * 1.5 AS y FROM customer) SELECT k, round(sqrt(y * y + greatest(x - 10, 0 - (x + 5), 0) ** 2), 6) AS metres FROM c""")
def closest_segments(spark, sf_dir):
    k, z = F.col("c_custkey"), F.lit(0.0)
    x, y = k % 40 - F.lit(20.0), k % 7 * F.lit(1.5)
    return rounded(t.read(spark, sf_dir, "customer").select(k.alias("k"), shape.closest(z, z, F.lit(10.0), z, x, y, x + 5, y).alias("metres")))


@query("""WITH p AS (SELECT c_custkey AS lap_id, k, k * 20.0 + (c_custkey % 7) * 4 AS east, (c_custkey % 11) * 30.0 AS north FROM customer WHERE c_custkey < 400, range(0, 10) r(k)),
 m AS (SELECT a.lap_id, a.k, min(abs(a.east - b.east)) AS m FROM p a JOIN p b ON a.north = b.north AND a.lap_id <> b.lap_id AND abs(a.east - b.east) <= 16 GROUP BY 1, 2)
 SELECT p.lap_id, count(*) AS n, CAST(count_if(m IS NULL) AS BIGINT) AS beyond, max(m) AS worst_m FROM p LEFT JOIN m USING (lap_id, k) GROUP BY 1""".replace(" WHERE c_custkey < 400", ""))
def line_deviations(spark, sf_dir):
    k = F.col("c_custkey")
    rows = t.read(spark, sf_dir, "customer").select(k.alias("lap_id"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k"))
    points = rows.select("lap_id", "k", (F.col("k") * F.lit(20.0) + F.col("lap_id") % 7 * 4).alias("east"), (F.col("lap_id") % 11 * F.lit(30.0)).alias("north"))
    return rounded(shape.line_deviations(points))


#: Every supplier's line items are points 5 m apart, fifty a corner; a corner's form goes by supplier and number, its values
#: by the tax too.
_FORMS = (
    "greatest(0.0e0, 1 - abs(j - 25) / 20.7e0)", "CASE WHEN j BETWEEN 5 AND 45 THEN greatest(0.5e0, 1 - abs(j - 33) / 8.3e0) ELSE 0.0e0 END", "CASE WHEN j <= 46 THEN j / 45.7e0 ELSE 0.0e0 END",
    "CASE WHEN j >= 3 THEN (49 - j) / 45.7e0 ELSE 0.0e0 END", "greatest(0.0e0, 1 - abs(j - 13) / 8.3e0, 1 - abs(j - 37) / 8.3e0)", "greatest(0.0e0, 1 - abs(j - 9) / 6.7e0, 1 - abs(j - 25) / 6.7e0, 1 - abs(j - 41) / 6.7e0)",
    "greatest(0.0e0, 1 - abs(j - 13) / 10.7e0) - 0.8e0 * greatest(0.0e0, 1 - abs(j - 37) / 10.7e0)", "0.0e0", "CASE WHEN j = 25 THEN 1.0e0 ELSE 0.0e0 END",
)
_FORM = "CASE (axis_id + c) % 9 " + " ".join(f"WHEN {k} THEN {f}" for k, f in enumerate(_FORMS)) + " END"
_FEATURES = f"""pt AS (SELECT l_suppkey AS axis_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 AS i, l_tax FROM lineitem),
 pc AS (SELECT axis_id, i, i // 50 AS c, i % 50 AS j, l_tax FROM pt),
 fe AS (SELECT axis_id, c, j, i * 5.0 AS cum_m, CASE WHEN (axis_id + c) % 2 = 0 THEN 1 ELSE -1 END * 0.02 * (1 + 0.01 * l_tax) * CAST({_FORM} AS DOUBLE) AS curvature FROM pc),
 tu AS (SELECT *, sign(sum(curvature) OVER p) * curvature AS turning, count(*) OVER p AS points, sign(sum(curvature) OVER p) AS way FROM fe WINDOW p AS (PARTITION BY axis_id, c)),
 pk AS (SELECT * FROM (SELECT *, max(turning) OVER (PARTITION BY axis_id, c) AS peak FROM tu) WHERE points >= 3 AND peak > 0 AND way <> 0),
 la AS (SELECT *, coalesce(last_value(CASE WHEN turning >= 0.8 * peak THEN 1 WHEN turning < 0.6 * peak THEN 0 END IGNORE NULLS) OVER (PARTITION BY axis_id, c ORDER BY j), 0) AS active FROM pk),
 be AS (SELECT *, CASE WHEN active = 1 AND coalesce(lag(active) OVER (PARTITION BY axis_id, c ORDER BY j), 0) = 0 THEN 1 ELSE 0 END AS begins FROM la),
 rg AS (SELECT axis_id, c, region, min(j) AS a, max(j) AS z, min(cum_m) AS from_m, max(cum_m) AS to_m, max(turning) AS peak FROM (SELECT *, sum(begins) OVER (PARTITION BY axis_id, c ORDER BY j) AS region FROM be) WHERE active = 1 AND turning >= 0.8 * peak GROUP BY 1, 2, 3),
 tp AS (SELECT axis_id, c, count(*) AS parts, min(a) AS a, max(z) AS z, min((from_m + to_m) / 2) AS apex_m, min((z - a) * 2.5) AS half_m FROM rg GROUP BY 1, 2)"""


def _curved(spark, sf_dir):
    w = Window.partitionBy("l_suppkey").orderBy("l_extendedprice", "l_orderkey", "l_linenumber")
    rows = t.read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("axis_id"), (F.row_number().over(w) - 1).alias("i"), "l_tax")
    rows = rows.select("axis_id", "i", F.floor(F.col("i") / 50).alias("c"), (F.col("i") % 50).alias("j"), "l_tax")
    # factors in the text's order, as products that lie on a threshold show another
    form = F.when((F.col("axis_id") + F.col("c")) % 2 == 0, 1).otherwise(-1) * F.lit(0.02) * (1 + 0.01 * F.col("l_tax")) * F.expr(_FORM).cast("double")
    features = rows.select("axis_id", (F.col("i") * F.lit(5.0)).alias("cum_m"), form.alias("curvature"))
    corners = rows.select("axis_id", F.col("c").cast("long").alias("segment_id")).distinct()
    return features, corners.select("axis_id", "segment_id", (F.col("segment_id") * F.lit(250.0)).alias("start_m"), (F.col("segment_id") * F.lit(250.0) + 250).alias("end_m"))


@query(f"WITH {_FEATURES} SELECT axis_id, c AS segment_id, CAST(region AS BIGINT) AS region, from_m, to_m, (from_m + to_m) / 2 AS apex_m, round(peak, 6) AS peak FROM rg")
def apex_regions(spark, sf_dir):
    return rounded(shape.apex_regions(*_curved(spark, sf_dir)), 6)


@query(f"""WITH {_FEATURES} SELECT axis_id, c AS segment_id, c * 250.0 AS entry_m, CASE WHEN parts = 1 THEN apex_m END AS apex_m, c * 250.0 + 250 AS exit_m, CASE WHEN parts = 1 THEN greatest(11.0, half_m + 5) END AS tolerance_m, coalesce(parts, 0) AS apexes,
 CASE WHEN parts IS NULL THEN 'insufficient geometry' WHEN parts > 1 THEN 'multiple apexes' WHEN half_m > 11 THEN 'broad peak' ELSE 'resolved' END AS state FROM (SELECT DISTINCT axis_id, c FROM pc) LEFT JOIN tp USING (axis_id, c)""")
def corner_geometry(spark, sf_dir):
    return rounded(shape.corner_phases(*_curved(spark, sf_dir), smoothing_m=6.0), 4)


@query(f"""WITH {_FEATURES}, sp AS (SELECT axis_id, c, min(CASE WHEN turning >= least(0.004, peak / 2) THEN j END) AS f, max(CASE WHEN turning >= least(0.004, peak / 2) THEN j END) AS l, greatest(0, 0 - min(turning)) / max(peak) AS reversal FROM pk GROUP BY 1, 2),
 hv AS (SELECT axis_id, c, avg(CASE WHEN j >= f AND j < f + (l - f + 1) // 2 THEN greatest(turning, 0) END) AS m1, avg(CASE WHEN j <= l AND j > l - (l - f + 1) // 2 THEN greatest(turning, 0) END) AS m2 FROM pk JOIN sp USING (axis_id, c) GROUP BY 1, 2),
 al AS (SELECT axis_id, c, parts, reversal, m2 / nullif(m1, 0) AS ratio, (a - f) / nullif(l - f, 0) AS b, (z - f) / nullif(l - f, 0) AS e, ((a + z) / 2 - f) / nullif(l - f, 0) AS mid, parts IS NULL OR (parts = 1 AND l - f < 2) AS lacking FROM (SELECT DISTINCT axis_id, c FROM pc) LEFT JOIN sp USING (axis_id, c) LEFT JOIN tp USING (axis_id, c) LEFT JOIN hv USING (axis_id, c))
 SELECT axis_id, c AS segment_id, CASE WHEN lacking THEN NULL WHEN reversal >= 0.6 OR parts >= 3 THEN 'complex' WHEN parts = 2 THEN 'double apex' WHEN coalesce(ratio, 'infinity'::DOUBLE) >= 1.3 AND e >= 0.8 THEN 'decreasing radius'
 WHEN ratio <= 1 / 1.3 AND b <= 0.2 THEN 'increasing radius' WHEN mid >= 0.6 THEN 'late apex' ELSE 'single apex' END AS shape, CASE WHEN lacking THEN 'insufficient geometry' END AS reason,
 CAST(CASE WHEN lacking THEN 0 ELSE parts END AS BIGINT) AS tight_parts, NOT lacking AND coalesce(reversal >= 0.6, false) AS changes_direction, round(CASE WHEN NOT lacking AND parts = 1 THEN least(greatest(mid, 0), 1) END, 6) AS apex_fraction, round(CASE WHEN NOT lacking AND parts = 1 THEN ratio END, 6) AS radius_ratio FROM al""")
def corner_shapes(spark, sf_dir):
    return rounded(shape.corner_shapes(*_curved(spark, sf_dir)), 6)


@query("""WITH c AS (SELECT c_nationkey AS axis_id, c_custkey, c_acctbal AS east, c_custkey * 3.0 AS north FROM customer), s AS (SELECT axis_id, greatest(max(east) - min(east), max(north) - min(north)) AS side, (max(east) + min(east)) / 2 AS me, (max(north) + min(north)) / 2 AS mn FROM c GROUP BY 1)
 SELECT c_custkey, round(0.5 + (east - me) / side, 6) + 0.0 AS x, round(0.5 - (north - mn) / side, 6) + 0.0 AS y FROM c JOIN s USING (axis_id)""")
def fitted_map(spark, sf_dir):
    rows = t.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("axis_id"), "c_custkey", F.col("c_acctbal").alias("east"), (F.col("c_custkey") * F.lit(3.0)).alias("north"))
    return rounded(shape.fitted(rows).select("c_custkey", "x", "y"))


@query("""WITH o AS (SELECT o_custkey AS pair_id, o_orderkey * 1.0 AS t, 2 + o_orderkey * CASE WHEN o_custkey % 5 = 0 THEN 0.01 ELSE 0.000123457 END + (o_orderkey % 13) * CASE WHEN o_custkey % 3 = 0 THEN 0.2 ELSE 0.01 END AS off FROM orders),
 f AS (SELECT pair_id, count(*) AS n, regr_slope(off, t) AS slope, regr_intercept(off, t) AS ic, quantile_cont(off, 0.5) AS mid FROM o GROUP BY 1),
 w AS (SELECT o.pair_id, max(abs(off - coalesce(ic + slope * t, off))) AS worst FROM o JOIN f USING (pair_id) GROUP BY 1)
 SELECT pair_id, n, round(slope, 6) AS slope, round(mid, 6) AS offset_s, CASE WHEN n < 3 THEN 'insufficient' WHEN worst > 0.5 OR abs(slope) > 0.001 OR slope IS NULL THEN 'conflicting' ELSE 'aligned' END AS verdict FROM f JOIN w USING (pair_id)""")
def recording_drift(spark, sf_dir):
    k, run = F.col("o_orderkey"), F.col("o_custkey")
    off = 2 + k * F.when(run % 5 == 0, 0.01).otherwise(0.000123457) + k % 13 * F.when(run % 3 == 0, 0.2).otherwise(0.01)
    out = shape.drift(t.read(spark, sf_dir, "orders").select(run.alias("pair_id"), (k * F.lit(1.0)).alias("t"), off.alias("offset_s")))
    return rounded(out.select("pair_id", "n", "slope", "offset_s", "verdict"))


_NAMES = ("click", "error", "purchase", "signup", "view")
_HEAD = "[header]\nvelocity kmh\ncoordinate units = degrees\n[column names]\ntime " + " ".join(_NAMES) + "\n[data]\n"
_TEXT = (
    SAMPLES_SQL + ", rw AS (SELECT run_id, t, " + ", ".join(f"max(CASE WHEN channel = '{c}' THEN CAST(round(v * 100) AS BIGINT) END) AS {c}" for c in _NAMES) + " FROM samples GROUP BY 1, 2), "
    f"vt AS (SELECT run_id, 'run-' || run_id || '.vbo' AS path, '{_HEAD.replace(chr(10), chr(39) + ' || chr(10) || ' + chr(39))}' || string_agg(printf('%.6f', t) || ' ' || " + " || ' ' || ".join(f"coalesce(CAST({c} AS VARCHAR), 'x')" for c in _NAMES) + ", chr(10) ORDER BY t) AS content FROM rw GROUP BY 1)"
)


def texts(spark, sf_dir):
    """Events as recordings in text, a file a user."""
    rows = t.samples(spark, sf_dir).groupBy("run_id", "t").agg(*(F.max(F.when(F.col("channel") == c, F.round(F.col("v") * 100).cast("long"))).alias(c) for c in _NAMES))
    line = F.concat_ws(" ", F.format_string("%.6f", "t"), *(F.coalesce(F.col(c).cast("string"), F.lit("x")) for c in _NAMES))
    # a recording is one file, so its lines are gathered
    whole = rows.groupBy("run_id").agg(F.array_sort(F.collect_list(F.struct("t", line.alias("line")))).alias("lines"))
    content = F.concat(F.lit(_HEAD), F.array_join(F.transform("lines", lambda x: x["line"]), "\n"))
    return whole.select("run_id", F.concat(F.lit("run-"), F.col("run_id").cast("string"), F.lit(".vbo")).alias("path"), content.cast("binary").alias("content"))


@query(f"WITH {SAMPLES_SQL} SELECT 'run-' || run_id || '.vbo' AS path, channel, round(t, 6) AS t, round(v * 100) AS v FROM samples")
def recorded_samples(spark, sf_dir):
    read, _ = intake.load(texts(spark, sf_dir).select("path", "content"))
    return rounded(read.where("v is not null").select("path", "channel", "t", "v"))


@query(f"WITH {_TEXT} SELECT path, sha256(content) AS content_sha256, sha256(content || content || content) AS sampled_sha256, strlen(content) AS size FROM vt")
def sampled_digests(spark, sf_dir):
    c = F.col("content")
    return texts(spark, sf_dir).select("path", F.sha2(c, 256).alias("content_sha256"), intake.sampled_digest(c).alias("sampled_sha256"), F.octet_length(c).cast("long").alias("size"))


@query(f"""WITH {_TEXT}, n AS (SELECT run_id, count(*) AS c, max(t) - min(t) AS s FROM rw GROUP BY 1)
 SELECT path, sha256('{{"kind":"recording-v1","size":' || strlen(content) || ',"sampledSha256":"' || sha256(content || content || content) || '","sampleCount":' || c || ',"durationUs":' || CAST(round(s * 1e6) AS BIGINT) || ',"channels":[' ||
 {" || ',' || ".join(f"'{{{chr(34)}name{chr(34)}:{chr(34)}{c}{chr(34)},{chr(34)}unit{chr(34)}:{chr(34)}{chr(34)},{chr(34)}samples{chr(34)}:' || c || '}}'" for c in _NAMES)} || ']}}') AS digest FROM vt JOIN n USING (run_id)""")
def recording_fingerprints(spark, sf_dir):
    files = texts(spark, sf_dir).select("path", "content")
    out = intake.fingerprints(files, intake.load(files)[0])
    return out.select("path", F.sha2("document", 256).alias("digest"))


@query("""WITH u AS (SELECT DISTINCT user_id AS k FROM events) SELECT 'run-' || k || '.vbo' AS path, CASE WHEN k % 7 = 1 THEN 'known' ELSE 'ready' END AS state FROM u
 UNION ALL SELECT 'z-' || k || '.vbo', CASE WHEN k % 7 = 1 THEN 'known' ELSE 'duplicate' END FROM u WHERE k % 10 = 0 UNION ALL SELECT 'bad-' || k || '.vbo', 'error' FROM u WHERE k % 50 = 1 UNION ALL SELECT 'bad-' || k || '.rcz', 'error' FROM u WHERE k % 50 = 1 UNION ALL SELECT 'n-' || k || '.txt', 'error' FROM u WHERE k % 50 = 2""")
def import_plan(spark, sf_dir):
    made = texts(spark, sf_dir)
    name = lambda a, b: F.concat(F.lit(a), F.col("run_id").cast("string"), F.lit(b))
    junk = F.concat(F.lit("junk"), F.col("run_id").cast("string")).cast("binary")
    files = made.select("path", "content").unionByName(made.where("run_id % 10 = 0").select(name("z-", ".vbo").alias("path"), "content"))
    for a, b, k in (("bad-", ".vbo", 1), ("bad-", ".rcz", 1), ("n-", ".txt", 2)):
        files = files.unionByName(made.where(F.col("run_id") % 50 == k).select(name(a, b).alias("path"), junk.alias("content")))
    known = made.where("run_id % 7 = 1").select(F.sha2("content", 256).alias("run_id"))
    return intake.import_plan(files, intake.load(files)[1], known).select("path", "state")


@query("SELECT 'c' || n_nationkey AS name, n_nationkey * 5.0 - 80 AS lat, n_nationkey * 12.0 - 110 AS lon, n_nationkey % 4 * 100.0 AS radius_m FROM nation WHERE n_nationkey % 4 > 0 AND n_nationkey * 12.0 - 110 <= 180")
def circuit_list(spark, sf_dir):
    k = F.col("n_nationkey")
    entry = F.struct(F.concat(F.lit(" c"), k.cast("string")).alias("name"), (k * 5.0 - 80).alias("lat"), (k * 12.0 - 110).alias("lon"), (k % 4 * 100.0).alias("radius"))
    return intake.circuits(t.read(spark, sf_dir, "nation").select(F.to_json(F.array(entry, F.struct(F.lit("x").alias("name"), F.lit(95.0).alias("lat"), F.lit(0.0).alias("lon"), F.lit(1.0).alias("radius")))).alias("text")))


@query("SELECT CAST(n_nationkey AS BIGINT) AS run_id, 3600 * (n_nationkey + h) AS hour_s, n_nationkey + h / 2.0 AS temperature, CASE WHEN h > 1 THEN h / 10.0 END AS rain FROM nation, range(0, 3) r(h) WHERE n_nationkey % 5 > 0")
def weather_hours(spark, sf_dir):
    k = F.col("n_nationkey")
    text = F.format_string('{"hourly": {"time": [%d, %d, %d], "temperature_2m": [%s, %s, %s], "precipitation": [%s]}}', 3600 * k, 3600 * (k + 1), 3600 * (k + 2), (k + 0.0).cast("string"), (k + 0.5).cast("string"), (k + 1.0).cast("string"), F.when(k % 5 > 0, "null, null, 0.2").otherwise("0.1"))
    return rounded(intake.weather_hours(t.read(spark, sf_dir, "nation").select(k.cast("long").alias("run_id"), text.alias("text"))))


@query(f"WITH {SAMPLES_SQL}, f AS (SELECT run_id, t, v - 5 AS lat, v * 2 AS lon FROM samples WHERE v * 2 <= 180 AND v - 5 <= 90), r AS (SELECT run_id, arg_min({{'a': lat, 'o': lon}}, t) AS x FROM f GROUP BY 1) SELECT run_id, round(x.a, 2) AS lat, round(x.o, 2) AS lon, run_id * 1000 AS start_ms FROM r WHERE run_id % 3 > 0")
def weather_requests(spark, sf_dir):
    s = t.samples(spark, sf_dir)
    fixes = s.select("run_id", "t", (F.col("v") - 5).alias("lat"), (F.col("v") * 2).alias("lon"))
    starts = s.select("run_id").distinct().withColumn("start_ms", F.when(F.col("run_id") % 3 > 0, F.col("run_id") * 1000))
    return rounded(intake.weather_requests(fixes, starts))


_SIGNS = "sn AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'rcz' ELSE 'vbo' END AS format, (c_custkey // 2 % 9) * 10.0 + c_custkey % 2 AS duration_s, k, (c_custkey // 2 % 50) * 1000.0 + k * 10 + CASE WHEN c_custkey % 11 = 0 THEN k * 8 ELSE c_custkey % 2 * 3 END AS east, 0.0 AS north FROM customer, range(0, 4) r(k))"


@query(f"WITH {_SIGNS} SELECT a.id AS a_id, b.id AS b_id, CAST(count_if(abs(a.east - b.east) <= 10) AS BIGINT) AS met FROM sn a JOIN sn b ON a.k = b.k AND a.format < b.format AND abs(a.duration_s - b.duration_s) <= 2 AND abs(a.east - b.east) < 90 GROUP BY 1, 2 HAVING count_if(abs(a.east - b.east) <= 10) >= 3")
def possible_matches(spark, sf_dir):
    k, i = F.col("c_custkey"), F.col("k")
    rows = t.read(spark, sf_dir, "customer").select("c_custkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("k"))
    half = F.floor(k / 2)
    east = half % 50 * F.lit(1000.0) + i * 10 + F.when(k % 11 == 0, i * 8).otherwise(k % 2 * 3)
    signs = rows.select(k.alias("id"), F.when(k % 2 == 0, "rcz").otherwise("vbo").alias("format"), (half % 9 * F.lit(10.0) + k % 2).alias("duration_s"), "k", east.alias("east"), F.lit(0.0).alias("north"))
    return intake.possible_matches(signs, least=3)


_AXIS_SQL = f"""ax AS (SELECT axis_id, idx, idx * 2.0 AS cum_m, {_SIDE} AS side, 2 * ({_SIDE}) AS n FROM (SELECT CAST(n_nationkey AS BIGINT) AS axis_id FROM nation) a, range(0, 1300) r(idx) WHERE idx < 2 * ({_SIDE})),
 hd AS (SELECT axis_id, idx, n, cum_m, floor(cum_m / side) AS k FROM ax),
 un AS (SELECT axis_id, idx, n, cum_m, CASE k WHEN 0 THEN 1.0 WHEN 2 THEN -1.0 ELSE 0.0 END AS ce, CASE k WHEN 1 THEN 1.0 WHEN 3 THEN -1.0 ELSE 0.0 END AS cn FROM hd),
 ar AS (SELECT a.axis_id, a.idx, any_value(a.cum_m) AS cum_m, any_value(a.n) AS n, atan2(sum(b.cn), sum(b.ce)) AS heading FROM un a, range(-3, 4) r(o), un b WHERE b.axis_id = a.axis_id AND b.idx = (a.idx + o + a.n) % a.n GROUP BY 1, 2),
 cv AS (SELECT a.axis_id, a.idx, a.cum_m, a.heading, ((b.heading - c.heading + 3 * pi()) % (2 * pi()) - pi()) / 4.0 AS curvature FROM ar a JOIN ar b ON b.axis_id = a.axis_id AND b.idx = (a.idx + 1) % a.n JOIN ar c ON c.axis_id = a.axis_id AND c.idx = (a.idx - 1 + a.n) % a.n)"""


def _features(spark, sf_dir):
    from stintlab.operators import corners

    return corners.features(square_axes(spark, sf_dir))


@query(f"WITH {_AXIS_SQL} SELECT axis_id, idx, round(heading, 4) + 0.0 AS heading, round(curvature, 4) + 0.0 AS curvature FROM cv")
def axis_features(spark, sf_dir):
    return rounded(_features(spark, sf_dir).select("axis_id", "idx", "heading", "curvature"), 4)


@query(f"""WITH {_AXIS_SQL}, sg1 AS (SELECT *, CASE WHEN curvature >= 1 / 250 THEN 1 WHEN curvature <= -1 / 250 THEN -1 ELSE 0 END AS s FROM cv),
 r1 AS (SELECT *, sum(CASE WHEN s IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY axis_id ORDER BY idx) AS run FROM (SELECT *, lag(s) OVER (PARTITION BY axis_id ORDER BY idx) AS p FROM sg1)),
 r2 AS (SELECT *, count(*) OVER w * 2.0 AS run_m, abs(sum(curvature * 2.0) OVER w) AS run_turn FROM r1 WINDOW w AS (PARTITION BY axis_id, run)),
 r3 AS (SELECT *, coalesce(last_value(CASE WHEN s = 0 AND run_m < 20 THEN NULL WHEN s <> 0 AND run_turn < 0.35 THEN 0 ELSE s END IGNORE NULLS) OVER (PARTITION BY axis_id ORDER BY idx), 0) AS k FROM r2),
 r4 AS (SELECT *, sum(CASE WHEN k IS NOT DISTINCT FROM pk THEN 0 ELSE 1 END) OVER (PARTITION BY axis_id ORDER BY idx) AS segment FROM (SELECT *, lag(k) OVER (PARTITION BY axis_id ORDER BY idx) AS pk FROM r3)),
 r5 AS (SELECT axis_id, segment, k, min(cum_m) AS start_m, max(cum_m) + 2 AS end_m, sum(curvature * 2) AS turn FROM r4 GROUP BY 1, 2, 3)
 SELECT axis_id, row_number() OVER (PARTITION BY axis_id ORDER BY start_m) AS segment_id, CASE WHEN k = 0 THEN 'straight' ELSE 'corner' END AS kind, start_m, end_m, round(turn, 4) + 0.0 AS turn_rad FROM r5""")
def segment_proposals(spark, sf_dir):
    from stintlab.operators import corners

    out = corners.proposals(_features(spark, sf_dir)).withColumn("segment_id", F.col("segment_id").cast("long"))
    return rounded(out, 4)


#: Each customer visits a gate of its own eight times, each time in another way: three clean passes, one that turns back at 3 m,
#: a slow one, one the other way, one that crosses three times, and one beside the gate.
_GATE = """gp AS (SELECT c_custkey AS run_id, k * 100 + 2.85 AS t, 1 AS direction, CASE WHEN (c_custkey + k) % 8 = 6 THEN 10.5 ELSE 20 END AS speed FROM customer, range(0, 8) r(k) WHERE (c_custkey + k) % 8 IN (0, 1, 2, 6))"""


def visits(spark, sf_dir):
    run, k, v, j = (F.col(c) for c in ("run_id", "k", "v", "j"))
    rows = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k"))
    rows = rows.withColumn("v", (run + k) % 8).withColumn("j", F.explode(F.sequence(F.lit(0), F.when(v == 4, 80).otherwise(12))))
    there = -57.0 + 10 * j
    back = F.when(j <= 5, there).when(j == 6, -3.0).otherwise(-7.0 - 10 * (j - 7))
    thrice = F.when(j <= 6, there).when(j == 7, -2.0).otherwise(4.0 + 10 * (j - 8))
    north = F.when(v == 3, back).when(v == 4, -20.0 + 0.5 * j).when(v == 5, -there).when(v == 6, thrice).otherwise(there)
    east = F.when(v == 7, 30.0).otherwise(3.0)
    # gates lie apart and look their own ways: the visits are turned with them
    turn, place = run % 4 * (3.141592653589793 / 2), run * F.lit(1000.0)

    def turned(x, y):
        return place + x * F.cos(turn) - y * F.sin(turn), x * F.sin(turn) + y * F.cos(turn)

    (e, n), (ax, ay), (bx, by) = turned(east, north), turned(F.lit(-10.0), F.lit(0.0)), turned(F.lit(10.0), F.lit(0.0))
    fixes = rows.select("run_id", (k * 100 + j * 0.5).alias("t"), e.alias("east"), n.alias("north"))
    gates = t.read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("run_id")).select("run_id", ax.alias("ax"), ay.alias("ay"), bx.alias("bx"), by.alias("by"))
    return fixes, gates


def _gate_passes(spark, sf_dir):
    from stintlab.operators import track

    return track.gate_passes(*visits(spark, sf_dir)).select("run_id", "t", "direction", "speed")


@query(f"WITH {_GATE} SELECT run_id, round(t, 4) AS t, direction, round(speed, 4) AS speed FROM gp")
def gate_passes(spark, sf_dir):
    return rounded(_gate_passes(spark, sf_dir), 4)


@query(f"WITH {_GATE}, l AS (SELECT run_id, row_number() OVER w AS lap_no, t AS t0, lead(t) OVER w AS t1 FROM gp WINDOW w AS (PARTITION BY run_id ORDER BY t)) SELECT run_id, lap_no, round(t0, 4) AS t0, round(t1, 4) AS t1, round(t1 - t0, 4) AS seconds FROM l WHERE t1 - t0 BETWEEN 3 AND 3600")
def detected_laps(spark, sf_dir):
    from stintlab.operators import track

    return rounded(track.laps_of(_gate_passes(spark, sf_dir)), 4).withColumn("lap_no", F.col("lap_no").cast("long"))
