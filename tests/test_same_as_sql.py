"""Queries on small made tables against their SQL, at values that lie on a threshold or have no span."""

import datetime as dt

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq

from stintlab import plans


def both(spark, folder, name, **tables):
    """The query's rows and those of its SQL, sorted."""
    con = duckdb.connect()
    for table, rows in tables.items():
        path = f"{folder}/{table}.parquet"
        pq.write_table(pa.Table.from_pylist(rows), path)
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{path}'")
    queries, sql = plans.registered()
    out = queries[name](spark, str(folder))
    told = con.execute(f"SELECT {', '.join(out.columns)} FROM ({sql[name]})").fetchall()

    def plain(rows):
        # decimals of the SQL as doubles
        return sorted((tuple(v if v is None or isinstance(v, str | bool) else float(v) for v in r) for r in rows), key=repr)

    return plain(out.collect()), plain(told)


def rising(suppliers, tax, n=41):
    """Corners whose curvature rises by the point: the 33rd of 41 lies on the threshold of the tight part."""
    return [{"l_suppkey": s, "l_orderkey": j, "l_linenumber": 1, "l_extendedprice": float(j), "l_tax": t} for s, t in zip(suppliers, tax, strict=True) for j in range(n)]


def on_threshold(spark, folder, name):
    k = range(2, 2 + 9 * 18, 9)
    got, told = both(spark, folder, name, lineitem=rising(k, [i % 9 / 100 for i in range(18)]))
    assert got == told and len(got) == 18


def test_apex_regions_begin_where_the_sql_has_them(spark, tmp_path):
    on_threshold(spark, tmp_path, "apex_regions")


def test_corner_phases_agree_on_the_threshold(spark, tmp_path):
    on_threshold(spark, tmp_path, "corner_geometry")


def test_corner_shapes_agree_on_the_threshold(spark, tmp_path):
    on_threshold(spark, tmp_path, "corner_shapes")


def test_a_channel_of_one_sample_lies_in_the_first_part_of_its_time(spark, tmp_path):
    at = [(1, "view", 0, 2.5), (2, "view", 0, 1.0), (2, "view", 6, 3.0), (2, "view", 12, 5.0), (2, "click", 3, 7.0)]
    events = [{"user_id": u, "event_type": c, "ts": dt.datetime(2024, 1, 1, h), "value": v} for u, c, h, v in at]
    got, told = both(spark, tmp_path, "channel_trends", events=events)
    assert got == told and {(r[0], r[1]): r[2] for r in got if r[3] == 1 and r[1] == "click" or r[0] == 1} == {(1, "view"): 0, (2, "click"): 0}


def test_a_nation_of_more_runs_than_a_document_holds_is_read_whole(spark, tmp_path):
    customer = [{"c_custkey": k, "c_nationkey": k % 40 % 3, "c_name": f"Customer#{k}"} for k in range(480)]
    got, told = both(spark, tmp_path, "read_day_documents", customer=customer)
    assert got == told and max(sum(r[0] == d for r in told) for d in (0, 2)) > 64


def test_clock_offsets_of_channels_without_spread(spark, tmp_path):
    """Run 1 has no spread at any shift, run 2 at one of them, run 3 only in groups too small to count."""
    values = {1: ([3.0] * 5, [1.0, 2.0, 4.0, 3.0, 5.0]), 2: ([3.0] * 5 + [1.0, 7.0], [2.0, 9.0, 4.0, 3.0, 5.0, 8.0, 6.0]), 3: ([2.0, 2.0, 5.0, 4.0, 8.0, 6.0], [1.0, 3.0, 4.0, 4.5, 7.0, 7.0])}
    start = dt.datetime(2024, 1, 1)
    events = [{"user_id": u, "event_type": c, "ts": start + dt.timedelta(hours=6 * k), "value": v} for u, sides in values.items() for c, vs in zip(("click", "view"), sides, strict=True) for k, v in enumerate(vs)]
    got, told = both(spark, tmp_path, "clock_offsets", events=events)
    assert repr(got) == repr(told) and [r[0] for r in got] == [1, 2, 3]
