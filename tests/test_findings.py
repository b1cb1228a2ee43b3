"""What a day's corners lost, and what the queries make of it."""

from collections import Counter

import pytest

SF = "/root/testdata/sf0.001"
BUNDLE = "axis_id long, run_id long, lap_no long, segment_id long, seconds double, entry double, least double, pickup_m double"


def bundle(spark):
    quick = [(1, 1, 1, 1, 10.0, 30.0, 20.0, 50.0), (1, 1, 2, 1, 10.0, 30.0, 20.0, 50.0)]
    slow = [
        (1, 2, 1, 1, 10.5, 27.0, 17.0, 60.0), (1, 2, 2, 1, 10.6, 29.0, 17.0, 60.0), (1, 2, 3, 1, 10.7, 29.0, 19.0, 60.0),
        (1, 2, 4, 1, 10.8, 29.0, 19.0, 40.0), (1, 2, 5, 1, 10.9, 29.0, 19.0, 52.0), (1, 2, 6, 1, 11.0, 29.0, 19.0, None),
        (1, 2, 7, 1, 10.01, 20.0, 10.0, 90.0),
    ]
    return spark.createDataFrame([*quick, *slow], BUNDLE)


def sql_rows(name):
    duckdb = pytest.importorskip("duckdb")

    import __spark_entry__

    db = duckdb.connect()
    for table in ("customer", "orders", "lineitem", "nation", "region", "supplier", "part", "events"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    rel = db.execute(__spark_entry__.oracle_sql()[name])
    return [dict(zip([c[0] for c in rel.description], r, strict=True)) for r in rel.fetchall()]


def same(got, expected):
    return sorted(map(repr, (sorted(r.asDict().items()) for r in got))) == sorted(map(repr, (sorted(r.items()) for r in expected)))


def test_a_loss_that_no_rule_explains_is_told_too(spark):
    from stintlab.operators import season

    found = {r["lap_no"]: (r["kind"], round(r["loss_s"], 6)) for r in season.findings(bundle(spark)).collect()}
    assert found == {
        1: ("early lift", 0.5), 2: ("low least speed", 0.6), 3: ("late throttle", 0.7), 4: ("early throttle", 0.8),
        5: ("unexplained", 0.9), 6: ("unexplained", 1.0),
    }


def test_every_loss_of_the_table_is_a_finding(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["coach_findings"](spark, SF).collect()
    assert same(got, sql_rows("coach_findings"))
    assert Counter(r["kind"] for r in got)["unexplained"] > 0


def test_a_plan_takes_the_loss_that_most_laps_share_also_where_no_rule_explains_it(spark):
    from stintlab.operators import season

    rows = season.plan(season.findings(bundle(spark)), ["axis_id"]).collect()
    assert [(r["segment_id"], r["kind"], r["laps"], round(r["loss_s"], 6), r["place"]) for r in rows] == [(1, "unexplained", 2, 0.95, 1)]


def test_plans_are_made_of_every_loss_of_the_table(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["coach_plan"](spark, SF).collect()
    assert same(got, sql_rows("coach_plan"))
    assert {r["kind"] for r in got} >= {"unexplained"}


def test_a_report_has_the_laps_of_a_loss_that_no_rule_explains(spark):
    import json

    from pyspark.sql import functions as F

    from stintlab.operators import season

    found = season.findings(bundle(spark))
    plan = season.plan(found, ["axis_id"]).select("axis_id", "segment_id", "kind", "place")
    rows = found.join(plan, ["axis_id", "segment_id", "kind"]).groupBy("axis_id", "place", "kind", "segment_id").agg(F.array_sort(F.collect_list("lap_no")).alias("laps"))
    (report,) = season.report(rows, "axis_id").collect()
    assert json.loads(report["document"])["results"] == [{"place": 1, "kind": "unexplained", "segment_id": 1, "laps": [5, 6]}]
    assert report["n"] == 1 and report["valid"]


def test_reports_have_every_segment_with_a_loss(spark):
    import __spark_entry__

    got = __spark_entry__.queries()["day_reports"](spark, SF).collect()
    assert same(got, sql_rows("day_reports"))
    lost = {(r["axis_id"], r["segment_id"]) for r in __spark_entry__.queries()["coach_findings"](spark, SF).collect()}
    assert {r["axis_id"]: r["n"] for r in got} == Counter(a for a, _ in lost)
