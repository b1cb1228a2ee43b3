"""Lloyd's rounds over two trees against rounds over all pairs in Python's integers."""

import hashlib
import math
import random

import numpy as np
import pytest

SF = "/root/testdata/sf0.001"
ROWS = "vec_id long, embedding array<double>, cluster int, distance long, n long, e string"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, 2, 3, "x") for i, e in rows], ROWS)


def brute(rows, k=40, rounds=5, dimensions=64):
    own = [(i, [math.floor(256 * x) for x in e]) for i, e in rows if e is not None and len(e) == dimensions and all(x is not None and math.isfinite(x) for x in e)]
    first = sorted(own, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [p for _, p in first]

    def nearest(p):
        return min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, p in own:
            groups.setdefault(nearest(p)[1], []).append(p)
        centroids = [[sum(x) // len(groups[j]) for x in zip(*groups[j], strict=True)] if j in groups else c for j, c in enumerate(centroids)]
    out = [(i, *nearest(p)[::-1]) for i, p in own]
    inertia = {}
    for _, j, d in out:
        inertia[j] = inertia.get(j, 0) + d
    top = (1 << 63) - 1
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, j, min(d, top), min(inertia[j], top), min(sum(inertia.values()), top), sha[j]) for i, j, d in out), key=repr)


def told(df):
    return sorted((tuple(r) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256").collect()), key=repr)


def made(rng, n=400, scale=1.0):
    middles = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(9)]
    rows = []
    for i in range(n):
        m = rng.choice(middles)
        rows.append((i, [scale * (x + rng.gauss(0, rng.choice([0.001, 0.2]))) for x in m]))
    rows += [(1000 + i, [scale * x for x in middles[0]]) for i in range(150)]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [1.0] * 63), (2004, [math.nan] * 64), (2005, [math.inf] + [0.0] * 63), (2006, [None] + [0.0] * 63)]
    rows += [(None, [0.25] * 64), (None, [-0.25] * 64), (7, [0.5 / 256] * 64), (7, [0.5 / 256] * 64), (2007, [-0.0] * 64)]
    return rows


def test_clusters_are_those_of_comparing_all(spark):
    from stintlab.llm.dual_tree import cluster

    for seed, scale in ((1, 1.0), (2, 30_000.0), (3, 1e12)):
        rows = made(random.Random(seed), scale=scale)
        assert told(cluster(table(spark, rows).repartition(3))) == brute(rows)


def test_ties_go_to_the_smaller_number_and_empty_centroids_stay(spark):
    from stintlab.llm.dual_tree import cluster

    rng = random.Random(4)
    rows = [(i, [float(rng.choice([0, 2])), float(rng.choice([0, 2]))]) for i in range(60)] + [(100 + i, [1.0, 1.0]) for i in range(20)]
    got = told(cluster(table(spark, rows).repartition(2), k=12, rounds=3, dimensions=2))
    assert got == brute(rows, 12, 3, 2)
    assert len({r[1] for r in got}) < 12


def test_few_and_no_vectors(spark):
    from stintlab.llm.dual_tree import cluster

    assert told(cluster(table(spark, []))) == []
    assert told(cluster(table(spark, [(1, None)]))) == []
    rows = [(1, [0.5] * 64), (2, [0.75] * 64)]
    assert told(cluster(table(spark, rows))) == brute(rows)


def test_cover_trees_cover_and_prune():
    from stintlab.llm.dual_tree import assign, cover_tree

    rng = np.random.default_rng(5)
    middles = rng.normal(0, 2000, (30, 64))
    points = np.floor(np.repeat(middles, 60, axis=0) + rng.normal(0, 3, (1800, 64)))
    tree, over = cover_tree(points), cover_tree(np.floor(middles[:12]), 1)
    assert sorted(tree.order.tolist()) == list(range(1800)) and (tree.points == points[tree.order]).all()
    for lo, hi, radius, child, count in zip(tree.lo, tree.hi, tree.radius, tree.child, tree.count, strict=True):
        assert np.sqrt(((tree.points[lo:hi] - tree.points[lo]) ** 2).sum(1)).max() <= radius + 1e-6
        if count:
            assert tree.lo[child] == lo and tree.hi[child + count - 1] == hi
            centres = tree.points[tree.lo[child : child + count]]
            apart = np.sqrt(((centres[:, None] - centres[None]) ** 2).sum(2)) + np.eye(count) * 1e9
            assert apart.min() > radius / 2
    lo, hi, to, compared = assign(tree, over)
    found = np.zeros(1800, int)
    for a, b, c in zip(lo, hi, to, strict=True):
        found[a:b] = c
    assert (found == ((tree.points[:, None] - np.floor(middles[:12])[None]) ** 2).sum(2).argmin(1)).all()
    # whole nodes go at once and hardly a pair is compared
    assert len(lo) < 1800 / 4 and compared < 1800 * 12 / 20


def test_the_query_returns_what_its_sql_says(spark):
    duckdb = pytest.importorskip("duckdb")

    from stintlab.llm import queries

    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{SF}/embeddings.parquet'")
    expected = sorted(db.execute(queries.oracle_sql()["op13_dual_tree"]).fetchall(), key=repr)
    assert told(queries.op13_dual_tree(spark, SF)) == expected
