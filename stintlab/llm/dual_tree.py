"""Centroid clustering by Lloyd's rounds over two trees.

Vectors become integers, floor(256 x). Each block of vectors is built into a cover tree once: a node's children lie
within its radius and more than half of it apart. Every round builds a tree over the centroids too and walks both: a
pair of nodes is let go when the distance of its centres less both radii passes what another node of centroids can do
for all vectors of the block's node. A node of vectors with one centroid left goes to it whole, by the difference of two
running sums; what is left when both sides are leaves is compared exactly, a tie going to the smaller number.

Trees are rows of a table in the shared folder, so a lost task reads its blocks again. A task returns a count and a sum
for each centroid, at most; the driver holds the centroids, whose number is a parameter.

Squares and sums are exact: in doubles where components stay within 2^20, in Python's integers beyond. Vectors with
another length, null, or with null or non-finite components are left out; so are those with a component past 1e150, whose
square no double holds. Repeated rows count as vectors, a null vec_id as the empty text where vectors are drawn and is
returned. Of fewer vectors than centroids each is one; no vectors give no rows. A distance or sum that passes 64 bits is
returned as 2^63 - 1. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlab.llm.common import cut

DIMENSIONS, CENTROIDS, ROUNDS, SEED, STEP = 64, 40, 5, "2", 256
#: Vectors of a tree and of a leaf; how far a component goes for doubles to be exact; share by which bounds are widened.
BLOCK, LEAF, EXACT, SLACK, MOST = 2048, 8, float(1 << 20), 1e-9, (1 << 63) - 1


@dataclass
class Tree:
    """Points in the order of the tree, ``order`` their places before; of each node its points lo to hi, the first of which
    is the centre, its radius and its children, ``count`` from ``child`` on."""

    points: np.ndarray
    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    radius: np.ndarray
    child: np.ndarray
    count: np.ndarray


def cover_tree(points: np.ndarray, leaf: int = LEAF) -> Tree:
    order = np.zeros(len(points), np.int64)
    nodes: list[tuple] = []
    waiting: list = [(0, np.arange(len(points)))]  # of each node its first place and its points, the centre first
    while len(nodes) < len(waiting):
        lo, own = waiting[len(nodes)]
        waiting[len(nodes)] = None
        end, child, count = lo + len(own), len(waiting), 0
        far = np.sqrt(((points[own] - points[own[0]]) ** 2).sum(axis=1))
        radius = float(far.max())
        if len(own) <= leaf or radius == 0:
            order[lo:end] = own
        else:
            start = lo
            while len(own):
                near = far <= radius / 2
                near[0] = True
                waiting.append((start, own[near]))
                start, own, count = start + int(near.sum()), own[~near], count + 1
                far = np.sqrt(((points[own] - points[own[0]]) ** 2).sum(axis=1)) if len(own) else far
        nodes.append((lo, end, radius, child, count))
    lo, hi, radius, child, count = (np.array([n[i] for n in nodes]) for i in range(5))
    return Tree(points[order], order, lo, hi, radius, child, count)


def _counted(count: np.ndarray) -> np.ndarray:
    """0, 1, ... up to each count, one after another."""
    ends = np.cumsum(count)
    return np.arange(int(count.sum())) - np.repeat(ends - count, count)


def _places(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return np.repeat(lo, hi - lo) + _counted(hi - lo)


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows that hold integers: doubles where they suffice, else Python's integers."""
    if len(a) and max(np.abs(a).max(), np.abs(b).max()) > EXACT:
        whole = np.frompyfunc(int, 1, 1)
        d = whole(a) - whole(b)
        return (d * d).sum(axis=1)
    d = a - b
    return np.einsum("ij,ij->i", d, d)


def assign(tree: Tree, centroids: Tree) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Ranges of the tree's points and the centroid each goes to: lo, hi, number; and how many exact comparisons it took."""
    q, r = np.zeros(1, np.int64), np.zeros(1, np.int64)
    whole, left_points, left_centroids = [], [], []
    while len(q):
        d = np.sqrt(((tree.points[tree.lo[q]] - centroids.points[centroids.lo[r]]) ** 2).sum(axis=1))
        first = np.flatnonzero(np.diff(q, prepend=-1))
        sizes = np.diff(np.append(first, len(q)))
        best = np.repeat(np.minimum.reduceat(d + tree.radius[q], first), sizes)
        keep = d - tree.radius[q] - centroids.radius[r] <= best + SLACK * (1 + d + best)
        q, r = q[keep], r[keep]
        first = np.flatnonzero(np.diff(q, prepend=-1))
        alone = np.repeat(np.diff(np.append(first, len(q))) == 1, np.diff(np.append(first, len(q))))
        done = alone & (centroids.hi[r] - centroids.lo[r] == 1)
        whole.append((tree.lo[q[done]], tree.hi[q[done]], centroids.order[centroids.lo[r[done]]]))
        q, r = q[~done], r[~done]
        ends = (tree.count[q] == 0) & (centroids.count[r] == 0)
        # a leaf waits until all that it is compared with are leaves
        first = np.flatnonzero(np.diff(q, prepend=-1))
        sizes = np.diff(np.append(first, len(q)))
        ends = np.repeat(np.logical_and.reduceat(ends, first), sizes) if len(q) else ends
        points = tree.hi[q[ends]] - tree.lo[q[ends]]
        others = centroids.hi[r[ends]] - centroids.lo[r[ends]]
        pair = np.repeat(np.arange(len(points)), points * others)
        nth = _counted(points * others)
        left_points.append(tree.lo[q[ends]][pair] + nth // others[pair])
        left_centroids.append(centroids.lo[r[ends]][pair] + nth % others[pair])
        q, r = q[~ends], r[~ends]
        # children of both sides; a leaf stays as it is
        nq, nr = np.maximum(tree.count[q], 1), np.maximum(centroids.count[r], 1)
        cq, cr = np.where(tree.count[q], tree.child[q], q), np.where(centroids.count[r], centroids.child[r], r)
        pair = np.repeat(np.arange(len(q)), nq * nr)
        nth = _counted(nq * nr)
        q, r = cq[pair] + nth // nr[pair], cr[pair] + nth % nr[pair]
        order = np.argsort(q, kind="stable")
        q, r = q[order], r[order]
    p, c = np.concatenate(left_points), np.concatenate(left_centroids)
    d, number = squared(tree.points[p], centroids.points[c]), centroids.order[c]
    order = np.lexsort((number, d, p)) if d.dtype != object else np.array(sorted(range(len(p)), key=lambda i: (p[i], d[i], number[i])), np.int64)
    p, number = p[order], number[order]
    nearest = np.flatnonzero(np.diff(p, prepend=-1))
    lo, hi, to = (np.concatenate(x) for x in zip(*whole, (p[nearest], p[nearest] + 1, number[nearest]), strict=True))
    return lo, hi, to, len(p)


def kept(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", dimensions: int = DIMENSIONS) -> DataFrame:
    """(vec_id, e) of the vectors that take part, their components as doubles."""
    e = F.col(vector_col).cast("array<double>")
    whole = F.expr(f"size(e) = {dimensions} AND NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) > 1e150)")
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), e.alias("e")).where(whole)


def integers(values) -> np.ndarray:
    return np.floor(np.asarray(values, np.float64) * STEP) + 0.0


def _packed(x: np.ndarray) -> bytes:
    return x.astype(np.int32 if not x.size or np.abs(x).max() < 2**31 else np.float64).tobytes()


def _unpacked(raw: bytes, rows: int, dimensions: int) -> np.ndarray:
    kind = np.int32 if len(raw) == 4 * rows * dimensions else np.float64
    return np.frombuffer(raw, kind).astype(np.float64).reshape(rows, dimensions)


_TREES = "ids array<long>, points binary, lo array<int>, hi array<int>, radius array<double>, child array<int>, count array<int>"


def trees(vectors: DataFrame, dimensions: int = DIMENSIONS, block: int = BLOCK) -> DataFrame:
    """A row a cover tree of up to ``block`` vectors of (vec_id, e)."""
    names = [part.split()[0] for part in _TREES.split(", ")]
    kinds = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()), *[pa.list_(pa.int32())] * 2]

    def built(ids: pa.ChunkedArray, points: np.ndarray) -> pa.RecordBatch:
        tree = cover_tree(points)
        row = [ids.take(pa.array(tree.order)).to_pylist(), _packed(tree.points), tree.lo, tree.hi, tree.radius, tree.child, tree.count]
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            for start in range(0, batch.num_rows, block):
                held.append(batch.slice(start, block))
                if sum(b.num_rows for b in held) >= block:
                    table = pa.Table.from_batches(held)
                    yield made(table.slice(0, block))
                    held = table.slice(block).to_batches()
        if any(b.num_rows for b in held):
            yield made(pa.Table.from_batches(held))

    def made(table: pa.Table) -> pa.RecordBatch:
        flat = table["e"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return built(table["vec_id"], integers(flat).reshape(table.num_rows, dimensions))

    return vectors.mapInArrow(run, _TREES)


def _read(batches: Iterator[pa.RecordBatch], dimensions: int) -> Iterator[tuple[pa.Array, Tree]]:
    for batch in batches:
        for i in range(batch.num_rows):
            ids = batch.column(0).slice(i, 1).flatten()
            lo, hi, radius, child, count = (batch.column(k).slice(i, 1).flatten().to_numpy() for k in range(2, 7))
            yield ids, Tree(_unpacked(batch.column(1)[i].as_py(), len(ids), dimensions), np.arange(len(ids)), lo, hi, radius, child, count)


def _sums(tree: Tree, lo: np.ndarray, hi: np.ndarray, to: np.ndarray, k: int) -> Iterator[tuple[int, int, list[int]]]:
    """Count and componentwise sum of what goes to each centroid, exact."""
    points = tree.points
    if np.abs(points).max() > EXACT:
        points = np.frompyfunc(int, 1, 1)(points)
    running = np.concatenate((points[:1] * 0, np.cumsum(points, axis=0)))
    for c in np.unique(to).tolist():
        own = to == c
        total = (running[hi[own]] - running[lo[own]]).sum(axis=0)
        yield c, int((hi[own] - lo[own]).sum()), [int(x) for x in total]


def _text(numbers) -> str:
    return ",".join(str(int(x)) for x in numbers)


def next_centroids(forest: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: floors of the means, in Python's integers; one that no vector goes to stays."""
    dimensions, k = len(centroids[0]), len(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        over = cover_tree(np.array(centroids, np.float64), 1)
        n, total = [0] * k, [[0] * dimensions for _ in range(k)]
        for _, tree in _read(batches, dimensions):
            lo, hi, to, _ = assign(tree, over)
            for c, m, own in _sums(tree, lo, hi, to, k):
                n[c] += m
                total[c] = [a + b for a, b in zip(total[c], own, strict=True)]
        some = [c for c in range(k) if n[c]]
        yield pa.RecordBatch.from_pydict({"cluster": pa.array(some, pa.int32()), "n": pa.array([n[c] for c in some], pa.int64()), "total": pa.array([_text(total[c]) for c in some], pa.string())})

    def added(key: tuple, rows: pa.Table) -> pa.Table:
        n, total = sum(rows["n"].to_pylist()), [0] * dimensions
        for own in rows["total"].to_pylist():  # a row a task
            total = [a + int(b) for a, b in zip(total, own.split(","), strict=True)]
        return pa.table({"cluster": pa.array([key[0].as_py()], pa.int32()), "mean": pa.array([_text(x // n for x in total)])})

    found = forest.mapInArrow(run, "cluster int, n long, total string").groupBy("cluster").applyInArrow(added, "cluster int, mean string")
    out = list(centroids)
    for row in found.collect():  # a row a centroid
        out[row["cluster"]] = [int(x) for x in row["mean"].split(",")]
    return out


def assigned(forest: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(vec_id, cluster, distance, comparisons): the last is the number of exact ones of the whole tree, on its first row."""
    dimensions = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = np.array(centroids, np.float64)
        over = cover_tree(points, 1)
        for ids, tree in _read(batches, dimensions):
            lo, hi, to, compared = assign(tree, over)
            cluster = np.zeros(len(ids), np.int32)
            cluster[_places(lo, hi)] = np.repeat(to, hi - lo)
            far = [min(int(d), MOST) for d in squared(tree.points, points[cluster])]
            counts = np.zeros(len(ids), np.int64)
            counts[:1] = compared
            yield pa.RecordBatch.from_arrays([ids, pa.array(cluster), pa.array(far, pa.int64()), pa.array(counts)], names=["vec_id", "cluster", "distance", "comparisons"])

    return forest.mapInArrow(run, "vec_id long, cluster int, distance long, comparisons long")


def cluster(
    vectors: DataFrame,
    k: int = CENTROIDS,
    rounds: int = ROUNDS,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    dimensions: int = DIMENSIONS,
    seed: str = SEED,
) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256. The first centroids are the ``k``
    vectors with the smallest sha256 of ``seed:vec_id``; ``rounds`` rounds move them."""
    spark = vectors.sparkSession
    own = kept(vectors, id_col, vector_col, dimensions)
    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = own.orderBy(drawn, "e").limit(k).collect()  # k rows
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = [[int(x) for x in integers(row["e"])] for row in first]
    forest = cut(trees(own, dimensions), "trees")
    for _ in range(rounds):
        centroids = next_centroids(forest, centroids)
    out = cut(assigned(forest, centroids).drop("comparisons"), "assigned")
    inertia = {r[0]: int(r[1]) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}  # k rows
    total = min(sum(inertia.values()), MOST)
    rows = [(c, min(n, MOST), total, hashlib.sha256(_text(centroids[c]).encode()).hexdigest()) for c, n in inertia.items()]
    known = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
