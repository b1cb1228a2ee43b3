"""Near-duplicate vectors by NN-descent.

Equal vectors are one class. Random hyperplanes deal the classes into small blocks, whose nearest members start
every vector's neighbour list. The number of trees of planes grows with their depth, so that a pair at the threshold
misses all of them as seldom among many vectors as among few; where more vectors than a block's lie on the same sides,
they are split further by where they lie. Then lists are refined by local joins until few links are new: the
neighbours of a vector, forward and reverse, are compared with each other, and what is nearer than a list's last entry
enters it. The pairs of at least the threshold link vectors, and all members of a component are compared in blocks.

Recall is audited: samples of all vectors and of the linked ones are compared with all vectors, and while the mean
share of a vector's links that was found is below the target in either, the lists are doubled, started again from
other planes and refined. If the last audit fails, all pairs are compared.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing; vectors of different
lengths never link. Rows with a null vec_id are returned without links. Repeated rows count as vectors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlab.llm.common import cut, groups, spans
from stintlab.llm.components import components

THRESHOLD, TARGET_RECALL = 0.95, 0.99
NEIGHBOURS, BLOCK = 8, 192
#: The chance that a pair at the threshold shares no code; the share of new links at which rounds end, and their bound.
MISS, FEW_NEW, MAX_ROUNDS = 0.03, 0.001, 12
AUDIT, MAX_DOUBLINGS, SEED = 2048, 3, 11
#: Bytes of vectors with one code that a task splits at once, and the side of an exact comparison's blocks.
GROUP_BYTES, EXACT_BLOCK = 16 << 20, 2048


def unit_rows(column: pa.Array) -> list[bytes | None]:
    """Each vector over its length as doubles, or None where it can't be compared."""
    flat, offsets = column.values, column.offsets.to_numpy()
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    if flat.null_count:
        values = np.where(flat.is_null().to_numpy(zero_copy_only=False), np.nan, values)
    known, out = column.is_valid().to_numpy(zero_copy_only=False), []
    for ok, a, b in zip(known, offsets[:-1], offsets[1:], strict=True):
        v = values[a:b]
        if not ok or a == b or not np.isfinite(v).all() or not (top := np.abs(v).max()):
            out.append(None)
            continue
        v = v / top  # so that squares neither vanish nor overflow
        out.append((v / np.sqrt(v @ v)).tobytes())
    return out


def _units(vectors: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = unit_rows(batch.column(1))
            keys = [None if r is None else hashlib.blake2b(r, digest_size=16).digest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.binary()), pa.array(rows, pa.binary())], names=["vec_id", "key", "vec"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, "vec_id long, key binary, vec binary")


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), np.float64).reshape(len(rows), -1)


def _by_length(vecs: list[bytes]) -> list[np.ndarray]:
    sizes = np.array([len(v) for v in vecs])
    return [np.flatnonzero(sizes == n) for n in np.unique(sizes)]


def trees_for(bits: int, threshold: float) -> int:
    """As many trees as let a pair at the threshold lie on the same sides of all of one's planes, but for ``MISS``."""
    same = (1 - math.acos(min(1.0, max(-1.0, threshold))) / math.pi) ** bits
    return 1 if same >= 1 - MISS else math.ceil(math.log(MISS) / math.log1p(-same))


def _codes(reps: DataFrame, trees: int, bits: int, turn: int) -> DataFrame:
    """(rep, vec, tree, code): on which sides of the tree's planes a vector lies, and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = batch.column(1).to_pylist()
            for own in _by_length(vecs) if vecs else ():
                part = batch.take(pa.array(own))
                x = matrix(part.column(1))
                for tree in range(trees):
                    planes = np.random.Generator(np.random.PCG64([SEED, turn, tree, x.shape[1]])).standard_normal((x.shape[1], bits))
                    code = (x @ planes > 0) @ (1 << np.arange(bits, dtype=np.int64)) * 65536 + x.shape[1]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0), part.column(1), pa.array(np.full(len(x), tree)), pa.array(code)], names=["rep", "vec", "tree", "code"]
                    )

    return reps.select("rep", "vec").mapInArrow(run, "rep long, vec binary, tree long, code long")


def leaves(x: np.ndarray, most: int, rng: np.random.Generator) -> Iterator[np.ndarray]:
    """Row numbers in parts of at most ``most``, halved along the line between two of a part's rows."""
    todo = [np.arange(len(x))]
    while todo:
        own = todo.pop()
        if len(own) <= most:
            yield own
            continue
        a, b = rng.choice(len(own), 2, replace=False)
        order = np.argpartition(x[own] @ (x[own[a]] - x[own[b]]), len(own) // 2)
        todo += [own[order[: len(own) // 2]], own[order[len(own) // 2 :]]]


def _split(coded: DataFrame, most: int) -> DataFrame:
    """The rows with new codes wherever more than ``most`` had one: each goes to the nearest of some of their vectors."""
    for level in range(20):
        over = coded.groupBy("tree", "code").agg(F.count("*").alias("m")).where(F.col("m") > most)
        chance = F.pmod(F.xxhash64("rep", "tree", F.lit(level)), F.col("m")) < F.ceil(4 * F.col("m") / most)
        # at most 4 vectors for every ``most`` rows
        pivots: dict[tuple[int, int], list[bytes]] = {}
        for r in coded.join(over, ["tree", "code"]).where(chance).select("tree", "code", "vec").toLocalIterator():
            pivots.setdefault((r.tree, r.code), []).append(bytes(r.vec))
        if not pivots:
            if over.isEmpty():
                return coded
            continue
        held = coded.sparkSession.sparkContext.broadcast(pivots)

        def run(batches: Iterator[pa.RecordBatch], held=held, level=level) -> Iterator[pa.RecordBatch]:
            near = {key: np.frombuffer(b"".join(v), np.float64).reshape(len(v), -1) for key, v in held.value.items()}
            for batch in batches:
                tree, code = batch.column(2).to_numpy(), batch.column(3).to_numpy().copy()
                at: dict[tuple[int, int], list[int]] = {}
                for i, key in enumerate(zip(tree.tolist(), code.tolist(), strict=True)):
                    if key in near:
                        at.setdefault(key, []).append(i)
                vecs = batch.column(1)
                for key, own in at.items():
                    x = matrix(vecs.take(pa.array(own)))
                    cells = (x @ near[key].T).argmax(1).tolist()
                    named = {c: int.from_bytes(hashlib.blake2b(f"{key[1]},{level},{c}".encode(), digest_size=8).digest(), "big", signed=True) for c in set(cells)}
                    code[own] = [named[c] for c in cells]
                yield pa.RecordBatch.from_arrays([batch.column(0), vecs, batch.column(2), pa.array(code)], names=["rep", "vec", "tree", "code"])

        coded = cut(coded.mapInArrow(run, "rep long, vec binary, tree long, code long"), "split")
    raise RuntimeError(f"more than {most} vectors can't be told apart")


def _nearest(k: int):
    """Of each block, every member's k nearest others: (u, v, sim)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "gkey"):
            reps, vecs = table["rep"].to_numpy(), table["vec"].to_pylist()
            out = []
            for a, b in spans(table, "gkey"):
                for own in _by_length(vecs[a:b]):
                    whole = np.frombuffer(b"".join(vecs[a + i] for i in own), np.float64).reshape(len(own), -1)
                    for part in leaves(whole, BLOCK, np.random.Generator(np.random.PCG64([SEED, len(own)]))):
                        n = len(part)
                        if n < 2:
                            continue
                        x = whole[part]
                        sim = x @ x.T
                        np.fill_diagonal(sim, -2)
                        best = np.argpartition(-sim, min(k, n - 1) - 1, axis=1)[:, : min(k, n - 1)]
                        ids = reps[a + own[part]]
                        out.append((np.repeat(ids, best.shape[1]), ids[best].ravel(), np.take_along_axis(sim, best, 1).ravel()))
            yield from _edges(out)

    return run


def _edges(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
    if parts:
        columns = [np.concatenate([p[i] for p in parts]) for i in range(3)]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["u", "v", "sim"])


def _top(k: int):
    """Of rows sorted by u, the k entries of greatest sim for every u, old before new where a pair came twice, with
    the sim that a newcomer must exceed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "u"):
            u, v, sim, new = (table[c].to_numpy() for c in ("u", "v", "sim", "new"))
            order = np.lexsort((new, v, u))
            once = np.concatenate(([True], (np.diff(u[order]) != 0) | (np.diff(v[order]) != 0)))
            order = order[once]
            order = order[np.lexsort((v[order], -sim[order], u[order]))]
            own = u[order]
            start = np.flatnonzero(np.concatenate(([True], np.diff(own) != 0)))
            rank = np.arange(len(own)) - np.repeat(start, np.diff(np.append(start, len(own))))
            order, rank = order[rank < k], rank[rank < k]
            own, near = u[order], sim[order]
            start = np.flatnonzero(rank == 0)
            sizes = np.diff(np.append(start, len(own)))
            bar = np.where(sizes == k, near[start + sizes - 1], -2.0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(own), pa.array(v[order]), pa.array(near), pa.array(new[order]), pa.array(np.repeat(bar, sizes))], names=["u", "v", "sim", "new", "bar"]
            )

    return run


_GRAPH = "u long, v long, sim double, new boolean, bar double"


def _merged(rows: DataFrame, k: int) -> DataFrame:
    return rows.select("u", "v", "sim", "new").repartition(F.col("u")).sortWithinPartitions("u").mapInArrow(_top(k), _GRAPH)


def _start(reps: DataFrame, n: int, k: int, threshold: float, turn: int) -> DataFrame:
    bits = max(1, math.ceil(math.log2(max(n, 2) / (BLOCK / 2))))
    longest = reps.agg(F.max(F.octet_length("vec"))).first()[0] or 1
    coded = cut(_codes(reps, trees_for(bits, threshold), bits, turn), "codes")
    coded = _split(coded, max(BLOCK, GROUP_BYTES // longest))
    dealt = coded.select(F.xxhash64("tree", "code").alias("gkey"), "rep", "vec").repartition(F.col("gkey")).sortWithinPartitions("gkey", "rep")
    found = dealt.mapInArrow(_nearest(k), "u long, v long, sim double").withColumn("new", F.lit(True))
    return cut(_merged(found, k), "graph")


def _compared(k: int):
    """The local join at each vector: what its neighbours find in each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "at"):
            ids, new, bar = table["rep"].to_numpy(), table["new"].to_numpy(), table["bar"].to_numpy()
            x = matrix(table["vec"]) if len(set(map(len, table["vec"].to_pylist()))) == 1 else None
            vecs = None if x is not None else table["vec"].to_pylist()
            out = []
            for a, b in spans(table, "at"):
                if b - a < 2 or not new[a:b].any():
                    continue
                # all neighbours of a vector have its length
                own = x[a:b] if x is not None else np.frombuffer(b"".join(vecs[a:b]), np.float64).reshape(b - a, -1)
                sim = own @ own.T
                good = (new[a:b, None] | new[None, a:b]) & (sim > bar[a:b, None]) & (ids[a:b, None] != ids[None, a:b])
                i, j = np.nonzero(good)
                if len(i):
                    out.append((ids[a + i], ids[a + j], sim[i, j]))
            yield from _edges(out)

    return run


def _refined(graph: DataFrame, reps: DataFrame, k: int) -> DataFrame:
    """A round of NN-descent over lists of at most k forward and k reverse neighbours."""
    bars = graph.groupBy("u").agg(F.first("bar").alias("bar")).withColumnRenamed("u", "rep")
    forward = graph.select(F.col("u").alias("at"), F.col("v").alias("rep"), "sim", "new")
    reverse = graph.select(F.col("v").alias("u"), F.col("u").alias("v"), "sim", "new")
    # a hub's list is cut in the tasks that hold parts of it, then again where they meet
    reverse = reverse.sortWithinPartitions("u").mapInArrow(_top(k), _GRAPH)
    reverse = _merged(reverse, k).select(F.col("u").alias("at"), F.col("v").alias("rep"), "sim", "new")
    both = forward.unionByName(reverse).groupBy("at", "rep").agg(F.max("new").alias("new"))
    held = reps.select("rep", "vec").join(bars, "rep", "left").withColumn("bar", F.coalesce("bar", F.lit(-2.0)))
    rows = both.join(held, "rep").select("at", "rep", "new", "bar", "vec").repartition(F.col("at")).sortWithinPartitions("at")
    found = rows.mapInArrow(_compared(k), "u long, v long, sim double").withColumn("new", F.lit(True))
    old = graph.select("u", "v", "sim", F.lit(False).alias("new"))
    return cut(_merged(old.unionByName(found), k), "graph")


def _counted(threshold: float):
    """Of each pair of blocks of a component, every member's number of linked vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "gkey"):
            reps, side, size, cross = (table[c].to_numpy() for c in ("rep", "side", "size", "cross"))
            vecs = table["vec"].to_pylist()
            ids, counts = [], []
            for a, b in spans(table, "gkey"):
                x = np.frombuffer(b"".join(vecs[a:b]), np.float64).reshape(b - a, -1)
                near = x @ x.T >= threshold
                if cross[a]:
                    near &= side[a:b, None] != side[None, a:b]
                np.fill_diagonal(near, False)
                ids.append(reps[a:b])
                counts.append(near @ size[a:b])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ids)), pa.array(np.concatenate(counts))], names=["rep", "links"])

    return run


def _links(graph: DataFrame, reps: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(rep, links), of all pairs within a component, and (node, component)."""
    near = graph.where(F.col("sim") >= threshold)
    pairs = cut(near.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "pairs")
    joined = cut(components(pairs), "components")
    names = joined.unionByName(joined.select(F.col("component").alias("node"), "component").distinct())
    members = cut(names.select("component", F.col("node").alias("rep")), "members")

    sizes = members.groupBy("component").agg(F.count("*").alias("m"))
    blocks = F.ceil(F.col("m") / EXACT_BLOCK).cast("int")
    rows = members.join(sizes, "component").withColumns({"blocks": blocks, "own": F.pmod(F.xxhash64("rep"), blocks).cast("int")})
    rows = rows.join(reps, "rep").select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(
        F.xxhash64("component", F.least("own", "other"), F.greatest("own", "other")).alias("gkey"), "rep",
        (F.col("own") != F.col("other")).alias("cross"), F.col("own").alias("side"), "size", "vec",
    )
    many = rows.repartition(F.col("gkey")).sortWithinPartitions("gkey").mapInArrow(_counted(threshold), "rep long, links long")
    return cut(many.groupBy("rep").agg(F.sum("links").alias("links")), "links"), joined


def _all_pairs(threshold: float):
    """Of each pair of blocks, every member's number of linked vectors, and the least row it is joined with in them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "gkey"):
            reps, side, size = (table[c].to_numpy() for c in ("rep", "side", "size"))
            for a, b in spans(table, "gkey"):
                x = np.frombuffer(b"".join(table["vec"][a:b].to_pylist()), np.float64).reshape(b - a, -1)
                near = x @ x.T >= threshold
                np.fill_diagonal(near, False)
                if (side[a:b] != side[a]).any():
                    near &= side[a:b, None] != side[None, a:b]
                i, j = np.nonzero(near)
                label = np.arange(b - a)
                while True:
                    low = label.copy()
                    np.minimum.at(low, i, label[j])
                    low = low[low]
                    if (low == label).all():
                        break
                    label = low
                own = np.flatnonzero(near.any(1))
                ids = reps[a:b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[own]), pa.array((near @ size[a:b])[own]), pa.array(ids[label[own]])], names=["rep", "links", "least"]
                )

    return run


def exact_links(reps: DataFrame, n: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The same as :func:`_links` from all pairs of vectors of a length, a row for each of n / ``EXACT_BLOCK`` blocks."""
    blocks = max(1, math.ceil(n / EXACT_BLOCK))
    rows = reps.withColumn("side", F.pmod(F.xxhash64("rep"), F.lit(blocks)).cast("int"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("other"))
    key = F.xxhash64(F.octet_length("vec"), F.least("side", "other"), F.greatest("side", "other"))
    rows = rows.select(key.alias("gkey"), "rep", "side", "size", "vec").repartition(F.col("gkey")).sortWithinPartitions("gkey", "side")
    found = cut(rows.mapInArrow(_all_pairs(threshold), "rep long, links long, least long"), "exact")
    pairs = found.where("rep <> least").select(F.greatest("rep", "least").alias("u"), F.least("rep", "least").alias("v")).distinct()
    return cut(found.groupBy("rep").agg(F.sum("links").alias("links")), "links"), cut(components(cut(pairs, "pairs")), "components")


def audited_recall(links: DataFrame, reps: DataFrame, threshold: float, audit: int = AUDIT) -> float:
    """The mean share of a linked vector's links, by comparison with all vectors, that was found: the less of what
    samples of all vectors and of those with links found give."""
    spark = reps.sparkSession
    order = (F.xxhash64("rep", F.lit(SEED)), "rep")
    any_ = reps.orderBy(*order).limit(audit).select("rep", "vec").collect()
    linked = reps.join(links.where("links > 0").select("rep"), "rep").orderBy(*order).limit(audit).select("rep", "vec").collect()
    both = {r.rep: bytes(r.vec) for r in (*any_, *linked)}
    held = spark.sparkContext.broadcast(list(both.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, total = np.array([i for i, _ in held.value], np.int64), np.zeros(len(held.value), np.int64)
        lengths = np.array([len(v) for _, v in held.value])
        for batch in batches:
            vecs, reps_, size = batch.column(1).to_pylist(), batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for same in _by_length(vecs) if vecs else ():
                asked = np.flatnonzero(lengths == len(vecs[same[0]]))
                if not len(asked):
                    continue
                q = np.frombuffer(b"".join(held.value[i][1] for i in asked), np.float64).reshape(len(asked), -1)
                for own in np.array_split(same, math.ceil(len(same) / 1024)):
                    x = np.frombuffer(b"".join(vecs[i] for i in own), np.float64).reshape(len(own), -1)
                    near = (q @ x.T >= threshold) & (ids[asked, None] != reps_[own][None, :])
                    total[asked] += near @ size[own]
        yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(total)], names=["rep", "true"])

    true = reps.select("rep", "vec", "size").mapInArrow(run, "rep long, true long").groupBy("rep").agg(F.sum("true").alias("true"))
    share = F.least(F.coalesce("links", F.lit(0)), "true") / F.col("true")
    found = {r.rep: r.share for r in true.where(F.col("true") > 0).join(links, "rep", "left").select("rep", share.alias("share")).collect()}
    parts = [[found[r.rep] for r in rows if r.rep in found] for rows in (any_, linked)]
    return min((float(np.mean(p)) for p in parts if p), default=1.0)


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """vec_id, n_links, component_id, kept."""
    known = cut(_units(vectors), "units")
    classes = known.where("key is not null and vec_id is not null").groupBy("key")
    classes = cut(classes.agg(F.min("vec_id").alias("rep"), F.count("*").alias("size"), F.first("vec").alias("vec")), "classes")
    reps = classes.select("rep", "size", "vec")
    n, k = reps.count(), NEIGHBOURS
    graph = _start(reps, n, k, threshold, 0)
    for doubling in range(MAX_DOUBLINGS + 1):
        for _ in range(MAX_ROUNDS):
            graph = _refined(graph, reps, k)
            row = graph.where(F.col("sim") >= threshold).agg(F.count("*").alias("all"), F.count_if("new").alias("new")).first()
            if row.new <= FEW_NEW * row.all:
                break
        links, joined = _links(graph, reps, threshold)
        if audited_recall(links, reps, threshold) >= target_recall:
            break
        if doubling == MAX_DOUBLINGS:
            links, joined = exact_links(reps, n, threshold)
            break
        k *= 2
        other = _start(reps, n, k, threshold, doubling + 1).select("u", "v", "sim", "new")
        graph = cut(_merged(graph.select("u", "v", "sim", F.lit(True).alias("new")).unionByName(other), k), "graph")
    of_class = classes.select("key", "rep", "size").join(links, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    rows = known.select("vec_id", "key").join(of_class, "key", "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "rep", "vec_id"))
    n_links = F.when(F.col("vec_id").isNull(), 0).otherwise(F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)))
    return rows.select(
        "vec_id", n_links.cast("long").alias("n_links"), component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(False)).alias("kept"),
    )
