"""N-gram Jaccard join by chosen paths.

Texts with the same shingle set are one class, and only classes are joined. Each run puts every set on paths of
a random tree: a node picks ``BRANCHES`` of the sets' min-hash coordinates by its own random bits, and a set goes
to the child named by its value, a token sampled from the set, there. Two sets of similarity s share a child with
probability s for each coordinate. Nodes of at most ``SMALL`` sets are compared by brute force; larger ones are
split again, unless a child keeps most of its parent, as near copies do, or the depth is reached: then its pairs
are compared whole, dealt out in blocks. So many runs are made that a pair at the threshold is found with the target
recall; then the recall is measured on sampled pairs, found by their sketches whatever the paths, and while it is too
low as many runs are added. If they don't help, the join fails rather than lose links.

A pair may meet in several leaves; it counts in the one with the least number, which both sides can tell from
their lists of leaves, so pairs are counted where they meet and never gathered. In a leaf, sketches first rule
out what can't be similar; what is left is compared by its whole sets.

The result has one row a document: its class (the least doc_id with the same set), the number of documents with
similarity of at least the threshold, and the component under these links. Texts without words link with nothing.
Rows with a null doc_id are returned with nulls and no links. Repeated rows count as documents.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.llm.common import cut, groups, id_text, slices, spans
from stintlab.llm.components import components
from stintlab.llm.shingles import digest, mix, shingle_set

THRESHOLD, TARGET_RECALL = 0.8, 0.999
SKETCH, BRANCHES, SMALL, BLOCK, DEPTH = 128, 2, 64, 1024, 6
#: A child with this share of its parent's sets isn't split further.
DENSE = 0.4
#: Bits of the filter of documents whose sets are needed, which is broadcast: 8 MB.
FILTER_BITS = 1 << 26
SEED = 7
#: Sets of either half of an audit's sample, partners that each is tried with, the share that has to be found (with room
#: for chance, as a pair right at the threshold is found with the target's probability), and how often runs are added.
AUDIT, AUDIT_PARTNERS, AUDIT_RECALL, MAX_TURNS = 128, 32, 0.99, 4


def runs_needed(threshold: float = THRESHOLD, target: float = TARGET_RECALL, depth: int = DEPTH, branches: int = BRANCHES) -> int:
    """Runs until a pair at the threshold is missed with a probability of at most 1 - target, at any depth."""
    found = 1.0
    for _ in range(depth):
        found = 1 - (1 - threshold * found) ** branches
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - found)))


def sketch(hashes: np.ndarray, size: int = SKETCH) -> np.ndarray:
    """Min-hash values, 32 bits each."""
    odd = mix(np.arange(1, size + 1, dtype=np.uint64) * np.uint64(SEED)) | np.uint64(1)
    out = np.full(size, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 2048):
        part = hashes[i : i + 2048, None] * odd
        part ^= part >> np.uint64(32)
        part *= np.uint64(0x9E3779B97F4A7C15)
        out = np.minimum(out, part.min(0))
    return (out >> np.uint64(32)).astype(np.uint32)


def child_nodes(nodes: np.ndarray, sketches: np.ndarray, branches: int = BRANCHES) -> np.ndarray:
    """For each set at a node, its children: a column for each of the node's coordinates."""
    out = np.empty((len(nodes), branches), np.uint64)
    rows = np.arange(len(nodes))
    for k in range(branches):
        own = mix(nodes.astype(np.uint64) ^ mix(np.array([k + 1], np.uint64)))
        first = (own % np.uint64(sketches.shape[1])).astype(np.int64)
        value = sketches[rows, first].astype(np.uint64)
        out[:, k] = mix(own ^ mix(value))
    return out.view(np.int64)


def _lists(column: pa.ChunkedArray) -> list[np.ndarray]:
    column = column.combine_chunks()
    flat, offsets = column.values.to_numpy(), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]


def _met_before(leaves: list[np.ndarray], node: int) -> np.ndarray:
    """Which pairs share a leaf with a lesser number than this one."""
    own = [x[x < node] for x in leaves]
    return overlaps(own) > 0


def overlaps(sets: list[np.ndarray], chunk: int = 4096) -> np.ndarray:
    """Sizes of the sets' pairwise intersections."""
    token = np.concatenate(sets)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(token, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[place]
    column, row = number[place[keep]], row[keep]
    order = np.argsort(column, kind="stable")
    column, row = column[order], row[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(shared.sum()), chunk):
        lo, hi = np.searchsorted(column, (a, a + chunk))
        there = np.zeros((len(sets), min(chunk, int(shared.sum()) - a)), np.float32)
        there[row[lo:hi], column[lo:hi] - a] = 1
        out += there @ there.T
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _wanted(table: pa.Table, a: int, b: int, leaves: list[np.ndarray]) -> np.ndarray:
    """Pairs of a group that count here: from its two blocks if it has two, and not met before."""
    side = table["side"].to_numpy()[a:b]
    pairs = ~_met_before(leaves[a:b], table["node"][a].as_py())
    if table["cross"][a].as_py():
        pairs &= side[:, None] != side[None, :]
    np.fill_diagonal(pairs, False)
    return pairs


_MEMBER = "gkey long, node long, rep long, cross boolean, side int, size long, leaves array<long>"


def _likely(threshold: float) -> Callable:
    """Keeps of each leaf the sets that have a likely partner by their sketches, five deviations below the threshold."""
    least = threshold - 5 * math.sqrt(threshold * (1 - threshold) / SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "gkey"):
            leaves = _lists(table["leaves"])
            values = np.frombuffer(b"".join(table["sketch"].to_pylist()), np.uint32).reshape(-1, SKETCH)
            keep = np.zeros(table.num_rows, bool)
            for a, b in spans(table, "gkey"):
                own = values[a:b]
                alike = np.zeros((b - a, b - a), np.int32)
                for k in range(SKETCH):
                    alike += own[:, None, k] == own[None, :, k]
                likely = alike >= least * SKETCH
                np.fill_diagonal(likely, False)
                if likely.any():
                    keep[a:b] = (likely & _wanted(table, a, b, leaves)).any(1)
            out = table.filter(pa.array(keep)).drop_columns(["sketch"])
            yield from out.combine_chunks().to_batches()

    return run


def _linked(threshold: float) -> Callable:
    """Of each leaf, a row for each set with links here: their number by documents, and the set it is joined to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "gkey"):
            leaves = _lists(table["leaves"])
            sets = [np.frombuffer(s, np.uint64) for s in table["hashes"].to_pylist()]
            size, reps = table["size"].to_numpy(), table["rep"].to_numpy()
            rows: list[tuple] = []
            for a, b in spans(table, "gkey"):
                if b - a < 2:
                    continue
                shared = overlaps(sets[a:b]).astype(np.float64)
                n = np.diagonal(shared)
                # in whole numbers, so that a pair right at the threshold isn't lost to rounding
                near = shared * 1e6 >= np.rint(threshold * 1e6) * (n[:, None] + n[None, :] - shared)
                near &= _wanted(table, a, b, leaves)
                counts = near @ size[a:b]
                root = np.arange(b - a)
                while True:
                    least = np.where(near, root[None, :], b - a).min(1)
                    new = np.minimum(root, least)
                    new = new[new]
                    if (new == root).all():
                        break
                    root = new
                own = reps[a:b]
                rows += [(int(own[i]), int(counts[i]), int(own[root[i]])) for i in np.flatnonzero(near.any(1))]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["rep", "links", "root"])

    return run


def _sketches(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                keys, n, values = [], [], []
                for t in part.column(1).to_pylist():
                    s = shingle_set(t)
                    n.append(len(s))
                    keys.append(digest(s) if len(s) else None)
                    values.append(sketch(s).tobytes() if len(s) else None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(keys, pa.binary()), pa.array(n, pa.int64()), pa.array(values, pa.binary())],
                    names=["doc_id", "key", "n", "sketch"],
                )

    return id_text(docs).mapInArrow(run, "doc_id long, key binary, n long, sketch binary")


def _leaves(reps: DataFrame, runs: range) -> DataFrame:
    """(rep, node, m): the leaves of every set that have at least two sets, with their numbers of sets."""

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, SKETCH)
            for r in runs:
                root = mix(np.array([r + 1], np.uint64) * np.uint64(0xA24BAED4963EE407))
                nodes = child_nodes(np.repeat(root, len(values)), values)
                for k in range(BRANCHES):
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes[:, k])], names=["rep", "node"])

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32).reshape(-1, SKETCH)
            nodes = child_nodes(batch.column(1).to_numpy().view(np.uint64), values)
            for k in range(BRANCHES):
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(nodes[:, k]), batch.column(2)], names=["rep", "node", "parent"])

    at = reps.select("rep", "sketch").mapInArrow(roots, "rep long, node long").withColumn("parent", F.lit(None).cast("long"))
    found = []
    for depth in range(1, DEPTH + 1):
        sizes = at.groupBy("node").agg(F.count("*").alias("m"), F.max("parent").alias("parent")).where("m > 1")
        done = F.col("m") <= SMALL
        if depth == DEPTH:
            done = F.lit(True)
        elif depth > 1:
            done |= F.col("m") >= DENSE * F.col("parent")
        placed = cut(at.select("rep", "node").join(sizes.withColumn("done", done).select("node", "m", "done"), "node"), "paths")
        found.append(placed.where("done").select("rep", "node", "m"))
        large = placed.where("not done")
        if large.isEmpty():
            break
        at = large.join(reps.select("rep", "sketch"), "rep").select("rep", "node", "m", "sketch")
        at = at.mapInArrow(deeper, "rep long, node long, parent long")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _members(leaves: DataFrame, reps: DataFrame) -> DataFrame:
    """Rows of the comparisons: a leaf of up to BLOCK sets is one group, a larger one a group for each pair of blocks."""
    lists = leaves.groupBy("rep").agg(F.sort_array(F.collect_set("node")).alias("leaves"))  # a few for each set
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep", F.lit(1)), blocks).cast("int")
    rows = leaves.withColumns({"blocks": blocks, "own": own})
    rows = rows.select("rep", "node", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = rows.select(
        F.xxhash64("node", F.least("own", "other"), F.greatest("own", "other")).alias("gkey"), "node", "rep",
        (F.col("own") != F.col("other")).alias("cross"), F.col("own").alias("side"),
    )
    # the block with itself is listed once, a block with another from both sides
    return rows.join(lists.join(reps.select("rep", "size", "sketch"), "rep"), "rep").select(
        "gkey", "node", "rep", "cross", "side", "size", "leaves", "sketch"
    )


def _dealt(rows: DataFrame) -> DataFrame:
    return rows.repartition(F.col("gkey")).sortWithinPartitions("gkey")


def _sets_of(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """(rep, hashes) of about the documents that ``reps`` names: a bounded bitmap of hashed ids is sent to the tasks,
    so that other documents aren't shuffled; those that it lets through by chance fall out in the join after it."""
    spark = docs.sparkSession
    bit = F.pmod(F.xxhash64("rep"), F.lit(FILTER_BITS))
    maps = reps.select(F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("p")).groupBy("k").agg(F.bitmap_construct_agg("p").alias("b"))
    held = spark.sparkContext.broadcast({r.k: bytes(r.b) for r in maps.collect()})  # FILTER_BITS in all
    hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS))
    hashed = hashed.select("doc_id", "text", F.bitmap_bucket_number(bit).alias("k"), F.bitmap_bit_position(bit).alias("p")).where("doc_id is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = held.value
        for batch in batches:
            for part in slices(batch):
                ids, sets = [], []
                for i, k, p in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                    ids.append((own := maps.get(k)) is not None and own[p >> 3] >> (p & 7) & 1 == 1)
                part = part.filter(pa.array(ids, pa.bool_()))
                sets = [shingle_set(t).tobytes() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.binary())], names=["rep", "hashes"])

    return hashed.mapInArrow(run, "rep long, hashes binary")


def _audit_pairs(reps: DataFrame, likely: DataFrame, threshold: float) -> DataFrame:
    """(a, b): pairs that may be similar by their sketches, of each of some sampled sets, however paths went, with up
    to ``AUDIT_PARTNERS`` others. One half of the sample is of all sets, the other of those with a likely partner."""
    spark = reps.sparkSession
    order = (F.xxhash64("rep", F.lit(SEED)), "rep")
    some = reps.orderBy(*order).limit(AUDIT).select("rep", "sketch").collect()
    linked = likely.select("rep").distinct().orderBy(*order).limit(AUDIT).join(reps, "rep").select("rep", "sketch").collect()
    held = spark.sparkContext.broadcast(sorted({r.rep: bytes(r.sketch) for r in (*some, *linked)}.items()))
    least = (threshold - 5 * math.sqrt(threshold * (1 - threshold) / SKETCH)) * SKETCH

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = np.array([i for i, _ in held.value], np.int64)
        asked = np.frombuffer(b"".join(s for _, s in held.value), np.uint32).reshape(-1, SKETCH)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for batch in batches:
            own = batch.column(0).to_numpy()
            values = np.ascontiguousarray(np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, SKETCH).T)
            for k in range(len(ids)):
                alike = np.zeros(len(own), np.uint8)
                for c in range(16):  # few go on to the other coordinates
                    alike += values[c] == asked[k, c]
                at = np.flatnonzero(alike >= least / SKETCH * 16 - 8)
                at = at[(values[:, at] == asked[k][:, None]).sum(0) >= least]
                at = at[own[at] != ids[k]]
                turn = mix(own[at].view(np.uint64) ^ ids[k : k + 1].view(np.uint64)) >> np.uint64(1)
                best = np.argsort(turn)[:AUDIT_PARTNERS]
                found.append((np.full(len(best), ids[k]), own[at[best]], turn[best].astype(np.int64)))
            if sum(len(f[0]) for f in found) > 100_000:
                yield from _audit_batch(found)
                found = []
        yield from _audit_batch(found)

    pairs = reps.select("rep", "sketch").mapInArrow(run, "a long, b long, turn long")
    first = Window.partitionBy("a").orderBy("turn", "b")
    return pairs.withColumn("n", F.row_number().over(first)).where(F.col("n") <= AUDIT_PARTNERS).select("a", "b")


def _audit_batch(found: list[tuple]) -> Iterator[pa.RecordBatch]:
    if found:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([f[k] for f in found])) for k in range(3)], names=["a", "b", "turn"])


def audited_recall(audit: DataFrame, sets: DataFrame, leaves: DataFrame, threshold: float) -> float:
    """Of the sampled pairs that are similar by their whole sets, the share that meets in a leaf; 1 if none is similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = ([np.frombuffer(s, np.uint64) for s in batch.column(k).to_pylist()] for k in (2, 3))
            shared = [len(np.intersect1d(x, y, assume_unique=True)) for x, y in zip(left, right, strict=True)]
            near = [s * 1e6 >= round(threshold * 1e6) * (len(x) + len(y) - s) for s, x, y in zip(shared, left, right, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(near, pa.bool_())], names=["a", "b", "near"])

    whole = audit.join(sets.select(F.col("rep").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("rep").alias("b"), F.col("hashes").alias("y")), "b")
    near = whole.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, near boolean").where("near").select("a", "b")
    asked = audit.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    own = leaves.join(asked, "rep").select("rep", "node")
    met = near.join(own.withColumnRenamed("rep", "a"), "a").join(own.withColumnRenamed("rep", "b"), ["b", "node"]).select("a", "b").distinct()
    all_ = near.count()
    return met.count() / all_ if all_ else 1.0


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, target_recall: float = TARGET_RECALL) -> DataFrame:
    """doc_id, class_id, class_size, n_links, component_id, kept."""
    known = cut(_sketches(docs), "sketches")
    named = known.where("doc_id is not null and n > 0")
    # equal sets have equal sketches
    classes = named.groupBy("key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size"), F.first("sketch").alias("sketch"))
    classes = cut(classes, "classes")
    reps = classes.select("rep", "size", "sketch")
    need = runs_needed(threshold, target_recall)
    leaves = cut(_leaves(reps, range(need)), "leaves")
    for turn in range(1, MAX_TURNS + 1):
        likely = _dealt(_members(leaves, reps)).mapInArrow(_likely(threshold), _MEMBER)
        likely = cut(likely, "likely")
        audit = cut(_audit_pairs(reps, likely, threshold), "audit")
        asked = audit.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
        sets = cut(_sets_of(docs, likely.select("rep").unionByName(asked)).dropDuplicates(["rep"]), "sets")
        if audited_recall(audit, sets, leaves, threshold) >= AUDIT_RECALL:
            break
        if turn == MAX_TURNS:
            raise RuntimeError(f"{need * turn} runs of paths miss more than {1 - AUDIT_RECALL} of the sampled pairs")
        leaves = cut(leaves.unionByName(_leaves(reps, range(need * turn, need * (turn + 1)))), "leaves")
    pairs = _dealt(likely.join(sets, "rep"))
    links = cut(pairs.mapInArrow(_linked(threshold), "rep long, links long, root long"), "links")
    joined = components(links.select(F.col("rep").alias("u"), F.col("root").alias("v")))
    counts = links.groupBy("rep").agg(F.sum("links").alias("links"))
    of_class = classes.select("key", "rep", "size").join(counts, "rep", "left").join(joined.withColumnRenamed("node", "rep"), "rep", "left")
    rows = known.select("doc_id", "key").join(of_class, "key", "left")
    class_id = F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    n_links = F.when(F.col("doc_id").isNull(), 0).otherwise(F.coalesce(F.col("size") - 1, F.lit(0)) + F.coalesce("links", F.lit(0)))
    return rows.select(
        "doc_id", class_id.alias("class_id"), F.coalesce("size", F.lit(1)).alias("class_size"), n_links.cast("long").alias("n_links"),
        component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(False)).alias("kept"),
    )


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, all columns, of which each component keeps the one with the least doc_id; null ids stay."""
    gone = jaccard_join(docs, threshold).where("doc_id is not null and not kept").select("doc_id").distinct()
    return docs.join(gone, docs["doc_id"].cast("long") == gone["doc_id"], "left_anti")
