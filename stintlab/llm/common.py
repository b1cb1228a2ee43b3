"""What the text operators share: Arrow maps over documents, shared folders, crc splits."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stintlab.operators.written import shared_folder
from stintlab.operators.written import written as cut  # noqa: F401  ends lineage

#: Characters of text that a task turns into results at once.
SLICE_CHARS = 4_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns as ``doc_id`` and ``text``; whatever else the table has is dropped."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def slices(batch: pa.RecordBatch, text_index: int = 1, most: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``most`` bytes of text each, one row at least."""
    column = batch.column(text_index)
    sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += size
    if start < len(sizes):
        yield batch.slice(start)


def map_texts(
    docs: DataFrame, make: Callable[[], Callable[[list], Sequence[list]]], columns: Sequence[tuple[str, pa.DataType, str]]
) -> DataFrame:
    """``doc_id`` and one value a document for each of ``columns`` (name, Arrow type, Spark type).

    ``make`` runs once a task and gives the function from a list of texts (None for null) to lists of values.
    """
    types = [t for _, t, _ in columns]
    names = ["doc_id", *(n for n, _, _ in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            for part in slices(batch):
                out = fn(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *(pa.array(v, t) for v, t in zip(out, types, strict=True))], names=names
                )

    schema = "doc_id long, " + ", ".join(f"{n} {s}" for n, _, s in columns)
    return id_text(docs).mapInArrow(run, schema)


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of the rows between changes of ``key``, which the rows are sorted by; each has whole groups, many where
    they are small."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(batch.schema.get_field_index(key)).to_numpy()
        last = int(np.searchsorted(k, k[-1])) if k[0] != k[-1] else 0
        if held and held[-1].column(batch.schema.get_field_index(key))[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def spans(table: pa.Table, key: str) -> Iterator[tuple[int, int]]:
    """Where each group of such a table begins and ends."""
    k = table[key].to_numpy()
    edges = np.flatnonzero(np.diff(k)) + 1
    yield from zip(np.concatenate(([0], edges)).tolist(), np.concatenate((edges, [len(k)])).tolist(), strict=True)


_KEPT: dict = {}


def kept(key, make: Callable[[], object]):
    """What ``make`` gave for ``key`` in this worker. A worker holds one such object: asking for another drops it, so
    that one operator's tables don't lie beside the next one's. Key None only drops."""
    if key not in _KEPT:
        _KEPT.clear()
        if key is None:
            return None
        _KEPT[key] = make()
    return _KEPT[key]


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as decimal text, modulo n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % n


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder's URI below spark.checkpoint.dir, which all executors see. Where that is unset, a session on one machine
    gets a folder of its own and a cluster an error."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
