"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

A word is a maximal run of ASCII letters, digits and non-ASCII characters, with A-Z lower-cased. A window is
ten consecutive words of an item, or the whole item if it has fewer. A window
occurs in a text if it is a run of the text's words, and offsets in the original follow from its words' places.

Null texts and texts without words hit nothing, items without words match nothing, and repeated items count by
their distinct ids; those without an id hit too, count as one and aren't listed. Rows that share a doc_id, have
none or repeat are told apart. An empty benchmark leaves every document clean.

The automaton reads words, not bytes: a text's words become the numbers that the benchmark's words have, which makes
about ten states of a word of an item. It is broadcast by part: each part has up to ``PART_WORDS`` words of items,
so a worker's automaton has a fixed bound whatever the benchmark's size, and every part passes over each text once.
A document's hits in several parts meet by a number of its row.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlab.llm.common import cut, id_text, kept, slices

WINDOW = 10
#: Words of items in one automaton, some 200 MB in a worker.
PART_WORDS = 200_000

#: Byte to byte: lower case for A-Z, space for what isn't in a word. All bytes of non-ASCII characters stay.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)

OUT = (
    "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, "
    "items array<long>, spans array<struct<start:long,end:long>>"
)


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[bytes]:
    if not words:
        return set()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))}


class Automaton:
    """One part's automaton over word numbers; each window carries its number of words and its items' ids."""

    def __init__(self, items: list[tuple[int | None, str]], size: int = WINDOW):
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        found: dict[tuple[int, ...], set[int | None]] = {}
        for item, text in items:
            own = [self.numbers.setdefault(w, len(self.numbers) + 1) for w in words_of(text)]
            for i in range(max(1, len(own) - size + 1)) if own else ():
                found.setdefault(tuple(own[i : i + size]), set()).add(item)
        self.tree = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for window, ids in found.items():
            self.tree.add_word(window, (len(window), tuple(ids)))
        if found:
            self.tree.make_automaton()

    def scan(self, text: str | None) -> tuple[int, np.ndarray, list[int | None]]:
        """Of a text: its number of words, the hit words' numbers, the ids of the items with occurring windows."""
        words = words_of(text)
        if not words or not len(self.tree):
            return len(words), np.empty(0, np.int64), []
        get = self.numbers.get
        items: set[int | None] = set()
        ends, lengths = [], []
        # 0 is no word of an item, so no window goes past it
        for end, (n, ids) in self.tree.iter(tuple([get(w, 0) for w in words])):
            ends.append(end)
            lengths.append(n)
            items.update(ids)
        if not ends:
            return len(words), np.empty(0, np.int64), []
        last = np.asarray(ends) + 1
        marks = np.zeros(len(words) + 1, np.int64)
        np.add.at(marks, last - np.asarray(lengths), 1)
        np.add.at(marks, last, -1)
        return len(words), np.flatnonzero(np.cumsum(marks[:-1]) > 0), list(items)


def char_spans(text: str, hit: np.ndarray) -> list[dict]:
    """Code-point ranges of the original text that runs of hit words cover."""
    raw = text.encode("utf-8", "surrogatepass")
    inside = np.frombuffer(raw.translate(_FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    breaks = np.flatnonzero(np.diff(hit) > 1)
    first, last = hit[np.concatenate(([0], breaks + 1))], hit[np.concatenate((breaks, [len(hit) - 1]))]
    # characters before a byte offset: bytes that don't continue a character
    before = np.concatenate(([0], np.cumsum((np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
    return [{"start": int(before[starts[a]]), "end": int(before[ends[b]])} for a, b in zip(first, last, strict=True)]


def _digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def _row(text: str | None, n_words: int, hit: np.ndarray, items: list[int | None]) -> tuple:
    named = sorted(i for i in items if i is not None)
    return n_words, len(hit), len(items), _digest(named), len(hit) > 0, named, char_spans(text, hit) if len(hit) else []


def parts_of(benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> list:
    """Broadcasts of the items, a list of (id, words) for each part. The driver holds one part at a time; a long item
    is cut so that each of its windows lies whole in one piece."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    context, step = benchmark.sparkSession.sparkContext, max(part_words, window)
    out, held, total = [], [], 0
    for r in items.where("text is not null").toLocalIterator():
        words = words_of(r.text)
        for i in range(0, max(1, len(words) - window + 1), step):
            piece = words[i : i + step + window - 1]
            if held and total + len(piece) > part_words:
                out.append(context.broadcast(held))
                held, total = [], 0
            held.append((r.item_id, b" ".join(piece).decode("utf-8", "surrogatepass")))
            total += len(piece)
    return [*out, context.broadcast(held)] if held or not out else out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """One row a document: word and hit counts, the items found and the hit character ranges."""
    parts = parts_of(benchmark, window, part_words)
    if len(parts) > 1:
        return _by_parts(docs, parts, window)
    scan = _scanner(parts[0], window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = scan()
        for batch in batches:
            for part in slices(batch):
                yield _batch(part.column(0), [_row(t, *automaton.scan(t)) for t in part.column(1).to_pylist()])

    return id_text(docs).mapInArrow(run, OUT)


def _scanner(held, window: int):
    """Gives a worker's automaton of a part, which stays from task to task."""
    name = uuid.uuid4().hex
    return lambda: kept(name, lambda: Automaton(held.value, window))


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, part_words: int = PART_WORDS) -> DataFrame:
    """The documents, all columns, without those that hold a window of an item."""
    at = docs.columns.index("text")
    clean = docs.select(*(F.col(f"`{c}`") for c in docs.columns))
    for k, held in enumerate(parts_of(benchmark, window, part_words)):
        if k:  # a task holds one automaton at a time
            clean = cut(clean, "clean")
        scan = _scanner(held, window)

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            automaton = scan()
            for batch in batches:
                for part in slices(batch, at):
                    yield part.filter(pa.array([not len(automaton.scan(t)[1]) for t in part.column(at).to_pylist()], pa.bool_()))

        clean = clean.mapInArrow(run, docs.schema)
    return clean


_TYPES = [
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()),
    ("contaminated", pa.bool_()), ("items", pa.list_(pa.int64())),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
]


def _batch(ids: pa.Array, rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * len(_TYPES)
    return pa.RecordBatch.from_arrays(
        [ids, *(pa.array(list(c), t) for c, (_, t) in zip(columns, _TYPES, strict=True))],
        names=["doc_id", *(n for n, _ in _TYPES)],
    )


def _by_parts(docs: DataFrame, parts: list, window: int) -> DataFrame:
    """The same rows from several parts: each gives hit ranges and items of the rows with hits, never their texts."""
    # ids may be null or shared, so rows have numbers of their own; written, since the numbers follow the partitions
    rows = cut(id_text(docs).withColumn("row", F.monotonically_increasing_id()), "numbered")
    schema = "row long, hits array<struct<a:long,z:long>>, items array<struct<id:long>>"
    found = None
    for held in parts:
        scan = _scanner(held, window)

        def run(batches: Iterator[pa.RecordBatch], scan=scan) -> Iterator[pa.RecordBatch]:
            automaton = scan()
            for batch in batches:
                for part in slices(batch):
                    out = []
                    for row, text in zip(part.column(2).to_pylist(), part.column(1).to_pylist(), strict=True):
                        _, hit, items = automaton.scan(text)
                        if len(hit):
                            breaks = np.flatnonzero(np.diff(hit) > 1)
                            first, last = hit[np.concatenate(([0], breaks + 1))], hit[np.concatenate((breaks, [len(hit) - 1]))]
                            ranges = [{"a": a, "z": z + 1} for a, z in zip(first.tolist(), last.tolist(), strict=True)]
                            out.append({"row": row, "hits": ranges, "items": [{"id": i} for i in items]})
                    yield pa.RecordBatch.from_pylist(out, schema=_FOUND)

        own = rows.mapInArrow(run, schema)
        found = own if found is None else found.unionByName(own)
    # a row a document and part at most
    told = found.groupBy("row").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))

    def finish(batches):
        for batch in batches:
            for part in slices(batch):
                out = []
                for text, hits, items in zip(*(part.column(k).to_pylist() for k in (1, 2, 3)), strict=True):
                    mark = np.zeros(len(words_of(text)), bool)
                    for x in hits or ():
                        mark[x["a"] : x["z"]] = True
                    out.append(_row(text, len(mark), np.flatnonzero(mark), [x["id"] for x in items or ()]))
                yield _batch(part.column(0), out)

    return rows.join(told, "row", "left").select("doc_id", "text", "hits", "items").mapInArrow(finish, OUT)


_FOUND = pa.schema([
    ("row", pa.int64()), ("hits", pa.list_(pa.struct([("a", pa.int64()), ("z", pa.int64())]))), ("items", pa.list_(pa.struct([("id", pa.int64())]))),
])
