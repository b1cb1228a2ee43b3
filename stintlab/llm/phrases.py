"""Phrase collocations by pivot partitioning.

Every phrase belongs to its pivot, the rarest of its words. The words of all texts are counted first. Then each
place of a text sends its word's partition a fragment: the word with up to three neighbours on either side, as far as they
are more frequent (words alike count by the leftmost). A fragment holds all phrases whose pivot stands there and nothing
of those whose pivot is another place, so each occurrence is counted once. Equal fragments of a stretch of text go as
one with a count. A partition forms the phrases of its pivots, counts them and lets go what is below the least
frequency, which no other partition can add to.

The order of words must be the same in all tasks, not exact: it is that of a table of 2^22 slots with the counts of the
frequent words that hash there, then of the word itself. The table has one size whatever the corpus. A word whose slot is
empty is rare for certain and ends fragments; one that shares a slot with frequent words is merely counted in vain. A
pivot with more than ``PIVOT_ROWS`` occurrences is dealt out over several partitions, whose counts are added up.

Scores, parts and containment are joins on the counts of the frequent phrases. A part or longer phrase of a frequent
phrase is found by its own words, so nothing is gathered by language.

Null or empty texts have no words; a null language counts as ``und``. Repeated rows and ids count as often as they
stand. Long texts are cut at the ends of pieces. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stintlab.llm.common import cut, groups, slices, spans

LEAST, LONGEST, TOP = 30, 4, 2000
#: Of two nested phrases the shorter goes where the longer has this share of its occurrences, in hundredths.
CONTAINED, SCALE = 80, 2_000_000
SLOTS, PIVOT_ROWS = 1 << 22, 1 << 18
#: Bytes of text that are cut into words at once, of fragments that are mined at once.
CHUNK_BYTES, MINED_BYTES = 12_000_000, 3_000_000

_KIND = np.zeros(256, np.uint8)
_KIND[list(b" \t")] = 1
_KIND[list(b".,;:!?\n\x0b\x0c\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, pa.Array]]:
    """The texts of each language of a batch of (lang, text)."""
    encoded = pc.fill_null(batch.column(0), "und").dictionary_encode()
    of, texts = encoded.indices.to_numpy(), pc.fill_null(batch.column(1), "")
    for k, lang in enumerate(encoded.dictionary.to_pylist()):
        yield lang, texts.take(pa.array(np.flatnonzero(of == k)))


def chunks(texts: pa.Array, most: int = CHUNK_BYTES) -> Iterator[np.ndarray]:
    """The texts' bytes in lower case with a piece's end between texts, in parts that end where a piece does."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "\n")[0]
    data = _LOWER[np.frombuffer(joined.as_buffer() or b"", np.uint8)]
    start = 0
    while start < len(data):
        end = start + most
        if end < len(data):
            ends = np.flatnonzero(_KIND[data[start:end]] == 2)
            if len(ends):
                end = start + int(ends[-1]) + 1
            while not len(ends) and end < len(data):  # one piece longer than a part
                ends = np.flatnonzero(_KIND[data[end : end + most]] == 2)
                end = end + int(ends[0]) + 1 if len(ends) else end + most
        yield data[start:end]
        start = end


def words_of(data: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Numbers of a chunk's words in order, the distinct words, and whether each word's piece goes on with the next."""
    kind = _KIND[data]
    inside = kind == 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.int32), pa.array([], pa.string()), np.zeros(0, bool)
    offsets = np.cumsum(inside, dtype=np.int32)[at] - 1
    offsets = np.append(offsets, np.int32(inside.sum())).astype(np.int32)
    column = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    encoded = column.dictionary_encode()
    piece = np.cumsum(kind == 2, dtype=np.int32)[at]
    return encoded.indices.to_numpy(), encoded.dictionary, np.append(piece[1:] == piece[:-1], False)


def _texts(docs: DataFrame, lang_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))


def word_counts(docs: DataFrame, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, word, f) of all words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, CHUNK_BYTES):
                for lang, texts in by_language(part):
                    for data in chunks(texts):
                        codes, vocabulary, _ = words_of(data)
                        f = np.bincount(codes, minlength=len(vocabulary))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([lang] * len(f), pa.string()), vocabulary, pa.array(f, pa.int64())], names=["lang", "word", "f"]
                        )

    counted = _texts(docs, lang_col, text_col).mapInArrow(run, "lang string, word string, f long")
    return counted.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def slot_counts(frequent: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Occurrences of the frequent words by slot: at most ``slots`` rows reach the driver, whatever the corpus."""
    slot = F.crc32(F.concat_ws("\t", "lang", "word").cast("binary")) % slots
    rows = frequent.groupBy(slot.cast("int").alias("slot")).agg(F.sum("f").alias("f")).toArrow()
    table = np.zeros(slots, np.uint32)
    table[rows["slot"].to_numpy()] = np.minimum(rows["f"].to_numpy(), 2**32 - 1)
    return table


def _ranks(lang: str, vocabulary: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of a chunk's words in the order of all words, rarest first, -1 for the certainly rare; and slot counts."""
    words, prefix = vocabulary.cast(pa.binary()).to_pylist(), lang.encode() + b"\t"
    counts = table[np.fromiter((zlib.crc32(prefix + w) % len(table) for w in words), np.int64, len(words))]
    known = np.flatnonzero(counts)
    order = sorted(known.tolist(), key=lambda i: (counts[i], words[i]))
    rank = np.full(len(words), -1, np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    return rank, counts


def _fragments(codes: np.ndarray, goes_on: np.ndarray, rank: np.ndarray) -> pa.Table:
    """Distinct fragments of a chunk: word numbers a3 a2 a1 p b1 b2 b3, null where they end, and how often each stands."""
    r, n = rank[codes], len(codes)
    side: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for way, name in ((-1, "a"), (1, "b")):
        held = r >= 0
        for k in range(1, LONGEST):
            here = np.zeros(n, bool)
            if k < n:
                mine, other = (slice(k, None), slice(None, -k)) if way < 0 else (slice(None, -k), slice(k, None))
                step = goes_on[: n - k] if way < 0 else goes_on[k - 1 : n - 1]
                here[mine] = held[mine] & step & ((r[other] > r[mine]) if way < 0 else (r[other] >= r[mine]))
            held = here
            side[f"{name}{k}"] = (here, np.roll(codes, -way * k))
    at = np.flatnonzero(side["a1"][0] | side["b1"][0])
    names = ["a3", "a2", "a1", "p", "b1", "b2", "b3"]
    columns = [pa.array(codes[at]) if m == "p" else pa.array(side[m][1][at], mask=~side[m][0][at]) for m in names]
    return pa.table(columns, names=names).group_by(names, use_threads=False).aggregate([([], "count_all")])


def fragments(docs: DataFrame, table, lang_col: str = "lang", text_col: str = "text", pivot_rows: int = PIVOT_ROWS) -> DataFrame:
    """Fragments by pivot: (lang, pivot, part, parts, body), body a line for each with its left words, right words and
    count between tabs. ``table`` is a broadcast of :func:`slot_counts`."""
    schema = "lang string, pivot string, part int, parts int, body string"
    names = ["lang", "pivot", "part", "parts", "body"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in slices(batch, 1, CHUNK_BYTES):
                for lang, texts in by_language(piece):
                    for data in chunks(texts):
                        codes, vocabulary, goes_on = words_of(data)
                        rank, counts = _ranks(lang, vocabulary, table.value)
                        found = _fragments(codes, goes_on, rank)
                        if not found.num_rows:
                            continue
                        found = found.take(pa.array(np.argsort(found["p"].to_numpy(), kind="stable"))).combine_chunks()
                        said = {m: vocabulary.take(found[m].combine_chunks()) for m in ("a3", "a2", "a1", "b1", "b2", "b3")}
                        none = pa.array([""] * found.num_rows)  # a side begins with a space, so that none is null
                        left = pc.binary_join_element_wise(none, said["a3"], said["a2"], said["a1"], " ", null_handling="skip")
                        right = pc.binary_join_element_wise(none, said["b1"], said["b2"], said["b3"], " ", null_handling="skip")
                        lines = pc.binary_join_element_wise(left, right, found["count_all"].combine_chunks().cast(pa.string()), "\t")
                        p = found["p"].to_numpy()
                        edges = np.concatenate(([0], np.flatnonzero(np.diff(p)) + 1, [len(p)])).astype(np.int32)
                        body = pc.binary_join(pa.ListArray.from_arrays(pa.array(edges), lines), "\n")
                        pivots = p[edges[:-1]]
                        parts = -(-counts[pivots].astype(np.int64) // pivot_rows)
                        # a hot pivot's part depends on what it holds, so that a task run again deals alike
                        salt = zlib.crc32(data.tobytes()) % parts
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([lang] * len(pivots), pa.string()),
                                vocabulary.take(pa.array(pivots)),
                                pa.array(salt, pa.int32()),
                                pa.array(parts, pa.int32()),
                                body,
                            ],
                            names=names,
                        )

    return _texts(docs, lang_col, text_col).mapInArrow(run, schema)


def _mined(table: pa.Table, least: int) -> pa.RecordBatch:
    """Phrases of whole groups of fragments and their counts, without the rare ones of undivided pivots."""
    lines = pc.split_pattern(table["body"].combine_chunks(), "\n")
    of = pc.list_parent_indices(lines).to_numpy()
    fields = pc.split_pattern(lines.flatten(), "\t").flatten()
    n = fields[2::3].cast(pa.int64()).to_numpy()
    sides = [pc.split_pattern(fields[k::3], " ") for k in (0, 1)]
    every = pa.chunked_array([table["pivot"].combine_chunks(), *(s.flatten() for s in sides)]).combine_chunks().dictionary_encode()
    codes, vocabulary = every.indices.to_numpy(), every.dictionary
    m, count = table.num_rows, len(of)
    around = np.full((count, 2 * LONGEST - 1), -1, np.int32)
    around[:, LONGEST - 1] = codes[:m][of]
    start = m
    for k, side in enumerate(sides):
        edges = side.offsets.to_numpy().astype(np.int64)
        edges = edges - edges[0]
        own, start = codes[start : start + edges[-1]], start + int(edges[-1])
        for j in range(1, LONGEST):
            has = np.flatnonzero(np.diff(edges) > j)
            around[has, LONGEST - 1 + (j if k else -j)] = own[edges[:-1][has] + j] if k else own[edges[1:][has] - j]
    encoded = table["lang"].combine_chunks().dictionary_encode()
    lang = encoded.indices.to_numpy()[of]
    whole = (table["parts"].to_numpy() == 1)[of]
    rows: list[list[np.ndarray]] = [[] for _ in range(LONGEST + 3)]
    for a in range(LONGEST):
        for b in range(max(1 - a, 0), LONGEST - a):
            span = around[:, LONGEST - 1 - a : LONGEST + b]
            has = np.flatnonzero((span[:, 0] >= 0) & (span[:, -1] >= 0))
            for j in range(LONGEST):
                rows[j].append(span[has, j] if j <= a + b else np.full(len(has), -1, np.int32))
            for j, column in enumerate((lang, whole, n)):
                rows[LONGEST + j].append(column[has])
    names = [*(f"w{j}" for j in range(LONGEST)), "lang", "whole", "n"]
    counted = pa.table([np.concatenate(r) for r in rows], names=names).group_by(names[:-1], use_threads=False).aggregate([("n", "sum")])
    counted = counted.filter(pa.array((counted["n_sum"].to_numpy() >= least) | ~counted["whole"].to_numpy()))
    said = []
    for j in range(LONGEST):
        c = counted[f"w{j}"].to_numpy()
        said.append(vocabulary.take(pa.array(c, mask=c < 0)))
    phrase = pc.binary_join_element_wise(*said, " ", null_handling="skip")
    size = sum((counted[f"w{j}"].to_numpy() >= 0).astype(np.int32) for j in range(LONGEST))
    lang = encoded.dictionary.take(counted["lang"].combine_chunks())
    return pa.RecordBatch.from_arrays([lang, phrase, pa.array(size), counted["n_sum"].combine_chunks()], names=["lang", "phrase", "size", "n"])


def mine(dealt: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, phrase, size, a) of all phrases of two words and more that stand ``least`` times, from fragments."""
    keyed = dealt.withColumn("key", F.xxhash64("lang", "pivot", "part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, "key"):
            sizes = np.cumsum(pc.binary_length(table["body"]).to_numpy(), dtype=np.int64)
            start = done = 0
            for _, end in spans(table, "key"):
                if sizes[end - 1] - done >= MINED_BYTES or end == table.num_rows:
                    yield _mined(table.slice(start, end - start), least)
                    start, done = end, sizes[end - 1]

    mined = keyed.repartition("key").sortWithinPartitions("key").mapInArrow(run, "lang string, phrase string, size int, n long")
    return mined.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a")).where(F.col("a") >= least)


def _exact(c) -> F.Column:
    return F.col(c).cast("decimal(20,0)")


def scored(grams: DataFrame, parts: DataFrame) -> DataFrame:
    """Each phrase of ``grams`` (lang, phrase, size, a) with the parts l and r of its lowest-scoring cut and the score;
    ``parts`` (lang, part, f) has the counts of all shorter phrases and words."""
    cuts = grams.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({
        "first": F.expr("substring_index(phrase, ' ', k)"),
        "rest": F.expr("substring_index(phrase, ' ', k - size)"),
    })
    for side, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(parts.select("lang", F.col("part").alias(side), F.col("f").alias(name)), ["lang", side])
    cuts = cuts.withColumns({"a_": _exact("a"), "l_": _exact("l"), "r_": _exact("r")})
    cuts = cuts.withColumn("score", F.expr(f"a_ * {SCALE} div (l_ + r_)"))
    worst = F.min(F.struct("score", "k", "l", "r")).alias("w")
    return cuts.groupBy("lang", "phrase", "size", "a").agg(worst).select("lang", "phrase", "size", "a", "w.l", "w.r", "w.score")


def contained(grams: DataFrame) -> DataFrame:
    """(lang, phrase, longer): the greatest count of a phrase that has it inside."""
    inner = F.expr(
        "flatten(transform(sequence(2, size - 1), m -> transform(sequence(1, size - m + 1), i -> array_join(slice(split(phrase, ' '), i, m), ' '))))"
    )
    longer = grams.where("size > 2").select("lang", "a", F.explode(inner).alias("phrase"))
    return longer.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, top: int = TOP) -> DataFrame:
    """Each language's first ``top`` phrases of two to four words: lang, rank, phrase, a, l, r, n, score. Words stand
    between blanks and tabs, A-Z in lower case; a phrase never crosses a mark of punctuation or the end of a line.

    A phrase's score is that of its weakest cut into a first part and a rest, floor(2,000,000 a / (l + r)). A phrase
    inside a longer one that has four fifths of its occurrences isn't returned.
    """
    spark = docs.sparkSession
    words = cut(word_counts(docs, lang_col, text_col), "words")
    frequent = words.where(F.col("f") >= least)
    table = spark.sparkContext.broadcast(slot_counts(frequent))
    grams = cut(mine(fragments(docs, table, lang_col, text_col), least), "phrases")
    parts = frequent.select("lang", F.col("word").alias("part"), "f").unionByName(grams.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    inside = F.lit(100) * _exact("longer") >= F.lit(CONTAINED) * _exact("a")
    left = scored(grams, parts).join(contained(grams), ["lang", "phrase"], "left").where(F.coalesce(~inside, F.lit(True)))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).join(totals, "lang")
    return ranked.select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")
