"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's score is the logistic of a bias and its words' weights; a document's is the noisy-or of its
sentences', one minus the product of their complements. Weights are trained from documents' labels alone, so
that the sentences which explain a label get the blame; those that score half or more are located, by the same cuts.

The training sample is bounded, ``MAX_A_CLASS`` documents and ``MAX_BYTES`` bytes of text of each label, the first that
fit in the order of a hash of their ids, and weighted back to the labels' true shares. A null or empty text is one
sentence without words. Documents that have several labels count as toxic if any says so. Repeated document rows are
scored each, and learned from each; equal scores need no order. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintlab.llm.common import crc_mod, cut, id_text, kept, map_texts, slices

MAX_A_CLASS, MAX_BYTES = 3000, 24 << 20
MIN_DOCS, STEPS, RATE, DECAY = 3, 150, 0.2, 1e-6
PREFIXES = (3, 4, 5, 6)
_MAX_MEMO = 300_000
_EDGE = re.compile(r"^\W+|\W+$")
#: What :func:`raw_words` cuts a text into, in place: a line's end counts as a word.
_PIECE = re.compile(r"\n|\S+")
#: Weights are kept as whole multiples of this, with the lowest bit marking the end of a sentence.
UNIT = 1e-6


def features(word: str) -> list[str]:
    """What a word is known by: itself and its beginnings, which tell inflected and compound forms."""
    return [word, *(f"{word[:n]}-" for n in PREFIXES if len(word) > n)]


def normal(raw: str) -> tuple[str, bool]:
    """A raw word without its outer punctuation, and whether a sentence ends with it."""
    return _EDGE.sub("", raw), raw.endswith((".", "!", "?"))


class _Weights(dict):
    """From a raw word to the sum of its features' weights, in UNITs and times two, plus one at a sentence's end."""

    def __init__(self, weights: dict[str, int]):
        super().__init__()
        self.weights = weights

    def __missing__(self, raw: str) -> int:
        word, end = normal(raw)
        value = sum(self.weights.get(f, 0) for f in features(word)) * 2 + end if word else int(end)
        if len(self) > _MAX_MEMO:
            self.clear()
        self[raw] = value
        return value


def raw_words(text: str | None) -> list[str]:
    return (text or "").lower().replace("\n", " . ").split()


def _bags(values: np.ndarray) -> np.ndarray:
    """The number of each word's sentence."""
    ends = values & 1
    return np.cumsum(ends) - ends


class Model:
    def __init__(self, bias: float, weights: dict[str, int]):
        self.bias, self.weights = bias, weights

    def bags(self):
        """The function from a text to its sentences' log odds and the number of each raw word's sentence."""
        table, bias = _Weights(self.weights), self.bias

        def of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
            words = raw_words(text)
            if not words:
                return np.array([bias]), np.empty(0, np.int64)
            values = np.fromiter(map(table.__getitem__, words), np.int64, len(words))
            bag = _bags(values)
            return bias + np.bincount(bag, (values >> 1) * UNIT), bag

        return of


def noisy_or(z: np.ndarray) -> float:
    """One minus the product of the sentences' complements."""
    return float(-np.expm1(-np.logaddexp(0, z).sum()))


def located(text: str | None, z: np.ndarray, bag: np.ndarray, least: float = 0.0) -> list[tuple[int, int, float]]:
    """The sentences with log odds of ``least`` or more: their character ranges and scores."""
    which = np.flatnonzero(z >= least)
    if not len(which) or not len(bag):
        return []
    places = [m.span() for m in _PIECE.finditer(text)]  # one for each raw word
    out = []
    # words are in the order of their sentences
    first, end = (np.searchsorted(bag, which, side).tolist() for side in ("left", "right"))
    for k, i, j in zip(which.tolist(), first, end, strict=True):
        own = [p for p in places[i:j] if text[p[0]] != "\n"]
        if own:
            out.append((own[0][0], own[-1][1], float(1 / (1 + np.exp(-z[k])))))
    return out


def fit(words: pa.ListArray, ends: pa.ListArray, labels: np.ndarray, weight: np.ndarray, steps: int = STEPS) -> Model:
    """Trains on documents' words, and which of them end sentences, by Adam on the noisy-or's weighted log loss.

    A gradient reaches a feature by way of the distinct words, so a step costs one pass over the words' places.
    """
    if not len(labels) or labels.min() == labels.max():
        return Model(-20.0 if not len(labels) or not labels.max() else 20.0, {})
    known = pc.list_value_length(words).to_numpy()
    sizes = np.maximum(known, 1)
    starts = np.cumsum(sizes) - sizes
    there = np.arange(known.sum()) + np.repeat(starts - (np.cumsum(known) - known), known)
    coded = words.flatten().dictionary_encode()
    number = ["", *coded.dictionary.to_pylist()]
    place = np.zeros(sizes.sum(), np.int64)
    place[there] = coded.indices.to_numpy() + 1
    end = np.zeros(sizes.sum(), np.int64)
    end[there] = ends.flatten().to_numpy(zero_copy_only=False)
    end[starts + sizes - 1] = 1
    sentence = np.cumsum(end) - end
    n = int(sentence[-1]) + 1
    doc = np.repeat(np.arange(len(labels)), sizes)
    owner = np.zeros(n, np.int64)
    owner[sentence] = doc
    seen = np.bincount(np.unique(place * len(labels) + doc) // len(labels), minlength=len(number))
    del coded, there, doc, end
    keys: dict[str, int] = {}
    of_word, column = array("q"), array("q")
    for i, word in enumerate(number):
        for f in features(word) if word else ():
            of_word.append(i)
            column.append(keys.setdefault(f, len(keys)))
    of_word, column = np.array(of_word), np.array(column)
    common = np.bincount(column, seen[of_word], len(keys)) >= MIN_DOCS
    of_word, column = of_word[common[column]], column[common[column]]
    column = (np.cumsum(common) - 1)[column]
    size = int(common.sum())
    w, b = np.zeros(size), -4.0
    m = v = np.zeros(size + 1)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        by_word = np.bincount(of_word, w[column], len(number))
        z = b + np.bincount(sentence, by_word[place], n)
        p = np.exp(-np.logaddexp(0, -z))
        clean = np.exp(-np.bincount(owner, np.logaddexp(0, z), len(labels)))
        up = np.where(labels == 1, -clean / np.maximum(1 - clean, 1e-12), 1.0) * weight
        g = p * up[owner]
        blame = np.bincount(place, g[sentence], len(number))
        gradient = np.append(np.bincount(column, blame[of_word], size) + DECAY * w, g.sum())
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        move = RATE * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, b = w - move[:-1], b - move[-1]
    kept = [f for f, c in zip(keys, common.tolist(), strict=True) if c]
    units = np.rint(w / UNIT).astype(np.int64).tolist()
    return Model(float(b), {f: x for f, x in zip(kept, units, strict=True) if x})


def train(docs: DataFrame, labels: DataFrame, max_a_class: int = MAX_A_CLASS, max_bytes: int = MAX_BYTES) -> Model:
    """A model from the labelled documents whose crc32 modulo 5 isn't 0, at most ``max_a_class`` of each label
    and ``max_bytes`` of their text."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    told = told.where("doc_id is not null and toxic in (0, 1)").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    told = told.where(crc_mod("doc_id", 5) != 0)
    totals = {r.toxic: r["count"] for r in told.groupBy("toxic").count().collect()}

    def first(k: int) -> DataFrame:
        return told.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_a_class)

    # at most twice max_a_class ids, here and as rows of sizes
    ids = cut(first(0).unionByName(first(1)), "labelled")
    sizes = id_text(docs).join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    fit_in, left = [], {0: max_bytes, 1: max_bytes}
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id").toLocalIterator():
        if r.bytes <= left[r.toxic]:
            left[r.toxic] -= r.bytes
            fit_in.append((r.doc_id, r.toxic))
    chosen = docs.sparkSession.createDataFrame(fit_in, "doc_id long, toxic int")
    sample = id_text(docs).join(F.broadcast(chosen), "doc_id")

    def words_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = [list(zip(*map(normal, raw_words(t)), strict=True)) or [(), ()] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), pa.array([r[0] for r in rows], pa.list_(pa.string())), pa.array([r[1] for r in rows], pa.list_(pa.bool_()))],
                    names=["doc_id", "toxic", "words", "ends"],
                )

    got = sample.select("doc_id", "text", "toxic").mapInArrow(words_in, "doc_id long, toxic int, words array<string>, ends array<boolean>").toArrow()
    got = got.sort_by("doc_id")
    labels_of = got["toxic"].to_numpy()
    shares = {k: totals.get(k, 0) / max(1, int((labels_of == k).sum())) for k in (0, 1)}
    words, ends = (got[c].combine_chunks() if got.num_rows else None for c in ("words", "ends"))
    return fit(words, ends, labels_of, np.array([shares[k] for k in labels_of.tolist()], float))


def _bags_of(held):
    """A worker's scorer of a broadcast model, which stays from task to task."""
    name = uuid.uuid4().hex
    return lambda: kept(name, lambda: held.value.bags())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every document, and the number and character ranges (start:end,
    comma-joined) of its offending sentences."""
    bags = _bags_of(docs.sparkSession.sparkContext.broadcast(model))

    def make():
        of = bags()

        def fn(texts):
            rows = []
            for t in texts:
                z, bag = of(t)
                s = noisy_or(z)
                # of a toxic document the worst sentence at least
                found = located(t, z, bag, min(0.0, float(z.max())) if s >= 0.5 else 0.0)
                rows.append((s, int(s >= 0.5), len(found), ",".join(f"{a}:{b}" for a, b, _ in found)))
            return list(zip(*rows, strict=True))

        return fn

    columns = [("score", pa.float64(), "double"), ("predicted", pa.int32(), "int"), ("n_offending", pa.int64(), "long"), ("spans", pa.string(), "string")]
    told = map_texts(docs, make, columns)
    return told.select("doc_id", (crc_mod("doc_id", 5) == 0).alias("held_out"), "score", "predicted", "n_offending", "spans")


def locate(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """A row for each sentence with a score of ``threshold`` or more: doc_id, its character range and score."""
    bags = _bags_of(docs.sparkSession.sparkContext.broadcast(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = bags()
        for batch in batches:
            for part in slices(batch):
                rows = [
                    (i, *found)
                    for i, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)
                    for found in located(t, *of(t), math.log(threshold / (1 - threshold)))
                ]
                columns = list(zip(*rows, strict=True)) or [()] * 4
                types = (pa.int64(), pa.int64(), pa.int64(), pa.float64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "start", "end", "score"]
                )

    return id_text(docs).mapInArrow(run, "doc_id long, start long, end long, score double")
