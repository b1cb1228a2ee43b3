"""Language identification with hyperdimensional profiles.

Every letter has a random vector of signs, fixed by its code point and the seed. A letter n-gram's vector binds
(multiplies) its letters' vectors, each permuted (rotated) once for every place before the end, so order matters;
a text's vector bundles (adds) its n-grams' vectors. A language's prototype bundles the training texts of that
language, and a text gets the language whose prototype is nearest by cosine. Runs of characters that aren't
letters count as one blank, so n-grams also see where words begin and end.

Texts that are null or have no letter get ``und`` with score 0, as do all texts if nothing was learned. Of equally
near languages the first by name wins; repeated rows give repeated rows and count as often where they are learned from.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stintlab.llm.common import crc_mod, kept, slices

DIM, ORDER, SEED = 1024, 3, 20240229
UNKNOWN = "und"
#: The least cosine of a text that is like a language, five deviations of chance; and deviations of the text's own scatter,
#: one over the root of its distinct n-grams, by which it may fall short.
MIN_SCORE, OWN_SCATTER = 5 / DIM**0.5, 1.0
#: What a prediction adds.
TOLD = ("lang_pred", "score", "n_grams")
#: Languages that may be learned; their prototypes go to every task.
MAX_LANGUAGES = 2000
#: Letters whose vectors a worker keeps, a kilobyte each; then it starts again.
MAX_LETTERS = 20_000
#: Texts whose vectors are made in one product.
ROWS = 128


@functools.cache
def _is_letter() -> np.ndarray:
    table = np.zeros(0x110000, bool)
    table[[i for i in range(0x110000) if chr(i).isalpha()]] = True
    return table


class Space:
    """The letters' vectors; each is made when first met and depends on the seed and its code point alone."""

    def __init__(self, dim: int = DIM, order: int = ORDER, seed: int = SEED):
        self.dim, self.order, self.seed = dim, order, seed
        self._of: dict[int, np.ndarray] = {}

    def letters(self, points: np.ndarray) -> np.ndarray:
        if len(self._of) > MAX_LETTERS:
            self._of.clear()
        for p in points.tolist():
            if p not in self._of:
                bits = np.random.Generator(np.random.PCG64([self.seed, p])).integers(0, 2, self.dim, dtype=np.int8)
                self._of[p] = bits * 2 - 1
        return np.stack([self._of[p] for p in points.tolist()])

    def ngrams(self, letters: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """A row for each n-gram; ``grams`` has rows of places in ``letters``."""
        out = np.ones((len(grams), self.dim), np.int8)
        for k in range(self.order):
            out *= np.roll(letters, self.order - 1 - k, axis=1)[grams[:, k]]
        return out


def _space(dim: int, order: int, seed: int) -> Space:
    return kept(("space", dim, order, seed), lambda: Space(dim, order, seed))


def profile(texts: list[str | None], space: Space) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a few texts: counts by text and n-gram, the n-grams' vectors, and whether each text has a letter."""
    joined, owner = [], []
    has = np.zeros(len(texts), bool)
    is_letter = _is_letter()
    for i, text in enumerate(texts):
        points = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = is_letter[points]
        has[i] = letter.any()
        points = np.concatenate(([32], np.where(letter, points, 32), [32]))
        points = points[np.concatenate(([True], (points[1:] != 32) | (points[:-1] != 32)))]
        if has[i] and len(points) >= space.order:
            joined.append(points)
            owner.append(np.full(len(points) - space.order + 1, i))
    if not joined:
        return np.zeros((len(texts), 0), np.float32), np.zeros((0, space.dim), np.int8), has
    seen, places = np.unique(np.concatenate(joined), return_inverse=True) if len(joined) == 1 else _dense(joined)
    k, cuts = len(seen), np.cumsum([0, *map(len, joined)])
    codes = []
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        own = places[a:b].astype(np.int64)
        code = own[: len(own) - space.order + 1].copy()
        for j in range(1, space.order):
            code = code * k + own[j : len(own) - space.order + 1 + j]
        codes.append(code)
    code, owner = np.concatenate(codes), np.concatenate(owner)
    if k**space.order <= 4_000_000:
        used = np.flatnonzero(np.bincount(code, minlength=1))
        number = np.zeros(used[-1] + 1, np.int64)
        number[used] = np.arange(len(used))
        column = number[code]
    else:
        used, column = np.unique(code, return_inverse=True)
    counts = np.bincount(owner * len(used) + column, minlength=len(texts) * len(used)).reshape(len(texts), -1)
    grams = np.stack([used // k ** (space.order - 1 - j) % k for j in range(space.order)], axis=1)
    return counts.astype(np.float32), space.ngrams(space.letters(seen), grams), has


def _dense(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    points = np.concatenate(parts)
    seen = np.flatnonzero(np.bincount(points))
    number = np.zeros(seen[-1] + 1, np.int64)
    number[seen] = np.arange(len(seen))
    return seen, number[points]


def _groups(texts: list) -> Iterator[tuple[int, list]]:
    """Runs of at most ROWS texts of a bounded length together."""
    start = total = 0
    for i, t in enumerate(texts):
        if i > start and (i - start >= ROWS or total + len(t or "") > 2_000_000):
            yield start, texts[start:i]
            start, total = i, 0
        total += len(t or "")
    if start < len(texts):
        yield start, texts[start:]


def learn(training: DataFrame, dim: int = DIM, order: int = ORDER, seed: int = SEED) -> dict[str, np.ndarray]:
    """Unit prototypes by language from columns ``text`` and ``lang``; rows with a null in either are skipped.

    Each task adds up its own texts, and the tasks' sums meet by language, a row for each task and language.
    """

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, held = _space(dim, order, seed), {}
        for batch in batches:
            for part in slices(batch, 0):
                texts, langs = part.column(0).to_pylist(), part.column(1).to_pylist()
                for at, group in _groups(texts):
                    counts, grams, has = profile(group, space)
                    own = np.array([langs[at + i] for i in range(len(group))], object)
                    share = counts / np.maximum(counts.sum(1, keepdims=True), 1) ** 0.5
                    for lang in set(own[has]):
                        total = share[(own == lang) & has].sum(0)
                        held[lang] = held.get(lang, 0) + total @ grams.astype(np.float32)
        names = list(held)
        yield pa.RecordBatch.from_arrays(
            [pa.array(names, pa.string()), pa.array([held[n].astype(float).tolist() for n in names], pa.list_(pa.float64()))],
            names=["lang", "v"],
        )

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    rows = training.where("text is not null and lang is not null").select("text", "lang")
    parts = rows.mapInArrow(sums, "lang string, v array<double>")
    parts = parts.withColumn("salt", F.spark_partition_id() % 64)
    parts = parts.groupBy("lang", "salt").applyInPandas(add, "lang string, v array<double>")
    found = parts.groupBy("lang").applyInPandas(add, "lang string, v array<double>").limit(MAX_LANGUAGES + 1).collect()
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages to learn")
    vectors = {r.lang: np.asarray(r.v) for r in found}
    return {k: v / n for k, v in sorted(vectors.items()) if (n := np.linalg.norm(v)) > 0}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], dim: int = DIM, order: int = ORDER, seed: int = SEED) -> DataFrame:
    """``docs`` (doc_id, text and any more columns) with ``lang_pred``, ``score``, the cosine cut to 0 to 1, and ``n_grams``, how
    many distinct ones the text has."""
    names = list(prototypes)
    held = docs.sparkSession.sparkContext.broadcast(np.stack([prototypes[n] for n in names]).astype(np.float32) if names else None)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        space, profiles = _space(dim, order, seed), held.value
        for batch in batches:
            for part in slices(batch, at):
                texts = part.column(at).to_pylist()
                lang, score, n_grams = [UNKNOWN] * len(texts), [0.0] * len(texts), [0] * len(texts)
                for start, group in _groups(texts) if names else ():
                    counts, grams, has = profile(group, space)
                    vectors = counts @ grams.astype(np.float32)
                    size = np.linalg.norm(vectors, axis=1)
                    near = vectors @ profiles.T / np.maximum(size, 1e-9)[:, None]
                    best = near.argmax(1)
                    for i in np.flatnonzero(has).tolist():
                        lang[start + i] = names[best[i]]
                        score[start + i] = float(min(1.0, max(0.0, near[i, best[i]])))
                    n_grams[start : start + len(group)] = (counts > 0).sum(1).tolist()
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(n_grams, pa.int64())],
                    names=[*part.schema.names, *TOLD],
                )

    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, k) for n, k in zip(TOLD, (T.StringType(), T.DoubleType(), T.LongType()), strict=True))])
    return docs.mapInArrow(run, schema)


def held_out_split(docs: DataFrame) -> DataFrame:
    """doc_id, text, lang and ``held_out``: the documents whose crc32 modulo 3 is 1 teach nothing."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")
    ).withColumn("held_out", crc_mod("doc_id", 3) == 1)


def identify(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, held_out, lang_pred, score."""
    split = held_out_split(docs)
    prototypes = learn(split.where("not held_out"))
    return predict(split.select("doc_id", "held_out", "text"), prototypes).select("doc_id", "held_out", "lang_pred", "score")


def keep_identified(docs: DataFrame, min_score: float = MIN_SCORE, own_scatter: float = OWN_SCATTER) -> DataFrame:
    """The documents, all columns, without those that have no letter or resemble no learned language.

    Unrelated texts' cosines scatter around zero by one over the root of the dimensions; a text's cosine with its own language
    scatters by one over the root of its distinct n-grams, so that a text shows the less the shorter it is. Each text is
    judged by both: it goes if its cosine falls short of ``min_score`` by more than ``own_scatter`` of its own deviations.
    """
    prototypes = learn(held_out_split(docs).where("not held_out"))
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns))
    clash = {c: f"{c}_{uuid.uuid4().hex}" for c in docs.columns if c in TOLD}
    told = predict(plain.withColumnsRenamed(clash), prototypes)
    alike = F.col("score") + own_scatter / F.sqrt(F.greatest("n_grams", F.lit(1))) >= min_score
    kept = told.where((F.col("lang_pred") != UNKNOWN) & alike).drop(*TOLD)
    return kept.withColumnsRenamed({v: k for k, v in clash.items()}).select(*(F.col(f"`{c}`") for c in docs.columns))
