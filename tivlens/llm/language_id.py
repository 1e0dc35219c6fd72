"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Letters are lower-cased, everything else becomes a space, and all 1- to 3-grams of the whole
text are hashed into ``BUCKETS`` features. Document frequencies cover all training documents.
The weights are learned with follow-the-regularised-leader (proximal, elastic net) on a sample
of at most ``max_rows`` distinct labelled training rows (text and label), spread evenly over the
languages by a hash of the row, with at least one row of each; a fifth of it is left out of the
fit and sets the temperature. All other work is one pass over the rows in the tasks; nothing but document frequencies (one row per feature), the
sample's features and the weights passes the driver.

Defined cases: a null text or one without a letter gets ``und`` with score 0; rows without a
label or an id may be scored but null labels are never learned from; without any label
everything is ``und``; rows that repeat are each scored alike; other columns are not read.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tivlens.llm.common import crc_mod

BUCKETS = 1 << 14
GRAMS = 3
SLICE = 1 << 20  # code points hashed at once
SPACE = 32


@lru_cache(maxsize=1)
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: the letter it counts as, or a space; and whether it is a letter."""
    folded = np.full(sys.maxunicode + 1, SPACE, np.uint32)
    letter = np.zeros(sys.maxunicode + 1, bool)
    for c in range(sys.maxunicode + 1):
        if (ch := chr(c)).isalpha():
            folded[c], letter[c] = ord(ch.lower()[0]), True
        elif c > 127 and unicodedata.category(ch)[0] == "M":
            folded[c] = c
    return folded, letter


def gram_counts(text: str) -> np.ndarray | None:
    """Counts of the hashed n-grams of the whole text; None if it has no letter."""
    folded, letter = _letters()
    counts = np.zeros(BUCKETS, np.int64)
    any_letter = False
    for at in range(0, len(text), SLICE):
        piece = text[max(0, at - GRAMS + 1):at + SLICE]
        points = np.frombuffer(piece.encode("utf-32-le"), np.uint32)
        any_letter = any_letter or bool(letter[points].any())
        codes = folded[points]
        key, blank = np.zeros(len(codes), np.uint32), np.ones(len(codes), bool)
        fresh = len(points) - len(text[at:at + SLICE])  # code points that the slice before has seen
        for n in range(1, GRAMS + 1):
            size = len(codes) - n + 1
            if size <= 0:
                break
            key = key[:size] * np.uint32(0x01000193) + codes[n - 1:]
            blank = blank[:size] & (codes[n - 1:] == SPACE)
            bucket = (key * np.uint32(0x9E3779B1) + np.uint32(n * 0x85EBCA6B % 2**32)) >> np.uint32(32 - 14)
            new = slice(max(0, fresh - n + 1), None)
            counts += np.bincount(bucket[new][~blank[new]], minlength=BUCKETS)
    return counts if any_letter else None


def features(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights of a text, of length 1."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray
    weights: np.ndarray  # BUCKETS x languages
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if text and self.langs else None
        if counts is None:
            return "und", 0.0
        at, x = features(counts, self.idf)
        p = softmax((x @ self.weights[at]) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(p[best])


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], k: int, epochs: int, alpha: float, beta: float, l1: float,
         l2: float) -> np.ndarray:
    """Weights after ``epochs`` passes of proximal follow-the-regularised-leader with elastic net."""
    z, n = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k))

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            old = n[at]
            w = weights(z[at], old)
            error = softmax(x @ w)
            error[y] -= 1
            g = np.outer(x, error)
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    return weights(z, n)


def temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, by golden-section search on its logarithm.

    Labels are smoothed by one row in all, so that a sample without errors doesn't ask for certainty.
    """
    m, k = scores.shape
    if not m or k < 2:
        return 1.0
    target = np.full((m, k), 1 / (m + 2) / (k - 1))
    target[np.arange(m), labels] = 1 - 1 / (m + 2)

    def loss(t: float) -> float:
        return float(-(target * np.log(np.maximum(softmax(scores / np.exp(t)), 1e-300))).sum(axis=1).mean())

    low, high, ratio = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """Documents that hold each feature, and documents with letters, over all rows of ``docs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for value in batch.column(0):
                if (counts := gram_counts(value.as_py() or "")) is not None:
                    df += counts > 0
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([*at, BUCKETS], pa.int32()), pa.array([*df[at], n], pa.int64())],
                                         names=["bucket", "n"])

    df = np.zeros(BUCKETS + 1, np.int64)
    found = docs.select(text_col).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in found.collect():
        df[r.bucket] = r.n
    return df[:-1], int(df[-1])


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", max_rows: int = 4000, epochs: int = 4,
        alpha: float = 1.0, beta: float = 1.0, l1: float = 0.02, l2: float = 0.1) -> Model:
    """Learn from the labelled rows of ``docs``; ``max_rows`` bounds the sample the weights are fitted on."""
    labelled = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    df, n = document_frequencies(docs, text_col)
    idf = np.log((1 + n) / (1 + df)) + 1
    placed = labelled.where("text is not null").withColumn("place", F.xxhash64("text", "lang"))
    counts = {r.lang: r.n for r in placed.select("lang", "place").distinct().groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(counts)
    if not langs:
        return Model([], idf, np.zeros((BUCKETS, 0)), 1.0)
    quota = max(1, max_rows // len(langs))
    some = quota + 6 * quota ** 0.5 + 6  # rows of a language to choose from, so that chance leaves the quota hardly unfilled
    share = F.element_at(F.create_map(*[x for lang in langs for x in (F.lit(lang), F.lit(some / counts[lang]))]), F.col("lang"))
    # the place in the sample's order decides; equal rows share it and count once
    chosen = placed.where((F.col("place") / F.lit(float(2**64)) + 0.5) < share).dropDuplicates(["lang", "place"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, xs, keep = [], [], []
            for k, value in enumerate(batch.column(0)):
                if (c := gram_counts(value.as_py())) is not None:
                    i, x = features(c, idf)
                    at.append(i.astype(np.int32))
                    xs.append(x.astype(np.float32))
                    keep.append(k)
            kept = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(1), kept.column(2), pa.array(at, pa.list_(pa.int32())), pa.array(xs, pa.list_(pa.float32()))],
                names=["lang", "place", "at", "x"])

    sample = chosen.mapInArrow(run, "lang string, place long, at array<int>, x array<float>")
    rows, left = [], []
    within = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("place"), "place"))
    # in an order that has nothing to do with the language
    for r in sample.withColumn("nth", within).where(F.col("nth") <= quota).orderBy(F.xxhash64("place"), "place").collect():
        row = np.array(r.at, np.int64), np.array(r.x), langs.index(r.lang)
        (left if r.place % 5 == 0 else rows).append(row)
    weights = ftrl(rows, len(langs), epochs, alpha, beta, l1, l2)
    scores = np.array([x @ weights[at] for at, x, _ in left]).reshape(len(left), len(langs))
    return Model(langs, idf, weights, temperature(scores, np.array([y for *_, y in left], int)))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
            carry: bool = False) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row; with ``carry`` the whole row as struct ``row`` in place of the id."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    key = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row") if carry else F.col(id_col).alias("doc_id")
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    # only texts are sent to the workers, the rows that they belong to stay; not deterministic
    # means that a condition on the prediction doesn't have it made a second time
    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = sent.value
        for batch in texts:
            found = [model.predict(v.as_py()) for v in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=schema.names)

    predicted = F.arrow_udf(run, schema).asNondeterministic()
    rows = docs.select(key, predicted(F.col(text_col)).alias("found"))
    return rows.select(rows.columns[0], "found.lang_pred", "found.score")


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2."""
    return crc_mod(id_col, 4) == 2
