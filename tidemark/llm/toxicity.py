"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

The features of a text are the hashed n-grams of code points (3 to 8, lower-cased, over word ends) that occur in it.
Each is scaled by the log ratio of its document counts in the two classes; n-grams whose counts differ by chance only
are left out, of the rest the MOST_FEATURES with the largest differences stay, and a logistic regression, in which
both classes weigh the same, weighs these. The bound is one on the model, which is broadcast; texts are scored whole.

Labels are learned from rows whose crc32 of the doc_id as text leaves a remainder mod 5 other than 0. The model is
fitted on at most MOST_TOXIC and MOST_CLEAN labelled rows of each class, taken in the order of a hash of the doc_id;
scoring takes whole texts of all rows, which never leave their partition. A null text scores like an empty one. Rows
without a label, or with a null doc_id, are scored only; their held_out is null if the doc_id is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read
from tidemark.llm.linear import fit_logistic, sigmoid
from tidemark.llm.registry import register

#: Labelled rows of each class that the model is fitted on, at most.
MOST_TOXIC = 1500
MOST_CLEAN = 2500
SIZES = (3, 4, 5, 6, 7, 8)
BITS = 22
#: Standard errors by which a feature's share must differ between the classes, and how many features are kept.
MIN_Z = 3.0
MOST_FEATURES = 12_000
SMOOTHING = 1.0
L2 = 1e-4
STEPS = 200
#: Code points whose n-grams are hashed at once.
AT_ONCE = 1 << 20


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds == fold


@dataclass
class Model:
    #: 1 for the buckets that have a weight
    active: np.ndarray
    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place of the text, bucket) of every n-gram, for one n after the other; texts are taken whole, some at a time."""
    at = 0
    while at < len(texts):
        end, held = at, 0
        while end < len(texts) and (end == at or held + len(texts[end]) <= AT_ONCE):
            held += len(texts[end]) + 1
            end += 1
        joined = "\0".join(t.lower().replace("\0", " ") for t in texts[at:end]) + "\0"
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        text = np.cumsum(code == 0, dtype=np.int32) - (code == 0) + np.int32(at)
        h = np.zeros(len(code), np.uint32)
        power = np.uint32(1)
        for n in range(max(SIZES)):
            if n >= len(code):
                break
            h = h[: len(code) - n] + code[n:] * power
            power = np.uint32(int(power) * 0x01000193 + 2 & 0xFFFFFFFF | 1)
            if n + 1 in SIZES:
                inside = text[: len(h)] == text[n:]
                inside &= code[n:] != 0
                mixed = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + np.uint32(n)
                bucket = ((mixed ^ (mixed >> np.uint32(12))) * np.uint32(0x297A2D39)) >> np.uint32(32 - BITS)
                yield text[: len(h)][inside], bucket[inside]
        at = end


def present(texts: list[str], active: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(place of the text, bucket), each pair once; only active buckets if given."""
    pairs = [np.empty(0, np.int64)]
    for text, bucket in grams(texts):
        if active is not None:
            some = active[bucket] != 0
            text, bucket = text[some], bucket[some]
        pairs.append(np.unique(text.astype(np.int64) << BITS | bucket))
    found = np.unique(np.concatenate(pairs))
    return found >> BITS, found & ((1 << BITS) - 1)


def fit(texts: list[str], y: np.ndarray) -> Model:
    """The model of labelled texts; without one of the classes, every score is that class's."""
    active = np.zeros(1 << BITS, np.uint8)
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    if not n1 or not n0:
        bias = 0.0 if not n1 and not n0 else (4.0 if n1 else -4.0)
        return Model(active, np.empty(0, np.int64), np.empty(0), bias)
    counts = np.zeros((2, 1 << BITS), np.float32)
    place = np.zeros(1 << BITS, np.int32)
    for text, label in zip(texts, y):
        bucket = np.concatenate([np.empty(0, np.uint32), *(b for _, b in grams([text]))])
        at = np.arange(len(bucket), dtype=np.int32)
        place[bucket] = at  # the last of equal ones stays, so each counts once
        counts[int(label), bucket[place[bucket] == at]] += 1
    share = (counts.sum(0) + 1) / (n0 + n1 + 2)
    z = (counts[1] / n1 - counts[0] / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1))
    buckets = np.flatnonzero(np.abs(z) >= MIN_Z)
    buckets = np.sort(buckets[np.argsort(-np.abs(z[buckets]), kind="stable")[:MOST_FEATURES]])
    p, q = counts[1, buckets] + SMOOTHING, counts[0, buckets] + SMOOTHING
    ratio = np.log(p / (n1 + 2 * SMOOTHING)) - np.log(q / (n0 + 2 * SMOOTHING))
    active[buckets] = 1
    rows, cols = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for k in range(0, len(texts), 256):
        text, bucket = present(texts[k : k + 256], active)
        rows.append(k + text)
        cols.append(np.searchsorted(buckets, bucket))
    rows, cols = np.concatenate(rows), np.concatenate(cols)
    even = np.where(y == 1, 0.5 / n1, 0.5 / n0) * (n0 + n1)  # both classes weigh the same
    w, bias = fit_logistic(rows, cols, ratio[cols], y.astype(float), len(buckets), L2, STEPS, even)
    return Model(active, buckets, w * ratio, bias)


def scores(model: Model, texts: list[str]) -> np.ndarray:
    text, bucket = present(texts, model.active)
    found = np.searchsorted(model.buckets, bucket)
    return sigmoid(np.bincount(text, model.weights[found], len(texts)) + model.bias)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, keep: Column, most: dict[int, int]) -> list[tuple[str, int]]:
    """At most so many (text, label) of each class among the rows to learn from, in the order of a hash."""
    rows = labels.where(keep).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    some = None
    for y, n in most.items():
        few = rows.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
        some = few if some is None else some.unionByName(few)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(some, "doc_id")
    return [(r.text, r.y) for r in found.select("text", "y", "doc_id").orderBy("doc_id").toLocalIterator()]


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 5, fold: int = 0) -> Model:
    keep = ~held_out(F.col("doc_id"), folds, fold)
    sample = labelled_sample(docs, labels, label, keep, {1: MOST_TOXIC, 0: MOST_CLEAN})
    return fit([t for t, _ in sample], np.array([y for _, y in sample], int))


def score_rows(docs: DataFrame, score) -> DataFrame:
    """(doc_id, score) of (doc_id, text) by a function from texts to scores."""

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(texts), pa.float64())], ["doc_id", "score"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), scored, "doc_id bigint, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    found = score_rows(docs, lambda texts: scores(sent.value, texts))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), 5, 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


@register("op9_toxicity")
def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
