"""Document quality by a linear-chain conditional random field over the lines of a text.

Every line that is not blank gets a vector of numbers about its characters and words; the emission of a line also sees
the vectors of the lines before and after it. Two labels, good and bad, and four transition weights complete the
chain. It is fitted by gradient steps on the log likelihood, where each line of a labelled document carries the
document's label. The document's quality is the mean of the forward-backward marginals of "good", weighted by the
lengths of the lines, and turned into a chance by a logistic curve fitted on the same documents.

Labels are learned from rows whose crc32 of the doc_id as text leaves a remainder mod 3 other than 1, on at most
MOST_GOOD and MOST_BAD documents of each class of at most MOST_LINES lines, taken in the order of a hash of the
doc_id. The classes are weighed back to their counts among all the rows to learn from, so that a score means the same at
every size of the table. Scoring takes all lines of all rows, which never leave their partition. A null or empty text, or
one of blank lines, has no lines; its score is the share of good documents among those rows. Rows without a label are scored only; held_out is
null where the doc_id is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read
from tidemark.llm.hashing import mix, word_hashes
from tidemark.llm.linear import fit_logistic, sigmoid
from tidemark.llm.registry import register
from tidemark.llm.toxicity import held_out, labelled_sample, score_rows

#: Labelled documents of each class that the model is fitted on, and the lines of each, at most.
MOST_GOOD = 1500
MOST_BAD = 1500
MOST_LINES = 64
#: Bytes whose lines are turned into numbers at once.
AT_ONCE = 2 << 20
L2, L2_CHAIN = 1e-3, 1e-1
STEPS = 120

#: Classes of bytes that are counted: lower, upper, digit, space, ends of sentences, commas, bars, hashes and signs,
#: brackets and quotes, other ASCII, non-ASCII.
_GROUPS = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t\r", ".!?", ",;:", "|", "#$%&*+=<>@^~\\/_", "()[]{}'\"`-")
CLASS = np.full(256, 9, np.uint8)
for _k, _group in enumerate(_GROUPS):
    CLASS[[ord(c) for c in _group]] = _k
CLASS[0x80:] = 10
CLASS[ord("\n")] = 15  # between lines, counted nowhere
N_CLASSES = 11
NOT_SPACE = CLASS != 3
NOT_SPACE[ord("\n")] = False
#: Numbers of a line, before the lines around it are added.
WIDTH = N_CLASSES + 8


def line_numbers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers of each line that is not blank, its length in bytes, lines of each text)."""
    lines, counts = [], []
    for text in texts:
        own = [x for x in text.split(b"\n") if not x.isspace() and x]
        lines += own
        counts.append(len(own))
    if not lines:
        return np.empty((0, WIDTH)), np.empty(0), np.array(counts, int)
    buffer = np.frombuffer(b"\n".join(lines), np.uint8)
    length = np.array([len(x) for x in lines])
    n = len(lines)
    line = np.repeat(np.arange(n), length + 1)[: len(buffer)]
    kinds = np.bincount(line * 16 + CLASS[buffer], minlength=16 * n).reshape(n, 16)[:, :N_CLASSES]
    share = kinds / length[:, None]
    words, per_line = word_hashes(lines, NOT_SPACE)
    of = np.repeat(np.arange(n), per_line)
    some = np.maximum(per_line, 1)
    again = np.zeros(len(words), bool)
    again[1:] = (words[1:] == words[:-1]) & (of[1:] == of[:-1])
    _, first = np.unique(mix(words ^ mix(of.astype(np.uint64) + np.uint64(1))), return_index=True)
    distinct = np.bincount(of[first], minlength=n)
    # words whose last byte is a sign
    is_sign = np.isin(CLASS[buffer], (6, 7, 9))
    end = np.append(~NOT_SPACE[buffer[1:]], True)
    sign_end = np.bincount(line[is_sign & end & NOT_SPACE[buffer]], minlength=n)
    last = buffer[np.cumsum(length + 1) - 2]
    extra = np.stack(
        [
            np.log1p(length) / 5,
            np.log1p(per_line) / 4,
            (length - kinds[:, 3]) / some / 10,
            np.bincount(of[again], minlength=n) / some,
            1 - distinct / some,
            sign_end / some,
            np.isin(CLASS[last], (4, 5)).astype(float),
            np.minimum(some / (kinds[:, 4] + 1), 100) / 20,
        ],
        axis=1,
    )
    return np.concatenate([share * 3, extra], axis=1), length, np.array(counts, int)


def with_neighbours(x: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers of each line, of the line before and of the one after (0 at the ends of a text), and a constant."""
    n, width = x.shape
    out = np.zeros((n, 3 * width + 3))
    doc = np.repeat(np.arange(len(counts)), counts)
    same = doc[1:] == doc[:-1]
    out[:, :width] = x
    out[1:, width : 2 * width][same] = x[:-1][same]
    out[:-1, 2 * width : 3 * width][same] = x[1:][same]
    out[:, -3] = 1
    out[1:, -2] = same
    out[:-1, -1] = same
    return out


def marginals(
    emission: np.ndarray, chain: np.ndarray, counts: np.ndarray, weight: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(chance of good for each line, expected transitions summed, log of the sum over all labellings by text).

    emission: the score of good of each line (bad has 0); chain[a, b]: the score of b after a; weight: of each line in
    the sum of transitions. Texts are walked side by
    side, longest first, one line of each at a time.
    """
    total = int(counts.sum())
    chance, moves, logz = np.zeros(total), np.zeros((2, 2)), np.zeros(len(counts))
    order = np.argsort(-counts, kind="stable")
    order = order[counts[order] > 0]
    if not len(order):
        return chance, moves, logz
    begin = (np.cumsum(counts) - counts)[order]
    most = int(counts[order[0]])
    alive = np.searchsorted(-counts[order], -np.arange(most), "left")  # texts with more than t lines
    scores = np.stack([np.zeros(total), emission], 1)
    forward = np.zeros((total, 2))
    forward[begin] = scores[begin]
    for t in range(1, most):
        at = begin[: alive[t]] + t
        forward[at] = np.logaddexp.reduce(forward[at - 1][:, :, None] + chain[None], axis=1) + scores[at]
    backward = np.zeros((total, 2))
    for t in range(most - 1, 0, -1):
        at = begin[: alive[t]] + t
        backward[at - 1] = np.logaddexp.reduce(chain[None] + (scores[at] + backward[at])[:, None, :], axis=2)
    z = np.logaddexp.reduce(forward[begin + counts[order] - 1], axis=1)
    logz[order] = z
    of = np.repeat(np.arange(len(counts)), counts)
    chance = np.exp(forward[:, 1] + backward[:, 1] - logz[of])
    inner = np.ones(total, bool)
    inner[begin] = False
    at = np.flatnonzero(inner)
    both = forward[at - 1][:, :, None] + chain[None] + (scores[at] + backward[at])[:, None, :] - logz[of[at]][:, None, None]
    share = np.ones(total) if weight is None else weight
    moves = (np.exp(both) * share[at][:, None, None]).sum(0)
    return chance, moves, logz


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    chain: np.ndarray
    slope: float
    shift: float
    prior: float


def fit(texts: list[bytes], y: np.ndarray, totals: dict[int, int] | None = None) -> Model:
    """The model of labelled texts; without one of the classes, every score is near that class's share.

    totals: documents of each class that the texts stand for, the texts themselves unless given.
    """
    own = {c: int((y == c).sum()) for c in (0, 1)}
    totals = own if totals is None else totals
    prior = float((totals[1] + 1) / (totals[0] + totals[1] + 2))
    x, length, counts = line_numbers(texts)
    x = with_neighbours(x, counts)
    if not len(x) or len(set(y.tolist())) < 2:
        d = x.shape[1]
        return Model(np.zeros(d), np.ones(d), np.zeros(d), np.zeros((2, 2)), 0.0, float(np.log(prior / (1 - prior))), prior)
    mean, spread = x.mean(0), x.std(0)
    mean[spread == 0], spread[spread == 0] = 0, 1
    mean[-3], spread[-3] = 0, 1
    x = (x - mean) / spread
    label = np.repeat(y, counts).astype(float)
    doc = np.repeat(np.arange(len(counts)), counts)
    same = doc[1:] == doc[:-1]
    # each class weighs as in all the documents it stands for
    weight = np.where(y == 1, totals[1] / own[1], totals[0] / own[0])
    weight = weight / weight.mean()
    of_line = np.repeat(weight, counts)
    seen = np.zeros((2, 2))
    np.add.at(seen, (label[:-1][same].astype(int), label[1:][same].astype(int)), of_line[1:][same])
    w, chain = np.zeros(x.shape[1]), np.zeros((2, 2))
    m, s = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    n = of_line.sum()
    for k in range(1, STEPS + 1):
        chance, moves, _ = marginals(x @ w, chain, counts, of_line)
        gradient = np.concatenate([x.T @ ((chance - label) * of_line) / n + L2 * w, ((moves - seen) / n + L2_CHAIN * chain).ravel()])
        m, s = 0.9 * m + 0.1 * gradient, 0.999 * s + 0.001 * gradient**2
        move = 0.05 * (m / (1 - 0.9**k)) / (np.sqrt(s / (1 - 0.999**k)) + 1e-8)
        w, chain = w - move[:-4], chain - move[-4:].reshape(2, 2)
    model = Model(mean, spread, w, chain, 1.0, 0.0, prior)
    some = counts > 0
    evidence = _evidence(model, x, length, counts)[some]
    rows = np.arange(len(evidence))
    even = weight[some] / weight[some].mean()
    slope, shift = fit_logistic(rows, np.zeros_like(rows), evidence, y[some].astype(float), 1, 1e-6, 2000, even)
    model.slope, model.shift = float(slope[0]), shift
    return model


def _evidence(model: Model, x: np.ndarray, length: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The log odds of the length-weighted mean of the marginals, of each text (0 without lines)."""
    chance = marginals(x @ model.weights, model.chain, counts)[0]
    doc = np.repeat(np.arange(len(counts)), counts)
    size = np.maximum(np.bincount(doc, length, len(counts)), 1)
    good = np.clip(np.bincount(doc, chance * length, len(counts)) / size, 1e-9, 1 - 1e-9)
    return np.where(counts > 0, np.log(good / (1 - good)), 0.0)


def scores(model: Model, texts: list[str]) -> np.ndarray:
    out, at = [np.empty(0)], 0
    data = [t.encode("utf-8", "surrogatepass") for t in texts]
    while at < len(data):
        end, held = at, 0
        while end < len(data) and (end == at or held + len(data[end]) <= AT_ONCE):
            held += len(data[end])
            end += 1
        x, length, counts = line_numbers(data[at:end])
        x = (with_neighbours(x, counts) - model.mean) / model.spread
        odds = model.slope * _evidence(model, x, length, counts) + model.shift
        out.append(np.where(counts > 0, sigmoid(odds), model.prior))
        at = end
    return np.concatenate(out)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    few_lines = docs.where(F.size(F.split(F.coalesce("text", F.lit("")), "\n")) <= MOST_LINES)
    keep = ~held_out(F.col("doc_id"), 3, 1)
    sample = labelled_sample(few_lines, labels, "quality", keep, {1: MOST_GOOD, 0: MOST_BAD})
    learnable = labels.where(keep).select("doc_id", F.col("quality").cast("int").alias("y")).where("y in (0, 1)").distinct()
    # of all rows to learn from, however long, so that neither the caps nor the lines move the classes
    found = docs.select("doc_id").join(learnable, "doc_id").groupBy("y").count().collect()
    totals = {0: 0, 1: 0} | {r["y"]: r["count"] for r in found}
    return fit([t.encode("utf-8", "surrogatepass") for t, _ in sample], np.array([y for _, y in sample], int), totals)


def quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs, labels))
    found = score_rows(docs, lambda texts: scores(sent.value, texts))
    return found.select(
        "doc_id",
        held_out(F.col("doc_id"), 3, 1).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )


def keep_rows(docs: DataFrame, model) -> DataFrame:
    """The rows whose text scores at least 0.5 by a broadcast Model, all columns as they are."""

    def good(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield batch.filter(pa.array(scores(model.value, texts) >= 0.5))

    return map_arrow(docs, good, docs.schema)


@register("op1_quality")
def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
