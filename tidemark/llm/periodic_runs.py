"""Periodic runs of words, found by recursive frequency splitting and a scan over lags.

A run is a stretch of consecutive words with smallest period q and a length of at least max(6, 4 * q) that no neighbouring
word extends. Every word of a run stands in it four times or more, so a word that stands less often in a segment
belongs to no run of it: it splits the segment. The parts are split again until no word is too rare, and parts of
fewer than six words go. All segments of a batch of texts are split at once, by counts of (segment, word).

Each surviving segment is scanned at every lag up to a quarter of its length. A run holds three equal pairs in a row on
any grid of steps as long as its period; two such grids are looked at for each lag, which takes time in proportion to
segment / lag, and the lag is compared in full only around the places where both grids agree. A stretch that is already
a run of a smaller period is not one of a multiple of it.

Texts are whole; one text stands in one task. A null or empty text has no words and no runs: `n_runs` 0, the four columns
of the longest run null, and the digests those of empty bytes. Repeated rows are separate rows. A null id damages nothing.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read
from tidemark.llm.registry import register

#: Copies of the period, and words, that a run has at least.
LEAST_COPIES = 4
LEAST_WORDS = 6

Run = tuple[int, int, int]  # start, length, period


def surviving(codes: np.ndarray, segment: np.ndarray) -> list[np.ndarray]:
    """Positions of each segment that is left when no word is too rare in its segment.

    `segment` names the text of every word; a gap in the positions, or another segment, ends a segment.
    """
    at = np.arange(len(codes))
    while len(at):
        pairs = segment * (int(codes.max()) + 1) + codes
        _, which, counts = np.unique(pairs, return_inverse=True, return_counts=True)
        often = counts[which] >= LEAST_COPIES
        kept, of = at[often], segment[often]
        new = np.ones(len(kept), bool)
        new[1:] = (np.diff(kept) != 1) | (np.diff(of) != 0)
        number = np.cumsum(new) - 1
        long = np.bincount(number)[number] >= LEAST_WORDS if len(kept) else np.empty(0, bool)
        if often.all() and long.all():
            return np.split(at, np.flatnonzero(new)[1:])
        at, codes, segment = kept[long], codes[often][long], number[long]
    return []


def _grid_hits(words: np.ndarray, lag: int, shift: int) -> np.ndarray:
    """Cells of a grid of step `lag` that begin three equal pairs in a row."""
    grid = words[shift::lag]
    same = grid[1:] == grid[:-1]
    return np.flatnonzero(same[:-2] & same[1:-1] & same[2:])


def segment_runs(words: np.ndarray) -> list[Run]:
    """The runs of one segment, by lag; all of them lie within it."""
    found: list[Run] = []
    known: set[tuple[int, int]] = set()
    for lag in range(1, len(words) // LEAST_COPIES + 1):
        hits = _grid_hits(words, lag, 0)
        if not len(hits):
            continue
        near = _grid_hits(words, lag, lag // 2)  # a run holds hits of both grids less than a step apart
        hits = hits[np.isin(hits, near) | np.isin(hits - 1, near) | np.isin(hits + 1, near)]
        done = 0
        for begin in (hits * lag).tolist():
            if begin < done:
                continue
            start, stop = extended(words, lag, begin)
            done = stop - lag
            if stop - start >= max(LEAST_WORDS, LEAST_COPIES * lag) and (start, stop) not in known:
                known.add((start, stop))
                found.append((start, stop - start, lag))
    return found


def extended(words: np.ndarray, lag: int, begin: int) -> tuple[int, int]:
    """The widest stretch around `begin` in which words a lag apart are equal, compared in growing blocks."""
    last, size = begin, 4 * lag + 64
    while last + lag < len(words):
        part = words[last : last + size]
        ahead = words[last + lag : last + lag + size]
        differ = np.flatnonzero(part[: len(ahead)] != ahead)
        if len(differ):
            last += int(differ[0])
            break
        last, size = last + len(ahead), 2 * size
    first, size = begin, 4 * lag + 64
    while first:
        low = max(0, first - size)
        differ = np.flatnonzero(words[low:first] != words[low + lag : first + lag])
        if len(differ):
            first = low + int(differ[-1]) + 1
            break
        first, size = low, 2 * size
    return first, last + lag


def runs_of(texts: list[np.ndarray]) -> list[list[Run]]:
    """The runs of each text of word codes, by start and period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    begins = np.cumsum(sizes) - sizes
    found: list[list[Run]] = [[] for _ in texts]
    if not sizes.sum():
        return found
    codes = np.concatenate(texts)
    for at in surviving(codes, np.repeat(np.arange(len(texts)), sizes)):
        text = int(np.searchsorted(begins + sizes, at[0], side="right"))
        shift = int(at[0] - begins[text])
        found[text] += [(shift + s, n, p) for s, n, p in segment_runs(codes[at[0] : at[-1] + 1])]
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in found]


def longest(runs: list[Run]) -> Run | None:
    """The run of the greatest length / period; of equal ones that with the smallest start, then period."""
    return min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """Whether each of n words is left when every run gives up all words after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:-1]) == 0


def repeated_tail(doc_id: int | None, n: int) -> np.ndarray:
    """For each word of a text the original word that stands there: every tenth text gets a periodic tail."""
    where = np.arange(n)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        where[a:] = a + np.arange(n - a) % p
    return where


SCHEMA = (
    "doc_id bigint, n_words bigint, n_runs bigint, start bigint, length bigint, period bigint, exponent_milli bigint, "
    "runs_sha256 string, collapsed_sha256 string, collapsed string"
)


def collapse_runs(docs: DataFrame, repeat_tails: bool = False) -> DataFrame:
    """The rows of (doc_id, text) as SCHEMA: the runs' number and digest, the longest run, and the text without repeats.

    `repeat_tails` first gives every tenth text a periodic tail.
    """

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            words, codes = [], []
            for doc_id, text in zip(ids, batch.column(1).to_pylist()):
                own = (text or "").encode("utf-8", "surrogatepass").split()
                code = np.fromiter(map(number.__getitem__, own), np.int64, len(own))
                if repeat_tails:
                    where = repeated_tail(doc_id, len(own))
                    code = code[where]
                    own = [own[i] for i in where.tolist()]
                words.append(own)
                codes.append(code)
            columns: list[list] = [[] for _ in range(9)]
            for own, runs in zip(words, runs_of(codes)):
                best = longest(runs)
                text = b" ".join(own)
                if runs:
                    text = b" ".join([own[i] for i in np.flatnonzero(kept_words(len(own), runs)).tolist()])
                listed = "".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()
                row = [len(own), len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2]]
                row += [hashlib.sha256(listed).hexdigest(), hashlib.sha256(text).hexdigest(), text.decode("utf-8", "surrogatepass")]
                for column, value in zip(columns, row):
                    column.append(value)
            kinds = [pa.int64()] * 6 + [pa.string()] * 3
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], [c.split()[0] for c in SCHEMA.split(", ")])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), measured, SCHEMA)


@register("op12_periodic_runs")
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse_runs(read(spark, sf_dir, "documents"), repeat_tails=True).drop("collapsed")
