"""Personal data by a semi-Markov conditional random field over segments of text.

Base spans come from fixed patterns (see `base_spans`). The field adds spans that the patterns lose, such as a phone number
followed by a card number, which together have too many digits for either. It works on islands: neighbouring
words that hold a digit or an at sign. An island is cut into atoms (runs of digits, runs of letters, single
signs); a segmentation is a row of entities of at most MOST_ATOMS atoms, MOST_LENGTH characters and, without an at sign,
MOST_DIGITS digits (those of the longest card number), and of single atoms outside. A candidate segment is scored by features of the whole span: its kind, whether the whole span is well formed (octets, check digit,
number of digits), its shape, its groups and what stands beside it. Dynamic programming sums over all
segmentations to fit the weights and finds the best one to choose boundaries and kinds jointly.

No labels are needed: the field is fitted on the islands, of at most LEARNED_LENGTH characters, of at most MOST_DOCS texts,
taken in the order of a hash of the doc_id (rows without one are not learned from), in which no pattern failed; their base
spans are the truth. Added spans never overlap base spans, which all stay: the field sees what lies between them.
The time for a text grows with its length. A null text is empty. Rows never leave their partition.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read
from tidemark.llm.registry import register

KINDS = ("email", "ip", "card", "phone")
#: Documents and islands that the field is fitted on, at most, and atoms of an entity.
MOST_DOCS = 1500
MOST_ISLANDS = 3000
MOST_ATOMS = 24
MOST_LENGTH = 400
MOST_DIGITS = 19
LEARNED_LENGTH = 400
STEPS = 60
L2 = 1e-3

LOCAL = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NUMBERS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
ATOM = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
TRIGGER = re.compile(r"[0-9@]")
DIGITS = re.compile(r"[^0-9]+")
GROUP = re.compile(r"[0-9]+")

Span = tuple[int, int, int]  # start, kind, end


#: What a digit adds to the check sum, at its place and doubled.
ONCE = {str(d): d for d in range(10)}
TWICE = {str(d): 2 * d - 9 * (d > 4) for d in range(10)}


def luhn(digits: str) -> bool:
    return (sum(map(ONCE.__getitem__, digits[::-2])) + sum(map(TWICE.__getitem__, digits[-2::-2]))) % 10 == 0


def digits_of(text: str) -> str:
    return DIGITS.sub("", text)


def is_octet(part: str) -> bool:
    """Is a run of digits, however many zeros it begins with, at most 255?"""
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or "0") <= 255


def base_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """(spans of the patterns, matches that failed a check); leftmost, not overlapping in a kind, linear in the text."""
    spans, failed, low = [], [], 0
    at = text.find("@")
    while at >= 0:
        # one at sign belongs to one match: from the first character its local part can start at
        begin = max(low, at - _run_before(text, at, low))
        domain = DOMAIN.match(text, at + 1) if begin < at else None
        if domain:
            low = domain.end()
            spans.append((begin, 0, low))
        at = text.find("@", max(low, at + 1))
    if any(map(text.__contains__, "0123456789")):
        for m in NUMBERS.finditer(text):
            parts, begin = m.group().split("."), m.start()
            for k in range(0, len(parts) - 3, 4):
                end = begin + sum(map(len, parts[k : k + 4])) + 3
                if all(map(is_octet, parts[k : k + 4])):
                    spans.append((begin, 1, end))
                else:
                    failed.append((begin, end))
                begin = end + 1
        for m in CARD.finditer(text):
            digits = digits_of(m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                spans.append((m.start(), 2, m.end()))
            elif len(digits) >= 14:
                failed.append(m.span())
        for m in PHONE.finditer(text):
            if 10 <= len(digits_of(m.group())) <= 15:
                spans.append((m.start(), 3, m.end()))
            else:
                failed.append(m.span())
    return sorted(spans), failed


def _run_before(text: str, at: int, low: int) -> int:
    """Characters of a local part directly before a place."""
    size, step = 0, 64
    while at - size > low:
        piece = text[max(low, at - size - step) : at - size]
        kept = len(piece) - len(piece.rstrip(LOCAL))
        size += kept
        if kept < len(piece):
            break
    return size


def islands(text: str) -> Iterator[tuple[int, int]]:
    """Runs of words, one space apart, that each hold a digit or an at sign."""
    begin = end = -1
    place = 0
    while (m := TRIGGER.search(text, place)) is not None:
        first = m.start()
        while first > max(end, 0) and not text[first - 1].isspace():
            first -= 1
        word = WORD.match(text, m.start())
        if end >= 0 and first == end + 1 and text[end] == " ":
            end = word.end()
        else:
            if end >= 0:
                yield begin, end
            begin, end = first, word.end()
        place = end
    if end >= 0:
        yield begin, end


WORD = re.compile(r"\S+")


def _beside(c: str) -> int:
    if not c:
        return 0
    if c.isspace():
        return 1
    if c.isalnum():
        return 2
    return 3 if c in ".-_@%+/=" else 4


#: Features of a span of one kind.
N_FEATURES = 100
WELL_FORMED = {
    0: lambda s, d: EMAIL.fullmatch(s) is not None,
    1: lambda s, d: s.count(".") == 3 and all(p.isdigit() and len(p) <= 3 and int(p) <= 255 for p in s.split(".")),
    2: lambda s, d: CARD.fullmatch(s) is not None and 14 <= len(d) <= 19 and luhn(d),
    3: lambda s, d: PHONE.fullmatch(s) is not None and 10 <= len(d) <= 15,
}
POSSIBLE = {
    0: re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+"),
    1: re.compile(r"[0-9]+(\.[0-9]+)+"),
    2: re.compile(r"[0-9][0-9\x20-]+[0-9]"),
    3: re.compile(r"[+(]?[0-9][\x20().0-9-]+[0-9]"),
}


def features(text: str, begin: int, end: int, kind: int) -> list[int]:
    """The features of a whole span that are on."""
    before, after = text[begin - 1 : begin], text[end : end + 1]
    # digits go on after a sign: a larger span of the same signs is possible
    goes_on = after in JOINING and text[end + 1 : end + 2] in ASCII_DIGITS
    came_on = before in JOINING and begin > 1 and text[begin - 2] in ASCII_DIGITS
    return _features(text[begin:end], _beside(before), _beside(after), goes_on, came_on, kind)


JOINING, ASCII_DIGITS = (" ", ".", "-"), tuple("0123456789")


@lru_cache(maxsize=100_000)
def _features(span: str, before: int, after: int, goes_on: bool, came_on: bool, kind: int) -> list[int]:
    groups = GROUP.findall(span)
    d = "".join(groups)
    on = [0, 1 + before, 6 + after]
    on.append(11 if WELL_FORMED[kind](span, d) else 12)
    on.append(13 + min(len(d), 24))
    on.append(38 + min(len(groups), 9))
    for k, sign in enumerate(" ().-+@"):
        if sign in span:
            on.append(48 + k)
    on.append(56 + (span[0] == "+"))
    on.append(58 + luhn(d) if d else 60)
    if goes_on:
        on.append(61)
    if came_on:
        on.append(62)
    on.append(63 + min(1 + span.count(" ") + span.count("-"), 8))
    on.append(72 + min(max(map(len, groups), default=0), 20))
    return [kind * N_FEATURES + k for k in on]


class Island:
    """An island's atoms and its candidate segments: (first atom, atom after the last, kind, features)."""

    def __init__(self, text: str, begin: int, end: int) -> None:
        self.cuts = [m.start() for m in ATOM.finditer(text, begin, end)] + [end]
        self.candidates: list[tuple[int, int, int, list[int]]] = []
        sign = -1  # the next at sign; without one near, a span holds no letters and not more digits than a card number
        for i in range(len(self.cuts) - 1):
            a = self.cuts[i]
            if not (text[a].isalnum() or text[a] in "+("):
                continue
            if sign < a:
                sign = text.find("@", a, end)
                sign = end + MOST_LENGTH if sign < 0 else sign
            n, last = 0, a
            for j in range(i + 1, min(i + MOST_ATOMS, len(self.cuts) - 1) + 1):
                b = self.cuts[j]
                if b - a > MOST_LENGTH:
                    break
                n += sum(map(str.isdigit, text[last:b]))
                if sign - a > MOST_LENGTH and (n > MOST_DIGITS or text[last].isalpha()):
                    break
                last = b
                if not text[b - 1].isalnum():
                    continue
                span = text[a:b]
                for kind in range(4):
                    enough = "@" in span if kind == 0 else n >= (4, 4, 12, 7)[kind]
                    if enough and POSSIBLE[kind].fullmatch(span):
                        self.candidates.append((i, j, kind, features(text, a, b, kind)))

    def scores(self, weights: np.ndarray) -> list[float]:
        return [float(weights[f].sum()) for *_, f in self.candidates]

    def expected(self, weights: np.ndarray) -> tuple[np.ndarray, float]:
        """(chance of every candidate, log of the sum over all segmentations)."""
        n, score = len(self.cuts) - 1, self.scores(weights)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        starts: list[list[int]] = [[] for _ in range(n + 1)]
        for c, (i, j, _, _) in enumerate(self.candidates):
            ends[j].append(c)
            starts[i].append(c)
        forward, backward = np.zeros(n + 1), np.zeros(n + 1)
        for t in range(1, n + 1):
            forward[t] = np.logaddexp.reduce([forward[t - 1], *(forward[self.candidates[c][0]] + score[c] for c in ends[t])])
        for t in range(n - 1, -1, -1):
            backward[t] = np.logaddexp.reduce([backward[t + 1], *(backward[self.candidates[c][1]] + score[c] for c in starts[t])])
        chance = [np.exp(forward[i] + score[c] + backward[j] - forward[n]) for c, (i, j, _, _) in enumerate(self.candidates)]
        return np.array(chance), float(forward[n])

    def best(self, weights: np.ndarray) -> list[Span]:
        """The entities of the best segmentation."""
        n, score = len(self.cuts) - 1, self.scores(weights)
        ends: list[list[int]] = [[] for _ in range(n + 1)]
        for c, (_, j, _, _) in enumerate(self.candidates):
            ends[j].append(c)
        top, back = [0.0] * (n + 1), [-1] * (n + 1)
        for t in range(1, n + 1):
            top[t] = top[t - 1]
            for c in ends[t]:
                s = top[self.candidates[c][0]] + score[c]
                if s > top[t]:
                    top[t], back[t] = s, c
        out, t = [], n
        while t:
            if back[t] < 0:
                t -= 1
            else:
                i, j, kind, _ = self.candidates[back[t]]
                out.append((self.cuts[i], kind, self.cuts[j]))
                t = i
        return out[::-1]


def fit(texts: list[str]) -> np.ndarray:
    """The weights, by gradient steps on the likelihood of the base spans of islands where no pattern failed."""
    weights = np.zeros(len(KINDS) * N_FEATURES)
    truth: list[tuple[Island, set[int]]] = []
    for text in texts:
        spans, failed = base_spans(text)
        for begin, end in islands(text):
            if len(truth) >= MOST_ISLANDS or end - begin > LEARNED_LENGTH or any(a < end and begin < b for a, b in failed):
                continue
            mine = [s for s in spans if s[0] < end and begin < s[2]]
            if any(a[2] > b[0] for a, b in zip(mine, mine[1:])):
                continue  # kinds that overlap have no single segmentation
            island = Island(text, begin, end)
            place = {(island.cuts[i], k, island.cuts[j]): c for c, (i, j, k, _) in enumerate(island.candidates)}
            if all(s in place for s in mine) and island.candidates:
                truth.append((island, {place[s] for s in mine}))
    if not truth:
        return weights
    squares = np.full_like(weights, 1e-6)
    for _ in range(STEPS):
        gradient = L2 * len(truth) * weights
        for island, gold in truth:
            chance, _ = island.expected(weights)
            for c, (*_, f) in enumerate(island.candidates):
                gradient[f] += chance[c] - (c in gold)
        gradient /= len(truth)
        squares += gradient**2
        weights -= 0.5 * gradient / np.sqrt(squares)
    return weights


def all_spans(text: str, weights: np.ndarray) -> tuple[list[Span], list[Span]]:
    """(base spans, base spans and those that the field adds)."""
    if TRIGGER.search(text) is None:
        return [], []
    base, _ = base_spans(text)
    added = []
    for begin, end in untaken(islands(text), base):
        # nothing to add where too few digits are left
        if "@" in text[begin:end] or sum(map(str.isdigit, text[begin:end])) >= 4:
            added += Island(text, begin, end).best(weights)
    return base, sorted(base + added)


def untaken(parts: Iterable[tuple[int, int]], spans: list[Span]) -> Iterator[tuple[int, int]]:
    """What the spans leave of the parts; both are in order, and both are gone through once."""
    k = 0
    reach = 0  # how far the spans seen so far take the text
    for begin, end in parts:
        begin = max(begin, min(reach, end))
        while k < len(spans) and spans[k][0] < end:
            if begin < spans[k][0]:
                yield begin, spans[k][0]
            reach = max(reach, spans[k][2])
            begin = max(begin, min(reach, end))
            k += 1
        if begin < end:
            yield begin, end


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def train(docs: DataFrame) -> np.ndarray:
    """The weights from a bounded sample: its keys are chosen first, so that no task holds more texts than these."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike("[0-9@]"))
    keyed = known.select("doc_id", F.xxhash64("text").alias("key"), "text")
    some = keyed.select("doc_id", "key").distinct().orderBy(F.xxhash64("doc_id"), "doc_id", "key").limit(MOST_DOCS)
    # repeated rows of a key are one text
    texts = keyed.join(some, ["doc_id", "key"]).groupBy("doc_id", "key").agg(F.min("text").alias("text"))
    found = texts.select(F.xxhash64("doc_id").alias("place"), "doc_id", "key", "text").toLocalIterator()
    return fit([r.text for r in sorted(found, key=lambda r: (r.place, r.doc_id, r.key))])


def find_pii(docs: DataFrame) -> DataFrame:
    """A row per document: doc_id, the counts and the digest of base spans, and all spans as text."""
    sent = docs.sparkSession.sparkContext.broadcast(train(docs))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [all_spans(t or "", sent.value) for t in batch.column(1).to_pylist()]
            counts = [pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k in range(4)]
            digest = [hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found]
            arrays = [batch.column(0), *counts, pa.array(digest, pa.string()), pa.array([written(x) for _, x in found], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, NAMES)

    schema = "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)


NAMES = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]


@register("op6_pii")
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(read(spark, sf_dir, "documents"))
