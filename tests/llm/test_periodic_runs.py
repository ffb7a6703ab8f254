"""Runs against a search through all lags and all smaller periods, and whole rows of odd texts."""

import hashlib
import random
import re
import time
import zlib
from fractions import Fraction

import numpy as np

from tidemark.llm.periodic_runs import collapse_runs, op12_periodic_runs, runs_of

EMPTY = hashlib.sha256(b"").hexdigest()


def plain_runs(words):
    """All stretches of at least max(6, 4 * q) words with smallest period q that cannot be widened."""
    found = []
    for q in range(1, len(words) // 4 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            part = words[i : j + q]
            if j > i and len(part) >= max(6, 4 * q):
                if not any(all(x == y for x, y in zip(part, part[p:])) for p in range(1, q)):
                    found.append((i, len(part), q))
            i = max(j, i + 1)
    return sorted(found, key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        g = h // 10
        a = g % len(words)
        p = 1 + (len(words) - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
    runs = plain_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None, None, None))
    milli = 1000 * best[1] // best[2] if runs else None
    left = " ".join(w for i, w in enumerate(words) if i not in gone)
    return (doc_id, len(words), len(runs), *best, milli, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(left))


def test_random_words_against_search():
    rng = random.Random(5)
    for _ in range(1500):
        few, words = rng.choice([1, 2, 3, 5]), []
        while len(words) < rng.randint(0, 90):
            if rng.random() < 0.5:
                words += [rng.randrange(few) for _ in range(rng.randint(1, 12))]
            else:
                words += [rng.randrange(few + 9) for _ in range(rng.randint(1, 9))] * rng.randint(2, 7)
        both = [np.array(words, np.int64), np.array(words[::-1], np.int64)]
        assert runs_of(both) == [plain_runs(words), plain_runs(words[::-1])]


def test_nested_and_touching_runs():
    words = ([1] * 7 + [2]) * 4 + [3, 4] * 4 + [4] * 6
    found = runs_of([np.array(words, np.int64)])[0]
    assert found == plain_runs(words)
    assert (0, 32, 8) in found and (0, 7, 1) in found and (32, 8, 2) in found


def test_a_million_words_in_seconds():
    rng = np.random.default_rng(1)
    words = rng.integers(0, 2000, 1_000_000)
    words[200_000:] = words[200_000 + np.arange(800_000) % 200_000]
    began = time.monotonic()
    assert runs_of([words])[0] == [(200_000, 800_000, 200_000)]
    assert time.monotonic() - began < 30


def test_rows(spark):
    damaged = [i for i in range(400) if zlib.crc32(str(i).encode()) % 10 == 0][:6]
    whole = next(i for i in range(400) if zlib.crc32(str(i).encode()) % 10)
    rng = random.Random(2)
    some = lambda n: " ".join(rng.choices(["a", "bé", "c d", "e", "f"], k=n))
    rows = [(i, some(80)) for i in damaged] + [(whole, t) for t in ("", "  \n", None, "x " * 6, "x " * 5, some(300), "q\x1fr " * 8)]
    rows += [(whole, "x " * 6), (damaged[0], None), (damaged[1], "one"), (damaged[2], " ".join(f"w{i}" for i in range(5000)))]
    schema = "doc_id long, text string, start string, n_runs string"
    got = collapse_runs(spark.createDataFrame([(*r, "", None) for r in rows], schema), repeat_tails=True).drop("collapsed")
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str(plain_row(*r)) for r in rows)
    empty = collapse_runs(spark.createDataFrame([(whole, None)], "doc_id long, text string")).first()
    assert (empty.n_words, empty.n_runs, empty.period, empty.runs_sha256, empty.collapsed_sha256) == (0, 0, None, EMPTY, EMPTY)
    null_id = collapse_runs(spark.createDataFrame([(None, "a b c d e f g")], "doc_id long, text string"), True).first()
    assert (null_id.doc_id, null_id.n_runs, null_id.collapsed) == (None, 0, "a b c d e f g")
    assert collapse_runs(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_query_against_search(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 60)))) for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = op12_periodic_runs(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(plain_row(*r) for r in rows)
