"""The join against all pairs; signatures against pairs at the edge of the similarity; hot groups."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import jaccard_join as jj

SCHEMA = T.StructType(
    [T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("node", T.StringType()), ("component_id", T.StringType()))]
)


def plain_set(text, k=5):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1)))


def plain_components(rows):
    sets = [(i, plain_set(t)) for i, t in rows]
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for (i, a), (j, b) in itertools.combinations(sets, 2):
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return sorted((i, len(s), root(i)) for i, s in sets)


@pytest.mark.parametrize("strong", [False, True])
def test_similar_sets_share_a_signature(strong):
    rng = np.random.default_rng(7)
    for trial in range(1500):
        n = int(rng.integers(1, 40 if trial % 2 else 700))
        common = int(rng.integers(max(1, int(n * 0.8)), n + 1))
        more = int(rng.integers(0, n // 4 + 1))
        h = np.unique(rng.integers(0, 2**64, n + more, dtype=np.uint64))
        a, b = h[rng.permutation(len(h))][:n], None
        b = np.concatenate([rng.permutation(a)[:common], np.setdiff1d(h, a)[:more]])
        if 100 * len(np.intersect1d(a, b)) < 80 * len(np.union1d(a, b)):
            continue
        sa, sb = (jj.signatures(np.sort(x), strong) for x in (a, b))
        assert len(np.intersect1d(sa, sb)), (n, common, more)
        apart = sum(bin((x ^ y) & (2**64 - 1)).count("1") for x, y in zip(jj.parities(a), jj.parities(b)))
        assert apart <= len(np.setxor1d(a, b))


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"w{rng.randrange(10**9)}"
    return " ".join(words)


def test_against_all_pairs(spark):
    rng = random.Random(8)
    vocabulary = [f"v{k}" for k in range(300)]
    rows = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.choice([3, 5, 6, 9, 30, 120, 260]))
        rows += [edited(rng, base, rng.choice([0, 0, 1, 2, 4])) for _ in range(rng.randint(1, 7))]
    passage = rng.choices(vocabulary, k=60)
    rows += [" ".join(rng.choices(vocabulary, k=25) + passage) for _ in range(40)]
    chain = rng.choices(vocabulary, k=200)
    for k in range(6):  # each similar to the next, the ends not
        chain[k * 7] = f"c{k}"
        rows.append(" ".join(chain))
    rows += ["A b\tC", "a B c\n", "", "  \t", "x"]
    pairs = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, None, None) for i, t in pairs], SCHEMA)
    want = plain_components(pairs)
    for small in (2,):  # 2: most buckets go the way of the large ones
        got = jj.components(docs, small=small).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == want


def test_hot_group(spark):
    """Hundreds of near copies and of texts that share most of their words are split right."""
    rng = random.Random(9)
    base = [f"b{k}" for k in range(80)]
    rows = [edited(rng, base, 1) for _ in range(150)] + [edited(rng, base, 9) for _ in range(60)] + [" ".join(base)] * 50
    pairs = list(enumerate(rows))
    docs = spark.createDataFrame([(i, t, None, None) for i, t in pairs], SCHEMA)
    got = jj.components(docs, small=4).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(pairs)


def test_odd_rows(spark):
    text = "one two three four five six seven eight"
    other = "quite another text with its own words here"
    rows = [(5, text), (5, text), (3, text), (None, text), (None, other), (None, None), (7, None), (8, "")]
    rows += [(9, other), (9, "a third text that has the same number again"), (10, "a third text that has the same number again")]
    rows += [(11, "long " * 100_000), (12, "LONG " * 100_000)]
    docs = spark.createDataFrame([(i, t, "own", "own") for i, t in rows], SCHEMA)
    out = jj.components(docs).collect()
    assert len(out) == len(rows)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in out}
    assert got[5, 4] == got[3, 4] == got[None, 4] == 3 or got[None, 4] == 9
    assert got[7, 0] == 7 and got[8, 0] == 8 and got[None, 0] is None
    assert got[9, 4] == got[9, 5] == got[10, 5] == 9
    assert got[11, 1] == got[12, 1] == 11
    assert jj.components(docs.limit(0)).collect() == []


def test_wide_parities_never_exceed_the_differences(spark):
    """Long sets of one or two bands: the sketch differs in at most as many places as the sets, and in many if they are apart."""
    import numpy as np
    from pyspark.sql import functions as F

    from tidemark.llm.jaccard_join import wide_apart, wide_parities

    rng = np.random.Generator(np.random.PCG64(5))
    rows = []
    for n, m, shared in [(2000, 2100, 1900), (4000, 4200, 4000), (2040, 2060, 1000), (3000, 3000, 3000), (5000, 5000, 0)]:
        pool = rng.integers(0, 2**63, n + m - shared, dtype=np.uint64)
        rows.append((wide_parities(pool[:n]), wide_parities(pool[n - shared :]), n + m - 2 * shared))
    assert len(rows[1][0]) * 2 == len(rows[1][1])
    assert wide_parities(pool[:1000]) is None
    found = spark.createDataFrame(rows, "p array<bigint>, q array<bigint>, d int")
    got = [tuple(r) for r in found.select(wide_apart(F.col("p"), F.col("q")), "d").collect()]
    assert all(k <= d for k, d in got)
    assert got[3][0] == 0 and all(k > 0.4 * d for k, d in got[:2])
    none = found.select(wide_apart(F.col("p"), F.lit(None).cast("array<bigint>")).alias("k"))
    assert none.where("k is not null").isEmpty()


def similar_pair(rng, n):
    """Two sets of about n elements whose similarity is just 0.8 or more."""
    a = rng.integers(0, 2**63, n, dtype=np.uint64)
    most = jj.most_differences(n)
    gone, new = int(rng.integers(0, most + 1)), int(rng.integers(0, most + 1))
    b = np.concatenate([a[gone:], rng.integers(0, 2**63, new, dtype=np.uint64)])
    return np.unique(a), np.unique(b)


def test_similar_sets_share_more_signatures_than_each_can_spare():
    rng, tried = np.random.default_rng(4), 0
    for _ in range(6000):
        a, b = similar_pair(rng, int(rng.integers(1, 400)))
        common = len(np.intersect1d(a, b))
        if not common or 100 * common < jj.PERCENT * (len(a) + len(b) - common):
            continue
        tried += 1
        shared = np.intersect1d(jj.signatures(a, False), jj.signatures(b, False))
        promised = []
        for h in (a, b):
            for band, spare in zip(jj.bands_of(len(h)), jj.spare_signatures(h)):
                promised.append((band, spare))
        both = set(jj.bands_of(len(a))) & set(jj.bands_of(len(b)))
        assert both
        for band in both:
            own = int((shared & np.uint64(1) == np.uint64(band & 1)).sum())
            assert own > max(s for x, s in promised if x == band), (len(a), len(b), common, band)
    assert tried > 1500


def check(spark, rows, **options):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jj.components(docs, **options).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == plain_components(rows)


def test_hot_passage_loses_no_link(spark):
    """Most documents hold one passage: its signatures are the most frequent ones and go first."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(40))
    rows = []
    for k in range(150):
        own = [f"w{rng.randrange(10**6)}" for _ in range(rng.choice([15, 40, 120]))]
        rows.append((len(rows) + 1, " ".join(own) + " " + passage))
        for _ in range(rng.choice([0, 0, 1, 3])):
            changed = list(own)
            for _ in range(rng.randint(0, 3)):
                changed[rng.randrange(len(changed))] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows) + 1, " ".join(changed) + " " + passage))
    check(spark, rows)


def test_large_group_of_near_copies_in_small_blocks(spark, monkeypatch):
    """Copies that each differ in a few words, near the threshold, in blocks of few nodes and with many rounds."""
    monkeypatch.setattr(jj._across_close, "__defaults__", (7,))
    rng = random.Random(10)
    base = [f"b{k}" for k in range(100)]
    rows = []
    for k in range(160):
        own = list(base)
        for _ in range(rng.randint(1, 5)):
            own[rng.randrange(100)] = f"x{rng.randrange(10**6)}"
        rows.append((k + 1, " ".join(own)))
    check(spark, rows, small=2)


def test_bucket_of_a_third_of_all_rows_is_split(spark):
    n = 60_000
    rows = spark.range(0, n, 1, 6).selectExpr("IF(id % 3 = 0, 7L, id) AS sig", "id AS node")
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        df = jj.joined_apart(rows, rows.groupBy("sig").agg(F.min("node").alias("a")), "sig")
        assert df.where("sig = 7").count() == n // 3 + 1
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class _Columns:
    """Stands for a table whose rows a test gives itself."""

    def select(self, *columns):
        return self


@pytest.mark.parametrize("step", ["with_sets", "signed"])
def test_texts_of_a_batch_are_hashed_together(spark, monkeypatch, step):
    """The array operations of a batch do not grow with its texts (they took most of the time)."""
    import pyarrow as pa

    calls, mix = [], jj.mix
    monkeypatch.setattr(jj, "mix", lambda h: calls.append(len(h)) or mix(h))
    monkeypatch.setattr(jj, "map_arrow", lambda df, rows, schema: rows)
    rng, took = random.Random(11), []
    for count in (20, 400):
        texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(rng.randint(100, 300))) for _ in range(count)]
        columns = {"doc_id": pa.array(range(count), pa.int64()), "text": pa.array(texts)}
        if step == "signed":
            del columns["doc_id"]
        rows = jj.with_sets(_Columns()) if step == "with_sets" else jj.signed(_Columns(), False, 80)
        calls.clear()
        assert sum(b.num_rows for b in rows(iter([pa.RecordBatch.from_pydict(columns)]))) >= count
        took.append(len(calls))
    assert took[1] <= took[0] + 5


def test_sets_of_a_batch_are_those_of_single_texts():
    rng = random.Random(12)
    texts = ["", "a", "a b", "A b c d", "a b c d e", " ", "x " * 100, "p q q p z", "q p p q z", "u" * 70_000 + " v"]
    texts += [" ".join(rng.choices("abcdefgh", k=rng.choice([0, 3, 5, 9, 40, 70, 1500]))) for _ in range(300)]
    h, n = jj.flat_sets([t.encode() for t in texts])
    assert n.tolist() == [len(plain_set(t)) for t in texts]
    sets = np.split(h, np.cumsum(n)[:-1])
    assert len({x.tobytes() for x in sets}) == len({plain_set(t) for t in texts})
    assert [len(np.intersect1d(a, b)) for a, b in zip(sets, sets[1:])] == [
        len(plain_set(a) & plain_set(b)) for a, b in zip(texts, texts[1:])
    ]
    sigs, of = jj.flat_signatures(h, n)
    parities, spare, nodes = jj.flat_parities(h, n), jj.flat_spare(h, n), jj.set_hashes(h, n)
    for k, x in enumerate(sets):
        assert set(sigs[of == k].tolist()) == (set(jj.signatures(x, False).tolist()) if len(x) else set())
        if len(x):
            assert parities[k].tolist() == jj.parities(x) and spare[k].tolist() == jj.spare_signatures(x)
            assert nodes[k] == jj.set_hashes(x, np.array([len(x)]))[0]
    assert [len(x) for x in jj.flat_sets([])] == [len(x) for x in jj.flat_signatures(*jj.flat_sets([b"", b" "]))] == [0, 0]


def test_word_hashes_follow_their_formula():
    """The sum of byte value times base^(place + 1), mixed; also of words longer than a slice and across its end."""
    from tidemark.llm import hashing

    def plain(word):
        total = sum(int(hashing._BYTE[b]) * pow(int(hashing._BASE), k + 1, 2**64) for k, b in enumerate(word)) + len(word)
        return int(hashing.mix(np.array([total % 2**64], np.uint64))[0])

    texts = [b"Ab c", b"", b"x" * 70_000 + b" y", b"\xc3\x89t\xc3\xa9 " * 9_000, b"z" * 140_000]
    found, counts = hashing.word_hashes(texts, jj.WORD)
    assert counts.tolist() == [2, 0, 2, 9000, 1]
    known = {}
    for h, w in zip(found.tolist(), b" ".join(texts).lower().split()):
        assert h == known.setdefault(w, plain(w))


def test_components_stop_when_the_edges_are_stars(spark, monkeypatch):
    from tidemark.llm import common

    names, plain = [], common.stored
    monkeypatch.setattr(common, "stored", lambda df, name: names.append(name) or plain(df, name))
    for edges in ([(1, x) for x in range(2, 30)], [(30 - x, 30) for x in range(1, 29)]):
        names.clear()
        found = common.connected_components(spark.createDataFrame(edges, "a long, b long"))
        want = min(min(e) for e in edges)
        assert {(r.node, r.component) for r in found.collect()} == {(x, want) for e in edges for x in e}
        assert len(names) == 2  # the edges and one round
    assert not common.are_stars(spark.createDataFrame([(3, 1), (3, 2)], "u long, v long"))
    assert not common.are_stars(spark.createDataFrame([(2, 1), (3, 2)], "u long, v long"))
    assert common.are_stars(spark.createDataFrame([(2, 1), (3, 1), (5, 4)], "u long, v long"))


def test_components_of_random_edges(spark):
    from tidemark.llm.common import connected_components

    rng = random.Random(3)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(1000 + x, 1001 + x) for x in range(40)]
    parent = {x: x for e in edges for x in e}

    def root(x):
        return x if parent[x] == x else root(parent[x])

    for a, b in edges:
        low, high = sorted((root(a), root(b)))
        parent[high] = low
    loose = {x for a, b in edges if a == b for x in (a,)} - {x for a, b in edges if a != b for x in (a, b)}
    found = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert sorted((r.node, r.component) for r in found) == sorted((x, root(x)) for x in parent if x not in loose)
