"""Ids against the library that the model file belongs to, for whole texts and for texts split into tiny chunks."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from tidemark.llm import sentencepiece_scan as sp

SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_tokens", T.StringType())]
)


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=sp.MODEL)


def some_texts():
    rng = random.Random(3)
    texts = ["", " ", "   ", "a", " a", "a  b   c    d", "\n\n\t x", "naïve café ñandú straße", "日本語 テキスト", "🙂🙃 　"]
    texts += ["<s> </s> <0x41> <unk>", "x" * 700, "ab" * 400, "-" * 300 + "=" * 99, "don't stop  now  ", "international" * 30]
    alphabets = ["etaoin shrdlu", "ab ", "  a", "éàü ß日本x", "0123456789 .,", "the in er re on "]
    for _ in range(150):
        texts.append("".join(rng.choices(rng.choice(alphabets), k=rng.randint(1, 90))))
    return texts


def test_whole_texts(library):
    model = sp.Model()
    for text in some_texts():
        ids = model.encode(text).tolist()
        assert ids == library.encode(text), text
        assert model.decode(ids) == library.decode(ids) == text


def test_every_boundary(library):
    """A matrix scan over chunks of a few code points, in one process."""
    model = sp.Model()
    rng = random.Random(4)
    for text in some_texts():
        if not text:
            continue
        size = rng.choice([1, 2, 3, 5, 8, 21])
        s = sp.escaped(text)
        cuts = [*range(0, len(s), size), len(s)]
        spans = [(b, e) for b, e in zip(cuts[:-1], cuts[1:])]
        ms = [sp.matrix(model, s, b, e, e == len(s)) for b, e in spans]
        total = ms[0]
        for m in ms[1:]:
            total = sp.product(total, m)
        (p, o, q, r, w), = [x for x in total if x[:2] == (sp.START, 0)]
        states = sp.boundary_states(ms, (p, o), (q, r))
        ids = []
        for (b, e), entry, leave in zip(spans, states[:-1], states[1:]):
            ids += sp.chunk_ids(model, s, b, e, entry, leave)[0].tolist()
        assert ids == library.encode(text), (text, size)


def test_product_is_associative():
    rng = random.Random(5)
    make = lambda: [(rng.randint(0, 3), 0, rng.randint(0, 3), 0, float(rng.randint(-5, 0))) for _ in range(8)]
    for _ in range(100):
        a, b, c = make(), make(), make()
        assert sorted(sp.product(sp.product(a, b), c)) == sorted(sp.product(a, sp.product(b, c)))


def test_rows(spark, library):
    texts = some_texts()[:40]
    rows = [(k, t, "own") for k, t in enumerate(texts)]
    rows += [(900, None, None), (901, "word " * 3000, None), (901, "word " * 3000, None), (901, "other " * 500, None)]
    rows += [(None, "x" * 2500, None), (None, "y z" * 1000, None)]
    out = sp.encode(spark.createDataFrame(rows, SCHEMA), chunk=40, fan=3).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.token_ids, r.n_tokens, r.round_trip) for r in out)
    want = [library.encode(t or "") for _, t, _ in rows]
    assert got == sorted((-1 if i is None else i, x, len(x), True) for (i, _, _), x in zip(rows, want))
    back = sp.decode(spark.createDataFrame(out)).collect()
    assert sorted(r.text for r in back) == sorted(t or "" for _, t, _ in rows)


def test_empty_table(spark):
    assert sp.encode(spark.createDataFrame([], SCHEMA)).collect() == []


def test_cuts_between_letters_and_marks_change_no_ids(library):
    model = sp.Model()
    rng = random.Random(8)
    parts = ["the", "Straße", "l'été", "e.g", "don't", "http://a.b", "x", "Ж", "日本", "\u0301", " ", "  ", "\n", "\t", ".", ",", "...", "-", "'", "(", ")", "9", "0.5", "\U0001f600"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(3000)]
    for text, ids in zip(texts, library.encode(texts, num_threads=1)):
        got, same = model.encode_checked(text)
        assert model.encode(text).tolist() == np.frombuffer(got, np.int32).tolist() == ids, text
        assert same == (model.decode(ids) == text)
    assert model.encode_checked("a\u2581b")[1] is False and model.encode_checked("") == (b"", True)
