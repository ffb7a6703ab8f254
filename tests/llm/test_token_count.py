"""Counts against the greedy longest-match model of a public library and against a plain search."""

import random

from pyspark.sql import types as T

from tidemark.llm.token_count import UNKNOWN, WORD, Automaton, count_pieces, load_vocabulary


def greedy(word, initial, continuation):
    at, n = 0, 0
    while at < len(word):
        pieces = continuation if at else initial
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1 + UNKNOWN
        at, n = end, n + 1
    return n


def test_small_alphabet_against_search():
    rng = random.Random(1)
    for _ in range(60):
        some = lambda n: ["".join(rng.choices("abc", k=rng.randint(1, 5))) for _ in range(n)]
        initial, more = some(rng.randint(1, 8)), some(rng.randint(0, 8))
        automaton = Automaton(initial, more)
        for word in some(40) + ["abcabcabc" * 3]:
            assert automaton.count(word) == greedy(word, set(initial), set(more)), (initial, more, word)


def test_against_library():
    from tokenizers import models

    initial, more = load_vocabulary()
    vocab = {p: i for i, p in enumerate([*dict.fromkeys(initial), *("##" + p for p in dict.fromkeys(more)), "[UNK]"])}
    model = models.WordPiece(vocab=vocab, unk_token="[UNK]", max_input_chars_per_word=10_000)
    automaton = Automaton(initial, more)
    rng = random.Random(2)
    words = ["international", "préférence", "straße", "x" * 300, "日本", "ñandú", "zzzqqq", "a"]
    words += ["".join(rng.choices("etaoinshrdlu", k=rng.randint(1, 30))) for _ in range(500)]
    for word in words:
        assert automaton.count(word) & (UNKNOWN - 1) == len(model.tokenize(word)), word


def test_rows(spark):
    schema = T.StructType(
        [T.StructField(c, t) for c, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("n_tokens", T.StringType()))]
    )
    long = "the cat, " * 20_000
    rows = [(1, None, "a"), (2, "", "b"), (None, "the cat", "c"), (3, "the cat", None), (3, "the cat", None), (4, long, "")]
    got = count_pieces(spark.createDataFrame(rows, schema)).collect()
    automaton = Automaton(*load_vocabulary())
    want = {t: sum(automaton.count(w) for w in WORD.findall(t or "")) for _, t, _ in rows}
    assert sorted((r.doc_id or 0, r.n_words, r.n_tokens) for r in got) == sorted(
        (i or 0, len(WORD.findall(t or "")), want[t]) for i, t, _ in rows
    )
    assert count_pieces(spark.createDataFrame([], schema)).collect() == []
