"""Base spans against the patterns as given, the sums against all segmentations, what the field adds."""

import itertools
import random
import re
import time

import numpy as np
import pytest

from tidemark.llm import pii

GIVEN = [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]


def plain(text):
    out = []
    for k, pattern in enumerate(GIVEN):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if k == 1 and max(map(int, m.group().split("."))) > 255:
                continue
            if k == 2 and not (14 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0):
                continue
            if k == 3 and not 10 <= len(d) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_against_patterns():
    rng = random.Random(11)
    alphabets = ["ab@.-_", "a@b.c", "0123456789.", "12. +-()", "+1 ()-.9", "4111 1-", "é@a.b 1"]
    for _ in range(6000):
        text = "".join(rng.choices(rng.choice(alphabets), k=rng.randint(0, 60)))
        assert pii.base_spans(text)[0] == plain(text), text


def test_long_texts_take_linear_time():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "1." * 150_000, "@a" * 100_000, "+" * 300_000, "a.b@" * 50_000):
        pii.base_spans(text)


@pytest.mark.parametrize("zeros", [0, 1, 3, 300, 5000])
def test_numbers_with_leading_zeros(zeros):
    text = f"x {'0' * zeros}255.1.1.1 {'0' * zeros}256.1.1.1 {'0' * (zeros + 1)}.0.0.0"
    spans = [text[a:b] for a, k, b in pii.base_spans(text)[0] if k == 1]
    assert [s.lstrip("0") for s in spans] == ["255.1.1.1", ".0.0.0"]


def test_octets():
    assert [pii.is_octet(x) for x in ("0", "00", "255", "0255", "256", "1000", "0" * 9999, "9" * 9999)] == [True] * 4 + [False] * 2 + [True, False]


LONG = {
    "addresses": "ab12@mail.example.com\n" * 95_000,
    "one island": "a@b.co " * 300 + "12345 " + "a@b.co " * 290_000,
    "addresses in lines": "10.1.2.3 x\n" * 180_000,
    "one word": "a1" * 500_000,
    "digits": "7" * 2_000_000,
    "at signs": "@" * 2_000_000,
    "bare numbers": "4567 " * 60_000,
}


@pytest.mark.parametrize("name", LONG)
def test_all_spans_of_two_megabytes_take_seconds(name, weights):
    began = time.monotonic()
    base, both = pii.all_spans(LONG[name], weights)
    assert set(base) <= set(both) and time.monotonic() - began < 60


def plain_untaken(text, spans):
    """The islands without all places of the spans, by marking every place."""
    taken = {i for a, _, b in spans for i in range(a, b)}
    out = []
    for begin, end in pii.islands(text):
        free = [i for i in range(begin, end) if i not in taken]
        for i in free:
            if out and out[-1][1] == i and i > begin and i - 1 not in taken:
                out[-1] = (out[-1][0], i + 1)
            else:
                out.append((i, i + 1))
    return out


def test_what_the_spans_leave():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices(["1", "12.3.4.5", "a@b.co", " ", "  ", "+1 (212) 555-0123", "x", "4111111111111111", "."], k=rng.randint(0, 14)))
        spans, _ = pii.base_spans(text)
        assert list(pii.untaken(pii.islands(text), spans)) == plain_untaken(text, spans), text


def test_islands():
    text = "word 12 (3) x 4@b\n5 6  7é8 end"
    assert [text[a:b] for a, b in pii.islands(text)] == ["12 (3)", "4@b", "5 6", "7é8"]
    assert list(pii.islands("")) == [] == list(pii.islands("no such word"))


def test_sums_against_all_segmentations():
    rng = np.random.default_rng(12)
    text = "+1 (20) 555-0123 45"
    island = pii.Island(text, 0, len(text))
    weights = rng.normal(size=len(pii.KINDS) * pii.N_FEATURES) * 0.2
    score = island.scores(weights)
    n, total, chance, best = len(island.candidates), 0.0, np.zeros(len(score)), (-1e9, None)
    for size in range(4):
        for some in itertools.combinations(range(n), size):
            spans = sorted(island.candidates[c][:2] for c in some)
            if any(a[1] > b[0] for a, b in zip(spans, spans[1:])):
                continue
            w = sum(score[c] for c in some)
            total += np.exp(w)
            chance[list(some)] += np.exp(w)
            best = max(best, (w, sorted((island.cuts[island.candidates[c][0]], island.candidates[c][2], island.cuts[island.candidates[c][1]]) for c in some)))
    got, logz = island.expected(weights)
    assert np.isclose(logz, np.log(total)) and np.allclose(got, chance / total)
    assert island.best(weights) == best[1]


@pytest.fixture(scope="module")
def weights():
    rng = random.Random(13)

    def card():
        d = "4" + "".join(rng.choices("0123456789", k=14))
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    texts = []
    for k in range(300):
        kind = rng.randrange(6)
        phone = f"+1 ({rng.randint(200, 989)}) 555-{rng.randint(0, 9999):04d}"
        ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        item = [phone, card(), ip, f"ab{k}@mail{k % 9}.example.com", "%032x" % rng.getrandbits(128), f"version {k}.0."][kind]
        texts.append(f"some words {item} and more")
    return pii.fit(texts)


def test_added_spans(weights):
    phone, card = "+1 (212) 555-0123", "4111111111111111"
    for text in (f"call {phone} {card} now", f"{phone} {card}"):
        at = text.index("+")
        assert pii.base_spans(text)[0] == []
        both = pii.all_spans(text, weights)[1]
        assert both == [(at, 3, at + len(phone)), (at + len(phone) + 1, 2, at + len(phone) + 1 + len(card))]
    clean = "Licensed under CC BY-NC 4.0. token 4aee7877f816035eb54cd1071cac in 2024, 100 200 300"
    assert pii.all_spans(clean, weights) == ([], [])


def test_sample_of_repeated_rows_and_missing_ids(spark):
    """A third of the rows without an id, a third with one id, some with one id and different texts: each text counts once."""
    rows = [(None, "call +1 (212) 555-0123")] * 50 + [(7, "mail ab@c.example.com")] * 50 + [(8, f"ip 10.0.0.{k}") for k in range(50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = pii.train(df)
    texts = sorted({(t) for i, t in rows if i is not None})
    assert np.abs(got).sum() > 0 and not got[3 * pii.N_FEATURES :].any()  # no phone was learned from
    assert np.allclose(np.abs(got).sum(), np.abs(pii.fit(texts)).sum())
    assert not pii.train(df.limit(0)).any()


def test_rows(spark):
    rows = [(1, None, "x"), (2, "", "x"), (None, "a@b.co", "x"), (3, "ü a@b.co 1.2.3.4", "x"), (3, "ü a@b.co 1.2.3.4", "x"), (4, "1 " * 2_000, "x")]
    out = pii.find_pii(spark.createDataFrame(rows, "doc_id long, text string, spans string")).collect()
    assert len(out) == 6
    got = {r.doc_id: (r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans) for r in out}
    assert got[3] == (1, 1, 0, 0, "email:2:8,ip:9:16") and got[None] == (1, 0, 0, 0, "email:0:6") and got[1] == got[2] == (0, 0, 0, 0, "")
    assert pii.find_pii(spark.createDataFrame([], "doc_id long, text string")).collect() == []
