"""Repairs against all edits of short conversations and against the SQL, whole and in chunks."""

import hashlib
import itertools
import random
import re
import time
from collections import defaultdict

import pytest

from tidemark.llm import conversation_repair as R

duckdb = pytest.importorskip("duckdb")
SCHEMA = "conv_id long, turn long, role string, text string"


def all_edits(rows, inserts=3):
    """The cheapest edits of rows (initial, gone, truncated), then the first by their letters: tries all of them."""
    best = None
    for counts in itertools.product(range(inserts), repeat=len(rows) + 1):
        if sum(counts) > inserts:
            continue
        for letters in itertools.product("DKR", repeat=len(rows)):
            if any(gone and x != "D" for (_, gone, _), x in zip(rows, letters)):
                continue
            kept, cost = [], 5 * sum(counts)
            for (initial, _, truncated), x, n in zip(rows, letters, counts):
                kept += ["?"] * n + ([initial] if x == "K" else ["?"] if x == "R" else [])
                cost += {"D": 2, "K": 0, "R": 1}[x] + 5 * (truncated and x != "D")
            kept += ["?"] * counts[-1]
            for role in itertools.product("ua", repeat=kept.count("?")):
                role = iter(role)
                if re.fullmatch("(s?(ua)+)?", "".join(next(role) if x == "?" else x for x in kept)):
                    audit = "".join("I" * n + x for n, x in zip(counts, (*letters, "")))
                    best = min(best or (cost, audit), (cost, audit))
                    break
    return best


def plain(rows, end=R.END):
    lattice = R.Lattice([(i, not gone, cut, int(gone)) for i, gone, cut in rows])
    letters, cost, _ = R.traced(lattice, end, True, (R.NOTHING,))[0]
    return cost, letters


def some_rows(rng, n):
    return [(rng.choice("suaaux"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(n)]


def test_short_conversations_against_all_edits():
    rng = random.Random(1)
    for _ in range(150):
        rows = some_rows(rng, rng.randint(0, 4))
        assert plain(rows) == all_edits(rows), rows


def test_distances_against_relaxation():
    rng = random.Random(2)
    for _ in range(40):
        lattice = R.Lattice([(i, not gone, cut, int(gone)) for i, gone, cut in some_rows(rng, rng.randint(1, 40))])
        square = R.matrix(lattice)
        for to in R.STATES:
            far = [R.FAR] * (len(lattice.arcs) + 4)
            far[len(lattice.arcs) + to] = 0
            for _ in range(2):  # inserts go from state to state of a layer
                for _ in range(3):
                    for node in reversed(range(len(lattice.arcs))):
                        far[node] = min(far[node], *(cost + far[head] for cost, _, head in lattice.arcs[node]))
            assert [square[4 * s + to] for s in R.STATES] == far[:4]


def test_work_is_linear_in_the_rows():
    rows = [("u", True, False, 0)] * 20_000 + [("a", True, True, 3)] * 20_000
    began = time.monotonic()
    letters, cost, _ = R.traced(R.Lattice(rows), R.END, True, (R.NOTHING,))[0]
    assert time.monotonic() - began < 20
    assert cost == 10_000 + 2 * 20_000 * 4 and letters == "KR" * 10_000 + "DDDD" * 20_000


def table(spark, rng, path, giant=0, extra=False):
    roles, texts = ["user", "assistant", "system", "tool", None, ""], ["", " \n", "Yes.", "No", "why? ", None, "Ü\x1f", "a.b"]
    rows = []
    for conv in [*range(60), None, -4]:
        for _ in range(rng.randint(1, 9)):
            turn = rng.choice([None, *range(-2, 9)])
            rows.append((conv, turn, rng.choice(roles[:3] * 4 + roles), rng.choice(texts) if rng.random() < 0.5 else f"t{rng.random()}."))
    for turn in range(giant):
        odd = rng.random() < 0.2
        rows.append((17, turn if turn % 7 else turn - 1, rng.choice(roles) if odd else roles[turn % 2], rng.choice(texts) if odd else f"g{turn}."))
    rows += rows[:20] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    if extra:
        df = df.selectExpr("*", "'x' AS digest", "1 AS times_", "'y' AS c", "2 AS first")
    df.repartition(3).write.parquet(f"{path}/conversations.parquet")
    return df


def by_sql(path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet/*.parquet'")
    found = con.execute(R.ORACLE)
    return [c[0] for c in found.description], sorted(map(str, found.fetchall()))


@pytest.mark.parametrize("chunk, fan, giant", [(1024, 256, 0), (4, 2, 120)])
def test_table_against_sql(spark, tmp_path, chunk, fan, giant):
    table(spark, random.Random(giant), tmp_path, giant, extra=True)
    conversations = spark.read.parquet(f"{tmp_path}/conversations.parquet")
    report, lines = R.repair(R.damaged(conversations), chunk, fan)
    columns, want = by_sql(tmp_path)
    got = R.for_all(conversations, report).select(*columns).collect()
    assert sorted(str(tuple(r)) for r in got) == want
    texts = defaultdict(list)
    for r in lines.orderBy("n", "k").collect():
        texts[r.conv_id].append(f"{r.role}:{r.text}")
    for r in got:
        assert r.repaired_sha256 == hashlib.sha256("\n".join(texts[r.conv_id]).encode()).hexdigest()
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in texts[r.conv_id]))


def test_query_against_sql(spark, tmp_path):
    table(spark, random.Random(9), tmp_path)
    columns, want = by_sql(tmp_path)
    assert sorted(str(tuple(r)) for r in R.op11_conversation_repair(spark, str(tmp_path)).select(*columns).collect()) == want


def test_repeated_rows_and_empty_table(spark):
    rows = [(1, 0, "user", "Hi.")] * 5000 + [(1, 1, "assistant", "Yes.")] * 3 + [(2, None, None, None)]
    report, _ = R.repair(R.filled(spark.createDataFrame(rows, SCHEMA)), 2, 2)
    found = {r.conv_id: r for r in report.collect()}
    assert (found[1].audit, found[1].cost, found[1].duplicate, found[1].illegal) == ("K" + "D" * 4999 + "KDD", 2 * 5001, 5001, 5001)
    assert (found[2].audit, found[2].cost, found[2].blank, found[2].gaps, found[2].repaired_sha256) == ("D", 2, 1, 0, R.EMPTY_SHA256)
    empty = spark.createDataFrame([], SCHEMA)
    assert R.for_all(empty, R.repair(R.damaged(empty))[0]).collect() == []
