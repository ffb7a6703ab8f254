"""Boilerplate lines and contamination against plain searches, with odd rows; the pipeline on odd rows."""

import hashlib
import random
import re
import time

from tidemark.llm import decontaminate, line_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, n_words string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 0, "own", "own") for i, t, s in rows], SCHEMA)


def test_lines_against_search(spark):
    rng = random.Random(14)
    common = [f"line {k}" for k in range(8)]
    rows = []
    for i in range(120):
        lines = rng.choices(common, weights=range(1, 9), k=3) + [f"own {i} {k}" for k in range(2)] + ["", "  "]
        rng.shuffle(lines)
        rows.append((i, "\n".join(lines), f"s{rng.randrange(14)}"))
    rows += [(500, None, "s1"), (501, "", None), (502, " line 7 \nline 7", None), (None, "line 7\nx", "s2"), (3, rows[3][1], rows[3][2])]
    sites, first = {}, {}
    for i, t, s in rows:
        for n, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" ")
            if line:
                sites.setdefault(line, set()).add(s or "")
                key = (-1 if i is None else i, n)
                first[line] = min(first.get(line, key), key)
    want = []
    for i, t, s in rows:
        kept = []
        for n, raw in enumerate((t or "").split("\n")):
            line = raw.strip(" ")
            if not (line and len(sites[line]) >= 10 and first[line] != (-1 if i is None else i, n)):
                kept.append(raw)
        want.append((str(i), t if t is None else "\n".join(kept)))
    out = line_dedup.remove_boilerplate(frame(spark, rows)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in out) == sorted((i, str(t)) for i, t in want)
    assert line_dedup.remove_boilerplate(frame(spark, [])).collect() == []


def test_very_long_documents(spark):
    """Thousands of removed lines in one text take time in proportion to its lines."""
    shared = [f"shared {k}" for k in range(12_000)]
    rows = [(i, "\n".join(shared + [f"own {i} {k}" for k in range(2_000)]), f"s{i}") for i in range(11)]
    began = time.monotonic()
    out = {r.doc_id: r for r in line_dedup.remove_boilerplate(frame(spark, rows)).collect()}
    assert time.monotonic() - began < 60
    assert out[0].text == rows[0][1] and out[0].n_removed == 0
    for i in range(1, 11):
        assert (out[i].n_lines, out[i].n_removed) == (14_000, 12_000)
        assert out[i].text == "\n".join(f"own {i} {k}" for k in range(2_000))


def test_line_on_a_third_of_all_rows_is_split(spark):
    n = 20_000
    rows = spark.range(0, n, 1, 6).selectExpr(
        "id AS doc_id", "concat('own ', id, if(id % 3 = 0, '\nhot line', '')) AS text", "concat('s', id % 40) AS source"
    )
    names = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
    }
    before = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        df = line_dedup.remove_boilerplate(rows)
        got = df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sum(r.n_removed for r in got) == (n + 2) // 3 - 1
    assert "skew=true" in plan


def plain_contamination(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
    wins = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            wins.setdefault(tuple(w[k : k + 13]), set()).add(item)
    out = []
    for i, t in rows:
        w, hit, found = words(t), set(), set()
        for win, ids in wins.items():
            for k in range(len(w) - len(win) + 1):
                if tuple(w[k : k + len(win)]) == win:
                    hit |= set(range(k, k + len(win)))
                    found |= ids
        ids = sorted(str(x) for x in found if x is not None)
        out.append((str(i), len(w), len(hit), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out)


def test_contamination_against_search(spark):
    rng = random.Random(15)
    vocabulary = "a b c d e é1 zz".split()
    items = [(k, " ".join(rng.choices(vocabulary, k=n))) for k, n in enumerate([1, 3, 12, 13, 14, 30, 40, 0])]
    items += [(100, None), (None, "d d e"), (10, items[4][1])]
    rows = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 50)))) for i in range(60)]
    rows += [(200 + k, f"x y {t.upper()}, q-r") for k, (_, t) in enumerate(items) if t]
    rows += [(300, None), (301, ""), (None, items[5][1]), (5, rows[5][1]), (302, "long! " * 30_000 + items[6][1])]
    benchmark = spark.createDataFrame([(i, t, "own") for i, t in items], "item_id long, text string, n_words string")
    for block in (500_000, 20):
        found = decontaminate.contamination(frame(spark, [(i, t, "s") for i, t in rows]), benchmark, block).collect()
        got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in found)
        assert got == plain_contamination(rows, items)
    none = decontaminate.contamination(frame(spark, [(1, "a b", "s")]), benchmark.limit(0)).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in none] == [(2, 0, False)]
    assert decontaminate.contamination(frame(spark, []), benchmark).collect() == []
