"""Stages of the pipeline on rows without an id and rows that share one."""

import random

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n, seed):
    rng = random.Random(seed)
    return [" ".join(f"w{rng.randrange(5000)}" for _ in range(60)) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], SCHEMA)


def left(df):
    return sorted((str(r.doc_id), r.text) for r in df.collect())


def test_groups_of_rows_without_or_with_one_id(spark):
    a, b, c, d, e = texts(5, 1)
    rows = [(7, a), (7, b), (7, b), (3, c), (9, c), (None, c), (None, d), (None, d), (4, e), (None, "")]
    out = corpus_pipeline.one_of_each_group(spark, frame(spark, rows), "")
    assert left(out) == sorted([("7", a), ("7", b), ("3", c), ("None", d), ("4", e), ("None", "")])


def test_benchmark_in_rows_without_or_with_one_id(spark, tmp_path):
    a, b, c, bad = texts(4, 2)
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, a), (None, bad), (5, b), (5, bad), (6, c)]
    out = corpus_pipeline.without_benchmark(spark, frame(spark, rows), str(tmp_path))
    assert left(out) == sorted([("None", a), ("5", b), ("6", c)])


def odd_table(spark, folder, n=80):
    """Labelled documents, some of them odd, with columns that clash; labels and a benchmark item beside them."""
    rng = random.Random(5)
    good = [" ".join(rng.choices(["the", "cat", "sat", "on", "mats", "and", "rain", "fell"], k=40)) + f" {i}." for i in range(n)]
    bad = ["\n".join("".join(rng.choices("#$%&!@*~^", k=30)) for _ in range(4)) + f" {i}" for i in range(n)]
    rows = [(i, t) for i, t in enumerate(good)] + [(n + i, t) for i, t in enumerate(bad)]
    rows += [(None, good[0]), (2, good[2]), (2, None), (None, None), (900, ""), (901, " \n "), (902, "word, " * 40_000)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k % 3}", 0, "x", 1) for k, (i, t) in enumerate(rows)], SCHEMA + ", row string, n_removed int")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels = [(i, int(i < n), 0) for i in range(2 * n)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, good[1])], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return docs, good, bad


COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


def test_stages_on_odd_rows_and_empty_tables(spark, tmp_path):
    docs, good, bad = odd_table(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES:
        out, none = stage(spark, docs, str(tmp_path)), stage(spark, docs.limit(0), str(tmp_path))
        assert out.columns == none.columns == (COLUMNS if name != "sentencepiece" else ["doc_id", "n_tokens", "token_ids", "round_trip"])
        assert none.collect() == []
        rows = out.collect()
        texts = [r.text for r in rows] if name != "sentencepiece" else []
        if name == "quality":
            assert set(good) <= set(texts) and not set(bad) & set(texts)
        elif name == "line_dedup":
            assert sorted(map(str, texts)) == sorted(str(r.text) for r in docs.collect())  # three sites: nothing is boilerplate
        elif name == "near_duplicates":
            assert sorted(t for t in texts if t in good) == sorted(good)
        elif name == "decontaminate":
            assert good[1] not in texts and len(rows) == docs.count() - 1
        else:
            assert len(rows) == docs.count() and all(r.round_trip for r in rows)


def test_run_on_odd_rows(spark, tmp_path):
    docs, good, _ = odd_table(spark, str(tmp_path))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = [r.doc_id for r in rows]
    assert set(range(len(good))) - {1} <= set(ids) and 1 not in ids
    assert not any(i is not None and len(good) <= i < 2 * len(good) for i in ids)
    assert sorted(i for i in ids if i in (0, 2)) == [0, 2]  # each text once


def test_boilerplate_lines_go_and_emptied_documents_with_them(spark):
    rows = [(i, f"own text {i}\nfollow us for more") for i in range(12)] + [(100, "follow us for more"), (101, ""), (102, None)]
    docs = spark.createDataFrame([(i, t, "en", f"s{k}", 0) for k, (i, t) in enumerate(rows)], SCHEMA)
    out = {r.doc_id: r for r in corpus_pipeline.without_boilerplate(spark, docs, "").collect()}
    assert out[0].text == rows[0][1] and out[0].n_chars == 0  # the first occurrence stays
    assert all(out[i].text == f"own text {i}" and out[i].n_chars == len(out[i].text) for i in range(1, 12))
    assert 100 not in out and out[101].text == "" and out[102].text is None
