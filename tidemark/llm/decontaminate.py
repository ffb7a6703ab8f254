"""Benchmark decontamination by a distributed positional inverted index.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after lower-casing A-Z. The index is kept in segments of whole
documents: for each word hash the sorted positions of the word in the segment. Every token of every document is in
it. A window is 13 consecutive words of an item (an item of fewer words, but not none, is one window). In each
segment a window starts from the postings of its rarest word there, moved by the word's place in the window, and is
intersected with the moved postings of its other words from rare to frequent. Nothing is shuffled by word, so a word
that makes up a third of all tokens is spread over the segments like the documents are.

Exact matches give the phrase hits. Proximity matches are places of the rarest word at which the second and third
rarest words also stand within `slop` words of where the window has them, and that are no exact matches.

The items are queries: they are taken in blocks of at most BLOCK_WORDS words, each broadcast in turn, so that what is
broadcast is bounded. A null or empty text has no words; an item with a null id still hits words, but is not listed.
Repeated rows are separate documents, found by their place in the index and not by doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read, stored
from tidemark.llm.hashing import byte_class, word_hashes
from tidemark.llm.registry import register

WORD = byte_class(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]")
WINDOW = 13
#: Words by which the second and third rarest word of a proximity match may be off.
SLOP = 3
#: Words of a segment: about 12 MB of postings.
SEGMENT_WORDS = 1_000_000
#: Words of the items that are broadcast at once: at most some 100 MB as windows.
BLOCK_WORDS = 500_000
#: Places of rarest words that are intersected at once.
AT_ONCE = 1_000_000

INDEX_SCHEMA = "segment string, doc_ids array<bigint>, n_words array<bigint>, terms binary, ends binary, postings binary"
MATCH_SCHEMA = (
    "segment string, place int, words array<int>, items array<bigint>, near_items array<bigint>, n_near bigint"
)


def build_index(docs: DataFrame, segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """A row per segment: its documents, its word hashes in order, and for each the positions of the word."""

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        ids, counts, hashes, held = [], [], [], 0

        def segment() -> pa.RecordBatch:
            words = np.concatenate(hashes)
            order = np.argsort(words, kind="stable").astype(np.int32)
            in_order = words[order]
            last = np.flatnonzero(np.diff(in_order, append=~in_order[-1:])) if len(words) else np.empty(0, np.int64)
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([f"{task}-{number}"]),
                    pa.array([ids], pa.list_(pa.int64())),
                    pa.array([np.concatenate(counts)], pa.list_(pa.int64())),
                    pa.array([in_order[last].tobytes()], pa.binary()),
                    pa.array([(last + 1).astype(np.int32).tobytes()], pa.binary()),
                    pa.array([order.tobytes()], pa.binary()),
                ],
                ["segment", "doc_ids", "n_words", "terms", "ends", "postings"],
            )

        for batch in batches:
            found, n = word_hashes([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()], WORD)
            ids += batch.column(0).to_pylist()
            counts.append(n)
            hashes.append(found)
            held += len(found)
            if held >= segment_words:
                yield segment()
                number += 1
                ids, counts, hashes, held = [], [], [], 0
        if ids:
            yield segment()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), segments, INDEX_SCHEMA)


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Blocks of (item_id, word hashes) of at most `block_words` words, or of a single longer item."""
    block, held = [], 0
    for row in items.select(F.col("item_id").cast("long"), "text").toLocalIterator():
        words, _ = word_hashes([(row[1] or "").encode()], WORD)
        if len(words):
            if block and held + len(words) > block_words:
                yield block
                block, held = [], 0
            block.append((row[0], words))
            held += len(words)
    if block:
        yield block


def windows_of(block: list[tuple[int, np.ndarray]], window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each window in a row, padded with 0; its length; the index of its item)."""
    rows, length, item = [], [], []
    for k, (_, words) in enumerate(block):
        if len(words) < window:
            rows.append(np.pad(words, (0, window - len(words)))[None])
        else:
            rows.append(np.lib.stride_tricks.sliding_window_view(words, window))
        length += [min(len(words), window)] * len(rows[-1])
        item += [k] * len(rows[-1])
    return np.concatenate(rows), np.array(length), np.array(item)


def intersect(
    terms: np.ndarray, ends: np.ndarray, postings: np.ndarray, windows: np.ndarray, length: np.ndarray, slop: int = SLOP
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(window, start) of exact matches and of proximity matches in one segment."""
    begins = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    counts = ends - begins
    width = windows.shape[1]
    place = np.searchsorted(terms, windows)
    place[place == len(terms)] = 0
    inside = np.arange(width) < length[:, None]
    alive = np.flatnonzero(((terms[place] == windows) | ~inside).all(1))
    # the words of a window from rare to frequent
    often = np.where(inside[alive], counts[place[alive]], np.iinfo(np.int64).max)
    order = np.argsort(often, axis=1, kind="stable")
    keys = (np.repeat(np.arange(len(terms), dtype=np.int64), counts) << 32) | postings
    out = [[], [], [], []]
    n = often[np.arange(len(alive)), order[:, 0]] if len(alive) else np.empty(0, np.int64)
    cut = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + AT_ONCE, AT_ONCE), "left")
    for lo, hi in zip(cut[:-1], np.append(cut[1:-1], len(alive))):
        if hi <= lo:
            continue
        some = np.repeat(np.arange(lo, hi), n[lo:hi])
        first = np.cumsum(n[lo:hi]) - n[lo:hi]
        rare = place[alive[some], order[some, 0]]
        start = postings[begins[rare] + np.arange(len(some)) - np.repeat(first, n[lo:hi])].astype(np.int64) - order[some, 0]
        near_by = np.ones(len(some), bool)
        exact = start >= 0
        for rank in range(1, width):
            at = order[some, rank]
            real = rank < length[alive[some]]
            want = (place[alive[some], at].astype(np.int64) << 32) + start + at
            if rank <= 2:
                low = np.minimum(np.searchsorted(keys, want - slop), len(keys) - 1)
                near_by &= ~real | ((keys[low] <= want + slop) & (keys[low] >= want - slop))
            left = np.flatnonzero(exact & real)
            spot = np.minimum(np.searchsorted(keys, want[left]), len(keys) - 1)
            exact[left[keys[spot] != want[left]]] = False
            if rank >= 2 and not exact.any():
                break
        for k, mask in ((0, exact), (2, near_by & ~exact & (length[alive[some]] > 2))):
            out[k].append(alive[some[mask]])
            out[k + 1].append(start[mask])
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def match_block(index: DataFrame, block: list[tuple[int, np.ndarray]], window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """A row for each document with a match: the words hit by phrases, items of phrases and of proximity matches."""
    windows, length, item = windows_of(block, window)
    item_ids = [i for i, _ in block]
    sent = index.sparkSession.sparkContext.broadcast((windows, length, item, item_ids))

    def matches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, length, item, item_ids = sent.value
        for batch in batches:
            for row in range(batch.num_rows):
                segment, n_words, terms, ends, postings = (
                    batch.column(c)[row].as_py() for c in ("segment", "n_words", "terms", "ends", "postings")
                )
                terms, ends = np.frombuffer(terms, np.uint64), np.frombuffer(ends, np.int32)
                if not len(terms):
                    continue
                doc_ends = np.cumsum(n_words)
                w, s, near_w, near_s = intersect(terms, ends, np.frombuffer(postings, np.int32), windows, length, slop)
                doc = np.searchsorted(doc_ends, s, "right")
                inside = s + length[w] <= doc_ends[doc]
                w, s, doc = w[inside], s[inside], doc[inside]
                edge = np.zeros(int(doc_ends[-1]) + 1, np.int32)
                np.add.at(edge, s, 1)
                np.add.at(edge, s + length[w], -1)
                hit = np.flatnonzero(np.cumsum(edge) > 0)
                hit_doc = np.searchsorted(doc_ends, hit, "right")
                near_s = np.clip(near_s, 0, int(doc_ends[-1]) - 1)
                near_doc = np.searchsorted(doc_ends, near_s, "right")
                found = np.unique(np.concatenate([doc, near_doc]))
                begin = np.concatenate([[0], doc_ends[:-1]])

                def ids(which: np.ndarray) -> list[int]:
                    return sorted({item_ids[k] for k in np.unique(item[which])} - {None})

                yield pa.RecordBatch.from_pylist(
                    [
                        {
                            "segment": segment,
                            "place": int(d),
                            "words": (hit[hit_doc == d] - begin[d]).tolist(),
                            "items": ids(w[doc == d]),
                            "near_items": ids(near_w[near_doc == d]),
                            "n_near": int((near_doc == d).sum()),
                        }
                        for d in found
                    ],
                    pa.schema(
                        [
                            ("segment", pa.string()),
                            ("place", pa.int32()),
                            ("words", pa.list_(pa.int32())),
                            ("items", pa.list_(pa.int64())),
                            ("near_items", pa.list_(pa.int64())),
                            ("n_near", pa.int64()),
                        ]
                    ),
                )

    return map_arrow(index.select("segment", "n_words", "terms", "ends", "postings"), matches, MATCH_SCHEMA)


def find_contamination(
    docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = SLOP, block_words: int = BLOCK_WORDS
) -> DataFrame:
    """A row per document: doc_id, n_words, hit words (positions), items and near_items (ids), n_near."""
    index = stored(build_index(docs), "postings")
    places = index.select(
        "segment", F.posexplode(F.arrays_zip("doc_ids", "n_words")).alias("place", "doc")
    ).select("segment", "place", F.col("doc.doc_ids").alias("doc_id"), F.col("doc.n_words").alias("n_words"))
    found = None
    for block in item_blocks(items, block_words):
        some = match_block(index, block, window, slop)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = docs.sparkSession.createDataFrame([], MATCH_SCHEMA)
    merged = found.groupBy("segment", "place").agg(
        F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"),
        F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_distinct(F.flatten(F.collect_list("near_items"))).alias("near_items"),
        F.sum("n_near").alias("n_near"),
    )
    return places.join(merged, ["segment", "place"], "left").drop("segment", "place")


def contamination(docs: DataFrame, items: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The verdict of each document: contaminated if at least a twentieth of its words are inside phrases of items."""
    found = find_contamination(docs, items, block_words=block_words)
    ids = F.array_sort(F.transform(F.coalesce("items", F.array().cast("array<bigint>")), lambda x: x.cast("string")))
    n_hit = F.greatest(F.size("words"), F.lit(0)).cast("long")
    n_hit = F.when(F.col("words").isNull(), F.lit(0)).otherwise(n_hit).cast("long")
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"),
    )


def words_sql(table: str, key: str) -> str:
    return (
        f"SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
        f"'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM {table}"
    )


CONTAMINATION_SQL = """
    WITH d AS ({docs_words}), b AS ({item_words}),
    wins AS (
      SELECT DISTINCT item_id, len(w) AS l, array_to_string(w, ' ') AS win FROM b WHERE len(w) BETWEEN 1 AND 12
      UNION
      SELECT item_id, 13, array_to_string(w[i:i + 12], ' ')
      FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13)),
    lens AS (SELECT DISTINCT l FROM wins),
    places AS (
      SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS win
      FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, lens WHERE len(w) >= l)),
    hits AS (SELECT doc_id, item_id, l, i FROM places JOIN wins USING (l, win)),
    words AS (SELECT doc_id, count(*) AS n_hit FROM (
      SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM hits) GROUP BY doc_id),
    items AS (
      SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
    SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
           sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
    FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)"""


def contamination_sql(docs: str = "documents") -> str:
    return CONTAMINATION_SQL.format(docs_words=words_sql(docs, "doc_id"), item_words=words_sql("benchmark", "item_id"))


@register("op4_decontaminate", contamination_sql())
def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
