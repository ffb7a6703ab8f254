"""Cross-site boilerplate lines: HyperLogLog spread per line hash, exact counts near the threshold, removal.

A line is a part of a text between line feeds, compared without leading and trailing spaces; blank lines are never
counted or removed. A site is a value of `source`; a null source is one site of its own. A line is boilerplate if it
stands on at least `min_sites` sites. One occurrence stays (`keep_first`): the first line of the smallest doc_id, so
that no content vanishes from the corpus; repeats of that row keep it too. A null text stays null, an empty one
empty. Rows with the same doc_id but other texts are told apart by a hash of the text.

A line is identified by two 64-bit hashes with different seeds, together 128 bits, so that lines themselves are
never shuffled.

DataFrame functions only. Line hashes are reduced to sketches before the shuffle; the few candidate lines are then
joined back by joins that shuffle both sides for themselves, so that a line that holds a third of all rows is split.
Texts are shuffled once, to meet the positions of their removed lines.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import joined_apart, read
from tidemark.llm.registry import register

#: Sites from which a line counts as boilerplate.
MIN_SITES = 10
#: log2 of the sketch's buckets; the relative standard error is 1.04 / sqrt(2 ** LG_K).
LG_K = 8


def _parts(text: Column) -> Column:
    return F.split(text, "\n")


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, site, line_no, line_hash, line_hash_2) of every line that is not blank."""
    rows = docs.select(
        "doc_id",
        F.xxhash64("text").alias("text_hash"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("site"),
        F.posexplode(_parts(F.col("text"))).alias("line_no", "raw"),
    )
    rows = rows.select("doc_id", "text_hash", "site", "line_no", F.trim("raw").alias("line")).where("line != ''")
    hashes = F.xxhash64("line").alias("line_hash"), F.xxhash64(F.lit(1), F.col("line")).alias("line_hash_2")
    return rows.select("doc_id", "text_hash", "site", "line_no", *hashes)


def line_spread(lines: DataFrame, lg_k: int = LG_K) -> DataFrame:
    """(line_hash, sketch, sites_estimate): sketches of the sites are merged by partial aggregation."""
    spread = lines.groupBy("line_hash").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch"))
    return spread.withColumn("sites_estimate", F.hll_sketch_estimate("sketch"))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> tuple[DataFrame, DataFrame]:
    """(boilerplate lines, occurrences of candidate lines).

    Within three standard errors of the threshold the sites are counted exactly; below, a line is left alone, and
    above, it is boilerplate by its sketch, and its sites are not counted again.
    """
    margin = math.ceil(3 * 1.04 / math.sqrt(2**lg_k) * min_sites)
    lines = lines_of(docs)
    candidates = line_spread(lines, lg_k).where(F.col("sites_estimate") >= min_sites - margin)
    candidates = candidates.select("line_hash", (F.col("sites_estimate") <= min_sites + margin).alias("near"))
    found = joined_apart(lines, candidates, "line_hash")
    counted_site = F.when(F.col("near"), F.col("site")).alias("site")
    per_site = found.groupBy("line_hash", "line_hash_2", "near", counted_site).agg(F.min(F.struct("doc_id", "line_no")).alias("first"))
    counted = per_site.groupBy("line_hash", "line_hash_2", "near").agg(F.count("*").alias("sites"), F.min("first").alias("first"))
    chosen = counted.where(~F.col("near") | (F.col("sites") >= min_sites)).select("line_hash", "line_hash_2", "first")
    return chosen, found


def remove_boilerplate(
    docs: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K, keep_first: bool = True
) -> DataFrame:
    """The documents with boilerplate lines taken out of `text`, with n_lines (not blank, before) and n_removed."""
    chosen, found = boilerplate(docs, min_sites, lg_k)
    hits = joined_apart(found, chosen, "line_hash", "line_hash_2")
    if keep_first:
        hits = hits.where(~F.struct("doc_id", "line_no").eqNullSafe(F.col("first")))
    gone = hits.groupBy(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).agg(
        F.collect_set("line_no").alias("gone_lines")
    )
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    marked = docs.select(*own, F.xxhash64("text").alias("own_hash"))
    joined = marked.join(
        gone, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("own_hash") == F.col("gone_hash")), "left"
    )
    parts = _parts(F.col("text"))
    # the places that are left, found by one pass over a hash set
    places = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("gone_lines"))
    kept = F.array_join(F.transform(places, lambda i: F.get(parts, i)), "\n")
    return joined.select(
        *[c for c in own if c != "text"],
        F.when(F.col("gone_lines").isNull(), F.col("text")).otherwise(kept).alias("text"),
        F.coalesce(F.size(F.filter(parts, lambda x: F.trim(x) != "")), F.lit(0)).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone_lines"), F.lit(0)).cast("long").alias("n_removed"),
    )


def removal_sql(source: str, min_sites: int = MIN_SITES) -> str:
    """SQL for (doc_id, text, lang, source, n_chars, n_lines, n_removed) over a table or subquery like documents."""
    return f"""
    SELECT d.doc_id, d.lang, d.source, d.n_chars,
      CASE WHEN count(l.line) FILTER (WHERE b.line IS NOT NULL AND b.first != [l.doc_id, l.n]) = 0 THEN any_value(d.text)
           ELSE coalesce(string_agg(l.raw, chr(10) ORDER BY l.n) FILTER (WHERE b.line IS NULL OR b.first = [l.doc_id, l.n]), '')
      END AS text,
      count(l.line) FILTER (WHERE l.line != '') AS n_lines,
      count(l.line) FILTER (WHERE b.line IS NOT NULL AND b.first != [l.doc_id, l.n]) AS n_removed
    FROM ({source}) d
    LEFT JOIN (SELECT *, trim(raw) AS line FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
               unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM ({source}))) l USING (doc_id)
    LEFT JOIN (
      SELECT line, min([doc_id, n]) AS first FROM (SELECT *, trim(raw) AS line FROM (
          SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS raw,
                 unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM ({source})))
      WHERE line != '' GROUP BY line HAVING count(DISTINCT site) >= {min_sites}
    ) b ON b.line = l.line
    GROUP BY ALL"""


@register(
    "op2_line_dedup",
    f"SELECT doc_id, text, n_lines, n_removed FROM ({removal_sql('SELECT * FROM documents')})",
)
def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return remove_boilerplate(docs).select("doc_id", "text", "n_lines", "n_removed")
