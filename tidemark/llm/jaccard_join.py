"""Near-duplicate documents by an exact Jaccard join with PartEnum signatures.

A document is the set of its distinct 5-word shingles (64-bit hashes). Two sets whose Jaccard similarity is at least s
differ in at most (1 - s) / (1 + s) * (|A| + |B|) elements. Sets of a size band divide the domain of hashes into the
same number of partitions, so many that every similar partner has at least one partition in which both hold the same
elements, and not none; its content is a signature. A set just below a band's end also takes the next band's
signatures. Where a set has too few partitions with elements for that promise, it signs its empty ones too.

Texts with the same set are one node from the start. Signatures held by two nodes or more are kept. A similar partner
shares not one signature of a band with a set but all except one for each difference, so in any one order of all signatures
the first shared one stands before as many others. In the order from rare to frequent each node therefore gives up its most
frequent ones, as many as the promise is better than one (prefix filtering): what a passage common to many documents
signs goes, and no pair of similar sets is lost. In each bucket that is left
the smallest node meets the others; if several components are left in a bucket of at most SMALL nodes, all pairs across
them meet. Pairs pass an exact filter (sizes, and parities of the elements by hash bits, which differ in no more places
than the sets do; long sets have a bit per element) and are then verified on the sets, each pair once. Verified pairs
are merged into components. Nodes of larger buckets that still hold several components get stronger signatures: partitions with room for one difference, cut in four, of which each three make a signature
(second level of PartEnum). If some of those buckets are still large and unsettled, more and more of their nodes, 4,
32, 256, ... of those outside the component with most nodes there, meet all others until every pair of components has
met: exact, and only reached by data made for it. So no bucket is capped or dropped.

A null or empty text, or one without words, has no shingles, links with nothing and is its own component; a null
doc_id belongs to the component of its set if others have it, else its component is null. Rows that repeat a doc_id
are one vertex. Shuffles carry hashes and node ids; texts are read again for the nodes of candidate pairs, whose ids are sent if few.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import connected_components, discard, joined_apart, map_arrow, read, stored
from tidemark.llm.hashing import byte_class, mix, word_hashes
from tidemark.llm.registry import register

WORD = byte_class(r"[^\x20\x09-\x0D]")
SHINGLE = 5
#: The similarity as a share of 100.
PERCENT = 80
#: Nodes up to which a bucket's remaining pairs are all met.
SMALL = 16
#: Ids (with nodes, 16 bytes a row) that are broadcast rather than joined by a shuffle of the texts.
MOST_SENT = 1_000_000
#: Nodes of a bucket that meet as many others at a time.
PART = 2048
#: 64-bit words of the parity sketch.
PARITY_WORDS = 16
#: A factor for each place in a shingle; unrelated ones, so that no exchange of words leaves their sum as it is.
_ODD = np.random.Generator(np.random.PCG64(5)).integers(1, 2**63, SHINGLE, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def flat_sets(texts: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingle hashes of all texts, each text's in order, and their number in each text.

    A text of fewer words has one hash of all of them.
    """
    words, counts = word_hashes(texts, WORD)
    ends = np.cumsum(counts)
    begins = ends - counts
    h, first = np.zeros(len(words), np.uint64), np.ones(len(words), bool)
    whole = max(0, len(words) - size + 1)
    for j in range(size):
        h[:whole] += words[j : whole + j] * _ODD[j]
    h += np.uint64(size)
    long, short = ends[counts >= size], counts < size
    for j in range(1, size):
        first[long - j] = False
        first[begins[short & (counts > j)] + j] = False
    few = short & (counts > 0)
    h[begins[few]] = counts[few].astype(np.uint64)
    for j in range(size - 1):
        at = begins[short & (counts > j)]
        h[at] += words[at + j] * _ODD[j]
    h = mix(h[first])
    n = np.where(short, few, counts - size + 1)
    ends = np.cumsum(n)
    for begin, end in zip((ends - n).tolist(), ends.tolist()):
        h[begin:end].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[(ends - n)[n > 0]] = True
    return h[new], per_set(new, n)


def per_set(flags: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of the flags of each set are up; n: how many flags each has."""
    before = np.concatenate([[0], np.cumsum(flags)])
    ends = np.cumsum(n)
    return before[ends] - before[ends - n]


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, in order."""
    h, n = flat_sets(texts, size)
    return np.split(h, np.cumsum(n)[:-1]) if texts else []


def band_of(n: int) -> int:
    """Sets of 2^b to 2^(b+1) - 1 elements share a band."""
    return int(n).bit_length() - 1


def most_differences(n: int, percent: int = PERCENT) -> int:
    """How many elements a similar set of any size may differ in: (1 - s) / (1 + s) * (n + n / s)."""
    return n * (100 - percent) // percent


def bands_of(n: int, percent: int = PERCENT) -> list[int]:
    """The bands whose signatures a set of n elements takes: its own, and the next one if a partner can lie there."""
    band = band_of(n)
    return [band] + [band + 1] * (100 * n >= percent * 2 ** (band + 1))


def groups_of(band: int, strong: bool, percent: int = PERCENT) -> int:
    """The partitions of a band: more than the differences of two of its sets."""
    largest = 2 ** (band + 1) - 1
    k = 2 * largest * (100 - percent) // (100 + percent)
    return k // 2 + 1 if strong else k + 1 + (k + 1) // 4


def cells_of(h: np.ndarray, cells: int | np.ndarray) -> np.ndarray:
    """The cell of each element; multiply-shift of the high half: monotone in the hash, so that cells are runs of the sorted set."""
    return (((h >> np.uint64(32)) * np.asarray(cells, np.uint64)) >> np.uint64(32)).astype(np.int64)


def spare_signatures(h: np.ndarray, percent: int = PERCENT) -> list[int]:
    """For the own and the next band, how many signatures shared with any similar partner a set has beyond one."""
    out = []
    for b in bands_of(len(h), percent):
        filled = 1 + int(np.count_nonzero(np.diff(cells_of(h, groups_of(b, False, percent)))))
        out.append(max(0, filled - most_differences(len(h), percent) - 1))
    return out + [0] * (2 - len(out))


def band_signatures(h: np.ndarray, b: int, strong: bool, percent: int = PERCENT) -> np.ndarray:
    """The signatures of one set (sorted hashes) in a band; the lowest bit is that of the band."""
    groups = groups_of(b, strong, percent)
    cells = 4 * groups if strong else groups
    cell = cells_of(h, cells)
    sums = np.zeros(cells, np.uint64)
    first = np.flatnonzero(np.diff(cell, prepend=-1))
    sums[cell[first]] = np.add.reduceat(mix(h + np.uint64(1)), first)
    if strong:
        quarters = sums.reshape(groups, 4)
        part = quarters.sum(1, dtype=np.uint64)[:, None] - quarters
        which = np.arange(4 * groups, dtype=np.uint64).reshape(groups, 4)
        filled = part != 0
        # a group with one difference at most; both sets have elements in the three equal quarters, or sign all
        enough = int((filled.sum(1) == 4).sum()) > most_differences(len(h), percent) // 2
    else:
        part, which = sums, np.arange(groups, dtype=np.uint64)
        filled = sums != 0
        enough = int(filled.sum()) > most_differences(len(h), percent)
    return signature_of(part, which, np.full(1, b), strong)[filled if enough else np.ones_like(filled)]


def signature_of(part: np.ndarray, which: np.ndarray, band: np.ndarray, strong: bool) -> np.ndarray:
    """The signatures of contents of partitions."""
    salt = (band * 2 + strong + 1).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    own = mix(part * np.uint64(0x9E3779B97F4A7C15) + mix(which + salt))
    return own & ~np.uint64(1) | (band & 1).astype(np.uint64)


def signatures(h: np.ndarray, strong: bool, percent: int = PERCENT) -> np.ndarray:
    """The signatures of one set in its own band and the next."""
    return np.unique(np.concatenate([band_signatures(h, b, strong, percent) for b in bands_of(len(h), percent)]))


def bands_of_sets(n: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For the own and the next band: which sets of n elements take it, their bands and the bands' partitions."""
    own = np.frexp(n)[1].astype(np.int64) - 1
    groups = np.array([groups_of(b, False, percent) for b in range(int(own.max(initial=0)) + 2)], np.int64)
    yield n > 0, own[n > 0], groups[own[n > 0]]
    near = (n > 0) & (100 * n >= percent * 2 ** (own + 1))
    yield near, own[near] + 1, groups[own[near] + 1]


def cell_runs(h: np.ndarray, n: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets with elements: the first element of each partition with elements, its number, and how many each set has."""
    cell = cells_of(h, np.repeat(groups, n))
    new = np.ones(len(h), bool)
    new[1:] = cell[1:] != cell[:-1]
    new[np.cumsum(n) - n] = True
    first = np.flatnonzero(new)
    return first, cell[first], per_set(new, n)


def flat_spare(h: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """`spare_signatures` of sets one behind the other, with n elements each."""
    out = np.zeros((len(n), 2), np.int64)
    for k, (take, _, groups) in enumerate(bands_of_sets(n, percent)):
        filled = cell_runs(h[np.repeat(take, n)], n[take], groups)[2]
        out[take, k] = np.maximum(0, filled - n[take] * (100 - percent) // percent - 1)
    return out


def flat_signatures(h: np.ndarray, n: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """The weak `signatures` of sets one behind the other, with n elements each, and the set that each signature is of."""
    hashed, sigs, sets = mix(h + np.uint64(1)), [], []
    begins = np.cumsum(n) - n
    for take, band, groups in bands_of_sets(n, percent):
        if not take.any():
            continue
        of, own = np.flatnonzero(take), n[take]
        mine = np.repeat(take, n)
        first, cell, filled = cell_runs(h[mine], own, groups)
        part = np.add.reduceat(hashed[mine], first)
        filled = per_set(part != 0, was := filled)
        enough = filled > own * (100 - percent) // percent
        keep = (part != 0) & np.repeat(enough, was)
        sigs.append(signature_of(part[keep], cell[keep].astype(np.uint64), np.repeat(band, was)[keep], False))
        sets.append(np.repeat(of, was)[keep])
        for k in np.flatnonzero(~enough):  # signs its empty partitions too
            sigs.append(band_signatures(h[begins[of[k]] : begins[of[k]] + own[k]], int(band[k]), False, percent))
            sets.append(np.full(len(sigs[-1]), of[k]))
    return np.concatenate([np.empty(0, np.uint64), *sigs]), np.concatenate([np.empty(0, np.int64), *sets])


def parities(h: np.ndarray, words: int = PARITY_WORDS) -> list[int]:
    """For each value of the low bits of a hash (1024 values), whether an odd number of elements has it; as 64-bit words."""
    bits = np.bincount((h & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64).tolist()


def wide_parities(h: np.ndarray) -> list[int] | None:
    """Parities by one to two hash values per element, for sets so large that nearly all of the 1024 differ by chance."""
    words = 2 ** len(h).bit_length() // 64
    return parities(h, words) if words > PARITY_WORDS else None


def wide_apart(p: Column, q: Column) -> Column:
    """The places in which two wide parities differ, the longer one folded to the length of the shorter; null if one is null."""
    words = F.least(F.size(p), F.size(q))

    def folded(x: Column) -> Column:
        halves = F.zip_with(F.slice(x, F.lit(1), words), F.slice(x, words + 1, words), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) > words, halves).otherwise(x)

    differing = F.zip_with(folded(p), folded(q), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    count = F.aggregate(differing, F.lit(0), lambda total, n: total + n)
    return F.when(p.isNotNull() & q.isNotNull(), count)


def flat_parities(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A row of `parities` for each of the sets one behind the other, with n elements each."""
    bits = 64 * PARITY_WORDS
    place = np.repeat(np.arange(len(n)) * bits, n) + (h & np.uint64(bits - 1)).astype(np.int64)
    odd = np.bincount(place, minlength=len(n) * bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).reshape(len(n), PARITY_WORDS)


def set_hashes(h: np.ndarray, n: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set: the node that stands for all texts with this set."""
    before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h), dtype=np.uint64)])
    ends = np.cumsum(n)
    return mix(before[ends] - before[ends - n] + n.astype(np.uint64)).view(np.int64)


def lists(values: np.ndarray, n: np.ndarray, missing: np.ndarray | None = None) -> pa.ListArray:
    """Lists of n values each; null where `missing`."""
    offsets = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=None if missing is None else pa.array(missing))


def with_sets(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, node, parity, wide, spare) of every document; node is null without shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = flat_sets([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            none, some = n == 0, n > 0
            wide = [wide_parities(x) for x in np.split(h, np.cumsum(n)[:-1])] if len(n) else []
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(n, pa.int64()),
                    pa.array(set_hashes(h, n), pa.int64(), mask=none),
                    lists(flat_parities(h, n)[some].ravel(), PARITY_WORDS * some, none),
                    pa.array(wide, pa.list_(pa.int64())),
                    lists(flat_spare(h, n, percent)[some].ravel().astype(np.int32), 2 * some, none),
                ],
                ["doc_id", "n_shingles", "node", "parity", "wide", "spare"],
            )

    schema = "doc_id bigint, n_shingles bigint, node bigint, parity array<bigint>, wide array<bigint>, spare array<int>"
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), rows, schema)


def signed(texts: DataFrame, strong: bool, percent: int) -> DataFrame:
    """(sig, node) of every signature of (text); a task signs a node once."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            h, n = flat_sets([t or b"" for t in batch.column(0).cast(pa.binary()).to_pylist()])
            node = set_hashes(h, n)
            fresh = np.array([x not in seen and not seen.add(x) for x in node.tolist()], bool) & (n > 0)
            h, n, node = h[np.repeat(fresh, n)], n[fresh], node[fresh]
            if strong:
                each = [signatures(x, True, percent) for x in np.split(h, np.cumsum(n)[:-1])] if len(n) else []
                sigs = np.concatenate([np.empty(0, np.uint64), *each])
                node = np.repeat(node, [len(x) for x in each])
            else:
                sigs, sets = flat_signatures(h, n, percent)
                node = node[sets]
            if len(sigs):
                yield pa.RecordBatch.from_arrays([pa.array(sigs.view(np.int64)), pa.array(node)], ["sig", "node"])

    return map_arrow(texts.select("text"), rows, "sig bigint, node bigint")


def shared(rows: DataFrame) -> DataFrame:
    """The (sig, node) whose signature two nodes or more have, once each: rows are shuffled once, sorted, and streamed."""

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), np.int64)  # the last row of the batch before
        told = False  # whether that row has been passed on
        for batch in batches:
            sig, node = (np.concatenate([h, c.to_numpy()]) for h, c in zip(held, batch.columns))
            new = np.ones(len(sig), bool)
            new[1:] = (sig[1:] != sig[:-1]) | (node[1:] != node[:-1])
            if not new.all():
                sig, node = sig[new], node[new]
            same = sig[1:] == sig[:-1]
            keep = np.zeros(len(sig), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if told:
                keep[0] = False
            told = bool(keep[-1]) or (told and len(sig) == 1)
            held = np.stack([sig[-1:], node[-1:]])
            yield pa.RecordBatch.from_arrays([pa.array(sig[keep]), pa.array(node[keep])], ["sig", "node"])

    spark = rows.sparkSession
    ordered = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "sig").sortWithinPartitions("sig", "node")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "65536")  # of 16 bytes; the limit of bytes stays
    return ordered.mapInArrow(repeated, "sig bigint, node bigint")


def rarest(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The (sig, node) without the most frequent signatures of each node, as many as its band can spare."""
    sizes = rows.groupBy("sig").agg(F.count("*").alias("n"))
    band = F.length(F.bin("n_shingles")) - 1
    own = nodes.select("node", "spare", band.bitwiseAND(1).alias("own_bit"))
    counted = joined_apart(rows, sizes, "sig").join(own, "node")
    bit = F.col("sig").bitwiseAND(1)
    by = Window.partitionBy("node", bit).orderBy(F.desc("n"), "sig")  # the signatures of one set
    spare = F.when(bit == F.col("own_bit"), F.col("spare")[0]).otherwise(F.col("spare")[1])
    return counted.withColumn("rank", F.row_number().over(by)).where(F.col("rank") > spare).select("sig", "node")


def with_texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The documents of some doc_ids, a stored table: those are broadcast if they are at most MOST_SENT, else both sides are shuffled."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return own.join(F.broadcast(ids) if ids.count() <= MOST_SENT else ids, "doc_id")


def near(pairs: DataFrame, nodes: DataFrame, percent: int, wide: bool = True) -> DataFrame:
    """The (a, b, doc_a, doc_b) of distinct pairs that may be similar by their sizes and parities; wide: if any node has wide ones."""
    side = lambda c: nodes.select(
        F.col("node").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("parity").alias(f"p_{c}"), F.col("one").alias(f"doc_{c}")
    )
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    apart = sum((F.bit_count(F.col("p_a")[k].bitwiseXOR(F.col("p_b")[k])) for k in range(PARITY_WORDS)), F.lit(0))
    total = F.col("n_a") + F.col("n_b")
    close = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent)
    close = close.where(apart * (100 + percent) <= total * (100 - percent)).drop("p_a", "p_b")
    if not wide:
        return close.select("a", "b", "doc_a", "doc_b")
    large = lambda c: nodes.where("wide is not null").select(F.col("node").alias(c), F.col("wide").alias(f"w_{c}"))
    close = close.join(large("a"), "a", "left").join(large("b"), "b", "left")
    apart = F.coalesce(wide_apart(F.col("w_a"), F.col("w_b")), F.lit(0))
    return close.where(apart * (100 + percent) <= total * (100 - percent)).select("a", "b", "doc_a", "doc_b")


def verified(close: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of stored pairs (a, b, doc_a, doc_b) that are similar, by their sets; a stored table."""
    wanted = close.select(F.col("a").alias("node"), F.col("doc_a").alias("doc_id"))
    wanted = wanted.unionByName(close.select(F.col("b").alias("node"), F.col("doc_b").alias("doc_id"))).distinct()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h, n = flat_sets([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])
            mine = pa.array(set_hashes(h, n), pa.int64(), mask=n == 0)
            yield pa.RecordBatch.from_arrays([batch.column(0), mine, lists(h.view(np.int64), n)], ["node", "own", "hashes"])

    # a doc_id may have rows with other texts: only the set that the node stands for counts
    wanted = stored(wanted, "ids")
    texts = with_texts(docs, wanted).select("node", "text")
    sets = map_arrow(texts, rows, "node bigint, own bigint, hashes array<bigint>").where("node = own").drop("own")
    sets = stored(sets.dropDuplicates(["node"]), "sets")
    discard(wanted)
    left = close.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("h_a")), "a")
    full = left.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("h_b")), "b")
    common = F.size(F.array_intersect("h_a", "h_b"))
    union = F.size("h_a") + F.size("h_b") - common
    links = stored(full.where(100 * common >= percent * union).select("a", "b"), "links")
    discard(sets)
    return links


class _Groups:
    """Nodes and the components that the links found so far make of them."""

    def __init__(self, nodes: DataFrame, docs: DataFrame, percent: int) -> None:
        self.nodes, self.docs, self.percent = nodes, docs, percent
        self.met: DataFrame | None = None  # all have a < b
        self.components: DataFrame | None = None
        self.wide = not nodes.where("wide is not null").isEmpty()

    def meet(self, pairs: DataFrame) -> None:
        """Verifies the pairs that have not met before and merges what they link."""
        if self.met is not None:  # before the other joins: distinct pairs lie by (a, b) already
            pairs = pairs.join(self.met, ["a", "b"], "left_anti")
        close = stored(near(pairs, self.nodes, self.percent, self.wide), "pairs")
        if self.met is not None and close.isEmpty():
            return
        met = close.select("a", "b")
        self.met = met if self.met is None else self.met.unionByName(met)
        found = verified(close, self.docs, self.percent)
        replaced = [found] if self.components is None else [found, self.components]
        if self.components is not None:
            if found.isEmpty():
                discard(found)
                return
            found = found.unionByName(self.components.select(F.col("node").alias("a"), F.col("component").alias("b")))
        self.components = stored(connected_components(found), "components")
        discard(*replaced)

    def unsettled(self, rows: DataFrame) -> DataFrame:
        """(sig, node, component, main, n) of the buckets that hold several components; main: the one with most nodes, n: all nodes."""
        known = rows.join(self.components, "node", "left")
        known = known.withColumn("component", F.coalesce("component", "node"))
        sizes = known.groupBy("sig", "component").agg(F.count("*").alias("size"))
        spread = sizes.groupBy("sig").agg(
            F.max(F.struct("size", "component"))["component"].alias("main"), F.sum("size").alias("n"), F.count("*").alias("several")
        )
        return joined_apart(known, spread.where("several > 1").select("sig", "main", "n"), "sig")


def _star(rows: DataFrame) -> DataFrame:
    """The smallest node of each bucket with every other."""
    low = rows.groupBy("sig").agg(F.min("node").alias("a"))
    return joined_apart(rows, low, "sig").where("node != a").select("a", F.col("node").alias("b")).distinct()


def _first_pairs(rows: DataFrame, small: int) -> DataFrame:
    """All pairs of buckets of at most `small` nodes; in larger ones the smallest node with every other."""
    sizes = rows.groupBy("sig").agg(F.min("node").alias("a"), F.count("*").alias("n"))
    star = joined_apart(rows, sizes.where(F.col("n") > small), "sig").where("node != a").select("a", F.col("node").alias("b"))
    few = rows.join(sizes.where(F.col("n") <= small).select("sig"), "sig")
    two = few.select("sig", F.col("node").alias("a")).join(few.select("sig", F.col("node").alias("b")), "sig").where("a < b")
    return star.unionByName(two.select("a", "b")).distinct()


def _across(rows: DataFrame, firsts: Column | None = None) -> DataFrame:
    """The pairs of a bucket's nodes in different components; firsts: which nodes outside the main component meet the others.

    Of each such pair one node is outside the main component, so nodes of a large group that is one component do not
    meet one another.
    """
    one = rows.where("component != main")
    one = one if firsts is None else one.where(firsts)
    left = one.select("sig", F.col("node").alias("x"), F.col("component").alias("c"))
    met = rows.join(left, "sig").where("component != c")
    return met.select(F.least("x", "node").alias("a"), F.greatest("x", "node").alias("b")).distinct()


def _close_pairs(percent: int):
    def meet(block: pa.Table) -> pa.Table:
        i, j = block["i"][0].as_py(), block["j"][0].as_py()
        part, node = block["part"].to_numpy(), block["node"].to_numpy()
        component, first = block["component"].to_numpy(), block["first"].to_numpy()
        size = block["n_shingles"].to_numpy()
        parity = block["parity"].combine_chunks().flatten().to_numpy().reshape(len(node), -1).view(np.uint64)
        found = []
        for one, two in {(i, j), (j, i)}:
            a, b = np.flatnonzero((part == one) & first), np.flatnonzero(part == two)
            for at in range(0, len(a), 256):
                some = a[at : at + 256]
                close = component[some][:, None] != component[b]
                low, high = np.minimum(size[some][:, None], size[b]), np.maximum(size[some][:, None], size[b])
                close &= 100 * low >= percent * high
                x, y = np.nonzero(close)
                x, y = some[x], b[y]
                apart = np.bitwise_count(parity[x] ^ parity[y]).sum(1, dtype=np.int64)
                near = apart * (100 + percent) <= (size[x] + size[y]) * (100 - percent)
                found.append(np.stack([node[x[near]], node[y[near]]]))
        pairs = np.sort(np.concatenate(found, 1), 0) if found else np.empty((2, 0), np.int64)
        return pa.table({"a": pa.array(pairs[0], pa.int64()), "b": pa.array(pairs[1], pa.int64())})

    return meet


def _across_close(rows: DataFrame, firsts: Column, percent: int, part: int = PART) -> DataFrame:
    """The pairs of `_across` that pass the filter by sizes and parities, found in blocks of at most `part` nodes a side.

    rows: (sig, node, component, main, n, n_shingles, parity). A pair that fails is never written, and none is written
    for each bucket that it shares.
    """
    parts = F.ceil(F.col("n") / part).cast("int")
    dealt = rows.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("first", (F.col("component") != F.col("main")) & firsts)
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    met = met.select("sig", "i", "j", "part", "node", "component", "first", "n_shingles", "parity")
    return met.groupBy("sig", "i", "j").applyInArrow(_close_pairs(percent), "a bigint, b bigint").distinct()


def _settle_large(groups: _Groups, rows: DataFrame) -> None:
    """More and more nodes of each bucket meet all others until no bucket holds a pair that has not met."""
    rank = F.xxhash64("node")
    share = 4
    rows = stored(rows.select("sig", "node").join(groups.nodes.select("node", "n_shingles", "parity"), "node"), "large")
    most = rows.groupBy("sig").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    while True:
        left = stored(groups.unsettled(rows), "unsettled")
        if left.isEmpty():
            return
        # about `share` nodes of each bucket by a hash; at the end all
        chosen = F.lit(True) if share >= most else (F.pmod(rank, F.col("n")) < share)
        groups.meet(_across_close(left, chosen, groups.percent))
        discard(left)
        if share >= most:
            return
        share *= 8


def components(docs: DataFrame, percent: int = PERCENT, small: int = SMALL) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    sets = stored(with_sets(docs, percent), "shingle-sets")
    nodes = sets.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull())
    nodes = nodes.groupBy("node").agg(
        F.min("doc_id").alias("one"), F.max("n_shingles").alias("n_shingles"), F.first("parity").alias("parity"), F.first("wide").alias("wide"),
        F.first("spare").alias("spare"),
    )
    nodes = stored(nodes, "nodes")
    groups = _Groups(nodes, docs, percent)
    texts = docs.where(F.col("doc_id").isNotNull())
    every = stored(shared(signed(texts, False, percent)), "signatures")
    weak = stored(rarest(every, nodes), "rarest")
    discard(every)
    groups.meet(_star(weak))
    left = stored(groups.unsettled(weak), "unsettled")
    groups.meet(_across(left.where(F.col("n") <= small)))
    large = groups.unsettled(left.where(F.col("n") > small).select("sig", "node"))
    large = stored(large.select("node").distinct(), "large-nodes")
    if not large.isEmpty():
        ids = stored(large.join(nodes, "node").select(F.col("one").alias("doc_id")), "ids")
        strong = shared(signed(with_texts(docs, ids).select("text"), True, percent)).join(large, "node", "left_semi")
        strong = stored(strong.select("sig", "node"), "signatures")
        discard(ids, weak, left)
        groups.meet(_first_pairs(strong, small))
        last = stored(groups.unsettled(strong).where(F.col("n") > small), "unsettled")
        if not last.isEmpty():
            _settle_large(groups, last)
    # from nodes to documents: rows of one doc_id are one vertex, which may tie several nodes
    found = groups.components
    tied = sets.where("doc_id is not null and node is not null").groupBy("doc_id").agg(
        F.min("node").alias("a"), F.max("node").alias("b")
    ).where("a != b")
    if not tied.isEmpty():
        own = sets.where("node is not null").join(tied, "doc_id").select("a", F.col("node").alias("b"))
        links = found.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(own)
        found = connected_components(links)
    whole = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = whole.groupBy("component").agg(F.min("one").alias("component_id"))
    # joined on another form of the component, so that this join shuffles both sides and can split a hot one
    ids = whole.select("node", F.hash("component").alias("h"), "component").join(
        lowest.select(F.hash("component").alias("h"), "component", "component_id"), ["h", "component"]
    )
    return (
        sets.drop("parity", "wide", "spare")
        .join(ids.select("node", "component_id"), "node", "left")
        .select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    )


JACCARD_SQL = """
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM {docs}),
    s AS (
      SELECT DISTINCT doc_id, md5_number_lower(array_to_string(w[i:i + 4], ' ')) AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    links AS (
      SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL)
      JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= {percent} * (p.n + q.n - c)),
    both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS v, doc_id AS r FROM w UNION SELECT b, r FROM reach JOIN both_ways ON a = v)
    SELECT doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(r) FROM reach WHERE v = doc_id) AS component_id
    FROM w LEFT JOIN n USING (doc_id)"""


@register("op5_jaccard_join", JACCARD_SQL.format(docs="documents", percent=PERCENT))
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(read(spark, sf_dir, "documents"))
