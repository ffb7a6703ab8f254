"""Near-duplicate vectors by sorted projection passes.

Equal vectors of a label are one node with a count. In each pass a node gets a key of BITS random sign bits (on which
side of random planes it lies); nodes are put in the lexicographic order of label and key, and each is compared with
the next `window` nodes of its label by exact cosine. Where all labels have at most `window` + 1 nodes, one pass is enough. Pairs found are verified and united across passes into components;
links are then counted inside the components, in blocks of at most BLOCK nodes that meet in pairs. So the work of a pass
grows with the nodes, whatever the size of a label.

A pair is missed if no pass brings it near. The recall depends on how alike the vectors of a label are; it is measured in
the tests and given in the README. `exact` compares all pairs of a label instead, in blocks, whose work grows with the
square of a label's nodes; the tests hold the passes against it.

Passes are made `TOGETHER` at a time: their orders are one table of that many rows a node, written to the shared folder and
deleted after use. A block of it gives at most one link a row, to the node that stands for its component there.

Vectors that are null, zero, of a null label, or hold a null or a non-finite component link with nothing and are kept
as their own component. A null vec_id is compared like others; a component's id is its smallest vec_id that is not
null, or null. Rows that repeat a vec_id are separate vectors. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import connected_components, discard, read, stored
from tidemark.llm.registry import register

COSINE = 0.98
#: Nodes of a label that meet as many others at a time.
PART = 2048
BITS = 60
#: Passes, nodes of the order that a node is compared with in each, and passes of one plan.
PASSES, WINDOW, TOGETHER = 48, 100, 8
#: Nodes of the order in a block, and of a component that meet at a time.
ORDER_BLOCK, BLOCK = 2048, 512
SEED = 11


def usable(embeddings: DataFrame) -> DataFrame:
    """The rows that can link: (row, vec_id, label, v)."""
    v = F.col("v")
    good = F.aggregate(v, F.lit(True), lambda ok, x: ok & F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    norm = F.aggregate(v, F.lit(0.0), lambda s, x: s + F.abs(x))
    return embeddings.where(v.isNotNull() & F.col("label").isNotNull()).where(good).where(norm > 0)


def _keys(numbers: range):
    """For each vector its key in each of the passes."""
    weights = np.int64(1) << np.arange(BITS - 1, -1, -1, dtype=np.int64)

    @F.pandas_udf("array<long>")
    def keys(v: pd.Series) -> pd.Series:
        sizes = v.map(len)
        out = np.zeros((len(v), len(numbers)), np.int64)
        for d in sizes.unique():
            mine = (sizes == d).to_numpy()
            x = np.stack(v[mine].to_list()).astype(float)
            for k, number in enumerate(numbers):
                planes = np.random.default_rng([SEED, number, int(d)]).normal(size=(int(d), BITS))
                out[mine, k] = (x @ planes > 0) @ weights
        return pd.Series(list(out))

    return keys


def unit(rows: pd.Series) -> np.ndarray:
    """Vectors of one dimension scaled to length one."""
    return scaled(np.stack(rows.to_list()).astype(float))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; by their largest part first, so that none overflows."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def standing_for(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n places the least place reachable over the links (a, b)."""
    low = np.arange(n)
    while True:
        new = low.copy()
        np.minimum.at(new, a, low[b])
        np.minimum.at(new, b, low[a])
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _windows(window: int, cosine: float):
    def compare(block: pa.Table) -> pa.Table:
        block = block.sort_by("place").combine_chunks()
        node, group = block["node"].to_numpy(), [block[c].to_numpy() for c in ("pass", "label", "d")]
        change = np.zeros(len(node), bool)
        for g in group:
            change[1:] |= g[1:] != g[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), len(node)]
        found = []
        for begin, end in zip(edges, edges[1:]):
            d = int(group[2][begin])
            x = block["v"].slice(begin, end - begin).combine_chunks().flatten().to_numpy().astype(float)
            x = scaled(x.reshape(-1, d))
            pairs = []
            for step in range(1, min(window, len(x) - 1) + 1):
                near = np.flatnonzero((x[:-step] * x[step:]).sum(1) >= cosine)
                pairs.append((near, near + step))
            if not pairs:
                continue
            a, b = (np.concatenate(side) for side in zip(*pairs))
            low = standing_for(len(x), a, b)
            linked = np.flatnonzero(low != np.arange(len(x)))
            found.append((node[begin + linked], node[begin + low[linked]]))
        a, b = (np.concatenate(side) for side in zip(*found)) if found else ([], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return compare


def _order(nodes: DataFrame, numbers: range) -> DataFrame:
    """(node, label, d, v, pass, at): `at` counts up in the order of pass, label, dimension and key."""
    keyed = nodes.select("*", F.posexplode(_keys(numbers)("v")).alias("pass", "key"))
    parts = max(1, int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    order = ["pass", "label", "d", "key", "node"]
    ordered = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    # the low 33 bits count the rows of a partition, the high ones number the partitions
    return stored(ordered.withColumn("at", F.monotonically_increasing_id()).drop("key"), "order")


def _placed(ordered: DataFrame) -> DataFrame:
    """The order with `place`, a number without gaps."""
    part = F.shiftright("at", 33)
    sizes = ordered.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # a row per partition of the order: as many as tasks
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    placed = ordered.withColumn("part", part).join(before, "part")
    return placed.select("node", "label", "d", "v", "pass", (F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)).alias("place"))


def links(nodes: DataFrame, cosine: float, passes: int, window: int) -> DataFrame:
    """(a, b): each node that has links found in the passes, with one that stands for its component; nodes: (node, label, d, v).

    `v` may hold floats; they are compared as doubles.
    """
    found = None
    for first in range(0, passes, TOGETHER):
        ordered = _order(nodes, range(first, min(first + TOGETHER, passes)))
        placed = _placed(ordered)
        block = F.floor(F.col("place") / ORDER_BLOCK)
        # a block also gets the first `window` nodes of the next blocks
        reach = F.floor((F.col("place") - window) / ORDER_BLOCK)
        each = placed.withColumn("block", F.explode(F.sequence(F.greatest(reach, F.lit(0)), block)))
        # each plan ends here, so that the driver never holds all passes as one
        some = stored(each.groupBy("block").applyInArrow(_windows(window, cosine), "a bigint, b bigint").distinct(), "links")
        discard(ordered)
        found = some if found is None else found.unionByName(some)
    return found.distinct()


def _near(left: pd.DataFrame, right: pd.DataFrame, same: bool, cosine: float) -> np.ndarray:
    """Which rows of the left are linked with which of the right; same: both are the same rows."""
    a, b = unit(left["v"]), unit(right["v"])
    near = a @ b.T
    # the product is only a filter: pairs near the threshold are computed like all others
    edge = np.argwhere(np.abs(near - cosine) < 1e-9)
    if len(edge):
        near[edge[:, 0], edge[:, 1]] = (a[edge[:, 0]] * b[edge[:, 1]]).sum(1)
    near = near >= cosine
    if same:
        np.fill_diagonal(near, False)
    return near


def _blocks(cosine: float):
    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        one, two = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["part"] == one], pdf[pdf["part"] == two]
        if len(left) and len(right):
            near = _near(left, right, one == two, cosine)
            out.append(pd.DataFrame({"node": left["node"], "more": near @ right["copies"].to_numpy()}))
            if one != two:
                out.append(pd.DataFrame({"node": right["node"], "more": near.T @ left["copies"].to_numpy()}))
        return pd.concat(out) if out else pd.DataFrame({"node": [], "more": []})

    return count


def link_counts(members: DataFrame, cosine: float) -> DataFrame:
    """(node, more): vectors of other nodes linked to each node; members: (node, component, copies, v)."""
    sizes = members.groupBy("component").agg(F.count("*").alias("n")).where("n > 1")
    parts = F.ceil(F.col("n") / BLOCK).cast("int")
    dealt = members.join(sizes, "component").withColumn("parts", parts)
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # each part meets itself and every other part once
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    met = met.select("component", "i", "j", "part", "node", "copies", "v")
    some = met.groupBy("component", "i", "j").applyInPandas(_blocks(cosine), "node bigint, more bigint")
    return some.groupBy("node").agg(F.sum("more").alias("more"))


def _lowest(near: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes and the smallest node that each reaches over the links between left and right."""
    nodes = np.unique(np.concatenate([left, right]))
    a, b = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
    low = np.arange(len(nodes))
    while True:
        new = low.copy()
        new[a] = np.minimum(new[a], np.where(near, low[b], len(nodes)).min(1))
        new[b] = np.minimum(new[b], np.where(near, low[a][:, None], len(nodes)).min(0))
        new = new[new]
        if (new == low).all():
            return nodes, nodes[low]
        low = new


def _meetings(cosine: float):
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"node": [], "more": [], "low": []}, dtype=np.int64)
        one, two = pdf["i"].iloc[0], pdf["j"].iloc[0]
        left, right = pdf[pdf["part"] == one], pdf[pdf["part"] == two]
        if not (len(left) and len(right)):
            return none
        near = _near(left, right, one == two, cosine)
        rows, columns = near.any(1), near.any(0)
        if not rows.any():
            return none
        near, left, right = near[rows][:, columns], left[rows], right[columns]
        nodes, low = _lowest(near, left["node"].to_numpy(), right["node"].to_numpy())
        more = np.zeros(len(nodes), np.int64)
        more[np.searchsorted(nodes, left["node"])] += near @ right["copies"].to_numpy()
        if one != two:
            more[np.searchsorted(nodes, right["node"])] += near.T @ left["copies"].to_numpy()
        return pd.DataFrame({"node": nodes, "more": more, "low": low})

    return meet


def all_links(nodes: DataFrame, cosine: float, part: int = PART) -> DataFrame:
    """(node, more, low) of each meeting of two parts: a node's linked vectors there, and the smallest node it reaches.

    nodes: (node, label, d, v, copies).
    """
    sizes = nodes.groupBy("label", "d").agg(F.ceil(F.count("*") / part).cast("int").alias("parts"))
    dealt = nodes.join(sizes, ["label", "d"])
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    # each part meets itself and every other part once
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    met = met.withColumn("i", F.least("part", "other")).withColumn("j", F.greatest("part", "other"))
    met = met.select("label", "d", "i", "j", "part", "node", "copies", "v")
    met = met.groupBy("label", "d", "i", "j").applyInPandas(_meetings(cosine), "node bigint, more bigint, low bigint")
    return stored(met, "links")


def near_duplicates(
    embeddings: DataFrame, cosine: float = COSINE, passes: int = PASSES, window: int = WINDOW, exact: bool = False
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row, by sorted passes, or by all pairs of a label if `exact`."""
    rows = embeddings.select(
        F.col("vec_id").cast("long"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("v")
    )
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    good = usable(rows)
    nodes = good.groupBy("label", "v").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("one"))
    nodes = stored(nodes.withColumn("d", F.size("v")), "vector-nodes")
    if exact:
        met = all_links(nodes.select("node", "label", "d", "v", "copies"), cosine)
        found = connected_components(met.select(F.col("node").alias("a"), F.col("low").alias("b")))
        more = met.groupBy("node").agg(F.sum("more").alias("more"))
    else:
        largest = nodes.groupBy("label", "d").count().agg(F.max("count")).first()[0] or 0
        passes = passes if largest > window + 1 else 1
        # the orders carry the vectors in the type they came in
        v = F.col("v").cast(embeddings.schema["embedding"].dataType).alias("v")
        found = connected_components(links(nodes.select("node", "label", "d", v), cosine, passes, window))
        more = link_counts(nodes.join(found, "node").select("node", "component", "copies", "v"), cosine)
    whole = nodes.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lowest = whole.groupBy("component").agg(F.min("one").alias("component_id"))
    whole = whole.join(lowest, "component").join(more, "node", "left")
    whole = whole.select("label", "v", (F.col("copies") - 1 + F.coalesce("more", F.lit(0))).alias("n_links"), "component_id")
    linked = good.join(whole, ["label", "v"]).select("row", "vec_id", "n_links", "component_id")
    rest = rows.select("row", "vec_id").join(good.select("row"), "row", "left_anti")
    rest = rest.select("row", "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


@register(
    "op10_embedding_dedup",
    f"""
    WITH RECURSIVE g AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE label IS NOT NULL
        AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        AND len(list_filter(embedding, lambda x: x != 0)) > 0),
    links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.label = b.label AND a.vec_id != b.vec_id
        AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= {COSINE}),
    n AS (SELECT a, count(*) AS n FROM links GROUP BY a),
    reach AS (SELECT vec_id AS v, vec_id AS r FROM embeddings UNION SELECT b, r FROM reach JOIN links ON a = v),
    c AS (SELECT v AS vec_id, min(r) AS component_id FROM reach GROUP BY v)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
    FROM embeddings LEFT JOIN n ON a = vec_id JOIN c USING (vec_id)""",
)
def op10_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
