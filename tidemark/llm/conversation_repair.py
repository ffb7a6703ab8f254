"""Cheapest repair of conversations by an auction algorithm for shortest paths.

The rows of a conversation, by turn (nulls first; ties by role, then by the digest of the text), are layers of a lattice.
Its four states say what the repaired conversation ends with so far: nothing, a system row, a user row, an assistant row.
An edit is an arc: Delete and Keep and Rerole lead to the next layer, Insert stays in its layer. Costs are integers.

Every node has a price, at no time more than its distance to the end. A path grows from its origin: if the price of its last
node is below the cheapest (arc cost + price of the arc's head), the price is raised to that and the path contracts by a node,
else the path extends along that arc. When it reaches a node of known distance, the prices of the whole path are
distances. Origins are taken block by block from the end, and the prices of a block start at the least distance behind it plus
what every path must pay, so the raises of a block are bounded and the work is linear in the rows. Arcs that are
tight under the converged prices are the cheapest repairs; the trace takes the least letter among them and lets the
auction converge at the head of an arc before it trusts it.

Conversations are not gathered in one task. Equal rows of one turn become one row with a count. All rows are then sorted
over the cluster by range and cut into chunks of `chunk` rows; a conversation that stands in one chunk is repaired there. One
that spans chunks or tasks (a third of all rows, say) gives for each chunk the matrix of distances between the states at
both ends. Matrices are combined `fan` at a time, level by level; on the way back each chunk learns the distances at its
end and traces itself from every state, and a second scan of the same kind tells it the state it begins in.
Only the digest of a repaired conversation is made in one task, which reads the kept rows in order and holds none of them.

Null roles and texts count as one space. A null conv_id is a conversation of its own. A conversation of which no row is
left has zeros, an empty audit and the digest of empty bytes. Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read, stored
from tidemark.llm.registry import register

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
LEGAL_PAIRS = ("su", "ua", "au")
SPACE = " \t\n\x0b\x0c\r"
#: Rows of a chunk, matrices combined at once, and layers of a block of the auction.
CHUNK, FAN, BLOCK = 1024, 256, 8
NOTHING, SYSTEM, USER, ASSISTANT = STATES = range(4)
ROLES = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 50
#: Distances from the states behind the last row: what must be inserted there.
END = (0, 2 * INSERT, INSERT, 0)
EMPTY_SHA256 = hashlib.sha256(b"").hexdigest()


def following(state: int) -> int:
    """The state after a user or assistant row that may stand next."""
    return ASSISTANT if state == USER else USER


def after_keep(state: int, initial: str) -> int | None:
    """The state after a row with this role initial, None if it may not stand next."""
    if initial == "s":
        return SYSTEM if state == NOTHING else None
    return following(state) if initial == ROLES[following(state)][0] else None


class Lattice:
    """The arcs (cost, letters, head) of some rows, by first letter; node = 4 * layer + state.

    A row is (initial, live, truncated, forced): `live` is one row to be judged, `forced` the number of rows behind
    it that must go. `least` is what every path pays on a layer.
    """

    def __init__(self, rows: list[tuple[str, bool, bool, int]]) -> None:
        self.arcs: list[list[tuple[int, str, int]]] = []
        self.least: list[int] = []
        self.system: list[int] = []  # Delete's cost less Keep's, of rows that may open the conversation
        for initial, live, truncated, forced in rows:
            if live:
                extra = TRUNCATED if truncated else 0
                here = len(self.arcs)
                for state in STATES:
                    found = [(DELETE, "D", here + 4 + state), (INSERT, "I", here + following(state))]
                    kept = after_keep(state, initial)
                    if kept is not None:
                        found.append((KEEP + extra, "K", here + 4 + kept))
                    found.append((REROLE + extra, "R", here + 4 + following(state)))
                    self.arcs.append(found)
                self.least.append(min(DELETE, KEEP + extra))
                if initial == "s":
                    self.system.append(DELETE - KEEP - extra)
            if forced:
                here, cost = len(self.arcs), DELETE * forced
                for state in STATES:
                    self.arcs.append([(cost, "D" * forced, here + 4 + state), (INSERT, "I", here + following(state))])
                self.least.append(cost)
        self.layers = len(self.least)

    def all_deleted(self) -> int:
        return sum(self.arcs[4 * i][0][0] for i in range(self.layers))


class Auction:
    """Prices of a lattice whose distances behind the last layer are `end`."""

    def __init__(self, lattice: Lattice, end: list[int] | tuple[int, ...], block: int = BLOCK) -> None:
        self.arcs, n = lattice.arcs, lattice.layers
        self.price = [0] * (4 * n) + list(end)
        self.known = bytearray(4 * n) + b"\1" * 4
        high = n
        while high:
            low = max(0, high - block)
            least = min(self.price[4 * high : 4 * high + 4])
            for layer in range(high - 1, low - 1, -1):
                least += lattice.least[layer]
                self.price[4 * layer : 4 * layer + 4] = [least] * 4
            if low:
                for state in STATES:
                    self.distance(4 * low + state)
            high = low

    def distance(self, origin: int) -> int:
        """The distance of a node; afterwards the prices along a shortest path from it are distances."""
        price, known, arcs = self.price, self.known, self.arcs
        path = [origin]
        while not known[node := path[-1]]:
            best, head = FAR * 2, node
            for cost, _, to in arcs[node]:
                if cost + price[to] < best:
                    best, head = cost + price[to], to
            if price[node] < best:
                price[node] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(head)
        for node in path:
            known[node] = 1
        return price[origin]

    def trace(self, node: int) -> tuple[str, int, int]:
        """(letters, cost, state at the end) of the cheapest path whose letters come first."""
        letters, total, end = [], 0, len(self.arcs)
        self.distance(node)
        while node < end:
            for cost, letter, to in self.arcs[node]:
                if self.price[node] == cost + self.price[to] and self.price[node] == cost + self.distance(to):
                    break
            letters.append(letter)
            total += cost
            node = to
        return "".join(letters), total, node - end


def traced(lattice: Lattice, end: list[int] | tuple[int, ...], last: bool, states: range | tuple[int, ...]) -> list[tuple[str, int, int]]:
    """The trace from each of the states; behind the last row the missing rows are inserted."""
    auction, found = Auction(lattice, end), []
    for state in states:
        letters, cost, to = auction.trace(state)
        if last:
            letters, cost, to = letters + "I" * (END[to] // INSERT), cost + END[to], NOTHING
        found.append((letters, cost, to))
    return found


def matrix(lattice: Lattice) -> list[int]:
    """Distances from every state before the rows to every state behind them, row by row."""
    found = np.full((4, 4), FAR, np.int64)
    gone = lattice.all_deleted()
    found[NOTHING, NOTHING] = found[SYSTEM, SYSTEM] = gone  # only by deleting all
    if lattice.system:
        found[NOTHING, SYSTEM] = gone - max(lattice.system)
    for to in (USER, ASSISTANT):
        end = [FAR] * 4
        end[to] = 0
        auction = Auction(lattice, end)
        found[:, to] = [auction.distance(state) for state in STATES]
    return found.ravel().tolist()


def replayed(rows: list[tuple[str, str, bool, int]], letters: str, state: int) -> Iterator[tuple[str, str | None, str | None]]:
    """(new role, old role, digest) of the repaired rows of a chunk; the old role and the digest are null for inserted rows."""
    at = 0
    for role, digest, live, forced in rows:
        if live:
            while letters[at] == "I":
                state, at = following(state), at + 1
                yield ROLES[state], None, None
            if letters[at] == "K":
                state = after_keep(state, role[:1])
                yield role, role, digest
            elif letters[at] == "R":
                state = following(state)
                yield ROLES[state], role, digest
            at += 1
        at += forced
    for _ in letters[at:]:
        state = following(state)
        yield ROLES[state], None, None


def pair_is_legal(a: Column, b: Column) -> Column:
    return F.concat(a, b).isin(*LEGAL_PAIRS)


def faults(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The distinct rows of (conv_id, turn, role, text, times), counted and judged, and the first text of each kind of row.

    `live` rows are judged by the repair, the `forced` equal rows behind them are blank or duplicate.
    """
    stripped = F.rtrim("text", F.lit(SPACE))
    each = turns.select(
        "conv_id", "turn", "role", "text", "times", F.sha2("text", 256).alias("digest"),
        (stripped == "").alias("blank"), (~F.right(stripped, F.lit(1)).isin(".", "!", "?")).alias("open"),
    )  # fmt: skip
    kinds = each.groupBy("conv_id", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("has"), "turn")).alias("first"), F.first("text").alias("text")
    )
    kinds = stored(kinds, "kinds")
    distinct = each.groupBy("conv_id", "turn", "role", "digest").agg(
        F.sum("times").alias("times"), F.max("blank").alias("blank"), F.max("open").alias("open")
    )
    # the kinds are read from a table, so both sides are shuffled by the join itself and a hot kind can be split
    k = kinds.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("first.turn").alias("f"))
    same = distinct.conv_id.eqNullSafe(k.c) & (distinct.role == k.r) & (distinct.digest == k.d)
    judged = distinct.join(k, same).withColumn("is_first", F.col("turn").eqNullSafe(F.col("f")))
    live = F.col("is_first") & ~F.col("blank")
    rows = judged.select(
        "conv_id", "turn", "role", "digest", "times", "blank", "is_first", live.alias("live"),
        (live & F.col("open")).alias("truncated"), (F.col("times") - live.cast("long")).alias("forced"),
    )  # fmt: skip
    return stored(rows, "rows"), kinds


def cut(rows: DataFrame, chunk: int) -> DataFrame:
    """All rows in order as chunks of one conversation: those of a conversation that lies within a task are whole.

    `part` and `idx` order the chunks of a conversation, `illegal` counts pairs of neighbours within a task.
    """
    order = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("digest")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    fields = ["role", "digest", "live", "truncated", "forced"]
    key = rows.schema["conv_id"].dataType.simpleString()
    kinds = "roles array<string>, digests array<string>, live array<boolean>, truncated array<boolean>, forced array<bigint>"
    schema = f"conv_id {key}, part int, idx bigint, whole boolean, head string, tail string, illegal bigint, {kinds}"
    names = ["conv_id", "part", "idx", "whole", "head", "tail", "illegal", "roles", "digests", "live", "truncated", "forced"]
    lists = [pa.string(), pa.string(), pa.bool_(), pa.bool_(), pa.int64()]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held: list[tuple] = []
        current, idx, first, before, kind = None, 0, True, None, None

        def closed(whole: bool) -> tuple:
            illegal, last = 0, before
            for role, _, live, _, forced in held:
                initial = role[:1]
                illegal += (last is not None and last + initial not in LEGAL_PAIRS) + live + forced - 1
                last = initial
            return (current, part, idx, whole, held[0][0][:1], last, illegal, *map(list, zip(*held)))

        def batch_of(found: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*found)) if found else [()] * len(names)
            kinds = [kind, pa.int32(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.int64(), *map(pa.list_, lists)]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            kind, found = batch.schema.field(0).type, []
            for conv, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if held and conv != current:
                    found.append(closed(idx == 0 and not first))
                    held, idx, first, before = [], 0, False, None
                elif len(held) == chunk:
                    found.append(closed(False))
                    held, idx, before = [], idx + 1, found[-1][5]
                current = conv
                held.append(tuple(row))
            if found:
                yield batch_of(found)
        if held:
            yield batch_of([closed(False)])

    return stored(map_arrow(ordered.select("conv_id", *fields), chunks, schema), "chunks")


def numbered(chunks: DataFrame) -> DataFrame:
    """The chunks that are not whole with `n`, their number in the conversation, and `last`; pairs across tasks are added.

    The windows run over one row for each task and conversation that reaches over its edge.
    """
    own = chunks.groupBy("conv_id", "part").agg(
        F.count(F.lit(1)).alias("size"), F.min_by("head", "idx").alias("head"), F.max_by("tail", "idx").alias("tail")
    )
    by = Window.partitionBy("conv_id")
    before = by.orderBy("part")
    ends = own.select(
        F.col("conv_id").alias("c"), F.col("part").alias("p"),
        F.coalesce(F.sum("size").over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"),
        F.sum("size").over(by).alias("total"),
        F.coalesce((~pair_is_legal(F.lag("tail").over(before), F.col("head"))).cast("long"), F.lit(0)).alias("across"),
    )  # fmt: skip
    joined = chunks.join(ends, chunks.conv_id.eqNullSafe(ends.c) & (chunks.part == ends.p))
    n = (F.col("shift") + F.col("idx")).alias("n")
    illegal = F.col("illegal") + F.when(F.col("idx") == 0, F.col("across")).otherwise(0)
    rest = [c for c in chunks.columns if c not in ("illegal", "idx", "part", "head", "tail", "whole")]
    return joined.select(*rest, n, (n + 1 == F.col("total")).alias("last"), illegal.alias("illegal"))


def times_vector(m: list[int], v: np.ndarray, forward: bool) -> np.ndarray:
    """The distances on the other side of a matrix: from the states before it, or (`forward`) to those behind it."""
    square = np.array(m, np.int64).reshape(4, 4)
    return np.minimum(((square.T if forward else square) + v).min(1), FAR)


def vectors(elements: DataFrame, start: tuple[int, ...], forward: bool, fan: int) -> DataFrame:
    """(conv_id, n, v): of (conv_id, n, m) the distances at one end of every matrix.

    Backward: distances from the states behind it to the conversation's end, which are `start` behind the last one.
    Forward: distances from the conversation's beginning, where they are `start`, to the states before it.
    """
    key = elements.schema["conv_id"].dataType.simpleString()

    def combined(table: pa.Table) -> pa.Table:
        table = table.sort_by("n")
        product = None
        for m in table["m"].to_pylist():
            square = np.array(m, np.int64).reshape(4, 4)
            product = square if product is None else np.minimum((product[:, :, None] + square[None]).min(1), FAR)
        one = table.slice(0, 1).select(["conv_id"])
        up = pa.array([table["n"][0].as_py() // fan], pa.int64())
        return one.append_column("n", up).append_column("m", pa.array([product.ravel().tolist()], pa.list_(pa.int64())))

    def resolved(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending" if forward else "descending")])
        v, found = np.array(table["v"][0].as_py(), np.int64), []
        for m in table["m"].to_pylist():
            found.append(v.tolist())
            v = times_vector(m, v, forward)
        return table.select(["conv_id", "n"]).append_column("v", pa.array(found, pa.list_(pa.int64())))

    most = elements.agg(F.max("n")).first()[0] or 0
    levels = [elements.select("conv_id", "n", "m")]
    while most:
        up = levels[-1].groupBy("conv_id", F.floor(F.col("n") / fan).alias("up"))
        levels.append(stored(up.applyInArrow(combined, f"conv_id {key}, n bigint, m array<bigint>"), "level"))
        most //= fan
    known = levels.pop().select("conv_id", "n", F.array(*map(F.lit, start)).cast("array<bigint>").alias("v"))
    while levels:
        level = levels.pop().withColumn("up", F.floor(F.col("n") / fan))
        above = known.select(F.col("conv_id").alias("c"), F.col("n").alias("above"), "v")
        joined = level.join(above, level.conv_id.eqNullSafe(above.c) & (level.up == above.above)).drop("c", "above")
        known = stored(joined.groupBy("conv_id", "up").applyInArrow(resolved, f"conv_id {key}, n bigint, v array<bigint>"), "vectors")
    return known


def with_columns(df: DataFrame, new: dict[str, tuple[str, pa.DataType]], fn) -> DataFrame:
    """The rows with new columns, which `fn` makes from each row as a dict."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fn(row) for row in batch.to_pylist()]
            columns = [pa.array([x[i] for x in found], kind) for i, (_, kind) in enumerate(new.values())]
            yield pa.RecordBatch.from_arrays(batch.columns + columns, batch.schema.names + list(new))

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)
    return map_arrow(df, added, own + ", ".join(f"{c} {t}" for c, (t, _) in new.items()))


def lattice_of(row: dict) -> Lattice:
    initials = (role[:1] for role in row["roles"])
    return Lattice(list(zip(initials, row["live"], row["truncated"], row["forced"])))


INTS = ("array<bigint>", pa.list_(pa.int64()))
TRACES = {"audits": ("array<string>", pa.list_(pa.string())), "costs": INTS, "exits": INTS}


def _traces(row: dict) -> list[tuple]:
    states = (NOTHING,) if row["entry"] == NOTHING else STATES
    return list(zip(*traced(lattice_of(row), row["v"], row["last"], states)))


def _exits_matrix(row: dict) -> list[list[int]]:
    square = np.full((4, 4), FAR, np.int64)
    square[STATES, row["exits"]] = 0
    return [square.ravel().tolist()]


def solved(chunks: DataFrame, fan: int) -> DataFrame:
    """The chunks with `n`, `entry` (the state they begin in), `audit` and `cost` of the cheapest repair."""
    end = F.array(*map(F.lit, END)).cast("array<bigint>")
    arrays = ["roles", "digests", "live", "truncated", "forced"]
    whole = chunks.where("whole").select(
        "conv_id", F.lit(0).cast("bigint").alias("n"), F.lit(True).alias("last"), "illegal", *arrays, end.alias("v"), F.lit(NOTHING).alias("entry")
    )
    whole = with_columns(whole, TRACES, _traces)
    found = whole.select("conv_id", "n", "entry", "illegal", *arrays, F.col("audits")[0].alias("audit"), F.col("costs")[0].alias("cost"))
    parts = stored(numbered(chunks.where(~F.col("whole"))), "parts")
    matrices = with_columns(parts.select("conv_id", "n", *arrays), {"m": INTS}, lambda row: [matrix(lattice_of(row))])
    ends = vectors(stored(matrices.select("conv_id", "n", "m"), "matrices"), END, False, fan)

    def at(df: DataFrame, known: DataFrame) -> DataFrame:
        known = known.select(F.col("conv_id").alias("c"), F.col("n").alias("k"), "v")
        return df.join(known, df.conv_id.eqNullSafe(known.c) & (df.n == known.k)).drop("c", "k")

    parts = stored(with_columns(at(parts, ends).withColumn("entry", F.lit(None).cast("int")), TRACES, _traces).drop("v", "entry"), "traces")
    exits = with_columns(parts.select("conv_id", "n", "exits"), {"m": INTS}, _exits_matrix)
    begins = vectors(stored(exits.select("conv_id", "n", "m"), "exits"), (0, FAR, FAR, FAR), True, fan)
    parts = at(parts, begins).withColumn("entry", F.array_position("v", F.lit(0).cast("bigint")).cast("int") - 1)
    parts = parts.select(
        "conv_id", "n", "entry", "illegal", *arrays, F.get("audits", F.col("entry")).alias("audit"), F.get("costs", F.col("entry")).alias("cost")
    )
    return stored(found.unionByName(parts), "solved")


def repaired_rows(pieces: DataFrame) -> DataFrame:
    """(conv_id, n, k, role, old_role, digest) of the repaired rows in order of (n, k)."""
    key = pieces.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "n", "k", "role", "old_role", "digest"]

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in batch.to_pylist():
                rows = list(zip(row["roles"], row["digests"], row["live"], row["forced"]))
                new = replayed(rows, row["audit"], row["entry"])
                found += [(row["conv_id"], row["n"], k, *x) for k, x in enumerate(new)]
            columns = list(zip(*found)) if found else [()] * 6
            kinds = [batch.schema.field("conv_id").type, pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return map_arrow(
        pieces.select("conv_id", "n", "entry", "audit", "roles", "digests", "live", "forced"),
        replay,
        f"conv_id {key}, n bigint, k bigint, role string, old_role string, digest string",
    )


def with_texts(rows: DataFrame, kinds: DataFrame) -> DataFrame:
    """(conv_id, n, k, role, text): the repaired rows with their texts, inserted ones with empty ones."""
    k = kinds.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "text")
    same = rows.conv_id.eqNullSafe(k.c) & (rows.old_role == k.r) & (rows.digest == k.d)
    return rows.join(k, same, "left").select("conv_id", "n", "k", "role", F.coalesce("text", F.lit("")).alias("text"))


def digests(lines: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): the digest of each conversation's `role:text` lines, read in order."""
    ordered = lines.select("conv_id", "n", "k", F.concat_ws(":", "role", "text").alias("line"))
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "n", "k").select("conv_id", "line")
    key = lines.schema["conv_id"].dataType.simpleString()

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, kind = None, None, pa.int64()
        for batch in batches:
            kind, found = batch.schema.field(0).type, []
            for conv, line in zip(*(c.to_pylist() for c in batch.columns)):
                if state is not None and conv == current:
                    state.update(b"\n")
                else:
                    if state is not None:
                        found.append((current, state.hexdigest()))
                    current, state = conv, hashlib.sha256()
                state.update(line.encode("utf-8", "surrogatepass"))
            yield _pairs(found, kind)
        if state is not None:
            yield _pairs([(current, state.hexdigest())], kind)

    return map_arrow(ordered, hashed, f"conv_id {key}, repaired_sha256 string")


def _pairs(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    a, b = list(zip(*found)) if found else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, pa.string())], ["conv_id", "repaired_sha256"])


def filled(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, times) with null roles and texts as one space; `times` is 1 if there is no such column."""
    blank = [F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")]
    times = F.col("times") if "times" in turns.columns else F.lit(1)
    return turns.select("conv_id", "turn", *blank, times.cast("long").alias("times"))


def damaged(turns: DataFrame) -> DataFrame:
    """Rows dropped, emptied, robbed of their ends, repeated or given to the user, by a checksum of conversation and turn."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    case = F.crc32(key.cast("binary")) % 20
    text = F.when(case == 1, "").when(case == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(case == 4, "user").otherwise(F.col("role"))
    times = F.col("times") * F.when(case == 3, 2).otherwise(1)
    return filled(turns).where(case != 0).select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("times"))


def repair(turns: DataFrame, chunk: int = CHUNK, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """Of rows as `filled` gives them: a report per conversation, and the repaired rows (conv_id, n, k, role, text).

    The repaired rows of a conversation stand in the order of (n, k).
    """
    rows, kinds = faults(turns)
    pieces = solved(cut(rows, chunk), fan)
    lines = stored(with_texts(repaired_rows(pieces), kinds), "repaired")
    counts = rows.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).cast("long").alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("times")).otherwise(0)).alias("blank"),
        F.sum(F.when(~F.col("blank"), F.col("times") - F.col("is_first").cast("long")).otherwise(0)).alias("duplicate"),
        F.sum(F.col("truncated").cast("long")).alias("truncated"),
    )
    in_order = F.array_sort(F.collect_list(F.struct("n", "audit")))
    audits = pieces.groupBy("conv_id").agg(
        F.sum("illegal").alias("illegal"), F.sum("cost").alias("cost"), F.concat_ws("", F.transform(in_order, lambda x: x.audit)).alias("audit")
    )
    report = counts
    for more in (audits, digests(lines)):
        more = more.withColumnRenamed("conv_id", "c")
        report = report.join(more, report.conv_id.eqNullSafe(more.c), "left").drop("c")
    return report.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256))), lines


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def for_all(conversations: DataFrame, report: DataFrame) -> DataFrame:
    """A row for every conv_id; conversations without a report have zeros and nothing repaired."""
    ids = conversations.select(F.col("conv_id").alias("c")).distinct()
    joined = ids.join(report, ids.c.eqNullSafe(report.conv_id), "left")
    zeros = [F.coalesce(x, F.lit(0)).cast("long").alias(x) for x in COUNTS]
    texts = [F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(EMPTY_SHA256)).alias("repaired_sha256")]
    return joined.select(F.col("c").alias("conv_id"), *zeros, *texts)


def _best(*options: str) -> str:
    return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"


def _then(state: str, cost: str, letter: str, line: str | None = None) -> str:
    """The way on from `state` after an edit, in SQL."""
    lines = f"list_prepend({line}, {state}.l)" if line else f"{state}.l"
    return f"struct_pack(c := {cost} + {state}.c, a := '{letter}' || {state}.a, l := {lines})"


def _from(state: str, keep: str, after_keep: str, role: str, after: str) -> str:
    """The cheapest way on from a state without an insertion; `keep` says when the row may stay."""
    kept = f"CASE WHEN NOT gone AND {keep} THEN {_then(after_keep, 'extra', 'K', 'line')} END"
    given = f"CASE WHEN NOT gone THEN {_then(after, '1 + extra', 'R', f"""'{role}:' || text""")} END"
    return _best(_then(state, "2", "D"), kept, given)


#: The states of the SQL are o (nothing), s, u and a; c is the cost, a the audit and l the lines from there on.
ORACLE = rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations
), checked AS (
  SELECT *, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda c, b: list_reduce(list_prepend(xor(c, b), CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])),
      lambda y, z: xor(y >> 1, 3988292384 * (y & 1))))) % 20 AS k FROM given
), damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN k = 3 THEN [1, 2] ELSE [1] END) AS copy
  FROM checked WHERE k <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged
), judged AS (
  SELECT *, NOT regexp_matches(text, '[^ 	-]') AS blank, NOT regexp_matches(text, '[.!?][ 	-]*$') AS open,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, left(role, 1) AS initial,
    lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS before
  FROM placed
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT again AND NOT blank) AS truncated,
    count(*) FILTER (before || initial NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n
  FROM judged GROUP BY conv_id
), steps AS (
  SELECT conv_id, n + 1 AS i, struct_pack(c := 0, a := '', l := CAST([] AS VARCHAR[])) AS o,
    struct_pack(c := 10, a := 'II', l := ['user:', 'assistant:']) AS s, struct_pack(c := 5, a := 'I', l := ['assistant:']) AS u,
    struct_pack(c := 0, a := '', l := CAST([] AS VARCHAR[])) AS a
  FROM counted
  UNION ALL
  SELECT conv_id, i, {_best("o", _then("w", "5", "I", "'user:'"))}, {_best("s", _then("w", "5", "I", "'user:'"))}, w,
    {_best("a", _then("u", "5", "I", "'user:'"))}
  FROM (
    SELECT *, {_best("u", _then("a", "5", "I", "'assistant:'"))} AS w FROM (
      SELECT conv_id, i, {_from("o", "initial IN ('s', 'u')", "(CASE WHEN initial = 's' THEN s ELSE u END)", "user", "u")} AS o,
        {_from("s", "initial = 'u'", "u", "user", "u")} AS s, {_from("u", "initial = 'a'", "a", "assistant", "a")} AS u,
        {_from("a", "initial = 'u'", "u", "user", "u")} AS a
      FROM (
        SELECT j.conv_id, j.i, j.text, j.initial, j.role || ':' || j.text AS line, j.blank OR j.again AS gone,
          CASE WHEN j.open THEN 5 ELSE 0 END AS extra, o, s, u, a
        FROM steps JOIN judged j ON j.conv_id IS NOT DISTINCT FROM steps.conv_id AND j.i = steps.i - 1)))
)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(o.c, 0) AS BIGINT) AS cost,
  coalesce(o.a, '') AS audit, sha256(coalesce(array_to_string(o.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN counted c ON c.conv_id IS NOT DISTINCT FROM g.conv_id
LEFT JOIN steps t ON t.conv_id IS NOT DISTINCT FROM g.conv_id AND t.i = 1
"""


@register("op11_conversation_repair", ORACLE)
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = read(spark, sf_dir, "conversations")
    return for_all(conversations, repair(damaged(conversations))[0])
