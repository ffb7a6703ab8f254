"""SentencePiece encoding and decoding with a max-plus scan over the chunks of giant texts.

For a byte-pair model a sequence of pieces is the encoding of a text exactly if every two neighbours are compatible:
the model, run on the two pieces alone, gives these two pieces. The encoding is therefore the one best path through
the lattice of all pieces in which an edge weighs 0 if its ends are compatible and minus infinity if not: the scan is
max-plus, and its finite entries say what can be reached. From a known piece on, at most one piece can end at any
place, so the path is found left to right.

A text of more than `chunk` code points is split. The state at a boundary is the piece that reaches it or stands
across it, and by how many code points it overhangs. Each chunk yields the max-plus matrix from the states at its start
to those at its end, without knowing what came before. Matrices are combined associatively, `fan` at a time, level by
level, until a text has one; on the way back each level learns the states at the boundaries of its children. Then every
chunk is traced back on its own. Chunks are rows that are dealt out evenly, so one giant text is spread over tasks.

Pieces never reach over the start of a word (a run of spaces after another character); the model file is checked for
that. Words are then independent, and each task remembers the words it saw last. A null or empty text has no pieces.
Code points without a piece become byte pieces. The model file is a parameter; it is a fixed file and is broadcast.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator
from itertools import compress, repeat
from operator import is_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read, stored
from tidemark.llm.registry import register

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Code points from which a text is split, and of each chunk.
CHUNK = 32_768
#: Matrices combined at once.
FAN = 64
REMEMBERED_WORDS = 500_000
REMEMBERED_PAIRS = 2_000_000
SPACE = "▁"
#: The state before the first piece; ids of code points without a piece are below it.
START = -1


class Model:
    """The pieces of a byte-pair SentencePiece model, their ranks, and which pieces may be neighbours."""

    def __init__(self, path: str = MODEL) -> None:
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        ids = range(sp.get_piece_size())
        special = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)
        self.pieces = [sp.id_to_piece(i) for i in ids]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special(i)}
        self.score = [sp.get_score(i) for i in ids]
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in ids if sp.is_byte(i)}
        self.unknown_id = sp.unk_id()
        self.longest = max(map(len, self.ids))
        self.trie: dict = {}
        for piece, i in self.ids.items():
            node = self.trie
            for c in piece:
                node = node.setdefault(c, {})
            node[None] = i
        self.size = [len(p) for p in self.pieces]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in self.ids):
            raise ValueError("a piece reaches over the start of a word")
        self.out = {i: bytes([b]) for b, i in self.byte_ids.items()}
        self.out |= {i: p.replace(SPACE, " ").encode() for p, i in self.ids.items()}
        self.out |= {i: b"" for i in ids if sp.is_control(i)}
        self.out[self.unknown_id] = " ⁇ ".encode()
        self.words_of = re.compile(self.word_pattern())
        self.forget()

    def word_pattern(self) -> str:
        """Spaces with what follows them up to the next space, cut between a run of letters and a run of marks.

        The marks are those that no piece holds beside a letter, so that no piece reaches over the cut.
        """
        if any(self.merged(p) != [p] for p in self.ids):
            return WORDS.pattern  # a piece that is not its own encoding must be seen beside its neighbours
        letter = re.compile(f"[{LETTERS}]")
        pairs = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        beside = {m for a, b in pairs for x, m in ((a, b), (b, a)) if letter.match(x)}
        marks = "".join(map(re.escape, sorted(set(string.punctuation + string.whitespace) - beside)))
        if not marks:
            return WORDS.pattern
        return (
            f"{SPACE}*[{LETTERS}]+(?=[{marks}{SPACE}]|\\Z)|{SPACE}*[{marks}]+(?=[{LETTERS}{SPACE}]|\\Z)|{SPACE}*[^{SPACE}]+|{SPACE}+"
        )

    def forget(self) -> None:
        self.fits: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.words_before: dict[str, bytes] = {}
        self.lossy: set[str] = set()

    def __getstate__(self) -> dict:
        return self.__dict__ | {"fits": {}, "words": {}, "words_before": {}, "lossy": set()}

    def merged(self, text: str) -> list[str]:
        """The model's own procedure: merge the best pair, the leftmost of equals, until none is a piece."""
        parts = list(text)
        while True:
            best, at = -np.inf, -1
            for k in range(len(parts) - 1):
                i = self.ids.get(parts[k] + parts[k + 1])
                if i is not None and (self.score[i] > best):
                    best, at = self.score[i], k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: int, b: int) -> bool:
        if a < 0 or b < 0:
            return True
        known = self.fits.get(a << 32 | b)
        if known is None:
            if len(self.fits) >= REMEMBERED_PAIRS:
                self.fits.clear()
            left, right = self.pieces[a], self.pieces[b]
            known = self.fits[a << 32 | b] = self.merged(left + right) == [left, right]
        return known

    def matches(self, text: str, at: int) -> list[int]:
        """The pieces that start at a place, from short to long; the code point itself if it is no piece."""
        out, node = [], self.trie
        for c in text[at : at + self.longest]:
            node = node.get(c)
            if node is None:
                break
            i = node.get(None)
            if i is not None:
                out.append(i)
        if text[at] not in self.ids:
            out.insert(0, -2 - ord(text[at]))
        return out

    def paths(self, text: str, begin: int, end: int, piece: int) -> dict[int, tuple[int, int]]:
        """place -> (start, piece) of the one piece that can end there, after `piece` ends at `begin`.

        Pieces start before `end` and may reach beyond it.
        """
        found = {begin: (-1, piece)}
        for at in range(begin, end):
            if at in found:
                last = found[at][1]
                for i in self.matches(text, at):
                    if self.compatible(last, i):
                        found[at + (self.size[i] if i >= 0 else 1)] = (at, i)
        return found

    def path(self, text: str) -> list[int]:
        """The pieces of a whole word: the same path as by `paths`, searched from long pieces to short ones."""
        at, last, end, options = 0, START, len(text), self.matches(text, 0)
        dead, trail, out = set(), [], []
        while at < end:
            while options:
                i = options.pop()
                to = at + (self.size[i] if i >= 0 else 1)
                if to not in dead and self.compatible(last, i):
                    trail.append((at, last, options))
                    out.append(i)
                    at, last = to, i
                    options = self.matches(text, at) if at < end else []
                    break
            else:
                dead.add(at)
                at, last, options = trail.pop()
                out.pop()
        return out

    @staticmethod
    def trace(found: dict[int, tuple[int, int]], begin: int, end: int) -> list[int]:
        out = []
        while end > begin:
            end, piece = found[end]
            out.append(piece)
        return out[::-1]

    def plain(self, pieces: list[int]) -> bytes:
        """Ids of pieces, 4 bytes each: a code point without a piece becomes its bytes, or unknown if the model has no bytes."""
        out: list[int] = []
        for i in pieces:
            if i >= 0:
                out.append(i)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in chr(-2 - i).encode("utf-8", "surrogatepass")]
            elif not out or out[-1] != self.unknown_id:
                out.append(self.unknown_id)
        return np.array(out, np.int32).tobytes()

    def word(self, text: str) -> bytes:
        """The ids of a whole word, or of a part of one that no piece reaches over, remembered."""
        ids = self.words.get(text)
        if ids is None:
            ids = self.words_before.get(text)
            if ids is None:
                ids = self.plain(self.path(text))
                back = b"".join(map(self.out.__getitem__, np.frombuffer(ids, np.int32).tolist()))
                if back != text.replace(SPACE, " ").encode("utf-8", "surrogatepass"):
                    self.lossy.add(text)
            if len(text) <= 64:
                if len(self.words) >= REMEMBERED_WORDS:
                    self.words_before, self.words = self.words, {}
                self.words[text] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a text that is short enough for one piece of work."""
        return np.frombuffer(self.encode_checked(text)[0], np.int32)

    def encode_checked(self, text: str) -> tuple[bytes, bool]:
        """(ids of such a text, 4 bytes each; do they give the text again?), which each of its words is asked once."""
        if not text:
            return b"", True
        words = self.words_of.findall(escaped(text))
        ids = list(map(self.words.get, words))
        if None in ids:
            for k in compress(range(len(ids)), map(is_, ids, repeat(None))):
                ids[k] = self.word(words[k])
        return b"".join(ids), SPACE not in text and (not self.lossy or self.lossy.isdisjoint(words))

    def decode(self, ids: list[int]) -> str:
        data = b"".join(map(self.out.__getitem__, ids)).decode("utf-8", "replace")
        return data[1:] if data.startswith(" ") else data


LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
WORDS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
WORD_START = re.compile(f"(?<=[^{SPACE}]){SPACE}")


def escaped(text: str) -> str:
    return SPACE + text.replace(" ", SPACE)


def states_before(model: Model, text: str, at: int) -> list[tuple[int, int]]:
    """All (piece, overhang) that can reach a boundary or stand across it."""
    if at == 0:
        return [(START, 0)]
    found = []
    for begin in range(max(0, at - model.longest), at):
        for end in range(at, min(begin + model.longest, len(text)) + 1):
            i = model.ids.get(text[begin:end])
            if i is not None:
                found.append((i, end - at))
    if text[at - 1] not in model.ids:
        found.append((-2 - ord(text[at - 1]), 0))
    return found


def matrix(model: Model, text: str, begin: int, end: int, last: bool) -> list[tuple[int, int, int, int, float]]:
    """(piece, overhang, piece, overhang, weight): the finite entries from states at `begin` to states at `end`.

    `text` has the chunk and as many code points around it as the longest piece has. Words inside the chunk always
    have a path, so only its two ends are searched.
    """
    words = [m.start() for m in WORD_START.finditer(text, begin, end + 1)]

    def leaving(found: dict) -> list[tuple[int, int]]:
        at_end = [(p, to - end) for to, (start, p) in found.items() if to >= end and start < end]
        return [x for x in at_end if not last or x[1] == 0]

    tail = []
    if words and words[-1] < end:
        tail = leaving(model.paths(text, words[-1], end, START))
    elif len(words) > 1:  # the chunk ends where a word starts
        tail = [(model.path(text[words[-2] : words[-1]])[-1], 0)]
    out = []
    for piece, over in states_before(model, text, begin):
        at = begin + over
        if not words or at > end:
            if at >= end:  # the piece stands across the whole chunk
                if not last or at == end:
                    out.append((piece, over, piece, at - end, 0.0))
            else:
                out += [(piece, over, p, o, 0.0) for p, o in leaving(model.paths(text, at, end, piece))]
        elif at <= words[0]:
            found = model.paths(text, at, words[0], piece)
            if words[0] in found:
                out += [(piece, over, p, o, 0.0) for p, o in tail or [(found[words[0]][1], 0)]]
    return out


def chunk_ids(model: Model, text: str, begin: int, end: int, entry: tuple[int, int], leave: tuple[int, int]) -> tuple[np.ndarray, int, int]:
    """(ids of the pieces that start inside the chunk, where the first starts, where the last ends)."""
    at, stop = begin + entry[1], end + leave[1]
    if at >= end:
        return np.empty(0, np.int32), at, at
    words = [m.start() for m in WORD_START.finditer(text, at, end)]
    if not words or words[0] > at:
        words = [at, *words]
    out = []
    for a, b in zip(words, [*words[1:], stop]):
        if a == at and a > 0 and not (text[a] == SPACE and text[a - 1] != SPACE):
            out.append(model.plain(model.trace(model.paths(text, a, min(b, end), entry[0]), a, b)))
        elif b == stop:
            out.append(model.plain(model.trace(model.paths(text, a, end, START), a, b)))
        else:
            out.append(model.word(text[a:b]))
    return np.frombuffer(b"".join(out), np.int32), at, stop


KEY = ["key_id", "key_hash"]
STATES = "array<struct<p:int,o:int,q:int,r:int,w:double>>"


def product(a: list, b: list) -> list[tuple]:
    """The max-plus product of two matrices given by their finite entries."""
    rows: dict[tuple, list] = {}
    for p, o, q, r, w in b:
        rows.setdefault((p, o), []).append((q, r, w))
    best: dict[tuple, float] = {}
    for p, o, q, r, w in a:
        for q2, r2, w2 in rows.get((q, r), ()):
            k = (p, o, q2, r2)
            best[k] = max(best.get(k, -np.inf), w + w2)
    return [(*k, w) for k, w in best.items()]


def boundary_states(matrices: list[list], entry: tuple[int, int], leave: tuple[int, int]) -> list[tuple[int, int]]:
    """The states at all boundaries of the best path from `entry` through the matrices to `leave`."""
    score, back = {entry: 0.0}, []
    for m in matrices:
        after, came = {}, {}
        for p, o, q, r, w in m:
            if (p, o) in score and score[p, o] + w > after.get((q, r), -np.inf):
                after[q, r], came[q, r] = score[p, o] + w, (p, o)
        back.append(came)
        score = after
    states = [leave]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def _entries(rows: list) -> list[tuple]:
    return [tuple(x[k] for k in "poqrw") if isinstance(x, dict) else tuple(x) for x in rows]


def _combine(fan: int):
    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("n")
        total = None
        for m in pdf["m"]:
            m = _entries(m)
            total = m if total is None else product(total, m)
        keys = [[pdf[c].iloc[0]] for c in KEY]
        rows = [dict(zip("poqrw", x)) for x in total]
        return pd.DataFrame({KEY[0]: keys[0], KEY[1]: keys[1], "n": [int(pdf["n"].iloc[0]) // fan], "m": [rows]})

    return combine


def _resolve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("n").reset_index(drop=True)
    one = pdf.iloc[0]
    states = boundary_states([_entries(m) for m in pdf["m"]], (one.ep, one.eo), (one.lp, one.lo))
    out = pdf[[*KEY, "n"]].copy()
    out["ep"], out["eo"] = [s[0] for s in states[:-1]], [s[1] for s in states[:-1]]
    out["lp"], out["lo"] = [s[0] for s in states[1:]], [s[1] for s in states[1:]]
    return out


def scan(matrices: DataFrame, fan: int = FAN) -> DataFrame:
    """(key, n, ep, eo, lp, lo): the states at the start and the end of every chunk on the best path of its text."""
    levels = [matrices]
    most = matrices.agg(F.max("n")).first()[0]
    schema = f"key_id bigint, key_hash bigint, n bigint, m {STATES}"
    while most:
        level = levels[-1].groupBy(*KEY, F.floor(F.col("n") / fan)).applyInPandas(_combine(fan), schema)
        levels.append(stored(level, "matrices"))
        most //= fan
    top = levels.pop()
    best = F.array_max(F.transform("m", lambda x: F.struct(x.w.alias("w"), x.q.alias("q"), x.r.alias("r"))))
    known = top.select(*KEY, "n", F.lit(START).alias("ep"), F.lit(0).alias("eo"), best.q.alias("lp"), best.r.alias("lo"))
    while levels:
        level = levels.pop().withColumn("up", F.floor(F.col("n") / fan).cast("long"))
        above = known.withColumnRenamed("n", "up")
        same = (level.key_id.eqNullSafe(above.key_id)) & (level.key_hash == above.key_hash) & (level.up == above.up)
        joined = level.join(above, same).select(level["*"], "ep", "eo", "lp", "lo")
        known = joined.groupBy(*KEY, "up").applyInPandas(
            _resolve, "key_id bigint, key_hash bigint, n bigint, ep int, eo int, lp int, lo int"
        )
    return known


def encode_giants(docs: DataFrame, model, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """(key_id, key_hash, token_ids, round_trip) of (key_id, key_hash, text); `model` is a broadcast Model."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        around = model.value.longest
        for batch in batches:
            for i, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                text = escaped(text)
                for n, begin in enumerate(range(0, len(text), chunk)):
                    end = min(begin + chunk, len(text))
                    low = max(0, begin - around - 1)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "key_id": pa.array([i], pa.int64()),
                            "key_hash": pa.array([h], pa.int64()),
                            "n": pa.array([n], pa.int64()),
                            "part": [text[low : end + around + 1]],
                            "b": pa.array([begin - low], pa.int32()),
                            "e": pa.array([end - low], pa.int32()),
                            "last": [end == len(text)],
                        }
                    )

    def matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(x, pa.float64() if x == "w" else pa.int32()) for x in "poqrw"]))
        for batch in batches:
            found = []
            for part, b, e, last in zip(*(batch.column(c).to_pylist() for c in ("part", "b", "e", "last"))):
                found.append([dict(zip("poqrw", x)) for x in matrix(model.value, part, b, e, last)])
            arrays = [batch.column(c) for c in (*KEY, "n")] + [pa.array(found, kind)]
            yield pa.RecordBatch.from_arrays(arrays, [*KEY, "n", "m"])

    def traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, same = [], []
            for row in batch.to_pylist():
                found, at, stop = chunk_ids(
                    model.value, row["part"], row["b"], row["e"], (row["ep"], row["eo"]), (row["lp"], row["lo"])
                )
                data = b"".join(map(model.value.out.__getitem__, found.tolist()))
                ids.append(found)
                same.append(data == row["part"][at:stop].replace(SPACE, " ").encode("utf-8", "surrogatepass"))
            arrays = [batch.column(c) for c in (*KEY, "n")] + [pa.array(ids, pa.list_(pa.int32())), pa.array(same)]
            yield pa.RecordBatch.from_arrays(arrays, [*KEY, "n", "ids", "same"])

    keys = "key_id bigint, key_hash bigint, n bigint"
    chunks = map_arrow(docs, cut, f"{keys}, part string, b int, e int, last boolean")
    chunks = stored(chunks.repartition(*KEY, "n"), "chunks")
    found = scan(stored(map_arrow(chunks, matrices, f"{keys}, m {STATES}"), "matrices"), fan)
    same = (chunks.key_id.eqNullSafe(found.key_id)) & (chunks.key_hash == found.key_hash) & (chunks.n == found.n)
    joined = chunks.join(found, same).select(chunks["*"], "ep", "eo", "lp", "lo").drop("last")
    parts = map_arrow(joined, traced, f"{keys}, ids array<int>, same boolean")
    whole = F.array_sort(F.collect_list(F.struct("n", "ids")))
    return parts.groupBy(*KEY).agg(
        F.flatten(F.transform(whole, lambda x: x.ids)).alias("token_ids"), F.bool_and("same").alias("round_trip")
    )


def encode(docs: DataFrame, path: str = MODEL, chunk: int = CHUNK, fan: int = FAN) -> DataFrame:
    """The rows of (doc_id, text) as (doc_id, n_tokens, token_ids, round_trip).

    round_trip: the decoded ids give the text again (not so where it has the mark that stands for a space).
    """
    model = docs.sparkSession.sparkContext.broadcast(Model(path))
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, same = zip(*map(model.value.encode_checked, batch.column(1).to_pylist())) if batch.num_rows else ((), ())
            ends = np.cumsum([0, *map(len, ids)]) // 4
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32)))
            arrays = [batch.column(0), lists, pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "token_ids", "round_trip"])

    giant = F.length("text") > chunk
    small = map_arrow(rows.where(~giant), whole, "doc_id bigint, token_ids array<int>, round_trip boolean")
    giants = rows.where(giant).select("doc_id", F.xxhash64("text").alias("h"), "text")
    each = giants.groupBy(F.col("doc_id").alias("key_id"), F.col("h").alias("key_hash")).agg(F.min("text").alias("text"))
    found = encode_giants(each, model, chunk, fan)
    same = giants.doc_id.eqNullSafe(found.key_id) & (giants.h == found.key_hash)
    large = giants.select("doc_id", "h").join(found, same).select("doc_id", "token_ids", "round_trip")
    both = small.unionByName(large)
    return both.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", "round_trip")


def decode(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """The rows of (doc_id, token_ids) as (doc_id, text); null ids give an empty text."""
    model = tokens.sparkSession.sparkContext.broadcast(Model(path))

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.value.decode(x or []) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.string())], ["doc_id", "text"])

    return map_arrow(tokens.select(F.col("doc_id").cast("long"), "token_ids"), texts, "doc_id bigint, text string")


@register("op3_sentencepiece")
def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(read(spark, sf_dir, "documents"))
