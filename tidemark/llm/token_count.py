"""Word-piece counts by a longest-match automaton that never builds the pieces.

A text is cut into words: runs of ASCII letters, digits and non-ASCII characters, and single ASCII punctuation marks;
white space and control characters separate. A word becomes the greedy longest-match-first pieces of the vocabulary
(continuations are separate entries), or one unknown piece if some part of it has none. The automaton is a trie with
failure links; each node knows how many pieces are popped when its link is taken, so a word costs time linear in its
length. A null text counts as empty: 0 words, 0 pieces.

The vocabulary comes from a public SentencePiece file (a parameter): pieces marked as word starts are initial pieces,
all others continuations. It is a fixed file of tens of thousands of entries and is broadcast as such.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import map_arrow, read
from tidemark.llm.registry import register

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+|[!-/:-@\[-`{-~]")
#: Entries a vocabulary may have to be broadcast.
MOST_ENTRIES = 2_000_000
#: Words whose counts a task remembers before it starts anew.
REMEMBERED = 300_000
UNKNOWN = 1 << 40


def load_vocabulary(path: str = VOCABULARY) -> tuple[list[str], list[str]]:
    """(initial pieces, continuation pieces) of a SentencePiece file."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    ids = range(model.get_piece_size())
    pieces = [model.id_to_piece(i) for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
    initial = [p[1:] for p in pieces if p[0] == "▁" and len(p) > 1]
    return initial, [p for p in pieces if "▁" not in p]


class Automaton:
    """Two tries, of initial and of continuation pieces, joined by failure links."""

    ROOT, MORE = 0, 1

    def __init__(self, initial: list[str], continuation: list[str]) -> None:
        if len(initial) + len(continuation) > MOST_ENTRIES:
            raise ValueError("the vocabulary is too large to be broadcast")
        self.next: dict[int, int] = {}
        children: list[list[tuple[str, int]]] = [[], []]
        final = [False, False]
        for root, pieces in ((self.ROOT, initial), (self.MORE, continuation)):
            for piece in pieces:
                node = root
                for c in piece:
                    to = self.next.get(node << 21 | ord(c))
                    if to is None:
                        to = self.next[node << 21 | ord(c)] = len(final)
                        children[node].append((c, to))
                        children.append([])
                        final.append(False)
                    node = to
                final[node] = final[node] or bool(piece)
        self.fail = [-1] * len(final)
        self.popped = [0] * len(final)
        queue = deque([self.ROOT, self.MORE])
        while queue:
            parent = queue.popleft()
            for c, node in children[parent]:
                queue.append(node)
                if final[node]:
                    self.fail[node], self.popped[node] = self.MORE, 1
                    continue
                z, popped = self.fail[parent], self.popped[parent]
                while z >= 0 and (z << 21 | ord(c)) not in self.next:
                    popped += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[node], self.popped[node] = self.next[z << 21 | ord(c)], popped

    def count(self, word: str) -> int:
        """Pieces of a word; 1 + UNKNOWN if it has none."""
        node, total = self.ROOT, 0
        for c in map(ord, word):
            while (to := self.next.get(node << 21 | c)) is None:
                total += self.popped[node]
                node = self.fail[node]
                if node < 0:
                    return 1 + UNKNOWN
            node = to
        while node != self.MORE:
            total += self.popped[node]
            node = self.fail[node]
            if node < 0:
                return 1 + UNKNOWN
        return total


class Remembered(dict):
    """Counts of the words seen last."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self.automaton.count(word)
        if len(word) <= 64:
            self[word] = n
        return n


def count_pieces(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """The documents with n_words, n_tokens and n_unknown in place of their text."""
    sent = docs.sparkSession.sparkContext.broadcast(Automaton(*load_vocabulary(vocabulary)))
    own = [c for c in docs.columns if c not in ("n_words", "n_tokens", "n_unknown", "text")]
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*own).schema)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Remembered(sent.value)
        for batch in batches:
            words, tokens, unknown = [], [], []
            for text in batch.column(batch.num_columns - 1).to_pylist():
                found = WORD.findall(text or "")
                total = sum(map(known.__getitem__, found))
                words.append(len(found))
                tokens.append(total & (UNKNOWN - 1))
                unknown.append(total >> 40)
            new = [pa.array(x, pa.int64()) for x in (words, tokens, unknown)]
            yield pa.RecordBatch.from_arrays(
                batch.columns[:-1] + new, batch.schema.names[:-1] + ["n_words", "n_tokens", "n_unknown"]
            )

    return map_arrow(docs.select(*own, "text"), counts, schema + "n_words bigint, n_tokens bigint, n_unknown bigint")


@register("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(F.col("doc_id"), "text")
    return count_pieces(docs)
