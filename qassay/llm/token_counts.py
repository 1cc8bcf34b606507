"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie over bytes; a word enters with one blank in front, which only first pieces begin with. Every node that is left because no
child fits has a failure link: where matching goes on after the longest pieces of what was read are taken off, and how many pieces that are. Both
are computed once, so a word costs a step per byte (and amortised failure steps), whatever its length, and no piece is ever built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay.llm.shared import text_chunks
from qassay.llm.tokens import byte_of

_built: dict[int, PieceAutomaton] = {}


class PieceAutomaton:
    """pieces: byte strings; those of a word's start begin with a blank. Every single byte is a piece as well, so each word has a count."""

    def __init__(self, pieces: list[bytes], capacity: int = 500_000):
        children: dict[int, int] = {}
        ends, order = [False], []
        for piece in [*(bytes([b]) for b in range(256)), *pieces]:
            node = 0
            for b in piece:
                key = node << 8 | b
                if key not in children:
                    children[key] = len(ends)
                    ends.append(False)
                node = children[key]
            ends[node] = True
        fail, popped = [0] * len(ends), [0] * len(ends)
        order = sorted(children.items(), key=lambda x: x[1])
        depth = [0] * len(ends)
        for key, node in order:
            depth[node] = depth[key >> 8] + 1
        for key, node in sorted(order, key=lambda x: depth[x[1]]):
            if ends[node]:
                popped[node] = 1
                continue
            parent, b = key >> 8, key & 255
            at, count = fail[parent], popped[parent]
            while at << 8 | b not in children:
                count += popped[at]
                at = fail[at]
            fail[node], popped[node] = children[at << 8 | b], count
        self.children, self.fail, self.popped = children, fail, popped
        self.known: dict[bytes, int] = {}
        self.capacity = capacity

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest-match split of one word."""
        children, fail, popped = self.children, self.fail, self.popped
        node, total = children[32], 0
        for b in word:
            step = children.get(node << 8 | b)
            while step is None:
                total += popped[node]
                node = fail[node]
                step = children.get(node << 8 | b)
            node = step
        while node:
            total += popped[node]
            node = fail[node]
        return total

    def count_all(self, words: list[bytes]) -> int:
        """Sum over the words; counts of short ones are remembered up to a bound."""
        counts = list(map(self.known.get, words))
        if None in counts:
            for i, n in enumerate(counts):
                if n is None:
                    word = words[i]
                    n = counts[i] = self.known.get(word) or self.count(word)
                    if len(word) <= 64:
                        self.known[word] = n
            if len(self.known) > self.capacity:
                self.known.clear()
        return sum(counts)


def vocabulary_pieces(definition: str) -> list[bytes]:
    """Pieces of a byte-level vocabulary given as JSON text, without special tokens."""
    model = json.loads(definition)
    special, table = {t["content"] for t in model.get("added_tokens", [])}, byte_of()
    return [bytes(table[c] for c in token) for token in model["model"]["vocab"] if token not in special]


def count_tokens(docs: DataFrame, definition: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words (runs of [^\\x20\\x09-\\x0D]) and n_tokens (pieces of all words).

    Null and empty texts have none of either. Rows are counted alone: repeated rows and null ids change nothing, other columns are not looked at, and
    an empty table gives an empty result. definition is a tokenizer's JSON text, of a fixed size, so it goes with the task.
    """
    shared = docs.sparkSession.sparkContext.broadcast(definition)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _built:
            _built[key] = PieceAutomaton(vocabulary_pieces(shared.value))
        automaton = _built[key]
        for batch in batches:
            for at, chunk in text_chunks(batch.column(1)):
                words = list(map(bytes.split, chunk, repeat(None)))
                columns = [batch.column(0).slice(at, len(chunk)), pa.array(map(len, words), pa.int64()), pa.array(map(automaton.count_all, words), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_tokens"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(count, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
