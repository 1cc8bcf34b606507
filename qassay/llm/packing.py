"""Order-preserving packing of token sequences by dynamic programming.

Documents of a task are taken in order as one stream of tokens. The stream is cut into windows of at most `size` tokens. A window is padded to
`size` tokens, unless its length is a power of two. Windows begin and end at the ends of documents and sentences; only stretches with neither
for more than size // 16 tokens may be cut inside. A cut costs as many tokens of padding as it is worth avoiding: none at the end of a document,
few at the end of a sentence, many inside a stretch. The least sum of padding and cut costs is found from left to right: the
best start of a padded window is the minimum of (cost + position) over a sliding range, kept in a monotone queue; windows whose length is a
power of two have at most log2(size) + 1 possible starts each, found by search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay.llm.shared import text_chunks
from qassay.llm.tokens import ByteTokenizer

_loaded: dict[int, ByteTokenizer] = {}


KINDS = ("document", "sentence", "inside")


def cut_points(doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending positions where a window may begin or end, the first 0 and the last the end of the stream, and their kinds (places in KINDS)."""
    marks = np.full(doc_ends[-1] + 1, len(KINDS), dtype=np.uint8)
    marks[sentence_ends] = 1
    marks[doc_ends] = 0
    marks[0] = 0
    ends = np.flatnonzero(marks < len(KINDS))
    longest, step = max(size // 16, 1), max(size // 32, 1)
    gaps = np.diff(ends)
    wide = np.flatnonzero(gaps > longest)
    inside = (gaps[wide] - 1) // step
    nth = np.arange(inside.sum()) - np.repeat(np.cumsum(inside) - inside, inside) + 1
    marks[np.repeat(ends[wide], inside) + nth * step] = 2
    positions = np.flatnonzero(marks < len(KINDS))
    return positions, marks[positions].astype(np.int64)


def best_cuts(positions: np.ndarray, cost: np.ndarray, size: int) -> np.ndarray:
    """Indices of the chosen cut points, first and last included."""
    n, first = len(positions), int(positions[0])
    at = np.full(int(positions[-1]) - first + 1, -1, dtype=np.int32)
    at[positions - first] = np.arange(n)
    exact: list[tuple[int, ...]] = [()] * n
    for b in range(size.bit_length()):
        start = np.searchsorted(positions, first + (1 << b))
        before = at[positions[start:] - first - (1 << b)]
        hits = np.flatnonzero(before >= 0)
        for j, i in zip((hits + start).tolist(), before[hits].tolist(), strict=True):
            exact[j] += (i,)
    place, charge = positions.tolist(), cost.tolist()
    oldest = np.searchsorted(positions, positions - size).tolist()
    total, back = [0], [0]
    # The queue: starts and their keys from head on.
    starts, keys, head = [0], [place[0]], 0
    for j, here, extra, oldest_start, exact_starts in zip(range(1, n), place[1:], charge[1:], oldest[1:], exact[1:], strict=True):
        while starts[head] < oldest_start:
            head += 1
        start = starts[head]
        least = keys[head] + size - here
        for i in exact_starts:
            if total[i] < least:
                least, start = total[i], i
        least += extra
        total.append(least)
        back.append(start)
        key = least + here
        while len(keys) > head and keys[-1] >= key:
            keys.pop()
            starts.pop()
        starts.append(j)
        keys.append(key)
    chosen = [len(place) - 1]
    while chosen[-1]:
        chosen.append(back[chosen[-1]])
    return np.array(chosen[::-1], dtype=np.int64)


def pack(docs: DataFrame, definition: str, pattern: str, doc_id: str = "doc_id", text: str = "text", size: int = 2048, end_id: int = 1, costs: tuple[int, int, int] = (0, 8, 64), chunk_tokens: int = 1 << 19) -> DataFrame:
    """One row per piece of a document in a sequence: doc_id, start (its document's ids before it), length, ids (little-endian unsigned 32-bit
    integers), doc_tokens, sequence_id (partition * 2**40 + running number), offset (in the sequence, gapless from 0), ends_at (document, sentence or inside).
    costs are the tokens of padding that a cut of each kind is worth avoiding.

    definition is the JSON text of the tokenizer and pattern its splitting rule (of a fixed size, so they go with the task). Null and empty texts have only the end id; bytes that
    are not UTF-8 count as U+FFFD. Every row is packed, repeated ones too; null ids stay null; other columns are not looked at; no rows give no pieces. The stream is solved in chunks of
    whole documents of about chunk_tokens tokens; a longer document is one chunk.
    """
    shared = docs.sparkSession.sparkContext.broadcast((definition, pattern))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(shared.value)
        if key not in _loaded:
            _loaded[key] = ByteTokenizer(*shared.value)
        tokenizer = _loaded[key]
        sequence = TaskContext.get().partitionId() << 40
        names, held, n_held = [], [], 0
        for batch in batches:
            for at, chunk in text_chunks(batch.column(1)):
                names += batch.column(0).slice(at, len(chunk)).to_pylist()
                held += [np.append(tokenizer.encode(raw.decode(errors="replace")), np.uint32(end_id)) for raw in chunk]
                n_held += sum(map(len, held[-len(chunk) :]))
                if n_held >= chunk_tokens:
                    pieces, sequence = _pieces(names, held, tokenizer, size, costs, sequence, kind)
                    yield pieces
                    names, held, n_held = [], [], 0
        if held:
            yield _pieces(names, held, tokenizer, size, costs, sequence, kind)[0]

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = pa.int64() if own.schema["doc_id"].dataType.simpleString() == "bigint" else pa.string()
    if kind == pa.string():
        own = own.withColumn("doc_id", F.col("doc_id").cast("string"))
    name = "long" if kind == pa.int64() else "string"
    return own.mapInArrow(solve, f"doc_id {name}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, ends_at string")


def _pieces(names, held, tokenizer, size, costs, sequence, kind) -> tuple[pa.RecordBatch, int]:
    ids = np.concatenate(held)
    ends = np.cumsum([len(x) for x in held])
    sentence_ends = np.flatnonzero(tokenizer.ends_sentence[ids]) + 1
    positions, kinds = cut_points(ends, sentence_ends, size)
    cuts = positions[best_cuts(positions, np.array(costs)[kinds], size)]
    edges = np.unique(np.concatenate([cuts, ends]))
    first, last = edges[:-1], edges[1:]
    kind_of_end = kinds[np.searchsorted(positions, last)]
    doc = np.searchsorted(ends, first, side="right")
    window = np.searchsorted(cuts, first, side="right") - 1
    raw, begins = ids.astype("<u4"), np.append(0, ends)
    columns = {
        "doc_id": pa.array([names[d] for d in doc], kind),
        "start": pa.array(first - begins[doc]),
        "length": pa.array(last - first),
        "ids": pa.array([raw[a:b].tobytes() for a, b in zip(first, last, strict=True)], pa.binary()),
        "doc_tokens": pa.array(np.diff(begins)[doc]),
        "sequence_id": pa.array(sequence + window),
        "offset": pa.array(first - cuts[window]),
        "ends_at": pa.array([KINDS[k] for k in kind_of_end]),
    }
    return pa.RecordBatch.from_pydict(columns), sequence + len(cuts) - 1
