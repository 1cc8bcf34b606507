"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A text is a sequence of blank-separated words in lower case. A word enters the network twice: as a hashed word and as the mean of its hashed
character n-grams (with marks for its ends), so unseen forms of known stems count. Windows of `window` words, each overlapping the next by half,
run through gated recurrent units in both directions; attention weights pool the states into one logit. The probabilities of all windows of a
text (their mean, maximum and share above one half) give its score by a logistic layer that is fitted to the true share of the labels.
Everything is trained in numpy, on a bounded sample of labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from qassay.llm.shared import text_chunks
from qassay.llm.training import Adam, collect_texts, draw, scatter_add, sigmoid
from qassay.llm.words import mix

_NOT_LETTERS = re.compile(r"[\W_]+")
GRAMS = (2, 3, 4, 5)
#: A text counts as toxic from this score on. Scores follow the true share of the labels (about one in nine), so weak cases lie well below one half.
TOXIC_FROM = 0.3


class GatedNet:
    def __init__(self, window: int = 64, hidden: int = 8, width: int = 8, buckets: int = 1 << 14, seed: int = 3):
        self.window, self.stride, self.hidden, self.buckets = window, window // 2, hidden, buckets
        rng = np.random.default_rng(seed)
        draw = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
        self.weights = {
            "words": draw(0.05, buckets, width), "grams": draw(0.05, buckets, width), "inputs": draw(0.35, 2 * width, 6 * hidden),
            "input_bias": np.zeros(6 * hidden, dtype=np.float32), "states": draw(0.3, 2, hidden, 3 * hidden),
            "attention": draw(0.3, 2 * hidden), "out": draw(0.3, 2 * hidden), "out_bias": np.zeros(1, dtype=np.float32),
        }
        self.used_words, self.used_grams = np.ones((2, buckets, 1), dtype=np.float32)
        self.calibration = np.zeros(6)
        self.known: dict[str, int] = {}

    def features(self, tokens: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word bucket of every token, the buckets of all its character n-grams in a row, and how many each token has (at least one)."""
        bare = ["<" + _NOT_LETTERS.sub("", t) + ">" for t in tokens]
        sizes = np.array([len(b) for b in bare])
        codes = np.frombuffer("".join(bare).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(bare)), sizes)
        starts = np.cumsum(sizes) - sizes
        powers = mix(np.arange(1, max(GRAMS) + 1, dtype=np.uint64)) | np.uint64(1)
        slots, owners = [], []
        for n in GRAMS:
            if len(codes) < n:
                continue
            value = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for j in range(n):
                value += codes[j : len(codes) - n + 1 + j] * powers[j]
            inside = owner[: len(value)] == owner[n - 1 :]
            slots.append((mix(value[inside]) % np.uint64(self.buckets)).astype(np.int64))
            owners.append(owner[: len(value)][inside])
        order = np.argsort(np.concatenate(owners), kind="stable")
        place = np.arange(len(codes), dtype=np.uint64) - starts.astype(np.uint64)[owner]
        words = np.add.reduceat(mix(codes + (place << np.uint64(32))), starts)
        slots, counts = np.concatenate(slots)[order], np.bincount(np.concatenate(owners), minlength=len(bare))
        return (mix(words) % np.uint64(self.buckets)).astype(np.int64), slots, counts

    def embed(self, words: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> np.ndarray:
        sums = np.add.reduceat(self.weights["grams"][slots] * self.used_grams[slots], np.cumsum(counts) - counts, axis=0)
        return np.concatenate([self.weights["words"][words] * self.used_words[words], sums / counts[:, None].astype(np.float32)], axis=1)

    def _step(self, state: np.ndarray, x: np.ndarray) -> tuple:
        h = self.hidden
        g = state @ self.weights["states"]
        gates = 1 / (1 + np.exp(-(x[..., : 2 * h] + g[..., : 2 * h])))
        fresh = np.tanh(x[..., 2 * h :] + gates[..., h:] * g[..., 2 * h :])
        return fresh + gates[..., :h] * (state - fresh), gates, fresh, g[..., 2 * h :]

    def forward(self, table: np.ndarray, rows: np.ndarray, keep: list | None = None) -> tuple:
        """Logits of windows (batch, window) of rows of table (its inputs per direction); row 0 is padding. keep collects what training needs."""
        h, length = self.hidden, rows.shape[1]
        state = np.zeros((2, len(rows), h), dtype=np.float32)
        states = np.empty((length, len(rows), 2 * h), dtype=np.float32)
        for t in range(length):
            x = np.stack([table[0].take(rows[:, t], axis=0), table[1].take(rows[:, length - 1 - t], axis=0)])
            before = state
            state, gates, fresh, inner = self._step(state, x)
            states[t, :, :h], states[length - 1 - t, :, h:] = state[0], state[1]
            if keep is not None:
                keep.append((before, gates, fresh, inner))
        share = states @ self.weights["attention"]
        share[1:][rows.T[1:] == 0] = -1e9
        share = np.exp(share - share.max(axis=0))
        share /= share.sum(axis=0)
        pooled = np.einsum("tb,tbh->bh", share, states)
        return pooled @ self.weights["out"] + self.weights["out_bias"], states, share, pooled

    def _split(self, projected: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(projected.reshape(len(projected), 2, 3 * self.hidden).transpose(1, 0, 2))

    def learn(self, adam: Adam, feats: tuple, rows: np.ndarray, y: np.ndarray, scale: float) -> None:
        """One step on windows (rows into the tokens of feats) with labels y."""
        h, w, length = self.hidden, self.weights, rows.shape[1]
        words, slots, counts = feats
        embedded = self.embed(words, slots, counts)
        keep: list = []
        logit, states, share, pooled = self.forward(self._split(embedded @ w["inputs"] + w["input_bias"]), rows, keep)
        d_logit = ((sigmoid(logit) - y) / len(y)).astype(np.float32)
        grads = {"out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True)}
        d_pooled = d_logit[:, None] * w["out"]
        d_share = np.einsum("tbh,bh->tb", states, d_pooled)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        d_states = share[..., None] * d_pooled + d_score[..., None] * w["attention"]
        grads["attention"] = np.einsum("tbh,tb->h", states, d_score)
        d_u, d_next = np.zeros_like(w["states"]), np.zeros((2, len(rows), h), dtype=np.float32)
        d_inputs = np.empty((2, length, len(rows), 3 * h), dtype=np.float32)
        for t in range(length - 1, -1, -1):
            before, gates, fresh, inner = keep[t]
            update, reset = gates[..., :h], gates[..., h:]
            d = d_next + np.stack([d_states[t, :, :h], d_states[length - 1 - t, :, h:]])
            d_fresh = d * (1 - update) * (1 - fresh * fresh)
            d_update = d * (before - fresh) * update * (1 - update)
            d_reset = d_fresh * inner * reset * (1 - reset)
            d_g = np.concatenate([d_update, d_reset, d_fresh * reset], axis=2)
            d_x = np.concatenate([d_update, d_reset, d_fresh], axis=2)
            d_u += before.transpose(0, 2, 1) @ d_g
            d_next = d * update + d_g @ w["states"].transpose(0, 2, 1)
            d_inputs[0, t], d_inputs[1, length - 1 - t] = d_x[0], d_x[1]
        at = rows.T.reshape(-1)
        flat = np.concatenate([scatter_add(len(words), at, d.reshape(len(at), 3 * h)) for d in d_inputs], axis=1)
        grads |= {"states": d_u, "inputs": embedded.T @ flat, "input_bias": flat.sum(axis=0)}
        d_embedded = flat @ w["inputs"].T
        width = w["words"].shape[1]
        grads["words"] = scatter_add(self.buckets, words, d_embedded[:, :width] * self.used_words[words])
        grads["grams"] = scatter_add(self.buckets, slots, self.used_grams[slots] * np.repeat(d_embedded[:, width:] / counts[:, None].astype(np.float32), counts, axis=0))
        adam.step(grads, scale)

    def train(self, texts: list[str], labels: np.ndarray, weight: np.ndarray, steps: int = 400, batch: int = 64, dropout: float = 0.15, least: float = 0.015) -> None:
        """Learn windows with the label of their text, drawn evenly from both labels; then fit the score of whole texts, weighted.

        Words and n-grams in fewer than the share `least` of the texts, or in fewer than four, stay out of the network."""
        rng, adam = np.random.default_rng(13), Adam(self.weights, 0.01)
        known: dict[str, int] = {"": 0}
        tokens = [np.array([known.setdefault(w, len(known)) for w in t.lower().split()], dtype=np.int64) for t in texts]
        words, slots, counts = self.features(list(known))
        in_texts = np.bincount(np.concatenate([np.unique(t) for t in tokens] or [np.zeros(0, dtype=np.int64)]), minlength=len(known))
        bound = max(4.0, least * len(texts))
        self.used_words = (np.bincount(words, weights=in_texts, minlength=self.buckets) >= bound).astype(np.float32)[:, None]
        self.used_grams = (np.bincount(slots, weights=np.repeat(in_texts, counts), minlength=self.buckets) >= bound).astype(np.float32)[:, None]
        first = np.cumsum(counts) - counts
        by_label = [np.flatnonzero(labels == c) for c in (0, 1)]
        for step in range(steps if all(map(len, by_label)) else 0):
            rows, y = np.zeros((batch, self.window), dtype=np.int64), np.arange(batch) % 2
            for i in range(batch):
                own = tokens[by_label[y[i]][rng.integers(len(by_label[y[i]]))]]
                start = int(rng.integers(max(1, len(own) - self.window + 1)))
                part = own[start : start + self.window]
                rows[i, : len(part)] = part
            rows[rng.random(rows.shape) < dropout] = 0
            own = np.unique(np.append(rows, 0))
            n = counts[own]
            chosen = np.repeat(first[own] - np.cumsum(n) + n, n) + np.arange(n.sum())
            self.learn(adam, (words[own], slots[chosen], n), np.searchsorted(own, rows), y.astype(np.float32), 1.0 if step < steps * 2 // 3 else 0.25)
        self.fit_scores(self.summaries([t.encode() for t in texts]), labels, weight)

    def fit_scores(self, x: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """Weighted, slightly damped logistic regression by Newton steps."""
        x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
        beta = np.zeros(x.shape[1])
        for _ in range(30 if len(x) else 0):
            p = sigmoid(x @ beta)
            grad = x.T @ (weight * (p - labels)) + 1e-2 * beta
            hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
            beta -= np.clip(np.linalg.solve(hess, grad), -2, 2)
        self.calibration = beta

    def _rows_of(self, tokens: list[str], capacity: int = 200_000) -> np.ndarray:
        """Rows of the tokens in the table of projected inputs, which is kept between calls and started anew when full."""
        if not self.known or len(self.known) > capacity:
            self.known = {"": 0}
            self.table = np.zeros((2, 1 << 12, 3 * self.hidden), dtype=np.float32)
            self._project([""], 0)
        fresh = list(dict.fromkeys(t for t in tokens if t not in self.known))
        for at in range(0, len(fresh), 1 << 14):
            part, n = fresh[at : at + (1 << 14)], len(self.known)
            self._project(part, n)
            self.known.update(zip(part, range(n, n + len(part)), strict=True))
        return np.fromiter(map(self.known.__getitem__, tokens), dtype=np.int64, count=len(tokens))

    def _project(self, tokens: list[str], at: int) -> None:
        while self.table.shape[1] < at + len(tokens):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)], axis=1)
        projected = self.embed(*self.features(tokens)) @ self.weights["inputs"] + self.weights["input_bias"]
        self.table[:, at : at + len(tokens)] = self._split(projected)

    def summaries(self, texts: list[bytes]) -> np.ndarray:
        """Per text, over the probabilities of all its windows: mean, maximum, share above one half, logit of the mean, log of their number."""
        if not texts:
            return np.zeros((0, 5))
        tokens = [t.decode(errors="replace").lower().split() for t in texts]
        sizes = np.array([len(t) for t in tokens], dtype=np.int64)
        counts = 1 + np.maximum(0, -(-(sizes - self.window) // self.stride))
        room = (counts - 1) * self.stride + self.window
        flat = np.zeros(room.sum(), dtype=np.int64)
        begins = np.cumsum(room) - room
        rows = self._rows_of([t for own in tokens for t in own])
        flat[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = rows
        starts = np.repeat(begins - (np.cumsum(counts) - counts) * self.stride, counts) + np.arange(counts.sum()) * self.stride
        p = np.empty(len(starts))
        for at in range(0, len(starts), 1024):
            windows = flat[starts[at : at + 1024, None] + np.arange(self.window)]
            p[at : at + 1024] = sigmoid(self.forward(self.table, windows)[0].astype(np.float64))
        firsts = np.cumsum(counts) - counts
        mean = np.add.reduceat(p, firsts) / counts
        logit = np.log(np.clip(mean, 1e-6, 1 - 1e-6) / (1 - np.clip(mean, 1e-6, 1 - 1e-6)))
        return np.stack([mean, np.maximum.reduceat(p, firsts), np.add.reduceat(p > 0.5, firsts, dtype=np.float64) / counts, logit, np.log(counts)], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.summaries(texts) @ self.calibration[:-1] + self.calibration[-1])

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "table": None}


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", per_class: int = 1500, chars: int = 4000) -> GatedNet:
    """A network trained on at most per_class labelled rows of each label (0 and 1), chars code points of each. Null labels and texts are left out;
    of rows that share an id one is taken."""
    known = labels.select(F.col(doc_id).alias("_id"), F.col(label).alias("toxic")).filter(F.col("toxic").isin(0, 1)).distinct()
    drawn, counts = draw(known, "toxic", per_class, "_id")
    own = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text")).filter("length(text) > 0")
    texts = own.join(F.broadcast(drawn), "_id").dropDuplicates(["_id", "toxic"])  # drawn is bounded by per_class, so no text is shuffled before
    sample = collect_texts(texts, "toxic", per_class, chars)
    net = GatedNet()
    y = sample["toxic"].to_numpy(dtype=np.int64) if len(sample) else np.zeros(0, dtype=np.int64)
    weight = np.array([counts[c] / max(1, (y == c).sum()) for c in y.tolist()])
    net.train(list(sample["text"]), y, weight / max(1e-9, weight.mean() if len(y) else 1))
    return net


def score_rows(docs: DataFrame, net: GatedNet, name: str, text: str = "text") -> DataFrame:
    """docs with the score of each text as a further column of that name, which must be new; rows stay in their partitions.

    A null or empty text is one window of padding and gets the score of that; without labelled rows of both kinds the score comes from the share of
    labels alone. Equal texts get equal scores, and an empty table gives an empty result.
    """
    if name in docs.columns:
        raise ValueError(f"column {name} exists")
    shared = docs.sparkSession.sparkContext.broadcast(net)
    at_text = docs.columns.index(text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in text_chunks(batch.column(at_text)):
                yield batch.slice(at, len(chunk)).append_column(name, pa.array(shared.value.score(chunk), pa.float64()))

    return docs.mapInArrow(apply, StructType([*docs.schema.fields, StructField(name, DoubleType())]))


def score_toxicity(docs: DataFrame, net: GatedNet, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1) of each row of docs, see score_rows; other columns are not looked at."""
    return score_rows(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), net, "score").select("doc_id", "score")
