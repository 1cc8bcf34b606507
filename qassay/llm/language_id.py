"""Language identification by a byte convolutional network.

Texts are cut into windows of a fixed number of bytes, the last one padded with zeros. Filters of two, three and four bytes slide over each window;
the maximum of each filter over the window (from zero up) feeds a softmax layer. Its mean log-probabilities over all windows of the text, weighted
by their bytes, give the language. The network is trained in numpy on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qassay.llm.shared import text_chunks
from qassay.llm.training import Adam, collect_texts, draw

WIDTHS = (2, 3, 4)


class ByteNet:
    def __init__(self, languages: list[str], window: int = 256, filters: int = 16, seed: int = 5):
        self.languages, self.window, self.filters = languages, window, filters
        rng = np.random.default_rng(seed)
        self.weights = {f"conv{w}": rng.normal(0, 0.3, (w, 256, filters)).astype(np.float32) for w in WIDTHS}
        self.weights |= {f"bias{w}": np.zeros(filters, dtype=np.float32) for w in WIDTHS}
        self.weights["out"] = rng.normal(0, 0.1, (len(WIDTHS) * filters, len(languages))).astype(np.float32)
        self.weights["out_bias"] = np.zeros(len(languages), dtype=np.float32)

    def _convolve(self, x: np.ndarray, width: int) -> np.ndarray:
        """Filter values (windows, places, filters) of byte rows x; one table lookup for each of the filter's bytes."""
        places, table = x.shape[1] - width + 1, self.weights[f"conv{width}"]
        total = np.take(table[0], x[:, :places], axis=0)
        for j in range(1, width):
            total += np.take(table[j], x[:, j : j + places], axis=0)
        return total

    def train(self, texts: list[bytes], labels: np.ndarray, steps: int = 350, batch: int = 64) -> None:
        rng, adam = np.random.default_rng(11), Adam(self.weights, 0.02)
        by_label = [np.flatnonzero(labels == c) for c in range(len(self.languages))]
        by_label = [b for b in by_label if len(b)]
        for step in range(steps):
            x = np.zeros((batch, self.window), dtype=np.uint8)
            y = np.zeros(batch, dtype=np.int64)
            for i in range(batch):
                own = by_label[rng.integers(len(by_label))]
                pick = own[rng.integers(len(own))]
                raw = texts[pick]
                length = int(rng.integers(min(16, len(raw)), min(self.window, len(raw)) + 1))
                start = int(rng.integers(len(raw) - length + 1))
                x[i, :length] = np.frombuffer(raw, dtype=np.uint8)[start : start + length]
                y[i] = labels[pick]
            peaks, at = [], []
            for w in WIDTHS:
                values = self._convolve(x, w)
                place = values.argmax(axis=1)
                at.append(place)
                peaks.append(np.take_along_axis(values, place[:, None], axis=1)[:, 0] + self.weights[f"bias{w}"])
            hidden = np.maximum(np.concatenate(peaks, axis=1), 0)
            logits = hidden @ self.weights["out"] + self.weights["out_bias"]
            p = np.exp(logits - logits.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(batch), y] -= 1
            p /= batch
            grads = {"out": hidden.T @ p, "out_bias": p.sum(axis=0)}
            back = (p @ self.weights["out"].T) * (hidden > 0)
            for k, w in enumerate(WIDTHS):
                own = back[:, k * self.filters : (k + 1) * self.filters]
                grads[f"bias{w}"] = own.sum(axis=0)
                grad = np.zeros_like(self.weights[f"conv{w}"])
                for j in range(w):
                    np.add.at(grad[j], (np.take_along_axis(x, at[k] + j, axis=1), np.arange(self.filters)[None, :]), own)
                grads[f"conv{w}"] = grad
            adam.step(grads, 1.0 if step < steps * 2 // 3 else 0.2)

    def prepare(self) -> None:
        """Tables of byte pairs, so that applying a filter takes half the lookups."""
        first = {w: self.weights[f"conv{w}"] for w in WIDTHS}
        self.pairs = {(w, j): (first[w][j][:, None, :] + first[w][j + 1][None, :, :]).reshape(65536, -1) for w in WIDTHS for j in range(0, w - 1, 2)}

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """Log-probabilities of every row of windows."""
        out = np.empty((len(x), len(self.languages)), dtype=np.float32)
        for at in range(0, len(x), 128):
            part = x[at : at + 128]
            pair = part[:, :-1].astype(np.int32) * 256 + part[:, 1:]
            peaks = []
            for w in WIDTHS:
                places = self.window - w + 1
                total = np.take(self.pairs[w, 0], pair[:, :places], axis=0)
                if w == 4:
                    total += np.take(self.pairs[w, 2], pair[:, 2 : 2 + places], axis=0)
                elif w == 3:
                    total += np.take(self.weights["conv3"][2], part[:, 2 : 2 + places], axis=0)
                while total.shape[1] > 1:
                    half = total.shape[1] // 2
                    low = np.maximum(total[:, :half], total[:, half : 2 * half])
                    if total.shape[1] % 2:
                        np.maximum(low[:, 0], total[:, -1], out=low[:, 0])
                    total = low
                peaks.append(total[:, 0] + self.weights[f"bias{w}"])
            logits = np.maximum(np.concatenate(peaks, axis=1), 0) @ self.weights["out"] + self.weights["out_bias"]
            logits -= logits.max(axis=1, keepdims=True)
            out[at : at + 128] = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        return out

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Language number (-1 without a letter) and its probability for each text, over all its windows."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        counts = -(-sizes // self.window)
        ends = np.cumsum(counts)
        total = np.zeros((len(texts), len(self.languages)))
        block = 4096
        padded = np.frombuffer(b"".join(t.ljust(n * self.window, b"\0") for t, n in zip(texts, counts.tolist(), strict=True)), dtype=np.uint8)
        windows = padded.reshape(-1, self.window)
        for at in range(0, len(windows), block):
            rows = np.arange(at, min(at + block, len(windows)))
            doc = np.searchsorted(ends, rows, side="right")
            weight = np.minimum(self.window, sizes[doc] - (rows - (ends - counts)[doc]) * self.window)
            np.add.at(total, doc, self.log_probabilities(windows[rows]) * weight[:, None])
        total /= np.maximum(sizes, 1)[:, None]
        p = np.exp(total - total.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        lettered = np.array([any(map(str.isalpha, t.decode(errors="ignore"))) for t in texts], dtype=bool)
        return np.where(lettered, best, -1), np.where(lettered, p[np.arange(len(texts)), best], 0.0)


def fit(rows: DataFrame, lang: str = "lang", text: str = "text", per_language: int = 600, chars: int = 1500) -> ByteNet:
    """A network trained on at most per_language labelled texts of each language, chars code points of each. Null labels and texts are left out; a text
    that repeats is one text, so copies neither crowd out others nor pass the bound."""
    rows = rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(text)).alias("_text")).filter("lang is not null and length(text) > 0")
    drawn, counts = draw(rows.select("lang", "_text").distinct(), "lang", per_language, "_text")
    # About 1.3 * per_language rows of each language are broadcast; only the texts they name are shuffled, one copy a task.
    texts = rows.join(F.broadcast(drawn), ["lang", "_text"]).dropDuplicates(["lang", "_text"])
    sample = collect_texts(texts, "lang", per_language, chars)
    net = ByteNet(sorted(counts))
    if counts:
        net.train([t.encode() for t in sample["text"]], np.searchsorted(net.languages, sample["lang"].to_numpy(dtype=object)))
        net.prepare()
    return net


def identify(docs: DataFrame, net: ByteNet, doc_id: str = "doc_id", text: str = "text", unknown: str = "und") -> DataFrame:
    """One row per row of docs: doc_id, lang_pred (a learned language, or unknown), score (its probability; 0 if unknown).

    Null and empty texts, texts without a letter, and all texts if nothing was learned, are unknown. Equal texts get equal results; other
    columns are not looked at; an empty table gives an empty result. Every window of a text counts.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at, chunk in text_chunks(batch.column(1)):
                best, score = model.predict(chunk) if model.languages else (np.full(len(chunk), -1), np.zeros(len(chunk)))
                names = [model.languages[b] if b >= 0 else unknown for b in best]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(chunk)), pa.array(names, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return own.mapInArrow(apply, f"doc_id {own.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
