"""Small tools for models trained in numpy: bounded labelled samples and Adam."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


_SPAN = 1 << 30


def draw(rows: DataFrame, label: str, per_class: int, key: str) -> tuple[DataFrame, dict]:
    """About 1.3 * per_class rows of each label, drawn evenly by a hash of key over all rows, with that hash as _order; and all rows' counts by label."""
    counts = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    bound: Column = F.lit(0)
    for value, n in counts.items():
        bound = F.when(F.col(label) == F.lit(value), F.lit(int(min(1.0, 1.3 * per_class / n + 20 / n) * _SPAN))).otherwise(bound)
    drawn = rows.withColumn("_order", F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(_SPAN)))
    return drawn.filter(F.col("_order") < bound), counts


def collect_texts(drawn: DataFrame, label: str, per_class: int, chars: int) -> pd.DataFrame:
    """text and label of at most per_class drawn rows of each label: a stretch of at most chars code points from a hashed place in each text."""
    room = F.greatest(F.length("text") - chars, F.lit(0))
    start = (F.pmod(F.xxhash64("text", F.lit("place")), room + 1) + 1).cast("int")
    found = drawn.select(F.substring(F.col("text"), start, F.lit(chars)).alias("text"), label, "_order").toPandas()
    found = found.sort_values(["_order", "text"], kind="stable").groupby(label, sort=True).head(per_class)
    return found.drop(columns="_order").reset_index(drop=True)


class Adam:
    """Adam steps on a dictionary of float32 arrays, in place."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float):
        self.weights, self.rate, self.steps = weights, rate, 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def step(self, grads: dict[str, np.ndarray], scale: float = 1.0) -> None:
        self.steps += 1
        rate = self.rate * scale * np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, g in grads.items():
            self.mean[k] += 0.1 * (g - self.mean[k])
            self.square[k] += 0.001 * (g * g - self.square[k])
            self.weights[k] -= (rate * self.mean[k] / (np.sqrt(self.square[k]) + 1e-8)).astype(np.float32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def scatter_add(size: int, at: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Rows of values summed by their target row."""
    out = np.zeros((size, *values.shape[1:]), dtype=values.dtype)
    if len(at):
        order = np.argsort(at, kind="stable")
        starts = np.flatnonzero(np.append(True, np.diff(at[order]) != 0))
        out[at[order][starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out
