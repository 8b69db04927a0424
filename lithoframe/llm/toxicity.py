"""Toxicity: logistic regression on hashed word n-grams and skip-grams, trained by FTRL-proximal.

Each coordinate has its own learning rate, and L1 leaves few weights other than zero: the model that goes to the tasks
is those few.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoframe.llm.common import add_text_columns, labelled, per_process, release, word_hashes

SCHEMA = "score double, predicted int"
_WORDS = re.compile(r"\w+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    rows: int = 16384         # bound of the training sample
    bits: int = 20            # of a feature's index
    skip: int = 1             # words that a skip-gram may leave out at most
    epochs: int = 4
    alpha: float = 1.0        # learning rate
    beta: float = 1.0
    l1: float = 10.0          # for a full sample; falls with the square root of its size
    l2: float = 0.1
    threshold: float = 0.5


@dataclass(frozen=True)
class Weights:
    index: bytes = b""        # uint32, ascending
    value: bytes = b""        # float64
    bias: float = -2.0
    settings: Settings = Settings()

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << self.settings.bits)
        w[np.frombuffer(self.index, np.uint32)] = np.frombuffer(self.value, np.float64)
        return w


def _tools(model: Weights) -> tuple[np.ndarray, dict]:
    return model.dense(), word_hashes()


def features(text: str | None, hashes: dict, s: Settings) -> np.ndarray:
    """Feature indexes of the whole text, with repeats: words, pairs, and pairs with words left out between."""
    words = _WORDS.findall(text.lower()) if text else []
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    found = [h * _MIX]
    for gap in range(1, s.skip + 2):
        found.append((h[:-gap] * np.uint64(2 * gap + 1) + h[gap:]) * _MIX)
    return (np.concatenate(found) >> np.uint64(64 - s.bits)).astype(np.int32)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, float]:
    """Indexes and values of the weights that aren't zero, and the bias (which has no penalty)."""
    size = (1 << s.bits) + 1
    z, n = np.zeros(size), np.zeros(size)
    bias = size - 1
    p = np.clip(labels.mean() if len(labels) else 0.1, 1e-3, 1 - 1e-3)
    z[bias], n[bias] = -np.log(p / (1 - p)) * s.beta / s.alpha, 0.0

    l1 = s.l1 * min(1.0, np.sqrt(len(examples) / s.rows))

    def weight(i: np.ndarray) -> np.ndarray:
        w = -(z[i] - np.sign(z[i]) * l1) / ((s.beta + np.sqrt(n[i])) / s.alpha + s.l2)
        w[np.abs(z[i]) <= l1] = 0
        w[-1] = -z[bias] * s.alpha / (s.beta + np.sqrt(n[bias]))
        return w

    for epoch in range(s.epochs):
        for k in np.random.default_rng(epoch).permutation(len(examples)):
            i = examples[k]
            w = weight(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - labels[k]
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w
            n[i] += g * g
    every = np.arange(size)
    w = weight(every)
    kept = np.flatnonzero(w[:-1])
    return kept, w[kept], float(w[-1])


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", text: str = "text", doc_id: str = "doc_id",
          settings: Settings = Settings()) -> Weights:
    """Weights from at most about ``rows`` of the labelled rows, drawn by a hash of the id.

    Features are made where the rows are. The sample is bounded, so one task passes over it, in a fixed permutation. A row
    with a null label teaches nothing; a null text counts as empty. Rows of one id count once, by their smallest text and label. Without both labels in the sample the weights
    are zero.
    """
    s = settings
    sample = labelled(docs, labels, label, text, doc_id, s.rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        hashes, end = word_hashes(), np.array([1 << s.bits], np.int32)
        for batch in batches:
            made = [np.concatenate([np.unique(features(t, hashes, s)), end]) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("_y"), pa.array(made, pa.list_(pa.int32()))],
                                             ["_id", "_y", "_features"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = []
        for batch in batches:
            for i, y, f in zip(batch.column("_id").to_pylist(), batch.column("_y").to_pylist(), batch.column("_features")):
                seen.append((i, y, f.values.to_numpy()))
        seen.sort(key=lambda x: (x[0], x[1], len(x[2]), zlib.crc32(x[2])))
        y = np.array([x[1] for x in seen], float)
        if len(set(y)) < 2:
            return
        index, value, bias = ftrl([x[2] for x in seen], y, s)
        yield pa.RecordBatch.from_pydict({"index": [index.astype(np.uint32).tobytes()], "value": [value.tobytes()],
                                          "bias": [bias]})

    made = sample.mapInArrow(featured, T.StructType([*sample.schema.fields[:1], *sample.schema.fields[2:], T.StructField(
        "_features", T.ArrayType(T.IntegerType()))]))
    row = made.repartition(1).mapInArrow(fit, "index binary, value binary, bias double").first()
    return Weights(bytes(row["index"]), bytes(row["value"]), row["bias"], s) if row else Weights(settings=s)


def score(docs: DataFrame, model: Weights, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with score (probability of label 1) and predicted (1 from the threshold on).

    Null texts count as empty; equal rows score alike; an empty table stays empty. New names begin with ``prefix``; input columns
    of these names are replaced.
    """
    s = model.settings

    def batch(texts: list) -> pd.DataFrame:
        w, hashes = per_process(_tools, model)
        total = np.empty(len(texts))
        for k, t in enumerate(texts):
            i = features(t, hashes, s)
            total[k] = w[np.unique(i[w[i] != 0])].sum() + model.bias
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return pd.DataFrame({"score": p, "predicted": (p >= s.threshold).astype("int32")})

    return add_text_columns(docs, text, batch, SCHEMA, prefix)
