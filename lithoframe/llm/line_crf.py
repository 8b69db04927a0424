"""Document quality from a linear-chain conditional random field over lines.

Every line with a word is good or bad. Node weights see the line's features and those of its neighbours, edge weights the
pair of labels. A document's quality is the length-weighted mean of the lines' forward-backward marginals, mapped to
a probability by two further parameters.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoframe.llm.common import add_text_columns, labelled, per_process

SCHEMA = "score double, predicted int, good_share double, n_lines long"
_SPACE = " \t\n\v\f\r"
#: What a character is: 0 lower case, 1 upper case, 2 digit, 3 sentence mark, 4 other mark, 5 other.
CLASSES = 6


@dataclass(frozen=True)
class Settings:
    rows: int = 4096        # bound of the training sample, documents
    rounds: int = 2         # of labelling the lines of bad documents anew
    steps: int = 120        # of gradient descent in each round
    rate: float = 0.1
    l2: float = 1e-3
    chunk: int = 256        # documents whose chains run side by side
    lines: int = 1 << 16    # lines of a padded chunk at most
    threshold: float = 0.3


@dataclass(frozen=True)
class Model:
    nodes: tuple = ()       # weight of "good" for each feature
    edges: tuple = (0.0, 0.0, 0.0, 0.0)  # bad-bad, bad-good, good-bad, good-good
    slope: float = 4.0
    shift: float = -2.0
    settings: Settings = Settings()


def _class_table() -> np.ndarray:
    table = np.full(0x10000, 5, np.uint8)
    for c in range(0x250):
        x = chr(c)
        table[c] = (0 if x.islower() else 1 if x.isupper() else 2 if x.isdigit() else 3 if x in ".,;:?'\"()-" else
                    5 if x.isspace() or x.isalpha() else 4)
    table[0x370:0x2000] = 0
    table[0x3040:0xD800] = 0
    return table


def line_features(text: str | None, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(features, length) of each line with a word: shares of kinds of characters, word shape and repetition."""
    lines = [x for x in text.split("\n") if x.strip(_SPACE)] if text else []
    if not lines:
        return np.empty((0, 11), np.float32), np.empty(0)
    points = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds = table[np.minimum(points, 0xFFFF)]
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    line = np.repeat(np.arange(len(lines)), length)
    share = np.bincount(line * CLASSES + kinds, minlength=len(lines) * CLASSES).reshape(-1, CLASSES) / length[:, None]
    seen: set[str] = set()
    rest = np.empty((len(lines), 5), np.float32)
    for k, x in enumerate(lines):
        words = x.split()
        n = max(1, len(words))
        rest[k] = (len(set(words)) / n, sum(map(eq, words, words[1:])) / n, min(20.0, len(x) / n) / 10,
                   x in seen, x.count(" | ") / n)
        seen.add(x)
    return np.concatenate([share[:, :5], rest, np.log1p(length)[:, None] / 8], axis=1).astype(np.float32), length


def chained(own: np.ndarray) -> np.ndarray:
    """A line's features beside those of the lines before and after it (0 beyond the ends), and a constant."""
    none = np.zeros((1, own.shape[1]), own.dtype)
    return np.concatenate([own, np.concatenate([none, own[:-1]]), np.concatenate([own[1:], none]),
                           np.ones((len(own), 1), own.dtype)], axis=1)


def padded(lengths: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """Documents by length, in chunks whose padded lines stay bounded; a longer document is a chunk by itself."""
    order, start = np.argsort(-lengths, kind="stable"), 0
    while start < len(order):
        n = max(1, min(s.chunk, s.lines // max(1, int(lengths[order[start]]))))
        yield order[start:start + n]
        start += n


def forward_backward(node: np.ndarray, edge: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of "good" (documents x lines), summed pair marginals (2 x 2) and log partition sums.

    node: (documents, lines) scores of good against bad; edge: 2 x 2 scores.
    """
    d, n = node.shape
    scores = np.stack([np.zeros_like(node), node], axis=2)
    alpha = np.empty((d, n, 2))
    alpha[:, 0] = scores[:, 0]
    for t in range(1, n):
        alpha[:, t] = np.logaddexp(alpha[:, t - 1, 0, None] + edge[0], alpha[:, t - 1, 1, None] + edge[1]) + scores[:, t]
    last = alpha[np.arange(d), np.maximum(lengths - 1, 0)]
    log_z = np.logaddexp(last[:, 0], last[:, 1])
    beta = np.zeros((d, n, 2))
    for t in range(n - 2, -1, -1):
        ahead = beta[:, t + 1] + scores[:, t + 1]
        made = np.logaddexp(edge[:, 0] + ahead[:, 0, None], edge[:, 1] + ahead[:, 1, None])
        beta[:, t] = np.where((t + 1 < lengths)[:, None], made, 0.0)
    inside = np.arange(n) < lengths[:, None]
    good = np.where(inside, 1 / (1 + np.exp(np.clip((alpha + beta)[:, :, 0] - (alpha + beta)[:, :, 1], -500, 500))), 0.0)
    pair = (alpha[:, :-1, :, None] + edge + (scores + beta)[:, 1:, None, :]) - log_z[:, None, None, None]
    pairs = (np.exp(np.minimum(pair, 0)) * inside[:, 1:, None, None]).sum(axis=(0, 1))
    return good, pairs, log_z


def quality(features: list[np.ndarray], lengths: list[np.ndarray], model: Model) -> tuple[np.ndarray, list[np.ndarray]]:
    """Good share of each document (0 without lines) and the marginals of its lines."""
    s, w, edge = model.settings, np.array(model.nodes), np.array(model.edges).reshape(2, 2)
    n = np.array([len(x) for x in lengths])
    share, lines = np.zeros(len(n)), [np.empty(0)] * len(n)
    for docs in padded(n, s):
        docs = docs[n[docs] > 0]
        if not len(docs):
            continue
        node = np.zeros((len(docs), n[docs[0]]))
        for k, i in enumerate(docs):
            node[k, :n[i]] = chained(features[i]) @ w
        good = forward_backward(node, edge, n[docs])[0]
        for k, i in enumerate(docs):
            lines[i] = good[k, :n[i]]
            share[i] = (lines[i] * lengths[i]).sum() / lengths[i].sum()
    return share, lines


def _fit_chain(chunks: list, size: int, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Node and edge weights by gradient ascent (Adam) on the labels' conditional likelihood."""
    total = sum(len(x[2]) for x in chunks)
    w, edge = np.zeros(size), np.zeros((2, 2))
    m, v = np.zeros(size + 4), np.zeros(size + 4)
    for step in range(1, s.steps + 1):
        g_w, g_e = np.zeros(size), np.zeros((2, 2))
        for lengths, where, x, y, weight, pairs in chunks:
            node = np.zeros(where.shape)
            node[where] = x @ w
            good, expected, _ = forward_backward(node, edge, lengths)
            g_w += x.T @ (y - good[where])
            g_e += pairs - expected
        g = np.concatenate([g_w, g_e.ravel()]) / total - s.l2 * np.concatenate([w, edge.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        move = s.rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w += move[:size]
        edge += move[size:].reshape(2, 2)
    return w, edge


def fit(features: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, s: Settings) -> Model:
    """Lines first have their document's label. In each round the lines of bad documents that the chain holds for good
    become good, except a document's worst one, and the chain is fitted anew."""
    n = np.array([len(x) for x in lengths])
    known = [np.full(k, float(y)) for k, y in zip(n, labels)]
    model = Model(settings=s)
    for round_ in range(s.rounds):
        chunks = []
        for docs in padded(n, s):
            docs = docs[n[docs] > 0]
            if not len(docs):
                continue
            where = np.arange(n[docs[0]]) < n[docs][:, None]
            pairs = np.zeros((2, 2))
            for i in docs:
                y = known[i].astype(int)
                np.add.at(pairs, (y[:-1], y[1:]), 1)
            chunks.append((n[docs], where, np.concatenate([chained(features[i]) for i in docs]),
                           np.concatenate([known[i] for i in docs]), None, pairs))
        if not chunks:
            return model
        w, edge = _fit_chain(chunks, chunks[0][2].shape[1], s)
        model = Model(tuple(w), tuple(edge.ravel()), settings=s)
        share, lines = quality(features, lengths, model)
        for i in np.flatnonzero((labels == 0) & (n > 0)):
            known[i] = (lines[i] >= 0.5).astype(float)
            known[i][int(lines[i].argmin())] = 0.0
    x = np.stack([share, np.ones(len(share))], axis=1)
    c = np.array([4.0, -2.0])
    for _ in range(50):  # Newton steps of a logistic regression in two parameters
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        c += np.linalg.solve(h, x.T @ (labels - p) - 1e-2 * c)
    return Model(model.nodes, model.edges, float(c[0]), float(c[1]), s)


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", doc_id: str = "doc_id",
          settings: Settings = Settings()) -> Model:
    """A model from at most about ``rows`` of the labelled rows, drawn by a hash of the id.

    Line features are made where the rows are; one task fits the chain on that bounded sample. Null labels teach nothing,
    null texts have no lines. Rows of one id count once, by their smallest text and label. Without both labels in the sample all weights are zero.
    """
    s = settings
    sample = labelled(docs, labels, label, text, doc_id, s.rows)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _class_table()
        for batch in batches:
            made = [line_features(t, table) for t in batch.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_y"), pa.array([x.tobytes() for x, _ in made], pa.binary()),
                 pa.array([n.astype(np.int64).tobytes() for _, n in made], pa.binary())], ["_id", "_y", "_x", "_n"])

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in b.to_pylist()),
                      key=lambda r: (r["_id"], r["_y"], len(r["_x"]), zlib.crc32(r["_x"])))
        y = np.array([r["_y"] for r in rows], float)
        if len(set(y)) < 2:
            return
        found = fit([np.frombuffer(r["_x"], np.float32).reshape(-1, 11) for r in rows],
                    [np.frombuffer(r["_n"], np.int64) for r in rows], y, s)
        yield pa.RecordBatch.from_pydict({"nodes": [list(map(float, found.nodes))], "edges": [list(map(float, found.edges))],
                                          "slope": [found.slope], "shift": [found.shift]})

    made = sample.mapInArrow(featured, T.StructType([sample.schema["_id"], sample.schema["_y"], T.StructField(
        "_x", T.BinaryType()), T.StructField("_n", T.BinaryType())]))
    row = made.repartition(1).mapInArrow(trained, "nodes array<double>, edges array<double>, slope double, shift double").first()
    if row is None or not row["nodes"]:
        return Model(nodes=(0.0,) * 34, settings=s)
    return Model(tuple(row["nodes"]), tuple(row["edges"]), row["slope"], row["shift"], s)


def score(docs: DataFrame, model: Model, text: str = "text", prefix: str = "") -> DataFrame:
    """docs with score (probability of label 1), predicted (1 from the threshold on), good_share and n_lines.

    A text that is null or has no line with a word has a good share of 0. Equal rows score alike; an empty table stays empty. New names begin with ``prefix``; input
    columns of these names are replaced.
    """
    def batch(texts: list) -> pd.DataFrame:
        table = per_process(_class_table)
        made = [line_features(t, table) for t in texts]
        share, lines = quality([x for x, _ in made], [n for _, n in made], model)
        p = 1 / (1 + np.exp(-np.clip(model.slope * share + model.shift, -30, 30)))
        return pd.DataFrame({"score": p, "predicted": (p >= model.settings.threshold).astype("int32"),
                             "good_share": share, "n_lines": [len(x) for x in lines]})

    return add_text_columns(docs, text, batch, SCHEMA, prefix)
