"""Join of documents by the Jaccard similarity of their word n-grams, candidates pruned by Bayes' rule.

1. Texts of the same words are one class. Each class has a MinHash signature.
2. Bands of the signature deal classes into buckets; of buckets with the same members one is kept. Members of a bucket
   compare signatures a few values at a time, and a pair is dropped as soon as the posterior probability that its similarity
   reaches the threshold falls below a tolerance. A large bucket is cut into blocks, and pairs of blocks are tasks.
3. What is left connects classes into groups. Inside a group (cut into blocks too) the pairs that survive the same
   comparison are verified on their n-gram sets, exactly. A task reports links per class and a few edges that keep
   them connected, never all pairs.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut, sized
from lithoframe.llm.common import WORD, add_text_columns, per_process, word_hashes
from lithoframe.llm.graph import components

_WORDS = re.compile(WORD)
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    n: int = 5                  # words of an n-gram
    threshold: float = 0.8
    bands: int = 32             # a pair at the threshold shares no band with a chance of 3e-6
    rows: int = 5               # values of a band
    step: int = 16              # values compared at a time
    tolerance: float = 1e-6     # of the posterior
    block: int = 1024           # members of a bucket in a block
    group_block: int = 128      # classes of a group in a block
    block_bytes: int = 1 << 24  # and bytes of their texts

    @property
    def size(self) -> int:
        return self.bands * self.rows


@functools.cache
def coefficients(s: Settings) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240501)
    return (rng.integers(0, 1 << 63, s.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, s.size, dtype=np.uint64))


@functools.cache
def least_matches(s: Settings) -> tuple[tuple[int, int], ...]:
    """(values compared, matches below which a pair is dropped) for each step.

    With a uniform prior the posterior of the similarity after m matches of n is Beta(m + 1, n - m + 1), and its mass
    above t is P(Binomial(n + 1, t) <= m).
    """
    from math import comb

    steps, t = [], s.threshold
    for n in [*range(s.step, s.size, s.step), s.size]:
        mass, m = 0.0, 0
        while m <= n:
            mass += comb(n + 1, m) * t ** m * (1 - t) ** (n + 1 - m)
            if mass >= s.tolerance:
                break
            m += 1
        steps.append((n, m))
    return tuple(steps)


def ngrams(words: list[str], hashes: dict, s: Settings) -> np.ndarray:
    """Sorted different n-gram hashes; a text of fewer words has one n-gram, all of it."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = min(s.n, len(h))
    made = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        made = (made ^ h[k:len(h) - n + 1 + k]) * _MIX
        made ^= made >> np.uint64(29)
    return np.unique(made * _MIX)


def signature(grams: np.ndarray, s: Settings) -> np.ndarray:
    """The low 16 bits of each smallest value."""
    a, b = coefficients(s)
    low = np.full(s.size, np.uint64(0xFFFFFFFFFFFFFFFF))
    for i in range(0, len(grams), 512):
        made = grams[i:i + 512, None] * a
        made += b
        np.minimum(low, made.min(axis=0), out=low)
    low ^= low >> np.uint64(31)
    return (low & np.uint64(0xFFFF)).astype(np.uint16)


def same_words(words: list[str]) -> bytes:
    import xxhash

    return xxhash.xxh128_digest(" ".join(words).encode("utf-8", "surrogatepass"))


def with_class(docs: DataFrame, text: str) -> DataFrame:
    """docs with _class: 16 bytes that texts of the same words share; null without a word."""
    def batch(texts: list) -> pd.DataFrame:
        return pd.DataFrame({"_class": [same_words(words) if (words := _WORDS.findall(t or "")) else None for t in texts]})

    return add_text_columns(docs, text, batch, "_class binary")


def signed(docs: DataFrame, text: str, s: Settings) -> DataFrame:
    """docs with _class, _values (the signature) and _bytes of the text."""
    def batch(texts: list) -> pd.DataFrame:
        hashes, made = per_process(word_hashes), []
        for t in texts:
            words = _WORDS.findall(t) if t else []
            made.append((same_words(words), signature(ngrams(words, hashes, s), s).tobytes(), len(t)) if words
                        else (None, None, 0))
        return pd.DataFrame(made, columns=["_class", "_values", "_bytes"])

    return add_text_columns(docs, text, batch, "_class binary, _values binary, _bytes long")


def band_keys(classes: DataFrame, s: Settings) -> DataFrame:
    """(key, _class) for every band of every class."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = np.random.default_rng(7).integers(0, 1 << 63, s.size, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        offset = np.arange(s.bands, dtype=np.uint64) * _MIX
        for batch in batches:
            if not batch.num_rows:
                continue
            v = np.frombuffer(b"".join(batch.column("_values").to_pylist()), np.uint16).reshape(-1, s.size)
            keys = (v.astype(np.uint64) * weights).reshape(len(v), s.bands, s.rows).sum(axis=2, dtype=np.uint64)
            keys = (keys ^ (keys >> np.uint64(32)) ^ offset) * _MIX
            at = pa.array(np.repeat(np.arange(len(v)), s.bands))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), batch.column("_class").take(at)],
                                             ["key", "_class"])

    return classes.select("_class", "_values").mapInArrow(run, "key long, _class binary")


def in_blocks(members: DataFrame, group: str, blocks: str) -> DataFrame:
    """Every member once for each pair of blocks that its own block is in: _lo, _hi, and _own (its block)."""
    own = members.withColumn("_own", F.pmod(F.xxhash64("_class", F.lit("block")), F.col(blocks)).cast("int"))
    return (own.withColumn("_other", F.explode(F.sequence(F.lit(0), (F.col(blocks) - 1).cast("int"))))
            .withColumn("_lo", F.least("_own", "_other")).withColumn("_hi", F.greatest("_own", "_other"))
            .drop("_other", blocks))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pd.DataFrame]:
    """The groups of a partition sorted by keys, several small ones together: frames with a column _run."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        frame = batch.to_pandas()
        held.append(frame)
        n += len(frame)
        last = frame[keys].iloc[-1]
        if (held[0][keys].iloc[0] == last).all():
            continue
        whole = pd.concat(held, ignore_index=True)
        ends = (whole[keys] == last).all(axis=1).to_numpy()
        done, rest = whole[~ends], whole[ends]
        held = [rest]
        yield done.assign(_run=(done[keys] != done[keys].shift()).any(axis=1).cumsum().to_numpy())
    if held:
        whole = pd.concat(held, ignore_index=True)
        yield whole.assign(_run=(whole[keys] != whole[keys].shift()).any(axis=1).cumsum().to_numpy())


def surviving(one: np.ndarray, many: np.ndarray, s: Settings) -> np.ndarray:
    """Indexes of the rows of ``many`` that the incremental comparison with ``one`` (a row, or as many rows) keeps."""
    left = np.arange(len(many))
    matches, start = np.zeros(len(many), np.int32), 0
    wide = one.ndim == 2
    for n, least in least_matches(s):
        matches += (many[left, start:n] == (one[left, start:n] if wide else one[start:n])).sum(axis=1, dtype=np.int32)
        keep = matches >= least
        left, matches, start = left[keep], matches[keep], n
        if not len(left):
            break
    return left


def connect(values: np.ndarray, s: Settings) -> np.ndarray:
    """For each row the first row of its component among the pairs that survive."""
    root = np.arange(len(values))
    open_ = np.arange(len(values))
    while len(open_):
        first, open_ = open_[0], open_[1:]
        front = [first]
        while front and len(open_):
            near = surviving(values[front.pop()], values[open_], s)
            if len(near):
                root[open_[near]] = first
                front.extend(open_[near])
                open_ = np.delete(open_, near)
    return root


def candidate_edges(classes: DataFrame, s: Settings) -> DataFrame:
    """Edges (a, b) that connect every pair of classes that shares a band and survives the comparison."""
    keys = cut(band_keys(classes, s))
    full = (keys.groupBy("key").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_class")).alias("_x"),
                                    F.bit_xor(F.xxhash64("_class", F.lit("second"))).alias("_y"))
            .filter(F.col("_n") > 1))
    kept = sized(full.groupBy("_n", "_x", "_y").agg(F.min("key").alias("key"))
                 .select("key", F.ceil(F.col("_n") / s.block).cast("int").alias("_blocks")))
    members = in_blocks(keys.join(kept, "key"), "key", "_blocks").drop("_own")
    by = ["key", "_lo", "_hi"]
    dealt = members.join(classes.select("_class", "_values"), "_class")
    dealt = dealt.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for frame in runs(batches, by):
            v = np.frombuffer(b"".join(frame["_values"]), np.uint16).reshape(-1, s.size)
            ids, run_no = frame["_class"].to_numpy(), frame["_run"].to_numpy()
            starts = np.flatnonzero(np.r_[True, run_no[1:] != run_no[:-1]])
            lengths = np.diff(np.r_[starts, len(run_no)])
            two = starts[lengths == 2]
            near = surviving(v[two], v[two + 1], s)
            a, b = [ids[two[near]]], [ids[two[near] + 1]]
            for i, n in zip(starts[lengths > 2], lengths[lengths > 2]):
                root = connect(v[i:i + n], s)
                other = np.flatnonzero(root != np.arange(n))
                a.append(ids[i + other])
                b.append(ids[i + root[other]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a), pa.binary()),
                                              pa.array(np.concatenate(b), pa.binary())], ["a", "b"])

    return dealt.mapInArrow(run, "a binary, b binary").distinct()


def verified(texts: DataFrame, s: Settings) -> DataFrame:
    """Of the blocks of each group, (a, b) edges of verified links, and (a, links, linked_docs) counts with b null.

    texts: root, _lo, _hi, _own, _class, _copies, _text; a class that comes twice in a block counts once.
    """
    by = ["root", "_lo", "_hi"]
    dealt = texts.repartition(*by).sortWithinPartitions(*by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = per_process(word_hashes)
        for frame in runs(batches, by):
            a, b, links, linked = [], [], [], []
            for _, g in frame.groupby("_run", sort=False):
                g = g.drop_duplicates("_class")
                for row in compared(g, hashes, s):
                    for out, x in zip((a, b, links, linked), row):
                        out.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()),
                                              pa.array(links, pa.int64()), pa.array(linked, pa.int64())],
                                             ["a", "b", "links", "linked_docs"])

    return dealt.mapInArrow(run, "a binary, b binary, links long, linked_docs long")


def compared(g: pd.DataFrame, hashes: dict, s: Settings) -> Iterator[tuple]:
    ids, own, copies = g["_class"].to_numpy(), g["_own"].to_numpy(), g["_copies"].to_numpy()
    n = len(g)
    if n < 2:
        return
    sets = [ngrams(_WORDS.findall(t), hashes, s) for t in g["_text"]]
    values = np.stack([signature(x, s) for x in sets])
    sizes = np.array([len(x) for x in sets])
    offsets = np.r_[0, np.cumsum(sizes)[:-1]]
    vocabulary, at = np.unique(np.concatenate(sets), return_inverse=True)
    here = np.zeros(len(vocabulary), np.int32)
    across = g["_lo"].iloc[0] != g["_hi"].iloc[0]
    links, linked = np.zeros(n, np.int64), np.zeros(n, np.int64)
    root = np.arange(n)

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(n - 1):
        rest = np.arange(i + 1, n)
        if across:
            rest = rest[own[rest] != own[i]]
        rest = rest[surviving(values[i], values[rest], s)]
        if not len(rest):
            continue
        here[at[offsets[i]:offsets[i] + sizes[i]]] = 1
        if len(rest) * 4 > n:
            shared = np.add.reduceat(here[at], offsets)[rest]
        else:
            shared = np.array([here[at[offsets[j]:offsets[j] + sizes[j]]].sum() for j in rest])
        here[at[offsets[i]:offsets[i] + sizes[i]]] = 0
        rest = rest[shared >= s.threshold * (sizes[i] + sizes[rest] - shared) - 1e-9]
        links[i] += len(rest)
        linked[i] += copies[rest].sum()
        links[rest] += 1
        linked[rest] += copies[i]
        for j in rest:
            x, y = top(i), top(j)
            if x != y:
                root[max(x, y)] = min(x, y)
    for i in range(n):
        if links[i]:
            yield ids[i], None, int(links[i]), int(linked[i])
            if root[i] != i:
                yield ids[i], ids[top(i)], 0, 0


def classes_of(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """(rows, classes). rows: _id and _class of every row; classes: _class, class_id, n_links, n_copies.

    class_id is the smallest id of the group, the classes that links connect. n_links counts the other documents that a
    document is linked to, copies of its own words included.
    """
    s = settings
    base = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    rows = cut(signed(base, "_text", s).drop("_text"))
    classes = cut(rows.filter(F.col("_class").isNotNull()).groupBy("_class").agg(
        F.min("_id").alias("_first"), F.count("*").alias("_copies"), F.first("_values").alias("_values"),
        F.first("_bytes").alias("_bytes")))
    groups = cut(components(candidate_edges(classes, s))
                 .join(classes.drop("_values"), F.col("node") == F.col("_class")).drop("node"))
    blocks = (groups.groupBy("root").agg(F.count("*").alias("_n"), F.sum("_bytes").alias("_b"))
              .select("root", F.greatest(F.ceil(F.col("_n") / s.group_block),
                                         F.ceil(F.col("_b") / s.block_bytes)).cast("int").alias("_blocks")))
    chosen = sized(groups.join(blocks, "root"))
    body = with_class(base, "_text").alias("d")
    # texts and classes grow alike, so neither side is sent to every task, however small it is here
    texts = body.join(chosen.alias("c").hint("merge"), (F.col("d._id").eqNullSafe(F.col("c._first")))
                      & (F.col("d._class") == F.col("c._class"))).select(
        "root", "_blocks", "c._class", "_copies", "_text")
    found = cut(verified(in_blocks(texts, "root", "_blocks"), s))
    counts = found.filter(F.col("b").isNull()).groupBy("a").agg(
        F.sum("links").alias("n_texts"), F.sum("linked_docs").alias("n_docs"))
    final = components(found.filter(F.col("b").isNotNull()).select("a", "b"))
    named = final.join(classes.select("_class", "_first"), F.col("node") == F.col("_class"))
    least = named.groupBy("root").agg(F.min("_first").alias("class_id"))
    linked = named.join(least, "root").select("_class", "class_id").join(
        counts, F.col("_class") == F.col("a"), "left").drop("a")
    return rows.select("_id", "_class"), (
        classes.select("_class", "_first", "_copies").join(linked, "_class", "left").select(
            "_class", F.coalesce("class_id", "_first").alias("class_id"), F.col("_copies").alias("n_copies"),
            F.coalesce("n_texts", F.lit(0)).alias("n_texts"),
            (F.coalesce("n_docs", F.lit(0)) + F.col("_copies") - 1).alias("n_links")))


def join_similar(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """A row per row of docs: the id, class_id, n_links, n_copies (documents of the same words), n_texts (linked texts).

    Words are runs of anything but ASCII white space, compared as they are. A text of fewer than n words has one n-gram. A null text and
    one without a word is alone: its class is its own id, without links. Repeated rows are copies. An empty table gives
    none.
    """
    rows, classes = classes_of(docs, text, doc_id, settings)
    return rows.join(classes, "_class", "left").select(
        F.col("_id").alias(doc_id), F.coalesce("class_id", "_id").alias("class_id"),
        *[F.coalesce(c, F.lit(d)).alias(c) for c, d in (("n_links", 0), ("n_copies", 1), ("n_texts", 0))])


def first_of_each(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", settings: Settings = Settings()) -> DataFrame:
    """The rows of docs, one of each group: the one of the smallest id. Rows without a word all stay.

    Columns stay as they are, whatever their names. Of repeated rows one stays; an empty table stays empty.
    """
    rows, classes = classes_of(docs, text, doc_id, settings)
    dropped = rows.join(classes, "_class").filter(
        F.col("class_id").isNotNull() & ~F.col("_id").eqNullSafe(F.col("class_id"))).select(
        F.col("_id").alias("_x"), F.col("_class").alias("_y")).distinct()
    # the caller's columns go along in one, so their names meet none of those made here
    held = docs.select(F.struct("*").alias("_doc"), F.col(doc_id).alias("_id"), F.col(text).alias("_text"))
    kept = with_class(held, "_text").join(
        dropped, F.col("_id").eqNullSafe(F.col("_x")) & (F.col("_class") == F.col("_y")), "left_anti")
    again = F.row_number().over(Window.partitionBy("_id", "_class").orderBy("_id"))
    return (kept.withColumn("_again", again).filter(F.col("_class").isNull() | (F.col("_again") == 1))
            .select("_doc.*"))
