"""Exact top-k by integer inner product over an impact-ordered index, score at a time.

Vectors are dealt into blocks. A block's index holds, for every dimension, its vectors in the order of that
dimension's value, cut into segments of one quantised impact. A query takes the segments of all dimensions by descending
impact and adds them to the accumulators. What the open segments can still add bounds every vector; once that proves
that few vectors can be among the best, those are scored exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lithoframe.functions.lineage import cut


@dataclass(frozen=True)
class Settings:
    k: int = 5
    scale: int = 256        # a component x becomes floor(scale * x)
    block: int = 8192       # vectors of an index block
    queries: int = 512      # that a task takes at once
    segments: int = 24      # of a dimension
    enough: float = 0.5     # share of a block that is scored exactly rather than taking more postings
    steps: tuple = (0.5, 0.8, 0.9, 0.95, 1.0)  # shares of the postings after which the bound is tried


def as_integers(vectors: DataFrame, vec_id: str, embedding: str, s: Settings) -> DataFrame:
    """(vec_id, v) of the rows that take part: an id, and a vector without null, nan or infinite components."""
    x = F.col(embedding)
    sound = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    return (vectors.filter(F.col(vec_id).isNotNull() & x.isNotNull() & sound)
            .select(F.col(vec_id).cast("long").alias("vec_id"),
                    F.transform(x, lambda c: F.floor(c.cast("double") * s.scale)).alias("v")))


def _matrix(table: pa.Table, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors in the order of ids; shorter vectors end with zeros."""
    v = table.column("v").combine_chunks()
    lengths = np.diff(v.offsets.to_numpy())
    made = np.zeros((len(v), width), np.int64)
    made[np.arange(width) < lengths[:, None]] = v.flatten().to_numpy()
    ids = table.column("vec_id").to_numpy()
    order = np.lexsort((*made.T[:1], ids))
    return ids[order], made[order]


def _packed(ids: np.ndarray, v: np.ndarray) -> tuple[bytes, bytes, str]:
    top = int(np.abs(v).max()) if v.size else 0
    kind = "<i2" if top < 1 << 15 else "<i4" if top < 1 << 31 else "<i8"
    return ids.astype("<i8").tobytes(), v.astype(kind).tobytes(), kind


def build_index(vectors: DataFrame, width: int, blocks: int, s: Settings) -> DataFrame:
    """A row per block: ids, values (row by row), the posting order of every dimension and where its segments begin."""
    def build(table: pa.Table) -> pa.Table:
        ids, v = _matrix(table, width)
        order = np.argsort(v, axis=0, kind="stable").T
        edges = np.empty((width, s.segments + 1), np.int64)
        for d in range(width):
            low, high = int(v[:, d].min()), int(v[:, d].max()) + 1
            bounds = low + (np.arange(s.segments) * (high - low)) // s.segments
            edges[d] = np.r_[np.searchsorted(v[order[d], d], bounds, side="left"), len(ids)]
        packed_ids, packed, kind = _packed(ids, v)
        return pa.table({"block": pa.array([table.column("block")[0].as_py()], pa.int32()), "ids": [packed_ids], "vectors": [packed], "kind": [kind],
                         "postings": [order.astype("<u4" if len(ids) >= 1 << 16 else "<u2").tobytes()], "edges": [edges.tobytes()]})

    dealt = vectors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
    return dealt.groupBy("block").applyInArrow(
        build, "block int, ids binary, vectors binary, kind string, postings binary, edges binary")


def _kth(scores: np.ndarray, k: int) -> int:
    """The k-th highest, or the lowest of fewer; 0 of none."""
    at = max(0, len(scores) - k)
    return np.partition(scores, at)[at] if len(scores) else 0


class Block:
    """A block of the index, for queries without components beyond ``largest``; held in the smallest floats that keep its sums exact."""

    def __init__(self, row: dict, width: int, largest: float):
        self.ids = np.frombuffer(row["ids"], "<i8")
        n = len(self.ids)
        self.v = np.frombuffer(row["vectors"], row["kind"]).reshape(n, width)
        self.postings = np.frombuffer(row["postings"], "<u4" if n >= 1 << 16 else "<u2").reshape(width, n).astype(np.intp)
        self.edges = np.frombuffer(row["edges"], np.int64).reshape(width, -1)
        reach = 2.0 * width * largest * float(np.abs(self.v.astype(float)).max(initial=0.0))
        self.sure = reach < 2.0 ** 53
        self.exact = self.v.astype(np.float32 if reach < 2.0 ** 24 else np.float64)
        self.sorted = np.take_along_axis(self.exact.T, self.postings, axis=1)
        last, first = np.maximum(self.edges[:, 1:] - 1, 0), np.minimum(self.edges[:, :-1], n - 1)
        self.high, self.low = (np.take_along_axis(self.sorted, at, axis=1) for at in (last, first))
        self.sizes = np.diff(self.edges)

    def scores(self, at: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Exact: by floats where no sum can leave their integers, else by 64-bit integers."""
        if self.sure:
            return (self.exact[at] @ q.astype(self.exact.dtype)).astype(np.int64)
        return self.v[at].astype(np.int64) @ q

    def best(self, query_id: int, q: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the k best vectors of the block, the query's own id left out.

        The accumulators hold the most that each vector can score: its own part in the dimensions where its segment was
        taken, and that of the best open segment in the others. Segments of a dimension are taken from one end of
        its postings, so those taken so far are one run of them; a further step adds its longer runs up anew, as all open
        segments are others. The vectors with the highest bounds are scored for a bar. Where floats can't hold the sums
        exactly, nothing is excluded and the whole block is scored.
        """
        n, (width, parts) = len(self.ids), self.high.shape
        possible = np.flatnonzero(self.ids != query_id)
        weight = q.astype(self.exact.dtype)
        up = weight > 0
        least = weight * np.where(up, self.sorted[:, 0], self.sorted[:, -1])
        impact = weight[:, None] * np.where(up[:, None], self.high, self.low) - least[:, None]
        impact[self.sizes == 0] = 0.0
        rank = np.argsort(-impact, axis=None, kind="stable")
        rank = rank[impact.ravel()[rank] > 0]
        dims, done = rank // parts, np.cumsum(self.sizes.ravel()[rank])
        for share in s.steps if self.sure and len(possible) > s.k and len(rank) else ():
            upto = int(np.searchsorted(done, share * done[-1], side="right"))
            begin, end, open_ = np.full(width, n), np.zeros(width, np.int64), least.copy()
            np.minimum.at(begin, dims[:upto], self.edges[:, :-1].ravel()[rank[:upto]])
            np.maximum.at(end, dims[:upto], self.edges[:, 1:].ravel()[rank[:upto]])
            np.maximum.at(open_, dims[upto:], least[dims[upto:]] + impact.ravel()[rank[upto:]])
            bound = np.full(n, open_.sum(), weight.dtype)
            for d, (i, j) in enumerate(zip(begin.tolist(), end.tolist())):
                if i < j:
                    gain = self.sorted[d, i:j] * weight[d]
                    gain -= open_[d]
                    np.add.at(bound, self.postings[d, i:j], gain)
            held = bound[possible]
            likely = possible[np.argpartition(held, max(0, len(held) - 8 * s.k))[-8 * s.k:]]
            possible = possible[held >= _kth(self.scores(likely, q), s.k)]
            if len(possible) <= max(s.k, s.enough * n):
                break
        exact = self.scores(possible, q)
        good = exact >= _kth(exact, s.k)
        ids, exact = self.ids[possible[good]], exact[good]
        order = np.lexsort((ids, -exact))[:s.k]
        return ids[order], exact[order]


def search(queries: DataFrame, vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding",
           settings: Settings = Settings()) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best vectors of every query, ties to the smaller id.

    Rows with a null id or vector, or with a null or non-finite component, take no part. Rows of the query's own id are no
    candidates. A shorter vector ends with zeros. Equal query rows count once; repeated vectors are candidates as often as they come. Scores
    must fit a long. Blocks of queries meet every block of the index once; no pair of vectors is ever a row.
    """
    s = settings
    asked = cut(as_integers(queries, vec_id, embedding, s).dropDuplicates())
    known = cut(as_integers(vectors, vec_id, embedding, s))
    n, width = known.agg(F.count("*"), F.max(F.size("v"))).first()
    m, wide = asked.agg(F.count("*"), F.max(F.size("v"))).first()
    schema = "query_id long, query_hash long, vec_id long, score long"
    if not n or not m:
        empty = known.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(0).cast("int").alias("rank"), "vec_id", "score")
    width, blocks, groups = max(width, wide, 1), math.ceil(n / s.block), math.ceil(m / s.queries)
    index = build_index(known, width, blocks, s)
    # Bundles of blocks meet slices of queries: no more of either than keep all cores at work, as each of one gets a copy of the other.
    wanted = 8 * known.sparkSession.sparkContext.defaultParallelism
    bundles, slices = min(blocks, wanted), min(groups, math.ceil(wanted / blocks))

    def gather(table: pa.Table) -> pa.Table:
        ids, v = _matrix(table, width)
        q_ids, q, kind = _packed(ids, v)
        return pa.table({"query_block": pa.array([table.column("query_block")[0].as_py()], pa.int32()), "q_ids": [q_ids], "q": [q], "q_kind": [kind]})

    dealt = asked.withColumn("query_block", F.pmod(F.xxhash64("vec_id", F.lit("query")), F.lit(groups)).cast("int"))
    asked_blocks = dealt.groupBy("query_block").applyInArrow(gather, "query_block int, q_ids binary, q binary, q_kind string")

    def dealt_out(df: DataFrame, bundle: Column, slice_: Column) -> DataFrame:
        return df.withColumn("tile", bundle * slices + slice_).repartitionById(bundles * slices, F.col("tile"))

    def below(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = dealt_out(index.withColumn("slice", below(slices)), F.col("block") % bundles, F.col("slice"))
    right = dealt_out(asked_blocks.withColumn("bundle", below(bundles)), F.col("bundle"), F.col("query_block") % slices)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids = np.frombuffer(row["q_ids"], "<i8")
                asked_ = np.frombuffer(row["q"], row["q_kind"]).reshape(len(q_ids), width).astype(np.int64)
                block = Block(row, width, float(np.abs(asked_.astype(float)).max()))
                found = [block.best(int(k), q, s) for k, q in zip(q_ids, asked_)]
                counts = [len(x) for x, _ in found]
                marks = [int.from_bytes(_digest(q), "little", signed=True) for q in asked_]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, counts)), pa.array(np.repeat(np.array(marks, np.int64), counts)),
                     pa.array(np.concatenate([x for x, _ in found]).astype(np.int64)),
                     pa.array(np.concatenate([x for _, x in found]).astype(np.int64))],
                    ["query_id", "query_hash", "vec_id", "score"])

    # Never broadcast: the right side has the queries once for every bundle.
    each = left.join(right.hint("merge"), "tile").mapInArrow(run, schema)
    order = Window.partitionBy("query_id", "query_hash").orderBy(F.desc("score"), "vec_id")
    return (each.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= s.k)
            .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


def _digest(q: np.ndarray) -> bytes:
    import xxhash

    return xxhash.xxh64_digest(q.tobytes())
