"""What several operators share: splits by checksum, bounded samples, text UDFs, global order."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The words of a text: runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo n; 0 for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n, F.lit(0))


def add_text_columns(df: DataFrame, text: str, fn: Callable[[list], pd.DataFrame], schema: str,
                     prefix: str = "") -> DataFrame:
    """df with the columns of ``schema`` that ``fn`` makes from a batch of texts.

    Only the text goes through Arrow. New names begin with ``prefix``; an input column of such a name is replaced. The UDF counts as
    non-deterministic so that a filter on its result doesn't make Spark run it twice.
    """
    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield fn([x if isinstance(x, str) else None for x in texts])

    names = [f.split()[0].strip() for f in schema.split(",")]
    kept = [c for c in df.columns if c.lower() not in {(prefix + n).lower() for n in names}]
    held = df.withColumn("_made", run.asNondeterministic()(F.col(text)))
    return held.select(*kept, *[F.col("_made")[n].alias(prefix + n) for n in names])


def thinned(df: DataFrame, key: Column, bound: int, n: int | None = None) -> DataFrame:
    """About ``bound`` rows at most, chosen by a hash of ``key``: reruns choose the same rows.

    Rows of one key are in or out together; where they repeat, ``n`` gives the number of keys, and ``bound`` is one of keys.
    """
    n = df.count() if n is None else n
    if n <= bound:
        return df
    scale = 1 << 30
    return df.filter(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(scale)) < int(scale * bound / n))


def labelled(docs: DataFrame, labels: DataFrame, label: str, text: str, doc_id: str, bound: int) -> DataFrame:
    """(_id, _text, _y) of about ``bound`` ids at most that have a label, drawn by a hash of the id.

    An id comes once, with the smallest of its texts and labels, however often it is repeated on either side.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("_id")).agg(
        F.min(F.col(label).cast("int")).alias("_y"))
    drawn = thinned(known, F.col("_id"), bound)
    found = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(drawn), "_id")
    return found.groupBy("_id", "_y").agg(F.min("_text").alias("_text")).select("_id", "_text", "_y")


def word_hashes():
    """A function from words to 64-bit hashes that remembers the words it has seen, up to 65,536."""
    import xxhash

    class Seen(dict):
        def __missing__(self, word):
            if len(self) >= 65_536:
                self.clear()
            h = self[word] = xxhash.xxh64_intdigest(word)
            return h

    return Seen()


def portions(texts: list, chars: int = 1 << 20) -> Iterator[list]:
    """The texts in lists of about a million characters, so that the words of a large batch aren't held at once."""
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t) if t else 0
        if held >= chars:
            yield part
            part, held = [], 0
    if part:
        yield part


class Remembered(dict):
    """What encode_all(words) makes of each word, kept for later texts; begins anew beyond ``limit`` words."""

    limit, longest = 250_000, 64

    def encode_all(self, words: list[str]):
        raise NotImplementedError

    def learn(self, texts: list[list[str]]) -> None:
        """Make sure of every word of these texts; those that were long last time are dropped."""
        for w in self.__dict__.pop("long", ()):
            self.pop(w, None)
        if len(self) > self.limit:
            self.clear()
        new = list(set().union(*texts).difference(self))
        self.update(zip(new, self.encode_all(new)) if new else ())
        self.long = [w for w in new if len(w) > self.longest]


_HELD: dict = {}


def per_process(make: Callable, *args):
    """make(*args), kept in the Python worker until another is asked for; what was held is let go of first."""
    key = (make, args)
    if key not in _HELD:
        release()
        _HELD[key] = make(*args)
    return _HELD[key]


def release() -> None:
    """Let go of what the Python worker holds for earlier tasks, and give the memory back to the machine."""
    if not _HELD:
        return
    _HELD.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give memory that the Python worker no longer uses back to the machine."""
    pa.default_memory_pool().release_unused()
    give_back = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give_back is not None:
        give_back(0)


def settled(df: DataFrame) -> DataFrame:
    """cut(df); the shuffles behind it, which nothing reads again, are removed at once instead of when the driver next collects garbage.

    Jobs of many steps would otherwise keep the shuffle files of all of them on the executors' disks.
    """
    from lithoframe.functions.lineage import cut

    conf, key = df.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = conf.get(key, None)
    conf.set(key, "true")
    try:
        return cut(df)
    finally:
        conf.unset(key) if before is None else conf.set(key, before)


def discard(df: DataFrame) -> None:
    """Delete a table that settled() wrote, once everything made from it is written too."""
    jvm, folders = df.sparkSession._jvm, {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
        path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def in_order(df: DataFrame, order: list[str], sums: dict[str, str], within: list[str] = ()) -> DataFrame:
    """Rows in a global order, with the running sum of each column of ``sums`` (named by its value) before each row.

    The rows are dealt out by range, sorted, summed inside their partition and written once. What earlier partitions
    hold is a row for each of them (and each ``within`` group in it), so no task sees more than its own range.
    ``within``: leading columns of the order; the sums start anew for each of their groups, which may be larger than a partition.
    """
    from lithoframe.functions.lineage import cut, sized

    groups, columns = list(within), list(sums)
    schema = T.StructType([*df.schema.fields, *[T.StructField(f"_r{i}", df.schema[c].dataType)
                                                for i, c in enumerate(columns)], T.StructField("_part", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, key, carry = TaskContext.get().partitionId(), None, [0] * len(columns)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            keys = list(zip(*[batch.column(g).to_pylist() for g in groups])) if groups else [()] * n
            new = np.fromiter((a != b for a, b in zip(keys, [key, *keys[:-1]])), bool, n)
            first = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            out = []
            for k, c in enumerate(columns):
                values = batch.column(c).to_numpy(zero_copy_only=False)
                before = np.r_[np.zeros(1, values.dtype), np.cumsum(values)[:-1]]
                run_ = np.where(first >= 0, before - before[first], before + carry[k])
                out.append(run_)
                carry[k] = run_[-1] + values[-1]
            key = keys[-1]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *[pa.array(x, batch.schema.field(c).type) for x, c in zip(out, columns)],
                 pa.array(np.full(n, part, np.int32))], schema=pa.schema(
                    [*batch.schema, *[pa.field(f"_r{k}", batch.schema.field(c).type) for k, c in enumerate(columns)],
                     pa.field("_part", pa.int32())]))

    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(run, schema))
    totals = placed.groupBy(*groups, "_part").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(columns)])
    before = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sized(totals.select(
        F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)],
        *[F.coalesce(F.sum(f"_t{i}").over(before), F.lit(0)).alias(f"_s{i}") for i, _ in enumerate(columns)]))
    same = [F.col("_part") == F.col("_p"), *[F.col(g).eqNullSafe(F.col(f"_g{i}")) for i, g in enumerate(groups)]]
    return placed.join(starts, functools.reduce(lambda a, b: a & b, same)).select(
        *df.columns, *[(F.col(f"_r{i}") + F.col(f"_s{i}")).alias(name) for i, name in enumerate(sums.values())])
