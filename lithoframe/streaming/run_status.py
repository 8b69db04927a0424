"""The current state of each run from a stream of status events.

Each batch leaves a folder ``batch=N`` with the latest event of its runs. Every so many batches they are folded into one table,
``_base/upto=N``, which counts once Spark has marked it finished: readers see the old log or the new one, never half of one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


FOLD_EVERY = 20     # batches between two folds of the log
EVENT = "run_id string, survey_id string, status string, updated_at timestamp, seq long"


def latest_events(events: DataFrame) -> DataFrame:
    """The latest of (run_id, survey_id, status, updated_at, seq) events of each run."""
    return events.groupBy("run_id").agg(F.max_by(
        F.struct("survey_id", "status", "updated_at", "seq"), F.struct("updated_at", "seq")).alias("r")).select(
        "run_id", "r.*")


def feed(events: DataFrame, out: str, checkpoint: str, once: bool = True, fold_every: int = FOLD_EVERY) -> StreamingQuery:
    """Append the latest event per run of each batch to ``out``, to be read by ``changes``; a repeated batch changes nothing.

    Batches keep no state, so an event may come as late as it likes: ``current`` weighs it by its own time.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        add_batch(batch, batch_id, out, fold_every)

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def add_batch(batch: DataFrame, batch_id: int, out: str, fold_every: int = FOLD_EVERY) -> None:
    """Write a batch over its own folder, unless it is folded already; fold the log after every ``fold_every`` batches."""
    spark = batch.sparkSession
    if batch_id <= _base(spark, out)[0]:
        return
    latest_events(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
    if (batch_id + 1) % fold_every == 0:
        fold(spark, out)


def fold(spark: SparkSession, out: str) -> None:
    """Fold all finished batches into one table, and delete what the table before it had folded.

    Readers that have just listed the log still find what the last table was made of; it goes with the next fold.
    """
    before, base = _base(spark, out)
    batches = _finished(spark, out, "batch")
    upto = max([before, *batches])
    if upto == before:
        return
    latest_events(changes(spark, out)).write.mode("overwrite").parquet(f"{out}/_base/upto={upto}")
    old = [p for n, p in batches.items() if n <= before]
    old += [p for n, p in _finished(spark, f"{out}/_base", "upto").items() if n < before]
    for path in old:
        p, fs = _hadoop(spark, path)
        fs.delete(p, True)


def changes(spark: SparkSession, out: str) -> DataFrame:
    """The log: the folded table and the batches after it. Empty where nothing has come yet."""
    upto, base = _base(spark, out)
    paths = ([base] if base else []) + [p for n, p in _finished(spark, out, "batch").items() if n > upto]
    if not paths:
        return spark.createDataFrame([], EVENT)
    return spark.read.parquet(*paths)


def _base(spark: SparkSession, out: str) -> tuple[int, str | None]:
    """The last folded table and the batch that it reaches to; -1 without one."""
    return max(_finished(spark, f"{out}/_base", "upto").items(), default=(-1, None))


def _hadoop(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _finished(spark: SparkSession, folder: str, name: str) -> dict[int, str]:
    """Number and path of the ``name=number`` folders that were written to their end, in order."""
    path, fs = _hadoop(spark, folder)
    found = {}
    for entry in fs.listStatus(path) if fs.exists(path) else ():
        at = entry.getPath().toString()
        kind, _, number = at.rsplit("/", 1)[-1].partition("=")
        if kind == name and fs.exists(_hadoop(spark, f"{at}/_SUCCESS")[0]):
            found[int(number)] = at
    return dict(sorted(found.items()))


def current(changes: DataFrame) -> DataFrame:
    """The last change of each run."""
    return latest_events(changes).drop("seq")
