"""Files ingested as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lithoframe.sources.segy import read_segy

FILES_PER_BATCH = 100
_FILES = "path string, modificationTime timestamp, length long, content binary"


def _stored(spark: SparkSession, paths: list[str], out: str) -> dict[str, str]:
    """Write the traces of the files; the errors of those that could not be read."""
    try:
        read_segy(spark, *paths).write.mode("overwrite").parquet(out)
        return {}
    except Exception as whole:  # which file it was is known only by reading each
        if len(paths) == 1:
            return {paths[0]: _reason(whole)}
    errors, mode = {}, "overwrite"
    for path in paths:
        try:
            read_segy(spark, path).write.mode(mode).parquet(out)
            mode = "append"
        except Exception as one:
            errors[path] = _reason(one)
    return errors


def _reason(error: Exception) -> str:
    """The last line of an error that says something."""
    lines = [x.strip() for x in str(error).splitlines() if x.strip() and not x.strip().startswith("at ")]
    told = [x for x in lines if "Error: " in x or "Exception: " in x]
    return (told or lines or [type(error).__name__])[-1][:1000]


def ingest_arrivals(spark: SparkSession, raw: str, out: str, checkpoint: str, once: bool = True,
                    files_per_batch: int = FILES_PER_BATCH) -> StreamingQuery:
    """Traces of new SEG-Y files under ``raw`` to ``out``/traces, one status row per file.

    The stream carries file names only; each batch reads its files through the splittable source. Where that
    fails, its files are read one after the other: one that cannot be read is ``failed``, with its error, and the stream goes
    on. A batch writes its own folder, so a repeated batch replaces itself.
    """
    arrivals = (spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.{[sS][gG][yY],[sS][eE][gG][yY]}")
                .option("maxFilesPerTrigger", files_per_batch).load(raw).select("path", "length"))

    def ingest(batch: DataFrame, batch_id: int) -> None:
        files = sorted(tuple(r) for r in batch.collect())  # at most files_per_batch, listed once
        if not files:
            return
        errors = _stored(spark, [path for path, _ in files], f"{out}/traces/batch={batch_id}")
        rows = [(path, size, "failed" if path in errors else "complete", errors.get(path)) for path, size in files]
        done = spark.createDataFrame(rows, "path string, size long, status string, error string").coalesce(1)
        done.withColumn("updated_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{out}/status/batch={batch_id}")

    writer = arrivals.writeStream.foreachBatch(ingest).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
