"""JSON sidecars: survey, well and run records, and metric reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lithoframe.functions.numeric import finite_or_null


def read_sidecars(spark: SparkSession, path: str, schema: T.StructType, kind: str, id_column: str,
                  strict: bool = False, one_per_file: bool = True) -> DataFrame:
    """Records of files ``<kind>/<id>/<name>.json``; the id is taken from the path.

    A listing skips records that do not parse. A strict read, for single lookups, fails on them.
    """
    corrupt = "_corrupt_record"
    wanted = T.StructType([f for f in schema if f.name != id_column])
    reader = spark.read.schema(wanted if strict else T.StructType([*wanted, T.StructField(corrupt, T.StringType())]))
    rows = reader.json(path, multiLine=one_per_file, mode="FAILFAST" if strict else "PERMISSIVE")
    if not strict:
        rows = rows.where(F.col(corrupt).isNull()).drop(corrupt)
    file = F.col("_metadata.file_path")
    return rows.select(F.regexp_extract(file, rf"/{kind}/([^/]+)/", 1).alias(id_column), "*",
                       file.alias("path"))


def write_report(rows: DataFrame, path: str, overwrite: bool = False) -> None:
    """Metric or quality rows as JSON lines; numbers that are not finite become null."""
    doubles = [f.name for f in rows.schema if isinstance(f.dataType, T.DoubleType)]
    rows.withColumns({c: finite_or_null(F.col(c)) for c in doubles}).write.mode(
        "overwrite" if overwrite else "errorifexists").json(path, ignoreNullFields=False)
