"""What the session's catalogs hold."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def discover(spark: SparkSession, name_parts: tuple[str, ...] = ()) -> DataFrame:
    """(catalog, schema, table, n_columns) of catalogs whose name holds one of the parts.

    Metadata only: names and columns come from the catalog, no table is read.
    """
    rows = []
    current = spark.catalog.currentCatalog()
    for cat in spark.catalog.listCatalogs():
        if name_parts and not any(p.lower() in cat.name.lower() for p in name_parts):
            continue
        spark.catalog.setCurrentCatalog(cat.name)
        for db in spark.catalog.listDatabases():
            for t in spark.catalog.listTables(db.name):
                name = t.name if t.isTemporary else f"{db.name}.{t.name}"
                rows.append((cat.name, db.name, t.name, len(spark.catalog.listColumns(name))))
    spark.catalog.setCurrentCatalog(current)
    return spark.createDataFrame(rows, "catalog string, schema string, table string, n_columns int")
