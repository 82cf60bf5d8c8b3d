"""S2/S3/S4: CSV source and sink, table sink.

* CSV is read with an explicit schema and a header (``read_csv`` in the
  reference infers types; here types are always stated).
* CSV is written with a header (the reference's ``COPY … CSV HEADER``).
* ``save_table`` is ``CREATE TABLE … AS``: Parquet under a shared folder
  (or a catalog table), which also cuts lineage for later jobs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TS_FORMAT = "yyyy-MM-dd HH:mm:ss[.SSSSSS]"  # with the fraction of a second


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    (df.write.mode(mode).option("header", True).option("timestampNTZFormat", TS_FORMAT)
     .option("timestampFormat", TS_FORMAT).csv(path))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("timestampNTZFormat", TS_FORMAT)
            .option("timestampFormat", TS_FORMAT).option("mode", "FAILFAST").csv(path))


def save_table(df: DataFrame, path: str | None = None, name: str | None = None,
               mode: str = "overwrite") -> DataFrame:
    """Materialise ``df`` (Parquet at ``path``, or catalog table ``name``) and
    return a DataFrame reading the stored result."""
    spark = df.sparkSession
    if name:
        df.write.mode(mode).saveAsTable(name)
        return spark.table(name)
    if not path:
        raise ValueError("path or name required")
    df.write.mode(mode).parquet(path)
    return spark.read.parquet(path)
