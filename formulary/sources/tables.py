"""Reading rows for expressions and writing what comes of them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "orc", "csv", "json")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read(spark: SparkSession, path: str, kind: str = "parquet", schema: T.StructType | str | None = None) -> DataFrame:
    """Text formats need a schema, so that no pass over the data goes into guessing one."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind!r}")
    if kind in ("csv", "json") and schema is None:
        raise ValueError(f"{kind} needs a schema")
    reader = spark.read.format(kind)
    if schema is not None:
        reader = reader.schema(schema)
    return (reader.option("header", True) if kind == "csv" else reader).load(path)


def contexts(spark: SparkSession, rows: Sequence[Mapping[str, object]]) -> DataFrame:
    """A row for each mapping of names to numbers, truth values or nested mappings of these."""

    def kind(value: object) -> T.DataType:
        if isinstance(value, bool):
            return T.BooleanType()
        if isinstance(value, (int, float)):
            return T.DoubleType()
        if isinstance(value, Mapping):
            return T.StructType([T.StructField(k, kind(v)) for k, v in value.items()])
        raise TypeError(f"{value!r} is no value")

    def plain(value: object) -> object:
        if isinstance(value, Mapping):
            return {k: plain(v) for k, v in value.items()}
        return value if isinstance(value, bool) else float(value)

    first = rows[0]
    schema = T.StructType([T.StructField(k, kind(v)) for k, v in first.items()])
    return spark.createDataFrame([tuple(plain(row[k]) for k in first) for row in rows], schema)


def with_struct(df: DataFrame, prefix: str, fields: Mapping[str, str]) -> DataFrame:
    """Columns gathered under a name: fields of a struct, and flat columns ``prefix.field``."""
    return df.withColumn(prefix, F.struct(*[F.col(column).cast("double").alias(name) for name, column in fields.items()]))


def write(df: DataFrame, path: str, kind: str = "parquet", by: Sequence[str] = (), mode: str = "errorifexists") -> None:
    writer = df.write.format(kind).mode(mode)
    (writer.partitionBy(*by) if by else writer).save(path)
