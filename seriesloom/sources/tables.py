"""Reading and writing tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

SERIES_SCHEMA = "date timestamp_ntz, id string, value double"


def clean_name(name: str) -> str:
    """snake_case form of a column label."""
    name = re.sub(r"%", " percent ", name)
    name = re.sub(r"([a-z0-9])([A-Z])", r"\1_\2", name)
    return re.sub(r"[^0-9a-zA-Z]+", "_", name).strip("_").lower()


def clean_names(df: DataFrame) -> DataFrame:
    """Snake-case all column names; repeated names get a running number."""
    seen: dict[str, int] = {}
    names = []
    for column in df.columns:
        name = clean_name(column)
        seen[name] = seen.get(name, 0) + 1
        names.append(name if seen[name] == 1 else f"{name}_{seen[name]}")
    return df.toDF(*names)


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Comma-separated file with a header; empty fields and NA are null, and names become snake_case.

    A schema (DDL) picks its columns by name, whatever their order in the file; text that does not fit a type becomes
    null. Give one for large files: without it Spark reads the file twice to infer the types.
    """
    if not path.lower().rstrip("/").endswith((".csv", ".csv.gz")):
        raise ValueError(f"expected a .csv file, got {path!r}")
    reader = spark.read.option("header", True).option("nullValue", "NA")
    if schema:
        df = clean_names(reader.csv(path))
        wanted = T.StructType.fromDDL(schema)
        require_columns(df, wanted.fieldNames())
        return df.select(*[_typed(f) for f in wanted.fields])
    df = clean_names(reader.option("inferSchema", True).csv(path))
    blank = {
        f.name: F.when(F.trim(F.col(f.name)) != "", F.col(f.name))
        for f in df.schema.fields if isinstance(f.dataType, T.StringType)
    }
    return df.withColumns(blank) if blank else df


def _typed(field: T.StructField):
    text = F.when(F.trim(field.name) != "", F.col(field.name))
    return (text if isinstance(field.dataType, T.StringType) else F.trim(text).try_cast(field.dataType)).alias(
        field.name)


def read_series_csv(spark: SparkSession, path: str) -> DataFrame:
    """Series file with the columns date, id, value."""
    return read_csv(spark, path, SERIES_SCHEMA)


def read_regressors_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """External regressors: date, id and the named numeric columns."""
    schema = "date timestamp_ntz, id string, " + ", ".join(f"{n} double" for n in names)
    return read_csv(spark, path, schema)


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: list[str] | None = None) -> str:
    """Write parquet or CSV, in parallel; returns the path."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("nullValue", "NA").csv(path)
    else:
        writer.format(fmt).save(path)
    return path
