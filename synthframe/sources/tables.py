"""Reading and writing tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

INDEX_COLUMN = "Unnamed: 0"  # fixed value: header some tools give an exported row index


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None,
             drop_index: bool = False) -> DataFrame:
    """CSV with a header.  Give a schema to save the extra inference pass."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(path)
    if drop_index:  # exported as an unnamed first column, which Spark calls _c0
        df = df.drop(INDEX_COLUMN, "_c0")
    return df


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet; filters and column pruning reach the scan."""
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """S3: CSV with a header, one file per partition, no index column."""
    df.write.mode(mode).option("header", True).csv(path)


def write_table(df: DataFrame, path: str, mode: str = "error") -> None:
    """S3: Parquet."""
    df.write.mode(mode).parquet(path)
