"""Sinks: each writes in parallel, partition by partition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; arrays and structs become JSON text."""
    nested = [c for c, t in df.dtypes if t.startswith(("array", "struct", "map"))]
    df.withColumns({c: F.to_json(c) for c in nested}).write.mode(mode).csv(path, header=True, quote='"', escape='"')


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def parquet(df: DataFrame, path: str, mode: str = "overwrite", by: tuple[str, ...] = ()) -> None:
    w = df.write.mode(mode)
    (w.partitionBy(*by) if by else w).parquet(path)


def split_ids(splits: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One folder of id lines per split."""
    splits.select("split", F.col("id").cast("string").alias("value")).write.mode(mode).partitionBy("split").text(path)


def metric_rows(df: DataFrame) -> DataFrame:
    """A one-row metrics frame as (metric, value) rows, for any report."""
    return df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in df.columns])).alias("m")).select("m.*")


def metrics_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A one-row metrics frame, or a small table as a confusion matrix, as one file of JSON lines."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", "false").json(path)
