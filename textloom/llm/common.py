"""Spark plumbing shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_TABLES: dict[str, set[str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir; one of our own only where it is unset, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    key = spark.sparkContext.applicationId
    return _OWN.setdefault(key, "file://" + tempfile.mkdtemp(prefix="textloom-"))


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table written once in the shared folder: cuts lineage, survives lost executors, and is read back with its partitions."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.__dict__["_table_path"] = path
    _TABLES.setdefault(spark.sparkContext.applicationId, set()).add(path)
    return out


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    _TABLES.get(spark.sparkContext.applicationId, set()).discard(path)


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of `written` that nothing will read again."""
    for t in tables:
        path = t.__dict__.get("_table_path")
        if path:
            _delete(t.sparkSession, path)


def release(spark: SparkSession) -> int:
    """Deletes every table this application wrote in the shared folder and still keeps for lazy results; to be called when the results have been stored. Returns how many."""
    left = list(_TABLES.get(spark.sparkContext.applicationId, ()))
    for path in left:
        _delete(spark, path)
    return len(left)


def partitions_for(spark: SparkSession, least: int = 1) -> int:
    """Partitions of an explicit exchange: the session's setting, which the cluster sizes to its input."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def tokenizer_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """A vocabulary file of a public tokenizer; TEXTLOOM_TOKENIZER or a parameter of the operators names another."""
    return os.environ.get("TEXTLOOM_TOKENIZER", f"/opt/tokenizers/{name}")
