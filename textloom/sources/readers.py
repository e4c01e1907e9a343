"""Readers with explicit schemas: no inference, nothing collected."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REVIEW_SCHEMA = "text_id BIGINT, text STRING, sentences STRING, label STRING"
CONLLU_TOKEN = "STRUCT<id: INT, form: STRING, lemma: STRING, upos: STRING, xpos: STRING, feats_str: STRING, head: INT, deprel: STRING, misc: STRING>"


def first_existing(candidates: Iterable[str]) -> str:
    """The first candidate path that exists; FileNotFoundError names them all otherwise."""
    tried = list(candidates)
    for p in tried:
        if os.path.exists(p.removeprefix("file://")):
            return p
    raise FileNotFoundError("none of these exists: " + ", ".join(tried))


def parquet(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def csv(spark: SparkSession, path: str, schema: str = REVIEW_SCHEMA) -> DataFrame:
    """CSV with a header, quoted line breaks and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with an explicit schema; blank lines are skipped, broken lines give NULLs."""
    return spark.read.schema(schema).json(path)


def coalesced(df: DataFrame, text: tuple[str, ...] = ("text", "content", "review", "comment"), ids: tuple[str, ...] = ("text_id", "id")) -> DataFrame:
    """(text_id, text, rest...): the first candidate column that is not NULL or empty; rows without text are dropped."""
    have = [c for c in text if c in df.columns]
    keys = [c for c in ids if c in df.columns]
    if not have or not keys:
        raise ValueError(f"no column among {text} or {ids}")
    pick = lambda cols: F.coalesce(*[F.nullif(F.col(c).cast("string"), F.lit("")) for c in cols])
    rest = [c for c in df.columns if c not in (*text, *ids)]
    return df.select(pick(keys).cast("bigint").alias("text_id"), pick(have).alias("text"), *rest).where("text IS NOT NULL")


def lines(spark: SparkSession, path: str, column: str = "value", kind: str = "string") -> DataFrame:
    """One trimmed value per line that is not blank."""
    v = F.trim("value")
    return spark.read.text(path).where(v != "").select(v.cast(kind).alias(column))


def union_available(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of frames whose columns may differ; missing ones are NULL."""
    out = None
    for f in frames:
        out = f if out is None else out.unionByName(f, allowMissingColumns=True)
    if out is None:
        raise ValueError("nothing to union")
    return out


def conllu(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(split, sentence_id, text, tokens): one row per sentence block; multi-word ranges and empty nodes are left out, `_` means none for lemma, xpos and deprel and X for upos."""
    raw = spark.read.option("lineSep", "\n\n").text(path).where(F.trim("value") != "")
    ls = F.split("value", "\n")
    fields = F.transform(F.filter(ls, lambda x: x.rlike(r"^\d+\t")), lambda x: F.split(x, "\t"))
    none = lambda c: F.when((c == "_") | (c == ""), None).otherwise(c)
    tokens = F.transform(
        fields,
        lambda f: F.struct(
            F.try_element_at(f, F.lit(1)).cast("int").alias("id"), F.try_element_at(f, F.lit(2)).alias("form"), F.coalesce(none(F.try_element_at(f, F.lit(3))), F.lit("_")).alias("lemma"),
            F.coalesce(none(F.try_element_at(f, F.lit(4))), F.lit("X")).alias("upos"), F.coalesce(none(F.try_element_at(f, F.lit(5))), F.lit("_")).alias("xpos"),
            F.coalesce(none(F.try_element_at(f, F.lit(6))), F.lit("_")).alias("feats_str"), F.try_element_at(f, F.lit(7)).try_cast("int").alias("head"),
            F.coalesce(none(F.try_element_at(f, F.lit(8))), F.lit("_")).alias("deprel"), none(F.try_element_at(f, F.lit(10))).alias("misc"),
        ),
    )
    meta = lambda key: F.nullif(F.regexp_extract("value", rf"(?m)^# {key} = (.*)$", 1), F.lit(""))
    return raw.select(F.lit(split).alias("split"), meta("sent_id").alias("sentence_id"), meta("text").alias("text"), tokens.alias("tokens")).where(F.size("tokens") > 0)


def token_rows(sentences: DataFrame) -> DataFrame:
    """The flat token table of `conllu`."""
    return sentences.select("split", "sentence_id", F.inline("tokens")).select("split", "sentence_id", F.col("id").alias("token_id"), "form", "lemma", "upos", "xpos", F.col("feats_str").alias("feats"))
