"""Aggregations over corpora and predictions (audits, distributions, counts)."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def value_counts(df: DataFrame, by: str) -> DataFrame:
    """(by, n, share): counts and their share of all rows, NULL as a value of its own."""
    g = df.groupBy(by).agg(F.count("*").alias("n"))
    total = g.agg(F.sum("n").alias("total"))
    return g.crossJoin(F.broadcast(total)).select(by, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # one row


def describe(df: DataFrame, value: Column, by: tuple[str, ...] = ()) -> DataFrame:
    """count, mean, sample standard deviation, minimum, quartiles, 5th and 95th percentile, maximum; percentiles interpolate linearly."""
    x = df.select(*by, value.cast("double").alias("x"))
    q = F.percentile("x", F.array(*[F.lit(p) for p in (0.05, 0.25, 0.5, 0.75, 0.95)]))
    a = x.groupBy(*by).agg(F.count("x").alias("n"), F.round(F.avg("x"), 6).alias("mean"), F.round(F.stddev_samp("x"), 6).alias("std"), F.min("x").alias("min"), q.alias("q"), F.max("x").alias("max"))
    return a.select(*by, "n", "mean", "std", "min", *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))], "max")


def duplicate_share(df: DataFrame, value: Column) -> DataFrame:
    """(rows, in_duplicate_groups, share): rows whose value occurs more than once, all members counted; pre-aggregated, so a hot value is no hot task."""
    g = df.groupBy(F.xxhash64(value).alias("h"), value.alias("v")).agg(F.count("*").alias("n"))
    return g.agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("in_duplicate_groups")).select("*", F.round(F.col("in_duplicate_groups") / F.col("rows"), 6).alias("share"))


def top(df: DataFrame, by: str, n: int) -> DataFrame:
    """The n most frequent values, ties by value."""
    return df.where(F.col(by).isNotNull()).groupBy(by).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.asc(by)).limit(n)


def majority(df: DataFrame, key: str, label: str, order: str) -> DataFrame:
    """(key, label, n): the most frequent label of each key, ties to the label seen first in `order`."""
    g = df.groupBy(key, label).agg(F.count("*").alias("n"), F.min(order).alias("first"))
    return g.groupBy(key).agg(F.max_by(F.struct(label, "n"), F.struct("n", -F.col("first"))).alias("b")).select(key, f"b.{label}", "b.n")


def exact_match_share(df: DataFrame, key: str, gold: str, pred: str) -> DataFrame:
    """Share of sequences whose labels all agree; two sequences of one length are equal if each place is, so no sequence is collected."""
    s = df.groupBy(key).agg(F.min((F.col(gold).eqNullSafe(F.col(pred))).cast("int")).alias("ok"))
    return s.agg(F.count("*").alias("sequences"), F.round(F.avg("ok"), 6).alias("exact_match"))


def below(value: Column, cuts: list, equal: bool = False) -> Column:
    """How many of some sorted cuts are less than a value (`equal`: or equal to it), by binary search in Arrow batches; no cuts give 0."""
    at, side = np.array(cuts or [], dtype=np.float64 if any(isinstance(c, float) for c in cuts or []) else np.int64), "right" if equal else "left"

    def search(v: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(at, v.to_numpy(), side=side).astype(np.int32))

    return F.pandas_udf(search, "int")(value)
