"""Deterministic splits by hash order, and leakage checks between them.

Fractions must add up to 1. Ranks are exact counts without a global sort: rows are binned by their hash, the bins counted,
and only a row's own bin is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import below


def check(fractions: dict[str, float]) -> None:
    if not fractions or any(f < 0 for f in fractions.values()) or abs(sum(fractions.values()) - 1) > 1e-9:
        raise ValueError("fractions must be at least 0 and add up to 1")


def hash_key(id_col: str, seed: int) -> Column:
    return F.sha2(F.concat(F.col(id_col).cast("string"), F.lit(f"|{seed}")), 256)


def ranked(df: DataFrame, by: tuple[str, ...], id_col: str, seed: int) -> DataFrame:
    """`rank` (from 1, by hash) and `total` within each stratum; strata of any size, as only bins of 1/4096 are sorted."""
    x = df.withColumn("_h", hash_key(id_col, seed)).withColumn("_b", F.substring("_h", 1, 3))
    bins = x.groupBy(*by, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by)
    at = bins.withColumn("_before", F.sum("_n").over(w.orderBy("_b")) - F.col("_n")).withColumn("total", F.sum("_n").over(w)).drop("_n")
    r = F.row_number().over(Window.partitionBy(*by, "_b").orderBy("_h", id_col))
    joined = x.withColumn("_r", r).alias("x").join(at.alias("a"), [F.col(f"x.{k}").eqNullSafe(F.col(f"a.{k}")) for k in by] + [F.col("x._b") == F.col("a._b")])
    return joined.select("x.*", (F.col("a._before") + F.col("x._r")).alias("rank"), F.col("a.total").alias("total")).drop("_h", "_b", "_r")


def _assign(rank: Column, total: Column, fractions: dict[str, float]) -> Column:
    upto, out = 0.0, None
    names = list(fractions)
    for name in names[:-1]:
        upto += fractions[name]
        cond = rank <= F.round(total * F.lit(round(upto, 9)))
        out = F.when(cond, name) if out is None else out.when(cond, name)
    return out.otherwise(names[-1]) if out is not None else F.lit(names[-1])


def stratified(df: DataFrame, label: str, fractions: dict[str, float], id_col: str = "text_id", seed: int = 42) -> DataFrame:
    """(id, label, split): every label is cut at the cumulative fractions of its own rows."""
    check(fractions)
    if label not in df.columns or id_col not in df.columns:
        raise ValueError(f"columns {id_col} and {label} are needed")
    r = ranked(df.select(id_col, label), (label,), id_col, seed)
    return r.select(F.col(id_col).alias("id"), label, _assign(F.col("rank"), F.col("total"), fractions).alias("split"))


def grouped(df: DataFrame, group: str, fractions: dict[str, float], id_col: str = "text_id", seed: int = 42) -> DataFrame:
    """(id, group, split): whole groups go to one split; fractions are of groups."""
    check(fractions)
    if group not in df.columns:
        raise ValueError(f"column {group} is needed")
    g = df.select(group).where(F.col(group).isNotNull()).distinct().withColumn("_all", F.lit(1))
    assigned = ranked(g, ("_all",), group, seed).select(group, _assign(F.col("rank"), F.col("total"), fractions).alias("split"))
    return df.select(F.col(id_col).alias("id"), group).join(assigned, group)


def _nonempty(n: int, fractions: dict[str, float]) -> None:
    """Raises if a part with a fraction would have none of n rows."""
    upto, before = 0.0, 0
    for i, (name, f) in enumerate(fractions.items()):
        upto += f
        end = n if i == len(fractions) - 1 else int(n * round(upto, 9) + 0.5)
        if f > 0 and end <= before:
            raise ValueError(f"the part {name} of {n} rows is empty")
        before = end


def by_time(df: DataFrame, time: str, fractions: dict[str, float], id_col: str = "event_id", bins: int = 1_024) -> DataFrame:
    """(id, time, split): the oldest rows first, ties by id; rows without a time are left out, and a part without rows is an error.

    Times are cut into ranges whose totals are carried; a time that is itself a cut, as one that many rows share is, has
    ranges of its own, by id where ids are numbers. Only a range is ordered in one task."""
    check(fractions)
    x = df.select(F.col(id_col).alias("id"), F.col(time).alias("time")).where("time IS NOT NULL")
    number = dict(x.dtypes)["id"] in ("bigint", "int", "smallint", "tinyint")
    places = [i / bins for i in range(1, bins)]
    t = F.unix_micros(F.col("time").cast("timestamp"))
    cuts = x.select(t.alias("t"), (F.col("id") if number else F.lit(0)).alias("i")).agg(F.percentile_approx("t", places, 10_000).alias("tc"), F.percentile_approx("i", places, 10_000).alias("ic"), F.count("*").alias("total")).first()  # fixed numbers
    r = x.withColumn("b1", below(t, cuts.tc)).withColumn("b2", below(t, cuts.tc, True)).withColumn("total", F.lit(cuts.total))
    r = r.withColumn("b3", F.when(F.col("b1") < F.col("b2"), below(F.col("id"), cuts.ic)).otherwise(0) if number else F.lit(0))
    key = ["b1", "b2", "b3"]
    counted = r.groupBy(*key).agg(F.count("*").alias("n"))
    n = counted.agg(F.sum("n")).first()[0] or 0
    _nonempty(n, fractions)
    at = counted.select(*key, (F.sum("n").over(Window.orderBy(*key)) - F.col("n")).alias("before"))  # a row per range
    ranked_ = r.withColumn("r", F.row_number().over(Window.partitionBy(*key).orderBy("time", "id"))).join(F.broadcast(at), key)
    return ranked_.select("id", "time", _assign(F.col("before") + F.col("r"), F.col("total"), fractions).alias("split"))


def sample(df: DataFrame, n: int, id_col: str = "text_id", seed: int = 42) -> DataFrame:
    """A seeded sample of n rows: those first in hash order."""
    return df.withColumn("_h", hash_key(id_col, seed)).orderBy("_h", id_col).limit(n).drop("_h")


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """(only_a, only_b): rows of one table that the other lacks, repeats counted; two equal runs give 0 and 0."""
    x = a.exceptAll(b).agg(F.count("*").alias("only_a"))
    return x.crossJoin(b.select(a.columns).exceptAll(a).agg(F.count("*").alias("only_b")))  # one row each


def stratified_sample(df: DataFrame, label: str, n: int, id_col: str = "text_id", seed: int = 42) -> DataFrame:
    """At most n rows per label, those first in hash order."""
    return ranked(df, (label,), id_col, seed).where(F.col("rank") <= n).drop("rank", "total")


def exact_leaks(df: DataFrame, value: Column, split: str) -> DataFrame:
    """(split_a, split_b, n): distinct values that occur in both splits, for each pair of splits."""
    sets = df.where(value.isNotNull()).groupBy(value.alias("v")).agg(F.array_sort(F.collect_set(split)).alias("s")).where(F.size("s") > 1)
    return sets.select(F.explode(F.expr("flatten(transform(s, (a, i) -> transform(slice(s, i + 2, size(s)), b -> struct(a AS split_a, b AS split_b))))")).alias("p")).groupBy("p.split_a", "p.split_b").agg(F.count("*").alias("n"))


def template_leaks(df: DataFrame, text: str, labels: tuple[str, ...], metadata: str = r"(?iU)\b(label|class|split|категорія|мітка)\s*[:=]") -> DataFrame:
    """Rows whose text holds a label's own words or looks like metadata."""
    low = F.lower(F.col(text))
    return df.where(F.col(text).rlike(metadata) | F.exists(F.array(*[F.lit(x.lower()) for x in labels]), lambda k: low.contains(k)))


def leakage_report(rows: DataFrame, near: DataFrame, times: DataFrame, labels: tuple[str, ...], text: str = "text", group: str = "source", split: str = "split") -> DataFrame:
    """(kind, split_a, split_b, n): every check in one table. Repeated rows count once. `near` has (split_a, split_b), a row per pair of near-duplicates; `times` (split, time); kind time is 1 where a later split begins before an earlier one ends."""
    two = lambda df, kind: df.select(F.lit(kind).alias("kind"), "split_a", "split_b", F.col("n").cast("bigint").alias("n"))
    template = template_leaks(rows, text, labels).distinct().groupBy(split).agg(F.count("*").alias("n")).select(F.lit("template").alias("kind"), F.col(split).alias("split_a"), F.col(split).alias("split_b"), "n")
    ends = times.groupBy("split").agg(F.min("time").alias("lo"), F.max("time").alias("hi"))
    b = ends.select(F.col("split").alias("split_b"), F.col("lo").alias("lo_b"))
    order = F.col("split_a").isin("train") & F.col("split_b").isin("val", "test")
    late = ends.select(F.col("split").alias("split_a"), F.col("hi").alias("hi_a")).crossJoin(F.broadcast(b)).where(order).select(F.lit("time").alias("kind"), "split_a", "split_b", (F.col("hi_a") > F.col("lo_b")).cast("bigint").alias("n"))  # a row per split
    return two(exact_leaks(rows, F.col(text), split), "exact").unionByName(two(exact_leaks(rows, F.col(group), split), "group")).unionByName(template).unionByName(two(near.groupBy("split_a", "split_b").agg(F.count("*").alias("n")), "near")).unionByName(late)
