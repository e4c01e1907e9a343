"""Evaluation from (id, gold, pred, score) tables: confusion, precision and recall, curves, span and field comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stats import below


def confusion(df: DataFrame, gold: str = "gold", pred: str = "pred", most: int = 2_000) -> DataFrame:
    """(gold, pred, n) for every pair of labels that occur, absent pairs as 0."""
    c = df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(gold).alias("gold"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    labels = c.select(F.col("gold").alias("l")).union(c.select("pred")).distinct()
    n = labels.count()
    if n > most:
        raise ValueError(f"a grid of {n} labels; at most {most} are a classifier's")
    grid = labels.select(F.col("l").alias("gold")).crossJoin(F.broadcast(labels.select(F.col("l").alias("pred"))))  # size checked
    return grid.join(c, ["gold", "pred"], "left").select("gold", "pred", F.coalesce("n", F.lit(0)).alias("n"))


def report(df: DataFrame, gold: str = "gold", pred: str = "pred") -> DataFrame:
    """(label, precision, recall, f1, support) per label, zero divisions as 0, and the rows `macro`, `weighted` and `accuracy`."""
    c = df.where(F.col(gold).isNotNull() & F.col(pred).isNotNull()).groupBy(F.col(gold).alias("g"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))
    both = c.select(F.explode(F.array(F.struct(F.col("g").alias("label"), F.lit(1).alias("is_gold")), F.struct(F.col("p").alias("label"), F.lit(0).alias("is_gold")))).alias("s"), "g", "p", "n").select("s.*", "g", "p", "n")
    per = both.groupBy("label").agg(
        F.sum(F.when((F.col("is_gold") == 1) & (F.col("g") == F.col("p")), F.col("n")).otherwise(0)).alias("tp"), F.sum(F.when(F.col("is_gold") == 1, F.col("n")).otherwise(0)).alias("support"), F.sum(F.when(F.col("is_gold") == 0, F.col("n")).otherwise(0)).alias("predicted")
    )
    z = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    f = per.select("label", z("tp", "predicted").alias("precision"), z("tp", "support").alias("recall"), "support", "tp").withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
    r = lambda c_: F.round(c_, 6)
    tot = f.agg(F.sum("support").alias("s"), *[F.avg(m).alias(f"m_{m}") for m in ("precision", "recall", "f1")], *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"w_{m}") for m in ("precision", "recall", "f1")], (F.sum("tp") / F.sum("support")).alias("acc"))
    rows = tot.select(F.explode(F.array(
        F.struct(F.lit("macro").alias("label"), F.col("m_precision").alias("precision"), F.col("m_recall").alias("recall"), F.col("m_f1").alias("f1"), F.col("s").alias("support")),
        F.struct(F.lit("weighted").alias("label"), F.col("w_precision").alias("precision"), F.col("w_recall").alias("recall"), F.col("w_f1").alias("f1"), F.col("s").alias("support")),
        F.struct(F.lit("accuracy").alias("label"), F.col("acc").alias("precision"), F.col("acc").alias("recall"), F.col("acc").alias("f1"), F.col("s").alias("support")),
    )).alias("r")).select("r.*")
    return f.select("label", "precision", "recall", "f1", "support").unionByName(rows).select("label", r(F.col("precision")).alias("precision"), r(F.col("recall")).alias("recall"), r(F.col("f1")).alias("f1"), "support")


def _running(df: DataFrame, score: str, y: str, bins: int = 1_024) -> DataFrame:
    """(threshold, pos, tp, k, p): per distinct score its positives, positives and rows at or above it, and all positives. Scores are pre-aggregated and cut into ranges; only a range is ordered in one task, and the ranges' totals are carried."""
    g = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("threshold")).agg(F.sum(y).alias("pos"), F.count("*").alias("n"))
    cuts = g.agg(F.percentile_approx("threshold", [i / bins for i in range(1, bins)], 10_000).alias("cuts")).first().cuts or []  # a fixed number
    x = g.withColumn("bin", len(cuts) - below(F.col("threshold"), cuts, True))
    w = Window.partitionBy("bin").orderBy(F.desc("threshold"))
    totals = x.groupBy("bin").agg(F.sum("pos").alias("bp"), F.sum("n").alias("bn"))
    carried = totals.select("bin", (F.sum("bp").over(Window.orderBy("bin")) - F.col("bp")).alias("ap"), (F.sum("bn").over(Window.orderBy("bin")) - F.col("bn")).alias("an"), F.sum("bp").over(Window.partitionBy()).alias("p"))  # a row per range
    return x.join(F.broadcast(carried), "bin").select("threshold", "pos", (F.col("ap") + F.sum("pos").over(w)).alias("tp"), (F.col("an") + F.sum("n").over(w)).alias("k"), "p")


def pr_curve(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """(threshold, tp, fp, precision, recall): one point per distinct score, ties share it."""
    c = _running(df, score, y)
    return c.select("threshold", "tp", (F.col("k") - F.col("tp")).alias("fp"), F.round(F.col("tp") / F.col("k"), 6).alias("precision"), F.round(F.coalesce(F.try_divide("tp", "p"), F.lit(0.0)), 6).alias("recall"))


def average_precision(df: DataFrame, score: str = "score", y: str = "y") -> DataFrame:
    """Sum over the curve of recall gained times precision; NULL without positives."""
    return _running(df, score, y).agg(F.round(F.sum(F.try_divide("pos", "p") * F.col("tp") / F.col("k")), 6).alias("average_precision"))


def class_score(raw: Column, index: Column, classes: int) -> Column:
    """The score of the class with an index from 0 in an array of one-vs-rest scores; with two classes one score serves both, with the other sign for the first."""
    if classes == 2:
        return F.when(index == 1, raw[0]).otherwise(-raw[0])
    return F.try_element_at(raw, (index + 1).cast("int"))


def threshold_sweep(df: DataFrame, thresholds: tuple[float, ...], score: str = "score", y: str = "y") -> DataFrame:
    """(threshold, predicted_positive, precision, recall, f1) per candidate threshold, in one pass with one conditional sum each."""
    aggs = [F.sum(y).alias("p")]
    for i, t in enumerate(thresholds):
        hit = F.col(score) >= F.lit(t)
        aggs += [F.sum(hit.cast("int")).alias(f"k{i}"), F.sum(F.when(hit, F.col(y)).otherwise(0)).alias(f"t{i}")]
    a = df.agg(*aggs)
    rows = a.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"k{i}").alias("predicted_positive"), F.col(f"t{i}").alias("tp"), F.col("p")) for i, t in enumerate(thresholds)])).alias("r")).select("r.*")
    z = lambda x, d: F.coalesce(F.try_divide(x, d), F.lit(0.0))
    q = rows.withColumn("precision", z(F.col("tp"), F.col("predicted_positive"))).withColumn("recall", z(F.col("tp"), F.col("p")))
    return q.select("threshold", "predicted_positive", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round(z(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), 6).alias("f1"))


def field_matches(gold: Column, pred: Column, fields: tuple[str, ...], unordered: tuple[str, ...] = ()) -> Column:
    """ARRAY<STRING> of the fields on which two structs differ; NULL equals NULL, the `unordered` fields are lists compared without order."""
    def same(f: str) -> Column:
        a, b = gold[f], pred[f]
        return F.array_sort(a).eqNullSafe(F.array_sort(b)) if f in unordered else a.eqNullSafe(b)

    return F.array_compact(F.array(*[F.when(~same(f), F.lit(f)) for f in fields]))


def rating(misses: Column, fields: int, partly: int = 4) -> Column:
    """correct, partly (at least `partly` fields match) or wrong."""
    hit = F.lit(fields) - F.size(misses)
    return F.when(hit == fields, "correct").when(hit >= partly, "partly").otherwise("wrong")


def span_comparison(gold: DataFrame, pred: DataFrame, doc: str = "doc") -> DataFrame:
    """(doc, category, gold and predicted span): exact, type (same span), boundary (overlap, same label), overlap, missed and false_positive.

    A predicted span that overlaps gold is no false positive; of several overlapping predictions the first counts. Duplicate spans count once."""
    g = gold.select(doc, "start_char", "end_char", "label").distinct()
    p = pred.select(doc, F.col("start_char").alias("ps"), F.col("end_char").alias("pe"), F.col("label").alias("pl")).distinct()
    cross = F.col("ps").isNotNull() & (F.greatest("start_char", "ps") < F.least("end_char", "pe"))  # greatest and least skip NULLs
    j = g.join(p, [doc], "left").withColumn("hit", cross)
    rank = F.when((F.col("start_char") == F.col("ps")) & (F.col("end_char") == F.col("pe")), F.when(F.col("label") == F.col("pl"), 0).otherwise(1)).when(F.col("hit"), F.when(F.col("label") == F.col("pl"), 2).otherwise(3))
    best = j.groupBy(doc, "start_char", "end_char", "label").agg(F.min(F.when(F.col("hit"), F.struct(rank.alias("r"), "ps", "pe", "pl"))).alias("b"))
    r = F.col("b.r")
    category = F.when(F.col("b").isNull(), "missed").when(r == 0, "exact").when(r == 1, "type").when(r == 2, "boundary").otherwise("overlap")
    out = best.select(doc, category.alias("category"), "start_char", "end_char", "label", F.col("b.ps").alias("pred_start"), F.col("b.pe").alias("pred_end"), F.col("b.pl").alias("pred_label"))
    fp = p.join(g, [p[doc] == g[doc], F.greatest(g["start_char"], p["ps"]) < F.least(g["end_char"], p["pe"])], "left_anti")
    return out.unionByName(fp.select(doc, F.lit("false_positive").alias("category"), *[F.lit(None).cast(t).alias(n) for n, t in (("start_char", "int"), ("end_char", "int"), ("label", "string"))], F.col("ps").alias("pred_start"), F.col("pe").alias("pred_end"), F.col("pl").alias("pred_label")))
