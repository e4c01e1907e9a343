"""Problem 9: mixing sources to target shares of the total size.

Entropy balancing: of all document rates in [0, max_repeats] that give each source its token target, those closest to 1 in
relative entropy are exponentially tilted, rate = min(max_repeats, exp(lambda * tokens)). Lambda solves a convex dual by
Newton steps, each one aggregation over the size distribution with the sources' states joined to it; a bracket keeps every
step safe. A source whose dual has no solution, since even the upper end of its bracket stays below the target, is
exhausted: it is used up and reported. Rates become copies by systematic sampling along the cumulated rates of a source's
documents in order of size, so that not only the expected but the actual tokens are near the target.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written
from .tokens import with_tokens

#: Documents of one source and size that are ordered in one task; more are ordered in further bins.
BIN = 50_000


@dataclass
class Mix:
    sizes: DataFrame  # (doc_id, source, n_tokens)
    shape: DataFrame  # (source, n_tokens, docs)
    report: DataFrame  # one row per source of the weights


def _weights(weights: DataFrame) -> DataFrame:
    """One row per source; a repeated source keeps its largest share and cap."""
    return weights.where("source IS NOT NULL").groupBy("source").agg(F.coalesce(F.max("target_share"), F.lit(0.0)).cast("double").alias("target_share"), F.max(F.greatest("max_repeats", F.lit(0))).cast("int").alias("max_repeats"))


def _rate(lam: str = "lam", cap: str = "max_repeats"):
    return F.least(F.exp(F.least(F.col(lam) * F.col("n_tokens"), F.lit(50.0))), F.col(cap).cast("double"))


def balance(documents: DataFrame, weights: DataFrame, fraction: float = 0.5, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", rounds: int = 60, tolerance: float = 1e-6) -> Mix:
    """The operator. The mix has `fraction` of the size of all documents of the named sources.

    report: (source, target_share, max_repeats, size, target_tokens, reachable_tokens, exhausted, converged, rounds, lam);
    `converged` says whether the expected tokens reached the target within `tolerance` (exhausted and empty sources have
    nothing to solve). Documents with a NULL source or one that is not named take no part; NULL and empty texts have no
    size; a source without documents is reported as exhausted; repeated rows of a document count as often as they stand."""
    w = _weights(weights)
    # the weights are a small table, which the optimizer broadcasts by its size; a large one is joined by shuffle of (doc_id, source, n_tokens) only
    counted = with_tokens(documents.where("source IS NOT NULL").select(F.col(doc_id).alias("doc_id"), "source", F.col(text).alias("text")), ("doc_id", "source"), "text", tokenizer)
    sizes = written(counted.join(w.select("source"), "source", "left_semi").select("doc_id", "source", "n_tokens"), "sizes")
    shape = written(sizes.groupBy("source", "n_tokens").agg(F.count("*").cast("double").alias("docs")), "shape")
    stats = shape.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("docs")).alias("size"), F.sum("docs").alias("docs"))
    base = w.join(stats, "source", "left").na.fill(0.0, ["size", "docs"])
    budget = base.agg((F.sum("size") * F.lit(fraction)).alias("budget"))
    scale = F.when(F.col("size") > 0, F.try_divide("size", "docs")).otherwise(1.0)
    # x is lambda times the mean size; the first round is at the upper end of the bracket
    state = written(
        base.crossJoin(F.broadcast(budget)).select(  # one row
            "source", "target_share", "max_repeats", "size", (F.col("target_share") * F.coalesce("budget", F.lit(0.0))).alias("target"), scale.alias("scale"),
            F.lit(60.0).alias("x"), F.lit(-60.0).alias("lo"), F.lit(60.0).alias("hi"), F.lit(0.0).alias("reached"), F.lit(False).alias("exhausted"), F.lit(False).alias("converged"), F.lit(0).alias("rounds"), (F.col("target_share") > 0).alias("live"),
        ), "state",
    )
    for k in range(rounds + 1):
        tilt = F.exp(F.least(F.col("x") / F.col("scale") * F.col("n_tokens"), F.lit(50.0)))
        rate = F.least(tilt, F.col("max_repeats").cast("double")) if k else F.col("max_repeats").cast("double")
        step = shape.join(state.where("live"), "source").groupBy("source").agg(
            F.sum(rate * F.col("n_tokens") * F.col("docs")).alias("g"), F.sum(F.when(tilt < F.col("max_repeats"), tilt * F.col("n_tokens") * F.col("n_tokens") * F.col("docs")).otherwise(0.0)).alias("h")
        )
        s = state.join(step, "source", "left").withColumn("g", F.when(F.col("live"), F.coalesce("g", F.lit(0.0))).otherwise(F.col("reached"))).withColumn("miss", F.col("g") - F.col("target"))
        if k == 0:
            s = s.withColumn("exhausted", F.col("live") & (F.col("g") < F.col("target"))).withColumn("lo1", F.col("lo")).withColumn("hi1", F.col("hi")).withColumn("next", F.lit(0.0))
            done = F.col("exhausted") | (F.col("g") == F.col("target"))
        else:
            s = s.withColumn("lo1", F.when(F.col("miss") <= 0, F.greatest("lo", "x")).otherwise(F.col("lo"))).withColumn("hi1", F.when(F.col("miss") > 0, F.least("hi", "x")).otherwise(F.col("hi")))
            newton = F.col("x") - F.try_divide(F.col("miss") * F.col("scale"), F.col("h"))
            s = s.withColumn("next", F.when((F.col("h") > 0) & (newton > F.col("lo1")) & (newton < F.col("hi1")), newton).otherwise((F.col("lo1") + F.col("hi1")) / 2))
            done = (F.abs("miss") <= tolerance * F.col("target")) | (F.col("hi1") - F.col("lo1") < 1e-13)
        s = s.withColumn("done", done)
        live = F.col("live")
        new = written(s.select(
            "source", "target_share", "max_repeats", "size", "target", "scale",
            F.when(live & ~F.col("done"), F.col("next")).otherwise(F.col("x")).alias("x"), F.when(live, F.col("lo1")).otherwise(F.col("lo")).alias("lo"), F.when(live, F.col("hi1")).otherwise(F.col("hi")).alias("hi"),
            F.col("g").alias("reached"), "exhausted", (F.col("converged") | live & F.col("done") & (F.abs("miss") <= tolerance * F.col("target"))).alias("converged"), F.when(live, F.lit(k)).otherwise(F.col("rounds")).alias("rounds"), (live & ~F.col("done")).alias("live"),
        ), "state")
        dropped(state)
        state = new
        if state.where("live").isEmpty():
            break
    full = F.col("size") * F.col("max_repeats")
    lam = F.when(F.col("target") <= 0, -1e6).when(F.col("exhausted") | (full <= F.col("target")), 1e6).otherwise(F.col("x") / F.col("scale"))
    report = state.select(
        "source", "target_share", "max_repeats", F.col("size").cast("bigint").alias("size"), F.col("target").alias("target_tokens"), F.least("target", full).alias("reachable_tokens"), "exhausted",
        (F.col("converged") | F.col("exhausted") | (F.col("target") <= 0)).alias("converged"), "rounds", lam.alias("lam"),
    )
    return Mix(sizes, shape, report)


def _places(mix: Mix, seed: int) -> DataFrame:
    """(source, n_tokens, rate, rate_used, before, shift, bins, max_repeats) of each size of a source: where its documents stand along the cumulated rates.

    A source's sizes are rounded in four levels, the largest documents with half of the tokens first; what their whole
    copies have too many or too few tokens goes to the rates of the levels that follow, so that the smallest documents
    bound the error."""
    lam = mix.report.select("source", "lam", "max_repeats", "reachable_tokens", (F.pmod(F.xxhash64(F.lit(seed), "source"), F.lit(1 << 20)) / F.lit(float(1 << 20))).alias("shift"))
    w = Window.partitionBy("source").orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)  # as many rows as a source has different sizes
    g = mix.shape.join(lam, "source").withColumn("rate", _rate()).withColumn("want", F.col("rate") * F.col("docs") * F.col("n_tokens"))
    part = F.coalesce(F.sum("want").over(w) / F.greatest(F.sum("want").over(Window.partitionBy("source")), F.lit(1e-9)), F.lit(0.0))
    g = written(g.withColumn("part", part).withColumn("level", F.when(F.col("part") < 0.5, 0).when(F.col("part") < 0.75, 1).when(F.col("part") < 0.875, 2).otherwise(3)).withColumn("bins", F.ceil(F.col("docs") / BIN).cast("int")), "groups")
    done = None
    for level in range(4):
        rest = g.where(f"level >= {level}")
        due = rest.groupBy("source").agg(F.sum("want").alias("want_left"), F.first("reachable_tokens").alias("target"))
        if done is not None:
            due = due.join(done.groupBy("source").agg(F.sum(F.col("got") * F.col("n_tokens")).alias("spent")), "source", "left")
        else:
            due = due.withColumn("spent", F.lit(0.0))
        due = due.select("source", F.coalesce(F.try_divide(F.col("target") - F.coalesce("spent", F.lit(0.0)), F.when(F.col("want_left") > 0, F.col("want_left"))), F.lit(1.0)).alias("factor"))
        x = rest.where(f"level = {level}").join(due, "source").withColumn("rate_used", F.least(F.col("rate") * F.greatest("factor", F.lit(0.0)), F.col("max_repeats").cast("double")))
        x = x.withColumn("before", F.coalesce(F.sum(F.col("rate_used") * F.col("docs")).over(w), F.lit(0.0)))
        place = lambda c: F.floor(F.round(c + F.col("shift"), 9))
        x = x.withColumn("got", (place(F.col("before") + F.col("rate_used") * F.col("docs")) - place(F.col("before"))).cast("double")).drop("factor")
        done = written(x if done is None else done.unionByName(x), "places")
    return done.select("source", "n_tokens", "rate", "rate_used", "before", "shift", "bins", "max_repeats")


def copies(mix: Mix, seed: int = 11) -> DataFrame:
    """(doc_id, source, n_tokens, rate, copies): every document of the named sources with its rate and its whole number of copies, at most max_repeats.

    Along a source's documents by size, equal sizes in the order of a hash, a document gets as many copies as whole
    numbers lie in its stretch of the cumulated rates, shifted by a fixed fraction."""
    r = mix.sizes.join(_places(mix, seed), ["source", "n_tokens"]).withColumn("h", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bin", F.pmod("h", "bins"))
    binned = r.groupBy("source", "n_tokens", "bin").agg(F.count("*").alias("m"))
    earlier = binned.withColumn("offset", F.coalesce(F.sum("m").over(Window.partitionBy("source", "n_tokens").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("source", "n_tokens", "bin", "offset")
    ranked = r.withColumn("k", F.row_number().over(Window.partitionBy("source", "n_tokens", "bin").orderBy("h", "doc_id")) - 1).join(earlier, ["source", "n_tokens", "bin"])
    place = lambda k: F.floor(F.round(F.col("before") + (F.col("offset") + k) * F.col("rate_used") + F.col("shift"), 9))
    n = F.least(place(F.col("k") + 1) - place(F.col("k")), F.col("max_repeats").cast("bigint"))
    return ranked.select("doc_id", "source", "n_tokens", "rate", n.cast("int").alias("copies"))


def shares(mix: Mix, seed: int = 11) -> DataFrame:
    """(source, target_share, actual_tokens, actual_share, exhausted, converged) of the mix that `copies` gives."""
    got = copies(mix, seed).groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("actual_tokens"))
    total = got.agg(F.sum("actual_tokens").alias("t"))
    return mix.report.join(got, "source", "left").crossJoin(F.broadcast(total)).select(  # one row
        "source", "target_share", F.coalesce("actual_tokens", F.lit(0)).alias("actual_tokens"), F.coalesce(F.col("actual_tokens") / F.greatest("t", F.lit(1)), F.lit(0.0)).alias("actual_share"), "exhausted", "converged"
    )
