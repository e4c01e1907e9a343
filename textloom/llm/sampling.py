"""Problem 2: a sample whose categories follow target shares.

Every id has a fixed random priority (a hash). One pass over the ids keeps per task and category a reservoir, the rows of
least priority, with the counts. Reservoirs merge by union: below the least bound of the merged ones, the least priority
a task let go, their rows are those of the whole table. After the final counts the quotas are made feasible together, and
each merged reservoir is trimmed to the quota's rows of least priority. A reservoir that turns out too small for its
quota is filled again with four times the room, so that the sample is always exact. Categories without rows enough are
reported, and so is each category's actual share.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Priority bins in which a merged reservoir is cut; only the bin at the cut is ordered.
BINS_LOG2 = 14
#: Target categories are held on the driver and in every task, one number each.
MAX_CATEGORIES = 100_000


def canonical_label(col):
    """Labels that differ only in letter case, outer or repeated blanks or blanks around the slash become one."""
    squeezed = F.trim(F.regexp_replace(F.lower(col), r"(?U)\s+", " "))
    return F.regexp_replace(squeezed, r" ?/ ?", " / ")


def feasible(wanted: list[float], minimum: list[float], available: list[int], size: float) -> list[int]:
    """Quotas near `wanted`, at least the minimum and at most what is available, that use up `size` where the rows allow.

    What exhausted categories leave goes to the others by one common factor, which keeps their shares relative to each
    other; minimums may exceed the size. Fractions are rounded by largest remainder, ties by order."""
    if not wanted:
        return []
    w, m, a = np.array(wanted, float), np.array(minimum, float), np.array(available, float)
    at = lambda x: np.minimum(a, np.maximum(m, x * w))
    factor = 1.0
    if at(1.0).sum() < size:
        pos = w > 0
        steps = np.unique(np.concatenate([[1.0], a[pos] / w[pos], m[pos] / w[pos]]))
        steps = steps[steps >= 1.0]
        factor = max(x for x in steps if at(x).sum() <= size)
        grows = pos & (m <= factor * w) & (factor * w < a)
        if grows.any():
            factor += (size - at(factor).sum()) / w[grows].sum()
    x = at(factor)
    q = np.floor(x + 1e-6)
    more = int(round(x.sum()) - q.sum())
    for i in sorted(range(len(x)), key=lambda i: (-round(x[i] - q[i], 6), i))[:max(0, more)]:
        q[i] += q[i] < a[i]
    return [int(v) for v in q]


def _targets(targets: DataFrame) -> list:
    rows = targets.where("label IS NOT NULL").groupBy(canonical_label(F.col("label")).alias("canon")).agg(
        F.min("label").alias("label"), F.coalesce(F.max("target_share"), F.lit(0.0)).cast("double").alias("share"), F.coalesce(F.max("min_rows"), F.lit(0)).cast("int").alias("least")
    ).orderBy("label").limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} target categories")
    return rows


_SCHEMA = "canon STRING, id {id}, priority BIGINT, n BIGINT, bound BIGINT"


def _reservoirs(ids: DataFrame, rows: list, fraction: float, room: dict[str, float]) -> DataFrame:
    """Of (id, canons, priority), one row per id: the reservoir rows (canon, id, priority), and per task a row (canon, n, bound) for each category with its ids and the least priority let go, NULL if none was; canon NULL counts all ids."""
    take = {r.canon: (r.share * fraction * room.get(r.canon, 1.5), room.get(r.canon, 1.5) * r.least + 64) for r in rows}
    kind = dict(ids.dtypes)["id"]

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = list(it)
        if not batches:
            return
        t = pa.Table.from_batches(batches)
        seen, at = t.num_rows, t.column("canons").combine_chunks()
        owner, canon = at.value_parent_indices().to_numpy(), at.flatten()
        names = canon.dictionary_encode()
        code = names.indices.to_numpy(zero_copy_only=False)
        prio = t.column("priority").to_numpy()[owner]
        own_ids = t.column("id").combine_chunks()
        schema = pa.schema([("canon", pa.string()), ("id", own_ids.type), ("priority", pa.int64()), ("n", pa.int64()), ("bound", pa.int64())])
        counts = [(None, seen, None)]
        for c, name in enumerate(names.dictionary.to_pylist()):
            if name not in take:
                continue
            mine = np.flatnonzero(code == c)
            rate, plus = take[name]
            size = int(rate * seen + 6 * (rate * seen) ** 0.5 + plus)
            o = mine[np.argsort(prio[mine], kind="stable")]
            kept = o[:size]
            counts.append((name, len(mine), int(prio[o[size]]) if len(o) > size else None))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(kept)), own_ids.take(pa.array(owner[kept])), pa.array(prio[kept]), pa.nulls(len(kept), pa.int64()), pa.nulls(len(kept), pa.int64())], schema=schema)
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in counts], pa.string()), pa.nulls(len(counts), own_ids.type), pa.nulls(len(counts), pa.int64()), pa.array([x[1] for x in counts], pa.int64()), pa.array([x[2] for x in counts], pa.int64())], schema=schema)

    return ids.mapInArrow(kernel, _SCHEMA.format(id=kind))


def stratified(labels: DataFrame, targets: DataFrame, fraction: float = 0.2, seed: int = 7, id_col: str = "text_id", label_col: str = "label", room: float = 1.5) -> tuple[DataFrame, DataFrame]:
    """The operator: (sample, report).

    sample (id, label): the ids drawn with their category as spelled in the targets; the sample size is `fraction` of all
    distinct ids with a label. report (label, canon, target_share, available, wanted, quota, actual_share, shortfall,
    exhausted), one row per target category: its distinct ids, the larger of its minimum and its share of the sample size,
    the ids drawn, their share of the sample, how many are missing, and whether the rows fall short of what is wanted.

    Ids repeated under one category count once, ids with several categories in each; NULL ids and labels take no part;
    a category without rows is exhausted; labels outside the targets only count toward the sample size."""
    spark = labels.sparkSession
    rows = _targets(targets)
    ids = labels.select(F.col(id_col).alias("id"), canonical_label(F.col(label_col)).alias("canon")).where("id IS NOT NULL AND canon IS NOT NULL")
    ids = ids.groupBy("id").agg(F.collect_set("canon").alias("canons")).withColumn("priority", F.xxhash64(F.lit(seed), "id"))
    rooms = {r.canon: room for r in rows}
    while True:
        held = written(_reservoirs(ids, rows, fraction, rooms), "reservoirs")
        state = {r.canon: r for r in held.where("n IS NOT NULL").groupBy("canon").agg(F.sum("n").alias("n"), F.min("bound").alias("bound")).collect()}
        size = fraction * (state[None].n if None in state else 0)
        available = [state[r.canon].n if r.canon in state else 0 for r in rows]
        wanted = [max(float(r.least), r.share * size) for r in rows]
        quota = feasible([r.share * size for r in rows], [float(r.least) for r in rows], available, size)
        report = [
            (r.label, r.canon, r.share, a, w, q, q / max(1, sum(quota)), max(0.0, w - q), a < w - 1e-9) for r, a, w, q in zip(rows, available, wanted, quota)
        ]
        out = spark.createDataFrame(report, "label STRING, canon STRING, target_share DOUBLE, available BIGINT, wanted DOUBLE, quota BIGINT, actual_share DOUBLE, shortfall DOUBLE, exhausted BOOLEAN")
        bounds = spark.createDataFrame([(r.canon, r.label, q, state[r.canon].bound if r.canon in state else None) for r, q in zip(rows, quota)], "canon STRING, label STRING, quota BIGINT, bound BIGINT")
        drawn = held.where("id IS NOT NULL").select("id", "canon", "priority", F.expr(f"CAST(shiftright(priority, {64 - BINS_LOG2}) AS INT)").alias("bin"))
        w = Window.partitionBy("canon").orderBy("bin")
        upto = drawn.groupBy("canon", "bin").agg(F.count("*").alias("n")).join(F.broadcast(bounds), "canon").withColumn("upto", F.sum("n").over(w))  # at most 2^14 bins of each of the checked categories
        cut = written(
            upto.where("upto - n < quota").groupBy("canon", "label", "quota", "bound").agg(F.max("bin").alias("cut"), F.sum(F.when(F.col("upto") <= F.col("quota"), F.col("n")).otherwise(0)).alias("below"), F.max("upto").alias("upto")), "cut"
        )
        # rows at or above a bound may be missing: the bins taken must end below it
        short = [r.canon for r in cut.where(f"bound IS NOT NULL AND (upto < quota OR cut >= shiftright(bound, {64 - BINS_LOG2}))").collect()]
        if not short:
            break
        for c in short:
            rooms[c] *= 4
        dropped(held, cut)
    taken = drawn.join(F.broadcast(cut), "canon").where("bin <= cut")
    whole = taken.where("bin < cut OR upto <= quota").select("id", "label")
    edge = taken.where("bin = cut AND upto > quota")
    kept = edge.withColumn("rank", F.row_number().over(Window.partitionBy("canon").orderBy("priority", "id"))).where("rank <= quota - below").select("id", "label")
    return whole.unionByName(kept), out


def sample(labels: DataFrame, targets: DataFrame, **more) -> DataFrame:
    """(id, label) of `stratified`."""
    return stratified(labels, targets, **more)[0]


def report(labels: DataFrame, targets: DataFrame, **more) -> DataFrame:
    """The report of `stratified`."""
    return stratified(labels, targets, **more)[1]
