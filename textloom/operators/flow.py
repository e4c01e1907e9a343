"""A per-message flow as guarded columns: each stage is a struct, computed only while the message is alive, and the audit log is a projection of the stages."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Stage:
    """A named stage: `ok` decides whether the message goes on, `detail` is logged, `needs` is a condition under which the stage runs at all."""

    name: str
    ok: Column
    detail: Column
    needs: Column | None = None


def run(df: DataFrame, stages: tuple[Stage, ...], done: str = "exported", failed: str = "safe_failure") -> DataFrame:
    """The rows with `steps` (an array of step, status, detail), `last_step` and `status`: a stage that fails ends the flow; the same columns work on a stream."""
    alive = F.lit(True)
    steps = []
    for s in stages:
        runs = alive if s.needs is None else alive & F.coalesce(s.needs, F.lit(False))
        ok = F.coalesce(s.ok, F.lit(False))
        steps.append(F.when(runs, F.struct(F.lit(s.name).alias("step"), F.when(ok, "ok").otherwise("failed").alias("status"), s.detail.cast("string").alias("detail"))))
        alive = alive & (~runs | ok)
    out = df.withColumn("steps", F.array_compact(F.array(*steps)))
    last = F.try_element_at("steps", F.lit(-1))
    return out.withColumn("last_step", last["step"]).withColumn("status", F.when(F.exists("steps", lambda x: x["status"] == "failed"), failed).otherwise(done))


def log(df: DataFrame, key: str) -> DataFrame:
    """(key, step_no, step, status, detail): the audit log of a run."""
    return df.select(key, F.posexplode("steps").alias("step_no", "s")).select(key, "step_no", "s.*")


def summary(df: DataFrame) -> DataFrame:
    """One row of rates: completion, average steps, share per status."""
    return df.agg(F.count("*").alias("cases"), F.round(F.avg((F.col("status") == "exported").cast("int")), 6).alias("completion"), F.round(F.avg(F.size("steps")), 6).alias("avg_steps"))
