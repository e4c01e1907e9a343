"""Evaluation of structured answers and of runs that produced them: comparisons per case, and one row of rates per set of runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _empty(x: Column, is_list: bool) -> Column:
    return x.isNull() | (F.size(x) == 0) if is_list else x.isNull()


def canonical(x: Column) -> Column:
    """A list in its sorted form, so that order does not matter; NULL stays NULL."""
    return F.array_sort(x)


def same(gold: Column, pred: Column, is_list: bool = False) -> Column:
    """Whether two field values are equal; NULL equals NULL, lists are compared without order."""
    return canonical(gold).eqNullSafe(canonical(pred)) if is_list else gold.eqNullSafe(pred)


def compare(gold: Column, pred: Column, fields: tuple[str, ...], lists: tuple[str, ...] = ()) -> Column:
    """struct(semantic_ok, hallucinated, missing_required, issues) of a predicted object against the expected one.

    An issue is `field: hallucinated` where a scalar or NULL is expected to be empty and is not, else `field: mismatch`;
    a missing list is an empty one where a list is expected. A NULL object is `invalid JSON`."""
    issues, missing = [], []
    for f in fields:
        g, p, is_list = gold[f], pred[f], f in lists
        if is_list:
            equal = F.when(g.isNull(), p.isNull()).otherwise(canonical(F.coalesce(p, F.array().cast("array<string>"))) == canonical(g.cast("array<string>"))) if f != "amounts_uah" else F.when(g.isNull(), p.isNull()).otherwise(canonical(F.coalesce(p, F.array().cast("array<double>"))) == canonical(g))
            invented = g.isNull() & ~_empty(p, True)
        else:
            equal = g.eqNullSafe(p)
            invented = g.isNull() & p.isNotNull() & (p.cast("string") != "")
        issues.append(F.when(~equal, F.when(invented, F.lit(f"{f}: hallucinated")).otherwise(F.lit(f"{f}: mismatch"))))
        missing.append(_empty(p, is_list) & ~_empty(g, is_list))
    found = F.when(pred.isNull(), F.array(F.lit("invalid JSON"))).otherwise(F.array_compact(F.array(*issues)))
    return F.struct(
        (F.size(found) == 0).alias("semantic_ok"), (pred.isNull() | F.exists(found, lambda x: x.contains("hallucinated"))).alias("hallucinated"),
        (pred.isNull() | reduce(lambda a, b: a | b, missing)).alias("missing_required"), found.alias("issues"),
    )


def assess(gold: Column, pred: Column, fields: tuple[str, ...], lists: tuple[str, ...] = (), normalised: tuple[str, ...] = ("document_type",)) -> Column:
    """struct(field_matches, field_total, issues): matching fields, and an issue class for each other one: invented values, another wording of a `normalised` field, or an extraction error."""
    hits, issues = [], []
    for f in fields:
        g, p, is_list = gold[f], pred[f], f in lists
        ok = same(g, p, is_list)
        filled = ~_empty(p, is_list) & (F.lit(True) if is_list else p.cast("string") != "")
        other = F.when(_empty(g, is_list) & filled, "hallucinated_field/value")
        if f in normalised:
            other = other.when(~_empty(g, is_list) & (g.cast("string") != "") & filled, "normalization_issue")
        hits.append(ok.cast("int"))
        issues.append(F.when(~ok, other.otherwise("semantic_extraction_error")))
    n = reduce(lambda a, b: a + b, hits)
    return F.struct(
        F.when(pred.isNull(), 0).otherwise(n).alias("field_matches"), F.when(pred.isNull(), 0).otherwise(len(fields)).alias("field_total"),
        F.when(pred.isNull(), F.array(F.lit("not_json_at_all"))).otherwise(F.array_compact(F.array(*issues))).alias("issues"),
    )


def catalogue(rules: tuple[tuple[Column, str], ...], default: str = "ok") -> Column:
    """ARRAY<STRING> of the names of all rules that hold, in order; [default] if none does."""
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(name)) for cond, name in rules]))
    return F.when(F.size(found) == 0, F.array(F.lit(default))).otherwise(found)


def share(cond: Column) -> Column:
    return F.avg(cond.cast("int"))


def share_among(cond: Column, among: Column, default: float) -> Column:
    """Share of the rows of `among` that also hold `cond`; the default where there is none."""
    return F.coalesce(F.try_divide(F.sum((cond & among).cast("int")), F.sum(among.cast("int"))), F.lit(default))


def repair_metrics(df: DataFrame) -> DataFrame:
    """Eight rates of (raw_parse_ok, raw_schema_ok, final_parse_ok, final_schema_ok, repairs_used, field_matches, field_total): the last is the mean of the rows' ratios."""
    r = lambda x, name: F.round(x, 6).alias(name)
    return df.agg(
        r(share(F.col("raw_parse_ok")), "raw_valid_json_rate"), r(share(F.col("raw_schema_ok")), "raw_schema_valid_rate"), r(share(F.col("final_parse_ok")), "post_repair_valid_json_rate"), r(share(F.col("final_schema_ok")), "schema_valid_json_rate"),
        r(F.avg("repairs_used"), "average_repairs_per_example"), r(share(F.col("repairs_used") > 0), "repair_needed_rate"), r(share(~F.col("final_schema_ok")), "repair_failed_rate"), r(F.avg(F.try_divide("field_matches", "field_total")), "mean_field_match_rate"),
    )


def tool_metrics(cases: DataFrame, logs: DataFrame) -> DataFrame:
    """Rates of tool use. `cases`: (case_id, rating, base_matches, matches, validated, expected_route, route); `logs`: (case_id, tool, success, unnecessary)."""
    per = logs.groupBy("case_id").agg(F.count("*").alias("calls"), F.sum(F.col("success").cast("int")).alias("good"), F.sum(F.col("unnecessary").cast("int")).alias("extra"), F.count_distinct(F.when(F.col("tool").isin("classify", "extract"), F.col("tool"))).alias("main"))
    x = cases.join(per, "case_id", "left").na.fill(0, ["calls", "good", "extra", "main"])
    rate = F.coalesce(F.try_divide(F.sum("good"), F.sum("calls")), F.lit(0.0))
    return x.agg(
        F.round(rate, 3).alias("tool_call_success_rate"), F.round(F.sum("calls") / F.count("*"), 3).alias("average_tool_calls_per_task"), F.sum((F.col("matches") > F.col("base_matches")).cast("int")).alias("tasks_with_useful_tool_use"),
        F.sum("extra").alias("unnecessary_tool_call_count"), *[F.sum((F.col("rating") == k).cast("int")).alias(f"rated_{k}") for k in ("correct", "partly", "wrong")],
        F.round(F.when(F.sum("calls") > 0, 1 - rate).otherwise(0.0), 3).alias("tool_error_rate"), F.round(share(F.col("main") == 2), 3).alias("tasks_using_both_main_tools_rate"),
        F.round(share((F.col("rating") != "correct") & F.col("validated")), 3).alias("tool_output_ignored_rate"), F.round(share(~F.col("expected_route").eqNullSafe(F.col("route"))), 3).alias("route_contradiction_rate"),
    )


def crew_metrics(runs: DataFrame) -> DataFrame:
    """Ten rates of runs (schema_valid, status, fallback_triggered, reviewer_issues, agents_called, semantic_ok, base_schema_valid, base_semantic_ok); shares among none are 1."""
    c = F.col
    reviewed = c("fallback_triggered") | c("reviewer_issues")
    r = lambda x, name: F.round(x, 6).alias(name)
    return runs.agg(
        r(share(c("schema_valid") & c("status").isin("accepted", "accepted_after_repair")), "valid_final_output_rate"), r(share_among(c("reviewer_issues"), reviewed, 1.0), "reviewer_catch_rate"), r(share(c("fallback_triggered")), "fallback_activation_rate"),
        r(share_among(c("status") == "accepted_after_repair", c("fallback_triggered"), 1.0), "fallback_success_rate"), r(share(c("status") == "manual_review"), "manual_review_rate"), r(F.avg("agents_called"), "average_agents_called_per_case"),
        r(share(c("schema_valid")), "schema_valid_rate"), r(share(c("base_schema_valid")), "baseline_schema_valid_rate"), r(share(c("base_semantic_ok")), "baseline_semantic_success_rate"), r(share(c("semantic_ok")), "crew_semantic_success_rate"),
    )


def flow_metrics(runs: DataFrame) -> DataFrame:
    """Nine figures of flow runs (final_status, fallback_triggered, n_steps, warnings)."""
    c = F.col
    done = F.coalesce(c("final_status"), F.lit("")) != ""
    r = lambda x, name, n=3: F.round(x, n).alias(name)
    return runs.agg(
        F.count("*").alias("total_cases"), r(share(done), "flow_completion_rate"), r(share(c("final_status").isin("exported", "exported_with_warning")), "validation_pass_rate"), r(share(c("fallback_triggered")), "fallback_activation_rate"),
        r(F.sum((c("final_status") == "fallback_repaired").cast("int")) / F.greatest(F.sum(c("fallback_triggered").cast("int")), F.lit(1)), "fallback_success_rate"), r(share(c("final_status") == "safe_failure"), "safe_failure_rate"),
        r(share(done), "export_valid_rate"), r(F.avg("n_steps"), "avg_steps_per_case", 2), r(F.avg("warnings"), "avg_warnings_per_case", 2),
    )


def entity_counts(compared: DataFrame) -> DataFrame:
    """(label, correct, missed, false_positive, rough_precision, rough_recall) of a span comparison: exact spans are correct, unmatched gold spans missed."""
    label = F.coalesce("label", "pred_label")
    g = compared.groupBy(label.alias("label")).agg(*[F.sum((F.col("category") == k).cast("int")).alias(n) for k, n in (("exact", "correct"), ("missed", "missed"), ("false_positive", "false_positive"))])
    z = lambda other: F.round(F.coalesce(F.try_divide(F.col("correct"), F.col("correct") + F.col(other)), F.lit(0.0)), 4)
    return g.select("*", z("false_positive").alias("rough_precision"), z("missed").alias("rough_recall"))


def extraction_scores(df: DataFrame) -> DataFrame:
    """(field_type, tp, fp, fn, skipped, precision, recall) of (field_type, expected BOOLEAN, skip BOOLEAN, found BOOLEAN); NULL precision without a prediction, skipped rows count nowhere else."""
    n = lambda cond, name: F.sum(cond.cast("int")).alias(name)
    e, f, s = F.col("expected"), F.col("found"), F.col("skip")
    g = df.groupBy("field_type").agg(n(~s & e & f, "tp"), n(~s & ~e & f, "fp"), n(~s & e & ~f, "fn"), n(s, "skipped"))
    return g.select("*", F.round(F.try_divide("tp", F.col("tp") + F.col("fp")), 6).alias("precision"), F.round(F.try_divide("tp", F.col("tp") + F.col("fn")), 6).alias("recall"))


def top_features(weights: DataFrame, k: int, by: str = "label", feature: str = "feature", weight: str = "weight") -> DataFrame:
    """(label, side, rank, feature, weight): the k largest and k smallest weights of each class. With two classes and weights of one, the other class has them with the other sign."""
    w = Window.partitionBy(by)
    r = weights.withColumn("top", F.row_number().over(w.orderBy(F.desc(weight), feature))).withColumn("low", F.row_number().over(w.orderBy(weight, feature)))
    side = F.explode(F.array_compact(F.array(F.when(F.col("top") <= k, F.struct(F.lit("positive").alias("side"), F.col("top").alias("rank"))), F.when(F.col("low") <= k, F.struct(F.lit("negative").alias("side"), F.col("low").alias("rank"))))))
    return r.where((F.col("top") <= k) | (F.col("low") <= k)).select(by, side.alias("s"), feature, weight).select(by, "s.side", "s.rank", feature, weight)


def mirrored(weights: DataFrame, other: str, by: str = "label", feature: str = "feature", weight: str = "weight") -> DataFrame:
    """Weights of the first of two classes, with the second class's beside them."""
    return weights.unionByName(weights.select(F.lit(other).alias(by), feature, (-F.col(weight)).alias(weight)))
