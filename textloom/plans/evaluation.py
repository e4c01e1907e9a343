"""Registered queries: evaluation of answers, runs and extractions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import evaluation as V
from ..operators import metrics, stats, validation
from ..sources.readers import parquet
from .checked import _BASE_OK, _E, _FLOW, _MODE, RULES, _answers, _flow
from .relational import _R, _S, _distinct, _split, reviews

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

FIELDS = ("primary_service", "services_mentioned", "issue_type", "document_type", "amounts_uah", "date_text", "location_text")
LISTS = ("services_mentioned", "amounts_uah")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def _cases(s, d):
    """Test cases with an answer beside the expected one, by the length of the input modulo 5: equal, lists in reverse, an invented place, two fields wrong, none at all; and a run of several agents."""
    t = parquet(s, d, "test_cases_lab13").withColumn("mode", F.length(F.coalesce("input", F.lit(""))) % 5)
    e, m = F.col("expected"), F.col("mode")
    pred = F.when(m != 4, F.struct(
        e["primary_service"].alias("primary_service"), F.when(m == 1, F.reverse(e["services_mentioned"])).otherwise(e["services_mentioned"]).alias("services_mentioned"), F.when(m == 3, F.lit("queue")).otherwise(e["issue_type"]).alias("issue_type"),
        F.when(m == 3, F.lit(None).cast("string")).otherwise(e["document_type"]).alias("document_type"), F.when(m == 1, F.reverse(e["amounts_uah"])).otherwise(e["amounts_uah"]).alias("amounts_uah"), e["date_text"].alias("date_text"),
        F.when(m == 2, F.lit("Тихоград")).otherwise(e["location_text"]).alias("location_text"),
    ))
    x = t.withColumn("pred", pred).withColumn("route", F.when(m == 3, "manual_review").otherwise(F.col("expected_route"))).withColumn("simple", F.coalesce(F.array_contains("tags", "simple"), F.lit(False)))
    return x.withColumn("c", V.compare(e, F.col("pred"), FIELDS, LISTS)).withColumn("misses", F.when(F.col("pred").isNull(), F.lit(7)).otherwise(F.size(metrics.field_matches(e, F.col("pred"), FIELDS, LISTS)))).withColumn(
        "rating", F.when(F.col("misses") == 0, "correct").when(F.col("misses") <= 2, "partly").otherwise("wrong")
    )


_M = "length(coalesce(input, '')) % 5"
_CASES = f"""(SELECT *, CASE WHEN mode <> 4 THEN {{'primary_service': e.primary_service, 'services_mentioned': CASE WHEN mode = 1 THEN list_reverse(e.services_mentioned) ELSE e.services_mentioned END, 'issue_type': CASE WHEN mode = 3 THEN 'queue' ELSE e.issue_type END,
'document_type': CASE WHEN mode = 3 THEN NULL ELSE e.document_type END, 'amounts_uah': CASE WHEN mode = 1 THEN list_reverse(e.amounts_uah) ELSE e.amounts_uah END, 'date_text': e.date_text, 'location_text': CASE WHEN mode = 2 THEN 'Тихоград' ELSE e.location_text END}} END AS p,
CASE WHEN mode = 3 THEN 'manual_review' ELSE expected_route END AS route, coalesce(list_contains(tags, 'simple'), false) AS simple FROM (SELECT *, expected AS e, {_M} AS mode FROM test_cases_lab13))"""


def _sql_scalar(f: str) -> str:
    return f"CASE WHEN e.{f} IS DISTINCT FROM p.{f} THEN CASE WHEN e.{f} IS NULL AND p.{f} IS NOT NULL AND p.{f} <> '' THEN '{f}: hallucinated' ELSE '{f}: mismatch' END END"


def _sql_list(f: str) -> str:
    return f"CASE WHEN (e.{f} IS NULL AND p.{f} IS NOT NULL) OR (e.{f} IS NOT NULL AND list_sort(coalesce(p.{f}, [])) <> list_sort(e.{f})) THEN CASE WHEN e.{f} IS NULL AND len(p.{f}) > 0 THEN '{f}: hallucinated' ELSE '{f}: mismatch' END END"


_ISSUES = "CASE WHEN p IS NULL THEN ['invalid JSON'] ELSE list_filter([" + ", ".join(_sql_list(f) if f in LISTS else _sql_scalar(f) for f in FIELDS) + "], lambda x: x IS NOT NULL) END"
_LACKS = " OR ".join(f"(coalesce(len(p.{f}), 0) = 0 AND coalesce(len(e.{f}), 0) > 0)" if f in LISTS else f"(p.{f} IS NULL AND e.{f} IS NOT NULL)" for f in FIELDS)
_MISSES = "CASE WHEN p IS NULL THEN 7 ELSE " + " + ".join(f"(list_sort(e.{f}) IS DISTINCT FROM list_sort(p.{f}))::INT" if f in LISTS else f"(e.{f} IS DISTINCT FROM p.{f})::INT" for f in FIELDS) + " END"
_RUNS = f"(SELECT *, {_ISSUES} AS issues, (p IS NULL OR {_LACKS}) AS missing, {_MISSES} AS misses FROM {_CASES})"
_RATED = f"(SELECT *, CASE WHEN misses = 0 THEN 'correct' WHEN misses <= 2 THEN 'partly' ELSE 'wrong' END AS rating FROM {_RUNS})"
_INVENTED = "(p IS NULL OR len(list_filter(issues, lambda x: contains(x, 'hallucinated'))) > 0)"


@query(f"SELECT case_id, len(issues) = 0 AS semantic_ok, {_INVENTED} AS hallucinated, missing AS missing_required, array_to_string(issues, '; ') AS issues FROM {_RUNS}")
def v10_compare(s, d):
    """Each answer against the expected object, lists without order."""
    return _cases(s, d).select("case_id", "c.semantic_ok", "c.hallucinated", "c.missing_required", F.array_join("c.issues", "; ").alias("issues"))


def _sql_assess(f: str) -> str:
    differ = f"list_sort(e.{f}) IS DISTINCT FROM list_sort(p.{f})" if f in LISTS else f"e.{f} IS DISTINCT FROM p.{f}"
    none, some = (f"coalesce(len(e.{f}), 0) = 0", f"coalesce(len(p.{f}), 0) > 0") if f in LISTS else (f"e.{f} IS NULL", f"coalesce(p.{f}, '') <> ''")
    other = f"WHEN coalesce(e.{f}, '') <> '' AND {some} THEN 'normalization_issue' " if f == "document_type" else ""
    return f"CASE WHEN {differ} THEN CASE WHEN {none} AND {some} THEN 'hallucinated_field/value' {other}ELSE 'semantic_extraction_error' END END"


_CLASSES = "CASE WHEN p IS NULL THEN ['not_json_at_all'] ELSE list_filter([" + ", ".join(map(_sql_assess, FIELDS)) + "], lambda x: x IS NOT NULL) END"


@query(f"SELECT issue, count(*) AS n, count(DISTINCT case_id) AS cases FROM (SELECT case_id, unnest({_CLASSES}) AS issue FROM {_CASES}) GROUP BY issue")
def v11_issue_classes(s, d):
    """How often each class of semantic issue occurs."""
    a = _cases(s, d).select("case_id", V.assess(F.col("expected"), F.col("pred"), FIELDS, LISTS).alias("a"))
    return a.select("case_id", F.explode("a.issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("n"), F.count_distinct("case_id").alias("cases"))


@query(f"SELECT case_id, array_to_string(list_sort(e.services_mentioned), '|') AS services, list_sort(e.services_mentioned) IS NOT DISTINCT FROM list_sort(list_reverse(e.services_mentioned)) AS same FROM {_CASES}")
def x23_canonical_lists(s, d):
    """Lists in sorted form, and whether a list equals its reverse then."""
    x = F.col("expected.services_mentioned")
    return _cases(s, d).select("case_id", F.array_join(V.canonical(x), "|").alias("services"), V.same(x, F.reverse(x), True).alias("same"))


@query(f"SELECT case_id, unnest(issues) AS issue, substring(replace(input, chr(10), ' '), 1, 40) AS excerpt FROM {_RUNS}")
def v13_error_frames(s, d):
    """A row per issue of a case, with the beginning of its input."""
    return _cases(s, d).select("case_id", F.explode("c.issues").alias("issue"), X.excerpt("input", 40).alias("excerpt"))


@query(f"SELECT case_id, rating, CASE WHEN mode = 1 THEN 'unnecessary' WHEN expected_route = 'manual_review' THEN 'manual' WHEN rating = 'wrong' THEN 'wrong' WHEN rating = 'partly' THEN 'partly' WHEN simple THEN 'simple' ELSE 'showcase' END AS category FROM {_RATED}")
def v14_case_summary(s, d):
    """The first category that holds, in this order."""
    c = F.col
    ladder = X.ladder(((c("mode") == 1, "unnecessary"), (c("expected_route") == "manual_review", "manual"), (c("rating") == "wrong", "wrong"), (c("rating") == "partly", "partly"), (c("simple"), "simple")), "showcase")
    return _cases(s, d).select("case_id", "rating", ladder.alias("category"))


@query(f"SELECT case_id, unnest(CASE WHEN len(k) = 0 THEN ['ok'] ELSE k END) AS category FROM (SELECT case_id, list_filter([CASE WHEN route IS DISTINCT FROM expected_route THEN 'wrong route' END, CASE WHEN route = 'manual_review' THEN 'manual review' END, CASE WHEN needs_fallback AND mode IN (2, 3) THEN 'repair helps' END, CASE WHEN {_INVENTED} THEN 'invented field' END, CASE WHEN missing THEN 'missing field' END], lambda x: x IS NOT NULL) AS k FROM {_RUNS})")
def f15_issue_catalogue(s, d):
    """All issues of a run, or `ok`."""
    c = F.col
    rules = ((~c("route").eqNullSafe(c("expected_route")), "wrong route"), (c("route") == "manual_review", "manual review"), (c("needs_fallback") & c("mode").isin(2, 3), "repair helps"), (c("c.hallucinated"), "invented field"), (c("c.missing_required"), "missing field"))
    return _cases(s, d).select("case_id", F.explode(V.catalogue(rules)).alias("category"))


@query(f"""SELECT round(avg((mode IN (0, 1, 3, 4))::INT), 6) AS raw_valid_json_rate, round(avg((ok AND mode < 2)::INT), 6) AS raw_schema_valid_rate, 1.0 AS post_repair_valid_json_rate, round(avg(ok::INT), 6) AS schema_valid_json_rate,
round(avg(CASE WHEN ok AND mode < 2 THEN 0 WHEN ok AND mode IN (2, 5) THEN 1 ELSE 2 END), 6) AS average_repairs_per_example, round(avg((NOT (ok AND mode < 2))::INT), 6) AS repair_needed_rate, round(avg((NOT ok)::INT), 6) AS repair_failed_rate, 1.0 AS mean_field_match_rate
FROM (SELECT {_MODE} AS mode, coalesce({_BASE_OK}, len(expected.amounts_uah) = 0 AND expected.services_mentioned IS NOT NULL AND len(list_distinct(expected.services_mentioned)) = len(expected.services_mentioned), false) AS ok FROM {_E})""")
def a16_repair_metrics(s, d):
    """Validity and repair rates of answers; the repaired object is read back and compared with the expected one."""
    a = _answers(s, d)
    kind = a.schema["expected"].dataType.simpleString()
    x = a.withColumn("v", validation.validate("raw", RULES)).withColumn("r", validation.repaired("raw", RULES, F.col("full")))
    x = x.withColumn("w", validation.validate("r.final", RULES)).withColumn("final", F.from_json("r.final", kind))
    x = x.withColumn("a", V.assess(F.col("expected"), F.col("final"), FIELDS, LISTS))
    return V.repair_metrics(x.select(F.col("v.parse_ok").alias("raw_parse_ok"), F.col("v.schema_ok").alias("raw_schema_ok"), F.col("w.parse_ok").alias("final_parse_ok"), F.col("w.schema_ok").alias("final_schema_ok"), "r.repairs_used", "a.field_matches", "a.field_total"))


def _logs(s, d):
    """Tool calls of the runs: a classifier always, an extractor but for reversed lists, a validator where something is wrong."""
    c = _cases(s, d)
    tools = F.array_compact(F.array(F.lit("classify"), F.when(F.col("mode") != 1, "extract"), F.when(F.col("mode").isin(2, 3), "validate")))
    t = c.select("case_id", "mode", F.posexplode(tools).alias("step", "tool"))
    return t.select("case_id", "step", "tool", ((F.col("tool") != "validate") | (F.col("mode") != 3)).alias("success"), ((F.col("tool") == "validate") & (F.col("mode") == 2)).alias("unnecessary"))


_LOGS = f"(SELECT case_id, tool, NOT (tool = 'validate' AND mode = 3) AS success, tool = 'validate' AND mode = 2 AS unnecessary FROM (SELECT case_id, mode, unnest(list_filter(['classify', CASE WHEN mode <> 1 THEN 'extract' END, CASE WHEN mode IN (2, 3) THEN 'validate' END], lambda x: x IS NOT NULL)) AS tool FROM {_CASES}))"
_BASE_MISS = "(e.primary_service IS DISTINCT FROM 'unknown')::INT + (coalesce(len(e.services_mentioned), 0) > 0)::INT + (e.issue_type IS DISTINCT FROM 'queue')::INT + (e.document_type IS NOT NULL)::INT + (coalesce(len(e.amounts_uah), 0) > 0)::INT + (e.date_text IS NOT NULL)::INT + (e.location_text IS NOT NULL)::INT"


def _baseline_matches():
    """Fields on which a constant answer (an unknown service in a queue, nothing else) is right; an absent list is an empty one."""
    e = F.col("expected")
    miss = [~e["primary_service"].eqNullSafe(F.lit("unknown")), F.size(F.coalesce(e["services_mentioned"], F.array().cast("array<string>"))) > 0, ~e["issue_type"].eqNullSafe(F.lit("queue")), e["document_type"].isNotNull(), F.size(F.coalesce(e["amounts_uah"], F.array().cast("array<double>"))) > 0, e["date_text"].isNotNull(), e["location_text"].isNotNull()]
    return F.lit(len(miss)) - sum((x.cast("int") for x in miss), F.lit(0))


@query(f"""WITH c AS {_RATED}, l AS {_LOGS}, m AS (SELECT case_id, count(DISTINCT tool) FILTER (tool IN ('classify', 'extract')) AS main FROM l GROUP BY case_id)
SELECT round((SELECT avg(success::INT) FROM l), 3) AS tool_call_success_rate, round((SELECT count(*) FROM l) / count(*), 3) AS average_tool_calls_per_task, sum((7 - misses > 7 - ({_BASE_MISS}))::INT)::BIGINT AS tasks_with_useful_tool_use,
(SELECT sum(unnecessary::INT) FROM l)::BIGINT AS unnecessary_tool_call_count, sum((rating = 'correct')::INT)::BIGINT AS rated_correct, sum((rating = 'partly')::INT)::BIGINT AS rated_partly, sum((rating = 'wrong')::INT)::BIGINT AS rated_wrong,
round(1 - (SELECT avg(success::INT) FROM l), 3) AS tool_error_rate, round(avg((main = 2)::INT), 3) AS tasks_using_both_main_tools_rate, round(avg((rating <> 'correct' AND mode IN (2, 3))::INT), 3) AS tool_output_ignored_rate, round(avg((route IS DISTINCT FROM expected_route)::INT), 3) AS route_contradiction_rate FROM c JOIN m USING (case_id)""")
def a17_tool_metrics(s, d):
    c = _cases(s, d).select("case_id", "rating", _baseline_matches().alias("base_matches"), (F.lit(7) - F.col("misses")).alias("matches"), F.col("mode").isin(2, 3).alias("validated"), "expected_route", "route")
    return V.tool_metrics(c, _logs(s, d))


@query(f"""WITH c AS (SELECT *, CASE WHEN mode IN (0, 1) THEN 'accepted' WHEN needs_fallback AND mode IN (2, 3) THEN 'accepted_after_repair' ELSE 'manual_review' END AS status, coalesce(needs_fallback, false) AS fb, mode IN (2, 3, 4) AS ri FROM {_RUNS})
SELECT round(avg((mode <> 4 AND status IN ('accepted', 'accepted_after_repair'))::INT), 6) AS valid_final_output_rate, round(coalesce(sum(ri::INT) / nullif(sum((fb OR ri)::INT), 0), 1.0), 6) AS reviewer_catch_rate, round(avg(fb::INT), 6) AS fallback_activation_rate,
round(coalesce(sum((fb AND status = 'accepted_after_repair')::INT) / nullif(sum(fb::INT), 0), 1.0), 6) AS fallback_success_rate, round(avg((status = 'manual_review')::INT), 6) AS manual_review_rate, round(avg(3 + fb::INT), 6) AS average_agents_called_per_case,
round(avg((mode <> 4)::INT), 6) AS schema_valid_rate, round(avg((mode NOT IN (3, 4))::INT), 6) AS baseline_schema_valid_rate, round(avg((7 - ({_BASE_MISS}) = 7)::INT), 6) AS baseline_semantic_success_rate, round(avg((len(issues) = 0)::INT), 6) AS crew_semantic_success_rate FROM c""")
def a18_crew_metrics(s, d):
    m, fb = F.col("mode"), F.coalesce("needs_fallback", F.lit(False))
    status = F.when(m.isin(0, 1), "accepted").when(fb & m.isin(2, 3), "accepted_after_repair").otherwise("manual_review")
    return V.crew_metrics(_cases(s, d).select((m != 4).alias("schema_valid"), status.alias("status"), fb.alias("fallback_triggered"), m.isin(2, 3, 4).alias("reviewer_issues"), (fb.cast("int") + 3).alias("agents_called"), F.col("c.semantic_ok").alias("semantic_ok"), (~m.isin(3, 4)).alias("base_schema_valid"), (_baseline_matches() == 7).alias("base_semantic_ok")))


_SERVICES = ("паспорт", "субсиді", "довідк")


def _flow_runs(s, d):
    """Flow runs with warnings and a repair: a failed message whose text names exactly one service takes that one."""
    named = F.filter(F.array(*[F.lit(x) for x in _SERVICES]), lambda x: F.col("clean").contains(x))
    f = _flow(s, d).withColumn("services", named).withColumn("warnings", F.array_compact(F.array(F.when(F.col("question"), "question"), F.when(F.col("clean").contains("грн"), "amount"))))
    failed = F.col("status") == "safe_failure"
    f = f.withColumn("fallback_triggered", failed).withColumn("repaired_service", F.when(failed & (F.size("services") == 1), F.try_element_at("services", F.lit(1))))
    return f.withColumn("final_status", F.when(F.col("repaired_service").isNotNull(), "fallback_repaired").when(failed, "safe_failure").when(F.size("warnings") > 0, "exported_with_warning").otherwise("exported"))


_FLOW_RUNS = f"""(SELECT *, CASE WHEN repaired IS NOT NULL THEN 'fallback_repaired' WHEN fb THEN 'safe_failure' WHEN len(warnings) > 0 THEN 'exported_with_warning' ELSE 'exported' END AS final_status FROM
(SELECT *, CASE WHEN fb AND len(services) = 1 THEN services[1] END AS repaired FROM (SELECT *, status = 'safe_failure' AS fb, list_filter(['паспорт', 'субсиді', 'довідк'], lambda x: contains(clean, x)) AS services,
list_filter([CASE WHEN contains(clean, '?') THEN 'question' END, CASE WHEN contains(clean, 'грн') THEN 'amount' END], lambda x: x IS NOT NULL) AS warnings FROM {_FLOW})))"""


@query(f"SELECT case_id, fb AS fallback_triggered, repaired AS repaired_service, CASE WHEN NOT fb THEN 'none' WHEN repaired IS NOT NULL THEN 'export_repaired' ELSE 'safe_failure' END AS action FROM {_FLOW_RUNS}")
def f10_service_repair(s, d):
    return _flow_runs(s, d).select("case_id", "fallback_triggered", "repaired_service", F.when(~F.col("fallback_triggered"), "none").when(F.col("repaired_service").isNotNull(), "export_repaired").otherwise("safe_failure").alias("action"))


@query(f"SELECT case_id, final_status AS status, coalesce(repaired, nullif(number, '')) AS service, array_to_string(warnings, ',') AS warnings, fb OR final_status = 'safe_failure' AS needs_manual_review, fb AS fallback_triggered FROM {_FLOW_RUNS}")
def f11_export_payload(s, d):
    """What leaves the flow: repaired fields over extracted ones, and whether someone must look at it."""
    r = _flow_runs(s, d)
    return r.select("case_id", F.col("final_status").alias("status"), F.coalesce("repaired_service", F.nullif("number", F.lit(""))).alias("service"), F.array_join("warnings", ",").alias("warnings"), (F.col("fallback_triggered") | (F.col("final_status") == "safe_failure")).alias("needs_manual_review"), "fallback_triggered")


@query(f"SELECT case_id, to_json({{'case_id': case_id, 'status': final_status, 'steps': steps, 'warnings': warnings}}) AS state FROM {_FLOW_RUNS}")
def f12_state(s, d):
    """The state of a run as JSON."""
    return _flow_runs(s, d).select("case_id", F.to_json(F.struct("case_id", F.col("final_status").alias("status"), F.size("steps").alias("steps"), "warnings")).alias("state"))


@query(f"SELECT adhoc_status, final_status AS flow_status, count(*) AS n, sum((final_status = 'safe_failure')::INT)::BIGINT AS structured_failures FROM (SELECT CASE WHEN number <> '' THEN 'ok' ELSE 'silent_failure' END AS adhoc_status, final_status FROM {_FLOW_RUNS}) GROUP BY ALL")
def f13_adhoc_against_flow(s, d):
    """A plain extraction, whose failures are silent, against the flow."""
    r = _flow_runs(s, d).select("case_id", "final_status")
    adhoc = _flow(s, d).select("case_id", F.when(F.col("number") != "", "ok").otherwise("silent_failure").alias("adhoc_status"))
    return adhoc.join(r, "case_id").groupBy("adhoc_status", F.col("final_status").alias("flow_status")).agg(F.count("*").alias("n"), F.sum((F.col("final_status") == "safe_failure").cast("int")).alias("structured_failures"))


@query(f"""SELECT count(*) AS total_cases, 1.0 AS flow_completion_rate, round(avg((final_status IN ('exported', 'exported_with_warning'))::INT), 3) AS validation_pass_rate, round(avg(fb::INT), 3) AS fallback_activation_rate, round(sum((final_status = 'fallback_repaired')::INT) / greatest(sum(fb::INT), 1), 3) AS fallback_success_rate,
round(avg((final_status = 'safe_failure')::INT), 3) AS safe_failure_rate, 1.0 AS export_valid_rate, round(avg(steps), 2) AS avg_steps_per_case, round(avg(len(warnings)), 2) AS avg_warnings_per_case FROM {_FLOW_RUNS}""")
def a19_all_flow_metrics(s, d):
    return V.flow_metrics(_flow_runs(s, d).select("final_status", "fallback_triggered", F.size("steps").alias("n_steps"), F.size("warnings").alias("warnings")))


@query(f"SELECT c.case_id, c.rating, l.tool FROM {_RATED} c JOIN (SELECT DISTINCT case_id, tool FROM {_LOGS}) l ON c.case_id = l.case_id")
def j10_case_lookup(s, d):
    """Tool calls with the case they belong to."""
    return _cases(s, d).select("case_id", "rating").join(_logs(s, d).select("case_id", "tool").distinct(), "case_id")


@query(f"SELECT case_id, count(*) AS calls, array_to_string(list_sort(list(tool)), ',') AS tools FROM {_LOGS} GROUP BY case_id")
def j13_logs_of_a_task(s, d):
    return _logs(s, d).groupBy("case_id").agg(F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_list("tool")), ",").alias("tools"))


@query(f"SELECT e.text_id, e.mode, r.repairs FROM (SELECT text_id, {_MODE} AS mode FROM {_E}) e LEFT JOIN (SELECT text_id, 1 AS repairs FROM (SELECT text_id, {_MODE} AS mode FROM {_E}) WHERE mode >= 2 GROUP BY text_id) r ON e.text_id = r.text_id")
def j3_left_of_repairs(s, d):
    """All answers with their repair, where there was one."""
    a = _answers(s, d).select("text_id", "mode")
    return a.join(a.where("mode >= 2").select("text_id", F.lit(1).alias("repairs")).distinct(), "text_id", "left")


@query(f"""SELECT split, count(*) AS n, sum((s <> '')::INT)::BIGINT AS filled FROM (SELECT split, coalesce(source, '') AS s FROM {_R} r JOIN {_S} s USING (text_id)) GROUP BY split""")
def d5_sources_by_split(s, d):
    return _distinct(s, d).join(_split(s, d), "text_id").groupBy("split").agg(F.count("*").alias("n"), F.sum((F.coalesce("source", F.lit("")) != "").cast("int")).alias("filled"))


@query(f"SELECT split, kind, value, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY split, kind), 6) AS share FROM (SELECT split, unnest(['label', 'source']) AS kind, unnest([label, source]) AS value FROM {_R} r JOIN {_S} s USING (text_id)) GROUP BY split, kind, value")
def d5_distributions(s, d):
    """Classes and sources of each split with their shares, NULL as a value."""
    x = _distinct(s, d).join(_split(s, d), "text_id").select("split", F.expr("stack(2, 'label', label, 'source', source) AS (kind, value)"))
    g = x.groupBy("split", "kind", "value").agg(F.count("*").alias("n"))
    total = g.groupBy("split", "kind").agg(F.sum("n").alias("t"))
    return g.join(total, ["split", "kind"]).select("split", "kind", "value", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query("""SELECT text_id, field_type, span_text FROM (SELECT *, row_number() OVER (PARTITION BY field_type ORDER BY text_id, start_char, span_text) AS r FROM (SELECT DISTINCT text_id, field_type, span_text, start_char FROM lab4_gold_ie_draft WHERE span_text <> '' AND start_char >= 0)) WHERE r <= 15""")
def r5_weak_gold(s, d):
    """A seed of gold spans: the first fifteen of each field, each once."""
    g = parquet(s, d, "lab4_gold_ie_draft").where("span_text <> '' AND start_char >= 0").select("text_id", "field_type", "span_text", "start_char").distinct()
    return g.withColumn("r", F.row_number().over(Window.partitionBy("field_type").orderBy("text_id", "start_char", "span_text"))).where("r <= 15").select("text_id", "field_type", "span_text")


@query("""WITH g AS (SELECT DISTINCT text_id, text, field_type, span_text, start_char FROM lab4_gold_ie_draft WHERE text IS NOT NULL AND field_type IN ('LOCATION', 'DATE', 'DOC_ID')),
x AS (SELECT field_type, coalesce(span_text, '') <> '' AND start_char >= 0 AS expected, coalesce(start_char, -1) < 0 AS skip, contains(text, '№') OR regexp_matches(text, '[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}') AS found FROM g),
c AS (SELECT field_type, sum((NOT skip AND expected AND found)::INT)::BIGINT AS tp, sum((NOT skip AND NOT expected AND found)::INT)::BIGINT AS fp, sum((NOT skip AND expected AND NOT found)::INT)::BIGINT AS fn, sum(skip::INT)::BIGINT AS skipped FROM x GROUP BY field_type)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM c""")
def a22_extraction_scores(s, d):
    """Whether texts with a gold span have a number or date at all, by field; rows without an offset are skipped."""
    g = parquet(s, d, "lab4_gold_ie_draft").where("text IS NOT NULL AND field_type IN ('LOCATION', 'DATE', 'DOC_ID')").select("text_id", "text", "field_type", "span_text", "start_char").distinct()
    found = F.col("text").contains("№") | F.col("text").rlike("[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}")
    start = F.coalesce("start_char", F.lit(-1))
    return V.extraction_scores(g.select("field_type", ((F.coalesce("span_text", F.lit("")) != "") & (start >= 0)).alias("expected"), (start < 0).alias("skip"), found.alias("found")))


@query(f"""SELECT field, count(*) AS n FROM (SELECT unnest(list_filter([{", ".join(f"CASE WHEN {'list_sort(e.' + f + ') IS DISTINCT FROM list_sort(p.' + f + ')' if f in LISTS else 'e.' + f + ' IS DISTINCT FROM p.' + f} THEN '{f}' END" for f in FIELDS)}], lambda x: x IS NOT NULL)) AS field FROM {_CASES} WHERE p IS NOT NULL) GROUP BY field ORDER BY n DESC, field LIMIT 4""")
def a21_mismatches(s, d):
    """The four fields that differ most often."""
    x = _cases(s, d).where("pred IS NOT NULL").select(F.explode(metrics.field_matches(F.col("expected"), F.col("pred"), FIELDS, LISTS)).alias("field"))
    return stats.top(x, "field", 4)


@query("""SELECT count(*) AS total_cases, sum((bad = 0)::INT)::BIGINT AS valid_cases, sum((bad > 0)::INT)::BIGINT AS failed_cases, round(avg((bad = 0)::INT), 6) AS pass_rate FROM
(SELECT len(list_filter(string_split(trim(regexp_replace(coalesce(input, ''), '[ \\n]+', ' ', 'g'), ' '), ' '), lambda w: w = '' OR regexp_matches(w, '[0-9№]') AND NOT regexp_matches(w, '^[0-9.,]+$'))) AS bad FROM test_cases_lab13)""")
def a24_regression(s, d):
    """Share of inputs whose tokens all have a tag of the universal set; words that mix digits with anything else get none."""
    words = F.split(F.btrim(F.regexp_replace(F.coalesce("input", F.lit("")), "[ \n]+", " "), F.lit(" ")), " ", -1)
    tag = lambda w: F.when(w.rlike("^[0-9.,]+$"), "NUM").when(w.rlike("[0-9№]"), "MIXED").otherwise("X")
    t = parquet(s, d, "test_cases_lab13").select(F.size(validation.invalid_tokens(F.transform(words, lambda w: F.struct(w.alias("form"), tag(w).alias("upos"))))).alias("bad"))
    return t.agg(F.count("*").alias("total_cases"), F.sum((F.col("bad") == 0).cast("int")).alias("valid_cases"), F.sum((F.col("bad") > 0).cast("int")).alias("failed_cases"), F.round(F.avg((F.col("bad") == 0).cast("int")), 6).alias("pass_rate"))


_TERMS = r"(SELECT DISTINCT text_id, label, unnest(list_filter(string_split_regex(lower(text), '[^\p{L}]+'), lambda x: length(x) >= 4)) AS feature FROM processed_v2_sample WHERE text IS NOT NULL AND label IS NOT NULL)"


@query(f"""WITH t AS {_TERMS}, n AS (SELECT label, count(*) AS n FROM (SELECT DISTINCT text_id, label FROM t) GROUP BY label), c AS (SELECT label, feature, count(*) AS k FROM t GROUP BY ALL), f AS (SELECT feature, sum(k) AS k FROM c GROUP BY feature HAVING sum(k) >= 20), a AS (SELECT sum(n) AS n FROM n),
w AS (SELECT n.label, f.feature, round(ln((coalesce(c.k, 0) + 1) / (n.n + 2)) - ln((f.k - coalesce(c.k, 0) + 1) / (a.n - n.n + 2)), 4) AS weight FROM n CROSS JOIN f CROSS JOIN a LEFT JOIN c ON c.label = n.label AND c.feature = f.feature)
SELECT label, side, rank, feature, weight FROM (SELECT *, 'positive' AS side, row_number() OVER (PARTITION BY label ORDER BY weight DESC, feature)::INT AS rank FROM w UNION ALL SELECT *, 'negative', row_number() OVER (PARTITION BY label ORDER BY weight, feature)::INT FROM w) WHERE rank <= 10""")
def w5_top_features(s, d):
    """The ten words that speak most for and against each label, by log-odds of the texts that hold them."""
    t = reviews(s, d).where("text IS NOT NULL AND label IS NOT NULL").select("text_id", "label", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) >= 4)).alias("feature")).distinct()
    n = t.select("text_id", "label").distinct().groupBy("label").agg(F.count("*").alias("n"))
    c = t.groupBy("label", "feature").agg(F.count("*").alias("k"))
    f = c.groupBy("feature").agg(F.sum("k").alias("total")).where("total >= 20")
    labels = n.agg(F.collect_list(F.struct("label", "n")).alias("ls"), F.sum("n").alias("all"))  # one row, with one entry per class
    grid = f.crossJoin(F.broadcast(labels)).select("feature", "total", "all", F.inline("ls"))
    odds = F.log((F.coalesce("k", F.lit(0)) + 1) / (F.col("n") + 2)) - F.log((F.col("total") - F.coalesce("k", F.lit(0)) + 1) / (F.col("all") - F.col("n") + 2))
    return V.top_features(grid.join(c, ["label", "feature"], "left").select("label", "feature", F.round(odds, 4).alias("weight")), 10)


@query(ORACLE["w5_top_features"].replace("SELECT label, side, rank, feature, weight FROM (SELECT *, 'positive'", "SELECT label, string_agg(feature, ' ' ORDER BY rank) AS words FROM (SELECT *, 'positive'").replace("WHERE rank <= 10", "WHERE rank <= 5 AND side = 'positive' GROUP BY label"))
def w4_top_words(s, d):
    """The five words of the largest weight of each class, in order."""
    t = w5_top_features(s, d).where("side = 'positive' AND rank <= 5")
    return t.groupBy("label").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]), " ").alias("words"))


@query("SELECT '- ' || coalesce(label, 'none') || ': ' || n || ' (' || printf('%.2f', share * 100) || ' %)' AS line FROM (SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM processed_v2_sample), 6) AS share FROM processed_v2_sample GROUP BY label)")
def k5_report_lines(s, d):
    """Lines of a report: each label with its count and share."""
    v = stats.value_counts(reviews(s, d), "label")
    return v.select(F.format_string("- %s: %d (%.2f %%)", F.coalesce("label", F.lit("none")), "n", F.col("share") * 100).alias("line"))
