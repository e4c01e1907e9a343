"""The pN_ queries: each operator over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from . import canonical, chunking, crosssplit, leakage, linking, mixing, neardup, pii, sampling, sentences


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    units = sentences.sentence_units(_t(spark, d, "processed_v2_sample"))
    return units.select(F.col("id").alias("text_id"), "start_char").distinct()


def p1_units(spark: SparkSession, d: str) -> DataFrame:
    return sentences.sentence_units(_t(spark, d, "processed_v2_sample")).withColumnRenamed("id", "text_id")


def _p3(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return crosssplit.jaccard_split(_t(spark, d, "processed_v2_sample"), _t(spark, d, "split_ids"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.pairs_of(*_p3(spark, d))


def p3_counts(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.counts_of(*_p3(spark, d))


def p3_weighted(spark: SparkSession, d: str) -> DataFrame:
    return crosssplit.classes_of(*crosssplit.cross_split(_t(spark, d, "processed_v2_sample"), _t(spark, d, "split_ids")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.pairs_of(*neardup.near_duplicates(_t(spark, d, "processed_v2_sample")))


def p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups_of(*neardup.near_duplicates(_t(spark, d, "processed_v2_sample")))


def _p6_rows(spark: SparkSession, d: str) -> DataFrame:
    reviews = _t(spark, d, "processed_v2_sample").select(F.lit("processed_v2_sample").alias("src"), F.col("text_id").cast("string").alias("row_key"), "text")
    cases = _t(spark, d, "test_cases_lab13").select(F.lit("test_cases_lab13").alias("src"), F.col("case_id").alias("row_key"), F.col("input").alias("text"))
    return reviews.unionByName(cases)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return canonical.found(_p6_rows(spark, d))


def p6_consistent(spark: SparkSession, d: str) -> DataFrame:
    return canonical.consistent(_p6_rows(spark, d))


def _p7_rows(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name: _t(spark, d, name).select(F.lit(name).alias("src"), "text_id", "text")
    return one("processed_v2_sample").unionByName(one("eval_set_lab11"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    rows = _p7_rows(spark, d)
    return pii.spans(rows, pii.trained(rows)).select("src", "text_id", "pii_type").distinct()


def p7_redacted(spark: SparkSession, d: str) -> DataFrame:
    rows = _p7_rows(spark, d)
    return pii.redacted(rows, pii.trained(rows))


def _p2(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return sampling.stratified(_t(spark, d, "labels"), _t(spark, d, "label_targets"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[1].where("exhausted").select("label")


def p2_quotas(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[1].select("label", "available", "wanted", "quota", "exhausted")


def p2_shares(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[1].select("label", "target_share", "quota", "actual_share", "shortfall", "exhausted")


def p2_sample(spark: SparkSession, d: str) -> DataFrame:
    return _p2(spark, d)[0].withColumnRenamed("id", "text_id")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    typed = _t(spark, d, "eval_set_lab11").where("expected.location_text IS NOT NULL").select(F.lit("eval_set_lab11").alias("src"), "text_id", F.col("expected.location_text").alias("mention"))
    draft = _t(spark, d, "lab4_gold_ie_draft").where("field_type = 'LOCATION'").select(F.lit("lab4_gold_ie_draft").alias("src"), "text_id", F.expr("stack(2, span_text, normalized_value) AS mention"))
    return linking.linked(typed.unionByName(draft), _t(spark, d, "location_ref"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(_t(spark, d, "documents"), _t(spark, d, "heldout_items"))


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(_t(spark, d, "documents"), _t(spark, d, "heldout_items")).distinct()


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.cleaned(_t(spark, d, "documents"), _t(spark, d, "heldout_items")).select("doc_id", "text", "leaked_chars")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return mixing.balance(_t(spark, d, "documents"), _t(spark, d, "source_weights")).report.where("exhausted").select("source")


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(mixing.balance(_t(spark, d, "documents"), _t(spark, d, "source_weights")))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.copies(mixing.balance(_t(spark, d, "documents"), _t(spark, d, "source_weights"))).where("copies > 0")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_documents(_t(spark, d, "documents"), only_oversized=True).where("piece_no = 0").select("doc_id").distinct()


def p10_pieces(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_documents(_t(spark, d, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p1_units, p2_found, p2_quotas, p2_shares, p2_sample, p3_found, p3_counts, p3_weighted, p4_found, p4_groups, p5_found, p6_found, p6_consistent,
        p7_found, p7_redacted, p8_found, p8_spans, p8_cleaned, p9_found, p9_shares, p9_mix, p10_found, p10_pieces,
    )
}

_CANON = r"regexp_replace(trim(regexp_replace(lower(label), '\s+', ' ', 'g')), ' ?/ ?', ' / ', 'g')"
_QUOTAS = f"""
WITH r AS (SELECT DISTINCT text_id, {_CANON} AS canon FROM labels WHERE text_id IS NOT NULL AND label IS NOT NULL),
c AS (SELECT canon, count(*) AS n FROM r GROUP BY canon),
s AS (SELECT count(DISTINCT text_id) * 0.2::DOUBLE AS s FROM r),
q AS (SELECT t.label, t.target_share, t.target_share * s.s AS part, t.min_rows::DOUBLE AS least, coalesce(c.n, 0) AS available, greatest(t.min_rows::DOUBLE, t.target_share * s.s) AS wanted, s.s
      FROM (SELECT *, {_CANON} AS canon FROM label_targets) t LEFT JOIN c USING (canon) CROSS JOIN s),
steps AS (SELECT 1.0::DOUBLE AS x UNION SELECT available / part FROM q WHERE part > 0 UNION SELECT least / part FROM q WHERE part > 0),
tried AS (SELECT x, sum(least(available::DOUBLE, greatest(least, x * part))) AS total, sum(CASE WHEN least <= x * part AND x * part < available THEN part ELSE 0 END) AS slope, any_value(s) AS s FROM steps, q WHERE x >= 1 GROUP BY x),
best AS (SELECT CASE WHEN x = 1 AND total >= s THEN 1.0 WHEN slope > 0 THEN x + (s - total) / slope ELSE x END AS x FROM tried WHERE x = 1 OR total <= s ORDER BY tried.x DESC LIMIT 1),
e AS (SELECT q.*, least(available::DOUBLE, greatest(least, best.x * part)) AS exact FROM q, best),
f AS (SELECT *, floor(exact + 1e-6) AS whole, round(sum(exact) OVER ()) - sum(floor(exact + 1e-6)) OVER () AS more FROM e),
g AS (SELECT *, row_number() OVER (ORDER BY round(exact - whole, 6) DESC, label) AS place FROM f),
h AS (SELECT *, (whole + CASE WHEN place <= more AND whole < available THEN 1 ELSE 0 END)::BIGINT AS quota FROM g)
"""
ORACLE: dict[str, str] = {
    "p2_found": _QUOTAS + "SELECT label FROM q WHERE available < wanted - 1e-9",
    "p2_quotas": _QUOTAS + "SELECT label, available::BIGINT AS available, wanted, quota, available < wanted - 1e-9 AS exhausted FROM h",
    "p2_shares": _QUOTAS + "SELECT label, target_share, quota, quota / sum(quota) OVER () AS actual_share, greatest(0.0, wanted - quota) AS shortfall, available < wanted - 1e-9 AS exhausted FROM h",
}
