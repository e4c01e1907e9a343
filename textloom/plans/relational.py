"""Registered queries: scans, projections, filters, joins, aggregations, windows, set operations, splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import features, metrics, similarity, splits, stats
from ..sources.readers import parquet, union_available

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}]"
_WC = f"len(list_filter(string_split_regex(coalesce(text, ''), '{WS}+'), lambda x: x <> ''))"
SPLITS = {"train": 0.8, "val": 0.1, "test": 0.1}


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL."""
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def reviews(s: SparkSession, d: str) -> DataFrame:
    return parquet(s, d, "processed_v2_sample")


def _split(s: SparkSession, d: str) -> DataFrame:
    return parquet(s, d, "split_ids").distinct()


_R = "(SELECT DISTINCT text_id, text, label, source FROM processed_v2_sample)"
_S = "(SELECT DISTINCT text_id, split FROM split_ids)"


def _distinct(s, d):
    return reviews(s, d).select("text_id", "text", "label", "source").distinct()


@query("SELECT label, count(*) AS n, round(count(*) / (SELECT count(*) FROM processed_v2_sample), 6) AS share FROM processed_v2_sample GROUP BY label")
def a1_value_counts(s, d):
    return stats.value_counts(reviews(s, d), "label")


@query("""SELECT label, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.25), 6) AS p25,
round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.95), 6) AS p95, max(x) AS max FROM (SELECT label, length(text)::DOUBLE AS x FROM processed_v2_sample) GROUP BY label""")
def a2_length_describe(s, d):
    return stats.describe(reviews(s, d), F.length("text"), ("label",))


_CLEAN = f"trim(regexp_replace(coalesce(text, ''), '{WS}+', ' ', 'g'))"


@query(f"""SELECT count(*) AS n, round(avg(length(coalesce(text, ''))), 6) AS mean_before, round(avg(length({_CLEAN})), 6) AS mean_after, median(length(coalesce(text, ''))) AS median_before, median(length({_CLEAN})) AS median_after,
round(avg({_WC}), 6) AS words, round(avg(({_WC} < 5)::INT) * 100, 6) AS short_pct FROM processed_v2_sample""")
def a3_audit_before_after(s, d):
    t = reviews(s, d).select(F.length(F.coalesce("text", F.lit(""))).alias("b"), F.length(X.clean("text")).alias("a"), X.word_count("text").alias("w"))
    half = lambda c: F.percentile(c, F.lit(0.5))
    return t.agg(F.count("*").alias("n"), F.round(F.avg("b"), 6).alias("mean_before"), F.round(F.avg("a"), 6).alias("mean_after"), half("b").alias("median_before"), half("a").alias("median_after"), F.round(F.avg("w"), 6).alias("words"), F.round(F.avg((F.col("w") < 5).cast("int")) * 100, 6).alias("short_pct"))


@query(f"""SELECT split, count(x) AS n, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS std, min(x) AS min, round(quantile_cont(x, 0.05), 6) AS p05, round(quantile_cont(x, 0.25), 6) AS p25,
round(quantile_cont(x, 0.5), 6) AS p50, round(quantile_cont(x, 0.75), 6) AS p75, round(quantile_cont(x, 0.95), 6) AS p95, max(x) AS max FROM (SELECT split, length(text)::DOUBLE AS x FROM {_R} r JOIN {_S} s USING (text_id)) GROUP BY split""")
def a4_length_by_split(s, d):
    return stats.describe(_distinct(s, d).join(_split(s, d), "text_id"), F.length("text"), ("split",))


@query("""SELECT sum(n)::BIGINT AS rows, coalesce(sum(n) FILTER (n > 1), 0)::BIGINT AS in_duplicate_groups, round(coalesce(sum(n) FILTER (n > 1), 0) / sum(n), 6) AS share
FROM (SELECT count(*) AS n FROM processed_v2_sample GROUP BY text)""")
def a5_duplicate_share(s, d):
    return stats.duplicate_share(reviews(s, d), F.col("text"))


@query("SELECT source, label, count(*) AS n FROM processed_v2_sample GROUP BY source, label")
def a6_group_size_two_keys(s, d):
    return reviews(s, d).groupBy("source", "label").agg(F.count("*").alias("n"))


_TOK = r"list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}]+'), lambda x: x <> '')"


@query(f"SELECT token, n FROM (SELECT token, count(*) AS n FROM (SELECT unnest({_TOK}) AS token FROM processed_v2_sample) GROUP BY token) ORDER BY n DESC, token LIMIT 20")
def a8_top_tokens(s, d):
    return stats.top(reviews(s, d).select(F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "")).alias("token")), "token", 20)


@query("""SELECT source, label, n FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, f) AS r FROM (SELECT source, label, count(*) AS n, min(text_id) AS f FROM processed_v2_sample WHERE label IS NOT NULL GROUP BY source, label)) WHERE r = 1""")
def a10_majority_label(s, d):
    return stats.majority(reviews(s, d).where("label IS NOT NULL"), "source", "label", "text_id")


@query(f"""SELECT split, count(*) AS n, count(DISTINCT source) AS sources, array_to_string(list_sort(list(DISTINCT label)), '; ') AS labels FROM {_R} r JOIN {_S} s USING (text_id) WHERE label IS NOT NULL GROUP BY split""")
def a11_inventory(s, d):
    x = _distinct(s, d).join(_split(s, d), "text_id").where("label IS NOT NULL")
    return x.groupBy("split").agg(F.count("*").alias("n"), F.count_distinct("source").alias("sources"), F.array_join(F.sort_array(F.collect_set("label")), "; ").alias("labels"))


@query(f"""WITH t AS (SELECT split, unnest({_TOK}) AS form FROM {_R} r JOIN {_S} s USING (text_id)), v AS (SELECT DISTINCT form FROM t WHERE split = 'train')
SELECT split, count(*) AS tokens, round(avg((v.form IS NULL)::INT), 6) AS oov_rate FROM t LEFT JOIN v USING (form) GROUP BY split""")
def a12_oov_rate(s, d):
    from ..operators.tagging import oov_rate

    return oov_rate(_distinct(s, d).join(_split(s, d), "text_id").select("split", F.explode(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "")).alias("form")))


_GP = f"(SELECT r.label AS gold, l.label AS pred FROM {_R} r JOIN (SELECT DISTINCT text_id, label FROM labels) l USING (text_id) WHERE r.label IS NOT NULL AND l.label IS NOT NULL)"


def _gold_pred(s, d):
    l = parquet(s, d, "labels").distinct().withColumnRenamed("label", "pred")
    return _distinct(s, d).withColumnRenamed("label", "gold").join(l, "text_id").where("gold IS NOT NULL AND pred IS NOT NULL")


@query(f"""WITH g AS {_GP}, l AS (SELECT gold AS x FROM g UNION SELECT pred FROM g), c AS (SELECT gold, pred, count(*) AS n FROM g GROUP BY ALL)
SELECT a.x AS gold, b.x AS pred, coalesce(c.n, 0)::BIGINT AS n FROM l a CROSS JOIN l b LEFT JOIN c ON c.gold = a.x AND c.pred = b.x""")
def a13_confusion(s, d):
    return metrics.confusion(_gold_pred(s, d))


@query(f"""WITH g AS {_GP}, l AS (SELECT gold AS label FROM g UNION SELECT pred FROM g),
c AS (SELECT label, (SELECT count(*) FROM g WHERE gold = label AND pred = label) AS tp, (SELECT count(*) FROM g WHERE gold = label) AS support, (SELECT count(*) FROM g WHERE pred = label) AS k FROM l),
p AS (SELECT label, coalesce(tp / nullif(k, 0), 0.0) AS precision, coalesce(tp / nullif(support, 0), 0.0) AS recall, support, tp FROM c),
f AS (SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM p)
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM f
UNION ALL SELECT 'macro', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'weighted', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), sum(support)::BIGINT FROM f
UNION ALL SELECT 'accuracy', round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), round(sum(tp) / sum(support), 6), sum(support)::BIGINT FROM f""")
def a14_report(s, d):
    return metrics.report(_gold_pred(s, d))


@query(f"""SELECT count(*) AS sequences, round(avg(ok), 6) AS exact_match FROM (SELECT source, min((gold IS NOT DISTINCT FROM pred)::INT) AS ok FROM (SELECT r.source, r.label AS gold, l.label AS pred FROM {_R} r JOIN (SELECT DISTINCT text_id, label FROM labels) l USING (text_id) WHERE r.label IS NOT NULL AND l.label IS NOT NULL) GROUP BY source)""")
def a15_sequence_exact_match(s, d):
    return stats.exact_match_share(_gold_pred(s, d), "source", "gold", "pred")


@query("SELECT service, count(*) AS n FROM (SELECT DISTINCT text_id, unnest(expected.services_mentioned) AS service FROM eval_set_lab11) GROUP BY service")
def a20_nested_counter(s, d):
    return parquet(s, d, "eval_set_lab11").select("text_id", F.explode("expected.services_mentioned").alias("service")).distinct().groupBy("service").agg(F.count("*").alias("n"))


@query("""SELECT field, n FROM (SELECT field, count(*) AS n FROM (SELECT unnest([CASE WHEN expected.issue_type IS NULL THEN 'issue_type' END, CASE WHEN expected.document_type IS NULL THEN 'document_type' END, CASE WHEN expected.date_text IS NULL THEN 'date_text' END, CASE WHEN expected.location_text IS NULL THEN 'location_text' END, CASE WHEN expected.primary_service IS NULL THEN 'primary_service' END]) AS field FROM eval_set_lab11) WHERE field IS NOT NULL GROUP BY field) ORDER BY n DESC, field LIMIT 4""")
def a21_missing_fields(s, d):
    names = ("issue_type", "document_type", "date_text", "location_text", "primary_service")
    miss = F.array_compact(F.array(*[F.when(F.col(f"expected.{n}").isNull(), n) for n in names]))
    return stats.top(parquet(s, d, "eval_set_lab11").select(F.explode(miss).alias("field")), "field", 4)


@query("""SELECT field_type, count(*) AS n, sum((substring(text, start_char + 1, end_char - start_char) = span_text)::INT)::BIGINT AS tp, sum((substring(text, start_char + 1, end_char - start_char) <> span_text)::INT)::BIGINT AS fp,
round(sum((substring(text, start_char + 1, end_char - start_char) = span_text)::INT) / count(*), 6) AS precision FROM (SELECT DISTINCT * FROM lab4_gold_ie_draft) WHERE span_text <> '' AND start_char >= 0 AND end_char >= start_char AND text IS NOT NULL GROUP BY field_type""")
def a22_span_agreement(s, d):
    g = parquet(s, d, "lab4_gold_ie_draft").distinct().where("span_text <> '' AND start_char >= 0 AND end_char >= start_char AND text IS NOT NULL")
    ok = F.expr("substring(text, start_char + 1, end_char - start_char) = span_text")
    return g.groupBy("field_type").agg(F.count("*").alias("n"), F.sum(ok.cast("int")).alias("tp"), F.sum((~ok).cast("int")).alias("fp"), F.round(F.sum(ok.cast("int")) / F.count("*"), 6).alias("precision"))


@query(f"SELECT split, min(posted_at) AS first, max(posted_at) AS last, count(posted_at) AS n FROM raw_reviews JOIN {_S} s USING (text_id) GROUP BY split")
def a23_time_bounds(s, d):
    return parquet(s, d, "raw_reviews").join(_split(s, d), "text_id").groupBy("split").agg(F.min("posted_at").alias("first"), F.max("posted_at").alias("last"), F.count("posted_at").alias("n"))


@query("SELECT count(DISTINCT label) AS labels, count(DISTINCT source) AS sources, count(DISTINCT text_id) AS ids FROM processed_v2_sample")
def a25_distinct_sets(s, d):
    return reviews(s, d).agg(F.count_distinct("label").alias("labels"), F.count_distinct("source").alias("sources"), F.count_distinct("text_id").alias("ids"))


@query("SELECT text_id AS id, label AS category FROM processed_v2_sample")
def proj1_columns(s, d):
    return reviews(s, d).select(F.col("text_id").alias("id"), F.col("label").alias("category"))


@query("SELECT r.text_id, r.label FROM processed_v2_sample r WHERE label IN (SELECT label FROM processed_v2_sample WHERE label IS NOT NULL GROUP BY label ORDER BY count(*) DESC, label LIMIT 5)")
def proj2_topk_filter(s, d):
    r = reviews(s, d)
    return r.join(stats.top(r, "label", 5).select("label"), "label", "left_semi").select("text_id", "label")


@query(r"SELECT text_id FROM processed_v2_sample WHERE regexp_matches(text, '(?i)(паспорт|довідк|свідоцтв)')")
def proj3_regex_filter(s, d):
    return reviews(s, d).where(F.col("text").rlike("(?iU)(паспорт|довідк|свідоцтв)")).select("text_id")


@query(f"SELECT text_id, {_WC}::INT AS words FROM processed_v2_sample WHERE {_WC} < 5")
def proj4_short_text(s, d):
    return reviews(s, d).where(X.is_short("text")).select("text_id", X.word_count("text").alias("words"))


@query(rf"SELECT text_id FROM processed_v2_sample WHERE trim(coalesce(text, ''), ' ') = '' OR regexp_matches(trim(text, ' '), '^\p{{Nd}}+$') OR regexp_matches(trim(text, ' '), '^([^\p{{L}}\p{{M}}\p{{Nd}}\p{{Nl}}\p{{Pc}}\x{{200C}}\x{{200D}}]|_)+$')")
def proj5_garbage(s, d):
    return reviews(s, d).where(X.is_garbage("text")).select("text_id")


_META = r"(?i)(^|[^\p{L}\p{M}\p{Nd}\p{Pc}])(label|class|split|категорія|мітка)" + WS + "*[:=]"
_TEMPLATE = f"(regexp_matches(text, '{_META}') OR contains(lower(text), 'neutral') OR contains(lower(text), 'подяка') OR contains(lower(text), 'скарга') OR contains(lower(text), 'питання'))"
_NAMES = ("Neutral", "Подяка", "Скарга", "Питання")


@query(f"SELECT text_id, label FROM processed_v2_sample WHERE {_TEMPLATE}")
def proj7_template_leak(s, d):
    return splits.template_leaks(reviews(s, d), "text", _NAMES).select("text_id", "label")


@query(f"SELECT text_id, len(list_filter({_TOK}, lambda x: length(x) >= 3))::INT AS n FROM processed_v2_sample WHERE len(list_filter({_TOK}, lambda x: length(x) >= 3)) >= 4")
def proj8_min_tokens(s, d):
    n = F.size(F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: F.length(x) >= 3))
    return reviews(s, d).where(n >= 4).select("text_id", n.alias("n"))


@query("SELECT text_id::VARCHAR AS text_id, coalesce(label, 'none') AS label, coalesce(try_cast(substring(source, length(source) - 2) AS INT), -1) AS source_no FROM processed_v2_sample")
def proj10_casts(s, d):
    return reviews(s, d).select(F.col("text_id").cast("string").alias("text_id"), F.coalesce("label", F.lit("none")).alias("label"), F.coalesce(F.right("source", F.lit(3)).try_cast("int"), F.lit(-1)).alias("source_no"))


@query("SELECT case_id, coalesce(expected.primary_service, 'unknown') AS service, coalesce(nullif(expected_behavior, ''), 'none') AS behavior FROM test_cases_lab13")
def proj11_defaults(s, d):
    return parquet(s, d, "test_cases_lab13").select("case_id", F.coalesce("expected.primary_service", F.lit("unknown")).alias("service"), F.coalesce(F.nullif("expected_behavior", F.lit("")), F.lit("none")).alias("behavior"))


@query("SELECT case_id, coalesce(b.issue_type, a.issue_type) AS issue_type, coalesce(b.date_text, a.date_text) AS date_text FROM (SELECT case_id, expected AS a, CASE WHEN needs_fallback THEN {'issue_type': 'fallback', 'date_text': NULL::VARCHAR} ELSE {'issue_type': NULL::VARCHAR, 'date_text': NULL::VARCHAR} END AS b FROM test_cases_lab13)")
def proj12_struct_merge(s, d):
    """The right struct's fields win where they are set; the rest is dropped."""
    t = parquet(s, d, "test_cases_lab13")
    right = F.when(F.col("needs_fallback"), F.struct(F.lit("fallback").alias("issue_type"), F.lit(None).cast("string").alias("date_text")))
    return t.select("case_id", F.col("expected").alias("a"), right.alias("b")).select("case_id", F.coalesce("b.issue_type", "a.issue_type").alias("issue_type"), F.coalesce("b.date_text", "a.date_text").alias("date_text"))


@query("SELECT text_id, substring(replace(text, chr(10), ' '), 1, 60) AS excerpt FROM processed_v2_sample WHERE text IS NOT NULL")
def proj13_excerpts(s, d):
    return reviews(s, d).where("text IS NOT NULL").select("text_id", X.excerpt("text", 60).alias("excerpt"))


@query("SELECT text_id, CASE label WHEN 'Gratitude / Positive Feedback' THEN 'positive' WHEN 'Complaint / Dissatisfaction' THEN 'negative' ELSE 'other' END AS tone FROM processed_v2_sample")
def proj14_map_lookup(s, d):
    m = F.create_map(F.lit("Gratitude / Positive Feedback"), F.lit("positive"), F.lit("Complaint / Dissatisfaction"), F.lit("negative"))
    return reviews(s, d).select("text_id", F.coalesce(F.try_element_at(m, F.coalesce("label", F.lit(""))), F.lit("other")).alias("tone"))


@query("SELECT r.text_id, r.label AS review_label, l.label FROM processed_v2_sample r JOIN labels l USING (text_id)")
def j1_inner(s, d):
    return reviews(s, d).select("text_id", F.col("label").alias("review_label")).join(parquet(s, d, "labels"), "text_id")


@query(f"SELECT r.text_id, r.source, s.split FROM processed_v2_sample r LEFT JOIN {_S} s USING (text_id)")
def j2_left(s, d):
    return reviews(s, d).select("text_id", "source").join(_split(s, d), "text_id", "left")


@query("""SELECT coalesce(a.label, b.label) AS label, coalesce(a.n, 0)::BIGINT AS reviews, coalesce(b.n, 0)::BIGINT AS labelled FROM (SELECT label, count(*) AS n FROM processed_v2_sample WHERE label IS NOT NULL GROUP BY label) a
FULL JOIN (SELECT label, count(*) AS n FROM labels WHERE label IS NOT NULL GROUP BY label) b ON a.label = b.label""")
def j4_full_outer(s, d):
    a = reviews(s, d).where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("reviews"))
    b = parquet(s, d, "labels").where("label IS NOT NULL").groupBy("label").agg(F.count("*").alias("labelled"))
    return a.join(b, "label", "full").select("label", F.coalesce("reviews", F.lit(0)).alias("reviews"), F.coalesce("labelled", F.lit(0)).alias("labelled"))


@query("SELECT text_id, label FROM processed_v2_sample WHERE text_id IN (SELECT text_id FROM split_ids WHERE split = 'test')")
def j5_semi(s, d):
    return reviews(s, d).join(parquet(s, d, "split_ids").where("split = 'test'"), "text_id", "left_semi").select("text_id", "label")


@query("SELECT DISTINCT text_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM processed_v2_sample r WHERE r.text_id = l.text_id) AND text_id IS NOT NULL")
def j6_anti(s, d):
    return parquet(s, d, "labels").join(reviews(s, d), "text_id", "left_anti").where("text_id IS NOT NULL").select("text_id").distinct()


_W7 = rf"""WITH t AS (SELECT min(text_id) AS doc, text FROM processed_v2_sample WHERE text IS NOT NULL GROUP BY text),
tf AS (SELECT doc, term, count(*) AS tf FROM (SELECT doc, unnest({_TOK}) AS term FROM t) GROUP BY doc, term), n AS (SELECT count(*) AS n FROM t),
idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n HAVING count(*) >= 2),
w AS (SELECT doc, term, tf * idf AS w FROM tf JOIN idf USING (term)), u AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w)"""


def _documents(s, d):
    t = reviews(s, d).where("text IS NOT NULL").groupBy("text").agg(F.min("text_id").alias("doc"))
    return t.select("doc", F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != "").alias("terms"))


def _unit_weights(s, d, sublinear=False):
    t = _documents(s, d)
    counts = features.term_counts(t, "doc", F.col("terms"))
    return features.tfidf(counts, t.agg(F.count("*").alias("n")), 2, 1.0, sublinear)


@query(_W7 + "SELECT a.doc AS doc_a, b.doc AS doc_b, round(sum(a.w * b.w), 6) AS cosine FROM u a JOIN u b ON a.term = b.term AND a.doc < b.doc GROUP BY a.doc, b.doc HAVING round(sum(a.w * b.w), 6) >= 0.95")
def j7_near_duplicate_pairs(s, d):
    """Different texts with a TF-IDF cosine of at least 0.95; equal texts are one document."""
    return similarity.document_pairs(_documents(s, d), 0.95)


@query("SELECT text_id, pos::INT AS pos, service, amount FROM (SELECT text_id, unnest(range(1, least(len(s), len(a)) + 1)) AS pos, s, a FROM (SELECT DISTINCT text_id, expected.services_mentioned AS s, expected.amounts_uah AS a FROM eval_set_lab11)), LATERAL (SELECT s[pos] AS service, a[pos] AS amount)")
def j11_zip(s, d):
    t = parquet(s, d, "eval_set_lab11").select("text_id", F.col("expected.services_mentioned").alias("s"), F.col("expected.amounts_uah").alias("a")).distinct()
    n = F.least(F.size("s"), F.size("a"))
    return t.where(n > 0).select("text_id", F.posexplode(F.slice(F.arrays_zip("s", "a"), F.lit(1), n)).alias("p", "z")).select("text_id", (F.col("p") + 1).alias("pos"), F.col("z.s").alias("service"), F.col("z.a").alias("amount"))


@query("""WITH t AS (SELECT DISTINCT expected.issue_type AS g, unnest(expected.services_mentioned) AS s FROM eval_set_lab11), k AS (SELECT g, count(*) AS n FROM t WHERE g IS NOT NULL GROUP BY g)
SELECT a.g AS a, b.g AS b, round(count(*) / (ka.n + kb.n - count(*)), 6) AS jaccard FROM t a JOIN t b ON a.s = b.s AND a.g < b.g JOIN k ka ON ka.g = a.g JOIN k kb ON kb.g = b.g GROUP BY a.g, b.g, ka.n, kb.n HAVING count(*) / (ka.n + kb.n - count(*)) >= 0.5""")
def j12_set_overlap(s, d):
    """Sets meet by their members; a set's size is counted beside it."""
    t = parquet(s, d, "eval_set_lab11").select(F.col("expected.issue_type").alias("g"), F.explode("expected.services_mentioned").alias("s")).where("g IS NOT NULL").distinct()
    x = t.join(t.groupBy("g").agg(F.count("*").alias("n")), "g")
    both = x.withColumnsRenamed({"g": "a", "n": "na"}).join(x.withColumnsRenamed({"g": "b", "n": "nb"}), "s").where("a < b").groupBy("a", "b", "na", "nb").agg(F.count("*").alias("k"))
    j = F.col("k") / (F.col("na") + F.col("nb") - F.col("k"))
    return both.where(j >= 0.5).select("a", "b", F.round(j, 6).alias("jaccard"))


@query("SELECT text_id, 'review' AS kind FROM processed_v2_sample UNION ALL SELECT text_id, 'raw' FROM raw_reviews")
def u1_union(s, d):
    return union_available([reviews(s, d).select("text_id", F.lit("review").alias("kind")), parquet(s, d, "raw_reviews").select("text_id", F.lit("raw").alias("kind"))])


@query("SELECT text_id, loaded_at, attempt FROM (SELECT *, row_number() OVER (PARTITION BY text_id ORDER BY loaded_at, attempt) AS r FROM raw_reviews) WHERE r = 1")
def u2_dedup_keep_first(s, d):
    return parquet(s, d, "raw_reviews").groupBy("text_id").agg(F.min(F.struct("loaded_at", "attempt")).alias("b")).select("text_id", "b.loaded_at", "b.attempt")


@query(f"""WITH t AS (SELECT DISTINCT text, split FROM {_R} r JOIN {_S} s USING (text_id) WHERE text IS NOT NULL)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM t a JOIN t b ON a.text = b.text AND a.split < b.split GROUP BY ALL""")
def u3_exact_leaks(s, d):
    return splits.exact_leaks(_distinct(s, d).join(_split(s, d), "text_id"), F.col("text"), "split")


@query(f"""WITH t AS (SELECT DISTINCT source, split FROM {_R} r JOIN {_S} s USING (text_id) WHERE source IS NOT NULL)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS n FROM t a JOIN t b ON a.source = b.source AND a.split < b.split GROUP BY ALL""")
def u4_group_overlap(s, d):
    return splits.exact_leaks(_distinct(s, d).join(_split(s, d), "text_id"), F.col("source"), "split")


@query("SELECT case_id, array_to_string(list_sort(list_filter(['date', 'amount', 'document', 'noisy'], lambda x: NOT coalesce(list_contains(tags, x), false))), ',') AS missing FROM test_cases_lab13")
def u5_key_difference(s, d):
    want = F.array(*[F.lit(x) for x in ("amount", "date", "document", "noisy")])
    return parquet(s, d, "test_cases_lab13").select("case_id", F.array_join(F.array_except(want, F.coalesce("tags", F.array().cast("array<string>"))), ",").alias("missing"))


_H = lambda col, seed=42: f"sha256({col}::VARCHAR || '|{seed}')"


@query(f"SELECT text_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_H('text_id')}, text_id) AS r FROM (SELECT DISTINCT text_id, label FROM processed_v2_sample WHERE label IS NOT NULL)) WHERE r <= 50")
def w2_stratified_sample(s, d):
    return splits.stratified_sample(reviews(s, d).select("text_id", "label").where("label IS NOT NULL").distinct(), "label", 50)


@query("SELECT label, text_id, n, rank FROM (SELECT label, text_id, length(text) AS n, row_number() OVER (PARTITION BY label ORDER BY length(text) DESC, text_id) AS rank FROM (SELECT DISTINCT text_id, text, label FROM processed_v2_sample WHERE text IS NOT NULL AND label IS NOT NULL)) WHERE rank <= 5")
def w3_rank_in_group(s, d):
    w = Window.partitionBy("label").orderBy(F.desc("n"), "text_id")
    x = reviews(s, d).where("text IS NOT NULL AND label IS NOT NULL").select("label", "text_id", F.length("text").cast("bigint").alias("n")).distinct()
    return x.withColumn("rank", F.row_number().over(w).cast("bigint")).where("rank <= 5")


_SC = "(SELECT event_id, value AS score, (event_type = 'purchase')::INT AS y FROM events WHERE value IS NOT NULL)"


def _scores(s, d):
    return parquet(s, d, "events").where("value IS NOT NULL").select("event_id", F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("y"))


@query(f"""SELECT threshold, tp::BIGINT AS tp, (k - tp)::BIGINT AS fp, round(tp / k, 6) AS precision, round(coalesce(tp / nullif(p, 0), 0), 6) AS recall FROM (SELECT score AS threshold, sum(sum(y)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS k, sum(sum(y)) OVER () AS p FROM {_SC} GROUP BY score)""")
def w6_pr_curve(s, d):
    return metrics.pr_curve(_scores(s, d))


@query(f"""SELECT round(sum(pos / p * tp / k), 6) AS average_precision FROM (SELECT sum(y) AS pos, sum(sum(y)) OVER (ORDER BY score DESC) AS tp, sum(count(*)) OVER (ORDER BY score DESC) AS k, sum(sum(y)) OVER () AS p FROM {_SC} GROUP BY score)""")
def w7_average_precision(s, d):
    return metrics.average_precision(_scores(s, d))


@query(f"""WITH t AS (SELECT unnest([5.0, 20.0, 50.0, 100.0]::DOUBLE[]) AS threshold), c AS (SELECT threshold, sum((score >= threshold)::INT) AS k, sum(CASE WHEN score >= threshold THEN y ELSE 0 END) AS tp, sum(y) AS p FROM {_SC}, t GROUP BY threshold),
m AS (SELECT threshold, k, coalesce(tp / nullif(k, 0), 0) AS pr, coalesce(tp / nullif(p, 0), 0) AS re FROM c)
SELECT threshold, k::BIGINT AS predicted_positive, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1 FROM m""")
def o5_threshold_sweep(s, d):
    return metrics.threshold_sweep(_scores(s, d), (5.0, 20.0, 50.0, 100.0))


@query("""WITH r AS (SELECT event_id AS id, row_number() OVER (ORDER BY ts, event_id) AS r, count(*) OVER () AS n FROM events WHERE ts IS NOT NULL)
SELECT id, CASE WHEN r <= round(n * 0.8) THEN 'train' WHEN r <= round(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM r""")
def w8_time_split(s, d):
    return splits.by_time(parquet(s, d, "events"), "ts", SPLITS).select("id", "split")


@query("SELECT text_id, source, attempt FROM raw_reviews ORDER BY attempt DESC, source, text_id, loaded_at LIMIT 25")
def o1_multi_key_top(s, d):
    """A top-k report."""
    return parquet(s, d, "raw_reviews").orderBy(F.desc("attempt"), "source", "text_id", "loaded_at").limit(25).select("text_id", "source", "attempt")


@query(f"""WITH r AS (SELECT text_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY {_H('text_id')}, text_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT text_id, label FROM processed_v2_sample WHERE label IS NOT NULL))
SELECT id, label, CASE WHEN r <= round(n * 0.8) THEN 'train' WHEN r <= round(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM r""")
def d2_stratified_split(s, d):
    return splits.stratified(reviews(s, d).select("text_id", "label").where("label IS NOT NULL").distinct(), "label", SPLITS)


@query(f"""WITH g AS (SELECT source, row_number() OVER (ORDER BY {_H('source')}, source) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM processed_v2_sample WHERE source IS NOT NULL)),
a AS (SELECT source, CASE WHEN r <= round(n * 0.8) THEN 'train' WHEN r <= round(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM g)
SELECT split, count(DISTINCT source) AS groups, count(*) AS n FROM (SELECT DISTINCT text_id, source FROM processed_v2_sample) JOIN a USING (source) GROUP BY split""")
def d3_group_split(s, d):
    x = splits.grouped(reviews(s, d).select("text_id", "source").distinct(), "source", SPLITS)
    return x.groupBy("split").agg(F.count_distinct("source").alias("groups"), F.count("*").alias("n"))


@query("SELECT label, round(n / (k * c), 6) AS weight FROM (SELECT label, count(*) AS c, sum(count(*)) OVER () AS n, count(*) OVER () AS k FROM processed_v2_sample WHERE label IS NOT NULL GROUP BY label)")
def m7_class_weights(s, d):
    return features.class_weights(reviews(s, d), "label")


@query(_W7 + "SELECT term, round(sum(w), 4) AS weight FROM u GROUP BY term ORDER BY round(sum(w), 4) DESC, term LIMIT 20")
def m1_tfidf_top_terms(s, d):
    w = _unit_weights(s, d).groupBy("term").agg(F.round(F.sum("weight"), 4).alias("weight"))
    return w.orderBy(F.desc("weight"), "term").limit(20)


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT query_id, id, cosine, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM p) WHERE rank <= 10""")
def m12_vector_topk(s, d):
    """A search: the queries are the vectors whose id is divisible by 100, against all vectors."""
    v = parquet(s, d, "embeddings")
    return features.nearest(v, v.where("vec_id % 100 = 0"), 10)


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events WHERE ts IS NOT NULL GROUP BY ALL")
def s1_windowed_counts(s, d):
    from ..streaming.messages import windowed_counts

    return windowed_counts(parquet(s, d, "events"))


_ND = rf"""{_W7}, pairs AS (SELECT a.doc AS i, b.doc AS j FROM u a JOIN u b ON a.term = b.term AND a.doc < b.doc GROUP BY a.doc, b.doc HAVING round(sum(a.w * b.w), 6) >= 0.95), s AS {_S}"""


@query(f"""{_ND}, r AS (SELECT * FROM {_R} x JOIN s USING (text_id)), e AS (SELECT split, min(posted_at) AS lo, max(posted_at) AS hi FROM raw_reviews JOIN s USING (text_id) GROUP BY split)
SELECT 'exact' AS kind, split_a, split_b, count(*) AS n FROM (SELECT DISTINCT a.text, a.split AS split_a, b.split AS split_b FROM r a JOIN r b ON a.text = b.text AND a.split < b.split) GROUP BY ALL
UNION ALL SELECT 'group', split_a, split_b, count(*) FROM (SELECT DISTINCT a.source, a.split AS split_a, b.split AS split_b FROM (SELECT DISTINCT source, split FROM r) a JOIN (SELECT DISTINCT source, split FROM r) b ON a.source = b.source AND a.split < b.split) GROUP BY ALL
UNION ALL SELECT 'template', split, split, count(*) FROM r WHERE {_TEMPLATE} GROUP BY split
UNION ALL SELECT 'near', least(x.split, y.split), greatest(x.split, y.split), count(*) FROM pairs JOIN s x ON x.text_id = i JOIN s y ON y.text_id = j WHERE x.split <> y.split GROUP BY ALL
UNION ALL SELECT 'time', a.split, b.split, (a.hi > b.lo)::BIGINT FROM e a, e b WHERE a.split = 'train' AND b.split IN ('val', 'test')""")
def d6_leakage_report(s, d):
    """Exact, near, group, template and time leakage between the splits in one table."""
    sp = _split(s, d)
    rows = reviews(s, d).select("text_id", "text", "label", "source").join(sp, "text_id")
    p = similarity.document_pairs(_documents(s, d), 0.95)
    near = p.join(sp.select(F.col("text_id").alias("doc_a"), F.col("split").alias("x")), "doc_a").join(sp.select(F.col("text_id").alias("doc_b"), F.col("split").alias("y")), "doc_b").where("x <> y").select(F.least("x", "y").alias("split_a"), F.greatest("x", "y").alias("split_b"))
    times = parquet(s, d, "raw_reviews").join(sp, "text_id").select("split", F.col("posted_at").alias("time"))
    return splits.leakage_report(rows, near, times, _NAMES)


@query(r"SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(label), '[^\p{L}]+')) AS word FROM label_targets UNION SELECT unnest(string_split_regex(lower(canonical_name), '[^\p{L}]+')) FROM location_ref) WHERE word <> ''")
def u6_vocabulary_union(s, d):
    """The words of two vocabularies, each once."""
    words = lambda df, c: df.select(F.explode(F.split(F.lower(c), r"[^\p{L}]+")).alias("word")).where("word <> ''")
    return words(parquet(s, d, "label_targets"), "label").unionByName(words(parquet(s, d, "location_ref"), "canonical_name")).distinct()


def _sql_splits(seed: int) -> str:
    return f"""(SELECT text_id AS id, label, CASE WHEN r <= round(n * 0.8) THEN 'train' WHEN r <= round(n * 0.9) THEN 'val' ELSE 'test' END AS split FROM (SELECT text_id, label, row_number() OVER (PARTITION BY label ORDER BY {_H('text_id', seed)}, text_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT text_id, label FROM processed_v2_sample WHERE label IS NOT NULL)))"""


@query(f"SELECT 'same seed' AS run, 0::BIGINT AS only_a, 0::BIGINT AS only_b UNION ALL SELECT 'other seed', count(*), count(*) FROM {_sql_splits(42)} a JOIN {_sql_splits(43)} b ON a.id = b.id AND a.label = b.label WHERE a.split <> b.split")
def u7_determinism(s, d):
    """Rows in which two runs of a split differ: of one seed, over other partitions, and of two seeds."""
    r = reviews(s, d).select("text_id", "label").where("label IS NOT NULL").distinct()
    one = splits.stratified(r, "label", SPLITS)
    again, other = splits.stratified(r.repartition(7, "label"), "label", SPLITS), splits.stratified(r, "label", SPLITS, seed=43)
    return splits.differences(one, again).select(F.lit("same seed").alias("run"), "only_a", "only_b").unionByName(splits.differences(one, other).select(F.lit("other seed").alias("run"), "only_a", "only_b"))


@query(f"SELECT text_id, gold, pred FROM (SELECT r.text_id, r.label AS gold, l.label AS pred FROM {_R} r JOIN (SELECT DISTINCT text_id, label FROM labels) l USING (text_id)) WHERE gold <> pred ORDER BY text_id, gold, pred LIMIT 100")
def o2_first_errors(s, d):
    """The first hundred wrong rows: a top-k report."""
    return _gold_pred(s, d).where("gold <> pred").orderBy("text_id", "gold", "pred").limit(100).select("text_id", "gold", "pred")


@query(f"SELECT text_id FROM (SELECT DISTINCT text_id FROM processed_v2_sample) ORDER BY {_H('text_id')}, text_id LIMIT 50")
def o4_seeded_sample(s, d):
    """A sampling operator: fifty ids by hash order."""
    return splits.sample(reviews(s, d).select("text_id").distinct(), 50)


@query("SELECT vec_id, embedding[label % 4 + 1] AS score, CASE WHEN label % 2 = 1 THEN embedding[1] ELSE -embedding[1] END AS binary_score FROM embeddings")
def o6_class_scores(s, d):
    """The score of a row's own class among one-vs-rest scores, and of two classes that share one."""
    v = parquet(s, d, "embeddings")
    return v.select("vec_id", metrics.class_score(F.col("embedding"), F.col("label") % 4, 4).alias("score"), metrics.class_score(F.col("embedding"), F.col("label") % 2, 2).alias("binary_score"))


_BIGRAMS = rf"""(SELECT doc, unnest(list_concat(t, list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]))) AS term FROM (SELECT min(text_id) AS doc, {_TOK} AS t FROM processed_v2_sample WHERE text IS NOT NULL GROUP BY text))"""


@query(f"""WITH tf AS (SELECT doc, term, count(*) AS tf FROM {_BIGRAMS} GROUP BY doc, term), n AS (SELECT count(DISTINCT text) AS n FROM processed_v2_sample WHERE text IS NOT NULL),
idf AS (SELECT term, ln((1 + n) / (1 + count(*))) + 1 AS idf FROM tf, n GROUP BY term, n HAVING count(*) >= 2), w AS (SELECT doc, term, (1 + ln(tf)) * idf AS w FROM tf JOIN idf USING (term)), u AS (SELECT doc, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc)) AS w FROM w)
SELECT term, count(*) AS docs, round(sum(w), 4) AS weight FROM u GROUP BY term HAVING count(*) >= 5""")
def m1_tfidf_bigrams(s, d):
    """Sublinear TF-IDF of words and pairs of words: the weight of each term in all texts."""
    t = reviews(s, d).where("text IS NOT NULL").groupBy("text").agg(F.min("text_id").alias("doc"))
    terms = t.withColumn("t", F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda x: x != ""))
    counts = features.term_counts(terms, "doc", features.ngrams("t", 1, 2))
    w = features.tfidf(counts, t.agg(F.count("*").alias("n")), 2, 1.0, True)
    return w.groupBy("term").agg(F.count("*").alias("docs"), F.round(F.sum("weight"), 4).alias("weight")).where("docs >= 5")
