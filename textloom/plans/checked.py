"""Registered queries: validation, repair, evaluation, the message flow, and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import flow, metrics, models, splits, tagging, validation
from ..operators.validation import Rule
from ..sources.readers import parquet
from .relational import _unit_weights, reviews
from .textual import _tokens

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

RULES = (
    Rule("primary_service", "string", nullable=True), Rule("services_mentioned", "array", unique=True), Rule("issue_type", "string", nullable=True), Rule("document_type", "string", nullable=True),
    Rule("amounts_uah", "array", items="number", minimum=0), Rule("date_text", "string", nullable=True), Rule("location_text", "string", nullable=True),
)


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


def _answers(s, d):
    """Answers as a model may give them: valid, fenced, with trailing words, with a list as text, or without a field, by the hash of the text."""
    e = parquet(s, d, "eval_set_lab11").where("text IS NOT NULL AND expected IS NOT NULL").select("text_id", "text", "expected").distinct()
    full = F.to_json("expected", {"ignoreNullFields": "false"})
    mode = X.sha_mod6("text")
    less = F.to_json(F.struct(*[F.col(f"expected.{n}") for n in ("primary_service", "services_mentioned", "issue_type", "document_type", "amounts_uah", "date_text")]), {"ignoreNullFields": "false"})
    listed = F.to_json(F.struct(F.col("expected.primary_service"), F.array_join(F.coalesce("expected.services_mentioned", F.array().cast("array<string>")), ",").alias("services_mentioned"), *[F.col(f"expected.{n}") for n in ("issue_type", "document_type", "amounts_uah", "date_text", "location_text")]), {"ignoreNullFields": "false"})
    raw = F.when(mode < 2, full).when(mode == 2, F.concat(F.lit("```json\n"), full, F.lit("\n```"))).when(mode == 3, listed).when(mode == 4, less).otherwise(F.concat(full, F.lit(" That is all.")))
    return e.select("text_id", "expected", mode.alias("mode"), full.alias("full"), raw.alias("raw"))


_MODE = "((4 * list_sum(list_transform(string_split(substring(sha256(text), 1, 63), ''), lambda x: ('0x' || x)::INT)) + ('0x' || substring(sha256(text), 64, 1))::INT)::INT % 6)"
_E = "(SELECT DISTINCT text_id, text, expected FROM eval_set_lab11 WHERE text IS NOT NULL AND expected IS NOT NULL)"
_BASE_OK = "(expected.services_mentioned IS NOT NULL AND expected.amounts_uah IS NOT NULL AND len(list_distinct(expected.services_mentioned)) = len(expected.services_mentioned) AND NOT list_bool_or(list_transform(expected.amounts_uah, lambda x: x < 0)))"


@query(f"""SELECT mode, count(*) AS n, sum((mode IN (0, 1, 3, 4))::INT)::BIGINT AS parsed FROM (SELECT {_MODE} AS mode FROM {_E}) GROUP BY mode""")
def v6_faulty_answers(s, d):
    """Answers by fault mode, and how many parse as JSON."""
    a = _answers(s, d).withColumn("v", validation.validate("raw", RULES))
    return a.groupBy("mode").agg(F.count("*").alias("n"), F.sum(F.col("v.parse_ok").cast("int")).alias("parsed"))


@query()
def v1_schema_validation(s, d):
    """(text_id, mode, parse_ok, schema_ok, error_type, first error): rows-only, as JSON typing differs between engines; tested on fixtures."""
    a = _answers(s, d).withColumn("v", validation.validate("raw", RULES))
    return a.select("text_id", "mode", "v.parse_ok", "v.schema_ok", "v.error_type", F.try_element_at("v.errors", F.lit(1))["path"].alias("first_path"))


@query(f"SELECT count(*) AS answers, round(avg((mode >= 2)::INT), 6) AS repair_needed FROM (SELECT {_MODE} AS mode, expected FROM {_E}) WHERE coalesce({_BASE_OK}, len(expected.amounts_uah) = 0 AND expected.services_mentioned IS NOT NULL AND len(list_distinct(expected.services_mentioned)) = len(expected.services_mentioned))")
def v7_repair_rates(s, d):
    """Over answers whose full form is valid: the share that needed repair."""
    a = _answers(s, d).withColumn("base", validation.validate("full", RULES)["schema_ok"]).where("base")
    r = a.withColumn("r", validation.repaired("raw", RULES, F.col("full")))
    return r.agg(F.count("*").alias("answers"), F.round(F.avg((F.col("r.repairs_used") > 0).cast("int")), 6).alias("repair_needed"))


_FIELDS = ("primary_service", "issue_type", "document_type", "date_text", "location_text")


@query("""WITH p AS (SELECT case_id, expected AS a, expected_route AS r FROM test_cases_lab13), m AS (SELECT case_id, (a.primary_service IS DISTINCT FROM 'unknown')::INT + (a.issue_type IS DISTINCT FROM 'queue')::INT + (a.document_type IS NOT NULL)::INT + (a.date_text IS NOT NULL)::INT + (a.location_text IS NOT NULL)::INT AS n FROM p)
SELECT rating, count(*) AS n FROM (SELECT CASE WHEN n = 0 THEN 'correct' WHEN 5 - n >= 4 THEN 'partly' ELSE 'wrong' END AS rating FROM m) GROUP BY rating""")
def v9_field_rating(s, d):
    """A constant answer against the expected fields: NULL equals NULL."""
    t = parquet(s, d, "test_cases_lab13")
    none = F.lit(None).cast("string")
    guess = F.struct(F.lit("unknown").alias("primary_service"), F.lit("queue").alias("issue_type"), none.alias("document_type"), none.alias("date_text"), none.alias("location_text"))
    m = metrics.field_matches(F.col("expected"), guess, _FIELDS)
    return t.select(metrics.rating(m, 5).alias("rating")).groupBy("rating").agg(F.count("*").alias("n"))


@query(r"""SELECT count(*) AS sentences, sum((len(t) = 0)::INT)::BIGINT AS without_tokens, sum((len(list_filter(t, lambda w: regexp_matches(w, '[0-9]') AND regexp_matches(w, '\p{L}'))) > 0)::INT)::BIGINT AS with_bad_tags FROM (SELECT regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\v]+') AS t FROM processed_v2_sample)""")
def v5_token_output(s, d):
    """Sentences without tokens, and with a token whose tag is none of the closed set: a word with digits and letters is tagged MIXED."""
    tag = lambda f: F.when(f.rlike("[0-9]") & f.rlike(r"\p{L}"), "MIXED").when(f.rlike("[0-9]"), "NUM").otherwise("X")
    t = reviews(s, d).select(F.transform(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[^ \t\n\r\f\x0b]+"), 0), lambda f: F.struct(f.alias("form"), tag(f).alias("upos"))).alias("tokens"))
    return t.agg(F.count("*").alias("sentences"), F.count_if(F.size("tokens") == 0).alias("without_tokens"), F.count_if(F.size(validation.invalid_tokens("tokens")) > 0).alias("with_bad_tags"))


def _flow(s, d):
    t = parquet(s, d, "test_cases_lab13").select("case_id", F.coalesce("input", F.lit("")).alias("input"))
    x = t.withColumn("clean", F.lower(X.clean("input"))).withColumn("number", F.regexp_extract("clean", r"№ ?([0-9]+)", 1)).withColumn("question", F.col("clean").contains("?"))
    signals = F.concat_ws("; ", F.when(F.col("number") != "", "number"), F.when(F.col("question"), "question"), F.when(F.col("clean").contains("грн"), "amount"))
    x = x.withColumn("signals", signals)
    stages = (
        flow.Stage("ingest", F.col("clean") != "", F.length("clean")),
        flow.Stage("route", F.col("signals") != "", F.col("signals")),
        flow.Stage("execute", F.col("number") != "", F.col("number"), needs=F.col("signals").contains("number")),
        flow.Stage("validate", F.length("number") <= 6, F.length("number"), needs=F.col("number") != ""),
        flow.Stage("export", F.lit(True), F.lit("done")),
    )
    return flow.run(x, stages)


_WS = r"[\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_FLOW = rf"""(SELECT case_id, clean, number, sig, CASE WHEN clean = '' OR sig = '' OR (number <> '' AND length(number) > 6) THEN 'safe_failure' ELSE 'exported' END AS status,
CASE WHEN clean = '' THEN 1 WHEN sig = '' THEN 2 WHEN number <> '' AND length(number) > 6 THEN 4 WHEN number <> '' THEN 5 ELSE 3 END AS steps FROM
(SELECT *, concat_ws('; ', CASE WHEN number <> '' THEN 'number' END, CASE WHEN contains(clean, '?') THEN 'question' END, CASE WHEN contains(clean, 'грн') THEN 'amount' END) AS sig FROM
(SELECT *, regexp_extract(clean, '№ ?([0-9]+)', 1) AS number FROM (SELECT case_id, lower(trim(regexp_replace(coalesce(input, ''), '{_WS}+', ' ', 'g'))) AS clean FROM test_cases_lab13))))"""


@query(f"SELECT case_id, status, sig AS signals, steps::INT AS n_steps FROM {_FLOW}")
def flow_messages(s, d):
    """Each message through ingest, route, execute, validate and export, with its status and number of steps."""
    return _flow(s, d).select("case_id", "status", "signals", F.size("steps").alias("n_steps"))


@query(f"SELECT step_no::INT AS step_no, status, count(*) AS n FROM (SELECT status, unnest(range(0, steps)) AS step_no FROM {_FLOW}) GROUP BY ALL")
def f9_flow_log(s, d):
    f = _flow(s, d)
    return flow.log(f.withColumnRenamed("status", "final"), "case_id").drop("status").join(f.select("case_id", "status"), "case_id").groupBy("step_no", "status").agg(F.count("*").alias("n"))


@query(f"SELECT count(*) AS cases, round(avg((status = 'exported')::INT), 6) AS completion, round(avg(steps), 6) AS avg_steps FROM {_FLOW}")
def a19_flow_metrics(s, d):
    return flow.summary(_flow(s, d))


def _splits(s, d):
    r = reviews(s, d).where("text IS NOT NULL AND label IS NOT NULL").select("text_id", "text", F.regexp_replace(F.lower(X.clean("label")), " ?/ ?", " / ").alias("label")).distinct()
    x = r.join(parquet(s, d, "split_ids").distinct(), "text_id")
    return x.where("split = 'train'"), x.where("split = 'test'")


@query()
def m5_logistic(s, d):
    """Report of logistic regression, fitted on the training split, on the test split."""
    train, test = _splits(s, d)
    return metrics.report(models.logistic(train, test).withColumnRenamed("label", "gold"))


@query()
def m6_linear_svm(s, d):
    """The same of linear support vector machines."""
    train, test = _splits(s, d)
    return metrics.report(models.linear_svm(train, test).withColumnRenamed("label", "gold"))


@query()
def m9_lda(s, d):
    t = reviews(s, d).select("text_id", "text").distinct().withColumn("tokens", X.topic_tokens("text")).where(F.size("tokens") >= 4)
    return models.lda(t, "tokens", k=5, iterations=30)[1]


@query()
def m8_lsa(s, d):
    return models.lsa(_unit_weights(s, d), k=4, vocabulary=None)


@query()
def m10_word2vec(s, d):
    t = reviews(s, d).select("text").distinct().withColumn("tokens", X.embedding_tokens("text"))
    return models.word2vec(t, "tokens", size=100, iterations=20)


@query()
def m17_crf(s, d):
    """Tags of the sentences whose number ends in 0 or 5, by a CRF trained on the others: a train and test split."""
    t = _tokens(s, d).groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("token_id", "form", "upos"))).alias("z")).select("sentence_id", F.col("z.form").alias("forms"), F.col("z.upos").alias("tags"))
    train = t.where("sentence_id % 5 <> 0")
    model = tagging.train_crf(train, ["NUM", "PROPN", "PUNCT", "X"], rounds=200)
    p = tagging.tag_by_crf(t.where("sentence_id % 5 = 0").select("sentence_id", "forms", F.col("tags").alias("gold")), model, ("sentence_id", "gold"))
    z = p.select(F.explode(F.arrays_zip("gold", "pred")).alias("z")).select("z.gold", "z.pred")
    return metrics.report(z)
