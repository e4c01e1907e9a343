"""Core operators on small fixtures."""

import json
import math
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.operators import evaluation, features, flow, metrics, models, similarity, splits, tagging, validation
from textloom.operators.validation import Rule
from textloom.sources import readers, writers
from textloom.streaming import messages


def test_stratified_split_is_exact_and_deterministic(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(300)], "text_id BIGINT, label STRING")
    one = splits.stratified(df, "label", {"train": 0.8, "val": 0.1, "test": 0.1})
    two = splits.stratified(df.orderBy(F.desc("text_id")), "label", {"train": 0.8, "val": 0.1, "test": 0.1})
    assert one.exceptAll(two).isEmpty() and two.exceptAll(one).isEmpty()
    n = {(r.label, r.split): r["count"] for r in one.groupBy("label", "split").count().collect()}
    assert n == {("b", "train"): 80, ("b", "val"): 10, ("b", "test"): 10, ("a", "train"): 160, ("a", "val"): 20, ("a", "test"): 20}
    with pytest.raises(ValueError):
        splits.stratified(df, "label", {"train": 0.8})
    with pytest.raises(ValueError):
        splits.grouped(df, "nothing", {"train": 1.0})


def test_groups_do_not_cross(spark):
    df = spark.createDataFrame([(i, f"g{i % 17}") for i in range(200)], "text_id BIGINT, source STRING")
    s = splits.grouped(df, "source", {"train": 0.7, "test": 0.3})
    assert s.groupBy("source").agg(F.count_distinct("split").alias("n")).where("n > 1").isEmpty() and s.count() == 200


def test_cosine_pairs_match_brute_force(spark):
    rng = np.random.default_rng(0)
    base = rng.random((12, 30)) * (rng.random((12, 30)) < 0.5)
    docs = np.vstack([base, base + 0.03 * (rng.random(base.shape) < 0.2)])
    docs /= np.linalg.norm(docs, axis=1, keepdims=True)
    df = spark.createDataFrame([(int(i), f"t{j}", float(docs[i, j])) for i, j in zip(*np.nonzero(docs))], "doc INT, term STRING, weight DOUBLE")
    got = {(r.doc_a, r.doc_b) for r in similarity.cosine_pairs(df, 0.95).collect()}
    assert got == {(i, j) for i in range(24) for j in range(i + 1, 24) if docs[i] @ docs[j] >= 0.95}


@pytest.mark.parametrize("threshold,most", [(0.95, 1000), (0.8, 1000), (0.8, 20), (0.3, 1000)])
def test_document_pairs_match_the_cosine_join(spark, threshold, most):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(60):
        base = [f"t{int(x)}" for x in rng.zipf(1.5, 12) % 60]
        rows += [(3 * i + k, base[k:] + ["t1"] * k) for k in range(3)]
    rows += [(0, ["t7", "t8"]), (None, ["t7", "t9"]), (None, ["t9"]), (500, []), (501, ["only"])]
    df = spark.createDataFrame(rows, "doc BIGINT, terms ARRAY<STRING>")
    counts = features.term_counts(df, "doc", F.col("terms"))
    want = similarity.cosine_pairs(features.tfidf(counts, df.agg(F.count("*").alias("n")), 2, 1.0, False), threshold).collect()
    got = similarity.document_pairs(df, threshold, most=most).collect()
    assert want and sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_leakage_report_counts_repeated_rows_once(spark):
    rows = [(1, "label: x", "s", "train"), (1, "label: x", "s", "train"), (2, "label: x", "s", "test"), (2, "label: x", "s", "test"), (3, "y", "z", "val")]
    df = spark.createDataFrame(rows, "text_id INT, text STRING, source STRING, split STRING")
    near = spark.createDataFrame([], "split_a STRING, split_b STRING")
    got = {tuple(r) for r in splits.leakage_report(df, near, df.select("split", F.lit(1).alias("time")), ("nothing",)).collect()}
    assert got == {("exact", "test", "train", 1), ("group", "test", "train", 1), ("template", "train", "train", 1), ("template", "test", "test", 1), ("time", "train", "test", 0), ("time", "train", "val", 0)}


@pytest.mark.parametrize("name,megabytes", [("j7_near_duplicate_pairs", 5), ("d6_leakage_report", 10)])
def test_near_duplicates_shuffle_little(spark, name, megabytes):
    from textloom.plans import registry

    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).head().totalShuffleWrite()
    before = written()
    registry.QUERIES[name](spark, "/root/testdata/sf0.01").collect()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(10_000)
    assert written() - before < megabytes * 1e6


def test_tfidf_is_the_smooth_formula(spark):
    docs = {1: ["a", "b", "a"], 2: ["a", "c"], 3: ["b", "c", "c"]}
    df = spark.createDataFrame([(k, v) for k, v in docs.items()], "d INT, t ARRAY<STRING>")
    got = {(r.doc, r.term): r.weight for r in features.tfidf(features.term_counts(df, "d", F.col("t")), df.agg(F.count("*").alias("n")), 1, 1.0, True).collect()}
    idf = math.log(4 / 3) + 1
    raw = {"a": (1 + math.log(2)) * idf, "b": idf}
    norm = math.sqrt(sum(x * x for x in raw.values()))
    assert got[1, "a"] == pytest.approx(raw["a"] / norm) and got[1, "b"] == pytest.approx(raw["b"] / norm)


def test_ngrams(spark):
    df = spark.createDataFrame([(["a", "b", "c"], "ab d"), ([], None)], "t ARRAY<STRING>, s STRING").select(features.ngrams("t").alias("n"), features.char_ngrams("s").alias("g")).collect()
    assert df[0].n == ["a", "b", "c", "a b", "b c"] and df[1].n == [] and df[1].g == []
    assert sorted(df[0].g) == sorted([" ab", "ab ", " ab ", " d "])


def test_report_and_curve(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "gold STRING, pred STRING")
    r = {x.label: x for x in metrics.report(df).collect()}
    assert r["a"].precision == 0.5 and r["a"].recall == 0.5 and r["c"].f1 == 0.0 and r["accuracy"].f1 == 0.5
    s = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.8, 1), (0.1, 0)], "score DOUBLE, y INT")
    c = [(x.threshold, x.tp, x.fp) for x in metrics.pr_curve(s).orderBy(F.desc("threshold")).collect()]
    assert c == [(0.9, 1, 0), (0.8, 2, 1), (0.1, 2, 2)]
    assert metrics.average_precision(s).first()[0] == pytest.approx(0.5 * 1 + 0.5 * 2 / 3, abs=1e-6)


def test_span_comparison(spark):
    g = spark.createDataFrame([(1, 0, 5, "A"), (1, 10, 15, "A"), (1, 20, 25, "B"), (2, 0, 3, "A")], "doc INT, start_char INT, end_char INT, label STRING")
    p = spark.createDataFrame([(1, 0, 5, "A"), (1, 11, 16, "A"), (1, 20, 25, "A"), (1, 40, 45, "A")], "doc INT, start_char INT, end_char INT, label STRING")
    n = {r.category: r["count"] for r in metrics.span_comparison(g, p).groupBy("category").count().collect()}
    assert n == {"exact": 1, "boundary": 1, "type": 1, "missed": 1, "false_positive": 1}


def test_validation(spark):
    rules = (Rule("a", "string"), Rule("b", "array", items="number", minimum=0), Rule("c", "string", nullable=True, enum=("x", "y")), Rule("d", "array", unique=True))
    good = {"a": "s", "b": [1, 2.5], "c": None, "d": ["p", "q"]}
    cases = [
        (json.dumps(good), None), ("not json", "parse"), (json.dumps(good) + " tail", "parse"), ("[1]", "parse"), (None, "parse"),
        (json.dumps({k: v for k, v in good.items() if k != "a"}), "missing"), (json.dumps(good | {"a": 5}), "wrong_type"), (json.dumps(good | {"z": 1}), "extra"), (json.dumps(good | {"c": "w"}), "other"),
        (json.dumps(good | {"b": [-1]}), "other"), (json.dumps(good | {"d": ["p", "p"]}), "other"), (json.dumps(good | {"b": ["k"]}), "wrong_type"),
    ]
    df = spark.createDataFrame([(i, c) for i, (c, _) in enumerate(cases)], "i INT, raw STRING")
    for r in df.select("i", "raw", validation.validate("raw", rules).alias("v")).collect():
        assert r.v.error_type == cases[r.i][1], r
        assert r.v.schema_ok == (cases[r.i][1] is None)
    fixed = spark.createDataFrame([("```json\n" + json.dumps(good) + "\n```",), ("broken",), (json.dumps(good),)], "raw STRING").select(validation.repaired("raw", rules, F.lit(json.dumps(good))).alias("r")).collect()
    assert [x.r.repairs_used for x in fixed] == [1, 2, 0] and all(json.loads(x.r.final) == good for x in fixed)


def test_flow_stops_at_the_first_failure(spark):
    df = spark.createDataFrame([(1, "ok"), (2, ""), (3, None)], "id INT, t STRING")
    st = (flow.Stage("ingest", F.col("t") != "", F.col("t")), flow.Stage("export", F.lit(True), F.lit("done")))
    r = {x.id: x for x in flow.run(df, st).collect()}
    assert r[1].status == "exported" and len(r[1].steps) == 2 and r[2].status == r[3].status == "safe_failure" and len(r[3].steps) == 1


def test_conllu_reader_and_tagging(spark, tmp_path):
    p = tmp_path / "x.conllu"
    p.write_text("# sent_id = s1\n# text = Кіт спить.\n1\tКіт\tкіт\tNOUN\t_\tCase=Nom\t2\tnsubj\t_\t_\n2-3\tне було\t_\t_\t_\t_\t_\t_\t_\t_\n2\tспить\t_\tVERB\t_\t_\t0\troot\t_\t_\n3\t.\t.\tPUNCT\t_\t_\t2\tpunct\t_\t_\n3.1\tx\t_\t_\t_\t_\t_\t_\t_\t_\n\n# sent_id = s2\n# text = Пес\n1\tПес\tпес\t_\t_\t_\t0\troot\t_\t_\n\n", encoding="utf-8")
    s = readers.conllu(spark, str(p), "train")
    t = readers.token_rows(s)
    assert [(r.sentence_id, r.token_id, r.form, r.upos) for r in t.orderBy("sentence_id", "token_id").collect()] == [("s1", 1, "Кіт", "NOUN"), ("s1", 2, "спить", "VERB"), ("s1", 3, ".", "PUNCT"), ("s2", 1, "Пес", "X")]
    f = {r.form: r for r in tagging.token_features(t).collect()}
    assert f["спить"].prev_form == "кіт" and f["Кіт"].bos and f["."].eos
    lex = tagging.lexicon(t.withColumn("seq", F.monotonically_increasing_id()))
    assert {r.form: r.pred for r in tagging.tag_by_lexicon(t, lex, "X").collect()}["спить"] == "VERB"


def test_crf_learns_a_context(spark):
    data = [(["a", "b", "1"], ["X", "Y", "NUM"])] * 6 + [(["b", "a"], ["X", "Y"])] * 6
    df = spark.createDataFrame([(i, f, t) for i, (f, t) in enumerate(data)], "sentence_id INT, forms ARRAY<STRING>, tags ARRAY<STRING>")
    m = tagging.train_crf(df, ["X", "Y", "NUM"], buckets=256, rounds=15)
    out = tagging.tag_by_crf(df, m).join(df.select("sentence_id", "tags"), "sentence_id").collect()
    assert all(r.pred == r.tags for r in out)


def test_crf_takes_all_sentences_at_once(spark):
    rng = np.random.default_rng(5)
    words = np.array([f"{a}{b}" for a in ("Кіт", "пес", "12", ",") for b in range(50)])
    data = [(i, words[rng.integers(0, 200, n)].tolist()) for i, n in enumerate(rng.integers(0, 60, 3000).tolist())]
    rows = [(i, f, ["PROPN" if w[0] == "К" else "NUM" if w[0] == "1" else "X" for w in f]) for i, f in data]
    df = spark.createDataFrame(rows, "sentence_id INT, forms ARRAY<STRING>, tags ARRAY<STRING>").repartition(4).cache()
    df.count()
    began = time.time()
    m = tagging.train_crf(df, ["NUM", "PROPN", "X"], rounds=12)
    got = {r.sentence_id: r.pred for r in tagging.tag_by_crf(df, m).collect()}
    assert time.time() - began < 8
    assert len(got) == 3000 and all(got[i] == t for i, _, t in rows)
    assert all(got[i] == tagging.viterbi(f, m) for i, f, _ in rows[:100])


def test_classifiers_separate_obvious_classes(spark):
    df = spark.createDataFrame([(i, f"{'добре чудово' if i % 2 else 'погано жахливо'} слово{i % 5}", "pos" if i % 2 else "neg") for i in range(60)], "text_id INT, text STRING, label STRING")
    for f in (models.logistic, models.linear_svm):
        assert f(df, df, features=256, iterations=5).where("pred <> label").isEmpty()


def test_sources_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'рядок "з" лапками\nі переносом', "[]", "a"), (2, None, None, None)], readers.REVIEW_SCHEMA)
    writers.csv(df, str(tmp_path / "c"))
    assert readers.csv(spark, str(tmp_path / "c")).where("text_id = 1").first().text == 'рядок "з" лапками\nі переносом'
    writers.jsonl(df, str(tmp_path / "j"))
    assert readers.jsonl(spark, str(tmp_path / "j"), readers.REVIEW_SCHEMA).exceptAll(df).isEmpty()
    raw = spark.createDataFrame([("", "зміст", "7"), (None, None, "8")], "text STRING, content STRING, id STRING")
    assert [(r.text_id, r.text) for r in readers.coalesced(raw).collect()] == [(7, "зміст")]
    with pytest.raises(FileNotFoundError):
        readers.first_existing([str(tmp_path / "no")])
    assert readers.union_available([df, df.drop("label")]).count() == 4


def test_streams_use_the_same_columns(spark, tmp_path):
    df = spark.createDataFrame([(1, "Привіт  світ."), (2, None)], "id INT, text STRING")
    df.write.parquet(str(tmp_path / "in"))
    s = messages.preprocessed(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")))
    q = s.select("id", "clean").writeStream.format("memory").queryName("pre").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert {(r.id, r.clean) for r in spark.table("pre").collect()} == {(1, "Привіт світ."), (2, "")}


def test_lsa_over_every_term_is_the_svd(spark):
    rng = np.random.default_rng(3)
    a = rng.random((30, 40)) * (rng.random((30, 40)) < 0.4)
    a[29] = 0
    a[29, 39] = 0.5  # a document of one term, rare enough to fall out of a bounded vocabulary
    a[:29, 39] = 0
    df = spark.createDataFrame([(int(i), f"t{j:02}", float(a[i, j])) for i, j in zip(*np.nonzero(a))], "doc INT, term STRING, weight DOUBLE")
    got = np.zeros((30, 3))
    for r in models.lsa(df, k=3, vocabulary=None).collect():
        got[r.doc, r.topic] = r.score
    assert {r.doc for r in models.lsa(df, k=3, vocabulary=None).select("doc").collect()} == set(range(30))
    u, s, _ = np.linalg.svd(a)
    assert np.allclose(np.abs(got), np.abs(u[:, :3] * s[:3]), atol=1e-4)


def test_comparison_flags_invented_and_missing_values(spark):
    kind = "STRUCT<a: STRING, services_mentioned: ARRAY<STRING>, document_type: STRING>"
    rows = [(("x", ["p", "q"], "d"), ("x", ["q", "p"], "d")), ((None, [], "d"), ("y", None, "e")), (("x", ["p"], None), (None, [], "")), (("x", None, "d"), None), ((None, None, None), (None, ["p"], "z"))]
    df = spark.createDataFrame(rows, f"g {kind}, p {kind}")
    names, lists = ("a", "services_mentioned", "document_type"), ("services_mentioned",)
    got = df.select(evaluation.compare(F.col("g"), F.col("p"), names, lists).alias("c"), evaluation.assess(F.col("g"), F.col("p"), names, lists).alias("a")).collect()
    assert [tuple(r.c)[:3] for r in got] == [(True, False, False), (False, True, False), (False, False, True), (False, True, True), (False, True, False)]
    assert [r.c.issues for r in got] == [[], ["a: hallucinated", "document_type: mismatch"], ["a: mismatch", "services_mentioned: mismatch", "document_type: mismatch"], ["invalid JSON"], ["services_mentioned: hallucinated", "document_type: hallucinated"]]
    assert [(r.a.field_matches, r.a.field_total, r.a.issues) for r in got] == [(3, 3, []), (0, 3, ["hallucinated_field/value", "semantic_extraction_error", "normalization_issue"]), (0, 3, ["semantic_extraction_error"] * 3), (0, 0, ["not_json_at_all"]), (1, 3, ["hallucinated_field/value"] * 2)]
    assert df.select(metrics.field_matches(F.col("g"), F.col("p"), names, lists).alias("m")).first().m == [] and df.select(metrics.field_matches(F.col("g"), F.col("p"), names).alias("m")).first().m == ["services_mentioned"]


def test_rates_of_no_runs_have_defaults(spark):
    r = spark.createDataFrame([(True, "accepted", False, False, 2, True, True, False)], "schema_valid BOOLEAN, status STRING, fallback_triggered BOOLEAN, reviewer_issues BOOLEAN, agents_called INT, semantic_ok BOOLEAN, base_schema_valid BOOLEAN, base_semantic_ok BOOLEAN")
    m = evaluation.crew_metrics(r).first()
    assert m.reviewer_catch_rate == 1.0 and m.fallback_success_rate == 1.0 and m.manual_review_rate == 0.0
    f = spark.createDataFrame([("exported", False, 3, 1)], "final_status STRING, fallback_triggered BOOLEAN, n_steps INT, warnings INT")
    assert evaluation.flow_metrics(f).first().fallback_success_rate == 0.0
    assert {r.category for r in spark.range(1).select(F.explode(evaluation.catalogue(((F.lit(False), "x"), (F.lit(None).cast("boolean"), "y")))).alias("category")).collect()} == {"ok"}


def test_weights_of_two_classes_mirror(spark):
    w = spark.createDataFrame([("a", "x", 2.0), ("a", "y", -1.0)], "label STRING, feature STRING, weight DOUBLE")
    t = {(r.label, r.side, r.feature) for r in evaluation.top_features(evaluation.mirrored(w, "b"), 1).collect()}
    assert t == {("a", "positive", "x"), ("a", "negative", "y"), ("b", "positive", "y"), ("b", "negative", "x")}
    s = spark.createDataFrame([([0.25], 0), ([0.25], 1)], "raw ARRAY<DOUBLE>, i INT")
    assert [r.s for r in s.select(metrics.class_score(F.col("raw"), F.col("i"), 2).alias("s")).collect()] == [-0.25, 0.25]


def test_curve_of_many_scores_and_time_split_of_hot_times(spark):
    df = spark.createDataFrame([((i * 37) % 5000 / 7.0, int(i % 3 == 0)) for i in range(5000)], "score DOUBLE, y INT")
    rows, tp, want = sorted(df.collect(), key=lambda r: -r.score), 0, {}
    for k, r in enumerate(rows, 1):
        tp += r.y
        want[r.score] = (tp, k - tp)
    assert {r.threshold: (r.tp, r.fp) for r in metrics.pr_curve(df).collect()} == want
    t = spark.createDataFrame([(i, 5 if i % 3 else i % 1000) for i in range(3000)], "event_id BIGINT, s INT").withColumn("ts", F.timestamp_seconds("s"))
    order = [r.event_id for r in t.orderBy("ts", "event_id").collect()]
    want = {e: "train" if k < 2400 else "val" if k < 2700 else "test" for k, e in enumerate(order)}
    cut = {"train": 0.8, "val": 0.1, "test": 0.1}
    assert {r.id: r.split for r in splits.by_time(t, "ts", cut).collect()} == want
    with pytest.raises(ValueError):
        splits.by_time(t.limit(2), "ts", cut)


def test_a_grid_of_too_many_labels_is_an_error(spark):
    with pytest.raises(ValueError):
        metrics.confusion(spark.range(30).select(F.col("id").cast("string").alias("gold"), F.lit("x").alias("pred")), most=20)


def test_logistic_beats_the_majority(spark):
    rows = [(i, f"дякую за швидку роботу {i}" if i % 3 else f"жахлива черга знову {i}", "plus" if i % 3 else "minus") for i in range(90)]
    df = spark.createDataFrame(rows, "text_id BIGINT, text STRING, label STRING")
    train, test = df.where("text_id < 60"), df.where("text_id >= 60")
    assert models.logistic(train, test, features=1 << 10, iterations=20).where("pred = label").count() == 30
    assert models.linear_svm(train, test, features=1 << 10, iterations=5).where("pred = label").count() >= 29


def test_one_vs_rest_on_packed_rows(spark):
    rng = np.random.default_rng(4)
    x = rng.poisson(0.3, (400, 200))
    x[:, 0] = 1
    y = (x[:, 1:4] * [1, 2, 3]).sum(axis=1) % 3
    rows = [(f"c{k}", np.flatnonzero(v).tolist(), v[v > 0].astype(float).tolist()) for k, v in zip(y, x)]
    df = spark.createDataFrame(rows, "label STRING, _i ARRAY<INT>, _c ARRAY<DOUBLE>").repartition(3)
    packed = models._packed(df, "label", ["c0", "c1", "c2"])
    blobs = packed.select(F.expr("sum(length(y) + length(size) + length(gap) + length(count))").alias("b"), F.sum("m").alias("m")).first()
    assert blobs.m == (x > 0).sum() and blobs.b < 3 * blobs.m  # a sparse vector has 12 bytes an entry, and each class had its own copy
    idf = 1 + rng.random(200)
    w, b = models._one_vs_rest(packed, idf, 3, 1e-3, 40)
    v = x * idf / np.linalg.norm(x * idf, axis=1, keepdims=True)
    from pyspark.ml.classification import LinearSVC
    from pyspark.ml.linalg import Vectors

    for k in range(3):
        sign = np.where(y == k, 1, -1)
        loss = lambda w, b: np.maximum(0, 1 - sign * (v @ w + b)).mean() + 5e-4 * w @ w  # noqa: E731, B023
        theirs = LinearSVC(regParam=1e-3, maxIter=40, tol=1e-4, standardization=False).fit(spark.createDataFrame([(Vectors.dense(r), float(s > 0)) for r, s in zip(v, sign)], ["features", "label"]))
        assert loss(w[:, k], b[k]) <= loss(theirs.coefficients.toArray(), theirs.intercept) * 1.05


def test_metrics_as_rows_and_json(spark, tmp_path):
    df = spark.createDataFrame([(1, 0.5, None)], "n INT, rate DOUBLE, none DOUBLE")
    assert {r.metric: r.value for r in writers.metric_rows(df).collect()} == {"n": 1.0, "rate": 0.5, "none": None}
    writers.metrics_json(df, str(tmp_path / "m"))
    files = [f for f in os.listdir(tmp_path / "m") if f.endswith(".json")]
    assert len(files) == 1 and json.loads((tmp_path / "m" / files[0]).read_text()) == {"n": 1, "rate": 0.5, "none": None}


def test_deliveries_are_deduplicated_on_a_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:05"), (2, "2024-01-01 00:00:09")], "id INT, t STRING").withColumn("t", F.to_timestamp("t"))
    df.write.parquet(str(tmp_path / "in"))
    q = messages.deduplicated(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "id", "t").writeStream.format("memory").queryName("once").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r.id for r in spark.table("once").collect()) == [1, 2]


def test_nearest_in_blocks(spark):
    rng = np.random.default_rng(2)
    v = spark.createDataFrame([(i, [float(x) for x in rng.normal(size=4)]) for i in range(40)], "vec_id BIGINT, embedding ARRAY<DOUBLE>")
    one = {tuple(r) for r in features.nearest(v, v.where("vec_id < 9"), 3).collect()}
    assert len(one) == 27 and {tuple(r) for r in features.nearest(v, v.where("vec_id < 9"), 3, block=4).collect()} == one


def _skipgram_texts(n):
    import random

    rng = random.Random(7)
    topics = [[f"t{k}w{i}" for i in range(8)] for k in range(4)]
    return [[rng.choice(topics[k % 4]) for _ in range(12)] + ["common"] * (k % 2) for k in range(n)]


def test_neighbouring_words_are_counted_by_distance(spark):
    from collections import Counter

    import numpy as np

    texts = [["a", "b", "rare", "a", "c"], ["b"], [], ["c", "c", "a", "b", "b", "a", "c", "b"]]
    want, words = Counter(), ["a", "b", "c"]
    for t in texts:
        t = [w for w in t if w in words]
        for i, w in enumerate(t):
            for j in range(max(0, i - 3), min(len(t), i + 4)):
                if i != j:
                    want[w, t[j]] += 4 - abs(i - j)
    got, df = {}, spark.createDataFrame([(t,) for t in texts], "tokens ARRAY<STRING>").repartition(3)
    for r in models._counted_pairs(df, words, 3, 2).collect():
        at, c, n = np.frombuffer(r.at, np.int64), np.frombuffer(r.c, np.int32), np.frombuffer(r.n, np.float32)
        got |= {(w, words[j]): k for i, w in enumerate(words[r.block::2]) for j, k in zip(c[at[i]:at[i + 1]], n[at[i]:at[i + 1]])}
    assert got == dict(want)


def test_word_vectors_read_the_texts_once_and_not_by_partition(spark):
    """Epochs pass over counts, so neither the number of epochs nor the partitions change what is read or how the vectors come out."""
    import numpy as np

    texts, read = _skipgram_texts(400), spark.sparkContext.accumulator(0)

    def noted(it):
        for b in it:
            read.add(b.num_rows)
            yield b

    found = []
    for parts in (1, 3):
        df = spark.createDataFrame([(t,) for t in texts], "tokens ARRAY<STRING>").repartition(parts).mapInArrow(noted, "tokens ARRAY<STRING>")
        found.append({r.word: np.array(r.vector) for r in models.word2vec(df, "tokens", size=16, iterations=10).collect()})
    assert read.value == 2 * len(texts)
    a, b = found
    assert a.keys() == b.keys() and len(a) == 33 and all(len(v) == 16 for v in a.values())
    assert max(np.abs(a[w] - b[w]).max() for w in a) < 1e-2
    unit = {w: v / np.linalg.norm(v) for w, v in a.items()}
    for w in sorted(a.keys() - {"common"}):
        near = sorted(a.keys() - {w, "common"}, key=lambda o: -(unit[w] @ unit[o]))[:7]
        assert {o[:2] for o in near} == {w[:2]}
    assert models.word2vec(spark.createDataFrame([(["once"],)], "tokens ARRAY<STRING>"), "tokens").count() == 0
    assert models.word2vec(spark.createDataFrame([(["alone"],)] * 3, "tokens ARRAY<STRING>"), "tokens", size=4).count() == 1


def test_word_vectors_reach_the_loss_of_single_steps(spark):
    """The skip-gram loss with 5 negatives is no more than 2 % above that of plain stochastic steps over the tokens."""
    import numpy as np

    from pyspark import SparkContext

    texts = _skipgram_texts(300)
    words = sorted({w for t in texts for w in t})
    ids, width, size, epochs = {w: i for i, w in enumerate(words)}, len(words), 16, 5
    count, pairs, rng = np.zeros(width), np.zeros((width, width)), np.random.default_rng(3)
    for t in texts:
        for i, w in enumerate(t):
            count[ids[w]] += 1
            for j in range(max(0, i - 5), min(len(t), i + 6)):
                if i != j:
                    pairs[ids[w], ids[t[j]]] += (6 - abs(i - j)) / 5
    noise = count**0.75 / (count**0.75).sum()
    loss = lambda u, v: (pairs * np.logaddexp(0, -u @ v.T) + 5 * pairs.sum(axis=1)[:, None] * noise * np.logaddexp(0, u @ v.T)).sum() / pairs.sum()
    u, v = (rng.random((width, size)) - 0.5) / size, np.zeros((width, size))
    for e in range(epochs):
        for t in texts:
            for i, w in enumerate(t):
                b = rng.integers(1, 6)
                for j in range(max(0, i - b), min(len(t), i + b + 1)):
                    if i != j:
                        at = np.append(ids[t[j]], rng.choice(width, 5, p=noise))
                        step = (0.025 - 0.0249 * e / epochs) * (np.array([1, 0, 0, 0, 0, 0]) - 1 / (1 + np.exp(-v[at] @ u[ids[w]])))
                        old = u[ids[w]].copy()
                        u[ids[w]] += step @ v[at]
                        np.add.at(v, at, step[:, None] * old)
    held, broadcast = [], SparkContext.broadcast
    try:
        SparkContext.broadcast = lambda self, x: (held.append(x) if isinstance(x, np.ndarray) else None, broadcast(self, x))[1]
        out = models.word2vec(spark.createDataFrame([(t,) for t in texts], "tokens ARRAY<STRING>"), "tokens", size=size, iterations=epochs).collect()
    finally:
        SparkContext.broadcast = broadcast
    order = np.argsort([ids[r.word] for r in out])
    assert loss(held[-1][order], held[-2][order]) < 1.02 * loss(u, v)


def test_svm_has_every_term(spark):
    from textloom.operators import features

    rows = [(i, f"слово{i % 7} і  Мітка{i // 2}-а it’s {'дуже ' * (i % 3)}{i}", "ab"[i // 2 % 2]) for i in range(4000)]  # a word of its own tells two texts; more terms than 2^14
    train = spark.createDataFrame([*rows, (-2, "", "b"), (-3, "я", None)], "text_id BIGINT, text STRING, label STRING")
    words = models._worded(train, "text", True)
    terms = words.select("text_id", F.explode(F.array_distinct(F.concat(F.transform(features.ngrams("_words"), lambda g: F.concat(F.lit("w:"), g)), features.char_ngrams("text")))).alias("t"))
    often = sorted(r.n for r in terms.groupBy("t").agg(F.count("*").alias("n")).where("n > 1").collect())
    _, idf = models._vocabulary(words.select("_words", "_pieces"), None)
    assert np.allclose(idf, np.log(4003 / (np.array(often[::-1]) + 1)))
    held = {}

    def seen(rows, idf, classes, reg, iterations=None):
        held.update(columns=len(idf), iterations=iterations)
        return np.zeros((len(idf), classes)), np.zeros(classes)

    own, models._one_vs_rest = models._one_vs_rest, seen
    try:
        models.linear_svm(train, train)
    finally:
        models._one_vs_rest = own
    assert held == {"columns": len(idf), "iterations": None}  # 2^14 columns and 10 rounds before


def test_descent_comes_to_the_least_loss():
    rng = np.random.default_rng(2)
    x = rng.random((90, 40)) * (rng.random((90, 40)) < 0.3)
    x[:, 0] = 0.1
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y = np.where(x[:, 1] + 0.3 * rng.random(90) > 0.2, 1.0, -1.0)
    at, w, b, a, soft = np.concatenate([[0], np.cumsum((x > 0).sum(axis=1))]), np.zeros(40), 0.0, np.zeros(90), 0.3
    for _ in range(400):
        b, loss, gap = models._descent(y, np.nonzero(x)[1], at, x[x > 0], w, b, a, 1.0, soft)
        assert np.allclose(w, (a * y) @ x)
        b += soft * (a @ y)
    assert gap < 0.005 * (loss + w @ w / 2) and abs(a @ y) < 0.05
