"""Text and span functions against plain Python."""

import hashlib
import re

from pyspark.sql import functions as F

from textloom.functions import spans as R
from textloom.functions import text as X
from textloom.plans import registry

CASES = [
    None, "", "   ", "Привіт  світ ", "об’єкт “тест” – так", "кiт і Iрпінь бIб", "Сайт https://a.ua/x?y=1 та www.b.com, пошта a.b@c.ua; тел +38 (067) 123-45-67.",
    "Ціна 5.5 грн. Див. ст. 5 закону. Так! Ні? Може бути… 😀 кінець", "12345", "!!! ???", "м. Київ, вул. Шевченка. Далі текст.", "Подано 31.02.2024, 12.05.2023 та 7 травня 2022, ще 3 лютого.",
]


def rows(spark, *cols):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(CASES)], "i INT, t STRING")
    return [r[1:] for r in sorted(df.select("i", *cols).collect())]


def test_clean_and_count(spark):
    for (got, n), t in zip(rows(spark, X.clean("t"), X.word_count("t")), CASES):
        assert got == re.sub(r"\s+", " ", t or "").strip()
        assert n == len((t or "").split())


def test_normalize_is_idempotent(spark):
    for a, b in rows(spark, X.normalize("t"), X.normalize(X.normalize("t"))):
        assert a == b
    got = dict(zip(CASES, [r[0] for r in rows(spark, X.normalize("t"))]))
    assert got["кiт і Iрпінь бIб"] == "кіт і Iрпінь бІб"
    assert got["об’єкт “тест” – так"] == "об'єкт \"тест\" - так"


def test_mask_counts_before_each_step(spark):
    m = dict(zip(CASES, [r[0] for r in rows(spark, X.mask("t"))]))
    r = m[CASES[6]]
    assert (r.urls, r.emails, r.phones) == (2, 1, 1) and "<URL>" in r.masked and "<PHONE>" in r.masked


def test_sentences_keep_abbreviations(spark):
    s = dict(zip(CASES, [r[0] for r in rows(spark, X.split_sentences("t"))]))
    assert s["м. Київ, вул. Шевченка. Далі текст."] == ["м. Київ, вул. Шевченка.", "Далі текст."]
    assert s[None] == [] and s["   "] == []


def test_garbage_and_short(spark):
    g = dict(zip(CASES, rows(spark, X.is_garbage("t"), X.is_short("t"))))
    assert g["12345"][0] and g["!!! ???"][0] and g[""][0] and g[None][0] and not g[CASES[5]][0]


def test_hash_mode(spark):
    for (m,), t in zip(rows(spark, X.sha_mod6("t")), CASES):
        assert m is None if t is None else m == int(hashlib.sha256(t.encode()).hexdigest(), 16) % 6


def test_shapes(spark):
    forms = ["Київ", "УКРАЇНА", "abc", "Івано-Франківськ", "12", "-", "п'ять", "aB"]
    df = spark.createDataFrame([(f,) for f in forms], "f STRING").select("f", X.shape("f").alias("s"), X.affixes("f").alias("a"))
    for r in df.collect():
        assert (r.s.is_upper, r.s.is_title, r.s.is_digit) == (r.f.isupper(), r.f.istitle(), r.f.isdigit())
        w = r.f.lower()
        assert (r.a.p2, r.a.s4) == (w[:2], w[-4:])


def test_spans_match_finditer(spark):
    for p in (r"\d+", "[А-Яа-я]+", "😀"):
        for (got,), t in zip(rows(spark, R.find("t", p)), CASES):
            assert [(s.start_char, s.end_char, s.value) for s in got] == [(*m.span(), m.group()) for m in re.finditer(p, t or "")]


def test_dates(spark):
    got = [r[0] for r in rows(spark, R.dates("t"))][-1]
    assert [(s.value, s.parsed) for s in got] == [("31.02.2024", "2024-02-31"), ("12.05.2023", "2023-05-12"), ("7 травня 2022", "2022-05-07"), ("3 лютого", None)]


def test_merge_is_an_ordered_fold(spark):
    def py(base, rules):
        acc = list(base)
        for r in rules:
            if any((x[0], x[1], x[3]) == (r[0], r[1], r[3]) for x in acc):
                continue
            hit = next((i for i, x in enumerate(acc) if max(x[0], r[0]) < min(x[1], r[1]) and x[3] in ("DATE", "LOC")), None)
            if hit is None:
                acc.append(r)
            else:
                acc[hit] = r
        return sorted(set(acc))

    base = [(0, 5, "a", "LOC"), (8, 12, "b", "PER")]
    rules = [(3, 9, "c", "DATE"), (4, 6, "d", "LOC"), (8, 12, "b", "PER"), (20, 22, "e", "DATE")]
    df = spark.createDataFrame([(base, rules)], f"b ARRAY<{R.SPAN}>, r ARRAY<{R.SPAN}>")
    got = df.select(R.merge_rules("b", "r", ("DATE", "LOC")).alias("m")).first().m
    assert [tuple(x) for x in got] == py(base, rules)


def test_feats_and_joint(spark):
    df = spark.createDataFrame([({"B": ["y", "x"], "A": ["1"]},), ({},)], "f MAP<STRING, ARRAY<STRING>>").select(X.feats_string("f").alias("s"))
    assert [r.s for r in df.collect()] == ["A=1|B=y,x", "_"]
    r = spark.range(1).select(X.split_joint(F.lit("NOUN||Case=Nom|Number=Sing")).alias("j")).first().j
    assert (r.upos, r.feats) == ("NOUN", "Case=Nom|Number=Sing")


def test_json_check_sees_every_row(spark, tmp_path):
    cases = [
        ('["a", "b"]', True, 2), (' ["a"] ', True, 1), ("[]", True, 0), ('{"a": 1}', True, None), ("null", True, None), ('"x"', True, None), ("['a', 'b']", False, None), ('["a",]', False, None), ("[NaN]", False, None),
        ('["a"] tail', False, None), ('["a"]["b"]', False, None), ("1, 2", False, None), ("1],[2", False, None), ('1},{"a":2', False, None), ("слово", False, None), ("", False, None), ("  ", False, None), (None, None, None),
    ]
    spark.createDataFrame([(i, x) for i, (x, _, _) in enumerate(cases)], "text_id BIGINT, sentences STRING").write.parquet(f"{tmp_path}/processed_v2_sample.parquet")
    got = {r.text_id: (r.valid, r.n) for r in registry.QUERIES["x21_json_check"](spark, str(tmp_path)).collect()}
    assert got == {i: (v, n) for i, (_, v, n) in enumerate(cases)}
