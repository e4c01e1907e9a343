"""Problems 2, 3, 4, 5 and 9: brute force and edge cases."""

import math
import os
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from textloom.llm import chars, common, crosssplit, linking, mixing, neardup, sampling, tokens
from textloom.llm.setjoin import close_pairs, cross_pairs, word_sets


def edited_texts(seed=3, groups=25):
    rng = random.Random(seed)
    vocab = [f"слово{i}" for i in range(400)]
    out, k = [], 0
    for _ in range(groups):
        base = rng.sample(vocab, rng.choice([14, 16, 20, 30, 45, 80]))
        for _ in range(rng.randint(1, 5)):
            w = list(base)
            for _ in range(rng.randint(0, max(1, len(w) // 6))):
                w[rng.randrange(len(w))] = rng.choice(vocab)
            rng.shuffle(w)
            out.append((k, " ".join(w)))
            k += 1
    out += [(k, out[0][1]), (k + 1, out[0][1].upper()), (k + 2, "одне слово"), (k + 3, None), (k + 4, ""), (None, out[0][1])]
    return out + [out[0]]


def brute_pairs(rows, least=14):
    sets = {i: set(chars.words(t)) for i, t in rows if t and i is not None}
    sets = {i: s for i, s in sets.items() if len(s) >= least}
    return {(a, b) for a in sets for b in sets if a < b and 4 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", j % 3) for j, (i, t) in enumerate(rows)], "text_id BIGINT, text STRING, key STRING, n INT")


@pytest.mark.parametrize("limit,hold,strength", [(50_000, 3_000_000, 0), (50_000, 3_000_000, 1), (1, 3_000_000, 0), (2, 3_000_000, 0), (7, 40, 0)])
def test_near_duplicates_match_brute_force(spark, limit, hold, strength):
    rows = edited_texts()
    df = frame(spark, rows)
    sets = word_sets(df, "text_id", "text").cache()
    links = neardup.similar_sets(sets, limit=limit, hold=hold, strength=strength)
    got = neardup.pairs_of(sets.select("id", "key", "n").distinct(), links)
    assert {tuple(r) for r in got.collect()} == brute_pairs(rows)


def test_groups_are_components(spark):
    rows = edited_texts(5, 12)
    m, l = neardup.near_duplicates(frame(spark, rows))
    got = {}
    for r in neardup.groups_of(m, l).collect():
        got.setdefault(r.class_id, set()).add(r.id)
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in brute_pairs(rows):
        parent[find(a)] = find(b)
    expected = {}
    for x in list(parent):
        expected.setdefault(find(x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, expected.values()))


def test_near_duplicates_of_an_empty_table(spark):
    m, l = neardup.near_duplicates(frame(spark, [(1, "коротко")]))
    assert m.isEmpty() and neardup.pairs_of(m, l).isEmpty() and neardup.groups_of(m, l).isEmpty()


def test_cross_split_matches_brute_force(spark):
    rows = edited_texts(7)
    split = {i: ("train", "val", "test", None)[i % 4] for i, _ in rows if i is not None}
    s = spark.createDataFrame([(i, x) for i, x in split.items() if x] + [(0, "train"), (99_999, "val")], "text_id BIGINT, split STRING")
    df = frame(spark, rows).withColumn("source", F.lit("q")).withColumn("split", F.lit("other")).drop("split")
    m, l = crosssplit.jaccard_split(df, s)
    want = {(a, b) for a, b in brute_pairs(rows) if split[a] and split[b] and (split[a] == "train") != (split[b] == "train")}
    assert {tuple(r) for r in crosssplit.pairs_of(m, l).collect()} == want
    leaked = {i for p in want for i in p if split[i] != "train"}
    assert sum(r.leaked for r in crosssplit.counts_of(m, l).collect()) == len(leaked)
    m, l = crosssplit.cross_split(df.limit(0), s)
    assert crosssplit.pairs_of(m, l).isEmpty()
    m, l = crosssplit.jaccard_split(df, s, cell=2)
    assert {tuple(r) for r in crosssplit.pairs_of(m, l).collect()} == want


@pytest.mark.parametrize("weights,t,cell,seed", [("unit", 6 / 7, 20_000, 1), ("idf", 0.8, 20_000, 2), ("random", 0.8, 20_000, 3), ("random", 0.6, 1, 4), ("random", 0.9, 3, 5)])
def test_weighted_join_finds_every_pair(weights, t, cell, seed):
    rng = np.random.default_rng(seed)
    vocab = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    docs = []
    for _ in range(60):
        base = rng.choice(vocab, rng.integers(5, 40), replace=False)
        for _ in range(4):
            docs.append(np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.choice(vocab, rng.integers(1, 4))])))
    flat, at = np.concatenate(docs), np.concatenate([[0], np.cumsum([len(x) for x in docs])])
    counts = np.bincount(crosssplit._bucket(flat), minlength=crosssplit.BUCKETS)
    weight = rng.lognormal(0, 1, crosssplit.BUCKETS) if weights == "random" else crosssplit.term_weights(counts, len(docs), weights)
    cls = crosssplit.term_classes(counts, weight)
    d, term, *values = crosssplit.listed(flat, at, counts, weight, cls, t)
    p = np.empty(len(d), dtype=crosssplit._POST)
    for name, v in zip(crosssplit._VALUES, values):
        p[name] = v
    for name, v in zip(crosssplit._SKETCHES, crosssplit.class_sketches(flat, at[:-1], cls)):
        p[name] = v[d]
    p["key"], p["side"] = d, d % 2
    i, lists = crosssplit.cells(term, p["key"].copy(), p["side"], counts[crosssplit._bucket(term)], cell)
    p = p[i]
    p["term"] = (lists >> np.uint64(32)).astype(np.uint32)
    met = {tuple(x) for x in crosssplit.met_in(np.concatenate([p, p]), t).tolist()}
    unit = [dict(zip(x.tolist(), (weight[crosssplit._bucket(x)] / np.sqrt(np.square(weight[crosssplit._bucket(x)]).sum())).tolist())) for x in docs]
    dot = lambda x, y: sum(v * unit[y].get(k, 0.0) for k, v in unit[x].items())
    want = {(x, y) for x in range(0, len(docs), 2) for y in range(1, len(docs), 2) if dot(x, y) >= t}
    assert want and want <= met and len(met) < len(docs) ** 2 / 4


def test_idf_weights_are_exact(spark):
    rows = [(i, t) for i, t in edited_texts(9) if i is not None]
    s = spark.createDataFrame([(i, "train" if i % 2 else "test") for i, _ in rows], "text_id BIGINT, split STRING")
    m, l = crosssplit.cross_split(frame(spark, rows), s, cosine=0.7)
    sets = {i: set(chars.words(t)) for i, t in rows if t}
    sets = {i: x for i, x in sets.items() if len(x) >= 14}
    n, df = len([1 for i, t in rows if i in sets]), Counter(w for i, t in rows if i in sets for w in sets[i])
    square = lambda x: sum(math.log1p(n / df[w]) ** 2 for w in x)
    want = {(min(a, b), max(a, b)) for a in sets for b in sets if a % 2 == 0 and b % 2 and square(sets[a] & sets[b]) / math.sqrt(square(sets[a]) * square(sets[b])) >= 0.7}
    assert {tuple(r) for r in crosssplit.pairs_of(m, l).collect()} == want
    assert {r.text_id for r in crosssplit.classes_of(m, l).collect()} == {i for p in want for i in p if i % 2 == 0}


def test_a_text_in_many_batches_is_paired_once():
    p = np.zeros(60_000, dtype=crosssplit._POST)
    p["term"], p["w"], p["max"], p["sum"], p["least0"], p["side"] = 1, 1, 1, 1, 1, np.arange(len(p)) % 2
    began = time.time()
    assert crosssplit.met_in(p, 0.8).tolist() == [[0, 0]] and time.time() - began < 2


def test_a_long_list_is_compared_in_blocks():
    rng = np.random.default_rng(6)
    p = np.zeros(40_000, dtype=crosssplit._POST)
    w = 1 / np.sqrt(rng.integers(40, 46, len(p)))
    p["term"], p["w"], p["max"], p["sum"], p["norm"], p["rest"] = 1, w, w, 1 / w, 0.99, 1 / w
    p["key"], p["side"] = np.arange(len(p)), np.arange(len(p)) % 2
    for k in range(crosssplit.CLASSES):
        p[f"least{k}"] = w * w
    for name in crosssplit._SKETCHES:
        p[name] = rng.integers(0, 1 << 63, len(p), dtype=np.uint64)
        p[name][1::2][:50] = p[name][::2][:50]  # fifty pairs of equal sketches
    began = time.time()
    met = {tuple(x) for x in crosssplit.met_in(p, 6 / 7).tolist()}
    assert time.time() - began < 3  # 400 million pairs
    assert {(2 * k, 2 * k + 1) for k in range(50) if min(w[2 * k], w[2 * k + 1]) >= 6 / 7 * max(w[2 * k], w[2 * k + 1])} <= met and len(met) < 100


@pytest.mark.parametrize("top", [60, neardup.MOST + 9])
def test_long_buckets_are_compared_in_blocks(top):
    rng = np.random.default_rng(7)
    e = np.zeros(900, dtype=neardup._ENTRY)
    e["sig"], e["key"], e["n"] = np.repeat([1, 2, 3], [500, 399, 1]), np.arange(900) % 850, np.minimum(rng.integers(14, top, 900), neardup.MOST)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    e["wide"] = base[rng.integers(0, 30, 900)] ^ (np.uint64(1) << rng.integers(0, 63, 900).astype(np.uint64))
    near = neardup._Near(e, e, 3, 4)
    i, j = np.triu_indices(900, 1)
    ok = (e["sig"][i] == e["sig"][j]) & near(i, j) & (e["key"][i] != e["key"][j])
    want = {(min(a, b), max(a, b)) for a, b in zip(e["key"][i[ok]].tolist(), e["key"][j[ok]].tolist())}
    assert want and {tuple(x) for x in close_pairs(e["sig"].copy(), e["key"].copy(), near).tolist()} == want
    x, y = e[::2], e[1::2]
    i, j = np.divmod(np.arange(450 * 450), 450)
    near = neardup._Near(x, y, 3, 4)
    ok = (x["sig"][i] == y["sig"][j]) & near(i, j) & (x["key"][i] != y["key"][j])
    want = {(min(a, b), max(a, b)) for a, b in zip(x["key"][i[ok]].tolist(), y["key"][j[ok]].tolist())}
    assert want and {tuple(r) for r in cross_pairs(x["sig"].copy(), x["key"].copy(), y["sig"].copy(), y["key"].copy(), near).tolist()} == want


def test_a_long_bucket_takes_little_time():
    rng = np.random.default_rng(8)
    e = np.zeros(30_000, dtype=neardup._ENTRY)
    e["sig"], e["key"], e["n"], e["wide"] = 1, np.arange(len(e)), rng.integers(40, 50, len(e)), rng.integers(0, 1 << 63, len(e), dtype=np.uint64)
    began = time.time()
    close_pairs(e["sig"].copy(), e["key"].copy(), neardup._Near(e, e, 3, 4))
    assert time.time() - began < 3  # 450 million pairs


def test_written_tables_are_deleted(spark, tmp_path):
    t = common.written(spark.range(5), "x")
    path = t.inputFiles()[0].removeprefix("file:").replace("///", "/")
    assert os.path.exists(path) and t.count() == 5
    common.dropped(t, spark.range(3))
    assert not os.path.exists(path)
    common.written(spark.range(2), "y")
    assert common.release(spark) >= 1 and common.release(spark) == 0


def test_sample_follows_targets(spark):
    rows = [(i, "A / b") for i in range(1000)] + [(1000 + i, " a/B ") for i in range(500)] + [(2000 + i, "c") for i in range(40)] + [(3000 + i, "e") for i in range(300)] + [(0, "a / b"), (None, "c"), (5, None), (9000, "other")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "text_id BIGINT, label STRING, bin INT")
    t = spark.createDataFrame([("A / B", 0.5, 5), ("C", 0.4, 5), ("D", 0.0, 3), ("E", 0.1, 5)], "label STRING, target_share DOUBLE, min_rows INT")
    sample, report = sampling.stratified(df, t)
    q = {r.label: r for r in report.collect()}
    size = 0.2 * 1841
    assert q["A / B"].available == 1500 and q["C"].available == 40 and q["C"].exhausted and q["D"].exhausted and not q["A / B"].exhausted
    n = {r.label: r["count"] for r in sample.groupBy("label").count().collect()}
    assert n == {r.label: r.quota for r in q.values() if r.quota} and sum(n.values()) == round(size) and n["C"] == 40
    assert abs(n["A / B"] / n["E"] - 5) < 0.05 and q["C"].shortfall == pytest.approx(0.4 * size - 40) and sum(r.actual_share for r in q.values()) == pytest.approx(1)
    two = sampling.sample(df.repartition(7), t)
    assert sample.exceptAll(two).isEmpty() and two.exceptAll(sample).isEmpty() and sample.select("id").distinct().count() == sample.count()
    small = sampling.sample(df, t, room=0.0001)  # reservoirs that overflow are filled again
    assert sample.exceptAll(small).isEmpty() and small.exceptAll(sample).isEmpty()
    assert sampling.sample(df.limit(0), t).isEmpty() and sampling.report(df.limit(0), t).count() == 4 and sampling.report(df, t.limit(0)).isEmpty()


def test_the_sample_is_that_of_least_priority(spark):
    df = spark.createDataFrame([(i, "ab"[i % 3 == 0]) for i in range(30_000)], "text_id BIGINT, label STRING")
    t = spark.createDataFrame([("a", 0.6, 1), ("b", 0.1, 1)], "label STRING, target_share DOUBLE, min_rows INT")
    got = sampling.sample(df.repartition(5), t)
    w = df.withColumn("p", F.xxhash64(F.lit(7), "text_id"))
    for label, n in (("a", got.where("label = 'a'").count()), ("b", got.where("label = 'b'").count())):
        want = {r.text_id for r in w.where(f"label = '{label}'").orderBy("p").limit(n).collect()}
        assert {r.id for r in got.where(f"label = '{label}'").collect()} == want and n


@pytest.mark.parametrize("wanted,minimum,available,size,quota", [
    ([50, 30, 20], [0, 0, 0], [100, 100, 100], 100, [50, 30, 20]), ([50, 30, 20], [0, 0, 0], [100, 100, 10], 100, [56, 34, 10]), ([50, 50], [0, 0], [10, 20], 100, [10, 20]),
    ([99, 1], [0, 5], [100, 100], 100, [99, 5]), ([0, 0], [3, 0], [2, 9], 100, [2, 0]), ([], [], [], 5, []),
])
def test_feasible_quotas(wanted, minimum, available, size, quota):
    assert sampling.feasible(wanted, minimum, available, size) == quota


PLACES = ["Тихоград", "Новий Тихоград", "Сніжинськ", "Кривогірка", "Соковопіль", "Туманоярці", "Вишнанківці"]


@pytest.mark.parametrize("typed,place", [
    ("тихоград", 1), ("м. Тихограду", 1), ("Tykhohrad", 1), ("nb[juhfl", 1), ("Новий Тихгорад", 2), ("Нового Тихограда", 2), ("Сніжи-нськ", 3), ("Сніжинстк", 3), ("Крнвогірка", 4), ("у Кривогірці", 4), ("центр Соковополя", 5), ("Туманоя.", 6),
    ("Виш нанківці", 7), ("Вишнанківцях, обл.", 7), ("Тихолісся", 0), ("Пшеницьке Урочище", 0), ("нашому місті", 0), ("", 0), (" ", 0),
])
def test_places(spark, typed, place, _cache={}):
    if not _cache:
        cases = [c for c in test_places.pytestmark[0].args[1]]
        ref = spark.createDataFrame([(i + 1, p, "r") for i, p in enumerate(PLACES)] + [(1, PLACES[0], "r"), (None, "x", "r"), (9, None, "r")], "loc_id INT, canonical_name STRING, mention STRING")
        v = spark.createDataFrame([("s", i, t) for i, (t, _) in enumerate(cases)] + [("s", 500, None), ("s", 501, "там же"), ("s", 501, "Тихоград")], "src STRING, text_id BIGINT, mention STRING")
        got = {r.text_id: r.loc_id for r in linking.linked(v, ref).collect()}
        assert got[500] == 0 and got[501] == 1
        assert linking.linked(v.limit(0), ref).isEmpty() and set(r.loc_id for r in linking.linked(v, ref.limit(0)).collect()) == {0}
        _cache.update({t: got[i] for i, (t, _) in enumerate(cases)})
    assert _cache[typed] == place


#: Names that are in no table: nothing in the operator can be fitted to them.
UNSEEN = ["Яблунецьке", "Залізний Брід", "Осокорки", "Верхоріччя", "Білопілля", "Підгірці", "Радехів", "Вовчанськ", "Миронівка", "Старий Радехів", "Ніжиловичі", "Хорол"]


@pytest.mark.parametrize("typed,place", [
    ("у Яблунецькому", 1), ("Залізному Броду", 2), ("Осокорків", 3), ("Верхоріччі", 4), ("Верхорічье", 4), ("Білопіллям", 5), ("у Білопіллі", 5), ("Підгірцях", 6), ("Радехова", 7), ("м. Вовчанську", 8), ("Vovchansk", 8), ("djdxfycmr", 8), ("Миронівці", 9),
    ("Мироновка", 9), ("старого радехова", 10), ("Ніжил.", 11), ("Х о р о л", 12), ("Хоролу", 12), ("дуже далеко звідси де колись давно стояло біля річки одне велике село Миронівка над водою", 9), ("Вовчий Яр", 0), ("Миронопіль", 0),
])
def test_places_unseen(spark, typed, place, _cache={}):
    if not _cache:
        cases = [t for t, _ in test_places_unseen.pytestmark[0].args[1]]
        ref = spark.createDataFrame([(i + 1, p) for i, p in enumerate(UNSEEN)], "loc_id INT, canonical_name STRING")
        v = spark.createDataFrame([("s", i, t) for i, t in enumerate(cases)], "src STRING, text_id BIGINT, mention STRING")
        one = {r.text_id: r.loc_id for r in linking.linked(v, ref).collect()}
        assert one == {r.text_id: r.loc_id for r in linking.linked(v, ref, forms_in=50, readings_in=7).collect()}  # several lists and tasks
        _cache.update({t: one[i] for i, t in enumerate(cases)})
    assert _cache[typed] == place


def test_prefix_join_loses_no_similar_pair():
    rng = random.Random(4)
    words = ["".join(rng.choice("абвгд") for _ in range(rng.randint(3, 14))) for _ in range(300)]
    counts = np.zeros(linking._BUCKETS, dtype=np.int64)
    for w in words:
        for g in linking.bigrams(w):
            counts[linking._rank(g)] += 1
    index = linking.Index([(w, False) for w in words], counts, 0.35)
    for w in words[:100]:
        p = linking.bigrams(w)
        want = {v for v in words if len(p & linking.bigrams(v)) >= 0.35 * len(p | linking.bigrams(v)) and linking.distance(w, v, linking.allowed(len(v))) <= linking.allowed(len(v))}
        assert {words[i] for i, _, _ in index.probe(w, False)} == want


def test_distance():
    assert [linking.distance(a, b, 2) for a, b in (("abc", "abc"), ("abc", "acb"), ("abc", "xyzw"), ("", "ab"))] == [0, 1, 3, 2]


def test_mix_reaches_targets(spark):
    rng = random.Random(1)
    docs = [(i, "слово " * rng.randint(3, 60), "a" if i % 3 else "b", "z") for i in range(600)] + [(900, "довге " * 3000, "a", "z"), (901, None, "a", "z"), (902, "", "b", "z"), (903, "x y", None, "z"), (904, "x y", "unused", "z")]
    d = spark.createDataFrame(docs, "doc_id BIGINT, text STRING, source STRING, rate STRING")
    w = spark.createDataFrame([("a", 0.3, 1), ("b", 0.65, 2), ("none", 0.05, 3)], "source STRING, target_share DOUBLE, max_repeats INT")
    m = mixing.balance(d, w)
    r = {x.source: x for x in m.report.collect()}
    assert r["none"].exhausted and not r["a"].exhausted and all(x.converged for x in r.values())
    c = mixing.copies(m)
    assert c.count() == 603 and c.where("copies > 2 OR (source = 'a' AND copies > 1) OR copies < 0").isEmpty()
    expected = {x.source: x.t for x in c.groupBy("source").agg(F.sum(F.col("rate") * F.col("n_tokens")).alias("t")).collect()}
    assert expected["a"] == pytest.approx(r["a"].reachable_tokens, rel=1e-4) and expected["b"] == pytest.approx(r["b"].reachable_tokens, rel=1e-4)
    s = {x.source: x.actual_tokens for x in mixing.shares(m).collect()}
    assert s["none"] == 0 and s["b"] == pytest.approx(expected["b"], rel=0.01) and s["a"] == pytest.approx(expected["a"], rel=0.01)
    assert mixing.copies(mixing.balance(d.limit(0), w)).isEmpty()
    assert not mixing.balance(d, w, rounds=1).report.where("source = 'b'").first().converged


def test_one_size_in_several_bins(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BIN", 7)
    d = spark.createDataFrame([(i, "одне й те саме", "a") for i in range(100)] + [(5, "одне й те саме", "a")] * 20, "doc_id BIGINT, text STRING, source STRING")
    m = mixing.balance(d, spark.createDataFrame([("a", 0.5, 3)], "source STRING, target_share DOUBLE, max_repeats INT"))
    assert mixing.copies(m).agg(F.sum("copies")).first()[0] == 30


@pytest.mark.parametrize("text", ["的一是在不了有和人这中大为上个国我以要他时来用们。" * 1_100, "กขคงจชซณดตถทนบปผพภมยรลวศสห" * 1_000, "слово " * 9_000, "a" * 30_000, " " * 25_000 + "x", "x \n y" * 6_000])
def test_tokens_of_long_texts(text):
    path = common.tokenizer_path()
    assert len(text) > 20_000 and tokens.count(text, path) == len(tokens.encoder(path).encode_ordinary(text))
