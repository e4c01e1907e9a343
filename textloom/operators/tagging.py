"""Part-of-speech tagging: token features, lexicon and majority taggers, and a linear-chain CRF."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import affixes, shape


def token_features(tokens: DataFrame, sentence: str = "sentence_id", order: str = "token_id", form: str = "form") -> DataFrame:
    """Each token with its neighbours' forms, flags for the sentence's ends, its place, affixes and shape."""
    w = Window.partitionBy(sentence).orderBy(order)
    x = tokens.withColumn("prev_form", F.lower(F.lag(form).over(w))).withColumn("next_form", F.lower(F.lead(form).over(w))).withColumn("position", F.row_number().over(w) - 1)
    return x.withColumn("bos", F.col("prev_form").isNull()).withColumn("eos", F.col("next_form").isNull()).withColumn("affix", affixes(form)).withColumn("shape", shape(form))


def lexicon(train: DataFrame, form: str = "form", label: str = "upos", order: str = "seq") -> DataFrame:
    """(form, label): the most frequent label of each lower-case form, ties to the first seen."""
    from .stats import majority

    return majority(train.withColumn("form", F.lower(form)), "form", label, order).select("form", label)


def tag_by_lexicon(tokens: DataFrame, lexicon_: DataFrame, fallback: str, form: str = "form", label: str = "upos") -> DataFrame:
    """`pred` from the lexicon, the fallback label for unknown forms."""
    l = lexicon_.withColumnRenamed(label, "_l").withColumnRenamed("form", "_f")
    return tokens.join(l, F.lower(tokens[form]) == F.col("_f"), "left").withColumn("pred", F.coalesce("_l", F.lit(fallback))).drop("_l", "_f")


def oov_rate(tokens: DataFrame, by: str = "split", train: str = "train", form: str = "form") -> DataFrame:
    """(split, tokens, oov_rate): share of tokens whose lower-case form is not in the training part. Tokens are counted by form and part first, so that what meets is a form's few counts."""
    c = tokens.groupBy(F.lower(form).alias("_f"), by).agg(F.count("*").alias("n"))
    f = c.groupBy("_f").agg(F.max((F.col(by) == train).cast("int")).alias("known"), F.collect_list(F.struct(by, "n")).alias("parts"))  # as many parts as there are splits
    x = f.select("known", F.inline("parts"))
    return x.groupBy(by).agg(F.sum("n").alias("tokens"), F.round(F.sum(F.col("n") * (1 - F.col("known"))) / F.sum("n"), 6).alias("oov_rate"))


@dataclass
class Crf:
    """Hashed emission weights [buckets, labels] and transitions [labels, labels]."""

    labels: list[str]
    emission: np.ndarray
    transition: np.ndarray


def _hashed(forms: list[str], buckets: int) -> list[list[int]]:
    low = [f.lower() for f in forms]
    out = []
    for i, w in enumerate(low):
        f = [f"w={w}", f"s2={w[-2:]}", f"s3={w[-3:]}", f"p2={w[:2]}", f"cap={forms[i][:1].isupper()}", f"dig={any(c.isdigit() for c in w)}", f"-1={low[i - 1] if i else '<s>'}", f"+1={low[i + 1] if i + 1 < len(low) else '</s>'}", f"alpha={w.isalpha()}"]
        out.append([zlib.crc32(x.encode()) % buckets for x in f])
    return out


def _packed(forms: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sentences by falling length, position by position: (row of each sentence that has tokens, how many of them have each position, place of each token in the flat forms, its window, hashed features of each window). A window is a token with its neighbours; each is hashed once."""
    lengths = np.asarray(forms.value_lengths().fill_null(0)).astype(np.int64)
    coded = forms.flatten().dictionary_encode()
    ids, vocab = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary.to_pylist()
    start = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")[: int((lengths > 0).sum())]
    if not len(order):
        return order, np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.empty((0, 9), np.int64)
    n, v = len(ids), len(vocab) + 2  # and the words before and after a sentence
    before, after = np.empty(n, np.int64), np.empty(n, np.int64)
    before[1:], after[:-1] = ids[:-1], ids[1:]
    before[start[order]], after[(start + lengths - 1)[order]] = v - 2, v - 1
    pairs, own = np.unique(before * v + ids, return_inverse=True)
    window, inverse = np.unique(own * np.int64(v) + after, return_inverse=True)
    pair, last = pairs[window // v], window % v
    words = [*vocab, "<s>", "</s>"]
    single = np.array([_hashed([w], buckets)[0] for w in vocab], dtype=np.int64)
    crc = lambda x: zlib.crc32(x.encode()) % buckets
    prev_, next_ = (np.array([crc(mark + (w.lower() if k < v - 2 else w)) for k, w in enumerate(words)]) for mark in ("-1=", "+1="))
    features = single[pair % v].copy()
    features[:, 6], features[:, 7] = prev_[pair // v], next_[last]
    counts = len(order) - np.searchsorted(lengths[order][::-1], np.arange(1, int(lengths.max()) + 1))
    place = np.concatenate([start[order[:c]] + k for k, c in enumerate(counts.tolist())])
    return order, counts, place, inverse[place], features


def _gradient(em: np.ndarray, tr: np.ndarray, counts: np.ndarray, window: np.ndarray, features: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The gradient of the log-likelihood of sentences as `_packed` gives them; forward and backward sums of all sentences at once, position by position, scaled to a sum of 1."""
    k, n = em.shape[1], len(window)
    s = np.zeros((k, len(features)))  # a row per label: what is summed lies apart
    for f in features.T:
        s += em.T[:, f]
    s -= s.max(axis=0)
    e = np.take(np.exp(s), window, axis=1)
    t = np.exp(tr - tr.max())
    end = np.cumsum(counts)
    at = list(zip((end - counts).tolist(), end.tolist()))
    a, c = np.empty((k, n)), np.empty(n)
    for i, (lo, hi) in enumerate(at):
        x = a[:, lo:hi]
        if i:
            first = at[i - 1][0]
            np.matmul(t.T, a[:, first:first + hi - lo], out=x)
            x *= e[:, lo:hi]
        else:
            x[:] = e[:, lo:hi]
        np.maximum(x.sum(axis=0), 1e-300, out=c[lo:hi])
        x /= c[lo:hi]
    e /= c
    dt = np.zeros((k, k))
    z = np.ones((k, n))
    for i in range(len(at) - 1, 0, -1):
        (lo, hi), first = at[i], at[i - 1][0]
        before = slice(first, first + hi - lo)
        x = e[:, lo:hi] * z[:, lo:hi]
        np.matmul(t, x, out=z[:, before])
        dt += np.bincount(tags[before] * k + tags[lo:hi], minlength=k * k).reshape(k, k) - t * (a[:, before] @ x.T)
    a *= z
    de = np.empty_like(em)
    for y in range(k):
        by = np.bincount(window, (tags == y) - a[y], len(features))
        de[:, y] = sum(np.bincount(f, by, len(em)) for f in features.T)
    return de, dt


def train_crf(sentences: DataFrame, labels: list[str], buckets: int = 1 << 13, rounds: int = 8, rate: float = 0.5, l2: float = 1e-4) -> Crf:
    """Maximum-likelihood training of (forms ARRAY<STRING>, tags ARRAY<STRING>) rows: each round is one pass that sums exact gradients per partition (fixed size, a number of partitions that the cores bound) and a step with per-weight rates. Features are hashed once, before the first round."""
    at = {l: i for i, l in enumerate(labels)}
    k = len(labels)
    model = Crf(labels, np.zeros((buckets, k)), np.zeros((k, k)))
    ge, gt = np.full((buckets, k), 1e-8), np.full((k, k), 1e-8)
    spark = sentences.sparkSession

    def pack(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            forms, tags = b.column("forms"), b.column("tags")
            index = pc.index_in(tags.flatten(), pa.array(labels, pa.string())).fill_null(-1).to_numpy().astype(np.int32)
            own = np.asarray(tags.value_lengths().fill_null(-1))
            bad = np.bincount(np.repeat(np.arange(len(own)), np.maximum(own, 0)), index < 0, len(own))
            ok = pa.array((own == np.asarray(forms.value_lengths().fill_null(0))) & (bad == 0))
            forms, tags = forms.filter(ok), tags.filter(ok)
            _, counts, place, window, features = _packed(forms, buckets)
            if not len(place):
                continue
            y = pc.index_in(tags.flatten(), pa.array(labels, pa.string())).to_numpy().astype(np.int32)[place]
            yield pa.RecordBatch.from_arrays([pa.array([x.astype(np.int32).tobytes()], pa.binary()) for x in (counts, window, features, y)], names=["counts", "window", "features", "y"])

    cores = max(1, spark.sparkContext.defaultParallelism)
    src = sentences.select("forms", "tags").mapInArrow(pack, "counts BINARY, window BINARY, features BINARY, y BINARY").coalesce(2 * cores).persist()
    for _ in range(rounds):
        held = spark.sparkContext.broadcast((model.emission, model.transition))

        def grads(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            em, tr = held.value
            de, dt = np.zeros_like(em), np.zeros_like(tr)
            for b in it:
                for row in zip(*(b.column(c).to_pylist() for c in ("counts", "window", "features", "y"))):
                    counts, window, features, y = (np.frombuffer(x, dtype=np.int32).astype(np.int64) for x in row)
                    e, t = _gradient(em, tr, counts, window, features.reshape(-1, 9), y)
                    de += e
                    dt += t
            yield pa.RecordBatch.from_arrays([pa.array([de.tobytes()], pa.binary()), pa.array([dt.tobytes()], pa.binary())], names=["e", "t"])

        de, dt = np.zeros((buckets, k)), np.zeros((k, k))
        for r in src.mapInArrow(grads, "e BINARY, t BINARY").collect():  # two rows a core
            de += np.frombuffer(r.e).reshape(buckets, k)
            dt += np.frombuffer(r.t).reshape(k, k)
        held.destroy()
        de -= l2 * model.emission
        dt -= l2 * model.transition
        ge += de**2
        gt += dt**2
        model.emission = model.emission + rate * de / np.sqrt(ge)
        model.transition = model.transition + rate * dt / np.sqrt(gt)
    src.unpersist()
    return model


def _best_tags(forms: pa.Array, model: Crf) -> pa.Array:
    """`viterbi` of all sentences of a list column at once."""
    order, counts, place, window, features = _packed(forms, len(model.emission))
    lengths = np.asarray(forms.value_lengths().fill_null(0)).astype(np.int64)
    out = np.empty(int(lengths.sum()), dtype=np.int64)
    if len(order):
        s = model.emission[features].sum(axis=1)[window]
        end = np.cumsum(counts)
        start = end - counts
        back, best = np.empty(s.shape, dtype=np.int8 if s.shape[1] < 128 else np.int32), s[: counts[0]].copy()
        for i in range(1, len(counts)):
            m = best[: counts[i], :, None] + model.transition
            back[start[i]:end[i]] = m.argmax(axis=1)
            best[: counts[i]] = s[start[i]:end[i]] + m.max(axis=1)
        last = best.argmax(axis=1)
        for i in range(len(counts) - 1, -1, -1):
            here = last[: counts[i]]
            out[place[start[i]:end[i]]] = here
            if i:
                last[: counts[i]] = back[np.arange(start[i], end[i]), here]
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(model.labels, pa.string()).take(pa.array(out)))


def viterbi(forms: list[str], model: Crf) -> list[str]:
    """The best label sequence of one sentence."""
    if not forms:
        return []
    s = np.stack([model.emission[x].sum(axis=0) for x in _hashed(forms, len(model.emission))])
    best, back = s[0], []
    for i in range(1, len(forms)):
        m = best[:, None] + model.transition
        back.append(m.argmax(axis=0))
        best = s[i] + m.max(axis=0)
    y = [int(best.argmax())]
    for b in reversed(back):
        y.append(int(b[y[-1]]))
    return [model.labels[i] for i in reversed(y)]


def tag_by_crf(sentences: DataFrame, model: Crf, keep: tuple[str, ...] = ("sentence_id",)) -> DataFrame:
    """(keep..., pred): predicted tags beside each sentence's forms."""
    held = sentences.sparkSession.sparkContext.broadcast(model)
    src = sentences.select(*keep, "forms")
    types = dict(src.dtypes)

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.RecordBatch.from_arrays([*b.columns, _best_tags(b.column("forms"), held.value)], names=[*b.schema.names, "pred"])

    return src.mapInArrow(kernel, ", ".join(f"{n} {types[n]}" for n in keep) + ", forms ARRAY<STRING>, pred ARRAY<STRING>")
