"""Problem 3: records of evaluation splits that also stand, exactly or nearly, in the training split.

A cosine join of term-weight vectors between the two sides. A vector has a weight per distinct word (inverse document
frequency, or 1) and unit length. Terms are put in one global order, rare ones first; a vector lists only the terms from
which on its residual norm still reaches the threshold t. Of two vectors x, y that list a term, the dot product is at most

* sum(x) * max(y) and sum(y) * max(x), whole vectors (maximum weights): one range of the list sorted by maximum weight;
* 1 - sum(H * min(least squared weights)) / 2 over six classes of terms by weight, H the Hamming distance of the parity
  sketches of a class, since the squared distance of the vectors is 2 - 2 * dot and every word of one of them only adds
  its squared weight to it;
* w(x) * w(y) + min(|rest x| * |rest y|, sum(rest x) * max(y), sum(rest y) * max(x)), if this is their first common term
  (residual norms and maximum weights); a pair is met there in any case.

Pairs below t by any of these are dropped, the dot products of the rest are exact. A list of a term that many vectors
share is cut into a grid of cells, so that no task holds or pairs more than a fixed number of postings of a term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, partitions_for, written
from .setjoin import bloom, by_partition, flat_sets, in_bloom, mix, word_sets

#: Documents of a term are counted by hash bucket in a table of fixed size (1 MB): the order of terms only affects speed, and the idf of a term is that of its bucket.
BUCKETS = 1 << 18
#: Documents of a term in a row or column of its grid; buckets hold more terms as a corpus grows, so four times their mean if that is more.
CELL = 20_000
#: Classes of terms by weight, each with a parity sketch of 32 bits; two share a number.
CLASSES = 6
_VALUES = ("w", "norm", "rest", "max", "sum", *(f"least{k}" for k in range(CLASSES)))
_SKETCHES = tuple(f"sketch{k}" for k in range(CLASSES // 2))
_POST = np.dtype([("term", "<u4"), *((v, "<f4") for v in _VALUES), ("key", "<i8"), *((v, "<u8") for v in _SKETCHES), ("side", "u1")])
#: Pairs of a block of sketches that are compared at once.
BLOCK = 1 << 19
_SLACK = 1e-5  # weights travel as 32-bit numbers
_SALT = np.uint64(0x9E3779B97F4A7C15)


def _bucket(terms: np.ndarray) -> np.ndarray:
    return (terms & np.uint64(BUCKETS - 1)).astype(np.int64)


def term_counts(sets: DataFrame) -> np.ndarray:
    """How many sets hold a term of each bucket of the term hash; all sets count."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, dtype=np.int64)
        for b in it:
            flat, _ = flat_sets(b.column("toks"))
            total += np.bincount(_bucket(flat), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(BUCKETS, dtype=np.int64)
    for r in sets.select("toks").mapInArrow(kernel, "bucket INT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        out[r.bucket] = r.n
    return out


def term_weights(counts: np.ndarray, sets: int, weights: str) -> np.ndarray:
    """The weight of a term by bucket: "idf" is log(1 + sets / documents), "unit" is 1."""
    if weights == "unit":
        return np.ones(BUCKETS)
    if weights != "idf":
        raise ValueError("weights must be 'idf' or 'unit'")
    return np.log1p(max(1, sets) / np.maximum(counts, 1))


def term_classes(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The class of a term by bucket, by falling weight, an equal part of all squared weight each; equal weights are dealt out."""
    if weight.min() == weight.max():
        return (np.arange(BUCKETS) % CLASSES).astype(np.uint8)
    o = np.argsort(-weight, kind="stable")
    mass = np.cumsum((counts * weight * weight)[o])
    out = np.empty(BUCKETS, dtype=np.uint8)
    out[o] = np.minimum(CLASSES - 1, (CLASSES * mass / max(mass[-1], 1e-300)).astype(np.int64))
    return out


def class_sketches(flat: np.ndarray, at: np.ndarray, cls: np.ndarray) -> list[np.ndarray]:
    """32-bit parity sketches of the terms of each class, two classes in a number."""
    c = cls[_bucket(flat)].astype(np.uint64)
    bit = np.uint64(1) << ((mix(flat) >> np.uint64(32)) % np.uint64(32) + np.uint64(32) * (c % np.uint64(2)))
    return [np.bitwise_xor.reduceat(np.where(c // np.uint64(2) == np.uint64(k), bit, np.uint64(0)), at) for k in range(CLASSES // 2)]


def listed(flat: np.ndarray, at: np.ndarray, counts: np.ndarray, weight: np.ndarray, cls: np.ndarray, t: float) -> tuple[np.ndarray, ...]:
    """(vector, term, w, norm, rest, max, sum, least of each class) of the terms that each of the vectors lists, norm and rest being the length and the sum of what follows."""
    n = np.diff(at)
    doc = np.repeat(np.arange(len(n)), n)
    raw = weight[_bucket(flat)]
    length = np.sqrt(np.add.reduceat(raw * raw, at[:-1]))
    o = np.lexsort((flat, counts[_bucket(flat)], doc))
    term, w = flat[o], raw[o] / length[doc]
    done = np.cumsum(w * w)
    before = done - w * w - (done - w * w)[at[:-1]][doc]
    added = np.cumsum(w)
    total = np.add.reduceat(w, at[:-1])
    rest = total[doc] - (added - (added - w)[at[:-1]][doc])
    least = np.full((len(n), CLASSES), 4.0)  # more than any: a class without terms does not lower the other vector's
    np.minimum.at(least, (doc, cls[_bucket(term)]), w * w)
    own = 1 - before >= t * t - 1e-9
    d = doc[own]
    return d, term[own], w[own], np.sqrt(np.maximum(0, 1 - before - w * w))[own], np.maximum(rest, 0)[own], np.maximum.reduceat(w, at[:-1])[d], total[d], *(least[d, k] for k in range(CLASSES))


def cells(term: np.ndarray, key: np.ndarray, side: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(posting, list): the list or lists that each posting goes to. Of a term with more than `size` documents evaluation postings choose a row, training postings a column of a grid of lists, and each goes to all cells of it: any two of different sides meet in one cell."""
    s = np.maximum(1, -(-count // size))
    at = np.repeat(np.arange(len(term)), s)
    other = np.arange(len(at)) - np.repeat(np.cumsum(s) - s, s)
    own = (mix(key.view(np.uint64))[at] % s[at].astype(np.uint64)).astype(np.int64)
    row, col = np.where(side[at] == 1, other, own), np.where(side[at] == 1, own, other)
    return at, mix(term[at] + (row * s[at] + col).astype(np.uint64) * _SALT)


def _postings(sets: DataFrame, held, parts: int, t: float, cell: int) -> DataFrame:
    """(pid, blob): postings of each vector by the partition that holds the term's list; equal sets of one side are posted once a batch."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weight, cls = held.value
        for b in it:
            both = np.stack([b.column("key").to_numpy(), b.column("side").to_numpy().astype(np.int64)], axis=1)
            uniq, first = np.unique(both, axis=0, return_index=True)
            flat, at = flat_sets(b.column("toks").take(pa.array(first)))
            if not len(flat):
                continue
            sketch = class_sketches(flat, at[:-1], cls)
            d, term, *values = listed(flat, at, counts, weight, cls, t)
            p = np.empty(len(d), dtype=_POST)
            for name, v in zip(_VALUES, values):
                p[name] = v
            for name, v in zip(_SKETCHES, sketch):
                p[name] = v[d]
            p["key"], p["side"] = uniq[d, 0], uniq[d, 1]
            i, lists = cells(term, p["key"].copy(), p["side"], counts[_bucket(term)], cell)
            p = p[i]
            p["term"] = (lists >> np.uint64(32)).astype(np.uint32)
            pid = ((lists & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32)
            o = np.argsort(pid, kind="stable")
            pid, p = pid[o], p[o]
            cut = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(pid[cut]), pa.array([x.tobytes() for x in np.split(p, cut[1:])], pa.binary())], names=["pid", "blob"])

    return sets.select("key", "side", "toks").mapInArrow(kernel, "pid INT, blob BINARY")


def _offered(x: dict[str, np.ndarray], y: dict[str, np.ndarray], lo: np.ndarray, hi: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) with lo[i] <= j < hi[i], at most some millions at once. Of long ranges those are left out whose sketches differ too much even at the least weights of their block: whole blocks are compared at once, without gathering entries."""
    width = hi - lo
    ends = np.cumsum(width)
    a = 0
    while a < len(width):
        most = int(width[a:a + 64].max())
        if most >= 256 and len(width) - a >= 4:
            b = min(len(width), a + max(64, BLOCK // max(1, most)))
            first, last = int(lo[a:b].min()), int(hi[a:b].max())
            step = max(1, BLOCK // (b - a))
            if (b - a) * (last - first) <= 16 * int(width[a:b].sum()):
                for c in range(first, last, step):
                    i, j = np.divmod(np.flatnonzero(_alike(x, y, slice(a, b), slice(c, min(last, c + step)), t)), min(last, c + step) - c)
                    i, j = i + a, j + c
                    ok = (j >= lo[i]) & (j < hi[i])
                    yield i[ok], j[ok]
                a = b
                continue
        b = max(a + 1, min(a + 64 if len(width) - a >= 68 else len(width), int(np.searchsorted(ends, (ends[a - 1] if a else 0) + 2_000_000, side="right"))))
        w = width[a:b]
        i = np.repeat(np.arange(a, b), w)
        yield i, np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(lo[a:b], w)
        a = b


def _alike(x: dict[str, np.ndarray], y: dict[str, np.ndarray], rows: slice, cols: slice, t: float) -> np.ndarray:
    """A matrix: whether the sketches of two vectors allow the threshold, at the least weights of any vector of the block, rounded down to 255ths of their largest."""
    least = [min(x[n][rows].min(), y[n][cols].min()) for n in _VALUES[5:]]
    least = np.minimum(least[::2], least[1::2])
    scale = 255 / max(float(least.max()), 1e-30)
    part = np.floor(least * scale * (1 - 1e-6)).astype(np.uint16)  # at most 255 * 64 for each of three sketches: no overflow
    shape = rows.stop - rows.start, cols.stop - cols.start
    differ, bits = np.empty(shape, dtype=np.uint64), np.empty(shape, dtype=np.uint8)
    same = part.min() == part.max()  # then bits are counted and weighed at the end
    total = np.zeros(shape, dtype=np.uint8 if same else np.uint16)
    for name, weight in zip(_SKETCHES, part):
        np.bitwise_xor(x[name][rows, None], y[name][None, cols], out=differ)
        np.bitwise_count(differ, out=bits)
        total += bits if same else bits * weight
    if same:
        return total <= min(192, math.floor(2 * (1 - t) * scale * (1 + 1e-6) / max(int(part[0]), 1e-9)))
    return total <= min(65_535, math.floor(2 * (1 - t) * scale * (1 + 1e-6)))


def met_in(p: np.ndarray, t: float) -> np.ndarray:
    """Rows (evaluation key, training key) of the postings of some lists whose bounds reach t. A set posted several times counts once."""
    t -= _SLACK
    low = np.uint64(0xFFFFFFFF)
    o = np.lexsort((p["key"], p["side"], p["term"]))
    term, side, key = p["term"][o], p["side"][o], p["key"][o]
    once = np.concatenate([[True], (term[1:] != term[:-1]) | (side[1:] != side[:-1]) | (key[1:] != key[:-1])])
    p = p[o[once]]
    p = p[np.lexsort((-p["max"], p["side"], p["term"]))]
    cut = np.flatnonzero(np.concatenate([[True], p["term"][1:] != p["term"][:-1]]))
    found, kept = [np.empty((0, 2), dtype=np.int64)], 0
    for s, e in zip(cut, np.concatenate([cut[1:], [len(p)]])):
        mid = s + int(np.searchsorted(p["side"][s:e], 1))
        if mid == s or mid == e:
            continue
        x, y = {c: p[c][s:mid].copy() for c in _POST.names}, {c: p[c][mid:e].copy() for c in _POST.names}
        hi = np.searchsorted(-y["max"], -t / x["sum"], side="right")
        lo = np.minimum(np.searchsorted(np.maximum.accumulate(y["sum"]), t / x["max"]), hi)
        for i, j in _offered(x, y, lo, hi, t):
            apart = np.zeros(len(i), dtype=np.float32)  # a lower bound of the squared distance
            for k, name in enumerate(_SKETCHES):
                differ, u, v = x[name][i] ^ y[name][j], f"least{2 * k}", f"least{2 * k + 1}"
                apart = apart + np.bitwise_count(differ & low) * np.minimum(x[u][i], y[u][j]) + np.bitwise_count(differ >> np.uint64(32)) * np.minimum(x[v][i], y[v][j])
                ok = apart <= 2 * (1 - t)
                i, j, apart = i[ok], j[ok], apart[ok]
            ok = y["sum"][j] * x["max"][i] >= t
            i, j = i[ok], j[ok]
            after = np.minimum(x["norm"][i] * y["norm"][j], np.minimum(x["rest"][i] * y["max"][j], y["rest"][j] * x["max"][i]))
            ok = x["w"][i] * y["w"][j] + after >= t
            if ok.any():
                found.append(np.stack([x["key"][i[ok]], y["key"][j[ok]]], axis=1))
                kept += len(found[-1])
                if kept > 2_000_000:
                    found, kept = [np.unique(np.concatenate(found), axis=0)], 0
    return np.unique(np.concatenate(found), axis=0)


def _probe(postings: DataFrame, t: float) -> DataFrame:
    """(a, b): keys of an evaluation set and a training set whose bounds allow the threshold."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(x, dtype=_POST) for b in it for x in b.column("blob").to_pylist()]
        if not held:
            return
        p = np.concatenate(held)
        held.clear()
        pairs = met_in(p, t)
        for s in range(0, len(pairs), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[s:s + 100_000, 0].copy()), pa.array(pairs[s:s + 100_000, 1].copy())], names=["a", "b"])

    return postings.mapInArrow(kernel, "a BIGINT, b BIGINT")


def _dots(pairs: DataFrame, sets: DataFrame, held, t: float) -> DataFrame:
    """(a, b, dot, overlap, union_size): of candidate pairs those whose exact dot product reaches t, with the number of common words and of all words. Only sets that a fixed-size Bloom filter of the candidates lets through are shuffled to them."""
    bits = sets.sparkSession.sparkContext.broadcast(bloom(pairs.select(F.explode(F.array("a", "b")).alias("key")), "key"))

    def asked(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            _, first = np.unique(b.column("key").to_numpy(), return_index=True)
            b = b.take(pa.array(np.sort(first)))
            yield b.filter(pa.array(in_bloom(bits.value, b.column("key").to_numpy())))

    own = sets.select("key", "toks").mapInArrow(asked, "key BIGINT, toks BINARY").groupBy("key").agg(F.min("toks").alias("toks"))
    both = pairs.join(own.withColumnsRenamed({"key": "a", "toks": "ta"}), "a").join(own.withColumnsRenamed({"key": "b", "toks": "tb"}), "b")

    def exact(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = held.value[1]
        for b in it:
            rows = []
            for k, (x, y) in enumerate(zip(b.column("ta").to_pylist(), b.column("tb").to_pylist())):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                common = np.intersect1d(p, q, assume_unique=True)
                square = lambda s: float(np.square(weight[_bucket(s)]).sum())
                dot = square(common) / math.sqrt(square(p) * square(q))
                if dot >= t - 1e-9:
                    rows.append((k, dot, len(common), len(p) + len(q) - len(common)))
            at = pa.array([r[0] for r in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [b.column("a").take(at), b.column("b").take(at), pa.array([r[1] for r in rows], pa.float64()), pa.array([r[2] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32())],
                names=["a", "b", "dot", "overlap", "union_size"],
            )

    return both.select("a", "b", "ta", "tb").mapInArrow(exact, "a BIGINT, b BIGINT, dot DOUBLE, overlap INT, union_size INT")


def cross_split(
    texts: DataFrame, splits: DataFrame, least: int = 14, cosine: float = 0.8, weights: str = "idf", train: str = "train", evaluation: tuple[str, ...] = ("val", "test"), cell: int = CELL
) -> tuple[DataFrame, DataFrame]:
    """The operator: (members, links).

    members (id, split, source, key, side, n): each distinct id with a split and enough words (side 1 is training), links
    (a, b, dot, overlap, union_size): evaluation set key and training set key with a cosine of at least `cosine`, also
    where both are the same key. Ids without a split, NULL, empty, blank and short texts take no part; repeated rows of
    either table count once; other columns are ignored."""
    spark = texts.sparkSession
    s = splits.select(F.col("text_id").alias("id"), "split").where(F.col("split").isin(train, *evaluation)).distinct()
    t = texts.select(F.col("text_id").alias("id"), "text", *(["source"] if "source" in texts.columns else [F.lit(None).cast("string").alias("source")]))
    joined = t.join(s, "id").withColumn("side", (F.col("split") == train).cast("int"))
    sets = written(word_sets(joined, "id", "text", least, ("split", "source", "side")), "sets")
    n = sets.count()
    counts = term_counts(sets)
    weight = term_weights(counts, n, weights)
    held = spark.sparkContext.broadcast((counts, weight, term_classes(counts, weight)))
    parts = partitions_for(spark, 1 + n * 12 // 200_000)  # about 16 MB of postings each
    cell = max(cell, 4 * int(counts.mean()))
    met = written(_probe(by_partition(_postings(sets, held, parts, cosine, cell), parts), cosine), "met")
    pairs = written(met.where("a <> b").distinct(), "pairs")
    members = written(sets.select("id", "split", "source", "key", "side", "n").distinct(), "members")
    same = members.groupBy("key").agg(F.min("side").alias("lo"), F.max("side").alias("hi"), F.min("n").alias("n")).where("lo < hi")
    same = same.select(F.col("key").alias("a"), F.col("key").alias("b"), F.lit(1.0).alias("dot"), F.col("n").alias("overlap"), F.col("n").alias("union_size"))
    links = written(_dots(pairs, sets, held, cosine).unionByName(same), "links")
    dropped(met, pairs, sets)
    return members, links


def jaccard_split(texts: DataFrame, splits: DataFrame, least: int = 14, num: int = 3, den: int = 4, **more) -> tuple[DataFrame, DataFrame]:
    """The operator for pairs defined by a Jaccard similarity g = num/den of word sets: with unit weights g implies a cosine of 2g/(1+g), so the join with that threshold loses none; the exact similarity follows from its common and all words."""
    members, links = cross_split(texts, splits, least, 2 * num / (num + den), "unit", **more)
    return members, links.where(F.col("overlap") * den >= F.col("union_size") * num)


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(text_id_a, text_id_b), smaller id first: one id of the pair is in the training split, the other in another."""
    m = members.select("id", "key", "side").distinct()
    x = m.where("side = 0").select(F.col("id").alias("i"), F.col("key").alias("a"))
    y = m.where("side = 1").select(F.col("id").alias("j"), F.col("key").alias("b"))
    return links.select("a", "b").join(x, "a").join(y, "b").where("i <> j").select(F.least("i", "j").alias("text_id_a"), F.greatest("i", "j").alias("text_id_b")).distinct()


def counts_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(split, source, texts, leaked, links): per evaluation split and source its ids, those with a training counterpart, and their links to training sets."""
    per = links.groupBy("a").agg(F.count("*").alias("links")).withColumnRenamed("a", "key")
    ev = members.where("side = 0").groupBy("id", "split", "key").agg(F.min("source").alias("source"))
    return ev.join(per, "key", "left").groupBy("split", "source").agg(
        F.countDistinct("id").alias("texts"), F.count_distinct(F.when(F.col("links").isNotNull(), F.col("id"))).alias("leaked"), F.coalesce(F.sum("links"), F.lit(0)).alias("links")
    )


def classes_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(text_id, split, source, class_id, links, best): one row per evaluation id with a training counterpart; class_id is shared by ids with the same set of words, links counts the training sets near it, best is the largest cosine."""
    per = links.groupBy("a").agg(F.count("*").alias("links"), F.round(F.max("dot"), 6).alias("best")).withColumnRenamed("a", "key")
    return members.where("side = 0").groupBy("id", "split", "key").agg(F.min("source").alias("source")).join(per, "key").select(F.col("id").alias("text_id"), "split", "source", F.col("key").alias("class_id"), "links", "best")
