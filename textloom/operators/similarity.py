"""Exact cosine joins by prefix filtering: of unit vectors given as (doc, term, weight), and of the TF-IDF vectors of documents.

Terms are ordered by rarity; a vector's prefix ends where its residual norm falls below the threshold, so two vectors whose
prefixes share no term cannot reach it. Only prefixes are joined; candidates are verified exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cosine_pairs(weights: DataFrame, threshold: float) -> DataFrame:
    """(doc_a, doc_b, cosine) with doc_a < doc_b and a cosine of at least the threshold, rounded to 6 places."""
    rarity = weights.groupBy("term").agg(F.count("*").alias("df"))
    w = Window.partitionBy("doc").orderBy("df", "term")  # a document's own terms
    ordered = weights.join(rarity, "term").withColumn("before", F.sum(F.col("weight") * F.col("weight")).over(w) - F.col("weight") * F.col("weight"))
    prefix = ordered.where(1 - F.col("before") >= threshold * threshold - 1e-9).select("doc", "term")
    cand = prefix.select(F.col("doc").alias("doc_a"), "term").join(prefix.select(F.col("doc").alias("doc_b"), "term"), "term").where("doc_a < doc_b").select("doc_a", "doc_b").distinct()
    vec = weights.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("term", "weight"))).alias("v"))
    both = cand.join(vec.withColumnsRenamed({"doc": "doc_a", "v": "va"}), "doc_a").join(vec.withColumnsRenamed({"doc": "doc_b", "v": "vb"}), "doc_b")
    dot = F.aggregate(F.map_entries("va"), F.lit(0.0), lambda s, e: s + e["value"] * F.coalesce(F.try_element_at("vb", e["key"]), F.lit(0.0)))
    return both.select("doc_a", "doc_b", F.round(dot, 6).alias("cosine")).where(F.col("cosine") >= threshold)


#: Terms are hashed to so many classes; the norms of two vectors within the classes bound their dot product.
CLASSES = 32
#: Pairs of a block of class norms that are multiplied at once, and candidates verified at once.
BLOCK, VERIFIED = 1 << 20, 20_000


def _close(term: np.ndarray, at: np.ndarray, idx: np.ndarray, w: np.ndarray, t: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, dot) of vectors with a dot product of at least t among postings sorted by `term`. Posting k has terms idx[at[k]:at[k + 1]], in order of rarity, and weights w; a pair is given only in the list of its first common term."""
    n = np.diff(at)
    row = np.repeat(np.arange(len(n)), n)
    cls = (idx.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(59)).astype(np.int64)  # 32 classes
    norms = np.sqrt(np.bincount(row * CLASSES + cls, w * w, len(n) * CLASSES)).astype(np.float32).reshape(len(n), CLASSES)
    width = np.int64(idx.max(initial=0)) + 1
    place = row * width + idx  # sorted

    def verified(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m = n[i]
        ends = np.cumsum(m)
        k = np.arange(ends[-1]) + np.repeat(at[i] - ends + m, m)
        want = np.repeat(j, m) * width + idx[k]
        q = np.minimum(np.searchsorted(place, want), len(place) - 1)
        hit = place[q] == want
        pair = np.repeat(np.arange(len(i)), m)
        dot = np.bincount(pair[hit], w[k[hit]] * w[q[hit]], len(i))
        common, first = np.unique(pair[hit], return_index=True)
        ok = np.zeros(len(i), dtype=bool)
        ok[common] = idx[k[hit][first]] == term[i[common]]
        ok &= dot >= t
        return i[ok], j[ok], dot[ok]

    start = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]])) if len(term) else np.empty(0, np.int64)
    left, right, held = [], [], 0
    for s, e in zip(start.tolist(), np.concatenate([start[1:], [len(term)]]).tolist()):
        height = max(32, BLOCK // (e - s))
        for a in range(s, e, height):
            b = min(e, a + height)
            for c in range(a, e, step := max(1, BLOCK // (b - a))):
                i, j = np.nonzero(norms[a:b] @ norms[c:min(e, c + step)].T >= t - 1e-4)
                i, j = i + a, j + c
                up = j > i
                left.append(i[up])
                right.append(j[up])
                held += len(left[-1])
                if held >= VERIFIED:
                    i, j = np.concatenate(left), np.concatenate(right)
                    for x in range(0, held, VERIFIED):
                        yield verified(i[x:x + VERIFIED], j[x:x + VERIFIED])
                    left, right, held = [], [], 0
    if held:
        yield verified(np.concatenate(left), np.concatenate(right))


def document_pairs(texts: DataFrame, threshold: float, min_df: int = 2, most: int = 4_000_000) -> DataFrame:
    """(doc_a, doc_b, cosine) with doc_a < doc_b and a cosine of at least the threshold, rounded to 6 places, of the TF-IDF vectors of a (doc, terms) table with a row per text; rows of one doc are one vector.

    The vectors are those of `features.tfidf`. Terms in at least `min_df` documents travel as a table of 64-bit hashes, if they are at most `most`; a posting of each term of a prefix then carries its whole vector, so that nothing else is shuffled. A larger vocabulary goes through joins."""
    from .features import tfidf

    spark = texts.sparkSession
    docs = texts.select("doc", F.transform("terms", lambda x: F.xxhash64(x)).alias("h")).groupBy("doc").agg(F.count("*").alias("texts"), F.flatten(F.collect_list("h")).alias("h")).persist()
    total = docs.agg(F.coalesce(F.sum("texts"), F.lit(0)).alias("n"), F.count("*").alias("docs")).first()
    known = docs.select(F.explode(F.array_distinct("h")).alias("h")).groupBy("h").agg(F.count("*").alias("df")).where(F.col("df") >= min_df).limit(most + 1).toArrow()
    if known.num_rows > most:
        docs.unpersist()
        counts = texts.select("doc", F.explode("terms").alias("term")).groupBy("doc", "term").agg(F.count("*").alias("tf"))
        return cosine_pairs(tfidf(counts, texts.agg(F.count("*").alias("n")), min_df, 1.0, False), threshold)
    h, df = known.column("h").to_numpy(), known.column("df").to_numpy()
    rank = np.empty(len(h), dtype=np.int32)
    rank[np.lexsort((h, df))] = np.arange(len(h))
    idf = np.empty(len(h))
    idf[rank] = np.log((1 + total.n) / (1 + df)) + 1
    o = np.argsort(h)
    held = spark.sparkContext.broadcast((h[o], rank[o], idf))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")), 1 + total.docs // 20_000)
    least = threshold - 5e-7 - 1e-9  # what rounds to the threshold

    def vectors(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, rank, idf = held.value
        for b in it:
            col = b.column("h")
            flat = col.flatten().to_numpy()
            row = np.repeat(np.arange(len(col)), np.asarray(col.value_lengths().fill_null(0)))
            q = np.minimum(np.searchsorted(hashes, flat), max(0, len(hashes) - 1))
            hit = hashes[q] == flat if len(hashes) else np.zeros(len(flat), dtype=bool)
            if not hit.any():
                continue
            place, tf = np.unique(row[hit] * len(hashes) + rank[q[hit]], return_counts=True)
            row, idx = place // len(hashes), place % len(hashes)
            w = tf * idf[idx]
            first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            n = np.diff(np.concatenate([first, [len(row)]]))
            square = w * w / np.repeat(np.add.reduceat(w * w, first), n)
            done = np.cumsum(square) - square
            own = np.flatnonzero(1 - (done - np.repeat(done[first], n)) >= least * least - 1e-9)
            order = np.repeat(np.arange(len(n)), n)[own]  # the vector of each posting
            pack = np.stack([idx, tf], axis=1).astype(np.int32).tobytes()
            blob = [pack[8 * s:8 * (s + m)] for s, m in zip(first.tolist(), n.tolist())]
            pid = ((idx[own].astype(np.uint64) * np.uint64(0xC4CEB9FE1A85EC53) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(pid), pa.array(idx[own].astype(np.int32)), b.column("doc").take(pa.array(row[own])), pa.array(blob, pa.binary()).take(pa.array(order))], names=["pid", "term", "doc", "vector"]
            )

    def pairs(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf = held.value[2]
        batches = [b for b in it if b.num_rows]
        if not batches:
            return
        got = pa.Table.from_batches(batches)
        batches.clear()
        got = got.take(pa.array(np.argsort(got.column("term").to_numpy(), kind="stable"))).combine_chunks()
        blobs = got.column("vector").to_pylist()
        flat = np.frombuffer(b"".join(blobs), dtype=np.int32).reshape(-1, 2)
        at = np.concatenate([[0], np.cumsum([len(x) // 8 for x in blobs])])
        idx, w = flat[:, 0].astype(np.int64), flat[:, 1] * idf[flat[:, 0]]
        w = w / np.repeat(np.sqrt(np.add.reduceat(w * w, at[:-1])), np.diff(at))
        doc = got.column("doc").combine_chunks()
        for i, j, dot in _close(got.column("term").to_numpy(), at, idx, w, least):
            yield pa.RecordBatch.from_arrays([doc.take(pa.array(i)), doc.take(pa.array(j)), pa.array(dot)], names=["a", "b", "dot"])

    kind = dict(texts.dtypes)["doc"]
    posted = docs.where("doc IS NOT NULL").select("doc", "h").mapInArrow(vectors, f"pid INT, term INT, doc {kind}, vector BINARY").repartitionById(parts, F.col("pid"))
    found = posted.mapInArrow(pairs, f"a {kind}, b {kind}, dot DOUBLE")
    return found.select(F.least("a", "b").alias("doc_a"), F.greatest("a", "b").alias("doc_b"), F.round("dot", 6).alias("cosine")).where(F.col("cosine") >= threshold)
