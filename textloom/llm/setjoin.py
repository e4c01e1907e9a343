"""Sets of distinct words as tables: shared by the joins between similar texts.

A text's set is kept as sorted 64-bit word hashes (two different words of one comparison collide with a probability
under 1e-15); texts with equal sets share one 64-bit `key`, so copies are compared once and expanded at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import words

_CACHE: dict[str, int] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def word_hashes(text: str) -> list[int]:
    """64-bit hashes of the words of a text, in order."""
    out = []
    for w in words(text):
        h = _CACHE.get(w)
        if h is None:
            if len(_CACHE) > 400_000:
                _CACHE.clear()
            h = _CACHE[w] = xxhash.xxh3_64_intdigest(w)
        out.append(h)
    return out


def flat_sets(blobs: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All hashes of a binary column end to end, and the offsets at which each row begins (one more at the end)."""
    sizes = np.array([0 if b is None else len(b) // 8 for b in blobs.to_pylist()], dtype=np.int64)
    joined = b"".join(b for b in blobs.to_pylist() if b)
    return np.frombuffer(joined, dtype=np.uint64), np.concatenate([[0], np.cumsum(sizes)])


def sketches(flat: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """96-bit parity sketches of sets, as 64 and 32 bits: the Hamming distance of two sketches never exceeds the sets' symmetric difference."""
    if not len(flat):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32)
    slot = (mix(flat) >> np.uint64(32)) % np.uint64(96)
    low = slot < np.uint64(64)
    wide = np.where(low, np.uint64(1) << (slot & np.uint64(63)), np.uint64(0))
    narrow = np.where(low, np.uint32(0), np.uint32(1) << (slot & np.uint64(31)).astype(np.uint32))
    return np.bitwise_xor.reduceat(wide, at), np.bitwise_xor.reduceat(narrow, at)


def distance(w1: np.ndarray, n1: np.ndarray, w2: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """Hamming distances of sketches."""
    return np.bitwise_count(w1 ^ w2).astype(np.int64) + np.bitwise_count(n1 ^ n2)


def word_sets(df: DataFrame, id_col: str = "text_id", text_col: str = "text", least: int = 14, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, keep..., key, n, toks): one row per input row whose text has at least `least` distinct words. NULL ids and NULL, empty or blank texts give none."""
    src = df.select(F.col(id_col).alias("id"), *[F.col(c) for c in keep], F.col(text_col).alias("_text")).where("id IS NOT NULL AND _text IS NOT NULL")
    extra = "".join(f", {c} {t}" for c, t in src.dtypes if c in keep)

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rows, sets = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                s = set(word_hashes(t))
                if len(s) >= least:
                    rows.append(i)
                    sets.append(sorted(s))
            if not rows:
                continue
            n = np.array([len(s) for s in sets], dtype=np.int64)
            flat = np.fromiter((h for s in sets for h in s), dtype=np.uint64, count=int(n.sum()))
            at = np.concatenate([[0], np.cumsum(n)[:-1]])
            key = mix(np.add.reduceat(mix(flat), at) + n.astype(np.uint64)).view(np.int64)
            raw = flat.tobytes()
            toks = [raw[8 * a:8 * (a + m)] for a, m in zip(at.tolist(), n.tolist())]
            took = pa.array(rows)
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(took), *[b.column(c).take(took) for c in keep], pa.array(key), pa.array(n.astype(np.int32)), pa.array(toks, pa.binary())],
                names=["id", *keep, "key", "n", "toks"],
            )

    return src.mapInArrow(kernel, f"id {dict(src.dtypes)['id']}{extra}, key BIGINT, n INT, toks BINARY")


def bloom(df: DataFrame, col: str) -> np.ndarray:
    """A Bloom filter of a 64-bit column, built by one aggregation: 16 to 32 bits a row, between 512 KB and 16 MB. Beyond some eight million rows it only lets more through, which is more work and no loss."""
    rows = df.count()
    size = 1 << max(16, min(21, (max(1, rows // 4) - 1).bit_length()))
    bit = lambda k: f"shiftleft(1L, CAST(shiftrightunsigned({col}, {k}) & 63 AS INT))"
    t = df.groupBy(F.expr(f"CAST({col} & {size - 1} AS INT)").alias("w")).agg(F.expr(f"bit_or({bit(40)} | {bit(46)})").alias("b")).toArrow()
    out = np.zeros(size, dtype=np.uint64)
    out[t.column("w").to_numpy()] = t.column("b").to_numpy().view(np.uint64)
    return out


def bits_of(keys: np.ndarray) -> np.ndarray:
    """The same filter of 64-bit numbers at hand."""
    size = 1 << max(16, min(21, (max(1, len(keys) // 4) - 1).bit_length()))
    out, one, six = np.zeros(size, dtype=np.uint64), np.uint64(1), np.uint64(63)
    np.bitwise_or.at(out, (keys & np.uint64(size - 1)).astype(np.int64), (one << ((keys >> np.uint64(40)) & six)) | (one << ((keys >> np.uint64(46)) & six)))
    return out


def in_bloom(bits: np.ndarray, key: np.ndarray) -> np.ndarray:
    k, one, six = key.view(np.uint64), np.uint64(1), np.uint64(63)
    w = bits[(k & np.uint64(len(bits) - 1)).astype(np.int64)]
    need = (one << ((k >> np.uint64(40)) & six)) | (one << ((k >> np.uint64(46)) & six))
    return (w & need) == need


def verified(pairs: DataFrame, sets: DataFrame, gamma_num: int, gamma_den: int) -> DataFrame:
    """Of candidate pairs (a, b), a written table, of set keys those whose Jaccard similarity is at least gamma_num / gamma_den, with the overlap.

    Only sets that a bounded Bloom filter of the candidates lets through are shuffled to the pairs."""
    sides = pairs.select(F.explode(F.array("a", "b")).alias("key"))
    bits = sets.sparkSession.sparkContext.broadcast(bloom(sides, "key"))

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            hit = in_bloom(bits.value, b.column("key").to_numpy())
            _, first = np.unique(b.column("key").to_numpy(), return_index=True)
            once = np.zeros(len(hit), dtype=bool)
            once[first] = True
            yield b.filter(pa.array(hit & once))

    held = sets.select("key", "toks").mapInArrow(kernel, "key BIGINT, toks BINARY").groupBy("key").agg(F.min("toks").alias("toks"))
    both = pairs.join(held.withColumnsRenamed({"key": "a", "toks": "ta"}), "a").join(held.withColumnsRenamed({"key": "b", "toks": "tb"}), "b")

    def overlap(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                o = len(np.intersect1d(p, q, assume_unique=True))
                n.append((o, len(p) + len(q) - o))
            ok = [i for i, (o, u) in enumerate(n) if o * gamma_den >= gamma_num * u]
            yield pa.RecordBatch.from_arrays(
                [b.column("a").take(pa.array(ok, pa.int64())), b.column("b").take(pa.array(ok, pa.int64())), pa.array([n[i][0] for i in ok], pa.int32()), pa.array([n[i][1] for i in ok], pa.int32())],
                names=["a", "b", "overlap", "union_size"],
            )

    return both.select("a", "b", "ta", "tb").mapInArrow(overlap, "a BIGINT, b BIGINT, overlap INT, union_size INT")


def by_partition(df: DataFrame, parts: int) -> DataFrame:
    """Rows (pid, ...) brought to the partition that they name."""
    return df.repartitionById(parts, F.col("pid"))


#: From so many equal neighbours on, pairs are compared in blocks.
RUN = 64


def close_pairs(order_key: np.ndarray, keys: np.ndarray, near, chunk: int = 4_000_000) -> np.ndarray:
    """Unordered pairs (a < b) of different `keys` among equal neighbours in sorted `order_key` that `near(i, j)` admits; memory is bounded by the chunk, not by the pairs. Long runs of neighbours go to `near.blocks(rows, cols)`, if it has that: it yields the admitted pairs of two ranges."""
    found, n, kept, limit = [], len(order_key), 0, 1_000_000
    alive, d = np.arange(n - 1 if n else 0), 1
    if n and hasattr(near, "blocks"):
        start = np.flatnonzero(np.concatenate([[True], order_key[1:] != order_key[:-1]]))
        length = np.diff(np.concatenate([start, [n]]))
        for s, w in zip(start[length >= RUN].tolist(), length[length >= RUN].tolist()):
            for i, j in near.blocks((s, s + w), None):
                a, b = keys[i], keys[j]
                m = a != b
                if m.any():
                    found.append(np.stack([np.minimum(a, b)[m], np.maximum(a, b)[m]], axis=1))
                    kept += len(found[-1])
                    if kept > limit:
                        found = [np.unique(np.concatenate(found), axis=0)]
                        kept, limit = 0, max(1_000_000, len(found[0]))
        alive = alive[~np.repeat(length >= RUN, length)[:-1]]
    while len(alive):
        alive = alive[alive + d < n]
        alive = alive[order_key[alive] == order_key[alive + d]]
        for s in range(0, len(alive), chunk):
            i = alive[s:s + chunk]
            j = i + d
            ok = near(i, j)
            i, j = i[ok], j[ok]
            a, b = keys[i], keys[j]
            m = a != b
            if m.any():
                found.append(np.stack([np.minimum(a, b)[m], np.maximum(a, b)[m]], axis=1))
                kept += len(found[-1])
                if kept > limit:
                    found = [np.unique(np.concatenate(found), axis=0)]
                    kept, limit = 0, max(1_000_000, len(found[0]))
        d += 1
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), dtype=keys.dtype)


def cross_pairs(left_order: np.ndarray, left: np.ndarray, right_order: np.ndarray, right: np.ndarray, near, chunk: int = 4_000_000) -> np.ndarray:
    """Pairs (a < b) of different keys, one of `left`, one of `right`, whose order keys (both sorted) are equal and that `near(i, j)` admits; memory is bounded by the chunk."""
    lo, hi = np.searchsorted(right_order, left_order, "left"), np.searchsorted(right_order, left_order, "right")
    width = hi - lo
    ends = np.cumsum(width)
    found, a = [np.empty((0, 2), dtype=left.dtype)], 0
    while a < len(width):
        if hasattr(near, "blocks") and width[a] >= RUN:
            e = int(np.searchsorted(left_order, left_order[a], "right"))
            for i, j in near.blocks((a, e), (int(lo[a]), int(hi[a]))):
                x, y = left[i], right[j]
                m = x != y
                if m.any():
                    found.append(np.stack([np.minimum(x, y)[m], np.maximum(x, y)[m]], axis=1))
                    if sum(map(len, found)) > 2_000_000:
                        found = [np.unique(np.concatenate(found), axis=0)]
            a = e
            continue
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + chunk, side="right")))
        w = width[a:b]
        i = np.repeat(np.arange(a, b), w)
        j = np.arange(len(i)) - np.repeat(np.cumsum(w) - w, w) + np.repeat(lo[a:b], w)
        a = b
        ok = near(i, j) & (left[i] != right[j])
        if ok.any():
            x, y = left[i[ok]], right[j[ok]]
            found.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
            if sum(map(len, found)) > 2_000_000:
                found = [np.unique(np.concatenate(found), axis=0)]
    return np.unique(np.concatenate(found), axis=0)
