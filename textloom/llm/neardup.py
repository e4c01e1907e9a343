"""Problem 4: groups of records that are small edits of one another, by PartEnum signatures.

For a Jaccard threshold g two sets of sizes s <= t can only be similar if s >= g*t, and then differ in at most
(1-g)/(1+g)*(s+t) words. Sizes are cut into bands whose ends are g apart; a set signs at its own band's level and at the
next, so every similar pair meets at the level of the larger set's band, where it differs in at most k words. There the
word domain is hashed into n1 parts of n2 slots: some part differs in at most k2 = ceil((k+1)/n1)-1 words, so some
n2-k2 of its slots are equal, and that subset's contents are a signature both sets have. Nothing similar is missed;
buckets are thinned by size and a 96-bit parity sketch (whose Hamming distance never exceeds the sets'), and the rest is
compared exactly.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, partitions_for, written
from .setjoin import by_partition, close_pairs, cross_pairs, distance, flat_sets, mix, sketches, verified, word_sets

#: Sizes beyond MOST are stored as MOST and not thinned by size.
MOST = 65_535
#: Pairs of a block of sketches that are compared at once.
BLOCK = 1 << 19
_ENTRY = np.dtype([("sig", "<u4"), ("n", "<u2"), ("key", "<i8"), ("wide", "<u8"), ("narrow", "<u4")])


def bands(least: int, num: int, den: int, most: int) -> list[tuple[int, int]]:
    """Size bands [lo, hi] from `least` on with hi <= lo*den/num, up to one that holds `most`."""
    out, lo = [], max(1, least)
    while not out or out[-1][1] < most:
        hi = max(lo, lo * den // num)
        out.append((lo, hi))
        lo = hi + 1
    return out


def plan(hi: int, num: int, den: int, strength: int) -> tuple[int, int, int, int]:
    """(k, n1, n2, k2) of the level whose larger sets have up to `hi` words. Higher strengths sign larger subsets more often: fewer chance meetings for more signatures."""
    k = 2 * hi * (den - num) // (den + num)
    k2 = min(1 + strength, k)
    n1 = -(-(k + 1) // (k2 + 1))
    k2 = -(-(k + 1) // n1) - 1
    return k, n1, k2 + 2 + (strength > 0) if k2 else 1, k2


def _sign(flat: np.ndarray, at: np.ndarray, n: np.ndarray, level: int, hi: int, num: int, den: int, strength: int) -> np.ndarray:
    """Signatures [sets, signatures] of one level."""
    k, n1, n2, k2 = plan(hi, num, den, strength)
    slots = n1 * n2
    h = mix(flat + np.uint64(0x9E3779B97F4A7C15 * (strength + 1) & 0xFFFFFFFFFFFFFFFF))
    doc = np.repeat(np.arange(len(n)), n)
    cell = doc * slots + (h % np.uint64(slots)).astype(np.int64)
    o = np.argsort(cell, kind="stable")
    c = cell[o]
    start = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.empty(0, np.int64)
    content = np.zeros(len(n) * slots, dtype=np.uint64)
    if len(c):
        content[c[start]] = np.add.reduceat(mix(h)[o], start)
    content = content.reshape(len(n), slots)
    sigs = []
    for i in range(n1):
        for which, subset in enumerate(itertools.combinations(range(n2), n2 - k2)):
            s = np.full(len(n), np.uint64((level * 1_000_003 + i * 1_009 + which) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
            for q in subset:
                s = mix(s + content[:, i * n2 + q])
            sigs.append(s)
    return np.stack(sigs, axis=1)


def _entries(sets: DataFrame, parts: int, least: int, num: int, den: int, strength: int) -> DataFrame:
    """(pid, blob): packed signatures by the partition that compares them; equal sets of a batch sign once."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            keys, first = np.unique(b.column("key").to_numpy(), return_index=True)
            flat, at = flat_sets(b.column("toks").take(pa.array(first)))
            n = np.diff(at)
            wide, narrow = sketches(flat, at[:-1])
            out = []
            levels = bands(least, num, den, int(n.max(initial=1)))
            levels.append((levels[-1][1] + 1, (levels[-1][1] + 1) * den // num))
            for level, (lo, hi) in enumerate(levels):
                below = levels[level - 1][0] if level else lo
                own = np.flatnonzero((n >= below) & (n <= hi) & (n * den >= lo * num))
                if not len(own):
                    continue
                pick = np.concatenate([np.arange(at[i], at[i + 1]) for i in own])
                sig = _sign(flat[pick], None, n[own], level, hi, num, den, strength)
                e = np.empty(sig.size, dtype=_ENTRY)
                s = sig.reshape(-1)
                e["sig"] = (s >> np.uint64(32)).astype(np.uint32)
                e["n"] = np.repeat(np.minimum(n[own], MOST), sig.shape[1])
                e["key"] = np.repeat(keys[own], sig.shape[1])
                e["wide"] = np.repeat(wide[own], sig.shape[1])
                e["narrow"] = np.repeat(narrow[own], sig.shape[1])
                out.append((((s & np.uint64(0xFFFFFFFF)) % np.uint64(parts)).astype(np.int32), e))
            if not out:
                continue
            pid, e = np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])
            o = np.argsort(pid, kind="stable")
            pid, e = pid[o], e[o]
            cut = np.flatnonzero(np.concatenate([[True], pid[1:] != pid[:-1]]))
            yield pa.RecordBatch.from_arrays([pa.array(pid[cut]), pa.array([x.tobytes() for x in np.split(e, cut[1:])], pa.binary())], names=["pid", "blob"])

    return sets.select("key", "toks").mapInArrow(kernel, "pid INT, blob BINARY")


def _once(e: np.ndarray) -> np.ndarray:
    """Entries sorted by signature and key, each once."""
    e = e[np.lexsort((e["key"], e["sig"]))]
    return e[np.concatenate([[True], (e["sig"][1:] != e["sig"][:-1]) | (e["key"][1:] != e["key"][:-1])])] if len(e) else e


class _Near:
    """Whether sizes and sketches allow entry i of one list and entry j of another to be similar enough."""

    def __init__(self, x: np.ndarray, y: np.ndarray, num: int, den: int):
        self.x, self.y = ({c: e[c].astype(np.int64) if c == "n" else e[c].copy() for c in ("n", "wide", "narrow")} for e in (x, y))
        self.num, self.den = num, den

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        x, y, num, den = self.x, self.y, self.num, self.den
        p, q = x["n"][i], y["n"][j]
        ok = (np.minimum(p, q) * den >= np.maximum(p, q) * num) & (distance(x["wide"][i], x["narrow"][i], y["wide"][j], y["narrow"][j]) * (num + den) <= (p + q) * (den - num))
        return ok | (p == MOST) | (q == MOST)

    def blocks(self, rows: tuple[int, int], cols: tuple[int, int] | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Admitted pairs (i, j) of a range of one list and a range of the other, or i, j of one range. By size, and then in blocks, of which the sketches' first 64 bits are compared at once: no entry is gathered but those that pass."""
        x, y = self.x, self.y
        a = rows[0] + np.argsort(x["n"][rows[0]:rows[1]], kind="stable")
        b = a if cols is None else cols[0] + np.argsort(y["n"][cols[0]:cols[1]], kind="stable")
        p, q, u, v = x["n"][a], y["n"][b], x["wide"][a], y["wide"][b]
        height = max(64, min(1024, BLOCK // len(b)))
        for r in range(0, len(a), height):
            k = min(len(a), r + height)
            least, most = int(p[r]), int(p[k - 1])
            first = int(np.searchsorted(q, -(-least * self.num // self.den)))
            last = len(b) if most == MOST else int(np.searchsorted(q, min(MOST - 1, most * self.den // self.num), side="right"))
            spans = [(r if cols is None else first, last)]
            if last < len(b) and q[-1] == MOST:  # sizes stored as MOST meet every other
                spans.append((max(last, int(np.searchsorted(q, MOST))), len(b)))
            for lo, hi in spans:
                for c in range(lo, hi, step := max(1, BLOCK // (k - r))):
                    d = min(hi, c + step)
                    open_ = most == MOST or int(q[d - 1]) == MOST
                    top = 64 if open_ else min(64, (most + int(q[d - 1])) * (self.den - self.num) // (self.num + self.den))
                    i, j = np.divmod(np.flatnonzero(np.bitwise_count(u[r:k, None] ^ v[None, c:d]) <= top), d - c)
                    i, j = i + r, j + c
                    if cols is None:
                        up = j > i
                        i, j = i[up], j[up]
                    i, j = a[i], b[j]
                    ok = self(i, j)
                    yield i[ok], j[ok]


def _rows(pairs: np.ndarray | None = None, chunks: list[tuple[int, int, np.ndarray]] = ()) -> Iterator[pa.RecordBatch]:
    """Output batches (a, b, grp, chunk, blob) of `_meet`: pairs, or the chunks of a group."""
    if pairs is not None:
        for s in range(0, len(pairs), 100_000):
            x = pairs[s:s + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy()), pa.nulls(len(x), pa.int64()), pa.nulls(len(x), pa.int32()), pa.nulls(len(x), pa.binary())], names=_MEET)
    for grp, chunk, e in chunks:
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([grp], pa.int64()), pa.array([chunk], pa.int32()), pa.array([e.tobytes()], pa.binary())], names=_MEET)


_MEET = ["a", "b", "grp", "chunk", "blob"]


def _meet(entries: DataFrame, num: int, den: int, limit: int, hold: int) -> DataFrame:
    """(a, b): pairs of keys with a signature in common, a size ratio and a sketch distance that allow the similarity. (grp, chunk, blob): entries of buckets larger than `limit`, or of a partition larger than `hold`, in chunks of at most `limit`, to be compared chunk by chunk."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, given, pid = [], 0, 0, 0
        for b in it:
            for pid, x in zip(b.column("pid").to_pylist(), b.column("blob").to_pylist()):
                held.append(np.frombuffer(x, dtype=_ENTRY))
                size += len(held[-1])
                if size > hold:
                    held = [_once(np.concatenate(held))]
                    size = len(held[0])
                    if size > hold // 2:  # a partition out of proportion leaves this task as it comes
                        for s in range(0, size, limit):
                            yield from _rows(chunks=[(pid, given, held[0][s:s + limit])])
                            given += 1
                        held, size = [], 0
        if not held:
            return
        e = _once(np.concatenate(held))
        held.clear()
        if given:
            for s in range(0, len(e), limit):
                yield from _rows(chunks=[(pid, given, e[s:s + limit])])
                given += 1
            return
        same = e["sig"][1:] == e["sig"][:-1]
        e = e[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(e) > 1 else e[:0]
        sig = e["sig"].copy()
        start = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.empty(0, np.int64)
        length = np.diff(np.concatenate([start, [len(sig)]]))
        for s, n in zip(start[length > limit].tolist(), length[length > limit].tolist()):
            grp = -(pid * (1 << 32) + int(sig[s]) + 1)
            for k in range(0, n, limit):
                yield from _rows(chunks=[(grp, k // limit, e[s + k:min(s + n, s + k + limit)])])
        small = e[~np.repeat(length > limit, length)]
        yield from _rows(close_pairs(small["sig"].copy(), small["key"].copy(), _Near(small, small, num, den)))

    return entries.mapInArrow(kernel, "a BIGINT, b BIGINT, grp BIGINT, chunk INT, blob BINARY")


def _chunk_pairs(chunks: DataFrame, num: int, den: int, parts: int) -> DataFrame:
    """(a, b): the same pairs from a table of chunks (grp, chunk, blob): each two chunks of a group are one cell, and cells are spread over the tasks."""
    most = chunks.groupBy("grp").agg(F.max("chunk").alias("q"))
    cell = chunks.join(most, "grp").withColumn("other", F.explode(F.expr("sequence(0, q)"))).select("grp", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "blob")

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, left = None, None
        for b in it:
            for g, i, j, blob in zip(*(b.column(c).to_pylist() for c in ("grp", "i", "j", "blob"))):
                e = np.frombuffer(blob, dtype=_ENTRY)
                e = e[np.argsort(e["sig"], kind="stable")]
                if i == j:
                    yield from _pair_rows(close_pairs(e["sig"].copy(), e["key"].copy(), _Near(e, e, num, den)))
                elif before == (g, i, j):
                    yield from _pair_rows(cross_pairs(left["sig"].copy(), left["key"].copy(), e["sig"].copy(), e["key"].copy(), _Near(left, e, num, den)))
                else:
                    before, left = (g, i, j), e

    return cell.repartition(parts, "grp", "i", "j").sortWithinPartitions("grp", "i", "j", "chunk").mapInArrow(kernel, "a BIGINT, b BIGINT")


def _pair_rows(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    for b in _rows(pairs):
        yield b.select(["a", "b"])


def similar_sets(sets: DataFrame, least: int = 14, num: int = 3, den: int = 4, limit: int = 150_000, strength: int = 0, hold: int = 3_000_000) -> DataFrame:
    """(a, b, overlap, union_size): every pair a < b of different set keys with a Jaccard similarity of at least num/den.

    `sets` is a written table (key, n, toks). Buckets of more than `limit` sets, and partitions of more than `hold`
    entries, are compared in pairs of chunks of at most `limit`, spread over tasks: nothing is left out, and no task holds
    more. `strength` 1 or 2 signs larger subsets more often, worth it from some ten million sets on."""
    spark = sets.sparkSession
    parts = partitions_for(spark, 1 + sets.count() * 50 // 600_000)  # about 16 MB of signatures each
    met = written(_meet(by_partition(_entries(sets, parts, least, num, den, strength), parts), num, den, limit, hold), "met")
    pairs = met.where("a IS NOT NULL").select("a", "b")
    chunks = met.where("grp IS NOT NULL").select("grp", "chunk", "blob")
    if not chunks.isEmpty():
        pairs = pairs.unionByName(_chunk_pairs(chunks, num, den, parts))
    distinct = written(pairs.distinct(), "pairs")
    out = written(verified(distinct, sets, num, den), "similar")
    dropped(met, distinct)
    return out


def near_duplicates(df: DataFrame, id_col: str = "text_id", text_col: str = "text", least: int = 14, num: int = 3, den: int = 4) -> tuple[DataFrame, DataFrame]:
    """The operator: (members, links).

    members (id, key, n): each distinct id with at least `least` distinct words, and the key of its set of words; ids
    with equal sets share a key. links (a, b, overlap, union_size): pairs of different keys that are similar. Repeated
    rows count once; NULL ids and NULL, empty, blank or short texts take no part; other columns are ignored."""
    sets = written(word_sets(df, id_col, text_col, least), "sets")
    links = similar_sets(sets, least, num, den)
    members = written(sets.select("id", "key", "n").distinct(), "members")
    dropped(sets)
    return members, links


def pairs_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(text_id_a, text_id_b): every pair of ids, smaller first, whose sets are equal or linked."""
    m = members.select("id", "key")
    x, y = m.withColumnsRenamed({"id": "i", "key": "a"}), m.withColumnsRenamed({"id": "j", "key": "b"})
    repeated = m.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    copies = m.join(repeated, "key", "left_semi")
    same = copies.withColumnRenamed("id", "i").join(copies.withColumnRenamed("id", "j"), "key").where("i < j").select("i", "j")
    linked = links.select("a", "b").join(x, "a").join(y, "b").where("i <> j").select("i", "j")
    return same.unionByName(linked).select(F.least("i", "j").alias("text_id_a"), F.greatest("i", "j").alias("text_id_b")).distinct()


def groups_of(members: DataFrame, links: DataFrame) -> DataFrame:
    """(id, class_id, copies, links): one row per id; class_id is the least key of its connected component, copies counts the ids with the same set, links the different sets its own is similar to.

    Components are found by letting the least key spread along the links; each round is written to the shared folder."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    label = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("c"), F.count("*").alias("links")), "label")
    while True:
        spread = both.join(label.select(F.col("a").alias("b"), "c"), "b").groupBy("a").agg(F.min("c").alias("d"))
        hop = label.select(F.col("a").alias("c"), F.col("c").alias("e"))
        step = written(label.join(spread, "a").join(hop, "c", "left").select("a", F.least("c", "d", "e").alias("f"), "c", "links"), "label")
        label = step.select("a", F.col("f").alias("c"), "links")
        if step.where("f <> c").isEmpty():
            break
    sizes = members.groupBy("key").agg(F.count("*").alias("copies"))
    return (
        members.join(sizes, "key").join(label.withColumnRenamed("a", "key"), "key", "left")
        .where("copies > 1 OR links IS NOT NULL")
        .select("id", F.coalesce("c", "key").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"))
    )
