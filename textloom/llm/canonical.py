"""Problem 6: visually identical text with different characters.

One pass over the texts lists the values (words, runs of blanks) that are not in consistent form, with their look-alike
mapping, and counts all other words. In SQL the mapped values are grouped under Unicode's accent-sensitive collation, each
class gets one deterministic canonical member (written consistently, most frequent, greatest), and that member is joined
back to the distinct values. What is left for the texts are the values whose canonical member is not their mapping; texts
are rewritten where they are read, and neither texts nor every occurrence of a value travel to a join.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import _PLAIN_WORDS, _WORDS, _MARKS_POSSIBLE, odd_values
from .common import dropped, written

_SCHEMA = "src STRING, row_key STRING, text_md5 STRING, start INT, len INT, value STRING, mapped STRING, n BIGINT"
_NAMES = ["src", "row_key", "text_md5", "start", "len", "value", "mapped", "n"]


def scan(rows: DataFrame) -> DataFrame:
    """Of (src, row_key, text): a row per value out of form (n NULL), and the counts of all words in form (row_key NULL), flushed before a task's table outgrows a fixed size."""

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def flush() -> pa.RecordBatch:
            w = list(seen)
            none = pa.nulls(len(w), pa.string())
            out = pa.RecordBatch.from_arrays([none, none, none, pa.nulls(len(w), pa.int32()), pa.nulls(len(w), pa.int32()), pa.array(w, pa.string()), pa.array(w, pa.string()), pa.array([seen[x] for x in w], pa.int64())], names=_NAMES)
            seen.clear()
            return out

        for b in it:
            at, got = [], []
            for i, text in enumerate(b.column("text").to_pylist()):
                if not text:
                    continue
                odd = odd_values(text)
                if odd:
                    at += [i] * len(odd)
                    got += odd
                else:
                    seen.update((_WORDS if _MARKS_POSSIBLE.search(text) else _PLAIN_WORDS).findall(text))
            for s in range(0, len(at), 50_000):
                e = s + 50_000
                idx, g = pa.array(at[s:e], pa.int64()), got[s:e]
                yield pa.RecordBatch.from_arrays(
                    [b.column(c).take(idx) for c in ("src", "row_key", "text_md5")]
                    + [pa.array([x[0] for x in g], pa.int32()), pa.array([x[1] for x in g], pa.int32()), pa.array([x[2] for x in g], pa.string()), pa.array([x[3] for x in g], pa.string()), pa.nulls(len(g), pa.int64())],
                    names=_NAMES,
                )
            if len(seen) > 300_000:
                yield flush()
        if seen:
            yield flush()

    return rows.select("src", "row_key", F.md5("text").alias("text_md5"), "text").mapInArrow(kernel, _SCHEMA)


_CLASSES = """
WITH odd AS (SELECT value, mapped, count(*) AS n FROM {scan} WHERE n IS NULL GROUP BY value, mapped),
members AS (
  SELECT mapped COLLATE UNICODE AS cls, value AS member, 0 AS in_form, n FROM odd
  UNION ALL SELECT mapped COLLATE UNICODE, mapped, 1, 0L FROM odd
  UNION ALL SELECT w.mapped COLLATE UNICODE, w.value, 1, w.n FROM (SELECT value, mapped, sum(n) AS n FROM {scan} WHERE n IS NOT NULL GROUP BY value, mapped) w
            LEFT SEMI JOIN (SELECT DISTINCT mapped COLLATE UNICODE AS mapped FROM odd) o ON w.mapped COLLATE UNICODE = o.mapped
),
ranked AS (SELECT cls, member COLLATE UTF8_BINARY AS member, max(in_form) AS in_form, sum(n) AS n FROM members GROUP BY cls, member COLLATE UTF8_BINARY)
SELECT cls, max_by(member, struct(in_form, n, member)) AS canonical, count(*) AS members FROM ranked GROUP BY cls
"""


def classes(scanned: DataFrame) -> DataFrame:
    """(cls, canonical, members): one row per equivalence class that holds a value out of form."""
    return scanned.sparkSession.sql(_CLASSES, scan=scanned)


_EXCEPTIONS = """
SELECT o.value, o.mapped, c.canonical
FROM (SELECT DISTINCT value, mapped FROM {scan} WHERE n IS NULL) o JOIN {classes} c ON o.mapped COLLATE UNICODE = c.cls
WHERE o.mapped <> c.canonical
"""
#: Values whose canonical member is not their mapping that are broadcast; more are joined to the values of each row.
MAX_EXCEPTIONS = 500_000


def exceptions(scanned: DataFrame) -> DataFrame:
    """(value, mapped, canonical): distinct values out of form whose class has another canonical member than their mapping."""
    return scanned.sparkSession.sql(_EXCEPTIONS, scan=scanned, classes=classes(scanned))


def replacements(rows: DataFrame) -> DataFrame:
    """(src, row_key, text_md5, start, len, value, canonical): the values of (src, row_key, text) to be written otherwise. NULL and empty texts have none; equal rows repeat theirs."""
    scanned = written(scan(rows), "scan")
    return _replaced(scanned, written(exceptions(scanned), "exceptions"))


def _replaced(scanned: DataFrame, other: DataFrame) -> DataFrame:
    odd = scanned.where("n IS NULL").drop("n")
    if other.isEmpty():
        joined = odd.withColumn("canonical", F.col("mapped"))
    else:
        joined = odd.join(other, ["value", "mapped"], "left").withColumn("canonical", F.coalesce("canonical", "mapped"))
    return joined.where("value <> canonical").select("src", "row_key", "text_md5", "start", "len", "value", "canonical")


def found(rows: DataFrame) -> DataFrame:
    """(src, row_key): records with any character out of form."""
    return replacements(rows).select("src", "row_key").distinct()


def rewritten(text: str | None, other: dict[tuple[str, str], str]) -> tuple[str | None, int]:
    """The text in consistent form and how many of its values were replaced."""
    if not text:
        return text, 0
    out, at, n = [], 0, 0
    for start, size, value, mapped in odd_values(text):
        new = other.get((value, mapped), mapped)
        if new != value:
            out += [text[at:start], new]
            at = start + size
            n += 1
    return "".join([*out, text[at:]]) if n else text, n


def consistent(rows: DataFrame, most: int = MAX_EXCEPTIONS) -> DataFrame:
    """(src, row_key, text, consistent_text, replaced): every row of (src, row_key, text) in consistent form; NULL stays NULL, repeated rows stay repeated."""
    scanned = written(scan(rows), "scan")
    other = written(exceptions(scanned), "exceptions")
    base = rows.select("src", "row_key", "text")
    if other.count() > most:
        pieces = _replaced(scanned, other).groupBy("src", "row_key", "text_md5").agg(F.array_sort(F.collect_set(F.struct("start", "len", "canonical"))).alias("pieces"))
        joined = base.withColumn("text_md5", F.md5("text")).join(pieces, ["src", "row_key", "text_md5"], "left")
        done = F.expr(
            "aggregate(pieces, struct(CAST('' AS STRING) AS o, 0 AS at), (a, p) -> struct(concat(a.o, substring(text, a.at + 1, p.start - a.at), p.canonical) AS o, p.start + p.len AS at), a -> concat(a.o, substring(text, a.at + 1)))"
        )
        return joined.select("src", "row_key", "text", F.when(F.col("pieces").isNull(), F.col("text")).otherwise(done).alias("consistent_text"), F.when(F.col("pieces").isNull(), 0).otherwise(F.size("pieces")).alias("replaced"))
    held = rows.sparkSession.sparkContext.broadcast({(r.value, r.mapped): r.canonical for r in other.toLocalIterator()})
    dropped(scanned, other)

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            new = [rewritten(t, held.value) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x[0] for x in new], pa.string()), pa.array([x[1] for x in new], pa.int32())], names=["src", "row_key", "text", "consistent_text", "replaced"])

    return base.mapInArrow(kernel, "src STRING, row_key STRING, text STRING, consistent_text STRING, replaced INT")
