"""Problem 8: passages of held-out items inside a large corpus.

The n-grams of the items' normalised words are a hash set of checked size, broadcast in blocks; every window of every text
is looked up, hits are verified word by word, and hits that continue one another are joined into spans. Words are compared
by their look: letters of several alphabets that look alike are one, whatever their neighbours say about the alphabet.
Documents are never shuffled, and cleaned texts come out of the pass that finds the hits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import _ALWAYS, _MARKS_POSSIBLE, _PLAIN_WORDS, _WORDS, CYRILLIC_LOOKALIKE, CYRILLIC_OF_GREEK, GREEK_OF_CYRILLIC, LATIN_LOOKALIKE, _composed, back_map, fix_text
from .setjoin import mix

#: N-grams broadcast at once; more items are searched in further blocks, each over all documents.
BLOCK = 1_000_000
_MULT = 0x9E3779B97F4A7C15


#: Small letters that look alike, or whose capitals do.
_LOOK = str.maketrans({a.lower(): b.lower() for a, b in zip(LATIN_LOOKALIKE + GREEK_OF_CYRILLIC, CYRILLIC_LOOKALIKE + CYRILLIC_OF_GREEK)})


class Codes(dict):
    """Numbers of words by their look among the items' words, 0 for any other word; words met are remembered, up to a fixed number."""

    def __init__(self, known: dict[str, int]):
        super().__init__()
        self.known = known

    def __reduce__(self):
        return Codes, (self.known,)

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        code = self[word] = self.known.get(word.translate(_LOOK), 0)
        return code


def _split(text: str) -> list[str]:
    """The words of a text without invisible characters and with composed letters, in small letters."""
    text = (_composed(text) if _ALWAYS.search(text) else text).lower()
    return (_WORDS if _MARKS_POSSIBLE.search(text) else _PLAIN_WORDS).findall(text)


def _word_codes(text: str, codes: Codes) -> np.ndarray:
    """Codes of the words of a text."""
    return np.array([codes[w] for w in _split(text)], dtype=np.uint64)


def _grams(code: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n codes."""
    if len(code) < n:
        return np.empty(0, np.uint64)
    h = np.zeros(len(code) - n + 1, dtype=np.uint64)
    for k in range(n):
        h = (h + mix(code[k:len(code) - n + 1 + k] + np.uint64((k + 1) * _MULT & 0xFFFFFFFFFFFFFFFF))) * np.uint64(_MULT)
    return h


def index(items: list[tuple[int, str]], n: int) -> tuple[Codes, np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]:
    """Word codes, sorted n-gram hashes, their (item, position), and the items' codes."""
    known: dict[str, int] = {}
    coded = []
    for item, text in items:
        ws = [w.translate(_LOOK) for w in _split(text)]
        for w in ws:
            known.setdefault(w, len(known) + 1)
        coded.append((item, np.array([known[w] for w in ws], dtype=np.uint64)))
    h, at = [], []
    for i, (_, c) in enumerate(coded):
        g = _grams(c, n)
        h.append(g)
        at += [(i, p) for p in range(len(g))]
    hashes = np.concatenate(h) if h else np.empty(0, np.uint64)
    o = np.argsort(hashes, kind="stable")
    return Codes(known), hashes[o], np.array(at, dtype=np.int64).reshape(-1, 2)[o], coded


def runs(code: np.ndarray, idx, n: int) -> list[tuple[int, int, int]]:
    """(item, first word, last word + 1) of maximal verified passages of at least n words."""
    _, hashes, at, coded = idx
    # a window with an unknown word is in no item: only stretches of known words are hashed
    known = code > 0
    if not known.any():
        return []
    edge = np.flatnonzero(np.diff(np.concatenate([[0], known.astype(np.int8), [0]])))
    out: dict[tuple[int, int], list[int]] = {}
    for s, e in zip(edge[::2], edge[1::2]):
        if e - s < n:
            continue
        g = _grams(code[s:e], n)
        lo, hi = np.searchsorted(hashes, g, "left"), np.searchsorted(hashes, g, "right")
        for k in np.flatnonzero(hi > lo):
            for j in range(lo[k], hi[k]):
                i, p = at[j]
                pos = s + int(k)
                if np.array_equal(code[pos:pos + n], coded[i][1][p:p + n]):
                    span = out.setdefault((int(i), pos - int(p)), [])
                    span.append(pos)
    found = []
    for (i, _), ps in out.items():
        start = prev = ps[0]
        for p in ps[1:]:
            if p > prev + 1:
                found.append((coded[i][0], start, prev + n))
                start = p
            prev = p
        found.append((coded[i][0], start, prev + n))
    return sorted(set(found))


def _blocks(items: DataFrame, n: int, item_id: str, text: str):
    """Broadcast indexes of the items, read one by one: each has at most BLOCK n-grams and one item more, and the driver holds one at a time."""
    rows = items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL").distinct()
    block, size, spark = [], 0, items.sparkSession
    for r in rows.toLocalIterator():
        block.append((r.i, r.t))
        size += len(r.t) // 2
        if size > BLOCK:
            yield spark.sparkContext.broadcast(index(block, n))
            block, size = [], 0
    yield spark.sparkContext.broadcast(index(block, n))


def _spans(text: str, idx, n: int) -> list[tuple]:
    """(item, first character, end, words) of the passages in a text as stored."""
    found = runs(_word_codes(text, idx[0]), idx, n)
    if not found:
        return []
    words, back = [m.span() for m in _WORDS.finditer(fix_text(text))], back_map(text)
    return [(item, back(words[s][0]), back(words[e - 1][1]), e - s) for item, s, e in found]


def leaks(documents: DataFrame, items: DataFrame, n: int = 12, doc_id: str = "doc_id", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The operator: (doc_id, item_id, start_char, end_char, words), one row per maximal passage of at least n consecutive words of an item in a document.

    NULL and short texts and items have none; repeated documents repeat their rows; items that share a passage are all
    reported. Items beyond a block are searched in a further pass over the documents."""
    src = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).where("_text IS NOT NULL")
    kind, own = dict(items.dtypes)[item_id], dict(src.dtypes)["doc_id"]
    out = None
    for held in _blocks(items, n, item_id, text):

        def kernel(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in it:
                at, got = [], []
                for i, t in enumerate(b.column("_text").to_pylist()):
                    spans = _spans(t, held.value, n)
                    at += [i] * len(spans)
                    got += spans
                cols = list(zip(*got)) if got else [[], [], [], []]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(at, pa.int64())), pa.array(list(cols[0]), pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()), *[pa.array(list(c), pa.int32()) for c in cols[1:]]],
                    names=["doc_id", "item_id", "start_char", "end_char", "words"],
                )

        part = src.mapInArrow(kernel, f"doc_id {own}, item_id {kind}, start_char INT, end_char INT, words INT")
        out = part if out is None else out.unionByName(part)
    return out


def found(documents: DataFrame, items: DataFrame, n: int = 12) -> DataFrame:
    """(doc_id, item_id): documents and the items that leaked into them."""
    return leaks(documents, items, n).select("doc_id", "item_id").distinct()


def without(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given spans, which may overlap."""
    out, at = [], 0
    for s, e in sorted(spans):
        out.append(text[at:max(at, s)])
        at = max(at, e)
    return "".join([*out, text[at:]])


def cleaned(documents: DataFrame, items: DataFrame, n: int = 12, drop: str = "spans", item_id: str = "item_id", text: str = "text") -> DataFrame:
    """The documents with all their columns, without leaked spans (drop="spans", a column `leaked_chars` says how many characters went; one of that name is replaced) or without leaking rows (drop="documents"). Each row is judged by its own text, in the pass that reads it; NULL texts stay."""
    if drop not in ("spans", "documents"):
        raise ValueError("drop must be 'spans' or 'documents'")
    out = documents.drop("leaked_chars").withColumn("leaked_chars", F.lit(0))
    for held in _blocks(items, n, item_id, text):

        def kernel(it: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for b in it:
                texts, gone, keep = b.column(text).to_pylist(), b.column("leaked_chars").to_pylist(), []
                for i, t in enumerate(texts):
                    spans = [(s, e) for _, s, e, _ in _spans(t, held.value, n)] if t else []
                    if not spans or drop == "spans":
                        keep.append(i)
                    if spans:
                        texts[i] = without(t, spans)
                        gone[i] += len(t) - len(texts[i])
                new = {text: pa.array(texts, b.schema.field(text).type), "leaked_chars": pa.array(gone, pa.int32())}
                done = pa.RecordBatch.from_arrays([new.get(c, b.column(c)) for c in b.schema.names], names=b.schema.names)
                yield done.take(pa.array(keep, pa.int64())) if len(keep) < len(texts) else done

        out = out.mapInArrow(kernel, out.schema)
    return out if drop == "spans" else out.drop("leaked_chars")
