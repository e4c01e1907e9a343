"""Problem 10: texts over a token limit cut into pieces at natural boundaries, with overlap.

Boundaries are ranked: section, paragraph, line, sentence, word, character. A text is split at the highest rank; what is
still too large is split at the next, down to characters. Sentences are those of problem 1, whose statistics are learned from
the documents themselves. The parts are packed greedily, and each piece after the first
repeats trailing parts of the one before, as many as the overlap allows (single words, where no larger part is small
enough). Pieces are exact slices of the text: their union is the text, and every piece is encoded to prove its size.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path
from .sentences import Model, collected, learn, starts
from .tokens import count

#: Each pattern matches the end of a part of its rank, blanks included.
SEPARATORS = (
    re.compile(r"(?<=\S)[^\S\n]*+\n(?:[^\S\n]*+\n)++(?=[^\n]*[^\s.!?…,;:。！？।]\n[^\S\n]*+\n)"),  # before a line that stands alone and ends like no sentence: a heading
    re.compile(r"(?<=\S)[^\S\n]*+\n(?:[^\S\n]*+\n)++"),
    re.compile(r"\n"),
    None,  # sentences
    re.compile(r"\s++"),
)


def parts(text: str, start: int, end: int, limit: int, path: str, sentence_starts: Callable[[], list[int]], rank: int = 0) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of consecutive parts of at most `limit` tokens, each as large a natural unit as fits."""
    n = count(text[start:end], path)
    if n <= limit:
        return [(start, end, n)] if end > start else []
    while rank < len(SEPARATORS):
        if SEPARATORS[rank] is None:
            at = sentence_starts()
            cuts = at[bisect_right(at, start):bisect_left(at, end)]
        else:
            cuts = [m.end() for m in SEPARATORS[rank].finditer(text, start, end) if start < m.end() < end]
        rank += 1
        if cuts:
            out, at = [], start
            for c in [*cuts, end]:
                out += parts(text, at, c, limit, path, sentence_starts, rank)
                at = c
            return out
    out, at = [], start
    while at < end:  # no boundary left: characters, by halving steps
        size = min(end - at, limit)
        while size > 1 and count(text[at:at + size], path) > limit:
            size = max(1, size // 2)
        out.append((at, at + size, count(text[at:at + size], path)))
        at += size
    return out


def _overlap_start(text: str, start: int, end: int, overlap: int, path: str) -> int:
    """The first word boundary from which the end of a piece has at most `overlap` tokens, else the first character."""
    if overlap <= 0:
        return end
    words = [m.end() for m in re.finditer(r"\s+", text[start:end])]
    best = end
    for w in reversed(words):
        if w == end - start:
            continue
        if count(text[start + w:end], path) > overlap:
            break
        best = start + w
    if best < end:
        return best
    # no word fits: as many trailing characters as do
    lo, hi = 0, min(4 * overlap, end - start - 1)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if count(text[end - mid:end], path) <= overlap else (lo, mid - 1)
    return end - lo


def pieces(text: str | None, limit: int = 2048, overlap: int = 64, path: str | None = None, model: Model = Model()) -> list[tuple[int, int, int]]:
    """(start, end, tokens) of the pieces of a text: one if it is within the limit; none for None and empty texts. Sentences follow the model, which may be empty."""
    if overlap < 0 or limit <= overlap:
        raise ValueError("the overlap must be at least 0 and less than the limit")
    path = path or tokenizer_path()
    if not text:
        return []
    total = count(text, path)
    if total <= limit:
        return [(0, len(text), total)]
    room = limit - overlap
    units = parts(text, 0, len(text), max(1, room), path, cache(lambda: starts(text, model)))
    out: list[tuple[int, int, int]] = []
    k = 0
    while k < len(units):
        begin = units[k][0]
        if out:
            # trailing whole units where they fit the overlap, else words
            j = k
            while j > 0 and units[j - 1][0] > out[-1][0] and count(text[units[j - 1][0]:units[k][0]], path) <= overlap:
                j -= 1
            begin = units[j][0] if j < k else _overlap_start(text, out[-1][0], units[k][0], overlap, path)
        last, n = k, count(text[begin:units[k][1]], path)
        while n > limit and begin < units[k][0]:  # tokens may merge otherwise across the seam
            begin = min(units[k][0], begin + 1)
            n = count(text[begin:units[k][1]], path)
        size = n
        while last + 1 < len(units) and size + units[last + 1][2] <= limit:
            last += 1
            size += units[last][2]
        n = count(text[begin:units[last][1]], path)
        while n > limit and last > k:
            last -= 1
            n = count(text[begin:units[last][1]], path)
        out.append((begin, units[last][1], n))
        k = last + 1
    return out


def split_documents(documents: DataFrame, limit: int = 2048, overlap: int = 64, tokenizer: str | None = None, doc_id: str = "doc_id", text: str = "text", only_oversized: bool = False, model: Model | None = None) -> DataFrame:
    """The operator: (doc_id, piece_no, pieces, start_char, end_char, n_tokens, piece); offsets count code points.

    Texts within the limit are one piece; NULL and empty texts have none; repeated rows repeat theirs; other columns are ignored. Without a model of sentences one is learned from the documents. A character of more than `limit` tokens would stand alone."""
    path = tokenizer or tokenizer_path()
    held = documents.sparkSession.sparkContext.broadcast(model or collected(learn(documents, text)))
    src = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).where("_text IS NOT NULL AND _text <> ''")

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, rows = [], []
            for i, t in enumerate(b.column("_text").to_pylist()):
                if only_oversized and len(t.encode("utf-8", "replace")) <= limit:
                    continue  # a token has at least one byte
                ps = pieces(t, limit, overlap, path, held.value)
                if only_oversized and len(ps) < 2:
                    continue
                for k, (s, e, n) in enumerate(ps):
                    at.append(i)
                    rows.append((k, len(ps), s, e, n, t[s:e]))
            for s in range(0, len(at), 20_000):
                r = rows[s:s + 20_000]
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id").take(pa.array(at[s:s + 20_000], pa.int64())), *[pa.array([x[j] for x in r], pa.int32()) for j in range(5)], pa.array([x[5] for x in r], pa.string())],
                    names=["doc_id", "piece_no", "pieces", "start_char", "end_char", "n_tokens", "piece"],
                )

    return src.mapInArrow(kernel, f"doc_id {dict(src.dtypes)['doc_id']}, piece_no INT, pieces INT, start_char INT, end_char INT, n_tokens INT, piece STRING")
