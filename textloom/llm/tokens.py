"""Token counts by a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tokenizer_path

#: The pre-tokenisation pattern of byte-level BPE vocabularies (public, fixed value).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@lru_cache(maxsize=2)
def encoder(path: str):
    """The tokenizer of a rank file, loaded once per worker."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


#: Text is encoded in stretches of about this many characters, cut only between two parts of the pattern.
STRETCH = 20_000


def stretches(text: str):
    """The text in stretches that encode on their own as they do together: they end where a blank follows a character that is none, and there the pattern always cuts. What has no such place is matched by the pattern, part by part."""
    at = 0
    while len(text) - at > STRETCH:
        cut = _BREAK.search(text, at + STRETCH // 2, at + STRETCH)
        if cut:
            yield text[at:cut.end()]
            at = cut.end()
            continue
        end = at + 1
        for m in _PARTS.finditer(text, at):
            end = m.end()
            if end - at >= STRETCH // 2:
                break
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


_BREAK = re.compile(r"\S(?= \S)")
_PARTS = regex.compile(PATTERN)


def count(text: str, path: str) -> int:
    """Tokens of a text."""
    if len(text) <= STRETCH:
        return len(encoder(path).encode_ordinary(text))
    return sum(len(encoder(path).encode_ordinary(s)) for s in stretches(text))


def with_tokens(df: DataFrame, keep: tuple[str, ...], text_col: str = "text", path: str | None = None) -> DataFrame:
    """(keep..., n_tokens): NULL texts have 0 tokens."""
    path = path or tokenizer_path()
    src = df.select(*keep, F.col(text_col).alias("_text"))
    types = dict(src.dtypes)

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            n = [count(t, path) if t else 0 for t in b.column("_text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keep], pa.array(n, pa.int64())], names=[*keep, "n_tokens"])

    return src.mapInArrow(kernel, ", ".join(f"{k} {types[k]}" for k in keep) + ", n_tokens BIGINT")
