"""Problem 5: freely typed values mapped to a canonical list, by a prefix-filtered set-similarity join.

Every mention is read in a few ways (its runs of neighbouring words, the same keys on another keyboard layout), every
entry is written in a few ways (inflected, transliterated, cut short). Readings and forms become sets of character
bigrams, ordered by global rarity; only rare prefixes meet, in an inverted list probed by batches of readings, under length
and positional filters, and Jaccard is verified exactly. An edit bound then tells a misspelling of a name from a name that
only resembles it, the most similar entry is kept, and what no entry explains is reported as unmatched.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import fix_text
from .common import partitions_for, written

#: Jaccard similarity of bigram sets that candidates must reach.
SIMILARITY = 0.35
#: Forms in one inverted list, and readings that probe it in one task; more of either go to further tasks.
FORMS, READINGS = 200_000, 20_000
_FOLD = str.maketrans({"і": "и", "ї": "и", "ы": "и", "є": "е", "э": "е", "ё": "е", "ґ": "г", "ь": None, "ъ": None, "'": None, "’": None, "ʼ": None})
# The Ukrainian and Latin letters on the same keys, and the official transliteration (word-initial forms apart).
_KEYS = dict(zip("qwertyuiop[]asdfghjkl;'zxcvbnm,.`", "йцукенгшщзхїфівапролджєячсмитьбю'"))
_LATIN = dict(zip("абвгґдезиіклмнопрстуфхцчшщюяжйїє", "a b v h g d e z y i k l m n o p r s t u f kh ts ch sh shch iu ia zh i i ie".split())) | {"ь": "", "'": "", "’": "", "ʼ": ""}
_INITIAL = {"є": "ye", "ї": "yi", "й": "y", "ю": "yu", "я": "ya"}
# Case endings of the Ukrainian declensions by nominative ending, the longest match holds; and the vowels.
_ENDINGS = {
    "ий": "ого ому им ім", "ій": "ього ьому ім", "цька": "цької цькій цьку цькою", "ська": "ської ській ську ською", "ське": "ського ському ським", "цьке": "цького цькому цьким",
    "а": "и і у ою", "я": "і ю ею єю", "о": "а у ом і", "е": "я ю ем і а у", "и": "ів ам ами ах", "і": "ів ям ями ях", "ї": "їв ям ями ях", "ь": "я ю ем і", "": "а у ом і ові",
}
_VOWELS = "аеєиіїоуюя"
_SOFTER = {"к": "ц", "г": "з", "х": "с"}
_WORD = re.compile(r"[^\W_]+(?:['’ʼ][^\W_]+)*")


def _stems(word: str) -> set[str]:
    """The word, and as written with the vowels that general sound laws exchange: і of a closed syllable and о, a doubled consonant before я and a soft one before е, plural -ці and singular -ець."""
    out = {word}
    for m in re.finditer(f"і(?=[^{_VOWELS}]+(?:[^{_VOWELS}][{_VOWELS}])?$|[^{_VOWELS}]{{2}}[{_VOWELS}]$)", word):
        out.add(word[:m.start()] + "о" + word[m.end():])
    m = re.search(r"([^\W\d_])\1я$", word)
    if m:
        out.add(word[:m.start() + 1] + "ьє")
    if word.endswith("ці"):
        out.add(word[:-2] + "ець")
    return out


def _inflected(word: str) -> list[str]:
    """The case forms of a word by the general rules of its ending, the nominative first."""
    if not word:
        return [word]
    end = next(e for k in range(min(4, len(word)), -1, -1) for e in [word[len(word) - k:]] if e in _ENDINGS)
    stem, forms = word[:len(word) - len(end)], [word]
    for e in _ENDINGS[end].split():
        s = stem
        if e[0] in "іїє" and end in ("а", "о") and s[-1:] in _SOFTER:
            s = s[:-1] + _SOFTER[s[-1]]
        if end in ("ь", "") and s:
            s = re.sub(f"і(?=[^{_VOWELS}]+$)", "о", s)  # a closed syllable opens
        if end == "і" and s.endswith("ц") and e == "ів":
            forms.append(s + "ів")
            continue
        forms.append(s + e)
    if end in ("и", "і") and stem.endswith(("ц", "к", "ч", "ж", "ш")):
        forms += [stem + e for e in ("ям", "ями", "ях", "ам", "ами", "ах")]
    return forms


def _translit(word: str) -> str:
    return "".join(_INITIAL.get(c, _LATIN.get(c, c)) if i == 0 else _LATIN.get(c, c) for i, c in enumerate(word.replace("зг", "згh"))).replace("zhh", "zgh")


def fold(text: str) -> str:
    """Letters only, lower case, without the differences that spelling habits make."""
    return "".join(_WORD.findall(text.lower())).translate(_FOLD)


def forms(name: str) -> list[tuple[str, bool]]:
    """(form, cut): ways a canonical name may be written: its words inflected together, joined, folded, and transliterated; and, as spelled, the beginnings of at least four letters at which it may be cut short."""
    words = _WORD.findall(fix_text(name).lower())
    if not words:
        return []
    each = [_inflected(w) for w in words]
    out = {"".join(words)}
    for k in range(max(map(len, each))):
        out.add("".join(e[min(k, len(e) - 1)] for e in each))
    if len(each) == 2:
        out |= {a + b for a in each[0] for b in each[1]}
    out |= {"".join(words[:-1]) + s for s in _stems(words[-1])}
    latin = {_translit(w) for w in out} | {"".join(map(_translit, words)), "".join(map(_translit, words)).replace("ie", "e")}
    whole = "".join(words)
    return sorted({(fold(w), False) for w in out | latin} | {(whole[:k], True) for k in range(4, len(whole))})


def readings(mention: str | None, shortest: int = 1, longest: int = 1 << 30) -> list[tuple[str, str, bool]]:
    """(reading, folded whole, cut): folded runs of neighbouring words of a mention before its first comma and of all of it, with `shortest` to `longest` letters; the same for the other keyboard layout; `whole` is all that was read; where `cut`, a full stop cuts the reading short and it is as typed. NULL and blank mentions have none."""
    if not mention or not mention.strip():
        return []
    t = fix_text(mention).lower().strip()
    out: dict[tuple[str, str, bool], None] = {}

    def read(s: str) -> None:
        typed = _WORD.findall(s)
        words = [fold(w) for w in typed]
        whole = "".join(words)
        short = s.rstrip(" )»\"”!?").endswith(".")
        for i in range(len(words)):
            run = ""
            for j in range(i, len(words)):
                run += words[j]
                if len(run) > longest:
                    break
                if len(run) >= shortest:
                    out[run, whole, False] = None
                    if short and j == len(words) - 1:
                        out["".join(typed[i:]), whole, True] = None

    read(t.split(",")[0])
    if "," in t:
        read(t)
    if re.search("[a-z]", t) and not re.search("[а-яіїєґ]", t):
        read("".join(_KEYS.get(c, c) for c in t))
    return list(out)


def bigrams(w: str, cut: bool = False) -> frozenset[int]:
    """The character bigrams of a word with its ends marked, of one cut short without the last, as numbers."""
    p = [35, *map(ord, w)] + ([] if cut else [36])
    return frozenset(x << 21 | y for x, y in zip(p, p[1:]))


def similarity_of(a: str, b: str, cut: bool = False) -> float:
    """Jaccard similarity of the bags of letters and bigrams of two words."""
    bags = [Counter(w) + Counter(zip("#" + w, w if cut else w + "$")) for w in (a, b)]
    both = sum((bags[0] & bags[1]).values())
    return both / max(1, sum(bags[0].values()) + sum(bags[1].values()) - both)


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with transpositions, or most + 1 if it is larger."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    two, one = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[j - 1] + 1, one[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        two, one = one, row
    return one[-1]


def allowed(n: int) -> int:
    """Edits that a misspelling of a name of n letters may have."""
    return 0 if n < 5 else 1 if n < 9 else 2 if n < 16 else 3


#: Rarity of a bigram is counted by hash bucket, in a table of fixed size; any one order is right.
_BUCKETS = 1 << 16


def _rank(gram: int) -> int:
    return (gram * 0x9E3779B1 >> 11) & (_BUCKETS - 1)


def _gram_counts(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n): how many of a task's words hold a bigram of each bucket."""
    total = np.zeros(_BUCKETS, dtype=np.int64)
    for b in it:
        for w, cut in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for g in bigrams(w, cut):
                total[_rank(g)] += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["bucket", "n"])


class Index:
    """Inverted lists of the rare prefixes of some forms."""

    def __init__(self, words: list[tuple[str, bool]], counts: np.ndarray, similarity: float):
        self.counts, self.similarity = counts, similarity
        self.words = words
        self.sets = [bigrams(w, c) for w, c in words]
        self.size = np.array([len(s) for s in self.sets], dtype=np.int64)
        lists: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, s in enumerate(self.sets):
            for pos, g in enumerate(self._prefix(s)):
                lists[g].append((i, pos))
        self.lists = {g: np.array(v, dtype=np.int64) for g, v in lists.items()}

    def _prefix(self, s: frozenset[int]) -> list[int]:
        n = len(s)
        return sorted(s, key=lambda g: (self.counts[_rank(g)], g))[:n - int(np.ceil(self.similarity * n - 1e-9)) + 1]

    def probe(self, word: str, cut: bool) -> list[tuple[int, float, int]]:
        """(form, Jaccard, edits) of the forms similar enough to a reading and within the edits a misspelling may have; a reading cut short must be the form's letters."""
        mine, t = bigrams(word, cut), self.similarity
        n = len(mine)
        met: set[int] = set()
        for pos, g in enumerate(self._prefix(mine)):
            at = self.lists.get(g)
            if at is not None:
                i, q = at[:, 0], at[:, 1]
                m = self.size[i]
                ok = (m >= t * n - 1e-9) & (n >= t * m - 1e-9) & (1 + np.minimum(n - pos - 1, m - q - 1) + np.minimum(pos, q) >= t / (1 + t) * (n + m) - 1e-9)
                met.update(i[ok].tolist())
        out = []
        for i in met:
            form, short = self.words[i]
            both = len(mine & self.sets[i])
            jaccard = both / (n + len(self.sets[i]) - both)
            if jaccard < t or short != cut:
                continue
            most = 0 if cut else allowed(len(form))
            # an edit changes at most three bigrams of either word
            if n + len(self.sets[i]) - 2 * both > 6 * most:
                continue
            d = distance(word, form, most)
            if d <= most:
                out.append((i, jaccard, d))
        return out


def _exploded(df: DataFrame, schema: str, fn) -> DataFrame:
    """Rows of fn(first column) beside the columns of each row."""
    kinds = {"STRING": pa.string(), "BOOLEAN": pa.bool_()}

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [x.split() for x in schema.split(",")]
        for b in it:
            rows = [(i, *r) for i, v in enumerate(b.column(0).to_pylist()) for r in fn(v)]
            cols = list(zip(*rows)) if rows else [[] for _ in fields]
            keep = [b.column(k).take(pa.array(cols[0], pa.int64())) for k in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(keep + [pa.array(list(c), kinds[f[1]]) for c, f in zip(cols[1:], fields[b.num_columns:])], names=[f[0] for f in fields])

    return df.mapInArrow(kernel, schema)


def matched(mentions: DataFrame, reference: DataFrame, col: str = "mention", ref_id: str = "loc_id", ref_name: str = "canonical_name", similarity: float = SIMILARITY, forms_in: int = FORMS, readings_in: int = READINGS) -> DataFrame:
    """The operator: (mention, loc_id, similarity, jaccard, distance, length), the best entry of every distinct mention that has one.

    `jaccard` and `distance` are those of the reading and the form that met; `similarity`, by which the best entry is
    kept, is the Jaccard similarity, of bags of letters and bigrams, of the form and the whole mention before its comma, so that what an entry leaves
    unexplained counts against it. Ties go to the longer reading, fewer edits, the smaller id; NULL and blank mentions
    match nothing; a repeated entry counts once. A mention cut short by a full stop matches only if one entry continues it."""
    spark = mentions.sparkSession
    named = reference.select(F.col(ref_name).alias("name"), F.col(ref_id).alias("id")).where("id IS NOT NULL AND name IS NOT NULL").distinct()
    id_type = dict(named.dtypes)["id"]
    shapes = written(_exploded(named, f"name STRING,id {id_type},form STRING,cut BOOLEAN", forms).select("id", "form", "cut").distinct(), "forms")
    # no reading outside these lengths can be within the edits of a form
    span = shapes.agg(F.min(F.length("form")).alias("lo"), F.max(F.length("form")).alias("hi"), F.count("*").alias("n")).first()
    lo, hi = max(1, (span.lo or 1) - 3), (span.hi or 0) + 3
    said = written(
        _exploded(mentions.select(F.col(col).alias("mention")).where("mention IS NOT NULL").distinct().repartition(partitions_for(spark)), "mention STRING,reading STRING,whole STRING,cut BOOLEAN", lambda m: readings(m, lo, hi)), "readings"
    )
    counts = np.zeros(_BUCKETS, dtype=np.int64)
    for r in said.select("reading", "cut").unionByName(shapes.select(F.col("form").alias("reading"), "cut")).mapInArrow(_gram_counts, "bucket INT, n BIGINT").groupBy("bucket").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r.bucket] = r.n
    held = spark.sparkContext.broadcast(counts)  # of fixed size
    probes = said.select("reading", "cut").distinct()
    blocks = 1 + span.n // forms_in
    salts = max(partitions_for(spark), 1 + probes.count() // readings_in)
    x = probes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("salt", F.pmod(F.xxhash64("reading"), F.lit(salts)).cast("int"))
    y = shapes.select("form", F.col("cut").alias("form_cut")).distinct().withColumn("block", F.pmod(F.xxhash64("form"), F.lit(blocks)).cast("int")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))

    def probed(left: pa.Table, right: pa.Table) -> pa.Table:
        index = Index(list(zip(right.column("form").to_pylist(), right.column("form_cut").to_pylist())), held.value, similarity)
        rows = [(w, c, index.words[i][0], j, d) for w, c in zip(left.column("reading").to_pylist(), left.column("cut").to_pylist()) for i, j, d in index.probe(w, c)]
        return pa.table({n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate((("reading", pa.string()), ("cut", pa.bool_()), ("form", pa.string()), ("jaccard", pa.float64()), ("distance", pa.int32())))})

    close = written(x.groupBy("block", "salt").cogroup(y.groupBy("block", "salt")).applyInArrow(probed, "reading STRING, cut BOOLEAN, form STRING, jaccard DOUBLE, distance INT"), "close")
    hits = said.join(close, ["reading", "cut"]).join(shapes, ["form", "cut"])
    several = hits.where("cut").groupBy("mention", "reading").agg(F.count_distinct("id").alias("c")).where("c > 1").select("mention", "reading")
    hits = hits.where("NOT cut").unionByName(hits.where("cut").join(several, ["mention", "reading"], "left_anti").select(hits.columns))

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            j = [similarity_of(w, fold(f), c) for w, f, c in zip(b.column("whole").to_pylist(), b.column("form").to_pylist(), b.column("cut").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("mention", "id", "distance", "length", "jaccard")] + [pa.array(j, pa.float64())], names=["mention", "id", "distance", "length", "jaccard", "similarity"])

    scored = hits.select("mention", "id", "distance", F.length("reading").alias("length"), "jaccard", "whole", "form", "cut").mapInArrow(whole, f"mention STRING, id {id_type}, distance INT, length INT, jaccard DOUBLE, similarity DOUBLE")
    best = scored.groupBy("mention").agg(F.max_by(F.struct("id", "similarity", "jaccard", "distance", "length"), F.struct("similarity", "length", -F.col("distance"), "jaccard", -F.col("id"))).alias("b"))
    return best.select("mention", F.col("b.id").alias("loc_id"), "b.similarity", "b.jaccard", "b.distance", "b.length")


def linked(values: DataFrame, reference: DataFrame, **more) -> DataFrame:
    """Of (src, text_id, mention), several mentions of one place per key, (src, text_id, loc_id): the most similar match of any of them, 0 where none has one."""
    m = matched(values, reference, **more)
    joined = values.select("src", "text_id", "mention").distinct().join(m, "mention", "left")
    return joined.groupBy("src", "text_id").agg(F.max_by("loc_id", F.when(F.col("loc_id").isNotNull(), F.struct("similarity", "length", "jaccard", -F.col("loc_id")))).alias("loc_id")).select(
        "src", "text_id", F.coalesce("loc_id", F.lit(0)).cast("int").alias("loc_id")
    )
