"""Problem 1: sentence boundaries across languages and scripts.

Two passes. The first counts, per language, how often each short word type stands before a full stop, what kind of
character follows it there, and which words begin sentences after unmistakable boundaries; log-likelihood ratios over
these counts give abbreviations, the types whose full stop is usually followed inside the sentence, collocations across a
full stop, and sentence starters. Nothing is listed by hand. The second pass classifies every mark with these statistics.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chars import BLANKS, INVISIBLE, fix_text
from .common import written

#: The learned model is broadcast; it holds only what is over its threshold, some thousand types a language. Beyond this many entries a job stops with advice instead of broadcasting without bound.
MAX_TYPES = 2_000_000
ABBREVIATION, COLLOCATION, STARTER, FOLLOWED = 0.3, 7.88, 30.0, 10.0
#: A type seen before fewer full stops than this is no abbreviation: once or twice is no evidence.
LEAST = 3

_SAME_LENGTH = {ord(c): " " for c in BLANKS} | {ord(c): "​" for c in INVISIBLE if c != "‍"} | {0xFF10 + i: str(i) for i in range(10)} | {0xFF21 + i: chr(65 + i) for i in range(26)} | {0xFF41 + i: chr(97 + i) for i in range(26)}
_LETTER = r"[^\W\d_]"
_EMOJI = "\U0001F000-\U0001FAFF☀-➿⬀-⯿️"
#: A mark with all that belongs to the sentence before it: further marks, closing quotes and brackets, blanks and emoji.
_MARK = re.compile(rf"(?P<mark>[.!?…]+[.!?…​]*|[。！？｡।॥؟۔][。！？!?।]*)(?P<close>[)\]»”’\"」』）】​]*)(?P<tail>(?:[ ​]*[{_EMOJI}][{_EMOJI}‍]*)*)(?P<gap>[ ​]*)")
_LINE = re.compile("[^\r\n\v\f\x1c-\x1e\x85\u2028\u2029]+")
_BEFORE = re.compile(rf"(?:{_LETTER}[\w'’ʼ​̀-ͯ-]*\.)*{_LETTER}[\w'’ʼ​̀-ͯ-]*$")
_NEXT = re.compile(rf"[«„“\"'(\[‹「—–​ -]*({_LETTER}[\w'’ʼ​̀-ͯ-]*|\d)?")
_ADDRESS = re.compile(r"\S*@\S+|(?:https?://|www\.)\S+", re.IGNORECASE)
_TYPE = re.compile(rf"(?<![\w'’-]){_LETTER}+(?![\w'’-])")
_DOTTED = re.compile(rf"(?<![\w'’-])((?:{_LETTER}{{1,2}}\.)*{_LETTER}+)\.(?![.…a-z0-9])(?=[ ​]*(\S?)({_LETTER}*))")
_STARTS = re.compile(rf"(?:^|[!?…\n][»”\")]*|(?<={_LETTER}{{6}})\.[»”\")]*)\s*({_LETTER}+)", re.MULTILINE)
_OPEN, _CLOSE = "«„“「『‹", {"«": "»", "„": "”“", "“": "”", "「": "」", "『": "』", "‹": "›"}
_CYR, _LAT = re.compile("[Ѐ-ԯ]"), re.compile("[A-Za-zÀ-ɏ]")
_OTHER = (("th", re.compile("[฀-๿]")), ("hi", re.compile("[ऀ-ॿ]")), ("ar", re.compile("[؀-ۿ]")), ("ja", re.compile("[぀-ヿ]")), ("zh", re.compile("[一-鿿]")))
_FOREIGN = re.compile("[؀-ۿऀ-ॿ฀-๿぀-ヿ一-鿿]")
# Letters that only some languages of an alphabet have.
_OWN_LETTERS = {
    "cyrl": {"uk": "іїєґ", "ru": "ыэёъ", "be": "ў", "sr": "ђјљњћџ", "mk": "ѓѕќ"},
    "latn": {"pl": "ąćęłńśźż", "de": "äöüß", "cs": "ěřůďťň", "fr": "àâçèêëîïôûœ", "es": "ñ¿¡", "ro": "ăâîșț", "tr": "ğış", "vi": "đơư"},
}
_OWN = {script: re.compile("[" + "".join(own.values()) + "]") for script, own in _OWN_LETTERS.items()}


def script(text: str) -> str:
    """The script of a text: 'cyrl', 'latn', or the language of one that has its own."""
    cyr, lat = bool(_CYR.search(text)), bool(_LAT.search(text))
    if cyr and lat:
        cyr, lat = len(_CYR.findall(text)), len(_LAT.findall(text))
    if not cyr and not lat or (not text.isascii() and _FOREIGN.search(text) and len(_CYR.findall(text)) + len(_LAT.findall(text)) < len(text) // 4):
        for name, p in _OTHER:
            if p.search(text):
                return name
    return "cyrl" if cyr >= lat else "latn"


def language(text: str) -> str:
    """The language whose statistics a text shares: that of its script with the most letters of its own, as 'cyrl-uk'; the plain script where none has any."""
    name = script(text)
    own = _OWN.get(name)
    found = own.findall(text.lower()) if own else ()
    if not found:
        return name
    n = Counter(found)
    return name + "-" + max(_OWN_LETTERS[name], key=lambda x: (sum(n[c] for c in _OWN_LETTERS[name][x]), x))


def _kind(c: str, rest: str = "") -> str:
    if not c:
        return "end"
    if c.isdigit():
        return "digit"
    if c.isalpha():
        return "lower" if c.islower() else "upper"
    return "other"


def count_types(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, w, v, kind, n): counts of a task; flushed before they outgrow a fixed size."""
    c: Counter = Counter()

    def flush() -> pa.RecordBatch:
        k = list(c)
        out = pa.RecordBatch.from_arrays([pa.array([x[i] for x in k], pa.string()) for i in range(4)] + [pa.array([c[x] for x in k], pa.int64())], names=["lang", "w", "v", "kind", "n"])
        c.clear()
        return out

    for b in it:
        for text in b.column("text").to_pylist():
            if not text or not text.strip():
                continue
            t = fix_text(text)
            if "@" in t:
                t = _ADDRESS.sub(" ", t)
            lang = language(t)
            low = t.lower()
            for w, n in Counter(_TYPE.findall(low)).items():
                c[lang, w, "", "all"] += n
            if t.isupper():
                continue
            for m in _DOTTED.finditer(t):
                w, nxt, rest = m.groups()
                w = w.lower()
                c[lang, w, "", _kind(nxt)] += 1
                if "." in w:
                    c[lang, w, "", "all"] += 1
                if nxt.isalpha():
                    c[lang, w, (nxt + rest).lower(), "pair"] += 1
            for w in _STARTS.findall(t):
                if not w.islower():
                    c[lang, w.lower(), "", "start"] += 1
        if len(c) > 200_000:
            yield flush()
    if c:
        yield flush()


@dataclass
class Model:
    """Learned types by language: abbreviations; types whose full stop is followed by a small letter, digit or capital within the sentence; collocations over a full stop; sentence starters; the language that texts without letters of their own share; the length of the longest type."""

    abbreviations: dict[str, set[str]] = field(default_factory=dict)
    lower: dict[str, set[str]] = field(default_factory=dict)
    digit: dict[str, set[str]] = field(default_factory=dict)
    upper: dict[str, set[str]] = field(default_factory=dict)
    pairs: dict[str, set[tuple[str, str]]] = field(default_factory=dict)
    starters: dict[str, set[str]] = field(default_factory=dict)
    same: dict[str, str] = field(default_factory=dict)
    longest: int = 0

    def language(self, text: str) -> str:
        name = language(text)
        return self.same.get(name, name)


def _llr(k1, n1, k2, n2):
    """Column of the log-likelihood ratio of two binomials, k1 of n1 against k2 of n2."""
    def ll(k, n, p):
        p = F.least(F.greatest(p, F.lit(1e-12)), F.lit(1 - 1e-12))
        return k * F.log(p) + (n - k) * F.log(1 - p)

    n2 = F.greatest(n2, F.lit(1.0))
    k2 = F.least(F.greatest(k2, F.lit(0.0)), n2)
    p, p1, p2 = (k1 + k2) / (n1 + n2), k1 / n1, k2 / n2
    return 2 * (ll(k1, n1, p1) + ll(k2, n2, p2) - ll(k1, n1, p) - ll(k2, n2, p))


def learn(df: DataFrame, text_col: str = "text") -> DataFrame:
    """(lang, w, v, role, score): what the corpus teaches, from counts over all its texts."""
    counted = written(df.select(F.col(text_col).alias("text")).mapInArrow(count_types, "lang STRING, w STRING, v STRING, kind STRING, n BIGINT").groupBy("lang", "w", "v", "kind").agg(F.sum("n").alias("n")), "types")
    # Cyrillic texts without letters of one language share the statistics of the one that most texts are in; Latin ones are a group of their own
    most = counted.where("kind = 'all' AND lang LIKE 'cyrl-%'").groupBy("lang").agg(F.sum("n").alias("n")).agg(F.max_by("lang", "n").alias("l")).first().l
    same = counted.where("lang = 'cyrl'").select(F.lit("cyrl").alias("lang"), F.lit("").alias("w"), F.lit(most).cast("string").alias("v"), F.lit("same").alias("role"), F.lit(1.0).alias("score")).limit(1 if most else 0)
    if most:
        counted = counted.withColumn("lang", F.when(F.col("lang") == "cyrl", most).otherwise(F.col("lang"))).groupBy("lang", "w", "v", "kind").agg(F.sum("n").alias("n"))
    types = counted.where("kind <> 'pair'").groupBy("lang", "w").agg(
        *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).cast("double").alias(k) for k in ("all", "lower", "upper", "digit", "other", "end", "start")]
    ).withColumn("dot", F.expr("lower + upper + digit + other + `end`")).withColumn("all", F.greatest("all", "dot", "start"))
    total = types.groupBy("lang").agg(*[F.sum(k).alias(f"t_{k}") for k in ("all", "dot", "lower", "upper", "digit", "start")])
    x = types.join(F.broadcast(total), "lang")  # one row per language group
    size = F.length(F.regexp_replace("w", r"\.", ""))
    p0, p1 = F.greatest(F.col("t_dot") / F.col("t_all"), F.lit(1e-9)), F.lit(0.99)
    without = F.col("all") - F.col("dot")
    known = 2 * (F.col("dot") * (F.log(p1) - F.log(p0)) + without * (F.log(1 - p1) - F.log(1 - p0)))
    # against Punkt, occurrences without the full stop weigh by their share, so that noise does not outgrow evidence, and a type that ends texts is an ordinary word
    abbreviation = F.when((F.col("dot") >= LEAST) & (F.col("end") < 0.02 * F.col("dot")), known * F.exp(-size.cast("double")) * (F.lit(1) + F.length("w") - size) * F.pow(size.cast("double"), -20 * without / F.col("dot")))

    def followed(kind: str):
        rest, trest = F.col("dot"), F.col("t_dot") - F.col("dot")
        return F.when(F.col(kind) / F.col("dot") > 0.35, _llr(F.col(kind), rest, F.col(f"t_{kind}") - F.col(kind), trest))

    # capitals after an abbreviation's full stop, more often than the sentence ends there by chance
    rate, chance = F.least(F.col("upper") / F.col("dot"), F.lit(1 - 1e-12)), 0.05
    often = F.when(rate > chance, 2 * (F.col("upper") * (F.log(F.greatest(rate, F.lit(1e-12))) - F.log(F.lit(chance))) + (F.col("dot") - F.col("upper")) * (F.log(1 - rate) - F.log(F.lit(1 - chance)))))
    starter = F.when(F.col("start") / F.col("all") > F.col("t_start") / F.col("t_all"), _llr(F.col("start"), F.col("all"), F.col("t_start") - F.col("start"), F.col("t_all") - F.col("all")))
    roles = x.where("dot > 0 OR start > 0").select("lang", "w", F.lit("").alias("v"), F.explode(F.array(*[
        F.struct(F.lit(r).alias("role"), score.alias("score"), F.lit(least).alias("least")) for r, score, least in (
            ("abbreviation", F.when(F.col("dot") > 0, abbreviation), ABBREVIATION),
            ("lower", F.when(F.col("dot") > 0, followed("lower")), FOLLOWED),
            ("digit", F.when(F.col("dot") > 0, followed("digit")), FOLLOWED),
            ("upper", F.when(F.col("dot") > 0, often), FOLLOWED),
            ("starter", F.when(F.col("start") > 0, starter), STARTER),
        )
    ])).alias("r")).select("lang", "w", "v", "r.*").where("score >= least").drop("least")
    known_short = roles.where("role = 'abbreviation'").select("lang", "w")
    pair = counted.where("kind = 'pair' AND n >= 5").select("lang", "w", "v", F.col("n").cast("double").alias("n")).join(known_short, ["lang", "w"], "left_semi")
    y = pair.join(types.select("lang", "w", "dot"), ["lang", "w"]).join(types.select("lang", F.col("w").alias("v"), F.col("all").alias("v_all")), ["lang", "v"]).join(F.broadcast(total), "lang")
    score = F.when(F.col("n") / F.col("dot") > F.col("v_all") / F.col("t_all"), _llr(F.col("n"), F.col("dot"), F.greatest(F.col("v_all") - F.col("n"), F.lit(0.0)), F.col("t_all") - F.col("dot")))
    pairs = y.select("lang", "w", "v", F.lit("pair").alias("role"), score.alias("score")).where(F.col("score") >= COLLOCATION)
    upper = roles.where("role = 'upper'").join(known_short, ["lang", "w"], "left_semi").select(*roles.columns)
    return roles.where("role <> 'upper'").unionByName(upper).unionByName(pairs).unionByName(same)


def collected(learned: DataFrame) -> Model:
    """The model on the driver, its size checked."""
    learned = written(learned, "model")
    n = learned.count()
    if n > MAX_TYPES:
        raise ValueError(f"{n} learned types exceed {MAX_TYPES}; raise the thresholds ABBREVIATION, FOLLOWED, COLLOCATION or STARTER")
    m = Model()
    for r in learned.toLocalIterator():
        if r.role == "same":
            m.same[r.lang] = r.v
            continue
        m.longest = max(m.longest, len(r.w))
        at = {"abbreviation": m.abbreviations, "lower": m.lower, "digit": m.digit, "upper": m.upper, "starter": m.starters, "pair": m.pairs}[r.role]
        at.setdefault(r.lang, set()).add((r.w, r.v) if r.role == "pair" else r.w)
    return m


def _quoted(line: str) -> list[tuple[int, int]]:
    """Spans between paired quotation marks; a mark without its partner in the line opens nothing."""
    spans, at, alone = [], 0, set()
    for m in _QUOTE.finditer(line):
        if m.start() < at or m.group() in alone:
            continue
        ends = [e for e in (line.find(x, m.end()) for x in _CLOSE.get(m.group(), '"')) if e > 0]
        if ends:
            spans.append((m.start(), min(ends)))
            at = min(ends) + 1
        else:
            alone.add(m.group())  # nor do later ones of the kind have a partner
    return spans


_QUOTE = re.compile('[«„“「『‹"]')
_ODD = re.compile(f"[{BLANKS}{INVISIBLE}０-９Ａ-Ｚａ-ｚ]")
_THAI_GAP = re.compile(r"[ ​]* [ ​]*(?=[^ ​])")
_EMPTY: frozenset = frozenset()


def _around_of(spans: list[tuple[int, int]], at: int) -> tuple[int, int] | None:
    """The span around an offset, of sorted spans that do not overlap."""
    k = bisect_left(spans, (at,)) - 1
    return spans[k] if k >= 0 and spans[k][0] < at < spans[k][1] else None


def starts(text: str | None, model: Model) -> list[int]:
    """Offsets (code points, from 0) of the first character of each sentence. None, empty and blank texts have none."""
    if not text:
        return []
    t = text.translate(_SAME_LENGTH) if _ODD.search(text) else text
    lang = model.language(t)
    capital = not t.isupper()
    abbreviations, lower, digit, upper, pairs, starters = (x.get(lang, _EMPTY) for x in (model.abbreviations, model.lower, model.digit, model.upper, model.pairs, model.starters))
    out = []
    for lm in _LINE.finditer(t):
        line, base = lm.group(), lm.start()
        first = len(line) - len(line.lstrip(" ​"))
        if first == len(line):
            continue
        out.append(base + first)
        if lang == "th":
            out += [base + first + m.end() for m in _THAI_GAP.finditer(line[first:])]
            continue
        quotes = _quoted(line) if _QUOTE.search(line) else []
        addresses = [m.span() for m in _ADDRESS.finditer(line)] if "@" in line or "://" in line or "www." in line.lower() else []
        for m in _MARK.finditer(line):
            s, e, nxt = m.start(), m.end("mark"), m.end()
            if nxt >= len(line):
                break
            if _around_of(addresses, s) and not (m["gap"] or m["tail"]):
                continue
            inside = _around_of(quotes, s)
            if inside:
                if not (m["close"] and inside[1] < m.end("close") and m["gap"] and line[nxt].isupper() and _first(line, nxt) in starters and capital):
                    continue
            mark = m["mark"].rstrip("​")
            n = _NEXT.match(line, nxt)
            word = (n.group(1) or "").replace("​", "")
            head = word[:1]
            if mark[0] in "。！？｡।॥؟۔":
                if line[nxt] in ",，、)」』”":
                    continue
                out.append(base + nxt)
                continue
            if not head and line[nxt] in ",;:)]}»”%/.-" or line[nxt] in ",;:)]}»”，、":
                continue
            if not (m["gap"] or m["tail"] or m["close"].strip("​")) and mark[-1] == "." and (head.islower() or head.isdigit() and s and line[s - 1].isdigit() or line[nxt] in "_@/="):
                continue
            dots = mark.startswith("…") or mark.startswith("..")
            dash = line[nxt] in "—–-"
            if dash and head.islower():
                continue
            # a longer word is none of the learned types, nor the one that follows
            before = _BEFORE.search(line[max(0, s - 2 - 2 * max(model.longest, len(word)), line.rfind(" ", max(0, s - 2 - 2 * max(model.longest, len(word))), s)):s])
            w = before.group().replace("​", "") if before else ""
            if dots or mark[0] == "." and len(mark) > 1 and mark[-1] in ".…":
                if head.islower() and not m["tail"]:
                    low = fix_text(word).lower()
                    if low == fix_text(w).lower() or low not in starters:
                        continue
                out.append(base + nxt)
                continue
            if mark == "." and not m["tail"] and not m["close"].strip("​"):
                low = fix_text(w).lower()
                nlow = fix_text(word).lower() if word else ""
                if low and len(low) == 1 and (w.isupper() or not capital) and (head.isupper() or not head):
                    # an initial; with its surname before it, the sentence may end there
                    back = line[:s - len(w)].rstrip(" ​")
                    surname = re.search(rf"{_LETTER}[\w'’ʼ-]+(?:[ ​]+{_LETTER}\.)?$", back)
                    if not (capital and surname and surname.group()[0].isupper() and nlow in starters and len(word) > 1):
                        continue
                elif low in abbreviations:
                    if not capital or not head.isupper():
                        continue
                    if low in upper or (low, nlow) in pairs or nlow not in starters:
                        continue
                elif head.islower() and (low in lower) or head.isdigit() and low in digit:
                    continue
            out.append(base + nxt)
    return out


def _first(line: str, at: int) -> str:
    m = _NEXT.match(line, at)
    return fix_text((m.group(1) or "").replace("​", "")).lower()


def split_sentences(df: DataFrame, model: Model, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """The operator: (id, sentence_no, start_char, sentence), one row per sentence of each row; sentences run to the next one's start without outer blanks. NULL, empty and blank texts give no row; repeated rows repeat theirs; extra columns are ignored."""
    held = df.sparkSession.sparkContext.broadcast(model)
    src = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text IS NOT NULL")

    def kernel(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            at, no, start, unit = [], [], [], []
            for i, t in enumerate(b.column("text").to_pylist()):
                ss = starts(t, held.value)
                for k, s in enumerate(ss):
                    at.append(i)
                    no.append(k)
                    start.append(s)
                    unit.append(t[s:ss[k + 1] if k + 1 < len(ss) else None].rstrip())
            for s in range(0, len(at), 50_000):
                e = s + 50_000
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at[s:e], pa.int64())), pa.array(no[s:e], pa.int32()), pa.array(start[s:e], pa.int32()), pa.array(unit[s:e], pa.string())], names=["id", "sentence_no", "start_char", "sentence"])

    return src.mapInArrow(kernel, f"id {dict(src.dtypes)['id']}, sentence_no INT, start_char INT, sentence STRING")


def sentence_units(df: DataFrame, id_col: str = "text_id", text_col: str = "text") -> DataFrame:
    """Learns from the table, then splits it; repeated rows repeat their sentences."""
    return split_sentences(df, collected(learn(df, text_col)), id_col, text_col)
