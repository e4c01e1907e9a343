"""Text functions as Column expressions: cleaning, normalisation, masking, splitting, tokenising, shapes.

Patterns start with (?U) or (?iU): \\w, \\s, \\d and case then follow Unicode, as texts here are mostly Cyrillic.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Characters and patterns of the cleaning rules.
APOSTROPHES = "’ʼ`´"
QUOTES = "«»„“”‟"
DASHES = "–—−"
URL = r"(?iU)(https?://\S+|www\.\S+)"
EMAIL = r"(?iU)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
PHONE = r"(?U)(\+?\d[\d\s\-\(\)]{7,}\d)"
ABBREVIATIONS = ("м", "вул", "пл", "пр", "пров", "р", "ст", "с", "ім", "п", "т", "див", "напр", "тобто", "тд", "т.д", "і т.д", "і т.п", "тис", "млн", "тел")
DOT, DECIMAL = "<DOT>", "<DECIMAL_DOT>"
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+(?=(?:[\"\)\]]?\s*)?[A-ZА-ЯІЇЄҐ])"
_CYRILLIC = "[А-Яа-яІіЇїЄєҐґ]"


def c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean(t: Column | str) -> Column:
    """NULL becomes empty, every run of white space (no-break spaces too) one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c(t), F.lit("")), r"(?U)\s+", " "))


def normalize(t: Column | str) -> Column:
    """One apostrophe, one quotation mark, one dash; a Latin i between Cyrillic letters becomes Cyrillic; white space collapsed."""
    s = F.translate(F.coalesce(c(t), F.lit("")), APOSTROPHES + QUOTES + DASHES, "'" * len(APOSTROPHES) + '"' * len(QUOTES) + "-" * len(DASHES))
    s = F.regexp_replace(s, f"(?<={_CYRILLIC})i(?={_CYRILLIC})", "і")
    return clean(F.regexp_replace(s, f"(?<={_CYRILLIC})I(?={_CYRILLIC})", "І"))


def mask(t: Column | str) -> Column:
    """struct(masked, urls, emails, phones): masks in this order, each kind counted on the text left by the one before."""
    s0 = F.coalesce(c(t), F.lit(""))
    s1 = F.regexp_replace(s0, URL, "<URL>")
    s2 = F.regexp_replace(s1, EMAIL, "<EMAIL>")
    return F.struct(F.regexp_replace(s2, PHONE, "<PHONE>").alias("masked"), F.regexp_count(s0, F.lit(URL)).alias("urls"), F.regexp_count(s1, F.lit(EMAIL)).alias("emails"), F.regexp_count(s2, F.lit(PHONE)).alias("phones"))


def _escaped(s: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in s)


def protect(t: Column | str, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Full stops of listed abbreviations (in list order, in the list's spelling) and between digits become placeholders."""
    s = reduce(lambda a, ab: F.regexp_replace(a, rf"(?iU)\b{_escaped(ab)}\.", ab + DOT), abbreviations, c(t))
    return F.regexp_replace(s, r"(?U)(?<=\d)\.(?=\d)", DECIMAL)


def split_sentences(t: Column | str, abbreviations: tuple[str, ...] = ABBREVIATIONS) -> Column:
    """Sentences of a text: a mark, a blank and a capital (a quote or bracket may stand between) end one; fragments of a lone quote or bracket are dropped."""
    s = protect(F.trim(F.coalesce(c(t), F.lit(""))), abbreviations)
    parts = F.split(s, SENTENCE_GAP)
    kept = F.filter(parts, lambda p: ~F.trim(p).isin('"', ")", "]", ""))
    restored = F.transform(kept, lambda p: F.trim(F.regexp_replace(F.replace(F.replace(F.trim(p), F.lit(DECIMAL), F.lit(".")), F.lit(DOT), F.lit(".")), r"(?U)\s+", " ")))
    return F.filter(restored, lambda p: p != "")


def apostrophes_first(t: Column | str) -> Column:
    """The shorter order of cleaning: apostrophes, then masks, then white space; quotes and dashes stay."""
    s = F.translate(F.coalesce(c(t), F.lit("")), APOSTROPHES, "'" * len(APOSTROPHES))
    return clean(F.regexp_replace(F.regexp_replace(F.regexp_replace(s, URL, "<URL>"), EMAIL, "<EMAIL>"), PHONE, "<PHONE>"))


def preprocess(df: DataFrame, text: str) -> DataFrame:
    """The rows with clean, normalized, masked, sentences and the counters chars_before, chars_after, urls, emails, phones, n_sentences: the whole chain, each step once."""
    x = df.withColumn("clean", clean(text)).withColumn("normalized", normalize("clean"))
    x = x.withColumn("_1", F.regexp_replace("normalized", URL, "<URL>")).withColumn("_2", F.regexp_replace("_1", EMAIL, "<EMAIL>")).withColumn("masked", F.regexp_replace("_2", PHONE, "<PHONE>"))
    x = x.withColumn("urls", F.regexp_count("normalized", F.lit(URL))).withColumn("emails", F.regexp_count("_1", F.lit(EMAIL))).withColumn("phones", F.regexp_count("_2", F.lit(PHONE)))
    x = x.withColumn("sentences", split_sentences("masked")).withColumn("n_sentences", F.size("sentences"))
    return x.withColumn("chars_before", F.length(F.coalesce(c(text), F.lit("")))).withColumn("chars_after", F.length("masked")).drop("_1", "_2")


def word_count(t: Column | str) -> Column:
    """Words between white space; 0 for NULL and blank texts."""
    return F.size(F.filter(F.split(F.coalesce(c(t), F.lit("")), r"(?U)\s+"), lambda x: x != ""))


def json_check(t: Column | str) -> Column:
    """struct(valid, n): whether the whole text is one JSON value, and its length if that is an array. NULL gives NULL; blank text, and an object with a key twice, is invalid."""
    # the JSON reader stops after the first value; what follows it breaks one wrapping or the other
    valid = F.when(c(t).isNotNull(), F.try_parse_json(F.concat(F.lit("["), c(t), F.lit("]"))).isNotNull() & F.try_parse_json(F.concat(F.lit('{"a":'), c(t), F.lit("}"))).isNotNull())
    return F.struct(valid.alias("valid"), F.when(valid, F.json_array_length(c(t))).alias("n"))


def is_short(t: Column | str, words: int = 5) -> Column:
    return word_count(t) < words


def is_garbage(t: Column | str) -> Column:
    """Empty, digits only, or symbols only."""
    s = F.trim(F.coalesce(c(t), F.lit("")))
    return (s == "") | s.rlike(r"(?U)^\d+$") | s.rlike(r"(?U)^[\W_]+$")


def is_tricky(t: Column | str) -> Column:
    """Latin letters, numbers with a point, apostrophes, hyphens or dashes, @ or #."""
    return F.coalesce(c(t), F.lit("")).rlike(r"(?U)[A-Za-z]|\d+\.\d+|['ʼ’\-—–@#]")


def difficulty(t: Column | str) -> Column:
    """Additive score of what makes a text tricky: Latin, apostrophes, numbers with a point and shouting count two, hyphens or dashes and @ or # one."""
    s = F.coalesce(c(t), F.lit(""))
    terms = [(s.rlike("[A-Za-z]"), 2), (s.rlike("['’ʼ]"), 2), (s.rlike("[-—–]"), 1), (s.rlike("[@#]"), 1), (s.rlike(r"(?U)\d+\.\d+"), 2), ((F.upper(s) == s) & (F.lower(s) != s) & (F.length(s) >= 6), 2)]
    return reduce(lambda a, b: a + b, [x.cast("int") * n for x, n in terms])


def topic_tokens(t: Column | str, stopwords: tuple[str, ...] = (), drop: tuple[str, ...] = (), least: int = 3) -> Column:
    """Tokens for topic models: lower case, given phrases, non-letters and digits dropped, stop words and short tokens filtered."""
    s = F.translate(F.lower(F.coalesce(c(t), F.lit(""))), "'’", "  ")
    s = reduce(lambda a, p: F.regexp_replace(a, "(?U)" + p, " "), drop, s)
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[^\w\sіїєґІЇЄҐ-]", " "), r"(?U)\d+", " ")
    words = F.split(clean(s), " ")
    stop = F.array(*[F.lit(w) for w in stopwords]).cast("array<string>")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~F.array_contains(stop, w))


def embedding_tokens(t: Column | str) -> Column:
    """Words with inner hyphens and apostrophes, lower case, without outer -'_ and pure digits."""
    found = F.regexp_extract_all(F.lower(F.coalesce(c(t), F.lit(""))), F.lit(r"(?U)\w+(?:[-'’]\w+)*"), 0)
    return F.filter(F.transform(found, lambda w: F.btrim(w, F.lit("-'_"))), lambda w: (w != "") & ~w.rlike(r"(?U)^\d+$"))


def symbol_tokens(t: Column | str) -> Column:
    """Words and single symbols in order."""
    return F.regexp_extract_all(F.coalesce(c(t), F.lit("")), F.lit(r"(?U)\w+|[^\w\s]"), 0)


def fold_replace(t: Column | str, pairs: tuple[tuple[str, str], ...]) -> Column:
    """Ordered literal replacements: each sees what the ones before left."""
    return reduce(lambda a, p: F.replace(a, F.lit(p[0]), F.lit(p[1])), pairs, F.lower(F.coalesce(c(t), F.lit(""))))


def excerpt(t: Column | str, n: int) -> Column:
    return F.substring(F.replace(c(t), F.lit("\n"), F.lit(" ")), 1, n)


def affixes(form: Column | str) -> Column:
    """struct(p2, p3, s2, s3, s4) of the lower-case form; short forms give themselves."""
    w = F.lower(c(form))
    return F.struct(F.substring(w, 1, 2).alias("p2"), F.substring(w, 1, 3).alias("p3"), *[F.right(w, F.lit(n)).alias(f"s{n}") for n in (2, 3, 4)])


def shape(form: Column | str) -> Column:
    """struct of flags: upper, title, digit, hyphen, apostrophe, punctuation."""
    w = c(form)
    return F.struct(
        ((F.upper(w) == w) & (F.lower(w) != w)).alias("is_upper"), w.rlike(r"^(?:\P{L}*\p{Lu}\p{Ll}*(?=\P{L}|$))+\P{L}*$").alias("is_title"), w.rlike(r"(?U)^\d+$").alias("is_digit"),
        w.contains("-").alias("has_hyphen"), w.rlike("['’ʼ]").alias("has_apostrophe"), w.rlike(r"(?U)^[^\w\s]+$").alias("is_punct"),
    )


def feats_string(feats: Column | str) -> Column:
    """MAP<STRING, ARRAY<STRING>> as Key=v1,v2|Key=v with sorted keys; _ for none."""
    m = F.array_sort(F.map_entries(c(feats)))
    return F.coalesce(F.nullif(F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), "|"), F.lit("")), F.lit("_"))


def joint_label(upos: Column | str, feats: Column | str) -> Column:
    return F.concat_ws("||", c(upos), c(feats))


def split_joint(label: Column | str) -> Column:
    """struct(upos, feats) of a joint label."""
    return F.struct(F.split_part(c(label), F.lit("||"), F.lit(1)).alias("upos"), F.regexp_replace(c(label), r"^.*?\|\|", "").alias("feats"))


def sha_mod6(t: Column | str) -> Column:
    """SHA-256 of a text as a number, modulo 6: powers of 16 are 4 modulo 6."""
    h = F.sha2(c(t), 256)
    digit = lambda s: F.conv(s, 16, 10).cast("int")
    head = F.aggregate(F.filter(F.split(F.substring(h, 1, 63), ""), lambda x: x != ""), F.lit(0), lambda a, x: a + digit(x))
    return ((head * 4 + digit(F.substring(h, 64, 1))) % 6).cast("int")


def neighbour_string(word: Column | str, score: Column | str) -> Column:
    return F.format_string("%s (%.3f)", c(word), c(score))


def ladder(rules: tuple[tuple[Column, str], ...], default: str | None) -> Column:
    """The label of the first rule that holds."""
    out = None
    for cond, label in rules:
        out = F.when(cond, F.lit(label)) if out is None else out.when(cond, F.lit(label))
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)
