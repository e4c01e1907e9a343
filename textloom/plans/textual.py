"""Registered queries: text functions, extraction with spans, tokens and tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import spans as R
from ..functions import text as X
from ..operators import evaluation, features, metrics, tagging
from ..sources.readers import parquet
from .relational import WORD, WS, reviews

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f
    return add


_COLLAPSE = lambda x: f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"
_TEXT = "coalesce(text, '')"
_D = r"\p{Nd}"
_CYR = "[А-Яа-яІіЇїЄєҐґ]"
_TRANSLATED = f"translate({_COLLAPSE(_TEXT)}, '’ʼ`´«»„“”‟–—−', '''''''''\"\"\"\"\"\"---')"


def _between(x: str, latin: str, cyr: str) -> str:
    """The replacement between two Cyrillic letters without lookaround: twice, as neighbours share letters."""
    once = lambda y: f"regexp_replace({y}, '({_CYR}){latin}({_CYR})', '\\1{cyr}\\2', 'g')"
    return once(once(x))


_NORMAL = _COLLAPSE(_between(_between(_TRANSLATED, "i", "і"), "I", "І"))
_S1 = f"regexp_replace({_TEXT}, '(?i)(https?://[^\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}]+|www\\.[^\\s\\x{{00A0}}\\x{{2000}}-\\x{{200A}}\\x{{202F}}]+)', '<URL>', 'g')"
_EMAIL = r"(?i)\b[A-Z0-9._%+-]+@[A-Z0-9.-]+\.[A-Z]{2,}\b"
_S2 = f"regexp_replace(s1, '{_EMAIL}', '<EMAIL>', 'g')"
_PHONE = rf"(\+?{_D}([{_D}\-\(\)]|{WS}){{7,}}{_D})"


@query(f"SELECT text_id, {_COLLAPSE(_TEXT)} AS clean FROM processed_v2_sample")
def x1_clean(s, d):
    return reviews(s, d).select("text_id", X.clean("text").alias("clean"))


@query(f"SELECT text_id, {_NORMAL} AS normalized FROM processed_v2_sample")
def x2_normalize(s, d):
    return reviews(s, d).select("text_id", X.normalize(X.clean("text")).alias("normalized"))


_URL = "(?i)(https?://[^\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}]+|www\\.[^\\s\\x{00A0}\\x{2000}-\\x{200A}\\x{202F}]+)"


@query(f"""SELECT text_id, regexp_replace(s2, '{_PHONE}', '<PHONE>', 'g') AS masked, len(regexp_extract_all({_TEXT}, '{_URL}'))::INT AS urls, len(regexp_extract_all(s1, '{_EMAIL}'))::INT AS emails, len(regexp_extract_all(s2, '{_PHONE}'))::INT AS phones
FROM (SELECT *, {_S2} AS s2 FROM (SELECT text_id, text, {_S1} AS s1 FROM processed_v2_sample))""")
def x4_mask(s, d):
    m = reviews(s, d).select("text_id", X.mask("text").alias("m"))
    return m.select("text_id", "m.masked", "m.urls", "m.emails", "m.phones")


@query(f"""SELECT sum(len(regexp_extract_all({_TEXT}, '{_URL}')))::BIGINT AS urls, sum(len(regexp_extract_all(s1, '{_EMAIL}')))::BIGINT AS emails, sum(len(regexp_extract_all(s2, '{_PHONE}')))::BIGINT AS phones
FROM (SELECT *, {_S2} AS s2 FROM (SELECT text, {_S1} AS s1 FROM processed_v2_sample))""")
def a7_mask_totals(s, d):
    return reviews(s, d).select(X.mask("text").alias("m")).agg(F.sum("m.urls").alias("urls"), F.sum("m.emails").alias("emails"), F.sum("m.phones").alias("phones"))


_NOT_WORD = "(^|" + WORD.replace("[", "[^", 1) + ")"


def _twice(f, x: str) -> str:
    """A replacement whose matches share a character with the next one, applied twice."""
    return f(f(x))


def _sql_protected(x: str) -> str:
    for ab in X.ABBREVIATIONS:
        dotted = ab.replace(".", "\\.")
        x = _twice(lambda y, ab=ab, dotted=dotted: f"regexp_replace({y}, '{_NOT_WORD}(?i:{dotted})\\.', '\\1{ab}<DOT>', 'g')", x)
    return _twice(lambda y: f"regexp_replace({y}, '({_D})\\.({_D})', '\\1<DECIMAL_DOT>\\2', 'g')", x)


_GAPS = f"string_split(regexp_replace(p, '([.!?]){WS}+([\"\\)\\]]?{WS}*[A-ZА-ЯІЇЄҐ])', '\\1' || chr(2) || '\\2', 'g'), chr(2))"
_KEPT = f"list_filter({_GAPS}, lambda x: trim(x) NOT IN ('\"', ')', ']', ''))"
_SENTENCES = f"list_filter(list_transform({_KEPT}, lambda x: trim(regexp_replace(replace(replace(trim(x), '<DECIMAL_DOT>', '.'), '<DOT>', '.'), '{WS}+', ' ', 'g'))), lambda x: x <> '')"
_PROTECTED = f"{_sql_protected('trim(masked)')} AS p"
_N1 = _S1.replace(_TEXT, "normalized")


@query(f"SELECT text_id, {_sql_protected(_TEXT)} AS protected FROM processed_v2_sample")
def x5_protect(s, d):
    """Full stops of abbreviations and in numbers as placeholders."""
    return reviews(s, d).select("text_id", X.protect(F.coalesce("text", F.lit(""))).alias("protected"))


@query(f"SELECT text_id, array_to_string({_SENTENCES}, chr(10)) AS sentences FROM (SELECT text_id, {_PROTECTED} FROM (SELECT text_id, {_COLLAPSE(_TEXT)} AS masked FROM processed_v2_sample))")
def x6_sentences(s, d):
    """Sentences of the cleaned text, a line each."""
    return reviews(s, d).select("text_id", F.array_join(X.split_sentences(X.clean("text")), "\n").alias("sentences"))


@query(f"""SELECT text_id, normalized, masked, array_to_string(s, chr(10)) AS sentences, length({_TEXT})::INT AS chars_before, length(masked)::INT AS chars_after, urls, emails, phones, len(s)::INT AS n_sentences FROM
(SELECT *, {_SENTENCES} AS s FROM (SELECT *, {_PROTECTED} FROM (SELECT *, regexp_replace(s2, '{_PHONE}', '<PHONE>', 'g') AS masked, len(regexp_extract_all(s2, '{_PHONE}'))::INT AS phones FROM
(SELECT *, regexp_replace(s1, '{_EMAIL}', '<EMAIL>', 'g') AS s2, len(regexp_extract_all(s1, '{_EMAIL}'))::INT AS emails FROM (SELECT *, {_N1} AS s1, len(regexp_extract_all(normalized, '{_URL}'))::INT AS urls FROM (SELECT text_id, text, {_NORMAL} AS normalized FROM processed_v2_sample))))))""")
def x7_preprocess(s, d):
    """Cleaning, normalisation, masks, sentences and their counters."""
    p = X.preprocess(reviews(s, d).select("text_id", "text"), "text")
    return p.select("text_id", "normalized", "masked", F.array_join("sentences", "\n").alias("sentences"), "chars_before", "chars_after", "urls", "emails", "phones", "n_sentences")


@query(f"SELECT sum((n <> twice)::INT)::BIGINT AS not_idempotent, sum((coalesce(regexp_matches(text, '\\p{{L}}'), false) AND n = '')::INT)::BIGINT AS emptied, sum((n <> {_TEXT})::INT)::BIGINT AS changed FROM (SELECT *, {_NORMAL.replace(_TEXT, 'n')} AS twice FROM (SELECT text, {_NORMAL} AS n FROM processed_v2_sample))")
def x8_idempotence(s, d):
    """How many texts cleaning changes, how many a second time, and how many with letters become empty."""
    c = reviews(s, d).select("text", X.normalize(X.clean("text")).alias("n")).withColumn("twice", X.normalize(X.clean("n")))
    return c.agg(F.count_if(F.col("twice") != F.col("n")).alias("not_idempotent"), F.count_if(F.col("text").rlike(r"\p{L}") & (F.col("n") == "")).alias("emptied"), F.count_if(F.col("n") != F.coalesce("text", F.lit(""))).alias("changed"))


_APOSTROPHES = f"translate({_TEXT}, '’ʼ`´', '{chr(39) * 8}')"


@query(f"""SELECT text_id, {_COLLAPSE(f"regexp_replace(s2, '{_PHONE}', '<PHONE>', 'g')")} AS cleaned FROM (SELECT text_id, {_S2} AS s2 FROM (SELECT text_id, {_S1.replace(_TEXT, _APOSTROPHES)} AS s1 FROM processed_v2_sample))""")
def x3_apostrophes_first(s, d):
    """The shorter order of cleaning."""
    return reviews(s, d).select("text_id", X.apostrophes_first("text").alias("cleaned"))


_TRICKY = [("[A-Za-z]", 2), ("[''’ʼ]", 2), ("[-—–]", 1), ("[@#]", 1), (rf"{_D}+\.{_D}+", 2)]


@query(f"""SELECT text_id, {' OR '.join(f"regexp_matches({_TEXT}, '{p}')" for p, _ in _TRICKY)} AS tricky, ({' + '.join(f"regexp_matches({_TEXT}, '{p}')::INT * {n}" for p, n in _TRICKY)} + (upper({_TEXT}) = {_TEXT} AND lower({_TEXT}) <> {_TEXT} AND length({_TEXT}) >= 6)::INT * 2)::INT AS score FROM processed_v2_sample""")
def proj6_difficulty(s, d):
    return reviews(s, d).select("text_id", X.is_tricky("text").alias("tricky"), X.difficulty("text").alias("score"))


@query(f"""SELECT text_id, array_to_string(t, ' ') AS tokens FROM (SELECT text_id, list_filter(list_transform(regexp_extract_all(lower({_TEXT}), '{WORD}+([-''’]{WORD}+)*'), lambda x: trim(x, '-''_')), lambda x: x <> '' AND NOT regexp_full_match(x, '{_D}+')) AS t FROM processed_v2_sample) WHERE len(t) > 0""")
def proj9_non_empty(s, d):
    t = reviews(s, d).select("text_id", X.embedding_tokens("text").alias("t")).where(F.size("t") > 0)
    return t.select("text_id", F.array_join("t", " ").alias("tokens"))


@query("SELECT case_id, CASE WHEN len(k) = 0 THEN '_' ELSE array_to_string(k, '|') END AS feats FROM (SELECT case_id, list_filter(['Route=' || expected_route, CASE WHEN len(expected.services_mentioned) > 0 THEN 'Services=' || array_to_string(expected.services_mentioned, ',') END, CASE WHEN len(tags) > 0 THEN 'Tags=' || array_to_string(tags, ',') END], lambda x: x IS NOT NULL) AS k FROM test_cases_lab13)")
def x14_feats(s, d):
    """A map of lists as one string with sorted keys."""
    t = parquet(s, d, "test_cases_lab13")
    none = F.array().cast("array<string>")
    entry = lambda k, v: F.when(F.size(v) > 0, F.struct(F.lit(k).alias("key"), v.alias("value")))
    m = F.map_from_entries(F.array_compact(F.array(entry("Tags", F.coalesce("tags", none)), entry("Services", F.coalesce("expected.services_mentioned", none)), entry("Route", F.array_compact(F.array("expected_route"))))))
    return t.select("case_id", X.feats_string(m).alias("feats"))


_STOP = "['для', 'або', 'але', 'the', 'and', 'nie', 'jest']"


_NONLETTER = r"[^\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}\x{200C}\x{200D}\s\x{000B}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}-]"


@query(f"""SELECT text_id, array_to_string(list_filter(string_split({_COLLAPSE(f"regexp_replace(regexp_replace(translate(lower({_TEXT}), chr(39) || '’', '  '), '{_NONLETTER}', ' ', 'g'), '{_D}+', ' ', 'g')")}, ' '), lambda x: length(x) >= 3 AND NOT list_contains({_STOP}, x)), ' ') AS tokens FROM processed_v2_sample""")
def x9_topic_tokens(s, d):
    return reviews(s, d).select("text_id", F.array_join(X.topic_tokens("text", ("для", "або", "але", "the", "and", "nie", "jest")), " ").alias("tokens"))


@query(f"""SELECT text_id, array_to_string(list_filter(list_transform(regexp_extract_all(lower({_TEXT}), '{WORD}+([-''’]{WORD}+)*'), lambda x: trim(x, '-''_')), lambda x: x <> '' AND NOT regexp_full_match(x, '{_D}+')), ' ') AS tokens FROM processed_v2_sample""")
def x10_embedding_tokens(s, d):
    return reviews(s, d).select("text_id", F.array_join(X.embedding_tokens("text"), " ").alias("tokens"))


_SYMBOL = rf"{WORD}+|" + _NONLETTER.replace("-]", "]")


@query(f"SELECT text_id, len(regexp_extract_all({_TEXT}, '{_SYMBOL}'))::INT AS n, array_to_string(regexp_extract_all({_TEXT}, '{_SYMBOL}'), ' ') AS tokens FROM processed_v2_sample")
def x11_symbol_tokens(s, d):
    t = X.symbol_tokens("text")
    return reviews(s, d).select("text_id", F.size(t).alias("n"), F.array_join(t, " ").alias("tokens"))


@query(f"SELECT text_id, len(list_filter(string_split_regex({_TEXT}, '{WS}+'), lambda x: x <> ''))::INT AS words FROM processed_v2_sample")
def x12_word_count(s, d):
    return reviews(s, d).select("text_id", X.word_count("text").alias("words"))


@query(f"SELECT text_id, replace(replace(replace(lower({_TEXT}), 'талон', 'квиток'), 'квиток так', 'квиток'), 'ё', 'е') AS folded FROM processed_v2_sample")
def x13_fold_replace(s, d):
    return reviews(s, d).select("text_id", X.fold_replace("text", (("талон", "квиток"), ("квиток так", "квиток"), ("ё", "е"))).alias("folded"))


_FORMS = r"(SELECT DISTINCT form FROM (SELECT unnest(regexp_extract_all(text, '[\p{L}\p{Nd}''’ʼ-]+')) AS form FROM processed_v2_sample))"


def _forms(s, d):
    return reviews(s, d).select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{Nd}'’ʼ-]+"), 0)).alias("form")).distinct()


@query(f"SELECT form, substring(lower(form), 1, 2) AS p2, substring(lower(form), 1, 3) AS p3, right(lower(form), 2) AS s2, right(lower(form), 3) AS s3, right(lower(form), 4) AS s4 FROM {_FORMS}")
def x15_affixes(s, d):
    return _forms(s, d).select("form", X.affixes("form").alias("a")).select("form", "a.*")


@query(rf"SELECT form, upper(form) = form AND lower(form) <> form AS is_upper, regexp_full_match(form, '{_D}+') AS is_digit, contains(form, '-') AS has_hyphen, regexp_matches(form, '[''’ʼ]') AS has_apostrophe, regexp_matches(form, '\p{{Lu}}') AND NOT regexp_matches(form, '[\p{{L}}]\p{{Lu}}|(^|\P{{L}})[^\p{{Lu}}\P{{L}}]') AS is_title, regexp_full_match(form, '[''’ʼ-]+') AS is_punct FROM {_FORMS}")
def x16_shapes(s, d):
    f = X.shape("form")
    return _forms(s, d).select("form", f["is_upper"].alias("is_upper"), f["is_digit"].alias("is_digit"), f["has_hyphen"].alias("has_hyphen"), f["has_apostrophe"].alias("has_apostrophe"), f["is_title"].alias("is_title"), f["is_punct"].alias("is_punct"))


@query(r"""SELECT text_id, list_distinct_sorted AS amounts FROM (SELECT text_id, array_to_string(list_sort(list_distinct(list_transform(regexp_extract_all(coalesce(text, ''), '(?i)(\p{Nd}[\p{Nd}\s\x{00A0}\x{2000}-\x{200A}\x{202F}]*([\s\x{00A0}\x{2000}-\x{200A}\x{202F}]*тис\.?)?)[\s\x{00A0}\x{2000}-\x{200A}\x{202F}]*грн', 1),
lambda x: try_cast(regexp_replace(x, '[^\p{Nd}]', '', 'g') AS BIGINT) * CASE WHEN contains(lower(x), 'тис') THEN 1000 ELSE 1 END))), ',') AS list_distinct_sorted FROM processed_v2_sample) WHERE NOT regexp_matches(list_distinct_sorted, '[０-９]')""")
def x19_amounts(s, d):
    return reviews(s, d).select("text_id", F.array_join(F.transform(F.array_sort(R.amounts("text")), lambda x: x.cast("string")), ",").alias("amounts"))


@query("SELECT text_id, CASE WHEN sentences IS NOT NULL THEN coalesce(json_valid(sentences), false) AND trim(sentences) <> '' END AS valid, CASE WHEN json_valid(sentences) AND trim(sentences) <> '' AND json_type(sentences) = 'ARRAY' THEN json_array_length(sentences) END::INT AS n FROM processed_v2_sample")
def x21_json_check(s, d):
    """The check of every row, whatever its value begins with: NULL is neither valid nor invalid (NULL), an empty value is invalid."""
    v = X.json_check("sentences")
    return reviews(s, d).select("text_id", v["valid"].alias("valid"), v["n"].alias("n"))


@query("SELECT text_id, (4 * list_sum(list_transform(string_split(substring(h, 1, 63), ''), lambda x: ('0x' || x)::INT)) + ('0x' || substring(h, 64, 1))::INT)::INT % 6 AS mode FROM (SELECT text_id, sha256(text) AS h FROM processed_v2_sample WHERE text IS NOT NULL)")
def x22_hash_mode(s, d):
    return reviews(s, d).where("text IS NOT NULL").select("text_id", X.sha_mod6("text").alias("mode"))


@query("SELECT text_id, label || ' (' || printf('%.3f', length(text) / 1000) || ')' AS shown FROM processed_v2_sample WHERE label IS NOT NULL AND text IS NOT NULL")
def x24_neighbour_string(s, d):
    return reviews(s, d).where("label IS NOT NULL AND text IS NOT NULL").select("text_id", X.neighbour_string("label", F.length("text") / F.lit(1000)).alias("shown"))


@query("SELECT text_id, CASE WHEN contains(lower(text), 'дякую') THEN 'thanks' WHEN contains(text, '?') THEN 'question' WHEN contains(text, '!') THEN 'emphatic' ELSE 'plain' END AS category FROM processed_v2_sample WHERE text IS NOT NULL")
def x25_ladder(s, d):
    return reviews(s, d).where("text IS NOT NULL").select("text_id", X.ladder(((F.lower("text").contains("дякую"), "thanks"), (F.col("text").contains("?"), "question"), (F.col("text").contains("!"), "emphatic")), "plain").alias("category"))


@query("SELECT label || '||' || source AS joint, label AS upos, source AS feats FROM processed_v2_sample WHERE label IS NOT NULL AND source IS NOT NULL")
def x26_joint_label(s, d):
    j = reviews(s, d).where("label IS NOT NULL AND source IS NOT NULL").select(X.joint_label("label", "source").alias("joint"))
    return j.select("joint", X.split_joint("joint")["upos"].alias("upos"), X.split_joint("joint")["feats"].alias("feats"))


def _sql_spans(pattern: str) -> str:
    """Offsets in SQL: sentinels around matches, then running lengths of the alternating pieces."""
    return rf"""(SELECT text_id, i, list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::INT AS start_char, p[i] AS value FROM
(SELECT text_id, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT text_id, string_split(regexp_replace(text, '{pattern}', chr(1) || '\0' || chr(1), 'g'), chr(1)) AS p FROM processed_v2_sample WHERE text IS NOT NULL)))"""


@query("SELECT text_id, start_char, (start_char + length(value))::INT AS end_char, value FROM " + _sql_spans(r"#[0-9]{4,6}-[A-Z]{2}"))
def r9_spans(s, d):
    """Every match of a pattern with its code-point offsets."""
    return reviews(s, d).where("text IS NOT NULL").select("text_id", F.inline(R.find("text", "#[0-9]{4,6}-[A-Z]{2}"))).drop("label")


_EDGE = "[^" + WORD[1:-1] + r"\x{01}\x{02}]"


def _marked(text: str, pattern: str, before: str, after: str | None) -> str:
    """Matches of a pattern between two kinds of neighbours, put between sentinels. RE2 has no lookaround, so neighbours are matched too; two matches may share one, hence twice, unless only the one before counts."""
    if after is None:
        return f"regexp_replace({text}, '(?i)(^|{before})({pattern})', '\\1' || chr(1) || '\\2' || chr(2), 'g')"
    once = lambda x: f"regexp_replace({x}, '(?i)(^|{before})({pattern})($|{after})', '\\1' || chr(1) || '\\2' || chr(2) || '\\3', 'g')"
    return once(once(text))


def _sql_between(pattern: str, before: str = _EDGE, after: str | None = _EDGE, source: str = "processed_v2_sample", key: str = "text_id") -> str:
    """(key, start_char, end_char, value) of the matches of a pattern whose neighbours are of the given kinds."""
    return rf"""(SELECT {key}, i, list_sum(list_transform(p[1:i - 1], lambda x: length(x)))::INT AS start_char, (list_sum(list_transform(p[1:i - 1], lambda x: length(x))) + length(p[i]))::INT AS end_char, p[i] AS value FROM
(SELECT {key}, p, unnest(range(2, len(p) + 1, 2)) AS i FROM (SELECT {key}, string_split(replace({_marked('text', pattern, before, after)}, chr(2), chr(1)), chr(1)) AS p FROM {source} WHERE text IS NOT NULL)))"""


_MONTHS = "|".join(R.MONTHS)
_DIGITS = lambda x: f"translate({x}, '０１２３４５６７８９', '0123456789')::INT"
_NUMERIC_DATE = rf"{_D}{{1,2}}[./-]{_D}{{1,2}}[./-]{_D}{{4}}"
_PART = lambda i: _DIGITS(rf"regexp_extract(value, '({_D}{{1,2}})[./-]({_D}{{1,2}})[./-]({_D}{{4}})', {i})")


def _sql_numeric(source: str, key: str) -> str:
    return rf"""(SELECT {key}, start_char, end_char, value, printf('%04d-%02d-%02d', y, m, d) AS parsed, 'numeric' AS method FROM (SELECT *, {_PART(1)} AS d, {_PART(2)} AS m, {_PART(3)} AS y FROM {_sql_between(_NUMERIC_DATE, source=source, key=key)}) WHERE d BETWEEN 1 AND 31 AND m BETWEEN 1 AND 12)"""


def _sql_textual(source: str, key: str) -> str:
    """With a year where one follows, else with the white space before the next word."""
    spans = _sql_between(rf"{_D}{{1,2}}{WS}+(?:{_MONTHS})(?:{WS}*{_D}{{4}})?", source=source, key=key)
    year = rf"regexp_extract(value, '({_D}{{4}})$', 1)"
    month = f"list_position([{', '.join(repr(m) for m in R.MONTHS)}], lower(regexp_extract(value, '(?i)({_MONTHS})', 1)))"
    return rf"""(SELECT {key}, start_char, end_char, value, CASE WHEN {year} <> '' THEN printf('%04d-%02d-%02d', {_DIGITS(year)}, {month}, {_DIGITS(f"regexp_extract(value, '^({_D}{{1,2}})', 1)")}) END AS parsed, 'textual' AS method FROM {spans})"""


_DATES = f"(SELECT * FROM {_sql_numeric('processed_v2_sample', 'text_id')} UNION ALL SELECT * FROM {_sql_textual('processed_v2_sample', 'text_id')})"


def _trimmed(df):
    """Dates without a year end at the month: the pattern lets them run on over white space."""
    v = F.when(F.col("parsed").isNull(), F.regexp_replace("value", r"(?U)\s+$", "")).otherwise(F.col("value"))
    return df.withColumn("end_char", F.col("start_char") + F.length(v)).withColumn("value", v)


@query(f"SELECT text_id, start_char, end_char, value, parsed, method FROM {_DATES}")
def r1_dates(s, d):
    """Numeric and textual dates with their offsets, as ISO text where they can be."""
    return _trimmed(reviews(s, d).where("text IS NOT NULL").select("text_id", F.inline(R.dates("text"))))


@query(f"SELECT method, count(*) AS n, count(parsed) AS parsed, count(DISTINCT parsed) AS days, min(parsed) AS first, max(parsed) AS last FROM {_DATES} GROUP BY method")
def x18_textual_dates(s, d):
    """How many dates of each kind could be read, and the earliest and latest of them."""
    return reviews(s, d).where("text IS NOT NULL").select(F.inline(R.dates("text"))).groupBy("method").agg(F.count("*").alias("n"), F.count("parsed").alias("parsed"), F.count_distinct("parsed").alias("days"), F.min("parsed").alias("first"), F.max("parsed").alias("last"))


@query(rf"""SELECT value, CASE WHEN d BETWEEN 1 AND 31 AND m BETWEEN 1 AND 12 THEN printf('%04d-%02d-%02d', y, m, d) END AS iso FROM (SELECT *, {_PART(1)} AS d, {_PART(2)} AS m, {_PART(3)} AS y FROM (SELECT DISTINCT value FROM (SELECT unnest(regexp_extract_all(text, '[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{4}}')) AS value FROM processed_v2_sample) UNION SELECT unnest(['31.02.2020', '32.01.2020', '1.13.2020', '0.5.2020'])))""")
def x17_numeric_dates(s, d):
    """Numeric dates as ISO text by a test of ranges only: the 31st of February passes, a 13th month does not."""
    t = reviews(s, d).select(F.explode(F.regexp_extract_all("text", F.lit("[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{4}"), 0)).alias("value"))
    odd = s.createDataFrame([(x,) for x in ("31.02.2020", "32.01.2020", "1.13.2020", "0.5.2020")], "value STRING")
    return t.unionByName(odd).distinct().select("value", R.numeric_date(F.col("value")).alias("iso"))


_WORDS_OF = "|".join(w for w in R.DOCUMENT_WORDS if w != "№")


def _sql_documents(source: str, key: str) -> str:
    named = _sql_between(rf"(?:{_WORDS_OF}){WS}*№?{WS}*{_D}{{1,10}}", source=source, key=key)
    bare = _sql_between(rf"№{WS}*{_D}{{1,10}}", before=".", source=source, key=key)
    return rf"""(SELECT {key}, start_char, end_char, value, regexp_extract(value, '({_D}{{1,10}})$', 1) AS doc_id FROM (SELECT * FROM {named} UNION ALL SELECT b.* FROM {bare} b LEFT JOIN {named} n ON b.{key} = n.{key} AND b.start_char < n.end_char AND b.end_char > n.start_char WHERE n.{key} IS NULL) WHERE NOT regexp_matches(regexp_extract(value, '({_D}{{1,10}})$', 1), '^20{_D}{_D}$'))"""


_FIRSTS = "(SELECT min(text_id) AS text_id, text FROM processed_v2_sample WHERE text IS NOT NULL GROUP BY text)"


def _firsts(s, d):
    """Every text once, under its least id: equal texts have equal spans."""
    return reviews(s, d).where("text IS NOT NULL").groupBy("text").agg(F.min("text_id").alias("text_id"))


@query(f"SELECT text_id, start_char, end_char, value, doc_id FROM {_sql_documents(_FIRSTS, 'text_id')}")
def r3_document_ids(s, d):
    """Document numbers with their offsets, of every different text."""
    return _firsts(s, d).select("text_id", F.inline(R.document_ids("text")))


_PLACES = (("Тихоград", "Тихоград"), ("Тихоград", "Тихограді"), ("Тихоград", "Тихограда"), ("Сніжинськ", "Сніжинськ"), ("Сніжинськ", "Сніжинську"))


def _sql_dictionary(entries, source: str, key: str) -> str:
    """Whole words in their letter case: the case-blind matches that are spelled so."""
    by: dict[str, list[str]] = {}
    for entry, form in entries:
        by.setdefault(entry, []).append(form)
    one = lambda e, fs: f"SELECT DISTINCT {key}, start_char, end_char, value, '{e}' AS label FROM {_sql_between('|'.join(sorted(fs, key=len, reverse=True)), source=source, key=key).replace('(?i)', '')}"
    return "(" + " UNION ALL ".join(one(e, fs) for e, fs in by.items()) + ")"


@query(f"SELECT text_id, start_char, end_char, value, label FROM {_sql_dictionary(_PLACES, _FIRSTS, 'text_id')}")
def r2_dictionary(s, d):
    """Inflected forms of dictionary entries, of every different text."""
    return _firsts(s, d).select("text_id", F.inline(R.dictionary("text", _PLACES)))


@query(f"""SELECT field, count(*) AS n, count(DISTINCT text_id) AS texts FROM (SELECT text_id, 'DATE' AS field FROM {_sql_numeric(_FIRSTS, 'text_id')} UNION ALL SELECT text_id, 'DATE' FROM {_sql_textual(_FIRSTS, 'text_id')}
UNION ALL SELECT text_id, 'DOC_ID' FROM {_sql_documents(_FIRSTS, 'text_id')} UNION ALL SELECT text_id, 'LOCATION' FROM {_sql_dictionary(_PLACES, _FIRSTS, 'text_id')}) GROUP BY field""")
def r4_all_fields(s, d):
    """Dates, places and document numbers of every different text in one list, counted by field."""
    return _firsts(s, d).select("text_id", F.inline(R.extracted("text", _PLACES))).groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("text_id").alias("texts"))


_PHRASES = (("ЦНАП", "ORG"), ("єЗаява", "DOMAIN"), ("гаряча лінія", "DOMAIN"))
_SQL_PHRASES = " UNION ALL ".join(f"SELECT *, '{label}' AS label FROM {_sql_between(p, source=_FIRSTS)}" for p, label in _PHRASES)


@query(f"SELECT text_id, start_char, end_char, value, label FROM ({_SQL_PHRASES})")
def r8_phrases(s, d):
    """Whole-word phrases, letter case aside, of every different text."""
    return _firsts(s, d).select("text_id", F.inline(R.phrases("text", _PHRASES)))


_NO_DIGIT = r"[^\p{Nd}\x{01}\x{02}]"


@query(f"SELECT text_id, start_char, end_char, value, label FROM (SELECT *, 'DATE' AS label FROM {_sql_between(rf'{_D}{{1,2}}(?:-{_D}{{1,2}})?{WS}+(?:{_MONTHS})', before=_NO_DIGIT, after=_EDGE, source=_FIRSTS)})")
def r7_date_ranges(s, d):
    """Days, or ranges of days, before the name of a month, of every different text."""
    return _firsts(s, d).select("text_id", F.inline(R.find("text", R.DATE_RANGE, "DATE")))


@query(f"SELECT text_id, start_char, end_char, value, label FROM (SELECT *, 'MONEY' AS label FROM {_sql_between(rf'{_D}(?:{_D}|{WS})*{WS}*грн|{_D}+грн|{_D}{{1,3}}(?:{WS}{_D}{{3}})+\b|{_D}+-{_D}+\b', before=_NO_DIGIT, after=None, source=_FIRSTS)}) WHERE contains(lower(value), 'грн') OR length(value) >= 5")
def r6_money(s, d):
    """Sums of money, of every different text; without a currency they need five characters."""
    money = F.filter(R.find("text", R.MONEY, "MONEY"), lambda x: F.lower(x["value"]).contains("грн") | (F.length(x["value"]) >= 5))
    return _firsts(s, d).select("text_id", F.inline(money))


@query()
def r11_hybrid_entities(s, d):
    """Date, money and phrase rules merged in order into dictionary entities; the merge is a fold over each text's spans without a SQL form, its parts have one (r2, r6, r7, r8)."""
    rules = R.entities("text", _PHRASES)
    base = R.dictionary("text", (("LOC", "Тихоград"), ("LOC", "Сніжинськ"), ("ORG", "Реєстр пільг")))
    t = reviews(s, d).where("text IS NOT NULL").select("text_id", base.alias("base"), rules.alias("rules"))
    return t.select("text_id", F.inline(R.merge_rules("base", "rules")))


@query(r"""WITH f AS (SELECT text_id, label, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS w FROM (SELECT DISTINCT text_id, text, label FROM processed_v2_sample WHERE text IS NOT NULL))
SELECT label, count(*) AS words, count(DISTINCT w) AS types FROM f GROUP BY label""")
def m4_count_vectors(s, d):
    t = reviews(s, d).where("text IS NOT NULL").select("text_id", "text", "label").distinct()
    return t.select("label", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{M}]+"), 0)).alias("w")).groupBy("label").agg(F.count("*").alias("words"), F.count_distinct("w").alias("types"))


@query(rf"""WITH w AS (SELECT ' ' || unnest(list_filter(string_split(trim(regexp_replace(lower(coalesce(text, '')), '{WS}+', ' ', 'g')), ' '), lambda x: x <> '')) || ' ' AS p FROM processed_v2_sample),
g AS (SELECT substring(p, i, n) AS gram FROM (SELECT p, n, unnest(range(1, greatest(length(p) - n + 1, 1) + 1)) AS i FROM (SELECT p, unnest([3, 4, 5]) AS n FROM w)) WHERE length(p) > n UNION ALL SELECT p FROM w WHERE length(p) <= 5)
SELECT gram, count(*) AS n FROM g GROUP BY gram""")
def m3_char_ngrams(s, d):
    return reviews(s, d).select(F.explode(features.char_ngrams("text")).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))


def _tokens(s, d):
    """A token table: words and symbols of the reviews, tagged by their shape."""
    t = reviews(s, d).where("text IS NOT NULL").select("text_id", "text", "source").distinct()
    x = t.select(F.col("text_id").alias("sentence_id"), "source", F.posexplode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{M}]+|[0-9]+|[.,!?]"), 0)).alias("token_id", "form"))
    return x.withColumn("upos", F.when(F.col("form").rlike("^[0-9]+$"), "NUM").when(F.col("form").rlike("^[.,!?]$"), "PUNCT").when(F.col("form").rlike(r"^\p{Lu}"), "PROPN").otherwise("X"))


_SQL_TOKENS = r"""(SELECT text_id AS sentence_id, source, i - 1 AS token_id, t[i] AS form, CASE WHEN regexp_full_match(t[i], '[0-9]+') THEN 'NUM' WHEN regexp_full_match(t[i], '[.,!?]') THEN 'PUNCT' WHEN regexp_matches(t[i], '^\p{Lu}') THEN 'PROPN' ELSE 'X' END AS upos
FROM (SELECT text_id, source, t, unnest(range(1, len(t) + 1)) AS i FROM (SELECT text_id, source, regexp_extract_all(text, '[\p{L}\p{M}]+|[0-9]+|[.,!?]') AS t FROM (SELECT DISTINCT text_id, text, source FROM processed_v2_sample WHERE text IS NOT NULL))))"""


@query(f"""SELECT sentence_id, token_id::INT AS token_id, form, lower(lag(form) OVER w) AS prev_form, lower(lead(form) OVER w) AS next_form, (row_number() OVER w - 1)::INT AS position, lag(form) OVER w IS NULL AS bos, lead(form) OVER w IS NULL AS eos
FROM {_SQL_TOKENS} WINDOW w AS (PARTITION BY sentence_id ORDER BY token_id)""")
def w1_token_features(s, d):
    return tagging.token_features(_tokens(s, d)).select("sentence_id", "token_id", "form", "prev_form", "next_form", "position", "bos", "eos")


@query(f"""WITH t AS {_SQL_TOKENS}, c AS (SELECT lower(form) AS form, upos, count(*) AS n, min(sentence_id * 100000 + token_id) AS f FROM t WHERE sentence_id % 5 <> 0 GROUP BY ALL), l AS (SELECT form, upos FROM (SELECT *, row_number() OVER (PARTITION BY form ORDER BY n DESC, f) AS r FROM c) WHERE r = 1)
SELECT upos, pred, count(*) AS n FROM (SELECT t.upos, coalesce(l.upos, 'X') AS pred FROM t LEFT JOIN l ON lower(t.form) = l.form WHERE sentence_id % 5 = 0) GROUP BY ALL""")
def m16_lexicon_tagger(s, d):
    """Trained on four fifths of the sentences, applied to the others: a train and test split."""
    t = _tokens(s, d).withColumn("seq", F.col("sentence_id") * 100000 + F.col("token_id"))
    lex = tagging.lexicon(t.where("sentence_id % 5 <> 0"))
    return tagging.tag_by_lexicon(t.where("sentence_id % 5 = 0"), lex, "X").groupBy("upos", "pred").agg(F.count("*").alias("n"))


_GOLD = "(SELECT DISTINCT text_id AS doc, text, start_char, end_char, field_type AS label FROM lab4_gold_ie_draft WHERE field_type IN ('DATE', 'DOC_ID') AND text IS NOT NULL AND start_char >= 0)"
_GOLD_TEXTS = f"(SELECT DISTINCT doc, text FROM {_GOLD})"
_PREDICTED = f"""(SELECT DISTINCT doc, start_char AS ps, end_char AS pe, 'DATE' AS pl FROM {_sql_numeric(_GOLD_TEXTS, 'doc')} UNION SELECT doc, start_char, end_char + CASE WHEN parsed IS NULL THEN 0 ELSE 0 END, 'DATE' FROM {_sql_textual(_GOLD_TEXTS, 'doc')}
UNION SELECT doc, start_char, end_char, 'DOC_ID' FROM {_sql_documents(_GOLD_TEXTS, 'doc')})"""
_COMPARED = f"""(WITH g AS (SELECT DISTINCT doc, start_char, end_char, label FROM {_GOLD}), p AS {_PREDICTED},
j AS (SELECT g.*, min(CASE WHEN g.start_char = ps AND g.end_char = pe THEN CASE WHEN label = pl THEN 0 ELSE 1 END WHEN label = pl THEN 2 ELSE 3 END) AS r FROM g LEFT JOIN p ON g.doc = p.doc AND greatest(g.start_char, ps) < least(g.end_char, pe) GROUP BY ALL)
SELECT label, CASE WHEN r IS NULL THEN 'missed' WHEN r = 0 THEN 'exact' WHEN r = 1 THEN 'type' WHEN r = 2 THEN 'boundary' ELSE 'overlap' END AS category FROM j
UNION ALL SELECT pl, 'false_positive' FROM p WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.doc = p.doc AND greatest(g.start_char, ps) < least(g.end_char, pe)))"""


def _compared(s, d):
    """Draft dates and document numbers against the rules' spans."""
    g = parquet(s, d, "lab4_gold_ie_draft").where("field_type IN ('DATE', 'DOC_ID') AND text IS NOT NULL AND start_char >= 0").select(F.col("text_id").alias("doc"), "text", "start_char", "end_char", F.col("field_type").alias("label")).distinct()
    t = g.select("doc", "text").distinct()
    dates = _trimmed(t.select("doc", F.inline(R.dates("text")))).select("doc", "start_char", "end_char", F.lit("DATE").alias("label"))
    ids = t.select("doc", F.inline(R.document_ids("text"))).select("doc", "start_char", "end_char", F.lit("DOC_ID").alias("label"))
    return metrics.span_comparison(g.drop("text"), dates.unionByName(ids))


@query(f"SELECT category, count(*) AS n FROM {_COMPARED} GROUP BY category")
def v12_span_comparison(s, d):
    """The comparison by category."""
    return _compared(s, d).groupBy("category").agg(F.count("*").alias("n"))


@query(f"""SELECT *, round(coalesce(correct / nullif(correct + false_positive, 0), 0.0), 4) AS rough_precision, round(coalesce(correct / nullif(correct + missed, 0), 0.0), 4) AS rough_recall FROM
(SELECT label, sum((category = 'exact')::INT)::BIGINT AS correct, sum((category = 'missed')::INT)::BIGINT AS missed, sum((category = 'false_positive')::INT)::BIGINT AS false_positive FROM {_COMPARED} GROUP BY label)""")
def a9_entity_counts(s, d):
    """Correct, missed and false spans of each label, with rough precision and recall."""
    return evaluation.entity_counts(_compared(s, d))


@query(f"""WITH g AS (SELECT DISTINCT doc, start_char, end_char, label FROM {_GOLD}) SELECT label, pl AS rule, count(*) AS n FROM g JOIN {_PREDICTED} p ON g.doc = p.doc AND greatest(g.start_char, ps) < least(g.end_char, pe) GROUP BY ALL""")
def j8_span_overlap(s, d):
    """Draft spans that a rule's span of the same text overlaps."""
    g = parquet(s, d, "lab4_gold_ie_draft").where("field_type IN ('DATE', 'DOC_ID') AND text IS NOT NULL AND start_char >= 0").select(F.col("text_id").alias("doc"), "text", "start_char", "end_char", F.col("field_type").alias("label")).distinct()
    t = g.select("doc", "text").distinct()
    dates = _trimmed(t.select("doc", F.inline(R.dates("text")))).select("doc", "start_char", "end_char", F.lit("DATE").alias("rule"))
    ids = t.select("doc", F.inline(R.document_ids("text"))).select("doc", "start_char", "end_char", F.lit("DOC_ID").alias("rule"))
    p = dates.unionByName(ids).distinct().withColumnsRenamed({"start_char": "ps", "end_char": "pe"})
    return g.drop("text").distinct().join(p, "doc").where("greatest(start_char, ps) < least(end_char, pe)").groupBy("label", "rule").agg(F.count("*").alias("n"))


@query(f"SELECT source, count(DISTINCT sentence_id) AS sentences, count(*) AS tokens, sum((upos = 'NUM')::INT)::BIGINT AS num, sum((upos = 'PROPN')::INT)::BIGINT AS propn, sum((upos = 'PUNCT')::INT)::BIGINT AS punct, sum((upos = 'X')::INT)::BIGINT AS x FROM {_SQL_TOKENS} GROUP BY source")
def a11_tag_counts(s, d):
    """Sentences, tokens and tags by source."""
    t = _tokens(s, d)
    tags = t.groupBy("source").pivot("upos", ["NUM", "PROPN", "PUNCT", "X"]).agg(F.count("token_id")).na.fill(0)
    n = t.groupBy("source").agg(F.count_distinct("sentence_id").alias("sentences"), F.count("*").alias("tokens"))
    return n.join(tags, n["source"].eqNullSafe(tags["source"])).select(n["source"], "sentences", "tokens", F.col("NUM").alias("num"), F.col("PROPN").alias("propn"), F.col("PUNCT").alias("punct"), F.col("X").alias("x"))


_TAGS = f"(SELECT sentence_id AS doc, list(upos ORDER BY token_id) AS t FROM {_SQL_TOKENS} GROUP BY sentence_id)"


@query(f"""SELECT term, count(*) AS n, count(DISTINCT doc) AS docs FROM (SELECT doc, unnest(list_concat(list_transform(range(1, len(t)), lambda i: t[i] || ' ' || t[i + 1]), list_transform(range(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2]), list_transform(range(1, len(t) - 2), lambda i: t[i] || ' ' || t[i + 1] || ' ' || t[i + 2] || ' ' || t[i + 3]))) AS term FROM {_TAGS}) GROUP BY term""")
def m2_tag_ngrams(s, d):
    """Runs of two to four tags."""
    t = _tokens(s, d).groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("token_id", "upos"))).alias("z")).select(F.col("sentence_id").alias("doc"), F.col("z.upos").alias("t"))
    return t.select("doc", F.explode(features.ngrams("t", 2, 4)).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.count_distinct("doc").alias("docs"))


@query(f"SELECT sentence_id, array_to_string(list(form ORDER BY token_id), ' ') AS forms, array_to_string(list(upos ORDER BY token_id), ' ') AS tags FROM {_SQL_TOKENS} GROUP BY sentence_id")
def m18_forms_and_tags(s, d):
    """Forms and tags out of nested tokens."""
    t = _tokens(s, d).groupBy("sentence_id").agg(F.array_sort(F.collect_list(F.struct("token_id", "form", "upos"))).alias("tokens"))
    return t.select("sentence_id", F.array_join(F.transform("tokens", lambda x: x["form"]), " ").alias("forms"), F.array_join(F.transform("tokens", lambda x: x["upos"]), " ").alias("tags"))


_GRAMS = "(SELECT DISTINCT word, known, substring(p, i, n) AS g FROM (SELECT word, known, p, n, unnest(range(1, greatest(length(p) - n + 1, 1) + 1)) AS i FROM (SELECT word, known, ' ' || w || ' ' AS p, unnest([3, 4, 5]) AS n FROM (SELECT canonical_name AS word, loc_id % 2 = 0 AS known, unnest(string_split(lower(canonical_name), ' ')) AS w FROM location_ref))))"


@query(f"SELECT word, CASE WHEN known THEN 'in_vocabulary' WHEN EXISTS (SELECT 1 FROM {_GRAMS} a JOIN {_GRAMS} b ON a.g = b.g WHERE a.word = x.word AND b.known) THEN 'oov_subword' ELSE 'oov' END AS status FROM (SELECT canonical_name AS word, loc_id % 2 = 0 AS known FROM location_ref) x")
def m11_word_status(s, d):
    """Whether a word has a vector, gets one from character n-grams it shares with others, or neither: names with an even number are known here, which is what is tested."""
    from ..operators import models

    names = parquet(s, d, "location_ref").select(F.col("canonical_name").alias("word"), "loc_id")
    known = names.where("loc_id % 2 = 0").select("word", F.array(F.col("loc_id").cast("float"), F.lit(1.0).cast("float")).alias("vector"))
    return models.subword_vectors(names, known).select("word", "status")


@query("""WITH q AS (SELECT * FROM embeddings WHERE vec_id % 100 = 0), p AS (SELECT q.vec_id AS query_id, e.vec_id AS id, round(list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS cosine FROM q JOIN embeddings e ON e.vec_id <> q.vec_id)
SELECT query_id, string_agg(id || ' (' || printf('%.3f', cosine) || ')', ', ' ORDER BY rank) AS neighbours FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY cosine DESC, id) AS rank FROM p) WHERE rank <= 3 GROUP BY query_id""")
def m13_neighbour_table(s, d):
    """The three nearest of each query as one string: a search, with the vectors whose id is divisible by 100 against all."""
    v = parquet(s, d, "embeddings")
    n = features.nearest(v, v.where("vec_id % 100 = 0"), 3).select("query_id", "rank", X.neighbour_string(F.col("id").cast("string"), "cosine").alias("shown"))
    return n.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "shown"))), lambda x: x["shown"]), ", ").alias("neighbours"))
