"""All matches of a pattern with their offsets, and rule-based extraction built on them, in built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import c

SPAN = "STRUCT<start_char: INT, end_char: INT, value: STRING, label: STRING>"
# Months and document words of the extraction rules, and their date, number and money patterns.
MONTHS = ("січня", "лютого", "березня", "квітня", "травня", "червня", "липня", "серпня", "вересня", "жовтня", "листопада", "грудня")
DOCUMENT_WORDS = ("№", "номер", "повідомлення", "заява", "документ", "звернення", "рішення", "договір", "запит", "лист")
DATE_NUMERIC = r"(?U)\b(\d{1,2})[./-](\d{1,2})[./-](\d{4})\b"
DATE_TEXTUAL = r"(?iU)\b(\d{1,2})\s+(" + "|".join(MONTHS) + r")\s*(\d{4})?\b"
DOCUMENT_ID = r"(?iU)\b(?:" + "|".join(DOCUMENT_WORDS) + r")\s*№?\s*(\d{1,10})\b|№\s*(\d{1,10})\b"
MONEY = r"(?iU)(?<!\d)(\d[\d\s]*\s*грн|\d+грн|\d{1,3}(?:\s\d{3})+|\d+(?:-\d+))(?!\d)"
DATE_RANGE = r"(?iU)(?<!\d)(\d{1,2}(?:-\d{1,2})?\s+(?:" + "|".join(MONTHS) + r"))\b"
DATE_YEAR = r"(?U)(?<!\d)(\d{1,2}\.\d{1,2}\.\d{4})(?=(?:\s*р(?:оку|\.)?)?\b)"


def find(t: Column | str, pattern: str, label: str = "") -> Column:
    """ARRAY<span> of all matches in order, offsets in code points. The text must not hold U+0001 or U+0002."""
    marked = F.split(F.regexp_replace(F.coalesce(c(t), F.lit("")), pattern, "\u0001$0\u0002"), "[\u0001\u0002]", -1)
    # pieces alternate: outside, match, outside, ...
    folded = F.aggregate(
        F.transform(marked, lambda x, i: F.struct(x.alias("s"), (i % 2 == 1).alias("hit"))),
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["s"])).alias("at"),
            F.when(p["hit"], F.concat(a["out"], F.array(F.struct(a["at"].alias("start_char"), (a["at"] + F.length(p["s"])).alias("end_char"), p["s"].alias("value"), F.lit(label).alias("label"))))).otherwise(a["out"]).alias("out"),
        ),
        lambda a: a["out"],
    )
    return folded


def _number(v: Column) -> Column:
    """Digits as a number, full-width ones too."""
    return F.translate(v, "０１２３４５６７８９", "0123456789").try_cast("int")


def numeric_date(v: Column) -> Column:
    """d.m.yyyy as ISO text, NULL unless the day is 1 to 31 and the month 1 to 12."""
    d, m, y = (_number(F.regexp_extract(v, DATE_NUMERIC, i)) for i in (1, 2, 3))
    return F.when(d.between(1, 31) & m.between(1, 12), F.format_string("%04d-%02d-%02d", y, m, d))


def textual_date(v: Column) -> Column:
    """Day and month name as ISO text, NULL without a year."""
    months = F.create_map(*[x for i, m in enumerate(MONTHS) for x in (F.lit(m), F.lit(i + 1))])
    d, y = F.regexp_extract(v, DATE_TEXTUAL, 1), F.regexp_extract(v, DATE_TEXTUAL, 3)
    return F.when(y != "", F.format_string("%04d-%02d-%02d", _number(y), F.try_element_at(months, F.lower(F.regexp_extract(v, DATE_TEXTUAL, 2))), _number(d)))


def dates(t: Column | str) -> Column:
    """ARRAY<struct(start_char, end_char, value, parsed, method)>: numeric dates that are possible, then textual ones (kept as typed without a year)."""
    num = F.filter(F.transform(find(t, DATE_NUMERIC), lambda s: F.struct(s["start_char"], s["end_char"], s["value"], numeric_date(s["value"]).alias("parsed"), F.lit("numeric").alias("method"))), lambda s: s["parsed"].isNotNull())
    txt = F.transform(find(t, DATE_TEXTUAL), lambda s: F.struct(s["start_char"], s["end_char"], s["value"], textual_date(s["value"]).alias("parsed"), F.lit("textual").alias("method")))
    return F.concat(num, txt)


def document_ids(t: Column | str) -> Column:
    """ARRAY<struct(start_char, end_char, value, doc_id)>; four-digit numbers that begin with 20 are years, not ids."""
    got = F.transform(find(t, DOCUMENT_ID), lambda s: F.struct(s["start_char"], s["end_char"], s["value"], F.coalesce(F.nullif(F.regexp_extract(s["value"], DOCUMENT_ID, 1), F.lit("")), F.nullif(F.regexp_extract(s["value"], DOCUMENT_ID, 2), F.lit(""))).alias("doc_id")))
    return F.filter(got, lambda s: s["doc_id"].isNotNull() & ~s["doc_id"].rlike(r"^20\d\d$"))


def phrases(t: Column | str, rules: tuple[tuple[str, str], ...]) -> Column:
    """ARRAY<span> of whole-word phrases, letter case aside, by rule order."""
    quoted = lambda p: "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in p)
    return F.flatten(F.array(*[find(t, rf"(?iU)(?<!\w){quoted(p)}(?!\w)", label) for p, label in rules]))


def entities(t: Column | str, rules: tuple[tuple[str, str], ...] = ()) -> Column:
    """ARRAY<span> of date, money and phrase rules; money without a currency needs five characters."""
    money = F.filter(find(t, MONEY, "MONEY"), lambda s: F.lower(s["value"]).contains("грн") | (F.length(s["value"]) >= 5))
    out = F.concat(find(t, DATE_YEAR, "DATE"), find(t, DATE_RANGE, "DATE"), money)
    return F.concat(out, phrases(t, rules)) if rules else out


def overlaps(a: Column, b: Column) -> Column:
    return F.greatest(a["start_char"], b["start_char"]) < F.least(a["end_char"], b["end_char"])


def merge_rules(base: Column | str, rules: Column | str, replaceable: tuple[str, ...] = ("DATE", "MONEY", "DOMAIN", "LOC", "ORG")) -> Column:
    """Rule spans merged into base spans, in order: an equal span and label is skipped, the first overlapping base span of a replaceable label is replaced, anything else is appended; then duplicates are dropped and spans sorted."""
    labels = F.array(*[F.lit(x) for x in replaceable])

    def step(acc: Column, r: Column) -> Column:
        same = F.exists(acc, lambda s: (s["start_char"] == r["start_char"]) & (s["end_char"] == r["end_char"]) & (s["label"] == r["label"]))
        hit = F.array_position(F.transform(acc, lambda s: overlaps(s, r) & F.array_contains(labels, s["label"])), F.lit(True))
        return F.when(same, acc).when(hit > 0, F.transform(acc, lambda s, i: F.when(i + 1 == hit, r).otherwise(s))).otherwise(F.concat(acc, F.array(r)))

    return F.array_sort(F.array_distinct(F.aggregate(c(rules), c(base), step)))


def dictionary(t: Column | str, forms: tuple[tuple[str, str], ...]) -> Column:
    """ARRAY<span> of inflected forms of dictionary entries (entry, form), whole words in their letter case; the label is the entry."""
    by_entry: dict[str, list[str]] = {}
    for entry, form in forms:
        by_entry.setdefault(entry, []).append(form)
    quoted = lambda f: "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in f)
    return F.array_distinct(F.flatten(F.array(*[find(t, r"(?U)(?<!\w)(?:" + "|".join(quoted(f) for f in sorted(fs, key=len, reverse=True)) + r")(?!\w)", e) for e, fs in by_entry.items()])))


def amounts(t: Column | str) -> Column:
    """ARRAY<BIGINT> of sums before `грн`, thousands marked by `тис`, first seen first, each once; unreadable numbers are dropped."""
    got = F.regexp_extract_all(F.coalesce(c(t), F.lit("")), F.lit(r"(?iU)(\d[\d\s]*(?:\s*тис\.?)?)\s*грн"), 1)
    number = lambda x: F.regexp_replace(x, r"(?U)[^\d]", "").try_cast("bigint") * F.when(F.lower(x).contains("тис"), 1000).otherwise(1)
    return F.array_distinct(F.filter(F.transform(got, number), lambda x: x.isNotNull()))


def extracted(t: Column | str, places: tuple[tuple[str, str], ...] = ()) -> Column:
    """ARRAY<struct(start_char, end_char, value, field)>: dates, places and document numbers of a text in one list."""
    take = lambda arr, field: F.transform(arr, lambda s: F.struct(s["start_char"], s["end_char"], s["value"], F.lit(field).alias("field")))
    out = F.concat(take(dates(t), "DATE"), take(document_ids(t), "DOC_ID"))
    return F.concat(out, take(dictionary(t, places), "LOCATION")) if places else out
