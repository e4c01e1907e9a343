"""Schema validation of JSON objects, bounded repair, and checks of token output: constraint columns, no per-row code."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A field of an object: its JSON type (string, number, boolean, array, object), and what else it must satisfy."""

    name: str
    type: str
    nullable: bool = False
    required: bool = True
    enum: tuple[str, ...] = ()
    minimum: float | None = None
    items: str | None = None
    unique: bool = False


_TYPES = {"string": "STRING", "number": "(BIGINT|DECIMAL.*|DOUBLE|FLOAT|INT)", "boolean": "BOOLEAN", "array": "ARRAY<.*>", "object": "(OBJECT|STRUCT)<.*>"}
_ERROR = "STRUCT<path: STRING, type: STRING, message: STRING>"


def _below(limit: float):
    return lambda x: x.try_cast("double") < limit


def unfenced(raw: Column | str) -> Column:
    """The JSON object inside a fenced or wordy answer: from the first brace to the last."""
    c = F.col(raw) if isinstance(raw, str) else raw
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


def validate(raw: Column | str, rules: tuple[Rule, ...], extra_allowed: bool = False) -> Column:
    """struct(parse_ok, schema_ok, error_type, errors): errors sorted by path; the type of the first of missing, wrong type, extra field, other that occurs, `parse` if the text is no JSON object."""
    c = F.col(raw) if isinstance(raw, str) else raw
    # the JSON reader stops after the first value; words after an object make the whole text no JSON
    whole = ~c.rlike(r"(?s)^\s*\{") | c.rlike(r"(?s)\}\s*$")
    v = F.when(whole, F.try_parse_json(c))
    kind = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    is_object = kind.rlike("^(OBJECT|STRUCT)<")
    text = F.when(is_object, c)
    keys = F.json_object_keys(text)
    err = lambda path, t, msg: F.struct(F.lit(path).alias("path"), F.lit(t).alias("type"), F.lit(msg).alias("message"))
    checks = []
    for r in rules:
        sub = F.try_variant_get(v, f"$.{r.name}", "variant")
        t = F.coalesce(F.schema_of_variant(sub), F.lit("VOID"))
        present, null = F.array_contains(keys, r.name), (t == "VOID")
        if r.required:
            checks.append(F.when(~present, err(r.name, "missing", "required")))
        ok = t.rlike(f"^{_TYPES[r.type]}$") | (null if r.nullable else F.lit(False))
        checks.append(F.when(present & ~ok, err(r.name, "wrong_type", r.type)))
        value = F.get_json_object(c, f"$.{r.name}")
        if r.enum:
            checks.append(F.when(present & ok & ~null & ~value.isin(*r.enum), err(r.name, "other", "enum")))
        if r.minimum is not None and r.type == "number":
            checks.append(F.when(present & ok & (value.try_cast("double") < r.minimum), err(r.name, "other", "minimum")))
        if r.type == "array":
            arr = F.from_json(value, "array<string>")
            if r.items == "number":
                checks.append(F.when(present & ok & ~null & F.exists(arr, lambda x: x.try_cast("double").isNull()), err(r.name, "wrong_type", "items")))
            if r.minimum is not None:
                checks.append(F.when(present & ok & ~null & F.exists(arr, _below(r.minimum)), err(r.name, "other", "minimum")))
            if r.unique:
                checks.append(F.when(present & ok & ~null & (F.size(F.array_distinct(arr)) < F.size(arr)), err(r.name, "other", "unique")))
    known = F.array(*[F.lit(r.name) for r in rules])
    extra = F.array().cast(f"array<{_ERROR}>") if extra_allowed else F.transform(F.array_except(keys, known), lambda k: F.struct(k.alias("path"), F.lit("extra").alias("type"), F.lit("unexpected").alias("message")))
    found = F.array_sort(F.concat(F.array_compact(F.array(*checks)).cast(f"array<{_ERROR}>"), F.coalesce(extra, F.array().cast(f"array<{_ERROR}>"))))
    errors = F.when(is_object, found).otherwise(F.array(err("$", "parse", "not a JSON object")))
    types = F.transform(errors, lambda e: e["type"])
    order = F.coalesce(*[F.when(F.array_contains(types, t), F.lit(t)) for t in ("parse", "missing", "wrong_type", "extra", "other")])
    return F.struct(v.isNotNull().alias("parse_ok"), (F.size(errors) == 0).alias("schema_ok"), order.alias("error_type"), errors.alias("errors"))


def repaired(raw: Column | str, rules: tuple[Rule, ...], fallback: Column, rounds: int = 2) -> Column:
    """struct(final, repairs_used): up to `rounds` repairs of an invalid answer: first the object inside it, then the fallback."""
    c = F.col(raw) if isinstance(raw, str) else raw
    ok = lambda x: validate(x, rules)["schema_ok"]
    first = unfenced(c)
    if rounds <= 0:
        return F.struct(c.alias("final"), F.lit(0).alias("repairs_used"))
    if rounds == 1:
        return F.struct(F.when(ok(c), c).otherwise(fallback).alias("final"), F.when(ok(c), 0).otherwise(1).alias("repairs_used"))
    return F.struct(F.when(ok(c), c).when(F.coalesce(ok(first), F.lit(False)), first).otherwise(fallback).alias("final"), F.when(ok(c), 0).when(F.coalesce(ok(first), F.lit(False)), 1).otherwise(2).alias("repairs_used"))


# The universal part-of-speech tags.
UPOS = ("ADJ", "ADP", "ADV", "AUX", "CCONJ", "DET", "INTJ", "NOUN", "NUM", "PART", "PRON", "PROPN", "PUNCT", "SCONJ", "SYM", "VERB", "X")


def invalid_tokens(tokens: Column | str) -> Column:
    """The tokens (structs with form and upos) without a form or with a tag outside the universal set."""
    c = F.col(tokens) if isinstance(tokens, str) else tokens
    return F.filter(c, lambda t: t["form"].isNull() | (t["form"] == "") | t["upos"].isNull() | ~t["upos"].isin(*UPOS))
