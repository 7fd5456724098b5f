"""Closed records: JSON held against a form at every depth, in the JVM by VARIANT.

A form is a dict (an object with exactly these members), a one-item list (an array of that
form), a set (one of these texts), or the name of a kind: text (a string that is not blank),
string, integer, number, boolean or any. optional() marks a member that may be absent,
nullable() a value that may be null.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

_FINDINGS = "array<struct<path:string,problem:string>>"
_KINDS = {"string": "^STRING", "text": "^STRING", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))", "number": "^(BIGINT|DECIMAL|DOUBLE|FLOAT)", "boolean": "^BOOLEAN", "any": ""}


class optional(NamedTuple):  # noqa: N801
    form: object


class nullable(NamedTuple):  # noqa: N801
    form: object


def _one(path: Column, problem: str) -> Column:
    return F.array(F.struct(path.alias("path"), F.lit(problem).alias("problem"))).cast(_FINDINGS)


def _walk(value: Column, form: object, path: Column) -> Column:
    none = F.array().cast(_FINDINGS)
    kind = F.schema_of_variant(value)
    if isinstance(form, nullable):
        return F.when(kind == "VOID", none).otherwise(_walk(value, form.form, path))
    if isinstance(form, dict):
        members = F.try_variant_get(value, "$", "map<string,variant>")
        keys = F.map_keys(members)
        must = F.array(*[F.lit(n) for n, f in form.items() if not isinstance(f, optional)]).cast("array<string>")
        under = lambda name: F.concat(path, F.lit("."), name)
        named = lambda names, problem: F.transform(names, lambda n: F.struct(under(n).alias("path"), F.lit(problem).alias("problem")))
        parts = [named(F.array_except(must, keys), "missing"), named(F.array_except(keys, F.array(*[F.lit(n) for n in form]).cast("array<string>")), "unexpected")]
        for name, inner in form.items():
            inner = inner.form if isinstance(inner, optional) else inner
            if inner != "any":
                parts.append(F.when(F.map_contains_key(members, F.lit(name)), _walk(F.try_element_at(members, F.lit(name)), inner, under(F.lit(name)))).otherwise(none))
        return F.when(kind.startswith("OBJECT"), F.flatten(F.array(*parts))).otherwise(_one(path, "no object"))
    if isinstance(form, list):
        items = F.try_variant_get(value, "$", "array<variant>")
        each = F.flatten(F.transform(items, lambda x, i: _walk(x, form[0], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))))
        return F.when(kind.startswith("ARRAY"), each).otherwise(_one(path, "no array"))
    text = F.try_variant_get(value, "$", "string")
    if isinstance(form, (set, frozenset)):
        fits, problem = (kind == "STRING") & text.isin(*sorted(form)), "not one of the values"
    else:
        fits, problem = kind.rlike(_KINDS[form]), f"no {form}"
        if form == "text":
            fits = fits & text.rlike("\\S")
    return F.when(F.coalesce(fits, F.lit(False)), none).otherwise(_one(path, problem))


def record_findings(raw: Column, form: object) -> Column:
    """(path, problem) of everything in a JSON text that its form does not allow, or misses:
    missing, unexpected, no object, no array, no <kind>, not one of the values; at $ "no json"
    for what cannot be read (a member that repeats too) and for null."""
    value = F.try_parse_json(raw)
    return F.when(value.isNull(), _one(F.lit("$"), "no json")).otherwise(_walk(value, form, F.lit("$")))
