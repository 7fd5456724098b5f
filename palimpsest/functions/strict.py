"""Strict JSON: repeated keys at any depth, NaN and infinities, and text behind the value
are refused. What a reply must look like is then a chain of JVM expressions.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructType

#: The error codes of answers and decisions below.
PARSED = (
    StructType().add("valid", "boolean").add("keys", ArrayType(StringType()))
    .add("kinds", MapType(StringType(), StringType())).add("texts", MapType(StringType(), StringType()))
)


def refuse_constant(name: str) -> None:
    raise ValueError(f"{name} is no JSON number")


def whole_text(text: str) -> str:
    """The text with each lone surrogate, which JSON can name but no text can hold, as U+FFFD."""
    return text if text.isascii() else re.sub("[\ud800-\udfff]", "\ufffd", text)


def _closed(pairs: list[tuple[str, object]]) -> dict:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key repeats")
    return out


_DECODER = json.JSONDecoder(object_pairs_hook=_closed, parse_constant=refuse_constant)


def _kind(value: object) -> str:
    if isinstance(value, str):
        return "text" if value.strip() else "blank"
    if value is None or isinstance(value, bool):
        return "null" if value is None else "boolean"
    return {dict: "object", list: "array"}.get(type(value), "number")


def _parse(raw: str | None) -> tuple | None:
    if raw is None:
        return None, None, None, None
    try:
        value = _DECODER.decode(raw)
    except (ValueError, RecursionError):
        return False, None, None, None
    if not isinstance(value, dict):
        return True, None, None, None
    named = {whole_text(k): v for k, v in value.items()}
    return True, sorted(named), {k: _kind(v) for k, v in named.items()}, {k: whole_text(v) if isinstance(v, str) else json.dumps(v) for k, v in named.items()}


@F.pandas_udf(PARSED)
def parse_strict(raw: pd.Series) -> pd.DataFrame:
    """valid (null for null); of an object its sorted keys, and by key the kind of value
    (text, blank, null, boolean, number, object, array) and its text; a lone surrogate in it
    becomes U+FFFD."""
    return pd.DataFrame([_parse(r) for r in raw], columns=["valid", "keys", "kinds", "texts"])


def _keys(parsed: Column, *wanted: str) -> Column:
    return F.coalesce(parsed["keys"] == F.array(*[F.lit(w) for w in sorted(wanted)]), F.lit(False))


def answer_error(parsed: Column) -> Column:
    """Why a parsed reply is no answer `{"answer": text}`; null where it is one."""
    kind = parsed["kinds"]["answer"]
    return (
        F.when(parsed["valid"].isNull(), "no_content").when(~parsed["valid"], "not_json")
        .when(~_keys(parsed, "answer"), "wrong_fields").when(kind != "text", "blank_or_non_string_answer")
    )


def decision_error(parsed: Column, operations: Column) -> Column:
    """Why a parsed reply is no decision `{"operation": ..., "target_id": ...}` among the
    operations that are open; null where it is one. An update needs a target, all others
    must have none."""
    operation, target = parsed["texts"]["operation"], parsed["kinds"]["target_id"]
    is_open = (parsed["kinds"]["operation"] == "text") & F.array_contains(operations, operation)
    return (
        F.when(parsed["valid"].isNull(), "no_content").when(~parsed["valid"], "not_json")
        .when(~_keys(parsed, "operation", "target_id"), "wrong_fields").when(~is_open, "operation_not_available")
        .when((operation == "Update") & (target != "text"), "update_requires_nonempty_target_id")
        .when((operation != "Update") & (target != "null"), "target_id_must_be_null")
    )
