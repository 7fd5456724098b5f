"""Nested values by path: members dropped, renamed or replaced at any depth, and canonical
JSON of any nested value, as column code made from its schema. Everything stays in the JVM.

A path names members, joined by dots, and [] for the items of an array: `messages[].content`.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, MapType, NullType, StringType, StructType, TimestampNTZType, TimestampType


def rewrite(value: Column, schema: DataType, drop: tuple[str, ...] = (), rename: Mapping[str, str] | None = None, replace: Mapping[str, Callable[[Column], Column]] | None = None, path: str = "") -> Column:
    """The value with the members at `drop` left out, those at `rename` named anew and those at
    `replace` given to a function. Nulls stay null, members keep their order."""
    rename, replace = rename or {}, replace or {}
    if path in replace:
        return replace[path](value)
    go = lambda v, kind, at: rewrite(v, kind, drop, rename, replace, at)
    if isinstance(schema, ArrayType):
        return F.transform(value, lambda x: go(x, schema.elementType, f"{path}[]"))
    if isinstance(schema, StructType):
        at = {f.name: f"{path}.{f.name}" if path else f.name for f in schema}
        members = [go(value[f.name], f.dataType, at[f.name]).alias(rename.get(at[f.name], f.name)) for f in schema if at[f.name] not in drop]
        return F.when(value.isNotNull(), F.struct(*members))
    return value


#: Characters that a JSON string escapes by name.
_NAMED = {"\\": "\\\\", '"': '\\"', "\n": "\\n", "\r": "\\r", "\t": "\\t", "\b": "\\b", "\f": "\\f"}


def json_string(text: Column) -> Column:
    """A JSON string: what must be escaped is, nothing else."""
    plain = text
    for c, to in _NAMED.items():
        plain = F.replace(plain, F.lit(c), F.lit(to))
    rare = plain
    for code in [*range(8), 11, *range(14, 32)]:
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    body = F.when(text.rlike("[\\x00-\\x07\\x0B\\x0E-\\x1F]"), rare).when(text.rlike('[\\\\"\\x08-\\x0D]'), plain).otherwise(text)
    return F.concat(F.lit('"'), body, F.lit('"'))


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with the value computed once, however often it is used: inside a lambda
    Spark computes each use anew."""
    return F.transform(F.array(value), then)[0]


def json_number(x: Column) -> Column:
    """The shortest decimal that reads back as the same double: plain for exponents from -4 to
    15, else with an exponent of two digits or more. What is not finite is no JSON: an error.

    Java's text of a double reads back, but may have a digit too many. Decimals of 15 digits
    never share a double, so one of no more digits is the only one, and the shortest."""
    short = lambda t: (F.char_length(t) <= 16) & ~t.contains("E") & (t.endswith(".0") | ~t.endswith("0"))
    said = _let(x.cast("string"), lambda t: F.when(short(t), t).otherwise(_let(_shortest(x), _spelt)))
    finite = F.abs(x) < float("inf")
    return F.when(x.isNull(), F.lit(None)).when(finite, said).otherwise(F.raise_error(F.lit("a number is not finite")).cast("string"))


def _shortest(x: Column) -> Column:
    """The shortest decimal in scientific form, perhaps with zeros at its end. Of 15 digits
    or fewer there is one at most, which 15 digits show; doubles near 0 hold fewer."""
    tried = [F.format_string(f"%.{p}e", x) for p in range(17)]
    first = lambda some: F.coalesce(*[F.when(t.cast("double") == x, t) for t in some], tried[-1])
    return F.when(F.abs(x) < 2.2250738585072014e-308, first(tried[:-1])).otherwise(first(tried[14:-1]))


def _spelt(shortest: Column) -> Column:
    digits = F.rtrim(F.replace(F.ltrim(F.substring_index(shortest, "e", 1), F.lit("-")), F.lit("."), F.lit("")), F.lit("0"))
    parts = F.struct(F.when(digits == "", "0").otherwise(digits).alias("digits"), F.substring_index(shortest, "e", -1).cast("int").alias("exponent"), F.when(shortest.startswith("-"), "-").otherwise("").alias("sign"))
    return _let(parts, lambda p: _placed(p["sign"], p["digits"], p["exponent"]))


def _placed(sign: Column, digits: Column, exponent: Column) -> Column:
    n = F.char_length(digits)
    whole = F.concat(F.rpad(F.substring(digits, F.lit(1), exponent + 1), exponent + 1, F.lit("0")), F.lit("."), F.when(n > exponent + 1, F.substring(digits, exponent + 2, n)).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), n))).otherwise(""))
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), F.greatest(F.lit(2), F.char_length(F.abs(exponent).cast("string"))), F.lit("0")))
    return F.concat(sign, F.when((exponent >= 0) & (exponent < 16), whole).when((exponent < 0) & (exponent >= -4), small).otherwise(scientific))


def canonical_json(value: Column, schema: DataType) -> Column:
    """Compact JSON with the members of every object in the order of their names, nulls
    included and characters as they are; null for a null value at the top alone."""
    return F.when(value.isNotNull(), _canonical(value, schema))


def _canonical(value: Column, schema: DataType) -> Column:
    null = lambda made: F.coalesce(made, F.lit("null"))
    if isinstance(schema, StructType):
        members = [F.concat(json_string(F.lit(f.name)), F.lit(":"), _canonical(value[f.name], f.dataType)) for f in sorted(schema, key=lambda f: f.name)]
        return null(F.when(value.isNotNull(), F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}"))))
    if isinstance(schema, ArrayType):
        return null(F.concat(F.lit("["), F.array_join(F.transform(value, lambda x: _canonical(x, schema.elementType)), ","), F.lit("]")))
    if isinstance(schema, MapType):
        entries = F.transform(F.array_sort(F.map_keys(value)), lambda k: F.concat(json_string(k), F.lit(":"), _canonical(F.try_element_at(value, k), schema.valueType)))
        return null(F.concat(F.lit("{"), F.array_join(entries, ","), F.lit("}")))
    if isinstance(schema, StringType):
        return null(json_string(value))
    if isinstance(schema, (DoubleType, FloatType)):
        return null(json_number(value.cast("double")))
    if isinstance(schema, (IntegralType, BooleanType, DecimalType)):
        return null(value.cast("string"))
    if isinstance(schema, (DateType, TimestampType, TimestampNTZType)):  # as texts, in the session's zone
        return null(json_string(value.cast("string")))
    if isinstance(schema, NullType):
        return F.lit("null")
    raise TypeError(f"{schema.simpleString()} has no JSON form")
