"""Fail-closed checks: rules as data, findings as rows, and sinks that keep nothing when one
fails.

A rule is a predicate that every row of a table must meet; a null does not meet it. All
rules of a table are held against it in one pass. In front of a sink the same rules are
counted while the rows are written, and the write is committed only if every count is 0.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.sources import snapshots


class Rule(NamedTuple):
    rule: str
    table: str
    predicate: str  # SQL over the table's columns
    severity: str = "fail"


class CheckFailed(Exception):
    """Rules that do not hold, with the number of rows that break each."""

    def __init__(self, broken: dict[str, object]):
        super().__init__(", ".join(f"{k}: {v}" for k, v in broken.items()))
        self.broken = broken


def _broken(predicate: str | Column) -> Column:
    return ~F.coalesce(F.expr(predicate) if isinstance(predicate, str) else predicate, F.lit(False))


def findings(tables: Mapping[str, DataFrame], rules: list[Rule], keys: Mapping[str, str]) -> DataFrame:
    """(table, key, rule, severity) of every row that breaks a rule: one pass a table. keys has
    the key column of each table; rules of tables that are not given are an error."""
    out = None
    for name in dict.fromkeys(r.table for r in rules):
        own = [F.when(_broken(r.predicate), F.struct(F.lit(r.rule).alias("rule"), F.lit(r.severity).alias("severity"))) for r in rules if r.table == name]
        hits = tables[name].select(F.col(keys[name]).cast("string").alias("key"), F.explode(F.array_compact(F.array(*own))).alias("f"))
        hits = hits.select(F.lit(name).alias("table"), "key", "f.rule", "f.severity")
        out = hits if out is None else out.unionByName(hits)
    if out is None:
        raise ValueError("no rules")
    return out


def require(df: DataFrame, **conditions: str | Column) -> DataFrame:
    """df, whose plan fails at the first row that breaks a condition, naming it."""
    for name, condition in conditions.items():
        message = F.lit(f"check failed: {name}")
        df = df.filter(F.when(_broken(condition), F.raise_error(message).cast("boolean")).otherwise(True))
    return df


def require_none(**violations: DataFrame) -> None:
    """Nothing if all are empty, else CheckFailed: the gate in front of a side effect. Each is
    read up to its first row."""
    first = None
    for name, df in violations.items():
        one = df.limit(1).select(F.lit(name).alias("name"))
        first = one if first is None else first.unionByName(one)
    if first is not None and (met := sorted(r.name for r in first.collect())):
        raise CheckFailed(dict.fromkeys(met, "not empty"))


def replace_checked(df: DataFrame, base: str, rows: Mapping[str, str | Column], totals: Mapping[str, tuple[Column, Callable[[object], bool]]] | None = None) -> int:
    """snapshots.replace, committed only if every row meets `rows` and each aggregate of
    `totals` its test. The counts are taken while the rows are written: no second pass."""
    seen, totals = Observation(), totals or {}
    counts = [F.count_if(_broken(c)).alias(f"row_{k}") for k, c in enumerate(rows.values())]
    counts += [c.alias(f"total_{k}") for k, (c, _) in enumerate(totals.values())]

    def check() -> None:
        got = seen.get
        broken = {n: got[f"row_{k}"] for k, n in enumerate(rows) if got[f"row_{k}"]}
        broken |= {n: got[f"total_{k}"] for k, (n, (_, holds)) in enumerate(totals.items()) if not holds(got[f"total_{k}"])}
        if broken:
            raise CheckFailed(broken)

    return snapshots.replace(df.observe(seen, *counts) if counts else df, base, check=check if counts else None)
