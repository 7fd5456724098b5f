"""Registration of queries with their SQL oracles."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Where the two dialects name a function differently: marker, Spark, oracle.
_DIALECT = (
    ("@ENTRY", "format_string('mem_%04d', ", "printf('mem_%04d', "),
    ("@ISO", "date_format(", "strftime("),
    ("@FMT", "\"yyyy-MM-dd'T'HH:mm:ss'Z'\"", "'%Y-%m-%dT%H:%M:%SZ'"),
    ("@SHA", "sha2(", "sha256("),
    ("@HEX", ", 256)", ")"),
    ("@G", "", ", 'g'"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sql(name: str, text: str) -> None:
    """Register one statement; {table} marks a table, @NAME a dialect's spelling."""
    ours, oracle = text, re.sub(r"\{(\w+)\}", r"\1", text)
    for mark, spark_form, oracle_form in _DIALECT:
        ours, oracle = ours.replace(mark, spark_form), oracle.replace(mark, oracle_form)
    names = sorted(set(re.findall(r"\{(\w+)\}", text)))
    QUERIES[name] = lambda spark, sf_dir: spark.sql(ours, **{n: table(spark, sf_dir, n) for n in names})
    ORACLES[name] = oracle


def query(oracle: str | None = None):
    """Decorator: register a function of (spark, sf_dir) under its own name."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add
