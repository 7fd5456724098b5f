"""Evidence files: canonical JSON lines in partitions, checksum manifests, and reads that
trust only what a manifest vouches for. Nothing that exists is ever written over.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions.nested import canonical_json
from palimpsest.functions.strict import refuse_constant, whole_text


def canonical(*columns: str) -> Column:
    """Compact JSON of flat columns by name, nulls included (nested ones: canonical_json)."""
    return F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})


def publish(df: DataFrame, path: str, *by: str) -> None:
    """Write df's other columns as canonical JSON lines (members sorted at every depth), a
    folder for each value of `by`. Fails where the path exists."""
    rest = [c for c in df.columns if c not in by]
    whole = F.struct(*rest)
    df.select(*by, canonical_json(whole, df.select(whole.alias("r")).schema["r"].dataType).alias("value")).write.mode("errorifexists").partitionBy(*by).text(path)


def relative_path(spark: SparkSession, root: str, name: Column) -> Column:
    """A file's path below root; root may be given with or without a scheme."""
    at = spark._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath().rstrip("/")
    return F.substring(F.regexp_replace(name, "^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", ""), F.lit(len(at) + 2), F.char_length(name))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file under a folder, at any depth; paths are relative to it.
    A file is hashed in one task, which Spark allows up to 2 GB."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(relative_path(spark, path, F.col("path")).alias("path"), F.sha2("content", 256).alias("sha256"))


def write_manifest(spark: SparkSession, path: str, to: str) -> None:
    """Lines `sha256  path` in the order of paths. Fails where `to` exists."""
    lines = checksums(spark, path).orderBy("path").select(F.concat_ws("  ", "sha256", "path").alias("value"))
    lines.write.mode("errorifexists").text(to)


def manifest(lines: DataFrame) -> DataFrame:
    """(path, sha256, problem) of manifest lines (value): malformed, unsafe (absolute, going
    up, or with a backslash), repeated, or null."""
    form = "^([0-9a-f]{64})  (.+)$"
    out = lines.select(F.regexp_extract("value", form, 2).alias("path"), F.regexp_extract("value", form, 1).alias("sha256"))
    unsafe = F.col("path").rlike("^/|\\\\|(^|/)\\.\\.(/|$)")
    again = F.count("*").over(Window.partitionBy("path")) > 1
    return out.withColumn("problem", F.when(F.col("path") == "", "malformed").when(unsafe, "unsafe").when(again, "repeated"))


def compare(expected: DataFrame, actual: DataFrame, key: str = "path", value: str = "sha256") -> DataFrame:
    """(key, status): verified, changed, missing (expected alone) or unlisted (there alone)."""
    both = expected.select(key, F.col(value).alias("_want")).join(actual.select(key, F.col(value).alias("_have")), key, "full")
    status = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "unlisted")
    return both.select(key, status.when(F.col("_want") == F.col("_have"), "verified").otherwise("changed").alias("status"))


def verify(spark: SparkSession, path: str, listed: str) -> DataFrame:
    """compare() of a manifest with the folder that it lists."""
    return compare(manifest(spark.read.text(listed)).filter("problem is null"), checksums(spark, path))


def verified_rows(spark: SparkSession, path: str, listed: str, schema: str) -> DataFrame:
    """Rows of publish()'s files whose hash the manifest vouches for. A file that rows come
    from but that the folder's listing does not know fails the query: no row is lost by
    its name alone."""
    # the reader gives a file's address with its special characters encoded, once
    address = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    rows = spark.read.text(path).withColumn("path", relative_path(spark, path, address))
    status = F.coalesce("status", F.raise_error(F.concat(F.lit("no such file is listed: "), F.col("path"))).cast("string"))
    rows = rows.join(verify(spark, path, listed), "path", "left").filter(status == "verified")
    by = [c for c in rows.columns if c not in ("value", "path", "status")]
    return rows.select(*by, F.from_json("value", schema).alias("r")).select(*by, "r.*")


def complete_only(rows: DataFrame, planned: DataFrame, *key: str) -> DataFrame:
    """Rows of the keys that have as many rows as planned (key, planned)."""
    full = rows.groupBy(*key).agg(F.count("*").alias("_n")).join(planned, list(key)).filter("_n = planned")
    return rows.join(full.select(*key), list(key), "left_semi")


def redact(raw: Column, keys: tuple[str, ...], secrets: tuple[str, ...]) -> Column:
    """JSON without the members of these names at any depth, and with the secrets replaced in
    its strings and in its members' names; canonical. What is no JSON becomes null, so that
    nothing leaks; NaN and infinities are none. A lone surrogate becomes U+FFFD."""

    def hide(text: str) -> str:
        for s in secrets:
            text = text.replace(s, "[REDACTED]")
        return text

    def clean(value):
        if isinstance(value, dict):
            return {hide(k): clean(v) for k, v in value.items() if k.lower() not in keys}
        if isinstance(value, list):
            return [clean(v) for v in value]
        return hide(value) if isinstance(value, str) else value

    def one(text: str) -> str | None:
        try:
            value = clean(json.loads(text, parse_constant=refuse_constant))
            return whole_text(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False))
        except (ValueError, RecursionError):
            return None

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(one, na_action="ignore")

    return run(raw)
