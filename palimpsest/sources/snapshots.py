"""Atomic replacement of a table: versions in folders of their own, one commit at a time.

A version is written under a fresh name, which nobody reads, and then named by a commit file
that is made under the next number and never written over. The last whole commit is the
table, so a reader sees the old version or the new one, and a writer that fails, at
whatever point, leaves the table as it was. Of two writers of one number one is refused.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from py4j.protocol import Py4JJavaError


#: What a whole commit ends with.
END = " committed"


class Conflict(Exception):
    """Another writer has committed first."""


def _files(spark: SparkSession, path: str):
    made = spark._jvm.org.apache.hadoop.fs.Path(path)
    return made.getFileSystem(spark._jsc.hadoopConfiguration()), made


def commits(spark: SparkSession, base: str) -> dict[int, str]:
    """Folder by number of every whole commit (a commit that breaks off lacks its END)."""
    fs, at = _files(spark, f"{base}/_commits")
    if not fs.exists(at):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(at)]
    if not (known := [n for n in names if n.isdecimal()]):
        return {}
    lines = spark.read.text([f"{base}/_commits/{n}" for n in known])
    rows = lines.selectExpr("value", "element_at(split(_metadata.file_path, '/'), -1) AS n").collect()
    return {int(r.n): r.value.removesuffix(END) for r in rows if r.value.endswith(END)}


def last(spark: SparkSession, base: str) -> int:
    """Number of the last whole commit, 0 where there is none."""
    return max(commits(spark, base), default=0)


def _commit(spark: SparkSession, base: str, number: int, folder: str) -> None:
    fs, at = _files(spark, f"{base}/_commits/{number:012d}")
    try:
        out = fs.create(at, False)
    except Py4JJavaError as failed:
        if "AlreadyExists" in failed.java_exception.getClass().getName():
            raise Conflict(f"commit {number} is taken") from failed
        raise
    out.write(bytearray(f"{folder}{END}", "utf-8"))
    out.close()


def replace(df: DataFrame, base: str, expected: int | None = None, check: Callable[[], None] | None = None) -> int:
    """Make df the table at base and return its number. expected: the number that df was made
    from; where another is the last one by now, nothing is committed and Conflict is
    raised. check: called when the version is written, before it is committed; what it
    raises leaves the table as it was, and the version's files are removed."""
    spark, folder = df.sparkSession, f"data-{uuid.uuid4().hex}"
    made_from = last(spark, base) if expected is None else expected
    try:
        df.write.mode("errorifexists").parquet(f"{base}/{folder}")
        if check:
            check()
        if last(spark, base) != made_from:
            raise Conflict(f"{base} is no longer at commit {made_from}")
        # a number that a broken commit holds is passed over
        fs, at = _files(spark, f"{base}/_commits")
        taken = [int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdecimal()] if fs.exists(at) else []
        _commit(spark, base, max([made_from, *taken]) + 1, folder)
    except BaseException:
        fs, at = _files(spark, f"{base}/{folder}")
        fs.delete(at, True)
        raise
    return last(spark, base)


def read(spark: SparkSession, base: str, number: int | None = None) -> DataFrame:
    """The table, or an earlier version of it. A reader keeps the version that it began with."""
    known = commits(spark, base)
    if not known:
        raise FileNotFoundError(f"nothing is committed at {base}")
    return spark.read.parquet(f"{base}/{known[max(known) if number is None else number]}")


def drop_old(spark: SparkSession, base: str, keep: int = 2) -> list[int]:
    """Remove the files of all but the last `keep` versions; their numbers. What is not
    committed yet is left alone."""
    known = commits(spark, base)
    gone = sorted(known)[:-keep] if keep else sorted(known)
    for n in gone:
        fs, at = _files(spark, f"{base}/{known[n]}")
        fs.delete(at, True)
    return gone
