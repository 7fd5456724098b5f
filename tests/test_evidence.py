"""Evidence files: what is changed, lost or added later is found; nothing is written over."""

import pathlib

import pytest
from pyspark.errors import AnalysisException

from palimpsest.sources import evidence
from palimpsest.sources.shared import fresh_folder


def test_tampering_is_found_and_not_read(spark):
    at = fresh_folder(spark, "evidence")
    rows = spark.createDataFrame([(k, v, None if v == 2 else f"t{v}") for k in "abc" for v in range(3)], "k string, v long, t string").coalesce(1)
    evidence.publish(rows, f"{at}/records", "k")
    with pytest.raises(AnalysisException):
        evidence.publish(rows, f"{at}/records", "k")
    evidence.write_manifest(spark, f"{at}/records", f"{at}/manifest")
    assert {r.status for r in evidence.verify(spark, f"{at}/records", f"{at}/manifest").collect()} == {"verified"}
    folder = pathlib.Path(at.removeprefix("file://")) / "records"
    one, two = next((folder / "k=a").glob("part-*")), next((folder / "k=b").glob("part-*"))
    one.with_name(f".{one.name}.crc").unlink()
    one.write_text('{"t":"x","v":9}\n')
    two.with_name("part-new").write_text("{}\n")
    two.unlink()
    found = {r.path.partition("/")[0] + r.status for r in evidence.verify(spark, f"{at}/records", f"{at}/manifest").collect()}
    assert found == {"k=achanged", "k=bmissing", "k=bunlisted", "k=cverified"}
    kept = evidence.verified_rows(spark, f"{at}/records", f"{at}/manifest", "v bigint, t string").collect()
    assert sorted((r.k, r.v, r.t) for r in kept) == [("c", 0, "t0"), ("c", 1, "t1"), ("c", 2, None)]


def test_canonical_keeps_nulls_and_sorts(spark):
    row = spark.createDataFrame([(1, None, "x")], "b int, a string, c string").select(evidence.canonical("b", "c", "a").alias("j")).first()
    assert row.j == '{"a":null,"b":1,"c":"x"}'


def test_no_row_is_lost_by_a_files_name(spark):
    at = fresh_folder(spark, "evi dence+x")
    rows = spark.createDataFrame([(k, n) for n, k in enumerate(["a b", "c", "d%e", "f+g", "records", "é", "x=y", None])], "k string, v long")
    evidence.publish(rows, f"{at}/records", "k")
    evidence.write_manifest(spark, f"{at}/records", f"{at}/manifest")
    assert {r.status for r in evidence.verify(spark, f"{at}/records", f"{at}/manifest").collect()} == {"verified"}
    for root in (f"{at}/records", f"{at}/records/", f"{at}/records".removeprefix("file://")):
        assert sorted(r.v for r in evidence.verified_rows(spark, root, f"{at}/manifest", "v bigint").collect()) == list(range(8))


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ('{"a": NaN, "sk-1": "sk-1"}', None), ('{"sk-1": "x sk-1"}', '{"[REDACTED]":"x [REDACTED]"}'), ('{"Key": 1, "b": [{"KEY": 2, "c": "\\ud800 é"}]}', '{"b":[{"c":"\ufffd é"}]}'),
        ("[" * 50_000, None), ("1e999", None), ("", None), ('"sk-1"', '"[REDACTED]"'), (None, None),
    ],
)
def test_redaction(spark, raw, wanted):
    from pyspark.sql import functions as F

    assert spark.createDataFrame([(raw,)], "r string").select(evidence.redact(F.col("r"), ("key",), ("sk-1",)).alias("x")).first().x == wanted


def test_nested_members_are_sorted_in_files(spark):
    from datetime import date

    at = fresh_folder(spark, "nested")
    rows = spark.createDataFrame([("k", [{"z": 1, "a": None}], date(2024, 1, 2), 2.0)], "k string, n array<struct<z:int,a:string>>, d date, f double")
    evidence.publish(rows, f"{at}/records", "k")
    assert [r.value for r in spark.read.text(f"{at}/records").collect()] == ['{"d":"2024-01-02","f":2.0,"n":[{"a":null,"z":1}]}']
