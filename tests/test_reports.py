"""Releases and protocols: nothing comes out that its audit or version does not stand for."""

import hashlib

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import evidence


def test_a_text_is_released_by_its_own_audit_alone(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    texts = spark.createDataFrame([(k, f"t{k}") for k in range(7)] + [(7, None)], "id int, text string")
    rows = [(0, sha("t0"), "ELIGIBLE", 0), (1, sha("t1 "), "ELIGIBLE", 0), (2, sha("t2"), "ELIGIBLE", 3), (3, sha("t3"), "REJECTED", 3), (4, sha("t4"), "ELIGIBLE", 0), (4, sha("t4"), "REJECTED", 3), (5, None, "ELIGIBLE", 0), (7, sha(""), "ELIGIBLE", 0)]
    audits = spark.createDataFrame(rows, "id int, text_sha256 string, verdict string, failures int")
    got = {r.id: (r.text, r.status) for r in evidence.release(texts, audits, "id", F.when(F.col("failures") == 0, "ELIGIBLE").otherwise("REJECTED")).collect()}
    assert got == {0: ("t0", "released"), 1: (None, "unbound"), 2: (None, "restated"), 3: (None, "REJECTED"), 4: (None, "repeated"), 5: (None, "unbound"), 6: (None, "no_audit"), 7: (None, "unbound")}


def test_an_unknown_version_fails(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "v string, n int")
    rules = {"a": F.col("n") + 1, "b": F.col("n") * 10}
    assert sorted(r.x for r in evidence.under_protocol(df, "v", rules, "x").collect()) == [2, 20]
    for odd in ("c", None):
        with pytest.raises(Exception, match="no protocol of version"):
            evidence.under_protocol(df.unionByName(spark.createDataFrame([(odd, 3)], df.schema)), "v", rules, "x").collect()


def test_denominators_say_what_they_leave_out(spark):
    df = spark.createDataFrame([("g", "new", "s"), ("g", "old", "s"), ("g", "old", "other"), ("g", None, "s"), ("h", "new", None), (None, "old", "s")], "g string, kind string, src string")
    got = {(r.g, r.measure): (r.n, r.left_out) for r in evidence.denominators(df, "g", "kind", "src", {"all": ("new", "old"), "old": ("old",)}, ("s",)).collect()}
    assert got == {("g", "all"): (2, 2), ("g", "old"): (1, 3), ("h", "all"): (0, 1), ("h", "old"): (0, 1)}
