"""Closed records, rewriting by path and canonical JSON against plain Python."""

import json
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.nested import canonical_json, json_number, rewrite
from palimpsest.functions.records import nullable, optional, record_findings

FORM = {"id": "integer", "kind": {"a", "b"}, "note": optional(nullable("text")), "turns": [{"role": {"user"}, "text": "text", "marks": ["number"]}], "free": "any"}
GOOD = {"id": 1, "kind": "a", "note": None, "turns": [{"role": "user", "text": "x", "marks": [1, 2.5]}], "free": {"x": [1]}}


@pytest.mark.parametrize(
    ("change", "wanted"),
    [
        ({}, []), ({"id": "1"}, ["$.id: no integer"]), ({"id": 1.5}, ["$.id: no integer"]), ({"kind": "c"}, ["$.kind: not one of the values"]), ({"kind": 1}, ["$.kind: not one of the values"]),
        ({"note": " "}, ["$.note: no text"]), ({"more": 1, "x": 2}, ["$.more: unexpected", "$.x: unexpected"]), ({"turns": {}}, ["$.turns: no array"]), ({"turns": []}, []), ({"turns": None}, ["$.turns: no array"]),
        ({"turns": [1, {"role": "user", "text": "", "marks": [True, 1, "2"]}, {"role": "user"}]}, ["$.turns[0]: no object", "$.turns[1].text: no text", "$.turns[1].marks[0]: no number", "$.turns[1].marks[2]: no number", "$.turns[2].text: missing", "$.turns[2].marks: missing"]),
        ("[1]", ["$: no object"]), ("null", ["$: no object"]), ('{"id": 1, "id": 2}', ["$: no json"]), ("{", ["$: no json"]), (None, ["$: no json"]),
    ],
)
def test_records(spark, change, wanted):
    raw = json.dumps(GOOD | change) if isinstance(change, dict) else change
    found = spark.createDataFrame([(raw,)], "r string").select(record_findings(F.col("r"), FORM).alias("f")).first().f
    assert sorted(f"{f.path}: {f.problem}" for f in found) == sorted(wanted)


def test_numbers_are_written_as_python_does(spark):
    rng = random.Random(1)
    numbers = [0.0, -0.0, 1.0, 100.0, 0.1, 1e15, 1e16, 123456789012345680.0, 1e-4, 1e-5, 9.999e-5, 1e22, 1e23, 5e-324, 1.7976931348623157e308, 2.0e-3, 4.35, 0.3, 2 / 3, 9007199254740993.0, None]
    numbers += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(300)] + [round(rng.uniform(-1e4, 1e4), rng.randint(0, 6)) for _ in range(300)]
    numbers = [n for n in numbers if n is None or math.isfinite(n)]
    got = spark.createDataFrame(list(enumerate(numbers)), "k int, x double").select("k", json_number(F.col("x")).alias("s")).collect()
    assert {r.k: r.s for r in got} == {k: None if n is None else repr(n) for k, n in enumerate(numbers)}
    with pytest.raises(Exception, match="not finite"):
        spark.createDataFrame([(math.inf,)], "x double").select(json_number(F.col("x"))).collect()


def test_a_number_is_worked_out_once(spark):
    df = spark.createDataFrame([([1.5, 0.1 + 0.2, 1e300, 2.0e-3, -12345678.25],)], "x array<double>")
    made = df.select(F.array_join(F.transform("x", json_number), " ").alias("s"))
    assert made._jdf.queryExecution().analyzed().toString().count("format_string") < 50  # each use within a lambda is a call of its own
    assert made.first().s == "1.5 0.30000000000000004 1e+300 0.002 -12345678.25"


SCHEMA = "z string, a struct<y:double,b:array<struct<q:string,c:bigint>>>, m map<string,boolean>, n array<array<float>>"


def test_canonical_bytes(spark):
    rows = [
        ('é"\\\n\t\x01\x1f\x7f/ﬁ😀\\u000b', (1.5, [("x", 1), None, (None, None)]), {"b": True, "a": None}, [[0.5], [], None]), (None, None, None, None), ("", (None, []), {}, []), ("\x0b\b\f\r", (1e300, None), {"é": False, '"': True}, None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    got = [r.j for r in df.coalesce(1).select(canonical_json(F.struct("*"), df.schema).alias("j")).collect()]

    def plain(row):
        z, a, m, n = row
        a = a and {"y": a[0], "b": a[1] and [x and {"q": x[0], "c": x[1]} for x in a[1]] if a[1] is not None else None}
        return {"z": z, "a": a, "m": m, "n": n}

    assert got == [json.dumps(plain(r), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for r in rows]


def test_rewriting_by_path(spark):
    df = spark.createDataFrame([(1, [("u", "secret", 3), None]), (2, None)], "id int, turns array<struct<role:string,text:string,n:int>>")
    whole = rewrite(F.struct("*"), df.schema, drop=("turns[].text",), rename={"turns[].n": "count", "turns": "said"}, replace={"turns[].role": F.upper})
    got = [r.asDict(recursive=True) for r in df.coalesce(1).select(whole.alias("w")).select("w.*").collect()]
    assert got == [{"id": 1, "said": [{"role": "U", "count": 3}, None]}, {"id": 2, "said": None}]
