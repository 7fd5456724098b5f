"""Snapshots, checks and closures: what fails leaves nothing behind, what changed is named."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import checks
from palimpsest.sources import closures, snapshots
from palimpsest.sources.shared import fresh_folder


def values(spark, base, number=None):
    return sorted(r.a for r in snapshots.read(spark, base, number).collect())


def test_a_reader_sees_the_old_table_or_the_new(spark):
    base, frame = fresh_folder(spark, "snap"), lambda *v: spark.createDataFrame([(x,) for x in v], "a int")
    with pytest.raises(FileNotFoundError):
        snapshots.read(spark, base)
    assert snapshots.replace(frame(1, 2), base) == 1
    old = snapshots.read(spark, base)
    failing = frame(3, 4).select(F.when(F.col("a") == 4, F.raise_error(F.lit("writer dies")).cast("int")).otherwise(F.col("a")).alias("a"))
    with pytest.raises(Exception, match="writer dies"):
        snapshots.replace(failing, base)
    folder = base.removeprefix("file://")
    assert values(spark, base) == [1, 2] and len([f for f in os.listdir(folder) if f.startswith("data")]) == 1
    assert snapshots.replace(frame(5), base, expected=1) == 2
    assert values(spark, base) == [5] and values(spark, base, 1) == [1, 2] and sorted(r.a for r in old.collect()) == [1, 2]
    with pytest.raises(snapshots.Conflict):
        snapshots.replace(frame(6), base, expected=1)  # made from a version that is no longer the last
    with open(f"{folder}/_commits/{3:012d}", "w") as broken:  # a writer that died while it committed
        broken.write("data-half")
    assert values(spark, base) == [5]
    with pytest.raises(snapshots.Conflict):
        snapshots._commit(spark, base, 2, "data-late")
    assert snapshots.replace(frame(7), base) == 4 and values(spark, base) == [7]
    assert snapshots.drop_old(spark, base, keep=1) == [1, 2] and values(spark, base) == [7]


def test_checks_gate_the_write(spark):
    base = fresh_folder(spark, "gate")
    rows = spark.createDataFrame([(1, "x"), (2, None), (-3, "y")], "a int, b string")
    with pytest.raises(checks.CheckFailed) as failed:
        checks.replace_checked(rows, base, {"positive": "a > 0", "named": F.col("b").isNotNull()}, {"many": (F.count("*"), lambda n: n > 5), "some": (F.count("*"), bool)})
    assert failed.value.broken == {"positive": 1, "named": 1, "many": 3} and not snapshots.commits(spark, base)
    assert not [f for f in os.listdir(base.removeprefix("file://")) if f.startswith("data")]
    assert checks.replace_checked(rows.filter("a = 1"), base, {"positive": "a > 0"}) == 1
    with pytest.raises(Exception, match="check failed: named"):
        checks.require(rows, named="b is not null").collect()
    assert checks.require(rows, whole="a < 5").count() == 3
    checks.require_none(a=rows.filter("a > 9"), b=rows.filter("a > 99"))
    with pytest.raises(checks.CheckFailed, match="negative"):
        checks.require_none(a=rows.filter("a > 9"), negative=rows.filter("a < 0"))


def test_rules_are_data(spark):
    rules = [checks.Rule("positive", "t", "a > 0"), checks.Rule("named", "t", "b <> ''", "review"), checks.Rule("never", "u", "false")]
    t = spark.createDataFrame([(1, "x"), (2, None), (None, "")], "a int, b string")
    u = spark.createDataFrame([(5,)], "k long")
    got = sorted(map(tuple, checks.findings({"t": t, "u": u}, rules, {"t": "a", "u": "k"}).collect()), key=str)
    assert got == sorted([("t", "2", "named", "review"), ("t", None, "positive", "fail"), ("t", None, "named", "review"), ("u", "5", "never", "fail")], key=str)
    with pytest.raises(ValueError, match="no rules"):
        checks.findings({}, [], {})


@pytest.fixture
def chain(spark):
    files = spark.createDataFrame([("c", n, f"f{k}", f"{n}{k}") for n in range(1, 6) for k in range(40) if n != 4], "chain string, attempt long, path string, sha256 string")
    attempts = spark.createDataFrame([("c", n, "p", "CLOSED_INCOMPLETE") for n in range(1, 6)], "chain string, attempt long, plan string, status string")
    closed = closures.close(attempts, files).persist()
    return files, closed, spark.createDataFrame([("c", "p")], "chain string, plan string")


def found(closed, files, plan):
    return {r.attempt: r.finding for r in closures.verify_chain(closed, files, plan).collect()}


def test_each_link_names_the_one_before(chain):
    files, closed, plan = chain
    before = closures.START
    for r in closed.orderBy("attempt").collect():
        body = json.loads(r.closure)
        assert body["predecessor"] == before and json.dumps(body, sort_keys=True, separators=(",", ":")) == r.closure
        before = hashlib.sha256(r.closure.encode()).hexdigest()
        assert r.sha256 == before
    assert found(closed, files, plan) == dict.fromkeys(range(1, 6), "verified")


def test_a_changed_link_is_named_and_what_follows_refused(chain):
    files, closed, plan = chain
    drifted = files.withColumn("sha256", F.when((F.col("attempt") == 2) & (F.col("path") == "f7"), "x").otherwise(F.col("sha256")))
    assert found(closed, drifted, plan) == {1: "verified", 2: "evidence_drifted", 3: "refused", 4: "refused", 5: "refused"}
    edit = lambda n, to: closed.withColumn("closure", F.when(F.col("attempt") == n, to).otherwise(F.col("closure")))
    forged = edit(3, F.replace("closure", F.lit('"plan":"p"'), F.lit('"plan":"q"')))
    assert found(forged, files, plan) == {1: "verified", 2: "verified", 3: "plan_changed", 4: "predecessor_changed", 5: "refused"}
    assert found(edit(1, F.lit("{")), files, plan) == {1: "malformed", 2: "predecessor_changed", 3: "refused", 4: "refused", 5: "refused"}
    assert found(edit(5, F.replace("closure", F.lit("CLOSED_INCOMPLETE"), F.lit("OPEN"))), files, plan)[5] == "not_closed"
    assert found(closed.filter("attempt <> 2"), files, plan) == {1: "verified", 3: "predecessor_changed", 4: "refused", 5: "refused"}
    more = files.unionByName(files.limit(1).selectExpr("chain", "4L AS attempt", "path", "sha256"))
    assert found(closed, more, plan) == {1: "verified", 2: "verified", 3: "verified", 4: "evidence_drifted", 5: "refused"}


def test_digests_of_dealt_lines(spark, monkeypatch):
    ids = spark.createDataFrame([(c, a, c * 1000 + k) for c in range(3) for a in (1, 2) for k in range(5 + 300 * c * (a - 1))] * 2, "chain long, attempt long, id long").repartition(5)
    want = {}
    for c in range(3):
        for a in (1, 2):
            parts = {}
            for k in range(5 + 300 * c * (a - 1)):
                path = f"p-{c * 1000 + k}"
                parts.setdefault(hashlib.sha256(path.encode()).hexdigest()[:2], []).append(f"{hashlib.sha256(str(c * 1000 + k).encode()).hexdigest()}  {path}")
            sha = sorted(p + hashlib.sha256("\n".join(sorted(lines)).encode()).hexdigest() for p, lines in parts.items())
            want[c, a] = hashlib.sha256("\n".join(sha).encode()).hexdigest()
    path = F.concat(F.lit("p-"), "id")
    for groups, large in ((1 << 16, 1 << 20), (1 << 16, 100), (1, 1)):  # no attempt is large, some are, all are
        monkeypatch.setattr(closures, "GROUPS", groups)
        monkeypatch.setattr(closures, "LARGE", large)
        files = closures.dealt(ids, path).distinct().select("chain", "attempt", "_deal", path.alias("path"), F.sha2(F.col("id").cast("string"), 256).alias("sha256"))
        for f in (files, files.drop("_deal")):
            assert {(r.chain, r.attempt): r.evidence for r in closures.evidence_digests(f).collect()} == want
    plan = closures.evidence_digests(files)._jdf.queryExecution().executedPlan().toString().split("Subquery")[0]
    moved = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(moved) == 2 and not any("part#" in line for line in moved)  # numbers, then what is left of each deal
