"""Planned calls: what is missing, double or unplanned is named before a file is read."""

import pathlib

import pytest

from palimpsest.operators.checks import CheckFailed
from palimpsest.sources import calls
from palimpsest.sources.shared import fresh_folder


def test_a_plan_is_met_exactly_or_not_read(spark):
    root = fresh_folder(spark, "calls")
    at = pathlib.Path(root.removeprefix("file://"))
    for g, s in [("a b", 1), ("a b", 2), ("c%d", 1)]:
        folder = at / f"generator={g.replace('%', '%25')}" / f"scenario={s}"
        folder.mkdir(parents=True)
        (folder / "call.json").write_text(f'{{"text": "{g}{s}",\n "n": {s}}}')
    plan = spark.createDataFrame([(1, "c%d", 1), (2, "a b", 2), (3, "a b", 1)], "slot int, generator string, scenario int")
    read = lambda p=plan: calls.planned_calls(spark, root, p, "slot", "text string, n int", "generator", "scenario")
    assert [tuple(r) for r in read().collect()] == [(1, "c%d", 1, "c%d1", 1), (2, "a b", 2, "a b2", 2), (3, "a b", 1, "a b1", 1)]
    find = lambda p: {(r.generator, r.scenario): r.finding for r in calls.plan_findings(calls.listing(spark, root, "generator", "scenario"), p, "generator", "scenario").collect()}
    assert find(plan.filter("slot < 3")) == {("a b", "1"): "unplanned"}
    (at / "generator=a b/scenario=1/again.json").write_text("no json, and never read")
    more = plan.unionByName(spark.createDataFrame([(4, "x", 9), (5, "c%d", 1)], plan.schema))
    assert find(more) == {("a b", "1"): "double", ("x", "9"): "missing", ("c%d", "1"): "repeated"}
    with pytest.raises(CheckFailed) as failed:
        read(more)
    assert failed.value.broken == {"double": 1, "missing": 1, "repeated": 1}
