"""Window selection against the plain loop, with counters that do not add up."""

import random

from pyspark.sql import functions as F

from palimpsest.functions.tokens import ChatTemplate, History, Lines, Pattern
from palimpsest.operators import windows


def chat():
    class Quirky(Pattern):  # a class of a function goes to the workers by value
        """A phrase over two turns is one token: a longer suffix can be cheaper."""

        def __call__(self, text):
            return len(text.split()) - (15 if "mark" in text and "long" * 5 in text.replace(" ", "") else 0)

    return History(Quirky(), ChatTemplate(opening="please go on from here"), "be brief")


CHAT = chat()


def loop(units, budget):
    kept = []
    for unit in reversed(units):
        if CHAT([m for u in [unit, *kept] for m in u]) > budget:
            break
        kept = [unit, *kept]
    return len(kept), CHAT([m for u in kept for m in u])


def histories():
    rng = random.Random(3)
    make = lambda: [[(rng.choice(["user", "assistant"]), rng.choice(["mark", "long " * rng.randint(1, 20), "a b", ""]))] * rng.choice([1, 1, 2]) for _ in range(rng.randint(1, 9))]
    return {k: make() for k in range(60)}


def frame(spark, units):
    rows = [(k, i, [{"role": r, "content": c} for r, c in u]) for k, h in units.items() for i, u in enumerate(h)]
    return spark.createDataFrame(rows, "run int, at long, messages array<struct<role:string,content:string>>").repartition(3)


def test_windows_equal_the_loop(spark):
    units = histories()
    falls = 0
    for budget in (0, 9, 30):
        got = {r.run: (r.admitted, r.used) for r in windows.select_window(frame(spark, units), "run", "at", "messages", CHAT, budget).collect()}
        want = {k: loop(h, budget) for k, h in units.items()}
        assert got == want
    for h in units.values():
        counts = [CHAT([m for u in h[-n:] for m in u]) for n in range(1, len(h) + 1)]
        falls += any(a > b for a, b in zip(counts, counts[1:]))
    assert falls > 5  # longer suffixes that are cheaper do occur


def test_required_budget_is_the_smallest_that_keeps_all(spark):
    units = histories()
    wanted = {k: {i for i in range(len(h)) if i % 3 == 1} for k, h in units.items()}
    got = windows.required_budget(frame(spark, units), "run", "at", "messages", CHAT, F.col("at") % 3 == 1, least=2).collect()
    assert {r.run for r in got} == set(units)
    for r in got:
        h, need = units[r.run], wanted[r.run]
        if len(need) < 2:
            assert r.required is None
        else:
            keeps = lambda b: len(h) - loop(h, b)[0] <= min(need)  # noqa: B023, E731
            assert keeps(r.required) and not any(map(keeps, range(r.required)))


def test_prefix_admission_stops_at_the_first_overflow(spark):
    rows = [(1, 1, "a b c"), (1, 2, "d " * 9), (1, 3, "e"), (2, 1, "x " * 50), (3, 1, None), (3, 2, "y")]
    ranked = spark.createDataFrame(rows, "q int, pos int, line string")
    got = {r.q: tuple(r)[1:] for r in windows.admit_prefix(ranked, "q", "pos", "line", Lines(Pattern()), 8, 5).collect()}
    assert got == {1: (1, 3, 1, False), 2: (0, 0, None, True), 3: (2, 1, 2, False)}
    assert windows.admit_prefix(ranked.limit(0), "q", "pos", "line", Lines(Pattern()), 8, 5).count() == 0
