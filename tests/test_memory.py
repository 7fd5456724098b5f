"""The relational state machine against a sequential fold on random decisions."""

import random

from palimpsest.operators import memory


def fold(initial, decisions):
    state = {e: [i, i, t] for e, i, t in initial}
    errors = set()
    for idx, entry, op, target, text in sorted(decisions):
        if op == "Add":
            state[entry] = [idx, idx, text]
        elif op == "Update":
            if target in state:
                state[target][1:] = [idx, text]
            else:
                errors.add(idx)
    return {(k, *v) for k, v in state.items()}, errors


def test_execute_equals_fold(spark):
    rng, want, initial, decisions = random.Random(7), {}, [], []
    for run in range(60):
        start = [(f"m{i}", i, f"t{i}") for i in range(1, 4)]
        steps = [(i, f"m{i}", rng.choice(["Add", "Update", "Update", "Noop", "?"]), f"m{rng.randint(1, 14)}", f"x{i}") for i in range(4, 13)]
        want[run] = fold(start, steps)
        initial += [(run, e, i, t) for e, i, t in start]
        decisions += [(run, i, e, op, target, t) for i, e, op, target, t in steps]
    state, _, errors = memory.execute(
        spark.createDataFrame(initial, "run int, entry_id string, idx int, text string"),
        spark.createDataFrame(decisions, "run int, idx int, entry_id string, op string, target string, text string"),
    )
    got, bad = {r: set() for r in want}, {r: set() for r in want}
    for r in state.collect():
        got[r.run].add((r.entry_id, r.created_idx, r.updated_idx, r.text))
    for r in errors.collect():
        bad[r.run].add(r.idx)
    assert {r: (got[r], bad[r]) for r in want} == want
