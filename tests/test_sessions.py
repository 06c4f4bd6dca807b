"""Capped sessions by successors against the state machine, on logs with and without idle gaps."""

import datetime as dt
import random

import pytest

from factloom.operators import events

SCHEMA = "key string, seq long, ts timestamp, identity string"


def log_of(seed, n, keys, names, gaps):
    r, now, out = random.Random(seed), dt.datetime(2024, 1, 1), []
    for i in range(n):
        now += dt.timedelta(minutes=r.choice(gaps))
        out.append((r.choice(keys), i, now, r.choice(names)))
    return out


def folded(rows):
    state, out = {}, {}
    for key, seq, ts, identity in sorted(rows, key=lambda r: (r[2], r[1])):
        out[key, seq] = state.setdefault(key, events.SessionFold()).place(ts, identity)
    return out


@pytest.mark.parametrize(("n", "keys", "names", "gaps"), [(900, ["a"], [f"i{k}" for k in range(35)], [0, 1]), (700, ["a", "b", None], [None, *(f"i{k}" for k in range(24))], [0, 2, 29, 30]), (500, ["a"], ["x", "y"], [0]), (400, ["a", "b"], [f"i{k}" for k in range(400)], [0, 1, 31])])
def test_capped_sessions_equal_the_state_machine(spark, n, keys, names, gaps):
    rows = log_of(n, n, keys, names, gaps)
    got = {(r["key"], r["seq"]): r["session"] for r in events.capped_sessions(spark.createDataFrame(rows, SCHEMA), "key", "identity").collect()}
    assert got == folded(rows)


def test_no_sessions_of_an_empty_log(spark):
    assert events.capped_sessions(spark.createDataFrame([], SCHEMA), "key", "identity").count() == 0
