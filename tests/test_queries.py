"""Every registered engine query against its SQL in DuckDB, on the smallest tables."""

import math
import os

import duckdb
import pytest

from flowspark.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    one = lambda v: ("",) if v is None else (float(v),) if isinstance(v, int | float) and not isinstance(v, bool) else (str(v),)
    return sorted(names), sorted(repr([one(r[k]) for k in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    found = duck.execute(ORACLES[name])
    want = canonical([d[0] for d in found.description], found.fetchall())
    assert canonical(df.columns, df.collect()) == want


def test_resume_compares_the_stored_log_up_to_the_last_timesteps(spark, monkeypatch):
    from flowspark.operators import ledger

    seen, own = [], ledger.divergence
    monkeypatch.setattr(ledger, "divergence", lambda stored, moves: seen.append((stored, moves)) or own(stored, moves))
    QUERIES["resume_divergence"](spark, SF)
    stored, moves = ({r.run_id: r["count"] for r in x.groupBy("run_id").count().collect()} for x in seen[0])
    assert stored.keys() == moves.keys() and all(0.9 * moves[k] <= stored[k] < moves[k] for k in moves)


def test_balances_beyond_64_bits_are_over_the_ceiling(spark):
    from flowspark.operators import ledger

    moves = [("r", k, k, "a", "b", "x", 1 << 61) for k in range(1, 7)] + [("r", k, k, "b", "a", "x", 3 << 61) for k in (7, 8)] + [("r", 9, 9, "a", "b", "y", 1 << 53), ("r", 10, 10, "a", "b", "y", 1)]
    moves = spark.createDataFrame(moves, "run_id string, seq long, timestep long, source string, target string, substance string, count long")
    seeds = spark.createDataFrame([("a", "x", 3), ("b", "x", -3), ("a", "y", 0), ("b", "y", 0)], "endpoint string, substance string, count long")
    for start in (None, seeds):
        balance, want = {("a", "x"): 3 if start else 0, ("b", "x"): -3 if start else 0}, []
        for r in moves.orderBy("seq").collect():
            for cell, delta in (((r.source, r.substance), -r["count"]), ((r.target, r.substance), r["count"])):
                balance[cell] = now = balance.get(cell, 0) + delta
                if abs(now) > 1 << 53:
                    want.append((r.seq, *cell, delta, now if -(1 << 63) <= now < 1 << 63 else None))
        assert any(w[-1] is None for w in want)
        found = ledger.over_ceiling(moves, start).select("seq", "endpoint", "substance", "delta", "balance").collect()
        assert sorted(map(tuple, found), key=repr) == sorted(want, key=repr)
