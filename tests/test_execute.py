"""Both executors on random models, with runs that fail; deep chains; forcings from tables; the end-to-end fixture."""

import json
import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowspark.operators import execute, sweep
from flowspark.plans.expr import Expr, add, clamp, compare, divide, forcing, lit, maximum, minimum, multiply, param, power, select, subtract, table_lookup
from flowspark.plans.model import Model
from flowspark.queries import _fact_source, _projection, _rule, _wrap, basin, chain, hydrology

LAST = 12


def random_model(seed: int) -> Model:
    """A graph of five compartments and a sea whose rules use every kind of expression, projection and partition of tiers A and B."""
    r = random.Random(seed)
    names = [f"c{k}" for k in range(5)]
    projections, states, inputs, rules, bindings, edges = [], [], [], [], [], set()

    def expression(k: int, depth: int = 0) -> Expr:
        kind = r.randrange(13 if depth < 3 else 4)
        sub = lambda: expression(k, depth + 1)
        if kind == 0:
            return lit(r.choice((0.0, 0.5, 2.0, 3.25)))
        if kind == 1:
            return param("gain")
        if kind == 2:
            return forcing(r.choice(("rain", "heat")))
        if kind == 3:
            if r.random() < 0.5 or not k:
                own = f"i{len(inputs)}"
                inputs.append({"compartment": names[k], "substance": "water", "input": own, "value_kind": "scalar", "source": {"kind": "forcing", "forcing": {"id": "heat"}}})
                return Expr("input", name=own, declared="scalar")
            p = f"p{len(projections)}"
            source = _fact_source(*(("incoming", names[k]) if r.random() < 0.5 else ("outgoing", names[r.randrange(k)])))
            shape = r.randrange(3)
            if shape == 0:
                n = r.randrange(1, 4)
                spec, initial = {"kind": "bounded_lag", "source": source, "steps": n}, [float(r.randrange(3)) for _ in range(n)]
            elif shape == 1:
                n = r.randrange(1, 4)
                spec, initial = {"kind": "ordered_rolling_aggregate", "source": source, "window": n, "aggregate": "sum_oldest_to_newest"}, [0.5] * (n - 1)
            else:
                read = lambda n: Expr("input", name=n, declared="scalar")
                spec = {
                    "kind": "finite_recurrence", "state_kinds": ["extensive"], "parameters": [{"id": "gain", "value_kind": "scalar"}], "output_index": 0,
                    "inputs": [{"reference": {"id": "before", "value_kind": "scalar"}, "source": {"kind": "previous_state", "index": 0, "value_kind": "extensive"}}, {"reference": {"id": "now", "value_kind": "scalar"}, "source": source}],
                    "updates": [_wrap(add(multiply(param("gain"), read("before")), multiply(lit(0.25), read("now"))))],
                }
                initial = [1.0]
            spec, state = _projection(p, spec, initial)
            projections.append(spec)
            states.append(state)
            return Expr("projection", name=p, declared="extensive")
        binary = {4: add, 5: subtract, 6: multiply, 7: minimum, 8: maximum}
        if kind in binary:
            return binary[kind](sub(), sub())
        if kind == 9:
            return divide(sub(), param("part"))
        if kind == 10:
            return clamp(sub(), lit(0), lit(6))
        if kind == 11:
            return select(compare(r.choice(("less_than", "equal", "greater_than_or_equal")), sub(), lit(1)), sub(), sub())
        return table_lookup("curve", sub()) if r.random() < 0.7 else power(clamp(sub(), lit(0), lit(4)), lit(0.5))

    for k, c in enumerate(names):
        targets = r.sample([*names[k + 1 :], "sea"], min(2, 5 - k))
        edges |= {(c, t) for t in targets}
        e = maximum(expression(k), lit(0)) if r.random() < 0.7 else expression(k)
        kind = r.choice(("release_all", "fixed_fraction_split", "constant_fraction_transfer", "expression_partition", "exogenous_series", "retain_all"))
        own = [(f"b{n}", t) for n, t in enumerate(targets)]
        if kind == "fixed_fraction_split":
            part = {"kind": kind, "retained_fraction": 1 - 0.25 * len(own), "branches": [{"branch": b, "fraction": 0.25} for b, _ in own]}
        elif kind == "expression_partition":
            part = {"kind": kind, "branches": [{"branch": b, "expression": _wrap(e if n else lit(0.75))} for n, (b, _) in enumerate(own)]}
        elif kind == "retain_all":
            part, own = {"kind": kind}, []
        else:
            own = own[:1]
            part = {"kind": kind, "branch": "b0"} | ({"series": {"id": "rain"}} if kind == "exogenous_series" else {"fraction": 0.3} if kind == "constant_fraction_transfer" else {})
        rules.append(_rule(c, e, part, gain=0.5, part=2.0))
        bindings += [{"compartment": c, "substance": "water", "branch": b, "destination": t} for b, t in own]
    d = json.loads(json.dumps(basin(LAST).document))
    horizon = {"first": 0, "last": LAST}
    return Model.from_document(d | {
        "finite_compartments": names, "connections": [{"source": a, "target": b} for a, b in sorted(edges)],
        "initial_stocks": [{"compartment": c, "amounts": [{"substance": "water", "amount": 30.0 + 20 * k}]} for k, c in enumerate(names)],
        "projections": {"specifications": projections, "initial_states": states},
        "forcings": [{"id": n, "horizon": horizon, "values": [float(r.randrange(5)) for _ in range(LAST + 1)]} for n in ("rain", "heat")],
        "interpolation_tables": [{"id": "curve", "numerical_semantics_version": "v1", "boundary_policy": r.choice(("clamp_to_endpoint", "reject", "linear_extrapolate")), "abscissae": [0.0, 2.0, 40.0], "ordinates": [0.0, 1.5, 3.0]}],
        "rules": rules, "transfer_bindings": bindings, "input_bindings": inputs,
    })


RUNS = [("a", "gain", 0.5), ("a", "part", None), ("b", "gain", 1.5), ("c", "gain", -1.0), ("d", "part", 0.0), ("e", "gain", 40.0), ("f", None, None), ("g", "none", 1.0), ("h", "gain", float("inf")), ("i", "gain", 1.0), ("i", "gain", 2.0), ("j", "part", -3.0)]
PARAMS = "run_id string, compartment string, substance string, parameter string, value double"


@pytest.mark.parametrize("seed", range(6))
def test_both_executors_agree_on_every_run(spark, seed):
    m = random_model(seed)
    assert "C" not in execute.tiers(m).values()
    target = "c2"
    params = spark.createDataFrame([(n, None if p is None else target, None if p is None else "water", p, v) for n, p, v in RUNS], PARAMS)
    seen = {mode: Counter(execute.run(spark, m, params, mode).select(*execute.FIELDS).collect()) for mode in (None, "sequential")}
    assert seen[None] == seen["sequential"]
    told = {mode: sorted(execute.outcomes(spark, m, params, mode).collect()) for mode in (None, "sequential")}
    assert told[None] == told["sequential"] and {x.run_id for x in told[None]} == {n for n, *_ in RUNS}
    codes = {x.run_id: x.error for x in told[None]}
    assert (codes["g"], codes["h"], codes["i"]) == ("ParameterNotDeclared", "NonFiniteValue", "DuplicateTarget")
    assert {n for n, *_ in seen[None]} <= {x.run_id for x in told[None] if x.status == "completed"}


def test_an_overdraw_fails_its_run_alone(spark):
    d = json.loads(json.dumps(basin(9).document))
    for s in d["initial_stocks"]:
        s["amounts"][0]["amount"] = 1.0
    grid = sweep.sweep(spark, 4, ("upper", "water", "gain"), F.col("id") * 0.0 - F.when(F.col("id") == 3, 1.0).otherwise(0.0))
    for mode in (None, "sequential"):
        rows = {x.run_id: (x.status, x.error, x.timestep) for x in execute.outcomes(spark, Model.from_document(d), grid, mode).collect()}
        assert rows == {**{f"run-00000{k}": ("failed", "RuleOverdraw", 1) for k in range(3)}, "run-000003": ("failed", "InvalidAmount", 1)}
        assert execute.run(spark, Model.from_document(d), grid, mode).count() == 0


def test_a_chain_of_fifty_lags_is_planned_quickly(spark):
    m = chain(50, 9)
    begun = time.time()
    rows = execute.run(spark, m)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert time.time() - begun < 120 and plan.count("Exchange hashpartitioning(run_id") <= 1
    assert Counter(rows.select(*execute.FIELDS).collect()) == Counter(execute.run(spark, m, mode="sequential").select(*execute.FIELDS).collect())


def test_forcings_from_a_table(spark):
    """Runs that the table names read it in place of the document's; a step without a number fails the run that reads it."""
    m = basin(9)
    rows = [("x", "rain", t, float(t % 3)) for t in range(10)] + [("y", "rain", t, 1.0) for t in range(5)] + [("z", "other", 0, 1.0)]
    series = spark.createDataFrame(rows, "run_id string, forcing_id string, timestep long, value double")
    params = spark.createDataFrame([(n, None, None, None, None) for n in "xyz"], PARAMS)
    for mode in (None, "sequential"):
        told = {x.run_id: (x.status, x.error, x.timestep) for x in execute.outcomes(spark, m, params, mode, series).collect()}
        assert told == {"x": ("completed", None, None), "y": ("failed", "Numerical", 5), "z": ("completed", None, None)}
    a, b = (Counter(execute.run(spark, m, params, mode, series).select(*execute.FIELDS).collect()) for mode in (None, "sequential"))
    assert a == b
    plain = Counter(x[1:] for x in execute.run(spark, m).select(*execute.FIELDS).collect())
    assert Counter(x[1:] for x in a.elements() if x[0] == "z") == plain != Counter(x[1:] for x in a.elements() if x[0] == "x")


def test_hydrology_fixture(spark):
    """Seven rules of different kinds with input bindings; without the one that reads its own past, in tiers A and B too."""
    want = {"linear-reservoir": [2000000, 1500000, 1125000], "lag": [3000000, 2000000], "muskingum": [1800000, 540000, 161999], "evaporation": [1000000, 2000000, 3000000], "seepage": [2000000, 3000000, 4000000], "reservoir-policy": [3000000, 8000000, 3000000], "demand": [6000000, 8000000, 10000000]}
    for m, mode in ((hydrology(), None), (hydrology(without=("muskingum",)), None), (hydrology(without=("muskingum",)), "sequential")):
        found: dict = {}
        for x in execute.run(spark, m, mode=mode).orderBy("seq").collect():
            found.setdefault(x.source, []).append(x["count"])
        assert found == {k: v for k, v in want.items() if (k, "water") in m.rules}
    assert "C" in execute.tiers(hydrology()).values() and set(execute.tiers(hydrology(without=("muskingum",))).values()) == {"A", "B"}
