"""Documents, runs of all tiers, sweeps, replay."""

import copy
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from flowspark.operators import execute, ledger, series, sweep
from flowspark.operators.simulate import RunError, simulate
from flowspark.plans.expr import Expr, add, lit
from flowspark.plans.model import Archive, Model, ModelError
from flowspark.queries import _fact_source, _projection, _rule, basin
from flowspark.sources import documents, log


def document():
    return json.loads(json.dumps(basin(9, closed=True).document))


def reservoir():
    """Two slots: storage and release; k = 0.25 from 8."""
    scalar = lambda n: Expr("input", name=n, declared="scalar")
    k = Expr("parameter", name="k", declared="scalar")
    multiply = lambda a, b: Expr("multiply", (a, b))
    before = {"reference": {"id": "before", "value_kind": "scalar"}, "source": {"kind": "previous_state", "index": 0, "value_kind": "extensive"}}
    wrap = lambda e: {"rule_ir_version": "v1", "numerical_semantics_version": "v1", "expression": e.to_dict()}
    spec = {"kind": "finite_recurrence", "state_kinds": ["extensive", "extensive"], "inputs": [before], "parameters": [{"id": "k", "value_kind": "scalar"}],
            "updates": [wrap(Expr("subtract", (scalar("before"), multiply(k, scalar("before"))))), wrap(multiply(k, scalar("before")))], "output_index": 1}
    p, state = _projection("store", spec, [8.0, 0.0])
    d = document()
    d |= {"finite_compartments": ["pond"], "connections": [{"source": "pond", "target": "sea"}], "initial_stocks": [{"compartment": "pond", "amounts": [{"substance": "water", "amount": 100.0}]}],
          "horizon": {"first": 0, "last": 2}, "forcings": [], "interpolation_tables": [], "projections": {"specifications": [p], "initial_states": [state]},
          "rules": [_rule("pond", Expr("projection", name="store", declared="extensive"), {"kind": "release_all", "branch": "out"}, k=0.25)],
          "transfer_bindings": [{"compartment": "pond", "substance": "water", "branch": "out", "destination": "sea"}], "units": [{"substance": "water", "unit": "m3", "quantum": 1e-6}]}
    return d


def test_linear_reservoir(spark):
    m = Model.from_document(reservoir())
    assert [n for *_, n in simulate(m)] == [2000000, 1500000, 1125000]
    assert execute.tiers(m) == {("pond", "water"): "B"}
    assert [r["count"] for r in execute.run(spark, m).orderBy("seq").collect()] == [2000000, 1500000, 1125000]


def test_columnar_equals_sequential(spark):
    m = basin(40)
    grid = sweep.sweep(spark, 5, ("upper", "water", "gain"), F.col("id") * 0.3)
    keys = ["run_id", "seq", "timestep", "source", "target", "substance", "count", "amount"]
    a = execute.run(spark, m, grid).select(*keys).collect()
    b = execute.run(spark, m, grid, mode="sequential").select(*keys).collect()
    assert Counter(a) == Counter(b) and len(a) > 200


def test_partition_count_changes_nothing(spark):
    grid = sweep.sweep(spark, 4, ("upper", "water", "gain"), F.col("id") * 0.3)
    one = Counter(execute.run(spark, basin(20), grid.repartition(1)).collect())
    assert one == Counter(execute.run(spark, basin(20), grid.repartition(7)).collect())


def test_expression_partition_and_overdraw(spark):
    d = reservoir()
    d["projections"] = {"specifications": [], "initial_states": []}
    d["finite_compartments"], d["boundary_accounts"] = ["pond"], ["a", "b"]
    d["connections"] = [{"source": "pond", "target": t} for t in "ab"]
    wrap = lambda e: {"rule_ir_version": "v1", "numerical_semantics_version": "v1", "expression": e.to_dict()}
    split = {"kind": "expression_partition", "branches": [{"branch": "to-b", "expression": wrap(lit(3))}, {"branch": "to-a", "expression": wrap(add(lit(1), lit(1)))}]}
    d["rules"] = [_rule("pond", lit(0), split)]
    d["transfer_bindings"] = [{"compartment": "pond", "substance": "water", "branch": f"to-{t}", "destination": t} for t in "ab"]
    d["initial_stocks"][0]["amounts"][0]["amount"] = 10.0
    d["horizon"]["last"] = 1
    m = Model.from_document(d)
    assert [(t, n) for _, _, t, _, n in simulate(m)] == [("a", 2000000), ("b", 3000000)] * 2
    d["horizon"]["last"] = 2
    with pytest.raises(RunError, match="Overdraw"):
        simulate(Model.from_document(d))
    failed = execute.sequential(Model.from_document(d), execute.runs_of(spark).selectExpr("run_id", "'' compartment", "'' substance", "'' parameter", "CAST(NULL AS double) value")).collect()
    assert len(failed) == 1 and "Overdraw" in failed[0]["error"]


@pytest.mark.parametrize("change, code", [
    (lambda d: d.update(extra=1), "UnknownField"),
    (lambda d: d["finite_compartments"].append("Upper"), "InvalidStart"),
    (lambda d: d["finite_compartments"].append("upper"), "DuplicateEndpoint"),
    (lambda d: d["connections"].append({"source": "upper", "target": "none"}), "UnknownConnectionEndpoint"),
    (lambda d: d["connections"].append({"source": "lower", "target": "upper"}), "Cycle"),
    (lambda d: d["initial_stocks"][0]["amounts"][0].update(amount=-1.0), "Negative"),
    (lambda d: d["initial_stocks"][0].update(compartment="sea"), "BoundaryAccountStock"),
    (lambda d: d["horizon"].update(first=99), "ReversedRunHorizon"),
    (lambda d: d["calendar"].update(timestep_seconds=0), "ZeroTimestepDuration"),
    (lambda d: d["forcings"][0]["values"].pop(), "ValueCountMismatch"),
    (lambda d: d["interpolation_tables"][0].update(abscissae=[0.0, 0.0, 1.0]), "AbscissaeNotStrictlyIncreasing"),
    (lambda d: d["rules"][0]["parameters"].clear(), "MissingRuleParameter"),
    (lambda d: d["transfer_bindings"].pop(), "MissingTransferBinding"),
    (lambda d: d["projections"]["initial_states"].pop(), "MissingInitialState"),
    (lambda d: d["projections"]["specifications"].append(copy.deepcopy(d["projections"]["specifications"][0])), "DuplicateProjection"),
    (lambda d: d["units"].clear(), "MissingUnit"),
    (lambda d: d["units"][0].update(quantum=0.0), "NonPositiveQuantum"),
    (lambda d: d["units"][0].update(substance="salt"), "UnknownUnitSubstance"),
    (lambda d: d["units"].append(dict(d["units"][0])), "DuplicateUnit"),
    (lambda d: d["units"][0].update(unit="m 3"), "InvalidUnit"),
    (lambda d: d["substances"].append("water"), "DuplicateSubstance"),
    (lambda d: d["substances"].append("salt"), "MissingUnit"),
    (lambda d: d["initial_stocks"].append(copy.deepcopy(d["initial_stocks"][0])), "DuplicateCompartment"),
    (lambda d: d["initial_stocks"][0].update(compartment="none"), "UnknownCompartment"),
    (lambda d: d["initial_stocks"][0]["amounts"][0].update(substance="salt"), "UnregisteredSubstance"),
    (lambda d: d["initial_stocks"][0]["amounts"][0].update(amount=1e300), "StockNotCountable"),
    (lambda d: (d["substances"].append("salt"), d["units"].append({"substance": "salt", "unit": "kg", "quantum": 1.0}), d["initial_stocks"][0]["amounts"].append({"substance": "salt", "amount": 2.0})), "MissingRule"),
    (lambda d: d["projections"]["initial_states"][0]["values"].pop(), "InitialStateLength"),
    (lambda d: d["projections"]["initial_states"][0]["values"][0].update(value=-1.0), "Negative"),
    (lambda d: d["projections"]["specifications"][0]["spec"].update(steps=0), "NonPositiveBound"),
    (lambda d: d["projections"]["specifications"][0]["spec"]["source"]["selector"].update(compartment="none"), "UnknownProjectionFactCompartment"),
    (lambda d: d["projections"]["specifications"][0]["spec"]["source"]["selector"].update(substance="salt"), "UnknownProjectionFactSubstance"),
    (lambda d: d["projections"]["initial_states"].append({"projection": "none", "values": []}), "UnknownInitialState"),
    (lambda d: d["rules"].append(copy.deepcopy(d["rules"][0])), "DuplicateRule"),
    (lambda d: d["rules"][0].update(compartment="none"), "UnknownRuleCompartment"),
    (lambda d: d["rules"][0].update(compartment="sea"), "BoundaryAccountRule"),
    (lambda d: d["rules"][0].update(substance="salt"), "UnknownRuleSubstance"),
    (lambda d: d["rules"][0]["parameters"].append({"id": "gain", "value": 1.0}), "DuplicateParameter"),
    (lambda d: d["rules"][0].update(disposition={"rule_ir_version": "v1", "numerical_semantics_version": "v1", "partition": {"kind": "fixed_fraction_split", "retained_fraction": 0.5, "branches": [{"branch": "down", "fraction": 0.4}]}}), "InvalidFixedFractionTotal"),
    (lambda d: d["rules"][0]["disposition"]["partition"].update(kind="spill"), "UnknownKind"),
    (lambda d: d["rules"][0]["disposition"].update(rule_ir_version="v2"), "RuleIrVersionMismatch"),
    (lambda d: d["transfer_bindings"].append({"compartment": "upper", "substance": "water", "branch": "more", "destination": "lower"}), "UnusedTransferBinding"),
    (lambda d: d["transfer_bindings"][0].update(destination="sea"), "UndeclaredConnection"),
    (lambda d: d["transfer_bindings"].append(dict(d["transfer_bindings"][0])), "DuplicateTransferBranch"),
    (lambda d: d["interpolation_tables"][0].update(boundary_policy="none"), "UnknownKind"),
    (lambda d: d["interpolation_tables"][0].update(abscissae=[0.0], ordinates=[0.0]), "TooFewPoints"),
    (lambda d: d["interpolation_tables"][0]["ordinates"].pop(), "CoordinateCountMismatch"),
    (lambda d: d["forcings"][0].update(horizon={"first": 0, "last": 3}), "ForcingHorizonMismatch"),
    (lambda d: d["forcings"].append(copy.deepcopy(d["forcings"][0])), "DuplicateForcing"),
    (lambda d: d["forcings"].clear(), "UnknownForcing"),
    (lambda d: d["interpolation_tables"].clear(), "UnknownTable"),
    (lambda d: d.update(document_version="v2"), "DocumentVersion"),
    (lambda d: d.pop("units"), "MalformedDocument"),
])
def test_diagnostics(change, code):
    d = document()
    change(d)
    with pytest.raises(ModelError, match=code):
        Model.from_document(d)


def _changed(spec=None, initial=None):
    d = reservoir()
    d["projections"]["specifications"][0]["spec"].update(spec or {})
    if initial is not None:
        d["projections"]["initial_states"][0]["values"] = initial
    return d


def _updates(*expressions):
    return [{"rule_ir_version": "v1", "numerical_semantics_version": "v1", "expression": e.to_dict()} for e in expressions]


@pytest.mark.parametrize("document, code", [
    (_changed({"output_index": 2}), "RecurrenceOutputIndex"),
    (_changed({"state_kinds": ["extensive"]}), "RecurrenceUpdateCount"),
    (_changed({"state_kinds": [], "updates": []}), "NonPositiveBound"),
    (_changed({"parameters": [{"id": "k", "value_kind": "scalar"}, {"id": "j", "value_kind": "scalar"}]}), "UnusedParameterDeclaration"),
    (_changed({"parameters": []}), "MissingParameterDeclaration"),
    (_changed({"inputs": []}), "MissingInputBinding"),
    (_changed({"updates": _updates(Expr("parameter", name="k"), Expr("parameter", name="k"))}), "UnusedInputBinding"),
    (_changed({"updates": _updates(Expr("forcing", name="f"), Expr("parameter", name="k"))}), "ForbiddenRecurrenceLeaf"),
    (_changed({"updates": _updates(Expr("comparison", (lit(1), lit(2)), name="equal"), Expr("parameter", name="k"))}), "RecurrenceUpdateKind"),
    (_changed(initial=[{"kind": "extensive", "value": 1.0}]), "InitialStateLength"),
    (_changed(initial=[{"kind": "extensive", "value": 1.0}, {"kind": "scalar", "value": 1.0}]), "InitialStateKind"),
])
def test_recurrence_diagnostics(document, code):
    with pytest.raises(ModelError, match=code):
        Model.from_document(document)


def test_nesting_and_cycles():
    d = document()
    node = {"kind": "literal", "value": 0.0}
    for _ in range(300):
        node = {"kind": "add", "lhs": node, "rhs": {"kind": "literal", "value": 0.0}}
    d["rules"][0]["expression"]["expression"] = node
    with pytest.raises(ModelError, match="TooDeep"):
        Model.from_document(d)
    d["rules"][0]["expression"] = d
    with pytest.raises(ModelError, match="Cyclic|TooDeep"):
        Model.from_document(d)


def test_digest_and_substitution():
    d = document()
    m = Model.from_document(d)
    other = copy.deepcopy(d)
    other["finite_compartments"].reverse()
    other["rules"].reverse()
    assert Model.from_document(other).digest == m.digest
    changed = m.substitute({("upper", "water", "gain"): 0.75})
    assert changed.digest != m.digest and m.rules["upper", "water"].parameters == {"gain": 0.5}
    assert Model.from_document(changed.document).digest == changed.digest
    for bad in ({("none", "water", "gain"): 1.0}, {("upper", "water", "x"): 1.0}, {("upper", "water", "gain"): float("nan")}):
        with pytest.raises(ModelError):
            m.substitute(bad)
    a = Archive()
    assert a.insert(m) == a.insert(m) == m.digest and a.get(m.digest) is m


def test_replay_series_and_seal(spark):
    m = basin(30, closed=True)
    moves = execute.run(spark, m).cache()
    tables = documents.tables_of(spark, m)
    seeds = ledger.seed_cells(tables["endpoints"], tables["substances"], tables["initial_stocks"])
    final = {r.endpoint: r.balance for r in ledger.final_stock(moves, seeds).collect()}
    assert sum(final.values()) == sum(m.initial_count(c, "water") for c in ("upper", "lower", "pool"))
    assert ledger.overdrafts(moves, seeds).count() == 0 and ledger.order_violations(moves).count() == 0
    assert {r.net for r in ledger.conservation_totals(moves).collect()} == {0}
    got = series.ranged(moves, "outgoing", "pool", "water", (0, 30), (-1, 31), 0.25).orderBy("timestep").collect()
    assert [r.presence for r in got] == ["absent"] + ["present"] * 31 + ["absent"]
    assert [r["count"] for r in got][1:9] == [128, 64, 32, 16, 8, 4, 2, 1] and got[15]["count"] == 0
    digest = log.log_digests(moves)
    seal = ledger.seal(moves, 30).join(digest.select("run_id", "log_digest"), "run_id")
    assert [r.status for r in ledger.run_status(moves, seal).collect()] == ["complete"]
    rows = log.records(spark.createDataFrame([("run-000000", m.digest)], "run_id string, model_digest string"), moves, seal)
    assert log.grammar_violations(rows).count() == 0
    assert log.grammar_violations(rows.where("record <> 'genesis'")).count() == 1
    assert ledger.divergence(moves.where("seq < 10"), moves).count() == 0


def test_sources(spark, tmp_path):
    m = basin(5)
    documents.write_document(spark, m, str(tmp_path / "model"))
    assert [x.digest for x in documents.read_models(spark, str(tmp_path / "model")).values()] == [m.digest]
    rows = spark.createDataFrame([(m.digest, json.dumps(m.document))], "digest string, document string")
    for _ in range(2):
        log.insert_models(spark, str(tmp_path / "archive"), rows)
    assert spark.read.parquet(str(tmp_path / "archive")).count() == 1
    with pytest.raises(ValueError, match="DigestCollision"):
        log.insert_models(spark, str(tmp_path / "archive"), spark.createDataFrame([(m.digest, "{}")], "digest string, document string"))
    t = documents.tables_of(spark, m)
    wider = t["forcing"].withColumn("value", F.col("value") + 1), t["knots"].withColumn("y", F.col("y") * 2)
    read = Model.from_document(documents.document_with(m.document, *wider))
    assert read.forcings["rain"] == tuple(v + 1 for v in m.forcings["rain"]) and read.tables["curve"].knots == tuple((x, 2 * y) for x, y in m.tables["curve"].knots)
    assert Model.from_document(documents.document_with(m.document, t["forcing"], t["knots"])).digest == m.digest
    with pytest.raises(ModelError, match="ValueCountMismatch"):
        documents.document_with(m.document, t["forcing"].where("timestep < 3"))


def test_streaming(spark, tmp_path):
    from flowspark.streaming import balances

    moves = execute.run(spark, basin(20))
    moves.repartition(3).write.parquet(str(tmp_path / "log"))
    q = balances.start(balances.running_balances(balances.read_log(spark, str(tmp_path / "log"), execute.TRANSFERS)), str(tmp_path / "c"), "complete", "live")
    q.awaitTermination(120)
    assert Counter(spark.table("live").select("endpoint", "balance").collect()) == Counter(ledger.final_stock(moves).select("endpoint", "balance").collect())


def test_violations_of_a_sweep(spark):
    bad = spark.createDataFrame([("r", "upper", "water", "none", 1.0), ("r", "upper", "water", "gain", float("nan")), ("r", "upper", "water", "gain", 1.0)], "run_id string, compartment string, substance string, parameter string, value double")
    assert Counter(r.violation for r in sweep.violations(basin(3), bad).collect()) == {"ParameterNotDeclared": 1, "NonFiniteValue": 1, "DuplicateTarget": 1}
    assert _fact_source("incoming", "x")["kind"] == "authoritative_fact"
