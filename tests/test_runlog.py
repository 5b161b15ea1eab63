"""Logs as evidence: genesis, digests, seals, reading, resuming; and ledgers of runs and cells that never move."""

import json
import random

import pytest
from pyspark.sql import functions as F

from flowspark.functions import numeric as N
from flowspark.operators import execute, ledger, partition, runlog, series, sweep
from flowspark.plans.model import Model
from flowspark.queries import basin, published_sweep
from flowspark.sources import documents, log


@pytest.fixture(scope="module")
def held(spark):
    """Three runs of a model with another gain each, their genesis, transfers and seals."""
    m = basin(12)
    params = sweep.sweep(spark, 3, ("upper", "water", "gain"), 0.5 + F.col("id") * 0.25)
    digests = runlog.model_digests(m, params).cache()
    begun = runlog.genesis(spark, m, digests).cache()
    moves = execute.run(spark, m, params).cache()
    return m, params, digests, begun, moves, runlog.seals(begun, moves, m.last).cache()


def codes(df):
    return sorted({(x.run_id, x.violation) for x in df.collect()})


def test_completed_runs_read_back(spark, held):
    m, params, digests, begun, moves, seals = held
    assert {x.model_digest for x in digests.collect()} == {m.substitute({("upper", "water", "gain"): g}).digest for g in (0.5, 0.75, 1.0)}
    states = runlog.read(m, begun, moves, seals, digests).collect()
    assert {(x.status, x.last_timestep, x.violation) for x in states} == {("complete", 12, None)} and sum(x.transfers for x in states) == moves.count()
    log_, refused = runlog.read_completed(m, begun, moves, seals.where("run_id <> 'run-000001'"), digests)
    assert codes(refused) == [("run-000001", "MissingCompletionSeal")] and log_.count() == moves.where("run_id <> 'run-000001'").count()
    assert {x.run_id for x in runlog.replay_against(begun, m).collect()} == {"run-000001", "run-000002"}
    assert {x.violation for x in runlog.read(m, begun, moves, seals).collect()} == {None, "ModelDigestMismatch"}


def test_digests_cover_genesis_and_amounts(spark, held):
    _, _, _, begun, moves, seals = held
    plain = {x.run_id: x.log_digest for x in seals.collect()}
    other = {x.run_id: x.log_digest for x in log.digests(begun.withColumn("count", F.col("count") + F.when(F.col("endpoint") == "lower", 1).otherwise(0)), moves).collect()}
    bits = {x.run_id: x.log_digest for x in log.digests(begun, moves.withColumn("amount", F.when(F.col("seq") == 3, F.col("amount") * (1 + 2.0**-52)).otherwise(F.col("amount")))).collect()}
    same = {x.run_id: x.log_digest for x in log.digests(begun.repartition(5), moves.repartition(7)).collect()}
    assert same == plain and all(other[k] != plain[k] != bits[k] for k in plain)
    values = [0.1, 1.0, 5e-324, 2.0**53, 0.1 + 0.2, 0.3]
    texts = [x.t for x in spark.createDataFrame([(v,) for v in values], "v double").select(log.bits(F.col("v")).alias("t")).collect()]
    assert len(set(texts)) == len(values)


def test_each_break_of_a_log_is_named(spark, held):
    m, _, _, begun, moves, seals = held
    one, rest = F.col("run_id") == "run-000001", F.col("run_id") != "run-000001"
    check = lambda g=begun, t=moves, s=seals, runs=None: codes(runlog.log_violations(g, t, s, runs))
    assert check() == []
    assert ("run-000001", "GenesisNotFirst") in check(g=begun.where(rest))
    assert check(runs=spark.createDataFrame([("nothing",)], "run_id string")) == [("nothing", "MissingGenesis")]
    assert ("run-000001", "RepeatedGenesis") in check(g=begun.unionAll(begun.where(one)))
    assert check(s=seals.unionAll(seals.where(one))) == [("run-000001", "AlreadySealed")]
    assert check(s=seals.withColumn("transfer_count", F.col("transfer_count") + F.when(one, 1).otherwise(0))) == [("run-000001", "SealTransferCount")]
    assert check(s=seals.withColumn("log_digest", F.when(one, "0").otherwise(F.col("log_digest")))) == [("run-000001", "SealDigest")]
    assert check(s=seals.withColumn("final_timestep", F.when(one, 3).otherwise(F.col("final_timestep")).cast("long"))) == [("run-000001", "SealFinalTimestep")]
    assert check(s=seals.withColumn("transfer_count", F.col("transfer_count") - F.when(one, 2).otherwise(0))) == [("run-000001", "RecordAfterSeal")]
    assert ("run-000001", "TimestepOrder") in check(t=moves.withColumn("timestep", F.when(one & (F.col("seq") == 9), 0).otherwise(F.col("timestep")).cast("long")))


def test_each_transfer_that_a_model_cannot_make_is_named(spark, held):
    m, _, _, _, moves, _ = held
    at = lambda column, value, kind: moves.withColumn(column, F.when(F.col("seq") == 5, value).otherwise(F.col(column)).cast(kind))
    named = lambda rows: {x.violation for x in runlog.transfer_violations(m, rows).collect()}
    assert named(moves) == set()
    assert named(at("timestep", 99, "long")) == {"TimestepOutsideHorizon"}
    assert "UnknownEndpoint" in named(at("target", "nowhere", "string"))
    assert "EndpointKindMismatch" in named(at("target_kind", "other", "string"))
    assert named(at("target", F.col("source"), "string")) == {"SelfTransfer"}
    assert "TransferRegistryMismatch" in named(at("substance", "salt", "string"))
    assert named(at("amount", 0.1, "double")) == {"NonQuantumTransfer"}
    assert {"CountAboveCeiling", "Overdraw"} <= named(at("count", 1 << 60, "long"))
    back = moves.withColumns({"source": F.col("target"), "target": F.col("source"), "source_kind": F.col("target_kind"), "target_kind": F.col("source_kind")})
    assert "UndeclaredConnection" in named(back)


def test_resuming_replaces_a_prefix_that_agrees(spark, held):
    m, params, _, _, moves, _ = held
    prefix = moves.where("seq < 7")
    whole, differs = runlog.resume(spark, m, prefix.withColumn("count", F.col("count") + F.when((F.col("run_id") == "run-000002") & (F.col("seq") == 4), 1).otherwise(0)), params)
    assert {(x.run_id, x.seq) for x in differs.collect()} == {("run-000002", 4)}
    assert sorted(whole.select(*execute.FIELDS).collect()) == sorted(moves.where("run_id <> 'run-000002'").select(*execute.FIELDS).collect())


def test_runs_and_cells_that_never_move(spark):
    m = published_sweep(5)
    grid = sweep.sweep(spark, 3, ("basin-00", "water", "release-coefficient"), F.col("id") * 0.5 - F.when(F.col("id") == 2, 9.0).otherwise(0.0))
    outcomes = execute.outcomes(spark, m, grid).cache()
    assert {(x.run_id, x.status, x.error) for x in outcomes.collect()} == {("run-000000", "completed", None), ("run-000001", "completed", None), ("run-000002", "failed", "InvalidAmount")}
    moves, runs = execute.run(spark, m, grid), outcomes.where("status = 'completed'").select("run_id")
    t = documents.tables_of(spark, m)
    seeds = ledger.seed_cells(t["endpoints"].where("kind = 'finite'"), t["substances"], t["initial_stocks"])
    assert ledger.final_stock(moves, seeds, runs).count() == 100
    begun = runlog.genesis(spark, m, runs.withColumn("model_digest", F.lit(m.digest)))
    seals = runlog.seals(begun, moves, m.last)
    assert {(x.status, x.transfers) for x in runlog.read(m, begun, moves, seals).collect()} == {("complete", 0)}
    assert {(x.status) for x in ledger.run_status(moves, seals.where("run_id = 'run-000000'"), runs).collect()} == {"complete", "resumable"}
    read = series.ranged_runs(moves, runs, "outgoing", "basin-00", "water", (0, 5), (-1, 6), 1e-6).collect()
    assert {(x.timestep, x.presence, x["count"]) for x in read} == {(-1, "absent", None), (6, "absent", None), *((k, "present", 0) for k in range(6))} and len(read) == 16
    steps = runs.select("run_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long"))).alias("timestep"))
    assert ledger.snapshots(moves, steps, seeds).count() == 600


def test_state_at(spark, held):
    m, _, _, _, moves, _ = held
    cells = spark.createDataFrame([("upper", "water", 400000, True), ("none", "water", 0, False)], "endpoint string, substance string, count long, modelled boolean")
    states = spark.createDataFrame([("run-000000", 12), ("run-000001", 3), ("nothing", None)], "run_id string, last_timestep long")
    found = {(x.run_id, x.endpoint): (x.presence, x.balance) for x in runlog.state_at(moves, cells, states, 5, 0).collect()}
    out = moves.where("run_id = 'run-000000' AND source = 'upper' AND timestep <= 5").agg(F.sum("count")).first()[0]
    assert found["run-000000", "upper"] == ("present", 400000 - out) and found["run-000001", "upper"] == found["nothing", "upper"] == ("absent", None)
    assert found["run-000000", "none"] == ("not_modelled", None)


def test_amounts_that_cannot_move_are_told(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, -1.0), (3, float("nan")), (4, float("inf")), (5, None), (6, 1e17), (7, 0.5)], "id int, v double")
    branches = [("a", F.col("v"))]
    assert {x.id for x in partition.violations(rows, branches, F.lit(1.0), ["id"]).collect()} == {2, 3, 4, 5, 6}
    assert {(x.id, x["count"]) for x in partition.split(rows, branches, F.lit(1.0), ["id"]).collect()} == {(1, 2)}
    assert {x.id for x in partition.retain_all(rows, F.col("v"), F.lit(1.0), ["id"]).collect()} == {2, 3, 4, 5, 6}


def test_interpolation_by_join_equals_the_ladder(spark):
    """Tables of several sizes and policies, values at, between and outside their knots, against the scalar form."""
    r = random.Random(8)
    tables = {f"t{n}{p}": (sorted({r.randrange(10**6) / 64 for _ in range(n)}), p) for n in (2, 3, 40, 500) for p in N.POLICIES}
    knots = {t: ([(x, r.uniform(-5, 5)) for x in xs], p) for t, (xs, p) in tables.items()}
    rows = []
    for t, (k, _) in knots.items():
        rows += [(t, v) for v in [*r.sample([x for x, _ in k], 2), k[0][0] - 1, k[-1][0] + 2.5, k[0][0], k[-1][0], *(r.uniform(k[0][0], k[-1][0]) for _ in range(30))]]
    rows.append(("none", 1.0))
    made = N.interpolate_join(spark.createDataFrame(rows, "table_id string, v double"), spark.createDataFrame([(t, x, y, p) for t, (k, p) in knots.items() for x, y in k], "table_id string, x double, y double, policy string"), "v")
    found = made.collect()
    assert len(found) == len(rows)
    for x in found:
        k, p = knots.get(x.table_id, ([], "reject"))
        outside = not k or not k[0][0] <= x.v <= k[-1][0]
        assert (x.y is None) if outside and p == "reject" else abs(x.y - N.scalar_interpolate(x.v, k, p)) <= 1e-9 * max(1, abs(x.y)), x


def test_documents_without_rules_for_stocks_are_refused():
    d = json.loads(json.dumps(basin(3).document))
    d["rules"] = [x for x in d["rules"] if x["compartment"] != "lower"]
    d["transfer_bindings"] = [x for x in d["transfer_bindings"] if x["compartment"] != "lower"]
    assert Model.from_document(d).rules.keys() == {("upper", "water")}


def test_handle(spark, held):
    from flowspark.operators.handle import Runs

    m, params, digests, _, moves, seals = held
    runs = Runs(spark, m, params.unionAll(spark.createDataFrame([("bad", "upper", "water", "gain", -9.0)], params.schema)))
    assert {(x.run_id, x.status) for x in runs.status().collect()} == {*((f"run-00000{k}", "completed") for k in range(3)), ("bad", "failed")}
    records, evidence = runs.authoritative_log()
    assert {x.run_id: x.log_digest for x in evidence.collect()} == {x.run_id: x.log_digest for x in seals.collect()}
    assert log.grammar_violations(records).count() == 0 and records.count() == moves.count() + 6
    assert {x.run_id for x in runs.replay_against(m).collect()} == {"run-000001", "run-000002"}
    assert runs.quantum("water") == 0.25
    assert sum(x["count"] for x in runs.series("outgoing", "upper", "water").collect()) == moves.where("source = 'upper'").agg(F.sum("count")).first()[0]
    assert {x.presence for x in runs.series("incoming", "nowhere", "water", (-1, 2)).collect()} == {"not_modelled"}


def test_built_documents_equal_written_ones():
    from flowspark.plans import builders as B
    from flowspark.plans.expr import lit, param

    rules = [B.rule("a", "water", param("k"), B.fixed_fraction_split(0.5, east=0.25, west=0.25), {"k": 1.0}), B.rule("b", "water", lit(0), B.expression_partition({"out": lit(1)})), B.rule("c", "water", lit(0), B.constant_fraction("out", 0.5)), B.rule("d", "water", lit(0), B.exogenous("out", "f"))]
    edges = [("a", "b"), ("a", "c"), ("b", "sea"), ("c", "sea"), ("d", "sea")]
    bindings = {("a", "water", "east"): "b", ("a", "water", "west"): "c", **{(c, "water", "out"): "sea" for c in "bcd"}}
    d = B.model_document(list("abcd"), ["sea"], edges, {(c, "water"): 9.0 for c in "abcd"}, {"water": ("m3", 0.5)}, (0, 1), rules, bindings, forcings={"f": [1.0, 2.0]})
    m = Model.from_document(d)
    assert Model.from_document(json.loads(json.dumps(m.document))).digest == m.digest and {r.partition.kind for r in m.rules.values()} == {"fixed_fraction_split", "expression_partition", "constant_fraction_transfer", "exogenous_series"}
    assert B.rolling_sum(B.fact("incoming", "a", "water"), 3)["window"] == 3
