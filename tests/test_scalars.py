"""Numbers, quanta, expressions, topology: exact values."""

import math
import random
import struct
from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from flowspark.functions import numeric as N
from flowspark.functions.quantum import MAX_COUNT, scalar_floor_count, scalar_whole_count
from flowspark.operators.execute import runs_of
from flowspark.plans.expr import MAX_DEPTH, Expr, ExprError, add, clamp, compare, divide, forcing, lit, maximum, minimum, multiply, param, power, select, subtract, table_lookup
from flowspark.plans.model import Table
from flowspark.plans.topology import Topology, TopologyError, topological_order
from flowspark.sources.documents import parse_run_id


def bits(x):
    return struct.pack(">d", x).hex()


def test_sums_keep_their_order():
    assert bits(N.scalar_sum([1e16, 1, 1])) == "4341c37937e08000"
    assert bits(N.scalar_sum([1, 1, 1e16])) == "4341c37937e08001"
    assert bits(N.check(-0.0)) == bits(0.0)
    for bad in (math.inf, math.nan):
        with pytest.raises(N.NumericError):
            N.check(bad)
    with pytest.raises(N.NumericError):
        N.scalar_sum([1e308, 1e308])


def test_power_and_division():
    assert N.scalar_power(6.25, 0.5) == 2.5
    for a, b in ((0.0, -1.0), (-1.0, 0.5)):
        with pytest.raises(N.NumericError):
            N.scalar_power(a, b)
    with pytest.raises(N.NumericError):
        N.scalar_divide(1.0, 0.0)
    with pytest.raises(N.NumericError):
        N.scalar_clamp(1.0, 2.0, 1.0)


def test_interpolation():
    knots = [(0.0, 1.0), (10.0, 2.0), (20.0, 4.0)]
    assert [N.scalar_interpolate(x, knots, "clamp_to_endpoint") for x in (-5, 0, 5, 10, 15, 25)] == [1, 1, 1.5, 2, 3, 4]
    assert [N.scalar_interpolate(x, knots, "linear_extrapolate") for x in (-10, 30)] == [0, 6]
    with pytest.raises(N.NumericError):
        N.scalar_interpolate(-1, knots, "reject")


@given(st.integers(0, 10**9), st.sampled_from([1e-6, 0.01, 0.1, 0.125, 1.0, 2.5]))
@settings(max_examples=300)
def test_an_exact_image_gives_its_count(n, q):
    assert scalar_floor_count(n * q, q) == n


@given(st.floats(0, 1e9), st.sampled_from([1e-6, 0.01, 0.1, 0.125, 1.0]))
@settings(max_examples=300)
def test_floor_is_below_and_near(v, q):
    n = scalar_floor_count(v, q)
    if scalar_whole_count(v, q) is None:
        assert n * q <= v
    assert abs(Fraction(v) - n * Fraction(q)) < Fraction(q) * 2


def test_quantum_edges():
    assert scalar_floor_count(4.3, 0.1) == 43
    assert scalar_floor_count(0.9, 1.0) == 0
    assert scalar_floor_count(-1.0, 1.0) is None
    assert scalar_floor_count(math.inf, 1.0) is None
    assert scalar_floor_count(float(MAX_COUNT) * 4, 1.0) is None


def test_expression_types_and_round_trip():
    e = select(compare("less_than", forcing("x"), lit(2)), clamp(multiply(param("k"), forcing("x")), lit(0), lit(9)), add(minimum(lit(1), lit(2)), maximum(power(lit(2), lit(3)), divide(subtract(lit(1), lit(4)), lit(2)))))
    assert Expr.from_dict(e.to_dict()) == e
    t = table_lookup("t", forcing("x"))
    assert Expr.from_dict(t.to_dict()) == t
    tables = {"t": Table("t", ((0.0, 0.0), (1.0, 10.0)), "reject")}
    assert t.value(lambda x: 0.25, tables) == 2.5
    assert e.value(lambda x: {"x": 1.0, "k": 3.0}[x.name], {}) == 3.0
    with pytest.raises(ExprError):
        add(compare("equal", lit(1), lit(1)), lit(1))
    with pytest.raises(ExprError):
        lit(math.inf)
    with pytest.raises(ExprError):
        Expr.from_dict({"kind": "literal", "value": 1, "more": 2})
    deep = lit(0)
    with pytest.raises(ExprError):
        for _ in range(MAX_DEPTH + 1):
            deep = add(deep, lit(1))


def test_select_is_lazy():
    e = select(compare("equal", lit(0), lit(0)), lit(1), divide(lit(1), lit(0)))
    assert e.value(lambda x: 0.0, {}) == 1.0


def test_topology():
    assert topological_order(["c", "b", "a"], [("c", "a")]) == ["b", "c", "a"]
    with pytest.raises(TopologyError, match="Cycle"):
        topological_order(["a", "b"], [("a", "b"), ("b", "a")])
    t = Topology(["a", "b", "c"], ["sea"], [("a", "sea"), ("b", "c"), ("c", "sea")])
    assert t.parts() == {"a": "a", "b": "b", "c": "b", "sea": "sea"}
    for finite, edges in ((["a", "a"], []), (["a"], [("a", "x")]), (["a", "b"], [("a", "b"), ("a", "b")])):
        with pytest.raises(TopologyError):
            Topology(finite, [], edges)


def test_run_ids():
    assert parse_run_id("00112233-4455-6677-8899-AABBCCDDEEFF") == "00112233445566778899aabbccddeeff"
    assert parse_run_id(bytes(16)) == "0" * 32
    with pytest.raises(ValueError):
        parse_run_id("12")


def test_columns_equal_scalars(spark):
    from pyspark.sql import functions as F

    from flowspark.functions.quantum import floor_count, whole_count

    r = random.Random(5)
    rows = [(r.uniform(0, 100) if r.random() < 0.5 else r.randrange(10000) * q, q) for q in (1e-6, 0.01, 0.1, 0.125, 1.0) for _ in range(300)]
    out = spark.createDataFrame(rows, "v double, q double").select("v", "q", floor_count(F.col("v"), F.col("q")).alias("f"), whole_count(F.col("v"), F.col("q")).alias("w")).collect()
    assert all(x.f == scalar_floor_count(x.v, x.q) and x.w == scalar_whole_count(x.v, x.q) for x in out)
    assert runs_of(spark, 3).count() == 3


def test_columns_reject_what_scalars_reject(spark):
    from pyspark.sql import functions as F

    one = spark.range(1).select(F.lit(1e308).alias("big"), F.lit(0.0).alias("zero"))
    for bad in (N.finite(N.multiply(F.col("big"), 10.0)), N.divide(F.col("big"), F.col("zero")), N.minimum(F.col("big") * 10, F.lit(1.0)), N.clamp(F.col("zero"), 2.0, 1.0)):
        with pytest.raises(Exception, match="NON_FINITE|CLAMP"):
            one.select(bad.alias("x")).collect()
