"""Running a model for many parameter sets at once.

Each rule has a tier. A: the amount at every (run, timestep) is one column expression over forcings and parameters.
B: it also reads facts of compartments that come before it, so all its timesteps follow at once from those compartments'
transfers, by windows. C: it reads its own or later facts, so a run goes step by step.

A model of A and B rules runs as one wide table with a row for each (run, timestep): every rule adds its counts as columns, in
topological order, and facts, lags, sums and balances are sums of such columns and windows by run. So the table is dealt
out by run once, whatever the model's size, and transfers come out of it at the end. One with a C rule runs in
``applyInPandas`` by run.

In both, a run that fails (a number that is not finite, an amount that is none, an overdraw, a substitution that the model does
not know) never stops others: ``run`` gives the transfers of the runs that complete, ``outcomes`` one row for each run.
"""

from __future__ import annotations

import math
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import numeric as N
from ..functions.quantum import MAX_COUNT, floor_count
from ..plans.expr import TRUTH, Expr
from ..plans.model import Model, ModelError, Projection, Rule, Selector
from ..sources.shared import checkpointed
from . import projection as P
from .simulate import RunError, simulate

FIELDS = ("run_id", "seq", "timestep", "source", "source_kind", "target", "target_kind", "substance", "count", "amount")
TRANSFERS = "run_id string, seq long, timestep long, source string, source_kind string, target string, target_kind string, substance string, count long, amount double"
_MOVES = "array<struct<source:string,source_kind:string,target:string,target_kind:string,substance:string,count:bigint,amount:double>>"
#: Deep models are cut after so many layers, or the plan gets too deep to be read.
CUT_LAYERS = 16
COMPLETED, FAILED = "completed", "failed"


def _steps(first: int = Window.unboundedPreceding, last: int = 0) -> WindowSpec:
    """A run's rows from `first` to `last` steps after this one."""
    return Window.partitionBy("run_id").orderBy("timestep").rowsBetween(first, last)


def _wanted(model: Model, rule: Rule) -> set[str]:
    """Names of the projections that a rule's expressions read."""
    return {n for e in _expressions(rule) for x in e.leaves() for k, n in [model.resolve(rule, x) if x.kind in ("input", "projection") else (x.kind, x.name)] if k == "projection"}


def _sources(model: Model, s: Selector) -> list[tuple[str, str, str]]:
    """The branches (compartment, substance, branch) whose transfers a selector sums."""
    return [k for k, d in model.destinations.items() if k[1] == s.substance and (k[0] if s.direction == "outgoing" else d) == s.compartment]


def tier(model: Model, rule: Rule) -> str:
    names = _wanted(model, rule)
    if not names:
        return "A"
    rank = model.topology.rank
    for p in model.projections:
        if p.id not in model.closure(names):
            continue
        if TRUTH in p.state_kinds or p.value_kind == TRUTH:
            return "C"
        for s in p.facts():
            readers = [s.compartment] if s.direction == "outgoing" else [c for c, _, _ in _sources(model, s)]
            if any(rank[c] >= rank[rule.compartment] for c in readers):
                return "C"
    return "B"


def tiers(model: Model) -> dict[tuple[str, str], str]:
    return {k: tier(model, r) for k, r in model.rules.items()}


def _expressions(rule: Rule) -> list[Expr]:
    return [rule.expression, *(e for _, e in rule.partition.branches if isinstance(e, Expr))]


def runs_of(spark: SparkSession, count: int = 1) -> DataFrame:
    return spark.range(count).select(F.format_string("run-%06d", "id").alias("run_id"))


def run(spark: SparkSession, model: Model, params: DataFrame | None = None, mode: str | None = None, forcings: DataFrame | None = None) -> DataFrame:
    """The transfers of each run that completes.

    params: run_id, compartment, substance, parameter, value (NULL parameter or value: the model's own). forcings: run_id,
    forcing_id, timestep, value, which for the runs that it names stand in place of the document's values. mode
    "sequential" forces tier C; by default the plan follows the rules' tiers.
    """
    if _stepwise(model, mode):
        return sequential(model, _params(spark, params), forcings).where("error IS NULL AND seq IS NOT NULL").select(*FIELDS)
    rows = _columnar(spark, model, _params(spark, params), forcings)
    offset = F.coalesce(F.sum(F.size("moves")).over(_steps(last=-1)), F.lit(0))
    rows = rows.where("failure IS NULL").withColumn("__offset", offset).select("run_id", "timestep", "__offset", F.posexplode("moves").alias("__n", "m"))
    return rows.select("run_id", (F.col("__offset") + F.col("__n")).alias("seq"), "timestep", *[F.col(f"m.{f}").alias(f) for f in FIELDS[3:]])


def outcomes(spark: SparkSession, model: Model, params: DataFrame | None = None, mode: str | None = None, forcings: DataFrame | None = None) -> DataFrame:
    """run_id, status (completed or failed), error (its code), timestep (of the failure, NULL before the first) and transfers, for every run."""
    if _stepwise(model, mode):
        rows = sequential(model, _params(spark, params), forcings)
        out = rows.groupBy("run_id").agg(F.max("error").alias("error"), F.max(F.when(F.col("error").isNotNull(), F.col("timestep"))).alias("timestep"), F.count("seq").alias("transfers"))
    else:
        rows = _columnar(spark, model, _params(spark, params), forcings)
        out = rows.groupBy("run_id").agg(F.max("failure").alias("f"), F.sum(F.size("moves")).alias("n")).select("run_id", F.col("f.error").alias("error"), F.col("f.timestep").alias("timestep"), F.when(F.col("f").isNull(), F.col("n")).otherwise(0).alias("transfers"))
    return out.select("run_id", F.when(F.col("error").isNull(), COMPLETED).otherwise(FAILED).alias("status"), F.regexp_extract("error", "^[A-Za-z]+", 0).alias("error"), "timestep", "transfers")


def _stepwise(model: Model, mode: str | None) -> bool:
    return mode == "sequential" or "C" in tiers(model).values()


def _params(spark: SparkSession, params: DataFrame | None) -> DataFrame:
    if params is None:
        params = runs_of(spark).selectExpr("run_id", "CAST(NULL AS string) compartment", "CAST(NULL AS string) substance", "CAST(NULL AS string) parameter", "CAST(NULL AS double) value")
    return params.select("run_id", "compartment", "substance", "parameter", "value")


# tier C


def sequential(model: Model, params: DataFrame, forcings: DataFrame | None = None) -> DataFrame:
    """Tier C: transfers, and a row with error (and no seq) for each run that fails or moves nothing (then error is NULL too)."""
    kinds = model.topology.kinds
    columns = [*FIELDS, "error"]

    def one(name: str, rows: pd.DataFrame, series: pd.DataFrame | None = None) -> pd.DataFrame:
        try:
            own: dict[tuple, float] = {}
            for r in rows[rows["given"]].itertuples():
                if (r.compartment, r.substance, r.parameter) in own:
                    raise RunError("DuplicateTarget")
                own[r.compartment, r.substance, r.parameter] = float(r.value)
            m = model.substitute(own) if own else model
            if series is not None and len(series):
                m = m.with_forcings({f: dict(zip(g["timestep"], g["value"], strict=True)) for f, g in series.groupby("forcing_id")})
            moves = simulate(m)
        except RunError as e:
            return pd.DataFrame([(name, None, e.timestep, *[None] * 7, str(e))], columns=columns)
        except ModelError as e:
            return pd.DataFrame([(name, *[None] * 9, str(e))], columns=columns)
        out = [(name, k, t, s, kinds[s], d, kinds[d], sub, n, n * model.quantum(sub), None) for k, (t, s, d, sub, n) in enumerate(moves)]
        return pd.DataFrame(out or [(name, *[None] * 10)], columns=columns)

    marked = params.withColumn("given", F.col("parameter").isNotNull() & F.col("value").isNotNull())
    schema = f"{TRANSFERS}, error string"
    if forcings is None:
        rows = marked.groupBy("run_id").applyInPandas(lambda key, rows: one(key[0], rows), schema)
    else:
        series = forcings.select("run_id", "forcing_id", "timestep", "value").join(marked.select("run_id").distinct(), "run_id", "left_semi")
        rows = marked.groupBy("run_id").cogroup(series.groupBy("run_id")).applyInPandas(lambda key, rows, own: one(key[0], rows, own), schema)
    return rows


# tiers A and B


def _parameter(compartment: str, substance: str, name: str) -> str:
    return f"p_{compartment}|{substance}|{name}"


def _moved(key: tuple[str, str, str]) -> str:
    return "n_" + "|".join(key)


def _wide(model: Model, params: DataFrame) -> DataFrame:
    """One row a run, with a column for each parameter of the model, and the code of a substitution that cannot be made."""
    targets = [(c, s, p) for (c, s), r in model.rules.items() for p in r.parameters]
    given = F.col("parameter").isNotNull() & F.col("value").isNotNull()
    name = F.concat_ws("|", "compartment", "substance", "parameter")
    rules = sorted({f"{c}|{s}" for c, s in model.rules})
    codes = [
        ("DuplicateTarget", F.count_if(given) > F.count_distinct(F.when(given, name))),
        ("RuleNotFound", F.max(given & ~F.concat_ws("|", "compartment", "substance").isin(rules))),
        ("ParameterNotDeclared", F.max(given & ~name.isin(["|".join(t) for t in targets]))),
        ("NonFiniteValue", F.max(given & (F.isnan("value") | (F.abs("value") == float("inf"))))),
    ]
    aggs = [F.coalesce(F.max(F.when(given & (name == "|".join(t)), F.col("value"))), F.lit(model.rules[t[:2]].parameters[t[2]])).alias(_parameter(*t)) for t in targets]
    return params.groupBy("run_id").agg(F.coalesce(*[F.when(found, F.lit(code)) for code, found in codes]).alias("__refused"), *aggs)


def _base(spark: SparkSession, model: Model, params: DataFrame, forcings: DataFrame | None) -> DataFrame:
    """Every (run, timestep) with parameters and forcings, dealt out by run once: all that follows is by run."""
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    base = _wide(model, params).repartition(tasks, "run_id")
    base = base.withColumn("timestep", F.explode(F.sequence(F.lit(model.first).cast("long"), F.lit(model.last).cast("long"))))
    read = {n for r in model.rules.values() for e in _expressions(r) for x in e.leaves() for k, n in [model.resolve(r, x) if x.kind == "input" else (x.kind, x.name)] if k == "forcing"}
    read |= {s for r in model.rules.values() if r.partition.kind == "exogenous_series" for _, s in r.partition.branches}
    if read:
        steps = range(model.first, model.last + 1)
        table = pd.DataFrame({"timestep": list(steps)} | {f"f_{n}": model.forcings[n] for n in sorted(read)})
        base = base.join(F.broadcast(spark.createDataFrame(table)), "timestep")  # bounded: it came in the document
    if forcings is not None and read:
        own = forcings.groupBy("run_id", "timestep").agg(*[F.max(F.when(F.col("forcing_id") == n, F.col("value"))).alias(f"g_{n}") for n in sorted(read)])
        named = forcings.groupBy("run_id").agg(*[F.max(F.col("forcing_id") == n).alias(f"h_{n}") for n in sorted(read)])
        base = base.join(own, ["run_id", "timestep"], "left").join(named, "run_id", "left").repartition(tasks, "run_id")
        values = {f"f_{n}": F.when(F.col(f"`h_{n}`"), F.col(f"`g_{n}`")).otherwise(F.col(f"`f_{n}`")) for n in sorted(read)}
        base = base.withColumns(values).drop(*[f"{k}_{n}" for k in "gh" for n in read])
    return base


def _layers(model: Model) -> list[list[Rule]]:
    """Rules in turn order, dealt to layers: each reads facts of rules in layers before its own."""
    depth: dict[tuple[str, str], int] = {}
    out: list[list[Rule]] = []
    for rule in (model.rules[c, s] for c in model.topology.order for s in model.substances if (c, s) in model.rules):
        closure = model.closure(_wanted(model, rule))
        read = {k[:2] for p in model.projections if p.id in closure for f in p.facts() for k in _sources(model, f)}
        depth[rule.compartment, rule.substance] = own = max([depth[k] + 1 for k in read], default=0)
        out += [[]] if own == len(out) else []
        out[own].append(rule)
    return out


def _columnar(spark: SparkSession, model: Model, params: DataFrame, forcings: DataFrame | None = None) -> DataFrame:
    """run_id, timestep, moves (the step's transfers in log order) and failure (of the run, the same in all its rows: timestep, error)."""
    with N.quiet():
        rows = _base(spark, model, params, forcings)
        facts: set[str] = set()
        for k, rules in enumerate(_layers(model)):
            if k and k % CUT_LAYERS == 0:
                rows = checkpointed(rows)
            rows = _layer(model, rules, rows, facts)
        errors: list[Column] = []
        done: list[tuple[str, str, str]] = []
        for rule in (model.rules[c, s] for c in model.topology.order for s in model.substances if (c, s) in model.rules):
            own = [(rule.compartment, rule.substance, b) for b, _ in rule.partition.branches]
            done += own
            errors += [F.col(f"`e_{rule.compartment}|{rule.substance}`"), *([_overdraw(model, rule)] if own else [])]
        moves = F.filter(F.array(*[_transfer(model, k) for k in done]), lambda m: m["count"] > 0) if done else F.array().cast(_MOVES)
        error = F.coalesce(F.col("__refused"), *errors)
        rows = rows.withColumn("__error", error).select("run_id", "timestep", moves.alias("moves"), F.when(F.col("__error").isNotNull(), F.struct(F.when(F.col("__refused").isNull(), F.col("timestep")).alias("timestep"), F.col("__error").alias("error"))).alias("failure"))
        return rows.withColumn("failure", F.min("failure").over(Window.partitionBy("run_id")))


def _transfer(model: Model, key: tuple[str, str, str]) -> Column:
    c, s, _ = key
    d, kinds, n = model.destinations[key], model.topology.kinds, F.coalesce(F.col(f"`{_moved(key)}`"), F.lit(0).cast("long"))
    return F.struct(
        F.lit(c).alias("source"), F.lit(kinds[c]).alias("source_kind"), F.lit(d).alias("target"), F.lit(kinds[d]).alias("target_kind"), F.lit(s).alias("substance"),
        n.alias("count"), (n.cast("double") * F.lit(model.quantum(s))).alias("amount"),
    )


def _overdraw(model: Model, rule: Rule) -> Column:
    """A turn comes after all that flows in within its step, so it overdraws if the balance after it is negative."""
    c, s = rule.compartment, rule.substance
    change = lambda keys: reduce(Column.__add__, [F.coalesce(F.col(f"`{_moved(k)}`"), F.lit(0)) for k in keys], F.lit(0).cast("long"))
    net = change(_sources(model, Selector("incoming", c, s))) - change(_sources(model, Selector("outgoing", c, s)))
    return F.when(F.sum(net).over(_steps()) + F.lit(model.initial_count(c, s)) < 0, F.lit("RuleOverdraw"))


def _layer(model: Model, rules: list[Rule], rows: DataFrame, facts: set[str]) -> DataFrame:
    """rows with the count of each branch of these rules (NULL where it fails), and e_ with the code of each rule's failure.

    What the rules need is added for all of them at once, so the plan deepens by the layer and not by the rule.
    """
    closures = [[p for p in model.projections if p.id in model.closure(_wanted(model, r))] for r in rules]
    new = {_fact_name(s): s for own in closures for p in own for s in p.facts() if _fact_name(s) not in facts}
    rows = _added(rows, {f"{k}_{n}": x for n, s in new.items() for k, x in zip("cv", _fact(model, s), strict=True)})
    facts.update(new)
    level: dict[str, int] = {}
    for p in model.projections:
        level[p.id] = 1 + max((level[n] for n in p.earlier()), default=-1)
    failures: list[list[Column]] = [[] for _ in rules]
    for depth in sorted(set(level.values())):
        at = [(k, p) for k, own in enumerate(closures) for p in own if level[p.id] == depth]
        rows = _added(rows, {n: x for k, p in at if p.kind != "finite_recurrence" for n, x in _windowed(model, rules[k], p).items()})
        for k, p in at:
            name = _place(rules[k], p.id)
            if p.kind == "finite_recurrence":
                rows = _recurrence(rules[k], rows, p)
                value = F.col(f"`v_{name}`")
                failures[k] += [F.when(F.isnan(value), F.lit("Numerical")).when(value == -math.inf, F.lit("InvalidAmount"))]
            elif p.kind == "ordered_rolling_aggregate":
                failures[k] += [F.when(F.col(f"`c_{name}`") > MAX_COUNT, F.lit("ProjectionCountOverflow"))]
    parts = [_parts(model, r) for r in rules]
    rows = _added(rows, {f"__a{k}_{n}": x for k, own in enumerate(parts) for n, (x, _, _) in enumerate(own)})  # columns of their own: counts refer to them many times
    amount = lambda k, n: F.col(f"__a{k}_{n}")
    rows = _added(rows, {f"__n{k}_{n}": F.coalesce(c, floor_count(amount(k, n), F.lit(model.quantum(rules[k].substance)))) for k, own in enumerate(parts) for n, (_, c, _) in enumerate(own)})
    named = {b: F.col(f"__n{k}_{n}") for k, own in enumerate(parts) for n, (_, _, b) in enumerate(own) if b}
    for k, r in enumerate(rules):
        for n in range(len(parts[k])):
            failures[k] += [F.when(F.isnan(amount(k, n)), F.lit("Numerical")).when(F.col(f"__n{k}_{n}").isNull(), F.lit("InvalidAmount"))]
        named[f"e_{r.compartment}|{r.substance}"] = F.coalesce(*failures[k])
    scratch = [c for c in rows.columns if c.startswith(("__a", "__n"))]
    return _added(rows, named).drop(*scratch)


def _added(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return rows.withColumns(columns) if columns else rows


def _parts(model: Model, rule: Rule) -> list[tuple[Column, Column, str | None]]:
    """What a rule evaluates, in order: amount, exact count (or NULL) and the branch that takes it, if any."""

    def leaf(x: Expr) -> Column:
        kind, name = model.resolve(rule, x)
        if kind == "parameter":
            return F.col(f"`{_parameter(rule.compartment, rule.substance, name)}`")
        return F.col(f"`f_{name}`") if kind == "forcing" else F.col(f"`v_{_place(rule, name)}`")

    none = F.lit(None).cast("long")

    def count(e: Expr) -> Column:
        """The exact count of an expression that only reads or chooses one of this substance; else NULL."""
        if e.kind in ("input", "projection"):
            kind, name = model.resolve(rule, e)
            if kind == "projection" and _substance(model, name) == rule.substance:
                return F.col(f"`c_{_place(rule, name)}`")
        if e.kind == "select":
            return F.when(e.args[0].column(leaf, model.tables), count(e.args[1])).otherwise(count(e.args[2]))
        return none

    whole = lambda e: (N.finite(e.column(leaf, model.tables), "amount"), count(e))
    branch = lambda b: _moved((rule.compartment, rule.substance, b))
    p = rule.partition
    if p.kind == "expression_partition":
        return [(*whole(e), branch(b)) for b, e in p.branches]
    amount, exact = whole(rule.expression)
    if p.kind == "release_all":
        return [(amount, exact, branch(p.branches[0][0]))]
    out = [(amount, exact, None)]  # it must be an amount even where nothing of it moves
    if p.kind == "exogenous_series":
        return out + [(N.finite(F.col(f"`f_{s}`")), none, branch(b)) for b, s in p.branches]
    return out + [(N.finite(amount * F.lit(f)), none, branch(b)) for b, f in p.branches]


def _substance(model: Model, name: str) -> str | None:
    """The substance whose exact counts a projection carries; a recurrence carries none here."""
    p = next(p for p in model.projections if p.id == name)
    if p.kind == "finite_recurrence":
        return None
    return p.source.substance if isinstance(p.source, Selector) else _substance(model, p.source)


def _fact_name(s: Selector) -> str:
    return f"{s.direction}|{s.compartment}|{s.substance}"


def _place(rule: Rule, projection: str) -> str:
    """A recurrence reads its rule's parameters, so every rule has projections of its own."""
    return f"{rule.compartment}|{rule.substance}|{projection}"


def _fact(model: Model, s: Selector) -> tuple[Column, Column]:
    """The selector's count and amount at each timestep; 0 when dry. All its branches have had their turn."""
    counts = [F.col(f"`{_moved(k)}`") for k in _sources(model, s)]
    n = reduce(Column.__add__, counts, F.lit(0).cast("long"))
    return n, n.cast("double") * F.lit(model.quantum(s.substance))


def _windowed(model: Model, rule: Rule, p: Projection) -> dict[str, Column]:
    """v_ and c_ of a lag or a rolling sum."""
    out, source = _place(rule, p.id), _fact_name(p.source) if isinstance(p.source, Selector) else _place(rule, p.source)
    v, c, age = F.col(f"`v_{source}`"), F.col(f"`c_{source}`"), F.col("timestep") - F.lit(model.first)
    if p.kind == "bounded_lag":
        w = Window.partitionBy("run_id").orderBy("timestep")
        first = F.element_at(F.array(*[F.lit(float(x)) for x in p.initial]), F.least(age + 1, F.lit(p.span)).cast("int"))
        return {f"v_{out}": F.when(age < p.span, first).otherwise(F.lag(v, p.span).over(w)), f"c_{out}": F.lag(c, p.span).over(w)}
    w = _steps(-(p.span - 1))
    got = F.collect_list(v).over(w)
    if p.initial:
        missing = F.greatest(F.lit(p.span - 1) - age, F.lit(0)).cast("int")
        got = F.concat(F.slice(F.array(*[F.lit(float(x)) for x in p.initial]), F.lit(p.span) - missing, missing), got)
    return {f"v_{out}": N.ordered_sum(got), f"c_{out}": F.when(F.count(c).over(w) == p.span, F.sum(c).over(w))}


def _recurrence(rule: Rule, rows: DataFrame, p: Projection) -> DataFrame:
    """rows with v_ (NaN where a number is not finite, minus infinity where an extensive state is negative) and c_ (NULL)."""
    out, inputs = _place(rule, p.id), dict(p.inputs)
    read = {n: f"v_{_fact_name(s)}" for n, s in p.inputs if isinstance(s, Selector)} | {n: f"v_{_place(rule, n)}" for n in p.earlier()}
    own = [_parameter(rule.compartment, rule.substance, n) for n in p.parameters]
    place = {n: f"__x{k}" for k, n in enumerate(read)}
    rows = _added(rows, {f"__x{k}": F.col(f"`{c}`") for k, c in enumerate([*read.values(), *own])})

    def update(slots: list[Column], x: Column) -> list[Column]:
        def leaf(e: Expr) -> Column:
            if e.kind == "parameter":
                return x[f"__x{len(read) + p.parameters.index(e.name)}"]
            if e.kind == "input" and not isinstance(inputs[e.name], Selector):
                return slots[inputs[e.name]]
            return x[place[e.name]]

        new = [N.finite(u.column(leaf, {})) for u in p.updates]
        # a state that cannot be is minus infinity, which no later step takes for a number
        return [F.when(v < 0, F.lit(-math.inf)).otherwise(v) if kind == "extensive" else v for v, kind in zip(new, p.state_kinds)]

    def told(slots: list[Column]) -> Column:
        return F.coalesce(*[F.when(F.isnan(v) | (v == -math.inf), v) for v in slots], slots[p.output])

    rows = P.recurrence(rows, ["run_id"], None, [float(v) for v in p.initial], update, told, f"v_{out}")
    return rows.withColumn(f"c_{out}", F.lit(None).cast("long")).drop(*[f"__x{k}" for k in range(len(read) + len(own))])
