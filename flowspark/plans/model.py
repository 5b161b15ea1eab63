"""The model: a validated, content-addressed bundle read from one plain document.

``Model.from_document`` reads the version 1 document (unknown fields are errors) and checks it as a whole; a failed check
is a ``ModelError`` whose first word names it. ``Model.document`` gives the document back. ``Model.digest`` is a SHA-256 of
a canonical form: any change of content changes it, the order in which an author lists things does not.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Mapping
from dataclasses import dataclass, field, replace
from functools import cached_property
from typing import Any

from ..functions.quantum import MAX_COUNT, scalar_floor_count
from .expr import TRUTH, Expr, ExprError, known
from .topology import Topology, TopologyError

GRAMMAR = re.compile("[a-z][a-z0-9_-]*")
MAX_NESTING = 256
_V1 = "v1"


class ModelError(ValueError):
    """A document or model that fails a check."""


def require(ok: bool, code: str, detail: Any = "") -> None:
    if not ok:
        raise ModelError(f"{code}: {detail}" if detail != "" else code)


def identity(text: Any, what: str = "identity") -> str:
    require(isinstance(text, str) and text != "", "Empty", what)
    require(bool(re.match("[a-z]", text)), "InvalidStart", text)
    require(bool(GRAMMAR.fullmatch(text)), "InvalidCharacter", text)
    return text


def number(x: Any, what: str, least: float | None = None) -> float:
    require(isinstance(x, int | float) and not isinstance(x, bool) and math.isfinite(x), "NonFinite", what)
    require(least is None or x >= least, "Negative", what)
    return float(x) + 0.0


def unique(items: list, code: str) -> None:
    seen = set()
    for x in items:
        require(x not in seen, code, x)
        seen.add(x)


def check_nesting(document: Any) -> None:
    """Deep or cyclic documents are errors, found without recursion."""
    stack, path = [(document, 0, False)], set()
    while stack:
        node, depth, leave = stack.pop()
        if leave:
            path.discard(id(node))
        elif isinstance(node, dict | list | tuple):
            require(id(node) not in path, "CyclicDocument")
            require(depth < MAX_NESTING, "DocumentTooDeep")
            path.add(id(node))
            stack.append((node, depth, True))
            stack += [(x, depth + 1, False) for x in (node.values() if isinstance(node, dict) else node)]


@dataclass(frozen=True)
class Table:
    id: str
    knots: tuple[tuple[float, float], ...]
    policy: str


@dataclass(frozen=True)
class Selector:
    """Transfers into or out of a compartment."""

    direction: str
    compartment: str
    substance: str


@dataclass(frozen=True)
class Projection:
    id: str
    kind: str  # bounded_lag, ordered_rolling_aggregate, finite_recurrence
    value_kind: str
    source: Selector | str | None = None  # a name is an earlier projection
    span: int = 0  # steps or window
    state_kinds: tuple[str, ...] = ()
    inputs: tuple[tuple[str, Selector | int], ...] = ()
    parameters: tuple[str, ...] = ()
    updates: tuple[Expr, ...] = ()
    output: int = 0
    initial: tuple[float | bool, ...] = ()

    def facts(self) -> list[Selector]:
        own = [self.source] if isinstance(self.source, Selector) else []
        return own + [s for _, s in self.inputs if isinstance(s, Selector)]

    def earlier(self) -> set[str]:
        own = {self.source} if isinstance(self.source, str) else set()
        return own.union(*(u.names("projection") for u in self.updates))


@dataclass(frozen=True)
class Partition:
    """How an amount is split: kind, and for each branch in name order a fraction, an expression or a series."""

    kind: str
    branches: tuple[tuple[str, Any], ...] = ()
    retained: float = 0.0


@dataclass(frozen=True)
class Rule:
    compartment: str
    substance: str
    expression: Expr
    partition: Partition
    parameters: Mapping[str, float] = field(default_factory=dict)


def _versions(node: Mapping, *fields: str) -> None:
    known(node, "rule_ir_version", "numerical_semantics_version", *fields)
    require(node.get("rule_ir_version") == _V1, "RuleIrVersionMismatch")
    require(node.get("numerical_semantics_version") == _V1, "NumericalVersionMismatch")


def _expression(node: Mapping) -> Expr:
    _versions(node, "expression")
    return Expr.from_dict(node["expression"])


def _selector(node: Mapping) -> Selector:
    known(node, "kind", "compartment", "substance")
    require(node["kind"] in ("incoming_transfer_amount", "outgoing_transfer_amount"), "UnknownKind", node["kind"])
    return Selector(node["kind"].split("_")[0], identity(node["compartment"]), identity(node["substance"]))


def _fraction(x: Any) -> float:
    x = number(x, "fraction")
    require(0 <= x <= 1, "OutOfRange", x)
    return x


def _partition(node: Mapping) -> Partition:
    _versions(node, "partition")
    p = node["partition"]
    kind = p.get("kind")
    fields = {"retain_all": (), "release_all": ("branch",), "fixed_fraction_split": ("retained_fraction", "branches"), "exogenous_series": ("branch", "series"), "constant_fraction_transfer": ("branch", "fraction"), "expression_partition": ("branches",)}
    require(kind in fields, "UnknownKind", kind)
    known(p, "kind", *fields[kind])
    if kind == "retain_all":
        return Partition(kind)
    if kind == "release_all":
        return Partition(kind, ((identity(p["branch"]), None),))
    if kind == "exogenous_series":
        return Partition(kind, ((identity(p["branch"]), identity(p["series"]["id"])),))
    if kind == "constant_fraction_transfer":
        return Partition(kind, ((identity(p["branch"]), _fraction(p["fraction"])),))
    if kind == "expression_partition":
        branches = []
        for b in p["branches"]:
            known(b, "branch", "expression")
            e = _expression(b["expression"])
            require(e.value_kind != TRUTH, "NonScalarExpression", b["branch"])
            branches.append((identity(b["branch"]), e))
        unique([b for b, _ in branches], "DuplicateBranch")
        return Partition(kind, tuple(sorted(branches, key=lambda b: b[0])))
    branches = []
    for b in p["branches"]:
        known(b, "branch", "fraction")
        branches.append((identity(b["branch"]), _fraction(b["fraction"])))
    unique([b for b, _ in branches], "DuplicateBranch")
    branches.sort()
    total = _fraction(p["retained_fraction"])
    for _, f in branches:
        total += f
    require(total == 1.0, "InvalidFixedFractionTotal", total)
    return Partition(kind, tuple(branches), _fraction(p["retained_fraction"]))


def _projection(node: Mapping, initial: dict[str, list]) -> Projection:
    _versions(node, "id", "value_kind", "spec")
    name, spec = identity(node["id"]), node["spec"]
    kind = spec.get("kind")
    require(name in initial, "MissingInitialState", name)
    states = initial[name]
    for s in states:
        known(s, "kind", "value")
    values = tuple(s["value"] if s["kind"] == TRUTH else number(s["value"], "initial value", 0.0 if s["kind"] == "extensive" else None) for s in states)
    if kind == "finite_recurrence":
        known(spec, "kind", "state_kinds", "inputs", "parameters", "updates", "output_index")
        inputs = []
        for i in spec["inputs"]:
            src = i["source"]
            inputs.append((identity(i["reference"]["id"]), _selector(src["selector"]) if src["kind"] == "authoritative_fact" else int(src["index"])))
        unique([n for n, _ in inputs], "DuplicateInputBinding")
        updates = tuple(_expression(u) for u in spec["updates"])
        kinds = tuple(spec["state_kinds"])
        require(len(kinds) > 0, "NonPositiveBound", name)
        require(len(updates) == len(kinds), "RecurrenceUpdateCount", name)
        require(all((u.value_kind == TRUTH) == (k == TRUTH) for u, k in zip(updates, kinds)), "RecurrenceUpdateKind", name)
        require(0 <= spec["output_index"] < len(kinds), "RecurrenceOutputIndex", name)
        require(all(isinstance(s, Selector) or 0 <= s < len(kinds) for _, s in inputs), "PreviousStateIndex", name)
        require(not any(x.kind in ("forcing", "interpolated_table") for u in updates for x in u.leaves()), "ForbiddenRecurrenceLeaf", name)
        parameters = tuple(identity(p["id"]) for p in spec["parameters"])
        unique(list(parameters), "DuplicateParameterDeclaration")
        used = set().union(*(u.names("parameter") for u in updates))
        require(used <= set(parameters), "MissingParameterDeclaration", name)
        require(set(parameters) <= used, "UnusedParameterDeclaration", name)
        read = set().union(*(u.names("input") for u in updates))
        require(read <= {n for n, _ in inputs}, "MissingInputBinding", name)
        require({n for n, _ in inputs} <= read, "UnusedInputBinding", name)
        require(len(values) == len(kinds), "InitialStateLength", name)
        require([s["kind"] for s in states] == list(kinds), "InitialStateKind", name)
        return Projection(name, kind, node["value_kind"], None, 0, kinds, tuple(inputs), parameters, updates, spec["output_index"], values)
    require(kind in ("bounded_lag", "ordered_rolling_aggregate"), "UnknownKind", kind)
    lag = kind == "bounded_lag"
    known(spec, "kind", "source", *(("steps",) if lag else ("window", "aggregate")))
    source = spec["source"]
    source = _selector(source["selector"]) if source["kind"] == "authoritative_fact" else identity(source["reference"]["id"])
    span = int(spec["steps"] if lag else spec["window"])
    require(span > 0, "NonPositiveBound", name)
    require(lag or spec["aggregate"] == "sum_oldest_to_newest", "UnknownKind", spec.get("aggregate"))
    require(lag or node["value_kind"] != TRUTH, "ProjectionKind", name)
    require(len(values) == (span if lag else span - 1), "InitialStateLength", name)
    return Projection(name, kind, node["value_kind"], source, span, initial=values)


_FIELDS = ("document_version", "versions", "finite_compartments", "boundary_accounts", "connections", "substances", "initial_stocks", "calendar", "horizon", "projections", "forcings", "interpolation_tables", "rules", "transfer_bindings", "input_bindings", "units")


@dataclass(frozen=True)
class Model:
    document: Mapping[str, Any]
    topology: Topology
    substances: tuple[str, ...]
    stocks: Mapping[tuple[str, str], float]
    origin: int
    step: int
    first: int
    last: int
    projections: tuple[Projection, ...]
    forcings: Mapping[str, tuple[float, ...]]
    tables: Mapping[str, Table]
    rules: Mapping[tuple[str, str], Rule]
    destinations: Mapping[tuple[str, str, str], str]
    inputs: Mapping[tuple[str, str, str], tuple[str, str]]
    units: Mapping[str, tuple[str, float]]

    @classmethod
    def from_document(cls, document: Mapping[str, Any]) -> "Model":
        check_nesting(document)
        try:
            return cls._build(document)
        except (ExprError, TopologyError) as e:
            raise ModelError(str(e)) from e
        except (KeyError, TypeError, AttributeError) as e:
            raise ModelError(f"MalformedDocument: {e!r}") from e

    @classmethod
    def _build(cls, d: Mapping[str, Any]) -> "Model":
        known(d, *_FIELDS)
        require(d["document_version"] == _V1, "DocumentVersion", d["document_version"])
        known(d["versions"], "rule_ir", "interpreter", "numerical_semantics", "canonical_encoding")
        topology = Topology([identity(x) for x in d["finite_compartments"]], [identity(x) for x in d["boundary_accounts"]], [(c["source"], c["target"]) for c in d["connections"]])
        substances = tuple(sorted(identity(x) for x in d["substances"]))
        unique(list(substances), "DuplicateSubstance")
        stocks: dict[tuple[str, str], float] = {}
        unique([s["compartment"] for s in d["initial_stocks"]], "DuplicateCompartment")
        for s in d["initial_stocks"]:
            known(s, "compartment", "amounts")
            c = s["compartment"]
            require(c in topology.kinds, "UnknownCompartment", c)
            require(topology.kinds[c] == "finite", "BoundaryAccountStock", c)
            unique([a["substance"] for a in s["amounts"]], "DuplicateSubstance")
            for a in s["amounts"]:
                require(a["substance"] in substances, "UnregisteredSubstance", a["substance"])
                stocks[c, a["substance"]] = number(a["amount"], "stock", 0.0)
        step, first, last = d["calendar"]["timestep_seconds"], d["horizon"]["first"], d["horizon"]["last"]
        require(step > 0, "ZeroTimestepDuration")
        require(0 <= first <= last, "ReversedRunHorizon")
        units = {}
        unique([u["substance"] for u in d["units"]], "DuplicateUnit")
        for u in d["units"]:
            known(u, "substance", "unit", "quantum")
            require(u["substance"] in substances, "UnknownUnitSubstance", u["substance"])
            require(bool(re.fullmatch(r"[\x21-\x7e]+", u["unit"])), "InvalidUnit", u["unit"])
            q = number(u["quantum"], "quantum")
            require(q > 0, "NonPositiveQuantum", q)
            units[u["substance"]] = (u["unit"], q)
        require(set(units) == set(substances), "MissingUnit", sorted(set(substances) - set(units)))
        forcings = {}
        unique([f["id"] for f in d["forcings"]], "DuplicateForcing")
        for f in d["forcings"]:
            known(f, "id", "horizon", "values")
            require((f["horizon"]["first"], f["horizon"]["last"]) == (first, last), "ForcingHorizonMismatch", f["id"])
            require(len(f["values"]) == last - first + 1, "ValueCountMismatch", f["id"])
            forcings[identity(f["id"])] = tuple(number(v, f["id"]) for v in f["values"])
        tables = {}
        unique([t["id"] for t in d["interpolation_tables"]], "DuplicateTable")
        for t in d["interpolation_tables"]:
            known(t, "id", "numerical_semantics_version", "boundary_policy", "abscissae", "ordinates")
            require(t["numerical_semantics_version"] == _V1, "TableNumericalVersionMismatch", t["id"])
            require(len(t["abscissae"]) == len(t["ordinates"]), "CoordinateCountMismatch", t["id"])
            require(len(t["abscissae"]) >= 2, "TooFewPoints", t["id"])
            knots = tuple((number(x, "abscissa"), number(y, "ordinate")) for x, y in zip(t["abscissae"], t["ordinates"]))
            require(all(a[0] < b[0] for a, b in zip(knots, knots[1:])), "AbscissaeNotStrictlyIncreasing", t["id"])
            require(t["boundary_policy"] in ("reject", "clamp_to_endpoint", "linear_extrapolate"), "UnknownKind", t["boundary_policy"])
            tables[identity(t["id"])] = Table(t["id"], knots, t["boundary_policy"])
        initial: dict[str, list] = {}
        unique([s["projection"] for s in d["projections"]["initial_states"]], "DuplicateInitialState")
        for s in d["projections"]["initial_states"]:
            initial[s["projection"]] = s["values"]
        projections = tuple(_projection(p, initial) for p in d["projections"]["specifications"])
        unique([p.id for p in projections], "DuplicateProjection")
        require(set(initial) <= {p.id for p in projections}, "UnknownInitialState", sorted(set(initial) - {p.id for p in projections}))
        before: set[str] = set()
        for p in projections:
            require(p.earlier() <= {q.id for q in projections}, "UnknownProjectionReference", p.id)
            require(p.earlier() <= before, "DependencyNotEarlier", p.id)
            before.add(p.id)
            for s in p.facts():
                require(s.compartment in topology.kinds, "UnknownProjectionFactCompartment", s.compartment)
                require(s.substance in substances, "UnknownProjectionFactSubstance", s.substance)
        destinations, inputs = {}, {}
        for b in d["transfer_bindings"]:
            known(b, "compartment", "substance", "branch", "destination")
            k = (b["compartment"], b["substance"], b["branch"])
            require(k not in destinations, "DuplicateTransferBranch", k)
            require((k[0], b["destination"]) in set(topology.edges), "UndeclaredConnection", (k[0], b["destination"]))
            destinations[k] = b["destination"]
        for b in d["input_bindings"]:
            known(b, "compartment", "substance", "input", "value_kind", "source")
            k = (b["compartment"], b["substance"], b["input"])
            require(k not in inputs, "DuplicateRuleInput", k)
            kind = b["source"]["kind"]
            name = b["source"].get(kind) or b["source"].get("table") or b["source"].get("reference")
            inputs[k] = (kind, name["id"] if isinstance(name, Mapping) else name)
        rules = {}
        for r in d["rules"]:
            known(r, "compartment", "substance", "expression", "disposition", "parameters")
            k = (r["compartment"], r["substance"])
            require(k[0] in topology.kinds, "UnknownRuleCompartment", k[0])
            require(topology.kinds[k[0]] == "finite", "BoundaryAccountRule", k[0])
            require(k[1] in substances, "UnknownRuleSubstance", k[1])
            require(k not in rules, "DuplicateRule", k)
            unique([p["id"] for p in r["parameters"]], "DuplicateParameter")
            rule = Rule(*k, _expression(r["expression"]), _partition(r["disposition"]), {identity(p["id"]): number(p["value"], "parameter") for p in r["parameters"]})
            require(rule.expression.value_kind != TRUTH, "NonScalarRule", k)
            rules[k] = rule
        model = cls(d, topology, substances, stocks, d["calendar"]["origin_unix_seconds"], step, first, last, projections, forcings, tables, rules, destinations, inputs, units)
        model._check_rules()
        return model

    def _check_rules(self) -> None:
        known_projections = {p.id: p for p in self.projections}
        ruled = {c for c, _ in self.rules}
        for (c, s), amount in self.stocks.items():
            require(amount == 0 or c not in ruled or (c, s) in self.rules, "MissingRule", (c, s))
        total: dict[str, int] = {}
        for (c, s), amount in self.stocks.items():
            count = scalar_floor_count(amount, self.units[s][1])
            require(count is not None, "StockNotCountable", (c, s))
            total[s] = total.get(s, 0) + count
            require(total[s] <= MAX_COUNT, "StockCountOverflow", s)
        used = set()
        for key, rule in self.rules.items():
            expressions = [rule.expression, *(e for _, e in rule.partition.branches if isinstance(e, Expr))]
            wanted: set[str] = set()
            for e in expressions:
                for x in e.leaves():
                    if x.kind == "forcing":
                        require(x.name in self.forcings, "UnknownForcing", x.name)
                    elif x.kind == "projection":
                        require(x.name in known_projections, "UnknownProjection", x.name)
                    elif x.kind == "interpolated_table":
                        require(x.name in self.tables, "UnknownTable", x.name)
                    elif x.kind == "parameter":
                        require(x.value_kind != TRUTH, "TruthParameter", x.name)
                        require(x.name in rule.parameters, "MissingRuleParameter", (*key, x.name))
                    elif x.kind == "input":
                        require((*key, x.name) in self.inputs, "MissingInputBinding", (*key, x.name))
                        kind, name = self.inputs[*key, x.name]
                        require(kind != "interpolation_table", "TableInputNeedsAbscissa", x.name)
                        require(name in (self.forcings if kind == "forcing" else known_projections), "UnknownInputSource", name)
                wanted |= e.names("projection")
            wanted |= {n for (c, s, _), (k, n) in self.inputs.items() if (c, s) == key and k == "projection"}
            for p in self.closure(wanted):
                require(set(known_projections[p].parameters) <= set(rule.parameters), "MissingRuleParameter", (*key, p))
            for b, series in rule.partition.branches:
                require((*key, b) in self.destinations, "MissingTransferBinding", (*key, b))
                if rule.partition.kind == "exogenous_series":
                    require(series in self.forcings, "UnknownForcing", series)
                used.add((*key, b))
        require(set(self.destinations) <= used, "UnusedTransferBinding", sorted(set(self.destinations) - used))

    def closure(self, names: set[str]) -> set[str]:
        """The projections that these read, themselves included."""
        by = {p.id: p for p in self.projections}
        out, stack = set(), list(names)
        while stack:
            n = stack.pop()
            if n not in out:
                out.add(n)
                stack += by[n].earlier()
        return out

    def resolve(self, rule: Rule, leaf: Expr) -> tuple[str, str]:
        """An input's source, or the leaf's own."""
        return self.inputs[rule.compartment, rule.substance, leaf.name] if leaf.kind == "input" else (leaf.kind, leaf.name)

    def quantum(self, substance: str) -> float:
        require(substance in self.units, "UnknownSubstance", substance)
        return self.units[substance][1]

    def initial_count(self, endpoint: str, substance: str) -> int:
        return scalar_floor_count(self.stocks.get((endpoint, substance), 0.0), self.quantum(substance))

    # identity

    @cached_property
    def canonical(self) -> bytes:
        """Lists that stand for sets are sorted; numbers are written by their bits."""

        def form(x: Any, path: str) -> Any:
            if isinstance(x, bool) or x is None or isinstance(x, str):
                return x
            if isinstance(x, int | float):
                return (float(x) + 0.0).hex() if path not in ("first", "last", "steps", "window", "index", "output_index", "origin_unix_seconds", "timestep_seconds") else int(x)
            if isinstance(x, Mapping):
                return {k: form(v, k) for k, v in x.items()}
            items = [form(v, path) for v in x]
            ordered = path in ("values", "abscissae", "ordinates", "updates", "state_kinds", "specifications")
            return items if ordered else sorted(items, key=lambda v: json.dumps(v, sort_keys=True))

        return b"flowspark-model-1\n" + json.dumps(form(self.document, ""), sort_keys=True, separators=(",", ":")).encode()

    @cached_property
    def digest(self) -> str:
        return hashlib.sha256(self.canonical).hexdigest()

    def substitute(self, values: Mapping[tuple[str, str, str], float]) -> "Model":
        """A model with other parameter values; all targets are checked before any changes."""
        for (c, s, p), v in values.items():
            require((c, s) in self.rules, "RuleNotFound", (c, s))
            require(p in self.rules[c, s].parameters, "ParameterNotDeclared", (c, s, p))
            require(isinstance(v, int | float) and math.isfinite(v), "NonFiniteValue", (c, s, p))
        document = json.loads(json.dumps(self.document))
        for r in document["rules"]:
            for p in r["parameters"]:
                p["value"] = values.get((r["compartment"], r["substance"], p["id"]), p["value"])
        rules = {k: replace(r, parameters={p: float(values.get((*k, p), v)) for p, v in r.parameters.items()}) for k, r in self.rules.items()}
        return replace(self, document=document, rules=rules)


    def with_forcings(self, values: Mapping[str, Mapping[int, float]]) -> "Model":
        """A model whose named forcings have these values by timestep; a step without one has no number, and a run that reads it fails."""
        new = {k: tuple(float(v.get(t, math.nan)) for t in range(self.first, self.last + 1)) for k, v in values.items() if k in self.forcings}
        return replace(self, forcings={**self.forcings, **new})


class Archive:
    """Models by digest; inserting one twice changes nothing."""

    def __init__(self):
        self._models: dict[str, Model] = {}

    def insert(self, model: Model) -> str:
        held = self._models.setdefault(model.digest, model)
        require(held.canonical == model.canonical, "DigestCollision", model.digest)
        return model.digest

    def get(self, digest: str) -> Model:
        require(digest in self._models, "ModelArtifactNotFound", digest)
        return self._models[digest]
