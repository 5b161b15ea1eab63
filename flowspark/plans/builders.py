"""Documents from plain calls: rules, partitions, projections and whole models, as the version 1 document has them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Any

from .expr import Expr

_V1 = {"rule_ir_version": "v1", "numerical_semantics_version": "v1"}
VERSIONS = dict.fromkeys(("rule_ir", "interpreter", "numerical_semantics", "canonical_encoding"), "v1")


def expression(e: Expr) -> dict[str, Any]:
    return {**_V1, "expression": e.to_dict()}


# partitions


def retain_all() -> dict[str, Any]:
    return {"kind": "retain_all"}


def release_all(branch: str) -> dict[str, Any]:
    return {"kind": "release_all", "branch": branch}


def fixed_fraction_split(retained: float, **branches: float) -> dict[str, Any]:
    return {"kind": "fixed_fraction_split", "retained_fraction": retained, "branches": [{"branch": b, "fraction": f} for b, f in branches.items()]}


def constant_fraction(branch: str, fraction: float) -> dict[str, Any]:
    return {"kind": "constant_fraction_transfer", "branch": branch, "fraction": fraction}


def exogenous(branch: str, forcing: str) -> dict[str, Any]:
    return {"kind": "exogenous_series", "branch": branch, "series": {"id": forcing}}


def expression_partition(branches: Mapping[str, Expr]) -> dict[str, Any]:
    return {"kind": "expression_partition", "branches": [{"branch": b, "expression": expression(e)} for b, e in branches.items()]}


def rule(compartment: str, substance: str, e: Expr, partition: Mapping[str, Any], parameters: Mapping[str, float] | None = None) -> dict[str, Any]:
    return {"compartment": compartment, "substance": substance, "expression": expression(e), "disposition": {**_V1, "partition": dict(partition)}, "parameters": [{"id": k, "value": v} for k, v in (parameters or {}).items()]}


# projections: each is a specification with its initial state


def fact(direction: str, compartment: str, substance: str) -> dict[str, Any]:
    return {"kind": "authoritative_fact", "selector": {"kind": f"{direction}_transfer_amount", "compartment": compartment, "substance": substance}}


def projection(name: str, spec: Mapping[str, Any], initial: Sequence[float], kind: str = "extensive") -> tuple[dict[str, Any], dict[str, Any]]:
    return {**_V1, "id": name, "value_kind": kind, "spec": dict(spec)}, {"projection": name, "values": [{"kind": kind, "value": v} for v in initial]}


def bounded_lag(source: Mapping[str, Any], steps: int) -> dict[str, Any]:
    return {"kind": "bounded_lag", "source": dict(source), "steps": steps}


def rolling_sum(source: Mapping[str, Any], window: int) -> dict[str, Any]:
    return {"kind": "ordered_rolling_aggregate", "source": dict(source), "window": window, "aggregate": "sum_oldest_to_newest"}


def state_input(name: str, index: int) -> dict[str, Any]:
    return {"reference": {"id": name, "value_kind": "scalar"}, "source": {"kind": "previous_state", "index": index, "value_kind": "extensive"}}


def fact_input(name: str, source: Mapping[str, Any]) -> dict[str, Any]:
    return {"reference": {"id": name, "value_kind": "scalar"}, "source": dict(source)}


def recurrence(updates: Sequence[Expr], inputs: Sequence[Mapping[str, Any]], parameters: Sequence[str] = (), output: int = 0) -> dict[str, Any]:
    return {"kind": "finite_recurrence", "state_kinds": ["extensive"] * len(updates), "inputs": list(inputs), "parameters": [{"id": p, "value_kind": "scalar"} for p in parameters], "updates": [expression(u) for u in updates], "output_index": output}


# models


def table(name: str, knots: Sequence[tuple[float, float]], policy: str) -> dict[str, Any]:
    return {"id": name, "numerical_semantics_version": "v1", "boundary_policy": policy, "abscissae": [x for x, _ in knots], "ordinates": [y for _, y in knots]}


def forcing_input(compartment: str, substance: str, name: str, forcing: str) -> dict[str, Any]:
    return {"compartment": compartment, "substance": substance, "input": name, "value_kind": "scalar", "source": {"kind": "forcing", "forcing": {"id": forcing}}}


def model_document(
    finite_compartments: Sequence[str], boundary_accounts: Sequence[str], connections: Sequence[tuple[str, str]], stocks: Mapping[tuple[str, str], float], units: Mapping[str, tuple[str, float]], horizon: tuple[int, int],
    rules: Sequence[Mapping[str, Any]] = (), bindings: Mapping[tuple[str, str, str], str] | None = None, inputs: Sequence[Mapping[str, Any]] = (), projections: Sequence[tuple[Mapping[str, Any], Mapping[str, Any]]] = (),
    forcings: Mapping[str, Sequence[float]] | None = None, tables: Sequence[Mapping[str, Any]] = (), origin: int = 0, step: int = 86400,
) -> dict[str, Any]:
    """stocks by (compartment, substance), units (name, quantum) by substance, bindings: destination by (compartment, substance, branch)."""
    first, last = horizon
    return {
        "document_version": "v1", "versions": dict(VERSIONS), "finite_compartments": list(finite_compartments), "boundary_accounts": list(boundary_accounts),
        "connections": [{"source": a, "target": b} for a, b in connections], "substances": list(units),
        "initial_stocks": [{"compartment": c, "amounts": [{"substance": s, "amount": v} for (o, s), v in stocks.items() if o == c]} for c in dict.fromkeys(c for c, _ in stocks)],
        "calendar": {"origin_unix_seconds": origin, "timestep_seconds": step}, "horizon": {"first": first, "last": last},
        "projections": {"specifications": [dict(p) for p, _ in projections], "initial_states": [dict(s) for _, s in projections]},
        "forcings": [{"id": n, "horizon": {"first": first, "last": last}, "values": list(v)} for n, v in (forcings or {}).items()], "interpolation_tables": [dict(t) for t in tables],
        "rules": [dict(r) for r in rules], "transfer_bindings": [{"compartment": c, "substance": s, "branch": b, "destination": d} for (c, s, b), d in (bindings or {}).items()],
        "input_bindings": [dict(i) for i in inputs], "units": [{"substance": s, "unit": u, "quantum": q} for s, (u, q) in units.items()],
    }
