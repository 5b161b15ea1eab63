"""The rule language: a closed, typed expression tree that compiles to a Spark column or is evaluated for one step.

Nodes are plain data. ``Expr.column`` gives Catalyst the whole rule, so it is folded, shared and generated as code;
``Expr.value`` is the same rule on scalars, for rules whose inputs exist only step by step.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import numeric as N

MAX_DEPTH = 128
SCALAR, TRUTH = "scalar", "truth"
#: Operand kinds by node kind.
_OPERANDS = {k: (SCALAR, SCALAR) for k in ("add", "subtract", "multiply", "divide", "power", "minimum", "maximum", "comparison")}
_OPERANDS |= {"clamp": (SCALAR,) * 3, "select": (TRUTH, SCALAR, SCALAR), "interpolated_table": (SCALAR,)}
_LEAVES = ("input", "parameter", "forcing", "projection")
#: Names of the operands in documents.
_FIELDS = {k: ("lhs", "rhs") for k in _OPERANDS if len(_OPERANDS[k]) == 2}
_FIELDS |= {"clamp": ("value", "lower", "upper"), "select": ("condition", "when_true", "when_false"), "interpolated_table": ("input",)}


class ExprError(ValueError):
    """An expression that is not well formed."""


def known(node: Mapping[str, Any], *fields: str) -> None:
    """Unknown fields are errors."""
    if extra := set(node) - set(fields):
        raise ExprError(f"UnknownField: {sorted(map(str, extra))}")


@dataclass(frozen=True)
class Expr:
    kind: str
    args: tuple["Expr", ...] = ()
    name: str | None = None
    number: float | None = None
    value_kind: str = SCALAR
    declared: str | None = None

    def __post_init__(self):
        if self.kind == "literal":
            if self.number is None or self.number != self.number or abs(self.number) == float("inf"):
                raise ExprError("NonFiniteLiteral")
            object.__setattr__(self, "number", float(self.number) + 0.0)
        elif self.kind in _LEAVES:
            if not self.name:
                raise ExprError("MissingName")
            object.__setattr__(self, "declared", self.declared or self.value_kind)
        else:
            want = _OPERANDS.get(self.kind)
            if want is None:
                raise ExprError(f"UnknownKind: {self.kind}")
            if len(self.args) != len(want) or any(a.value_kind != k for a, k in zip(self.args, want)):
                raise ExprError("IncompatibleValueKind")
            if self.kind == "comparison" and self.name not in N.COMPARISONS:
                raise ExprError(f"UnknownComparison: {self.name}")
            object.__setattr__(self, "value_kind", TRUTH if self.kind == "comparison" else SCALAR)
        if self.depth > MAX_DEPTH:
            raise ExprError("ExpressionTooDeep")

    @property
    def depth(self) -> int:
        if "_depth" not in self.__dict__:
            object.__setattr__(self, "_depth", 1 + max((a.depth for a in self.args), default=0))
        return self.__dict__["_depth"]

    def leaves(self) -> list["Expr"]:
        if not self.args:
            return [self]
        own = [self] if self.kind == "interpolated_table" else []
        return own + [x for a in self.args for x in a.leaves()]

    def names(self, kind: str) -> set[str]:
        return {x.name for x in self.leaves() if x.kind == kind}

    # plain data

    def to_dict(self) -> dict[str, Any]:
        out: dict[str, Any] = {"kind": self.kind}
        if self.kind == "literal":
            out["value"] = self.number
        elif self.kind in _LEAVES:
            out["reference"] = {"id": self.name} | ({} if self.kind == "forcing" else {"value_kind": self.declared})
        else:
            if self.kind == "comparison":
                out["comparison"] = self.name
            if self.kind == "interpolated_table":
                out["table"] = {"id": self.name}
            out |= {f: a.to_dict() for f, a in zip(_FIELDS[self.kind], self.args)}
        return out

    @classmethod
    def from_dict(cls, node: Mapping[str, Any], depth: int = 0) -> "Expr":
        if depth > MAX_DEPTH:
            raise ExprError("ExpressionTooDeep")
        kind = node.get("kind")
        try:
            if kind == "literal":
                known(node, "kind", "value")
                return cls("literal", number=float(node["value"]))
            if kind in _LEAVES:
                known(node, "kind", "reference")
                ref = node["reference"]
                known(ref, "id", *(() if kind == "forcing" else ("value_kind",)))
                own = SCALAR if kind == "forcing" else ref["value_kind"]
                return cls(kind, name=ref["id"], value_kind=TRUTH if own == TRUTH else SCALAR, declared=own)
            if kind in _FIELDS:
                extra = {"comparison": ("comparison",), "interpolated_table": ("table",)}.get(kind, ())
                known(node, "kind", *extra, *_FIELDS[kind])
                name = node["comparison"] if kind == "comparison" else node["table"]["id"] if kind == "interpolated_table" else None
                return cls(kind, tuple(cls.from_dict(node[f], depth + 1) for f in _FIELDS[kind]), name=name)
        except KeyError as e:
            raise ExprError(f"MissingField: {e}") from e
        raise ExprError(f"UnknownKind: {kind}")

    # evaluation

    def column(self, leaf: Callable[["Expr"], Column], tables: Mapping[str, Any]) -> Column:
        """leaf gives the column of an input, parameter, forcing or projection; tables have knots and policy."""
        if self.kind == "literal":
            return F.lit(self.number)
        if self.kind in _LEAVES:
            return leaf(self)
        args = [a.column(leaf, tables) for a in self.args]
        if self.kind == "interpolated_table":
            return N.interpolate(args[0], tables[self.name].knots, tables[self.name].policy)
        if self.kind == "comparison":
            return N.compare(self.name, *args)
        return getattr(N, self.kind)(*args)

    def value(self, leaf: Callable[["Expr"], Any], tables: Mapping[str, Any]) -> float | bool:
        k = self.kind
        if k == "literal":
            return self.number
        if k in _LEAVES:
            return leaf(self)
        if k == "select":
            return self.args[1 if self.args[0].value(leaf, tables) else 2].value(leaf, tables)
        args = [a.value(leaf, tables) for a in self.args]
        if k == "interpolated_table":
            return N.scalar_interpolate(args[0], tables[self.name].knots, tables[self.name].policy)
        return _SCALAR[k](self.name, *args)


_SCALAR = {
    "add": lambda _, a, b: N.check(a + b),
    "subtract": lambda _, a, b: N.check(a - b),
    "multiply": lambda _, a, b: N.check(a * b),
    "divide": lambda _, a, b: N.scalar_divide(a, b),
    "power": lambda _, a, b: N.scalar_power(a, b),
    "minimum": lambda _, a, b: a if a <= b else b,
    "maximum": lambda _, a, b: a if a >= b else b,
    "clamp": lambda _, v, lo, hi: N.scalar_clamp(v, lo, hi),
    "comparison": lambda op, a, b: N.scalar_compare(op, a, b),
}


def lit(value: float) -> Expr:
    return Expr("literal", number=value)


def param(name: str) -> Expr:
    return Expr("parameter", name=name)


def input_(name: str, value_kind: str = SCALAR) -> Expr:
    return Expr("input", name=name, value_kind=value_kind)


def forcing(name: str) -> Expr:
    return Expr("forcing", name=name)


def projection(name: str, value_kind: str = SCALAR) -> Expr:
    return Expr("projection", name=name, value_kind=value_kind)


def add(a: Expr, b: Expr) -> Expr:
    return Expr("add", (a, b))


def subtract(a: Expr, b: Expr) -> Expr:
    return Expr("subtract", (a, b))


def multiply(a: Expr, b: Expr) -> Expr:
    return Expr("multiply", (a, b))


def divide(a: Expr, b: Expr) -> Expr:
    return Expr("divide", (a, b))


def power(a: Expr, b: Expr) -> Expr:
    return Expr("power", (a, b))


def minimum(a: Expr, b: Expr) -> Expr:
    return Expr("minimum", (a, b))


def maximum(a: Expr, b: Expr) -> Expr:
    return Expr("maximum", (a, b))


def clamp(v: Expr, lo: Expr, hi: Expr) -> Expr:
    return Expr("clamp", (v, lo, hi))


def compare(op: str, a: Expr, b: Expr) -> Expr:
    return Expr("comparison", (a, b), name=op)


def select(condition: Expr, a: Expr, b: Expr) -> Expr:
    return Expr("select", (condition, a, b))


def table_lookup(table: str, x: Expr) -> Expr:
    return Expr("interpolated_table", (x,), name=table)
