"""Conditions and expressions of patterns as Column expressions; null stands for what can't be evaluated."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from patternloom.functions.scalar import dual, dual_arithmetic, dual_compare, dual_text, strict_and, strict_or
from patternloom.plans.ast import Expr


@dataclass
class Scope:
    """Texts of variables and row names; a name that is missing can't be evaluated."""

    names: dict[str, Column]

    def text(self, name: str) -> Column:
        return self.names.get(name, F.lit(None).cast("string"))


def value(e: Expr, scope: Scope) -> Column:
    """The dual-typed value of an expression."""
    if e.op == "lit":
        return dual_text(F.lit(e.args[0]))
    if e.op == "num":
        return dual(F.lit(float(e.args[0])), F.lit(str(float(e.args[0]))))
    if e.op == "var":
        return dual_text(scope.text(e.args[0]))
    if e.op == "path":
        return dual_text(scope.text(".".join(e.args)))
    if e.op in ("+", "-", "*", "/", "%"):
        return dual_arithmetic(e.op, value(e.args[0], scope), value(e.args[1], scope))
    return dual()


def evaluate(e: Expr, scope: Scope) -> Column:
    """The truth of a condition, or null where a part can't be evaluated."""
    if e.op == "&&":
        return strict_and(evaluate(e.args[0], scope), evaluate(e.args[1], scope))
    if e.op == "||":
        return strict_or(evaluate(e.args[0], scope), evaluate(e.args[1], scope))
    if e.op in ("==", "!=", "<", "<=", ">", ">="):
        return dual_compare(e.op, value(e.args[0], scope), value(e.args[1], scope))
    if e.op == "double":
        inner = e.args[0]
        a, b = value(inner.args[0], scope), value(inner.args[1], scope)
        return F.when(a["d"].isNotNull() & b["d"].isNotNull(), dual_compare(inner.op, a, b))
    if e.op == "change":
        parts = dict(e.args[1])
        v = value(e.args[0], scope)["d"]
        if "direction" in parts and "threshold" in parts:
            limit = value(parts["threshold"], scope)["d"]
            way = F.lit(parts["direction"]) if isinstance(parts["direction"], str) else value(parts["direction"], scope)["s"]
            return F.when(way == "increase", v > limit).when(way == "decrease", v < limit)
        return F.lit(None).cast("boolean")
    if e.op == "truth":
        v = value(e.args[0], scope)
        return F.when(v["d"].isNotNull(), v["d"] != 0)
    return F.lit(None).cast("boolean")
