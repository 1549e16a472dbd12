"""The syntax tree of pattern programs."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Element:
    """A literal or a variable of a cell pattern."""

    kind: str  # "literal" or "variable"
    text: str
    optional: bool = False
    relaxable: bool = False


@dataclass(frozen=True)
class RowRef:
    """[TABLE:"T", COL: pattern, ...] or [UUID:"u", ...]; cells: column -> alternatives of element sequences."""

    table: str | None
    uuid: str | None
    cells: tuple[tuple[str, tuple[tuple[Element, ...], ...]], ...] = ()


@dataclass(frozen=True)
class Slot:
    name: str
    ref: RowRef
    optional: bool = False


@dataclass(frozen=True)
class Expr:
    """op with arguments: lit, num, var, path, prop, state, binary operators, comparisons, &&, ||, calls."""

    op: str
    args: tuple[Any, ...] = ()


@dataclass
class Pattern:
    name: str
    description: str = ""
    described: Expr | None = None
    mode: str = "MANUAL"
    slots: list[Slot] = field(default_factory=list)
    constraints: list[tuple[str, Expr]] = field(default_factory=list)  # (shouldhave | musthave | musthaveoromit, condition)
    constants: dict[str, str] = field(default_factory=dict)
    components: list[tuple[str, str]] = field(default_factory=list)  # infpat a = P
    rowequivs: list[tuple[str, str]] = field(default_factory=list)
    instmaps: list[tuple[str, str, str]] = field(default_factory=list)
    requires: list[tuple[str, str]] = field(default_factory=list)  # instance, kind
    code: list[Statement] = field(default_factory=list)


@dataclass
class Statement:
    kind: str
    args: tuple[Any, ...] = ()
    line: int = 0


@dataclass
class Function:
    name: str
    params: list[str]
    body: list[Statement]
    result: Expr | None


@dataclass
class Program:
    imports: list[tuple[str, str]] = field(default_factory=list)  # (file | folder, path)
    functions: list[Function] = field(default_factory=list)
    patterns: list[Pattern] = field(default_factory=list)
    statements: list[Statement] = field(default_factory=list)
