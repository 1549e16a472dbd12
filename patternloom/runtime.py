"""The interpreter of pattern programs: control on the driver, solving and editing of tables on Spark."""

from __future__ import annotations

import copy
import functools
import itertools
import math
import threading
import time
import uuid
from collections import ChainMap
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from dataclasses import dataclass, field, fields, is_dataclass
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.checkpoints import checkpoint
from patternloom.functions.annotate import namings
from patternloom.functions.omni import omni_text
from patternloom.operators.closure import complete_taxonomy, words_of
from patternloom.plans.ast import Expr, Pattern, Program, Slot, Statement
from patternloom.plans.compile import MAX_MATCHES, share, solve, static_uids
from patternloom.plans.conditions import Scope, evaluate
from patternloom.plans.conditions import value as expression
from patternloom.sources import sinks
from patternloom.sources.readers import Config
from patternloom.sources.tablestore import Store, Table

#: The language's own limit of a loop.
LOOPS = 25
#: Rounds after which rules that still add rows fail.
AUTO_ROUNDS = 1_000
#: Maps of instances that are tried at once.
MAPS = 64
AUTO = ("AUTO", "AUTOREGEN")


class ScriptError(RuntimeError):
    pass


class Break(Exception):
    pass


class Exit(Exception):
    def __init__(self, code: int) -> None:
        super().__init__(code)
        self.code = code


@dataclass
class Instance:
    """A named object: its kind, properties (text; a number where it reads as one) and attached rows."""

    kind: str
    props: dict[str, str] = field(default_factory=dict)
    rows: list[str] = field(default_factory=list)


@dataclass
class State:
    name: str = ""
    instances: dict[str, Instance] = field(default_factory=dict)
    explanation: list[str] = field(default_factory=list)
    runs: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class Dual:
    """A value as number and as text; None where it has no such form."""

    d: float | None
    s: str | None


def of_text(s: str | None) -> Dual:
    try:
        return Dual(float(s), s)
    except (TypeError, ValueError):
        return Dual(None, s)


def of_number(d: float) -> Dual:
    return Dual(d, str(d))


def arithmetic(op: str, a: Dual, b: Dual) -> Dual:
    if a.d is not None and b.d is not None:
        x, y = a.d, b.d
        if op in "/%" and y == 0:
            out = math.nan if op == "%" or x == 0 or math.isnan(x) else math.copysign(math.inf, x)
        else:
            out = {"+": lambda: x + y, "-": lambda: x - y, "*": lambda: x * y, "/": lambda: x / y, "%": lambda: math.fmod(x, y)}[op]()
        return of_number(out)
    if op == "+" and a.s is not None and b.s is not None:
        return Dual(None, a.s + b.s)
    return Dual(None, None)


def compare(op: str, a: Dual, b: Dual) -> bool | None:
    x, y = (a.d, b.d) if a.d is not None and b.d is not None else (a.s, b.s)
    if x is None or y is None:
        return None
    return {"==": x == y, "!=": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]


@contextmanager
def jobs_end_at(spark: SparkSession, ends: float | None) -> Iterator[None]:
    """Cancels the jobs of this thread that still run at a time of the monotonic clock, or start later."""
    if ends is None:
        yield
        return
    sc, tag, done = spark.sparkContext, f"patternloom-{uuid.uuid4().hex}", threading.Event()

    def watch() -> None:
        left = ends - time.monotonic()
        while not done.wait(max(left, 0.2)):
            sc.cancelJobsWithTag(tag)
            left = 0

    sc.addJobTag(tag)
    threading.Thread(target=watch, daemon=True).start()
    try:
        yield
    finally:
        done.set()
        sc.removeJobTag(tag)


def literals(x: Any) -> Iterator[str]:
    """All texts within a program: what its rows and rules may write among them."""
    if isinstance(x, str):
        yield x
    elif is_dataclass(x):
        for f in fields(x):
            yield from literals(getattr(x, f.name))
    elif isinstance(x, (list, tuple, set, frozenset)):
        for y in x:
            yield from literals(y)
    elif isinstance(x, dict):
        yield from literals([*x.keys(), *x.values()])


def plain(e: Expr) -> bool:
    """Whether an expression is made of literals, variables and arithmetic alone."""
    return e.op in ("lit", "num", "var", "path") or e.op in ("+", "-", "*", "/", "%") and all(plain(a) for a in e.args)


def names_of(match: dict[str, Any]) -> dict[str, Dual]:
    """A solution's variables and row names as conditions see them."""
    return {k.replace("__", "."): of_text(v) for k, v in match.items() if isinstance(v, str) and k != "hash"}


def named_columns(rows: DataFrame) -> dict[str, str]:
    """The columns of solutions (see Runtime.texts) by the names that conditions use."""
    return {c.replace("__", "."): c for c in rows.columns if c not in ("hash", "executable", "n_opt_unfilled", "_bound", "_at", "_map")}


def batches(rows: DataFrame, size: int = 100) -> Iterator[dict[str, Any]]:
    """Ordered rows, some at a time."""
    for at in itertools.count(0, size):
        some = rows.offset(at).limit(size).collect()
        yield from (r.asDict() for r in some)
        if len(some) < size:
            return


class Runtime:
    """Runs a program over a store. states is the log of snapshots; the last is the current one."""

    def __init__(self, spark: SparkSession, store: Store, program: Program, output: str | None = None, time_limit: float | None = None, lemmas: Column | None = None) -> None:
        self.spark, self.store, self.program, self.output, self.lemmas = spark, store, program, output, lemmas
        self.patterns = {p.name: p for p in program.patterns}
        if len(self.patterns) < len(program.patterns):
            raise ScriptError("two patterns have the same name")
        self.max_matches = MAX_MATCHES
        self.states, self.matches, self.printed = [State()], {}, []
        self.solved_at: dict[str, tuple[int, int]] = {}
        self.grown: dict[str, int] = {}
        self.due: list[str] = []  # patterns that were run, but whose solutions nobody has asked for
        self.kinds_known: dict[tuple[int, str, str], bool] = {}
        self.scope: ChainMap = ChainMap({})
        self.remap: dict[str, str] = {}
        self.enabled: frozenset[str] | None = None
        self.ends = time.monotonic() + time_limit if time_limit else None

    @property
    def state(self) -> State:
        return self.states[-1]

    def run(self) -> int:
        """Execute the program; its exit code, -10 for a failed verifyAnswer. At the time limit running jobs are cancelled."""
        try:
            with jobs_end_at(self.spark, self.ends):
                self.execute(self.program.statements)
        except Exit as e:
            return e.code
        except (ScriptError, Break):
            raise
        except Exception as e:
            if self.ends and time.monotonic() > self.ends:
                raise ScriptError("time limit") from e
            raise
        return 0

    def say(self, text: str) -> None:
        self.printed.append(text)

    # solving
    def required(self, name: str) -> list[str]:
        """A pattern and what it is composed of, components first."""
        out: list[str] = []

        def visit(n: str, path: tuple[str, ...]) -> None:
            if n in path:
                raise ScriptError(f"pattern {n} is a component of itself")
            if n not in self.patterns:
                raise ScriptError(f"no pattern {n}")
            for _, of in self.patterns[n].components:
                visit(of, (*path, n))
            if n not in out:
                out.append(n)

        visit(name, ())
        return out

    def populate(self, names: list[str] | None = None) -> None:
        """Solve all patterns, or those named with their components."""
        order = list(dict.fromkeys(x for n in (self.patterns if names is None else names) for x in self.required(n)))
        self.store.locate([u for n in order for u in static_uids(self.patterns[n])])
        for n in order:
            self.tick()
            now = self.store.version, self.max_matches
            if self.solved_at.get(n) == now:  # no table has changed since
                continue
            if n in self.matches:
                self.matches[n].unpersist()
            self.matches[n], self.solved_at[n] = solve(self.store, self.patterns[n], self.max_matches, self.lemmas, solved=self.matches).cache(), now

    def tick(self) -> None:
        if self.ends and time.monotonic() > self.ends:
            raise ScriptError("time limit")

    def auto(self) -> int:
        """Drop implied rows, complete the taxonomy, then run AUTO and AUTOREGEN patterns until no row is added; the rounds.

        A pattern whose code only generates rows is solved anew for rows that the last round added: one slot at a time reads
        these, the slots before it the rows from before, those behind it all. Others are solved and run as a whole each round.
        """
        self.store.drop_generated("TEMPGEN")
        if "KINDOF" in self.store:
            complete_taxonomy(self.store)
        autos = [p for p in self.program.patterns if p.mode in AUTO]
        bulk = [p for p in autos if p.code and not p.components and all(s.ref.uuid is None for s in p.slots) and all(s.kind == "generate" and all(plain(e) for _, e in s.args[0][1]) for s in p.code)]
        added: dict[str, DataFrame] | None = None  # rows of the last round by table; None: everything is new
        before: dict[str, DataFrame] = {}  # all rows from before it
        for k in range(1, AUTO_ROUNDS + 1):
            self.tick()
            rows = [(table, kind, cells) for p in bulk for table, kind, cells in self.generated(p, added, before)]
            others = [p for p in autos if p not in bulk]
            self.populate([p.name for p in others])
            before = {name: t.rows for name, t in self.store.tables.items()}
            added = self.grow(rows)
            version = self.store.version
            for p in others:
                for row in self.matches[p.name].where("executable").toLocalIterator():
                    self.run_match(p, row.asDict(), {}, frozenset(), kind="TEMPGEN" if p.mode == "AUTOREGEN" else "GEN")
            if self.store.version != version:  # their code may have edited any table
                for name, t in self.store.tables.items():
                    if t.rows is not before.get(name):
                        new = checkpoint(t.rows.join(before[name].select("uid"), "uid", "left_anti").select(*t.rows.columns)) if name in before else t.rows
                        if new.isEmpty():
                            added.pop(name, None)
                        else:
                            added[name] = new
                            before[name] = t.rows.join(new.select("uid"), "uid", "left_anti").select(*new.columns)
            if not added:
                self.due = [p.name for p in autos]
                return k
        raise ScriptError(f"rules still add rows after {AUTO_ROUNDS} rounds")

    def generated(self, p: Pattern, added: dict[str, DataFrame] | None, before: dict[str, DataFrame]) -> Iterator[tuple[str, str, DataFrame]]:
        """(table, kind, cells) that a pattern's code generates for its executable solutions, of which at least one row is new."""
        kind = "TEMPGEN" if p.mode == "AUTOREGEN" else "GEN"
        if added is None:
            found = [solve(self.store, p, None, self.lemmas, distinct=False)]
        else:
            held = {name: before.get(name, t.rows) if name in added else t.rows for name, t in self.store.tables.items()}
            old, new, every = self.store.with_rows(held), self.store.with_rows(added), self.store
            found = []
            for j, slot in enumerate(p.slots):
                if slot.ref.table.upper() in added:
                    filled = copy.copy(p)
                    filled.slots = [*p.slots[:j], Slot(slot.name, slot.ref), *p.slots[j + 1 :]]
                    found.append(solve(every, filled, None, self.lemmas, sources=[old] * j + [new] + [every] * (len(p.slots) - j - 1), distinct=False))
        for m in found:
            rows = self.texts_of(m).where("executable")
            names = {c.replace("__", "."): F.col(f"`{c}`") for c in rows.columns if c not in ("hash", "executable", "n_opt_unfilled")}
            for s in p.code:
                table, cells = s.args[0]
                t = self.store[table]
                row = [F.lit("")] * len(t.header)
                for c, e in cells:
                    row[t.column(c)] = F.coalesce(expression(e, Scope(names))["s"], F.raise_error(F.lit(f"line {s.line}: an expression has no value")).cast("string"))
                yield t.name.upper(), kind, rows.select(F.array(*row).alias("cells"))

    def grow(self, rows: list[tuple[str, str, DataFrame]]) -> dict[str, DataFrame]:
        """Add generated rows, each table's of one kind in one step; what was added, by table. Only these are written down,
        and every eighth time the table as a whole, so that its plan stays short."""
        added: dict[str, DataFrame] = {}
        for table, kind in sorted({(t, k) for t, k, _ in rows}):
            every = [c for t, k, c in rows if (t, k) == (table, kind)]
            new = checkpoint(self.store.fresh(table, functools.reduce(DataFrame.unionByName, every), kind))
            if not new.isEmpty():
                t = self.store[table]
                self.grown[table] = self.grown.get(table, 0) + 1
                joint = t.rows.unionByName(new)
                self.store.add(Table(t.name, t.header, checkpoint(joint) if self.grown[table] % 8 == 0 else joint, t.roles))
                added[table] = added[table].unionByName(new) if table in added else new
        return added

    def cut(self, table: str) -> None:
        """Write an edited table down: its plan would grow with each edit."""
        t = self.store[table]
        self.store.add(Table(t.name, t.header, checkpoint(t.rows), t.roles))

    # matches
    def texts(self, name: str) -> DataFrame:
        return self.texts_of(self.matches[name])

    @staticmethod
    def texts_of(m: DataFrame) -> DataFrame:
        """Solutions with their variables as texts and row names as uids."""
        cols = [omni_text(F.col(f"`{c}`")).alias(c[2:]) for c in m.columns if c.startswith("v_")]
        rows = [F.when(F.col(f"`{c}`").isNull(), F.lit("")).otherwise(F.concat(F.lit("UUID"), F.col(f"`{c}`"))).alias(c[4:]) for c in m.columns if c.startswith("uid_")]
        return m.select("hash", "executable", "n_opt_unfilled", *cols, *rows)

    def chosen(self, name: str, how: tuple | None) -> DataFrame:
        """The solutions meant, with their order (_bound, then _at): by index, by hash, by conditions (the most bound variables
        first), or all."""
        self.populate([name])
        rows = self.texts(name)
        bound = F.lit(0)
        if how is not None and how[0] == "index":
            rows = rows.offset(how[1]).limit(1)
        elif how is not None and how[0] == "hash":
            rows = rows.where(F.col("hash") == how[1].lower()).limit(1)
        elif how is not None:
            for c in how[1]:
                rows = rows.where(self.column_of(c, rows))
            bound = sum(((F.coalesce(F.col(f"`{c}`"), F.lit("")) != "").cast("int") for c in named_columns(rows).values()), F.lit(0))
        return rows.withColumns({"_bound": bound, "_at": F.monotonically_increasing_id()})

    def column_of(self, e: Expr, rows: DataFrame) -> Column:
        """A condition over solutions: what it says of instances, states and the program's variables is worked out here."""
        known = {k: v for k, v in self.scope.items() if isinstance(v, Dual)}
        text = lambda k: F.lit(known[k].s if k in known else None).cast("string")
        names = {k: F.coalesce(F.col(f"`{c}`"), text(k)) for k, c in named_columns(rows).items()}
        return evaluate(self.grounded(e), Scope({k: text(k) for k in known} | names))

    def grounded(self, e: Any, state: State | None = None) -> Any:
        """An expression without instances and states."""
        if isinstance(e, (tuple, list)):
            return tuple(self.grounded(x, state) for x in e)
        if not isinstance(e, Expr):
            return e
        if e.op == "stated":
            return self.grounded(e.args[1], self.state_of(*e.args[0]))
        if e.op in ("prop", "meets"):
            v = self.value(e, None, state)
            return Expr("none") if v.s is None else Expr("lit", (v.s,))
        if e.op == "generate":
            raise ScriptError("a condition generates no rows")
        return Expr(e.op, tuple(self.grounded(x, state) for x in e.args))

    def needed(self, p: Pattern) -> list[str]:
        """The instances that a pattern has to be given."""
        return list(dict.fromkeys([i for i, _ in p.requires] + [i for i, _, _ in p.instmaps]))

    def kinds(self, p: Pattern) -> list[tuple[str, str]]:
        """(instance, kind) that a pattern requires; what its components require of instances that it maps to them too."""
        mapped = [(i, k) for i, var, j in p.instmaps for x, k in self.kinds(self.patterns[dict(p.components)[var]]) if x == j]
        return [*p.requires, *mapped]

    def mappings(self, p: Pattern, remap: tuple) -> Iterator[dict[str, str]]:
        """The given map, or injective ones from needed instances to those of the state, where all kinds fit."""
        need = self.needed(p)
        every = [dict(remap)] if remap else (dict(zip(need, perm, strict=True)) for perm in itertools.permutations(self.state.instances, len(need)))
        for pairs in every:
            have = {i: self.state.instances.get(pairs.get(i, i)) for i, _ in self.kinds(p)}
            if len(pairs) == len(need) and all(have[i] is not None and self.is_kind(have[i].kind, k) for i, k in self.kinds(p)):
                yield pairs

    def satisfied(self, p: Pattern, match: dict[str, Any], pairs: dict[str, str]) -> bool:
        """Whether a solution may be executed with a map of instances: every condition can be evaluated, and all but a
        shouldhave hold, those of its components too."""
        local, old = names_of(match), self.remap
        self.remap = self.mapped(p, pairs)
        try:
            got = [(kind, self.condition(c, local)) for kind, c in p.constraints]
        except ScriptError:  # an instance that the state doesn't have
            return False
        finally:
            self.remap = old
        if any(v is None or not v and kind != "shouldhave" for kind, v in got):
            return False
        for var, of in p.components:
            q = self.patterns[of]
            if q.constraints or q.components:
                part = self.component_match(var, of, match)
                if part is not None and not self.satisfied(q, part, self.part_pairs(p, var, pairs)):
                    return False
        return True

    def part_pairs(self, p: Pattern, var: str, pairs: dict[str, str]) -> dict[str, str]:
        """A component's map of instances: its own go by those that the composite maps to them."""
        return {**pairs, **{j: pairs.get(i, i) for i, a, j in p.instmaps if a == var}}

    def executable(self, name: str, how: tuple | None, remap: tuple) -> tuple[dict[str, Any], dict[str, str]] | None:
        """The first solution meant, with the first map of instances, whose requirements are met.

        The conditions of a pattern are tried for all solutions and MAPS maps at a time in one job, which returns one row; of a
        composite, whose components have conditions of their own, the solutions that meet its own ones come in small batches.
        """
        p, rows = self.patterns[name], self.chosen(name, how)
        found, maps = None, self.mappings(p, remap)
        for first in itertools.count(0, MAPS):
            some = list(itertools.islice(maps, MAPS))
            if not some:
                break
            fits = F.array_position(F.array(*(self.met(p, rows, pairs) for pairs in some)), True)
            ready = rows.withColumn("_map", fits).where("_map > 0").orderBy(F.desc("_bound"), "_at")
            if any(self.patterns[of].constraints or self.patterns[of].components for _, of in p.components):
                for m in batches(ready):
                    pairs = next((x for x in some if self.satisfied(p, m, x)), None)
                    if pairs is not None:
                        found = min(found or (math.inf,), (-m["_bound"], m["_at"], first, m, pairs), key=lambda x: x[:3])
                        break
            else:
                for m in (r.asDict() for r in ready.limit(1).collect()):
                    found = min(found or (math.inf,), (-m["_bound"], m["_at"], first, m, some[m["_map"] - 1]), key=lambda x: x[:3])
        if found is None:
            return None
        *_, m, pairs = found
        return {k: v for k, v in m.items() if k not in ("_bound", "_at", "_map")}, pairs

    def met(self, p: Pattern, rows: DataFrame, pairs: dict[str, str]) -> Column:
        """Whether a solution's own conditions hold with a map of instances, as satisfied() has it."""
        old, out = self.remap, F.lit(True)
        self.remap = self.mapped(p, pairs)
        try:
            for kind, c in p.constraints:
                got = self.column_of(c, rows)
                out = out & (got.isNotNull() if kind == "shouldhave" else F.coalesce(got, F.lit(False)))
        except ScriptError:  # an instance that the state doesn't have
            return F.lit(False)
        finally:
            self.remap = old
        return out

    def mapped(self, p: Pattern, pairs: dict[str, str]) -> dict[str, str]:
        return {**self.remap, **pairs, **{f"{var}.{j}": pairs.get(i, i) for i, var, j in p.instmaps}}

    def component_match(self, var: str, of: str, match: dict[str, Any]) -> dict[str, Any] | None:
        """The component's solution over the rows that it has in the composite's."""
        rows = self.texts(of)
        for c in rows.columns:
            if f"{var}__{c}" in match:
                rows = rows.where(F.col(f"`{c}`").eqNullSafe(match[f"{var}__{c}"]))
        got = rows.limit(1).collect()
        return got[0].asDict() if got else None

    def run_match(self, p: Pattern, match: dict[str, Any], remap: dict[str, str], blocks: frozenset[str], kind: str = "GEN") -> None:
        local = {k.removeprefix("v_").removeprefix("uid_"): v for k, v in match.items() if k not in ("hash", "executable", "n_opt_unfilled", "relaxed_dyn", "relaxed_total", "should_score") and not k.startswith(("o_", "relax_"))}
        flat = {k.replace("__", "."): of_text(v if isinstance(v, str) else " ".join(x[-1] for x in v)) for k, v in local.items() if v is not None}
        old = self.scope, self.remap, self.enabled, getattr(self, "generated_kind", "GEN")
        self.scope, self.remap, self.enabled, self.generated_kind = self.scope.new_child(flat), {**self.remap, **remap}, blocks or None, kind
        try:
            self.execute(p.code)
        finally:
            self.scope, self.remap, self.enabled, self.generated_kind = old

    def is_kind(self, narrow: str, wide: str) -> bool:
        """Whether two kinds are the same, or a row says so by words or by the lemmas of content words."""
        asked = self.store.version, words_of(narrow), words_of(wide)
        if asked[2] == "thing" or asked[1] == asked[2]:
            return True
        if "KINDOF" not in self.store:
            return False
        if asked not in self.kinds_known:
            t = self.store["KINDOF"]
            named = lambda c: F.explode(namings(F.element_at("cells", t.column(c) + 1), self.lemmas))
            rows = t.rows.select("cells", named("HYPONYM").alias("name")).where(F.col("name") == asked[1])
            self.kinds_known[asked] = not rows.select(named("HYPERNYM").alias("name")).where(F.col("name") == asked[2]).isEmpty()
        return self.kinds_known[asked]

    # expressions
    def instance(self, name: str, state: State | None = None) -> Instance:
        s = state or self.state
        name = self.remap.get(name, name)
        if name not in s.instances:
            raise ScriptError(f"no instance {name}")
        return s.instances[name]

    def state_of(self, how: str, name: str) -> State:
        at = [k for k, s in enumerate(self.states) if s.name == name]
        if not at or how == "getStateWithName" and len(at) > 1:
            raise ScriptError(f"{len(at)} states are named {name}")
        k = {"getStateWithName": at[0], "getStateFirstWithName": at[0], "getStateLastWithName": at[-1], "getStateBeforeName": at[0] - 1, "getStateAfterName": at[-1] + 1}[how]
        if not 0 <= k < len(self.states):
            raise ScriptError(f"{how}({name}): there is no such state")
        return self.states[k]

    def value(self, e: Expr, local: dict | None = None, state: State | None = None) -> Dual:
        if e.op == "lit":
            return of_text(e.args[0])
        if e.op == "num":
            return of_number(e.args[0])
        if e.op in ("var", "path"):
            name = e.args[0] if e.op == "var" else ".".join(e.args)
            got = (local or {}).get(name, self.scope.get(name))
            return got if isinstance(got, Dual) else Dual(None, None)
        if e.op == "prop":
            where, path, prop = e.args
            s = self.state_of(*where) if where else state
            return of_text(self.instance(".".join(path), s).props.get(prop))
        if e.op == "stated":
            return self.value(e.args[1], local, self.state_of(*e.args[0]))
        if e.op in ("+", "-", "*", "/", "%"):
            return arithmetic(e.op, self.value(e.args[0], local, state), self.value(e.args[1], local, state))
        if e.op == "meets":
            return of_number(float(self.meets(e.args)))
        if e.op == "generate":
            return of_text(self.generate(e.args[0], local))
        raise ScriptError(f"{e.op} is no value")

    def meets(self, args: tuple) -> bool:
        name, how, remap, _ = args
        if how and how[0] == "index":
            raise ScriptError("meetsRequirements takes a hash or conditions")
        return self.executable(name, how, remap) is not None

    def condition(self, e: Expr, local: dict | None = None) -> bool | None:
        if e.op in ("&&", "||"):
            a, b = self.condition(e.args[0], local), self.condition(e.args[1], local)
            return None if a is None or b is None else (a and b) if e.op == "&&" else (a or b)
        if e.op in ("==", "!=", "<", "<=", ">", ">="):
            return compare(e.op, self.value(e.args[0], local), self.value(e.args[1], local))
        if e.op == "double":
            a, b = (self.value(x, local) for x in e.args[0].args)
            return None if a.d is None or b.d is None else compare(e.args[0].op, a, b)
        if e.op == "change":
            parts, v = dict(e.args[1]), self.value(e.args[0], local).d
            limit = self.value(parts["threshold"], local).d if "threshold" in parts else None
            way = parts.get("direction")
            way = way if isinstance(way, str) or way is None else self.value(way, local).s
            return None if v is None or limit is None else v > limit if way == "increase" else v < limit if way == "decrease" else None
        if e.op == "truth":
            v = self.value(e.args[0], local)
            return None if v.d is None else v.d != 0
        return None

    def truth(self, e: Expr, local: dict | None = None) -> bool:
        return bool(self.condition(e, local))

    def text(self, e: Expr, local: dict | None = None) -> str:
        v = self.value(e, local)
        if v.s is None:
            raise ScriptError("an expression has no value")
        return v.s

    # statements
    def execute(self, statements: list[Statement]) -> None:
        for s in statements:
            self.tick()
            try:
                getattr(self, f"do_{s.kind}")(*s.args)
            except (ScriptError, KeyError) as e:
                raise ScriptError(f"line {s.line}: {e}") from e

    def do_declare(self, name: str, e) -> None:
        self.scope.maps[0][name] = self.value(e)

    def do_assign(self, name: str, e) -> None:
        for m in self.scope.maps:  # where it was declared
            if name in m:
                m[name] = self.value(e)
                return
        self.scope.maps[0][name] = self.value(e)

    def do_instance(self, name: str, kind: Expr) -> None:
        self.state.instances[name] = Instance(self.text(kind))

    def do_instantiate(self, name: str, kind: Expr, props: tuple[str, ...]) -> None:
        """An instance with what the PROP tables say of its kind: object, property and value columns."""
        if kind.op == "kindprops":
            kind, props = kind.args[0], kind.args[1]
        inst = Instance(self.text(kind))
        for p, v in common_properties(self.store, inst.kind).collect():
            if not props or p in props:
                inst.props.setdefault(p, v)
        self.state.instances[name] = inst

    def do_setprop(self, e: Expr, value: Expr) -> None:
        where, path, prop = e.args
        if where:
            raise ScriptError("only the current state can be changed")
        v = self.value(value)
        self.instance(".".join(path)).props[prop] = str(v.d) if v.d is not None else v.s

    def generate(self, ref: tuple, local: dict | None = None) -> str:
        table, cells = ref
        t = self.store[table]
        row = [""] * len(t.header)
        for c, e in cells:
            row[t.column(c)] = self.text(e, local)
        got = self.store.insert(table, self.spark.createDataFrame([(row,)], "cells array<string>"), getattr(self, "generated_kind", "GEN"))
        self.cut(table)
        return got.first().uid

    def do_generate(self, ref: tuple) -> None:
        self.generate(ref)

    def do_removeRow(self, e: Expr) -> None:
        uid = self.text(e).removeprefix("UUID")
        for t in list(self.store.tables.values()):
            self.keep(t, F.col("uid") != uid)

    def do_removeRows(self, ref: tuple) -> None:
        table, cells = ref
        t = self.store[table]
        fits = F.lit(True)
        for c, e in cells:
            fits = fits & (F.lower(F.trim(F.element_at("cells", t.column(c) + 1))) == self.text(e).strip().lower())
        self.keep(t, ~fits)

    def keep(self, t: Table, rows: Column) -> None:
        self.store.add(Table(t.name, t.header, t.rows.where(rows), t.roles))

    def do_executePattern(self, name: str, how: tuple | None, remap: tuple, blocks: tuple) -> None:
        p = self.patterns.get(name)
        if p is None:
            raise ScriptError(f"no pattern {name}")
        if remap and len(dict(remap)) != len(self.needed(p)):
            raise ScriptError(f"executePattern({name}): it needs {len(self.needed(p))} instances, {len(dict(remap))} are given")
        found = self.executable(name, how, remap)
        if found is None:
            raise ScriptError(f"executePattern({name}): no solution that is meant meets the requirements")
        m, pairs = found
        for var, of in p.components:
            part = self.component_match(var, of, m)
            if part is not None:
                self.run_match(self.patterns[of], part, self.part_pairs(p, var, pairs), frozenset(blocks))
        self.run_match(p, m, pairs, frozenset(blocks))
        self.state.runs.append(name)
        self.do_incrementState()

    def do_executeAutoPatterns(self) -> None:
        self.auto()

    def do_populateInfPatMatches(self) -> None:
        self.populate()

    def do_incrementState(self) -> None:
        self.states.append(State("", copy.deepcopy(self.state.instances)))

    def do_setStateName(self, e: Expr) -> None:
        self.state.name = self.text(e)

    def do_getStateWithName(self, name: str, e: Expr) -> None:
        self.scope.maps[0][name] = of_number(float(self.states.index(self.state_of("getStateWithName", self.text(e)))))

    def do_temporalblock(self, name: str, body: list[Statement]) -> None:
        if self.enabled and name in self.enabled:
            self.execute(body)

    def do_if(self, arms: list, other: list) -> None:
        for cond, body in arms:
            if self.truth(cond):
                return self.inside(body)
        return self.inside(other)

    def inside(self, body: list[Statement]) -> None:
        self.scope = self.scope.new_child()
        try:
            self.execute(body)
        finally:
            self.scope = self.scope.parents

    def do_while(self, cond: Expr, body: list[Statement]) -> None:
        for _ in range(LOOPS):
            if not self.truth(cond):
                return
            try:
                self.inside(body)
            except Break:
                return

    def do_break(self) -> None:
        raise Break

    def do_exit(self, code: int) -> None:
        raise Exit(code)

    def do_verifyAnswer(self, cond: Expr) -> None:
        if not self.truth(cond):
            raise Exit(-10)

    def do_setEnvironmentVariable(self, name: str, value: str) -> None:
        if name != "maxMatches":
            raise ScriptError(f"no setting {name}")
        self.max_matches = int(float(value))

    def do_attachRowToInstance(self, name: str, e: Expr) -> None:
        self.instance(name).rows.append(self.text(e).removeprefix("UUID"))

    def do_detachRowFromInstance(self, name: str, e: Expr) -> None:
        uid = self.text(e).removeprefix("UUID")
        self.instance(name).rows = [r for r in self.instance(name).rows if r != uid]

    def do_println(self, e: Expr) -> None:
        self.say(self.text(e))

    def do_addExplanationText(self, e: Expr) -> None:
        self.state.explanation.append(self.text(e))

    def do_printInstances(self) -> None:
        for n, i in self.state.instances.items():
            self.say(f"{n} [{i.kind}] {i.props}")

    def do_printVariables(self) -> None:
        for n, v in sorted(self.scope.items()):
            self.say(f"{n} = {v.s}")

    def do_printState(self) -> None:
        self.say(f"state {len(self.states) - 1} {self.state.name}")
        self.do_printInstances()

    def do_processStageTransition(self, e: Expr) -> None:
        self.state.runs.append(".".join(map(str, e.args)))

    def do_processStageComplete(self) -> None:
        pass

    def path(self, name: str | None, default: str) -> str:
        if name is None and self.output is None:
            raise ScriptError("an export needs an output path")
        return name or f"{self.output}/{default}"

    def found(self) -> list[tuple[Pattern, DataFrame]]:
        self.populate(self.due)
        return [(self.patterns[n], m) for n, m in self.matches.items()]

    def do_exportInfPatJSON(self, name: str | None) -> None:
        sinks.write_matches_json(self.path(name, "matches.json"), self.found(), self.store)

    def do_exportInfPatHTML(self, name: str | None) -> None:
        sinks.write_matches_html(self.path(name, "matches.html"), self.found(), self.store)

    def do_exportInfPatDebugHTML(self, name: str | None) -> None:
        sinks.write_candidates_html(self.path(name, "debug.html"), self.found(), self.store, self.lemmas)

    def do_exportTableStoreHTML(self, name: str | None) -> None:
        sinks.write_store_html(self.path(name, "tables.html"), self.store)

    def do_exportStateSpaceHTML(self, name: str | None) -> None:
        sinks.write_states_html(self.spark, self.path(name, "states.html"), [{"name": s.name, "instances": {n: i.props for n, i in s.instances.items()}, "explanation": s.explanation} for s in self.states])

    def states_frame(self) -> DataFrame:
        """(state_idx, state, instance, kind, property, value, is_numeric)."""
        rows = [(k, s.name, n, i.kind, p, v, of_text(v).d is not None) for k, s in enumerate(self.states) for n, i in s.instances.items() for p, v in i.props.items()]
        return self.spark.createDataFrame(rows, "state_idx int, state string, instance string, kind string, property string, value string, is_numeric boolean")


def common_properties(store: Store, kind: str) -> DataFrame:
    """(property, value) that the tables named PROP* give for an object of a kind."""
    out = None
    for t in store.tables.values():
        names = {h.strip().upper() for h in t.header}
        if not t.name.upper().startswith("PROP") or "PROPERTY" not in names or not names & {"VALUE", "VALUES"}:
            continue
        whose = next((c for c in ("OBJECT", "AGENT", "AGENT/OBJECT/LOCATION") if c in names), None)
        if whose is None:
            continue
        cell = lambda c, t=t: F.trim(F.get("cells", F.lit(t.column(c))))
        part = t.rows.where(F.lower(cell(whose)) == kind.lower()).select(cell("PROPERTY").alias("property"), cell("VALUE" if "VALUE" in names else "VALUES").alias("value"))
        out = part if out is None else out.unionByName(part)
    return out if out is not None else store.spark.createDataFrame([], "property string, value string")


def unpivot_properties(df: DataFrame, id: str, columns: list[str]) -> DataFrame:
    """(object, property, value): one row for each column that isn't null, as text."""
    each = F.explode(F.array(*(F.struct(F.lit(c).alias("property"), F.col(c).cast("string").alias("value")) for c in columns)))
    return df.select(F.col(id).alias("object"), each.alias("e")).select("object", "e.property", "e.value").where("value is not null")


def enumerate_patterns(spark: SparkSession, store: Store, program: Program, max_matches: int = MAX_MATCHES, threads: int = 4) -> tuple[list[tuple[Pattern, DataFrame]], dict[str, float]]:
    """Solve every pattern after the automatic ones, `threads` at a time; the solutions and a summary of them. Each table is
    annotated once for all patterns, and slots with equal constraints are solved once."""
    run = Runtime(spark, store, program)
    run.max_matches = max_matches
    run.auto()
    share(store, program.patterns)
    run.populate()
    with ThreadPoolExecutor(max(1, threads)) as pool:  # each count is a job of its own, which fills the pattern's cache
        counts = dict(zip(run.matches, pool.map(lambda m: m.count(), run.matches.values()), strict=True))
    slots = [len(p.slots) for p in program.patterns]
    variables = [len({c for c in run.matches[p.name].columns if c.startswith("v_")}) for p in program.patterns]
    n = max(len(slots), 1)
    return run.found(), {"solutions": sum(counts.values()), "patterns": len(counts), "at_limit": sum(c >= max_matches for c in counts.values()), "mean_slots": sum(slots) / n, "mean_variables": sum(variables) / n}


def run_properties(spark: SparkSession, config: Config) -> dict[str, dict[str, float]]:
    """The enumeration run that a properties file describes: each pattern file's solutions as <name>.json, and as pages where
    asked for; the summary of each file."""
    from patternloom.plans.parser import load
    from patternloom.sources.tablestore import load_store

    given, out, told = Path(config.input_path), config.output_path.rstrip("/"), {}
    for file in [given] if given.suffix == ".iml" else sorted(given.glob("*.iml")):
        store = load_store(spark, config.store_index, whole_rows=config.whole_rows)  # automatic patterns of one file add nothing to the next
        found, told[file.name] = enumerate_patterns(spark, store, load(file), config.max_matches, config.threads)
        sinks.write_matches_json(f"{out}/{file.name}.json", found, store)
        if config.export_html:
            sinks.write_matches_html(f"{out}/{file.name}.html", found, store)
        if config.export_store_html:
            sinks.write_store_html(f"{out}/{file.name}.tables.html", store)
        for _, m in found:
            m.unpersist()
    return told


def main(argv: list[str] | None = None) -> int:
    """Command line: --script with --tablestoreIndex, --outputPath, --timeLimit, --twolineHeader, --lemmas; or
    --props alone; or --tablestoreIndex with --exportTablestore, which writes the tables as one JSON document."""
    import argparse

    from patternloom.plans.parser import load
    from patternloom.sources.readers import lemma_dictionary, properties
    from patternloom.sources.tablestore import load_store

    a = argparse.ArgumentParser(prog="patternloom")
    a.add_argument("--props")
    a.add_argument("--script")
    a.add_argument("--tablestoreIndex")
    a.add_argument("--outputPath")
    a.add_argument("--timeLimit", type=float)
    a.add_argument("--twolineHeader", action="store_true")
    a.add_argument("--lemmas")
    a.add_argument("--exportTablestore")
    args = a.parse_args(argv)
    if not args.props and not (args.tablestoreIndex and (args.script or args.exportTablestore)):
        a.error("--props, or --tablestoreIndex with --script or --exportTablestore, are needed")
    spark = SparkSession.builder.getOrCreate()
    if args.props:
        for name, told in run_properties(spark, properties(args.props)).items():
            print(f"{name}: {told}")
        return 0
    store = load_store(spark, args.tablestoreIndex, args.twolineHeader)
    if args.exportTablestore:
        sinks.write_store_document(args.exportTablestore, store)
    if not args.script:
        return 0
    program = load(args.script)
    lemmas = lemma_dictionary(spark, args.lemmas, store.words(sorted(set(literals(program))))) if args.lemmas else None
    run = Runtime(spark, store, program, args.outputPath, args.timeLimit, lemmas)
    code = run.run()
    print("\n".join(run.printed))
    return code
