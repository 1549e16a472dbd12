"""Patterns to DataFrames: candidates for each slot, joins on shared variables, the fold of bindings."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternloom.functions.omni import FEW, VALUE, class_join, keyed_join, loose_keys, omni_eq, omni_keys, omni_merge, omni_text
from patternloom.functions.scalar import applied, match_hash, row_hash
from patternloom.operators.segment import segments
from patternloom.plans.ast import Element, Expr, Pattern, Slot
from patternloom.plans.conditions import Scope, evaluate
from patternloom.sources.tablestore import Store

MAX_MATCHES = 25_000
#: Planned bytes of the slots' tables from which on joins count their keys first.
LARGE = 1 << 30
#: What the planner takes for the size of rows that it can't tell, as those given by the driver or checkpointed.
UNKNOWN = 1 << 60


@dataclass
class Occurrence:
    """A place of a variable: slot, its column in the slot's candidates, the element, and whether it may be without a value
    (an optional element, or one that not all options of its cell have)."""

    var: str
    slot: int
    column: str
    element: Element
    loose: bool = False


@dataclass
class Candidates:
    slot: Slot
    rows: DataFrame
    occurrences: list[Occurrence] = field(default_factory=list)
    static: bool = False
    bytes: int = 0


def lowered(slot: Slot, constants: dict[str, str]) -> Slot:
    """The slot as it is solved: constants in place of their variables; literals of a static row without variables are
    comments."""
    cells = []
    for name, options in slot.ref.cells:
        cells.append((name, tuple(tuple(Element("literal", constants[e.text], e.optional, e.relaxable) if e.kind == "variable" and e.text in constants else e for e in o) for o in options)))
    if slot.ref.uuid is not None and not any(e.kind == "variable" for _, os in cells for o in os for e in o):
        cells = []
    return Slot(slot.name, type(slot.ref)(slot.ref.table, slot.ref.uuid, tuple(cells)), slot.optional)


#: Row ids that last from run to run; all other rows are known by their content.
LASTING_UID = "^.{4}-.{4}-.{4}-.{4}"


def wanted_cells(store: Store, name: str, slot: Slot) -> list[tuple[int, tuple[tuple[Element, ...], ...]]]:
    return [(store[name].column(c), options) for c, options in slot.ref.cells]


def constraint(name: str, slot: Slot, wanted: list) -> tuple:
    """What decides which rows fit a slot, and how: whatever its variables are called."""
    said = lambda e: (e.kind, e.text.lower() if e.kind == "literal" else "", e.optional, e.relaxable)
    return name.upper(), slot.ref.uuid, tuple((c, tuple(tuple(map(said, o)) for o in options)) for c, options in wanted)


def fitting(store: Store, name: str, slot: Slot, wanted: list, lemmas: Column | None, large: bool = False) -> DataFrame:
    """uid, hash, relaxed and v0, v1 ... (the variables' values in order): every way in which a table's row fits a slot.

    Of a large table each combination of the wanted cells' texts is annotated and segmented once.
    """
    columns = [c for c, _ in wanted]
    by_text = large and columns and store.shared is None and not store.whole_rows
    rows = every = store[name].rows if by_text else store.annotated(name, columns, lemmas)
    content = F.lower(store[name].text(data_only=True))
    if slot.ref.uuid is not None:
        rows = every = rows.where(F.col("uid") == slot.ref.uuid)
    if by_text:
        rows = store[name].annotated_texts(every, columns, lemmas)
    out = [F.col("uid"), row_hash(F.when(F.col("uid").rlike(LASTING_UID), F.col("uid")).otherwise(content)).alias("hash")]
    relaxed, k = F.lit(0), 0
    for i, (c, options) in enumerate(wanted):
        rows = rows.withColumn(f"_seg{i}", F.explode(segments(F.col(f"alts_{c}"), options)))
        relaxed = relaxed + F.col(f"_seg{i}.relaxed")
        for at in range(max(sum(e.kind == "variable" for e in o) for o in options)):
            out.append(F.try_element_at(F.col(f"_seg{i}.values"), F.lit(at + 1)).alias(f"v{k}"))
            k += 1
    out.append(relaxed.cast("int").alias("relaxed"))
    if by_text:
        ways = rows.select("_x", *out[2:])
        return every.withColumn("_x", store[name].cell_texts(columns)).join(ways, "_x").select(*out[:2], *ways.columns[1:])
    return rows.select(*out)


def candidates(store: Store, slot: Slot, number: int, tables_of_uid: dict[str, str] | None = None, lemmas: Column | None = None, large: bool = False) -> Candidates:
    """uid, relaxed and a value column for each variable occurrence: every way in which a row fits the slot."""
    ref, p = slot.ref, f"s{number}_"
    name = ref.table
    if name is None:
        name = (tables_of_uid if tables_of_uid is not None else store.locate([ref.uuid]))[ref.uuid]
    if name is None:  # a static row that no table holds
        none = store.rows().where("1 = 0").select(F.col("uid").alias(f"{p}uid"), F.lit(0).alias(f"{p}hash"), F.lit(0).alias(f"{p}relaxed"))
        return Candidates(slot, none, [], True)
    wanted = wanted_cells(store, name, slot)
    keep: list[Occurrence] = []
    for _, options in wanted:
        names = [[e for e in o if e.kind == "variable"] for o in options]
        for at in range(max(map(len, names))):
            # options may bind different variables at the same place: each is an occurrence of its own
            if len({o[at].text for o in names if len(o) > at}) > 1:
                raise ValueError(f"slot {slot.name}: the options of a cell must name the same variables in the same order")
            e = next(o[at] for o in names if len(o) > at)
            keep.append(Occurrence(e.text, number, f"{p}v{len(keep)}", e, any(len(o) <= at or o[at].optional for o in names)))
    rows = store.once(constraint(name, slot, wanted), lambda: fitting(store, name, slot, wanted, lemmas, large))
    return Candidates(slot, rows.select(*(F.col(c).alias(p + c) for c in rows.columns)), keep, ref.uuid is not None, store[name].planned_bytes())


def share(store: Store, patterns: list[Pattern]) -> None:
    """Until a table changes: annotate each table of these patterns once, and solve slots once whose constraints several have."""
    where = store.locate([u for p in patterns for u in static_uids(p)])
    seen, columns = Counter(), {}
    for p in patterns:
        for slot in (lowered(s, p.constants) for s in p.slots):
            name = slot.ref.table or where[slot.ref.uuid]
            if name is not None:
                wanted = wanted_cells(store, name, slot)
                columns.setdefault(name.upper(), set()).update(c for c, _ in wanted)
                seen[constraint(name, slot, wanted)] += 1
    store.share({name: sorted(c) for name, c in columns.items()}, {k for k, n in seen.items() if n > 1})


def occurrences(cands: list[Candidates]) -> dict[str, list[Occurrence]]:
    """The places of each variable in declared order."""
    out: dict[str, list[Occurrence]] = {}
    for o in (o for c in cands for o in c.occurrences):
        out.setdefault(o.var, []).append(o)
    return out


@dataclass
class Link:
    """A condition between what is joined already and a slot to come: a value there, a column here, and whether either may
    be missing, in which case it fits everything."""

    left: Column
    right: str
    left_open: bool
    right_open: bool


class Links:
    """What may be asked of a join without losing a solution of the fold over declared order.

    A variable's first place binds it, if that always has a value: each later place is linked with it, until a relaxable one
    may have changed the binding. Where the first place may be empty (an optional element or slot), another place may bind:
    two places are linked with each other in either order; more are joined in declared order, each with the fold so far.
    """

    def __init__(self, cands: list[Candidates]) -> None:
        self.cands, self.of = cands, occurrences(cands)
        self.firm = {v for v, os in self.of.items() if not self.open(os[0])}

    def open(self, o: Occurrence) -> bool:
        return o.loose or self.cands[o.slot].slot.optional

    def ordered(self, var: str) -> bool:
        return var not in self.firm and len(self.of[var]) > 2

    def ready(self, slot: int, done: list[int]) -> bool:
        """Whether the slot's places can be linked: binders come first, and all earlier places where the order counts."""
        for var, os in self.of.items():
            mine = next((k for k, o in enumerate(os) if o.slot == slot), None)
            if mine is None:
                continue
            before = os[:1] if var in self.firm else os[:mine] if self.ordered(var) else []
            if any(o.slot not in done and o.slot != slot for o in before):
                return False
        return True

    def between(self, slot: int, done: list[int]) -> list[Link]:
        out = []
        for var, os in self.of.items():
            mine = [o for o in os if o.slot == slot]
            if not mine:
                continue
            if var in self.firm:
                if os[0].slot in done:
                    still = [o for k, o in enumerate(os) if o.slot == slot and not any(x.element.relaxable for x in os[1 : k + 1])]
                    out += [Link(F.col(os[0].column), o.column, False, o.loose) for o in still]
                continue
            o = mine[0]
            k = os.index(o)
            before = [x for x in os[:k] if x.slot in done]
            after = [x for x in os[k + 1 :] if x.slot in done]
            if before and not o.element.relaxable:
                out.append(Link(fold(before, self.open), o.column, all(map(self.open, before)), o.loose))
            elif len(os) == 2 and after and not after[0].element.relaxable:
                out.append(Link(fold(after, self.open), o.column, self.open(after[0]), o.loose))
        return out

    def within(self, slot: int) -> list[tuple[str, str]]:
        """Columns of one slot that hold the same variable, the first of them its binder."""
        out = []
        for var in self.firm:
            os = self.of[var]
            if os[0].slot == slot:
                out += [(os[0].column, o.column) for k, o in enumerate(os) if k and o.slot == slot and not any(x.element.relaxable for x in os[1 : k + 1])]
        return out


def fold(places: list[Occurrence], open_) -> Column:
    """The binding after these places, in order; null where none has a value."""
    bound = F.lit(None).cast(VALUE)
    for o in places:
        v = F.col(o.column)
        skip = missing(v) if open_(o) else v.isNull()
        bound = F.when(skip, bound).when(bound.isNull(), v).otherwise(omni_merge(bound, v) if o.element.relaxable else bound)
    return bound


def missing(v: Column) -> Column:
    return v.isNull() | (F.size(v) == 0)


def joined(cands: list[Candidates], tasks: int | None = None) -> DataFrame:
    """All combinations of candidates that agree as far as they are linked; an optional slot is also left unfilled.

    Static slots come first, then connected ones before others, of these the one with more links, or of a smaller table; a
    slot on which others depend before them.
    """
    links = Links(cands)
    sizes = [estimate(c) for c in cands]
    todo = sorted(range(len(cands)), key=lambda i: (cands[i].slot.optional, not cands[i].static, i))
    done: list[int] = []
    out: DataFrame | None = None
    while todo:
        ready = [i for i in todo if links.ready(i, done)]
        if out is None:
            firm = [i for i in ready if not cands[i].slot.optional] or ready
            pick = min(firm, key=lambda i: (not cands[i].static, sizes[i], i))
        else:
            held = {i: links.between(i, done) for i in ready}
            firmly = lambda i: sum(not x.right_open and not x.left_open for x in held[i])  # noqa: B023, E731
            pick = min(ready, key=lambda i: (cands[i].slot.optional, not held[i] and not cands[i].static, not cands[i].static, -firmly(i), sizes[i], i))  # noqa: B023
        todo.remove(pick)
        c = cands[pick]
        rows = c.rows
        for a, b in links.within(pick):
            rows = rows.where(missing(F.col(b)) | omni_eq(F.col(a), F.col(b)))
        both = rows if out is None else connect(out, rows, links.between(pick, done), tasks)
        if c.slot.optional:
            empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in rows.schema]
            if out is None:
                both = both.unionByName(rows.sparkSession.range(1).select(*empty))
            else:
                both = both.unionByName(out.select("*", *empty))
        out = both
        done.append(pick)
    return out


def estimate(c: Candidates) -> int:
    """Bytes of a slot's table as far as the planner knows them, less for each literal that cuts its rows down."""
    literals = sum(all(any(e.kind == "literal" and not e.optional for e in o) for o in options) for _, options in c.slot.ref.cells)
    return c.bytes >> 3 * literals


def connect(left: DataFrame, right: DataFrame, links: list[Link], tasks: int | None = None) -> DataFrame:
    """Join on omni-equality: hashed on keys, with the exact conditions as residual.

    Links that always have both values make the keys, all of them together. Without such a one, a link that may lack a value
    does: rows that have it meet by its keys, and those that lack it are brought to all rows of the other side, which are dealt
    over copies of them; so what is copied is never more than the rows without a value. Without a link all rows are combined.
    """
    if not links:
        return left.crossJoin(right)
    residual = F.lit(True)
    for x in links:
        fits = omni_eq(x.left, F.col(x.right))
        if x.right_open:
            fits = missing(F.col(x.right)) | fits
        if x.left_open:
            fits = x.left.isNull() | fits
        residual = residual & fits
    hard = [x for x in links if not x.left_open and not x.right_open]
    if hard and tasks is not None:
        values = lambda side: [F.col(f"{side}.v{k}") for k in range(len(hard))]
        equal = F.lit(True)
        for a, b in zip(values("_l"), values("_r"), strict=True):
            equal = equal & omni_eq(a, b)
        meet = lambda a, b: keyed_join(a, b, omni_keys(*values("_l")), omni_keys(*values("_r")), equal, tasks if a.count() + b.count() > FEW else None)
        both = class_join(left, right, [x.left for x in hard], [F.col(x.right) for x in hard], meet, tasks)
        return both if len(hard) == len(links) else both.where(residual)
    if hard:
        return keyed_join(left, right, omni_keys(*(x.left for x in hard)), omni_keys(*(F.col(x.right) for x in hard)), residual, tasks)
    x = min(links, key=lambda x: x.left_open + x.right_open)
    salt = lambda df: F.xxhash64(*(c for c in df.columns if c.endswith("_uid")))
    lk = loose_keys(x.left, x.left.isNull() if x.left_open else None, salt(left), "l", "r" if x.right_open else None)
    rk = loose_keys(F.col(x.right), missing(F.col(x.right)) if x.right_open else None, salt(right), "r", "l" if x.left_open else None)
    return keyed_join(left, right, lk, rk, residual, tasks)


def bind(out: DataFrame, cands: list[Candidates]) -> DataFrame:
    """v_<name> for each variable, the fold over its occurrences in declared order, and o_<name>; rows that disagree go.

    Where the first place always has a value and none is relaxable, the joins have compared all places with it already.
    """
    places, firm = occurrences(cands), Links(cands).firm
    for var in places:
        if var in firm and not any(o.element.relaxable for o in places[var][1:]):
            bound = F.col(places[var][0].column)
            out = out.withColumns({f"v_{var}": bound, f"o_{var}": as_written(bound, [F.col(o.column) for o in places[var]])})
            continue
        bound, good = F.lit(None).cast(VALUE), F.lit(True)
        for o in places[var]:
            v = F.col(o.column)
            skip = missing(v) if o.loose or cands[o.slot].slot.optional else v.isNull()
            if o.element.relaxable:
                bound = F.when(skip, bound).when(bound.isNull(), v).otherwise(omni_merge(bound, v))
            else:
                good = good & (skip | bound.isNull() | F.coalesce(omni_eq(bound, v), F.lit(True)))
                bound = F.when(bound.isNull() & ~skip, v).otherwise(bound)
        out = out.withColumns({f"v_{var}": bound, f"o_{var}": F.when(bound.isNotNull(), as_written(bound, [F.col(o.column) for o in places[var]]))}).where(good)
    return out


def as_written(bound: Column, values: list[Column]) -> Column:
    """A binding's words as its cells have them: at each position those of the first place that has its lemma, as a relaxable
    place may have left the lemma alone."""
    cells = F.array_compact(F.array(*values))
    found = "try_element_at(filter(flatten(cs), q -> element_at(q, -1) = element_at(p, -1)), 1)[0]"
    return applied(f"(b, cs) -> array_join(transform(b, p -> coalesce({found}, p[0])), ' ')", bound, cells)


def static_uids(pattern: Pattern) -> list[str]:
    """The rows that a pattern names without their tables."""
    return [s.ref.uuid for s in pattern.slots if s.ref.table is None and s.ref.uuid is not None]


def names_in(e) -> set[str] | None:
    """The variables of a condition; None where it also reads anything else than variables and literals."""
    if not isinstance(e, Expr):
        return set()
    if e.op == "var":
        return {e.args[0]}
    if e.op in ("path", "prop", "stated", "meets", "generate", "change"):
        return None
    found = [names_in(a) for a in e.args]
    return None if None in found else set().union(*found)


def filter_early(cands: list[Candidates], cond: Expr) -> None:
    """Filter a slot's rows by a condition that they alone decide: all its variables are bound there for good."""
    names = names_in(cond)
    if not names:
        return
    bound: dict[str, Occurrence] = {}
    for o in (o for c in cands for o in c.occurrences):
        first = bound.setdefault(o.var, o)
        if o.element.relaxable or first.loose:
            return
    if names <= bound.keys() and len({bound[n].slot for n in names}) == 1:
        c = cands[bound[next(iter(names))].slot]
        if not c.slot.optional:
            c.rows = c.rows.where(F.coalesce(evaluate(cond, Scope({n: omni_text(F.col(bound[n].column)) for n in names})), F.lit(True)))


def one_way_each(cands: list[Candidates]) -> bool:
    """Whether no row fits its slot in two ways: then solutions differ in their rows, and none comes twice. One job."""
    ways = None
    for i, c in enumerate(cands):
        rows = c.rows.select(F.lit(i).alias("slot"), F.col(f"s{i}_uid").alias("uid"))
        ways = rows if ways is None else ways.unionByName(rows)
    return ways is None or ways.groupBy("slot", "uid").count().where("count > 1").isEmpty()


def solve(store: Store, pattern: Pattern, max_matches: int | None = MAX_MATCHES, lemmas: Column | None = None, solved: dict[str, DataFrame] | None = None, tasks: int | None = None, sources: list[Store] | None = None, distinct: bool = True) -> DataFrame:
    """The solutions of a pattern: uid_<slot>, relax_<slot>, v_<variable>, o_<variable> (its words as they stand in the cells),
    n_opt_unfilled, relaxed_dyn, relaxed_total, executable, should_score, hash; without duplicates (same rows and same lemma text
    of all bindings; of such the least relaxed one is kept), and ordered where there is a limit.
    A solution is executable if its conditions could all be evaluated and each musthave holds; conditions on instances can't
    be evaluated here, but once instances are mapped. The hash adds up those of the filled rows, by their ids where these last,
    else by their DATA text, and those of the components' solutions.

    Components (`infpat a = P`) are taken from solved[P]; their slots and variables appear as a.x. Where `tasks` is given, or
    the slots' tables are planned to have more than LARGE bytes, equal texts are annotated once and joins compare classes of
    equal values, whose rows are dealt over the tasks; counting these takes jobs for each join, which small tables don't need.
    With `sources` each slot reads a store of its own. Where duplicates don't matter, distinct=False leaves them in and spares a
    shuffle; large tables also spare it where no row fits its slot in two ways, composites where their components are distinct.
    """
    slots = [lowered(s, pattern.constants) for s in pattern.slots]
    where = store.locate(static_uids(pattern))
    stores = sources or [store] * len(slots)
    if tasks is None and len(slots) > 1:
        names = [s.ref.table or where[s.ref.uuid] for s in slots]
        if LARGE < sum(st[n].planned_bytes() for st, n in zip(stores, names, strict=True) if n is not None) < UNKNOWN:
            tasks = int(store.spark.conf.get("spark.sql.shuffle.partitions"))
    cands = [candidates(st, s, i, where, lemmas, tasks is not None) for i, (st, s) in enumerate(zip(stores, slots, strict=True))]
    for kind, cond in pattern.constraints:
        if kind == "musthaveoromit":
            filter_early(cands, cond)
    once = distinct
    out = bind(joined(cands, tasks), cands) if cands else None
    if out is not None:
        for c, i in zip(cands, range(len(cands)), strict=True):
            out = out.withColumnsRenamed({f"s{i}_uid": f"uid_{c.slot.name}", f"s{i}_relaxed": f"relax_{c.slot.name}"})
    if pattern.components:
        from patternloom.operators.composite import compose

        parts = [(solved or {})[of] for _, of in pattern.components]
        tasks = max([tasks or 0, *(getattr(p, "_tasks", None) or 0 for p in parts)]) or None
        out = compose(out, pattern, solved or {}, tasks)
        distinct = distinct and not (all(getattr(p, "_distinct", False) for p in parts) and (not cands or tasks is not None and one_way_each(cands)))
    elif distinct and cands and tasks is not None:
        distinct = not one_way_each(cands)
    if out is None:
        out = store.spark.range(1).select(F.lit(0).alias("_one"))
    uids = [c for c in out.columns if c.startswith("uid_")]
    values = [c for c in out.columns if c.startswith("v_")]
    words = [c for c in out.columns if c.startswith("o_")]
    loosened = [c for c in out.columns if c.startswith("relax_")]
    relaxed = lambda keep: sum((F.coalesce(F.col(f"relax_{c.slot.name}"), F.lit(0)) for c in cands if keep(c)), F.lit(0))
    unfilled = sum((F.col(u).isNull().cast("int") for u in uids), F.lit(0))
    out = out.withColumns({"n_opt_unfilled": unfilled.cast("int"), "relaxed_dyn": relaxed(lambda c: not c.static).cast("int"), "relaxed_total": relaxed(lambda c: True).cast("int")})
    told = lambda c: c.replace("__", ".")  # noqa: E731  a component's names follow its own and a dot
    scope = Scope({told(v[2:]): omni_text(F.col(v)) for v in values} | {told(u[4:]): F.when(F.col(u).isNull(), F.lit("")).otherwise(F.concat(F.lit("UUID"), u)) for u in uids})
    executable, score, shoulds = F.lit(True), F.lit(0.0), 0
    for kind, cond in pattern.constraints:
        got = evaluate(cond, scope)
        executable = executable & got.isNotNull()
        if kind == "musthaveoromit":
            out = out.where(F.coalesce(got, F.lit(True)))
        elif kind == "musthave":
            executable = executable & F.coalesce(got, F.lit(False))
        else:
            score, shoulds = score + F.coalesce(got, F.lit(False)).cast("double"), shoulds + 1
    parts = [F.col(f"s{i}_hash") for i in range(len(cands))] + [F.col(f"hash_{a}") for a, _ in pattern.components]
    hashes = F.filter(F.array(*parts), lambda h: h.isNotNull()) if parts else F.array().cast("array<int>")
    out = out.withColumns({"executable": executable, "should_score": score / max(shoulds, 1), "hash": match_hash(hashes)})
    rest = ["n_opt_unfilled", "relaxed_dyn", "relaxed_total", *loosened, *words, *values, "executable", "should_score", "hash"]
    texts = {f"_t{i}": F.coalesce(omni_text(F.col(v)), F.lit("\x00")) for i, v in enumerate(values)}
    out = out.select(*uids, *rest).withColumns(texts)
    if distinct and (uids or texts):
        out = out.groupBy(*uids, *texts).agg(F.min(F.struct(*rest)).alias("_s")).select(*uids, *(F.col(f"_s.{c}").alias(c) for c in rest), *texts)
    if max_matches is not None:
        out = out.orderBy("n_opt_unfilled", "relaxed_dyn", "relaxed_total", *uids, *texts).limit(max_matches)
    out = out.drop(*texts)
    out._distinct, out._tasks = once, tasks  # what a composite of these solutions needs to know
    return out
