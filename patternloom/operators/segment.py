"""Span segmentation: all ways in which a sequence of literals and variables tiles a cell."""

from __future__ import annotations

import itertools

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from patternloom.functions.scalar import applied, quoted
from patternloom.plans.ast import Element

SEGMENTS = "array<struct<values:array<array<array<string>>>,relaxed:int>>"


def literal_candidates(slots: list, e: Element) -> list[tuple[int, int]]:
    """Spans where a literal stands; a relaxable one spans from each start until all its words were seen."""
    words = e.text.lower().split()
    out, n = [], len(slots)
    if e.relaxable:
        for s in range(n):
            left = set(words)
            for i in range(s, n):
                left -= set(slots[i])
                if not left:
                    out.append((s, i + 1))
                    break
    else:
        k = len(words)
        out = [(s, s + k) for s in range(n - k + 1) if all(words[i] in slots[s + i] for i in range(k))]
    return out + [(-1, -1)] * e.optional


def segment(slots: list, values: list, elements: tuple[Element, ...]) -> list[tuple[list, int]]:
    """(value of each variable or None, relaxed count) for each complete assignment over one alternative of a cell."""
    n = len(slots)
    fixed = [literal_candidates(slots, e) if e.kind == "literal" else [None] for e in elements]
    out = []
    for choice in itertools.product(*fixed):
        for spans in fill(list(choice), elements, n):
            relaxed = complete(spans, elements, n)
            if relaxed is not None:
                out.append(([[list(p) for p in values[a:b]] if a >= 0 and b > a else None for e, (a, b) in zip(elements, spans, strict=True) if e.kind == "variable"], relaxed))
    return out


def fill(spans: list, elements: tuple[Element, ...], n: int) -> list[list[tuple[int, int]]]:
    """The spans with variables placed: neighbouring ones share the gap between placed literals, in every split."""
    groups, i = [], 0
    while i < len(spans):
        if spans[i] is None:
            j = i
            while j < len(spans) and (spans[j] is None or spans[j][0] < 0):
                j += 1
            groups.append((i, j))
            i = j
        else:
            i += 1
    each = []
    for i, j in groups:
        low = next((spans[k][1] for k in range(i - 1, -1, -1) if spans[k] is not None and spans[k][1] >= 0), 0)
        high = spans[j][0] if j < len(spans) else n
        names = [k for k in range(i, j) if spans[k] is None]
        need = sum(not elements[k].optional for k in names)
        gap = high - low
        ways = []
        if gap >= need:
            for lengths in compositions(gap, [0 if elements[k].optional else 1 for k in names]):
                at, way = low, {}
                for k, size in zip(names, lengths, strict=True):
                    way[k] = (at, at + size)
                    at += size
                ways.append(way)
            if not need:
                ways.append({k: (-1, -1) for k in names})
        each.append(ways)
    out = []
    for ways in itertools.product(*each):
        done = list(spans)
        for way in ways:
            for k, s in way.items():
                done[k] = s
        out.append(done)
    return out


def compositions(total: int, least: list[int]):
    """All ways to split total into parts that have at least their minimum."""
    if not least:
        if total == 0:
            yield []
        return
    rest = sum(least[1:])
    for first in range(least[0], total - rest + 1) if len(least) > 1 else ([total] if total >= least[0] else []):
        for tail in compositions(total - first, least[1:]):
            yield [first, *tail]


def complete(spans: list, elements: tuple[Element, ...], n: int) -> int | None:
    """The number of relaxations by which the spans tile 0..n, or None if they don't."""
    at, relaxed = 0, 0
    for k, (a, b) in enumerate(spans):
        if a < 0 and elements[k].optional:
            continue
        if a != at:
            if not any(elements[x].relaxable for x in (k - 1, k, k + 1) if 0 <= x < len(elements)):
                return None
            relaxed += 1
        at = b
    if at != n:
        if not elements[-1].relaxable:
            return None
        relaxed += 1
    return relaxed


def cell_segments(alts: list, elements: tuple[Element, ...]) -> list[tuple[list, int]]:
    """All assignments over all alternatives of a cell, and the skipped one where every element is optional."""
    out = [s for alt in alts for s in segment([list(x) for x in alt["slots"]], [list(x) for x in alt["value"]], elements)]
    if all(e.optional for e in elements):
        out.append(([None for e in elements if e.kind == "variable"], 0))
    seen, unique = set(), []
    for s in out:
        key = repr(s)
        if key not in seen:
            seen.add(key)
            unique.append(s)
    return unique


def native(alts: Column, elements: tuple[Element, ...]) -> Column:
    """The segmentations of one option without relaxable elements, as a walk over its elements: the partial assignments
    (place reached, values so far) of each alternative, of which those that reach its end remain."""
    least = [len(e.text.split()) if e.kind == "literal" else 1 for e in elements]
    values, parts = "array<array<array<string>>>", "array<struct<at:int,values:array<array<array<string>>>>>"
    walk = f"array(named_struct('at', 0, 'values', cast(array() AS {values})))"
    for k, e in enumerate(elements):
        behind = elements[k + 1 :]
        if e.kind == "literal":
            fits = [f"coalesce(array_contains(get(a.slots, p.at + {i}), {quoted(w)}), false)" for i, w in enumerate(e.text.lower().split())]
            here = " AND ".join([*fits, f"p.at + {least[k]} <= size(a.slots)"])
            found = f"if({here}, array(named_struct('at', p.at + {least[k]}, 'values', p.values)), cast(array() AS {parts}))"
            skipped = "p"
        else:
            last = f"size(a.slots) - {sum(n for n, x in zip(least[k + 1 :], behind, strict=True) if not x.optional)}"
            ends = f"array({last})" if all(x.kind == "literal" and not x.optional for x in behind) else f"sequence(p.at + 1, {last})"
            found = f"transform(if(p.at + 1 <= {last}, {ends}, cast(array() AS array<int>)), e -> named_struct('at', e, 'values', concat(p.values, array(slice(a.value, p.at + 1, e - p.at)))))"
            skipped = "named_struct('at', p.at, 'values', concat(p.values, array(cast(null AS array<array<string>>))))"
        walk = f"flatten(transform({walk}, p -> {f'concat({found}, array({skipped}))' if e.optional else found}))"
    made = f"transform(flatten(transform(c, a -> filter({walk}, p -> p.at = size(a.slots)))), p -> named_struct('values', p.values, 'relaxed', 0))"
    if all(e.optional for e in elements):
        names = ", ".join("cast(null AS array<array<string>>)" for e in elements if e.kind == "variable")
        made = f"concat({made}, array(named_struct('values', cast(array({names}) AS {values}), 'relaxed', 0)))"
    return applied(f"c -> array_distinct({made})", alts).cast(SEGMENTS)


def segments(alts: Column, options: tuple[tuple[Element, ...], ...]) -> Column:
    """Column of all segmentations of a cell: array of (values of the variables in order, relaxed).

    Everything but relaxable elements is a walk inside the JVM; options with one of these go through one Arrow-batched function.
    """
    if not any(e.relaxable for o in options for e in o):
        made = [native(alts, o) for o in options]
        return F.concat(*made) if len(made) > 1 else made[0]

    @F.pandas_udf(SEGMENTS)
    def run(col: pd.Series) -> pd.Series:
        return pd.Series([[{"values": v, "relaxed": r} for option in options for v, r in cell_segments(list(c), option)] for c in col])

    return run(alts)
