"""Composite patterns: solutions of patterns joined on equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.functions.omni import class_join
from patternloom.plans.ast import Pattern


def prefixed(matches: DataFrame, name: str) -> DataFrame:
    """A component's slots, variables, their words and hash (as a number) under its name."""
    named = [(kind, c) for c in matches.columns for kind in ("uid_", "v_", "o_", "relax_") if c.startswith(kind)]
    keep = [F.col(c).alias(f"{kind}{name}.{c[len(kind) :]}") for kind, c in named]
    return matches.select(*keep, F.conv("hash", 16, 10).cast("int").alias(f"hash_{name}"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Classes of equal row ids (see class_join); slots that aren't filled have no equal."""
    filled = lambda side, n: F.greatest(*(F.col(f"{side}.v{k}").isNull() for k in range(n)), F.lit(False))
    n = len(a.schema["_l"].dataType.fields)
    return a.where(~filled("_l", n)).join(b.where(~filled("_r", n)), F.col("_l") == F.col("_r"))


def compose(own: DataFrame | None, pattern: Pattern, solved: dict[str, DataFrame], tasks: int | None = None) -> DataFrame:
    """The pattern's own rows with those of its components; rowequiv a.r = b.q is an equality of row ids, hence a hash join.

    A part without a rowequiv to those before it is combined with all of them. With `tasks`, rows of solutions that share the
    same rows are dealt over these.
    """
    safe = lambda ref: f"uid_{ref}".replace(".", "__")
    out = own
    done = set(own.columns) if own is not None else set()
    for name, of in pattern.components:
        part = prefixed(solved[of], name)
        part = part.toDF(*(c.replace(".", "__") for c in part.columns))
        if out is None:
            out = part
        else:
            on = [(safe(x), safe(y)) for a, b in pattern.rowequivs for x, y in ((a, b), (b, a)) if safe(x) in done and safe(y) in part.columns]
            if on and tasks is not None:
                out = class_join(out, part, [F.col(x) for x, _ in on], [F.col(y) for _, y in on], same_rows, tasks)
            elif on:
                cond = F.lit(True)
                for x, y in on:
                    cond = cond & (out[x] == part[y])
                out = out.join(part, cond)
            else:
                out = out.crossJoin(part)
        done |= set(part.columns)
    return out
