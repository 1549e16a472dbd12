"""Transitive closure of an edge table, and the fixpoint of rules that generate rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.checkpoints import checkpoint
from patternloom.functions.annotate import annotate, namings
from patternloom.functions.scalar import tokens
from patternloom.sources.tablestore import Store

ROUNDS = 50


def transitive_closure(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = ROUNDS) -> DataFrame:
    """All (src, dst) with a path of one edge or more, each once; terminates on cycles.

    Paths double each round (new paths joined with all known), so the rounds follow the logarithm of the longest path; a
    round is cut off from the last by a checkpoint.
    """
    known = checkpoint(edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).where("src is not null and dst is not null").distinct())
    delta = known
    for _ in range(rounds):
        a = delta.select("src", F.col("dst").alias("mid"))
        b = known.select(F.col("src").alias("mid"), "dst")
        c = known.select("src", F.col("dst").alias("mid"))
        d = delta.select(F.col("src").alias("mid"), "dst")
        found = a.join(b, "mid").select("src", "dst").unionByName(c.join(d, "mid").select("src", "dst")).distinct()
        delta = checkpoint(found.join(known, ["src", "dst"], "left_anti"))
        if delta.isEmpty():
            break
        known = checkpoint(known.unionByName(delta))
    else:
        raise RuntimeError(f"the closure is not complete after {rounds} rounds")
    return known.select(F.col("src").alias(src), F.col("dst").alias(dst))


def complete_taxonomy(store: Store, table: str = "KINDOF", narrow: str = "HYPONYM", wide: str = "HYPERNYM", rounds: int = ROUNDS) -> int:
    """Add the implied rows of a kind-of table as TEMPGEN rows; returns how many.

    A row's wide cell meets another's narrow cell if an alternative's content lemmas equal its first alternative's.
    """
    t = store[table]
    i, j = t.column(narrow), t.column(wide)
    lemmas = lambda c: F.transform(annotate(F.element_at("cells", c + 1)), lambda ts: F.array_join(F.transform(ts, lambda x: x["lemma"]), " "))
    pairs = t.rows.select(F.element_at(lemmas(i), 1).alias("src"), F.explode(lemmas(j)).alias("dst")).where("src <> '' and dst <> ''")
    closed = transitive_closure(pairs, rounds=rounds)
    new = closed.join(pairs.distinct(), ["src", "dst"], "left_anti").where("src <> dst")
    cells = F.array(*(F.col("src") if k == i else F.col("dst") if k == j else F.lit("") for k in range(len(t.header))))
    before = t.rows.count()
    store.insert(table, new.select(cells.alias("cells")), "TEMPGEN")
    store.add(type(t)(t.name, t.header, checkpoint(store[table].rows), t.roles))
    return store[table].rows.count() - before


def fixpoint(step: Callable[[], None], size: Callable[[], int], rounds: int = ROUNDS) -> int:
    """Repeat step until size() stays as it was; the number of rounds. Fails where it still grows after the last one."""
    before = size()
    for k in range(1, rounds + 1):
        step()
        now = size()
        if now == before:
            return k
        before = now
    raise RuntimeError(f"no fixpoint after {rounds} rounds")


def kind_of_semi_join(rows: DataFrame, value: str, kind: str, kinds: DataFrame) -> DataFrame:
    """rows whose value is `kind` or a kind of it by kinds(src, dst); everything is a kind of thing.

    A cell of kinds counts with its first alternative, named by its words or by the lemmas of its content words.
    """
    asked = words_of(kind)
    if asked == "thing":
        return rows
    wide = kinds.where(F.array_contains(namings(F.col("dst")), asked)).select(F.explode(namings(F.col("src"))).alias("_k"))
    wide = wide.unionByName(kinds.sparkSession.range(1).select(F.lit(asked).alias("_k"))).distinct()
    return rows.join(wide, F.array_join(tokens(F.lower(F.col(value))), " ") == F.col("_k"), "left_semi")


def words_of(text: str) -> str:
    """A kind's words as namings() has them."""
    return " ".join(w for w in text.lower().split(" ") if w)
