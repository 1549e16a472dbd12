"""Set-valued ("omni") equality of token sequences as Column expressions.

A value is an ARRAY<ARRAY<STRING>>: for each position the set of the token's representations (word, lemma). Two values
are equal if they have as many positions and every position's sets meet. The relation is symmetric, not transitive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from patternloom.checkpoints import checkpoint
from patternloom.functions.scalar import applied

VALUE = "array<array<string>>"


def omni_eq(a: Column, b: Column) -> Column:
    """Equal length, and the sets at every position have a common element."""
    return applied("(a, b) -> size(a) = size(b) AND forall(zip_with(a, b, (x, y) -> coalesce(arrays_overlap(x, y), false)), z -> z)", a, b)


def omni_keys(*values: Column) -> Column:
    """Blocking keys of values that are to agree with as many others: equal ones share at least one.

    A key holds the values' lengths and one representation of the token at each of at most three places: of a single value
    the first, the second and the last, so that a word with which most values begin doesn't bring them all together; of
    several values the last and, of the first one if there are two, the first.
    """
    keys, used = "array('')", values[:3]
    for k in range(len(used)):
        v = f"v.v{k}"
        n = f"size({v})"
        keys = f"transform({keys}, k -> concat(k, '\x1e', cast({n} AS string)))"
        first, second = (2, 1), (3, 2)  # a place is that of values of at least so many tokens; the last one is that of all
        places = [] if k or len(used) > 2 else [first] if len(used) == 2 else [first, second]
        for least, at in [*places, (1, n)]:
            held = f"if({n} >= {least}, array_distinct(try_element_at({v}, {at})), array(''))"
            keys = f"flatten(transform({keys}, k -> transform({held}, t -> concat(k, '\x1f', t))))"
    return applied(f"v -> transform({keys}, k -> xxhash64(k))", F.struct(*(v.alias(f"v{k}") for k, v in enumerate(used))))


def omni_merge(bound: Column, value: Column) -> Column:
    """The binding after a relaxable occurrence: the non-empty intersections where any position agrees, else as it was."""
    meet = F.filter(F.zip_with(bound, value, lambda x, y: F.array_intersect(x, y)), lambda s: F.size(s) > 0)
    return F.when((F.size(bound) == F.size(value)) & (F.size(meet) > 0), meet).otherwise(bound)


def omni_text(v: Column) -> Column:
    """The last representation of each position (its lemma), joined by spaces."""
    return applied("v -> array_join(transform(v, p -> element_at(p, -1)), ' ')", v)


def literal_value(tokens: list[list[str]]) -> Column:
    return F.array(*(F.array(*(F.lit(t) for t in p)) for p in tokens)).cast(VALUE) if tokens else F.array().cast(VALUE)


def omni_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, residual: Column | None = None) -> DataFrame:
    """Inner join on omni-equality: a hash join on blocking keys, then the exact predicate.

    Values can meet on several keys; only the smallest common one counts, so every pair comes once and nothing is deduplicated.
    """
    on = omni_eq(F.col(left_value), F.col(right_value))
    return keyed_join(left, right, omni_keys(F.col(left_value)), omni_keys(F.col(right_value)), on if residual is None else on & residual)


def keyed_join(left: DataFrame, right: DataFrame, left_keys: Column, right_keys: Column, residual: Column, tasks: int | None = None) -> DataFrame:
    """Pairs of rows whose key sets meet and that fulfil the residual condition, each once: at their smallest common key.

    With `tasks`, keys that have more rows than such a part of their side are dealt out (see dealt()).
    """
    a = left.withColumn("_ka", left_keys).withColumn("_k", F.explode("_ka"))
    b = right.withColumn("_kb", right_keys).withColumn("_kr", F.explode("_kb"))
    on = (F.col("_k") == F.col("_kr")) & (F.col("_k") == F.array_min(F.array_intersect("_ka", "_kb"))) & residual
    if tasks is not None:
        a, b = dealt(a, b, tasks)
        on = on & (F.col("_i") == F.col("_ir")) & (F.col("_j") == F.col("_jr"))
    return a.join(b, on).drop("_ka", "_kb", "_k", "_kr", "_i", "_ir", "_j", "_jr")


def dealt(a: DataFrame, b: DataFrame, tasks: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a cell (_i, _j and _ir, _jr) beside the key: a hot key's pairs are a grid of cells.

    A key is hot if one side has more than its share of rows for it, a `tasks`-th part of them: so at most `tasks` keys of
    each side are. Its left rows are dealt over the grid's rows and copied to each of its columns, the right ones the other way.
    """
    counts = a.groupBy(F.col("_k").alias("k")).agg(F.count("*").alias("l"), F.lit(0).cast("long").alias("r")).unionByName(b.groupBy(F.col("_kr").alias("k")).agg(F.lit(0).cast("long").alias("l"), F.count("*").alias("r")))
    counts = counts.groupBy("k").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    nl, nr = (max(1, (x or 0) // tasks) for x in counts.agg(F.sum("l"), F.sum("r")).first())
    found = counts.where((F.col("l") > nl) | (F.col("r") > nr)).where("l > 0 and r > 0").collect()  # at most 2 * tasks keys
    hot = a.sparkSession.createDataFrame([(r.k, -(-r.l // nl), -(-r.r // nr)) for r in found], "_h long, _m long, _n long")
    one = F.lit(0).cast("long")

    def spread(side: DataFrame, key: str, i: str, j: str, mine: str, other: str) -> DataFrame:
        out = side.join(F.broadcast(hot), F.col(key) == F.col("_h"), "left")
        lot = F.coalesce(F.pmod(F.xxhash64(*side.columns), F.col(mine)), one)  # by content: a task that runs again deals alike
        copies = F.coalesce(F.sequence(one, F.col(other) - 1), F.array(one))
        return out.withColumn(i, lot).withColumn(j, F.explode(copies)).drop("_h", "_m", "_n")

    return spread(a, "_k", "_i", "_j", "_m", "_n"), spread(b, "_kr", "_jr", "_ir", "_n", "_m")


#: Pairs up to which a cell of a class's grid isn't divided, and pairs of classes up to which they are broadcast.
CELL, FEW = 1 << 20, 10_000


def class_join(left: DataFrame, right: DataFrame, left_on: list[Column], right_on: list[Column], meet: Callable[[DataFrame, DataFrame], DataFrame], tasks: int) -> DataFrame:
    """Pairs of rows whose values meet. Rows with equal values are a class; only the classes are compared, and their rows are
    joined by numbers.

    meet joins two saved tables of classes, (_l, _nl) and (_r, _nr): a struct of values and how many rows have it; it gives each
    pair of classes once. A pair of classes is a grid of cells by its numbers of rows, as near to squares as copies the fewest rows.
    """
    a = left.withColumn("_l", F.struct(*(x.alias(f"v{k}") for k, x in enumerate(left_on))))
    b = right.withColumn("_r", F.struct(*(x.alias(f"v{k}") for k, x in enumerate(right_on))))
    own, other = (checkpoint(x) for x in (a.groupBy("_l").agg(F.count("*").cast("double").alias("_nl")), b.groupBy("_r").agg(F.count("*").cast("double").alias("_nr"))))
    met = checkpoint(meet(own, other).select("_l", "_r", "_nl", "_nr", F.monotonically_increasing_id().alias("_p")))
    n, total, nl, nr = (x or 0 for x in met.agg(F.count("*"), F.sum(F.col("_nl") * F.col("_nr")), F.sum("_nl"), F.sum("_nr")).first())
    parts = int(max(1, min(4 * tasks, total / CELL + (nl + nr) / 100_000)))
    cells = F.ceil(F.col("_nl") * F.col("_nr") / F.lit(float(max(CELL, total / (16 * tasks)))))
    high = F.least(F.col("_nl"), F.greatest(F.lit(1.0), F.round(F.sqrt(cells * F.col("_nl") / F.col("_nr"))))).cast("long")
    grid = met.withColumn("_m", high).withColumn("_n", F.least(F.col("_nr"), F.ceil(cells / F.col("_m"))).cast("long"))

    def spread(side: DataFrame, own: str, i: str, j: str, mine: str, other: str) -> DataFrame:
        here = grid.select(own, "_p", "_m", "_n")
        out = side.join(F.broadcast(here) if n <= FEW else here, own)
        ids = [c for c in side.columns if c.startswith("uid_") or c.endswith("_uid")] or side.columns
        out = out.withColumn(i, F.pmod(F.xxhash64(*ids), F.col(mine)))  # by content: a task that runs again deals alike
        return out.withColumn(j, F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop(own, "_m", "_n").repartition(parts, "_p", "_i", "_j")

    x, y = spread(a, "_l", "_i", "_j", "_m", "_n"), spread(b, "_r", "_j", "_i", "_n", "_m")
    both = x.join(y, ["_p", "_i", "_j"]) if nl >= nr else y.join(x, ["_p", "_i", "_j"])
    return both.select(*left.columns, *right.columns)


#: Rows that fit whatever the other side holds are copied so many times, the other side's rows dealt over the copies.
COPIES = 16


def loose_keys(value: Column, open_: Column | None, salt: Column, mine: str, other: str | None) -> Column:
    """Keys of a side on which values may be missing: a row without one (open_) meets every row of the other side.

    mine and other name the two sides' open rows: an open row is copied under COPIES keys of its own side, and each row takes
    one of the other side's, where that has open ones (other is given).
    """
    named = lambda side, k: F.xxhash64(F.lit(f"\x1d{side}"), k)
    keys = omni_keys(value)
    if open_ is not None:
        keys = F.when(open_, F.transform(F.sequence(F.lit(0), F.lit(COPIES - 1)), lambda k: named(mine, k))).otherwise(keys)
    return keys if other is None else F.concat(keys, F.array(named(other, F.pmod(salt, F.lit(COPIES)).cast("int"))))


#: The most frequent words whose counts order a row's words; they are broadcast.
FREQUENT = 10_000


def overlap_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, left_words: str, right_words: str, least: int = 1) -> DataFrame:
    """(left_id, right_id, shared): pairs of rows whose word sets have at least `least` words in common; rows of one id are one.

    Each row's words are put in one order, rare ones first. Two sets of which `least` words agree also agree in one of the words
    that are left when each loses its last `least` - 1: only these are joined, so the words that most rows have stay out of the
    join from two words on. A pair is told at its rarest common word alone, and its words are counted then.
    """
    sides = [left.select(F.col(left_id).alias("_id"), F.explode(F.array_distinct(left_words)).alias("_w")), right.select(F.col(right_id).alias("_id"), F.explode(F.array_distinct(right_words)).alias("_w"))]
    counts = sides[0].unionByName(sides[1]).groupBy("_w").agg(F.count("*").alias("_n")).where("_n > 1").orderBy(F.desc("_n"), "_w").limit(FREQUENT)

    def ordered(side: DataFrame, id: str) -> DataFrame:
        named = side.where("_w is not null").distinct().join(F.broadcast(counts), "_w", "left").groupBy("_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_w").alias("w")))).alias("_o"))
        out = named.where(F.size("_o") >= least).select(F.col("_id").alias(id), "_o", F.slice("_o", F.lit(1), F.size("_o") - (least - 1)).alias("_p"))
        return out.withColumn("_k", F.explode("_p"))

    a, b = ordered(sides[0], "_a"), ordered(sides[1], "_b").withColumnsRenamed({"_o": "_q", "_p": "_r", "_k": "_m"})
    both = a.join(b, (F.col("_k") == F.col("_m")) & (F.col("_k") == F.array_min(F.array_intersect("_p", "_r"))))
    return both.select(F.col("_a").alias(left_id), F.col("_b").alias(right_id), F.size(F.array_intersect("_o", "_q")).cast("long").alias("shared")).where(F.col("shared") >= least)
