"""Joins of patterns with optional rows and variables, and with hot keys: results against brute force, and plans."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from patternloom.functions.omni import keyed_join, omni_eq, omni_join, omni_keys, overlap_join
from patternloom.plans.compile import solve
from patternloom.plans.parser import parse
from patternloom.sources.tablestore import Store, from_rows

ANIMALS = ["cats", "cat", "dog", "dogs", "big cats", "big dogs", "small dog"]


def one(text):
    return parse(f"inferencepattern p {text} endinferencepattern").patterns[0]


def tables(spark, seed, n=6):
    rng, s, rows = random.Random(seed), Store(spark), {}
    for t in "ABC":
        rows[t] = [[rng.choice([*ANIMALS, ""]), rng.choice([*ANIMALS, "", "cat ; big cats"]), f"{t.lower()}{i}"] for i in range(n)]
        s.add(from_rows(spark, t, ["U", "V", "[SKIP] UID"], rows[t]))
    return s, rows


def value(text):
    """The omni value of a cell's alternative with plain plurals."""
    return [{w, w.removesuffix("s")} for w in text.split()]


def meet(a, b):
    return len(a) == len(b) and all(x & y for x, y in zip(a, b, strict=True))


def ways(row, cells):
    """All bindings of a slot's cells to a row: one list of (variable, value or None, relaxable) each."""
    each = []
    for name, var in cells:
        text = row["UV".index(name)]
        alts = [value(a.strip()) for a in text.split(";")]
        found = [v for v in alts if v]
        each.append([(var.strip("*~"), v, "~" in var) for v in found] + [(var.strip("*~"), None, False)] * ("*" in var))
    return [list(w) for w in itertools.product(*each)]


def brute(rows, slots):
    """Uids of the slots of all solutions, by the fold over declared order."""
    out = set()
    each = [[(r[2], w) for r in rows[t] for w in ways(r, cells)] + [(None, [])] * optional for t, cells, optional in slots]
    for combination in itertools.product(*each):
        bound, good = {}, True
        for var, v, relaxable in (x for _, w in combination for x in w):
            if v is None:
                continue
            if var not in bound:
                bound[var] = v
            elif relaxable:
                both = [a & b for a, b in zip(bound[var], v, strict=False) if a & b] if len(bound[var]) == len(v) else []
                bound[var] = both or bound[var]
            else:
                good = good and meet(bound[var], v)
        if good:
            out.add(tuple(u for u, _ in combination))
    return out


def text_of(slots):
    return " ".join(f"row {'*' * o}s{k}=[TABLE:\"{t}\", {', '.join(f'{c}:<{v}>' for c, v in cells)}]" for k, (t, cells, o) in enumerate(slots))


def uids(m, n):
    return {tuple(r) for r in m.select(*(f"uid_s{k}" for k in range(n))).collect()}


X, OX = [("U", "x")], [("U", "*x")]
SHAPES = [
    [("A", X, 0), ("B", OX, 0)],
    [("A", OX, 0), ("B", X, 0)],
    [("A", X, 1), ("B", X, 0)],
    [("A", X, 1), ("B", X, 1)],
    [("A", OX, 1), ("B", OX, 1)],
    [("A", X, 1), ("B", X, 0), ("C", X, 0)],
    [("A", OX, 0), ("B", X, 0), ("C", X, 0)],
    [("A", X, 1), ("B", OX, 0), ("C", X, 1)],
    [("A", [("U", "x"), ("V", "y")], 0), ("B", X, 1), ("C", [("U", "x"), ("V", "y")], 1)],
    [("A", [("U", "*x"), ("V", "y")], 0), ("B", [("U", "y"), ("V", "*x")], 0)],
    [("A", X, 1), ("B", [("U", "~x"), ("V", "y")], 0), ("C", [("U", "x"), ("V", "y")], 0)],
    [("A", [("U", "x"), ("V", "*x")], 0), ("B", OX, 1)],
]


@pytest.mark.parametrize("k", range(len(SHAPES)))
def test_optional_rows_and_variables_equal_brute_force(spark, k):
    s, rows = tables(spark, k, 5 if len(SHAPES[k]) > 2 else 8)
    assert uids(solve(s, one(text_of(SHAPES[k])), None), len(SHAPES[k])) == brute(rows, SHAPES[k])


def test_random_patterns_equal_brute_force(spark):
    rng = random.Random(11)
    for seed in range(6):
        s, rows = tables(spark, 100 + seed, 4)
        slots = [(t, [(c, rng.choice(["x", "x", "*x", "y", "*y", "~x"])) for c in rng.sample("UV", rng.choice([1, 2]))], rng.random() < 0.4) for t in rng.sample("ABC", 3)]
        assert uids(solve(s, one(text_of(slots)), None), 3) == brute(rows, slots), slots


@pytest.mark.parametrize("slots", [*SHAPES[:5], SHAPES[7]])
def test_plans_of_optional_rows_and_variables_have_no_product(spark, slots):
    s, _ = tables(spark, 1)
    for limit in ("-1", "10485760"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
        try:
            plan = solve(s, one(text_of(slots)), None)._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def largest_and_median(df):
    n = sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())
    return n[-1], n[len(n) // 2]


@pytest.fixture
def fixed_plans(spark):
    held = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_a_common_first_word_makes_no_large_task(spark, fixed_plans):
    """Nine values in ten begin with one word."""
    rows = lambda p: spark.range(6_000).select(F.concat(F.lit(p), "id").alias(f"{p}_uid"), F.array(F.array(F.when(F.col("id") % 10 < 9, "the").otherwise(F.concat(F.lit("w"), F.col("id") % 97))), F.array(F.concat(F.lit("v"), F.col("id")))).alias(p))
    got = omni_join(rows("a"), rows("b"), "a", "b")
    assert got.count() == 6_000
    large, median = largest_and_median(got)
    assert large < 3 * median


def test_hot_values_are_dealt_out(spark, fixed_plans):
    """Nine values in ten are one word alone: their pairs are a grid of cells."""
    rows = lambda p, n: spark.range(n).select(F.concat(F.lit(p), "id").alias(f"{p}_uid"), F.array(F.array(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("w"), F.col("id"))))).alias(p))
    a, b = rows("a", 2_000), rows("b", 300)
    joined = lambda tasks: keyed_join(a, b, omni_keys(F.col("a")), omni_keys(F.col("b")), omni_eq(F.col("a"), F.col("b")), tasks)
    got = joined(16)
    assert got.count() == 1_800 * 270 + 30 == got.select("a_uid", "b_uid").distinct().count()
    large, median = largest_and_median(got)
    assert large <= 3 * median and large * 5 < largest_and_median(joined(None))[0]


def test_dealt_patterns_equal_brute_force(spark):
    for k in (0, 3, 8, 10):
        s, rows = tables(spark, 50 + k, 5)
        assert uids(solve(s, one(text_of(SHAPES[k])), None, tasks=3), len(SHAPES[k])) == brute(rows, SHAPES[k])


def test_overlap_join_equals_brute_force(spark):
    rng = random.Random(5)
    sets = lambda n: [(k, rng.choices(["the", "of", "the", *"abcdefgh"], k=rng.randrange(6)) + [None] * (k % 7 == 0)) for k in range(n)]
    a, b = sets(40), sets(30)
    left, right = (spark.createDataFrame(x, "k int, w array<string>") for x in (a, b))
    for least in (1, 2, 3):
        got = {tuple(r) for r in overlap_join(left.toDF("i", "v"), right.toDF("j", "w"), "i", "j", "v", "w", least).collect()}
        shared = {(i, j): len((set(v) & set(w)) - {None}) for i, v in a for j, w in b}
        assert got == {(i, j, n) for (i, j), n in shared.items() if n >= least}


def test_words_that_all_rows_have_are_not_joined(spark):
    rows = lambda p: spark.range(4_000).select("id", F.array(F.lit("the"), F.concat(F.lit(p), "id"), F.when(F.col("id") < 5, "rare")).alias("w"))
    got = overlap_join(rows("a").toDF("i", "v"), rows("b").toDF("j", "w"), "i", "j", "v", "w", 2)
    assert got.count() == 25
