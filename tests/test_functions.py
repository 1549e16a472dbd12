"""Column functions against plain Python."""

import itertools
import math
import random

from pyspark.sql import functions as F

from patternloom.functions import annotate as A
from patternloom.functions import scalar as S
from patternloom.functions.omni import VALUE, omni_eq, omni_join, omni_keys, omni_merge, omni_text


def equal(a, b):
    return len(a) == len(b) and all(set(x) & set(y) for x, y in zip(a, b, strict=True))


def values(n, seed=3):
    rng = random.Random(seed)
    return [[[rng.choice("abcdef") for _ in range(rng.randint(1, 2))] for _ in range(rng.randint(0, 3))] for _ in range(n)]


def test_omni_join_equals_brute_force(spark):
    a, b = values(60), values(60, 4)
    left = spark.createDataFrame(list(enumerate(a)), f"i int, va {VALUE}")
    right = spark.createDataFrame(list(enumerate(b)), f"j int, vb {VALUE}")
    got = sorted((r.i, r.j) for r in omni_join(left, right, "va", "vb").collect())
    assert got == sorted((i, j) for i, j in itertools.product(range(60), range(60)) if equal(a[i], b[j]))
    plan = omni_join(left, right, "va", "vb")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_omni_equality_is_not_transitive(spark):
    df = spark.createDataFrame([([["cats", "cat"]], [["cat", "feline"]], [["feline"]])], f"a {VALUE}, b {VALUE}, c {VALUE}")
    r = df.select(omni_eq(F.col("a"), F.col("b")).alias("ab"), omni_eq(F.col("b"), F.col("c")).alias("bc"), omni_eq(F.col("a"), F.col("c")).alias("ac"), omni_text(F.col("b")).alias("t"), omni_keys(F.col("a")).alias("k")).first()
    assert (r.ab, r.bc, r.ac, r.t, len(r.k)) == (True, True, False, "feline", 2)


def test_relaxed_merge(spark):
    df = spark.createDataFrame([([["a", "b"], ["c"]], [["b"], ["x"]], [["q"], ["z"]])], f"a {VALUE}, b {VALUE}, c {VALUE}")
    r = df.select(omni_merge(F.col("a"), F.col("b")).alias("x"), omni_merge(F.col("a"), F.col("c")).alias("y")).first()
    assert r.x == [["b"]]  # positions without overlap are dropped
    assert r.y == [["a", "b"], ["c"]]  # nothing in common: as it was


def test_ieee_and_dual(spark):
    df = spark.createDataFrame([(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (6.0, 4.0)], "a double, b double")
    q = [r[0] for r in df.select(S.ieee_divide(F.col("a"), F.col("b"))).collect()]
    assert q[0] == math.inf and q[1] == -math.inf and math.isnan(q[2]) and q[3] == 1.5
    one = spark.range(1)
    cmp = lambda op, a, b: one.select(S.dual_compare(op, S.dual_text(F.lit(a)), S.dual_text(F.lit(b)))).first()[0]
    assert cmp("<", "9", "10") is True and cmp("<", "9", "10x") is False and cmp("==", "5", "5.0") is True
    add = one.select(S.dual_arithmetic("+", S.dual_text(F.lit("a")), S.dual_text(F.lit("1"))).alias("x")).first().x
    assert (add.d, add.s) == (None, "a1")
    assert one.select(S.strict_or(F.lit(None).cast("boolean"), F.lit(True))).first()[0] is None


def java_hash(s):
    h = 0
    for c in s:
        left = (h << 5) & 0xFFFFFFFF
        left = left - (1 << 32) if left >= 1 << 31 else left
        h = (left ^ (h >> 27)) ^ ord(c)
    return int(math.fmod(h, 1_000_000))


def test_row_hash(spark):
    words = ["", "a0b2-a45f-01e1-4bf4", "abc", "zzzzzzzzzzzzzzzzzzz"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select(S.row_hash(F.col("w"))).collect()
    assert [r[0] for r in got] == [java_hash(w) for w in words]


def test_questions(spark):
    one = spark.range(1)
    parts = one.select(S.stem_and_choices(F.lit("Why? (A) one (B) two"))).first()[0]
    assert parts == ["Why?", "one", "two"]
    idx = lambda x: one.select(S.answer_index(F.lit(x))).first()[0]
    assert [idx(x) for x in ("A", "e", "1", "5", "F", "")] == [0, 4, 0, 4, -1, -1]
    e = one.select(S.explanation(F.lit(" AA|central bb|LEX aa|LEX "))).first()[0]
    assert [(x.uid, x.role) for x in e] == [("aa", "CENTRAL"), ("bb", "LEX")]
    assert one.select(S.topic_prefix(F.lit("A_B_C"), 2)).first()[0] == "A_B"
    assert one.select(S.sanitised(F.lit("object/agent 2"))).first()[0] == "OBJECT_AGENT_2"


def test_alternatives_and_annotation(spark):
    one = spark.range(1)
    assert one.select(S.alternatives(F.lit("a-b ; c"))).first()[0] == ["a-b", "c", "a b"]
    alts = one.select(A.annotate(F.lit("the big cats ; "))).first()[0]
    assert [[t.lemma for t in ts] for ts in alts] == [["big", "cat"], []]
    assert one.select(A.annotate(F.lit(""))).first()[0] == [[]]


def test_names_and_token_sets(spark):
    one = spark.range(1)
    first = lambda c: one.select(c).first()[0]
    assert first(A.namings(F.lit("The Cats ; dogs"))) == ["the cats", "cat"]
    assert first(A.namings(F.lit(""))) == [] and first(A.namings(F.lit("the"))) == ["the"]
    known = F.create_map(F.lit("cat"), F.lit("feline"))
    assert set(first(A.question_tokens(F.lit("the Cats"), F.lit("run"), known))) == {"Cats", "cat", "feline", "run"}
    assert set(first(A.question_tokens(F.lit("a cat"), F.lit(None).cast("string")))) == {"cat"}
    assert set(first(A.row_tokens(F.lit(" the cat "), known))) == {"the", "cat", "feline"} and first(A.row_tokens(F.lit(""))) == []


def test_literal_spans(spark):
    df = spark.createDataFrame([([["a"], ["b", "x"], ["a"], ["b"]],), ([],)], "s array<array<string>>")
    assert [r[0] for r in df.select(A.literal_spans(F.col("s"), ["A", "b"])).collect()] == [[0, 2], []]
    got = [[(x.start, x.until) for x in r[0]] for r in df.select(A.relaxed_spans(F.col("s"), ["b", "a"])).collect()]
    assert got == [[(0, 2), (1, 3), (2, 4)], []]
