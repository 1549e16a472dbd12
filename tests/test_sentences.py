"""Tags of words within the sentence that their row is."""

import itertools
import random

from pyspark.sql import functions as F

from patternloom.functions import annotate as A
from patternloom.plans.compile import solve
from patternloom.plans.parser import parse
from patternloom.sources.tablestore import Store, from_rows

CLOSED = {w: t for t, words in A.CLOSED.items() for w in words}


def guess(word):
    if word.isdigit():
        return "CD"
    return "RB" if word.endswith("ly") else "VB" if word.endswith(("ning", "ped")) else "JJ" if word.endswith(("tive", "less")) else "NN"


def brute(words):
    """The best of all tag sequences."""
    may = [{CLOSED[w]: 0} if w in CLOSED else {"CD": 0} if guess(w) == "CD" else {t: 0 if t == guess(w) else A.UNLIKELY for t in A.OPEN_TAGS} for w in words]
    score = lambda path: sum(m[t] for m, t in zip(may, path, strict=True)) + sum(A.FOLLOWS.get(f"{a} {b}", 0) for a, b in zip(path, path[1:], strict=False))
    return list(max(itertools.product(*may), key=lambda p: (score(p), p)))


def test_decoder_equals_trying_all_paths(spark):
    rng = random.Random(2)
    words = ["the", "to", "can", "of", "it", "and", "stone", "running", "trapped", "slowly", "active", "endless", "7", "water"]
    rows = [(k, rng.choices(words, k=rng.randrange(7))) for k in range(150)]
    got = spark.createDataFrame(rows, "k int, w array<string>").select("k", A.sentence_tags(F.col("w")).alias("t")).collect()
    assert {r.k: r.t for r in got} == {k: brute(w) for k, w in rows}


def store_of(spark, whole_rows):
    s = Store(spark, whole_rows)
    s.add(from_rows(spark, "T", ["[FILL] BEFORE", "WORD", "AFTER", "[SKIP] UID"], [["the", "Water", "is cold", "t1"], ["to", "Water", "a plant", "t2"], ["we can", "water ; stop", "", "t3"], ["", "running-water", "flows", "t4"], ["", "", "water", "t5"]]))
    return s


def tags(spark, whole_rows):
    rows = store_of(spark, whole_rows)["T"].annotated([1], content_only=False, whole_rows=whole_rows).collect()
    return {r.uid: [tags_of(a) for a in r.alts_1] for r in rows}


def tags_of(alternative):
    """The last that a token is known by is pos: and its tag."""
    return [t[-1].removeprefix("pos:").upper() for t in alternative.slots]


def test_a_tag_depends_on_the_cells_around(spark):
    assert tags(spark, True) == {"t1": [["NN"]], "t2": [["VB"]], "t3": [["VB"], ["VB"]], "t4": [[brute(["running-water", "flows"])[0]], brute(["running", "water", "flows"])[:2]], "t5": [[]]}
    assert all(a in ([], ["NN"], ["VB", "NN"]) for v in tags(spark, False).values() for a in v)


def test_patterns_read_whole_rows(spark):
    p = parse('inferencepattern p row a=[TABLE:"T", WORD: "POS:VB"] endinferencepattern').patterns[0]
    assert {r.uid_a for r in solve(store_of(spark, True), p).collect()} == {"t2", "t3"}
    assert solve(store_of(spark, False), p).count() == 0


def test_spans_are_mapped_back_to_their_cells(spark):
    rng, words = random.Random(3), ["the", "to", "stone", "running", "slowly", "7", "of", "water"]
    cells = [[" ".join(rng.choices(words, k=rng.randrange(4))) for _ in range(3)] + [f"u{k}"] for k in range(40)]
    s = Store(spark, True)
    s.add(from_rows(spark, "T", ["A", "[FILL] B", "C", "[SKIP] UID"], cells))
    got = {r.uid: r for r in s["T"].annotated([0, 2], content_only=False, whole_rows=True).collect()}
    for a, b, c, uid in cells:
        every = brute(f"{a} {b} {c}".split())
        n = len(a.split())
        for alts, want_words, want in ((got[uid].alts_0, a, every[:n]), (got[uid].alts_2, c, every[len(every) - len(c.split()) :])):
            assert tags_of(alts[0]) == want
            assert [v[0] for v in alts[0].value] == want_words.split()
