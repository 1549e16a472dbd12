"""Evaluation operators on small tables with ties and missing gold rows; readers."""

import pytest
from pyspark.sql import functions as F

from patternloom.operators import evaluation as E
from patternloom.sources import readers


def test_average_precision(spark):
    scores = spark.createDataFrame([("q1", "a", 3.0), ("q1", "b", 2.0), ("q1", "c", 2.0), ("q2", "a", 1.0)], "question string, uid string, score double")
    gold = spark.createDataFrame([("q1", "a"), ("q1", "c"), ("q2", "z"), ("q3", "a")], "question string, uid string")
    got = {r.question: round(r.ap, 6) for r in E.average_precision(scores, gold).collect()}
    assert got == {"q1": round((1 + 2 / 3) / 2, 6), "q2": 0.0, "q3": 0.0}
    assert E.mean_average_precision(scores, gold).first().questions == 3
    recall = {r.question: (r.hits, r.extras) for r in E.top_n_recall(scores, gold, 2).collect()}
    assert recall == {"q1": (1, 1), "q2": (0, 1), "q3": (0, 0)}


def test_combinations(spark):
    sols = spark.createDataFrame([("q", 1, ["a", "x"]), ("q", 2, ["b"]), ("q", 3, ["a", "b", "y", "z"]), ("q", 4, ["n"])], "question string, solution int, uids array<string>")
    gold = spark.createDataFrame([("q", ["a", "b", "c"])], "question string, gold array<string>")
    best = E.best_combination(sols, gold, 2).first()
    assert (best.ids, best.hits, best.extras) == ([1, 2], 2, 1)
    assert E.best_combination(sols, gold, 1).first().ids == [3]
    scores = spark.createDataFrame([("q", u, s) for u, s in (("a", 5.0), ("b", 4.0), ("x", 1.0))], "question string, uid string, score double")
    assert {r.solution: r.score for r in E.score_sum(sols, scores, cutoff=1).collect()}[1] == 5.0
    assert {r.solution: r.score for r in E.score_sum(sols, scores, cutoff=1, mode="compat").collect()}[1] == 6.0


def test_histogram_and_tfidf(spark):
    h = {r.bin: r.n for r in E.histogram(spark.createDataFrame([(0.0,), (0.1,), (1.0,), (2.0,)], "x double"), "x").collect()}
    assert (h[0], h[1], h[9], sum(h.values())) == (1, 1, 1, 3)
    w = E.tfidf(spark.createDataFrame([("d", "a"), ("d", "a"), ("d", "b"), ("e", "a")], "doc string, word string"))
    assert w.groupBy("doc").agg(F.sum(F.col("weight") ** 2).alias("s")).where("abs(s - 1) > 1e-9").count() == 0


def test_readers(spark, tmp_path):
    (tmp_path / "q7.tsv").write_text("uuid\trowText\tisGoldRow\tscore_0\tscore_1\nu1\tt\t1\t0.1\t0.9\n")
    assert tuple(readers.rankings(spark, str(tmp_path / "q7.tsv"), "probabilities").first()) == ("q7", "u1", 0.9)
    (tmp_path / "l.tsv").write_text("QuestionID\tExplanationID\tScore\tIsGold\nq1\tu\t0.5\t1\nq2\tv\t0.4\t0\n")
    assert readers.rankings(spark, str(tmp_path / "l.tsv"), "listed", "q2").first().uid == "v"
    (tmp_path / "qs.tsv").write_text("questionID\tquestion\tanswerKey\texplanation\nq1\tWhy? (A) x (B) y\tB\tu1|central\n")
    q = readers.questions(spark, str(tmp_path / "qs.tsv")).first()
    assert (q.stem, q.choices, q.answer, q.explanation[0].role, q.topic) == ("Why?", ["x", "y"], 1, "CENTRAL", None)
    (tmp_path / "n.csv").write_text("Word,V.Mean.Sum,A.Mean.Sum,D.Mean.Sum\nJoy,9,1,\n")
    assert tuple(readers.word_norms(spark, str(tmp_path / "n.csv")).first()) == ("joy", 1.0, 0.0, -1.0)
    (tmp_path / "c.props").write_text("# run\nmaxMatches = 10\nnumThreads=2\nexportInfPatHTML = true\n")
    c = readers.properties(str(tmp_path / "c.props"))
    assert (c.max_matches, c.threads, c.export_html) == (10, 2, True)
    assert readers.chunk_patterns("a\n\nb\n\nc\n", 2) == ["a\n\nb", "c"]
    with pytest.raises(ValueError):
        readers.rankings(spark, "x", "other")
    (tmp_path / "r.tsv").write_text("Q1\t\nabcd\n01ab-23cd-45ef-6789\t2\ttext\n")
    assert [tuple(r) for r in readers.ratings(spark, str(tmp_path / "r.tsv")).collect()] == [("abcd", "01ab-23cd-45ef-6789", 2)]


def test_question_layouts(spark, tmp_path):
    head = "GRADE\tTopic\tquestionid\tQUESTION\tisMultipleChoiceQuestion\tincludesDiagram\n"
    rows = ["4\tA_B, c\tq1\tWhy? (A) x (B) y\t1\t0", "4\t\tq2\tNo choices\t0\t0", "4\t\tq3\tLook (A) z\t1\t1", "\t\tq4\t\t1\t0"]
    (tmp_path / "new.tsv").write_text(head + "\n".join(rows) + "\n")
    assert [(r.question, r.grade, r.topics, r.choices, r.answer) for r in readers.questions(spark, str(tmp_path / "new.tsv")).collect()] == [("q1", "4", ["A_B", "C"], ["x", "y"], -1)]
    old = ["id,o,points,key,mc,diagram,exam,grade,year,cat,question", 'q1,o1,1,3,1,0,E,5,2010,,"What, then? (a) x (b) y (C) z"', "q2,o2,,E,1,0,E,5,2010,,Which (1) one (2) two", "q3,o3,1,A,1,1,E,5,2010,,Look (A) z"]
    (tmp_path / "old.csv").write_text("\n".join(old) + "\n")
    got = [(r.question, r.stem, r.choices, r.answer, r.kind, r.topics) for r in readers.questions_fixed(spark, str(tmp_path / "old.csv")).orderBy("question").collect()]
    assert got == [("q1", "What, then?", ["x", "y", "z"], 2, "", []), ("q2", "Which", ["one", "two"], -1, "", [])]


def test_other_rankings(spark, tmp_path):
    (tmp_path / "q8.tsv").write_text("u1\tx\ty\t0.25\nu2\tx\ty\tnone\n")
    assert sorted(tuple(r) for r in readers.rankings(spark, str(tmp_path / "q8.tsv"), "headerless").collect()) == [("q8", "u1", 0.25), ("q8", "u2", None)]
    (tmp_path / "q9_ENUM0.tsv").write_text("COS_AC_CORRECT\tother\tUUID\n0.5\t1\tu3\n")
    assert tuple(readers.rankings(spark, str(tmp_path / "q9_ENUM0.tsv"), "cosine", "q9").first()) == ("q9", "u3", 0.5)
    found = [readers.ranking_path(str(tmp_path), q) for q in ("q8", "q9", "q0")]
    assert found == [str(tmp_path / "q8.tsv"), str(tmp_path / "q9_ENUM0.tsv"), None]
    scores = spark.createDataFrame([("a", "u1", 0.5), ("b", "u2", 0.1), ("a", "u2", 0.2)], "question string, uid string, score double")
    readers.split_rankings(scores, str(tmp_path / "split"))
    assert sorted(p.name for p in (tmp_path / "split").iterdir() if p.is_dir()) == ["question=a", "question=b"]
    back = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "split"))
    assert sorted((r.question, r.uid, float(r.score)) for r in back.collect()) == [("a", "u1", 0.5), ("a", "u2", 0.2), ("b", "u2", 0.1)]


def test_each_rating_sheet_has_blocks_of_its_own(spark, tmp_path):
    (tmp_path / "sheets").mkdir()
    for k in (1, 2):  # the second sheet begins without a head: its first line has no question, not the other sheet's last
        head = "Q1\t\n" if k == 1 else ""
        (tmp_path / "sheets" / f"{k}.tsv").write_text(f"{head}01ab-23cd-45ef-000{k}\t{k}\ttext\n")
    got = sorted(tuple(r) for r in readers.ratings(spark, str(tmp_path / "sheets")).select("uid", "question", "rating").collect())
    assert got == [("01ab-23cd-45ef-0001", "Q1", 1), ("01ab-23cd-45ef-0002", None, 2)]


def test_streaming_feed(spark, tmp_path):
    from patternloom.sources.tablestore import Store, from_rows
    from patternloom.streaming.feed import feed

    s = Store(spark)
    s.add(from_rows(spark, "T", ["A", "[SKIP] UID"], [["x", "u"]]))
    spark.createDataFrame([(["x", ""],), (["y", ""],)], "cells array<string>").write.parquet(str(tmp_path / "in"))
    rows = spark.readStream.schema("cells array<string>").parquet(str(tmp_path / "in"))
    feed(rows, s, "T", checkpoint=str(tmp_path / "cp")).awaitTermination()
    assert s["T"].rows.count() == 2


def test_search_of_combinations_equals_all_of_them(spark):
    import itertools
    import random

    from patternloom.operators.evaluation import best_combination, chosen

    rng = random.Random(6)
    for _ in range(60):
        held = [(rng.getrandbits(7) | 1 << rng.randrange(7), rng.getrandbits(4)) for _ in range(rng.randrange(1, 9))]
        for k in (1, 2, 3, 4):
            every = [c for n in range(1, k + 1) for c in itertools.combinations(range(len(held)), n)]
            union = lambda c, x: __import__("functools").reduce(int.__or__, (held[i][x] for i in c)).bit_count()  # noqa: B023, E731
            best = min(every, key=lambda c: (-union(c, 0), union(c, 1), c))
            assert chosen(held, k) == (list(best), union(best, 0), union(best, 1))
    rows = [(q, s, rng.sample(range(12), rng.randrange(1, 5))) for q in range(5) for s in range(8)]
    df, gold = spark.createDataFrame(rows, "question int, solution int, uids array<int>"), spark.createDataFrame([(q, list(range(6))) for q in range(5)], "question int, gold array<int>")
    got = {r.question: (r.ids, r.hits, r.extras) for r in best_combination(df, gold, k=3).collect()}
    for q in range(5):
        mine = {s: set(u) for p, s, u in rows if p == q and set(u) & set(range(6))}
        figures = lambda c: (-len(set().union(*(mine[i] for i in c)) & set(range(6))), len(set().union(*(mine[i] for i in c)) - set(range(6))), c)  # noqa: B023, E731
        best = min((c for n in (1, 2, 3) for c in itertools.combinations(sorted(mine), n)), key=figures)
        assert got[q] == (list(best), -figures(best)[0], figures(best)[1])


def test_four_of_a_thousand_solutions_end():
    import random

    from patternloom.operators.evaluation import chosen

    rng = random.Random(7)
    held = [(sum(1 << b for b in rng.sample(range(14), rng.randrange(1, 4))), rng.getrandbits(40) & rng.getrandbits(40) & rng.getrandbits(40)) for _ in range(1_000)]
    ids, hits, extras = chosen(held, 4)
    assert len(ids) == 4 and hits == 12 and extras == (held[ids[0]][1] | held[ids[1]][1] | held[ids[2]][1] | held[ids[3]][1]).bit_count()
