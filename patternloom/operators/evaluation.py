"""Evaluation of solutions and rankings: overlap, combinations, average precision, profiles, co-occurrence, statistics."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def overlap(solutions: DataFrame, gold: DataFrame, question: str = "question", rows: str = "uids") -> DataFrame:
    """question, uids joined with gold(question, gold): hits (rows that are gold) and extras (rows that are not)."""
    both = solutions.join(gold, question)
    return both.withColumns({"hits": F.size(F.array_intersect(rows, "gold")), "extras": F.size(F.array_except(rows, "gold"))})


def best_combination(solutions: DataFrame, gold: DataFrame, k: int = 2, question: str = "question", solution: str = "solution", rows: str = "uids", by_score: str | None = None) -> DataFrame:
    """The best union of up to k solutions of a question that have a gold row, with its rows: most hits, then fewest extras (or
    the highest sum of by_score), then the smallest solution ids.

    Up to two, and scored ones, are joined; three and more are looked for question by question, with a bound (see chosen())."""
    short = overlap(solutions, gold, question, rows).where("hits > 0")
    if k > 2 and by_score is None:
        return searched(short.select(question, F.col(solution).alias("id"), F.col(rows).alias("rows"), "gold"), k, question)
    extra = [F.col(by_score).alias("score")] if by_score else [F.lit(0.0).alias("score")]
    short = short.select(question, F.col(solution).alias("id"), F.col(rows).alias("rows"), "gold", *extra)
    out = short.select(question, "gold", F.array("id").alias("ids"), F.col("id").alias("last"), "rows", "score")
    for _ in range(k - 1):
        more = short.select(F.col(question).alias("_q"), F.col("id").alias("_id"), F.col("rows").alias("_rows"), F.col("score").alias("_score"))
        out = out.join(more, (out[question] == more["_q"]) & (out["last"] <= more["_id"]))
        same = F.col("last") == F.col("_id")
        out = out.select(question, "gold", F.array_distinct(F.concat("ids", F.array("_id"))).alias("ids"), F.col("_id").alias("last"), F.array_union("rows", "_rows").alias("rows"), (F.col("score") + F.when(same, 0.0).otherwise(F.col("_score"))).alias("score"))
    out = out.withColumns({"hits": F.size(F.array_intersect("rows", "gold")), "extras": F.size(F.array_except("rows", "gold"))})
    order = [F.desc("hits"), F.desc("score") if by_score else F.asc("extras"), F.asc("extras"), F.asc("ids")]
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(question).orderBy(*order))).where("_n = 1").select(question, "ids", "hits", "extras", "score", "rows")


def searched(short: DataFrame, k: int, question: str) -> DataFrame:
    """best_combination() of more than two; of solutions with the same rows only the one with the smallest id is looked at."""
    plain = short.withColumn("rows", F.array_sort(F.array_distinct("rows"))).groupBy(question, "rows", "gold").agg(F.min("id").alias("id"))
    kind = {f.name: f.dataType.simpleString() for f in plain.schema}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        gold = set(group["gold"].iloc[0])
        number: dict = {}
        bits = lambda rows, inside: sum({1 << number.setdefault(r, len(number)) for r in rows if (r in gold) == inside})
        held = [(bits(r, True), bits(r, False)) for r in group["rows"]]
        best, hits, extras = chosen(held, k)
        return pd.DataFrame({question: [group[question].iloc[0]], "ids": [[group["id"].iloc[i] for i in best]], "hits": [hits], "extras": [extras], "score": [0.0], "rows": [sorted({r for i in best for r in group["rows"].iloc[i]})]})

    return plain.groupBy(question).applyInPandas(run, f"`{question}` {kind[question]}, ids array<{kind['id']}>, hits int, extras int, score double, rows {kind['rows']}")


def chosen(held: list[tuple[int, int]], k: int) -> tuple[list[int], int, int]:
    """Which of the solutions, given as bitmaps of their gold and other rows, are best together, with hits and extras.

    The first pass finds the best figures: solutions with many new gold rows first, no further where the largest ones left
    can't reach what was found. The second takes the first combination in order that has these figures.
    """
    size = [g.bit_count() for g, _ in held]

    def search(order: list[int], best: tuple[int, int], strictly: bool) -> tuple[list[int], tuple[int, int]]:
        """Combinations along an order that are better than best, or at least as good, where the first such one ends it."""
        most = [0] * (len(order) + 1)  # the largest solution from a place on
        for i in range(len(order) - 1, -1, -1):
            most[i] = max(most[i + 1], size[order[i]])
        found: list[int] = []

        def visit(at: int, taken: list[int], gold: int, other: int) -> bool:
            nonlocal best, found
            for i in range(at, len(order)):
                left = k - len(taken)
                if not hopeful(gold.bit_count() + left * most[i], other.bit_count()):
                    return False
                g, o = gold | held[order[i]][0], other | held[order[i]][1]
                now = (g.bit_count(), -o.bit_count())
                if hopeful(*(now[0], -now[1])):
                    best, found = now, [*taken, order[i]]
                    if not strictly:
                        return True
                if left > 1 and visit(i + 1, [*taken, order[i]], g, o):
                    return True
            return False

        def hopeful(hits: int, extras: int) -> bool:
            return (hits, -extras) > best if strictly else (hits, -extras) >= best

        visit(0, [], 0, 0)
        return found, best

    _, figures = search(sorted(range(len(held)), key=lambda i: (-size[i], held[i][1].bit_count())), (-1, 0), True)
    ids, _ = search(list(range(len(held))), figures, False)
    return ids, figures[0], -figures[1]


def ranked(scores: DataFrame, question: str = "question", uid: str = "uid", score: str = "score") -> DataFrame:
    """scores with rank: 1 for the highest score of a question, ties by uid."""
    return scores.withColumn("rank", F.row_number().over(Window.partitionBy(question).orderBy(F.desc(score), F.asc(uid))))


def average_precision(scores: DataFrame, gold: DataFrame, question: str = "question", uid: str = "uid", score: str = "score") -> DataFrame:
    """question, ap, found, gold: mean over the gold rows of i / rank of the i-th found; a gold row that isn't ranked adds 0."""
    hits = ranked(scores, question, uid, score).join(gold.select(question, uid).distinct(), [question, uid])
    hits = hits.withColumn("i", F.row_number().over(Window.partitionBy(question).orderBy("rank")))
    got = hits.groupBy(question).agg(F.sum(F.col("i") / F.col("rank")).alias("sum"), F.count("*").alias("found"))
    total = gold.select(question, uid).distinct().groupBy(question).agg(F.count("*").alias("gold"))
    out = total.join(got, question, "left")
    return out.select(question, (F.coalesce("sum", F.lit(0.0)) / F.col("gold")).alias("ap"), F.coalesce("found", F.lit(0)).cast("long").alias("found"), "gold")


def mean_average_precision(scores: DataFrame, gold: DataFrame, **names) -> DataFrame:
    return average_precision(scores, gold, **names).agg(F.avg("ap").alias("map"), F.count("*").alias("questions"))


def top_n(scores: DataFrame, n: int, by: list[str], score: str = "score", uid: str = "uid") -> DataFrame:
    """The n rows of each group with the highest score, ties by uid."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(uid))
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_n_recall(scores: DataFrame, gold: DataFrame, n: int, question: str = "question", uid: str = "uid", score: str = "score") -> DataFrame:
    """question, hits, extras, recall of the n highest-ranked rows."""
    top = top_n(scores, n, [question], score, uid)
    marked = top.join(gold.select(question, uid).distinct().withColumn("_g", F.lit(1)), [question, uid], "left")
    got = marked.groupBy(question).agg(F.count("_g").alias("hits"), (F.count("*") - F.count("_g")).alias("extras"))
    total = gold.select(question, uid).distinct().groupBy(question).agg(F.count("*").alias("gold"))
    return total.join(got, question, "left").select(question, F.coalesce("hits", F.lit(0)).cast("long").alias("hits"), F.coalesce("extras", F.lit(0)).cast("long").alias("extras"), (F.coalesce("hits", F.lit(0)) / F.col("gold")).alias("recall"))


def score_sum(solutions: DataFrame, scores: DataFrame, question: str = "question", solution: str = "solution", rows: str = "uids", cutoff: int | None = None, mode: str = "fixed") -> DataFrame:
    """question, solution, score: the sum of its rows' scores. With a cutoff, rows ranked beyond it add 0, or the cutoff
    itself in mode "compat"."""
    r = ranked(scores)
    each = solutions.select(question, solution, F.explode(rows).alias("uid")).join(r, [question, "uid"], "left")
    value = F.col("score")
    if cutoff is not None:
        value = F.when(F.col("rank") > cutoff, F.lit(float(cutoff) if mode == "compat" else 0.0)).otherwise(value)
    return each.groupBy(question, solution).agg(F.sum(F.coalesce(value, F.lit(0.0))).alias("score"))


def mean_rank_by_rating(scores: DataFrame, ratings: DataFrame, question: str = "question", uid: str = "uid") -> DataFrame:
    """rating, mean_rank, n over questions with at most one rating of zero."""
    clean = ratings.groupBy(question).agg(F.count_if(F.col("rating") == 0).alias("zeros")).where("zeros <= 1").select(question)
    return ranked(scores, question, uid).join(ratings.join(clean, question), [question, uid]).groupBy("rating").agg(F.avg("rank").alias("mean_rank"), F.count("*").alias("n"))


def topic_profile(overlaps: DataFrame, topics: DataFrame, levels: int, question: str = "question", pattern: str = "pattern") -> DataFrame:
    """topic (its first levels), pattern, mean_hits and, where overlaps has a share (hits by gold rows), mean_share: the mean
    over the topic's questions of the pattern's best."""
    from patternloom.functions.scalar import topic_prefix

    named = topics.select(question, topic_prefix(F.col("topic"), levels).alias("topic")).distinct()
    size = named.groupBy("topic").agg(F.count("*").alias("n"))
    what = [c for c in ("hits", "share") if c in overlaps.columns]
    best = overlaps.groupBy(question, pattern).agg(*(F.max(c).alias(c) for c in what))
    total = best.join(named, question).groupBy("topic", pattern).agg(*(F.sum(c).alias(c) for c in what)).join(size, "topic")
    return total.select("topic", pattern, *((F.col(c) / F.col("n")).alias(f"mean_{c}") for c in what))


def coverage_bands(coverage: DataFrame, levels: int = 5, question: str = "question") -> DataFrame:
    """level, topic, low (< 0.33), mid (< 0.66), high: questions by their coverage, for each depth of the topic label."""
    from patternloom.functions.scalar import topic_prefix

    each = coverage.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels))))
    each = each.withColumn("prefix", topic_prefix(F.col("topic"), F.col("level")))
    c = F.col("coverage")
    return each.groupBy("level", F.col("prefix").alias("topic")).agg(F.count_if(c < 0.33).alias("low"), F.count_if((c >= 0.33) & (c < 0.66)).alias("mid"), F.count_if(c >= 0.66).alias("high"))


def suggestions(missing: DataFrame, patterns: DataFrame) -> DataFrame:
    """missing(uid, n), patterns(pattern, uid) -> pattern, score: how often its rows are missing, highest first."""
    return patterns.distinct().join(missing, "uid").groupBy("pattern").agg(F.sum("n").alias("score")).orderBy(F.desc("score"), "pattern")


def cooccurrence(members: DataFrame, words: DataFrame | None = None, group: str = "solution", uid: str = "uid") -> DataFrame:
    """a, b, n: ordered pairs of different rows of a solution; with words(uid, words) only those that share one."""
    m = members.select(group, uid).distinct()
    a, b = m.select(group, F.col(uid).alias("a")), m.select(group, F.col(uid).alias("b"))
    n = a.join(b, group).where("a <> b").groupBy("a", "b").agg(F.count("*").alias("n"))
    if words is not None:
        w = words.select(uid, "words")
        n = n.join(w.toDF("a", "wa"), "a").join(w.toDF("b", "wb"), "b").where(F.arrays_overlap("wa", "wb")).drop("wa", "wb")
    return n


def accuracy(sets: DataFrame, gold: DataFrame, question: str = "question", rows: str = "uids") -> DataFrame:
    """question, the part of the gold rows that a set holds."""
    return sets.join(gold, question).select(question, (F.size(F.array_intersect(rows, "gold")) / F.greatest(F.size("gold"), F.lit(1))).alias("accuracy"))


def distractors(candidates: DataFrame, question_words: DataFrame, n: int = 1, skip: int = 100, tries: int = 500, seed: int = 0, question: str = "question") -> DataFrame:
    """For each question the n of up to `tries` seeded-random rows ranked beyond skip that share most words with it."""
    drawn = candidates.where(F.col("rank") > skip).withColumn("_r", F.xxhash64(F.lit(seed), question, "uid"))
    drawn = drawn.withColumn("_n", F.row_number().over(Window.partitionBy(question).orderBy("_r", "uid"))).where(F.col("_n") <= tries)
    scored = drawn.join(question_words, question).withColumn("shared", F.size(F.array_intersect("words", "question_words")))
    w = Window.partitionBy(question).orderBy(F.desc("shared"), "uid")
    return scored.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).select(question, "uid", "shared")


def tfidf(words: DataFrame, doc: str = "doc", word: str = "word", binary: bool = False) -> DataFrame:
    """doc, word, weight: tf / log10(1 + df), scaled to unit length for each document. binary counts a word once."""
    tf = words.groupBy(doc, word).agg((F.lit(1) if binary else F.count("*")).alias("tf"))
    df = tf.groupBy(word).agg(F.count("*").alias("df"))
    w = tf.join(df, word).select(doc, word, (F.col("tf") / F.log10(1 + F.col("df"))).alias("w"))
    norm = w.groupBy(doc).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, doc).select(doc, word, (F.col("w") / F.col("norm")).alias("weight"))


BINS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.01]


def histogram(df: DataFrame, value: str, bins: list[float] | None = None) -> DataFrame:
    """bin, low, high, n, proportion: half-open bins; values outside count in the total alone."""
    edges = BINS if bins is None else bins
    v = F.col(value)
    which: Column = F.lit(None).cast("int")
    for k in range(len(edges) - 1):
        which = F.when((v >= edges[k]) & (v < edges[k + 1]), k).otherwise(which)
    n = df.select(which.alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    every = df.sparkSession.createDataFrame([(k, edges[k], edges[k + 1]) for k in range(len(edges) - 1)], "bin int, low double, high double")
    return every.join(n, "bin", "left").crossJoin(total).select("bin", "low", "high", F.coalesce("n", F.lit(0)).cast("long").alias("n"), (F.coalesce("n", F.lit(0)) / F.greatest("total", F.lit(1))).alias("proportion"))


def category_counts(df: DataFrame, value: str) -> DataFrame:
    return df.groupBy(value).agg(F.count("*").alias("n"))


def confusion_matrix(df: DataFrame, actual: str, predicted: str, classes: list) -> DataFrame:
    """actual, one column for each predicted class, and the part of the actual class that was predicted right (tpr)."""
    m = df.groupBy(F.col(actual).alias("actual")).pivot(predicted, classes).agg(F.count(F.lit(1)))
    cols = [F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast("long").alias(f"p_{c}") for c in classes]
    m = m.select("actual", *cols)
    right = F.lit(None).cast("long")
    for c in classes:
        right = F.when(F.col("actual") == F.lit(c), F.col(f"p_{c}")).otherwise(right)
    total = sum((F.col(f"p_{c}") for c in classes), F.lit(0))
    return m.withColumn("tpr", F.when(total > 0, right / total))


def false_positive_share(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """predicted, the part of its rows whose actual class is another."""
    return df.groupBy(F.col(predicted).alias("predicted")).agg((F.count_if(F.col(actual) != F.col(predicted)) / F.count("*")).alias("false_share"))


def coverage_histogram(overlaps: DataFrame, gold: DataFrame, question: str = "question") -> DataFrame:
    """bin, low, high, n, proportion of questions by the part of their gold rows that their best solution holds; questions
    without a solution have none of them. overlaps(question, hits), gold(question, gold)."""
    return histogram(coverage(overlaps, gold, question), "coverage")


def coverage(overlaps: DataFrame, gold: DataFrame, question: str = "question") -> DataFrame:
    """question, coverage: the best solution's hits by the number of gold rows, 0 where there is no solution."""
    best = overlaps.groupBy(question).agg(F.max("hits").alias("hits"))
    return gold.join(best, question, "left").select(question, (F.coalesce("hits", F.lit(0)) / F.greatest(F.size("gold"), F.lit(1))).alias("coverage"))


def coverage_averages(overlaps: DataFrame, gold: DataFrame, question: str = "question") -> DataFrame:
    """questions, answered (with a solution that has a gold row), mean_coverage of all and of the answered, complete."""
    c = coverage(overlaps, gold, question)
    return c.agg(F.count("*").alias("questions"), F.count_if(F.col("coverage") > 0).alias("answered"), F.avg("coverage").alias("mean_coverage"), F.avg(F.when(F.col("coverage") > 0, F.col("coverage"))).alias("mean_answered"), F.count_if(F.col("coverage") >= 1).alias("complete"))


#: The counts of gold rows for which the histogram of overlaps has a line.
OVERLAPS = range(15)


def overlap_histogram(best: dict[int, DataFrame], gold: DataFrame, question: str = "question") -> DataFrame:
    """k, overlap (0 to 14), n: the questions of which the best combination of k solutions holds so many gold rows; those without
    a solution have none. best: best_combination() by k."""
    out = None
    for k, b in best.items():
        hits = gold.select(question).join(b.select(question, "hits"), question, "left").select(F.coalesce("hits", F.lit(0)).alias("overlap"))
        lines = gold.sparkSession.range(len(OVERLAPS)).select(F.lit(k).alias("k"), F.col("id").cast("int").alias("overlap"))
        part = lines.join(hits.groupBy("overlap").agg(F.count("*").alias("n")), "overlap", "left").select("k", "overlap", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def combination_averages(best: dict[int, DataFrame], gold: DataFrame, question: str = "question") -> DataFrame:
    """k, mean_overlap (part of the gold rows) and mean_extra (rows that aren't gold) of the best combinations over all questions,
    those without one counting 0."""
    out = None
    for k, b in best.items():
        each = gold.select(question, F.size("gold").alias("g")).join(b.select(question, "hits", "extras"), question, "left")
        part = each.agg(F.avg(F.coalesce("hits", F.lit(0)) / F.greatest("g", F.lit(1))).alias("mean_overlap"), F.avg(F.coalesce("extras", F.lit(0))).alias("mean_extra"))
        part = part.select(F.lit(k).alias("k"), "mean_overlap", "mean_extra")
        out = part if out is None else out.unionByName(part)
    return out


def leftover_by_topic(best: DataFrame, gold: DataFrame, topics: DataFrame, levels: int = 5, question: str = "question") -> DataFrame:
    """level, topic, band, uid, n: the gold rows that the best combinations lack, counted for each depth of the topic label and
    band of coverage (low < 0.33, mid < 0.66, high). topics(question, topic): a question with several counts for each."""
    from patternloom.functions.scalar import topic_prefix

    each = gold.join(best.select(question, "hits", "rows"), question, "left")
    part = F.coalesce("hits", F.lit(0)) / F.greatest(F.size("gold"), F.lit(1))
    band = F.when(part < 0.33, "low").when(part < 0.66, "mid").otherwise("high")
    rest = F.array_except("gold", F.coalesce("rows", F.slice("gold", 1, 0)))
    each = each.select(question, band.alias("band"), F.explode(rest).alias("uid")).join(topics.select(question, "topic"), question)
    each = each.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels)))).withColumn("topic", topic_prefix(F.col("topic"), F.col("level")))
    return each.groupBy("level", "topic", "band", "uid").agg(F.count("*").alias("n"))


def leftover_rows(solutions: DataFrame, gold: DataFrame, question: str = "question", rows: str = "uids") -> DataFrame:
    """uid, n: gold rows that no solution of their question holds, and for how many questions."""
    held = solutions.select(question, F.explode(rows).alias("uid")).distinct()
    return gold.select(question, F.explode("gold").alias("uid")).join(held, [question, "uid"], "left_anti").groupBy("uid").agg(F.count("*").alias("n"))


def pattern_statistics(matches: dict[str, DataFrame]) -> DataFrame:
    """pattern, solutions, slots, variables, and of the solutions' rows those with and without a variable bound: one job."""
    out = None
    for name, m in matches.items():
        slots, vs = [c for c in m.columns if c.startswith("uid_")], [c for c in m.columns if c.startswith("v_")]
        bound = sum(((F.col(f"`{c}`").isNotNull() & (F.size(f"`{c}`") > 0)).cast("int") for c in vs), F.lit(0))
        part = m.agg(F.count("*").alias("solutions"), F.count_if(bound > 0).alias("with_variables"), F.coalesce(F.avg(bound.cast("double")), F.lit(0.0)).alias("mean_bound"))
        part = part.select(F.lit(name).alias("pattern"), "solutions", F.lit(len(slots)).alias("slots"), F.lit(len(vs)).alias("variables"), "with_variables", (F.col("solutions") - F.col("with_variables")).alias("without_variables"), "mean_bound")
        out = part if out is None else out.unionByName(part)
    return out


def populated_variables(matches: DataFrame) -> DataFrame:
    """variables bound, solutions with so many."""
    vs = [c for c in matches.columns if c.startswith("v_")]
    bound = sum(((F.col(c).isNotNull() & (F.size(c) > 0)).cast("int") for c in vs), F.lit(0))
    return matches.groupBy(bound.alias("bound")).agg(F.count("*").alias("n"))


def leaked(train: DataFrame, held_out: DataFrame, id: str = "id") -> DataFrame:
    """Ids in both sets, apart from the suffix that numbers permutations."""
    base = lambda df: df.select(F.split(F.col(id), "_ENUM")[0].alias("id"))
    return base(train).intersect(base(held_out))


