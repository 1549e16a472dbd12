"""Readers of rankings, questions, ratings, word norms, categories, lemmas, properties; splitting and chunking."""

from __future__ import annotations

from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternloom.checkpoints import checkpoint
from patternloom.functions.annotate import lemma
from patternloom.functions.scalar import answer_index, explanation, stem_and_choices, tokens

#: Steps from word to lemma that are followed at most.
ROUNDS = 10
RANKING_FORMATS = ("probabilities", "listed", "headerless", "cosine")


def rankings(spark: SparkSession, path: str, kind: str, question: str | None = None) -> DataFrame:
    """(question, uid, score) from one of RANKING_FORMATS.

    probabilities: uuid, rowText, isGoldRow, score_0, score_1 (the score). listed: QuestionID, ExplanationID, Score, IsGold.
    headerless: uid first, score fourth. cosine: UUID and COS_AC_CORRECT by name. All but `listed` hold one question, whose id
    is given or else the file's name up to the first dot.
    """
    tsv = spark.read.option("sep", "\t").option("quote", "")
    stem = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^/]*)?$", 1) if question is None else F.lit(question)
    if kind == "probabilities":
        out = tsv.option("header", True).csv(path).select(stem.alias("question"), F.col("uuid").alias("uid"), F.col("score_1").try_cast("double").alias("score"))
    elif kind == "listed":
        out = tsv.option("header", True).csv(path).select(F.col("QuestionID").alias("question"), F.col("ExplanationID").alias("uid"), F.col("Score").try_cast("double").alias("score"))
        out = out.where(F.col("question") == question) if question is not None else out
    elif kind == "headerless":
        out = tsv.csv(path).select(stem.alias("question"), F.col("_c0").alias("uid"), F.col("_c3").try_cast("double").alias("score"))
    elif kind == "cosine":
        out = tsv.option("header", True).csv(path).select(stem.alias("question"), F.col("UUID").alias("uid"), F.col("COS_AC_CORRECT").try_cast("double").alias("score"))
    else:
        raise ValueError(f"kind must be one of {RANKING_FORMATS}")
    return out.where("uid is not null")


def ranking_path(folder: str, question: str) -> str | None:
    """The file of a question's ranking, or that of its first permutation, or None."""
    return next((str(p) for p in (Path(folder) / f"{question}.tsv", Path(folder) / f"{question}_ENUM0.tsv") if p.is_file()), None)


def split_rankings(scores: DataFrame, path: str) -> None:
    """One folder for each question."""
    scores.repartition("question").write.mode("overwrite").partitionBy("question").option("sep", "\t").option("header", True).csv(path)


def label_probabilities(spark: SparkSession, path: str) -> DataFrame:
    """(question, uid, row_text, score, logit, gold) from lines of JSON: id, context, label, label_logits, label_probs.

    The id is the question's, a hyphen and the choice, two underscores and the row's uid; score and logit are the second
    label's, gold is label 1. The text stands after three characters of the context. Lines that are no such object are left
    out.
    """
    schema = "id string, context string, label double, label_logits array<double>, label_probs array<double>"
    rows = spark.read.text(path).select(F.from_json("value", schema).alias("j")).where("j.id is not null").select("j.*")
    head = F.regexp_replace("id", r"(?s)__(?!.*__).*$", "")
    return rows.select(
        F.regexp_replace(head, r"(?s)-[^-]*$", "").alias("question"), F.regexp_extract("id", r"(?s)__((?!.*__).*)$", 1).alias("uid"), F.substring(F.col("context"), F.lit(4), F.length("context")).alias("row_text"),
        F.try_element_at("label_probs", F.lit(2)).alias("score"), F.try_element_at("label_logits", F.lit(2)).alias("logit"), (F.col("label") == 1).alias("gold"),
    )


def questions(spark: SparkSession, path: str, sep: str = "\t") -> DataFrame:
    """Questions by their header: id, stem, choices, answer (0-based, else -1), grade, topic, flags, fold, explanation.

    The header's columns may stand in any order and be written in any case; those that the file lacks are empty. topics are
    the topic's parts between commas, in upper case. Questions of fewer than two characters are left out, and so are, where
    the file tells, those with a diagram and those without choices.
    """
    df = spark.read.option("sep", sep).option("header", True).csv(path)
    have = {c.strip().lower(): c for c in df.columns}
    col = lambda *names: next((F.col(f"`{have[n.lower()]}`") for n in names if n.lower() in have), F.lit(None).cast("string"))
    text = F.trim(F.coalesce(col("question"), F.lit("")))
    parts = stem_and_choices(F.regexp_replace(text, '(?s)^"(.*)"$', "$1"))
    kept = (F.length(text) >= 2) & (F.coalesce(F.trim(col("isMultipleChoiceQuestion")), F.lit("1")) == "1") & (F.coalesce(F.trim(col("includesDiagram")), F.lit("0")) != "1")
    topic = col("topic", "consensus")
    return df.where(kept).select(
        col("questionID").alias("question"), col("originalQuestionID").alias("original"), F.element_at(parts, 1).alias("stem"), F.slice(parts, F.lit(2), F.size(parts)).alias("choices"),
        answer_index(F.coalesce(col("answerKey"), F.lit(""))).alias("answer"), col("schoolGrade", "grade").alias("grade"), col("examName").alias("exam"), topic.alias("topic"), topics(topic).alias("topics"),
        col("flags").alias("flags"), col("fold").alias("fold"), explanation(col("explanation")).alias("explanation"),
    )


def topics(topic: Column) -> Column:
    return F.transform(F.split(F.upper(F.coalesce(topic, F.lit(""))), ","), lambda x: F.trim(x))


def questions_fixed(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Questions of the older layout, whose first line names no columns that count: fields go by their places.

    id, original id, points, answer, multiple choice, diagram, exam, grade, year, then of 14 fields and more the question's
    type, of 15 and more its topics and explanation too; the question follows. Choices go by A to D, in either case, or 1 to 4.
    """
    df = spark.read.option("sep", sep).option("header", True).option("quote", '"').option("escape", '"').csv(path)
    n = len(df.columns)
    df = df.toDF(*(f"f{i}" for i in range(n)))
    at = lambda i: F.trim(F.coalesce(F.col(f"f{i}"), F.lit("")))
    text = at(10 + (n >= 14) + (n >= 15))
    parts = F.transform(F.split(F.regexp_replace(text, '(?s)^"(.*)"$', "$1"), r"\(([A-Da-d]|[1-4])\)"), lambda x: F.trim(x))
    kept = (at(4) == "1") & (at(5) != "1") & (F.length(text) >= 2)
    answer = F.when(at(3).rlike("^[A-D1-4]$"), answer_index(at(3))).otherwise(-1)
    return df.where(kept).select(
        at(0).alias("question"), at(1).alias("original"), F.element_at(parts, 1).alias("stem"), F.slice(parts, F.lit(2), F.size(parts)).alias("choices"), answer.alias("answer"), at(7).alias("grade"), at(6).alias("exam"),
        (F.regexp_replace(at(9), "(?<=.)[?]$", "") if n >= 14 else F.lit("")).alias("kind"), (topics(at(10)) if n >= 15 else F.array().cast("array<string>")).alias("topics"), (at(11) if n >= 15 else F.lit("")).alias("explanation"),
    )


def ratings(spark: SparkSession, path: str) -> DataFrame:
    """(question, uid, rating) from sheets of blocks: a line with a question id alone opens a block of uid, rating lines."""
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    f = F.split("line", "\t")
    uid = F.regexp_extract("line", r"\b([0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4})\b", 1)
    head = F.when((uid == "") & (F.trim(f[0]) != ""), F.trim(f[0]))
    # a sheet is one file of bounded length; its order is that of its lines
    q = F.last(head, ignorenulls=True).over(Window.partitionBy("file").orderBy("n"))
    rating = F.try_element_at(F.filter(F.transform(f, lambda x: F.trim(x).try_cast("int")), lambda x: x.isNotNull()), F.lit(1))
    return lines.select(q.alias("question"), uid.alias("uid"), rating.alias("rating")).where("uid <> '' and rating is not null")


def word_norms(spark: SparkSession, path: str) -> DataFrame:
    """(word, valence, arousal, dominance), each from 1..9 to 0..1, -1 where it is missing."""
    df = spark.read.option("header", True).csv(path)
    have = {c.lower(): c for c in df.columns}
    scale = lambda *names: F.coalesce((next((F.col(f"`{have[n]}`") for n in names if n in have), F.lit(None).cast("string")).try_cast("double") - 1) / 8, F.lit(-1.0))
    return df.select(F.lower(F.col(f"`{have['word']}`")).alias("word"), scale("v.mean.sum", "valence").alias("valence"), scale("a.mean.sum", "arousal").alias("arousal"), scale("d.mean.sum", "dominance").alias("dominance"))


def with_category(rows: DataFrame, categories: DataFrame, name: str = "table") -> DataFrame:
    """rows with their table's category, UNKNOWN where there is none. categories(name, category) is a list of tables."""
    return rows.join(categories.withColumnRenamed("name", name), name, "left").withColumn("category", F.coalesce("category", F.lit("UNKNOWN")))


def categories(spark: SparkSession, path: str) -> DataFrame:
    """(name, category) from lines of table name, category; blank lines and those that begin with # are left out."""
    f = F.split("value", "\t")
    rows = spark.read.text(path).where((F.trim("value") != "") & ~F.trim("value").startswith("#"))
    return rows.select(F.trim(f[0]).alias("name"), F.coalesce(F.trim(F.try_element_at(f, F.lit(2))), F.lit("UNKNOWN")).alias("category"))


def split_questions(df: DataFrame, path: str, n: int, id: str = "question") -> None:
    """Write questions in files of n, in the order of their ids: a folder for each part."""
    numbered = df.withColumn("part", F.floor((F.row_number().over(Window.orderBy(id)) - 1) / n))  # a question file is small
    numbered.write.mode("overwrite").partitionBy("part").json(path)


def lemma_dictionary(spark: SparkSession, path: str, words: DataFrame | None = None, limit: int = 200_000) -> F.Column | None:
    """A map column word -> lemma from lines of lemma, word, of which a word's last counts; None where nothing is left.

    With words(word), lower case, only the entries of these words, and of what lemmas they lead to, become part of the map, so
    a file may be of any length; more than limit entries are an error.
    """
    f = F.split("value", "\t")
    pairs = spark.read.text(path).where(F.size(f) >= 2).select(F.monotonically_increasing_id().alias("n"), F.lower(F.trim(f[1])).alias("word"), F.trim(f[0]).alias("lemma"))
    if words is not None:
        known, size = words.select("word").distinct(), -1
        for _ in range(ROUNDS):  # rows that rules generate hold lemmas, which are words again
            known = checkpoint(known)
            if known.count() == size:
                break
            size = known.count()
            told = pairs.join(known, "word", "left_semi").select(F.explode(tokens(F.lower("lemma"))).alias("word"))
            known = known.unionByName(told).unionByName(known.select(lemma(F.col("word")).alias("word"))).distinct()
        else:
            raise ValueError(f"{path}: lemmas lead on to other words for more than {ROUNDS} steps")
        pairs = pairs.join(known, "word", "left_semi")
    rows = pairs.groupBy("word").agg(F.max_by("lemma", "n").alias("lemma")).limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{path}: a lemma dictionary of more than {limit} entries is not supported")
    entries = {r.word: r.lemma for r in sorted(rows)}
    return F.map_from_arrays(F.lit(list(entries)), F.lit(list(entries.values()))) if entries else None


@dataclass
class Config:
    """The properties of an enumeration run."""

    store_index: str = ""
    input_path: str = ""
    output_path: str = ""
    max_matches: int = 25_000
    threads: int = 4
    export_html: bool = False
    export_store_html: bool = False
    whole_rows: bool = False


def properties(path: str) -> Config:
    """key = value lines; # and ! begin comments."""
    got = {}
    for line in Path(path).read_text(encoding="utf-8").splitlines():
        line = line.strip()
        if line and line[0] not in "#!" and "=" in line:
            k, v = line.split("=", 1)
            got[k.strip().lower()] = v.strip()
    flag = lambda k: got.get(k, "").lower() == "true"
    return Config(got.get("tablestoreindex", ""), got.get("imlinputpath", ""), got.get("imloutputpath", ""), int(got.get("maxmatches", 25_000)), int(got.get("numthreads", 4)), flag("exportinfpathtml"), flag("exporttablestorehtml"), flag("annotatewholerows"))


def chunk_patterns(text: str, n: int) -> list[str]:
    """A pattern file cut at blank lines into chunks of n patterns; the last may have fewer."""
    parts = [p.strip("\n") for p in text.replace("\r\n", "\n").split("\n\n") if p.strip()]
    return ["\n\n".join(parts[i : i + n]) for i in range(0, len(parts), n)]
