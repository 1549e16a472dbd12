"""Filter interaction audit: a table of first failures by order tells what each of five filters removes in every order."""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.common import binaries, forget, map_chunks, prepare, read, save, tidy

FILTERS = "ABCDE"
#: Thresholds: fewest words, fewest distinct words in 100, most capital letters in 100 code points.
WORDS, DISTINCT, CAPITALS = 50, 65, 5
MARKS = b"#$%&*|"
UPPER = bytes(range(65, 91))
#: Bytes of UTF-8 that begin no code point.
INNER = bytes(range(128, 192))

ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
N, M = len(FILTERS), len(ORDERS)
#: RANK[order, filter]: the place of the filter in the order. SHAPE: orders, steps.
RANK = np.array([[o.index(f) for f in FILTERS] for o in ORDERS])
SHAPE = (M, N)
#: FIRST[mask, order]: the place of the first filter that a document fails, N where it fails none. 32 rows of 120.
FAILS = (np.arange(1 << N)[:, None] >> np.arange(N)) & 1
FIRST = np.where(FAILS[:, None, :] == 1, RANK[None], N).min(axis=2)
#: A document's group within its part: its mask, whether it is good, whether it is toxic.
GROUPS = 4 << N
#: Cells of a part: removals of all, of good and of toxic ones by order and step; all documents; failures and sole failures by filter.
CELLS = 3 * M * N + 1 + 2 * N
#: Parts that a task holds at once.
PARTS = 500


def own_mask(text: bytes) -> int:
    """The bits of the filters A to D that a text fails."""
    words = text.split()
    points = len(text.translate(None, INNER))
    upper = len(text) - len(text.translate(None, UPPER))
    marks = len(text.translate(None, MARKS)) < len(text)
    return (len(words) < WORDS) | (100 * len(set(words)) < DISTINCT * len(words)) << 1 | (100 * upper > CAPITALS * points) << 2 | marks << 3


def digests(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """id, part, mask (A to D), h (128 bits of BLAKE2 of the text): what the audit needs of each row."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), F.col(f"`{text}`").alias("t"))

    def step(t: pa.Table, texts: list[bytes]) -> pa.Table:
        h = binaries([hashlib.blake2b(x, digest_size=16).digest() for x in texts])
        return pa.table({"id": t["id"], "part": t["part"], "mask": pa.array([own_mask(x) for x in texts], pa.int32()), "h": h})

    kind = rows.schema["id"].dataType.simpleString()
    return map_chunks(rows, "t", step, f"id {kind}, part string, mask int, h binary")


def marked(rows: DataFrame, labels: DataFrame, id: str) -> DataFrame:
    """part, code (mask with E, good, toxic) of each row of digests.

    Only texts that occur under two ids, and labels that say 1, are joined: both joins have the rows on their left, so that a
    copied text's or an id's rows can be split over tasks.
    """
    copied = rows.groupBy("h").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi").select("h", "lo")
    one = lambda c: F.coalesce(F.max((F.col(c) == 1).cast("int")), F.lit(0))
    told = labels.where(F.col(f"`{id}`").isNotNull()).groupBy(F.col(f"`{id}`").alias("id")).agg(one("quality").alias("good"), one("toxic").alias("toxic")).where("good + toxic > 0")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    last = F.coalesce((F.col("id") > F.col("lo")).cast("int"), F.lit(0))
    known = rows.where("id is not null").join(copied, "h", "left").join(told, "id", "left")
    mask = F.col("mask") + last * (1 << N - 1)
    return known.select("part", (mask * 4 + zero("good") * 2 + zero("toxic")).alias("code")).unionByName(rows.where("id is null").select("part", (F.col("mask") * 4).alias("code")))


def cells_of(counts: np.ndarray) -> np.ndarray:
    """A part's cells from the documents in each of its groups: every group's removals are looked up by its mask."""
    n = counts.reshape(1 << N, 2, 2)
    at = FIRST + (N + 1) * np.arange(M)  # the cell of each mask and order, with a last step for what is kept
    removed = [np.bincount(at.ravel(), np.repeat(w, M), M * (N + 1)).reshape(M, N + 1)[:, :N] for w in (n.sum(axis=(1, 2)), n[:, 1, :].sum(axis=1), n[:, :, 1].sum(axis=1))]
    every = n.sum(axis=(1, 2))
    return np.concatenate([*(r.ravel() for r in removed), [every.sum()], every @ FAILS, every[1 << np.arange(N)]]).astype(np.int64)


def partial(rows: DataFrame) -> DataFrame:
    """part, cells: the cells of each part over a task's rows, as an array."""

    def run(batches):
        number: dict[str, int] = {}
        total = np.zeros((16, GROUPS), np.int64)

        def out():
            used = [(p, k) for p, k in number.items()]
            yield pa.RecordBatch.from_pydict({"part": pa.array([p for p, _ in used], pa.string()), "cells": pa.array([cells_of(total[k]) for _, k in used], pa.list_(pa.int64()))})

        for b in batches:
            parts = b.column("part").dictionary_encode()
            names = parts.dictionary.to_pylist()
            if len(number) + len(names) > PARTS:
                yield from out()
                number.clear()
                total[:] = 0
            of = np.array([number.setdefault(p, len(number)) for p in names], np.int64)
            if len(number) > len(total):
                total = np.concatenate([total, np.zeros((len(number), GROUPS), np.int64)])
            at = of[parts.indices.to_numpy(zero_copy_only=False)] * GROUPS + b.column("code").to_numpy(zero_copy_only=False)
            total += np.bincount(at, minlength=total.size).reshape(total.shape)
        if number:
            yield from out()
        tidy()

    return rows.mapInArrow(run, "part string, cells array<long>")


def report(sums: DataFrame) -> DataFrame:
    """A row for each part, order and step, from a part's summed cells."""
    names = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    which = np.array([[FILTERS.index(f) for f in o] for o in ORDERS])

    def run(batches):
        for b in batches:
            for part, cells in zip(b.column("part").to_pylist(), b.column("cells").to_pylist(), strict=True):
                c = np.array(cells, np.int64)
                removed, good, toxic = c[: 3 * M * N].reshape(3, *SHAPE)
                docs, fails, alone = c[3 * M * N], c[-2 * N : -N], c[-N:]
                of_filter = np.array([removed[which == f].sum() for f in range(N)])
                columns = (docs - removed.cumsum(axis=1), removed, fails[which] - removed, alone[which], good, toxic, of_filter[which])
                table = {"part": [part] * (M * N), "filter_order": np.repeat(ORDERS, N).tolist(), "step": pa.array(np.tile(np.arange(1, N + 1), M), pa.int32())}
                yield pa.RecordBatch.from_pydict(table | {k: pa.array(v.ravel(), pa.int64()) for k, v in zip(names, columns, strict=True)})

    return sums.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{k} long" for k in names))


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """What each of the filters A to E removes at each step of each of their 120 orders, for each value of `part`: 600 rows a part.

    A null text is an empty one (which fails A alone, and E where another such text has a smaller id); a null part counts as
    the empty string. A row without id has no smaller or larger one: it neither fails E nor makes others fail, and has no labels.
    Repeated rows count each; of equal texts all rows with the smallest id pass E. Labels that name an id more often count as 1
    if one of them does. An empty table has no parts and no rows.

    Texts are read once and never shuffled: their masks and hashes go on, the hashes to find equal texts (as equal counts what
    agrees in 128 bits), and each task adds up its rows by part before the parts' arrays are summed, cell by cell.
    """
    prepare(docs.sparkSession)
    rows = save(digests(docs, id, text, part), "audit-digests")
    cells = partial(marked(rows, labels, id)).select("part", F.posexplode("cells").alias("k", "n"))
    sums = cells.groupBy("part", "k").agg(F.sum("n").alias("n")).groupBy("part").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("c"))  # CELLS entries for a part
    held = save(sums.select("part", F.transform("c", lambda x: x["n"]).alias("cells")), "audit-cells")
    forget(rows)
    return report(held)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(read(spark, sf_dir, "documents").select("doc_id", "text", "source"), read(spark, sf_dir, "labels"))
