"""What operators leave on disk while they run."""

import random
import time
from pathlib import Path

from pyspark.sql import functions as F

from patternloom.llm import common
from patternloom.llm import op02_jaccard_join as op2


def shuffle_files(spark):
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {p for d in dirs for p in Path(str(d)).rglob("shuffle_*")}


def left_over(spark, before):
    for _ in range(40):  # they go in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.25)
    return left


def test_saved_tables_leave_no_shuffle_files(spark):
    before = shuffle_files(spark)
    saved = common.save(spark.range(10_000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    assert not left_over(spark, before)
    assert saved.count() == 7


def test_keys_of_near_duplicates_are_not_written_to_the_shared_folder(spark, monkeypatch):
    rng = random.Random(11)
    rows = [(i, " ".join(f"w{rng.randrange(10_000)}" for _ in range(400))) for i in range(100)]
    sizes = {}

    def save(df, tag):
        out = common.save(df, tag)
        sizes.setdefault(tag, sum(p.stat().st_size for p in Path(out._saved_at.removeprefix("file://")).rglob("*.parquet")))
        return out

    monkeypatch.setattr(op2, "save", save)
    docs = spark.createDataFrame([*rows, (100, rows[0][1] + " more")], "doc_id long, text string")
    kept = op2.keep_one(docs)
    assert sorted(r.doc_id for r in kept.collect()) == list(range(100))
    assert sizes["jaccard"] < 0.12 * sum(len(t) for _, t in rows)


def test_packed_keys():
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(12)
    key, cls = rng.integers(-(1 << 63), 1 << 63, 200_000), rng.integers(-(1 << 63), 1 << 63, 200_000)
    key[:5], cls[:5] = key[0], cls[0]
    batch = pa.RecordBatch.from_pydict({"key": pa.array(key), "cls": pa.array(cls), "hub": pa.nulls(len(key), pa.int64())})
    got = pa.Table.from_batches(op2.packed([batch]))
    values = dict(zip(got["bucket"].to_pylist(), got["keys"].to_pylist(), strict=True))
    assert len(values) == got.num_rows and sum(map(len, values.values())) < 14 * len(key)
    back = [(b, *r) for b, value in values.items() for r in op2.unpacked(value).tolist()]
    want = zip((key.view(np.uint64) >> np.uint64(64 - op2.BUCKET)).tolist(), (key & ((1 << op2.REST) - 1)).tolist(), cls.tolist(), strict=True)
    assert sorted(back) == sorted(want)
