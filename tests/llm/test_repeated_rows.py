"""Rows that agree in everything, and labels of documents that aren't there."""

from collections import Counter

from patternloom.llm import op01_decontamination as op1
from patternloom.llm import op04_toxicity as op4
from patternloom.llm import op06_licenses as op6
from patternloom.llm import op09_sharding as op9


def loads(spark, rows):
    got = op9.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    assert len(got) == len(rows)
    size, places = Counter(), {}
    for r in got:
        size[r.shard] += r.size
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in places.values())
    return [size[k] for k in range(16)]


def test_repeated_rows_are_dealt_over_all_shards(spark):
    others = [(10 + k, f"text {k} " + "w " * 10) for k in range(498)]
    for id in (1, None):
        size = loads(spark, [(id, "copied " * 40)] * 2_000 + others)
        assert max(size) < 1.2 * min(size), size


def test_rows_without_text_are_dealt_too(spark):
    size = loads(spark, [(None, None)] * 3_000 + [(1, "")] * 3_000)
    assert max(size) < 1.5 * min(size), size


def test_labels_of_other_documents_take_no_places_in_the_sample(spark):
    docs = spark.createDataFrame([(k, ("rotten filthy stupid hate " if k % 2 else "gentle kind river stone ") * 8 + f"w{k % 7}") for k in range(400)], "doc_id long, text string")
    labels = spark.range(60_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    got = op4.score(docs, op4.fit(docs, labels, sample=100)).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got)


def test_equal_words_are_matched_without_their_product(monkeypatch):
    """Documents and items of one word repeated, and a passage that many items share, in bounded memory."""
    import tracemalloc

    def scanned(items, texts):
        s = op1.Suffixes(items, 13)
        tracemalloc.start()
        out = op1.scan(s, texts, None)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return out, peak

    out, peak = scanned([("a", b"w " * 5_000)], [b"w " * 20_000])
    assert out["__spans"] == [[0, 20_000]] and out["__longest"] == [{"length": 5_000, "item_id": "a", "item_start": 0, "doc_start": 0}]
    assert peak < 100 << 20
    shared = b"one two three four five six seven eight nine ten eleven twelve thirteen fourteen "
    items = [(f"i{k:04}", b"x%d " % k + shared + b"y%d" % k) for k in range(2_000)]
    text = b"".join(b"z%d " % (k % 7) + shared for k in range(2_000)) + items[1234][1]
    plain, peak = scanned(items, [text])
    assert plain["__longest"] == [{"length": 16, "item_id": "i1234", "item_start": 0, "doc_start": 30_000}] and len(plain["__items"][0]) == 2_000
    assert peak < 200 << 20
    monkeypatch.setattr(op1, "PAIRS", 7)
    few = [(n, t) for n, t in items[:20]]
    small = b"".join(b"z%d " % (k % 7) + shared for k in range(20)) + few[12][1]
    assert scanned(few, [small, b"", small])[0]["__longest"] == [{"length": 16, "item_id": "i0012", "item_start": 0, "doc_start": 300}, None, {"length": 16, "item_id": "i0012", "item_start": 0, "doc_start": 300}]


def test_licences_are_told_by_aligned_words(spark):
    """Identifiers, denied mentions, and a notice that names every licence."""
    texts = {
        1: "This is not under the MIT license.", 2: "SPDX-License-Identifier: GPL-3.0-only", 3: "SPDX: Apache-2.0", 4: "Apache-2.0 license", 5: "Creative Commons Attribution-NonCommercial 4.0",
        6: "released under the MIT license, not the Apache License, Version 2.0", 7: " filler ".join(f"{t} x" for _, t, _ in op6.ALL), 8: "license mit spdx attribution creative identifier", 9: "the " * 5_000 + "MIT License " * 3_000,
    }
    got = {r.doc_id: (r["__labels"], r["__score"]) for r in op6.scan(spark.createDataFrame([*texts.items()], "doc_id long, text string")).collect()}
    assert [got[k][0] for k in (1, 2, 3, 4, 5, 6, 8)] == ["", "gpl,spdx", "apache-2.0", "apache-2.0", "cc-by-nc", "mit", ""]
    assert set(got[7][0].split(",")) >= {label for label, _, _ in op6.ALL} and got[7][1] == 1.0
    assert got[9][0] == "mit" and 0.3 < got[9][1] < 0.7
    assert all(got[k][0] == op6.brute(t)[3] for k, t in texts.items())
