"""The queries' columns and types, null ids, and that nothing else imports this subpackage."""

import os
import re
from pathlib import Path

import pytest

from patternloom.llm.registry import ORACLE_SQL, QUERIES

ROOT = Path(__file__).resolve().parents[2]
COLUMNS = {
    "op1": "doc_id bigint, n_words bigint, n_hit bigint, n_items bigint, items_sha256 string, contaminated boolean",
    "op2": "doc_id bigint, n_shingles bigint, component_id bigint",
    "op3": "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint",
    "op4": "doc_id bigint, held_out boolean, score double, predicted int",
    "op5": "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string",
    "op6": "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double",
    "op7": "vec_id bigint, n_links bigint, component_id bigint, kept boolean",
    "op8": "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    "op9": "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
    "op10": "page_id bigint, host string, path string, rule string, verdict string",
    "op11": "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint",
    "op12": "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string",
    "op13": "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean",
}
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long", "embeddings": "vec_id long, embedding array<float>, label int", "pages": "page_id long, url string, html string",
    "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int",
    "conversations": "conv_id long, turn long, role string, text string",
}
ROWS = {
    "documents": [(None, None, None, None, None), (1, "some words", None, None, None), (1, "some words", "en", "s", 10), (2, "", "en", "s", 0)],
    "embeddings": [(None, None, None), (1, [1.0, 0.0], 1), (1, [1.0, 0.0], 1)], "pages": [(None, None, None), (1, "http://a.com/en/", "")],
    "benchmark": [(None, None), (1, "some words")], "labels": [(None, None, None), (1, 0, None), (2, 1, 1)],
    "conversations": [(None, None, None, None), (1, 0, "user", "a."), (1, 0, "user", "a."), (2, None, None, "")],
}
#: Rows of the result on the second kind of table, where they aren't those of the documents.
COUNTS = {"op7": len(ROWS["embeddings"]), "op10": len(ROWS["pages"]), "op11": 1_200, "op12": 3}


@pytest.fixture(scope="module", params=["empty", "nulls"])
def folder(request, spark, tmp_path_factory):
    d = tmp_path_factory.mktemp(request.param)
    for name, schema in SCHEMAS.items():
        spark.createDataFrame(ROWS[name] if request.param == "nulls" else [], schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")
    return request.param, str(d)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_columns_and_small_tables(spark, folder, name):
    kind, d = folder
    got = QUERIES[name](spark, d)
    types = dict(got.dtypes)
    for column in COLUMNS[name.split("_")[0]].split(", "):
        c, t = column.split(" ")
        assert types[c] == t, (name, c)
    assert got.count() == (COUNTS.get(name.split("_")[0], len(ROWS["documents"])) if kind == "nulls" else 0)


def test_nothing_else_imports_it():
    for f in [*ROOT.glob("patternloom/**/*.py"), *ROOT.glob("tests/*.py"), ROOT / "bench.py"]:
        if "llm" not in f.parts:
            assert not re.search(r"^\s*(from|import) .*\bllm\b", f.read_text(), re.MULTILINE), f


def test_registry():
    assert set(ORACLE_SQL) <= set(QUERIES) and len(QUERIES) == 13
    assert all(os.path.basename(q.__module__.replace(".", "/")).startswith("op") for q in QUERIES.values())
