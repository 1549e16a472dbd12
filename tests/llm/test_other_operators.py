"""Operators on vectors, rows and pages, the components, the registry and the pipeline."""

import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternloom.llm import components as stars
from patternloom.llm import op07_embeddings as op7
from patternloom.llm import op09_sharding as op9
from patternloom.llm import op10_urls as op10
from patternloom.llm.components import components

DATA = "/root/testdata/sf0.001"


def union_find(edges):
    root = {}

    def top(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    return {x: top(x) for x in root}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 3000 + i) for i in range(50)] + [(7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame([*edges, (None, 5)], "u long, v long")).collect()}
    assert got == union_find([e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    rows, i = [], 0
    for _ in range(40):
        base = rng.normal(size=16)
        for _ in range(6):
            v = base + rng.normal(size=16) * rng.choice([0.02, 0.12, 0.2])
            rows.append((i, [float(x) for x in v * rng.uniform(0.1, 9)], int(i % 2)))
            i += 1
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, rows[0][1], None), (903, None, 0), (904, [0.0] * 16, 0), (905, [0.0] * 16, 0), (906, [float("nan")] * 16, 0), (907, [None] + [1.0] * 15, 0), (908, [1.0, 2.0], 0), (909, [1.0, 2.0], 0), (910, [], 0), (None, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumns({"id": F.lit("x"), "grp": F.lit(1), "key": F.lit(2), "n_links": F.lit(0)})
    ok = [r for r in rows if r[1] and r[2] is not None and None not in r[1] and np.isfinite(r[1]).all() and any(r[1])]
    links, n = [], Counter()
    for a in range(len(ok)):
        for b in range(a):
            x, y = np.array(ok[a][1]), np.array(ok[b][1])
            if ok[a][2] == ok[b][2] and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.98:
                links.append((ok[a], ok[b]))
                n[id(ok[a])] += 1
                n[id(ok[b])] += 1
    got = {r.vec_id: r for r in op7.near_duplicates(df).collect()}
    assert len(got) == len(rows)
    found, want = sum(r.n_links for r in got.values()), sum(n.values())
    assert want > 100 and 0.95 * want <= found <= want
    exact = {r[0]: n[id(r)] for r in ok}
    assert all(got[k].n_links <= v for k, v in exact.items())
    comp = union_find([(a[0], b[0]) for a, b in links if a[0] is not None and b[0] is not None])
    same = [got[k].component_id == v for k, v in comp.items()]
    assert sum(same) >= 0.95 * len(same)
    assert got[900].n_links >= 2 and not got[901].kept
    assert all(got[k].n_links == 0 and got[k].component_id == k and got[k].kept for k in (902, 903, 904, 905, 906, 907, 910))
    assert got[908].n_links == 1 and got[909].component_id == 908


def test_calibration_keeps_pairs_at_the_threshold():
    first, width, least = op7.calibrate(64, 0.98)
    rng = np.random.default_rng(9)
    d = rng.normal(size=(5000, 64))
    d = np.abs(d * np.sqrt(0.04) / np.linalg.norm(d, axis=1, keepdims=True))[:, : op7.PROJECTIONS]
    kept = (d[:, 0] <= first) & ((d[:, 1:] <= width).sum(axis=1) >= least)
    assert kept.mean() > 0.98


def test_sharding(spark):
    rng = random.Random(4)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(3000)] + [(i, "the same text " * 5) for i in range(3000, 3200)] + [(5, None), (None, None), (6, "é"), (6, "é"), (6, "é")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"shard": F.lit("a"), "size": F.lit(0), "slot": F.lit(1)})
    got = op9.shard(df).collect()
    key = lambda i, t: (str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode()))
    assert Counter((str(r.doc_id), r.size, r.text_crc32) for r in got) == Counter(key(*r) for r in rows)
    for s in range(16):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    mean = sum(load.values()) / 16
    assert max(load.values()) < 1.05 * mean and min(load.values()) > 0.95 * mean
    assert len({r.shard for r in got if r.text_crc32 == zlib.crc32(b"the same text " * 5)}) == 1
    assert op9.shard(df.limit(0)).count() == 0


def test_one_text_fills_the_table(spark):
    df = spark.createDataFrame([(i, "hot " * 20) for i in range(1500)] + [(i, f"text {i}") for i in range(1500, 2500)], "doc_id long, text string")
    load = Counter()
    for r in op9.shard(df).collect():
        load[r.shard] += r.size
    assert max(load.values()) < 1.2 * sum(load.values()) / 16


def test_rebalancing_edits_few_slots():
    rng = random.Random(2)
    sizes = [(s, rng.randint(50, 150)) for s in range(512)]
    first = op9.assign(sizes, 8, 512)
    grown = op9.rebalance(first, sizes, 9)
    moved = [s for s in range(512) if first[s] != grown[s]]
    assert 0 < len(moved) < 512 / 6 and {grown[s] for s in moved} == {8}
    load = Counter()
    for s, n in sizes:
        load[grown[s]] += n
    assert max(load.values()) < 1.06 * sum(load.values()) / 9
    shrunk = op9.rebalance(first, sizes, 7)
    assert max(shrunk) == 6 and all(a == b for a, b in zip(first, shrunk, strict=True) if a < 7 and a == b)


PAGES = [
    (1, "http://a.com/en/x", ""), (2, "https://Example.COM/en/7?a=/b", None), (3, "http://example.com/en/8", ""), (4, "http://x.example.net/de/8#f", ""), (5, "http://notcom/en/", ""),
    (6, "ftp://net", ""), (7, None, None), (8, "no scheme", ""), (9, "http://free.test/a", '<link rel="canonical" href="http://b.org/es/1">'), (10, "http://free.test/b", "<LINK href='http://free.test/a' REL='canonical'>"),
    (11, "http://free.test/c", '<meta http-equiv="refresh" content="0; url=http://example.com/en/7x">'), (12, "http://free.test/d", '<link rel="canonical" href="http://free.test/c"><link rel=canonical href=http://b.com/en/q>'),
    (13, "http://free.test/e", '<link rel="canonical" href="/relative">'), (14, "http://a.com?x/en/", ""), (15, "http://a.com/EN/", ""), (1, "http://a.com/en/x", ""),
]


def test_urls(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "verdict": F.lit("v"), "component": F.lit(1)})
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in op10.filter_urls(df).collect()}
    assert got[1] == ("a.com", "/en/x", "com/en/", "block") and got[2] == ("example.com", "/en/7", "example.com/en/7", "allow")
    assert got[3][2:] == ("com/en/", "block") and got[4] == ("x.example.net", "/de/8", "example.net/de/8", "block") and got[5][2:] == (None, "allow")
    assert got[6] == ("net", "", None, "allow") and got[7] == ("", "", None, "allow") and got[8] == ("", "", None, "allow")
    assert got[9][3] == "block" and got[10][3] == "block"  # aliases of a blocked url
    assert got[11][3] == "allow" and got[12][3] == "allow"  # an allowed url in the component wins
    assert got[13][3] == "allow" and got[14][:2] == ("a.com", "") and got[15][2] is None
    assert op10.filter_urls(df).count() == len(PAGES) and op10.filter_urls(df.limit(0)).count() == 0
    redirects = spark.createDataFrame([("http://free.test/e", "http://b.org/es/2"), (None, "x")], "src string, dst string")
    assert {r.page_id: r.verdict for r in op10.filter_urls(df, redirects=redirects).collect()}[13] == "block"


def test_each_rule_has_the_word_of_the_contract(spark):
    """A page for each rule, on its host and on a subdomain; an alias of a page that net/de/ allows is allowed."""
    said = {("com", "/en/"): "block", ("example.com", "/en/7"): "allow", ("net", "/de/"): "allow", ("example.net", "/de/8"): "block", ("org", "/es/"): "block"}
    want = [(f"http://{sub}{h}{p}z", h + p, v) for (h, p), v in said.items() for sub in ("", "x.")]
    rows = [(k, u, "") for k, (u, _, _) in enumerate(want)] + [(90, "http://free.test/z", '<link rel="canonical" href="http://y.net/de/1"><link rel="canonical" href="http://y.org/es/1">')]
    got = {r.page_id: (r.rule, r.verdict) for r in op10.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: (rule, v) for k, (_, rule, v) in enumerate(want)} | {90: (None, "allow")}


def test_spellings_of_a_url_are_one(spark):
    link = lambda u: f'<link rel="canonical" href="{u}">'
    rows = [
        (1, "http://FREE.test/e", ""), (2, "http://other.test/", link("http://free.test/e")), (3, "http://third.test/", link("http://FREE.test:80/e#x") + link("http://b.org/es/1")),  # host case, port, fragment
        (4, "http://q.test/?a=1&b=2", ""), (5, "http://q2.test", link("http://q.test?a=1&amp;b=2") + link("http://c.org/es/")),  # an encoded target, an empty path
        (6, "https://r.test/dir/page", link("../up?x") + link("//d.org/es/2")), (7, "https://r.test/up?x", ""), (8, "https://r.test/dir/x", link("./page")), (9, "http://r.test/dir/x", ""),
        (10, "http://s.test/a?b=/c/d", link("?z")), (11, "http://s.test/a?z", link("mailto:x@e.org") + link("#top")), (12, "http://s.test/free", link("javascript:void(0)")), (13, "http://s.test/a", link("/es/")),
    ]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.verdict, r.component) for r in op10.filter_urls(df).collect()}
    assert {i for i, (v, _) in got.items() if v == "block"} == {1, 2, 3, 4, 5, 6, 7, 8}
    assert got[10][1] == got[11][1] is not None and got[12][1] is None and got[13][1] == "http://s.test/a"


def test_urls_spread_like_a_walk_over_links(spark):
    """Random pages and links against a search from page to page; long chains, stars and cycles among them."""
    rng = random.Random(4)
    urls = [f"http://h{k}.test/{k}" for k in range(120)] + [f"http://h{k}.org/es/{k}" for k in range(4)] + ["http://example.com/en/7"]
    links = {(urls[k], urls[k + 1]) for k in range(40)} | {(urls[50], urls[k]) for k in range(51, 70)} | {(rng.choice(urls[70:]), rng.choice(urls[70:])) for _ in range(30)}
    rows = [(k, u, "".join(f"<link rel=canonical href='{b}'>" for a, b in sorted(links) if a == u)) for k, u in enumerate(urls)] + [(500, urls[0], ""), (501, None, "")]
    near: dict = {u: set() for u in urls}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)

    def verdict(u):
        own = "allow" if u == "http://example.com/en/7" else "block" if ".org/es/" in u else None
        seen, todo = {u}, [u]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        return own or ("allow" if "http://example.com/en/7" in seen else "block" if any(".org/es/" in x for x in seen) else "allow")

    got = {(r.page_id, r.verdict) for r in op10.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {(k, verdict(u) if u else "allow") for k, u, _ in rows}


@pytest.mark.parametrize("hot", [1_000, 2])
def test_components_of_stars_chains_and_cycles(spark, monkeypatch, hot):
    monkeypatch.setattr(stars, "HOT", hot)
    rng = random.Random(6)
    pairs = [(1, k) for k in range(2, 60)] + [(900, k) for k in range(800, 860)] + [(200 + k, 201 + k) for k in range(70)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5), (None, 3), (270, 300)]
    root = {x: x for p in pairs for x in p if None not in p}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if None not in (a, b):
            root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "u long, v long").repartition(5)).collect()}
    assert got == {x: top(x) for p in pairs for x in p if None not in p and p[0] != p[1]}


def test_a_stored_map_is_edited_and_kept(spark, tmp_path):
    """Three versions of one map: a grown table and another number of shards move few slots; the same table moves none."""
    rng = random.Random(2)
    rows = [(k, "x" * rng.randrange(400)) for k in range(900)]
    df = lambda n: spark.createDataFrame(rows[:n], "doc_id long, text string")
    path = f"file://{tmp_path}/map"
    placed = [{r.doc_id: (r.shard, r.map_version) for r in op9.shard(df(n), shards=s, slots=64, map_path=path).collect()} for n, s in ((500, 4), (500, 4), (900, 4), (900, 5))]
    assert placed[0] == placed[1] and {v for _, v in placed[0].values()} == {1}
    stored = {v: {r.vslot: r.shard for r in spark.read.parquet(path).where(f"version = {v}").collect()} for v in (1, 2, 3)}
    moved = [sum(stored[a][k] != stored[b][k] for k in range(64)) for a, b in ((1, 2), (2, 3))]
    assert 0 < moved[0] < 16 and 0 < moved[1] < 26
    assert {v for _, v in placed[2].values()} == {2} and {v for _, v in placed[3].values()} == {3} and {s for s, _ in placed[3].values()} == set(range(5))
    sizes = [sum(len(rows[i][1]) + 1 for i, (s, _) in placed[3].items() if s == k) for k in range(5)]
    assert max(sizes) < 1.3 * min(sizes)


def test_native_plans_run_no_python(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for df in (op9.shard(docs), op10.filter_urls(pages)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("Python", "Pandas", "InArrow"))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_queries_equal_sql(spark):
    import duckdb

    from patternloom.llm.registry import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        got, want = QUERIES[name](spark, DATA), con.sql(sql)
        cols = sorted(got.columns)
        assert cols == sorted(want.columns), name
        order = [want.columns.index(c) for c in cols]
        assert sorted(repr(tuple(r[c] for c in cols)) for r in got.collect()) == sorted(repr(tuple(r[i] for i in order)) for r in want.fetchall()), name


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_pipeline(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    at, names = docs, [n for n, _ in p.STAGES]
    assert names == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]
    counts = []
    for _, stage in p.STAGES[:-1]:
        at = spark.createDataFrame(stage(spark, at, DATA).collect(), docs.schema)
        assert at.columns == docs.columns
        counts.append(at.count())
    assert docs.count() >= counts[0] > counts[1] > counts[2] == counts[3] > 0
    whole = p.run(spark, DATA)
    assert whole.select("doc_id").distinct().count() == counts[3]
