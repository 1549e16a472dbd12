"""Queries of the driver over its tables: each operator of the engine with the SQL that must give the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternloom.checkpoints import shared_folder
from patternloom.functions import annotate as A
from patternloom.functions import scalar as S
from patternloom.functions.omni import omni_join, overlap_join
from patternloom.operators import closure, evaluation
from patternloom.plans.compile import solve
from patternloom.plans.parser import parse
from patternloom.runtime import Runtime, unpivot_properties
from patternloom.sources import readers, sinks
from patternloom.sources.tablestore import Store, from_frame, load_table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def geo_store(spark: SparkSession, d: str) -> Store:
    """region, nation, supplier and customer as tables of kinds and parts."""
    store = Store(spark)
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    store.add(from_frame("INREGION", nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.concat(F.lit("n"), "n_nationkey").alias("id"), "n_name", "r_name"), "id", {"NATION": "n_name", "REGION": "r_name"}))
    for t, p in (("supplier", "s"), ("customer", "c")):
        rows = read(spark, d, t).join(nation, F.col(f"{p}_nationkey") == nation.n_nationkey)
        key = "s_suppkey" if p == "s" else "c_custkey"
        store.add(from_frame(t.upper(), rows.select(F.concat(F.lit(p), key).alias("id"), f"{p}_name", "n_name"), "id", {"NAME": f"{p}_name", "NATION": "n_name"}))
    return store


# -- annotation and predicates

@query("tokenize_cells", """
SELECT p_partkey, CAST(len(list_filter(string_split(trim(p_name), ' '), lambda x: x <> '')) AS INTEGER) AS n_tokens,
  array_to_string(list_filter(string_split(trim(p_name), ' '), lambda x: x <> ''), '|') AS tokens
FROM part""")
def tokenize_cells(spark, d):
    t = S.tokens(F.col("p_name"))
    return read(spark, d, "part").select("p_partkey", F.size(t).alias("n_tokens"), F.array_join(t, "|").alias("tokens"))


@query("hyphen_alternatives", """
WITH a AS (SELECT o_orderkey, list_transform(string_split(o_orderpriority, ';'), lambda x: trim(x)) AS p FROM orders)
SELECT o_orderkey, array_to_string(list_concat(p, list_transform(list_filter(p, lambda x: contains(x, '-')), lambda x: replace(x, '-', ' '))), '|') AS alternatives FROM a""")
def hyphen_alternatives(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.array_join(S.alternatives(F.col("o_orderpriority")), "|").alias("alternatives"))


_WORDS = "list_filter(string_split(lower(trim(text)), ' '), lambda x: x <> '')"


@query("lexical_span", f"""
WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents)
SELECT doc_id, CAST(len(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the')) AS INTEGER) AS n_spans,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(w)), lambda i: w[i] = 'of' AND w[i + 1] = 'the'), lambda i: CAST(i - 1 AS VARCHAR)), ','), '') AS starts
FROM w""")
def lexical_span(spark, d):
    """Places where two literal words stand one after the other."""
    w = S.tokens(F.lower(F.col("text")))
    docs = read(spark, d, "documents").select("doc_id", F.transform(w, lambda x: F.array(x)).alias("slots"))
    spans = A.literal_spans(F.col("slots"), ["of", "the"])
    return docs.select("doc_id", spans.alias("s")).select("doc_id", F.size("s").alias("n_spans"), F.array_join(F.transform("s", lambda x: x.cast("string")), ",").alias("starts"))


@query("lexical_relaxed", """
WITH w AS (SELECT p_partkey, list_filter(string_split(lower(trim(p_name)), ' '), lambda x: x <> '') AS w FROM part),
s AS (SELECT p_partkey, w, unnest(range(1, len(w) + 1)) AS i FROM w),
f AS (SELECT p_partkey, i, list_position(w[i:], 'widget') AS a, list_position(w[i:], 'red') AS b FROM s)
SELECT p_partkey, CAST(count(*) AS BIGINT) AS n_spans, CAST(sum(i - 1 + greatest(a, b)) AS BIGINT) AS ends FROM f WHERE a > 0 AND b > 0 GROUP BY p_partkey""")
def lexical_relaxed(spark, d):
    """Spans from each start to the place by which all words of a relaxable literal were seen."""
    w = S.tokens(F.lower(F.col("p_name")))
    parts = read(spark, d, "part").select("p_partkey", F.transform(w, lambda x: F.array(x)).alias("slots"))
    spans = parts.select("p_partkey", A.relaxed_spans(F.col("slots"), ["widget", "red"]).alias("s")).where(F.size("s") > 0)
    return spans.select("p_partkey", F.size("s").cast("long").alias("n_spans"), F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + x["until"]).alias("ends"))


# -- pattern joins

@query("pattern_join_2", """
SELECT 's' || s_suppkey AS supplier, 'n' || n_nationkey AS nation, n_name AS n, r_name AS r
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def pattern_join_2(spark, d):
    p = parse('inferencepattern p row s=[TABLE:"SUPPLIER", NAME:<x>, NATION:<n>] row t=[TABLE:"INREGION", NATION:<n>, REGION:<r>] endinferencepattern').patterns[0]
    m = solve(geo_store(spark, d), p, None)
    return m.select(F.col("uid_s").alias("supplier"), F.col("uid_t").alias("nation"), words(m, "n"), words(m, "r"))


def words(m: DataFrame, var: str) -> F.Column:
    """A binding as it stands in its cell: the first representation of each position."""
    return F.array_join(F.transform(F.col(f"v_{var}"), lambda p: p[0]), " ").alias(var)


@query("pattern_join_3", """
SELECT 's' || s_suppkey AS supplier, 'c' || c_custkey AS customer, r_name AS r
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey WHERE r_name = 'ASIA'""")
def pattern_join_3(spark, d):
    p = parse('inferencepattern p row t=[TABLE:"INREGION", NATION:<n>, REGION:"asia"] row s=[TABLE:"SUPPLIER", NATION:<n>] row c=[TABLE:"CUSTOMER", NATION:<n>] endinferencepattern').patterns[0]
    m = solve(geo_store(spark, d), p, None)
    return m.select(F.col("uid_s").alias("supplier"), F.col("uid_c").alias("customer"), F.lit("ASIA").alias("r"))


@query("static_row", "SELECT 'n' || n_nationkey AS nation, 's' || s_suppkey AS supplier FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_nationkey = 3")
def static_row(spark, d):
    p = parse('inferencepattern p row a=[UUID:"n3", NATION:<n>] row s=[TABLE:"SUPPLIER", NATION:<n>] endinferencepattern').patterns[0]
    m = solve(geo_store(spark, d), p, None)
    return m.select(F.col("uid_a").alias("nation"), F.col("uid_s").alias("supplier"))


@query("optional_row_union", """
SELECT 'n' || n_nationkey AS nation, 's' || s_suppkey AS supplier, 0 AS unfilled FROM nation JOIN supplier ON s_nationkey = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, NULL, 1 FROM nation""")
def optional_row_union(spark, d):
    """An optional row is enumerated both filled and left out."""
    p = parse('inferencepattern p row a=[TABLE:"INREGION", NATION:<n>] row *s=[TABLE:"SUPPLIER", NATION:<n>] endinferencepattern').patterns[0]
    m = solve(geo_store(spark, d), p, None)
    return m.select(F.col("uid_a").alias("nation"), F.col("uid_s").alias("supplier"), F.col("n_opt_unfilled").alias("unfilled"))


@query("omni_join", """
WITH a AS (SELECT n_nationkey, [lower(n_name), lower(substr(n_name, 1, 3))] AS v FROM nation),
b AS (SELECT c_custkey, n.n_name, [lower(n.n_name), 'x' || c_custkey] AS v FROM customer JOIN nation n ON c_nationkey = n.n_nationkey)
SELECT a.n_nationkey, b.c_custkey FROM a JOIN b ON list_has_any(a.v, b.v)""")
def omni_join_query(spark, d):
    """Values meet if the sets at every position do: a hash join on blocking keys."""
    nation = read(spark, d, "nation")
    a = nation.select("n_nationkey", F.array(F.array(F.lower("n_name"), F.lower(F.substring("n_name", 1, 3)))).alias("va"))
    b = read(spark, d, "customer").join(nation.select(F.col("n_nationkey").alias("k"), "n_name"), F.col("c_nationkey") == F.col("k"))
    b = b.select("c_custkey", F.array(F.array(F.lower("n_name"), F.concat(F.lit("x"), "c_custkey"))).alias("vb"))
    return omni_join(a, b, "va", "vb").select("n_nationkey", "c_custkey")


@query("musthaveoromit_filter", """
SELECT 's' || s_suppkey AS supplier, 'n' || n_nationkey AS nation FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA'""")
def musthaveoromit_filter(spark, d):
    p = parse('inferencepattern p row s=[TABLE:"SUPPLIER", NATION:<n>] row t=[TABLE:"INREGION", NATION:<n>, REGION:<r>] musthaveoromit(<r> != "asia" && <r> != "ASIA") endinferencepattern').patterns[0]
    m = solve(geo_store(spark, d), p, None)
    return m.select(F.col("uid_s").alias("supplier"), F.col("uid_t").alias("nation"))


@query("match_order_limit", """
SELECT nation, supplier FROM (
  SELECT 'n' || n_nationkey AS nation, 's' || s_suppkey AS supplier, 0 AS u FROM nation JOIN supplier ON s_nationkey = n_nationkey
  UNION ALL SELECT 'n' || n_nationkey, NULL, 1 FROM nation) ORDER BY u, nation, supplier NULLS FIRST LIMIT 20""")
def match_order_limit(spark, d):
    p = parse('inferencepattern p row a=[TABLE:"INREGION", NATION:<n>] row *s=[TABLE:"SUPPLIER", NATION:<n>] endinferencepattern').patterns[0]
    return solve(geo_store(spark, d), p, 20).select(F.col("uid_a").alias("nation"), F.col("uid_s").alias("supplier"))


@query("composite_rowequiv", """
SELECT 's' || s_suppkey AS supplier, 'c' || c_custkey AS customer FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN customer ON c_nationkey = n_nationkey""")
def composite_rowequiv(spark, d):
    """Solutions of two patterns joined on the row that they share."""
    prog = parse("""inferencepattern a row s=[TABLE:"SUPPLIER", NATION:<n>] row t=[TABLE:"INREGION", NATION:<n>] endinferencepattern
        inferencepattern b row c=[TABLE:"CUSTOMER", NATION:<n>] row t=[TABLE:"INREGION", NATION:<n>] endinferencepattern
        inferencepattern ab infpat x = a infpat y = b rowequiv x.t = y.t endinferencepattern""")
    store, solved = geo_store(spark, d), {}
    for p in prog.patterns:
        solved[p.name] = solve(store, p, None, solved=solved)
    return solved["ab"].select(F.col("uid_x__s").alias("supplier"), F.col("uid_y__c").alias("customer"))


@query("match_hash", """
WITH RECURSIVE s AS (SELECT 's' || s_suppkey AS supplier, lower(s_name || ' ' || n_name) AS a, lower(n_name || ' ' || r_name) AS b
  FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey),
u AS (SELECT a AS t FROM s UNION SELECT b FROM s),
h AS (SELECT t, 0 AS i, CAST(0 AS BIGINT) AS h FROM u
  UNION ALL SELECT t, i + 1, CASE WHEN v >= 2147483648 THEN v - 4294967296 ELSE v END FROM (
    SELECT t, i, xor(xor((((h & 4294967295) << 5) & 4294967295), ((h >> 27) & 4294967295)), ascii(t[i + 1])) AS v FROM h WHERE i < length(t))),
r AS (SELECT t, h % 1000000 AS h FROM h WHERE i = length(t))
SELECT supplier, lower(to_hex(abs((a.h + b.h) % 1000000))) AS hash FROM s JOIN r a ON a.t = s.a JOIN r b ON b.t = s.b""")
def match_hash_query(spark, d):
    """The solution's hash: the sum of its rows' hashes, here by content, as their ids aren't of the lasting form."""
    p = parse('inferencepattern p row s=[TABLE:"SUPPLIER", NATION:<n>] row t=[TABLE:"INREGION", NATION:<n>] endinferencepattern').patterns[0]
    return solve(geo_store(spark, d), p, None).select(F.col("uid_s").alias("supplier"), "hash")


# -- fixpoints and edits

@query("taxonomic_closure", """
WITH RECURSIVE e AS (
  SELECT DISTINCT 'N' || n_nationkey AS src, 'R' || n_regionkey AS dst FROM nation
  UNION SELECT DISTINCT 'S' || s_suppkey, 'N' || s_nationkey FROM supplier
  UNION SELECT DISTINCT 'R' || r_regionkey, 'WORLD' FROM region),
c AS (SELECT src, dst FROM e UNION SELECT c.src, e.dst FROM c JOIN e ON c.dst = e.src)
SELECT src, dst FROM c""")
def taxonomic_closure(spark, d):
    pre = lambda p, c: F.concat(F.lit(p), c)
    e = read(spark, d, "nation").select(pre("N", "n_nationkey").alias("src"), pre("R", "n_regionkey").alias("dst"))
    e = e.unionByName(read(spark, d, "supplier").select(pre("S", "s_suppkey").alias("src"), pre("N", "s_nationkey").alias("dst")))
    e = e.unionByName(read(spark, d, "region").select(pre("R", "r_regionkey").alias("src"), F.lit("WORLD").alias("dst")))
    return closure.transitive_closure(e)


@query("kind_of_semi_join", """
SELECT s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE lower(r_name) = 'europe'""")
def kind_of_semi_join(spark, d):
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    named = nation.join(region, nation.n_regionkey == region.r_regionkey)  # the first alternatives count, by words or content lemmas
    kinds = named.select(F.concat("n_name", F.lit(" ; a land")).alias("src"), F.concat(F.lit("the "), "r_name", F.lit(" ; europe")).alias("dst"))
    rows = read(spark, d, "supplier").join(nation, F.col("s_nationkey") == nation.n_nationkey)
    return closure.kind_of_semi_join(rows, "n_name", "europe", kinds).select("s_suppkey")


@query("generate_rows_dedupe", """
WITH have AS (SELECT DISTINCT lower(p_brand) AS b, lower(p_type) AS t FROM part WHERE p_size <= 25)
SELECT DISTINCT lower(p_brand) AS brand, lower(p_type) AS type FROM part WHERE p_size > 25 AND NOT EXISTS (SELECT 1 FROM have WHERE b = lower(p_brand) AND t = lower(p_type))""")
def generate_rows_dedupe(spark, d):
    """Rows are added unless the table has their words already."""
    part, store = read(spark, d, "part"), Store(spark)
    store.add(from_frame("KIND", part.where("p_size <= 25"), "p_partkey", {"BRAND": "p_brand", "TYPE": "p_type"}))
    got = store.insert("KIND", part.where("p_size > 25").select(F.array(F.lower("p_brand"), F.lower("p_type"), F.lit("")).alias("cells")))
    return got.where("added").select(F.col("cells")[0].alias("brand"), F.col("cells")[1].alias("type"))


@query("remove_rows", "SELECT CAST(s_suppkey AS VARCHAR) AS uid FROM supplier WHERE s_acctbal >= 0")
def remove_rows(spark, d):
    s, store = read(spark, d, "supplier"), Store(spark)
    store.add(from_frame("SUPPLIER", s, "s_suppkey", {"NAME": "s_name"}))
    store.remove(s.where("s_acctbal < 0").select(F.col("s_suppkey").cast("string").alias("uid")))
    return store["SUPPLIER"].rows.select("uid")


@query("unpivot_properties", """
SELECT p_partkey AS object, property, value FROM (
  SELECT p_partkey, 'p_brand' AS property, p_brand AS value FROM part UNION ALL SELECT p_partkey, 'p_type', p_type FROM part UNION ALL SELECT p_partkey, 'p_size', CAST(p_size AS VARCHAR) FROM part) WHERE value IS NOT NULL""")
def unpivot(spark, d):
    return unpivot_properties(read(spark, d, "part"), "p_partkey", ["p_brand", "p_type", "p_size"])


# -- scalars

@query("dual_compare", """
SELECT event_id, CASE WHEN a IS NOT NULL THEN a > 50 ELSE s > '50' END AS above FROM (
  SELECT event_id, try_cast(x AS DOUBLE) AS a, x AS s FROM (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN CAST(event_id % 100 AS VARCHAR) ELSE event_type END AS x FROM events))""")
def dual_compare(spark, d):
    x = F.when(F.col("event_id") % 2 == 0, (F.col("event_id") % 100).cast("string")).otherwise(F.col("event_type"))
    return read(spark, d, "events").select("event_id", S.dual_compare(">", S.dual_text(x), S.dual_text(F.lit("50"))).alias("above"))


@query("ieee_divide", """
SELECT event_id, CASE WHEN b = 0 THEN CASE WHEN a > 0 THEN 'Infinity' WHEN a < 0 THEN '-Infinity' ELSE 'NaN' END ELSE CAST(CAST(round(a / b * 1000) AS BIGINT) AS VARCHAR) END AS q
FROM (SELECT event_id, CAST(event_id % 7 - 3 AS DOUBLE) AS a, CAST(event_id % 5 - 2 AS DOUBLE) AS b FROM events)""")
def ieee_divide(spark, d):
    a, b = (F.col("event_id") % 7 - 3).cast("double"), (F.col("event_id") % 5 - 2).cast("double")
    q = S.ieee_divide(a, b)
    whole = ~F.isnan(q) & (F.abs(q) < float("inf"))
    return read(spark, d, "events").select("event_id", F.when(whole, F.round(F.when(whole, q).otherwise(0.0) * 1000).cast("long").cast("string")).otherwise(q.cast("string")).alias("q"))


@query("split_mc_choices", r"""
WITH q AS (SELECT n_nationkey, 'Which is ' || n_name || '? (A) one (B) two (C) ' || n_name AS t, substr('ABCDE', n_nationkey % 5 + 1, 1) AS a FROM nation)
SELECT n_nationkey, trim(regexp_split_to_array(t, '\(([A-E]|[1-5])\)')[1]) AS stem, CAST(len(regexp_split_to_array(t, '\(([A-E]|[1-5])\)')) - 1 AS INTEGER) AS n_choices, CAST(n_nationkey % 5 AS INTEGER) AS answer FROM q""")
def split_mc_choices(spark, d):
    t = F.concat(F.lit("Which is "), "n_name", F.lit("? (A) one (B) two (C) "), "n_name")
    parts = S.stem_and_choices(t)
    letter = F.substring(F.lit("ABCDE"), F.col("n_nationkey") % 5 + 1, F.lit(1))
    return read(spark, d, "nation").select("n_nationkey", parts[0].alias("stem"), (F.size(parts) - 1).alias("n_choices"), S.answer_index(letter).alias("answer"))


@query("expl_string", """
SELECT o_orderkey, 'p' || l_partkey AS uid, CASE WHEN l_linenumber = 1 THEN 'CENTRAL' ELSE 'GROUNDING' END AS role FROM (
  SELECT o_orderkey, l_partkey, l_linenumber, row_number() OVER (PARTITION BY o_orderkey, l_partkey ORDER BY l_linenumber) AS k FROM orders JOIN lineitem ON o_orderkey = l_orderkey) WHERE k = 1""")
def expl_string(spark, d):
    """uid|ROLE strings back to rows; the first of a uid counts."""
    li = read(spark, d, "lineitem")
    word = F.concat(F.lit("P"), "l_partkey", F.lit("|"), F.when(F.col("l_linenumber") == 1, "central").otherwise("grounding"))
    made = li.groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", word.alias("w")))), lambda x: x["w"]), " ").alias("e"))
    e = read(spark, d, "orders").join(made, F.col("o_orderkey") == F.col("l_orderkey"))
    return e.select("o_orderkey", F.explode(S.explanation(F.col("e"))).alias("x")).select("o_orderkey", "x.uid", "x.role")


@query("state_first_last_before_after", """
SELECT event_id, lag(event_id) OVER w AS before, lead(event_id) OVER w AS after, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS first_named,
  last_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_named
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def state_references(spark, d):
    """The log of a user's states: before, after, first and last with the same name."""
    w, n = Window.partitionBy("user_id").orderBy("ts", "event_id"), Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    full = n.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return read(spark, d, "events").select("event_id", F.lag("event_id").over(w).alias("before"), F.lead("event_id").over(w).alias("after"), F.first("event_id").over(full).alias("first_named"), F.last("event_id").over(full).alias("last_named"))


# -- evaluation

_SETS = "SELECT l_orderkey AS q, l_suppkey % 3 AS sol, list(DISTINCT l_partkey) AS uids FROM lineitem GROUP BY ALL"
_GOLD = "SELECT l_orderkey AS q, list(DISTINCT l_partkey) AS gold FROM lineitem WHERE l_quantity > 25 GROUP BY ALL"


def order_sets(spark, d) -> tuple[DataFrame, DataFrame]:
    """Solutions (parts of an order by supplier class) and gold rows (its large positions)."""
    li = read(spark, d, "lineitem")
    sols = li.groupBy(F.col("l_orderkey").alias("question"), (F.col("l_suppkey") % 3).alias("solution")).agg(F.collect_set("l_partkey").alias("uids"))
    return sols, li.where("l_quantity > 25").groupBy(F.col("l_orderkey").alias("question")).agg(F.collect_set("l_partkey").alias("gold"))


@query("overlap_counts", f"""
SELECT s.q AS question, CAST(s.sol AS BIGINT) AS solution, CAST(len(list_intersect(uids, gold)) AS INTEGER) AS hits, CAST(len(uids) - len(list_intersect(uids, gold)) AS INTEGER) AS extras
FROM ({_SETS}) s JOIN ({_GOLD}) g ON s.q = g.q""")
def overlap_counts(spark, d):
    return evaluation.overlap(*order_sets(spark, d)).select("question", "solution", "hits", "extras")


@query("best_pair_combination", f"""
WITH s AS (SELECT s.q, s.sol, s.uids, g.gold FROM ({_SETS}) s JOIN ({_GOLD}) g ON s.q = g.q WHERE len(list_intersect(uids, gold)) > 0),
p AS (SELECT a.q, a.gold, list_distinct(list_concat(a.uids, b.uids)) AS u FROM s a JOIN s b ON a.q = b.q AND a.sol <= b.sol),
c AS (SELECT q, CAST(len(list_intersect(u, gold)) AS INTEGER) AS hits, CAST(len(u) - len(list_intersect(u, gold)) AS INTEGER) AS extras FROM p)
SELECT question, hits, extras FROM (SELECT q AS question, hits, extras, row_number() OVER (PARTITION BY q ORDER BY hits DESC, extras) AS k FROM c) WHERE k = 1""")
def best_pair_combination(spark, d):
    return evaluation.best_combination(*order_sets(spark, d), k=2).select("question", "hits", "extras")


def line_scores(spark, d) -> tuple[DataFrame, DataFrame]:
    li = read(spark, d, "lineitem")
    scores = li.groupBy(F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("uid")).agg(F.max("l_extendedprice").alias("score"))
    return scores, li.where("l_quantity > 25").select(F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("uid"))


_SCORES = "SELECT l_orderkey AS q, l_partkey AS uid, max(l_extendedprice) AS score FROM lineitem GROUP BY ALL"
_RANKS = f"SELECT q, uid, row_number() OVER (PARTITION BY q ORDER BY score DESC, uid) AS rank FROM ({_SCORES})"


@query("average_precision", f"""
WITH r AS ({_RANKS}), g AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS uid FROM lineitem WHERE l_quantity > 25),
h AS (SELECT r.q, rank, row_number() OVER (PARTITION BY r.q ORDER BY rank) AS i FROM r JOIN g ON r.q = g.q AND r.uid = g.uid)
SELECT q AS question, round(sum(i / rank) / count(*), 6) AS ap FROM h GROUP BY q""")
def average_precision(spark, d):
    return evaluation.average_precision(*line_scores(spark, d)).select("question", F.round("ap", 6).alias("ap"))


@query("topn_recall", f"""
WITH r AS ({_RANKS}), g AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS uid FROM lineitem WHERE l_quantity > 25)
SELECT g.q AS question, CAST(count(r.uid) AS BIGINT) AS hits, round(count(r.uid) / count(*), 6) AS recall FROM g LEFT JOIN (SELECT * FROM r WHERE rank <= 2) r ON r.q = g.q AND r.uid = g.uid GROUP BY g.q""")
def topn_recall(spark, d):
    return evaluation.top_n_recall(*line_scores(spark, d), n=2).select("question", "hits", F.round("recall", 6).alias("recall"))


@query("topic_profile", """
WITH t AS (SELECT p_partkey AS q, array_to_string(string_split(replace(p_type, ' ', '_'), '_')[1:2], '_') AS topic FROM part),
o AS (SELECT l_partkey AS q, l_shipdate IS NULL AS x, l_returnflag AS pattern, max(l_linenumber) AS hits FROM lineitem GROUP BY ALL),
n AS (SELECT topic, count(*) AS n FROM t GROUP BY topic)
SELECT t.topic, o.pattern, round(sum(o.hits) / any_value(n.n), 6) AS mean_hits FROM o JOIN t ON o.q = t.q JOIN n ON n.topic = t.topic GROUP BY t.topic, o.pattern""")
def topic_profile(spark, d):
    topics = read(spark, d, "part").select(F.col("p_partkey").alias("question"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("topic"))
    hits = read(spark, d, "lineitem").select(F.col("l_partkey").alias("question"), F.col("l_returnflag").alias("pattern"), F.col("l_linenumber").alias("hits"))
    return evaluation.topic_profile(hits, topics, 2).select("topic", "pattern", F.round("mean_hits", 6).alias("mean_hits"))


@query("topic_profile_shares", f"""
WITH o AS (SELECT s.q, CAST(s.sol AS BIGINT) AS pattern, len(list_intersect(uids, gold)) AS hits, len(gold) AS n_gold FROM ({_SETS}) s JOIN ({_GOLD}) g ON s.q = g.q),
t AS (SELECT o_orderkey AS q, string_split(o_orderpriority, '-')[1] AS topic FROM orders), n AS (SELECT topic, count(*) AS n FROM t GROUP BY topic)
SELECT t.topic, o.pattern, round(sum(o.hits) / any_value(n.n), 6) AS mean_hits, round(sum(o.hits / o.n_gold) / any_value(n.n), 6) AS mean_share
FROM o JOIN t ON o.q = t.q JOIN n ON n.topic = t.topic GROUP BY t.topic, o.pattern""")
def topic_profile_shares(spark, d):
    """Best hits of each kind of solution, and their part of the gold rows, by the first level of an order's topic."""
    o = evaluation.overlap(*order_sets(spark, d)).select("question", F.col("solution").alias("pattern"), "hits", (F.col("hits") / F.size("gold")).alias("share"))
    topics = read(spark, d, "orders").select(F.col("o_orderkey").alias("question"), F.replace("o_orderpriority", F.lit("-"), F.lit("_")).alias("topic"))
    return evaluation.topic_profile(o, topics, 1).select("topic", "pattern", F.round("mean_hits", 6).alias("mean_hits"), F.round("mean_share", 6).alias("mean_share"))


@query("coverage_bands", """
WITH c AS (SELECT replace(p_type, ' ', '_') AS topic, p_size / 50.0 AS coverage FROM part),
e AS (SELECT unnest([1, 2, 3]) AS level, topic, coverage FROM c)
SELECT CAST(level AS INTEGER) AS level, array_to_string(string_split(topic, '_')[1:level], '_') AS topic, count(*) FILTER (coverage < 0.33) AS low, count(*) FILTER (coverage >= 0.33 AND coverage < 0.66) AS mid, count(*) FILTER (coverage >= 0.66) AS high FROM e GROUP BY 1, 2""")
def coverage_bands(spark, d):
    c = read(spark, d, "part").select(F.col("p_partkey").alias("question"), F.replace("p_type", F.lit(" "), F.lit("_")).alias("topic"), (F.col("p_size") / 50.0).alias("coverage"))
    return evaluation.coverage_bands(c, 3)


@query("cooccurrence_pairs", """
WITH m AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS u FROM lineitem)
SELECT x.u AS a, y.u AS b, count(*) AS n FROM m x JOIN m y ON x.s = y.s AND x.u <> y.u GROUP BY ALL""")
def cooccurrence_pairs(spark, d):
    return evaluation.cooccurrence(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("solution"), F.col("l_suppkey").alias("uid")))


@query("tfidf_unit", """
WITH w AS (SELECT item_id AS doc, unnest(list_filter(string_split(lower(trim(text)), ' '), lambda x: x <> '')) AS word FROM benchmark),
tf AS (SELECT doc, word, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT word, count(*) AS df FROM tf GROUP BY ALL),
x AS (SELECT doc, tf.word, tf / log10(1 + df) AS w FROM tf JOIN df ON tf.word = df.word)
SELECT doc, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM x""")
def tfidf_unit(spark, d):
    w = read(spark, d, "benchmark").select(F.col("item_id").alias("doc"), F.explode(S.tokens(F.lower("text"))).alias("word"))
    return evaluation.tfidf(w).select("doc", "word", F.round("weight", 6).alias("weight"))


@query("confusion_matrix", """
SELECT quality AS actual, count(*) FILTER (toxic = 0) AS p_0, count(*) FILTER (toxic = 1) AS p_1, round(count(*) FILTER (toxic = quality) / count(*), 6) AS tpr FROM labels GROUP BY quality""")
def confusion_matrix(spark, d):
    return evaluation.confusion_matrix(read(spark, d, "labels"), "quality", "toxic", [0, 1]).withColumn("tpr", F.round("tpr", 6))


@query("histogram_bins", """
WITH b AS (SELECT unnest(range(0, 10)) AS bin), v AS (SELECT l_discount * 10 AS x FROM lineitem),
e AS (SELECT bin, CASE WHEN bin = 0 THEN 0.0 ELSE bin / 10.0 END AS low, CASE WHEN bin = 9 THEN 1.01 ELSE (bin + 1) / 10.0 END AS high FROM b)
SELECT CAST(bin AS INTEGER) AS bin, count(x) AS n, round(count(x) / (SELECT count(*) FROM v), 6) AS proportion FROM e LEFT JOIN v ON x >= CAST(low AS DOUBLE) AND x < CAST(high AS DOUBLE) GROUP BY bin""")
def histogram_bins(spark, d):
    return evaluation.histogram(read(spark, d, "lineitem").select((F.col("l_discount") * 10).alias("x")), "x").select("bin", "n", F.round("proportion", 6).alias("proportion"))


@query("score_sum", f"""
WITH r AS ({_RANKS}), s AS (SELECT q, sol, unnest(uids) AS uid FROM ({_SETS})), v AS ({_SCORES})
SELECT s.q AS question, CAST(s.sol AS BIGINT) AS solution, round(sum(CASE WHEN r.rank > 2 THEN 0.0 ELSE v.score END), 2) AS score FROM s JOIN r ON s.q = r.q AND s.uid = r.uid JOIN v ON v.q = s.q AND v.uid = s.uid GROUP BY ALL""")
def score_sum(spark, d):
    out = evaluation.score_sum(order_sets(spark, d)[0], line_scores(spark, d)[0], cutoff=2)
    return out.withColumn("score", F.round("score", 2))


@query("top_n_per_pattern", "SELECT o_orderpriority AS pattern, o_orderkey AS uid FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS k FROM orders) WHERE k <= 5")
def top_n_per_pattern(spark, d):
    o = read(spark, d, "orders").select(F.col("o_orderpriority").alias("pattern"), F.col("o_orderkey").alias("uid"), F.col("o_totalprice").alias("score"))
    return evaluation.top_n(o, 5, ["pattern"]).select("pattern", "uid")


@query("mean_rank_by_rating", f"""
WITH r AS ({_RANKS}), t AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS uid, CAST(l_partkey % 4 AS INTEGER) AS rating FROM lineitem),
c AS (SELECT q FROM t GROUP BY q HAVING count(*) FILTER (rating = 0) <= 1)
SELECT rating, round(avg(rank), 6) AS mean_rank, count(*) AS n FROM r JOIN t ON r.q = t.q AND r.uid = t.uid JOIN c ON c.q = r.q GROUP BY rating""")
def mean_rank_by_rating(spark, d):
    t = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("question"), F.col("l_partkey").alias("uid"), (F.col("l_partkey") % 4).cast("int").alias("rating")).distinct()
    return evaluation.mean_rank_by_rating(line_scores(spark, d)[0], t).withColumn("mean_rank", F.round("mean_rank", 6))


@query("pattern_suggestions", """
WITH m AS (SELECT l_partkey AS uid, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT p_brand AS pattern, CAST(sum(n) AS BIGINT) AS score FROM part JOIN m ON p_partkey = uid GROUP BY 1""")
def pattern_suggestions(spark, d):
    missing = read(spark, d, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("uid")).agg(F.count("*").alias("n"))
    return evaluation.suggestions(missing, read(spark, d, "part").select(F.col("p_brand").alias("pattern"), F.col("p_partkey").alias("uid")))


@query("leak_check", "SELECT 'q' || o_custkey AS id FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT 'q' || o_custkey FROM orders WHERE o_orderstatus <> 'O'")
def leak_check(spark, d):
    name = read(spark, d, "orders").select("o_orderstatus", F.concat(F.lit("q"), "o_custkey", F.lit("_ENUM"), "o_orderkey").alias("id"))
    return evaluation.leaked(name.where("o_orderstatus = 'O'"), name.where("o_orderstatus <> 'O'"))


@query("row_text", "SELECT CAST(s_suppkey AS VARCHAR) AS uid, s_name || ' ' || n_name AS row_text FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def row_text(spark, d):
    s, n = read(spark, d, "supplier"), read(spark, d, "nation")
    t = from_frame("S", s.join(n, s.s_nationkey == n.n_nationkey), "s_suppkey", {"NAME": "s_name", "NATION": "n_name"})
    return t.rows.select("uid", t.text().alias("row_text"))




@query("shouldhave_score", """
SELECT 's' || s_suppkey AS supplier, r_name <> 'ASIA' AS executable, ((CASE WHEN r_name = 'EUROPE' THEN 1 ELSE 0 END) + (CASE WHEN r_name <> 'AFRICA' THEN 1 ELSE 0 END)) / 2.0::DOUBLE AS score
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def shouldhave_score(spark, d):
    """musthave marks a solution as executable or not; shouldhave scores it; neither removes it."""
    p = parse('inferencepattern p row s=[TABLE:"SUPPLIER", NATION:<n>] row t=[TABLE:"INREGION", NATION:<n>, REGION:<r>] musthave(<r> != "asia") shouldhave(<r> == "europe") shouldhave(<r> != "africa") endinferencepattern').patterns[0]
    m = solve(geo_store(spark, d), p, None)
    return m.select(F.col("uid_s").alias("supplier"), "executable", F.col("should_score").alias("score"))


@query("self_join_same_variable", "SELECT 'n' || a.n_nationkey AS a, 'n' || b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def self_join_same_variable(spark, d):
    p = parse('inferencepattern p row a=[TABLE:"INREGION", REGION:<r>] row b=[TABLE:"INREGION", REGION:<r>] endinferencepattern').patterns[0]
    m = solve(geo_store(spark, d), p, None)
    return m.select(F.col("uid_a").alias("a"), F.col("uid_b").alias("b"))


@query("or_options", "SELECT 'n' || n_nationkey AS nation FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('ASIA', 'EUROPE')")
def or_options(spark, d):
    p = parse('inferencepattern p row a=[TABLE:"INREGION", REGION:"asia" || "europe"] endinferencepattern').patterns[0]
    return solve(geo_store(spark, d), p, None).select(F.col("uid_a").alias("nation"))


@query("span_segmentation", """
WITH w AS (SELECT p_partkey, list_filter(string_split(trim(p_name), ' '), lambda x: x <> '') AS w FROM part)
SELECT 'p' || p_partkey AS part, array_to_string(w[1:i], ' ') AS a, array_to_string(w[i + 1:], ' ') AS b FROM (SELECT *, unnest(range(1, len(w))) AS i FROM w)""")
def span_segmentation(spark, d):
    """Two variables share a cell in every split."""
    store = Store(spark)
    store.add(from_frame("PART", read(spark, d, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), "p_name"), "id", {"NAME": "p_name"}))
    p = parse('inferencepattern p row r=[TABLE:"PART", NAME:<a> + <b>] endinferencepattern').patterns[0]
    m = solve(store, p, None)
    return m.select(F.col("uid_r").alias("part"), words(m, "a"), words(m, "b"))


@query("category_counts", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def category_counts(spark, d):
    return evaluation.category_counts(read(spark, d, "part"), "p_brand")


@query("false_positive_share", "SELECT toxic AS predicted, round(count(*) FILTER (quality <> toxic) / count(*), 6) AS false_share FROM labels GROUP BY toxic")
def false_positive_share(spark, d):
    return evaluation.false_positive_share(read(spark, d, "labels"), "quality", "toxic").withColumn("false_share", F.round("false_share", 6))


@query("set_accuracy", f"SELECT s.q AS question, CAST(s.sol AS BIGINT) AS solution, round(len(list_intersect(uids, gold)) / len(gold), 6) AS accuracy FROM ({_SETS}) s JOIN ({_GOLD}) g ON s.q = g.q")
def set_accuracy(spark, d):
    sols, gold = order_sets(spark, d)
    sols = sols.withColumn("set", F.struct("question", "solution"))
    return evaluation.accuracy(sols.select("set", "question", "uids").join(gold, "question").select("set", "uids"), sols.join(gold, "question").select("set", "gold"), "set").select("set.question", "set.solution", F.round("accuracy", 6).alias("accuracy"))


@query("table_categories", "SELECT n_name, CASE n_regionkey WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE 'UNKNOWN' END AS category FROM nation")
def table_categories(spark, d):
    known = spark.createDataFrame([(0, "first"), (1, "second")], "name int, category string")
    return readers.with_category(read(spark, d, "nation"), known, "n_regionkey").select("n_name", "category")


@query("populated_variables", "SELECT CASE WHEN s IS NULL THEN 1 ELSE 2 END AS bound, count(*) AS n FROM (SELECT n_nationkey, 1 AS s FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT n_nationkey, NULL FROM nation) GROUP BY 1")
def populated_variables(spark, d):
    p = parse('inferencepattern p row a=[TABLE:"INREGION", NATION:<n>] row *s=[TABLE:"SUPPLIER", NATION:<n>, NAME:<x>] endinferencepattern').patterns[0]
    return evaluation.populated_variables(solve(geo_store(spark, d), p, None))


@query("mean_average_precision", f"""
WITH r AS ({_RANKS}), g AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS uid FROM lineitem WHERE l_quantity > 25),
h AS (SELECT r.q, rank, row_number() OVER (PARTITION BY r.q ORDER BY rank) AS i FROM r JOIN g ON r.q = g.q AND r.uid = g.uid)
SELECT round(avg(ap), 6) AS map, count(*) AS questions FROM (SELECT q, sum(i / rank) / count(*) AS ap FROM h GROUP BY q)""")
def mean_average_precision(spark, d):
    return evaluation.mean_average_precision(*line_scores(spark, d)).withColumn("map", F.round("map", 6))


@query("content_lemma_counts", """
SELECT word, count(*) AS n FROM (SELECT DISTINCT p_partkey, unnest(list_filter(string_split(lower(trim('the ' || p_brand)), ' '), lambda x: x NOT IN ('', 'the'))) AS word FROM part) GROUP BY word""")
def content_lemma_counts(spark, d):
    """In how many rows each word stands."""
    alts = A.annotate(F.concat(F.lit("the "), F.col("p_brand")))
    each = read(spark, d, "part").select(F.explode(A.content_lemmas(alts)).alias("word"))
    return each.groupBy("word").agg(F.count("*").alias("n"))


@query("catalog_roles", "SELECT * FROM (VALUES ('SUPPLIER', 'NAME', 'DATA'), ('SUPPLIER', 'NATION', 'DATA'), ('SUPPLIER', '[SKIP] UID', 'UID'), ('CUSTOMER', 'NAME', 'DATA'), ('CUSTOMER', 'NATION', 'DATA'), ('CUSTOMER', '[SKIP] UID', 'UID'), ('INREGION', 'NATION', 'DATA'), ('INREGION', 'REGION', 'DATA'), ('INREGION', '[SKIP] UID', 'UID')) t(tbl, col, role)")
def catalog_roles(spark, d):
    return geo_store(spark, d).catalog().select(F.col("table").alias("tbl"), "col", "role")


@query("cells_long_form", "SELECT 'SUPPLIER' AS tbl, 's' || s_suppkey AS uid, 'NAME' AS col, s_name AS text FROM supplier UNION ALL SELECT 'SUPPLIER', 's' || s_suppkey, 'NATION', n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def cells_long_form(spark, d):
    return geo_store(spark, d).cells().where("table = 'SUPPLIER' and role = 'DATA'").select(F.col("table").alias("tbl"), "uid", "col", "text")


@query("overlap_join", """
WITH w AS (SELECT DISTINCT item_id, unnest(list_filter(string_split(lower(trim(text)), ' '), lambda x: x <> '')) AS w FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, count(*) AS shared FROM w a JOIN w b ON a.w = b.w GROUP BY ALL HAVING count(*) >= 5""")
def overlap_join_query(spark, d):
    w = read(spark, d, "benchmark").select("item_id", S.tokens(F.lower("text")).alias("w"))
    return overlap_join(w.toDF("a", "wa"), w.toDF("b", "wb"), "a", "b", "wa", "wb", 5)


@query("cooccurrence_shared_words", """
WITH m AS (SELECT DISTINCT l_orderkey AS s, l_partkey AS u FROM lineitem),
w AS (SELECT p_partkey AS u, list_filter(string_split(lower(trim(p_name)), ' '), lambda x: x <> '') AS w FROM part)
SELECT x.u AS a, y.u AS b, count(*) AS n FROM m x JOIN m y ON x.s = y.s AND x.u <> y.u JOIN w wx ON wx.u = x.u JOIN w wy ON wy.u = y.u WHERE list_has_any(wx.w, wy.w) GROUP BY ALL""")
def cooccurrence_shared_words(spark, d):
    words_of = read(spark, d, "part").select(F.col("p_partkey").alias("uid"), S.tokens(F.lower("p_name")).alias("words"))
    return evaluation.cooccurrence(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("solution"), F.col("l_partkey").alias("uid")), words_of)


_OVERLAPS = f"SELECT s.q, s.sol, len(list_intersect(uids, gold)) AS hits FROM ({_SETS}) s JOIN ({_GOLD}) g ON s.q = g.q"
_COVER = f"SELECT g.q, coalesce(max(o.hits), 0) / any_value(len(g.gold)) AS c FROM ({_GOLD}) g LEFT JOIN ({_OVERLAPS}) o ON o.q = g.q GROUP BY g.q"


@query("best_by_score", f"""
WITH s AS (SELECT o.q, o.sol, s.uids, g.gold, CAST(s.sol + 1 AS DOUBLE) AS score FROM ({_OVERLAPS}) o JOIN ({_SETS}) s ON s.q = o.q AND s.sol = o.sol JOIN ({_GOLD}) g ON g.q = o.q WHERE o.hits > 0),
p AS (SELECT a.q, a.gold, list_distinct(list_concat(list_concat(a.uids, b.uids), c.uids)) AS u, a.score + CASE WHEN b.sol = a.sol THEN 0 ELSE b.score END + CASE WHEN c.sol = b.sol THEN 0 ELSE c.score END AS score
  FROM s a JOIN s b ON a.q = b.q AND a.sol <= b.sol JOIN s c ON c.q = a.q AND b.sol <= c.sol),
x AS (SELECT q, CAST(len(list_intersect(u, gold)) AS INTEGER) AS hits, CAST(len(u) - len(list_intersect(u, gold)) AS INTEGER) AS extras, score FROM p)
SELECT question, hits, score FROM (SELECT q AS question, hits, score, row_number() OVER (PARTITION BY q ORDER BY hits DESC, score DESC, extras) AS k FROM x) WHERE k = 1""")
def best_by_score(spark, d):
    """Combinations of up to three solutions, the highest sum of scores first."""
    sols, gold = order_sets(spark, d)
    return evaluation.best_combination(sols.withColumn("points", (F.col("solution") + 1).cast("double")), gold, k=3, by_score="points").select("question", "hits", "score")


@query("coverage_histogram", f"""
WITH b AS (SELECT unnest(range(0, 10)) AS bin), v AS ({_COVER}),
e AS (SELECT bin, CAST(CASE WHEN bin = 0 THEN 0.0 ELSE bin / 10.0 END AS DOUBLE) AS low, CAST(CASE WHEN bin = 9 THEN 1.01 ELSE (bin + 1) / 10.0 END AS DOUBLE) AS high FROM b)
SELECT CAST(bin AS INTEGER) AS bin, count(c) AS n, round(count(c) / (SELECT count(*) FROM v), 6) AS proportion FROM e LEFT JOIN v ON c >= low AND c < high GROUP BY bin""")
def coverage_histogram(spark, d):
    sols, gold = order_sets(spark, d)
    return evaluation.coverage_histogram(evaluation.overlap(sols, gold), gold).select("bin", "n", F.round("proportion", 6).alias("proportion"))


@query("coverage_averages", f"""
SELECT count(*) AS questions, count(*) FILTER (c > 0) AS answered, round(avg(c), 6) AS mean_coverage, round(avg(c) FILTER (c > 0), 6) AS mean_answered, count(*) FILTER (c >= 1) AS complete FROM ({_COVER})""")
def coverage_averages(spark, d):
    sols, gold = order_sets(spark, d)
    out = evaluation.coverage_averages(evaluation.overlap(sols, gold), gold)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_coverage", "mean_answered")})


@query("leftover_rows", f"""
WITH s AS (SELECT l_orderkey AS q, l_partkey AS u FROM lineitem WHERE l_suppkey % 3 = 0), g AS (SELECT DISTINCT l_orderkey AS q, l_partkey AS u FROM lineitem WHERE l_quantity > 25)
SELECT u AS uid, count(*) AS n FROM g ANTI JOIN s USING (q, u) GROUP BY u""")
def leftover_rows(spark, d):
    sols, gold = order_sets(spark, d)
    return evaluation.leftover_rows(sols.where("solution = 0"), gold)


@query("pattern_statistics", """
SELECT 'p' AS pattern, count(*) AS solutions, 2 AS slots, 2 AS variables, count(*) AS with_variables, CAST(0 AS BIGINT) AS without_variables, round(avg(b), 6) AS mean_bound FROM (
  SELECT 2.0 AS b FROM nation JOIN supplier ON s_nationkey = n_nationkey UNION ALL SELECT 1.0 FROM nation)""")
def pattern_statistics(spark, d):
    p = parse('inferencepattern p row a=[TABLE:"INREGION", NATION:<n>] row *s=[TABLE:"SUPPLIER", NATION:<n>, NAME:<x>] endinferencepattern').patterns[0]
    return evaluation.pattern_statistics({"p": solve(geo_store(spark, d), p, None)}).withColumn("mean_bound", F.round("mean_bound", 6))


@query("arithmetic_and_logic", """
SELECT event_id, CAST(a + b AS BIGINT) AS plus, CAST(a - b AS BIGINT) AS minus, CAST(a * b AS BIGINT) AS times, CASE WHEN b = 0 THEN NULL ELSE CAST(a - b * trunc(a / b) AS BIGINT) END AS rest, event_type || '-' || event_id AS joined,
  a = b AS eq, a <> b AS ne, a < b AS lt, a <= b AS le, a >= b AS ge, CASE WHEN a = 0 OR b = 0 THEN NULL ELSE a > 0 AND b > 0 END AS both, CASE WHEN a = 0 OR b = 0 THEN NULL ELSE a > 0 OR b > 0 END AS either
FROM (SELECT event_id, event_type, CAST(event_id % 7 - 3 AS DOUBLE) AS a, CAST(event_id % 5 - 2 AS DOUBLE) AS b FROM events)""")
def arithmetic_and_logic(spark, d):
    """Dual-typed values: numbers, texts where one side is none, and conditions that fail if either side does."""
    num = lambda n, k: S.dual((F.col("event_id") % n - k).cast("double"))
    a, b = num(7, 3), num(5, 2)
    whole = lambda op: S.dual_arithmetic(op, a, b)["d"]
    yes = lambda x: F.when(x["d"] == 0, F.lit(None).cast("boolean")).otherwise(x["d"] > 0)
    text = S.dual_arithmetic("+", S.dual_arithmetic("+", S.dual_text(F.col("event_type")), S.dual_text(F.lit("-"))), S.dual_text(F.col("event_id").cast("string")))
    rest = whole("%")
    return read(spark, d, "events").select(
        "event_id", whole("+").cast("long").alias("plus"), whole("-").cast("long").alias("minus"), whole("*").cast("long").alias("times"), F.when(~F.isnan(rest), rest.cast("long")).alias("rest"), text["s"].alias("joined"),
        *(S.dual_compare(op, a, b).alias(n) for op, n in (("==", "eq"), ("!=", "ne"), ("<", "lt"), ("<=", "le"), (">=", "ge"))), S.strict_and(yes(a), yes(b)).alias("both"), S.strict_or(yes(a), yes(b)).alias("either"),
    )


@query("sanitised_names", "SELECT p_partkey, regexp_replace(trim(regexp_replace(upper(p_type || ' / ' || p_brand || '#'), '[^A-Z0-9]+', ' ', 'g')), ' +', '_', 'g') AS name FROM part")
def sanitised_names(spark, d):
    return read(spark, d, "part").select("p_partkey", S.sanitised(F.concat("p_type", F.lit(" / "), "p_brand", F.lit("#"))).alias("name"))


@query("roles_and_flags", """
SELECT o_orderkey, CAST(count(*) FILTER (l_linenumber = 1) AS INTEGER) AS n_central, any_value(o_orderpriority) LIKE '1-%' AS urgent
FROM orders JOIN (SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL) ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def roles_and_flags(spark, d):
    """Explanations filtered by role, questions by flag."""
    word = F.concat(F.lit("p"), "l_partkey", F.lit("|"), F.when(F.col("l_linenumber") == 1, "central").otherwise("grounding"))
    made = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", word.alias("w")))), lambda x: x["w"]), " ").alias("e"))
    both = read(spark, d, "orders").join(made, F.col("o_orderkey") == F.col("l_orderkey"))
    flags = F.concat(F.lit("success "), F.replace("o_orderpriority", F.lit("-"), F.lit(" flag ")))
    return both.select("o_orderkey", F.size(S.with_roles(S.explanation(F.col("e")), ["CENTRAL"])).alias("n_central"), S.has_flag(flags, "1").alias("urgent"))


@query("distractor_choice", """
WITH q AS (SELECT item_id, list_distinct(list_filter(string_split(lower(trim(text)), ' '), lambda x: x <> '')) AS w FROM benchmark WHERE text IS NOT NULL),
c AS (SELECT a.item_id AS question, b.item_id AS uid, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared FROM q a JOIN q b ON a.item_id <> b.item_id AND (a.item_id + b.item_id) % 7 = 0)
SELECT question, uid, shared FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY shared DESC, uid) AS k FROM c) WHERE k <= 2""")
def distractor_choice(spark, d):
    """The two rows of each question, out of those ranked beyond the skipped ones, that share most words with it."""
    w = read(spark, d, "benchmark").where("text is not null").select("item_id", F.array_distinct(S.tokens(F.lower("text"))).alias("words"))
    a, b = w.select(F.col("item_id").alias("question"), F.col("words").alias("question_words")), w.withColumnRenamed("item_id", "uid")
    pairs = a.join(b, (F.col("question") != F.col("uid")) & (F.pmod(F.col("question") + F.col("uid"), F.lit(7)) == 0))
    return evaluation.distractors(pairs.select("question", "uid", "words", F.lit(101).alias("rank")), a, n=2, skip=100, tries=1_000_000)


@query("tfidf_binary", """
WITH tf AS (SELECT DISTINCT item_id AS doc, unnest(list_filter(string_split(lower(trim(text)), ' '), lambda x: x <> '')) AS word FROM benchmark),
df AS (SELECT word, count(*) AS df FROM tf GROUP BY word), x AS (SELECT doc, tf.word, 1 / log10(1 + df) AS w FROM tf JOIN df ON tf.word = df.word)
SELECT doc, word, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc)), 6) AS weight FROM x""")
def tfidf_binary(spark, d):
    w = read(spark, d, "benchmark").select(F.col("item_id").alias("doc"), F.explode(S.tokens(F.lower("text"))).alias("word"))
    return evaluation.tfidf(w, binary=True).select("doc", "word", F.round("weight", 6).alias("weight"))


@query("relaxable_variable", "SELECT 's' || s_suppkey AS supplier, 'n' || n_nationkey AS nation FROM supplier CROSS JOIN nation")
def relaxable_variable(spark, d):
    """A relaxable occurrence never rules a row out, so every pair is a solution."""
    p = parse('inferencepattern p row s=[TABLE:"SUPPLIER", NATION:<n>] row t=[TABLE:"INREGION", NATION:<~n>] endinferencepattern').patterns[0]
    return solve(geo_store(spark, d), p, None).select(F.col("uid_s").alias("supplier"), F.col("uid_t").alias("nation"))


@query("cross_product", "SELECT 's' || s_suppkey AS supplier, r_name AS r FROM supplier CROSS JOIN (SELECT DISTINCT r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey = 3)")
def cross_product(spark, d):
    """Slots without a common variable: a product with one static row."""
    p = parse('inferencepattern p row t=[UUID:"n3", REGION:<r>] row s=[TABLE:"SUPPLIER", NAME:<x>] endinferencepattern').patterns[0]
    m = solve(geo_store(spark, d), p, None)
    return m.select(F.col("uid_s").alias("supplier"), words(m, "r"))


@query("part_of_speech_slots", "SELECT 'o' || o_orderkey AS row FROM orders WHERE regexp_matches(o_orderpriority, '^[0-9]')")
def part_of_speech_slots(spark, d):
    """A literal that is a tag fits tokens of that tag: here cardinal numbers."""
    store = Store(spark)
    o = read(spark, d, "orders").select(F.concat(F.lit("o"), "o_orderkey").alias("id"), F.split_part("o_orderpriority", F.lit("-"), F.lit(1)).alias("level"), "o_orderstatus")
    store.add(from_frame("ORDERS", o, "id", {"LEVEL": "level", "STATUS": "o_orderstatus"}))
    p = parse('inferencepattern p row r=[TABLE:"ORDERS", LEVEL:"POS:CD"] endinferencepattern').patterns[0]
    return solve(store, p, None).select(F.col("uid_r").alias("row"))


@query("constants_and_change", """
SELECT 'p' || p_partkey AS part, p_size > 25 AS executable FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)""")
def constants_and_change(spark, d):
    """A constant stands for its literal; CHANGE compares with a threshold."""
    part, store = read(spark, d, "part"), Store(spark)
    brand = part.agg(F.min("p_brand")).first()[0]
    store.add(from_frame("PART", part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), "p_brand", "p_size"), "id", {"BRAND": "p_brand", "SIZE": "p_size"}))
    p = parse(f'inferencepattern p const <b> = "{brand}" row r=[TABLE:"PART", BRAND:<b>, SIZE:<s>] musthave(<s> CHANGE [threshold: 25, direction: increase]) endinferencepattern').patterns[0]
    return solve(store, p, None).select(F.col("uid_r").alias("part"), "executable")


@query("auto_fixpoint", """
WITH RECURSIVE e AS (SELECT n_name AS part, r_name AS whole FROM nation JOIN region ON n_regionkey = r_regionkey UNION SELECT r_name, 'WORLD' FROM region
  UNION SELECT 'WORLD', 'SPACE'),
c AS (SELECT lower(part) AS part, lower(whole) AS whole FROM e UNION SELECT c.part, lower(e.whole) FROM c JOIN e ON c.whole = lower(e.part))
SELECT part, whole FROM c""")
def auto_fixpoint(spark, d):
    """A rule that generates rows runs until no row is added."""
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    e = nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_name", "r_name").union(region.select("r_name", F.lit("WORLD"))).union(spark.range(1).select(F.lit("WORLD"), F.lit("SPACE"))).toDF("part", "whole")
    store = Store(spark)
    store.add(from_frame("PARTOF", e.withColumn("id", F.concat(F.lit("e-"), "part", F.lit("-"), "whole")), "id", {"PART": "part", "WHOLE": "whole"}))
    run = Runtime(spark, store, parse("""inferencepattern chain executionmode = "AUTO" row a=[TABLE:"PARTOF", PART:<x>, WHOLE:<y>] row b=[TABLE:"PARTOF", PART:<y>, WHOLE:<z>]
        generateRow([TABLE:"PARTOF", PART:<x>, WHOLE:<z>]) endinferencepattern executeAutoPatterns"""))
    run.run()
    cell = lambda k: F.lower(F.element_at("cells", k))
    return store["PARTOF"].rows.select(cell(1).alias("part"), cell(2).alias("whole"))


# -- readers and writers: files in the shared folder, written from the tables and read back

def scratch(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/query-{uuid.uuid4().hex}/{name}"


def as_tsv(df: DataFrame, name: str, header: bool = True, sep: str = "\t", **options: str) -> str:
    path = scratch(df.sparkSession, name)
    df.write.options(sep=sep, header=header, **options).csv(path)
    return path


def as_lines(lines: DataFrame, name: str) -> str:
    path = scratch(lines.sparkSession, name)
    lines.write.text(path)
    return path


def nation_file(spark, d) -> str:
    """The 25 nations as one table file: some with blanks around them, some deprecated, some without a uid."""
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    k = F.col("n_nationkey")
    name = F.when(k % 3 == 0, F.concat(F.lit("  "), "n_name", F.lit(" "))).otherwise(F.col("n_name"))
    cells = [name, F.lit("is in"), F.col("r_name"), F.lit("a note"), F.when(k % 5 == 0, "old").otherwise(""), F.when(k % 7 == 0, "").otherwise(F.concat(F.lit("u"), k))]
    rows = nation.join(region, nation.n_regionkey == region.r_regionkey).select(k.cast("long").alias("k"), F.concat_ws("\t", *cells).alias("value"))
    head = spark.range(1).select(F.lit(-1).cast("long").alias("k"), F.lit("NATION\t[FILL] verb\tREGION\t[SKIP] COMMENTS\t[SKIP] DEP\t[SKIP] UID").alias("value"))
    return as_lines(head.unionByName(rows).coalesce(1).sortWithinPartitions("k").select("value"), "NATIONS.tsv")


@query("table_file", """
SELECT 'u' || n_nationkey AS uid, n_name || ' is in ' || r_name AS row_text, n_name || ' ' || r_name AS data_text FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey % 5 <> 0 AND n_nationkey % 7 <> 0""")
def table_file(spark, d):
    """Rows without a uid and deprecated ones are left out; comments are no text, fillers no data."""
    t = load_table(spark, nation_file(spark, d))
    return t.rows.select("uid", t.text().alias("row_text"), t.text(True).alias("data_text"))


@query("table_file_roles", "SELECT * FROM (VALUES ('NATIONS', 'NATION', 'NATION', 'DATA'), ('NATIONS', '[FILL] verb', 'FILL_VERB', 'FILL'), ('NATIONS', 'REGION', 'REGION', 'DATA'), ('NATIONS', '[SKIP] COMMENTS', 'SKIP_COMMENTS', 'SKIP'), ('NATIONS', '[SKIP] DEP', 'SKIP_DEP', 'DEP'), ('NATIONS', '[SKIP] UID', 'SKIP_UID', 'UID')) t(tbl, col, name, role)")
def table_file_roles(spark, d):
    store = Store(spark)
    store.add(load_table(spark, nation_file(spark, d)))
    return store.catalog().select(F.col("table").alias("tbl"), "col", "name", "role")


@query("ranking_files", """
WITH s AS (SELECT 's' || s_suppkey AS uid, 'q' || s_nationkey AS q, CAST(s_acctbal AS DOUBLE) AS score FROM supplier)
SELECT 'probabilities' AS kind, 'q0' AS question, uid, score FROM s UNION ALL SELECT 'listed', q, uid, score FROM s UNION ALL SELECT 'headerless', 'q0', uid, score FROM s UNION ALL SELECT 'cosine', 'q0', uid, score FROM s""")
def ranking_files(spark, d):
    """The four forms of rankings."""
    s = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("uid"), F.concat(F.lit("q"), "s_nationkey").alias("q"), F.col("s_acctbal").cast("double").alias("score"))
    none = F.lit("-")
    files = {
        "probabilities": as_tsv(s.select(F.col("uid").alias("uuid"), none.alias("rowText"), none.alias("isGoldRow"), none.alias("score_0"), F.col("score").alias("score_1")), "p"),
        "listed": as_tsv(s.select(F.col("q").alias("QuestionID"), F.col("uid").alias("ExplanationID"), F.col("score").alias("Score"), none.alias("IsGold")), "l"),
        "headerless": as_tsv(s.select("uid", none.alias("a"), none.alias("b"), "score"), "h", header=False),
        "cosine": as_tsv(s.select(none.alias("x"), F.col("score").alias("COS_AC_CORRECT"), F.col("uid").alias("UUID")), "c"),
    }
    out = None
    for kind, path in files.items():
        part = readers.rankings(spark, path, kind, None if kind == "listed" else "q0").select(F.lit(kind).alias("kind"), "question", "uid", "score")
        out = part if out is None else out.unionByName(part)
    return out


@query("rankings_by_question", "SELECT 'q' || s_nationkey AS question, 's' || s_suppkey AS uid, CAST(s_acctbal AS DOUBLE) AS score FROM supplier")
def rankings_by_question(spark, d):
    """A folder for each question, read back as one table."""
    s = read(spark, d, "supplier").select(F.concat(F.lit("q"), "s_nationkey").alias("question"), F.concat(F.lit("s"), "s_suppkey").alias("uid"), F.col("s_acctbal").cast("double").alias("score"))
    path = scratch(spark, "rankings")
    readers.split_rankings(s, path)
    return spark.read.options(sep="\t", header=True).schema("uid string, score double, question string").csv(path).select("question", "uid", "score")


@query("prediction_lines", """
SELECT 'Q_' || s_nationkey || '-1' AS question, 's' || s_suppkey AS uid, s_name AS row_text, CAST(s_suppkey AS DOUBLE) / 1000 AS score, CAST(s_nationkey AS DOUBLE) AS logit, s_suppkey % 2 = 1 AS gold FROM supplier""")
def prediction_lines(spark, d):
    s = read(spark, d, "supplier")
    two = lambda x: F.array(F.lit(0.25), x.cast("double"))
    line = F.to_json(F.struct(
        F.concat(F.lit("Q_"), "s_nationkey", F.lit("-1-A__x__s"), "s_suppkey").alias("id"), F.concat(F.lit("B: "), "s_name").alias("context"), (F.col("s_suppkey") % 2).alias("label"),
        two(F.col("s_nationkey")).alias("label_logits"), two(F.col("s_suppkey").cast("double") / 1000).alias("label_probs"),
    ))
    return readers.label_probabilities(spark, as_lines(s.select(line.alias("value")).unionByName(spark.range(1).select(F.lit("no object").alias("value"))), "predictions"))


@query("question_file", """
SELECT 'Q' || n_nationkey AS question, 'Which is ' || n_name || '?' AS stem, 'one|two|' || n_name AS choices, CAST(n_nationkey % 5 AS INTEGER) AS answer, 'EARTH_' || n_regionkey || '|LIFE' AS topics, 'u' || n_nationkey || ' CENTRAL' AS explanation
FROM nation WHERE n_nationkey % 3 <> 0 AND n_nationkey % 4 <> 1""")
def question_file(spark, d):
    """Columns by their header, in any order and case; only questions with choices and without a diagram."""
    k = F.col("n_nationkey")
    made = read(spark, d, "nation").select(
        F.concat(F.lit('"Which is '), "n_name", F.lit('? (A) one (B) two (C) '), "n_name", F.lit('"')).alias("Question"), F.substring(F.lit("ABCDE"), k % 5 + 1, F.lit(1)).alias("ANSWERKEY"), F.concat(F.lit("Q"), k).alias("questionID"),
        F.concat(F.lit("earth_"), "n_regionkey", F.lit(", Life ")).alias("consensus"), F.when(k % 3 == 0, "0").otherwise("1").alias("isMultipleChoiceQuestion"), F.when(k % 4 == 1, "1").otherwise("0").alias("includesDiagram"),
        F.concat(F.lit("U"), k, F.lit("|central")).alias("Explanation"),
    )
    e = F.col("explanation")[0]
    got = readers.questions(spark, as_tsv(made, "questions"))
    return got.select("question", "stem", F.array_join("choices", "|").alias("choices"), "answer", F.array_join("topics", "|").alias("topics"), F.concat_ws(" ", e["uid"], e["role"]).alias("explanation"))


@query("question_file_by_place", """
SELECT 'Q' || n_nationkey AS question, 'Which is ' || n_name || '?' AS stem, 'one|two' AS choices, CAST(CASE WHEN n_nationkey % 5 = 4 THEN -1 ELSE n_nationkey % 5 END AS INTEGER) AS answer, 'CAUSAL' AS kind, 'EARTH|LIFE' AS topics
FROM nation WHERE n_nationkey % 4 <> 1""")
def question_file_by_place(spark, d):
    """The older layout: fields by their places."""
    k, none = F.col("n_nationkey"), F.lit("x")
    made = read(spark, d, "nation").select(
        F.concat(F.lit("Q"), k).alias("a"), none.alias("b"), F.lit("1").alias("c"), F.substring(F.lit("ABCDE"), k % 5 + 1, F.lit(1)).alias("d"), F.lit("1").alias("e"), F.when(k % 4 == 1, "1").otherwise("0").alias("f"),
        none.alias("g"), none.alias("h"), none.alias("i"), F.lit("CAUSAL?").alias("j"), F.lit("earth, life").alias("k"), F.lit("why, so").alias("l"), F.concat(F.lit("Which is "), "n_name", F.lit("? (a) one (B) two")).alias("m"), none.alias("n"), none.alias("o"),
    )
    got = readers.questions_fixed(spark, as_tsv(made, "questions", sep=",", escape='"'))
    return got.select("question", "stem", F.array_join("choices", "|").alias("choices"), "answer", "kind", F.array_join("topics", "|").alias("topics"))


@query("rating_sheets", "SELECT 'nation ' || s_nationkey AS question, printf('%04x-0000-0000-00ff', s_suppkey) AS uid, CAST(s_suppkey % 4 AS INTEGER) AS rating FROM supplier")
def rating_sheets(spark, d):
    """Blocks of rated rows, each below the line that names its question."""
    s = read(spark, d, "supplier").select(F.col("s_nationkey").alias("b"), F.col("s_suppkey").cast("long").alias("n"))
    line = F.concat_ws("\t", F.concat(F.lower(F.lpad(F.hex("n"), 4, "0")), F.lit("-0000-0000-00ff")), F.lit("a row"), (F.col("n") % 4).cast("string"))
    heads = s.select("b").distinct().select("b", F.lit(-1).cast("long").alias("n"), F.concat(F.lit("nation "), "b").alias("value"))
    lines = heads.unionByName(s.select("b", "n", line.alias("value"))).repartition("b").sortWithinPartitions("b", "n").select("value")
    return readers.ratings(spark, as_lines(lines, "ratings"))


@query("word_norm_file", """
SELECT 'w' || p_partkey AS word, (p_size % 9) / 8.0::DOUBLE AS valence, CASE WHEN p_partkey % 3 = 0 THEN -1.0::DOUBLE ELSE 0.5::DOUBLE END AS arousal, -1.0::DOUBLE AS dominance FROM part""")
def word_norm_file(spark, d):
    made = read(spark, d, "part").select(F.concat(F.lit("W"), "p_partkey").alias("Word"), (F.col("p_size") % 9 + 1).alias("V.Mean.Sum"), F.when(F.col("p_partkey") % 3 == 0, "none").otherwise("5").alias("A.Mean.Sum"))
    return readers.word_norms(spark, as_tsv(made, "norms", sep=","))


@query("category_file", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'even' ELSE 'UNKNOWN' END AS category FROM nation")
def category_file(spark, d):
    nation = read(spark, d, "nation")
    lines = nation.select(F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit(" "), "n_name", F.lit("\t even"))).otherwise(F.concat(F.lit("# "), "n_name", F.lit("\todd"))).alias("value"))
    return readers.with_category(nation, readers.categories(spark, as_lines(lines, "categories")), "n_name").select("n_nationkey", "category")


def _listed(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


_TAG = (
    "CASE " + " ".join(f"WHEN w IN {_listed(ws)} THEN '{t}'" for t, ws in A.CLOSED.items())
    + r""" WHEN regexp_matches(w, '^[0-9][0-9.,/%-]*$') THEN 'CD' WHEN NOT regexp_matches(w, '[a-z0-9\x{80}-\x{10FFFF}]') THEN 'SY' WHEN w LIKE '%ly' THEN 'RB'
    WHEN regexp_matches(w, '.{3}(ing|ed|ise|ize|ify)$') THEN 'VB' WHEN regexp_matches(w, '.{3}(ous|ful|able|ible|ive|less|ish)$') THEN 'JJ' ELSE 'NN' END"""
)
_LEMMA = (
    "CASE " + " ".join(f"WHEN w = '{a}' THEN '{b}'" for a, b in A.IRREGULAR.items())
    + r""" WHEN regexp_matches(w, '.{2}ies$') THEN w[:-4] || 'y' WHEN regexp_matches(w, '.{2}(ss|us|is)$') THEN w WHEN regexp_matches(w, '.(ches|shes|xes|sses|zes)$') THEN w[:-3]
    WHEN regexp_matches(w, '.{2}s$') THEN w[:-2] WHEN regexp_matches(w, '.{2}(bb|dd|ff|gg|mm|nn|pp|rr|tt)ing$') THEN w[:-5] WHEN regexp_matches(w, '.{2}(bb|dd|ff|gg|mm|nn|pp|rr|tt)ed$') THEN w[:-4]
    WHEN regexp_matches(w, '.{3}ied$') THEN w[:-4] || 'y' WHEN regexp_matches(w, '.{3}ing$') THEN w[:-4] WHEN regexp_matches(w, '.{3}ed$') THEN w[:-3] ELSE w END"""
)


@query("annotated_tokens", f"""
WITH t AS (SELECT item_id, list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '') AS ws FROM benchmark WHERE text IS NOT NULL),
u AS (SELECT item_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM t), l AS (SELECT item_id, pos, word, lower(word) AS w FROM u)
SELECT item_id, CAST(pos AS INTEGER) AS pos, word, {_TAG} AS tag, {_LEMMA} AS lemma, ({_LEMMA}) || '_' || ({_TAG}) AS tagged FROM l""")
def annotated_tokens(spark, d):
    """Each token's grouped tag and lemma."""
    words_of = F.transform(S.tokens(F.translate("text", "\n", " ")), lambda w: A.token(w))
    return read(spark, d, "benchmark").where("text is not null").select("item_id", F.posexplode(words_of).alias("pos", "t")).select("item_id", "pos", "t.word", "t.tag", "t.lemma", F.col("t.tlemma").alias("tagged"))


@query("question_row_tokens", """
WITH w AS (SELECT p_partkey, list_filter(string_split(p_name || ' of ' || p_brand || ' ' || p_type, ' '), lambda x: x <> '') AS q, list_filter(string_split('the ' || p_name, ' '), lambda x: x <> '') AS r FROM part),
m AS (SELECT p_partkey,
  list_concat(list_concat(q, list_transform(q, lambda x: lower(x))), list_transform(q, lambda x: CASE lower(x) WHEN 'red' THEN 'colour' WHEN 'economy' THEN 'price' WHEN 'widget' THEN 'tool' ELSE lower(x) END)) AS q_all,
  list_concat(r, list_transform(r, lambda x: CASE lower(x) WHEN 'red' THEN 'colour' WHEN 'widget' THEN 'tool' ELSE x END)) AS r_all FROM w)
SELECT p_partkey, array_to_string(list_sort(list_distinct(q_all)), '|') AS question, array_to_string(list_sort(list_distinct(r_all)), '|') AS row_words FROM m""")
def question_row_tokens(spark, d):
    """Words and lemmas of a question's content words, and of a row's words, with a dictionary from a file."""
    lines = spark.createDataFrame([("colour\tred",), ("price\teconomy",), ("tool\twidget",)], "value string")
    known = readers.lemma_dictionary(spark, as_lines(lines, "lemmas"))
    q = A.question_tokens(F.concat(F.lit("the "), "p_name", F.lit(" of "), "p_brand"), F.col("p_type"), known)
    r = A.row_tokens(F.concat(F.lit("the "), "p_name"), known)
    return read(spark, d, "part").select("p_partkey", F.array_join(F.sort_array(q), "|").alias("question"), F.array_join(F.sort_array(r), "|").alias("row_words"))


@query("solution_documents", """
SELECT 's' || s_suppkey || ',n' || n_nationkey AS uuids, lower('n=' || n_name || ',r=' || r_name || ',x=' || s_name) AS variables, s_name || ' ' || n_name || ' / ' || n_name || ' ' || r_name AS texts
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def solution_documents(spark, d):
    """Solutions as JSON objects, read back."""
    store = geo_store(spark, d)
    p = parse('inferencepattern p row s=[TABLE:"SUPPLIER", NAME:<x>, NATION:<n>] row t=[TABLE:"INREGION", NATION:<n>, REGION:<r>] endinferencepattern').patterns[0]
    doc = F.from_json("json", "uuids array<string>, slots array<struct<rowText:string>>, variables array<struct<name:string,value:string>>").alias("j")
    got = sinks.match_documents(p, solve(store, p, None), store).select(doc).select("j.*")
    named = F.sort_array(F.transform("variables", lambda v: F.concat(v["name"], F.lit("="), v["value"])))
    return got.select(F.array_join("uuids", ",").alias("uuids"), F.array_join(named, ",").alias("variables"), F.array_join(F.col("slots.rowText"), " / ").alias("texts"))


@query("store_documents", """
SELECT 's' || s_suppkey AS uid, 'SUPPLIER' AS tbl, 'NAME|NATION|SKIP_UID' AS names, lower(s_name) || '|' || lower(n_name) AS words, 'NN|NN' AS tags FROM supplier JOIN nation ON s_nationkey = n_nationkey""")
def store_documents(spark, d):
    """Annotated rows as JSON objects, read back."""
    store = Store(spark)
    store.add(geo_store(spark, d)["SUPPLIER"])
    cells = "array<array<array<string>>>"
    got = sinks.store_documents(store).select(F.from_json("json", f"uuid string, tablename string, headerSanitized array<string>, cellWordsLowerCase {cells}, cellTags {cells}").alias("j")).select("j.*")
    flat = lambda c: F.array_join(F.flatten(F.flatten(c)), "|")
    return got.select(F.col("uuid").alias("uid"), F.col("tablename").alias("tbl"), F.array_join("headerSanitized", "|").alias("names"), flat("cellWordsLowerCase").alias("words"), flat("cellTags").alias("tags"))


# -- scripts

@query("requirements_of_instances", """
SELECT r_name FROM region JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 3 GROUP BY r_name HAVING sum(n_nationkey) > 50""")
def requirements_of_instances(spark, d):
    """Instances with the properties of their kinds; a pattern's requirements hold for some of them."""
    nation, region = read(spark, d, "nation"), read(spark, d, "region")
    total = nation.join(region, nation.n_regionkey == region.r_regionkey).groupBy("r_name").agg(F.sum("n_nationkey").cast("string").alias("total")).withColumns({"property": F.lit("total"), "id": F.concat(F.lit("t"), "r_name")})
    store = geo_store(spark, d)
    store.add(from_frame("PROP-TOTALS", total, "id", {"OBJECT": "r_name", "PROPERTY": "property", "VALUE": "total"}))
    kinds = region.where("r_regionkey <> 3").select(F.concat(F.lit("k"), "r_regionkey").alias("id"), "r_name", F.lit("the great regions ; lands").alias("kind"))
    store.add(from_frame("KINDOF", kinds, "id", {"HYPONYM": "r_name", "HYPERNYM": "kind"}))
    names = [r.r_name for r in region.select("r_name").collect()]  # the five regions
    rule = 'inferencepattern p require instance place = [KINDOF:"great region"] row r=[TABLE:"INREGION", NATION:<n>] musthave(place."total" > 50) endinferencepattern'
    each = [f'instantiate i{k}([KINDOF:"{n}"]) if (meetsRequirements(p, [<n> == "nation_0"], [place->i{k}]) > 0) then println("{n}") endif' for k, n in enumerate(names)]
    run = Runtime(spark, store, parse("\n".join([rule, *each])))
    run.run()
    return spark.createDataFrame([(x,) for x in run.printed], "r_name string")


@query("script_edits", """
SELECT lower(n_name) AS nation, lower(r_name) AS region FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE' AND n_nationkey <> 4
UNION SELECT 'atlantis', 'asia' UNION SELECT 'nation_1', 'america' UNION SELECT lower(n_name), 'world' FROM nation WHERE n_nationkey = 2""")
def script_edits(spark, d):
    """Rows are generated, unless they exist, and removed by a script; a pattern's code writes one for the solution meant."""
    store = geo_store(spark, d)
    run = Runtime(spark, store, parse("""inferencepattern p row a=[TABLE:"INREGION", NATION:<n>] temporalblock(now) generateRow([TABLE:"INREGION", NATION:<n>, REGION:"world"]) endtemporalblock
        temporalblock(later) generateRow([TABLE:"INREGION", NATION:<n>, REGION:"never"]) endtemporalblock endinferencepattern
      generateRow([TABLE:"INREGION", NATION:"atlantis", REGION:"ASIA"]) generateRow([TABLE:"INREGION", NATION:"NATION_1", REGION:"AMERICA"])
      executePattern(p, [<n> == "nation_2"], temporalblocks=[now])
      removeRows([TABLE:"INREGION", REGION:"europe"]) removeRow("n4")"""))
    run.run()
    cell = lambda k: F.lower(F.element_at("cells", k))
    return store["INREGION"].rows.select(cell(1).alias("nation"), cell(2).alias("region"))


# -- more of patterns and sets

@query("optional_variable", """
SELECT 's' || s_suppkey AS supplier, 'n' || n_nationkey AS nation FROM supplier CROSS JOIN (SELECT n_nationkey, n_regionkey FROM nation) WHERE s_nationkey = n_nationkey
UNION SELECT 's' || s_suppkey, 'x' || s_nationkey FROM supplier WHERE s_nationkey % 2 = 0""")
def optional_variable(spark, d):
    """An optional variable's cell may be empty: the row then fits every binding that the pattern's other cells allow."""
    store, nation = geo_store(spark, d), read(spark, d, "nation")
    s = read(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.concat(F.lit("x"), "s_nationkey").alias("home"), "n_name")
    homes = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("id"), F.concat(F.lit("x"), "n_nationkey").alias("home"), F.col("n_name").alias("name"))
    empty = nation.where("n_nationkey % 2 = 0").select(F.concat(F.lit("x"), "n_nationkey").alias("id"), F.concat(F.lit("x"), "n_nationkey").alias("home"), F.lit("").alias("name"))
    store.add(from_frame("S", s, "id", {"HOME": "home", "NATION": "n_name"}))
    store.add(from_frame("N", homes.unionByName(empty), "id", {"HOME": "home", "NATION": "name"}))
    p = parse('inferencepattern p row a=[TABLE:"S", HOME:<h>, NATION:<n>] row b=[TABLE:"N", HOME:<h>, NATION:<*n>] endinferencepattern').patterns[0]
    return solve(store, p, None).select(F.col("uid_a").alias("supplier"), F.col("uid_b").alias("nation"))


@query("lemma_overlap", """
WITH w AS (SELECT p_partkey, list_distinct(list_filter(string_split(lower(trim(p_name)), ' '), lambda x: x <> '')) AS w FROM part)
SELECT a.p_partkey AS part, CAST(len(list_intersect(a.w, b.w)) AS INTEGER) AS shared, list_has_any(a.w, b.w) AS meets FROM w a JOIN w b ON a.p_partkey + 1 = b.p_partkey""")
def lemma_overlap(spark, d):
    """Whether the sets of content lemmas of a row and the next one meet, plural or not."""
    part = read(spark, d, "part")
    lemmas = lambda c: A.content_lemmas(A.annotate(c))
    a = part.select(F.col("p_partkey").alias("part"), lemmas(F.concat(F.lit("the "), "p_name", F.lit("s"))).alias("wa"))
    b = part.select((F.col("p_partkey") - 1).alias("part"), lemmas(F.col("p_name")).alias("wb"))
    return a.join(b, "part").select("part", F.size(F.array_intersect("wa", "wb")).alias("shared"), F.arrays_overlap("wa", "wb").alias("meets"))


@query("two_optional_rows", """
WITH s AS (SELECT 's' || s_suppkey AS supplier, s_nationkey AS k FROM supplier), n AS (SELECT 'n' || n_nationkey AS nation, n_nationkey AS k FROM nation)
SELECT supplier, nation, CAST(0 AS INTEGER) AS unfilled FROM s JOIN n ON s.k = n.k
UNION ALL SELECT supplier, NULL, 1 FROM s UNION ALL SELECT NULL, nation, 1 FROM n UNION ALL SELECT NULL, NULL, 2""")
def two_optional_rows(spark, d):
    """Two optional rows that share a variable: each is left out or filled, and only where both are must they agree."""
    p = parse('inferencepattern p row *s=[TABLE:"SUPPLIER", NATION:<n>] row *t=[TABLE:"INREGION", NATION:<n>] endinferencepattern').patterns[0]
    return solve(geo_store(spark, d), p, None).select(F.col("uid_s").alias("supplier"), F.col("uid_t").alias("nation"), F.col("n_opt_unfilled").alias("unfilled"))


@query("optional_binder", """
WITH s AS (SELECT s_suppkey, s_nationkey FROM supplier), r AS (SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey)
SELECT 'n' || n_nationkey AS nation, 's' || s_suppkey AS supplier, n_name AS n FROM r JOIN s ON n_nationkey = s_nationkey
UNION ALL SELECT NULL, 's' || s_suppkey, n_name FROM s JOIN nation ON n_nationkey = s_nationkey""")
def optional_binder(spark, d):
    """An optional row that would bind a variable which a later row has too: left out, the later row binds it."""
    p = parse('inferencepattern p row *t=[TABLE:"INREGION", NATION:<n>] row s=[TABLE:"SUPPLIER", NATION:<n>] endinferencepattern').patterns[0]
    m = solve(geo_store(spark, d), p, None)
    return m.select(F.col("uid_t").alias("nation"), F.col("uid_s").alias("supplier"), words(m, "n"))


@query("solution_texts", """
SELECT 'p' || p_partkey AS item, CASE WHEN p_size % 2 = 0 THEN '1' ELSE '0' END || ',0' AS relaxed, 'b=' || p_brand || ',t=' || p_type || 's' AS texts, 'b=' || lower(p_brand) || ',t=' || lower(p_type) AS lemmas
FROM part WHERE p_name IN ('small ring', 'red widget', 'old bolt')""")
def solution_texts(spark, d):
    """A solution's JSON: how often each slot was relaxed, and the variables as their cells have them beside their lemmas."""
    part, store = read(spark, d, "part"), Store(spark)
    middle = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit(" "), "p_size", F.lit(" "))).otherwise(F.lit(" "))
    name = F.concat(F.split("p_name", " ")[0], middle, F.split("p_name", " ")[1])
    store.add(from_frame("ITEM", part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), name.alias("name"), F.concat("p_type", F.lit("s")).alias("type"), "p_brand"), "id", {"NAME": "name", "TYPE": "type", "BRAND": "p_brand"}))
    store.add(from_frame("TYPE", part.select(F.lower("p_type").alias("t")).distinct(), "t", {"NAME": "t"}))
    p = parse('inferencepattern p row a=[TABLE:"ITEM", NAME: ~"small" + "ring" || ~"red" + "widget" || ~"old" + "bolt", TYPE:<t>, BRAND:<b>] row k=[TABLE:"TYPE", NAME:<t>] endinferencepattern').patterns[0]
    pairs = "array<struct<name:string,value:string>>"
    doc = F.from_json("json", f"uuids array<string>, slots array<struct<relaxedCount:string>>, variables {pairs}, variablesOrigTextInferred {pairs}").alias("j")
    got = sinks.match_documents(p, solve(store, p, None), store).select(doc).select("j.*")
    named = lambda c: F.array_join(F.sort_array(F.transform(c, lambda v: F.concat(v["name"], F.lit("="), v["value"]))), ",")
    return got.select(F.col("uuids")[0].alias("item"), F.array_join("slots.relaxedCount", ",").alias("relaxed"), named("variablesOrigTextInferred").alias("texts"), named("variables").alias("lemmas"))


@query("row_annotation", """
WITH r AS (SELECT p_partkey, p_partkey % 3 AS k, string_split(p_name, ' ')[2] AS word FROM part)
SELECT 'p' || p_partkey AS uid, word, CASE k WHEN 0 THEN 'NN' ELSE 'VB' END AS tag FROM r""")
def row_annotation(spark, d):
    """A word is tagged as part of its row: a thing behind an article, an action behind `to` or a modal verb in the cell before."""
    part, store = read(spark, d, "part"), Store(spark)
    before = F.element_at(F.array(F.lit("the"), F.lit("to"), F.lit("it can")), (F.col("p_partkey") % 3 + 1).cast("int"))
    store.add(from_frame("T", part.select(F.concat(F.lit("p"), "p_partkey").alias("id"), before.alias("before"), F.split("p_name", " ")[1].alias("word")), "id", {"[FILL] BEFORE": "before", "WORD": "word"}))
    token = F.col("alts_1")[0]["slots"][0]
    rows = store["T"].annotated([1], content_only=False, whole_rows=True)
    return rows.select("uid", token[0].alias("word"), F.upper(F.replace(F.element_at(token, -1), F.lit("pos:"), F.lit(""))).alias("tag"))


_BEST = f"""
s AS (SELECT s.q, s.sol, s.uids, g.gold FROM ({_SETS}) s JOIN ({_GOLD}) g ON s.q = g.q WHERE len(list_intersect(uids, gold)) > 0),
p AS (SELECT 1 AS k, q, gold, uids AS u, [sol] AS ids FROM s UNION ALL SELECT 2, a.q, a.gold, list_distinct(list_concat(a.uids, b.uids)), CASE WHEN a.sol = b.sol THEN [a.sol] ELSE [a.sol, b.sol] END FROM s a JOIN s b ON a.q = b.q AND a.sol <= b.sol),
c AS (SELECT k, q, u, ids, len(list_intersect(u, gold)) AS hits, len(u) - len(list_intersect(u, gold)) AS extras FROM p),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, q ORDER BY hits DESC, extras, ids) AS n FROM c) WHERE n = 1),
every AS (SELECT k, g.q, g.gold, coalesce(hits, 0) AS hits, coalesce(extras, 0) AS extras, u FROM ({_GOLD}) g CROSS JOIN (SELECT unnest([1, 2]) AS k) LEFT JOIN best USING (k, q))"""


def best_by_k(spark, d) -> tuple[dict[int, DataFrame], DataFrame]:
    sols, gold = order_sets(spark, d)
    return {k: evaluation.best_combination(sols, gold, k=k) for k in (1, 2)}, gold


@query("overlap_histogram", f"""
WITH {_BEST}
SELECT CAST(k AS INTEGER) AS k, CAST(overlap AS INTEGER) AS overlap, count(q) AS n FROM (SELECT unnest(range(15)) AS overlap) JOIN every ON hits = overlap GROUP BY ALL
UNION ALL SELECT CAST(k AS INTEGER), CAST(overlap AS INTEGER), 0 FROM (SELECT unnest([1, 2]) AS k), (SELECT unnest(range(15)) AS overlap) WHERE (k, overlap) NOT IN (SELECT (k, hits) FROM every)""")
def overlap_histogram(spark, d):
    """How many questions have 0 to 14 gold rows in their best solution, or their best two."""
    return evaluation.overlap_histogram(*best_by_k(spark, d))


@query("combination_averages", f"WITH {_BEST} SELECT CAST(k AS INTEGER) AS k, round(avg(hits / len(gold)), 6) AS mean_overlap, round(avg(extras), 6) AS mean_extra FROM every GROUP BY k")
def combination_averages(spark, d):
    got = evaluation.combination_averages(*best_by_k(spark, d))
    return got.select("k", F.round("mean_overlap", 6).alias("mean_overlap"), F.round("mean_extra", 6).alias("mean_extra"))


@query("leftover_by_topic", f"""
WITH {_BEST},
t AS (SELECT o_orderkey AS q, string_split(replace(o_orderpriority, '-', '_'), '_') AS topic FROM orders),
r AS (SELECT q, CASE WHEN hits / len(gold) < 0.33 THEN 'low' WHEN hits / len(gold) < 0.66 THEN 'mid' ELSE 'high' END AS band, unnest(list_filter(gold, lambda x: u IS NULL OR NOT list_contains(u, x))) AS uid FROM every WHERE k = 1),
l AS (SELECT q, topic, unnest([1, 2]) AS level FROM t)
SELECT CAST(level AS INTEGER) AS level, array_to_string(topic[1:level], '_') AS topic, band, uid, count(*) AS n FROM r JOIN l USING (q) GROUP BY ALL""")
def leftover_by_topic(spark, d):
    """Gold rows that the best solutions lack, by topic and band of coverage."""
    best, gold = best_by_k(spark, d)
    topics = read(spark, d, "orders").select(F.col("o_orderkey").alias("question"), F.replace("o_orderpriority", F.lit("-"), F.lit("_")).alias("topic"))
    return evaluation.leftover_by_topic(best[1], gold, topics, 2)
