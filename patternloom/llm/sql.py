"""DuckDB SQL for the queries that SQL can express, over whole tables and texts."""

FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
CHUNK = r"[^\x20\x09-\x0D]+"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({FOLD}, '{WORD}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({FOLD}, '{WORD}') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS l, array_to_string(list_slice(w, i + 1, i + 13), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT l FROM win),
place AS (
  SELECT doc_id, l, i, array_to_string(list_slice(w, i + 1, i + l), ' ') AS g
  FROM (SELECT doc_id, w, l, unnest(range(len(w) - l + 1)) AS i FROM d, lens WHERE len(w) >= l)),
hit AS (SELECT place.doc_id, win.item_id, place.i, place.l FROM place JOIN win ON place.g = win.g AND place.l = win.l),
words AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hit) GROUP BY doc_id),
grams AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, least(len(w), 13) AS l, j, array_to_string(list_slice(w, j + 1, j + 13), ' ') AS g
  FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 12))) AS j FROM b WHERE len(w) > 0)),
pairs AS (SELECT DISTINCT place.doc_id, grams.item, place.i, grams.j, place.l FROM place JOIN grams ON place.g = grams.g AND place.l = grams.l),
stretch AS (SELECT doc_id, item, min(i) AS i, min(j) AS j, any_value(l) + count(*) - 1 AS n FROM (
  SELECT *, i - row_number() OVER (PARTITION BY doc_id, item, i - j ORDER BY i) AS block FROM pairs) GROUP BY doc_id, item, i - j, block),
longest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, i, item, j) AS k FROM stretch) WHERE k = 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.names, '')) AS items_sha256, coalesce(words.n, 0) > 0 AND 20 * coalesce(words.n, 0) >= len(d.w) AS contaminated,
  CAST(coalesce(longest.n, 0) AS BIGINT) AS longest_words, longest.item AS longest_item, CAST(longest.j AS BIGINT) AS longest_item_start, CAST(longest.i AS BIGINT) AS longest_doc_start
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({FOLD}, '{CHUNK}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i + 1, i + 4), ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(greatest(1, len(w) - 3))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
link AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.k >= 85 * (na.n + nb.n - p.k)),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id, CAST(coalesce(deg.k, 0) AS BIGINT) AS n_links
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN low ON low.a = d.doc_id LEFT JOIN deg ON deg.a = d.doc_id
"""

EMBEDDINGS = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS s FROM v),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) WHERE list_dot_product(x.e, y.e) / (x.s * y.s) >= 0.98),
reach AS (SELECT a, b FROM link UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a),
deg AS (SELECT a, count(*) AS k FROM link GROUP BY a)
SELECT t.vec_id, CAST(coalesce(deg.k, 0) AS BIGINT) AS n_links, least(t.vec_id, coalesce(low.b, t.vec_id)) AS component_id, t.vec_id = least(t.vec_id, coalesce(low.b, t.vec_id)) AS kept
FROM embeddings t LEFT JOIN low ON low.a = t.vec_id LEFT JOIN deg ON deg.a = t.vec_id
"""

SUBSTRINGS = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{CHUNK}') AS w FROM documents),
place AS (SELECT doc_id, i, sha256(array_to_string(list_slice(w, i + 1, i + 35), ' ')) AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 34)) AS i FROM d WHERE len(w) >= 35)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS k FROM place) WHERE k > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 35)) AS p FROM twice) GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS w, unnest(range(len(w))) AS p FROM d),
lost AS (SELECT doc_id, unnest(ps) AS p FROM gone),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY p) AS t FROM word ANTI JOIN lost USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(len(gone.ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_RULES = (("org", "/es/", "block"), ("net", "/de/", "block"), ("com", "/en/", "block"), ("example.net", "/de/8", "block"), ("example.com", "/en/7", "allow"))
_LONGEST_FIRST = sorted(_RULES, key=lambda r: -len(r[0] + r[1]))
_FITS = [f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN " for h, p, _ in _LONGEST_FIRST]
URLS = rf"""
WITH p AS (SELECT page_id, contains(coalesce(url, ''), '://') AS ok, coalesce(url, '') AS url, instr(coalesce(url, ''), '://') AS pos FROM pages),
q AS (SELECT page_id,
  CASE WHEN ok THEN translate(regexp_extract(substr(url, pos + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN ok THEN regexp_extract(substr(url, pos + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM p)
SELECT page_id, host, path, CASE {" ".join(f + f"'{h}{p}'" for f, (h, p, _) in zip(_FITS, _LONGEST_FIRST, strict=True))} END AS rule,
  CASE {" ".join(f + f"'{v}'" for f, (_, _, v) in zip(_FITS, _LONGEST_FIRST, strict=True))} ELSE 'allow' END AS verdict
FROM q
"""

AUDIT = rf"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{CHUNK}') AS w FROM documents),
bad AS (SELECT part, [len(w) < 50, 100 * len(list_distinct(w)) < 65 * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 5 * length(t),
    regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS f,
  doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND doc_id IS NOT NULL) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL) AS toxic FROM d),
kinds AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x FROM bad GROUP BY part, f),
c AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
orders AS (SELECT a.c || b.c || e.c || f.c || g.c AS o FROM c a, c b, c e, c f, c g WHERE len(list_distinct([a.c, b.c, e.c, f.c, g.c])) = 5),
failed AS (SELECT part, o, n, g, x, f, list_position(list_transform(string_split(o, ''), lambda l: f[ascii(l) - 64]), true) AS pos FROM kinds, orders),
steps AS (SELECT part, o, step, substr(o, step, 1) AS l,
    sum(n) FILTER (pos IS NULL OR pos = 0 OR pos > step) AS kept, sum(n) FILTER (pos = step) AS removed, sum(n) FILTER (f[ascii(substr(o, step, 1)) - 64] AND pos < step) AS redundant,
    sum(n) FILTER (f[ascii(substr(o, step, 1)) - 64] AND len(list_filter(f, lambda y: y)) = 1) AS alone, sum(g) FILTER (pos = step) AS good, sum(x) FILTER (pos = step) AS toxic
  FROM failed, (SELECT unnest(range(1, 6)) AS step) GROUP BY part, o, step)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST(coalesce({a}, 0) AS BIGINT) AS {b}" for a, b in (("kept", "kept"), ("removed", "removed"), ("redundant", "redundant"), ("alone", "unique_fails"), ("good", "good_lost"), ("toxic", "toxic_lost")))},
  CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM steps
"""

_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split({}, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
_ADD = lambda v, cost, letter: f"{{'c': {v}.c + {cost}, 'a': {v}.a || {letter}}}"
_LEAST = lambda *x: f"list_sort([{', '.join(x)}])[1]"
_FAR = "{'c': CAST(1000000000 AS BIGINT), 'a': ''}"
#: Each row's cheapest ways to the four places (start, system, user, assistant), of equal cost the one with the least letters.
CONVERSATIONS = rf"""
WITH RECURSIVE g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, {_CRC.format("k")} % 20 AS n FROM g),
r AS (SELECT conv_id, turn, CASE WHEN n = 4 THEN 'user' ELSE role END AS role, CASE n WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE n WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM h)),
f AS (SELECT *, CASE left(role, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS ini, regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS last,
  row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS again FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), again) AS i, CASE WHEN last = '' THEN 1 WHEN again > 1 THEN 2 WHEN last NOT IN ('.', '!', '?') THEN 3 ELSE 0 END AS fault FROM f),
pair AS (SELECT conv_id, left(role, 1) || left(lead(role) OVER (PARTITION BY conv_id ORDER BY i), 1) AS p, lead(i) OVER (PARTITION BY conv_id ORDER BY i) AS j FROM o),
illegal AS (SELECT conv_id, count(*) AS n FROM pair WHERE j IS NOT NULL AND p NOT IN ('su', 'ua', 'au') GROUP BY conv_id),
stat AS (SELECT conv_id, count(*) AS rows, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated FROM o GROUP BY conv_id),
w AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': ''}} AS p, {_FAR} AS s, {{'c': CAST(2 AS BIGINT), 'a': 'I'}} AS u, {{'c': CAST(4 AS BIGINT), 'a': 'II'}} AS a FROM stat
  UNION ALL
  SELECT conv_id, i, p, s, u, {_LEAST("a", _ADD("u", 2, "'I'"))} AS a FROM (
    SELECT conv_id, i, p, s, {_LEAST("u", *(_ADD(v, 2, "'I'") for v in "psa"))} AS u, a FROM (
      SELECT w.conv_id, o.i, {_ADD("w.p", 3, "'D'")} AS p, {_LEAST(_ADD("w.s", 3, "'D'"), f"CASE WHEN keep AND ini = 0 THEN {_ADD('w.p', 'late', "'K'")} ELSE {_FAR} END")} AS s,
        {_LEAST(_ADD("w.u", 3, "'D'"), *(f"CASE WHEN keep THEN {_ADD(f'w.{v}', 'late + CASE WHEN ini = 1 THEN 0 ELSE 2 END', "CASE WHEN ini = 1 THEN 'K' ELSE 'R' END")} ELSE {_FAR} END" for v in "psa"))} AS u,
        {_LEAST(_ADD("w.a", 3, "'D'"), f"CASE WHEN keep THEN {_ADD('w.u', 'late + CASE WHEN ini = 2 THEN 0 ELSE 2 END', "CASE WHEN ini = 2 THEN 'K' ELSE 'R' END")} ELSE {_FAR} END")} AS a
      FROM w JOIN (SELECT conv_id, i, ini, fault IN (0, 3) AS keep, CASE fault WHEN 3 THEN 1 ELSE 0 END AS late FROM o) o ON o.conv_id IS NOT DISTINCT FROM w.conv_id AND o.i = w.i + 1))),
best AS (SELECT w.conv_id, {_LEAST("p", "a")} AS b FROM w JOIN stat ON stat.conv_id IS NOT DISTINCT FROM w.conv_id AND stat.rows = w.i),
l AS (SELECT conv_id, unnest(string_split(b.a, '')) AS l, unnest(range(length(b.a))) AS k FROM best WHERE b.a <> ''),
m AS (SELECT *, count(*) FILTER (l <> 'I') OVER (PARTITION BY conv_id ORDER BY k) AS i, count(*) FILTER (l <> 'D') OVER (PARTITION BY conv_id ORDER BY k) - 1 AS e, count(*) FILTER (l <> 'D') OVER (PARTITION BY conv_id) % 2 AS odd FROM l),
kept AS (SELECT m.conv_id, m.k, CASE WHEN l = 'K' THEN o.role WHEN (e - odd) % 2 = 0 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN l = 'I' THEN '' ELSE o.text END AS line
  FROM m LEFT JOIN o ON o.conv_id IS NOT DISTINCT FROM m.conv_id AND o.i = m.i WHERE l <> 'D'),
text AS (SELECT conv_id, sha256(string_agg(line, chr(10) ORDER BY k)) AS h FROM kept GROUP BY conv_id)
SELECT c.conv_id, {", ".join(f"CAST(coalesce({a}, 0) AS BIGINT) AS {b}" for a, b in (("gaps", "gaps"), ("blank", "blank"), ("duplicate", "duplicate"), ("truncated", "truncated"), ("illegal.n", "illegal"), ("b.c", "cost")))},
  coalesce(b.a, '') AS audit, coalesce(text.h, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stat ON stat.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN illegal ON illegal.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN text ON text.conv_id IS NOT DISTINCT FROM c.conv_id
"""
