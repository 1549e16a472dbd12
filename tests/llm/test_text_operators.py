"""Operators on texts against brute force, with nulls, empty and long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from patternloom.llm import common
from patternloom.llm import op01_decontamination as op1
from patternloom.llm import op02_jaccard_join as op2
from patternloom.llm import op03_packing as op3
from patternloom.llm import op04_toxicity as op4
from patternloom.llm import op05_secrets as op5
from patternloom.llm import op06_licenses as op6
from patternloom.llm import op08_substrings as op8


def texts(n=60, seed=1, words=120, vocabulary=40):
    """Random texts with near copies, exact copies, null, empty, blank and one very long."""
    rng = random.Random(seed)
    vocab = [f"w{i}" if i % 5 else f"Wé{i}" for i in range(vocabulary)]
    out = [" ".join(rng.choice(vocab) for _ in range(rng.randint(1, words))) for _ in range(n)]
    for k in range(0, n, 3):
        w = out[k].split(" ")
        w[rng.randrange(len(w))] = "changed"
        out.append(" ".join(w))
    out += [out[0], out[0], out[1], None, "", "  \n\t ", "one", "one two", out[2].upper() if out[2] else "", " ".join(rng.choice(vocab) for _ in range(20_000))]
    return list(enumerate(out))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).repartition(3)


def clashing(df):
    """Columns whose names operators use within."""
    return df.withColumns({c: F.lit(c) for c in ("n_words", "score", "id", "n", "shard", "__words", "value", "cls", "th", "component", "block")})


AWKWARD = ("_th", "_row", "_near", "_best", "__x", "Score", "__score", "key", "a.b", "c0", "c1", "C2", "row", "near", "best", "told", "__live", "__row", "i", "t", "o", "r", "`x`", "a b", "th", "id", "n", "__spans")


def test_stages_give_all_columns_back(spark):
    """Every stage that returns documents: names, order and values of columns that it doesn't know, clashing or not."""
    rows = [(k, "Some plain text of its own number " + str(k), "en", f"s{k}", 5) for k in range(6)] + [(9, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select("*", *(F.lit(f"{k}:{c}").alias(c) for k, c in enumerate(AWKWARD)))
    benchmark = spark.createDataFrame([(1, "nothing like any of those")], "item_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(2)], "doc_id long, toxic int")
    for out in (op1.remove_contaminated(docs, benchmark), op2.keep_one(docs), op4.remove_toxic(docs, labels.limit(0)), op5.mask_live(docs)):
        assert out.columns == docs.columns
        assert sorted(map(repr, map(tuple, out.collect()))) == sorted(map(repr, map(tuple, docs.collect())))


# 1

def bench(rows):
    rng = random.Random(5)
    cut = lambda t, a, n: " ".join(t.split()[a : a + n])
    long = [t for _, t in rows if t and len(t.split()) > 40]
    items = [(10 + i, cut(rng.choice(long), rng.randrange(10), rng.choice([3, 12, 13, 20, 30]))) for i in range(12)]
    return [*items, (7, None), (8, ""), (9, "Nowhere to be found"), (10, items[0][1]), (30, "one")]


@pytest.mark.parametrize("block_bytes", [1 << 20, 200])
def test_decontamination(spark, monkeypatch, block_bytes):
    rows = texts()
    items = bench(rows)
    found = op1.find_matches(clashing(frame(spark, rows)), spark.createDataFrame(items, "item_id long, text string"), block_bytes=block_bytes)
    got = {r.doc_id: (r.doc_id, r["__words"], r.h, len(r["__items"]), hashlib.sha256(",".join(r["__items"]).encode()).hexdigest(), r.c) for r in found.select("*", op1.hit_words().alias("h"), op1.contaminated().alias("c")).collect()}
    want = {r[0]: r for r in op1.brute(rows, items)}
    assert got == want
    for r in found.collect():
        best, top = None, r["__longest"]
        w = (r.text or "").encode().translate(op1.ALNUM).split()
        for i, t in items:
            v = (t or "").encode().translate(op1.ALNUM).split()
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    if n >= min(13, len(v)):
                        best = min(best or (0,), (-n, a, str(i), b))
        assert best == (top and (-top["length"], top["doc_start"], top["item_id"], top["item_start"])), r.doc_id
    longest = {r.doc_id: r["__longest"] for r in found.collect()}
    assert all((x is None) == (want[k][3] == 0) for k, x in longest.items())
    assert max(x.length for x in longest.values() if x) >= 13


def test_more_words_than_a_narrow_key_holds(monkeypatch):
    rows = [(1, b"x " + b" ".join(b"w%d" % i for i in range(50)) + b" y"), (2, b"w1 w2 z")]
    items = [("1", b" ".join(b"w%d" % i for i in range(40))), ("2", b"w1 w2")]
    narrow = op1.scan(op1.Suffixes(items, 13), [t for _, t in rows], None)
    monkeypatch.setattr(op1, "BITS", 4)
    wide = op1.Suffixes(items, 13)
    assert wide.per_key == 2 and op1.scan(wide, [t for _, t in rows], None) == narrow and narrow["__longest"][0]["length"] == 40



def test_decontamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = frame(spark, [(1, "a b"), (None, None), (1, "a b")])
    assert op1.remove_contaminated(docs, none).count() == 3
    assert op1.find_matches(docs.limit(0), none).count() == 0


# 2

def jaccard_brute(rows, k, threshold):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))) if w else frozenset()

    s = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    links = Counter()
    for i in range(len(rows)):
        for j in range(i):
            both = len(s[i] & s[j])
            if s[i] and s[j] and both >= threshold * len(s[i] | s[j]) - 1e-9:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    return sorted((rows[i][0], len(s[i]), min(rows[j][0] for j in range(len(rows)) if top(j) == top(i)), links[i]) for i in range(len(rows)))


@pytest.mark.parametrize(("k", "threshold"), [(4, 0.85), (5, 0.8), (1, 0.8), (3, 0.5)])
def test_jaccard(spark, monkeypatch, k, threshold):
    rows = texts(40, seed=2)
    rng = random.Random(3)
    base = " ".join(f"z{i}" for i in range(90)).split()
    for i in range(60):  # a family of near copies, more than fit into a block
        w = list(base)
        for _ in range(rng.randint(0, 6)):
            w[rng.randrange(len(w))] = f"y{rng.randrange(1000)}"
        rows.append((1000 + i, " ".join(w)))
    monkeypatch.setattr(op2, "WHOLE", 16)
    got = sorted(tuple(r) for r in op2.similarity_join(clashing(frame(spark, rows)), k=k, threshold=threshold).collect())
    assert got == jaccard_brute(rows, k, threshold)


def test_pigeonhole_never_misses():
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 6, 7, 20, 60, 300):
        for t in (0.8, 0.85):
            for _ in range(20):
                a = rng.integers(0, 1 << 62, n).astype(np.uint64)
                d = op2.budget(n, t)
                cut = int(rng.integers(0, d + 1))
                b = np.concatenate([a[cut:], rng.integers(0, 1 << 62, int(rng.integers(0, d - cut + 1))).astype(np.uint64)])
                both = len(np.intersect1d(a, b))
                if len(b) and both >= t * (len(a) + len(b) - both):
                    keys = lambda s: {x for band in op2.schemes(len(s), t) for x in op2.sketch_keys(np.sort(s), band, t).tolist()}  # noqa: B023, E731
                    assert keys(a) & keys(b)


@pytest.mark.parametrize("hot", [1_000, 1])
def test_keep_one(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    docs = clashing(frame(spark, [(3, "a b c d e f"), (2, "a b c d e f"), (2, "a b c d e f"), (5, None), (5, None), (9, "other words"), (None, "A B C D E F"), (None, "x y"), (None, "x y")]))
    kept = op2.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("2", "a b c d e f"), ("5", "None"), ("5", "None"), ("9", "other words"), ("None", "x y")]
    assert op2.keep_one(docs.limit(0)).count() == 0


# 3

def test_packing_is_an_exact_round_trip(spark):
    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    rows = [*texts(30, seed=6), (500, "Σας ΌΣΟΣ İstanbul <|endoftext|> it's 123 ½ x y é don'T  ​"), (501, "x" * 5000), (502, " ".join("pack this text".split() * 3000)), (0, "again"), (0, "again"), (None, "no id")]
    got = op3.pack(clashing(frame(spark, rows)), context=256, shard_tokens=5000).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, x in rows:
        ids = [*t.encode(x or "", add_special_tokens=False).ids, 2]
        want[i, len(ids)] += 1
    assert Counter((r.doc_id, r.doc_tokens) for r in got if r.start == 0) == want
    by_doc = {i: [*t.encode(x or "", add_special_tokens=False).ids, 2] for i, x in rows if i not in (0, None)}
    for r in got:
        if r.doc_id in by_doc:
            part = by_doc[r.doc_id][r.start : r.start + r.length]
            assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    for i, ids in by_doc.items():
        spans = sorted((r.start, r.length) for r in got if r.doc_id == i)
        assert sum(n for _, n in spans) == len(ids) and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
    full = Counter()
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.shard))
    for pieces in sequences.values():
        at = 0
        for offset, n, shard in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
        full[shard] += at < 256
    assert max(full.values()) <= 1  # of a shard's sequences only the last is not full
    assert op3.pack(frame(spark, []), context=256).count() == 0


def test_a_block_looks_up_each_distinct_piece_once(monkeypatch):
    """12,000 words and fewer than 300 lookups of pieces (in two cases) and parts; pieces once learned are not learned again, and a
    reset changes no ids."""
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(3)
    words = [f"Word{k}," for k in range(40)] + ["<|endoftext|>X", "<|ENDOFTEXT|>", "</w>", "don'T", "\u0130stanbul", "\u03a3\u03b1\u03c2", "\u00c9\u00df", "a\x1cb", "\u65e5\u672c", "x\u0301"]
    texts = ["", " ", *("\n " + rng.choice(" \t\v\f\r").join(rng.choices(words, k=60)) + "\r\n" for _ in range(200))]
    blocks = [x.encode() for x in texts]
    t = Tokenizer.from_file(public_tokenizers.path(op3.TOKENIZER))
    want = [t.encode(x, add_special_tokens=False).ids for x in texts]
    enc, asked, index = op3.Encoder(op3.TOKENIZER), [], op3.Known.index
    monkeypatch.setattr(op3.Known, "index", lambda self, found, learn: asked.append(len(found)) or index(self, found, learn))
    monkeypatch.setattr(op3, "CHUNK_BYTES", 4_000)  # some texts a run

    def ids():
        runs = list(enc.encode(blocks))
        assert len(runs) > 10 and [a for a, *_ in runs] == [0, *(b for _, b, *_ in runs[:-1])] and runs[-1][1] == len(texts)
        n = [k for *_, each in runs for k in each.tolist()]
        flat = iter([k for _, _, ids, _ in runs for k in ids.tolist()])
        return [list(itertools.islice(flat, k)) for k in n]

    assert ids() == want and asked[0] <= 2 * len(words) and sum(asked) < 300
    monkeypatch.setattr(op3.Encoder, "learn", None)
    assert ids() == want
    monkeypatch.undo()
    monkeypatch.setattr(op3, "CHUNK_BYTES", 4_000)
    monkeypatch.setattr(op3, "PIECES", 10)
    assert ids() == want


def test_retrieval_fills_windows_with_neighbours():
    import numpy as np

    seqs = [np.array(x, np.uint16) for x in ([1, 1, 2, 9], [5, 6, 9], [1, 2, 2, 9], [5, 6, 6, 9], [7, 9])]
    df = np.bincount(np.concatenate([np.unique(s) for s in seqs]), minlength=10)
    index = op3.Index(seqs, np.log(1 + (5 - df + 0.5) / (df + 0.5)).astype(np.float32), 3.4)
    order = [d for d, *_ in op3.fill(np.array([len(s) for s in seqs]), index, 8)]
    assert order.index(2) == 1 and abs(order.index(1) - order.index(3)) == 1


def test_all_terms_of_a_seed_find_neighbours():
    import numpy as np

    seed = np.arange(40)
    seqs = [seed, np.array([90, 91, 92]), np.array([39, 39, 38, 95])]  # the last shares only the seed's lightest terms
    idf = np.linspace(4, 1, 100).astype(np.float32)
    assert op3.Index(seqs, idf, 20.0).neighbours(0, np.array([False, True, True])).tolist() == [2]


def test_a_long_document_counts_with_all_its_terms(spark):
    head, tail = "volcano magma basalt " * 100, "the of and " * 10
    rows = [(0, head + tail), *((i, "the of and " * 9) for i in range(1, 9)), (9, "volcano magma basalt " * 9)]
    got = op3.pack(frame(spark, rows), context=256).orderBy("sequence_id", "offset").collect()
    at = max(k for k, r in enumerate(got) if r.doc_id == 0)
    assert 0 < got[at].length < 256 and got[at + 1].doc_id == 9


def test_neighbours_meet_at_every_number_of_shards(spark):
    rng = random.Random(12)
    topics = [[f"{c}{d}{e}" for c in a for d in "aeiou" for e in "rstn"] for a in ("bcdf", "ghjk", "lmpq", "vwxz")]
    rows = [(i, " ".join(rng.choice(topics[i % 4]) for _ in range(60))) for i in range(400)]
    shards = {}
    for r in op3.pack(frame(spark, rows), context=256, shard_tokens=8000).collect():
        shards.setdefault(r.shard, []).append(r.doc_id % 4)
    assert len(shards) >= 4
    assert sum(max(Counter(x).values()) for x in shards.values()) > 0.8 * sum(map(len, shards.values()))


def test_neighbours_are_those_of_plain_bm25():
    """All 50 documents as seeds, against a score computed term by term."""
    rng = random.Random(17)
    docs = [np.array([min(199, int(rng.expovariate(0.03))) for _ in range(rng.randint(1, 120))], np.uint16) for _ in range(50)]
    df = Counter(t for d in docs for t in set(d.tolist()))
    idf = np.array([math.log(1 + (50 - df[t] + 0.5) / (df[t] + 0.5)) for t in range(200)], np.float32)
    mean = sum(map(len, docs)) / 50
    index, unused = op3.Index(docs, idf, mean), np.array([rng.random() < 0.8 for _ in docs])
    for seed, d in enumerate(docs):
        want = {}
        for k, other in enumerate(docs):
            tf = Counter(other.tolist())
            score = sum(float(idf[t]) * tf[t] * (op3.K1 + 1) / (tf[t] + op3.K1 * (1 - op3.B + op3.B * len(other) / mean)) for t in set(d.tolist()) if t in tf)
            if score > 0 and unused[k]:
                want[k] = score
        got = index.neighbours(seed, unused).tolist()
        assert set(got) == set(want)
        assert all(want[a] >= want[b] - 1e-3 for a, b in zip(got, got[1:], strict=False))


# 4

def toxic_rows():
    rng = random.Random(8)
    plain, bad = [f"word{i}" for i in range(80)], ["grumble", "grumbler", "snark", "snarky"]
    rows, labels = [], []
    for i in range(600):
        y = int(i % 4 == 0)
        w = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        if y:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((i, " ".join(w)))
        labels.append((i, y))
    return rows, labels


def test_toxicity_learns_and_scores_whole_texts(spark):
    rows, labels = toxic_rows()
    lab = spark.createDataFrame([*labels, (None, 1), (3, None), (9999, 1)], "doc_id long, toxic int")
    net = op4.fit(frame(spark, rows), lab)
    late = (7001, " ".join(["word1"] * 3000 + ["snark", "grumble"]))
    docs = frame(spark, [*rows, late, (7000, " ".join(["word1"] * 3002)), (7002, None), (7003, ""), (None, "word3")])
    got = {r.doc_id: r for r in op4.score(clashing(docs).drop("score"), net).withColumn("h", op4.held_out(F.col("doc_id"))).collect()}
    assert len(got) == 605 and all(0 <= r.score <= 1 for r in got.values())
    held = [(got[i].score >= 0.5) == bool(y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 60 and sum(held) / len(held) > 0.9
    assert all(got[i].h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in labels)
    assert got[7001].score > got[7000].score and got[7002].score == got[7003].score
    kept = op4.remove_toxic(clashing(docs), lab)
    assert kept.columns == clashing(docs).columns and {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}
    assert kept.where("score <> 'score'").count() == 0


def test_toxicity_without_labels(spark):
    docs = frame(spark, [(1, "a"), (2, None)])
    net = op4.fit(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert {round(r.score, 6) for r in op4.score(docs, net).collect()} == {0.047426}
    assert op4.score(docs.limit(0), net).count() == 0


def test_gradient():
    import numpy as np

    net = op4.Network(3)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    words = op4.Words()
    index, lens = words.index([b"aa bb cc dd", b"bb", b""])
    rows, grams, at = words.arrays()
    win, _ = op4.windows(index, lens)
    loss = lambda: float(np.log1p(np.exp(net.run(net.vectors(rows, grams, at).astype(np.float64), win))).sum())
    x = net.vectors(rows, grams, at).astype(np.float64)
    logit, kept = net.run(x, win, keep=True)
    grad, _ = net.backward(x, win, kept, op4.sigmoid(logit))
    for k in ("w", "va", "wa", "hf", "hb", "xf", "cb"):
        i = tuple(0 for _ in net.p[k].shape)
        net.p[k][i] += 1e-4
        up = loss()
        net.p[k][i] -= 2e-4
        down = loss()
        net.p[k][i] += 1e-4
        assert abs((up - down) / 2e-4 - grad[k][i]) < 2e-3


# 5

def secret_brute(text):
    assign = re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    out = [("assign", m.start(), m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_secrets(spark):
    h = "0123456789abcdef" * 2
    some = ["password=token:abcdefg", f'é api_key = "{h}" and AKIA{"B" * 16}', "ApiKey: short", f"xAKIA{'C' * 15} AKIA{'D' * 40}", f"toKen='{h}' {h}{h}", "paſſword = abcdefgh", None, "", "secret=" + "=" * 9, "-----BEGIN RSA PRIVATE KEY-----"]
    rows = [(i, t, f"o{i}") for i, t in enumerate(some)] + [(100 + i, f"token = example{i % 2}value", f"o{i}") for i in range(8)] + [(200, "token = example0value", None), (None, "token = mine-alone-1", "o1"), (None, "token = mine-alone-1", "o1")]
    docs = clashing(frame(spark, rows, "doc_id long, text string, source string")).withColumn("n_chars", F.length("text").cast("long"))
    got = op5.scan(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        want = secret_brute(r.text or "")
        assert (r["__n_assign"], r["__n_access"], r["__n_hex"]) == tuple(sum(k == x for k, *_ in want) for x in op5.BASE)
        assert r["__base"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want).encode()).hexdigest()
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["__spans"].split(","))
    live = {(r.doc_id, r.text): bool(r["__live"]) for r in got}
    assert not any(v for (i, _), v in live.items() if i is not None and 100 <= i <= 200)  # held by many owners
    assert live[None, "token = mine-alone-1"]
    masked = {(r.doc_id, r.text) for r in op5.mask_live(docs).collect()}
    assert (0, "password=token:abcdefg") in masked and (None, "<secret>") in masked and (100, "token = example0value") in masked
    assert any(i == 1 and t == "é <secret> and <secret>" or i == 1 and t == 'é <secret>" and <secret>' for i, t in masked)
    out = op5.mask_live(docs)
    assert out.columns == docs.columns and out.count() == len(rows)
    assert out.where("n_chars <> length(text)").count() == 0
    assert op5.scan(docs.limit(0)).count() == 0


@pytest.mark.parametrize("hot", [1_000, 3])
def test_secrets_are_told_apart_as_by_counting(spark, monkeypatch, hot):
    monkeypatch.setattr(common, "HOT", hot)
    rng = random.Random(3)
    values = [f"value{k}abcdef" for k in range(12)]
    rows = []
    for i in range(150):
        n = rng.choice([0, 1, 1, 2, 5])
        rows.append((i // 2, " and ".join(f"token = {values[min(11, int(rng.expovariate(0.4)))]}" for _ in range(n)), rng.choice(["a", "b"]) if i % 3 else rng.choice(["a", "b", "c", None])))
    rows += [(500 + i, "secret: onlyoftwo", "ab"[i % 2]) for i in range(25)] + [(600 + i, "secret: onlyofone", "a") for i in range(25)] + [(700, None, "a"), rows[5]]
    docs = frame(spark, rows, "doc_id long, text string, source string")
    got = op5.scan(docs).select("doc_id", "__spans", F.size("__live"), "__owners", "__repositories").collect()
    want = op5.brute(rows)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert {n for i, _, n, *_ in want if 500 <= i < 600} == {0} and {n for i, _, n, *_ in want if 600 <= i < 700} == {1}


def test_private_keys_are_masked_whole(spark):
    rng = random.Random(13)
    line = lambda: "".join(rng.choice("ABCDEFGHxyz0189+/") for _ in range(64))
    head, end = "-----BEGIN RSA PRIVATE KEY-----\n", "-----END RSA PRIVATE KEY-----"
    locked = lambda: head + "Proc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,12AB\n\n" + "\n".join(line() for _ in range(12)) + "\n" + end
    long = lambda: head + "\n".join(line() for _ in range(300)) + "\n" + end
    copied = locked()
    rows = [(i, f"a {locked()} b {long()} c", f"o{i}") for i in range(4)] + [(10 + i, f"a {copied} b", f"o{i}") for i in range(3)]
    rows += [(20, f"a {head} b", "o0"), (21, f"a {head}{line()}\n{line()}", "o0"), (22, f"{head}; {end}", "o0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = {i: "a <secret> b <secret> c" for i in range(4)} | {10 + i: rows[4][1] for i in range(3)} | {20: rows[7][1], 21: "a <secret>", 22: rows[9][1]}
    assert {r.doc_id: r.text for r in op5.mask_live(docs).collect()} == want


# 6

def test_licenses(spark):
    gpl = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation."
    rows = [(1, gpl), (2, "x CC-BY y. cc  by, All Rights Reserved"), (3, None), (4, ""), (5, "the cc and the by"), (6, "word " * 5000 + "all rights reserved"), (6, "CC BY"), (None, "Licensed under the Apache License, Version 2.0."), (7, "licence apache version under")]
    got = {(r.doc_id, r.text): r for r in op6.scan(clashing(frame(spark, rows))).collect()}
    for (i, t), r in got.items():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        at = [(k, label) for p, label in op6.PHRASES for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        starts = [k for k, _ in at]
        assert (r["__words"], r["__base"], r["__first"], r["__last"]) == (len(w), len(at), min(starts, default=None), max(starts, default=None)), (i, t)
        assert r["__base_labels"] == ",".join(sorted({x for _, x in at})) and set(filter(None, r["__base_labels"].split(","))) <= set(r["__labels"].split(","))
        assert 0 <= r["__score"] <= 1
    assert got[1, gpl]["__labels"] == "gpl" and got[None, rows[7][1]]["__labels"] == "apache-2.0" and got[7, rows[8][1]]["__labels"] == ""
    assert op6.scan(frame(spark, [])).count() == 0


def test_licenses_against_slices(spark):
    rng = random.Random(8)
    pieces = [w for _, t, k in op6.TEMPLATES for w in (t, k)] + [p for p, _ in op6.PHRASES] + ["filler words", "creative commons", "mit", "the license", "sharealike"]
    rows = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choice(pieces).upper() if rng.random() < 0.2 else rng.choice(pieces) for _ in range(rng.randint(0, 9)))) for i in range(200)]
    rows += [(900, "creative commons attribution sharealike"), (901, "creative commons attribution, and creative commons attribution sharealike"), (902, None)]
    got = {r.doc_id: (r["__words"], r["__base"], r["__base_labels"], r["__labels"]) for r in op6.scan(frame(spark, rows)).collect()}
    assert got == {i: op6.brute(t) for i, t in rows}
    assert got[900][3] == "cc-by-sa" and got[901][3] == "cc-by,cc-by-sa"


def test_licenses_of_every_notice(spark):
    t = {label: words for label, words, _ in op6.TEMPLATES if words != "released under the mit license"}
    loose = " waived word redistribution word affero word hereby word mozilla word unencumbered word sharealike word spdx word isc word" * 200
    rows = [(1, f"{t['mit']} and so on {t['bsd']}"), (2, loose + " released under the MIT license" + loose), (3, " ".join(t.values())), (4, loose), (5, "mit license"), (6, "mit"), (7, "license")]
    got = {r.doc_id: r for r in op6.scan(frame(spark, rows)).collect()}
    assert got[1]["__labels"] == "bsd,mit" and got[2]["__labels"] == "mit" and got[4]["__labels"] == "" == got[6]["__labels"]
    assert got[1]["__score"] == got[2]["__score"] == 1.0 and got[5]["__score"] == 0.4
    assert set(t) <= set(got[3]["__labels"].split(","))


# 8

def substring_brute(rows, window):
    lists = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in rows]
    times = Counter(tuple(w[i : i + window]) for w in lists for i in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, lists, strict=True):
        gone = {p for k in range(len(w) - window + 1) if times[tuple(w[k : k + window])] > 1 for p in range(k, k + window)}
        out.append((i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [3, 35])
def test_substrings(spark, monkeypatch, window):
    monkeypatch.setattr(op8, "BLOCK_BYTES", 20_000)
    rows = [*texts(50, seed=9, vocabulary=2000), (900, " ".join(["again"] * 80)), (None, "a b c d"), (None, "a b c d")]
    got = op8.dedup_substrings(clashing(frame(spark, rows)), window=window).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept) for r in got), key=str) == substring_brute(rows, window)
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)
    assert op8.dedup_substrings(frame(spark, [])).count() == 0


def test_sketches_bound_the_difference():
    import numpy as np

    rng = np.random.default_rng(6)
    for n, m in ((1, 1), (10, 70), (300, 280), (500, 4000)):
        a, b = (np.unique(rng.integers(0, 5000, k)).astype(np.uint64) for k in (n, m))
        assert op2.hamming(op2.parity_sketch(a), op2.parity_sketch(b)) <= len(np.setxor1d(a, b))
        assert op2.hamming(op2.parity_sketch(a), op2.parity_sketch(a)) == 0


def test_runs_of_equal_keys_stay_together(spark):
    rng = random.Random(7)
    rows = [(k, c) for k in range(40) for c in rng.sample(range(1000), rng.choice([1, 2, 3, 8, 9, 30]))] + [(99, c) for c in range(2000)] * 2
    blob = lambda rs: np.array([len(rs)] + [c for _, c in rs] + [1] * len(rs) + [k for k, _ in rs], np.int64).tobytes()
    blobs = spark.createDataFrame([(blob(rows[:len(rows) // 2]),), (blob(rows[len(rows) // 2 :]),)], "keys binary").coalesce(1)
    keys = blobs.mapInArrow(op2.unfolded, "key long, cls long, hub long")
    assert keys.where("key = 99 and hub is null").count() == 1 and keys.where("key = 99 and hub = 0").count() == 1999  # one row of a hot key is shuffled
    got = op2.candidate_pairs(keys).collect()
    groups = {}
    for k, c in set(rows):
        groups.setdefault(k, set()).add(c)
    assert len({(r.u, r.v) for r in got}) == len(got) and all(r.u != r.v for r in got)
    links = {frozenset((r.u, r.v)) for r in got}
    for g in groups.values():
        if len(g) <= op2.SMALL:
            assert all(frozenset((a, b)) in links for a in g for b in g if a < b)
        else:
            assert all(frozenset((min(g), c)) in links for c in g if c != min(g))
