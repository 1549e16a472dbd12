"""Operators 11 to 13 against plain versions."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from patternloom.llm import op11_filter_audit as op11
from patternloom.llm import op12_conversations as op12
from patternloom.llm import op13_tokens as op13

WORD = re.compile("[^\x20\x09-\x0d]+")


# ---------------------------------------------------------------- 11


def failures(text, i, rows):
    words = WORD.findall(text)
    return {
        "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in "#$%&*|" for c in text),
        "E": i is not None and any(j is not None and j < i and (t or "") == text for j, t, _ in rows),
    }


def plain_audit(rows, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    out = {}
    for part in {s or "" for _, _, s in rows}:
        docs = [(i, failures(t or "", i, rows)) for i, t, s in rows if (s or "") == part]
        removals = dict.fromkeys("ABCDE", 0)
        for o in map("".join, itertools.permutations("ABCDE")):
            left, gone = docs, []
            for step, f in enumerate(o, 1):
                now = [d for d in left if d[1][f]]
                out[part, o, step] = [len(left) - len(now), len(now), sum(d[1][f] for d in gone), sum(d[1][f] and sum(d[1].values()) == 1 for d in docs), sum(d[0] in good for d in now), sum(d[0] in toxic for d in now)]
                left, gone = [d for d in left if not d[1][f]], gone + now
                removals[f] += len(now)
        for o in map("".join, itertools.permutations("ABCDE")):
            for step, f in enumerate(o, 1):
                out[part, o, step].append(removals[f])
    return out


def audited(spark, rows, labels):
    docs = spark.createDataFrame([(i, t, s, 1, "x", True) for i, t, s in rows], "doc_id long, text string, source string, mask int, part string, good boolean")
    got = op11.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): list(r)[3:] for r in got}, len(got)


def test_audit_equals_a_plain_one(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(90)] + ["ÄÖ", "日本", "AB", "#x", "Tom", "é"]
    texts = [" ".join(rng.choices(words[: rng.choice([20, 60, 96])], k=rng.choice([10, 49, 50, 80]))) for _ in range(50)] + ["", " \t\n", "A" * 3, "x\x1cy " * 60, "a　b " * 60]
    rows = [(rng.choice([*range(80), None]), rng.choice([*texts, None]), rng.choice(["s", "t", "", None])) for _ in range(160)]
    rows += [(5, texts[0], "s")] * 3 + [(3, texts[0], "s")] * 2
    labels = [(rng.randrange(90), rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(60)] + [(5, 1, 1), (5, 0, 0), (None, 1, 1)]
    got, n = audited(spark, rows, labels)
    assert n == len(got) == 3 * 600 and got == plain_audit(rows, labels)


def test_audit_of_nothing_and_of_one_text_everywhere(spark):
    assert audited(spark, [], [])[1] == 0
    got, _ = audited(spark, [(i, "copy", "hot") for i in range(500)] + [(None, "copy", None)], [(i, 1, 0) for i in range(500)])
    assert got["hot", "EABCD", 1] == [1, 499, 0, 0, 499, 0, sum(got["hot", "".join(o), o.index("E") + 1][1] for o in itertools.permutations("ABCDE"))]
    assert got["", "EABCD", 1][:2] == [1, 0]


def test_audit_of_many_parts_flushes(spark, monkeypatch):
    monkeypatch.setattr(op11, "PARTS", 2)
    assert audited(spark, [(i, "w " * 60, f"s{i % 7}") for i in range(70)], [])[0]["s3", "ABCDE", 1][:2] == [10, 0]


def test_first_failures():
    assert op11.FIRST.shape == (32, 120)
    for mask, (k, order) in itertools.product(range(32), enumerate(op11.ORDERS)):
        assert op11.FIRST[mask, k] == next((s for s, f in enumerate(order) if mask >> "ABCDE".index(f) & 1), 5)


# ---------------------------------------------------------------- 12


def test_graph_equals_trying_all_edits():
    rng, graph = random.Random(5), op12.Graph()
    for k in range(4_000):
        symbols = bytes(rng.randrange(16) if k % 2 else rng.choice([0, 1, 2, 1, 2, 13, 14, 6, 5, 1]) for _ in range(rng.randrange(9)))
        assert graph.solve(symbols) == op12.brute([("sua?"[s & 3], s >> 2) for s in symbols]), symbols


def test_graph_of_a_long_conversation():
    rng, graph = random.Random(6), op12.Graph()
    symbols = bytes(rng.choice([0, 1, 2, 3, 13, 14, 6, 5]) for _ in range(50_000))
    cost, audit = graph.solve(symbols)
    assert len(audit) - audit.count("I") == len(symbols) and len(graph.vectors) < 1_000
    kept = [s for s, x in zip(symbols, audit.replace("I", ""), strict=True) if x != "D"]
    assert cost == 3 * audit.count("D") + 2 * (audit.count("I") + audit.count("R")) + sum(s >> 2 == 3 for s in kept)


def test_place_without_hope_is_on_no_cheapest_path():
    graph = op12.Graph()
    for n in range(12):
        symbols = bytes([3] * n + [0, 1, 2])
        assert graph.solve(symbols) == op12.brute([("?", 0)] * n + [("s", 0), ("u", 0), ("a", 0)])


def plain_repair(rows, damage=True):
    """(outcome, repaired rows) of each conversation."""
    convs = {}
    for c, t, r, x in rows:
        space = lambda v: " " if v is None else v
        r, x, k = space(r), space(x), zlib.crc32(f"{space(c)}:{space(t)}".encode()) % 20 if damage else 19
        conv = convs.setdefault(c, [])
        x = "" if k == 1 else re.sub("[.!?]", "", x) if k == 2 else x
        conv += [(t, "user" if k == 4 else r, x)] * (0 if k == 0 else 2 if k == 3 else 1)
    out = {}
    for c, conv in convs.items():
        conv.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], hashlib.md5(v[2].encode()).digest()))
        seen, told = set(), []
        for _, r, x in conv:
            bare = x.strip(" \t\n\x0b\x0c\r")
            told.append((r, 1 if not bare else 2 if (r, x) in seen else 3 if bare[-1] not in ".!?" else 0))
            seen.add((r, x))
        cost, audit = op12.brute(told)
        turns = [t for t, _, _ in conv if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(conv, conv[1:], strict=False))
        kept, i = [], 0
        total = len(audit) - audit.count("D")
        for x in audit:
            name = ("system" if total % 2 and not kept else ["user", "assistant"][(len(kept) - total % 2) % 2])
            if x == "I":
                kept.append((name, ""))
                continue
            if x != "D":
                kept.append((conv[i][1] if x == "K" else name, conv[i][2]))
            i += 1
        assert re.fullmatch("(s?(ua)+)?", "".join(r[0] for r, _ in kept))
        faults = [sum(f == k for _, f in told) for k in (1, 2, 3)]
        out[c] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(f"{r}:{x}" for r, x in kept).encode()).hexdigest()), kept
    return out


SCHEMA = "conv_id long, turn long, role string, text string, c string, kind int, audit int"


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(7)
    texts = ["a.", "b", "a. ", "c!\n", "", " ", "\t", "d?", "x　", "日本。", "e.\x1c", None, "f.g"]
    rows = [(rng.choice([*range(30), None]), rng.choice([*range(7), None]), rng.choice(["user", "assistant", "system", "tool", None, "", "u", "sage"]), rng.choice(texts)) for _ in range(400)]
    rows += [(1, 2, "user", "same.")] * 4 + [(-7, t, "user" if t % 2 else "assistant", f"t{t}.") for t in range(60)]
    return rows + [(40, k, "user", "only this.") for k in range(50) if zlib.crc32(f"40:{k}".encode()) % 20 == 0]


def test_damaged_conversations_equal_plain_ones(spark, talks):
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in talks], SCHEMA).repartition(5)
    rows = op12.damaged(df)
    got = op12.reported(rows, op12.audits(rows)).collect()
    want = {c: v for c, (v, _) in plain_repair(talks).items()}
    want |= {c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in {r[0] for r in talks} - set(want)}
    assert len(got) == len(want) and {r.c: tuple(r)[1:] for r in got} == want
    assert want[40][-2] == ""


def test_repair_gives_the_rows_back(spark, talks, monkeypatch):
    monkeypatch.setattr(op12, "ROWS", 3)
    got = op12.repair(spark.createDataFrame([(*r, "x", 1, 2) for r in talks], SCHEMA))
    assert got.columns == ["conv_id", "place", "role", "text"]
    rows = {}
    for r in got.collect():
        rows.setdefault(r.conv_id, {})[r.place] = (r.role, r.text)
    assert {c: [v[k] for k in sorted(v)] for c, v in rows.items()} == {c: kept for c, (_, kept) in plain_repair(talks, damage=False).items() if kept}


def test_repair_of_one_conversation_that_is_most_of_the_table(spark):
    rows = [(None if k % 3 else 1, k if k % 5 else None, ["user", "assistant"][k % 2], f"turn {k}" + "." * (k % 4 > 0)) for k in range(9_000)]
    assert op12.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).count() > 5_000
    assert op12.repair(spark.createDataFrame([], SCHEMA)).count() == 0


# ---------------------------------------------------------------- 13


@pytest.fixture(scope="module")
def encoder():
    return op13.Encoder(op13.MODEL)


def noise(rng, n):
    return "".join(rng.choices([" ", " ", "a", "b", "\n", "\t", "\r", "é", "▁", "😀", "\x00", "<s>", "</s>", "<0x0A>", "the", "th", "ing", " and", "　", ".", ";\r", "\xa0", "1", "é", "{", "\r\n", "日本"], k=n))


def test_lengths_are_the_librarys(encoder, monkeypatch):
    assert encoder.cuts
    rng = random.Random(8)
    texts = ["", " ", "  ", "\n", " \n ", "▁", *(noise(rng, rng.randrange(15)) for _ in range(4_000)), noise(rng, 20_000), "ab" * 30_000]
    lengths = op13.Lengths(encoder, {b" the": encoder.piece(b" the")})
    want = [len(encoder.sp.encode(t)) for t in texts]
    assert [lengths.count(t.encode()) for t in texts] == want
    monkeypatch.setattr(op13, "STEP", 7)
    monkeypatch.setattr(op13, "CACHE", 5)
    assert [lengths.count(t.encode()) for t in texts] == want
    encoder_whole = op13.Encoder(op13.MODEL)
    encoder_whole.cuts = False
    assert op13.Lengths(encoder_whole, {}).count(b"a b") == len(encoder.sp.encode("a b"))


def test_models_with_other_pieces_are_not_cut(encoder):
    import public_tokenizers

    with open(public_tokenizers.path(op13.MODEL), "rb") as f:
        model = f.read()
    assert op13.separable(model, ["▁a", "▁▁", "b"]) and not op13.separable(model, ["a▁b"]) and not op13.separable(model, ["a\n"])


def test_token_counts_of_rows(spark, encoder):
    rng = random.Random(9)
    texts = [None, "", "the cat", "the cat", *(noise(rng, 50) for _ in range(60)), "the cat and the dog " * 5_000]
    rows = [(k if k % 9 else None, t, "x", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, i string, n_tokens int").repartition(3)
    got = op13.count_tokens(df).collect()
    want = [(i, len((t or "").encode()), len(encoder.sp.encode(t or "")), len(encoder.sp.encode(t or "")) > 4096) for i, t, *_ in rows]
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want)) and any(r.over_limit for r in got)
    assert op13.count_tokens(df.where("false")).count() == 0
    pieces, lengths = op13.frequent(df, "text", op13.MODEL)
    assert op13.unpacked((pieces, lengths))[b" cat"] == encoder.piece(b" cat") and len(lengths) // 2 <= op13.TABLE
