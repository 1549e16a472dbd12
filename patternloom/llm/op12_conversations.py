"""Conversation structure repair: minimum costs from both ends mark the tight arcs of an edit graph, a frontier walks the least of them."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from patternloom.llm.common import prepare, read, tidy

WHITE = " \t\n\x0b\x0c\r"
ROLES = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 2, 3, 2, 1
#: Initials in the order of their codes; any other one is code 3.
INITIALS = "sua"
#: What a row is told by: the code of its role's initial, and 4 times its fault (BLANK, DUPLICATE, TRUNCATED or none).
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
#: Places in (s?(ua)+)?: at the start, after the s, after a u, after an a; where each initial leads from there.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
FAR = 1 << 20
#: A place that costs so much more than the best one is on no cheapest path: five edits' cost leads from the best one to wherever it leads.
HOPELESS = 20
#: Outcomes of conversations of at most SHORT rows that a worker remembers before it starts afresh.
MEMORY, SHORT = 100_000, 64
#: Least number of rows and bytes of text that are passed on at once.
ROWS, BYTES = 2_000, 1 << 20


def arcs(symbol: int | None) -> list[tuple[int, int, str, int]]:
    """(from, to, letter, cost): the edits of a row; with None those that insert one."""
    new = [(p, NEXT[p][r]) for p in range(4) for r in ROLES if r in NEXT[p]]
    if symbol is None:
        return [(p, q, "I", INSERT) for p, q in new]
    out = [(p, p, "D", DELETE) for p in range(4)]
    fault, initial = symbol >> 2, "sua?"[symbol & 3]
    if fault not in (BLANK, DUPLICATE):
        more = CUT_SHORT * (fault == TRUNCATED)
        out += [(p, NEXT[p][initial], "K", KEEP + more) for p in range(4) if initial in NEXT[p]]
        out += [(p, q, "R", REROLE + more) for p, q in new]
    return out


INSERTS = arcs(None)


class Graph:
    """Cheapest edits of a conversation. Its layers are the gaps between rows, each with the four places; an insertion leads
    on within a layer, any other edit to the next one.

    Costs of a layer count from its best place: only few such vectors exist, so they are numbered, and what a row makes of one
    is worked out once.
    """

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.number: dict[tuple[int, ...], int] = {}
        self.ahead: dict[tuple[int, int], tuple[int, int]] = {}
        self.back: dict[tuple[int, int], int] = {}
        self.moves: dict[tuple, tuple[str, int]] = {}
        self.known: dict[bytes, tuple[int, str]] = {}
        self.first, self.base = self.numbered(self.settled([0, FAR, FAR, FAR]))
        self.last, _ = self.numbered(self.settled([0 if p in ENDS else FAR for p in range(4)], back=True))

    def settled(self, cost: list[int], back: bool = False) -> list[int]:
        """Costs with insertions: two of them lead wherever insertions lead."""
        for _ in range(2):
            for p, q, _, w in INSERTS:
                a, b = (q, p) if back else (p, q)
                cost[b] = min(cost[b], cost[a] + w)
        return cost

    def numbered(self, cost: list[int]) -> tuple[int, int]:
        low = min(cost)
        v = tuple(c - low if c - low <= HOPELESS else FAR for c in cost)
        if v not in self.number:
            self.number[v] = len(self.vectors)
            self.vectors.append(v)
        return self.number[v], low

    def forward(self, f: int, symbol: int) -> tuple[int, int]:
        """The vector behind a row, and by how much its best place costs more."""
        if (f, symbol) not in self.ahead:
            cost = [FAR] * 4
            for p, q, _, w in arcs(symbol):
                cost[q] = min(cost[q], self.vectors[f][p] + w)
            self.ahead[f, symbol] = self.numbered(self.settled(cost))
        return self.ahead[f, symbol]

    def backward(self, g: int, symbol: int) -> int:
        """The vector of what is left to pay before a row."""
        if (g, symbol) not in self.back:
            cost = [FAR] * 4
            for p, q, _, w in arcs(symbol):
                cost[p] = min(cost[p], self.vectors[g][q] + w)
            self.back[g, symbol] = self.numbered(self.settled(cost, back=True))[0]
        return self.back[g, symbol]

    def move(self, f: int, g: int, then: int | None, symbol: int | None, places: int) -> tuple[str, int]:
        """The letters up to and with a row's, and the frontier behind it: of all tight arcs that leave the frontier (a set of
        places, as bits) those with the least letter are followed. Without a row: the letters up to the end."""
        key = (f, g, then, symbol, places)
        if key not in self.moves:
            before, after = self.vectors[f], self.vectors[g]
            best = min(a + b for a, b in zip(before, after, strict=True))
            tight = [(p, q, letter) for p, q, letter, w in INSERTS if before[p] + w + after[q] == best]
            if symbol is not None:
                rest = [(p, q, letter, before[p] + w + self.vectors[then][q]) for p, q, letter, w in arcs(symbol)]
                low = min(c for _, _, _, c in rest)
                tight += [(p, q, letter) for p, q, letter, c in rest if c == low]
            letters, at = "", places
            while symbol is not None or not any(at >> p & 1 and before[p] == best for p in ENDS):
                letter = min(x for p, _, x in tight if at >> p & 1)
                at = sum({1 << q for p, q, x in tight if at >> p & 1 and x == letter})
                letters += letter
                if letter != "I":
                    break
            self.moves[key] = letters, at
        return self.moves[key]

    def solve(self, symbols: bytes) -> tuple[int, str]:
        """The least cost and the audit: among the cheapest edits the ones whose letters are least in ASCII."""
        found = self.known.get(symbols)
        if found is None:
            f, g, cost = array("H", [self.first]), array("H", [self.last]), self.base
            for s in symbols:
                n, more = self.forward(f[-1], s)
                f.append(n)
                cost += more
            for s in reversed(symbols):
                g.append(self.backward(g[-1], s))
            g.reverse()
            letters, places = [], 1
            for i, s in enumerate(symbols):
                more, places = self.move(f[i], g[i], g[i + 1], s, places)
                letters.append(more)
            letters.append(self.move(f[-1], g[-1], None, None, places)[0])
            found = cost + min(self.vectors[f[-1]][p] for p in ENDS), "".join(letters)
            if len(symbols) <= SHORT:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[symbols] = found
        return found


def damaged(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations' rows as c, t, r, x with gone: every twentieth by crc32 of `conv:turn` is gone, emptied, stripped of
    [.!?], repeated, or given to the user; nulls count as a space (a null turn stays null)."""
    c, t = F.col(f"`{conv}`"), F.col(f"`{turn}`")
    space = lambda x: F.coalesce(x.cast("string"), F.lit(" "))
    k = F.crc32(F.concat(space(c), F.lit(":"), space(t))) % 20
    x, r = space(F.col(f"`{text}`")), space(F.col(f"`{role}`"))
    x = F.when(k <= 1, "").when(k == 2, F.translate(x, ".!?", "")).otherwise(x)
    out = rows.select(c.alias("c"), t.alias("t"), F.when(k == 4, "user").otherwise(r).alias("r"), x.alias("x"), (k == 0).alias("gone"), F.explode(F.when(k == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"))
    return out.drop("copy")


def whole(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The conversations' rows as they are, as c, t, r, x, gone."""
    space = lambda x: F.coalesce(F.col(f"`{x}`").cast("string"), F.lit(" "))
    return rows.select(F.col(f"`{conv}`").alias("c"), F.col(f"`{turn}`").alias("t"), space(role).alias("r"), space(text).alias("x"), F.lit(False).alias("gone"))


def digest(x: Column) -> Column:
    return F.unhex(F.md5(x))


def in_order(rows: DataFrame, *before: str) -> DataFrame:
    """Each conversation's rows in one partition, one after another: by turn (nulls first), then role, then the text's digest."""
    return rows.repartition("c").sortWithinPartitions(F.col("c").asc_nulls_first(), *before, F.col("t").asc_nulls_first(), "r", "h")


STATS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def audits(rows: DataFrame) -> DataFrame:
    """c, gaps, blank, duplicate, truncated, illegal, cost, audit: a row for each conversation among c, t, r, x, gone.

    Texts are not moved: their digests and faults are. Equal rows of a conversation are counted in the partition that its rows
    are brought to anyway. A task keeps a byte for each row of the conversation that it reads, and two numbers while it is solved.
    """
    prepare(rows.sparkSession)
    last = F.right(F.rtrim("x", F.lit(WHITE)), F.lit(1))
    initial = F.lit(3)
    for k, letter in enumerate(INITIALS):
        initial = F.when(F.startswith("r", F.lit(letter)), k).otherwise(initial)
    own = F.when(last == "", BLANK).when(~last.isin(".", "!", "?"), TRUNCATED).otherwise(0)
    small = rows.select("c", "t", "r", "gone", digest(F.col("x")).alias("h"), initial.alias("initial"), own.alias("own")).repartition("c")
    seen = F.row_number().over(Window.partitionBy("c", "gone", "r", "h").orderBy(F.col("t").asc_nulls_first()))
    fault = F.when((F.col("own") != BLANK) & (seen > 1), DUPLICATE).otherwise(F.col("own"))
    told = small.withColumn("symbol", (F.col("initial") + 4 * fault).cast("int")).withColumn("again", seen)
    told = told.sortWithinPartitions(F.col("c").asc_nulls_first(), F.col("t").asc_nulls_first(), "r", "h", "again").select("c", "t", "gone", "symbol")

    def run(batches):
        graph, out = Graph(), []

        def close(c, symbols: bytearray, turns: int, low, high) -> None:
            faults = [0] * 4
            for s in range(16):
                faults[s >> 2] += symbols.count(s)
            plain = symbols.translate(bytes(s & 3 for s in range(256)))
            legal = sum(plain.count(bytes(INITIALS.index(x) for x in pair)) for pair in ("su", "ua", "au"))
            cost, audit = graph.solve(bytes(symbols))
            out.append((c, high - low + 1 - turns if turns else 0, *faults[1:], max(0, len(plain) - 1) - legal, cost, audit))

        def emit():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:-1]), pa.array(columns[-1], pa.string())], names=["c", *STATS, "audit"])

        now: tuple | None = None
        symbols, turns, low, high = bytearray(), 0, None, None
        kind = None
        for b in batches:
            kind = b.column("c").type
            for c, t, gone, symbol in zip(*(b.column(k).to_pylist() for k in ("c", "t", "gone", "symbol")), strict=True):
                if now != (c,):
                    if now:
                        close(now[0], symbols, turns, low, high)
                    now, symbols, turns, low, high = (c,), bytearray(), 0, None, None
                if not gone:
                    symbols.append(symbol)
                    if t is not None and t != high:
                        turns, low, high = turns + 1, t if low is None else low, t
            if len(out) >= ROWS:
                yield emit()
        if now:
            close(now[0], symbols, turns, low, high)
            yield emit()
        tidy()

    return told.mapInArrow(run, f"c {rows.schema['c'].dataType.simpleString()}, " + ", ".join(f"{k} long" for k in STATS) + ", audit string")


def edited(audit: str, rows: Iterator[tuple[str, str]]) -> Iterator[tuple[str, str]]:
    """(role, text) after the edits. What a rerole or an insertion gives follows from how many rows stay: an odd number begins
    with the system's."""
    system = (len(audit) - audit.count("D")) % 2
    at = 0
    for letter in audit:
        role, text = next(rows) if letter != "I" else ("", "")
        if letter != "D":
            yield (role if letter == "K" else ROLES["ua"[(at - system) % 2]]), text
            at += 1


def walked(rows: DataFrame, found: DataFrame) -> DataFrame:
    """For each conversation its outcome (first) and then its rows in order, in one partition."""
    both = rows.where("not gone").select("c", F.lit(1).alias("kind"), "t", "r", digest(F.col("x")).alias("h"), "x", *(F.lit(None).cast("long").alias(k) for k in STATS))
    head = found.select("c", F.lit(0).alias("kind"), *(F.lit(None).cast(rows.schema[k].dataType).alias(k) for k in ("t", "r")), F.lit(None).cast("binary").alias("h"), F.col("audit").alias("x"), *STATS)
    return in_order(both.unionByName(head), "kind").drop("t", "h")


def conversations(batches) -> Iterator[tuple[tuple, Iterator[tuple[str, str]]]]:
    """((c, stats ..., audit), edited rows) of each conversation of a sorted partition; the rows are read as they are asked for."""
    names = ("c", "kind", "r", "x", *STATS)
    flat = (row for b in batches for row in zip(*(b.column(k).to_pylist() for k in names), strict=True))
    for c, _, _, audit, *stats in flat:  # the edits of one conversation ask for all of its rows before the next one's come
        yield (c, *stats, audit), edited(audit, ((r, x) for _, _, r, x, *_ in flat))


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """c, place, role, text: the rows of the repaired conversations, numbered from 0, inserted ones with an empty text."""

    def run(batches):
        held, size, kind = [], 0, None

        def emit():
            c, p, r, x = zip(*held, strict=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kind), pa.array(p, pa.int64()), pa.array(r, pa.string()), pa.array(x, pa.string())], names=["c", "place", "role", "text"])

        def typed():
            nonlocal kind
            for b in batches:
                kind = b.column("c").type
                yield b

        for (c, *_), kept in conversations(typed()):
            for place, (role, text) in enumerate(kept):
                held.append((c, place, role, text))
                size += len(text)
                if len(held) >= ROWS or size >= BYTES:
                    yield emit()
                    size = 0
        if held:
            yield emit()
        tidy()

    return walked(rows, found).mapInArrow(run, f"c {rows.schema['c'].dataType.simpleString()}, place long, role string, text string")


def reported(rows: DataFrame, found: DataFrame) -> DataFrame:
    """The outcomes with the SHA-256 of `role:text` of all repaired rows, joined by line ends; the rows stream through it."""

    def run(batches):
        held, kind = [], None

        def emit():
            columns = list(zip(*held, strict=True))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(x, pa.int64()) for x in columns[1:-2]), *(pa.array(x, pa.string()) for x in columns[-2:])], names=["c", *STATS, "audit", "repaired_sha256"])

        def typed():
            nonlocal kind
            for b in batches:
                kind = b.column("c").type
                yield b

        for outcome, kept in conversations(typed()):
            h, joint = hashlib.sha256(), ""
            for role, text in kept:
                h.update(f"{joint}{role}:{text}".encode())
                joint = "\n"
            held.append((*outcome, h.hexdigest()))
            if len(held) >= ROWS:
                yield emit()
        if held:
            yield emit()
        tidy()

    kind = rows.schema["c"].dataType.simpleString()
    return walked(rows, found).mapInArrow(run, f"c {kind}, " + ", ".join(f"{k} long" for k in STATS) + ", audit string, repaired_sha256 string")


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of conversations -> conv, place, role, text: each conversation's cheapest repair to the roles (s?(ua)+)?.

    Blank and repeated rows (of role and text) go; keeping a row is free, another role 2, deleting 3, inserting 2, and a row that
    stays without [.!?] at its end 1 more; ties go to the edits whose letters (Delete, Insert, Keep, Rerole) are least. Rows count
    in the order of their turns, nulls first, those of one turn by role and digest of the text. A null role or text is a space
    (a blank row; a role that cannot stay); an empty role cannot stay either. Rows without conversation are one. A conversation
    of which nothing stays has no rows here. An empty table gives an empty one; other columns are left out.

    A conversation is a chain: one task reads its rows in their order, however many they are, but holds no more of them than
    a byte each, and its audit.
    """
    given = whole(rows, conv, turn, role, text)
    return repaired(given, audits(given)).withColumnsRenamed({"c": conv, "role": role, "text": text})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read(spark, sf_dir, "conversations"))
    return reported(rows, audits(rows)).withColumnRenamed("c", "conv_id")


def brute(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, audit) of (role, fault) rows by trying all edits, for tests."""
    done: dict[tuple[int, int], tuple[int, str]] = {}

    def best(i: int, place: int, inserted: int) -> tuple[int, str]:
        if (i, place, inserted) in done:
            return done[i, place, inserted]
        ways = [(0, "")] if i == len(rows) and place in ENDS else []
        steps = [(i, q, inserted + 1, 2, "I") for r, q in NEXT[place].items() if r != "s"] if inserted < 3 else []
        if i < len(rows):
            role, fault = rows[i]
            steps.append((i + 1, place, 0, 3, "D"))
            if fault in (0, 3):
                late = fault == 3
                steps += [(i + 1, q, 0, late, "K") for r, q in NEXT[place].items() if role[:1] == r]
                steps += [(i + 1, q, 0, 2 + late, "R") for r, q in NEXT[place].items() if r != "s"]
        for a, b, c, w, x in steps:
            cost, audit = best(a, b, c)
            ways.append((cost + w, x + audit))
        done[i, place, inserted] = min(ways, default=(1 << 30, ""))
        return done[i, place, inserted]

    return best(0, 0, 0)
