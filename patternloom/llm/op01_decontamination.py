"""Benchmark decontamination by suffix arrays over document shards, searched with every benchmark suffix."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.common import ALNUM, map_chunks, neutral, neutral_name, offsets, prepare, read, runs, save

WINDOW = 13
#: Bytes of benchmark text that are searched in one pass over the documents; a larger benchmark takes several passes.
BLOCK_BYTES = 8 << 20
#: Word ids are packed three to a 64-bit key; two where one item alone has more different words than fit.
BITS, PER_KEY = 21, 3
WIDE_BITS, WIDE_PER_KEY = 31, 2
#: Pairs of a place and an origin that are followed at once.
PAIRS = 1 << 18
FOUND = "__words long, __spans array<int>, __items array<string>, __longest struct<length:int,item_id:string,item_start:int,doc_start:int>"


class Suffixes:
    """The suffixes of a block of benchmark items, ready to be searched in a shard."""

    def __init__(self, items: list[tuple[str, bytes]], window: int) -> None:
        self.window, self.ids = window, {}
        self.names = [name for name, _ in items]
        self.rank = np.unique(np.array([n.encode() for n in self.names] or [b""], object), return_inverse=True)[1]
        rows = [[self.ids.setdefault(w, len(self.ids) + 1) for w in text.translate(ALNUM).split()] for _, text in items]
        self.bits, self.per_key = (BITS, PER_KEY) if len(self.ids) < 1 << BITS else (WIDE_BITS, WIDE_PER_KEY)
        self.len = np.array([len(r) for r in rows], np.int64)
        self.off = offsets(self.len + 1)  # a zero, which is no word, ends each item
        self.words = np.zeros(int(self.off[-1]) + window, np.int64)
        for r, at in zip(rows, self.off, strict=False):
            self.words[at : at + len(r)] = r
        owner = np.repeat(np.arange(len(rows)), self.len)
        place = np.arange(len(owner)) - np.repeat(offsets(self.len)[:-1], self.len)
        left = self.len[owner] - place
        keep = (left >= window) | (place == 0)  # one window for a short item, else those of full length
        owner, place, left = owner[keep], place[keep], np.minimum(left[keep], window)
        at = self.off[owner] + place
        grid = self.words[at[:, None] + np.arange(window)]
        grid[np.arange(window) >= left[:, None]] = 0
        before = np.where(place > 0, self.words[at - 1], 0)
        order = np.lexsort((before, *grid.T[::-1])) if len(grid) else np.zeros(0, np.int64)
        grid, self.owner, self.at, before = grid[order], owner[order], at[order], before[order]
        self.first = runs(grid)  # origins of distinct window q: first[q] to first[q + 1], by the word before them
        self.behind = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first)) * (len(self.ids) + 1) + before
        self.grid = grid[self.first[:-1]]
        self.size = (self.grid > 0).sum(axis=1)
        top = np.where(self.grid > 0, self.grid, (1 << self.bits) - 1)
        self.low, self.high = self.pack(self.grid), self.pack(top)
        self.begin = np.zeros(1 << 20, bool)
        self.begin[pair(self.grid[:, 0], self.grid[:, 1] if window > 1 else 0 * self.grid[:, 0])] = True
        self.single = np.zeros(len(self.ids) + 1, bool)
        self.single[self.grid[self.size == 1, 0]] = True

    def pack(self, grid: np.ndarray) -> list[np.ndarray]:
        """Rows of word ids as few 64-bit keys, which sort like the rows."""
        grid = np.pad(grid, ((0, 0), (0, -grid.shape[1] % self.per_key)))
        out = []
        for j in range(0, grid.shape[1], self.per_key):
            key = grid[:, j]
            for k in range(1, self.per_key):
                key = (key << self.bits) | grid[:, j + k]
            out.append(key)
        return out


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 0x9E3779B1 + b * 0x85EBCA77) >> 7 & (1 << 20) - 1


def bisect(key: np.ndarray, low: np.ndarray, high: np.ndarray, want: np.ndarray, right: bool) -> np.ndarray:
    """For each query the insertion place of want in its own slice low:high of key."""
    low, high = low.copy(), high.copy()
    while True:
        going = low < high
        if not going.any():
            return low
        mid = (low + high) >> 1
        value = key[np.minimum(mid, len(key) - 1)]
        up = going & ((value <= want) if right else (value < want))
        low = np.where(up, mid + 1, low)
        high = np.where(going & ~up, mid, high)


def search(s: Suffixes, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in words where a window occurs, and the window's number, from the shard's suffix array.

    The array holds the suffixes that begin like some benchmark suffix, ordered by their first `window` words; each
    benchmark suffix is then found by binary search, key by key.
    """
    nothing = np.zeros(0, np.int64)
    nxt = np.append(words[1:], 0)
    at = np.flatnonzero((words > 0) & (s.begin[pair(words, nxt)] | s.single[words]))
    if not len(at) or not len(s.grid):
        return nothing, nothing
    padded = np.append(words, np.zeros(s.window + PER_KEY, np.int64))
    keys = s.pack(padded[at[:, None] + np.arange(s.window)])
    order = np.lexsort(keys[::-1])
    array, keys = at[order], [k[order] for k in keys]
    edges = []
    for want, right in ((s.low, False), (s.high, True)):
        low, high = np.zeros(len(s.grid), np.int64), np.full(len(s.grid), len(array), np.int64)
        for j, key in enumerate(keys):
            a, b = bisect(key, low, high, want[j], False), bisect(key, low, high, want[j], True)
            if j == len(keys) - 1:
                edges.append(b if right else a)
            low, high = a, b  # an empty slice stays where the bound belongs
    n = np.maximum(edges[1] - edges[0], 0)
    which = np.repeat(np.arange(len(n)), n)
    return array[np.repeat(edges[0], n) + np.arange(len(which)) - np.repeat(offsets(n)[:-1], n)], which


def longest(s: Suffixes, words: np.ndarray, at: np.ndarray, which: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """Found places with those of their origins where a match begins, followed as far as document and item agree: place, origin,
    length, about PAIRS pairs at a time.

    Where the words before agree too, a match that begins further left holds this one: such origins are a run of the window's,
    which is left out unseen.
    """
    word = np.where(at > 0, words[at - 1], 0)
    low, high = s.first[which], s.first[which + 1]
    key = which * (len(s.ids) + 1) + word
    a, b = np.searchsorted(s.behind, key, "left"), np.searchsorted(s.behind, key, "right")
    a, b = np.where(word > 0, a, low), np.where(word > 0, b, low)
    n = (a - low) + (high - b)
    blocks = np.cumsum(n) // PAIRS
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(blocks)) + 1):
        k = n[part]
        within = np.arange(int(k.sum())) - np.repeat(offsets(k)[:-1], k)
        row = np.repeat(low[part], k) + within
        row += np.repeat(b[part] - a[part], k) * (row >= np.repeat(a[part], k))
        place = np.repeat(at[part], k)
        origin, length, going = s.at[row], np.repeat(s.size[which[part]], k), np.arange(len(place))
        while len(going):
            p, o = place[going] + length[going], origin[going] + length[going]
            w = s.words[np.minimum(o, len(s.words) - 1)]
            same = (p < len(words)) & (w > 0) & (words[np.minimum(p, len(words) - 1)] == w)
            going = going[same]
            length[going] += 1
        yield place, row, length


def scan(s: Suffixes, texts: list[bytes], before: dict | None) -> dict[str, list]:
    """Word count, hit spans, items with occurring windows and the longest match of each text."""
    get, out = s.ids.get, {"__words": [], "__spans": [], "__items": [], "__longest": []}
    lists = [t.translate(ALNUM).split() for t in texts]
    lens = np.array([len(w) for w in lists], np.int64)
    off = offsets(lens + 1)
    words = np.zeros(int(off[-1]), np.int64)
    zero = (0,).__mul__
    for w, a in zip(lists, off, strict=False):
        words[a : a + len(w)] = np.fromiter(map(get, w, zero(len(w))), np.int64, len(w))
    at, which = search(s, words)
    delta = np.zeros(len(words) + 1, np.int32)
    np.add.at(delta, at, 1)
    np.add.at(delta, at + s.size[which], -1)
    hit = (np.cumsum(delta[:-1]) > 0).astype(np.int8)
    turn = np.diff(np.concatenate([[0], hit, [0]]))
    begin, end = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    of = np.searchsorted(off, begin, "right") - 1
    spans: dict[int, list[int]] = {}
    for d, a, b in zip(of.tolist(), (begin - off[of]).tolist(), (end - off[of]).tolist(), strict=True):
        spans.setdefault(d, []).extend((a, b))
    doc = np.searchsorted(off, at, "right") - 1
    pairs = np.unique(doc * max(len(s.grid), 1) + which)
    items: dict[int, set[int]] = {}
    for d, q in zip((pairs // max(len(s.grid), 1)).tolist(), (pairs % max(len(s.grid), 1)).tolist(), strict=True):
        items.setdefault(d, set()).update(s.owner[s.first[q] : s.first[q + 1]].tolist())
    best: dict[int, dict] = {}

    def first_of_each(place: np.ndarray, row: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each document's longest match; of equal ones the first in it, by item and within the item."""
        d, item = np.searchsorted(off, place, "right") - 1, s.owner[row]
        order = np.lexsort((s.at[row] - s.off[item], s.rank[item], place, -length, d))
        top = order[runs(d[order])[:-1]]
        return place[top], row[top], length[top]

    if len(at):
        tops = [first_of_each(*found) for found in longest(s, words, at, which)]
        for p, r, n in zip(*first_of_each(*(np.concatenate(x) for x in zip(*tops, strict=True))), strict=True):
            k, o = int(np.searchsorted(off, p, "right") - 1), int(s.owner[r])
            best[k] = {"length": int(n), "item_id": s.names[o], "item_start": int(s.at[r] - s.off[o]), "doc_start": int(p - off[k])}
    for k in range(len(texts)):
        mine, names, top = spans.get(k, []), {s.names[i] for i in items.get(k, ())}, best.get(k)
        if before:
            mine, names = joined(before["__spans"][k], mine), names | set(before["__items"][k])
            old = before["__longest"][k]
            top = min((x for x in (old, top) if x), key=lambda x: (-x["length"], x["doc_start"], x["item_id"], x["item_start"]), default=None)
        out["__words"].append(int(lens[k]))
        out["__spans"].append(mine)
        out["__items"].append(sorted(names))
        out["__longest"].append(top)
    return out


def joined(a: list[int], b: list[int]) -> list[int]:
    """Union of two lists of spans, both as start, end, start, end ..."""
    out: list[int] = []
    for x, y in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and x <= out[-1]:
            out[-1] = max(out[-1], y)
        else:
            out += [x, y]
    return out


_ready: dict[str, Suffixes] = {}


def find_matches(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with __words, __spans (hit word spans), __items (ids as strings) and __longest (longest verbatim match: of equal
    ones the first in the document, then of the first item by name, then the first in the item).

    A null text or item text has no words; an item without an id is named "". A shard is what a task holds at once; the
    benchmark goes to all tasks in blocks of bounded size, one pass over the documents for each.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.select(F.coalesce(F.col(item).cast("string"), F.lit("")).alias("id"), F.coalesce(F.col(item_text), F.lit("")).alias("t"))
    blocks = 1 + (items.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema if not f.name.startswith("__")]
    out = docs.select(*(F.col(f"`{n}`") for n, _ in fields))
    schema = ", ".join([f"`{n}` {t}" for n, t in fields] + [FOUND])
    for k in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("id", "t"), F.lit(blocks)) == k)
        held = spark.sparkContext.broadcast([(r.id, r.t.encode()) for r in part.collect()])  # about block_bytes

        def once(held=held, first=not k, key=uuid.uuid4().hex):
            s = _ready.get(key)
            if s is None:
                _ready.clear()
                s = _ready[key] = Suffixes(held.value, window)

            def step(t: pa.Table, texts: list[bytes]) -> pa.Table:
                before = None if first else {c: t[c].to_pylist() for c in ("__spans", "__items", "__longest")}
                got = scan(s, texts, before)
                for name, kind in (("__words", pa.int64()), ("__spans", pa.list_(pa.int32())), ("__items", pa.list_(pa.string())), ("__longest", pa.struct([("length", pa.int32()), ("item_id", pa.string()), ("item_start", pa.int32()), ("doc_start", pa.int32())]))):
                    column = pa.array(got[name], kind)
                    at = t.schema.get_field_index(name)
                    t = t.append_column(name, column) if at < 0 else t.set_column(at, name, column)
                return t

            return step

        out = map_chunks(out, text, None, schema, once=once)
        if k < blocks - 1:
            out = save(out, "matches")
    return out


def hit_words() -> F.Column:
    return F.aggregate(F.transform("__spans", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x)), F.lit(0).cast("long"), lambda a, x: a + x)


def contaminated() -> F.Column:
    """At least one word in twenty lies in an occurrence of a benchmark window."""
    return (hit_words() > 0) & (20 * hit_words() >= F.col("__words"))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that are not contaminated, with their own columns, whatever these are called."""
    plain = neutral(docs)
    found = find_matches(plain, benchmark, neutral_name(docs, text), **options)
    return found.where(~contaminated()).select(*plain.columns).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_matches(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    longest = F.col("__longest")
    return found.select(
        "doc_id", F.col("__words").alias("n_words"), hit_words().alias("n_hit"), F.size("__items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__items", ","), 256).alias("items_sha256"), contaminated().alias("contaminated"),
        F.coalesce(longest["length"].cast("long"), F.lit(0).cast("long")).alias("longest_words"), longest["item_id"].alias("longest_item"),
        longest["item_start"].cast("long").alias("longest_item_start"), longest["doc_start"].cast("long").alias("longest_doc_start"),
    )


def brute(docs: list[tuple], items: list[tuple], window: int = WINDOW) -> list[tuple]:
    """The same rows by comparing slices, for tests."""
    cut = lambda t: (t or "").encode().translate(ALNUM).split()
    wins = [(str(i), {tuple(w[k : k + min(window, len(w))]) for k in range(max(1, len(w) - window + 1))}) for i, t in items if (w := cut(t))]
    out = []
    for i, t in docs:
        w, hit, names = cut(t), set(), set()
        for name, ws in wins:
            for g in ws:
                for k in range(len(w) - len(g) + 1):
                    if tuple(w[k : k + len(g)]) == g:
                        names.add(name)
                        hit.update(range(k, k + len(g)))
        out.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out
