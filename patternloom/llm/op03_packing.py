"""Lexical retrieval packing: BM25 indexes of shards dealt by content give each seed its unused neighbours, which fill its window."""

from __future__ import annotations

import gc
import itertools
import os
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.common import CHUNK_BYTES, binaries, chunks, offsets, prepare, read, runs, save, tidy

CONTEXT = 4096
#: Tokens of one shard: its index is built and used in one task.
SHARD_TOKENS = 1_000_000
END = 2
#: BM25's k1 and b.
K1, B = 1.2, 0.75
#: Dimensions of a document's sketch, and the documents sampled for each shard (and at least) to lay out the shards.
DIMS, SAMPLED, LEAST = 64, 24, 2_000
TOKENIZER = "word_bpe_49k.json"
#: Distinct pieces between spaces whose ids a worker remembers.
PIECES = 1_000_000
#: Text whose pieces are looked up at once, in bytes.
BLOCK_BYTES = 16 << 20


#: What no plain piece holds: other than visible ASCII and precomposed Latin-1 letters, or the start of a special token. A
#: plain piece's normal form is its lower case.
HARD = re.compile("[^\n!-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]|<\\|")
#: The tokenizer's own cuts, restricted to plain pieces, one on each line.
CUTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|\n|[^\na-z0-9\u00df-\u00f6\u00f8-\u00ff]+")


def visible_bytes() -> dict[int, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is printable, else one beyond."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {b: b for b in keep} | {b: 256 + i for i, b in enumerate(rest)} | {10: 10}


class Ids:
    """Token ids of numbered entries, one after another."""

    def __init__(self, kind: type) -> None:
        self.ids, self.off = np.empty(0, kind), np.zeros(1, np.int64)

    def add(self, ids: np.ndarray, lens: np.ndarray) -> None:
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])
        self.off = np.concatenate([self.off, self.off[-1] + np.cumsum(lens)])

    def of(self, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the entries in order, and where each entry's begin, with the end."""
        n = self.off[index + 1] - self.off[index]
        at = offsets(n)
        return self.ids[np.repeat(self.off[index] - at[:-1], n) + np.arange(at[-1])], at


def lined(pieces: pa.Array) -> str:
    """The pieces, one on each line."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(pieces)], pa.int32()), pieces.cast(pa.string())), "\n")[0].as_py()


class Known:
    """Texts that have numbers, in order of first sight, and the ids of each."""

    def __init__(self, kind: type) -> None:
        self.texts, self.ids = pa.array([], pa.large_string()), Ids(kind)

    def index(self, texts: pa.Array, learn: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """The numbers of distinct texts; learn gives the ids of new ones, one after another, and how many each has."""
        at = pc.index_in(texts, value_set=self.texts)
        new = at.is_null()
        at = at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = texts.filter(new)
        if len(fresh):
            at[new.to_numpy(zero_copy_only=False)] = len(self.texts) + np.arange(len(fresh))
            self.ids.add(*learn(fresh))
            self.texts = pa.concat_arrays([self.texts, fresh])
        return at


class Encoder:
    """The tokenizer's ids, computed once for each distinct piece between ASCII spaces: no token reaches over a space.

    Plain pieces are cut here, all new ones at once, and their parts, which many pieces share, go to the tokenizer's model;
    any other piece goes through the whole tokenizer. Pieces and parts are told apart by Arrow, a block of texts at a time.
    """

    def __init__(self, name: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks of an executor are as many as its cores
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.plain = name == TOKENIZER
        self.size = self.tokenizer.get_vocab_size()
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.shown = visible_bytes()
        self.reset()

    def reset(self) -> None:
        self.pieces, self.parts = Known(self.kind), Known(self.kind)
        self.parts.index(pa.array(["\n"], pa.large_string()), lambda end: (np.empty(0), np.zeros(1, np.int64)))  # the end of a piece has no ids

    def flat(self, got: Iterable[list[int]], size: int) -> tuple[np.ndarray, np.ndarray]:
        ids, n = [], np.empty(size, np.int64)
        for k, x in enumerate(got):
            ids.extend(x)
            n[k] = len(x)
        return np.array(ids, self.kind), n

    def learn_parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new parts."""
        shown = lined(parts).encode().decode("latin-1").translate(self.shown).split("\n")
        return self.flat(([t.id for t in toks] for toks in map(self.tokenizer.model.tokenize, shown)), len(parts))

    def learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces."""
        if not self.plain:
            return self.whole(pieces.to_pylist())
        lines = lined(pieces) + "\n"
        hard = [m.start() for m in HARD.finditer(lines)]
        cuts = pa.array(CUTS.findall(lines.lower()), pa.large_string()).dictionary_encode()
        index = self.parts.index(cuts.dictionary, self.learn_parts)[cuts.indices.to_numpy()]
        ids, at = self.parts.ids.of(index)
        cut = np.concatenate([[0], at[1:][index == 0]])
        if hard:
            ends = np.cumsum(pc.utf8_length(pieces).to_numpy() + 1)
            each = np.split(ids, cut[1:-1])
            hard = np.unique(np.searchsorted(ends, hard, "right"))
            got, n = self.whole(pieces.take(pa.array(hard)).to_pylist())
            for k, x in zip(hard.tolist(), np.split(got, np.cumsum(n)[:-1]), strict=True):
                each[k] = x
            ids, cut = np.concatenate(each), offsets(np.fromiter(map(len, each), np.int64, len(each)))
        return ids, np.diff(cut)

    def whole(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.flat((e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)), len(pieces))

    def encode(self, texts: list[bytes]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """Runs of texts of about CHUNK_BYTES, first to end: the ids of a run's texts in one array and the number of each text's."""
        if len(self.pieces.texts) > PIECES:
            self.reset()
        whole = pa.array(texts, pa.large_binary()).cast(pa.large_string())
        # normal forms are lower case, but a special token is not
        cut = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(whole, "<|"), whole, pc.ascii_lower(whole)))
        found = cut.flatten().dictionary_encode()
        gc.disable()  # of the many small lists made here none is part of a cycle
        try:
            numbers = self.pieces.index(found.dictionary, self.learn)
        finally:
            gc.enable()
        at, each = cut.offsets.to_numpy(), found.indices.to_numpy()
        del whole, cut, found
        size = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
        for a, b in itertools.pairwise(runs(size // CHUNK_BYTES).tolist()):
            ids, end = self.pieces.ids.of(numbers[each[at[a] : at[b]]])
            yield a, b, ids, np.diff(end[at[a : b + 1] - at[a]])


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def weighted(tokens: list[np.ndarray], idf: np.ndarray, mean: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The documents' terms one after another, where each document's begin (with the end), and their BM25 weights, with
    corpus-wide document frequencies."""
    terms, weights, counts = [np.zeros(0, np.int64)], [np.zeros(0, np.float32)], [np.zeros(0, np.int64)]
    bits = len(idf).bit_length()
    size = 1 << 32 - bits
    for a in range(0, len(tokens), size):
        part = tokens[a : a + size]
        lens = np.fromiter(map(len, part), np.int64, len(part))
        key = np.repeat(np.arange(len(part), dtype=np.uint32) << np.uint32(bits), lens)
        key |= np.concatenate(part).astype(np.uint32)
        key.sort()
        edge = runs(key)
        key = key[edge[:-1]]
        doc, term, tf = (key >> np.uint32(bits)).astype(np.int64), (key & np.uint32((1 << bits) - 1)).astype(np.int64), np.diff(edge).astype(np.float32)
        norm = (K1 * (1 - B + B * lens / max(mean, 1))).astype(np.float32)
        terms.append(term)
        weights.append(idf[term] * tf * np.float32(K1 + 1) / (tf + norm[doc]))
        counts.append(np.bincount(doc, minlength=len(part)))
    return np.concatenate(terms), offsets(np.concatenate(counts)), np.concatenate(weights)


class Index:
    """BM25 over the documents of a shard."""

    def __init__(self, tokens: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.terms, self.at, self.weight = weighted(tokens, idf, mean)
        self.asked = np.zeros(len(idf), np.float32)
        # what is scored: documents that were unused when it was last cut down, their terms and weights
        self.docs, self.begin, self.held = np.arange(len(tokens)), self.at[:-1], self.terms

    def neighbours(self, seed: int, unused: np.ndarray) -> np.ndarray:
        """Unused documents that share a term with the seed, best by all its terms first; ties by place."""
        keep = unused[self.docs]
        if 4 * np.count_nonzero(keep) < 3 * len(keep):
            n = np.diff(np.append(self.begin, len(self.held)))
            each = np.repeat(keep, n)
            self.docs, self.begin, self.held, self.weight = self.docs[keep], offsets(n[keep])[:-1], self.held[each], self.weight[each]
            keep = np.ones(len(self.docs), bool)
        if not len(self.docs):
            return self.docs
        mine = self.terms[self.at[seed] : self.at[seed + 1]]
        self.asked[mine] = 1
        score = np.add.reduceat(self.weight * self.asked[self.held], self.begin)
        self.asked[mine] = 0
        found = np.flatnonzero((score > 0) & keep)
        return self.docs[found[np.argsort(-score[found], kind="stable")]]


class Sketcher:
    """A document's weighted terms, projected to DIMS dimensions: related documents have sketches of like direction."""

    def __init__(self, idf: np.ndarray, mean: float) -> None:
        self.idf, self.mean = idf, mean
        self.axes = np.random.default_rng(3).standard_normal((len(idf), DIMS), np.float32)

    def of(self, tokens: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(tokens), DIMS), np.float32)
        terms, at, w = weighted(tokens, self.idf, self.mean)
        for k, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
            out[k] = w[a:b] @ self.axes[terms[a:b]]
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


class Layout:
    """Shards by content: a tree of cuts across the widest direction of the sketches, each in proportion to its shards.

    Documents that no cut parts (copies) and fill more than a shard are dealt over its shards by a hash.
    """

    def __init__(self, x: np.ndarray, n: np.ndarray, shards: int) -> None:
        """x, n: sketches and tokens of sampled documents."""
        self.shards = 0
        axis, cut, sides, leaves = [], [], [], []

        def grow(at: np.ndarray, k: int) -> int:
            """The number of a node, or of a leaf as -1 - its number."""
            if k > 1 and len(at) > 1:
                mid = x[at] - x[at].mean(axis=0)
                d = mid[np.argmax((mid**2).sum(axis=1))]
                for _ in range(10):
                    d = mid.T @ (mid @ d)
                    d = d / max(float(np.linalg.norm(d)), 1e-12)
                p = np.round(x[at] @ d, 4)  # copies agree, however their products are rounded
                order = np.argsort(p, kind="stable")
                total = np.cumsum(n[at][order])
                values = np.unique(p)
                if len(values) > 1:
                    v = min(int(np.searchsorted(values, p[order[np.searchsorted(total, total[-1] * (k // 2) / k)]])), len(values) - 2)
                    right = p > values[v]
                    share = float(n[at][right].sum() / total[-1])
                    me = len(axis)
                    axis.append(d)
                    cut.append((values[v] + values[v + 1]) / 2)
                    sides.append([0, 0])
                    sides[me][0] = grow(at[~right], max(1, round(k * (1 - share))))
                    sides[me][1] = grow(at[right], max(1, round(k * share)))
                    return me
            leaves.append((self.shards, k))
            self.shards += k
            return -len(leaves)

        self.root = grow(np.arange(len(x)), shards)
        self.axis, self.cut, self.sides = np.array(axis, np.float32).reshape(-1, DIMS), np.array(cut), np.array(sides, np.int64).reshape(-1, 2)
        self.leaves = np.array(leaves, np.int64)

    def shard(self, x: np.ndarray, dealt: np.ndarray) -> np.ndarray:
        node = np.full(len(x), self.root)
        while len(at := np.flatnonzero(node >= 0)):
            k = node[at]
            node[at] = self.sides[k, ((x[at] * self.axis[k]).sum(axis=1) > self.cut[k]).astype(np.int64)]
        first, parts = self.leaves[-1 - node].T
        return first + dealt % parts


def fill(lengths: np.ndarray, index: Index, context: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset): windows are filled with a seed and its unused neighbours.

    What does not fit into a window is cut there and its rest opens the next one. A seed is the last document placed, or
    the first unused one where it has no unused neighbour left.
    """
    out, unused, free, sequence, first = [], lengths > 0, context, 0, 0
    left = int(unused.sum())
    queue, at, seed = np.zeros(0, np.int64), 0, -1

    def put(doc: int) -> None:
        nonlocal free, sequence
        start, n = 0, int(lengths[doc])
        while n:
            size = min(n, free)
            out.append((doc, start, size, sequence, context - free))
            start, n, free = start + size, n - size, free - size
            if not free:
                free, sequence = context, sequence + 1

    while left:
        while at < len(queue) and not unused[queue[at]]:
            at += 1
        if at < len(queue) and seed >= 0:
            doc = int(queue[at])
        else:
            while not unused[first]:
                first += 1
            doc = first
        before = sequence
        unused[doc] = False
        left -= 1
        put(doc)
        if sequence != before or seed < 0 or at >= len(queue):  # a new window: its neighbours are those of its first document
            seed = doc
            queue, at = index.neighbours(doc, unused) if left else np.zeros(0, np.int64), 0
    return out


def tokenize(docs: DataFrame, id: str, text: str, name: str) -> DataFrame:
    """kind 0: id, tokens (ids as little-endian binary, END added), n for every row of docs, a null text being empty.
    kind 1: id, n, in how many of a task's rows each token id occurs."""
    prepare(docs.sparkSession)

    def run(batches):
        enc = encoder(name)
        total = np.zeros(enc.size, np.int64)
        end = np.array([END], enc.kind).tobytes()
        for t, texts in chunks(batches, "text", BLOCK_BYTES):
            for a, b, ids, n in enc.encode(texts):
                off = offsets(n)
                key = np.sort((np.repeat(np.arange(len(n)), n) << 32) | ids)
                total += np.bincount(key[runs(key)[:-1]] & 0xFFFFFFFF, minlength=enc.size)
                total[END] += len(n)
                raw, w = ids.tobytes(), ids.itemsize
                tokens = binaries([raw[w * i : w * j] + end for i, j in itertools.pairwise(off.tolist())])
                yield from pa.table({"id": t["id"].slice(a, b - a), "n": pa.array(n + 1), "tokens": tokens, "kind": pa.array(np.zeros(len(n), np.int32))}).to_batches()
                ids = key = raw = tokens = None
            t = texts = None
        used = np.flatnonzero(total)
        tidy()
        yield pa.RecordBatch.from_pydict({"id": pa.array(used), "n": pa.array(total[used]), "tokens": pa.nulls(len(used), pa.binary()), "kind": pa.array(np.ones(len(used), np.int32))})

    return docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text")).mapInArrow(run, "id long, n long, tokens binary, kind int")


def frequencies(counts: DataFrame, size: int) -> np.ndarray:
    """In how many documents each id occurs: a vector as long as the vocabulary, summed over all documents."""
    df = np.zeros(size, np.int64)
    for r in counts.groupBy("id").agg(F.sum("n").alias("df")).collect():  # at most a row for each id of the vocabulary
        df[r.id] = r.df
    return df


def lay_out(placed: DataFrame, idf: np.ndarray, mean: float, n_docs: int, shards: int, width: int) -> Layout:
    """The shards by the sketches of SAMPLED documents for each, chosen by hash."""
    if shards == 1:
        return Layout(np.zeros((0, DIMS), np.float32), np.zeros(0), 1)

    def run(batches):
        sketcher = Sketcher(idf, mean)
        for batch in batches:
            x = sketcher.of([np.frombuffer(b, f"<u{width}") for b in batch.column("tokens").to_pylist()])
            yield pa.RecordBatch.from_pydict({"n": batch.column("n"), "x": binaries([v.tobytes() for v in x])})
        tidy()

    part = min(1.0, max(SAMPLED * shards, LEAST) / max(n_docs, 1))
    rows = placed.where(F.pmod("dealt", F.lit(1 << 30)) < int(part * (1 << 30))).select("n", "tokens").mapInArrow(run, "n long, x binary").collect()  # SAMPLED rows of 4 * DIMS bytes for each shard
    rows.sort()
    return Layout(np.frombuffer(b"".join(r.x for r in rows), np.float32).reshape(-1, DIMS), np.array([r.n for r in rows], np.float64), shards)


def pack(docs: DataFrame, id: str = "doc_id", text: str = "text", tokenizer: str = TOKENIZER, context: int = CONTEXT, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """docs(id, text) -> id, start, length, ids_crc32, doc_tokens, sequence_id, offset, shard: a row for each piece.

    Each row of docs, repeated ones included, gives its ids and END to exactly one place each; a null or empty text gives
    END alone. Documents are dealt to shards of about shard_tokens by their content, so that neighbours meet whatever the
    number of shards. A shard cuts the whole windows off its long documents and packs what is left of each by retrieval, for
    which a document counts with all its terms; all its sequences but the last are full. Statistics of terms are those of
    the whole table.
    """
    spark = docs.sparkSession
    size = encoder(tokenizer).size
    width = 2 if size <= 1 << 16 else 4
    both = save(tokenize(docs, id, text, tokenizer), "packing-tokens")
    tokens = both.where("kind = 0").drop("kind")
    n_docs, n_tokens = tokens.agg(F.count("*"), F.sum("n")).first()
    df = frequencies(both.where("kind = 1").select("id", "n"), size)
    idf = np.log(1 + ((n_docs or 0) - df + 0.5) / (df + 0.5)).astype(np.float32)
    mean = (n_tokens or 0) / max(n_docs or 0, 1)
    # the row's place in the written table parts rows that agree in everything
    placed = tokens.select("id", "n", "tokens", F.xxhash64(F.col("id"), F.monotonically_increasing_id()).alias("dealt"))
    layout = lay_out(placed, idf, mean, n_docs or 0, 1 + (n_tokens or 0) // shard_tokens, width)
    shards = layout.shards
    held = spark.sparkContext.broadcast((idf, mean, layout))  # as long as the vocabulary, and a sketch for each shard

    def deal(batches):
        idf, mean, layout = held.value
        sketcher = Sketcher(idf, mean)
        for batch in batches:
            h = batch.column("dealt").to_numpy(zero_copy_only=False)
            x = sketcher.of([np.frombuffer(b, f"<u{width}") for b in batch.column("tokens").to_pylist()])
            yield pa.RecordBatch.from_pydict({"id": batch.column("id"), "n": batch.column("n"), "tokens": batch.column("tokens"), "shard": pa.array(layout.shard(x, h), pa.int64())})
        tidy()

    dealt = placed.mapInArrow(deal, "id long, n long, tokens binary, shard long") if shards > 1 else placed.withColumn("shard", F.lit(0).cast("long"))
    n = min(shards, max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + shards // 4))  # a task has about four shards at most
    dealt = dealt.repartition(n, "shard").sortWithinPartitions("shard", "id", "n")

    def run(batches):
        _encoders.clear()  # a worker that cut tokens cuts no more
        tidy()
        idf, mean, _ = held.value
        shard, out, tails, sequence = None, [], [], 0

        def crc(a: np.ndarray) -> int:
            return zlib.crc32(a.astype("<u4").tobytes())

        def emit():
            rows = list(zip(*out, strict=True)) or [[]] * 8
            out.clear()
            names = ("id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "shard")
            return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(names, rows, strict=True)})

        def close(sequence: int) -> None:
            lengths = np.array([len(t) - whole for _, t, whole in tails], np.int64)
            for d, start, length, s, offset in fill(lengths, Index([t for _, t, _ in tails], idf, mean), context):
                i, t, whole = tails[d]
                out.append((i, whole + start, length, crc(t[whole + start : whole + start + length]), len(t), (shard << 32) + sequence + s, offset, shard))
            tails.clear()

        for batch in batches:
            for i, s, b in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "shard", "tokens")), strict=True):
                if s != shard:
                    if shard is not None:
                        close(sequence)
                        yield emit()
                    shard, sequence = s, 0
                t = np.frombuffer(b, f"<u{width}")
                whole = len(t) // context * context
                for a in range(0, whole, context):
                    out.append((i, a, context, crc(t[a : a + context]), len(t), (s << 32) + sequence, 0, s))
                    sequence += 1
                if whole < len(t):
                    tails.append((i, t, whole))
            if len(out) > 10_000:
                yield emit()
        if shard is not None:
            close(sequence)
            yield emit()
        tidy()

    packed = dealt.select("id", "shard", "tokens").mapInArrow(run, "id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, shard long")
    return packed.withColumnRenamed("id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents").select("doc_id", "text"))
