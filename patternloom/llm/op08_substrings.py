"""Substring dedup: merged count-min sketches rule out windows that occur once; the rest are grouped exactly."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.common import Lexicon, binaries, mix, offsets, prepare, read, runs, save, starts_mask, text_bytes

WINDOW = 35
#: Rows of the sketch, and counters of a row for each byte of text: about two for a window.
DEPTH, COUNTERS_PER_BYTE = 2, 0.5
#: Counters of a slice of a sketch row, merged in one task; hashes of a slice of the exact grouping.
SLICE_BITS, SLICE_HASHES = 23, 2_000_000
#: Bits of a counter's number at most, which leaves as many for a place in a block as any text needs; beyond that size
#: the sketch only rules out fewer windows.
BITS = 38
#: Text of one block of documents, which is read and held at once.
BLOCK_BYTES = 8 << 20
#: Blocks of one slice that are answered in one batch.
ANSWERS = 64
_ODD = ((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F), (0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD))


def rolling(h: np.ndarray, k: int, odd: int) -> np.ndarray:
    """Hash of the k words from each place: a polynomial of the word hashes, by prefix sums modulo 2**64."""
    n = len(h)
    if n < k:
        return np.zeros(0, np.uint64)
    inverse = pow(odd, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, odd, np.uint64)) * np.uint64(inverse)
        down = np.cumprod(np.full(n, inverse, np.uint64)) * np.uint64(odd)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * down)])
        return mix((total[k:] - total[:-k]) * up[: n - k + 1])


class Block:
    """The words of some documents: the distinct ones, and the index of each word of all texts."""

    def __init__(self, words: list[bytes], index: np.ndarray, lens: np.ndarray) -> None:
        self.words, self.index, self.lens = words, index, lens

    @classmethod
    def of(cls, texts: list[bytes]) -> Block:
        lexicon = Lexicon()
        index, lens = lexicon.index([t.split() for t in texts])
        return cls(lexicon.fresh, index, lens)

    def pack(self) -> bytes:
        """Words hold no space, so spaces part them. Indexes go byte plane by byte plane, which squeezes better."""
        joined = b" ".join(self.words)
        head = np.array([len(self.lens), len(self.index), len(joined)], np.int64)
        planes = np.ascontiguousarray(self.index.astype("<u4").view(np.uint8).reshape(-1, 4).T)
        return zstandard.compress(head.tobytes() + self.lens.astype("<i8").tobytes() + planes.tobytes() + joined, 3)

    @classmethod
    def unpack(cls, blob: bytes) -> Block:
        b = zstandard.decompress(blob)
        docs, n, size = np.frombuffer(b, np.int64, 3).tolist()
        lens = np.frombuffer(b, "<i8", docs, 24)
        at = 24 + 8 * docs
        index = np.ascontiguousarray(np.frombuffer(b, np.uint8, 4 * n, at).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)
        return cls(b[at + 4 * n : at + 4 * n + size].split(b" ") if size else [], index, lens)


class Windows:
    """All whole windows of a block of documents: two hashes of each, and its place among the block's words."""

    def __init__(self, block: Block, window: int) -> None:
        self.lens = block.lens
        digests = b"".join(map(xxhash.xxh3_128_digest, block.words))
        h = np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)
        self.place = np.flatnonzero(starts_mask(self.lens, window))
        each = [rolling(h[block.index, j], window, _ODD[0][j])[self.place] if len(self.place) else np.zeros(0, np.uint64) for j in (0, 1)]
        self.h0, self.h1 = each

    def counters(self, row: int, bits: int) -> np.ndarray:
        """The counter of each window in a row of the sketch, which has 2**bits."""
        return mix(self.h0 * np.uint64(_ODD[1][row % 2]) + np.uint64(row)) >> np.uint64(64 - bits)


def squeeze(sorted_values: np.ndarray, more: np.ndarray) -> bytes:
    """Ascending integers as differences, with a flag for each."""
    gap = np.diff(sorted_values, prepend=np.uint64(0)).astype(np.uint32)
    return zstandard.compress(len(gap).to_bytes(4, "little") + np.packbits(more).tobytes() + np.ascontiguousarray(gap.view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unsqueeze(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    b = zstandard.decompress(blob)
    n = int.from_bytes(b[:4], "little")
    flags = -(-n // 8)
    more = np.unpackbits(np.frombuffer(b, np.uint8, flags, 4), count=n).astype(bool)
    gap = np.ascontiguousarray(np.frombuffer(b, np.uint8, 4 * n, 4 + flags).reshape(4, -1).T).view(np.uint32).ravel()
    return np.cumsum(gap.astype(np.int64)), more


def marked(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values (below 2**BITS) ascending, whether each stands more than once, and the index of each input's."""
    low = max(1, len(values).bit_length())
    place = np.sort((values << np.uint64(low)) | np.arange(len(values), dtype=np.uint64))
    values, order = place >> np.uint64(low), (place & np.uint64((1 << low) - 1)).astype(np.int64)
    edge = runs(values)
    n = np.diff(edge)
    inverse = np.empty(len(values), np.int64)
    inverse[order] = np.repeat(np.arange(len(n)), n)
    return values[edge[:-1]], n > 1, inverse


def slices(values: np.ndarray, shift: int) -> list[tuple[int, slice]]:
    """Runs of ascending values that agree above shift bits."""
    top = (values >> np.uint64(shift)).astype(np.int64)
    edge = runs(top)
    return [(int(top[a]), slice(a, b)) for a, b in zip(edge[:-1], edge[1:], strict=True)] if len(values) else []


def repeated(docs: DataFrame, text: str, window: int) -> DataFrame:
    """block, ids, texts (its words, packed), and hits: bits of the windows of the block that occur elsewhere too."""
    spark = docs.sparkSession
    prepare(spark)
    size = text_bytes(docs, text)
    bits = min(BITS, max(SLICE_BITS - 4, int(size * COUNTERS_PER_BYTE).bit_length()))
    low = min(SLICE_BITS, bits)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def sketch(batches):
        held, ids, size, number = [], [], 0, [0]
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()

        def flush():
            block = (task << 24) + number[0]
            number[0] += 1
            words = Block.of(held)
            rows = [(block, -1, None, words.pack(), list(ids))]
            w = Windows(words, window)
            for row in range(DEPTH):
                values, more, _ = marked(w.counters(row, bits))
                for top, part in slices(values, low):
                    rows.append((block, (row << 40) + top, squeeze(values[part] & np.uint64((1 << low) - 1), more[part]), None, None))
            held.clear()
            ids.clear()
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_pydict({"block": pa.array(cols[0], pa.int64()), "slice": pa.array(cols[1], pa.int64()), "blob": pa.array(cols[2], pa.binary()), "texts": pa.array(cols[3], pa.binary()), "ids": pa.array(cols[4], pa.list_(pa.int64()))})

        for batch in batches:
            for i, b in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()).to_pylist(), strict=True):
                held.append(b or b"")
                ids.append(i)
                size += len(b or b"") + 64
                if size >= BLOCK_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    made = save(docs.select(F.col("id").cast("long"), text).mapInArrow(sketch, "block long, slice long, blob binary, texts binary, ids array<long>"), "substrings")
    blocks = made.where("slice < 0").select("block", "ids", "texts")

    def merge(batches):
        for t in by_slice(batches):
            total, blobs = np.zeros(1 << low, np.uint8), t["blob"]
            for b in blobs:  # blobs stay squeezed: only one block's counters are laid out at a time
                at, more = unsqueeze(b.as_py())
                total[at] = np.minimum(total[at] + 1 + more, 2)
            for i in range(0, t.num_rows, ANSWERS):
                part = t.slice(i, ANSWERS)
                bits_of = [np.packbits(total[unsqueeze(b.as_py())[0]] > 1).tobytes() for b in part["blob"]]
                yield from pa.table({"block": part["block"], "slice": part["slice"], "bits": binaries(bits_of)}).to_batches()

    answer = "block long, slice long, bits binary"
    counted = save(made.where("slice >= 0").select("block", "slice", "blob").repartition(n, "slice").sortWithinPartitions("slice", "block").mapInArrow(merge, answer), "substrings-sketch")
    likely = collected(counted, "sketch")
    shift = 64 - max(0, int(size / 6 / SLICE_HASHES)).bit_length()

    def suspects(w: Windows, answers: list[dict]) -> np.ndarray:
        """Windows all of whose counters were met more than once."""
        told = {a["slice"]: a["bits"] for a in answers or ()}
        keep = np.ones(len(w.h0), bool)
        for row in range(DEPTH):
            values, _, inverse = marked(w.counters(row, bits))
            hit = np.zeros(len(values), bool)
            for top, part in slices(values, low):
                hit[part] = np.unpackbits(np.frombuffer(told[(row << 40) + top], np.uint8), count=part.stop - part.start).astype(bool)
            keep &= hit[inverse]
        return np.flatnonzero(keep)

    def grouped_suspects(w: Windows, answers: list[dict]):
        """Suspects' place among windows in order of hash, runs of equal hash, slices of runs."""
        at = suspects(w, answers)
        at = at[np.lexsort((w.h1[at], w.h0[at]))]
        pairs = np.stack([w.h0[at], w.h1[at]], axis=1)
        edge = runs(pairs)
        first = pairs[edge[:-1]]
        top = (first[:, 0] >> np.uint64(shift)).astype(np.int64) if shift < 64 else np.zeros(len(first), np.int64)
        cut = runs(top)
        return at, edge, first, [(int(top[a]), slice(a, b)) for a, b in zip(cut[:-1], cut[1:], strict=True)] if len(first) else []

    def exact(batches):
        for batch in batches:
            for row in batch.to_pylist():
                w = Windows(Block.unpack(row["texts"]), window)
                _, edge, first, cuts = grouped_suspects(w, row["sketch"])
                more = np.diff(edge) > 1
                rows = [(row["block"], top, first[part].tobytes(), np.packbits(more[part]).tobytes()) for top, part in cuts]
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_pydict({"block": pa.array(cols[0], pa.int64()), "slice": pa.array(cols[1], pa.int64()), "blob": pa.array(cols[2], pa.binary()), "more": pa.array(cols[3], pa.binary())})

    def group(batches):
        for t in by_slice(batches):
            got = [np.frombuffer(b, np.uint64).reshape(-1, 2) for b in t["blob"].to_pylist()]
            more = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=len(g)) for b, g in zip(t["more"].to_pylist(), got, strict=True)])
            every = np.concatenate(got)
            order = np.lexsort((every[:, 1], every[:, 0]))
            edge = runs(every[order])
            times = np.add.reduceat(1 + more[order].astype(np.int64), edge[:-1])
            hit = np.empty(len(every), bool)
            hit[order] = np.repeat(times > 1, np.diff(edge))
            off = offsets(np.array([len(g) for g in got]))
            yield from pa.table({"block": t["block"], "slice": t["slice"], "bits": binaries([np.packbits(hit[a:b]).tobytes() for a, b in zip(off[:-1], off[1:], strict=True)])}).to_batches()

    asked = blocks.join(likely, "block", "left").select("block", "texts", "sketch").mapInArrow(exact, "block long, slice long, blob binary, more binary")
    grouped = save(asked.repartition(n, "slice").sortWithinPartitions("slice", "block").mapInArrow(group, answer), "substrings-exact")
    both = blocks.join(likely, "block", "left").join(collected(grouped, "exact"), "block", "left")

    def covered(row: dict) -> tuple[Block, np.ndarray]:
        """The block's words, and which of them lie in a window that occurs elsewhere."""
        block = Block.unpack(row["texts"])
        w = Windows(block, window)
        at, edge, first, cuts = grouped_suspects(w, row["sketch"])
        told = {a["slice"]: a["bits"] for a in row["exact"] or ()}
        hit = np.zeros(len(first), bool)
        for top, part in cuts:
            hit[part] = np.unpackbits(np.frombuffer(told[top], np.uint8), count=part.stop - part.start).astype(bool)
        start = w.place[at[np.repeat(hit, np.diff(edge))]]
        delta = np.zeros(int(w.lens.sum()) + 1, np.int32)
        np.add.at(delta, start, 1)
        np.add.at(delta, start + window, -1)
        return block, np.cumsum(delta[:-1]) > 0

    return both, covered


def by_slice(batches):
    from patternloom.llm.blocks import grouped

    return grouped(batches, ["slice"])


def collected(answers: DataFrame, name: str) -> DataFrame:
    """A row for each block with its answers, one from each slice."""
    return answers.groupBy("block").agg(F.collect_list(F.struct("slice", "bits")).alias(name))


def dedup_substrings(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW, keep_text: bool = True) -> DataFrame:
    """docs(id, text) -> id, n_words, n_removed, kept_sha256 and, if keep_text, kept: a row for each row of docs.

    Words are runs of other than ASCII space. A word goes if a window of `window` words covers it whose sequence also
    starts anywhere else, in the same text or another; a null or empty text, or one shorter than a window, loses nothing.
    kept is the other words joined by one space. Repeated rows lose all their whole windows, as each occurs elsewhere.

    Documents are held in blocks. Each block sends its windows' counters of a count-min sketch, sorted and squeezed, to
    the slices of the sketch; a slice adds up the blocks' sketches and tells each block which of its counters came out
    at two or more, so no task and no broadcast holds a whole sketch. Counters never underestimate: a window with a
    smaller count occurs once. A second pass sends the 128-bit hashes of the rest, each once for a block, to be grouped.
    """
    named = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").alias("text"))
    both, covered = repeated(named, "text", window)

    def finish(batches):
        for batch in batches:
            for row in batch.to_pylist():
                block, gone = covered(row)
                lens, get = block.lens, block.words.__getitem__
                off = offsets(lens)
                lost = np.concatenate([[0], np.cumsum(gone)])
                removed = lost[off[1:]] - lost[off[:-1]]
                out = []
                for k in range(len(lens)):
                    index = block.index[off[k] : off[k + 1]]
                    out.append(b" ".join(map(get, (index[~gone[off[k] : off[k + 1]]] if removed[k] else index).tolist())))
                cols = {"id": pa.array(row["ids"], pa.int64()), "n_words": pa.array(lens), "n_removed": pa.array(removed.astype(np.int64)), "kept_sha256": pa.array([hashlib.sha256(x).hexdigest() for x in out])}
                if keep_text:
                    cols["kept"] = pa.array(out, pa.binary()).cast(pa.string())
                t = pa.table(cols)
                yield from t.to_batches(max_chunksize=2000)

    schema = "id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return both.select("block", "ids", "texts", "sketch", "exact").mapInArrow(finish, schema).withColumnRenamed("id", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(read(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False)
