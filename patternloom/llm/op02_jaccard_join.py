"""N-gram Jaccard join by parity sketches: pigeonhole on sketch parts per size band, then exact verification."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.blocks import forest, grouped, map_blocks, neighbour_blocks
from patternloom.llm.common import WordHashes, binaries, chunks, forget, grams, join_counted, map_chunks, mix, neutral, neutral_name, offsets, prepare, read, runs, save, tidy
from patternloom.llm.components import components

#: Bits of one part of a sketch. Only its fingerprint is kept, so that width costs nothing.
PART_BITS = 1024
#: A size band reaches from BAND**k to BAND**(k + 1).
BAND = 1.5
#: Parts besides those that the pigeonhole needs; each set leaves as many of its emptiest parts unused.
SPARE = 0.12
#: Bits at most of the bitmap of wanted texts that tasks get: 16 MB.
BITMAP_BITS = 27
#: Classes with an equal key up to which all their pairs are looked at.
SMALL = 8
#: Clusters of candidates up to this size are verified in one block.
WHOLE = 256
#: Keys that a task sorts at once before they are dealt, and pairs that it holds to leave out repeated ones.
HELD = 1_000_000
#: A key is dealt by its first BUCKET bits; beside these it goes by its last REST bits.
BUCKET, REST = 12, 36
#: What is dealt by bucket: rows, pairs of classes (u, v, hub), and packed keys.
DEALT = "bucket int, id long, cls long, n long, th long, sketch binary, u long, v long, hub boolean, keys binary"
#: What buckets give: rows and pairs.
MET = DEALT.removeprefix("bucket int, ").removesuffix(", keys binary")
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[bytes], hashes: WordHashes, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct k-word shingles of all texts as 64-bit hashes, sorted within each text; set sizes; 128-bit set digests."""
    h, lens = hashes.of([t.split() for t in texts])
    off = offsets(lens)
    doc = np.repeat(np.arange(len(texts)), lens)
    s = np.zeros(len(h), np.uint64)
    g = grams(h[:, 0], k, _ODD[0])
    s[: len(g)] = g
    keep = np.arange(len(h)) + k <= off[1:][doc]
    short = np.flatnonzero((lens > 0) & (lens < k))  # the whole sequence is the one shingle
    for d in short.tolist():
        row = h[off[d] : off[d + 1], 0]
        s[off[d]], keep[off[d]] = mix(grams(row, len(row), _ODD[0]) ^ np.uint64(len(row))).item() if len(row) else 0, True
    s, doc = s[keep], doc[keep]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    s, doc = s[new], doc[new]
    sizes = np.bincount(doc, minlength=len(texts))
    digest = np.zeros((len(texts), 2), np.uint64)
    full = sizes > 0
    for j in (0, 1):
        if len(s):
            digest[full, j] = mix(np.add.reduceat(mix(s ^ np.uint64(_ODD[j])), offsets(sizes)[:-1][full]) + sizes[full].astype(np.uint64))
    return s, sizes, digest


def budget(n: int, threshold: float) -> int:
    """The largest symmetric difference of a set of n with a set that is similar enough: the partner has n / threshold."""
    return int(math.floor(n * (1 - threshold) / threshold + 1e-9))


def schemes(n: int, threshold: float) -> range:
    """Size bands in whose sketch a set of n must appear: its own, and those above where a partner may lie."""
    band = lambda x: int(math.floor(math.log(x) / math.log(BAND) + 1e-9))
    return range(band(n), band(n / threshold) + 1)


def parts(band: int, threshold: float) -> int:
    most = budget(int(math.ceil(BAND ** (band + 1))), threshold) + 1
    return most if most == 1 else int(math.ceil(most * (1 + SPARE))) + 1


def sketch_keys(shingles: np.ndarray, band: int, threshold: float) -> np.ndarray:
    """Fingerprints of the sketch parts that stand for a set in a band.

    Each shingle flips one bit of the band's sketch, so two sketches differ in at most as many bits as the sets differ
    in shingles, and of p parts at least p - d are equal. A set whose differences are at most d therefore may leave out
    p - d - 1 parts and still share one with every partner, provided that both leave out by the same order of part
    contents: here the parts with fewest bits go first.
    """
    n, p = len(shingles), parts(band, threshold)
    place = mix(shingles + np.uint64(band * 2 + 1)) % np.uint64(p * PART_BITS)
    place.sort()
    edge = runs(place)
    odd = place[edge[:-1]][np.diff(edge) % 2 == 1]
    part = (odd // np.uint64(PART_BITS)).astype(np.int64)
    bits = np.bincount(part, minlength=p)
    content = np.zeros(p, np.uint64)
    if len(part):
        held = np.flatnonzero(bits)
        content[held] = np.add.reduceat(mix(odd ^ np.uint64(_ODD[1])), offsets(bits[held])[:-1])
    key = mix(content ^ mix(np.arange(p, dtype=np.uint64) + np.uint64((band + 7) << 32)))
    order = np.lexsort((key, bits))
    return key[order[p - min(p, budget(n, threshold) + 1) :]]


def joined_rows(docs: DataFrame, id: str, text: str, k: int, threshold: float) -> DataFrame:
    """A row for each row of docs: id, th (hash of the text), n, component, component_id, n_links."""
    spark = docs.sparkSession
    prepare(spark)
    bound = int(round(threshold * 10_000))

    def digest_once():
        hashes, seen = WordHashes(), set()

        def step(t: pa.Table, texts: list[bytes]) -> tuple[pa.Table, pa.RecordBatch | None]:
            """The rows of a chunk, and one value in which its keys are."""
            s, sizes, digest = shingle_sets([x.lower() for x in texts], hashes, k)
            off = offsets(sizes)
            cls = digest[:, 0].view(np.int64)
            rows, keys = [], []
            for d in np.flatnonzero(sizes).tolist():
                c = int(cls[d])
                if c in seen:
                    continue
                if len(seen) > 500_000:
                    seen.clear()
                seen.add(c)
                mine = s[off[d] : off[d + 1]]
                for band in schemes(len(mine), threshold):
                    got = sketch_keys(mine, band, threshold)
                    keys.append(got)
                    rows.append(c)
            whole, ids = pa.array(cls, mask=sizes == 0), t["id"].to_pylist()
            spread = mix(np.array([i if x is None else x for i, x in enumerate(ids)], np.int64).view(np.uint64)) >> np.uint64(64 - BUCKET)
            told = dealt_rows(bucket=pa.array(spread.astype(np.int32)), id=t["id"], cls=whole, n=pa.array(sizes.astype(np.int64)), th=t["th"], sketch=binaries([parity_sketch(s[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)]))
            if not keys:
                return told, None
            held = b"".join([np.array([len(keys)], np.int64).tobytes(), np.array(rows, np.int64).tobytes(), np.array([len(x) for x in keys], np.int64).tobytes(), *(x.tobytes() for x in keys)])
            return told, pa.RecordBatch.from_pydict({"keys": binaries([held])})

        return step

    def digest(batches):
        step, aside = digest_once(), []

        def folded():
            for t, texts in chunks(batches, "text"):
                told, keys = step(t, texts)
                aside.append(told)
                if keys is not None:
                    yield keys

        for b in packed(unfolded(folded())):
            while aside:
                yield from aside.pop().to_batches(max_chunksize=20_000)
            yield b
        for told in aside:
            yield from told.to_batches(max_chunksize=20_000)
        tidy()

    hashed = docs.select(F.col(f"`{id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))
    # keys, of which there are about as many bytes as of texts, are shuffled once and never written to the shared folder
    both = save(met(hashed.mapInArrow(digest, DEALT)), "jaccard")
    rows = both.where("n is not null").select("id", "cls", "n", "th", "sketch")  # each use reads the columns that it needs
    classes = rows.where("cls is not null").groupBy(F.col("cls").alias("node")).agg(F.min("id").alias("low"), F.min("th").alias("th"), F.min("n").alias("n"), F.min("sketch").alias("sketch"), F.count("*").alias("copies"))
    classes = save(classes, "jaccard-classes")
    pairs = save(once_each(both), "jaccard-pairs")
    cluster = save(components(likely(pairs, classes, threshold)), "jaccard-clusters")
    forget(pairs)
    members = save(cluster.join(classes.select("node", "th", "n", "copies"), "node").select(F.col("node").alias("id"), F.col("component").alias("grp"), "th", "n", "copies"), "jaccard-members")
    sizes = members.groupBy("grp").agg(F.count("*").alias("rows"))
    banded = members.join(sizes, "grp").withColumn("band", F.when(F.col("rows") <= WHOLE, F.lit(0)).otherwise(F.floor(F.log(F.col("n") + 0.0) / F.lit(-math.log(threshold)) + 1e-9)).cast("int"))
    blocks = neighbour_blocks(banded.select("grp", "band", "id", "copies"), WHOLE)
    found = save(verify(hashed, members.select("th", "id"), blocks, k, bound), "jaccard-links")
    linked = components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("deg").alias("deg"))
    named = classes.select("node", "low", "copies").join(linked, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    named = save(named.select(F.col("node").alias("cls"), "component", "low", (F.col("copies") - 1 + F.coalesce("deg", F.lit(0))).alias("n_links")), "jaccard-linked")
    low = save(named.groupBy("component").agg(F.min("low").alias("component_id"), F.count("*").alias("classes")), "jaccard-low")
    told = save(join_counted(named, low, "component", "classes").select("cls", "component", "component_id", "n_links"), "jaccard-named")
    forget(cluster, members, found, classes, named, low)
    out = rows.join(told, "cls", "left")
    return out.select("id", "th", "n", "component", F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))


def parity_sketch(shingles: np.ndarray) -> bytes:
    """One parity bit for each 2**k places that shingles hash to, with at least as many places as shingles."""
    m = 1 << max(6, (len(shingles) - 1).bit_length())
    return np.packbits((np.bincount((mix(shingles ^ np.uint64(_ODD[1])) & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).astype(np.uint8), bitorder="little").tobytes()


def hamming(a: bytes, b: bytes) -> int:
    """Different bits of two sketches, the longer folded to the shorter: at most the sets' symmetric difference."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = len(a), len(b)
    while n > m:
        n //= 2
        x = (x >> 8 * n) ^ (x & (1 << 8 * n) - 1)
    while m > n:
        m //= 2
        y = (y >> 8 * m) ^ (y & (1 << 8 * m) - 1)
    return (x ^ y).bit_count()


def similarity_join(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs(id, text) -> id, n_shingles, component_id, n_links: one row per row of docs.

    Words are runs of other than ASCII space; A-Z count as a-z. A text with fewer than k words is one shingle; one
    without words (null, empty, blank) links with nothing and is its own component. Rows link when the Jaccard
    similarity of their sets is at least threshold; equal sets always do. component_id is the smallest id reachable,
    null only where no row of the component has an id. Repeated rows are rows of their own.

    Rows are first reduced to classes of equal sets, so copies cost nothing further. Sketch parts meet by sorting. Pairs
    with an equal part whose whole sketches differ in more bits than similar sets differ in shingles are dropped; classes
    that share a part with very many others are linked to one of those. The components of what is left are the candidate
    clusters, and all pairs of a cluster are verified exactly on the shingle sets, in blocks of bounded size; only as many
    links as connect the rows leave a block.
    """
    return joined_rows(docs, id, text, k, threshold).select(F.col("id").alias(id), F.col("n").alias("n_shingles"), "component_id", "n_links")


def unfolded(batches):
    """(key, cls, hub) rows of the values in which chunks hold theirs; hub is null.

    A key that more than SMALL classes of a task share goes on for the first of them alone, to which the others are linked
    here (rows with hub): a key of very many classes reaches its task as a few rows from each task.
    """

    def flush(held: list[np.ndarray]):
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        rows = rows[runs(rows)[:-1]]
        edge = runs(rows[:, 0])
        size = np.diff(edge)
        long = np.repeat(size > SMALL, size)
        head = np.repeat(rows[edge[:-1], 1], size) if len(rows) else rows[:, 1]
        first = np.zeros(len(rows), bool)
        first[edge[:-1]] = True
        tied = long & ~first
        t = pa.table({"key": pa.array(rows[:, 0].copy()), "cls": pa.array(rows[:, 1].copy()), "hub": pa.array(head.copy(), mask=~tied)})
        yield from t.to_batches(max_chunksize=50_000)

    held, size = [], 0
    for batch in batches:
        for b in batch.column(0).to_pylist():
            n = int(np.frombuffer(b, np.int64, 1)[0])
            cls, lens = np.frombuffer(b, np.int64, 2 * n, 8).reshape(2, n)
            held.append(np.stack([np.frombuffer(b, np.int64, -1, 8 + 16 * n), np.repeat(cls, lens)], axis=1))
            size += len(held[-1])
            if size > HELD:
                yield from flush(held)
                held, size = [], 0
    if held:
        yield from flush(held)
    tidy()


def dealt_rows(**columns: pa.Array) -> pa.Table:
    """A table as DEALT has it; columns that aren't given are null."""
    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}
    n = len(next(iter(columns.values())))
    return pa.table({c: columns.get(c, pa.nulls(n, kinds[kind])) for c, kind in (x.split() for x in DEALT.split(", "))})


def packed(batches):
    """(key, cls, hub) rows as DEALT has them: for each bucket of a batch one value, which holds its keys in about four bytes
    each and their classes in eight. Rows that have a hub are pairs."""
    for batch in batches:
        key, cls, tied = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).is_valid().to_numpy(zero_copy_only=False))
        if tied.any():
            links = np.unique(np.stack([cls[tied], batch.column(2).filter(batch.column(2).is_valid()).to_numpy()], axis=1), axis=0)
            spread = mix(links[:, 0].view(np.uint64)) >> np.uint64(64 - BUCKET)
            yield from dealt_rows(bucket=pa.array(spread.astype(np.int32)), u=pa.array(links[:, 0].copy()), v=pa.array(links[:, 1].copy()), hub=pa.array(np.ones(len(links), bool))).to_batches()
            key, cls = key[~tied], cls[~tied]
        if not len(key):
            continue
        bucket = (key.view(np.uint64) >> np.uint64(64 - BUCKET)).astype(np.int32)
        rest = key & ((1 << REST) - 1)
        order = np.lexsort((cls, rest, bucket))
        bucket, rest, cls = bucket[order], rest[order], cls[order]
        edge = runs(bucket)
        step = np.diff(rest, prepend=0)
        step[edge[:-1]] = rest[edge[:-1]]
        width = [(x.bit_length() + 7) // 8 for x in np.maximum.reduceat(step, edge[:-1]).tolist()]
        low = step.view(np.uint8).reshape(-1, 8)
        values = [bytes([w]) + low[a:b, :w].tobytes() + cls[a:b].tobytes() for w, a, b in zip(width, edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        yield from dealt_rows(bucket=pa.array(bucket[edge[:-1]]), keys=binaries(values)).to_batches()


def unpacked(value: bytes) -> np.ndarray:
    """The (key, cls) rows of a value of packed(), without the key's bucket."""
    w = value[0]
    n = (len(value) - 1) // (w + 8)
    low = np.zeros((n, 8), np.uint8)
    low[:, :w] = np.frombuffer(value, np.uint8, n * w, 1).reshape(n, w)
    return np.stack([np.cumsum(low.view(np.int64).ravel()), np.frombuffer(value, np.int64, n, 1 + n * w)], axis=1)


def pairs_of(rows: np.ndarray) -> np.ndarray:
    """(u, v, hub) of the (key, cls) rows of a bucket: pairs of classes with an equal key.

    A run of up to SMALL classes gives all its pairs. A longer one links each class to its first (hub 1), which keeps
    the run together: such a link stands for pairs that it doesn't name, so it mustn't be dropped.
    """
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    rows = rows[runs(rows)[:-1]]  # a class may stand in a run more than once
    edge, c = runs(rows[:, 0]), rows[:, 1]
    size, first = np.diff(edge), edge[:-1]
    out = [np.empty((0, 3), np.int64)]
    for g in range(2, SMALL + 1):
        at = first[size == g]
        if len(at):
            x, y = np.triu_indices(g, 1)
            out.append(np.stack([c[(at[:, None] + y).ravel()], c[(at[:, None] + x).ravel()], np.zeros(len(at) * len(x), np.int64)], axis=1))
    for a, n in zip(first[size > SMALL].tolist(), size[size > SMALL].tolist(), strict=True):
        out.append(np.stack([c[a + 1 : a + n], np.full(n - 1, c[a]), np.ones(n - 1, np.int64)], axis=1))
    return np.concatenate(out)


def met(dealt: DataFrame) -> DataFrame:
    """The rows of DEALT as MET has them: keys become the pairs of classes that share one, other rows stay."""
    n = int(dealt.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        found, size, held, last = [], 0, [], None

        def told():
            rows = np.concatenate(found)
            rows = rows[np.lexsort((-rows[:, 2], rows[:, 1], rows[:, 0]))]
            rows = rows[runs(rows[:, :2])[:-1]]
            t = dealt_rows(bucket=pa.nulls(len(rows), pa.int32()), u=pa.array(rows[:, 0].copy()), v=pa.array(rows[:, 1].copy()), hub=pa.array(rows[:, 2] > 0))
            yield from t.drop_columns(["bucket", "keys"]).to_batches(max_chunksize=50_000)

        for batch in batches:
            packs = batch.column(batch.num_columns - 1)
            other = batch.filter(packs.is_null())
            if other.num_rows:
                yield other.select(other.schema.names[1:-1])
            for bucket, value in zip(batch.column(0).to_pylist(), packs.to_pylist(), strict=True):
                if value is None:
                    continue
                if bucket != last and held:
                    found.append(pairs_of(np.concatenate(held)))
                    size, held = size + len(found[-1]), []
                    if size > HELD:
                        yield from told()
                        found, size = [], 0
                held.append(unpacked(value))
                last = bucket
        if held:
            found.append(pairs_of(np.concatenate(held)))
        if found:
            yield from told()
        tidy()

    return dealt.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(run, MET)


def once_each(found: DataFrame) -> DataFrame:
    """found(u, v, hub) -> each pair once."""
    return found.where("u is not null").groupBy("u", "v").agg(F.max("hub").alias("hub"))


def candidate_pairs(keys: DataFrame) -> DataFrame:
    """keys(key, cls, hub) -> (u, v, hub): pairs of classes with an equal key. Rows that have a hub are such pairs already."""
    return once_each(met(keys.mapInArrow(packed, DEALT)))


def likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """(u, v) of pairs, without those whose sizes or sketches show that they differ too much."""
    side = lambda c: classes.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("sketch").alias(f"s_{c}"))
    named = pairs.where("not hub").join(side("u"), "u").join(side("v"), "v")
    sized = named.where(F.least("n_u", "n_v") >= threshold * F.greatest("n_u", "n_v") - 1e-6)

    def near(batches):
        for batch in batches:
            t = batch.to_pydict()
            ok = [hamming(a, b) <= budget(min(x, y), threshold) for a, b, x, y in zip(t["s_u"], t["s_v"], t["n_u"], t["n_v"], strict=True)]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["u", "v"])

    kept = sized.select("u", "v", "n_u", "n_v", "s_u", "s_v").mapInArrow(near, "u long, v long")
    return kept.unionByName(pairs.where("hub").select("u", "v"))


def wanted(hashes: DataFrame):
    """A test of a column of hashes that holds for all of hashes(th) and few others: a bitmap of bounded size.

    What passes it still has to be joined; what fails need not be moved. With more hashes than bits it passes most.
    """
    spark = hashes.sparkSession
    each = save(hashes.select("th").distinct(), "wanted")
    bits = min(BITMAP_BITS, max(16, (16 * each.count()).bit_length()))
    low = min(bits, 20)
    place = F.pmod(F.xxhash64("th"), F.lit(1 << bits))
    rows = each.select((place / (1 << low)).cast("long").alias("slice"), F.pmod(place, F.lit(1 << low)).alias("at"))
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "slice").sortWithinPartitions("slice")

    def draw(batches):
        for t in grouped(batches, ["slice"]):
            part = np.zeros(1 << low, bool)
            part[t["at"].to_numpy()] = True
            yield pa.RecordBatch.from_pydict({"slice": pa.array([t["slice"][0].as_py()], pa.int64()), "bits": binaries([np.packbits(part).tobytes()])})

    whole = np.zeros((1 << bits - low, (1 << low) // 8), np.uint8)
    for r in dealt.mapInArrow(draw, "slice long, bits binary").toLocalIterator():  # 2**bits bits at most
        whole[r.slice] = np.frombuffer(r.bits, np.uint8)
    held = spark.sparkContext.broadcast(whole.ravel())
    forget(each)

    @F.pandas_udf("boolean")
    def test(at: pd.Series) -> pd.Series:
        x = at.to_numpy()
        return pd.Series((held.value[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1).astype(bool))

    return lambda th: test(F.pmod(F.xxhash64(th), F.lit(1 << bits)))


def verify(hashed: DataFrame, need: DataFrame, blocks: DataFrame, k: int, bound: int) -> DataFrame:
    """(a, b, deg): links that connect a with b, or b null and the number of rows that link with a in a block."""

    def sets_once():
        hashes, seen = WordHashes(), set()

        def step(t: pa.Table, texts: list[bytes]) -> pa.Table:
            ids = t["id"].to_pylist()
            first = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
            s, sizes, digest = shingle_sets([texts[i].lower() for i in first], hashes, k)
            off = offsets(sizes)
            same = [j for j, i in enumerate(first) if int(digest[j, 0].view(np.int64)) == ids[i]]
            return pa.table({"id": pa.array([ids[first[j]] for j in same], pa.int64()), "shingles": binaries([s[off[j] : off[j + 1]].tobytes() for j in same])})

        return step

    # as many rows as there are candidates: never a side to broadcast
    texts = hashed.select("th", "text").where(wanted(need)("th")).join(need.hint("shuffle_merge"), "th")
    sets = map_chunks(texts, "text", None, "id long, shingles binary", once=sets_once).dropDuplicates(["id"])

    def compare(t: pa.Table, side: np.ndarray, across: bool) -> pa.Table | None:
        held = [np.frombuffer(b, np.uint64) for b in t["shingles"].to_pylist()]
        sizes = np.array([len(x) for x in held])
        n = len(held)
        value, inverse, count = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(n), sizes)
        shared = count[inverse] > 1
        column = (np.cumsum(count > 1) - 1)[inverse[shared]]
        row, width = row[shared], int((count > 1).sum())
        both = np.zeros((n, n), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for at in range(0, width, 4096):
            a, b = np.searchsorted(column, [at, at + 4096])
            m = np.zeros((n, min(4096, width - at)), np.float32)
            m[row[a:b], column[a:b] - at] = 1
            both += m @ m.T
        both = both.astype(np.int64)
        union = sizes[:, None] + sizes[None, :] - both
        ok = 10_000 * both >= bound * union
        if across:
            ok &= side[:, None] != side[None, :]
        np.fill_diagonal(ok, False)
        if not ok.any():
            return None
        ids, copies = t["id"].to_numpy(), t["copies"].to_numpy()
        deg = ok @ copies
        a, b = np.nonzero(np.triu(ok))
        links = forest(n, a, b)
        x, y = np.array([p for p, _ in links], np.int64), np.array([q for _, q in links], np.int64)
        some = np.flatnonzero(deg)
        return pa.table({"a": pa.array(np.concatenate([ids[x], ids[some]])), "b": pa.concat_arrays([pa.array(ids[y]), pa.nulls(len(some), pa.int64())]), "deg": pa.array(np.concatenate([np.zeros(len(x), np.int64), deg[some]]))})

    return map_blocks(blocks.join(sets, "id"), compare, "a long, b long, deg long")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """docs with one row of each group of similar rows: the one with the smallest id. Rows without words all stay.

    All columns of docs are given back as they were, whatever they are called.
    """
    plain = neutral(docs)
    i, t = neutral_name(docs, id), neutral_name(docs, text)
    links = joined_rows(plain, i, t, k, threshold)
    links = save(links.where("component is not null").select("id", "th", "component"), "jaccard-rows")
    order = F.struct(F.col("id").isNull().alias("none"), "id", "th")
    groups = save(links.groupBy("component").agg(F.min(order).alias("b"), F.count("*").alias("rows")).where("rows > 1"), "jaccard-groups")
    best = groups.select(F.xxhash64("b.id", "b.th").alias("row")).distinct()
    crowded = save(join_counted(links, groups.select("component", "rows"), "component", "rows").select("id", "th"), "jaccard-crowded")
    # most rows are in no group and stay where they are
    rows = crowded.select(F.xxhash64("id", "th").alias("row")).distinct()
    verdict = rows.join(best.withColumn("best", F.lit(True)), "row", "left").select("row", F.coalesce("best", F.lit(False)).alias("best"))
    named = plain.withColumn("th", F.xxhash64(F.coalesce(t, F.lit("")))).withColumn("row", F.xxhash64(F.col(i).cast("long"), "th"))
    named = named.withColumn("near", wanted(crowded)("th"))
    some = named.where("near").join(verdict, "row", "left")  # without a verdict a row is in no group
    kept = some.where("best").dropDuplicates(["row"])  # repeated rows too are one group
    out = named.where("not near").select(*plain.columns).unionByName(some.where("best is null").select(*plain.columns)).unionByName(kept.select(*plain.columns))
    return out.toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(read(spark, sf_dir, "documents").select("doc_id", "text"), k=4, threshold=0.85)
