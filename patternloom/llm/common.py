"""What the operators of this subpackage share: reading, shared storage, whole-text chunks, word tables.

Row-level contract used everywhere: a null text counts as empty, repeated rows are rows of their own, columns that an
operator does not name are passed on or left out, never interpreted, and an empty table gives an empty result with the
same schema. Operators that return their input's columns work under neutral names, so no name can clash.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.shipping import ship

#: Text that a Python worker holds at once, in bytes; one longer document is a chunk of its own.
CHUNK_BYTES = 2 << 20
#: Spark's setting by which a query's shuffle files are deleted when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Distinct words that a worker remembers before it starts afresh.
LEXICON_WORDS = 200_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset (tests on one machine) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="patternloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it again: later steps start from the files.

    The shuffle files behind it go at once; else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/patternloom/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def forget(*saved: DataFrame) -> None:
    """Delete the files of saved tables that no later result reads."""
    for df in saved:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df._saved_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def neutral(docs: DataFrame) -> DataFrame:
    """docs with its columns named c0, c1 ... by place; .toDF(*docs.columns) gives them their names back."""
    return docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))


def neutral_name(docs: DataFrame, name: str) -> str:
    """What neutral() calls a column: the one of exactly this name, else of this name in other case."""
    cols = docs.columns
    return f"c{cols.index(name) if name in cols else [c.lower() for c in cols].index(name.lower())}"


def prepare(spark: SparkSession) -> None:
    """Small Arrow batches: a batch of long documents, or of blocks of them, must fit beside the heap."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(CHUNK_BYTES))


def tidy() -> None:
    """Give memory back: a worker outlives its task, and the next one may be of another kind."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has no such call
        ctypes.CDLL(None).malloc_trim(0)


def chunks(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.Table, list[bytes]]]:
    """Batches joined until they hold limit bytes of text: the table and its texts as UTF-8."""
    held: list[pa.RecordBatch] = []
    texts: list[bytes] = []
    size = 0

    def flush():
        return pa.Table.from_batches(held).combine_chunks(), texts

    for batch in batches:
        got = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
        start = 0
        for i, b in enumerate(got):
            size += len(b or b"") + 64
            if size >= limit:
                held.append(batch.slice(start, i + 1 - start))
                texts.extend(b or b"" for b in got[start : i + 1])
                yield flush()
                held, texts, size, start = [], [], 0, i + 1
        if start < len(got):
            held.append(batch.slice(start))
            texts.extend(b or b"" for b in got[start:])
    if held:
        yield flush()


def map_chunks(df: DataFrame, text: str, fn: Callable[[pa.Table, list[bytes]], pa.Table | Iterable[pa.Table]], schema: str, limit: int = CHUNK_BYTES, once: Callable | None = None) -> DataFrame:
    """fn over chunks of whole documents. once() runs in each task and makes fn where fn is None (per-task state)."""

    def run(batches):
        step = once() if once else fn
        for table, texts in chunks(batches, text, limit):
            out = step(table, texts)
            for t in [out] if isinstance(out, pa.Table) else out:
                yield from t.to_batches(max_chunksize=20_000)
        step = table = texts = out = t = None
        tidy()

    return df.mapInArrow(run, schema)


#: bytes.split() cuts at exactly \\x20 and \\x09-\\x0D.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
#: A-Z lower-cased; digits, a-z and all bytes of non-ASCII characters are word bytes, other ASCII becomes a space.
ALNUM = bytes((c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32) for c in range(256))


class Lexicon(dict):
    """word -> dense index, in order of first sight; fresh lists words not yet given their arrays."""

    def __init__(self) -> None:
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = i = len(self)
        self.fresh.append(word)
        return i

    def index(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Index of each word of all texts in one array, and the word count of each text."""
        lens = np.fromiter(map(len, texts), np.int64, len(texts))
        get = self.__getitem__
        out = np.empty(int(lens.sum()), np.int64)
        at = 0
        for words in texts:
            out[at : at + len(words)] = np.fromiter(map(get, words), np.int64, len(words))
            at += len(words)
        return out, lens


class WordHashes:
    """Two independent 64-bit hashes for each word, remembered in a bounded table."""

    def __init__(self) -> None:
        self.reset()

    def reset(self) -> None:
        self.words, self.h = Lexicon(), np.empty((0, 2), np.uint64)

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.words) > LEXICON_WORDS:
            self.reset()
        index, lens = self.words.index(texts)
        if self.words.fresh:
            digests = b"".join(map(xxhash.xxh3_128_digest, self.words.fresh))
            self.h = np.concatenate([self.h, np.frombuffer(digests, ">u8").astype(np.uint64).reshape(-1, 2)])
            self.words.fresh = []
        return self.h[index], lens


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits whose every output bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def grams(h: np.ndarray, k: int, odd: int) -> np.ndarray:
    """Hash of the k words that start at each place; the last k - 1 places hold no whole gram."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = h[:n].copy()
    for j in range(1, k):
        out *= np.uint64(odd)
        out += h[j : j + n]
    return mix(out)


def offsets(lens: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)


def starts_mask(lens: np.ndarray, k: int) -> np.ndarray:
    """True at places of the joined texts where a whole k-gram of one text starts."""
    off = offsets(lens)
    delta = np.zeros(int(off[-1]) + 1, np.int32)
    whole = lens >= k
    np.add.at(delta, off[:-1][whole], 1)
    np.add.at(delta, off[1:][whole] - k + 1, -1)
    return np.cumsum(delta[:-1]) > 0


def runs(keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows in a sorted array, and its length."""
    if not len(keys):
        return np.zeros(1, np.int64)
    new = keys[1:] != keys[:-1]
    if new.ndim > 1:
        new = new.any(axis=1)
    return np.concatenate([[0], np.flatnonzero(new) + 1, [len(keys)]]).astype(np.int64)


def binaries(parts: list[bytes]) -> pa.Array:
    return pa.array(parts, pa.binary())


def text_bytes(docs: DataFrame, text: str) -> int:
    return docs.agg(F.sum(F.octet_length(text))).first()[0] or 0


#: A key of more rows than this, and than a thousandth of all, is looked up from a broadcast of at most 1,000 rows.
HOT = 1_000


def join_counted(df: DataFrame, side: DataFrame, on: str, count: str) -> DataFrame:
    """df joined (inner) with side, which has a row for each key and in `count` how many rows of df have it.

    Rows of hot keys are not shuffled, so no task gets more than a thousandth of df for one key. side is read several
    times: a saved table. The column count is left out.
    """
    limit = max(HOT, (side.agg(F.sum(count)).first()[0] or 0) // 1_000)
    hot, cold = side.where(F.col(count) > limit).drop(count), side.where(F.col(count) <= limit).drop(count)
    first = df.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on, "left")
    return first.where("_hot").drop("_hot").unionByName(first.where("_hot is null").select(*df.columns).join(cold, on))
