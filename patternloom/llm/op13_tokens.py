"""Token counts: a broadcast table of frequent pre-tokens' lengths, worker caches for the rest; no pre-token is shuffled."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.common import binaries, chunks, map_chunks, prepare, read, tidy

MODEL = "piece_bpe_32k.model"
CONTEXT = 4096
#: Entries of the broadcast table, none longer than LONG bytes: at most 5 MB.
TABLE, LONG = 65_536, 64
#: Partitions that are looked at for frequent pre-tokens, and the bytes read of each. What they miss costs time, no count.
SAMPLED_PARTS, SAMPLED_BYTES = 16, 4 << 20
#: Pre-tokens that a worker remembers beside the table before it starts afresh.
CACHE = 400_000
#: Text that is cut at once.
STEP = 1 << 20

#: The library's mark of a space, which in a text means the same as one.
MARK = "▁".encode()
#: A line end, or what begins with spaces or after a line end and goes on to the next of either.
CUT = re.compile(rb"\n| +[^ \n]*|[^ \n]+")
BETWEEN = re.compile(rb"(?<=\n)|(?<=[^ ])(?= )")


def separable(model: bytes, pieces: list[str]) -> bool:
    """Whether no token of a model can reach over a cut: byte pairs without normalization, a space first or none at all in
    every piece, no line end in any, no strings taken out beforehand."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    proto.ParseFromString(model)
    how, kinds = proto.normalizer_spec, {p.type for p in proto.pieces}
    plain = not how.precompiled_charsmap and not how.normalization_rule_tsv and how.add_dummy_prefix and not how.remove_extra_whitespaces and how.escape_whitespaces
    return plain and proto.trainer_spec.model_type == 2 and not proto.trainer_spec.treat_whitespace_as_suffix and kinds <= {1, 2, 3, 6} and not any("▁" in p.lstrip("▁") or "\n" in p for p in pieces)


class Encoder:
    """Lengths as the library gives them, without begin and end."""

    def __init__(self, name: str) -> None:
        import public_tokenizers
        import sentencepiece

        with open(public_tokenizers.path(name), "rb") as f:
            model = f.read()
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.cuts = separable(model, [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())])

    def whole(self, text: bytes) -> int:
        return len(self.sp.encode(text.decode(errors="replace")))

    def piece(self, piece: bytes) -> int:
        """Tokens of a pre-token inside a text: the line end before it parts it from the space that the library puts first."""
        return 1 if piece == b"\n" else self.whole(b"\n" + piece) - 2


class Lengths(dict):
    """Tier one: the frequent pre-tokens. Others are looked up in the worker's cache, tier two, and encoded where that has
    none."""

    def __init__(self, encoder: Encoder, frequent: dict[bytes, int]) -> None:
        super().__init__(frequent)
        self.encoder, self.cache = encoder, {}

    def __missing__(self, piece: bytes) -> int:
        n = self.cache.get(piece)
        if n is None:
            n = self.encoder.piece(piece)
            if len(piece) <= LONG:
                if len(self.cache) >= CACHE:
                    self.cache.clear()
                self.cache[piece] = n
        return n

    def count(self, text: bytes) -> int:
        return sum(sum(map(self.__getitem__, pieces)) for pieces in pre_tokens(text)) if self.encoder.cuts else self.encoder.whole(text)


def pre_tokens(text: bytes) -> Iterator[list[bytes]]:
    """The text's pre-tokens, those of about a megabyte at a time; an empty text has none."""
    if text:
        text = b" " + text.replace(MARK, b" ")
    at = 0
    while at < len(text):
        cut = BETWEEN.search(text, at + STEP) if at + STEP < len(text) else None
        end = cut.start() if cut else len(text)
        yield CUT.findall(text, at, end)
        at = end


_encoders: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    if name not in _encoders:
        _encoders[name] = Encoder(name)
    return _encoders[name]


def frequent(docs: DataFrame, text: str, model: str) -> tuple[bytes, bytes]:
    """The table as it is broadcast: pre-tokens joined by line ends, and their lengths as unsigned 16-bit numbers.

    SAMPLED_PARTS partitions count what begins them; each returns at most TABLE counts.
    """
    if not encoder(model).cuts:
        return b"", b""
    stride = max(1, docs.rdd.getNumPartitions() // SAMPLED_PARTS)

    def run(batches):
        seen: Counter = Counter()
        size = 0
        for _, texts in chunks(batches, "t", 1 << 18) if TaskContext.get().partitionId() % stride == 0 else ():
            for t in texts:
                for pieces in pre_tokens(t):
                    seen.update(pieces)
                    if len(seen) > 4 * TABLE:
                        seen = Counter(dict(seen.most_common(TABLE)))
                size += len(t)
            if size >= SAMPLED_BYTES:
                break
        best = [(p, n) for p, n in seen.most_common(TABLE) if n > 1 and len(p) <= LONG and p != b"\n"]
        tidy()
        yield pa.RecordBatch.from_pydict({"p": binaries([b"\n".join(p for p, _ in best)]), "n": binaries([np.array([n for _, n in best], "<u4").tobytes()])})

    total: Counter = Counter()
    for r in docs.select(F.col(f"`{text}`").alias("t")).mapInArrow(run, "p binary, n binary").where("n != ''").collect():  # about SAMPLED_PARTS rows
        for p, n in zip(bytes(r.p).split(b"\n"), np.frombuffer(r.n, "<u4").tolist(), strict=True):
            total[p] += n
    chosen = [p for p, _ in sorted(total.items(), key=lambda x: (-x[1], x[0]))[:TABLE]]
    return b"\n".join(chosen), np.array([encoder(model).piece(p) for p in chosen], "<u2").tobytes()


def unpacked(table: tuple[bytes, bytes]) -> dict[bytes, int]:
    lengths = np.frombuffer(table[1], "<u2").tolist()
    return dict(zip(table[0].split(b"\n"), lengths, strict=True)) if lengths else {}


def count_tokens(docs: DataFrame, id: str = "doc_id", text: str = "text", model: str = MODEL, limit: int = CONTEXT) -> DataFrame:
    """docs(id, text) -> id, n_bytes (UTF-8), n_tokens (without begin and end), over_limit: a row for each row of docs.

    A null or empty text has 0 bytes and no tokens; repeated rows, equal ids and null ids stay rows of their own; other columns
    are left out. Counts are those of the library for whole texts, whatever the table and the caches hold: texts are cut only
    where no token of the model can reach over, and not at all for a model that gives no such places. One map, no shuffle.
    """
    spark = docs.sparkSession
    prepare(spark)
    rows = docs.select(F.col(f"`{id}`").alias("i"), F.col(f"`{text}`").alias("t"))
    held = spark.sparkContext.broadcast(frequent(rows, "t", model))  # TABLE entries at most

    def once():
        lengths = Lengths(encoder(model), unpacked(held.value))

        def step(t: pa.Table, texts: list[bytes]) -> pa.Table:
            n = np.fromiter(map(lengths.count, texts), np.int64, len(texts))
            return pa.table({"i": t["i"], "n_bytes": pa.array([len(x) for x in texts], pa.int64()), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

        return step

    kind = rows.schema["i"].dataType.simpleString()
    return map_chunks(rows, "t", None, f"i {kind}, n_bytes long, n_tokens long, over_limit boolean", once=once).withColumnRenamed("i", id)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(read(spark, sf_dir, "documents").select("doc_id", "text"))
