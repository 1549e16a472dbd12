"""Comparing rows of the same and of neighbouring bands in blocks of bounded size."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def neighbour_blocks(df: DataFrame, rows_per_chunk: int, neighbours: bool = True) -> DataFrame:
    """df(grp, band, id, ...) -> the same with block keys, a row for each block that it takes part in.

    Two rows meet in exactly one block if they share a grp and their bands differ by at most one. A band of more than
    rows_per_chunk rows is dealt into chunks, and each pair of chunks is a block of its own: no task holds more than two
    chunks, however large a band is, and a block may run anywhere. `side` is 0 or 1 by chunk; rows of side 0 meet each
    other only in a block of one chunk.
    """
    sizes = df.groupBy("grp", "band").agg(F.count("*").alias("n"))
    sizes = sizes.select("grp", "band", (F.floor((F.col("n") - 1) / rows_per_chunk) + 1).cast("int").alias("own"))
    if neighbours:
        near = sizes.select("grp", "band", "own", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("d"))
        near = near.groupBy("grp", (F.col("band") + F.col("d")).alias("band")).agg(
            F.max(F.when(F.col("d") == 0, F.col("own"))).alias("own"),
            F.max(F.when(F.col("d") == -1, F.col("own"))).alias("above"),  # the size of band + 1, told to band
            F.max(F.when(F.col("d") == 1, F.col("own"))).alias("below"),
        ).where("own is not null")
    else:
        near = sizes.withColumns({"above": F.lit(None).cast("int"), "below": F.lit(None).cast("int")})
    named = df.join(near, ["grp", "band"]).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("own")).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    block = lambda band, low, high, kind, side: F.struct(band.cast("long").alias("b"), low.cast("int").alias("i"), high.cast("int").alias("j"), F.lit(kind).alias("kind"), side.cast("int").alias("side"))
    chunk, band = F.col("chunk"), F.col("band")
    inside = F.transform(upto(F.col("own")), lambda c: block(band, F.least(chunk, c), F.greatest(chunk, c), 0, (chunk > c).cast("int")))
    up = F.transform(upto(F.coalesce("above", F.lit(0))), lambda c: block(band, chunk, c, 1, F.lit(0)))
    down = F.transform(upto(F.coalesce("below", F.lit(0))), lambda c: block(band - 1, c, chunk, 1, F.lit(1)))
    keys = F.concat(inside, up, down) if neighbours else inside
    out = named.withColumn("_k", F.explode(keys))
    return out.select(*(F.col(c) for c in df.columns), *(F.col(f"_k.{c}").alias(f"k_{c}") for c in ("b", "i", "j", "kind", "side"))).drop("band")


BLOCK_KEY = ["grp", "k_b", "k_i", "k_j", "k_kind"]


def map_blocks(df: DataFrame, fn: Callable[[pa.Table, np.ndarray, bool], pa.Table | None], schema: str, partitions: int | None = None) -> DataFrame:
    """fn(rows, side, across) for every block; across: only rows of different sides are to be compared."""
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = df.repartition(n, *BLOCK_KEY).sortWithinPartitions(*BLOCK_KEY, "k_side", "id")

    def run(batches):
        for t in grouped(batches, BLOCK_KEY):
            side = t["k_side"].to_numpy()
            across = bool(t["k_kind"][0].as_py() or t["k_i"][0].as_py() != t["k_j"][0].as_py())
            if len(side) < 2 or across and side.min() == side.max():
                continue
            out = fn(t, side, across)
            if out is not None and out.num_rows:
                yield from out.to_batches()

    return dealt.mapInArrow(run, schema)


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal keys in sorted batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False).astype(np.int64) for k in keys], axis=1)
        cuts = np.flatnonzero((cols[1:] != cols[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        if last is not None and (cols[0] != last).any():
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append(batch.slice(a, b - a))
            if b < batch.num_rows:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
        last = cols[-1]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def forest(n: int, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """As few of the links a-b as connect what all of them connect."""
    root = list(range(n))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = top(x), top(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out
