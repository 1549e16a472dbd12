"""Embedding near-dedup by collision counting: sorted one-dimensional projections, query-centred windows, verification."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from patternloom.llm.blocks import forest, map_blocks, neighbour_blocks
from patternloom.llm.common import binaries, prepare, read, save
from patternloom.llm.components import components

#: Projections and the part of linked pairs that windows and count are calibrated to keep.
PROJECTIONS, RECALL = 16, 0.995
#: Rows of a chunk of one window of the first projection.
CHUNK = 1024


def directions(dim: int, count: int = PROJECTIONS, seed: int = 5) -> np.ndarray:
    """Orthonormal directions (as many as there are dimensions at most), the same everywhere."""
    q, _ = np.linalg.qr(np.random.default_rng(seed + dim).normal(size=(dim, dim)))
    return q[:, : min(count, dim)]


def calibrate(dim: int, threshold: float, recall: float = RECALL, trials: int = 20_000) -> tuple[float, float, int]:
    """Half-width of the first projection's window, of the others', and the least count of collisions.

    Drawn from pairs of unit vectors whose cosine is the threshold, which are the farthest that link: the first window
    keeps (1 + recall) / 2 of them, and so does the count among the others, so the whole keeps the recall at least.
    """
    rng = np.random.default_rng(1)
    if dim == 1:
        return 1e-6, 1e-6, 0
    diff = rng.normal(size=(trials, dim))
    diff *= math.sqrt(2 - 2 * threshold) / np.linalg.norm(diff, axis=1, keepdims=True)
    diff = np.abs(diff[:, : min(PROJECTIONS, dim)])
    part = (1 + recall) / 2
    first = float(np.quantile(diff[:, 0], part))
    width = float(np.quantile(diff[:, 1:], 0.95))
    count = int(np.quantile((diff[:, 1:] <= width).sum(axis=1), 1 - part))
    return first * 1.0001 + 1e-9, width * 1.0001 + 1e-9, count


def near_duplicates(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """vectors -> id, n_links, component_id, kept: one row per row of vectors.

    Rows are compared where their labels are equal and not null and their vectors have as many components. A vector that
    is null, empty or zero, or holds null or non-finite components, links with nothing. Equal vectors are one class, so a
    vector that fills a third of the table costs as one; its copies count as links of each other.

    Classes are sorted along the first projection; those within its window meet in blocks of bounded size, where the
    windows of the other projections that hold the pair are counted. Pairs that reach the calibrated count are verified in
    double precision.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select(F.col(f"`{id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & F.col("label").isNotNull() & F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.exists("v", lambda x: x != 0)
    key = F.when(usable, F.struct(F.xxhash64("label", F.size("v")).alias("grp"), F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v", "label").alias("h2")))
    rows = save(rows.withColumn("key", key), "vectors")
    classes = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # a class goes by a number of its own: the hash of its key
    classes = classes.select(F.col("key.grp").alias("grp"), F.xxhash64("key").alias("id"), "key", "low", "copies", "v")

    def project(batches):
        made: dict[int, tuple] = {}
        for batch in batches:
            v = batch.column(batch.schema.get_field_index("v")).to_pylist()
            proj, band, unit = [], [], []
            for x in v:
                x = np.array(x, np.float64)
                if len(x) not in made:
                    made[len(x)] = directions(len(x)), calibrate(len(x), threshold)[0]
                q, first = made[len(x)]
                u = x / np.abs(x).max()
                u /= math.sqrt(u @ u)
                p = u @ q
                proj.append(p.astype(np.float32).tobytes())
                band.append(int(math.floor(p[0] / first)))
                unit.append(u.tobytes())
            t = pa.Table.from_batches([batch]).drop_columns(["v"])
            t = t.append_column("band", pa.array(band, pa.int64())).append_column("p", binaries(proj)).append_column("unit", binaries(unit))
            yield from t.to_batches()

    flat = classes.select("grp", "id", "copies", "v").mapInArrow(project, "grp long, id long, copies long, band long, p binary, unit binary")
    blocks = neighbour_blocks(save(flat, "projections"), CHUNK)

    def compare(t: pa.Table, side: np.ndarray, across: bool) -> pa.Table | None:
        unit = np.stack([np.frombuffer(b, np.float64) for b in t["unit"].to_pylist()])
        proj = np.stack([np.frombuffer(b, np.float32) for b in t["p"].to_pylist()])
        n, dim = unit.shape
        first, width, least = calibrated(dim, threshold)
        order = np.argsort(proj[:, 0], kind="stable")
        unit, proj, side = unit[order], proj[order], side[order]
        ids, copies = t["id"].to_numpy()[order], t["copies"].to_numpy()[order]
        reach = np.searchsorted(proj[:, 0], proj[:, 0] + np.float32(first * 1.001), "right")
        left, right = [], []
        for i in range(n):  # the window centred on i; smaller partners had theirs
            j = slice(i + 1, int(reach[i]))
            if j.start >= j.stop:
                continue
            hits = (np.abs(proj[j, 1:] - proj[i, 1:]) <= np.float32(width * 1.001)).sum(axis=1)
            found = np.flatnonzero(hits >= least) + i + 1
            if across:
                found = found[side[found] != side[i]]
            if len(found):
                left.append(np.full(len(found), i))
                right.append(found)
        if not left:
            return None
        a, b = np.concatenate(left), np.concatenate(right)
        ok = np.einsum("ij,ij->i", unit[a], unit[b]) >= threshold
        a, b = a[ok], b[ok]
        deg = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
        links = forest(n, a, b)
        x, y = np.array([p for p, _ in links], np.int64), np.array([q for _, q in links], np.int64)
        some = np.flatnonzero(deg)
        return pa.table({"a": pa.array(np.concatenate([ids[x], ids[some]])), "b": pa.concat_arrays([pa.array(ids[y]), pa.nulls(len(some), pa.int64())]), "deg": pa.array(np.concatenate([np.zeros(len(x), np.int64), deg[some].astype(np.int64)]))})

    found = save(map_blocks(blocks, compare, "a long, b long, deg long"), "vector-links")
    linked = components(found.where("b is not null").select(F.col("a").alias("u"), F.col("b").alias("v")))
    degree = found.groupBy(F.col("a").alias("node")).agg(F.sum("deg").alias("deg"))
    named = rows.where("key is not null").groupBy("key").agg(F.min("id").alias("low"), F.count("*").alias("copies")).withColumn("node", F.xxhash64("key"))
    named = named.join(linked, "node", "left").join(degree, "node", "left").withColumn("component", F.coalesce("component", "node"))
    low = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = save(named.join(low, "component").select("key", "component_id", (F.col("copies") - 1 + F.coalesce("deg", F.lit(0))).alias("n_links")), "vectors-named")
    out = rows.select("id", "key").join(named, "key", "left")
    part = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), part.alias("component_id"), F.coalesce(F.col("id") == part, F.lit(True)).alias("kept"))


_calibrated: dict[tuple[int, float], tuple[float, float, int]] = {}


def calibrated(dim: int, threshold: float) -> tuple[float, float, int]:
    if (dim, threshold) not in _calibrated:
        _calibrated[dim, threshold] = calibrate(dim, threshold)
    return _calibrated[dim, threshold]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "embeddings"))
