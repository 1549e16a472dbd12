"""Connected components of an edge table with DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patternloom.llm.common import forget, save

#: A node with more edges than this, and than a thousandth of all, is looked up from a broadcast of at most 2,000 rows.
HOT = 1_000


def lowest(e: DataFrame) -> DataFrame:
    """(u, m): the smallest v of each u; tasks take their own minima before the shuffle."""
    return e.groupBy("u").agg(F.min("v").alias("m"))


def looked_up(e: DataFrame, low: DataFrame, on: str, hot: list) -> DataFrame:
    """e with m of the node at `on` where low has one. Edges of hot nodes stay where they are; the others are shuffled."""
    low = low.select(F.col("u").alias(on), "m")
    if not hot:
        return e.join(low, on, "left")
    mine = F.col(on).isin(hot)
    return e.where(mine).join(F.broadcast(low.where(mine)), on, "left").unionByName(e.where(~mine).join(low.where(~mine), on, "left"))


def hot_nodes(e: DataFrame, edges: int) -> dict[str, list]:
    """For each end of the edges the nodes that stand there more often than the limit: fewer than a thousand."""
    limit = max(HOT, edges // 1_000)
    if edges <= limit:
        return {"u": [], "v": []}
    ends = e.select(F.explode(F.array(F.struct(F.lit("u").alias("end"), F.col("u").alias("node")), F.struct(F.lit("v").alias("end"), F.col("v").alias("node")))).alias("x"))
    found = ends.groupBy("x").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("x.end", "x.node").collect()
    return {end: [r.node for r in found if r.end == end] for end in ("u", "v")}


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """edges(u, v) -> (node, component), component being the smallest node reachable; u = v and nulls are ignored.

    Alternating large-star and small-star steps over edges that point from a node to a smaller one: each round hangs every
    node under the smallest neighbour known, so the number of rounds follows the logarithm of the longest path. No step
    gathers a component or the edges of a hot node in one place. Every round is written to the shared folder.
    """
    few = max(1, int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4)  # edges are small beside what they come from
    e = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    e = save(e.coalesce(few), "edges")
    seen = None
    for _ in range(rounds):
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == seen:
            break
        seen, hot = now, hot_nodes(e, now[0])
        # a node's larger neighbours move to the smallest node below it
        large = looked_up(e, lowest(e), "v", hot["v"]).select("u", F.coalesce("m", "v").alias("v"))
        # a node and its smaller neighbours move to the smallest of these
        small = looked_up(large, lowest(large), "u", hot["u"]).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
        last, e = e, save(small.select("x.u", "x.v").where("u <> v").distinct().coalesce(few), "edges")
        forget(last)
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
