"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.storage import release, stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for every node of ``edges(a, b)``; component is the least id.

    Self loops and repeated edges are allowed; rows with a null end are ignored.
    Each round is a union-find step for the whole graph: every node points its
    larger neighbours at its least one (large star), then itself and its smaller
    neighbours at the least (small star).  Minima are combined map-side, the join
    back is left to adaptive skew handling, so a node with very many edges is never
    gathered in one task.  Rounds grow with the logarithm of the diameter and each
    one's edges are written to the shared folder.
    """
    e = (
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull())
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    e = stored(e)
    loops = e.where("u = v").select("u").distinct()
    before, e = None, e.where("u <> v")
    sign = None
    for _ in range(max_rounds):
        both = e.select("u", "v").unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("s"))
        e = stored(small.select("s.u", "s.v").where("u <> v").distinct())
        if before is not None:
            release(before)
        before = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == sign:
            break
        sign = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = e.select(F.col("v").alias("id")).unionAll(loops.select(F.col("u").alias("id"))).distinct()
    roots = roots.join(e.select(F.col("u").alias("id")), "id", "left_anti").select("id", F.col("id").alias("component"))
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionAll(roots)
