"""Suggesting terms related to a query list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def oriented(relation: DataFrame, query: DataFrame, black: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """((query, target, value), blacklisted targets) of the relations with exactly one end in
    the query list.  Of repeated pairs the last counts if ``relation`` has ``line_no``."""
    q = query.select("term_id").distinct()
    one = q.select(F.col("term_id").alias("term1"), F.lit(True).alias("q1"))
    two = q.select(F.col("term_id").alias("term2"), F.lit(True).alias("q2"))
    no = F.lit(False)
    rows = relation.join(one, "term1", "left").join(two, "term2", "left").where(F.coalesce("q1", no) != F.coalesce("q2", no))
    rows = rows.withColumn("query", F.when(F.col("q1"), F.col("term1")).otherwise(F.col("term2"))).withColumn("target", F.when(F.col("q1"), F.col("term2")).otherwise(F.col("term1")))
    last = F.max_by("value", "line_no") if "line_no" in relation.columns else F.max("value")
    rows = rows.groupBy("query", "target").agg(last.alias("value"))
    if black is None:
        return rows, rows.select("target").limit(0)
    b = black.select(F.col("term_id").alias("target")).distinct()
    return rows.join(b, "target", "left_anti").select("query", "target", "value"), rows.join(b, "target", "left_semi").select("target").distinct()


def targets(related: DataFrame, excluded: DataFrame | None = None, limit: int = 0) -> DataFrame:
    """(target, hits): targets by the number of queries they relate to, ties by the larger id."""
    hits = related.groupBy("target").agg(F.count("*").alias("hits"))
    if excluded is not None:
        hits = hits.join(excluded.select(F.col("term_id").alias("target")), "target", "left_anti")
    ordered = hits.orderBy(F.desc("hits"), F.desc("target"))
    return ordered.limit(limit) if limit else ordered


def query_means(related: DataFrame, chosen: DataFrame) -> DataFrame:
    """(query, mean): the sum of a query's values to the chosen targets over their number;
    queries whose sum is 0 are left out."""
    n = chosen.agg(F.count("*").alias("n"))
    sums = related.join(chosen.select("target"), "target", "left_semi").groupBy("query").agg(F.sum("value").alias("s")).where("s <> 0")
    return sums.crossJoin(F.broadcast(n)).select("query", (F.col("s") / F.col("n")).alias("mean"))


def cells(related: DataFrame, chosen: DataFrame, means: DataFrame, transform: str = "no") -> DataFrame:
    """(query, target, value): the matrix of kept queries by chosen targets; values as they
    are, as 10 to the negative power (exp) or as negative logarithms (log10)."""
    rows = related.where("value <> 0").join(chosen.select("target"), "target", "left_semi").join(means.select("query"), "query", "left_semi")
    value = {"no": F.col("value"), "exp": F.pow(F.lit(10.0), -F.col("value")), "log10": -F.log10("value")}[transform]
    return rows.select("query", "target", value.alias("value"))


def suggestions(relation: DataFrame, query: DataFrame, black: DataFrame | None = None, excluded: DataFrame | None = None, limit: int = 0, transform: str = "no") -> dict[str, DataFrame]:
    """targets, means and cells, and the blacklisted targets."""
    related, dropped = oriented(relation, query, black)
    chosen = targets(related, excluded, limit)
    means = query_means(related, chosen)
    return {"targets": chosen, "means": means, "cells": cells(related, chosen, means, transform), "blacklisted": dropped}
