"""Tables behind the report's plots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.storage import ranked

#: Root and reference terms of well-known ontologies, by lower-case name.
DEFAULT_ROOTS = {"hp": ("HP:0000118", "HP:0000118"), "go": ("GO:0008150", "GO:0008150"), "mondo": ("MONDO:0700096", "MONDO:0700096")}


def default_root(name: str) -> tuple[str, str] | None:
    return DEFAULT_ROOTS.get(name.lower())


def transformed(value: Column, method: str) -> Column:
    """cubic_root, bins (five half-open steps, 1 stays 1) or none."""
    if method == "cubic_root":
        return F.cbrt(value)
    if method == "bins":
        steps = F.when((value >= 0) & (value < 0.2), 0.2)
        for lo, v in ((0.2, 0.3), (0.4, 0.5), (0.6, 0.7), (0.8, 0.9)):
            steps = steps.when((value >= lo) & (value < round(lo + 0.2, 1)), v)
        return steps.when(value == 1, 1.0).otherwise(F.raise_error(F.lit("a value lies outside 0 to 1")).cast("double"))
    if method == "none":
        return value
    raise ValueError(f"unknown method {method}")


def ontoplot(paths: DataFrame, level: DataFrame, freq: DataFrame, root: str, alpha: str = "bins", size: str = "cubic_root") -> DataFrame:
    """(term_id, level, angle, radius, size, alpha): polar places of all terms below ``root``.

    Terms of a level stand at equal angles in depth-first order, which is the order of their
    least path from the root.
    """
    down = paths.where(F.array_contains("path", F.lit(root))).select("term_id", F.reverse("path").alias("way"))
    first = down.groupBy("term_id").agg(F.min("way").alias("way")).join(level, "term_id")
    first = ranked(first.where("level is not null"), "level", "way", "k")
    n = first.groupBy("level").agg(F.count("*").alias("n"))
    rows = first.join(F.broadcast(n), "level").join(freq, "term_id", "left")  # levels are few
    f = F.coalesce("freq", F.lit(0.0))
    return rows.select("term_id", "level", ((F.col("k") - 1) * (2 * math.pi) / F.col("n")).alias("angle"), F.col("level").cast("double").alias("radius"), transformed(f, size).alias("size"), transformed(f, alpha).alias("alpha"))


def redundancy_table(redundancy: DataFrame) -> DataFrame:
    return redundancy.orderBy(F.desc("size"), "profile_id")


def frequency_table(freq: DataFrame, names: DataFrame, min_freq: float = 0.005) -> DataFrame:
    """(name, percent), the most frequent first."""
    rows = freq.where(F.col("freq") >= min_freq).join(names.select("term_id", "name"), "term_id")
    return rows.select("name", (F.col("freq") * 100).alias("percent")).orderBy(F.desc("percent"), "name")


def ic_pairs(profile: DataFrame, ic: DataFrame, by: str = "term") -> DataFrame:
    """Structural and observed IC of each used term, or their means for each profile."""
    if by == "term":
        return profile.select("term_id").distinct().join(ic, "term_id").select("term_id", "ic_resnik", "ic_resnik_observed")
    return profile.join(ic, "term_id").groupBy("profile_id").agg(F.avg("ic_resnik").alias("ic_resnik"), F.avg("ic_resnik_observed").alias("ic_resnik_observed"))


def cluster_matrix(profile_sim: DataFrame, cluster: DataFrame) -> DataFrame:
    """(cluster_id, a, b, sim): similarities inside each cluster."""
    x, y = cluster.select(F.col("profile_id").alias("a"), "cluster_id"), cluster.select(F.col("profile_id").alias("b"), "cluster_id")
    return profile_sim.join(x, "a").join(y, ["b", "cluster_id"]).select("cluster_id", "a", "b", "sim")


def document_report(doc_profile: DataFrame, titles: DataFrame) -> DataFrame:
    """Documents with their titles and types; unknown ones keep nulls."""
    return doc_profile.join(titles, "doc_id", "left")


def heatmap(cells: DataFrame, row: str, col: str, value: str, limit: int = 200) -> DataFrame:
    """A wide table for a plot; at most ``limit`` columns, more is an error."""
    names = [r[0] for r in cells.select(col).distinct().limit(limit + 1).collect()]
    if len(names) > limit:
        raise ValueError(f"a heatmap has {limit} columns at most")
    return cells.groupBy(row).pivot(col, sorted(names)).agg(F.first(value))
