"""Propagating items from terms to their ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import profiles, similarity
from termloom.operators.graph import REWRITE
from termloom.storage import stored


def expand_to_parents(item: DataFrame, closure_: DataFrame, level: DataFrame, minimum_children: int = 2, other: dict[str, DataFrame] | None = None) -> DataFrame:
    """(term_id, item_id) after items have risen level by level from the leaves.

    At each level but the deepest a term gains the items that at least that many of its
    descendants hold, descendants as they are after their own levels were done.  With
    ``other`` = {reflexive, closure, ic} of the ontology that the items belong to, what
    counts is how often an item is the best common ancestor between the items of two
    descendants, twice at least for a pair, and results are cleaned of redundant ancestors.
    """
    items = stored(item.select("term_id", "item_id").distinct())
    used = items.select("term_id").distinct()
    used = used.unionByName(used.join(closure_, "term_id").select(F.col("ancestor").alias("term_id"))).distinct()
    placed = stored(used.join(level, "term_id").where("level is not null"))
    steps = sorted((r["level"] for r in placed.select("level").distinct().collect()), reverse=True)[1:]  # levels are few
    for k, step in enumerate(steps, 1):
        here = placed.where(F.col("level") == step).select(F.col("term_id").alias("t"))
        below = here.join(closure_.select("term_id", F.col("ancestor").alias("t")), "t").join(items.select("term_id").distinct(), "term_id", "left_semi")
        enough = below.groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= minimum_children).select("t")
        below = below.join(enough, "t", "left_semi")
        held = below.join(items, "term_id").select("t", "term_id", "item_id")
        votes = held.groupBy("t", "item_id").agg(F.count("*").alias("v")) if other is None else _shared(held, other)
        gained = stored(votes.where(F.col("v") >= minimum_children).select(F.col("t").alias("term_id"), "item_id"))
        if other is not None:
            old = items.join(gained.select("term_id"), "term_id", "left_semi")
            both = old.unionByName(gained).distinct()
            lone = gained.join(old.select("term_id"), "term_id", "left_anti")
            kept = profiles.drop_ancestors(both.select(F.col("term_id").alias("profile_id"), F.lit(0).alias("pos"), F.col("item_id").alias("term_id")), other["closure"])
            kept = kept.select(F.col("profile_id").alias("term_id"), F.col("term_id").alias("item_id")).join(old.select("term_id"), "term_id", "left_semi")
            items = stored(items.join(gained.select("term_id"), "term_id", "left_anti").unionByName(kept).unionByName(lone).distinct())
        else:
            # only what a term of this level held already can come twice; what was stored stays as it is
            old = items.join(gained.select("term_id").distinct(), "term_id", "left_semi")
            items = items.unionByName(stored(gained.join(old, ["term_id", "item_id"], "left_anti")))
            if k % REWRITE == 0:
                items = stored(items)
    return items


def _shared(held: DataFrame, other: dict[str, DataFrame]) -> DataFrame:
    """(t, item_id, v): votes by best common ancestors between the items of two children."""
    x = held.select("t", F.col("term_id").alias("c1"), F.col("item_id").alias("a"))
    y = held.select("t", F.col("term_id").alias("c2"), F.col("item_id").alias("b"))
    pairs = x.join(y, "t").where("c1 < c2")
    lookup = similarity.micas(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), other["reflexive"], other["ic"])
    scored = pairs.withColumn("lo", F.least("a", "b")).withColumn("hi", F.greatest("a", "b"))
    scored = scored.join(lookup.select(F.col("a").alias("lo"), F.col("b").alias("hi"), "mica", "mica_ic"), ["lo", "hi"])
    top = F.max_by("mica", F.struct("mica_ic", "mica")).alias("m")
    one = scored.groupBy("t", "c1", "c2", "a").agg(top).select("t", "c1", "c2", "m")
    two = scored.groupBy("t", "c1", "c2", "b").agg(top).select("t", "c1", "c2", "m")
    counts = one.unionByName(two).groupBy("t", "c1", "c2", "m").agg(F.count("*").alias("f")).where("f >= 2")
    return counts.groupBy("t", F.col("m").alias("item_id")).agg(F.sum("f").alias("v"))


def from_dictionary(dictionary: DataFrame) -> DataFrame:
    """(term_id, item_id) of a dictionary (term_id, value), each pair once."""
    return dictionary.select("term_id", F.col("value").alias("item_id")).distinct()


def level_terms(item: DataFrame, level: DataFrame) -> DataFrame:
    """(level, terms) of the terms that hold items."""
    used = item.select("term_id").distinct().join(level, "term_id").where("level is not null")
    return used.groupBy("level").agg(F.array_sort(F.collect_list("term_id")).alias("terms"))
