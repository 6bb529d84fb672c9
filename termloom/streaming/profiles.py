"""Structured Streaming over the engine's operators.

The ontology side is static: its term similarities and closures are joined with the stream
inside the query, so the stream itself keeps no state but that of its aggregates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.functions.strings import clean_text
from termloom.operators.compare import mirrored


def index_stream(docs: DataFrame, clean: str = "hard", min_words: int = 10) -> DataFrame:
    """A stream of (id, text) as cleaned texts with their year and length, short ones left out."""
    rows = docs.withColumn("text", clean_text(F.col("text"), clean))
    return rows.where(F.size(F.split("text", " ")) >= min_words).withColumn("text_length", F.length("text"))


def score_stream(annotations: DataFrame, reference: DataFrame, term_sim: DataFrame, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """(window, profile_id, sim, n): the one-way best-match average of the terms that each
    profile gained in a window towards a reference profile.

    ``annotations`` is a stream of (ts, profile_id, term_id); late rows count until the
    watermark has passed their window.  Terms without a like in the reference count 0.
    """
    best = (
        mirrored(term_sim.where("sim is not null"))
        .join(reference.select(F.col("term_id").alias("b")).distinct(), "b", "left_semi")
        .groupBy(F.col("a").alias("term_id"))
        .agg(F.max("sim").alias("best"))
    )
    rows = annotations.withWatermark("ts", watermark).join(best, "term_id", "left")
    return rows.groupBy(F.window("ts", window).alias("window"), "profile_id").agg(F.avg(F.coalesce("best", F.lit(0.0))).alias("sim"), F.count("*").alias("n"))


def observed_stream(annotations: DataFrame, reflexive_: DataFrame, watermark: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """(window, term_id, observed_freq): occurrences of each term and of all below it."""
    up = annotations.withWatermark("ts", watermark).join(reflexive_.select("term_id", "ancestor"), "term_id")
    return up.groupBy(F.window("ts", window).alias("window"), F.col("ancestor").alias("term_id")).agg(F.count("*").cast("double").alias("observed_freq"))
