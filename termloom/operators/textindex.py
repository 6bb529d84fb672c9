"""Corpus indexes: filtering, preparing and splitting parsed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.functions.splitter import split_column
from termloom.functions.strings import clean_text


def blacklist_hit(words: list[str], mode: str = "partial", title: str = "title", category: str = "article_category") -> Column:
    """struct(word, field, content) of the first blacklisted word, in list order, that the
    title or else the category holds (``partial``) or is (``exact``); null without one."""
    if mode not in ("partial", "exact"):
        raise ValueError(f"mode is partial or exact, not {mode}")
    found = []
    for w in words:
        if not w.strip():
            continue
        for c in (title, category):
            low, needle = F.lower(F.col(c)), F.lit(w.lower())
            hit = low.contains(needle) if mode == "partial" else low == needle
            found.append(F.when(hit, F.struct(F.lit(w).alias("word"), F.lit(c).alias("field"), F.col(c).alias("content"))))
    return F.coalesce(*found) if found else F.lit(None).cast("struct<word:string,field:string,content:string>")


def usable(records: DataFrame, kind: str = "basic", equivalences: DataFrame | None = None, words: list[str] | None = None, mode: str = "partial") -> DataFrame:
    """The records that an index takes: with an id and a text that is long enough (ten words
    for abstracts, more than 1000 characters for papers), not blacklisted.

    Papers without a pmid take the one that ``equivalences(pmc, pmid)`` gives, else their pmc.
    """
    rows = records.where("error is null")
    if kind == "paper":
        if equivalences is not None:
            eq = equivalences.select("pmc", F.col("pmid").alias("eq_pmid")).dropDuplicates(["pmc"])
            rows = rows.join(eq, "pmc", "left").withColumn("pmid", F.coalesce("pmid", "eq_pmid", "pmc")).drop("eq_pmid")
        else:
            rows = rows.withColumn("pmid", F.coalesce("pmid", "pmc"))
    rows = rows.where(F.col("pmid").isNotNull() & (F.coalesce("text", F.lit("")) != ""))
    if kind == "abstract":
        rows = rows.where(F.size(F.split("text", " ")) >= 10)
    if kind == "paper":
        rows = rows.where(F.length("text") > 1000)
    if words and kind != "basic":
        rows = rows.where(blacklist_hit(words, mode).isNull())
    return rows


def prepare(rows: DataFrame, split: bool = False, split_type: str = "classic", clean: str = "soft") -> DataFrame:
    """The ten columns of a corpus index.

    With ``split`` the text becomes JSON of sentences by paragraph; ``text_length`` is that of
    the text as it came.
    """
    base = rows.withColumn("text_length", F.length("text"))
    if split:
        base = base.withColumn("_s", split_column(rows, F.col("text"), split_type))
        flat = F.flatten("_s")
        base = base.withColumn("body", F.to_json("_s")).withColumn("n", F.size(flat)).withColumn("lengths", F.transform(flat, lambda s: F.length(s)))
    else:
        base = base.withColumn("body", clean_text(F.col("text"), clean)).withColumn("n", F.lit(1)).withColumn("lengths", F.array(F.lit(1)))
    none = F.lit("None")
    return base.select(
        "pmid",
        F.col("body").alias("text"),
        F.col("path").alias("original_filename"),
        "year",
        "text_length",
        F.col("n").cast("int").alias("number_of_sentences"),
        F.col("lengths").cast("array<int>").alias("length_of_sentences"),
        F.coalesce("title", none).alias("title"),
        F.coalesce("article_type", none).alias("article_type"),
        F.coalesce("article_category", none).alias("article_category"),
    )


def dealt(items: DataFrame, n: int, weight: str) -> DataFrame:
    """``items`` over ``n`` partitions of near equal total weight: each weight class is spread
    by hash, so that neither the largest nor the most frequent gather anywhere."""
    return items.repartition(n, F.pmod(F.xxhash64(weight, F.monotonically_increasing_id()), F.lit(n * 8)))
