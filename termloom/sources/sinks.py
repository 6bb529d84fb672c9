"""Writing results: tables, pair lists, corpus indexes, matrices and reports."""

from __future__ import annotations

import html

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.storage import stored


def write_tables(tables: dict[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    """Each table as a folder of its name."""
    for name, df in tables.items():
        df.write.mode("overwrite").format(fmt).save(f"{folder}/{name}")


def write_pairs(pairs: DataFrame, path: str, mode: str = "overwrite") -> None:
    """``a<tab>b<tab>value`` lines."""
    pairs.write.mode(mode).csv(path, sep="\t", header=False)


def write_profiles(profile: DataFrame, path: str, sep: str = ";", two_columns: bool = False) -> None:
    if two_columns:
        rows = profile.select("profile_id", "term_id")
    else:
        terms = F.transform(F.array_sort(F.collect_list(F.struct("pos", "term_id"))), lambda x: x["term_id"])
        rows = profile.groupBy("profile_id").agg(F.array_join(terms, sep).alias("terms"))
    rows.write.mode("overwrite").csv(path, sep="\t", header=False)


#: Terms, alternatives, ids of profiles and items in one object of a JSON dump, about.
OBJECT_ROWS = 50_000


def write_ontology_json(term: DataFrame, alt: DataFrame, profile: DataFrame, path: str, rows: int = OBJECT_ROWS) -> None:
    """A JSON dump of an ontology, its profiles and items: objects of bounded size, a file each.

    ``part`` orders the objects: terms follow each other in their order, and a long profile
    is continued by objects of a larger part.
    """
    profile = stored(profile)
    n = profile.count() // rows + 1
    bucket = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("bucket")
    entries = lambda k, v: F.map_from_entries(F.collect_list(F.struct(k, v)))
    part = F.coalesce(F.floor(F.col("ord") / rows), bucket("term_id", term.count() // rows + 1)).cast("long").alias("part")
    kinds = [
        term.groupBy(part).agg(entries(F.col("term_id"), F.transform_values("tags", lambda k, v: F.to_json(v))).alias("terms")),
        alt.groupBy(bucket("alt_id", alt.count() // rows + 1)).agg(entries("alt_id", "main_id").alias("alternatives_index")),
    ]
    lists = profile.groupBy("profile_id", F.floor(F.col("pos") / rows).cast("long").alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term_id"))), lambda x: x["term_id"]).alias("ts"))
    kinds.append(lists.groupBy("part", bucket("profile_id", n)).agg(entries("profile_id", "ts").alias("profiles")))
    held = profile.groupBy("term_id").agg(F.array_sort(F.collect_set("profile_id")).alias("xs"))
    kinds.append(held.groupBy(bucket("term_id", n)).agg(entries("term_id", "xs").alias("items")))
    for k, rows_ in enumerate(kinds):
        rows_.drop("bucket").write.mode("append" if k else "overwrite").option("maxRecordsPerFile", 1).json(path)


def write_corpus(index: DataFrame, path: str, items_per_file: int = 0, balance: int = 0, by_source: bool = False) -> None:
    """A corpus index as gz TSV; ``items_per_file`` rolls files, ``balance`` spreads texts over
    so many files of near equal bytes, ``by_source`` gives each input file a folder of its own."""
    rows = index.withColumn("length_of_sentences", F.array_join(F.transform("length_of_sentences", lambda x: x.cast("string")), ","))
    if balance:
        # texts of like length are dealt out in turn, largest first: each file gets as many of every length
        length = F.floor(F.log2(F.greatest(F.col("text_length"), F.lit(1)).cast("double")) * 8).cast("int")
        group = F.pmod(F.xxhash64("pmid"), F.lit(4))
        turn = F.row_number().over(Window.partitionBy(length, group).orderBy(F.desc("text_length"), "pmid"))
        rows = rows.withColumn("_file", F.pmod(turn + group + length, F.lit(balance)).cast("int"))
        rows = rows.repartitionById(balance, "_file").drop("_file")
    w = rows.withColumn("source", F.col("original_filename")).write.partitionBy("source") if by_source else rows.write
    w = w.mode("overwrite").option("compression", "gzip").option("sep", "\t").option("quote", "").option("escape", "")
    (w.option("maxRecordsPerFile", items_per_file) if items_per_file else w).csv(path)


def write_matches(matches: DataFrame, path: str, threshold: float = 0.0, order: str = "corpus-query") -> None:
    """Matches at the threshold, appended; the column order follows ``order``."""
    first, second = ("text_id", "kwd_id") if order == "corpus-query" else ("kwd_id", "text_id")
    matches.where(F.col("score") >= threshold).select(first, second, "score").write.mode("append").csv(path, sep="\t")


def save_matrix(path: str, ids: list[str], matrix: np.ndarray) -> None:
    """``path``.npy and ``path``.lst."""
    np.save(f"{path}.npy", matrix)
    with open(f"{path}.lst", "w") as f:
        f.write("".join(f"{x}\n" for x in ids))


def write_report(path: str, title: str, tables: dict[str, DataFrame], limit: int = 1000) -> None:
    """A plain HTML page with the first rows of each table."""
    out = [f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1>"]
    for name, df in tables.items():
        out.append(f"<h2>{html.escape(name)}</h2><table border=1><tr>" + "".join(f"<th>{html.escape(c)}</th>" for c in df.columns) + "</tr>")
        for r in df.limit(limit).collect():
            out.append("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>")
        out.append("</table>")
    with open(path, "w") as f:
        f.write("\n".join(out))
