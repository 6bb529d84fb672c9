"""Tabular sources: profiles, keywords, relations, corpus indexes, score files, JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value); numbers ascend in the order of the file."""
    return spark.read.text(path).select(F.monotonically_increasing_id().alias("line_no"), "value")


def read_table(spark: SparkSession, path: str, columns: list[int], sep: str = "\t", filter_col: int = -1, filter_value: str | None = None) -> DataFrame:
    """(pos, text) of one column, each value once, or (pos, text, other) of two."""
    part = F.split("value", F.lit("\\Q" + sep + "\\E"))
    rows = _lines(spark, path)
    if filter_col >= 0:
        rows = rows.where(part[filter_col] == filter_value)
    if len(columns) == 1:
        one = rows.select("line_no", part[columns[0]].alias("text")).groupBy("text").agg(F.min("line_no").alias("pos"))
        return one.select("pos", "text")
    if len(columns) == 2:
        return rows.select(F.col("line_no").alias("pos"), part[columns[0]].alias("text"), part[columns[1]].alias("other"))
    raise ValueError("one or two columns can be read")


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """(pos, text): stripped lines."""
    return _lines(spark, path).select(F.col("line_no").alias("pos"), F.trim("value").alias("text"))


def read_profiles(spark: SparkSession, path: str, id_col: int = 0, term_col: int = 1, sep: str = ";", two_columns: bool = False, field_sep: str = "\t") -> DataFrame:
    """(profile_id, pos, term_id) of ``id<tab>t1;t2`` lines, or of (id, term) lines."""
    part = F.split("value", F.lit("\\Q" + field_sep + "\\E"))
    rows = _lines(spark, path).where(F.trim("value") != "").select("line_no", part[id_col].alias("profile_id"), part[term_col].alias("terms"))
    if two_columns:
        pos = F.row_number().over(Window.partitionBy("profile_id").orderBy("line_no")) - 1
        return rows.select("profile_id", pos.cast("int").alias("pos"), F.col("terms").alias("term_id"))
    last = rows.groupBy("profile_id").agg(F.max_by("terms", "line_no").alias("terms"))
    return last.select("profile_id", F.posexplode(F.split("terms", F.lit("\\Q" + sep + "\\E"))).alias("pos", "term_id"))


def read_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(kwd_id, text): names and ``|``-separated synonyms, each once; the last line of an id
    counts, lines of other than two or three fields are left out."""
    part = F.split("value", "\t")
    rows = _lines(spark, path).where(F.size(part).isin(2, 3))
    words = F.when(F.size(part) == 3, F.concat(F.split(part[2], r"\|"), F.array(part[1]))).otherwise(F.array(part[1]))
    last = rows.select("line_no", part[0].alias("kwd_id"), words.alias("w")).groupBy("kwd_id").agg(F.max_by("w", "line_no").alias("w"))
    return last.select("kwd_id", F.explode(F.array_distinct("w")).alias("text")).where("text <> ''")


def read_query_keywords(spark: SparkSession, path: str) -> DataFrame:
    """(id, keyword, alternatives): ``id<tab>keyword[<tab>a,b]``, lower case."""
    part = F.split(F.lower("value"), "\t")
    alternatives = F.when(F.size(part) > 2, F.split(part[2], ",")).otherwise(F.array().cast("array<string>"))
    return _lines(spark, path).select(F.split("value", "\t")[0].alias("id"), part[1].alias("keyword"), alternatives.alias("alternatives"))


def read_relations(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, term1, term2, value)."""
    part = F.split("value", "\t")
    return _lines(spark, path).select("line_no", part[0].alias("term1"), part[1].alias("term2"), part[2].cast("double").alias("value"))


def read_scores(spark: SparkSession, path: str, aggregate: Column | None = None) -> DataFrame:
    """(doc_id, term_id, score) of ``doc<tab>t1,t2<tab>s1;s2,s3``; the best score of a term, or
    ``aggregate`` of the array column ``s``."""
    part = F.split("value", "\t")
    pairs = F.arrays_zip(F.split(part[1], ",").alias("t"), F.split(part[2], ",").alias("s"))
    rows = spark.read.text(path).select(part[0].alias("doc_id"), F.explode(pairs).alias("p"))
    rows = rows.select("doc_id", F.col("p.t").alias("term_id"), F.transform(F.split("p.s", ";"), lambda x: x.cast("double")).alias("s"))
    return rows.select("doc_id", "term_id", (F.array_max("s") if aggregate is None else aggregate).alias("score"))


def read_corpus(spark: SparkSession, path: str, split: bool) -> DataFrame:
    """(text_id, doc_id, par, sent, text) of a corpus index, or (text_id, text) unsplit.

    Lines with fewer than two fields or without valid JSON are left out.
    """
    part = F.split("value", "\t")
    rows = spark.read.text(path).where(F.size(part) >= 2).select(part[0].alias("doc_id"), part[1].alias("body"))
    if not split:
        return rows.select(F.col("doc_id").alias("text_id"), F.col("body").alias("text"))
    nested = rows.select("doc_id", F.from_json("body", "array<array<string>>").alias("p")).where("p is not null")
    par = nested.select("doc_id", F.posexplode("p").alias("par", "ss"))
    sent = par.select("doc_id", "par", F.posexplode("ss").alias("sent", "text"))
    return sent.select(F.concat_ws("_", "doc_id", "par", "sent").alias("text_id"), "doc_id", "par", "sent", "text")


def read_ontology_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables of a JSON dump of an ontology object: term, alt, obsolete, profile, item.

    A dump in several files has one object in each; they continue each other in the order of
    their ``part``, then of the files' names.
    """
    maps = "map<string,array<string>>"
    schema = f"part long, terms map<string,map<string,string>>, alternatives_index map<string,string>, profiles {maps}, items {maps}"
    raw = spark.read.json(path, schema=schema, multiLine=True).select("*", F.struct("part", F.col("_metadata.file_path")).alias("at"))
    wrapped = lambda v: F.coalesce(F.from_json(v, "array<string>"), F.array(v))
    n = raw.where("terms is not null").select("at", F.size("terms").alias("n"))
    before = n.select("at", (F.sum("n").over(Window.orderBy("at")) - F.col("n")).cast("int").alias("before"))  # a row for each object
    terms = raw.select("at", F.posexplode("terms").alias("k", "term_id", "t")).join(F.broadcast(before), "at").withColumn("ord", F.col("before") + F.col("k"))
    tags = F.transform_values("t", lambda k, v: wrapped(v))
    first = lambda tag: wrapped(F.try_element_at("t", F.lit(tag)))[0]
    term = terms.select("term_id", "ord", first("name").alias("name"), first("def").alias("definition"), tags.alias("tags"))
    lists = raw.select("at", F.explode("profiles").alias("profile_id", "ts"))
    size = F.sum(F.size("ts")).over(Window.partitionBy("profile_id").orderBy("at")) - F.size("ts")
    lists = lists.withColumn("before", size).select("profile_id", "before", F.posexplode("ts").alias("k", "term_id"))
    return {
        "term": term,
        "alt": raw.select(F.explode("alternatives_index").alias("alt_id", "main_id")),
        "obsolete": term.where(F.element_at(F.coalesce(F.try_element_at("tags", F.lit("is_obsolete")), F.array(F.lit("false"))), 1) == "true").select("term_id"),
        "profile": lists.select("profile_id", (F.col("before") + F.col("k")).cast("int").alias("pos"), "term_id"),
        "item": raw.select(F.explode("items").alias("term_id", "xs")).select("term_id", F.explode("xs").alias("item_id")),
    }
