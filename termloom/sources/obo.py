"""Reading OBO ontologies into term, edge, alternative and obsolete tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.storage import stored

#: Tags that may occur more than once in a stanza.
MULTI = frozenset(
    """alt_id consider disjoint_from holds_over_chain idspace intersection_of is_a namespace property_value relationship
    remark replaced_by subset subsetdef synonym synonymtypedef transitive_over treat-xrefs-as-equivalent
    treat-xrefs-as-has-subclass treat-xrefs-as-is_a treat-xrefs-as-reverse-genus-differentia union_of xref""".split()
)
#: Tags whose value ends where a `` ! comment`` begins.
COMMENTED = MULTI - frozenset("alt_id consider intersection_of namespace remark replaced_by subset synonym xref".split())
#: Tags of which the first counts if they are repeated against the standard.
FIRST_ONLY = ("def", "comment", "name", "created_by")
_HEAD = r"\[(?:Term|Typedef|Instance)\][ \t]*(?:\n|$)"


def _any(c: Column, values) -> Column:
    return c.isin(*sorted(values))


def stanza_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, kind, pos, tag, value): every tag line of OBO files, plain or gz."""
    lines = stanzas(spark, path).select("file", "ord", "kind", F.posexplode(_tag_lines(F.col("body"))).alias("pos", "l"))
    return lines.select("file", "ord", "kind", "pos", "l.tag", "l.value")


def stanzas(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, kind, body): the stanzas of OBO files; ord ascends over files by name and within each.

    ``kind`` is Header, Term, Typedef or Instance; other bracket lines do not end a stanza.
    A plain file is read in parts cut at bracket lines, one row a stanza, by as many tasks as
    it has blocks.
    """
    raw = spark.read.option("lineSep", "\n[").text(path)
    raw = stored(raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value"))
    # a row for each block of a file: its first id and the rows before it
    at = raw.groupBy("file", "block").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    at = at.select("file", "block", "first", (F.sum("n").over(Window.orderBy("file", "block")) - F.col("n")).alias("before"))
    rows = raw.join(F.broadcast(at), ["file", "block"])
    top = (F.col("block") == 0) & (F.col("id") == F.col("first"))
    body = F.when(top, F.col("value")).otherwise(F.concat(F.lit("["), F.col("value")))
    rows = rows.select("file", (F.col("before") + F.col("id") - F.col("first")).alias("n"), top.alias("top"), F.regexp_replace(body, "\r\n?", "\n").alias("body"))
    # lone carriage returns leave several stanzas in a row
    rows = rows.select("file", "n", "top", F.posexplode(F.split("body", rf"\n(?={_HEAD})")).alias("k", "body"))
    rows = rows.select("file", (F.shiftleft("n", 32) + F.col("k")).alias("ord"), ((F.col("top") & (F.col("k") == 0)) | F.col("body").rlike(f"^{_HEAD}")).alias("head"), "body")
    rows = _glued(rows)
    kind = F.coalesce(F.nullif(F.regexp_extract("body", r"^\[(Term|Typedef|Instance)\]", 1), F.lit("")), F.lit("Header"))
    return rows.select("file", "ord", kind.alias("kind"), "body")


def _glued(rows: DataFrame) -> DataFrame:
    """(file, ord, body): rows that begin with another bracket line go to the stanza before."""
    if rows.where(~F.col("head")).isEmpty():
        return rows.select("file", "ord", "body")
    part = F.shiftright("ord", 48).alias("part")  # 65,536 rows each
    slim = rows.select("ord", "head", part)
    last = slim.where("head").groupBy("part").agg(F.max("ord").alias("last"))
    before = slim.select("part").distinct().join(last, "part", "left").select("part", F.max("last").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    own = F.max(F.when(F.col("head"), F.col("ord"))).over(Window.partitionBy("part").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    loose = slim.withColumn("own", own).where(~F.col("head")).join(F.broadcast(before), "part").select("ord", F.coalesce("own", "carried").alias("of"))
    tails = rows.select("ord", "body").join(loose, "ord").groupBy(F.col("of").alias("ord")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "body"))), lambda x: x["body"]), "\n").alias("tail"))
    return rows.where("head").join(tails, "ord", "left").select("file", "ord", F.concat_ws("\n", "body", "tail").alias("body"))


def _tag_lines(body: Column) -> Column:
    """The tag lines of a stanza as an array of (tag, value)."""
    lines = F.filter(F.split(body, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\[(Term|Typedef|Instance)\]\s*$") & x.contains(":"))
    parts = F.transform(lines, lambda x: F.split(F.regexp_replace(x, r"\s+$", ""), ":", 2))
    pairs = F.transform(parts, lambda p: F.struct(F.ltrim(p[0]).alias("tag"), F.ltrim(p[1]).alias("value")))
    plain = lambda v: F.trim(F.regexp_replace(v, r'\{["\\:A-Za-z0-9/., =?&_-]+\} ?', ""))
    bare = F.transform(pairs, lambda p: F.struct(p["tag"].alias("tag"), F.when(p["tag"].isin("is_a", "is_obsolete"), plain(p["value"])).otherwise(p["value"]).alias("value")))
    return F.transform(bare, lambda p: F.struct(p["tag"].alias("tag"), F.when(_any(p["tag"], COMMENTED), F.split(p["value"], " ! ")[0]).otherwise(p["value"]).alias("value")))


def stanza_tags(rows: DataFrame) -> DataFrame:
    """(file, ord, kind, tags) of ``stanzas``: a map from tag to its values, in order.

    A tag that may not be repeated raises, but for those of FIRST_ONLY.
    """
    rows = rows.select("file", "ord", "kind", _tag_lines(F.col("body")).alias("l")).where(F.size("l") > 0)

    def values(tag: Column) -> Column:
        v = F.transform(F.filter("l", lambda x: x["tag"] == tag), lambda x: x["value"])
        wrong = F.raise_error(F.concat(F.lit("the tag is repeated but holds one value: "), tag)).cast("array<string>")
        return F.when(_any(tag, MULTI) | (F.size(v) == 1), v).when(tag.isin(*FIRST_ONLY), F.slice(v, 1, 1)).otherwise(wrong)

    names = F.array_distinct(F.transform("l", lambda x: x["tag"]))
    return rows.select("file", "ord", "kind", F.map_from_entries(F.transform(names, lambda t: F.struct(t.alias("tag"), values(t).alias("v")))).alias("tags"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with ord replaced by their rank from 0; ranks are counted in parts of the order."""
    rows = stored(rows.withColumn("part", F.shiftright("ord", 48)))
    n = rows.groupBy("part").agg(F.count("*").alias("n"))
    before = n.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))  # a row for 65,536 stanzas
    rank = F.row_number().over(Window.partitionBy("part").orderBy("ord")) - 1
    return rows.withColumn("rank", rank).join(F.broadcast(before), "part").withColumn("ord", (F.col("before") + F.col("rank")).cast("int")).drop("part", "rank", "before")


def _first(tag: str) -> Column:
    return F.try_element_at("tags", F.lit(tag))[0]


def read_obo(spark: SparkSession, path: str, black_list: list[str] | None = None) -> dict[str, DataFrame]:
    """Tables of an ontology: header, term (all stanzas of terms), typedef, instance.

    Terms whose id does not begin with the ontology's own name are left out when the header
    has one.  Of stanzas with the same id the last counts, at the place of the first.
    """
    tags = stored(stanza_tags(stanzas(spark, path)))
    header = tags.where("kind = 'Header'").select("file", "tags")
    ont = F.try_element_at("tags", F.lit("ontology"))[0]
    name = F.when(ont.contains("efo"), F.lit("efo")).otherwise(F.upper(F.split(ont, "[/.]")[0]))
    names = header.select("file", name.alias("ont_name"))
    own = tags.where("kind <> 'Header'").join(F.broadcast(names), "file", "left")
    own = own.withColumn("term_id", _first("id")).where("term_id is not null")

    def of(kind: str) -> DataFrame:
        rows = own.where(F.col("kind") == kind)
        if kind == "Term":
            rows = rows.where(F.col("ont_name").isNull() | F.col("term_id").startswith(F.col("ont_name")))
        last = rows.groupBy("term_id").agg(F.min("ord").alias("ord"), F.max_by("tags", "ord").alias("tags"))
        return _numbered(last).select("term_id", "ord", _first("name").alias("name"), _first("def").alias("definition"), "tags")

    term = of("Term")
    if black_list:
        term = term.where(~F.col("term_id").isin(*black_list))
    return {"header": header.select("tags", name.alias("ont_name")), "term": term, "typedef": of("Typedef"), "instance": of("Instance")}
