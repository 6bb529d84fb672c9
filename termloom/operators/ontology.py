"""The ontology: canonical tables, built once and never changed."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import graph, profiles, similarity
from termloom.sources.obo import read_obo
from termloom.sources.tables import read_ontology_json
from termloom.storage import stored


def _values(tag: str) -> Column:
    return F.try_element_at("tags", F.lit(tag))


@dataclass(frozen=True)
class Ontology:
    """Terms without the obsolete ones, their edges, alternative and obsolete ids.

    Derived tables are written to the shared folder when first used.
    """

    term: DataFrame
    edge: DataFrame
    alt: DataFrame
    obsolete: DataFrame
    all_terms: DataFrame = field(repr=False, default=None)
    header: DataFrame = field(repr=False, default=None)

    @staticmethod
    def from_obo(spark: SparkSession, path: str, black_list: list[str] | None = None) -> Ontology:
        """Loads an OBO file; raises if it holds no term."""
        tables = read_obo(spark, path, black_list)
        out = Ontology.from_terms(tables["term"], black_list, tables["header"])
        if out.all_terms.isEmpty():
            raise ValueError(f"{path} holds no term")
        return out

    @staticmethod
    def from_terms(term: DataFrame, black_list: list[str] | None = None, header: DataFrame | None = None) -> Ontology:
        """From (term_id, ord, name, definition, tags)."""
        term = stored(term)
        gone = term.where(F.try_element_at(_values("is_obsolete"), F.lit(1)) == "true")
        first = F.coalesce(_values("replaced_by")[0], _values("consider")[0])
        prefix = F.split(first, ":")[0]
        hint = gone.select("term_id", first.alias("m"), F.when(first.contains(":"), prefix).alias("p")).where("m is not null and (p is null or contains(term_id, p))")
        live = term.join(gone.select("term_id"), "term_id", "left_anti")
        named = live.select(F.col("term_id").alias("main_id"), F.explode(_values("alt_id")).alias("alt_id")).where("alt_id <> main_id")
        if black_list:
            named = named.where(~F.col("alt_id").isin(*black_list))
        named = named.groupBy("alt_id").agg(F.max("main_id").alias("main_id"))
        both = named.unionByName(hint.select(F.col("term_id").alias("alt_id"), F.col("m").alias("main_id")).join(named.select("alt_id"), "alt_id", "left_anti"))
        edge = live.select(F.col("term_id").alias("child"), F.explode(_values("is_a")).alias("parent")).distinct()
        return Ontology(stored(live), stored(edge), stored(graph.resolve_chains(both)), stored(gone.select("term_id")), term, header)

    @staticmethod
    def from_edges(term: DataFrame, edge: DataFrame) -> Ontology:
        """From (term_id, name) and (child, parent), without alternatives."""
        spark = term.sparkSession
        none = F.lit(None)
        rows = term.select("term_id", none.cast("int").alias("ord"), (F.col("name") if "name" in term.columns else F.col("term_id")).alias("name"), none.cast("string").alias("definition"), F.create_map().cast("map<string,array<string>>").alias("tags"))
        rows = stored(rows)
        return Ontology(rows, stored(edge.select("child", "parent").distinct()), spark.createDataFrame([], "alt_id string, main_id string"), spark.createDataFrame([], "term_id string"), rows)

    @staticmethod
    def from_json(spark: SparkSession, path: str) -> Ontology:
        """From a JSON dump of an ontology object; what it derives is derived anew."""
        got = read_ontology_json(spark, path)
        out = Ontology.from_terms(got["term"])
        # the dump's own alternatives count beside those of the stanzas
        more = got["alt"].join(out.alt.select("alt_id"), "alt_id", "left_anti")
        return replace(out, alt=stored(out.alt.select("alt_id", "main_id").unionByName(more)))

    @cached_property
    def closure(self) -> DataFrame:
        return stored(graph.closure(self.edge, self.term))

    @cached_property
    def reflexive(self) -> DataFrame:
        return graph.reflexive(self.closure, self.term)

    @cached_property
    def level(self) -> DataFrame:
        return stored(graph.levels(self.term, self.edge, self.closure))

    @cached_property
    def meta(self) -> DataFrame:
        """(term_id, n_anc, n_desc, struct_freq, level)."""
        return stored(graph.frequencies(self.term, self.closure).join(self.level, "term_id"))

    @cached_property
    def paths(self) -> DataFrame:
        return stored(graph.paths(self.term, self.edge, self.closure))

    def meta_with(self, profile: DataFrame) -> DataFrame:
        """``meta`` with the observed frequencies of a profile table, null where unseen."""
        return self.meta.join(profiles.observed_frequencies(profile, self.reflexive), "term_id", "left")

    def ic(self, *ic_types: str, profile: DataFrame | None = None, zhou_k: float = 0.5, compat: bool = False) -> DataFrame:
        meta = self.meta if profile is None else self.meta_with(profile)
        return similarity.ics(meta, ic_types or ("resnik",), zhou_k, compat)

    def term_similarities(self, a: DataFrame, b: DataFrame | None = None, sim_type: str = "lin", ic_type: str = "resnik", profile: DataFrame | None = None) -> DataFrame:
        """(a, b, mica, mica_ic, sim) of the term pairs of the profiles compared."""
        ic = stored(self.ic(*{ic_type, "resnik"}, profile=profile))
        own = "resnik" if sim_type in ("eric", "neric", "nweric", "erlin") else ic_type
        used = a.select("term_id").unionByName((a if b is None else b).select("term_id")).distinct()
        mica = similarity.micas(similarity.term_pairs(a, b), self.reflexive, ic, f"ic_{own}", used)
        top = self.meta.agg(F.max("struct_freq")).first()[0] if sim_type == "nweric" else None
        return similarity.similarities(mica, ic, sim_type, ic_type, top)

    # lookups -------------------------------------------------------------------------

    def main_ids(self, ids: DataFrame, column: str = "term_id") -> DataFrame:
        return profiles.main_ids(ids, self.term, self.alt, column)

    def dictionary(self, tag: str, regex: str | None = None, all_terms: bool = True) -> DataFrame:
        """(term_id, value, pos) of a tag; with ``regex`` its first group where it matches."""
        source = self.all_terms if all_terms else self.term
        rows = source.select("term_id", F.posexplode(_values(tag)).alias("pos", "value"))
        if regex is not None:
            rows = rows.where(F.col("value").rlike(regex)).withColumn("value", F.regexp_extract("value", regex, 1))
        return rows.select("term_id", "value", "pos")

    def by_value(self, tag: str, regex: str | None = None, multi: bool = False) -> DataFrame:
        """(value, term_id) with the last term of a value, or (value, terms) with all."""
        rows = self.dictionary(tag, regex).join(self.all_terms.select("term_id", "ord"), "term_id")
        if multi:
            return rows.groupBy("value").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "term_id"))), lambda x: x["term_id"]).alias("terms"))
        return rows.groupBy("value").agg(F.max_by("term_id", F.struct("ord", "term_id")).alias("term_id"))

    def names_of(self, ids: DataFrame, column: str = "term_id") -> DataFrame:
        """``ids`` with main_id and name; both null for ids that are unknown."""
        named = self.main_ids(ids, column)
        return named.join(self.term.select(F.col("term_id").alias("main_id"), "name"), "main_id", "left")

    def ids_of(self, names: DataFrame, column: str = "name") -> DataFrame:
        """``names`` with term_id, by name or else by synonym; null for unknown ones."""
        n = self.term.groupBy(F.col("name").alias(column)).agg(F.max_by("term_id", "ord").alias("_n"))
        s = self.by_value("synonym", r'"(.*)"').select(F.col("value").alias(column), F.col("term_id").alias("_s"))
        return names.join(n, column, "left").join(s, column, "left").withColumn("term_id", F.coalesce("_n", "_s")).drop("_n", "_s")

    def extract_ids(self, texts: DataFrame, column: str = "text", split_by: str = " ") -> DataFrame:
        """``texts`` with term_id: the text, or its first part, if that is a term."""
        t = self.term.select("term_id")
        whole, part = t.select(F.col("term_id").alias(column), F.col("term_id").alias("_w")), t.select(F.col("term_id").alias("_p"))
        rows = texts.withColumn("_first", F.split(F.col(column), F.lit("\\Q" + split_by + "\\E"))[0])
        rows = rows.join(whole, column, "left").join(part, F.col("_first") == F.col("_p"), "left")
        return rows.withColumn("term_id", F.coalesce("_w", "_p")).drop("_w", "_p", "_first")

    def search(self, keyword: str, tags: tuple[str, ...] = ("name", "synonym", "def")) -> DataFrame:
        """(term_id): terms with a value of the tags that the pattern matches, case ignored."""
        values = F.flatten(F.array(*(F.coalesce(_values(t), F.array().cast("array<string>")) for t in tags)))
        return self.term.where(F.exists(values, lambda v: v.rlike("(?i)" + keyword))).select("term_id")

    def attributes(self) -> DataFrame:
        """(term_id, name, level, synonyms): synonyms joined by ``|``."""
        syn = self.dictionary("synonym", r'"(.*)"', False).groupBy("term_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]), "|").alias("synonyms"))
        return self.term.select("term_id", "name").join(self.level, "term_id").join(syn, "term_id", "left").fillna("", ["synonyms"])

    def level_terms(self) -> DataFrame:
        """(level, terms)."""
        return self.level.where("level is not null").groupBy("level").agg(F.array_sort(F.collect_list("term_id")).alias("terms"))

    def children_table(self, terms: DataFrame) -> DataFrame:
        """(term_id, name, below): descendants with their names."""
        kin = graph.familiar(self.closure, terms, up=False)
        named = kin.join(self.term.select(F.col("term_id").alias("related"), F.col("name").alias("n")), "related")
        lists = named.groupBy("term_id").agg(F.array_sort(F.collect_list(F.struct(F.col("related").alias("term_id"), F.col("n").alias("name")))).alias("below"))
        return terms.select("term_id").distinct().join(self.term.select("term_id", "name"), "term_id").join(lists, "term_id", "left")

    def structure(self) -> str:
        return graph.structure_type(self.term, self.edge, self.closure).first()[0]

    def tables(self) -> dict[str, DataFrame]:
        return {"term": self.all_terms, "edge": self.edge, "alt": self.alt, "obsolete": self.obsolete, "closure": self.closure, "meta": self.meta}

    def same_as(self, other: Ontology) -> bool:
        """Whether both hold the same terms, edges, alternatives and obsolete ids."""
        for a, b in ((self.term.select("term_id", "name"), other.term.select("term_id", "name")), (self.edge, other.edge), (self.alt, other.alt), (self.obsolete, other.obsolete)):
            if not a.exceptAll(b).isEmpty() or not b.exceptAll(a).isEmpty():
                return False
        return True

    def reroot(self, root: str) -> Ontology:
        """The part of the ontology at and below ``root``."""
        inside = self.closure.where(F.col("ancestor") == root).select("term_id").unionByName(self.term.where(F.col("term_id") == root).select("term_id")).distinct()
        inside = stored(inside)
        edge = self.edge.join(inside.withColumnRenamed("term_id", "child"), "child", "left_semi").join(inside.withColumnRenamed("term_id", "parent"), "parent", "left_semi").where(F.col("child") != root)
        return Ontology(self.term.join(inside, "term_id", "left_semi"), edge.select("child", "parent"), self.alt.join(inside.withColumnRenamed("term_id", "main_id"), "main_id", "left_semi").select("alt_id", "main_id"), self.obsolete, self.all_terms, self.header)
