"""Queries of the readers and writers: tables written as files in each format and read back.

The ontology of these files is made of ``part``: a root, the brands below it and the parts below
these, with alternative ids, synonyms, cross references, obsolete terms that name a
successor, a term of another ontology and a type definition.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import items
from termloom.operators.ontology import Ontology
from termloom.plans.catalog import Catalog
from termloom.sources import obo, sinks, tables
from termloom.storage import shared_dir

_HEADER = "format-version: 1.2\nontology: pt\n\n"
_FIRST = """[Term]
id: PT:ROOT
name: All
comment: the top

[Term]
id: OTHER:1
name: not of this ontology
is_a: PT:ROOT

[Typedef]
id: PT:part_of
name: part of
"""


class Files:
    """Files made of the tables of a catalog, each written when first asked for."""

    def __init__(self, c: Catalog):
        self.c = c

    def _text(self, rows: DataFrame) -> str:
        """``rows(k, value)`` as text files that continue each other in the order of k, each with the header."""
        path = shared_dir(self.c.spark)
        first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0  # of a partition
        value = F.when(first, F.concat(F.lit(_HEADER), F.col("value"))).otherwise(F.col("value"))
        rows.orderBy("k").select(value.alias("value")).write.text(path)
        return path

    @cached_property
    def obo(self) -> str:
        part = self.c.table("part")
        text = lambda s, *a: F.format_string(s, *(F.col(x).cast("string") for x in a))
        top = self.c.spark.createDataFrame([("0", _FIRST)], "k string, value string")
        brand = part.select("p_brand").distinct().select(F.concat(F.lit("1"), F.col("p_brand")).alias("k"), text("[Term]\nid: PT:%s\nname: brand %s\nis_a: PT:ROOT ! All\n", "p_brand", "p_brand").alias("value"))
        gone = (F.col("p_partkey") % 11 == 0) & (F.col("p_partkey") > 0)
        lines = F.concat(
            text('[Term]\nid: PT:%s\nname: %s\ndef: "%s of %s" []\nsynonym: "%s %s" EXACT []\nxref: XR:%s\n', "p_partkey", "p_name", "p_type", "p_brand", "p_brand", "p_size", "p_size"),
            F.when(F.col("p_partkey") % 5 == 0, text("alt_id: PT:A%s\n", "p_partkey")).otherwise(F.lit("")),
            F.when(gone, F.format_string("is_obsolete: true\nreplaced_by: PT:%s\n", (F.col("p_partkey") - 1).cast("string"))).otherwise(text("is_a: PT:%s ! brand %s\n", "p_brand", "p_brand")),
        )
        rows = part.select(F.format_string("2%018d", "p_partkey").alias("k"), lines.alias("value"))
        return self._text(top.unionByName(brand).unionByName(rows))

    @cached_property
    def ontology(self) -> Ontology:
        return Ontology.from_obo(self.c.spark, self.obo)

    @cached_property
    def json(self) -> str:
        """All terms as JSON objects with profiles and items."""
        path = shared_dir(self.c.spark)
        sinks.write_ontology_json(self.ontology.all_terms, self.ontology.alt, self.profiles, path)
        return path

    @cached_property
    def profiles(self) -> DataFrame:
        """(profile_id, pos, term_id): the parts that each nation's suppliers sell."""
        s = self.c.table("supplier").select("s_suppkey", "s_nationkey")
        li = self.c.table("lineitem").select("l_suppkey", "l_partkey")
        rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).groupBy("s_nationkey", "l_partkey").agg(F.count("*").alias("n"))
        return rows.select(F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("profile_id"), F.col("l_partkey").cast("int").alias("pos"), F.concat(F.lit("PT:"), F.col("l_partkey").cast("string")).alias("term_id"))


_P = """p as (select p_partkey as k, 'PT:' || p_partkey as id, p_name as name, p_brand as b, p_type as t, p_size as z, p_partkey % 11 = 0 and p_partkey > 0 as gone from part),
all_terms as (select 'PT:ROOT' as term_id, 'All' as name, '0' as o union all select distinct 'PT:' || b, 'brand ' || b, '1' || b from p union all select id, name, '2' || lpad(k::varchar, 18, '0') from p),
live as (select term_id, name, o from all_terms where term_id not in (select id from p where gone)),
alt as (select 'PT:A' || k as alt_id, id as main_id from p where k % 5 = 0 and not gone union all select id, 'PT:' || (k - 1) from p where gone),
prof as (select distinct 'N' || s_nationkey as profile_id, l_partkey::int as pos, 'PT:' || l_partkey as term_id from lineitem join supplier on l_suppkey = s_suppkey)
"""


def _sql(body: str, *ctes: str) -> str:
    return "with " + ", ".join((_P, *ctes)) + body


_ASKED = "asked as (select 'PT:A' || p_partkey as term_id from part where p_partkey % 5 = 0 union all select 'PT:' || p_partkey from part union all select 'PT:nothing')"


def _asked(f: Files) -> DataFrame:
    part = f.c.table("part")
    ids = part.where("p_partkey % 5 = 0").select(F.concat(F.lit("PT:A"), F.col("p_partkey").cast("string")).alias("term_id"))
    return ids.unionByName(part.select(F.concat(F.lit("PT:"), F.col("p_partkey").cast("string")).alias("term_id"))).unionByName(f.c.spark.createDataFrame([("PT:nothing",)], "term_id string"))


def _size(tag: str):
    return F.coalesce(F.size(F.try_element_at("tags", F.lit(tag))), F.lit(0))


def obo_terms(f: Files) -> DataFrame:
    return obo.read_obo(f.c.spark, f.obo)["term"].select("term_id", "ord", "name", "definition", _size("is_a").alias("n_is_a"), _size("alt_id").alias("n_alt"))


def obo_names_of(f: Files) -> DataFrame:
    return f.ontology.names_of(_asked(f)).select("term_id", "main_id", "name")


def obo_ids_of(f: Files) -> DataFrame:
    part = f.c.table("part")
    names = part.select(F.col("p_name").alias("name")).unionByName(part.select(F.concat_ws(" ", "p_brand", F.col("p_size").cast("string")).alias("name"))).distinct()
    return f.ontology.ids_of(names).select("name", "term_id")


def obo_extract_ids(f: Files) -> DataFrame:
    texts = _asked(f).select(F.concat("term_id", F.lit(" and so on")).alias("text"))
    return f.ontology.extract_ids(texts).select("text", "term_id")


def obo_structure(f: Files) -> DataFrame:
    return f.c.spark.createDataFrame([(f.ontology.structure(),)], "structure string")


def profiles_file(f: Files) -> DataFrame:
    path = shared_dir(f.c.spark)
    sinks.write_profiles(f.profiles, path)
    return tables.read_profiles(f.c.spark, path)


def profiles_two_columns_file(f: Files) -> DataFrame:
    path = shared_dir(f.c.spark)
    sinks.write_profiles(f.profiles, path, two_columns=True)
    return tables.read_profiles(f.c.spark, path, two_columns=True).select("profile_id", "term_id")


def relations_file(f: Files) -> DataFrame:
    path = shared_dir(f.c.spark)
    rows = f.c.table("lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count("*").alias("n"))
    sinks.write_pairs(rows.select(F.col("l_suppkey").cast("string"), "l_returnflag", "n"), path)
    return tables.read_relations(f.c.spark, path).select("term1", "term2", "value")


def scores_file(f: Files) -> DataFrame:
    path = shared_dir(f.c.spark)
    one = F.struct(F.col("l_linenumber"), F.concat(F.lit("T"), F.col("l_linenumber").cast("string")).alias("t"), F.concat_ws(";", F.col("l_quantity").cast("string"), F.col("l_tax").cast("string")).alias("s"))
    rows = f.c.table("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(one)).alias("x"))
    join = lambda k: F.array_join(F.transform("x", lambda x: x[k]), ",")
    sinks.write_pairs(rows.select(F.col("l_orderkey").cast("string"), join("t"), join("s")), path)
    return tables.read_scores(f.c.spark, path)


def keywords_file(f: Files) -> DataFrame:
    path = shared_dir(f.c.spark)
    rows = f.c.table("part").select(F.col("p_partkey").cast("string").alias("k"), "p_name", F.concat_ws("|", "p_brand", "p_type", "p_brand").alias("more"))
    sinks.write_pairs(rows, path)
    return tables.read_keywords(f.c.spark, path)


def query_keywords_file(f: Files) -> DataFrame:
    path = shared_dir(f.c.spark)
    sinks.write_pairs(f.c.table("part").select(F.col("p_partkey").cast("string").alias("k"), "p_type", F.concat_ws(",", "p_brand", "p_name").alias("more")), path)
    return tables.read_query_keywords(f.c.spark, path).select("id", "keyword", F.array_join("alternatives", ";").alias("alternatives"))


def table_file(f: Files) -> DataFrame:
    path = shared_dir(f.c.spark)
    sinks.write_pairs(f.c.table("part").select("p_name", "p_brand", F.col("p_size").cast("string").alias("z")), path)
    size = f.c.table("part").agg(F.min("p_size")).first()[0]
    return tables.read_table(f.c.spark, path, [0], "\t", 2, str(size)).select("text")


def list_file(f: Files) -> DataFrame:
    path = shared_dir(f.c.spark)
    f.c.table("part").select(F.concat(F.lit("  "), F.col("p_name"), F.lit(" ")).alias("value")).write.text(path)
    return tables.read_list(f.c.spark, path).groupBy("text").agg(F.count("*").alias("n"))


def json_terms(f: Files) -> DataFrame:
    o = Ontology.from_json(f.c.spark, f.json)
    return o.meta.join(o.term.select("term_id", "name"), "term_id").select("term_id", "name", "n_anc", "n_desc", "level")


def json_profiles(f: Files) -> DataFrame:
    got = tables.read_ontology_json(f.c.spark, f.json)
    return got["profile"].join(got["item"].select("term_id", F.col("item_id").alias("profile_id")), ["profile_id", "term_id"]).select("profile_id", "pos", "term_id")


_META = """kin as (select id as term_id, 'PT:' || b as ancestor, 1 as dist from p where not gone union all select id, 'PT:ROOT', 2 from p where not gone union all select distinct 'PT:' || b, 'PT:ROOT', 1 from p)"""

#: name -> (query, SQL)
FILES = {
    "obo_terms": (
        obo_terms,
        _sql("""select a.term_id, (row_number() over (order by o) - 1)::int as ord, a.name, case when p.k is not null then '"' || p.t || ' of ' || p.b || '" []' end as definition,
                case when a.term_id = 'PT:ROOT' then 0 when p.gone then 0 else 1 end as n_is_a, case when p.k % 5 = 0 then 1 else 0 end as n_alt from all_terms a left join p on p.id = a.term_id"""),
    ),
    "obo_edges": (lambda f: f.ontology.edge, _sql("select id as child, 'PT:' || b as parent from p where not gone union all select distinct 'PT:' || b, 'PT:ROOT' from p")),
    "obo_alternatives": (lambda f: f.ontology.alt.select("alt_id", "main_id"), _sql("select alt_id, main_id from alt")),
    "obo_obsolete": (lambda f: f.ontology.obsolete, _sql("select id as term_id from p where gone")),
    "obo_dictionary": (lambda f: f.ontology.dictionary("xref", r"^XR:(\d+)$"), _sql("select id as term_id, z::varchar as value, 0 as pos from p")),
    "items_from_dictionary": (lambda f: items.from_dictionary(f.ontology.dictionary("xref", r"^XR:(\d+)$")), _sql("select id as term_id, z::varchar as item_id from p")),
    "item_level_terms": (
        lambda f: items.level_terms(items.from_dictionary(f.ontology.dictionary("xref")), f.ontology.level).select("level", F.size("terms").alias("n"), F.col("terms")[0].alias("first")),
        _sql("select 3 as level, count(*)::int as n, min(id) as first from p where not gone"),
    ),
    "obo_by_value": (lambda f: f.ontology.by_value("xref", r"^XR:(\d+)$"), _sql("select z::varchar as value, arg_max(id, k) as term_id from p group by z")),
    "obo_names_of": (
        obo_names_of,
        _sql("select x.term_id, l.term_id as main_id, l.name from asked x left join alt a on a.alt_id = x.term_id left join live l on l.term_id = coalesce(a.main_id, x.term_id)", _ASKED),
    ),
    "obo_ids_of": (
        obo_ids_of,
        _sql(
            "select n.name, coalesce(x.term_id, y.term_id) as term_id from n left join x using (name) left join y using (name)",
            "n as (select name from p union select b || ' ' || z from p), x as (select name, arg_max(term_id, o) as term_id from live group by name), y as (select b || ' ' || z as name, arg_max(id, k) as term_id from p group by 1)",
        ),
    ),
    "obo_search": (
        lambda f: f.ontology.search("ring|g.*o|of Brand#1"),
        _sql("select l.term_id from live l left join p on p.id = l.term_id where regexp_matches(lower(l.name), 'ring|g.*o|of brand#1') or regexp_matches(lower(p.b || ' ' || p.z), 'ring|g.*o|of brand#1') or regexp_matches(lower(p.t || ' of ' || p.b), 'ring|g.*o|of brand#1')"),
    ),
    "obo_attributes": (
        lambda f: f.ontology.attributes(),
        _sql("select l.term_id, l.name, case when l.term_id = 'PT:ROOT' then 1 when p.k is null then 2 else 3 end as level, coalesce(p.b || ' ' || p.z, '') as synonyms from live l left join p on p.id = l.term_id"),
    ),
    "obo_extract_ids": (obo_extract_ids, _sql("select x.term_id || ' and so on' as text, l.term_id from asked x left join live l on l.term_id = x.term_id", _ASKED)),
    "obo_structure": (obo_structure, "select 'hierarchical' as structure"),
    "profiles_file": (profiles_file, _sql("select profile_id, (row_number() over (partition by profile_id order by pos, term_id) - 1)::int as pos, term_id from prof")),
    "profiles_two_columns_file": (profiles_two_columns_file, _sql("select profile_id, term_id from prof")),
    "relations_file": (relations_file, "select l_suppkey::varchar as term1, l_returnflag as term2, count(*)::double as value from lineitem group by 1, 2"),
    "scores_file": (scores_file, "select l_orderkey::varchar as doc_id, 'T' || l_linenumber as term_id, greatest(l_quantity, l_tax) as score from lineitem"),
    "keywords_file": (keywords_file, "select distinct p_partkey::varchar as kwd_id, unnest([p_name, p_brand, p_type]) as text from part"),
    "query_keywords_file": (query_keywords_file, "select p_partkey::varchar as id, lower(p_type) as keyword, lower(p_brand) || ';' || lower(p_name) as alternatives from part"),
    "table_file": (table_file, "select distinct p_name as text from part where p_size = (select min(p_size) from part)"),
    "list_file": (list_file, "select p_name as text, count(*) as n from part group by 1"),
    "json_terms": (
        json_terms,
        _sql(
            """select l.term_id, l.name, (select count(*) from kin where kin.term_id = l.term_id) as n_anc, (select count(*) from kin where ancestor = l.term_id) as n_desc,
                (1 + coalesce((select max(dist) from kin where kin.term_id = l.term_id), 0))::int as level from live l""",
            _META,
        ),
    ),
    "json_profiles": (json_profiles, _sql("select profile_id, (row_number() over (partition by profile_id order by pos, term_id) - 1)::int as pos, term_id from prof")),
}
