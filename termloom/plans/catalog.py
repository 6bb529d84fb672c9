"""An ontology and profiles derived from the test tables, and the same in SQL.

    ROOT <- B:brand, T:type, Z:size;  B and Z <- C:brand|size;  C and T <- P:part

Orders are profiles of parts, and of brands where a line was returned; nations are profiles
of the part classes that their customers order.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.operators.ontology import Ontology
from termloom.storage import stored


class Catalog:
    """The derived tables of one folder of test tables."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._kept: dict[str, DataFrame] = {}

    def kept(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that several queries use, stored when first asked for."""
        if name not in self._kept:
            self._kept[name] = stored(make())
        return self._kept[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def named(self) -> DataFrame:
        """Parts with the ids of their terms."""
        return self.table("part").select(
            "p_partkey",
            F.concat(F.lit("B:"), "p_brand").alias("b"),
            F.concat(F.lit("T:"), "p_type").alias("t"),
            F.concat(F.lit("Z:"), F.col("p_size").cast("string")).alias("z"),
            F.concat(F.lit("C:"), "p_brand", F.lit("|"), F.col("p_size").cast("string")).alias("c"),
            F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("p"),
        )

    @cached_property
    def ontology(self) -> Ontology:
        root = F.lit("ROOT")
        pair = lambda a, b: F.struct(F.col(a).alias("child"), (b if not isinstance(b, str) else F.col(b)).alias("parent"))
        links = F.array(pair("b", root), pair("t", root), pair("z", root), pair("c", "b"), pair("c", "z"), pair("p", "c"), pair("p", "t"))
        edge = stored(self.named.select(F.explode(links).alias("e")).select("e.*").distinct())
        term = edge.select(F.col("child").alias("term_id")).distinct().unionByName(self.spark.createDataFrame([("ROOT",)], "term_id string"))
        return Ontology.from_edges(term, edge)

    @cached_property
    def lines(self) -> DataFrame:
        li = self.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_returnflag", "l_linestatus")
        return li.join(self.named, F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def orders(self) -> DataFrame:
        """(profile_id, pos, term_id) of every order."""
        term = F.when(F.col("l_returnflag") == "R", F.col("b")).otherwise(F.col("p"))
        return self.lines.select(F.col("l_orderkey").cast("string").alias("profile_id"), F.col("l_linenumber").cast("int").alias("pos"), term.alias("term_id"))

    @cached_property
    def nations(self) -> DataFrame:
        """(profile_id, pos, term_id): the classes that a nation's customers order, each once."""
        o = self.table("orders").select("o_orderkey", "o_custkey")
        c = self.table("customer").select("c_custkey", "c_nationkey")
        rows = self.lines.select("l_orderkey", "c").join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
        rows = rows.select(F.concat(F.lit("N:"), F.col("c_nationkey").cast("string")).alias("profile_id"), F.col("c").alias("term_id")).distinct()
        return stored(rows.withColumn("pos", F.row_number().over(Window.partitionBy("profile_id").orderBy("term_id")).cast("int") - 1).select("profile_id", "pos", "term_id"))

    @cached_property
    def follows(self) -> DataFrame:
        """(a, b): classes of neighbouring lines of an order, as unordered pairs."""
        x = self.lines.select("l_orderkey", F.col("l_linenumber").alias("n"), F.col("c").alias("x"))
        y = self.lines.select("l_orderkey", (F.col("l_linenumber") - 1).alias("n"), F.col("c").alias("y"))
        return stored(x.join(y, ["l_orderkey", "n"]).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())


_known: dict[tuple[str, str], Catalog] = {}


def catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalog of a folder, one for all queries of a session: its ontology, closure and
    profiles are derived once.  The folder's tables must not change in the meantime."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _known:
        _known.clear()
        _known[key] = Catalog(spark, sf_dir)
    return _known[key]


PART = """named as (select p_partkey, 'B:' || p_brand as b, 'T:' || p_type as t, 'Z:' || p_size as z, 'C:' || p_brand || '|' || p_size as c, 'P:' || p_partkey as p from part),
edge as (select b as child, 'ROOT' as parent from named union select t, 'ROOT' from named union select z, 'ROOT' from named
         union select c, b from named union select c, z from named union select p, c from named union select p, t from named),
term as (select 'ROOT' as term_id union select child from edge),
walk as (select child as term_id, parent as ancestor, 1 as dist from edge union select w.term_id, e.parent, w.dist + 1 from walk w join edge e on e.child = w.ancestor),
closure as (select term_id, ancestor, min(dist)::int as dist from walk group by all),
rc as (select term_id, ancestor, dist from closure union all select term_id, term_id, 0 from term),
lev as (select term_id, (coalesce((select min(dist) from closure c where c.term_id = term.term_id and ancestor = 'ROOT'), 0) + 1)::int as level from term),
freq as (select term_id, (select count(*) from closure c where c.term_id = term.term_id) as n_anc, (select count(*) from closure c where c.ancestor = term.term_id) as n_desc from term),
meta as (select freq.*, (n_desc + 1)::double as struct_freq, level from freq join lev using (term_id)),
top as (select count(*)::double as n_terms, max(struct_freq) as max_struct, max(level)::double as max_depth from meta),
ic as (select term_id, -log10(struct_freq / max_struct) + 0.0 as ic_resnik from meta, top),
lines as (select l_orderkey, l_linenumber, l_returnflag, l_linestatus, named.* from lineitem join named on l_partkey = p_partkey),
prof as (select l_orderkey::varchar as profile_id, l_linenumber::int as pos, case when l_returnflag = 'R' then b else p end as term_id from lines)"""

NATION = """nat as (select distinct 'N:' || c_nationkey as profile_id, c as term_id from lines join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey)"""

PAIRS = """pairs as (select distinct least(x.c, y.c) as a, greatest(x.c, y.c) as b from lines x join lines y on x.l_orderkey = y.l_orderkey and x.l_linenumber + 1 = y.l_linenumber)"""

MICA = """mica as (select a, b, arg_max(ra.ancestor, (ic_resnik, ra.ancestor)) as mica, max(ic_resnik) as mica_ic from pairs
  join rc ra on ra.term_id = a join rc rb on rb.term_id = b and rb.ancestor = ra.ancestor join ic on ic.term_id = ra.ancestor group by a, b),
scored as (select mica.*, x.ic_resnik as ica, y.ic_resnik as icb from mica join ic x on x.term_id = a join ic y on y.term_id = b)"""


def sql(*ctes: str, body: str) -> str:
    return "with recursive " + ",\n".join((PART, *ctes)) + "\n" + body
