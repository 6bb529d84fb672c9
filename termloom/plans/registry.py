"""Queries of the engine over the test tables, and their SQL.

Every query reads its whole tables.  Those without SQL are iterative or sequential; their
operators are tested on small fixtures.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions import splitter, strings
from termloom.operators import cluster, compare, graph, items, profiles, report, search, similarity, suggest, textindex
from termloom.plans.catalog import MICA, NATION, PAIRS, Catalog, catalog, sql
from termloom.plans.files import FILES, Files
from termloom.storage import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, oracle: str | None = None):
    """Registers a function of a catalog under a name, with its SQL."""

    def add(f: Callable[[Catalog], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(catalog(spark, sf_dir))
        if oracle is not None:
            ORACLE_SQL[name] = oracle
        return f

    return add


def _r(c: str | Column, alias: str | None = None) -> Column:
    """Six digits, without a negative zero."""
    return (F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)).alias(alias or c)


# graph -------------------------------------------------------------------------------


@_query("closure", sql(body="select term_id, ancestor, dist from closure"))
def _(c: Catalog) -> DataFrame:
    return c.ontology.closure


@_query("levels", sql(body="select term_id, level from lev"))
def _(c: Catalog) -> DataFrame:
    return c.ontology.level


@_query(
    "levels_longest",
    sql(body="select term_id, (max(dist) + 1)::int as level from (select term_id, dist from walk where ancestor = 'ROOT' union all select 'ROOT', 0) group by term_id"),
)
def _(c: Catalog) -> DataFrame:
    o = c.ontology
    return graph.levels(o.term, o.edge, o.closure, shortest=False)


@_query("roots_and_leaves", sql(body="select term_id, 'root' as kind from term where term_id not in (select term_id from closure) union all select term_id, 'leaf' from term where term_id not in (select ancestor from closure)"))
def _(c: Catalog) -> DataFrame:
    o = c.ontology
    top = graph.roots(o.term, o.closure).select("term_id", F.lit("root").alias("kind"))
    return top.unionByName(graph.leaves(o.term, o.closure).select("term_id", F.lit("leaf").alias("kind")))


@_query("structure_type", sql(body="select case when (select count(*) from edge) = 0 then 'atomic' when (select count(*) from term) - (select count(distinct child) from edge) >= 2 then 'sparse' else 'hierarchical' end as structure"))
def _(c: Catalog) -> DataFrame:
    o = c.ontology
    return graph.structure_type(o.term, o.edge, o.closure)


@_query("frequencies", sql(body="select term_id, n_anc, n_desc, struct_freq from meta"))
def _(c: Catalog) -> DataFrame:
    return c.ontology.meta.select("term_id", "n_anc", "n_desc", "struct_freq")


_PATHS = "ways as (select 'ROOT' as term_id, 1 as n, 'ROOT' as way union all select e.child, n + 1, e.child || '>' || way from ways join edge e on e.parent = ways.term_id)"


@_query("path_stats", sql(_PATHS, body="select term_id, count(*) as total_paths, max(n)::int as largest_path, min(n)::int as shortest_path from ways group by term_id"))
def _(c: Catalog) -> DataFrame:
    o = c.ontology
    return graph.path_stats(o.term, o.edge, o.closure)


@_query("parental_paths", sql(_PATHS, body="select term_id, array_to_string(list_slice(string_split(arg_min(way, (n, way)), '>'), 2, 99), '>') as path from ways group by term_id"))
def _(c: Catalog) -> DataFrame:
    return graph.parental_path(c.ontology.paths).select("term_id", F.array_join("path", ">").alias("path"))


@_query("direct_relations", sql(body="select b.term_id, 'parent' as side, e.parent as related from (select distinct b as term_id from named) b join edge e on e.child = b.term_id union all select b.term_id, 'child', e.child from (select distinct b as term_id from named) b join edge e on e.parent = b.term_id"))
def _(c: Catalog) -> DataFrame:
    brands = c.named.select(F.col("b").alias("term_id")).distinct()
    up, down = (graph.direct(c.ontology.edge, brands, u) for u in (True, False))
    side = lambda df, s: df.select("term_id", F.lit(s).alias("side"), "related")
    return side(up, "parent").unionByName(side(down, "child"))


@_query("familiar_descendants", sql(body="select ancestor as term_id, term_id as related, dist from closure where ancestor in (select b from named)"))
def _(c: Catalog) -> DataFrame:
    return graph.familiar(c.ontology.closure, c.named.select(F.col("b").alias("term_id")), up=False)


@_query("rerooted_levels", sql(body="select term_id, (dist + 1)::int as level from closure where ancestor = (select min(b) from named) union all select min(b), 1 from named"))
def _(c: Catalog) -> DataFrame:
    root = c.named.agg(F.min("b")).first()[0]
    return graph.reroot_levels(c.ontology.edge, c.ontology.closure, root).withColumn("level", F.col("level").cast("int"))


@_query("child_relations_two_hops", sql(body="select distinct e.parent, e.child from edge e join lev on lev.term_id = e.parent where (e.parent = 'ROOT' or e.parent in (select term_id from closure where ancestor = 'ROOT')) and level <= 3"))
def _(c: Catalog) -> DataFrame:
    o = c.ontology
    return graph.child_relations(o.edge, o.closure, o.level, c.spark.createDataFrame([("ROOT",)], "term_id string"), hops=2)


@_query("level_terms", sql(body="select level, count(*) as n_terms, min(term_id) as first_term from lev group by level"))
def _(c: Catalog) -> DataFrame:
    return c.ontology.level_terms().select("level", F.size("terms").cast("long").alias("n_terms"), F.col("terms")[0].alias("first_term"))


_ALT = "alt as (select 'O:' || p_partkey as alt_id, 'P:' || p_partkey as main_id from part union all select 'OO:' || p_partkey, 'O:' || p_partkey from part)"


def _alternatives(c: Catalog) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    old = F.struct(F.concat(F.lit("O:"), key).alias("alt_id"), F.concat(F.lit("P:"), key).alias("main_id"))
    older = F.struct(F.concat(F.lit("OO:"), key).alias("alt_id"), F.concat(F.lit("O:"), key).alias("main_id"))
    return graph.resolve_chains(c.table("part").select(F.explode(F.array(old, older)).alias("a")).select("a.*"))


@_query("alternative_chains", sql(_ALT, body="select x.alt_id, coalesce(y.main_id, x.main_id) as main_id from alt x left join alt y on y.alt_id = x.main_id"))
def _(c: Catalog) -> DataFrame:
    return _alternatives(c)


# information content and similarity --------------------------------------------------


@_query(
    "ic_structural",
    sql(
        body="""select term_id, round(-log10(struct_freq / max_struct), 6) + 0.0 as ic_resnik, round(1 - log10(struct_freq) / log10(n_terms), 6) + 0.0 as ic_seco,
        round(0.5 * (1 - log10(struct_freq) / log10(n_terms)) + 0.5 * (case when n_desc > 0 then log10(n_desc) / log10(max_depth) end), 6) + 0.0 as ic_zhou,
        round(case when n_anc > 0 then -log10((n_desc / n_anc::double + 1) / (max_depth + 1)) end, 6) + 0.0 as ic_sanchez from meta, top"""
    ),
)
def _(c: Catalog) -> DataFrame:
    ic = c.ontology.ic("resnik", "seco", "zhou", "sanchez")
    return ic.select("term_id", *(_r(f"ic_{t}") for t in ("resnik", "seco", "zhou", "sanchez")))


_OBS = "obs as (select ancestor as term_id, count(*)::double as f from prof join rc using (term_id) group by ancestor)"


@_query("ic_observed", sql(_OBS, body="select term_id, f as observed_freq, round(-log10(f / (select max(f) from obs)), 6) + 0.0 as ic_resnik_observed from term left join obs using (term_id)"))
def _(c: Catalog) -> DataFrame:
    meta = stored(c.ontology.meta_with(c.orders))
    return meta.select("term_id", "observed_freq").join(similarity.ics(meta, ("resnik_observed",)), "term_id").select("term_id", "observed_freq", _r("ic_resnik_observed"))


def _mica(c: Catalog) -> tuple[DataFrame, DataFrame]:
    ic = c.kept("ic", lambda: c.ontology.ic("resnik"))
    return similarity.micas(c.follows, c.ontology.reflexive, ic), ic


@_query("mica", sql(PAIRS, MICA, body="select a, b, mica, round(mica_ic, 6) + 0.0 as mica_ic from mica"))
def _(c: Catalog) -> DataFrame:
    return _mica(c)[0].select("a", "b", "mica", _r("mica_ic"))


_SIMS = {
    "resnik": "mica_ic",
    "lin": "case when a = b then 1.0 else 2 * mica_ic / nullif(ica + icb, 0) end",
    "jiang_conrath": "ica + icb - 2 * mica_ic",
    "eric": "greatest(0.0, 2 * mica_ic - least(ica, icb))",
    "neric": "case when a = b or least(ica, icb) <= 0 then 1.0 else greatest(0.0, 2 * mica_ic - least(ica, icb)) / least(ica, icb) end",
    "nweric": "greatest(0.0, 2 * mica_ic - least(ica, icb)) / log10((select max_struct from top))",
    "erlin": "case when a = b then 1.0 when 2 * mica_ic - least(ica, icb) > 0 then 2 * mica_ic / nullif(ica + icb, 0) else 0.0 end",
}


def _sim(kind: str) -> Callable[[Catalog], DataFrame]:
    def run(c: Catalog) -> DataFrame:
        mica, ic = _mica(c)
        top = c.ontology.meta.agg(F.max("struct_freq")).first()[0] if kind == "nweric" else None
        return similarity.similarities(mica, ic, kind, "resnik", top).select("a", "b", _r("sim"))

    return run


for _kind, _expr in _SIMS.items():
    _query(f"sim_{_kind}", sql(PAIRS, MICA, body=f"select a, b, round({_expr}, 6) + 0.0 as sim from scored"))(_sim(_kind))


@_query(
    "common_ancestors",
    sql(PAIRS, body="select a, b, ra.ancestor from pairs join rc ra on ra.term_id = a join rc rb on rb.term_id = b and rb.ancestor = ra.ancestor where a <> b union all select a, b, ancestor from pairs join closure on term_id = a where a = b"),
)
def _(c: Catalog) -> DataFrame:
    return similarity.common_ancestors(c.follows, c.ontology.closure, c.ontology.reflexive)


_SHARED = "nt as (select profile_id, count(*) as n from prof group by 1), hit as (select profile_id, ancestor, count(*) as c from prof join closure using (term_id) group by 1, 2)"


@_query("profile_common_ancestors", sql(_SHARED, body="select profile_id, ancestor, round(c / n::double, 6) as share from hit join nt using (profile_id) where c / n::double >= 0.5"))
def _(c: Catalog) -> DataFrame:
    return similarity.profile_common_ancestors(c.orders, c.ontology.closure, 0.5).select("profile_id", "ancestor", _r("share"))


@_query(
    "profile_mica",
    sql(_SHARED, body="select profile_id, arg_max(ancestor, (ic_resnik, ancestor)) as mica, round(max(ic_resnik), 6) + 0.0 as mica_ic from hit join nt using (profile_id) join ic on ic.term_id = ancestor where c / n::double >= 0.5 group by profile_id"),
)
def _(c: Catalog) -> DataFrame:
    ic = c.kept("ic", lambda: c.ontology.ic("resnik"))
    return similarity.profile_mica(c.orders, c.ontology.closure, ic, cutoff=0.5).select("profile_id", "mica", _r("mica_ic"))


# profile similarity ------------------------------------------------------------------

_BMA = """pairs as (select distinct least(x.term_id, y.term_id) as a, greatest(x.term_id, y.term_id) as b from (select distinct term_id from nat) x, (select distinct term_id from nat) y)"""
_BEST = """sims as (select a, b, case when a = b then 1.0 else 2 * mica_ic / nullif(ica + icb, 0) end as sim from scored),
both_ways as (select * from sims union all select b, a, sim from sims where a <> b),
best as (select a, profile_id as pb, max(sim) as best from nat join both_ways on b = term_id group by 1, 2),
way as (select profile_id as pa, pb, sum(best) as s from nat join best on a = term_id group by 1, 2),
size as (select profile_id, count(*) as n from nat group by 1)"""


def _nation_sims(c: Catalog) -> DataFrame:
    return c.kept("nation_sims", lambda: c.ontology.term_similarities(c.nations, sim_type="lin"))


@_query(
    "profile_bma_lin",
    sql(NATION, _BMA, MICA, _BEST, body="select x.pa as a, x.pb as b, round((x.s + y.s) / (m.n + k.n), 6) + 0.0 as sim from way x join way y on x.pa = y.pb and x.pb = y.pa join size m on m.profile_id = x.pa join size k on k.profile_id = x.pb"),
)
def _(c: Catalog) -> DataFrame:
    return compare.compare_profiles(c.nations, _nation_sims(c)).select("a", "b", _r("sim"))


@_query("profile_bma_one_way", sql(NATION, _BMA, MICA, _BEST, body="select pa as a, pb as b, round(s / n, 6) + 0.0 as sim from way join size on profile_id = pa"))
def _(c: Catalog) -> DataFrame:
    return compare.compare_profiles(c.nations, _nation_sims(c), bidirectional=False).select("a", "b", _r("sim"))


@_query(
    "rank_candidates",
    sql(NATION, _BMA, MICA, _BEST, body="select pb as candidate, round(s / n, 6) + 0.0 as sim, row_number() over (order by round(s / n, 6) desc, pb)::int as rank from way join size on profile_id = pa where pa = 'N:0'"),
)
def _(c: Catalog) -> DataFrame:
    sims = compare.compare_profiles(c.nations, _nation_sims(c), bidirectional=False).select("a", "b", _r("sim"))
    return compare.rank_candidates(stored(sims), "N:0")


_OWN = """pairs as (select distinct least(x.c, y.c) as a, greatest(x.c, y.c) as b from lines x join lines y on x.l_orderkey = y.l_orderkey and x.l_linenumber < y.l_linenumber)"""


@_query(
    "profile_self_similarity",
    sql(
        _OWN,
        MICA,
        body="""select profile_id, round(coalesce(avg(sim), 1.0), 6) + 0.0 as sim from (select distinct l_orderkey as o, l_orderkey::varchar as profile_id from lines) left join
        (select x.l_orderkey as o, case when scored.a = scored.b then 1.0 else 2 * mica_ic / nullif(ica + icb, 0) end as sim from lines x join lines y on x.l_orderkey = y.l_orderkey and x.l_linenumber < y.l_linenumber
         join scored on scored.a = least(x.c, y.c) and scored.b = greatest(x.c, y.c)) using (o) group by profile_id""",
    ),
)
def _(c: Catalog) -> DataFrame:
    prof = c.lines.select(F.col("l_orderkey").cast("string").alias("profile_id"), F.col("l_linenumber").alias("pos"), F.col("c").alias("term_id"))
    x, y = prof.select("profile_id", F.col("pos").alias("i"), F.col("term_id").alias("x")), prof.select("profile_id", F.col("pos").alias("j"), F.col("term_id").alias("y"))
    pairs = stored(x.join(y, "profile_id").where("i < j").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct())
    ic = c.kept("ic", lambda: c.ontology.ic("resnik"))
    sims = similarity.similarities(similarity.micas(pairs, c.ontology.reflexive, ic), ic, "lin")
    return compare.self_similarities(prof, sims).select("profile_id", _r("sim"))


@_query("profile_mean_ic", sql(body="select profile_id, round(avg(ic_resnik), 6) + 0.0 as ic_resnik from prof join ic using (term_id) group by profile_id"))
def _(c: Catalog) -> DataFrame:
    return profiles.mean_ics(c.orders, c.ontology.ic("resnik"), ["ic_resnik"]).select("profile_id", _r("ic_resnik"))


def _brand_profiles(c: Catalog) -> DataFrame:
    """The classes that each nation's suppliers sell, each once."""
    s = c.table("supplier").select("s_suppkey", "s_nationkey")
    li = c.table("lineitem").select("l_suppkey", "l_partkey")
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c.named, F.col("l_partkey") == F.col("p_partkey"))
    n = rows.select("s_nationkey", "c").distinct()
    return c.kept("brand_profiles", lambda: n.select(F.concat(F.lit("S:"), F.col("s_nationkey").cast("string")).alias("profile_id"), F.dense_rank().over(_by("s_nationkey", "c")).alias("pos"), F.col("c").alias("term_id")))


def _by(part: str, order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(part).orderBy(order)


def _brand_sims(c: Catalog, prof: DataFrame) -> DataFrame:
    return c.kept("brand_sims", lambda: c.ontology.term_similarities(prof, sim_type="lin"))


@_query("greedy_term_matches")
def _(c: Catalog) -> DataFrame:
    prof = _brand_profiles(c)
    ref = prof.where(F.col("profile_id") == prof.agg(F.min("profile_id")).first()[0])
    return compare.term_matches(ref, prof, _brand_sims(c, prof))


_SELL = """sell as (select distinct 'S:' || s_nationkey as profile_id, c as term_id from lineitem join supplier on l_suppkey = s_suppkey join named on l_partkey = p_partkey),
ref as (select distinct term_id from sell where profile_id = (select min(profile_id) from sell)),
pairs as (select distinct least(x.term_id, y.term_id) as a, greatest(x.term_id, y.term_id) as b from (select distinct term_id from sell) x, ref y)"""
_NEGATIVE = """sims as (select a, b, case when a = b then 1.0 else 2 * mica_ic / nullif(ica + icb, 0) end as sim from scored),
both_ways as (select * from sims union all select b, a, sim from sims where a <> b),
best as (select a as term_id, max(sim) as best from both_ways where b in (from ref) group by a),
low as (select term_id, count(*) as count from sell left join best using (term_id) where coalesce(best, 0) <= 0.95 group by term_id order by count desc, term_id desc limit 20)"""


@_query("negative_terms", sql(_SELL, MICA, _NEGATIVE, body="select low.term_id, profile_id as candidate, count from low join sell using (term_id)"))
def _(c: Catalog) -> DataFrame:
    prof = _brand_profiles(c)
    ref = prof.where(F.col("profile_id") == prof.agg(F.min("profile_id")).first()[0])
    sims = stored(compare.candidate_term_sims(ref, prof, _brand_sims(c, prof)))
    return compare.negative_matrix(sims, compare.negative_terms(sims, 0.95, 20))


@_query("ward_clusters")
def _(c: Catalog) -> DataFrame:
    prof = _brand_profiles(c)
    groups, _links, _tree = cluster.cluster_profiles(compare.compare_profiles(prof, _brand_sims(c, prof)), "lin")
    return groups


_RISEN = """it as (select distinct p as term_id, l_suppkey::varchar as item_id from lineitem join named on l_partkey = p_partkey),
kin2 as (select c.ancestor as t, c.term_id from closure c join lev on lev.term_id = c.ancestor and level = 2 where c.term_id in (select term_id from it)),
up2 as (select t as term_id, item_id from kin2 join it using (term_id) where t in (select t from kin2 group by t having count(*) >= 3) group by t, item_id having count(*) >= 3),
it2 as (select * from it union select * from up2),
kin1 as (select c.ancestor as t, c.term_id from closure c join lev on lev.term_id = c.ancestor and level = 1 where c.term_id in (select term_id from it2)),
up1 as (select t as term_id, item_id from kin1 join it2 using (term_id) where t in (select t from kin1 group by t having count(*) >= 3) group by t, item_id having count(*) >= 3)"""


@_query("items_to_parents", sql(_RISEN, body="select * from it2 union select * from up1"))
def _(c: Catalog) -> DataFrame:
    item = c.table("lineitem").select("l_partkey", "l_suppkey").join(c.named.select("p_partkey", "p"), F.col("l_partkey") == F.col("p_partkey"))
    item = item.select(F.col("p").alias("term_id"), F.col("l_suppkey").cast("string").alias("item_id"))
    return items.expand_to_parents(item, c.ontology.closure, c.ontology.level, minimum_children=3)


# profiles ----------------------------------------------------------------------------

_RED = "red as (select distinct x.profile_id, x.term_id from prof x join prof y using (profile_id) join closure c on c.term_id = y.term_id and c.ancestor = x.term_id)"


@_query("clean_profiles", sql(_RED, body="select profile_id, pos, term_id from prof anti join red using (profile_id, term_id)"))
def _(c: Catalog) -> DataFrame:
    return profiles.clean(c.orders, c.ontology.closure)


_MIXED = "mixed as (select l_orderkey::varchar as profile_id, l_linenumber::int as pos, case l_returnflag when 'R' then b when 'A' then 'OO:' || p_partkey else case l_linestatus when 'O' then 'O:' || p_partkey else 'X:' || p_partkey end end as term_id from lines)"


def _mixed(c: Catalog) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    old = F.when(F.col("l_linestatus") == "O", F.concat(F.lit("O:"), key)).otherwise(F.concat(F.lit("X:"), key))
    term = F.when(F.col("l_returnflag") == "R", F.col("b")).when(F.col("l_returnflag") == "A", F.concat(F.lit("OO:"), key)).otherwise(old)
    return c.lines.select(F.col("l_orderkey").cast("string").alias("profile_id"), F.col("l_linenumber").cast("int").alias("pos"), term.alias("term_id"))


_MAIN = "res as (select x.alt_id, coalesce(y.main_id, x.main_id) as main_id from alt x left join alt y on y.alt_id = x.main_id), checked as (select m.*, case when term.term_id is not null then m.term_id else res.main_id end as main_id from mixed m left join term on term.term_id = m.term_id left join res on res.alt_id = m.term_id)"


@_query("check_ids", sql(_ALT, _MIXED, _MAIN, body="select profile_id, pos, coalesce(main_id, term_id) as term_id, main_id is not null as accepted from checked"))
def _(c: Catalog) -> DataFrame:
    good, bad = profiles.check_ids(_mixed(c), c.ontology.term, _alternatives(c))
    return good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))


@_query(
    "clean_profiles_hard",
    sql(_ALT, _MIXED, _MAIN, "good as (select profile_id, main_id as term_id, min(pos)::int as pos from checked where main_id is not null group by 1, 2)", body="select profile_id, pos, term_id from good g where not exists (select 1 from good h join closure c on c.term_id = h.term_id where h.profile_id = g.profile_id and c.ancestor = g.term_id)"),
)
def _(c: Catalog) -> DataFrame:
    return profiles.clean_hard(_mixed(c), c.ontology.term, _alternatives(c), c.ontology.closure)



@_query(
    "clean_by_score",
    sql(
        "held as (select distinct profile_id, term_id from prof), kin as (select term_id, ancestor as k from closure union all select ancestor, term_id from closure union all select term_id, term_id from term)",
        body="select distinct h.profile_id, keep as term_id from (select h.profile_id, h.term_id, arg_max(kin.k, (ic_resnik, kin.k)) as keep from held h join kin using (term_id) join held g on g.profile_id = h.profile_id and g.term_id = kin.k join ic on ic.term_id = kin.k group by 1, 2) h",
    ),
)
def _(c: Catalog) -> DataFrame:
    scores = c.ontology.ic("resnik").select("term_id", F.col("ic_resnik").alias("score"))
    return profiles.clean_by_score(c.orders, scores, c.ontology.closure)


@_query("expand_parental", sql(body="select distinct profile_id, term_id from prof union select profile_id, ancestor from prof join closure using (term_id)"))
def _(c: Catalog) -> DataFrame:
    return profiles.expand_with_parents(c.orders, c.ontology.closure)


@_query("filter_list", sql(body="select term_id from term where term_id in (select term_id from closure where ancestor = (select min(b) from named)) and term_id not in (select term_id from closure where ancestor = (select min(t) from named))"))
def _(c: Catalog) -> DataFrame:
    white, black = c.named.agg(F.min("b"), F.min("t")).first()
    return profiles.filter_terms(c.ontology.term.select("term_id"), c.ontology.closure, [white], [black])


_N = "np as (select count(distinct profile_id)::double as n from prof)"


@_query("term_frequency", sql(_N, body="select term_id, round(count(*) / any_value(n), 6) as freq from prof, np group by term_id"))
def _(c: Catalog) -> DataFrame:
    return profiles.term_frequencies(c.orders).select("term_id", _r("freq"))


@_query(
    "term_frequency_parents",
    sql(_N, body="select term_id, round(count(*) / any_value(n), 6) as freq from (select profile_id, term_id from prof union all select * from (select distinct profile_id, ancestor as term_id from prof join closure using (term_id))), np group by term_id"),
)
def _(c: Catalog) -> DataFrame:
    return profiles.term_frequencies(c.orders, c.ontology.closure).select("term_id", _r("freq"))


@_query(
    "general_profile",
    sql(_N, "often as (select term_id from prof, np group by term_id having count(*) / any_value(n) >= 0.005)", body="select term_id from often where term_id not in (select ancestor from often join closure using (term_id))"),
)
def _(c: Catalog) -> DataFrame:
    alt = c.spark.createDataFrame([], "alt_id string, main_id string")
    return profiles.general_profile(c.orders, c.ontology.term, alt, c.ontology.closure, 0.005)


@_query(
    "profile_size_stats",
    sql(
        "sz as (select count(*)::double as x from prof group by profile_id)",
        body="select count(x) as elements, sum(x) as total, max(x) as largest, min(x) as smallest, round(avg(x), 6) as average, round(var_pop(x), 6) as variance, round(stddev_pop(x), 6) as deviation, quantile_cont(x, 0.25) as q1, quantile_cont(x, 0.5) as median, quantile_cont(x, 0.75) as q3 from sz",
    ),
)
def _(c: Catalog) -> DataFrame:
    s = profiles.size_stats(c.orders)
    return s.select("elements", F.col("sum").alias("total"), F.col("max").alias("largest"), F.col("min").alias("smallest"), _r("average"), _r("variance"), _r("deviation"), "q1", "median", "q3")


@_query("profile_size_percentile", sql("sz as (select count(*)::double as x from prof group by profile_id)", body="select quantile_cont(x, 0.1) as size, round(avg(x), 4) as mean_size from sz"))
def _(c: Catalog) -> DataFrame:
    return profiles.size_at_percentile(c.orders, 90).crossJoin(profiles.mean_size(c.orders))


@_query("profile_redundancy", sql(_RED, body="select profile_id, count(*) as size, count(red.term_id) as redundant from prof left join red using (profile_id, term_id) group by profile_id"))
def _(c: Catalog) -> DataFrame:
    return profiles.redundancy(c.orders, c.ontology.closure)


_DIST = """own as (select level, count(*) as n_ontology from lev group by 1), seen as (select level, count(*) as n_cohort, count(distinct term_id) as n_unique from prof join lev using (term_id) group by 1),
dist as (select level, n_ontology, coalesce(n_cohort, 0) as n_cohort, coalesce(n_unique, 0) as n_unique, round(n_ontology / sum(n_ontology) over () * 100, 3) as pct_ontology,
         round(coalesce(n_cohort, 0) / sum(n_cohort) over () * 100, 3) as pct_weighted, round(coalesce(n_unique, 0) / sum(n_unique) over () * 100, 3) as pct_unique from own left join seen using (level))"""


@_query("level_distribution", sql(_DIST, body="select * from dist"))
def _(c: Catalog) -> DataFrame:
    return profiles.level_distribution(c.orders, c.ontology.level)


@_query(
    "specificity_index",
    sql(
        _DIST,
        "w as (select arg_max(level, (pct_ontology, level)) as top, count(*) as n from dist), d as (select level, top, n, pct_weighted - pct_ontology as d from dist, w where pct_weighted > pct_ontology)",
        body="select case when count(*) filter (level > top) = 0 then 0.0 else round(sum(d * (level - top) / (n - top)) filter (level > top) / nullif(sum(d * (top - level + 1) / top) filter (level <= top), 0), 6) end as dsi from d",
    ),
)
def _(c: Catalog) -> DataFrame:
    return profiles.specificity_index(profiles.level_distribution(c.orders, c.ontology.level)).select(_r("dsi"))


@_query("child_share", sql(body="select round(avg((n_desc > 0)::int), 6) as share from prof join meta using (term_id)"))
def _(c: Catalog) -> DataFrame:
    return profiles.child_share(c.orders, c.ontology.meta).select(_r("share"))


# lookups and reports -----------------------------------------------------------------


@_query("translate_ids", sql(_ALT, _MIXED, _MAIN, body="select profile_id, pos, term_id, p_name as name from checked left join part on main_id = 'P:' || p_partkey"))
def _(c: Catalog) -> DataFrame:
    names = c.table("part").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("main_id"), F.col("p_name").alias("name"))
    return profiles.main_ids(_mixed(c), c.ontology.term, _alternatives(c)).join(names, "main_id", "left").select("profile_id", "pos", "term_id", "name")


@_query("profile_names", sql(body="select l_orderkey::varchar as profile_id, string_agg(p_name, ';' order by l_linenumber, p_name) as names from lineitem join part on l_partkey = p_partkey group by 1"))
def _(c: Catalog) -> DataFrame:
    names = c.table("part").select(F.concat(F.lit("P:"), F.col("p_partkey").cast("string")).alias("term_id"), F.col("p_name").alias("name"))
    prof = c.lines.select(F.col("l_orderkey").cast("string").alias("profile_id"), F.col("l_linenumber").alias("pos"), F.col("p").alias("term_id"))
    return profiles.translated(prof, names).select("profile_id", F.array_join("names", ";").alias("names"))


@_query("keyword_search", "select 'PT:' || p_partkey as term_id from part where not (p_partkey % 11 = 0 and p_partkey > 0) and regexp_matches(lower(p_name), 'ring|g.*o') union all select distinct 'PT:' || p_brand from part where regexp_matches(lower('brand ' || p_brand), 'ring|g.*o')")
def _(c: Catalog) -> DataFrame:
    return _files(c).ontology.search("ring|g.*o", ("name",))


@_query("ic_report", sql(_OBS, body="select profile_id, round(avg(ic_resnik), 6) + 0.0 as ic_resnik, round(avg(-log10(f / (select max(f) from obs))), 6) + 0.0 as ic_resnik_observed from prof join ic using (term_id) join obs using (term_id) group by profile_id"))
def _(c: Catalog) -> DataFrame:
    ic = c.ontology.ic("resnik", "resnik_observed", profile=c.orders)
    return report.ic_pairs(c.orders, ic, "profile").select("profile_id", _r("ic_resnik"), _r("ic_resnik_observed"))


_PLACES = """down as (select term_id, min(list_reverse(string_split(way, '>'))) as way from ways group by term_id),
fr as (select term_id, count(*) / (select count(distinct profile_id) from prof)::double as freq from (select distinct profile_id, term_id from prof union select profile_id, ancestor from prof join closure using (term_id)) group by term_id),
place as (select term_id, level, row_number() over (partition by level order by way) as k, count(*) over (partition by level) as n, coalesce(freq, 0) as f from down join lev using (term_id) left join fr using (term_id))"""


@_query(
    "ontoplot_places",
    sql(
        _PATHS,
        _PLACES,
        body="""select term_id, level, round((k - 1) * 2 * pi() / n, 6) + 0.0 as angle, level::double as radius, round(cbrt(f), 6) as size,
        case when f < 0.2 then 0.2 when f < 0.4 then 0.3 when f < 0.6 then 0.5 when f < 0.8 then 0.7 when f < 1 then 0.9 else 1.0 end::double as alpha from place""",
    ),
)
def _(c: Catalog) -> DataFrame:
    o = c.ontology
    freq = profiles.term_frequencies(c.orders, o.closure, distinct=True)
    return report.ontoplot(o.paths, o.level, freq, "ROOT").select("term_id", "level", _r("angle"), "radius", _r("size"), "alpha")


_REL = """rel as (select b as term1, 'N:' || s_nationkey as term2, count(*)::double as value from lineitem join named on l_partkey = p_partkey join supplier on l_suppkey = s_suppkey group by 1, 2),
q as (select b as term_id from named group by b having count(*) > (select count(*) / count(distinct b) from named)),
related as (select term1 as query, term2 as target, value from rel where term1 in (from q)),
hits as (select target, count(*) as hits from related group by 1)"""


def _relations(c: Catalog) -> tuple[DataFrame, DataFrame]:
    s = c.table("supplier").select("s_suppkey", "s_nationkey")
    li = c.table("lineitem").select("l_suppkey", "l_partkey")
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(c.named, F.col("l_partkey") == F.col("p_partkey"))
    rel = rows.groupBy(F.col("b").alias("term1"), F.concat(F.lit("N:"), F.col("s_nationkey").cast("string")).alias("term2")).agg(F.count("*").cast("double").alias("value"))
    n = c.named.groupBy("b").agg(F.count("*").alias("n"))
    often = n.crossJoin(F.broadcast(n.agg(F.avg("n").alias("m")))).where(F.col("n") > F.col("m")).select(F.col("b").alias("term_id"))
    return stored(rel), stored(often)


@_query("suggestion_targets", sql(_REL, body="select target, hits from hits"))
def _(c: Catalog) -> DataFrame:
    return suggest.suggestions(*_relations(c))["targets"]


@_query("suggestion_means", sql(_REL, body="select query, round(sum(value) / (select count(*) from hits), 6) as mean from related group by query having sum(value) <> 0"))
def _(c: Catalog) -> DataFrame:
    return suggest.suggestions(*_relations(c))["means"].select("query", _r("mean"))


@_query("suggestion_cells", sql(_REL, body="select query, target, round(-log10(value), 6) + 0.0 as value from related where value <> 0"))
def _(c: Catalog) -> DataFrame:
    return suggest.suggestions(*_relations(c), transform="log10")["cells"].select("query", "target", _r("value"))


@_query("profile_child_tables", sql(body="select profile_id, prof.term_id, prof.term_id as name, (select count(*) from closure c where c.ancestor = prof.term_id) as n_below, (select min(c.term_id) from closure c where c.ancestor = prof.term_id) as first_below from (select distinct profile_id, term_id from prof) prof"))
def _(c: Catalog) -> DataFrame:
    return profiles.child_tables(c.orders, c.ontology.closure, c.ontology.term)


@_query("profile_level_lists", sql(body="select level, term_id, count(*) as times from prof join lev using (term_id) group by all"))
def _(c: Catalog) -> DataFrame:
    return profiles.level_lists(c.orders, c.ontology.level, distinct=False)


@_query("familiar_ancestors_ranked", sql(body="select c.term_id, ancestor as related, dist, (row_number() over (partition by c.term_id order by level desc, ancestor))::int as rank from closure c join lev on lev.term_id = ancestor"))
def _(c: Catalog) -> DataFrame:
    return graph.familiar(c.ontology.closure, c.ontology.term, up=True, level=c.ontology.level)


# strings and texts -------------------------------------------------------------------


@_query(
    "white_similarity_network",
    """with n as (select distinct p_name as t from part), g as (select t, [substr(t, i, 2) for i in range(1, length(t))] as g from n)
    select x.t as a, y.t as b, round(2.0 * len(list_distinct(list_intersect(x.g, y.g))) / (len(x.g) + len(y.g)), 6) as sim from g x join g y on x.t < y.t""",
)
def _(c: Catalog) -> DataFrame:
    # names are few whatever the number of parts; positions follow their order
    names = c.table("part").select(F.col("p_name").alias("text")).distinct()
    return strings.similarity_network(names.withColumn("pos", F.col("text"))).select("a", "b", _r("sim"))


@_query("ukkonen_similarity_network")
def _(c: Catalog) -> DataFrame:
    names = c.table("part").select(F.col("p_name").alias("text")).distinct()
    return strings.similarity_network(names.withColumn("pos", F.col("text")), "ukkonen_myers").select("a", "b", _r("sim"))


@_query(
    "clean_texts_hard",
    r"""with a as (select doc_id, regexp_replace(text, '([A-Za-z()]+ *)\n( *[A-Za-z()-]+)', '\1 \2', 'g') as t from documents),
    b as (select doc_id, replace(replace(replace(regexp_replace(t, '^\s+|\s+$', '', 'g'), chr(13), chr(10)), '&#13', chr(10)), chr(9), ' ') as t from a),
    c as (select doc_id, regexp_replace(regexp_replace(t, '\\[a-z]+(?:\[.+\])?\{(.+)\}', '\1', 'g'), ' +', ' ', 'g') as t from b),
    d as (select doc_id, replace(regexp_replace(regexp_replace(t, '([0-9]+)[.,]([0-9]+)', '\1''\2', 'g'), 'i\.?e\.?', 'ie', 'g'), 'al.', 'al ') as t from c)
    select doc_id, md5(t) as digest, length(t)::bigint as n from d""",
)
def _(c: Catalog) -> DataFrame:
    t = strings.clean_text(F.col("text"), "hard")
    return c.table("documents").select("doc_id", t.alias("t")).select("doc_id", F.md5(F.col("t").cast("binary")).alias("digest"), F.length("t").cast("long").alias("n"))


@_query("extract_years", r"select o_orderkey, cast(nullif(regexp_extract(strftime(o_orderdate, 'on %d %m %Y'), '.*(\d{4}).*', 1), '') as int) as year from orders")
def _(c: Catalog) -> DataFrame:
    return c.table("orders").select("o_orderkey", strings.extract_year(F.date_format("o_orderdate", "'on' dd MM yyyy")).alias("year"))


@_query(
    "blacklisted_pages",
    """select page_id, case when contains(lower(url), 'shop') or contains(lower(html), 'shop') then 'shop' when contains(lower(url), 'news') or contains(lower(html), 'news') then 'news' end as word,
    case when contains(lower(url), 'shop') then 'title' when contains(lower(html), 'shop') then 'article_category' when contains(lower(url), 'news') then 'title' when contains(lower(html), 'news') then 'article_category' end as field from pages""",
)
def _(c: Catalog) -> DataFrame:
    pages = c.table("pages").select("page_id", F.col("url").alias("title"), F.col("html").alias("article_category"))
    hit = textindex.blacklist_hit(["shop", " ", "news"])
    return pages.select("page_id", hit["word"].alias("word"), hit["field"].alias("field"))


@_query("document_sentences")
def _(c: Catalog) -> DataFrame:
    docs = c.table("documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    split = docs.withColumn("s", splitter.split_column(docs, F.col("text")))
    return splitter.sentences(split, "doc_id", F.col("s")).select("text_id", F.length("text").alias("n"))


@_query("corpus_index")
def _(c: Catalog) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = c.table("documents").select(F.col("doc_id").cast("string").alias("pmid"), none.alias("pmc"), F.lit(0).alias("year"), "text", F.col("source").alias("path"), none.alias("title"), none.alias("article_type"), none.alias("article_category"), none.alias("error"))
    return textindex.prepare(textindex.usable(rows), split=True).select("pmid", "text_length", "number_of_sentences", F.md5(F.col("text").cast("binary")).alias("digest"))


# embeddings --------------------------------------------------------------------------


@_query(
    "semantic_top_k",
    """with q as (select vec_id as i, embedding::double[] as v from embeddings where vec_id % 100 = 0), s as (select q.i as query_id, e.vec_id as corpus_id, list_cosine_similarity(q.v, e.embedding::double[]) as score from q, embeddings e),
    r as (select *, row_number() over (partition by query_id order by score desc, corpus_id::varchar) as k from s) select query_id::varchar as query_id, corpus_id::varchar as corpus_id, round(score, 6) as score from r where k <= 20""",
)
def _(c: Catalog) -> DataFrame:
    e = c.table("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "vec_id")
    # the stated query set: every row whose id is divisible by 100, against all rows
    return search.top_k(e.where("vec_id % 100 = 0"), e, 20).select("query_id", "corpus_id", _r("score"))


@_query(
    "semantic_best_match",
    """with q as (select vec_id as i, label, embedding::double[] as v from embeddings where vec_id % 100 = 0), s as (select q.label, q.i, e.vec_id, list_cosine_similarity(q.v, e.embedding::double[]) as score from q, embeddings e),
    r as (select *, row_number() over (partition by i order by score desc, vec_id::varchar) as k from s) select vec_id::varchar as text_id, label::varchar as kwd_id, round(max(score), 6) as score from r where k <= 20 group by 1, 2""",
)
def _(c: Catalog) -> DataFrame:
    e = c.table("embeddings").select(F.col("vec_id").cast("string").alias("id"), F.col("embedding").alias("vector"), "vec_id", "label")
    q = e.where("vec_id % 100 = 0")
    hits = search.top_k(q, e, 20).join(q.select(F.col("id").alias("query_id"), F.col("label").cast("string").alias("kwd_id")), "query_id")
    return search.best_matches(hits.withColumnRenamed("corpus_id", "text_id")).select("text_id", "kwd_id", _r("score"))


@_query("keyword_search_in_texts")
def _(c: Catalog) -> DataFrame:
    kw = c.table("benchmark").select(F.col("item_id").cast("string").alias("kwd_id"), "text")
    tx = c.table("documents").select(F.col("doc_id").cast("string").alias("text_id"), "text")
    return search.search(kw, tx, k=3)


# files -------------------------------------------------------------------------------


def _files(c: Catalog) -> Files:
    if not hasattr(c, "files"):
        c.files = Files(c)
    return c.files


def _file_query(make: Callable[[Files], DataFrame]) -> Callable[[Catalog], DataFrame]:
    return lambda c: make(_files(c))


for _name, (_make, _oracle) in FILES.items():
    _query(_name, _oracle)(_file_query(_make))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-match averages of all nations' profiles."""
    return QUERIES["profile_bma_lin"](spark, sf_dir)
