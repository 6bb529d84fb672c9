"""Profiles: ingestion, cleaning, expansion, frequencies and statistics.

A profile table has (profile_id, pos, term_id); pos keeps the order of the list and makes
repeated terms distinct rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.storage import stored


def main_ids(ids: DataFrame, term: DataFrame, alt: DataFrame, column: str = "term_id") -> DataFrame:
    """``ids`` with main_id: the id itself if it is a term, else its main id, else null."""
    known = term.select(F.col("term_id").alias(column), F.lit(True).alias("_is"))
    other = alt.select(F.col("alt_id").alias(column), F.col("main_id").alias("_main")).dropDuplicates([column])
    # terms and alternatives grow with the ontology and pack well: their files look smaller than a broadcast is
    joined = ids.join(known.hint("merge"), column, "left").join(other.hint("merge"), column, "left")
    return joined.withColumn("main_id", F.when(F.col("_is"), F.col(column)).otherwise(F.col("_main"))).drop("_is", "_main")


def check_ids(profile: DataFrame, term: DataFrame, alt: DataFrame, substitute: bool = True) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) rows of a profile table; accepted ids are replaced by their main
    ids if ``substitute``."""
    named = main_ids(profile, term, alt)
    good = named.where("main_id is not null")
    return good.select("profile_id", "pos", F.col("main_id" if substitute else "term_id").alias("term_id")), named.where("main_id is null").select("profile_id", "pos", "term_id")


def _first_only(profile: DataFrame) -> DataFrame:
    return profile.groupBy("profile_id", "term_id").agg(F.min("pos").alias("pos")).select("profile_id", "pos", "term_id")


def _with_listed_ancestors(profile: DataFrame, closure_: DataFrame) -> DataFrame:
    """``profile`` with above: those ancestors of the term that some profile lists, null without one."""
    inner = closure_.select(F.col("ancestor").alias("term_id")).distinct()
    listed = stored(profile.select("term_id").distinct().join(inner, "term_id", "left_semi"))
    up = closure_.join(listed.withColumnRenamed("term_id", "ancestor"), "ancestor", "left_semi").groupBy("term_id").agg(F.collect_list("ancestor").alias("above"))
    return profile.join(up, "term_id", "left")


def _marked(profile: DataFrame, closure_: DataFrame) -> DataFrame:
    """(profile_id, term_id, pos, redundant): the rows of a profile table, each with whether its
    term is a strict ancestor of another of the profile."""
    rows = _with_listed_ancestors(profile.select("profile_id", "pos", "term_id"), closure_)
    own = F.struct("term_id", "pos", F.lit(False).alias("up"))
    kin = F.transform(F.array_distinct("above"), lambda x: F.struct(x.alias("term_id"), F.lit(None).cast(profile.schema["pos"].dataType).alias("pos"), F.lit(True).alias("up")))
    rows = rows.select("profile_id", F.explode(F.when(F.col("above").isNull(), F.array(own)).otherwise(F.concat(F.array(own), kin))).alias("r")).select("profile_id", "r.*")
    return rows.withColumn("redundant", F.max("up").over(Window.partitionBy("profile_id", "term_id"))).where(~F.col("up")).drop("up")


def redundant(profile: DataFrame, closure_: DataFrame) -> DataFrame:
    """(profile_id, term_id): terms that are strict ancestors of another of their profile."""
    return _marked(profile.withColumn("pos", F.lit(0)), closure_).where("redundant").select("profile_id", "term_id").distinct()


def drop_ancestors(profile: DataFrame, closure_: DataFrame) -> DataFrame:
    return _marked(profile, closure_).where(~F.col("redundant")).select("profile_id", "pos", "term_id")


def drop_alternatives(profile: DataFrame, alt: DataFrame) -> DataFrame:
    """Without the alternative ids whose main id the profile holds too."""
    main = profile.select("profile_id", F.col("term_id").alias("main_id")).distinct()
    doubled = alt.join(main, "main_id").select("profile_id", F.col("alt_id").alias("term_id"))
    return profile.join(doubled, ["profile_id", "term_id"], "left_anti").select("profile_id", "pos", "term_id")


def clean(profile: DataFrame, closure_: DataFrame, alt: DataFrame | None = None) -> DataFrame:
    """Without redundant ancestors and, given ``alt``, doubled alternatives."""
    out = drop_ancestors(profile, closure_)
    return out if alt is None else drop_alternatives(out, alt)


def clean_hard(profile: DataFrame, term: DataFrame, alt: DataFrame, closure_: DataFrame, term_filter: str | None = None) -> DataFrame:
    """Main ids, optionally only below ``term_filter``, each once, without redundant
    ancestors.  Profiles left empty vanish."""
    good, _ = check_ids(profile, term, alt)
    if term_filter is not None:
        good = good.join(closure_.where(F.col("ancestor") == term_filter).select("term_id"), "term_id", "left_semi")
    return drop_ancestors(stored(_first_only(good.select("profile_id", "pos", "term_id"))), closure_)


def clean_by_score(profile: DataFrame, scores: DataFrame, closure_: DataFrame, by_max: bool = True, remove_without_score: bool = True) -> DataFrame:
    """(profile_id, term_id): of each term and its scored kin in the profile the best scored
    (worst if not ``by_max``); ties go to the larger id for the best, the smaller for the worst."""
    held = profile.select("profile_id", "term_id").distinct()
    scored = stored(held.join(scores.select("term_id", "score"), "term_id"))
    # upwards only: a term has few ancestors, but as many descendants as the ontology is large
    above = closure_.select("term_id", F.col("ancestor").alias("kin")).join(scored.select(F.col("term_id").alias("kin")).distinct(), "kin", "left_semi")
    up = scored.select("profile_id", "term_id", F.col("score").alias("own")).join(above, "term_id").join(scored.select("profile_id", F.col("term_id").alias("kin"), "score"), ["profile_id", "kin"])
    both = F.array(F.struct("term_id", "kin", "score"), F.struct(F.col("kin").alias("term_id"), F.col("term_id").alias("kin"), F.col("own").alias("score")))
    family = up.select("profile_id", F.explode(both).alias("f")).select("profile_id", "f.*").unionByName(scored.select("profile_id", "term_id", F.col("term_id").alias("kin"), "score"))
    order = F.struct("score", "kin")
    best = family.groupBy("profile_id", "term_id").agg((F.max_by if by_max else F.min_by)("kin", order).alias("keep"))
    kept = best.select("profile_id", F.col("keep").alias("term_id")).distinct()
    if not remove_without_score:
        kept = kept.unionByName(held.join(scores.select("term_id"), "term_id", "left_anti").select("profile_id", "term_id")).distinct()
    return kept


def _above(profile: DataFrame, closure_: DataFrame) -> DataFrame:
    """(profile_id, term_id, above): rows with the strict ancestors of their term, a profile's rows in one place.

    Ancestors travel as an array: only where a profile's rows have met are they listed.
    """
    n = 4 * int(profile.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a fixed number: merged by their bytes here, partitions are too large once listed
    up = closure_.groupBy("term_id").agg(F.collect_list("ancestor").alias("above"))
    rows = profile.select("profile_id", "term_id").join(up, "term_id", "left")
    return rows.select("profile_id", "term_id", F.coalesce("above", F.array().cast("array<string>")).alias("above")).repartition(n, "profile_id")


def expand_with_parents(profile: DataFrame, closure_: DataFrame, unwanted: list[str] | None = None) -> DataFrame:
    """(profile_id, term_id): the terms and all their strict ancestors, less the unwanted."""
    out = _above(profile, closure_).select("profile_id", F.explode(F.concat(F.array("term_id"), "above")).alias("term_id")).distinct()
    return out.where(~F.col("term_id").isin(*unwanted)) if unwanted else out


def filter_terms(terms: DataFrame, closure_: DataFrame, white: list[str] | None = None, black: list[str] | None = None) -> DataFrame:
    """Terms with a whitelisted strict ancestor, if there is a whitelist, and no blacklisted one."""
    up = closure_.select("term_id", "ancestor")
    if white:
        terms = terms.join(up.where(F.col("ancestor").isin(*white)).select("term_id"), "term_id", "left_semi")
    if black:
        terms = terms.join(up.where(F.col("ancestor").isin(*black)).select("term_id"), "term_id", "left_anti")
    return terms


def observed_frequencies(profile: DataFrame, reflexive_: DataFrame, increase: float = 1.0) -> DataFrame:
    """(term_id, observed_freq): occurrences of each term and of all below it."""
    n = profile.groupBy("term_id").agg(F.count("*").alias("n"))
    return n.join(reflexive_, "term_id").groupBy(F.col("ancestor").alias("term_id")).agg((F.sum("n") * F.lit(increase)).cast("double").alias("observed_freq"))


def term_frequencies(profile: DataFrame, closure_: DataFrame | None = None, ratio: bool = True, min_freq: float = 0.0, distinct: bool = False) -> DataFrame:
    """(term_id, freq): occurrences, over the number of profiles if ``ratio``.

    With ``closure_`` a profile also counts once for every strict ancestor of its terms; an
    ancestor that it lists itself then counts twice, unless ``distinct``.
    """
    count = lambda rows: rows.groupBy("term_id").agg(F.count("*").cast("double").alias("freq"))
    own = profile.select("profile_id", "term_id")
    if distinct:
        freq = count(own.distinct() if closure_ is None else expand_with_parents(profile, closure_))
    else:
        freq = count(own)
        if closure_ is not None:
            up = _above(profile, closure_).select("profile_id", F.explode("above").alias("term_id")).distinct()
            freq = freq.unionByName(count(up)).groupBy("term_id").agg(F.sum("freq").alias("freq"))
    if not ratio:
        return freq
    n = profile.agg(F.count_distinct("profile_id").alias("n"))
    out = freq.crossJoin(F.broadcast(n)).select("term_id", (F.col("freq") / F.col("n")).alias("freq"))
    return out.where(F.col("freq") >= min_freq)


def general_profile(profile: DataFrame, term: DataFrame, alt: DataFrame, closure_: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(term_id): terms of at least that share of the profiles, hard-cleaned as one profile."""
    often = term_frequencies(profile).where(F.col("freq") >= threshold)
    one = often.select(F.lit("general").alias("profile_id"), F.lit(0).alias("pos"), "term_id")
    return clean_hard(one, term, alt, closure_).select("term_id")


def sizes(profile: DataFrame) -> DataFrame:
    return profile.groupBy("profile_id").agg(F.count("*").alias("size"))


def size_stats(profile: DataFrame) -> DataFrame:
    """One row of statistics of the profile sizes, zero sizes left out in the _nz ones."""
    x = F.col("size").cast("double")
    nz = F.when(F.col("size") != 0, x)
    out = []
    for c, suffix in ((x, ""), (nz, "_nz")):
        q = F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        out += [F.count(c).alias(f"elements{suffix}"), F.sum(c).alias(f"sum{suffix}"), F.max(c).alias(f"max{suffix}"), F.min(c).alias(f"min{suffix}"), F.avg(c).alias(f"average{suffix}")]
        out += [F.var_pop(c).alias(f"variance{suffix}"), F.stddev_pop(c).alias(f"deviation{suffix}"), q[0].alias(f"q1{suffix}"), q[1].alias(f"median{suffix}"), q[2].alias(f"q3{suffix}")]
    return sizes(profile).agg(*out)


def mean_size(profile: DataFrame, digits: int = 4) -> DataFrame:
    return sizes(profile).agg(F.round(F.avg("size"), digits).alias("mean_size"))


def size_at_percentile(profile: DataFrame, percent: float = 50, increasing: bool = False) -> DataFrame:
    """One row: the linearly interpolated size at the percentile, counted from the largest
    size down unless ``increasing``."""
    p = percent if increasing else 100 - percent
    return sizes(profile).agg(F.percentile("size", F.lit(p / 100)).alias("size"))


def redundancy(profile: DataFrame, closure_: DataFrame) -> DataFrame:
    """(profile_id, size, redundant): terms, and those made redundant by a descendant."""
    rows = _marked(profile.select("profile_id", F.lit(0).alias("pos"), "term_id"), closure_)
    return rows.groupBy("profile_id").agg(F.count("*").alias("size"), F.count_if("redundant").alias("redundant"))


def child_share(profile: DataFrame, meta: DataFrame) -> DataFrame:
    """One row: the share of listed terms that have descendants."""
    return profile.join(meta.select("term_id", "n_desc"), "term_id").agg(F.avg((F.col("n_desc") > 0).cast("double")).alias("share"))


def child_tables(profile: DataFrame, closure_: DataFrame, names: DataFrame) -> DataFrame:
    """(profile_id, term_id, name, n_below, first_below): each listed term with its name, the
    number of its descendants and the least of them, null without one."""
    below = closure_.groupBy(F.col("ancestor").alias("term_id")).agg(F.count("*").alias("n_below"), F.min("term_id").alias("first_below"))
    rows = profile.select("profile_id", "term_id").distinct().join(names.select("term_id", "name"), "term_id").join(below, "term_id", "left")
    return rows.select("profile_id", "term_id", "name", F.coalesce("n_below", F.lit(0).cast("long")).alias("n_below"), "first_below")


def level_lists(profile: DataFrame, level: DataFrame, distinct: bool = True) -> DataFrame:
    """(level, term_id, times): the terms of all profiles by level, once or as often as listed."""
    rows = profile.join(level, "term_id").where("level is not null").groupBy("level", "term_id").agg(F.count("*").alias("times"))
    return rows.withColumn("times", F.lit(1).cast("long")) if distinct else rows


def mean_ics(profile: DataFrame, ic: DataFrame, columns: list[str]) -> DataFrame:
    """(profile_id, <column> ...): mean ICs of the terms."""
    return profile.join(ic, "term_id").groupBy("profile_id").agg(*(F.avg(c).alias(c) for c in columns))


def level_distribution(profile: DataFrame, level: DataFrame) -> DataFrame:
    """(level, n_ontology, n_cohort, n_unique, pct_ontology, pct_weighted, pct_unique).

    A row for each level of the ontology; percentages have three digits.
    """
    onto = level.where("level is not null").groupBy("level").agg(F.count("*").alias("n_ontology"))
    held = profile.join(level, "term_id").groupBy("level").agg(F.count("*").alias("n_cohort"), F.count_distinct("term_id").alias("n_unique"))
    rows = onto.join(held, "level", "left").fillna(0, ["n_cohort", "n_unique"])
    totals = rows.agg(*(F.sum(c).alias(f"t_{c}") for c in ("n_ontology", "n_cohort", "n_unique")))
    pct = lambda c: F.round(F.try_divide(F.col(c), F.col(f"t_{c}")) * 100, 3)
    return rows.crossJoin(F.broadcast(totals)).select(
        "level", "n_ontology", "n_cohort", "n_unique", pct("n_ontology").alias("pct_ontology"), pct("n_cohort").alias("pct_weighted"), pct("n_unique").alias("pct_unique")
    )


def specificity_index(distribution: DataFrame, mode: str = "weighted") -> DataFrame:
    """One row (dsi): how far the profiles' terms lie below the ontology's widest level.

    Only levels whose observed share exceeds the ontology's count, by the excess times a
    distance weight.  0 without such a level below the widest; null without one above.
    """
    seen = F.col("pct_unique" if mode == "uniq" else "pct_weighted")
    widest = distribution.agg(F.max_by("level", F.struct("pct_ontology", "level")).alias("top"), F.count("*").alias("n"))
    rows = distribution.crossJoin(F.broadcast(widest)).withColumn("d", seen - F.col("pct_ontology")).where("d > 0")
    gap = F.col("top") - F.col("level")
    weight = F.when(gap >= 0, gap + 1).otherwise(-gap)
    part = rows.agg(
        F.sum(F.when(gap < 0, F.col("d") * weight / (F.col("n") - F.col("top")))).alias("hss"),
        F.sum(F.when(gap >= 0, F.col("d") * weight / F.col("top"))).alias("lss"),
    )
    return part.select(F.when(F.col("hss").isNull(), F.lit(0.0)).otherwise(F.try_divide("hss", "lss")).alias("dsi"))


def translated(profile: DataFrame, names: DataFrame) -> DataFrame:
    """(profile_id, names): the terms' names in order, ids without a name left out."""
    named = profile.join(names.select("term_id", "name"), "term_id").where("name is not null")
    return named.groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("names"))


def as_arrays(profile: DataFrame) -> DataFrame:
    """(profile_id, terms): a row for each profile."""
    return profile.groupBy("profile_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "term_id"))), lambda x: x["term_id"]).alias("terms"))


def from_arrays(rows: DataFrame, id_col: str, terms: Column) -> DataFrame:
    """A profile table of rows with an id and an array of terms."""
    return rows.select(F.col(id_col).cast("string").alias("profile_id"), F.posexplode(terms).alias("pos", "term_id"))


def from_pairs(rows: DataFrame, id_col: str, term_col: str, order: str) -> DataFrame:
    """A profile table of (id, term) rows; repeated pairs stay."""
    pos = F.row_number().over(Window.partitionBy(id_col).orderBy(order)) - 1
    return rows.select(F.col(id_col).cast("string").alias("profile_id"), pos.cast("int").alias("pos"), F.col(term_col).alias("term_id"))


def items_of(profile: DataFrame) -> DataFrame:
    """(term_id, item_id): which profiles hold which term."""
    return profile.select("term_id", F.col("profile_id").alias("item_id")).distinct()


def profiles_of(item: DataFrame) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("item_id").orderBy("term_id")) - 1
    return item.select(F.col("item_id").alias("profile_id"), pos.cast("int").alias("pos"), "term_id")


def merge_items(old: DataFrame, new: DataFrame, replace: bool = False, expand: bool = False) -> DataFrame:
    """Items with those of ``new``: only these if ``replace``; joined key by key if
    ``expand``, else new keys win over old ones."""
    if replace:
        return new.distinct()
    if not expand:
        old = old.join(new.select("term_id"), "term_id", "left_anti")
    return old.unionByName(new).distinct()
