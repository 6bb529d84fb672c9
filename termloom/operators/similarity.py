"""Information content, most informative common ancestors and term similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

IC_TYPES = ("resnik", "resnik_observed", "seco", "zhou", "sanchez")
SIM_TYPES = ("resnik", "lin", "jiang_conrath", "eric", "neric", "nweric", "erlin")


def maxima(meta: DataFrame) -> DataFrame:
    """One row: number of terms, largest frequencies and deepest level."""
    observed = F.max("observed_freq") if "observed_freq" in meta.columns else F.lit(None).cast("double")
    return meta.agg(F.count("*").alias("n_terms"), F.max("struct_freq").alias("max_struct"), F.max("level").alias("max_depth"), observed.alias("max_observed"))


def _log_ratio(a: Column, b: Column) -> Column:
    """-log10(a / b), null where the ratio is not positive."""
    ratio = F.try_divide(a.cast("double"), b.cast("double"))
    return F.when(ratio > 0, -F.log10(ratio) + F.lit(0.0))


def ic_column(ic_type: str, zhou_k: float = 0.5, compat: bool = False) -> Column:
    """The IC of a term from its meta row joined with the maxima.

    Undefined values (an unobserved term, zhou of a leaf, sanchez of a root) are null.
    ``compat`` makes ``seco`` give zhou's value.
    """
    c = F.col
    log_terms = F.log10(F.greatest(c("n_terms"), F.lit(1)).cast("double"))
    seco = F.lit(1.0) - F.try_divide(F.log10("struct_freq"), log_terms)
    depth = F.when(c("n_desc") > 0, F.try_divide(F.log10(c("n_desc").cast("double")), F.log10(c("max_depth").cast("double"))))
    zhou = F.lit(zhou_k) * seco + F.lit(1 - zhou_k) * depth
    table = {
        "resnik": _log_ratio(c("struct_freq"), c("max_struct")),
        "seco": zhou if compat else seco,
        "zhou": zhou,
        "sanchez": _log_ratio(F.try_divide(c("n_desc").cast("double"), c("n_anc").cast("double")) + 1, c("max_depth") + 1),
    }
    if ic_type == "resnik_observed":
        return _log_ratio(c("observed_freq"), c("max_observed"))
    if ic_type not in table:
        raise ValueError(f"unknown IC type {ic_type}; known are {', '.join(IC_TYPES)}")
    return table[ic_type]


def ics(meta: DataFrame, ic_types=("resnik",), zhou_k: float = 0.5, compat: bool = False) -> DataFrame:
    """(term_id, ic_<type> ...) of every term of ``meta``."""
    joined = meta.crossJoin(F.broadcast(maxima(meta)))  # one row
    return joined.select("term_id", *(ic_column(t, zhou_k, compat).alias(f"ic_{t}") for t in ic_types))


def term_pairs(a: DataFrame, b: DataFrame | None = None) -> DataFrame:
    """(a, b) with a <= b: the distinct term pairs of profiles that are compared.

    ``a`` and ``b`` have (profile_id, term_id); without ``b`` the profiles of ``a`` are
    compared among themselves, so every pair of used terms occurs.
    """
    left = a.select(F.col("term_id").alias("x")).distinct()
    right = (a if b is None else b).select(F.col("term_id").alias("y")).distinct()
    return left.crossJoin(right).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def micas(pairs: DataFrame, reflexive_: DataFrame, ic: DataFrame, ic_col: str = "ic_resnik", terms: DataFrame | None = None) -> DataFrame:
    """(a, b, mica, mica_ic) for every pair with a common ancestor.

    Both closures are first restricted to the terms of the pairs (``terms``, if they are known); then each pair is joined
    with the ancestors of ``a`` and, on (b, ancestor), with those of ``b``.  Ties go to the
    largest id.
    """
    used = pairs.select(F.explode(F.array("a", "b")).alias("term_id")).distinct() if terms is None else terms
    up = reflexive_.select("term_id", "ancestor").join(used, "term_id", "left_semi").join(ic.select(F.col("term_id").alias("ancestor"), F.col(ic_col).alias("anc_ic")), "ancestor")
    up = up.where("anc_ic is not null")
    ua = up.select(F.col("term_id").alias("a"), "ancestor", "anc_ic")
    ub = up.select(F.col("term_id").alias("b"), "ancestor")
    return (
        pairs.join(ua, "a")
        .join(ub, ["b", "ancestor"])
        .groupBy("a", "b")
        .agg(F.max_by("ancestor", F.struct("anc_ic", "ancestor")).alias("mica"), F.max("anc_ic").alias("mica_ic"))
    )


def similarities(mica: DataFrame, ic: DataFrame, sim_type: str = "lin", ic_type: str = "resnik", max_struct: Column | float | None = None) -> DataFrame:
    """(a, b, mica, mica_ic, sim) for the pairs of ``micas``.

    The eric family always uses resnik ICs, whatever ``ic_type``.
    """
    if sim_type not in SIM_TYPES:
        raise ValueError(f"unknown similarity {sim_type}; known are {', '.join(SIM_TYPES)}")
    own = f"ic_{'resnik' if 'eric' in sim_type or sim_type == 'erlin' else ic_type}"
    both = mica.join(ic.select(F.col("term_id").alias("a"), F.col(own).alias("ica")), "a").join(ic.select(F.col("term_id").alias("b"), F.col(own).alias("icb")), "b")
    m, a, b = F.col("mica_ic"), F.col("ica"), F.col("icb")
    same = F.col("a") == F.col("b")
    lin = F.when(same, F.lit(1.0)).otherwise(F.try_divide(2 * m, a + b))
    low = F.least(a, b)
    eric = F.greatest(F.lit(0.0), 2 * m - low)
    top = F.lit(None).cast("double") if max_struct is None else (F.lit(float(max_struct)) if not isinstance(max_struct, Column) else max_struct)
    sim = {
        "resnik": m,
        "lin": lin,
        "jiang_conrath": a + b - 2 * m,
        "eric": eric,
        "neric": F.when(same | (low <= 0), F.lit(1.0)).otherwise(F.try_divide(eric, low)),
        "nweric": F.try_divide(eric, F.log10(top)),
        "erlin": F.when(same, F.lit(1.0)).when(eric > 0, lin).otherwise(F.lit(0.0)),
    }[sim_type]
    return both.select("a", "b", "mica", "mica_ic", sim.cast("double").alias("sim"))


def common_ancestors(pairs: DataFrame, closure_: DataFrame, reflexive_: DataFrame) -> DataFrame:
    """(a, b, ancestor): ancestors that both terms share; a term counts as its own when the
    two differ, and a term paired with itself has its strict ancestors."""
    other = pairs.where("a <> b")
    up = reflexive_.select("term_id", "ancestor")
    both = other.join(up.withColumnRenamed("term_id", "a"), "a").join(up.withColumnRenamed("term_id", "b"), ["b", "ancestor"])
    self_ = pairs.where("a = b").join(closure_.select(F.col("term_id").alias("a"), "ancestor"), "a")
    return both.select("a", "b", "ancestor").unionByName(self_.select("a", "b", "ancestor"))


def best_mica_to_profile(terms: DataFrame, profile: DataFrame, reflexive_: DataFrame, ic: DataFrame, ic_col: str = "ic_resnik") -> DataFrame:
    """(term_id, mica, mica_ic): each term's most informative ancestor shared with any term
    of the profile."""
    pairs = terms.select(F.col("term_id").alias("a")).distinct().crossJoin(profile.select(F.col("term_id").alias("b")).distinct())
    used = terms.select("term_id").unionByName(profile.select("term_id")).distinct()
    return micas(pairs, reflexive_, ic, ic_col, used).groupBy(F.col("a").alias("term_id")).agg(F.max_by("mica", F.struct("mica_ic", "mica")).alias("mica"), F.max("mica_ic").alias("mica_ic"))


def profile_common_ancestors(profile: DataFrame, closure_: DataFrame, cutoff: float = 1.0) -> DataFrame:
    """(profile_id, ancestor, share): strict ancestors of at least ``cutoff`` of a profile's terms."""
    n = profile.groupBy("profile_id").agg(F.count("*").alias("n"))
    hits = profile.join(closure_, "term_id").groupBy("profile_id", "ancestor").agg(F.count("*").alias("c"))
    return hits.join(n, "profile_id").withColumn("share", F.col("c") / F.col("n")).where(F.col("share") >= cutoff).select("profile_id", "ancestor", "share")


def profile_mica(profile: DataFrame, closure_: DataFrame, ic: DataFrame, ic_col: str = "ic_resnik", cutoff: float = 1.0) -> DataFrame:
    """(profile_id, mica, mica_ic): the most informative of the profile's common ancestors."""
    shared = profile_common_ancestors(profile, closure_, cutoff).join(ic.select(F.col("term_id").alias("ancestor"), F.col(ic_col).alias("v")), "ancestor")
    return shared.where("v is not null").groupBy("profile_id").agg(F.max_by("ancestor", F.struct("v", "ancestor")).alias("mica"), F.max("v").alias("mica_ic"))
