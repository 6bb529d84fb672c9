"""Similarity between profiles: best-match averages, rankings and term matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.shipping import ship


def mirrored(term_sim: DataFrame) -> DataFrame:
    """Both directions of a table with a <= b."""
    one = term_sim.select("a", "b", "sim")
    return one.unionByName(one.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def _directed(left: DataFrame, right: DataFrame, sims: DataFrame) -> DataFrame:
    """(pa, pb, total, n): the sum over the terms of pa of the best similarity in pb.

    Best similarities are found once for each distinct term and right profile, not for each
    pair of profiles, and only then spread over the left profiles that hold the term.
    """
    best = (
        right.select(F.col("profile_id").alias("pb"), F.col("term_id").alias("b"))
        .distinct()
        .join(sims, "b")
        .groupBy("a", "pb")
        .agg(F.max("sim").alias("best"))
    )
    n = left.groupBy(F.col("profile_id").alias("pa")).agg(F.count("*").alias("n"))
    sums = (
        left.select(F.col("profile_id").alias("pa"), F.col("term_id").alias("a"))
        .groupBy("pa", "a")
        .agg(F.count("*").alias("times"))
        .join(best, "a")
        .groupBy("pa", "pb")
        .agg(F.sum(F.col("best") * F.col("times")).alias("total"))
    )
    return sums.join(n, "pa")


def compare_profiles(profile: DataFrame, term_sim: DataFrame, external: DataFrame | None = None, bidirectional: bool = True) -> DataFrame:
    """(a, b, sim): best-match averages of all profiles with all of ``external``.

    Without ``external`` the profiles are compared among themselves, themselves included.
    Terms listed twice count twice; a term without a comparable partner counts 0, and
    profiles without any comparable term have similarity 0.  One-way values are those of
    ``a`` towards ``b``.
    """
    other = profile if external is None else external
    sims = mirrored(term_sim.where("sim is not null"))
    ids = profile.select(F.col("profile_id").alias("a")).distinct().crossJoin(other.select(F.col("profile_id").alias("b")).distinct())
    there = _directed(profile, other, sims).select(F.col("pa").alias("a"), F.col("pb").alias("b"), F.col("total").alias("t1"))
    out = ids.join(there, ["a", "b"], "left")
    size = lambda df, name, n: df.groupBy(F.col("profile_id").alias(name)).agg(F.count("*").alias(n))
    out = out.join(size(profile, "a", "n1"), "a")
    if not bidirectional:
        return out.select("a", "b", (F.coalesce("t1", F.lit(0.0)) / F.col("n1")).alias("sim"))
    back = _directed(other, profile, sims).select(F.col("pa").alias("b"), F.col("pb").alias("a"), F.col("total").alias("t2"))
    out = out.join(back, ["a", "b"], "left").join(size(other, "b", "n2"), "b")
    return out.select("a", "b", ((F.coalesce("t1", F.lit(0.0)) + F.coalesce("t2", F.lit(0.0))) / (F.col("n1") + F.col("n2"))).alias("sim"))


def self_similarities(profile: DataFrame, term_sim: DataFrame) -> DataFrame:
    """(profile_id, sim): mean similarity of the term pairs of a profile; pairs without one
    are left out, and a profile without pairs has 1."""
    x = profile.select("profile_id", F.col("pos").alias("i"), F.col("term_id").alias("ta"))
    y = profile.select("profile_id", F.col("pos").alias("j"), F.col("term_id").alias("tb"))
    pairs = x.join(y, "profile_id").where("i < j").select("profile_id", F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b"))
    mean = pairs.join(term_sim, ["a", "b"]).groupBy("profile_id").agg(F.avg("sim").alias("m"))
    return profile.select("profile_id").distinct().join(mean, "profile_id", "left").select("profile_id", F.coalesce("m", F.lit(1.0)).alias("sim"))


def above(profile_sim: DataFrame, threshold: float) -> DataFrame:
    """The pairs of two different profiles whose similarity passes the threshold."""
    return profile_sim.where((F.col("a") != F.col("b")) & (F.col("sim") >= threshold))


def rank_candidates(profile_sim: DataFrame, reference: str, limit: int | None = None, scores: DataFrame | None = None) -> DataFrame:
    """(candidate, sim, rank): candidates by similarity to ``reference``.

    With ``scores(candidate, score)`` the best-scored ``limit`` candidates are chosen first
    and then ranked by similarity; candidates without a score are left out.
    """
    rows = profile_sim.where(F.col("a") == reference).select(F.col("b").alias("candidate"), "sim")
    if scores is not None:
        rows = rows.join(scores, "candidate")
        if limit:
            rows = rows.orderBy(F.desc("score"), F.desc("sim"), "candidate").limit(limit)
    ordered = rows.orderBy(F.desc("sim"), "candidate")
    if limit:
        ordered = ordered.limit(limit)
        # at most ``limit`` rows: a report's size
        return ordered.select("candidate", "sim", F.row_number().over(Window.orderBy(F.desc("sim"), "candidate")).alias("rank"))
    # every candidate: ranks come from counts below, not from a sort in one task
    steps = rows.groupBy("sim").agg(F.count("*").alias("n"))
    better = steps.alias("x").join(steps.alias("y"), F.col("y.sim") > F.col("x.sim"), "left").groupBy(F.col("x.sim").alias("sim")).agg(F.coalesce(F.sum("y.n"), F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("sim").orderBy("candidate"))
    return rows.join(better, "sim").select("candidate", "sim", (F.col("before") + within).cast("int").alias("rank"))


def term_matches(reference: DataFrame, candidates: DataFrame, lin: DataFrame) -> DataFrame:
    """(candidate, ref_term, cand_term, sim): greedy one-to-one matching by lin.

    Of each candidate's pairs, best first, those are taken whose two ends are still free.
    A candidate's pairs are sorted once and each is looked at once.
    """
    sims = mirrored(lin)
    pairs = (
        reference.select(F.col("pos").cast("int").alias("ref_pos"), F.col("term_id").alias("a"))
        .crossJoin(candidates.select(F.col("profile_id").alias("candidate"), F.col("pos").cast("int").alias("cand_pos"), F.col("term_id").alias("b")))
        .join(sims, ["a", "b"], "left")
        .select("candidate", (-F.coalesce("sim", F.lit(0.0))).alias("key"), "ref_pos", "cand_pos", F.col("a").alias("ref_term"), F.col("b").alias("cand_term"))
    )
    ship(reference.sparkSession)
    return pairs.groupBy("candidate").applyInArrow(_greedy, "candidate string, ref_term string, cand_term string, sim double")


def _codes(column: pa.ChunkedArray) -> tuple[list[str], np.ndarray]:
    """The distinct terms in order and the place of each row's term; no object for each row."""
    d = pa.chunked_array([column.combine_chunks()]).dictionary_encode().chunk(0)
    names, order = np.unique(np.array(d.dictionary.to_pylist(), object), return_inverse=True)
    return names.tolist(), order[d.indices.to_numpy()]


def _greedy(pairs: pa.Table) -> pa.Table:
    """The matches of one candidate."""
    # codes in the order of the terms, so that they sort as the terms do
    names, codes = zip(*(_codes(pairs.column(k)) for k in ("ref_term", "cand_term")))
    key, i, j = (pairs.column(k).to_numpy() for k in ("key", "ref_pos", "cand_pos"))
    order = np.lexsort((codes[1], codes[0], j, i, key))
    free = [[True] * len(x) for x in names]
    taken, most = [], min(map(len, names))
    for k, x, y in zip(order.tolist(), codes[0][order].tolist(), codes[1][order].tolist()):
        if free[0][x] and free[1][y]:
            free[0][x] = free[1][y] = False
            taken.append(k)
            if len(taken) == most:
                break
    out = pairs.take(pa.array(taken, pa.int64()))
    sim = pa.array(0.0 - out.column("key").to_numpy(), pa.float64())
    return pa.table([out.column("candidate"), out.column("ref_term"), out.column("cand_term"), sim], ["candidate", "ref_term", "cand_term", "sim"])


def term_matrix(matches: DataFrame, ranked: DataFrame, term_limit: int = 100) -> DataFrame:
    """(ref_term, total, candidates): rows of the matrix of reference terms by candidates,
    the ``term_limit`` rows with the largest sums; candidates in the order of ``ranked``."""
    cells = matches.join(ranked.select("candidate", "rank"), "candidate")
    rows = cells.groupBy("ref_term").agg(F.sum("sim").alias("total"), F.array_sort(F.collect_list(F.struct("rank", "candidate", "sim"))).alias("candidates"))
    return rows.orderBy(F.desc("total"), "ref_term").limit(term_limit)


def candidate_term_sims(reference: DataFrame, candidates: DataFrame, lin: DataFrame) -> DataFrame:
    """(candidate, term_id, best): each candidate term's best lin to the reference, 0 if none."""
    best = mirrored(lin).join(reference.select(F.col("term_id").alias("b")).distinct(), "b", "left_semi").groupBy(F.col("a").alias("term_id")).agg(F.max("sim").alias("best"))
    cand = candidates.select(F.col("profile_id").alias("candidate"), "term_id").distinct()
    return cand.join(best, "term_id", "left").select("candidate", "term_id", F.coalesce("best", F.lit(0.0)).alias("best"))


def negative_terms(term_sims: DataFrame, sim_filter: float = 0.2, term_limit: int = 100) -> DataFrame:
    """(term_id, count): terms that so many candidates hold without a like in the reference,
    the most frequent first, ties by the larger id."""
    low = term_sims.where(F.col("best") <= sim_filter)
    return low.groupBy("term_id").agg(F.count("*").alias("count")).orderBy(F.desc("count"), F.desc("term_id")).limit(term_limit)


def negative_matrix(term_sims: DataFrame, negative: DataFrame) -> DataFrame:
    """(term_id, candidate, count): cells of the matrix, the term's count where the
    candidate holds the term."""
    return negative.join(term_sims.select("candidate", "term_id"), "term_id").select("term_id", "candidate", "count")
