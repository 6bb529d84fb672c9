"""Closure, levels, paths and structure of the is_a graph."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.storage import stored


#: Rounds of a loop after which what it has found is written anew as one table.
REWRITE = 16


def closure(edge: DataFrame, term: DataFrame | None = None) -> DataFrame:
    """(term_id, ancestor, dist): all strict ancestors with their least distance.

    A semi-naive loop: each round joins only the pairs found last with the edges and keeps
    what is new, so rounds equal the depth and cycles end at the fixpoint.  Ancestors that
    are no terms are left out if ``term`` is given.
    """
    e = stored(edge.select(F.col("child").alias("c"), F.col("parent").alias("p")).where("c is not null and p is not null").distinct())
    found = delta = e.select(F.col("c").alias("term_id"), F.col("p").alias("ancestor"), F.lit(1).alias("dist"))
    # only edges that leave a parent lead on: leaves, mostly the bulk, are no one's ancestor
    e = stored(e.join(e.select(F.col("p").alias("c")).distinct(), "c", "left_semi"))
    for hop in count(2):  # ends: each round finds new pairs, of which there are finitely many
        near = delta.join(e, F.col("ancestor") == F.col("c")).select("term_id", F.col("p").alias("ancestor")).distinct()
        delta = stored(near.join(found, ["term_id", "ancestor"], "left_anti").withColumn("dist", F.lit(hop)))
        if delta.isEmpty():
            break
        found = found.unionByName(delta)
        if hop % REWRITE == 0:  # else the plan grows by a table a hop
            found = stored(found)
    # a cycle reaches its own members: they are no ancestors of themselves
    found = found.where("term_id <> ancestor")
    if term is not None:
        found = found.join(term.select(F.col("term_id").alias("ancestor")), "ancestor", "left_semi").select("term_id", "ancestor", "dist")
    return found


def reflexive(closure_: DataFrame, term: DataFrame) -> DataFrame:
    """The closure with every term as its own ancestor at distance 0."""
    return closure_.select("term_id", "ancestor", "dist").unionByName(term.select("term_id", F.col("term_id").alias("ancestor"), F.lit(0).alias("dist")))


def roots(term: DataFrame, closure_: DataFrame) -> DataFrame:
    return term.join(closure_.select("term_id"), "term_id", "left_anti")


def leaves(term: DataFrame, closure_: DataFrame) -> DataFrame:
    return term.join(closure_.select(F.col("ancestor").alias("term_id")), "term_id", "left_anti")


def structure_type(term: DataFrame, edge: DataFrame, closure_: DataFrame) -> DataFrame:
    """One row (structure): atomic, sparse, circular or hierarchical."""
    with_parents = edge.join(term, edge.child == term.term_id, "left_semi").select("child").distinct()
    up = closure_.select(F.col("term_id").alias("x"), F.col("ancestor").alias("y"))
    back = closure_.select(F.col("term_id").alias("y"), F.col("ancestor").alias("x"))
    counts = (
        term.agg(F.count("*").alias("n"))
        .join(with_parents.agg(F.count("*").alias("p")))
        .join(up.join(back, ["x", "y"], "left_semi").agg(F.count("*").alias("loops")))
    )
    kind = F.when(F.col("p") == 0, "atomic").when(F.col("n") - F.col("p") >= 2, "sparse").when(F.col("loops") > 0, "circular").otherwise("hierarchical")
    return counts.select(kind.alias("structure"))


def frequencies(term: DataFrame, closure_: DataFrame) -> DataFrame:
    """(term_id, n_anc, n_desc, struct_freq) of every term; struct_freq = n_desc + 1."""
    up = closure_.groupBy("term_id").agg(F.count("*").alias("n_anc"))
    down = closure_.groupBy(F.col("ancestor").alias("term_id")).agg(F.count("*").alias("n_desc"))
    zero = F.lit(0).cast("long")
    both = term.select("term_id").join(up, "term_id", "left").join(down, "term_id", "left")
    both = both.select("term_id", F.coalesce("n_anc", zero).alias("n_anc"), F.coalesce("n_desc", zero).alias("n_desc"))
    return both.withColumn("struct_freq", (F.col("n_desc") + 1).cast("double"))


def levels(term: DataFrame, edge: DataFrame, closure_: DataFrame, shortest: bool = True) -> DataFrame:
    """(term_id, level): nodes on the shortest or longest path from a root; a root has 1.

    Shortest levels come from the closure's distances.  Longest ones relax level by level
    from the roots and need as many rounds as the graph is deep.  Terms on or below a cycle
    without a root have a null level.
    """
    top = roots(term.select("term_id"), closure_)
    if shortest:
        far = closure_.join(top.select(F.col("term_id").alias("ancestor")), "ancestor", "left_semi")
        far = far.groupBy("term_id").agg((F.min("dist") + 1).alias("level"))
        found = far.unionByName(top.withColumn("level", F.lit(1)))
    else:
        e = stored(edge.select("child", "parent").distinct())
        n = term.count()
        front = found = stored(top.withColumn("level", F.lit(1)))
        for depth in range(2, n + 2):  # deeper than there are terms: the rest lies on or below a cycle
            front = stored(front.join(e, F.col("term_id") == F.col("parent")).select(F.col("child").alias("term_id")).distinct().withColumn("level", F.lit(depth)))
            if front.isEmpty():
                break
            found = found.unionByName(front)
            if depth % REWRITE == 0:
                found = stored(found)
        found = found.groupBy("term_id").agg(F.max("level").alias("level")).where(F.col("level") <= n)
    return term.select("term_id").join(found, "term_id", "left").select("term_id", F.col("level").cast("int").alias("level"))


def paths(term: DataFrame, edge: DataFrame, closure_: DataFrame) -> DataFrame:
    """(term_id, path): every path from a term up to a root, the term first."""
    e = stored(edge.select("child", "parent").distinct())
    front = found = stored(roots(term.select("term_id"), closure_).withColumn("path", F.array("term_id")))
    for _ in range(1_000):
        step = front.join(e, F.col("term_id") == F.col("parent")).where(~F.array_contains("path", F.col("child")))
        front = stored(step.select(F.col("child").alias("term_id"), F.concat(F.array("child"), "path").alias("path")))
        if front.isEmpty():
            return found
        found = found.unionByName(front)
    raise RuntimeError("the graph is too deep for its paths to be listed")


def path_stats(term: DataFrame, edge: DataFrame, closure_: DataFrame) -> DataFrame:
    """(term_id, total_paths, largest_path, shortest_path), lengths in nodes.

    Paths are counted by length, level by level from the roots, and never listed: rows are
    terms by lengths however many paths there are.  A cycle below a root raises.
    """
    top = roots(term.select("term_id"), closure_)
    loops = closure_.join(closure_.select(F.col("ancestor").alias("term_id"), F.col("term_id").alias("ancestor")), ["term_id", "ancestor"], "left_semi").select("term_id")
    below = closure_.join(top.select(F.col("term_id").alias("ancestor")), "ancestor", "left_semi").select("term_id")
    if not loops.join(below, "term_id", "left_semi").isEmpty():
        raise ValueError("paths below a root run in a cycle")
    e = stored(edge.select("child", "parent").distinct())
    front = found = stored(top.select("term_id", F.lit(1).alias("length"), F.lit(1).cast("decimal(38,0)").alias("n")))
    for length in count(2):
        step = front.join(e, F.col("term_id") == F.col("parent")).groupBy(F.col("child").alias("term_id")).agg(F.sum("n").cast("decimal(38,0)").alias("n"))
        front = stored(step.select("term_id", F.lit(length).alias("length"), "n"))
        if front.isEmpty():
            break
        found = found.unionByName(front)
        if length % REWRITE == 0:
            found = stored(found)
    return found.groupBy("term_id").agg(F.sum("n").cast("long").alias("total_paths"), F.max("length").alias("largest_path"), F.min("length").alias("shortest_path"))


def parental_path(paths_: DataFrame, which: str = "shortest_path", level: int = 0) -> DataFrame:
    """(term_id, path): the first path of the wanted length without the term itself; with a
    ``level``, only its part down from that level."""
    pick = F.min_by("path", F.struct(F.size("path"), "path")) if which == "shortest_path" else F.max_by("path", F.struct(F.size("path"), "path"))
    one = paths_.groupBy("term_id").agg(pick.alias("path"))
    rest = F.slice("path", F.lit(2), F.size("path"))
    if level:
        rest = F.slice(rest, 1, F.greatest(F.size(rest) - F.lit(level), F.lit(0)))
    return one.select("term_id", rest.alias("path"))


def direct(edge: DataFrame, terms: DataFrame, up: bool) -> DataFrame:
    """(term_id, related): parents (``up``) or children of the given terms."""
    a, b = ("child", "parent") if up else ("parent", "child")
    return edge.select(F.col(a).alias("term_id"), F.col(b).alias("related")).distinct().join(terms.select("term_id").distinct(), "term_id", "left_semi")


def familiar(closure_: DataFrame, terms: DataFrame, up: bool, level: DataFrame | None = None) -> DataFrame:
    """(term_id, related, dist): strict ancestors (``up``) or descendants.

    With ``level`` there is a column rank: ancestors from the deepest level up, descendants from
    the highest down, ties by id.
    """
    a, b = ("term_id", "ancestor") if up else ("ancestor", "term_id")
    both = closure_.select(F.col(a).alias("t"), F.col(b).alias("related"), "dist")
    found = both.join(terms.select(F.col("term_id").alias("t")).distinct(), "t", "left_semi").withColumnRenamed("t", "term_id")
    if level is None:
        return found
    order = F.desc_nulls_last("level") if up else F.asc_nulls_last("level")
    ranked = found.join(level.select(F.col("term_id").alias("related"), "level"), "related", "left")
    return ranked.select("term_id", "related", "dist", F.row_number().over(Window.partitionBy("term_id").orderBy(order, "related")).alias("rank"))


def reroot_levels(edge: DataFrame, closure_: DataFrame, root: str) -> DataFrame:
    """(term_id, level) of ``root`` and what lies below it, the root at 1."""
    below = closure_.where(F.col("ancestor") == root).select("term_id", (F.col("dist") + 1).alias("level"))
    return below.unionByName(edge.sparkSession.createDataFrame([(root, 1)], "term_id string, level int"))


def resolve_chains(alt: DataFrame, rounds: int = 40) -> DataFrame:
    """(alt_id, main_id) with chains D -> C -> B followed to their end by pointer jumping.

    Each round doubles the part of a chain that is known.  Ids on a cycle keep the last
    id they came to.
    """
    now = stored(alt.where("alt_id <> main_id").select("alt_id", "main_id"))
    for _ in range(rounds):
        nxt = now.select(F.col("alt_id").alias("m"), F.col("main_id").alias("further"))
        joined = now.join(nxt, F.col("main_id") == F.col("m"), "left").select(
            "alt_id", F.when(F.col("further") == F.col("alt_id"), F.col("main_id")).otherwise(F.coalesce("further", "main_id")).alias("next"), "main_id"
        )
        joined = stored(joined)
        moved = joined.where(F.col("next") != F.col("main_id")).limit(1).count()
        now = joined.select("alt_id", F.col("next").alias("main_id"))
        if not moved:
            break
    return now


def child_relations(edge: DataFrame, closure_: DataFrame, level: DataFrame, terms: DataFrame, up: bool = False, hops: int | None = None) -> DataFrame:
    """(parent, child) relations among the given terms and all that lies below (``up``:
    above) them; ``hops`` limits them to so many levels away from the nearest given one."""
    kin = familiar(closure_, terms, up).select(F.col("related").alias("term_id")).distinct().unionByName(terms.select("term_id").distinct()).distinct()
    if hops is not None:
        lv = kin.join(level, "term_id")
        order = F.desc("level") if up else F.asc("level")
        # levels are few: the window runs over the distinct ones
        ranks = lv.select("level").distinct().withColumn("hop", F.row_number().over(Window.orderBy(order)))
        kin = lv.join(F.broadcast(ranks), "level").where(F.col("hop") <= hops + 1).select("term_id")
    a, b = ("child", "parent") if up else ("parent", "child")
    return edge.join(kin.withColumnRenamed("term_id", a), a, "left_semi").select("parent", "child").distinct()
