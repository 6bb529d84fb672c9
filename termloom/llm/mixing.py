"""Mixing overlapping sources to target weights by min-cost flow.

A document may belong to several sources.  Documents are aggregated by membership
pattern; a flow network routes each pattern's words to the quotas of its sources, and
the k-th repetition of a pattern costs k - 1 a word (convex, so no word is repeated
while another that could serve is still unused).  The flow says how many words each
pattern gives; documents are then taken in the order of a seeded hash, up to the hash
below which exactly that many words lie, found by counting (``splitters``).

Nulls and ties: a null text has size 0; a null source is a source of its own, the last;
rows that repeat are told apart by their number in the stored key table.  Documents of
size 0 are never taken.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.llm import textkernel as tk
from termloom.llm.splitters import _SIGN, Cut, find_cuts
from termloom.llm.storage import arrow, stored

WEIGHTS = (3, 1, 2)
SHARE, MOST = 1.5, 2
SEED = 20240607
#: Patterns and sources whose facts are sent to all executors, some 100 bytes each.
BROADCAST_ROWS = 200_000


def water_fill(sizes: Sequence[int], weights: Sequence[float], total: float, most: float) -> list[float]:
    """Shares of ``total`` by weight, none above ``most`` times its size; what exceeds
    that goes to the others by weight until none is above."""
    shares, full = [0.0] * len(sizes), set()
    while True:
        rest = total - sum(most * sizes[k] for k in full)
        weight = sum(w for k, w in enumerate(weights) if k not in full)
        for k in range(len(sizes)):
            shares[k] = float(most * sizes[k]) if k in full else rest * weights[k] / weight
        over = {k for k in range(len(sizes)) if k not in full and shares[k] > most * sizes[k]}
        if not over:
            return shares
        full |= over
        if len(full) == len(sizes):
            return [float(most * s) for s in sizes]


def min_cost_flow(supplies: Sequence[int], members: Sequence[Sequence[int]], quotas: Sequence[int], most: int) -> list[list[tuple[int, int]]]:
    """Words that each pattern gives to each of its sources, as (source, words) lists.

    Successive shortest paths over the network start -> pattern (``most`` arcs, the k-th
    costs k - 1 a word and holds the pattern's size) -> source -> end (its quota).
    """
    patterns, sources = len(supplies), len(quotas)
    start, end = patterns + sources, patterns + sources + 1
    arcs: list[list] = []  # to, capacity left, cost; the arc's reverse is at index ^ 1
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, capacity: int, cost: int) -> None:
        for x, y, c, k in ((a, b, capacity, cost), (b, a, 0, -cost)):
            out[x].append(len(arcs))
            arcs.append([y, c, k])

    for p in range(patterns):
        for k in range(most):
            arc(start, p, supplies[p], k)
    routes = []
    for p in range(patterns):
        mine = []
        for s in members[p]:
            mine.append((s, len(arcs)))
            arc(p, patterns + s, most * supplies[p], 0)
        routes.append(mine)
    for s in range(sources):
        arc(patterns + s, end, quotas[s], 0)
    while True:
        far: list[float] = [float("inf")] * (end + 1)
        via = [-1] * (end + 1)
        far[start], queue, queued = 0, [start], {start}
        while queue:
            x = queue.pop(0)
            queued.discard(x)
            for i in out[x]:
                y, c, k = arcs[i]
                if c > 0 and far[x] + k < far[y]:
                    far[y], via[y] = far[x] + k, i
                    if y not in queued:
                        queued.add(y)
                        queue.append(y)
        if via[end] < 0:
            return [[(s, arcs[i ^ 1][1]) for s, i in mine if arcs[i ^ 1][1]] for mine in routes]
        path, x = [], end
        while x != start:
            path.append(via[x])
            x = arcs[via[x] ^ 1][0]
        least = min(arcs[i][1] for i in path)
        for i in path:
            arcs[i][1] -= least
            arcs[i ^ 1][1] += least


def _sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        names = [n for n in b.schema.names if n != "text"]
        for flat in tk.chunks(b.column("text")):
            part = b.slice(flat.first, flat.n)
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), pa.array(np.diff(tk.words(flat).at), pa.int64())], [*names, "size"])


def mix_keys(docs: DataFrame, members: Column, payload: Sequence[Column] = ()) -> DataFrame:
    """The stored key table: doc_id, source, members (sorted array), hashes, payload, size.

    ``size`` is the number of words, maximal runs outside ``[\\x20\\x09-\\x0D]``.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.array_sort(F.array_distinct(members)).alias("members"),
        F.xxhash64(F.lit(SEED), F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit(""))).alias("k1"),
        F.xxhash64(F.monotonically_increasing_id()).alias("k2"),
        *payload,
        "text",
    )
    return stored(arrow(rows, _sized, T.StructType([*rows.drop("text").schema, T.StructField("size", T.LongType())])))


def plan_mix(keys: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``keys`` with source_size, target (both of its own source) and taken (words).

    The driver gets a row for each source and each membership pattern, never documents.
    A document's ``taken`` is a multiple of its size, except for one document a pattern
    that is cut so that the pattern's words come out as routed.
    """
    patterns = keys.groupBy("members").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    owned = {r["source"]: r["size"] for r in keys.groupBy("source").agg(F.sum("size").alias("size")).collect()}
    names = sorted({m for r in patterns for m in r["members"]} | set(owned), key=lambda s: (s is None, s or ""))
    if not names:
        empty = F.lit(0).cast("long")
        return keys.select("*", empty.alias("source_size"), F.lit(0.0).alias("target"), empty.alias("taken"))
    number = {s: k for k, s in enumerate(names)}
    sizes = [owned.get(s, 0) for s in names]
    targets = water_fill(sizes, [weights[k % len(weights)] for k in range(len(names))], share * sum(sizes), most)
    order = sorted(range(len(patterns)), key=lambda k: [number[m] for m in patterns[k]["members"]])
    patterns = [patterns[k] for k in order]
    flow = min_cost_flow([r["size"] for r in patterns], [[number[m] for m in r["members"]] for r in patterns], [round(t) for t in targets], most)
    gives = [sum(w for _, w in f) for f in flow]

    spark = keys.sparkSession
    rows = [(r["members"], k, gives[k] // r["size"] if r["size"] else 0, gives[k] % r["size"] if r["size"] else 0) for k, r in enumerate(patterns)]
    coded = spark.createDataFrame(rows, "members array<string>, code long, whole long, part long")
    # rows that came from the driver are few; beyond the bound a shuffled join, which AQE splits where it is skewed
    small = F.broadcast if len(rows) + len(names) <= BROADCAST_ROWS else (lambda df: df)
    coded = stored(keys.select("members", "k1", "k2", "size").join(small(coded), "members"))
    cuts = find_cuts(coded, ["code", "k1", "k2"], "size", {(k,): [(0, float(p))] for _, k, _, p in rows if p}, 0.0)
    # after the cut nearest to the routed words, one document makes up the difference
    edges = []
    for names_, k, whole, part in rows:
        cut = cuts.get(((k,), 0), Cut(None, 0))
        none = cut.last is None or cut.last[0] != k + _SIGN
        last = (-_SIGN, -_SIGN) if none else (cut.last[1] - _SIGN, cut.last[2] - _SIGN)
        edges.append((names_, k, whole, none, *last, part - (0 if none else cut.below)))
    edge = spark.createDataFrame(edges, "members array<string>, code long, whole long, none boolean, c1 long, c2 long, owed long")
    inside = ~F.col("none") & (F.struct("k1", "k2") <= F.struct(F.col("c1").alias("k1"), F.col("c2").alias("k2")))
    marked = coded.drop("members").join(small(edge.drop("members", "whole")), "code").withColumn("inside", inside)
    # where words are owed: the first document after the cut gives them; where too many, the last before
    fits = F.when(F.col("owed") > 0, ~F.col("inside")).when(F.col("owed") < 0, F.col("inside")) & (F.col("size") >= F.abs("owed"))
    place = F.struct("k1", "k2")
    mender = marked.where(fits).groupBy("code").agg(F.min(F.when(F.col("owed") > 0, place)).alias("m1"), F.max(F.when(F.col("owed") < 0, place)).alias("m2"))
    # a row for each pattern, like the tables that come from the driver below
    found = {r["code"]: r["m"] for r in mender.select("code", F.coalesce("m1", "m2").alias("m")).collect()}
    last = [(*e, *(found.get(e[1]) or (None, None))) for e in edges]
    edge = spark.createDataFrame(last, "members array<string>, code long, whole long, none boolean, c1 long, c2 long, owed long, m1 long, m2 long")
    taken = F.col("size") * (F.col("whole") + F.col("inside").cast("long")) + F.when((F.col("k1") == F.col("m1")) & (F.col("k2") == F.col("m2")), F.col("owed")).otherwise(F.lit(0))
    facts = spark.createDataFrame([(s is None, s or "", sizes[k], targets[k]) for k, s in enumerate(names)], "is_null boolean, s string, source_size long, target double")
    return (
        keys.join(small(edge), "members")
        .withColumn("inside", inside)
        .withColumn("taken", taken.cast("long"))
        .join(small(facts), (F.col("source").isNull() == F.col("is_null")) & (F.coalesce("source", F.lit("")) == F.col("s")))
    )


def mix(docs: DataFrame, members: Column | None = None, **options) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for each row of ``docs``.

    ``members`` is an array of source names, by default the one in ``source``.
    """
    members = F.array(F.col("source").cast("string")) if members is None else members
    return plan_mix(mix_keys(docs, members), **options).select("doc_id", "size", "source_size", "target", "taken")


def take(docs: DataFrame, members: Column | None = None, **options) -> DataFrame:
    """The mixed rows of ``docs``, columns unchanged.

    A document gives one row for each whole time it is taken, and one more where the last
    part is at least half of it.  The texts ride along in the key table, so that they are
    moved nowhere but into it.
    """
    members = F.array(F.col("source").cast("string")) if members is None else members
    keys = mix_keys(docs, members, [F.struct("*").alias("r")])
    taken = plan_mix(keys, **options)
    times = F.when(F.col("size") > 0, F.floor((F.lit(2) * F.col("taken") + F.col("size")) / (F.lit(2) * F.col("size")))).otherwise(F.lit(0)).cast("int")
    return taken.select("r", F.explode(F.array_repeat(F.lit(0), times))).select("r.*")
