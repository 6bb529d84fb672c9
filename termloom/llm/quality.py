"""Quality rules with adaptive thresholds.

Each document gets whole-text counts; ratios of these go into mergeable quantile
sketches, one for each language, source and ratio.  A sketch is a log-linear histogram:
whole numbers below 512 have a bucket each, larger ones share a bucket with at most 1/256
relative width, which is finer than the spread of any ratio here.  Merging adds counts, so the result depends neither on the order nor on
the partitioning, and a sketch has at most some 14,000 buckets whatever the rows.

A threshold climbs its group's sketch: the spread starts as the distance from the median
down to the lower quartile, which junk cannot reach, and takes in the 75th, 90th, 95th, 98th and
99th percentile in turn, as long as each is at most JUMP times as far from the median as what came
before; the first jump is where another population begins, and there the climb ends.  The
threshold is the median plus REACH times the spread and one event (what a single
occurrence adds in a text of the group's median length).  So a group whose upper third
is junk has the threshold of its clean part.  Every sketch is filled up with PRIOR
pseudo-documents at the quantiles of its language's sketch, and that one with those of the
whole table: small groups lean on them, large ones do not feel them, and no size
switches anything.  Documents are then joined with their group's
thresholds and the ones beyond any are rejected.

Nulls and empties: a null text has no words and is rejected by the base rule like any
other text under ten words; a null language or source is a group of its own; repeated
rows are judged alike.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from termloom.llm import textkernel as tk
from termloom.llm.storage import arrow, stored

WINDOW = 5
#: Ratio -> (count, what it is a share of, the count that one occurrence adds).  Ratios are per
#: mille.  A repeat covers two windows, a capitalised word some five letters.
RATIOS = {
    "symbols": ("n_symbols", "n_words", 1),
    "duplicate_lines": ("n_dup_lines", "n_lines", 1),
    "repeats": ("n_repeat_words", "n_words", 2 * WINDOW),
    "stutter": ("n_stutter", "n_words", 1),
    "capitals": ("n_capitals", "word_chars", 5),
    "marks": ("n_marks", "n_words", 1),
    "wide": ("word_chars", "n_words", 5),
}
#: A percentile further from the median than JUMP spreads and an event is of another population.
JUMP = 4
#: The threshold lies this many spreads and events above the median.
REACH = 4
#: Pseudo-documents that a sketch takes from the one above it.
PRIOR = 20
CLIMB = (75, 90, 95, 98, 99)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?~^_=+{}[]\\/@`")] = True

_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stutter", "n_lines", "n_capitals", "n_marks")
SCHEMA = "doc_id long, lang string, source string, " + ", ".join(f"{c} long" for c in _COUNTS)


def line_ranges(flat: tk.Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, range of each document) of the ``\\n``-split lines; a text has at least one."""
    breaks = np.flatnonzero(flat.data == 10)
    start = np.sort(np.concatenate((flat.offsets[:-1], breaks + 1)), kind="stable")
    end = np.sort(np.concatenate((flat.offsets[1:], breaks)), kind="stable")
    # an empty document and the one after it start alike: line counts keep them apart
    n = 1 + np.searchsorted(breaks, flat.offsets[1:]) - np.searchsorted(breaks, flat.offsets[:-1])
    return start, end, np.concatenate(([0], np.cumsum(n)))


def text_counts(flat: tk.Flat) -> dict[str, np.ndarray]:
    """The counts of every document of ``flat``."""
    w = tk.words(flat)
    n = np.diff(w.at)
    bounds = flat.offsets

    def count(mask: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.cumsum(mask)))[bounds])

    in_words = ~tk._SPACE[flat.data]
    out = {
        "n_words": n,
        "word_chars": count(in_words & (flat.data & 0xC0 != 0x80)),
        "n_symbols": count(_SYMBOL[flat.data]),
        "n_capitals": count(_CAPITAL[flat.data]),
        "n_marks": count(_MARK[flat.data]),
    }
    start, end, at = line_ranges(flat)
    filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    held = np.concatenate(([0], np.cumsum(filled)))[at]
    _, kept = tk.distinct_sorted(tk.range_hashes(flat.data, start[filled], end[filled], False), held)
    out["n_lines"] = np.diff(held)
    out["n_dup_lines"] = np.diff(held) - np.diff(kept)

    out["n_repeat_words"] = np.zeros(flat.n, np.int64)
    hashes = tk.word_hashes(flat, w, lower=False)
    same = np.zeros(len(hashes) + 1, np.int64)
    same[2:] = np.cumsum(hashes[1:] == hashes[:-1])
    # a document's first word has no word before it
    out["n_stutter"] = same[w.at[1:]] - same[np.minimum(w.at[:-1] + 1, w.at[1:])]
    windows, to = tk.shingles(hashes, w.at, WINDOW)
    _, single = tk.distinct_sorted(windows, to)
    for d in np.flatnonzero((np.diff(to) > np.diff(single)) & (n > WINDOW)):
        own = windows[to[d] : to[d + 1]]
        _, back, times = np.unique(own, return_inverse=True, return_counts=True)
        hit = np.concatenate((times[back] > 1, np.zeros(WINDOW - 1, bool))).astype(np.int64)
        out["n_repeat_words"][d] = int((np.convolve(hit, np.ones(WINDOW, np.int64))[: len(hit)] > 0).sum())
    return out


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for flat in tk.chunks(b.column("text")):
            c = text_counts(flat)
            own = [b.column(k).slice(flat.first, flat.n) for k in ("doc_id", "lang", "source")]
            yield pa.RecordBatch.from_arrays([*own, *(pa.array(c[k], pa.int64()) for k in _COUNTS)], ["doc_id", "lang", "source", *_COUNTS])


def counts(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the counts of every row."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    return arrow(narrow, _count_batches, SCHEMA)


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (F.lit(100) * F.col("n_repeat_words") > F.lit(20) * F.col("n_words"))


def ratios() -> dict[str, Column]:
    """Whole per-mille ratios of the counts (``wide``: a thousandth of a character a word)."""
    return {k: F.expr(f"{a} * 1000 div greatest({b}, 1)") for k, (a, b, _) in RATIOS.items()}


def bucket(v: Column) -> Column:
    """Log-linear bucket of a whole number, at most 1/256 wide relative to it."""
    e = F.greatest(F.length(F.bin(v)) - 9, F.lit(0))
    return (e * 256 + F.call_function("shiftright", v, e)).cast("int")


def bucket_top(b: Column) -> Column:
    """The largest number in a bucket."""
    e = F.greatest(F.floor(b / 256).cast("int") - 1, F.lit(0))
    return (F.call_function("shiftleft", (b - e * 256 + 1).cast("long"), e) - 1).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """(lang, source, ratio, top, n): the sketches of all groups, in one aggregate.

    Beside the ratios there are sketches of the counts that these are shares of; ``top`` is
    the largest number in a bucket.
    """
    values = ratios() | {b: F.col(b) for _, b, _ in RATIOS.values()}
    each = F.explode(F.array(*(F.struct(F.lit(k).alias("ratio"), bucket(v).alias("bucket")) for k, v in values.items())))
    counted = measured.where("n_words > 0").select("lang", "source", each.alias("s")).groupBy("lang", "source", "s.ratio", "s.bucket").agg(F.count("*").alias("n"))
    return counted.select("lang", "source", "ratio", bucket_top(F.col("bucket")).alias("top"), "n")


def _running(rows: DataFrame, by: list[str]) -> DataFrame:
    """The sketches merged by ``by`` and ratio, with running and whole counts."""
    merged = rows.groupBy(*by, "ratio", "top").agg(F.sum("n").alias("n"))
    w = Window.partitionBy(*by, "ratio")
    return merged.select(*by, "ratio", "top", "n", F.sum("n").over(w.orderBy("top")).alias("cum"), F.sum("n").over(w).alias("total"))


def _quantile(part: int, whole: int) -> Column:
    return F.min(F.when(F.col("cum") * whole >= F.col("total") * part, F.col("top")))


def _prior(running: DataFrame, by: list[str]) -> DataFrame:
    """The PRIOR pseudo-documents of each sketch: its evenly spread quantiles."""
    return running.groupBy(*by, "ratio").agg(F.array(*(_quantile(2 * k + 1, 2 * PRIOR) for k in range(PRIOR))).alias("prior"))


def _filled(rows: DataFrame, by: list[str], prior: DataFrame, on: Column) -> DataFrame:
    """``rows`` and, for each of their sketches, the pseudo-documents of the one above."""
    keys = rows.select(*by, "ratio").distinct()
    more = keys.join(prior.withColumnRenamed("ratio", "r"), (F.col("ratio") == F.col("r")) & on).select(*by, "ratio", F.explode("prior").alias("top"), F.lit(1).cast("long").alias("n"))
    return rows.select(*by, "ratio", "top", "n").unionByName(more)


def thresholds(sketch: DataFrame) -> DataFrame:
    """(g_lang, g_source, max_<ratio> ..., own_<ratio> ...), a row for each group; ``own`` says
    that the spread of the group's quantiles, not the single event, makes up the larger part."""
    above = _prior(_running(sketch, []), [])
    langs = _running(_filled(sketch, ["lang"], above, F.lit(True)), ["lang"])
    prior = _prior(langs, ["lang"]).withColumnRenamed("lang", "l")
    run = _running(_filled(sketch, ["lang", "source"], prior, F.col("lang").eqNullSafe(F.col("l"))), ["lang", "source"])
    q = run.groupBy("lang", "source", "ratio").agg(*(_quantile(p, 100).alias(f"q{p}") for p in (25, 50, *CLIMB)))
    sizes = q.groupBy("lang", "source").agg(*(F.max(F.when(F.col("ratio") == b, F.col("q50"))).alias(f"mid_{b}") for b in sorted({b for _, b, _ in RATIOS.values()})))
    sizes = sizes.select(F.col("lang").alias("g_lang"), F.col("source").alias("g_source"), *(c for c in sizes.columns if c.startswith("mid_")))
    q = q.where(F.col("ratio").isin(*RATIOS)).join(sizes, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")))
    event = F.lit(1)
    for k, (_, b, n) in RATIOS.items():
        event = F.when(F.col("ratio") == k, F.greatest(F.lit(1), F.expr(f"{1000 * n} div greatest(mid_{b}, 1)"))).otherwise(event)
    q = q.withColumn("event", event).withColumn("spread", F.col("q50") - F.col("q25")).withColumn("on", F.lit(True))
    for p in CLIMB:
        far = F.col(f"q{p}") - F.col("q50")
        q = q.withColumn("on", F.col("on") & (far <= JUMP * (F.col("spread") + F.col("event")))).withColumn("spread", F.when(F.col("on"), F.greatest("spread", far)).otherwise(F.col("spread")))
    q = q.withColumn("limit", F.col("q50") + REACH * (F.col("spread") + F.col("event")))
    pick = lambda k, c: F.max(F.when(F.col("ratio") == k, c))
    return q.groupBy("g_lang", "g_source").agg(*(pick(k, F.col("limit")).alias(f"max_{k}") for k in RATIOS), *(pick(k, F.col("spread") > F.col("event")).alias(f"own_{k}") for k in RATIOS))


def _beyond() -> Column:
    out = F.lit(False)
    for k, v in ratios().items():
        out = out | F.coalesce(v > F.col(f"max_{k}"), F.lit(False))
    return out


def quality(docs: DataFrame) -> DataFrame:
    """The counts of every row with base_failed, the group's thresholds and kept."""
    measured = stored(counts(docs))
    limit = stored(thresholds(sketches(measured)))
    # one row a group; Spark broadcasts it below its own size threshold and shuffles beyond
    joined = measured.join(limit, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    beyond = _beyond()
    return joined.select(
        "doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base_failed().alias("base_failed"), (~base_failed() & ~beyond).alias("kept"), *(f"max_{k}" for k in RATIOS)
    )


def _judged(columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for flat in tk.chunks(b.column("text")):
                c = text_counts(flat)
                part = b.slice(flat.first, flat.n)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in columns), *(pa.array(c[k], pa.int64()) for k in _COUNTS)], [*columns, *_COUNTS])

    return run


def keep_good(docs: DataFrame) -> DataFrame:
    """``docs`` without the rejected rows, its columns unchanged.

    The texts are counted twice, once for the sketches and once beside the thresholds,
    which is cheaper than moving them to join the verdicts.
    """
    measured = counts(docs)
    limit = stored(thresholds(stored(sketches(measured))))
    packed = docs.select(F.struct("*").alias("r"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), "text")
    schema = T.StructType([*packed.drop("text").schema, *(T.StructField(c, T.LongType()) for c in _COUNTS)])
    again = arrow(packed, _judged(["r", "lang", "source"]), schema)
    joined = again.join(limit, F.col("lang").eqNullSafe(F.col("g_lang")) & F.col("source").eqNullSafe(F.col("g_source")), "left")
    return joined.where(~base_failed() & ~_beyond()).select("r.*")
