"""String similarity and text cleaning as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from termloom.shipping import ship


def bigrams(s: Column) -> Column:
    """All runs of two characters, repeats included; empty below two characters."""
    n = F.length(s)
    return F.when(n >= 2, F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substr(s, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def white_similarity(a: Column, b: Column) -> Column:
    """Twice the distinct shared bigrams over all bigrams; 0 where neither has any."""
    x, y = bigrams(F.trim(a)), bigrams(F.trim(b))
    total = F.size(x) + F.size(y)
    return F.when(total > 0, F.try_divide(F.lit(2.0) * F.size(F.array_intersect(x, y)), total)).otherwise(F.lit(0.0))


def common_subsequence(x: str, y: str) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, by the greedy O(ND) edit search."""
    n, m = len(x), len(y)
    reach = {1: 0}
    steps: list[dict[int, int]] = []
    for d in range(n + m + 1):
        steps.append(dict(reach))
        for diagonal in range(-d, d + 1, 2):
            below, beside = reach.get(diagonal + 1, -1), reach.get(diagonal - 1, -1)
            at = below if diagonal == -d or (diagonal != d and beside < below) else beside + 1
            while at < n and at - diagonal < m and x[at] == y[at - diagonal]:
                at += 1
            reach[diagonal] = at
            if at >= n and at - diagonal >= m:
                return _walk_back(steps, n, m)
    return []


def _walk_back(steps: list[dict[int, int]], at: int, col: int) -> list[tuple[int, int]]:
    pairs = []
    for d in range(len(steps) - 1, -1, -1):
        reach, diagonal = steps[d], at - col
        below, beside = reach.get(diagonal + 1, -1), reach.get(diagonal - 1, -1)
        down = diagonal == -d or (diagonal != d and beside < below)
        start = below if down else beside + 1
        while at > start and d >= 0 and at > 0 and col > 0 and at - 1 >= start:
            at, col = at - 1, col - 1
            pairs.append((at, col))
        if d == 0:
            break
        at, col = (start, start - diagonal - 1) if down else (start - 1, start - diagonal)
    return pairs[::-1]


def gap_similarity(x: str, y: str) -> float:
    """1 less the share of characters skipped before each match of the common subsequence;
    what follows the last match is not charged."""
    total = len(x) + len(y)
    if not total:
        return 1.0
    skipped, last = 0, (-1, -1)
    for i, j in common_subsequence(x, y):
        skipped += (i - last[0] - 1) + (j - last[1] - 1)
        last = (i, j)
    return (total - skipped) / total


def _gap_series(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([gap_similarity((x or "").strip(), (y or "").strip()) for x, y in zip(a, b)])


def similarity(a: Column, b: Column, algorithm: str = "white") -> Column:
    """``white`` (bigrams, built in) or ``ukkonen_myers`` (a pandas UDF: no built-in finds
    common subsequences)."""
    if algorithm == "white":
        return white_similarity(a, b)
    if algorithm == "ukkonen_myers":
        return F.pandas_udf(_gap_series, DoubleType())(a, b)
    raise ValueError(f"unknown algorithm {algorithm}")


def fragments(s: Column, split_char: str = ";", remove: str = "") -> Column:
    """The parts of a composed text without the characters in ``remove``, empty ones left out."""
    parts = F.split(s, F.lit("\\Q" + split_char + "\\E"))
    if remove:
        drop = "[" + "".join("\\" + c if c in "\\]^-[" else c for c in remove) + "]"
        parts = F.transform(parts, lambda p: F.regexp_replace(p, drop, ""))
    return F.filter(parts, lambda p: F.length(p) > 0)


def complex_similarity(a: Column, b: Column, split_char: str = ";", remove: str = "") -> Column:
    """Mean of both directions' mean best bigram similarity between the fragments."""
    x, y = fragments(a, split_char, remove), fragments(b, split_char, remove)

    def one_way(p: Column, q: Column) -> Column:
        best = F.transform(p, lambda s: F.coalesce(F.array_max(F.transform(q, lambda t: white_similarity(s, t))), F.lit(0.0)))
        return F.try_divide(F.aggregate(best, F.lit(0.0), lambda acc, v: acc + v), F.size(p))

    return (F.coalesce(one_way(x, y), F.lit(0.0)) + F.coalesce(one_way(y, x), F.lit(0.0))) / 2


def similarity_network(rows: DataFrame, algorithm: str = "white", split_char: str = ";", remove: str = "", unique: bool = False) -> DataFrame:
    """(a, b, sim).  Rows of (pos, text) are compared each with all that follow; rows of
    (pos, text, other) are compared with their own other text."""

    def score(a: Column, b: Column) -> Column:
        if algorithm == "white":
            return complex_similarity(a, b, split_char, remove)
        ship(rows.sparkSession)
        return similarity(a, b, algorithm)

    if "other" in rows.columns:
        return rows.select(F.col("text").alias("a"), F.col("other").alias("b"), score(F.col("text"), F.col("other")).alias("sim"))
    if unique:
        rows = rows.groupBy("text").agg(F.min("pos").alias("pos"))
    x, y = rows.select(F.col("pos").alias("i"), F.col("text").alias("a")), rows.select(F.col("pos").alias("j"), F.col("text").alias("b"))
    pairs = x.join(y, F.col("i") < F.col("j")).withColumn("sim", score(F.col("a"), F.col("b")))
    return pairs.groupBy("a", "b").agg(F.max_by("sim", F.struct("i", "j")).alias("sim"))


def extract_year(s: Column) -> Column:
    """The last run of four digits on a line, as a number; null without one."""
    return F.nullif(F.regexp_extract(s, r".*(\d{4}).*", 1), F.lit("")).cast("int")


def clean_text(s: Column, kind: str = "hard") -> Column:
    """``basic`` leaves the text; ``soft`` joins broken lines, strips, maps carriage returns
    and tabs, drops LaTeX commands and folds blanks; ``hard`` also rewrites decimal signs,
    "i.e." and "al."."""
    if kind == "basic":
        return s
    if kind not in ("soft", "hard"):
        raise ValueError(f"unknown cleaning {kind}")
    s = F.regexp_replace(s, r"(?<![A-Za-z()])([A-Za-z()]++ *+)\n( *[A-Za-z()-]+)", "$1 $2")  # a word is tried from its first sign only
    s = F.regexp_replace(s, r"^\s+|\s+$", "")
    for old, new in (("\r", "\n"), ("&#13", "\n"), ("\t", " ")):
        s = F.replace(s, F.lit(old), F.lit(new))
    s = F.regexp_replace(s, r"\\[a-z]+(?:\[.+\])?\{(.+)\}", "$1")
    s = F.regexp_replace(s, " +", " ")
    if kind == "hard":
        s = F.regexp_replace(s, "([0-9]+)[.,]([0-9]+)", "$1'$2")
        s = F.replace(F.regexp_replace(s, r"i\.?e\.?", "ie"), F.lit("al."), F.lit("al "))
    return s


def filled(s: Column) -> Column:
    """Neither null nor blank once the entity of the no-break space is taken out."""
    return F.coalesce(F.replace(F.trim(s), F.lit("&#x000a0;"), F.lit("")), F.lit("")) != ""


def in_terms(words: Sequence[str]) -> Column:
    return F.array(*(F.lit(w) for w in words)).cast("array<string>")
