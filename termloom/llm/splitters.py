"""Exact splitters by histogram refinement.

Rows have a key of several 64-bit words, compared in order, and a weight.  For wanted
cumulative weights, probes cut each interval that still holds a wanted position into
equal parts; one aggregate counts the exact weight of every part over all partitions;
the part that holds the position is probed next.  A position settles when its part
weighs no more than the tolerance or holds a single row.  The driver only sees the
histograms: at most 4096 numbers for the first round and 256 for each open position
afterwards.  Rows are never moved or sampled.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SIGN = 1 << 63
_FULL = (1 << 64) - 1


def _signed(x: int) -> int:
    return x - _SIGN


class Interval(NamedTuple):
    """All keys whose first words are ``fixed`` and whose next word starts with ``prefix``
    (``bits`` leading bits of the word with its sign flipped)."""

    fixed: tuple[int, ...]
    bits: int
    prefix: int


class Cut(NamedTuple):
    """Keys at or below ``last`` (unsigned words) weigh ``below`` in all."""

    last: tuple[int, ...] | None
    below: int


def _edges(x: Interval, words: int) -> tuple[int, int]:
    """First and last key of the interval as whole numbers."""
    first = last = 0
    for k in range(words):
        if k < len(x.fixed):
            lo = hi = x.fixed[k]
        elif k == len(x.fixed):
            rest = 64 - x.bits
            lo, hi = x.prefix << rest, ((x.prefix + 1) << rest) - 1
        else:
            lo, hi = 0, _FULL
        first, last = first << 64 | lo, last << 64 | hi
    return first, last


def _words(key: int, words: int) -> tuple[int, ...] | None:
    if key < 0:
        return None
    return tuple(key >> 64 * (words - 1 - k) & _FULL for k in range(words))


def find_cuts(
    keys: DataFrame, words: list[str], weight: str, targets: dict[tuple[int, ...], list[tuple[int, float]]], tolerance: float, first_bits: int = 12, next_bits: int = 8
) -> dict[tuple[tuple[int, ...], int], Cut]:
    """The cut nearest to each wanted weight.

    ``keys`` should be stored, for it is read once a round.  ``targets`` maps fixed leading
    words (signed; ``()`` for the whole table) to (name, wanted weight below the cut, counted
    from the first such key).  Returns (fixed, name) -> Cut, with ``below`` counted likewise.
    """
    spark = keys.sparkSession
    out: dict[tuple[tuple[int, ...], int], Cut] = {}
    # interval -> [(owner, name, wanted, weight below the interval)]
    open_: dict[Interval, list[tuple]] = {}
    for fixed, wanted in targets.items():
        if wanted:
            open_[Interval(tuple(v + _SIGN for v in fixed), 0, 0)] = [(fixed, name, t, 0) for name, t in wanted]
    while open_:
        later: dict[Interval, list[tuple]] = {}
        shapes: dict[tuple[int, int], list[Interval]] = {}
        for x in open_:
            shapes.setdefault((len(x.fixed), x.bits), []).append(x)
        for (depth, bits), intervals in shapes.items():
            step = min(64 - bits, first_bits if bits == 0 and len(intervals) == 1 else next_bits)
            word = F.col(words[depth]).bitwiseXOR(F.lit(-_SIGN))
            child = F.shiftrightunsigned(word, 64 - bits - step) if bits + step < 64 else word
            kept = keys.select(*words[: depth + 1], weight)
            number = F.lit(0)
            if depth or bits:
                fields = [f"f{k} long" for k in range(depth)] + ["p long", "n int"]
                rows = [(*(_signed(v) for v in x.fixed), x.prefix - (1 << 64) if x.prefix >= _SIGN else x.prefix, n) for n, x in enumerate(intervals)]
                # one row for each open position: bounded by the number of wanted cuts
                near = F.broadcast(spark.createDataFrame(rows, ", ".join(fields)))
                on = [kept[words[k]] == near[f"f{k}"] for k in range(depth)]
                if bits:
                    on.append(F.shiftrightunsigned(kept[words[depth]].bitwiseXOR(F.lit(-_SIGN)), 64 - bits) == near["p"])
                cond = on[0]
                for c in on[1:]:
                    cond = cond & c
                kept, number = kept.join(near, cond), F.col("n")
            rows = kept.groupBy(number.alias("node"), child.alias("child")).agg(
                F.sum(weight).alias("w"), F.count("*").alias("c"), F.min(words[depth]).alias("lo"), F.max(words[depth]).alias("hi")
            ).collect()
            parts: dict[int, list] = {}
            for r in rows:
                parts.setdefault(r["node"], []).append((r["child"] & _FULL, int(r["w"] or 0), r["c"], r["lo"], r["hi"]))
            for n, x in enumerate(intervals):
                mine = sorted(parts.get(n, []))
                for owner, name, t, below in open_[x]:
                    if not mine:
                        out[owner, name] = Cut(_words(_edges(x, len(words))[0] - 1, len(words)), below)
                        continue
                    at = below
                    for p, w, c, lo, hi in mine:
                        if at + w >= t or p == mine[-1][0]:
                            break
                        at += w
                    part = Interval(x.fixed, bits + step, p)
                    if lo == hi and c > 1 and w > tolerance and depth + 1 < len(words):
                        later.setdefault(Interval((*x.fixed, lo + _SIGN), 0, 0), []).append((owner, name, t, at))
                    elif c > 1 and w > tolerance and bits + step < 64:
                        later.setdefault(part, []).append((owner, name, t, at))
                    else:
                        first, last = _edges(part, len(words))
                        out[owner, name] = Cut(_words(last, len(words)), at + w) if 2 * (t - at) > w else Cut(_words(first - 1, len(words)), at)
        open_ = later
    return out


def literal(cut: Cut, names: list[str]) -> Column:
    """The cut's last key as a struct of signed words."""
    return F.struct(*(F.lit(_signed(v)).alias(n) for v, n in zip(cut.last, names)))


def cuts_below(cuts: list[Cut], words: list[str]) -> Column:
    """How many of the ascending ``cuts`` lie wholly below a row's key.

    Cuts are grouped by the leading bits of their first word, so that a row compares
    itself with the few of its own group only.
    """
    always = sum(c.last is None for c in cuts)
    cuts = [c for c in cuts if c.last is not None]
    if not cuts:
        return F.lit(always)
    bits = max(1, min(12, len(cuts).bit_length() - 2))
    groups: list[list[Cut]] = [[] for _ in range(1 << bits)]
    for c in cuts:
        groups[c.last[0] >> (64 - bits)].append(c)
    kind = "array<struct<" + ",".join(f"{w}:bigint" for w in words) + ">>"
    before, entries = always, []
    for g in groups:
        entries.append(F.struct(F.lit(before).alias("base"), F.array(*(literal(c, words) for c in g)).cast(kind).alias("cuts")))
        before += len(g)
    key = F.struct(*(F.col(w).alias(w) for w in words))
    entry = F.element_at(F.array(*entries), F.shiftrightunsigned(F.col(words[0]).bitwiseXOR(F.lit(-_SIGN)), 64 - bits).cast("int") + 1)
    return entry["base"] + F.size(F.filter(entry["cuts"], lambda c: c < key))
