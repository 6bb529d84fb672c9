"""Personal data: fixed patterns, and identifiers found by bootstrapped contexts.

The fixed patterns give the base spans and the seed entities.  A pattern is a context: the
two words before, the two words after, or the word on each side, with digits masked; what
stands in it may be anything, with or without blanks, digits or a leading plus.  Patterns
are induced from the seeds, and the texts are then read for all instances of these
patterns; those that ordinary words fill, so that known values are less than a fifth of their
instances, are left aside.  Patterns and instances (by value) form a graph over the whole corpus, which
Spark scores in turns: a pattern's confidence is the share of its distinct instances'
scores, damped by how few they are; an instance's score is the best confidence of its
patterns, and 1 for a seed.  Instances above the bar are promoted: in the next turn the texts
are read for the contexts in which these stand (values of up to SPAN tokens), new patterns
are induced from seeds and promoted instances alike, and so on.  Instances of confident patterns that are no seeds are reported
as ``found``, spans that overlap as one.

Patterns and values are 64-bit hashes.  The sets of them that tasks look up are broadcast,
eight bytes for each pattern that holds enough distinct known instances.

All offsets are code points.  A null or empty text has no spans; repeated rows are scanned
alike and count once as instances.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import textkernel as tk
from termloom.llm.storage import arrow, stored

KINDS = ("email", "ip", "card", "phone", "found")
#: Turns of scoring, the confidence of a pattern that may report, and the distinct
#: instances that damp it by half.
TURNS, CONFIDENT, DAMP = 3, 0.8, 1.0
#: Distinct known instances that a reporting pattern must hold: seeds, and instances that
#: earlier turns promoted.
SEEDS = 4

U64 = np.uint64

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match takes whole runs of digits, so it begins where a run begins: no run is tried twice
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LONG_RUN = re.compile(r"[0-9](?:[\x20-]?[0-9]){15}")
_IP_LIKE = re.compile(r"[0-9]\.[0-9]")
_DIGIT = re.compile(r"[0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(_DIGIT.findall(s))


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of ``[A-Za-z0-9._%+-]+@`` and a dotted domain, found from each @ on."""
    after, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > after and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            after = m.end()
            yield start, after
        at = text.find("@", max(at + 1, after))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, failing matches dropped."""
    spans = []
    if "@" in text:
        spans += [(0, *x) for x in _emails(text)]
    if not _DIGIT.search(text):
        return spans
    if _IP_LIKE.search(text):
        spans += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-40:]) <= 255 for p in m[0].split("."))]
    if _LONG_RUN.search(text):
        spans += [(2, *m.span()) for m in _CARD.finditer(text) if 16 <= len(d := _digits(m[0])) <= 19 and _luhn(d)]
    if "+" in text:
        spans += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= len(_digits(m[0])) <= 15]
    return spans


# A context token is a run of these bytes, without the signs that merely hang on at its ends.
_INSIDE = np.zeros(256, bool)
_INSIDE[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789")] = True
_INSIDE[128:] = True
_LAST = _INSIDE.copy()
_FIRST = _INSIDE.copy()
_FIRST[list(b"+@")] = True
_INSIDE[list(b"+@._%/&#-")] = True
_IS_DIGIT = np.zeros(256, bool)
_IS_DIGIT[48:58] = True
_MASKED = np.arange(256, dtype=np.uint8)
_MASKED[48:58] = 48
#: A pattern is tried when known values are at least this share of its distinct instances.
SHARE = 0.2
#: One of so many values is looked at to tell patterns far below that share.
SAMPLE = 64
#: Most tokens between the two words of a pattern that is open to both sides.
SPAN = 9
_EDGE, _STEP = U64(1), U64(0x9FB21C651E98DF25)
_TAGS = (U64(0x3C79AC492BA7B653), U64(0x1C69B3F74AC4AE35), U64(0xF39CC0605CEDC835))


class Tokens(NamedTuple):
    """Tokens with two edge marks before and after each document, so that contexts end there.

    ``start`` and ``end`` are byte ranges; ``context`` has digits masked, ``value`` has not.
    Document d owns the places ``at[d] .. at[d + 1]``, marks included.
    """

    start: np.ndarray
    end: np.ndarray
    real: np.ndarray
    digit: np.ndarray
    context: np.ndarray
    value: np.ndarray
    at: np.ndarray


def tokens(flat: tk.Flat) -> Tokens:
    n = len(flat.data)
    inside = _INSIDE[flat.data]
    cut = np.zeros(n + 1, bool)
    cut[flat.offsets] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | cut[1:-1]
    last[:-1] &= ~inside[1:] | cut[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    place = np.arange(n + 1)
    # the first good byte from each place on, and the end of the last one before it
    onward = np.minimum.accumulate(np.where(np.append(_FIRST[flat.data], True), place, n)[::-1])[::-1]
    before = np.maximum.accumulate(np.where(np.append(False, _LAST[flat.data]), place, 0))
    start, end = onward[start], before[end]
    good = start < end
    start, end = start[good], end[good]
    doc = np.searchsorted(flat.offsets, start, "right") - 1
    spot = np.arange(len(start)) + 2 + 4 * doc
    size = len(start) + 4 * flat.n

    def padded(x: np.ndarray, fill) -> np.ndarray:
        out = np.full(size, fill, x.dtype)
        out[spot] = x
        return out

    digits = np.concatenate(([0], np.cumsum(_IS_DIGIT[flat.data])))
    at = np.searchsorted(start, flat.offsets) + 4 * np.arange(flat.n + 1)
    return Tokens(
        padded(start, -1),
        padded(end, -1),
        padded(np.ones(len(start), bool), False),
        padded(digits[end] > digits[start], False),
        padded(tk.range_hashes(_MASKED[flat.data], start, end, True), _EDGE),
        padded(tk.range_hashes(flat.data, start, end, True), _EDGE),
        at,
    )


def patterns_of(t: Tokens, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The patterns of the spans of places ``i .. j - 1``: two words to the left, two words
    to the right, and one on each side; what they leave out is free."""
    c = t.context
    pairs = ((c[i - 2], c[i - 1]), (c[j], c[j + 1]), (c[i - 1], c[j]))
    return tuple(tk.mix((tk.mix(x * _STEP + tag)) * _STEP + y) for (x, y), tag in zip(pairs, _TAGS))


def _onward(h: np.ndarray, token: np.ndarray, k: int) -> np.ndarray:
    """The hash of a value with its token number k added."""
    return tk.mix(h * _STEP + token + U64(k + 1))


def values_of(t: Tokens, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """A hash of each span's tokens in lower case."""
    h = np.zeros(len(i), U64)
    for k in range(int((j - i).max(initial=0))):
        live = i + k < j
        h = np.where(live, _onward(h, t.value[np.where(live, i + k, 0)], k), h)
    return h


class Members(NamedTuple):
    """A set of hashes with a small table that turns most others away."""

    sorted: np.ndarray
    table: np.ndarray


def members(keys: np.ndarray) -> Members:
    table = np.zeros(1 << max(16, (8 * len(keys)).bit_length()), bool)
    table[keys & U64(len(table) - 1)] = True
    return Members(keys, table)


def held(m: Members, h: np.ndarray) -> np.ndarray:
    """The places of ``h`` whose hash is in the set."""
    spots = np.flatnonzero(m.table[h & U64(len(m.table) - 1)])
    at = np.searchsorted(m.sorted, h[spots])
    return spots[(at < len(m.sorted)) & (m.sorted[np.minimum(at, len(m.sorted) - 1)] == h[spots])]


def _sign_starts(flat: tk.Flat) -> np.ndarray:
    """The byte at which each code point begins, and the end."""
    return np.append(np.flatnonzero(flat.data & 0xC0 != 0x80), len(flat.data))


def _seed_places(t: Tokens, flat: tk.Flat, texts: list[str], docs) -> tuple[np.ndarray, np.ndarray]:
    """First and last-but-one places of the tokens of the fixed patterns' spans in ``docs``."""
    i, j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    starts = _sign_starts(flat)
    for d in docs:
        spans = np.array([x[1:] for x in base_spans(texts[d])], np.int64)
        if len(spans):
            lo, hi = t.at[d] + 2, t.at[d + 1] - 2
            x, y = starts[np.searchsorted(starts, flat.offsets[d]) + spans.T]
            p, q = lo + np.searchsorted(t.end[lo:hi], x, "right"), lo + np.searchsorted(t.start[lo:hi], y, "left")
            i.append(p[p < q])
            j.append(q[p < q])
    return np.concatenate(i), np.concatenate(j)


def _hit_spans(t: Tokens, flat: tk.Flat, texts: list[str], m: Members) -> tuple[np.ndarray, ...]:
    """(pattern, i, j, seed) of what stands in a pattern of the set: whole seeds, and spans
    that touch no seed.

    Where one side is free, the span is the run of tokens with digits that begins or ends
    there, else the one token; between two words it is all that stands there, up to SPAN.
    """
    real = np.flatnonzero(t.real)
    left, right, _ = patterns_of(t, real, real + 1)
    k, e = held(m, left), held(m, right)
    left, i, right, e = left[k], real[k], right[e], real[e]
    between = []
    spots = real
    for size in range(1, SPAN + 1):
        spots = spots[t.real[spots + size - 1]]
        both = patterns_of(t, spots, spots + size)[2]
        k = held(m, both)
        between.append((both[k], spots[k], spots[k] + size))
    docs = np.unique(np.searchsorted(t.at, np.concatenate([i, e, *(x[1] for x in between)]), "right") - 1)
    a, b = _seed_places(t, flat, texts, docs.tolist())
    ends = np.zeros(len(t.real) + 1, np.int64)
    np.add.at(ends, a, 1)
    np.add.at(ends, b, -1)
    taken = np.cumsum(ends[:-1]) > 0
    place = np.arange(len(taken))
    run = t.real & t.digit & ~taken
    run_end = np.minimum.accumulate(np.where(run, len(run), place)[::-1])[::-1]
    run_start = np.maximum.accumulate(np.where(run, -1, place)) + 1
    spans = [(left, i, np.where(run[i], run_end[i], i + 1)), (right, np.where(run[e], run_start[e], e), e + 1), *between]
    key, i, j = (np.concatenate(x) for x in zip(*spans))
    before = np.concatenate(([0], np.cumsum(taken)))
    free = before[i] == before[j]
    whole = [(key[free], i[free], j[free])]
    for p in patterns_of(t, a, b):
        k = held(m, p)
        whole.append((p[k], a[k], b[k]))
    key, i, j = (np.concatenate(x) for x in zip(*whole))
    return key, i, j, np.arange(len(key)) >= int(free.sum())


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[tk.Flat, list[str]]]:
    for flat in tk.chunks(b.column("text")):
        yield flat, [x or "" for x in b.column("text").slice(flat.first, flat.n).to_pylist()]


_EDGES = "pattern long, value long, seed boolean"


def _edges(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Distinct rows; hashes are stored as signed numbers."""
    p, v, s = (np.concatenate(x) for x in zip(*rows)) if rows else (np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, bool))
    order = np.lexsort((s, v, p))
    p, v, s = p[order], v[order], s[order]
    new = np.ones(len(p), bool)
    new[1:] = (p[1:] != p[:-1]) | (v[1:] != v[:-1]) | (s[1:] != s[:-1])
    return pa.RecordBatch.from_arrays([pa.array(p[new].view(np.int64)), pa.array(v[new].view(np.int64)), pa.array(s[new])], ["pattern", "value", "seed"])


def _seed_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for flat, texts in _pieces(b):
            t = tokens(flat)
            i, j = _seed_places(t, flat, texts, range(flat.n))
            v = values_of(t, i, j)
            rows += [(p, v, np.ones(len(v), bool)) for p in patterns_of(t, i, j)]
        yield _edges(rows)


def _contexts(values):
    """The patterns that the values of a broadcast set stand in, wherever they stand."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = members(values.value)
        for b in batches:
            rows = []
            for flat in tk.chunks(b.column("text")):
                t = tokens(flat)
                spots = np.flatnonzero(t.real)
                h = np.zeros(len(spots), U64)
                for k in range(SPAN):
                    inside = t.real[spots + k]
                    spots, h = spots[inside], h[inside]
                    h = _onward(h, t.value[spots + k], k)
                    hit = held(m, h)
                    rows += [(p, h[hit], np.zeros(len(hit), bool)) for p in patterns_of(t, spots[hit], spots[hit] + k + 1)]
            yield _edges(rows)

    return run


def _instances(patterns, sampled: bool = False):
    """All distinct instances of the patterns of a broadcast set, or of a SAMPLE-th of all values."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = members(patterns.value)
        for b in batches:
            rows = []
            for flat, texts in _pieces(b):
                t = tokens(flat)
                key, i, j, seed = _hit_spans(t, flat, texts, m)
                v = values_of(t, i, j)
                own = v % U64(SAMPLE) == 0 if sampled else slice(None)
                rows.append((key[own], v[own], seed[own]))
            yield _edges(rows)

    return run


def _report(patterns):
    """The result rows, with what stands in a pattern of the broadcast set as ``found``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = members(patterns.value)
        for b in batches:
            counts: list[list[int]] = [[], [], [], [], []]
            sums, spans = [], []
            for flat, texts in _pieces(b):
                starts = _sign_starts(flat)
                more: dict[int, list[tuple[int, int]]] = {}
                if len(m.sorted):
                    t = tokens(flat)
                    _, i, j, seed = _hit_spans(t, flat, texts, m)
                    for x, y in zip(i[~seed].tolist(), j[~seed].tolist()):
                        more.setdefault(int(np.searchsorted(t.at, x, "right")) - 1, []).append((int(t.start[x]), int(t.end[y - 1])))
                for d, text in enumerate(texts):
                    base = sorted(base_spans(text))
                    for k in range(4):
                        counts[k].append(sum(x[0] == k for x in base))
                    joined = ",".join(f"{KINDS[k]}:{x}:{y}" for k, x, y in base)
                    sums.append(hashlib.sha256(joined.encode()).hexdigest())
                    found: list[list[int]] = []
                    for x, y in sorted(set(more.get(d, ()))):  # spans that overlap are one
                        if found and x < found[-1][1]:
                            found[-1][1] = max(found[-1][1], y)
                        else:
                            found.append([x, y])
                    counts[4].append(len(found))
                    if found:
                        found = (np.searchsorted(starts, found) - np.searchsorted(starts, flat.offsets[d])).tolist()
                    spans.append(",".join([joined] * bool(joined) + [f"found:{x}:{y}" for x, y in found]))
            n = [pa.array(c, pa.int64()) for c in counts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *n[:4], pa.array(sums, pa.string()), pa.array(spans, pa.string()), n[4], pa.array(np.sum(counts, axis=0), pa.int64())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_found", "n_spans"])

    return run


def _hashes(df: DataFrame) -> np.ndarray:
    """The one column of hashes, sorted, on the driver: eight bytes each."""
    return np.sort(df.toArrow().column(0).to_numpy().astype(np.int64).view(U64))


def _supported(contexts: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(pattern, distinct known values) of the patterns that hold at least ``least``."""
    t = contexts.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= least).toArrow()
    keys, n = t.column("pattern").to_numpy().astype(np.int64).view(U64), t.column("n").to_numpy()
    order = np.argsort(keys)
    return keys[order], n[order]


def _sample_counts(texts: DataFrame, patterns: np.ndarray) -> np.ndarray:
    """Distinct instances of each pattern among a SAMPLE-th of all values."""
    out = np.zeros(len(patterns), np.int64)
    if len(patterns):
        some = arrow(texts, _instances(texts.sparkSession.sparkContext.broadcast(patterns), True), _EDGES)
        t = some.select("pattern", "value").distinct().groupBy("pattern").agg(F.count("*").alias("n")).toArrow()
        out[np.searchsorted(patterns, t.column("pattern").to_numpy().astype(np.int64).view(U64))] = t.column("n").to_numpy()
    return out


def _hopeful(known: np.ndarray, sample: np.ndarray) -> np.ndarray:
    """False where the sample shows, six deviations clear, that known values are less than
    SHARE of a pattern's instances: reading them all could but confirm it."""
    most = known / SHARE / SAMPLE
    return sample <= most + 6 * np.sqrt(most) + 6


def _scored(edges: DataFrame, scores: DataFrame | None) -> DataFrame:
    """``edges`` with the score of each value: 1 for seeds, else what the last turn gave."""
    if scores is None:
        return edges.withColumn("score", F.col("seed").cast("double"))
    score = F.when(F.col("seed"), F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return edges.join(scores, "value", "left").withColumn("score", score).drop("best")


def score_patterns(scored: DataFrame, confident: float, least: int) -> DataFrame:
    """(pattern, confidence) from ``scored(pattern, value, seed, score)``, which has a row for
    each pattern and value.

    Known instances are seeds and those that an earlier turn scored ``confident``; a pattern
    needs ``least`` of them, and SHARE of all its instances.  The aggregates by pattern and
    by value are combined map-side and AQE splits skewed joins, so neither a pattern nor a
    value that holds a third of the edges meets in one task.
    """
    p = scored.groupBy("pattern").agg(F.sum("score").alias("s"), F.count("*").alias("n"), F.sum((F.col("score") >= confident).cast("long")).alias("known"))
    return p.where((F.col("known") >= least) & (F.col("known") >= F.lit(SHARE) * F.col("n"))).select("pattern", (F.col("s") / (F.col("n") + F.lit(DAMP))).alias("confidence"))


def scan_pii(docs: DataFrame, *, turns: int = TURNS, confident: float = CONFIDENT, min_seeds: int = SEEDS) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found, n_spans) for each row.

    ``n_spans`` counts all spans: where it is above 0 the text holds personal data.
    Spans are ``kind:start:end`` by kind (in the order of KINDS), then start.
    """
    if turns < 1:
        raise ValueError("turns must be at least 1")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    only, share = texts.select("text"), docs.sparkSession.sparkContext.broadcast
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_found long, n_spans long"
    seeds = stored(arrow(only, _seed_contexts, _EDGES).distinct())
    contexts, edges, scores, good = seeds, None, None, None
    promoted, seen, read = (np.zeros(0, U64) for _ in range(3))
    sample = np.zeros(0, np.int64)
    for turn in range(turns):
        if turn:
            more = _hashes(scores.where(F.col("best") >= confident).select("value"))
            if len(more) and not np.array_equal(more, promoted):
                where = arrow(only, _contexts(share(more)), _EDGES).select("pattern", "value")
                contexts = stored(seeds.select("pattern", "value").union(where).distinct())
            promoted = more
        patterns, known = _supported(contexts, min_seeds)
        # only patterns that no earlier turn met are sampled, and only those not yet read are read
        new = np.setdiff1d(patterns, seen)
        sample = np.concatenate((sample, _sample_counts(only, new)))
        seen = np.concatenate((seen, new))
        order = np.argsort(seen)
        seen, sample = seen[order], sample[order]
        live = np.setdiff1d(patterns[_hopeful(known, sample[np.searchsorted(seen, patterns)])], read)
        if len(live):
            found = arrow(only, _instances(share(live)), _EDGES)
            # a value that is a seed anywhere is a seed
            found = stored(found.groupBy("pattern", "value").agg(F.max("seed").alias("seed")))
            edges, read = found if edges is None else edges.union(found), np.concatenate((read, live))
        if edges is None:
            break
        good = stored(score_patterns(_scored(edges, scores), confident, min_seeds))
        scores = stored(edges.join(good, "pattern").where("not seed").groupBy("value").agg(F.max("confidence").alias("best")))
    keys = np.zeros(0, U64) if good is None else _hashes(good.where(F.col("confidence") >= confident).select("pattern"))
    return arrow(texts, _report(share(keys)), schema)
