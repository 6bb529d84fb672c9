"""Benchmark decontamination by spaced-seed hashing.

A seed is a mask over a window of words: marked places are hashed, the others ignored, so
a window still hits when words at ignored places were changed.  The seed hashes of the
benchmark items and those of the documents are joined; around each hit the item and the
document are aligned on the hit's diagonal.  The best stretch (a match counts 1, a changed
word -2) must hold enough equal words.

Equal items are one item, known by the least id.  A Bloom filter of the items' seed hashes,
at most 2**FILTER_BITS bits, turns documents' windows away before the join; a benchmark that
outgrows it lets more windows pass, and none is lost.  The join is by seed hash; one that very
many documents hold is salted.  A hit only names a pair of document and item: places are
not paired, so words that repeat thousands of times on both sides cost no more than the diagonals
of the two texts.

Nulls and empties: a null or empty text, on either side, matches nothing.  An item with
fewer words than the narrowest seed is indexed as a whole and must occur whole.  Repeated
rows are judged alike.  A null item_id is kept where no equal item has an id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import textkernel as tk
from termloom.llm.storage import arrow, stored

U64 = np.uint64
#: Six masks of weight 6.  Of overlaps of ten equal words, these find all with up to two changed
#: words among them, wherever these stand, and all but one of the 286 placements of three.
MASKS = ("111111", "11101000011", "1110001011", "1101111", "100111011", "11010111")
#: An overlap needs so many equal words, or all words of a shorter item.
MIN_EQUAL = 10
#: Bits of the filter for each seed hash, hashes of the filter, and its largest size (32 MB).
HASH_BITS, PROBES, FILTER_BITS = 32, 6, 28
#: Documents of one seed hash that meet its items in one task, about.
SALT_ROWS = 100_000
#: Rows of small tables that are sent to all executors; beyond it they are joined by a shuffle.
BROADCAST_ROWS = 1_000_000
_NARROW = min(map(len, MASKS))


def _windows(h: np.ndarray, at: np.ndarray, mask: str, number: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, first word) of every window of the mask that lies in one document."""
    span = len(mask)
    first = np.arange(max(0, len(h) - span + 1))
    doc_end = np.repeat(at[1:], np.diff(at))
    first = first[first + span <= doc_end[: len(first)]]
    x = np.full(len(first), number + 1, U64)
    for k in (k for k, c in enumerate(mask) if c == "1"):
        x = tk.mix(x * U64(0x9FB21C651E98DF25) + h[first + k])
    return x, first


def _probes(sizes: tuple[int, ...]) -> list[tuple[str, int]]:
    """The masks, and one that covers a whole item for each size of short items."""
    return [(mask, k) for k, mask in enumerate(MASKS)] + [("1" * size, 999 + size) for size in sizes]


def _keys(h: np.ndarray, size: int) -> np.ndarray:
    """The distinct seed hashes of an item."""
    at = np.array([0, size])
    probes = _probes(()) if size >= _NARROW else _probes((size,))[len(MASKS) :]
    return np.unique(np.concatenate([_windows(h, at, *p)[0] for p in probes]))


def diagonals(doc: np.ndarray, item: np.ndarray) -> np.ndarray:
    """The offsets of ``doc`` against ``item`` on which a seed hits.

    Places are paired while they are few; where words repeat so often that the pairs outnumber
    the diagonals, each diagonal is asked instead.  Both give the same.
    """
    n, m = len(doc), len(item)
    if m < _NARROW:
        whole = np.ones(max(0, n - m + 1), bool)
        for k in range(m):
            whole &= doc[k : k + len(whole)] == item[k]
        return np.flatnonzero(whole)
    found = []
    for k, mask in enumerate(MASKS):
        x, a = _windows(doc, np.array([0, n]), mask, k)
        y, b = _windows(item, np.array([0, m]), mask, k)
        order = np.argsort(y, kind="stable")
        y, b = y[order], b[order]
        lo, hi = np.searchsorted(y, x, "left"), np.searchsorted(y, x, "right")
        many = hi - lo
        if many.sum() > 4 * (n + m):
            return np.array([g for g in range(1 - m, n) if _seeded(_same(doc, item, g)[0])], np.int64)
        entry = np.repeat(lo, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        found.append(np.repeat(a, many) - b[entry])
    return np.unique(np.concatenate(found))


def _same(doc: np.ndarray, item: np.ndarray, g: int) -> tuple[np.ndarray, int]:
    """Which words of the diagonal are equal, and the item's word that it begins at."""
    lo, hi = max(0, -g), min(len(item), len(doc) - g)
    return doc[lo + g : hi + g] == item[lo:hi], lo


def _seeded(same: np.ndarray) -> bool:
    if int(same.sum()) < 6:
        return False
    for mask in MASKS:
        n = len(same) - len(mask) + 1
        if n > 0:
            hit = np.ones(n, bool)
            for k in (k for k, c in enumerate(mask) if c == "1"):
                hit &= same[k : k + n]
            if hit.any():
                return True
    return False


def best_overlap(doc: np.ndarray, item: np.ndarray, min_equal: int) -> tuple[int, int, int] | None:
    """(equal words, first word in the document, words) of the best stretch of all diagonals."""
    best = None
    for g in diagonals(doc, item).tolist():
        same, lo = _same(doc, item, g)
        score = np.concatenate(([0], np.cumsum(np.where(same, 1, -2))))
        least = np.minimum.accumulate(score)
        end = int((score - least).argmax())
        begin = int(np.flatnonzero(score[: end + 1] == least[end])[-1])
        equal = int(same[begin:end].sum())
        if equal >= min(min_equal, len(item)):
            best = max(best or (0, 0, 0), (equal, lo + g + begin, end - begin))
    return best


def _itemized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for flat in tk.chunks(b.column("text")):
            w = tk.words(flat)
            h = tk.word_hashes(flat, w)
            rows = []
            for d in range(flat.n):
                own = h[w.at[d] : w.at[d + 1]]
                if len(own):
                    # the sequence's print: each word's hash with its place
                    place = tk.mix(own + np.arange(len(own), dtype=U64) * U64(0xD1342543DE82EF95))
                    p1, p2 = tk.mix(place).sum(), tk.mix(place ^ U64(0x5851F42D4C957F2D)).sum()
                    rows.append((b.column("item_id")[flat.first + d].as_py(), len(own), int(p1.view(np.int64)), int(p2.view(np.int64)), own.tobytes()))
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["item_id", "item_words", "i1", "i2", "item"])


def _item_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i1, i2, raw in zip(b.column("i1"), b.column("i2"), b.column("item")):
            h = np.frombuffer(raw.as_buffer(), U64)
            keys = _keys(h, len(h)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.full(len(keys), i1.as_py())), pa.array(np.full(len(keys), i2.as_py()))], ["key", "i1", "i2"])


def _bits(bits: int, probe: int) -> int:
    """The right shift that takes a probe's bits from a hash."""
    return round(probe * (64 - bits) / (PROBES - 1))


def _filter(seeds: DataFrame) -> tuple[int, np.ndarray]:
    """(bits, words) of the Bloom filter of all seed hashes; the driver gets its non-zero words."""
    n = seeds.count()
    bits = min(FILTER_BITS, max(12, math.ceil(math.log2(max(1, n) * HASH_BITS))))
    places = F.array(*(F.shiftrightunsigned("key", _bits(bits, k)).bitwiseAND(F.lit((1 << bits) - 1)) for k in range(PROBES)))
    set_ = seeds.select(F.explode(places).alias("p")).select(F.shiftrightunsigned("p", 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("p").bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    t = set_.groupBy("word").agg(F.bit_or("bit").alias("bit")).toArrow()
    words = np.zeros(1 << (bits - 6), U64)
    words[t.column("word").to_numpy()] = t.column("bit").to_numpy().view(U64)
    return bits, words


def _candidates(shared, bits: int, sizes: tuple[int, ...]):
    """Rows that hold a hash which may be an item's: their keys and their words' hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shared.value
        for b in batches:
            for flat in tk.chunks(b.column("text")):
                w = tk.words(flat)
                h = tk.word_hashes(flat, w)
                keys, docs = [], []
                for probe in _probes(sizes):
                    x, first = _windows(h, w.at, *probe)
                    for k in range(PROBES):
                        p = (x >> U64(_bits(bits, k))) & U64((1 << bits) - 1)
                        near = (words[p >> U64(6)] >> (p & U64(63))) & U64(1) > 0
                        x, first = x[near], first[near]
                    keys.append(x)
                    docs.append(np.searchsorted(w.at, first, "right") - 1)
                x, d = np.concatenate(keys), np.concatenate(docs)
                order = np.lexsort((x, d))
                x, d = x[order], d[order]
                new = np.ones(len(x), bool)
                new[1:] = (x[1:] != x[:-1]) | (d[1:] != d[:-1])
                x, d = x[new], d[new]
                own, at = np.unique(d, return_index=True)
                if not len(own):
                    continue
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(x)).astype(np.int32)), pa.array(x.view(np.int64)))
                raw = pa.array([h[w.at[k] : w.at[k + 1]].tobytes() for k in own.tolist()], pa.binary())
                part = b.slice(flat.first, flat.n).take(pa.array(own))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "h1", "h2")), lists, raw], ["doc_id", "h1", "h2", "keys", "words"])

    return run


def _verify(min_equal: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            best = [best_overlap(np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64), min_equal) for x, y in zip(b.column("words"), b.column("item"))]
            hit = [k for k, v in enumerate(best) if v]
            if hit:
                part = b.take(pa.array(hit))
                values = [pa.array(c, pa.int64()) for c in zip(*(best[k] for k in hit))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("rid", "i1", "i2")), *values], ["rid", "i1", "i2", "n_equal", "first_word", "n_words"])

    return run


def _small(df: DataFrame) -> DataFrame:
    """``df``, stored, to be broadcast if it has few rows."""
    df = stored(df)
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _found(docs: DataFrame, benchmark: DataFrame, min_equal: int) -> DataFrame | None:
    """(doc_id, h1, h2, item_id, n_items, n_equal, first_word, n_words, item_words); ``h1`` and ``h2`` are hashes
    of the row's text.  None if no item has a word."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    items = arrow(items, _itemized, "item_id long, item_words long, i1 long, i2 long, item binary")
    items = stored(items.groupBy("item_words", "i1", "i2").agg(F.min("item_id").alias("item_id"), F.count("*").alias("n_items"), F.first("item").alias("item")))
    sizes = tuple(sorted(r[0] for r in items.where(F.col("item_words") < _NARROW).select("item_words").distinct().collect()))  # at most five
    seeds = stored(arrow(items.select("i1", "i2", "item"), _item_keys, "key long, i1 long, i2 long"))
    bits, words = _filter(seeds)
    if not words.any():
        return None
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("h1"), F.xxhash64(F.lit(17), text).alias("h2"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(words)
    held = arrow(rows, _candidates(shared, bits, sizes), "doc_id long, h1 long, h2 long, keys array<long>, words binary")
    held = stored(held.withColumn("rid", F.monotonically_increasing_id()))

    # seed hashes joined; those of very many documents in as many parts as they need
    keys = held.select("rid", F.explode("keys").alias("key"))
    hot = _small(keys.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > SALT_ROWS).select("key", F.ceil(F.col("n") / SALT_ROWS).cast("long").alias("parts")))
    parts = F.coalesce("parts", F.lit(1).cast("long"))
    left = keys.join(hot, "key", "left").select("rid", "key", F.pmod(F.xxhash64("rid"), parts).alias("salt"))
    right = seeds.join(hot, "key", "left").select("key", "i1", "i2", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)).alias("salt"))
    pairs = left.join(right, ["key", "salt"]).select("rid", "i1", "i2").distinct()
    both = pairs.join(held.select("rid", "words"), "rid").join(items.select("i1", "i2", "item"), ["i1", "i2"])
    seen = arrow(both.select("rid", "i1", "i2", "words", "item"), _verify(min_equal), "rid long, i1 long, i2 long, n_equal long, first_word long, n_words long")
    return stored(seen).join(held.select("rid", "doc_id", "h1", "h2"), "rid").join(items.drop("item"), ["i1", "i2"])


_SCHEMA = "doc_id long, item_id long, n_equal long, first_word long, n_words long, item_words long, n_items long"


def overlaps(docs: DataFrame, benchmark: DataFrame, *, min_equal: int = MIN_EQUAL) -> DataFrame:
    """(doc_id, item_id, n_equal, first_word, n_words, item_words, n_items): a row for each row
    of ``docs`` and distinct item with a verified overlap; the best stretch of the pair is given.
    ``item_id`` is the least of the ``n_items`` equal items."""
    found = _found(docs, benchmark, min_equal)
    if found is None:
        return docs.sparkSession.createDataFrame([], _SCHEMA)
    return found.select("doc_id", "item_id", "n_equal", "first_word", "n_words", "item_words", "n_items")


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, *, min_equal: int = MIN_EQUAL) -> DataFrame:
    """``docs`` without the rows that overlap an item, its columns unchanged."""
    found = _found(docs, benchmark, min_equal)
    if found is None:
        return docs
    bad = _small(found.select(F.col("doc_id").alias("d"), "h1", "h2").distinct())
    packed = docs.select(F.struct("*").alias("r"))
    text = F.coalesce(F.col("r.text").cast("string"), F.lit(""))
    same = F.col("r.doc_id").cast("long").eqNullSafe(F.col("d")) & (F.xxhash64(text) == F.col("h1")) & (F.xxhash64(F.lit(17), text) == F.col("h2"))
    return packed.join(bad, same, "left_anti").select("r.*")
