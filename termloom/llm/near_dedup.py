"""MinHash near-duplicate detection with SuperMinHash signatures.

Documents become sets of word shingles.  SuperMinHash (Ertl 2017) gives element i,
in step j, the rank ``j + r`` at the j-th place of its own random permutation, so
signature slots are filled without replacement: estimates have less variance than
independent hashes, and a document stops as soon as no later step can lower a slot.
Signatures are cut into bands; documents that share a band are candidates, every
link is confirmed on the full sets, and links are grouped by connected components.

No group is expanded into all of its pairs:
  1. equal sets are folded to one representative by an aggregate;
  2. each bucket links its members to its least one only (a star);
  3. the members of buckets that then still span several components are joined between
     components by prefix filter, which is exact: with all sets in one order, rare elements first, two
     sets can only link if the first seventh or so of the smaller one meets the first quarter of the
     larger one.  Documents that share a template but no link differ in their rare
     elements, so that they meet nowhere, however many they are.
Every pair that shares a bucket and links is thus in one component.  The order is that of
element counts in a table of ORDER_SLOTS; any order is exact, a truer one is faster.

Nulls and empties: a document without words, or a null text, has an empty set, links
with nothing and forms its own component.  Rows that repeat a doc_id are one document: they
share its component, whatever their texts.  A row with a null doc_id links with nothing and
has a null component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import textkernel as tk
from termloom.llm.components import components
from termloom.llm.storage import arrow, release, stored

U64 = np.uint64
#: Bands x rows.  At similarity 0.75 a pair misses every band with probability
#: (1 - 0.75**5)**40 = 2e-5.
BANDS, ROWS = 40, 5
#: Ids below this number are sent to all executors (8 bytes each); above it the texts
#: are joined by a shuffle instead.
BROADCAST_IDS = 500_000
#: Counters of elements (8 bytes each, sent to all executors) that order the elements of sets.
ORDER_SLOTS = 1 << 20


def super_minhash(elements: np.ndarray, at: np.ndarray, slots: int) -> np.ndarray:
    """Signatures (documents x slots, uint64) of the sets ``elements[at[d]:at[d+1]]``.

    A slot holds ``step << 32 | rank``.  Exactly the sequential algorithm, carried out
    one permutation step at a time for all elements of all documents.
    """
    n = len(at) - 1
    sig = np.full(n * slots, np.iinfo(U64).max, U64)
    doc = np.repeat(np.arange(n), np.diff(at))
    elements = elements.copy()
    perm = None
    for j in range(slots):
        if not len(elements):
            break
        x = tk.mix(elements + U64((j + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        k = (j + (((x & U64(0xFFFFFFFF)) * U64(slots - j)) >> U64(32)).astype(np.int64)).astype(np.int64)
        if j == 0:
            place = k
        else:
            if perm is None:  # the first swap, made only where a second step is needed
                perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(elements), 1))
                perm[np.arange(len(elements)), first] = 0
            rows = np.arange(len(elements))
            place = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(sig, doc * slots + place, (U64(j) << U64(32)) | (x >> U64(32)))
        done = sig.reshape(n, slots).max(1) < (U64(j + 1) << U64(32))
        live = ~done[doc]
        elements, doc, first = elements[live], doc[live], place[live] if j == 0 else None
        if perm is not None:
            perm = perm[live]
    return sig.reshape(n, slots)


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit hash for each band, different between bands."""
    h = np.broadcast_to(np.arange(1, bands + 1, dtype=U64) * U64(0xC2B2AE3D27D4EB4F), (len(sig), bands))
    for r in range(rows):
        h = tk.mix(h * U64(0x9FB21C651E98DF25) + sig[:, r : bands * rows : rows])
    return h


def _sets(column: pa.Array, size: int) -> Iterator[tuple[tk.Flat, np.ndarray, np.ndarray]]:
    for flat in tk.chunks(column):
        w = tk.words(flat)
        yield flat, *tk.distinct_sorted(*tk.shingles(tk.word_hashes(flat, w), w.at, size))


def _prints(elements: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each set."""
    sums = np.concatenate((np.zeros(1, U64), np.cumsum(tk.mix(elements))))
    sums2 = np.concatenate((np.zeros(1, U64), np.cumsum(tk.mix(elements ^ U64(0x5851F42D4C957F2D)))))
    return tk.mix((sums[at[1:]] - sums[at[:-1]]) + np.diff(at).astype(U64)), sums2[at[1:]] - sums2[at[:-1]]


def _sketch(size: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for flat, elements, at in _sets(b.column("text"), size):
                fp1, fp2 = _prints(elements, at)
                bands_ = np.ascontiguousarray(band_hashes(super_minhash(elements, at, bands * rows), bands, rows)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("doc_id").slice(flat.first, flat.n),
                        pa.array(np.diff(at), pa.int64()),
                        pa.array(fp1.view(np.int64)),
                        pa.array(fp2.view(np.int64)),
                        pa.FixedSizeListArray.from_arrays(pa.array(bands_.ravel()), bands).cast(pa.list_(pa.int64())),
                    ],
                    ["doc_id", "n_shingles", "fp1", "fp2", "bands"],
                )

    return run


def _full_sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for flat, elements, at in _sets(b.column("text"), size):
                lists = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(elements.view(np.int64)))
                print_ = pa.array(_prints(elements, at)[0].view(np.int64))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(flat.first, flat.n), print_, lists], ["id", "f", "elements"])

    return run


def _sets_of(ids: DataFrame, texts: DataFrame, size: int) -> DataFrame:
    """(id, f, elements) of the sets ``ids(id, f)``; ``f`` tells texts with one doc_id apart."""
    ids = stored(ids.distinct())
    narrow = F.broadcast(ids.select("id").distinct()) if ids.count() <= BROADCAST_IDS else ids.select("id").distinct()
    wanted = texts.join(narrow, texts["doc_id"] == narrow["id"], "left_semi")
    out = stored(arrow(wanted, _full_sets(size), "id long, f long, elements array<long>").dropDuplicates(["id", "f"]))
    release(ids)
    return out


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of ``pairs(a, fa, b, fb)`` whose full sets meet the threshold."""
    both = (
        pairs.join(sets.select(F.col("id").alias("b"), F.col("f").alias("fb"), F.col("elements").alias("eb")), ["b", "fb"])
        .join(sets.select(F.col("id").alias("a"), F.col("f").alias("fa"), F.col("elements").alias("ea")), ["a", "fa"])
        .withColumn("i", F.size(F.array_intersect("ea", "eb")).cast("long"))
    )
    return both.where(F.lit(100) * F.col("i") >= F.lit(percent) * (F.size("ea") + F.size("eb") - F.col("i"))).select("a", "b")


def _could_link(x: str, y: str, percent: int):
    return F.lit(100) * F.least(x, y) >= F.lit(percent) * F.greatest(x, y)


def _prefixes(order, percent: int):
    """The first elements of each set, rare ones first: (id, f, n, element, place, small), with
    ``small`` where the element belongs to the shorter prefix that the smaller set of a pair needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order.value
        for b in batches:
            lists = b.column("elements")
            at = lists.offsets.to_numpy().astype(np.int64)
            at, e = at - at[0], lists.flatten().to_numpy(zero_copy_only=False).view(U64)
            n = np.diff(at)
            doc = np.repeat(np.arange(len(n)), n)
            turn = np.lexsort((e, counts[e & U64(len(counts) - 1)], doc))
            place = np.arange(len(e)) - at[doc]
            # a link needs percent of the larger set, and 2 percent / (100 + percent) of both if they are equal
            least, half = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
            keep = place < (n - least + 1)[doc]
            small = place < (n - half + 1)[doc]
            own = pa.array(doc[keep])
            yield pa.RecordBatch.from_arrays(
                [b.column("id").take(own), b.column("f").take(own), pa.array(n[doc][keep]), pa.array(e[turn][keep].view(np.int64)), pa.array(place[keep]), pa.array(small[keep])],
                ["id", "f", "n", "element", "place", "small"],
            )

    return run


def prefix_pairs(sets: DataFrame, parts: DataFrame, percent: int) -> DataFrame:
    """(a, fa, b, fb): every pair of ``sets`` of different parts whose Jaccard similarity may
    reach ``percent``, and few others.  ``parts(id, part)`` has a row for each id."""
    slot = F.col("e").bitwiseAND(F.lit(ORDER_SLOTS - 1)).alias("slot")
    t = sets.select(F.explode("elements").alias("e")).groupBy(slot).agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(ORDER_SLOTS, np.int64)
    counts[t.column("slot").to_numpy()] = t.column("n").to_numpy()
    shared = sets.sparkSession.sparkContext.broadcast(counts)
    first = stored(arrow(sets, _prefixes(shared, percent), "id long, f long, n long, element long, place long, small boolean").join(parts, "id"))
    x, y = first.where("small").alias("x"), first.alias("y")
    smaller = F.struct("x.n", "x.id", "x.f") < F.struct("y.n", "y.id", "y.f")
    # what may still be common after these places
    most = F.least(F.col("x.n") - F.col("x.place"), F.col("y.n") - F.col("y.place"))
    enough = F.lit(100 + percent) * most >= F.lit(percent) * (F.col("x.n") + F.col("y.n"))
    on = (F.col("x.element") == F.col("y.element")) & (F.col("x.part") != F.col("y.part")) & smaller & _could_link("x.n", "y.n", percent) & enough
    return x.join(y, on).select(F.col("x.id").alias("a"), F.col("x.f").alias("fa"), F.col("y.id").alias("b"), F.col("y.f").alias("fb")).distinct()


def near_duplicates(docs: DataFrame, *, shingle_words: int = 2, percent: int = 75, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    ``docs`` needs ``doc_id`` (integer) and ``text``; other columns are ignored.
    Two documents link when ``100 * |A & B| >= percent * |A | B|``.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = stored(arrow(texts, _sketch(shingle_words, bands, rows), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<long>"))

    # 1. equal sets fold to their least id
    filled = sketch.where("n_shingles > 0 and doc_id is not null")
    folded = stored(filled.groupBy("n_shingles", "fp1", "fp2").agg(F.min("doc_id").alias("rep"), F.min_by("bands", "doc_id").alias("bands")))

    # 2. stars: each member of a bucket with its least member
    rowsets = folded.select(F.col("rep").alias("id"), F.col("fp1").alias("f"), F.col("n_shingles").alias("n"), F.explode("bands").alias("bucket"))
    heads = rowsets.groupBy("bucket").agg(F.min(F.struct("id", "f", "n")).alias("h"), F.count("*").alias("m")).where("m > 1")
    members = stored(rowsets.join(heads, "bucket").select("bucket", "id", "f", "n", "m", "h", ((F.col("id") == F.col("h.id")) & (F.col("f") == F.col("h.f"))).alias("first")))
    stars = members.where(~F.col("first") & _could_link("n", "h.n", percent)).select(F.col("h.id").alias("a"), F.col("h.f").alias("fa"), F.col("id").alias("b"), F.col("f").alias("fb"))
    stars = stored(stars.distinct())
    ends = stars.select(F.col("a").alias("id"), F.col("fa").alias("f")).unionAll(stars.select("b", "fb"))
    sets = _sets_of(ends, texts, shingle_words)
    links = stored(_confirmed(stars, sets, percent))
    release(stars, sets)
    parts = stored(components(links))
    release(links)

    # 3. buckets that still span components: pairs between these, not within them
    placed = members.where("m > 2").join(parts, "id", "left").select("bucket", "id", "f", "first", F.coalesce("component", "id").alias("part"))
    mixed = placed.groupBy("bucket").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo <> hi").select("bucket")
    rest = stored(placed.join(mixed, "bucket", "left_semi").where("not first").select("id", "f", "part").distinct())
    release(members)
    sets = _sets_of(rest.select("id", "f"), texts, shingle_words)
    pairs = stored(prefix_pairs(sets, rest.select("id", "part").distinct(), percent))
    more = stored(_confirmed(pairs, sets, percent))
    release(rest, sets, pairs)

    # rows that repeat a doc_id with other texts are one document
    twice = filled.groupBy("doc_id").agg(F.min(F.struct("fp1", "fp2")).alias("x"), F.max(F.struct("fp1", "fp2")).alias("y")).where("x <> y").select("doc_id")
    prints = ["n_shingles", "fp1", "fp2"]
    again = filled.join(stored(twice), "doc_id", "left_semi").join(folded.select(*prints, "rep"), prints).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).distinct()
    parts = stored(components(parts.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more).unionAll(again)))

    groups = folded.join(parts.withColumnRenamed("id", "rep"), "rep", "left").select(*prints, F.coalesce("component", "rep").alias("component_id"))
    out = sketch.drop("bands").join(groups, prints, "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one row of each component, its columns unchanged.

    Of rows that repeat the kept doc_id one stays, the first by a hash of its text.
    Rows with a null doc_id all stay.
    """
    kept = near_duplicates(docs, **options).where("kept and doc_id is not null").select(F.col("doc_id").alias("k")).distinct()
    packed = docs.select(F.struct("*").alias("r"))
    id_ = F.col("r.doc_id").cast("long")
    one = packed.where(id_.isNotNull()).join(kept, id_ == F.col("k"), "left_semi")
    # repeated ids are found on the narrow column; only their rows are regrouped
    again = stored(docs.select(F.col("doc_id").cast("long").alias("k")).where("k is not null").groupBy("k").count().where("count > 1").select("k"))
    single = one.join(again, id_ == F.col("k"), "left_anti")
    multi = one.join(again, id_ == F.col("k"), "left_semi").groupBy(id_.alias("k")).agg(F.min_by("r", F.struct(F.xxhash64(F.coalesce("r.text", F.lit(""))), F.xxhash64("r"))).alias("r")).select("r")
    return single.unionByName(multi).unionByName(packed.where(id_.isNull())).select("r.*")
