"""Incremental, reversible removal of lines that repeat across documents.

A line's key is the line without the ASCII white space at its ends and with A-Z lower;
keys of at least 20 code points take part, as 128 bits of hashes.  The store holds

  * postings(k1, k2, doc_id): which document holds which key;
  * refs(k1, k2, n_docs, last_doc): exact reference counts and the largest holder;
  * filters(shard, filter): a cuckoo filter of the keys of each shard of ``refs``.

Inserting documents asks the shards' filters which keys may be known already; only those
are joined with the exact tables, all others are appended as new.  Deleting documents
recounts the keys they held and takes those that nobody holds any more out of the
filters, so that a deletion restores the state without these documents.

Nulls and ties: a null or empty text is one empty line, which is never dropped.  Rows with
a null doc_id are not counted and lose no line.  Rows that repeat a doc_id are one
document.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import textkernel as tk
from termloom.llm.cuckoo import CuckooFilter
from termloom.llm.quality import line_ranges
from termloom.llm.storage import arrow, release, stored
from termloom.shipping import ship

MIN_CHARS, MIN_DOCS = 20, 3
#: Keys in one shard of the filters, about; 2 bytes a slot.
SHARD_KEYS = 400_000
_KEY = ["k1", "k2"]


def line_keys(flat: tk.Flat) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(k1, k2, takes part, range of each document) of all lines."""
    w = tk.words(flat)
    start, end, at = line_ranges(flat)
    first, after = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    filled = after > first
    lo, hi = start.copy(), start.copy()
    lo[filled], hi[filled] = w.start[first[filled]], w.end[after[filled] - 1]
    chars = np.concatenate(([0], np.cumsum(flat.data & 0xC0 != 0x80)))
    return tk.range_hashes(flat.data, lo, hi, True), tk.range_hashes2(flat.data, lo, hi), chars[hi] - chars[lo] >= MIN_CHARS, at


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for flat in tk.chunks(b.column("text")):
            k1, k2, part, at = line_keys(flat)
            doc = np.repeat(np.arange(flat.n), np.diff(at))[part]
            k1, k2 = k1[part], k2[part]
            order = np.lexsort((k2, k1, doc))
            doc, k1, k2 = doc[order], k1[order], k2[order]
            new = np.ones(len(doc), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
            ids = b.column("doc_id").slice(flat.first, flat.n).take(pa.array(doc[new]))
            yield pa.RecordBatch.from_arrays([pa.array(k1[new].view(np.int64)), pa.array(k2[new].view(np.int64)), ids], ["k1", "k2", "doc_id"])


def _narrow(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def _shard(shards: int):
    return F.pmod(F.xxhash64("k1"), F.lit(shards)).cast("int").alias("shard")


def _probe(_, keys: pa.Table, filters: pa.Table) -> pa.Table:
    known = np.zeros(len(keys), bool)
    k1, k2 = (keys.column(k).to_numpy().astype(np.int64) for k in _KEY)
    if len(filters):
        known = _load(filters).contains(k1, k2)
    return pa.table({"k1": k1, "k2": k2, "maybe": known})


def _load(filters: pa.Table) -> CuckooFilter:
    raw = filters.column("filter")[0].as_py()
    return CuckooFilter(0, np.frombuffer(raw, np.uint16).reshape(-1, 4).copy())


def _change(capacity: int):
    def run(key, keys: pa.Table, filters: pa.Table) -> pa.Table:
        f = _load(filters) if len(filters) else CuckooFilter(capacity)
        k1, k2 = (keys.column(k).to_numpy().astype(np.int64) for k in _KEY)
        add = keys.column("add").to_numpy(zero_copy_only=False).astype(bool)
        f.delete(k1[~add], k2[~add])
        f.insert(k1[add], k2[add])
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "filter": pa.array([f.table.tobytes()], pa.binary())})

    return run


@dataclass(frozen=True)
class LineStore:
    """The tables of the module's docstring; a store is never changed, only succeeded."""

    postings: DataFrame
    refs: DataFrame
    filters: DataFrame
    shards: int = 0
    shard_keys: int = SHARD_KEYS

    @staticmethod
    def empty(spark: SparkSession, shard_keys: int = SHARD_KEYS) -> LineStore:
        make = spark.createDataFrame
        return LineStore(make([], "k1 long, k2 long, doc_id long"), make([], "k1 long, k2 long, n_docs long, last_doc long"), make([], "shard int, filter binary"), 0, shard_keys)

    def _refiltered(self, refs: DataFrame, added: DataFrame, removed: DataFrame | None) -> tuple[DataFrame, int]:
        """The filters after the keys of ``added`` came and those of ``removed`` went.

        Shards hold a bounded number of keys; when the store outgrows them, their number is
        doubled at least and they are filled anew from the exact table.
        """
        ship(refs.sparkSession)
        n = refs.count()
        shards, old = self.shards, self.filters
        if n > shards * self.shard_keys:
            shards = max(2 * shards, math.ceil(n / self.shard_keys))
            old, added, removed = old.limit(0), refs, None
        changes = added.select(*_KEY, F.lit(True).alias("add"))
        if removed is not None:
            changes = changes.unionByName(removed.select(*_KEY, F.lit(False).alias("add")))
        changes = changes.withColumn("shard", _shard(shards))
        # twice the mean: shards are hash shares, far from that by less
        done = changes.groupBy("shard").cogroup(old.groupBy("shard")).applyInArrow(_change(2 * self.shard_keys), "shard int, filter binary")
        return stored(done), shards

    def insert(self, docs: DataFrame) -> LineStore:
        """The store with the lines of ``docs``; documents held already are not counted again."""
        new = stored(arrow(_narrow(docs), _postings, "k1 long, k2 long, doc_id long").where("doc_id is not null"))
        if not self.shards:
            refs = stored(new.groupBy(*_KEY).agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc")))
            filters, shards = self._refiltered(refs, refs, None)
            return LineStore(new.distinct(), refs, filters, shards, self.shard_keys)
        ship(docs.sparkSession)
        keys = new.select(*_KEY).distinct().withColumn("shard", _shard(self.shards))
        probed = stored(keys.groupBy("shard").cogroup(self.filters.groupBy("shard")).applyInArrow(_probe, "k1 long, k2 long, maybe boolean"))
        maybe = probed.where("maybe").select(*_KEY)
        again = new.join(maybe, _KEY, "left_semi").distinct().join(self.postings, [*_KEY, "doc_id"], "left_anti")
        fresh = stored(new.join(maybe, _KEY, "left_anti").distinct().unionByName(again))
        counted = fresh.groupBy(*_KEY).agg(F.count("*").alias("more"), F.max("doc_id").alias("top"))
        known = maybe.join(self.refs, _KEY).join(counted, _KEY, "left").select(
            *_KEY, (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "top").alias("last_doc")
        )
        known = stored(known)
        added = stored(counted.join(known, _KEY, "left_anti").select(*_KEY, F.col("more").alias("n_docs"), F.col("top").alias("last_doc")))
        refs = stored(self.refs.join(known, _KEY, "left_anti").unionByName(known).unionByName(added))
        filters, shards = self._refiltered(refs, added, None)
        release(new, probed, known, added)
        # postings are only added to: nothing written before is written again
        return LineStore(self.postings.unionByName(fresh), refs, filters, shards, self.shard_keys)

    def delete(self, doc_ids: DataFrame) -> LineStore:
        """The store without the documents whose ids are in ``doc_ids(doc_id)``."""
        ids = doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
        touched = stored(self.postings.join(ids, "doc_id", "left_semi").select(*_KEY).distinct())
        postings = stored(self.postings.join(ids, "doc_id", "left_anti"))
        counted = stored(
            postings.join(touched, _KEY, "left_semi").groupBy(*_KEY).agg(F.countDistinct("doc_id").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        )
        gone = stored(touched.join(counted, _KEY, "left_anti"))
        refs = stored(self.refs.join(touched, _KEY, "left_anti").unionByName(counted))
        filters, shards = self._refiltered(refs, gone.limit(0), gone)
        release(touched, gone)
        # shards whose keys did not change keep their filters
        filters = filters.unionByName(self.filters.join(filters.select("shard"), "shard", "left_anti")) if shards == self.shards else filters
        return LineStore(postings, refs, stored(filters), shards, self.shard_keys)

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, dropped): the first hashes of the keys that a document loses."""
        repeated = self.refs.where(F.col("n_docs") >= min_docs).select(*_KEY, "last_doc")
        lost = self.postings.join(repeated, _KEY).where(F.col("doc_id") != F.col("last_doc"))
        return lost.groupBy("doc_id").agg(F.collect_set("k1").alias("dropped"))


def _resolve(texts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for flat in tk.chunks(b.column("text")):
                k1, _, part, at = line_keys(flat)
                lists = b.column("dropped").slice(flat.first, flat.n)
                ids = b.column("doc_id").slice(flat.first, flat.n)
                start, end, _ = line_ranges(flat)
                raw = flat.data.tobytes()
                lines, dropped, sums, kept = np.diff(at), [], [], []
                for d in range(flat.n):
                    text = raw[flat.offsets[d] : flat.offsets[d + 1]]
                    n = 0
                    if lists[d].is_valid:
                        s = slice(at[d], at[d + 1])
                        lose = part[s] & np.isin(k1[s].view(np.int64), lists[d].values.to_numpy())
                        n = int(lose.sum())
                        if n:
                            text = b"\n".join(x for x, out in zip(text.split(b"\n"), lose.tolist()) if not out)
                    dropped.append(n)
                    sums.append(hashlib.sha256(text).hexdigest())
                    if texts:
                        kept.append(text.decode())
                own = [ids, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sums)]
                yield pa.RecordBatch.from_arrays(own + [pa.array(kept, pa.string())] * texts, ["doc_id", "n_lines", "n_dropped", "kept_sha256"] + ["kept_text"] * texts)

    return run


def resolve(store: LineStore, docs: DataFrame, *, min_docs: int = MIN_DOCS, texts: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256[, kept_text]) for each row of ``docs``.

    A key held by ``min_docs`` documents loses its lines in all but the largest doc_id.
    """
    joined = _narrow(docs).join(store.drops(min_docs), "doc_id", "left")
    return arrow(joined, _resolve(texts), "doc_id long, n_lines long, n_dropped long, kept_sha256 string" + ", kept_text string" * texts)


def build(docs: DataFrame, *, batches: int = 2, withdrawn: int = 32, shard_keys: int = SHARD_KEYS) -> LineStore:
    """A store of ``docs``, filled as an archive is: batch after batch (by a hash of the
    id), each of which asks the filters of those before; then a ``withdrawn``-th of the
    documents is deleted and comes back in.  The state is that of one insertion of all.
    """
    id_ = F.col("doc_id").cast("long")
    part = F.pmod(F.xxhash64(id_, F.lit(1)), F.lit(batches))
    store = LineStore.empty(docs.sparkSession, shard_keys)
    for k in range(batches):
        store = store.insert(docs.where(part == k))
    if withdrawn:
        some = docs.where(F.pmod(F.xxhash64(id_, F.lit(2)), F.lit(withdrawn)) == 0)
        store = store.delete(some.select("doc_id")).insert(some)
    return store


def dedup_lines(docs: DataFrame, *, batches: int = 1, withdrawn: int = 0, shard_keys: int = SHARD_KEYS, **options) -> DataFrame:
    """``resolve`` over a store made of ``docs`` itself."""
    return resolve(build(docs, batches=batches, withdrawn=withdrawn, shard_keys=shard_keys), docs, **options)
