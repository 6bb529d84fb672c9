"""Sharding by histogram sort.

Documents are ordered by (hash of the text, hash of the id, hash of the row's number),
so equal texts lie side by side while any group of them can be divided; a group that lies at a
splitter is in both shards.  The splitters between shards come from exact byte counts
(``splitters.find_cuts``), one for each shard; then the narrow rows are exchanged once,
by ranges of the key with a bounded number of rows, so that no task sorts a whole shard of a large
corpus.  Each range numbers its rows; the rows of a shard in the ranges before are added.

Nulls and ties: a null text counts 16 bytes and has the checksum of the empty text; a
null doc_id is hashed as such; rows that repeat are told apart by their number in the
stored key table and each gets a place of its own.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.llm.splitters import cuts_below, find_cuts
from termloom.llm.storage import arrow, stored

_KEY = ["k1", "k2", "k3"]
#: Bytes that each document costs beside its text.
OVERHEAD = 16
#: Rows that one task sorts, about.
CELL_ROWS = 500_000
#: Ranges whose row counts are sent to all executors, 20 bytes each.
BROADCAST_RANGES = 1_000_000
_COLUMNS = ["doc_id", "size", "text_crc32", "shard"]


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Numbers a range's sorted rows within each shard, whose rows are neighbours."""
    part, shard, n = TaskContext.get().partitionId(), -1, 0
    for b in batches:
        s = b.column("shard").to_numpy()
        if not len(s):
            continue
        place = np.arange(len(s))
        new = np.concatenate(([s[0] != shard], s[1:] != s[:-1]))
        first = np.maximum.accumulate(np.where(new, place, 0 if new[0] else -n))
        own = place - first
        shard, n = int(s[-1]), int(own[-1]) + 1
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in _COLUMNS), pa.array(np.full(len(s), part, np.int32)), pa.array(own)], [*_COLUMNS, "part", "own"])


def shard_documents(docs: DataFrame, shards: int = 40, *, tolerance: float = 0.001, cell_rows: int = CELL_ROWS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) for each row.

    ``size`` is the UTF-8 bytes of the text plus 16; shards have sizes as near to equal
    as whole documents allow, each splitter off by at most ``tolerance`` of a shard or
    half a document.  ``slot`` counts from 0 without gaps in each shard.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keys = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.xxhash64(text).alias("k1"),
            F.xxhash64(F.col("doc_id").cast("long")).alias("k2"),
            F.xxhash64(F.monotonically_increasing_id()).alias("k3"),
        )
    )
    total, n = keys.agg(F.sum("size"), F.count("*")).first()
    total = total or 0
    found = find_cuts(keys, _KEY, "size", {(): [(c, total * c / shards) for c in range(1, shards)]} if n else {}, tolerance * total / shards)
    cuts = sorted((found[x] for x in found), key=lambda c: c.last or ())
    placed = keys.withColumn("shard", cuts_below(cuts, _KEY).cast("int"))
    ranges = max(1, math.ceil(n / cell_rows))
    laid = placed.repartitionByRange(ranges, *_KEY).sortWithinPartitions(*_KEY).select(*_COLUMNS)
    numbered = stored(arrow(laid, _number, "doc_id long, size long, text_crc32 long, shard int, part int, own long"))
    # a row for each range, and one more for each shard
    counts = numbered.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col("shard").alias("s"), F.col("part").alias("p"), F.coalesce(before, F.lit(0)).alias("before"))
    counts = F.broadcast(counts) if ranges <= BROADCAST_RANGES else counts
    return numbered.join(counts, (F.col("shard") == F.col("s")) & (F.col("part") == F.col("p"))).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("before") + F.col("own")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
