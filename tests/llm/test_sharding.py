import zlib

import pytest

from termloom.llm import sharding
from tests.llm.fixtures import SCHEMA, awkward, clashing, table


@pytest.mark.parametrize("shards,cell_rows", [(4, 500_000), (7, 5), (40, 500_000), (1, 10)])
def test_law_and_slots(spark, shards, cell_rows):
    rows = awkward(n=200)
    got = sharding.shard_documents(clashing(table(spark, rows), "size", "k1", "cell", "shard"), shards, cell_rows=cell_rows).collect()
    assert len(got) == len(rows)
    want = sorted(((i is None, i or 0), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert sorted(((r.doc_id is None, r.doc_id or 0), r.size, r.text_crc32) for r in got) == want
    by = {}
    for r in got:
        assert 0 <= r.shard < shards and r.law == "bytes" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    total, largest = sum(r.size for r in got), max(r.size for r in got)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
        assert abs(sum(r.size for r in rs) - total / shards) <= largest + 0.01 * total / shards
    assert [(r.doc_id, r.shard) for r in got if r.doc_id == 17] == [(r.doc_id, r.shard) for r in sharding.shard_documents(table(spark, rows), shards).collect() if r.doc_id == 17]


def test_a_hot_text_and_repeated_rows_are_divided(spark):
    """A third of all rows has one text, and half of these are the very same row."""
    rows = [(k, "the same text " * 5, "en", "a", 1) for k in range(100)] + [(5, "the same text " * 5, "en", "a", 1)] * 100
    rows += [(1000 + k, f"text {k} " * 9, "en", "a", 1) for k in range(400)]
    got = sharding.shard_documents(table(spark, rows), 10).toPandas()
    sizes = got.groupby("shard")["size"].sum()
    assert len(sizes) == 10 and sizes.max() - sizes.min() <= 2 * got["size"].max()
    assert (got.groupby("shard")["slot"].max() + 1 == got.groupby("shard").size()).all()


def test_empty_table(spark):
    assert sharding.shard_documents(spark.createDataFrame([], SCHEMA)).count() == 0
