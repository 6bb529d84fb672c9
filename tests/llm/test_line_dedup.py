import hashlib

import numpy as np
import pytest

from termloom.llm import line_dedup
from termloom.llm.cuckoo import CuckooFilter
from tests.llm.fixtures import SCHEMA, awkward, clashing, lower, prose, table

BLANK = " \t\n\x0b\x0c\r"


def keys(t):
    return [lower(x.strip(BLANK)) for x in (t or "").split("\n")]


def brute(rows):
    held = {}
    for i, t, *_ in rows:
        if i is not None:
            for k in keys(t):
                if len(k) >= 20:
                    held.setdefault(k, set()).add(i)
    out = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x, k in zip(lines, keys(t)) if i is None or len(k) < 20 or len(held[k]) < 3 or max(held[k]) == i]
        out.append((i is None, i or 0, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((r.doc_id is None, r.doc_id or 0, r.n_lines, r.n_dropped, r.kept_sha256) for r in df.collect())


def corpus(n=80):
    import random

    r = random.Random(8)
    pool = [prose(r, 8) for _ in range(12)] + ["  " + prose(r, 8).upper() + "\t", "short", "", "ééééééééééééééééééé", "éééééééééééééééééééé"]
    return [(k, "\n".join(r.choices(pool, k=r.randint(1, 6)) + [prose(r, 9)]), "en", "a", 1) for k in range(n)]


def test_matches_brute_force(spark):
    for rows in (awkward(), corpus(), [(1, "a" * 19 + "\n" + "b" * 20, "en", "a", 1)] * 4):
        df = clashing(table(spark, rows), "k1", "dropped", "n_lines", "shard")
        assert rows_of(line_dedup.dedup_lines(df)) == brute(rows)
        assert rows_of(line_dedup.dedup_lines(df, batches=3, withdrawn=3, shard_keys=16)) == brute(rows)


def test_texts(spark):
    rows = corpus(30)
    got = line_dedup.dedup_lines(table(spark, rows), texts=True).collect()
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_insert_and_delete_are_exact_and_reversible(spark):
    rows = corpus()
    first, second, third = rows[:30], rows[25:60], rows[60:]  # the second overlaps the first
    empty = line_dedup.LineStore.empty(spark, shard_keys=40)
    a = empty.insert(table(spark, first))
    b = a.insert(table(spark, second)).insert(table(spark, third))
    assert rows_of(line_dedup.resolve(b, table(spark, rows))) == brute(rows)
    assert b.shards > a.shards
    gone = spark.createDataFrame([(i,) for i, *_ in rows[30:]], "doc_id long")
    back = b.delete(gone)
    state = lambda s: sorted(map(tuple, s.refs.collect()))
    assert state(back) == state(a)
    assert rows_of(line_dedup.resolve(back, table(spark, first))) == brute(first)
    # the filters hold every key that is left: inserting it again changes nothing
    assert state(back.insert(table(spark, first))) == state(a)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 1000, 20_000])
def test_cuckoo_filter(n):
    g = np.random.default_rng(n)
    k1, k2 = g.integers(-(2**62), 2**62, (2, n)), g.integers(-(2**62), 2**62, (2, n))
    f = CuckooFilter(n)
    f.insert(k1[0], k2[0])
    assert f.entries == n and f.contains(k1[0], k2[0]).all()
    assert f.contains(k1[1], k2[1]).mean() < 0.002 if n else True
    half = n // 2
    f.delete(k1[0, :half], k2[0, :half])
    assert f.entries == n - half and f.contains(k1[0, half:], k2[0, half:]).all()


def test_cuckoo_filter_refuses_to_overflow():
    f = CuckooFilter(10)
    g = np.random.default_rng(0)
    with pytest.raises(OverflowError):
        f.insert(g.integers(0, 2**62, 500), g.integers(0, 2**62, 500), max_rounds=50)


def test_second_insert_leaves_new_keys_to_the_filters(spark):
    """Keys that the filters do not know are counted without the exact table."""
    rows = corpus()
    a = line_dedup.LineStore.empty(spark).insert(table(spark, rows[:40]))
    # a store whose exact table lost its rows still takes in the keys that its filters do not know
    blind = line_dedup.LineStore(a.postings, a.refs.limit(0), a.filters, a.shards, a.shard_keys)
    b, c = a.insert(table(spark, rows[40:])), blind.insert(table(spark, rows[40:]))
    known = {(r.k1, r.k2) for r in a.refs.collect()}
    fresh = lambda s: {(r.k1, r.k2, r.n_docs) for r in s.refs.collect() if (r.k1, r.k2) not in known}
    assert fresh(b) == fresh(c) and len(fresh(b)) > 20


def test_cuckoo_filter_deletes_equal_entries_one_by_one():
    f = CuckooFilter(100)
    k = np.array([5, 5, 5, 9], np.int64)
    f.insert(k, k)
    f.delete(k[:2], k[:2])
    assert f.entries == 2 and f.contains(k, k).all()
    f.delete(k[:1], k[:1])
    assert f.entries == 1 and not f.contains(k[:1], k[:1]).any()
