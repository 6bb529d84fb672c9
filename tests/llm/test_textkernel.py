"""The text hash: no structure of the text may make two texts alike."""

import random

import numpy as np
import pyarrow as pa
import pytest

from termloom.llm import decontamination, line_dedup, near_dedup, quality
from termloom.llm import textkernel as tk
from tests.llm.fixtures import SCHEMA, table


def thue_morse(n, signs="ab"):
    """The Thue-Morse string of n signs and its complement: polynomial hashes modulo a
    power of two cannot tell them apart, whatever their base."""
    s = [bin(k).count("1") & 1 for k in range(n)]
    return "".join(signs[x] for x in s), "".join(signs[1 - x] for x in s)


def hashes(text, lower=False):
    data, offsets = tk.flatten(pa.array([text]))
    return int(tk.range_hashes(data, offsets[:-1], offsets[1:], lower)[0]), int(tk.range_hashes2(data, offsets[:-1], offsets[1:])[0])


@pytest.mark.parametrize("n", [64, 256, 1024, 4096])
def test_thue_morse_strings_differ_under_both_functions(n):
    a, b = thue_morse(n)
    assert hashes(a)[0] != hashes(b)[0] and hashes(a)[1] != hashes(b)[1]


def test_a_hash_depends_on_the_bytes_alone():
    r = random.Random(1)
    words = ["".join(r.choices("abcXYZé\0", k=r.randint(0, 40))) for _ in range(3000)] + ["x" * k for k in range(600)]
    data, offsets = tk.flatten(pa.array(words))
    for f in (lambda *x: tk.range_hashes(*x, False), lambda *x: tk.range_hashes(*x, True), tk.range_hashes2):
        all_ = f(data, offsets[:-1], offsets[1:])
        low = f is not None and words
        fold = lambda w: "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
        by = {}
        for w, h in zip(low, all_.tolist()):
            by.setdefault(h, set()).add(w)
        # no collision but between cases of a folded word
        assert all(len({fold(w) for w in ws}) == 1 for ws in by.values())
        for k in r.sample(range(len(words)), 200):
            own, at = tk.flatten(pa.array([words[k]]))
            assert int(f(own, at[:-1], at[1:])[0]) == int(all_[k])
    assert hashes("AbC", True)[0] == hashes("aBc", True)[0] != hashes("abd", True)[0]
    assert len(np.unique(all_)) > 2500


def test_operators_tell_thue_morse_texts_apart(spark):
    a, b = thue_morse(1024)
    filler = "this is the first line of every text here\n"
    rows = [(1, a, "en", "s", 1), (2, a, "en", "s", 1), (3, b, "en", "s", 1)]
    got = {r.doc_id: r for r in line_dedup.dedup_lines(table(spark, rows)).collect()}
    assert [got[k].n_dropped for k in (1, 2, 3)] == [0, 0, 0]
    got = {r.doc_id: r.component_id for r in near_dedup.near_duplicates(table(spark, rows[1:])).collect()}
    assert got == {2: 2, 3: 3}
    got = quality.quality(table(spark, [(1, filler + a + "\n" + b, "en", "s", 1)])).collect()[0]
    assert got.n_dup_lines == 0
    prose = " and twelve words that are the same on both sides of this"
    items = spark.createDataFrame([(7, " ".join([a] * 12)), (8, a + prose)], "item_id long, text string")
    docs = spark.createDataFrame([(1, " ".join([b] * 12), "en", "s", 1), (2, b + prose, "en", "s", 1)], SCHEMA)
    assert {(r.doc_id, r.item_id, r.n_equal) for r in decontamination.overlaps(docs, items).collect()} == {(2, 8, 12)}
