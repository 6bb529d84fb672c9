import collections

import pytest

from termloom.llm import quality
from tests.llm.fixtures import SCHEMA, WORD, awkward, clashing, table, words_of


def counted(text):
    t = text or ""
    w = words_of(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
    cover = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(cover)


def test_counts_match_brute_force(spark):
    rows = awkward() + [(7, "a b c d e a b c d e\nx\nx\n \n", "en", "a", 1), (8, "z z z z z z", "en", "a", 1)]
    got = quality.quality(table(spark, rows)).collect()
    assert len(got) == len(rows)
    key = lambda r: tuple((x is None, x or 0) for x in r)
    want = sorted(((i, *counted(t)) for i, t, *_ in rows), key=key)
    have = sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key)
    assert have == want
    for r in got:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_junk_goes_and_prose_stays(spark):
    from tests.llm.fixtures import prose
    import random

    r = random.Random(3)
    good = [(k, prose(r, 80), "en", "s", 1) for k in range(200)]
    bad = [(1000 + k, prose(r, 80).replace(" ", "$$ ### "), "en", "s", 1) for k in range(30)] + [(2000 + k, prose(r, 60).upper(), "en", "s", 1) for k in range(20)]
    kept = {x.doc_id for x in quality.quality(table(spark, good + bad)).where("kept").collect()}
    assert kept == {k for k, *_ in good}
    assert {x.doc_id for x in quality.keep_good(table(spark, good + bad)).collect()} == kept


def test_thresholds_adapt_to_the_group(spark):
    """A source whose every text has many symbols keeps them; another one does not."""
    from tests.llm.fixtures import prose
    import random

    r = random.Random(4)
    code = [(k, prose(r, 60).replace(" ", " | "), "en", "code", 1) for k in range(100)]
    news = [(500 + k, prose(r, 60), "en", "news", 1) for k in range(100)] + [(900, prose(r, 60).replace(" ", " | "), "en", "news", 1)]
    kept = {x.doc_id for x in quality.quality(table(spark, code + news)).where("kept").collect()}
    assert all(k in kept for k, *_ in code) and 900 not in kept


def test_small_groups_use_the_merged_sketches(spark):
    from tests.llm.fixtures import prose
    import random

    r = random.Random(5)
    many = [(k, prose(r, 60), "en", f"s{k % 40}", 1) for k in range(400)]
    odd = [(999, prose(r, 60).replace(" ", " $$$ "), "en", "tiny", 1)]
    got = {x.doc_id: x.kept for x in quality.quality(table(spark, many + odd)).collect()}
    assert not got[999] and sum(got.values()) == 400


def test_empty_table_and_clashing_columns(spark):
    assert quality.quality(spark.createDataFrame([], SCHEMA)).count() == 0
    assert quality.keep_good(spark.createDataFrame([], SCHEMA)).count() == 0
    df = clashing(table(spark, awkward()), "kept", "n_words", "r", "max_symbols", "g_lang", "bucket")
    out = quality.keep_good(df)
    assert out.columns == df.columns
    assert out.count() == quality.quality(table(spark, awkward())).where("kept").count()


@pytest.mark.parametrize("v", [0, 1, 31, 63, 64, 65, 127, 128, 1000, 123_456_789])
def test_buckets_hold_their_numbers(spark, v):
    from pyspark.sql import functions as F

    b, top = spark.range(1).select(quality.bucket(F.lit(v).cast("long")).alias("b")).select("b", quality.bucket_top(F.col("b")).alias("t")).first()
    below = spark.range(1).select(quality.bucket_top(F.lit(b - 1)).alias("t")).first()[0] if b else -1
    assert below < v <= top <= v * 33 / 32 + 1


@pytest.mark.parametrize("share", [30, 45])
def test_a_group_that_is_largely_junk_does_not_raise_its_own_limits(spark, share):
    """One source holds most rows and junk of one kind makes up to 45% of it."""
    from tests.llm.fixtures import prose
    import random

    r = random.Random(6)
    junk = [lambda t: t.replace(" ", "$$ ### "), str.upper, lambda t: " ".join(w + " " + w for w in t.split())]
    rows, bad = [], set()
    for k in range(300):
        t = prose(r, 80)
        if k % 100 < share:
            t = junk[k % 3](t)
            bad.add(k)
        rows.append((k, t, "en", "hot", 1))
    rows += [(1000 + k, prose(r, 80), "en", f"s{k % 4}", 1) for k in range(80)]
    kept = {x.doc_id for x in quality.quality(table(spark, rows)).where("kept").collect()}
    assert not kept & bad
    assert len(kept) >= 0.97 * (len(rows) - len(bad))


def test_quantiles_set_the_limits(spark):
    """Groups alike but for their spread get limits that follow it."""
    import random

    r = random.Random(7)
    text = lambda width: " ".join("x" * r.randint(6 - width, 6 + width) for _ in range(60))
    rows = [(k, text(0), "en", "narrow", 1) for k in range(150)] + [(500 + k, text(5), "en", "wide", 1) for k in range(150)]
    got = {x.source: x for x in quality.quality(table(spark, rows)).collect()}
    assert got["narrow"].max_wide < got["wide"].max_wide


def test_stutter_is_counted():
    import pyarrow as pa

    from termloom.llm import textkernel as tk

    texts = ["a a a b", "", "b", "b b", None, "c C"]
    got = [n for f in tk.chunks(pa.array(texts)) for n in quality.text_counts(f)["n_stutter"].tolist()]
    assert got == [2, 0, 0, 1, 0, 0]
