import numpy as np
import pytest

from termloom.llm import near_dedup
from tests.llm.fixtures import SCHEMA, awkward, clashing, lower, table, words_of


def words_set(t):
    w = words_of(lower(t or ""))
    return {tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set())


def brute(rows, percent=75):
    """doc_id -> (set sizes of its rows, component): rows of one doc_id are one document."""
    s = [(i, words_set(t)) for i, t, *_ in rows if i is not None]
    parent = {i: i for i, _ in s}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(s):
        for b, y in s[:k]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {i: (sorted({len(y) for j, y in s if j == i}), find(i)) for i in parent}


def check(spark, rows):
    want = brute(rows)
    got = near_dedup.near_duplicates(table(spark, rows)).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert r.n_shingles in want[r.doc_id][0] and r.component_id == want[r.doc_id][1]
            assert r.kept == (r.component_id == r.doc_id)


def test_matches_brute_force(spark):
    check(spark, awkward())


def test_chains_and_hubs(spark):
    """Long chains of small changes, and many near copies of one text."""
    import random

    from tests.llm.fixtures import prose

    r = random.Random(9)
    base = prose(r, 100).split()
    rows, w = [], list(base)
    for k in range(40):
        w = list(w)
        w[(k * 3) % 100] = f"n{k}"
        rows.append((k, " ".join(w), "en", "a", 1))
    for k in range(60):
        v = list(base)
        v[r.randrange(100)] = f"m{k}"
        rows.append((500 + k, " ".join(v), "en", "a", 1))
    check(spark, rows)


def form_letters(n, own):
    """Texts of one template, whose ``own`` words between keep them under the threshold."""
    import random

    from tests.llm.fixtures import prose

    r = random.Random(n)
    base = prose(r, 150).split()
    rows = []
    for k in range(n):
        w = list(base)
        for p in r.sample(range(150), own):
            w[p] = f"w{r.randrange(10**6)}"
        rows.append((k, " ".join(w), "en", "hot", 1))
    return rows


def candidates(spark, rows):
    """How many pairs the third step verifies, of texts that are all in other components."""
    docs = table(spark, rows).selectExpr("doc_id", "text")
    sets = near_dedup._sets_of(near_dedup.arrow(docs, near_dedup._full_sets(2), "id long, f long, elements array<long>").select("id", "f"), docs, 2)
    return near_dedup.prefix_pairs(sets, sets.selectExpr("id", "id as part"), 75).count()


def test_texts_of_one_template_without_links_yield_few_pairs(spark):
    for n in (200, 400):
        rows = form_letters(n, 26)  # some two thirds of two texts are common
        want = brute(rows)
        assert len({c for _, c in want.values()}) == n
        assert candidates(spark, rows) <= 2 * n
    check(spark, rows)


def test_links_between_components_are_found(spark):
    rows = form_letters(120, 9) + [(1000 + k, t + f" tail {k}", *x) for k, t, *x in form_letters(90, 12)]
    check(spark, rows)


def test_prefix_pairs_lose_no_link(spark):
    import random

    r = random.Random(2)
    pool = [f"e{k}" for k in range(60)]
    rows = [(k, " ".join(r.sample(pool, r.randint(1, 14))), "en", "a", 1) for k in range(150)]
    rows += [(200 + k, " ".join(w for w in rows[k][1].split() if r.random() > 0.1) or "x", "en", "a", 1) for k in range(150)]
    docs = table(spark, rows).selectExpr("doc_id", "text")
    sets = near_dedup._sets_of(near_dedup.arrow(docs, near_dedup._full_sets(1), "id long, f long, elements array<long>").select("id", "f"), docs, 1)
    got = {tuple(sorted((x.a, x.b))) for x in near_dedup.prefix_pairs(sets, sets.selectExpr("id", "id as part"), 75).collect()}
    one = {i: set(t.split()) for i, t, *_ in rows}
    want = {(a, b) for a in one for b in one if a < b and 100 * len(one[a] & one[b]) >= 75 * len(one[a] | one[b])}
    assert want <= got and len(got) < 0.5 * len(one) ** 2 / 2


def test_rows_of_one_id_with_other_texts_are_one_document(spark):
    from tests.llm.fixtures import prose
    import random

    r = random.Random(4)
    a, b, c = (prose(r, 60) for _ in range(3))
    check(spark, [(1, a, "en", "x", 1), (2, a + " end", "en", "x", 1), (2, b, "en", "x", 1), (3, b + " end", "en", "x", 1), (3, c, "en", "x", 1), (4, c, "en", "x", 1), (5, prose(r, 60), "en", "x", 1), (5, None, "en", "x", 1)])


def test_keep_one_leaves_one_row_of_each_component(spark):
    rows = awkward()
    want = brute(rows)
    df = clashing(table(spark, rows), "k", "r", "component_id", "kept")
    out = near_dedup.keep_one(df)
    assert out.columns == df.columns
    ids = [x.doc_id for x in out.collect()]
    assert sorted(i for i in ids if i is not None) == sorted({c for _, c in want.values()})
    assert ids.count(None) == 2


def test_empty_table(spark):
    assert near_dedup.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
    assert near_dedup.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0


def sequential(elements, slots):
    """SuperMinHash one element after the other, without early stopping."""
    from termloom.llm.textkernel import mix

    sig = [2**64 - 1] * slots
    for e in elements.tolist():
        perm = list(range(slots))
        for j in range(slots):
            x = int(mix(np.array([(e + (j + 1) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
            k = j + ((x & 0xFFFFFFFF) * (slots - j) >> 32)
            perm[j], perm[k] = perm[k], perm[j]
            sig[perm[j]] = min(sig[perm[j]], j << 32 | x >> 32)
    return sig


@pytest.mark.parametrize("n", [1, 3, 20, 90])
def test_signatures_are_those_of_the_sequential_algorithm(n):
    g = np.random.default_rng(n)
    e = g.integers(0, 2**63, n, dtype=np.uint64)
    got = near_dedup.super_minhash(np.concatenate([e, e[:1]]), np.array([0, n, n, n + 1]), 16)
    assert got[0].tolist() == sequential(e, 16)
    assert got[2].tolist() == sequential(e[:1], 16)


def test_estimates_similarity_with_less_variance_than_independent_hashes():
    g = np.random.default_rng(0)
    errors = []
    for _ in range(200):
        e = g.integers(0, 2**63, 130, dtype=np.uint64)
        sig = near_dedup.super_minhash(np.concatenate([e[:115], e[15:]]), np.array([0, 115, 230]), 64)
        errors.append((sig[0] == sig[1]).mean() - 100 / 130)
    assert abs(np.mean(errors)) < 0.01
    j = 100 / 130
    assert np.var(errors) < j * (1 - j) / 64
