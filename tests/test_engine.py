"""Operators on toy ontologies, with values worked out by hand."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.operators import cluster, compare, graph, items, profiles, similarity, suggest
from termloom.operators.ontology import Ontology
from tests.obo import ATOMIC, BRANCHED, CHAIN, CIRCULAR, ENRICHMENT, PROFILES, SPARSE, obo, profile_table


def load(spark, tmp_path, text, **options):
    path = tmp_path / "x.obo"
    path.write_text(text)
    return Ontology.from_obo(spark, str(path), **options)


@pytest.fixture(scope="module")
def enrichment(spark, tmp_path_factory):
    return load(spark, tmp_path_factory.mktemp("e"), ENRICHMENT)


@pytest.fixture(scope="module")
def branched(spark, tmp_path_factory):
    return load(spark, tmp_path_factory.mktemp("b"), BRANCHED)


def ids(spark, *terms):
    return spark.createDataFrame([(t,) for t in terms], "term_id string")


def pairs(df):
    return {tuple(r) for r in df.collect()}


# loading -----------------------------------------------------------------------------


def test_tables(enrichment):
    assert pairs(enrichment.edge) == {("branchA", "root"), ("branchB", "root"), ("branchAChild1", "branchA"), ("branchAChild2", "branchA")}
    assert [r.term_id for r in enrichment.term.orderBy("ord").collect()] == ["root", "branchA", "branchB", "branchAChild1", "branchAChild2"]
    assert pairs(enrichment.alt) == {("branchAChild3", "branchAChild1")}
    assert enrichment.structure() == "hierarchical"
    assert pairs(enrichment.dictionary("xref", r"([A-Z]+:\d+)").select("term_id", "value")) == {("branchAChild1", "HP:12"), ("branchAChild1", "DO:37")}
    assert pairs(enrichment.by_value("xref")) >= {("wikipedia", "branchAChild1")}


def test_alternative_chain_and_obsoletes(spark, tmp_path):
    o = load(spark, tmp_path, CHAIN)
    assert dict(pairs(o.alt)) == dict.fromkeys(["Child1", "Child3", "Child4", "Child10", "Child11"], "Child2")
    assert {r[0] for r in pairs(o.obsolete)} == {"Child1", "Child3", "Child5", "Child10", "Child11"}
    assert {r[0] for r in pairs(o.term.select("term_id"))} == {"Parental", "Child2"}
    assert o.same_as(load(spark, tmp_path, CHAIN)) and not o.same_as(load(spark, tmp_path, ENRICHMENT))


@pytest.mark.parametrize("text,kind", [(SPARSE, "sparse"), (ATOMIC, "atomic"), (CIRCULAR, "circular")])
def test_structures(spark, tmp_path, text, kind):
    o = load(spark, tmp_path, text)
    assert o.structure() == kind
    if kind == "circular":
        assert pairs(o.closure.select("term_id", "ancestor")) == {(a, b) for a in "ABC" for b in "ABC" if a != b}
        assert all(r.level is None for r in o.level.collect())


def test_bad_files(spark, tmp_path):
    with pytest.raises(ValueError):
        load(spark, tmp_path, "format-version: 1.2\nontology: x\n")
    with pytest.raises(Exception, match="holds one value"):
        load(spark, tmp_path, obo({"id": "a", "is_obsolete": ["true", "false"]}))
    o = load(spark, tmp_path, obo({"id": "a", "name": ["first", "second"]}))
    assert o.term.first().name == "first"


def test_header_filters_other_ontologies(spark, tmp_path):
    o = load(spark, tmp_path, obo({"id": "GO:1"}, {"id": "HP:1"}, header="format-version: 1.2\nontology: go/releases"))
    assert pairs(o.term.select("term_id")) == {("GO:1",)}


def test_black_list_and_qualifiers(spark, tmp_path):
    o = load(spark, tmp_path, obo({"id": "a"}, {"id": "b", "is_a": 'a {source="X:1"} ! thing'}, {"id": "c", "is_a": "a"}), black_list=["c"])
    assert pairs(o.edge) == {("b", "a")} and o.term.count() == 2


# graph -------------------------------------------------------------------------------


def random_dag(draw_edges):
    return sorted({(max(a, b), min(a, b)) for a, b in draw_edges if a != b})


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9)), min_size=1, max_size=18))
def test_closure_levels_and_paths_match_brute_force(spark, edges):
    edges = random_dag(edges)
    if not edges:
        return
    up = {n: {b for a, b in edges if a == n} for n in range(10)}

    def ways(n):
        return [[n]] if not up[n] else [[n, *w] for p in up[n] for w in ways(p)]

    term = ids(spark, *map(str, range(10)))
    edge = spark.createDataFrame([(str(a), str(b)) for a, b in edges], "child string, parent string")
    c = graph.closure(edge, term)
    want = {(str(n), str(a)): min(w.index(a) for w in ways(n) if a in w) for n in range(10) for a in {x for w in ways(n) for x in w} - {n}}
    assert {(r.term_id, r.ancestor): r.dist for r in c.collect()} == want
    assert dict(pairs(graph.levels(term, edge, c))) == {str(n): min(map(len, ways(n))) for n in range(10)}
    assert dict(pairs(graph.levels(term, edge, c, shortest=False))) == {str(n): max(map(len, ways(n))) for n in range(10)}
    got = graph.paths(term, edge, c).collect()
    assert sorted((r.term_id, tuple(r.path)) for r in got) == sorted((str(n), tuple(map(str, w))) for n in range(10) for w in ways(n))


def test_kin(spark, branched):
    assert pairs(graph.direct(branched.edge, ids(spark, "ChildA"), up=False).select("related")) == {("ChildA1",), ("ChildA2",)}
    assert pairs(graph.familiar(branched.closure, ids(spark, "ChildB1"), up=True).select("related", "dist")) == {("ChildB", 1), ("Parental", 2)}
    assert pairs(graph.reroot_levels(branched.edge, branched.closure, "ChildA")) == {("ChildA", 1), ("ChildA1", 2), ("ChildA2", 2)}
    part = branched.reroot("ChildA")
    assert part.term.count() == 3 and pairs(part.edge) == {("ChildA1", "ChildA"), ("ChildA2", "ChildA")}
    rel = graph.child_relations(branched.edge, branched.closure, branched.level, ids(spark, "Parental"), hops=0)
    assert pairs(rel) == {("Parental", "ChildA"), ("Parental", "ChildB")}


# information content and similarity --------------------------------------------------


def test_ic(spark, enrichment):
    ic = {r.term_id: r for r in enrichment.ic("resnik", "seco", "zhou", "sanchez").collect()}
    assert ic["root"].ic_resnik == 0 and ic["branchA"].ic_resnik == pytest.approx(0.22184874961635637) and ic["branchB"].ic_resnik == pytest.approx(0.6989700043360187)
    assert ic["branchB"].ic_seco == pytest.approx(1.0) and ic["branchB"].ic_zhou is None and ic["root"].ic_sanchez is None
    assert ic["branchA"].ic_zhou == pytest.approx(0.5 * (1 - math.log10(3) / math.log10(5)) + 0.5 * math.log10(2) / math.log10(3))
    assert ic["branchA"].ic_sanchez == pytest.approx(-math.log10((2 / 1 + 1) / 4))
    with pytest.raises(ValueError):
        enrichment.ic("nonsense")


def test_observed_ic(spark, enrichment):
    prof = profile_table(spark, PROFILES)
    ic = enrichment.ic("resnik", "resnik_observed", profile=prof)
    got = {r.profile_id: (r.ic_resnik, r.ic_resnik_observed) for r in profiles.mean_ics(prof, ic, ["ic_resnik", "ic_resnik_observed"]).collect()}
    assert got["P1"] == pytest.approx((0.3069395846507917, 0.21187577965807694))
    assert got["P2"] == pytest.approx((0.46598000289067915, 0.49357512632949585))
    assert got["P4"] == pytest.approx((0.22184874961635637, 0.19629464514396822))
    assert got["P5"] == pytest.approx((0.6989700043360187, 0.43933269383026263))


GOLDEN = {
    ("P1", "P5"): 0.6204627667845211,
    ("P2", "P5"): 0.5,
    ("P3", "P5"): 0.5793484513785037,
    ("P4", "P5"): 0.48185106713808395,
    ("P1", "P3"): 0.8272836890460279,
    ("P1", "P2"): 0.7469751778563474,
    ("P2", "P4"): 0.24092553356904198,
    ("P2", "P3"): 0.7195656342523358,
    ("P3", "P4"): 0.36138830035356295,
    ("P1", "P4"): 0.6204627667845211,
}


def test_best_match_averages(spark, enrichment):
    prof = profile_table(spark, PROFILES)
    sims = enrichment.term_similarities(prof, sim_type="lin")
    got = {(r.a, r.b): r.sim for r in compare.compare_profiles(prof, sims).collect()}
    assert len(got) == 25
    for (a, b), v in GOLDEN.items():
        assert got[a, b] == pytest.approx(v) and got[b, a] == pytest.approx(v)
    for p in PROFILES:
        assert got[p, p] == pytest.approx(1.0)
    one = {(r.a, r.b): r.sim for r in compare.compare_profiles(prof, sims, bidirectional=False).collect()}
    for a, b in GOLDEN:
        n, m = len(PROFILES[a]), len(PROFILES[b])
        assert (one[a, b] * n + one[b, a] * m) / (n + m) == pytest.approx(got[a, b])


@pytest.mark.parametrize("kind", similarity.SIM_TYPES)
def test_term_similarities(spark, branched, kind):
    terms = ["Parental", "ChildA", "ChildA1", "ChildA2", "ChildB1"]
    prof = profile_table(spark, {"p": terms})
    got = {(r.a, r.b): r.sim for r in branched.term_similarities(prof, sim_type=kind).collect()}
    n = {"Parental": 7, "ChildA": 3, "ChildA1": 1, "ChildA2": 1, "ChildB1": 1}
    ic = {t: -math.log10(v / 7) for t, v in n.items()}
    up = {"Parental": ["Parental"], "ChildA": ["ChildA", "Parental"], "ChildA1": ["ChildA1", "ChildA", "Parental"], "ChildA2": ["ChildA2", "ChildA", "Parental"], "ChildB1": ["ChildB1", "Parental"]}
    for a in terms:
        for b in terms:
            if a > b:
                continue
            m, x, y = max(ic[t] for t in up[a] if t in up[b]), ic[a], ic[b]
            eric = max(0.0, 2 * m - min(x, y))
            lin = 1.0 if a == b else (2 * m / (x + y) if x + y else None)
            want = {"resnik": m, "lin": lin, "jiang_conrath": x + y - 2 * m, "eric": eric, "neric": 1.0 if a == b or min(x, y) <= 0 else eric / min(x, y), "nweric": eric / math.log10(7), "erlin": 1.0 if a == b else (lin if eric > 0 else 0.0)}[kind]
            assert got[a, b] == (None if want is None else pytest.approx(want, abs=1e-12))


def test_common_ancestors(spark, branched):
    p = spark.createDataFrame([("ChildA1", "ChildA2"), ("ChildA", "ChildA1"), ("ChildA1", "ChildA1")], "a string, b string")
    got = similarity.common_ancestors(p, branched.closure, branched.reflexive).collect()
    assert {(r.a, r.b, r.ancestor) for r in got} == {
        ("ChildA1", "ChildA2", "ChildA"), ("ChildA1", "ChildA2", "Parental"), ("ChildA", "ChildA1", "ChildA"), ("ChildA", "ChildA1", "Parental"), ("ChildA1", "ChildA1", "ChildA"), ("ChildA1", "ChildA1", "Parental")}
    prof = profile_table(spark, {"p": ["ChildA1", "ChildA2", "ChildB1"]})
    ic = branched.ic("resnik")
    assert pairs(similarity.profile_mica(prof, branched.closure, ic, cutoff=0.6).select("mica")) == {("ChildA",)}
    assert pairs(similarity.profile_mica(prof, branched.closure, ic).select("mica")) == {("Parental",)}


REF = {"ref": ["ChildA1", "ChildA2"]}
CANDIDATES = {"A": ["ChildA1", "ChildA2"], "B": ["Parental", "ChildB"], "C": ["ChildA", "ChildA1", "Parental"], "D": ["ChildB1", "ChildB2"], "E": ["Parental"], "F": ["ChildA1"]}


def test_ranking_and_greedy_matches(spark, branched):
    ref, cand = profile_table(spark, REF), profile_table(spark, CANDIDATES)
    sims = branched.term_similarities(ref, cand)
    ranked = compare.rank_candidates(compare.compare_profiles(ref, sims, cand), "ref")
    got = {r.candidate: (r.sim, r.rank) for r in ranked.collect()}
    assert got["A"] == (1.0, 1) and got["F"][0] == pytest.approx(0.8118083219821401) and got["F"][1] == 2 and got["B"][0] == 0
    limited = compare.rank_candidates(compare.compare_profiles(ref, sims, cand), "ref", limit=2)
    assert [r.candidate for r in limited.orderBy("rank").collect()] == ["A", "F"]
    m = {(r.candidate, r.ref_term): (r.cand_term, r.sim) for r in compare.term_matches(ref, cand, sims).collect()}
    assert m["A", "ChildA1"] == ("ChildA1", 1.0) and m["A", "ChildA2"] == ("ChildA2", 1.0)
    assert m["F", "ChildA1"] == ("ChildA1", 1.0) and ("F", "ChildA2") not in m
    neg = compare.candidate_term_sims(ref, cand, sims)
    low = {(r.term_id, r["count"]) for r in compare.negative_terms(neg, 0.2).collect()}
    assert ("Parental", 3) in low and ("ChildB1", 1) in low and not any(t == "ChildA1" for t, _ in low)


def test_self_similarity(spark, branched):
    prof = profile_table(spark, {"x": ["ChildA1", "ChildA2", "ChildB1"], "y": ["ChildA1"]})
    sims = branched.term_similarities(prof)
    got = dict(pairs(compare.self_similarities(prof, sims)))
    lin = 2 * -math.log10(3 / 7) / (2 * math.log10(7))
    assert got["y"] == 1.0 and got["x"] == pytest.approx(lin / 3)


# profiles ----------------------------------------------------------------------------


def test_cleaning(spark, enrichment):
    prof = profile_table(spark, {**PROFILES, "Q": ["branchAChild3", "branchAChild1", "nothing", "branchB", "branchB"]})
    clean = profiles.as_arrays(profiles.clean_hard(prof, enrichment.term, enrichment.alt, enrichment.closure))
    got = {r.profile_id: r.terms for r in clean.collect()}
    assert got == {"P1": ["branchAChild1"], "P2": ["branchB", "branchAChild1"], "P3": ["branchAChild1", "branchAChild2"], "P4": ["branchA"], "P5": ["branchAChild1"], "Q": ["branchAChild1", "branchB"]}
    soft = {r.profile_id: r.terms for r in profiles.as_arrays(profiles.clean(prof, enrichment.closure, enrichment.alt)).collect()}
    assert soft["Q"] == ["branchAChild1", "nothing", "branchB", "branchB"]
    below = {r.profile_id: r.terms for r in profiles.as_arrays(profiles.clean_hard(prof, enrichment.term, enrichment.alt, enrichment.closure, "branchA")).collect()}
    assert below["P2"] == ["branchAChild1"] and "P4" not in below
    good, bad = profiles.check_ids(prof.where("profile_id = 'Q'"), enrichment.term, enrichment.alt)
    assert [r.term_id for r in good.orderBy("pos").collect()] == ["branchAChild1", "branchAChild1", "branchB", "branchB"] and pairs(bad.select("term_id")) == {("nothing",)}
    assert pairs(profiles.redundancy(prof.where("profile_id = 'P1'"), enrichment.closure)) == {("P1", 3, 2)}


def test_cleaning_by_score(spark, enrichment):
    prof = profile_table(spark, {"x": ["root", "branchA", "branchAChild1", "branchB"]})
    scores = spark.createDataFrame([("branchA", 5.0), ("branchAChild1", 1.0), ("root", 2.0)], "term_id string, score double")
    assert pairs(profiles.clean_by_score(prof, scores, enrichment.closure).select("term_id")) == {("branchA",)}
    assert pairs(profiles.clean_by_score(prof, scores, enrichment.closure, by_max=False, remove_without_score=False).select("term_id")) == {("branchAChild1",), ("branchB",)}


def test_frequencies_and_statistics(spark, enrichment):
    prof = profile_table(spark, PROFILES)
    assert dict(pairs(profiles.term_frequencies(prof)))["branchAChild1"] == pytest.approx(0.8)
    with_up = dict(pairs(profiles.term_frequencies(prof, enrichment.closure, ratio=False)))
    assert with_up["root"] == 8 and with_up["branchA"] == 6
    once = dict(pairs(profiles.term_frequencies(prof, enrichment.closure, ratio=False, distinct=True)))
    assert once["root"] == 5 and once["branchA"] == 5
    s = profiles.size_stats(prof).first()
    assert (s.elements, s.average, s.q1, s.median, s.q3, s.max) == (5, pytest.approx(2.2), 1, 3, 3, 3) and s.variance == pytest.approx(0.96)
    assert profiles.size_at_percentile(prof, 75).first()[0] == 1 and profiles.size_at_percentile(prof, 75, increasing=True).first()[0] == 3
    assert pairs(profiles.general_profile(prof, enrichment.term, enrichment.alt, enrichment.closure, 0.5)) == {("branchAChild1",)}
    assert pairs(profiles.expand_with_parents(prof.where("profile_id = 'P5'"), enrichment.closure, ["root"]).select("term_id")) == {("branchAChild1",), ("branchA",)}
    assert pairs(profiles.filter_terms(enrichment.term.select("term_id"), enrichment.closure, ["root"], ["branchA"])) == {("branchA",), ("branchB",)}


def test_specificity(spark):
    rows = [(1, 10.0, 20.0, 5.0), (2, 60.0, 46.666, 70.0), (3, 30.0, 43.334, 25.0)]
    dist = spark.createDataFrame(rows, "level int, pct_ontology double, pct_weighted double, pct_unique double")
    # only level 1 (weight 2, over 2 levels) and level 3 (weight 1, over 1) exceed the ontology
    assert profiles.specificity_index(dist).first()[0] == pytest.approx(13.334 / 10.0)
    assert profiles.specificity_index(dist, "uniq").first()[0] == 0


def test_items_rise(spark, branched):
    item = spark.createDataFrame([("ChildA1", "x"), ("ChildA2", "x"), ("ChildA2", "y"), ("ChildB1", "x"), ("ChildB2", "z")], "term_id string, item_id string")
    got = pairs(items.expand_to_parents(item, branched.closure, branched.level, 2))
    assert got == pairs(item) | {("ChildA", "x"), ("Parental", "x")}


# clusters, suggestions ---------------------------------------------------------------


def test_ward_matches_a_direct_computation():
    g = np.random.default_rng(1)
    x = g.normal(size=(9, 3))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1))
    links = cluster.ward(d)
    groups = {k: [k] for k in range(9)}
    for step, (a, b, dist, n) in enumerate(links):
        p, q = x[groups[int(a)]], x[groups[int(b)]]
        direct = np.sqrt(2 * len(p) * len(q) / (len(p) + len(q))) * np.linalg.norm(p.mean(0) - q.mean(0))
        assert dist == pytest.approx(direct)
        groups[9 + step] = groups.pop(int(a)) + groups.pop(int(b))
        assert len(groups[9 + step]) == n
    assert cluster.newick(links, list("abcdefghi")).count("(") == 8


def test_clusters(spark):
    sims = [("a", "b", 0.9), ("a", "c", 0.1), ("b", "c", 0.2), ("c", "d", 0.8), ("a", "d", 0.1), ("b", "d", 0.1)]
    df = spark.createDataFrame(sims, "a string, b string, sim double")
    groups, links, tree = cluster.cluster_profiles(df, "lin")
    by = {}
    for r in groups.collect():
        by.setdefault(r.cluster_id, set()).add(r.profile_id)
    assert sorted(map(sorted, by.values())) == [["a", "b"], ["c", "d"]] and links.count() == 3 and tree.endswith(";")


def test_suggestions(spark):
    rel = [("branchAChild1", "branchB", 8.0), ("branchA", "branchB", 6.0), ("branchAChild2", "branchAChild1", 9.0), ("branchC", "branchA", 5.0), ("branchCChild1", "branchB", 4.0), ("branchCChild1", "branchAChild2", 3.0), ("branchA", "branchAChild1", 2.0), ("x", "y", 1.0)]
    relation = spark.createDataFrame([(k, *r) for k, r in enumerate(rel)], "line_no long, term1 string, term2 string, value double")
    query = ids(spark, "branchAChild1", "branchA", "branchCChild1", "lost")
    out = suggest.suggestions(relation, query)
    assert [(r.target, r.hits) for r in out["targets"].collect()] == [("branchB", 3), ("branchAChild2", 2), ("branchC", 1)]
    cells = {(r["query"], r["target"]): r["value"] for r in out["cells"].collect()}
    assert cells == {("branchAChild1", "branchB"): 8, ("branchAChild1", "branchAChild2"): 9, ("branchA", "branchB"): 6, ("branchA", "branchC"): 5, ("branchCChild1", "branchB"): 4, ("branchCChild1", "branchAChild2"): 3}
    assert dict(pairs(out["means"]))["branchA"] == pytest.approx(11 / 3)
    limited = suggest.suggestions(relation, query, black=ids(spark, "branchC"), limit=1, transform="exp")
    assert pairs(limited["blacklisted"]) == {("branchC",)} and {r["value"] for r in limited["cells"].collect()} == {10**-8.0, 10**-6.0, 10**-4.0}


# lookups -----------------------------------------------------------------------------


def test_lookups(spark, enrichment):
    names = spark.createDataFrame([("Child4",), ("fourth",), ("nobody",)], "name string")
    assert pairs(enrichment.ids_of(names)) == {("Child4", "branchAChild1"), ("fourth", "branchAChild1"), ("nobody", None)}
    assert {(r.term_id, r.name) for r in enrichment.names_of(ids(spark, "branchAChild3", "branchB", "zz")).collect()} == {("branchAChild3", "Child4"), ("branchB", "Child2"), ("zz", None)}
    texts = spark.createDataFrame([("branchA thing",), ("branchB",), ("no",)], "text string")
    assert {(r.text, r.term_id) for r in enrichment.extract_ids(texts).collect()} == {("branchA thing", "branchA"), ("branchB", "branchB"), ("no", None)}
    assert pairs(enrichment.search("FOURTH|child5")) == {("branchAChild1",), ("branchAChild2",)}
    assert {(r.term_id, r.level, r.synonyms) for r in enrichment.attributes().collect()} >= {("branchAChild1", 3, "fourth"), ("root", 1, "")}
    assert {r.level: len(r.terms) for r in enrichment.level_terms().collect()} == {1: 1, 2: 2, 3: 2}
    below = {r.term_id: [x.term_id for x in r.below] for r in enrichment.children_table(ids(spark, "branchA")).collect()}
    assert below == {"branchA": ["branchAChild1", "branchAChild2"]}


def test_supplier_profiles_hold_every_class(spark):
    """The clustered and matched profiles are whole: each (nation, class) that is sold."""
    from termloom.plans import registry
    from termloom.plans.catalog import Catalog

    c = Catalog(spark, "/root/testdata/sf0.001")
    brand = {r["p_partkey"]: r["c"] for r in c.named.select("p_partkey", "c").collect()}
    nation = dict(c.table("supplier").select("s_suppkey", "s_nationkey").collect())
    sold = {(f"S:{nation[s]}", brand[p]) for s, p in c.table("lineitem").select("l_suppkey", "l_partkey").collect()}
    got = [(r.profile_id, r.term_id) for r in registry._brand_profiles(c).collect()]
    assert len(got) == len(set(got)) and set(got) == sold


def test_greedy_matches_of_large_profiles(spark):
    """Every pair of two profiles of 400 terms is looked at, in order."""
    import random

    r = random.Random(4)
    sims = [(min(a, b), max(a, b), r.randint(0, 20) / 20) for a in (f"a{k:03d}" for k in range(400)) for b in (f"b{k:03d}" for k in range(400))]
    ref = spark.createDataFrame([("r", k, f"a{k:03d}") for k in range(400)], "profile_id string, pos int, term_id string")
    cand = spark.createDataFrame([("c", k, f"b{k:03d}") for k in range(400)], "profile_id string, pos int, term_id string")
    got = {(x.ref_term, x.cand_term, x.sim) for x in compare.term_matches(ref, cand, spark.createDataFrame(sims, "a string, b string, sim double")).collect()}
    left, right, want = set(), set(), set()
    for a, b, s in sorted(sims, key=lambda x: (-x[2], x[0], x[1])):
        if a not in left and b not in right:
            left.add(a)
            right.add(b)
            want.add((a, b, s))
    assert got == want


def test_path_counts_match_the_listed_paths(spark):
    """Diamonds on diamonds have exponentially many paths, which are counted but not listed."""
    small = [("b", "a"), ("c", "a"), ("d", "b"), ("d", "c"), ("e", "d"), ("f", "d"), ("g", "e"), ("g", "f"), ("g", "a")]
    deep = [(f"{x}{k}", y) for k in range(1, 11) for x, y in (("l", f"t{k - 1}"), ("r", f"t{k - 1}"))] + [(f"t{k}", f"{x}{k}") for k in range(1, 11) for x in "lr"]
    for edges in (small, deep):
        edge = spark.createDataFrame(edges, "child string, parent string")
        term = spark.createDataFrame([(t,) for t in sorted({x for e in edges for x in e})], "term_id string")
        up = graph.closure(edge, term)
        got = {r.term_id: (r.total_paths, r.largest_path, r.shortest_path) for r in graph.path_stats(term, edge, up).collect()}
        if edges is deep:
            assert got["t10"] == (2**10, 21, 21)
        else:
            listed = {}
            for r in graph.paths(term, edge, up).collect():
                listed.setdefault(r.term_id, []).append(len(r.path))
            assert got == {t: (len(n), max(n), min(n)) for t, n in listed.items()}
    ring = spark.createDataFrame([("b", "a"), ("c", "b"), ("b", "c")], "child string, parent string")
    three = spark.createDataFrame([("a",), ("b",), ("c",)], "term_id string")
    with pytest.raises(ValueError):
        graph.path_stats(three, ring, graph.closure(ring, three))


def test_ranked_kin_and_child_tables(spark, branched):
    o = branched
    seed = spark.createDataFrame([("ChildA1",)], "term_id string")
    got = [(r.related, r.rank) for r in graph.familiar(o.closure, seed, up=True, level=o.level).orderBy("rank").collect()]
    assert got == [("ChildA", 1), ("Parental", 2)]
    prof = spark.createDataFrame([("p", 0, "ChildA"), ("p", 1, "ChildA1"), ("q", 0, "ChildA")], "profile_id string, pos int, term_id string")
    rows = {(r.profile_id, r.term_id): (r.n_below, r.first_below) for r in profiles.child_tables(prof, o.closure, o.term).collect()}
    assert rows == {("p", "ChildA"): (2, "ChildA1"), ("p", "ChildA1"): (0, None), ("q", "ChildA"): (2, "ChildA1")}
    assert {(r.level, r.term_id, r.times) for r in profiles.level_lists(prof, o.level, distinct=False).collect()} == {(2, "ChildA", 2), (3, "ChildA1", 1)}
