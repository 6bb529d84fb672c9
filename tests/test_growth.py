"""Work that must not grow faster than the input."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from termloom.functions import splitter
from termloom.operators import compare, graph, profiles, search, similarity
from termloom.sources import obo, sinks, tables
from termloom.storage import ranked
from tests.plans import executed


def wide(spark, n):
    """A root with n leaves: (closure, terms)."""
    closure = spark.range(n).selectExpr("'t' || id as term_id", "'root' as ancestor", "1 as dist")
    return closure, closure.select("term_id").unionByName(spark.createDataFrame([("root",)], "term_id string"))


def test_cleaning_by_score_never_lists_descendants(spark):
    closure, term = wide(spark, 2000)
    prof = spark.range(50).selectExpr("cast(id as string) as profile_id", "explode(array('root', 't' || id)) as term_id", "0 as pos")
    scores = term.selectExpr("term_id", "if(term_id = 'root', 0.0, 1.0) as score")
    rows, steps = executed(profiles.clean_by_score(prof, scores, closure))
    assert {tuple(r) for r in rows} == {(str(k), f"t{k}") for k in range(50)}
    assert max(n for _, n in steps) <= 2000  # 50 times 2,000 if each listed root met all its descendants


def test_obo_file_is_read_in_parts(spark, tmp_path):
    text = "format-version: 1.2\nontology: x\n\n" + "".join(f'[Term]\nid: X:{k}\nname: n{k}\ndef: "{"d" * 200}" []\n\n' for k in range(5000))
    text += "[Other]\nxref: X:late\n\n[Term]\nid: X:1\nname: again\n"
    (tmp_path / "x.obo").write_text(text)
    (tmp_path / "r.obo").write_text(text.replace("\n", "\r"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
    try:
        _, steps = executed(obo.stanzas(spark, str(tmp_path / "x.obo")).groupBy(F.spark_partition_id()).count())
        got = {name: obo.read_obo(spark, str(tmp_path / name))["term"].collect() for name in ("x.obo", "r.obo")}
        parts = obo.stanzas(spark, str(tmp_path / "x.obo")).select(F.spark_partition_id()).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert parts > 3  # one row and one task before
    for rows in got.values():
        assert [(r.ord, r.term_id, r.name) for r in sorted(rows, key=lambda r: r.ord)] == [(k, f"X:{k}", "again" if k == 1 else f"n{k}") for k in range(5000)]
        assert next(r for r in rows if r.term_id == "X:4999").tags["xref"] == ["X:late"]


def test_json_dump_in_objects(spark, tmp_path):
    term = spark.range(95).selectExpr("'t' || (1000 - id) as term_id", "cast(id as int) as ord", "map('name', array('n' || id)) as tags")
    alt = spark.createDataFrame([("a1", "t1000"), ("a2", "t999")], "alt_id string, main_id string")
    prof = spark.range(60).selectExpr("'p' || id % 2 as profile_id", "cast(id * 3 as int) as pos", "'t' || (1000 - id) as term_id")
    path = str(tmp_path / "d")
    sinks.write_ontology_json(term, alt, prof, path, rows=10)
    assert max(spark.read.json(path, multiLine=True).selectExpr("greatest(size(map_keys(from_json(to_json(terms), 'map<string,string>'))), 0)").first()) <= 10
    got = tables.read_ontology_json(spark, path)
    assert [r.term_id for r in got["term"].orderBy("ord").collect()] == [f"t{1000 - k}" for k in range(95)]
    assert sorted(r.ord for r in got["term"].collect()) == list(range(95))
    assert {tuple(r) for r in got["alt"].collect()} == {("a1", "t1000"), ("a2", "t999")}
    assert {tuple(r) for r in got["profile"].collect()} == {(f"p{k % 2}", k // 2, f"t{1000 - k}") for k in range(60)}
    assert {tuple(r) for r in got["item"].collect()} == {(f"t{1000 - k}", f"p{k % 2}") for k in range(60)}


def test_cleaning_lists_only_ancestors_that_profiles_hold(spark):
    closure = spark.range(20).selectExpr("'leaf' as term_id", "'a' || id as ancestor", "1 as dist")
    prof = spark.range(300).selectExpr("cast(id as string) as profile_id", "explode(array('leaf', 'a0', 'x')) as term_id", "0 as pos")
    rows, steps = executed(profiles.clean(prof, closure))
    assert {(r.profile_id, r.term_id) for r in rows} == {(str(k), t) for k in range(300) for t in ("leaf", "x")}
    assert max(n for _, n in steps) <= 1200  # 6,000 with all ancestors
    assert {tuple(r) for r in profiles.redundancy(prof, closure).collect()} == {(str(k), 3, 1) for k in range(300)}


def test_ids_are_checked_without_a_broadcast(spark):
    term = spark.createDataFrame([("a",)], "term_id string")
    alt = spark.createDataFrame([("b", "a")], "alt_id string, main_id string")
    prof = spark.createDataFrame([("p", 0, t) for t in "abc"], "profile_id string, pos int, term_id string")
    rows, steps = executed(profiles.main_ids(prof, term, alt))
    assert {(r.term_id, r.main_id) for r in rows} == {("a", "a"), ("b", "a"), ("c", None)}
    assert not any("Broadcast" in name for name, _ in steps)


def test_ancestors_are_listed_where_a_profile_has_met(spark):
    closure = spark.range(20).selectExpr("'leaf' as term_id", "'a' || id as ancestor", "1 as dist")
    prof = spark.range(300).selectExpr("cast(id as string) as profile_id", "'leaf' as term_id", "0 as pos")
    plan = profiles.expand_with_parents(prof, closure)._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning(profile_id")  # no exchange above
    assert profiles.expand_with_parents(prof, closure).count() == 300 * 21
    assert {r.freq for r in profiles.term_frequencies(prof, closure).collect()} == {1.0}


def test_ranks_of_one_group_come_from_several_tasks(spark):
    rows = spark.range(3000).selectExpr("id % 2 as g", "id as x")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    got = ranked(rows, "g", "x", "k").collect()
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(r.g, r.x, r.k) for r in got} == {(k % 2, k, k // 2 + 1) for k in range(3000)}


def test_leaves_are_not_joined_with_edges_again(spark):
    edge = spark.range(500).selectExpr("'t' || id as child", "'r' as parent").unionByName(spark.createDataFrame([("r", "s")], "child string, parent string"))
    pairs = spark.createDataFrame([("t1", "t2")], "a string, b string")
    c = graph.closure(edge)
    assert c.count() == 1001
    term = spark.range(500).selectExpr("'t' || id as term_id").unionByName(spark.createDataFrame([("r",), ("s",)], "term_id string"))
    rows, steps = executed(similarity.micas(pairs, graph.reflexive(c, term), term.selectExpr("term_id", "1.0D as ic_resnik")))
    assert [(r.mica, r.mica_ic) for r in rows] == [("s", 1.0)]
    assert sum(n for name, n in steps if "Join" in name) < 100  # the closure is cut to the terms of the pairs first


def test_vectors_are_those_of_the_plain_sum():
    import hashlib

    texts = ["Some words, some Words", "", None, "ab"]
    got = search.hashing_embedder(16)()(texts)
    want = np.zeros((4, 16), np.float32)
    for row, text in zip(want, texts):
        t = " ".join((text or "").lower().split())
        for g in t.split() + [t[k : k + 3] for k in range(len(t) - 2)]:
            h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
            row[h % 16] += 1.0 if h >> 63 else -1.0
    assert (got == want).all()


def test_scores_are_held_in_slices(monkeypatch):
    monkeypatch.setattr(search, "CELLS", 40)
    b = pd.DataFrame({"id": [str(k) for k in range(25)], "vector": [np.array([1.0, k]) for k in range(25)]})
    assert [len(x) for x in search._slices(iter([b, b[:0]]), 10)] == [4, 4, 4, 4, 4, 4, 1]


def test_greedy_codes_follow_the_order_of_terms():
    column = pa.chunked_array([["b", "a"], ["c", "a"]])
    names, codes = compare._codes(column)
    assert (names, codes.tolist()) == (["a", "b", "c"], [1, 0, 2, 0])


def test_sentences_are_split_in_slices(spark, monkeypatch):
    monkeypatch.setattr(splitter, "SLICE", 3)
    df = spark.range(10).selectExpr("cast(id as string) as id", "concat('Sentence ', id, ' is long enough. And another one.') as text").coalesce(1)
    rows = df.withColumn("s", splitter.split_column(df, F.col("text"))).orderBy("id").collect()
    assert [r.s for r in rows] == [splitter.split_document(r.text) for r in rows]
