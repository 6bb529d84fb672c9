"""Strings, texts, sources, search, streams and the command line."""

import gzip
import io
import json
import random
import tarfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom import cli
from termloom.functions import splitter, strings
from termloom.operators import report, search, textindex
from termloom.operators.ontology import Ontology
from termloom.sources import sinks, tables, text
from termloom.streaming import profiles as stream
from tests.obo import ENRICHMENT, PROFILES, profile_table


def white(a, b):
    x, y = [a[k : k + 2] for k in range(len(a) - 1)], [b[k : k + 2] for k in range(len(b) - 1)]
    return 2 * len(set(x) & set(y)) / (len(x) + len(y)) if x or y else 0.0


def test_white_similarity(spark):
    rows = [("abcdf", "abcde"), ("abcd", "abc"), ("abcd", "asdabcde"), ("abcd", "abcefd"), ("a", "b"), ("", ""), ("aaaa", "aa"), ("x", "xy")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = {(r.a, r.b): r.s for r in df.select("a", "b", strings.white_similarity(F.col("a"), F.col("b")).alias("s")).collect()}
    for a, b in rows:
        assert got[a, b] == pytest.approx(white(a, b))
    assert got["abcdf", "abcde"] == 0.75 and got["abcd", "asdabcde"] == 0.6


def lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abc", max_size=12), st.text("abc", max_size=12))
def test_common_subsequence(a, b):
    m = strings.common_subsequence(a, b)
    assert len(m) == lcs(a, b) and all(a[i] == b[j] for i, j in m)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(m, m[1:]))


def test_gap_similarity():
    assert strings.gap_similarity("abcd", "abcd") == 1.0 and strings.gap_similarity("xyz", "abc") == 1.0
    assert strings.gap_similarity("xabc", "abc") == pytest.approx(6 / 7) and strings.gap_similarity("abcx", "abc") == 1.0


def test_networks(spark):
    rows = spark.createDataFrame([(0, "ab;bc"), (1, "ab"), (2, "zz")], "pos long, text string")
    got = {(r.a, r.b): r.sim for r in strings.similarity_network(rows).collect()}
    assert got == {("ab;bc", "ab"): pytest.approx((0.5 + 1) / 2), ("ab;bc", "zz"): 0, ("ab", "zz"): 0}
    two = spark.createDataFrame([(0, "abcd", "abcx")], "pos long, text string, other string")
    assert strings.similarity_network(two, "ukkonen_myers").first().sim == pytest.approx((8 - 0) / 8)


def test_cleaning_agrees_in_both_forms(spark):
    r = random.Random(3)
    parts = ["word", "\n", " ", "  ", "4.5", "3,2", "i.e.", "et al.", "\t", "\r", "&#13", r"\bold{x}", r"\a[1]{y z}", "(A)", ".", "é", " "]
    rows = ["".join(r.choices(parts, k=r.randint(0, 14))) for _ in range(300)]
    for kind in ("basic", "soft", "hard"):
        clean = text._cleaner(kind)
        df = spark.createDataFrame([(k, t) for k, t in enumerate(rows)], "k int, t string")
        got = {x.k: x.c for x in df.select("k", strings.clean_text(F.col("t"), kind).alias("c")).collect()}
        assert all(got[k] == clean(t) for k, t in enumerate(rows) if " " not in t)
    df = spark.createDataFrame([("Published 1999 and 2004.",), ("none",)], "t string")
    assert [x[0] for x in df.select(strings.extract_year(F.col("t"))).collect()] == [2004, None]


def test_splitting(spark):
    doc = "First sentence here. Second one; third\npart, and more.\n\nA new paragraph. ab.\n\n\n\nno"
    got = splitter.split_document(doc)
    assert got[0][0] == "First sentence here" and all(2 < len(s) <= 3000 for p in got for s in p)
    assert len(got) == 2 and "".join(got[1]).startswith("A new paragraph")
    assert splitter.split_document(None) == [] and splitter.split_document("") == []
    overlapped = splitter.split_recursive(" ".join(f"w{k}" for k in range(40)), 60, 20, ("\n", " ", ""))
    assert all(len(c) <= 60 for c in overlapped)
    assert all(set(a.split()) & set(b.split()) for a, b in zip(overlapped, overlapped[1:]))
    df = spark.createDataFrame([("d", doc)], "id string, text string")
    rows = splitter.sentences(df.withColumn("s", splitter.split_column(df, F.col("text"))), "id", F.col("s")).collect()
    assert {(r.text_id, r.text) for r in rows} == {(f"d_{p}_{s}", t) for p, ss in enumerate(got) for s, t in enumerate(ss)}


ABSTRACT = b"""<PubmedArticleSet><PubmedArticle><MedlineCitation><PMID>1</PMID><DateCompleted><Year>2001</Year></DateCompleted>
<Article><ArticleTitle>A Title</ArticleTitle><Abstract><AbstractText>One two three four five six <sup>skip</sup> seven eight nine ten eleven.</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle>
<PubmedArticle><MedlineCitation><PMID>2</PMID><Article><ArticleTitle>B</ArticleTitle></Article></MedlineCitation></PubmedArticle></PubmedArticleSet>"""
PAPER = """<article article-type="Research"><front><article-meta><article-id pub-id-type="pmc">77</article-id><title-group><article-title>Paper</article-title></title-group>
<article-categories><subj-group><subject>Case</subject></subj-group></article-categories><pub-date pub-type="epub"><year>2010</year></pub-date></article-meta></front><body><sec><p>%s</p><table>no</table></sec></body></article>"""


def test_parsers(spark, tmp_path):
    with gzip.open(tmp_path / "a.xml.gz", "wb") as f:
        f.write(ABSTRACT)
    rec = text.read_records(spark, str(tmp_path / "a.xml.gz"), "abstract")
    one = rec.where("pmid = '1'").first()
    assert one.year == 2001 and one.title == "a title" and "skip" not in one.text and "six seven" in one.text
    stats = text.parse_stats(rec, "abstract").first()
    assert (stats.total, stats.no_pmid, stats.no_abstract, stats.errors) == (2, 0, 1, 0)
    assert [r.pmid for r in textindex.usable(rec, "abstract").collect()] == ["1"]
    assert textindex.usable(rec, "abstract", words=["title"]).count() == 0

    with tarfile.open(tmp_path / "p.tar.gz", "w:gz") as tar:
        for name, body in (("x.xml", PAPER % ("long body. " * 200)), ("y.xml", "<broken")):
            data = body.encode()
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tar.addfile(info, io.BytesIO(data))
    rec = text.read_records(spark, str(tmp_path / "p.tar.gz"), "paper")
    good = rec.where("error is null").first()
    assert good.pmc == "77" and good.year == 2010 and good.article_type == "research" and good.article_category == "case" and "no" not in good.text.split()
    assert rec.where("error is not null").count() == 1
    eq = spark.createDataFrame([("77", "500")], "pmc string, pmid string")
    assert textindex.usable(rec, "paper", eq).first().pmid == "500"

    (tmp_path / "plain.one.txt").write_text("some\nplain text")
    assert text.read_plain(spark, str(tmp_path / "plain.one.txt")).first()[0] == "plain"
    basic = text.read_records(spark, str(tmp_path / "plain.one.txt"), "basic")
    assert basic.first().text == "some plain text"


def test_corpus_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(str(k), f"Sentence number {k}. Another one here, and more of it.") for k in range(5)], "pmid string, text string")
    for c in ("pmc", "path", "title", "article_type", "article_category", "error"):
        rows = rows.withColumn(c, F.lit(None).cast("string"))
    index = textindex.prepare(rows.withColumn("year", F.lit(1)), split=True)
    sinks.write_corpus(index, str(tmp_path / "i"), items_per_file=2)
    back = tables.read_corpus(spark, str(tmp_path / "i"), True)
    assert {r.text_id.split("_")[0] for r in back.collect()} == set("01234")
    flat = {r.pmid: sum(json.loads(r.text), []) for r in index.collect()}
    assert back.count() == sum(map(len, flat.values()))


def test_tables(spark, tmp_path):
    (tmp_path / "k").write_text("k1\tfirst\ta|b|first\nk2\tsecond\nbad\nk1\tlast\tc\n")
    assert {tuple(r) for r in tables.read_keywords(spark, str(tmp_path / "k")).collect()} == {("k1", "c"), ("k1", "last"), ("k2", "second")}
    (tmp_path / "p").write_text("P1\ta;b;a\nP2\tc\n")
    assert [tuple(r) for r in tables.read_profiles(spark, str(tmp_path / "p")).orderBy("profile_id", "pos").collect()] == [("P1", 0, "a"), ("P1", 1, "b"), ("P1", 2, "a"), ("P2", 0, "c")]
    (tmp_path / "s").write_text("d\tt1,t2\t1;3,2\n")
    assert {tuple(r) for r in tables.read_scores(spark, str(tmp_path / "s")).collect()} == {("d", "t1", 3.0), ("d", "t2", 2.0)}
    (tmp_path / "t").write_text("a\t1\nb\t2\na\t1\n")
    assert {r.text for r in tables.read_table(spark, str(tmp_path / "t"), [0], filter_col=1, filter_value="1").collect()} == {"a"}
    (tmp_path / "j").write_text(json.dumps({"terms": {"a": {"id": "a", "name": "A", "is_a": ["b"]}}, "alternatives_index": {"x": "a"}, "profiles": {"p": ["a", "b"]}, "items": {"a": ["i"]}}))
    got = tables.read_ontology_json(spark, str(tmp_path / "j"))
    assert got["term"].first().tags["is_a"] == ["b"] and got["profile"].count() == 2 and got["alt"].first().main_id == "a" and got["obsolete"].count() == 0


def test_top_k_matches_brute_force(spark, monkeypatch):
    g = np.random.default_rng(2)
    corpus, queries = g.normal(size=(120, 8)), g.normal(size=(7, 8))
    corpus[5] = corpus[6]
    df = lambda m: spark.createDataFrame([(f"{k:03d}", v.tolist()) for k, v in enumerate(m)], "id string, vector array<double>")
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    s = unit(queries) @ unit(corpus).T
    want = {(f"{q:03d}", f"{c:03d}") for q in range(7) for c in sorted(range(120), key=lambda c: (-s[q, c], c))[:9]}
    for block in (20_000, 3):
        monkeypatch.setattr(search, "BLOCK_ROWS", block)
        got = search.top_k(df(queries), df(corpus).repartition(5), 9).collect()
        assert {(r.query_id, r.corpus_id) for r in got} == want
        assert all(abs(r.score - s[int(r.query_id), int(r.corpus_id)]) < 1e-9 for r in got)
        near = search.nearest(df(queries).repartition(2), df(corpus), 9).collect()
        assert {(r.row_id, r.side_id) for r in near} == want
    assert search.top_k(df(queries).limit(0), df(corpus), 3).count() == 0


def test_search_finds_the_same_words(spark):
    kw = spark.createDataFrame([("k1", "heart failure"), ("k1", "cardiac failure"), ("k2", "blue whale")], "kwd_id string, text string")
    tx = spark.createDataFrame([("d_0_0", "a case of heart failure"), ("d_0_1", "the blue whale sings"), ("e_1_0", "cardiac failure")], "text_id string, text string")
    best = search.search(kw, tx, k=1)
    got = {r.text_id: r.kwd_id for r in best.collect()}
    assert got == {"d_0_0": "k1", "d_0_1": "k2", "e_1_0": "k1"}
    docs = {(r.doc_id, r.kwd_id): r.positions for r in search.document_profiles(best).collect()}
    assert docs["d", "k2"] == ["0_1"] and docs["e", "k1"] == ["1_0"]
    assert {r.kwd_id for r in search.search(kw, tx, k=1, order="query-corpus").collect()} == {"k1", "k2"}


def test_report_columns(spark):
    df = spark.createDataFrame([(0.0,), (0.2,), (0.5,), (0.99,), (1.0,)], "v double")
    assert [r[0] for r in df.select(report.transformed(F.col("v"), "bins")).collect()] == [0.2, 0.3, 0.5, 0.9, 1.0]
    assert report.default_root("HP") == report.default_root("hp")


def test_streams(spark, tmp_path):
    (tmp_path / "x.obo").write_text(ENRICHMENT)
    onto = Ontology.from_obo(spark, str(tmp_path / "x.obo"))
    prof = profile_table(spark, PROFILES)
    sims = onto.term_similarities(prof)
    rows = prof.select(F.timestamp_seconds(F.col("pos") * 60).alias("ts"), "profile_id", "term_id")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    out = stream.score_stream(src, prof.where("profile_id = 'P5'"), sims)
    q = out.writeStream.format("memory").queryName("scores").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r.profile_id: (r.sim, r.n) for r in spark.table("scores").collect()}
    assert got["P5"] == (1.0, 1) and got["P4"][0] == pytest.approx(0.48185106713808395) and got["P1"][1] == 3
    q = stream.observed_stream(src, onto.reflexive).writeStream.format("memory").queryName("obs").outputMode("complete").option("checkpointLocation", str(tmp_path / "d")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.term_id: r.observed_freq for r in spark.table("obs").collect()}["root"] == 11


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master: spark)
    (tmp_path / "o.obo").write_text(ENRICHMENT)
    (tmp_path / "p").write_text("".join(f"{k}\t{';'.join(v)}\n" for k, v in PROFILES.items()))
    base = ["profiles", "-O", str(tmp_path / "o.obo")]
    cli.main([*base, "-i", str(tmp_path / "p"), "-s", "lin", "-o", str(tmp_path / "sim")])
    got = {tuple(r[:2]): float(r[2]) for r in spark.read.csv(str(tmp_path / "sim_lin"), sep="\t").collect()}
    assert got["P1", "P2"] == pytest.approx(0.7469751778563474)
    (tmp_path / "l").write_text("branchAChild1\nbranchB\nroot\n")
    cli.main([*base, "-i", str(tmp_path / "l"), "-F", "p(root)n(branchA)", "-o", str(tmp_path / "f")])
    assert [r[0] for r in spark.read.csv(str(tmp_path / "f"), sep="\t").collect()] == ["branchB"]
    cli.main(["string-network", "-i", str(tmp_path / "l"), "-o", str(tmp_path / "net")])
    assert spark.read.csv(str(tmp_path / "net"), sep="\t").count() == 3
    (tmp_path / "rel").write_text("branchAChild1\tbranchB\t8\nbranchB\troot\t2\n")
    (tmp_path / "q").write_text("branchAChild1\n")
    cli.main(["suggest", "-q", str(tmp_path / "q"), "-O", str(tmp_path / "o.obo"), "-r", str(tmp_path / "rel"), "-o", str(tmp_path / "sug")])
    assert [tuple(r) for r in spark.read.csv(str(tmp_path / "sug"), sep="\t").collect()] == [("branchAChild1", "8.0")]
    with pytest.raises(SystemExit):
        cli.main(["remote"])


def _csv(spark, path):
    return [tuple(r) for r in spark.read.csv(str(path), sep="\t").collect()]


def test_command_line_flags(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda master: spark)
    (tmp_path / "o.obo").write_text(ENRICHMENT)
    (tmp_path / "p").write_text("".join(f"{k}\t{';'.join(v)}\n" for k, v in PROFILES.items()))
    (tmp_path / "known").mkdir()
    (tmp_path / "known" / "toy.obo").write_text(ENRICHMENT)
    monkeypatch.setenv("TERMLOOM_ONTOLOGIES", str(tmp_path / "known"))
    base = ["profiles", "-O", "toy"]
    # ancestors come from the deepest level up, descendants from the highest down
    cli.main([*base, "-C", "as/branchAChild1", "-o", str(tmp_path / "up")])
    assert [r[0] for r in _csv(spark, tmp_path / "up")] == ["branchA", "root"]
    cli.main([*base, "-C", "s/root", "-o", str(tmp_path / "down")])
    assert [r[0] for r in _csv(spark, tmp_path / "down")] == ["branchA", "branchB", "branchAChild1", "branchAChild2"]
    # propagation brings a term to a profile only over the items' levels, the parental way always
    cli.main([*base, "-i", str(tmp_path / "p"), "-e", "propagate", "-o", str(tmp_path / "risen"), "-E", ","])
    risen = dict(_csv(spark, tmp_path / "risen"))
    assert set(risen) == set(PROFILES) and set(PROFILES["P5"]) <= set(risen["P5"].split(","))
    with pytest.raises(SystemExit):
        cli.main([*base, "-i", str(tmp_path / "p"), "-e", "other", "-o", str(tmp_path / "x")])
    with pytest.raises(SystemExit):
        cli.main(["profiles", "-O", "no such ontology"])
    cli.main([*base, "-i", str(tmp_path / "p"), "-o", str(tmp_path / "wide"), "--output_report", str(tmp_path / "r.html"), "--root_term", "root", "--ontoplot_mode", "dynamic"])
    assert "plot" in (tmp_path / "r.html").read_text() and "angle" in (tmp_path / "r.html").read_text()
    # ranking and its report
    (tmp_path / "ref").write_text("branchAChild1\nroot\n")
    (tmp_path / "docs").write_text("".join(f"{k}\t{'|'.join(v)}\n" for k, v in PROFILES.items()))
    (tmp_path / "titles").write_text("P1\ta title\tarticle\tnews\n")
    report_ = ["match-report", "-i", str(tmp_path / "docs"), "-O", str(tmp_path / "o.obo"), "-r", str(tmp_path / "ref"), "-o", str(tmp_path / "m.html")]
    cli.main([*report_, "--pubmed_ids_and_titles", str(tmp_path / "titles"), "-N", "1,2", "--sim", "resnik", "--get_full_sim_sorted_list"])
    assert "a title" in (tmp_path / "m.html").read_text() and len(_csv(spark, tmp_path / "m.html.tsv")) == len(PROFILES)
    with pytest.raises(SystemExit):
        cli.main([*report_, "--use_pickle"])
    # matching with saved vectors, several keyword files
    (tmp_path / "k1").write_text("k1\tred house\thome\n")
    (tmp_path / "k2").write_text("k2\tblue river\n")
    (tmp_path / "c").write_text("d1\tthe red house on the hill\nd2\ta blue river runs\n")
    flags = ["match", "-q", f"{tmp_path / 'k1'},{tmp_path / 'k2'}", "-c", str(tmp_path / "c"), "-o", str(tmp_path / "hits"), "-C", str(tmp_path / "cv"), "-Q", f"{tmp_path / 'v1'},{tmp_path / 'v2'}"]
    cli.main(flags)
    one = sorted(_csv(spark, tmp_path / "hits"))
    assert {r[1] for r in one} == {"k1", "k2"} and (tmp_path / "cv").exists() and (tmp_path / "v2").exists()
    cli.main([*flags, "--print_relevant_pairs"])  # from the saved vectors, appended
    assert sorted(_csv(spark, tmp_path / "hits")) == sorted(one * 2)
    with pytest.raises(SystemExit):
        cli.main([*flags, "-g", "0"])


def test_corpus_files_by_source_and_in_balance(spark, tmp_path):
    r = random.Random(3)
    rows = [(str(k), "word " * r.choice([5, 50, 500, 5000]) + str(k), f"f{k % 3}", 1, 1, 1, [1]) for k in range(400)]
    index = spark.createDataFrame(rows, "pmid string, text string, original_filename string, year int, text_length int, number_of_sentences int, length_of_sentences array<int>")
    index = index.withColumn("text_length", F.length("text"))
    sinks.write_corpus(index, str(tmp_path / "s"), by_source=True)
    assert sorted(p.name for p in (tmp_path / "s").glob("source=*")) == ["source=f0", "source=f1", "source=f2"]
    sinks.write_corpus(index, str(tmp_path / "b"), balance=4)
    sizes = [len(gzip.open(p).read()) for p in (tmp_path / "b").glob("*.gz")]
    assert len(sizes) == 4 and max(sizes) < 1.35 * min(sizes)


def test_keyword_search_over_values_of_all_tags(spark, tmp_path):
    (tmp_path / "o.obo").write_text(ENRICHMENT)
    o = Ontology.from_obo(spark, str(tmp_path / "o.obo"))
    assert {r.term_id for r in o.search("child[12]", ("name",)).collect()} == {r.term_id for r in o.term.where("lower(name) rlike 'child[12]'").collect()} != set()
