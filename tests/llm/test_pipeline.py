"""The pipeline against brute force, stage by stage, and the registration of its queries."""

import re
import zlib
from pathlib import Path

import corpus_pipeline
from termloom.llm import queries
from tests.llm.fixtures import awkward, prose, table
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_near_dedup import brute as groups
from tests.llm.test_quality import counted


def test_stages(spark, tmp_path):
    import random

    r = random.Random(21)
    items = [(j, prose(r, 25)) for j in range(5)]
    rows = awkward(n=120) + [(3000 + j, prose(r, 30) + " " + t, "en", "a", 1) for j, t in items]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_duplicates", "benchmark_decontamination", "source_mixing", "sharding"]

    good = stages["quality_rules"](spark, docs, str(tmp_path))
    good = [tuple(x) for x in good.collect()]
    for i, t, *_ in good:
        w, _, _, _, rep = counted(t)
        assert w >= 10 and 100 * rep <= 20 * w
    one = [tuple(x) for x in stages["near_duplicates"](spark, table(spark, good), str(tmp_path)).collect()]
    assert sorted(i for i, *_ in one if i is not None) == sorted({c for _, c in groups(good).values()})
    clean = [tuple(x) for x in stages["benchmark_decontamination"](spark, table(spark, one), str(tmp_path)).collect()]
    dirty = {d for d, _ in leaks(one, items)}
    assert sorted(i or -1 for i, *_ in clean) == sorted(i or -1 for i, *_ in one if i not in dirty) and dirty
    mixed = [tuple(x) for x in stages["source_mixing"](spark, table(spark, clean), str(tmp_path)).collect()]
    assert set(mixed) <= set(clean) and max(mixed.count(x) for x in mixed) <= 2
    placed = stages["sharding"](spark, table(spark, mixed), str(tmp_path)).collect()
    key = lambda i, t: (i is None, i or 0, zlib.crc32((t or "").encode()))
    assert sorted((x.doc_id is None, x.doc_id or 0, x.text_crc32) for x in placed) == sorted(key(i, t) for i, t, *_ in mixed)
    whole = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(map(str, ((x.doc_id, x.text_crc32) for x in whole))) == sorted(map(str, ((x.doc_id, x.text_crc32) for x in placed)))


def test_stages_keep_clashing_columns_and_awkward_rows(spark, tmp_path):
    """Extra columns with the names that stages use, nulls in every column, a very long text."""
    from tests.llm.fixtures import clashing

    rows = awkward() + [(4000, None, None, None, None), (4001, "word " * 3 + "ab " * 30_000, None, None, None)]
    spark.createDataFrame([(1, "some item that nobody holds in any of these texts at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = clashing(table(spark, rows), "r", "k", "kept", "h1", "n_words", "members", "size", "shard", "rid")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == names, name
        docs = corpus_pipeline.stored(docs)
        assert docs.count() > 0, name
    placed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert placed.count() == docs.count()


def test_empty_documents(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", name)[1]) for name in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert set(queries.ORACLE_SQL) <= set(queries.QUERIES)


def test_no_local_checkpoints():
    root = Path(__file__).resolve().parents[2] / "termloom"
    assert not [p for p in root.rglob("*.py") if "localCheckpoint(" in p.read_text()]
