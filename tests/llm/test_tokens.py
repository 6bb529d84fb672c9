import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import textkernel, tokens
from tests.llm.fixtures import SCHEMA, awkward, clashing, table

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoder():
    return tokens.WordEncoder(PATH, 2)


def plain(encoder, text):
    return [*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="aB'é 1\n\t.!<|>́ſK　\x85\x1c", max_size=40)), max_size=5))
def test_words_give_the_ids_of_the_text(encoder, texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    for flat in textkernel.chunks(pa.array(texts, pa.string())):
        ids, at = encoder.encode(flat)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [plain(encoder, t) for t in texts[flat.first : flat.first + flat.n]]


def test_forgetting_changes_nothing(encoder, monkeypatch):
    monkeypatch.setattr(tokens, "MEMORY_WORDS", 3)
    monkeypatch.setattr(tokens, "MEMORY_PIECES", 3)
    e = tokens.WordEncoder(PATH, 2)
    for text in ["one two three four", "don't stop, four", "one <|endoftext|> two"] * 2:
        (flat,) = textkernel.chunks(pa.array([text]))
        assert e.encode(flat)[0].tolist() == plain(encoder, text)


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 32), st.data())
def test_packing_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, 2**bits - 1), max_size=70)), np.uint32)
    raw = tokens.pack(ids, bits)
    assert len(raw) == (len(ids) * bits + 7) // 8
    assert tokens.unpack(raw, len(ids), bits).tolist() == ids.tolist()


@pytest.mark.parametrize("bits", [5, 16, 17])
def test_random_access(tmp_path, bits):
    g = np.random.default_rng(bits)
    docs = [(None, np.zeros(0, np.uint32))] + [(k, g.integers(0, 2**bits, n).astype(np.uint32)) for k, n in enumerate([3, 0, 9000, 1, 4096, 300_000, 7])]
    w = tokens.Writer(str(tmp_path / "x"), bits)
    for d, ids in docs:
        w.add(d, ids)
    n, total = w.close()
    assert (n, total) == (len(docs), sum(len(i) for _, i in docs))
    r = tokens.Reader(str(tmp_path / "x"))
    for k, (d, ids) in enumerate(docs):
        assert r.nulls[k] == (d is None) and r.document(k).tolist() == ids.tolist()
    everything = np.concatenate([i for _, i in docs])
    for lo, hi in [(0, 1), (4090, 4100), (4096, 8192), (100_000, 250_001), (total - 1, total)]:
        assert r.ids(lo, hi).tolist() == everything[lo:hi].tolist()
    assert os.path.getsize(tmp_path / "x") < total * bits / 8 + 8 * (total / 4096) + 20 * len(docs) + 200


@pytest.mark.parametrize("file_bytes", [2_000, 32_000_000])
def test_query_matches_direct_encoding(spark, encoder, file_bytes):
    rows = awkward()
    files = tokens.write_tokens(clashing(table(spark, rows), "cell", "ids", "size", "d", "h"), PATH, 2, file_bytes=file_bytes)
    assert files.count() >= (3 if file_bytes == 2_000 else 1)
    got = tokens.read_tokens(files).orderBy("start").collect()
    assert len(got) == len(rows)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    want = sorted(((i, crc(plain(encoder, t)), len(plain(encoder, t))) for i, t, *_ in rows), key=key)
    assert sorted(((r.doc_id, r.ids_crc32, r.n_tokens) for r in got), key=key) == want
    ids = [r.doc_id for r in got]
    assert [i is not None for i in ids] == sorted(i is not None for i in ids) and [i for i in ids if i is not None] == sorted(i for i in ids if i is not None)
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_a_tokenizer_that_keeps_white_space_encodes_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    t = Tokenizer(models.WordLevel({"a": 0, "b": 1, "\u0120b": 2, "\u0120a": 3, "?": 4}, unk_token="?"))
    t.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    t.save(str(tmp_path / "t.json"))
    e = tokens.WordEncoder(str(tmp_path / "t.json"), 9)
    assert not e.by_word
    (flat,) = textkernel.chunks(pa.array(["a b", "", "b a"]))
    ids, at = e.encode(flat)
    assert ids.tolist() == [0, 2, 9, 9, 1, 3, 9] and at.tolist() == [0, 3, 4, 7]
    assert tokens.WordEncoder(PATH, 2).by_word


def test_empty_table(spark):
    assert tokens.read_tokens(tokens.write_tokens(spark.createDataFrame([], SCHEMA), PATH, 2)).count() == 0
