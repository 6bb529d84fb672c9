"""Token ids in fixed-width bit-packed files.

Every id takes the fewest bits that hold the vocabulary's largest id.  Ids are packed in
blocks; a file ends with the byte offset of each block and with each document's id and
first token, so any range of ids is found by two seeks and unpacked by numpy at once.

File layout (little endian)
    8 bytes   magic
    blocks    ids of the file in order, BLOCK ids each (the last has fewer), least
              significant bit first, each block padded to whole bytes
    footer    u64 block byte offsets [n_blocks + 1], i64 doc ids [n_docs],
              u8 null marks [n_docs], u64 first id of each document [n_docs + 1]
    trailer   u64 footer position, u32 bits, u32 BLOCK, u64 n_blocks, u64 n_docs, magic

Texts are exchanged once, by ranges of ascending (doc_id, text hash), each of which is encoded and
written by one task to one file.  Files are opened through the file system that their folder names
(local or mounted, hdfs, s3, gs).  Words are encoded once a worker and looked up from then
on where the tokenizer drops white space before it merges, so that a text's ids are those of its
words, one after the other; a tokenizer that does not pass the test for that encodes whole texts.

Nulls and ties: a null text is empty and has the end id only; a null doc_id comes first;
rows that repeat a doc_id are all written, in the order of their text's hash.  An empty
table writes no file and gives no rows.
"""

from __future__ import annotations

import math
import os
import re
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm import textkernel as tk
from termloom.llm.storage import arrow, shared_dir, stored

MAGIC = b"TLPACK01"
BLOCK = 4096
#: Text bytes of one file, about.
FILE_BYTES = 32_000_000
#: Files of one call at most; a corpus of more than MOST_FILES * FILE_BYTES has larger ones.
MOST_FILES = 20_000
#: Words, and pieces of words, that a worker remembers at most before it starts afresh.
MEMORY_WORDS, MEMORY_PIECES = 700_000, 600_000
_TRAILER = struct.Struct("<QIIQQ8s")


def bits_for(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    places = np.arange(bits, dtype=np.uint32)
    return np.packbits((ids.astype(np.uint32)[:, None] >> places & 1).astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(raw: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    each = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return each.astype(np.uint32) @ (np.uint32(1) << np.arange(bits, dtype=np.uint32))


class Writer:
    """Writes documents of ascending id to a file, a block at a time."""

    def __init__(self, path: str, bits: int):
        self.path, self.bits = path, bits
        system, place = fs.FileSystem.from_uri(path)
        self.f = system.open_output_stream(place)
        self.f.write(MAGIC)
        self.offsets, self.docs, self.nulls, self.first = [len(MAGIC)], [], [], [0]
        self.held: list[np.ndarray] = []
        self.n_held = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.first.append(self.first[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= 64 * BLOCK:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if all_ else len(ids) // BLOCK * BLOCK
        for k in range(0, end, BLOCK):
            raw = pack(ids[k : min(k + BLOCK, end)], self.bits)
            self.f.write(raw)
            self.offsets.append(self.offsets[-1] + len(raw))
        self.held, self.n_held = [ids[end:]], len(ids) - end

    def close(self) -> tuple[int, int]:
        """Documents and ids written."""
        self._flush(True)
        at = self.offsets[-1]
        self.f.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes() + np.array(self.first, "<u8").tobytes())
        self.f.write(_TRAILER.pack(at, self.bits, BLOCK, len(self.offsets) - 1, len(self.docs), MAGIC))
        self.f.close()
        return len(self.docs), self.first[-1]


class Reader:
    """Random access to the ids of a file."""

    def __init__(self, path: str):
        system, place = fs.FileSystem.from_uri(path)
        self.f = system.open_input_file(place)
        self.f.seek(self.f.size() - _TRAILER.size)
        at, self.bits, self.block, blocks, docs, magic = _TRAILER.unpack(self.f.read(_TRAILER.size))
        if magic != MAGIC:
            raise ValueError(f"{path} is no token file")
        self.f.seek(at)
        self.offsets = np.frombuffer(self.f.read(8 * (blocks + 1)), "<u8").astype(np.int64)
        self.docs = np.frombuffer(self.f.read(8 * docs), "<i8")
        self.nulls = np.frombuffer(self.f.read(docs), "u1").astype(bool)
        self.first = np.frombuffer(self.f.read(8 * (docs + 1)), "<u8").astype(np.int64)

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids ``lo .. hi`` of the file, read from the blocks that hold them."""
        if lo >= hi:
            return np.zeros(0, np.uint32)
        a, b = lo // self.block, (hi - 1) // self.block
        self.f.seek(int(self.offsets[a]))
        raw = self.f.read(int(self.offsets[b + 1] - self.offsets[a]))
        parts = []
        for k in range(a, b + 1):
            n = min(self.block, int(self.first[-1]) - k * self.block)
            parts.append(unpack(memoryview(raw)[self.offsets[k] - self.offsets[a] : self.offsets[k + 1] - self.offsets[a]], n, self.bits))
        return np.concatenate(parts)[lo - a * self.block : hi - a * self.block]

    def document(self, k: int) -> np.ndarray:
        return self.ids(int(self.first[k]), int(self.first[k + 1]))

    def close(self) -> None:
        self.f.close()


class _Numbers(dict):
    """Numbers new keys in the order in which they are asked for."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, key: bytes) -> int:
        n = self[key] = len(self)
        self.new.append(key)
        return n


class WordEncoder:
    """Encodes texts word by word with a tokenizer that drops white space.

    ASCII words are cut where the tokenizer's own splitter always cuts them (between
    letters, single digits and other signs), lower case, and each piece is encoded once;
    other words, and those with an apostrophe or a special token's opening, go through the
    tokenizer whole.
    """

    PIECE = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")

    def __init__(self, path: str, end: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.end = Tokenizer.from_file(path), end
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces, self.piece_ids, self.piece_at = _Numbers(), [], [np.array([0])]
        self._forget()
        self.by_word = True
        probes = ["Two  Words 123\tfoo-bar's", "a1b2 É\n\nÇa x.y, don't", " lead and trail ", "UPPER lower 9876 #!", "one\u3000two\xa0three", "e\u0301 a" * 3]
        (flat,) = tk.chunks(pa.array(probes))
        self.by_word = np.array_equal(self.encode(flat)[0], self._whole(flat)[0])

    def _whole(self, flat: tk.Flat) -> tuple[np.ndarray, np.ndarray]:
        """Encodes whole texts."""
        raw = flat.data.tobytes()
        texts = [raw[a:b].decode() for a, b in zip(flat.offsets[:-1].tolist(), flat.offsets[1:].tolist())]
        ids = [[*e.ids, self.end] for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        return np.array([x for own in ids for x in own], np.uint32), np.cumsum([0, *map(len, ids)])

    def _forget(self) -> None:
        """Forgets the words; the pieces only when they too are many."""
        self.words = _Numbers()
        self.words[b"\n"]  # no word holds a line break: number 0 is the end of a document
        self.words.new.clear()
        self.flat, self.at = [np.array([self.end], np.uint32)], [np.array([0, 1])]
        if len(self.pieces) > MEMORY_PIECES:
            self.pieces, self.piece_ids, self.piece_at = _Numbers(), [], [np.array([0])]

    def _encode_pieces(self) -> None:
        """Looks the new pieces' ids up, many in one call."""
        new, self.pieces.new = self.pieces.new, []
        for k in range(0, len(new), 1000):
            text = [p.decode() for p in new[k : k + 1000]]
            starts = np.concatenate(([0], np.cumsum(np.fromiter(map(len, text), np.int64, len(text)) + 1)))
            e = self.tokenizer.encode("\n".join(text), add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            places = np.array([o[0] for o in e.offsets], np.int64)
            self.piece_ids.append(ids)
            self.piece_at.append(self.piece_at[-1][-1] + np.searchsorted(places, starts[1:]))

    @staticmethod
    def _ragged(ids: np.ndarray, at: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The entries ``n`` of a ragged table, one after the other, and where each ends."""
        first, size = at[n], at[n + 1] - at[n]
        upto = np.cumsum(size)
        return ids[np.repeat(first - upto + size, size) + np.arange(upto[-1] if len(n) else 0)], upto

    def _learn(self) -> None:
        new, self.words.new = self.words.new, []
        numbers, counts, find, cut = [], [], self.pieces.__getitem__, self.PIECE.findall
        for w in new:
            if b"<|" in w:  # a special token's opening: its case counts
                numbers.append(find(w))
                counts.append(1)
            elif w.isascii() and b"'" not in w:
                s = cut(w.lower())
                numbers.extend(map(find, s))
                counts.append(len(s))
            else:
                numbers.append(find(w.lower()))
                counts.append(1)
        self._encode_pieces()
        self.piece_ids, self.piece_at = [np.concatenate(self.piece_ids)], [np.concatenate(self.piece_at)]
        ids, upto = self._ragged(self.piece_ids[0], self.piece_at[0], np.array(numbers))
        self.flat = [np.concatenate((*self.flat, ids))]
        self.at = [np.concatenate((*self.at, self.at[-1][-1] + upto[np.cumsum(counts) - 1]))]

    def encode(self, flat: tk.Flat) -> tuple[np.ndarray, np.ndarray]:
        """(ids, range of each document), an end id after each."""
        if not self.by_word:
            return self._whole(flat)
        if len(self.words) > MEMORY_WORDS:
            self._forget()
        raw, numbers, find = flat.data.tobytes(), [], self.words.__getitem__
        if b"<|" not in raw:
            raw = raw.lower()
        for a, b in zip(flat.offsets[:-1].tolist(), flat.offsets[1:].tolist()):
            numbers.extend(map(find, raw[a:b].split()))
            numbers.append(0)
        if self.words.new:
            self._learn()
        n = np.array(numbers, np.int64)
        ids, upto = self._ragged(self.flat[0], self.at[0], n)
        return ids, np.concatenate(([0], upto[n == 0]))


_encoders: dict[tuple[str, int], WordEncoder] = {}


def _encoder(path: str, end: int) -> WordEncoder:
    if (path, end) not in _encoders:
        _encoders[path, end] = WordEncoder(path, end)
    return _encoders[path, end]


def _write(folder: str, path: str, end: int):
    """Encodes a range's texts, as they come, into one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, writer, cell = _encoder(path, end), None, TaskContext.get().partitionId()
        for b in batches:
            for flat in tk.chunks(b.column("text")):
                if writer is None:
                    system, place = fs.FileSystem.from_uri(folder)
                    system.create_dir(place, recursive=True)
                    # a name of its own for each attempt: only names that a finished task returned are read
                    writer = Writer(f"{folder}/{cell:08d}-{uuid.uuid4().hex}.tok", bits_for(e.vocabulary))
                ids, at = e.encode(flat)
                for d, x, y in zip(b.column("doc_id").slice(flat.first, flat.n).to_pylist(), at[:-1].tolist(), at[1:].tolist()):
                    writer.add(d, ids[x:y])
        if writer:
            docs, n = writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int32()), pa.array([writer.path]), pa.array([docs], pa.int64()), pa.array([n], pa.int64())], ["cell", "path", "n_docs", "n_ids"])

    return run


def write_tokens(docs: DataFrame, path: str, end: int, folder: str | None = None, *, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Encodes and writes all documents; (cell, path, n_docs, n_ids, start), a row a file.

    ``start`` is the number of ids in the files before.  ``folder`` is a path or URI that every
    worker can open, by default one in the shared folder.
    """
    spark = docs.sparkSession
    folder = folder or shared_dir(spark)
    text, id_ = F.col("text").cast("string"), F.col("doc_id").cast("long")
    total = docs.agg(F.sum(F.coalesce(F.octet_length(text), F.lit(0)) + 16)).first()[0] or 0
    cells = min(MOST_FILES, max(1, math.ceil(total / file_bytes)))
    # equal rows have no order, but their number lets a range end among them
    rows = docs.select(id_.alias("doc_id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.xxhash64(F.monotonically_increasing_id()).alias("u"), text.alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("h"), F.col("u")]
    laid = rows.repartitionByRange(cells, *order).sortWithinPartitions(*order).select("doc_id", "text")
    files = stored(arrow(laid, _write(folder, path, end), "cell int, path string, n_docs long, n_ids long"))
    starts, at = [], 0
    for r in files.orderBy("cell").collect():  # a row for each file, MOST_FILES at most
        starts.append((r["cell"], r["path"], r["n_docs"], r["n_ids"], at))
        at += r["n_ids"]
    return spark.createDataFrame(starts, "cell int, path string, n_docs long, n_ids long, start long")


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for path, start in zip(b.column("path").to_pylist(), b.column("start").to_pylist()):
            r = Reader(path)
            k, n = 0, len(r.docs)
            while k < n:  # about a million ids at once
                e = max(k + 1, int(np.searchsorted(r.first, r.first[k] + 1_000_000, "right")) - 1)
                ids = r.ids(int(r.first[k]), int(r.first[e])).astype("<u4")
                at = r.first[k : e + 1] - r.first[k]
                sums = [zlib.crc32(ids[x:y]) for x, y in zip(at[:-1].tolist(), at[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(r.docs[k:e], pa.int64(), mask=r.nulls[k:e]), pa.array(start + r.first[k:e], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(sums, pa.int64())],
                    ["doc_id", "start", "n_tokens", "ids_crc32"],
                )
                k = e
            r.close()


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of ``write_tokens``."""
    n = max(1, files.count())
    spread = files.select("path", "start").repartitionByRange(n, "start")
    return arrow(spread, _read, "doc_id long, start long, n_tokens long, ids_crc32 long")
