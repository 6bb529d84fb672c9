"""Secret scans: fixed patterns, and dictionary-primed compression novelty.

The fixed patterns give the base spans.  The method looks at every other token in a
sensitive context: the bytes that it adds to the compressed size of its surroundings,
with the compressor primed by a dictionary of identifiers.  The dictionary is learned from the
corpus: the words that identifiers and prose are made of, counted by documents over all of
them, the most frequent ones up to DICTIONARY_BYTES, after a few names of common configuration
keys.  Words, identifiers and repetitions of the surroundings cost few bytes; a random string
costs about a byte for each of its own.  A token is reported when it costs at least ``NOVEL`` of
its length and dictionary words make up less than ``NAMED`` of it.

All offsets are code points.  A null or empty text has no spans.  Repeated rows are
scanned alike.  An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.quality import bucket
from termloom.llm.storage import arrow, release, stored

KINDS = ("assign", "access", "hex", "novel")
#: Share of its own bytes that a token must cost beside its surroundings.
NOVEL = 0.7
#: Code points of the surroundings on each side.
AROUND = 160
#: A token counts as in sensitive context so many code points before or after a cue.
REACH = 32

_ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{16,}")
_CUE = re.compile(r"(?ai:secret|token|passw|pwd|api.?key|private.?key|access.?key|auth|bearer|credential)")
# an = stands between name and value, but at the end of a run it is padding
_TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_=-]{16})[A-Za-z0-9+/_-]++(?:=+(?![A-Za-z0-9+/_=-]))?")
#: Signs of a token at least.
LEAST = 16
#: Size of the learned dictionary; a zstandard window sees all of it.
DICTIONARY_BYTES = 32_000
#: Words that a task counts before it hands its counts on.
HELD_WORDS = 500_000

#: Names of common configuration keys; the corpus' own words come after them.
_IDENTIFIERS = """
get set value name index count list item key data type user file path size length string number error result
return function class public private static void import from const default export require module request response
client server config settings options params headers body content message status code token secret password
access_key api_key auth_token client_secret connection_string database username hostname localhost example
test_user my_password changeme placeholder your_api_key_here insert_token_here sample_value undefined null true false
application development production environment variable authorization bearer credential certificate private_key
the of and to in is that for it as was with be by on not he his but at are this have which you had or her she an
they were we their been has there more if no out so said what up its about into than them can only other new some
could time these two may then do first any my now such like our over man me even most made after also did many
0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 00000000 11111111 12345678 deadbeef
"""

_PART = re.compile("[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_WORD = re.compile("[A-Z]?[a-z]{2,}|[A-Z]{3,}(?![a-z])")
#: Share of a token's signs in dictionary words from which on it is an identifier.
NAMED = 0.4


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_docs): the words of each text, once a text."""

    def out(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "n"])

    held: Counter = Counter()
    for b in batches:
        for text in b.column("text"):
            held.update({w.lower() for w in set(_WORD.findall(text.as_py() or ""))})
            if len(held) > HELD_WORDS:
                yield out(held)
                held.clear()
    yield out(held)


def learned_words(docs: DataFrame, size: int = DICTIONARY_BYTES) -> list[str]:
    """The words that most documents hold, the most frequent last, in ``size`` bytes.

    Counts cover all words of all texts; only their head, which fits the dictionary, is
    brought to the driver.  A word of more than 24 letters is no name.
    """
    counted = arrow(docs.select(F.col("text").cast("string").alias("text")), _count_words, "word string, n long").where(F.length("word") <= 24)
    counted = stored(counted.groupBy("word").agg(F.sum("n").alias("n")).where("n > 1"))
    # bytes of the words by their count: the least bucket of counts that the dictionary reaches
    least, left = 0, size
    for r in counted.groupBy(bucket(F.col("n")).alias("b")).agg(F.sum(F.length("word") + 1).alias("bytes")).orderBy(F.desc("b")).collect():
        least, left = r["b"], left - r["bytes"]
        if left <= 0:
            break
    # so that tasks hand the driver little more than the head
    head = counted.where(bucket(F.col("n")) >= least).orderBy(F.col("n").desc(), "word").limit(size // 4).collect()
    release(counted)
    out, left = [], size
    for r in head:
        left -= len(r["word"]) + 1
        if left < 0:
            break
        out.append(r["word"])
    return out[::-1]


class Novelty:
    """Compressed sizes beside a dictionary of ``words``."""

    def __init__(self, words: list[str] | tuple[str, ...] = ()):
        import zstandard

        text = " ".join(words) + _IDENTIFIERS
        self.words = frozenset(w.lower() for w in re.findall("[A-Za-z]{3,}", text))
        self.compressor = zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(text.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def novelty(self, token: str, before: str, after: str) -> float:
        """Marginal compressed bytes of each byte of the token: the size of surroundings and
        token less that of the surroundings.  About 1 where nothing in the dictionary or the
        surroundings repeats in the token."""
        around = (before + "\n" + after).encode()
        extra = len(self.compressor.compress(around + b"\n" + token.encode())) - len(self.compressor.compress(around + b"\n"))
        return extra / len(token)

    def named(self, token: str) -> float:
        """Share of the token's signs that lie in words of the dictionary."""
        return sum(len(p) for p in _PART.findall(token) if p.lower() in self.words) / len(token)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of the fixed patterns, failing matches dropped."""
    low = text.lower()
    spans = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        spans += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= 12]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    spans += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(spans)


def novel_spans(text: str, base: list[tuple[int, int, int]], judge: Novelty | None = None) -> list[tuple[int, int, int]]:
    """Incompressible tokens on either side of a cue that no base span touches."""
    judge = judge or _judge(())
    found: list[tuple[int, int, int]] = []
    spots: list[tuple[int, int]] | None = None
    starts: list[int] = []  # of the base spans, overlapping ones as one
    ends: list[int] = []
    done = 0
    for cue in _CUE.finditer(text):
        if spots is None:
            spots = [m.span() for m in _TOKEN.finditer(text)]
            for x, _, y in base:
                if ends and x < ends[-1]:
                    ends[-1] = max(ends[-1], y)
                else:
                    starts.append(x)
                    ends.append(y)
        lo, hi = cue.start() - REACH, cue.end() + REACH
        # cues ascend, and so do the tokens in their reach: each is looked at once
        first = max(done, bisect_right(spots, lo, key=lambda x: x[1]))
        done = max(done, bisect_left(spots, hi, key=lambda x: x[0]))
        for a, b in spots[first:done]:
            k = bisect_left(starts, b) - 1
            if b - a < LEAST or k >= 0 and ends[k] > a:
                continue
            token = text[a:b]
            if judge.named(token) < NAMED and judge.novelty(token, text[max(0, a - AROUND) : a], text[b : b + AROUND]) >= NOVEL:
                found.append((a, 3, b))
    return found


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


_judges: dict[bytes, Novelty] = {}


def _judge(words: tuple[str, ...]) -> Novelty:
    """The judge of a dictionary, made once a worker and known by its words."""
    key = hashlib.blake2b(" ".join(words).encode(), digest_size=16).digest()
    if key not in _judges:
        _judges.clear()
        _judges[key] = Novelty(words)
    return _judges[key]


def _scan(words):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(words.value)
        for b in batches:
            out: tuple[list, ...] = ([], [], [], [], [], [])
            for text in b.column("text"):
                t = text.as_py() or ""
                base = base_spans(t)
                for k in range(3):
                    out[k].append(sum(x[1] == k for x in base))
                joined = _joined(base)
                extra = novel_spans(t, base, judge)
                out[3].append(len(extra))
                out[4].append(hashlib.sha256(joined.encode()).hexdigest())
                out[5].append(_joined(base + extra) if extra else joined)
            counts = [pa.array(x, pa.int64()) for x in out[:4]]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *counts, pa.array(out[4], pa.string()), pa.array(out[5], pa.string())], ["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans"])

    return run


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans) for each row.

    Spans are ``kind:start:end`` of whole matches, by start and then kind.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    words = docs.sparkSession.sparkContext.broadcast(tuple(learned_words(texts)))
    return arrow(texts, _scan(words), "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
