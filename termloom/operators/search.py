"""Embedding texts and finding the keywords most similar to them."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from termloom.shipping import ship
from termloom.storage import stored

#: Vectors of the query side that are sent to all executors at once; more go in blocks.
BLOCK_ROWS = 4_096
#: Cells of the matrix of scores that a worker holds at once, eight bytes each.
CELLS = 1 << 22
#: Hashes of words and 3-grams that a worker remembers.
REMEMBERED = 1 << 18

Embedder = Callable[[], Callable[[list[str]], np.ndarray]]


def hashing_embedder(dim: int = 128) -> Embedder:
    """A deterministic embedder without a model: signed hashes of words and 3-grams.

    An embedder is made once in each worker and called with a list of texts; a model's
    encode method fits the same form.
    """

    def make() -> Callable[[list[str]], np.ndarray]:
        known: dict[str, int] = {}

        def place(g: str) -> int:
            """The dimension of a word or 3-gram, from ``dim`` on if it counts upwards."""
            h = int.from_bytes(hashlib.blake2b(g.encode(), digest_size=8).digest(), "little")
            if len(known) >= REMEMBERED:
                known.clear()
            known[g] = at = h % dim + (dim if h >> 63 else 0)
            return at

        def encode(texts: list[str]) -> np.ndarray:
            out = np.zeros((len(texts), dim), np.float32)
            for row, text in zip(out, texts):
                t = " ".join((text or "").lower().split())
                at = [known[g] if g in known else place(g) for g in t.split() + [t[k : k + 3] for k in range(len(t) - 2)]]
                n = np.bincount(np.array(at, np.int64), minlength=2 * dim)
                row[:] = n[dim:] - n[:dim]
            return out

        return encode

    return make


def embed(texts: DataFrame, embedder: Embedder | None = None, text_col: str = "text") -> DataFrame:
    """``texts`` with a ``vector`` column (an iterator pandas UDF: one model a worker)."""
    make = embedder or hashing_embedder()
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = make()
        for b in batches:
            yield pd.Series(list(encode(b.fillna("").tolist())))

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return texts.withColumn("vector", F.pandas_udf(run, "array<float>")(F.col(text_col)))


def top_k(queries: DataFrame, corpus: DataFrame, k: int = 20, threshold: float = -1.0) -> DataFrame:
    """(query_id, corpus_id, score): the ``k`` corpus vectors nearest to each query by cosine.

    Both sides have (id, vector).  The queries go to the executors in blocks of bounded size;
    each partition of the corpus multiplies its vectors with a block and keeps its own best
    ``k`` of each query, so what is shuffled is at most k rows a query and partition.  Ties go
    to the smaller corpus id; ``k = 0`` keeps all pairs.
    """
    spark = corpus.sparkSession
    ship(spark)
    out = None
    for block in _blocks(queries):
        part = corpus.select("id", "vector").mapInPandas(_score(spark.sparkContext.broadcast(block), k, threshold), "query_id string, corpus_id string, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], "query_id string, corpus_id string, score double")
    if not k:
        return out
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "corpus_id"))
    return out.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _blocks(queries: DataFrame) -> Iterator[tuple[list[str], np.ndarray]]:
    ids: list[str] = []
    vectors: list[list[float]] = []
    for r in queries.select(F.col("id").cast("string"), "vector").toLocalIterator():
        ids.append(r[0])
        vectors.append(r[1])
        if len(ids) == BLOCK_ROWS:
            yield ids, _unit(np.array(vectors, np.float64))
            ids, vectors = [], []
    if ids:
        yield ids, _unit(np.array(vectors, np.float64))


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _slices(batches: Iterator[pd.DataFrame], columns: int) -> Iterator[pd.DataFrame]:
    """The rows of the batches, as many at once as keep the matrix of scores within CELLS."""
    step = max(1, CELLS // columns)
    for b in batches:
        for k in range(0, len(b), step):
            yield b.iloc[k : k + step]


def _score(shared, k: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        best: pd.DataFrame | None = None
        for b in _slices(batches, len(ids)):
            s = _unit(np.stack(b["vector"].to_numpy()).astype(np.float64)) @ q.T
            names = b["id"].astype(str).to_numpy()
            # only what may be among a query's k best, ties included, becomes rows
            least = np.partition(s, len(s) - k, axis=0)[len(s) - k] if 0 < k < len(s) else -np.inf
            rows, cols = np.nonzero((s >= threshold) & (s >= least))
            part = pd.DataFrame({"query_id": np.array(ids, object)[cols], "corpus_id": names[rows], "score": s[rows, cols]})
            if not k:
                yield part
                continue
            best = part if best is None else pd.concat([best, part])
            best = best.sort_values(["query_id", "score", "corpus_id"], ascending=[True, False, True]).groupby("query_id", sort=False).head(k)
        if best is not None:
            yield best

    return run


def nearest(rows: DataFrame, side: DataFrame, k: int = 20, threshold: float = -1.0) -> DataFrame:
    """(row_id, side_id, score): the ``k`` vectors of ``side`` nearest to each of ``rows``.

    ``rows`` stay where they are, however many; ``side`` goes to the executors in blocks of
    bounded size.  With one block nothing is shuffled, with several k rows a row and block.
    Ties go to the smaller side id; ``k = 0`` keeps all pairs.
    """
    spark = rows.sparkSession
    ship(spark)
    schema = "row_id string, side_id string, score double"
    parts = [rows.select("id", "vector").mapInPandas(_nearest(spark.sparkContext.broadcast(block), k, threshold), schema) for block in _blocks(side)]
    if not parts:
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if not k or len(parts) == 1:
        return out
    rank = F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc("score"), "side_id"))
    return out.withColumn("r", rank).where(F.col("r") <= k).drop("r")


def _nearest(shared, k: int, threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, q = shared.value
        ids = np.array(ids, object)
        for b in _slices(batches, len(ids)):
            s = _unit(np.stack(b["vector"].to_numpy()).astype(np.float64)) @ q.T
            m = s.shape[1]
            least = np.partition(s, m - k, axis=1)[:, m - k, None] if 0 < k < m else -np.inf
            i, j = np.nonzero((s >= threshold) & (s >= least))
            part = pd.DataFrame({"i": i, "row_id": b["id"].astype(str).to_numpy()[i], "side_id": ids[j], "score": s[i, j]})
            if k:
                part = part.sort_values(["i", "score", "side_id"], ascending=[True, False, True]).groupby("i", sort=False).head(k)
            yield part.drop(columns="i")

    return run


def embed_keywords(keywords: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(id, kwd_id, text, vector) of (kwd_id, text)."""
    return embed(keywords.select(F.concat_ws("\u0001", "kwd_id", "text").alias("id"), "kwd_id", "text"), embedder)


def embed_texts(sentences: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(id, text, vector) of (text_id, text)."""
    return embed(sentences.select(F.col("text_id").alias("id"), "text"), embedder)


def match(keywords: DataFrame, texts: DataFrame, k: int = 20, threshold: float = 0.0, order: str = "corpus-query") -> DataFrame:
    """(text_id, kwd_id, score) of vectors from ``embed_keywords`` and ``embed_texts``."""
    kw, tx = keywords.select("id", "vector"), texts.select("id", "vector")
    if order == "corpus-query":
        hits = nearest(tx, kw, k).select(F.col("row_id").alias("text_id"), F.col("side_id").alias("kw"), "score")
    elif order == "query-corpus":
        hits = top_k(kw, tx, k).select(F.col("corpus_id").alias("text_id"), F.col("query_id").alias("kw"), "score")
    else:
        raise ValueError(f"order is corpus-query or query-corpus, not {order}")
    return best_matches(hits.withColumn("kwd_id", F.split("kw", "\u0001")[0])).where(F.col("score") >= threshold)


def search(keywords: DataFrame, sentences: DataFrame, k: int = 20, threshold: float = 0.0, order: str = "corpus-query", embedder: Embedder | None = None) -> DataFrame:
    """(text_id, kwd_id, score): each sentence's (``corpus-query``) or each keyword text's
    (``query-corpus``) best matches, the best score of a keyword's synonyms.

    ``keywords`` has (kwd_id, text), ``sentences`` (text_id, text).
    """
    return match(stored(embed_keywords(keywords, embedder)), stored(embed_texts(sentences, embedder)), k, threshold, order)


def relevant_pairs(matches: DataFrame, keywords: DataFrame, threshold: float = 0.0) -> DataFrame:
    """(terms, score, text_ids): matches by keyword, whose texts are joined by `` -- ``."""
    names = keywords.groupBy("kwd_id").agg(F.array_join(F.array_sort(F.collect_set("text")), " -- ").alias("terms"))
    rows = matches.where(F.col("score") >= threshold).join(names, "kwd_id")
    return rows.groupBy("terms").agg(F.max("score").alias("score"), F.array_sort(F.collect_set("text_id")).alias("text_ids")).orderBy(F.desc("score"), "terms")


def best_matches(hits: DataFrame) -> DataFrame:
    """The best score of each (text_id, kwd_id)."""
    return hits.groupBy("text_id", "kwd_id").agg(F.max("score").alias("score"))


def document_profiles(matches: DataFrame) -> DataFrame:
    """(doc_id, kwd_id, best, scores, positions): a document's matches by keyword; ``text_id``
    is doc_par_sent."""
    part = F.regexp_extract("text_id", r"^(.*)_(\d+_\d+)$", 1), F.regexp_extract("text_id", r"^(.*)_(\d+_\d+)$", 2)
    rows = matches.select(part[0].alias("doc_id"), part[1].alias("where"), "kwd_id", "score")
    each = rows.groupBy("doc_id", "kwd_id").agg(F.max("score").alias("best"), F.array_sort(F.collect_list(F.struct("where", "score"))).alias("w"))
    return each.select("doc_id", "kwd_id", "best", F.transform("w", lambda x: x["score"]).alias("scores"), F.transform("w", lambda x: x["where"]).alias("positions"))
