"""Splitting documents into paragraphs and sentences."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.shipping import ship

#: split type -> (size, overlap, separators from coarse to fine)
TYPES = {"classic": (10, 0, ("\n", ".", ";", ",")), "space_overlap": (60, 20, ("\n", " ", ""))}
LONGEST = 3000
#: Texts whose sentences a worker holds at once.
SLICE = 200


def _merge(pieces: list[str], sep: str, size: int, overlap: int) -> list[str]:
    """Joins neighbours while they fit; the next chunk begins with up to ``overlap`` of the last."""
    out: list[str] = []
    held: list[str] = []
    total = 0
    for p in pieces:
        joint = len(sep) if held else 0
        if held and total + len(p) + joint > size:
            text = sep.join(held).strip()
            if text:
                out.append(text)
            while held and (total > overlap or (total + len(p) + (len(sep) if held else 0) > size and total > 0)):
                total -= len(held[0]) + (len(sep) if len(held) > 1 else 0)
                held.pop(0)
        held.append(p)
        total += len(p) + (len(sep) if len(held) > 1 else 0)
    text = sep.join(held).strip()
    return [*out, text] if text else out


def split_recursive(text: str, size: int, overlap: int, separators: Sequence[str]) -> list[str]:
    """Chunks by the coarsest separator that occurs; what is still too long is split by the
    finer ones, and short neighbours are merged up to ``size``."""
    k = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    sep, finer = separators[k], separators[k + 1 :] if k < len(separators) - 1 or separators[k] in text else ()
    pieces = [p for p in (text.split(sep) if sep else list(text)) if p]
    out: list[str] = []
    short: list[str] = []
    for p in pieces:
        if len(p) < size:
            short.append(p)
            continue
        if short:
            out += _merge(short, sep, size, overlap)
            short = []
        out += split_recursive(p, size, overlap, finer) if finer else [p]
    return out + (_merge(short, sep, size, overlap) if short else [])


def split_document(text: str | None, kind: str = "classic") -> list[list[str]]:
    """Sentences of each paragraph; only those of 3 to 3000 characters, no empty paragraph."""
    size, overlap, separators = TYPES[kind]
    out = []
    for paragraph in split_recursive(text or "", 10, 0, ("\n\n",)):
        sentences = [s.strip() for s in split_recursive(paragraph.strip().replace("\n", ""), size, overlap, separators)]
        sentences = [s for s in sentences if 2 < len(s) <= LONGEST]
        if sentences:
            out.append(sentences)
    return out


def split_column(df: DataFrame, text: Column, kind: str = "classic") -> Column:
    """``array<array<string>>`` of a text column (a pandas UDF: the recursion has no built-in)."""
    ship(df.sparkSession)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            for k in range(0, len(b), SLICE):
                yield pd.Series([split_document(t, kind) for t in b.iloc[k : k + SLICE]])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "array<array<string>>")(text)


def sentences(df: DataFrame, id_col: str, split: Column) -> DataFrame:
    """(text_id, doc_id, par, sent, text): a row a sentence, text_id = doc_par_sent."""
    par = df.select(F.col(id_col).alias("doc_id"), F.posexplode(split).alias("par", "ss"))
    sent = par.select("doc_id", "par", F.posexplode("ss").alias("sent", "text"))
    return sent.select(F.concat_ws("_", "doc_id", "par", "sent").alias("text_id"), "doc_id", "par", "sent", "text")
