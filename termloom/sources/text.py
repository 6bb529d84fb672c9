"""Text sources: plain, gz and tar.gz files, PubMed abstracts and PMC papers."""

from __future__ import annotations

import gzip
import io
import os
import re
import tarfile
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.strings import clean_text
from termloom.shipping import ship

#: Elements whose own content is left out; the text after them stays.
SILENT = frozenset(("fig", "fig-group", "sup", "table", "table-wrap", "xref"))
#: Elements that end a paragraph.
BREAKS = frozenset(("p", "sec"))
RECORD = "path string, pmid string, pmc string, year int, text string, title string, article_type string, article_category string, error string"

_ARROW = pa.schema([(c, pa.int32() if t == "int" else pa.string()) for c, t in (f.split() for f in RECORD.split(", "))])


def element_text(e: ET.Element) -> str:
    """Text of an element, its children and its tail; blanks folded, paragraphs apart."""
    parts = []
    if e.tag not in SILENT:
        if e.text is not None:
            parts.append(" " + e.text.replace("\n", " ") + " ")
        parts += [element_text(c) for c in e]
    if e.tag in BREAKS:
        parts.append("\n\n")
    if e.tail is not None:
        parts.append(" " + e.tail.replace("\n", " ") + " ")
    return re.sub(" +", " ", "".join(parts))


def _year(e: ET.Element | None) -> int | None:
    m = re.search(r".*(\d{4}).*", e.text or "") if e is not None else None
    return int(m[1]) if m else None


def _title(e: ET.Element | None) -> str:
    if e is None or not (e.text or "").strip().replace("&#x000a0;", ""):
        return "none"
    return element_text(e).strip().lower()


def abstract_record(article: ET.Element, clean: Callable[[str], str]) -> dict:
    """Fields of one article of an abstract file."""
    citation = article.find("MedlineCitation")
    pmid, year, text = None, 0, ""
    for e in citation if citation is not None else ():
        if e.tag == "PMID":
            pmid = e.text
        elif e.tag == "DateCompleted":
            year = _year(e.find("Year")) or 0
        abstract = e.find("Abstract")
        for t in abstract.findall("AbstractText") if abstract is not None else ():
            body = element_text(t).strip()
            if body:
                text += clean(body) + "\n\n"
    return {"pmid": pmid, "pmc": None, "year": year, "text": clean(text), "title": _title(article.find("MedlineCitation/Article/ArticleTitle")), "article_type": "none", "article_category": "none"}


def paper_record(xml: bytes, clean: Callable[[str], str]) -> dict:
    """Fields of one full paper; years by preference accepted, pmc-release, other."""
    root = ET.fromstring(xml)
    ids = {e.get("pub-id-type"): e.text for e in root.iter("article-id")}
    year = None
    for e in root.iter("date"):
        if e.get("date-type") == "accepted":
            year = _year(e.find("year"))
    if year is None:
        for e in root.iter("pub-date"):
            if e.get("pub-type") == "pmc-release" or year is None:
                year = _year(e.find("year"))
    subject = root.find("front/article-meta/article-categories/subj-group/subject")
    body = root.find("body")
    return {
        "pmid": ids.get("pmid"),
        "pmc": ids.get("pmc"),
        "year": year or 0,
        "text": clean(element_text(body).strip()) if body is not None else "",
        "title": _title(root.find("front/article-meta/title-group/article-title")),
        "article_type": (root.get("article-type") or "none").lower(),
        "article_category": subject.text.strip().lower() if subject is not None and (subject.text or "").strip() else "none",
    }


def _cleaner(kind: str) -> Callable[[str], str]:
    """``functions.strings.clean_text`` for a single Python string."""

    def run(s: str) -> str:
        if kind == "basic":
            return s
        s = re.sub(r"([A-Za-z()]+ *)\n( *[A-Za-z()-]+)", r"\1 \2", s).strip()
        s = s.replace("\r", "\n").replace("&#13", "\n").replace("\t", " ")
        s = re.sub(" +", " ", re.sub(r"\\[a-z]+(?:\[.+\])?\{(.+)\}", r"\1", s))
        if kind == "hard":
            s = re.sub("([0-9]+)[.,]([0-9]+)", r"\1'\2", s)
            s = re.sub(r"i\.?e\.?", "ie", s).replace("al.", "al ")
        return s

    return run


def _members(path: str, raw: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of a file, or of each member of a tar.gz."""
    if path.endswith((".tar.gz", ".tgz")):
        with tarfile.open(fileobj=io.BytesIO(raw), mode="r:gz") as tar:
            for m in tar:
                if not m.isdir():
                    yield os.path.join(path, m.name), tar.extractfile(m).read()
    else:
        yield path, gzip.decompress(raw) if path.endswith(".gz") else raw


def _parse(kind: str, clean_kind: str):
    def rows(path: str, raw: bytes) -> Iterator[dict]:
        clean = _cleaner(clean_kind)
        try:
            for name, data in _members(path, raw):
                try:
                    if kind == "abstract":
                        for article in ET.fromstring(data):
                            yield {"path": name} | abstract_record(article, clean)
                    elif kind == "paper":
                        yield {"path": name} | paper_record(data, clean)
                    else:
                        yield {"path": name, "pmid": os.path.basename(name).split(".")[0], "text": clean(data.decode("utf-8", "replace"))}
                except Exception as e:  # one bad member does not spoil the others: it becomes an error row
                    yield {"path": name, "error": repr(e)}
        except Exception as e:
            yield {"path": path, "error": repr(e)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, raw in zip(b.column("path").to_pylist(), b.column("content")):
                found = list(rows(path, raw.as_py()))  # a file at a time
                if found:
                    yield pa.RecordBatch.from_pylist(found, _ARROW)

    return run


def read_records(spark: SparkSession, path: str, kind: str = "basic", clean: str = "hard") -> DataFrame:
    """A row for each text: basic files, ``abstract`` sets or ``paper`` archives.

    Texts that cannot be read give a row with ``error``; see ``parse_stats``.
    """
    if kind not in ("basic", "abstract", "paper"):
        raise ValueError(f"unknown kind of text {kind}")
    ship(spark)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_parse(kind, clean), RECORD)


def read_plain(spark: SparkSession, path: str, clean: str = "hard") -> DataFrame:
    """(id, path, text) of plain or gz text files, all in built-in expressions."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw.select(F.regexp_extract("path", r"([^/.]+)[^/]*$", 1).alias("id"), "path", clean_text(F.col("value"), clean).alias("text"))


def parse_stats(records: DataFrame, kind: str) -> DataFrame:
    """(total, no_pmid, no_abstract, errors); short texts count as none."""
    good = F.col("error").isNull()
    short = F.size(F.split("text", " ")) < 10 if kind == "abstract" else F.length("text") < 50
    return records.agg(
        F.count("*").alias("total"),
        F.count_if(good & F.col("pmid").isNull()).alias("no_pmid"),
        F.count_if(good & F.col("pmid").isNotNull() & ((F.col("text") == "") | short)).alias("no_abstract"),
        F.count_if(~good).alias("errors"),
    )
