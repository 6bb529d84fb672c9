"""Small tables with every awkward case, and brute-force helpers."""

from __future__ import annotations

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile("[^\x20\x09-\x0d]+")
_SYLLABLES = ["an", "er", "the", "ou", "ing", "ti", "sh", "re", "é", "lo", "ka"]


def words_of(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def prose(r: random.Random, n: int) -> str:
    out = []
    for k in range(n):
        w = "".join(r.choices(_SYLLABLES, k=r.randint(1, 3)))
        out.append(w.capitalize() if k % 9 == 0 else w)
    return " ".join(out)


def awkward(seed: int = 1, n: int = 60) -> list[tuple]:
    """Rows with nulls in every column, empties, a very long text, ties and repeated rows."""
    r = random.Random(seed)
    rows = []
    base = [prose(r, r.randint(20, 120)) for _ in range(n // 3)]
    for k in range(n):
        t = r.choice(base)
        kind = k % 6
        if kind == 1:
            w = t.split()
            w[r.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif kind == 2:
            t = prose(r, r.randint(1, 200))
        elif kind == 3:
            t = t + "\nThe same closing line for everybody here.\n" + prose(r, 12)
        elif kind == 4:
            t = t.upper().replace(" ", " ###! ", 20)
        rows.append((k, t, r.choice(["en", "de"]), r.choice(["hot", "hot", "hot", "a", "b"]), len(t)))
    rows += [
        (1000, None, "en", "hot", None),
        (1001, "", None, None, 0),
        (1002, " \t\n\x0b\x0c\r ", "en", None, 7),
        (1003, prose(r, 12_000), "en", "hot", 1),
        (1004, "one", "en", "a", 3),
        (1005, "one", "de", "b", 3),
        (1006, "x y", None, "a", 3),
        (1007, "a b  c é́ \U0001f642 \x1c d\x85e", "fr", "a", 9),
        (None, "a row without an id but with some words in it here", "en", "a", 5),
        (None, None, None, None, None),
    ]
    rows += [rows[3], rows[3], rows[2]]
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def clashing(df, *names):
    """``df`` with extra columns of names that an operator might use itself."""
    from pyspark.sql import functions as F

    for k, name in enumerate(names):
        df = df.withColumn(name, F.lit(f"own {k}"))
    return df
