"""Plain versions of the operators, for small tables, and the odd rows that every operator must take."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, spans string, row long, kept boolean"

ODD_TEXTS = [
    None, "", " ", "\n\t\x0b\x0c\r ", "word", "a b c d", "naïve café ünïcode 漢字 😀 ſecret K",
    "x" * 5000, "la " * 3000, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen " * 40,
    " no break\x85spaces\x1c here", "A\x00B zero bytes\x00",
]


def odd_rows(texts=None):
    """Rows with clashing extra columns, nulls in every column, repeated rows and repeated ids."""
    texts = ODD_TEXTS if texts is None else texts
    rows = [(k, t, None, "x", k, True) for k, t in enumerate(texts)]
    rows += [rows[-1], rows[min(3, len(rows) - 1)], (None, "null id here " * 9, "en", None, None, None), (None, None, None, None, None, None), (1, "other text of id one", "de", "s", 1, False)]
    return rows


def frame(spark, rows=None, schema=SCHEMA):
    return spark.createDataFrame(odd_rows() if rows is None else rows, schema)


def words(text):
    return WORD.findall(text or "")


def tables(sf, *names):
    import duckdb

    return [duckdb.sql(f"SELECT * FROM '/root/testdata/sf{sf}/{n}.parquet' ORDER BY 1").fetchall() for n in names]


def components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(x) for x in range(n)]
