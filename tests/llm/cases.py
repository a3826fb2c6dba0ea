"""Rows every operator must live with, and the driver's small tables."""

from __future__ import annotations

import re

import duckdb

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PASSAGE = " ".join(f"passage{i}" for i in range(60))
LONG = " ".join(f"w{i * 7919 % 5003}" for i in range(40_000))

#: (doc_id, text, lang, source): NULLs in every column, empty and blank texts, ties, repeated rows, odd white space, long texts.
EDGES = [
    (1, f"start of one {PASSAGE} end, of one. the of and to", "en", "src0"),
    (2, f"the second has {PASSAGE} too and the rest of it", "en", "src0"),
    (2, f"the second has {PASSAGE} too and the rest of it", "en", "src0"),
    (3, None, None, None),
    (4, "", "", ""),
    (5, " \t\n\r\x0b\x0c ", "de", "src1"),
    (None, f"no id here {PASSAGE}", "fr", None),
    (None, None, None, "src0"),
    (6, "one", "xx", "src1"),
    (7, "one two", "en-US", "src1"),
    (8, "a " * 400, "en", "src0"),
    (9, "A a A a  a\tA\na A a a a A a a a a a a a", "en", "src0"),
    (10, LONG, "en", "src0"),
    (11, f"{PASSAGE} {PASSAGE}", None, "src2"),
    (12, "x y z\x1c\x85 naïve Ünïcode ﬁ 한글 🙂‍ <|endoftext|> </s> ▁▁ é́", "fr", "src2"),
    (13, "tab\tline\nline\n\nline\nline 'tis it's ### %% | || <b>", "es", "src2"),
    (14, "one", "xx", "src1"),
    (15, "y" * 5000 + " " * 700 + "z" * 3000, "en", "src0"),
]


def edges(spark, extra: bool = False):
    """EDGES as a DataFrame; with `extra` columns whose names the operators use themselves."""
    df = spark.createDataFrame(EDGES, "doc_id bigint, text string, lang string, source string")
    if extra:
        from pyspark.sql import functions as F

        for name in ("key", "row", "kept", "words", "n_words", "fp", "h", "w", "t", "k", "extra", "part", "ids", "sequence_id", "offset", "text2", "all"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def rows_of(name: str, columns: str) -> list[tuple]:
    return sorted(duckdb.sql(f"SELECT {columns} FROM '{FOLDER}/{name}.parquet'").fetchall())


def words(text) -> list[str]:
    return WORD.findall(text or "")


def exact(rows) -> list[tuple]:
    """Rows as sorted tuples; NULLs first."""
    return sorted((tuple(r) for r in rows), key=lambda r: tuple((x is not None, x) for x in r))
