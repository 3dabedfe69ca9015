"""Writes the code point tables of transliteration, from the ICU4J library that comes with Spark.

    python tools/build_transliteration.py

Table ``ascii``: letters of the six scripts that are made Latin, each through its script's transform, without
marks, and through Latin-ASCII. Table ``latin``: all letters through Any-Latin. Context rules are lost.
"""

from __future__ import annotations

import sys
import unicodedata
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import regex
from pyspark.sql import SparkSession

OUT = Path(__file__).resolve().parent.parent / "lexigrain" / "refdata"
SCRIPTS = ("Cyrillic", "Greek", "Armenian", "Georgian", "Hangul", "Latin")


def main() -> None:
    spark = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").getOrCreate()
    icu = spark.sparkContext._jvm.com.ibm.icu.text.Transliterator
    sep = "\n"

    def through(name: str, texts: list[str]) -> list[str]:
        t = icu.getInstance(name)
        out = []
        for i in range(0, len(texts), 2000):
            out += t.transliterate(sep.join(texts[i : i + 2000])).split(sep)
        assert len(out) == len(texts), name
        return out

    chars = [chr(c) for c in range(128, sys.maxunicode + 1) if unicodedata.category(chr(c))[0] in "LNM" and c < 0x30000]
    rows = []
    for script in SCRIPTS:
        own = [c for c in chars if regex.match(rf"\p{{Script={script}}}", c)]
        latin = own if script == "Latin" else through(f"{script}-Latin", own)
        bare = ["".join(x for x in unicodedata.normalize("NFKD", t) if unicodedata.category(x) != "Mn") for t in latin]
        rows += [{"char": c, "ascii": a} for c, a in zip(own, through("Latin-ASCII", bare))]
    pq.write_table(pa.Table.from_pylist(rows), OUT / "ascii.parquet", compression="zstd")
    latin = through("Any-Latin", chars)
    pq.write_table(pa.Table.from_pylist([{"char": c, "latin": t} for c, t in zip(chars, latin) if c != t]), OUT / "latin.parquet", compression="zstd")
    print(len(rows), sum(c != t for c, t in zip(chars, latin)))


if __name__ == "__main__":
    main()
