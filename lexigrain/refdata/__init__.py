"""Packaged reference tables: Python objects for kernels and plan-time use, DataFrames for joins."""

from __future__ import annotations

import json
from functools import cache
from pathlib import Path

import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession

FOLDER = Path(__file__).resolve().parent


def path(name: str) -> str:
    """Where a table is packaged."""
    return str(FOLDER / f"{name}.parquet")


@cache
def rows(name: str) -> list[dict]:
    """A table as dictionaries; read once a process."""
    return pq.read_table(path(name)).to_pylist()


def frame(spark: SparkSession, name: str) -> DataFrame:
    """A table as a DataFrame. It travels in the plan, so executors need no file of ours."""
    return spark.createDataFrame(pq.read_table(path(name)))


@cache
def words(name: str) -> list[str]:
    """A word list: stopwords, nullwords, nullplaces, person_name_prefixes, org_name_prefixes, obj_name_prefixes, name_split_phrases or generic_person_names."""
    return next(r["words"] for r in rows("word_lists") if r["list"] == name)


def ordinals() -> dict[int, list[str]]:
    return {r["number"]: r["forms"] for r in rows("ordinals")}


@cache
def address_formats() -> dict[str, dict]:
    return {r["country"]: json.loads(r["spec"]) for r in rows("address_formats")}


@cache
def chars(name: str) -> dict[int, str]:
    """A transliteration table, for ``str.translate``."""
    column = "ascii" if name == "ascii" else "latin"
    return {ord(r["char"]): r[column] for r in rows(name)}
