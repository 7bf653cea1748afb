"""The registered corpus queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixsieve.llm import collocations, decontaminate, exact, html, lmscore, merkle, mixing, nearcopies, quality, suffixes, tokens, topk, toxicity

MODULES = (tokens, exact, html, mixing, decontaminate, toxicity, nearcopies, quality, lmscore, suffixes, merkle, collocations, topk)


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for m in MODULES for name, query in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.ORACLES.items()}
