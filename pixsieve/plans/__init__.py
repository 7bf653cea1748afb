"""Registered queries: each plan module holds QUERIES (name to callable) and ORACLE (name to SQL)."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

MODULES = ("signature_plans", "chain_plans", "block_plans", "byte_plans", "lookup_plans", "corpus_plans", "extract_plans", "camera_plans", "file_plans", "picture_plans", "nested_plans", "payload_plans")


def _modules():
    for m in MODULES:
        try:
            yield importlib.import_module(f"pixsieve.plans.{m}")
        except ModuleNotFoundError as e:
            if e.name != f"pixsieve.plans.{m}":
                raise


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLE.items()}
