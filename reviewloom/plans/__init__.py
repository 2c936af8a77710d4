"""Registered queries: every operator on the given tables, with an independent SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from ..functions.strings import WS
from ..sources.tables import read_table as table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None = None):
    """Register a query under its function name."""
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def sql_norm(c: str) -> str:
    """SQL twin of ``norm_text``."""
    return f"regexp_replace(lower(coalesce({c}, '')), '^{WS}+|{WS}+$', '', 'g')"


def sql_split(key: str, seed: int = 20, percent: int = 80) -> str:
    """SQL twin of ``hash_split``."""
    digest = f"('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 12))::BIGINT % 100"
    return f"CASE WHEN {digest} < {percent} THEN 'train' ELSE 'test' END"


MODULES = (
    "dedup matching schema enrichment profiling encoding text vectors decisions extraction "
    "split io models incremental streams reviews"
).split()


def load() -> None:
    """Import every module that registers queries."""
    for name in MODULES:
        import_module(f"{__name__}.{name}")
