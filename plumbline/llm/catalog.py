"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import byte_bpe, exact_dedup, filter_audit, language_id, ngram_join, packing, progressive_jpeg, quality, token_alignment, token_output, url_filter, vector_dedup, warc

_MODULES = [language_id, quality, progressive_jpeg, ngram_join, byte_bpe, packing, exact_dedup, warc, token_output, url_filter, token_alignment, filter_audit, vector_dedup]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: fn for m in _MODULES for name, fn in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
