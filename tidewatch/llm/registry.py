"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from tidewatch.llm import conversations, decontaminate, html_text, importance, multiset_hash, near, pieces, quality, secret_scan, substring, token_files, toxicity, url_filter  # noqa: F401  (operators register their queries)
from tidewatch.llm.common import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
