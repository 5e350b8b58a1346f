"""The registered queries and their SQL, gathered from the operator families."""

from __future__ import annotations


from . import evaluate, evidence, extras, index, ingest, knowledge, streams, text


def families() -> list:
    return [text, ingest, index, evidence, knowledge, evaluate, streams, extras]


def queries() -> dict:
    return {k: f for m in families() for k, (f, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: sql for m in families() for k, (_, sql) in m.QUERIES.items() if sql}
