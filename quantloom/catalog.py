"""Registry of the engine's queries and of the DuckDB SQL that checks them."""

from __future__ import annotations

from quantloom.plans import queries as Q


def flagship(spark, sf_dir):
    return Q.flagship(spark, sf_dir)


def queries() -> dict:
    return dict(Q.QUERIES)


def oracle_sql() -> dict:
    return dict(Q.ORACLES)
