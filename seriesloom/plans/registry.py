"""All registered queries of the core, with the SQL that checks them."""

from __future__ import annotations

from seriesloom.plans import cloud_queries, data_quality, kernel_queries, metric_queries, series_queries, transport_queries

MODULES = (data_quality, series_queries, cloud_queries, metric_queries, kernel_queries, transport_queries)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE.items()}


def flagship(spark, sf_dir):
    return queries()["p5_grid"](spark, sf_dir)
