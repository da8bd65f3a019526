"""All registered queries and oracles."""

from __future__ import annotations

from functools import wraps

from fundlens.plans.browse_queries import browse_queries
from fundlens.plans.ingest_queries import ingest_oracles, ingest_queries
from fundlens.plans.model_queries import model_oracles, model_queries
from fundlens.plans.oracles import browse_oracles
from fundlens.plans.text_queries import text_oracles, text_queries
from fundlens.session import ship_package


def _ready(query):
    @wraps(query)
    def run(spark, sf_dir):
        ship_package(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict:
    found = {**browse_queries(), **ingest_queries(), **text_queries(), **model_queries()}
    return {name: _ready(query) for name, query in found.items()}


def oracle_sql() -> dict[str, str]:
    return {**browse_oracles(), **ingest_oracles(), **text_oracles(), **model_oracles()}
