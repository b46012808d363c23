"""All queries of the layout engine."""

from __future__ import annotations

from leafgrid.plans import evaluation, files, headings, page_queries, projections, repairs, tables, transactions
from leafgrid.plans.registry import Registry

REGISTRY = Registry()
for part in (evaluation, headings, projections, tables, page_queries, repairs, files, transactions):
    for name, query in part.REGISTRY.queries.items():
        REGISTRY.add(name, query, part.REGISTRY.oracles.get(name))
