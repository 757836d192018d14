"""All registered queries and their SQL counterparts."""

from __future__ import annotations

from loomlog.plans import activity, funnel, orders, preparation, retention, stats, stores

_MODULES = (preparation, activity, orders, funnel, retention, stats, stores)

QUERIES = {name: fn for module in _MODULES for name, fn in module.QUERIES.items()}
ORACLES = {name: sql for module in _MODULES for name, sql in module.ORACLES.items()}
