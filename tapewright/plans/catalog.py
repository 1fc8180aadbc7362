"""All registered queries."""

from __future__ import annotations

from tapewright.plans import registry
from tapewright.plans import (  # noqa: F401
    queries_features, queries_options, queries_scalars,
    queries_stats, queries_storage, queries_streaming,
    queries_trades,
)


def queries():
    return dict(registry.QUERIES)


def oracle_sql():
    return dict(registry.ORACLES)
