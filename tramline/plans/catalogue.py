"""Every query of the library by name, with its SQL."""

from __future__ import annotations

from tramline.plans import arrival_plans, catalog_plans, change_plans, import_plans, ingest_plans, live_plans, network_plans, spatial_plans, stream_plans, train_plans, vehicle_plans  # noqa: F401
from tramline.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
