"""Registered queries over the driver tables and their SQL counterparts."""
from __future__ import annotations

from clustrum.plans import (
    cleaning, cohorts, density, drift, geometry, models, partitions, profile, requests, sources, streams,
)

MODULES = (sources, cleaning, profile, cohorts, geometry, partitions, drift, models, density, requests, streams)


def all_queries() -> dict:
    return {name: fn for module in MODULES for name, fn in module.QUERIES.items()}


def all_oracles() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
