"""All queries of the engine by name, each with the SQL that it matches.

Runs are played by vectors (regular, with a class) and by users' events (irregular); results by line items;
logs by conversations. Floats are given in ten-thousandths, so that results compare exactly.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import context, contracts, event_logs, families, impulses, kernels, loading, logs, registry, reports, scalars, selection, tuning

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return kernels.QUERIES | reports.QUERIES | logs.QUERIES | registry.QUERIES | contracts.QUERIES | impulses.QUERIES | loading.QUERIES | scalars.QUERIES | selection.QUERIES | event_logs.QUERIES | tuning.QUERIES | families.QUERIES | context.QUERIES


def oracle_sql() -> dict[str, str]:
    return kernels.ORACLES | reports.ORACLES | logs.ORACLES | registry.ORACLES | contracts.ORACLES | impulses.ORACLES | loading.ORACLES | scalars.ORACLES | selection.ORACLES | event_logs.ORACLES | tuning.ORACLES | families.ORACLES | context.ORACLES
