"""Every query of the library by name, each with its SQL where SQL can say it."""

from __future__ import annotations

from logfold.plans import evaluation, logs, mapping, reports

MODULES = (logs, mapping, evaluation, reports)


def queries() -> dict:
    return {f.__name__: f for module in MODULES for f in module.QUERIES}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLE.items()}
