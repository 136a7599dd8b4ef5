"""Operators for preparing training text at scale; each module holds one and its query."""

import sys

from pyspark import cloudpickle

from . import (
    decontaminate,
    exact_dedup,
    html_text,
    license_scan,
    line_dedup,
    near_dedup,
    packing,
    periodic_runs,
    personal_data,
    quality_classifier,
    quality_rules,
    token_alignment,
    token_counts,
)

# Code of this package travels with the tasks: executors need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

_PARTS = (
    near_dedup,
    quality_rules,
    license_scan,
    line_dedup,
    token_counts,
    decontaminate,
    quality_classifier,
    personal_data,
    html_text,
    packing,
    exact_dedup,
    token_alignment,
    periodic_runs,
)


def queries() -> dict:
    return {name: query for part in _PARTS for name, query in part.ops.queries.items()}


def oracles() -> dict:
    return {name: sql for part in _PARTS for name, sql in part.ops.oracles.items()}
