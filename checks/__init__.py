"""Queries over the given tables, each with the SQL that must give the same rows."""

from . import modelling, normalization, scores, statistics, streams, tables, windows

ALL = [
    part.checks
    for part in (windows, normalization, tables, scores, statistics, modelling, streams)
]
