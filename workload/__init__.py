"""Registered queries: every operator on the shared test tables, with its DuckDB equivalent."""

from workload import aggregates, evaluation, features, filters, joins, learning, sampled, shaping, sources, variants

ALL_MODULES = (sources, filters, joins, aggregates, shaping, sampled, evaluation, features, learning, variants)
