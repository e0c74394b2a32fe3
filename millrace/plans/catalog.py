"""All named queries of the library, and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from millrace.functions import extensions, scalar
from millrace.operators import aggregates, joins, quantiles, reshape, windows
from millrace.plans import star
from millrace.sources import formats
from millrace.streaming import arrivals, events

_MODULES = (star, formats, reshape, joins, aggregates, quantiles, windows, scalar, extensions, events, arrivals)
QUERIES = {name: query for m in _MODULES for name, query in m.QUERIES.items()}
ORACLES = {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
