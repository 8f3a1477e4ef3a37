"""Registered queries over the driver tables and the SQL each must equal."""

from __future__ import annotations

from . import basics, hits, kernels, names, patches, plans, rules, seams, signals, spectral, stores, texts, trees, written, zones

PARTS = (signals, zones, hits, texts, spectral, plans, rules, basics, kernels, names, patches, seams, stores, trees, written)
QUERIES = {name: query for part in PARTS for name, query in part.QUERIES.items()}
SQL = {name: text for part in PARTS for name, text in part.SQL.items()}
FLAGSHIP = "set_gain"
