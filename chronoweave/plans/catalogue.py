"""Registered queries of the temporal operators."""

from . import q_graph, q_io, q_narrative, q_text

PARTS = (q_graph, q_text, q_narrative, q_io)
QUERIES = {name: f for part in PARTS for name, f in part.QUERIES.items()}
ORACLES = {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
