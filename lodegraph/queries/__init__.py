"""The registered queries of the engine's own operators, by family."""

from lodegraph.queries import attention, attribution, builders, context, graph, more, retrieval, statistics, streaming, structure, text, verification
from lodegraph.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "attention", "attribution", "builders", "context", "graph", "more", "retrieval", "statistics", "streaming", "structure", "text", "verification"]
