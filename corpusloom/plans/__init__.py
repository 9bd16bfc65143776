"""Named queries over the driver's tables, each beside the DuckDB SQL it must equal."""

from corpusloom.plans import etl, lexical, reading, reuse, scalars, search, session, structure
from corpusloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "etl", "lexical", "reading", "reuse", "scalars", "search", "session", "structure"]
