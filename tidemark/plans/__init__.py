"""All queries of the engine's own operators, with their SQL."""

from . import history_queries, model_queries, source_queries

QUERIES = {**history_queries.QUERIES, **model_queries.QUERIES, **source_queries.OWN}
ORACLES = {**history_queries.ORACLES, **model_queries.ORACLES, **source_queries.OWN_SQL}
