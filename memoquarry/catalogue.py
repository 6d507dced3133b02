"""All registered queries and their SQL."""

from memoquarry.plans import base, eval_queries, graph_queries, memory_queries, text_queries  # noqa: F401  they register themselves

QUERIES, ORACLES = base.QUERIES, base.ORACLES
