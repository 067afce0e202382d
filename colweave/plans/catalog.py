"""All registered queries; importing the topic modules fills the registry."""

from colweave.plans import (clean_queries, embed_queries, graph_queries, metric_queries,  # noqa: F401
                            profile_queries, report_queries)
from colweave.plans import large_queries  # noqa: F401, E402  (takes the SQL of the modules above)
from colweave.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
