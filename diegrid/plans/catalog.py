"""All registered queries and their SQL statements."""

from diegrid.plans import die_queries  # noqa: F401
from diegrid.plans import duplicate_queries  # noqa: F401
from diegrid.plans import feature_queries  # noqa: F401
from diegrid.plans import flow_queries  # noqa: F401
from diegrid.plans import metric_queries  # noqa: F401
from diegrid.plans import pixel_queries  # noqa: F401
from diegrid.plans import policy_queries  # noqa: F401
from diegrid.plans import rootcause_queries  # noqa: F401
from diegrid.plans import source_queries  # noqa: F401
from diegrid.plans import split_queries  # noqa: F401
from diegrid.plans.registry import BODIES, QUERIES, statement

SQL = {key: statement(body) for key, body in BODIES.items()}

__all__ = ["QUERIES", "SQL"]
