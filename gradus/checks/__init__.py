"""Every operator bound to the test tables, with the SQL it must agree with.

``queries`` maps a name to ``f(spark, folder) -> DataFrame``; ``oracles`` maps the same name to SQL
over the same tables. The SQL is written independently of the Spark plans.
"""

from . import aggregates, composite, earlier, joins, models, projections, tables_io  # noqa: F401
from .registry import oracles, queries

__all__ = ["oracles", "queries"]
