"""Query plans over the operators; QUERIES and SQL hold all registered ones."""

from . import layout_queries, live_queries, pixel_queries, reading, stream_queries, table_queries  # noqa: F401  they register themselves
from .queries import QUERIES, SQL  # noqa: F401
