"""Registered queries over the driver tables (one per operator group)."""

from . import q_delivery, q_fields, q_files, q_json, q_packets, q_routes, q_time  # noqa: F401  (register queries)
from . import q_stream  # noqa: F401,E402  (uses the batch oracles)
from . import q_end  # noqa: F401,E402
from .registry import REGISTRY, Query, query

__all__ = ["REGISTRY", "Query", "query"]
