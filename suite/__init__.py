"""Registered queries: each runs an operator over whole tables; most have the same result as SQL."""

from suite.registry import QUERIES, SQL
from suite import (  # noqa: F401
    flagship, grouping, joining, rowwise, shaping, checking, sampling, quality, inout, receipts, moving)
