"""Registered queries, one or more per operator, with the SQL that must agree."""

from tidemark.catalog import base
from tidemark.catalog import (  # noqa: F401  (importing registers the queries)
    detectors, parts, scoring, streams, tables, tuned, workflows)

QUERIES = base.QUERIES
ORACLES = base.ORACLES
