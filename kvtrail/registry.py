"""All registered queries of the core library, with their SQL counterparts."""

from __future__ import annotations

from kvtrail.plans import bundle_queries as _bundles  # noqa: F401
from kvtrail.plans import catalog
from kvtrail.plans import filter_queries as _filters  # noqa: F401
from kvtrail.plans import history_queries as _history  # noqa: F401
from kvtrail.plans import kv_queries as _kv  # noqa: F401
from kvtrail.plans import log_queries as _log  # noqa: F401
from kvtrail.plans import secret_queries as _secrets  # noqa: F401
from kvtrail.plans import stream_queries as _streams  # noqa: F401
from kvtrail.plans import summary_queries as _summary  # noqa: F401
from kvtrail.plans import validation_queries as _validation  # noqa: F401

QUERIES = catalog.QUERIES
ORACLE_SQL = catalog.ORACLE_SQL
