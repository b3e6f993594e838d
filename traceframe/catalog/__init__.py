"""All registered queries and oracles."""

from traceframe.catalog import auditing, documents, extraction, files, functions, matching, tables  # noqa: F401
from traceframe.catalog.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracles() -> dict[str, str]:
    return dict(ORACLES)
