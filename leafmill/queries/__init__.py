"""The engine's queries over rendered fixtures: tables shown as pages, answers, votes and jobs."""

from leafmill.queries import columns, first_version, pages, relations, rollups  # noqa: F401  they register their queries
from leafmill.queries.registry import ORACLES, QUERIES  # noqa: F401
