"""One query per operator, with the SQL that must give the same rows."""

from .registry import ORACLES, QUERIES
from . import checks, contracts, counts, jobs, joins, loops, outcomes, scalars, scans, states, streams  # noqa: F401,E402

__all__ = ["ORACLES", "QUERIES"]
