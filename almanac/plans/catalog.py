"""All registered queries of the listings operators and their SQL twins."""

from __future__ import annotations

from almanac.plans import audits, dated, derived, merging, more, records, space  # noqa: F401  (modules register their queries)
from almanac.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
