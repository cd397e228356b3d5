"""All queries by name."""

from __future__ import annotations

from .analysis import QUERIES as ANALYSIS
from .case import Query
from .evaluation import QUERIES as EVALUATION
from .relational import QUERIES as RELATIONAL
from .trust import QUERIES as TRUST

QUERIES: dict[str, Query] = {**RELATIONAL, **EVALUATION, **ANALYSIS, **TRUST}
