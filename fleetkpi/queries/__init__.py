"""All registered queries by name."""

from __future__ import annotations

from .base import Query
from .checks import QUERIES as _CHECKS
from .history import QUERIES as _HISTORY
from .indicators import QUERIES as _INDICATORS
from .logs import QUERIES as _LOGS
from .models import QUERIES as _MODELS
from .reports import QUERIES as _REPORTS
from .streams import QUERIES as _STREAMS
from .timelines import QUERIES as _TIMELINES


def catalogue() -> dict[str, Query]:
    merged: dict[str, Query] = {}
    for part in (_LOGS, _TIMELINES, _REPORTS, _MODELS, _INDICATORS, _HISTORY, _STREAMS, _CHECKS):
        repeated = merged.keys() & part.keys()
        if repeated:
            raise ValueError(f"registered twice: {sorted(repeated)}")
        merged.update(part)
    return merged
