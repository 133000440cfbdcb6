"""Participant-progress analytics on Spark.

Screen logs, a participant roster and a contact list go in; progress, funnel
stages, dashboard aggregates, call lists and change reports come out.  Every
operator is a DataFrame transform with an explicit ``as_of`` clock.
"""

from trailmark.config import DEFAULT_CONFIG, ProgressConfig
from trailmark.plans.refresh import refresh

__all__ = ["DEFAULT_CONFIG", "ProgressConfig", "refresh"]
