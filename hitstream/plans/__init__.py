"""The query catalogue: importing this package registers every query."""

from hitstream.plans import analysis, frontend, joins, streams, telemetry, triggers, waves
from hitstream.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "analysis", "frontend", "joins", "streams", "telemetry", "triggers", "waves"]
