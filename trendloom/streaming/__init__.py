"""Standing queries, buffered runs and keyed state over streams."""

from trendloom.streaming.buffered import BufferedRun
from trendloom.streaming.standing import StandingOptions, active_set, moves, standing_changes

__all__ = ["BufferedRun", "StandingOptions", "active_set", "moves", "standing_changes"]
