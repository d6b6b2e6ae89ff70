"""Structured Streaming jobs."""

from sightlines.streaming.latency import start_latency
from sightlines.streaming.slow_log import start_slow_log

__all__ = ["start_latency", "start_slow_log"]
