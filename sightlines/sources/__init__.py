"""Table sources and result sinks."""

from sightlines.sources.supplied import supplied_tables
from sightlines.sources.tables import OccurrenceTables

__all__ = ["OccurrenceTables", "supplied_tables"]
