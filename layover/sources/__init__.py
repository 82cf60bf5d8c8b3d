"""Sources and sinks: Parquet scans, the airline adapter, CSV, tables."""

from layover.sources.adapter import Airline, load

__all__ = ["Airline", "load"]
