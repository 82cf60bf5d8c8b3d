"""Named jobs.  Each job is a function ``(Airline, **params) -> DataFrame``."""
