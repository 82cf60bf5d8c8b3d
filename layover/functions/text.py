"""String helpers with Postgres semantics.

Postgres ``concat`` skips NULL arguments while Spark's returns NULL, so
every argument is wrapped in ``coalesce(x, '')``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x):
    return F.col(x) if isinstance(x, str) else x


def concat_ns(*parts) -> Column:
    """NULL-skipping concat; plain strings are column names, use ``F.lit`` for text."""
    return F.concat(*[F.coalesce(_c(p).cast("string"), F.lit("")) for p in parts])


def route(dep="departure_airport", arr="arrival_airport") -> Column:
    """``concat(departure_airport, '-', arrival_airport)``."""
    return concat_ns(dep, F.lit("-"), arr)


def dotted_name(first="first_name", last="last_name") -> Column:
    """``concat(upper(first_name), '.', upper(last_name))``."""
    return concat_ns(F.upper(_c(first)), F.lit("."), F.upper(_c(last)))
