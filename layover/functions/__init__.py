"""Column-expression helpers.  Every helper returns a JVM-side ``Column``;
none of them is a Python UDF, so they stay inside whole-stage codegen."""

from layover.functions.text import concat_ns, dotted_name, route
from layover.functions.time import (
    add_minutes,
    days_between,
    hours_between,
    minutes_between,
    seconds_between,
)

__all__ = [
    "add_minutes",
    "concat_ns",
    "days_between",
    "dotted_name",
    "hours_between",
    "minutes_between",
    "route",
    "seconds_between",
]
