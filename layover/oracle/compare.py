"""Order-insensitive comparison of two result frames (pandas).

Columns are compared by name; doubles are rounded to 6 places; NULL-like
values (None, NaN, NaT, pd.NA) are unified; timestamps become integers.
"""

from __future__ import annotations

import hashlib

import pandas as pd


def normalize(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        s = df[c]
        if pd.api.types.is_float_dtype(s):
            df[c] = s.round(6)
        elif pd.api.types.is_datetime64_any_dtype(s):
            df[c] = s.astype("datetime64[us]").astype("int64").where(s.notna(), None)
        df[c] = df[c].map(lambda v: None if v is None or v is pd.NA or v is pd.NaT
                          or (isinstance(v, float) and v != v) else v)
    return df


def rows(df: pd.DataFrame) -> list[str]:
    return sorted(repr(tuple(r)) for r in normalize(df).itertuples(index=False))


def frame_hash(df: pd.DataFrame) -> str:
    return hashlib.sha1("\n".join(rows(df)).encode()).hexdigest()


def same(a: pd.DataFrame, b: pd.DataFrame) -> tuple[bool, str]:
    if sorted(a.columns) != sorted(b.columns):
        return False, f"columns differ: {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return False, f"row counts differ: {len(a)} vs {len(b)}"
    ra, rb = rows(a), rows(b)
    if ra != rb:
        sa, sb = set(ra), set(rb)
        return False, f"values differ, e.g. only left {list(sa - sb)[:2]} only right {list(sb - sa)[:2]}"
    return True, ""
