"""Rows of a DataFrame against rows of SQL, in any order."""

from __future__ import annotations

import math


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def same_rows(df, con, sql: str) -> None:
    names = sorted(df.columns)
    ours = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=str)
    result = con.sql(sql)
    theirs_names = [d[0] for d in result.description]
    assert sorted(theirs_names) == names
    at = [theirs_names.index(n) for n in names]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=str)
    assert ours == theirs
