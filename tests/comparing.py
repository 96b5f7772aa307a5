"""Values of both engines, made comparable."""

from __future__ import annotations

import datetime
import decimal
import math

SF = "/root/testdata/sf0.001"


def plain(v):
    """A value as both engines can give it."""
    if isinstance(v, (float, decimal.Decimal)):
        x = float(v)
        return "nan" if math.isnan(x) else round(x, 8) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return str(v) if isinstance(v, (datetime.date, datetime.datetime)) else v


def rows_of(df) -> list[tuple]:
    names = sorted(df.columns)
    return sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)


def duck_rows(con, sql: str) -> tuple[list[str], list[tuple]]:
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    order = [names.index(n) for n in sorted(names)]
    return sorted(names), sorted((tuple(plain(r[i]) for i in order) for r in got.fetchall()), key=repr)
