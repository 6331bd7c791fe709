"""Comparison of a query's rows with its SQL's: names, number and values, in any order."""

import datetime
import decimal
import math


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return v


def rows(columns, values):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


def differs(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    found = con.execute(sql)
    want = rows([d[0] for d in found.description], found.fetchall())
    if got[0] != want[0]:
        return f"columns {got[0]} and {want[0]}"
    if got[1] != want[1]:
        pairs = [(a, b) for a, b in zip(got[1], want[1], strict=False) if a != b][:3]
        return f"{len(got[1])} and {len(want[1])} rows, first differences {pairs}"
    return None
