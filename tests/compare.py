"""Order-free comparison of a Spark result with an oracle's."""

from __future__ import annotations

import math


def cell(v):
    if v is None or isinstance(v, float) and math.isnan(v) or str(v) in ("NaT", "<NA>"):
        return "NULL"
    if isinstance(v, float) and v.is_integer():
        return str(int(v))  # counts with gaps are floats on one side
    if isinstance(v, float):
        return f"{v:.6g}" if abs(v) > 1e6 else f"{round(v, 5):.5f}"
    if hasattr(v, "__iter__") and not isinstance(v, str):
        return "[" + ",".join(map(cell, v)) + "]"
    return str(v).replace(" 00:00:00", "")


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(map(cell, r)) for r in frame[columns].itertuples(index=False))
