"""Zone, calendar and cyclic features on TIMESTAMP_NTZ (UTC wall clock)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from haze.schemas import LOCAL_TZ


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def local_time(ts: str | Column, tz: str = LOCAL_TZ, source_tz: str = "UTC") -> Column:
    """UTC wall clock -> local wall clock, both TIMESTAMP_NTZ."""
    return F.convert_timezone(F.lit(source_tz), F.lit(tz), _col(ts))


def cyclic(x: str | Column, period: int) -> tuple[Column, Column]:
    """sin/cos of 2*pi*x/period, same operation order as the source."""
    v = _col(x)
    arg = F.lit(2 * math.pi) * v / F.lit(float(period))
    return F.sin(arg), F.cos(arg)


def calendar_columns(ts: str | Column, tz: str = LOCAL_TZ, cyclic_parts: bool = True) -> dict[str, Column]:
    """hour, day_of_week (Monday=0), day_of_month, month, quarter, is_weekend (+ sin/cos)."""
    if isinstance(ts, str):
        loc_sql = f"convert_timezone('UTC', '{tz}', `{ts}`)"
        parts = {"hour": f"hour({loc_sql})", "day_of_week": f"weekday({loc_sql})",
                 "day_of_month": f"dayofmonth({loc_sql})", "month": f"month({loc_sql})",
                 "quarter": f"quarter({loc_sql})",
                 "is_weekend": f"CAST(weekday({loc_sql}) >= 5 AS INT)"}
        if cyclic_parts:
            two_pi = f"{2 * math.pi!r}D"
            for name, period in (("hour", 24), ("day_of_week", 7), ("month", 12)):
                arg = f"{two_pi} * {parts[name]} / {float(period)!r}D"
                parts[f"{name}_sin"] = f"sin({arg})"
                parts[f"{name}_cos"] = f"cos({arg})"
        return {k: F.expr(v) for k, v in parts.items()}
    loc = local_time(ts, tz)
    hour = F.hour(loc)
    dow = F.weekday(loc)
    month = F.month(loc)
    out = {
        "hour": hour,
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(loc),
        "month": month,
        "quarter": F.quarter(loc),
        "is_weekend": (dow >= 5).cast("int"),
    }
    if cyclic_parts:
        out["hour_sin"], out["hour_cos"] = cyclic(hour, 24)
        out["day_of_week_sin"], out["day_of_week_cos"] = cyclic(dow, 7)
        out["month_sin"], out["month_cos"] = cyclic(month, 12)
    return out
