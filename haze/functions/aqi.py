"""Air Quality Index as native column expressions (no Python in the hot path)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.schemas import (AQI_BREAKPOINTS, AQI_CATEGORIES, AQI_POLLUTANT_ORDER, DISPLAY_BANDS,
                          FALLBACK_CATEGORY, band_slope)


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def dsql(x: float) -> str:
    """Exact Spark SQL double literal (shortest repr round-trips)."""
    return f"{float(x)!r}D"


def subindex_sql(col: str, pollutant: str, bands: dict | None = None) -> str:
    """The band CASE as Spark SQL text: one expression, built in one call."""
    table = (bands or AQI_BREAKPOINTS).get(pollutant, [])
    if not table:
        return "CAST(NULL AS DOUBLE)"
    c = f"`{col}`"
    arms = " ".join(f"WHEN {c} >= {dsql(cl)} AND {c} <= {dsql(ch)} "
                    f"THEN {dsql(band_slope(cl, ch, il, ih))} * ({c} - {dsql(cl)}) + {dsql(il)}"
                    for cl, ch, il, ih in table)
    return f"CASE {arms} ELSE CAST(NULL AS DOUBLE) END"


def aqi_subindex(conc: str | Column, pollutant: str, unit_scale: float = 1.0,
                 bands: dict | None = None) -> Column:
    """Piecewise-linear sub-index; NULL outside every band (gaps and ceiling).

    Bands are tried in order with both edges inclusive, and the value is
    ``((Ih-Il)/(Ch-Cl))*(c-Cl)+Il`` in that operation order.
    """
    if isinstance(conc, str) and unit_scale == 1.0:
        return F.expr(subindex_sql(conc, pollutant, bands))
    c = _col(conc)
    if unit_scale != 1.0:
        c = c * F.lit(float(unit_scale))
    table = (bands or AQI_BREAKPOINTS).get(pollutant, [])
    expr = None
    for clow, chigh, ilow, ihigh in table:
        cond = (c >= F.lit(float(clow))) & (c <= F.lit(float(chigh)))
        val = F.lit(band_slope(clow, chigh, ilow, ihigh)) * (c - F.lit(float(clow))) + F.lit(float(ilow))
        expr = F.when(cond, val) if expr is None else expr.when(cond, val)
    if expr is None:
        return F.lit(None).cast("double")
    return expr.otherwise(F.lit(None).cast("double"))


def overall_aqi(pollutants: list[str] | None = None, nan_policy: str = "first", bands: dict | None = None,
                unit_scale: dict[str, float] | None = None, without: str | None = None) -> Column:
    """Overall index = max of sub-indices.

    ``nan_policy="first"`` keeps the source rule: a max scan that starts at
    an out-of-band value stays undefined, so the result is NULL exactly when
    the first present pollutant (in ``pollutants`` order) is out of band.
    ``"skip"`` is a plain max that ignores out-of-band values.

    ``bands`` replaces the band table, ``unit_scale`` multiplies the named
    pollutants first, and ``without`` treats one of them as absent.
    """
    order = [p for p in (pollutants or AQI_POLLUTANT_ORDER) if p != without]
    scale = unit_scale or {}

    def sub(p: str) -> str:
        if scale.get(p, 1.0) == 1.0:
            return subindex_sql(p, p, bands)
        return subindex_sql(p, p, bands).replace(f"`{p}`", f"(`{p}` * {dsql(scale[p])})")

    if not order:
        return F.lit(None).cast("double")
    sub_sql = [sub(p) for p in order]
    top_sql = f"greatest({', '.join(sub_sql)})" if len(sub_sql) > 1 else sub_sql[0]
    if nan_policy == "skip":
        return F.expr(top_sql)
    first_sql = "CASE " + " ".join(f"WHEN `{p}` IS NOT NULL THEN {t}" for p, t in zip(order, sub_sql)) + " END"
    return F.expr(f"CASE WHEN ({first_sql}) IS NULL THEN CAST(NULL AS DOUBLE) ELSE {top_sql} END")


def legend(spark: SparkSession) -> DataFrame:
    """The display bands as a table of six rows: (ordinal, above, up_to, band); the last has no upper end."""
    names = [*DISPLAY_BANDS, (None, FALLBACK_CATEGORY)]
    rows = [(i + 1, float(names[i - 1][0]) if i else None, None if up is None else float(up), name) for i, (up, name) in enumerate(names)]
    return spark.createDataFrame(rows, "ordinal int, above double, up_to double, band string")


def aqi_category(aqi: str | Column) -> Column:
    """Category with integer gaps (50.5 -> Hazardous); NULL falls through too."""
    if isinstance(aqi, str):
        arms = " ".join(f"WHEN `{aqi}` >= {dsql(lo)} AND `{aqi}` <= {dsql(hi)} THEN '{name}'"
                        for lo, hi, name in AQI_CATEGORIES)
        return F.expr(f"CASE {arms} ELSE '{FALLBACK_CATEGORY}' END")
    a = _col(aqi)
    expr = None
    for low, high, name in AQI_CATEGORIES:
        cond = (a >= F.lit(float(low))) & (a <= F.lit(float(high)))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(FALLBACK_CATEGORY))


def display_band(aqi: str | Column) -> Column:
    """Gap-free display band: <=50, <=100, ... else Hazardous."""
    if isinstance(aqi, str):
        arms = " ".join(f"WHEN `{aqi}` <= {dsql(up)} THEN '{name}'" for up, name in DISPLAY_BANDS)
        return F.expr(f"CASE {arms} ELSE '{FALLBACK_CATEGORY}' END")
    a = _col(aqi)
    expr = None
    for upper, name in DISPLAY_BANDS:
        cond = a <= F.lit(float(upper))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(FALLBACK_CATEGORY))
