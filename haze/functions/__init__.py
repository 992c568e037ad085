"""Column -> Column expressions. All run inside whole-stage codegen."""

from haze.functions.aqi import aqi_category, aqi_subindex, display_band, legend, overall_aqi
from haze.functions.timefeat import calendar_columns, cyclic, local_time

__all__ = ["aqi_category", "aqi_subindex", "display_band", "legend", "overall_aqi", "calendar_columns", "cyclic", "local_time"]
