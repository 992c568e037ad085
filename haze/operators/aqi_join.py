"""AQI through a band table: unpivot pollutants, then a range join.

The join is on ``pollutant`` with the concentration range as the residual
predicate. Its strategy is the planner's: the default table has 26 rows, whose
size the planner sees, so it is broadcast and the observations aren't shuffled; a
user's table may be of any size.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haze.schemas import AQI_BREAKPOINTS, AQI_POLLUTANT_ORDER, band_slope


def band_table(spark: SparkSession, bands: dict | None = None) -> DataFrame:
    """The bands as a local relation, whose size the planner knows."""
    rows = [(p, i, float(cl), float(ch), int(il), int(ih), band_slope(cl, ch, il, ih))
            for p, bs in (bands or AQI_BREAKPOINTS).items() for i, (cl, ch, il, ih) in enumerate(bs)]
    kinds = [("pollutant", pa.string()), ("band", pa.int32()), ("clow", pa.float64()), ("chigh", pa.float64()),
             ("ilow", pa.int32()), ("ihigh", pa.int32()), ("slope", pa.float64())]
    columns = [*zip(*rows)] or [()] * len(kinds)
    return spark.createDataFrame(pa.table({name: pa.array(c, kind) for (name, kind), c in zip(kinds, columns)}))


def pollutants_long(df: DataFrame, pollutants: list[str] | None = None, key=("city", "timestamp")) -> DataFrame:
    cols = [p for p in (pollutants or AQI_POLLUTANT_ORDER) if p in df.columns]
    return (df.select(*key, *cols)
              .unpivot(list(key), cols, "pollutant", "conc")
              .where(F.col("conc").isNotNull()))


def aqi_long_rangejoin(df: DataFrame, bands: dict | None = None, key=("city", "timestamp")) -> DataFrame:
    """(key..., pollutant, conc, sub_index); sub_index NULL when no band holds the value."""
    spark = df.sparkSession
    bt = band_table(spark, bands)
    long = pollutants_long(df, key=key)
    j = long.join(bt,
                  (long.pollutant == bt.pollutant) & (long.conc >= bt.clow) & (long.conc <= bt.chigh),
                  "left")
    sub = bt.slope * (long.conc - bt.clow) + bt.ilow.cast("double")
    return j.select(*[long[k] for k in key], long.pollutant, long.conc, sub.alias("sub_index"))
