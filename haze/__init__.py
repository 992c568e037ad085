"""haze: hourly air-quality analytics on Spark DataFrames.

Layout
------
functions/  Column -> Column expressions (AQI bands, calendar, formatting)
operators/  DataFrame -> DataFrame operators (cleaning, series windows,
            profiling, learning, forecasting, influence)
sources/    readers and writers (landed JSON payloads, CSV, keyed feature
            table, driver-table adapters)
plans/      composed jobs and the registered query catalogue
streaming/  Structured Streaming forms of the hourly jobs
"""

__version__ = "0.1.0"
