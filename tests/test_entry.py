import math

import duckdb
import pandas as pd

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
FAST = ["daily_aqi", "aqi_overall", "air_weather_join", "quality_audit", "full_features", "bucketed_features",
        "describe", "histogram", "regression_metrics", "forecast_inputs", "daily_forecast", "json_hourly_scan",
        "store_append", "feature_increment", "time_split", "stream_daily_alerts", "daily_alerts", "ingest_three_runs",
        "store_append_dupes", "stream_ingest", "json_weather_scan", "describe_skewed", "box_stats", "kde", "band_legend",
        "correlation_matrix", "augment", "hash_sample", "fixed_sample", "mean_abs_importance", "top_features", "dedup_first",
        "new_rows_only", "stream_join", "stream_features", "row_positions", "moving_average", "fill_both", "recent_trend", "last_row", "aqi_long_rangejoin",
        "user_full_features", "user_store_append", "user_time_split", "user_tail_rows", "user_forecast_inputs",
        "order_series_features", "latest_model", "metrics_table"]


def _canon(df):
    cols = sorted(df.columns)
    out = []
    for rec in df[cols].itertuples(index=False, name=None):
        row = []
        for v in rec:
            if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
                row.append(None)
            elif isinstance(v, float):
                row.append(round(v, 6))
            elif isinstance(v, pd.Timestamp):
                v = v.to_pydatetime()
                row.append(v.date().isoformat() if v.hour == v.minute == v.second == 0 else v.isoformat())
            elif hasattr(v, "isoformat"):
                row.append(v.isoformat())
            else:
                row.append(v.item() if hasattr(v, "item") else v)
        out.append(tuple(row))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "mean_aqi" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())
    assert len(E.queries()) >= 60


def test_fast_queries_match_duckdb(spark):
    con = duckdb.connect()
    for t in ["events", "orders", "lineitem", "customer", "nation"]:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    qs, sql = E.queries(), E.oracle_sql()
    for k in FAST:
        a = _canon(qs[k](spark, SF).toPandas())
        b = _canon(con.execute(sql[k]).df())
        assert a == b, k
