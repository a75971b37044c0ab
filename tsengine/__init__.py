"""Time-series forecasting-data engine: DataFrame in, DataFrame out, on Spark."""
