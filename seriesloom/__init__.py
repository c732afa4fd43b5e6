"""seriesloom: forecasting over panels of many time series, written as Spark DataFrame jobs."""
